"""Exact top-k search by inner product over norm-sorted vectors.

Vectors are turned into whole numbers, so scores are exact. The principal axes of all vectors (a d x d matrix, summed by
Spark) turn them so that a few leading coordinates hold most of each length. Vectors are dealt into bands of descending
length, and bands into blocks of bounded size. Queries meet the longest band first, which gives each a score that its k-th
result reaches at least; then they go only to those bands whose longest vector could still reach it, as no inner product
exceeds the product of the lengths. Within a block, partial sums over the leading coordinates plus the lengths of what is left
(Cauchy-Schwarz) discard most vectors before the exact product.

Equal vectors are one candidate with its k + 1 smallest ids, so a vector that a third of all rows share costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from podium.sources.scratch import stage

SCALE = 1024
BANDS = 64
BLOCK_ROWS = 4096  # vectors in a block
CHUNK_ROWS = 4096  # queries that meet a block together
SLAB_ROWS = 512  # vectors of like length compared at once
HEAD = 16  # leading coordinates of the partial sums
#: Products of components up to this size add up exactly in 64-bit floats for up to 2 ** 11 components.
EXACT = 2**21
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def whole_vectors(vectors: DataFrame, id_: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``, the components times ``scale`` rounded down.

    Vectors that are null or hold a null or a component that is not finite are left out, as are rows without an id.
    """
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")) & ~F.isnan(c), F.lit(False)))
    kept = vectors.filter(F.col(id_).isNotNull() & F.col(embedding).isNotNull() & F.coalesce(fine, F.lit(False)))
    return kept.select(
        F.col(id_).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")
    )


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def _matrix(lists, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    out = np.zeros((len(lists), width), dtype=np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def principal_axes(distinct: DataFrame, width: int) -> np.ndarray:
    """The axes (columns) of the vectors' second moments, by falling weight.

    Every task sums its own vectors' products; width x width sums reach the driver, whatever the number of vectors.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = _matrix(batch.column(0).to_pylist(), width).astype(float)
            total += rows.T @ rows
        cells = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells.size)), pa.array(cells)], ["cell", "product"])

    sums = distinct.select("v").mapInArrow(products, "cell long, product double").groupBy("cell").agg(F.sum("product").alias("s"))
    moments = np.zeros(width * width)
    for row in sums.collect():  # width * width rows
        moments[row["cell"]] = row["s"]
    scale = max(1.0, float(np.abs(moments).max(initial=0)))
    _, axes = np.linalg.eigh(moments.reshape(width, width) / scale)
    return np.ascontiguousarray(axes[:, ::-1])


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products, within the range of a long."""
    largest = max(int(np.abs(queries).max(initial=0)), int(np.abs(rows).max(initial=0)))
    if largest <= EXACT and queries.shape[1] <= 2**11:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    wide = queries.astype(object) @ rows.astype(object).T
    return np.clip(wide, LONG_MIN, LONG_MAX).astype(np.int64) if wide.size else wide.astype(np.int64)


def block_top_k(q: pd.DataFrame, c: pd.DataFrame, k: int, width: int, axes: np.ndarray) -> pd.DataFrame:
    """The k best candidates of one block for every query of a chunk."""
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    if not len(q) or not len(c):
        return empty
    c = c.sort_values("norm", ascending=False, kind="stable")
    queries, rows = _matrix(list(q["v"]), width), _matrix(list(c["v"]), width)
    turned_q, turned_c = queries @ axes, rows @ axes
    head = min(HEAD, width)
    rest_q = np.sqrt((turned_q[:, head:] ** 2).sum(axis=1))
    rest_c = np.sqrt((turned_c[:, head:] ** 2).sum(axis=1))
    q_norm, c_norm = q["norm"].to_numpy(), c["norm"].to_numpy()
    ids, query_ids = [sorted(x) for x in c["ids"]], q["vec_id"].to_numpy()
    floor = q["reached"].to_numpy().astype(float)  # -inf where nothing is known yet
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    for at in range(0, len(rows), SLAB_ROWS):
        slab = slice(at, at + SLAB_ROWS)
        # Rounding may lower a bound by a part in 10^12 or so; the slack keeps it an upper bound.
        live = np.flatnonzero(q_norm * c_norm[at] * (1 + 1e-9) + 1e-6 >= floor)
        if not live.size:
            break  # lengths only fall from here
        bound = turned_q[live, :head] @ turned_c[slab, :head].T + np.outer(rest_q[live], rest_c[slab])
        bound += 1e-9 * np.outer(q_norm[live], c_norm[slab]) + 1e-6
        hope = bound >= floor[live, None]
        some = np.flatnonzero(hope.any(axis=0))
        if not some.size:
            continue
        exact, hope = scores(queries[live], rows[at + some]), hope[:, some]
        for row, i in enumerate(live):
            mine = np.flatnonzero(hope[row])
            if not mine.size:
                continue
            near, got = some[mine], exact[row, mine]
            if near.size > 4 * k:  # ties of the k-th score stay
                least = np.partition(got, -2 * k)[-2 * k]
                near, got = near[got >= least], got[got >= least]
            own = query_ids[i]
            found = best[i]
            for j, s in zip(near, got, strict=True):
                found.extend((-int(s), x) for x in [x for x in ids[at + j] if x != own][:k])
            found.sort()
            del found[k:]
            if len(found) == k:
                floor[i] = max(floor[i], -found[-1][0])
    out = [(own, x, -s) for own, found in zip(query_ids, best, strict=True) for s, x in found]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64") if out else empty


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """Each query's ``k`` highest scores among all other rows: query_id, rank, vec_id, score.

    ``is_query`` tells the queries by ``vec_id``. Ties go to the smaller id, a query's own row takes no part, and a query with fewer
    than ``k`` other rows gets all. Vectors of other lengths count as filled up with zeros. An id given to several different vectors
    keeps them as candidates; as queries they share their results. An empty table gives an empty result. Scores beyond a long stop at its ends.
    """
    rows = stage(whole_vectors(vectors, scale=scale), "topk-vectors")
    first = Window.partitionBy("v").orderBy("vec_id")
    # Ranking cuts each vector's ids to k + 1 in every task before the shuffle.
    few = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    distinct = few.groupBy("v").agg(F.collect_list("vec_id").alias("ids")).withColumn("norm", _norm(F.col("v")))
    distinct = stage(distinct, "topk-distinct")
    shape = distinct.agg(F.max(F.size("v")).alias("width"), F.percentile_approx("norm", [i / BANDS for i in range(1, BANDS)], 10_000).alias("cuts")).first()
    width = max(1, shape["width"] or 1)
    cuts = np.unique(np.array(shape["cuts"] or [], dtype=float))[::-1]  # BANDS - 1 at most
    axes = principal_axes(distinct, width)
    edges = F.array(*[F.lit(float(x)) for x in cuts]) if cuts.size else F.array().cast("array<double>")
    banded = distinct.withColumn("band", F.size(F.filter(edges, lambda e: F.col("norm") < e)))
    # A band is as many blocks as it has multiples of BLOCK_ROWS, also when all its vectors are of one length.
    blocks = banded.groupBy("band").agg(
        F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"), F.max("norm").alias("longest"), F.count("*").alias("n")
    )
    bands = {r["band"]: (r["parts"], r["longest"], r["n"]) for r in blocks.collect()}  # BANDS rows at most
    queries = rows.filter(is_query).dropDuplicates(["vec_id", "v"]).withColumn("norm", _norm(F.col("v")))
    queries = stage(queries, "topk-queries")
    chunks = max(1, -(-queries.count() // CHUNK_ROWS))
    if not bands:
        return _ranked(rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score long"), k)
    parts = F.element_at(F.create_map(*[F.lit(x) for b, (p, _, _) in bands.items() for x in (b, p)]), F.col("band"))
    candidates = banded.withColumn("part", F.pmod(F.xxhash64("v"), parts)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
    on = ["band", "part", "chunk"]
    schema = "query_id long, vec_id long, score long"
    find = lambda key, q, c: block_top_k(q, c, k, width, axes)

    def meet(q: DataFrame, c: DataFrame) -> DataFrame:
        spread = q.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        spread = spread.select("vec_id", "v", "norm", "reached", "band", F.col("part").cast("long"), "chunk")
        held = c.select("ids", "v", "norm", "band", F.col("part").cast("long"), "chunk")
        return spread.groupBy(*on).cogroup(held.groupBy(*on)).applyInPandas(find, schema)

    # The longest bands that hold k vectors besides the query's own come first.
    order, seen, opening = sorted(bands), 0, []
    for band in order:
        opening.append(band)
        seen += bands[band][2]
        if seen > k:
            break
    start = asked.withColumns({"reached": F.lit(float("-inf")), "band": F.explode(F.array(*[F.lit(b) for b in opening]))})
    seeds = stage(meet(start, candidates.filter(F.col("band") <= opening[-1])), "topk-first")
    kth = _ranked(seeds, k).filter(F.col("rank") == k).groupBy("query_id").agg(F.min("score").cast("double").alias("reached"))
    later = [b for b in order if b > opening[-1]]
    found = seeds
    if later:
        known = asked.join(kth, asked["vec_id"] == kth["query_id"], "left").withColumn("reached", F.coalesce("reached", F.lit(float("-inf"))))
        limits = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(float(bands[b][1])).alias("longest")) for b in later])
        slack = F.col("norm") * F.lit(1 + 1e-9)
        near = F.filter(limits, lambda x: slack * x["longest"] + 1e-6 >= F.col("reached"))
        going = known.withColumn("band", F.explode(F.transform(near, lambda x: x["band"])))
        found = seeds.unionByName(meet(going, candidates.filter(F.col("band") > opening[-1])))
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.distinct()
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
