"""Ranked lexical search: the best documents for every item, by dense blocked matrix products.

Scores are sums of whole numbers, a term's weight times its impact in a document. The terms that occur in a tile of items are numbered compactly; a tile of the item
matrix (items x terms, weights) times a tile of the impact matrix (terms x documents) is one BLAS product in float64. All its products and partial sums
stay below 2 ** 53, as tiles are narrow enough for that, so they are exact whatever the order BLAS adds in; tiles are added as 64-bit integers.
Each task keeps the best documents of every item it has seen. A tile passes on all that reach its own k-th score and the task's, ties included.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.words import blocks
from podium.sources.scratch import stage

BEST = 50
SCALE = 1_000_000_000
EXACT = 1 << 53  # whole numbers up to here are exact in float64
BLOCK_TERMS = 1 << 17  # terms of the items that are searched for in one pass over the documents
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 128, 2048, 1024
HELD = 1 << 16  # candidates held before they are cut to the best

#: Digits and letters of ASCII, A to Z as a to z, and all beyond ASCII belong to terms; the rest separates them.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms(text: str | None) -> list[bytes]:
    """A text's terms in UTF-8, repeats included."""
    return [] if text is None else text.encode().translate(_TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_norm(n: int, documents: int, all_terms: int) -> int:
    return 50 + 50 * n * documents // all_terms


class ItemTile:
    """Some items with their own compact vocabulary: a dense matrix of weights for each tile of terms."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        self.n = len(items)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.asarray(i, np.int64) for i in items]]))
        # Impacts are at most 10 ** 6, so a tile of this many terms cannot reach 2 ** 53.
        most = int(weights[self.vocabulary].max(initial=1)) * (SCALE // 1000)
        self.width = max(1, min(TILE_TERMS, (EXACT - 1) // max(1, most)))
        full = np.zeros((self.n, len(self.vocabulary)))
        for i, item in enumerate(items):
            full[i, np.searchsorted(self.vocabulary, item)] = weights[item]
        self.matrices = [np.ascontiguousarray(full[:, a : a + self.width]) for a in range(0, len(self.vocabulary), self.width)]
        self.place = np.full(len(weights), -1, np.int64)
        self.place[self.vocabulary] = np.arange(len(self.vocabulary))

    def scores(self, docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Items x documents, from entries (document, term, impact)."""
        total = np.zeros((self.n, docs), np.int64)
        at = self.place[term]
        for number, matrix in enumerate(self.matrices):
            inside = (at >= number * self.width) & (at < number * self.width + matrix.shape[1])
            if inside.any():
                dense = np.zeros((matrix.shape[1], docs))
                dense[at[inside] - number * self.width, doc[inside]] = impact[inside]
                total += (matrix @ dense).astype(np.int64)
        return total


class Best:
    """The highest scores of each item, equal ones by rising document id, null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)  # lower scores cannot be among the best
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, first_item: int, scores: np.ndarray, doc_ids: np.ndarray, no_id: np.ndarray) -> None:
        floor = self.floor[first_item : first_item + len(scores)]
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        item, doc = np.nonzero(scores >= floor[:, None])
        self.held.append((item + first_item, scores[item, doc], no_id[doc], doc_ids[doc]))
        self.size += len(item)
        if self.size > max(HELD, 2 * self.k * len(self.floor)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, no_id, doc = (np.concatenate([np.zeros(0, t), *some]) for t, some in zip((np.int64, np.int64, bool, np.int64), zip(*self.held) if self.held else [()] * 4))
        order = np.lexsort((doc, no_id, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[place < self.k]
        self.held = [(item[place < self.k], score[keep], no_id[keep], doc[keep])]
        self.size = len(keep)
        last = order[place == self.k - 1]
        self.floor[item[place == self.k - 1]] = np.maximum(1, score[last])
        return self.held[0]


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, ``n`` (terms, repeats included) and the numbers and counts of the terms in the vocabulary, for documents with terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for whole in batches:
            for batch in blocks(whole):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = terms(text.as_py())
                    if found:
                        counts = Counter(map(number, found))
                        counts.pop(None, None)
                        rows.append((doc_id, len(found), list(counts), list(counts.values())))
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n", "terms", "counts"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id and each different ``term`` of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for t in set(terms(text.as_py()))]
            columns = zip(*rows, strict=True) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.binary()], strict=True)], ["item_id", "term"])

    narrow = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "item_id long, term binary").distinct()


def _best(counted: DataFrame, items: list[list[int]], weights: list[int], documents: int, all_terms: int, k: int) -> DataFrame:
    """Each task's best ``k`` documents of every item: ``item`` (its number), doc_id, score."""
    shared = counted.sparkSession.sparkContext.broadcast((items, np.array(weights, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        tiles = [ItemTile(items[a : a + TILE_ITEMS], weights) for a in range(0, len(items), TILE_ITEMS)]
        best = Best(len(items), k)
        for whole in batches:
            for at in range(0, whole.num_rows, TILE_DOCS):
                batch = whole.slice(at, TILE_DOCS)
                norms = np.array([length_norm(n, documents, all_terms) for n in batch.column("n").to_pylist()], np.int64)
                term, count = batch.column("terms").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
                doc = np.repeat(np.arange(batch.num_rows), batch.column("terms").value_lengths().to_numpy())
                impact = SCALE * count // (1000 * count + 20 * norms[doc])
                doc_ids = batch.column("doc_id").fill_null(0).to_numpy()
                no_id = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                for number, tile in enumerate(tiles):
                    best.add(number * TILE_ITEMS, tile.scores(batch.num_rows, doc, term, impact), doc_ids, no_id)
        item, score, no_id, doc = best.cut()
        columns = [pa.array(item.astype(np.int32)), pa.array(doc, mask=no_id), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` documents of highest score above 0 for every item: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII letters and digits and of all beyond ASCII, A to Z as a to z. Of ``n`` terms in a document, ``tf`` times the term, with all weights ``w`` of
    the item's terms, the score is the sum of ``w * (10 ** 9 * tf div (1000 * tf + 20 * m))``; ``m`` compares n with the mean. Null texts have no terms: such documents are not counted, such items find
    nothing. Equal scores go by rising doc_id, null last; repeated documents are ranked each. Rows of ``items`` that share an id (a null one too) are one item with the terms of
    all. Without items, or documents, the result is empty. Other columns play no part.

    Items are searched for in blocks of about 131,072 terms, each a pass over the documents; a block's vocabulary is what reaches the driver. Documents may be any number.
    """
    spark = docs.sparkSession
    found = stage(_item_terms(items), "search-items")
    whole = max(1, math.ceil(found.count() / BLOCK_TERMS))
    ranked = None
    totals = None
    for block in range(whole):
        chosen = found.filter(F.pmod(F.xxhash64("item_id"), F.lit(whole)) == block) if whole > 1 else found
        rows = chosen.groupBy("item_id").agg(F.collect_set("term").alias("terms")).orderBy("item_id").collect()
        if not rows:
            continue
        vocabulary: dict[bytes, int] = {}
        numbered = [[vocabulary.setdefault(bytes(t), len(vocabulary)) for t in row["terms"]] for row in rows]
        counted = stage(_counted(docs, vocabulary), "search-counted")
        totals = totals or counted.agg(F.count("*"), F.sum("n")).first()
        if not totals[0]:
            break
        holding = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = [weight(totals[0], holding.get(t, 0)) for t in range(len(vocabulary))]
        best = _best(counted, numbered, weights, totals[0], totals[1], k)
        names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(rows)], "item int, item_id long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        top = top.join(names, "item").select("item_id", "rank", "doc_id", "score")
        ranked = top if ranked is None else ranked.unionByName(top)
    return ranked if ranked is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
docs AS (SELECT doc_id, r, terms, CAST(len(terms) AS BIGINT) AS n FROM lowered WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
weights AS (
  SELECT item_id, w.term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM wanted w JOIN df ON w.term = df.term, totals
),
scores AS (
  SELECT item_id, d.doc_id, d.r,
    CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * d.n * t.docs) // t.terms)))) AS BIGINT) AS score
  FROM weights w JOIN tf ON w.term = tf.term JOIN docs d ON d.r = tf.r, totals t
  GROUP BY item_id, d.doc_id, d.r
),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""
