"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a hash. The words of a source are summed by hash bucket, and the bucket in which the
source's budget runs out is the only one looked into further: its documents are summed again by the next
digits of the hash, down to single hash values. What remains is one threshold for each source and budget, so the
mix is a filter ``hash <= threshold``; no document is sorted, and a smaller budget always takes a subset of what a
larger one takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.words import unused
from podium.sources.scratch import stage

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
DIGITS, LEVELS = 3, 4  # 16 ** 3 = 4,096 buckets a level, 48 bits in all
WORD = r"[^\x20\x09-\x0D]+"


def document_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Hexadecimal digits that depend on a document alone, so that reruns agree."""
    key = F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return F.substring(F.md5(key.cast("binary")), 1, DIGITS * LEVELS)


def sized(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, source, its words as ``size``, its ``hash``."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", words.alias("size"), document_hash().alias("hash"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: ``source_size`` and its ``target`` words.

    The sources, by code point with null last, weigh ``weights`` in turn and share the size of all documents.
    No target is over ``max_repeats`` times its source's size; the excess is shared among the others by weight. That
    is one level ``l`` with targets ``min(cap, l * weight)``: with sources by rising cap per weight, it is what is left of
    the budget over the weights left, at the first source that reaches its cap no sooner. The windows hold one row per source.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turns = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(turns, (place % len(weights) + 1).cast("int")))
    cap = F.lit(float(max_repeats)) * F.col("source_size")
    by_cap = Window.orderBy((cap / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - max_repeats * F.coalesce(
        F.sum("source_size").over(before), F.lit(0)
    )
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = weighed.select("*", (left.cast("double") / weights_left).alias("level"), F.row_number().over(by_cap).alias("turn"))
    reached = F.when(cap / F.col("weight") >= F.col("level"), F.struct("turn", "level"))
    fitted = levels.withColumn("share", F.min(reached).over(everything)["level"])
    return fitted.select(
        "source", "source_size", F.least(cap, F.coalesce(F.col("share"), F.lit(0.0)) * F.col("weight")).alias("target")
    )


def thresholds(rows: DataFrame, budgets: DataFrame, keys: list[str]) -> DataFrame:
    """For each row of ``budgets`` (``keys`` and a number of words ``budget``), the last hash taken.

    A histogram holds at most 4,096 sums for a key, whatever the documents, and each level reads only
    the documents of boundary buckets. Documents of equal hash go together; they are taken if that brings the sum nearer to the budget.
    A NULL ``threshold`` takes nothing.
    """
    open_ = budgets.select(*keys, "budget", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"))
    done = None
    for level in range(1, LEVELS + 1):
        near = [open_[k].eqNullSafe(rows[k]) for k in keys]
        inside = F.substring(rows["hash"], 1, DIGITS * (level - 1)) == open_["prefix"]
        held = rows.join(open_, near + ([inside] if level > 1 else [])).select(
            *[open_[k] for k in keys], "budget", "below", "size", F.substring("hash", 1, DIGITS * level).alias("bucket")
        )
        sums = held.groupBy(*keys, "budget", "below", "bucket").agg(F.sum("size").alias("words"))
        order = Window.partitionBy(*keys, "budget").orderBy("bucket")
        upto = sums.select("*", (F.col("below") + F.sum("words").over(order)).alias("upto"))
        # The first bucket that ends beyond the budget is looked into; without one, every document is taken.
        last = upto.groupBy(*keys, "budget").agg(
            F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", "upto", "words"))).alias("edge"),
            F.max(F.when(F.col("upto") <= F.col("budget"), F.col("bucket"))).alias("whole"),
            F.max("below").alias("below"),
        )
        last = stage(last, f"mix-level{level}")
        whole = last.filter("edge IS NULL").select(*keys, "budget", F.lit("g").alias("threshold"))
        if level < LEVELS:
            open_ = last.filter("edge IS NOT NULL").select(
                *keys, "budget", F.col("edge.bucket").alias("prefix"), (F.col("edge.upto") - F.col("edge.words")).alias("below")
            )
        else:
            over = F.col("edge.upto") - F.col("budget")
            under = F.col("budget") - (F.col("edge.upto") - F.col("edge.words"))
            just_below = F.col("whole")
            edge = last.filter("edge IS NOT NULL").select(
                *keys,
                "budget",
                # Without a whole bucket here, all hashes below the edge are still taken: "~" marks "up to, without".
                F.when(over < under, F.col("edge.bucket"))
                .otherwise(F.coalesce(just_below, F.concat(F.lit("<"), F.col("edge.bucket"))))
                .alias("threshold"),
            )
            whole = whole.unionByName(edge)
        done = whole if done is None else done.unionByName(whole)
    return done


def takes(hash_: Column, threshold: Column) -> Column:
    """Whether a document of this hash is within the threshold."""
    before = hash_ < F.substring(threshold, 2, DIGITS * LEVELS)
    return F.coalesce(F.when(threshold.startswith("<"), before).otherwise(hash_ <= threshold), F.lit(False))


def _plan(rows: DataFrame, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """One row a source: ``of``, source_size, target, ``whole`` (times every document is taken), budget and threshold of one time more."""
    goal = targets(rows, weights, max_repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", whole.cast("int"))
    goal = stage(goal.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    cut = thresholds(rows, goal.select("source", "budget"), ["source"])
    return stage(
        goal.join(cut.select(F.col("source").alias("cut_source"), "threshold"), F.col("source").eqNullSafe(F.col("cut_source")), "left"),
        "mix-plan",
    ).select(F.col("source").alias("of"), "source_size", "target", "whole", "budget", "threshold")


def _repeats(hash_: Column, plan: Callable[[str], Column]) -> Column:
    once_more = F.when(plan("budget") > 0, takes(hash_, plan("threshold"))).otherwise(False)
    return plan("whole") + once_more.cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """How often the mix takes each document.

    Returns one row per document: doc_id, source, hash, size (words; 0 without text), source_size, target, ``repeats`` and
    ``taken`` = size x repeats. A source whose target is 1.7 times its size gives every document once, and once more those whose
    hash is within the threshold for 0.7 times its size.

    Null sources are one source. Repeated rows each count and share one hash. Documents without words take the repeats
    of their source and hash. An empty table gives an empty result. Columns beyond doc_id, text and source play no part.
    """
    rows = stage(sized(docs), "mix-rows")
    plan = _plan(rows, weights, max_repeats)
    repeats = _repeats(F.col("hash"), F.col)
    return rows.join(plan, rows["source"].eqNullSafe(plan["of"])).select(
        "doc_id", "source", "hash", "size", "source_size", "target",
        repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents of the mix, each as many times as it is taken, with all their columns.

    What a document needs to know is the threshold of its source, so rows meet one row a source and their texts are compared in place:
    a document's own hash against it. Null sources are one source, null texts have no words and follow their hash, repeated rows are taken alike,
    columns may have any names, texts any length. An empty table stays empty.
    """
    plan = _plan(stage(sized(docs), "mix-rows"), weights, max_repeats)
    names = {c: unused(docs, f"mix_{c}") for c in plan.columns}
    plan = plan.withColumnsRenamed(names)
    found = docs.join(plan, docs["source"].eqNullSafe(plan[names["of"]]))
    repeats, copy = unused(docs, "mix_repeats"), unused(docs, "mix_copy")
    counted = found.withColumn(repeats, _repeats(document_hash(), lambda c: F.col(names[c])))
    copies = F.explode(F.sequence(F.lit(1), F.col(repeats)))
    return counted.filter(F.col(repeats) > 0).select(*[docs_column(c) for c in docs.columns], copies.alias(copy)).drop(copy)


def docs_column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source,
    CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
    substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 12) AS h
  FROM documents
),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
weighed AS (
  SELECT source, source_size,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sizes
),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
    row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS turn
  FROM weighed
),
fitted AS (
  SELECT *, (SELECT arg_min(level, turn) FROM levels WHERE 3.0::DOUBLE * source_size / weight >= level) AS share FROM levels
),
goal AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(share, 0) * weight) AS target FROM fitted
),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS whole FROM goal
),
budget AS (SELECT *, target - whole * source_size AS budget FROM plan),
by_hash AS (SELECT source, h, sum(size) AS words FROM rows_ GROUP BY source, h),
upto AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM by_hash),
edges AS (
  SELECT u.source, u.h, u.upto <= b.budget
      OR (u.upto - u.words <= b.budget AND u.upto - b.budget < b.budget - (u.upto - u.words)
          AND u.h = min(CASE WHEN u.upto > b.budget THEN u.h END) OVER (PARTITION BY u.source)) AS taken
  FROM upto u JOIN budget b ON u.source IS NOT DISTINCT FROM b.source
)
SELECT r.doc_id, r.size, b.source_size, b.target,
  r.size * (b.whole + CASE WHEN b.budget > 0 AND e.taken THEN 1 ELSE 0 END) AS taken
FROM rows_ r
JOIN budget b ON r.source IS NOT DISTINCT FROM b.source
JOIN edges e ON r.source IS NOT DISTINCT FROM e.source AND r.h = e.h
"""
