"""How filters interact: what each removes at each place of every order, and its Shapley share.

The sets of filters already applied are the states of a subset lattice, and applying one more is an edge. What an edge removes depends on
its state alone, not on the order that led there. So it is enough to know, for each of the n * 2 ** (n - 1) edges, what it removes. The number of orders
that reach a state (counted forward from the empty set) times the number that leave the next one for the full set (counted backward) is the number
of orders that pass the edge; weighing removals by it gives each filter's Shapley sum, and the steps of each order are read from the
edges that it passes.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITAL_PCT = 200, 50, 3
BLANKS = r"[\x20\x09-\x0D]+"


def paths(n: int) -> list[tuple[int, int, int, int, int]]:
    """The lattice's edges: state, filter, next state, orders that reach the state, orders that leave the next one."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full):  # smaller sets have smaller numbers
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in reversed(range(full)):
        leave[state] = sum(leave[state | 1 << f] for f in range(n) if not state >> f & 1)
    return [
        (state, f, state | 1 << f, reach[state], leave[state | 1 << f])
        for state in range(full)
        for f in range(n)
        if not state >> f & 1
    ]


def _effects(spark: SparkSession, n: int) -> DataFrame:
    """What each edge does to each combination of failures: 2 ** n rows an edge, whatever the data."""
    rows = [
        (mask, state, f, int(not mask & after), int(not mask & state and mask >> f & 1), int(bool(mask & state) and mask >> f & 1), int(mask == 1 << f))
        for mask in range(1 << n)
        for state, f, after, _, _ in paths(n)
    ]
    return spark.createDataFrame(rows, "mask int, state int, filter int, keeps int, removes int, repeats int, alone int")


def _orders(spark: SparkSession, filters: str) -> DataFrame:
    """Every order's edges: n! * n rows, whatever the data."""
    rows = []
    for order in permutations(range(len(filters))):
        state, name = 0, "".join(filters[f] for f in order)
        for step, f in enumerate(order, 1):
            rows.append((state, f, name, step))
            state |= 1 << f
    return spark.createDataFrame(rows, "state int, filter int, filter_order string, step int")


def audit(failures: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order and step; the step's filter is the letter of ``filter_order`` at that place.

    ``failures`` has ``part``, ``mask`` (int; bit i: fails the i-th filter), ``n`` (documents), ``good`` and ``toxic`` (how many of them). Rows of the same part and
    mask add up first, so what is spread over the lattice is at most 2 ** n rows a part. Counts: ``kept`` after the step, ``removed`` in it,
    ``redundant`` (fail its filter, but went earlier), ``unique_fails`` (fail no other), ``good_lost``, ``toxic_lost`` (of the removed), and ``shapley`` (its
    filter's removed, added up over all orders). No rows give no result.
    """
    spark, n = failures.sparkSession, len(filters)
    sums = failures.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    weigh = lambda count, effect: F.sum(F.col(count) * F.col(effect)).cast("long")
    edges = sums.join(_effects(spark, n), "mask").groupBy("part", "state", "filter").agg(
        weigh("n", "keeps").alias("kept"),
        weigh("n", "removes").alias("removed"),
        weigh("n", "repeats").alias("redundant"),
        weigh("n", "alone").alias("unique_fails"),
        weigh("good", "removes").alias("good_lost"),
        weigh("toxic", "removes").alias("toxic_lost"),
    )
    passing = spark.createDataFrame([(s, f, reach * leave) for s, f, _, reach, leave in paths(n)], "state int, filter int, passing long")
    weighed = edges.join(passing, ["state", "filter"]).withColumn(
        "shapley", F.sum(F.col("removed") * F.col("passing")).over(Window.partitionBy("part", "filter"))
    )
    return weighed.join(_orders(spark, filters), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def own_failures(text: Column, words: Column) -> Column:
    """Bits of the filters that look at one text alone: A few words, B few different ones, C many capitals, D signs."""
    count = F.size(words)
    fails = [
        count < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PCT * count,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITAL_PCT * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    bits = [F.when(fail, F.lit(1 << i)).otherwise(F.lit(0)) for i, fail in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Part, mask and counts of documents, for :func:`audit`; only digests of texts and single bits are shuffled.

    ``docs`` has doc_id, text and lang; ``labels`` doc_id, quality and toxic. A null text is an empty one, a null language the part "". A document fails E if a
    row of smaller doc_id has the same text; rows without an id neither fail E nor make others fail, and have no labels. Repeated rows count each.
    If a document has several labels, one good (quality 1) or toxic (1) is enough. Other columns play no part. An empty table gives no rows.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    worded = texts.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    rows = worded.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_failures(F.col("text"), F.col("words")).alias("mask"))

    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("marked")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    # Rows without an id match no label; dealt by digest, they do not meet in one task.
    deal = F.coalesce("doc_id", F.xxhash64("digest"))
    labelled = rows.withColumn("deal", deal).join(marks, (F.col("deal") == marks["marked"]) & F.col("doc_id").isNotNull(), "left")
    labelled = labelled.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})

    kind = ["digest", "part", "mask", "good", "toxic"]
    each = labelled.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))  # repeated rows become one
    # A text in a third of all rows is a few rows of each task from here on.
    per_text = each.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("first"),
        F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("at_first"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without_id"),
    )
    first = F.min("first").over(Window.partitionBy("digest"))
    passes = F.col("without_id") + F.when(F.col("first") == first, F.col("at_first")).otherwise(0)
    split = per_text.withColumn("passes", passes)
    copies = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("passes").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passes")).alias("n")),
    )
    return (
        split.select("part", "good", "toxic", F.inline(copies))
        .filter("n > 0")
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    )


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END AS a,
    CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 1 ELSE 0 END AS b,
    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 1 ELSE 0 END AS c,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
    CASE WHEN x.doc_id > min(x.doc_id) OVER (PARTITION BY t) THEN 1 ELSE 0 END AS e
  FROM texts x LEFT JOIN marks m ON x.doc_id = m.doc_id
),
kinds AS (
  SELECT part, CASE WHEN a = 1 THEN 'A' ELSE '' END || CASE WHEN b = 1 THEN 'B' ELSE '' END || CASE WHEN c = 1 THEN 'C' ELSE '' END
      || CASE WHEN d = 1 THEN 'D' ELSE '' END || CASE WHEN e = 1 THEN 'E' ELSE '' END AS fails,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM failed GROUP BY ALL
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order
  FROM letters p JOIN letters q ON q.f <> p.f JOIN letters r ON r.f NOT IN (p.f, q.f)
  JOIN letters s ON s.f NOT IN (p.f, q.f, r.f) JOIN letters t ON t.f NOT IN (p.f, q.f, r.f, s.f)
),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
met AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS fails_it, fails = f AS only_it,
    translate(fails, before, '') <> fails AS gone
  FROM kinds, steps
),
summed AS (
  SELECT part, filter_order, step, f,
    CAST(sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN only_it THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN NOT gone AND fails_it THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN NOT gone AND fails_it THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""
