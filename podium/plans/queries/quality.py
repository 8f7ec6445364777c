"""Profiles of missing values, table statistics, imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import exact as ops_exact
from podium.operators import quality as ops
from podium.plans.queries.registry import LABELLED_SQL, labelled_documents, labelled_marks, query, table

LABELLED_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
MARKED_COLUMNS = LABELLED_COLUMNS
COUNTED = {"quality_nulls": "quality", "toxic_nulls": "toxic"}


def _fractions_sql(source: str) -> str:
    columns = ", ".join(
        f"count(CASE WHEN {c} IS NULL THEN 1 END) / count(*) AS {c}_missing_fraction"
        for c in LABELLED_COLUMNS
    )
    return f"SELECT {columns} FROM {source}"


@query(f"WITH {LABELLED_SQL} {_fractions_sql('labelled')}")
def null_fraction_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.null_fractions(labelled_marks(spark, sf_dir))


@query(f"WITH {LABELLED_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) - count({c}) AS nulls FROM labelled"
    for c in LABELLED_COLUMNS
))
def null_profile_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.null_profile(labelled_marks(spark, sf_dir))


@query(f"""
WITH {LABELLED_SQL}
SELECT lang, count(*) - count(quality) AS quality_nulls, count(*) - count(toxic) AS toxic_nulls
FROM labelled GROUP BY lang ORDER BY 2 DESC, 3 DESC, 1
""")
def null_count_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.missing_by_group(labelled_documents(spark, sf_dir), "lang", COUNTED)


MARKED_SQL = f"""
WITH {LABELLED_SQL}, marked AS (
  SELECT doc_id, text, lang, source, n_chars,
         coalesce(CAST(quality AS VARCHAR), 'NA') AS quality,
         coalesce(CAST(toxic AS VARCHAR), 'NA') AS toxic
  FROM labelled
)
"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels as text, missing ones written ``NA``."""
    return labelled_marks(spark, sf_dir, "NA").select(
        "doc_id",
        "text",
        "lang",
        "source",
        "n_chars",
        *[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in ("quality", "toxic")],
    )


@query(MARKED_SQL + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(CASE WHEN CAST({c} AS VARCHAR) = 'NA' THEN 1 END) "
    "AS sentinel_rows FROM marked"
    for c in MARKED_COLUMNS
))
def sentinel_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` is a number: comparing it with text must not fail."""
    return ops.sentinel_profile(_marked(spark, sf_dir))


@query(MARKED_SQL + """
SELECT lang,
       count(CASE WHEN quality = 'NA' THEN 1 END) AS quality_marks,
       count(CASE WHEN toxic = 'NA' THEN 1 END) AS toxic_marks
FROM marked WHERE quality = 'NA' OR toxic = 'NA' GROUP BY lang
""")
def sentinel_count_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = {"quality_marks": "quality", "toxic_marks": "toxic"}
    return ops.sentinel_by_group(_marked(spark, sf_dir), "lang", counted)


@query(f"""
WITH {LABELLED_SQL}
SELECT doc_id, text, lang, source, n_chars,
       coalesce(CAST(quality AS DOUBLE), (SELECT avg(quality) FROM labelled)) AS quality,
       coalesce(CAST(toxic AS DOUBLE), (SELECT avg(toxic) FROM labelled)) AS toxic
FROM labelled
""")
def mean_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.impute_means(labelled_documents(spark, sf_dir), ["quality", "toxic"])


@query(f"""
WITH {LABELLED_SQL}, filled AS (
  SELECT doc_id, text, lang, source, n_chars,
         coalesce(CAST(quality AS DOUBLE), (SELECT avg(quality) FROM labelled)) AS quality,
         coalesce(CAST(toxic AS DOUBLE), (SELECT avg(toxic) FROM labelled)) AS toxic
  FROM labelled
) """ + _fractions_sql("filled"))
def null_fraction_after_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = ops.impute_means(labelled_documents(spark, sf_dir), ["quality", "toxic"])
    return ops.null_fractions(filled)


NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
TEXTS = ["l_returnflag", "l_linestatus"]
TIMES = ["l_shipdate"]


@query(" UNION ALL ".join(
    [
        f"""SELECT '{c}' AS column_name, count({c}) AS non_null,
            round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev,
            CAST(CASE WHEN min({c}) = 0 THEN 0 ELSE min({c}) END AS DOUBLE) AS min_number,
            CAST(CASE WHEN max({c}) = 0 THEN 0 ELSE max({c}) END AS DOUBLE) AS max_number,
            CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text,
            CAST(NULL AS TIMESTAMP) AS min_time, CAST(NULL AS TIMESTAMP) AS max_time FROM lineitem"""
        for c in NUMBERS
    ]
    + [
        f"SELECT '{c}', count({c}), NULL, NULL, NULL, NULL, min({c}), max({c}), NULL, NULL FROM lineitem"
        for c in TEXTS
    ]
    + [
        f"SELECT '{c}', count({c}), NULL, NULL, NULL, NULL, NULL, NULL, min({c}), max({c}) FROM lineitem"
        for c in TIMES
    ]
))
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded because the order of summation differs between engines; -0.0 shown as 0.0."""
    profile = ops.table_profile(table(spark, sf_dir, "lineitem"))
    return profile.withColumns(
        {c: F.round(c, 4) for c in ("mean", "stddev")}
        | {c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)) for c in ("min_number", "max_number")}
    )


# A double times a power of two is a whole number of 128 bits for values of these columns and, but for bits far below what their sum is rounded by, for their squared
# distances from the mean. Both halves of a sum are exact doubles (or end in a bit for what lies below), so it is rounded once.
SQUARE_BITS = {"l_quantity": 88, "l_discount": 104, "l_tax": 104, "l_linenumber": 96}


def _exact_sum_sql(value: str, bits: int = 60) -> str:
    total = f"sum(CAST(({value}) * {2**bits}::DOUBLE AS HUGEINT))::HUGEINT"
    halves = f"({total} // {2**50})::DOUBLE * {2**50}::DOUBLE + ({total} % {2**50})::DOUBLE"
    lower = f"(({total} % {2**73}::HUGEINT) // {2**20} | CASE WHEN {total} % {2**20} <> 0 THEN 1 ELSE 0 END)"
    large = f"({total} // {2**73}::HUGEINT)::DOUBLE * {2**73}::DOUBLE + {lower}::DOUBLE * {2**20}::DOUBLE"
    return f"((CASE WHEN {total} < {2**102}::HUGEINT THEN {halves} ELSE {large} END) / {2**bits}::DOUBLE)"


def _number_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, non_null, mean,
            sqrt((SELECT {_exact_sum_sql(f"(CAST({c} AS DOUBLE) - mean) * (CAST({c} AS DOUBLE) - mean)", SQUARE_BITS.get(c, 68))} FROM lineitem) / (non_null - 1)) AS stddev,
            min_number, max_number, CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text,
            CAST(NULL AS TIMESTAMP) AS min_time, CAST(NULL AS TIMESTAMP) AS max_time FROM (
              SELECT count({c}) AS non_null, {_exact_sum_sql(f"CAST({c} AS DOUBLE)")} / count({c}) AS mean,
                CAST(CASE WHEN min({c}) = 0 THEN 0 ELSE min({c}) END AS DOUBLE) AS min_number,
                CAST(CASE WHEN max({c}) = 0 THEN 0 ELSE max({c}) END AS DOUBLE) AS max_number FROM lineitem)"""


@query(" UNION ALL ".join(
    [_number_sql(c) for c in NUMBERS]
    + [
        f"SELECT '{c}', count({c}), NULL, NULL, NULL, NULL, min({c}), max({c}), NULL, NULL FROM lineitem"
        for c in TEXTS
    ]
    + [
        f"SELECT '{c}', count({c}), NULL, NULL, NULL, NULL, NULL, NULL, min({c}), max({c}) FROM lineitem"
        for c in TIMES
    ]
))
def table_profile_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation to the last bit, so nothing is rounded; -0.0 shown as 0.0."""
    profile = ops.table_profile(table(spark, sf_dir, "lineitem"), exact=True)
    return profile.withColumns(
        {c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)) for c in ("min_number", "max_number")}
    )


EXACT = ["l_quantity", "l_extendedprice", "l_discount"]


@query(f"""
SELECT l_returnflag, l_linestatus, {", ".join(f"{_exact_sum_sql(c)} AS sum_{c}, count({c}) AS count_{c}" for c in EXACT)}
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def exact_group_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of doubles by group, to the last bit."""
    return ops_exact.exact_sums(table(spark, sf_dir, "lineitem"), EXACT, ["l_returnflag", "l_linestatus"])


CATALOG = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS position, '{kind}' AS data_type, "
    f"count({c}) AS non_null, count(*) AS row_count FROM lineitem"
    for i, (c, kind) in enumerate(CATALOG.items(), start=1)
))
def column_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.column_catalog(table(spark, sf_dir, "lineitem"))


@query("SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT * FROM lineitem)")
def distinct_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_row_count(table(spark, sf_dir, "lineitem"))
