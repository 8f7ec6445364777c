"""Filters, counts, sorts, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions.predicates import in_scope, is_present, violates_format
from podium.operators import quality, sets
from podium.operators.quality import drop_columns_matching, leak_summary, leaked_rows
from podium.operators.tally import tally
from podium.plans.queries.registry import (
    FACT_SQL,
    GOLD,
    LABELLED_SQL,
    NO_AWARD,
    labelled_documents,
    order_year,
    orders_per_nation,
    query,
    table,
)


@query(f"WITH {FACT_SQL} SELECT n_name, y, count(o_orderkey) AS n FROM fact GROUP BY n_name, y")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_per_nation(spark, sf_dir).select("n_name", "y", "n")


@query("SELECT p_brand, count(*) AS parts FROM part GROUP BY p_brand")
def group_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(table(spark, sf_dir, "part"), ["p_brand"], name="parts")


@query(f"""
WITH {FACT_SQL}
SELECT y, n_name, count(CASE WHEN o_orderpriority <> '{NO_AWARD}' THEN 1 END) AS awards
FROM fact GROUP BY y, n_name
""")
def conditional_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_per_nation(
        spark, sf_dir, lambda: is_present("o_orderpriority", NO_AWARD), "awards"
    )


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, count(o_orderkey) AS n
FROM orders GROUP BY 1, 2 ORDER BY y, o_orderstatus
""")
def sorted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return tally(orders, [order_year(), "o_orderstatus"], of="o_orderkey").orderBy(
        "y", "o_orderstatus"
    )


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
""")
def top_n_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("""
SELECT p_partkey, p_name, p_size FROM part WHERE contains(p_name, 'ring') AND p_size >= 10
""")
def scoped_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.filter(in_scope("p_name", "ring", "p_size", 10)).select(
        "p_partkey", "p_name", "p_size"
    )


@query(f"SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '{GOLD}'")
def equality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.filter(F.col("o_orderpriority") == GOLD).select("o_orderkey", "o_orderstatus")


@query(f"""
SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderpriority IS NOT NULL AND o_orderpriority <> '{NO_AWARD}'
""")
def sentinel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.filter(is_present("o_orderpriority", NO_AWARD)).select(
        "o_orderkey", "o_orderpriority"
    )


@query(f"WITH {LABELLED_SQL} SELECT * FROM labelled WHERE quality IS NULL")
def null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = labelled_documents(spark, sf_dir)
    return documents.filter(F.col("quality").isNull())


@query(f"""
WITH {LABELLED_SQL}
SELECT * FROM labelled WHERE quality IS NOT NULL AND toxic IS NOT NULL
""")
def drop_incomplete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_documents(spark, sf_dir).na.drop(how="any")


@query(r"""
SELECT * FROM documents WHERE NOT regexp_matches(source, '^src\d$')
""")
def format_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(violates_format("source", r"^src\d$"))


@query(r"""
SELECT 'source' AS column_name, '^src\d$' AS pattern,
       count(CASE WHEN NOT regexp_matches(source, '^src\d$') THEN 1 END) AS violations FROM documents
UNION ALL
SELECT 'lang', '^[a-z]{2}$', count(CASE WHEN NOT regexp_matches(lang, '^[a-z]{2}$') THEN 1 END) FROM documents
""")
def format_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations counted for each column and pattern."""
    return quality.format_report(table(spark, sf_dir, "documents"), {"source": r"^src\d$", "lang": "^[a-z]{2}$"})


@query(f"""
WITH {LABELLED_SQL}
SELECT doc_id, CAST(quality AS VARCHAR) AS quality_text FROM labelled
WHERE quality IS NULL OR NOT regexp_matches(CAST(quality AS VARCHAR), '^1$')
""")
def format_violations_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.col("quality").cast("string").alias("quality_text")
    documents = labelled_documents(spark, sf_dir).select("doc_id", quality)
    return documents.filter(violates_format("quality_text", "^1$", include_null=True))


@query(r"SELECT * FROM part WHERE NOT regexp_matches(p_name, '^\w+ \w+$')")
def format_violations_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean case: every part name is two words."""
    return table(spark, sf_dir, "part").filter(violates_format("p_name", r"^\w+ \w+$"))


@query("""
WITH codes AS (SELECT r_name AS code FROM region UNION SELECT 'BUILDING')
SELECT code, count(c_custkey) AS leaked_rows, count(c_custkey) > 0 AS leaked
FROM codes LEFT JOIN customer ON c_mktsegment = code
GROUP BY code
""")
def domain_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region names never occur as a segment; one planted code does."""
    planted = F.lit("BUILDING").alias("r_name")
    regions = table(spark, sf_dir, "region").select("r_name")
    known = sets.union_all([regions, regions.select(planted).distinct()])
    return leak_summary(table(spark, sf_dir, "customer"), "c_mktsegment", known)


@query("SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'ASIA')")
def domain_leak_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_rows(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "ASIA"])


@query("SELECT max(o_totalprice) AS max_price FROM orders")
def global_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.max("o_totalprice").alias("max_price"))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.distinct_values(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("""
SELECT 'customer' AS kind, c_custkey AS account, c_nationkey AS nation, c_acctbal AS balance
FROM customer
UNION ALL
SELECT 'supplier', s_suppkey, s_nationkey, s_acctbal FROM supplier
""")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("kind"),
        F.col("c_custkey").alias("account"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("kind"),
        F.col("s_suppkey").alias("account"),
        F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"),
    )
    return sets.union_all([customers, suppliers])


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag
FROM lineitem
""")
def drop_columns_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_columns_matching(table(spark, sf_dir, "lineitem"), r"^l_(ship|line)")
