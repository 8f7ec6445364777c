"""Laid-out tables, counts taken while writing, profiles and sketches that are kept, published results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators import distinct as distinct_ops
from podium.operators.inference import infer_types as inferred
from podium.operators.ranking import rollup_pages
from podium.operators.sets import union_all
from podium.operators.tally import tally
from podium.operators.trend import growth
from podium.plans.queries.registry import LABELLED_SQL, labelled_documents, order_year, query, table
from podium.sources.dimensions import dimension
from podium.sources.layout import Layout, lay_out
from podium.sources.profiles import refresh_profile
from podium.sources.publishing import publish, publish_partitions
from podium.sources.readers import read_csv_text, read_csv_typed
from podium.sources.scratch import scratch_path, stage
from podium.sources.sinks import observed, write_csv

ORDERS = Layout(bucket_by=("o_custkey",), buckets=8, partition_by=("y",), sort_by=("o_orderkey",))


@query("""
WITH counts AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1, 2
), compared AS (
  SELECT *, lag(n) OVER (PARTITION BY o_custkey ORDER BY y) AS prev_n FROM counts
)
SELECT o_custkey, y, n, prev_n, TRY_CAST((n - prev_n) / nullif(prev_n, 0) * 100 AS DECIMAL(10, 3)) AS growth_pct FROM compared
""")
def laid_out_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth by customer on a table in buckets of customers and folders of years: no exchange, and early years are not read."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", order_year())
    laid = lay_out(orders, f"orders_{uuid.uuid4().hex}", ORDERS)
    return growth(tally(laid.filter(F.col("y") >= 1997), ["o_custkey", "y"]), "o_custkey", "y")


LABELLED = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@query(f"WITH {LABELLED_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS nulls, count(CASE WHEN quality = 1 THEN 1 END) AS good_rows FROM labelled"
    for c in LABELLED
))
def counts_while_writing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and NULLs of a table, counted by the job that writes it."""
    watched, counts = observed(labelled_documents(spark, sf_dir), {"good": F.col("quality") == 1})
    watched.write.parquet(scratch_path(spark, "labelled"))
    found = counts()
    nulls = dimension(spark, found["nulls"], "column_name", "nulls", "string", "long")
    return nulls.withColumns({"row_count": F.lit(found["rows"]).cast("long"), "good_rows": F.lit(found["where"]["good"]).cast("long")})


PROFILED = {
    "o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "time", "o_orderpriority": "text",
}
_KINDS = {"number": "DOUBLE", "text": "VARCHAR", "time": "TIMESTAMP"}


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
    + ", ".join(
        f"CAST({f'{end}({c})' if kind == own else 'NULL'} AS {_KINDS[kind]}) AS {end}_{kind}" for kind in _KINDS for end in ("min", "max")
    )
    + ", true AS distinct_is_near FROM orders"
    for c, own in PROFILED.items()
))
def incremental_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of a growing folder: the second refresh reads what was added, and merges."""
    orders = table(spark, sf_dir, "orders")
    folder, states = scratch_path(spark, "growing"), scratch_path(spark, "states")
    early = F.year("o_orderdate") <= 1997
    orders.filter(early).write.parquet(folder)
    refresh_profile(spark, folder, states, schema=orders.schema)
    orders.filter(~early).write.mode("append").parquet(folder)
    profile, _ = refresh_profile(spark, folder, states, schema=orders.schema)
    exact = distinct_ops.distinct_rows  # what the sketches are held against
    true = union_all([exact(orders.select(c)).select(F.lit(c).alias("c"), "distinct_rows") for c in orders.columns])
    far = F.abs(F.col("approx_distinct") - F.col("distinct_rows")) > 6 * distinct_ops.standard_error() * F.col("distinct_rows") + 1
    return profile.join(true, F.col("column_name") == F.col("c")).withColumn("distinct_is_near", ~far).drop("approx_distinct", "c", "distinct_rows")


@query("SELECT l_returnflag, count(DISTINCT (l_orderkey, l_linenumber, l_quantity, l_shipdate)) AS distinct_rows FROM lineitem GROUP BY l_returnflag")
def distinct_rows_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows by group, exact; digests are shuffled in place of rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return distinct_ops.distinct_rows(rows, ["l_returnflag"])


SKETCHED = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, true AS estimate_is_near, true AS merging_changes_nothing FROM orders" for c in SKETCHED
))
def distinct_sketch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by year, stored and united: as near to the truth as they promise, and the same as one sketch of everything."""
    orders = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    kept = stage(distinct_ops.distinct_sketches(orders, SKETCHED, ["y"]), "sketches")
    united = distinct_ops.sketch_estimates(distinct_ops.merge_sketches(kept))
    whole = distinct_ops.sketch_estimates(distinct_ops.distinct_sketches(orders, SKETCHED)).withColumnsRenamed({"approx_distinct": "at_once", "column_name": "c"})
    true = union_all([distinct_ops.distinct_rows(orders.select(c)).select(F.lit(c).alias("of"), F.col("distinct_rows").alias("distinct_values")) for c in SKETCHED])
    near = F.abs(F.col("approx_distinct") - F.col("distinct_values")) <= 6 * distinct_ops.standard_error() * F.col("distinct_values") + 1
    # Unions of sketches keep what a single one keeps, but for the order in which registers filled.
    alike = F.abs(F.col("approx_distinct") - F.col("at_once")) <= 2 * distinct_ops.standard_error() * F.col("at_once") + 1
    return (
        united.join(whole, F.col("column_name") == F.col("c"))
        .join(true, F.col("column_name") == F.col("of"))
        .select("column_name", "distinct_values", near.alias("estimate_is_near"), alike.alias("merging_changes_nothing"))
    )


@query("""
SELECT 'c_custkey' AS column_name, 1 AS position, 'int' AS data_type, count(*) AS non_null, 0::BIGINT AS not_int, 0::BIGINT AS not_double FROM customer
UNION ALL SELECT 'c_name', 2, 'string', count(*), count(*), count(*) FROM customer
UNION ALL SELECT 'c_nationkey', 3, 'string', count(*), count(CASE WHEN c_custkey % 10 = 0 THEN 1 END), count(CASE WHEN c_custkey % 10 = 0 THEN 1 END) FROM customer
UNION ALL SELECT 'c_acctbal', 4, 'double', count(*), count(*), 0 FROM customer
UNION ALL SELECT 'c_mktsegment', 5, 'string', count(*), count(*), count(*) FROM customer
""")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a text file's columns from one scan, with how many values do not fit."""
    customer = table(spark, sf_dir, "customer")
    mixed = F.when(F.col("c_custkey") % 10 == 0, F.lit("none")).otherwise(F.col("c_nationkey").cast("string"))
    path = scratch_path(spark, "customer-mixed")
    write_csv(customer.select("c_custkey", "c_name", mixed.alias("c_nationkey"), "c_acctbal", "c_mktsegment"), path)
    found = inferred(read_csv_text(spark, path))
    return found.select("column_name", "position", "data_type", "non_null", F.col("misfits")["int"].alias("not_int"), F.col("misfits")["double"].alias("not_double"))


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, count(*) * CASE WHEN year(o_orderdate) = 1996 THEN 2 ELSE 1 END AS n
FROM orders GROUP BY 1, 2, year(o_orderdate)
UNION ALL
SELECT 0, 'all', count(*) FROM orders
""")
def published_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rerun of one year replaces that year; a rerun of everything replaces everything."""
    counts = tally(table(spark, sf_dir, "orders"), [order_year(), "o_orderstatus"])
    years, total = scratch_path(spark, "by-year"), scratch_path(spark, "total")
    for result in (counts, counts.filter("y = 1996").withColumn("n", F.col("n") * 2)):
        publish_partitions(result, years, ["y"])
    for times in (2, 1):
        whole = counts.agg((F.sum("n") * times).alias("n")).select(F.lit(0).alias("y"), F.lit("all").alias("o_orderstatus"), "n")
        publish(whole, total, write=lambda df, path: write_csv(df, path))
    schema = "y int, o_orderstatus string, n long"
    return spark.read.schema(schema).parquet(years).select("y", "o_orderstatus", "n").unionAll(read_csv_typed(spark, total, schema))


@query("""
WITH items AS (
  SELECT l_returnflag, l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS item FROM lineitem
), placed AS (
  SELECT *, sum(length(item) + 2) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, item ROWS UNBOUNDED PRECEDING) - length(item) - 2 AS start FROM items
)
SELECT l_returnflag, CAST(start // 20000 + 1 AS BIGINT) AS page, string_agg(item, ', ' ORDER BY l_orderkey, l_linenumber, item) AS lines
FROM placed GROUP BY 1, 2
""")
def rollup_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists far longer than a cell should be, a third of the table and more each, in pages."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return rollup_pages(
        items, ["l_returnflag"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"], "lines", page_chars=20_000, stage=stage
    )
