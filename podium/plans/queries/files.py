"""Sources and sinks: whole tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators.sets import union_all
from podium.operators.tally import tally
from podium.plans.queries.registry import (
    LABELLED_SQL,
    labelled_documents,
    order_year,
    query,
    table,
)
from podium.sources.dimensions import read_code_dimension
from podium.sources.quarantine import read_csv_checked
from podium.sources.readers import (
    csv_options,
    infer_csv_schema,
    read_csv_text,
    read_csv_typed,
    read_format,
)
from podium.sources.scratch import scratch_path
from podium.sources.sinks import convert_dialect, export_sorted, write_csv, write_parquet


@query("SELECT * FROM orders")
def csv_typed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "orders-csv")
    write_csv(orders, path, mode="errorifexists")
    return read_csv_typed(spark, path, orders.schema)


@query("SELECT * FROM documents")
def csv_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text with line breaks, quotes and blanks comes back as it was."""
    documents = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "documents-csv")
    write_csv(documents, path, exact=True)
    return read_csv_typed(spark, path, documents.schema, exact=True)


@query("SELECT * FROM events")
def csv_events_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times keep their microseconds."""
    events = table(spark, sf_dir, "events")
    path = scratch_path(spark, "events-csv")
    write_csv(events, path, exact=True)
    return read_csv_typed(spark, path, events.schema, exact=True)


@query("SELECT * FROM conversations")
def csv_dialect_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text through a change of separator."""
    conversations = table(spark, sf_dir, "conversations")
    commas, semicolons = scratch_path(spark, "turns-comma"), scratch_path(spark, "turns-semicolon")
    write_csv(conversations, commas, exact=True)
    convert_dialect(spark, commas, semicolons, to_sep=";", exact=True)
    return read_csv_typed(spark, semicolons, conversations.schema, sep=";", exact=True)


@query(f"""
WITH {LABELLED_SQL}
SELECT doc_id, quality AS number, coalesce(CAST(quality AS VARCHAR), 'NA') AS text, 'kept' AS read_as FROM labelled
UNION ALL
SELECT doc_id, quality, CAST(quality AS VARCHAR), 'null' FROM labelled
""")
def csv_missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text ``NA`` read without and with the reader's missing-value option."""
    path = scratch_path(spark, "labels-csv")
    documents = labelled_documents(spark, sf_dir).select(
        "doc_id", F.col("quality").alias("number"), F.col("quality").alias("text")
    )
    write_csv(documents, path, null_value="NA")
    schema = "doc_id bigint, number int, text string"
    kept = read_csv_typed(spark, path, schema).select("*", F.lit("kept").alias("read_as"))
    nulled = read_csv_typed(spark, path, schema, null_value="NA").select("*", F.lit("null").alias("read_as"))
    return union_all([kept, nulled])


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment
FROM customer
""")
def untyped_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "customer-csv")
    write_csv(table(spark, sf_dir, "customer"), path)
    return read_csv_text(spark, path)


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_dialect_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma to semicolon without the saved row index, then read with inferred types."""
    part = table(spark, sf_dir, "part").withColumn("Unnamed: 0", F.col("p_partkey"))
    commas, semicolons = scratch_path(spark, "part-comma"), scratch_path(spark, "part-semicolon")
    write_csv(part, commas)
    convert_dialect(spark, commas, semicolons, to_sep=";", drop_pattern="^Unnamed")
    schema = infer_csv_schema(spark, semicolons, sep=";")
    return read_csv_typed(spark, semicolons, schema, sep=";").withColumn(
        "p_partkey", F.col("p_partkey").cast("bigint")
    )


@query("SELECT * FROM orders")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "orders-parquet")
    write_parquet(orders, path, partition_by=["o_orderstatus"])
    return spark.read.schema(orders.schema).parquet(path)


@query("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, o_orderpriority, count(*) AS n
FROM orders GROUP BY 1, 2, 3
""")
def sorted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    counts = tally(orders, [order_year(), "o_orderstatus", "o_orderpriority"])
    path = scratch_path(spark, "counts-sorted")
    export_sorted(counts, path, ["y", "o_orderstatus", "o_orderpriority"])
    return read_csv_typed(spark, path, counts.schema)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def format_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source known by name, with its schema given, so that it is read once."""
    path = scratch_path(spark, "supplier-json")
    supplier = table(spark, sf_dir, "supplier")
    supplier.write.json(path)
    return read_format(spark, path, "json", schema=supplier.schema)


@query("""
SELECT c_name AS "NOC",
       CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS region,
       CASE WHEN c_acctbal < 0 THEN c_mktsegment || ', "' || c_name || '"' END AS notes
FROM customer
""")
def cr_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records end in a bare carriage return; notes hold commas and quotes; some regions are ``NA``."""
    segment = F.col("c_mktsegment")
    note = F.concat(segment, F.lit(', "'), F.col("c_name"), F.lit('"'))
    codes = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("NOC"),
        F.when(segment == "MACHINERY", F.lit("NA")).otherwise(segment).alias("region"),
        F.when(F.col("c_acctbal") < 0, note).alias("notes"),
    )
    path = scratch_path(spark, "codes")
    codes.write.options(**csv_options(), lineSep="\r").csv(path)
    return read_code_dimension(spark, path)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
# Records of customers, some broken: quotes not doubled, fields cut off, a text for a number, a segment that does not exist.
PLANTED_SQL = """
planted AS (
  SELECT *,
    CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_acctbal AS VARCHAR) AS balance,
    '"' || c_name || ', ""Jr.""' || '"' AS doubled,
    '"' || c_name || ' \\"Jr.\\", Sr.' || '"' AS shifted,
    CASE WHEN c_custkey % 7 = 0 THEN 'quotes' WHEN c_custkey % 11 = 1 THEN 'cut' WHEN c_custkey % 13 = 2 THEN 'type'
         WHEN c_custkey % 17 = 3 THEN 'segment' ELSE 'good' END AS kind
  FROM customer
)"""


@query(f"""
WITH {PLANTED_SQL}
SELECT CASE WHEN kind = 'good' THEN c_custkey END AS c_custkey,
       CASE WHEN kind = 'good' THEN c_name || ', "Jr."' END AS c_name,
       CASE WHEN kind = 'good' THEN c_nationkey END AS c_nationkey,
       CASE WHEN kind = 'good' AND c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal,
       CASE WHEN kind = 'good' THEN c_mktsegment END AS c_mktsegment,
       CASE kind WHEN 'quotes' THEN concat_ws(',', k, shifted, nation, balance, c_mktsegment)
                 WHEN 'cut' THEN concat_ws(',', k, doubled)
                 WHEN 'type' THEN concat_ws(',', k, doubled, 'x', balance, c_mktsegment)
                 WHEN 'segment' THEN concat_ws(',', k, doubled, nation, balance, 'OTHER') END AS record,
       CASE kind WHEN 'quotes' THEN 'fields' WHEN 'cut' THEN 'fields' WHEN 'type' THEN 'type of c_nationkey' WHEN 'segment' THEN 'segment' END AS reasons
FROM planted
""")
def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with broken records: what fits and what was set apart, with the reason, make up the file."""
    key, nation, balance = (F.col(c).cast("string") for c in ("c_custkey", "c_nationkey", "c_acctbal"))
    known = F.when(F.col("c_custkey") % 5 == 0, F.lit("NA")).otherwise(balance)
    doubled = F.concat(F.lit('"'), F.col("c_name"), F.lit(', ""Jr."""'))
    shifted = F.concat(F.lit('"'), F.col("c_name"), F.lit(' \\"Jr.\\", Sr."'))
    line = (
        F.when(F.col("c_custkey") % 7 == 0, F.concat_ws(",", key, shifted, nation, balance, "c_mktsegment"))
        .when(F.col("c_custkey") % 11 == 1, F.concat_ws(",", key, doubled))
        .when(F.col("c_custkey") % 13 == 2, F.concat_ws(",", key, doubled, F.lit("x"), balance, "c_mktsegment"))
        .when(F.col("c_custkey") % 17 == 3, F.concat_ws(",", key, doubled, nation, balance, F.lit("OTHER")))
        .otherwise(F.concat_ws(",", key, doubled, nation, known, "c_mktsegment"))
    )
    customer = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "customer-broken")
    customer.select(line.alias("value")).write.text(path)
    found = read_csv_checked(
        spark, path, customer.schema, header=False, checks={"segment": F.col("c_mktsegment").isin(*SEGMENTS)}
    )
    rejected = found.rejected.select("record", F.array_join("reasons", ", ").alias("reasons"))
    return found.rows.unionByName(rejected, allowMissingColumns=True)
