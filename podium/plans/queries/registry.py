"""The list of queries, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators.tally import tally

Build = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    build: Build
    sql: str


REGISTRY: dict[str, Query] = {}


def query(sql: str) -> Callable[[Build], Build]:
    """Register the decorated function under its own name, with equivalent SQL."""

    def register(build: Build) -> Build:
        REGISTRY[build.__name__] = Query(build, sql)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Order priority plays the award: one value stands for "none", one for gold.
NO_AWARD = "4-NOT SPECIFIED"
GOLD = "1-URGENT"

def order_year() -> Column:
    return F.year("o_orderdate").alias("y")


def orders_per_nation(
    spark: SparkSession, sf_dir: str, where: Callable[[], Column] | None = None, name: str = "n"
) -> DataFrame:
    """Orders by year and nation; ``where`` restricts what is counted, not the groups.

    Counting happens on the nation's key; the 25 names join the counts, not the orders.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    placed = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    counts = tally(
        placed,
        [order_year(), "c_nationkey"],
        of="o_orderkey",
        where=where() if where else None,
        name=name,
    )
    return counts.join(nation, counts["c_nationkey"] == nation["n_nationkey"]).select(
        "y", "n_name", name
    )


FACT_SQL = """
fact AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS y, n_name, o_orderkey, o_custkey, o_orderpriority
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
)"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; quality and toxic are NULL where there is none."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return documents.join(labels, "doc_id", "left")


def labelled_marks(spark: SparkSession, sf_dir: str, mark: str | None = None) -> DataFrame:
    """:func:`labelled_documents` for questions about missing values: every text is cut down to one character, or to ``mark`` if it is that, before the join.

    So whole texts are neither joined nor shuffled; NULL stays NULL.
    """
    documents = table(spark, sf_dir, "documents")
    short = F.when(F.col("text") == mark, F.lit(mark)).otherwise(F.substring("text", 1, 1)) if mark else F.substring("text", 1, 1)
    narrow = documents.select("doc_id", short.alias("text"), "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return narrow.join(labels, "doc_id", "left")


LABELLED_SQL = """
labelled AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
