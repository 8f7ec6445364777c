"""Marked periods and their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions.predicates import is_present
from podium.operators.offsets import compare_offsets, compare_offsets_sql, enrich
from podium.operators.tally import tally
from podium.sources.dimensions import dimension
from podium.plans.queries.registry import (
    FACT_SQL,
    NO_AWARD,
    order_year,
    orders_per_nation,
    query,
    table,
)

HOSTS = {
    1995: "NATION_0",
    1996: "NATION_4",
    1997: "NATION_9",
    1998: "NATION_13",
    1999: "NATION_17",
    2000: "NATION_21",
    2001: "NATION_24",
}
HOSTS_SQL = "hosts(y, n_name) AS (VALUES " + ", ".join(
    f"({year}, '{nation}')" for year, nation in HOSTS.items()
) + ")"
STEPS = {"n_host": 0, "n_other1": -1, "n_other2": -2, "n_other3": 1, "n_other4": 2}


def _compared_sql(count: str) -> str:
    cells = ", ".join(
        f"count({count} CASE WHEN f.y = h.y + ({step}) AND f.n_name = h.n_name "
        f"AND o_orderpriority <> '{NO_AWARD}' THEN ITEM END) AS {name}"
        for name, step in STEPS.items()
    )
    return f"""
WITH {FACT_SQL}, {HOSTS_SQL},
ends AS (SELECT min(y) AS first_y, max(y) AS last_y FROM fact),
compared AS (
  SELECT h.y, h.n_name, {cells}
  FROM hosts h LEFT JOIN fact f ON f.n_name = h.n_name
  GROUP BY h.y, h.n_name
), best AS (
  SELECT *, greatest(n_other1, n_other2, n_other3, n_other4) AS best_other FROM compared
)
"""


COUNTS = "y, n_name, " + ", ".join(STEPS)
MARGIN = "(n_host - best_other) / nullif(n_host, 0) * 100 AS margin_over_host_pct"
CHANGE = "(n_host - best_other) / nullif(best_other, 0) * 100 AS change_over_best_pct"
RANGES = ", ".join(
    f"y + ({step}) BETWEEN first_y AND last_y AS {name[2:]}_in_range"
    for name, step in STEPS.items()
    if step
)
PER_ROW = _compared_sql("").replace("ITEM", "o_orderkey")
PER_CUSTOMER = _compared_sql("DISTINCT").replace("ITEM", "o_custkey || '/' || o_orderpriority")


@query(f"{PER_ROW} SELECT {COUNTS}, {RANGES}, {MARGIN}, {CHANGE} FROM best, ends")
def host_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    awards = orders_per_nation(spark, sf_dir, lambda: is_present("o_orderpriority", NO_AWARD))
    return compare_offsets(awards, HOSTS, period="y", group="n_name")


@query(f"{PER_CUSTOMER} SELECT {COUNTS}, {RANGES}, {MARGIN}, {CHANGE} FROM best, ends")
def host_advantage_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, but a customer's equal awards of a year count once."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    placed = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    counts = tally(
        placed,
        [order_year(), "c_nationkey"],
        where=is_present("o_orderpriority", NO_AWARD),
        distinct=["o_custkey", "o_orderpriority"],
    )
    named = counts.join(nation, counts["c_nationkey"] == nation["n_nationkey"])
    return compare_offsets(named.select("y", "n_name", "n"), HOSTS, period="y", group="n_name")


# One nation without a name, in the first year only, and no counts but its own there.
SPARSE_SQL = f"""
WITH {FACT_SQL}, {HOSTS_SQL}, sparse AS (
  SELECT y, n_name, count(*) AS n FROM fact WHERE y > (SELECT min(y) FROM fact) GROUP BY y, n_name
  UNION ALL SELECT min(y), NULL, NULL FROM fact
), ends AS (SELECT min(y) AS first_y, max(y) AS last_y FROM sparse), compared AS (
  SELECT h.y, h.n_name, """ + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN s.y = h.y + ({step}) THEN s.n END), 0) AS BIGINT) AS {name}" for name, step in STEPS.items()
) + f"""
  FROM hosts h LEFT JOIN sparse s ON s.n_name = h.n_name GROUP BY h.y, h.n_name
), best AS (SELECT *, greatest(n_other1, n_other2, n_other3, n_other4) AS best_other FROM compared)
SELECT {COUNTS}, {RANGES}, {MARGIN}, {CHANGE} FROM best, ends
"""


@query(SPARSE_SQL)
def host_advantage_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period whose only group has no name and no count is in the data all the same; pairs given twice count once."""
    counts = orders_per_nation(spark, sf_dir)
    ends = counts.agg(F.min("y").alias("first"))
    later = counts.filter(F.col("y") > ends.scalar())
    nothing = ends.select(F.col("first").alias("y"), F.lit(None).cast("string").alias("n_name"), F.lit(None).cast("long").alias("n"))
    hosts = dimension(spark, HOSTS, "y", "n_name", "int")
    return compare_offsets(later.unionByName(nothing), hosts.unionAll(hosts), period="y", group="n_name")


@query(f"{PER_ROW} SELECT {COUNTS}, {MARGIN} FROM best")
def host_advantage_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter(is_present("o_orderpriority", NO_AWARD))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    entries = (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, F.col("c_nationkey") == nation["n_nationkey"])
        .select(order_year(), "n_name", "o_orderkey")
    )
    return compare_offsets_sql(
        entries, HOSTS, period="y", group="n_name", item="o_orderkey", step=1
    )


ODD_HOSTS = {year: nation for year, nation in HOSTS.items() if year % 2}


@query("WITH hosts(y, host) AS (VALUES " + ", ".join(
    f"({year}, '{nation}')" for year, nation in ODD_HOSTS.items()
) + """)
SELECT o.*, host
FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders) o
LEFT JOIN hosts h ON o.y = h.y
""")
def host_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("*", order_year())
    return enrich(orders, ODD_HOSTS, "y", "host")
