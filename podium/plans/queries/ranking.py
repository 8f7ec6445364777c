"""Top-k, leaders, modal bands and lists as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podium.functions.bands import Bands
from podium.functions.predicates import is_present
from podium.operators.ranking import leaders, modal_bands, rollup_text, top_k
from podium.operators.tally import tally
from podium.plans.queries.registry import FACT_SQL, NO_AWARD, orders_per_nation, query, table

TOP_SQL = f"""
WITH {FACT_SQL}, counts AS (
  SELECT y, n_name, count(CASE WHEN o_orderpriority <> '{NO_AWARD}' THEN 1 END) AS awards
  FROM fact GROUP BY y, n_name
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY y ORDER BY awards DESC, n_name) AS INTEGER) AS rank
  FROM counts
), top AS (SELECT * FROM ranked WHERE rank <= 10)
"""


def _awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_per_nation(
        spark, sf_dir, lambda: is_present("o_orderpriority", NO_AWARD), "awards"
    )


def _top_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_awards(spark, sf_dir), ["y"], "awards", ["n_name"], 10)


@query(TOP_SQL + "SELECT y, n_name, awards, rank FROM top")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_nations(spark, sf_dir)


@query(TOP_SQL + """
SELECT y, string_agg(n_name || '-' || CAST(awards AS VARCHAR), ', ' ORDER BY rank) AS top_nations
FROM top GROUP BY y
""")
def topk_rollup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _top_nations(spark, sf_dir)
    return rollup_text(best, ["y"], ["rank"], ["n_name", "awards"], "top_nations")


LEADER_SQL = f"""
WITH counts AS (
  SELECT p_brand, n_name, count(CASE WHEN o_orderpriority <> '{NO_AWARD}' THEN 1 END) AS awards
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
  GROUP BY p_brand, n_name
), leaders AS (
  SELECT p_brand, n_name, awards FROM counts
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY awards DESC, n_name) = 1
)
"""


def _brand_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two chains meet in one join: orders are narrowed to key, nation and award first."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", is_present("o_orderpriority", NO_AWARD).alias("award")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    placed = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        "o_orderkey", "c_nationkey", "award"
    )
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    sold = items.join(placed, items["l_orderkey"] == placed["o_orderkey"]).join(
        part, items["l_partkey"] == part["p_partkey"]
    )
    counts = tally(sold, ["p_brand", "c_nationkey"], where=F.col("award"), name="awards")
    named = counts.join(nation, counts["c_nationkey"] == nation["n_nationkey"])
    return leaders(named.select("p_brand", "n_name", "awards"), ["p_brand"], "awards", ["n_name"])


@query(LEADER_SQL + "SELECT p_brand, n_name, awards FROM leaders")
def leader_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brand_leaders(spark, sf_dir)


@query(LEADER_SQL + """
SELECT n_name, string_agg(p_brand || '-' || CAST(awards AS VARCHAR), ', ' ORDER BY p_brand) AS brands
FROM leaders GROUP BY n_name
""")
def leaders_regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One leader per brand: a list is at most as long as there are brands."""
    led = _brand_leaders(spark, sf_dir)
    return rollup_text(led, ["n_name"], ["p_brand"], ["p_brand", "awards"], "brands")


@query(LEADER_SQL + """
SELECT n_name, p_brand, awards,
       CAST(row_number() OVER (PARTITION BY n_name ORDER BY p_brand) AS INTEGER) AS position
FROM leaders
""")
def leader_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regrouped leaders as rows: the form for results of any length."""
    in_order = Window.partitionBy("n_name").orderBy("p_brand")
    return _brand_leaders(spark, sf_dir).withColumn("position", F.row_number().over(in_order))


SIZE_BANDS = Bands.even(10, 50, 10)
PRICE_BANDS = Bands.even(900, 1000, 20)
QUANTITY_BANDS = Bands.even(0, 50, 5)


def band_sql(value: str, first: int, last: int, width: int) -> str:
    """Band number by arithmetic, NULL outside."""
    return (
        f"CASE WHEN {value} >= {first} AND {value} < {last} "
        f"THEN CAST(floor(({value} - {first}) / {width}) AS INTEGER) END"
    )


def band_label_sql(number: str, first: int, width: int) -> str:
    low = f"({first} + {width} * {number})"
    return f"CAST({low} AS VARCHAR) || '-' || CAST({low} + {width} AS VARCHAR)"


@query(f"""
WITH banded AS (SELECT {band_sql('p_size', 10, 50, 10)} AS b FROM part)
SELECT {band_label_sql('b', 10, 10)} AS size_band, count(*) AS parts
FROM banded GROUP BY b
""")
def band_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return tally(part, [SIZE_BANDS.label("p_size").alias("size_band")], name="parts")


def mode_sql(group: str, source: str, scales: dict[str, tuple[str, int, int, int]], null_last: bool) -> str:
    """One count per value and band, ranked, then laid out side by side."""
    counts = " UNION ALL ".join(
        f"SELECT {group}, '{name}' AS d, {band_sql(*scale)} AS b FROM {source}"
        for name, scale in scales.items()
    )
    order = "(b IS NULL), n DESC, b" if null_last else "n DESC, (b IS NULL), b"
    columns = ", ".join(
        f"max(CASE WHEN d = '{name}' THEN {band_label_sql('b', first, width)} END) AS {name}"
        for name, (_, first, _, width) in scales.items()
    )
    return f"""
    SELECT {group}, {columns} FROM (
      SELECT {group}, d, b, row_number() OVER (PARTITION BY {group}, d ORDER BY {order}) AS place
      FROM (SELECT {group}, d, b, count(*) AS n FROM ({counts}) GROUP BY {group}, d, b)
    ) WHERE place = 1 GROUP BY {group}
    """


SOLD_SQL = """
WITH sold AS (
  SELECT p_brand, p_size, p_retailprice, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey
)"""
SOLD_SCALES = {
    "size_band": ("p_size", 10, 50, 10),
    "price_band": ("p_retailprice", 900, 1000, 20),
    "quantity_band": ("l_quantity", 0, 50, 5),
}


@query(SOLD_SQL + mode_sql("p_brand", "sold", SOLD_SCALES, null_last=True))
def mode_band_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modes(spark, sf_dir, null_competes=False)


@query(SOLD_SQL + mode_sql("p_brand", "sold", SOLD_SCALES, null_last=False))
def mode_band_null_competes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modes(spark, sf_dir, null_competes=True)


def _modes(spark: SparkSession, sf_dir: str, null_competes: bool) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    sold = items.join(part, items["l_partkey"] == part["p_partkey"])
    bands = {
        "size_band": (F.col("p_size"), SIZE_BANDS),
        "price_band": (F.col("p_retailprice"), PRICE_BANDS),
        "quantity_band": (F.col("l_quantity"), QUANTITY_BANDS),
    }
    return modal_bands(sold, "p_brand", bands, null_competes=null_competes)
