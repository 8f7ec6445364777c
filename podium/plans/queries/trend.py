"""Growth and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators.tally import tally
from podium.operators.trend import growth, growth_and_share
from podium.plans.queries.registry import order_year, query, table

TREND_SQL = """
WITH counts AS (
  SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS y, count(o_orderkey) AS n
  FROM orders GROUP BY 1, 2
), totals AS (
  SELECT y, CAST(sum(n) AS BIGINT) AS total_n FROM counts GROUP BY y
), compared AS (
  SELECT c.y, o_orderstatus, n, total_n,
         lag(n) OVER (PARTITION BY o_orderstatus ORDER BY c.y) AS prev_n
  FROM counts c JOIN totals t ON c.y = t.y
), rates AS (
  SELECT *,
         TRY_CAST((n - prev_n) / nullif(prev_n, 0) * 100 AS DECIMAL(10, 3)) AS growth_pct,
         TRY_CAST(n / nullif(total_n, 0) * 100 AS DECIMAL(10, 3)) AS share_pct
  FROM compared
)
SELECT y, o_orderstatus, n, prev_n, CAST(growth_pct AS DOUBLE) AS growth_pct,
       CAST(growth_pct AS VARCHAR) || '%' AS growth_text,
       total_n, CAST(share_pct AS DOUBLE) AS share_pct,
       CAST(share_pct AS VARCHAR) || '%' AS share_text
FROM rates
"""


def _as_double(trend: DataFrame) -> DataFrame:
    """Engines hand decimals over differently; the texts still show all three places."""
    rates = [c for c in ("growth_pct", "share_pct") if c in trend.columns]
    return trend.withColumns({c: F.col(c).cast("double") for c in rates})


def _orders_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(table(spark, sf_dir, "orders"), ["o_orderstatus", order_year()], of="o_orderkey")


@query(TREND_SQL)
def participation_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three order statuses per year are few enough to total them in a window."""
    counts = _orders_by_status(spark, sf_dir)
    return _as_double(growth_and_share(counts, "o_orderstatus", "y", totals="window"))


@query(TREND_SQL)
def participation_trend_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _orders_by_status(spark, sf_dir)
    return _as_double(growth_and_share(counts, "o_orderstatus", "y", totals="join"))


@query("""
WITH counts AS (
  SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(event_id) AS n
  FROM events GROUP BY 1, 2
), compared AS (
  SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS prev_n FROM counts
)
SELECT event_type, day, n, prev_n,
       TRY_CAST((n - prev_n) / nullif(prev_n, 0) * 100 AS DECIMAL(10, 3)) AS growth_pct
FROM compared
""")
def lag_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    counts = tally(table(spark, sf_dir, "events"), ["event_type", day], of="event_id")
    return growth(counts, "event_type", "day")
