"""Period-over-period growth and shares of a total, on pre-aggregated counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions.rates import change_pct, percent_text, share_pct


def growth(counts: DataFrame, category: str, period: str, count: str = "n") -> DataFrame:
    """Add ``prev_<count>`` and ``growth_pct`` against the previous period present.

    ``counts`` has one row per category and period, so a window holds at most as
    many rows as there are periods, whatever the size of the table behind it.
    """
    in_time = Window.partitionBy(category).orderBy(period)
    before = f"prev_{count}"
    return counts.withColumn(before, F.lag(count).over(in_time)).withColumn(
        "growth_pct", change_pct(count, before)
    )


def growth_and_share(
    counts: DataFrame,
    category: str,
    period: str,
    count: str = "n",
    *,
    totals: str = "join",
) -> DataFrame:
    """:func:`growth` plus ``total_<count>`` per period, ``share_pct`` and both rates as text.

    Counts without a period are left out: they belong to no point in time.

    ``totals`` decides where the period total comes from:

    * ``"join"``: a second, partially combined sum over ``counts``, joined back.
      Right for any number of categories. Both sides start from the same
      shuffled counts, so the table behind them is scanned once.
    * ``"window"``: a sum over all rows of a period. One join less, but a whole
      period meets in one task: only for a handful of categories.
    """
    total = f"total_{count}"
    counts = counts.filter(F.col(period).isNotNull())
    grown = growth(counts, category, period, count)
    if totals == "window":
        with_total = grown.withColumn(total, F.sum(count).over(Window.partitionBy(period)))
    elif totals == "join":
        sums = counts.groupBy(period).agg(F.sum(count).alias(total))
        with_total = grown.join(sums, period)
    else:
        raise ValueError("totals must be 'join' or 'window'")
    return with_total.withColumn("share_pct", share_pct(count, total)).select(
        period,
        category,
        count,
        f"prev_{count}",
        "growth_pct",
        percent_text("growth_pct").alias("growth_text"),
        total,
        "share_pct",
        percent_text("share_pct").alias("share_text"),
    )
