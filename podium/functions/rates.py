"""Percentages that give NULL, not an error, where they are undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from podium.functions.predicates import as_column

RATE_TYPE = "decimal(10,3)"


def ratio_pct(part: str | Column, whole: str | Column) -> Column:
    """``part / whole * 100`` as double; NULL when ``whole`` is zero."""
    return F.try_divide(as_column(part), as_column(whole)) * F.lit(100)


def share_pct(part: str | Column, whole: str | Column) -> Column:
    """:func:`ratio_pct` rounded half up to three places; NULL on overflow."""
    return ratio_pct(part, whole).try_cast(RATE_TYPE)


def change_pct(now: str | Column, before: str | Column) -> Column:
    """Growth from ``before`` to ``now`` in percent, rounded like :func:`share_pct`."""
    now, before = as_column(now), as_column(before)
    return share_pct(now - before, before)


def percent_text(rate: str | Column) -> Column:
    """``12.500`` becomes ``12.500%``; NULL stays NULL."""
    return F.concat(as_column(rate).cast("string"), F.lit("%"))
