"""Counting rows per group: the pre-aggregation every ranking and trend starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions.predicates import as_column


def tally(
    df: DataFrame,
    by: list[str | Column],
    *,
    of: str | Column | None = None,
    where: Column | None = None,
    distinct: list[str | Column] | None = None,
    name: str = "n",
) -> DataFrame:
    """Count per group, for all groups of ``df``, also those that count nothing.

    ``of`` counts only rows where that value is not NULL. ``where`` counts only
    rows that satisfy it, without removing groups. ``distinct`` counts each
    combination of the given columns once instead of every row.

    Rows are combined before the shuffle, so a group holding most of the table
    still sends one row per task. That holds for ``distinct`` too: copies are
    removed by one aggregation first and counted by a second.
    """
    counted = F.lit(1) if of is None else as_column(of)
    keep = counted.isNotNull() if where is None else (where & counted.isNotNull())
    keys = [as_column(c) for c in by]
    if distinct is None:
        return df.groupBy(*keys).agg(F.count(F.when(keep, F.lit(1))).alias(name))

    marks = [as_column(c).alias(f"_mark{i}") for i, c in enumerate(distinct)]
    named = df.select(*[k.alias(f"_key{i}") for i, k in enumerate(keys)], *marks, keep.alias("_keep"))
    once = named.groupBy(*[c for c in named.columns if c != "_keep"]).agg(
        F.max(F.coalesce("_keep", F.lit(False))).alias("_keep")
    )
    counts = once.groupBy(*[f"_key{i}" for i in range(len(keys))]).agg(
        F.count(F.when(F.col("_keep"), F.lit(1))).alias(name)
    )
    names = df.select(*keys).columns
    return counts.withColumnsRenamed({f"_key{i}": n for i, n in enumerate(names)})
