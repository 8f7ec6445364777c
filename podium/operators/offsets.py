"""Comparing one marked period per group with its neighbouring periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions.predicates import quoted
from podium.functions.rates import ratio_pct
from podium.sources.dimensions import dimension


def enrich(df: DataFrame, lookup: Mapping | DataFrame, on: str, name: str) -> DataFrame:
    """Add ``name`` by looking ``on`` up; rows without an entry keep NULL.

    ``lookup`` is a mapping, or a DataFrame with the columns ``on`` and ``name``
    and one row per key. The new column comes last.
    """
    entries = _frame(df, lookup, on, name).select(quoted(on).alias("_key"), quoted(name).alias(name))
    return df.join(entries, quoted(on) == F.col("_key"), "left").select(*[quoted(c) for c in df.columns], quoted(name))


def compare_offsets(
    counts: DataFrame,
    marked: Mapping | DataFrame,
    *,
    period: str,
    group: str,
    count: str = "n",
    offsets: Sequence[int] = (-1, -2, 1, 2),
) -> DataFrame:
    """Set a group's count in its marked period against the periods around it.

    ``counts`` has one row per period and group, covering all periods of the
    data. ``marked`` names the group to look at in each marked period: a mapping
    ``period -> group``, or a DataFrame with these two columns; a pair given
    twice counts once.

    Per marked pair the result holds ``<count>_host`` and, for the offset at
    place *i*, ``<count>_other<i>`` (0 when there is nothing to count) with
    ``other<i>_in_range`` saying whether that period lies within the data. It
    ends with two rates, NULL where undefined: ``margin_over_host_pct`` is the
    lead over the best neighbour in percent of the host count,
    ``change_over_best_pct`` the same lead in percent of the best neighbour.

    However many pairs are marked, the data is read once: the wanted cells are
    joined to ``counts`` and summed into columns. Counts without a period or
    group belong to no pair, but a period with any row is in the data, whatever
    its groups and counts.
    """
    pairs = _frame(counts, marked, period, group).distinct()
    steps = [0, *offsets]
    names = [f"{count}_host", *[f"{count}_other{i}" for i in range(1, len(steps))]]

    cells = pairs.select(
        F.col(period).alias("_period"),
        F.col(group).alias("_group"),
        F.inline(
            F.array(*[
                F.struct(F.lit(i).alias("_slot"), (F.col(period) + F.lit(step)).alias("_at"))
                for i, step in enumerate(steps)
            ])
        ),
    )
    found = counts.join(
        cells, F.col(period).eqNullSafe(F.col("_at")) & F.col(group).eqNullSafe(F.col("_group"))
    ).select("_period", "_group", "_slot", F.col(count).alias("_count"))
    # One zero per pair keeps those for which nothing was found.
    zeros = pairs.select(
        F.col(period).alias("_period"),
        F.col(group).alias("_group"),
        F.lit(0).alias("_slot"),
        F.lit(0).cast("bigint").alias("_count"),
    )
    compared = (
        found.unionByName(zeros)
        .groupBy("_period", "_group")
        .agg(*[
            F.coalesce(F.sum(F.when(F.col("_slot") == i, F.col("_count"))), F.lit(0)).alias(n)
            for i, n in enumerate(names)
        ])
        .withColumnsRenamed({"_period": period, "_group": group})
    )

    # The ends carry a count along. So both aggregations need the same columns of
    # ``counts`` and share one scan and one shuffle, as does the null-safe join.
    end = F.when(F.col(period).isNotNull(), F.struct(F.col(period).alias("at"), F.col(count)))
    ends = counts.agg(F.struct(F.min(end)["at"].alias("first"), F.max(end)["at"].alias("last")))
    host, best = F.col(names[0]), _best(names[1:])
    return compared.withColumn("_ends", ends.scalar()).select(
        period,
        group,
        *names,
        *[
            (F.col(period) + F.lit(step))
            .between(F.col("_ends.first"), F.col("_ends.last"))
            .alias(f"other{i}_in_range")
            for i, step in enumerate(steps)
            if i > 0
        ],
        ratio_pct(host - best, host).alias("margin_over_host_pct"),
        ratio_pct(host - best, best).alias("change_over_best_pct"),
    )


OFFSETS_STATEMENT = """
WITH counts AS (
  SELECT period, member, count(item) AS n
  FROM {entries}
  GROUP BY period, member
)
SELECT
  m.period,
  m.member,
  coalesce(sum(CASE WHEN c.period = m.period             THEN c.n END), 0) AS n_host,
  coalesce(sum(CASE WHEN c.period = m.period - :step     THEN c.n END), 0) AS n_other1,
  coalesce(sum(CASE WHEN c.period = m.period - 2 * :step THEN c.n END), 0) AS n_other2,
  coalesce(sum(CASE WHEN c.period = m.period + :step     THEN c.n END), 0) AS n_other3,
  coalesce(sum(CASE WHEN c.period = m.period + 2 * :step THEN c.n END), 0) AS n_other4
FROM {marked} AS m
LEFT JOIN counts AS c
  ON c.member = m.member
 AND c.period BETWEEN m.period - 2 * :step AND m.period + 2 * :step
GROUP BY m.period, m.member
"""


def compare_offsets_sql(
    entries: DataFrame,
    marked: Mapping | DataFrame,
    *,
    period: str,
    group: str,
    item: str,
    step: int,
) -> DataFrame:
    """The counts of :func:`compare_offsets`, two steps each way, as one SQL statement.

    ``entries`` are single rows, not counts; ``item`` is counted where not NULL.
    """
    view = entries.select(
        F.col(period).alias("period"), F.col(group).alias("member"), F.col(item).alias("item")
    )
    pairs = _frame(entries, marked, period, group).select(
        F.col(period).alias("period"), F.col(group).alias("member")
    ).distinct()
    compared = entries.sparkSession.sql(
        OFFSETS_STATEMENT, args={"step": step}, entries=view, marked=pairs
    )
    host = F.col("n_host")
    best = _best([f"n_other{i}" for i in range(1, 5)])
    return compared.withColumn("margin_over_host_pct", ratio_pct(host - best, host)).withColumnsRenamed(
        {"period": period, "member": group}
    )


def _best(names: list[str]):
    return F.greatest(*names) if len(names) > 1 else F.col(names[0])


def _frame(df: DataFrame, lookup: Mapping | DataFrame, key: str, value: str) -> DataFrame:
    if isinstance(lookup, DataFrame):
        return lookup.select(quoted(key), quoted(value))
    types = dict(df.dtypes)
    return dimension(df.sparkSession, lookup, key, value, types[key], types.get(value))
