"""One aggregation for several counts: grouping sets, combined in each task and shuffled once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.functions.predicates import quoted

_SET = "_set"


@dataclass(frozen=True)
class SharedCounts:
    """Counts by several combinations of columns, in one table whose rows say which combination they belong to."""

    table: DataFrame
    keys: tuple[str, ...]
    sets: tuple[tuple[str, ...], ...]
    measures: tuple[str, ...]

    def _number(self, by: Sequence[str]) -> int:
        if set(by) not in map(set, self.sets):
            raise ValueError(f"{list(by)} is none of the combinations counted: {[list(s) for s in self.sets]}")
        # A combination's number has a bit for every key that it leaves out, the first key's bit highest.
        return reduce(lambda n, key: 2 * n + (key not in by), self.keys, 0)

    def counts(self, by: Sequence[str], measure: str, name: str | None = None) -> DataFrame:
        """``by`` and the count, one row per group."""
        if measure not in self.measures:
            raise ValueError(f"{measure!r} is not counted; {list(self.measures)} are")
        rows = self.table.filter(F.col(_SET) == self._number(by))
        return rows.select(*[quoted(c) for c in by], quoted(measure).alias(name or measure))

    def stacked(self, group: str, values: Sequence[str], measure: str) -> DataFrame:
        """``group``, ``_value`` (place of the column in ``values``), ``_band`` (its content) and ``_n``, for the combinations of ``group`` and each value."""
        numbers = [self._number([group, v]) for v in values]
        which = reduce(lambda rest, i: F.when(F.col(_SET) == numbers[i], F.lit(i)).otherwise(rest), range(len(values)), F.lit(None).cast("int"))
        band = reduce(lambda rest, i: F.when(F.col(_SET) == numbers[i], quoted(values[i])).otherwise(rest), range(len(values)), F.lit(None))
        rows = self.table.filter(F.col(_SET).isin(*numbers))
        return rows.select(quoted(group), which.alias("_value"), band.alias("_band"), quoted(measure).alias("_n"))

    def stored(self, keep: Callable[[DataFrame, str], DataFrame]) -> SharedCounts:
        """The same counts, computed once and read from where ``keep`` (such as ``scratch.stage``) puts them."""
        return replace(self, table=keep(self.table, "shared-counts"))


def shared_counts(df: DataFrame, sets: Sequence[Sequence[str]], measures: Mapping[str, Column]) -> SharedCounts:
    """Every measure for every combination of columns in ``sets``, from one scan and one shuffle.

    ``measures`` are aggregates such as ``F.count("ID")``. Rows are laid out by combination and combined again inside each task, so what is shuffled is at most a
    row per group, task and combination, however many rows a group has. A NULL key is a group of its own, apart from "not in this combination".
    """
    keys = list(dict.fromkeys(c for s in sets for c in s))
    clash = {_SET, *measures} & set(keys)
    if clash or _SET in measures:
        raise ValueError(f"names used twice: {sorted(clash or {_SET})}")
    grouped = df.groupingSets([[quoted(c) for c in s] for s in sets], *[quoted(c) for c in keys])
    table = grouped.agg(F.grouping_id().cast("long").alias(_SET), *[m.alias(n) for n, m in measures.items()])
    return SharedCounts(table, tuple(keys), tuple(map(tuple, sets)), tuple(measures))
