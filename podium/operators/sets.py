"""Set operations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of all frames, duplicates kept, columns matched by name."""
    return reduce(DataFrame.unionByName, frames)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """The different values (or combinations) in the given columns."""
    return df.select(*columns).distinct()
