"""Distinct counts that can be kept and merged (sketches), and exact ones that shuffle digests in place of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions.predicates import quoted

LG_K = 12  # 2 ** 12 registers


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a sketch's estimate: two of three estimates are nearer to the truth than this."""
    return 1.04 / (2**lg_k) ** 0.5


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """128 bits of a row: equal rows have equal digests, and two different rows of 10 ** 12 share one with a chance of 10 ** -15.

    NULL and NaN are values equal to themselves and -0.0 is 0.0, as in DISTINCT. Columns of maps have no digest.
    """
    names = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema}

    def same(c: str) -> Column:
        return quoted(c) + F.lit(0.0) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else quoted(c)

    # A hash passes over NULLs, so which columns are NULL is hashed as well.
    nulls = F.concat(*[F.when(quoted(c).isNull(), F.lit("0")).otherwise(F.lit("1")) for c in names])
    first, second = (F.xxhash64(F.lit(seed), nulls, *[same(c) for c in names]) for seed in (1, 2))
    # Both hashes walk the same way, so the second one takes the columns backwards, too.
    second = F.xxhash64(F.lit(2), *[same(c) for c in reversed(names)], nulls)
    return F.struct(first.alias("a"), second.alias("b"))


def distinct_rows(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by`` and ``distinct_rows``, exact but for equal digests: 16 bytes of each different row of a task are shuffled, however wide rows are.

    The digests of a group are counted in many tasks, so one group may hold most of the table.
    """
    rest = [c for c in df.columns if c not in by]
    digest = row_digest(df, rest or df.columns)
    keys = [quoted(c).alias(f"_key{i}") for i, c in enumerate(by)]
    once = df.select(*keys, digest["a"].alias("_a"), digest["b"].alias("_b")).distinct()
    counts = once.groupBy(*[f"_key{i}" for i in range(len(by))]).agg(F.count(F.lit(1)).alias("distinct_rows"))
    return counts.select(*[F.col(f"_key{i}").alias(c) for i, c in enumerate(by)], "distinct_rows")


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """``by`` and ``column_name, sketch``: what is needed to estimate distinct values later, alone or merged with others.

    Sketches are combined in each task and have at most 2 ** ``lg_k`` bytes. NULL is no value. Store them by day or file and :func:`merge_sketches` over any days.
    """
    kinds = {f.name: f.dataType for f in df.schema}

    def value(c: str) -> Column:
        if isinstance(kinds[c], (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
            return quoted(c)
        return (quoted(c) + F.lit(0.0) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else quoted(c)).cast("string")

    wide = df.groupBy(*[quoted(c).alias(f"_key{i}") for i, c in enumerate(by)]).agg(
        *[F.hll_sketch_agg(value(c), lg_k).alias(f"_s{i}") for i, c in enumerate(columns)]
    )
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"_s{i}").alias("sketch")) for i, c in enumerate(columns)]
    return wide.select(*[F.col(f"_key{i}").alias(c) for i, c in enumerate(by)], F.inline(F.array(*rows)))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, column_name, sketch`` of the union of what the given sketches have seen; may be merged again."""
    return sketches.groupBy(*[quoted(c) for c in by], "column_name").agg(F.hll_union_agg("sketch", True).alias("sketch"))


def sketch_estimates(sketches: DataFrame) -> DataFrame:
    """The given rows with ``approx_distinct`` in place of ``sketch``."""
    return sketches.withColumn("approx_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")
