"""Data-quality profiles, checks and repair. Every profile is one aggregation."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions.predicates import SENTINEL, is_sentinel, quoted, violates_format
from podium.operators.exact import exact_means, exact_moments, one_row
from podium.sources.dimensions import codes as code_frame


def _long(
    df: DataFrame,
    columns: Sequence[str],
    stats: Callable[[str], dict[str, Column]],
    facts: Callable[[str], dict[str, Column]] = lambda c: {},
) -> DataFrame:
    """One aggregation over all columns, turned into one row per column.

    ``stats`` gives the aggregates of a column, ``facts`` what is known without reading it.
    """
    wanted = {c: stats(c) for c in columns}
    wide = df.agg(*[
        expression.alias(f"_{i}_{stat}")
        for i, c in enumerate(columns)
        for stat, expression in wanted[c].items()
    ])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[known.alias(fact) for fact, known in facts(c).items()],
            *[F.col(f"_{i}_{stat}").alias(stat) for stat in wanted[c]],
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, non_null, nulls`` for every column."""
    return _long(
        df,
        columns or df.columns,
        lambda c: {"non_null": F.count(quoted(c)), "nulls": F.count_if(quoted(c).isNull())},
    )


def null_fractions(
    df: DataFrame, columns: Sequence[str] | None = None, suffix: str = "_missing_fraction"
) -> DataFrame:
    """One row: the fraction (0 to 1) of NULLs in every column; NULL for an empty table."""
    rows = F.count(F.lit(1))
    return df.agg(*[
        F.try_divide(F.count_if(quoted(c).isNull()), rows).alias(c + suffix)
        for c in columns or df.columns
    ])


def sentinel_profile(
    df: DataFrame, columns: Sequence[str] | None = None, sentinel: str = SENTINEL
) -> DataFrame:
    """``column_name, sentinel_rows``: how often every column holds the missing-value text."""
    return _long(
        df,
        columns or df.columns,
        lambda c: {"sentinel_rows": F.count_if(is_sentinel(quoted(c), sentinel))},
    )


def missing_by_group(df: DataFrame, by: str, counts: dict[str, str]) -> DataFrame:
    """NULLs per group, worst group first; ``counts`` maps output name to column."""
    return (
        df.groupBy(quoted(by))
        .agg(*[F.count_if(quoted(c).isNull()).alias(name) for name, c in counts.items()])
        .orderBy(*[quoted(name).desc() for name in counts], quoted(by).asc())
    )


def sentinel_by_group(
    df: DataFrame, by: str, counts: dict[str, str], sentinel: str = SENTINEL
) -> DataFrame:
    """Missing-value texts per group; groups without any are left out."""
    flags = {name: is_sentinel(quoted(c), sentinel) for name, c in counts.items()}
    return (
        df.select(quoted(by), *[flag.alias(name) for name, flag in flags.items()])
        .filter(reduce(Column.__or__, [quoted(name) for name in flags]))
        .groupBy(quoted(by))
        .agg(*[F.count_if(quoted(name)).alias(name) for name in flags])
    )


def table_profile(df: DataFrame, *, exact: bool = False) -> DataFrame:
    """Summary statistics of every number, text, date and time column, one row each.

    ``exact`` takes mean and deviation of whole numbers and doubles from :func:`exact_moments`: the same for any order and partitioning of the rows, at the price
    of two more readings of these columns. Otherwise they come from the one aggregation of the numbers and may differ in the last digits.

    Values keep their type: ``mean``, ``stddev``, ``min_number`` and
    ``max_number`` for numbers, ``min_text`` and ``max_text`` for text,
    ``min_time`` and ``max_time`` (without time zone) for dates and times.

    Numbers and text are aggregated apart. The smallest and largest text need an
    aggregation without hashing and generated code that would slow the numbers
    down several times; and columnar files still read every column just once.
    """

    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    summed = [c for c in numbers if exact and not isinstance(df.schema[c].dataType, T.DecimalType)]
    moments = one_row(exact_moments(df, summed)) if summed else None

    number_columns = dict.fromkeys(("mean", "stddev", "min_number", "max_number"), "double")
    time_columns = dict.fromkeys(("min_time", "max_time"), "timestamp_ntz")

    def number(c: str) -> dict[str, Column]:
        value = quoted(c)
        ends = {"non_null": F.count(value), "min_number": F.min(value).cast("double"), "max_number": F.max(value).cast("double")}
        if c in summed:
            return ends
        return ends | {"mean": F.avg(value).cast("double"), "stddev": F.stddev_samp(value)}

    def exactly(c: str) -> dict[str, Column]:
        return {n: moments[f"{n}_{c}"] for n in ("mean", "stddev")} if c in summed else {}

    def text(c: str) -> dict[str, Column]:
        value = quoted(c)
        return {"non_null": F.count(value), "min_text": F.min(value), "max_text": F.max(value)}

    def time(c: str) -> dict[str, Column]:
        value = quoted(c)
        ends = {"min_time": F.min(value), "max_time": F.max(value)}
        return {"non_null": F.count(value)} | {n: v.cast("timestamp_ntz") for n, v in ends.items()}

    times = [
        f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    ]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    kept = [c for c in numbers if c not in summed]
    # Numbers and times are as cheap as each other and share an aggregation; a row has the statistics of one kind and NULL for the other.
    both = number_columns | time_columns

    def quick(c: str) -> dict[str, Column]:
        own = number(c) if c in kept else time(c)
        return {"non_null": own["non_null"]} | {n: own.get(n, F.max(F.lit(None).cast(kind))) for n, kind in both.items()}

    parts = [_long(df, c, stats) for c, stats in ((kept + times, quick), (texts, text)) if c]
    if summed:
        parts.append(_long(df, summed, number, exactly))
    if not parts:
        raise ValueError("the table has no number, text or time columns")
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    kinds = number_columns | {"min_text": "string", "max_text": "string"} | time_columns
    return whole.select(
        "column_name",
        "non_null",
        *[
            (F.col(c) if c in whole.columns else F.lit(None).cast(kind)).alias(c)
            for c, kind in kinds.items()
        ],
    )


def column_catalog(df: DataFrame) -> DataFrame:
    """``column_name, position, data_type, non_null, row_count`` for every column."""
    place = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(df.schema, start=1)}
    return _long(
        df,
        df.columns,
        lambda c: {"non_null": F.count(quoted(c)), "row_count": F.count(F.lit(1))},
        lambda c: {"position": F.lit(place[c][0]), "data_type": F.lit(place[c][1])},
    )


def distinct_row_count(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """One row ``distinct_rows``: exact by default, a sketch estimate on request.

    Copies of a row are dropped before the shuffle, so a row repeated a billion
    times still travels once per task.
    """
    if approximate:
        row = F.struct(*[quoted(c) for c in df.columns])
        return df.agg(F.approx_count_distinct(F.xxhash64(row)).alias("distinct_rows"))
    return df.distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))


def impute_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace NULLs by the mean of the column. Whole numbers become doubles.

    Means come from :func:`exact_sums`, so a table read or dealt out another way is filled with the same values. They are one row that the rows meet as a
    scalar subquery: nothing goes through the driver program and no join is needed. A column without any value stays NULL.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    floats = [c for c in columns if isinstance(kinds[c], (T.DoubleType, T.FloatType))]
    others = [c for c in columns if c not in floats]
    filled = df
    rows = []
    if floats:
        rows.append((floats, one_row(exact_means(df, floats))))
    if others:

        def mean(c: str) -> Column:
            if isinstance(kinds[c], T.IntegralType):  # sums of decimals are exact
                return F.try_divide(F.sum(quoted(c).cast("decimal(38,0)")).cast("double"), F.count(quoted(c)).cast("double"))
            return F.avg(quoted(c)).cast("double")

        rows.append((others, one_row(df.agg(*[mean(c).alias(c) for c in others]))))
    for some, means in rows:
        helper = "_means"
        while helper in df.columns:
            helper += "_"
        filled = filled.withColumn(helper, means).withColumns({
            c: F.coalesce(quoted(c).cast("double"), F.col(helper)[c]) for c in some
        }).drop(helper)
    return filled


def format_report(df: DataFrame, patterns: dict[str, str], include_null: bool = False) -> DataFrame:
    """``column_name, pattern, violations`` for every column with a pattern: how many values it does not match."""
    return _long(
        df,
        list(patterns),
        lambda c: {"violations": F.count_if(violates_format(quoted(c), patterns[c], include_null))},
        lambda c: {"pattern": F.lit(patterns[c])},
    )


def drop_columns_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Leave out the columns whose name matches ``pattern`` anywhere."""
    return df.select(*[quoted(c) for c in df.columns if not re.search(pattern, c)])


def leaked_rows(df: DataFrame, column: str, codes: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose ``column`` holds a value that belongs to another domain.

    ``codes`` is a list, tested during the scan, or a DataFrame with one column,
    tested by a semi-join.
    """
    if isinstance(codes, DataFrame):
        return df.join(codes, df[column] == codes[codes.columns[0]], "left_semi")
    return df.filter(quoted(column).isin(*codes))


def has_leak(df: DataFrame, column: str, codes: Sequence[str] | DataFrame) -> bool:
    """Whether :func:`leaked_rows` finds anything; stops at the first hit."""
    return not leaked_rows(df, column, codes).isEmpty()


def leak_summary(df: DataFrame, column: str, codes: Sequence[str] | DataFrame) -> DataFrame:
    """``code, leaked_rows, leaked`` for every code, also for codes never found."""
    wanted = codes if isinstance(codes, DataFrame) else code_frame(df.sparkSession, codes)
    wanted = wanted.select(wanted[wanted.columns[0]].alias("code")).distinct()
    # Values are counted first, so what meets the codes is a row per value and not per row of the table.
    found = df if isinstance(codes, DataFrame) else leaked_rows(df, column, codes)
    hits = found.groupBy(quoted(column).alias("code")).agg(F.count(F.lit(1)).alias("leaked_rows"))
    rows = F.coalesce("leaked_rows", F.lit(0).cast("bigint"))
    return wanted.join(hits, "code", "left").select(
        "code", rows.alias("leaked_rows"), (rows > 0).alias("leaked")
    )
