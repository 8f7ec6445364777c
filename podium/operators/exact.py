"""Sums, means and deviations that do not depend on the order of rows: exact, rounded once at the end.

A finite double is a whole number of at most 53 bits times a power of two. On a fixed grid of limbs of 22 bits it falls into four neighbouring
limbs, whole numbers below 2 ** 22 each. Limbs are summed as longs, which is exact in any order and leaves room for 2 ** 40 rows, so partial sums in
tasks, their merging and their shuffling cannot change a result. A group needs one row per top limb met, at most 95, whatever its size. In the end limbs
are carried into each other and the highest four, with one more bit for what lies below them, give the nearest double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions.predicates import quoted

BITS = 22
MASK = (1 << BITS) - 1
LOWEST, HIGHEST = -48, 46  # top limbs of doubles; what lies below the lowest are parts of it
PIECES = 4
WHOLE_TOP = 2  # top limb of 64-bit whole numbers

_FLOATS = (T.DoubleType, T.FloatType)


def _top_limb(value: Column) -> Column:
    """Where a finite double starts. A logarithm that is off by one at a limb's edge does no harm: four pieces hold all bits either way."""
    size = F.floor(F.log2(F.abs(value)) / BITS).cast("int")
    return F.when(value == 0, F.lit(0)).otherwise(F.least(F.greatest(size, F.lit(LOWEST)), F.lit(HIGHEST)))


def _unit(limb: Column) -> Column:
    return F.get(F.array(*[F.lit(2.0 ** (BITS * i)) for i in range(LOWEST, HIGHEST + 1)]), limb - LOWEST)


def _split(rows: DataFrame) -> DataFrame:
    """``_top``, pieces ``_p0`` to ``_p3`` and ``_odd`` for rows with ``_double`` or ``_whole``; the other one is NULL."""
    odd = F.isnan("_double") | (F.abs("_double") == F.lit(float("inf")))
    rows = rows.withColumns({"_odd": F.when(odd, F.col("_double")), "_rest": F.when(~odd, F.col("_double"))})
    rows = rows.withColumn("_top", F.when(F.col("_rest").isNotNull(), _top_limb(F.col("_rest"))).otherwise(WHOLE_TOP))
    rows = rows.withColumn("_rest", F.col("_rest") / _unit(F.col("_top")))  # exact, as all that follows
    for i in range(PIECES):
        shift = BITS * (WHOLE_TOP - i)
        whole = F.shiftright("_whole", shift) if shift >= 0 else F.lit(0).cast("long")
        whole = whole.bitwiseAND(F.lit(MASK).cast("long")) if i else whole  # the first piece has the sign
        rows = rows.withColumn(f"_p{i}", F.coalesce(F.col("_rest").cast("long"), whole))
        rows = rows.withColumn("_rest", (F.col("_rest") - F.col(f"_p{i}").cast("double")) * F.lit(2.0**BITS))
    return rows


def _with_nearest(df: DataFrame, parts: str, name: str) -> DataFrame:
    """Add the double nearest to the sum of ``parts``: an array of structs of ``limb`` and ``sum``, several for a limb allowed.

    Each step is a projection of its own, as each uses the one before it several times.
    """
    zero, mask = F.lit(0).cast("long"), F.lit(MASK).cast("long")
    col = F.col

    def total(limb: Column) -> Column:
        own = F.filter(parts, lambda p: p["limb"] == limb)
        return F.aggregate(own, zero, lambda so_far, p: so_far + p["sum"])

    def carried(values: Column) -> Column:
        def step(done: Column, value: Column) -> Column:
            digits = F.concat(done["digits"], F.array((done["carry"] + value).bitwiseAND(mask)))
            return F.struct(F.shiftright(done["carry"] + value, BITS).alias("carry"), digits.alias("digits"))

        return F.aggregate(values, F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("digits")), step)

    def digit(back: int) -> Column:
        return F.when(col("_at") >= back, F.get("_digits", col("_at") - back)).otherwise(zero)

    limbs = F.transform(parts, lambda p: p["limb"])
    # Sums of longs reach three limbs up.
    df = df.withColumns({"_low": F.coalesce(F.array_min(limbs), F.lit(0)), "_high": F.coalesce(F.array_max(limbs), F.lit(0)) + 4})
    df = df.withColumn("_totals", F.transform(F.sequence("_low", "_high"), total))
    # What is carried out of the highest limb is -1 for negative sums, else 0.
    df = df.withColumn("_negative", carried(col("_totals"))["carry"] < 0)
    signed = F.transform("_totals", lambda t: F.when(col("_negative"), -t).otherwise(t))
    df = df.withColumn("_digits", carried(signed)["digits"])
    df = df.withColumn("_at", F.array_max(F.transform("_digits", lambda d, i: F.when(d != 0, i))))
    below = F.exists(F.transform("_digits", lambda d, i: (d != 0) & (i < col("_at") - 3)), lambda more: more)
    df = df.withColumns({
        "_upper": (digit(0) * (1 << BITS) + digit(1)).cast("double"),
        # The last bit stands for all below. Both halves are exact, so rounding happens once, in their addition.
        "_lower": ((digit(2) * (1 << BITS) + digit(3)) * 2 + below.cast("long")).cast("double"),
        "_unit": BITS * (col("_low") + col("_at") - 1),
    })
    first = F.floor(col("_unit") / 2).cast("int")  # a power of two in two steps, as one alone may lie beyond doubles
    value = (col("_upper") + col("_lower") * F.lit(2.0 ** (-2 * BITS - 1))) * F.pow(F.lit(2.0), first) * F.pow(F.lit(2.0), col("_unit") - first)
    return df.withColumn(name, F.when(col("_at").isNull(), F.lit(0.0)).when(col("_negative"), -value).otherwise(value))


def exact_sums(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, and for every column ``sum_<c>`` (the double nearest to the true sum) and ``count_<c>`` (values that are not NULL); one row per group.

    Columns are whole numbers, floats or doubles. The result is the same for every order and partitioning of the rows. NULLs are left out; the sum of none is
    NULL, and an empty table without ``by`` gives one row of NULLs and zeros. As in IEEE arithmetic NaN, or infinities of both signs, give NaN, and one infinity
    itself; a sum beyond the largest double is infinite. Sums below 2 ** -1000 may be rounded twice.

    One scan and three shuffles: of a row per task, group, column and power of two, of a row per group, column and power of two, and of a row per group and column.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    wrong = [c for c in columns if not isinstance(kinds[c], (*_FLOATS, T.IntegralType))]
    if wrong:
        raise ValueError(f"neither whole numbers nor doubles: {wrong}")
    keys = [f"_key{i}" for i in range(len(by))]

    def entry(place: int, c: str) -> Column:
        is_float = isinstance(kinds[c], _FLOATS)
        double = quoted(c).cast("double") if is_float else F.lit(None).cast("double")
        whole = F.lit(None).cast("long") if is_float else quoted(c).cast("long")
        return F.struct(F.lit(place).alias("_place"), double.alias("_double"), whole.alias("_whole"))

    stacked = df.select(
        *[quoted(c).alias(k) for c, k in zip(by, keys, strict=True)], F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)]))
    ).filter("_double IS NOT NULL OR _whole IS NOT NULL" if not by else "true")
    sums = _split(stacked).groupBy(*keys, "_place", "_top").agg(
        F.array(*[F.sum(f"_p{i}") for i in range(PIECES)]).alias("_sums"),
        F.count(F.coalesce(F.col("_double"), F.col("_whole").cast("double"))).alias("_count"),
        F.sum("_odd").alias("_odd"),
    )
    pieces = F.transform("_sums", lambda s, i: F.struct((F.col("_top") - i).alias("limb"), s.alias("sum")))
    known = F.filter(pieces, lambda p: p["sum"].isNotNull())

    each = sums.withColumn("_parts", known).groupBy(*keys, "_place").agg(
        F.flatten(F.collect_list("_parts")).alias("_parts"), F.sum("_count").alias("_count"), F.sum("_odd").alias("_odd")
    )
    added = _with_nearest(each, "_parts", "_sum")
    found = F.when(F.col("_count") > 0, F.coalesce("_odd", "_sum"))
    wide = added.groupBy(*keys).agg(*[
        made
        for i in range(len(columns))
        for made in (
            F.max(F.when(F.col("_place") == i, found)).alias(f"_sum{i}"),
            F.coalesce(F.max(F.when(F.col("_place") == i, F.col("_count"))), F.lit(0)).alias(f"_count{i}"),
        )
    ])
    return wide.select(
        *[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)],
        *[made for i, c in enumerate(columns) for made in (F.col(f"_sum{i}").alias(f"sum_{c}"), F.col(f"_count{i}").alias(f"count_{c}"))],
    )


def exact_means(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and ``<c>``: the exact sum of every column over its count, NULL without values."""
    sums = exact_sums(df, columns, by)
    mean = lambda c: F.try_divide(quoted(f"sum_{c}"), quoted(f"count_{c}").cast("double")).alias(c)
    return sums.select(*[quoted(c) for c in by], *[mean(c) for c in columns])


def one_row(df: DataFrame) -> Column:
    """The single row of ``df`` as a struct; however often it is used in a plan, it is computed once."""
    return df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row")).scalar()


def exact_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``mean_<c>`` and ``stddev_<c>`` (of a sample, NULL for fewer than two values) of every column.

    The sum of squares is that of the distances from the mean, each distance and each square rounded as a double and all squares summed exactly. So this reads the
    columns twice, and values far from zero lose nothing.
    """
    means = exact_means(df, columns)
    around = df.select(*[quoted(c).cast("double").alias(c) for c in columns]).withColumn("_means", one_row(means))
    away = {c: quoted(c) - F.col("_means")[c] for c in columns}
    squares = exact_sums(around.select(*[(away[c] * away[c]).alias(c) for c in columns]), columns)
    spread = lambda c: F.when(
        quoted(f"count_{c}") > 1, F.sqrt(quoted(f"sum_{c}") / (quoted(f"count_{c}") - 1).cast("double"))
    )
    return squares.withColumn("_means", one_row(means)).select(
        *[F.col("_means")[c].alias(f"mean_{c}") for c in columns], *[spread(c).alias(f"stddev_{c}") for c in columns]
    )
