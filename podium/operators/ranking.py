"""Top-k, leaders, modal bands and ranked lists as text; ties never depend on row order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from podium.functions.bands import Bands


def top_k(
    df: DataFrame,
    by: list[str],
    measure: str,
    ties: list[str],
    k: int,
    rank: str | None = "rank",
) -> DataFrame:
    """The ``k`` rows with the largest ``measure`` in each group, numbered from 1.

    Equal measures are ordered by ``ties`` ascending; pass enough columns to tell
    all rows of a group apart. Spark cuts every task's share of a group to ``k``
    rows before the shuffle, so a hot group stays small.
    """
    best_first = Window.partitionBy(*by).orderBy(
        F.desc_nulls_last(measure), *[F.asc_nulls_last(t) for t in ties]
    )
    column = rank or "_rank"
    best = df.withColumn(column, F.row_number().over(best_first)).filter(F.col(column) <= k)
    return best if rank else best.drop(column)


def leaders(df: DataFrame, by: list[str], measure: str, ties: list[str]) -> DataFrame:
    """The single best row of each group."""
    return top_k(df, by, measure, ties, 1, rank=None)


def rollup_text(
    df: DataFrame,
    by: list[str],
    order: list[str],
    parts: list[str],
    name: str,
    *,
    within: str = "-",
    between: str = ", ",
) -> DataFrame:
    """One text per group listing its rows in the given order, e.g. ``A-9, B-7``.

    For ranked results: the text of a group is as long as the group, so feed it
    rows already cut by :func:`top_k` or reduced by :func:`leaders`.
    """
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                    F.concat_ws(within, *parts).alias("text"))
    listed = F.array_sort(F.collect_list(item))
    return df.groupBy(*by).agg(
        F.array_join(F.transform(listed, lambda x: x["text"]), between).alias(name)
    )


def modal_bands(
    df: DataFrame,
    group: str,
    bands: dict[str, tuple[Column, Bands]],
    *,
    null_competes: bool = False,
) -> DataFrame:
    """The most frequent band of several values per group, one column per value.

    ``bands`` maps an output column to the value and its bands. Rows outside
    every band count as unknown: by default the unknown wins only when a group
    has no known band at all; with ``null_competes`` it wins when it is the most
    frequent. Equal counts go to the lowest band, and to a known one first.

    One pass: rows are counted by group and combination of band numbers first,
    before the shuffle. Only these counts are laid out by value and summed, and
    the winners come from one more aggregation.
    """
    names = list(bands)
    numbers = [scale.index(value).alias(f"_band{i}") for i, (value, scale) in enumerate(bands.values())]
    together = df.groupBy(group, *numbers).agg(F.count(F.lit(1)).alias("_rows"))
    laid_out = together.select(
        F.col(group),
        "_rows",
        F.inline(
            F.array(*[
                F.struct(F.lit(i).alias("_value"), F.col(f"_band{i}").alias("_band")) for i in range(len(names))
            ])
        ),
    )
    counts = laid_out.groupBy(group, "_value", "_band").agg(F.sum("_rows").alias("_n"))
    return modes_of_counts(counts, group, {name: scale for name, (_, scale) in bands.items()}, null_competes=null_competes)


def modes_of_counts(
    counts: DataFrame, group: str, bands: dict[str, Bands], *, null_competes: bool = False
) -> DataFrame:
    """The winners of :func:`modal_bands` from counts made elsewhere: ``group``, ``_value`` (place in ``bands``), ``_band`` (number), ``_n``."""

    def winner(i: int) -> Column:
        unknown = F.col("_band").isNull().alias("unknown")
        fewest_last = (-F.col("_n")).alias("neg_n")
        order = [fewest_last, unknown] if null_competes else [unknown, fewest_last]
        candidate = F.struct(*order, F.col("_band").alias("band"))
        return F.min(F.when(F.col("_value") == i, candidate))["band"]

    best = counts.groupBy(group).agg(*[winner(i).alias(f"_{name}") for i, name in enumerate(bands)])
    return best.select(group, *[scale.label_of(F.col(f"_{name}")).alias(name) for name, scale in bands.items()])


def rollup_pages(
    df: DataFrame,
    by: list[str],
    order: list[str],
    parts: list[str],
    name: str,
    *,
    page_chars: int = 1 << 20,
    within: str = "-",
    between: str = ", ",
    stage: Callable[[DataFrame, str], DataFrame],
) -> DataFrame:
    """:func:`rollup_text` for groups of any size: ``by, page, <name>``, in pages of about ``page_chars`` characters.

    The texts of a group's pages, put together with ``between`` by rising page, are the whole text. A page holds the items that begin within its share of the
    text, so it is longer by one item at most; after an item longer than a page, numbers may be missing.

    Rows are dealt out by ranges of ``by`` and ``order``, so a group is spread over many tasks. Each range adds up its lengths, the sums of the ranges before it (a few numbers
    a range) say where it begins, and the rows then know their page. ``order`` should tell all rows of a group apart. ``stage`` keeps the dealt rows, such as
    ``scratch.stage``: ranges must not change between the two readings.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    places = [f"_o{i}" for i in range(len(order))]
    rows = df.select(
        *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)],
        *[F.col(c).alias(k) for c, k in zip(order, places, strict=True)],
        F.concat_ws(within, *parts).alias("_text"),
    ).withColumn("_size", F.length("_text") + len(between))
    dealt = rows.repartitionByRange(*keys, *places).withColumn("_range", F.spark_partition_id())
    dealt = stage(dealt, "pages")

    sizes = dealt.groupBy(*keys, "_range").agg(F.sum("_size").alias("_whole"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"_of{k}") for k in keys], F.col("_range").alias("_of_range"), F.coalesce(F.sum("_whole").over(before), F.lit(0)).alias("_start")
    )
    same = F.col("_range") == F.col("_of_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of{k}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*places, "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_upto", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(starts, same)
    page = F.floor((F.col("_start") + F.col("_upto")) / F.lit(page_chars)) + 1
    item = F.struct(*[F.col(o) for o in places], F.col("_text"))
    listed = F.array_sort(F.collect_list(item))
    return placed.groupBy(*keys, page.alias("page")).agg(
        F.array_join(F.transform(listed, lambda x: x["_text"]), between).alias(name)
    ).select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "page", name)
