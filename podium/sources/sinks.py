"""Writers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions.predicates import quoted
from podium.sources.readers import csv_options, read_csv_text

# Microseconds are kept; readers need no pattern for them.
_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _unbroken(df: DataFrame, line_sep: str | None, null_value: str | None) -> DataFrame:
    """The same rows; a text that the file could not give back ends the job.

    That is one with a character that ends a record, or one equal to the mark for NULL.
    """
    breaks = [line_sep] if line_sep else ["\r", "\n"]

    def checked(name: str) -> Column:
        text = quoted(name)
        lost = reduce(or_, [text.contains(b) for b in breaks])
        if null_value:
            lost = lost | (text == F.lit(null_value))
        message = F.lit(f"a text in column {name} can't be written to this CSV without loss")
        return F.when(lost, F.raise_error(message)).otherwise(text).alias(name)

    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(*[checked(c) if c in texts else quoted(c) for c in df.columns])


def refuse_existing(spark: SparkSession, paths: Iterable[str]) -> None:
    """An error, as a write with ``mode="errorifexists"`` gives, if any of the paths is there: for jobs with several results, before the first is made."""
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            raise AnalysisException(f"path {path} already exists")


def write_csv(
    df: DataFrame,
    path: str,
    *,
    mode: str = "overwrite",
    sep: str = ",",
    encoding: str = "UTF-8",
    null_value: str | None = None,
    line_sep: str | None = None,
    exact: bool = False,
) -> None:
    """A folder of CSV files with headers. ``mode="errorifexists"`` protects old results.

    With ``exact`` every text comes back as it is, line breaks and empty texts
    too, when read with ``exact``. Without it, for other programs, a line break
    inside a text would end its record, so such a text is an error; an empty text
    and NULL look alike.
    """
    options = csv_options(sep, encoding, null_value, line_sep=line_sep, exact=exact)
    # A mark the caller chose for NULL may also be a value, as in published files; ours may not.
    own_mark = options["nullValue"] if exact else None
    safe = _unbroken(df, options.get("lineSep"), own_mark)
    safe.write.mode(mode).options(**options, **_TIMES).csv(path)


def write_parquet(
    df: DataFrame, path: str, *, mode: str = "overwrite", partition_by: list[str] | None = None
) -> None:
    """A folder of parquet files, optionally one subfolder per partition value.

    Rows are first rebalanced on those values, which merges small shares of one
    value and splits large ones, so files come out of like size.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by or []).parquet(path)


def observed(df: DataFrame, conditions: Mapping[str, Column] | None = None) -> tuple[DataFrame, Callable[[], dict]]:
    """The same rows, counted on their way to wherever an action takes them, and the counts, to be asked for after it.

    Counts are ``rows``, ``nulls`` by column, and ``where``: the rows for which each of ``conditions`` is true. They cost no job of their own. The first action counts;
    it must take all rows (a write does, a preview does not).
    """
    watch = Observation()
    conditions = conditions or {}
    found = [F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    true = [F.count_if(holds).alias(f"c{i}") for i, holds in enumerate(conditions.values())]

    def counts() -> dict:
        got = watch.get
        return {
            "rows": got["rows"],
            "nulls": {c: got[f"n{i}"] for i, c in enumerate(df.columns)},
            "where": {c: got[f"c{i}"] for i, c in enumerate(conditions)},
        }

    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *found, *true), counts


def convert_dialect(
    spark: SparkSession,
    source: str,
    target: str,
    *,
    from_sep: str = ",",
    to_sep: str = ";",
    encoding: str = "UTF-8",
    drop_pattern: str | None = None,
    mode: str = "overwrite",
    line_sep: str | None = None,
    exact: bool = False,
) -> None:
    """Rewrite a CSV with another separator, value texts unchanged.

    Columns whose name matches ``drop_pattern``, such as a saved row index, are left out.
    ``exact`` is for a source written with it, and holds for the target too.
    """
    df = read_csv_text(spark, source, sep=from_sep, encoding=encoding, line_sep=line_sep, exact=exact)
    if drop_pattern is not None:
        df = df.drop(*[c for c in df.columns if re.search(drop_pattern, c)])
    write_csv(df, target, mode=mode, sep=to_sep, encoding=encoding, line_sep=line_sep, exact=exact)


def export_sorted(
    df: DataFrame, path: str, sort: list[str], *, sep: str = ",", mode: str = "overwrite", exact: bool = False
) -> None:
    """Write a result as sorted CSV files, each with a header, whose names follow the sort order.

    Rows are sorted by range in parallel, so any size does; read in the order of their names, the
    files hold the rows in order.
    """
    write_csv(df.orderBy(*sort), path, mode=mode, sep=sep, exact=exact)
