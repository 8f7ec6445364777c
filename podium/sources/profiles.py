"""Profiles kept per input file: only files not seen before are read, and the states of all are merged."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions.predicates import quoted

LG_K = 12  # sketches of 2 ** 12 registers: a standard error of 1.6 %

FILE = ["file", "modified", "bytes"]
STATE = (
    "file string, modified timestamp, bytes long, column_name string, row_count long, non_null long, "
    "min_number double, max_number double, min_text string, max_text string, min_time timestamp_ntz, max_time timestamp_ntz, sketch binary"
)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _named() -> list[Column]:
    hidden = ("file_path", "file_modification_time", "file_size")
    return [F.col(f"_metadata.{c}").alias(name) for c, name in zip(hidden, FILE, strict=True)]


def _sketched(field: T.StructField) -> Column:
    """What a distinct sketch counts: whole numbers and text as they are, other types by their text."""
    value = quoted(field.name)
    if isinstance(field.dataType, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
        return value
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0.0)  # -0.0 is 0.0
    return value.cast("string")


def file_states(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per input file and column: counts, smallest and largest value, and a sketch of distinct values.

    ``df`` reads files and has their hidden ``_metadata``. Each file's rows are combined in the tasks that read it, so a row per task,
    file and column is shuffled. Columns of other types than numbers, text, dates, times and booleans have counts alone.
    """
    fields = [f for f in df.schema if columns is None or f.name in columns]

    def entry(i: int, field: T.StructField) -> Column:
        kind, low, high = field.dataType, F.col(f"_low{i}"), F.col(f"_high{i}")
        of = lambda kinds, value, to: (value if isinstance(kind, kinds) else F.lit(None)).cast(to)
        return F.struct(
            F.lit(field.name).alias("column_name"), F.col("_rows").alias("row_count"), F.col(f"_known{i}").alias("non_null"),
            of(T.NumericType, low, "double").alias("min_number"), of(T.NumericType, high, "double").alias("max_number"),
            of(T.StringType, low, "string").alias("min_text"), of(T.StringType, high, "string").alias("max_text"),
            of(_TIMES, low, "timestamp_ntz").alias("min_time"), of(_TIMES, high, "timestamp_ntz").alias("max_time"),
            F.col(f"_sketch{i}").alias("sketch"),
        )

    def ends(field: T.StructField) -> tuple[Column, Column]:
        if isinstance(field.dataType, (T.NumericType, T.StringType, *_TIMES)):
            return F.min(quoted(field.name)), F.max(quoted(field.name))
        return F.lit(None), F.lit(None)

    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    aggregates = []
    for i, field in enumerate(fields):
        low, high = ends(field)
        sketch = F.lit(None).cast("binary") if isinstance(field.dataType, nested) else F.hll_sketch_agg(_sketched(field), LG_K)
        aggregates += [F.count(quoted(field.name)).alias(f"_known{i}"), low.alias(f"_low{i}"), high.alias(f"_high{i}"), sketch.alias(f"_sketch{i}")]
    wide = df.groupBy(*_named()).agg(F.count(F.lit(1)).alias("_rows"), *aggregates)
    return wide.select(*FILE, F.inline(F.array(*[entry(i, f) for i, f in enumerate(fields)])))


def merged_profile(states: DataFrame) -> DataFrame:
    """One row per column from the states of any files: rows, values, NULLs, ends, and about how many different values."""
    ends = [f(f"{end}_{c}").alias(f"{end}_{c}") for c in ("number", "text", "time") for end, f in (("min", F.min), ("max", F.max))]
    return states.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("non_null").alias("non_null"),
        (F.sum("row_count") - F.sum("non_null")).alias("nulls"),
        *ends,
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_distinct"),
    )


def listed_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """``file, modified, bytes`` of the files below a folder, as their states name them, and ``path`` to load them by; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(*_named(), "path")


def refresh_profile(
    spark: SparkSession, path: str, states_path: str, *, schema: T.StructType | str, fmt: str = "parquet", columns: Sequence[str] | None = None,
    pattern: str = "*.parquet",
) -> tuple[DataFrame, list[str]]:
    """The profile of all files below ``path`` now, and the files that had to be read for it.

    ``states_path`` keeps a state per file, known by path, time and size. Files without one are read and their states added; files that are gone, or were replaced, no
    longer count. A run that fails leaves at most states of files that are as they say. Listing is metadata: a row per file.
    """
    present = listed_files(spark, path, pattern)
    try:
        states = spark.read.schema(STATE).parquet(states_path)
    except AnalysisException:
        states = spark.createDataFrame([], STATE)  # the first run
    seen = states.select(*FILE).distinct()
    same = reduce(Column.__and__, [present[c] == seen[c] for c in FILE])
    new = [r["path"] for r in present.join(seen, same, "left_anti").select("path").collect()]
    if new:
        read = spark.read.format(fmt).schema(schema).load(new)
        file_states(read, columns).write.mode("append").parquet(states_path)
        states = spark.read.schema(STATE).parquet(states_path)
    # A state written twice, by runs at the same time, counts once.
    current = states.dropDuplicates(["file", "modified", "bytes", "column_name"])
    same = reduce(Column.__and__, [current[c] == present[c] for c in FILE])
    return merged_profile(current.join(present, same, "left_semi")), new
