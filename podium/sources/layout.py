"""Tables laid out for repeated analyses: folders by period, hashed buckets by group, rows sorted inside.

Analyses that group or join by the bucket columns need no exchange, and those that name periods read only their folders.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions.predicates import quoted
from podium.sources.scratch import scratch_path

ROWS_PER_FILE = 2_000_000


@dataclass(frozen=True)
class Layout:
    """How a table lies in its folder. ``bucket_by`` are the columns of groups, ``partition_by`` those of folders."""

    bucket_by: tuple[str, ...]
    buckets: int
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.bucket_by or self.buckets < 1:
            raise ValueError("a layout needs bucket columns and at least one bucket")
        if set(self.bucket_by) & set(self.partition_by):
            raise ValueError("a column is either of folders or of buckets")


def buckets_for(rows: int, partitions: int = 1, rows_per_file: int = ROWS_PER_FILE) -> int:
    """A power of two of buckets, so that two layouts of different size still fit each other."""
    needed = max(1, -(-rows // (max(1, partitions) * rows_per_file)))
    return 1 << (needed - 1).bit_length()


def lay_out(df: DataFrame, table: str, layout: Layout, *, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Write ``df`` in this layout and register it under ``table``; returns the table.

    Rows are shuffled once, by bucket, so every bucket of a folder is one file, sorted by bucket columns and ``sort_by``. One key lies in one bucket
    whatever its share of the rows: choose bucket columns of many values, and folders for the few.
    """
    _checked(table)
    path = path or scratch_path(df.sparkSession, table)
    order = [*layout.bucket_by, *[c for c in layout.sort_by if c not in layout.bucket_by]]
    dealt = df.repartition(layout.buckets, *[quoted(c) for c in layout.bucket_by])
    writer = dealt.write.format("parquet").mode(mode).option("path", path).bucketBy(layout.buckets, *layout.bucket_by).sortBy(*order)
    if layout.partition_by:
        writer = writer.partitionBy(*layout.partition_by)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def open_layout(spark: SparkSession, table: str, path: str, schema: T.StructType, layout: Layout) -> DataFrame:
    """Register a folder written by :func:`lay_out` in another session; nothing is read or moved."""
    _checked(table)
    name = lambda c: "`" + c.replace("`", "``") + "`"
    columns = ", ".join(f"{name(f.name)} {f.dataType.simpleString()}" for f in schema)
    order = [*layout.bucket_by, *[c for c in layout.sort_by if c not in layout.bucket_by]]
    parts = f"PARTITIONED BY ({', '.join(map(name, layout.partition_by))})" if layout.partition_by else ""
    buckets = f"CLUSTERED BY ({', '.join(map(name, layout.bucket_by))}) SORTED BY ({', '.join(map(name, order))}) INTO {layout.buckets} BUCKETS"
    quoted_path = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {parts} {buckets} LOCATION '{quoted_path}'")
    if layout.partition_by:
        spark.catalog.recoverPartitions(table)
    return spark.table(table)


def _checked(table: str) -> None:
    if not re.fullmatch(r"\w+(\.\w+)?", table):
        raise ValueError(f"not a table name: {table!r}")


def rows_per_bucket(table: DataFrame, layout: Layout) -> DataFrame:
    """``bucket, row_count``: whether one bucket holds too much, by the hash Spark buckets with."""
    bucket = F.pmod(F.hash(*[quoted(c) for c in layout.bucket_by]), F.lit(layout.buckets)).alias("bucket")
    return table.groupBy(bucket).agg(F.count(F.lit(1)).alias("row_count"))
