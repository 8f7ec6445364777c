"""Results that a rerun replaces and a failed run leaves alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from podium.sources.sinks import write_parquet

Write = Callable[[DataFrame, str], None]


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def publish(df: DataFrame, path: str, write: Write = write_parquet) -> None:
    """Replace the whole result at ``path``: write beside it, then put the new folder in its place.

    ``write`` is any writer of a folder, such as ``write_csv``. Until all rows are written the old result stays readable, and it stays for good if the run fails. ``df`` may
    read the very folder that it replaces. Between two renames there is a moment without a result; if the second fails the old one is put back.
    """
    spark = df.sparkSession
    fs, target = _file_system(spark, path.rstrip("/"))
    parent, name = target.getParent(), target.getName()
    at = lambda kind: spark._jvm.org.apache.hadoop.fs.Path(parent, f".{name}-{kind}-{uuid.uuid4().hex}")
    new, old = at("new"), at("old")
    try:
        write(df, str(new.toString()))
        had = fs.exists(target)
        if had and not fs.rename(target, old):
            raise OSError(f"{path} can't be replaced")
        if not fs.rename(new, target):
            if had:
                fs.rename(old, target)
            raise OSError(f"{path} can't be put in place")
        if had:
            fs.delete(old, True)
    finally:
        if fs.exists(new):
            fs.delete(new, True)


def publish_partitions(df: DataFrame, path: str, partition_by: Sequence[str], *, fmt: str = "parquet", **options: object) -> None:
    """Replace the folders of those partition values that ``df`` has rows for; all others stay as they are.

    A rerun of one year replaces that year and adds nothing twice. Rows are first rebalanced on the partition columns, so one value's rows are written by as many tasks as
    they need. Spark writes beside the old folders and puts the new ones in place when all tasks are done, so a failed run leaves the old result. A value without rows is
    not touched: it can't be told from one that was not meant.
    """
    dealt = df.hint("rebalance", *partition_by)
    writer = dealt.write.mode("overwrite").format(fmt).options(partitionOverwriteMode="dynamic", **options)
    writer.partitionBy(*partition_by).save(path)
