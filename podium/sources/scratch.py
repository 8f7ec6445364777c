"""Where intermediate tables go."""

from __future__ import annotations

import re
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one below the warehouse if unset."""
    shared = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR)
    return (shared or f"{spark.conf.get(WAREHOUSE_DIR).rstrip('/')}/scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path not used before, below the shared folder.

    What is written there stays until its user removes it, as frames that read
    it may still be evaluated later.
    """
    warn_if_local(spark)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def warn_if_local(spark: SparkSession) -> None:
    """Say so when executors on other machines would not see the folder, as nothing is set and the warehouse is on the driver's own disk."""
    remote = not getattr(spark.sparkContext, "master", "local").startswith("local")
    unset = not (spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR))
    if remote and unset and shared_dir(spark).startswith(("file:", "/")):
        warnings.warn(f"set {SHARED_DIR}: {shared_dir(spark)} may lie on the driver's machine alone", stacklevel=3)


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a frame to the shared folder as parquet and read it back.

    This cuts the lineage: what is lost with an executor is read again, not
    computed again, and a frame used several times is computed once. ``folder`` is a
    run's own, from :func:`scratch_path`, for :func:`clear`.
    """
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, folder: str) -> None:
    """Remove one folder made by :func:`scratch_path`, when nothing reads it any more; any other path is an error."""
    inside = folder.removeprefix(f"{shared_dir(spark)}/")
    if inside == folder or not re.fullmatch(r"[^/]+-[0-9a-f]{32}", inside):
        raise ValueError(f"{folder!r} is no folder of this session's shared folder")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
