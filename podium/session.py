"""Session for jobs and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str, *, master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """Session with the given settings on top of the cluster's; ``master`` is for local runs.

    No tuning is forced on a cluster. The operators rely on Spark's defaults:
    adaptive execution sizes the shuffles and splits hot keys of large joins.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
