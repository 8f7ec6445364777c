"""Lookup tables of known small size, and the country-code file."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions.predicates import quoted
from podium.sources.readers import read_csv_typed

CODE_SCHEMA = "NOC string, region string, notes string"


def dimension(
    spark: SparkSession,
    entries: Mapping,
    key: str,
    value: str,
    key_type: str | None = None,
    value_type: str | None = None,
) -> DataFrame:
    """A two-column table from a mapping written in the program.

    Types are those of the Python values unless given.

    It becomes a local relation, whose exact size Spark knows while planning. A
    join with it is broadcast when that size is within
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled when it is not, so no
    hint is given.
    """
    table = pa.table({key: list(entries.keys()), value: list(entries.values())})
    frame = spark.createDataFrame(table)
    casts = {c: quoted(c).cast(t) for c, t in ((key, key_type), (value, value_type)) if t}
    return frame.withColumns(casts) if casts else frame


def codes(spark: SparkSession, values: Iterable[str]) -> DataFrame:
    """A one-column table ``code`` from values written in the program."""
    return spark.createDataFrame(pa.table({"code": pa.array(list(values), pa.string())}))


def read_code_dimension(spark: SparkSession, path: str) -> DataFrame:
    """The country-code file: code, region and notes.

    Records may end in a bare carriage return. A region written ``NA`` is NULL.
    """
    return read_csv_typed(spark, path, CODE_SCHEMA).withColumn(
        "region", F.when(F.col("region") != "NA", F.col("region"))
    )
