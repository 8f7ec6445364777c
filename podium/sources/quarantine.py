"""Reading CSV with a quarantine: records that do not fit go to a side output of the same scan, with file and reason."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions.predicates import SENTINEL, quoted
from podium.sources.readers import csv_options
from podium.sources.scratch import scratch_path

FILE, RECORD, REASONS = "file", "record", "reasons"


class Checked(NamedTuple):
    """The records that fit, with their types, and those that do not: ``file, record, reasons``."""

    rows: DataFrame
    rejected: DataFrame


def _free(name: str, taken: set[str]) -> str:
    while name.lower() in taken:
        name = f"_{name}"
    taken.add(name.lower())
    return name


def checked_records(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    *,
    sep: str = ",",
    encoding: str = "UTF-8",
    null_value: str | None = None,
    line_sep: str | None = None,
    missing: str | None = SENTINEL,
    checks: Mapping[str, Column] | None = None,
    exact: bool = False,
    header: bool = True,
) -> tuple[DataFrame, dict[str, str]]:
    """Every record of the files with its verdict, as one scan; and the names of the columns added to those of ``schema``.

    All fields are read as text, so nothing is lost to a type. Then, in the same projection, ``reasons`` is the list of what is wrong:

    * ``fields``: more or fewer fields than columns. A quote that the writer did not double shifts a record and shows here.
    * ``type of <column>``: a text that is no value of the column's type. The text ``missing`` is a missing value and fits every type; in text
      columns it stays as it is, as in :func:`read_csv_typed`.
    * the name of each of ``checks`` whose condition on the typed columns is false; unknown is no fault.

    ``reasons`` is NULL for records that fit. ``record`` is the text of a record that does not: as in the file if its fields are too
    many or too few, written again from its fields otherwise. Spark's parser drops blank lines. ``header`` says whether each file starts with one.
    """
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    taken = {f.name.lower() for f in typed}
    names = {n: _free(n, taken) for n in (FILE, RECORD, REASONS)}
    broken = _free("broken", taken)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in typed] + [T.StructField(broken, T.StringType())])
    options = csv_options(sep, encoding, null_value, line_sep=line_sep, exact=exact) | {"header": header}
    # The count of fields shows only if all of them are parsed.
    read = spark.read.schema(texts).options(mode="PERMISSIVE", columnNameOfCorruptRecord=broken, **options).csv(path)

    def value(field: T.StructField) -> Column:
        text = quoted(field.name)
        if isinstance(field.dataType, T.StringType):
            return text
        if missing is not None:
            text = F.when(text != F.lit(missing), text)
        return text.try_cast(field.dataType)

    def misfit(field: T.StructField) -> Column:
        text = quoted(field.name)
        known = text.isNotNull() if missing is None else text.isNotNull() & (text != F.lit(missing))
        return known & value(field).isNull()

    whole = quoted(broken).isNull()
    misfits = {f.name: misfit(f) for f in typed if not isinstance(f.dataType, T.StringType)}
    faults = [F.when(~whole, F.lit("fields"))] + [F.when(whole & wrong, F.lit(f"type of {n}")) for n, wrong in misfits.items()]
    # Nearly all records fit: lists are made, and with no checks records written again, only for those that do not.
    faulty = F.coalesce(reduce(or_, misfits.values(), ~whole), F.lit(False))
    none = F.array().cast("array<string>")
    record = F.coalesce(quoted(broken), F.to_csv(F.struct(*[quoted(f.name) for f in typed]), _text_options(options)))
    # What a condition sees are typed values, so they are there before it.
    values = {f.name: _free(f"value{i}", taken) for i, f in enumerate(typed)}
    prepared = read.select(
        F.col("_metadata.file_path").alias(names[FILE]),
        (record if checks else F.when(faulty, record)).alias(names[RECORD]),
        whole.alias(broken),
        F.when(faulty, F.array_compact(F.array(*faults))).otherwise(none).alias(names[REASONS]),
        *[value(f).alias(values[f.name]) for f in typed],
    ).withColumnsRenamed({v: n for n, v in values.items()})
    for name, holds in (checks or {}).items():
        bad = F.when(quoted(broken) & ~F.coalesce(holds, F.lit(True)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
        prepared = prepared.withColumn(names[REASONS], F.concat(quoted(names[REASONS]), bad))
    reasons = quoted(names[REASONS])
    rejected = F.size(reasons) > 0
    return prepared.select(
        *[quoted(f.name) for f in typed],
        quoted(names[FILE]),
        F.when(rejected, quoted(names[RECORD])).alias(names[RECORD]),
        F.when(rejected, reasons).alias(names[REASONS]),
    ), names


def _text_options(options: Mapping[str, object]) -> dict[str, str]:
    kept = {k: options[k] for k in ("sep", "quote", "escape", "nullValue") if k in options}
    return kept | {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv_checked(spark: SparkSession, path: str | list[str], schema: T.StructType | str, *, target: str | None = None, **options) -> Checked:
    """Parse the files once; records that fit and records that do not are written side by side and read back as two tables.

    ``options`` are those of :func:`checked_records`. Both outputs lie in one parquet folder, ``target`` or one in the shared folder, apart by a
    partition column: reading one does not touch the other. No row is lost: their counts add up to the records of the files.
    """
    records, names = checked_records(spark, path, schema, **options)
    split = _free("rejected", {c.lower() for c in records.columns})
    target = target or scratch_path(spark, "checked")
    broken = quoted(names[REASONS]).isNotNull()
    marked = records.withColumns({split: broken, names[FILE]: F.when(broken, quoted(names[FILE]))})  # only rejected records are read with their file
    marked.write.partitionBy(split).parquet(target)
    both = spark.read.schema(marked.schema).parquet(target)
    fields = [c for c in records.columns if c not in names.values()]
    good = both.filter(~quoted(split)).select(*[quoted(c) for c in fields])
    bad = both.filter(quoted(split)).select(*[quoted(names[n]).alias(n) for n in (FILE, RECORD, REASONS)])
    return Checked(good, bad)


def checked_frames(spark: SparkSession, path: str | list[str], schema: T.StructType | str, **options) -> Checked:
    """As :func:`read_csv_checked`, but nothing is stored: each use of either table parses the files again."""
    records, names = checked_records(spark, path, schema, **options)
    fits = quoted(names[REASONS]).isNull()
    fields = [quoted(c) for c in records.columns if c not in names.values()]
    return Checked(records.filter(fits).select(*fields), records.filter(~fits).select(*[quoted(names[n]).alias(n) for n in (FILE, RECORD, REASONS)]))


def reject_report(rejected: DataFrame) -> DataFrame:
    """``reason, rejected_rows`` for every reason met; a record with several counts for each."""
    return rejected.select(F.explode(REASONS).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rejected_rows"))
