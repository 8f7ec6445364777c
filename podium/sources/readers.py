"""Readers. Paths may be any URI the cluster's Hadoop file systems resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What ends a record and what stands for NULL in files written with ``exact=True``.
EXACT_LINE_SEP = "\x1e"
EXACT_NULL = "\\N"


def csv_options(
    sep: str = ",",
    encoding: str = "UTF-8",
    null_value: str | None = None,
    *,
    line_sep: str | None = None,
    exact: bool = False,
) -> dict:
    """Options shared by all CSV readers and writers.

    A quote inside a quoted field is written twice. Without this escape a field
    such as ``"Al ""Bob"", Jr."`` would break apart and shift its whole row.
    Blanks at the ends of a value belong to it.

    ``exact`` is for files that this package writes and reads again: a control
    character ends records, so line breaks inside a text do not, and NULL has a
    mark of its own, so it is not the empty text.
    """
    options = {
        "header": True,
        "sep": sep,
        "encoding": encoding,
        "quote": '"',
        "escape": '"',
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    if exact:
        line_sep, null_value = line_sep or EXACT_LINE_SEP, EXACT_NULL if null_value is None else null_value
    if line_sep is not None:
        options["lineSep"] = line_sep
    if null_value is not None:
        options["nullValue"] = null_value
    return options


def read_csv_typed(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    *,
    sep: str = ",",
    encoding: str = "UTF-8",
    null_value: str | None = None,
    line_sep: str | None = None,
    multi_line: bool = False,
    exact: bool = False,
) -> DataFrame:
    """CSV with a known schema, the form for large inputs: one pass, no inference.

    With ``null_value="NA"`` that text is NULL in every column. Without it the
    text stays as it is in text columns and is NULL in numeric ones.

    ``multi_line`` reads foreign files with line breaks inside quoted fields; such
    a file can't be split, so each is read by one task.
    """
    options = csv_options(sep, encoding, null_value, line_sep=line_sep, exact=exact)
    return spark.read.schema(schema).options(multiLine=multi_line, **options).csv(path)


def infer_csv_schema(
    spark: SparkSession,
    path: str | list[str],
    *,
    sep: str = ",",
    encoding: str = "UTF-8",
    null_value: str | None = None,
) -> T.StructType:
    """The schema that fits every value of the file; reads all of it once."""
    options = csv_options(sep, encoding, null_value)
    return spark.read.options(inferSchema=True, **options).csv(path).schema


def read_csv_inferred(
    spark: SparkSession,
    path: str | list[str],
    *,
    sep: str = ",",
    encoding: str = "UTF-8",
    null_value: str | None = None,
) -> DataFrame:
    """CSV with inferred types. To read it again, keep the schema and use the typed reader."""
    options = csv_options(sep, encoding, null_value)
    return spark.read.options(inferSchema=True, **options).csv(path)


def read_csv_text(
    spark: SparkSession,
    path: str | list[str],
    *,
    sep: str = ",",
    encoding: str = "UTF-8",
    line_sep: str | None = None,
    exact: bool = False,
) -> DataFrame:
    """CSV with a header, every column as text."""
    return spark.read.options(**csv_options(sep, encoding, line_sep=line_sep, exact=exact)).csv(path)


def read_format(
    spark: SparkSession, path: str, fmt: str, *, schema: T.StructType | str | None = None, **options: object
) -> DataFrame:
    """Any data source Spark knows by name, built in or added by the user as a package.

    Without ``schema`` most formats read all data once more to infer it, at each call.
    """
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)
