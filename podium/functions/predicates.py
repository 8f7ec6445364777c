"""Row predicates. All of them stay native, so Spark can push them to the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = "NA"


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> Column:
    """The column of that very name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_present(c: str | Column, sentinel: str = SENTINEL) -> Column:
    """True when ``c`` holds a value: neither NULL nor the missing-value text.

    The cast keeps numeric columns legal under ANSI mode; on text columns the
    optimizer removes it, so the comparison still reaches the scan.
    """
    c = as_column(c)
    return c.isNotNull() & (c.cast("string") != F.lit(sentinel))


def is_missing(c: str | Column, sentinel: str = SENTINEL) -> Column:
    """Opposite of :func:`is_present`; never NULL."""
    c = as_column(c)
    return c.isNull() | (c.cast("string") == F.lit(sentinel))


def is_sentinel(c: str | Column, sentinel: str = SENTINEL) -> Column:
    """True when ``c`` holds exactly the missing-value text; never NULL."""
    return as_column(c).cast("string").eqNullSafe(F.lit(sentinel))


def in_scope(text: str | Column, part: str, period: str | Column, first_period: int) -> Column:
    """``text`` contains ``part`` and ``period`` is not before ``first_period``."""
    return as_column(text).contains(part) & (as_column(period) >= F.lit(first_period))


def violates_format(c: str | Column, pattern: str, include_null: bool = False) -> Column:
    """True when no part of ``c`` matches ``pattern``, or only an empty part.

    A NULL is unknown and not reported unless ``include_null`` is set.
    """
    c = as_column(c)
    wrong = F.regexp_extract(c, pattern, 0) == ""
    return (c.isNull() | wrong) if include_null else wrong
