"""Types of text columns, found by one aggregation, with the evidence for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podium.functions.predicates import quoted

# From narrow to wide; a column has the first type that all its values fit, and text fits everything.
_WHOLE = r"^[+-]?\d+$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(NaN|[+-]?Infinity|[+-]?Inf)$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"
_ZONED = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
TYPES = ["int", "bigint", "decimal", "double", "date", "timestamp_ntz", "timestamp", "boolean"]
LONGEST = 38  # digits of a decimal


def _fits(text: Column) -> dict[str, Column]:
    """Whether a text that is not NULL is a value of each type."""
    whole = text.rlike(_WHOLE)
    digits = F.length(F.regexp_replace(text, r"^[+-]?0*", ""))
    return {
        "int": whole & text.try_cast("int").isNotNull(),
        "bigint": whole & text.try_cast("bigint").isNotNull(),
        "decimal": whole & (digits <= LONGEST),
        "double": text.rlike(_NUMBER),
        "date": text.rlike(_DATE) & text.try_cast("date").isNotNull(),
        "timestamp_ntz": text.rlike(_TIME) & text.try_cast("timestamp_ntz").isNotNull(),
        "timestamp": text.rlike(_ZONED) & text.try_cast("timestamp").isNotNull(),
        "boolean": F.lower(text).isin("true", "false"),
    }


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, *, missing: Sequence[str] = ("",)) -> DataFrame:
    """``column_name, position, data_type, non_null, misfits, example`` for every text column, from one scan and one aggregation.

    ``misfits`` says for each type how many values it does not hold, ``example`` the smallest value that keeps the column from the type that fits most values
    without fitting all (NULL if there is none): the value to look at when a column of numbers comes out as text. NULLs and the texts
    ``missing`` are no values; a column without values is text. Whole numbers beyond 64 bits are decimals; one number with a point makes a column double. Types
    are those of Spark's own inference on clean files; dates and times are ISO.
    """
    names = list(columns or df.columns)
    aggregates = []
    for i, c in enumerate(names):
        text = quoted(c).cast("string")
        value = F.when(~text.isin(*missing), text) if missing else text
        fits = _fits(value)
        aggregates += [
            F.count(value).alias(f"_n{i}"),
            F.max(F.length(F.regexp_replace(F.when(fits["decimal"], value), r"^[+-]?0*", ""))).alias(f"_digits{i}"),
            *[F.count_if(value.isNotNull() & ~fits[t]).alias(f"_{t}{i}") for t in TYPES],
            *[F.min(F.when(value.isNotNull() & ~fits[t], value)).alias(f"_bad_{t}{i}") for t in TYPES],
        ]
    wide = df.agg(*aggregates)

    def entry(i: int, c: str) -> Column:
        misfits = {t: F.col(f"_{t}{i}") for t in TYPES}
        chosen = F.lit("string")
        for t in reversed(TYPES):
            name = F.lit(t)
            if t == "decimal":
                name = F.concat(F.lit("decimal("), F.greatest(F.col(f"_digits{i}"), F.lit(20)).cast("string"), F.lit(",0)"))
            chosen = F.when(misfits[t] == 0, name).otherwise(chosen)
        nearly = F.array_min(F.array(*[
            F.struct(misfits[t].alias("n"), F.lit(place).alias("place"), F.col(f"_bad_{t}{i}").alias("value")) for place, t in enumerate(TYPES)
        ]))
        text = F.col(f"_n{i}") == 0
        held = (nearly["n"] > 0) & (nearly["n"] < F.col(f"_n{i}"))
        return F.struct(
            F.lit(c).alias("column_name"),
            F.lit(i + 1).alias("position"),
            F.when(text, F.lit("string")).otherwise(chosen).alias("data_type"),
            F.col(f"_n{i}").alias("non_null"),
            F.create_map(*[part for t in TYPES for part in (F.lit(t), misfits[t])]).alias("misfits"),
            F.when(held, nearly["value"]).alias("example"),
        )

    return wide.select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(names)])))


def schema_of(evidence: DataFrame) -> T.StructType:
    """The schema that :func:`infer_types` found; one row a column reaches the driver."""
    rows = evidence.select("column_name", "position", "data_type").orderBy("position").collect()
    return T.StructType([T.StructField(r["column_name"], T._parse_datatype_string(r["data_type"])) for r in rows])
