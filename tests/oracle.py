"""Comparing a query's rows with those of its SQL, regardless of order."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# What the two engines call the same type.
SAME_TYPE = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "decimal(10,3)": "DECIMAL(10,3)",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(row[i]) for i in order) for row in rows))


def differences(frame, connection, sql) -> list[str]:
    """What differs between a DataFrame and the SQL, in words; empty when nothing does."""
    answer = connection.execute(sql)
    sql_types = {d[0]: str(d[1]) for d in answer.description}
    expected = answer.fetchall()
    spark_types = dict(frame.dtypes)
    found = []
    if set(sql_types) != set(spark_types):
        return [f"columns {sorted(spark_types)} against {sorted(sql_types)}"]
    for name, kind in spark_types.items():
        if SAME_TYPE.get(kind, kind) != sql_types[name]:
            found.append(f"type of {name}: {kind} against {sql_types[name]}")
    got = _rows(frame.columns, frame.collect())
    want = _rows(list(sql_types), expected)
    if len(got) != len(want):
        found.append(f"{len(got)} rows against {len(want)}")
    if got != want:
        odd = [(g, w) for g, w in zip(got, want) if g != w][:2]
        found.append(f"values, e.g. {odd}")
    return found
