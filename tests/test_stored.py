"""Profiles that grow with their files, sketches, inferred types, published results, pages."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from podium.operators import (
    distinct_rows,
    distinct_sketches,
    infer_types,
    merge_sketches,
    null_profile,
    rollup_pages,
    rollup_text,
    schema_of,
    sketch_estimates,
    standard_error,
)
from podium.sources import (
    file_states,
    merged_profile,
    observed,
    publish,
    publish_partitions,
    read_csv_inferred,
    read_csv_text,
    refresh_profile,
    stage,
    write_csv,
    write_parquet,
)

SCHEMA = "id long, name string, size double, day date, ok boolean, tags array<string>"


def rows(first, n):
    return [(i, None if i % 5 == 0 else f"n{i % 50}", i / 4, None, i % 2 == 0, ["a"]) for i in range(first, first + n)]


def profile_of(frame):
    return {r.column_name: tuple(r)[1:] for r in frame.collect()}


def test_only_new_files_are_read_and_states_merge(spark, tmp_path):
    folder, states = str(tmp_path / "in"), str(tmp_path / "states")
    spark.createDataFrame(rows(0, 100), SCHEMA).coalesce(1).write.parquet(folder)
    first, read = refresh_profile(spark, folder, states, schema=SCHEMA)
    assert len(read) == 1
    spark.createDataFrame(rows(100, 60), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    second, read = refresh_profile(spark, folder, states, schema=SCHEMA)
    assert len(read) == 1 and len(spark.read.parquet(states).select("file").distinct().collect()) == 2
    whole = merged_profile(file_states(spark.read.schema(SCHEMA).parquet(folder)))
    assert profile_of(second) == profile_of(whole)
    assert profile_of(second)["name"][:3] == (160, 128, 32) and profile_of(second)["size"][3:5] == (0.0, 39.75)
    assert profile_of(second)["tags"][:3] == (160, 160, 0)
    nulls = {r.column_name: r.nulls for r in null_profile(spark.read.schema(SCHEMA).parquet(folder)).collect()}
    assert nulls == {c: p[2] for c, p in profile_of(second).items()}
    _, read = refresh_profile(spark, folder, states, schema=SCHEMA)
    assert read == []


def test_folders_of_odd_names(spark, tmp_path):
    folder, states = str(tmp_path / "in put"), str(tmp_path / "sta tes")
    frame = spark.createDataFrame(rows(0, 40), SCHEMA).withColumn("part", F.concat(F.lit("a b%"), F.col("id") % 2))
    frame.write.partitionBy("part").parquet(folder)
    for new in (True, False):
        profile, read = refresh_profile(spark, folder, states, schema=SCHEMA)
        assert (len(read) > 0) is new and profile_of(profile)["id"][0] == 40


def test_replaced_and_removed_files_count_no_more(spark, tmp_path):
    folder, states = str(tmp_path / "in"), str(tmp_path / "states")
    frame = spark.createDataFrame(rows(0, 100), SCHEMA)
    frame.repartition(2).write.parquet(folder)
    refresh_profile(spark, folder, states, schema=SCHEMA)
    gone = sorted(f for f in os.listdir(folder) if f.startswith("part"))[0]
    left = spark.read.schema(SCHEMA).parquet(folder).filter(~F.input_file_name().endswith(gone)).count()
    os.remove(f"{folder}/{gone}")
    profile, read = refresh_profile(spark, folder, states, schema=SCHEMA)
    assert read == [] and profile_of(profile)["id"][0] == left
    frame.limit(10).coalesce(1).write.mode("overwrite").parquet(folder)
    profile, read = refresh_profile(spark, folder, states, schema=SCHEMA)
    assert len(read) == 1 and profile_of(profile)["id"][0] == 10


def test_counts_are_taken_by_the_job_that_writes(spark, tmp_path):
    frame = spark.createDataFrame(rows(0, 100), SCHEMA).drop("tags").repartition(5)
    watched, counts = observed(frame, {"even": F.col("ok")})
    write_parquet(watched, str(tmp_path / "out"))
    got = counts()
    assert got["rows"] == 100 and got["where"] == {"even": 50}
    assert got["nulls"] == {r.column_name: r.nulls for r in null_profile(spark.read.parquet(str(tmp_path / "out"))).collect()}


def test_digests_count_as_distinct_does(spark):
    draw = random.Random(2)
    values = [None, "a", "", "ab"]
    table = spark.createDataFrame(
        [(draw.choice(values), draw.choice(values), draw.choice([0.0, -0.0, float("nan"), 1.0, None]), draw.choice([None, 1])) for _ in range(3000)],
        "a string, b string, x double, n int",
    )
    assert distinct_rows(table).first()[0] == table.distinct().count()
    by = {r.n: r.distinct_rows for r in distinct_rows(table, ["n"]).collect()}
    assert by == {r.n: r["count"] for r in table.distinct().groupBy("n").count().collect()}
    assert distinct_rows(table.filter("false")).first()[0] == 0
    plan = distinct_rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    exchange = plan.split("Exchange")[1]
    assert "text" not in exchange.split("\n")[0]


def test_sketches_are_near_and_merge(spark):
    table = spark.range(60_000).select((F.col("id") % 20_000).alias("a"), (F.col("id") % 7).alias("part"), F.lit(None).cast("string").alias("none"), (F.col("id") / 3).alias("x"))
    kept = distinct_sketches(table, ["a", "none", "x"], ["part"])
    got = {r.column_name: r.approx_distinct for r in sketch_estimates(merge_sketches(kept)).collect()}
    assert got["none"] == 0
    for column, true in (("a", 20_000), ("x", 60_000)):
        assert abs(got[column] - true) <= 4 * standard_error() * true
    twice = merge_sketches(merge_sketches(kept, ["part"]).unionByName(kept), ["part"])
    assert twice.count() == 21
    assert max(len(r.sketch) for r in kept.collect()) <= 2**12 + 64


FILE = {
    "small": (["1", "-2", "+3", ""], "int"),
    "big": (["1", "3000000000", "", "2"], "bigint"),
    "huge": (["1", "12345678901234567890", "2", "3"], "decimal(20,0)"),
    "real": (["1", "2.5", "-1e3", ""], "double"),
    "day": (["2020-01-02", "1999-12-31", "", "2000-02-29"], "date"),
    "moment": (["2020-01-02 03:04:05", "2020-01-02 03:04:05.123", "", "1999-12-31 00:00:00"], "timestamp"),
    "flag": (["true", "FALSE", "True", ""], "boolean"),
    "word": (["a", "1", "2", "3"], "string"),
    "mixed": (["2020-01-02", "1", "", "2"], "string"),
    "nothing": (["", "", "", ""], "string"),
}


def test_types_are_spark_s_own_on_clean_files(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as file:
        file.write(",".join(FILE) + "\n" + "\n".join(",".join(v[0][i] for v in FILE.values()) for i in range(4)) + "\n")
    evidence = infer_types(read_csv_text(spark, path))
    got = {f.name: f.dataType.simpleString() for f in schema_of(evidence)}
    own = {f.name: f.dataType.simpleString() for f in read_csv_inferred(spark, path).schema}
    assert {c: t.replace("timestamp_ntz", "timestamp") for c, t in got.items()} == {c: t for c, (_, t) in FILE.items()}
    assert {c: t.replace("timestamp_ntz", "timestamp") for c, t in got.items()} == {c: t.replace("timestamp_ntz", "timestamp") for c, t in own.items()}


def test_evidence_for_a_type_that_was_spoilt(spark):
    table = spark.createDataFrame([("1", "x"), ("NA", "y"), ("2", None), ("30000000000", "")], "n string, t string")
    found = {r.column_name: r for r in infer_types(table).collect()}
    n = found["n"]
    assert (n.data_type, n.non_null, n.example) == ("string", 4, "NA")
    assert (n.misfits["int"], n.misfits["bigint"], n.misfits["boolean"]) == (2, 1, 4)
    assert (found["t"].non_null, found["t"].example) == (2, None)
    cleaned = {r.column_name: r.data_type for r in infer_types(table, missing=["", "NA"]).collect()}
    assert cleaned["n"] == "bigint"
    assert [r.data_type for r in infer_types(table.filter("false")).collect()] == ["string", "string"]
    plan = infer_types(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def failing(frame):
    return frame.withColumn("n", F.when(F.col("n") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("n")))


def test_a_failed_run_leaves_the_old_result(spark, tmp_path):
    whole, years = str(tmp_path / "whole"), str(tmp_path / "years")
    frame = spark.createDataFrame([(1956, 1), (1956, 2), (1960, 3)], "y int, n int")
    publish(frame, whole)
    publish_partitions(frame, years, ["y"])
    for act in (lambda: publish(failing(frame), whole), lambda: publish_partitions(failing(frame), years, ["y"])):
        with pytest.raises(Exception, match="broken"):
            act()
    for path in (whole, years):
        assert {tuple(r) for r in spark.read.parquet(path).select("y", "n").collect()} == {(1956, 1), (1956, 2), (1960, 3)}
    assert os.listdir(tmp_path / "whole") and [f for f in os.listdir(tmp_path) if f.startswith(".whole")] == []


def test_reruns_replace(spark, tmp_path):
    whole, years = str(tmp_path / "whole"), str(tmp_path / "years")
    frame = spark.createDataFrame([(1956, 1), (1956, 2), (1960, 3)], "y int, n int")
    for _ in range(2):
        publish_partitions(frame, years, ["y"])
    publish_partitions(spark.createDataFrame([(1960, 4), (1964, 5)], "y int, n int"), years, ["y"])
    assert sorted(tuple(r) for r in spark.read.parquet(years).select("y", "n").collect()) == [(1956, 1), (1956, 2), (1960, 4), (1964, 5)]
    publish(frame, whole, write=write_csv)
    publish(read_csv_text(spark, whole).filter("n > 1"), whole, write=write_csv)  # reads what it replaces
    assert read_csv_text(spark, whole).count() == 2
    assert os.listdir(tmp_path) and not [f for f in os.listdir(tmp_path) if f.startswith(".")]


@pytest.mark.parametrize("chars", [1, 40, 10_000])
def test_pages_make_up_the_text(spark, chars):
    draw = random.Random(chars)
    rows = [("hot" if i % 3 else draw.choice(["a", None]), i, "x" * draw.randint(0, 9)) for i in range(900)]
    table = spark.createDataFrame(rows, "g string, i int, t string").repartition(5)
    pages = rollup_pages(table, ["g"], ["i"], ["i", "t"], "text", page_chars=chars, stage=stage)
    whole = {r.g: r.text for r in rollup_text(table, ["g"], ["i"], ["i", "t"], "text").collect()}
    got: dict = {}
    for r in sorted(pages.collect(), key=lambda r: r.page):
        got.setdefault(r.g, []).append(r.text)
        assert len(r.text) < chars + 16
    assert {g: ", ".join(parts) for g, parts in got.items()} == whole
    assert rollup_pages(table.filter("false"), ["g"], ["i"], ["i", "t"], "text", stage=stage).collect() == []
