"""Laid-out tables: analyses without exchange, folders that are not read, layouts opened again."""

from __future__ import annotations

import re
import uuid

import pytest
from pyspark.sql import functions as F

from podium.operators import growth, tally, top_k
from podium.sources import Layout, buckets_for, lay_out, open_layout, rows_per_bucket

BY_NATION = Layout(bucket_by=("noc",), buckets=4, partition_by=("year",), sort_by=("sport",))


@pytest.fixture
def entries(spark):
    columns = [(F.col("id") % 9).cast("string").alias("noc"), (F.col("id") % 5).cast("string").alias("sport"), (1956 + F.col("id") % 4 * 4).cast("int").alias("year"), "id"]
    return spark.range(2000).select(*columns)


@pytest.fixture
def table(spark, entries):
    name = f"t_{uuid.uuid4().hex}"
    yield lay_out(entries, name, BY_NATION)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.fixture
def plan(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.maxMetadataStringLength"):
        spark.conf.unset(key)


def test_groups_of_the_bucket_column_need_no_exchange(table, entries, plan):
    counts = tally(table, ["noc", "sport"])
    assert "Exchange" not in plan(counts) and "Exchange" in plan(tally(entries, ["noc", "sport"]))
    assert set(map(tuple, counts.collect())) == set(map(tuple, tally(entries, ["noc", "sport"]).collect()))
    trend = growth(tally(table, ["noc", "year"]), "noc", "year")
    assert "Exchange" not in plan(trend)
    best = top_k(tally(table, ["noc", "sport"]), ["noc"], "n", ["sport"], 2)
    assert "Exchange" not in plan(best)


def test_joins_of_like_layouts_need_no_exchange(spark, table, entries, plan):
    name = f"t_{uuid.uuid4().hex}"
    names = lay_out(entries.select("noc", F.concat(F.lit("N"), "noc").alias("name")).distinct(), name, Layout(("noc",), 4))
    joined = table.join(names, "noc")
    assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert joined.count() == 2000
    spark.sql(f"DROP TABLE {name}")


def test_other_years_are_not_read(table, plan):
    text = plan(table.filter("year >= 1964"))
    assert re.search(r"PartitionFilters: \[[^\]]*year[^\]]*1964", text)
    files = table.filter("year = 1956").select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("year=1956" in r.f for r in files)
    assert len(files) <= 4  # a file for each bucket


def test_rows_are_whole_and_sorted_in_files(table, entries):
    assert set(map(tuple, table.select("id", "noc", "sport", "year").collect())) == set(map(tuple, entries.select("id", "noc", "sport", "year").collect()))
    for part in table.withColumn("f", F.input_file_name()).groupBy("f").agg(F.collect_list(F.struct("noc", "sport")).alias("rows")).collect():
        assert part.rows == sorted(part.rows)


def test_open_again(spark, entries, tmp_path, plan):
    first, second = f"t_{uuid.uuid4().hex}", f"t_{uuid.uuid4().hex}"
    path = f"{tmp_path}/it's here"
    written = lay_out(entries, first, BY_NATION, path=path)
    schema, rows = written.schema, set(map(tuple, written.select("id", "year").collect()))
    spark.sql(f"DROP TABLE {first}")  # the folder stays
    opened = open_layout(spark, second, path, schema, BY_NATION)
    assert set(map(tuple, opened.select("id", "year").collect())) == rows
    assert "Exchange" not in plan(tally(opened, ["noc"]))
    spark.sql(f"DROP TABLE {second}")


def test_bucket_counts(table):
    assert [buckets_for(n, 2, 10) for n in (0, 1, 20, 21, 100)] == [1, 1, 1, 2, 8]
    assert sum(r.row_count for r in rows_per_bucket(table, BY_NATION).collect()) == 2000
    for wrong in (dict(bucket_by=(), buckets=1), dict(bucket_by=("a",), buckets=0), dict(bucket_by=("a",), buckets=1, partition_by=("a",))):
        with pytest.raises(ValueError):
            Layout(**wrong)
    with pytest.raises(ValueError):
        lay_out(table, "no name", BY_NATION)
