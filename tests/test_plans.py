"""Plans: how often data is scanned, what reaches the scan, what must not appear."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from podium.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def plan(spark):
    """The physical plan without adaptive execution, which shows reuse before running."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    yield lambda name: REGISTRY[name].build(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def scans(text, table):
    return len(re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet", text))


@pytest.mark.parametrize("name", [n for n in REGISTRY])
def test_no_python_and_no_cross_join(plan, name):
    text = plan(name)
    for unwanted in ("Python", "ExistingRDD", "CartesianProduct", "NestedLoopJoin"):
        assert unwanted not in text


@pytest.mark.parametrize("name, table", [
    ("participation_trend", "orders"),
    ("participation_trend_join", "orders"),
    ("host_advantage", "orders"),
    ("host_advantage_distinct", "orders"),
    ("host_advantage_sql", "orders"),
    ("mode_band_per_group", "lineitem"),
    ("leader_per_group", "lineitem"),
    ("games_host_advantage", "lineitem"),
    ("games_participation", "lineitem"),
    ("games_winner_profile", "lineitem"),
    ("null_profile_long", "documents"),
    ("sentinel_profile", "documents"),
    ("column_catalog", "lineitem"),
])
def test_facts_are_scanned_once(plan, name, table):
    assert scans(plan(name), table) == 1


def test_profile_reads_every_column_once(plan):
    read = [
        column
        for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan("table_profile"))
        for column in re.findall(r"(\w+):", schema)
    ]
    assert len(read) == len(set(read)) == 11


@pytest.mark.parametrize("name", ["topk_per_group", "leader_per_group", "games_top_countries"])
def test_groups_are_cut_before_the_shuffle(plan, name):
    assert plan(name).count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(plan):
    text = plan("scoped_filter")
    assert "StringContains(p_name,ring)" in text and "GreaterThanOrEqual(p_size,10)" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int>" in text
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan("equality_filter")
    assert "Not(EqualTo(o_orderpriority,4-NOT SPECIFIED))" in plan("sentinel_filter")
    assert "In(c_mktsegment, [" in plan("domain_leak_rows")


def test_largest_rows_need_no_full_sort(plan):
    assert "TakeOrderedAndProject" in plan("top_n_global")


def test_counts_are_combined_before_the_shuffle(plan):
    for name in ("group_row_count", "mode_band_per_group", "distinct_row_count", "host_advantage_distinct"):
        text = plan(name)
        assert re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*HashAggregate", text), name


def test_hot_join_key_is_split(spark, tmp_path):
    """One customer places a third of all orders; the customers are too many to broadcast."""
    sf_dir = str(tmp_path)
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    hot = orders.withColumn("o_custkey", F.lit(7).cast("bigint"))
    third = hot.limit(orders.count() // 2)
    copies = F.explode(F.sequence(F.lit(0), F.lit(39))).alias("copy")
    many = orders.unionByName(third).select("*", copies).withColumn(
        "o_orderkey", F.col("o_orderkey") + F.col("copy") * 10_000_000
    )
    many.drop("copy").repartition(16).write.parquet(f"{sf_dir}/orders.parquet")
    for name in ("customer", "nation"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{sf_dir}/{name}.parquet")

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        frame = REGISTRY["group_count"].build(spark, sf_dir)
        rows = frame.collect()
        assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    connection = duckdb.connect()
    for name in ("orders", "customer", "nation"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, rows)) == sorted(connection.execute(REGISTRY["group_count"].sql).fetchall())


GAMES = [n for n in REGISTRY if n.startswith("games_")]


@pytest.mark.parametrize("name", GAMES)
def test_season_is_tested_below_the_joins(plan, name):
    text = plan(name)
    (scan,) = re.findall(r"FileScan parquet [^\n]*lineitem\.parquet[^\n]*", text)
    # The condition on the season's source column is in the filter right above its scan.
    above = text[: text.index(scan)].splitlines()[-4:]
    assert any("Filter" in line and "l_linestatus" in line for line in above)
    assert scans(text, "region") == 0


def test_values_are_counted_before_they_meet_the_codes(plan):
    text = plan("domain_leak_check")
    assert re.search(r"Join[\s\S]*HashAggregate\(keys=\[c_mktsegment", text)


def test_band_combinations_are_counted_before_they_are_laid_out(plan):
    lines = plan("mode_band_per_group").splitlines()
    generate = next(i for i, line in enumerate(lines) if "Generate inline" in line)
    assert any("HashAggregate" in line for line in lines[generate:])


def test_partitioned_files_are_rebalanced(spark, tmp_path):
    from podium.sources import write_parquet

    target = str(tmp_path / "out")
    write_parquet(spark.range(1000).selectExpr("id", "id % 3 AS part").repartition(8), target, partition_by=["part"])
    import glob

    assert len(glob.glob(f"{target}/part=*/*.parquet")) == 3
