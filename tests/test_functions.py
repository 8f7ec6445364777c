"""Predicates, bands and rates on edge cases."""

from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from podium.functions import (
    Bands,
    change_pct,
    in_scope,
    is_missing,
    is_present,
    percent_text,
    share_pct,
    violates_format,
)

AGES = Bands.even(10, 80, 5)


def column(spark, kind, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.select(expression, "i").orderBy("i").collect()]


def test_present_and_missing_treat_null_and_sentinel_alike(spark):
    values = ["Gold", "NA", None, "na", ""]
    assert column(spark, "string", values, is_present("v")) == [True, False, False, True, True]
    assert column(spark, "string", values, is_missing("v")) == [False, True, True, False, False]


def test_present_on_numbers_does_not_fail(spark):
    assert column(spark, "double", [1.5, None], is_present("v")) == [True, False]


def test_scope(spark):
    frame = spark.createDataFrame(
        [("1956 Summer", 1956), ("1956 Winter", 1956), ("1952 Summer", 1952), (None, 1960), ("2000 summer", 2000)],
        "g string, y int",
    )
    assert [r.y for r in frame.filter(in_scope("g", "Summer", "y", 1956)).collect()] == [1956]


def test_format(spark):
    pattern = r"^\d{4} Summer$"
    values = ["2012 Summer", "2012 Winter", None, "x2012 Summer", "SWE"]
    assert column(spark, "string", values, violates_format("v", pattern)) == [False, True, None, True, True]
    assert column(spark, "string", values, violates_format("v", pattern, include_null=True)) == [
        False, True, True, True, True,
    ]


def test_band_edges(spark):
    values = [10.0, 14.9, 15.0, 79.9, 80.0, 9.0, None, float("nan")]
    assert column(spark, "double", values, AGES.label("v")) == [
        "10-15", "10-15", "15-20", "75-80", None, None, None, None,
    ]
    assert column(spark, "double", values, AGES.index("v")) == [0, 0, 1, 13, None, None, None, None]
    assert column(spark, "double", values, AGES.label_of(AGES.index(F.col("v")))) == [
        "10-15", "10-15", "15-20", "75-80", None, None, None, None,
    ]


def test_band_definitions_are_checked():
    assert len(AGES.labels) == 14
    assert Bands.even(120, 220, 5).labels[-1] == "215-220"
    assert len(Bands.even(30, 150, 10).labels) == 12
    for edges, labels in [((1,), ()), ((1, 1), ("a",)), ((2, 1), ("a",)), ((1, 2), ("a", "b"))]:
        with pytest.raises(ValueError):
            Bands(edges, labels)
    with pytest.raises(ValueError):
        Bands.even(0, 10, 3)


@settings(max_examples=12, deadline=None)
@given(
    edges=st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=2, max_size=9, unique=True).map(sorted),
    others=st.lists(st.floats(-2e6, 2e6, allow_nan=False), max_size=20),
)
def test_bands_equal_a_search_edge_by_edge(spark, edges, others):
    bands = Bands.of(edges)
    values = [*edges, *others]
    expected = [
        next((i for i in range(len(edges) - 1) if edges[i] <= v < edges[i + 1]), None) for v in values
    ]
    assert column(spark, "double", values, bands.index("v")) == expected


def test_rates(spark):
    frame = spark.createDataFrame(
        [(1, 891, None), (2, 1422, 891), (3, 1, 0), (4, 0, 5), (5, 2_000_000_000, 1)],
        "i int, now bigint, before bigint",
    ).orderBy("i")
    rows = frame.select(
        change_pct("now", "before").alias("c"), percent_text(change_pct("now", "before")).alias("t")
    ).collect()
    assert [r.c for r in rows] == [None, Decimal("59.596"), None, Decimal("-100.000"), None]
    assert [r.t for r in rows] == [None, "59.596%", None, "-100.000%", None]


def test_rates_round_half_up(spark):
    frame = spark.createDataFrame([(1, 2.0005), (2, -1.0005)], "i int, v double").orderBy("i")
    got = [r[0] for r in frame.select(share_pct(F.col("v") / 100, F.lit(1.0))).collect()]
    assert got == [Decimal("2.001"), Decimal("-1.001")]
