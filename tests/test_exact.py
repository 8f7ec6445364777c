"""Exact sums against rational arithmetic, for any order and partitioning."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from podium.operators import exact_means, exact_moments, exact_sums


def true_sum(values):
    total = sum(map(Fraction, values))
    try:
        return float(total)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def doubles(spark, values, partitions=3):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(partitions)


CASES = {
    "cancels": [1e16, 1.0, -1e16, 1e-8],
    "far apart": [1e300, 1.0, -1e300, 1e-300, 2.0**-1000],
    "tie up and down": [2.0**53, 1.0, 2.0**-60],
    "tie": [2.0**53, 1.0],
    "negative": [-0.1] * 10 + [0.3],
    "negative whole": [-(2.0**22), -(2.0**44), -1.0],
    "zeros": [0.0, -0.0],
    "edges": [2.0**22, 2.0**44, 2.0**-22, 2.0**66 - 2.0**14, math.nextafter(2.0**22, 0), math.nextafter(2.0**-22, 0)],
    "denormal": [5e-324, 1e-310, 2.0],
    "largest": [1.7976931348623157e308, 1.0, -1.7976931348623157e308],
    "overflow": [1.7976931348623157e308] * 3,
}


@pytest.mark.parametrize("name", list(CASES))
def test_sums_are_the_nearest_double(spark, name):
    row = exact_sums(doubles(spark, CASES[name]), ["x"]).first()
    assert row.sum_x == true_sum(CASES[name]) and row.count_x == len(CASES[name])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64, allow_subnormal=False).filter(lambda x: x == 0 or 1e-280 < abs(x) < 1e300), max_size=20), min_size=1, max_size=8))
def test_random_sums_by_group(spark, groups):
    rows = [(g, x) for g, values in enumerate(groups) for x in values]
    if rows:
        got = {r.g: r.sum_x for r in exact_sums(spark.createDataFrame(rows, "g int, x double"), ["x"], ["g"]).collect()}
        assert got == {g: true_sum(values) for g, values in enumerate(groups) if values}


def test_same_result_on_1_and_200_partitions(spark):
    draw = random.Random(1)
    values = [draw.uniform(-1, 1) * 10 ** draw.randint(-12, 12) for _ in range(5000)]
    df = doubles(spark, values)
    results = {tuple(exact_moments(df.repartition(n), ["x"]).first()) for n in (1, 7, 200)}
    assert len(results) == 1
    mean, spread = results.pop()
    assert mean == true_sum(values) / 5000
    exact = Fraction(sum(map(Fraction, values))) / 5000
    assert spread == pytest.approx(math.sqrt(sum((Fraction(v) - exact) ** 2 for v in values) / 4999), rel=1e-14)
    plain = {df.repartition(n).agg(F.avg("x")).first()[0] for n in (1, 7, 200)}
    assert len(plain) > 1  # what the plain average does


def test_far_from_zero(spark):
    values = [1e9 + i / 8 for i in range(9)]
    assert exact_moments(doubles(spark, values), ["x"]).first().stddev_x == pytest.approx(math.sqrt(sum((i - 4) ** 2 for i in range(9)) / 64 / 8), rel=1e-15)


def test_other_types_and_missing_values(spark):
    df = spark.createDataFrame(
        [("a", 2**62, 1, 0.1, None), ("a", 2**62, None, 0.2, None), ("a", -1, 3, None, None), (None, 1, 1, 0.5, None), (None, None, 1, -0.5, None)],
        "g string, big long, small int, f float, none double",
    )
    got = {r.g: r for r in exact_sums(df, ["big", "small", "f", "none"], ["g"]).collect()}
    f32 = [Fraction(r[0]) for r in df.select(F.col("f").cast("double")).filter("f > 0 AND f < 0.3").collect()]
    assert (got["a"].sum_big, got["a"].sum_small, got["a"].sum_f) == (float(2**63 - 1), 4.0, float(sum(f32)))
    assert (got["a"].sum_none, got["a"].count_none, got["a"].count_f) == (None, 0, 2)
    assert (got[None].sum_big, got[None].count_big, got[None].sum_f) == (1.0, 1, 0.0)
    means = exact_means(df, ["small", "none"]).first()
    assert (means.small, means.none) == (1.5, None)
    with pytest.raises(ValueError):
        exact_sums(df, ["g"])


def test_not_finite(spark):
    inf, nan = math.inf, math.nan
    for values, want in (([1.0, inf], inf), ([1.0, -inf], -inf), ([inf, -inf], nan), ([nan, 1.0], nan), ([inf, inf], inf)):
        got = exact_sums(doubles(spark, values), ["x"]).first().sum_x
        assert got == want or (math.isnan(got) and math.isnan(want))


def test_empty_tables_and_odd_names(spark):
    empty = spark.createDataFrame([], "g int, x double")
    assert tuple(exact_sums(empty, ["x"]).first()) == (None, 0)
    assert exact_sums(empty, ["x"], ["g"]).collect() == []
    assert tuple(exact_moments(empty, ["x"]).first()) == (None, None)
    odd = spark.createDataFrame([(1, 0.1), (1, 0.2)], "`a.b` int, `x y` double")
    assert tuple(exact_sums(odd, ["x y"], ["a.b"]).first()) == (1, true_sum([0.1, 0.2]), 2)


def test_what_is_shuffled_does_not_grow_with_rows(spark):
    """Rows are combined in each task: a row per group, column and power of two."""
    df = spark.range(200_000, numPartitions=4).select((F.col("id") % 3).alias("g"), (F.rand(1) * 1000).alias("x"))
    plan = exact_sums(df, ["x"], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3 and "partial_sum" in plan and "Python" not in plan
