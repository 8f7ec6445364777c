"""Operators on small fixtures, against results worked out in plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from podium.functions import Bands
from podium.operators import (
    compare_offsets,
    compare_offsets_sql,
    distinct_row_count,
    distinct_values,
    drop_columns_matching,
    enrich,
    growth_and_share,
    impute_means,
    leaders,
    leak_summary,
    leaked_rows,
    missing_by_group,
    modal_bands,
    null_fractions,
    null_profile,
    rollup_text,
    sentinel_by_group,
    sentinel_profile,
    table_profile,
    tally,
    top_k,
    union_all,
)
from podium.operators.quality import column_catalog, has_leak

rows_of_counts = st.lists(
    st.tuples(st.sampled_from("abc"), st.integers(1, 5)), min_size=1, max_size=60
)


def as_set(frame):
    return {tuple(r) for r in frame.collect()}


# --- tally ---------------------------------------------------------------


@pytest.fixture
def medals(spark):
    return spark.createDataFrame(
        [
            (1956, "AUS", "Relay", "Gold"),
            (1956, "AUS", "Relay", "Gold"),
            (1956, "AUS", "Dash", "NA"),
            (1956, "AUS", None, "Gold"),
            (1956, "FRA", "Dash", None),
            (1960, "FRA", "Dash", "Bronze"),
        ],
        "y int, noc string, event string, medal string",
    )


def test_tally_keeps_groups_that_count_nothing(medals):
    won = F.col("medal") != "NA"
    assert as_set(tally(medals, ["y", "noc"])) == {(1956, "AUS", 4), (1956, "FRA", 1), (1960, "FRA", 1)}
    assert as_set(tally(medals, ["y", "noc"], of="event")) == {
        (1956, "AUS", 3), (1956, "FRA", 1), (1960, "FRA", 1),
    }
    assert as_set(tally(medals, ["y", "noc"], of="event", where=won)) == {
        (1956, "AUS", 2), (1956, "FRA", 0), (1960, "FRA", 1),
    }


def test_tally_distinct_counts_copies_once(medals):
    won = F.col("medal") != "NA"
    got = tally(medals, ["y", "noc"], of="event", where=won, distinct=["event", "medal"], name="n")
    assert got.columns == ["y", "noc", "n"]
    assert as_set(got) == {(1956, "AUS", 1), (1956, "FRA", 0), (1960, "FRA", 1)}


def test_tally_groups_by_expressions(medals):
    late = (F.col("y") > 1956).alias("late")
    assert as_set(tally(medals, [late])) == {(False, 5), (True, 1)}
    assert as_set(tally(medals, [late], distinct=["noc"])) == {(False, 2), (True, 1)}


# --- trend ---------------------------------------------------------------


@settings(max_examples=8, deadline=None)
@given(rows=rows_of_counts)
def test_trend_against_plain_python(spark, rows):
    counts = tally(spark.createDataFrame(rows, "c string, p int"), ["c", "p"])
    n = Counter(rows)
    total = Counter(p for _, p in rows)
    expected = {}
    for c, p in n:
        earlier = [q for d, q in n if d == c and q < p]
        expected[c, p] = (n[c, p], n[c, max(earlier)] if earlier else None, total[p])
    for totals in ("join", "window"):
        trend = growth_and_share(counts, "c", "p", totals=totals).collect()
        assert {(r.c, r.p): (r.n, r.prev_n, r.total_n) for r in trend} == expected
        shares = defaultdict(Decimal)
        for r in trend:
            shares[r.p] += r.share_pct
            assert (r.growth_pct is None) == (r.prev_n is None)
            assert r.growth_text == (None if r.growth_pct is None else f"{r.growth_pct}%")
        assert all(abs(s - 100) <= Decimal("0.002") for s in shares.values())


def test_trend_leaves_out_counts_without_period(spark):
    counts = spark.createDataFrame([("a", None, 7), ("a", 1, 2), ("a", 2, 3)], "c string, p int, n bigint")
    for totals in ("join", "window"):
        got = growth_and_share(counts, "c", "p", totals=totals)
        assert {(r.p, r.prev_n) for r in got.collect()} == {(1, None), (2, 2)}


def test_trend_rejects_unknown_totals(spark):
    counts = spark.createDataFrame([("a", 1, 2)], "c string, p int, n bigint")
    with pytest.raises(ValueError):
        growth_and_share(counts, "c", "p", totals="guess")


# --- ranking -------------------------------------------------------------


@settings(max_examples=8, deadline=None)
@given(rows=rows_of_counts, k=st.integers(1, 4))
def test_top_k_against_plain_python(spark, rows, k):
    counts = tally(spark.createDataFrame(rows, "g string, m int"), ["g", "m"])
    n = Counter(rows)
    expected = set()
    for g in {g for g, _ in rows}:
        best = sorted(((-c, m) for (h, m), c in n.items() if h == g))[:k]
        expected |= {(g, m, -c, i) for i, (c, m) in enumerate(best, start=1)}
    assert as_set(top_k(counts, ["g"], "n", ["m"], k)) == expected


def test_ties_and_list_order(spark):
    counts = spark.createDataFrame(
        [(1964, "POL", 240), (1964, "KOR", 240), (1964, "GER", 478), (1964, "ITA", 256), (1968, "USA", 496)],
        "y int, noc string, n bigint",
    ).repartition(5)
    best = top_k(counts, ["y"], "n", ["noc"], 3)
    texts = rollup_text(best, ["y"], ["rank"], ["noc", "n"], "best")
    assert as_set(texts) == {(1964, "GER-478, ITA-256, KOR-240"), (1968, "USA-496")}
    assert as_set(leaders(counts, ["y"], "n", ["noc"])) == {(1964, "GER", 478), (1968, "USA", 496)}


def test_rank_column_can_be_left_out(spark):
    counts = spark.createDataFrame([("a", "x", None), ("a", "y", 0)], "g string, m string, n bigint")
    assert as_set(top_k(counts, ["g"], "n", ["m"], 1, rank=None)) == {("a", "y", 0)}


SIZE = Bands.even(0, 30, 10)


def test_modes_with_unknown_bands(spark):
    people = spark.createDataFrame(
        [
            ("run", 5.0), ("run", None), ("run", None), ("run", 15.0), ("run", 16.0),
            ("swim", None), ("swim", 99.0),
            ("row", 25.0), ("row", 5.0), ("row", None), ("row", None), ("row", None),
        ],
        "sport string, size double",
    )
    bands = {"size_band": (F.col("size"), SIZE), "half_band": (F.col("size") / 2, SIZE)}
    known = modal_bands(people, "sport", bands)
    assert as_set(known) == {
        ("run", "10-20", "0-10"), ("swim", None, None), ("row", "0-10", "0-10"),
    }
    competing = modal_bands(people, "sport", bands, null_competes=True)
    assert as_set(competing) == {
        ("run", "10-20", "0-10"), ("swim", None, None), ("row", None, None),
    }


@settings(max_examples=8, deadline=None)
@given(rows=st.lists(
    st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(-5, 35))), min_size=1, max_size=40
))
def test_modes_against_plain_python(spark, rows):
    frame = spark.createDataFrame(rows, "g string, v int")
    expected = set()
    for g in {g for g, _ in rows}:
        hits = Counter(v // 10 for h, v in rows if h == g and v is not None and 0 <= v < 30)
        best = min(((-n, b) for b, n in hits.items()), default=None)
        expected.add((g, None if best is None else f"{best[1] * 10}-{best[1] * 10 + 10}"))
    assert as_set(modal_bands(frame, "g", {"band": (F.col("v"), SIZE)})) == expected


# --- offsets -------------------------------------------------------------


@pytest.fixture
def counts(spark):
    return spark.createDataFrame(
        [(2000, "A", 10), (2004, "A", 20), (2008, "A", 5), (2004, "B", 0), (2008, "B", 3), (2012, "C", 1)],
        "y int, noc string, n bigint",
    )


def test_offsets(counts):
    hosts = {2004: "A", 2008: "B", 2012: "Z"}
    got = compare_offsets(counts, hosts, period="y", group="noc", offsets=(-4, -8, 4, 8))
    by_year = {r.y: r.asDict() for r in got.collect()}
    assert set(by_year) == {2004, 2008, 2012}
    a = by_year[2004]
    assert [a[f"n_{c}"] for c in ("host", "other1", "other2", "other3", "other4")] == [20, 10, 0, 5, 0]
    assert [a[f"other{i}_in_range"] for i in (1, 2, 3, 4)] == [True, False, True, True]
    assert a["margin_over_host_pct"] == 50.0
    assert a["change_over_best_pct"] == 100.0
    b = by_year[2008]
    assert (b["n_host"], b["margin_over_host_pct"], b["change_over_best_pct"]) == (3, 100.0, None)
    absent = by_year[2012]
    assert (absent["n_host"], absent["margin_over_host_pct"]) == (0, None)
    assert [absent[f"other{i}_in_range"] for i in (1, 2, 3, 4)] == [True, True, False, False]


def test_offsets_accept_a_frame_and_one_offset(spark, counts):
    marked = spark.createDataFrame([(2004, "A"), (2004, "B")], "y int, noc string")
    got = compare_offsets(counts, marked, period="y", group="noc", offsets=(4,))
    assert {(r.noc, r.n_host, r.n_other1) for r in got.collect()} == {("A", 20, 5), ("B", 0, 3)}


def test_offsets_as_sql(spark):
    entries = spark.createDataFrame(
        [(2000, "A", "x")] * 3 + [(2004, "A", "x")] * 4 + [(2004, "A", None)] + [(2012, "A", "x")],
        "y int, noc string, event string",
    )
    got = compare_offsets_sql(
        entries, {2004: "A", 2016: "B"}, period="y", group="noc", item="event", step=4
    )
    assert {tuple(r) for r in got.collect()} == {
        (2004, "A", 4, 3, 0, 0, 1, 25.0),
        (2016, "B", 0, 0, 0, 0, 0, None),
    }


def test_enrich_keeps_rows_without_entry(spark):
    rows = spark.createDataFrame([(1, 1956), (2, 1957), (3, None)], "id int, y int")
    got = enrich(rows, {1956: "AUS"}, "y", "host")
    assert got.columns == ["id", "y", "host"]
    assert {(r.id, r.host) for r in got.collect()} == {(1, "AUS"), (2, None), (3, None)}


# --- quality -------------------------------------------------------------


@pytest.fixture
def untidy(spark):
    return spark.createDataFrame(
        [
            (1, "g1", 10, "NA", "x"),
            (2, "g1", None, "NA", None),
            (3, "g2", 20, "5", "NA"),
            (3, "g2", 20, "5", "NA"),
            (4, "g3", 30, "6", "y"),
        ],
        "id int, g string, `a.b` int, w string, h string",
    )


def test_profiles(untidy):
    assert as_set(null_profile(untidy)) == {
        ("id", 5, 0), ("g", 5, 0), ("a.b", 4, 1), ("w", 5, 0), ("h", 4, 1),
    }
    fractions = null_fractions(untidy).first().asDict()
    assert fractions["a.b_missing_fraction"] == 0.2 and fractions["id_missing_fraction"] == 0.0
    assert as_set(sentinel_profile(untidy)) == {("id", 0), ("g", 0), ("a.b", 0), ("w", 2), ("h", 2)}
    assert as_set(column_catalog(untidy)) == {
        ("id", 1, "int", 5, 5), ("g", 2, "string", 5, 5), ("a.b", 3, "int", 4, 5),
        ("w", 4, "string", 5, 5), ("h", 5, "string", 4, 5),
    }
    assert distinct_row_count(untidy).first()[0] == 4
    assert distinct_row_count(untidy, approximate=True).first()[0] == 4


def test_profiles_of_an_empty_table(untidy):
    empty = untidy.limit(0)
    assert null_fractions(empty).first()[0] is None
    assert as_set(null_profile(empty, ["id"])) == {("id", 0, 0)}


def test_table_profile(untidy, spark):
    got = {r.column_name: r for r in table_profile(untidy).collect()}
    assert set(got) == {"id", "g", "a.b", "w", "h"}
    assert (got["a.b"].non_null, got["a.b"].mean, got["a.b"].min_number, got["a.b"].max_number) == (
        4, 20.0, 10.0, 30.0,
    )
    assert abs(got["a.b"].stddev - 8.16496580927726) < 1e-12
    assert (got["h"].non_null, got["h"].min_text, got["h"].max_text, got["h"].mean) == (4, "NA", "y", None)
    only_text = table_profile(untidy.select("g"))
    assert only_text.columns == table_profile(untidy).columns
    with pytest.raises(ValueError):
        table_profile(spark.sql("SELECT true AS flag"))


def test_missing_by_group(untidy):
    worst_first = missing_by_group(untidy, "g", {"ab_missing": "a.b", "h_missing": "h"})
    assert [tuple(r) for r in worst_first.collect()] == [("g1", 1, 1), ("g2", 0, 0), ("g3", 0, 0)]
    marks = sentinel_by_group(untidy, "g", {"w_marks": "w", "h_marks": "h"})
    assert as_set(marks) == {("g1", 2, 0), ("g2", 0, 2)}


def test_imputation_makes_whole_numbers_double(spark):
    numbers = spark.createDataFrame(
        [(1, 1, None), (2, None, None), (3, 2, None)], "id int, v int, never double"
    )
    got = impute_means(numbers, ["v", "never"])
    assert dict(got.dtypes)["v"] == "double"
    assert as_set(got) == {(1, 1.0, None), (2, 1.5, None), (3, 2.0, None)}


def test_imputation_adds_no_join(spark, untidy):
    plan = impute_means(untidy, ["a.b"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_leaks(spark, untidy):
    assert as_set(leak_summary(untidy, "g", ["g2", "SWE"])) == {("g2", 2, True), ("SWE", 0, False)}
    listed = spark.createDataFrame([("g1",), ("g9",)], "code string")
    assert as_set(leak_summary(untidy, "g", listed)) == {("g1", 2, True), ("g9", 0, False)}
    assert leaked_rows(untidy, "g", listed).count() == 2
    assert has_leak(untidy, "g", ["g3"]) and not has_leak(untidy, "g", ["SWE"])


def test_column_and_set_operators(spark, untidy):
    assert drop_columns_matching(untidy, r"^(a\.|h$)").columns == ["id", "g", "w"]
    assert as_set(distinct_values(untidy, "g")) == {("g1",), ("g2",), ("g3",)}
    one = spark.sql("SELECT 1 AS a, 'x' AS b")
    other = spark.sql("SELECT 'x' AS b, 1 AS a")
    assert [tuple(r) for r in union_all([one, other, one]).collect()] == [(1, "x")] * 3


def test_offsets_with_missing_and_negative_counts(spark):
    counts = spark.createDataFrame([(1956, "A", -5), (1960, "A", 3), (1964, None, None)], "y int, g string, n bigint")
    (got,) = compare_offsets(counts, {1960: "A"}, period="y", group="g", offsets=(-4, 4, 8)).collect()
    assert (got.n_host, got.n_other1, got.n_other2) == (3, -5, 0)
    assert (got.other1_in_range, got.other2_in_range, got.other3_in_range) == (True, True, False)


def test_offsets_with_a_pair_given_twice(spark):
    counts = spark.createDataFrame([(1960, "A", 3)], "y int, g string, n bigint")
    marked = spark.createDataFrame([(1960, "A"), (1960, "A")], "y int, g string")
    (got,) = compare_offsets(counts, marked, period="y", group="g").collect()
    assert got.n_host == 3


def test_names_with_dots(spark):
    rows = spark.createDataFrame([(1956, "NA"), (1960, None)], "`the.year` int, `a b.c` string")
    assert [r[2] for r in enrich(rows, {1956: "AUS"}, "the.year", "host.noc").orderBy("`the.year`").collect()] == ["AUS", None]
    assert missing_by_group(rows, "the.year", {"no.c": "a b.c"}).first()[:] == (1960, 1)
    assert sentinel_by_group(rows, "the.year", {"no.c": "a b.c"}).first()[:] == (1956, 1)


def test_an_empty_match_is_a_violation(spark):
    from podium.operators import format_report

    rows = spark.createDataFrame([("a1",), ("",), (None,)], "c string")
    assert format_report(rows, {"c": "[0-9]*$"}).first()[:] == ("c", "[0-9]*$", 1)
    assert format_report(rows, {"c": "[0-9]*$"}, include_null=True).first()[2] == 2


def test_profile_of_times(spark):
    rows = spark.sql("SELECT date'2024-01-02' AS d, timestamp_ntz'2024-01-02 03:04:05.000006' AS t")
    got = {r.column_name: r for r in table_profile(rows).collect()}
    assert str(got["t"].max_time) == "2024-01-02 03:04:05.000006" and str(got["d"].min_time).startswith("2024-01-02")
