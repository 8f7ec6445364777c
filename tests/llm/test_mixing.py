"""Source mixing against the rule worked out step by step."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from podium.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shared_out(sizes: dict) -> dict:
    """Targets by the rule itself: share by weight, cut what is over three times its size, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > 3 * sizes[s]}
        if not over:
            return goal | {s: left * weight[s] / whole for s in open_}
        for s in over:
            goal[s] = 3.0 * sizes[s]
            left -= goal[s]
        open_ -= over
    return goal


def documents(seed: int, n: int, sources: list) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        source = sources[0] if draw.random() < 0.4 else draw.choice(sources)
        text = draw.choice([None, "", "a b", " ".join("w" * draw.randint(1, 3) for _ in range(draw.randint(1, 60)))])
        rows.append((draw.choice([None, i, i, i]), text, "en", source, 0))
    return rows


@pytest.mark.parametrize("sources", [["a"], ["b", "a", None], list("zyxwvutsrq"), ["A", "a", "é", "", None]])
def test_targets_and_words_taken(spark, sources):
    rows = documents(len(sources), 300, sources)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    goal = shared_out(sizes)
    assert sum(goal.values()) == pytest.approx(sum(sizes.values()))
    largest = max(r.size for r in got)
    for source, target in goal.items():
        mine = [r for r in got if r.source == source]
        assert {r.source_size for r in mine} == {sizes[source]}
        assert mine[0].target == pytest.approx(target)
        # Documents of equal hash go together: rows that repeat a text without an id.
        assert abs(sum(r.taken for r in mine) - target) <= 3 * largest
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.size * r.repeats for r in got)


def test_taken_words_meet_the_target_within_a_document(spark):
    rows = [(i, "w " * (i % 50 + 1), "en", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 50 for r in got)


def test_reruns_agree_and_smaller_budgets_are_nested(spark):
    rows = mixing.sized(spark.createDataFrame(documents(5, 400, ["a", "b"]), SCHEMA)).filter("doc_id IS NOT NULL").cache()
    budgets = spark.createDataFrame([("a", 300.0), ("a", 900.0), ("b", 500.0)], "source string, budget double")
    cuts = mixing.thresholds(rows, budgets, ["source"])
    first, again = sorted(map(tuple, cuts.collect())), sorted(map(tuple, cuts.collect()))
    assert first == again
    small, large = (r[2] for r in first if r[0] == "a")
    kept = [
        {r.doc_id for r in rows.filter(F.col("source") == "a").filter(mixing.takes(F.col("hash"), F.lit(t))).collect()} for t in (small, large)
    ]
    assert kept[0] < kept[1]


def test_mixed_documents_are_repeated_with_all_columns(spark):
    docs = spark.createDataFrame(documents(9, 200, ["a", "b", "c"]), SCHEMA).withColumn("size", F.lit("kept")).withColumn("hash", F.lit(1))
    want = mixing.mix(docs).agg(F.sum("repeats")).first()[0]
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert got.count() == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs).collect() == []
    assert mixing.mixed_documents(docs).collect() == []
