"""Exact top-k against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from podium.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    whole = [(i, [math.floor(1024 * c) for c in v]) for i, v, _ in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for q, a in whole:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in whole if c != q)
            out |= {(q, rank, c, -s) for rank, (s, c) in enumerate(scored[:k], 1)}
    return out


def vectors(seed, n, width, kind):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        if kind == "ties":
            v = [float(draw.randint(-1, 1)) for _ in range(width)]
        elif kind == "hot" and i % 3:
            v = [0.5] * width
        else:
            v = [draw.gauss(0, 1 + (i % 7)) for _ in range(width)]
        rows.append((i, [float(__import__("numpy").float32(x)) for x in v], 0))
    return rows


@pytest.mark.parametrize("kind, n, width", [("plain", 400, 20), ("ties", 300, 3), ("hot", 300, 8), ("plain", 5, 4), ("plain", 1, 2)])
def test_against_all_pairs(spark, kind, n, width):
    rows = vectors(n, n, width, kind)
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, k=10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, 10, 10)


def test_small_blocks_and_chunks_change_nothing(spark, monkeypatch):
    for name in ("BLOCK_ROWS", "CHUNK_ROWS", "SLAB_ROWS"):
        monkeypatch.setattr(topk, name, 16)
    rows = vectors(3, 300, 24, "plain")
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, k=3)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 3)


def test_what_takes_no_part(spark):
    good = vectors(4, 40, 4, "plain")
    bad = [(100, None, 0), (110, [1.0, None, 0.0, 0.0], 0), (120, [float("nan")] * 4, 0), (130, [float("inf")] * 4, 0), (None, [1.0] * 4, 0)]
    frame = spark.createDataFrame(good + bad, SCHEMA).withColumns({c: F.lit(1) for c in ("score", "rank", "band", "v", "norm")})
    got = topk.top_k(frame, F.col("vec_id") % 10 == 0)
    assert {tuple(r) for r in got.collect()} == brute(good, 10, 10)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**40 + i), float(-(2**35) * i)], 0) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = {(q, r, c, max(-(2**63), min(2**63 - 1, s))) for q, r, c, s in brute(rows, 10, 3)}
    got = {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 10 == 0, k=3).collect()}
    assert {(q, s) for q, _, _, s in got} == {(q, s) for q, _, _, s in want}


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []
