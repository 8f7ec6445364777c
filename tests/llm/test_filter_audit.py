"""The filter audit against every order worked through step by step."""

from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from podium.llm import filter_audit
from tests.llm.rows import ROWS, SCHEMA, awkward, empty

LABELS = "doc_id long, quality int, toxic int"


def fails(rows: list[tuple]) -> list[set[str]]:
    first: dict[str, int] = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = text.encode().split()
        found = set()
        if len(words) < 200:
            found.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            found.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            found.add("C")
        if re.search(r"[#$%&*|]", text):
            found.add("D")
        if doc_id is not None and doc_id > first[text]:
            found.add("E")
        out.append(found)
    return out


def by_hand(rows: list[tuple], labels: list[tuple]) -> dict:
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    failed = fails(rows)
    out = {}
    for part in {r[2] or "" for r in rows}:
        docs = [(r[0], f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d, why in left if f in why]
                left = [(d, why) for d, why in left if f not in why]
                share[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in why for _, why in docs) - len(gone), sum(why == {f} for _, why in docs),
                    sum(d in good for d in gone), sum(d in toxic for d in gone),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(share[order[step - 1]])
    return out


def check(spark, docs, rows, labels):
    got = filter_audit.audit(filter_audit.failures(docs, spark.createDataFrame(labels, LABELS))).collect()
    want = by_hand(rows, labels)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want


def test_awkward_rows(spark):
    labels = [(4, 1, 0), (5, 0, 1), (5, 1, None), (None, 1, 1), (10, None, None), (99, 1, 1), (15, 1, 1)]
    check(spark, awkward(spark), ROWS, labels)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rows_with_many_copies(spark, seed):
    draw = random.Random(seed)
    hot = "Hot TEXT & more " * 60
    texts = [hot, None, "", "a b c", "# " + " ".join(map(str, range(250))), " ".join(map(str, range(250))), "A" * 300, "w " * 300, "é" * 10 + " X"]
    rows = [
        (draw.choice([None, i, i, i // 3]), hot if i % 3 == 0 else draw.choice(texts), draw.choice([None, "", "en", "de"]), "s", 0) for i in range(400)
    ]
    labels = [(draw.randint(0, 400), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(200)]
    check(spark, spark.createDataFrame(rows, SCHEMA), rows, labels)


def test_no_rows(spark):
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert filter_audit.audit(filter_audit.failures(empty(spark), labels)).collect() == []
    rows = [(1, "x", "en", "s", 1)]
    check(spark, spark.createDataFrame(rows, SCHEMA), rows, [])


def test_every_order_passes_each_level_once():
    for n in (1, 2, 5):
        edges = filter_audit.paths(n)
        assert len(edges) == n * 2 ** (n - 1)
        orders = len(list(permutations(range(n))))
        for level in range(n):
            assert sum(reach * leave for state, _, _, reach, leave in edges if state.bit_count() == level) == orders
        for f in range(n):
            assert sum(reach * leave for _, g, _, reach, leave in edges if g == f) == orders


def test_other_numbers_of_filters(spark):
    rows = spark.createDataFrame([("p", 1, 3, 1, 0), ("p", 3, 2, 0, 2), ("p", 0, 5, 5, 0), ("p", 1, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(rows, "XY").collect()}
    assert got == {
        ("XY", 1): (5, 6, 0, 4, 1, 2, 10), ("XY", 2): (5, 0, 2, 0, 0, 0, 2),
        ("YX", 1): (9, 2, 0, 0, 0, 2, 2), ("YX", 2): (5, 4, 2, 4, 1, 0, 10),
    }
