from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm import fingerprints as ops
from podium.llm.words import WordBlock, runs_everywhere
from tests.llm.rows import ROWS, SCHEMA, awkward, empty, prose


def plain_print(text):
    """Votes counted one term and bit at a time, from the same term hashes."""
    block = WordBlock(pa.array([text]))
    hashes = [block.hashes(0), block.hashes(1)]
    terms = [(int(a), int(b), min(8, int(n))) for a, b, n in zip(*hashes, block.ends - block.starts)]
    terms += [(int(a), int(b), 8) for a, b in zip(*[runs_everywhere(h, 5, i) for i, h in enumerate(hashes)])]
    out = []
    for part in (0, 1):
        votes = [sum(w if t >> (63 - i) & 1 else -w for t, w in ((x[part], x[2]) for x in terms)) for i in range(64)]
        out.append(sum(1 << (63 - i) for i, v in enumerate(votes) if v > 0))
    return tuple(out)


def shown(print_):
    return "%016x%016x" % tuple(map(int, print_))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abc é\t", max_size=40), max_size=5))
def test_votes(texts):
    got = ops.fingerprints(pa.array(texts, pa.string()))
    assert [tuple(map(int, r)) for r in got] == [plain_print(t) for t in texts]


def test_votes_of_many_terms():
    texts = [prose(1, 40_000), "", prose(2, 3), prose(3, 33_000)]
    got = ops.fingerprints(pa.array(texts))
    for text, row in zip(texts, got):
        assert tuple(map(int, ops.fingerprints(pa.array([text]))[0])) == tuple(map(int, row))


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    prints = [plain_print(r[1] or "") for r in order]
    out = {}
    for i, (doc_id, text, *_) in enumerate(order):
        j = (i + 1) % len(order)
        text, other = text or "", order[j][1] or ""
        k = len(text) // 3
        changed = text[: len(text) - k] + other[:k]
        new = plain_print(changed)
        near = lambda a, b: 1 - sum((x ^ y).bit_count() for x, y in zip(a, b)) / 128
        close = sum(sum((x ^ y).bit_count() for x, y in zip(prints[i], p)) <= 3 for p in prints) - 1
        out[doc_id] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), shown(prints[i]), shown(new), near(prints[i], new), near(prints[i], prints[j]), close)
    return out


@pytest.mark.parametrize("n", [1, 2, 90])
def test_edits_follow_the_order_across_tasks(spark, n):
    draw = random.Random(n)
    rows = [(i * 3, draw.choice([None, "", "é", prose(i, draw.randint(1, 60)), prose(7, 50)]), "en", "s", 0) for i in range(n)]
    draw.shuffle(rows)
    rows[0] = (None, "without an id " + prose(8, 9), "en", "s", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ops.fingerprinted(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == n
    assert {r[0]: tuple(r)[1:] for r in got} == expected(rows)


def test_pairs_within_a_radius(spark):
    draw = random.Random(4)
    prints = set()
    for _ in range(25):
        base = draw.getrandbits(128)
        for _ in range(8):
            prints.add(base ^ sum({1 << draw.randrange(128) for _ in range(draw.randint(0, 5))}))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    values = [(signed(p >> 64), signed(p & (2**64 - 1))) for p in prints]
    frame = spark.createDataFrame(values, "fp1 long, fp2 long")
    for radius in (1, 3, 4):
        got = [tuple(r) for r in ops.within(frame, radius).collect()]
        want = set()
        for a in values:
            for b in values:
                d = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b))
                if a < b and d <= radius:
                    want.add((*a, *b, d))
        assert set(got) == want and len(got) == len(want)


def test_likeness_follows_the_overlap():
    text, other = prose(1, 300), prose(2, 300)
    own, near, far = ops.fingerprints(pa.array([text, ops.edited(text, other), other]))
    assert 1.0 > ops.likeness(own[None], near[None])[0] > 0.65 > ops.likeness(own[None], far[None])[0] + 0.05
    assert np.array_equal(*ops.fingerprints(pa.array([text, text])))


def test_awkward_rows(spark):
    got = ops.fingerprinted(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        texts = [t or "" for d, t, *_ in ROWS if d == r.doc_id]
        assert r.fingerprint in {shown(plain_print(t)) for t in texts} and r.n_chars in {len(t) for t in texts}
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 32}


def test_empty_table(spark):
    assert ops.fingerprinted(empty(spark)).collect() == []
