from __future__ import annotations

import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm import simhash_links as ops
from podium.llm.components import connected
from tests.llm.rows import ROWS, awkward, empty


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbB é\t\n", max_size=40))
def test_fingerprint(text):
    assert ops.fingerprint(text) == plain_fingerprint(text)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_pairs_against_all_pairs(spark):
    draw = random.Random(1)
    prints = {0, 2**64 - 1}
    for _ in range(40):
        base = draw.getrandbits(64)
        for _ in range(8):
            prints.add(base ^ sum({1 << draw.randrange(64) for _ in range(draw.randint(0, 3))}))
    for i in range(20):  # many in one segment
        prints.add(0xABCD << (16 * (i % 4)) ^ i)
    values = sorted(map(signed, prints))
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for radius in (1, 2):
        want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
        got = [tuple(r) for r in ops.near_pairs(frame, radius).collect()]
        assert set(got) == want and len(got) == len(want)


def test_components(spark):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(draw.randint(200, 260), draw.randint(200, 260)) for _ in range(40)]
    links += [(7, 7), (1, 0)]
    root = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= (root[a], root[b]) != (low, low)
            root[a] = root[b] = low
    got = connected(spark.createDataFrame(links, "a long, b long")).collect()
    alone = {x for x in root if all(a == b for a, b in links if x in (a, b))}
    assert {(r.node, r.root) for r in got} == {(x, r) for x, r in root.items() if x not in alone}
    assert len(got) == len({r.node for r in got})


def test_awkward_rows_against_all_pairs(spark):
    got = ops.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    prints = [plain_fingerprint(t) for _, t, *_ in ROWS]
    group = list(range(len(ROWS)))
    for _ in ROWS:
        for i in group[:]:
            for j in range(len(ROWS)):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    group[j] = group[i] = min(group[i], group[j])
    want = []
    for i, (doc_id, *_) in enumerate(ROWS):
        ids = [r[0] for j, r in enumerate(ROWS) if group[j] == group[i] and r[0] is not None]
        want.append((doc_id, f"{prints[i]:016x}", min(ids, default=None)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_one_document_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = ops.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert ids == sorted({r.component_id for r in ops.near_duplicates(docs).collect()})
    assert {1, 4, 6, 7, 10, 11} <= set(ids) and not {2, 3, 5, 12} & set(ids)
    assert kept.filter("doc_id = 4").first().text == ROWS[5][1]


def test_empty_table(spark):
    assert ops.near_duplicates(empty(spark)).collect() == []
    assert ops.drop_near_duplicates(empty(spark)).collect() == []
