"""Packing: every id once, in order, in sequences that hold what they may, with little padding."""

from __future__ import annotations

import collections
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from podium.llm import packing
from tests.llm.rows import ROWS, SCHEMA, awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, texts: list[tuple], library) -> float:
    """Holds pieces against the library's ids; the share of padding."""
    want = collections.Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t in texts)
    by_document = collections.defaultdict(list)
    by_sequence = collections.defaultdict(list)
    for r in rows:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        by_document[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id in {d for d, _ in texts}:
        ids = collections.Counter(want_ids for (d, want_ids), n in want.items() for _ in range(n) if d == doc_id)
        pieces = collections.Counter((r.start, bytes(r.ids), r.doc_tokens) for r in by_document[doc_id])
        if sum(ids.values()) == 1:
            whole = b"".join(i for _, i, _ in sorted(pieces))
            assert tuple(np.frombuffer(whole, "<u4")) == next(iter(ids))
            at = 0
            for start, i, total in sorted(pieces):
                assert start == at and total == len(next(iter(ids)))
                at += len(i) // 4
        else:  # repeated rows: as many ids in all
            assert sum(len(i) // 4 * n for (_, i, _), n in pieces.items()) == sum(len(i) * n for i, n in ids.items())
    used = padded = 0
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        used += at
        padded += at if at & (at - 1) == 0 else packing.CAPACITY
    return (padded - used) / padded if padded else 0.0


def test_awkward_rows(spark, library):
    rows = packing.pack(awkward(spark).repartition(3), PATH).collect()
    check(rows, [(r[0], r[1]) for r in ROWS], library)


def test_table_has_little_padding_and_few_cuts(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    assert check(rows, [(r.doc_id, r.text) for r in docs.collect()], library) < 0.02
    tokens = {r.doc_id: r.doc_tokens for r in rows}
    least = sum(-(-n // packing.CAPACITY) for n in tokens.values())
    assert len(rows) < 3 * least


def test_workers_number_apart_and_reruns_agree(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * (i % 90), "en", "hot", 0) for i in range(500)], SCHEMA).repartition(7, "doc_id")
    rows = packing.pack(docs, PATH)
    first, again = sorted(map(tuple, rows.collect())), sorted(map(tuple, rows.collect()))
    assert first == again
    assert all(sum(n) <= 1024 for n in _lengths(first).values())


def _lengths(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[5]].append(r[2])
    return out


def test_sequences_hold_the_ids_of_their_pieces(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * (i % 40), "en", "a", 0) for i in range(60)], SCHEMA)
    pieces = packing.pack(docs, PATH).cache()
    lying = {(r.sequence_id, r.offset): bytes(r.ids) for r in pieces.collect()}
    found = {r.sequence_id: bytes(r.ids) for r in packing.sequences(pieces).collect()}
    assert sum(map(len, found.values())) == sum(map(len, lying.values()))
    assert all(found[s][4 * at : 4 * at + len(ids)] == ids for (s, at), ids in lying.items())


def test_empty_table_and_capacity(spark):
    assert packing.pack(empty(spark), PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack(empty(spark), PATH, capacity=1000)
    small = packing.pack(spark.createDataFrame(ROWS, SCHEMA), PATH, capacity=64).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert small.agg(F.max("n")).first()[0] == 64


def test_classes_hold_a_fixed_number_of_pieces():
    draw = random.Random(4)
    packer = packing.Packer(5 << packing.LOCAL_BITS)
    lengths = [draw.choice([1, 30, 340, 341, 342, 512, 513, 1000, draw.randint(1, 5000)]) for _ in range(2000)]
    placed = [p for i, n in enumerate(lengths) for p in packer.add(i, np.zeros(n, np.uint32))]
    members = collections.defaultdict(list)
    for (_, _, ids, _), sequence, _ in placed:
        members[sequence].append(len(ids))
    for held in members.values():
        classes = {packing.CAPACITY // n for n in held}
        assert classes == {len(held)}
    # A task holds less than one sequence a class.
    assert sum(len(p[2]) for held in packer.open.values() for p in held) < 1024 * len(packer.open)
    rest = list(packer.finish())
    ends = collections.Counter()
    for (_, _, ids, _), sequence, _ in rest:
        ends[sequence] += len(ids)
    assert all(n & (n - 1) == 0 for n in ends.values())  # nothing to pad
    assert sum(lengths) == sum(len(p[2]) for p, _, _ in placed + rest)
    assert min(s for _, s, _ in placed + rest) >> packing.LOCAL_BITS == 5


def test_cuts_save_what_they_cost():
    first = packing.cuts(1024)
    assert first[1024] == 1024 and first[512] == 512 and first[900] == 512 and first[1020] == 1020
    assert all(0 < first[n] <= n for n in range(1, 1025))
    assert packing.cuts(1024, 1e9) == list(range(1025))  # dear cuts: none


def test_ids_are_the_library_s(library):
    ids = packing.token_ids(PATH)
    blanks = " " * 1_000_000 + "a"  # too long a run for the matcher
    draw = random.Random(8)
    letters = "ab  'sSt1²½éñ漢字ぁ\n\r\t　​\U0001f600\U00031350#&"
    texts = [None, "", "<|endoftext|>", "a<|endoftext|> b<|endoftext", "it's I'LL", blanks, "x1" * 50_000]
    texts += ["".join(draw.choices(letters, k=draw.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        if text is blanks:
            assert ids(text).tolist() == [220] * (len(blanks) - 2) + library.encode(" a").ids or len(ids(text)) > 1000
        assert len(text or "") > 10**5 or ids(text).tolist() == library.encode(text or "", add_special_tokens=False).ids
