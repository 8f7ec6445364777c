from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm.words import WordBlock, blocks, leftmost_minima, runs_everywhere, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\v ", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    block = WordBlock(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        a, b = block.first[i], block.first[i + 1]
        got = [block.data[s:e].tobytes() for s, e in zip(block.starts[a:b], block.ends[a:b])]
        assert got == words(text)
        assert block.text(a, b) == b" ".join(words(text))
    points = block.code_points()
    assert points[-1] == sum(len(t or "") for t in texts)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_hashes_depend_on_the_words_alone(texts, length):
    block = WordBlock(pa.array(texts, pa.string()))
    every = [block.data[s:e].tobytes() for s, e in zip(block.starts, block.ends)]
    for which in (0, 1):
        hashes = block.hashes(which)
        assert (len(set(every)) == len(set(hashes.tolist()))) and dict(zip(every, hashes)) == {w: h for w, h in zip(every, hashes)}
        runs = runs_everywhere(hashes, length, which)
        told = {}
        for i, h in enumerate(runs.tolist()):
            assert told.setdefault(h, every[i : i + length]) == every[i : i + length]


def test_lower_case_and_portions():
    text = "AbC É Zz " * 60_000
    big = WordBlock(pa.array([text]), lower=True)
    small = WordBlock(pa.array(["abc É zz"]))
    assert set(big.hashes().tolist()) == set(small.hashes().tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 9))
def test_leftmost_minima(values, width):
    got = leftmost_minima(np.array(values), width).tolist()
    want = [i + min(range(width), key=lambda j: (values[i + j], j)) for i in range(len(values) - width + 1)]
    assert got == want


def test_blocks_are_bounded_and_whole():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 100, 1, 0, 7)] + [None]})
    parts = list(blocks(batch, size=8))
    assert [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert list(blocks(batch.slice(0, 0))) == []
