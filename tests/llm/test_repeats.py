"""Both operators on repeated passages against looking at every window."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from podium.llm import passages, recurring, suffixes
from tests.llm.rows import ROWS, SCHEMA, awkward, empty, prose


def ordered(rows):
    """Documents in the order of ids, null first; rows that repeat id and text once. Ids in these tests have one text each."""
    return sorted({(d, t) for d, t, *_ in rows}, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None))


def covered(rows, length):
    """For each document its words and which are in a window that starts earlier."""
    seen, out = set(), []
    for doc_id, text in ordered(rows):
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(w for *_, w in words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        out.append((doc_id, words, gone))
    return out


def removed(rows):
    out, times = [], Counter((d, t) for d, t, *_ in rows)
    for document, (doc_id, words, gone) in zip(ordered(rows), covered(rows, passages.WINDOW), strict=True):
        kept = " ".join(w for (*_, w), g in zip(words, gone) if not g)
        out += [(doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] * times[document]
    return sorted(map(repr, out))


def marks(rows):
    """Code points of each document in a repeated passage."""
    out = {}
    for doc_id, words, gone in covered(rows, suffixes.MATCH_WORDS):
        points, previous = set(), False
        for i, ((s, e, _), g) in enumerate(zip(words, gone)):
            if g:
                points |= set(range(s, e))
        if points:
            out[doc_id] = points
    return out


def made(seed):
    """Copies, near copies, shared passages at both ends and inside, periodic texts, one window more or less."""
    draw = random.Random(seed)
    shared = [prose(seed * 10 + i, draw.choice([19, 20, 21, 49, 50, 51, 120])) for i in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(seed * 1000 + i, draw.randint(0, 40), 50)]
        for _ in range(draw.randint(0, 3)):
            piece = draw.choice(shared).split()
            a = draw.choice([0, 0, draw.randint(0, len(piece))])
            parts += [draw.choice([" ", "\n", "\t\t"]).join(piece[a:]), prose(draw.randint(0, 10**6), draw.randint(0, 5))]
        if draw.random() < 0.2:
            parts.append("a b " * draw.randint(5, 60))
        text = " ".join(parts)
        rows.append((draw.choice([i, i + 1000]), text, "en", "s", 0))
    rows += [(d + 5000, t, *rest) for d, t, *rest in rows[:15]]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [300, 1 << 22])
def test_made_texts(spark, monkeypatch, seed, block):
    monkeypatch.setattr(recurring, "BLOCK_CHARS", block * 10)
    monkeypatch.setattr(passages, "SHARD_WORDS", 40)
    rows = made(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = passages.remove_repeats(docs).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == removed(rows)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)
    check_spans(rows, suffixes.repeated_passages(docs).collect())


def check_spans(rows, spans):
    texts = dict(ordered(rows))
    words = {d: (t or "").encode().split() for d, t in texts.items()}
    found = {}
    for r in spans:
        piece = texts[r.doc_id][r.begins : r.ends]
        assert piece.encode().split() == words[r.of_doc_id][r.of_word : r.of_word + r.n_words] and r.n_words >= 50
        found.setdefault(r.doc_id, set()).update(m for w in re.finditer(r"[^\x20\x09-\x0D]+", piece) for m in range(r.begins + w.start(), r.begins + w.end()))
    assert found == marks(rows)


def test_awkward_rows(spark):
    got = passages.remove_repeats(awkward(spark)).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == removed(ROWS)
    spans = suffixes.repeated_passages(awkward(spark)).collect()
    by_id = {}
    for r in spans:
        by_id.setdefault(r.doc_id, []).append(r)
    assert set(by_id) == {5, 8, 9, 15}
    assert [(r.of_doc_id, r.n_words) for r in by_id[5]] == [(4, 20_000)]
    assert {r.of_doc_id for r in by_id[9]} == {None}


def test_repeated_rows_have_a_result_each(spark):
    rows = [(None, prose(3, 30), "en", "hot", 0)] * 40 + [(i, prose(3 + i % 2, 30), "en", "s", 0) for i in range(1, 9)] + [(1, prose(4, 30), "en", "s", 0)] * 3
    got = passages.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == removed(rows)
    assert len(got) == len(rows)


def test_rows_without_text_fill_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(recurring, "BLOCK_CHARS", 1 << 14)
    docs = spark.range(2000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    corpus = recurring.Corpus(docs, "blocks")
    assert corpus.n_blocks == 32
    assert corpus.blocks.groupBy("block").count().agg({"count": "max"}).first()[0] < 200


def test_empty_table(spark):
    assert passages.remove_repeats(empty(spark)).collect() == []
    assert suffixes.repeated_passages(empty(spark)).collect() == []


def test_a_shared_window_retains_a_shared_run():
    import pyarrow as pa

    from podium.llm.words import WordBlock

    text = prose(5, 50)
    for length, k in ((passages.WINDOW, passages.RUN), (suffixes.MATCH_WORDS, suffixes.PREFIX_WORDS)):
        window = " ".join(text.split()[:length])
        alone = set(recurring.retained_hashes(pa.array([window]), length, k).tolist())
        assert len(alone) == 1
        for i in range(10):
            inside = f"{prose(i, 30)} {window} {prose(i + 50, 30)}"
            assert alone <= set(recurring.retained_hashes(pa.array([inside]), length, k).tolist())
        block = WordBlock(pa.array([window]))
        starts, chosen, _ = recurring.retained(block, length, k)
        assert starts.tolist() == [0] and 0 <= chosen[0] <= length - k
