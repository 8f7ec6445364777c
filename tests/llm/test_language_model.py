from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from podium.llm import attention, language_model
from podium.llm.words import split
from tests.llm.rows import ROWS, awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF_DIR = "/root/testdata/sf0.01"


def expected(rows):
    """Base scores by the formula, for (doc_id, text) rows."""
    words = [(d, (t or "").encode().lower().split(), zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2) for d, t in rows]
    counts, ends = collections.Counter(), 0
    for _, w, out in words:
        if not out:
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    p = lambda c: math.log10((c + 1) / (n + v + 1))
    return [(d, out, len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), n, sum(p(counts[x]) for x in w) + p(ends)) for d, w, out in words]


def same(got, want):
    key = lambda r: (repr(r[0]), r[2], r[5])
    got, want = sorted((tuple(r)[:6] for r in got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


@pytest.fixture(scope="module")
def quick():
    patch = pytest.MonkeyPatch()
    patch.setattr(language_model, "STEPS", 40)
    yield
    patch.undo()


def test_base_is_exact_and_held_out_texts_are_likelier_under_the_model(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = language_model.scored(docs, PATH).collect()
    same(got, expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    # The base gives each unseen word a whole place, so it adds up to one over known words alone: there the model has to be better.
    held = [r for r in got if r.held_out and r.n_known == r.n_tokens]
    assert len(held) > 20 and all(r.score > r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def test_awkward_rows(spark, quick):
    got = language_model.scored(awkward(spark), PATH).collect()
    same(got, expected([(d, t) for d, t, *_ in ROWS]))
    scores = {(r.doc_id, r.n_tokens): r.score for r in got}
    assert all(math.isfinite(s) for s in scores.values()) and scores[2, 1] == scores[1, 1]


def test_nothing_learned_and_no_rows(spark, quick):
    assert language_model.scored(empty(spark), PATH).collect() == []
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(held_out, "a b c", "en", "s", 5)]
    got = language_model.scored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), PATH).collect()
    same(got, expected([(held_out, "a b c")]))


def small_model(seed=1):
    counts = np.zeros(500)
    counts[:400] = np.arange(400, 0, -1)
    words = attention.Vocabulary(counts)
    model = attention.Attention(500, words.prior, seed)
    draw = np.random.default_rng(seed)
    for name in ("near", "c1", "c2"):
        model.p[name] = draw.standard_normal(model.p[name].shape).astype(np.float32) * 0.3
    return model, words


def test_probabilities_add_up_to_one():
    model, words = small_model()
    x = model.vectors(np.arange(8), np.arange(8))[None]
    classes = np.exp([model.log_class(x, 0, np.full((1, 8), c)) for c in range(attention.CLASSES)]).sum(axis=0)
    used = np.bincount(words.of, minlength=attention.CLASSES) > 0
    assert np.allclose(classes, 1, atol=1e-5)
    assert np.allclose(np.bincount(words.of, weights=np.exp(words.inside), minlength=attention.CLASSES)[used], 1)


def test_windows_score_each_position_once_and_never_look_ahead():
    model, words = small_model()
    draw = np.random.default_rng(2)
    lengths = [0, 1, 5, 31, 32, 33, 48, 49, 200]
    first = np.concatenate([[0], np.cumsum(lengths)])
    ids = draw.integers(0, 500, first[-1] + 1)
    x = model.vectors(ids, ids)
    row, target = np.arange(first[-1]), ids[1:]
    got = attention.score(model, words, x, row, target, first)
    for i, n in enumerate(lengths):
        for j in range(n):
            # The window that scores position j: the first, or the one of whose later half it is part.
            begin = 0 if j < attention.WINDOW else (j // attention.STRIDE - 1) * attention.STRIDE
            seen = x[first[i] + begin : first[i] + j + 1][None]
            want = model.log_class(seen, seen.shape[1] - 1, words.of[target[None, first[i] + j : first[i] + j + 1]])[0, 0]
            assert abs(got[first[i] + j] - want - words.inside[target[first[i] + j]]) < 1e-4
    assert (got < 0).all()


def test_slopes_are_those_of_the_loss():
    model, words = small_model()
    model.p = {n: w.astype(np.float64) for n, w in model.p.items()}
    draw = np.random.default_rng(3)
    a, b, y = draw.integers(0, 500, (3, 4, 6))
    y = words.of[y]
    real = draw.random((4, 6)) < 0.8
    _, slopes = model.step(a, b, y, real)
    for name in model.p:
        g = slopes[name]
        if name in "ab":
            dense = np.zeros_like(model.p[name])
            np.add.at(dense, g[0], g[1])
            g = dense
        index = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept, e = model.p[name][index], 1e-4
        model.p[name][index] = kept + e
        up = model.step(a, b, y, real)[0]
        model.p[name][index] = kept - e
        down = model.step(a, b, y, real)[0]
        model.p[name][index] = kept
        assert abs((up - down) / (2 * e) - g[index]) < 2e-3 * max(1, abs(g[index])), name


def test_mixed_words_of_a_first_subword_add_up_to_one_at_most():
    """Seen words have their counted shares; all unseen ones together have the one place kept for them, shared out as the model spells them."""
    words = ["the", "then", "there", "theory", "thesis", "theme", "thermal"]
    counts = np.array([5, 2, 0, 1, 0, 0, 0])
    ids, first = language_model.parts_of(words, PATH)
    begins, goes_on, different = (np.zeros(language_model.TOKENS, dtype=np.int64) for _ in range(3))
    heads = ids[first[:-1]]
    for head, n in zip(heads, counts, strict=True):
        begins[head] += n
        different[head] += n > 0
    goes_on[language_model.END] = counts.sum()
    model = language_model.Model(PATH, begins, goes_on, different)
    _, _, logs = model.inside_words(words, counts)
    zeros = model.inside_words(words, np.zeros_like(counts))[2]
    for head in np.unique(heads):
        mine = heads == head
        places = begins[head] + different[head] + 1
        seen = counts[mine] > 0
        spelled = np.exp(zeros[mine] - np.log((1 - language_model.INNER_WEIGHT) / places + language_model.INNER_WEIGHT))
        assert spelled.sum() <= 1 + 1e-6
        want = np.where(seen, (1 - language_model.INNER_WEIGHT) * (counts[mine] + 1) / places, (1 - language_model.INNER_WEIGHT) / places * spelled)
        assert np.allclose(np.exp(logs[mine]), want + language_model.INNER_WEIGHT * spelled)
        assert np.exp(logs[mine]).sum() <= 1 + 1e-6


def test_many_unseen_words_share_one_place():
    """Thousands of words that nobody counted do not add up to more than what is kept for them."""
    draw = np.random.default_rng(1)
    words = sorted({"".join(draw.choice(list("abcdefghij"), size=draw.integers(2, 7))) for _ in range(4000)})
    nothing = np.zeros(language_model.TOKENS, dtype=np.int64)
    model = language_model.Model(PATH, nothing, nothing, nothing)
    head, _, logs = model.inside_words(words, np.zeros(len(words), dtype=np.int64))
    assert np.bincount(head, weights=np.exp(logs)).max() <= 1 + 1e-6


def fresh_model(texts):
    words = sorted({w for t in texts for w in t.split()})
    ids, first = language_model.parts_of(words, PATH)
    begins, goes_on, different = (np.zeros(language_model.TOKENS, dtype=np.int64) for _ in range(3))
    begins[ids[first[:-1]]] = 1
    begins[language_model.END] = goes_on[language_model.END] = len(texts)
    return language_model.Model(PATH, begins, goes_on, different)


@pytest.fixture
def learning(spark, monkeypatch):
    """What the trainers learn from, put down in files by the tasks of a run whose start knows no text."""
    monkeypatch.setattr(language_model, "STEPS", 0)

    def run(texts, rows=None):
        rows = rows or [(i, t) for i, t in zip((i for i in range(10**6) if zlib.crc32(str(i).encode()) % 7 != 2), texts, strict=False)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        frame = docs.select("doc_id", language_model.held_out().alias("held_out"), "text")
        counts = language_model.coded(language_model.word_counts(frame), PATH).cache()
        totals = counts.agg({"n": "sum"}).first()[0]
        model = fresh_model([t for _, t in rows])
        before = {net: {n: w.copy() for n, w in getattr(model, net).p.items()} for net in ("outer", "inner")}
        language_model.learned(model, frame, counts, totals, counts.count())
        return {net: np.flatnonzero((getattr(model, net).p["a"] != before[net]["a"]).any(axis=1)) for net in before}

    return run


def test_every_training_text_and_word_moves_the_weights(learning):
    """700 texts, more than the start has, and a long one: the subwords of each are learned from, those of held-out texts are not."""
    draw = np.random.default_rng(4)
    words = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), size=6)) for _ in range(3000)]
    texts = [" ".join(words[i * 4 : i * 4 + 4]) for i in range(700)] + [" ".join(words[2800:2990] * 20)]
    held = next(i for i in range(10**6, 10**6 + 100) if zlib.crc32(str(i).encode()) % 7 == 2)
    ids = [i for i in range(10**4) if zlib.crc32(str(i).encode()) % 7 != 2]
    moved = learning(None, [*zip(ids, texts, strict=False), (held, "\u4e2d\u6587 \u0436\u0443\u043a")])
    seen, first = language_model.parts_of(words[:2990], PATH)
    assert set(moved["outer"]) == set(seen[first[:-1]]) | {language_model.END}
    assert set(moved["inner"]) == set(seen)


def test_windows_hold_every_word_and_end_once():
    first = np.array([0, 0, 3, 50, 50, 51])
    head, tail = np.arange(1, 52), np.arange(101, 152)
    a, b, y, real = (v.ravel() for v in language_model.windows(first, head, tail))
    end = language_model.END
    want = [w for i in range(5) for w in [*head[first[i] : first[i + 1]], end]]
    assert y[real].tolist() == want
    assert a[real].tolist() == [w for i in range(5) for w in [end, *head[first[i] : first[i + 1]]]]
    assert b[real].tolist() == [w for i in range(5) for w in [end, *tail[first[i] : first[i + 1]]]]


def test_words_within_are_learned_whole_and_by_their_counts(monkeypatch):
    """Long words in several pieces, frequent ones in several batches: their weights add up to the counts of every subword."""
    words, counts = ["the", "interdenominationalistically" * 3, "cat", "dogs"], [100_000, 3, 1, 7]
    trainer = language_model.InnerTrainer(fresh_model(words))
    got = collections.Counter()

    def learn(a, b, target, weight):
        for i, n in zip(a.ravel().tolist(), weight.ravel().tolist(), strict=True):
            got[i] += n

    monkeypatch.setattr(trainer.adam, "learn", learn)
    monkeypatch.setattr(language_model, "TASK_WORDS", 2)
    trainer.learn(*language_model.parts_of(words, PATH), np.array(counts))
    trainer.flush()
    want = collections.Counter()
    for word, n in zip(words, counts, strict=True):
        for i in language_model.parts_of([word], PATH)[0].tolist():
            want[i] += n
    assert {i: n for i, n in got.items() if n} == pytest.approx(dict(want))


def test_trainers_are_averaged_by_what_they_learned_from():
    model = fresh_model(["a b c"])
    found = []
    for shift, seen, rows in ((1.0, 3, [5, 9000]), (5.0, 1, [5])):
        own = language_model.copy.deepcopy(model)
        own.outer.p["a"][rows] += np.float32(shift)
        found += language_model.moves("outer ", model.outer, own.outer, seen).to_pylist()
    table = language_model.pa.Table.from_pylist(found, language_model.MOVED)
    parts = {p: table.filter(language_model.pc.equal(table.column("part"), p)) for p in (0, 9000 // language_model.PART_ROWS)}
    means = {}
    for part in parts.values():
        row = language_model.mean_moves(part).to_pylist()[0]
        means.update(zip(np.frombuffer(row["rows"], "<i4").tolist(), np.frombuffer(row["moves"], "<f4").reshape(-1, attention.SIZE)[:, 0].tolist(), strict=True))
    assert means == pytest.approx({5: 2.0, 9000: 1.0}, rel=1e-5)


def test_many_words_are_encoded_by_few_calls(monkeypatch):
    """Subwords are those of each word by itself, also beside words with blanks of other kinds; 20,000 words take no call for each."""
    draw = np.random.default_rng(6)
    letters = list("abcthe'sllred019!?#-_.|<>\x7f\x1c\xa0\u3000\u00e9\u00f1\u4e2d")
    words = ["".join(draw.choice(letters, size=draw.integers(1, 9))) for _ in range(3000)] + ["'s", "'", "<|endoftext|>", "a" * 5000, "\u00a0", "x\u00a0", "\u2003y"]
    encoder = language_model.subwords(PATH)
    ids, first = language_model.parts_of(words, PATH)
    assert [ids[s:e].tolist() for s, e in zip(first, first[1:], strict=False)] == [encoder.encode_ordinary(" " + w) for w in words]
    assert [len(x) for x in language_model.parts_of([], PATH)] == [0, 1]
    calls = collections.Counter()
    for name in ("encode_ordinary", "encode_to_numpy"):
        kept = getattr(encoder, name)
        monkeypatch.setattr(encoder, name, lambda *a, name=name, kept=kept, **b: (calls.update([name]), kept(*a, **b))[1])
    language_model.parts_of([f"word{i}" for i in range(20_000)], PATH)
    assert sum(calls.values()) <= 20


def test_sums_by_row_are_those_of_each_id():
    draw = np.random.default_rng(7)
    ids, values = draw.integers(0, 50, 1000).astype(np.uint16), draw.standard_normal((1000, 4)).astype(np.float32)
    rows, sums = attention._sums_by_row(ids, values)
    assert rows.tolist() == sorted(set(ids.tolist())) and sums.dtype == values.dtype
    assert np.allclose(sums, [values[ids == i].sum(axis=0) for i in rows], atol=1e-5)


def test_words_of_texts_are_those_between_the_six_blanks():
    texts = ["", " ", "a", "  The\tthe\n\x0b\x0c\rTHE ", "Äb c \x1c\x1d  ", "a\x00b 中文 \U0001f600X", "x  y", ""]
    words, first = split(pa.array(["left out", *texts], pa.string()).slice(1))
    assert [[w.encode() for w in words[s:e].to_pylist()] for s, e in zip(first, first[1:], strict=False)] == [t.encode().lower().split() for t in texts]
    assert split(pa.array([], pa.string()))[1].tolist() == [0]


@pytest.mark.parametrize("n_parts", [1, 7, 5000])
def test_a_block_asks_each_part_once_and_is_told_of_every_word(monkeypatch, n_parts):
    """A row for each part that has words of the block, not one for each word, and for each word what is known of it, whatever the order of the rows; also where hashes are alike."""
    texts = [" ".join(f"w{i}" for i in range(s, 3000, s)) for s in (1, 2, 3)] + ["", "é 中"]
    words = sorted({w for t in texts for w in t.split(" ") if w} | {"elsewhere"})
    for alike in (False, True):
        if alike:
            monkeypatch.setattr(language_model.WordBlock, "hashes", lambda self: np.zeros(len(self.starts), np.uint64) + 3)
        of = language_model.in_parts(pa.array(words), n_parts)
        part = dict(zip(of[0].tolist(), of[1].tolist(), strict=True))
        blocks = {b: pa.table({"block": pa.array([b] * len(t), pa.int32()), "text": t}) for b, t in {4: texts, 9: texts[:2], 2: ["", " "]}.items()}
        asked = pa.concat_tables([language_model.ask(t, n_parts) for t in blocks.values()])
        assert len({(r["part"], r["block"]) for r in asked.to_pylist()}) == asked.num_rows <= min(n_parts, 3000) * 2
        told = []
        for p in set(asked.column("part").to_pylist()):
            mine = [i for i in range(len(words)) if part[i] == p]
            known = pa.table({"word": [words[i] for i in mine], "n": mine, "head": [i + 1 for i in mine], "tail": [i + 2 for i in mine], "rest": [-0.5 * i for i in mine]})
            told.append(language_model.tell(asked.filter(language_model.pc.equal(asked.column("part"), p)), known))
        told = pa.concat_tables(told[::-1])
        for b, table in blocks.items():
            different = split(table.column("text").combine_chunks().take(pa.array(range(table.num_rows))[::-1]))[0].unique()
            n, head, tail, rest = language_model.facts_of(told.filter(language_model.pc.equal(told.column("block"), b)), different, n_parts)
            assert [words[i] for i in n] == different.to_pylist()
            assert (head == n + 1).all() and (tail == n + 2).all() and (rest == -0.5 * n).all()


def test_words_are_counted_in_parts_and_flushes(spark, monkeypatch):
    """Counts of a word that is held more than once, in many parts, and with 0 of held-out texts alone."""
    monkeypatch.setattr(language_model, "HELD_WORDS", 10)
    rows = [(i % 5 == 0, f"The word{i % 7} only{i}  ") for i in range(60)]
    frame = spark.createDataFrame(rows, "held_out boolean, text string").repartition(3)
    want = collections.Counter({w: 0 for _, t in rows for w in t.lower().split()})
    want.update(w for out, t in rows for w in t.lower().split() if not out)
    for n_parts in (1, 11):
        got = language_model.coded(language_model.word_counts(frame, n_parts), PATH).collect()
        assert [[*np.frombuffer(r.ids, "<u2")] for r in got] == [language_model.subwords(PATH).encode_ordinary(" " + r.word) for r in got]
        assert len(got) == len(want) and {r.word: r.n for r in got} == dict(want)


def test_each_stage_has_one_python_worker_for_a_task(spark):
    """No Python step hands its rows to another in one stage: each would have a worker of its own, and all stay in memory."""
    rows = spark.createDataFrame([(False, "a b")], "held_out boolean, text string")
    plan = language_model.coded(language_model.word_counts(rows), PATH)._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.split("Initial Plan")[0].splitlines() if "InArrow" in line or "Exchange" in line]
    assert ["Exchange" in line for line in steps] == [False, True, False], plan
