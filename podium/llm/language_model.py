"""Language-model scores of whole texts: a unigram base, and a causal self-attention model on subword ids.

A text is words and one end. The model predicts a word's first subword from the words before it, and each further subword, or the word's
end, from the subwords before it in the word: two masks of the same kind of model (podium.llm.attention). What is inside a word does not depend on where
it stands, so it is scored once for each word of the corpus and not for each occurrence. There the attention model is mixed, with the fixed weight INNER_WEIGHT,
with the share the word has among the training words of its first subword, each counted once more and one place kept for all unseen words, which the attention
model shares out among them.

Word counts cover all training documents, and so do the subword counts within the models' classes and the models' weights: they only start from a bounded
sample, on the driver, and learn in tasks from every word of every training text, and from every counted word's subwords by its count. The trainers start from the same
weights and are averaged. Documents are dealt into blocks and counted words into parts; a block asks each part once for all of its words that are there.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podium.llm.attention import WINDOW, Adam, Attention, Vocabulary, score, train
from podium.llm.words import WordBlock, blocks, split
from podium.sources.scratch import stage

SAMPLE_ROWS, SAMPLE_CHARS = 600, 8192  # texts the weights start from: how many, and of longer ones how much, from a place chosen by hash
TRAINER_WORDS = 8_000_000  # what a task that trains learns from, about
TASK_WINDOWS, TASK_WORDS = 192, 2048  # in a step of such a task
WINDOWS_AT_ONCE, DIFFERENT_AT_ONCE = 16_384, 100_000  # windows, and different words, that are shuffled together
PART_ROWS = 4096
KNOWN_WORDS = 4_000_000  # whose subwords a task that trains keeps
STEPS, WINDOWS_A_STEP, WORDS_A_STEP, WORD_PARTS = 400, 48, 384, 8
BLOCK_CHARS, PART_CHARS = 4 << 20, 8 << 20  # of text, in a block and for a part of the counted words
ROW_CHARS = 256  # what a row counts besides its text, so that many empty texts are many blocks too
WORDS_AT_ONCE = 4096  # that are encoded in one call
HELD_WORDS = 500_000  # that a counting task holds, different ones of each portion of text
PIECES = ((0, 2), (2, 3), (3, 4), (4, 6), (6, WORD_PARTS))  # lengths of pieces of words that are learned from together
END = 50_256  # the vocabulary's free id: the end of a text, its beginning, and the end of a word
TOKENS = END + 1
INNER_WEIGHT = 0.1  # of the attention model within words, against counted words
LOG10 = np.log(10.0)


@lru_cache(maxsize=2)
def subwords(path: str):
    """The encoder of a rank file of the tiktoken library."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def blank_first(path: str) -> np.ndarray:
    """Of each id, whether its bytes begin with a blank."""
    encoder = subwords(path)
    return np.array([encoder.decode_single_token_bytes(i)[:1] == b" " for i in range(encoder.n_vocab)])


def parts_of(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of all words one after the other, and where each word's begin. A word is encoded as after a blank."""
    encoder, begins = subwords(path), blank_first(path)
    # Between words that hold no blanks of any kind the pattern always cuts, so many are encoded at once. Only a word's first subword holds its blank.
    plain = np.ones(len(words), dtype=bool)
    for at in range(0, len(words), WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE]
        if " ".join(part).split() != part:
            plain[at : at + len(part)] = [w.split() == [w] for w in part]
    lengths = np.zeros(len(words), dtype=np.int64)
    some = np.flatnonzero(plain)
    found = []
    for at in range(0, len(some), WORDS_AT_ONCE):
        part = some[at : at + WORDS_AT_ONCE]
        ids = encoder.encode_to_numpy(" " + " ".join([words[i] for i in part]), disallowed_special=()).astype(np.int64)
        lengths[part] = np.diff(np.append(np.flatnonzero(begins[ids]), len(ids)))
        found.append(ids)
    rest = np.flatnonzero(~plain)
    lists = [encoder.encode_ordinary(" " + words[i]) for i in rest]
    lengths[rest] = [len(x) for x in lists]
    first = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(lengths, out=first[1:])
    out = np.empty(first[-1], dtype=np.int64)
    is_plain = np.repeat(plain, lengths)
    out[is_plain] = np.concatenate([*found, np.zeros(0, np.int64)])
    out[~is_plain] = [i for x in lists for i in x]
    return out, first


def coded(counts: DataFrame, path: str) -> DataFrame:
    """Each word of :func:`word_counts` once, with ``n`` and ``ids``, its subwords as little-endian unsigned 16-bit integers, so that they are found once. Each part of the
    words is added up in one task."""

    def run(table: pa.Table) -> pa.Table:
        words = pc.split_pattern(table.column("words").combine_chunks(), "\n").flatten()
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), "<i8")
        found = added_up([pa.table([words, pa.array(n)], ["word", "n"])])
        # By hash: whatever the order in which they come.
        found = found.take(pa.array(in_parts(found.column("word").combine_chunks(), 1)[0]))
        ids, first = parts_of(found.column("word").to_pylist(), path)
        return found.append_column("ids", binaries(ids.astype("<u2"), first))

    return counts.groupBy("part").applyInArrow(run, "word string, n long, ids binary")


def parts_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`parts_of` gave for the words of a column ``ids``."""
    first = np.zeros(len(column) + 1, dtype=np.int64)
    np.cumsum(np.asarray(pc.binary_length(column)) // 2, out=first[1:])
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").astype(np.int64), first


def held_out(doc_id: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """Whether the crc32 of the id's text leaves ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def in_parts(words: pa.Array, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Different words by the parts that they are in, always in the same order: their places, and their parts."""
    hashes = WordBlock(words).hashes()
    order = np.argsort(hashes)
    if (np.diff(hashes[order]) == 0).any():
        order = np.asarray(pc.sort_indices(words)).astype(np.int64)
    parts = (hashes % np.uint64(n_parts)).astype(np.int32)[order]
    by_part = np.argsort(parts, kind="stable")
    return order[by_part], parts[by_part]


def in_lines(words: pa.Array, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The places of :func:`in_parts`, where in them each part begins and the last ends, the parts, and each part's words, one on each line."""
    order, parts = in_parts(words, n_parts)
    begin = np.append(np.flatnonzero(np.diff(parts, prepend=-1)), len(parts))
    lists = pa.LargeListArray.from_arrays(pa.array(begin), words.take(pa.array(order)))
    return order, begin, parts[begin[:-1]], pc.binary_join(lists, "\n")


def binaries(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes of values[begin[i]] to values[begin[i + 1]], for each i."""
    offsets = pa.py_buffer((begin * values.itemsize).astype("<i4").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, offsets, pa.py_buffer(values.tobytes())])


def word_counts(rows: DataFrame, n_parts: int = 8) -> DataFrame:
    """What tasks count: of each ``part`` its ``words``, one on each line, and ``n``, how often training texts hold each, as little-endian 64-bit integers; also words of
    held-out texts alone, with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> pa.RecordBatch:
            found = added_up(held)
            held.clear()
            order, begin, parts, lines = in_lines(found.column("word").combine_chunks(), n_parts)
            counts = np.asarray(found.column("n")).astype("<i8")[order]
            return pa.RecordBatch.from_arrays([pa.array(parts), lines, binaries(counts, begin)], ["part", "words", "n"])

        for batch in batches:
            for part in blocks(batch):
                for used in (True, False):
                    found = split(part.filter(pc.equal(part.column("held_out"), not used)).column("text"))[0].value_counts()
                    n = np.asarray(found.field("counts")) * used
                    held.append(pa.table([found.field("values"), pa.array(n, pa.int64())], ["word", "n"]))
                if sum(table.num_rows for table in held) >= HELD_WORDS:
                    yield flush()
        if held:
            yield flush()
        give_back()

    return rows.select("text", "held_out").mapInArrow(run, "part int, words string, n binary")


def give_back() -> None:
    """What Arrow keeps of freed memory: a worker goes on to other tasks, which may need it for other things."""
    pa.default_memory_pool().release_unused()


def added_up(tables: list[pa.Table]) -> pa.Table:
    """Each word once, with the sum of its counts."""
    found = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.table([found.column("word"), found.column("n_sum")], ["word", "n"])


def subword_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of :func:`coded` counts: how often each subword begins a word of the training texts, how often it goes on within one (END: how often one ends), and how many different
    words begin with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3 * TOKENS, dtype=np.int64)
        for batch in batches:
            n = np.asarray(batch.column("n"))
            ids, first = parts_in(batch.column("ids"))
            heads = np.zeros(len(ids), dtype=bool)
            heads[first[:-1]] = True
            weight = np.repeat(n, np.diff(first))
            sums += np.bincount(np.where(heads, ids, ids + TOKENS), weights=weight, minlength=3 * TOKENS).astype(np.int64)
            sums[TOKENS + END] += n.sum()
            sums[2 * TOKENS :] += np.bincount(ids[heads], minlength=TOKENS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["slot", "n"])

    found = counts.filter("n > 0").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    sums = np.zeros(3 * TOKENS, dtype=np.int64)
    for row in found.collect():  # three for each id of the vocabulary at most
        sums[row["slot"]] = row["n"]
    return sums[:TOKENS], sums[TOKENS : 2 * TOKENS], sums[2 * TOKENS :]


class Model:
    """Both masks' weights and the counts of the training texts. Small: it goes to the tasks as it is."""

    def __init__(self, path: str, begins: np.ndarray, goes_on: np.ndarray, different: np.ndarray):
        self.path, self.begins, self.different = path, begins, different
        self.outer_words, self.inner_words = Vocabulary(begins), Vocabulary(goes_on)
        self.outer = Attention(TOKENS, self.outer_words.prior, 1)
        self.inner = Attention(TOKENS, self.inner_words.prior, 2)

    def train(self, texts: list[str], steps: int = STEPS, seed: int = 3) -> None:
        draw = np.random.default_rng(seed)
        every = [[w.decode() for w in t.encode().lower().split()] for t in texts]
        different = sorted({w for words in every for w in words})
        if not different:
            return
        number = {w: i for i, w in enumerate(different)}
        ids, first = parts_of(different, self.path)
        head, tail = ids[first[:-1]], ids[first[1:] - 1]
        flat = [np.array([number[w] for w in words], dtype=np.int64) for words in every]
        a = np.concatenate([np.concatenate([[END], head[f]]) for f in flat])
        b = np.concatenate([np.concatenate([[END], tail[f]]) for f in flat])
        y = np.concatenate([np.concatenate([head[f], [END]]) for f in flat])
        y = self.outer_words.of[y]
        # Windows may reach into the next text; its beginning is marked by END.
        span = np.arange(min(WINDOW, len(a)))

        def outer_batches() -> Iterator[tuple[np.ndarray, ...]]:
            for _ in range(steps):
                at = draw.integers(0, len(a) - len(span) + 1, WINDOWS_A_STEP)[:, None] + span
                yield a[at], b[at], y[at], np.ones(at.shape, dtype=bool)

        train(self.outer, outer_batches())
        used = np.concatenate(flat)
        following = np.append(ids[1:], END)
        following[first[1:] - 1] = END
        z = self.inner_words.of[following]

        def inner_batches() -> Iterator[tuple[np.ndarray, ...]]:
            for _ in range(steps):
                word = used[draw.integers(0, len(used), WORDS_A_STEP)]
                # Of words with more subwords than fit, a stretch from anywhere in them; its first one always begins the word's context.
                skip = (draw.random(len(word)) * np.maximum(1, first[word + 1] - first[word] - WORD_PARTS + 1)).astype(np.int64)
                at = (first[word] + skip)[:, None] + np.arange(WORD_PARTS)
                real = at < first[word + 1][:, None]
                at = np.where(real, at, first[word][:, None])
                yield ids[at], np.broadcast_to(head[word][:, None], at.shape), z[at], real

        train(self.inner, inner_batches())

    def inside_words(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`inside_parts` of words."""
        return self.inside_parts(*parts_of(words, self.path), counts)

    def inside_parts(self, ids: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last subword of each word, and the log probability of all after the first, its end included. ``counts``: of the words."""
        if not len(ids):
            return ids, ids, np.zeros(0)
        head, tail = ids[first[:-1]], ids[first[1:] - 1]
        following = np.append(ids[1:], END)
        following[first[1:] - 1] = END
        x = self.inner.vectors(ids, np.repeat(head, np.diff(first)))
        found = score(self.inner, self.inner_words, x, np.arange(len(ids)), following, first)
        spelled = np.add.reduceat(found, first[:-1])
        places = self.begins[head] + self.different[head] + 1.0
        known = np.log((1 - INNER_WEIGHT) * (counts + 1) / places + INNER_WEIGHT * np.exp(spelled))
        # The one place kept for unseen words is shared among them as the attention model spells them, so all words of a first subword add up to one at most.
        unseen = np.log((1 - INNER_WEIGHT) / places + INNER_WEIGHT) + spelled
        return head, tail, np.where(counts > 0, known, unseen)

    def across_words(self, head: np.ndarray, tail: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each text, the log probability of its words' first subwords and of its end. ``word`` numbers the words in
        ``head`` and ``tail``; text i has words first[i] to first[i + 1]."""
        n = len(first) - 1
        begin = first + np.arange(n + 1)  # each text has a beginning before its words
        row = np.full(len(word) + n, len(head))
        is_word = np.ones(len(row), dtype=bool)
        is_word[begin[:-1]] = False
        row[is_word] = word
        target = np.append(np.append(head, END)[row][1:], END)
        x = self.outer.vectors(np.append(head, END), np.append(tail, END))
        found = score(self.outer, self.outer_words, x, row, target, begin)
        return np.add.reduceat(found, begin[:-1]) if n else np.zeros(0)


def sample(rows: DataFrame) -> list[str]:
    """At most SAMPLE_ROWS different training texts: those of smallest text hash. Of a text longer than SAMPLE_CHARS, that much from a place its hash chooses."""
    some = rows.filter(~F.col("held_out") & (F.length("text") > 0)).select("text", F.xxhash64("text").alias("hash"))
    chosen = stage(some.select("hash").distinct().orderBy("hash").limit(SAMPLE_ROWS).select(F.col("hash").alias("h")), "lm-sample")
    found = some.join(chosen, some["hash"] == chosen["h"])
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    part = F.substr("text", F.pmod(F.xxhash64("hash"), spare.cast("long")).cast("int") + 1, F.lit(SAMPLE_CHARS))
    return [row["text"] for row in found.groupBy("hash").agg(F.first(part).alias("text")).orderBy("hash").collect()]  # SAMPLE_ROWS


def windows(first: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, ...]:
    """Inputs, targets and weights of a block's texts, one after the other in windows that do not overlap; every word and every end is a target once.

    ``head`` and ``tail`` are the words' first and last subwords; text i has words first[i] to first[i + 1]. Its beginning is marked by END.
    """
    begin = first + np.arange(len(first))  # each text has a beginning before its words
    n = len(head) + len(first) - 1
    is_word = np.ones(n, dtype=bool)
    is_word[begin[:-1]] = False
    size = -(-n // WINDOW) * WINDOW
    a, b = np.full(size + 1, END, np.uint16), np.full(size, END, np.uint16)
    a[:n][is_word], b[:n][is_word] = head, tail
    real = np.arange(size) < n
    y = np.where(real, a[1:], END)
    return tuple(v.reshape(-1, WINDOW) for v in (a[:size], b, y, real))


class OuterTrainer:
    """Learns from texts, block by block: each of their words and ends once."""

    def __init__(self, model: Model):
        self.model, self.adam, self.draw, self.seen = model, Adam(model.outer), np.random.default_rng(5), 0
        # Words met, by hash in order, with their first and last subwords.
        self.known, self.ends = np.zeros(0, np.uint64), np.zeros((0, 2), np.uint16)
        self.held: list[tuple[np.ndarray, ...]] = []

    def _subwords(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First and last subword of each word, and where each text's words begin."""
        words, begin = split(texts)
        coded = words.dictionary_encode()
        hashes = WordBlock(coded.dictionary).hashes()
        order = np.argsort(hashes)
        hashes = hashes[order]
        if len(self.known) > KNOWN_WORDS:
            self.known, self.ends = self.known[:0], self.ends[:0]
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), dtype=bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != hashes
        ids, first = parts_of(coded.dictionary.take(pa.array(order[new])).to_pylist(), self.model.path)
        ends = np.stack([ids[first[:-1]], ids[first[1:] - 1]], axis=1).astype(np.uint16)
        self.known = np.insert(self.known, place[new], hashes[new])
        self.ends = np.insert(self.ends, place[new], ends, axis=0)
        found = np.empty((len(hashes), 2), np.uint16)
        found[order] = self.ends[np.searchsorted(self.known, hashes)]
        return found[np.asarray(coded.indices)], begin

    def learn(self, texts: pa.Array) -> None:
        found, begin = self._subwords(texts)
        a, b, y, real = windows(begin, found[:, 0], found[:, 1])
        self.seen += int(real.sum())
        self.held.append((a, b, self.model.outer_words.of[y].astype(np.uint8), real))
        if sum(len(v[0]) for v in self.held) >= WINDOWS_AT_ONCE:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        a, b, y, real = (np.concatenate(v) for v in zip(*self.held, strict=True))
        self.held.clear()
        order = self.draw.permutation(len(a))
        for at in np.array_split(order, max(1, round(len(order) / TASK_WINDOWS))):
            self.adam.learn(a[at], b[at], y[at], real[at])


class InnerTrainer:
    """Learns from different words and their counts: all subwords of each, by how often the training texts hold it."""

    def __init__(self, model: Model):
        self.model, self.adam, self.draw, self.seen = model, Adam(model.inner), np.random.default_rng(7), 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def learn(self, ids: np.ndarray, first: np.ndarray, counts: np.ndarray) -> None:
        """Word i has the subwords ids[first[i]] to ids[first[i + 1]] and the count counts[i]."""
        if len(counts):
            self.held.append((ids, np.diff(first), counts))
        if sum(len(h[2]) for h in self.held) >= DIFFERENT_AT_ONCE:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        ids, lengths, counts = (np.concatenate(h) for h in zip(*self.held, strict=True))
        self.held.clear()
        first = np.concatenate([[0], np.cumsum(lengths)])
        following = np.append(ids[1:], END)
        following[first[1:] - 1] = END
        target = self.model.inner_words.of[following]
        self.seen += int(counts.sum())
        # Words of more subwords than a window has are several pieces.
        pieces = -(-lengths // WORD_PARTS)
        of = np.repeat(np.arange(len(counts)), pieces)
        begin = first[of] + WORD_PARTS * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(begin + WORD_PARTS, first[of + 1])
        # What is frequent comes in many batches with a part of its weight in each, so that none is about a single word.
        batches = max(1, round(len(of) / TASK_WORDS))
        weight = counts[of].astype(np.float64)
        times = np.clip(np.ceil(weight / (8 * weight.mean())), 1, batches).astype(np.int64)
        which, weight = np.repeat(np.arange(len(of)), times), np.repeat(weight / times, times)
        length = (end - begin)[which]
        some_length = [np.flatnonzero((length > short) & (length <= long)) for short, long in PIECES]
        steps = [at for rows in some_length if len(rows) for at in np.array_split(self.draw.permutation(rows), max(1, round(len(rows) / TASK_WORDS)))]
        for step in self.draw.permutation(len(steps)):
            some = steps[step]
            piece = which[some]
            at = begin[piece][:, None] + np.arange(int(length[some].max()))
            real = at < end[piece][:, None]
            at = np.where(real, at, begin[piece][:, None])
            head = np.broadcast_to(ids[first[of[piece]]][:, None], at.shape)
            self.adam.learn(ids[at], head, target[at], real * weight[some][:, None])


MOVES = "name string, part int, rows binary, moves binary, words long"


def moves(net: str, old: Attention, new: Attention, seen: int) -> pa.RecordBatch:
    """The weights that training moved, by how much, in parts of PART_ROWS rows."""
    found = []
    for name, before in old.p.items():
        before, after = before.reshape(len(before), -1), new.p[name].reshape(len(before), -1)
        moved = np.flatnonzero((before != after).any(axis=1))
        for part in np.unique(moved // PART_ROWS).tolist():
            rows = moved[moved // PART_ROWS == part]
            found.append((net + name, part, rows.astype("<i4").tobytes(), (after - before)[rows].astype("<f4").tobytes(), seen))
    return pa.RecordBatch.from_pylist([dict(zip(("name", "part", "rows", "moves", "words"), f, strict=True)) for f in found], MOVED)


MOVED = pa.schema([("name", pa.string()), ("part", pa.int32()), ("rows", pa.binary()), ("moves", pa.binary()), ("words", pa.int64())])


def mean_moves(table: pa.Table) -> pa.Table:
    """The mean of all trainers' moves of one part, each row's over those that moved it, weighed by what they learned from."""
    base = table.column("part")[0].as_py() * PART_ROWS
    total, weight = None, np.zeros(PART_ROWS)
    # Added up in one order, whatever the order in which they come.
    for row in sorted(table.select(["rows", "moves", "words"]).to_pylist(), key=lambda r: (r["words"], r["moves"])):
        at = np.frombuffer(row["rows"], "<i4") - base
        moved = np.frombuffer(row["moves"], "<f4").reshape(len(at), -1)
        total = np.zeros((PART_ROWS, moved.shape[1])) if total is None else total
        total[at] += row["words"] * moved
        weight[at] += row["words"]
    at = np.flatnonzero(weight)
    values = (total[at] / weight[at][:, None]).astype("<f4")
    return pa.Table.from_pylist([{"name": table.column("name")[0].as_py(), "part": base // PART_ROWS, "rows": (at + base).astype("<i4").tobytes(), "moves": values.tobytes(), "words": int(weight.max())}], MOVED)


def learned(model: Model, rows: DataFrame, counts: DataFrame, n_words: int, n_different: int) -> None:
    """Train on all training texts and words in tasks, and set the model to the mean of what they come to, weighed by what each learned from.

    The model across words sees every word and end of every training text once, the model within words every counted word with its count. Their texts and words stay
    where they are read: about one trainer for each TRAINER_WORDS of them, and no shuffle but that of the moves. The sums are made in tasks, part by part; the driver gets one model.
    """

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own = copy.deepcopy(model)
        trainer = OuterTrainer(own)
        for batch in batches:
            for part in blocks(batch):
                trainer.learn(part.column("text"))
        trainer.flush()
        yield moves("outer ", model.outer, own.outer, trainer.seen)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own = copy.deepcopy(model)
        trainer = InnerTrainer(own)
        for batch in batches:
            trainer.learn(*parts_in(batch.column("ids")), np.asarray(batch.column("n")))
        trainer.flush()
        yield moves("inner ", model.inner, own.inner, trainer.seen)

    trainers = lambda n: max(1, -(-n // TRAINER_WORDS))
    texts = rows.filter(~F.col("held_out")).select("text").coalesce(trainers(n_words))
    words = counts.filter("n > 0").coalesce(trainers(8 * n_different))
    found = texts.mapInArrow(outer, MOVES).unionByName(words.mapInArrow(inner, MOVES))
    for row in found.groupBy("name", "part").applyInArrow(mean_moves, MOVES).collect():  # each weight once
        net, name = row["name"].split(" ")
        weights = getattr(model, net).p[name]
        at = np.frombuffer(row["rows"], "<i4")
        weights[at] += np.frombuffer(row["moves"], "<f4").reshape(len(at), *weights.shape[1:])


ASKED, TOLD = "part int, block int, words string", "block int, part int, facts binary"
FACTS = np.dtype([("n", "<i8"), ("head", "<u2"), ("tail", "<u2"), ("rest", "<f8")])  # of a word


def ask(table: pa.Table, n_parts: int) -> pa.Table:
    """For each part, the different words of a block that are in it."""
    _, begin, parts, lines = in_lines(split(table.column("text").combine_chunks())[0].unique(), n_parts)
    number = pa.array(np.full(len(parts), table.column("block")[0].as_py(), dtype=np.int32))
    return pa.table([pa.array(parts), number, lines], ["part", "block", "words"])


def tell(asked: pa.Table, known: pa.Table) -> pa.Table:
    """What is known of each word that blocks ask a part for, as FACTS in the order in which they ask."""
    words = pc.split_pattern(asked.column("words").combine_chunks(), "\n")
    facts = np.empty(known.num_rows, FACTS)
    for name in FACTS.names:
        facts[name] = np.asarray(known.column(name))
    found = facts[np.asarray(pc.index_in(words.flatten(), value_set=known.column("word").combine_chunks()))]
    begin = np.append(0, np.cumsum(np.asarray(pc.list_value_length(words)), dtype=np.int64))
    return pa.table([asked.column("block"), asked.column("part"), binaries(found, begin)], ["block", "part", "facts"])


def facts_of(told: pa.Table, words: pa.Array, n_parts: int) -> list[np.ndarray]:
    """The facts of a block's different words, from what all parts told it."""
    facts = np.empty(len(words), FACTS)
    facts[in_parts(words, n_parts)[0]] = np.frombuffer(b"".join(told.sort_by("part").column("facts").to_pylist()), FACTS)
    return [facts[name].astype(np.float64 if name == "rest" else np.int64) for name in FACTS.names]


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, path: str) -> DataFrame:
    """Scores of every text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    Learned from the documents that are not held out. A null text counts as empty: one token, its end. Repeated rows are scored, and learned from, each. If nothing
    is learned, the base is uniform over one token and the model untrained. An empty table gives an empty result.
    """
    # A to Z become a to z where words are taken.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text.alias("text"))
    shape = rows.agg(F.count_if(~F.col("held_out")).alias("ends"), F.sum(F.length("text") + ROW_CHARS).alias("chars")).first()
    n_blocks, n_parts = (max(1, -(-(shape["chars"] or 0) // size)) for size in (BLOCK_CHARS, PART_CHARS))
    counts = stage(coded(word_counts(rows, n_parts), path), "lm-counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_ends = shape["ends"] or 0
    n_train = (totals["n"] or 0) + n_ends
    n_words = (totals["v"] or 0) + (n_ends > 0)
    begins, goes_on, different = subword_counts(counts)
    begins[END] = n_ends
    model = Model(path, begins, goes_on, different)
    model.train(sample(rows))
    learned(model, rows, counts, totals["n"] or 0, totals["v"] or 0)


    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, tail, rest = model.inside_parts(*parts_in(batch.column("ids")), np.asarray(batch.column("n")))
            part = WordBlock(batch.column("word")).hashes() % np.uint64(n_parts)
            columns = [pa.array(part.astype(np.int32)), batch.column("word"), batch.column("n"), pa.array(head.astype(np.int32)), pa.array(tail.astype(np.int32)), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "word", "n", "head", "tail", "rest"])

    known = counts.mapInArrow(inside, "part int, word string, n long, head int, tail int, rest double")
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")
    dealt = rows.select(block.alias("block"), "doc_id", "held_out", "text")
    asked = dealt.groupBy("block").applyInArrow(lambda table: ask(table, n_parts), ASKED)
    told = asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(tell, TOLD)

    def answer(table: pa.Table, told: pa.Table) -> pa.Table:
        words, first = split(table.column("text").combine_chunks())
        words, texts = words.dictionary_encode(), table.num_rows
        n, head, tail, rest = facts_of(told, words.dictionary, n_parts)
        word, doc = np.array(words.indices), np.repeat(np.arange(texts, dtype=np.int32), np.diff(first))
        del words
        give_back()
        sums = lambda values: np.bincount(doc, weights=values[word], minlength=texts)
        base = sums(np.log10(n + 1.0) - np.log10(n_train + n_words + 1.0)) if len(word) else np.zeros(texts)
        base += np.log10(n_ends + 1.0) - np.log10(n_train + n_words + 1.0)
        known_words = sums((n > 0).astype(float)).astype(np.int64) if len(word) else np.zeros(texts, dtype=np.int64)
        total = model.across_words(head, tail, word, first)
        total = total + (sums(rest) if len(word) else 0)
        return pa.table({
            "doc_id": table.column("doc_id"),
            "held_out": table.column("held_out"),
            "n_tokens": np.diff(first) + 1,
            "n_known": known_words + int(n_ends > 0),
            "train_tokens": np.full(texts, n_train, dtype=np.int64),
            "base_score": base,
            "score": total / LOG10,
        })

    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(answer, RESULT)
