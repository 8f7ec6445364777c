"""Removing repeated passages with sharded Aho-Corasick automata.

First the recurring windows are confirmed (podium.llm.recurring). Each block of documents is told of those it holds, once each, and where they
occur first in the corpus; windows that follow each other in both places are joined into passages. Every passage is cut into aligned
phrases of half a window, of which any window within it holds at least one whole. The phrases are compiled into Aho-Corasick automata over word
numbers, in shards of bounded size, and all documents of the block are streamed through: each hit is extended left and right along its
passage, which gives every occurrence of every recurring window.

So a block's automata hold what recurs in it and nothing else, and the work grows with the corpus and not with its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm import recurring
from podium.llm.recurring import COPY, DOCUMENT_ROWS, WORD_BITS, Corpus

WINDOW = 20
RUN = 8
PHRASE = WINDOW // 2
SHARD_WORDS = 200_000  # words of the phrases in an automaton
PASSAGE_ROWS = 2
STRETCHES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>"


def confirmed_passages(told: pa.Table, documents: list[tuple[int, list[bytes]]]) -> list[tuple[int, list[bytes]]]:
    """Passages of a block as (first place in the corpus, words), from its documents (number, words) and the windows told to it."""
    rows = np.asarray(told.column("kind")) == PASSAGE_ROWS
    places, firsts = np.asarray(told.column("a"))[rows], np.asarray(told.column("b"))[rows]
    order = np.argsort(places)
    places, firsts = places[order], firsts[order]
    words = dict(documents)
    out = []
    for some in np.split(np.arange(len(places)), np.flatnonzero((np.diff(places) != 1) | (np.diff(firsts) != 1)) + 1):
        if len(some):
            number, a = divmod(int(places[some[0]]), 1 << WORD_BITS)
            out.append((int(firsts[some[0]]), words[number][a : a + len(some) - 1 + WINDOW]))
    return out


def automata(passages: list[list[int]]) -> Iterator[ahocorasick.Automaton]:
    """Automata of the passages' phrases, of at most SHARD_WORDS words each; a phrase's value lists its passages and places."""
    places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for number, words in enumerate(passages):
        for at in range(0, len(words) - PHRASE + 1, PHRASE):
            places.setdefault(tuple(words[at : at + PHRASE]), []).append((number, at))
            if len(places) * PHRASE >= SHARD_WORDS:
                yield _compiled(places)
                places = {}
    if places:
        yield _compiled(places)


def _compiled(places: dict[tuple[int, ...], list[tuple[int, int]]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase, where in places.items():
        automaton.add_word(phrase, where)
    automaton.make_automaton()
    return automaton


def _extent(document: tuple[int, ...], passage: list[int], at: int, place: int) -> tuple[int, int]:
    """The longest stretch of the document equal to the passage around a phrase at ``at`` of one and ``place`` of the other."""
    a, p = at, place
    while a and p and document[a - 1] == passage[p - 1]:
        a, p = a - 1, p - 1
    b, p = at + PHRASE, place + PHRASE
    while b < len(document) and p < len(passage) and document[b] == passage[p]:
        b, p = b + 1, p + 1
    return a, b


def repeats_in_block(documents: list[tuple[int, list[bytes]]], passages: list[tuple[int, list[bytes]]]) -> list[np.ndarray]:
    """For each document (number, words), which words are in an occurrence of a passage (first place, words) other than the first."""
    numbers: dict[bytes, int] = {}
    bodies = [[numbers.setdefault(w, len(numbers) + 1) for w in words] for _, words in passages]
    coded = [tuple(numbers.get(w, 0) for w in words) for _, words in documents]
    gone = [np.zeros(len(words), dtype=bool) for _, words in documents]
    for automaton in automata(bodies):
        for (number, _), words, mask in zip(documents, coded, gone, strict=True):
            upto: dict[tuple[int, int], int] = {}  # by passage and shift: where the last occurrence ended
            for last, where in automaton.iter(words) if len(words) >= WINDOW else ():
                at = last - PHRASE + 1
                for passage, place in where:
                    shift = (passage, at - place)
                    if at < upto.get(shift, 0):
                        continue
                    a, b = _extent(words, bodies[passage], at, place)
                    upto[shift] = b
                    if b - a >= WINDOW and passages[passage][0] != (number << WORD_BITS) + at - place:
                        mask[a:b] = True
    return gone


def _stretches(mask: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def clean_block(table: pa.Table, told: pa.Table) -> pa.Table:
    """The result of a block's documents, from the passages and the document numbers told to it."""
    kinds = np.asarray(told.column("kind"))
    rows = kinds == DOCUMENT_ROWS
    numbers = dict(zip(np.asarray(told.column("a"))[rows].tolist(), np.asarray(told.column("b"))[rows].tolist(), strict=True))
    documents, ids, place = [], [], {}
    for doc_id, key, text in zip(*[table.column(c) for c in ("doc_id", "key", "text")], strict=True):
        same = key.as_py()
        if same not in place:
            place[same] = len(documents)
            documents.append((numbers[same], (text.as_py() or "").encode().split()))
        ids.append((doc_id.as_py(), place[same]))
    own = [i for i, (number, _) in enumerate(documents) if number != COPY]
    mine = [documents[i] for i in own]
    found = dict(zip(own, repeats_in_block(mine, confirmed_passages(told, mine)), strict=True))
    out: list[list] = [[], [], [], []]
    for i, (_, words) in enumerate(documents):
        # An equal text came earlier: every window of a copy goes.
        gone = found[i] if i in found else np.full(len(words), len(words) >= WINDOW)
        kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words)
        for values, value in zip(out, (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), _stretches(gone)), strict=True):
            values.append(value)
    # Rows that repeat a document have its result.
    types = [pa.int64(), pa.int64(), pa.string(), STRETCHES]
    rows = pa.array([at for _, at in ids], pa.int64())
    columns = [pa.array([i for i, _ in ids], pa.int64()), *[pa.array(v, t).take(rows) for v, t in zip(out, types, strict=True)]]
    return pa.table(columns, [c.split()[0] for c in RESULT.split(", ")[:5]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the words kept, joined by one space) and ``removed`` (stretches of word numbers).

    A word goes if it is in a window of 20 words whose words also start earlier: in a document of smaller doc_id, or before in the same one. All is
    judged on the input. A null doc_id counts as the smallest; of different texts with one doc_id, an arbitrary but fixed one is
    earlier. Rows that repeat both doc_id and text are one document, and each has its result. A null text has no words. An empty table gives an empty result.
    """
    corpus = Corpus(docs, "passages")
    runs = recurring.recurring_runs(corpus, WINDOW, RUN)
    windows = recurring.recurring_windows(corpus, runs, WINDOW, RUN)
    # A window that a block holds once, at its first place of all, takes no word from the block.
    needed = windows.filter((F.col("n") > 1) | (F.col("place") != F.col("first")))
    told = corpus.told().unionAll(needed.select("block", F.lit(PASSAGE_ROWS).alias("kind"), F.col("place").alias("a"), F.col("first").alias("b")))
    return corpus.blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(clean_block, RESULT)
