"""Repeated passages with sparse suffixes.

Only suffixes at content-selected (minimiser) positions are retained, about six for every hundred words. Suffixes alike in their first 16
words belong together; those without a like one are dropped. The rest are widened: to the left by up to 34 words
and to the right, which takes in every window of 50 words that retains the suffix; windows are grouped in turn
and the earliest of each group kept as the source. Matches that go on in both documents are joined, so a match ends where the texts differ.

Words are compared by their hashes: 64 bits for the first 16 words, 96 bits for a window. Grouping is Spark's: windows over the hash sort each shuffle partition, so that equal
ones are next to each other. A block of documents sends a suffix once however often it holds it, so a frequent passage is a row of each block at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm import recurring
from podium.llm.recurring import COPY, DOCUMENT_ROWS, WORD_BITS, Corpus

MATCH_WORDS = 50
PREFIX_WORDS = 16
MATCH_ROWS = 2
SPANS = "number long, begins int, ends int, n_words int, of long, of_word int"


def spans_of_block(table: pa.Table, told: pa.Table) -> pa.Table:
    """Spans of the block's documents, from the first places of the windows that recur in it."""
    texts, numbers = recurring.own_documents(table, told)
    block, starts = recurring.candidate_windows(texts, told, MATCH_WORDS, PREFIX_WORDS)
    h1, h2 = recurring.window_hashes(block, starts, MATCH_WORDS)
    rows = np.asarray(told.column("kind")) == MATCH_ROWS
    known, second, firsts = (np.asarray(told.column(c))[rows] for c in ("a", "c", "b"))
    order = np.lexsort((second, known))
    known, second, firsts = known[order], second[order], firsts[order]
    # Hashes of windows are compared by their 64 bits here, and by the other 32 where those are equal.
    at = np.searchsorted(known, h1)
    while True:
        short = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == h1) & (second[np.minimum(at, len(known) - 1)] < h2) if len(known) else None
        if short is None or not short.any():
            break
        at = at + short
    hit = np.zeros(len(h1), dtype=bool) if not len(known) else (known[np.minimum(at, len(known) - 1)] == h1) & (second[np.minimum(at, len(known) - 1)] == h2)
    hit &= at < len(known)
    starts, of = starts[hit], firsts[at[hit]]
    doc = block.doc[starts]
    places = (numbers[doc] << WORD_BITS) + starts - block.first[doc]
    later = of != places
    starts, of, doc, places = starts[later], of[later], doc[later], places[later]
    breaks = np.flatnonzero((np.diff(places) != 1) | (np.diff(of) != 1)) + 1
    heads = np.concatenate([[0], breaks]).astype(np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
    tails = np.append(breaks, len(starts)).astype(np.int64) - 1 if len(starts) else heads
    points = block.code_points()
    base = points[block.bounds[doc[heads]]]
    return pa.table({
        "number": numbers[doc[heads]],
        "begins": (points[block.starts[starts[heads]]] - base).astype(np.int32),
        "ends": (points[block.ends[starts[tails] + MATCH_WORDS - 1]] - base).astype(np.int32),
        "n_words": (tails - heads + MATCH_WORDS).astype(np.int32),
        "of": of[heads] >> WORD_BITS,
        "of_word": (of[heads] & ((1 << WORD_BITS) - 1)).astype(np.int32),
    })


def copies_of_block(table: pa.Table, told: pa.Table) -> pa.Table:
    """A span over all words of each copy that is long enough; ``of`` is filled in later."""
    rows = np.asarray(told.column("kind")) == DOCUMENT_ROWS
    copies = {k for k, n in zip(np.asarray(told.column("a"))[rows].tolist(), np.asarray(told.column("b"))[rows].tolist(), strict=True) if n == COPY}
    out: list[tuple] = []
    block = table.column("block")[0].as_py() if table.num_rows else 0
    for key, text in zip(table.column("key").to_pylist(), table.column("text").to_pylist(), strict=True):
        if key in copies and text:
            copies.discard(key)
            n = len(text.encode().split())
            if n >= MATCH_WORDS:
                out.append((block, key, len(text) - len(text.lstrip(recurring.BLANKS)), len(text.rstrip(recurring.BLANKS)), n))
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    columns = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "key", "begins", "ends", "n_words"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Every passage of at least 50 words that occurs earlier: doc_id, begins, ends (code points, end exclusive), n_words, of_doc_id and
    of_word (the document where it occurs first, and the word number at which it does).

    A window of 50 consecutive words is matched to its first occurrence, by doc_id and then by position; matches that go on are one
    row, so rows of one document may overlap where its windows come from different places. Words are told apart by their bytes; blanks
    between them do not count. A document equal to an earlier one, blanks too, is one row over all its words.

    A null doc_id counts as the smallest; rows that repeat id and text are one document. Documents without a match have no row. An
    empty table gives an empty result.
    """
    corpus = Corpus(docs, "suffixes")
    runs = recurring.recurring_runs(corpus, MATCH_WORDS, PREFIX_WORDS)
    windows = recurring.recurring_windows(corpus, runs, MATCH_WORDS, PREFIX_WORDS)
    matches = windows.select("block", F.lit(MATCH_ROWS).alias("kind"), F.col("h1").alias("a"), F.col("first").alias("b"), F.col("h2").alias("c"))
    told = recurring.with_runs(corpus, runs).withColumn("c", F.lit(0)).unionAll(matches)
    blocks = corpus.blocks.groupBy("block")
    spans = blocks.cogroup(told.groupBy("block")).applyInArrow(spans_of_block, SPANS)
    whole = blocks.cogroup(corpus.told().groupBy("block")).applyInArrow(copies_of_block, "block int, key long, begins int, ends int, n_words int")
    copied = whole.join(corpus.info.select("block", "key", "number", "of"), ["block", "key"]).select("number", "begins", "ends", "n_words", "of", F.lit(0).alias("of_word"))
    ids = corpus.info.select("number", "doc_id")
    sources = ids.select(F.col("number").alias("of"), F.col("doc_id").alias("of_doc_id"))
    found = spans.unionAll(copied).join(ids, "number").join(sources, "of")
    return found.select("doc_id", "begins", "ends", "n_words", "of_doc_id", "of_word")
