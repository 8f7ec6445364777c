"""Where runs of words recur: what the two operators on repeated passages have in common.

Documents are dealt into blocks of bounded size by a hash of their key; that is the only time their texts are shuffled, as every later step
reads the same exchange. Of the runs of ``k`` words of a document, those at content-selected positions are retained: the smallest hash of any
``length - k + 1`` runs in a row, so that every window of ``length`` words retains at least one, and equal windows retain equal ones. A
window can only recur if the run that it retains recurs. So most of a corpus is ruled out by counting retained runs, a few for every
hundred words, and full windows are compared only where their retained run was seen twice.

What blocks send is unique within the block: a run or window that is in a third of all documents is at most one row of each block, so
no key grows with its occurrences.

Texts that are equal as a whole are compared through the first of them, their representative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.words import WordBlock, document_key, leftmost_minima, runs_everywhere
from podium.sources.scratch import stage

BLOCK_CHARS = 4 << 20
ROW_CHARS = 256  # what a row counts besides its text, so that many short or null texts are many blocks too
#: A place is a document's number in the order of ids, and a word number below this many bits.
WORD_BITS = 28
BLANKS = " \t\n\v\f\r"
COPY = -1
RUN_ROWS, DOCUMENT_ROWS = 0, 1


class Corpus:
    """Documents in blocks, and what is known of each.

    ``blocks``: block, doc_id, key, text. ``info``: key, block, doc_id, ``number`` in the order of doc_id (null first, ties by key), and ``of``, the
    number of the first document of equal text. Rows that repeat id and text share the key and count as one document.
    """

    def __init__(self, docs: DataFrame, name: str):
        text = F.col("text").cast("string")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("key"), text.alias("text"))
        chars = rows.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + ROW_CHARS).alias("n")).first()["n"] or 0
        self.n_blocks = max(1, -(-chars // BLOCK_CHARS))
        # Another hash than the key's: documents are told apart by both.
        block = F.pmod(F.hash("doc_id", "text"), F.lit(self.n_blocks)).cast("int")
        self.blocks = rows.select(block.alias("block"), "doc_id", "key", "text")
        digests = stage(rows.select("doc_id", "key", block.alias("block"), F.xxhash64("text").alias("h1"), F.md5(F.col("text").cast("binary")).alias("h2")).distinct(), f"{name}-texts")
        order = [F.col("doc_id").asc_nulls_first(), F.col("key").asc()]
        ranged = digests.select("doc_id", "key").repartitionByRange(*order).sortWithinPartitions(*order)
        ranged = stage(ranged.withColumn("id", F.monotonically_increasing_id()), f"{name}-order")
        # Partition and row number are in the id's upper and lower bits; a row for each partition makes the numbers dense.
        part = F.shiftright("id", 33)
        sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = sizes.select("part", before.alias("before"))
        numbered = ranged.join(offsets, part == F.col("part")).select(
            F.col("doc_id").alias("d"), F.col("key").alias("k"), (F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("number")
        )
        same = (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))
        known = stage(digests.join(numbered, same).drop("k", "d"), f"{name}-numbers")
        first = known.groupBy("h1", "h2").agg(F.min("number").alias("of")).withColumnsRenamed({"h1": "g1", "h2": "g2"})
        joined = known.join(first, F.col("h1").eqNullSafe(F.col("g1")) & F.col("h2").eqNullSafe(F.col("g2")))
        self.info = stage(joined.select("key", "block", "doc_id", "number", "of"), f"{name}-info")

    def told(self) -> DataFrame:
        """For each block, rows (block, kind, a, b): key and number of its documents, the number COPY for those equal to an earlier one."""
        number = F.when(F.col("number") == F.col("of"), F.col("number")).otherwise(F.lit(COPY))
        return self.info.select("block", F.lit(DOCUMENT_ROWS).alias("kind"), F.col("key").alias("a"), number.cast("long").alias("b"))


def own_documents(table: pa.Table, told: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Texts and numbers of a block's documents, each once, without copies."""
    kind = np.asarray(told.column("kind"))
    rows = kind == DOCUMENT_ROWS
    numbers = dict(zip(np.asarray(told.column("a"))[rows].tolist(), np.asarray(told.column("b"))[rows].tolist(), strict=True))
    chosen, out = [], []
    for i, key in enumerate(table.column("key").to_pylist()):
        number = numbers.pop(key, COPY)
        if number != COPY:
            chosen.append(i)
            out.append(number)
    texts = table.column("text").take(pa.array(chosen, pa.int64())).combine_chunks()
    return texts, np.array(out, dtype=np.int64)


def retained(block: WordBlock, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within a document, the run each retains, and the hashes of all runs."""
    hashes = runs_everywhere(block.hashes(), k)
    n = len(block.starts)
    if n < length:
        nothing = np.zeros(0, dtype=np.int64)
        return nothing, nothing, hashes
    windows = np.arange(n - length + 1)
    windows = windows[block.doc[windows] == block.doc[windows + length - 1]]
    return windows, leftmost_minima(hashes, length - k + 1)[windows], hashes


def retained_hashes(texts: pa.Array, length: int, k: int) -> np.ndarray:
    _, chosen, hashes = retained(WordBlock(texts), length, k)
    return hashes[np.unique(chosen)]


def recurring_runs(corpus: Corpus, length: int, k: int) -> DataFrame:
    """``block`` and ``hash`` of the retained runs that occur at least twice in the corpus."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        texts, _ = own_documents(table, told)
        hashes, counts = np.unique(retained_hashes(texts, length, k), return_counts=True)
        block = np.full(len(hashes), table.column("block")[0].as_py() if table.num_rows else 0, dtype=np.int32)
        return pa.table({"block": block, "hash": hashes.view(np.int64), "n": counts})

    runs = corpus.blocks.groupBy("block").cogroup(corpus.told().groupBy("block")).applyInArrow(run, "block int, hash long, n long")
    total = F.sum("n").over(Window.partitionBy("hash"))
    return runs.withColumn("total", total).filter("total > 1").select("block", "hash")


def window_hashes(block: WordBlock, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash for the windows at ``starts``."""
    first = runs_everywhere(block.hashes(0), length, 0)[starts].view(np.int64)
    second = (runs_everywhere(block.hashes(1), length, 1)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return first, second


def candidate_windows(texts: pa.Array, told: pa.Table, length: int, k: int) -> tuple[WordBlock, np.ndarray]:
    """A block's words, and the starts of the windows whose retained run recurs."""
    block = WordBlock(texts)
    starts, chosen, hashes = retained(block, length, k)
    rows = np.asarray(told.column("kind")) == RUN_ROWS
    recurring = np.asarray(told.column("a"))[rows].view(np.uint64)
    return block, starts[np.isin(hashes[chosen], recurring)]


def with_runs(corpus: Corpus, runs: DataFrame) -> DataFrame:
    """The rows told to blocks, with the runs that recur."""
    return corpus.told().unionAll(runs.select("block", F.lit(RUN_ROWS).alias("kind"), F.col("hash").alias("a"), F.lit(0).cast("long").alias("b")))


def recurring_windows(corpus: Corpus, runs: DataFrame, length: int, k: int) -> DataFrame:
    """The windows that occur at least twice: block, h1, h2, ``place`` (the first in this block), ``first`` (the first of all) and ``n`` (how often
    this block holds it)."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        texts, numbers = own_documents(table, told)
        block, starts = candidate_windows(texts, told, length, k)
        h1, h2 = window_hashes(block, starts, length)
        doc = block.doc[starts]
        places = (numbers[doc] << WORD_BITS) + starts - block.first[doc]
        order = np.lexsort((places, h2, h1))
        h1, h2, places = h1[order], h2[order], places[order]
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        heads = np.flatnonzero(new)
        n = np.diff(np.append(heads, len(h1)))
        number = np.full(len(heads), table.column("block")[0].as_py() if table.num_rows else 0, dtype=np.int32)
        return pa.table({"block": number, "h1": h1[heads], "h2": h2[heads], "place": places[heads], "n": n})

    found = corpus.blocks.groupBy("block").cogroup(with_runs(corpus, runs).groupBy("block")).applyInArrow(
        run, "block int, h1 long, h2 int, place long, n long"
    )
    same = Window.partitionBy("h1", "h2")
    both = found.withColumns({"total": F.sum("n").over(same), "first": F.min("place").over(same)})
    return both.filter("total > 1").select("block", "h1", "h2", "place", "first", "n")
