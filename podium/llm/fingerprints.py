"""Document fingerprints by SimHash, and permuted block tables to find those nearby.

Terms are words and runs of five words. Each term's 128-bit hash votes on every bit of the fingerprint, for one or for zero, with the term's
weight: a word counts as its length in bytes, up to eight, and a run eight. The majority decides, so likeness of fingerprints follows the
weighted overlap of the texts.

To find all fingerprints within a number of bits, they are cut into two more blocks than that number. However the differing bits fall, two blocks
agree, so each pair of blocks is the key of one table, and what meets in a table is verified by its whole distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.words import WordBlock, blocks, document_key, runs_everywhere
from podium.sources.scratch import stage

RUN_WORDS = 5
RUN_WEIGHT = 8
BITS = 128
RADIUS = 3
VOTES_AT_ONCE = 1 << 15  # terms whose bits are held at a time


def _vote(votes: np.ndarray, doc: np.ndarray, hashes: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> None:
    """Add each term's weight to the bits it sets, and take it from the others; terms are in the order of documents."""
    for at in range(0, len(doc), VOTES_AT_ONCE):
        part = slice(at, at + VOTES_AT_ONCE)
        raw = np.stack([h[part] for h in hashes], axis=1).astype(">u8").view(np.uint8)
        # Sums of so few small weights are exact in 32-bit floats.
        bits = np.unpackbits(raw.reshape(-1, BITS // 8), axis=1).astype(np.float32)
        weight = weights[part].astype(np.float32)
        heads = np.flatnonzero(np.diff(doc[part], prepend=-1))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(weight)], strict=True):
            votes[doc[at + a]] += (2 * (weight[a:b] @ bits[a:b]) - weight[a:b].sum()).astype(np.int64)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Two unsigned longs for each text; zero for a text without words. A tied bit is zero."""
    block = WordBlock(texts)
    votes = np.zeros((len(texts), BITS), dtype=np.int64)
    words = block.hashes(0), block.hashes(1)
    lengths = np.minimum(block.ends - block.starts, RUN_WEIGHT).astype(np.uint8)
    _vote(votes, block.doc, words, lengths)
    n = len(block.starts)
    starts = np.arange(max(0, n - RUN_WORDS + 1))
    starts = starts[block.doc[starts] == block.doc[starts + RUN_WORDS - 1]] if len(starts) else starts
    runs = tuple(runs_everywhere(words[i], RUN_WORDS, i)[starts] for i in (0, 1))
    _vote(votes, block.doc[starts], runs, np.full(len(starts), RUN_WEIGHT, dtype=np.uint8))
    return np.packbits(votes > 0, axis=1).view(">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _hexed(prints: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in prints.tolist()]


def edited(text: str, following: str) -> str:
    """The last third of a text's code points (rounded down) replaced by as many, or all, from the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = (
    "doc_id long, key long, n_chars long, edited_sha256 string, fp1 long, fp2 long, edited_fingerprint string, near_edited double, near_next double"
)


def _compared(held: list[tuple]) -> pa.RecordBatch:
    """For documents (doc_id, key, text) in order, each but the last with its fingerprint, that of its edited text, and how near they and the next are."""
    rows = held[:-1]
    changed = [edited(a[2], b[2]) for a, b in zip(held, held[1:])]
    every, new = (fingerprints(pa.array(x, pa.string())) for x in ([r[2] for r in held], changed))
    own, other = every[:-1], every[1:]
    columns = [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.int64()),
        pa.array([len(r[2]) for r in rows], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(own[:, 0].view(np.int64)),
        pa.array(own[:, 1].view(np.int64)),
        pa.array(_hexed(new), pa.string()),
        pa.array(likeness(own, new)),
        pa.array(likeness(own, other)),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])


def _order() -> list[Column]:
    return [F.col("doc_id").desc_nulls_last(), F.col("key").asc()]


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms (``RESULT``), one row for each row of ``docs``.

    Documents follow one another by falling doc_id, null last, and after the last comes the first; rows of equal id follow in a fixed order. Sorted by
    range, a task meets each document together with the next, except for its last; these few are written out with the first
    of each task and joined, so no order of all documents passes through one task.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    ordered = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    names = [c.split()[0] for c in RESULT.split(", ")]

    def edge(kind: str, row: tuple, empty: pa.RecordBatch) -> pa.RecordBatch:
        values = {"doc_id": row[0], "key": row[1]}
        columns = [pa.array([values.get(f.name)], f.type) for f in empty.schema]
        return pa.RecordBatch.from_arrays([*columns, pa.array([kind]), pa.array([row[2]])], [*names, "edge", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty, last = _compared([]), None
        for batch in batches:
            for part in blocks(batch):
                held = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))
                if last is None:
                    yield edge("first", held[0], empty)
                else:
                    held.insert(0, last)
                last = held[-1]
                if len(held) > 1:
                    done = _compared(held)
                    none = pa.nulls(done.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([*done.columns, none, none], [*names, "edge", "text"])
        if last is not None:
            yield edge("last", last, empty)

    found = stage(ordered.mapInArrow(run, f"{RESULT}, edge string, text string"), "fingerprints-tasks")
    # Two rows for each task that had documents; texts are joined by the place in this order.
    edges = found.filter("edge IS NOT NULL").select("doc_id", "key", "edge", "text")
    place = F.row_number().over(Window.orderBy(F.col("doc_id").desc_nulls_last(), "key", "edge"))
    places = stage(edges.select("doc_id", "key", "edge", place.alias("place")), "fingerprints-edges")
    total = places.count()
    same = lambda a, b: (a["edge"] == b["edge"]) & (a["key"] == b["key"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    placed = edges.join(places, same(edges, places)).select(edges["doc_id"], edges["key"], edges["edge"], edges["text"], "place").distinct()
    lasts = placed.filter("edge = 'last'").withColumn("then", F.col("place") % F.lit(max(1, total)) + 1)
    firsts = placed.filter("edge = 'first'").select(F.col("place").alias("then"), F.col("text").alias("following"))
    pairs = lasts.join(firsts, "then").select("doc_id", "key", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                for doc_id, key, text, following in zip(*[part.column(i).to_pylist() for i in range(4)], strict=True):
                    yield _compared([(doc_id, key, text), (None, None, following)])

    return found.filter("edge IS NULL").drop("edge", "text").unionByName(pairs.mapInArrow(finish, RESULT))


def _key(first: int, width: int) -> Column:
    """Bits ``first`` to ``first + width`` of the fingerprint, counted from its low end, as a long."""
    low, high = F.col("fp2"), F.col("fp1")
    if first >= 64:
        taken = F.shiftrightunsigned(high, first - 64)
    elif first + width <= 64 or first == 0:
        taken = F.shiftrightunsigned(low, first)
    else:
        taken = F.shiftrightunsigned(low, first).bitwiseOR(F.shiftleft(high, 64 - first))
    return taken.bitwiseAND(F.lit((1 << width) - 1))


def block_tables(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp1``, ``fp2``, ``table`` and ``key``: a row of each fingerprint for each pair of its ``radius + 2`` blocks."""
    edges = [BITS * i // (radius + 2) for i in range(radius + 3)]
    keys = [_key(a, b - a) for a, b in zip(edges, edges[1:])]
    if any(b - a > 62 for a, b in zip(edges, edges[1:])):
        raise ValueError("choose a radius of at least one bit")
    tables = [F.struct(F.lit(i).alias("table"), keys[a].alias("key_a"), keys[b].alias("key_b")) for i, (a, b) in enumerate(combinations(range(radius + 2), 2))]
    return prints.select("fp1", "fp2", F.explode(F.array(*tables)).alias("t")).select("fp1", "fp2", "t.table", "t.key_a", "t.key_b")


def within(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of different fingerprints (a1, a2) < (b1, b2) with at most ``radius`` differing bits, once each, and their ``distance``."""
    left = block_tables(prints, radius).select(F.col("fp1").alias("a1"), F.col("fp2").alias("a2"), "table", "key_a", "key_b").alias("l")
    right = block_tables(prints, radius).select(F.col("fp1").alias("b1"), F.col("fp2").alias("b2"), "table", "key_a", "key_b").alias("r")
    distance = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("table", "key_a", "key_b")]
    smaller = (F.col("a1") < F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") < F.col("b2")))
    met = left.join(right, [*on, smaller, distance <= radius])
    return met.select("a1", "a2", "b1", "b2", distance.cast("int").alias("distance")).distinct()


def fingerprinted(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, ``fingerprint`` and ``edited_fingerprint`` (32 hexadecimal digits), near_edited, near_next, and
    ``n_near``, the number of other documents whose fingerprint differs in at most ``radius`` bits.

    A null text counts as empty. Equal texts have equal fingerprints; texts without words have fingerprint zero and are near each other. Repeated rows are
    documents of their own. A single document follows itself. An empty table gives an empty result.
    """
    found = stage(with_edits(docs), "fingerprints-found")
    counts = stage(found.groupBy("fp1", "fp2").agg(F.count("*").alias("n")), "fingerprints-counts")
    pairs = within(counts.select("fp1", "fp2"), radius)
    both = pairs.select("a1", "a2", "b1", "b2").unionAll(pairs.select("b1", "b2", "a1", "a2"))
    others = both.join(counts, (F.col("b1") == F.col("fp1")) & (F.col("b2") == F.col("fp2"))).groupBy("a1", "a2").agg(F.sum("n").alias("more"))
    near = counts.join(others, (F.col("fp1") == F.col("a1")) & (F.col("fp2") == F.col("a2")), "left")
    near = near.select(F.col("fp1").alias("n1"), F.col("fp2").alias("n2"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"))
    hexed = F.lower(F.concat(F.lpad(F.hex("fp1"), 16, "0"), F.lpad(F.hex("fp2"), 16, "0")))
    return found.join(near, (F.col("fp1") == F.col("n1")) & (F.col("fp2") == F.col("n2"))).select(
        "doc_id", "n_chars", "edited_sha256", hexed.alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "n_near"
    )
