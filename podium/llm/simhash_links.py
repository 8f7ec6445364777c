"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into four segments of 16 bits. If two fingerprints differ in two bits at most, these lie in one segment, so the
other three agree, or in two segments with one bit each. So there are four tables, each keyed by the three segments that
are not left out; a fingerprint looks up its own key, and the keys that differ by one bit in one segment (the Hamming ball of radius one
within it). Every pair of segments is covered by one table, and a table's bucket holds fingerprints that differ in 16 bits
at most, so no bucket grows with a group of copies: equal fingerprints are one row. Matches are verified by their whole distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm.components import connected
from podium.llm.words import document_key, unused
from podium.sources.scratch import stage

SHINGLE_WORDS = 3
SEED = 42
SEGMENTS, SEGMENT_BITS = 4, 16
RADIUS = 2


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """Each bit is one if it is set in over half of the XXH64 hashes of the text's shingles; zero without words.

    A to Z count as a to z. A text with fewer than ``size`` words is one shingle.
    """
    words = text.encode().lower().split() if text is not None else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=starts[1:])
        begin, end = starts[:n].tolist(), (starts[size:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)]
    votes = np.zeros(64, dtype=np.int64)
    every = np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, n, 1 << 16):  # whole texts, in bounded memory
        votes += np.unpackbits(every[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (of the row's id and text) and ``fp``, the fingerprint's 64 bits as a long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
            columns = [batch.column("doc_id"), batch.column("key"), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_key().alias("key"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(compute, "doc_id long, key long, fp long")


def near_pairs(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs ``a < b`` of different values ``fp`` that differ in at most ``radius`` (0 to 2) bits."""
    masks = [~(((1 << SEGMENT_BITS) - 1) << (SEGMENT_BITS * out)) & (2**64 - 1) for out in range(SEGMENTS)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    stored = F.array(*[
        F.struct(F.lit(out).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(masks[out]))).alias("key")) for out in range(SEGMENTS)
    ])
    index = fingerprints.select("fp", F.explode(stored).alias("at")).select(F.col("fp").alias("b"), "at.table", "at.key")
    # Table ``out`` is asked for the own key and for single bits of the segments before ``out``: each pair of segments once.
    # A flip only ever sets a bit: of two keys that differ in one bit, one lacks it, and that one asks.
    flips = F.array(*[
        F.struct(F.lit(out).alias("table"), F.lit(signed(1 << bit)).alias("bit"), F.lit(signed(masks[out])).alias("mask"))
        for out in range(SEGMENTS)
        for bit in range(SEGMENT_BITS * out)
    ])
    own = fingerprints.select("fp", F.explode(stored).alias("at")).select(F.col("fp").alias("a"), "at.table", "at.key", F.lit(True).alias("same"))
    unset = F.filter(flips, lambda f: F.col("fp").bitwiseAND(f["bit"]) == 0)
    ball = fingerprints.select("fp", F.explode(unset).alias("f")).select(
        F.col("fp").alias("a"), "f.table", F.col("fp").bitwiseOR(F.col("f.bit")).bitwiseAND(F.col("f.mask")).alias("key"), F.lit(False).alias("same")
    )
    probes = own.unionAll(ball) if radius > 1 else own
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # An own key meets both members of a pair, so the smaller asks; a set bit is asked for by one side only.
    met = probes.alias("p").join(
        index.alias("i"),
        (F.col("p.table") == F.col("i.table"))
        & (F.col("p.key") == F.col("i.key"))
        & (~F.col("same") | (F.col("a") < F.col("b")))
        & (distance >= 1)
        & (distance <= radius),
    )
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, key, fp and ``root`` (a fingerprint of its component) for each row."""
    rows = stage(with_fingerprints(docs), "simhash-rows")
    nodes = rows.select("fp").distinct()
    roots = connected(near_pairs(stage(nodes, "simhash-nodes"), radius), "simhash")
    return rows.join(roots, rows["fp"] == roots["node"], "left").select("doc_id", "key", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row for each document: doc_id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    The component is the smallest doc_id reachable over links of at most ``radius`` bits, the document itself included. Texts without
    words, null ones too, have fingerprint zero and are linked like any other. Rows with a null id are linked too; a component of such
    rows alone has a null id. Repeated rows are repeated in the result. An empty table gives an empty result.
    """
    rows = stage(grouped(docs, radius), "simhash-grouped")
    smallest = rows.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "of")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(smallest, rows["root"] == smallest["of"]).select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without near-duplicates: of each component one row stays, with its own columns.

    It is that of smallest doc_id (a row without an id only if no row has one), among rows of that id one chosen by its text; of
    repeated rows one stays. Null texts and texts without words are near-duplicates of each other. Texts are read whole, however long. Further columns may have
    any names. An empty table stays empty.
    """
    key = unused(docs, "simhash_key")
    rows = grouped(docs, radius)
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("head"))
    heads = best.select(F.col("head.key").alias(unused(docs, "simhash_head")), F.col("head.doc_id").alias(unused(docs, "simhash_id")))
    keyed = docs.withColumn(key, document_key())
    same = (keyed[key] == heads[heads.columns[0]]) & keyed["doc_id"].eqNullSafe(heads[heads.columns[1]])
    return keyed.join(heads, same, "left_semi").dropDuplicates([key, "doc_id"]).drop(key)
