"""Harmonic packing of token ids into sequences of a fixed capacity.

A length belongs to class k if k pieces of it fit into a sequence and k + 1 do not: (capacity / (k + 1), capacity / k]. A sequence of class k holds exactly
k pieces, whichever they are, so every worker fills its own sequences, one open one a class, and no worker needs to know of another.

Documents may be cut, so a length in the lower part of its class need not waste the difference: it gives a piece of exactly the next class's
largest length and goes on with what is left, if that saves more padding than a cut is worth. In the end the pieces of a worker's open sequences,
less than one sequence a class, are laid end to end; what does not fill a last sequence is cut into powers of two, which need no padding.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm import bpe

CAPACITY = 1024
END_ID = 0
CUT_COST = 4.0  # tokens of padding that a cut has to save
LOCAL_BITS = 40  # of a sequence's number; the task's number lies above
OUTPUT_PIECES = 1 << 13  # rows of an answer's portion

# Fixed value: the published pattern of this kind of vocabulary.
PATTERN = bpe.CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Piece = tuple[int | None, int, np.ndarray, int]  # document, start, ids, ids of the whole document


class TokenIds:
    """Token ids of whole texts under a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        self.merges = bpe.merges(path)
        special = self.merges.special
        ranks = {raw: i for raw, i in self.merges.ids.items() if i not in set(special.values())}
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # a run too long for its matcher, which the streaming encoder takes
            return np.frombuffer(array("I", bpe.encode_text(text, self.merges)), np.uint32)


@lru_cache(maxsize=4)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


@lru_cache(maxsize=16)
def cuts(capacity: int, cut_cost: float = CUT_COST) -> list[int]:
    """For each length up to the capacity, how long its first piece is; the length itself if it stays whole.

    A piece of class k costs what it lacks to the class's share ``capacity / k``; a cut costs ``cut_cost``. The cheapest way is taken.
    """
    first, cost = [0] * (capacity + 1), [0.0] * (capacity + 1)
    shares = sorted({(capacity // k, capacity / k) for k in range(1, capacity + 1)}, reverse=True)
    largest: dict[int, float] = {}
    for whole, share in shares:
        largest.setdefault(whole, share)  # a length is of the class of fewest pieces that holds it
    for length in range(1, capacity + 1):
        best, first[length] = capacity / (capacity // length) - length, length
        for whole, share in largest.items():
            if whole < length and share - whole + cut_cost + cost[length - whole] < best:
                best, first[length] = share - whole + cut_cost + cost[length - whole], whole
        cost[length] = best
    return first


class Packer:
    """Fills one worker's sequences. ``add`` and ``finish`` return pieces with their sequence's number and their place in it."""

    def __init__(self, numbered_from: int = 0, capacity: int = CAPACITY, cut_cost: float = CUT_COST):
        self.next, self.capacity = numbered_from, capacity
        self.first = cuts(capacity, cut_cost)
        self.open: dict[int, list[Piece]] = {}

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple[Piece, int, int]]:
        at, total = 0, len(ids)
        while at < total:
            size = self.first[min(self.capacity, total - at)]
            piece = (doc_id, at, ids[at : at + size], total)
            at += size
            members = self.capacity // size
            held = self.open.setdefault(members, [])
            held.append(piece)
            if len(held) == members:
                yield from self._close(self.open.pop(members))

    def finish(self) -> Iterator[tuple[Piece, int, int]]:
        """Lay what is open end to end."""
        rest = [piece for members in sorted(self.open) for piece in self.open[members]]
        self.open = {}
        left = sum(len(ids) for _, _, ids, _ in rest)
        held: list[Piece] = []
        room = self._room(left)
        for doc_id, start, ids, total in rest:
            at = 0
            while at < len(ids):
                some = ids[at : at + room]
                held.append((doc_id, start + at, some, total))
                at, room, left = at + len(some), room - len(some), left - len(some)
                if not room:
                    yield from self._close(held)
                    held, room = [], self._room(left)

    def _room(self, left: int) -> int:
        return min(self.capacity, 1 << left.bit_length() - 1) if left else 0

    def _close(self, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        at = 0
        for piece in pieces:
            yield piece, self.next, at
            at += len(piece[2])
        self.next += 1


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
RESULT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def _portions(placed: Iterator[tuple[Piece, int, int]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], NAMES)

    for (doc_id, start, ids, total), sequence, offset in placed:
        rows.append((doc_id, start, len(ids), ids.tobytes(), total, sequence, offset))
        if len(rows) >= OUTPUT_PIECES:
            yield batch()
            rows = []
    if rows:
        yield batch()


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, cut_cost: float = CUT_COST) -> DataFrame:
    """Pieces of all documents and where they lie: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its text's ids under the vocabulary file ``path`` (of the tokenizers library, on all executors), without added tokens, and ``end_id``; a null or empty
    text is ``end_id`` alone. Every id lies in exactly one piece. Sequences hold at most ``capacity`` (a power of two) tokens; those that are not a power of two long
    are to be padded to it. Rows that repeat are packed each; rows without an id as well. Other columns play no part. An empty table gives no pieces.

    Each task packs its own documents and holds one document and less than one sequence a class, so nothing is shuffled. A sequence's number is that of its task and a count
    within the task: a task that runs again over the same rows in the same order gives the same numbers.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(path)
        packer = Packer(TaskContext.get().partitionId() << LOCAL_BITS, capacity, cut_cost)
        end = np.array([end_id], np.uint32)

        def placed() -> Iterator[tuple[Piece, int, int]]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield from packer.add(doc_id, np.concatenate([encode(text.as_py()), end]).astype("<u4"))
            yield from packer.finish()

        yield from _portions(placed())

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, RESULT)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id``, ``length`` and the packed ``ids`` without padding; a sequence has at most as many pieces as its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda done, part: F.concat(done, part["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
