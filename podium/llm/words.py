"""Words, their hashes, and hashes of word sequences, for blocks of documents at once.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20  # text handled at a time in a task; a longer document is a block of its own

HASHED_BYTES = 1 << 18

_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)  # A to Z as a to z
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; ``bytes.split`` splits at exactly the six blanks."""
    return [] if text is None else text.encode().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A to Z as a to z, and where each text's begin: text i has words first[i] to first[i + 1]."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    real = np.asarray(pc.binary_length(words)) > 0  # blanks at an end or beside each other are split too
    first = np.append(0, np.cumsum(real))[np.asarray(lists.offsets)]
    return (words if real.all() else words.filter(pa.array(real))).cast(pa.string()), first


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts are about ``size`` bytes together."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    done = 1
    factor = base
    while done < n:  # doubling: base ** i for the second half from the first
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(factor)
        factor = factor * factor % 2**64
        done += more
    return out


class Rolling:
    """Hashes of all runs of a given length, from prefix sums of value x base ** position modulo 2 ** 64."""

    def __init__(self, seed: int):
        self.base = int(_mix(np.array([seed * 2 + 1], dtype=np.uint64))[0]) | 1
        self.inverse = pow(self.base, -1, 2**64)

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ``values[start:end]`` for each pair."""
        n = len(values)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * _powers(self.base, n), out=sums[1:])
        shift = _powers(self.inverse, n + 1)[starts]
        return _mix((sums[ends] - sums[starts]) * shift + (ends - starts).astype(np.uint64))


_BYTES = [_mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(s)) for s in (11, 23)]
_WORDS, _RUNS = (Rolling(3), Rolling(5)), (Rolling(7), Rolling(9))


class WordBlock:
    """The words of a block of documents: where they are, which document they are in, and their hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        bounds = offsets - first
        space = _IS_SPACE[self.data]
        inside = ~space
        begins = inside.copy()
        begins[1:] &= space[:-1]
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]  # a document begins a word also without a blank before it
        begins[heads] = inside[heads]
        finishes = inside.copy()
        finishes[:-1] &= space[1:]
        tails = bounds[1:][bounds[:-1] < bounds[1:]] - 1
        finishes[tails] = inside[tails]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        self.doc = np.searchsorted(bounds, self.starts, side="right") - 1
        #: Document d holds words first[d] to first[d + 1].
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.bounds = bounds

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; ``which`` chooses one of two."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(out):  # a portion of the text at a time, so that what is held for each byte stays small
            upto = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + HASHED_BYTES, side="right")))
            a, b = self.starts[at], self.ends[upto - 1]
            values = _BYTES[which][self.data[a:b]]
            out[at:upto] = _WORDS[which].spans(values, self.starts[at:upto] - a, self.ends[at:upto] - a)
            at = upto
        return out

    def code_points(self) -> np.ndarray:
        """The number of code points before each byte, and before the end."""
        out = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def text(self, a: int, b: int) -> bytes:
        """Words a to b of the block joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True))


def runs_everywhere(word_hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of ``length`` words of a block, also of those that leave a document."""
    at = np.arange(max(0, len(word_hashes) - length + 1))
    return _RUNS[which].spans(word_hashes, at, at + length)


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the index of its smallest, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(len(values))
    span = 1
    while span < width:  # best[i]: of the values i to i + span
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best[:n]


def document_key() -> Column:
    """A 64-bit key of a row's ``doc_id`` and ``text``; rows that repeat both share it."""
    return F.xxhash64("doc_id", "text")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
