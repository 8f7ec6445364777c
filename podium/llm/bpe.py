"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

For a merge list, the encoding of a longer text ends in the encoding of one of its prefixes plus one token. So it is enough to know, for
every position, the last token of the encoding that ends there: it is the one token that ends at this position and may follow the last
token of the position where it starts. Two tokens may follow each other if no merge joins parts of them across the
border before those parts are used up inside (``Merges.may_follow``).

No token is longer than the longest one of the vocabulary, ``lookahead`` bytes. So every encoding of a continued text passes through one
of the last ``lookahead`` positions, and what the paths back from all of these have in common can't change any more: it is
emitted and forgotten. Memory holds the undecided bytes alone, however long the text is.
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 1 << 16  # text fed at a time
OPEN_CHARS = 1 << 12  # a run of one kind longer than this is fed on before it ends
CHECK_BYTES = 1 << 12  # undecided bytes before looking for what is stable
CACHED_BYTES = 64  # longest run whose encoding is kept
CACHED_RUNS = 87_000  # in each of two generations; from 87,382 on a dict's table is twice as large
CACHED_PAIRS = 500_000
OUTPUT_BYTES = 4 << 20

# The published pattern of this kind of vocabulary, and the letters and digits that came after Unicode 16.0, which
# the vocabulary's own implementation takes for neither.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
LATER_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LATER_DIGITS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"

LETTER, DIGIT, OTHER, BLANK = "letter", "digit", "other", "blank"


def _kinds(later: bool) -> dict[str, str]:
    if not later:
        return {LETTER: r"\p{L}", DIGIT: r"\p{N}", OTHER: r"[^\s\p{L}\p{N}]", BLANK: r"\s"}
    letter, digit = rf"[\p{{L}}--[{LATER_LETTERS}]]", rf"[\p{{N}}--[{LATER_DIGITS}]]"
    return {LETTER: letter, DIGIT: digit, OTHER: rf"[^\s{letter}{digit}]", BLANK: r"\s"}


def _pattern(kinds: dict[str, str]) -> regex.Pattern:
    runs = "|".join(f" ?{kinds[k]}+" for k in (LETTER, DIGIT, OTHER))
    return regex.compile(rf"(?V1){CONTRACTIONS}|{runs}|\s+(?!\S)|\s+")


_LATER = regex.compile(f"[{LATER_LETTERS}{LATER_DIGITS}]")
_PLAIN, _EXACT = _pattern(_kinds(False)), _pattern(_kinds(True))
_RUN = {k: regex.compile(f"(?V1){v}*") for k, v in _kinds(True).items()}


def _pattern_for(text: str) -> regex.Pattern:
    try:
        text.encode("latin-1")  # most texts, and told much faster than by searching
    except UnicodeEncodeError:
        return _EXACT if _LATER.search(text) else _PLAIN
    return _PLAIN


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A vocabulary file's tokens and merges. ``lookahead`` is the length of its longest token in bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, symbols = content["model"], _byte_symbols()
        raw = {token: bytes(symbols[c] for c in token) for token in model["vocab"]}
        self.ids = {raw[token]: i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.lookahead = max(map(len, self.ids))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # left, right, rank of the merge
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = self.ids[raw[left]], self.ids[raw[right]]
            self.rank[a, b] = rank
            self.parts.setdefault(self.ids[raw[left] + raw[right]], (a, b, rank))
        self._pairs: dict[int, bool] = {}
        self._runs: dict[str, bytes] = {}
        self._older_runs: dict[str, bytes] = {}

    @cached_property
    def tails(self) -> set[bytes]:
        """Ends of tokens; only runs too long to be cached ask for them."""
        return {b[k:] for b in self.ids for k in range(len(b))}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token ``b`` stays apart from token ``a`` before it."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._stays_apart(a, b)
        return known

    def _stays_apart(self, a: int, b: int) -> bool:
        never = len(self.rank)
        right, used_right = a, never  # a part at the end of a, and when a merge inside a uses it up
        while True:
            left, used_left = b, never
            while True:
                rank = self.rank.get((right, left))
                # Of equal merges the leftmost comes first: inside a before the border, at the border before inside b.
                if rank is not None and rank < used_right and rank <= used_left:
                    return False
                if left not in self.parts:
                    break
                left, _, used_left = self.parts[left]
            if right not in self.parts:
                return True
            _, right, used_right = self.parts[right]

    def run(self, text: str) -> bytes:
        """The ids of one whole run, as little-endian 32-bit integers."""
        found = self._runs.get(text)
        if found is None:
            raw = text.encode()
            if len(raw) <= CACHED_BYTES:
                found = self._older_runs.get(text) or array("I", self._path(raw)).tobytes()
                if len(self._runs) >= CACHED_RUNS:  # what is asked for again is kept, the rest goes
                    self._older_runs, self._runs = self._runs, {}
                self._runs[text] = found
            else:
                coder = RunEncoder(self)
                out = array("I")
                coder.feed(raw, out)
                coder.finish(out)
                found = out.tobytes()
        return found

    def _path(self, raw: bytes) -> list[int]:
        """The one path of tokens that may follow each other, for a run that is within the lookahead: longest token first."""
        ids, pairs = self.ids, self._pairs
        n = len(raw)
        path: list[int] = []
        starts: list[int] = []
        closed = set()  # positions from which no path leads to the end
        start, end, before = 0, n, -1
        while start < n:
            while end > start:
                token = ids.get(raw[start:end])
                if token is not None and end not in closed:
                    if before < 0:
                        break
                    apart = pairs.get(before << 32 | token)
                    if apart or (apart is None and self.may_follow(before, token)):
                        break
                end -= 1
            if end > start:
                path.append(token)
                starts.append(start)
                start, end, before = end, n, token
            elif path:
                closed.add(start)
                path.pop()
                end = start - 1
                start = starts.pop()
                before = path[-1] if path else -1
            else:
                raise ValueError("the vocabulary does not cover these bytes")
        return path


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class RunEncoder:
    """Encodes one run of bytes, fed in any portions."""

    def __init__(self, rules: Merges):
        self.rules = rules
        self.before = -1  # last emitted token
        self.bytes = bytearray()  # undecided
        self.last = [-1]  # last token at each position; its length says where it starts
        self.size = [0]

    def feed(self, portion: bytes, out: array) -> None:
        rules, last, size = self.rules, self.last, self.size
        ids, tails, may_follow = rules.ids, rules.tails, rules.may_follow
        for at in range(0, len(portion), CHECK_BYTES):
            done = len(self.bytes)
            self.bytes += portion[at : at + CHECK_BYTES]
            held = bytes(self.bytes)
            for end in range(done + 1, len(held) + 1):
                start = end - 1
                while True:
                    some = held[start:end]
                    token = ids.get(some)
                    if token is not None:
                        previous = last[start] if start else self.before
                        if previous < 0 or may_follow(previous, token):
                            last.append(token)
                            size.append(end - start)
                            break
                    elif some not in tails:
                        raise ValueError("the vocabulary does not cover these bytes")
                    start -= 1
                    if start < 0:
                        raise ValueError("the vocabulary's merges are not consistent")
            if len(held) > CHECK_BYTES:
                self._settle(out)

    def _settle(self, out: array) -> None:
        """Emit what all continuations share."""
        size = self.size
        # Positions a continued encoding may pass through last; paths only lead back, so the latest is moved back until one is left.
        paths = set(range(max(0, len(self.bytes) - self.rules.lookahead + 1), len(self.bytes) + 1))
        while len(paths) > 1:
            latest = max(paths)
            paths.remove(latest)
            paths.add(latest - size[latest])
        stable = paths.pop()
        if stable:
            self._emit(stable, out)
            del self.bytes[:stable], self.last[:stable], size[:stable]

    def _emit(self, end: int, out: array) -> None:
        path = []
        while end:
            path.append(self.last[end])
            end -= self.size[end]
        out.extend(reversed(path))
        if path:
            self.before = path[0]

    def finish(self, out: array) -> None:
        self._emit(len(self.bytes), out)
        self.__init__(self.rules)


class Encoder:
    """Encodes one text, fed in any portions; ``feed`` and ``finish`` return ids as little-endian 32-bit integers."""

    def __init__(self, rules: Merges):
        self.rules = rules
        self.special = regex.compile("|".join(map(regex.escape, rules.special))) if rules.special else None
        self.held_back = max(map(len, rules.special), default=1) - 1
        self.text = ""  # may hold the start of a special token
        self.tail = ""  # a run not known to have ended
        self.kind = ""  # of a run that is fed on before it ends
        self.coder = RunEncoder(rules)

    def feed(self, portion: str) -> bytes:
        return self._split(portion, False)

    def finish(self) -> bytes:
        return self._split("", True)

    def _split(self, portion: str, final: bool) -> bytes:
        """Cut out special tokens; all between them is ordinary text."""
        text = self.text + portion
        if self.special is None:
            self.text = ""
            return self._runs(text, final)
        out, at = b"", 0
        for found in self.special.finditer(text):
            out += self._runs(text[at : found.start()], True) + array("I", [self.rules.special[found.group()]]).tobytes()
            at = found.end()
        upto = len(text) if final else max(at, len(text) - self.held_back)
        self.text = text[upto:]
        return out + self._runs(text[at:upto], final)

    def _runs(self, portion: str, final: bool) -> bytes:
        text = self.tail + portion
        self.tail = ""
        head = b""
        if self.kind:
            head, text = self._go_on(text, final)
            if self.kind:
                return head
        run = self.rules.run
        if final:
            return head + b"".join(map(run, _pattern_for(text).findall(text)))
        # A run that ends two characters before the end is whole: the longest contraction has three.
        out, at = [head], 0
        for found in _pattern_for(text).finditer(text):
            if found.end() > len(text) - 2:
                break
            out.append(run(found.group()))
            at = found.end()
        self.tail = text[at:]
        if len(self.tail) > OPEN_CHARS:
            out.append(self._open())
        return b"".join(out)

    def _open(self) -> bytes:
        """Start to feed a long run that has not ended."""
        first = self.tail[1] if self.tail[0] == " " and not self.tail[1].isspace() else self.tail[0]
        for kind in (LETTER, DIGIT, OTHER, BLANK):
            if _RUN[kind].match(first).end():
                self.kind = kind
        text, self.tail = self.tail, ""
        lead, text = (text[:1], text[1:]) if text[0] == " " and self.kind != BLANK else ("", text)
        out = array("I")
        self.coder.feed(lead.encode(), out)
        done, rest = self._go_on(text, False)
        if not self.kind:  # it did end
            self.tail = rest
        return out.tobytes() + done

    def _go_on(self, text: str, final: bool) -> tuple[bytes, str]:
        """Feed what continues the open run; the rest of the text if the run ends in it."""
        end = _RUN[self.kind].match(text).end()
        ended = final or end < len(text)
        out = array("I")
        # The last blank before other text does not belong to the run of blanks.
        upto = end - 1 if self.kind == BLANK and end < len(text) and end else end
        if self.kind == BLANK and not ended:
            upto, self.tail = max(0, end - 1), text[max(0, end - 1) :]
        self.coder.feed(text[:upto].encode(), out)
        if ended:
            self.coder.finish(out)
            self.kind = ""
            return out.tobytes(), text[upto:]
        return out.tobytes(), ""


class Decoder:
    """Turns ids into text, fed in any portions; bytes of an unfinished character wait for the next portion."""

    def __init__(self, rules: Merges):
        self.bytes = rules.bytes
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        numbers = array("I")
        numbers.frombytes(ids)
        return self.utf8.decode(b"".join(map(self.bytes.__getitem__, numbers)))

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


def encode_text(text: str | None, rules: Merges) -> bytes:
    coder, out = Encoder(rules), []
    for at in range(0, len(text or ""), PIECE_CHARS):
        out.append(coder.feed(text[at : at + PIECE_CHARS]))
    return b"".join(out) + coder.finish()


def decode_ids(ids: bytes | None, rules: Merges) -> str:
    coder, out = Decoder(rules), []
    for at in range(0, len(ids or b""), 4 * PIECE_CHARS):
        out.append(coder.feed(ids[at : at + 4 * PIECE_CHARS]))
    return "".join(out) + coder.finish()


def _in_portions(names: list[str], rows: Iterator[tuple], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= OUTPUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids``, the whole text's token ids as little-endian unsigned 32-bit integers, for every row.

    ``path`` is a byte-level BPE vocabulary file of the tokenizers library that all executors have. A null text counts as empty: no ids.
    Repeated rows are encoded alike. A special token's string in a text becomes that token. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = merges(path)
        for batch in batches:
            rows = ((d, encode_text(t.as_py(), rules)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            yield from _in_portions(["doc_id", "ids"], rows, [pa.int64(), pa.binary()])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """What :func:`encode` and :func:`decode` give one after the other (doc_id, ids, text), by one Python process for each task, not two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = merges(path)
        for batch in batches:
            coded = ((d, encode_text(t.as_py(), rules)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            rows = ((d, ids, decode_ids(ids, rules)) for d, ids in coded)
            yield from _in_portions(["doc_id", "ids", "text"], rows, [pa.int64(), pa.binary(), pa.string()])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary, text string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``text`` for the rows of ``encode``; null ids give an empty text, and broken UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = merges(path)
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            rows = ((d, i.as_py(), decode_ids(i.as_py(), rules)) for d, i in pairs)
            yield from _in_portions(["doc_id", "ids", "text"], rows, [pa.int64(), pa.binary(), pa.string()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
