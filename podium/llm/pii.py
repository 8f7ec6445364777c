"""Personal data by rules and a skip-chain conditional random field.

Rules find emails, IP addresses, cards and phone numbers. A conditional random field then labels every word that holds a digit, an
``@`` or a ``+``; all other words have only the label "none", which cuts the chain between them. Neighbouring words are linked, and so are
words of a document that are equal or have the same digits, however far apart: each to a variable that all like words share, so a word repeated a
thousand times has as many links, and any two are two links apart. Loopy message passing, until the messages stand still, makes the labels of a
document agree. What the field finds beyond the rules is added; what the rules find stays.

The field is trained here, on a bounded sample of texts labelled by the rules, by maximising its pseudo-likelihood. To find more than the rules do, it has to know them by
something else than their own patterns: words that mostly stand before one kind ("call", "from") are learned as cues, and training sees what follows a cue once
more by the cue alone and once without it, and each of two like words once more by the other alone, with the rest held back. What follows a cue and looks like a number or an
address, but fits no rule, is taken for unknown there, not for harmless.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.sources.scratch import stage

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE_ROWS = 1000  # different texts that the field is trained on, at most
SAMPLE_CHARS = 8192  # of a longer text, a stretch of this length around a marked word is trained on
FEATURES = 4096
HIDDEN = FEATURES  # a feature without weight
CUE_TEXTS, CUE_SHARE = 5, 0.9  # texts in which a word stands before a kind, and how often it is this kind, to be its cue
CUE_REACH = 48  # characters before a word in which its two last ordinary words are looked for
NUMBER_DIGITS = 7  # what follows a cue and has this many digits and no letter, or an @, may be personal data
STILL, ROUNDS = 1e-3, 1000  # how little messages move at the end; rounds after which those that swing for ever are stopped
STEPS, RATE, PENALTY = 300, 0.5, 1e-4
SURE = 0.9  # probability from which a word's label counts

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@+]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_REPEATS = re.compile(r"(.)\1+", re.S)
Span = tuple[int, int, int]  # start, number of the kind, end


def passes_luhn(digits: str) -> bool:
    numbers = [int(d) for d in reversed(digits)]
    doubled = [2 * d - 9 if d > 4 else 2 * d for d in numbers[1::2]]
    return (sum(numbers[::2]) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, 0, found.end()
            done = found.end()
        else:
            done = at + 1  # nothing before a failed @ can start an address beyond it
        at = text.find("@", done)


def base_spans(text: str | None) -> list[Span]:
    """What the rules find in a whole text, by start and then kind; positions are code points.

    For each kind the leftmost matches that do not overlap; those that fail its test (parts up to 255, 14 to 19 digits that pass Luhn, 10 to 15
    digits) are dropped and not looked into again.
    """
    if not text:
        return []
    found = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() <= 37 else ""
            if 14 <= len(digits) <= 19 and passes_luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def marked_words(text: str) -> list[tuple[int, int]]:
    """Start and end of each word that holds a digit, an @ or a +."""
    out, done = [], 0
    mark = _MARK.search(text)
    while mark:
        at = mark.start()
        start = max([done, *(text.rfind(b, done, at) + 1 for b in " \t\n\v\f\r")])
        blank = _BLANK.search(text, at)
        done = blank.start() if blank else len(text)
        out.append((start, done))
        mark = _MARK.search(text, done)
    return out


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


def _shape(word: str) -> str:
    kinds = "".join("0" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return _REPEATS.sub(r"\1+", kinds)[:64]


_LETTERS = re.compile(r"[^\W\d_]+")
_EDGES = ".,;:!?\"'()[]{}<>#$%&|*`~"


def _size(n: int) -> str:
    return "short" if n < NUMBER_DIGITS else "middle" if n < 14 else "card" if n <= 19 else "long"


def _number_like(words: list[str], near: list[bool]) -> list[bool]:
    """Whether each word is in a run of marked words that has an @, or many digits and no letter."""
    out: list[bool] = []
    for i in range(len(words)):
        if not near[i]:
            end = next((j for j in range(i + 1, len(words)) if not near[j]), len(words))
            run = "".join(words[i:end])
            like = "@" in run or (len(_NOT_DIGIT.sub("", run)) >= NUMBER_DIGITS and not any(map(str.isalpha, run)))
            out += [like] * (end - i)
    return out


def _features(words: list[str], near: list[bool], cues: list[str]) -> list[list[int]]:
    """Feature numbers of each marked word; ``near[i]``: word i - 1 is right before it."""
    shapes = [_shape(w) for w in words]
    out = []
    for i, word in enumerate(words):
        digits = _NOT_DIGIT.sub("", word)
        core = word.strip(_EDGES)
        before = shapes[i - 1] if near[i] else "-"
        after = shapes[i + 1] if i + 1 < len(words) and near[i + 1] else "-"
        size = _size(len(digits))
        if cues[i] != "-":
            size += " cued"  # what such a form means elsewhere says little here
        out.append([
            _slot(x)
            for x in (
                f"shape {shapes[i]} {size}",
                f"core {_shape(core)} {size}",
                f"digits {min(len(digits), 24)}",
                f"only digits {core.isdigit()} {size} {14 <= len(digits) <= 19 and passes_luhn(digits)}",
                f"at {core.count('@')} dots {min(core.count('.'), 5)} {size}",
                f"plus {core[:1] == '+'} letters {any(map(str.isalpha, core))}",
                f"before {before}",
                f"after {after}",
                f"both {before} {_shape(core)} {size} {after}",
                "all",
                f"cue {cues[i]}",
            )
        ])
    return out


def context(text: str, spans: list[tuple[int, int]], near: list[bool]) -> list[list[str]]:
    """For each marked word the two ordinary words before it, the nearer one first; marked words in a row share those before the first."""
    out: list[list[str]] = []
    for i, (start, _) in enumerate(spans):
        if near[i]:
            out.append(out[-1])
            continue
        low = max(spans[i - 1][1] if i else 0, start - CUE_REACH)
        found = list(_LETTERS.finditer(text, low, start))
        if found and low == found[0].start() and low and text[low - 1].isalpha():
            del found[0]  # the end of a word
        out.append([m.group().lower() for m in found[-2:][::-1]])
    return out


class Graph:
    """Marked words of some documents, their features and their links. ``cues``: the kind that a word stands before."""

    def __init__(self, cues: dict[str, str] | None = None) -> None:
        self.cues = cues or {}
        self.features: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []  # each word and the like one before it

    def add(self, text: str, spans: list[tuple[int, int]]) -> list[str]:
        """Add a text's marked words; returns the kind each is cued for, or "-". Small numbers are cued for nothing."""
        first = len(self.features)
        words = [text[a:b] for a, b in spans]
        # Between two neighbours there are blanks only.
        near = [i > 0 and not text[spans[i - 1][1] : a].strip(" \t\n\v\f\r") for i, (a, _) in enumerate(spans)]
        cued = ["-"] * len(spans)
        if self.cues:
            like = _number_like(words, near)
            cued = [
                next((self.cues[w] for w in some if w in self.cues), "-") if may_be else "-"
                for some, may_be in zip(context(text, spans, near), like, strict=True)
            ]
        self.features += _features(words, near, cued)
        self.chain += [(first + i - 1, first + i) for i, n in enumerate(near) if n]
        seen: dict[str, int] = {}
        for i, word in enumerate(words):
            digits = _NOT_DIGIT.sub("", word)
            core = word.strip(_EDGES).casefold()  # punctuation and case make no other word
            likeness = {f"word {core}", f"digits {digits}" if len(digits) >= 4 else f"word {core}"}
            others = {seen[x] for x in likeness if x in seen}
            self.skip += [(first + j, first + i) for j in sorted(others)]
            seen |= dict.fromkeys(likeness, i)
        return cued

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = [np.array(x, dtype=np.int64).reshape(-1, 2) for x in (self.chain, self.skip)]
        return np.array(self.features, dtype=np.int64), pairs[0], pairs[1]


class Field:
    """Weights of features, of neighbouring labels and of labels of like words, and the cues."""

    def __init__(self, nodes: np.ndarray, chain: np.ndarray, skip: np.ndarray, cues: dict[str, str] | None = None):
        self.nodes, self.chain, self.skip, self.cues = nodes, chain, skip, cues or {}

    def marginals(self, graph: Graph) -> np.ndarray:
        """Each word's label probabilities by loopy message passing. Each message ends when it and what it tells stand still, so that
        a document's result does not depend on those computed with it."""
        features, chain, skip = graph.arrays()
        n = len(features)
        own = self.nodes[features].sum(axis=1)
        head = np.arange(n)
        for before, word in skip.tolist():
            head[word] = head[before]
        members = np.unique(skip)
        shared, number = np.unique(head[members], return_inverse=True)
        own = np.concatenate([own, np.zeros((len(shared), 5))])
        links = np.concatenate([chain, np.stack([members, n + number], axis=1)])
        if not len(links):
            return _softmax(own)
        half = _half(self.skip)
        tables = np.concatenate([np.broadcast_to(self.chain, (len(chain), 5, 5)), np.broadcast_to(half, (len(members), 5, 5))])
        source = np.concatenate([links[:, 0], links[:, 1]])
        target = np.concatenate([links[:, 1], links[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        factors = np.exp(tables)
        sent = np.zeros((len(source), 5))
        belief = own.copy()
        live = np.arange(len(source))  # messages that move, and those from words that such a message reached
        for _ in range(ROUNDS):
            told = belief[source[live]] - sent[back[live]]
            told = np.exp(told - told.max(axis=1, keepdims=True))
            new = np.log((told[:, :, None] * factors[live]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            step = 0.5 * (new - sent[live])
            sent[live] += step
            np.add.at(belief, target[live], step)
            moved = live[np.abs(step).max(axis=1) > STILL]
            reached = np.zeros(len(own), dtype=bool)
            reached[target[moved]] = True
            again = reached[source]
            again[moved] = True
            live = np.flatnonzero(again)
            if not len(live):
                break
        return _softmax(belief[:n])


def _half(table: np.ndarray) -> np.ndarray:
    """The table of a link to a shared variable: two of them in a row are as strong as ``table``, the link of a word to a like one."""
    values, vectors = np.linalg.eigh(np.exp((table + table.T) / 2))
    return np.log(np.maximum((vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T, 1e-6))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _gold(spans: list[tuple[int, int]], base: list[Span]) -> list[int]:
    """The label of each word: the kind of a rule's span that covers part of it."""
    return [next((k + 1 for s, k, e in base if s < b and a < e), 0) for a, b in spans]


def learn_cues(texts: list[str]) -> dict[str, str]:
    """Words that stand before one kind in CUE_TEXTS texts or more and, of all marked words they stand before that are no bare small numbers, mostly before it."""
    before: dict[str, Counter] = {}
    for text in set(texts):
        spans = marked_words(text)
        near = [i > 0 and not text[spans[i - 1][1] : a].strip(" \t\n\v\f\r") for i, (a, _) in enumerate(spans)]
        met = {(w, label) for some, label in zip(context(text, spans, near), _gold(spans, base_spans(text)), strict=True) if label for w in some[:1]}
        for word, label in met:
            before.setdefault(word, Counter())[label] += 1
    cues = {}
    for word, labels in before.items():
        (label, n), all_ = labels.most_common(1)[0], labels.total()
        if n >= CUE_TEXTS and n >= CUE_SHARE * all_:
            cues[word] = LABELS[label]
    return cues


def train(texts: list[str]) -> Field:
    """Maximise the pseudo-likelihood: each word's label given its features and the labels of the words it is linked to."""
    cues = learn_cues(texts)
    graph, uncued, gold, cued = Graph(cues), Graph(), [], []
    for text in texts:
        spans = marked_words(text)
        cued += graph.add(text, spans)
        uncued.add(text, spans)
        gold += _gold(spans, base_spans(text))
    field = Field(np.zeros((FEATURES + 1, 5)), np.zeros((5, 5)), np.zeros((5, 5)), cues)
    if not gold:
        return field
    features, chain, skip = graph.arrays()
    y = np.array(gold)
    has_cue = np.array([c != "-" for c in cued])
    unknown = has_cue & (y == 0)
    # Links to what is not known teach nothing.
    chain, skip = (links[~unknown[links].any(axis=1)] for links in (chain, skip))
    # A word is seen once more by its cue alone, once more without its cue, and once more by each like word alone.
    by_cue = np.flatnonzero(has_cue & ~unknown)
    alone = np.full((2 * len(by_cue) + 2 * len(skip), features.shape[1]), HIDDEN)
    alone[: len(by_cue), -1] = features[by_cue, -1]
    alone[len(by_cue) : 2 * len(by_cue)] = uncued.arrays()[0][by_cue]
    copies = len(y) + 2 * len(by_cue) + np.arange(2 * len(skip))
    of = np.concatenate([by_cue, by_cue, skip[:, 1], skip[:, 0]])
    skip = np.concatenate([skip, np.stack([skip[:, 0], copies[: len(skip)]], axis=1), np.stack([copies[len(skip) :], skip[:, 1]], axis=1)])
    features = np.concatenate([features, alone])
    unknown = np.concatenate([unknown, np.zeros(len(of), dtype=bool)])
    y = np.concatenate([y, y[of]])
    n = len(y)
    truth = np.eye(5)[y]
    # Rare kinds weigh as much as frequent ones, up to a factor.
    weight = np.minimum(10.0, n / (5 * np.maximum(1, np.bincount(y, minlength=5))))[y]
    weight /= weight.mean()
    weight[unknown] = 0
    moments = [np.zeros_like(w) for w in (field.nodes, field.chain, field.skip)]
    for _ in range(STEPS):
        scores = field.nodes[features].sum(axis=1)
        for links, table in ((chain, field.chain), (skip, field.skip)):
            np.add.at(scores, links[:, 1], table[y[links[:, 0]]])
            np.add.at(scores, links[:, 0], table.T[y[links[:, 1]]])
        error = (_softmax(scores) - truth) * weight[:, None] / n
        slopes = [np.zeros_like(field.nodes), np.zeros((5, 5)), np.zeros((5, 5))]
        np.add.at(slopes[0], features.ravel(), np.repeat(error, features.shape[1], axis=0))
        for links, slope in ((chain, slopes[1]), (skip, slopes[2])):
            np.add.at(slope, y[links[:, 0]], error[links[:, 1]])
            np.add.at(slope.T, y[links[:, 1]], error[links[:, 0]])
        for w, g, m in zip((field.nodes, field.chain, field.skip), slopes, moments, strict=True):
            g += PENALTY * w
            m += g * g
            w -= RATE * g / (np.sqrt(m) + 1e-8)
        field.nodes[HIDDEN] = 0
    return field


def fit(docs: DataFrame) -> Field:
    """Train on at most SAMPLE_ROWS different texts that hold a marked word: those of smallest text hash, so equal tables give equal fields.

    Of a text longer than SAMPLE_CHARS, whole words of a stretch of that length are taken, around the first marked word after a place that its hash chooses.
    """
    some = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("hash")).filter(F.col("text").rlike("[0-9@+]"))
    chosen = stage(some.select("hash").distinct().orderBy("hash").limit(SAMPLE_ROWS).select(F.col("hash").alias("h")), "pii-sample")
    found = some.join(chosen, some["hash"] == chosen["h"])
    place = F.pmod(F.xxhash64("hash"), F.length("text").cast("long")).cast("int")
    later = F.regexp_instr(F.substr("text", place + 1), F.lit("[0-9@+]"))
    marked = F.when(later > 0, place + later).otherwise(F.regexp_instr("text", F.lit("[0-9@+]")))
    start = F.greatest(marked - SAMPLE_CHARS // 2, F.lit(1))
    stretch = F.regexp_replace(F.substr("text", start, F.lit(SAMPLE_CHARS)), r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]|[\x20\x09-\x0D][^\x20\x09-\x0D]*$", "")
    short = F.when(F.length("text") <= SAMPLE_CHARS, F.col("text")).otherwise(stretch)
    texts = found.groupBy("hash").agg(F.first(short).alias("text")).orderBy("hash").collect()  # SAMPLE_ROWS at most
    return train([row["text"] for row in texts])


def added_spans(text: str, spans: list[tuple[int, int]], labels: np.ndarray, sure: np.ndarray, base: list[Span], near: set[int]) -> list[Span]:
    """Words of one label in a row, less what is punctuation at their ends, where no rule found anything."""
    out: list[Span] = []
    i = 0
    while i < len(spans):
        label = int(labels[i]) if sure[i] >= SURE else 0
        j = i + 1
        while label and j < len(spans) and j in near and labels[j] == label and sure[j] >= SURE:
            j += 1
        if label:
            a, b = spans[i][0], spans[j - 1][1]
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while a < b and not text[b - 1].isalnum():
                b -= 1
            if a < b and not any(s < b and a < e for s, _, e in base):
                out.append((a, label - 1, b))
        i = j
    return out


def find_all(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text the rules' spans, and all spans."""
    graph, held, out = Graph(field.cues), [], []
    for text in texts:
        base = base_spans(text)
        spans = marked_words(text) if text else []
        first = len(graph.features)
        links = len(graph.chain)
        if spans:
            graph.add(text, spans)
        near = {b - first for _, b in graph.chain[links:]}
        held.append((text, base, spans, first, near))
    marginals = field.marginals(graph) if graph.features else np.zeros((0, 5))
    labels, sure = marginals.argmax(axis=1), marginals.max(axis=1, initial=0)
    for text, base, spans, first, near in held:
        part = slice(first, first + len(spans))
        more = added_spans(text, spans, labels[part], sure[part], base, near) if spans else []
        out.append((base, sorted(base + more)))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id``, ``base`` and ``spans``: what the rules find and everything, as ``kind:start:end`` joined by commas, for every row.

    The field is fitted to ``docs`` unless given. A null text has no spans, as an empty one. Repeated rows get equal results. An
    empty table gives an empty result.
    """
    model = field or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                found = find_all(texts.slice(at, 256).to_pylist(), model)
                columns = [ids.slice(at, 256), pa.array([_joined(b) for b, _ in found]), pa.array([_joined(a) for _, a in found])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "spans"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, base string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the name of the kind that begins it."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs`` with texts without their personal data; null stays null, and other columns stay as they are."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                texts = part.column(at).to_pylist()
                out = [redact(t, spans) if spans else t for t, (_, spans) in zip(texts, find_all(texts, field), strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)
