from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm import pii
from tests.llm.rows import ROWS, SCHEMA, awkward, empty

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = (
                True,
                kind != 1 or all(int(p) <= 255 for p in m.group().split(".")),
                14 <= len(digits) <= 19 and luhn(digits),
                10 <= len(digits) <= 15,
            )[kind]
            if fine:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


ALPHABETS = ["a@.-1", "1.25", "0123456789 -", "+1 ().-2", "a1@b.c+ %_é"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
@settings(max_examples=400, deadline=None)
@given(st.data())
def test_base_spans_are_those_of_the_patterns(alphabet, data):
    text = data.draw(st.text(alphabet=alphabet, max_size=40))
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_cards_and_phones():
    draw = random.Random(1)
    for _ in range(300):
        card = "".join(draw.choice("0123456789") + draw.choice(["", "", " ", "-"]) for _ in range(draw.randint(12, 20)))
        text = f"x {card} y +1 ({draw.randint(100, 999)}) 555-{draw.randint(1000, 9999)} {draw.randint(0, 300)}.1.1.{draw.randint(0, 300)}"
        assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000, "9" * 5000 + ".1.1.1"):
        pii.base_spans(text)
        pii.marked_words(text)


def test_marked_words():
    text = "a 1b\tc@d\n\v+ e é2 \f9"
    assert [text[a:b] for a, b in pii.marked_words(text)] == [w for w in re.split(r"[\x20\x09-\x0D]+", text) if re.search("[0-9@+]", w)]


def sample():
    draw = random.Random(3)
    out = []
    for _ in range(300):
        ip = ".".join(str(draw.randint(0, 255)) for _ in range(4))
        phone = f"+1 ({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)}"
        out.append(f"call {phone} from {ip} or version {draw.randint(1, 9)}.{draw.randint(0, 9)} in {draw.randint(1990, 2024)} by a{draw.randint(1, 99)}@mail.example.com today, then call {phone} again")
    return out


@pytest.fixture(scope="module")
def field():
    return pii.train(sample())


def test_distant_like_words_agree(field):
    """A word is taken for what a repetition of it in clear context is; alone it stays less sure."""
    graph = pii.Graph()
    text = "call +1 (555) 555-0199 now or later 555-0199 again"
    graph.add(text, pii.marked_words(text))
    assert graph.skip  # the second 555-0199 is linked to the first
    linked = field.marginals(graph)[-1]
    cut = pii.Graph()
    cut.add(text, pii.marked_words(text))
    cut.skip = []
    assert linked[pii.LABELS.index("phone")] > field.marginals(cut)[-1][pii.LABELS.index("phone")]


def test_repeats_far_from_clear_context_are_labelled_alike(field):
    import numpy as np

    text = "call +1 (555) 555-0199 now" + " or later 555-0199 again" * 100
    graph = pii.Graph()
    graph.add(text, pii.marked_words(text))
    bare = field.marginals(graph)[-100:]
    assert len(bare) == 100 and np.ptp(bare, axis=0).max() < 1e-3
    base, spans = pii.find_all([text], field)[0]
    found = [text[a:b] for a, _, b in spans if (a, _, b) not in base]
    assert found == ["555-0199"] * 100


def test_messages_on_a_tree_are_exact(field):
    """Without cycles, enough rounds give the marginals of summing over all labellings."""
    import itertools

    import numpy as np

    graph = pii.Graph()
    text = "+1 (555) 555-0199 x 10.0.0.1"
    graph.add(text, pii.marked_words(text))
    features, chain, skip = graph.arrays()
    assert len(skip) == 0
    own = field.nodes[features].sum(axis=1)
    total = np.zeros_like(own)
    for labels in itertools.product(range(5), repeat=len(own)):
        weight = np.exp(sum(own[i, y] for i, y in enumerate(labels)) + sum(field.chain[labels[a], labels[b]] for a, b in chain))
        for i, y in enumerate(labels):
            total[i, y] += weight
    want = total / total.sum(axis=1, keepdims=True)
    assert np.abs(field.marginals(graph) - want).max() < 0.02


def test_what_the_rules_find_stays_and_results_do_not_depend_on_neighbours(field):
    texts = [t for _, t, *_ in ROWS] + sample()[:50]
    together = pii.find_all(texts, field)
    for text, (base, spans) in zip(texts, together):
        assert base == plain_spans(text) and set(base) <= set(spans) and spans == sorted(spans)
        assert all(a[2] <= b[0] or a in base or b in base for a, b in zip(spans, spans[1:]))
        assert pii.find_all([text], field)[0] == (base, spans)


def test_clean_texts_are_left_alone(field):
    clean = ["Version 2.0. is here", "in 1999 and 2024, chapter 3.", "no marks at all", "a + b = c"]
    assert [spans for _, spans in pii.find_all(clean, field)] == [[]] * len(clean)


def cued_texts(n, seed):
    """Personal data after a cue, and harmless numbers after other words."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        phone = f"+1 ({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)}"
        ip = ".".join(str(draw.randint(0, 255)) for _ in range(4))
        out.append(
            f"w{'xyz'[i % 3]} please call {phone} or write to b{draw.randint(1, 99)}@mail.example.com soon, in {draw.randint(1990, 2024)} {draw.randint(2, 9)} people came, "
            f"token = \"{draw.getrandbits(120):030x}\" version {draw.randint(1, 9)}.{draw.randint(0, 9)} order {draw.randint(10**7, 10**9)} from host {ip} up"
        )
    return out


def test_what_follows_a_cue_is_found_beyond_the_rules():
    """Numbers that fit no rule are found after a word that stands before phones, and nowhere else."""
    field = pii.train(cued_texts(400, 5))
    assert field.cues["call"] == "phone" and field.cues["host"] == "ip" and "order" not in field.cues and "in" not in field.cues
    draw = random.Random(6)
    numbers = [draw.choice(["5551{:06d}", "555-{:07d}", "(555){:07d}", "555.{:07d}"]).format(draw.randint(0, 999_999)) for _ in range(60)]
    hits = []
    for number in numbers:
        text = f"so please call {number} now"
        base, spans = pii.find_all([text], field)[0]
        assert base == []
        hits += [text[a:b] for a, k, b in spans if pii.KINDS[k] == "phone"]
    recall = len(hits) / len(numbers)
    assert recall > 0.5, recall
    clean = [f"so they order {n} now" for n in numbers] + [f"call {n} people in {1990 + n}" for n in range(2, 30)] + ["please call me", 'token = "9f8e7d6c5b4a39281706f5e4d3c2b1"']
    assert [t for t, (_, spans) in zip(clean, pii.find_all(clean, field), strict=True) if spans] == []


def test_like_words_are_linked_whatever_their_case_and_punctuation(field):
    graph = pii.Graph()
    text = "Bob@Example.org and bob@example.org, or <bob@example.org> not (BOB@example.org.) so carl@example.org"
    graph.add(text, pii.marked_words(text))
    assert graph.skip == [(0, 1), (1, 2), (2, 3)]


def test_long_texts_teach(spark):
    long = [" ".join(["filler"] * 3000) + " " + t + " " + " ".join(["filler"] * 3000) for t in cued_texts(40, 8)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(long)], SCHEMA)
    field = pii.fit(docs)
    assert abs(field.nodes).sum() > 0 and field.cues["call"] == "phone"


def test_redaction():
    assert pii.redact("a b@c.de f", [(2, 0, 8)]) == "a [EMAIL] f"
    assert pii.redact("0123456789", [(1, 2, 5), (3, 3, 7)]) == "0[CARD]789"


def test_awkward_rows(spark):
    got = pii.find(awkward(spark)).collect()
    joined = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    assert sorted((repr(r.doc_id), r.base) for r in got) == sorted((repr(d), joined(plain_spans(t))) for d, t, *_ in ROWS)
    docs = awkward(spark)
    clean = pii.redacted(docs, pii.fit(docs))
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = clean.filter("doc_id = 10").first().text
    assert "[EMAIL]" in text and "[PHONE]" in text and "[CARD]" in text and "[IP]" in text and plain_spans(text) == []
    assert clean.filter("doc_id = 8").first().text == ROWS[10][1]


def test_empty_table(spark):
    assert pii.find(empty(spark)).collect() == []
