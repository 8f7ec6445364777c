"""The transducer against the tokenizers library."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from podium.llm import bpe
from tests.llm.rows import ROWS, awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, RULES = Tokenizer.from_file(PATH), bpe.merges(PATH)
ALPHABETS = [
    "ab", "aab c", " \n\t a", "'srevtmld ", "é ñab", "!?'s ", "0123 ", "the andingionre", "՘\U00016ff4a1 ", "\x1c\x85  a　", "<|endoftext|> a",
]


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def in_portions(text, size):
    coder = bpe.Encoder(RULES)
    out = b"".join(coder.feed(text[at : at + size]) for at in range(0, len(text), size))
    return out + coder.finish()


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_any_portions_give_the_library_s_ids(alphabet, monkeypatch):
    draw = random.Random(alphabet)
    for _ in range(250):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60)))
        if draw.random() < 0.2:
            text += "<|endoftext|>" + text
        ids, decoded = expected(text)
        assert np.frombuffer(bpe.encode_text(text, RULES), "<u4").tolist() == ids
        monkeypatch.setattr(bpe, "OPEN_CHARS", draw.choice([4, 10, 4096]))
        monkeypatch.setattr(bpe, "CHECK_BYTES", draw.choice([5, 20, 4096]))
        got = in_portions(text, draw.choice([1, 2, 3, 7, 20]))
        assert np.frombuffer(got, "<u4").tolist() == ids
        coder = bpe.Decoder(RULES)
        assert "".join(coder.feed(got[at : at + 4]) for at in range(0, len(got), 4)) + coder.finish() == decoded
        monkeypatch.undo()


@pytest.mark.parametrize("alphabet", ["a", "ab", "! ", "  \n", "thein", "é", " ", "\U0001f600"])
def test_long_runs_take_constant_memory(alphabet):
    draw = random.Random(alphabet)
    text = "".join(draw.choice(alphabet) for _ in range(40_000))
    coder, held, out = bpe.Encoder(RULES), 0, b""
    for at in range(0, len(text), 1000):
        out += coder.feed(text[at : at + 1000])
        held = max(held, len(coder.coder.bytes) + len(coder.tail) + len(coder.text))
    out += coder.finish()
    assert np.frombuffer(out, "<u4").tolist() == expected(text)[0]
    assert held <= 4 * (bpe.CHECK_BYTES + bpe.OPEN_CHARS) + 4 * RULES.lookahead


def test_lookahead_is_the_longest_token():
    assert RULES.lookahead == max(map(len, RULES.ids)) == 128


def test_every_character_is_of_the_library_s_kind():
    points = [*range(0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x11000), *range(0x11D00, 0x12700), *range(0x16E00, 0x17000), *range(0x18C00, 0x18E00)]
    text = "".join(f"{chr(p)}a{chr(p)}1{chr(p)}!{chr(p)} " for p in points if not 0xD800 <= p < 0xE000)
    assert np.frombuffer(bpe.encode_text(text, RULES), "<u4").tolist() == expected(text)[0]


def test_broken_utf8_decodes_to_replacements():
    ids = [RULES.ids[b"\xff"], RULES.ids[b"\xc3"], RULES.ids[b"a"]]
    assert bpe.decode_ids(np.array(ids, "<u4").tobytes(), RULES) == LIBRARY.decode(ids) == "��a"


def test_awkward_rows(spark):
    for coded in (bpe.decode(bpe.encode(awkward(spark), PATH), PATH), bpe.round_trip(awkward(spark), PATH)):
        got = sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in coded.collect())
        assert got == sorted((repr(d), *expected(t or "")) for d, t, *_ in ROWS)


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(empty(spark), PATH), PATH).collect() == []
    assert bpe.round_trip(empty(spark), PATH).collect() == []


def test_full_caches_stay_small(monkeypatch):
    """Many different words leave two full generations behind, and frequent words are still known."""
    rules = bpe.Merges(PATH)
    monkeypatch.setattr(rules, "_path", lambda raw: [1, 2])
    tracemalloc.start()
    try:
        for i in range(430_000):
            rules.run(f" word{i}")
            if i % 1000 == 0:
                rules.run(" the")
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert " the" in rules._runs and len(rules._runs) + len(rules._older_runs) > 80_000
    assert held < 40e6
