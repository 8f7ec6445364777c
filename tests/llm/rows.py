"""Awkward documents, shared by the tests of all operators."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, or that other tables bring along.
CLASHING = ["hash", "key", "block", "number", "size", "fp", "score", "rank", "edge", "place", "n", "hits", "root", "held_out", "language", "spans",
            "simhash_key", "Simhash_Head", "simhash_id", "mix_of", "mix_whole", "mix_budget", "mix_threshold", "mix_repeats", "MIX_copy", "source_size", "target"]


def prose(seed: int, n: int, words: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randint(0, words)}" for _ in range(n))


PASSAGE = prose(1, 70)
LONG = prose(2, 20_000, 5_000)

ROWS: list[tuple] = [
    (None, "A text without an id. " + PASSAGE, "en", "a", 1),
    (None, None, None, None, None),
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, " \t\n\v\f\r ", "de", "b", 7),
    (4, LONG, "en", "hot", len(LONG)),
    (5, LONG, "en", "hot", len(LONG)),
    (5, LONG, "en", "hot", len(LONG)),
    (6, "x" * 100_000, "fr", "hot", 100_000),
    (7, "éé ñ x  y　z \U0001f600 <|endoftext|> end", "fr", "b", 30),
    (8, PASSAGE, "en", "hot", 1),
    (9, "before " + PASSAGE + "\tafter " + PASSAGE, "en", "hot", 1),
    (10, "mail me.too+x@mail-1.example.com or +1 (555) 010-4477, card 4111 1111 1111 1111, host 10.0.255.1.", "en", "c", 1),
    (11, "le la les de la du " * 5, "fr", "c", 1),
    (12, "le la les de la du " * 5, "fr", "c", 1),
    (13, "one", "en", "c", 3),
    (14, "one two", "en", "c", 7),
    (15, "word " * 500, "en", "hot", 2500),
]


def awkward(spark):
    """The rows, with extra columns of clashing names."""
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(c) for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
