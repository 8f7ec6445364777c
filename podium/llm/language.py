"""Language identification by compression.

A language is known by a raw-content zstandard dictionary: a bounded sample of its texts. A text is compressed with every
language's dictionary, piece by piece over its whole length, and goes to the language that makes it smallest. If the runner-up is about as
small, the prediction is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.words import blocks
from podium.sources.scratch import stage

UNKNOWN = "und"
SAMPLE_ROWS = 64  # texts a language is learned from
SAMPLE_CHARS = 4096  # letters and spaces taken from each of them
LONG_ENOUGH = 200  # characters; shorter texts are learned from only where a language has too few others
LEVEL = 9
PIECE = 16 * 1024  # bytes compressed at a time, so that the dictionary counts as much at the end of a long text
MIN_MARGIN = 0.01
#: A run that always compresses. Without it, zstandard stores short pieces as they are and their sizes tell nothing.
FILLER = b"\n" * 48

_LETTERS = re.compile(r"[^\W\d_]+")
RESULT = "language string, score double, accepted boolean"


def letters_only(text: str) -> bytes:
    """Runs of letters in lower case, one space between them."""
    runs = _LETTERS.findall(text.lower())
    if not all(map(str.isalpha, runs)):  # numerals such as a superscript two are no letters
        runs = "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()
    return " ".join(runs).encode()


def dictionaries(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """One dictionary for each value of ``lang``, from the columns ``text`` and ``lang``.

    At most ``rows`` different texts with at most ``chars`` letters and spaces of each reach the driver for a language: those of smallest
    text hash, so equal tables give equal dictionaries and copies of a text count once. Rows without a text or language teach nothing.
    """
    known = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select(
        "lang", F.xxhash64("text").alias("hash"), (F.length("text") < LONG_ENOUGH).alias("short"), "text"
    )
    first = Window.partitionBy("lang").orderBy("short", "hash")
    chosen = known.select("lang", "hash", "short").distinct().withColumn("place", F.row_number().over(first))
    chosen = chosen.filter(F.col("place") <= rows).select(F.col("lang").alias("l"), F.col("hash").alias("h"), "place")
    chosen = stage(chosen, "language-samples")  # its size on disk is known when the join is planned
    found = known.join(chosen, (known["lang"] == chosen["l"]) & (known["hash"] == chosen["h"]))
    samples = found.groupBy("lang", "place").agg(F.first(F.substring("text", 1, 2 * chars)).alias("sample"))
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for row in samples.collect():  # rows x languages
        body = letters_only(row["sample"]).decode()[:chars].encode()
        if body:
            parts.setdefault(row["lang"], []).append((row["place"], body))
    return {lang: b" ".join(body for _, body in sorted(some)) for lang, some in sorted(parts.items())}


def compressors(learned: dict[str, bytes], level: int = LEVEL) -> dict[str, zstandard.ZstdCompressor]:
    made = {}
    for lang, body in learned.items():
        content = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        made[lang] = zstandard.ZstdCompressor(
            level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False
        )
    return made


def classify(text: str | None, by_language: dict, min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
    """Language, margin (how much smaller than the runner-up, from 0 to 1), and whether the margin is wide enough."""
    body = letters_only(text) if text is not None else b""
    if not body or not by_language:
        return UNKNOWN, 0.0, False
    sizes = dict.fromkeys(by_language, 0)
    for at in range(0, len(body), PIECE):
        piece = body[at : at + PIECE] + FILLER
        for lang, compressor in by_language.items():
            sizes[lang] += len(compressor.compress(piece))
    ranked = sorted((size, lang) for lang, size in sizes.items())
    if len(ranked) == 1:
        return ranked[0][1], 1.0, True
    margin = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
    return ranked[0][1], margin, margin >= min_margin


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether the crc32 of the id's text leaves ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, training: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``doc_id`` and the prediction for every row of ``docs``; languages are learned from ``training`` (text, lang).

    A text that is null or has no letter is ``und`` and rejected. Equal sizes go to the language first by name, with score 0, and are rejected.
    A rejected text still names its likeliest language. Repeated rows are predicted alike. Without any labelled text everything is
    ``und``. An empty table gives an empty result.
    """
    learned = dictionaries(training)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_language = compressors(learned)
        for batch in batches:
            found = [classify(t.as_py(), by_language, min_margin) for t in batch.column("text")]
            language, score, accepted = zip(*found, strict=True) if found else ([], [], [])
            columns = [pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "language", "score", "accepted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(predict, f"doc_id long, {RESULT}")


def accepted_rows(batches: Iterator[pa.RecordBatch], by_language: dict, min_margin: float = MIN_MARGIN) -> Iterator[pa.RecordBatch]:
    """The accepted rows of each batch, in portions, so that neither this process nor Spark holds a second whole batch of texts."""
    for batch in batches:
        for part in blocks(batch):
            accepted = [classify(t.as_py(), by_language, min_margin)[2] for t in part.column("text")]
            yield part.filter(pa.array(accepted, pa.bool_()))


def keep_identified(docs: DataFrame, training: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is told with a wide enough margin, with their own columns."""
    learned = dictionaries(training)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from accepted_rows(batches, compressors(learned), min_margin)

    return docs.mapInArrow(keep, docs.schema)
