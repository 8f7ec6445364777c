from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from podium.llm import language
from podium.llm.words import BLOCK_BYTES
from tests.llm.rows import awkward, empty

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = language.identify(docs, docs.filter(~language.held_out())).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.filter(language.held_out()).agg(F.avg((F.col("language") == F.col("lang")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] >= 0.98 and 0 <= right[1] <= right[2] <= 1


def test_prediction_uses_the_text_alone(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(100)
    learned = docs.filter(~language.held_out())
    plain = {r.doc_id: tuple(r)[1:] for r in language.identify(docs, learned).collect()}
    other = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"))
    assert {r.doc_id - 1000: tuple(r)[1:] for r in language.identify(other, learned).collect()} == plain


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = language.identify(docs, docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by_id[i].language for i in (1, 2, 3)] == ["und"] * 3 and not by_id[1].accepted
    assert by_id[11][1:] == by_id[12][1:] and by_id[11].language == "fr"
    kept = language.keep_identified(docs, docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} >= {4, 5, 8, 11, 12}
    assert kept.filter("doc_id IN (1, 2, 3)").count() == 0


def test_long_texts_are_read_to_their_end():
    learned = {"aa": b"lorem ipsum dolor " * 50, "bb": b"sit amet consetetur " * 50}
    by_language = language.compressors(learned)
    start, rest = "lorem ipsum dolor ", "sit amet consetetur "
    assert language.classify(start * 10 + rest * 5000, by_language)[0] == "bb"


def test_nothing_learned_and_no_rows(spark):
    docs = awkward(spark)
    assert {r.language for r in language.identify(docs, empty(spark)).collect()} == {"und"}
    assert language.identify(empty(spark), docs).collect() == []
    assert language.classify("le la", language.compressors({"fr": b"le la les"})) == ("fr", 1.0, True)


def test_a_copied_text_is_learned_from_once(spark):
    rows = [(i, "the same text again and again", "en") for i in range(500)] + [(1000, "another one entirely", "en")]
    (body,) = language.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string")).values()
    assert body.count(b"the same text") == 1 and b"another one" in body


def test_letters_beside_numerals_count():
    assert language.letters_only("5 m² ½ x½y ab") == b"m x y ab" and language.letters_only("² ½ 3") == b""
    assert language.classify("m²", language.compressors({"fr": b"le la les"}))[0] == "fr"


def test_kept_rows_are_handed_on_in_portions():
    """A batch of 12 MB of text goes on whole and in order, but a few MB at a time."""
    learned = language.compressors({"a": b"the cat sat on the mat", "b": b"xyz qrs tuv"})
    texts = [f"{'the cat sat on the mat ' * 1000}{i}" for i in range(500)] + ["12 34", None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    parts = list(language.accepted_rows(iter([batch]), learned))
    assert max(sum(len(t) for t in p.column("text").to_pylist()) for p in parts) <= BLOCK_BYTES
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(500))
