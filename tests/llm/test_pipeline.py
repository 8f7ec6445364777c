"""The pipeline stage by stage against brute force, and the registered queries."""

from __future__ import annotations

import collections
import hashlib
import importlib
import os
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from podium.llm import language, simhash_links
from podium.llm.queries import ORACLES, QUERIES
from podium.sources.scratch import stage
from tests.llm.rows import CLASHING, ROWS, SCHEMA, awkward, empty
from tests.llm.test_mixing import shared_out
from tests.llm.test_pii import plain_spans
from tests.llm.test_simhash_links import plain_fingerprint
from tests.oracle import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def groups(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "redact_pii", "mix_sources", "encode_bpe"]
    rows = {r.doc_id: r for r in docs.collect()}

    told = stage(stages["language_id"](spark, docs, SF_DIR), "test")
    assert told.columns == COLUMNS
    by_language = language.compressors(language.dictionaries(docs.filter(~language.held_out())))
    want = {d for d, r in rows.items() if language.classify(r.text, by_language)[2]}
    assert {r.doc_id for r in told.collect()} == want and len(want) > 0.99 * len(rows)

    single = stage(stages["near_dedup"](spark, told, SF_DIR), "test")
    ids = sorted(want)
    group = groups([plain_fingerprint(rows[d].text) for d in ids])
    heads = {min(d for d, g in zip(ids, group) if g == own) for own in set(group)}
    kept = {r.doc_id: r for r in single.collect()}
    assert single.columns == COLUMNS and set(kept) == heads
    assert all(kept[d] == rows[d] for d in kept)

    clean = stage(stages["redact_pii"](spark, single, SF_DIR), "test")
    redacted = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == COLUMNS and set(redacted) == heads
    for d, r in redacted.items():
        text, spans = kept[d].text, plain_spans(kept[d].text)
        if not any(c in text for c in "0123456789@+"):
            assert r == kept[d]
        at = 0
        for start, _, end in spans:  # what lies between two spans, and nothing of them
            if start >= at:
                assert not plain_spans(r.text) or text[start:end] not in r.text
            at = end
        assert r.n_chars == len(r.text) and plain_spans(r.text) == []

    mixed = stage(stages["mix_sources"](spark, clean, SF_DIR), "test")
    assert mixed.columns == COLUMNS
    words = lambda r: len(r.text.encode().split())
    sizes, taken = collections.Counter(), collections.Counter()
    for r in redacted.values():
        sizes[r.source] += words(r)
    times = collections.Counter(r.doc_id for r in mixed.collect())
    for d, n in times.items():
        assert n <= 3
        taken[redacted[d].source] += n * words(redacted[d])
    largest = max(map(words, redacted.values()))
    for source, target in shared_out(sizes).items():
        assert abs(taken[source] - target) <= largest

    coded = stages["encode_bpe"](spark, mixed, SF_DIR).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert collections.Counter(r.doc_id for r in coded) == times
    for r in coded:
        ids = np.array(library.encode(redacted[r.doc_id].text, add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, bytes(r.ids)) == (len(ids), ids.tobytes())
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(redacted[r.doc_id].text.encode()).hexdigest()


def test_run_is_all_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF_DIR), "test")
    want = sorted((r.doc_id, r.ids_sha256) for r in docs.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect()) == want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("make", [awkward, empty])
def test_each_stage_takes_awkward_and_no_rows(spark, name, make):
    docs = make(spark)
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, SF_DIR)
    if name != "encode_bpe":
        assert got.columns == docs.columns
        given = [docs.first()[c] for c in CLASHING] if make is awkward else []
        assert all([r[c] for c in CLASHING] == given for r in got.collect())
    n = got.count()
    assert n == 0 if make is empty else n > 0
    if make is awkward and name in ("redact_pii", "encode_bpe"):
        assert n == len(ROWS)


def test_rows_without_any_text(spark):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, "", None, None, 0)], SCHEMA)
    for name, apply in corpus_pipeline.STAGES:
        apply(spark, docs, SF_DIR).collect()


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_equal_their_sql(spark, name):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


CONTRACT = {
    "op1": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op4": "doc_id bigint, fingerprint string, component_id bigint",
    "op5": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op7": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op10": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op11": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, "
    "toxic_lost bigint, shapley bigint",
    "op12": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op13": "item_id bigint, rank int, doc_id bigint, score bigint",
}


def test_queries_return_what_is_agreed(spark):
    names = {n.split("_")[0]: n for n in QUERIES}
    assert len(QUERIES) == len(names) == 13
    for short, columns in CONTRACT.items():
        frame = QUERIES[names[short]](spark, "/root/testdata/sf0.001")
        types = dict(frame.dtypes)
        for column in columns.split(", "):
            name, kind = column.split()
            assert types[name] == kind, (short, name, types[name])
        if short not in ("op9", "op11", "op12", "op13"):
            assert frame.count() == 200


def test_op1_base_against_the_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in QUERIES["op1_pii_skip_chain"](spark, "/root/testdata/sf0.01").collect():
        spans = plain_spans(texts[r.doc_id])
        kinds = collections.Counter(k for _, k, _ in spans)
        joined = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in range(4))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_entry_works_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        reloaded = importlib.reload(__spark_entry__)
        assert not any(n.startswith("op") or n == "pipeline" for n in reloaded.queries())
        assert len(reloaded.queries()) > 60
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
    assert "pipeline" in __spark_entry__.queries()


def test_fingerprint_of_the_library_is_ours():
    assert simhash_links.fingerprint("A b C d") == plain_fingerprint("A b C d")
