"""One query for each corpus operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import (
    bpe,
    filter_audit,
    fingerprints,
    language,
    language_model,
    mixing,
    packing,
    passages,
    pii,
    ranked_search,
    simhash_links,
    suffixes,
    topk,
)

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def corpus_query(sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query under its function's name."""

    def register(build: Build) -> Build:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@corpus_query(mixing.SQL)
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document by the mix of all sources."""
    chosen = mixing.mix(table(spark, sf_dir, "documents"))
    return chosen.select("doc_id", "size", "source_size", "target", "taken")


@corpus_query(topk.SQL)
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector against all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


@corpus_query()
def op7_language_by_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, docs.filter(~language.held_out()))
    return found.select(
        "doc_id", language.held_out().alias("held_out"), F.col("language").alias("lang_pred"), "score", "accepted"
    )


@corpus_query()
def op4_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near-duplicates of every document."""
    return simhash_links.near_duplicates(table(spark, sf_dir, "documents"))


@corpus_query()
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), path)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@corpus_query()
def op1_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the rules' spans, and all spans."""
    found = pii.find(table(spark, sf_dir, "documents"))
    kinds = F.transform(F.split("base", ","), lambda s: F.substring_index(s, ":", 1))
    count = lambda kind: F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


@corpus_query()
def op3_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of 20 words that came earlier."""
    return passages.remove_repeats(table(spark, sf_dir, "documents"))


@corpus_query()
def op2_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that occur earlier, in all documents."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@corpus_query()
def op6_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they are."""
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


@corpus_query()
def op8_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document under the unigram base and the attention model."""
    return language_model.scored(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@corpus_query(filter_audit.SQL)
def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language's documents, at each place of each order, with Shapley sums."""
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@corpus_query()
def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@corpus_query(ranked_search.SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every item of the benchmark."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
