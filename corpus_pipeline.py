"""A pipeline over ``documents``: language ID, near-duplicates, personal data, source weights, token ids.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before it kept, and returns a DataFrame that is written as parquet and read again for the next
one. All but the last return the columns of ``docs``, whatever they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import bpe, language, mixing, pii, simhash_links
from podium.sources.scratch import stage

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; those without letters, or as near to another language, go.

    Languages are learned from the labelled documents that are not held out. Null texts go; an empty table stays empty.
    """
    return language.keep_identified(docs, docs.filter(~language.held_out()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, whose fingerprints of three-word shingles differ in two bits at most: the one of smallest doc_id.

    Texts without words share a fingerprint; further columns may have any names; an empty table stays empty.
    """
    return simhash_links.drop_near_duplicates(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[EMAIL]``, ``[IP]``, ``[CARD]`` and ``[PHONE]`` for personal data; n_chars follows the new text.

    Null texts stay null, repeated rows stay, texts are read whole; an empty table stays empty.
    """
    clean = pii.redacted(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken: none, once, twice or three times.

    Null sources are one source, repeated rows are taken alike; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the text that they decode to; no other column is returned.

    A null text has no ids and decodes to an empty one; repeated rows are encoded each; an empty table gives an empty result.
    """
    path = public_tokenizers.path(TOKENIZER)
    coded = bpe.round_trip(docs, path)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode_bpe),
]

#: Compression, SimHash, the random field and BPE have no SQL; tests hold run() against the operators' brute-force forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; what each returns is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
