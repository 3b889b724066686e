"""A corpus pipeline over `documents`: language ID, near-dedup, surrogates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of
documents.

Defined cases: a null, empty or blank text, or one without a letter, has no language and goes at the first stage, as
do texts of a language that isn't learned; so later stages see none of these, but take them as their operators say.
Texts are taken whole, however long. Of rows that are equal or near copies one stays, that with the smallest doc_id, of
those the first by text; a null doc_id is no smallest one. Null sources are one source, the last. Rows whose lang or
n_chars is null go through like others. The mix repeats rows and cuts one of a source, so doc_ids repeat from there on.
An empty table gives an empty result. Further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import bpe, language_id, mixing, pii, simhash
from tidemill.llm.common import DOCUMENT_COLUMNS, delete, write

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language."""
    return language_id.accept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: near fingerprints of the distinct words, and 0.8 of the five-word shingles shared."""
    return simhash.keep_one(docs, words=1, distance=6, similarity=0.8, distinct=True)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return pii.replace(docs).select(*DOCUMENT_COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts the sources to their targets."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with digests of the ids and of what they decode to."""
    return bpe.tokenize(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("pii_surrogates", surrogates),
    ("source_mixing", mixture),
    ("bpe_tokens", tokens),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes when the next one has written its own."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            path = write(docs)
            if last:
                delete(spark, last)
            docs, last = spark.read.parquet(path), path
    return docs
