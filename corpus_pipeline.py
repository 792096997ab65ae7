"""The corpus pipeline: quality classifier, exact dedup, near-dedup, mixing to target weights, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
`documents`; the last has a row for each document of the mix, repetitions included, with its tokens' number and digests.

Defined results, from those of the operators: a null text is an empty one, and empty texts are equal; ties and repeated
rows are copies, and the row with the least doc_id stays (rows that repeat that doc_id all do); a null doc_id is never
learnt from and its row stays unless the classifier rejects it; very long texts are read whole; an empty table gives an
empty result; further columns, whatever their names, are kept to the end, except that the last stage adds `n_tokens`,
`ids_sha256` and `decoded_sha256` in place of columns of these names and drops `text`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm import bpe, exact_dedup, mixing, quality, simhash
from vectorloom.llm.common import discard, materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good; it learns from the labelled documents that arrive here."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the least id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, whose five-word shingles have a Jaccard similarity of at least 0.8, found by SimHash signatures and then an exact join, the document with the least id."""
    return simhash.similar_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeat as often as the mix takes them."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix, and of the text that its tokens decode to."""
    return materialize(bpe.encode(docs, bpe.default_path(), ids=False).drop("text"), "tokens")  # written here, in small batches


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]
#: The classifier's training and the tokenizer can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again for the next."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
