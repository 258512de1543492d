"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept, and its decisions take effect. All but the last return the
columns of ``documents``. Rows that share a doc_id count as one document from the second stage on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import decontaminate, hyperminhash, mixing, queries, token_store, toxicity
from gleanery.storage import Tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject; the model is fitted to the labelled ones."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest doc_id."""
    return hyperminhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights: a document stands as many times as the mix takes it."""
    return mixing.mixture(docs, size_power=queries.SIZE_POWER)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the packed format, read back: doc_id, start, n_tokens, ids_crc32 of every document of the mix."""
    blocks = token_store.write_tokens(spark, docs, queries.tokenizer_path(), queries.VOCABULARY, queries.END_ID)
    return token_store.read_blocks(blocks)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_output", token_ids),
]

#: SQL can't express the stages: a fitted model, a sketch index, edit distances, hashed ranks and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, tables = queries.table(spark, sf_dir, "documents"), Tables(spark, "pipeline")
    for _, stage in STAGES:
        made = tables.write(stage(spark, docs, sf_dir))
        if hasattr(docs, "_gleanery_path"):
            tables.drop(docs)
        docs = made
    return docs
