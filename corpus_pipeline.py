"""From raw documents to packed training sequences, one written stage after the other."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from batchlens.llm import langid, packing, simhash, similar, substring
from batchlens.llm.common import table
from batchlens.session import LoopState, work_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter, none that stands out) go."""
    return langid.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Groups are first those of op5: SimHash fingerprints that differ in at most two bits.  Of what stays, documents linked by a similarity of
    five-word shingles of at least 0.8, which fingerprints don't tell from others, are grouped too.
    """
    state = LoopState(spark, "near-dedup")
    first, _ = state.save(simhash.keep_first(docs))
    kept, _ = state.save(similar.keep_first(first))
    state.drop(first)
    return kept


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur more than once are removed from every text; no document goes."""
    return substring.clean(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all remaining documents, placed in sequences of 4096."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: A trained network and a linear program decide; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
