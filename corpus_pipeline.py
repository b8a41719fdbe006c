"""A corpus from raw documents to packed sequences: each stage is written as a table and read again by the next one.

Defined results: null and empty texts have no words and go with the first stage; of rows that agree in id and text one stays
after near_dedup; texts that share an id, or have none, are documents of their own; a very long text is one document; other
columns pass through all stages but the last, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver.llm import minhash, mixing, packing, passages, quality
from palaver.llm.common import read, stored

NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that every rule keeps."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, linked from a similarity of 0.8."""
    return minhash.deduplicated(docs, percent=NEAR_PERCENT)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat an earlier passage."""
    return passages.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their sources' targets say."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents lies in the packed sequences, and its ids; ``row`` tells copies of a document apart."""
    return packing.packed(docs, ids=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("source_mix", source_mix), ("pack", pack)]
#: SQL has no Burrows-Wheeler merging, tokenizer or best-fit packing: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
