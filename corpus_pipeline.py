"""From raw documents to packed training sequences: STAGES in order, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlane.llm import exact_dedup, jaccard_join, mixing, packing, quality
from emberlane.llm.common import bounded_batches, drop_stored, scratch
from emberlane.llm.queries import id_remainder, tokenizer_path

#: Bytes of an Arrow batch in this session at most: stages follow each other in the same executors, so each is kept small.
BATCH = 4 << 20


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 go; learnt from the labels that op4 learns from."""
    bounded_batches(spark, BATCH)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), id_remainder(5, 0))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at Jaccard 0.8 of five-word shingles stays: the one with the smallest doc_id."""
    bounded_batches(spark, BATCH)
    return jaccard_join.one_of_each(docs, shingle=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once, twice or not at all, so that sources come near their word targets."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    bounded_batches(spark, BATCH)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("mixing sources", source_mix),
    ("best-fit packing", pack_sequences),
]

#: Trees, hashes and tokenizers have no SQL; tests hold the pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again.

    What a stage stored on its way, and its input once its result is written, is deleted. Rows without an id, rows that
    repeat an id or a text, null and empty texts and columns of any name pass as the stages' docstrings say; an empty table
    gives an empty result.
    """
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
        if written is not None:
            drop_stored(written)
        written = docs
    return docs
