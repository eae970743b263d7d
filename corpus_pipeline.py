"""From raw documents to training tokens in five stages.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on, with the columns they came with; mixing adds
their training_position, as files don't keep the order of rows. The last stage gives tokens in training order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, mixing, shingles, suffix, toxicity
from ledgerline.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity 0.8 or more."""
    return shingles.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere too; n_chars, where there is one, follows the text."""
    left = suffix.remove_repeats(docs, keep_text=True)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with their training_position; the next stage range-sorts them by it."""
    return mixing.mixed(docs, in_order=False)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with digests of them and of the text decoded from them, range-sorted by training_position."""
    placed = [c for c in ("training_position",) if c in docs.columns]
    return bpe.encode(docs.orderBy(*placed, "doc_id") if placed else docs, public_tokenizers.path("byte_bpe_50k.json"), "both", tuple(placed))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode_and_decode),
]

#: Learned scores, fingerprints and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each one's result kept in the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
