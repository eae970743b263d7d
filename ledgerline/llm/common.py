"""What several operators share: folds, words, durable tables and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.durable import checkpointed, discard, scratch_path, written

__all__ = ["WORD", "checkpointed", "components", "discard", "fold", "give_back", "scratch_path", "small_batches", "written"]

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fold(column: str, modulus: int = 5) -> Column:
    """crc32 of an id as text, modulo modulus: the folds of the learned operators. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def give_back() -> None:
    """Hand a worker's freed memory back to the machine: workers live on after their tasks, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Jobs that run meanwhile hand rows to Python in Arrow batches of `most` bytes and one row at most, where Spark would
    take up to 64 MB or 10,000 rows, held on both sides; a limit that the session has set itself stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); nodes without an edge don't appear.

    Alternates the large-star and small-star steps, which keep the number of edges from growing and halve paths, so the
    rounds grow with the logarithm of the longest path. Each round is written to the shared folder.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        # written, as its three uses below would each be planned again: the driver holds plans and what they report
        large = written(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        last, now = now, written(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        discard(last, large)
        state = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h"), F.sum(F.expr("xxhash64(a, b) % 1000003")).alias("s")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    top = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(top)
