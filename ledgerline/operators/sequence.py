"""Ordered operators: running values, runs, first rows, gaps, chunks. Order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.durable import written
from ledgerline.operators.scans import Running, scan


def monotonicity_violations(scores: DataFrame, run: str = "run", order: str = "attempt", score: str = "score") -> DataFrame:
    """Scores below the highest earlier one of their run, with it; a tie is none. A run may be of any length."""
    return scan(scores, [run], [order], earlier_max=Running("max", F.col(score), inclusive=False)).where(F.col(score) < F.col("earlier_max"))


def best_attempt(attempts: DataFrame, run: str = "run", order: str = "attempt", score: str = "score") -> DataFrame:
    """(run, attempt, score) of each run's highest score; the first of a tie."""
    best = attempts.where(F.col(score).isNotNull()).groupBy(run).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"))).alias("m"))
    return best.select(run, (-F.col("m.o")).alias(order), F.col("m.s").alias(score))


def assign_runs(appends: DataFrame, key: str, order: list[str], attempt: str = "attempt") -> DataFrame:
    """Appends with run: a new run begins where the attempt number doesn't grow. A key may have any number of rows."""
    # in a struct, so that a null attempt counts as the row before too
    with_last = scan(appends, [key], order, __last=Running("last", F.struct(F.col(attempt).alias("attempt")), inclusive=False))
    begins = F.coalesce((F.col(attempt) <= F.col("__last.attempt")).cast("int"), F.lit(0))
    return scan(with_last, [key], order, run=Running("sum", begins)).withColumn("run", (F.col("run") + 1).cast("long")).drop("__last")


def unscored(attempts: DataFrame, run: str = "run", order: str = "attempt", score: str = "score") -> DataFrame:
    """(run, unscored): the highest attempt number less the attempts with a score, 0 at least."""
    return attempts.groupBy(run).agg(F.greatest(F.lit(0), F.max(order) - F.count(score)).cast("long").alias("unscored"))


def first_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def resume_candidate(runs: DataFrame, wanted: DataFrame, key: list[str], run: str = "run_id") -> DataFrame:
    """Wanted keys with the newest run whose whole key is equal, null equal to null."""
    newest = runs.groupBy(*key).agg(F.max(run).alias(run)).alias("r")
    on = [F.col(f"w.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    return wanted.select(*key).distinct().alias("w").join(newest, on).select(*(F.col(f"w.{k}") for k in key), run)


def uncovered_ranges(intervals: DataFrame, lengths: DataFrame, key: str = "object") -> DataFrame:
    """(key, start, end) of the parts of [0, length) that no interval [start, end) covers."""
    inside = intervals.join(lengths, key).select(key, F.greatest(F.lit(0), "start").cast("long").alias("start"), F.least("end", "length").cast("long").alias("end")).where("start < end")
    ends = lengths.select(key, F.col("length").cast("long").alias("start"), F.col("length").cast("long").alias("end"))
    covered = scan(inside.unionByName(ends), [key], ["start", "end"], covered=Running("max", F.col("end"), inclusive=False)).withColumn("covered", F.coalesce("covered", F.lit(0)))
    return covered.where("start > covered").select(key, F.col("covered").alias("start"), F.col("start").alias("end"))


def row_creators(steps: DataFrame, targets: DataFrame, contract: DataFrame) -> DataFrame:
    """(table, step): the first step in order that writes a contract table with create rights; tables without one are
    left out. steps (step, step_no), targets (step, table), contract (table)."""
    owned = targets.select("step", F.lower("table").alias("table")).join(contract.select(F.lower("table").alias("table")).distinct(), "table").join(steps, "step")
    return owned.groupBy("table").agg(F.min_by("step", F.struct("step_no", "step")).alias("step"))


def exists_guard(df: DataFrame, test: Column) -> DataFrame:
    """One row: whether any row passes test."""
    return df.where(test).limit(1).agg((F.count("*") > 0).alias("found"))


def chunk_by_range(df: DataFrame, key: str, size: int = 5000) -> DataFrame:
    """df with chunk: which stretch [low + i * size, low + (i + 1) * size) a whole-number key is in."""
    low = F.broadcast(df.agg(F.min(key).alias("__low")))
    return df.crossJoin(low).withColumn("chunk", F.floor((F.col(key) - F.col("__low")) / size)).drop("__low")


def chunk_by_keyset(df: DataFrame, key: str, size: int, partitions: int | None = None) -> DataFrame:
    """(key, rank, chunk) of distinct keys in order: chunks of size keys.

    Keys are range-partitioned and ranked inside their partition; the partitions' counts, one row each, give the offsets.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the ranges are drawn from a sample, so they are kept: both uses below must see the same ones
    placed = written(keys.repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").count().withColumn("__offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("__part").orderBy(key)
    rank = (F.row_number().over(within) + F.col("__offset")).cast("long")
    return placed.join(F.broadcast(offsets), "__part").withColumn("rank", rank).select(key, "rank", F.floor((F.col("rank") - 1) / size).alias("chunk"))


def cap_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 20) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
