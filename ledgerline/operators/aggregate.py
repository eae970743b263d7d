"""Aggregates of the settlement and reconciliation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,4)"


def summarize(ledger: DataFrame, keys: list[str], measures: list[str], count: str = "tx_count") -> DataFrame:
    """Row count and sums by keys."""
    return ledger.groupBy(*keys).agg(F.count("*").alias(count), *(F.sum(F.col(m).cast(WIDE)).cast(WIDE).alias(m) for m in measures))


def conditional_sums(df: DataFrame, keys: list[str], specs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Sums of a value where a test holds, by name; null where it never does."""
    return df.groupBy(*keys).agg(*(F.sum(F.when(test, value)).alias(name) for name, (test, value) in specs.items()))


def merge_streams(streams: list[DataFrame], keys: list[str], measures: list[str]) -> DataFrame:
    """Streams summed one by one, put together and summed again by keys without regard to case."""
    lowered = lambda df: df.select(*(F.lower(F.col(k)).alias(k) for k in keys), *measures)
    sums = [F.sum(F.col(m)).alias(m) for m in measures]
    parts = [lowered(s).groupBy(*keys).agg(*sums) for s in streams]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*sums)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def net_zero_groups(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Keys whose measure adds up to zero, with the number of rows."""
    return df.groupBy(*keys).agg(F.sum(F.col(measure).cast(WIDE)).alias("net"), F.count("*").alias("rows")).where("net = 0").drop("net")


def distinct_count_gate(df: DataFrame, column: str, required: int) -> DataFrame:
    """One row: distinct values found, required, passed."""
    return df.agg(F.countDistinct(column).alias("found")).select("found", F.lit(required).cast("long").alias("required"), (F.col("found") == required).alias("passed"))


def scalar_agg(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates of a whole table: always one row, with count 0 and nulls for an empty table."""
    return df.agg(*aggregates)


def scalar_lookup(df: DataFrame, column: str, default: object, order: list[Column]) -> DataFrame:
    """One row: the column of the first row in order, or the default when there is no row. A null that is found stays."""
    first = df.orderBy(*order).limit(1).select(F.col(column).alias("value"))
    found = first.agg(F.count("*").alias("n"), F.first("value").alias("value"))
    return found.select(F.when(F.col("n") > 0, F.col("value")).otherwise(F.lit(default).cast(df.schema[column].dataType)).alias(column))


def key_bounds(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def table_fingerprint(df: DataFrame, measures: list[str], keys: list[str] = ()) -> DataFrame:
    """Row count, sums, and the exclusive or and the sum of row hashes, whatever the order. Pairs of equal rows cancel in
    the exclusive or, so the sum and the count stand beside it."""
    h = F.xxhash64(*df.columns)
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        *(F.sum(F.col(m).cast(WIDE)).cast(WIDE).alias(f"sum_{m}") for m in measures),
        F.bit_xor(h).alias("hash_xor"),
        F.sum(h.cast("decimal(38,0)")).cast("decimal(38,0)").alias("hash_sum"),
    )


def all_or_none(df: DataFrame, group: str, member: str, required: dict[str, int]) -> DataFrame:
    """Groups of steps of which some but not all are there: (group, found, required)."""
    need = F.create_map(*(F.lit(x) for kv in required.items() for x in kv))
    counted = df.groupBy(group).agg(F.countDistinct(member).alias("found"))
    return counted.withColumn("required", need[F.col(group)].cast("long")).where("found > 0 AND found < required")


def outcome_counters(evals: DataFrame, keys: list[str], outcome: str = "outcome", names: tuple[str, ...] = ("measured", "fired", "silenced")) -> DataFrame:
    """Evaluations by outcome, and how many there were."""
    return evals.groupBy(*keys).agg(F.count("*").alias("evaluated"), *(F.sum((F.col(outcome) == n).cast("long")).alias(n) for n in names))
