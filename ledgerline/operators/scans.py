"""Running values in order, for groups of any length: rows are range-sorted, and what stands before a partition is carried
into it, so that no group has to fit into one task."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.durable import written


class Running(NamedTuple):
    """What runs: kind sum, max, min or last (the last value that isn't null), of a column; with or without the row itself."""

    kind: str
    value: Column
    inclusive: bool = True


def scan(df: DataFrame, group: list[str], order: list[str], partitions: int | None = None, **outs: Running) -> DataFrame:
    """df with a column for each of outs: its running value in the row's group, in order. Rows that are equal in group and
    order should not differ, as their places among each other aren't told. Where nothing came yet the value is null.

    The rows are written once, in range partitions. A window runs inside of each partition; each partition gives one row
    for each of its groups, and of these a group has no more than there are partitions.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the ranges are drawn from a sample, so they are kept: all uses below must see the same ones
    placed = written(df.withColumns({f"__v_{c}": r.value for c, r in outs.items()}).repartitionByRange(parts, *group, *order).withColumn("__part", F.spark_partition_id()))
    ordered = F.struct(*order)
    runs = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.last(v, ignorenulls=True)}
    whole = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.max_by(v, F.when(v.isNotNull(), ordered))}
    sums = placed.groupBy("__part", *group).agg(*(whole[r.kind](F.col(f"__v_{c}")).alias(f"__c_{c}") for c, r in outs.items()))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("__part", *(F.col(g).alias(f"__g_{i}") for i, g in enumerate(group)), *(runs[r.kind](F.col(f"__c_{c}")).over(before).alias(f"__c_{c}") for c, r in outs.items()))
    carry = carry.withColumnRenamed("__part", "__p")
    on = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{i}"))

    def joined(kind: str, here: Column, earlier: Column) -> Column:
        if kind == "sum":
            return F.when(here.isNull(), earlier).when(earlier.isNull(), here).otherwise(here + earlier)
        return {"max": F.greatest, "min": F.least, "last": F.coalesce}[kind](here, earlier)

    inside = Window.partitionBy("__part", *group).orderBy(*order)
    own = placed.withColumns({f"__r_{c}": runs[r.kind](F.col(f"__v_{c}")).over(inside.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)) for c, r in outs.items()})
    out = own.join(carry, on).withColumns({c: joined(r.kind, F.col(f"__r_{c}"), F.col(f"__c_{c}")) for c, r in outs.items()})
    return out.select(*dict.fromkeys([*df.columns, *outs]))


def carried(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """df with out: the last value that isn't null up to each row."""
    return scan(df, [], [order], **{out: Running("last", F.col(value))})


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with out: each row's place in order, from 1."""
    return scan(df, [], order, **{out: Running("sum", F.lit(1).cast("long"))})
