"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_kinds(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(DataFrame.unionByName, dfs)


def except_both(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(side, ...): rows of one side that the other lacks, each once."""
    return _sides(expected.subtract(actual), actual.subtract(expected))


def except_all_both(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(side, ...): rows of one side beyond those of the other, repeats counted."""
    return _sides(expected.exceptAll(actual), actual.exceptAll(expected))


def _sides(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.withColumn("side", F.lit("expected")).unionByName(actual.withColumn("side", F.lit("actual")))


def written_and_read(writes: DataFrame, reads: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are both written and read, ignoring case."""
    low = lambda df: df.select(F.lower(F.col(key)).alias(key))
    return low(writes).intersect(low(reads))


def reconcile_roster(stages: DataFrame, excluded: DataFrame, discovered: DataFrame, key: str = "name") -> DataFrame:
    """(type, subject): found but not listed (Missing), listed more than once (Duplicate), listed but not found
    (Unknown). Names are compared without regard to case; excluded ones count as listed."""
    low = lambda df: df.select(F.lower(F.col(key)).alias("subject"))
    listed, out, found = low(stages), low(excluded).distinct(), low(discovered).distinct()
    tagged = lambda df, kind: df.select(F.lit(kind).alias("type"), "subject")
    missing = found.join(listed.union(out), "subject", "left_anti")
    repeated = listed.groupBy("subject").count().where("count > 1")
    unknown = listed.distinct().join(found, "subject", "left_anti")
    return union_kinds(tagged(missing, "Missing"), tagged(repeated, "Duplicate"), tagged(unknown, "Unknown"))
