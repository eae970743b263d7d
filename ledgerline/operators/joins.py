"""Joins of the settlement and reconciliation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate_join(txn: DataFrame, pg_rate: DataFrame, client_rate: DataFrame, contract: DataFrame, pg_keys: list[str], client_keys: list[str], contract_keys: list[str]) -> DataFrame:
    """Transactions with the provider's rate, the client's rate and the contract of their keys; others drop out. Which
    side is broadcast is left to the planner, which knows their sizes."""
    return txn.join(pg_rate, pg_keys).join(client_rate, client_keys).join(contract, contract_keys)


def left_lookup(df: DataFrame, dim: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """df with dim's columns, defaults where no row of dim fits or its value is null."""
    return df.join(dim, keys, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def join_amount_match(left: DataFrame, right: DataFrame, keys: list[str], left_amount: str, right_amount: str) -> DataFrame:
    """Rows of equal keys whose amounts are equal but for the sign. Columns other than the keys must not clash."""
    return left.join(right, keys).where(F.abs(F.col(left_amount)) == F.abs(F.col(right_amount)))


def align_to_main(df: DataFrame, group: list[str], is_main: Column, columns: list[str]) -> DataFrame:
    """Every row with the given columns of its group's main row; rows of groups without one keep their own. Of several
    main rows the smallest values count, so that no row is repeated."""
    main = df.where(is_main).groupBy(*group).agg(F.min(F.struct(*columns)).alias("__main"))
    return df.join(main, group, "left").withColumns({c: F.when(F.col("__main").isNotNull(), F.col(f"__main.{c}")).otherwise(F.col(c)) for c in columns}).drop("__main")


def semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_semi")


def anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """NOT EXISTS: rows with null keys stay."""
    return left.join(right, keys, "left_anti")


def not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """NOT IN as SQL has it: nothing if right has a null key; rows with a null key only if right is empty."""
    state = right.agg(F.count("*").alias("__all"), F.count(key).alias("__known"))
    rows = left.join(right.select(key), key, "left_anti").crossJoin(F.broadcast(state))
    return rows.where((F.col("__all") == 0) | ((F.col("__all") == F.col("__known")) & F.col(key).isNotNull())).drop("__all", "__known")


def compare_scalars(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of one row each, side by side."""
    return a.crossJoin(b)


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: int = 1) -> DataFrame:
    """Points with every span of their keys that holds them, start and end included; spans that end before they start hold
    none.

    Spans of whole numbers are cut into dyadic cells, whose lengths are powers of two times width: two of each length at
    most, so a span of any length has a number of cells that grows with its logarithm. A point stands in one cell of each
    length that occurs, and in one of a span's cells at most, so no pair comes up twice. Neither long spans nor an object
    with very many points and spans meet in one task. Other types are joined by their keys alone.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    if not {dict(points.dtypes)[at], dict(spans.dtypes)[start], dict(spans.dtypes)[end]} <= whole:
        return points.join(spans, keys).where(F.col(at).between(F.col(start), F.col(end)))
    unit = lambda c: F.floor(F.col(c).cast("long") / width) if width > 1 else F.col(c).cast("long")
    shifted = lambda c, k: F.call_function("shiftright", c, k)
    length = F.col("__high") - F.col("__low") + 1

    def cells(k: Column) -> Column:
        """At length 2^k: the cell before the first even place, and the one behind the last, where the span still has them."""
        first = shifted(F.col("__low"), k) + (shifted(F.col("__low"), k) * F.call_function("shiftleft", F.lit(1).cast("long"), k) != F.col("__low")).cast("long")
        last = shifted(F.col("__high") + 1, k)
        cell = lambda test, c: F.when((first < last) & (F.pmod(test, F.lit(2)) == 1), F.struct(k.alias("k"), c.alias("cell")))
        return F.array(cell(first, first), cell(last, last - 1))

    sized = spans.where(F.col(start) <= F.col(end)).withColumn("__low", unit(start)).withColumn("__high", unit(end))
    levels = F.sequence(F.lit(0), F.floor(F.log2(length.cast("double"))).cast("int"))
    covered = sized.withColumn("__c", F.explode(F.filter(F.flatten(F.transform(levels, cells)), lambda c: c.isNotNull()))).withColumn("__k", F.col("__c.k")).withColumn("__cell", F.col("__c.cell")).drop("__c", "__low", "__high")
    used = covered.agg(F.sort_array(F.collect_set("__k"))).first()[0]  # 63 at most
    asked = points.withColumn("__k", F.explode(F.array(*map(F.lit, used)) if used else F.array().cast("array<int>"))).withColumn("__cell", shifted(unit(at), F.col("__k")))
    return asked.join(covered, [*keys, "__k", "__cell"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__k", "__cell")


def work_after_failure(journal: DataFrame, run: str = "run_id", step: str = "step_no", status: str = "status") -> DataFrame:
    """(run, step) of steps that did something although an earlier step of their run had failed: steps after the run's
    first failure, which is all that the inequality needs, so runs aren't joined with themselves row by row."""
    failed = journal.where(F.col(status) == "Failed").groupBy(run).agg(F.min(step).alias("failed_step"))
    return journal.join(failed, run).where((F.col(step) > F.col("failed_step")) & (F.col(status) != "Skipped")).select(run, step, status, "failed_step")


def due_date(df: DataFrame, schedule: DataFrame, keys: list[str], column: str) -> DataFrame:
    """df with the schedule's column; null where the schedule has no row. The schedule must be unique by keys."""
    return df.join(unique(schedule.select(*keys, column), keys), keys, "left")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, failing when it is run if keys repeat."""
    others = [c for c in df.columns if c not in keys]
    alone = F.assert_true(F.col("__n") == 1, F.concat_ws(" ", F.lit("several rows for"), *(F.col(k).cast("string") for k in keys)))
    counted = df.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in others))
    return counted.where(alone.isNull()).select(*df.columns)


def missing_rates(txn: DataFrame, first: DataFrame, second: DataFrame, first_keys: list[str], second_keys: list[str], by: list[str]) -> DataFrame:
    """Transactions without a row in either rate table, counted by key."""
    a = first.select(*first_keys).distinct().withColumn("__a", F.lit(True))
    b = second.select(*second_keys).distinct().withColumn("__b", F.lit(True))
    rows = txn.join(a, first_keys, "left").join(b, second_keys, "left").where("__a IS NULL OR __b IS NULL")
    return rows.groupBy(*by).agg(F.count("*").alias("missing"), F.sum(F.col("__a").isNull().cast("long")).alias("missing_first"), F.sum(F.col("__b").isNull().cast("long")).alias("missing_second"))


def canonical_pairs(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Unordered pairs, lower-cased, each once."""
    x, y = F.lower(F.col(a)), F.lower(F.col(b))
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where(x.isNotNull() & y.isNotNull()).distinct()


def pair_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, a, b): pairs that got lost and that were added between two lists of pairs."""
    o, n = canonical_pairs(old), canonical_pairs(new)
    tagged = lambda df, name: df.select(F.lit(name).alias("change"), "a", "b")
    return reduce(DataFrame.unionByName, (tagged(o.join(n, ["a", "b"], "left_anti"), "lost"), tagged(n.join(o, ["a", "b"], "left_anti"), "added")))
