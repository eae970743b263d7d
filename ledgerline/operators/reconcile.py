"""Reconciliation: comparing results, tables and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.expressions import normalize_value, values_equal

WIDE = "decimal(38,4)"


def full_compare(expected: DataFrame, actual: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Full outer join of two tables unique by keys; rows whose measures differ, null counted as zero.

    The flags in_expected and in_actual keep a missing row apart from a row of zeros. Null keys equal each other.
    """
    e = expected.select(*keys, *(F.col(m).alias(f"expected_{m}") for m in measures), F.lit(True).alias("in_expected")).alias("e")
    a = actual.select(*keys, *(F.col(m).alias(f"actual_{m}") for m in measures), F.lit(True).alias("in_actual")).alias("a")
    on = reduce(lambda x, y: x & y, (F.col(f"e.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys))
    both = e.join(a, on, "full").select(
        *(F.coalesce(f"e.{k}", f"a.{k}").alias(k) for k in keys),
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_expected", "in_actual")),
        *(F.coalesce(F.col(f"{side}_{m}"), F.lit(0)).cast(WIDE).alias(f"{side}_{m}") for m in measures for side in ("expected", "actual")),
    )
    return both.where(reduce(lambda x, y: x | y, (F.col(f"expected_{m}") != F.col(f"actual_{m}") for m in measures)))


def aggregate_compare(ledger: DataFrame, summary: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Sums per key of both sides, compared by full_compare."""
    total = lambda df: df.groupBy(*keys).agg(*(F.sum(F.col(m)).cast(WIDE).alias(m) for m in measures))
    return full_compare(total(ledger), total(summary), keys, measures)


ISSUE = "run_id long, step_code string, issue_code string, severity string, expected_value string, actual_value string, detected_at timestamp"
#: Severities from the least to the worst.
SEVERITIES = ("Info", "Warning", "Error", "Critical")


def cell_diff(legacy: DataFrame, target: DataFrame, numeric: str = "scale3") -> DataFrame:
    """Cells (proc, case_id, set_no, row_no, col, val) that differ: kind value, only_legacy or only_target. Sets whose row
    counts differ are left out, and so are cases that only the target has."""
    rows = lambda df: df.where("set_no IS NOT NULL").groupBy("proc", "case_id", "set_no").agg(F.coalesce(F.max("row_no") + 1, F.lit(0)).alias("n"))
    same = rows(legacy).alias("l").join(rows(target).alias("t"), ["proc", "case_id", "set_no"]).where("l.n = t.n").select("proc", "case_id", "set_no")
    keys = ["proc", "case_id", "set_no", "row_no", "key"]
    cells = lambda df, side: df.where("col IS NOT NULL").select("proc", "case_id", "set_no", "row_no", F.lower("col").alias("key"), F.col("col").alias(f"{side}_col"), F.col("val").alias(side), F.lit(True).alias(f"in_{side}"))
    both = cells(legacy, "legacy").join(cells(target, "target"), keys, "full").join(same, ["proc", "case_id", "set_no"], "left_semi")
    kind = F.when(F.col("in_target").isNull(), "only_legacy").when(F.col("in_legacy").isNull(), "only_target").when(~values_equal(normalize_value(F.col("legacy"), "string", numeric), normalize_value(F.col("target"), "string", numeric)), "value")
    return both.select("proc", "case_id", "set_no", "row_no", F.coalesce("legacy_col", "target_col").alias("col"), kind.alias("kind"), "legacy", "target").where("kind IS NOT NULL")


def compare_cases(legacy: DataFrame, target: DataFrame, numeric: str = "scale3") -> DataFrame:
    """(proc, case_id, result) for each legacy case: match, missing, status, sets, rows or cells, the first that fails.
    Cases that only the target has don't count; error codes are only reported. Where the rows of one case disagree on its
    status, both count: it equals only another case with the same two."""
    case = ["proc", "case_id"]
    head = lambda df: df.groupBy(*case).agg(F.concat_ws(",", F.min("status"), F.when(F.min("status") != F.max("status"), F.max("status"))).alias("status"), F.countDistinct("set_no").alias("sets"))
    rows = lambda df: df.where("set_no IS NOT NULL").groupBy(*case, "set_no").agg(F.coalesce(F.max("row_no") + 1, F.lit(0)).alias("n"))
    uneven = rows(legacy).alias("l").join(rows(target).alias("t"), [*case, "set_no"]).where("l.n <> t.n").select(*case).distinct().withColumn("uneven", F.lit(True))
    cells = cell_diff(legacy, target, numeric).select(*case).distinct().withColumn("cells", F.lit(True))
    t = head(target).select(*case, F.col("status").alias("t_status"), F.col("sets").alias("t_sets"), F.lit(True).alias("there"))
    joined = head(legacy).join(t, case, "left").join(uneven, case, "left").join(cells, case, "left")
    result = F.when(F.col("there").isNull(), "missing").when(~F.col("status").eqNullSafe(F.col("t_status")), "status").when(F.col("sets") != F.col("t_sets"), "sets").when(F.col("uneven"), "rows").when(F.col("cells"), "cells").otherwise("match")
    return joined.select(*case, result.alias("result"))


def match_rate(cases: DataFrame) -> DataFrame:
    """One row: legacy cases, those that match, and their share in percent with one decimal; 0 without cases."""
    counted = cases.agg(F.count("*").alias("cases"), F.coalesce(F.sum((F.col("result") == "match").cast("long")), F.lit(0)).alias("matches"))
    return counted.withColumn("rate", F.when(F.col("cases") > 0, F.round(F.col("matches").cast("decimal(20,0)") * 100 / F.col("cases"), 1)).otherwise(0).cast("decimal(5,1)"))


def table_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, columns): rows added, removed and changed between two tables unique by keys, with the names of the
    columns that changed."""
    others = [c for c in left.columns if c not in keys]
    l = left.select(*keys, *(F.col(c).alias(f"l_{c}") for c in others), F.lit(True).alias("__l"))  # noqa: E741
    r = right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in others), F.lit(True).alias("__r"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in others)))
    change = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed").when(F.size("columns") > 0, "changed")
    none = F.array().cast("array<string>")
    rows = l.join(r, keys, "full").withColumn("columns", F.when(F.col("__l") & F.col("__r"), changed).otherwise(none))
    return rows.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change", "columns")


def capture_control_totals(df: DataFrame, run_id: int, step: str, measures: list[str]) -> DataFrame:
    """(run_id, step_code, control_name, control_value): the row count and the measures' sums, one row each."""
    totals = df.agg(F.count("*").cast(WIDE).alias("rows"), *(F.coalesce(F.sum(F.col(m).cast(WIDE)), F.lit(0)).cast(WIDE).alias(m) for m in measures))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("control_name"), F.col(c).alias("control_value")) for c in ["rows", *measures])))
    return totals.select(pairs.alias("p")).select(F.lit(run_id).cast("long").alias("run_id"), F.lit(step).alias("step_code"), "p.*")


def compare_control_totals(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """Control totals that differ or that one side lacks, by step and name."""
    keys = ["step_code", "control_name"]
    f, c = frozen.select(*keys, F.col("control_value").alias("frozen_value")), current.select(*keys, F.col("control_value").alias("current_value"))
    return f.join(c, keys, "full").where("NOT (frozen_value <=> current_value)")


def compare_runs(totals: DataFrame, reference: int, candidate: int) -> DataFrame:
    """The same totals of two runs side by side, with the difference (null where one run has none)."""
    pick = lambda run, name: totals.where(F.col("run_id") == run).select("step_code", "control_name", F.col("control_value").alias(name))
    both = pick(reference, "reference_value").join(pick(candidate, "candidate_value"), ["step_code", "control_name"], "full")
    return both.withColumn("difference", (F.col("candidate_value") - F.col("reference_value")).cast(WIDE))


def unwritten_control_names(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """(step, owner, name) of totals that a step reads from an owner that doesn't write them. A name that any other step
    writes drops out, and an owner with an unknown write (a null name) silences its readers. writes (step, name), reads
    (step, owner, name)."""
    low = F.lower("name").alias("key")
    silent = writes.where("name IS NULL").select(F.col("step").alias("owner")).distinct()
    return reads.withColumn("key", F.lower("name")).join(writes.where("name IS NOT NULL").select(low).distinct(), "key", "left_anti").join(silent, "owner", "left_anti").select("step", "owner", "name").distinct()


def identity_violations(df: DataFrame, keys: list[str], identities: dict[str, tuple]) -> DataFrame:
    """(keys, identity, expected, actual): rows where an identity's two sides differ; a row with a null side is no
    violation. identities gives (expected, actual) columns by name."""
    checks = F.explode(F.array(*(F.struct(F.lit(n).alias("identity"), e.cast(WIDE).alias("expected"), a.cast(WIDE).alias("actual")) for n, (e, a) in identities.items())))
    return df.select(*keys, checks.alias("c")).where("c.expected <> c.actual").select(*keys, "c.*")


def state_date_violations(df: DataFrame, keys: list[str], rules: dict) -> DataFrame:
    """(keys, rule): rows and the rules, Columns that are true for a violation, that they break."""
    broken = F.explode(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items()))))
    return df.select(*keys, broken.alias("rule"))


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent, keys, "left_anti")


def branch_compare(sources: dict[str, DataFrame], ledger: DataFrame, branch: str, amount: str) -> DataFrame:
    """(branch, expected_rows, expected_amount, actual_rows, actual_amount, matched): each source branch against the ledger's."""
    total = lambda df, side: df.agg(F.count("*").alias(f"{side}_rows"), F.coalesce(F.sum(F.col(amount).cast(WIDE)), F.lit(0)).cast(WIDE).alias(f"{side}_amount"))
    expected = reduce(DataFrame.unionByName, (total(df, "expected").withColumn(branch, F.lit(name)) for name, df in sources.items()))
    actual = ledger.groupBy(branch).agg(F.count("*").alias("actual_rows"), F.sum(F.col(amount).cast(WIDE)).cast(WIDE).alias("actual_amount"))
    both = expected.join(actual, branch, "full").select(branch, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("expected_rows", "actual_rows")), *(F.coalesce(c, F.lit(0)).cast(WIDE).alias(c) for c in ("expected_amount", "actual_amount")))
    return both.withColumn("matched", (F.col("expected_rows") == F.col("actual_rows")) & (F.col("expected_amount") == F.col("actual_amount")))


def journal_checkpoint_conflicts(journal: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(run_id, step_code, step_status, checkpoint_status): steps that succeeded in the journal without a succeeded
    checkpoint, or the other way round."""
    c = checkpoint.select("run_id", "step_code", "checkpoint_status")
    done, marked = F.col("step_status") == "Succeeded", F.coalesce(F.col("checkpoint_status") == "Succeeded", F.lit(False))
    return journal.join(c, ["run_id", "step_code"], "left").where(done != marked).select("run_id", "step_code", "step_status", "checkpoint_status")


def missing_steps(required: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Required (run_id, step_code) without a succeeded checkpoint."""
    return required.join(checkpoint.where("checkpoint_status = 'Succeeded'"), ["run_id", "step_code"], "left_anti")


def stale_locks(runs: DataFrame, locks: DataFrame) -> DataFrame:
    """Locks still held by runs that ended, or by no run that is known."""
    r = runs.select(F.col("run_id").alias("owner_run_id"), "run_status")
    return locks.where("lock_status = 'Held'").join(r, "owner_run_id", "left").where("run_status IS NULL OR run_status NOT IN ('Running', 'Restarting')").select("job_name", "batch_ymd", "owner_run_id", "run_status")


def publish_gate(required: DataFrame, checkpoint: DataFrame, issues: DataFrame, locks: DataFrame, run_id: int) -> DataFrame:
    """One row: missing steps, blocking issues, owned locks of a run, and whether it may publish: nothing missing, no
    Error or Critical issue, exactly one lock held."""
    mine = F.col("run_id") == run_id
    missing = missing_steps(required.where(mine), checkpoint.where(mine)).agg(F.count("*").alias("missing"))
    blocking = issues.where(mine & F.col("severity").isin("Error", "Critical")).agg(F.count("*").alias("blocking"))
    held = locks.where((F.col("owner_run_id") == run_id) & (F.col("lock_status") == "Held")).agg(F.count("*").alias("locks"))
    return missing.crossJoin(blocking).crossJoin(held).withColumn("may_publish", (F.col("missing") == 0) & (F.col("blocking") == 0) & (F.col("locks") == 1))


def time_order_violations(journal: DataFrame, start: str = "started_at", end: str = "completed_at") -> DataFrame:
    return journal.where(F.col(end) < F.col(start))


def domain_violations(df: DataFrame, column: str, contract: DataFrame, table_name: str) -> DataFrame:
    """(value, rows): values of a control column that the contract (table_name, column_name, value) doesn't allow; null
    isn't one."""
    allowed = contract.where((F.col("table_name") == table_name) & (F.col("column_name") == column)).select("value")
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows")).join(allowed, "value", "left_anti")


def recompute_compare(stored: DataFrame, recomputed: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Rows whose stored amount isn't what it comes to when computed again."""
    r = recomputed.select(*keys, F.col(measure).alias("recomputed"))
    return stored.select(*keys, F.col(measure).alias("stored")).join(r, keys).where("NOT (stored <=> recomputed)")


def collect_issues(*checks: DataFrame) -> DataFrame:
    """Issue tables as one."""
    return reduce(DataFrame.unionByName, checks)


def severity_gate(issues: DataFrame, least: str = "Error") -> DataFrame:
    """One row: issues, the worst severity (null without issues), passed unless one is `least` or worse."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    worst = issues.agg(F.count("*").alias("issues"), F.max(rank).alias("rank"))
    return worst.select("issues", F.when(F.col("rank") > 0, F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank").cast("int"))).alias("worst"), F.coalesce(F.col("rank") < SEVERITIES.index(least) + 1, F.lit(True)).alias("passed"))


def declared_vs_found(declared: DataFrame, found: DataFrame) -> DataFrame:
    """(step, declared, found, missed, fabricated): ordinals by step that were declared and not found, and the reverse."""
    d, f = declared.select("step", "ordinal", F.lit(1).alias("d")).distinct(), found.select("step", "ordinal", F.lit(1).alias("f")).distinct()
    both = d.join(f, ["step", "ordinal"], "full")
    n = lambda c: F.sum(c.cast("long"))
    return both.groupBy("step").agg(F.count("d").alias("declared"), F.count("f").alias("found"), n(F.col("f").isNull()).alias("missed"), n(F.col("d").isNull()).alias("fabricated"))
