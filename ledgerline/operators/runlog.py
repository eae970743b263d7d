"""Run logs: usage, score blocks, attempts, findings. Lines are rows (run_id, line_no, line); order is line_no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.expressions import normalized_score
from ledgerline.operators.scans import Running, scan
from ledgerline.operators.sequence import monotonicity_violations

AXES = ("Accuracy", "Crud", "Interface", "Exception", "Readability")
#: What the lines of a run log look like.
LINES = {
    "timestamp": r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\.\d+",
    "usage": r"캐시 쓰기:\s*(\d+),\s*캐시 읽기:\s*(\d+),\s*출력:\s*(\d+)",
    "request": r"AI ([^-]+?) 요청 전송",
    "response": r"AI ([^-]+?) 응답 수신 완료",
    "review": r"리뷰 응답 수신 완료",
    "discarded": r"JSON 검토 보고서 파싱 중 오류 발생",
    "attempt": r"\(시도 (\d+)/(?:\d+|검증 완료까지)\)",
    "rollback": r"\d+차 시도\((\d+)/100\)가 최고 후보\(",
    "adoption": r"가장 높은 점수를 받은 \d+차 시도\((\d+)/100\)를 채택합니다",
    "passed": r"L1/L2 자동 검증 모두 통과",
    "stagnation": r"재시도가 점수를 개선하지 못해 목차를 다시 설계합니다",
    "requested": r"사용자가 문서 구조 변경을 요청하여 목차를 다시 설계합니다",
}
#: Text that tells which check a finding came from, in order of priority, and where its parts stand.
CHECK_MARKERS = (
    ("A", "개만 담고 있습니다. 명세서 DML 범위 표는"),
    ("B", "문장에 명세서가 확정한"),
    ("C", "문장이 명세서에 없는"),
    ("D", "을(를) 선언 없이 씁니다. 명세서 지역 변수 표는"),
    ("E", "로 초기화하고 CATCH에서 그 값을"),
    ("P", "원본에 없는 최상위 술어"),
)
COORDINATE = r"섹션의\s+([A-Z]+)\s+(\d+)(?=\s|\()"
MISSING_ITEMS = r"확정한\s+(?:최상위\s+WHERE\s+술어\s+컬럼|조인\s+키)\s+(.*?)이\(가\)\s*없습니다"
EXTRA_ITEMS = r"없는\s+술어\s+컬럼\s+(.*?)을\(를\)\s*씁니다"
UNKNOWN_KIND = "(no request line)"


FIGURES = ("cache_write", "cache_read", "output")


def _group(name: str, number: int = 1) -> Column:
    """A group of a line's pattern, null where the line doesn't match."""
    return F.when(F.col("line").rlike(LINES[name]), F.regexp_extract("line", LINES[name], number))


def usage_lines(log: DataFrame) -> DataFrame:
    """(run_id, line_no, cache_write, cache_read, output) of usage lines: those that give all three figures. A line that
    leaves one unreported is no usage line and uses up no request."""
    return log.where(F.col("line").rlike(LINES["usage"])).select("run_id", "line_no", *(_group("usage", i + 1).cast("long").alias(c) for i, c in enumerate(FIGURES)))


def usage_totals(log: DataFrame) -> DataFrame:
    return usage_lines(log).groupBy("run_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cache_write", "cache_read", "output")))


def usage_by_kind(log: DataFrame, window: int = 2) -> DataFrame:
    """(run_id, kind, calls, cache_write, cache_read, output): a usage line belongs to the first response line after it,
    if that comes within the next `window` lines and before the next usage line, else to the last request line since the
    usage line before it, else to no known kind: a request is used once.

    The lines between two usage lines are one segment, so each segment gives its last request and its first response. A
    run may have any number of lines: see scans.
    """
    usage = F.col("line").rlike(LINES["usage"])
    few = log.select("run_id", "line_no", _group("request").alias("request"), _group("response").alias("response"), usage.cast("int").alias("usage"), *(_group("usage", i + 1).cast("long").alias(c) for i, c in enumerate(FIGURES)))
    few = few.where("request IS NOT NULL OR response IS NOT NULL OR usage = 1")
    numbered = scan(few, ["run_id"], ["line_no"], segment=Running("sum", F.col("usage"))).withColumn("segment", F.col("segment") - F.col("usage"))
    parts = numbered.groupBy("run_id", "segment").agg(
        F.max_by("request", F.when(F.col("request").isNotNull(), F.col("line_no"))).alias("request"),
        F.min(F.when(F.col("response").isNotNull(), F.struct("line_no", "response"))).alias("response"),
        F.max(F.when(F.col("usage") == 1, F.col("line_no"))).alias("at"),
        *(F.max(c).alias(c) for c in FIGURES),
    )
    # what comes next is what came last, seen from the end; in a struct, so that segments without a response count
    backwards = scan(parts.withColumn("down", -F.col("segment")), ["run_id"], ["down"], next=Running("last", F.struct("response"), inclusive=False))
    answered = F.when(F.col("after")["line_no"] - F.col("at") <= window, F.col("after")["response"])
    used = backwards.withColumn("after", F.col("next.response")).where("at IS NOT NULL").withColumn("kind", F.coalesce(answered, "request", F.lit(UNKNOWN_KIND)))
    return used.groupBy("run_id", "kind").agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in FIGURES))


def score_blocks(log: DataFrame, within: int = 15) -> DataFrame:
    """(run_id, anchor_line, position, the five axes, score) of review responses.

    The axes are read in the `within` lines after a review line, up to the next one; the first value of each axis counts,
    so a repeated block counts once. A block with a value over 10 before it is complete, without all axes, or followed by
    a parse failure before the next review line is dropped.
    """
    is_anchor = F.col("line").rlike(LINES["review"])
    few = log.where(is_anchor | F.col("line").rlike('"Score') | F.col("line").rlike(LINES["discarded"])).select("run_id", "line_no", "line")
    rows = scan(few, ["run_id"], ["line_no"], anchor=Running("sum", is_anchor.cast("int")), anchor_line=Running("last", F.when(is_anchor, F.col("line_no")))).where("anchor > 0")
    hits = F.explode(F.transform(F.regexp_extract_all("line", F.lit(r'("Score(?:Accuracy|Crud|Interface|Exception|Readability)"\s*:\s*\d+)'), F.lit(1)), lambda m: F.struct(F.regexp_extract(m, r"Score([A-Za-z]+)", 1).alias("axis"), F.regexp_extract(m, r":\s*(\d+)", 1).cast("int").alias("value"))))
    near = rows.where((F.col("line_no") > F.col("anchor_line")) & (F.col("line_no") <= F.col("anchor_line") + within))
    found = near.select("run_id", "anchor", "anchor_line", "line_no", hits.alias("h")).select("run_id", "anchor", "anchor_line", "line_no", "h.axis", "h.value")
    firsts = found.groupBy("run_id", "anchor", "anchor_line", "axis").agg(F.min_by("value", "line_no").alias("value"), F.min("line_no").alias("at"))
    wide = firsts.groupBy("run_id", "anchor", "anchor_line").agg(F.count("*").alias("n"), F.max("at").alias("complete"), *(F.max(F.when(F.col("axis") == a, F.col("value"))).alias(a.lower()) for a in AXES))
    bad = found.where("value > 10").groupBy("run_id", "anchor").agg(F.min("line_no").alias("bad"))
    dropped = rows.where(F.col("line").rlike(LINES["discarded"])).select("run_id", "anchor").distinct()
    good = wide.where("n = 5").join(bad, ["run_id", "anchor"], "left").where("bad IS NULL OR bad > complete").join(dropped, ["run_id", "anchor"], "left_anti")
    score = normalized_score(*(F.col(a.lower()) for a in AXES))
    return good.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy("anchor_line"))).select("run_id", "anchor_line", "position", *(a.lower() for a in AXES), score.alias("score"))


def adopted_score(log: DataFrame) -> DataFrame:
    """(run_id, adopted, is_best): the score of the last adoption line, else the last score if a pass line was seen; and
    whether it is the best of the run (null without a score)."""
    facts = log.groupBy("run_id").agg(F.max_by(_group("adoption").cast("int"), F.when(F.col("line").rlike(LINES["adoption"]), F.col("line_no"))).alias("said"), F.max(F.col("line").rlike(LINES["passed"])).alias("passed"))
    scores = score_blocks(log).groupBy("run_id").agg(F.max_by("score", "position").alias("last"), F.max("score").alias("best"))
    adopted = F.coalesce("said", F.when(F.col("passed"), F.col("last")))
    return facts.join(scores, "run_id", "left").select("run_id", adopted.alias("adopted"), (adopted == F.col("best")).alias("is_best"))


def unrolled_regressions(scores: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """(run_id, violations): scores below the earlier maximum without a rollback line of that score, which is looked for
    forwards only; a match uses up the lines up to it, a miss uses none. Runs without scores are left out.

    The greedy match is a fold over a run's scores in order; a run has one score for each attempt.
    """
    before = Window.partitionBy("run_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    lower = scores.withColumn("best", F.max("score").over(before)).withColumn("lower", F.col("score") < F.col("best"))
    own = lower.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("lower"), F.struct("position", F.col("score").cast("long").alias("score"))))), lambda x: x["score"]).alias("own"))
    lines = rollbacks.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.col("score").cast("long").alias("score")))), lambda x: x["score"]).alias("lines"))
    joined = own.join(lines, "run_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<bigint>")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("n"))

    def step(state: Column, score: Column) -> Column:
        found = F.array_position(F.slice("lines", (state["at"] + 1).cast("int"), F.size("lines")), score)
        return F.struct(F.when(found > 0, state["at"] + found).otherwise(state["at"]).alias("at"), (state["n"] + (found == 0).cast("bigint")).alias("n"))

    return joined.select("run_id", F.aggregate("own", start, step)["n"].alias("violations"))


def rollback_lines(log: DataFrame) -> DataFrame:
    return log.where(F.col("line").rlike(LINES["rollback"])).select("run_id", "line_no", _group("rollback").cast("int").alias("score"))


def wall_clock(log: DataFrame) -> DataFrame:
    """(run_id, first, last, seconds) from the first and the last line with a timestamp, in line order."""
    ts = F.try_to_timestamp(_group("timestamp"), F.lit("yyyy-MM-dd HH:mm:ss"))
    stamped = log.select("run_id", "line_no", ts.alias("ts")).where("ts IS NOT NULL")
    ends = stamped.groupBy("run_id").agg(F.min_by("ts", "line_no").alias("first"), F.max_by("ts", "line_no").alias("last"))
    return ends.withColumn("seconds", (F.unix_timestamp("last") - F.unix_timestamp("first")).cast("long"))


def run_metrics(log: DataFrame) -> DataFrame:
    """One row for each run: scores in order, monotonicity violations, unrolled regressions, attempts and unscored ones,
    usage, wall clock, the adopted score, and whether the outline was drawn anew."""
    scores = score_blocks(log)
    trajectory = scores.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "score"))), lambda x: x["score"]).alias("trajectory"))
    breaks = monotonicity_violations(scores, "run_id", "position").groupBy("run_id").agg(F.count("*").alias("monotonicity_violations"))
    facts = log.groupBy("run_id").agg(F.coalesce(F.max(_group("attempt").cast("int")), F.lit(0)).alias("attempts"), F.max(F.col("line").rlike(LINES["stagnation"])).alias("redrafted_on_stagnation"), F.max(F.col("line").rlike(LINES["requested"])).alias("redrafted_on_request"))
    joined = facts
    for part in (trajectory, breaks, unrolled_regressions(scores, rollback_lines(log)), usage_totals(log), wall_clock(log).select("run_id", "seconds"), adopted_score(log)):
        joined = joined.join(part, "run_id", "left")
    scored = F.when(F.col("trajectory").isNull(), 0).otherwise(F.size("trajectory"))
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("monotonicity_violations", "violations", "cache_write", "cache_read", "output")})
    return filled.withColumn("unscored", F.greatest(F.lit(0), F.col("attempts") - scored)).withColumnRenamed("violations", "unrolled_regressions")


def failed_axes(reviews: DataFrame, axes: list[str], threshold: int) -> DataFrame:
    """Reviews with the names of the axes below threshold; a missing review (a null axis) fails all of them."""
    missing = F.greatest(*(F.col(a).isNull().cast("int") for a in axes)) == 1
    return reviews.withColumn("failed", F.when(missing, F.array(*map(F.lit, axes))).otherwise(F.array_compact(F.array(*(F.when(F.col(a) < threshold, F.lit(a)) for a in axes)))))


def verification_coverage(steps: DataFrame, defects: DataFrame, flags: Column) -> DataFrame:
    """(job, steps_total, steps_verified, coverage, attention). steps (job, step, adopted; a null step: not measured, which
    leaves the total null), defects (job, step, kind). Only Unverifiable and GenerationFailed reduce, and only adopted
    steps. flags is an aggregate of steps that asks for attention besides."""
    reducing = defects.where(F.col("kind").isin("Unverifiable", "GenerationFailed")).select("job", "step").distinct().withColumn("reduced", F.lit(True))
    joined = steps.join(reducing, ["job", "step"], "left")
    known = F.count("step")
    counted = joined.groupBy("job").agg(
        F.when(F.max(F.col("step").isNull().cast("int")) == 0, known).alias("steps_total"),
        F.sum((F.col("reduced") & F.col("adopted")).cast("long")).alias("lost"),
        F.coalesce(flags, F.lit(False)).alias("flagged"),
    )
    lost = F.coalesce("lost", F.lit(0))
    return counted.select("job", "steps_total", (F.col("steps_total") - lost).alias("steps_verified"), F.when(F.col("steps_total") > 0, F.round((F.col("steps_total") - lost) * 100 / F.col("steps_total"), 1)).alias("coverage"), (F.col("steps_total").isNull() | (lost > 0) | F.col("flagged")).alias("attention"))


def classify_findings(messages: DataFrame, markers: tuple[tuple[str, str], ...] = CHECK_MARKERS) -> DataFrame:
    """messages (message) with check (the first marker that is in it, else Unclassified), kind and ordinal of checks B, C
    and P, and the listed items of B and C."""
    out = F
    for check, marker in markers:
        out = out.when(F.contains("message", F.lit(marker)), check)
    found = messages.withColumn("check", out.otherwise("Unclassified") if out is not F else F.lit("Unclassified"))
    placed = F.col("check").isin("B", "C", "P") & F.col("message").rlike(COORDINATE)
    raw = F.when(F.col("check") == "B", F.regexp_extract("message", MISSING_ITEMS, 1)).when(F.col("check") == "C", F.regexp_extract("message", EXTRA_ITEMS, 1)).otherwise("")
    items = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    return found.withColumns({"kind": F.when(placed, F.regexp_extract("message", COORDINATE, 1)), "ordinal": F.when(placed, F.regexp_extract("message", COORDINATE, 2).cast("int")), "items": F.coalesce(items, F.array().cast("array<string>"))})


def finding_matrix(findings: DataFrame, keys: list[str], conditions: tuple[str, ...] = ("AsIs", "SimulatedCache17")) -> DataFrame:
    """Findings counted by keys and condition."""
    return findings.groupBy(*keys).pivot("condition", list(conditions)).count().na.fill(0)


def harness_gaps(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """(job, steps, measured, missing_files, unmeasured): jobs with the steps that were measured (steps: job, step,
    measured, has_file); unmeasured jobs have none."""
    counted = steps.groupBy("job").agg(F.count("*").alias("steps"), F.sum(F.col("measured").cast("long")).alias("measured"), F.sum((~F.col("has_file")).cast("long")).alias("missing_files"))
    return jobs.select("job").distinct().join(counted, "job", "left").select("job", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("steps", "measured", "missing_files"))).withColumn("unmeasured", F.col("measured") == 0)


def status_counts(docs: DataFrame, status: str = "status") -> DataFrame:
    return docs.groupBy(status).agg(F.count("*").alias("documents"))
