"""Ordered operators, run logs and change detection over events, documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.durable import scratch_path
from ledgerline.functions.expressions import normalized_score
from ledgerline.operators import incremental as I
from ledgerline.operators import runlog as G
from ledgerline.operators import sequence as Q
from ledgerline.plans.catalogue import query
from ledgerline.streaming.journal import stream_journal_conflicts, stream_usage
from ledgerline.streaming.runs import drained

NUMBERED = "e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, CASE WHEN event_type <> 'click' THEN CAST(floor(value) AS BIGINT) END AS score, event_id FROM events)"


def attempts(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return t("events").select(F.col("user_id").alias("run"), n.alias("attempt"), F.when(F.col("event_type") != "click", F.floor("value")).alias("score"), "event_id")


@query("win1_monotonicity", f"WITH {NUMBERED}, m AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_max FROM e) SELECT run, attempt, score, event_id, earlier_max FROM m WHERE score < earlier_max")
def _(spark, t):
    return Q.monotonicity_violations(attempts(t))


@query("win2_best_attempt", f"WITH {NUMBERED} SELECT run, min(attempt) AS attempt, score FROM e WHERE (run, score) IN (SELECT (run, max(score)) FROM e GROUP BY run) GROUP BY 1, 3")
def _(spark, t):
    return Q.best_attempt(attempts(t))


@query("win3_assign_runs", "WITH a AS (SELECT event_id, user_id, ts, event_id % 5 AS attempt FROM events), b AS (SELECT *, CASE WHEN attempt <= lag(attempt) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS s FROM a) SELECT event_id, user_id, attempt, CAST(1 + sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM b")
def _(spark, t):
    appends = t("events").select("event_id", "user_id", "ts", (F.col("event_id") % 5).alias("attempt"))
    return Q.assign_runs(appends, "user_id", ["ts", "event_id"]).drop("ts")


@query("win4_unscored", f"WITH {NUMBERED} SELECT run, CAST(greatest(0, max(attempt) - count(score)) AS BIGINT) AS unscored FROM e GROUP BY 1")
def _(spark, t):
    return Q.unscored(attempts(t))


LOG = """log AS (SELECT conv_id AS run_id, turn AS line_no, CASE turn % 6 WHEN 0 THEN '2026-01-01 10:00:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || '.123 토큰 사용량 - 입력: 2, 캐시 쓰기: ' || length(text) || ', 캐시 읽기: ' || conv_id || ', 출력: ' || turn ELSE text END AS line FROM conversations)"""


def log(t):
    """conversations as run logs: every sixth line reports usage."""
    usage = F.concat(F.lit("2026-01-01 10:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(".123 토큰 사용량 - 입력: 2, 캐시 쓰기: "), F.length("text"), F.lit(", 캐시 읽기: "), "conv_id", F.lit(", 출력: "), "turn")
    return t("conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("line_no"), F.when(F.col("turn") % 6 == 0, usage).otherwise(F.col("text")).alias("line"))


def scored_log(t):
    """Run logs with review blocks: one for each turn, its axes drawn from the text's length; every third has a value out
    of range, every fifth is thrown away, every other one is rolled back or adopted."""
    n = F.length("text") % 11
    axis = lambda name, x: F.concat(F.lit(f'  "Score{name}": '), x.cast("string"))
    lines = F.array(
        F.lit("AI plan 리뷰 요청 전송 - x"), F.lit("AI plan 리뷰 응답 수신 완료 - x"), F.concat(F.lit("(시도 "), F.col("turn") + 1, F.lit("/6)")),
        axis("Accuracy", F.when(F.col("turn") % 3 == 2, F.lit(11)).otherwise(n)), axis("Crud", n), axis("Interface", n), axis("Exception", n), axis("Readability", n),
        F.when(F.col("turn") % 5 == 4, "JSON 검토 보고서 파싱 중 오류 발생").otherwise("ok"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("1차 시도("), n * 10, F.lit("/100)가 최고 후보("))).otherwise(F.concat(F.lit("가장 높은 점수를 받은 1차 시도("), n * 10, F.lit("/100)를 채택합니다"))),
    )
    return t("conversations").select(F.col("conv_id").alias("run_id"), "turn", F.posexplode(lines).alias("i", "line")).select("run_id", (F.col("turn") * 10 + F.col("i")).alias("line_no"), "line")


SCORES = "s AS (SELECT conv_id AS run_id, turn, turn * 10 + 1 AS anchor_line, length(text) % 11 AS n FROM conversations WHERE turn % 3 <> 2 AND turn % 5 <> 4), p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY anchor_line) AS position FROM s)"


@query("win5_adopted_score", f"WITH {SCORES}, b AS (SELECT run_id, max(n * 10) AS best FROM s GROUP BY 1), a AS (SELECT conv_id AS run_id, arg_max(length(text) % 11, turn) FILTER (turn % 2 = 1) * 10 AS adopted FROM conversations GROUP BY 1) SELECT run_id, CAST(adopted AS INTEGER) AS adopted, adopted = best AS is_best FROM a LEFT JOIN b USING (run_id)")
def _(spark, t):
    return G.adopted_score(scored_log(t))


#: Greedy matches, score by score: best so far, lines used up, violations.
REGRESSIONS = """k AS (SELECT conv_id AS run_id, turn * 10 + 9 AS line_no, length(text) % 11 AS n FROM conversations WHERE turn % 2 = 0),
f(run_id, position, best, used, violations) AS (SELECT run_id, position, n, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM p WHERE position = 1
  UNION ALL SELECT p.run_id, p.position, greatest(f.best, p.n),
    CASE WHEN p.n < f.best THEN coalesce((SELECT min(line_no) FROM k WHERE k.run_id = p.run_id AND k.n = p.n AND k.line_no > f.used), f.used) ELSE f.used END,
    f.violations + CASE WHEN p.n < f.best AND NOT EXISTS (SELECT 1 FROM k WHERE k.run_id = p.run_id AND k.n = p.n AND k.line_no > f.used) THEN 1 ELSE 0 END
  FROM f JOIN p ON p.run_id = f.run_id AND p.position = f.position + 1),
v AS (SELECT run_id, CAST(arg_max(violations, position) AS BIGINT) AS violations FROM f GROUP BY 1)"""


@query("win6_unrolled_regressions", f"WITH RECURSIVE {SCORES}, {REGRESSIONS} SELECT run_id, violations FROM v")
def _(spark, t):
    lines = scored_log(t)
    return G.unrolled_regressions(G.score_blocks(lines), G.rollback_lines(lines))


@query("win7_first_by_key", "SELECT source, arg_min(doc_id, (n_chars, doc_id)) AS doc_id FROM documents GROUP BY 1")
def _(spark, t):
    return Q.first_by_key(t("documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars"), F.col("doc_id")]).drop("n_chars")


@query("win8_resume_candidate", "WITH k AS (SELECT lang, source, nullif(doc_id % 4, 3) AS effort, max(doc_id) AS run_id FROM documents GROUP BY ALL) SELECT k.lang, k.source, k.effort, k.run_id FROM k WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id % 7 = 0 AND d.lang = k.lang AND d.source = k.source AND nullif(d.doc_id % 4, 3) IS NOT DISTINCT FROM k.effort)")
def _(spark, t):
    runs = t("documents").select("lang", "source", F.when(F.col("doc_id") % 4 != 3, F.col("doc_id") % 4).alias("effort"), F.col("doc_id").alias("run_id"))
    return Q.resume_candidate(runs, runs.where("run_id % 7 = 0"), ["lang", "source", "effort"])


@query("win9_wall_clock", f"WITH {LOG}, u AS (SELECT run_id, line_no, line_no % 60 AS s FROM log WHERE line_no % 6 = 0) SELECT run_id, CAST(arg_max(s, line_no) - arg_min(s, line_no) AS BIGINT) AS seconds FROM u GROUP BY 1")
def _(spark, t):
    return G.wall_clock(log(t)).select("run_id", "seconds")


@query(
    "win10_uncovered_ranges",
    """WITH i AS (SELECT l_orderkey AS object, greatest(0, CAST(l_quantity AS BIGINT) - 3) AS a, least(60, CAST(l_quantity AS BIGINT) + 5) AS b FROM lineitem),
    x AS (SELECT object, a, b FROM i WHERE a < b UNION ALL SELECT DISTINCT object, 60, 60 FROM i),
    g AS (SELECT object, a, coalesce(max(b) OVER (PARTITION BY object ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM x)
    SELECT object, c AS start, a AS "end" FROM g WHERE a > c""",
)
def _(spark, t):
    i = t("lineitem").select(F.col("l_orderkey").alias("object"), (F.col("l_quantity").cast("long") - 3).alias("start"), (F.col("l_quantity").cast("long") + 5).alias("end"))
    return Q.uncovered_ranges(i, i.select("object").distinct().withColumn("length", F.lit(60)))


@query("win11_row_creators", "SELECT lower(n_name) AS \"table\", arg_min(r_name, n_regionkey) AS step FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0 GROUP BY 1")
def _(spark, t):
    steps = t("region").select(F.col("r_name").alias("step"), F.col("r_regionkey").alias("step_no"))
    targets = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("step"), F.upper("n_name").alias("table"))
    return Q.row_creators(steps, targets, t("nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("table")))


@query("top1_exists_guard", "SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 400000")
def _(spark, t):
    return Q.exists_guard(t("orders"), F.col("o_totalprice") > 400000)


@query("top2_ordinal_sort", "SELECT n_name, n_nationkey FROM nation ORDER BY n_name")
def _(spark, t):
    return t("nation").select("n_name", "n_nationkey").orderBy("n_name")


@query("top3_chunk_by_range", "SELECT o_orderkey, CAST(floor((o_orderkey - (SELECT min(o_orderkey) FROM orders)) / 5000) AS BIGINT) AS chunk FROM orders")
def _(spark, t):
    return Q.chunk_by_range(t("orders"), "o_orderkey").select("o_orderkey", "chunk")


@query("top4_chunk_by_keyset", "WITH k AS (SELECT DISTINCT c_name FROM customer), r AS (SELECT c_name, row_number() OVER (ORDER BY c_name) AS rank FROM k) SELECT c_name, rank, CAST(floor((rank - 1) / 100) AS BIGINT) AS chunk FROM r")
def _(spark, t):
    return Q.chunk_by_keyset(t("customer"), "c_name", 100)


@query("top5_cap_per_group", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def _(spark, t):
    return Q.cap_per_group(t("documents").select("source", "doc_id"), ["source"], [F.col("doc_id")])


@query("src2_preview_counted", "SELECT least(100, count(*)) AS n FROM orders")
def _(spark, t):
    from ledgerline.sources.files import preview

    return preview(t("orders")).agg(F.count("*").alias("n"))


@query("log1_usage_totals", f"WITH {LOG} SELECT conv_id AS run_id, CAST(sum(length(text)) AS BIGINT) AS cache_write, CAST(sum(conv_id) AS BIGINT) AS cache_read, CAST(sum(turn) AS BIGINT) AS output FROM conversations WHERE turn % 6 = 0 GROUP BY 1")
def _(spark, t):
    return G.usage_totals(log(t))


@query(
    "log2_usage_by_kind",
    """WITH l AS (SELECT conv_id AS run_id, turn, role, CASE WHEN turn % 3 < 2 THEN role ELSE NULL END AS response FROM conversations)
    SELECT run_id, role AS kind, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS cache_write, count(*) AS cache_read, CAST(2 * count(*) AS BIGINT) AS output FROM (SELECT c.conv_id AS run_id, coalesce(l.response, c.role) AS role, c.text FROM conversations c JOIN l ON l.run_id = c.conv_id AND l.turn = c.turn) GROUP BY 1, 2""",
)
def _(spark, t):
    """Usage of each kind of call: every turn is a request, a usage line, and for two of three a response."""
    lines = F.array(F.concat(F.lit("AI "), "role", F.lit(" 요청 전송 - x")), F.concat(F.lit("토큰 사용량 - 입력: 2, 캐시 쓰기: "), F.length("text"), F.lit(", 캐시 읽기: 1, 출력: 2")), F.when(F.col("turn") % 3 < 2, F.concat(F.lit("AI "), "role", F.lit(" 응답 수신 완료 - x"))).otherwise("-"))
    rows = t("conversations").select(F.col("conv_id").alias("run_id"), "turn", F.posexplode(lines).alias("i", "line")).select("run_id", (F.col("turn") * 10 + F.col("i")).alias("line_no"), "line")
    return G.usage_by_kind(rows)


@query("log3_score_blocks", f"WITH {SCORES} SELECT run_id, anchor_line, position, n AS accuracy, n AS crud, n AS interface, n AS exception, n AS readability, n * 10 AS score FROM p")
def _(spark, t):
    return G.score_blocks(scored_log(t))


@query(
    "log4_run_metrics",
    f"""WITH RECURSIVE {SCORES}, {REGRESSIONS}, m AS (SELECT run_id, position, n, max(n) OVER (PARTITION BY run_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
    b AS (SELECT run_id, string_agg(CAST(n * 10 AS VARCHAR), ',' ORDER BY position) AS trajectory, count(*) FILTER (n < before) AS violations, count(*) AS scored, max(n) * 10 AS best FROM m GROUP BY 1),
    c AS (SELECT conv_id AS run_id, max(turn) + 1 AS attempts, CAST(arg_max(length(text) % 11, turn) FILTER (turn % 2 = 1) * 10 AS INTEGER) AS adopted FROM conversations GROUP BY 1)
    SELECT run_id, CAST(attempts AS INTEGER) AS attempts, false AS redrafted_on_stagnation, false AS redrafted_on_request, trajectory, coalesce(b.violations, 0) AS monotonicity_violations, coalesce(v.violations, 0) AS unrolled_regressions,
      CAST(0 AS BIGINT) AS cache_write, CAST(0 AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS output, CAST(NULL AS BIGINT) AS seconds, adopted, adopted = best AS is_best, CAST(greatest(0, attempts - coalesce(scored, 0)) AS INTEGER) AS unscored
    FROM c LEFT JOIN b USING (run_id) LEFT JOIN v USING (run_id)""",
)
def _(spark, t):
    """All metrics of each run."""
    return G.run_metrics(scored_log(t)).withColumn("trajectory", F.array_join("trajectory", ","))


REVIEWS = "SELECT doc_id, quality, toxic FROM labels"


@query("log5_failed_axes", "SELECT doc_id, quality, toxic, CASE WHEN doc_id % 9 = 0 THEN 'quality,toxic' ELSE concat_ws(',', CASE WHEN quality < 1 THEN 'quality' END, CASE WHEN toxic < 1 THEN 'toxic' END) END AS failed FROM (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN quality END AS quality, toxic FROM labels)")
def _(spark, t):
    reviews = t("labels").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("quality")).alias("quality"), "toxic")
    return G.failed_axes(reviews, ["quality", "toxic"], 1).withColumn("failed", F.array_join("failed", ","))


@query("log6_verification_coverage", "WITH s AS (SELECT source AS job, doc_id AS step, n_chars > 500 AS adopted FROM documents), d AS (SELECT DISTINCT source AS job, doc_id AS step FROM documents JOIN labels USING (doc_id) WHERE quality = 0), c AS (SELECT s.job, count(*) AS steps_total, count(d.step) FILTER (adopted) AS lost FROM s LEFT JOIN d USING (job, step) GROUP BY 1) SELECT job, steps_total, steps_total - lost AS steps_verified, round((steps_total - lost) * 100 / steps_total, 1) AS coverage, lost > 0 AS attention FROM c")
def _(spark, t):
    steps = t("documents").select(F.col("source").alias("job"), F.col("doc_id").alias("step"), (F.col("n_chars") > 500).alias("adopted"))
    bad = t("labels").where("quality = 0").select("doc_id")
    defects = t("documents").join(bad, "doc_id").select(F.col("source").alias("job"), F.col("doc_id").alias("step"), F.lit("Unverifiable").alias("kind"))
    return G.verification_coverage(steps, defects, F.lit(False))


@query("log7_classify_findings", "SELECT event_id, CASE event_type WHEN 'click' THEN 'B' WHEN 'view' THEN 'C' WHEN 'purchase' THEN 'P' ELSE CASE WHEN event_id % 3 = 0 THEN 'A' ELSE 'Unclassified' END END AS \"check\", CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'UPDATE' END AS kind, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(event_id % 20 AS INTEGER) END AS ordinal, CASE event_type WHEN 'click' THEN 'YMD;PGNAME' WHEN 'view' THEN 'TID' ELSE '' END AS items FROM events")
def _(spark, t):
    head = F.concat(F.lit("S07 섹션의 UPDATE "), F.col("event_id") % 20)
    text = (
        F.when(F.col("event_type") == "click", F.concat(head, F.lit("(갱신 1) 문장에 명세서가 확정한 조인 키 YMD, PGNAME이(가) 없습니다")))
        .when(F.col("event_type") == "view", F.concat(head, F.lit(" 문장이 명세서에 없는 술어 컬럼 TID을(를) 씁니다")))
        .when(F.col("event_type") == "purchase", F.concat(head, F.lit(" 문장의 원본에 없는 최상위 술어 A IN (1, 2)")))
        .when(F.col("event_id") % 3 == 0, F.concat(head, F.lit(" 2개만 담고 있습니다. 명세서 DML 범위 표는 3개")))
        .otherwise("x")
    )
    return G.classify_findings(t("events").select("event_id", text.alias("message"))).select("event_id", "check", "kind", "ordinal", F.array_join("items", ";").alias("items"))


@query("log8_finding_matrix", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') GROUP BY 1")
def _(spark, t):
    rows = t("documents").join(t("labels").select("doc_id"), "doc_id").select("source", F.col("lang").alias("condition")).where("condition IN ('en', 'fr')")
    return G.finding_matrix(rows, ["source"], ("en", "fr"))


@query("log10_harness_gaps", "SELECT source AS job, count(*) AS steps, count(l.doc_id) AS measured, count(*) FILTER (n_chars < 300) AS missing_files, count(l.doc_id) = 0 AS unmeasured FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def _(spark, t):
    d = t("documents").join(t("labels").select("doc_id", F.lit(True).alias("l")), "doc_id", "left")
    steps = d.select(F.col("source").alias("job"), F.col("doc_id").alias("step"), F.coalesce("l", F.lit(False)).alias("measured"), (F.col("n_chars") >= 300).alias("has_file"))
    return G.harness_gaps(steps, steps)


@query("log11_status_counts", "SELECT o_orderstatus AS status, count(*) AS documents FROM orders GROUP BY 1")
def _(spark, t):
    return G.status_counts(t("orders").withColumnRenamed("o_orderstatus", "status"))


HASHES = "SELECT CAST(doc_id AS VARCHAR) AS key, sha256(text) AS source_hash FROM documents"


@query("inc1_composite_hash", f"WITH h AS ({HASHES}), d AS (SELECT CAST(doc_id AS VARCHAR) AS key, string_agg(CAST(doc_id + k AS VARCHAR) || '=' || sha256(source), ';' ORDER BY CAST(doc_id + k AS VARCHAR)) AS s FROM documents, range(1, 3) r(k) WHERE doc_id % 3 = 0 GROUP BY 1) SELECT key, sha256(source_hash || '|4|' || coalesce(s, '')) AS composite_hash FROM h LEFT JOIN d USING (key)")
def _(spark, t):
    docs = t("documents")
    deps = docs.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("key"), F.explode(F.array((F.col("doc_id") + 1).cast("string"), (F.col("doc_id") + 2).cast("string"))).alias("dependency"), F.sha2("source", 256).alias("hash"))
    return I.composite_hash(docs.select(F.col("doc_id").cast("string").alias("key"), F.sha2("text", 256).alias("source_hash")), deps, 4)


def cache(t):
    return t("documents").select(F.col("doc_id").alias("key"), F.col("source").alias("identity"), F.col("lang").alias("composite_hash"), F.sha2("text", 256).alias("content_hash"))


@query("inc2_plan_recompute", "SELECT doc_id AS key, CASE WHEN doc_id % 13 > 3 AND doc_id % 13 <> 5 THEN 'reuse' ELSE 'recompute' END AS decision, CASE doc_id % 13 WHEN 0 THEN 'not cached' WHEN 1 THEN 'format version' WHEN 2 THEN 'identity' WHEN 3 THEN 'composite hash' WHEN 5 THEN 'content hash' ELSE 'unchanged' END AS reason FROM documents")
def _(spark, t):
    m = F.col("key") % 13
    old = cache(t).where(m != 0).withColumns({"format_version": F.when(m == 1, 21).otherwise(22), "identity": F.when(m == 2, "x").otherwise(F.col("identity")), "composite_hash": F.when(m == 3, "x").otherwise(F.col("composite_hash")), "content_hash": F.when(m == 5, "x").otherwise(F.col("content_hash"))})
    return I.plan_recompute(cache(t), old, 22)


@query("inc3_snapshot_diff", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 11 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0)")
def _(spark, t):
    d = t("documents").select("doc_id", F.md5("text").alias("h"))
    after = d.where("doc_id % 7 <> 0").withColumn("h", F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("h")))
    return I.snapshot_diff(d.where("doc_id % 5 <> 0"), after, "doc_id", "h")


@query("inc4_upsert", "SELECT source, CASE WHEN count(*) FILTER (doc_id % 2 = 1) > 0 THEN max(doc_id) FILTER (doc_id % 2 = 1) ELSE max(doc_id) END AS doc_id FROM documents GROUP BY 1")
def _(spark, t):
    d = t("documents").select("source", "doc_id")
    return I.upsert(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["source"], [F.col("doc_id")])


@query("inc4_upsert_store", "SELECT doc_id, lang, CASE WHEN doc_id % 11 = 0 THEN 'again' ELSE source END AS source, n_chars, text FROM documents")
def _(spark, t):
    d = t("documents").select("doc_id", "lang", "source", "n_chars", "text")
    path = scratch_path(spark)
    # stored without the documents that only the updates bring
    I.write_store(d.where("doc_id % 22 <> 0"), path, ["doc_id"], 16)
    I.upsert_store(spark, path, d.where("doc_id % 11 = 0").withColumn("source", F.lit("again")), ["doc_id"], [F.col("n_chars")])
    return I.read_store(spark, path)


@query("inc5_merge_into_store", "SELECT source, lang, coalesce(max(doc_id) FILTER (doc_id % 3 = 2), max(doc_id) FILTER (doc_id % 3 = 1), max(doc_id)) AS doc_id FROM documents GROUP BY 1, 2")
def _(spark, t):
    d = t("documents").select("source", "lang", "doc_id")
    path, key, order = scratch_path(spark), ["source", "lang"], [F.col("doc_id")]
    I.write_store(I.merge_stores(d.where("doc_id % 3 = 0"), key=key, order=order), path, key, 8)
    I.merge_into_store(spark, path, *(d.where(f"doc_id % 3 = {i}") for i in (1, 2)), key=key, order=order)
    return I.read_store(spark, path)


@query("inc5_merge_stores", "SELECT lang, source, coalesce(max(doc_id) FILTER (doc_id % 3 = 2), max(doc_id) FILTER (doc_id % 3 = 1), max(doc_id)) AS doc_id FROM documents GROUP BY 1, 2")
def _(spark, t):
    d = t("documents").select("lang", "source", "doc_id")
    return I.merge_stores(*(d.where(f"doc_id % 3 = {i}") for i in range(3)), key=["lang", "source"], order=[F.col("doc_id")])


@query("inc6_tail_hash", "SELECT doc_id, sha256(right(text, 200)) AS hash FROM documents WHERE length(text) > 0")
def _(spark, t):
    return t("documents").where("length(text) > 0").select("doc_id", I.tail_hash(F.col("text"), 200).alias("hash"))


#: Events in two deliveries: the earlier half but for every seventh, then the rest, whose early rows come late.
DELIVERED = "e AS (SELECT *, epoch_us(ts) AS us FROM events), c AS (SELECT min(us) + (max(us) - min(us)) // 2 AS cut FROM e), d AS (SELECT e.*, us < cut AND event_id % 7 <> 0 AS early FROM e, c)"


def deliveries(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))
    cut = e.agg((F.min("us") + F.floor((F.max("us") - F.min("us")) / 2)).alias("cut")).first()["cut"]
    early = (F.col("us") < cut) & (F.col("event_id") % 7 != 0)
    return e.where(early).drop("us"), e.where(~early).drop("us")


def streamed(spark, t, result):
    """What result gives of a stream of events that arrive in two deliveries. After the first the stream ends; after the
    second it is started anew and goes on from its checkpoint."""
    source, path = scratch_path(spark), scratch_path(spark)
    for part in deliveries(t):
        part.write.mode("append").parquet(source)
        out = drained(result(spark.readStream.schema(part.schema).parquet(source)), path)
    return out


@query(
    "str1_usage_windows",
    f"WITH {DELIVERED}, w AS (SELECT max(us) FILTER (early) // 1000 - 600000 AS first, max(us) // 1000 - 600000 AS last FROM d), b AS (SELECT *, (us // 3600000000) * 3600 AS window_start FROM d) SELECT window_start, user_id, count(*) AS n FROM b, w WHERE (early OR (window_start + 3600) * 1000 > first) AND (window_start + 3600) * 1000 <= last GROUP BY 1, 2",
)
def _(spark, t):
    """Closed windows of the stream: late rows of closed windows are left out, windows still open don't come out."""
    out = streamed(spark, t, lambda events: stream_usage(events, key="user_id"))
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "user_id", "n")


@query(
    "str2_journal_conflicts",
    f"""WITH {DELIVERED}, j AS (SELECT * FROM d WHERE event_type = 'purchase'), v AS (SELECT * FROM d WHERE event_type = 'view'),
    w AS (SELECT least((SELECT max(us) FROM j WHERE early), (SELECT max(us) FROM v WHERE early)) // 1000 - 600000 AS first, least((SELECT max(us) FROM j), (SELECT max(us) FROM v)) // 1000 - 600000 AS last),
    k AS (SELECT v.* FROM v, w WHERE early OR us > first * 1000)
    SELECT j.event_id AS run_id, j.user_id AS step_code FROM j, w WHERE (early OR us > first * 1000) AND us + 172800000000 < last * 1000 AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = j.user_id AND k.us BETWEEN j.us AND j.us + 172800000000)""",
)
def _(spark, t):
    """Purchases that no view of the same user follows within two days, as they come out of two joined streams when none
    can come any more."""

    def conflicts(events):
        side = lambda kind, status: events.where(F.col("event_type") == kind).select(F.lit(0).alias("run_id"), F.col("user_id").alias("step_code"), F.lit("Succeeded").alias(status), "ts")
        return stream_journal_conflicts(side("purchase", "step_status"), side("view", "checkpoint_status"), within="48 HOURS")

    lone = streamed(spark, t, conflicts)
    bought = t("events").where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return lone.join(bought, (F.col("step_code") == F.col("user_id")) & (lone["ts"] == bought["ts"])).select(F.col("event_id").alias("run_id"), "step_code")


@query("exp15_normalized_score", "SELECT l_orderkey, l_linenumber, CAST(round_even((CAST(l_tax AS DECIMAL(10,2)) * 25 + CAST(l_discount AS DECIMAL(10,2)) * 100 + l_linenumber + 3 + 1) * 2, 0) AS INTEGER) AS score FROM lineitem")
def _(spark, t):
    """Five axes from 0 to 10; taxes give quarters, so that halves come up."""
    money = lambda c, k: F.col(c).cast("decimal(10,2)") * k
    return t("lineitem").select("l_orderkey", "l_linenumber", normalized_score(money("l_tax", 25), money("l_discount", 100), F.col("l_linenumber"), F.lit(3), F.lit(1)).alias("score"))
