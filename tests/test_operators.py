import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerline.functions import checks
from ledgerline.functions.expressions import cast_int, mentions, normalize_heading, round3
from ledgerline.operators import aggregate, graph, joins, reconcile, runlog, sequence, settlement, sets, text
from ledgerline.sources import files
from ledgerline.sources.generate import generate_linked
from ledgerline.streaming import journal


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def test_rounding_as_the_source_database_does(spark):
    df = spark.createDataFrame([("12.5",), ("-12.5",), ("12.49",), ("-12.49",), (None,)], "s string").select(F.col("s").cast("decimal(10,2)").alias("x"))
    got = df.select(round3(F.col("x"), 0).cast("int"), round3(F.col("x"), 0, 1).cast("int"), cast_int(F.col("x")), cast_int(F.col("x"), money=True)).collect()
    assert [tuple(r) for r in got] == [(13, 12, 12, 13), (-13, -12, -12, -13), (12, 12, 12, 12), (-12, -12, -12, -12), (None,) * 4]


def case(case_id, rows_, status="SUCCESS"):
    return (case_id, status, None, [rows_] if rows_ is not None else None)


@pytest.fixture
def results(spark):
    def make(*cases):
        schema = "ProcedureName string, ExecutionResults array<struct<CaseId string, Status string, ErrorCode string, ResultSets array<array<map<string,string>>>>>"
        return files.result_cells(spark.createDataFrame([("p", list(cases))], schema))

    return make


@pytest.mark.parametrize(
    ("legacy", "target", "result"),
    [
        ([case("1", [{"a": "1"}])], [case("1", [{"a": "1"}]), case("9", [{"a": "1"}])], "match"),
        ([case("1", [{"a": "1"}])], [case("2", [{"a": "1"}])], "missing"),
        ([case("1", [{"a": "1"}])], [case("1", [{"a": "1"}], "FAIL")], "status"),
        ([case("1", [{"a": "1"}])], [case("1", [{"a": "1"}, {"a": "2"}])], "rows"),
        ([case("1", [{"a": "1"}])], [case("1", None)], "sets"),
        ([case("1", [{"a": "1"}])], [case("1", [{"a": "2"}])], "cells"),
        ([case("1", [{"a": "1", "b": "x"}])], [case("1", [{"a": "1"}])], "cells"),
        ([case("1", [{"a": "1.0"}])], [case("1", [{"a": "1.00"}])], "match"),
        ([case("1", [{"a": "ABC"}])], [case("1", [{"A": "abc"}])], "match"),
    ],
)
def test_compare_cases(results, legacy, target, result):
    assert rows(reconcile.compare_cases(results(*legacy), results(*target))) == [("p", "1", result)]


def test_text_numbers_differ_by_how_they_are_written(results):
    a, b = results(case("1", [{"a": "1.0"}])), results(case("1", [{"a": "1.00"}]))
    assert reconcile.compare_cases(a, b, numeric="text").first()["result"] == "cells"
    assert reconcile.match_rate(reconcile.compare_cases(a, a)).first()["rate"] == 100
    assert reconcile.match_rate(reconcile.compare_cases(a, a).limit(0)).first()["rate"] == 0


def test_a_table_is_no_different_from_itself(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3.0)], "k int, s string, v double")
    assert reconcile.table_diff(df, df, ["k"]).count() == 0
    assert sets.except_both(df, df).count() == 0
    assert sets.except_all_both(df.union(df), df).count() == 2


def test_update_from_fails_on_several_matches(spark):
    target = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    source = spark.createDataFrame([(1, 5), (1, 6)], "k int, w int")
    with pytest.raises(PySparkException, match="several rows"):
        settlement.update_from(target, source, ["k"], {"v": F.col("s_w")}).collect()
    assert rows(settlement.update_from(target, source.limit(1), ["k"], {"v": F.col("v") + F.col("s_w")})) == [(1, 15), (2, 20)]


def test_not_in_with_a_null_gives_nothing(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert rows(joins.not_in(left, spark.createDataFrame([(1,)], "k int"), "k")) == [(2,)]
    assert joins.not_in(left, spark.createDataFrame([(1,), (None,)], "k int"), "k").count() == 0
    assert joins.not_in(left, left.limit(0), "k").count() == 3


def test_interval_join_in_cells_is_the_same_join(spark):
    points = spark.range(300).select((F.col("id") % 3).alias("o"), F.col("id").alias("at"))
    spans = spark.createDataFrame([(0, 5, 50), (0, 40, 41), (1, 0, 299), (2, 9, 3)], "o long, a long, b long")
    wanted = rows(joins.interval_join(points, spans, ["o"], "at", "a", "b"))
    assert wanted == rows(joins.interval_join(points, spans, ["o"], "at", "a", "b", width=16)) and len(wanted) > 100


def test_closure_meets_cycles_and_shared_nodes_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e")], "source string, target string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.closure(edges, roots, 2)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2)]
    levels = {r["node"]: (r["level"], r["in_cycle"]) for r in graph.execution_levels(edges).collect()}
    assert levels["e"] == (0, False) and levels["d"] == (1, False) and levels["a"] == (2, True)


def test_components_of_a_long_path(spark):
    pairs = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(pairs).select("component").distinct().collect()[0][0] == 0


def test_upstream_first_gives_up_on_chains(spark):
    reads = spark.createDataFrame([("x", "t1"), ("y", "t2")], "item string, table string")
    pending = spark.createDataFrame([("x", "t9"), ("y", "t1"), ("z", "t2")], "item string, table string")
    assert graph.upstream_first(reads, pending).count() == 0
    assert rows(graph.upstream_first(reads.limit(1), pending)) == [("x", "y")]


BLOCK = '{{ "ScoreAccuracy": {}, "ScoreCrud": {}, "ScoreInterface": {}, "ScoreException": {}, "ScoreReadability": {} }}'


def log(spark, *lines):
    return spark.createDataFrame([("r", i, line) for i, line in enumerate(lines)], "run_id string, line_no int, line string")


def test_scores_of_a_run(spark):
    review = "2026-01-01 10:00:00.100 AI plan 리뷰 응답 수신 완료 - x"
    block = lambda *n: BLOCK.format(*n)
    lines = [
        review, block(6, 9, 7, 7, 10), block(6, 9, 7, 7, 10), "(시도 1/6)",
        review, block(6, 8, 6, 9, 9), "(시도 2/6)",
        review, block(8, 9, 8, 8, 9), "(시도 6/6)",
        review, block(7, 7, 7, 8, 8), "1차 시도(76/100)가 최고 후보(",
        review, block(7, 7, 7, 8, 8), "JSON 검토 보고서 파싱 중 오류 발생",
        review, block(11, 7, 7, 8, 8), review, *["x"] * 15, block(1, 1, 1, 1, 1), "2026-01-01 10:00:09.000 end",
    ]
    m = runlog.run_metrics(log(spark, *lines)).first()
    assert (m["trajectory"], m["monotonicity_violations"], m["unscored"], m["unrolled_regressions"], m["seconds"]) == ([78, 76, 84, 74], 2, 2, 1, 9)


def test_usage_goes_to_the_response_then_to_the_request_once(spark):
    usage = "토큰 사용량 - 입력: 2, 캐시 쓰기: {}, 캐시 읽기: 0, 출력: 1, 추론: 미보고"
    lines = ["AI a 요청 전송", usage.format(1), "AI b 응답 수신 완료", usage.format(2), "x", "x", "x", "AI c 요청 전송", usage.format(4), usage.format(8), "x"]
    got = {r["kind"]: (r["calls"], r["cache_write"]) for r in runlog.usage_by_kind(log(spark, *lines)).collect()}
    assert got == {"b": (1, 1), runlog.UNKNOWN_KIND: (2, 10), "c": (1, 4)}
    assert runlog.usage_totals(log(spark, *lines)).first()["cache_write"] == 15


def test_unrolled_regressions_against_a_loop(spark):
    import random

    random.seed(3)
    scores, backs, want = [], [], {}
    for run in range(30):
        own, lines = [random.randrange(5) for _ in range(8)], [random.randrange(5) for _ in range(6)]
        scores += [(run, i, s) for i, s in enumerate(own)]
        backs += [(run, i, s) for i, s in enumerate(lines)]
        best, at, n = own[0], 0, 0
        for s in own:
            if s < best:
                hit = next((i for i in range(at, len(lines)) if lines[i] == s), None)
                at, n = (hit + 1, n) if hit is not None else (at, n + 1)
            best = max(best, s)
        want[run] = n
    got = runlog.unrolled_regressions(spark.createDataFrame(scores, "run_id int, position int, score int"), spark.createDataFrame(backs, "run_id int, line_no int, score int"))
    assert {r["run_id"]: r["violations"] for r in got.collect()} == want


def test_markdown_with_an_unclosed_fence_has_none(spark):
    docs = spark.createDataFrame([(1, "# A\n```\nx\n# B"), (2, ""), (3, None)], "doc_id int, text string")
    got = text.markdown_lines(docs).where("doc_id = 1").orderBy("line_no").collect()
    assert [r["in_fence"] for r in got] == [False] * 4 and got[3]["heading"] == "# B"


def test_words_and_headings(spark):
    df = spark.createDataFrame([("code 코드A1 B", "A1"), ("xA1", "A1"), ("'A1'", "A1"), ("A1_b", "A1"), ("a.b(", "a.b(")], "t string, v string")
    assert [r[0] for r in df.select(mentions(F.col("t"), F.col("v"))).collect()] == [True, False, True, False, True]
    assert spark.range(1).select(normalize_heading(F.lit("## 2.1. Steps :"))).first()[0] == "Steps"


def test_keyset_chunks_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.format_string("k%05d", F.col("id") % 700).alias("k"))
    a, b = (rows(sequence.chunk_by_keyset(df, "k", 64, n)) for n in (1, 64))
    assert a == b and a[-1][1:] == (700, 10)


def test_fingerprints_do_not_depend_on_order(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).cast("decimal(19,4)").alias("m"))
    one, many = (aggregate.table_fingerprint(df.repartition(n, "id"), ["m"]).first() for n in (1, 64))
    assert one == many


def test_publish_gate_and_severities(spark):
    issues = spark.createDataFrame([(1, "Warning"), (2, "Critical")], "run_id int, severity string")
    steps = spark.createDataFrame([(1, "a"), (2, "a")], "run_id int, step_code string")
    done = steps.withColumn("checkpoint_status", F.lit("Succeeded"))
    locks = spark.createDataFrame([(1, "Held"), (2, "Held")], "owner_run_id int, lock_status string")
    assert [reconcile.publish_gate(steps, done, issues, locks, r).first()["may_publish"] for r in (1, 2)] == [True, False]
    assert tuple(reconcile.severity_gate(issues.limit(0)).first()) == (0, None, True)


def test_user_checks_are_held_to_the_schema(spark):
    checks.register_check("T1", "Error", lambda df: df.select(F.lit(1).alias("run_id")))
    with pytest.raises(ValueError, match="step_code"):
        checks.run_check("T1", spark.range(1))
    with pytest.raises(ValueError, match="registered"):
        checks.register_check("T1", "Error", lambda df: df)


def test_generated_tables_are_linked_and_repeat(spark):
    make = lambda: generate_linked(spark, {"p": {"id": "key"}, "c": {"pid": "ref:p", "k": "choice:x|y", "a": "amount"}}, {"p": 7, "c": 50}, 3)
    assert rows(make()["c"]) == rows(make()["c"]) and {r["pid"] for r in make()["c"].collect()} <= set(range(7))


def test_streams_give_what_their_batch_form_gives(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 2, f"2026-01-01 {i % 24:02d}:00:00", float(i)) for i in range(60)], "event_id int, run_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = journal.stream_usage(stream).writeStream.outputMode("complete").format("memory").queryName("usage").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("usage")) == rows(journal.stream_usage(events))

    j = events.select("run_id", F.col("event_id").cast("string").alias("step_code"), F.lit("Succeeded").alias("step_status"), "ts")
    c = j.where("step_code % 3 <> 0").withColumnRenamed("step_status", "checkpoint_status")
    j.coalesce(1).write.parquet(str(tmp_path / "j"))
    c.coalesce(1).write.parquet(str(tmp_path / "c"))
    late = spark.createDataFrame([(9, "late", "Succeeded", "2026-02-01 00:00:00")], "run_id int, step_code string, step_status string, ts string").withColumn("ts", F.to_timestamp("ts"))
    read = lambda n, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / n))
    q = journal.stream_journal_conflicts(read("j", j), read("c", c)).writeStream.outputMode("append").format("memory").queryName("conflicts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    late.write.mode("append").parquet(str(tmp_path / "j"))
    late.withColumnRenamed("step_status", "checkpoint_status").write.mode("append").parquet(str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("conflicts"), "step_code") == rows(journal.stream_journal_conflicts(j, c), "step_code")


def test_log_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\ny\nz")
    assert rows(files.read_log(spark, str(tmp_path))) == [("a.log", 0, "x"), ("a.log", 1, "y"), ("a.log", 2, "z")]
