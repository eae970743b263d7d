"""Many literals in many texts, Markdown lines, running values and spans, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from ledgerline.functions.expressions import mentions
from ledgerline.operators import joins as J
from ledgerline.operators import scans as S
from ledgerline.operators import search as X
from ledgerline.operators import sequence as Q
from ledgerline.operators import text as T


def test_literals_of_any_characters(spark):
    texts = ["상태는 '미정산' 이고 '-' 이다", "SUMMARY SUM_1 aSUM", "x SUM, impaymobile인", None, "", "a b", "((", "미정산_", "é SUMé"]
    values = ["미정산", "-", "'-'", "SUM", "impaymobile", "", "정산", "a b", "SUM_1", "((", "\\E", "é", "UM"]
    rnd = random.Random(1)
    texts += ["".join(rnd.choice("ab_ '-미") for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    values += ["".join(rnd.choice("ab_ '-미") for _ in range(rnd.randint(1, 3))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    literals = spark.createDataFrame([(v,) for v in [*values, None, "SUM"]], "literal string")
    each = [docs.where(mentions(F.col("text"), F.lit(v))).select("doc_id", F.lit(v).alias("literal")) for v in sorted(set(values))]
    wanted = sorted(tuple(r) for part in each for r in part.collect())
    for most in (1000, 5):  # one automaton, several
        assert sorted(tuple(r) for r in X.occurrences(literals, docs, "doc_id", True, most).collect()) == wanted
    plain = sorted((i, v) for i, t in enumerate(texts) if t is not None for v in set(values) if v in t)
    assert sorted(tuple(r) for r in X.occurrences(literals, docs, "doc_id").collect()) == plain
    assert X.occurrences(literals.limit(0), docs, "doc_id").count() == 0 == X.occurrences(literals, docs.limit(0), "doc_id").count()


def test_codebook_lists_values_without_letters(spark):
    docs = spark.createDataFrame([(1, "상태는 '미정산' 이고 '-' 이다")], "doc_id int, text string")
    literals = spark.createDataFrame([("p", None, "미정산"), ("q", "c", "미정산"), ("p", "d", "'-'"), ("p", "d", "none")], "label string, column string, value string")
    got = {r["value"]: (r["column"], r["procedures"], r["documents"], r["match_eligible"], r["listed"]) for r in T.build_codebook(literals, docs).collect()}
    assert got == {"미정산": ("c", ["p", "q"], 1, True, True), "'-'": ("d", ["p"], 1, True, True), "none": ("d", ["p"], 0, True, False)}


def test_short_quotations_are_found(spark):
    quotes = spark.createDataFrame([(1, "a"), (2, " *b c* "), (3, "``"), (4, None)], "item_id int, quote string")
    docs = spark.createDataFrame([(1, "xay"), (2, "b\n|c"), (3, ""), (4, None)], "doc_id int, text string")
    assert {tuple(r) for r in T.find_quotes(quotes, docs).collect()} == {(1, 1), (2, 2)}


def lines(text):
    rows = re.sub("\r\n?", "\n", text).split("\n")
    fence = [bool(re.match(r"\s*(```|~~~)", x)) for x in rows]
    closed, inside, heading, out = sum(fence) % 2 == 0, False, None, []
    for i, x in enumerate(rows):
        within = closed and inside and not fence[i]
        heading = x if re.match(r"#{1,6}\s+\S", x) and not within else heading
        out.append((i, x, fence[i], within, heading))
        inside ^= fence[i]
    return out


def test_markdown_lines_fold_inside_the_row(spark):
    rnd = random.Random(1)
    parts = ["# A", "## b", "text", "```", "~~~x", " ```sql", "#no", "", "###### deep", "-- c", "| a | b |", " # no"]
    texts = ["", "\r", "\n\n", "a\r\nb\rc\n", "```\n# x", "```\n# x\n```"] + ["".join(rnd.choice(parts) + rnd.choice(["\n", "\r\n", "\r"]) for _ in range(rnd.randint(0, 300))) for _ in range(30)]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id int, text string")
    found = T.markdown_lines(docs)
    assert "Exchange" not in found._jdf.queryExecution().toString() and "Window" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert {i: sorted(rows) for i, rows in got.items()} == {i: lines(t) for i, t in enumerate(texts)}


def test_running_values_cross_partitions(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "hot", "cold", None]), i, rnd.choice([None, rnd.randint(0, 9)])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    out = S.scan(df, ["g"], ["i"], 7, total=S.Running("sum", F.col("v")), best=S.Running("max", F.col("v"), False), low=S.Running("min", F.col("v")), last=S.Running("last", F.col("v")))
    got, state = {(r["g"], r["i"]): (r["total"], r["best"], r["low"], r["last"]) for r in out.collect()}, {}
    for g, i, v in rows:
        own = state.setdefault(g, [])
        before, own = [x for x in own if x is not None], own + [v]
        state[g] = own
        seen = [x for x in own if x is not None]
        assert got[(g, i)] == (sum(seen) if seen else None, max(before, default=None), min(seen, default=None), seen[-1] if seen else None)
    assert [r["n"] for r in S.numbered(df, ["i"], "n").orderBy("i").collect()] == list(range(1, 601))


def test_one_run_over_many_partitions(spark):
    rnd = random.Random(4)
    scores = [(1, i, rnd.randint(0, 100)) for i in range(500)]
    df = spark.createDataFrame(scores, "run_id int, position int, score int").repartition(8)
    best, wanted = None, set()
    for _, i, s in scores:
        if best is not None and s < best:
            wanted.add(i)
        best = s if best is None else max(best, s)
    assert {r["position"] for r in Q.monotonicity_violations(df, "run_id", "position").collect()} == wanted


def test_spans_of_any_length(spark):
    rnd = random.Random(5)
    points = [(rnd.randint(0, 2), rnd.randint(-50, 2_000_000)) for _ in range(500)] + [(1, 5)] * 50
    spans = [(rnd.randint(0, 2), s, s + rnd.choice([0, 1, 3, 100, 5000, 1_000_000, -5])) for s in (rnd.randint(-60, 2_000_000) for _ in range(150))]
    p, s = spark.createDataFrame(points, "k int, at int"), spark.createDataFrame(spans, "k int, a long, b long")
    wanted = sorted((k, x, a, b) for k, x in points for q, a, b in spans if q == k and a <= x <= b)
    for width in (1, 7, 1000):
        assert sorted(map(tuple, J.interval_join(p, s, ["k"], "at", "a", "b", width).select("k", "at", "a", "b").collect())) == wanted
    assert J.interval_join(p, s.limit(0), ["k"], "at", "a", "b").count() == 0
    real = J.interval_join(p.withColumn("at", F.col("at") / 2), s, ["k"], "at", "a", "b")
    assert real.count() == sum(q == k and a <= x / 2 <= b for k, x in points for q, a, b in spans)
