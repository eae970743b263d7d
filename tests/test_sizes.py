"""What only larger tables bring up: rare keys, long chains, many rounds."""

import random

import duckdb

from ledgerline.operators import graph as G
from ledgerline.operators import search as X
from ledgerline.operators import text as T
from ledgerline.plans import catalog_queries, catalogue
from tests.compare import same
from tests.test_graph_loops import close, closed


def test_copies_of_orders_by_their_own_keys(spark, tmp_path):
    """Negative keys that 97 or 89 divide, which orders have from 66,000 on."""
    rows = [(k, k % 7, "O") for k in [*range(0, 200_000, 1000), 97, 89, 97 * 89, 5]]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    wanted = catalogue.oracle_sql()["rec4_table_diff"]
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    same(catalogue.queries()["rec4_table_diff"](spark, str(tmp_path)), tables, wanted)


def counted(monkeypatch, most):
    """Tables that graph loops write from now on; more than that many are an error."""
    made, write = [], G.written

    def written(df):
        made.append(df)
        assert len(made) <= most
        return write(df)

    monkeypatch.setattr(G, "written", written)
    return made


def test_rounds_are_bounded_by_the_entries_not_by_chains(spark, monkeypatch):
    counted(monkeypatch, 40)
    chains = [(f"{c}{i}", f"{c}{i + 1}", 0) for c in "ab" for i in range(200)] + [("a3", "b150", 1), ("b1", "a2", 1)]
    for entries in (["A0", "b0", "x"], ["b0", "a0"]):
        assert close(spark, entries, chains) == closed(entries, chains)


def test_what_comes_up_late_is_left_out(spark):
    """Wide and deep graphs with far more than the cap, where labels stop early and owners are dropped."""
    for seed in range(1, 3):
        rnd = random.Random(seed)
        pairs = {(f"n{i}", f"n{min(59, i + rnd.choice([1, 1, 1, 2, 9]))}") for i in range(60) for _ in range(2)} | {(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(15)}
        edges = [(a, b, k) for k, (a, b) in enumerate(sorted(pairs, key=lambda e: rnd.random()))]
        entries = [f"n{i}" for i in rnd.sample(range(60), 3 + 2 * seed)]
        assert close(spark, entries, edges) == closed(entries, edges)


def test_labels_of_components_are_not_broadcast(spark, monkeypatch):
    made = counted(monkeypatch, 40)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20) if i % 7], "a long, b long")
    got = {r["node"]: r["component"] for r in G.components(pairs).collect()}
    assert got == {n: max(k for k in (1, 8, 15) if k <= n) for n in range(1, 21)}
    assert not any("BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString() for df in made)


def test_closures_with_and_without_broadcasts(spark, monkeypatch):
    rnd = random.Random(2)
    edges = [(f"v{rnd.randrange(12)}", f"v{rnd.randrange(12)}") for _ in range(22)]
    roots = spark.createDataFrame([("v0",), ("v3",), ("v3",), ("elsewhere",)], "node string")
    df, wanted = spark.createDataFrame(edges, "source string, target string"), set()
    for root in ("v0", "v3", "elsewhere"):
        depth, front = {root: 0}, {root}
        for d in range(1, 4):
            front = {b for a, b in edges if a in front} - depth.keys()
            depth |= dict.fromkeys(front, d)
        wanted |= {(root, n, d) for n, d in depth.items()}
    for few in (G.FEW, 0):
        monkeypatch.setattr(G, "FEW", few)
        got = [tuple(r) for r in G.closure(df, roots, 3).collect()]
        assert len(got) == len(wanted) and set(got) == wanted
    least = {n: min(d for _, m, d in wanted if m == n) for _, n, _ in wanted}
    assert sorted(tuple(r) for r in G.least_depths(df, roots, 3).collect()) == sorted(least.items())


def test_statements_meet_facts_and_anchors_in_one_join(spark, monkeypatch):
    rnd, joins, join = random.Random(4), [], T.interval_join
    monkeypatch.setattr(T, "interval_join", lambda *a: joins.append(a) or join(*a))
    spans = {(o, a, a + rnd.choice([0, 3, 20]), rnd.random() < 0.2) for o in "xy" for a in rnd.sample(range(60), 12)}
    facts, anchors = ({(rnd.choice("xyz"), rnd.randrange(70)) for _ in range(15)} for _ in range(2))
    made = lambda rows, names: spark.createDataFrame(sorted(rows), names)
    points = "object string, line int"
    got = T.coverage_map(made(spans, "object string, start_line int, end_line int, is_container boolean"), made(facts, points), made(anchors, points)).collect()
    assert len(joins) == 1
    for r in got:
        wanted = dict.fromkeys(["Consistent", "SpecMissing", "ProseOnly", "OutOfScope"], 0)
        for o, a, b, c in spans:
            if o == r["object"]:
                f, n = (any(p == o and a <= line <= b for p, line in ps) for ps in (facts, anchors))
                wanted["OutOfScope" if c or not (f or n) else "Consistent" if f and n else "SpecMissing" if f else "ProseOnly"] += 1
        assert r.asDict() == {"object": r["object"], **wanted}


def test_texts_of_many_slices(spark):
    n = 2 * X.SLICE + 5
    docs = spark.range(n, numPartitions=1).selectExpr("id AS doc_id", "concat('a', id, ' b') AS text")
    values = spark.createDataFrame([("b",), ("a7",), (f"a{n - 1}",)], "literal string")
    got = X.occurrences(values, docs, "doc_id", True)
    assert {(r["doc_id"], r["literal"]) for r in got.collect()} == {(i, "b") for i in range(n)} | {(7, "a7"), (n - 1, f"a{n - 1}")}


def test_documents_are_files_in_folders(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(catalog_queries, "scratch_path", lambda spark: f"{tmp_path}/docs")
    spark.range(30).selectExpr("id AS doc_id", "concat('x', id, chr(10), 'y') AS text").write.parquet(f"{tmp_path}/documents.parquet")
    assert tuple(catalogue.queries()["src6_read_documents"](spark, str(tmp_path)).first()) == (30, 20 * 5 + 10 * 4)
    assert len(list(tmp_path.glob("docs/folder=*/*.txt"))) == 30


def odd_documents(spark, path):
    texts = [None, "", "   ", "\u00a0\u3000", "\t", "\n", " \n", "a\u0001", "\u0001", "\u0001\u0001\n", " é😀 ", "x\r\ny", "same", "same"]
    spark.createDataFrame([(None if i == 3 else i // 2, x) for i, x in enumerate(texts)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    return tables


def test_empty_documents_are_none(spark, tmp_path):
    tables = odd_documents(spark, tmp_path)
    same(catalogue.queries()["src6_read_documents"](spark, str(tmp_path)), tables, catalogue.oracle_sql()["src6_read_documents"])
