"""Graphs over orders, parts, suppliers and nations; spans over events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ledgerline.durable import written
from ledgerline.operators import graph as G
from ledgerline.operators.scans import numbered
from ledgerline.plans.catalogue import query

#: customer -> nation -> region, supplier -> nation, part -> supplier by lineitem.
EDGES = """edges AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
  UNION SELECT 'r' || r_regionkey, 'p' || (r_regionkey * 10 + 1) FROM region)"""


def edges(t):
    e = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"))
    parts = [
        e(t("customer"), "c", "c_custkey", "n", "c_nationkey"), e(t("nation"), "n", "n_nationkey", "r", "n_regionkey"), e(t("supplier"), "s", "s_suppkey", "n", "s_nationkey"),
        e(t("lineitem"), "p", "l_partkey", "s", "l_suppkey"), e(t("region"), "r", "r_regionkey", "p", F.col("r_regionkey") * 10 + 1),
    ]
    return reduce(lambda a, b: a.union(b), parts).distinct()


CLOSURE = "WITH RECURSIVE " + EDGES + ", c(root, node, depth) AS (SELECT 'p' || p_partkey, 'p' || p_partkey, 0 FROM part UNION SELECT root, target, depth + 1 FROM c JOIN edges ON source = node WHERE depth < 4), m AS (SELECT root, node, min(depth) AS depth FROM c GROUP BY 1, 2)"


def closed(t):
    return G.closure(edges(t), t("part").select(F.concat(F.lit("p"), "p_partkey").alias("node")), 4)


@query("gra1_closure", CLOSURE + " SELECT root, node, depth FROM m")
def _(spark, t):
    return closed(t)


@query("gra2_node_status", CLOSURE + ", d AS (SELECT node, min(depth) AS depth FROM m GROUP BY 1), n AS (SELECT DISTINCT target AS node FROM edges) SELECT n.node, CASE WHEN depth IS NULL OR depth > 3 THEN 'SkippedDepth' WHEN n.node LIKE 'r%' OR n.node LIKE 'n1%' THEN 'SkippedExternal' ELSE 'Queued' END AS status FROM n LEFT JOIN d ON d.node = n.node")
def _(spark, t):
    calls = written(edges(t))
    nodes = calls.select(F.col("target").alias("node")).distinct()
    nodes = nodes.select("node", F.when(F.col("node").startswith("n1"), "Other").otherwise("own").alias("database"), F.when(F.col("node").startswith("r"), "UNKNOWN").otherwise("Procedure").alias("type"))
    return G.node_status(G.least_depths(calls, t("part").select(F.concat(F.lit("p"), "p_partkey").alias("node")), 4), nodes, "Own", 3)


@query(
    "gra3_execution_levels",
    "WITH y AS (SELECT a.c_custkey AS k, b.c_custkey AS l FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 7 = 0), z AS (SELECT k FROM y UNION SELECT l FROM y) SELECT 'r' || r_regionkey AS node, 0 AS level, false AS in_cycle FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'n' || n_nationkey, 1, false FROM nation UNION ALL SELECT 's' || s_suppkey, 2, false FROM supplier UNION ALL SELECT DISTINCT 'p' || l_partkey, 3, false FROM lineitem UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey IN (FROM z) THEN 4 ELSE 2 END, c_custkey IN (FROM z) FROM customer",
)
def _(spark, t):
    """All edges but those that lead from regions to parts; customers of every seventh key and the next call each other."""
    c = lambda x: F.concat(F.lit("c"), x)
    key = t("customer").select("c_custkey")
    pairs = key.where("c_custkey % 7 = 0").join(key.select((F.col("c_custkey") - 1).alias("c_custkey")), "c_custkey").select(c(F.col("c_custkey")).alias("source"), c(F.col("c_custkey") + 1).alias("target"))
    both = pairs.union(pairs.select("target", "source"))
    return G.execution_levels(edges(t).where("substring(source, 1, 1) <> 'r'").union(both))


@query("gra4_distinct_edges", "SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem")
def _(spark, t):
    return G.distinct_edges(t("lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")))


@query("gra5_call_graph", "SELECT l_suppkey AS source, string_agg(DISTINCT 'p' || l_partkey, ',' ORDER BY 'p' || l_partkey) AS targets FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1")
def _(spark, t):
    d = t("lineitem").select(F.col("l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.when(F.col("l_partkey") % 4 == 0, "Table").otherwise("Procedure").alias("type"))
    return G.call_graph(d).withColumn("targets", F.array_join("targets", ","))


@query(
    "gra6_draft_stages",
    """WITH w AS (SELECT DISTINCT 'p' || s_nationkey AS procedure, 't' || (s_suppkey % 60) AS tab FROM supplier), r AS (SELECT DISTINCT 'p' || (c_nationkey + 5) AS procedure, 't' || (c_custkey % 200) AS tab FROM customer),
    k AS (SELECT DISTINCT 'p' || n_nationkey AS a, 'p' || (n_regionkey + 27) AS b FROM nation WHERE n_nationkey % 2 = 0), h AS (SELECT tab FROM w GROUP BY 1 HAVING count(*) >= 3),
    p AS (SELECT DISTINCT w.procedure FROM w JOIN r ON r.tab = w.tab AND r.procedure <> w.procedure WHERE w.tab NOT IN (FROM h)), g AS (SELECT a AS procedure FROM k UNION SELECT b FROM k),
    e AS (SELECT procedure FROM w UNION SELECT procedure FROM r UNION FROM g)
    SELECT procedure, CASE WHEN procedure IN (FROM p) THEN 'producer' WHEN procedure IN (FROM g) THEN 'call group' ELSE 'unknown' END AS stage FROM e""",
)
def _(spark, t):
    name = lambda x: F.concat(F.lit("p"), x)
    w = t("supplier").select(name(F.col("s_nationkey")).alias("procedure"), F.concat(F.lit("T"), F.col("s_suppkey") % 60).alias("table"))
    r = t("customer").select(name(F.col("c_nationkey") + 5).alias("procedure"), F.concat(F.lit("t"), F.col("c_custkey") % 200).alias("table"))
    k = t("nation").where("n_nationkey % 2 = 0").select(name(F.col("n_nationkey")).alias("caller"), name(F.col("n_regionkey") + 27).alias("callee"))
    return G.draft_stages(w, r, k)


@query(
    "gra7_split_spans",
    """WITH b AS (SELECT l_orderkey AS caller, min(l_linenumber) FILTER (l_returnflag = 'R') AS a, max(l_linenumber) FILTER (l_returnflag = 'A') AS z, count(*) FILTER (l_returnflag = 'R') AS nb, count(*) FILTER (l_returnflag = 'A') AS nc FROM lineitem GROUP BY 1),
    s AS (SELECT o_orderkey AS procedure, o_orderpriority AS step FROM orders), o AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    SELECT b.caller, l_partkey AS callee, l_linenumber AS line, x.step AS caller_step, y.step AS callee_step FROM lineitem JOIN b ON b.caller = l_orderkey JOIN s x ON x.procedure = b.caller JOIN s y ON y.procedure = l_partkey
    WHERE l_returnflag = 'N' AND nb = 1 AND nc = 1 AND l_linenumber BETWEEN a AND z AND x.step <> y.step AND l_partkey NOT IN (FROM o)""",
)
def _(spark, t):
    l = t("lineitem")  # noqa: E741
    boundaries = l.where("l_returnflag IN ('R', 'A')").select(F.col("l_orderkey").alias("caller"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", "begin").otherwise("commit").alias("kind"))
    calls = l.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("caller"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("callee"))
    return G.split_spans(boundaries, calls, t("orders").select(F.col("o_orderkey").alias("procedure"), F.col("o_orderpriority").alias("step")), t("orders").select(F.col("o_orderkey").alias("procedure")))


@query(
    "gra8_components",
    "WITH RECURSIVE p AS (SELECT DISTINCT c_custkey AS a, c_custkey + 1 + c_nationkey % 3 AS b FROM customer WHERE c_nationkey % 2 = 0), e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), r(node, other) AS (SELECT x, x FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.other) SELECT node, min(other) AS component FROM r GROUP BY 1",
)
def _(spark, t):
    c = t("customer").where("c_nationkey % 2 = 0")
    return G.components(c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1 + F.col("c_nationkey") % 3).alias("b")))


@query("gra9_inherit_once", "WITH b AS (SELECT DISTINCT 'v' || s_nationkey AS variable, s_name AS col FROM supplier), f AS (SELECT DISTINCT 'v' || c_nationkey AS s, 'v' || (100 + c_custkey % 50) AS t FROM customer) SELECT variable, col AS \"column\" FROM b UNION SELECT t, col FROM f JOIN b ON s = variable")
def _(spark, t):
    v = lambda x: F.concat(F.lit("v"), x)
    feeds = t("customer").select(v("c_nationkey").alias("source"), v(F.col("c_custkey") % 50 + 100).alias("target")).distinct()
    return G.inherit_once(t("supplier").select(v("s_nationkey").alias("variable"), F.col("s_name").alias("column")), feeds)


@query("gra10_unresolved", "SELECT DISTINCT l_orderkey AS source, l_suppkey AS target FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 IN (0, 1))")
def _(spark, t):
    status = F.when(F.col("s_suppkey") % 9 == 0, "Queued").when(F.col("s_suppkey") % 9 == 1, "Cancelled").otherwise("Succeeded")
    return G.unresolved(t("lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target")), t("supplier").select(F.col("s_suppkey").alias("node"), status.alias("status")))


@query(
    "gra3_callers_of_cycles",
    "WITH RECURSIVE " + EDGES + """, x AS (SELECT * FROM edges WHERE source NOT LIKE 'c%' UNION ALL SELECT 'o' || o_orderkey, 'p' || l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    k AS (SELECT source, target FROM x WHERE source NOT LIKE 'o%'), reach(a, b) AS (SELECT source, target FROM k UNION SELECT a, target FROM reach JOIN k ON b = source),
    mutual AS (SELECT r.a, r.b FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a), c AS (SELECT a AS node, min(b) AS name FROM mutual GROUP BY 1),
    bottom AS (SELECT name FROM c EXCEPT SELECT c.name FROM c JOIN k ON source = node JOIN c d ON d.node = target WHERE d.name <> c.name),
    lev(node, level) AS (SELECT node, 0 FROM c WHERE name IN (FROM bottom) UNION SELECT source, level + 1 FROM lev JOIN x ON target = node WHERE source NOT IN (SELECT node FROM c))
    SELECT node, CAST(max(level) AS INTEGER) AS level, node IN (SELECT node FROM c) AS in_cycle FROM lev GROUP BY 1""",
)
def _(spark, t):
    """Regions call parts, these suppliers, these nations, and these regions: one cycle, as all regions are reached from
    each other. Parts that no region calls and orders only call it."""
    o = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("o"), "o_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    return G.execution_levels(edges(t).where("substring(source, 1, 1) <> 'c'").union(o.distinct()))


@query(
    "gra11_close_entry_points",
    "WITH c AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS k FROM customer WHERE c_nationkey < 18), e AS (SELECT 'N' || n_nationkey AS name, n_nationkey AS a, -1 AS b, false AS added FROM nation WHERE n_nationkey < 18 UNION ALL SELECT 'c' || c_custkey, c_nationkey, c_custkey, true FROM c WHERE k <= 18) SELECT name, CAST(row_number() OVER (ORDER BY a, b) AS INTEGER) AS position, added, (SELECT count(*) > 18 FROM c) AS cap_exceeded FROM e",
)
def _(spark, t):
    """Each nation calls its first customer, and each customer the next one of its nation, so that chains are as long as
    nations are large; of 18 entry points at most 18 procedures are added."""
    own = t("customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("keys"))
    names = F.concat(F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))), F.transform("keys", lambda k: F.concat(F.lit("c"), k.cast("string"))))
    calls = own.select(F.explode(F.arrays_zip(F.slice(names, F.lit(1), F.size("keys")).alias("source"), F.slice(names, F.lit(2), F.size("keys")).alias("target"))).alias("e")).select("e.source", "e.target", F.lit(0).alias("sibling"))
    return G.close_entry_points(t("nation").where("n_nationkey < 18").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").alias("position")), calls)


@query(
    "gra11_reorder_by_closure",
    "WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank FROM customer WHERE c_nationkey >= 5), i AS (SELECT o_orderkey, rank FROM orders LEFT JOIN c ON c_custkey = o_custkey), a AS (SELECT *, last_value(rank IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS anchor FROM i), h AS (SELECT rank AS anchor, min(o_orderkey) AS head FROM i GROUP BY 1) SELECT o_orderkey AS item, row_number() OVER (ORDER BY coalesce(anchor, -1), CASE WHEN rank IS NULL THEN 2 WHEN o_orderkey = head THEN 1 ELSE 3 END, o_orderkey) AS place FROM a LEFT JOIN h USING (anchor)",
)
def _(spark, t):
    """Orders in the order of their customers' balances; those of some nations' customers stay behind their neighbours."""
    ranked = numbered(t("customer").where("c_nationkey >= 5").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], "position")
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("name")
    return G.reorder_by_closure(t("orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("position"), name("o_custkey")), ranked.select(name("c_custkey"), "position"))


@query("gra12_upstream_first", "SELECT DISTINCT o_orderkey AS item, s_suppkey * 1000000 AS depends_on FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 10 = 5")
def _(spark, t):
    reads = t("lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("table"))
    pending = t("supplier").where("s_suppkey % 10 = 5").select((F.col("s_suppkey") * 1000000).alias("item"), F.col("s_suppkey").alias("table"))
    return G.upstream_first(reads, pending.unionByName(t("orders").select(F.col("o_orderkey").alias("item"), (-F.col("o_orderkey") - 1).alias("table"))))
