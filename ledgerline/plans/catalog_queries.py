"""Catalog operators over the driver's tables and their own columns; sources read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ledgerline.durable import scratch_path, written
from ledgerline.functions.checks import _CHECKS, register_check, run_check
from ledgerline.functions.expressions import base_name, canonical_key, classify_object_type
from ledgerline.operators import catalog as C
from ledgerline.plans.catalogue import query
from ledgerline.sources import files as S
from ledgerline.sources.generate import generate_linked

SMALL = ("region", "nation", "supplier")


@query("cat1_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in SMALL + ("orders",)))
def _(spark, t):
    return C.table_row_counts({n: t(n) for n in SMALL + ("orders",)})


@query("cat2_profile_small_tables", "WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS row_no, * FROM nation), r AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS row_no, * FROM region) SELECT 'nation' AS \"table\", row_no, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS col, unnest([CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)]) AS val FROM n UNION ALL SELECT 'region', row_no, unnest(['r_regionkey', 'r_name']), unnest([CAST(r_regionkey AS VARCHAR), r_name]) FROM r")
def _(spark, t):
    nation, region = t("nation").withColumn("n_nationkey", F.col("n_nationkey")), t("region")
    return C.profile_small_tables({"nation": nation, "region": region, "orders": t("orders")}, {"nation": [F.col("n_nationkey").cast("int")], "region": [F.col("r_regionkey").cast("int")], "orders": ["o_orderkey"]})


@query("cat3_to_string_cells", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS VARCHAR) AS p_size, CASE WHEN p_size > 20 THEN p_brand ELSE '' END AS brand FROM part")
def _(spark, t):
    return C.to_string_cells(t("part").select("p_partkey", "p_size", F.when(F.col("p_size") > 20, F.col("p_brand")).alias("brand")))


#: System tables derived from nation: a table for each region, a column for each nation.
def system(t):
    n = t("nation")
    of = n.select(F.col("n_regionkey").alias("object_id"), F.col("n_nationkey").alias("column_id"), F.col("n_name").alias("column_name"))
    kinds = of.select(*of.columns, (F.col("column_id") % 4).alias("type_id"), F.when(F.col("column_id") % 3 == 0, -1).otherwise(40).alias("max_length"), F.lit(19).alias("precision"), F.lit(4).alias("scale"), (F.col("column_id") % 2 == 0).alias("is_nullable"), (F.col("column_id") == 3).alias("is_identity"), F.lit(None).cast("string").alias("default_value"))
    types = n.where("n_nationkey < 4").select(F.col("n_nationkey").alias("type_id"), F.element_at(F.array(*map(F.lit, ("int", "nvarchar", "decimal", "varchar"))), F.col("n_nationkey").cast("int") + 1).alias("type_name"))
    tables = t("region").select(F.col("r_regionkey").alias("object_id"), F.col("r_name").alias("table"))
    return tables, kinds, types, of


TYPES = "CASE n_nationkey % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'nvarchar(' || CASE WHEN n_nationkey % 3 = 0 THEN 'MAX' ELSE '20' END || ')' WHEN 2 THEN 'decimal(19,4)' ELSE 'varchar(' || CASE WHEN n_nationkey % 3 = 0 THEN 'MAX' ELSE '40' END || ')' END"


@query("cat4_column_dictionary", f"SELECT r_name AS \"table\", n_nationkey AS column_id, n_name AS column_name, {TYPES} AS data_type, n_nationkey % 2 = 0 AS is_nullable, n_nationkey % 5 = 0 AS is_primary_key, n_nationkey % 7 = 0 AS is_foreign_key, n_nationkey = 3 AS is_identity, CASE WHEN n_nationkey % 6 = 0 THEN 'text' END AS description FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(spark, t):
    tables, columns, types, of = system(t)
    described = of.where("column_id % 6 = 0").select("object_id", "column_id", F.lit("text").alias("description"))
    return C.column_dictionary(tables, columns, types, of.where("column_id % 5 = 0"), of.where("column_id % 7 = 0"), described).drop("default_value")


@query("cat5_index_dictionary", "SELECT r_name AS \"table\", 'ix' || (n_nationkey % 2) AS index_name, 'CLUSTERED' AS index_type, n_nationkey % 2 = 0 AS is_unique, false AS is_primary_key, string_agg(n_name, ',' ORDER BY -n_nationkey) AS columns FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def _(spark, t):
    tables, columns, _, of = system(t)
    listed = of.select("object_id", (F.col("column_id") % 2).alias("index_id"), (-F.col("column_id")).alias("ordinal"), "column_id")
    indexes = listed.select("object_id", "index_id").distinct().select("*", F.concat(F.lit("ix"), "index_id").alias("index_name"), F.lit("CLUSTERED").alias("index_type"), (F.col("index_id") == 0).alias("is_unique"), F.lit(False).alias("is_primary_key"))
    return C.index_dictionary(tables, indexes, listed, columns).withColumn("columns", F.array_join("columns", ","))


@query("cat6_missing_descriptions", "SELECT p_brand AS \"table\", count(*) AS columns, count(*) FILTER (p_partkey % 3 <> 1) AS missing FROM part GROUP BY 1")
def _(spark, t):
    return C.missing_descriptions(t("part").select(F.col("p_brand").alias("table"), F.when(F.col("p_partkey") % 3 == 1, "x").when(F.col("p_partkey") % 3 == 2, " ").alias("description")))


@query("cat7_raw_dependencies", "SELECT DISTINCT s_name AS source, CASE WHEN s_suppkey % 4 = 1 THEN 'Other' END AS database, CASE WHEN s_suppkey % 3 = 0 THEN 'dbo' ELSE 'app' END AS schema, n_name AS name, CASE WHEN s_suppkey % 4 <> 1 AND s_suppkey % 3 = 0 AND n_nationkey % 2 = 0 THEN 'U' ELSE 'UNKNOWN' END AS type FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(spark, t):
    s = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    k = F.col("s_suppkey")
    refs = s.select(k.alias("object_id"), F.when(k % 4 == 1, "Other").when(k % 4 == 2, "MAIN").alias("ref_database"), F.when(k % 3 != 0, "app").alias("ref_schema"), F.col("n_name").alias("ref_name"))
    # a reference without a database is the own database's
    refs = refs.withColumn("ref_database", F.coalesce("ref_database", F.lit("main")))
    targets = t("nation").where("n_nationkey % 2 = 0").select(F.lit("DBO").alias("schema"), F.lower("n_name").alias("name"), F.lit("U").alias("type"))
    return C.raw_dependencies(refs, t("supplier").select(k.alias("object_id"), F.col("s_name").alias("source")), targets, "main")


@query("cat8_column_type_map", "WITH c AS (SELECT lower(p_brand) AS c, CASE WHEN p_size % 50 = 0 THEN 'int' ELSE lower(left(p_brand, 3)) END AS d FROM part) SELECT c AS \"column\", CASE WHEN count(DISTINCT d) = 1 THEN min(d) END AS data_type, count(DISTINCT d) AS types, count(DISTINCT d) > 1 AS ambiguous FROM c GROUP BY 1")
def _(spark, t):
    return C.column_type_map(t("part").select(F.col("p_brand").alias("column_name"), F.when(F.col("p_size") % 50 == 0, "INT").otherwise(F.left("p_brand", F.lit(3))).alias("data_type")))


@query("cat9_relevant_columns", "WITH c AS (SELECT n_regionkey AS t, n_nationkey AS k, n_name, n_regionkey > 0 AND (n_nationkey % 5 = 0 OR n_nationkey % 7 = 0 OR n_nationkey % 6 = 1) AS kept FROM nation), s AS (SELECT t, max(kept) AS any_kept FROM c GROUP BY 1) SELECT CAST(t AS VARCHAR) AS \"table\", n_name AS column_name FROM c JOIN s USING (t) WHERE kept OR NOT any_kept")
def _(spark, t):
    n = t("nation").select(F.col("n_regionkey").cast("string").alias("table"), F.col("n_name").alias("column_name"), (F.col("n_nationkey") % 5 == 0).alias("is_primary_key"), F.lit(False).alias("is_foreign_key"), F.col("n_nationkey").alias("k"), (F.col("n_regionkey") > 0).alias("on"))
    columns = n.withColumn("is_primary_key", F.col("is_primary_key") & F.col("on"))
    indexes = n.where("on AND k % 7 = 0").select("table", F.array(F.lower("column_name")).alias("columns"))
    return C.select_relevant_columns(columns.drop("k", "on"), n.where("on AND k % 6 = 1").select("table", "column_name"), indexes, n.where("k < 0").select("table", "column_name")).select("table", "column_name")


@query("cat10_orphaned_references", "SELECT 'dbo.[' || c_name || ']' AS reference, 'app.' || lower(c_name) AS looks_like FROM customer WHERE c_custkey % 3 = 0")
def _(spark, t):
    c = t("customer")
    return C.orphaned_references(c.select(F.concat(F.lit("dbo.["), "c_name", F.lit("]")).alias("name")), c.where("c_custkey % 3 = 0").select(F.concat(F.lit("app."), F.lower("c_name")).alias("name")))


@query("cat11_schema_catalog", "SELECT min(n) AS name FROM (SELECT c_name AS n FROM customer UNION ALL SELECT lower(c_name) FROM customer WHERE c_custkey % 2 = 0) GROUP BY lower(n)")
def _(spark, t):
    c = t("customer")
    return C.schema_catalog(c.select(F.col("c_name").alias("name")), c.where("c_custkey % 2 = 0").select(F.lower("c_name").alias("name")))


@query("cat12_13_object_names", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Procedure' WHEN 1 THEN 'Table' WHEN 2 THEN 'View' ELSE 'Unknown' END AS kind, 'db.' || lower(replace(replace(p_brand, '%', '%25'), '.', '%2E')) || '.' || lower(p_name) || '.P' AS key, 'x' AS base FROM (SELECT *  REPLACE (replace(replace(p_name, '%', '%25'), '.', '%2E') AS p_name) FROM part)")
def _(spark, t):
    kind = F.element_at(F.array(*map(F.lit, (" P ", "user_table", "V", "zz"))), (F.col("p_size") % 4 + 1).cast("int"))
    return t("part").select("p_partkey", classify_object_type(kind).alias("kind"), canonical_key(F.lit("DB"), F.col("p_brand"), F.col("p_name"), F.lit("P")).alias("key"), base_name(F.lit("dbo.[x]")).alias("base"))


@query(
    "cat14_map_by_name",
    """WITH l AS (SELECT c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'FRANCE' END AS hint, lower(n_name) || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_proc' ELSE '7' END AS doc FROM customer JOIN nation ON n_nationkey = c_nationkey),
    d AS (SELECT doc, max(hint) AS hint FROM l GROUP BY 1), t AS (SELECT n_name AS target FROM nation),
    m AS (SELECT doc AS name, target, CASE WHEN lower(hint) = lower(target) THEN 0 WHEN doc = lower(target) THEN 1 ELSE 1000 - length(target) END AS rank FROM d, t WHERE lower(hint) = lower(target) OR doc = lower(target) OR (starts_with(doc, lower(target)) AND NOT regexp_matches(substr(doc, length(target) + 1, 1), '^[0-9]')))
    SELECT name, arg_min(target, (rank, target)) AS target, CASE min(rank) WHEN 0 THEN 'hint' WHEN 1 THEN 'exact' ELSE 'prefix' END AS how FROM m GROUP BY 1""",
)
def _(spark, t):
    c = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    tail = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "_proc").otherwise("7")
    docs = c.groupBy(F.concat(F.lower("n_name"), tail).alias("name")).agg(F.max(F.when(F.col("c_custkey") % 5 == 0, "FRANCE")).alias("hint"))
    return C.map_by_name(docs, t("nation").select(F.col("n_name").alias("target")))


@query("cat15_snapshot_range", "SELECT 'orders' AS \"table\", count(*) AS rows, count(*) FILTER (strftime(o_orderdate, '%Y') <> '1995') AS outside FROM orders UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (strftime(l_shipdate, '%Y') <> '1995') FROM lineitem")
def _(spark, t):
    return C.snapshot_range_check({"orders": t("orders").withColumn("ymd", F.date_format("o_orderdate", "yyyy")), "lineitem": t("lineitem").withColumn("ymd", F.date_format("l_shipdate", "yyyy"))}, "1995")


@query("src1_read_table", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, t):
    path = scratch_path(spark)
    t("orders").write.parquet(f"{path}/orders.parquet")
    return S.read_table(spark, path, "orders").select("o_orderkey", "o_custkey")


@query("src3_execution_results", "SELECT 'p' AS proc, CAST(n_regionkey AS VARCHAR) AS case_id, CASE WHEN n_regionkey = 3 THEN 'FAIL' ELSE 'SUCCESS' END AS status, 0 AS set_no, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS row_no, 'name' AS col, n_name AS val FROM nation")
def _(spark, t):
    rows = t("nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.create_map(F.lit("name"), x["n_name"])).alias("rows"))
    case = F.struct(F.col("n_regionkey").cast("string").alias("CaseId"), F.when(F.col("n_regionkey") == 3, "FAIL").otherwise("SUCCESS").alias("Status"), F.array("rows").alias("ResultSets"))
    path = scratch_path(spark)
    rows.select(F.lit("p").alias("ProcedureName"), F.array(case).alias("ExecutionResults")).repartition("ExecutionResults").write.option("maxRecordsPerFile", 1).json(path)
    return S.read_execution_results(spark, path).drop("error_code")


def snapshot(spark, t):
    column = F.struct(F.col("n_name").alias("Name"), F.lit("int").alias("DataType"), (F.col("n_nationkey") % 2 == 0).alias("IsNullable"))
    by = t("nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(column)).alias("Columns"))
    o = t("region").join(by, F.col("r_regionkey") == F.col("n_regionkey"))
    body = F.struct(F.lit("db").alias("Database"), F.lit("dbo").alias("Schema"), F.col("r_name").alias("Name"), F.lit("P").alias("Type"), F.when(F.col("r_regionkey") != 2, F.concat(F.lit("create "), "r_name")).alias("Ddl"), "Columns", F.array(F.struct(F.lit("dbo.x").alias("Key"), F.lit("U").alias("Type"))).alias("Dependencies"))
    path = scratch_path(spark)
    o.select(F.create_map(F.col("r_name"), body).alias("Objects")).repartition(1).write.option("maxRecordsPerFile", 1).json(path)
    return S.read_catalog_snapshot(spark, path)


@query("src4_catalog_snapshot", "SELECT r_name AS object_key, n_name AS column_name, n_nationkey % 2 = 0 AS is_nullable FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(spark, t):
    return snapshot(spark, t)["columns"].select("object_key", "column_name", "is_nullable")


@query("src5_snapshot_export", "SELECT r_name AS source_key, 'dbo.x' AS target_key FROM region WHERE r_regionkey <> 2")
def _(spark, t):
    path = scratch_path(spark)
    S.write_catalog_snapshot(snapshot(spark, t), path)
    return spark.read.parquet(f"{path}/edges").select("source_key", "target_key")


#: Files that a driver lists at a time: a few hundred MB of its memory.
LOT = 128_000


@query("src6_read_documents", "SELECT count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents WHERE trim(text) <> ''")
def _(spark, t):
    """A file for each document, read in lots of folders, so that the driver lists the files of one lot at a time."""
    path, docs = scratch_path(spark), t("documents")
    lots = max(1, -(-docs.count() // LOT))
    key = F.xxhash64("doc_id", "text")
    S.write_documents(docs.select("doc_id", "text", F.concat_ws("-", F.pmod(key, F.lit(lots)), F.pmod(F.shiftright(key, 20), F.lit(256))).alias("folder")), path)
    found = []
    for lot in range(lots):
        spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/folder={lot}-0"))
        files = S.read_documents(spark, f"{path}/folder={lot}-*", "\u0001").coalesce(8 * spark.sparkContext.defaultParallelism)
        found.append(written(files.agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))))
    return reduce(lambda a, b: a.unionByName(b), found).agg(F.sum("documents").alias("documents"), F.sum("characters").alias("characters"))


@query("src7_read_log", "WITH r AS (SELECT conv_id % 20 AS run, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id, turn) - 1 AS n, regexp_replace(text, '\\s+', ' ', 'g') AS line FROM conversations) SELECT CAST(run AS VARCHAR) AS run_id, CAST(n AS INTEGER) AS line_no, line FROM r WHERE line <> ''")
def _(spark, t):
    """All conversations as the lines of twenty logs."""
    path = scratch_path(spark)
    rows = t("conversations").select(F.regexp_replace("text", r"\s+", " ").alias("text"), (F.col("conv_id") % 20).alias("run"), "conv_id", "turn")
    rows.repartition("run").sortWithinPartitions("run", "conv_id", "turn").select("run", "text").write.partitionBy("run").text(path)
    return S.read_log(spark, path, "run=([^/]+)/").where("line <> ''")


@query("src8_append_firings", "SELECT event_type AS check_key, count(*) AS n FROM events GROUP BY 1")
def _(spark, t):
    path = scratch_path(spark)
    for half in (0, 1):
        S.append_firings(t("events").where(f"event_id % 2 = {half}").select(F.col("event_type").alias("check_key")), path)
    return spark.read.parquet(path).groupBy("check_key").agg(F.count("*").alias("n"))


@query("src9_dependency_manifest", "SELECT c_name AS key, sha256(CASE WHEN c_custkey % 5 = 1 THEN '' ELSE c_name END) AS ddl_sha256, coalesce(string_agg('o' || o_orderkey, ',' ORDER BY 'o' || o_orderkey), '') AS targets FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name, c_custkey")
def _(spark, t):
    nodes = t("customer").select(F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 5 != 1, F.col("c_name")).alias("ddl"))
    edges = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("source_key"), F.concat(F.lit("o"), "o_orderkey").alias("target_key"))
    return S.dependency_manifest(nodes, edges).withColumn("targets", F.array_join("targets", ","))


@query("src10_seed_tables", "SELECT c_nationkey AS nation, count(DISTINCT o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, t):
    """What is read from the seeded tables before they are cleared."""
    path = scratch_path(spark)
    order = S.seed_tables({"customer": t("customer"), "orders": t("orders")}, path)
    seeded = lambda name: spark.read.parquet(f"{path}/{name}")
    joined = seeded("customer").join(seeded("orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    kept = written(joined.groupBy(F.col("c_nationkey").alias("nation")).agg(F.countDistinct("o_orderkey").alias("orders"), F.countDistinct("c_custkey").alias("customers")))
    S.clear_tables(spark, order, path)
    return kept


@query("src11_12_replace_and_restore", "SELECT o_orderstatus AS ymd, count(*) AS n FROM orders GROUP BY 1")
def _(spark, t):
    path, shadow = scratch_path(spark), scratch_path(spark)
    rows = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("ymd"))
    S.replace_partition(rows, path)
    S.replace_partition(rows.where("ymd = 'F'"), path)  # the same day again changes nothing
    S.capture_shadow(spark.read.parquet(path).where("ymd = 'P'"), shadow, 1, "S01")
    S.replace_partition(rows.where("ymd = 'P'").limit(1), path)
    S.restore_shadow(spark, shadow, 1, "S01", path)
    return spark.read.parquet(path).groupBy("ymd").agg(F.count("*").alias("n"))


@query("udf1_user_check", "SELECT o_orderkey AS run_id, 'S01' AS step_code, 'PRICE' AS issue_code, 'Error' AS severity, '400000' AS expected_value, CAST(o_custkey AS VARCHAR) AS actual_value FROM orders WHERE o_totalprice > 400000")
def _(spark, t):
    if "PRICE" not in _CHECKS:
        register_check("PRICE", "Error", lambda df: df.where("o_totalprice > 400000").select(F.col("o_orderkey").alias("run_id"), F.lit("S01").alias("step_code"), F.lit("400000").alias("expected_value"), F.col("o_custkey").alias("actual_value")))
    return run_check("PRICE", t("orders")).drop("detected_at")


@query("gen1_generate_linked", "SELECT count(*) AS rows, count(*) AS linked FROM orders")
def _(spark, t):
    n = t("orders").count()
    made = generate_linked(spark, {"parent": {"id": "key", "kind": "choice:a|b"}, "child": {"id": "key", "parent_id": "ref:parent", "amount": "amount", "ymd": "ymd"}}, {"parent": max(1, n // 10), "child": n}, 7)
    linked = made["child"].join(made["parent"].select(F.col("id").alias("parent_id")), "parent_id")
    return made["child"].agg(F.count("*").alias("rows")).crossJoin(linked.agg(F.count("*").alias("linked")))
