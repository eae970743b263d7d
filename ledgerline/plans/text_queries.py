"""Text operators over documents: their lines, with Markdown put around them, and what they mention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import text as T
from ledgerline.plans.catalogue import query

#: Markdown around each document's ids and text: two sections, a fence, a table. The text stands as a quotation.
MARKDOWN = (
    "# Rules", "intro {id}", "{text}", "## 1. Steps:", "step {id}", "```sql", "# not a heading", "-- the rest likewise", "select {id} from dbo.[T{mod}] join app.u", "```",
    "## Table (line 12)", "| Code | Line |", "|---|---|", "| C{mod} | {id} |", "| a \\| b | L7 |", "end",
)
#: Documents with the number of lines of their texts.
QUOTED = "q AS (SELECT doc_id, len(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS n FROM documents)"


def pages(t):
    quoted = F.concat(F.lit("> "), F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\n", "\n> "))
    line = lambda s: quoted if s == "{text}" else F.replace(F.replace(F.lit(s), F.lit("{id}"), F.col("doc_id").cast("string")), F.lit("{mod}"), (F.col("doc_id") % 5).cast("string"))
    return t("documents").select("doc_id", F.array_join(F.array(*map(line, MARKDOWN)), "\n").alias("text"))


@query("txt1_markdown_lines", f"WITH {QUOTED} SELECT doc_id, CAST(k - 1 + CASE WHEN k > 2 THEN n ELSE 0 END AS INTEGER) AS line_no, k IN (5, 9) AS is_fence, k BETWEEN 6 AND 8 AS in_fence, CASE WHEN k < 3 THEN '# Rules' WHEN k < 10 THEN '## 1. Steps:' ELSE '## Table (line 12)' END AS heading FROM q, range(1, 16) r(k) UNION ALL SELECT doc_id, CAST(unnest(range(2, 2 + n)) AS INTEGER), false, false, '# Rules' FROM q")
def _(spark, t):
    return T.markdown_lines(pages(t)).drop("line")


@query("txt1_document_lines", "SELECT doc_id, len(string_split(regexp_replace(replace(text, '. ', '.' || chr(13)), '\\r\\n?', chr(10), 'g'), chr(10))) AS lines, 'z' AS heading FROM documents")
def _(spark, t):
    """Whole texts with a carriage return after each sentence, and a heading below an unclosed fence at the end."""
    texts = t("documents").select("doc_id", F.concat(F.replace("text", F.lit(". "), F.lit(".\r")), F.lit("\r\n# z\r~~~")).alias("text"))
    return T.markdown_lines(texts).groupBy("doc_id").agg((F.count("*") - 2).alias("lines"), F.max_by("heading", "line_no").alias("heading")).withColumn("heading", F.replace("heading", F.lit("# "), F.lit("")))


@query("txt2_section_body", "SELECT doc_id, 'Steps' AS wanted, '## 1. Steps:' AS heading, 'step ' || doc_id || chr(10) || '```sql' || chr(10) || '# not a heading' || chr(10) || '-- the rest likewise' || chr(10) || 'select ' || doc_id || ' from dbo.[T' || (doc_id % 5) || '] join app.u' || chr(10) || '```' AS body FROM documents")
def _(spark, t):
    return T.section_body(pages(t), t("documents").select("doc_id", F.lit("Steps").alias("wanted")))


@query("txt3_section_defects", "SELECT doc_id, 'missing' AS defect, 'Ends' AS section FROM documents UNION ALL SELECT doc_id, 'out of order', 'Rules' FROM documents")
def _(spark, t):
    return T.section_defects(pages(t), ["Steps", "Ends", "Rules"])


@query("txt4_table_rows", f"WITH {QUOTED} SELECT doc_id, 0 AS table_no, CAST(12 + n AS INTEGER) AS line_no, 'C' || (doc_id % 5) AS code, CAST(doc_id AS VARCHAR) AS line FROM q UNION ALL SELECT doc_id, 0, CAST(13 + n AS INTEGER), 'a | b', 'L7' FROM q")
def _(spark, t):
    return T.markdown_table_rows(pages(t)).select("doc_id", "table_no", "line_no", F.col("cells")["Code"].alias("code"), F.col("cells")["Line"].alias("line"))


@query("txt5_attribution_defects", "SELECT CASE WHEN doc_id % 7 = 0 THEN 'X-' ELSE 'R-' END || doc_id AS rule_id, CASE WHEN doc_id % 7 = 0 THEN 'id prefix' WHEN doc_id % 7 = 1 THEN 'missing' WHEN doc_id % 7 = 2 THEN 'heading not found' WHEN doc_id % 7 = 3 THEN 'quote not found' END AS defect FROM documents WHERE doc_id % 7 < 4")
def _(spark, t):
    m, i = F.col("doc_id") % 7, F.col("doc_id").cast("string")
    claims = t("documents").select(F.concat(F.when(m == 0, "X-").otherwise("R-"), i).alias("rule_id"), i.alias("evidence_label"), F.when(m == 1, "").when(m == 2, "Nowhere").otherwise("steps").alias("evidence_heading"), F.when(m == 3, "not there").otherwise(F.concat(F.lit("*step*  "), i)).alias("evidence_quote"))
    return T.attribution_defects(claims.withColumn("evidence_heading", F.when(F.col("evidence_heading") == "steps", "Steps").otherwise(F.col("evidence_heading"))), pages(t), (), "R-")


@query("txt5_quoted_in", r"WITH b AS (SELECT item_id, regexp_replace(text, '[\s*`|_~]+', '', 'g') AS quote FROM benchmark), d AS (SELECT doc_id, regexp_replace(text, '[\s*`|_~]+', '', 'g') AS text FROM documents) SELECT DISTINCT item_id, doc_id FROM b JOIN d ON contains(d.text, b.quote) WHERE quote <> ''")
def _(spark, t):
    return T.find_quotes(t("benchmark").select("item_id", F.col("text").alias("quote")), t("documents").select("doc_id", "text"))


#: Values that hold no ASCII letter or digit, or only some.
ODD_VALUES = ("미정산", "-", "'-'", "정산", "§ 7", "NONE")


def literals(t):
    """The first words of all documents with the document's language as column, and some odd values, by source."""
    first = t("documents").select(F.concat(F.lit("p"), "source").alias("label"), F.col("lang").alias("column"), F.regexp_substr("text", F.lit(r"^[^\x20\x09-\x0D]+")).alias("value")).where("value IS NOT NULL").distinct()
    return first.unionByName(first.select(F.lit("q").alias("label"), F.lit("kind").alias("column"), F.explode(F.array(*map(F.lit, ODD_VALUES))).alias("value")).distinct())


@query(
    "txt6_build_codebook",
    r"""WITH d AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' 상태 ''미정산'' (-) x-' WHEN 1 THEN ' a미정산b 미정산_ § 7,' ELSE '' END AS text FROM documents),
    f AS (SELECT DISTINCT 'p' || source AS label, lang AS "column", nullif(regexp_extract(text, '^[^\x20\x09-\x0D]+'), '') AS value FROM documents),
    l AS (SELECT * FROM f WHERE value IS NOT NULL UNION ALL SELECT 'q', 'kind', unnest(['미정산', '-', chr(39) || '-' || chr(39), '정산', '§ 7', 'NONE'])),
    w AS (SELECT value, arg_min("column", (label, "column")) AS "column", string_agg(DISTINCT label, ',' ORDER BY label) AS procedures FROM l GROUP BY 1),
    h AS (SELECT value, count(*) AS n FROM w, d WHERE contains(text, value) AND regexp_matches(text, '(^|[^A-Za-z0-9_])' || regexp_escape(value) || '($|[^A-Za-z0-9_])') GROUP BY 1)
    SELECT value, "column", procedures, coalesce(n, 0) AS documents, length(value) >= 3 AS match_eligible, n IS NOT NULL AS listed FROM w LEFT JOIN h USING (value)""",
)
def _(spark, t):
    """Whole texts; some end with values in Hangul, in quotes, or between letters."""
    m = F.col("doc_id") % 4
    end = F.when(m == 0, " 상태 '미정산' (-) x-").when(m == 1, " a미정산b 미정산_ § 7,").otherwise("")
    return T.build_codebook(literals(t), t("documents").select("doc_id", F.concat("text", end).alias("text"))).withColumn("procedures", F.array_join("procedures", ","))


@query("txt7_match_codebook", "SELECT n_name AS value, 'nation' AS \"table\", n_nationkey AS row_no FROM nation UNION ALL SELECT r_name, 'region', r_regionkey FROM region")
def _(spark, t):
    cells = lambda n, k, c: t(n).select(F.lit(n).alias("table"), F.col(k).alias("row_no"), F.lit(c).alias("col"), F.lower(c).alias("val"))
    profiled = cells("nation", "n_nationkey", "n_name").unionByName(cells("region", "r_regionkey", "r_name"))
    book = lambda n, c, column: t(n).select(F.col(c).alias("value"), F.lit(column).cast("string").alias("column"), F.lit(True).alias("match_eligible"))
    return T.match_codebook(book("nation", "n_name", "N_NAME").unionByName(book("region", "r_name", None)), profiled)


@query("txt8_unknown_codes", "SELECT doc_id AS rule_id, lang AS code FROM documents WHERE lang <> 'en' UNION SELECT doc_id, 'zz' FROM documents WHERE doc_id % 10 = 0")
def _(spark, t):
    rules = t("documents").select(F.col("doc_id").alias("rule_id"), F.concat(F.lit("'"), "lang", F.lit("'"), F.when(F.col("doc_id") % 10 == 0, ", zz").otherwise("")).alias("code_value"))
    return T.unknown_codes(rules, t("documents").where("lang = 'en'").select(F.col("lang").alias("value")).distinct())


@query("txt8_never_cited", "SELECT DISTINCT source AS value FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 0)")
def _(spark, t):
    return T.never_cited(t("documents").select(F.col("source").alias("value")), t("documents").where("doc_id % 50 = 0").select(F.col("source").alias("code_value")))


@query("txt9_omission_comments", f"WITH {QUOTED} SELECT doc_id, CAST(6 + n AS INTEGER) AS line_no, '-- the rest likewise' AS line FROM q")
def _(spark, t):
    return T.omission_comments(pages(t), ["rest likewise", "omitted"])


@query("txt10_line_anchors", "SELECT doc_id, CAST(doc_id AS INTEGER) AS anchor, 'column' AS source FROM documents UNION ALL SELECT doc_id, 7, 'column' FROM documents UNION ALL SELECT doc_id, 7, 'cell' FROM documents UNION ALL SELECT doc_id, 12, 'heading' FROM documents")
def _(spark, t):
    return T.line_anchors(pages(t)).select("doc_id", "anchor", "source")


@query("txt11_coverage_map", "WITH s AS (SELECT DISTINCT l_orderkey AS object, l_linenumber * 10 AS a, l_linenumber * 10 + 5 AS b, l_quantity < 5 AS c FROM lineitem), f AS (SELECT DISTINCT l_orderkey AS object, CAST(l_quantity AS INTEGER) AS line FROM lineitem), n AS (SELECT DISTINCT l_orderkey AS object, CAST(l_quantity AS INTEGER) + 9 AS line FROM lineitem), k AS (SELECT object, c, EXISTS (SELECT 1 FROM f WHERE f.object = s.object AND line BETWEEN a AND b) AS f, EXISTS (SELECT 1 FROM n WHERE n.object = s.object AND line BETWEEN a AND b) AS n FROM s) SELECT object, count(*) FILTER (NOT c AND f AND n) AS Consistent, count(*) FILTER (NOT c AND f AND NOT n) AS SpecMissing, count(*) FILTER (NOT c AND NOT f AND n) AS ProseOnly, count(*) FILTER (c OR (NOT f AND NOT n)) AS OutOfScope FROM k GROUP BY 1")
def _(spark, t):
    l = t("lineitem")  # noqa: E741
    s = l.select(F.col("l_orderkey").alias("object"), (F.col("l_linenumber") * 10).alias("start_line"), (F.col("l_linenumber") * 10 + 5).alias("end_line"), (F.col("l_quantity") < 5).alias("is_container"))
    at = lambda shift: l.select(F.col("l_orderkey").alias("object"), (F.col("l_quantity").cast("int") + shift).alias("line"))
    return T.coverage_map(s, at(0), at(9))


@query("txt12_material_census", "WITH d AS (SELECT source, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (n_chars > 900) AS b FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), s AS (SELECT source, count(*) FILTER (lang = 'en') AS a FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) SELECT 'en' AS material, CAST(sum(s.a) AS BIGINT) AS in_source, CAST(sum(d.a) AS BIGINT) AS in_documents, CAST(sum(CAST(d.a < s.a AS INTEGER)) AS BIGINT) AS objects_with_loss FROM s FULL JOIN d USING (source) UNION ALL SELECT 'long', NULL, CAST(sum(d.b) AS BIGINT), NULL FROM d")
def _(spark, t):
    n = lambda test: F.sum(test.cast("long"))
    en, long = F.col("lang") == "en", F.col("n_chars") > 900
    s = t("documents").where("doc_id % 2 = 1").groupBy(F.col("source").alias("object")).agg(n(en).alias("en"), F.lit(None).cast("long").alias("long"))
    d = t("documents").where("doc_id % 2 = 0").groupBy(F.col("source").alias("object")).agg(n(en).alias("en"), n(long).alias("long"))
    return T.material_census(s, d, ["en", "long"])


@query("txt13_attribute_codes", "SELECT c_name || ' ' AS code, CASE WHEN c_custkey % 3 = 0 THEN n_name END AS step, c_custkey % 3 <> 0 AS unattributed FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(spark, t):
    joined = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    steps = joined.where("c_custkey % 3 = 0").groupBy(F.col("n_name").alias("step")).agg(F.collect_list(F.lower("c_name")).alias("codes"))
    return T.attribute_codes(t("customer").select(F.concat("c_name", F.lit(" ")).alias("code")), steps)


@query(
    "txt14_script_table_refs",
    r"""WITH d AS (SELECT doc_id, text || ' select 1 from dbo.[T' || (doc_id % 5) || '] join App.u' AS text FROM documents),
    n AS (SELECT doc_id, lower(regexp_replace(unnest(regexp_extract_all(text, '(?i)\b(?:from|join|into|update|merge(?:\s+into)?)\s+([\[\]A-Za-z_][\[\]A-Za-z0-9_.$]*)', 1)), '[\[\]]', '', 'g')) AS "table" FROM d)
    SELECT DISTINCT doc_id, "table" FROM n WHERE "table" <> '' AND "table" NOT IN ('select', 'where', 'set', 'values', 'into', 'from', 'join', 'on', 'as', 'openjson', 'string_split')""",
)
def _(spark, t):
    """Whole texts, with a statement behind them."""
    tail = F.concat(F.lit(" select 1 from dbo.[T"), (F.col("doc_id") % 5).cast("string"), F.lit("] join App.u"))
    return T.script_table_refs(t("documents").select("doc_id", F.concat("text", tail).alias("text")))


@query("txt15_size_warnings", "SELECT source AS stage, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY 1 HAVING sum(length(text)) > 120000")
def _(spark, t):
    d = t("documents")
    return T.size_warnings(d.select("doc_id", "text"), d.select(F.col("source").alias("stage"), "doc_id"))
