"""Document corpora: lines, sections, tables, attribution, codebooks, coverage. Documents are rows (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.expressions import normalize_heading, normalize_quote, split_code_values
from ledgerline.operators.joins import interval_join
from ledgerline.operators.search import occurrences

FENCE = r"^\s*(```|~~~)"
HEADING = r"^#{1,6}\s+\S"


#: Lines that one inner fold goes over: a result that grows line by line is copied at each step, so that one fold over a
#: text would take the square of its lines.
FOLDED = 64


def markdown_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, is_fence, in_fence, heading): fence lines themselves are outside, an unclosed fence clears
    all flags of its document, and the heading is the last one above outside of fences. A line ends with \\n, \\r or both;
    an empty text is one empty line, a null one none.

    Each text is folded inside its row, with the state (all fences closed?, within one?, heading) handed from line to line
    and from one stretch of lines to the next, so lines aren't exchanged.
    """
    # stretches of FOLDED lines, the last one shorter, each line with its end
    cut = F.regexp_extract_all(F.concat(F.regexp_replace("text", "\r\n?", "\n"), F.lit("\n")), F.lit(f"(?:[^\n]*+\n){{1,{FOLDED}}}+"), F.lit(0))
    lines = lambda s: F.split(F.substr(s, F.lit(1), F.length(s) - 1), "\n")
    marked = lambda s, b: F.transform(lines(s), lambda x, i: F.struct((b * FOLDED + i).alias("line_no"), x.alias("line"), x.rlike(FENCE).alias("is_fence"), F.when(x.rlike(HEADING), x).alias("head")))
    kind = "array<struct<line_no:int,line:string,is_fence:boolean,in_fence:boolean,heading:string>>"
    state = lambda closed, fence, heading, *more: F.struct(closed.alias("closed"), fence.alias("fence"), heading.alias("heading"), *more)
    inside = lambda now, x: now["closed"] & now["fence"] & ~x["is_fence"]
    heading = lambda now, x: F.when(inside(now, x), now["heading"]).otherwise(F.coalesce(x["head"], now["heading"]))
    after = lambda now, x, *more: state(now["closed"], now["fence"] != x["is_fence"], heading(now, x), *more)
    same = lambda now, *more: state(now["closed"], now["fence"], now["heading"], *more)

    def begins(now: Column, lines: Column) -> Column:
        """The states that stretches begin with, one more for each."""
        ended = F.aggregate(lines, same(now), lambda s, x: after(s, x))
        return F.transform(F.array(ended), lambda r: same(r, F.concat(now["begins"], F.array(same(now))).alias("begins")))[0]

    def rows_of(lines: Column, begin: Column) -> Column:
        row = lambda now, x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), x["is_fence"].alias("is_fence"), inside(now, x).alias("in_fence"), heading(now, x).alias("heading"))
        return F.aggregate(lines, same(begin, F.array().cast(kind).alias("out")), lambda now, x: after(now, x, F.concat(now["out"], F.array(row(now, x))).alias("out")))["out"]

    rows = docs.where("text IS NOT NULL").select("doc_id", F.transform(cut, marked).alias("stretches"))
    fences = F.aggregate("stretches", F.lit(0), lambda n, lines: n + F.size(F.filter(lines, lambda x: x["is_fence"])))
    first = state(fences % 2 == 0, F.lit(False), F.lit(None).cast("string"), F.array().cast("array<struct<closed:boolean,fence:boolean,heading:string>>").alias("begins"))
    begun = rows.withColumn("begins", F.aggregate("stretches", first, begins)["begins"])
    return begun.select("doc_id", F.inline(F.flatten(F.zip_with("stretches", "begins", rows_of))))


def section_body(docs: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, wanted, heading, body) for headings (doc_id, wanted): the section whose heading is the wanted text
    exactly, else the first whose normal form is the same. Body lines stand without the heading."""
    lines = markdown_lines(docs).where("heading IS NOT NULL")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    is_head = F.col("line").eqNullSafe(F.col("heading")) & F.col("line").rlike(HEADING) & ~F.col("in_fence")
    marked = lines.withColumn("is_head", is_head).withColumn("section", F.sum(F.col("is_head").cast("int")).over(w))
    bodies = marked.groupBy("doc_id", "section").agg(
        F.first("heading").alias("heading"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_head"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    found = headings.join(bodies, "doc_id").withColumn("title", F.trim(F.regexp_replace("heading", r"^#+\s*", "")))
    rank = F.when(F.trim("wanted") == F.trim("heading"), 0).when(F.trim(F.regexp_replace("wanted", r"^#+\s*", "")) == F.col("title"), 1).when(normalize_heading(F.col("wanted")) == normalize_heading(F.col("heading")), 2)
    best = Window.partitionBy("doc_id", "wanted").orderBy("__rank", "section")
    return found.withColumn("__rank", rank).where("__rank IS NOT NULL").withColumn("__n", F.row_number().over(best)).where("__n = 1").select("doc_id", "wanted", "heading", "body")


def section_defects(docs: DataFrame, required: list[str]) -> DataFrame:
    """(doc_id, defect, section): required sections that are missing, and those that come before one they should follow."""
    want = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(s).alias("section")) for i, s in enumerate(required))))
    wanted = docs.select("doc_id", want.alias("w")).select("doc_id", "w.*")
    heads = markdown_lines(docs).where(F.col("line").rlike(HEADING) & ~F.col("in_fence")).select("doc_id", normalize_heading(F.col("line")).alias("section"), "line_no").groupBy("doc_id", "section").agg(F.min("line_no").alias("line_no"))
    both = wanted.join(heads, ["doc_id", "section"], "left")
    missing = both.where("line_no IS NULL").select("doc_id", F.lit("missing").alias("defect"), "section")
    w = Window.partitionBy("doc_id").orderBy("place")
    late = both.where("line_no IS NOT NULL").withColumn("before", F.lag("line_no").over(w)).where("line_no < before")
    return missing.unionByName(late.select("doc_id", F.lit("out of order").alias("defect"), "section"))


def table_cells(line: Column) -> Column:
    """Cells of a pipe-table line: split at pipes that aren't escaped, trimmed, escapes undone."""
    bare = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))


def markdown_table_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, table_no, line_no, heading, cells): rows of pipe tables as maps from header names. A table is a header
    line, a separator line and the pipe lines right below; missing cells are left out, surplus ones dropped."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    lines = markdown_lines(docs).where("NOT in_fence AND NOT is_fence")
    separator = F.col("line").rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$") & F.contains(F.col("line"), F.lit("-"))
    pipe = F.contains(F.col("line"), F.lit("|"))
    rows = lines.withColumn("pipe", pipe).withColumn("block", F.col("line_no") - F.sum(F.col("pipe").cast("int")).over(w)).where("pipe")
    block = Window.partitionBy("doc_id", "block").orderBy("line_no")
    rows = rows.withColumn("place", F.row_number().over(block)).withColumn("sep", separator)
    heads = rows.groupBy("doc_id", "block").agg(F.max(F.when(F.col("place") == 1, F.col("line"))).alias("head"), F.max(F.when(F.col("place") == 2, F.col("sep"))).alias("ok"), F.min("line_no").alias("begin")).where("ok")
    heads = heads.withColumn("table_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("begin")) - 1)
    body = rows.where("place > 2").join(heads, ["doc_id", "block"])
    names, cells = table_cells(F.col("head")), table_cells(F.col("line"))
    both = F.filter(F.arrays_zip(names.alias("k"), cells.alias("v")), lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    return body.withColumn("__z", both).select("doc_id", "table_no", "line_no", "heading", F.map_from_entries(F.aggregate("__z", F.array().cast("array<struct<k:string,v:string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))))).alias("cells"))


def attribution_defects(claims: DataFrame, docs: DataFrame, allowed: tuple[str, ...], prefix: str) -> DataFrame:
    """(rule_id, defect) of claims (rule_id, evidence_label, evidence_heading, evidence_quote) that documents (doc_id is
    the label) don't bear out: the first of id prefix, missing, source not allowed, label unknown, heading not found,
    quote not found."""
    known = docs.select(F.col("doc_id").cast("string").alias("evidence_label")).distinct().withColumn("known", F.lit(True))
    wanted = claims.select(F.col("evidence_label").alias("doc_id"), F.col("evidence_heading").alias("wanted")).dropna().distinct()
    labelled = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    bodies = section_body(labelled, wanted).select(F.col("doc_id").alias("evidence_label"), F.col("wanted").alias("evidence_heading"), "body")
    joined = claims.join(known, "evidence_label", "left").join(bodies, ["evidence_label", "evidence_heading"], "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    defect = (
        F.when(~F.coalesce(F.startswith("rule_id", F.lit(prefix)), F.lit(False)), "id prefix")
        .when(blank("evidence_label") | blank("evidence_heading") | blank("evidence_quote"), "missing")
        .when(~F.col("evidence_label").isin(*allowed) if allowed else F.lit(False), "source not allowed")
        .when(F.col("known").isNull(), "label unknown")
        .when(F.col("body").isNull(), "heading not found")
        .when(~F.contains(normalize_quote(F.col("body")), normalize_quote(F.col("evidence_quote"))), "quote not found")
    )
    return joined.select("rule_id", defect.alias("defect")).where("defect IS NOT NULL")


def quoted_in(claims: DataFrame, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Claims (with a document id) and whether the document holds the quotation, white space and marks aside."""
    texts = docs.select(doc_id, normalize_quote(F.col("text")).alias("__text"))
    return claims.join(texts, doc_id, "left").withColumn("found", F.coalesce(F.contains("__text", normalize_quote(F.col("quote"))), F.lit(False))).drop("__text")


def find_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of the documents (doc_id, text) that hold a quotation (item_id, quote), white space and marks
    aside. Empty quotations are found nowhere. All quotations are looked for in one pass over the documents, however
    short they are; see search.occurrences for more of them than fit into one automaton."""
    normal = quotes.select("item_id", normalize_quote(F.col("quote")).alias("literal")).where("literal <> ''").distinct()
    held = occurrences(normal, docs.select("doc_id", normalize_quote(F.col("text")).alias("text")), "doc_id")
    return held.join(normal, "literal").select("item_id", "doc_id").distinct()


def build_codebook(literals: DataFrame, docs: DataFrame) -> DataFrame:
    """(value, column, procedures, documents, match_eligible, listed) of literals (label, column, value): how many documents
    mention a value, the first column that isn't null by label, and whether it is long enough to be matched with code
    tables. listed is false for values that no document mentions. Values may be of any characters; documents are scanned
    once for all of them."""
    values = literals.groupBy("value").agg(F.min_by("column", F.when(F.col("column").isNotNull(), F.struct("label", "column"))).alias("column"), F.sort_array(F.collect_set("label")).alias("procedures"))
    hits = occurrences(values.select(F.col("value").alias("literal")), docs, "doc_id", whole_words=True).groupBy(F.col("literal").alias("value")).agg(F.count("*").alias("documents"))
    return values.join(hits, "value", "left").select("value", "column", "procedures", F.coalesce("documents", F.lit(0)).alias("documents"), (F.length("value") >= 3).alias("match_eligible"), F.col("documents").isNotNull().alias("listed"))


def match_codebook(codebook: DataFrame, profiled: DataFrame) -> DataFrame:
    """(value, table, row_no): the first row of each code table (table, row_no, col, val) that holds a match-eligible
    value, in its column where that is known and the table has it, in any cell otherwise, case aside."""
    cells = profiled.select("table", "row_no", F.lower("col").alias("col"), F.lower("val").alias("val"))
    entries = codebook.where("match_eligible").select("value", F.lower("value").alias("val"), F.lower("column").alias("column"))
    has = cells.select("table", F.col("col").alias("column")).distinct().withColumn("has", F.lit(True))
    pairs = entries.join(cells, "val").join(has, ["table", "column"], "left").where("column IS NULL OR has IS NULL OR col = column")
    return pairs.groupBy("value", "table").agg(F.min("row_no").alias("row_no"))


def unknown_codes(rules: DataFrame, codebook: DataFrame) -> DataFrame:
    """(rule_id, code): values of rules' code cells that the codebook lacks."""
    codes = rules.select("rule_id", F.explode(split_code_values(F.col("code_value"))).alias("code")).distinct()
    return codes.join(codebook.select(F.col("value").alias("code")), "code", "left_anti").select("rule_id", "code")


def never_cited(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Codebook values that no rule cites."""
    codes = rules.select(F.explode(split_code_values(F.col("code_value"))).alias("value")).distinct()
    return items.select("value").distinct().join(codes, "value", "left_anti")


def omission_comments(docs: DataFrame, patterns: list[str], most: int = 20) -> DataFrame:
    """(doc_id, line_no, line): comment lines inside fences that say that something is left out, each text once, the first
    `most` of a document."""
    comment = F.col("line").rlike(r"^\s*(--|//|#|\*)")
    hits = markdown_lines(docs).where(F.col("in_fence") & comment & F.col("line").rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)))
    once = hits.groupBy("doc_id", F.trim("line").alias("line")).agg(F.min("line_no").alias("line_no"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return once.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).select("doc_id", "line_no", "line")


def line_anchors(docs: DataFrame, column: str = "line", heading_pattern: str = r"\((?:line|L)\s*(\d+)\)", cell_pattern: str = r"\bL(\d+)\b") -> DataFrame:
    """(doc_id, anchor, source, row_text, is_comment): line numbers that documents cite, in a table column of that name,
    in headings, and in other cells."""
    rows = markdown_table_rows(docs).withColumn("row_text", F.array_join(F.map_values("cells"), " | "))
    comment = lambda c: F.trim(c).rlike(r"^(--|/\*|//)")
    number = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    named = F.element_at(F.map_values(F.map_filter("cells", lambda k, v: F.lower(k) == column)), 1)
    by_column = rows.where(F.size(F.map_filter("cells", lambda k, v: F.lower(k) == column)) > 0).select("doc_id", F.explode(number(named)).alias("anchor"), F.lit("column").alias("source"), "row_text")
    by_cell = rows.select("doc_id", F.explode(F.regexp_extract_all("row_text", F.lit(cell_pattern), F.lit(1))).alias("anchor"), F.lit("cell").alias("source"), "row_text")
    heads = markdown_lines(docs).where(F.col("line").rlike(HEADING) & ~F.col("in_fence"))
    by_head = heads.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(heading_pattern), F.lit(1))).alias("anchor"), F.lit("heading").alias("source"), F.col("line").alias("row_text"))
    found = by_column.unionByName(by_cell).unionByName(by_head)
    return found.withColumn("anchor", F.col("anchor").cast("int")).withColumn("is_comment", comment(F.col("row_text"))).distinct()


def coverage_map(statements: DataFrame, facts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(object, Consistent, SpecMissing, ProseOnly, OutOfScope): statements (object, start_line, end_line, is_container)
    by whether a fact and an anchor (object, line) fall on them; containers are out of scope."""
    spans = statements.select("object", "start_line", "end_line", "is_container").distinct()
    key = ["object", "start_line", "end_line"]
    of = lambda points, fact: points.select("object", "line", F.lit(fact).alias("fact"), F.lit(not fact).alias("anchor"))
    marks = lambda df, by: df.groupBy(*by).agg(F.max("fact").alias("fact"), F.max("anchor").alias("anchor"))
    points = marks(of(facts, True).unionByName(of(anchors, False)), ["object", "line"])
    # both are met in one join, by stretches of eight lines, which most statements fit into
    met = marks(interval_join(points, spans.select(*key).distinct(), ["object"], "line", "start_line", "end_line", 8), key)
    joined = spans.join(met, key, "left")
    kind = F.when(F.col("is_container"), "OutOfScope").when(F.col("fact") & F.col("anchor"), "Consistent").when(F.col("fact"), "SpecMissing").when(F.col("anchor"), "ProseOnly").otherwise("OutOfScope")
    return joined.withColumn("kind", kind).groupBy("object").pivot("kind", ["Consistent", "SpecMissing", "ProseOnly", "OutOfScope"]).count().na.fill(0)


def material_census(source_counts: DataFrame, doc_counts: DataFrame, materials: list[str]) -> DataFrame:
    """(material, in_source, in_documents, objects_with_loss): facts in the source against rows in documents (object, one
    column for each material). Sums stay null where nothing was counted; only objects that both sides counted can lose."""
    s = source_counts.select("object", *(F.col(m).alias(f"s_{m}") for m in materials))
    d = doc_counts.select("object", *(F.col(m).alias(f"d_{m}") for m in materials))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("material"), F.col(f"s_{m}").cast("long").alias("s"), F.col(f"d_{m}").cast("long").alias("d")) for m in materials)))
    long = s.join(d, "object", "full").select(each.alias("x")).select("x.*")
    return long.groupBy("material").agg(F.sum("s").alias("in_source"), F.sum("d").alias("in_documents"), F.sum(F.when(F.col("s").isNotNull() & F.col("d").isNotNull(), (F.col("d") < F.col("s")).cast("long"))).alias("objects_with_loss"))


def attribute_codes(missing: DataFrame, steps: DataFrame) -> DataFrame:
    """(code, step, unattributed): missing codes with the steps whose code list (step, codes array) names them."""
    owned = steps.select("step", F.explode("codes").alias("c")).select("step", F.lower(F.trim("c")).alias("key")).distinct()
    return missing.select("code", F.lower(F.trim("code")).alias("key")).join(owned, "key", "left").select("code", "step", F.col("step").isNull().alias("unattributed"))


#: Words that can follow the verbs but name no table.
NO_TABLES = ("select", "where", "set", "values", "into", "from", "join", "on", "as", "openjson", "string_split")


def script_table_refs(scripts: DataFrame) -> DataFrame:
    """(doc_id, table): names after FROM, JOIN, INTO, UPDATE, MERGE and DELETE FROM in scripts, without brackets, in lower
    case, each once. Temporary tables and table variables are left out."""
    pattern = r"(?i)\b(?:from|join|into|update|merge(?:\s+into)?)\s+([\[\]A-Za-z_][\[\]A-Za-z0-9_.$]*)"
    names = F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
    found = scripts.select("doc_id", names.alias("name")).select("doc_id", F.lower(F.regexp_replace("name", r"[\[\]]", "")).alias("table"))
    return found.where(~F.col("table").isin(*NO_TABLES) & (F.col("table") != "")).distinct()


def size_warnings(docs: DataFrame, stages: DataFrame, limit: int = 120_000) -> DataFrame:
    """(stage, characters): stages (stage, doc_id) whose documents together exceed the limit."""
    return docs.join(stages, "doc_id").groupBy("stage").agg(F.sum(F.length("text")).alias("characters")).where(F.col("characters") > limit)
