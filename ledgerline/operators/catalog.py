"""Catalog tables: profiles, dictionaries, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.expressions import base_name


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows)."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()))


def to_string_cells(df: DataFrame) -> DataFrame:
    """df with every cell as text; null becomes the empty text."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))


def profile_small_tables(tables: dict[str, DataFrame], order: dict[str, list[str]], threshold: int = 500) -> DataFrame:
    """(table, row_no, col, val): the distinct rows, case aside, of tables with threshold rows at most. Rows are numbered
    by the order columns. Larger tables are only counted, so what is numbered in one window has that size at most."""
    found = []
    for name, df in tables.items():
        if df.limit(threshold + 1).count() > threshold:
            continue
        cells = to_string_cells(df)
        once = cells.groupBy(*(F.lower(c).alias(f"__{c}") for c in cells.columns)).agg(*(F.min(c).alias(c) for c in cells.columns))
        rows = once.withColumn("row_no", F.row_number().over(Window.orderBy(*order[name], *cells.columns)).cast("long"))
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("val")) for c in cells.columns)))
        found.append(rows.select(F.lit(name).alias("table"), "row_no", pairs.alias("p")).select("table", "row_no", "p.*"))
    return reduce(DataFrame.unionByName, found)


def column_dictionary(tables: DataFrame, columns: DataFrame, types: DataFrame, keys: DataFrame, foreign: DataFrame, described: DataFrame) -> DataFrame:
    """Columns of tables with their rendered type and flags. tables (object_id, table), columns (object_id, column_id,
    column_name, type_id, max_length, precision, scale, is_nullable, is_identity, default_value), types (type_id,
    type_name), keys and foreign (object_id, column_id), described (object_id, column_id, description)."""
    both = ["object_id", "column_id"]
    flag = lambda df, name: df.select(*both).distinct().withColumn(name, F.lit(True))
    joined = columns.join(tables, "object_id").join(types, "type_id").join(flag(keys, "pk"), both, "left").join(flag(foreign, "fk"), both, "left").join(described, both, "left")
    size = F.when(F.col("max_length") == -1, "MAX").when(F.col("type_name").isin("nchar", "nvarchar"), F.floor(F.col("max_length") / 2).cast("string")).otherwise(F.col("max_length").cast("string"))
    rendered = (
        F.when(F.col("type_name").isin("char", "varchar", "nchar", "nvarchar", "binary", "varbinary"), F.concat("type_name", F.lit("("), size, F.lit(")")))
        .when(F.col("type_name").isin("decimal", "numeric"), F.concat("type_name", F.lit("("), F.col("precision").cast("string"), F.lit(","), F.col("scale").cast("string"), F.lit(")")))
        .otherwise(F.col("type_name"))
    )
    no = F.lit(False)
    return joined.select("table", "column_id", "column_name", rendered.alias("data_type"), "is_nullable", F.coalesce("pk", no).alias("is_primary_key"), F.coalesce("fk", no).alias("is_foreign_key"), "is_identity", "default_value", "description")


def index_dictionary(tables: DataFrame, indexes: DataFrame, index_columns: DataFrame, columns: DataFrame) -> DataFrame:
    """Indexes with their columns in order. indexes (object_id, index_id, index_name, index_type, is_unique,
    is_primary_key), index_columns (object_id, index_id, ordinal, column_id)."""
    listed = index_columns.join(columns.select("object_id", "column_id", "column_name"), ["object_id", "column_id"]).groupBy("object_id", "index_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"]).alias("columns"))
    return indexes.join(tables, "object_id").join(listed, ["object_id", "index_id"]).select("table", "index_name", "index_type", "is_unique", "is_primary_key", "columns")


def missing_descriptions(columns: DataFrame, table: str = "table") -> DataFrame:
    """(table, columns, missing): columns without a description."""
    blank = (F.coalesce(F.trim("description"), F.lit("")) == "").cast("long")
    return columns.groupBy(table).agg(F.count("*").alias("columns"), F.sum(blank).alias("missing"))


def raw_dependencies(references: DataFrame, objects: DataFrame, targets: DataFrame, current_db: str) -> DataFrame:
    """(source, database, schema, name, type) of references (object_id, ref_database, ref_schema, ref_name) of known
    objects (object_id, source): the schema is dbo and the type UNKNOWN where nothing is said, and the own database is
    left out. targets (schema, name, type)."""
    schema = F.coalesce("ref_schema", F.lit("dbo"))
    rows = references.join(objects, "object_id").select("source", F.when(F.lower("ref_database") != current_db.lower(), F.col("ref_database")).alias("database"), schema.alias("schema"), F.col("ref_name").alias("name"))
    t = targets.select(F.lower("schema").alias("__s"), F.lower("name").alias("__n"), "type").distinct()
    found = rows.join(t, (F.lower("schema") == F.col("__s")) & (F.lower("name") == F.col("__n")) & F.col("database").isNull(), "left")
    return found.select("source", "database", "schema", "name", F.coalesce("type", F.lit("UNKNOWN")).alias("type")).distinct()


def column_type_map(columns: DataFrame) -> DataFrame:
    """(column, data_type, types, ambiguous): column names, case aside, with their type where there is one only."""
    by = columns.groupBy(F.lower("column_name").alias("column")).agg(F.countDistinct(F.lower("data_type")).alias("types"), F.min(F.lower("data_type")).alias("least"))
    return by.select("column", F.when(F.col("types") == 1, F.col("least")).alias("data_type"), "types", (F.col("types") > 1).alias("ambiguous"))


def select_relevant_columns(columns: DataFrame, references: DataFrame, indexes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Columns (table, column_name, is_primary_key, is_foreign_key) that are referenced, keys, in an index (table, columns),
    or mentioned (table, column_name); all columns of a table of which nothing would be kept."""
    key = lambda df, t, c: df.select(F.lower(t).alias("__t"), F.lower(c).alias("__c"))
    wanted = key(references, "table", "column_name").union(key(mentions, "table", "column_name")).union(indexes.select(F.lower("table"), F.explode("columns").alias("c")).select(F.col("lower(table)").alias("__t"), F.lower("c").alias("__c")))
    hit = wanted.distinct().withColumn("__hit", F.lit(True))
    rows = columns.withColumn("__t", F.lower("table")).withColumn("__c", F.lower("column_name")).join(hit, ["__t", "__c"], "left")
    kept = F.coalesce("__hit", F.lit(False)) | F.coalesce("is_primary_key", F.lit(False)) | F.coalesce("is_foreign_key", F.lit(False))
    counts = rows.withColumn("__kept", kept)
    some = counts.groupBy("__t").agg(F.max("__kept").alias("__some"))
    return counts.join(some, "__t").where("__kept OR NOT __some").select(*columns.columns)


def orphaned_references(references: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(reference, looks_like): referenced names that match no dependency as they stand but one by their last part."""
    r = references.select(F.col("name").alias("reference"), F.lower("name").alias("__key"), F.lower(base_name(F.col("name"))).alias("__base")).distinct()
    d = dependencies.select(F.col("name").alias("looks_like"), F.lower("name").alias("__key"), F.lower(base_name(F.col("name"))).alias("__base")).distinct()
    return r.join(d.select("__key"), "__key", "left_anti").join(d.select("looks_like", "__base"), "__base").select("reference", "looks_like")


def schema_catalog(*names: DataFrame) -> DataFrame:
    """(name): all names, each once, case aside; of several spellings the least."""
    return reduce(DataFrame.unionByName, (n.select("name") for n in names)).groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name")).select("name")


def map_by_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, target, how): each document (name, hint) with its target (target): the one its hint names, else the one of
    the same name, else the longest that it begins with, where no digit follows."""
    r = right.select("target", F.lower("target").alias("__t")).distinct()
    l = left.select("name", F.lower("name").alias("__n"), F.lower("hint").alias("__h"))  # noqa: E741
    hinted = l.join(r, F.col("__h") == F.col("__t")).select("name", "target", F.lit(0).alias("rank"))
    same = l.join(r, F.col("__n") == F.col("__t")).select("name", "target", F.lit(1).alias("rank"))
    # every beginning of the name is a key, so the prefix match is an equi join
    begins = l.select("name", "__n", F.explode(F.transform(F.sequence(F.lit(1), F.length("__n")), lambda i: F.left("__n", i))).alias("__t"))
    after = F.substring(F.col("__n"), F.length("__t") + 1, F.lit(1))
    prefix = begins.where(~after.rlike("^[0-9]")).join(r, "__t").select("name", "target", (1000 - F.length("__t")).alias("rank"))
    best = hinted.union(same).union(prefix).groupBy("name").agg(F.min(F.struct("rank", "target")).alias("m"))
    how = F.when(F.col("m.rank") == 0, "hint").when(F.col("m.rank") == 1, "exact").otherwise("prefix")
    return best.select("name", F.col("m.target").alias("target"), how.alias("how"))


def snapshot_range_check(tables: dict[str, DataFrame], ymd: str, column: str = "ymd") -> DataFrame:
    """(table, rows, outside): rows of each table, and those of another day."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("rows"), F.coalesce(F.sum((~F.col(column).eqNullSafe(F.lit(ymd))).cast("long")), F.lit(0)).alias("outside")).select(F.lit(n).alias("table"), "rows", "outside") for n, df in tables.items()))
