"""Change detection: fingerprints, reuse decisions, snapshots, stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.durable import discard, written

#: Column of a stored table's parts; the number of parts stands in the metadata of the first key column.
PART = "store_part"


def composite_hash(objects: DataFrame, dependencies: DataFrame, max_depth: int) -> DataFrame:
    """(key, composite_hash) of objects (key, source_hash): SHA-256 of the source hash, the depth and the dependencies'
    hashes in the order of their keys. dependencies (key, dependency, hash)."""
    lists = dependencies.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("dependency", "hash"))).alias("d"))
    joined = F.array_join(F.transform(F.coalesce("d", F.array().cast("array<struct<dependency:string,hash:string>>")), lambda x: F.concat_ws("=", x["dependency"], x["hash"])), ";")
    return objects.join(lists, "key", "left").select("key", F.sha2(F.concat_ws("|", "source_hash", F.lit(str(max_depth)), joined), 256).alias("composite_hash"))


def plan_recompute(current: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """(key, decision, reason) for current (key, identity, composite_hash, content_hash) against cache (the same and
    format_version): the first test that fails says why."""
    c, o = current.alias("c"), cache.alias("o")
    differs = lambda x: ~F.col(f"c.{x}").eqNullSafe(F.col(f"o.{x}"))
    reason = (
        F.when(F.col("o.key").isNull(), "not cached")
        .when(~F.col("o.format_version").eqNullSafe(F.lit(version)), "format version")
        .when(differs("identity"), "identity")
        .when(differs("composite_hash"), "composite hash")
        .when(differs("content_hash"), "content hash")
        .otherwise("unchanged")
    )
    return c.join(o, F.col("c.key") == F.col("o.key"), "left").select("c.key", F.when(reason == "unchanged", "reuse").otherwise("recompute").alias("decision"), reason.alias("reason"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, hash_: str) -> DataFrame:
    """(key, change): new, removed, changed or unchanged."""
    b, a = before.select(key, F.col(hash_).alias("__b"), F.lit(True).alias("__in_b")), after.select(key, F.col(hash_).alias("__a"), F.lit(True).alias("__in_a"))
    change = F.when(F.col("__in_b").isNull(), "new").when(F.col("__in_a").isNull(), "removed").when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("changed")
    return b.join(a, key, "full").select(key, change.alias("change"))


def upsert(store: DataFrame, updates: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The store with updates put in: for each key the row that comes last in order; an update wins over the store."""
    return merge_stores(store, updates, key=key, order=order)


def merge_stores(*stores: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Stores put together; of a key's rows the one of the latest store, and in it the last in order, stays."""
    tagged = [s.withColumn("__store", F.lit(i)) for i, s in enumerate(stores)]
    rows = reduce(DataFrame.unionByName, tagged)
    others = [c for c in stores[0].columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(F.col("__store"), *(o.alias(f"__o{i}") for i, o in enumerate(order)))).alias("__row"))
    return last.select(*key, *(F.col(f"__row.{c}").alias(c) for c in others)).select(*stores[0].columns)


def _dealt(rows: DataFrame, key: list[str], parts: int) -> DataFrame:
    return rows.withColumn(PART, F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))


def write_store(rows: DataFrame, path: str, key: list[str], parts: int) -> None:
    """A new store: rows dealt to parts folders by a hash of their key. parts is kept in the store; choose it so that a
    part is about one file's worth of rows at the size that the store will have."""
    marked = rows.withMetadata(key[0], {"store_parts": parts})
    _dealt(marked, key, parts).repartition(parts, PART).write.mode("error").partitionBy(PART).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store."""
    return spark.read.parquet(path).drop(PART)


def upsert_store(spark: SparkSession, path: str, updates: DataFrame, key: list[str], order: list[Column]) -> list[int]:
    """Put updates into a store as upsert() does, but read and rewrite only the parts that hold one of their keys; returns
    these parts' numbers.

    The new parts are written apart first and then put in place of the old ones, so a lost executor costs only its tasks;
    where the driver ends between the two, the same call again gives the same store. Updates take the store's types before
    their keys are hashed; columns that the store has not raise, null keys are keys like any other. What the driver takes
    in is the numbers of parts, no more than the store has.
    """
    stored = spark.read.parquet(path)
    parts = stored.schema[key[0]].metadata.get("store_parts")
    if parts is None:
        raise ValueError(f"{path} wasn't written by write_store with the key {key}")
    kept = [f for f in stored.schema.fields if f.name != PART]
    if set(updates.columns) != {f.name for f in kept}:
        raise ValueError(f"columns of the updates {sorted(updates.columns)} aren't those of the store")
    fitted = written(_dealt(updates.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kept)), key, parts))
    touched = sorted(r[0] for r in fitted.select(PART).distinct().collect())
    if touched:
        old = stored.where(F.col(PART).isin(touched))
        merged = written(upsert(old, fitted, [PART, *key], order))
        marked = merged.withMetadata(key[0], {"store_parts": parts})
        marked.repartition(len(touched), PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
        discard(merged)
    discard(fitted)
    return touched


def merge_into_store(spark: SparkSession, path: str, *stores: DataFrame, key: list[str], order: list[Column]) -> list[int]:
    """Older stores put into one on disk, the latest last, as merge_stores() does; only parts that hold one of their keys are
    rewritten. Returns these parts' numbers."""
    return upsert_store(spark, path, merge_stores(*stores, key=key, order=order), key, order)


def tail_hash(text: Column, n: int, reference: str = r"(?s)\n#+ References\n.*\z") -> Column:
    """SHA-256 of the last n characters of a text without its reference section; empty texts give the empty text."""
    bare = F.regexp_replace(text, reference, "")
    tail = F.substring(bare, F.greatest(F.lit(1), F.length(bare) - n + 1), F.lit(n))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.lit("")).otherwise(F.sha2(tail, 256))
