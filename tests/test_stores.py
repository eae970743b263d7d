"""Partitioned scans of a database, and stores that are updated in part."""

import pytest
from pyspark.sql import functions as F

from ledgerline.durable import scratch_path
from ledgerline.operators import incremental as I
from ledgerline.sources.files import balanced_cuts, read_partitioned


@pytest.fixture(scope="module")
def database(spark):
    url = "jdbc:derby:memory:scan;create=true"
    dense = spark.range(0, 3000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    far = spark.range(0, 1000).select((F.col("id") * 1000 + 1_000_000).alias("k"), F.col("id").alias("v"))
    none = spark.range(0, 50).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v"))
    rows = dense.unionByName(far).unionByName(none)
    rows.write.jdbc(url, "CROWDED", mode="overwrite")
    rows.limit(0).write.jdbc(url, "NOTHING", mode="overwrite")
    rows.where("k IS NULL").write.jdbc(url, "NULLS", mode="overwrite")
    rows.where("k = 7").write.jdbc(url, "ONE", mode="overwrite")
    rows.where("k IS NOT NULL").select((F.col("k") / 7).alias("k"), "v").write.jdbc(url, "BROKEN", mode="overwrite")
    return url, rows


def sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_parts_are_even_and_whole(spark, database):
    url, rows = database
    got = read_partitioned(spark, url, "CROWDED", '"k"', rows=500)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    # the dense keys lie in one stride, which is cut again
    found = sizes(got)
    assert max(found) <= 500 and sum(found) == 4050 and len(found) <= 12


def test_filters_and_columns_reach_the_database(spark, database):
    url, rows = database
    got = read_partitioned(spark, url, "CROWDED", '"k"', rows=500).where("v > 900").select("k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,900)" in plan and "ReadSchema: struct<k:bigint>" in plan
    assert got.count() == rows.where("v > 900").count()


@pytest.mark.parametrize("table,found", [("NOTHING", []), ("NULLS", [50]), ("ONE", [10])])
def test_odd_tables(spark, database, table, found):
    got = read_partitioned(spark, database[0], table, '"k"', rows=5)
    assert sizes(got) == found and got.rdd.getNumPartitions() == 1


def test_fractions_are_cut_where_rows_lie(spark, database):
    got = read_partitioned(spark, database[0], "BROKEN", '"k"', rows=500)
    assert got.count() == 4000 and max(sizes(got)) <= 500
    assert got.agg(F.sum("v")).first() == database[1].where("k IS NOT NULL").agg(F.sum("v")).first()


def test_cuts_hold_every_cell_once():
    assert balanced_cuts([(100, 5), (110, 5), (120, 5), (190, 30), (210, 1)], 10) == [120, 190, 210]
    assert balanced_cuts([], 10) == [] and balanced_cuts([(3, 99)], 10) == []


def files(spark, path):
    rows = spark.read.parquet(path).select(F.input_file_name().alias("f"), I.PART).distinct().collect()
    found = {}
    for r in rows:
        found.setdefault(r[I.PART], set()).add(r["f"])
    return found


def test_only_touched_parts_are_rewritten(spark):
    path = scratch_path(spark)
    store = spark.range(0, 1000).select("id", F.lit(0).alias("version"), F.concat(F.lit("v"), "id").alias("text"))
    I.write_store(store, path, ["id"], 16)
    before = files(spark, path)
    updates = spark.createDataFrame([(5, 2, "new"), (5, 1, "older"), (4000, 1, "added"), (None, 1, "null key")], "id long, version int, text string")
    touched = I.upsert_store(spark, path, updates, ["id"], [F.col("version")])
    after = files(spark, path)
    assert 1 <= len(touched) <= 3 and set(before) | set(touched) == set(after)
    assert all(before[p] == after[p] for p in before if p not in touched)
    assert all(before.get(p) != after[p] for p in touched)
    wanted = {r["id"]: tuple(r) for r in store.collect()} | {5: (5, 2, "new"), 4000: (4000, 1, "added"), None: (None, 1, "null key")}
    assert {r["id"]: tuple(r) for r in I.read_store(spark, path).collect()} == wanted
    assert I.read_store(spark, path).count() == len(wanted)
    # the same call again changes no row, and no update touches nothing
    assert I.upsert_store(spark, path, updates, ["id"], [F.col("version")]) == touched
    assert {r["id"]: tuple(r) for r in I.read_store(spark, path).collect()} == wanted
    assert I.upsert_store(spark, path, updates.limit(0), ["id"], [F.col("version")]) == []


def test_updates_of_other_types_and_columns(spark):
    path = scratch_path(spark)
    I.write_store(spark.range(0, 100).select("id", F.lit("a").alias("text")), path, ["id"], 4)
    I.upsert_store(spark, path, spark.createDataFrame([("b", 7)], "text string, id int"), ["id"], [F.col("text")])
    assert I.read_store(spark, path).count() == 100 and I.read_store(spark, path).where("id = 7").first()["text"] == "b"
    with pytest.raises(ValueError, match="columns"):
        I.upsert_store(spark, path, spark.range(1), ["id"], [F.col("id")])
    plain = scratch_path(spark)
    spark.range(3).write.parquet(plain)
    with pytest.raises(ValueError, match="write_store"):
        I.upsert_store(spark, plain, spark.range(1), ["id"], [F.col("id")])


def test_merge_into_store_equals_merge_of_all(spark):
    path, key, order = scratch_path(spark), ["k"], [F.col("at")]
    old, mid, new = (spark.range(0, 60).where(f"id % {m} = 0").select((F.col("id") % 30).alias("k"), F.col("id").alias("at"), F.lit(m).alias("of")) for m in (2, 3, 5))
    I.write_store(I.merge_stores(old, key=key, order=order), path, key, 8)
    I.merge_into_store(spark, path, mid, new, key=key, order=order)
    assert sorted(map(tuple, I.read_store(spark, path).collect())) == sorted(map(tuple, I.merge_stores(old, mid, new, key=key, order=order).collect()))
