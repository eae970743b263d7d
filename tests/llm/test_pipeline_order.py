import corpus_pipeline
from ledgerline.llm import mixing
from pyspark.sql import functions as F

from ledgerline.llm.common import scratch_path, written

SF = "/root/testdata/sf0.001"


def test_tokens_come_in_training_order(spark):
    """The mix written to several files, of sizes that don't follow the order, and encoded: positions rise, and each row
    stands where the mix put it."""
    docs = written(spark.read.parquet(f"{SF}/documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    path = scratch_path(spark)
    mixed = stages["mixing"](spark, docs, SF)
    mixed.repartition(7, F.when(F.col("training_position") < 0.5, F.lit(0)).otherwise(F.col("doc_id") % 6)).write.parquet(path)
    tokens = stages["bpe"](spark, spark.read.parquet(path), SF).collect()
    placed = mixing.mix(docs).collect()
    want = sorted((at, r["doc_id"]) for r in placed for at in (r["position"], r["position_again"]) if at is not None)
    assert [(r["training_position"], r["doc_id"]) for r in tokens] == want
    assert len(want) > docs.count()


def test_training_position_gives_way(spark):
    docs = spark.createDataFrame([(i, f"a b c {i}", "s", 9) for i in range(5)], "doc_id long, text string, source string, training_position int")
    out = mixing.mixed(docs)
    assert out.columns == ["doc_id", "text", "source", "training_position"] and all(0 <= r["training_position"] <= 1 for r in out.collect())
    assert mixing.mixed(docs.limit(0)).count() == 0
