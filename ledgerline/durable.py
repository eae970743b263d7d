"""Intermediate tables that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one of our own only on a local master where none is set, as in
    tests. On a cluster that setting must be there: executors share no machine's folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = sc._jsc.sc().getCheckpointDir().get()
    return named


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df computed once, kept as Parquet in the shared folder and read back: later jobs survive lost executors."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more: all that came of them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder; keeps how its rows are dealt out, unlike written()."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
