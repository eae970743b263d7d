"""Documents as files: lots, packed files, and a store that only Spark's writers reach."""

import gzip

from ledgerline.plans import catalog_queries, catalogue
from ledgerline.sources import files as S
from tests.compare import same
from tests.test_sizes import odd_documents


def test_documents_are_read_in_lots(spark, monkeypatch, tmp_path):
    read, paths = S.read_documents, []
    monkeypatch.setattr(S, "read_documents", lambda spark, path, *a: paths.append(path) or read(spark, path, *a))
    monkeypatch.setattr(catalog_queries, "LOT", 3)
    monkeypatch.setattr(catalog_queries, "scratch_path", lambda spark: f"{tmp_path}/docs")
    tables = odd_documents(spark, tmp_path)
    same(catalogue.queries()["src6_read_documents"](spark, str(tmp_path)), tables, catalogue.oracle_sql()["src6_read_documents"])
    assert len(paths) == 5 and len(set(paths)) == 5
    # neither the driver nor Hadoop's local file system makes the files: no checksums beside them, nothing unfinished
    assert len(list(tmp_path.glob("docs/folder=*/*.txt"))) == 14 and not list(tmp_path.glob("docs/folder=*/.*"))


def test_no_documents(spark, tmp_path):
    tables = odd_documents(spark, tmp_path)
    tables.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT 1 AS doc_id, 'x' AS text WHERE false")
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    same(catalogue.queries()["src6_read_documents"](spark, str(tmp_path)), tables, catalogue.oracle_sql()["src6_read_documents"])


def test_packed_and_plain_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("x\r\né".encode())
    (tmp_path / "b.md").write_bytes(" 　".encode())
    (tmp_path / "c.md.gz").write_bytes(gzip.compress(b"packed\n"))
    assert {tuple(r) for r in S.read_documents(spark, str(tmp_path)).collect()} == {("a.md", "x\r\né"), ("c.md.gz", "packed\n")}


def test_documents_in_another_store(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.docs.link./in", f"file://{tmp_path}")
    docs = spark.createDataFrame([("0-1", 1, "a\nb"), ("0-1", 2, None), ("0-2", None, "c")], "folder string, doc_id long, text string")
    S.write_documents(docs, "viewfs://docs/in/d")
    assert len(list(tmp_path.glob("d/folder=*/*.txt"))) == 3
    assert {r["text"] for r in S.read_documents(spark, "viewfs://docs/in/d", "\u0001").collect()} == {"a\nb", "c"}
