import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import extract, queries

SF = "/root/testdata/sf0.01"


def shown(page):
    return [t for t, _, _ in extract.leaf_blocks(page)]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<html><head><title>T</title><meta charset=x><body><p>a</p>", ["a"]),
        ("<head><title>T</title><style>s</style><p>a<p>b", ["a", "b"]),
        ("<head><link rel=x>Hello <b>you</b><p>b", ["Hello you", "b"]),
        ("<head><template><div>x</div></template><title>T</title></head><p>b", ["b"]),
        ("<title>T<p>a</p>", ["a"]),
        ("<p>a</p><select><option>x<option>y<p>b</p>", ["a", "b"]),
        ("<p>a</p><div><select><option>x</div><p>b</p>", ["a", "b"]),
        ("<p>a <select><option>x</select> b</p>", ["a b"]),
        ("<iframe src=x><p>a</p>", ["a"]),
        ("<textarea>x</textarea><p>a</p>", ["a"]),
        ("<div><noscript>x</div><p>a</p>", ["a"]),
        ("<object data=x><p>a</p></object><p>b</p>", ["a", "b"]),
        ("<p>Area <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <svg><text>label</text></svg></p>", ["Area x=2 and label"]),
        ("<p>a</p><script>if (a < b) '</p>'<p>x", ["a"]),
        ("<p>a &lt;b&gt; &amp;amp; c</p><!-- <p>x</p> --><p>b", ["a <b> &amp; c", "b"]),
        ("", []),
        ("<", ["<"]),
    ],
)
def test_hidden_elements_end_as_in_html(page, want):
    assert shown(page) == want


def test_pages_without_an_end_of_the_head(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    labelled = pages.withColumn("doc_id", queries._named_document())
    chain = extract.fit(labelled, spark.read.parquet(f"{SF}/documents.parquet"))
    cut = pages.withColumn("html", F.regexp_replace("html", "(?i)</head>|</title>", ""))
    texts = lambda df: {r["page_id"]: r["text"] for r in extract.extract(df, chain).collect()}
    whole, less = texts(pages), texts(cut)
    assert sum(whole[i] == less[i] for i in whole) > 0.99 * len(whole)


def test_real_pages_alone_teach_the_chain(spark):
    """Accuracy on labelled pages that weren't trained on, without any made-up page."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("doc_id", queries._named_document())
    rows = pages.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("whole")), "doc_id").orderBy("page_id").collect()
    made = [m for m in (extract.labelled(r["html"], r["whole"] or "") for r in rows) if m]
    train, test = made[::2], made[1::2]
    chain = extract.train(train)
    right = sum(chain.decode(f) == y for f, y in test) / len(test)
    assert len(test) > 50 and right > 0.95


def test_repeated_pages_ties_and_an_empty_table(spark):
    chain = extract.train(extract.templates(60))
    page = "<article><h1>Head</h1><p>Some words of the story, long enough to be a sentence of it.</p></article>"
    df = spark.createDataFrame([(1, "u", page)] * 3 + [(1, "v", page), (2, "u", "")], "page_id long, url string, html string")
    got = extract.extract(df, chain).collect()
    assert len(got) == 5 and len({r["text"] for r in got if r["page_id"] == 1}) == 1 and re.match("Head\n", got[0]["text"])
    assert extract.extract(df.limit(0), chain).count() == 0
    assert extract.fit(df.limit(0).withColumn("doc_id", F.lit(1)), df.limit(0).select(F.lit(1).alias("doc_id"), F.col("html").alias("text"))).weights
