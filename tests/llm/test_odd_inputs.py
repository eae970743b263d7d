"""Training rows that don't depend on how tables are dealt out, and media without content."""

import pytest

from ledgerline.llm import extract, ogg

PAGES = "page_id long, doc_id long, html string, key string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, i % 20, f"<p>page {i}</p>", "k") for i in range(40)]
    rows += [(3, 5, "<p>another page 3</p>", "k"), (3, 5, "<p>another page 3</p>", "k"), (None, 4, "<p>no id</p>", "k"), (None, 4, "<p>nor here</p>", "k"), (50, None, "<p>x</p>", "k"), (51, 2, None, "k"), (52, 999, "<p>y</p>", "k")]
    return spark.createDataFrame(rows, PAGES)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, f"text {i}") for i in range(20)] + [(i, f"second text {i}") for i in range(0, 20, 2)] + [(1, None), (2, ""), (None, "of none")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sample,most", [(1000, 1 << 20), (10, 1 << 20), (1000, 200)])
def test_the_same_sample_however_rows_lie(pages, documents, sample, most):
    first = rows(extract.labelled_sample(pages, documents, sample, most))
    for n in (1, 5):
        turned = pages.orderBy("html", ascending=False).repartition(n, "html"), documents.orderBy("text", ascending=False).repartition(n, "text")
        assert rows(extract.labelled_sample(*turned, sample, most)) == first
    assert len({r[0] for r in first}) == len(first) <= sample
    assert sum(len(r[1]) for r in first) <= most and sum(len(r[2]) for r in first) <= most
    # nothing less than the whole, where no bound is met: 40 pages and the one without an id
    assert len(first) == (41 if (sample, most) == (1000, 1 << 20) else len(first)) and first


def test_no_pages_no_sample(pages, documents):
    assert rows(extract.labelled_sample(pages.limit(0), documents, 10, 100)) == []
    assert rows(extract.labelled_sample(pages, documents.limit(0), 10, 100)) == []


def test_null_media_give_nulls(spark):
    media = ogg.write_media(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string"))
    both = media.unionByName(media.where("doc_id = 1").selectExpr("7L AS doc_id", "5L AS n_bytes", "CAST(NULL AS BINARY) AS media"), allowMissingColumns=True)
    got = {r["doc_id"]: r for r in ogg.read_media(both).collect()}
    assert tuple(got[7]) == (7, 5, None, None, None, None, None, None)
    assert got[1]["payload_bytes"] == got[2]["payload_bytes"] == 192 and got[2]["n_bytes"] == 0
