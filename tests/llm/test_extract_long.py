from ledgerline.llm import extract


def marks(text):
    return next(f for f in extract.features([(text, frozenset(), 0.0)])[0] if f.startswith("marks:"))


def test_marks_of_a_long_block_count_all_of_it():
    names, prose = "name " * 400, "So, it went on. " * 2000
    assert marks(names + prose) == marks(prose) != marks(names)
    assert marks("So, it went on. " * 125 + "name " * 20_000) == marks(names)


def test_long_pages_train(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(extract, "templates", list)
    monkeypatch.setattr(extract, "train", lambda made: seen.append(made))
    line = "Some words of the story, long enough to be a sentence of it. "
    texts = [(i, "\n".join(f"{line}{i} {k}" for k in range(n))) for i, n in ((1, 5), (2, 2000))]
    pages = [(i, i, "<article>" + "".join(f"<p>{x}</p>" for x in t.split("\n")) + "</article>") for i, t in texts]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    df = spark.createDataFrame(pages, "page_id long, doc_id long, html string")
    extract.fit(df, documents)
    assert sorted(len(y) for _, y in seen[0]) == [5, 2000]
    extract.fit(df, documents, sample_bytes=20_000)
    assert [len(y) for _, y in seen[1]] == [5]
