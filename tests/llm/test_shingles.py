import random

import pytest

from ledgerline.llm import shingles


def reference_groups(rows):
    """Components over all pairs whose five-word shingles have a Jaccard similarity of 0.8 or more."""

    def own(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, label = [own(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    return label


def survivors(rows):
    first = {}
    for row, k in zip(rows, reference_groups(rows)):
        first[k] = min(first.get(k, row), row)
    return sorted(i for i, _ in first.values())


def made(rng):
    """Texts with one to many words replaced, cut or moved, short ones, shared passages, and a large group."""
    word = lambda: f"w{rng.randrange(4000)}"
    text = lambda n: [word() for _ in range(n)]
    passage, texts = text(60), []
    for n in (4, 5, 6, 12, 30, 100, 100, 300):
        for _ in range(3):
            base = text(n)
            texts.append(base)
            for edits in (1, 1, 2, 3, 5, 8):
                other = list(base)
                for _ in range(edits):
                    other[rng.randrange(len(other))] = word()
                texts += [other, base[edits:], base + text(edits)]
    texts += [text(rng.randrange(20, 80)) + passage + text(rng.randrange(20, 80)) for _ in range(40)]
    base = text(120)
    for _ in range(60):
        other = list(base)
        other[rng.randrange(len(other))] = word()
        texts.append(other)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, " \n"), (9003, texts[0][0].upper()), (9004, texts[0][0])]
    return rows


@pytest.mark.parametrize("long,block", [(32, 5000), (2, 7)])
def test_near_copies_against_all_pairs(spark, monkeypatch, long, block):
    monkeypatch.setattr(shingles, "LONG", long)
    monkeypatch.setattr(shingles, "BLOCK", block)
    rows = made(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in shingles.keep_one(docs).collect()) == survivors(rows)


def test_lists_lose_no_shared_shingle(spark):
    rng = random.Random(4)
    rows = [(k, sorted({rng.randrange(400) for _ in range(rng.randrange(1, 9))})) for k in range(120)]
    held = {}
    for k, first in rows:
        for g in first:
            held.setdefault(g, set()).add(k)
    kinds = spark.createDataFrame([(k, len(f), f) for k, f in rows], "k long, n int, first array<long>")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for size in ("1", "2", "3", "10000"):
        spark.conf.set(name, size)
        found = {}
        for r in shingles._lists(kinds).collect():
            assert rows[r["k"]][1][r["at"] - 1] == r["g"]
            found.setdefault(r["g"], set()).add(r["k"])
        spark.conf.unset(name)
        assert {g: ks for g, ks in held.items() if len(ks) > 1} == {g: ks for g, ks in found.items() if len(ks) > 1}
        assert sum(len(ks) == 1 for ks in found.values()) <= 8  # partitions' ends only


def test_phrases_come_last_in_large_tables_too(spark):
    """Phrases that 60 texts share don't make lists in a table of 256,000 rows, of which 3000 are here."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**9)}"
    phrases = [[word() for _ in range(24)] for _ in range(50)]
    rows = [(i, " ".join([word() for _ in range(30)] + phrases[i % 50] + [word() for _ in range(30)])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = shingles._sets(docs, shingles._common(docs, 256_000)).collect()
    late = sum(r["late"] for r in sets)
    assert 0.9 * 3000 * 20 <= late <= 1.1 * 3000 * 20
    met = {}
    for r in sets:
        for g in r["first"]:
            met[g] = met.get(g, 0) + 1
    assert sum(n * (n - 1) // 2 for n in met.values()) <= 0.1 * 3000 * 60


def test_rounds_of_components_have_small_plans(spark, monkeypatch):
    from ledgerline.llm import common

    exchanges, keep = [], common.written

    def noted(df):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return keep(df)

    monkeypatch.setattr(common, "written", noted)
    found = common.components(spark.createDataFrame([(k, k + 1) for k in range(9)] + [(20, 22), (22, 21)], "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == dict.fromkeys(range(10), 0) | dict.fromkeys((20, 21, 22), 20)
    assert max(exchanges) <= 6


def test_one_word_replaced_in_a_hundred_is_a_near_copy(spark):
    import corpus_pipeline

    rng = random.Random(1)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((2 * i, " ".join(words)))
        words[50] = "other"
        rows.append((2 * i + 1, " ".join(words)))
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 80, 2))


def test_texts_of_pairs_come_in_small_batches(spark, monkeypatch, tmp_path):
    """40 texts that are alike, each of 90,000 random words, are packed once and never held together."""
    pieces = shingles._pieces

    def noted(batches, rows=256):
        import uuid

        def seen():
            for batch in batches:
                (tmp_path / uuid.uuid4().hex).write_text(f"{'+'.join(batch.schema.names)} {batch.nbytes} {batch.num_rows}")
                yield batch

        return pieces(seen(), rows)

    monkeypatch.setattr(shingles, "_pieces", noted)
    rng = random.Random(7)
    base = [f"{rng.randrange(16**8):x}" for _ in range(90_000)]
    rows = []
    for i in range(40):
        base[rng.randrange(len(base))] = f"other{i}"
        rows.append((i, " ".join(base)))
    kept = shingles.keep_one(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert [r["doc_id"] for r in kept.select("doc_id").collect()] == [0]
    found = [p.read_text().split() for p in tmp_path.iterdir()]
    text = max(len(t) for _, t in rows)
    assert max(int(n) for _, n, _ in found) <= (4 << 20) + 2 * text + 4096
    assert sum(int(n) for names, _, n in found if names == "id+text+first_t") == 40
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
