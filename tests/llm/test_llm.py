import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pandas as pd
import pytest
import zstandard
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm import bpe, common, extract, mixing, neighbours, ogg, pitman_yor, queries, simhash, suffix, toxicity, urlfilter
from tests.compare import duck, same
from tests.llm.test_shingles import survivors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names operators might use themselves.
CLASHES = ["doc", "t", "fp", "component", "size", "bucket", "position", "chunk", "part", "score", "held_out", "train", "ids", "marks", "node"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls anywhere, empty and long texts, ties, repeated rows, and columns with clashing names."""
    random.seed(5)
    words = ["".join(random.choice("abcdeé") for _ in range(random.randrange(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    passage = text(90)
    rows = [(i, text(random.randrange(1, 40)), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, text(5) + " " + passage + " " + text(5), "en", "s0") for i in range(4)]
    rows += [(200, rows[0][1], "en", "s1"), (3, rows[3][1], "en", "s3"), (3, rows[3][1], "en", "s3"), (3, "other words", "en", "s2"), (None, rows[1][1], None, None), (None, None, None, None), (300, None, None, "s9"), (301, "", "en", ""), (302, " \n\t ", "en", "s9"), (303, "word " * 30_000, "fr", "s9"), (304, "x" * 50_000, "fr", "s9"), (305, "<|endoftext|>\x00 A\u3000B", "fr", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASHES})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return collections.Counter(map(tuple, rows))


def test_suffixes_from_a_table(spark):
    """Rows of a list of public suffixes, with wildcards and exceptions, against a loop over a host's endings."""
    rules = ["com", "co.uk", "uk", "*.ck", "!www.ck", "*.b.c", "x.y.b.c", None, "", "co.uk", "NET"]
    hosts = ["a.b.co.uk", "co.uk", "uk", "www.ck", "q.www.ck", "a.b.ck", "b.ck", "ck", "p.q.b.c", "p.x.y.b.c", "b.c", "no.rule", "single", "1.2.3.4:80", "u@m.net:8", "[::1]:80", "..", "a..com"]

    def plain(host: str) -> tuple[str, str]:
        bare = host.split("@")[-1]
        bare = bare.rsplit(":", 1)[0] if ":" in bare and bare.rsplit(":", 1)[1].isdigit() else bare
        if bare.startswith("[") or bare.replace(".", "").isdigit():
            return bare, bare
        parts, known, taken = bare.split("."), {r.lower() for r in rules if r}, 1
        for k in range(1, len(parts) + 1):
            end = parts[-k:]
            if ".".join(end) in known or ".".join(["*", *end[1:]]) in known:
                taken = max(taken, k)
        for k in range(2, len(parts) + 1):
            if "!" + ".".join(parts[-k:]) in known:
                taken = k - 1
        return ".".join(parts[-taken:]), ".".join(parts[-taken - 1 :])

    table = spark.createDataFrame([(r,) for r in rules], "suffix string")
    found = urlfilter.registered(spark.createDataFrame([(h,) for h in hosts], "host string"), table).collect()
    assert {r["host"]: (r["suffix"], r["domain"]) for r in found if r["host"] != ".."} == {h: plain(h) for h in hosts if h != ".."} and len(found) == len(hosts)
    outcomes = spark.createDataFrame([("a.x.ck", 1)] * 9 + [("b.y.ck", 0)] * 9, "host string, bad int")
    above = {r["host"]: r["above"] for r in urlfilter.reputation(outcomes, 0.5, table).collect()}
    assert above["a.x.ck"] > 0.95 and above["b.y.ck"] < 0.05
    assert urlfilter.reputation(outcomes, 0.5, table.limit(0)).count() == 2 and urlfilter.reputation(outcomes.limit(0), 0.5, table).count() == 0


@pytest.mark.parametrize("name", ["op2_url_reputation", "op9_curriculum_mix"])
def test_sql(spark, name):
    same(queries.queries()[name](spark, SF), duck(SF), queries.oracle_sql()[name])


# 1


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op1_toxicity_nnpu(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = scored.where("held_out").join(labels, "doc_id").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in got)
    assert hit / sum(r["predicted"] for r in got) > 0.95 and hit / sum(r["toxic"] for r in got) > 0.85
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored.limit(500).collect())


def test_toxicity_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (None, 1), (5, None), (9, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).count() == odd.count()
    empty = toxicity.fit(odd, labels.limit(0))
    assert toxicity.reject(odd, empty).columns == odd.columns and toxicity.reject(odd, empty).count() == odd.count()
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_nnpu_finds_the_positives_among_the_unlabelled():
    rng = random.Random(2)
    doc = lambda bad: {f"w{rng.randrange(300)}" for _ in range(30)} | ({f"bad{rng.randrange(4)}"} if bad else set())
    model = toxicity.train([doc(True) for _ in range(200)], [doc(i % 5 == 0) for i in range(1000)], 0.2)
    probability = lambda d: model.bias + sum(model.weights.get(f, 0) for f in d)
    assert all(probability(doc(True)) > 0 for _ in range(50)) and sum(probability(doc(False)) > 0 for _ in range(50)) == 0


def test_nnpu_corrects_a_negative_part_and_weighs_both_ways():
    rng = random.Random(3)
    doc = lambda bad: {f"w{rng.randrange(40)}" for _ in range(6)} | ({f"bad{rng.randrange(4)}"} if bad else {f"good{rng.randrange(4)}"})
    positive, unlabelled = [doc(True) for _ in range(100)], [doc(i % 5 == 0) for i in range(200)]
    model = toxicity.train(positive, unlabelled, 0.3, sparsity=0.0)  # a prior above the true share drives the second part below zero
    assert model.corrected > 0 and min(model.weights.values()) < 0 < max(model.weights.values())
    assert model.weights["bad0"] > 0 > model.weights["good0"]


def test_every_feature_of_enough_texts_is_weighed(spark):
    """60,000 words in eight texts each: the one that tells toxic texts is the last by name, and counts."""
    block = lambda i: " ".join(f"w{k}" for k in range(i % 6 * 10_000, i % 6 * 10_000 + 10_000))
    docs = spark.createDataFrame([(i, block(i) + (" zzz" if i < 24 else "")) for i in range(120)], "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") < 24).cast("int").alias("toxic")))
    assert model.weights["zzz"] == max(model.weights.values()) > 0 and model.score("w1 zzz") > 0.5 > model.score("w1")


def test_toxicity_of_one_sided_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} other text here") for i in range(60)] + [(1, "more of the same id")] * 3, "doc_id long, text string")
    every = toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")))
    assert {r["predicted"] for r in toxicity.score(docs, every).collect()} == {1}
    none = toxicity.fit(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert {r["predicted"] for r in toxicity.score(docs, none).collect()} == {0} and none.weights == {}


# 2


def test_hosts_rules_and_shrinkage(spark):
    urls = [None, "", "nothing", "http://A.Example.ORG/es/1?x", "https://org#f", "ftp://x.com/fr", "ftp://x.com/fr/", "a://b.com/de/1", "http://h.net", "http://example.org/en/12", "x://?q"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[10] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[4][2:] == (None, "allow")
    assert got[5][2] is None and got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block") and got[9][2:] == ("example.org/en/1", "block")
    outcomes = spark.createDataFrame([("a.x.net", 1)] * 30 + [("b.x.net", 1)] + [(f"h{i}.y.net", 0) for i in range(60)], "host string, bad int")
    above = {r["host"]: r["above"] for r in urlfilter.reputation(outcomes, 0.5).collect()}
    assert above["a.x.net"] > above["b.x.net"] > 0.5 > above["h1.y.net"]


def test_beta_probabilities(spark):
    """Against draws from the beta distribution, from lopsided small parameters to large ones."""
    rng = np.random.default_rng(8)
    cases = [(a, b, x) for a, b in ((0.02, 3.0), (0.5, 0.5), (2.0, 5.0), (30.0, 4.0), (2600.0, 7400.0), (1e5, 3e5)) for x in (0.05, 0.25, 0.6)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a double, b double").distinct()
    for x in (0.05, 0.25, 0.6):
        got = {(r["a"], r["b"]): r["p"] for r in df.select("a", "b", urlfilter.above(F.col("a"), F.col("b"), x).alias("p")).collect()}
        for (a, b), p in got.items():
            assert abs(p - (rng.beta(a, b, 200_000) > x).mean()) < 0.006, (a, b, x)


def test_suffixes_and_odd_pages(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "u:p@www.x.com:8080", "1.2.3.4:80", "[::1]:80", "localhost", "x.com"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r[0]: (r[1], r[2]) for r in df.select("host", *urlfilter.suffix_and_domain(F.col("host"))).collect()}
    assert got["a.b.co.uk"] == got["b.co.uk"] == ("co.uk", "b.co.uk") and got["u:p@www.x.com:8080"] == got["x.com"] == ("com", "x.com")
    assert got["1.2.3.4:80"] == ("1.2.3.4", "1.2.3.4") and got["localhost"] == ("localhost", "localhost")
    pages = spark.createDataFrame([(1, "http://h.net/a"), (1, "http://h.net/a"), (1, "http://i.net"), (None, "http://h.net"), (2, None)], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "page_id long, bad int")
    judged = urlfilter.judge(pages, outcomes).collect()
    assert len(judged) == 5 and {r["host_pages"] for r in judged if r["host"] == "h.net"} == {2}
    assert urlfilter.judge(pages.limit(0), outcomes).count() == 0 and urlfilter.judge(pages, outcomes.limit(0)).count() == 5


# 3


def bitwise_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_pages():
    assert all(ogg.page_checksum(d) == bitwise_crc(d) for d in (b"", b"a", bytes(range(256)), b"OggS" * 40))
    for n in (192, 4800, 192 * 400):
        payload = random.Random(n).randbytes(n)
        media = ogg.encode(payload)
        assert ogg.decode(media)[0] == payload
        for bad in (media[:-1], media[1:], media[: n // 2] + bytes([media[n // 2] ^ 1]) + media[n // 2 + 1 :]):
            with pytest.raises(ValueError):
                ogg.decode(bad)
    media = ogg.encode(random.Random(1).randbytes(192 * 2010))
    facts = ogg.decode(media)[1]
    assert facts["seconds"] == 192 * 2010 / ogg.RATE and facts["cue_seconds"] == [*(4800 * 8 * k / ogg.RATE for k in range(1, 11)), facts["seconds"]]
    at, seen = 0, set()
    while at < len(media):  # a false granule position, with a right checksum, in each page that has one
        _, _, flags, granule, serial, number, _, n = ogg.HEAD.unpack_from(media, at)
        end = at + ogg.HEAD.size + n + sum(media[at + ogg.HEAD.size : at + ogg.HEAD.size + n])
        if granule != -1:
            page = media[at : at + 6] + (granule + 12345).to_bytes(8, "little") + media[at + 14 : at + 22] + b"\0\0\0\0" + media[at + 26 : end]
            page = page[:22] + ogg.page_checksum(page).to_bytes(4, "little") + page[26:]
            with pytest.raises(ValueError):
                ogg.decode(media[:at] + page + media[end:])
            seen.add(serial)
        at = end
    assert seen == {ogg.SAMPLES, ogg.CUES}
    writer = ogg.StreamWriter(5, 4)
    packets = [b"x" * n for n in (0, 254, 255, 256, 5000, 1)]
    for i, p in enumerate(packets):
        writer.add(p, i)
    writer.flush(last=True)
    assert ogg.demultiplex(b"".join(writer.pages))[5]["packets"] == packets


def test_ogg_columns(odd):
    got = ogg.read_media(ogg.write_media(odd)).collect()
    want = []
    for doc_id, text in texts(odd):
        raw = text.encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        want.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert ogg.read_media(ogg.write_media(odd.limit(0))).count() == 0
    assert bag(r[:5] for r in got) == bag(want) and len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got}) == len({r["payload_sha256"] for r in got})


# 4


def reference_components(fps, ids):
    near = np.bitwise_count(fps[:, None] ^ fps) <= 4
    label = np.arange(len(fps))
    while not np.array_equal(after := np.where(near, label, len(fps)).min(1), label):
        label = after
    named = {k: min((i for i, lab in zip(ids, label) if lab == k and i is not None), default=None) for k in set(label.tolist())}
    return [named[k] for k in label.tolist()]


def reference_fingerprint(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_simhash_against_all_pairs(request, table):
    docs = request.getfixturevalue(table)
    pairs = texts(docs)
    fps = np.array([reference_fingerprint(t) for _, t in pairs], np.uint64)
    want = [(i, f"{int(f):016x}", c) for (i, _), f, c in zip(pairs, fps, reference_components(fps, [i for i, _ in pairs]))]
    assert bag(simhash.near_duplicates(docs).collect()) == bag(want)


def test_vantage_shards_lose_no_pair():
    rng = np.random.default_rng(3)
    for most in (60, 200, 700):
        x = rng.integers(0, 2**63, 900, dtype=np.int64).view(np.uint64)
        dense = x[0] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
        x = np.unique(np.concatenate([x, dense]))
        at, shard, side = simhash.Shards(rng.choice(x, 500, replace=False), len(x), most, 4).assign(x)
        met = np.zeros((len(x), len(x)), int)
        for k in np.unique(shard):
            groups = [at[(shard == k) & (side == s)] for s in range(3)]
            met[np.ix_(groups[0], groups[0])] += 1
            met[np.ix_(groups[1], groups[2])] += 1
            met[np.ix_(groups[2], groups[1])] += 1
        near = np.bitwise_count(x[:, None] ^ x) <= 4
        assert (met[near] == 1).all()


def test_views_lose_no_pair():
    rng = np.random.default_rng(5)
    masks = simhash.parts()
    assert sum(masks) == simhash.ALL and all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])
    base = rng.integers(0, 2**63, 400, dtype=np.int64).view(np.uint64)
    x = base.repeat(4)
    for k in range(4):  # up to four bits away from where they came from
        flip = rng.random(len(x)) < 0.8
        x = np.where(flip, x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)), x)
    x = np.unique(np.concatenate([base, x]))
    met = np.zeros((len(x), len(x)), bool)
    for mask in masks:
        at, shard, side = simhash.Shards(x, len(x), 100, 1, mask).assign(x)
        for k in np.unique(shard):
            groups = [at[(shard == k) & (side == s)] for s in range(3)]
            for a, b in ((0, 0), (1, 2), (2, 1)):
                met[np.ix_(groups[a], groups[b])] = True
        found = simhash.Linker(x, 4, 1, mask)
        found.close(np.arange(len(x)))
    near = np.bitwise_count(x[:, None] ^ x) <= 4
    assert met[near].all() and near.sum() > 2 * len(x)


def test_copies_of_fingerprints_grow_slowly():
    """How many shards a random fingerprint goes to, in trees laid out for 1 and for 64 million of them: a power below 1.4."""
    rng = np.random.default_rng(12)
    asked, copies = rng.integers(0, 1 << 64, 2000, np.uint64), []
    for total in (1_000_000, 64_000_000):
        most, sample = simhash.scaled(total)
        assert (most, sample) == (20_000 * int(total**0.5) // 1000, 8192 * int(total**0.5) // 1000)
        tree = simhash.Shards(rng.integers(0, 1 << 64, sample, np.uint64), total, most, 1, simhash.parts()[0])
        copies.append(len(tree.assign(asked)[0]) / len(asked))
    assert copies[1] < copies[0] * 64**0.4
    assert simhash.scaled(10) == (20_000, 8192)


def test_components_of_long_chains(spark):
    edges = spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    got = common.components(edges).collect()
    assert len(got) == 301 and {r["component"] for r in got} == {0}


def test_keep_one_keeps_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    left, every = simhash.near_duplicates(kept), simhash.near_duplicates(odd)
    prints = lambda df: {r["fingerprint"] for r in df.collect()}
    groups = reference_components(np.array([int(r["fingerprint"], 16) for r in every.collect()], np.uint64), list(range(every.count())))
    assert kept.count() == len(prints(left)) == len(set(groups))


# 5


def reference_removal(docs, length=200):
    raws = [t.encode() for _, t in docs]
    count = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc_id, _), r in zip(docs, raws):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((doc_id, len(r), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("bucket_rows", [20_000, 1, 3])
def test_repeats_against_every_string(spark, odd, documents, bucket_rows, monkeypatch):
    whole = suffix.repeats
    monkeypatch.setattr(suffix, "repeats", lambda docs, length: whole(docs, length, bucket_rows=bucket_rows))
    small = odd.where("text IS NULL OR length(text) < 3000").union(spark.createDataFrame([(900, "ab" * 300, "en", "s"), (901, "q" * 200, "en", "s"), (902, "q" * 199, "en", "s")], "doc_id long, text string, lang string, source string").withColumns({c: F.lit(7) for c in CLASHES}))
    for docs in (small, documents):
        assert bag(suffix.remove_repeats(docs).collect()) == bag(reference_removal(texts(docs)))
    kept = suffix.remove_repeats(small, keep_text=True)
    assert kept.columns == small.columns and kept.count() == small.count()
    assert suffix.remove_repeats(small.limit(0)).count() == 0


def test_deep_shallow_order_is_suffix_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (400, 90)).astype(np.uint8)
    rows[:, :80] = rows[rng.integers(0, 5, 400), :80]
    group = rng.integers(0, 3, 400)
    order = suffix.deep_shallow_order(rows, group)
    assert [(group[i], rows[i].tobytes()) for i in order] == sorted((g, r.tobytes()) for g, r in zip(group, rows))


# 6


def test_language_model(odd, documents):
    for docs in (odd, documents):
        pairs = texts(docs)
        tokens = [WORD.findall(lower(t)) + [None] for _, t in pairs]
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in pairs]
        count = collections.Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
        n, v = sum(count.values()), len(count)
        base = [sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) for ws in tokens]
        got = pitman_yor.score(docs).collect()
        want = bag((i, h, len(ws), sum(count[w] > 0 for w in ws), n, round(b, 3)) for (i, _), h, ws, b in zip(pairs, held, tokens, base))
        assert bag((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
        assert all(r["score"] < 0 for r in got)
    test = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
    again = {r["doc_id"]: r["score"] for r in pitman_yor.score(documents.repartition(7)).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 * abs(r["score"]) for r in got)


def test_language_model_without_training_rows(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert {r["train_tokens"] for r in pitman_yor.score(docs).collect()} == {0}
    assert pitman_yor.score(docs.limit(0)).count() == 0


def seatings(n):
    """Every way of seating n customers: the sizes of the tables."""
    if n == 0:
        yield []
        return
    for sizes in seatings(n - 1):
        for k in range(len(sizes)):
            yield sizes[:k] + [sizes[k] + 1] + sizes[k + 1 :]
        yield [*sizes, 1]


@pytest.mark.parametrize("discount, new", [(0.3, 0.05), (0.3, 6.0), (0.7, 0.7), (0.9, 2.0)])
def test_seating_follows_the_restaurant(discount, new, monkeypatch):
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 7):  # every seating, weighed by its tables
        law = collections.Counter()
        for sizes in seatings(n):
            law[len(sizes)] += math.prod(math.prod(j - discount for j in range(1, k)) for k in sizes) * new ** len(sizes)
        drawn = collections.Counter(pitman_yor.seat(np.full(40_000, n), np.full(40_000, new), discount, rng).tolist())
        for t, weight in law.items():
            p = weight / sum(law.values())
            assert abs(drawn[t] / 40_000 - p) < 5 * math.sqrt(p * (1 - p) / 40_000) + 1e-9
    # parties beyond the tabulated numbers
    for n, weight in ((100, new), (128, new * 20)):
        p = pitman_yor.log_stirling(discount)[n, 1 : n + 1] + math.log(weight) * np.arange(1, n + 1)
        p = np.exp(p - p.max())
        p /= p.sum()
        mean = (p * np.arange(1, n + 1)).sum()
        spread = math.sqrt((p * np.arange(1, n + 1) ** 2).sum() - mean**2)
        with monkeypatch.context() as m:
            m.setattr(pitman_yor, "EXACT", 50)
            t = pitman_yor.seat(np.full(40_000, n), np.full(40_000, weight), discount, rng)
        assert abs(t.mean() - mean) < 0.1 + 0.06 * mean and abs(t.std() - spread) < 0.1 + 0.12 * spread
    assert pitman_yor.seat(np.array([0, 10**12]), np.full(2, 0.5), discount, rng)[0] == 0


def test_probabilities_of_every_context_add_up_to_one():
    texts_ = [b"a b a b c", b"a b d", b"", b"c c c c c c c", b"a b a b c", b"e"]
    none = np.zeros(0, np.uint64)
    hashes, doc = pitman_yor.token_hashes(texts_)
    two, one = pitman_yor.contexts(hashes, doc, none, pitman_yor.Hot(none, none, none, none))
    start = int(pitman_yor.START)
    assert [int(x) for x in one[:2]] == [start, int(hashes[0])] and [int(x) for x in two[:3]] == [start, start, int(hashes[0])]
    kinds, (token, before, second) = pitman_yor.places(hashes, one, two)
    assert (kinds[token] == hashes).all() and (kinds[before] == one).all() and (kinds[second] == two).all()
    own = pitman_yor.Part([pitman_yor.pack(second, before, token, np.ones(len(doc), np.int64), doc, kinds)])
    assert own.n3.sum() == len(hashes)
    pairs = pitman_yor.pack(second[:0], before, token, np.ones(len(doc), np.int64), doc[:0], kinds)
    [[words, count, customers]] = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint64).reshape(3, -1) for b in pitman_yor.asked(pd.DataFrame({"part": [0], "train": [True], "blob": [pairs]}), 1)["words"]]
    assert dict(zip(words.tolist(), count.tolist())) == collections.Counter(hashes.tolist())
    assert dict(zip(words.tolist(), customers.tolist())) == collections.Counter(w for _, w in {*zip(one.tolist(), hashes.tolist())})
    state = pitman_yor.State(int(count.sum()), len(words), int(customers.sum()), len(words), 0.6)
    settings = pitman_yor.Settings()
    p1 = state.probability(customers.astype(np.int64), np.ones(len(words), np.int64), settings.strengths[0])
    unknown = state.probability(np.zeros(1, np.int64), np.zeros(1, np.int64), settings.strengths[0])
    assert abs(p1.sum() + unknown[0] - 1) < 1e-12
    own.known(words, p1)
    rng = np.random.default_rng(4)
    models = []
    for _ in range(3):
        own.sweep(settings, rng)
        assert (own.t3 <= own.n3).all() and (own.t3 >= 1).all() and (own.t2 <= own.n2).all() and (own.t2 >= 1).all()
        models.append(own.predictive(settings))
    token, p = np.append(words, np.uint64(99)), np.append(p1, unknown)
    for x, y in {*zip(two.tolist(), one.tolist()), (5, int(one[1])), (5, 6)}:
        every = own.probability(models, np.full(len(token), x, np.uint64), np.full(len(token), y, np.uint64), token, p)
        assert abs(every.sum() - 1) < 1e-9 and every.min() > 0


def test_many_parts_and_common_contexts(spark, documents):
    rows = documents.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, "same " * 300) for i in range(60)], "doc_id long, text string"))
    whole = {r["doc_id"]: r for r in pitman_yor.score(rows).collect()}
    parts = {r["doc_id"]: r for r in pitman_yor.score(rows, part_bytes=200_000).collect()}
    assert whole.keys() == parts.keys()
    for i, r in whole.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (parts[i]["n_tokens"], parts[i]["n_known"], parts[i]["train_tokens"])
        assert abs(r["base_score"] - parts[i]["base_score"]) < 1e-6 * abs(r["base_score"])
    assert abs(sum(r["score"] for r in whole.values()) / sum(r["score"] for r in parts.values()) - 1) < 0.02


def test_copies_are_told_apart(documents):
    again = documents.select((F.col("doc_id") + 50_000).alias("doc_id"), "text").where(F.pmod("doc_id", F.lit(10)) == 0)
    got = pitman_yor.score(documents.select("doc_id", "text").union(again)).where("n_tokens > 30").collect()
    ids = {r["doc_id"] - 50_000 for r in got}
    rate = lambda rows: np.array([r["score"] / r["n_tokens"] for r in rows])
    twice, once = rate([r for r in got if not r["held_out"] and r["doc_id"] in ids]), rate([r for r in got if not r["held_out"] and r["doc_id"] < 50_000 and r["doc_id"] not in ids])
    assert np.median(twice) > np.median(once)


# 7


def test_greedy_search_finds_what_is_near():
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(40, 24))
    x = np.concatenate([m + rng.normal(size=(30, 24)) * 0.25 for m in middle])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbours.robust_prune(x)
    assert (graph >= 0).sum(1).max() < 200 and (graph >= 0).sum(1).min() > 0
    cosine = x @ x.T
    want = {(i, j) for i, j in zip(*np.nonzero(cosine >= 0.8))}
    got = set(zip(*(a.tolist() for a in neighbours.range_search(x, graph, x, 0.8))))
    assert got <= want and len(got) > 0.97 * len(want)


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = base[:40] + rng.normal(size=(40, 16)) * 0.05
    tight = base[50] + rng.normal(size=(80, 16)) * 0.02
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near, tight, base[:5]]))]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [float("inf")] + [0.0] * 15), (906, [1.0, 0.0]), (907, [2.0, 0.0]), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in CLASHES})
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = [v / np.linalg.norm(v) for _, v in good]
    links = [[k for k, u in enumerate(unit) if k != j and len(u) == len(v) and u @ v >= 0.95] for j, v in enumerate(unit)]
    label = list(range(len(unit)))
    for _ in range(60):
        label = [min([label[j], *(label[k] for k in ks)]) for j, ks in enumerate(links)]
    name = {k: min(i for (i, _), lab in zip(good, label) if lab == k and i is not None) for k in set(label)}
    want = bag([(i, len(ks), name[lab], i == name[lab]) for (i, _), ks, lab in zip(good, links, label)] + [(i, 0, i, True) for i in range(900, 906)])
    found = neighbours.near_duplicates(df)
    assert bag(found.collect()) == want
    assert neighbours.audit(df, found) > 0.99
    for index in ({"shard_rows": 40, "most_rows": 60}, {"shard_rows": 40, "most_rows": 60, "most_centres": 2}, {"shard_rows": 40, "most_rows": 30, "levels": 0}):
        small = neighbours.near_duplicates(df, **index)
        assert sum(r["n_links"] for r in small.collect()) >= 0.9 * sum(len(ks) for ks in links)
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


# 8


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def test_automaton_against_the_library(tokenizer, documents):
    rng = random.Random(1)
    letters = "abcdetsrn'  \n.,1é日😀Ω<|>\x1c\x85\xa0\u3000\u2028"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    made += ["", "aaaaaaaaaaaaaaaaaa", "<|endoftext|>x <|endoftext|>", " a\n\nb  c \n", "it's we'll", "x" * 3000] + [t for _, t in texts(documents)]
    encoder = bpe.Encoder(bpe.load(public_tokenizers.path("byte_bpe_50k.json")), remembered=2000)
    for at in range(0, len(made), 300):
        part = made[at : at + 300]
        want = tokenizer.encode_batch(part, add_special_tokens=False)
        got = encoder.ids_texts(part)
        assert got == [",".join(map(str, w.ids)) for w in want]
        assert [encoder.decode(g) for g in got] == [tokenizer.decode(w.ids, skip_special_tokens=False) for w in want]


def test_automaton_reads_right_tokenizations_only():
    labels = {0: b"a", 1: b"b", 2: b"ab", 3: b"aab", 4: b"aa"}
    auto = bpe.Automaton(labels, [(0, 1, 2), (0, 2, 3), (0, 0, 4)])

    def merged(word):
        ids = [{97: 0, 98: 1}[c] for c in word]
        for u, v, uv in ((0, 1, 2), (0, 2, 3), (0, 0, 4)):
            at, out = 0, []
            while at < len(ids):
                if ids[at : at + 2] == [u, v]:
                    out.append(uv)
                    at += 2
                else:
                    out.append(ids[at])
                    at += 1
            ids = out
        return ids

    for n in range(1, 9):
        for k in range(1 << n):
            word = bytes(97 + (k >> i & 1) for i in range(n))
            assert auto.encode_word(word) == merged(word)
            assert bpe.Tables(auto).encode([word])[0] == ",".join(map(str, merged(word))) if n < 6 else True


def test_encoding_odd_rows(odd, tokenizer):
    got = bpe.encode(odd, public_tokenizers.path("byte_bpe_50k.json"), "both").collect()
    want = [(i, tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts(odd)]
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bag((r["doc_id"], r["n_tokens"], r["ids_sha256"], digest(r["ids"])) for r in got) == bag((i, len(x), digest(x), digest(x)) for i, x in want)


# 9


def reference_targets(sizes, weights):
    total, target, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        share = {i: left * weights[i] / sum(weights[k] for k in open_) for i in open_}
        full = {i for i in open_ if share[i] > 2 * sizes[i]}
        if not full:
            for i in open_:
                target[i] = share[i]
            return target
        for i in full:
            target[i] = 2.0 * sizes[i]
            left -= target[i]
        open_ -= full
    return target


def test_mix_against_dealing_out_again(odd):
    got = mixing.mix(odd).collect()
    count = lambda t: len(WORD.findall(t))
    sources = [(r["doc_id"], r["text"] or "", r["source"]) for r in odd.collect()]
    names = sorted({s for _, _, s in sources if s is not None}) + [None]
    sizes = [sum(count(t) for _, t, s in sources if s == n) for n in names]
    target = dict(zip(names, reference_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])))
    assert bag((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == bag((i, count(t), sizes[names.index(s)], round(target[s], 6)) for i, t, s in sources)
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and 0 <= (r["position"] or 0) <= 1
    assert all(abs(taken[n] - target[n]) <= 0.51 for n in names)
    assert bag(tuple(r) for r in got) == bag(tuple(r) for r in mixing.mix(odd.repartition(5)).collect())
    assert mixing.mix(odd.limit(0)).count() == 0


def test_positions_follow_the_schedule(spark):
    for slope in mixing.SLOPES:
        t = np.linspace(0, 1, 11)
        asked = spark.createDataFrame([(float(x + slope * (x * x - x)),) for x in t], "q double")
        got = [r[0] for r in asked.select(mixing.position(F.col("q"), F.lit(slope))).collect()]
        assert np.allclose(got, t)


def test_mixed_documents(odd):
    out = mixing.mixed(odd)
    assert out.columns == [*odd.columns, "training_position"]
    placed = mixing.mix(odd).select("doc_id", F.expr("int(position IS NOT NULL) + int(position_again IS NOT NULL)").alias("n")).collect()
    copies = collections.Counter()
    for r in placed:
        copies[r["doc_id"]] += r["n"]
    assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter({k: v for k, v in copies.items() if v})


# 10


def test_extraction_against_the_markup(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    good = 0
    for r in queries.op10_crf_extraction(spark, sf).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        good += r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])
    assert good / len(pages) > 0.97


def test_extraction_of_other_pages(spark):
    chain = extract.train(extract.templates())
    say = "Some words of the story, long enough to be a sentence of it. " * 2
    page = f"<html><head><title>T</title></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class='cookie notice'>{say}</div><main><h1>Head</h1><p>One &amp; {say}</p><script>x</script><aside>{say}</aside><p>Two\n {say}</div><div id=comments><p>{say}</p></div></main><form>{say}</form><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<"), (5, "u", "<p"), (6, "u", "<!-- <p>x</p>"), (None, "u", "<div><div>" * 3000 + "x")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in extract.extract(df, chain).collect()}
    assert got[1] == f"Head\nOne & {say}\nTwo {say}".replace(" \n", "\n").strip() and got[2] == got[3] == "" == got[6] and len(got) == 7


def test_extraction_of_made_up_layouts_held_out():
    chain = extract.train(extract.templates())
    pages = extract.templates(200, seed=99)
    assert sum(chain.decode(f) == y for f, y in pages) / len(pages) > 0.85
    blocks = [(got, gold) for f, y in pages for got, gold in zip(chain.decode(f), y)]
    assert sum(a == b for a, b in blocks) / len(blocks) > 0.97


def test_extraction_drops_parts_inside_the_article():
    chain = extract.train(extract.templates())
    say = "Some words of the story, long enough to be a sentence of it. " * 2
    for part in (f"<section class='comments'><p>{say}</p></section>", f"<form><p>{say}</p></form>", f"<div class='ad'>{say}</div>", f"<div class='cookie-consent'><p>{say}</p></div>", f"<div hidden>{say}</div>"):
        page = f"<article><h1>Head</h1><p>{say}</p>{part}<p>{say}</p></article>"
        assert chain.decode(extract.features(extract.leaf_blocks(page))) == [1, 1, 0, 1], part


def test_viterbi_is_the_best_path():
    rng = random.Random(0)
    chain = extract.Chain({"a": 0.7, "b": -0.4, "c": 1.1}, np.array([[0.5, -0.6], [-0.2, 0.3]]))
    for _ in range(50):
        names = [[rng.choice("abcd") for _ in range(3)] for _ in range(6)]
        emit = [sum(chain.weights.get(n, 0) for n in x) for x in names]
        value = lambda p: sum(e for e, y in zip(emit, p) if y) + sum(chain.moves[i][j] for i, j in zip(p, p[1:]))
        paths = [[k >> i & 1 for i in range(6)] for k in range(64)]
        assert abs(value(chain.decode(names)) - max(map(value, paths))) < 1e-9


# the pipeline


def test_pipeline_stage_by_stage(spark, documents, tokenizer):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, SF))
        assert docs.columns == documents.columns + ["training_position"] * (name == "mixing")
        if name == "simhash":  # near copies of the pipeline: five words, similarity 0.8
            assert sorted(r["doc_id"] for r in docs.collect()) == survivors(sorted(texts(before)))
        if name == "suffix":
            want = {i: n - gone for i, n, gone, _, _ in reference_removal(texts(before))}
            assert all(abs(len((r["text"] or "").encode()) - want[r["doc_id"]]) <= 6 and r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "mixing":
            assert {(r["doc_id"], r["text"]) for r in docs.collect()} <= set(texts(before))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    want = bag((i, len(tokenizer.encode(t, add_special_tokens=False).ids), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts(docs))
    assert bag((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in last) == want
    assert corpus_pipeline.run(spark, SF).count() == len(last)


def test_pipeline_stages_on_odd_rows(spark, odd):
    labels = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), labels).count() == 0
        assert stage(spark, odd, labels).count() > 0
