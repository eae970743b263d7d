"""Chunked byte-level BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ledgerline.llm import chunked_bpe, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=chunked_bpe.load_ranks(RANKS), special_tokens={})


def raw(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.mark.parametrize("chunk, overlap", [(300, 60), (64, 16), (20, 5)])
def test_chunks_stitch_wherever_they_are_cut(spark, library, chunk, overlap):
    rnd = random.Random(chunk)
    letters = "ab'slre  \n\n\t1é漢字.,!?''  "
    texts = ["", None, "a", "   ", "x" * 3000, " " * 2000, "'" * 900 + "ll", "漢" * 1500, "ab" * 700 + "'re", "<|endoftext|>" * 30]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 2500))) for _ in range(25)]
    texts += [("word " * rnd.randint(1, 200) + "z" * rnd.randint(0, 600) + "  " * rnd.randint(0, 150)) * 3 for _ in range(8)]
    rows = [*enumerate(texts), (3, "twice " * 100), (3, "twice " * 100), (None, "no id " * 60)]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, part int, key string")
    got = chunked_bpe.encode(df, RANKS, "ids", public_tokenizers.PATTERN, chunk, overlap).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=key) == sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=key)


def test_overlaps_without_a_stitch_are_seen(spark):
    df = spark.createDataFrame([(1, "ab " * 200), (2, "ab " * 30 + "x" * 500 + " ab" * 30)], "doc_id long, text string")
    chunks = chunked_bpe._chunks(df, public_tokenizers.PATTERN, 100, 20)
    named = {r["key"]: r["doc_id"] for r in chunks.select("key", "doc_id").collect()}
    assert {named[r["key"]]: r["whole"] for r in chunked_bpe._stitches(chunks, 20).collect()} == {1: True, 2: False}


def test_merges_of_long_words(library):
    merger = chunked_bpe.Merger(chunked_bpe.load_ranks(RANKS))
    rnd = random.Random(9)
    for n in (1, 2, 50, 255, 256, 3000):
        for letters in ("a", "ab", "aáé漢", "thequick"):
            word = "".join(rnd.choice(letters) for _ in range(n)).encode()
            wanted = raw(library._core_bpe.encode_single_piece(word))
            assert merger.merge_long(word) == wanted == merger.merge([word])[0]


def test_empty_table_and_digests(spark, library):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert chunked_bpe.encode(df, RANKS, "digest").count() == 0
    got = {r["doc_id"]: r for r in queries.op13_chunked_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
