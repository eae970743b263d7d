"""Groups of marks that become small enough only when they are split to single starts."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from ledgerline.llm import suffix
from tests.llm.test_llm import bag, reference_removal


def test_strings_that_start_at_their_mark():
    after = np.array([[1, 2], [1, 2], [1, 3], [1, 2]], np.uint8)
    none, whole, group = np.zeros((4, 0), np.uint8), np.full(4, 2), np.array([0, 0, 0, 1])
    first, last = suffix.repeated_around(none, after, np.zeros(4, int), whole, group, np.ones(4, int), 2, 0, 0)
    assert first.tolist() == last.tolist() == [0, 0, -1, -1]


def test_groups_split_to_single_starts(spark):
    rnd = random.Random(5)
    letters = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    long = letters(3000)
    # a passage whose one mark is 102 bytes in, so that strings from there on reach two bytes beyond it
    passages = (long[m - 102 : m + 198] for m in suffix.anchors([long.encode()])[0][0].tolist() if 102 <= m <= 2800)
    passage = next(p for p in passages if suffix.anchors([p.encode()])[0][0].tolist() == [102])
    tails = [letters(60) for _ in range(4)]
    docs = [(i, letters(60) + passage + tails[i // 2]) for i in range(8)]
    rows = suffix.repeats
    try:
        suffix.repeats = lambda docs, length: rows(docs, length, bucket_rows=3)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got, left = suffix.remove_repeats(df).collect(), corpus_pipeline.cut_repeats(spark, df, "").collect()
    finally:
        suffix.repeats = rows
    wanted = reference_removal(docs)
    assert bag(got) == bag(wanted)
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in left} == {w[0]: w[4] for w in wanted}
