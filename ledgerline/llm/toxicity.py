"""Toxicity by non-negative positive-unlabelled learning.

A logistic classifier in numpy is trained from texts confirmed as toxic and from unlabelled texts, some of them toxic
too. Its risk is the class prior times the risk of the positives as positives, plus the risk of the unlabelled as
negatives less the share that the positives among them cause; that second part can't be negative in truth, so when it
turns negative on the sample, the step is taken against it instead (Kiryo et al. 2017).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import fold, give_back, written

TERM = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6, 7)


def features(text: str) -> set[str]:
    """Words of a text in lower case, and their beginnings of four to seven characters."""
    words = set(TERM.findall(text.lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "~" for w in words if len(w) > n)
    return out


class Model:
    """Weights of features; a text's score is the logistic function of their sum. corrected is how many steps of the
    training went against the second part of the risk, as it was negative."""

    def __init__(self, weights: dict[str, float], bias: float, corrected: int = 0):
        self.weights, self.bias, self.corrected = weights, bias, corrected
        self.heads = {f[:4].rstrip("~") for f in weights}

    def score(self, text: str) -> float:
        # only words that begin like a feature can have one
        words = [w for w in set(TERM.findall(text.lower())) if w[:4] in self.heads]
        own = set(words).union(*({w[:n] + "~" for w in words if len(w) > n} for n in BEGINNINGS))
        z = self.bias + sum(map(self.weights.__getitem__, sorted(own & self.weights.keys())))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


Side = tuple[np.ndarray, np.ndarray, int]  # rows, features, number of texts


def descend(positive: Side, unlabelled: Side, kinds: int, prior: float, epochs: int = 200, rate: float = 0.3, sparsity: float = 7e-4) -> tuple[np.ndarray, int]:
    """Weights of kinds features, the bias last, that make the non-negative risk small, by full-batch Adam with soft
    thresholds (an L1 penalty of sparsity); and the number of steps taken against a negative second part."""
    w = np.zeros(kinds + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, corrected = np.zeros_like(w), np.zeros_like(w), 0

    def logits(side: Side) -> np.ndarray:
        rows, cols, n = side
        return w[-1] + np.bincount(rows, w[cols], n)

    def gradient(side: Side, d: np.ndarray) -> np.ndarray:
        rows, cols, n = side
        return np.append(np.bincount(cols, d[rows], kinds), d.sum()) / n

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, epochs + 1):
        zp, zu = logits(positive), logits(unlabelled)
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_negative = gradient(unlabelled, su) - prior * gradient(positive, sp)
        if negative >= 0:
            g = prior * gradient(positive, sp - 1) + grad_negative
        else:
            g, corrected = -grad_negative, corrected + 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w -= move * m / (1 - 0.9**step)
        w[:-1] = np.sign(w[:-1]) * np.maximum(0.0, np.abs(w[:-1]) - move[:-1] * sparsity)
    return w, corrected


def train(positive: list[set[str]], unlabelled: list[set[str]], prior: float, least: int = 8, **steps) -> Model:
    """A model of the features that at least `least` of all texts have; without positives or unlabelled texts every text
    gets the prior."""
    bias = float(np.log(prior / (1 - prior)))
    seen: dict[str, int] = {}
    for t in positive + unlabelled:
        for f in t:
            seen[f] = seen.get(f, 0) + 1
    kept = sorted(f for f, c in seen.items() if c >= least)
    if not positive or not unlabelled or not kept:
        return Model({}, bias)
    index = {f: i for i, f in enumerate(kept)}
    sides = []
    for texts in (positive, unlabelled):
        pairs = [(k, index[f]) for k, t in enumerate(texts) for f in sorted(t & index.keys())]
        rows, cols = (np.array(x, int) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
        sides.append((rows, cols, len(texts)))
    w, corrected = descend(*sides, len(kept), prior, **steps)
    return Model({f: float(w[i]) for f, i in index.items() if w[i]}, float(w[-1]), corrected)


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 0, positives: int = 2500, unlabelled: int = 6000, least: int = 8) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), outside the fold held_out.

    The class prior is the share of toxic documents among all labelled ones outside the fold, shrunk towards a quarter by
    the weight of two labels, so that it is never 0 or 1. The texts are a bounded sample of the labelled rows: at most
    `positives` toxic ones, and at most `unlabelled` drawn whatever their label says, whose labels aren't looked at; both
    first by a hash of their id. Features are all that at least `least` of these texts have; how often a class has them
    plays no part, and their number is bounded by the sample's text alone. A document with several labels counts as toxic if one says so; of several texts
    with one doc_id, the first by a hash of the text trains. Null ids, labels and texts don't. Without toxic labels every
    text gets the prior.
    """
    model = _fitted(docs, labels, held_out, positives, unlabelled, least)
    give_back()  # the sample's features have gone, and the driver lives on
    return model


def _fitted(docs: DataFrame, labels: DataFrame, held_out: int, positives: int, unlabelled: int, least: int) -> Model:
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id") != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")).first()
    prior = (size["toxic"] + 0.5) / (size["n"] + 2)
    pick = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(known.where("toxic = 1"), positives).select("doc_id", F.lit(1).alias("side"))
    chosen = chosen.unionByName(pick(known, unlabelled).select("doc_id", F.lit(0).alias("side")))
    # at most positives + unlabelled ids are broadcast, and one text for each is kept
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "side").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                found = pa.array([sorted(features(t)) for t in part.column("text").to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("side"), found], ["doc_id", "side", "terms"])

    rows = written(texts.mapInArrow(terms, "doc_id long, side int, terms array<string>"))
    counts = rows.select(F.explode("terms").alias("term")).groupBy("term").count().where(F.col("count") >= least)
    kept = sorted(counts.select("term").toArrow()["term"].to_pylist())
    index = spark.sparkContext.broadcast({t: i for i, t in enumerate(kept)})

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.value.get
        for batch in batches:
            found = pa.array([[i for i in map(get, ts) if i is not None] for ts in batch.column("terms").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("side"), found], ["doc_id", "side", "terms"])

    # one list of numbers for each text of the sample reaches the driver
    few = rows.mapInArrow(numbers, "doc_id long, side int, terms array<int>").toArrow().combine_chunks().sort_by([("side", "ascending"), ("doc_id", "ascending")])
    sides = []
    for wanted in (1, 0):
        lists = few.filter(pa.compute.equal(few["side"], wanted))["terms"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        sides.append((np.repeat(np.arange(len(lists), dtype=np.int32), sizes), lists.flatten().to_numpy(zero_copy_only=False), len(lists)))
    if not kept or not sides[0][2] or not sides[1][2]:
        return Model({}, float(np.log(prior / (1 - prior))))
    w, corrected = descend(*sides, len(kept), prior)
    return Model({t: float(x) for t, x in zip(kept, w) if x}, float(w[-1]), corrected)


def score(docs: DataFrame, model: Model, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; repeated rows are scored one by one, an empty table gives
    an empty one. Null and empty texts get the model's bias: a low score. A null doc_id falls into the fold of the empty
    text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                found = [shared.value.score(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", (fold("doc_id") == held_out).alias("held_out")).mapInArrow(scores, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below threshold, with all their columns; repeated rows fare alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                keep = [shared.value.score(t or "") < threshold for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, schema)
