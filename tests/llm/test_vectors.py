"""Hard negatives and whitening against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import negatives, queries, whitening
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"


def loop(rows, positives=5, negatives=10):
    """The result of mine() by scoring everything."""
    sound = sorted((i, lab, [int(np.floor(256 * c)) for c in v]) for i, v, lab in rows if i is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v))
    out = []
    for a, own, x in (r for r in sound if r[0] % 100 == 0):
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, lab) for i, lab, y in sound if len(y) == len(x))
        for s, i, _ in [r for r in scored if r[2] == own and r[1] != a][:positives]:
            low = [r for r in scored if r[2] != own and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
            out += [(a, i, rank + 1, j, -s, -t) for rank, (t, j, _) in enumerate(low)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0).collect())


def test_negatives_of_clusters_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TREE", 8)
    monkeypatch.setattr(negatives, "LEAST_ROWS", 200)
    rnd = random.Random(5)
    middles = [[rnd.gauss(0, 0.3) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(1500):
        v = [float(np.float32(x + rnd.gauss(0, 0.15))) for x in rnd.choice(middles)]
        v = list(middles[0]) if i % 150 == 0 else v[:4] if i % 31 == 3 else v
        v = None if i % 89 == 1 else [] if i % 89 == 2 else [float("nan")] * 6 if i % 83 == 1 else [None, *v[1:]] if i % 97 == 1 else v
        rows.append((i, v, None if i % 101 == 7 else rnd.randint(0, 4)))
    rows.append((None, list(middles[1]), 1))
    df = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, block int, score int, x string").repartition(3)
    wanted = loop(rows)
    assert mined(df) == wanted and len(wanted) > 300
    assert mined(df.union(df)) == wanted  # repeated rows count once
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id % 100 <> 0")) == []


def test_scores_beyond_doubles_stay_exact(spark):
    rows = [(100, [2.0**21, 1.0, 1.0], 1), (101, [2.0**21, 1.0, 3.0], 1), (102, [2.0**20, 1.0, 5.0], 2), (103, [2.0**20, 1.0, 6.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df) == loop(rows)


def test_spanning_tree_is_minimal():
    x = np.random.default_rng(1).standard_normal((40, 3))
    order, parent, edge = negatives.spanning_tree(x)
    assert sorted(order) == list(range(40)) and all(p < k for k, p in enumerate(parent))
    away = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    assert np.allclose(edge[1:], [away[order[k], order[p]] for k, p in enumerate(parent) if p >= 0])
    joined, total = {0}, 0.0  # by brute force over all edges
    while len(joined) < 40:
        w, _, b = min((away[a, b], a, b) for a in joined for b in set(range(40)) - joined)
        joined.add(b)
        total += w
    assert np.isclose(total, edge.sum())


def test_most_scores_of_near_anchors_are_bounded_away(monkeypatch):
    """A tree over near anchors computes few scores beyond its root's."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.standard_normal((4000, 16))).astype(np.int64)
    block = negatives.Block(np.arange(4000), np.zeros(4000, np.int64), x)
    anchors = np.floor(256 * (rng.standard_normal(16) + 0.02 * rng.standard_normal((20, 16)))).astype(np.int64)
    order, parent, edge = negatives.spanning_tree(anchors.astype(float))
    tree = negatives.Tree(np.arange(9000, 9020), np.zeros(20, np.int64), parent, edge, anchors[order], [])
    scored, scores = [], block.scores
    monkeypatch.setattr(block, "scores", lambda a, at: scored.append(len(block.ids[at])) or scores(a, at))
    found = list(negatives.search(block, tree, True, 5))
    assert sum(scored[1:]) < 0.2 * 19 * 4000
    for c, _, rows, got in found:
        whole = x @ tree.x[c]
        assert rows.tolist() == np.lexsort((np.arange(4000), -whole))[:5].tolist() and (whole[rows] == got).all()


def test_negatives_query(spark):
    same(queries.op11_anchor_tree_negatives(spark, SF), duck(SF), queries.OP11_SQL)


def whitened(vectors, kept=4):
    """(n, S, values, vectors, trace) by a dense solver."""
    x = np.unique(vectors, axis=0)
    away = x - x.sum(0) / len(x)
    cov = away.T @ away / len(x)
    e, u = np.linalg.eigh(cov)
    return len(x), x.sum(0), e[::-1][:kept], u[:, ::-1][:, :kept], np.trace(cov)


def test_whitening_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.stack(table["embedding"]).astype(float)).astype(np.int64)
    n, s, e, u, trace = whitened(x)
    got = queries.op12_jacobi_davidson(spark, SF).toPandas().sort_values(["vec_id", "component"])
    order = np.argsort(table["vec_id"].to_numpy())
    wanted, found = ((x - s / n) @ u / np.sqrt(e))[order], got["whitened"].to_numpy().reshape(-1, 4)
    assert np.abs(found * np.sign((found * wanted).sum(0)) - wanted).max() < 1e-10
    assert got["deviation"].tolist() == np.repeat(((n * x - s) ** 2).sum(1)[order], 4).tolist() and set(got["n"]) == {n}
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 4), e / trace, rtol=1e-12) and got["identity_error"].max() < 1e-12


def test_whitening_odd_rows(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [3.0, -2.0], 2), (None, [3.0, 5.0], 3), (4, None, 4), (5, [], 5), (6, [1.0, None], 6), (7, [1.0, float("inf")], 7), (8, [1.0], 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted((i, c) for i in (0, 1, 2, 2, 3) for c in (1, 2))
    n, s, e, u, _ = whitened(np.array([[256, 512], [768, -512], [768, 1280]]))
    assert {r["n"] for r in got} == {3} and all(abs(abs(r["whitened"]) - abs(((np.array([256, 512]) - s / n) @ u / np.sqrt(e))[r["component"] - 1])) < 1e-12 for r in got if r["vec_id"] == 1)
    assert whitening.whiten(df.limit(0)).count() == 0
    alone = whitening.whiten(df.where("vec_id = 1")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(1, 0, None, None, None)] * 2
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [4e15, 4e15])], "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["deviation"] is None for r in line)


@pytest.mark.parametrize("spectrum", [np.r_[1.0, 1 - 1e-6, 0.99, 0.98, np.linspace(0.97, 0, 146)], np.ones(60), np.r_[np.ones(2), np.zeros(48)], 1 / np.arange(1.0, 301), np.array([2.0])])
def test_jacobi_davidson_against_a_dense_solver(spectrum):
    n = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((n, n)))[0]
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.jacobi_davidson(lambda x: a @ x, n, most=40)
    assert np.abs(values - np.sort(spectrum)[::-1][:4]).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(4)
    a = np.diag(np.arange(1.0, 13))
    q = np.linalg.qr(rng.standard_normal((12, 2)))[0]
    right = rng.standard_normal((12, 3))
    out = whitening.minres(lambda x: a @ x, np.array([0.5, 3.3, 20.0]), q, right, 12)
    project = np.eye(12) - q @ q.T
    for j, shift in enumerate((0.5, 3.3, 20.0)):
        assert np.allclose(project @ (a - shift * np.eye(12)) @ project @ out[:, j], project @ right[:, j], atol=1e-8)
