"""SimHash fingerprints and their near-duplicate components by vantage-point trees.

Only distinct fingerprints are compared. Their bits are cut into VIEWS parts; of two fingerprints within r bits of each
other, one part differs in at most r // VIEWS bits. The distance in a part is a distance too, with narrower bounds, so
each part has its vantage-point tree, which is laid out on the driver from a bounded sample: a node splits by the distance
to its vantage point, d <= mu or d > mu. Two fingerprints within the part's radius q on different sides have
mu - q < d <= mu and mu < d <= mu + q, by the triangle inequality; only these boundary bands are sent, besides to their
own side's shard, to a shard that crosses the two sides, which is split further in the same way. So each pair that is
close in a part meets in exactly one of the part's shards, and each shard is searched exactly, for all 64 bits, by the
same recursion in its task. Shards yield spanning edges of what they link, never all pairs of a group.

With q = 1 of 21 bits a level's bands hold about a third of its values; they hold two thirds with 4 of 64 bits in one
tree. By the recursion of cross shards the work then grows with about the 1.3rd power of the number of fingerprints
instead of the 1.65th, for three trees instead of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import components, written

SEED = 42
RADIUS = 4
VIEWS = 3
ALL = (1 << 64) - 1
SALTS = 32
LEAF = 640  # fingerprints that are compared one by one


def fingerprint(text: str, words_in: int = 4) -> int:
    """SimHash of a text's word shingles: a bit is 1 if it is set in over half of their hashes; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_in:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - words_in + 1].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words_in - 1 :].tolist())])
    count = np.zeros(64, np.int64)
    for at in range(0, len(raw), 8 << 15):
        bits = np.unpackbits(np.frombuffer(raw[at : at + (8 << 15)], np.uint8)).reshape(-1, 64)
        count += bits.sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(count * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, other: Column | None = None) -> DataFrame:
    """(doc_id, fp, t) for every row of docs; fp holds the unsigned fingerprint's 64 bits as a long, t the long column
    other. Null texts count as empty ones: 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                fps = np.array([fingerprint(t or "") for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64)), part.column("t")], ["doc_id", "fp", "t"])

    t = F.lit(0).cast("long") if other is None else other
    return docs.select("doc_id", "text", t.alias("t")).mapInArrow(hashed, "doc_id long, fp long, t long")


def _distance(x: np.ndarray, to: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ to) & mask).astype(np.int16)


def parts(views: int = VIEWS) -> list[int]:
    """Masks of the parts that 64 bits are cut into: 22, 21 and 21 bits for three."""
    ends = [64 * k // views for k in range(views + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]


class Shards:
    """The upper tree of one part of the bits: which shards a fingerprint goes to, and on which side. Built from a sample that stands for total
    fingerprints; a shard is meant to hold most of them at most. Sides: 0 both (a shard of one side), 1 and 2 across.

    Where vantage points don't divide a shard (a dense cluster), it is dealt into blocks instead and each pair of blocks
    becomes a shard.
    """

    def __init__(self, sample: np.ndarray, total: int, most: int, radius: int, mask: int = ALL):
        self.radius, self.most, self.scale, self.mask = radius, most, total / max(1, len(sample)), np.uint64(mask)
        self.shards = 0
        self.rng = np.random.default_rng(SEED)
        self.root = self._one(sample)

    def _leaf(self, n: float, across: bool) -> tuple:
        blocks = max(1, int(np.ceil(n * self.scale / self.most)))
        first = self.shards
        self.shards += blocks * blocks
        return ("leaf", first, blocks, across)

    def _vantage(self, x: np.ndarray, y: np.ndarray | None = None) -> tuple[np.uint64, int] | None:
        """The best of a few vantage points: the one whose bands hold least; None if none divides."""
        everything = x if y is None else np.concatenate([x, y])
        best = None
        for p in self.rng.choice(everything, min(16, len(everything)), replace=False):
            d = _distance(everything, p, self.mask)
            for mu in {int(np.median(d)), int(np.quantile(d, 0.35)), int(np.quantile(d, 0.65))}:
                inside = (d <= mu).mean()
                band = ((d > mu - self.radius) & (d <= mu + self.radius)).mean()
                cost = max(inside, 1 - inside) ** 2 + min(inside, 1 - inside) ** 2 + band**2 / 2
                if 0.02 < inside < 0.98 and (best is None or cost < best[0]):
                    best = (cost, p, mu)
        return None if best is None or best[0] > 0.93 else best[1:]

    def _one(self, x: np.ndarray) -> tuple:
        if len(x) * self.scale <= self.most or len(x) < 32 or (split := self._vantage(x)) is None:
            return self._leaf(len(x), False)
        p, mu = split
        d = _distance(x, p, self.mask)
        inner, outer = (d > mu - self.radius) & (d <= mu), (d > mu) & (d <= mu + self.radius)
        return ("one", p, mu, self._one(x[d <= mu]), self._one(x[d > mu]), self._two(x[inner], x[outer]))

    def _two(self, a: np.ndarray, b: np.ndarray) -> tuple:
        n = max(len(a), len(b))
        if (len(a) + len(b)) * self.scale <= 2 * self.most or n < 32 or (split := self._vantage(a, b)) is None:
            return self._leaf(n, True)
        p, mu = split
        r, da, db = self.radius, _distance(a, p, self.mask), _distance(b, p, self.mask)
        band = lambda d: ((d > mu - r) & (d <= mu), (d > mu) & (d <= mu + r))
        (ai, ao), (bi, bo) = band(da), band(db)
        return ("two", p, mu, self._two(a[da <= mu], b[db <= mu]), self._two(a[da > mu], b[db > mu]), self._two(a[ai], b[bo]), self._two(a[ao], b[bi]))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in x with the shards and sides that they go to."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        r = self.radius

        def leaf(node: tuple, at: np.ndarray, side: int) -> None:
            _, first, blocks, across = node
            own = ((x[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks
            for other in range(blocks):
                if across:  # block i of the one side meets block j of the other in shard i * blocks + j
                    shard = own * blocks + other if side == 1 else other * blocks + own
                    out.append((at, first + shard, np.full(len(at), side)))
                else:
                    shard = np.minimum(own, other) * blocks + np.maximum(own, other)
                    out.append((at, first + shard, np.where(own == other, 0, np.where(own < other, 1, 2))))

        def walk(node: tuple, at: np.ndarray, side: int) -> None:
            if not len(at):
                return
            if node[0] == "leaf":
                leaf(node, at, side)
                return
            d, mu = _distance(x[at], node[1], self.mask), node[2]
            walk(node[3], at[d <= mu], side)
            walk(node[4], at[d > mu], side)
            inner, outer = at[(d > mu - r) & (d <= mu)], at[(d > mu) & (d <= mu + r)]
            if node[0] == "one":
                walk(node[5], inner, 1)
                walk(node[5], outer, 2)
            else:
                walk(node[5], inner if side == 1 else outer, side)
                walk(node[6], outer if side == 1 else inner, side)

        walk(self.root, np.arange(len(x)), 0)
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3)) if out else (np.zeros(0, int),) * 3


class Linker:
    """Components of fingerprints in one task. close() and across() go on with the tree down to LEAF."""

    def __init__(self, x: np.ndarray, radius: int, near: int | None = None, mask: int = ALL):
        """near: the radius in the part of the bits that mask names, by which branches are pruned."""
        self.x, self.radius, self.near, self.mask = x, radius, radius if near is None else near, np.uint64(mask)
        self.up = np.arange(len(x))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.up[at]
        while True:
            after = self.up[found]
            if np.array_equal(after, found):
                self.up[at] = found
                return found
            found = after

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link what is close between two lists, block by block; blocks that are one component already are left out."""
        for i in range(0, len(a), LEAF):
            for j in range(0, len(b), LEAF):
                p, q = a[i : i + LEAF], b[j : j + LEAF]
                rp, rq = self.roots(p), self.roots(q)
                if rp.min() == rp.max() == rq.min() == rq.max():
                    continue
                near = np.bitwise_count(self.x[p, None] ^ self.x[q]) <= self.radius
                rows, cols = np.nonzero(near) if np.count_nonzero(near) < 4 * LEAF else (None, None)
                if rows is None:  # many links: the smallest label on either side spreads until nothing changes
                    lp, lq, before = rp.copy(), rq.copy(), None
                    while before is None or not np.array_equal(before, lp):
                        before = lp
                        lq = np.minimum(lq, np.where(near, lp[:, None], len(self.x)).min(0))
                        lp = np.minimum(lp, np.where(near, lq, len(self.x)).min(1))
                    links = zip(np.concatenate([rp, rq]).tolist(), np.concatenate([lp, lq]).tolist())
                    links = {x for x in links if x[0] != x[1]}
                else:
                    links = {x for x in zip(rp[rows].tolist(), rq[cols].tolist()) if x[0] != x[1]}
                for u, v in links:
                    self.join(u, v)

    def _split(self, everything: np.ndarray) -> tuple[np.uint64, int] | None:
        for k in range(1, 5):
            p = self.x[everything[len(everything) * k // 5]]
            d = _distance(self.x[everything], p, self.mask)
            mu = int(np.median(d))
            if 0.1 < (d <= mu).mean() < 0.9:
                return p, mu
        return None

    def close(self, at: np.ndarray) -> None:
        """Link all close pairs of a list."""
        split = self._split(at) if len(at) > 2 * LEAF else None
        if split is None:
            for i in range(0, len(at), LEAF):
                self.compare(at[i : i + LEAF], at[i:])
            return
        d, mu, r = _distance(self.x[at], split[0], self.mask), split[1], self.near
        self.close(at[d <= mu])
        self.close(at[d > mu])
        self.across(at[(d > mu - r) & (d <= mu)], at[(d > mu) & (d <= mu + r)])

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link all close pairs between two lists."""
        split = self._split(np.concatenate([a, b])) if len(a) * len(b) > 2 * LEAF * LEAF else None
        if split is None:
            self.compare(a, b)
            return
        p, mu, r = split[0], split[1], self.near
        da, db = _distance(self.x[a], p, self.mask), _distance(self.x[b], p, self.mask)
        band = lambda d: ((d > mu - r) & (d <= mu), (d > mu) & (d <= mu + r))
        (ai, ao), (bi, bo) = band(da), band(db)
        self.across(a[da <= mu], b[db <= mu])
        self.across(a[da > mu], b[db > mu])
        self.across(a[ai], b[bo])
        self.across(a[ao], b[bi])


def scaled(total: int, shard_size: int = 20_000, sample: int = 8192) -> tuple[int, int]:
    """Size of a shard and of the sample for total distinct values. Both grow with the square root of total beyond a
    million, so that a shard stands for as many points of the sample at any size, and the upper trees split down to it."""
    growth = max(1.0, (total / 1_000_000) ** 0.5)
    return int(shard_size * growth), int(sample * growth)


def edges(prints: DataFrame, radius: int = RADIUS, shard_size: int = 20_000, sample: int = 8192, views: int = VIEWS) -> DataFrame:
    """(a, b): edges that span what is within radius bits among all distinct values of prints (fp), shard by shard.

    shard_size is what a task takes in at a time, sample what the driver takes in to lay out the upper trees, both for a
    million distinct values and growing with their square root: for ten thousand million, 2 million values of 8 bytes and
    a sample of 819,200. Every value is compared all the same.
    """
    spark = prints.sparkSession
    distinct = written(prints.select("fp").where("fp IS NOT NULL").distinct())
    total = distinct.count()
    shard_size, sample = scaled(total, shard_size, sample)
    rows = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    some = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
    near, masks = radius // views, parts(views)
    trees = spark.sparkContext.broadcast([Shards(some, total, shard_size, near, mask) for mask in masks])

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame["fp"].to_numpy(np.int64)
            for view, tree in enumerate(trees.value):
                at, shard, side = tree.assign(x.view(np.uint64))
                yield pd.DataFrame({"view": np.full(len(at), view, np.int8), "shard": shard, "side": side.astype(np.int8), "fp": x[at]})

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "fp"])
        x, side = frame["fp"].to_numpy(np.int64), frame["side"].to_numpy()
        found = Linker(x.view(np.uint64), radius, near, masks[int(frame["view"].iloc[0])])
        if len(own := np.nonzero(side == 0)[0]):
            found.close(own)
        found.across(np.nonzero(side == 1)[0], np.nonzero(side == 2)[0])
        roots = found.roots(np.arange(len(x)))
        linked = roots != np.arange(len(x))
        return pd.DataFrame({"a": x[linked], "b": x[roots[linked]]})

    return distinct.mapInPandas(assign, "view byte, shard long, side byte, fp long").groupBy("view", "shard").applyInPandas(search, "a long, b long")


def link(prints: DataFrame, radius: int = RADIUS, **shards) -> DataFrame:
    """(fp, component) for all distinct values of prints (fp) that are within radius bits of another: component is the
    smallest signed fp reachable. Values that are close to none don't appear."""
    return components(edges(prints, radius, **shards)).select(F.col("node").alias("fp"), "component")


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component) for every fingerprint of prints."""
    every = prints.select("fp").distinct().join(link(prints, radius), "fp", "left")
    return every.select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id
    among the documents reachable over fingerprints within radius bits, the document itself included.

    Rows without a doc_id are compared like others but never name a component; a component of such rows only has a null
    component_id. Texts that are null, empty or without words have the fingerprint zero. An empty table gives an empty one.
    """
    prints = written(fingerprints(docs))
    kinds = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    grouped = kinds.join(link(kinds, radius), "fp")
    # a large component's fingerprints are spread over several tasks, which its one row visits
    spread = grouped.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = spread.join(least, ["component", "salt"]).select("fp", "component_id", F.lit(True).alias("grouped"))
    label = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")
    by_print = written(kinds.join(named, "fp", "left").select("fp", label))
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, with all their columns, that come first in their near-duplicate component: by doc_id, null last,
    then by a hash of the text. Of rows with the same doc_id and text one stays."""
    hashed = written(fingerprints(docs, F.xxhash64(F.coalesce("text", F.lit("")))))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "t")).alias("first")
    kinds = written(hashed.groupBy("fp").agg(first))
    return rows_of(docs, kinds.join(_components(kinds, radius), "fp").groupBy("component").agg(F.min("first").alias("first")))


def rows_of(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each row of groups, whose `first` names its doc_id and the hash t of its
    text; rows that repeat both count once."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(row.alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.col("doc_id").alias("id"))
    first = written(groups.select(F.col("first.doc_id").alias("first_id"), F.col("first.t").alias("first_t")))
    kept = keyed.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("t") == F.col("first_t")), "left_semi")
    twice = keyed.groupBy("id", "t").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return (kept.dropDuplicates(["id", "t"]) if twice else kept).select("row.*")
