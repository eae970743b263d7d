"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are put together first. The others go to overlapping shards, those of their nearest centres; shards that are
too large are clustered again by centres of their own, level by level. In each shard a flat graph is built: vertices are
searched for in the graph so far, greedily from the medoid, and of what a search meets a vertex keeps its nearest, drops
what that neighbour is clearly closer to, and so on (robust pruning). A vertex's adjacency lists from all of its shards
are united. Every vector is then searched for in the shard of its nearest centre: greedily from the medoid with a beam,
and from what that finds by going on through everything within the range. Links are verified by cosine in double
precision; audit() measures recall against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import components, written

LEAST = 0.95


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, unit): unit holds a row's vector at length one as doubles, node a hash of it; both null for vectors
    that are null, empty or zero or hold null or non-finite components."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, raws = [], []
            for v in batch.column("embedding"):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) if v.is_valid and v.values.null_count == 0 else np.zeros(0)
                most = np.abs(x).max(initial=0.0)
                if not (np.isfinite(most) and most > 0):
                    nodes.append(None)
                    raws.append(None)
                    continue
                x = x / most  # no overflow below
                raw = (x / np.sqrt((x * x).sum())).tobytes()
                nodes.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(raws, pa.binary())], ["vec_id", "node", "unit"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(units, "vec_id long, node long, unit binary")


def centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centres of unit vectors by spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def greedy(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, met=None) -> tuple[np.ndarray, np.ndarray]:
    """Walks over graph from start, one for each query, side by side: the `beam` nearest vertices that each walk has met,
    once it has been at all of them, -1 where there are fewer; and which vertices it has met. met is told of
    (queries, vertices, cosines) as they are met."""
    n, q = len(x), len(queries)
    seen = np.zeros((q, n), bool)
    seen[:, start] = True
    ids, sims, done = np.full((q, beam), -1), np.full((q, beam), -3.0), np.ones((q, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = start, queries @ x[start], False
    if met:
        met(np.arange(q), np.full(q, start), sims[:, 0])
    active = np.arange(q)
    while len(active):
        best = np.where(done[active], -3.0, sims[active]).argmax(1)
        done[active, best] = True
        neighbours = graph[ids[active, best]]
        fresh = (neighbours >= 0) & ~seen[active[:, None], neighbours]
        rows = np.repeat(np.arange(len(active)), fresh.sum(1))
        seen[active[rows], neighbours[fresh]] = True
        cosines = np.full(neighbours.shape, -3.0)
        cosines[fresh] = np.einsum("ij,ij->i", queries[active[rows]], x[neighbours[fresh]])
        if met:
            met(active[rows], neighbours[fresh], cosines[fresh])
        all_ids = np.concatenate([ids[active], np.where(fresh, neighbours, -1)], 1)
        all_sims = np.concatenate([sims[active], cosines], 1)
        all_done = np.concatenate([done[active], ~fresh], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
        active = active[~done[active].all(1)]
    return ids, seen


def _adjacency(n: int, a: np.ndarray, b: np.ndarray, cosines: np.ndarray, most: int, spread: int) -> np.ndarray:
    """Rows of neighbours, -1 where there are fewer, of edges a -> b. A hub keeps its nearest `most`; each of these takes
    over up to `spread` of the others, so that what a hub can't keep stays in reach."""
    order = np.lexsort((-cosines, a))
    a, b = a[order], b[order]
    head = np.searchsorted(a, a)
    place = np.arange(len(a)) - head
    over = np.nonzero(place >= most)[0]
    parent = b[head[over] + (place[over] - most) // spread]
    key = np.unique(np.concatenate([(a * n + b)[place < most], parent * n + b[over]]))
    a, b = key // n, key % n
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, int(place.max(initial=0)) + 1), -1)
    out[a, place] = b
    return out


def robust_prune(x: np.ndarray, degree: int = 24, beam: int = 48, alpha: float = 1.2, batch: int = 256) -> np.ndarray:
    """Adjacency of a flat graph over unit vectors: rows of neighbours, -1 where there are fewer.

    Vertices come batch by batch, in a random order, onto a sparse random graph. A vertex's candidates are what a greedy
    search for it meets nearest and its neighbours so far. The nearest is kept and candidates that are alpha times closer
    to it than to the vertex are dropped, until `degree` are kept; edges are made to run both ways after each batch.
    """
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1)
    rng = np.random.default_rng(n)
    medoid = int((x @ x.mean(0)).argmax())
    order = rng.permutation(n)
    first = rng.integers(0, n, (n, 6))
    a, b = np.repeat(np.arange(n), 6), first.ravel()
    a, b = a[a != b], b[a != b]
    graph = _adjacency(n, np.concatenate([a, b]), np.concatenate([b, a]), np.zeros(2 * len(a)), 2 * degree, degree)
    for i in range(0, n, batch):
        rows = order[i : i + batch]
        near, _ = greedy(x, graph, medoid, x[rows], min(beam, n))
        c = np.concatenate([near, graph[rows]], axis=1)
        c = np.sort(c, axis=1)
        alive = (c >= 0) & (c != rows[:, None]) & np.concatenate([np.ones((len(rows), 1), bool), c[:, 1:] != c[:, :-1]], 1)
        vectors = x[np.maximum(c, 0)]
        own = 1 - np.einsum("ikd,id->ik", vectors, x[rows])
        kept = np.full((len(rows), degree), -1)
        for k in range(degree):
            some = np.nonzero(alive.any(1))[0]
            if not len(some):
                break
            pick = np.where(alive[some], own[some], np.inf).argmin(1)
            kept[some, k] = c[some, pick]
            between = 1 - np.einsum("ikd,id->ik", vectors[some], vectors[some, pick])
            alive[some] &= alpha * between > own[some]
            alive[some, pick] = False
        graph[rows] = -1
        a, b = np.nonzero(graph >= 0)[0], graph[graph >= 0]
        at, to = rows[np.nonzero(kept >= 0)[0]], kept[kept >= 0]
        key = np.unique(np.concatenate([a * n + b, at * n + to, to * n + at]))
        a, b = key // n, key % n
        graph = _adjacency(n, a, b, np.einsum("ij,ij->i", x[a], x[b]), 2 * degree, degree)
    return graph


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, least: float = LEAST, beam: int = 48, slack: float = 0.06) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vertex) with a cosine of at least `least` that a walk over the graph finds, for all queries side by
    side: greedy with a beam from the medoid, then through every vertex within the range and a little more."""
    n, q = len(x), len(queries)
    if not n or not q:
        return np.zeros(0, int), np.zeros(0, int)
    hits_q, hits_v = [], []

    def met(rows, vertices, cosines):
        near = cosines >= least - slack
        hits_q.append(rows[near])
        hits_v.append(vertices[near])

    _, seen = greedy(x, graph, int((x @ x.mean(0)).argmax()), queries, beam, met)
    rows, vertices = np.concatenate(hits_q), np.concatenate(hits_v)
    out_q, out_v = [rows], [vertices]
    while len(rows):  # the range expands until nothing new is in it
        next_q, next_v = [], []
        for i in range(0, len(rows), 50_000):
            r, v = rows[i : i + 50_000], graph[vertices[i : i + 50_000]]
            key = np.unique((r[:, None] * n + v)[v >= 0])
            r, v = key // n, key % n
            new = ~seen[r, v]
            r, v = r[new], v[new]
            seen[r, v] = True
            near = np.einsum("ij,ij->i", queries[r], x[v]) >= least - slack
            next_q.append(r[near])
            next_v.append(v[near])
        rows, vertices = np.concatenate(next_q), np.concatenate(next_v)
        out_q.append(rows)
        out_v.append(vertices)
    rows, vertices = np.concatenate(out_q), np.concatenate(out_v)
    sure = np.einsum("ij,ij->i", queries[rows], x[vertices]) >= least if len(rows) else np.zeros(0, bool)
    return rows[sure], vertices[sure]


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number in each number's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def _stack(units: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _fitted(members: DataFrame, most_rows: int, overlap: int, least: float, fan: int = 64, sample: int = 4000) -> DataFrame:
    """(shard, fitted): centres of shards of members (shard, home, node, weight, unit, rows) that are too large, from up to
    about `sample` members each. A shard that centres don't divide, or that they would cut links of, a dense cluster, isn't
    there."""
    some = members.where(F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("rows") / sample)) == 0)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(min(fan, max(8, 2 * frame["rows"].iloc[0] // most_rows)))
        x = _stack(frame.sort_values("node")["unit"])
        c = centres(x, k)
        near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap]
        a, b = np.nonzero(x[:1000] @ x[:1000].T >= least)
        together = (near[b] == near[a, :1]).any(1).mean()  # where b stands in a's home
        divides = np.bincount(near.ravel()).max() <= 0.7 * len(x) and together >= 0.99
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "fitted": [c.tobytes()]})[: int(divides)]

    return some.groupBy("shard").applyInPandas(fit, "shard long, fitted binary")


def _split(members: DataFrame, fitted: DataFrame, overlap: int) -> DataFrame:
    """members (shard, home, node, weight, unit, rows) in the smaller shards of their shard's centres, fitted.

    A shard's members are dealt over several tasks, and its centres go to each of them, ahead of the members.
    """
    dealt = F.ceil(F.col("rows") / 20_000)
    heads = fitted.join(members.select("shard", dealt.alias("tasks")).distinct(), "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), "fitted")
    rows = members.select("shard", F.pmod(F.xxhash64("node"), dealt).alias("task"), F.lit(None).cast("binary").alias("fitted"), "home", "node", "weight", "unit")
    both = heads.select("shard", "task", "fitted", F.lit(None).cast("boolean").alias("home"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("weight"), F.lit(None).cast("binary").alias("unit")).unionByName(rows)
    sorted_ = both.repartition("shard", "task").sortWithinPartitions("shard", "task", F.col("fitted").isNull())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        c, shard = None, None
        for batch in batches:
            heads = np.nonzero(batch.column("fitted").is_valid().to_numpy(zero_copy_only=False))[0].tolist()
            for begin, end in zip([0, *heads], [*heads, batch.num_rows]):
                if begin in heads and begin < end:
                    shard, c = batch.column("shard")[begin].as_py(), np.frombuffer(batch.column("fitted")[begin].as_py(), np.float64)
                    begin += 1
                if begin < end:
                    part = batch.slice(begin, end - begin)  # without a head, so without nulls
                    units = part.column("unit").to_pandas()
                    x = _stack(units)
                    table = c.reshape(-1, x.shape[1])
                    near = np.argsort(-(x @ table.T), axis=1, kind="stable")[:, : min(overlap, len(table))]
                    at = np.repeat(np.arange(len(x)), near.shape[1])
                    first = np.tile(np.arange(near.shape[1]) == 0, len(x))
                    name = np.array([hash((shard, j)) for j in range(len(table))], np.int64)[near.ravel()]
                    home = part.column("home").to_numpy(zero_copy_only=False)[at] & first
                    yield pd.DataFrame({"shard": name, "home": home, "node": part.column("node").to_numpy()[at], "weight": part.column("weight").to_numpy()[at], "unit": units.to_numpy()[at]})

    return sorted_.mapInArrow(lambda batches: (pa.RecordBatch.from_pandas(f, schema=MEMBER, preserve_index=False) for f in assign(batches)), "shard long, home boolean, node long, weight long, unit binary")


MEMBER = pa.schema([("shard", pa.int64()), ("home", pa.bool_()), ("node", pa.int64()), ("weight", pa.int64()), ("unit", pa.binary())])


def links(distinct: DataFrame, least: float = LEAST, shard_rows: int = 1500, overlap: int = 3, most_rows: int = 3000, sample: int = 20_000, most_centres: int = 512, levels: int = 8) -> DataFrame:
    """Links among distinct vectors (node, unit, weight): rows (a, b, n). Rows with a null b give the weight n of the
    vectors that a links with; the others are edges that join what is linked.

    Centres are fitted on a bounded sample; every vector is indexed and searched. Shards with over most_rows members are
    split by centres of their own, up to `levels` times. What is still too large then, which no centres tell apart, is
    dealt into blocks, each with a graph of its own, and each block's queries visit all of the shard's blocks.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    rows = distinct.select("node", "unit").orderBy(F.xxhash64("node"), "node").limit(sample).collect()
    if not rows:
        return spark.createDataFrame([], "a long, b long, n long")
    widths: dict[int, list[bytes]] = {}
    for r in rows:
        widths.setdefault(len(r["unit"]), []).append(bytes(r["unit"]))
    k = max(1, min(most_centres, total // shard_rows))
    # vectors of other lengths have no cosine with each other: centres of their own
    fitted = {w: centres(np.frombuffer(b"".join(u), np.float64).reshape(len(u), -1), max(1, k * len(u) // len(rows))) for w, u in widths.items()}
    first = dict(zip(fitted, np.cumsum([0, *(len(c) for c in fitted.values())])))
    shared = spark.sparkContext.broadcast((fitted, first))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted, first = shared.value
        for frame in frames:
            for width, part in frame.groupby(frame["unit"].map(len)):
                c = fitted.get(width)
                if c is None:  # a length that the sample doesn't have: one shard
                    yield pd.DataFrame({"shard": -width, "home": True, "node": part["node"], "weight": part["weight"], "unit": part["unit"]})
                    continue
                cosine = _stack(part["unit"]) @ c.T
                some = min(overlap, c.shape[0])
                near = np.argsort(-cosine, axis=1, kind="stable")[:, :some]
                at = np.repeat(np.arange(len(part)), some)
                yield pd.DataFrame({"shard": near.ravel() + first[width], "home": np.tile(np.arange(some) == 0, len(part)), "node": part["node"].to_numpy()[at], "weight": part["weight"].to_numpy()[at], "unit": part["unit"].to_numpy()[at]})

    members = written(distinct.mapInPandas(assign, "shard long, home boolean, node long, weight long, unit binary"))
    settled = None
    for _ in range(levels):
        sizes = written(members.groupBy("shard").agg(F.count("*").alias("rows")))
        if sizes.where(F.col("rows") > most_rows).isEmpty():
            break
        sized = members.join(sizes, "shard")
        fitted = written(_fitted(sized.where(F.col("rows") > most_rows), most_rows, 2, least))
        named = fitted.select("shard")
        rest = written(sized.join(named, "shard", "left_anti").drop("rows"))
        settled = rest if settled is None else settled.unionByName(rest)
        members = written(_split(sized.join(named, "shard", "left_semi"), fitted, 2))
    members = members if settled is None else settled.unionByName(members)
    # a vector may come to one small shard by two ways
    members = written(members.groupBy("shard", "node").agg(F.max("home").alias("home"), F.first("weight").alias("weight"), F.first("unit").alias("unit")))
    sizes = written(members.groupBy("shard").agg(F.ceil(F.count("*") / most_rows).alias("blocks")))
    members = members.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        nodes = frame["node"].to_numpy()
        return pd.DataFrame({"node": nodes, "edges": [nodes[row[row >= 0]] for row in robust_prune(_stack(frame["unit"]))]})

    lists = members.groupBy("shard", "block").applyInPandas(build, "node long, edges array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
    ready = written(members.join(united, "node"))

    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    data = ready.select("shard", "node", "weight", "unit", "edges", F.col("block").alias("held"), every.alias("asked"), F.lit(False).alias("query"))
    asks = ready.where("home").select("shard", "node", "weight", "unit", F.lit(None).cast("array<long>").alias("edges"), every.alias("held"), F.col("block").alias("asked"), F.lit(True).alias("query"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["query", "node"])
        asked = frame["query"].to_numpy()
        own, queries = frame[~asked], frame[asked]
        empty = pd.DataFrame({"a": [], "b": [], "n": []}).astype("Int64")
        if not len(own) or not len(queries):
            return empty
        nodes, q_nodes = own["node"].to_numpy(), queries["node"].to_numpy()
        edges = list(own["edges"])
        at = np.repeat(np.arange(len(nodes)), [len(e) for e in edges])
        to = np.concatenate(edges).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(nodes, to), len(nodes) - 1)
        inside = nodes[place] == to  # neighbours in other shards or blocks are met there
        at, place = at[inside], place[inside]
        column = np.arange(len(at)) - np.searchsorted(at, at)
        graph = np.full((len(nodes), int(column.max(initial=0)) + 1), -1)
        graph[at, column] = place
        x, weight = _stack(own["unit"]), own["weight"].to_numpy()
        rows, vertices = range_search(x, graph, _stack(queries["unit"]), least)
        other = q_nodes[rows] != nodes[vertices]
        rows, vertices = rows[other], vertices[other]
        count = np.bincount(rows, weight[vertices], len(q_nodes)).astype(np.int64)
        names, number = np.unique(np.concatenate([q_nodes[rows], nodes[vertices]]), return_inverse=True)
        label = _spanning(len(names), number[: len(rows)], number[len(rows) :])
        tied = label != np.arange(len(names))
        counts = pd.DataFrame({"a": q_nodes, "b": pd.array([None] * len(q_nodes), "Int64"), "n": count})[count > 0]
        return pd.concat([counts, pd.DataFrame({"a": names[tied], "b": pd.array(names[label[tied]], "Int64"), "n": 0})])

    return data.unionByName(asks).groupBy("shard", "held", "asked").applyInPandas(search, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = LEAST, **index) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: components of their own.
    Rows with equal vectors link, whatever their ids. Vectors of different lengths don't link. Rows without vec_id count
    as links but never name a component. An empty table gives an empty one.
    """
    units = written(unit_vectors(vectors))
    groups = units.where("node IS NOT NULL").groupBy("node", "unit").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    distinct = written(groups)
    found = written(links(distinct.select("node", "unit", "weight"), least, **index))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    parts = components(found.where("b IS NOT NULL").select("a", "b"))
    labels = distinct.select("node", "weight", "least").join(parts, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = labels.join(named, "component").select("node", "component_id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    known = units.where("node IS NOT NULL").join(by_node, "node").select("vec_id", "n_links", "component_id")
    alone = units.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(vectors: DataFrame, found: DataFrame, queries: int = 200, least: float = LEAST) -> float:
    """Share of the links of a bounded sample of vectors, counted by brute force over all rows, that found (the result of
    near_duplicates) has; 1.0 if there are none."""
    units = unit_vectors(vectors).where("node IS NOT NULL")
    asked = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).collect()
    shared = vectors.sparkSession.sparkContext.broadcast([(r["vec_id"], bytes(r["unit"])) for r in asked])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, part in frame.groupby(frame["unit"].map(len)):
                q = [(i, u) for i, u in shared.value if len(u) == width]
                if q:
                    near = np.frombuffer(b"".join(u for _, u in q), np.float64).reshape(len(q), -1) @ _stack(part["unit"]).T >= least
                    yield pd.DataFrame({"vec_id": [i for i, _ in q], "n": near.sum(1)})

    true = units.mapInPandas(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("true"))
    both = true.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum("true").alias("t"), F.sum(F.least("true", "n_links")).alias("f")).first()
    return both["f"] / both["t"] if both["t"] else 1.0
