"""Hard negatives by bounds along spanning trees of the anchors.

Anchors are dealt into trees by their nearest centre, and each tree joins its anchors by a minimum spanning tree. Rows are
dealt into blocks that tasks keep at hand while the trees come along. A tree's root is scored on a whole block. For a child
every row's score lies within its score, or the bounds of it, at the parent, give or take the edge's length times the
row's norm. Only rows whose bounds overlap a window that still takes scores are scored at the child. So nothing is lost,
and the nearer anchors are to each other the less is computed.

The window of a search for positives begins at the worst of the best found so far. That of a positive's negatives is given
by its score, and its lower end rises likewise. What blocks find is merged by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import written
from ledgerline.llm.neighbours import centres
from ledgerline.llm.whitening import quantised

#: Anchors of a tree at most, and rows of a block at least and at most.
TREE, LEAST_ROWS, MOST_ROWS = 256, 8192, 65_536
#: Bounds are widened by as much against rounding.
SLACK = 1 + 1e-9
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree of the rows of x by their distances, grown from the row nearest to
    the mean: rows in an order in which parents come first, the parent's place in that order (-1 for the root), and the
    distance to it."""
    n = len(x)
    root = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order, place = [root], {root: 0}
    near, best = np.full(n, root), np.sqrt(((x - x[root]) ** 2).sum(1))
    parent, edge = [-1], [0.0]
    best[root] = np.inf
    for k in range(1, n):
        i = int(best.argmin())
        parent.append(place[int(near[i])])
        edge.append(float(best[i]))
        place[i] = k
        order.append(i)
        left = np.ones(n, bool)
        left[order] = False
        away = np.sqrt(((x - x[i]) ** 2).sum(1))
        closer = left & (away < best)
        near[closer], best[closer] = i, away[closer]
        best[i] = np.inf
    return np.array(order), np.array(parent), np.array(edge)


class Block:
    """Rows at hand: vec_ids, labels, vectors as whole numbers, their norms; by rising vec_id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.real = self.x.astype(np.float64)
        self.norm = np.sqrt((self.real**2).sum(1)) * SLACK
        self.most = int(np.abs(self.real).max(initial=0))

    def scores(self, anchor: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        """Exact inner products with the rows at `at`."""
        bound = len(anchor) * (self.most + 1) * (int(np.abs(anchor.astype(np.float64)).max(initial=0)) + 1)
        if bound < 1 << 53:
            return np.rint(self.real[at] @ anchor.astype(np.float64)).astype(np.int64)
        if bound < 1 << 62:
            return self.x[at] @ anchor
        exact = self.x[at].astype(object) @ anchor.astype(object)
        return np.array([min(max(v, LOWEST), HIGHEST) for v in exact.tolist()], np.int64)


class Tree:
    """Anchors in an order in which parents come first."""

    def __init__(self, ids, labels, parents, edges, x, windows):
        self.ids, self.labels, self.parents, self.edges, self.x, self.windows = ids, labels, parents, edges, x, windows


def first(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Which k of rows `at`, in rising order of ids, come first by falling score, then rising id: places in at, in order."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.nonzero(scores >= least)[0]
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((at[some], -scores[some].astype(np.float64) if np.abs(scores).max(initial=0) < 1 << 52 else -scores[some]))][:k]


def search(block: Block, tree: Tree, positives: bool, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(place of the anchor, place of its window, rows, scores): what of the block stands in each anchor's windows, the first
    k of it. With positives the one window takes any score, of rows of the anchor's label other than itself; else windows
    are (low, high) with both ends in, for rows of other labels."""
    n = len(tree.ids)
    low, high = np.empty((n, len(block.ids))), np.empty((n, len(block.ids)))
    for c in range(n):
        p = tree.parents[c]
        same = block.labels == tree.labels[c]
        wanted = same & (block.ids != tree.ids[c]) if positives else ~same
        windows = [(LOWEST, HIGHEST)] if positives else tree.windows[c]
        if p < 0:
            score = block.scores(tree.x[c], slice(None))
            low[c] = high[c] = score
            rows = np.nonzero(wanted)[0]
            score = score[rows]
        else:
            reach = tree.edges[c] * SLACK * block.norm + 1e-3
            low[c], high[c] = low[p] - reach, high[p] + reach
            overlap = np.zeros(len(block.ids), bool)
            for a, b in windows:
                if a <= b:
                    # k rows that surely stand in the window shut out what surely scores below them all
                    sure = low[c][wanted & (low[c] >= a) & (high[c] <= b)]
                    if len(sure) >= k:
                        a = max(a, np.partition(sure, len(sure) - k)[len(sure) - k])
                    overlap |= (high[c] >= a) & (low[c] <= b)
            rows = np.nonzero(wanted & overlap)[0]
            score = block.scores(tree.x[c], rows)
            low[c, rows] = high[c, rows] = score
        for w, (a, b) in enumerate(windows):
            inside = np.nonzero((score >= a) & (score <= b))[0] if a <= b else np.zeros(0, int)
            best = inside[first(score[inside], rows[inside], k)]
            if len(best):
                yield c, w, rows[best], score[best]


def _numbers(rows: DataFrame, anchor: Column) -> DataFrame:
    """(vec_id, label, anchor, width, x): x as raw 64-bit integers."""

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            ends = x.offsets.to_numpy().astype(np.int64) * 8
            values = np.ascontiguousarray(x.values.to_numpy(zero_copy_only=False)).tobytes()
            cut = pa.array([values[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), batch.column("label").cast(pa.int64()), batch.column("anchor"), pa.array(np.diff(ends) // 8), cut], ["vec_id", "label", "anchor", "width", "x"])

    return rows.select("vec_id", "label", anchor.alias("anchor"), "x").mapInArrow(raw, "vec_id long, label long, anchor boolean, width long, x binary")


def _stack(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, width)


def _trees(anchors: DataFrame, total: int, sample: int = 4000, most: int = 1024) -> DataFrame:
    """(width, tree, place, parent, edge, vec_id, label, x) of anchors (vec_id, label, width, x): a tree for the anchors of one
    length that are nearest to one of some centres, fitted on a bounded sample; of over TREE such anchors, several."""
    some = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total // sample))) == 0).select("width", "x").collect()
    table = {}
    for width in {r["width"] for r in some}:
        x = np.frombuffer(b"".join(r["x"] for r in some if r["width"] == width), np.int64).reshape(-1, width).astype(np.float64)
        table[width] = centres(x, max(1, min(most, 2 * total // TREE)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, np.int64)
            for i, (width, raw) in enumerate(zip(batch.column("width").to_pylist(), batch.column("x").to_pylist())):
                if width in table:
                    near[i] = (table[width] @ np.frombuffer(raw, np.int64).astype(np.float64)).argmax()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "near"])

    dealt = written(anchors.mapInArrow(assign, "vec_id long, label long, width long, x binary, near long"))
    sizes = dealt.groupBy("width", "near").agg(F.ceil(F.count("*") / TREE).alias("parts"))
    named = dealt.join(sizes, ["width", "near"]).withColumn("tree", F.xxhash64("width", "near", F.pmod(F.xxhash64("vec_id"), F.col("parts"))))

    def grown(frame):
        frame = frame.sort_values("vec_id")
        x = np.frombuffer(b"".join(frame["x"]), np.int64).reshape(len(frame), -1).astype(np.float64)
        order, parent, edge = spanning_tree(x)
        out = frame.iloc[order][["width", "tree", "vec_id", "label", "x"]]
        return out.assign(place=np.arange(len(out)), parent=parent, edge=edge)[["width", "tree", "place", "parent", "edge", "vec_id", "label", "x"]]

    return written(named.groupBy("width", "tree").applyInPandas(grown, "width long, tree long, place int, parent int, edge double, vec_id long, label long, x binary"))


def _met(rows: DataFrame, trees: DataFrame, blocks: int, positives: bool, k: int) -> DataFrame:
    """(anchor_id, window, score, vec_id): what each block of rows (block, ...) finds for the anchors of all trees (windows:
    pairs of scores one after the other)."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    none = lambda kind: F.lit(None).cast(kind)
    held = rows.select("width", "block", none("long").alias("tree"), none("int").alias("place"), none("int").alias("parent"), none("double").alias("edge"), "vec_id", "label", "x", none("array<long>").alias("windows"))
    windows = none("array<long>") if positives else F.col("windows")
    asked = trees.select("width", every, "tree", "place", "parent", "edge", "vec_id", "label", "x", windows.alias("windows"))

    def of_tree(block: Block | None, parts: list[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
        whole = pa.concat_batches(parts)
        column = lambda c: whole.column(c).to_numpy(zero_copy_only=False)
        windows = [] if positives else [list(zip(w[::2], w[1::2])) for w in whole.column("windows").to_pylist()]
        tree = Tree(column("vec_id"), column("label"), column("parent"), column("edge"), _stack(whole.column("x"), width), windows)
        found = list(search(block, tree, positives, k)) if block else []
        if found:
            sizes = [len(at) for _, _, at, _ in found]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(tree.ids[[c for c, _, _, _ in found]], sizes)), pa.array(np.repeat([w for _, w, _, _ in found], sizes).astype(np.int32)),
                pa.array(np.concatenate([s for _, _, _, s in found])), pa.array(block.ids[np.concatenate([at for _, _, at, _ in found])]),
            ], ["anchor_id", "window", "score", "vec_id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, held, parts, tree = None, None, [], [], None
        for batch in batches:
            # runs of one block and one tree, or of one block's rows
            names = np.stack([batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("width", "block", "tree")] + [batch.column("place").is_valid().to_numpy(zero_copy_only=False)])
            cuts = [0, *(np.nonzero((names[:, 1:] != names[:, :-1]).any(0))[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                run, own = batch.slice(a, b - a), tuple(names[:, a].tolist())
                if parts and own != tree:
                    yield from of_tree(block, parts, key[0])
                    parts = []
                if own[:2] != key:
                    key, block, held = own[:2], None, []
                if not own[3]:
                    held.append(run)
                    continue
                if held:
                    whole = pa.concat_batches(held)
                    block, held = Block(whole.column("vec_id").to_numpy(), whole.column("label").to_numpy(), _stack(whole.column("x"), key[0])), []
                parts.append(run)
                tree = own
        if parts:
            yield from of_tree(block, parts, key[0])

    both = held.unionByName(asked).repartition(blocks, "width", "block").sortWithinPartitions("width", "block", F.col("place").isNotNull(), "tree", "place")
    return both.mapInArrow(meet, "anchor_id long, window int, score long, vec_id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """(anchor_id, window, best): the first k by falling score, then rising vec_id, in order."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("down"), "vec_id", "score"))), 1, k)
    return found.groupBy("anchor_id", "window").agg(best.alias("best"))


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives for the rows of `rows` (vec_id, embedding, label) that `anchor` holds for: (anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score).

    Scores are inner products of entries times 256, rounded down, in whole numbers; beyond 64 bits they stop at the ends.
    An anchor's positives are the first of the other rows of its label, by falling score, then rising vec_id. Each has as
    negatives the first of the rows of other labels whose scores are between low and high percent of its own, both in.
    Rows without a vec_id, a label or a vector, with an empty one, or with null or non-finite entries take no part. Of
    rows with one vec_id one counts: that with the least label, then the least vector. Vectors of other lengths don't
    meet. Fewer positives or negatives, or none, give as many rows; an empty table, or no anchors, an empty one. Other
    columns don't matter, whatever they are called.
    """
    spark = rows.sparkSession
    sound = quantised(rows.where("vec_id IS NOT NULL AND label IS NOT NULL"), "vec_id", "label", anchor.alias("anchor"))
    single = sound.groupBy("vec_id").agg(F.min(F.struct("label", "x", "anchor")).alias("r")).select("vec_id", "r.label", "r.anchor", "r.x")
    numbers = written(_numbers(single, F.coalesce("anchor", F.lit(False))))
    total, asked = numbers.agg(F.count("*"), F.count_if("anchor")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not asked:
        return spark.createDataFrame([], schema)
    # as many blocks as keep tasks busy, but no larger or smaller than these bounds: each block meets every anchor
    size = min(MOST_ROWS, max(LEAST_ROWS, total // 512))
    blocks = -(-total // size)
    dealt = numbers.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    trees = _trees(numbers.where("anchor").select("vec_id", "label", "width", "x"), asked)
    chosen = written(_best(_met(dealt, trees, blocks, True, positives), positives).select("anchor_id", "best"))
    # 100 s >= low p and 100 s <= high p, for whole s
    whole = lambda c: c.cast("decimal(38,0)")
    end = lambda c: F.least(F.greatest(c, whole(F.lit(LOWEST))), whole(F.lit(HIGHEST))).cast("long")
    p = lambda b: whole(b["score"])
    window = F.transform("best", lambda b: F.array(end(F.ceil(p(b) * low / 100)), end(F.floor(p(b) * high / 100))))
    windows = chosen.select(F.col("anchor_id").alias("vec_id"), F.flatten(window).alias("windows"))
    found = _best(_met(dealt, _with_windows(trees, windows), blocks, False, negatives), negatives)
    ranked = found.join(chosen.withColumnRenamed("best", "positive"), "anchor_id").select("anchor_id", F.element_at("positive", F.col("window") + 1).alias("p"), F.posexplode("best").alias("at", "n"))
    return ranked.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))


def _with_windows(trees: DataFrame, windows: DataFrame) -> DataFrame:
    """trees with their anchors' windows; anchors without positives have none, and stay for the sake of their children."""
    return trees.join(windows, "vec_id", "left").withColumn("windows", F.coalesce("windows", F.array().cast("array<long>")))
