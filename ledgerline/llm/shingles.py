"""Near copies by the Jaccard similarity of their word shingles: every pair at or above it is found and verified.

Candidates come in two rounds. The first is cheap: what the vantage-point search links among SimHash fingerprints of the
shingles, and neighbours in the lists of documents that share a shingle. What is verified of them is put together, so
that large groups are mostly one component already; in long lists each set is also tried with the one that has the largest
share of common shingles, as an unchanged original has. The second is exact: two sets of similarity s share one of the first
|S| - ceil(s |S|) + 1 shingles of each, in any order common to all sets, so that all pairs of different components that
share such a shingle are tried. Shingles common in a sample come last in the order, so that lists stay short.

In a long list, sets meet in blocks inside tasks, by parity sketches: sets that differ in d shingles differ in d bits at
most, so that only pairs that may be similar enough come out.

Only the shingles that sets must share one of are shuffled, once; texts of candidates are fetched, packed, to verify them.
Texts that aren't wanted don't move: a sieve of bounded size, over hashes of those that are, lets them pass by.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import simhash
from ledgerline.llm.common import components, discard, give_back, small_batches, written
from ledgerline.llm.pitman_yor import token_hashes

SEED = 42
WORDS_IN = 5
LONG = 32  # sets of a list that are paired by a join; the sets of longer lists meet in blocks
BLOCK = 5000
SKETCH = 1024
TOP, BOTTOM = 4, 5  # near copies have a similarity of 4/5 or more; kept whole, so that nothing is rounded
#: Odd multipliers, one for each word of a shingle.
PLACES = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WORDS_IN)], np.uint64)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a text of fewer words is one shingle, one without words none.
    A-Z are lower-cased. A shingle's hash is a mixed sum of its words' 64-bit hashes, each times its place's multiplier."""
    hashes, of = token_hashes([(t or "").encode().lower() for t in texts])
    ends = np.searchsorted(of, np.arange(len(texts)), "right")  # each text's hashes end with the token for the end
    begins = np.concatenate(([0], ends[:-1])) if len(texts) else ends
    total = np.zeros(len(hashes), np.uint64)
    for k in range(WORDS_IN):
        total[: len(hashes) - k] += hashes[k:] * PLACES[k]
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    out = []
    for b, e in zip(begins.tolist(), (ends - 1).tolist()):
        n = e - b
        if n >= WORDS_IN:
            out.append(np.unique(total[b : e - WORDS_IN + 1]))
        elif n:
            out.append(np.array([xxhash.xxh64_intdigest(hashes[b:e].tobytes(), SEED)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _print(own: np.ndarray) -> np.uint64:
    """SimHash of a set of shingles."""
    if not len(own):
        return np.uint64(0)
    count = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 15):
        count += np.unpackbits(own[at : at + (1 << 15)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint32)
    return np.packbits(count * 2 > len(own)).view(np.uint64)[0]


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _common(docs: DataFrame, rows: int, sample: int = 4000, share: int = 8) -> Callable[[pd.Series], pd.Series]:
    """A test of shingles' hashes, to be used in tasks: whether several texts of a sample hold it. It only decides in which
    order shingles come, so that a few others may pass.

    The sample is the same share of every large table: of a smaller one, shingles would have to be in more texts to be
    found, and the lists of those that aren't would grow with the table."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(min(share, max(1, rows // sample)))) == 0).select("text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(part.column("text").to_pylist())).view(np.int64))], ["g"])
        give_back()

    found = written(some.mapInArrow(own, "g long").groupBy("g").count().where("count > 2").select("g"))
    passes = _sieve(found)
    discard(found)
    return passes


def _sets(docs: DataFrame, common: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(doc_id, t, k, fp, n, late, bits, first) for every row of docs: a hash of the text, one of the set, its fingerprint
    and size, how many of its shingles are common, its parity sketch, and the shingles, in the common order, that another
    set must share one of."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            keys, prints, sizes, lates, bits, firsts = [], [], [], [], [], []
            sets = shingle_sets(part.column("text").to_pylist())
            tested = common(pd.Series(np.concatenate(sets))).to_numpy()
            for own, is_late in zip(sets, np.split(tested, np.cumsum([len(x) for x in sets])[:-1])):
                keys.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                prints.append(_print(own))
                sizes.append(len(own))
                bits.append(np.packbits(np.bincount((own % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).tobytes())
                lates.append(int(is_late.sum()))
                if lates[-1]:
                    own = np.concatenate((own[~is_late], own[is_late]))
                firsts.append(own[: len(own) - -(-TOP * len(own) // BOTTOM) + 1].view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in firsts])))
            first = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(firsts)))
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("t"), longs(keys), longs(prints), pa.array(sizes, pa.int32()), pa.array(lates, pa.int32()), pa.array(bits, pa.binary()), first], ["doc_id", "t", "k", "fp", "n", "late", "bits", "first"])
        give_back()

    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).mapInArrow(hashed, "doc_id long, t long, k long, fp long, n int, late int, bits binary, first array<long>")


def _lists(kinds: DataFrame) -> DataFrame:
    """(g, k, n, at) for the shingles g that may have to be shared, where several sets have them: at counts from 1.

    Rows are range-sorted, so that a hot shingle is dealt over several partitions; what stands at a partition's ends stays
    even if it is alone there.
    """

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, whose run may go on
        kept = True  # whether it stays in any case: it begins the partition or its run
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.concat_batches([held, batch])
            g = whole.column("g").to_numpy()
            same = g[1:] == g[:-1]
            keep = np.concatenate(([kept], same)) | np.concatenate((same, [False]))
            yield whole.slice(0, len(g) - 1).filter(pa.array(keep[:-1]))
            held, kept = whole.slice(len(g) - 1), bool(keep[-1])
        if held is not None:
            yield held

    rows = kinds.select(F.posexplode("first").alias("at", "g"), "k", "n").select("g", "k", "n", (F.col("at") + 1).alias("at"))
    return rows.repartitionByRange("g", "n", "k").sortWithinPartitions("g", "n", "k").mapInArrow(repeated, "g long, k long, n int, at int")


def _alike(lists: DataFrame) -> DataFrame:
    """(g, k, n, at, times) from lists (g, k, n, at): lists of the same sets, as the shingles of one passage have, become
    one, told by a 64-bit hash of its sets. times counts the shingles, at is the last one's place."""
    same = lists.groupBy("g").agg(F.expr("bit_xor(xxhash64(k))").alias("same"))
    rows = lists.join(same, "g").groupBy("same", "k").agg(F.min("n").alias("n"), F.max("at").alias("at"), F.count("*").alias("times"))
    return rows.withColumnRenamed("same", "g")


def _near(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets of kinds (k, n, bits) that can be similar enough by their sizes and sketches: no pair that
    is gets lost, as sets differ in no fewer shingles than their sketches differ in bits."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, 4096):
            n = part.column("n_a").to_numpy().astype(np.int64) + part.column("n_b").to_numpy()
            bits = [np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(len(n), -1) for c in ("bits_a", "bits_b")]
            differing = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
            yield part.select(["a", "b"]).filter(pa.array((TOP + BOTTOM) * differing <= (BOTTOM - TOP) * n))

    side = lambda c: kinds.select(F.col("k").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{BOTTOM} * least(n_a, n_b) >= {TOP} * greatest(n_a, n_b)")
    return sized.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(near, "a long, b long")


def _sieve(wanted: DataFrame, most: int = 1 << 25) -> Callable[[pd.Series], pd.Series]:
    """A test of hashes, to be used in tasks: true for all in the one column of wanted, and for few others. It is a Bloom filter of 16 bits for
    each, `most` bits altogether; with more hashes than those suffice for it lets more others through, never fewer."""
    bits = 1 << min(most.bit_length() - 1, max(10, (16 * wanted.count()).bit_length()))

    def places(h: np.ndarray) -> list[np.ndarray]:
        mixed = [(h * np.uint64(m)) >> np.uint64(32) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        return [x & np.uint64(bits - 1) for x in mixed]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            for at in places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                own[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()])], ["bits"])

    total = np.zeros(bits // 8, np.uint8)
    for row in wanted.repartition(8).mapInArrow(marked, "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], np.uint8)
    shared = wanted.sparkSession.sparkContext.broadcast(total)

    def passes(h: pd.Series) -> pd.Series:
        table = shared.value
        found = [table[x >> np.uint64(3)] >> (np.uint64(7) - (x & np.uint64(7))).astype(np.uint8) & 1 for x in places(h.to_numpy().view(np.uint64))]
        return pd.Series((found[0] & found[1]).astype(bool))

    return passes


def _verified(pairs: DataFrame, kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets of kinds (k, n, bits, first_id, first_t) whose similarity is high enough, by their texts.
    Texts are fetched only for pairs that their sketches leave open."""
    pairs = written(_near(pairs, kinds))
    wanted = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    one = written(kinds.join(wanted, "k", "left_semi").select("k", "first_id", "first_t"))
    passes = _sieve(one.select("first_t"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            part = part.filter(pa.array(passes(part.column("first_t").to_pandas())))
            texts = pa.array([zlib.compress(t, 1) for t in part.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("first_t"), texts], ["id", "first_t", "text"])
        give_back()

    # one pass of one worker: a filter on a UDF's result would have Spark work it out twice, in two workers of each task
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("first_t", F.xxhash64("text"))
    keyed = keyed.mapInArrow(packed, "id long, first_t long, text binary")
    with small_batches(docs.sparkSession):
        texts = written(keyed.join(one, "first_t").where(F.col("id").eqNullSafe(F.col("first_id"))).select("k", "text").dropDuplicates(["k"]))
    of = lambda c: texts.select(F.col("k").alias(c), F.col("text").alias(f"text_{c}"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, 64):
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            texts_of = dict(zip(a + b, part.column("text_a").to_pylist() + part.column("text_b").to_pylist()))
            own = dict(zip(texts_of, shingle_sets([zlib.decompress(t).decode() for t in texts_of.values()])))
            good = []
            for x, y in zip(a, b):
                shared = len(np.intersect1d(own[x], own[y], assume_unique=True))
                good.append(BOTTOM * shared >= TOP * (len(own[x]) + len(own[y]) - shared))
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        give_back()

    with small_batches(docs.sparkSession):
        found = written(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(similar, "a long, b long"))
    discard(pairs, one, texts)
    return found


def _neighbours(rows: DataFrame, by: str) -> DataFrame:
    """Pairs of sets that come one after the other, by size, among rows (by, n, k) of the same key, where their sizes
    allow it."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            key, n, k = (batch.column(c).to_numpy() for c in (by, "n", "k"))
            if not len(key):
                continue
            if before is not None:
                key, n, k = (np.concatenate(([x], y)) for x, y in zip(before, (key, n, k)))
            at = np.nonzero((key[1:] == key[:-1]) & (k[1:] != k[:-1]) & (BOTTOM * n[:-1] >= TOP * n[1:]))[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[at], k[at + 1])), pa.array(np.maximum(k[at], k[at + 1]))], ["a", "b"])
            before = key[-1], n[-1], k[-1]

    # range partitions: a hot key is dealt over several, at the cost of one pair at each border
    dealt = rows.select(by, "n", "k").repartitionByRange(by, "n", "k").sortWithinPartitions(by, "n", "k")
    return dealt.mapInArrow(pairs, "a long, b long").distinct()


def _hubs(lists: DataFrame, kinds: DataFrame) -> DataFrame:
    """Pairs of each set of a long list with the list's hub, the set with the largest share of common shingles."""
    long = written(lists.groupBy("g").agg(F.count("*").alias("rows")).where(F.col("rows") > LONG).select("g"))
    rows = written(lists.join(long, "g").select("g", "k", "n"))
    shares = kinds.join(rows.select("k").distinct(), "k", "left_semi").select("k", (F.col("late") / F.col("n")).alias("share"))
    best = written(rows.join(shares, "k").groupBy("g").agg(F.max(F.struct("share", "k", "n")).alias("hub")))
    pairs = rows.join(best, "g").where(f"k <> hub.k AND {BOTTOM} * least(n, hub.n) >= {TOP} * greatest(n, hub.n)")
    return pairs.select(F.least("k", "hub.k").alias("a"), F.greatest("k", "hub.k").alias("b"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of one long list (g, k, n, c, bits, rows) of different components c that may be similar enough
    by their sketches. Each two blocks of a list meet in one group."""
    blocks = F.ceil(F.col("rows") / BLOCK)
    own = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("g", "k", "n", "c", "bits", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def close(frame: pd.DataFrame) -> pd.DataFrame:
        k, n, c = (frame[x].to_numpy() for x in ("k", "n", "c"))
        bits = np.frombuffer(b"".join(frame["bits"]), np.uint64).reshape(len(frame), -1)
        first = np.nonzero(frame["own"].to_numpy() == frame["i"].to_numpy())[0]
        second = np.nonzero(frame["own"].to_numpy() == frame["j"].to_numpy())[0]
        out = []
        for at in range(0, len(first), 128):
            x = first[at : at + 128]
            p, q = np.nonzero((c[x, None] != c[second]) & (k[x, None] != k[second]) & (BOTTOM * np.minimum(n[x, None], n[second]) >= TOP * np.maximum(n[x, None], n[second])))
            for cut in range(0, len(p), 1 << 16):
                u, v = x[p[cut : cut + (1 << 16)]], second[q[cut : cut + (1 << 16)]]
                differing = np.bitwise_count(bits[u] ^ bits[v]).sum(1, dtype=np.int64)
                near = (TOP + BOTTOM) * differing <= (BOTTOM - TOP) * (n[u].astype(np.int64) + n[v])
                out.append(np.stack((np.minimum(k[u], k[v])[near], np.maximum(k[u], k[v])[near])))
        found = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"a": found[0], "b": found[1]})

    return dealt.groupBy("g", "i", "j").applyInPandas(close, "a long, b long")


def _candidates(lists: DataFrame, known: DataFrame, kinds: DataFrame) -> DataFrame:
    """All pairs (a, b) of sets of different components that can be similar enough, by the shingles of lists
    (g, k, n, at, times) that they share."""
    rows = written(lists.join(known.select(F.col("node").alias("k"), "component"), "k", "left").select("g", "k", "n", "at", "times", F.coalesce("component", "k").alias("c")))
    mixed = written(rows.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("rows")).where("low < high").select("g", "rows"))
    labelled, rows = rows, written(rows.join(mixed, "g"))
    long = rows.where(F.col("rows") > LONG).select("g", "k", "n", "c", "rows")
    met_long = _blocks(long.join(kinds.select("k", "bits"), "k"))
    short = rows.where(F.col("rows") <= LONG)
    side = lambda s: [F.col(x).alias(f"{x}_{s}") for x in ("k", "n", "at", "times", "c")]
    both = short.select("g", *side("a")).join(short.select("g", *side("b")), "g").where(f"k_a < k_b AND c_a <> c_b AND {BOTTOM} * least(n_a, n_b) >= {TOP} * greatest(n_a, n_b)")
    met = both.groupBy("k_a", "k_b", "n_a", "n_b").agg(F.sum("times_a").alias("shared"), F.max("at_a").alias("i"), F.max("at_b").alias("j"))
    # of what comes up to the last shared one all else differs, but for what stands in long lists, and so does what is left
    # of one of the two beginnings
    first = lambda n: f"({n} - ceil({n} * {TOP} / {BOTTOM}) + 1)"
    differing = f"i + j - 2 * shared + least({first('n_a')} - i, {first('n_b')} - j)"
    whole = written(met.where(f"({TOP} + {BOTTOM}) * ({differing}) <= ({BOTTOM} - {TOP}) * (n_a + n_b)").selectExpr("k_a AS a", "k_b AS b"))
    found = written(whole.union(met_long).distinct())
    discard(labelled, rows, mixed, whole)
    return found


def linked(kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of the sets of kinds (k, fp, n, first, first_id, first_t) that have a near copy: components over
    all pairs of similarity 4/5 or more."""
    each = written(_lists(kinds))
    lists = written(_alike(each))
    discard(each)
    # sets of one fingerprint, and one set for each of two fingerprints that the vantage-point search links
    prints = written(kinds.select("fp", "n", "k"))
    one = prints.groupBy("fp").agg(F.min("k").alias("k"))
    end = lambda c: one.select(F.col("fp").alias(c), F.col("k").alias(f"k_{c}"))
    across = simhash.edges(prints).distinct().join(end("a"), "a").join(end("b"), "b").select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b"))
    quick = _verified(written(across.union(_neighbours(prints, "fp")).union(_neighbours(lists, "g")).union(_hubs(lists, kinds)).distinct()), kinds, docs)
    rest = _verified(_candidates(lists, components(quick), kinds), kinds, docs)
    discard(lists, prints)
    return components(quick.union(rest))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that come first in their component of near copies, as in simhash.keep_one:
    texts whose shingles of five words have a similarity of 4/5 or more are near copies.

    Texts without words are near copies of each other: null, empty and blank ones. Of repeated rows one stays. Other
    columns don't matter, whatever they are called. An empty table gives an empty one.
    """
    with small_batches(docs.sparkSession):
        sets = written(_sets(docs, _common(docs, docs.count())))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "t")).alias("first")
    kinds = sets.groupBy("k").agg(first, F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("late").alias("late"), F.min("bits").alias("bits"), F.min("first").alias("shared"))
    kinds = written(kinds.select("k", "fp", "n", "late", "bits", F.col("shared").alias("first"), F.col("first.doc_id").alias("first_id"), F.col("first.t").alias("first_t")))
    rows = written(sets.select("doc_id", "t", "k"))
    discard(sets)
    labels = kinds.select("k", "first_id", "first_t").join(linked(kinds, docs).select(F.col("node").alias("k"), "component"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    labels = written(labels)
    discard(kinds)
    row = F.struct(F.col("first_id").isNull().alias("without"), F.col("first_id").alias("doc_id"), F.col("first_t").alias("t"))
    firsts = written(labels.groupBy("component").agg(F.min(row).alias("first")))
    # texts of rows that go, or that come up more than once, move; all others are what stays of their component
    times = rows.groupBy("doc_id", "t", "k").agg(F.count("*").alias("n")).join(labels.select("k", "component"), "k").join(firsts, "component")
    doubtful = written(times.where("n > 1 OR t <> first.t OR NOT (doc_id <=> first.doc_id)").select("t").distinct())
    passes = F.pandas_udf(_sieve(doubtful), "boolean")(F.xxhash64(F.coalesce("text", F.lit(""))))
    return docs.where(~passes).union(simhash.rows_of(docs.where(passes), firsts))
