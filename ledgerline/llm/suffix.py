"""Repeated passages by suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Sorting every suffix of a large
corpus is out of reach, so suffixes are sorted at anchors only: in every string of `length` bytes the k-byte gram with
the smallest hash is marked, so equal strings have a mark at the same place. Marks whose gram occurs once are done with.
Marks that share their whole surroundings with another mark cover them. Of the rest, with one mark for each kind of
shared surroundings, groups are made that could share a string: a string that starts between lo and hi bytes before its
mark holds the bytes from lo before the mark to length - hi behind it, so only marks with the same such core can. In each
group the bytes after a mark and the bytes before it, read backwards, are put in suffix order by deep-shallow sorting; the
common prefixes of neighbours in the two orders tell which strings around a mark occur again. A group that is too large
for a task is split by narrower ranges of starts, whose cores are longer, down to single starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerline.llm.common import discard, give_back, written

LENGTH, GRAM = 200, 50
BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 22  # bytes whose anchors are found at a time


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % (1 << 64)))
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the places of its marks and their grams' hashes: the first smallest gram of every string of length
    bytes. Texts shorter than that have none."""
    global _POWER, _INVERSE
    found: list[list] = [[] for _ in texts]
    batch, size = [], 0
    pieces: list[list[tuple[int, int, int]]] = []
    for i, t in enumerate(texts):
        step = PIECE - length + 1
        for at in range(0, max(0, len(t) - length + 1), step):  # long texts in pieces that overlap by length - 1
            end = min(len(t), at + PIECE)
            if size and size + end - at > PIECE:
                pieces.append(batch)
                batch, size = [], 0
            batch.append((i, at, end))
            size += end - at
    if batch:
        pieces.append(batch)
    for batch in pieces:
        x = np.frombuffer(b"".join(texts[i][a:e] for i, a, e in batch), np.uint8)
        n = len(x)
        if len(_POWER) <= n:
            _POWER, _INVERSE = _powers(BASE, n + 4096), _powers(pow(BASE, -1, 1 << 64), n + 4096)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _POWER[:n], out=c[1:])
        h = _mixed((c[gram:] - c[:-gram]) * _INVERSE[: n - gram + 1])
        low = np.uint64((1 << 24) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, reach, least = length - gram + 1, 1, key
        while reach * 2 <= width:
            least = np.minimum(least[: len(least) - reach], least[reach:])
            reach *= 2
        least = np.minimum(least[: len(h) - width + 1], least[width - reach : width - reach + len(h) - width + 1])
        offset = 0
        for i, a, e in batch:  # only strings inside a text
            marks = np.unique((least[offset : offset + (e - a) - length + 1] & low).astype(np.int64))
            found[i].append((marks - offset + a, h[marks]))
            offset += e - a
    out = []
    for parts in found:
        at = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.int64)
        hs = np.concatenate([q for _, q in parts]) if parts else np.zeros(0, np.uint64)
        at, first = np.unique(at, return_index=True)
        out.append((at, hs[first]))
    return out


class BlindTrie:
    """Strings of one length in order, by inserting them into a trie that keeps only the places where they branch.

    A node is [place, children by byte]; a leaf is a list of row numbers of equal strings.
    """

    def __init__(self, rows: np.ndarray):
        self.rows = [r.tobytes() for r in rows]
        self.root = None

    def add(self, i: int) -> None:
        s = self.rows[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # blind: only branching bytes are looked at, any leaf below will do
            place, below = node
            node = below.get(s[place]) or next(iter(below.values()))
        other = self.rows[node[0]]
        if other == s:
            node.append(i)
            return
        a, b = np.frombuffer(s, np.uint8), np.frombuffer(other, np.uint8)
        differs = int((a != b).argmax())
        parent, node, byte = None, self.root, 0
        while isinstance(node, tuple) and node[0] < differs:
            parent, byte = node, s[node[0]]
            node = node[1][byte]
        if isinstance(node, tuple) and node[0] == differs:
            node[1][s[differs]] = [i]
            return
        made = (differs, {s[differs]: [i], other[differs]: node})
        if parent is None:
            self.root = made
        else:
            parent[1][byte] = made

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


SMALL = 12  # rows that go to a blind trie at once


def deep_shallow_order(rows: np.ndarray, group: np.ndarray, shallow: int = 64) -> np.ndarray:
    """Order of rows (n x bytes) within groups, by group first.

    Shallow: multikey quicksort with words of eight bytes as characters. A run of rows that agree up to a depth is split
    in three by a pivot word there; the rows that equal the pivot go on one word deeper, the others at the same depth.
    Deep: runs that still agree at the shallow depth, and small ones, go through a blind trie.
    """
    n, wide = rows.shape
    padded = np.zeros((n, -(-wide // 8) * 8), np.uint8)
    padded[:, :wide] = rows
    words = padded.view(">u8").astype(np.uint64)
    deep = min(words.shape[1], shallow // 8)
    order = np.argsort(group, kind="stable")
    bounds = np.concatenate(([0], np.nonzero(np.diff(group[order]))[0] + 1, [n])).tolist() if n else []
    stack = [(a, b, 0) for a, b in zip(bounds, bounds[1:]) if b - a > 1]
    while stack:
        start, end, depth = stack.pop()
        part = order[start:end]
        if end - start <= SMALL or depth == deep:
            trie = BlindTrie(rows[part])
            for i in range(len(part)):
                trie.add(i)
            order[start:end] = part[trie.order()]
            continue
        value = words[part, depth]
        pivot = np.sort(value[[0, len(value) // 2, -1]])[1]
        less, more = value < pivot, value > pivot
        same = ~(less | more)
        order[start:end] = np.concatenate((part[less], part[same], part[more]))
        first, last = start + int(less.sum()), end - int(more.sum())
        stack += [(a, b, d) for a, b, d in ((start, first, depth), (first, last, depth + 1), (last, end, depth)) if b - a > 1]
    return order


def _common(rows: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it in order; -1 at the first of a group."""
    a, b = rows[order[1:]], rows[order[:-1]]
    differs = np.ones((len(a), rows.shape[1] + 1), bool)  # strings end somewhere, those without a byte too
    np.not_equal(a, b, out=differs[:, :-1])
    lcp = differs.argmax(1)
    return np.concatenate(([-1], np.where(group[order[1:]] == group[order[:-1]], lcp, -1)))


def repeated_around(before: np.ndarray, after: np.ndarray, has_before: np.ndarray, has_after: np.ndarray, group: np.ndarray, weight: np.ndarray, length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For each mark, how far before it, from low to high, the first and the last repeated string of length bytes around
    it start; (-1, -1) if none does. before is read backwards from the mark; weight is how many marks a row stands for."""
    n = len(group)
    first, last = np.full(n, -1), np.full(n, -1)
    if not n:
        return first, last
    orders = []
    for rows in (before, after):
        order = deep_shallow_order(rows, group)
        orders.append((order, _common(rows, order, group)))
    classes = np.zeros((2, n), np.int64)
    for back in range(low, high + 1):
        ahead = length - back
        whole = np.nonzero((has_before >= back) & (has_after >= ahead))[0]
        if not len(whole):
            continue
        for k, ((order, lcp), need) in enumerate(zip(orders, (back, ahead))):
            classes[k][order] = np.cumsum(lcp < need)
        pair = classes[0][whole] * (n + 1) + classes[1][whole]
        by = np.argsort(pair, kind="stable")
        begins = np.concatenate(([True], np.diff(pair[by]) != 0))
        kind = np.cumsum(begins) - 1
        many = np.bincount(kind, weight[whole][by])[kind] >= 2
        hit = whole[by[many]]
        last[hit] = back
        first[hit] = np.where(first[hit] < 0, back, first[hit])
    return first, last


def kinds_of_marks(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The marks of texts, those of one text with the same gram and surroundings put together: text, gram, surroundings'
    hash, number, place, bytes back and ahead of the first, and the ranges that they cover, merged: how many of each kind,
    their begins and ends. A text that repeats a short pattern has few kinds of marks, however long it is."""
    reach = length - gram
    found = anchors(texts, length, gram)
    count = [len(at) for at, _ in found]
    of = np.repeat(np.arange(len(texts)), count)
    at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
    grams = np.concatenate([h for _, h in found]) if found else np.zeros(0, np.uint64)
    begin, end = at - np.minimum(at, reach), np.minimum(at + length, np.repeat([len(x) for x in texts], count))
    digest = xxhash.xxh3_64_intdigest
    around = np.array([digest(texts[k][b:e], a - b) for k, a, b, e in zip(of.tolist(), at.tolist(), begin.tolist(), end.tolist())], np.uint64)
    order = np.lexsort((at, around, grams, of))
    of, grams, around, at, begin, end = (x[order] for x in (of, grams, around, at, begin, end))
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (grams[1:] != grams[:-1]) | (around[1:] != around[:-1])))[: len(of)]
    apart = new | np.concatenate(([True], begin[1:] > end[:-1]))[: len(of)]
    first, span = np.nonzero(new)[0], np.nonzero(apart)[0]
    number = np.diff(np.append(first, len(of)))
    spans = np.diff(np.append(np.searchsorted(span, first), len(span)))
    lasts = np.append(span[1:], len(of)) - 1
    return of[first], grams[first], around[first], number, at[first], (at - begin)[first], (end - at)[first], spans, begin[span], end[lasts] if len(of) else end


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = 20_000) -> DataFrame:
    """(doc, t, begin, end): byte ranges of the rows of docs (doc, t, text) that strings of length bytes cover which start
    somewhere else too. Rows with the same doc and t hold the same text. A task sorts about bucket_rows marks at a time;
    larger groups are split."""
    reach = length - gram

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                of, grams, around, number, at, back, ahead, spans, begins, ends = kinds_of_marks([t.encode() for t in part.column("text").to_pylist()], length, gram)
                offsets = pa.array(np.concatenate(([0], np.cumsum(spans))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (begins, ends)]
                doc, t = part.column("doc").to_numpy()[of], part.column("t").to_numpy()[of]
                columns = [doc, t, grams.view(np.int64), around.view(np.int64), number.astype(np.int32), at.astype(np.int32), back.astype(np.int16), ahead.astype(np.int16)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *lists], ["doc", "t", "gram", "around", "n", "at", "back", "ahead", "begins", "ends"])
        give_back()

    marked = docs.where(F.octet_length("text") >= length).mapInArrow(marks, "doc long, t long, gram long, around long, n int, at int, back short, ahead short, begins array<int>, ends array<int>")
    # the smaller sides of joins are written first, so that adaptive execution can split a hot key of the larger
    again = written(marked.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"))
    candidates = written(marked.join(again, "gram"))
    discard(again)

    kinds = written(candidates.groupBy("gram", "around").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "t", "at", "back", "ahead")).alias("one")))
    shared = kinds.where("n > 1").select("gram", "around")
    done = candidates.join(shared, ["gram", "around"]).select("doc", "t", F.explode(F.arrays_zip("begins", "ends")).alias("x")).selectExpr("doc", "t", "CAST(x.begins AS bigint) AS begin", "CAST(x.ends AS bigint) AS end")

    # grams with a mark that shares its surroundings with none, and with other marks to hold it against
    open_ = written(kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("gram"))
    left = kinds.join(open_, "gram").select(F.least("n", F.lit(2)).cast("int").alias("n"), "one.*")
    wanted = left.groupBy("doc", "t").agg(F.collect_list(F.struct("n", "at", "back", "ahead")).alias("marks"))

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds_ = ["doc", "t", "n", "at", "back", "ahead", "bytes"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.int16(), pa.binary()]
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows: list[list] = [[] for _ in names]
                for doc, t, text, some in zip(*(part.column(c).to_pylist() for c in ("doc", "t", "text", "marks"))):
                    raw = text.encode()
                    for m in some:
                        at, back, ahead = m["at"], m["back"], m["ahead"]
                        for column, value in zip(rows, (doc, t, m["n"], at, back, ahead, raw[at - back : at + ahead])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds_)], names)
        give_back()

    texts = docs.join(wanted, ["doc", "t"]).mapInArrow(surroundings, "doc long, t long, n int, at int, back short, ahead short, bytes binary")
    texts = written(texts.dropDuplicates(["doc", "t", "at"]))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (low, high), part in frame.sort_values(["core", "doc", "t", "at"]).groupby(["low", "high"]):
            n, back, ahead = len(part), part["back"].to_numpy(), part["ahead"].to_numpy()
            before, after = np.zeros((n, int(high)), np.uint8), np.zeros((n, length - int(low)), np.uint8)
            for i, (raw, b) in enumerate(zip(part["bytes"], back.tolist())):
                x = np.frombuffer(raw, np.uint8)
                near, far = x[max(0, b - int(high)) : b][::-1], x[b : b + length - int(low)]
                before[i, : len(near)], after[i, : len(far)] = near, far
            first, last = repeated_around(before, after, back, ahead, part["core"].to_numpy(), part["n"].to_numpy(), length, int(low), int(high))
            hit = (first >= 0) & (part["n"].to_numpy() == 1)  # marks that stand for several are done already
            at = part["at"].to_numpy()[hit].astype(np.int64)
            out.append(pd.DataFrame({"doc": part["doc"].to_numpy()[hit], "t": part["t"].to_numpy()[hit], "begin": at - last[hit], "end": at - first[hit] + length}))
        return pd.concat(out)

    discard(open_)
    used = [candidates, kinds, texts]

    def settled(found: DataFrame) -> DataFrame:
        """found written, so that what it was made from can go."""
        out = written(found)
        discard(*used)
        return out

    found, cut, width = done, texts.select("*", F.lit(0).alias("low"), F.lit(reach).alias("high")), reach // 2 + 1
    while True:
        # each mark for every range of starts that it has; a core's bytes are there wherever one of the range's starts is
        begins = F.explode(F.sequence("low", "high", F.lit(width))).alias("low")
        ranged = cut.select("doc", "t", "n", "at", "back", "ahead", "bytes", "high", begins).withColumn("high", F.least(F.col("low") + width - 1, "high"))
        ranged = ranged.where(F.greatest("low", F.lit(length) - F.col("ahead")) <= F.least("high", "back"))
        core = F.xxhash64("low", F.expr(f"substring(bytes, back - low + 1, low + {length} - high)"))
        keys = written(ranged.select("doc", "t", "at", "n", "low", "high", core.alias("core")))
        sizes = written(keys.groupBy("core").agg(F.count("*").alias("rows"), F.min("n").alias("least")).where("rows > 1 AND least = 1").select("core", "rows"))
        used += [keys, sizes]
        most = sizes.agg(F.max("rows").alias("most"), F.sum("rows").alias("rows")).first()
        if not most["rows"]:
            return settled(found)
        ready = keys.join(sizes, "core").select("doc", "t", "at", "low", "high", "core", "rows")
        some = ready.where(F.col("rows") <= bucket_rows).join(texts, ["doc", "t", "at"])
        buckets = max(1, int(most["rows"]) // bucket_rows)
        found = found.unionByName(some.groupBy(F.pmod("core", F.lit(buckets)).alias("bucket")).applyInPandas(search, "doc long, t long, begin long, end long"))
        if most["most"] <= bucket_rows:
            return settled(found)
        large = ready.where(F.col("rows") > bucket_rows)
        if width == 1:  # a core is a whole string here: its marks share it
            alike = large.join(texts.where("n = 1").select("doc", "t", "at"), ["doc", "t", "at"])
            return settled(found.unionByName(alike.selectExpr("doc", "t", "CAST(at - low AS bigint) AS begin", f"CAST(at - low + {length} AS bigint) AS end")))
        cut, width = written(large.select("doc", "t", "at", "low", "high").join(texts, ["doc", "t", "at"])), max(1, width // 4)
        used.append(cut)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text all
    columns of docs, the text being what is left, with characters that were cut through left out.

    Null texts count as empty and stay null with keep_text. Rows that repeat a text, same doc_id or not, are texts of
    their own: their strings occur again. Rows without doc_id are treated alike. An empty table gives an empty one.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    lists = repeats(keyed.select("doc", "t", F.coalesce("text", F.lit("")).alias("text")), length).groupBy("doc", "t").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    joined = keyed.join(lists, ["doc", "t"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                kept, facts = [], []
                for text, some in zip(part.column("text").to_pylist(), part.column("ranges")):
                    raw = (text or "").encode()
                    removed, spans, left, at = 0, 0, [], 0
                    if some.is_valid:
                        begin, end = (np.asarray(some.values.field(k)) for k in ("begin", "end"))
                        order = np.argsort(begin)
                        begin, end = begin[order], np.maximum.accumulate(end[order])
                        new = np.concatenate(([True], begin[1:] > end[:-1]))
                        for b, e in zip(begin[new].tolist(), end[np.concatenate((new[1:], [True]))].tolist()):
                            left.append(raw[at:b])
                            removed, spans, at = removed + e - b, spans + 1, e
                    left.append(raw[at:])
                    rest = b"".join(left)
                    kept.append(None if text is None else rest.decode("utf-8", "ignore"))
                    facts.append((len(raw), removed, spans, hashlib.sha256(rest).hexdigest() if not keep_text else ""))
                if keep_text:
                    yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(kept, pa.string())], ["row", "kept"])
                else:
                    columns = list(zip(*facts))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        give_back()

    if keep_text:
        whole = StructType([StructField("row", docs.schema), StructField("kept", StringType())])
        done = joined.select("row", "text", "ranges").mapInArrow(cut, whole)
        return done.select(*(F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
    return joined.select(F.col("row.doc_id").alias("doc_id"), "text", "ranges").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
