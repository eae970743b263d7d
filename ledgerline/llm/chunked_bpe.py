"""Byte-level BPE from a file of ranks, with long texts pre-tokenised in overlapping chunks.

A text of up to CHUNK characters is split by the pattern at once. A longer one is cut into chunks that run OVERLAP
characters into the next, which are dealt over all tasks and split each by itself from wherever it begins. As a match
depends only on what follows its beginning, two chunks that have one boundary in common agree from there on: the first
such place in each overlap is the stitch, up to which the earlier chunk's pieces count, and from which the later one's
do. Only the boundaries in overlaps meet in a window; the texts stay where they are. A text with an overlap that has no
stitch, as inside of one very long word, is split chunk after chunk instead, with what is unfinished carried along.

Pieces are encoded by their ranks: the adjacent two with the lowest rank of their union are joined, the leftmost of equals
first. Ids are decoded by concatenating the bytes that they stand for.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.bpe import SPLIT
from ledgerline.llm.common import written

CHUNK, OVERLAP = 32_768, 512
#: Characters after a piece that its match may have looked at: the longest fixed alternative of the pattern.
AHEAD = 3
#: Bytes of a piece from which a heap orders its merges; shorter ones are merged side by side.
LONG = 256
NONE = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank by token of a file with a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merger:
    """Ranks compiled to arrays. keys: pairs of ids whose union has a rank, sorted; rank: that rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.label = ranks, {r: t for t, r in ranks.items()}
        pairs = {a << 32 | b: r for t, r in ranks.items() for cut in range(1, len(t)) if (a := ranks.get(t[:cut])) is not None and (b := ranks.get(t[cut:])) is not None}
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def unions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each two ids' union, NONE where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of many short words, each as little-endian 32-bit integers. In each round every word has one merge."""
        out = [b""] * len(words)
        size = np.array([len(w) for w in words])
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), size)
        last = lambda of: np.append(of[1:] != of[:-1], True)  # noqa: E731  ends of words
        rank = np.full(len(ids), NONE)
        rank[:-1] = self.unions(ids[:-1], ids[1:])
        rank[last(of)] = NONE
        while len(ids):
            begin = np.nonzero(np.append(True, of[1:] != of[:-1]))[0]
            size = np.diff(np.append(begin, len(ids)))
            least = np.minimum.reduceat(rank, begin)
            done = least == NONE
            if done.any():
                raw = ids.astype("<u4")
                for w, b, n in zip(of[begin[done]].tolist(), begin[done].tolist(), size[done].tolist()):
                    out[w] = raw[b : b + n].tobytes()
                stays = np.repeat(~done, size)
                ids, of, rank = ids[stays], of[stays], rank[stays]
                size, least = size[~done], least[~done]
                if not len(ids):
                    break
            low = np.nonzero(rank == np.repeat(least, size))[0]
            at = low[np.append(True, of[low[1:]] != of[low[:-1]])]  # the leftmost of each word
            ids[at] = rank[at]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            at -= np.arange(len(at))
            ids, of, rank = ids[stays], of[stays], rank[stays]
            ends = last(of)
            for place in (at, at[at > 0] - 1):
                inner = place[~ends[place]]
                rank[inner] = self.unions(ids[inner], ids[inner + 1])
            rank[ends] = NONE
        return out

    def merge_long(self, word: bytes) -> bytes:
        """As merge for one word of any length, in n log n steps: a heap of pairs, and links to what is left beside them."""
        ids = self.first[np.frombuffer(word, np.uint8)]
        n = len(ids)
        rank = self.unions(ids[:-1], ids[1:]).tolist()
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank.append(NONE)
        heap = [(r, i) for i, r in enumerate(rank) if r < NONE]
        heapq.heapify(heap)
        pairs = dict(zip(self.keys.tolist(), self.rank.tolist())) if heap else {}
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue  # merged away, or with another neighbour now
            gone = after[i]
            ids[i], after[i], rank[gone] = r, after[gone], -1
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0:
                    right = after[left]
                    rank[left] = pairs.get(ids[left] << 32 | ids[right], NONE) if right < n else NONE
                    if rank[left] < NONE:
                        heapq.heappush(heap, (rank[left], left))
        path, i = [], 0
        while i < n:
            path.append(ids[i])
            i = after[i]
        return np.array(path, "<u4").tobytes()


class Encoder:
    """A merger with the pieces that a worker has met, at most so many, forgotten all at once."""

    def __init__(self, merger: Merger, split: str, remembered: int = 500_000):
        self.merger, self.remembered, self.find, self.known = merger, remembered, regex.compile(split).findall, {}

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each list of pieces as little-endian 32-bit integers."""
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = set().union(*texts)
        ranks, rest = self.merger.ranks, []
        for piece in new:
            word = piece.encode()
            whole = ranks.get(word)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(word) < LONG:
                rest.append((piece, word))
            else:
                self.known[piece] = self.merger.merge_long(word)
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            self.known.update(zip((p for p, _ in part), self.merger.merge([w for _, w in part])))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in texts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merger.label.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _chunks(long: DataFrame, split: str, chunk: int, overlap: int) -> DataFrame:
    """(key, part, doc_id, base, final, text, ends) of long texts: a number for each row, the chunk's place, where it begins,
    whether it is the last, its characters, and where its pieces end; of ends that a cut could have moved, none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _slices(batches, 1):
            key, doc_id, text = row.column("key"), row.column("doc_id"), row.column("text")[0].as_py()
            starts = range(0, max(1, len(text) - overlap), chunk)
            for part, at in enumerate(starts):
                columns = [key, pa.array([part], pa.int32()), doc_id.cast(pa.int64()), pa.array([at], pa.int64()), pa.array([at == starts[-1]]), pa.array([text[at : at + chunk + overlap] if at != starts[-1] else text[at:]])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "part", "doc_id", "base", "final", "text"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(split).findall
        for part in _slices(batches, 32):
            ends = []
            for text, base, final in zip(*(part.column(c).to_pylist() for c in ("text", "base", "final"))):
                own = np.cumsum([len(x) for x in find(text)])
                ends.append(base + (own if final else own[own <= len(text) - AHEAD]))
            offsets = np.cumsum([0, *map(len, ends)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ends).astype(np.int64)))], [*part.schema.names, "ends"])

    schema = "key long, part int, doc_id long, base long, final boolean, text string"
    parts = long.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(cut, schema)
    return written(parts.repartition("key", "part").mapInArrow(pieces, schema + ", ends array<long>"))


def _stitches(chunks: DataFrame, overlap: int) -> DataFrame:
    """(key, part, begin, end, whole): from where to where each chunk's pieces count, and whether all of its text's overlaps
    have a stitch. Only boundaries in overlaps are exchanged."""
    inside = lambda low: F.filter("ends", lambda e: (e >= low) & (e <= low + overlap))
    # a chunk begins with a boundary of its own
    head = F.when(F.col("part") > 0, F.concat(F.array("base"), inside(F.col("base"))))
    edges = chunks.select("key", "part", "final", F.try_element_at("ends", F.lit(-1)).alias("last"), head.alias("head"), F.when(~F.col("final"), F.slice(F.reverse("ends"), 1, overlap + 1)).alias("tail"))
    line = Window.partitionBy("key").orderBy("part")
    end = F.when(F.col("final"), F.col("last")).otherwise(F.array_min(F.array_intersect(F.lead("head").over(line), "tail")))
    ended = edges.select("key", "part", end.alias("end"))
    begun = ended.withColumn("begin", F.when(F.col("part") == 0, F.lit(0).cast("long")).otherwise(F.lag("end").over(line)))
    return begun.withColumn("whole", F.count(F.when(F.col("end").isNull(), 1)).over(Window.partitionBy("key")) == 0)


def _encode_long(long: DataFrame, merger, split: str, chunk: int, overlap: int) -> DataFrame:
    """(key, part, doc_id, ids) of long texts; ids as little-endian 32-bit integers, of some parts none."""
    chunks = _chunks(long, split, chunk, overlap)
    stitched = chunks.join(_stitches(chunks, overlap), ["key", "part"])
    schema = "key long, part int, doc_id long, ids binary"
    out = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Encoder(merger.value, split)
        for part in _slices(batches, 32):
            texts = []
            for text, base, begin, end, ends in zip(*(part.column(c).to_pylist() for c in ("text", "base", "begin", "end", "ends"))):
                at = [begin - base, *(e - base for e in ends if begin < e <= end)]
                texts.append([text[a:b] for a, b in zip(at, at[1:])])
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("part"), part.column("doc_id"), pa.array(worker.ids(texts), pa.binary())], schema=out)

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, key = Encoder(merger.value, split), None
        for row in _slices(batches, 1):
            own, base, final, text = (row.column(c)[0].as_py() for c in ("key", "base", "final", "text"))
            if own != key:
                key, carried, seen, tried = own, [], 0, 0
            carried.append(text[seen - base :])  # without what the chunk before had too
            seen = base + len(text)
            pieces = []
            if final or sum(map(len, carried)) >= 2 * tried:  # else a long piece would be looked through again and again
                rest = "".join(carried)
                pieces, tried = worker.find(rest), 0
                while not final and pieces and tried < AHEAD:  # the last pieces may go on
                    tried += len(pieces.pop())
                carried = [rest[len(rest) - tried :]]
            yield pa.RecordBatch.from_arrays([row.column("key"), row.column("part"), row.column("doc_id"), pa.array(worker.ids([pieces]), pa.binary())], schema=out)

    whole = stitched.where("whole").select("key", "part", "doc_id", "text", "base", "begin", "end", "ends").mapInArrow(apart, schema)
    rest = stitched.where("NOT whole").select("key", "part", "doc_id", "text", "base", "final").repartition("key").sortWithinPartitions("key", "part").mapInArrow(in_turn, schema)
    return whole.unionByName(rest)


def encode(docs: DataFrame, path: str, output: str = "ids", split: str = SPLIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Every row of docs (doc_id, text) encoded by the ranks in the file at path, which the driver can open; each match of
    split is encoded by itself, without special tokens. split must match every character and look at no character before
    its match and at most AHEAD after it.

    output "ids": (doc_id, ids array<int>). "digest": (doc_id, n_tokens, ids_sha256, decoded_sha256): of the ids as
    little-endian unsigned 32-bit integers, and of the bytes that they are decoded to. A null text counts as empty: no ids,
    digests of no bytes. Repeated rows, and different texts with one doc_id, are encoded one by one; ids must be whole
    numbers or null. An empty table gives an empty one; other columns don't matter, whatever they are called. Tables hold
    no lone surrogates, as their texts are UTF-8. docs is read twice, for its short and its long texts.

    The compiled ranks are broadcast; their size is the vocabulary's. Of long texts, chunks are kept in the shared folder.
    """
    merger = docs.sparkSession.sparkContext.broadcast(Merger(load_ranks(path)))
    sized = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def row(doc_ids: list, ids: list[bytes], decoded: list[str]) -> pa.RecordBatch:
        columns = {"doc_id": pa.array(doc_ids, pa.int64())}
        if output == "ids":
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        else:
            columns["n_tokens"] = pa.array([len(x) // 4 for x in ids], pa.int64())
            columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
            columns["decoded_sha256"] = pa.array(decoded, pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Encoder(merger.value, split)
        for part in _slices(batches, 1000):
            ids = worker.ids([worker.find(t) for t in part.column("text").to_pylist()])
            decoded = [] if output == "ids" else [hashlib.sha256(worker.decode(x)).hexdigest() for x in ids]
            yield row(part.column("doc_id").cast(pa.int64()).to_pylist(), ids, decoded)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, key, doc_id, ids, decoded = Encoder(merger.value, split), None, None, [], hashlib.sha256()
        for part in _slices(batches, 1):
            if part.column("key")[0].as_py() != key:
                if key is not None:
                    yield row([doc_id], [b"".join(ids)], [decoded.hexdigest()])
                key, doc_id, ids, decoded = part.column("key")[0].as_py(), part.column("doc_id")[0].as_py(), [], hashlib.sha256()
            ids.append(part.column("ids")[0].as_py())
            if output != "ids":
                decoded.update(worker.decode(ids[-1]))
        if key is not None:
            yield row([doc_id], [b"".join(ids)], [decoded.hexdigest()])

    schema = "doc_id long, ids array<int>" if output == "ids" else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = sized.where(F.length("text") <= chunk).mapInArrow(at_once, schema)
    parts = _encode_long(sized.where(F.length("text") > chunk), merger, split, chunk, overlap)
    return short.unionByName(parts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(joined, schema))
