"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens; its language is the right tokenizations and nothing else. It starts as one state that reads
every byte and grows by one merge gadget for each merge (u, v) in order of rank: where a state is reached by u and reads
v, a copy of it is made that doesn't read v, all u-arcs now lead to the copy, and every state that had a u-arc gains an
arc labelled uv to where v led. All arcs with one label lead to one state, so a state is
kept as the label and the merge that it was copied for. Words are encoded by stepping through the arcs;
ids are decoded by emitting arc labels.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerline.llm.common import give_back

#: Fixed value: how the public byte-level vocabularies split text into words before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters with Unicode's White_Space property.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: White space other than blanks and line ends.
OTHER_WHITE = [c for c in map(chr, range(0x3001)) if c not in " \n" and re.match(f"[{WHITE}]", c)]
NEVER = 1 << 30


def even(text: str) -> bool:
    """Whether a text has no other white space than single blanks and line ends, each before another character."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] in (" ", "\n") or any(c in text for c in OTHER_WHITE))


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next
    free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


class Automaton:
    """Compiled merges. labels: bytes of each token id; merges: pairs of ids with the id of their union, by rank.

    target[t] is the state that arcs labelled t lead to. A state is (label, time): the copy made for that label by its
    latest gadget up to then; it has lost what the label's gadgets took, and what the state base[label] had lost, which
    the label's arcs led to when it was made. gadget[u << 20 | v] is when u's copy lost v; split[t] is t's left part and
    the time it was made. All gadgets are kept as these tables, so an arc is looked up without walking copies.
    """

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int] | None = None):
        self.labels, self.special = labels, special or {}
        made = {uv for _, _, uv in merges}
        first = [t for t, b in labels.items() if len(b) == 1 and t not in made]
        self.target = dict.fromkeys(first, 0)
        self.base = dict.fromkeys(first, 0)
        self.split: dict[int, tuple[int, int]] = {}
        self.gadget: dict[int, int] = {}
        self.states: list[tuple[int, int]] = [(-1, -1)]
        for time, (u, v, uv) in enumerate(merges):
            if uv in self.target or u not in self.target or v not in self.target or not self.reads(self.target[u], v):
                continue
            self.base[uv] = self.target[uv] = self.target[v]
            self.split[uv] = (u, time)
            self.gadget[u << 20 | v] = time
            self.states.append((u, time))
            self.target[u] = len(self.states) - 1
        self.trie: dict = {}
        for t in self.target:
            node = self.trie
            for b in labels[t]:
                node = node.setdefault(b, {})
            node[-1] = t
        self.arcs: dict[int, int] = {}  # transitions met so far: state << 20 | label -> the next state, or -1

    def lost(self, state: int, label: int) -> int:
        """When the copies that a state goes back to lost their arc for label; NEVER if they didn't."""
        while state:
            owner, time = self.states[state]
            gone = self.gadget.get(owner << 20 | label, NEVER)
            if gone <= time:
                return gone
            state = self.base[owner]
        return NEVER

    def reads(self, state: int, label: int) -> bool:
        """Whether a state has an arc for label: the label isn't lost, and none of its left parts was when the union over
        it was made."""
        made = NEVER - 1
        while self.lost(state, label) > made:
            if label not in self.split:
                return True
            label, made = self.split[label]
        return False

    def step(self, state: int, label: int) -> int:
        """The next state, or -1 without such an arc."""
        key = state << 20 | label
        found = self.arcs.get(key)
        if found is None:
            found = self.arcs[key] = self.target[label] if self.reads(state, label) else -1
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The only path that spells word.

        Every beginning of the word has one path of its own. last[i] is the label that ends the path of the first i
        bytes; it is found from the arcs of the states that shorter beginnings lead to, so nothing is tried twice.
        """
        n, trie, arcs, target = len(word), self.trie, self.arcs, self.target
        last, start = [-1] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            if i and last[i] < 0:
                continue
            state = target[last[i]] if i else 0
            node = trie
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                label = node.get(-1)
                if label is not None and last[j + 1] < 0:
                    after = arcs.get(state << 20 | label)
                    if (self.step(state, label) if after is None else after) >= 0:
                        last[j + 1], start[j + 1] = label, i
        path, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError(f"no path spells {word!r}")
            path.append(last[at])
            at = start[at]
        return path[::-1]


def load(path: str) -> Automaton:
    """The automaton of a byte-level BPE file in the tokenizers library's JSON form."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], byte_letters()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocab = model["vocab"]
    labels = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if token not in special}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    auto = Automaton(labels, merges, special)
    auto.labels = labels | {i: t.encode() for t, i in special.items()}
    return auto


class Tables:
    """An automaton's tables as arrays, to take many words through it side by side.

    child(node, byte) walks the trie of arc labels (node 0 is dead, 1 the root), whose edges are kept sorted; named[node] is
    the label that ends at a node or -1. Whether an arc exists is looked up in a table of fixed size that forgets on collision.
    """

    SLOTS = 1 << 20
    LONGEST = 40  # bytes of a word; longer ones go through Automaton.encode_word

    def __init__(self, auto: Automaton):
        self.auto = auto
        inner, leaves = [auto.trie], 0
        for node in inner:
            inner += [v for k, v in node.items() if k >= 0 and len(v) > (-1 in v)]
        number = {id(node): i + 1 for i, node in enumerate(inner)}
        edges, named = {}, [-1] * (len(inner) + 1)
        for node in inner:
            at = number[id(node)]
            named[at] = node.get(-1, -1)
            for byte, below in node.items():
                if byte >= 0:
                    if id(below) not in number:
                        leaves += 1
                        named.append(below[-1])
                    edges[at << 8 | byte] = number.get(id(below), len(inner) + leaves)
        self.edge = np.array(sorted(edges), np.int32)
        self.below = np.array([edges[k] for k in self.edge.tolist()], np.int32)
        self.named, self.inner = np.array(named, np.int32), len(inner)
        self.name = [str(i) for i in range(max(auto.labels) + 1)]
        self.keys, self.there = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, bool)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes below, 0 where there are none."""
        key = (node.astype(np.int32) << 8) | byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.below[at], 0)

    def arc(self, before: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether the state after a label (-1: the first state) has an arc for another, for many pairs."""
        key = (before.astype(np.int64) + 1) << 20 | label
        slot = ((key * -7046029254386353131) >> 40) & (self.SLOTS - 1)
        for k in np.unique(key[self.keys[slot] != key]).tolist():
            at = ((k * -7046029254386353131) >> 40) & (self.SLOTS - 1)
            b = (k >> 20) - 1
            self.keys[at], self.there[at] = k, self.auto.step(self.auto.target[b] if b >= 0 else 0, k & 0xFFFFF) >= 0
        found = self.there[slot]
        for i in np.nonzero(self.keys[slot] != key)[0]:  # two new keys in one slot
            b = int(before[i])
            found[i] = self.auto.step(self.auto.target[b] if b >= 0 else 0, int(label[i])) >= 0
        return found

    def encode(self, words: list[bytes]) -> list[str]:
        """Automaton.encode_word for many words of 1 to LONGEST bytes; ids as decimals joined by commas."""
        length = np.array([len(w) for w in words])
        most = int(length.max())
        text = np.zeros((len(words), most), np.uint8)
        text[np.arange(most) < length[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        text = np.ascontiguousarray(text.T)
        last, start = np.full((most + 1, len(words)), -1, np.int32), np.zeros((most + 1, len(words)), np.int8)
        for i in range(most):
            row = np.nonzero((length > i) & ((last[i] >= 0) | (i == 0)))[0]
            before = last[i][row]
            node = self.child(np.ones(len(row), np.int32), text[i][row])
            for j in range(i, most):
                label = self.named[node]
                at = np.nonzero((label >= 0) & (last[j + 1][row] < 0))[0]
                if len(at):
                    at = at[self.arc(before[at], label[at])]
                    last[j + 1, row[at]], start[j + 1, row[at]] = label[at], i
                keep = np.nonzero((node > 0) & (node <= self.inner) & (length[row] > j + 1))[0]
                if not len(keep):
                    break
                row, before = row[keep], before[keep]
                node = self.child(node[keep], text[j + 1][row])
        paths, name = [], self.name
        for n, labels, begins in zip(length.tolist(), last.T.tolist(), start.T.tolist()):
            path = name[labels[n]]
            n = begins[n]
            while n:
                path = name[labels[n]] + "," + path
                n = begins[n]
            paths.append(path)
        return paths


class Encoder:
    """An automaton with what a worker remembers: pieces of text met, at most so many, forgotten all at once."""

    def __init__(self, auto: Automaton, split: str = SPLIT, remembered: int = 200_000):
        self.auto, self.remembered, self.tables = auto, remembered, Tables(auto)
        self.find = regex.compile(split).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(auto.special, key=len, reverse=True))) + ")") if auto.special else None
        self.known: dict[str, str] = {}  # pieces
        self.after: dict[str, str] = {}  # pieces of even texts without the blank before them
        self.label_of = {str(i): b for i, b in auto.labels.items()}

    def words(self, piece: str) -> list[str]:
        """The split of a piece; plain words with a mark behind them don't need the pattern."""
        body = piece[1:] if piece[:1] == " " else piece
        if body.isalpha():
            return [piece]
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return [piece[:-1], body[-1]]
        return self.find(piece)

    def learn(self, pieces: list[str]) -> list[str]:
        """The ids of pieces in their text form."""
        cut = [[w.encode() for w in self.words(piece)] for piece in pieces]
        words = {w for ws in cut for w in ws}
        short = [w for w in words if len(w) <= Tables.LONGEST]
        ids = {w: ",".join(map(str, self.auto.encode_word(w))) for w in words if len(w) > Tables.LONGEST}
        for i in range(0, len(short), 20_000):
            ids.update(zip(short[i : i + 20_000], self.tables.encode(short[i : i + 20_000])))
        return [ids[ws[0]] if len(ws) == 1 else ",".join(map(ids.__getitem__, ws)) for ws in cut]

    def ids_texts(self, texts: list[str]) -> list[str]:
        """Ids of each text as decimals joined by commas.

        Texts are first cut where other characters end and white space begins, as no word of the split goes on there. In
        even texts, with single blanks and line ends only, that is at the blanks.
        """
        cut, known, after = [], set(), set()
        for text in texts:
            for part in self.special.split(text) if self.special else [text]:
                if part in self.auto.special:
                    cut.append(("special", part, None))
                elif even(part):
                    pieces = part.replace("\n", " \n").split(" ")
                    first = pieces.pop(0)
                    known.update([first] if first else ())
                    after.update(pieces)
                    cut.append(("even", first, pieces))
                else:
                    pieces = PIECE.findall(part)
                    known.update(pieces)
                    cut.append(("uneven", "", pieces))
            cut.append(None)
        if len(self.known) + len(self.after) > self.remembered:
            self.known.clear()
            self.after.clear()
            if len(self.auto.arcs) > 300_000:
                self.auto.arcs.clear()
        new = list(known.difference(self.known))
        self.known.update(zip(new, self.learn(new)))
        new = list(after.difference(self.after))
        self.after.update(zip(new, self.learn([x if x[0] == "\n" else " " + x for x in new])))
        out, line, of, next_of = [], [], self.known.__getitem__, self.after.__getitem__
        for item in cut:
            if item is None:
                out.append(",".join(line))
                line = []
                continue
            kind, first, pieces = item
            if kind == "special":
                line.append(str(self.auto.special[first]))
                continue
            if first:
                line.append(of(first))
            line += map(next_of if kind == "even" else of, pieces)
        return out

    def decode(self, ids: str) -> str:
        """The labels of ids in their text form, joined; bytes that aren't UTF-8 are replaced."""
        return b"".join(map(self.label_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def encode(docs: DataFrame, path: str, output: str = "ids", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs (doc_id, text) encoded by the BPE file at path, which executors can read from the driver's copy.

    output "ids": (doc_id, ids array<int>). "digest": (doc_id, n_tokens, ids_sha256, decoded_sha256), the last from the
    ids decoded again. "both": all of these. The columns of docs named by carry come along, and rows keep their order. A null text counts as
    empty: no ids, digests of empty texts. Repeated rows are encoded one by one; an empty table gives an empty one. The
    compiled automaton is broadcast; its size is the vocabulary's.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(load(path)))  # as bytes: a task's automaton ends with the task
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        worker = Encoder(pickle.loads(shared.value))
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = worker.ids_texts([t or "" for t in part.column("text").to_pylist()])
                doc_id = part.column("doc_id").cast(pa.int64())
                columns = {"doc_id": doc_id}
                if output != "digest":
                    numbers = [np.fromstring(t, np.int32, sep=",") if t else np.zeros(0, np.int32) for t in texts]
                    ends = np.cumsum([0, *map(len, numbers)]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *numbers])))
                if output != "ids":
                    columns["n_tokens"] = pa.array([t.count(",") + 1 if t else 0 for t in texts], pa.int64())
                    columns["ids_sha256"] = pa.array([sha(t) for t in texts], pa.string())
                    columns["decoded_sha256"] = pa.array([sha(worker.decode(t)) for t in texts], pa.string())
                columns.update((c, part.column(c)) for c in carry)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            give_back()
        del worker
        give_back()

    parts = {"ids": "ids array<int>", "digest": "n_tokens long, ids_sha256 string, decoded_sha256 string"}
    schema = "doc_id long, " + parts.get(output, ", ".join(parts.values()))
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("doc_id", "text", *carry).mapInArrow(ids, schema)
