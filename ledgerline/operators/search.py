"""Many literals looked for in many texts: one pass over the texts for all of them, by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.expressions import mentions

#: Characters of the literals that one automaton holds, about: some hundred bytes of memory each.
MOST = 1_000_000
#: Texts whose finds a task holds at a time; of the texts themselves one is a Python string at a time.
SLICE = 256
WORD_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def occurrences(literals: DataFrame, texts: DataFrame, key: str, whole_words: bool = False, most: int = MOST) -> DataFrame:
    """(key, literal), each pair once: which texts (key, text) hold which literals (literal), case and all else counting.

    With whole_words a literal has to stand where neither an ASCII letter, digit or underscore comes right before it nor
    right after it, as `mentions` has it. Quotation marks are no such characters, so quoted literals always count. The
    empty literal stands in every text, with whole_words wherever two such places meet. Null literals and null texts are
    left out.

    An automaton is broadcast, and the texts are read once for it. Literals of more than `most` characters together are
    dealt over several automata by their hash, at the price of one more pass over the texts for each.
    """
    distinct = literals.select("literal").where("literal IS NOT NULL").distinct()
    size, empty = distinct.agg(F.sum(F.length("literal")), F.count_if(F.col("literal") == "")).first()
    rows = texts.select(key, "text").where("text IS NOT NULL")
    schema = rows.schema[key].dataType.simpleString()
    none = rows.where("false").select(key, F.lit("").alias("literal"))
    shards = -(-(size or 0) // most)
    found = []
    for shard in range(shards):
        own = distinct.where((F.col("literal") != "") & (F.pmod(F.xxhash64("literal"), F.lit(shards)) == shard))
        shared = rows.sparkSession.sparkContext.broadcast([r["literal"] for r in own.collect()])

        def hits(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            names = shared.value
            automaton = ahocorasick.Automaton()
            for i, name in enumerate(names):
                automaton.add_word(name, (i, len(name)))
            automaton.make_automaton()
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    piece = batch.slice(start, SLICE)
                    at, named = [], []
                    for row, text in enumerate(piece.column("text") if names else ()):
                        text, held = text.as_py(), set()
                        for last, (i, n) in automaton.iter(text):
                            if i in held:
                                continue
                            if not whole_words or not ((last >= n and text[last - n] in WORD_CHARACTERS) or text[last + 1 : last + 2] in WORD_CHARACTERS):
                                held.add(i)
                        at += [row] * len(held)
                        named += held
                    yield pa.RecordBatch.from_arrays([piece.column(key).take(pa.array(at, pa.int64())), pa.array([names[i] for i in named], pa.string())], [key, "literal"])

        found.append(rows.mapInArrow(hits, f"`{key}` {schema}, literal string"))
    if empty:
        held = rows.where(mentions(F.col("text"), F.lit(""))) if whole_words else rows
        found.append(held.select(key, F.lit("").alias("literal")))
    for part in found:
        none = none.union(part)
    return none.distinct()
