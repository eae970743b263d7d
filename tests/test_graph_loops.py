"""Graph operators against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import graph as G


def closed(entries, edges):
    """Entry points closed by hand: the list is gone through, and what an item calls first goes right behind it."""
    calls = {}
    for source, target, sibling in sorted(edges, key=lambda e: (e[2], e[1])):
        calls.setdefault(source.lower(), []).append((target, sibling))
    out, seen = [], set()
    for name in entries:
        if name.lower() not in seen:
            seen.add(name.lower())
            out.append((name, False))
    cap, at, over = 2 * len(out), 0, False
    while at < len(out) and not over:
        behind = at + 1
        for target, _ in calls.get(out[at][0].lower(), []):
            if target.lower() in seen:
                continue
            if len(out) >= cap:
                over = True
                break
            seen.add(target.lower())
            out.insert(behind, (target, True))
            behind += 1
        at += 1
    return [(name, place + 1, added, over) for place, (name, added) in enumerate(out)]


def close(spark, entries, edges):
    e = spark.createDataFrame(list(zip(entries, range(len(entries)))), "name string, position int")
    return sorted((tuple(r) for r in G.close_entry_points(e, spark.createDataFrame(edges, "source string, target string, sibling int")).collect()), key=lambda r: r[1])


def test_a_chain_of_thirty_is_followed_to_its_end(spark):
    chain = [(f"n{i}", f"n{i + 1}", 0) for i in range(30)] + [("n30", "n0", 0), ("n30", "n10", 1)]
    entries = ["N0", *(f"e{i}" for i in range(30)), "n0"]
    got = close(spark, entries, chain)
    assert got == closed(entries, chain) and [r[0] for r in got[:31]] == ["N0", *(f"n{i}" for i in range(1, 31))]
    assert not got[0][3]


@pytest.mark.parametrize("seed", range(4))
def test_closures_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    names = [f"P{i}" for i in range(14)]
    pairs = {(rnd.choice(names), rnd.choice(names)) for _ in range(rnd.randint(10, 40))}
    place, edges = {}, []
    for source, target in sorted(pairs):
        place[source] = place.get(source, 0) + 1
        edges.append((source, target.lower() if rnd.random() < 0.2 else target, place[source]))
    entries = rnd.sample(names, rnd.choice([2, 4, 8]))
    assert close(spark, entries, edges) == closed(entries, edges)


def test_reordering_keeps_strangers_behind_their_neighbours(spark):
    rnd = random.Random(3)
    closure = [("b", 1), ("A", 2), ("c", 3), ("d", 4), ("a", 9)]
    rank = {"b": 0, "a": 1, "c": 2, "d": 3}
    for n in (0, 1, 9, 40):
        items = [(i, 2 * i, rnd.choice(["a", "B", "c", "x", "y", None])) for i in range(n)]
        matched, behind, anchor = [], {}, -1
        for item, place, name in items:
            if name and name.lower() in rank:
                anchor = rank[name.lower()]
                matched.append((anchor, place, item))
            else:
                behind.setdefault(anchor, []).append(item)
        wanted = behind.pop(-1, [])
        for anchor, _, item in sorted(matched):
            wanted += [item, *behind.pop(anchor, [])]
        df = spark.createDataFrame(items, "item int, position int, name string")
        got = G.reorder_by_closure(df, spark.createDataFrame(closure, "name string, position int")).orderBy("place").collect()
        assert [r["item"] for r in got] == wanted and [r["place"] for r in got] == list(range(1, n + 1))


def mutual(edges):
    """Sets of nodes that reach each other, by brute force."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reached(start):
        seen, todo = set(), [start]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    nodes = {x for e in edges for x in e}
    reach = {x: reached(x) for x in nodes}
    return {frozenset(y for y in nodes if y in reach[x] and x in reach[y]) for x in nodes if any(y != x and y in reach[x] and x in reach[y] for y in nodes)}


@pytest.mark.parametrize("seed", range(2))
def test_strong_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"v{rnd.randint(0, 40)}", f"v{rnd.randint(0, 40)}") for _ in range(55)]
    found = G.strong_components(spark.createDataFrame(edges, "source string, target string")).groupBy("component").agg(F.collect_set("node").alias("nodes")).collect()
    assert {frozenset(r["nodes"]) for r in found} == mutual([e for e in edges if e[0] != e[1]])


def test_callers_of_cycles_are_not_on_them(spark):
    edges = [("x", "a"), ("a", "b"), ("b", "a"), ("a", "z"), ("y", "x"), ("c", "d"), ("d", "c"), ("d", "a"), ("q", "q")]
    got = {tuple(r) for r in G.execution_levels(spark.createDataFrame(edges, "source string, target string")).collect()}
    assert got == {("z", 0, False), ("q", 0, False), ("a", 1, True), ("b", 1, True), ("x", 2, False), ("y", 3, False), ("c", 4, True), ("d", 4, True)}
    assert G.execution_levels(spark.createDataFrame([], "source string, target string")).count() == 0
