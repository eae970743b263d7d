"""Dependency graphs: closures, levels, components, spans. Loops run on the driver over tables; each round is written to
the shared folder, so lineage stays short and lost executors cost one round."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.durable import written
from ledgerline.operators.joins import interval_join
from ledgerline.operators.scans import carried, numbered


#: Nodes up to which a frontier is broadcast, so that neither the edges nor what was seen are shuffled for it.
FEW = 500_000


def _few(nodes: DataFrame) -> DataFrame | None:
    """Distinct nodes, written, if a broadcast takes them."""
    kept = written(nodes.distinct())
    return F.broadcast(kept) if kept.count() <= FEW else None


def closure(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, node, depth): everything reachable over edges (source, target) in max_depth steps at most, with the least
    depth. Cycles and shared nodes are met once.

    Pairs of roots and nodes are many more than nodes where roots meet in the same ones: then only the edges of those
    nodes are joined, and only what was seen of their targets is compared.
    """
    steps = written(edges.select("source", "target").distinct())
    frontier = written(roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, max_depth + 1):
        few = _few(frontier.select(F.col("node").alias("source"))) if depth > 1 else None
        hops, known = steps, seen
        if few is not None:
            hops = written(steps.join(few, "source", "left_semi"))
            if hops.count() <= FEW:
                hops = F.broadcast(hops)
                known = seen.join(F.broadcast(hops.select(F.col("target").alias("node")).distinct()), "node", "left_semi")
        reached = frontier.join(hops, F.col("node") == F.col("source")).select("root", F.col("target").alias("node"))
        # a root's own edges differ, and nothing but itself was seen of it
        new = reached.where("root <> node") if depth == 1 else reached.distinct().join(known.select("root", "node"), ["root", "node"], "left_anti")
        frontier = written(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def least_depths(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): the nodes that roots (node) reach over edges (source, target) in max_depth steps at most, with the
    least depth of all roots; the closure's least depth by node, without its pairs."""
    frontier = written(roots.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).where("node IS NOT NULL").distinct()
        frontier = written(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def node_status(reached: DataFrame, nodes: DataFrame, current_db: str, max_depth: int, allow_external: bool = False) -> DataFrame:
    """(node, status): SkippedDepth without a path short enough, SkippedExternal in another database (unless allowed) or
    of unresolved type, else Queued. nodes (node, database, type)."""
    least = reached.groupBy("node").agg(F.min("depth").alias("depth"))
    external = (F.lower(F.coalesce("database", F.lit(current_db))) != current_db.lower()) & F.lit(not allow_external)
    status = F.when(F.col("depth").isNull() | (F.col("depth") > max_depth), "SkippedDepth").when(external | F.col("type").isNull() | (F.col("type") == "UNKNOWN"), "SkippedExternal").otherwise("Queued")
    return nodes.join(least, "node", "left").select("node", status.alias("status"))


def _spread(labels: DataFrame, steps: DataFrame, rounds: int | None = None) -> DataFrame:
    """labels (node, label) carried over steps (source, target) until nothing sinks any more: each node has the least label
    of those that reach it, its own included. Only nodes whose label sank pass it on. With rounds, the least label of those
    that reach it in so many steps; nodes that none reaches so are left out."""
    known = written(labels.groupBy("node").agg(F.min("label").alias("label")))
    moved = known
    for _ in count() if rounds is None else range(rounds):
        new = steps.join(moved, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.min("label").alias("new"))
        after = written(known.join(new, "node", "full").select("node", F.least("label", "new").alias("label"), (F.col("new").isNotNull() & (F.col("label").isNull() | (F.col("new") < F.col("label")))).alias("sank")))
        known, moved = after.select("node", "label"), after.where("sank").select("node", "label")
        if moved.isEmpty():
            break
    return known


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles of edges (source, target): nodes that reach each other have one component,
    named by one of them. A node that calls itself alone is on no cycle here. Nodes that only call a cycle, or are only
    called from one, are left out.

    First nodes that nothing calls or that call nothing are taken off, again and again. Then colours are spread: each node
    takes the least node that reaches it. What the node that a colour is named by can be reached from within its colour is
    a component; it is taken off, and the rest begins anew.
    """
    return _strong(written(edges.select("source", "target").where("source <> target").distinct()))


def _strong(left: DataFrame) -> DataFrame:
    """strong_components of distinct edges between different nodes, as written."""
    edges, found, n = left, None, left.count()
    while True:
        while True:
            callers, callees = left.select("source").distinct(), left.select("target").distinct()
            kept = written(left.join(callees.select(F.col("target").alias("source")), "source", "left_semi").join(callers.select(F.col("source").alias("target")), "target", "left_semi").select("source", "target"))
            left, before, n = kept, n, kept.count()
            if n == before:
                break
        if left.isEmpty():
            return edges.select(F.col("source").alias("node"), F.col("source").alias("component")).where("false") if found is None else found
        nodes = left.select(F.col("source").alias("node")).union(left.select("target")).distinct()
        colours = _spread(nodes.select("node", F.col("node").alias("label")), left)
        inside = left.join(colours.select(F.col("node").alias("source"), F.col("label").alias("c")), "source").join(colours.select(F.col("node").alias("target"), "label"), "target").where("c = label").select("source", "target")
        inside = written(inside)
        back = inside.select(F.col("target").alias("source"), F.col("source").alias("target"))
        own = _spread(colours.where("node = label"), back)  # the root's colour goes back to all that reach the root
        part = written(own.withColumnRenamed("label", "component"))
        # a colour whose root nothing comes back to is no cycle
        several = part.groupBy("component").count().where("count > 1").select("component")
        cycles = part.join(several, "component").select("node", "component")
        found = cycles if found is None else found.union(cycles)
        gone = part.select("node")
        left = written(left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"))
        n = left.count()


def execution_levels(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, level, in_cycle): callees first. Level 0 calls nothing; a node is one above its highest callee. Where only
    cycles and what calls them is left, the members of cycles that call no other cycle get the next level, with the flag;
    what calls them follows above, without it. With rounds, deeper graphs raise an error.

    Each round takes off at least one node, so it goes on until none is left; cycles are looked for once, when first
    nothing can be taken off.
    """
    edges = written(edges.select("source", "target").distinct())
    left = edges.where("source <> target")
    waiting = written(edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node"))).where("node IS NOT NULL").distinct())
    done, cycles = None, None
    for level in count() if rounds is None else range(rounds):
        if waiting.isEmpty():
            break
        ready = written(waiting.join(left.select(F.col("source").alias("node")).distinct(), "node", "left_anti").withColumn("in_cycle", F.lit(False)))
        of_cycles = ready.isEmpty()
        if of_cycles:
            if cycles is None:
                cycles = written(_strong(left))
            of = lambda end: cycles.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
            outside = left.join(of("source"), "source").join(of("target"), "target", "left").where("target_c IS NULL OR source_c <> target_c")
            ready = written(cycles.join(waiting, "node", "left_semi").join(outside.select(F.col("source_c").alias("component")).distinct(), "component", "left_anti").select("node", F.lit(True).alias("in_cycle")))
        placed = ready.select("node", F.lit(level).alias("level"), "in_cycle")
        done = placed if done is None else done.unionByName(placed)
        waiting = written(waiting.join(ready, "node", "left_anti"))
        rest = left.join(ready.select(F.col("node").alias("target")), "target", "left_anti")
        if of_cycles:  # others have no edges left that begin at them
            rest = rest.join(ready.select(F.col("node").alias("source")), "source", "left_anti")
        left = written(rest.select("source", "target"))
    else:
        if not waiting.isEmpty():
            raise RuntimeError(f"execution levels did not settle in {rounds} rounds")
    return waiting.select("node", F.lit(0).alias("level"), F.lit(False).alias("in_cycle")) if done is None else done


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").distinct()


def call_graph(dependencies: DataFrame, kinds: tuple[str, ...] = ("Procedure", "Function")) -> DataFrame:
    """(source, targets): the code objects that each object calls, in order."""
    return dependencies.where(F.col("type").isin(*kinds)).groupBy("source").agg(F.sort_array(F.collect_set("target")).alias("targets"))


def draft_stages(writes: DataFrame, reads: DataFrame, calls: DataFrame, hub: int = 3) -> DataFrame:
    """(procedure, stage): producer if it writes a table that another reads, call group if it calls or is called, else
    unknown. Tables with `hub` writers or more say nothing. writes and reads (procedure, table), calls (caller, callee)."""
    low = lambda df: df.select("procedure", F.lower("table").alias("table")).distinct()
    w, r = low(writes), low(reads)
    hubs = w.groupBy("table").agg(F.countDistinct("procedure").alias("n")).where(F.col("n") >= hub)
    w = w.join(hubs, "table", "left_anti")
    # a table with readers other than the writer: more than one reader, or one that isn't the writer
    readers = r.groupBy("table").agg(F.min("procedure").alias("first"), F.max("procedure").alias("last"))
    producers = w.join(readers, "table").where("first <> procedure OR last <> procedure").select("procedure").distinct().withColumn("p", F.lit(True))
    grouped = calls.select(F.col("caller").alias("procedure")).union(calls.select("callee")).distinct().withColumn("c", F.lit(True))
    everyone = writes.select("procedure").union(reads.select("procedure")).union(grouped.select("procedure")).distinct()
    return everyone.join(producers, "procedure", "left").join(grouped, "procedure", "left").select("procedure", F.when(F.col("p"), "producer").when(F.col("c"), "call group").otherwise("unknown").alias("stage"))


def split_spans(boundaries: DataFrame, calls: DataFrame, steps: DataFrame, dml: DataFrame) -> DataFrame:
    """(caller, callee, line, caller_step, callee_step): calls inside the only transaction of a caller, to a callee of
    another step that changes data and opens no transaction. boundaries (caller, line, kind begin | commit), calls
    (caller, line, callee), steps (procedure, step), dml (procedure)."""
    counts = boundaries.groupBy("caller").agg(
        F.sum((F.col("kind") == "begin").cast("int")).alias("begins"), F.sum((F.col("kind") == "commit").cast("int")).alias("commits"),
        F.min(F.when(F.col("kind") == "begin", F.col("line"))).alias("start"), F.max(F.when(F.col("kind") == "commit", F.col("line"))).alias("end"),
    )
    spans = counts.where("begins = 1 AND commits = 1").select("caller", "start", "end")
    inside = interval_join(calls, spans, ["caller"], "line", "start", "end")
    openers = boundaries.where("kind = 'begin'").select(F.col("caller").alias("callee")).distinct()
    inside = inside.join(dml.select(F.col("procedure").alias("callee")).distinct(), "callee", "left_semi").join(openers, "callee", "left_anti")
    of = lambda who: steps.select(F.col("procedure").alias(who), F.col("step").alias(f"{who}_step"))
    return inside.join(of("caller"), "caller").join(of("callee"), "callee").where("caller_step <> callee_step").select("caller", "callee", "line", "caller_step", "callee_step")


def components(pairs: DataFrame, scope: list[str] = (), rounds: int = 100) -> DataFrame:
    """(scope, node, component): connected components of pairs (a, b) inside each scope, named by their smallest node.

    A node's label sinks to the least of its neighbours', and then to that label's own, so paths halve each round. Labels are
    shuffled and not broadcast, as a broadcast of each round's labels would go through the driver.
    """
    scope = list(scope)
    both = pairs.select(*scope, F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(*scope, F.col("b").alias("x"), F.col("a").alias("y")))
    both = written(both.where("x IS NOT NULL AND y IS NOT NULL").distinct())
    labels = written(both.select(*scope, F.col("x").alias("node"), F.col("x").alias("component")).distinct())
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "y").hint("merge"), [*scope, "y"]).groupBy(*scope, F.col("x").alias("node")).agg(F.min("component").alias("near"))
        lower = written(labels.join(near.hint("merge"), [*scope, "node"]).select(*scope, "node", F.least("component", "near").alias("component"), F.col("component").alias("was")))
        up = lower.select(*scope, F.col("node").alias("component"), F.col("component").alias("up"))
        after = written(lower.join(up.hint("merge"), [*scope, "component"]).select(*scope, "node", F.least("component", "up").alias("component"), "was"))
        labels = after.drop("was")
        if after.where("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def inherit_once(bindings: DataFrame, feeds: DataFrame) -> DataFrame:
    """Bindings (variable, column) with those that a variable inherits over feeds (source, target), once and from the
    original list only."""
    passed = feeds.join(bindings, F.col("source") == F.col("variable")).select(F.col("target").alias("variable"), "column")
    return bindings.select("variable", "column").union(passed).distinct()


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target) of edges whose target is Cancelled or still Queued."""
    open_ = nodes.where(F.col("status").isin("Cancelled", "Queued")).select(F.col("node").alias("target"))
    return edges.join(open_, "target", "left_semi").select("source", "target").distinct()


def close_entry_points(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, position, added, cap_exceeded): entries (name, position) with the procedures that they reach put right behind
    their first caller, by edges (source, target, sibling), at any depth; names are told apart without their case. Behind
    its caller each procedure is followed by what it calls first itself. At most as many are added as there are entries,
    those that come up first as the list is gone through from its beginning, with a flag if there are more; entries always
    stay.

    A place is a path of positions: an entry's own, then the siblings' that lead to a procedure. In each round the owner of
    what has no place yet is the first placed procedure that reaches it over others without one, as labels that sink to
    the least path tell; what its owner calls directly gets its place behind it. Only where an owner has placed several do
    their labels have to be spread among what is left to it.

    Callers come up before what they call. So each of the first n + 1 to be added, for n entries, is reached in n + 1 steps,
    and labels go no further; and what comes up behind n + 1 others is dropped with what it owns. What a label that stopped
    early or a dropped owner leaves to a later owner comes up behind these, too. Rounds are bounded by the entries, however
    long the chains of the graph are.
    """
    first = lambda df, by, *keep: df.groupBy(by).agg(F.min(F.struct(*keep)).alias("r")).select(by, *(f"r.{c}" for c in keep))
    start = written(first(entries.select(F.lower("name").alias("node"), F.col("position").cast("long").alias("position"), "name"), "node", "position", "name"))
    most = start.count() + 1
    placed = written(start.select("node", F.array("position").alias("path"), "name"))
    low = edges.select(F.lower("source").alias("source"), F.lower("target").alias("target"), F.col("sibling").cast("long").alias("sibling"), F.col("target").alias("name"))
    calls = low.groupBy("source", "target").agg(F.min(F.struct("sibling", "name")).alias("r")).select("source", "target", "r.sibling", "r.name")
    calls = written(calls.join(placed.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target", "sibling", "name"))
    owned = _spread(calls.join(placed, F.col("source") == F.col("node")).select(F.col("target").alias("node"), F.col("path").alias("label")), calls, most)
    calls = written(calls.join(owned.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target", "sibling", "name"))
    order = F.struct(F.slice("path", F.lit(1), F.size("path") - 1).alias("caller"), F.element_at("path", -1).alias("sibling"), "node")
    newest, added, round_ = placed, None, 0
    while not owned.isEmpty():
        round_ += 1
        heads = newest.select(F.col("node").alias("source"), F.col("path").alias("label"))
        claims = owned.join(calls.withColumnRenamed("target", "node"), "node").join(heads, ["source", "label"])
        claimed = claims.select("node", F.concat("label", F.array("sibling")).alias("path"), "name", F.col("label").alias("owner"), F.lit(round_).alias("round"))
        added = written((claimed if added is None else added.unionByName(claimed)).orderBy(order).limit(most))
        newest = added.where(F.col("round") == round_)
        rest = owned.join(newest, "node", "left_anti")
        heirs = newest.groupBy(F.col("owner").alias("label")).agg(F.count("*").alias("n"), F.min("path").alias("heir"))
        rest = written(rest.join(heirs, "label"))
        single, several = rest.where("n = 1").select("node", F.col("heir").alias("label")), rest.where("n > 1").select("node")
        if several.isEmpty():
            owned = single
            continue
        among = written(calls.join(several.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target", "sibling", "name"))
        begun = among.join(newest, F.col("source") == F.col("node")).select(F.col("target").alias("node"), F.col("path").alias("label"))
        inner = among.join(several.withColumnRenamed("node", "source"), "source", "left_semi")
        owned = written(single.unionByName(_spread(begun, inner, most)))
    kept = placed.withColumn("added", F.lit(False))
    over = False
    if added is not None:
        over = added.count() == most
        kept = kept.unionByName(added.orderBy(order).limit(most - 1).select("node", "path", "name", F.lit(True).alias("added")))
    # at most twice the entries, which one job lists by hand: a window over all of them
    ranked = kept.withColumn("position", F.row_number().over(Window.orderBy("path", "node")))
    return ranked.select("name", "position", "added", F.lit(over).alias("cap_exceeded"))


def reorder_by_closure(items: DataFrame, closure: DataFrame) -> DataFrame:
    """items (item, position, name) in the order of a closure (name, position): (item, place) with places from 1. Items that
    the closure lacks stay behind the item that they stood behind before, in their order, or in front where none stood
    before them; several items of one name come one after the other, with what belongs behind them after the first.

    Items are range-sorted once: what stands before a partition is carried into it as the last match of each.
    """
    order = closure.groupBy(F.lower("name").alias("key")).agg(F.min("position").alias("rank"))
    named = items.withColumn("key", F.lower("name")).join(order, "key", "left").select("item", F.col("position").cast("long").alias("position"), F.col("rank").cast("long").alias("rank"))
    anchored = carried(written(named), "position", "rank", "anchor")
    # 0: in front; 1: the first match of an anchor, 2: what stays behind it, 3: its other matches
    head = anchored.where("rank IS NOT NULL").groupBy(F.col("rank").alias("anchor")).agg(F.min("position").alias("head"))
    kind = F.when(F.col("rank").isNull(), 2).when(F.col("position") == F.col("head"), 1).otherwise(3)
    keyed = anchored.join(head, "anchor", "left").select("item", F.coalesce("anchor", F.lit(-1)).alias("anchor"), kind.alias("kind"), "position")
    return numbered(written(keyed), ["anchor", "kind", "position"], "place").select("item", "place")


def upstream_first(reads: DataFrame, pending: DataFrame) -> DataFrame:
    """(item, depends_on): which pending item must come before which. reads (item, table), pending (item, table) lists
    what each pending item writes. Empty when a writer itself reads a pending item's table: there is no order then."""
    need = reads.join(pending.withColumnRenamed("item", "depends_on"), "table").where("item <> depends_on").select("item", "depends_on").distinct()
    wanted = need.join(pending.select("item").distinct(), "item", "left_semi")
    chained = wanted.select(F.col("depends_on").alias("item")).join(wanted.select("item").distinct(), "item", "left_semi").limit(1).agg(F.count("*").alias("n"))
    return wanted.crossJoin(F.broadcast(chained)).where("n = 0").drop("n")
