"""Directed graphs as nodes(id) and edges(src, dst): rank, reach, components, levels.

Iterations are driver loops over DataFrames; what one round leaves to the next is a
table in the shared folder, so plans stay flat and executors can be lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import drop, materialize, written

DAMPING = 0.85
HOPS = 4
"""Steps of a walk that are planned at a time, between two written tables."""
ISLAND_LINKS = 400_000
"""Links of a weakly connected part that one task walks in memory."""
BINS = 8
"""Tasks that share as many links, of small parts."""


def build(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): edges once each, self-loops kept; nodes declared or named by an edge."""
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    if nodes is not None:
        ids = ids.union(nodes.select("id"))
    return ids.distinct(), edges


def file_graph(files: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of imports; they are extracted once, since nodes and edges are read several times."""
    links = materialize(imports.where(F.col("to").isNotNull()).select(F.col("from").alias("src"), F.col("to").alias("dst")), "file-edges")
    return build(links, files.select(F.col("path").alias("id")))


def call_graph(symbols: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    return build(calls.where("caller_id IS NOT NULL AND callee_id IS NOT NULL").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")), symbols.where("kind IN ('function', 'method')").select("id"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, outgoing, incoming) of every node."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    every = nodes.select("id", F.lit(0).alias("o"), F.lit(0).alias("i")).union(ends)
    return every.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 40, tolerance: float = 1e-6, damping: float = DAMPING, between_checks: int = 5) -> DataFrame:
    """ranks(id, score), summing to one. The mass of nodes without edges out is spread evenly.

    Nodes that no edge leads to all have the same score, one number a round; only the others
    are iterated over. Each round is a table, so that no round is planned twice; every
    ``between_checks`` rounds the loop ends if no score moved by the tolerance in the last one.
    """
    spark = edges.sparkSession
    links = materialize(edges.select("src", "dst"), "rank-edges")
    degree = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    heard = links.select(F.col("dst").alias("id"), F.lit(True).alias("inner")).distinct()
    base = nodes.select("id").join(degree, "id", "left").join(heard, "id", "left")
    base = materialize(base.select("id", F.coalesce("out", F.lit(0)).alias("out"), F.coalesce("inner", F.lit(False)).alias("inner")), "rank-nodes")
    n, outer, idle, sinks = base.agg(F.count("*"), F.count_if(~F.col("inner")), F.count_if(F.expr("NOT inner AND out = 0")), F.count_if(F.expr("inner AND out = 0"))).first()
    if not n:
        return base.select("id", F.lit(0.0).alias("score"))
    given = links.join(base.where("NOT inner AND out > 0").select(F.col("id").alias("src"), (1.0 / F.col("out")).alias("c")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("c").alias("c"))
    core = materialize(base.where("inner").join(given, "id", "left").select("id", "out", F.coalesce("c", F.lit(0.0)).alias("c")), "rank-core")
    between = materialize(links.join(core.select(F.col("id").alias("src")), "src", "left_semi"), "rank-links")
    now, path = core.withColumn("score", F.lit(1.0 / n)), None
    alone, lost = 1.0 / n, sinks / n
    for done in range(1, iterations + 1):
        every = (1 - damping) / n + damping * (idle * alone + lost) / n
        sent = between.join(now.where("out > 0").select(F.col("id").alias("src"), (F.col("score") / F.col("out")).alias("share")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        after = now.select("id", "out", "c", F.col("score").alias("was")).join(sent, "id", "left")
        after = after.select("id", "out", "c", (F.lit(every) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(alone) * F.col("c"))).alias("score"), "was")
        before, (now, path) = path, written(after, "rank")
        if before is not None:
            drop(spark, before)
        check = tolerance > 0 and (done % between_checks == 0 or done == iterations)
        if sinks or check:
            lost, moved = now.agg(F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("score"))), F.lit(0.0)), F.coalesce(F.max(F.abs(F.col("score") - F.col("was"))), F.lit(0.0))).first()
        settled = check and max(moved, abs(every - alone) if outer else 0.0) < tolerance
        alone = every
        if settled:
            break
    rest = base.where("NOT inner").select("id", F.lit(alone).alias("score"))
    return now.select("id", "score").union(rest)


def _hops(front: DataFrame, step: DataFrame, hops: int, keys: list[str]) -> DataFrame:
    """What up to so many steps from a front get to: (keys, id), the front left out."""
    found = None
    for _ in range(hops):
        front = front.join(step, "id").select(*keys, F.col("next").alias("id")).distinct()
        found = front if found is None else found.union(front)
    return found.distinct()


def reach(edges: DataFrame, starts: DataFrame, backward: bool = False, depth: int | None = None) -> DataFrame:
    """reached(start, id): what a walk along (or against) the edges gets to; the start itself is left out.

    ``depth``: edges at most, no bound if None. Each round takes ``HOPS`` steps in one plan
    from what the last one found new, and writes what is new now.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = materialize(edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct(), "reach-edges")
    front = materialize(starts.select(F.col("id").alias("start"), "id").distinct(), "reach")
    seen = front
    left = depth
    while left is None or left > 0:
        hops = HOPS if left is None else min(HOPS, left)
        front = materialize(_hops(front, step, hops, ["start"]).join(seen, ["start", "id"], "left_anti"), "reach")
        if not front.limit(1).count():
            break
        # what was found before stays where it was written
        seen = seen.union(front)
        left = None if left is None else left - hops
    return seen.where("start <> id")


def _islands(links: DataFrame) -> DataFrame:
    """(id, island): the weakly connected part of every node of links (src, dst), by alternating star contractions."""
    now = materialize(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "islands")
    last = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = materialize(small, "islands")
        # an order-free fingerprint of the edges tells whether anything changed
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            return now.select(F.col("u").alias("id"), F.col("v").alias("island")).union(now.select(F.col("v").alias("id"), F.col("v").alias("island")).distinct())
        last = mark


def components_of(src: list, dst: list) -> tuple[list, list]:
    """(nodes, component of each) of links in memory: Tarjan's walk with a stack of its own."""
    after: dict = {}
    for a, b in zip(src, dst, strict=True):
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    order: dict = {}
    low: dict = {}
    open_: list = []
    named: dict = {}
    for root in after:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        open_.append(root)
        walk = [(root, iter(after[root]))]
        while walk:
            node, rest = walk[-1]
            for to in rest:
                if to not in order:
                    order[to] = low[to] = len(order)
                    open_.append(to)
                    walk.append((to, iter(after[to])))
                    break
                if to not in named:
                    low[node] = min(low[node], order[to])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == order[node]:
                    at = len(open_) - 1
                    while open_[at] != node:
                        at -= 1
                    part = open_[at:]
                    del open_[at:]
                    named |= dict.fromkeys(part, min(part))
    return list(named), list(named.values())


def strongly_connected(nodes: DataFrame, edges: DataFrame, links_in_memory: int = ISLAND_LINKS) -> DataFrame:
    """components(id, component): mutual reachability, named by the least id.

    A component lies within one weakly connected part of the graph. Parts of up to ``links_in_memory``
    links are walked in memory, about as many links at a time; only larger ones go through rounds.
    """
    links = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "scc-edges")
    every = nodes.select("id").distinct()
    island = materialize(_islands(links), "scc-islands")
    tagged = materialize(links.join(island.withColumnRenamed("id", "src"), "src"), "scc-tagged")
    size = tagged.groupBy("island").agg(F.count("*").alias("n"))
    large = materialize(size.where(F.col("n") > links_in_memory).select("island"), "scc-large")
    count, n_large = tagged.count(), large.count()
    small = tagged.join(large, "island", "left_anti") if n_large else tagged
    bins = -(-count // links_in_memory) * BINS

    def walked(table):
        import pyarrow as pa

        ids, parts = components_of(table.column("src").to_pylist(), table.column("dst").to_pylist())
        kind = table.schema.field("src").type
        return pa.table({"id": pa.array(ids, kind), "component": pa.array(parts, kind)})

    kind = links.schema["src"].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("component", kind)])
    binned = small.select("src", "dst", F.pmod(F.xxhash64("island"), F.lit(max(1, bins))).alias("bin"))
    done = materialize(binned.groupBy("bin").applyInArrow(walked, out), "scc-small")
    if n_large:
        rest = tagged.join(large, "island", "left_semi").select("src", "dst")
        ids = rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct()
        done = done.union(_by_colours(ids, rest))
    return every.join(done, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _by_colours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Strongly connected components of a graph of any size, in rounds.

    Rounds of forward colouring: the least id that reaches a node colours it; the nodes of
    a colour that reach its first node back form a component and leave the graph.
    """
    left = materialize(nodes.select("id").distinct(), "scc-left")
    links = materialize(edges.where("src <> dst").distinct(), "scc-edges")
    done = None
    while left.limit(1).count():
        colour = left.select("id", F.col("id").alias("colour"))
        while True:
            after = colour.select("id", "colour", F.col("colour").alias("was"))
            for _ in range(HOPS):
                heard = links.join(after, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("c"))
                after = after.join(heard, "id", "left").select("id", F.least("colour", F.coalesce("c", "colour")).alias("colour"), "was")
            after = materialize(after, "scc")
            colour = after.select("id", "colour")
            if not after.where("colour < was").limit(1).count():
                break
        named = colour.withColumnsRenamed({"id": "src", "colour": "cs"}), colour.withColumnsRenamed({"id": "dst", "colour": "cd"})
        inner = materialize(links.join(named[0], "src").join(named[1], "dst").where("cs = cd").select(F.col("dst").alias("id"), F.col("src").alias("next")), "scc-inner")
        # a node without a link in or out among its colour is on no cycle: it is a component by itself
        core = inner
        for _ in range(HOPS):
            core = core.join(core.select(F.col("next").alias("id")).distinct(), "id", "left_semi").join(core.select(F.col("id").alias("next")).distinct(), "next", "left_semi").select("id", "next")
        core = materialize(core, "scc-core")
        single = materialize(left.join(core.select("id").union(core.select("next")).distinct(), "id", "left_anti"), "scc-single")
        inner = core
        front = back = materialize(colour.where("id = colour").join(single, "id", "left_anti").select("colour", "id"), "scc-back")
        while True:
            front = materialize(_hops(front, inner, HOPS, ["colour"]).join(back, ["colour", "id"], "left_anti"), "scc-front")
            if not front.limit(1).count():
                break
            back = materialize(back.union(front), "scc-back")
        part = materialize(back.select("id", F.col("colour").alias("component")).union(single.select("id", F.col("id").alias("component"))), "scc-part")
        done = part if done is None else materialize(done.union(part), "scc-done")
        left = materialize(left.join(part, "id", "left_anti"), "scc-left")
        links = materialize(links.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"), "scc-edges")
    return done if done is not None else left.select("id", F.col("id").alias("component"))


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """levels(component, level) of the condensation: the longest path to a component from any source."""
    parts = materialize(strongly_connected(nodes, edges), "topo-parts")
    a, b = parts.withColumnsRenamed({"id": "src", "component": "a"}), parts.withColumnsRenamed({"id": "dst", "component": "b"})
    links = materialize(edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "topo-edges")
    now = parts.select("component", F.lit(0).cast("bigint").alias("level")).distinct()
    while True:
        after = now.select("component", "level", F.col("level").alias("was"))
        for _ in range(HOPS):
            pushed = links.join(after, F.col("src") == F.col("component")).groupBy(F.col("dst").alias("component")).agg((F.max("level") + 1).alias("l"))
            after = after.join(pushed, "component", "left").select("component", F.greatest("level", F.coalesce("l", "level")).alias("level"), "was")
        after = materialize(after, "topo")
        now = after.select("component", "level")
        if not after.where("level > was").limit(1).count():
            return now


def neighbours(edges: DataFrame, node, backward: bool = False) -> DataFrame:
    a, b = ("dst", "src") if backward else ("src", "dst")
    return edges.where(F.col(a) == node).select(F.col(b).alias("id")).distinct()


def impact(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(start, id, is_test): all that depends on a target, however far."""
    from ..functions.text import is_test_path

    return reach(edges, targets, backward=True).withColumn("is_test", is_test_path(F.col("id").cast("string")))
