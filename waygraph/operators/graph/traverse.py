"""Components, traversal, distances, paths, trees, matchings, colourings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from waygraph.operators.components import TASK_EDGES, connected_components
from waygraph.operators.graph.structure import canonical, degrees, nodes
from waygraph.plans import kernels
from waygraph.plans.kernels import FAR, HOPS, IDS, NegativeCycle, _overlay, _union, block_tables, counted, distances_among, farthest, in_few_parts, node_blocks, potentials, relax, search, search_on, settled_in_blocks, symmetric, with_loops
from waygraph.plans.stages import materialise, release


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``id, component``: (weakly) connected components, named by their least id."""
    return connected_components(edges, "src", "dst", vertices, task_edges=0)


def component_sizes(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``component, n``."""
    return components(edges, vertices).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def is_connected(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``components, connected``."""
    return component_sizes(edges, vertices).agg(F.count(F.lit(1)).alias("components")).withColumn("connected", F.col("components") == 1)


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component with most nodes, ties by least id."""
    cc = materialise(components(edges), "cc")
    top = cc.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    own = cc.join(top.select("component"), "component", "left_semi")
    return edges.join(own.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi").select(*edges.columns)


def _strong(e: pd.DataFrame) -> pd.DataFrame:
    """``id, component`` of bounded edges: finishing order forwards, then marking backwards."""
    codes, names = pd.factorize(pd.concat([e["src"], e["dst"]], ignore_index=True), sort=True)
    a, b = codes[: len(e)], codes[len(e) :]
    out, into = ([[] for _ in names] for _ in range(2))
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        out[u].append(v)
        into[v].append(u)
    seen, order = [False] * len(names), []
    for root in range(len(names)):
        stack = [] if seen[root] else [(root, iter(out[root]))]
        seen[root] = True
        while stack:
            u, rest = stack[-1]
            v = next((x for x in rest if not seen[x]), None)
            if v is None:
                order.append(u)
                stack.pop()
            else:
                seen[v] = True
                stack.append((v, iter(out[v])))
    mark = np.full(len(names), -1)
    for root in reversed(order):
        if mark[root] >= 0:
            continue
        own, todo = [], [root]
        mark[root] = root
        while todo:
            u = todo.pop()
            own.append(u)
            for v in into[u]:
                if mark[v] < 0:
                    mark[v] = root
                    todo.append(v)
        mark[own] = min(own)
    return pd.DataFrame({"id": names, "component": names[mark]})


def _strong_in_task(edges: DataFrame) -> DataFrame:
    """``id, component`` of a bounded table of edges, in one task."""

    def settle(batches):
        parts = list(batches)
        if parts:
            yield _strong(pd.concat(parts, ignore_index=True))

    kind = edges.schema["src"].dataType.simpleString()
    return edges.select("src", "dst").coalesce(1).mapInPandas(settle, f"id {kind}, component {kind}")


def _strong_in_blocks(edges: DataFrame, count: int) -> DataFrame:
    """``id, component``: strong components inside blocks of near ids of about BLOCK_EDGES edges, which lie in those of the graph."""
    block = node_blocks(edges, count)
    inner = edges.join(block.select(F.col("id").alias("src"), "blk"), "src").join(block.select(F.col("id").alias("dst"), F.col("blk").alias("to")), "dst").filter("blk = to")
    kind = edges.schema["src"].dataType.simpleString()
    return materialise(inner.select("blk", "src", "dst").groupBy("blk").applyInPandas(lambda e: _strong(e), f"id {kind}, component {kind}"), "scc-inner")


def _cyclic_part(e: DataFrame) -> DataFrame:
    """Edges between nodes that lie on a cycle or between two: those at the end, and at the start, of walks of any length."""
    n, still = e.count(), 0
    while n and still < 2:
        for a, b in (("src", "dst"), ("dst", "src")):
            live = in_few_parts(e.select(F.col(a).alias("id")), n).distinct()
            for _ in range(HOPS):
                live = live.join(e, F.col("id") == F.col(a)).select(F.col(b).alias("id")).distinct()
            live = materialise(live, "scc-live")
            old, (e, m) = e, counted(e.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), F.lit(True), "scc")
            release(old, live)
            still, n = (still + 1 if m == n else 0), m
            if still == 2 or not n:
                break
    return e


def _largest_reaching(e: DataFrame) -> DataFrame:
    """``id, m``: the largest id with a walk along ``e`` to a node, or its own; several steps go into one job."""
    steps = materialise(with_loops(e, F.lit(None)), "scc-steps")
    mark = materialise(steps.select(F.col("src").alias("id"), F.col("src").alias("m")).distinct(), "scc-mark")
    n = mark.count()
    while True:
        nxt = in_few_parts(mark, n)
        for _ in range(HOPS):
            nxt = nxt.join(steps, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.max("m").alias("m"))
        nxt = materialise(nxt, "scc-mark")
        settled = nxt.join(mark.withColumnRenamed("m", "before"), "id").filter("m <> before").isEmpty()
        release(mark)
        mark = nxt
        if settled:
            release(steps)
            return mark


def strong_components(edges: DataFrame, rounds: int = 1000, task_edges: int = TASK_EDGES) -> DataFrame:
    """``id, component``: strong components named by their least id.

    Nodes off every cycle are trimmed; then every node takes the largest id that
    reaches it, and what reaches back to that id with the same mark is its component;
    the rest goes on.  All steps are joins, several in one job.  Up to ``task_edges``
    edges, counted first, are settled in one task, with equal rows.  Of larger graphs the
    components inside blocks of near ids are first drawn together, as long as that leaves at
    most two thirds of the edges.
    """
    e = materialise(edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst").distinct(), "scc")
    if e.schema["src"].dataType.typeName() in ("long", "integer", "string"):
        n = e.count()
        if n <= task_edges:
            found = _strong_in_task(e)
            return nodes(edges).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        drawn = _strong_in_blocks(e, n)
        rep = lambda c: drawn.select(F.col("id").alias(c), F.col("component").alias(f"{c}2"))
        less = e.join(rep("src"), "src", "left").join(rep("dst"), "dst", "left").select(F.coalesce("src2", "src").alias("src"), F.coalesce("dst2", "dst").alias("dst")).filter("src <> dst").distinct()
        less, m = counted(less, F.lit(True), "scc")
        if 3 * m <= 2 * n:
            outer = strong_components(less, rounds, task_edges).select(F.col("id").alias("component"), F.col("component").alias("outer"))
            own = nodes(edges).join(drawn, "id", "left").withColumn("component", F.coalesce("component", "id"))
            return own.join(outer, "component", "left").select("id", F.coalesce("outer", "component").alias("component"))
    done = None
    for _ in range(rounds):
        e = _cyclic_part(e)
        if e.isEmpty():
            break
        mark = _largest_reaching(e)
        own = e.join(mark.select(F.col("id").alias("src"), F.col("m").alias("a")), "src").join(mark.select(F.col("id").alias("dst"), F.col("m").alias("b")), "dst").filter("a = b")
        first = materialise(mark.filter("id = m").select(F.col("m").alias("root"), F.col("id").alias("node"), F.lit(0).alias("dist")), "scc-first")
        hit = search_on(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), first)
        name = hit.groupBy("root").agg(F.min("node").alias("component"))
        part = materialise(hit.join(name, "root").select(F.col("node").alias("id"), "component"), "scc-part")
        done = part if done is None else done.unionByName(part)
        old, e = e, materialise(e.join(hit.select(F.col("node").alias("src")), "src", "left_anti").join(hit.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "scc")
        release(old, mark, hit)
    alone = nodes(edges)
    return alone.select("id", F.col("id").alias("component")) if done is None else alone.join(done, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def condensation(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Distinct ``src, dst`` between strong components, given ones if they are known."""
    c = components if components is not None else materialise(strong_components(edges), "scc")
    a = c.select(F.col("id").alias("src"), F.col("component").alias("a"))
    b = c.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    return edges.join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def attracting_components(edges: DataFrame) -> DataFrame:
    """``id, component`` of strong components that no edge leaves."""
    c = materialise(strong_components(edges), "scc")
    return c.join(condensation(edges, c).select(F.col("src").alias("component")), "component", "left_anti").select("id", "component")


def flow_hierarchy(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``value``: share of edge weight that lies on no cycle."""
    w = F.col(weight) if weight else F.lit(1.0)
    c = materialise(strong_components(edges), "scc")
    e = edges.withColumn("_w", w).join(c.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
    return e.agg((F.sum(F.when(F.col("a") != F.col("b"), F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("value"))


def bfs_tree(edges: DataFrame, source: int, directed: bool = False, reverse: bool = False) -> DataFrame:
    """``pred, node, dist``: a search tree; of several predecessors the least."""
    e = edges.select("src", "dst")
    e = (e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else e) if directed else symmetric(e)
    e = e.distinct()
    d = materialise(search(e, edges.sparkSession.range(source, source + 1)), "bfs")
    a = d.select(F.col("node").alias("src"), F.col("dist").alias("da"))
    b = d.select(F.col("node").alias("dst"), "dist")
    return e.join(a, "src").join(b, "dst").filter("dist = da + 1").groupBy(F.col("dst").alias("node"), "dist").agg(F.min("src").alias("pred")).select("pred", "node", "dist")


def hop_distances(edges: DataFrame, sources: DataFrame | None = None, cutoff: int | None = None, directed: bool = False) -> DataFrame:
    """``root, node, dist`` in hops."""
    return search(edges if directed else symmetric(edges), sources, cutoff)


def weighted_distances(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, directed: bool = False, weight=None) -> DataFrame:
    """``root, node, dist, pred`` by weights ``w``; negative weights are allowed on digraphs, negative cycles raise an error.

    ``weight`` may be a column expression, or a function from the edges to one, in place of ``w``; edges of null weight are hidden.
    """
    if weight is not None:
        edges = edges.select("src", "dst", (weight(edges) if callable(weight) else weight).alias("w")).filter("w is not null")
    return relax(edges if directed else symmetric(edges, "src", "dst", "w"), sources, cutoff)


def has_negative_cycle(edges: DataFrame) -> bool:
    """Whether a digraph (``src, dst, w``) has a cycle, or a loop, of negative weight."""
    try:
        potentials(edges)
    except NegativeCycle:
        return True
    return False


def nearest_source(edges: DataFrame, sources: DataFrame, directed: bool = False) -> DataFrame:
    """``id, source, dist``: the nearest of several sources by weights ``w``, ties to the least source."""
    e = edges if directed else symmetric(edges, "src", "dst", "w")
    e = materialise(e.filter("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("w").cast("double").alias("w")), "nearest-edges")
    if (e.agg(F.min("w")).first()[0] or 0.0) >= 0:  # one label a node: a node's nearest source is nearest all along the way
        first = sources.select(F.col("id").cast("long").alias("label")).distinct()
        near = settled_in_blocks(e, first.select(F.lit(0).cast("long").alias("root"), F.col("label").alias("node"), F.lit(0.0).alias("dist"), "label"))
        return near.select(F.col("node").alias("id"), F.col("label").alias("source"), "dist")
    d = weighted_distances(edges, sources, None, directed)
    return d.groupBy(F.col("node").alias("id")).agg(F.min(F.struct("dist", "root")).alias("s")).select("id", F.col("s.root").alias("source"), F.col("s.dist").alias("dist"))


def voronoi(edges: DataFrame, centers: DataFrame, directed: bool = False) -> DataFrame:
    """``id, center`` of all nodes, null if unreachable."""
    return nodes(edges).join(nearest_source(edges, centers, directed).select("id", F.col("source").alias("center")), "id", "left")


def paths(distances: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``root, node, path`` arrays along predecessors of weighted_distances (optionally only to ``targets`` (root, node)).

    All paths are joined by doubling: a row takes the stretch of the node its own ends at,
    so paths of n nodes take log2 n rounds.  Those to targets go back step by step.
    """
    if targets is None:
        ended = F.col("pred").isNull()
        live = distances.select("root", "node", F.coalesce("pred", "node").alias("to"), F.array("node").alias("path"), ended.alias("ended"))
        live = old = materialise(live, "paths")  # ``path`` leads from after ``to``, or from the start if ended, to the node
        for _ in range(64):
            if live.filter("not ended").isEmpty():
                return live.select("root", "node", "path")
            back = live.select("root", F.col("node").alias("to"), F.col("to").alias("to2"), F.col("path").alias("before"), F.col("ended").alias("end2"))
            more = live.filter("not ended").join(back, ["root", "to"]).select("root", "node", F.col("to2").alias("to"), F.concat("before", "path").alias("path"), F.col("end2").alias("ended"))
            live = materialise(live.filter("ended").unionByName(more), "paths")
            release(old)
            old = live
        raise RuntimeError("predecessors run in a circle")
    back = materialise(distances.select("root", F.col("node").alias("at"), "pred"), "preds")
    want = targets.join(distances.select("root", "node"), ["root", "node"], "left_semi")
    live, done = want.select("root", "node", F.col("node").alias("at"), F.array("node").alias("path")), None
    turn = 0
    while True:
        turn += 1
        live = live.join(back, ["root", "at"])
        if turn % 4 == 0:  # four steps back in one job
            live = materialise(live, "paths")
        own = live.filter("pred is null").select("root", "node", "path")
        done = own if done is None else done.unionByName(own)
        live = live.filter("pred is not null").select("root", "node", F.col("pred").alias("at"), F.concat(F.array("pred"), "path").alias("path"))
        if turn % 4 == 0:
            done = materialise(done, "paths-done")
            if not live.limit(1).count():
                return done


def all_shortest_paths(edges: DataFrame, source: int, target: int) -> DataFrame:
    """``path``: every shortest hop path between two nodes of an undirected graph."""
    d = materialise(search(symmetric(edges), edges.sparkSession.range(source, source + 1)), "bfs")
    end = d.filter(F.col("node") == target).first()
    if end is None:
        raise ValueError("no path")
    level = d.select(F.col("node").alias("dst"), F.col("dist").alias("b"))
    down = symmetric(edges).distinct().join(d.select(F.col("node").alias("src"), F.col("dist").alias("a")), "src").join(level, "dst").filter("b = a + 1").select("src", "dst")
    down = materialise(down, "levels")
    p = edges.sparkSession.range(1).select(F.array(F.lit(target).cast("long")).alias("path"))
    for _ in range(end["dist"]):
        p = materialise(p.withColumn("dst", F.element_at("path", 1)).join(down, "dst").select(F.concat(F.array("src"), "path").alias("path")), "paths")
    return p


def eccentricity(edges: DataFrame, batch: int = 32) -> DataFrame:
    """``id, value``: largest hop distance; an error if the graph is disconnected.

    A search from r bounds every other node v: its value is at least max(d, e(r) - d) and
    at most e(r) + d, with d the distance of the two.  Rounds of ``batch`` searches, half
    of them from nodes of the largest upper bounds and half from those of the smallest
    lower bounds, go on until both bounds of every node meet.  Graphs of more than one
    block of edges are settled in blocks if their borders are small.
    """
    e = materialise(symmetric(edges.select("src", "dst")).filter("src <> dst").distinct(), "ecc-edges")
    tables = block_tables(e.select(F.col("src").cast("long"), F.col("dst").cast("long"))) if e.count() > kernels.BLOCK_EDGES else None
    if tables is not None:
        return _eccentricity_in_blocks(nodes(edges).count(), e, tables)
    state = old = materialise(nodes(edges).select("id", F.lit(0).alias("low"), F.lit(2147483647).alias("high")), "ecc")
    n = state.count()
    while True:
        left = state.filter("low < high")
        if left.isEmpty():
            return state.select("id", F.col("low").alias("value"))
        chosen = left.orderBy(F.desc("high"), "id").limit(batch // 2).union(left.orderBy("low", F.desc("high"), "id").limit(batch // 2)).select("id").distinct()
        d = materialise(search(e, chosen), "ecc-search")
        roots = d.groupBy("root").agg(F.max("dist").alias("e"), F.count(F.lit(1)).alias("reach"))  # at most a batch
        if roots.agg(F.min("reach")).first()[0] < n:
            raise ValueError("the graph is disconnected")
        own = d.join(F.broadcast(roots), "root").groupBy(F.col("node").alias("id")).agg(F.max(F.greatest("dist", F.col("e") - F.col("dist"))).alias("lo"), F.min(F.col("e") + F.col("dist")).alias("hi"))
        own = own.join(roots.select(F.col("root").alias("id"), F.col("e").alias("own")), "id", "left")
        state = materialise(state.join(own, "id").select("id", F.coalesce("own", F.greatest("low", "lo")).alias("low"), F.coalesce("own", F.least("high", "hi")).alias("high")), "ecc")
        release(old, d)
        old = state


#: Roots of one round of _eccentricity_in_blocks.
FAR_ROOTS = 4096


def _eccentricity_in_blocks(n: int, edges: DataFrame, tables: DataFrame) -> DataFrame:
    """The rows of ``eccentricity``: the nodes farthest from a central one, in order, until no further one can raise a lower bound.

    With z the distances from the centre, nodes v and u are at most z(v) + z(u) apart, so
    only nodes u of z(u) above the least low(v) - z(v) can be farther from some v than known.
    """
    shared = edges.sparkSession.sparkContext.broadcast(_overlay(tables))
    ids = tables.filter(F.col("at") == IDS).select("blk", "cells").mapInPandas(lambda xs: (pd.DataFrame({"blk": np.int32(b), "id": np.frombuffer(c, np.int64), "low": np.int32(-1), "z": np.int32(0)}) for x in xs for b, c in zip(x["blk"], x["cells"], strict=True)), "blk int, id long, low int, z int")
    none = materialise(ids, "ecc")

    def beyond(root, state):
        return farthest(tables, shared, none.filter(F.col("id") == root["id"]).select("blk", F.col("id").alias("root")), state)

    some = beyond(none.orderBy("id").first(), none)
    end = some.orderBy(F.desc("low"), "id").first()
    if end["low"] >= FAR or none.count() < n:
        raise ValueError("the graph is disconnected")
    one = beyond(end, none)
    both = beyond(one.orderBy(F.desc("low"), "id").first(), one)
    z = beyond(both.orderBy("low", "id").first(), none)
    most = z.agg(F.max("low")).first()[0]
    state = both.select("blk", "id", "low").join(z.select("id", F.col("low").alias("z")).hint("merge"), "id").select("blk", "id", F.greatest("low", "z", most - F.col("z")).alias("low"), "z")
    state = materialise(state, "ecc")
    release(some, one, both, z)
    done = None
    while True:
        least = state.agg(F.min(F.col("low") - F.col("z"))).first()[0]
        left = state.filter(F.col("z") > least)
        if done is not None:
            left = left.filter((F.col("z") < done["z"]) | ((F.col("z") == done["z"]) & (F.col("id") > done["id"])))
        roots = materialise(left.orderBy(F.desc("z"), "id").limit(FAR_ROOTS).select("blk", F.col("id").alias("root"), "z"), "ecc-roots")
        done = roots.select(F.col("root").alias("id"), "z").orderBy("z", F.desc("id")).first()
        if done is None:
            release(none, tables)
            return state.select("id", F.col("low").alias("value"))
        state, old = farthest(tables, shared, roots.select("blk", "root"), state), state
        release(old, roots)


def distance_extremes(edges: DataFrame) -> DataFrame:
    """``id, value, center, periphery`` with the ``radius`` and ``diameter``."""
    e = eccentricity(edges)
    ends = e.agg(F.min("value").alias("radius"), F.max("value").alias("diameter"))
    return e.crossJoin(F.broadcast(ends)).withColumn("center", F.col("value") == F.col("radius")).withColumn("periphery", F.col("value") == F.col("diameter"))


def average_path_length(edges: DataFrame) -> DataFrame:
    """``value``: mean hop distance over ordered pairs of a connected graph."""
    from waygraph.operators.indicators import distance_sums

    d = distance_sums(edges)
    n = F.count(F.lit(1))
    return d.agg((F.sum("total") / (n * (n - 1))).alias("value"))


def transitive_closure(edges: DataFrame) -> DataFrame:
    """``src, dst``: every ordered pair joined by a directed path of at least one edge.

    Pairs are joined on with the edges, level by level; if there are still new ones after
    HOPS levels, the graph is deep and every node is searched from instead.
    """
    e = materialise(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "closure-edges")
    found, new = [e], e
    for _ in range(HOPS):
        step = new.select("src", F.col("dst").alias("m")).join(e.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst").distinct()
        new, n = counted(step.join(_union(found), ["src", "dst"], "left_anti"), F.lit(True), "closure")
        if not n:
            return _union(found)
        found.append(new)
    release(*found[1:])
    r = search(e)
    return e.select("src", F.col("dst").alias("root")).join(r, "root").select("src", F.col("node").alias("dst")).distinct()


def descendants(edges: DataFrame, source: int) -> DataFrame:
    """``id`` of nodes reachable from a node."""
    return search(edges, edges.sparkSession.range(source, source + 1)).filter("node <> root").select(F.col("node").alias("id"))


def ancestors(edges: DataFrame, source: int) -> DataFrame:
    """``id`` of nodes that reach a node."""
    return descendants(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), source)


def topological_levels(edges: DataFrame) -> DataFrame:
    """``id, level``: rounds of removing nodes without in-edges; an error if there is a cycle."""
    e = materialise(edges.select("src", "dst").distinct(), "dag")
    left, out, level = materialise(nodes(edges), "dag-left"), None, 0
    while left.limit(1).count():
        free = materialise(left.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"), "dag-free")
        if not free.limit(1).count():
            raise ValueError("the graph has a cycle")
        own = free.select("id", F.lit(level).alias("level"))
        out = own if out is None else out.unionByName(own)
        left = materialise(left.join(free, "id", "left_anti"), "dag-left")
        e = materialise(e.join(free.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst"), "dag")
        level += 1
    return out if out is not None else left.withColumn("level", F.lit(0))


def is_dag(edges: DataFrame) -> bool:
    """Whether a digraph has no cycle."""
    try:
        topological_levels(edges)
    except ValueError:
        return False
    return True


def _longest(edges: DataFrame, weight: str | None) -> DataFrame:
    """``node, dist, pred`` of a DAG: the negative of the largest sum to each node, and the least predecessor that gives it."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    topological_levels(edges)  # an error if there is a cycle
    e = edges.select("src", "dst", (-w).alias("w"))
    d = materialise(potentials(e).select("node", "dist"), "longest")
    up = d.select(F.col("node").alias("src"), F.col("dist").alias("ds"))
    back = e.join(up, "src").join(d.select(F.col("node").alias("dst"), "dist"), "dst").filter("dist < 0 and ds + w = dist")
    return d.join(back.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("pred")), "node", "left")


def dag_longest_path_length(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``value``: the largest sum of weights along a path of a DAG, at least 0."""
    return _longest(edges, weight).agg(F.greatest(F.lit(0.0), -F.min("dist")).alias("value"))


def dag_longest_path(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``path``: one longest path of a DAG; of several ends the least, of equal predecessors the least."""
    d = _longest(edges, weight).withColumn("root", F.lit(0).cast("long"))
    end = d.orderBy("dist", "node").limit(1).select("root", "node")
    return paths(d, end).select("path")


def astar_path_length(edges: DataFrame, source: int, target: int, heuristic: DataFrame, directed: bool = False) -> DataFrame:
    """``value``: least sum of ``w`` between two nodes, null if there is none; rows that cannot better the best so far go.

    ``heuristic`` (id, h) bounds the rest of the way to the target from below; a node
    without a row counts 0.  Each round joins the rows that improved, and keeps
    only those whose sum and bound are below the target's sum so far.
    """
    e = edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    e = e if directed else symmetric(e, "src", "dst", "w")
    e = e.groupBy("src", "dst").agg(F.min("w").alias("w")).join(heuristic.select(F.col("id").alias("dst"), "h"), "dst", "left").na.fill(0.0, ["h"])
    e = materialise(e, "astar-edges")
    best = front = materialise(edges.sparkSession.range(source, source + 1).select(F.col("id").alias("node"), F.lit(0.0).alias("dist")), "astar")
    while True:
        goal = best.filter(F.col("node") == target).first()
        step = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("d"), "h")
        if goal is not None:
            step = step.filter(F.col("d") + F.col("h") < goal["dist"])
        step = step.groupBy("node").agg(F.min("d").alias("d"))
        nxt = best.join(step, "node", "full").select("node", F.least("dist", "d").alias("dist"), F.coalesce(F.col("d") < F.col("dist"), F.col("dist").isNull()).alias("moved"))
        nxt = materialise(nxt, "astar")
        best, front = nxt.select("node", "dist"), nxt.filter("moved").select("node", "dist")
        if not front.limit(1).count():
            return best.filter(F.col("node") == target).agg(F.min("dist").alias("value"))


def has_path(edges: DataFrame, source: int, target: int, directed: bool = False) -> DataFrame:
    """``value``: whether a path leads from one node to another."""
    found = search(edges if directed else symmetric(edges), edges.sparkSession.range(source, source + 1))
    return found.agg(F.coalesce(F.bool_or(F.col("node") == target), F.lit(False)).alias("value"))


def floyd_warshall(edges: DataFrame, directed: bool = False) -> DataFrame:
    """``src, dst, dist`` of all pairs by weights, negative ones allowed on digraphs: every node relaxes as a source."""
    e = edges if directed else symmetric(edges, "src", "dst", "w")
    return relax(e, nodes(edges)).select(F.col("root").alias("src"), F.col("node").alias("dst"), "dist")


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges of a DAG that no longer path implies.

    If all edges lead to larger ids, or all to smaller ones, a longer path between the ends of an
    edge passes only ids between them: blocks of ids decide their edges alone, with the edges
    from ids up to their farthest target.  If those are many, searches from a node end at
    its farthest target that is not implied yet.  Other graphs list the closure.
    """
    e = materialise(edges.select("src", "dst").distinct(), "reduction-edges")
    facts = e.agg(F.count_if(F.col("src") >= F.col("dst")).alias("down"), F.count_if(F.col("src") <= F.col("dst")).alias("up"), F.count(F.lit(1)).alias("n")).first()
    if not facts["down"] or not facts["up"]:
        sign = 1 if not facts["down"] else -1
        whole = isinstance(e.schema["src"].dataType, IntegralType) and isinstance(e.schema["dst"].dataType, IntegralType)
        longer = _implied_in_blocks(e, facts["n"], sign) if whole else None
        if longer is None:
            longer = _implied(e, sign)
    else:
        c = materialise(transitive_closure(e), "closure")
        longer = e.select("src", F.col("dst").alias("m")).join(c.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst").distinct()
    return e.join(longer, ["src", "dst"], "left_anti")


def _implied_in_blocks(e: DataFrame, count: int, sign: int) -> DataFrame | None:
    """The rows of ``_implied``, or None if a block would need more than a few blocks' edges."""
    e = e.filter("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    turned = e if sign > 0 else e.select((-F.col("src")).alias("src"), (-F.col("dst")).alias("dst"))
    of = node_blocks(turned, count)
    span = turned.join(of.withColumnRenamed("id", "src"), "src").groupBy("blk").agg(F.min("src").alias("low"), F.max("src").alias("high"), F.max("dst").alias("last"))
    span = materialise(span, "reduction-spans")  # one row a block
    own = F.col("src") <= F.col("high")
    rows = materialise(turned.join(F.broadcast(span), (F.col("src") >= F.col("low")) & (F.col("src") < F.col("last"))).select("blk", "src", "dst", own.alias("own")), "reduction-blocks")
    most = rows.groupBy("blk").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > 4 * kernels.BLOCK_EDGES:
        release(of, span, rows)
        return None

    def settle(x):
        src, dst = x["src"].to_numpy(), x["dst"].to_numpy()
        ids = np.unique(np.concatenate([src, dst]))
        a, d = np.searchsorted(ids, src), np.searchsorted(ids, dst) - np.searchsorted(ids, src)
        order = np.argsort(-a, kind="stable")
        mine, hit = x["own"].to_numpy()[order], np.zeros(len(x), bool)
        a, d = a[order].tolist(), d[order].tolist()
        mask = (1 << (max(d) + 1)) - 1
        reach, k = {}, 0  # bit j of a node's number: a path leads to the node j places on
        while k < len(a):
            u, j, longer, direct = a[k], k, 0, 0
            while k < len(a) and a[k] == u:
                longer |= reach.get(u + d[k], 0) << d[k]
                direct |= 1 << d[k]
                k += 1
            for i in range(j, k):
                hit[i] = mine[i] and longer >> d[i] & 1
            reach[u] = (longer | direct) & mask
        return x.iloc[order][hit][["src", "dst"]]

    found = rows.groupBy("blk").applyInPandas(settle, "src long, dst long")
    found = materialise(found if sign > 0 else found.select((-F.col("src")).alias("src"), (-F.col("dst")).alias("dst")), "reduction-hit")
    release(of, span, rows)
    return found


def _implied(e: DataFrame, sign: int) -> DataFrame:
    """The edges ``src, dst`` of ``e`` that a longer path implies, all of ``sign`` times rising ids."""
    steps = materialise(with_loops(e.filter("src is not null and dst is not null"), F.lit(None)), "reduction-steps")
    edge = steps.filter("src <> dst")
    several = edge.groupBy("dst").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("dst")
    left = materialise(edge.join(several, "dst", "left_semi"), "reduction-left")
    last = F.col("dst") if sign > 0 else -F.col("dst")
    at = F.col("node") if sign > 0 else -F.col("node")
    seen = front = edge.select("src", F.col("dst").alias("node"))
    out, parts, size, hops = [], [], 1, 1  # most edges are implied by two steps, and then hold no search open
    while size:
        most = left.groupBy("src").agg(F.max(last).alias("most"))
        reach = front.join(most, "src").filter(at < F.col("most"))
        for _ in range(hops):
            reach = reach.join(steps.select(F.col("src").alias("node"), F.col("dst").alias("to")), "node").select("src", F.col("to").alias("node"), "most").filter(at <= F.col("most")).distinct()
        new, size = counted(reach.join(seen, ["src", "node"], "left_anti").select("src", "node"), F.lit(True), "reduction")
        # an edge is implied by any node on the way, other than its own ends, that leads to its far end
        via = front.unionByName(new).join(edge.select(F.col("src").alias("node"), "dst"), "node").select("src", "dst")
        out.append(materialise(left.join(via, ["src", "dst"], "left_semi"), "reduction-hit"))
        old, left = left, materialise(left.join(out[-1], ["src", "dst"], "left_anti"), "reduction-left")
        release(old)
        front, parts, hops = new, [*parts, new], HOPS
        seen = _union([edge.select("src", F.col("dst").alias("node")), *parts])
    return _union(out)


def simple_paths(edges: DataFrame, source: int, target: int, cutoff: int, directed: bool = False) -> DataFrame:
    """``path``: all paths without repetition of at most ``cutoff`` edges."""
    e = materialise((edges.select("src", "dst") if directed else symmetric(edges)).distinct(), "steps")
    live, out = edges.sparkSession.range(1).select(F.array(F.lit(source).cast("long")).alias("path")), None
    for _ in range(cutoff):
        live = live.withColumn("src", F.element_at("path", -1)).join(e, "src").filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        live = materialise(live, "paths")
        own = live.filter(F.element_at("path", -1) == target)
        out = own if out is None else out.unionByName(own)
        live = live.filter(F.element_at("path", -1) != target)
    return out


def simple_cycles(edges: DataFrame, cutoff: int) -> DataFrame:
    """``cycle``: elementary circuits of a digraph of at most ``cutoff`` nodes, each from its least node."""
    e = materialise(edges.select("src", "dst").distinct(), "steps")
    out = e.filter("src = dst").select(F.array("src").alias("cycle"))
    live = e.filter("src < dst").select(F.array("src", "dst").alias("path"))
    for _ in range(cutoff - 1):
        step = materialise(live.withColumn("src", F.element_at("path", -1)).join(e, "src"), "cycles")
        out = out.unionByName(step.filter(F.col("dst") == F.element_at("path", 1)).select(F.col("path").alias("cycle")))
        live = step.filter((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return out


def spanning_forest(edges: DataFrame, weight: str = "w", minimum: bool = True) -> DataFrame:
    """``src, dst, w``: edges of a least (or greatest) spanning forest by Boruvka rounds, ties by (src, dst); null weights are ignored."""
    w = F.col(weight).cast("double")
    e = canonical(edges.filter(w.isNotNull() & ~F.isnan(w)).select("src", "dst", (w if minimum else -w).alias("w")), "w").filter("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w"))
    e = materialise(e.select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b")), "mst")
    out = None
    while e.limit(1).count():
        s = e.select("a", "src", "dst", "w").unionByName(e.select(F.col("b").alias("a"), "src", "dst", "w"))
        best = s.groupBy("a").agg(F.min(F.struct("w", "src", "dst")).alias("s")).select("s.*").distinct()
        best = materialise(best, "mst-best")
        out = best if out is None else out.unionByName(best)
        pairs = e.join(best.select("src", "dst"), ["src", "dst"], "left_semi")
        cc = materialise(connected_components(pairs, "a", "b"), "mst-cc")
        e = e.join(cc.select(F.col("id").alias("a"), F.col("component").alias("x")), "a", "left").join(cc.select(F.col("id").alias("b"), F.col("component").alias("y")), "b", "left")
        e = materialise(e.select("src", "dst", "w", F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).filter("a <> b"), "mst")
    if out is None:
        return e.select("src", "dst", "w")
    return out.select("src", "dst", (F.col("w") if minimum else -F.col("w")).alias("w"))


def tree_facts(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``tree, forest`` of an undirected graph and ``arborescence, branching`` of the same edges as a digraph."""
    cc = materialise(components(edges, vertices), "cc")
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    n = cc.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("component").alias("c"))
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("i")).agg(F.coalesce(F.max("i"), F.lit(0)).alias("i"))
    t = m.crossJoin(n).crossJoin(into)  # one row each
    forest = F.col("m") == F.col("n") - F.col("c")
    return t.select((forest & (F.col("c") == 1)).alias("tree"), forest.alias("forest"), (forest & (F.col("c") == 1) & (F.col("i") <= 1)).alias("arborescence"), (forest & (F.col("i") <= 1)).alias("branching"))


def _matched(e: pd.DataFrame) -> pd.DataFrame:
    """The ``state`` of one block's open edges: TAKEN, DROPPED, OPEN, or CLEAR at this block's end of an edge that leaves it.

    An edge is decided once all before it at its ends are.  Of an edge that leaves the
    block, the other block decides its own end and says CLEAR (``heard``).
    """
    e = e.sort_values("at")
    used, waits, states = set(), set(), []
    for src, dst, low, inner, heard in zip(e["src"], e["dst"], e["low"], e["blk"] == e["other"], e["heard"], strict=True):
        ends = (src, dst) if inner else (src,) if low else (dst,)
        if any(x in used for x in ends):
            states.append(DROPPED)
        elif any(x in waits for x in ends):
            states.append(OPEN)
            waits.update(ends)
        elif inner or heard in (CLEAR, TAKEN):
            states.append(TAKEN)
            used.update(ends)
        else:
            states.append(CLEAR)
            waits.update(ends)
    e = e.assign(state=states).drop(columns="heard")
    return e[(e["state"] != DROPPED) | (e["blk"] != e["other"])]  # the other block hears of what is dropped


DROPPED, TAKEN, OPEN, CLEAR = range(4)


def maximal_matching(edges: DataFrame, priority: str | None = None) -> DataFrame:
    """``src, dst``: the matching that takes edges in order of ``priority`` (default (src, dst)).

    Nodes are dealt over ranges of ids; a round decides in every block all edges that its
    own edges decide, and blocks tell each other of edges between them, so the rounds are
    counted in blocks that a chain of ranks passes.  While a node has more open edges than a
    block may hold, edges least at both ends are taken round by round instead.
    """
    more = [priority] if priority else []
    e = canonical(edges, *more).filter("src <> dst").groupBy("src", "dst").agg(F.min(F.struct(*more, "src", "dst")).alias("r"))
    e, out = materialise(e, "matching"), []
    while True:
        ends = symmetric(e, "src", "dst", "r").groupBy(F.col("src").alias("id")).agg(F.min("r").alias("m"), F.count(F.lit(1)).alias("n"))
        low, hubs = counted(ends, F.col("n") > kernels.BLOCK_EDGES, "low")
        if not hubs:
            release(low)
            break
        take = e.join(low.select(F.col("id").alias("src"), F.col("m").alias("a")), "src").join(low.select(F.col("id").alias("dst"), F.col("m").alias("b")), "dst").filter("r = a and r = b").select("src", "dst")
        out.append(materialise(take, "taken"))
        used, old = out[-1].select(F.explode(F.array("src", "dst")).alias("id")), e
        e = materialise(e.join(used.withColumnRenamed("id", "src"), "src", "left_anti").join(used.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "r"), "matching")
        release(old, low)
    of = node_blocks(e, e.count())
    both = e.join(of.select(F.col("id").alias("src"), F.col("blk").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("blk").alias("b")), "dst")
    both = both.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))).alias("low"), "a", "b", "src", "dst", "r")
    blk, other = F.when(F.col("low"), F.col("a")).otherwise(F.col("b")), F.when(F.col("low"), F.col("b")).otherwise(F.col("a"))
    at = F.row_number().over(Window.partitionBy("blk").orderBy("r"))  # a block's edges
    live = both.select(blk.alias("blk"), other.alias("other"), "low", "src", "dst", "r").withColumn("at", at).drop("r").withColumn("heard", F.lit(OPEN))
    kind = e.schema["src"].dataType.simpleString()
    schema, old = f"blk int, other int, low boolean, src {kind}, dst {kind}, at int, state int", None
    while True:
        new, size = counted(live.groupBy("blk").applyInPandas(_matched, schema), F.col("state") >= OPEN, "matched")
        out.append(materialise(new.filter((F.col("state") == TAKEN) & F.col("low")).select("src", "dst"), "taken"))
        release(old)
        if not size:
            release(e, of, new)
            return _union(out)
        if len(out) > 16:
            parts, out = out, [materialise(_union(out), "taken")]
            release(*parts)
        said = new.filter("blk <> other").select(F.col("other").alias("blk"), "src", "dst", F.col("state").alias("heard"))
        live = new.filter(F.col("state") >= OPEN).drop("state").join(said, ["blk", "src", "dst"], "left").na.fill(OPEN, ["heard"]).filter(F.col("heard") != DROPPED)
        old = new


def matching_facts(edges: DataFrame, matching: DataFrame) -> DataFrame:
    """``is_matching, is_maximal``."""
    used = matching.select(F.explode(F.array("src", "dst")).alias("id"))
    twice = used.groupBy("id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("t"))
    fake = canonical(matching).join(canonical(edges), ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("f"))
    free = edges.filter("src <> dst").join(used.withColumnRenamed("id", "src"), "src", "left_anti").join(used.withColumnRenamed("id", "dst"), "dst", "left_anti").agg(F.count(F.lit(1)).alias("o"))
    ok = (F.col("t") == 0) & (F.col("f") == 0)
    return twice.crossJoin(fake).crossJoin(free).select(ok.alias("is_matching"), (ok & (F.col("o") == 0)).alias("is_maximal"))  # one row each


def independent_set(edges: DataFrame, seed: int = 0, must: DataFrame | None = None) -> DataFrame:
    """``id``: a maximal independent set by rounds of hash priorities, containing ``must`` if given."""
    s = materialise(symmetric(edges).filter("src <> dst").distinct(), "links")
    left = materialise(nodes(edges), "mis-left")
    rank = F.struct(F.xxhash64(F.lit(seed), "id"), F.col("id"))
    out, first = None, must
    while left.limit(1).count():
        if first is not None:
            take, first = first.select("id"), None
        else:
            live = s.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.select(F.col("id").alias("dst"), rank.alias("r")), "dst")
            best = live.groupBy(F.col("src").alias("id")).agg(F.min("r").alias("m"))
            take = left.withColumn("r", rank).join(best, "id", "left").filter("m is null or r < m").select("id")
        take = materialise(take, "mis")
        out = take if out is None else out.unionByName(take)
        near = s.join(take.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        left = materialise(left.join(take.union(near), "id", "left_anti"), "mis-left")
    return out if out is not None else left


def is_dominating(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """``value``: every node is chosen or next to a chosen one."""
    near = symmetric(edges).join(chosen.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return nodes(edges).join(chosen.select("id").union(near), "id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("value"))


def is_edge_cover(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """``value``: every node is an end of a chosen edge."""
    return nodes(edges).join(nodes(cover), "id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("value"))


def tournament_facts(edges: DataFrame) -> DataFrame:
    """``is_tournament, scores`` (sorted out-degrees)."""
    e = edges.select("src", "dst").distinct()
    n = nodes(e).agg(F.count(F.lit(1)).alias("n"))
    m = e.agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("src") == F.col("dst")).alias("l"))
    p = canonical(e).distinct().agg(F.count(F.lit(1)).alias("p"))
    out = nodes(e).join(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k")), "id", "left").agg(F.sort_array(F.collect_list(F.coalesce("k", F.lit(0)))).alias("scores"))
    full = F.col("n") * (F.col("n") - 1) / 2
    return n.crossJoin(m).crossJoin(p).crossJoin(out).select(((F.col("m") == full) & (F.col("p") == full) & (F.col("l") == 0)).alias("is_tournament"), "scores")  # one row each


def is_graphical(sequence: DataFrame, column: str = "degree") -> DataFrame:
    """``graphical, multigraphical, pseudographical`` of a table of degrees, on its histogram (Erdos-Gallai)."""
    h = sequence.groupBy(F.col(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("d"))  # distinct degrees
    h = h.withColumn("k", F.sum("n").over(w)).withColumn("s", F.sum(F.col("n") * F.col("d")).over(w))
    t = h.select(F.col("d").alias("d2"), F.col("n").alias("n2"))
    rest = h.join(t, F.col("d2") < F.col("d"), "left").groupBy("d", "n", "k", "s").agg(F.coalesce(F.sum(F.col("n2") * F.least("d2", "k")), F.lit(0)).alias("r"))  # pairs of distinct degrees
    total = h.agg(F.coalesce(F.sum(F.col("n") * F.col("d")), F.lit(0)).alias("sum"), F.coalesce(F.min("d"), F.lit(0)).alias("lo"), F.coalesce(F.max("d"), F.lit(0)).alias("hi"))
    ok = rest.agg(F.coalesce(F.bool_and(F.col("s") <= F.col("k") * (F.col("k") - 1) + F.col("r")), F.lit(True)).alias("ok"))
    even = (F.col("sum") % 2 == 0) & (F.col("lo") >= 0)
    return total.crossJoin(ok).select((even & F.col("ok")).alias("graphical"), (even & (2 * F.col("hi") <= F.col("sum"))).alias("multigraphical"), even.alias("pseudographical"))  # one row each


def bridges(edges: DataFrame, seed: int = 0) -> DataFrame:
    """``src, dst``: edges whose removal disconnects; parallel edges never are.

    Up to one block of edges, counted first, is settled in one task.  Of larger graphs blocks of
    near ids are drawn together first (``_shrunk``), as long as that leaves at
    most two thirds of the edges; else random values tell (``_bridges_by_levels``).
    """
    e = canonical(edges).filter("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    e = materialise(e.withColumn("key", F.monotonically_increasing_id()), "bridges")
    rows = e.select("src", "dst", "key", F.explode(F.when(F.col("m") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("twin")).drop("twin")
    return e.join(_bridge_keys(materialise(rows, "bridge-edges"), seed), "key", "left_semi").select("src", "dst")


def _two_connected(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each edge of a bounded multigraph is a bridge, the part of each node once bridges are gone)."""
    ends = np.concatenate([a, b])
    order = np.argsort(ends, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))]).tolist()
    other, edge = np.concatenate([b, a])[order].tolist(), (order % len(a)).tolist() if len(a) else []
    when, low, clock = [0] * n, [0] * n, 0
    cut, part, open_ = np.zeros(len(a), bool), np.zeros(n, np.int64), []
    for root in range(n):
        if when[root]:
            continue
        clock += 1
        when[root] = low[root] = clock
        stack, open_ = [(root, -1, starts[root])], [root]
        while stack:
            u, by, k = stack.pop()
            if k < starts[u + 1]:
                stack.append((u, by, k + 1))
                v = other[k]
                if edge[k] == by:
                    continue
                if when[v]:
                    low[u] = min(low[u], when[v])
                    continue
                clock += 1
                when[v] = low[v] = clock
                open_.append(v)
                stack.append((v, edge[k], starts[v]))
                continue
            if low[u] == when[u]:  # nothing below u leads above it
                if by >= 0:
                    cut[by] = True
                while True:
                    v = open_.pop()
                    part[v] = u
                    if v == u:
                        break
            if stack:
                up = stack[-1][0]
                low[up] = min(low[up], low[u])
    return cut, part


#: Kinds of rows of a shrunk block: a bridge, a bridge of a chain and its chain, a chain, a border node and its part.
DECIDED, MEMBER, CHAIN, BORDER_OF = range(4)


def _shrunk(x: pd.DataFrame) -> pd.DataFrame:
    """Rows ``what, key, grp, src, dst`` of one block's edges: parts without a bridge become one node, bridges that cut
    off no border node are decided, and chains of bridges that stand or fall together become one edge.
    """
    inner = x[x["a"] == x["b"]]
    out = x[x["a"] != x["b"]]
    own = np.where(out["a"] == out["blk"], out["src"], out["dst"])
    codes, names = pd.factorize(np.concatenate([inner["src"].to_numpy(), inner["dst"].to_numpy(), own]), sort=True)
    k = len(inner)
    cut, part = _two_connected(codes[:k], codes[k : 2 * k], len(names))
    border = {*part[codes[2 * k :]].tolist()}
    keys, links, rows = inner["key"].to_numpy(), {}, []
    for i in np.flatnonzero(cut).tolist():
        u, v = int(part[codes[i]]), int(part[codes[k + i]])
        links.setdefault(u, {})[v] = links.setdefault(v, {})[u] = i
    todo = [u for u in links if len(links[u]) == 1 and u not in border]
    while todo:
        u = todo.pop()
        if len(links[u]) != 1:
            continue
        (v, i), = links.pop(u).items()
        del links[v][u]
        rows.append((DECIDED, keys[i], None, None, None))
        if len(links[v]) == 1 and v not in border:
            todo.append(v)
    held = {u for u in links if u in border or len(links[u]) > 2}
    for u in held:
        for v, i in links[u].items():
            chain, before = [i], u
            while v not in held:
                before, v = v, next(w for w in links[v] if w != before)
                chain.append(links[before][v])
            if (u, chain[0]) < (v, chain[-1]):  # each chain from one of its ends
                grp = keys[chain[0]]
                rows.append((CHAIN, grp, None, names[u], names[v]))
                rows += [(MEMBER, keys[j], grp, None, None) for j in chain]
    rows += [(BORDER_OF, None, None, names[c], names[part[c]]) for c in np.unique(codes[2 * k :])]
    out = pd.DataFrame(rows, columns=["what", "key", "grp", "src", "dst"])
    return out.astype({"what": "int32", "key": "Int64", "grp": "Int64"})


def _bridge_keys(e: DataFrame, seed: int) -> DataFrame:
    """``key`` of the bridges of a multigraph ``src, dst, key`` (written, no loops); rows of one key are parallel."""
    n, kind = e.count(), e.schema["src"].dataType.simpleString()
    if n <= kernels.BLOCK_EDGES:

        def settle(batches):
            parts = list(batches)
            if parts:
                x = pd.concat(parts, ignore_index=True)
                codes, names = pd.factorize(pd.concat([x["src"], x["dst"]], ignore_index=True))
                yield x.loc[_two_connected(codes[: len(x)], codes[len(x) :], len(names))[0], ["key"]]

        return materialise(e.coalesce(1).mapInPandas(settle, "key long"), "bridge-keys")
    of = node_blocks(e, n)
    both = e.join(of.select(F.col("id").alias("src"), F.col("blk").alias("a")).hint("merge"), "src").join(of.select(F.col("id").alias("dst"), F.col("blk").alias("b")).hint("merge"), "dst")
    both = materialise(both.select("src", "dst", "key", "a", "b"), "bridge-blocks")
    sides = both.withColumn("blk", F.explode(F.array_distinct(F.array("a", "b"))))
    small = materialise(sides.groupBy("blk").applyInPandas(_shrunk, f"what int, key long, grp long, src {kind}, dst {kind}"), "bridge-shrunk")
    node = small.filter(F.col("what") == BORDER_OF)
    at = lambda c: node.select(F.col("src").alias(c), F.col("dst").alias(f"{c}2"))
    across = both.filter("a <> b").join(at("src"), "src").join(at("dst"), "dst").select(F.col("src2").alias("src"), F.col("dst2").alias("dst"), "key")
    rest, m = counted(across.unionByName(small.filter(F.col("what") == CHAIN).select("src", "dst", "key")), F.lit(True), "bridge-rest")
    found = _bridge_keys(rest, seed) if 3 * m <= 2 * n else _bridges_by_levels(rest, seed)
    chain = small.filter(F.col("what") == MEMBER).select(F.col("grp").alias("key"), F.col("key").alias("member"))
    found = found.join(chain, "key", "left").select(F.coalesce("member", "key").alias("key"))
    return materialise(small.filter(F.col("what") == DECIDED).select("key").unionByName(found), "bridge-keys")


def _bridges_by_levels(rows: DataFrame, seed: int) -> DataFrame:
    """The rows of ``_bridge_keys`` by joins, one level of a search forest a round.

    Every edge outside the forest gets a random 64-bit value; the xor of the
    values at the nodes below a tree edge is 0 exactly if no such edge leaves the
    sub-tree (up to 2^-64).
    """
    e = materialise(canonical(rows, "key").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("key")), "bridges")
    cc = components(e)
    d = materialise(search(symmetric(e), cc.select(F.col("component").alias("id")).distinct()).select("node", "dist"), "levels")
    s = symmetric(e).join(d.select(F.col("node").alias("src"), F.col("dist").alias("a")), "src").join(d.select(F.col("node").alias("dst"), "dist"), "dst").filter("dist = a + 1")
    tree = materialise(s.groupBy(F.col("dst").alias("id"), "dist").agg(F.min("src").alias("pred")), "tree")
    t = tree.select(F.least("id", "pred").alias("src"), F.greatest("id", "pred").alias("dst"))
    extra = e.join(t, ["src", "dst"], "left_anti").unionByName(e.join(t, ["src", "dst"], "left_semi").filter("m > 1"))
    x = extra.select(F.explode(F.array("src", "dst")).alias("id"), F.xxhash64(F.lit(seed), "src", "dst").alias("x")).groupBy("id").agg(F.bit_xor("x").alias("x"))
    v = materialise(d.withColumnRenamed("node", "id").join(x, "id", "left").join(tree.select("id", "pred"), "id", "left").select("id", "dist", "pred", F.coalesce("x", F.lit(0).cast("long")).alias("x")), "xor")
    top, out = v.agg(F.max("dist")).first()[0] or 0, None
    below = None
    for level in range(top, 0, -1):
        own = v.filter(F.col("dist") == level)
        if below is not None:
            own = own.join(below, "id", "left").withColumn("x", F.col("x").bitwiseXOR(F.coalesce("y", F.lit(0).cast("long")))).drop("y")
        own = materialise(own, "xor-level")
        hit = own.filter("x = 0").select(F.least("id", "pred").alias("src"), F.greatest("id", "pred").alias("dst"))
        out = hit if out is None else out.unionByName(hit)
        below = own.groupBy(F.col("pred").alias("id")).agg(F.bit_xor("x").alias("y"))
    return e.join(out, ["src", "dst"], "left_semi").select("key") if out is not None else e.select("key").limit(0)


def local_bridges(edges: DataFrame) -> DataFrame:
    """``src, dst`` of edges whose ends have no common neighbour; ``bridge_spans`` has the length of the way round."""
    from waygraph.operators.graph.cluster import triangle_rows

    t = triangle_rows(edges).select(F.explode(F.array(*[F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")) for x, y in (("a", "b"), ("b", "c"), ("a", "c"))])).alias("e")).select("e.*")
    return canonical(edges).filter("src <> dst").distinct().join(t, ["src", "dst"], "left_anti")


def bridge_spans(edges: DataFrame) -> DataFrame:
    """``src, dst, span`` of local bridges: hops between the ends without the edge, null for bridges.

    All are searched at once: a frontier of (edge, node) rows that leaves out its own edge, until its far end is met.
    Of those not met within HOPS levels bridges are known and not searched on, since that would go over all nodes.
    """
    e = materialise(local_bridges(edges), "local-bridges")
    steps = materialise(symmetric(canonical(edges).filter("src <> dst").distinct()).withColumnRenamed("src", "at"), "steps")
    key = ["src", "dst"]
    seen = front = materialise(e.select(*key, F.col("src").alias("node"), F.lit(0).alias("span")), "span")
    out, n = None, 0
    while front.limit(1).count():
        n += 1
        step = front.join(steps.withColumnRenamed("dst", "to"), F.col("node") == F.col("at")).filter(~((F.col("node") == F.col("src")) & (F.col("to") == F.col("dst"))))
        step = step.select(*key, F.col("to").alias("node")).distinct().join(seen.select(*key, "node"), [*key, "node"], "left_anti")
        step = materialise(step.withColumn("span", F.lit(n)), "span")
        hit = step.filter("node = dst").select(*key, "span")
        out = hit if out is None else out.unionByName(hit)
        more = step.join(hit.select(*key), key, "left_anti")
        if n == HOPS and not more.isEmpty():
            more = more.join(bridges(canonical(edges).distinct()), key, "left_anti")
        front = materialise(more, "span-front")
        seen = materialise(seen.unionByName(front), "span-seen")
    return e.join(out, key, "left") if out is not None else e.withColumn("span", F.lit(None).cast("int"))


def bridge_components(edges: DataFrame) -> DataFrame:
    """``id, component`` after all bridges are removed."""
    rest = canonical(edges).join(bridges(edges), ["src", "dst"], "left_anti")
    return components(rest, nodes(edges))


def metric_closure(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """``src, dst, w``: least distances between terminals; many of them are searched from together, and no rows of other nodes are listed."""
    d = distances_among(symmetric(edges, "src", "dst", "w"), terminals)
    if d is None:
        d = weighted_distances(edges, terminals)
    return d.join(terminals.withColumnRenamed("id", "node"), "node", "left_semi").filter("root < node").select(F.col("root").alias("src"), F.col("node").alias("dst"), F.col("dist").alias("w"))


def steiner_tree(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """``src, dst``: union of the paths of a spanning tree of the terminals' distances (twice the optimum at most)."""
    d = materialise(weighted_distances(edges, terminals), "steiner")
    c = d.join(terminals.withColumnRenamed("id", "node"), "node", "left_semi").filter("root < node").select(F.col("root").alias("src"), F.col("node").alias("dst"), F.col("dist").alias("w"))
    t = spanning_forest(c).select(F.col("src").alias("root"), F.col("dst").alias("node"))
    p = paths(d, t)
    steps = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))).alias("s")).select("s.*")
    return canonical(steps).distinct()


def greedy_color(edges: DataFrame, strategy: str = "largest_first", seed: int = 0) -> DataFrame:
    """``id, color``: greedy colouring in a static order; a node is coloured once all before it among its neighbours are."""
    s = materialise(symmetric(edges).filter("src <> dst").distinct(), "links")
    d = nodes(edges).join(s.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k")), "id", "left").na.fill(0, ["k"])
    rank = F.struct((-F.col("k")).alias("k"), F.col("id")) if strategy == "largest_first" else F.struct(F.xxhash64(F.lit(seed), "id").alias("k"), F.col("id"))
    r = materialise(d.select("id", rank.alias("r")), "ranks")
    before = materialise(s.join(r.select(F.col("id").alias("src"), F.col("r").alias("a")), "src").join(r.select(F.col("id").alias("dst"), F.col("r").alias("b")), "dst").filter("b < a").select(F.col("src").alias("id"), F.col("dst").alias("first")), "before")
    out = None
    left = r.select("id")
    while True:
        if out is None:
            new = left.join(before.select("id"), "id", "left_anti").select("id", F.lit(0).alias("color"))
        else:
            seen = before.join(left, "id", "left_semi").join(out.withColumnRenamed("id", "first"), "first", "left")
            g = seen.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("color").alias("c"), F.collect_set("color").alias("used")).filter("n = c")
            new = g.select("id", F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used")).alias("color"))
        new = materialise(new, "colored")
        if not new.limit(1).count():
            return out if out is not None else new
        out = new if out is None else materialise(out.unionByName(new), "colors")
        left = materialise(left.join(new.select("id"), "id", "left_anti"), "uncolored")


def is_semiconnected(edges: DataFrame) -> bool:
    """Whether of every two nodes one reaches the other: successive strong components must be adjacent."""
    scc = materialise(strong_components(edges), "scc")
    dag = materialise(condensation(edges, scc), "dag")
    names = scc.select(F.col("component").alias("id")).distinct()
    k = names.count()
    if k <= 1:
        return True
    lev = materialise(topological_levels(dag), "levels")
    if lev.count() < k or lev.select("level").distinct().count() < k:
        return False
    nxt = lev.select(F.col("id").alias("dst"), (F.col("level") - 1).alias("level"))
    step = lev.withColumnRenamed("id", "src").join(nxt, "level").join(dag, ["src", "dst"], "left_semi")
    return step.count() == k - 1


def lowest_common_ancestors(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``u, v, ancestor`` on a DAG for given pairs: of the lowest common ancestors the deepest, then the least id."""
    c = search(edges).select(F.col("root").alias("anc"), "node")
    c = materialise(c, "closure")
    both = pairs.join(c.select("anc", F.col("node").alias("u")), "u").join(c.select("anc", F.col("node").alias("v")), ["v", "anc"])
    above = c.filter("anc <> node").select("anc", F.col("node").alias("low"))
    higher = both.join(above, "anc").join(both.select("u", "v", F.col("anc").alias("low")), ["u", "v", "low"]).select("u", "v", "anc").distinct()
    low = both.join(higher, ["u", "v", "anc"], "left_anti")
    lev = topological_levels(edges).select(F.col("id").alias("anc"), "level")
    return low.join(lev, "anc").groupBy("u", "v").agg(F.min(F.struct((-F.col("level")).alias("l"), F.col("anc").alias("ancestor"))).alias("s")).select("u", "v", "s.ancestor")


def is_eulerian(edges: DataFrame, directed: bool = False) -> DataFrame:
    """``value``: connected and all degrees even (of a digraph: strongly connected and balanced)."""
    cc = strong_components(edges) if directed else components(edges)
    one = cc.agg((F.countDistinct("component") == 1).alias("one"))
    if directed:
        net = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("k")), F.struct(F.col("dst").alias("id"), F.lit(-1).alias("k")))).alias("s")).groupBy("s.id").agg(F.sum("s.k").alias("k"))
        even = net.agg(F.bool_and(F.col("k") == 0).alias("even"))
    else:
        even = degrees(edges).agg(F.bool_and(F.col("degree") % 2 == 0).alias("even"))
    return one.crossJoin(even).select((F.col("one") & F.col("even")).alias("value"))  # one row each


def intersection_array(edges: DataFrame) -> DataFrame:
    """``i, b, c`` of a distance-regular graph; ``regular`` is false where neighbour counts differ."""
    s = materialise(symmetric(edges).distinct(), "links")
    d = materialise(search(s), "pairs")
    n = d.join(s.withColumnRenamed("src", "node"), "node").join(d.select("root", F.col("node").alias("dst"), F.col("dist").alias("e")), ["root", "dst"])
    k = n.groupBy("root", "node", "dist").agg(F.count_if(F.col("e") == F.col("dist") + 1).alias("b"), F.count_if(F.col("e") == F.col("dist") - 1).alias("c"))
    return k.groupBy(F.col("dist").alias("i")).agg(F.min("b").alias("b"), F.min("c").alias("c"), ((F.min("b") == F.max("b")) & (F.min("c") == F.max("c"))).alias("regular"))


def could_be_isomorphic(g: DataFrame, h: DataFrame, triangles: bool = True) -> bool:
    """Whether two graphs have equal tables of (degree, triangles); false is certain."""
    from waygraph.operators.graph.cluster import triangles as count

    def profile(x):
        p = degrees(x)
        p = p.join(count(x), "id") if triangles else p.withColumn("triangles", F.lit(0))
        return p.groupBy("degree", "triangles").agg(F.count(F.lit(1)).alias("n"))

    a, b = profile(g), profile(h)
    return not (a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count())


def beam_search(edges: DataFrame, source: int, values: DataFrame, width: int) -> DataFrame:
    """``src, dst``: a breadth-first search that follows, from each node, only the ``width`` neighbours of highest value."""
    v = values.select(F.col("id").alias("dst"), "value")
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("value"), "dst"))
    best = symmetric(edges).distinct().join(v, "dst").withColumn("r", r).filter(F.col("r") <= width).select("src", "dst")
    return bfs_tree(best, source, directed=True).select(F.col("pred").alias("src"), F.col("node").alias("dst"))


def edge_swap(edges: DataFrame, seed: int = 0) -> DataFrame:
    """One round of degree-preserving swaps: edges are paired by hash order, (a,b),(c,d) become (a,d),(c,b) unless that makes a loop or a double edge."""
    e = materialise(canonical(edges).filter("src <> dst").distinct(), "links")
    n = 256
    h = e.withColumn("p", F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(n))).withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.xxhash64(F.lit(seed + 1), "src", "dst"), "src", "dst")))
    pair = h.withColumn("q", F.floor((F.col("r") - 1) / 2)).groupBy("p", "q").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("x")).filter(F.size("x") == 2)
    x = pair.select(F.element_at("x", 1).alias("e1"), F.element_at("x", 2).alias("e2"), F.monotonically_increasing_id().alias("k"))
    x = materialise(x, "swaps")
    new = x.select("k", F.explode(F.array(F.struct(F.col("e1.src").alias("s"), F.col("e2.dst").alias("d")), F.struct(F.col("e2.src").alias("s"), F.col("e1.dst").alias("d")))).alias("n")).select("k", F.least("n.s", "n.d").alias("src"), F.greatest("n.s", "n.d").alias("dst"))
    clash = new.filter("src = dst").select("k").union(new.join(e, ["src", "dst"], "left_semi").select("k")).union(new.join(new.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), ["src", "dst"]).select("k")).distinct()
    good = x.join(clash, "k", "left_anti")
    old = good.select(F.explode(F.array("e1", "e2")).alias("o")).select("o.src", "o.dst")
    return e.join(old, ["src", "dst"], "left_anti").unionByName(new.join(clash, "k", "left_anti").select("src", "dst"))


