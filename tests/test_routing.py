"""Routing and weighted sums against brute force in plain Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from waygraph import graph_queries
from waygraph.operators import indicators, paths, select
from waygraph.operators.graph import centrality, traverse
from waygraph.plans.kernels import NegativeCycle, potentials, relax
from waygraph.plans.stages import materialise
from waygraph.sources.fixtures import street_graph

EDGES = "src long, dst long, w double"


def drawn(n, m, seed):
    g = random.Random(seed)
    return sorted({(*sorted(g.sample(range(n), 2)), float(g.choice([1, 1, 2, 2.5, 3, 7]))) for _ in range(m)}, key=lambda e: e[:2])


def once(edges):
    return [(a, b, w) for (a, b), w in {(a, b): w for a, b, w in reversed(edges)}.items()]


def tree(edges, s, directed=False):
    """(order of settling, predecessors, path counts) from s."""
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
        if not directed:
            out.setdefault(b, []).append((a, w))
    dist, sigma, pred, order, heap = {s: 0.0}, {s: 1.0}, {s: []}, [], [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in order or d > dist[u]:
            continue
        order.append(u)
        for v, w in out.get(u, []):
            if v not in dist or d + w < dist[v] - 1e-12:
                dist[v], sigma[v], pred[v] = d + w, sigma[u], [u]
                heapq.heappush(heap, (d + w, v))
            elif abs(d + w - dist[v]) <= 1e-12 and v not in order:
                sigma[v] += sigma[u]
                pred[v].append(u)
    return order, pred, sigma


def sums(edges, kind, targets=None, directed=False, endpoints=False):
    """(per node, per edge) sums over all sources."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    out, per = dict.fromkeys(nodes, 0.0), {}
    for s in nodes:
        order, pred, sigma = tree(edges, s, directed)
        delta = dict.fromkeys(order, 1.0 if kind == "load" else 0.0)
        for v in reversed(order):
            for u in pred[v]:
                one = 1.0 if targets is None or v in targets else 0.0
                part = sigma[u] / sigma[v] * (one + delta[v]) if kind == "betweenness" else 1 + delta[v] if kind == "stress" else delta[v] / len(pred[v])
                delta[u] += part
                e = (u, v) if directed else tuple(sorted((u, v)))
                per[e] = per.get(e, 0.0) + part
            if v != s:
                out[v] += (sigma[v] * delta[v] if kind == "stress" else delta[v] - (kind == "load")) + endpoints
        out[s] += endpoints * (len(order) - 1)
    return out, per


@pytest.mark.parametrize("slices", [64, 2])
def test_weighted_sums(spark, monkeypatch, slices):
    """Betweenness, stress and load by weight, per node and per edge, over thin and thick slices of distance; two parts and ties."""
    from waygraph.plans import kernels

    monkeypatch.setattr(kernels, "SLICES", slices)
    edges = once(drawn(11, 22, 1)) + [(50, 51, 4.0), (51, 52, 1.0)]
    df = spark.createDataFrame(edges, EDGES)
    cases = [("stress", {}), ("load", {})] if slices == 2 else [("betweenness", {"endpoints": True}), ("betweenness", {"targets": {1, 2, 51}, "directed": True})]
    for kind, more in cases:
        got = {r.id: r.value for r in indicators.brandes(df, kind, weight="w", **more).collect()}
        assert got == pytest.approx(sums(edges, kind, **more)[0], abs=1e-9), (kind, more)
    got = {(r.src, r.dst): r.value for r in indicators.edge_brandes(df, weight="w").collect()}
    want = sums(edges, "betweenness")[1]
    assert got == pytest.approx({(a, b): want.get((a, b), 0.0) for a, b, _ in edges}, abs=1e-9)
    with pytest.raises(ValueError):
        indicators.brandes(spark.createDataFrame([(1, 2, 0.0)], EDGES), weight="w").count()


def test_weighted_betweenness_query(spark, sf):
    graph = street_graph(spark, sf)
    edges = [(r.src, r.dst, float(r.w)) for r in graph.collect()]
    want, _ = sums(once(edges), "betweenness")
    n = len(want)
    got = {r.id: r.value for r in centrality.betweenness_centrality(graph, weight="w").collect()}
    assert got == pytest.approx({k: v / ((n - 1) * (n - 2)) for k, v in want.items()}, abs=1e-9)


def test_negative_cycles(spark):
    """Short cycles in graphs of 20,000 nodes, negative weights without one, loops."""
    g = random.Random(4)
    n = 20_000
    level = {v: v // 2000 for v in range(n)}  # ten levels: at most nine steps
    rows = [(v, g.randrange((level[v] + 1) * 2000, n), float(g.choice([-5, 3, 4]))) for v in range(18_000) for _ in range(2)]
    df = spark.createDataFrame(rows, EDGES)
    assert not traverse.has_negative_cycle(df)
    back = spark.createDataFrame([(17_999, 18_000, 1.0), (18_000, 19_000, 2.0), (19_000, 17_999, -3.5)], EDGES)
    assert traverse.has_negative_cycle(df.unionByName(back))
    assert not traverse.has_negative_cycle(df.unionByName(back.withColumn("w", F.col("w") + 0.2)))
    assert traverse.has_negative_cycle(spark.createDataFrame([(1, 1, -1.0)], EDGES)) and not traverse.has_negative_cycle(spark.createDataFrame([(1, 1, 1.0)], EDGES))
    small = spark.createDataFrame([(0, 1, 2.0), (1, 2, -4.0), (2, 3, 1.0), (0, 3, -1.0)], EDGES)
    assert {r.node: (r.dist, r.pred) for r in potentials(small).collect()} == {0: (0.0, None), 1: (0.0, None), 2: (-4.0, 1), 3: (-3.0, 2)}
    with pytest.raises(NegativeCycle):
        relax(spark.createDataFrame([(0, 1, 1.0), (1, 2, -2.0), (2, 1, 1.0)], EDGES), spark.range(1)).count()


@pytest.mark.parametrize("shift", [0, -10, -3, -(1 << 62)])
@pytest.mark.parametrize("weighted", [False, True])
def test_mesh_paths_under_shifted_ids(spark, shift, weighted):
    """Paths do not depend on the ids of places, negative ones included."""
    line = [(k, k + 1, 10, 100 + k) for k in range(5)] + [(2, 7, 1, 200), (7, 3, 30, 201), (0, 4, 25, 300)]
    df = spark.createDataFrame([(a + shift, b + shift, w, f) for a, b, w, f in line], "src long, dst long, length int, fid long")
    mesh = spark.createDataFrame([(101,), (102,)], "fid long")
    asked = spark.createDataFrame([(1, shift, 5 + shift), (2, 1 + shift, 3 + shift), (3, 7 + shift, 7 + shift)], "req int, source long, target long")
    got = [(r.req, r.fid) for r in paths.mesh_path(df, mesh, asked, weighted).orderBy("req", "seq").collect()]
    first = [100, 101, 102, 103, 104] if weighted else [300, 104]
    assert got == [(1, f) for f in first] + [(2, 101), (2, 102)]


@pytest.mark.parametrize("shift", [0, -3])
def test_horizon_under_shifted_ids(spark, shift):
    df = spark.createDataFrame([(k + shift, k + 1 + shift) for k in range(6)], "src long, dst long")
    got = {r.id - shift: r.horizon for r in select.horizon(df, spark.createDataFrame([(0 + shift,), (5 + shift,)], "id long"), 2).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 1, 5: 0, 6: 1}


def test_way_paths_of_all_rows(spark, sf):
    """One request per lattice row: the changes of way are fewest, legs stay on their way, and every path is connected."""
    from waygraph.operators import ways as W
    from waygraph.queries import named_ways

    _, e = named_ways(spark, sf)
    e = materialise(e, "e")
    wp = materialise(W.way_places(e), "wp")
    lg = materialise(W.line_graph(wp), "lg")
    asked = materialise(graph_queries.requests(spark, sf), "asked")
    at = [asked.join(wp, F.col(c) == F.col("place")).select("req", "way") for c in ("source", "target")]
    got = paths.way_simplest_paths(e, lg, asked, *at).orderBy("req", "seq").collect()
    edge = {r.fid: r for r in e.collect()}
    by_place, ways_at = {}, {}
    for r in wp.collect():
        ways_at.setdefault(r.place, set()).add(r.way)
        by_place.setdefault(r.way, set()).add(r.place)
    assert asked.count() == len({r.req for r in got}) > 2
    for q in asked.collect():
        here, seen, ways_used = q.source, [], []
        for r in got:
            if r.req == q.req:
                x = edge[r.fid]
                assert here in (x.start_pl, x.end_pl)
                here = x.end_pl if here == x.start_pl else x.start_pl
                seen.append(r.fid)
                ways_used += [x.way] if ways_used[-1:] != [x.way] else []
        assert here == q.target
        front, level, done = set(ways_at[q.source]), 1, set(ways_at[q.source])
        while not front & ways_at[q.target]:
            front = {v for w in front for p in by_place[w] for v in ways_at[p]} - done
            done |= front
            level += 1
        assert len(ways_used) <= level
