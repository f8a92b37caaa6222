"""Operators against brute force in plain Python on small graphs."""

import heapq
import inspect
import itertools
import struct
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygraph.functions import geom as G
from waygraph.operators import indicators, paths, select
from waygraph.operators.graph import bipartite, centrality, cluster, structure, traverse
from waygraph.plans.kernels import level_sums, symmetric
from waygraph.plans.stages import materialise, path_exists, release


def random_edges(n, m, seed, weights=True):
    g = np.random.default_rng(seed)
    e = {tuple(sorted(map(int, g.choice(n, 2, replace=False)))) for _ in range(m)}
    return [(a, b, int(g.integers(1, 9))) for a, b in sorted(e)]


def frame(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, w double")


def links(edges, directed=False):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {})
        if not directed:
            out[b][a] = w
    return out


def distances(nbr, root):
    dist, heap = {}, [(0, root)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in dist:
            dist[u] = d
            for v, w in nbr[u].items():
                heapq.heappush(heap, (d + w, v))
    return dist


def hops(nbr, root):
    return distances({u: dict.fromkeys(vs, 1) for u, vs in nbr.items()}, root)


def reach_without(nbr, root, edge):
    seen, todo = {root}, deque([root])
    while todo:
        u = todo.popleft()
        for v in nbr[u]:
            if {u, v} != set(edge) and v not in seen:
                seen.add(v)
                todo.append(v)
    return seen


@pytest.fixture(scope="module")
def small():
    return random_edges(24, 40, 3)


@pytest.mark.parametrize("kind", ["betweenness", "stress", "load"])
@pytest.mark.parametrize("block", [10**9, 150])
def test_level_sums_equal_the_broadcast_way(spark, small, kind, block):
    g = frame(spark, small).select("src", "dst")
    want = {r.id: r.value for r in indicators.brandes(g, kind, endpoints=kind == "betweenness").collect()}
    got = {r.id: r.value for r in level_sums(symmetric(g), structure.nodes(g), kind, kind == "betweenness", block_rows=block).collect()}
    assert all(got.get(i, 0.0) == pytest.approx(v) for i, v in want.items()) and got.keys() <= want.keys()


def test_level_sums_of_edges(spark, small):
    g = frame(spark, small).select("src", "dst")
    got = level_sums(symmetric(g), structure.nodes(g), per_edge=True)
    got = {(r.src, r.dst): r.value for r in structure.canonical(got, "value").groupBy("src", "dst").agg(F.sum("value").alias("value")).collect()}
    want = {(r.src, r.dst): r.value for r in indicators.edge_brandes(g).collect()}
    assert got == pytest.approx(want)


def test_sums_beyond_the_broadcast_limit(spark, small, monkeypatch):
    """With no room for an adjacency every measure takes the join way, with equal values."""
    from waygraph.plans import kernels

    g = frame(spark, small).select("src", "dst")
    measures = [lambda: indicators.distance_sums(g), lambda: centrality.load_centrality(g), lambda: centrality.harmonic_centrality(g)]
    want = [sorted(map(tuple, m().collect())) for m in measures]
    monkeypatch.setattr(kernels, "BROADCAST_EDGES", 3)
    got = [sorted(map(tuple, m().collect())) for m in measures]
    for a, b in zip(want, got, strict=True):
        assert [x[0] for x in a] == [x[0] for x in b] and np.allclose(np.array(a, float), np.array(b, float))


def test_weighted_measures(spark, small):
    g, nbr = frame(spark, small), links(small)
    d = {u: distances(nbr, u) for u in nbr}
    n = len(nbr)
    close = {u: (len(x) - 1) / sum(x.values()) * (len(x) - 1) / (n - 1) if sum(x.values()) else 0.0 for u, x in d.items()}
    assert {r.id: r.value for r in centrality.weighted_closeness(g).collect()} == pytest.approx(close)
    assert {r.id: r.value for r in centrality.harmonic_centrality(g, weight="w").collect()} == pytest.approx({u: sum(1 / x for x in v.values() if x) for u, v in d.items()})
    whole = all(len(x) == n for x in d.values())
    assert centrality.wiener_index(g, "w").first().value == pytest.approx(sum(sum(x.values()) for x in d.values()) / 2 if whole else float("inf"))
    assert {(r.src, r.dst): r.dist for r in traverse.floyd_warshall(g).collect()} == {(u, v): float(x) for u, vs in d.items() for v, x in vs.items()}


def test_local_efficiency(spark, small):
    nbr, total = links(small), 0.0
    for vs in nbr.values():
        inner = {u: {v: 1 for v in nbr[u] if v in vs} for u in vs}
        k = len(vs)
        if k > 1:
            total += sum(1 / x for u in inner for x in hops(inner, u).values() if x) / (k * (k - 1))
    assert centrality.local_efficiency(frame(spark, small)).first().value == pytest.approx(total / len(nbr))


def test_bridges_and_spans(spark):
    edges = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 0, 1), (3, 4, 1), (4, 5, 1), (5, 6, 1), (6, 4, 1), (6, 7, 1)]
    g, nbr = frame(spark, edges).select("src", "dst"), links(edges)
    spans = {}
    for a, b, _ in edges:
        if not nbr[a].keys() & nbr[b].keys():
            rest = {u: {v: 1 for v in vs if {u, v} != {a, b}} for u, vs in nbr.items()}
            spans[a, b] = hops(rest, a).get(b)
    assert {(r.src, r.dst): r.span for r in traverse.bridge_spans(g).collect()} == {tuple(sorted(k)): v for k, v in spans.items()}
    cut = [(a, b) for a, b, _ in edges if b not in reach_without(nbr, a, (a, b))]
    assert sorted((r.src, r.dst) for r in traverse.bridges(g).collect()) == sorted(tuple(sorted(x)) for x in cut)
    blocks = {u: min(v for v in nbr if v in _without(nbr, u, cut)) for u in nbr}
    assert {r.id: r.component for r in traverse.bridge_components(g).collect()} == blocks


def _without(nbr, root, cut):
    gone = {frozenset(x) for x in cut}
    return hops({u: {v: 1 for v in vs if frozenset((u, v)) not in gone} for u, vs in nbr.items()}, root).keys()


def test_cliques_of_any_size(spark):
    """All maximal cliques by brute force, one of 15 nodes among them, and a hub with many neighbours."""
    edges = [(a, b, 1) for a, b in itertools.combinations(range(15), 2)] + [(3, 20, 1), (20, 21, 1), (21, 3, 1), (30, 31, 1)] + [(50, k, 1) for k in range(51, 90)] + [(51, 52, 1), (52, 53, 1), (51, 53, 1)]
    nbr = links(edges)

    def grow(chosen, may, done):
        if not may and not done:
            yield tuple(sorted(chosen))
        for v in sorted(may):
            yield from grow([*chosen, v], may & nbr[v].keys(), done & nbr[v].keys())
            may, done = may - {v}, done | {v}

    got = sorted(tuple(r.members) for r in cluster.maximal_cliques(frame(spark, edges)).collect())
    assert tuple(range(15)) in got and (3, 20, 21) in got and (30, 31) in got and (50, 51, 52, 53) in got and (50, 60) in got
    assert len(got) == 4 + 36
    other = random_edges(16, 60, 9)
    nbr = links(other)
    assert sorted(tuple(r.members) for r in cluster.maximal_cliques(frame(spark, other)).collect()) == sorted(grow([], set(nbr), set()))


def test_sets_and_labels(spark, small):
    g, nbr = frame(spark, small).select("src", "dst"), links(small)
    chosen = {r.id for r in traverse.independent_set(g).collect()}
    assert all(not (nbr[u].keys() & chosen) for u in chosen) and all(u in chosen or nbr[u].keys() & chosen for u in nbr)
    label = {r.id: r.label for r in cluster.label_propagation(g).collect()}
    for u, vs in nbr.items():
        if vs:
            n = Counter(label[v] for v in vs)
            assert n[label[u]] == max(n.values())
    cover = structure.canonical(g)
    assert traverse.is_edge_cover(g, cover).first().value and not traverse.is_edge_cover(g, cover.limit(1)).first().value


def test_edge_swaps_keep_degrees(spark, small):
    g = frame(spark, small).select("src", "dst")
    out = [(r.src, r.dst) for r in traverse.edge_swap(g, 4).collect()]
    assert len(set(out)) == len(small) and all(a < b for a, b in out)
    assert Counter(x for e in out for x in e) == Counter(x for a, b, _ in small for x in (a, b))


def test_girvan_newman_and_samples(spark):
    edges = [(a, b, 1) for k in (0, 10) for a, b in itertools.combinations(range(k, k + 4), 2)] + [(0, 10, 1)]
    g = frame(spark, edges).select("src", "dst")
    assert {(r.id, r.component) for r in cluster.girvan_newman(g).collect()} == {(i, i // 10 * 10) for i in (0, 1, 2, 3, 10, 11, 12, 13)}
    share = cluster.sampled_clustering(g, 1000).first().value
    assert 0.5 <= share <= 1.0


def test_dag_operators(spark):
    edges = [(a, b, w) for a, b, w in random_edges(16, 34, 5)]
    g, nbr = frame(spark, edges), links(edges, True)
    best = {}
    for u in sorted(nbr, reverse=True):
        best[u] = max((w + best[v] for v, w in nbr[u].items()), default=0)
    assert traverse.dag_longest_path_length(g, "w").first().value == max(best.values())
    path = traverse.dag_longest_path(g, "w").first().path
    assert sum(nbr[a][b] for a, b in zip(path, path[1:], strict=False)) == max(best.values())
    above = {u: {v for v in nbr if u in hops(nbr, v)} for u in nbr}
    pairs = [(a, b) for a in nbr for b in nbr if a < b and above[a] & above[b]][:30]
    level = {r.id: r.level for r in traverse.topological_levels(g).collect()}
    got = {(r.u, r.v): r.ancestor for r in traverse.lowest_common_ancestors(g.select("src", "dst"), spark.createDataFrame(pairs, "u long, v long")).collect()}
    for a, b in pairs:
        both = above[a] & above[b]
        low = [x for x in both if not any(x != y and x in above[y] for y in both)]
        assert got[a, b] == min(low, key=lambda x: (-level[x], x))
    assert traverse.is_semiconnected(frame(spark, [(0, 1, 1), (1, 2, 1)]).select("src", "dst")) and not traverse.is_semiconnected(frame(spark, [(0, 1, 1), (0, 2, 1)]).select("src", "dst"))


def test_terminals_and_goals(spark, small):
    g, nbr = frame(spark, small), links(small)
    part = sorted(max((hops(nbr, u).keys() for u in nbr), key=len))
    ends = [part[0], part[len(part) // 2], part[-1]]
    tree = [(r.src, r.dst) for r in traverse.steiner_tree(g, spark.createDataFrame([(x,) for x in ends], "id long")).collect()]
    joined = links([(a, b, 1) for a, b in tree])
    assert all(b in nbr[a] for a, b in tree) and set(ends) <= hops(joined, ends[0]).keys()
    closure = sum(sorted(distances(nbr, a)[b] for a, b in itertools.combinations(ends, 2))[:2])
    assert sum(nbr[a][b] for a, b in tree) <= closure
    far = distances(nbr, ends[0])
    bound = spark.createDataFrame([(u, float(distances(nbr, u).get(ends[2], 0)) / 2) for u in nbr], "id long, h double")
    assert traverse.astar_path_length(g, ends[0], ends[2], bound).first().value == far[ends[2]]
    assert traverse.has_path(g, ends[0], ends[2]).first().value


def test_facts(spark):
    ring = frame(spark, [(i, (i + 1) % 5, 1) for i in range(5)]).select("src", "dst")
    assert traverse.is_eulerian(ring, True).first().value and traverse.intersection_array(ring).filter("not regular").count() == 0
    t = traverse.tournament_facts(frame(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 1)]).select("src", "dst")).first()
    assert t.is_tournament and t.scores == [0, 1, 2]
    assert traverse.could_be_isomorphic(ring, structure.relabel(ring, spark.createDataFrame([(0, 9)], "old long, new long")))
    assert not traverse.could_be_isomorphic(ring, ring.filter("src <> 0"))
    assert traverse.tree_facts(ring.filter("src <> 4")).first().tree and not traverse.tree_facts(ring).first().forest
    assert structure.chain(spark.createDataFrame([(3, 7), (1, 5), (2, 6)], "seq long, id long"), "cycle").count() == 3
    assert bipartite.is_node_set(frame(spark, [(0, 1, 1)]).select("src", "dst"), spark.createDataFrame([(0,)], "id long")).first().value


def test_binary_geometry(spark):
    def wkb(kind, rows, order="<", head=b""):
        return struct.pack(order + "BI", 1 if order == "<" else 0, kind) + head + struct.pack(order + "I", len(rows)) + b"".join(struct.pack(f"{order}{len(r)}d", *r) for r in rows)

    flat, z = wkb(2, [(1, 2), (3, 4)]), wkb(1002, [(1, 2, 9), (3, 4, 9)], ">")
    ewkb = wkb(2 | 0x20000000 | 0x80000000, [(1, 2, 9), (3, 4, 9)], "<", struct.pack("<I", 2154))
    multi = struct.pack("<BII", 1, 5, 2) + flat + z
    point = struct.pack("<BIdd", 1, 1, 5, 6)
    rows = spark.createDataFrame([(k, b) for k, b in enumerate([flat, z, ewkb, multi, point, None])], "k int, b binary")
    got = {r.k: r.g for r in rows.select("k", G.parse_wkb_lines()("b").alias("g")).collect()}
    line = [(1.0, 2.0), (3.0, 4.0)]
    assert [[[tuple(p) for p in part] for part in got[k]] for k in range(4)] == [[line], [line], [line], [line, line]] and got[4] is None and got[5] is None
    ring = spark.createDataFrame([("SRID=4;POLYGON Z ((0 0 1, 2 0 1, 2 1 1, 0 0 1), (1 1 1))",), ("POINT (1 1)",)], "t string").select(G.parse_wkt_ring("t").alias("r")).collect()
    assert [tuple(p) for p in ring[0].r] == [(0, 0), (2, 0), (2, 1), (0, 0)] and ring[1].r is None


def test_walkers_have_no_limit_on_steps(spark):
    """The last pieces of a straight street are walked to its end, and no parameter bounds the steps."""
    n = 520
    e = spark.range(n).select(F.col("id").alias("fid"), F.col("id").alias("start_pl"), (F.col("id") + 1).alias("end_pl"), F.array(G.point(F.col("id"), 0.0), G.point(F.col("id") + 1, 0.0)).alias("geom"))
    p = spark.range(n + 1).select(F.col("id").alias("place"), G.point(F.col("id"), 0.0).alias("pt"), F.when((F.col("id") == 0) | (F.col("id") == n), 1).otherwise(2).alias("degree"))
    ask = spark.createDataFrame([(1, n - 8, n)], "req int, source long, target long")
    assert paths.azimuth_path(e, p, ask).count() == 8 and "rounds" not in inspect.signature(paths.azimuth_path).parameters


def test_released_stages_are_gone(spark):
    a = materialise(spark.range(3).toDF("id"), "gone")
    path = a._stage
    assert path_exists(spark, path)
    release(a, None, spark.range(1))
    assert not path_exists(spark, path)


def test_closest_features(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0)]), (2, [(0.0, 5.0), (10.0, 5.0)])], "k long, g array<struct<x:double,y:double>>").toDF("fid", "geom")
    pts = spark.createDataFrame([(7, (3.0, 1.0)), (8, (3.0, 4.5)), (9, (50.0, 50.0))], "pid long, pt struct<x:double,y:double>")
    assert sorted(map(tuple, select.closest_features(pts, lines, 4.0, "fid").collect())) == [(7, 1, 1.0), (8, 2, 0.5)]
