"""Golden numbers on small graphs, geometry, and equality of search strategies."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygraph.functions import geom as G
from waygraph.operators import indicators, sanitize, ways
from waygraph.operators.components import connected_components
from waygraph.operators.graph import bipartite, centrality, cluster, structure, traverse
from waygraph.plans.kernels import search, symmetric
from waygraph.sources import io


# Small graphs and the results that must be met on them.


def graph(spark, edges):
    return structure.path_graph(spark, edges)


def values(df, key="id", value="value", digits=3):
    return {r[key]: round(r[value], digits) for r in df.collect()}


K5 = [(i, j) for i in range(5) for j in range(i + 1, 5)]
KITE = [(0, 1), (0, 2), (0, 3), (0, 5), (1, 3), (1, 4), (1, 6), (2, 3), (2, 5), (3, 4), (3, 5), (3, 6), (4, 6), (5, 6), (5, 7), (6, 7), (7, 8), (8, 9)]


def test_centrality_golden(spark):
    k5, p3, kite = graph(spark, K5), graph(spark, [(0, 1), (1, 2)]), graph(spark, KITE)
    assert set(values(indicators.betweenness(k5), value="betwee").values()) == {0.0}
    assert values(indicators.betweenness(p3), value="betwee") == {0: 0, 1: 1, 2: 0}
    assert values(centrality.closeness_centrality(p3)) == {0: 0.667, 1: 1.0, 2: 0.667}
    b = values(indicators.betweenness(kite), value="betwee")
    assert [b[i] for i in range(10)] == [0.833, 0.833, 0.0, 3.667, 0.0, 8.333, 8.333, 14.0, 8.0, 0.0]
    c = values(centrality.closeness_centrality(kite))
    assert [c[i] for i in range(10)] == [0.529, 0.529, 0.5, 0.6, 0.5, 0.643, 0.643, 0.6, 0.429, 0.31]
    assert values(indicators.stress(p3), value="use") == {0: 0, 1: 1, 2: 0}
    assert values(centrality.load_centrality(p3, False)) == {0: 0, 1: 2.0, 2: 0}


def test_pagerank_golden(spark):
    g = graph(spark, [(1, 2), (1, 3), (3, 1), (3, 2), (3, 5), (4, 5), (4, 6), (5, 4), (5, 6), (6, 4)])
    r = values(centrality.pagerank(g, 0.9, tol=1e-8), digits=5)
    assert r == {1: 0.03721, 2: 0.05396, 3: 0.04151, 4: 0.37508, 5: 0.20600, 6: 0.28625}


def test_line_graphs(spark):
    for edges, n in (([(0, i) for i in range(1, 6)], 10), ([(i, i + 1) for i in range(4)], 3), ([(i, (i + 1) % 5) for i in range(5)], 5)):
        assert structure.line_graph(structure.canonical(graph(spark, edges))).count() == n


def test_weighted_paths(spark):
    xg = spark.createDataFrame([(0, 1, 10.0), (0, 3, 5.0), (1, 2, 1.0), (1, 3, 2.0), (2, 4, 1.0), (3, 1, 3.0), (3, 2, 5.0), (3, 4, 2.0), (4, 0, 7.0), (4, 2, 6.0)], "src long, dst long, w double")
    d = traverse.weighted_distances(xg, spark.range(1), directed=True)
    assert {r.node: r.dist for r in d.collect()}[2] == 9.0
    assert {r.node: r.path for r in traverse.paths(d).collect()}[2] == [0, 3, 1, 2]
    assert not traverse.has_negative_cycle(xg)
    bad = xg.unionByName(spark.createDataFrame([(2, 0, -20.0)], "src long, dst long, w double"))
    assert traverse.has_negative_cycle(bad)


def random_graph(n, m, seed):
    g = np.random.default_rng(seed)
    return sorted({tuple(sorted(x)) for x in g.integers(0, n, (m, 2)).tolist() if x[0] != x[1]})


@pytest.mark.parametrize("seed", [1, 2])
def test_search_strategies_agree(spark, seed):
    e = graph(spark, random_graph(30, 35, seed))
    for g in (e, symmetric(e)):
        assert sorted(map(tuple, search(g, broadcast=True).collect())) == sorted(map(tuple, search(g, broadcast=False).collect()))


def test_frontiers_of_many_short_jobs(spark, monkeypatch):
    """Long paths through jobs of two levels, so that written levels are merged on the way, and through jobs of one."""
    from waygraph.plans import kernels

    monkeypatch.setattr(kernels, "HOPS", 2)
    g = graph(spark, [(k, k + 1) for k in range(21)] + [(0, 3)])
    want = {(0, 0, 0), (0, 1, 1), (0, 2, 2)} | {(0, k, k - 2) for k in range(3, 22)}
    assert set(map(tuple, kernels.search(g, spark.range(1)).collect())) == want
    assert set(map(tuple, kernels.search(g, spark.range(1), 5).collect())) == {r for r in want if r[2] <= 5}
    assert set(map(tuple, kernels.search(g, spark.range(50, 51)).collect())) == {(50, 50, 0)}
    monkeypatch.setattr(kernels, "SMALL_FRONT", 0)
    w = g.filter("src < 6").selectExpr("src", "dst", "cast(if(dst = src + 1, 1, 4) as double) w")
    got = {r.node: (r.dist, r.pred) for r in kernels.relax(w, spark.range(1)).collect()}
    assert got == {0: (0.0, None), **{k: (float(k), k - 1) for k in range(1, 7)}}


def test_relaxations_agree(spark):
    from waygraph.plans.kernels import relax

    e = random_graph(25, 60, 5)
    w = spark.createDataFrame([(a, b, float((a * 7 + b * 3) % 5 + 1)) for a, b in e], "src long, dst long, w double")
    g = symmetric(w, "src", "dst", "w")
    assert sorted(map(str, relax(g, spark.range(25)).collect())) == sorted(map(str, relax(g, spark.range(25), broadcast=False).collect()))


@pytest.mark.parametrize("name", ["bigint", "string"])
def test_components_alike_in_rounds_and_in_one_task(spark, name):
    e = spark.createDataFrame([(a, b) for a, b in random_graph(80, 70, 4)] + [(5, 5), (None, 3), (900, None)], "src long, dst long").selectExpr(f"cast(src as {name}) src", f"cast(dst as {name}) dst")
    v = spark.range(100).selectExpr(f"cast(id as {name}) id")
    one, rounds = (sorted(map(tuple, connected_components(e, vertices=v, task_edges=n).collect())) for n in (200_000, 0))
    assert one == rounds and len(one) == 100


def test_components_and_cores(spark):
    edges = random_graph(60, 50, 3)
    up = list(range(60))

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(graph(spark, edges), vertices=spark.range(60)).collect()}
    assert got == {i: top(i) for i in range(60)}
    core = {r.id: r.core for r in cluster.core_number(graph(spark, K5 + [(4, 5), (5, 6)])).collect()}
    assert core == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 5: 1, 6: 1}


def test_loops_on_small_graphs(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (6, 7)])
    assert sorted(map(tuple, traverse.bridges(g).collect())) == [(2, 3), (6, 7)]
    assert sorted(map(tuple, traverse.strong_components(g).collect())) == sorted(map(tuple, traverse.strong_components(g, task_edges=0).collect()))
    scc = {r.id: r.component for r in traverse.strong_components(g).collect()}
    assert scc == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    color = {r.id: r.color for r in traverse.greedy_color(g).collect()}
    assert all(color[a] != color[b] for a, b in [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (6, 7)])
    m = traverse.maximal_matching(g)
    assert tuple(traverse.matching_facts(g, m).first()) == (True, True)
    assert traverse.is_dag(graph(spark, [(0, 1), (1, 2), (0, 2)])) and not traverse.is_dag(g)
    assert sorted(map(tuple, traverse.transitive_reduction(graph(spark, [(0, 1), (1, 2), (0, 2)])).collect())) == [(0, 1), (1, 2)]
    assert not bipartite.is_bipartite(g) and bipartite.is_bipartite(graph(spark, [(0, 1), (1, 2), (2, 3), (3, 0)]))
    w = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (2, 3, 1.0)], "src long, dst long, w double")
    assert sorted((r.src, r.dst) for r in traverse.spanning_forest(w).collect()) == [(0, 1), (1, 2), (2, 3)]


def test_triads(spark):
    r = {x.type: x.n for x in cluster.triadic_census(graph(spark, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 3)])).collect()}
    assert sum(r.values()) == 10 and r["030C"] == 1 and r["102"] == 3 and r["012"] == 6


def line(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def test_geometry(spark):
    df = spark.createDataFrame([(1, line((0, 0), (3, 4), (3, 10)))], f"fid long, geom {G.LINE}")
    r = df.select(G.length("geom").alias("l"), G.interpolate(F.col("geom"), 0.5).alias("m"), G.locate(F.col("geom"), G.point(3, 7)).alias("t"), G.substring(F.col("geom"), 0.0, 0.5).alias("s"), G.line_distance(G.point(5, 7), F.col("geom")).alias("d")).first()
    assert (r.l, round(r.m.y, 6), round(r.t, 6), r.d) == (11.0, 4.5, round(8 / 11, 6), 2.0) and len(r.s) == 3
    ring = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)
    parts = G.clip_outside(np.array([(-2.0, 2.0), (6.0, 2.0)]), ring)
    assert sum(np.linalg.norm(np.diff(p, axis=0), axis=1).sum() for p in parts) == 4.0 and len(parts) == 2
    assert len(G.hull_points(np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)], float))) == 5
    assert len(G.merge_lines([np.array([(0.0, 0), (1, 0)]), np.array([(2.0, 0), (1, 0)]), np.array([(5.0, 5), (6, 6)])])) == 2


def test_sanitize_cross(spark):
    """Two crossing streets become four edges around one vertex; a loose line goes."""
    rows = [(1, "a", line((0, 50), (100, 50))), (2, "b", line((50, 0), (50, 100))), (3, "c", line((900, 900), (950, 950)))]
    out = sanitize.sanitize(spark.createDataFrame(rows, f"fid long, name string, geom {G.LINE}")).collect()
    assert len(out) == 4 and all(math.isclose(abs(r.geom[0].x - r.geom[-1].x) + abs(r.geom[0].y - r.geom[-1].y), 50, abs_tol=0.01) for r in out)


def test_classes_formula(spark):
    g = np.random.default_rng(0)
    rows = [(int(i), float(g.integers(0, 9)), float(x)) for i, x in enumerate(g.exponential(5, 80))]
    got = {r.fid: r["class"] for r in ways.lengths_by_class(spark.createDataFrame(rows, "fid long, a double, length double"), "a", 7).collect()}
    total, cls, run, want = sum(r[2] for r in rows), 0, 0.0, {}
    for fid, _, x in sorted(rows, key=lambda r: (r[1], r[0])):
        if run >= (cls + 1) * total / 7:
            cls += 1
        want[fid] = cls
        run += x
    assert got == want


def test_edge_list_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", 1.5), ("b", "c", 2.0)], "src string, dst string, w double")
    io.write_edge_list(e, str(tmp_path / "e"))
    assert sorted(map(tuple, io.read_edge_list(spark, str(tmp_path / "e"), data=[("w", "double")]).collect())) == [("a", "b", 1.5), ("b", "c", 2.0)]
    io.write_adjacency_list(e, str(tmp_path / "a"))
    assert io.read_adjacency_list(spark, str(tmp_path / "a")).count() == 2
    v, back = io.from_node_link(io.node_link(e, structure.nodes(e)), "id string", "source string, target string, w double")
    assert v.count() == 3 and back.count() == 2
    assert io.from_adjacency_json(io.adjacency_json(e), "dst string, w double").count() == 2
    seg = spark.createDataFrame([(7, "LINESTRING (0 0, 500 0)")], "id long, wkt string")
    assert io.check_layer(io.segments_from(seg, "wkt", "id", format="wkt")).first().fid == 7
