"""Registered queries do the whole job: results on sf0.001 against plain Python."""

import numpy as np

from waygraph import graph_queries as G
from waygraph.queries import Q
from waygraph.sources import fixtures as X


def street(spark, sf):
    near = {}
    for r in G.street(spark, sf).collect():
        near.setdefault(r.src, []).append(r.dst)
        near.setdefault(r.dst, []).append(r.src)
    return near


def test_bridges_of_the_street_graph(spark, sf):
    near = street(spark, sf)

    def reached(a, b):
        """Whether b is reached from a without the edge a, b."""
        seen, todo = {a}, [a]
        while todo:
            u = todo.pop()
            for v in near[u]:
                if v not in seen and (u, v) != (a, b):
                    seen.add(v)
                    todo.append(v)
        return b in seen

    want = {(a, b) for a in near for b in near[a] if a < b and (near[a].count(b) == 1) and not reached(a, b)}
    assert {(r.src, r.dst) for r in Q["bridges"](spark, sf).collect()} == want


def test_labels_are_settled(spark, sf):
    near = street(spark, sf)
    label = {r.id: r.label for r in Q["label_propagation"](spark, sf).collect()}
    assert label.keys() == near.keys()
    for u, vs in near.items():
        own = [label[v] for v in vs]
        assert own.count(label[u]) == max(own.count(x) for x in own)


def test_hits_have_converged(spark, sf):
    e = [(r.src, r.dst) for r in X.customer_suppliers(spark, sf).select("src", "dst").collect()]
    ids = {x: i for i, x in enumerate(sorted({x for p in e for x in p}))}
    a = np.zeros((len(ids), len(ids)))
    for x, y in e:
        a[ids[x], ids[y]] += 1

    def first(m):
        v = np.abs(np.linalg.eigh(m)[1][:, -1])
        return v / v.sum()

    h = {r.id: r for r in Q["hits"](spark, sf).collect()}
    for name, want in (("hub", first(a @ a.T)), ("authority", first(a.T @ a))):
        got = np.array([h[x][name] for x in ids])
        assert np.abs(got - want).max() < 1e-8


def test_bench_gives_no_total_of_a_part():
    import bench

    whole = bench.line(dict.fromkeys(bench.QUERIES, 1.0), "x/sf0.1/")
    assert whole["value"] == len(bench.QUERIES) and whole["not_run"] == []
    part = bench.line({"vertices": 1.0}, "sf0.1")
    assert part["value"] is None and part["not_run"] == bench.QUERIES[1:]
