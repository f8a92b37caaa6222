"""Work that must not grow beyond the tables: small cases of what failed on large ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygraph.functions import geom as G
from waygraph.operators import diff, paths
from waygraph.operators.graph import bipartite, traverse
from waygraph import overlay_queries  # noqa: F401  registers its queries
from waygraph.plans import kernels
from waygraph.queries import Q
from waygraph.sources import io


def test_lines_do_not_carry_their_row(spark):
    """Exploded lines take the number of parts along, not all lines of their row."""
    line = F.array(G.point(0.0, 0.0), G.point(F.col("id").cast("double"), 1.0))
    rows = spark.range(1, 40).withColumn("geom", line).groupBy((F.col("id") % 2).alias("key")).agg(F.collect_list("geom").alias("lines"))
    out = io.segments_from(rows, "lines", "key", "key", "multi")
    assert out.count() == 39 and {r.fid for r in out.collect()} == {*range(20 - 1)} | {1000 + k for k in range(20)}
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]
    assert "size(parts" not in above and "size(lines" not in above


def test_shallow_closure_is_joined(spark, monkeypatch):
    """A graph of few levels is not searched node by node; a deep one, and cycles, give the same rows."""
    rng = random.Random(5)
    rows = {(rng.randint(0, 40), rng.randint(41, 60)) for _ in range(150)} | {(rng.randint(41, 60), rng.randint(61, 64)) for _ in range(40)}
    far = {(a, d) for a, b in rows for c, d in rows if b == c}
    monkeypatch.setattr(traverse, "search", lambda *a: pytest.fail("searched"))
    assert {tuple(r) for r in traverse.transitive_closure(spark.createDataFrame(list(rows), "src long, dst long")).collect()} == rows | far
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (4, 4)], "src long, dst long")
    assert {tuple(r) for r in traverse.transitive_closure(ring).collect()} == {(a, b) for a in (0, 1, 2) for b in (0, 1, 2, 3)} | {(4, 4)}
    monkeypatch.undo()
    path = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {tuple(r) for r in traverse.transitive_closure(path).collect()} == {(a, b) for a in range(30) for b in range(a + 1, 31)}


def reduced(rows):
    """Edges of a DAG that no longer path implies, by search."""
    to = {}
    for a, b in rows:
        to.setdefault(a, set()).add(b)

    def below(a):
        seen, todo = set(), list(to.get(a, ()))
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += to.get(v, ())
        return seen

    return {(a, b) for a, b in rows if not any(b in below(m) for m in to[a] if m != b)}


@pytest.mark.parametrize("sign", [1, -1])
def test_reduction_lists_no_closure(spark, monkeypatch, sign):
    """Edges along rising (or falling) ids are decided in blocks, or by searches that end at their farthest target."""
    rng = random.Random(7)
    rows = [(v, v + s) for v in range(300) for s in (1, 9, 10, 11) if rng.random() < 0.6]
    want = {(sign * a, sign * b) for a, b in reduced(rows)}
    e = spark.createDataFrame([(sign * a, sign * b) for a, b in rows], "src long, dst long")
    monkeypatch.setattr(traverse, "transitive_closure", lambda e: pytest.fail("closure"))
    monkeypatch.setattr(kernels, "BLOCK_EDGES", 100)
    assert {tuple(r) for r in traverse.transitive_reduction(e).collect()} == want
    assert {tuple(r) for r in e.join(traverse._implied(e, sign), ["src", "dst"], "left_anti").collect()} == want
    wide = [*rows, (0, 310), (0, 299), (290, 310)]
    e = spark.createDataFrame([(sign * a, sign * b) for a, b in wide], "src long, dst long")
    assert {tuple(r) for r in traverse.transitive_reduction(e).collect()} == {(sign * a, sign * b) for a, b in reduced(wide)}


def test_redundancy_counts_pairs_in_bits(spark, monkeypatch):
    """Top nodes of up to 150 neighbours: no list of pairs is written, and shares equal those of all pairs."""
    rng = random.Random(11)
    rows = {(u, 1000 + rng.randrange(200)) for u in range(12) for _ in range(rng.choice((2, 5, 40, 300)))} | {(50, 5000), (51, 5001), (51, 5002)}
    near = {}
    for u, p in rows:
        near.setdefault(u, set()).add(p)
    want = {}
    for u, ps in near.items():
        pairs = [(p, q) for p in ps for q in ps if p < q]
        if pairs:
            want[u] = sum(any({p, q} <= near[w] for w in near if w != u) for p, q in pairs) / len(pairs)
    write = bipartite.materialise
    monkeypatch.setattr(bipartite, "materialise", lambda df, name: pytest.fail("pairs are listed") if name == "pairs" else write(df, name))
    e = spark.createDataFrame(list(rows), "src long, dst long")
    assert {r.id: r.value for r in bipartite.node_redundancy(e).collect()} == want
    monkeypatch.undo()
    monkeypatch.setattr(bipartite, "TWO_STEPS", 0)
    assert {r.id: r.value for r in bipartite.node_redundancy(e).collect()} == want


def test_way_searches_end_at_the_nearest_target(spark, sf, monkeypatch):
    """No search goes over all ways, and the paths are those of whole searches."""
    whole = {tuple(r) for r in Q["way_simplest_paths"](spark, sf).collect()}  # fewer than MANY_SOURCES requests
    monkeypatch.setattr(kernels, "MANY_SOURCES", 1)
    monkeypatch.setattr(paths, "relax", lambda *a: pytest.fail("all ways are searched"))
    assert whole and {tuple(r) for r in Q["way_simplest_paths"](spark, sf).collect()} == whole


def test_lost_access_lists_no_pairs(spark, monkeypatch):
    """Sums of hops times length to some ways; null if none is reached, 0 for a way that only reaches itself."""
    monkeypatch.setattr(diff, "search", lambda *a: pytest.fail("pairs are listed"), raising=False)
    g = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "src long, dst long")
    roots = spark.createDataFrame([(1,), (3,), (7,), (9,), (10,)], "way long")
    gone = spark.createDataFrame([(2, 2.0), (2, 3.0), (4, 1.5), (9, 7.0)], "way long, length double")
    assert {tuple(r) for r in diff._lost(g, roots, gone, "removed").collect()} == {(1, 5.0 + 4.5), (3, 5.0 + 1.5), (9, 0.0)}


def test_bridges_are_found_in_blocks(spark, monkeypatch):
    """Lattices with gaps, chains, twigs and twins over several blocks: no round for each level, and rows of plain search."""
    monkeypatch.setattr(traverse, "_bridges_by_levels", lambda *a: pytest.fail("level by level"))
    monkeypatch.setattr(kernels, "BLOCK_EDGES", 60)
    rng = random.Random(2)
    rows = [(v, v + s) for v in range(400) for s in (1, 8) if rng.random() < 0.8]
    rows += [(700 + k, 701 + k) for k in range(150)] + [(700, 0), (790, 950), (950, 951), (800, 801)] + [(1000 + k, 1001 + k) for k in range(90)] + [(1090, 1000)]
    e = spark.createDataFrame(rows, "src long, dst long")
    cut, _ = traverse._two_connected(np.array([a for a, _ in rows]), np.array([b for _, b in rows]), 1100)
    want = {tuple(sorted(r)) for r, c in zip(rows, cut, strict=True) if c}
    for a, b in rng.sample(sorted(want), 5) + rng.sample(sorted({tuple(sorted(r)) for r in rows} - want), 5):  # the plain search itself
        near, seen, todo = {}, {a}, [a]
        skip = (a, b) in want or sum(tuple(sorted(r)) == (a, b) for r in rows) == 1
        for x, y in rows:
            if not (skip and {x, y} == {a, b}):
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (b not in seen) == ((a, b) in want)
    assert {tuple(r) for r in traverse.bridges(e).collect()} == want and len(want) > 100
    monkeypatch.undo()
    rows_ = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (F.least("src", "dst") * 10000 + F.greatest("src", "dst")).alias("key"))
    few = rows_.filter("src < 40 or src > 1080")
    level = {r.key for r in traverse._bridges_by_levels(few, 0).collect()}
    assert level == {a * 10000 + b for a, b in ((r.src, r.dst) for r in traverse.bridges(few).collect())}


def test_spans_of_bridges_are_not_searched(spark, monkeypatch):
    """A twig on a ring: its search would pass all nodes, the others end within the ring."""
    seen = []
    write = traverse.materialise
    monkeypatch.setattr(traverse, "materialise", lambda df, name: seen.append(name) or write(df, name))
    g = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), *[(k, k + 1) for k in range(4, 40)]], "src long, dst long")
    spans = {(r.src, r.dst): r.span for r in traverse.bridge_spans(g).collect()}
    assert spans == {(0, 1): 3, (1, 2): 3, (2, 3): 3, (0, 3): 3, **{(k, k + 1): None for k in range(3, 40)}}
    assert seen.count("span") <= 10


def test_terminals_are_searched_together(spark, monkeypatch):
    """Distances between terminals without rows of all other nodes, by sweeps or one by one; parts that do not meet stay apart."""
    rng = random.Random(4)
    rows = [(v, v + s, float(rng.randint(1, 9))) for v in range(200) for s in (1, 9) if rng.random() < 0.8] + [(500, 501, 2.0)]
    e = spark.createDataFrame(rows, "src long, dst long, w double")
    ids = spark.createDataFrame([(k,) for k in [*range(0, 200, 9), 500, 501, 900]], "id long")
    whole = {tuple(r) for r in traverse.weighted_distances(e, ids).join(ids.withColumnRenamed("id", "node"), "node", "left_semi").filter("root < node").select("root", "node", "dist").collect()}
    monkeypatch.setattr(traverse, "weighted_distances", lambda *a: pytest.fail("all nodes are listed"))
    assert {tuple(r) for r in traverse.metric_closure(e, ids).collect()} == whole and (500, 501, 2.0) in whole
    starts, nbr, w = np.array([0, 0, 1, 2]), np.array([0, 1]), np.array([1.0, 2.0])
    assert kernels._swept(starts, nbr, w, np.array([0, 2])).T.tolist() == [[0, 1, 3], [np.inf, np.inf, 0]]
    monkeypatch.setattr(kernels, "VISITS", 0)
    assert kernels._swept(starts, nbr, w, np.array([0])) is None
