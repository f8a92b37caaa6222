"""Searches of deep graphs: blocks of nodes against joins of a frontier, many roots at a time against one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygraph.operators.graph import traverse
from waygraph.plans import kernels
from waygraph.plans.kernels import relax, search, search_on, symmetric


def lattice(rows, width, seed=3):
    """Edges ``(src, dst, w)`` of a long lattice with gaps."""
    rng = random.Random(seed)
    near = [(v, v + s) for v in range(rows * width) for s in (1, width) if v + s < rows * width and (s > 1 or v % width < width - 1)]
    return [(a, b, float(rng.randint(1, 9))) for a, b in near if rng.random() < 0.8]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK_EDGES", 300)


def test_deep_search_takes_few_rounds(spark, small_blocks, monkeypatch):
    """A path of 900 nodes in some 7 blocks: the rounds are those of the blocks, not of the steps."""
    seen = []
    write = kernels.materialise
    monkeypatch.setattr(kernels, "materialise", lambda df, name, *a: seen.append(name) or write(df, name, *a))
    e = spark.range(899).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    d = {r.node: r.dist for r in search(symmetric(e), spark.range(1)).collect()}
    assert d == {v: v for v in range(900)}
    assert len(seen) < 30  # eight levels a job would be 113


def test_blocks_equal_frontiers(spark, small_blocks):
    rows = lattice(20, 8)
    e = spark.createDataFrame(rows, "src long, dst long, w double")
    first = spark.createDataFrame([(r, r, 0) for r in (0, 90, 5000)], "root long, node long, dist int")
    both = symmetric(e).distinct()
    want = {tuple(r) for r in search_on(both, first).collect()}
    assert {tuple(r) for r in search(both, first.select(F.col("root").alias("id"))).select("root", "node", "dist").collect()} == want
    assert {tuple(r) for r in search(both, first.select(F.col("root").alias("id")), 20).collect()} == {r for r in want if r[2] <= 20}
    w = symmetric(e, "src", "dst", "w")
    few = first.filter("root < 1000").select(F.col("root").alias("id"))
    assert {tuple(r) for r in relax(w, few).collect()} == {tuple(r) for r in relax(w, few, broadcast=True).collect()}


def test_nearest_source_by_one_label(spark, small_blocks):
    """Ties go to the least source, also where their ways meet in another block."""
    e = spark.createDataFrame(lattice(20, 8), "src long, dst long, w double")
    ids = spark.createDataFrame([(i,) for i in range(0, 160, 16)], "id long")
    d = relax(symmetric(e, "src", "dst", "w"), ids, broadcast=True).collect()
    want = {}
    for r in d:
        want[r.node] = min(want.get(r.node, (1e9, 0)), (r.dist, r.root))
    assert {r.id: (r.dist, r.source) for r in traverse.nearest_source(e, ids).collect()} == want


def test_routes_end_at_their_targets(spark, monkeypatch):
    """Paths to given targets equal those of whole searches; no whole search is made."""
    e = spark.createDataFrame(lattice(20, 8), "src long, dst long, w double")
    w = symmetric(e, "src", "dst", "w")
    want = spark.createDataFrame([(i, (i + 37) % 160) for i in range(0, 160, 5)] + [(999, 999), (0, 998)], "root long, node long")
    d = relax(w, want.select(F.col("root").alias("id")).distinct(), broadcast=True)
    whole = {tuple(r)[:2] + (tuple(r.path),) for r in traverse.paths(d, want).select("root", "node", "path").collect()}
    got = {tuple(r)[:2] + (tuple(r.path),) for r in kernels.routes(w, want).collect()}
    assert got == whole
    assert kernels.routes(w, want.filter("root < 20")) is None


def test_all_paths_by_doubling(spark):
    """Paths of 700 nodes in few rounds."""
    d = spark.range(700).select(F.lit(0).cast("long").alias("root"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("pred"))
    assert all(r.path == list(range(r.node + 1)) for r in traverse.paths(d).collect())


def test_strong_components_in_blocks(spark, small_blocks):
    """Components drawn together in blocks first, then over all: equal to one task's."""
    rng = random.Random(5)
    rows = [(a, b) if rng.random() < 0.5 else (b, a) for a, b, _ in lattice(60, 8, 9)] + [(i, i + 1) for i in range(1000, 1040)]
    rows += [(b, a) for a, b in rows[:300]]
    e = spark.createDataFrame(rows, "src long, dst long")
    want = {r.id: r.component for r in traverse.strong_components(e).collect()}
    assert {r.id: r.component for r in traverse.strong_components(e, task_edges=len(set(rows)) - 1).collect()} == want


def test_many_roots_at_a_time():
    """Waves and bit rows against one search at a time; numbers of paths beyond doubles keep their ratios."""
    rows = lattice(30, 6, 2)
    s = np.array([a for a, b, _ in rows] + [b for a, b, _ in rows])
    d = np.array([b for a, b, _ in rows] + [a for a, b, _ in rows])
    ids = np.unique(s)
    s, d = np.searchsorted(ids, s), np.searchsorted(ids, d)
    order = np.argsort(s, kind="stable")
    starts, nbr = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(ids)))]), d[order]
    roots = np.arange(len(ids))
    reach, total, far, inverse, _ = kernels.reach_sums(starts, nbr, roots)
    for r in roots:
        dist, _ = kernels.levels_from(starts, nbr, r)
        own = dist[dist > 0]
        assert (reach[r], total[r], far[r]) == (len(own) + 1, own.sum(), own.max(initial=0)) and abs(inverse[r] - (1 / own).sum()) < 1e-9
    # 1,200 diamonds in a row: 2^1200 paths
    a = [(3 * k + i, 3 * k + j) for k in range(1200) for i, j in ((0, 1), (0, 2), (1, 3), (2, 3))]
    s, d = np.array([x for x, _ in a]), np.array([y for _, y in a])
    order = np.argsort(s, kind="stable")
    starts, nbr = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=3601))]), d[order]
    levels = kernels.waves(starts, nbr, np.array([0]))
    assert len(levels) == 2401 and all(set(x[5]) <= {0.5, 1.0} for x in levels[1:])


def greedy(edges):
    """The matching of edges in order of (priority, src, dst), null first."""
    used, out = set(), set()
    for p, a, b in sorted({(p, min(a, b), max(a, b)) for a, b, p in edges if a != b}, key=lambda x: (x[0] is not None, x)):
        if not used & {a, b}:
            used |= {a, b}
            out.add((a, b))
    return out


def test_matching_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """A path of 400 nodes in blocks of 60 edges: rounds are those of the blocks, not a round for each link of the chain of ranks."""
    monkeypatch.setattr(kernels, "BLOCK_EDGES", 60)
    seen = []
    monkeypatch.setattr(traverse, "materialise", lambda df, name, *a, write=traverse.materialise: seen.append(name) or write(df, name, *a))
    e = spark.range(399).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {tuple(r) for r in traverse.maximal_matching(e).collect()} == {(k, k + 1) for k in range(0, 400, 2)}
    assert seen.count("taken") < 20  # a round for each link would be 200


@pytest.mark.parametrize("block", [20, 50])
def test_matching_in_blocks_equals_the_greedy_one(spark, monkeypatch, block):
    """With priorities, nulls among them, both directions, loops and repeated edges, in blocks and from hubs of more edges than a block."""
    monkeypatch.setattr(kernels, "BLOCK_EDGES", block)
    rng = random.Random(block)
    rows = [(rng.randrange(40), rng.randrange(40), rng.choice([None, 1, 2, 3, 4])) for _ in range(60)] + [(0, k, 5) for k in range(1, 30)]
    df = spark.createDataFrame(rows, "src long, dst long, p int")
    got = [tuple(r) for r in traverse.maximal_matching(df, "p").collect()]
    assert set(got) == greedy(rows) and len(got) == len(set(got))
    plain = [tuple(r) for r in traverse.maximal_matching(df).collect()]
    assert set(plain) == greedy([(a, b, 0) for a, b, _ in rows]) and len(plain) == len(set(plain))
    names = df.selectExpr("cast(src as string) src", "cast(dst as string) dst")
    assert {tuple(r) for r in traverse.maximal_matching(names).collect()} == greedy([(str(a), str(b), 0) for a, b, _ in rows])
    assert traverse.maximal_matching(df.limit(0)).count() == 0


@pytest.mark.parametrize("scattered", [False, True])
def test_eccentricity_in_blocks(spark, monkeypatch, scattered):
    """Blocks of some 40 nodes, of a long lattice or of ids dealt at random, equal plain searches; no search over the whole graph is made."""
    rng = random.Random(7)
    ids = list(range(180))
    if scattered:
        rng.shuffle(ids)
    edges = [(ids[a], ids[b]) for a, b, _ in lattice(30, 6)] + [(ids[v], ids[v + 6]) for v in range(0, 174, 6)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reach(root):
        dist, front = {root: 0}, [root]
        while front:
            far = {y for x in front for y in near[x]} - dist.keys()
            dist |= dict.fromkeys(far, dist[front[0]] + 1)
            front = list(far)
        return dist

    whole = reach(ids[0])
    monkeypatch.setattr(kernels, "BLOCK_EDGES", 120)
    monkeypatch.setattr(traverse, "FAR_ROOTS", 25)
    monkeypatch.setattr(traverse, "search", None)
    df = spark.createDataFrame([(a, b) for a, b in edges if a in whole], "src long, dst long")
    assert {r.id: r.value for r in traverse.eccentricity(df).collect()} == {v: max(reach(v).values()) for v in whole}
    if not scattered:
        with pytest.raises(ValueError, match="disconnected"):
            traverse.eccentricity(df.union(spark.createDataFrame([(500, 501)], df.schema)))
