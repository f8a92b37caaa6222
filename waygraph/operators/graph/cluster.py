"""Triangles, clustering, cores, communities, cuts, structural holes, similarity, assortativity, cliques."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waygraph.operators.components import connected_components
from waygraph.operators.graph.structure import canonical, degrees, node_boundary, nodes, subgraph
from waygraph.plans.kernels import symmetric
from waygraph.plans.stages import materialise


def _simple(edges: DataFrame) -> DataFrame:
    return canonical(edges).filter("src <> dst").distinct()


def triangle_rows(edges: DataFrame) -> DataFrame:
    """``a, b, c``: every triangle once.  Edges point from lower to higher degree, so no node fans out far."""
    e = _simple(edges)
    d = degrees(e)
    o = e.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    o = materialise(o.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"), F.when(up, F.col("dd")).otherwise(F.col("ds")).alias("db")), "oriented")
    wedge = o.join(o.select("a", F.col("b").alias("c"), F.col("db").alias("dc")), "a").filter(F.struct("db", "b") < F.struct("dc", "c"))
    return wedge.join(o.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).select("a", "b", "c")


def triangles(edges: DataFrame) -> DataFrame:
    """``id, triangles`` of every node."""
    t = triangle_rows(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return nodes(edges).join(t, "id", "left").na.fill(0, ["triangles"])


def clustering(edges: DataFrame) -> DataFrame:
    """``id, value``: 2 T / (d (d-1)), 0 below degree 2."""
    d = degrees(_simple(edges))
    t = triangles(edges).join(d, "id", "left").na.fill(0, ["degree"])
    return t.select("id", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(F.lit(0.0)).alias("value"))


def weighted_clustering(edges: DataFrame, weight: str = "w") -> DataFrame:
    """``id, value``: mean over neighbour pairs of the cube root of the three weights over the largest weight."""
    e = canonical(edges, weight).filter("src <> dst").groupBy("src", "dst").agg(F.max(weight).alias("w"))
    top = e.agg(F.max("w").alias("top"))
    e = e.crossJoin(top).select("src", "dst", (F.col("w") / F.col("top")).alias("w"))  # top is one row
    t = triangle_rows(edges)

    def weigh(t, x, y, name):
        return t.withColumn("src", F.least(x, y)).withColumn("dst", F.greatest(x, y)).join(e.withColumnRenamed("w", name), ["src", "dst"]).drop("src", "dst")

    t = weigh(weigh(weigh(t, "a", "b", "w1"), "b", "c", "w2"), "a", "c", "w3").withColumn("x", F.cbrt(F.col("w1") * F.col("w2") * F.col("w3")))
    s = t.select(F.explode(F.array("a", "b", "c")).alias("id"), "x").groupBy("id").agg(F.sum("x").alias("x"))
    d = degrees(e.select("src", "dst"))
    return nodes(edges).join(s, "id", "left").join(d, "id", "left").select("id", F.when(F.col("degree") > 1, 2 * F.coalesce("x", F.lit(0.0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(F.lit(0.0)).alias("value"))


def average_clustering(edges: DataFrame, count_zeros: bool = True) -> DataFrame:
    """``value``: mean clustering of all nodes, or of those above 0."""
    c = clustering(edges)
    return (c if count_zeros else c.filter("value > 0")).agg(F.avg("value").alias("value"))


def sampled_clustering(edges: DataFrame, trials: int = 1000, seed: int = 0) -> DataFrame:
    """``value``: share of ``trials`` hash-drawn nodes whose two drawn neighbours are adjacent; degree below 2 is a miss."""
    s = symmetric(_simple(edges))
    n = nodes(edges).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(trials)
    adj = s.join(n.withColumnRenamed("id", "src"), "src", "left_semi").groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("x"))
    k = F.size("x")
    i = F.pmod(F.xxhash64(F.lit(seed + 1), "src"), k)
    j = F.pmod(i + 1 + F.pmod(F.xxhash64(F.lit(seed + 2), "src"), F.greatest(k - 1, F.lit(1))), k)
    w = adj.filter(k > 1).select(F.element_at("x", (i + 1).cast("int")).alias("src"), F.element_at("x", (j + 1).cast("int")).alias("dst"))
    return w.join(s.withColumn("hit", F.lit(1)), ["src", "dst"], "left").agg(F.count("hit").alias("hits")).crossJoin(n.agg(F.count(F.lit(1)).alias("n"))).select((F.col("hits") / F.col("n")).alias("value"))  # one row each


def transitivity(edges: DataFrame) -> DataFrame:
    """``value``: 3 triangles over connected triples."""
    t = triangle_rows(edges).agg(F.count(F.lit(1)).alias("t"))
    d = degrees(_simple(edges)).agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("k"))
    return t.crossJoin(d).select(F.when(F.col("k") > 0, 3 * F.col("t") / F.col("k")).otherwise(F.lit(0.0)).alias("value"))  # one row each


def generalized_degree(edges: DataFrame) -> DataFrame:
    """``id, multiplicity, edges``: how many of a node's edges lie in so many triangles."""
    t = triangle_rows(edges)
    pairs = t.select(F.explode(F.array(*[F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")) for x, y in (("a", "b"), ("b", "c"), ("a", "c"))])).alias("e")).select("e.*")
    m = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("multiplicity"))
    e = _simple(edges).join(m, ["src", "dst"], "left").na.fill(0, ["multiplicity"])
    return symmetric(e, "src", "dst", "multiplicity").groupBy(F.col("src").alias("id"), "multiplicity").agg(F.count(F.lit(1)).alias("edges"))


def square_clustering(edges: DataFrame) -> DataFrame:
    """``id, value``: share of possible squares at each node."""
    s = materialise(symmetric(_simple(edges)), "links")
    k = s.groupBy(F.col("src").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    a = s.select(F.col("src").alias("v"), F.col("dst").alias("u"))
    uw = a.join(a.withColumnRenamed("u", "w"), "v").filter("u < w")
    common = uw.select("u", "w", "v").join(a.select(F.col("v").alias("u"), F.col("u").alias("z")), "u").join(a.select(F.col("v").alias("w"), F.col("u").alias("z")), ["w", "z"]).filter("z <> v").groupBy("v", "u", "w").agg(F.count(F.lit(1)).alias("q"))
    tie = s.select(F.col("src").alias("u"), F.col("dst").alias("w"), F.lit(1).alias("t"))
    x = uw.join(common, ["v", "u", "w"], "left").join(tie, ["u", "w"], "left").na.fill(0, ["q", "t"])
    x = x.join(k.select(F.col("x").alias("u"), F.col("k").alias("ku")), "u").join(k.select(F.col("x").alias("w"), F.col("k").alias("kw")), "w")
    possible = (F.col("ku") - (F.col("q") + 1 + F.col("t"))) * (F.col("kw") - (F.col("q") + 1 + F.col("t"))) + F.col("q")
    r = x.groupBy("v").agg(F.sum("q").alias("q"), F.sum(possible).alias("p"))
    return nodes(edges).join(r.withColumnRenamed("v", "id"), "id", "left").select("id", F.when(F.col("p") > 0, F.col("q") / F.col("p")).otherwise(F.lit(0.0)).alias("value"))


def core_number(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """``id, core``: h-index iteration; a node's value becomes the largest h with h neighbours of value h or more."""
    s = materialise(symmetric(_simple(edges)), "links")
    c = materialise(s.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("core")), "cores")
    for _ in range(rounds):
        near = s.join(c.select(F.col("id").alias("dst"), "core"), "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("core"), asc=False).alias("x"))
        h = F.size(F.filter("x", lambda v, i: v > i))
        nxt = materialise(c.join(near, "id").select("id", F.least(h, F.col("core")).alias("core"), (h < F.col("core")).alias("moved")), "cores")
        c = nxt.drop("moved")
        if not nxt.filter("moved").limit(1).count():
            return c
    raise RuntimeError("core numbers did not settle")


def k_core(edges: DataFrame, k: int | None = None, kind: str = "core") -> DataFrame:
    """Edges of the k-core, -shell, -crust or -corona; default k is the largest core number (one less for the crust)."""
    c = materialise(core_number(edges), "cores")
    if k is None:
        k = (c.agg(F.max("core")).first()[0] or 0) - (kind == "crust")
    if kind == "corona":
        s = symmetric(_simple(edges)).join(c.filter(F.col("core") >= k).select(F.col("id").alias("dst")), "dst", "left_semi")
        full = s.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
        own = c.filter(F.col("core") == k).join(full, "id", "left_semi")
    else:
        own = c.filter({"core": F.col("core") >= k, "shell": F.col("core") == k, "crust": F.col("core") <= k}[kind])
    return subgraph(_simple(edges), own.select("id"))


def label_propagation(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """``id, label``: colour classes take turns; each node takes the commonest neighbour label, its own among ties, else the largest.

    Ends when no label moves; an error if labels still move after ``rounds``.
    """
    from waygraph.operators.graph.traverse import greedy_color

    s = materialise(symmetric(_simple(edges)), "links")
    color = materialise(greedy_color(edges), "colors")
    k = (color.agg(F.max("color")).first()[0] or 0) + 1
    lab = materialise(color.select("id", "color", F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        moved = 0
        for c in range(k):
            turn = lab.filter(F.col("color") == c)
            counts = s.join(turn.select(F.col("id").alias("src"), F.col("label").alias("own")), "src").join(lab.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "own", "label").agg(F.count(F.lit(1)).alias("n"))
            best = counts.groupBy("src", "own").agg(F.max(F.struct("n", (F.col("label") == F.col("own")), "label")).alias("b"))
            new = best.select(F.col("src").alias("id"), F.col("b.label").alias("new"))
            nxt = lab.join(new, "id", "left").withColumn("m", (F.col("new") != F.col("label")) & F.col("new").isNotNull())
            nxt = materialise(nxt.select("id", "color", F.coalesce("new", "label").alias("label"), "m"), "labels")
            moved += nxt.filter("m").limit(1).count()
            lab = nxt.drop("m")
        if not moved:
            return lab.select("id", "label")
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def asyn_label_propagation(edges: DataFrame, rounds: int = 1000, weight: str | None = None) -> DataFrame:
    """``id, label``: in each round half of the nodes, drawn by hash, take the commonest neighbour label, their own among ties, else one drawn by hash.

    Ends when no node's label is beaten; an error if it never is.
    """
    s = materialise(symmetric(edges, "src", "dst", *([weight] if weight else [])), "links")
    w = F.col(weight) if weight else F.lit(1)
    lab = materialise(nodes(edges).withColumn("label", F.col("id")), "labels")
    for r in range(rounds):
        counts = s.join(lab.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum(w).alias("n"))
        counts = counts.join(lab.select(F.col("id").alias("src"), F.col("label").alias("own")), "src")
        best = counts.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("n", F.col("label") == F.col("own"), F.xxhash64(F.lit(r), "label"), "label")).alias("b"))
        turn = F.xxhash64(F.lit(r), "id") % 2 == 0
        new = F.coalesce("b.label", "label")
        nxt = lab.join(best, "id", "left").select("id", F.when(turn, new).otherwise(F.col("label")).alias("label"), (new != F.col("label")).alias("beaten"))
        nxt = materialise(nxt, "labels")
        lab = nxt.select("id", "label")
        if not nxt.filter("beaten").limit(1).count():
            return lab
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def modularity(edges: DataFrame, labels: DataFrame, weight: str | None = None) -> DataFrame:
    """``value``: sum over communities of L/m - (D/2m)^2."""
    w = F.col(weight) if weight else F.lit(1)
    e = edges.select("src", "dst", w.alias("w")).join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    inner = e.filter("a = b").groupBy(F.col("a").alias("label")).agg(F.sum("w").alias("l"))
    deg = e.select(F.explode(F.array("a", "b")).alias("label"), "w").groupBy("label").agg(F.sum("w").alias("d"))
    t = deg.join(inner, "label", "left").na.fill(0, ["l"]).withColumn("m", F.sum("d").over(Window.partitionBy()) / 2)  # one row per community
    return t.agg(F.sum(F.col("l") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2))).alias("value"))


def partition_quality(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``intra_edges, inter_edges, inter_non_edges, coverage, performance`` by counting."""
    e = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    m = e.agg(F.count_if(F.col("a") == F.col("b")).alias("intra_edges"), F.count_if(F.col("a") != F.col("b")).alias("inter_edges"))
    c = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"))
    t = m.crossJoin(c).withColumn("inter_non_edges", ((F.col("n") * F.col("n") - F.col("q")) / 2 - F.col("inter_edges")).cast("long"))  # one row each
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return t.select("intra_edges", "inter_edges", "inter_non_edges", (F.col("intra_edges") / (F.col("intra_edges") + F.col("inter_edges"))).alias("coverage"), ((F.col("intra_edges") + F.col("inter_non_edges")) / pairs).alias("performance"))


def is_partition(ids: DataFrame, blocks: DataFrame) -> DataFrame:
    """``value``: every node is in exactly one block and no other node in any."""
    t = ids.select("id", F.lit(1).alias("n")).join(blocks.groupBy("id").agg(F.count(F.lit(1)).alias("b")), "id", "full")
    return t.agg(F.coalesce(F.bool_and((F.col("n") == 1) & (F.col("b") == 1)), F.lit(True)).alias("value")).select(F.coalesce("value", F.lit(False)).alias("value"))


def k_cliques(edges: DataFrame, k: int) -> DataFrame:
    """``members``: every clique of ``k`` nodes once, ascending."""
    e = materialise(_simple(edges), "links")
    c = e.select(F.array("src", "dst").alias("members"))
    for _ in range(k - 2):
        c = c.withColumn("src", F.element_at("members", -1)).join(e, "src").withColumnRenamed("dst", "new").drop("src")
        others = c.withColumn("old", F.explode(F.slice("members", F.lit(1), F.size("members") - 1)))
        ok = others.join(e.select(F.col("src").alias("old"), F.col("dst").alias("new")), ["old", "new"]).groupBy("members", "new").agg(F.count(F.lit(1)).alias("n"))
        c = materialise(ok.filter(F.col("n") == F.size("members") - 1).select(F.concat("members", F.array("new")).alias("members")), "cliques")
    return c if k > 1 else nodes(edges).select(F.array("id").alias("members"))


def _maximal_within(nbr: dict[int, set[int]]) -> list[list[int]]:
    """Maximal cliques of a small graph, by pivoting."""
    out, stack = [], [([], set(nbr), set())]
    while stack:
        chosen, may, done = stack.pop()
        if not may:
            if not done:
                out.append(chosen)
            continue
        pivot = max(may | done, key=lambda u: len(may & nbr[u]))
        for v in sorted(may - nbr[pivot]):
            stack.append(([*chosen, v], may & nbr[v], done & nbr[v]))
            may, done = may - {v}, done | {v}
    return out


def maximal_cliques(edges: DataFrame) -> DataFrame:
    """``members`` of every maximal clique, ascending.

    Nodes are ordered by (degree, id).  A clique is found at its first node, among
    that node's later neighbours; of those a node has at most the square root of
    twice the number of edges, however many neighbours there are in all.  Cliques
    that an earlier node extends go, by a join.
    """
    e = materialise(_simple(edges), "links")
    s = materialise(symmetric(e), "links")
    k = s.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    a = e.join(k.select(F.col("id").alias("src"), F.struct("k", "id").alias("a")), "src").join(k.select(F.col("id").alias("dst"), F.struct("k", "id").alias("b")), "dst")
    later = materialise(a.select(F.least("a", "b")["id"].alias("v"), F.greatest("a", "b")["id"].alias("u")), "later")
    inner = later.join(later.withColumnRenamed("u", "w"), "v").filter("u < w").join(e.select(F.col("src").alias("u"), F.col("dst").alias("w")), ["u", "w"], "left_semi")
    local = later.select("v", "u", F.lit(None).cast("long").alias("w")).unionByName(inner.select("v", "u", "w"))

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        nbr: dict[int, set[int]] = {int(u): set() for u in g["u"]}
        pairs = g[g["w"].notna()]
        for u, w in zip(pairs["u"].astype("int64"), pairs["w"].astype("int64"), strict=True):
            nbr[u].add(w)
            nbr[w].add(u)
        v = int(g["v"].iloc[0])
        return pd.DataFrame({"members": [sorted([v, *c]) for c in _maximal_within(nbr)]})

    c = materialise(local.groupBy("v").applyInPandas(grow, "members array<long>"), "cliques")
    wider = c.withColumn("old", F.explode("members")).join(s.select(F.col("src").alias("old"), F.col("dst").alias("new")), "old").groupBy("members", "new").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.size("members"))
    return c.join(wider.select("members").distinct(), "members", "left_anti")


def cliques_of_nodes(cliques: DataFrame) -> DataFrame:
    """``id, cliques, largest``: number and largest size of the cliques with a node."""
    return cliques.select(F.explode("members").alias("id"), F.size("members").alias("k")).groupBy("id").agg(F.count(F.lit(1)).alias("cliques"), F.max("k").alias("largest"))


def k_clique_communities(edges: DataFrame, k: int) -> DataFrame:
    """``community, id``: k-cliques linked when they share k - 1 nodes; a community is named by its least clique, as text."""
    c = k_cliques(edges, k).withColumn("c", F.concat_ws(",", "members"))
    c = materialise(c, "cliques")
    parts = c.select("c", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.concat(F.slice("members", F.lit(1), i - 1), F.slice("members", i + 1, F.lit(k))))).alias("s"))
    hub = parts.groupBy("s").agg(F.min("c").alias("hub"))
    links = parts.join(hub, "s").filter("c <> hub")
    cc = connected_components(links, "c", "hub", c, "c")
    return c.join(cc.select(F.col("id").alias("c"), "component"), "c").select(F.col("component").alias("community"), F.explode("members").alias("id")).distinct()


def cut_measures(edges: DataFrame, inside: DataFrame, weight: str | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """``cut, volume, volume_other, normalized_cut, conductance, edge_expansion, mixing_expansion, node_expansion, boundary_expansion`` of a node set."""
    w = F.col(weight) if weight else F.lit(1)
    s = symmetric(edges.select("src", "dst", w.alias("w")), "src", "dst", "w")
    t = s.join(inside.select(F.col("id").alias("src"), F.lit(1).alias("a")), "src", "left").join(inside.select(F.col("id").alias("dst"), F.lit(1).alias("b")), "dst", "left")
    m = t.agg(F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNull(), F.col("w")).otherwise(0)).alias("cut"), F.sum(F.when(F.col("a").isNotNull(), F.col("w")).otherwise(0)).alias("volume"), F.sum(F.when(F.col("a").isNull(), F.col("w")).otherwise(0)).alias("volume_other"))
    n = nodes(edges, vertices).join(inside.select("id", F.lit(1).alias("a")), "id", "left").agg(F.count("a").alias("n"), F.count_if(F.col("a").isNull()).alias("o"))
    b = node_boundary(edges, inside).agg(F.count(F.lit(1)).alias("nb"))
    near = symmetric(edges).join(inside.select(F.col("id").alias("src")), "src", "left_semi").select("dst").distinct().agg(F.count(F.lit(1)).alias("nn"))
    r = m.crossJoin(n).crossJoin(b).crossJoin(near)  # one row each
    lo = F.least("n", "o")
    return r.select("cut", "volume", "volume_other", F.try_divide("cut", "volume").alias("c1"), F.try_divide("cut", "volume_other").alias("c2"), F.try_divide("cut", F.least("volume", "volume_other")).alias("conductance"), F.try_divide("cut", lo).alias("edge_expansion"), F.try_divide("cut", (F.col("volume") + F.col("volume_other"))).alias("mixing_expansion"), F.try_divide("nn", "n").alias("node_expansion"), F.try_divide("nb", "n").alias("boundary_expansion")).withColumn("normalized_cut", F.col("c1") + F.col("c2")).drop("c1", "c2")


def constraint(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``id, value``: sum over neighbours v of (p_uv + sum_w p_uw p_wv)^2, p the normalised mutual weights."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    s = symmetric(edges.filter("src <> dst").select("src", "dst", w.alias("w")), "src", "dst", "w").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    p = materialise(s.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("p")), "mutual")
    two = p.select(F.col("src").alias("u"), F.col("dst").alias("x"), F.col("p").alias("p1")).join(p.select(F.col("src").alias("x"), F.col("dst").alias("v"), F.col("p").alias("p2")), "x").filter("u <> v").groupBy("u", "v").agg(F.sum(F.col("p1") * F.col("p2")).alias("ind"))
    l = p.join(two, (p["src"] == two["u"]) & (p["dst"] == two["v"]), "left")
    return l.groupBy(F.col("src").alias("id")).agg(F.sum(F.pow(F.col("p") + F.coalesce("ind", F.lit(0.0)), F.lit(2))).alias("value"))


def effective_size(edges: DataFrame) -> DataFrame:
    """``id, value``: n - 2t/n of an unweighted undirected graph, t the ties among n neighbours."""
    e = _simple(edges)
    t = triangles(e).join(degrees(e), "id")
    return t.select("id", (F.col("degree") - 2 * F.col("triangles") / F.col("degree")).alias("value"))


def triadic_census(edges: DataFrame) -> DataFrame:
    """``type, n`` of the 16 directed triads; connected triples are classified, the others counted by formula."""
    e = edges.select("src", "dst").filter("src <> dst").distinct()
    code = canonical(e.withColumn("c", F.when(F.col("src") < F.col("dst"), 1).otherwise(2)), "c").groupBy("src", "dst").agg(F.sum("c").alias("c"))
    d = materialise(code, "dyads")
    s = d.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(d.select("dst", "src"))
    wedge = s.join(s.withColumnRenamed("y", "z"), "x").filter("y < z")
    t = wedge.select(F.sort_array(F.array("x", "y", "z")).alias("t")).distinct().select(*[F.element_at("t", i + 1).alias(k) for i, k in enumerate("abc")])
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        t = t.join(d.select(F.col("src").alias(x), F.col("dst").alias(y), F.col("c").alias(f"{x}{y}")), [x, y], "left").na.fill(0, [f"{x}{y}"])
    num = t.groupBy((F.col("ab") + 4 * F.col("ac") + 16 * F.col("bc")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    names = edges.sparkSession.createDataFrame([(k, _triad_name(k)) for k in range(64)], "code long, type string")
    own = num.join(F.broadcast(names), "code").groupBy("type").agg(F.sum("n").alias("n"))  # 64 rows
    n = nodes(edges).count()
    kinds = {r["m"]: r["n"] for r in d.groupBy((F.col("c") == 3).alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}
    have = {r["type"]: r["n"] for r in own.collect()}  # at most 16 rows
    inside = {True: 0, False: 0}  # mutual and asymmetric dyads within connected triples
    for name, c in have.items():
        inside[True] += int(name[0]) * c
        inside[False] += int(name[1]) * c
    rows = {x: 0 for x in _TRIADS} | have
    rows["102"] = kinds.get(True, 0) * (n - 2) - inside[True]
    rows["012"] = kinds.get(False, 0) * (n - 2) - inside[False]
    rows["003"] = n * (n - 1) * (n - 2) // 6 - sum(rows.values())
    return edges.sparkSession.createDataFrame(sorted(rows.items()), "type string, n long")


# The names of the triad types.
_TRIADS = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")


def _triad_name(code: int) -> str:
    """Type of a triad from its dyads: mutual, asymmetric and null counts, then its direction."""
    arcs = set()
    for shift, (x, y) in ((0, (0, 1)), (2, (0, 2)), (4, (1, 2))):
        c = code >> shift & 3
        arcs |= {(x, y)} if c & 1 else set()
        arcs |= {(y, x)} if c & 2 else set()
    pairs = [{a for a in arcs if set(a) == {x, y}} for x, y in ((0, 1), (0, 2), (1, 2))]
    m, a = sum(len(p) == 2 for p in pairs), sum(len(p) == 1 for p in pairs)
    base = f"{m}{a}{3 - m - a}"
    out = [sum(s == v for s, _ in arcs) for v in range(3)]
    into = [sum(t == v for _, t in arcs) for v in range(3)]
    if base == "021":
        return base + ("D" if 2 in out else "U" if 2 in into else "C")
    if base == "111":
        odd = next(p for p in pairs if len(p) == 1)
        src, dst = next(iter(odd))
        hub = next(v for v in range(3) if sum(v in {x for e in p for x in e} for p in pairs if p) == 2)
        return base + ("D" if dst == hub else "U")
    if base == "030":
        return base + ("C" if out == [1, 1, 1] else "T")
    if base == "120":
        lone = next(v for v in range(3) if all(v not in {x for e in p for x in e} for p in pairs if len(p) == 2))
        return base + ("D" if out[lone] == 2 else "U" if into[lone] == 2 else "C")
    return base


def link_scores(edges: DataFrame, candidates: DataFrame | None = None, communities: DataFrame | None = None, delta: float = 0.001) -> DataFrame:
    """``u, v`` and scores; default candidates are the non-adjacent pairs with a common neighbour.

    ``common, jaccard, adamic_adar, resource_allocation, preferential_attachment``;
    with ``communities`` (id, label) also ``cn_community, ra_community, within_inter``.
    """
    s = materialise(symmetric(_simple(edges)), "links")
    d = s.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    a = s.select(F.col("src").alias("u"), F.col("dst").alias("x"))
    b = s.select(F.col("src").alias("v"), F.col("dst").alias("x"))
    both = a.join(b, "x").filter("u < v")
    if candidates is None:
        both = both.join(s.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti")
    else:
        both = both.join(candidates, ["u", "v"], "left_semi")
    both = both.join(d.select(F.col("id").alias("x"), F.col("k").alias("kx")), "x")
    aggs = [F.count(F.lit(1)).alias("common"), F.sum(1 / F.log("kx")).alias("adamic_adar"), F.sum(1 / F.col("kx")).alias("resource_allocation")]
    if communities is not None:
        for n in ("u", "v", "x"):
            both = both.join(communities.select(F.col("id").alias(n), F.col("label").alias(f"l{n}")), n)
        same, own = F.col("lu") == F.col("lv"), (F.col("lu") == F.col("lv")) & (F.col("lx") == F.col("lu"))
        aggs += [F.count_if(own).alias("within"), F.sum(F.when(own, 1 / F.col("kx")).otherwise(0.0)).alias("ra_community"), F.max(same).alias("same")]
    r = both.groupBy("u", "v").agg(*aggs)
    if candidates is not None:
        r = candidates.join(r, ["u", "v"], "left").na.fill(0)
    r = r.join(d.select(F.col("id").alias("u"), F.col("k").alias("ku")), "u").join(d.select(F.col("id").alias("v"), F.col("k").alias("kv")), "v")
    r = r.withColumn("jaccard", F.col("common") / (F.col("ku") + F.col("kv") - F.col("common"))).withColumn("preferential_attachment", F.col("ku") * F.col("kv")).drop("ku", "kv")
    if communities is not None:
        r = r.withColumn("cn_community", F.col("common") + F.col("within")).withColumn("within_inter", F.when(F.col("same"), F.col("within") / (F.col("common") - F.col("within") + delta)).otherwise(F.lit(0.0))).drop("within", "same")
    return r


def edge_values(edges: DataFrame, values: DataFrame, name: str = "value", directed: bool = False) -> DataFrame:
    """``x, y``: a node value at both ends of every edge, in both orientations unless directed."""
    e = edges.select("src", "dst") if directed else symmetric(edges)
    return e.join(values.select(F.col("id").alias("src"), F.col(name).alias("x")), "src").join(values.select(F.col("id").alias("dst"), F.col(name).alias("y")), "dst").select("x", "y")


def mixing(edges: DataFrame, values: DataFrame, name: str = "value", normalized: bool = False, directed: bool = False) -> DataFrame:
    """``x, y, n``: joint counts, or shares, of a node value over edge ends."""
    m = edge_values(edges, values, name, directed).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("n", F.col("n") / F.sum("n").over(Window.partitionBy())) if normalized else m  # one row per pair of values


def attribute_assortativity(edges: DataFrame, values: DataFrame, name: str = "value", directed: bool = False) -> DataFrame:
    """``value``: (trace - sum a b) / (1 - sum a b) of the mixing shares."""
    m = materialise(mixing(edges, values, name, True, directed), "mixing")
    ab = m.groupBy("x").agg(F.sum("n").alias("a")).join(m.groupBy(F.col("y").alias("x")).agg(F.sum("n").alias("b")), "x").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    t = m.agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0.0)).alias("t"))
    return t.crossJoin(ab).select(F.try_divide(F.col("t") - F.col("s"), 1 - F.col("s")).alias("value"))  # one row each


def numeric_assortativity(edges: DataFrame, values: DataFrame, name: str = "value", directed: bool = False) -> DataFrame:
    """``value``: correlation of a node value over edge ends."""
    return edge_values(edges, values, name, directed).agg(F.corr(F.col("x").cast("double"), F.col("y").cast("double")).alias("value"))


def degree_assortativity(edges: DataFrame, x: str = "out", y: str = "in", directed: bool = False) -> DataFrame:
    """``value``: correlation of degrees over edge ends; on digraphs of x-degrees of sources and y-degrees of targets."""
    if not directed:
        return numeric_assortativity(edges, degrees(edges), "degree")
    def side(k):
        return edges.groupBy(F.col("src" if k == "out" else "dst").alias("id")).agg(F.count(F.lit(1)).alias("k"))

    e = edges.join(side(x).select(F.col("id").alias("src"), F.col("k").alias("a")), "src", "left").join(side(y).select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst", "left")
    return e.agg(F.corr(F.coalesce("a", F.lit(0)).cast("double"), F.coalesce("b", F.lit(0)).cast("double")).alias("value"))


def average_neighbour_degree(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``id, value``: (weighted) mean degree of neighbours."""
    w = F.col(weight) if weight else F.lit(1.0)
    s = symmetric(edges.select("src", "dst", w.alias("w")), "src", "dst", "w")
    d = degrees(edges)
    return s.join(d.select(F.col("id").alias("dst"), "degree"), "dst").groupBy(F.col("src").alias("id")).agg((F.sum(F.col("w") * F.col("degree")) / F.sum("w")).alias("value"))


def directed_neighbour_degree(edges: DataFrame, source: str = "out", target: str = "out", weight: str | None = None) -> DataFrame:
    """``id, value`` of a digraph: (weighted) mean ``target`` degree of the nodes that a node's ``source`` edges lead to."""
    e = edges.select("src", "dst", (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    e = e if source == "out" else e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    k = edges.groupBy(F.col("src" if target == "out" else "dst").alias("dst")).agg(F.count(F.lit(1)).alias("k"))
    s = e.join(k, "dst", "left").na.fill(0, ["k"])
    return s.groupBy(F.col("src").alias("id")).agg((F.sum(F.col("w") * F.col("k")) / F.sum("w")).alias("value"))


def average_degree_connectivity(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``degree, value``: (weighted) mean neighbour degree of nodes of each degree."""
    d = degrees(edges)
    s = symmetric(edges.select("src", "dst", (F.col(weight) if weight else F.lit(1.0)).alias("w")), "src", "dst", "w").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dn")), "dst").join(d.select(F.col("id").alias("src"), "degree"), "src")
    return s.groupBy("degree").agg((F.sum(F.col("w") * F.col("dn")) / F.sum("w")).alias("value"))


def degree_mixing(edges: DataFrame, normalized: bool = False) -> DataFrame:
    """``x, y, n``: joint counts, or shares, of the degrees of both ends."""
    return mixing(edges, degrees(edges), "degree", normalized)


def directed_degree_mixing(edges: DataFrame, x: str = "out", y: str = "in") -> DataFrame:
    """``x, y, n`` of a digraph: joint counts of x-degrees of sources and y-degrees of targets."""
    def side(k, end):
        return edges.groupBy(F.col("src" if k == "out" else "dst").alias(end)).agg(F.count(F.lit(1)).alias(f"k_{end}"))

    e = edges.select("src", "dst").join(side(x, "src"), "src", "left").join(side(y, "dst"), "dst", "left").na.fill(0)
    return e.groupBy(F.col("k_src").alias("x"), F.col("k_dst").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def girvan_newman(edges: DataFrame, levels: int = 1) -> DataFrame:
    """``level, id, component``: the edge of highest betweenness goes, again and again, until the components grow in number."""
    from waygraph.operators.indicators import edge_brandes

    e, ids, out = materialise(_simple(edges), "links"), materialise(nodes(edges), "ids"), None
    count = connected_components(e, "src", "dst", ids).select("component").distinct().count()
    for level in range(1, levels + 1):
        while e.limit(1).count():
            top = edge_brandes(e).orderBy(F.desc(F.round("value", 9)), "src", "dst").limit(1)
            e = materialise(e.join(top, ["src", "dst"], "left_anti"), "links")
            cc = materialise(connected_components(e, "src", "dst", ids), "cc")
            n = cc.select("component").distinct().count()
            if n > count:
                count = n
                part = cc.select(F.lit(level).alias("level"), "id", "component")
                out = part if out is None else out.unionByName(part)
                break
    return out if out is not None else ids.select(F.lit(0).alias("level"), "id", F.col("id").alias("component")).limit(0)


