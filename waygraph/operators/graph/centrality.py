"""Centrality and link analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waygraph.operators.graph.structure import canonical, degrees, nodes
from waygraph.operators.indicators import brandes, distance_sums, edge_brandes
from waygraph.plans.kernels import relax, search, symmetric
from waygraph.plans.stages import materialise, release


def with_total(df: DataFrame, name: str = "_n", total=None) -> DataFrame:
    """``df`` with a column of the number of its rows, or another total, from a one-row aggregate rather than a window over all rows."""
    return df.crossJoin(F.broadcast(df.agg((F.count(F.lit(1)) if total is None else total).alias(name))))  # one row


def degree_centrality(edges: DataFrame, end: str = "both") -> DataFrame:
    """``id, value``: degree (``both``), in- (``dst``) or out-degree (``src``) over n - 1."""
    d = degrees(edges) if end == "both" else edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return with_total(nodes(edges).join(d, "id", "left")).select("id", (F.coalesce("degree", F.lit(0)) / (F.col("_n") - 1)).alias("value"))


def betweenness_centrality(edges: DataFrame, k: int | None = None, normalized: bool = True, directed: bool = False, endpoints: bool = False, weight: str | None = None) -> DataFrame:
    """``id, value`` over paths shortest by hops or by a positive weight; with ``k`` sampled sources the sums are rescaled by n / k."""
    raw = with_total(materialise(brandes(edges, "betweenness", k, directed, endpoints, weight=weight), "betweenness"))
    n = F.col("_n")
    if normalized:
        pairs = n * (n - 1) if endpoints else (n - 1) * (n - 2)
        scale = F.when(pairs > 0, 1.0 / pairs).otherwise(F.lit(1.0))
    else:
        scale = F.lit(1.0 if directed else 0.5)
    return raw.select("id", (F.col("value") * (scale * n / k if k else scale)).alias("value"))


def edge_betweenness_centrality(edges: DataFrame, k: int | None = None, normalized: bool = True, directed: bool = False, weight: str | None = None) -> DataFrame:
    """``src, dst, value``."""
    raw = edge_brandes(edges, k, directed, weight=weight)
    n = nodes(edges).agg(F.count(F.lit(1)).alias("n"))
    scale = 1.0 / (F.col("n") * (F.col("n") - 1)) if normalized else F.lit(1.0 if directed else 0.5)
    return raw.crossJoin(n).select("src", "dst", (F.col("value") * (scale * F.col("n") / k if k else scale)).alias("value"))  # n is one row


def betweenness_subset(edges: DataFrame, sources: DataFrame, targets: list[int], directed: bool = False, normalized: bool = False, weight: str | None = None) -> DataFrame:
    """Betweenness over paths from ``sources`` (id) to ``targets`` only; the target list is an argument, hence small."""
    raw = with_total(materialise(brandes(edges, "betweenness", None, directed, sources=sources, targets=set(targets), weight=weight), "betweenness"))
    n = F.col("_n")
    scale = 1.0 / ((n - 1) * (n - 2)) if normalized else F.lit(1.0 if directed else 0.5)
    return raw.select("id", (F.col("value") * scale).alias("value"))


def edge_betweenness_subset(edges: DataFrame, sources: DataFrame, targets: list[int], directed: bool = False, weight: str | None = None) -> DataFrame:
    """The same per edge."""
    raw = edge_brandes(edges, None, directed, sources, set(targets), weight)
    return raw.select("src", "dst", (F.col("value") * (1.0 if directed else 0.5)).alias("value"))


def closeness_centrality(edges: DataFrame, wf_improved: bool = True) -> DataFrame:
    """``id, value``: (r-1)/sum of hops, times (r-1)/(n-1) if improved."""
    c = F.when(F.col("total") > 0, (F.col("reach") - 1) / F.col("total")).otherwise(F.lit(0.0))
    return with_total(materialise(distance_sums(edges), "sums")).select("id", (c * (F.col("reach") - 1) / (F.col("_n") - 1) if wf_improved else c).alias("value"))


def weighted_closeness(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Closeness by weights ``w``; of a digraph over inward distances."""
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w") if directed else symmetric(edges, "src", "dst", "w")
    d = relax(e, nodes(edges)).groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("r"), F.sum("dist").alias("t"))
    return with_total(materialise(d, "sums")).select("id", F.when(F.col("t") > 0, (F.col("r") - 1) / F.col("t") * (F.col("r") - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0)).alias("value"))


def harmonic_centrality(edges: DataFrame, directed: bool = False, weight: str | None = None) -> DataFrame:
    """``id, value``: sum of 1 / distance (inward on digraphs), in hops or by a weight."""
    back = edges.withColumnsRenamed({"src": "dst", "dst": "src"}) if directed else edges
    if weight is None:
        return distance_sums(back, directed=directed).select("id", F.col("inverse").alias("value"))
    e = back.select("src", "dst", F.col(weight).alias("w"))
    d = relax(e if directed else symmetric(e, "src", "dst", "w"), nodes(edges))
    return d.groupBy(F.col("root").alias("id")).agg(F.coalesce(F.sum(F.when(F.col("dist") > 0, 1.0 / F.col("dist"))), F.lit(0.0)).alias("value"))


def load_centrality(edges: DataFrame, normalized: bool = True, weight: str | None = None) -> DataFrame:
    """``id, value``: unit loads split evenly among predecessors; normalised by (n-1)(n-2)."""
    n = F.col("_n")
    return with_total(materialise(brandes(edges, "load", weight=weight), "load")).select("id", (F.col("value") / ((n - 1) * (n - 2)) if normalized else F.col("value")).alias("value"))


def _iterate(start: DataFrame, step, tol_scale, tol: float, rounds: int, name: str) -> DataFrame:
    """Repeat ``step`` on (id, x) until the summed change is below tol * tol_scale; an error if it never is."""
    x = old = materialise(start, name)
    for _ in range(rounds):
        seen = Observation()
        nxt = step(x).withColumnRenamed("x", "y").join(x, "id").select("id", F.col("y").alias("x"), F.abs(F.col("y") - F.col("x")).alias("d"))
        new = materialise(nxt.observe(seen, F.sum("d").alias("err")), name)
        release(old)
        old, x = new, new.select("id", "x")
        if (seen.get["err"] or 0.0) < tol * tol_scale:
            return x
    raise RuntimeError(f"{name}: no convergence in {rounds} rounds")


def eigenvector_centrality(edges: DataFrame, rounds: int = 100, tol: float = 1e-6, directed: bool = False) -> DataFrame:
    """``id, value``: power iteration on A + I from 1/n, L2 norm, until the L1 change is below n * tol."""
    e = materialise(edges.select("src", "dst") if directed else symmetric(edges), "links")
    ids = materialise(nodes(edges), "ids")
    n = ids.count()

    def step(x):
        into = e.join(x.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("s"))
        y = x.join(into, "id", "left").select("id", (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("x"))
        norm = y.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        return y.crossJoin(norm).select("id", (F.col("x") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("x"))  # norm is one row

    return _iterate(ids.withColumn("x", F.lit(1.0 / max(1, n))), step, n, tol, rounds, "eigenvector").select("id", F.col("x").alias("value"))


def katz_centrality(edges: DataFrame, alpha: float = 0.1, beta: float = 1.0, rounds: int = 1000, tol: float = 1e-6, directed: bool = False, normalized: bool = True) -> DataFrame:
    """``id, value``: x = alpha A'x + beta from 0, then L2 normalised."""
    e = materialise(edges.select("src", "dst") if directed else symmetric(edges), "links")
    ids = materialise(nodes(edges), "ids")
    n = ids.count()

    def step(x):
        into = e.join(x.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("s"))
        return x.join(into, "id", "left").select("id", (alpha * F.coalesce("s", F.lit(0.0)) + beta).alias("x"))

    x = _iterate(ids.withColumn("x", F.lit(0.0)), step, n, tol, rounds, "katz")
    if not normalized:
        return x.select("id", F.col("x").alias("value"))
    return x.crossJoin(x.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))).select("id", (F.col("x") / F.col("norm")).alias("value"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tol: float = 1e-6, weight: str | None = None, personalization: DataFrame | None = None, dangling: DataFrame | None = None) -> DataFrame:
    """``id, value`` of a digraph; dangling mass goes where ``dangling`` or ``personalization`` (id, p) says, else evenly."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    e = materialise(e.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src"))), "links")
    ids = nodes(edges)

    def share(t, name):
        if t is None:
            return F.lit(1.0) / F.col("_n")
        return F.coalesce(F.col(name), F.lit(0.0)) / F.col(f"_{name}")

    v = ids
    for t, name in ((personalization, "p"), (dangling, "q")):
        if t is not None:
            v = v.join(t.select("id", F.col("p").alias(name)), "id", "left")
    v = materialise(v.join(e.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(True)), "id", "left"), "nodes")
    v = v.crossJoin(F.broadcast(v.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(f"_{c}") for c in ("p", "q") if c in v.columns])))  # one row
    p = share(personalization, "p")
    v = materialise(v.select("id", p.alias("p"), (share(dangling, "q") if dangling is not None else p).alias("q"), F.col("out").isNull().alias("sink")), "nodes")
    n = v.count()

    def step(x):
        into = e.join(x.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("s"))
        lost = x.join(v, "id").agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("x"))), F.lit(0.0)).alias("lost"))
        y = v.join(into, "id", "left").crossJoin(lost)  # lost is one row
        return y.select("id", (alpha * (F.coalesce("s", F.lit(0.0)) + F.col("lost") * F.col("q")) + (1 - alpha) * F.col("p")).alias("x"))

    return _iterate(ids.withColumn("x", F.lit(1.0 / max(1, n))), step, n, tol, rounds, "pagerank").select("id", F.col("x").alias("value"))


def hits(edges: DataFrame, rounds: int = 100, tol: float = 1e-8) -> DataFrame:
    """``id, hub, authority`` of a digraph, each summing to 1."""
    e = materialise(edges.select("src", "dst"), "links")
    ids = materialise(nodes(edges), "ids")

    def authority(h):
        a = e.join(h.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("s"))
        return ids.join(a, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("x"))

    def step(h):
        b = e.join(authority(h).withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("s"))
        y = ids.join(b, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("x"))
        return with_total(y, "_top", F.max("x")).select("id", (F.col("x") / F.col("_top")).alias("x"))

    h = _iterate(ids.withColumn("x", F.lit(1.0 / max(1, ids.count()))), step, 1, tol, rounds, "hits")
    both = materialise(h.join(authority(h).withColumnRenamed("x", "a"), "id"), "hits")
    both = both.crossJoin(F.broadcast(both.agg(F.sum("x").alias("_x"), F.sum("a").alias("_a"))))  # one row
    return both.select("id", (F.col("x") / F.col("_x")).alias("hub"), (F.col("a") / F.col("_a")).alias("authority"))


def reaching(edges: DataFrame) -> DataFrame:
    """``id, value``: share of the other nodes reachable in a digraph."""
    d = distance_sums(edges, directed=True)
    return with_total(materialise(d, "reach")).select("id", ((F.col("reach") - 1) / (F.col("_n") - 1)).alias("value"))


def global_reaching(edges: DataFrame) -> DataFrame:
    """``value``: sum of (largest - own) local reach over n - 1."""
    return reaching(edges).agg(((F.max("value") * F.count(F.lit(1)) - F.sum("value")) / (F.count(F.lit(1)) - 1)).alias("value"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """``id, value``: 2 * mutual partners over all in- and out-edges of each node."""
    e = edges.select("src", "dst").distinct().filter("src <> dst")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("m"))
    both = e.join(back, ["src", "dst"], "left").groupBy(F.col("src").alias("id")).agg(F.count("m").alias("mutual"))
    d = degrees(e)
    return d.join(both, "id", "left").select("id", (2.0 * F.coalesce("mutual", F.lit(0)) / F.col("degree")).alias("value"))


def overall_reciprocity(edges: DataFrame) -> DataFrame:
    """``value``: share of edges whose reverse is an edge."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("m"))
    return e.join(back, ["src", "dst"], "left").agg((F.count("m") / F.count(F.lit(1))).alias("value"))


def global_efficiency(edges: DataFrame) -> DataFrame:
    """``value``: mean of 1 / distance over ordered pairs."""
    return harmonic_centrality(edges).agg((F.sum("value") / (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1))).alias("value"))


def local_efficiency(edges: DataFrame) -> DataFrame:
    """``value``: mean over nodes of the efficiency of the graph among their neighbours.

    All neighbour graphs are searched at once, as one graph of (centre, node) pairs.
    """
    s = materialise(symmetric(edges).distinct().filter("src <> dst"), "links")
    k = s.groupBy(F.col("src").alias("c")).agg(F.count(F.lit(1)).alias("k"))
    inner = s.select(F.col("src").alias("c"), F.col("dst").alias("u")).join(s.select(F.col("src").alias("u"), F.col("dst").alias("v")), "u")
    inner = materialise(inner.join(s.select(F.col("src").alias("c"), F.col("dst").alias("v")), ["c", "v"], "left_semi").select("c", "u", "v"), "ego")
    front = inner.select("c", F.col("u").alias("r"), F.col("u").alias("x")).distinct()
    seen, total, level = front, None, 0
    while True:
        level += 1
        front = front.join(inner, (front["c"] == inner["c"]) & (front["x"] == inner["u"])).select(front["c"], "r", F.col("v").alias("x")).distinct().join(seen, ["c", "r", "x"], "left_anti")
        front = materialise(front, "ego-front")
        if not front.limit(1).count():
            break
        part = front.groupBy("c").agg((F.count(F.lit(1)) / level).alias("e"))
        total = part if total is None else total.unionByName(part)
        seen = materialise(seen.unionByName(front), "ego-seen")
    if total is None:
        return k.agg(F.lit(0.0).alias("value"))
    e = total.groupBy("c").agg(F.sum("e").alias("e"))
    return k.join(e, "c", "left").agg(F.avg(F.when(F.col("k") > 1, F.coalesce("e", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1))).otherwise(F.lit(0.0))).alias("value"))


def wiener_index(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``value``: sum of all pair distances, in hops or by a weight; infinite if the graph is disconnected."""
    if weight is None:
        d = distance_sums(edges)
    else:
        e = symmetric(edges.select("src", "dst", F.col(weight).alias("w")), "src", "dst", "w")
        d = relax(e, nodes(edges)).groupBy("root").agg(F.count(F.lit(1)).alias("reach"), F.sum("dist").alias("total"))
    return d.agg(F.when(F.min("reach") == F.count(F.lit(1)), F.sum("total") / 2).otherwise(F.lit(float("inf"))).alias("value"))


def s_metric(edges: DataFrame) -> DataFrame:
    """``value``: sum over edges of the product of their ends' degrees."""
    d = degrees(edges)
    e = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("b")), "dst")
    return e.agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def rich_club(edges: DataFrame) -> DataFrame:
    """``k, value``: 2 E / (N (N-1)) among nodes of degree above k, not normalised."""
    d = degrees(edges)
    e = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("b")), "dst")
    per_e = e.groupBy(F.least("a", "b").alias("g")).agg(F.count(F.lit(1)).alias("m"))
    per_n = d.groupBy(F.col("degree").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    t = per_n.join(per_e, "g", "full").na.fill(0)
    ks = d.agg(F.max("degree").alias("top")).select(F.explode(F.sequence(F.lit(0), F.col("top") - 1)).alias("k"))
    r = ks.join(t, F.col("g") > F.col("k")).groupBy("k").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))  # distinct degrees on both sides
    return r.filter("n > 1").select("k", (2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("value"))


def dispersion(edges: DataFrame, pairs: DataFrame, normalized: bool = True) -> DataFrame:
    """``u, v, value`` for given pairs: pairs of common neighbours without a tie or a common tie in u's ego net besides u and v."""
    s = symmetric(edges).distinct().filter("src <> dst")
    common = materialise(pairs.join(s.select(F.col("src").alias("u"), F.col("dst").alias("x")), "u").join(s.select(F.col("src").alias("v"), F.col("dst").alias("x")), ["v", "x"]).select("u", "v", "x"), "common")
    xy = common.join(common.withColumnRenamed("x", "y"), ["u", "v"]).filter("x < y")
    tie = s.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    xy = xy.join(tie, ["x", "y"], "left_anti")
    via = s.select(F.col("src").alias("x"), F.col("dst").alias("z")).join(s.select(F.col("src").alias("z"), F.col("dst").alias("y")), "z").filter("x < y")
    ego = s.select(F.col("src").alias("u"), F.col("dst").alias("z"))
    linked = xy.join(via, ["x", "y"]).filter("z <> u and z <> v").join(ego, ["u", "z"], "left_semi").select("u", "v", "x", "y").distinct()
    d = xy.join(linked, ["u", "v", "x", "y"], "left_anti").groupBy("u", "v").agg(F.count(F.lit(1)).alias("d"))
    emb = common.groupBy("u", "v").agg(F.count(F.lit(1)).alias("emb"))
    out = pairs.join(emb, ["u", "v"], "left").join(d, ["u", "v"], "left").na.fill(0, ["emb", "d"])
    return out.select("u", "v", (F.when(F.col("emb") > 0, F.col("d") / F.col("emb")).otherwise(F.col("d")) if normalized else F.col("d")).cast("double").alias("value"))


