"""Bipartite graphs: ``src`` is the top node, ``dst`` the bottom node."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.operators.components import connected_components
from waygraph.operators.graph.structure import nodes
from waygraph.plans.stages import materialise


def two_coloring(edges: DataFrame) -> DataFrame:
    """``id, color`` of any graph, by components of the graph of (node, parity); the least node of a part has colour 0; an error if an odd cycle exists."""
    key = F.lit(2)
    a, b = F.col("src") * key, F.col("dst") * key
    doubled = edges.select(a.alias("x"), (b + 1).alias("y")).union(edges.select((a + 1).alias("x"), b.alias("y")))
    cc = materialise(connected_components(doubled, "x", "y"), "parity")
    v = cc.select(F.floor(F.col("id") / 2).cast("long").alias("id"), (F.col("id") % 2).alias("side"), "component")
    p = v.groupBy("id").agg(F.max(F.when(F.col("side") == 0, F.col("component"))).alias("c0"), F.max(F.when(F.col("side") == 1, F.col("component"))).alias("c1"))
    if p.filter("c0 = c1").limit(1).count():
        raise ValueError("the graph is not bipartite")
    return p.select("id", F.when(F.col("c0") < F.col("c1"), 0).otherwise(1).alias("color"))


def is_bipartite(edges: DataFrame) -> bool:
    """Whether a two-colouring exists."""
    try:
        two_coloring(edges)
    except ValueError:
        return False
    return True


def side_degrees(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``side, id, degree`` of both sides."""
    w = F.col(weight) if weight else F.lit(1)
    top = edges.groupBy(F.col("src").alias("id")).agg(F.sum(w).alias("degree")).select(F.lit("top").alias("side"), "id", "degree")
    return top.unionByName(edges.groupBy(F.col("dst").alias("id")).agg(F.sum(w).alias("degree")).select(F.lit("bottom").alias("side"), "id", "degree"))


def density(edges: DataFrame) -> DataFrame:
    """``value``: edges over all possible ones."""
    return edges.agg((F.count(F.lit(1)) / (F.countDistinct("src") * F.countDistinct("dst"))).alias("value"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """``side, id, value``: degree over the size of the other side."""
    n = edges.agg(F.countDistinct("src").alias("nt"), F.countDistinct("dst").alias("nb"))
    d = side_degrees(edges).crossJoin(n)  # one row
    return d.select("side", "id", (F.col("degree") / F.when(F.col("side") == "top", F.col("nb")).otherwise(F.col("nt"))).alias("value"))


def closeness_centrality(edges: DataFrame) -> DataFrame:
    """``id, value``: (m + 2 (n-1)) / sum of distances times the share reached; n the own side's size, m the other's.  Node ids of both sides must differ."""
    from waygraph.operators.indicators import distance_sums

    sides = side_degrees(edges).select("id", "side")
    n = edges.agg(F.countDistinct("src").alias("nt"), F.countDistinct("dst").alias("nb"))
    d = distance_sums(edges).join(sides, "id").crossJoin(n)  # one row
    own, other = F.when(F.col("side") == "top", F.col("nt")).otherwise(F.col("nb")), F.when(F.col("side") == "top", F.col("nb")).otherwise(F.col("nt"))
    share = (F.col("reach") - 1) / (F.col("nt") + F.col("nb") - 1)
    return d.select("id", F.when(F.col("total") > 0, (other + 2 * (own - 1)) / F.col("total") * share).otherwise(F.lit(0.0)).alias("value"))


def betweenness_centrality(edges: DataFrame) -> DataFrame:
    """``id, value``: betweenness over the largest value a node of its side can have."""
    from waygraph.operators.indicators import betweenness

    sides = side_degrees(edges).select("id", "side")
    c = edges.agg(F.countDistinct("src").cast("double").alias("n"), F.countDistinct("dst").cast("double").alias("m"))

    def top(n, m):
        s, t = F.floor((n - 1) / m), (n - 1) % m
        return (m * m * (s + 1) * (s + 1) + m * (s + 1) * (2 * t - s - 1) - t * (2 * s - t + 3)) / 2

    d = betweenness(edges).join(sides, "id").crossJoin(c)  # one row
    return d.select("id", F.try_divide("betwee", F.when(F.col("side") == "top", top(F.col("n"), F.col("m"))).otherwise(top(F.col("m"), F.col("n")))).alias("value"))


def projection(edges: DataFrame, kind: str = "count", weight: Column | None = None) -> DataFrame:
    """``u, v, w`` on the top side.

    ``kind``: ``count`` (shared neighbours), ``ratio`` (of the other side), ``newman``
    (sum of 1/(k-1)), ``jaccard``, ``overlap`` (over the smaller degree) or ``custom``
    with a ``weight`` expression over (common, union, du, dv, newman).
    """
    e = edges.select("src", "dst").distinct()
    kb = e.groupBy("dst").agg(F.count(F.lit(1)).alias("kb"))
    kt = e.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    x = e.join(kb.filter("kb > 1"), "dst")
    p = x.select(F.col("src").alias("u"), "dst", "kb").join(e.select(F.col("src").alias("v"), "dst"), "dst").filter("u < v")
    p = p.groupBy("u", "v").agg(F.count(F.lit(1)).alias("common"), F.sum(1 / (F.col("kb") - 1)).alias("newman"))
    if kind == "count":
        return p.select("u", "v", F.col("common").alias("w"))
    if kind == "newman":
        return p.select("u", "v", F.col("newman").alias("w"))
    if kind == "ratio":
        return p.crossJoin(e.agg(F.countDistinct("dst").alias("m"))).select("u", "v", (F.col("common") / F.col("m")).alias("w"))  # one row
    p = p.join(kt.select(F.col("src").alias("u"), F.col("k").alias("du")), "u").join(kt.select(F.col("src").alias("v"), F.col("k").alias("dv")), "v")
    p = p.withColumn("union", F.col("du") + F.col("dv") - F.col("common"))
    w = {"jaccard": F.col("common") / F.col("union"), "overlap": F.col("common") / F.least("du", "dv"), "custom": weight}[kind]
    return p.select("u", "v", w.alias("w"))


def multi_projection(edges: DataFrame) -> DataFrame:
    """``u, v, key``: one row per shared neighbour."""
    e = edges.select("src", "dst").distinct()
    return e.select(F.col("src").alias("u"), F.col("dst").alias("key")).join(e.select(F.col("src").alias("v"), F.col("dst").alias("key")), "key").filter("u < v").select("u", "v", "key")


def pair_clustering(edges: DataFrame, mode: str = "dot") -> DataFrame:
    """``id, value`` on the top side: mean overlap with second neighbours (``dot``: union, ``min``, ``max`` of degrees)."""
    w = {"dot": F.col("common") / F.col("union"), "min": F.col("common") / F.least("du", "dv"), "max": F.col("common") / F.greatest("du", "dv")}[mode]
    p = materialise(projection(edges, "custom", w), "overlap")
    s = p.select(F.col("u").alias("id"), "w").union(p.select("v", "w")).groupBy("id").agg(F.avg("w").alias("value"))
    return edges.select(F.col("src").alias("id")).distinct().join(s, "id", "left").na.fill(0.0, ["value"])


def robins_alexander(edges: DataFrame) -> DataFrame:
    """``value``: 4 * four-cycles over three-paths."""
    e = edges.select("src", "dst").distinct()
    c4 = projection(e, "count").agg(F.coalesce(F.sum(F.col("w") * (F.col("w") - 1) / 2), F.lit(0.0)).alias("c4"))
    kt = e.groupBy("src").agg(F.count(F.lit(1)).alias("a"))
    kb = e.groupBy("dst").agg(F.count(F.lit(1)).alias("b"))
    l3 = e.join(kt, "src").join(kb, "dst").agg(F.sum((F.col("a") - 1) * (F.col("b") - 1)).alias("l3"))
    return c4.crossJoin(l3).select(F.when(F.col("l3") > 0, 4.0 * F.col("c4") / F.col("l3")).otherwise(F.lit(0.0)).alias("value"))  # one row each


#: Neighbours' neighbours of one top node that a task holds.
TWO_STEPS = 20_000_000


def node_redundancy(edges: DataFrame) -> DataFrame:
    """``id, value`` of top nodes with two or more neighbours: share of neighbour pairs that another top node links too.

    A top node meets the others that share two or more of its neighbours, and ors their rows of bits:
    pairs are counted, not listed.  They are listed only if that makes fewer
    rows, or if one node's rows would not fit a task.
    """
    e = materialise(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "redundancy")
    low = e.groupBy("dst").agg(F.count(F.lit(1)).alias("b"))
    size = e.join(low, "dst").groupBy("src").agg(F.count(F.lit(1)).alias("k"), F.sum("b").alias("two"))
    size = size.agg(F.sum("two").alias("two"), F.max("two").alias("most"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("pairs")).first()
    if (size["two"] or 0) > (size["pairs"] or 0) or size["most"] > TWO_STEPS:
        x = e.select(F.col("src").alias("id"), F.col("dst").alias("p")).join(e.select(F.col("src").alias("id"), F.col("dst").alias("q")), "id").filter("p < q")
        x = materialise(x, "pairs")
        twice = x.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("p", "q", F.lit(1).alias("r"))
        return x.join(twice, ["p", "q"], "left").groupBy("id").agg((F.count("r") / F.count(F.lit(1))).alias("value"))
    around = e.groupBy("dst").agg(F.collect_list("src").alias("by"))
    kind = e.schema["src"].dataType.simpleString()

    def shares(x):
        me, k = x["src"].iloc[0], len(x)
        if k < 2:
            return pd.DataFrame({"id": [], "value": []})
        at = np.repeat(np.arange(k), [len(y) for y in x["by"]])
        other = np.concatenate(x["by"].to_list())
        at, other = at[other != me], other[other != me]
        _, other, times = np.unique(other, return_inverse=True, return_counts=True)
        several = times[other] > 1  # others that share one neighbour link no pair
        at = at[several]
        _, other = np.unique(other[several], return_inverse=True)
        both = 0
        if len(at):
            begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            step = max(1, 4_000_000 // len(at))  # words of 64 neighbours at a time
            for w in range(0, -(-k // 64), step):
                here = (at // 64 >= w) & (at // 64 < w + step)
                bits = np.zeros((other.max() + 1, min(step, -(-k // 64) - w)), np.uint64)
                np.bitwise_or.at(bits, (other[here], at[here] // 64 - w), np.uint64(1) << (at[here] % 64).astype(np.uint64))
                both += int(np.bitwise_count(np.bitwise_or.reduceat(bits[other], begin, axis=0)).sum())
            both -= len(begin)  # a neighbour with itself
        return pd.DataFrame({"id": [me], "value": [(both / 2) / (k * (k - 1) / 2)]})

    return e.join(around, "dst").groupBy("src").applyInPandas(shares, f"id {kind}, value double")


def biadjacency(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``row, col, w``: the incidence as a long table."""
    return edges.groupBy(F.col("src").alias("row"), F.col("dst").alias("col")).agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("w"))


def from_biadjacency(rows: DataFrame) -> DataFrame:
    """Edges of non-zero cells (row, col, w)."""
    return rows.filter("w <> 0").select(F.col("row").alias("src"), F.col("col").alias("dst"), "w")


def is_node_set(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``value``: no edge has both or neither of its ends in the set."""
    a = ids.select(F.col("id").alias("src"), F.lit(1).alias("a"))
    b = ids.select(F.col("id").alias("dst"), F.lit(1).alias("b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").agg(F.coalesce(F.bool_and(F.col("a").isNull() != F.col("b").isNull()), F.lit(True)).alias("value"))


def all_nodes(edges: DataFrame) -> DataFrame:
    """``id`` of both sides."""
    return nodes(edges)
