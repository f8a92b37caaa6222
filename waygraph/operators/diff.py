"""Structural difference of two states of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.functions import geom as G
from waygraph.operators.components import connected_components
from waygraph.operators.indicators import distance_sums
from waygraph.plans.kernels import cell_join
from waygraph.plans.stages import materialise


def split_edges(edges: DataFrame, places: DataFrame, size: float = 200.0) -> DataFrame:
    """Edges (``fid, geom`` and more) cut by the other state's places: ``part`` numbers the pieces, ``length`` is theirs.

    Places have a ``ring``, or ``rings`` with holes and parts, inside which an edge goes
    or in a hole stays.  Edges that meet no place pass through untouched.
    """
    polygon = F.col("rings") if "rings" in places.columns else F.array("ring")
    p = places.select("place", polygon.alias("rings")).withColumn("around", F.flatten("rings"))
    hits = cell_join(edges.select("fid", "geom"), p, "geom", "around", size, 0.0, G.meets_polygon("geom", "rings"), "fid", "place")
    own = hits.groupBy("fid").agg(F.sort_array(F.collect_list("rings")).alias("polygons"))
    e = edges.join(own, "fid", "left")
    rest = [c for c in edges.columns if c not in ("geom", "length")]
    cut = e.filter("polygons is not null").select(*rest, F.posexplode(G.line_minus_polygons()(F.col("geom"), F.col("polygons"))).alias("part", "geom"))
    whole = e.filter("polygons is null").select(*rest, F.lit(0).alias("part"), "geom")
    return cut.unionByName(whole).withColumn("length", G.length("geom"))


def paired(first: DataFrame, second: DataFrame, tolerance: float = 1.0, size: float = 200.0) -> DataFrame:
    """``fid1, fid2, way1, way2, diff``: edges of both states, each wholly within tolerance of the other; diff of their ``acces``."""
    a = first.filter("way is not null").select(F.col("fid").alias("fid1"), F.col("way").alias("way1"), F.col("acces").alias("acces1"), F.col("geom").alias("g1"))
    b = second.filter("way is not null").select(F.col("fid").alias("fid2"), F.col("way").alias("way2"), F.col("acces").alias("acces2"), F.col("geom").alias("g2"))
    a, b = a.withColumn("b1", G.bounds(F.col("g1"))), b.withColumn("b2", G.bounds(F.col("g2")))
    # boxes rule out most pairs before lines are compared
    same = G.box_within(F.col("b1"), F.col("b2"), tolerance) & G.box_within(F.col("b2"), F.col("b1"), tolerance) & G.covered("g1", "g2", tolerance) & G.covered("g2", "g1", tolerance)
    p = cell_join(a, b, "g1", "g2", size, tolerance, same, "fid1", "fid2")
    return p.select("fid1", "fid2", "way1", "way2", (F.col("acces2") - F.col("acces1")).alias("diff"))


def removed(first: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of the first state that have a way and no pair."""
    return first.filter("way is not null").join(pairs.select(F.col("fid1").alias("fid")), "fid", "left_anti")


def added(second: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of the second state that have a way and no pair."""
    return second.filter("way is not null").join(pairs.select(F.col("fid2").alias("fid")), "fid", "left_anti")


def _lost(graph: DataFrame, roots: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``way, name``: summed hops * length from ways to those of ``edges``; no row if none can be reached.  Tasks sum; no pairs are listed."""
    by_way = materialise(edges.groupBy(F.col("way").alias("id")).agg(F.sum("length").alias("length")), "diff-lengths")
    roots = materialise(roots.select(F.col("way").alias("id")).distinct(), "diff-roots")
    sums = distance_sums(graph, by_way, sources=roots).select("id", "weighted")
    part = materialise(connected_components(graph, "src", "dst", roots.union(by_way.select("id"))), "diff-parts")
    met = part.join(by_way, "id", "left_semi").select("component").distinct()
    some = part.join(met, "component", "left_semi").join(roots, "id", "left_semi")
    return some.join(sums, "id", "left").select(F.col("id").alias("way"), F.coalesce("weighted", F.lit(0.0)).alias(name))


def accessibility_delta(pairs: DataFrame, gone: DataFrame, new: DataFrame, graph1: DataFrame, graph2: DataFrame) -> DataFrame:
    """Pairs with ``removed, added, delta`` = diff + removed - added.

    ``removed`` is the sum of hops * length over removed edges from the pair's way
    in the first graph, ``added`` likewise in the second; ways that cannot be
    reached contribute nothing, and null if none can.
    """
    r = _lost(graph1, pairs.select(F.col("way1").alias("way")), gone, "removed").withColumnRenamed("way", "way1")
    a = _lost(graph2, pairs.select(F.col("way2").alias("way")), new, "added").withColumnRenamed("way", "way2")
    out = pairs.join(r, "way1", "left").join(a, "way2", "left")
    return out.withColumn("delta", F.col("diff") + F.coalesce("removed", F.lit(0.0)) - F.coalesce("added", F.lit(0.0)))


def structural_diff(first: DataFrame, second: DataFrame, graph1: DataFrame, graph2: DataFrame, tolerance: float = 1.0, srids: tuple[int, int] = (0, 0)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paired, removed, added); deltas only if every edge has its ``acces``.  Different SRIDs raise an error."""
    if srids[0] != srids[1]:
        raise ValueError(f"different SRIDs: {srids}")
    pairs = materialise(paired(first, second, tolerance), "diff-pairs")
    gone, new = removed(first, pairs), added(second, pairs)
    missing = first.filter("acces is null").limit(1).count() + second.filter("acces is null").limit(1).count()
    if not missing:
        pairs = accessibility_delta(pairs, gone, new, graph1, graph2)
    return pairs, gone, new
