"""Ways: edges chained into streets that go straight on, and their own measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waygraph.functions import geom as G
from waygraph.operators.components import connected_components
from waygraph.plans.stages import materialise


def departures(edges: DataFrame) -> DataFrame:
    """``place, edge, side, p1, p2, az``: how each edge leaves each of its places; a loop leaves twice."""
    a = edges.select(F.col("start_pl").alias("place"), F.col("fid").alias("edge"), F.lit(0).alias("side"), G.point_n("geom", 1).alias("p1"), G.point_n("geom", 2).alias("p2"))
    b = edges.select(F.col("end_pl").alias("place"), F.col("fid").alias("edge"), F.lit(1).alias("side"), G.point_n("geom", -1).alias("p1"), G.point_n("geom", -2).alias("p2"))
    return a.unionByName(b).withColumn("az", G.azimuth(F.col("p1"), F.col("p2")))


def place_pairs(dep: DataFrame) -> DataFrame:
    """Pairs of departures of a place in the order (edge, side), with deviation, gap and coefficient.

    The coefficient is (|sin a| + |sin b|) * gap, with a, b the angles between the
    straight line across the place and the two departures.
    """
    x = dep.select("place", *[F.col(c).alias(f"{c}_a") for c in ("edge", "side", "p1", "p2", "az")])
    y = dep.select("place", *[F.col(c).alias(f"{c}_b") for c in ("edge", "side", "p1", "p2", "az")])
    p = x.join(y, "place").filter(F.struct("edge_a", "side_a") < F.struct("edge_b", "side_b"))
    gap = G.distance(F.col("p1_a"), F.col("p1_b"))
    across = G.azimuth(F.col("p1_a"), F.col("p1_b"))
    coef = (F.abs(F.sin(F.col("az_a") - across)) + F.abs(F.sin(F.col("az_b") - across))) * gap
    return p.select("place", "edge_a", "side_a", "edge_b", "side_b", G.deviation(F.col("az_a"), F.col("az_b")).alias("angle"), gap.alias("gap"), coef.alias("coef"))


def pair_by_angle(edges: DataFrame, threshold: float = 60.0) -> DataFrame:
    """``place, edge_a, edge_b, gap``: at each place the pairs that go on into each other.

    Two departures are a pair.  Of more, the pair with the smallest coefficient is
    tried first, is accepted if it deviates by less than ``threshold`` degrees, and
    accepted departures leave; ties go to the first in the order (edge, side).
    Places are independent and their pairs are bounded by their degree.
    """
    dep = departures(edges)
    pairs = place_pairs(dep)
    n = dep.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    limit = threshold * 3.141592653589793 / 180

    def match(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["coef", "edge_a", "side_a", "edge_b", "side_b"])
        if g["n"].iloc[0] == 2:
            return g[["place", "edge_a", "edge_b", "gap"]]
        gone, keep = set(), []
        for i, (ea, sa, eb, sb, angle) in enumerate(zip(g["edge_a"], g["side_a"], g["edge_b"], g["side_b"], g["angle"], strict=True)):
            if (ea, sa) in gone or (eb, sb) in gone or angle >= limit:
                continue
            gone |= {(ea, sa), (eb, sb)}
            keep.append(i)
        return g.iloc[keep][["place", "edge_a", "edge_b", "gap"]]

    return pairs.join(n, "place").groupBy("place").applyInPandas(match, "place long, edge_a long, edge_b long, gap double")


def pair_by_name(edges: DataFrame) -> DataFrame:
    """``place, edge_a, edge_b, gap``: at each place all pairs of edges with the same name."""
    dep = departures(edges).join(edges.select(F.col("fid").alias("edge"), "name"), "edge").filter("name is not null")
    x = dep.select("place", "name", F.col("edge").alias("edge_a"), F.col("side").alias("sa"), F.col("p1").alias("pa"))
    y = dep.select("place", "name", F.col("edge").alias("edge_b"), F.col("side").alias("sb"), F.col("p1").alias("pb"))
    p = x.join(y, ["place", "name"]).filter(F.struct("edge_a", "sa") < F.struct("edge_b", "sb"))
    return p.select("place", "edge_a", "edge_b", G.distance(F.col("pa"), F.col("pb")).alias("gap"))


def partition(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``fid, way, dist``: the way of every edge (smallest edge id) and half the gaps to its continuations."""
    pairs = materialise(pairs, "way-pairs")
    cc = connected_components(pairs, "edge_a", "edge_b", edges, "fid")
    half = pairs.select(F.explode(F.array("edge_a", "edge_b")).alias("fid"), (F.col("gap") / 2).alias("d")).groupBy("fid").agg(F.sum("d").alias("dist"))
    return cc.withColumnRenamed("id", "fid").withColumnRenamed("component", "way").join(half, "fid", "left").select("fid", "way", F.coalesce("dist", F.lit(0.0)).alias("dist"))


def num_ways(parts: DataFrame) -> DataFrame:
    """``ways``: the number of distinct ways."""
    return parts.agg(F.countDistinct("way").alias("ways"))


def way_places(edges: DataFrame) -> DataFrame:
    """Distinct ``way, place`` of edges with a ``way`` column."""
    return edges.select("way", F.explode(F.array("start_pl", "end_pl")).alias("place")).distinct()


def way_degrees(wp: DataFrame) -> DataFrame:
    """``way, degree``: distinct other ways that share a place."""
    other = wp.select(F.col("way").alias("other"), "place")
    return wp.join(other, "place").filter("way <> other").groupBy("way").agg(F.countDistinct("other").cast("int").alias("degree"))


def way_connectivity(edges: DataFrame, wp: DataFrame) -> DataFrame:
    """``way, conn``: distinct (edge, place) of edges of other ways at the way's places."""
    ends = edges.select(F.col("way").alias("other"), F.col("fid"), F.explode(F.array("start_pl", "end_pl")).alias("place")).distinct()
    return wp.join(ends, "place").filter("way <> other").groupBy("way").agg(F.countDistinct("fid", "place").cast("int").alias("conn"))


def way_ends(edges: DataFrame) -> DataFrame:
    """``way, start_pl, end_pl``: places of odd incidence, least and greatest; a closed way has its least place twice."""
    inc = edges.select("way", F.explode(F.array("start_pl", "end_pl")).alias("place")).groupBy("way", "place").agg(F.count(F.lit(1)).alias("n"))
    a = inc.groupBy("way").agg(F.min(F.when(F.col("n") % 2 == 1, F.col("place"))).alias("s"), F.max(F.when(F.col("n") % 2 == 1, F.col("place"))).alias("e"), F.min("place").alias("m"))
    return a.select("way", F.coalesce("s", "m").alias("start_pl"), F.coalesce("e", "m").alias("end_pl"))


def build_ways(edges: DataFrame, threshold: float = 60.0, attribute: bool = False, geometry: bool = True) -> tuple[DataFrame, DataFrame]:
    """(ways, place edges with ``way`` and ``dist``) from place edges.

    ``ways``: ``way_id, start_pl, end_pl, length, degree, conn, spacing`` and the
    merged geometry.  Length is that of the edges plus the half gaps; degree and
    conn are 0 for a way that meets no other; spacing is length / conn, null then.
    """
    edges = materialise(edges, "way-edges")
    parts = partition(edges, pair_by_name(edges) if attribute else pair_by_angle(edges, threshold))
    e = materialise(edges.drop("way", "dist").join(parts, "fid", "left"), "edges-ways")
    wp = way_places(e)
    aggs = [(F.sum("length") + F.sum("dist")).alias("length")]
    if geometry:
        aggs.append(F.collect_list("geom").alias("lines"))
    w = e.groupBy("way").agg(*aggs)
    if geometry:
        w = w.withColumn("geom", G.line_merge()("lines")).drop("lines")
    w = w.join(way_ends(e), "way").join(way_degrees(wp), "way", "left").join(way_connectivity(e, wp), "way", "left")
    w = w.fillna(0, ["degree", "conn"]).withColumn("spacing", F.when(F.col("conn") > 0, F.col("length") / F.col("conn")))
    return w.withColumnRenamed("way", "way_id"), e


def line_graph(wp: DataFrame) -> DataFrame:
    """Undirected simple graph ``src, dst, place`` of ways that share a place; of several the largest place."""
    other = wp.select(F.col("way").alias("dst"), "place")
    return wp.withColumnRenamed("way", "src").join(other, "place").filter("src < dst").groupBy("src", "dst").agg(F.max("place").alias("place"))


def lengths_by_class(rows: DataFrame, attribute: str, classes: int = 10, key: str = "fid", length: str = "length") -> DataFrame:
    """``key, class``: classes of equal total length in ascending order of an attribute, nulls first, ties by key.

    A row's class is fixed before its length is added and rises by at most one a
    row:  class_i = min over j < i of (floor(C_j / b) - j) + i - 1,  with C the
    running length and b a class's share.  Rows are range-partitioned; sums and
    minima of partitions are shifted by those before, so no window holds all rows.
    """
    spark = rows.sparkSession
    order = [F.col("a").asc_nulls_first(), F.col("k")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = rows.select(F.col(key).alias("k"), F.col(attribute).cast("double").alias("a"), F.col(length).alias("l"))
    d = materialise(d.repartitionByRange(n, *order).withColumn("p", F.spark_partition_id()), "class-order")
    sums = d.groupBy("p").agg(F.sum("l").alias("l"), F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = sums.select("p", F.coalesce(F.sum("l").over(before), F.lit(0.0)).alias("l0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), (F.sum("l").over(Window.partitionBy()) / classes).alias("b"))
    w = Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = d.join(F.broadcast(base), "p")
    x = x.withColumn("c", F.col("l0") + F.coalesce(F.sum("l").over(w), F.lit(0.0))).withColumn("j", F.col("c0") + F.coalesce(F.count("l").over(w), F.lit(0)))
    x = materialise(x.withColumn("f", F.when(F.col("b") > 0, F.floor(F.col("c") / F.col("b"))).otherwise(F.lit(0)) - F.col("j")), "class-sums")
    low = x.groupBy("p").agg(F.min("f").alias("m"))
    low = low.select("p", F.min("m").over(before).alias("m0"))
    upto = Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(F.broadcast(low), "p").withColumn("m", F.least(F.min("f").over(upto), F.col("m0")))
    return x.select(F.col("k").alias(key), (F.col("m") + F.col("j")).cast("int").alias("class"))
