"""Selections of features: by attribute, by id, around a point, inside a polygon, within a horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.functions import geom as G
from waygraph.plans.kernels import numbered, ordered_ids, search, symmetric, with_cells


def top_features(rows: DataFrame, attribute: str, percent: float, key: str, of_all: bool = False) -> DataFrame:
    """``key`` of the top ``percent`` by an attribute, descending, ties by key.

    The share is of the rows with a value, or of all rows if ``of_all``; nulls
    come last.  A top-k report: the limit is the feature.
    """
    base = rows if of_all else rows.filter(F.col(attribute).isNotNull())
    k = int(base.count() / 100 * percent)
    return base.orderBy(F.desc_nulls_last(attribute), key).limit(k).select(key)


def edges_by_attribute(edges: DataFrame, attribute: str, percent: float) -> DataFrame:
    """``fid, start_pl, end_pl, length`` of the top edges; the share is of all rows."""
    top = top_features(edges, attribute, percent, "fid", of_all=True)
    return edges.join(top, "fid", "left_semi").select("fid", "start_pl", "end_pl", "length")


def edges_by_way_attribute(edges: DataFrame, ways: DataFrame, attribute: str, percent: float) -> DataFrame:
    """``fid, start_pl, end_pl, length`` of the edges of the top ways."""
    top = top_features(ways, attribute, percent, "way_id", of_all=True).withColumnRenamed("way_id", "way")
    return edges.join(top, "way", "left_semi").select("fid", "start_pl", "end_pl", "length")


def edges_by_fid(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose id is in ``ids.fid``."""
    return edges.join(ids, "fid", "left_semi").select("fid", "start_pl", "end_pl", "length")


def edges_by_way(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose way is in ``ids.way``."""
    return edges.join(ids, "way", "left_semi").select("fid", "start_pl", "end_pl", "length")


def around_point(rows: DataFrame, x: float, y: float, radius: float, key: str, within: bool = False) -> DataFrame:
    """Ids of lines that touch a disc, or lie wholly within it."""
    b, p = G.bounds(F.col("geom")), G.point(x, y)
    near = rows.filter((b["x0"] <= x + radius) & (b["x1"] >= x - radius) & (b["y0"] <= y + radius) & (b["y1"] >= y - radius))
    if within:
        return near.filter(F.forall("geom", lambda q: G.distance(q, p) <= radius)).select(key)
    return near.filter(G.line_distance(p, F.col("geom")) <= radius).select(key)


def in_polygon(rows: DataFrame, polygon: list, key: str, within: bool = False) -> DataFrame:
    """Ids of lines that share a point with a polygon, or lie wholly in it.

    ``polygon`` is one closed ring of (x, y), or a list of rings: holes and further parts.
    """
    rings = [polygon] if isinstance(polygon[0], tuple) else polygon
    r = F.array(*[F.array(*[G.point(a, b) for a, b in ring]) for ring in rings])
    xs, ys = ([p[k] for ring in rings for p in ring] for k in (0, 1))
    b = G.bounds(F.col("geom"))
    near = rows.filter((b["x0"] <= max(xs)) & (b["x1"] >= min(xs)) & (b["y0"] <= max(ys)) & (b["y1"] >= min(ys)))
    return near.filter(G.within_polygon("geom", r) if within else G.meets_polygon("geom", r)).select(key)


def closest_feature(rows: DataFrame, x: float, y: float, radius: float, key: str) -> DataFrame:
    """``key, dist`` of the nearest line within a radius, ties by key; an error if there is none."""
    near = around_point(rows, x, y, radius, key)
    out = rows.join(near, key, "left_semi").select(key, G.line_distance(G.point(x, y), F.col("geom")).alias("dist")).orderBy("dist", key).limit(1)
    if not out.count():
        raise ValueError(f"nothing within {radius} of ({x}, {y})")
    return out


def closest_features(points: DataFrame, rows: DataFrame, radius: float, key: str, point_key: str = "pid") -> DataFrame:
    """For every point (``point_key, pt``) the nearest line within a radius: ``point_key, key, dist``."""
    p = with_cells(points.select(point_key, "pt", F.array("pt").alias("_l")), "_l", max(radius, 1.0), radius)
    r = with_cells(rows.select(key, "geom"), "geom", max(radius, 1.0))
    d = p.join(r, ["cx", "cy"]).withColumn("dist", G.line_distance(F.col("pt"), F.col("geom"))).filter(F.col("dist") <= radius)
    return d.groupBy(point_key).agg(F.min(F.struct("dist", key)).alias("s")).select(point_key, f"s.{key}", "s.dist")


def ways_at_place(wp: DataFrame, place: int) -> DataFrame:
    """Ways at a place."""
    return wp.filter(F.col("place") == place).select("way")


def way_of_edge(edges: DataFrame, fid: int) -> DataFrame:
    """``way, start_pl`` of an edge."""
    return edges.filter(F.col("fid") == fid).select("way", "start_pl")


def horizon(graph: DataFrame, sources: DataFrame, cutoff: int | None = None) -> DataFrame:
    """``id, horizon``: hops from the nearest of ``sources`` (``id``) in an undirected graph; unreachable nodes are absent."""
    if not sources.limit(1).count():
        raise ValueError("no sources")
    names = ordered_ids(graph.select(F.explode(F.array("src", "dst")).alias("id")).union(sources.select("id")))
    g = numbered(graph.select("src", "dst"), names, "src", "dst")
    # one node below all numbers reaches every source
    hub = numbered(sources.select("id"), names, "id").select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    root = hub.select(F.col("src").alias("id")).distinct()
    found = search(symmetric(g).unionByName(hub), root, None if cutoff is None else cutoff + 1).filter("node >= 0")
    return found.join(names, F.col("node") == F.col("n")).select("id", (F.col("dist") - 1).alias("horizon"))


def horizon_features(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """The rows that a horizon (``id, horizon``) reached, geometry and all, with their ``horizon``."""
    return rows.join(found.select(F.col("id").alias(key), "horizon"), key)
