"""Topological graph of clean lines: vertices, edges, degrees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.functions import geom as G


def coordinate_key(p: Column) -> Column:
    """A vertex id from exact coordinates, so that no join is needed to find it."""
    return F.xxhash64(p["x"], p["y"])


def edges_of(lines: DataFrame, key: Callable[[Column], Column] = coordinate_key) -> DataFrame:
    """``fid, name, start_vtx, end_vtx, length, geom`` of lines ``fid, geom[, name]``."""
    name = F.col("name") if "name" in lines.columns else F.lit(None).cast("string").alias("name")
    return lines.select("fid", name, key(G.start_point("geom")).alias("start_vtx"), key(G.end_point("geom")).alias("end_vtx"), G.length("geom").alias("length"), "geom")


def vertices_of(edges: DataFrame) -> DataFrame:
    """``vid, degree, pt``; a loop counts twice."""
    ends = F.array(F.struct(F.col("start_vtx").alias("vid"), G.start_point("geom").alias("pt")), F.struct(F.col("end_vtx").alias("vid"), G.end_point("geom").alias("pt")))
    return edges.select(F.explode(ends).alias("e")).groupBy("e.vid").agg(F.count(F.lit(1)).cast("int").alias("degree"), F.min("e.pt").alias("pt"))


def edge_degrees(edges: DataFrame, vertices: DataFrame, start: str = "start_vtx", end: str = "end_vtx", vertex: str = "vid") -> DataFrame:
    """Adds ``degree``: other edge ends met at both ends; a loop's vertex counts once."""
    s = vertices.select(F.col(vertex).alias(start), F.col("degree").alias("_ds"))
    t = vertices.select(F.col(vertex).alias(end), F.col("degree").alias("_de"))
    out = edges.join(s, start).join(t, end)
    degree = F.when(F.col(start) == F.col(end), F.col("_ds") - 2).otherwise(F.col("_ds") + F.col("_de") - 2)
    return out.withColumn("degree", degree.cast("int")).drop("_ds", "_de")


def build_graph(lines: DataFrame, snap: float = 0.2, min_edge_length: float = 4.0, key: Callable[[Column], Column] = coordinate_key) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of raw lines; with ``snap`` above 0 they are sanitised and rounded to snap/2 first."""
    if snap > 0:
        from waygraph.operators.sanitize import sanitize

        lines = sanitize(lines, snap, min_edge_length).withColumn("geom", G.snap_to_grid("geom", snap / 2))
    edges = edges_of(lines, key)
    vertices = vertices_of(edges)
    return vertices, edge_degrees(edges, vertices)
