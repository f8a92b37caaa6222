"""Places: clusters of vertices, and edges attached to them.

Discs around vertices overlap when the vertices are at most two radii apart, so
clusters are the connected components of a distance join and need no union.  Input
polygons are united, with each other and with the clusters that join them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.functions import geom as G
from waygraph.operators.components import connected_components
from waygraph.operators.overlay import overlapping, union_polygons
from waygraph.plans.kernels import cell_join, points_in
from waygraph.plans.stages import materialise


def uncovered_vertices(vertices: DataFrame, polygons: DataFrame) -> DataFrame:
    """Vertices inside none of the input polygons (``pid, ring``)."""
    return vertices.join(vertices_in(vertices, polygons).select("vid"), "vid", "left_anti")


def with_rings(polygons: DataFrame) -> DataFrame:
    """``pid, rings`` of polygons that have a ``ring`` or ``rings``, turned so that the inside is on the left."""
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    return polygons.select("pid", G.oriented(rings).alias("rings"))


def vertices_in(vertices: DataFrame, polygons: DataFrame, size: float = 200.0) -> DataFrame:
    """``vid, pid`` of vertices inside polygons (``pid, ring`` or ``rings``); of several the smallest polygon id."""
    one = F.lit(0).alias("grp")
    pairs = points_in(vertices.select(F.col("vid").alias("id"), one, "pt"), with_rings(polygons).select("pid", one, "rings"), size)
    return pairs.groupBy(F.col("id").alias("vid")).agg(F.min("pid").alias("pid"))


def clusters(vertices: DataFrame, buffer: float) -> DataFrame:
    """``vid, cluster`` of vertices of degree above 1 whose discs touch, directly or in a chain."""
    v = vertices.filter("degree > 1").select("vid", F.array("pt").alias("line"), "pt")
    w = v.select(F.col("vid").alias("vid2"), F.col("line").alias("line2"), F.col("pt").alias("pt2"))
    near = (F.col("vid") < F.col("vid2")) & (G.distance(F.col("pt"), F.col("pt2")) <= 2 * buffer)
    pairs = cell_join(v, w, "line", "line2", max(4 * buffer, 1.0), 2 * buffer, near, "vid", "vid2")
    cc = connected_components(pairs.select("vid", "vid2"), "vid", "vid2", v.select("vid"), "vid")
    return cc.select(F.col("id").alias("vid"), F.col("component").alias("cluster"))


def _hulls(members: DataFrame, vertices: DataFrame) -> DataFrame:
    """``key, ring``: the convex hull of discs of ``radius`` around the vertices (``key, vid, radius``) of each key."""
    disc = F.transform(G.buffer_ring(G.point(0.0, 0.0), 1.0), lambda p: G.point(F.col("pt.x") + p["x"] * F.col("radius"), F.col("pt.y") + p["y"] * F.col("radius")))
    own = members.join(vertices.select("vid", "pt"), "vid").withColumn("disc", disc)
    return own.groupBy("key").agg(F.flatten(F.collect_list("disc")).alias("pts")).select("key", G.convex_hull()("pts").alias("ring"))


def _joined(own: DataFrame, inside: DataFrame, edges: DataFrame, hulls: DataFrame, given: DataFrame) -> DataFrame:
    """``cluster, to``: the input polygon that a cluster joins: it overlaps it, and an edge leads from one of its vertices into it; of several the smallest."""
    ends = edges.select(F.col("start_vtx").alias("a"), F.col("end_vtx").alias("b"))
    ends = ends.union(ends.select("b", "a"))
    linked = ends.join(inside.withColumnRenamed("vid", "a"), "a").join(own.withColumnRenamed("vid", "b"), "b").select("cluster", "pid").distinct()
    near = overlapping(hulls.select(F.col("key").alias("pid"), F.array("ring").alias("rings")), given)
    return linked.join(near.select(F.col("pid1").alias("cluster"), F.col("pid2").alias("pid")), ["cluster", "pid"]).groupBy("cluster").agg(F.min("pid").alias("to"))


def build_places(vertices: DataFrame, edges: DataFrame, buffer: float = 4.0, polygons: DataFrame | None = None, file_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(places, place_vtx).

    ``places``: ``place, ring, rings, nb_vtx, end_vtx, user_pl``; ``place_vtx``: ``vertex, place``.
    Place ids are the smallest vertex id of the place; ``rings`` is its polygon, ``ring``
    the outer ring.  Clusters of vertices have the convex hull of their discs.  Input
    ``polygons`` (``pid`` and ``ring`` or ``rings``) are united and split into their
    parts; each with a vertex inside is a place.  A cluster of vertices outside all of
    them joins an input place that it overlaps if an edge leads from one of its vertices
    to one inside it, and the place is then the union of both.  With ``file_only`` the
    polygons are taken as they are and no clusters are made.  Vertices left over, dead
    ends among them, are places alone with a disc of 1 m.  An error is raised if there
    is no place.
    """
    none = F.lit(None).cast("long")
    given = merged = None
    if polygons is None:
        own = clusters(vertices, buffer).withColumn("to", none)
    else:
        given = with_rings(polygons)
        if not file_only:
            given = union_polygons(given).select(F.col("part").alias("pid"), "rings")
        given = materialise(given, "given-places")
        inside = materialise(vertices_in(vertices, given), "inside")
        own = inside.select("vid", none.alias("cluster"), F.col("pid").alias("to"))
        if not file_only:
            free = materialise(clusters(vertices.join(inside.select("vid"), "vid", "left_anti"), buffer), "free-clusters")
            hulls = materialise(_hulls(free.select("vid", F.col("cluster").alias("key"), F.lit(float(buffer)).alias("radius")), vertices), "free-hulls")
            to = materialise(_joined(free, inside, edges, hulls, given), "joined-clusters")
            own = own.unionByName(free.join(to, "cluster", "left").select("vid", "cluster", "to"))
            both = hulls.join(to, F.col("key") == F.col("cluster")).select(F.col("to").alias("grp"), F.col("key").alias("pid"), F.array("ring").alias("rings"))
            with_hulls = given.join(to.select(F.col("to").alias("pid")).distinct(), "pid", "left_semi").select(F.col("pid").alias("grp"), F.lit(-1).cast("long").alias("pid"), "rings")
            # a polygon's own id may be that of a vertex; inside a group only the two kinds must differ
            parts = both.withColumn("pid", F.struct(F.lit(1).alias("kind"), "pid")).unionByName(with_hulls.withColumn("pid", F.struct(F.lit(0).alias("kind"), "pid")))
            merged = materialise(union_polygons(parts, group="grp").groupBy(F.col("grp").alias("pid")).agg(F.flatten(F.sort_array(F.collect_list("rings"))).alias("grown")), "grown-places")
    own = own.select("vid", "to", F.struct("to", F.when(F.col("to").isNull(), F.col("cluster")).alias("c")).alias("g"))
    first = own.groupBy("g").agg(F.min("vid").alias("place"))
    own = own.join(first, "g").select("vid", "place", "to")
    left = vertices.join(own.select("vid"), "vid", "left_anti").select("vid", F.col("vid").alias("place"), none.alias("to"), F.lit(True).alias("alone"))
    of = materialise(own.withColumn("alone", F.lit(False)).unionByName(left), "place-vtx")
    if not of.limit(1).count():
        raise ValueError("no places")
    grouped = of.groupBy("place").agg(F.count(F.lit(1)).cast("int").alias("nb_vtx"), F.max("to").alias("to"), F.max(F.when(F.col("alone"), F.col("vid"))).alias("end_vtx"))
    radius = F.when(F.col("alone"), F.lit(1.0)).otherwise(F.lit(float(buffer)))
    ring = _hulls(of.filter("to is null").select(F.col("place").alias("key"), "vid", radius.alias("radius")), vertices)
    out = grouped.join(ring.withColumnRenamed("key", "place"), "place", "left").withColumn("rings", F.array("ring"))
    if given is not None:
        out = out.join(given.select(F.col("pid").alias("to"), F.col("rings").alias("own")), "to", "left")
        if merged is not None:
            out = out.join(merged.select(F.col("pid").alias("to"), "grown"), "to", "left").withColumn("own", F.coalesce("grown", "own"))
        out = out.withColumn("rings", F.coalesce("own", "rings"))
    places = out.select("place", F.element_at("rings", 1).alias("ring"), "rings", "nb_vtx", "end_vtx", F.col("to").isNotNull().alias("user_pl"))
    return places, of.select(F.col("vid").alias("vertex"), "place")


def attached(edges: DataFrame, places: DataFrame, place_vtx: DataFrame) -> DataFrame:
    """Edges with ``start_pl, end_pl`` and the polygons ``rs, re`` of both, without those that lie inside a place."""
    s = place_vtx.select(F.col("vertex").alias("start_vtx"), F.col("place").alias("start_pl"))
    t = place_vtx.select(F.col("vertex").alias("end_vtx"), F.col("place").alias("end_pl"))
    rings = places.select("place", F.col("rings") if "rings" in places.columns else F.array("ring").alias("rings"))
    e = edges.join(s, "start_vtx").join(t, "end_vtx")
    e = e.join(rings.withColumnsRenamed({"place": "start_pl", "rings": "rs"}), "start_pl").join(rings.withColumnsRenamed({"place": "end_pl", "rings": "re"}), "end_pl")
    return e.filter(~((F.col("start_pl") == F.col("end_pl")) & G.within_polygon("geom", "rs")))


def place_edges(edges: DataFrame, places: DataFrame, place_vtx: DataFrame, strict: bool = False) -> DataFrame:
    """Edges attached to places, cut by them: adds ``start_pl, end_pl, status`` and new ``length, degree, geom``.

    Edges inside a place go.  ``status`` is 1 if cutting by each end place leaves
    one part, 0 if more (then the last part is kept at the start, the first at the
    end), 2 if nothing was left and the edge keeps its geometry.  Degrees are of
    places; the loop rule compares places, or vertices if ``strict`` (then a loop
    between different vertices has a null degree).
    """
    e = materialise(attached(edges.drop("degree"), places, place_vtx), "place-edges")
    degree = e.select(F.explode(F.array("start_pl", "end_pl")).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("d"))
    e = e.join(degree.select(F.col("place").alias("start_pl"), F.col("d").alias("ds")), "start_pl").join(degree.select(F.col("place").alias("end_pl"), F.col("d").alias("de")), "end_pl")
    minus = G.line_minus_polygon()
    e = e.withColumn("ps", minus("geom", "rs")).withColumn("pe", minus("geom", "re"))
    e = e.withColumn("status", F.when((F.size("ps") != 1) | (F.size("pe") != 1), 0).otherwise(1))
    after = F.when(F.col("ds") > 1, F.element_at(F.filter("ps", lambda x: F.size(x) > 1), -1)).otherwise(F.col("geom"))
    e = e.withColumn("g1", F.when(F.size("ps") > 0, after).otherwise(F.when(F.col("ds") > 1, F.lit(None).cast(G.LINE)).otherwise(F.col("geom"))))
    e = e.withColumn("p2", minus(F.coalesce("g1", "geom"), "re"))
    cut_end = (F.col("de") > 1) & (F.col("start_pl") != F.col("end_pl"))
    e = e.withColumn("g2", F.when(F.col("g1").isNull(), F.col("g1")).when(cut_end, F.when(F.size("p2") > 0, F.element_at("p2", 1))).otherwise(F.col("g1")))
    e = e.withColumn("status", F.when(F.col("g2").isNull(), 2).otherwise(F.col("status"))).withColumn("geom", F.coalesce("g2", "geom"))
    loop = F.col("start_vtx") == F.col("end_vtx") if strict else F.col("start_pl") == F.col("end_pl")
    both = F.when(F.col("start_pl") != F.col("end_pl"), F.col("ds") + F.col("de") - 2)
    return e.select("fid", "name", "start_pl", "end_pl", "start_vtx", "end_vtx", "status", G.length("geom").alias("length"), F.when(loop, F.col("ds") - 2).otherwise(both).cast("int").alias("degree"), "geom")


def one_place_per_vertex(edges: DataFrame) -> DataFrame:
    """Place edges when every vertex is its own place and nothing is cut."""
    return edges.withColumn("start_pl", F.col("start_vtx")).withColumn("end_pl", F.col("end_vtx")).withColumn("status", F.lit(1))


def place_degrees(edges: DataFrame) -> DataFrame:
    """``place, degree``: edge ends at each place, so that a loop counts twice."""
    return edges.select(F.explode(F.array("start_pl", "end_pl")).alias("place")).groupBy("place").agg(F.count(F.lit(1)).cast("int").alias("degree"))


def edge_graph(edges: DataFrame, int_length: bool = True) -> DataFrame:
    """Undirected multigraph ``src, dst, length, fid`` of places; lengths are whole metres unless asked otherwise."""
    length = F.col("length").cast("int") if int_length else F.col("length")
    return edges.select(F.least("start_pl", "end_pl").alias("src"), F.greatest("start_pl", "end_pl").alias("dst"), length.alias("length"), "fid")
