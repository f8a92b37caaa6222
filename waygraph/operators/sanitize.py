"""Raw lines to a planar topology: snapping, cutting at crossings, merging, dropping short and loose parts.

Steps that are order-dependent when done one feature at a time are done for all
features at once, on connected components, so the result depends on the data only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waygraph.functions import geom as G
from waygraph.operators.components import connected_components
from waygraph.operators.topology import coordinate_key
from waygraph.plans.kernels import cell_join
from waygraph.plans.stages import materialise


def _pieces(lines: DataFrame, tag: str) -> DataFrame:
    """``fid<tag>, k<tag>, a<tag>, b<tag>, line<tag>``: the straight pieces of every line."""
    p = lines.select(F.col("fid").alias(f"fid{tag}"), F.posexplode(G.pieces("geom")).alias(f"k{tag}", "s"))
    return p.select(f"fid{tag}", f"k{tag}", F.col("s.a").alias(f"a{tag}"), F.col("s.b").alias(f"b{tag}"), F.array("s.a", "s.b").alias(f"line{tag}")).withColumn(f"id{tag}", F.struct(f"fid{tag}", f"k{tag}"))


def _meeting(lines: DataFrame, size: float) -> DataFrame:
    p, q = _pieces(lines, "1"), _pieces(lines, "2")
    meet = (F.col("fid1") < F.col("fid2")) & G.pieces_meet(F.col("a1"), F.col("b1"), F.col("a2"), F.col("b2"))
    return cell_join(p, q, "line1", "line2", size, 1e-6, meet, "id1", "id2")


def drop_unconnected(lines: DataFrame, size: float = 200.0) -> DataFrame:
    """Lines that meet another line."""
    m = _meeting(lines, size).select(F.explode(F.array("fid1", "fid2")).alias("fid")).distinct()
    return lines.join(m, "fid", "left_semi")


def drop_null(lines: DataFrame) -> DataFrame:
    """Lines with a geometry of two points or more."""
    return lines.filter("geom is not null and size(geom) > 1")


def snap(lines: DataFrame, distance: float) -> DataFrame:
    """Points within a distance of each other, directly or in a chain, become the one of least (x, y)."""
    pts = lines.select(F.explode("geom").alias("pt")).distinct().select(coordinate_key(F.col("pt")).alias("k"), "pt", F.array("pt").alias("l"))
    other = pts.select(F.col("k").alias("k2"), F.col("pt").alias("pt2"), F.col("l").alias("l2"))
    near = cell_join(pts, other, "l", "l2", max(distance * 4, 1.0), distance, (F.col("k") < F.col("k2")) & (G.distance(F.col("pt"), F.col("pt2")) <= distance), "k", "k2")
    cc = connected_components(near, "k", "k2")
    low = cc.join(pts.select(F.col("k").alias("id"), "pt"), "id")
    low = low.join(low.groupBy("component").agg(F.min("pt").alias("to")), "component").filter("pt <> to").select("pt", "to")
    rows = lines.select("fid", F.posexplode("geom").alias("i", "pt")).join(low, "pt", "left").select("fid", "i", F.coalesce("to", "pt").alias("pt"))
    g = rows.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("i", "pt"))).alias("x"))
    pts_of = F.transform("x", lambda s: s["pt"])
    clean = F.filter(pts_of, lambda p, i: (i == 0) | (p != F.get(pts_of, i - 1)))
    return lines.drop("geom").join(g.select("fid", clean.alias("geom")), "fid").filter("size(geom) > 1")


def overlapping_parts(lines: DataFrame, size: float = 200.0) -> DataFrame:
    """``fid1, fid2, a, b``: stretches that two lines share."""
    m = _meeting(lines, size)
    dx, dy = F.col("b1.x") - F.col("a1.x"), F.col("b1.y") - F.col("a1.y")
    n = dx * dx + dy * dy

    def along(p):
        return ((p["x"] - F.col("a1.x")) * dx + (p["y"] - F.col("a1.y")) * dy) / n

    def off(p):
        return F.abs((p["x"] - F.col("a1.x")) * dy - (p["y"] - F.col("a1.y")) * dx)

    t1, t2 = along(F.col("a2")), along(F.col("b2"))
    lo, hi = F.greatest(F.lit(0.0), F.least(t1, t2)), F.least(F.lit(1.0), F.greatest(t1, t2))
    m = m.filter((n > 0) & (off(F.col("a2")) < 1e-9 * F.sqrt(n)) & (off(F.col("b2")) < 1e-9 * F.sqrt(n)) & (hi > lo))
    return m.select("fid1", "fid2", G.point(F.col("a1.x") + lo * dx, F.col("a1.y") + lo * dy).alias("a"), G.point(F.col("a1.x") + hi * dx, F.col("a1.y") + hi * dy).alias("b"))


def crossing_points(lines: DataFrame, size: float = 200.0) -> DataFrame:
    """``pt``: where lines cross, where shared stretches end, and where lines end."""
    m = _meeting(lines, size)
    x = m.select(G.crossing(F.col("a1"), F.col("b1"), F.col("a2"), F.col("b2")).alias("pt")).filter("pt is not null")
    o = overlapping_parts(lines, size).select(F.explode(F.array("a", "b")).alias("pt"))
    e = lines.select(F.explode(F.array(G.start_point("geom"), G.end_point("geom"))).alias("pt"))
    grid = 1e-6
    r = F.struct((F.round(F.col("pt.x") / grid) * grid).alias("x"), (F.round(F.col("pt.y") / grid) * grid).alias("y"))
    return x.union(o).union(e).select(r.alias("k"), "pt").groupBy("k").agg(F.min("pt").alias("pt")).select("pt")


def cut_at(lines: DataFrame, points: DataFrame, tolerance: float = G.ON_LINE, size: float = 200.0) -> DataFrame:
    """``fid, part, name, geom``: sub-lines between the points on a line, in order."""
    p = points.select("pt", F.array("pt").alias("pl"), coordinate_key(F.col("pt")).alias("pk"))
    on = cell_join(lines.select("fid", "geom"), p, "geom", "pl", size, tolerance, G.line_distance(F.col("pt"), F.col("geom")) <= tolerance, "fid", "pk")
    at = on.select("fid", G.locate(F.col("geom"), F.col("pt")).alias("t"))
    ends = lines.select("fid", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    at = at.union(ends).select("fid", F.round("t", 9).alias("t")).distinct()
    nxt = at.withColumn("u", F.lead("t").over(Window.partitionBy("fid").orderBy("t"))).filter("u is not null")
    name = F.col("name") if "name" in lines.columns else F.lit(None).cast("string").alias("name")
    out = nxt.join(lines.select("fid", name, "geom"), "fid").select("fid", "name", "t", G.substring(F.col("geom"), F.col("t"), F.col("u")).alias("geom"))
    return out.withColumn("part", F.row_number().over(Window.partitionBy("fid").orderBy("t"))).drop("t")


def distinct_parts(parts: DataFrame, grid: float = 1e-6) -> DataFrame:
    """Geometrically equal parts, in either direction, once: that of the least line id."""
    key = G.canonical(G.snap_to_grid(F.col("geom"), grid))
    return parts.withColumn("k", key).groupBy("k").agg(F.min(F.struct("fid", "part", "name", "geom")).alias("s")).select("s.*")


def _ended(parts: DataFrame, grid: float = 1e-6) -> DataFrame:
    """Parts with a unique id and the keys of their ends on a grid."""
    g = G.snap_to_grid(F.col("geom"), grid)
    d = parts.withColumn("geom", g)
    return d.select(F.xxhash64("fid", "part").alias("id"), "fid", "name", "geom", coordinate_key(G.start_point("geom")).alias("s"), coordinate_key(G.end_point("geom")).alias("e"))


def merge_through(parts: DataFrame) -> DataFrame:
    """``fid, name, geom``: parts joined through points where exactly two ends meet; closed rings start at a junction; rings without one go."""
    d = materialise(_ended(parts), "parts")
    ends = d.select("id", F.explode(F.array("s", "e")).alias("v"))
    two = ends.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).filter("n = 2")
    junction = ends.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n <> 2").select("v")
    cc = connected_components(two.filter("a <> b"), "a", "b", d, "id")
    g = d.join(cc, "id").groupBy("component").agg(F.min("fid").alias("fid"), F.min_by("name", "fid").alias("name"), F.sort_array(F.collect_list("geom")).alias("lines"))
    m = g.select("component", "name", "fid", F.posexplode(G.line_merge()("lines")).alias("k", "geom"))
    closed = G.start_point("geom") == G.end_point("geom")
    open_ = m.filter(~closed)
    ring = m.filter(closed).select("component", "k", "fid", "name", "geom", F.posexplode("geom").alias("i", "pt")).join(junction, coordinate_key(F.col("pt")) == F.col("v"))
    first = ring.groupBy("component", "k").agg(F.min("i").alias("i"), F.first("fid").alias("fid"), F.first("name").alias("name"), F.first("geom").alias("geom"))
    turned = F.when(F.col("i") == 0, F.col("geom")).otherwise(F.concat(F.slice("geom", F.col("i") + 1, F.size("geom")), F.slice("geom", F.lit(2), F.col("i"))))
    rings = first.select("component", "k", "fid", "name", turned.alias("geom"))
    out = open_.select("component", "k", "fid", "name", "geom").unionByName(rings)
    return out.select(F.xxhash64("component", "k").alias("fid"), "name", "geom")


def covering_names(lines: DataFrame, sources: DataFrame, tolerance: float = 0.5, size: float = 200.0) -> DataFrame:
    """``fid, geom`` of clean lines with the ``name`` of an input line (``fid, name, geom``) that covers them within tolerance.

    Of several the input line of the smallest id; a line that no single named input line covers has no name.
    """
    s = sources.filter("name is not null").select(F.col("fid").alias("sid"), F.col("name").alias("sname"), F.col("geom").alias("sgeom"))
    own = lines.select("fid", "geom").withColumn("box", G.bounds(F.col("geom")))
    near = G.box_within(F.col("box"), F.col("sbox"), tolerance) & G.covered("geom", "sgeom", tolerance)
    hits = cell_join(own, s.withColumn("sbox", G.bounds(F.col("sgeom"))), "geom", "sgeom", size, tolerance, near, "fid", "sid")
    best = hits.groupBy("fid").agg(F.min(F.struct("sid", "sname")).alias("s")).select("fid", F.col("s.sname").alias("name"))
    return lines.drop("name").join(best, "fid", "left").select("fid", "name", "geom")


def collapse_short(lines: DataFrame, shortest: float) -> DataFrame:
    """Edges shorter than the minimum go; the vertices they link become one, at the centroid of their midpoints."""
    if shortest <= 0:
        return lines
    d = materialise(lines.withColumn("s", coordinate_key(G.start_point("geom"))).withColumn("e", coordinate_key(G.end_point("geom"))).withColumn("len", G.length("geom")), "short")
    short = d.filter(F.col("len") < shortest)
    cc = materialise(connected_components(short, "s", "e"), "short-cc")
    mid = short.join(cc.withColumnRenamed("id", "s"), "s").withColumn("m", G.interpolate(F.col("geom"), 0.5)).groupBy("component").agg(F.avg("m.x").alias("x"), F.avg("m.y").alias("y"))
    to = cc.join(mid, "component").select("id", G.point(F.col("x"), F.col("y")).alias("p"))
    rest = d.filter(F.col("len") >= shortest).join(to.select(F.col("id").alias("s"), F.col("p").alias("ps")), "s", "left").join(to.select(F.col("id").alias("e"), F.col("p").alias("pe")), "e", "left")
    n = F.size("geom")
    moved = F.transform("geom", lambda p, i: F.when((i == 0) & F.col("ps").isNotNull(), F.col("ps")).when((i == n - 1) & F.col("pe").isNotNull(), F.col("pe")).otherwise(p))
    return rest.select("fid", "name", moved.alias("geom"))


def largest_part(lines: DataFrame) -> DataFrame:
    """Lines of the connected part with most lines, ties by least vertex."""
    d = lines.withColumn("s", coordinate_key(G.start_point("geom"))).withColumn("e", coordinate_key(G.end_point("geom")))
    d = materialise(d, "parts")
    cc = connected_components(d, "s", "e", d.select("s"), "s")
    own = materialise(d.join(cc.withColumnRenamed("id", "s"), "s"), "parts-cc")
    top = own.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return own.join(top.select("component"), "component", "left_semi").select("fid", "name", "geom")


def sanitize(lines: DataFrame, snap_distance: float = 0.2, min_edge_length: float = 4.0, keep_names: bool = True) -> DataFrame:
    """``fid, name, geom`` of a planar, connected network; an error if snapping is off or nothing is left.

    A name is that of an input line that covers the clean line, within the snap distance;
    without names lines are simplified to 0.1 m.
    """
    if snap_distance <= 0:
        raise ValueError("the snap distance must be above 0")
    if "name" not in lines.columns:
        lines = lines.withColumn("name", F.lit(None).cast("string"))
    given = drop_null(lines.select("fid", "name", "geom"))
    d = materialise(drop_unconnected(given), "connected")
    d = materialise(snap(d, snap_distance), "snapped")
    parts = materialise(distinct_parts(cut_at(d, materialise(crossing_points(d), "points"))), "cut")
    merged = materialise(merge_through(parts.filter(G.length("geom") > 1e-6)), "merged")
    out = largest_part(collapse_short(merged, min_edge_length))
    if keep_names:
        out = covering_names(materialise(out, "unnamed"), given, snap_distance + G.ON_LINE)
    else:
        out = out.withColumn("geom", G.simplify(0.1)("geom"))
    out = materialise(drop_null(out), "sanitized")
    if not out.limit(1).count():
        raise ValueError("nothing is left")
    return out


def bounding_box(lines: DataFrame) -> DataFrame:
    """``x0, y0, x1, y1`` of all lines."""
    b = lines.select(G.bounds(F.col("geom")).alias("b"))
    return b.agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))


