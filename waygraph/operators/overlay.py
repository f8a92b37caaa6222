"""Overlay of polygons: union by noding, classing and chaining pieces of their boundaries.

A polygon is a list of rings; a point is inside if a ray from it crosses the rings an odd
number of times, so holes and several parts need no type of their own.  Outer rings go
counter-clockwise and holes clockwise, so the inside lies to the left of every piece.

Every step is a join or an aggregate over pieces: boundaries are cut where they meet
(candidates by grid cell), pieces inside another polygon go, of pieces that coincide one
stays if all have the inside on the same side and none otherwise, and what is left is
linked into rings, whose order is found by pointer jumping.  Only a finished ring is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waygraph.functions import geom as G
from waygraph.operators.components import connected_components
from waygraph.plans.kernels import cell_join, list_ranks, points_in
from waygraph.plans.stages import materialise

#: Coordinates of the overlay are multiples of this.
GRID = 1e-6


def _snapped(p: Column, grid: float) -> Column:
    return G.point(F.round(p["x"] / grid) * grid, F.round(p["y"] / grid) * grid)


def _boundary(polygons: DataFrame, grid: float) -> DataFrame:
    """``grp, pid, r, k, a, b``: directed straight pieces of all rings, on the grid."""
    rings = polygons.select("grp", "pid", F.posexplode(G.oriented("rings")).alias("r", "ring"))
    p = rings.select("grp", "pid", "r", F.posexplode(G.pieces("ring")).alias("k", "s"))
    p = p.select("grp", "pid", "r", "k", _snapped(F.col("s.a"), grid).alias("a"), _snapped(F.col("s.b"), grid).alias("b"))
    return p.filter("a <> b").withColumns({"id": F.struct("grp", "pid", "r", "k"), "line": F.array("a", "b")})


def noded(pieces: DataFrame, size: float, grid: float = GRID) -> DataFrame:
    """``grp, pid, a, b``: pieces (``grp, pid, id, a, b, line``) cut where pieces of other polygons of their group cross, touch or overlap them."""
    one, two = (pieces.select(*[F.col(c).alias(f"{c}{n}") for c in ("grp", "pid", "id", "a", "b", "line")]) for n in (1, 2))
    meet = F.col("grp1").eqNullSafe(F.col("grp2")) & (F.col("pid1") != F.col("pid2")) & G.pieces_meet(*[F.col(c) for c in ("a1", "b1", "a2", "b2")])
    pairs = cell_join(one, two, "line1", "line2", size, grid, meet, "id1", "id2")
    # the crossing of two pieces is computed in one order, so that both get the same point
    x = F.when(F.col("id1") < F.col("id2"), G.crossing(F.col("a1"), F.col("b1"), F.col("a2"), F.col("b2"))).otherwise(G.crossing(F.col("a2"), F.col("b2"), F.col("a1"), F.col("b1")))
    on = [F.when(G.piece_distance(F.col(p), F.col("a1"), F.col("b1")) <= grid, F.col(p)) for p in ("a2", "b2")]
    touched = F.coalesce(on[0], on[1], _snapped(x, grid))
    both = F.when(on[0].isNotNull() & on[1].isNotNull(), F.array("a2", "b2")).otherwise(F.array(touched))
    cuts = pairs.select(F.col("id1").alias("id"), F.explode(both).alias("pt")).filter("pt is not null")
    ends = pieces.select("id", F.explode(F.array("a", "b")).alias("pt"))
    at = cuts.unionByName(ends).distinct().join(pieces.select("id", "a", "b"), "id")
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    t = (F.col("pt.x") - F.col("a.x")) * dx + (F.col("pt.y") - F.col("a.y")) * dy
    w = Window.partitionBy("id").orderBy(t, "pt")
    out = at.select("id.grp", "id.pid", F.col("pt").alias("from"), F.lead("pt").over(w).alias("to"))
    return out.filter("to is not null").select("grp", "pid", F.col("from").alias("a"), F.col("to").alias("b"))


def _outline(polygons: DataFrame, sub: DataFrame, size: float) -> DataFrame:
    """``grp, a, b, pid``: directed pieces between a covered and an uncovered side, once each."""
    ahead = F.col("a") < F.col("b")
    sub = sub.select("grp", "pid", ahead.alias("ahead"), F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("hi"))
    sub = materialise(sub, "overlay-pieces")
    key = ["grp", "lo", "hi"]
    one = sub.groupBy(*key).agg(F.min("ahead").alias("ahead"), F.max("ahead").alias("other"), F.min("pid").alias("pid")).filter("ahead = other")
    mid = G.point((F.col("lo.x") + F.col("hi.x")) / 2, (F.col("lo.y") + F.col("hi.y")) / 2)
    one = materialise(one.select(*key, "ahead", "pid", F.array(mid).alias("at"), F.struct(*key).alias("edge")), "overlay-outline")
    bodies = polygons.select(F.col("grp").alias("of"), F.col("pid").alias("by"), "rings", F.flatten("rings").alias("around"), F.struct("grp", "pid").alias("body"))
    test = F.col("grp").eqNullSafe(F.col("of")) & G.in_polygon(F.col("at")[0], F.col("rings"))
    inside = cell_join(one.select("edge", *key, "at"), bodies, "at", "around", size, 0.0, test, "edge", "body").select("edge", "by")
    inside = inside.join(sub.select(F.struct(*key).alias("edge"), F.col("pid").alias("by")), ["edge", "by"], "left_anti")
    kept = one.join(inside.select("edge"), "edge", "left_anti")
    return kept.select("grp", F.when(F.col("ahead"), F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(F.col("ahead"), F.col("hi")).otherwise(F.col("lo")).alias("b"), "pid")


def chained(edges: DataFrame) -> DataFrame:
    """``ring_id, grp, pid, ring``: directed pieces (``grp, a, b, pid``) with the inside to their left as closed rings.

    Where several rings touch, a piece goes on with the first one clockwise from where
    it came, which bounds the same part of the inside.
    """
    e = materialise(edges.withColumn("e", F.monotonically_increasing_id()), "overlay-edges")
    node = F.struct("grp", F.col("b").alias("at"))
    out = e.select(F.struct("grp", F.col("a").alias("at")).alias("node"), F.col("e").alias("f"), G.azimuth(F.col("a"), F.col("b")).alias("leaves"))
    turn = F.col("leaves") - G.azimuth(F.col("b"), F.col("a"))
    turn = F.when(turn <= 1e-12, turn + 2 * F.pi()).otherwise(turn)
    nxt = materialise(e.withColumn("node", node).join(out, "node").groupBy("e").agg(F.min_by("f", turn).alias("next")), "overlay-next")
    cc = connected_components(nxt, "e", "next", e, "e")
    links = nxt.join(cc.withColumnRenamed("id", "e"), "e").select(F.col("e").alias("id"), F.when(F.col("next") != F.col("component"), F.col("next")).alias("next"), "component")
    links = materialise(links, "overlay-links")
    ranks = list_ranks(links).join(links.select("id", "component"), "id")
    rows = ranks.join(e, F.col("id") == F.col("e")).groupBy(F.col("component").alias("ring_id")).agg(F.first("grp").alias("grp"), F.min("pid").alias("pid"), F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("o"), "a"))).alias("s"))
    corners = F.transform("s", lambda s: s["a"])
    return rows.select("ring_id", "grp", "pid", F.concat(corners, F.array(F.element_at(corners, 1))).alias("ring"))


def union_polygons(polygons: DataFrame, size: float = 200.0, grid: float = GRID, group: str | None = None) -> DataFrame:
    """``part, rings, area``: the connected parts of the union of ``pid, rings``, or with ``group`` of the union of each group.

    ``part`` is the smallest pid on the outer ring, ``rings`` its outer ring and holes.
    Parts that touch in points only stay apart.  Coordinates are rounded to ``grid``;
    null and empty polygons are left out, equal ones count once.  ``size`` is the cell of
    the joins and should be about the size of a polygon.  With ``group`` its column is returned too.
    """
    grp = F.col(group) if group else F.lit(0).cast("long")
    own = polygons.select(grp.alias("grp"), "pid", G.oriented("rings").alias("rings")).filter("size(rings) > 0")
    own = own.withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: _snapped(p, grid))))
    own = materialise(own.groupBy("grp", "rings").agg(F.min("pid").alias("pid")), "overlay")
    sub = noded(materialise(_boundary(own, grid), "overlay-boundary"), size, grid)
    rings = materialise(chained(_outline(own, sub, size)).withColumn("area", G.ring_area("ring")), "overlay-rings")
    outer = rings.filter("area > 0")
    hole = rings.filter("area < 0").select(F.col("ring_id").alias("hole"), "grp", F.col("ring").alias("inner"))
    middle = G.point((F.col("inner")[0]["x"] + F.col("inner")[1]["x"]) / 2, (F.col("inner")[0]["y"] + F.col("inner")[1]["y"]) / 2)
    around = points_in(hole.select(F.col("hole").alias("id"), "grp", middle.alias("pt")), outer.select(F.col("ring_id").alias("pid"), "grp", F.array("ring").alias("rings")), size)
    of = around.join(outer.select(F.col("ring_id").alias("pid"), "area"), "pid").groupBy(F.col("id").alias("hole")).agg(F.min_by("pid", "area").alias("ring_id"))
    of = of.join(hole.select("hole", "inner"), "hole")
    holes = of.groupBy("ring_id").agg(F.sort_array(F.collect_list("inner")).alias("holes"))
    out = outer.join(holes, "ring_id", "left").select(*([F.col("grp").alias(group)] if group else []), F.col("pid").alias("part"), F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(G.MLINE))).alias("rings"))
    return out.withColumn("area", G.polygon_area("rings"))


def capsules(lines: DataFrame, radius: float, quad_segs: int = 8, key: str = "fid") -> DataFrame:
    """``key, pid, rings``: around every piece of every line (``key, geom``) the polygon of points within ``radius``."""
    p = lines.select(key, F.posexplode(G.pieces("geom")).alias("k", "s")).filter("s.a <> s.b")
    return p.select(key, F.col("k").alias("pid"), F.array(G.capsule_ring(F.col("s.a"), F.col("s.b"), radius, quad_segs)).alias("rings"))


def buffers(lines: DataFrame, radius: float, quad_segs: int = 8, key: str = "fid") -> DataFrame:
    """``key, rings, area``: the polygon around each line (``key, geom``) of points within ``radius``, its ends and bends rounded by corners."""
    return union_polygons(capsules(lines, radius, quad_segs, key), max(1.0, 8 * radius), group=key).drop("part")


def overlapping(first: DataFrame, second: DataFrame, size: float = 200.0) -> DataFrame:
    """``pid1, pid2``: polygons of two tables (``pid, rings``) that share a point."""
    def ringed(df, n):
        return df.select(F.col("pid").alias(f"pid{n}"), F.posexplode("rings").alias(f"r{n}", f"ring{n}"), F.col("rings").alias(f"rings{n}"))

    a, b = ringed(first, 1).withColumn("id1", F.struct("pid1", "r1")), ringed(second, 2).withColumn("id2", F.struct("pid2", "r2"))
    cross = F.exists(G.pieces("ring1"), lambda s: F.exists(G.pieces("ring2"), lambda t: G.pieces_meet(s["a"], s["b"], t["a"], t["b"])))
    within = G.in_polygon(F.col("ring1")[0], F.col("rings2")) | G.in_polygon(F.col("ring2")[0], F.col("rings1"))
    return cell_join(a, b, "ring1", "ring2", size, 0.0, cross | within, "id1", "id2").select("pid1", "pid2").distinct()
