"""Polygon overlay, cover tests, list ranking and routing against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygraph.functions import geom as G
from waygraph.operators import overlay
from waygraph.plans.kernels import list_ranks

POLY = f"pid long, rings {G.MLINE}"


def box(x0, y0, x1, y1, hole=False):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return [{"x": float(x), "y": float(y)} for x, y in (ring[::-1] if hole else ring)]


def flood(cells, steps):
    """Connected parts of a set of cells."""
    parts, left = [], set(cells)
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            x, y = todo.pop()
            for dx, dy in steps:
                c = (x + dx, y + dy)
                if c in left:
                    left.remove(c)
                    part.add(c)
                    todo.append(c)
        parts.append(part)
    return parts


FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]


def by_cells(boxes):
    """(area, rings) of the parts of a union of integer boxes, and holes as parts of the rest that do not reach the outside."""
    cells = {(x, y) for own in boxes for x0, y0, x1, y1, add in own for x in range(x0, x1) for y in range(y0, y1) if add}
    out = []
    for part in flood(cells, FOUR):
        xs, ys = [c[0] for c in part], [c[1] for c in part]
        around = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)} - part
        out.append((len(part), len(flood(around, EIGHT))))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_union_of_boxes(spark, seed):
    """Overlapping, touching, equal and nested boxes with shared edges and corners: areas and rings by counting cells."""
    g = random.Random(seed)
    boxes = []
    for _ in range(45):
        x, y = g.randrange(40), g.randrange(40)
        boxes.append([(x, y, x + g.randrange(1, 9), y + g.randrange(1, 9), True)])
    boxes += boxes[:3]
    rows = [(k, [box(*b[:4]) for b in own]) for k, own in enumerate(boxes)]
    got = overlay.union_polygons(spark.createDataFrame([*rows, (99, None), (98, [])], POLY), 5.0).collect()
    assert sorted((round(r.area), len(r.rings)) for r in got) == by_cells(boxes)


def test_union_with_holes_and_parts(spark):
    """A frame, its hole partly filled, an island in it and a multi-polygon; clockwise input rings are turned."""
    frame = [box(0, 0, 20, 20, hole=True), box(5, 5, 15, 15)]  # both rings the wrong way round
    island = [box(8, 8, 10, 10)]
    two = [box(30, 0, 33, 3), box(40, 0, 43, 3)]
    bridge = [box(33, 1, 40, 2)]
    rows = [(1, frame), (2, island), (3, two), (4, bridge)]
    got = sorted((r.part, round(r.area, 6), len(r.rings)) for r in overlay.union_polygons(spark.createDataFrame(rows, POLY), 10.0).collect())
    assert got == [(1, 300.0, 2), (2, 4.0, 1), (3, 25.0, 1)]
    filled = rows[:1] + [(5, [box(4, 4, 16, 16)])]
    assert [(round(r.area, 6), len(r.rings)) for r in overlay.union_polygons(spark.createDataFrame(filled, POLY), 10.0).collect()] == [(400.0, 1)]


def contains(rings, p):
    inside = False
    for ring in rings:
        for a, b in zip(ring, ring[1:]):
            if (a["y"] > p[1]) != (b["y"] > p[1]) and p[0] < (b["x"] - a["x"]) * (p[1] - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                inside = not inside
    return inside


def test_union_of_discs(spark):
    """Discs as polygons: random points are in the union exactly if they are in a disc."""
    g = random.Random(4)
    centres = [(g.uniform(0, 30), g.uniform(0, 30)) for _ in range(40)]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(centres)], "pid long, x double, y double")
    discs = df.select("pid", F.array(G.buffer_ring(G.point(F.col("x"), F.col("y")), 3.0, 6)).alias("rings")).collect()
    union = overlay.union_polygons(spark.createDataFrame(discs, POLY), 6.0).collect()
    for _ in range(4000):
        p = (g.uniform(-4, 34), g.uniform(-4, 34))
        assert sum(contains(r.rings, p) for r in union) == any(contains(d.rings, p) for d in discs)


def test_groups_and_line_buffers(spark):
    """Each group has its own union; a buffer holds exactly the points near its line, up to the corners of its round ends."""
    rows = [("a", 1, [box(0, 0, 2, 2)]), ("a", 2, [box(1, 1, 3, 3)]), ("b", 1, [box(0, 0, 2, 2)])]
    got = overlay.union_polygons(spark.createDataFrame(rows, "g string, " + POLY), 2.0, group="g").collect()
    assert sorted((r.g, round(r.area, 6)) for r in got) == [("a", 7.0), ("b", 4.0)]
    line = [(0.0, 0.0), (40.0, 0.0), (40.0, 30.0), (5.0, 4.0)]
    df = spark.createDataFrame([(7, [{"x": x, "y": y} for x, y in line])], f"fid long, geom {G.LINE}")
    (b,) = overlay.buffers(df, 3.0, 16).collect()
    g = random.Random(5)

    def away(p):
        best = 1e9
        for (ax, ay), (bx, by) in zip(line, line[1:]):
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = max(0, min(1, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / n))
            best = min(best, ((p[0] - ax - t * (bx - ax)) ** 2 + (p[1] - ay - t * (by - ay)) ** 2) ** 0.5)
        return best

    for _ in range(3000):
        p = (g.uniform(-5, 45), g.uniform(-5, 35))
        if not 2.98 < away(p) <= 3.0:
            assert contains(b.rings, p) == (away(p) <= 3.0)


def test_cover(spark):
    """Intervals decide what five samples a piece cannot: a bump between the samples, gaps, ends that stick out."""
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    straight = line((0, 0), (200, 0))
    cases = [
        (straight, line((0, 0.9), (200, -0.9)), True), (straight, line((0, 0), (60, 0), (65, 3), (70, 0), (200, 0)), False),
        (line((0, 0), (60, 0), (65, 3), (70, 0), (200, 0)), straight, False), (straight, line((0, 0), (199.5, 0)), True), (straight, line((0, 0), (198.5, 0)), False),
        (straight, line((200, 1), (0, 1)), True), (straight, line((0, 1.01), (200, 1.01)), False), (line((5, 0.5), (5, 0.5)), straight, True), (line((5, 2), (5, 2)), straight, False),
        (straight, line((0, 0), (0, 0), (200, 0)), True), (line((0, 0), (100, 80)), line((0, 0), (50, 40), (50, 40), (100, 80)), True),
    ]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], f"k int, a {G.LINE}, b {G.LINE}")
    assert [r.ok for r in df.select("k", G.covered("a", "b", 1.0).alias("ok")).orderBy("k").collect()] == [c for _, _, c in cases]
    # random lines against a dense sample
    g = np.random.default_rng(3)
    rows = []
    for k in range(150):
        a = np.cumsum(g.uniform(-10, 14, (4, 2)), axis=0)
        rows.append((k, a, a + g.uniform(-1.3, 1.3, a.shape) * g.choice([0.5, 1.0])))
    df = spark.createDataFrame([(k, line(*a), line(*b)) for k, a, b in rows], f"k int, a {G.LINE}, b {G.LINE}")
    got = {r.k: r.ok for r in df.select("k", G.covered("a", "b", 1.0).alias("ok")).collect()}
    for k, a, b in rows:
        t = np.linspace(0, 1, 400)[:, None]
        far = 0.0
        for p, q in zip(a, a[1:]):
            x = p + t * (q - p)
            d = np.min([np.linalg.norm(x - (c + np.clip(((x - c) @ (e - c)) / ((e - c) @ (e - c)), 0, 1)[:, None] * (e - c)), axis=1) for c, e in zip(b, b[1:])], axis=0)
            far = max(far, d.max())
        if abs(far - 1) > 1e-3:
            assert got[k] == (far < 1)


def test_polygon_tests(spark):
    """Within, meeting, difference and text of polygons that are concave, have holes and several parts."""
    u = "POLYGON ((0 0, 30 0, 30 30, 20 30, 20 10, 10 10, 10 30, 0 30, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2))"
    two = "MULTIPOLYGON (((0 0, 0 9, 9 9, 9 0, 0 0)), ((20 0, 29 0, 29 9, 20 9, 20 0), (22 2, 24 2, 24 4, 22 4, 22 2)))"
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    lines = [line((5, 20), (25, 20)), line((5, 20), (5, 5), (25, 5), (25, 20)), line((1, 3), (6, 3)), line((12, 15), (18, 15)), line((1, 1), (28, 1)), line((40, 0), (50, 0)), line((12, 15), (18, 5))]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], f"k int, geom {G.LINE}").crossJoin(spark.createDataFrame([(u,)], "t string")).withColumn("rings", G.parse_wkt_polygon("t"))
    got = df.select("k", G.within_polygon("geom", "rings").alias("w"), G.meets_polygon("geom", "rings").alias("m"), F.aggregate(G.line_minus_polygon()("geom", "rings"), F.lit(0.0), lambda s, x: s + G.length(x)).alias("out"), G.polygon_area(F.col("rings")).alias("area")).orderBy("k").collect()
    assert [r.w for r in got] == [False, True, False, False, True, False, False]
    assert [r.m for r in got] == [True, True, True, False, True, False, True]
    assert [round(r.out, 6) for r in got] == [10.0, 0.0, 2.0, 6.0, 0.0, 10.0, round((6**2 + 10**2) ** 0.5 / 2, 6)] and {r.area for r in got} == {696.0}
    text = spark.createDataFrame([(two,), (u,), ("POINT (1 2)",), (None,)], "t string").withColumn("rings", G.parse_wkt_polygon("t"))
    back = text.withColumn("again", G.parse_wkt_polygon(G.wkt_polygon("rings"))).collect()
    assert [None if r.rings is None else len(r.rings) for r in back] == [3, 2, None, None]
    assert all(r.rings == r.again for r in back)
    areas = text.filter("rings is not null").select(G.polygon_area(F.col("rings")).alias("a")).collect()
    assert [r.a for r in areas] == [158.0, 696.0]


def test_list_ranks(spark):
    """Chains of 1, 2 and 100,000 links."""
    n = 100_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("id"), F.when(F.col("id") < n - 1, ((F.col("id") + 1) * 7919) % n).alias("next"))
    more = spark.createDataFrame([(-1, None), (-2, -3), (-3, None)], "id long, next long")
    out = list_ranks(df.unionByName(more))
    assert out.filter("id < 0").orderBy("id").collect() == [(-3, -3, 0), (-2, -3, 1), (-1, -1, 0)]
    own = out.filter("id >= 0")
    assert own.select("last").distinct().count() == 1
    place = {(k * 7919) % n: n - 1 - k for k in range(n)}
    got = {r.id: r["rank"] for r in own.select("id", "rank").collect()}
    assert got == place


def test_places_united_with_polygons(spark):
    """Overlapping input polygons are one place; a cluster joins it if it overlaps it and an edge leads into it, and then the polygon is the union."""
    from waygraph.operators import places

    at = {1: (0, 0), 2: (3, 0), 3: (10, 0), 4: (20, 0), 5: (10, 12), 6: (13, 12), 7: (28, 0), 8: (31, 0), 9: (60, 60)}
    v = spark.createDataFrame([(k, 1 if k == 9 else 2, {"x": float(x), "y": float(y)}) for k, (x, y) in at.items()], f"vid long, degree int, pt {G.PT}")
    e = spark.createDataFrame([(2, 3), (3, 5), (1, 2), (7, 8), (6, 9)], "start_vtx long, end_vtx long")
    given = spark.createDataFrame([(1, [box(5, -5, 15, 5)]), (2, [box(14, -5, 25, 5)]), (3, [box(100, 100, 101, 101)])], POLY)
    p, of = places.build_places(v, e, 4.0, given)
    assert {(r.vertex, r.place) for r in of.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 7), (8, 7), (9, 9)}
    rows = {r.place: r for r in p.collect()}
    assert {(k, r.nb_vtx, r.user_pl, r.end_vtx) for k, r in rows.items()} == {(1, 4, True, None), (5, 2, False, None), (7, 2, False, None), (9, 1, False, 9)}
    g = random.Random(6)
    for _ in range(2000):
        x, y = g.uniform(-6, 27), g.uniform(-7, 7)
        away = (max(0 - x, x - 3, 0) ** 2 + y * y) ** 0.5
        if not 3.95 < away < 4.01:
            assert contains(rows[1].rings, (x, y)) == (away < 4 or (5 < x < 25 and -5 < y < 5))
    # from the file alone nothing is united
    _, of = places.build_places(v, e, 4.0, given, file_only=True)
    assert {(r.vertex, r.place) for r in of.collect()} == {(k, k) for k in at}


def test_points_in_a_long_polygon(spark, monkeypatch):
    """A polygon over many cells is never copied to them, and its points are those of the plain test."""
    from waygraph.plans import kernels

    made = []
    plain = kernels.with_cells
    monkeypatch.setattr(kernels, "with_cells", lambda df, *a: made.append(plain(df, *a)) or made[-1])
    comb = [(0.0, 0.0), (400.0, 0.0)] + [p for k in range(20, 0, -1) for p in ((20.0 * k, 300.0), (20.0 * k - 10, 5.0))] + [(0.0, 300.0), (0.0, 0.0)]
    hole = [(100.0, 1.0), (100.0, 3.0), (200.0, 3.0), (200.0, 1.0), (100.0, 1.0)]
    poly = spark.createDataFrame([(1, 0, [[{"x": x, "y": y} for x, y in r] for r in (comb, hole)])], "pid long, grp int, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([(i, 0, {"x": (i * 37) % 401 + 0.25, "y": (i * 53) % 301 + 0.25}) for i in range(300)] + [(900, 0, {"x": 150.0, "y": 2.0})], "id long, grp int, pt struct<x:double,y:double>")
    got = {r.id for r in kernels.points_in(pts, poly, 10.0).collect()}
    want = {r.id for r in pts.crossJoin(poly.select("rings")).filter(G.in_polygon(F.col("pt"), F.col("rings"))).collect()}
    assert got == want and 900 not in got and 50 < len(got) < 300
    assert made[1].count() == 0  # rows of a polygon by cell: 1,200 before
