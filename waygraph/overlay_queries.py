"""Registered queries of polygon overlay, exact cover, sanitising steps, ways on real places and attributes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.functions import geom as G
from waygraph.further_queries import polygons
from waygraph.graph_queries import ST, _graph, requests, simple, street
from waygraph.operators import diff, indicators, overlay, paths, places, sanitize, select
from waygraph.operators import ways as W
from waygraph.operators.graph import centrality as C
from waygraph.operators.graph import structure as V
from waygraph.plans.kernels import potentials
from waygraph.plans.stages import materialise, shared_dir
from waygraph.queries import ANGLES, BOTH, BY_ANGLE, CLUSTER, WAYS, _recursive, named_ways, network, searched, seg
from waygraph.sources import fixtures as X
from waygraph.sources import io

# Polygons

#: A box around every vertex, in units of 10 m, of up to 6 units to each side of its lattice point.
BOXES = "vb AS (SELECT id, 10*(id % 30) - (id*7) % 5 - 2 AS x0, 10*(id % 30) + (id*11) % 5 + 2 AS x1, 10*(id // 30) - (id*13) % 5 - 2 AS y0, 10*(id // 30) + (id*17) % 5 + 2 AS y1 FROM dg)"


def boxes(spark, sf_dir) -> DataFrame:
    """``pid, rings``: a box around every vertex; many overlap their neighbours."""
    v = V.nodes(street(spark, sf_dir)).select(F.col("id").alias("pid"))
    col, row = F.col("pid") % 30, F.floor(F.col("pid") / 30)
    x0, x1, y0, y1 = (100 * c + s * 10 * ((F.col("pid") * m) % 5 + 2) for c, s, m in ((col, -1, 7), (col, 1, 11), (row, -1, 13), (row, 1, 17)))
    return v.select("pid", F.array(F.array(*[G.point(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])).alias("rings"))


#: Unions in SQL: boxes that share area or part of an edge hang together; a part of F cells, E pairs of neighbours and V full blocks of four has 1 - (F - E + V) holes.
UNION = ST + "," + BOXES + """,
nb AS (SELECT a.id AS a, b.id AS b FROM vb a JOIN vb b ON b.id IN (a.id+1, a.id-1, a.id+30, a.id-30, a.id+29, a.id-29, a.id+31, a.id-31) AND abs(a.id % 30 - b.id % 30) <= 1
  WHERE (least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) >= greatest(a.y0, b.y0)) OR (least(a.x1, b.x1) >= greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0))),
bc(id, c) USING KEY (id) AS (SELECT id, id FROM vb UNION SELECT nb.b, min(p.c) FROM bc p JOIN nb ON nb.a = p.id LEFT JOIN recurring.bc AS q ON q.id = nb.b WHERE p.c < q.c GROUP BY nb.b),
ce AS MATERIALIZED (SELECT DISTINCT c, x, y FROM (SELECT c, x, unnest(range(y0, y1)) AS y FROM (SELECT c, unnest(range(x0, x1)) AS x, y0, y1 FROM vb JOIN bc USING (id)))),
ch AS (SELECT a.c, count(*) - count(r.x) - count(u.x) + count(CASE WHEN r.x IS NOT NULL AND u.x IS NOT NULL AND d.x IS NOT NULL THEN 1 END) AS chi, count(*) AS f, min(a.x) * 10.0 AS x0, max(a.x) * 10.0 + 10 AS x1, min(a.y) * 10.0 AS y0, max(a.y) * 10.0 + 10 AS y1
  FROM ce a LEFT JOIN ce r ON r.c = a.c AND r.x = a.x + 1 AND r.y = a.y LEFT JOIN ce u ON u.c = a.c AND u.x = a.x AND u.y = a.y + 1 LEFT JOIN ce d ON d.c = a.c AND d.x = a.x + 1 AND d.y = a.y + 1 GROUP BY a.c)"""


def union(spark, sf_dir):
    """Bounds, area and number of rings of every part of the union of all boxes."""
    out = overlay.union_polygons(boxes(spark, sf_dir), 100.0).withColumn("b", G.bounds(F.col("rings")[0]))
    return out.select("b.x0", "b.x1", "b.y0", "b.y1", F.round("area", 3).alias("area"), F.size("rings").alias("rings"))


simple("polygon_union", _recursive(seg("SELECT x0::DOUBLE AS x0, x1::DOUBLE AS x1, y0::DOUBLE AS y0, y1::DOUBLE AS y1, f * 100.0::DOUBLE AS area, (2 - chi)::INT AS rings FROM ch", UNION)), union)
simple("overlapping_polygons", seg("SELECT a.id AS pid1, b.id AS pid2 FROM vb a JOIN vb b ON b.id IN (a.id+1, a.id+30, a.id+29, a.id+31) AND abs(a.id % 30 - b.id % 30) <= 1 WHERE least(a.x1, b.x1) >= greatest(a.x0, b.x0) AND least(a.y1, b.y1) >= greatest(a.y0, b.y0)", ST + "," + BOXES), lambda s, d: overlay.overlapping(boxes(s, d), boxes(s, d)).filter("pid1 < pid2"))
simple("polygon_centroids", seg("SELECT id AS pid, (5.0 * (x0 + x1))::DOUBLE AS x, (5.0 * (y0 + y1))::DOUBLE AS y FROM vb", ST + "," + BOXES), lambda s, d: boxes(s, d).select("pid", G.ring_centroid(F.col("rings")[0]).alias("c")).select("pid", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y")))


def united_vertices(spark, sf_dir):
    """Vertices by the part of the united boxes that holds them: united input places."""
    v, _ = network(spark, sf_dir)
    parts = materialise(overlay.union_polygons(boxes(spark, sf_dir), 100.0).select(F.col("part").alias("pid"), "rings"), "parts")
    of = places.vertices_in(v, parts)
    first = of.groupBy("pid").agg(F.min("vid").alias("least"))
    return of.join(first, "pid").select("vid", "least")


simple("vertices_of_united_polygons", _recursive(seg("""SELECT id AS vid, min(id) OVER (PARTITION BY c) AS least FROM (SELECT DISTINCT p.id, bc.c FROM (SELECT id, 100*(id % 30) + (id*37) % 11 AS x, 100*(id // 30) + (id*53) % 13 AS y FROM dg) p JOIN vb b ON b.id IN (p.id, p.id+1, p.id-1, p.id+30, p.id-30, p.id+29, p.id-29, p.id+31, p.id-31) AND abs(p.id % 30 - b.id % 30) <= 1 AND x > 10*b.x0 AND x < 10*b.x1 AND y > 10*b.y0 AND y < 10*b.y1 JOIN bc ON bc.id = b.id)""", UNION)), united_vertices)

#: An outer rectangle and its hole.
OUTER, HOLE = (250.5, 50.5, 2250.5, 1650.5), (750.5, 350.5, 1450.5, 1050.5)


def _rectangle(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def _clip(ax, ay, bx, by, r) -> tuple[str, str]:
    """SQL: the first and last share of a piece inside a rectangle; the first is above the last if there is none."""
    lo, hi = ["0.0"], ["1.0"]
    for a, b, low, high in ((ax, bx, r[0], r[2]), (ay, by, r[1], r[3])):
        s, t = f"(({low} - {a}) / ({b} - {a}))", f"(({high} - {a}) / ({b} - {a}))"
        inside = f"{a} BETWEEN {low} AND {high}"
        lo.append(f"CASE WHEN {a} = {b} THEN CASE WHEN {inside} THEN 0.0 ELSE 2.0 END ELSE least({s}, {t}) END")
        hi.append(f"CASE WHEN {a} = {b} THEN CASE WHEN {inside} THEN 1.0 ELSE -1.0 END ELSE greatest({s}, {t}) END")
    return f"greatest({', '.join(lo)})", f"least({', '.join(hi)})"


def _pieces_sql() -> str:
    """SQL: ``pz(fid, len, o, h)``: pieces with their lengths inside the outer rectangle and inside the hole, as far as they reach."""
    cols = []
    for ax, ay, bx, by in (("x1", "y1", "mx", "my"), ("mx", "my", "x2", "y2")):
        (o0, o1), (h0, h1) = _clip(ax, ay, bx, by, OUTER), _clip(ax, ay, bx, by, HOLE)
        cols.append(f"SELECT fid, sqrt(({bx}-{ax})*({bx}-{ax})+({by}-{ay})*({by}-{ay})) AS len, {o0} AS o0, {o1} AS o1, {h0} AS h0, {h1} AS h1 FROM seg")
    return "pz AS (SELECT *, greatest(o1 - o0, 0.0) AS o, greatest(h1 - h0, 0.0) AS h FROM (" + " UNION ALL ".join(cols) + "))"


HOLED = [_rectangle(*OUTER), _rectangle(*HOLE)]
simple("edges_in_holed_polygon", seg("SELECT fid FROM pz GROUP BY fid HAVING bool_and(o = 1 AND h1 < h0)", _pieces_sql()), lambda s, d: select.in_polygon(X.segments(s, d), HOLED, "fid", within=True))
simple("edges_meeting_holed_polygon", seg("SELECT fid FROM pz GROUP BY fid HAVING bool_or(o1 >= o0) AND NOT bool_and(h = 1)", _pieces_sql()), lambda s, d: select.in_polygon(X.segments(s, d), HOLED, "fid"))


def holed_place(spark):
    """The polygon with its hole as text, written, read and parsed."""
    text = "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in HOLED) + ")"
    return spark.range(1).select(F.col("id").alias("place"), G.parse_wkt_polygon(F.lit(text)).alias("rings"))


def split(spark, sf_dir):
    """What a holed place leaves of every street."""
    out = diff.split_edges(X.segments(spark, sf_dir), holed_place(spark))
    return out.groupBy("fid").agg(F.round(F.sum("length"), 6).alias("length"))


simple("split_by_holed_place", seg("SELECT fid, round(sum(len * (1 - o + h)), 6) AS length FROM pz GROUP BY fid HAVING sum(len * (1 - o + h)) > 1e-9", _pieces_sql()), split)


def read_holed(spark, sf_dir):
    """Boxes with a hole each, written as multi-polygon text and read again."""
    path = shared_dir(spark, "holed")
    b = boxes(spark, sf_dir)
    hole = F.transform(F.col("rings")[0], lambda p: G.point((p["x"] + 3 * (F.col("rings")[0][0]["x"] + F.col("rings")[0][2]["x"]) / 2) / 4, (p["y"] + 3 * (F.col("rings")[0][0]["y"] + F.col("rings")[0][2]["y"]) / 2) / 4))
    b.select("pid", G.wkt_polygon(G.oriented(F.array(F.col("rings")[0], hole))).alias("wkt")).write.parquet(path)
    r = io.read_polygons(spark, path, key="pid", geometry="wkt")
    return r.select("pid", F.size("rings").alias("rings"), F.round(G.polygon_area("rings"), 6).alias("area"))


simple("read_polygons_with_holes", seg("SELECT id AS pid, 2 AS rings, 93.75::DOUBLE * (x1 - x0) * (y1 - y0) AS area FROM vb", ST + "," + BOXES), read_holed)

# Cover


def moved(spark, sf_dir):
    """The streets again, a third each in place, half a metre and two metres to the east, with new ids."""
    dx = F.element_at(F.array(F.lit(0.0), F.lit(0.5), F.lit(2.0)), (X.lattice_key(G.start_point("geom")) % 3 + 1).cast("int"))
    s = X.segments(spark, sf_dir)
    return s.select((F.col("fid") + 10_000_000_000).alias("fid"), "name", F.transform("geom", lambda p: G.point(p["x"] + dx, p["y"])).alias("geom"))


def paired_moved(spark, sf_dir):
    """Pairs of two states whose streets moved by less and by more than the tolerance."""
    own = [s.select("fid", F.col("fid").alias("way"), F.lit(0.0).alias("acces"), "geom") for s in (X.segments(spark, sf_dir), moved(spark, sf_dir))]
    return diff.paired(own[0], own[1]).select("fid1", "fid2")


simple("diff_paired_moved", seg("SELECT fid AS fid1, fid + 10000000000 AS fid2 FROM seg WHERE v % 3 < 2"), paired_moved)


def covering(spark, sf_dir):
    """Halves of moved streets, named by the street that covers them."""
    m = moved(spark, sf_dir)
    halves = m.select(F.posexplode(F.array(F.slice("geom", 1, 2), F.slice("geom", 2, 2))).alias("k", "geom"), (F.col("fid") * 2).alias("f")).select((F.col("f") + F.col("k")).alias("fid"), "geom")
    return sanitize.covering_names(halves, X.segments(spark, sf_dir), 1.0).select("fid", "name")


# the first half of a street to the east stays within a metre of the street when it moves two metres along it
simple("names_by_cover", seg("SELECT (fid + 10000000000) * 2 + k AS fid, CASE WHEN v % 3 < 2 OR (k = 0 AND w = v + 1) THEN name END AS name FROM seg, (SELECT unnest([0, 1]) AS k)"), covering)

# Sanitising, step by step


def jittered(spark, sf_dir):
    """Streets whose ends miss their vertex by up to 8 cm."""
    off = (F.col("fid") * 7 % 5) * 0.02
    return X.segments(spark, sf_dir).withColumn("geom", F.transform("geom", lambda p, i: F.when(i == 1, p).otherwise(G.point(p["x"] + off, p["y"]))))


def snapped(spark, sf_dir):
    s = sanitize.snap(jittered(spark, sf_dir), 0.2)
    return s.select("fid", F.round(G.start_point("geom")["x"], 6).alias("x1"), F.round(G.end_point("geom")["x"], 6).alias("x2"))


simple("snapped_lines", seg("SELECT fid, round(x1 + 0.02 * a.o, 6) AS x1, round(x2 + 0.02 * b.o, 6) AS x2 FROM seg JOIN lo a ON a.p = v JOIN lo b ON b.p = w", "lo AS (SELECT p, min(fid * 7 % 5) AS o FROM (SELECT fid, v AS p FROM seg UNION ALL SELECT fid, w FROM seg) GROUP BY p)"), snapped)


def overlaps(spark, sf_dir):
    """Streets and lines drawn over the middle half of their first pieces."""
    s = X.segments(spark, sf_dir).select("fid", "geom")

    def at(k):
        a, b = F.col("geom")[0], F.col("geom")[1]
        return G.point(a["x"] + k * (b["x"] - a["x"]) / 4, a["y"] + k * (b["y"] - a["y"]) / 4)

    more = s.select((F.col("fid") + 10_000_000_000).alias("fid"), F.array(at(1), at(3)).alias("geom"))
    o = sanitize.overlapping_parts(s.unionByName(more)).filter("fid1 + 10000000000 = fid2")
    return o.select("fid1", "fid2", *[F.round(f"{p}.{c}", 6).alias(f"{p}{c}") for p in "ab" for c in "xy"])


simple("overlapping_stretches", seg("SELECT fid AS fid1, fid + 10000000000 AS fid2, " + ", ".join(f"round({c}1 + {k} * (m{c} - {c}1) / 4, 6) AS {p}{c}" for p, k in (("a", 1), ("b", 3)) for c in "xy") + " FROM seg"), overlaps)


def repeated_once(spark, sf_dir):
    """Every street twice, once backwards under another id: one of each stays."""
    s = X.segments(spark, sf_dir).select("fid", F.lit(1).alias("part"), "name", "geom")
    back = s.select((F.col("fid") + 10_000_000_000).alias("fid"), "part", "name", F.reverse("geom").alias("geom"))
    return sanitize.distinct_parts(s.unionByName(back)).select("fid", "name", F.round(G.length("geom"), 6).alias("length"))


simple("equal_lines_once", seg("SELECT fid, name, round(length, 6) AS length FROM seg"), repeated_once)
simple("simplified_lines", seg("SELECT fid, CASE WHEN abs((x2-x1)*(my-y1) - (y2-y1)*(mx-x1)) / sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) > 1.5 THEN 3 ELSE 2 END AS points FROM seg"), lambda s, d: X.segments(s, d).select("fid", F.size(G.simplify(1.5)("geom")).alias("points")))


def collapsed(spark, sf_dir):
    """Streets with a stub of two metres at the start of each: stubs go, and their streets end at the middle of the stub."""
    s = X.segments(spark, sf_dir)
    far = 10_000_000.0  # every street on an island of its own

    def shifted(p):
        return G.point(p["x"] + F.col("fid") * far, p["y"])

    own = s.select("fid", "name", F.transform("geom", shifted).alias("geom"))
    stub = own.select((F.col("fid") + 10_000_000_000).alias("fid"), "name", F.array(G.point(F.col("geom")[0]["x"] - 2, F.col("geom")[0]["y"]), F.col("geom")[0]).alias("geom"))
    out = sanitize.collapse_short(own.unionByName(stub), 4.0)
    return out.select("fid", F.round(G.start_point("geom")["x"] - F.col("fid") * far, 3).alias("x1"), F.round(G.end_point("geom")["x"] - F.col("fid") * far, 3).alias("x2"))


simple("short_edges_collapsed", seg("SELECT fid, round(x1 - 1, 3) AS x1, round(x2, 3) AS x2 FROM seg"), collapsed)

# Ways on places that hold several vertices

#: Edges between places of clustered vertices; those inside a place are gone.
ON_PLACES = CLUSTER + """,
cl AS (SELECT place AS id, min(c) AS c FROM cc GROUP BY place UNION ALL SELECT place, place FROM deg WHERE d = 1),
es AS MATERIALIZED (SELECT seg.*, a.c AS s, b.c AS t FROM seg JOIN cl a ON a.id = seg.v JOIN cl b ON b.id = seg.w WHERE a.c <> b.c),
dep AS (SELECT fid, s AS place, 0 AS side, x1 AS px, y1 AS py, atan2(mx - x1, my - y1) AS az FROM es UNION ALL SELECT fid, t, 1, x2, y2, atan2(mx - x2, my - y2) FROM es),
dn AS (SELECT place, count(*) AS n FROM dep GROUP BY place),
p0 AS (SELECT a.place, a.fid AS fa, a.side AS sa, b.fid AS fb, b.side AS sb, n, sqrt((a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py)) AS gap, a.az AS aza, b.az AS azb, atan2(b.px - a.px, b.py - a.py) AS ac,
  abs(CASE WHEN abs(a.az - b.az) > pi() THEN 2*pi() - abs(a.az - b.az) ELSE abs(a.az - b.az) END - pi()) AS turn FROM dep a JOIN dep b USING (place) JOIN dn USING (place) WHERE (a.fid, a.side) < (b.fid, b.side)),
pp AS MATERIALIZED (SELECT *, fa * 2 + sa AS a, fb * 2 + sb AS b, row_number() OVER (PARTITION BY place ORDER BY (abs(sin(aza - ac)) + abs(sin(azb - ac))) * gap, fa, sa, fb, sb) AS r FROM p0),"""
_REST = BY_ANGLE[BY_ANGLE.index("gr(place"):].replace("ap AS (SELECT fa, fb FROM", "ap AS (SELECT fa, fb, gap FROM").replace("FROM seg UNION SELECT e.dst", "FROM es UNION SELECT e.dst")
PLACE_WAYS = ON_PLACES + _REST[: _REST.index("wy AS MATERIALIZED")] + """
hg AS (SELECT fid, sum(gap) / 2 AS dist FROM (SELECT fa AS fid, gap FROM ap UNION ALL SELECT fb, gap FROM ap) GROUP BY fid),
wy AS MATERIALIZED (SELECT fid, s AS v, t AS w, length + coalesce(dist, 0.0) AS length, coalesce(dist, 0.0) AS dist, way FROM es JOIN wc USING (fid) LEFT JOIN hg USING (fid)),""" + WAYS[WAYS.index("wp AS (") :]


def edges_on_places(spark, sf_dir):
    """Edges between places of clustered vertices, not cut."""
    v, e = network(spark, sf_dir)
    p, pv = places.build_places(materialise(v, "v"), e, 46.0)
    return places.attached(e, materialise(p, "p"), pv).drop("rs", "re")


simple("edges_between_places", _recursive(seg("SELECT fid, s AS start_pl, t AS end_pl FROM es", ON_PLACES.rstrip(","))), lambda s, d: edges_on_places(s, d).select("fid", "start_pl", "end_pl"))


def gap_partition(spark, sf_dir):
    """Ways by angle where ends lie apart: coefficients rank the pairs, and half gaps are added."""
    e = materialise(edges_on_places(spark, sf_dir), "on-places")
    return W.partition(e, W.pair_by_angle(e, 60.0)).select("fid", "way", F.round("dist", 6).alias("dist"))


def gap_ways(spark, sf_dir):
    w, _ = W.build_ways(edges_on_places(spark, sf_dir), 60.0, geometry=False)
    return w.select("way_id", F.round("length", 6).alias("length"), "degree", "conn")


simple("way_partition_on_places", _recursive(seg("SELECT fid, way, round(dist, 6) AS dist FROM wy", PLACE_WAYS)), gap_partition)
simple("ways_on_places", _recursive(seg("SELECT wlen.way AS way_id, round(length, 6) AS length, coalesce(degree, 0) AS degree, coalesce(conn, 0) AS conn FROM wlen LEFT JOIN wdeg USING (way) LEFT JOIN wconn USING (way)", PLACE_WAYS)), gap_ways)


def joined_places(spark, sf_dir):
    """Clusters of vertices and input polygons united: every place with its polygon."""
    v, e = network(spark, sf_dir)
    v = materialise(v, "v")
    p, _ = places.build_places(v, e, 46.0, polygons(spark, sf_dir))
    return p.select("place", "nb_vtx", "user_pl", F.size("rings").alias("rings"), F.round(G.polygon_area("rings"), 3).alias("area"))


simple("places_with_polygons", None, joined_places)

# Attributes


def _class_sql(name: str, by: str) -> str:
    """SQL: classes of equal total length by an attribute of ``at0``."""
    return f"""{name} AS (SELECT way, (min(f) OVER (ORDER BY a NULLS FIRST, way ROWS UNBOUNDED PRECEDING) + j)::INT AS class FROM (SELECT way, a, j, floor(c / b) - j AS f FROM (SELECT way, {by} AS a,
row_number() OVER (ORDER BY {by} NULLS FIRST, way) - 1 AS j, coalesce(sum(length) OVER (ORDER BY {by} NULLS FIRST, way ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, sum(length) OVER () / 10 AS b FROM at0)))"""


ATTRIBUTES = BOTH + searched() + "," + ANGLES[ANGLES.index("wy2 AS") :] + """,
og AS (SELECT way, round(sum(s) / any_value(conn), 6) AS orthog FROM (SELECT way, place, other, min(s) AS s FROM ang2 GROUP BY ALL) JOIN wconn USING (way) GROUP BY way),
sm AS (SELECT root AS way, sum(dist)::BIGINT AS rtopo, round(sum(dist * round(length, 3)), 3) AS acces, CASE WHEN sum(dist) > 0 THEN (count(*) - 1) / sum(dist) * (count(*) - 1) / ((SELECT count(*) FROM wi) - 1) ELSE 0 END AS closen FROM bf JOIN wlen ON wlen.way = node GROUP BY root),
at0 AS MATERIALIZED (SELECT wlen.way, round(length, 3) AS length, orthog, rtopo, acces, closen FROM wlen LEFT JOIN og USING (way) LEFT JOIN sm USING (way)),""" + _class_sql("c1", "rtopo") + "," + _class_sql("c2", "length")


def attributes(spark, sf_dir):
    """Orthogonality, radius, accessibility and closeness of all ways, with classes."""
    w, e = named_ways(spark, sf_dir)
    w = w.withColumn("length", F.round("length", 3))
    out = indicators.way_attributes(w, materialise(e, "e"), ["orthog", "rtopo", "acces", "closen"], ["rtopo", "length"])
    return out.select(F.col("way_id").alias("way"), F.round("orthog", 6).alias("orthog"), "rtopo", F.round("acces", 3).alias("acces"), F.round("closen", 9).alias("closen"), "rtopo_cl", "length_cl")


simple("way_attributes", _recursive(seg("SELECT at0.way, orthog, rtopo, acces, round(closen, 9) AS closen, c1.class AS rtopo_cl, c2.class AS length_cl FROM at0 JOIN c1 USING (way) JOIN c2 USING (way)", ATTRIBUTES)), attributes)

# Routes and weights


def way_routes(spark, sf_dir):
    """Fewest changes of way for a request in every lattice row."""
    _, e = named_ways(spark, sf_dir)
    e = materialise(e, "e")
    wp = materialise(W.way_places(e), "wp")
    asked = materialise(requests(spark, sf_dir), "asked")
    at = [asked.join(wp, F.col(c) == F.col("place")).select("req", "way") for c in ("source", "target")]
    return paths.way_simplest_paths(e, materialise(W.line_graph(wp), "lg"), asked, *at)


simple("way_simplest_paths", None, way_routes)


def mesh_shortest(spark, sf_dir):
    _, e = network(spark, sf_dir)
    return paths.mesh_path(_graph(spark, sf_dir), e.filter("name in ('E1', 'N3', 'E2', 'N10')").select("fid"), requests(spark, sf_dir), weighted=True).select("req", "seq", "fid")


simple("mesh_shortest_paths", None, mesh_shortest)


def metres_above(spark, sf_dir):
    """Streets from lower to higher vertices, with their length over 100 m, which may be below 0."""
    return X.street_graph(spark, sf_dir).select("src", "dst", (F.col("w") - 100.0).alias("w"))


simple("least_potentials", _recursive(seg("SELECT node, dist FROM pt", ST + """,
pt(node, dist) USING KEY (node) AS (SELECT id, 0.0::DOUBLE FROM dg UNION SELECT e.dst, min(p.dist + e.w - 100) FROM pt p JOIN st e ON e.src = p.node LEFT JOIN recurring.pt AS q ON q.node = e.dst WHERE p.dist + e.w - 100 < q.dist GROUP BY e.dst)""")), lambda s, d: potentials(metres_above(s, d)).select("node", "dist"))
simple("weighted_betweenness", None, lambda s, d: C.betweenness_centrality(X.street_graph(s, d), weight="w").select("id", F.round("value", 9).alias("value")))
