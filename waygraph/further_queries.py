"""Registered queries of files, geometry, places and selections, and of further graph operators, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from waygraph.functions import geom as G
from waygraph.graph_queries import CORES, COSTS, EP, EV, REQUESTS, ST, TR, _flat, _graph, event_pairs, r9, requests, simple, street
from waygraph.operators import indicators, paths, places, sanitize, select
from waygraph.operators.graph import bipartite as B
from waygraph.operators.graph import centrality as C
from waygraph.operators.graph import cluster as K
from waygraph.operators.graph import matrix as L
from waygraph.operators.graph import structure as V
from waygraph.operators.graph import traverse as T
from waygraph.plans.stages import materialise, shared_dir, table
from waygraph.queries import ANGLES, LINES, Q, WAYS, _recursive, gathered, named_ways, network, searched, seg
from waygraph.sources import fixtures as X
from waygraph.sources import io

# Files

#: Boxes around blocks of lattice columns, and the vertices in them.
PL = "pl AS (SELECT DISTINCT id // 10 AS pid FROM dg), bx AS (SELECT pid, (pid % 3) * 1000 - 20 AS x0, (pid // 3) * 100 - 20 AS y0 FROM pl), px AS (SELECT id, 100*(id % 30) + (id*37) % 11 AS x, 100*(id // 30) + (id*53) % 13 AS y, k FROM dg), inb AS (SELECT id, pid FROM px JOIN bx ON pid IN (id // 10, id // 10 - 1, id // 10 + 1) AND x > x0 AND x < x0 + 350 AND y > y0 AND y < y0 + 40)"

SEGS = "SELECT fid, name, v AS start_v, w AS end_v, 3 AS points, round(length, 6) AS length FROM seg"


def shown(s):
    """Segments as plain columns."""
    return s.select("fid", "name", X.lattice_key(G.start_point("geom")).alias("start_v"), X.lattice_key(G.end_point("geom")).alias("end_v"), G.num_points("geom").alias("points"), F.round(G.length("geom"), 6).alias("length"))


def by_wkt(spark, sf_dir):
    """Segments written as CSV with WKT and read again."""
    path = shared_dir(spark, "wkt")
    io.write_wkt(X.segments(spark, sf_dir), path)
    return shown(io.read_segments(spark, path, "csv", key="fid", name="name"))


def by_geojson(spark, sf_dir):
    """Segments written as GeoJSON lines and read again."""
    path = shared_dir(spark, "geojson")
    io.write_geojson(X.segments(spark, sf_dir), path)
    return shown(io.check_layer(io.read_segments(spark, path, "geojson", key="fid", name="name")))


def by_parquet(spark, sf_dir):
    """Segments written as Parquet and read again."""
    path = shared_dir(spark, "layer")
    X.segments(spark, sf_dir).write.parquet(path)
    return shown(io.read_segments(spark, path, key="fid", name="name"))


def multi_parts(spark, sf_dir):
    """All segments of a name as one multi-line, read as single lines numbered by part."""
    g = X.segments(spark, sf_dir).groupBy("name").agg(F.min("fid").alias("key"), F.transform(F.array_sort(F.collect_list(F.struct("fid", "geom"))), lambda x: x["geom"]).alias("lines"))
    return shown(io.segments_from(g, "lines", "key", "name", "multi"))


def project(spark, sf_dir):
    """A project of vertices and ways, saved with its parameters."""
    path = shared_dir(spark, "project")
    v, _ = network(spark, sf_dir)
    w, e = named_ways(spark, sf_dir)
    io.save_project(path, {"vertices": v, "ways": w, "place_edges": e, "places": v.select(F.col("vid").alias("place"), F.lit(1).alias("nb_vtx"))}, buffer=4.0, threshold=60.0)
    return path


def reopened(spark, sf_dir):
    """Number of rows of every table of a saved project."""
    t = io.load_project(spark, project(spark, sf_dir), "_1")
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(t.items())]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def imported(spark, sf_dir):
    """Edges of another project."""
    e, _ = io.import_state(spark, project(spark, sf_dir))
    return e.select("fid", "name", "degree", "way", F.round("length", 6).alias("length"))


def polygons(spark, sf_dir):
    """A box around each block of ten lattice columns in a row: ``pid, ring, srid``, written and read again."""
    path = shared_dir(spark, "polygons")
    v = V.nodes(street(spark, sf_dir)).select(F.floor(F.col("id") / 10).alias("pid")).distinct()
    x, y = (F.col("pid") % 3) * 1000 - 20, F.floor(F.col("pid") / 3) * 100 - 20
    corners = [(x, y), (x + 350, y), (x + 350, y + 40), (x, y + 40)]
    v.select("pid", F.array(*[G.point(a, b) for a, b in corners]).alias("ring")).write.parquet(path)
    return io.read_polygons(spark, path, srid=2154)


simple("read_wkt", seg(SEGS), by_wkt)
simple("read_geojson", seg(SEGS), by_geojson)
simple("read_parquet_lines", seg(SEGS), by_parquet)
simple("read_wkb", seg(SEGS), lambda s, d: shown(io.segments_from(X.segments(s, d).select("fid", "name", G.wkb_line()("geom").alias("b")), "b", "fid", "name", "wkb")))
simple("polygon_text", seg("SELECT pid, 5 AS corners, 14000.0::DOUBLE AS area FROM bx", ST + "," + PL), lambda s, d: polygons(s, d).select("pid", G.parse_wkt_ring(G.wkt_ring("ring")).alias("r")).select("pid", F.size("r").alias("corners"), G.ring_area(F.col("r")).alias("area")))
simple("read_multi_lines", seg("SELECT CASE WHEN n > 1 THEN k * 1000 + part ELSE k END AS fid, name, start_v, end_v, points, length FROM (SELECT name, v AS start_v, w AS end_v, 3 AS points, round(length, 6) AS length, min(fid) OVER (PARTITION BY name) AS k, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY fid) - 1 AS part FROM seg)"), multi_parts)
simple("reopened_project", seg("SELECT * FROM (SELECT 'vertices_1' AS name, count(DISTINCT place) AS n FROM ends UNION ALL SELECT 'places_1', count(DISTINCT place) FROM ends UNION ALL SELECT 'place_edges_1', count(*) FROM wy UNION ALL SELECT 'ways_1', count(DISTINCT way) FROM wy)", WAYS), reopened)
simple("imported_state", seg("SELECT fid, name, a.d + b.d - 2 AS degree, way, round(length, 6) AS length FROM wy JOIN deg a ON a.place = v JOIN deg b ON b.place = w", WAYS), imported)
simple("manifest", "SELECT '4.0' AS buffer, '60.0' AS threshold FROM customer LIMIT 1", lambda s, d: s.read.json(project(s, d) + "/manifest"))
simple("read_polygons", seg("SELECT pid, 5 AS corners, 2154 AS srid, 14000.0::DOUBLE AS area FROM bx", ST + "," + PL), lambda s, d: polygons(s, d).select("pid", F.size("ring").alias("corners"), "srid", G.ring_area(F.col("ring")).alias("area")))


def graph_file(kind):
    """The street graph through a text or JSON format and back."""

    def run(spark, sf_dir):
        g = X.street_graph(spark, sf_dir)
        path = shared_dir(spark, kind)
        if kind == "edge-list":
            io.write_edge_list(g, path)
            out = io.read_edge_list(spark, path, data=[("w", "int")])
        elif kind == "adjacency-list":
            io.write_adjacency_list(g, path)
            out = io.read_adjacency_list(spark, path)
        elif kind == "node-link":
            out = io.from_node_link(io.node_link(g, V.nodes(g)), link="source long, target long, w int")[1]
        else:
            out = io.from_adjacency_json(io.adjacency_json(g), "dst long, w int")
        return out.select(F.col("src").cast("long"), F.col("dst").cast("long"), *[c for c in out.columns if c == "w"])

    return run


for kind, cols in (("edge-list", "src, dst, w"), ("adjacency-list", "src, dst"), ("node-link", "src, dst, w"), ("adjacency-json", "src, dst, w")):
    simple(kind.replace("-", "_") + "_file", seg(f"SELECT {cols} FROM st", ST), graph_file(kind))

# Geometry, places, ways

simple("points_on_edges", seg("""SELECT fid, round(h / length, 9) AS middle, round(x1 + t * (CASE WHEN a < h THEN mx - x1 ELSE 0 END), 6) AS x, round(y1 + t * (CASE WHEN a < h THEN my - y1 ELSE 0 END), 6) AS y, round(length / 2, 6) AS half
FROM (SELECT *, length / 4 AS a, sqrt((mx-x1)*(mx-x1) + (my-y1)*(my-y1)) AS h, (length / 4) / sqrt((mx-x1)*(mx-x1) + (my-y1)*(my-y1)) AS t FROM seg)"""), lambda s, d: X.segments(s, d).select("fid", F.round(G.locate(F.col("geom"), G.point_n("geom", 2)), 9).alias("middle"), F.round(G.interpolate(F.col("geom"), 0.25)["x"], 6).alias("x"), F.round(G.interpolate(F.col("geom"), 0.25)["y"], 6).alias("y"), F.round(G.length(G.substring(F.col("geom"), 0.25, 0.75)), 6).alias("half")))
simple("snapped_to_grid", seg("SELECT fid, round(x1/5)*5 AS x1, round(y1/5)*5 AS y1, round(x2/5)*5 AS x2, round(y2/5)*5 AS y2 FROM seg"), lambda s, d: X.segments(s, d).select("fid", G.snap_to_grid(F.col("geom"), 5.0).alias("g")).select("fid", G.start_point("g")["x"].alias("x1"), G.start_point("g")["y"].alias("y1"), G.end_point("g")["x"].alias("x2"), G.end_point("g")["y"].alias("y2")))
simple("equal_lines", seg("SELECT fid AS fid1, fid AS fid2 FROM seg"), lambda s, d: (lambda a: a.select(F.col("fid").alias("fid1"), G.canonical(F.col("geom")).alias("g")).join(a.select(F.col("fid").alias("fid2"), G.canonical(F.reverse("geom")).alias("g")), "g").select("fid1", "fid2"))(X.segments(s, d)))
PC = """pc AS (SELECT fid, 0 AS k, x1 AS pax, y1 AS pay, mx AS pbx, my AS pby, v FROM seg UNION ALL SELECT fid, 1, mx, my, x2, y2, v FROM seg),
pq AS (SELECT p.fid AS f, q.fid AS g, p.pax, p.pay, p.pbx, p.pby, q.pax AS qax, q.pay AS qay, q.pbx AS qbx, q.pby AS qby FROM pc p JOIN pc q ON p.fid < q.fid AND q.v BETWEEN p.v - 62 AND p.v + 62 AND greatest(p.pax, p.pbx) >= least(q.pax, q.pbx) AND least(p.pax, p.pbx) <= greatest(q.pax, q.pbx) AND greatest(p.pay, p.pby) >= least(q.pay, q.pby) AND least(p.pay, p.pby) <= greatest(q.pay, q.pby)),
sd AS (SELECT *, (pbx-pax)*(qay-pay) - (pby-pay)*(qax-pax) AS s1, (pbx-pax)*(qby-pay) - (pby-pay)*(qbx-pax) AS s2, (qbx-qax)*(pay-qay) - (qby-qay)*(pax-qax) AS s3, (qbx-qax)*(pby-qay) - (qby-qay)*(pbx-qax) AS s4, (pbx-pax)*(qby-qay) - (pby-pay)*(qbx-qax) AS det FROM pq),
mt AS (SELECT * FROM sd WHERE s1*s2 <= 0 AND s3*s4 <= 0)"""
simple("connected_lines", seg("SELECT fid FROM seg WHERE fid IN (SELECT f FROM mt UNION SELECT g FROM mt)", PC), lambda s, d: sanitize.drop_unconnected(sanitize.drop_null(X.segments(s, d))).select("fid"))
simple("vertices_in_polygons", seg("SELECT id AS vid, min(pid) AS pid FROM inb GROUP BY id", ST + "," + PL), lambda s, d: places.vertices_in(network(s, d)[0], polygons(s, d)))
simple("uncovered_vertices", seg("SELECT id AS vid FROM dg WHERE id NOT IN (SELECT id FROM inb)", ST + "," + PL), lambda s, d: places.uncovered_vertices(network(s, d)[0], polygons(s, d)).select("vid"))


def given_places(spark, sf_dir):
    """Places from polygons alone."""
    v, e = network(spark, sf_dir)
    p, _ = places.build_places(materialise(v, "v"), e, 4.0, polygons(spark, sf_dir), file_only=True)
    return p.select("place", "nb_vtx", "user_pl", F.col("end_vtx").isNotNull().alias("alone"))


simple("places_from_polygons", seg("SELECT min(i) AS place, count(*)::INT AS nb_vtx, bool_and(g) AS user_pl, NOT bool_and(g) AS alone FROM (SELECT dg.id AS i, q.pid IS NOT NULL AS g, coalesce('p' || q.pid, 'v' || dg.id) AS c FROM dg LEFT JOIN (SELECT id, min(pid) AS pid FROM inb GROUP BY id) q ON q.id = dg.id) GROUP BY c", ST + "," + PL), given_places)
simple("place_degrees", seg("SELECT id AS place, k::INT AS degree FROM dg", ST), lambda s, d: places.place_degrees(places.one_place_per_vertex(network(s, d)[1])))
simple("way_lines", seg("SELECT way AS way_id, 1 AS parts, (2 * count(*) + 1)::INT AS points, round(sum(length), 6) AS length FROM wy GROUP BY way", WAYS), lambda s, d: named_ways(s, d, True)[0].select("way_id", F.size("geom").alias("parts"), F.size(F.element_at("geom", 1)).alias("points"), F.round(G.length(F.element_at("geom", 1)), 6).alias("length")))
simple("way_angle_cosines", seg("SELECT a.place, a.fid AS edge_a, b.fid AS edge_b, round(cos(abs(CASE WHEN abs(a.az - b.az) > pi() THEN 2*pi() - abs(a.az - b.az) ELSE abs(a.az - b.az) END - pi())), 6) AS cos FROM dep a JOIN dep b USING (place) WHERE (a.fid, a.side) < (b.fid, b.side) AND a.way <> b.way", ANGLES), lambda s, d: indicators.way_angles(named_ways(s, d)[1], F.cos, "cos").select("place", "edge_a", "edge_b", F.round("cos", 6).alias("cos")))


def indicator_table(spark, sf_dir):
    """Ways with their orthogonality joined and classes of equal length by it."""
    w, e = named_ways(spark, sf_dir)
    o = indicators.way_orthogonality(indicators.way_angles(e), w.select(F.col("way_id").alias("way"), "conn")).withColumnRenamed("way", "way_id")
    return indicators.computed_properties(indicators.with_indicators(w.withColumn("none", F.lit(None).cast("double")), [o], "way_id"), ["length", "orthog", "none"])


simple("computed_properties", seg("SELECT unnest(['length', 'orthog', 'none']) AS name, unnest([count(length) > 0, count(DISTINCT edge) > 0, false]) AS computed FROM wlen, ang2", ANGLES), indicator_table)

# Selections and paths

simple("edges_by_length", seg("SELECT fid, v AS start_pl, w AS end_pl, round(length, 6) AS length FROM seg ORDER BY round(length, 3) DESC, fid LIMIT (SELECT floor(count(*) / 100 * 5)::INT FROM seg)"), lambda s, d: select.edges_by_attribute(places.one_place_per_vertex(network(s, d)[1]).withColumn("l", F.round("length", 3)), "l", 5).withColumn("length", F.round("length", 6)))
simple("edges_by_ids", seg("SELECT fid, v AS start_pl, w AS end_pl, round(length, 6) AS length FROM seg WHERE v IN (SELECT place FROM deg WHERE d = 1) OR w IN (SELECT place FROM deg WHERE d = 1)", "ends AS (SELECT v AS place FROM seg UNION ALL SELECT w FROM seg), deg AS (SELECT place, count(*) AS d FROM ends GROUP BY place)"), lambda s, d: (lambda v, e: select.edges_by_fid(e, e.join(v.filter("degree = 1").select(F.col("vid").alias("start_pl")), "start_pl", "left_semi").select("fid").union(e.join(v.filter("degree = 1").select(F.col("vid").alias("end_pl")), "end_pl", "left_semi").select("fid"))).withColumn("length", F.round("length", 6)))(network(s, d)[0], materialise(places.one_place_per_vertex(network(s, d)[1]), "e")))
simple("edges_by_ways", seg("SELECT fid, v AS start_pl, w AS end_pl, round(length, 6) AS length FROM wy WHERE way IN (SELECT way FROM wy WHERE v = 31 OR w = 31)", WAYS), lambda s, d: (lambda e: select.edges_by_way(e, select.ways_at_place(select_places(e), 31)).withColumn("length", F.round("length", 6)))(materialise(named_ways(s, d)[1], "e")))
PD = "least({0}, {1})".format(*["sqrt(pow(ax + greatest(0, least(1, ((1000 - ax)*(bx-ax) + (400 - ay)*(by-ay)) / ((bx-ax)*(bx-ax) + (by-ay)*(by-ay)))) * (bx-ax) - 1000, 2) + pow(ay + greatest(0, least(1, ((1000 - ax)*(bx-ax) + (400 - ay)*(by-ay)) / ((bx-ax)*(bx-ax) + (by-ay)*(by-ay)))) * (by-ay) - 400, 2))".replace("ax", a).replace("ay", b).replace("bx", c).replace("by", e) for a, b, c, e in (("x1", "y1", "mx", "my"), ("mx", "my", "x2", "y2"))])
simple("edges_touching_disc", seg(f"SELECT fid FROM seg WHERE {PD} <= 250"), lambda s, d: select.around_point(X.segments(s, d), 1000, 400, 250, "fid"))
simple("closest_edge", seg(f"SELECT fid, round({PD}, 6) AS dist FROM seg ORDER BY 2, 1 LIMIT 1"), lambda s, d: select.closest_feature(X.segments(s, d), 1000, 400, 250, "fid").withColumn("dist", F.round("dist", 6)))
simple("edges_meeting_polygon", seg("SELECT fid FROM seg WHERE (greatest(x1, x2, mx) >= 250.5 AND least(x1, x2, mx) <= 1250.5 AND greatest(y1, y2, my) >= 50.5 AND least(y1, y2, my) <= 650.5) AND (" + " OR ".join(f"({a} > 250.5 AND {a} < 1250.5 AND {b} > 50.5 AND {b} < 650.5)" for a, b in (("x1", "y1"), ("mx", "my"), ("x2", "y2"))) + " OR " + " OR ".join(f"(({a} - {c}) * ({p} - {c}) <= 0 AND {a} <> {p} AND {b} + ({c} - {a}) / ({p} - {a}) * ({q} - {b}) BETWEEN {lo} AND {hi})" for (x, y, z, w) in (("x1", "y1", "mx", "my"), ("mx", "my", "x2", "y2")) for a, b, p, q, c, lo, hi in ((x, y, z, w, 250.5, 50.5, 650.5), (x, y, z, w, 1250.5, 50.5, 650.5), (y, x, w, z, 50.5, 250.5, 1250.5), (y, x, w, z, 650.5, 250.5, 1250.5))) + ")"), lambda s, d: select.in_polygon(X.segments(s, d), [(250.5, 50.5), (1250.5, 50.5), (1250.5, 650.5), (250.5, 650.5), (250.5, 50.5)], "fid"))


def select_places(e):
    """``way, place`` of edges."""
    from waygraph.operators import ways

    return ways.way_places(e)


def horizon_lengths(spark, sf_dir):
    """Ways within two hops of those at a place, with their lengths."""
    from waygraph.operators import ways

    w, e = named_ways(spark, sf_dir)
    wp = materialise(ways.way_places(e), "wp")
    found = select.horizon(materialise(ways.line_graph(wp), "lg"), select.ways_at_place(wp, 31).withColumnRenamed("way", "id"), 2)
    return select.horizon_features(w.select("way_id", F.round("length", 6).alias("length")), "way_id", found)


simple("horizon_of_place", _recursive(seg("SELECT node AS way_id, round(length, 6) AS length, min(dist) AS horizon FROM hz JOIN wlen ON way = node GROUP BY ALL", LINES + ", adj AS (SELECT src, dst FROM lg UNION ALL SELECT dst, src FROM lg), hz(node, dist) AS (SELECT DISTINCT way, 0 FROM wp WHERE place = 31 UNION SELECT adj.dst, dist + 1 FROM hz JOIN adj ON adj.src = node WHERE dist < 2)")), horizon_lengths)


def path_lengths(spark, sf_dir):
    """Edges of shortest paths, joined with the edge table."""
    e = network(spark, sf_dir)[1]
    t = paths.path_table(paths.shortest_path(_graph(spark, sf_dir), requests(spark, sf_dir)), e.select("fid", F.col("length").cast("int").alias("l")))
    return t.groupBy("req").agg(F.sum("l").alias("metres"), F.max("seq").cast("int").isNotNull().alias("found"))


simple("path_tables", _recursive(seg("SELECT req, dist AS metres, true AS found FROM rq JOIN wd ON root = lo AND node = hi", REQUESTS + ", we AS (SELECT src, dst, w::BIGINT AS c FROM sy)" + COSTS)), path_lengths)

# Graphs

ONE = ST + ", ow AS (SELECT CASE WHEN w % 2 = 0 THEN src ELSE dst END AS src, CASE WHEN w % 2 = 0 THEN dst ELSE src END AS dst, w FROM st)"


def one_way(s, d):
    """Streets as one-way links, directed by the parity of their length."""
    g, even = X.street_graph(s, d), F.col("w") % 2 == 0
    return g.select(F.when(even, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(even, F.col("dst")).otherwise(F.col("src")).alias("dst"), "w")


SUPPLY = "cs AS (SELECT o_custkey AS src, l_suppkey + 10000000 AS dst, count(*) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), sp AS (SELECT l_suppkey + 10000000 AS src, l_partkey + 20000000 AS dst, count(*) AS w FROM lineitem GROUP BY ALL), dag AS (SELECT * FROM cs UNION ALL SELECT * FROM sp)"


def supply(s, d):
    """Customers to suppliers to parts, weighted by lines: a graph without cycles."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    i = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    a = i.join(o, "l_orderkey").select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst"))
    b = i.select((F.col("l_suppkey") + 10_000_000).alias("src"), (F.col("l_partkey") + 20_000_000).alias("dst"))
    return a.unionByName(b).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


simple("edge_table", seg("SELECT src AS source, dst AS target, w FROM st", ST), lambda s, d: V.to_edge_table(X.street_graph(s, d)))
simple("undirected_from_directed", seg("SELECT src, dst, w FROM st", ONE), lambda s, d: V.to_undirected(one_way(s, d)))
simple("edge_subgraph", seg("SELECT src, dst FROM st WHERE w >= 100", ST), lambda s, d: V.edge_subgraph(street(s, d), X.street_graph(s, d).filter("w >= 100")))
simple("filtered_view", seg("SELECT src, dst, w FROM st JOIN dg a ON a.id = src JOIN dg b ON b.id = dst WHERE w >= 100 AND a.k >= 4 AND b.k >= 4", ST), lambda s, d: V.filtered(X.street_graph(s, d), F.col("degree") >= 4, F.col("w") >= 100, V.degrees(street(s, d))))
simple("non_neighbours", seg("SELECT id FROM dg WHERE id <> 31 AND id NOT IN (SELECT dst FROM sy WHERE src = 31)", ST), lambda s, d: V.non_neighbours(street(s, d), V.nodes(street(s, d)), 31))
simple("contracted_nodes", seg("SELECT CASE WHEN src = 1 THEN 0 ELSE src END AS src, CASE WHEN dst = 1 THEN 0 ELSE dst END AS dst FROM st WHERE NOT (src = 0 AND dst = 1) AND NOT (src = 1 AND dst = 0)", ST), lambda s, d: V.contracted(street(s, d), 0, 1, self_loops=False))
for kind in ("path", "cycle", "star"):
    simple(f"{kind}_of_nodes", seg({"path": "SELECT src, dst FROM (SELECT id AS src, lead(id) OVER (ORDER BY id) AS dst FROM dg) WHERE dst IS NOT NULL", "cycle": "SELECT id AS src, coalesce(lead(id) OVER (ORDER BY id), (SELECT min(id) FROM dg)) AS dst FROM dg", "star": "SELECT (SELECT min(id) FROM dg) AS src, id AS dst FROM dg WHERE id > (SELECT min(id) FROM dg)"}[kind], ST), lambda s, d, kind=kind: V.chain(V.nodes(street(s, d)).select(F.col("id").alias("seq"), "id"), kind))
simple("graph_union", seg("SELECT src, dst FROM st UNION ALL SELECT src + 10000000, dst + 10000000 FROM st", ST), lambda s, d: V.union(street(s, d), street(s, d).select((F.col("src") + 10_000_000).alias("src"), (F.col("dst") + 10_000_000).alias("dst"))))
simple("disjoint_union", seg("SELECT '0:' || src AS src, '0:' || dst AS dst FROM st UNION ALL SELECT '1:' || src, '1:' || dst FROM st", ST), lambda s, d: V.disjoint_union(street(s, d), street(s, d)))
PR = EP + ", ca AS (SELECT n.id || '/' || es.src AS a, n.id || '/' || es.dst AS b FROM n, es UNION SELECT es.src || '/' || n.id, es.dst || '/' || n.id FROM n, es), te AS (SELECT x.src || '/' || y.src AS a, x.dst || '/' || y.dst AS b FROM es x, es y)"
simple("strong_product", PR + " SELECT DISTINCT a AS src, b AS dst FROM (SELECT * FROM ca UNION ALL SELECT * FROM te) WHERE a < b", lambda s, d: _flat(V.product(event_pairs(s, d), event_pairs(s, d), "strong")))
simple("lexicographic_product", PR + " SELECT DISTINCT a AS src, b AS dst FROM (SELECT es.src || '/' || x.id AS a, es.dst || '/' || y.id AS b FROM es, n x, n y UNION ALL SELECT n.id || '/' || es.src, n.id || '/' || es.dst FROM n, es) WHERE a < b", lambda s, d: _flat(V.product(event_pairs(s, d), event_pairs(s, d), "lexicographic")))
simple("wide_adjacency", EV + " SELECT src, dst, w FROM ev", lambda s, d: V.from_wide(V.to_wide(X.event_transitions(s, d)), "src").select("src", "dst", F.col("w").cast("long").alias("w")))
simple("prefix_tree", "WITH p AS (SELECT DISTINCT string_split(p_brand, '#') AS p FROM part), s AS (SELECT DISTINCT p[1:i] AS d FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p)) SELECT array_to_string(d[1:len(d)-1], '-') AS src, array_to_string(d, '-') AS dst FROM s UNION ALL SELECT array_to_string(p, '-'), 'NIL' FROM p", lambda s, d: V.prefix_tree(table(s, d, "part").select(F.split("p_brand", "#").alias("path")).distinct()).select(F.array_join("src", "-").alias("src"), F.array_join("dst", "-").alias("dst")))
simple("line_ends_as_edges", seg("SELECT v AS src, w AS dst FROM seg"), lambda s, d: V.edges_from_lines(X.segments(s, d)).select(X.lattice_key(F.col("src")).alias("src"), X.lattice_key(F.col("dst")).alias("dst")))
simple("bipartite_from_rows", "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem", lambda s, d: V.bipartite_edges(table(s, d, "lineitem"), "l_suppkey", "l_partkey").distinct())
simple("biadjacency", "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem", lambda s, d: B.from_biadjacency(B.biadjacency(X.supplier_parts(s, d))).select("src", "dst"))
simple("multi_projection", "WITH cn AS (SELECT DISTINCT c_nationkey AS src, c_mktsegment AS dst FROM customer) SELECT a.src AS u, b.src AS v, a.dst AS key FROM cn a JOIN cn b ON a.dst = b.dst WHERE a.src < b.src", lambda s, d: B.multi_projection(table(s, d, "customer").select(F.col("c_nationkey").alias("src"), F.col("c_mktsegment").alias("dst")).distinct()))
simple("modularity_matrix", EP + ", k AS (SELECT src AS id, count(*) AS k FROM es GROUP BY src) SELECT a.id AS i, b.id AS j, round((SELECT count(*) FROM es WHERE es.src = a.id AND es.dst = b.id) - a.k * b.k / (SELECT count(*) FROM es), 9) AS w FROM k a, k b", lambda s, d: r9(L.modularity_matrix(event_pairs(s, d)), "w"))

simple("subset_betweenness", _recursive(seg("SELECT id, round(coalesce(v, 0.0) / 2, 9) AS value FROM dg LEFT JOIN (SELECT node AS id, sum(delta) AS v FROM dl GROUP BY node) USING (id)", ST + ", top AS (SELECT id FROM dg WHERE k = (SELECT max(k) FROM dg))," + searched("sy", "top") + "," + gathered("betweenness", "sy").replace("(1 + y.delta)", "((y.node IN (0, 31, 62))::INT + y.delta)"))), lambda s, d: r9(C.betweenness_subset(street(s, d), (lambda k: k.join(k.agg(F.max("degree").alias("degree")), "degree", "left_semi").select("id"))(V.degrees(street(s, d))), [0, 31, 62]), "value"))
simple("reaching_centrality", _recursive(seg("SELECT root AS id, round((count(*) - 1) / ((SELECT count(*) FROM dg) - 1), 9) AS value FROM bf GROUP BY root", ONE + "," + searched("ow", "dg"))), lambda s, d: r9(C.reaching(one_way(s, d)), "value"))
simple("weighted_clustering", seg("SELECT id, round(CASE WHEN k > 1 THEN 2 * coalesce(x, 0) / (k * (k - 1)) ELSE 0 END, 9) AS value FROM dg LEFT JOIN (SELECT id, sum(cbrt(p.w * q.w * r.w) / (SELECT max(w) FROM st)) AS x FROM (SELECT a, b, c, unnest([a, b, c]) AS id FROM tr) JOIN st p ON p.src = a AND p.dst = b JOIN st q ON q.src = b AND q.dst = c JOIN st r ON r.src = a AND r.dst = c GROUP BY id) USING (id)", TR), lambda s, d: r9(K.weighted_clustering(X.street_graph(s, d)), "value"))
simple("dispersion", seg("""SELECT e.src AS u, e.dst AS v, round(CASE WHEN emb > 0 THEN dd / emb ELSE 0 END, 9) AS value FROM st e JOIN (SELECT e.src, e.dst, (SELECT count(*) FROM cw WHERE u = e.src AND v = e.dst) AS emb,
(SELECT count(*) FROM cw x JOIN cw y ON x.u = y.u AND x.v = y.v AND x.x < y.x WHERE x.u = e.src AND x.v = e.dst AND NOT EXISTS (SELECT 1 FROM sy t WHERE t.src = x.x AND t.dst = y.x)
AND NOT EXISTS (SELECT 1 FROM sy p JOIN sy q ON p.dst = q.src JOIN sy o ON o.dst = p.dst WHERE p.src = x.x AND q.dst = y.x AND o.src = e.src AND p.dst <> e.src AND p.dst <> e.dst)) AS dd FROM st e) z ON z.src = e.src AND z.dst = e.dst""", ST + ", cw AS (SELECT e.src AS u, e.dst AS v, a.dst AS x FROM st e JOIN sy a ON a.src = e.src JOIN sy b ON b.src = e.dst AND b.dst = a.dst)"), lambda s, d: r9(C.dispersion(street(s, d), street(s, d).select(F.col("src").alias("u"), F.col("dst").alias("v"))), "value"))
TOP = "(SELECT max(core) FROM core)"
for kind, rule in (("shell", f"core = {TOP}"), ("crust", f"core <= {TOP} - 1")):
    simple(f"k_{kind}", _recursive(seg(f"SELECT src, dst FROM st WHERE src IN (SELECT id FROM core WHERE {rule}) AND dst IN (SELECT id FROM core WHERE {rule})", ST + CORES)), lambda s, d, kind=kind: K.k_core(street(s, d), kind=kind))
simple("weighted_neighbour_degree", seg("SELECT src AS id, round(sum(w * k) / sum(w), 9) AS value FROM sy JOIN dg ON id = dst GROUP BY src", ST), lambda s, d: r9(K.average_neighbour_degree(X.street_graph(s, d), "w"), "value"))
simple("weighted_degree_connectivity", seg("SELECT a.k AS degree, round(sum(w * b.k) / sum(w), 9) AS value FROM sy JOIN dg a ON a.id = src JOIN dg b ON b.id = dst GROUP BY a.k", ST), lambda s, d: r9(K.average_degree_connectivity(X.street_graph(s, d), "w"), "value"))
IO = ONE + ", ko AS (SELECT src AS id, count(*) AS k FROM ow GROUP BY src), ki AS (SELECT dst AS id, count(*) AS k FROM ow GROUP BY dst)"
simple("directed_neighbour_degree", seg("SELECT src AS id, round(avg(coalesce(k, 0)), 9) AS value FROM ow LEFT JOIN ki ON ki.id = dst GROUP BY src", IO), lambda s, d: r9(K.directed_neighbour_degree(one_way(s, d), "out", "in"), "value"))
simple("directed_degree_assortativity", seg("SELECT round(corr(coalesce(a.k, 0), coalesce(b.k, 0)), 9) AS value FROM ow LEFT JOIN ko a ON a.id = src LEFT JOIN ki b ON b.id = dst", IO), lambda s, d: r9(K.degree_assortativity(one_way(s, d), "out", "in", True), "value"))
simple("degree_mixing", seg("SELECT a.k AS x, b.k AS y, count(*) AS n FROM sy JOIN dg a ON a.id = src JOIN dg b ON b.id = dst GROUP BY ALL", ST), lambda s, d: K.degree_mixing(street(s, d)))
simple("directed_degree_mixing", seg("SELECT coalesce(a.k, 0) AS x, coalesce(b.k, 0) AS y, count(*) AS n FROM ow LEFT JOIN ko a ON a.id = src LEFT JOIN ki b ON b.id = dst GROUP BY ALL", IO), lambda s, d: K.directed_degree_mixing(one_way(s, d)))
simple("is_partition", seg("SELECT count(*) = count(DISTINCT id) AND count(DISTINCT id) = (SELECT count(*) FROM dg) AS value FROM (SELECT id, id // 30 AS block FROM dg)", ST), lambda s, d: K.is_partition(V.nodes(street(s, d)), V.nodes(street(s, d)).withColumn("block", F.floor(F.col("id") / 30))))

REACH = ONE + "," + searched("ow", "dg")
SCC = REACH + ", sc AS MATERIALIZED (SELECT a.root AS id, min(a.node) AS component FROM bf a JOIN bf b ON b.root = a.node AND b.node = a.root GROUP BY a.root), cd AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM ow JOIN sc a ON a.id = ow.src JOIN sc b ON b.id = ow.dst WHERE a.component <> b.component)"
simple("strong_components", _recursive(seg("SELECT id, component FROM sc", SCC)), lambda s, d: T.strong_components(one_way(s, d)))
simple("condensation", _recursive(seg("SELECT src, dst FROM cd", SCC)), lambda s, d: T.condensation(one_way(s, d)))
simple("attracting_components", _recursive(seg("SELECT id, component FROM sc WHERE component NOT IN (SELECT src FROM cd)", SCC)), lambda s, d: T.attracting_components(one_way(s, d)))
simple("flow_hierarchy", _recursive(seg("SELECT round(count(*) FILTER (a.component <> b.component) / count(*), 9) AS value FROM ow JOIN sc a ON a.id = ow.src JOIN sc b ON b.id = ow.dst", SCC)), lambda s, d: r9(T.flow_hierarchy(one_way(s, d)), "value"))
simple("component_sizes", _recursive(seg("SELECT c AS component, count(*) AS n FROM cc GROUP BY c", ST + ", cc(id, c) USING KEY (id) AS (SELECT id, id FROM dg UNION SELECT e.dst, min(p.c) FROM cc p JOIN sy e ON e.src = p.id LEFT JOIN recurring.cc AS r ON r.id = e.dst WHERE p.c < r.c GROUP BY e.dst)")), lambda s, d: T.component_sizes(street(s, d)))
ZERO = ST + ", rq AS (SELECT 0::BIGINT AS lo), we AS (SELECT src, dst, w::BIGINT AS c FROM sy)" + COSTS
simple("shortest_path_nodes", _recursive(seg("SELECT node, path FROM pt", ZERO + ", pv AS (SELECT b.node, min(e.src) AS pred FROM wd b JOIN sy e ON e.dst = b.node JOIN wd a ON a.node = e.src AND a.dist + e.w = b.dist GROUP BY b.node), pt(node, path) AS (SELECT 0::BIGINT, '0' UNION ALL SELECT pv.node, path || ',' || pv.node FROM pt JOIN pv ON pv.pred = pt.node)")), lambda s, d: T.paths(T.weighted_distances(X.street_graph(s, d), s.range(1))).select("node", F.array_join(F.col("path").cast("array<string>"), ",").alias("path")))
CENTRES = REQUESTS + ", we AS (SELECT src, dst, w::BIGINT AS c FROM sy)" + COSTS
simple("nearest_source", _recursive(seg("SELECT node AS id, arg_min(root, (dist, root)) AS source, min(dist)::DOUBLE AS dist FROM wd GROUP BY node", CENTRES)), lambda s, d: T.nearest_source(X.street_graph(s, d), requests(s, d).select(F.col("source").alias("id")).distinct()))
simple("voronoi", _recursive(seg("SELECT id, center FROM dg LEFT JOIN (SELECT node AS id, arg_min(root, (dist, root)) AS center FROM wd GROUP BY node) USING (id)", CENTRES)), lambda s, d: T.voronoi(X.street_graph(s, d), requests(s, d).select(F.col("source").alias("id")).distinct()))
simple("metric_closure", _recursive(seg("SELECT root AS src, node AS dst, dist::DOUBLE AS w FROM wd WHERE node IN (SELECT lo FROM rq) AND root < node", CENTRES)), lambda s, d: T.metric_closure(X.street_graph(s, d), requests(s, d).select(F.col("source").alias("id")).distinct()))
simple("astar_path_length", _recursive(seg("SELECT dist::DOUBLE AS value FROM wd WHERE node = 62", ZERO)), lambda s, d: T.astar_path_length(X.street_graph(s, d), 0, 62, V.nodes(street(s, d)).select("id", (F.sqrt(F.pow(100.0 * (F.col("id") % 30 - 2), 2) + F.pow(100.0 * (F.floor(F.col("id") / 30) - 2), 2)) * 0.7 - 30).alias("h")).withColumn("h", F.greatest("h", F.lit(0.0)))))
simple("weight_expression", _recursive(seg("SELECT node, dist::DOUBLE AS dist FROM wd", ST + ", rq AS (SELECT 0::BIGINT AS lo), we AS (SELECT src, dst, (w * w)::BIGINT AS c FROM sy WHERE w <= 110)" + COSTS)), lambda s, d: T.weighted_distances(X.street_graph(s, d), s.range(1), weight=lambda e: F.when(F.col("w") <= 110, F.col("w") * F.col("w"))).select("node", "dist"))
simple("has_path", _recursive(seg("SELECT count(*) > 0 AS value FROM bf WHERE node = 62", ONE + ", z AS (SELECT 0::BIGINT AS id)," + searched("ow", "z"))), lambda s, d: T.has_path(one_way(s, d), 0, 62, True))
simple("all_shortest_paths", _recursive(seg("SELECT path FROM ps WHERE node = 62", ST + ", z AS (SELECT 0::BIGINT AS id)," + searched("sy", "z") + ", ps(node, dist, path) AS (SELECT 0::BIGINT, 0, '0' UNION ALL SELECT e.dst, p.dist + 1, p.path || ',' || e.dst FROM ps p JOIN sy e ON e.src = p.node JOIN bf b ON b.node = e.dst AND b.dist = p.dist + 1 WHERE p.dist < (SELECT dist FROM bf WHERE node = 62))")), lambda s, d: T.all_shortest_paths(street(s, d), 0, 62).select(F.array_join(F.col("path").cast("array<string>"), ",").alias("path")))
simple("simple_paths", _recursive(seg("SELECT array_to_string(p, ',') AS path FROM sx WHERE p[len(p)] = 62", ST + ", sx(p) AS (SELECT [0::BIGINT] UNION ALL SELECT list_append(p, e.dst) FROM sx JOIN sy e ON e.src = p[len(p)] WHERE len(p) <= 6 AND p[len(p)] <> 62 AND NOT list_contains(p, e.dst))")), lambda s, d: T.simple_paths(street(s, d), 0, 62, 6).select(F.array_join(F.col("path").cast("array<string>"), ",").alias("path")))
simple("simple_cycles", _recursive(seg("SELECT DISTINCT array_to_string(p, ',') AS cycle FROM sx JOIN ow e ON e.src = p[len(p)] AND e.dst = p[1]", ONE + ", sx(p) AS (SELECT [src, dst] FROM ow WHERE src < dst UNION ALL SELECT list_append(p, e.dst) FROM sx JOIN ow e ON e.src = p[len(p)] WHERE len(p) < 5 AND e.dst > p[1] AND NOT list_contains(p, e.dst))")), lambda s, d: T.simple_cycles(one_way(s, d), 5).select(F.array_join(F.col("cycle").cast("array<string>"), ",").alias("cycle")))
simple("distance_extremes", _recursive(seg("SELECT root AS id, max(dist) AS value, min(max(dist)) OVER () AS radius, max(max(dist)) OVER () AS diameter, max(dist) = min(max(dist)) OVER () AS center, max(dist) = max(max(dist)) OVER () AS periphery FROM bf WHERE root IN (SELECT node FROM bf WHERE root = (SELECT root FROM bf GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)) GROUP BY root", ST + "," + searched("sy", "dg"))), lambda s, d: T.distance_extremes(T.largest_component(street(s, d))))
simple("average_path_length", _recursive(seg("SELECT round(sum(dist) / ((SELECT count(*) FROM dg) * ((SELECT count(*) FROM dg) - 1)), 9) AS value FROM bf", ST + "," + searched("sy", "dg"))), lambda s, d: r9(T.average_path_length(street(s, d)), "value"))
simple("descendants", _recursive(seg("SELECT node AS id FROM bf WHERE node <> 0", ONE + ", z AS (SELECT 0::BIGINT AS id)," + searched("ow", "z"))), lambda s, d: T.descendants(one_way(s, d), 0))
simple("ancestors", _recursive(seg("SELECT node AS id FROM bf WHERE node <> 0", ONE + ", z AS (SELECT 0::BIGINT AS id), wo AS (SELECT dst AS src, src AS dst FROM ow)," + searched("wo", "z"))), lambda s, d: T.ancestors(one_way(s, d), 0))
simple("dag_longest_path_length", f"WITH {SUPPLY} SELECT max(a.w + coalesce(b.w, 0))::DOUBLE AS value FROM cs a LEFT JOIN sp b ON b.src = a.dst", lambda s, d: T.dag_longest_path_length(supply(s, d), "w"))
simple("transitive_closure", f"WITH {SUPPLY}, sn AS (SELECT s_suppkey + 10000000 AS src, s_nationkey + 30000000 AS dst FROM supplier) SELECT src, dst FROM cs UNION SELECT src, dst FROM sn UNION SELECT a.src, b.dst FROM cs a JOIN sn b ON b.src = a.dst", lambda s, d: T.transitive_closure(supply(s, d).filter("src < 10000000").select("src", "dst").unionByName(table(s, d, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("src"), (F.col("s_nationkey") + 30_000_000).alias("dst")))))
simple("transitive_reduction", _recursive(seg("SELECT e.src, e.dst FROM st e WHERE NOT EXISTS (SELECT 1 FROM st m JOIN bf b ON b.root = m.dst AND b.node = e.dst WHERE m.src = e.src AND m.dst <> e.dst)", ST + "," + searched("st", "dg"))), lambda s, d: T.transitive_reduction(street(s, d)))
simple("spanning_forest", _recursive(seg("SELECT e.src, e.dst, e.w::DOUBLE AS w FROM kr JOIN es e USING (i) WHERE took", ST + """, es AS (SELECT row_number() OVER (ORDER BY w, src, dst) AS i, src, dst, w FROM st), nr AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM dg), ex AS (SELECT i, a.r AS a, b.r AS b FROM es JOIN nr a ON a.id = src JOIN nr b ON b.id = dst),
kr(i, comp, took) AS (SELECT 0::BIGINT, (SELECT list(r::INT ORDER BY r) FROM nr), false UNION ALL SELECT e.i, CASE WHEN k.comp[e.a] <> k.comp[e.b] THEN list_transform(k.comp, lambda c: CASE WHEN c = k.comp[e.b] THEN k.comp[e.a] ELSE c END) ELSE k.comp END, k.comp[e.a] <> k.comp[e.b] FROM kr k JOIN ex e ON e.i = k.i + 1)""")), lambda s, d: T.spanning_forest(X.street_graph(s, d)))
simple("tree_facts", f"WITH {SUPPLY} SELECT false AS tree, false AS forest, false AS arborescence, false AS branching FROM (SELECT count(*) AS m, (SELECT count(*) FROM (SELECT src FROM dag UNION SELECT dst FROM dag)) AS n FROM dag) WHERE m >= n", lambda s, d: T.tree_facts(supply(s, d)))
simple("is_eulerian", _recursive(seg("SELECT (SELECT bool_and(k % 2 = 0) FROM dg) AND (SELECT count(DISTINCT c) = 1 FROM cc) AS value", ST + ", cc(id, c) USING KEY (id) AS (SELECT id, id FROM dg UNION SELECT e.dst, min(p.c) FROM cc p JOIN sy e ON e.src = p.id LEFT JOIN recurring.cc AS r ON r.id = e.dst WHERE p.c < r.c GROUP BY e.dst)")), lambda s, d: T.is_eulerian(street(s, d)))
simple("beam_search", _recursive(seg("SELECT min(e.src) AS src, b.node AS dst FROM bf b JOIN be e ON e.dst = b.node JOIN bf a ON a.node = e.src AND a.dist = b.dist - 1 GROUP BY b.node", ST + ", be AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY k DESC, dst) AS r FROM sy JOIN dg ON id = dst) WHERE r <= 2), z AS (SELECT 0::BIGINT AS id)," + searched("be", "z"))), lambda s, d: T.beam_search(street(s, d), 0, V.degrees(street(s, d)).select("id", F.col("degree").alias("value")), 2))
simple("bridge_spans", _recursive(seg("SELECT src, dst, min(n)::INT AS span FROM (SELECT l.src, l.dst, f.n FROM lb l LEFT JOIN sn f ON f.s = l.src AND f.t = l.dst AND f.node = l.dst) GROUP BY src, dst", ST + """, lb AS (SELECT src, dst FROM st e WHERE NOT EXISTS (SELECT 1 FROM sy a JOIN sy b ON a.dst = b.dst WHERE a.src = e.src AND b.src = e.dst)),
sn0(s, t, node, n) USING KEY (s, t, node) AS (SELECT src, dst, src, 0 FROM lb UNION SELECT p.s, p.t, e.dst, any_value(p.n) + 1 FROM sn0 p JOIN sy e ON e.src = p.node LEFT JOIN recurring.sn0 AS r ON r.s = p.s AND r.t = p.t AND r.node = e.dst LEFT JOIN recurring.sn0 AS q ON q.s = p.s AND q.t = p.t AND q.node = p.t WHERE r.n IS NULL AND q.n IS NULL AND NOT (e.src = p.s AND e.dst = p.t) GROUP BY p.s, p.t, e.dst), sn AS MATERIALIZED (SELECT * FROM sn0)""")), lambda s, d: T.bridge_spans(street(s, d)))


def _ways_of(table: str, tag: str) -> str:
    """The SQL of ways, their line graph and searches on it, over another table of segments, names ending in ``tag``."""
    sql = LINES + f", adj AS (SELECT src, dst FROM lg UNION ALL SELECT dst, src FROM lg), wi AS (SELECT DISTINCT src AS id FROM adj)," + searched() + ", ac AS (SELECT root AS way, sum(dist * length) AS acces FROM bf JOIN wlen ON wlen.way = node GROUP BY root)"
    for name in ("ends", "deg", "isl", "wy", "wp", "wends", "wdeg", "wconn", "wlen", "lg", "adj", "wi", "bf0", "bf", "ac"):
        sql = re.sub(rf"(?<![.\w]){name}\b", name + tag, sql)
    return re.sub(r"\bFROM seg\b", f"FROM {table}", sql).replace("recurring.bf0", f"recurring.bf0{tag}")


def _lost_sql(name: str, of: str, tag: str) -> str:
    """Hops times length over the edges ``of`` from every way of a state."""
    return f"""{name}w AS (SELECT way AS node, sum(length) AS len FROM {of} GROUP BY way),
{name} AS (SELECT root AS way, sum(dist * len) AS v FROM bf{tag} JOIN {name}w USING (node) GROUP BY root UNION ALL SELECT node, 0.0::DOUBLE FROM {name}w WHERE node NOT IN (SELECT id FROM wi{tag}))"""


simple("diff_accessibility", _recursive(seg("""SELECT a.fid AS fid1, b.fid AS fid2, round(b.acces - a.acces, 3) AS diff, round(r.v, 3) AS removed, round(n.v, 3) AS added, round(b.acces - a.acces + coalesce(r.v, 0) - coalesce(n.v, 0), 3) AS delta
FROM ea a JOIN eb b USING (fid) LEFT JOIN rv r ON r.way = a.way LEFT JOIN nw n ON n.way = b.way""", X.STATES_SQL + "," + _ways_of("sa", "1") + "," + _ways_of("sb", "2") + """,
ea AS MATERIALIZED (SELECT fid, wy1.way, length, coalesce(acces, 0.0) AS acces FROM wy1 LEFT JOIN ac1 USING (way)), eb AS MATERIALIZED (SELECT fid, wy2.way, length, coalesce(acces, 0.0) AS acces FROM wy2 LEFT JOIN ac2 USING (way)),
gone AS (SELECT * FROM ea WHERE fid NOT IN (SELECT fid FROM eb)), new AS (SELECT * FROM eb WHERE fid NOT IN (SELECT fid FROM ea)),""" + _lost_sql("rv", "gone", "1") + "," + _lost_sql("nw", "new", "2"))), Q["diff_accessibility"])
simple("crossing_points", seg("""SELECT x, y FROM (SELECT DISTINCT round(pax + (pbx - pax) * ((qax - pax) * (qby - qay) - (qay - pay) * (qbx - qax)) / det, 6) AS x, round(pay + (pby - pay) * ((qax - pax) * (qby - qay) - (qay - pay) * (qbx - qax)) / det, 6) AS y FROM mt WHERE det <> 0)
UNION SELECT x1, y1 FROM seg UNION SELECT x2, y2 FROM seg""", PC), Q["crossing_points"])
simple("bridges", _recursive(seg("SELECT src, dst FROM st LEFT JOIN (SELECT s, t, true AS met FROM sn WHERE node = t) ON s = src AND t = dst WHERE met IS NULL", ST + """,
sn0(s, t, node) USING KEY (s, t, node) AS (SELECT src, dst, src FROM st UNION SELECT p.s, p.t, e.dst FROM sn0 p JOIN sy e ON e.src = p.node LEFT JOIN recurring.sn0 AS r ON r.s = p.s AND r.t = p.t AND r.node = e.dst LEFT JOIN recurring.sn0 AS q ON q.s = p.s AND q.t = p.t AND q.node = p.t WHERE r.s IS NULL AND q.s IS NULL AND NOT (e.src = p.s AND e.dst = p.t) GROUP BY p.s, p.t, e.dst), sn AS MATERIALIZED (SELECT * FROM sn0)""")), Q["bridges"])
simple("bridges_of_regions", "SELECT s_suppkey + 10000000 AS src, (s_nationkey + 30000000)::BIGINT AS dst FROM supplier UNION ALL SELECT n_regionkey + 20000000, n_nationkey + 30000000 FROM nation", lambda s, d: T.bridges(table(s, d, "supplier").select((F.col("s_suppkey") + 10_000_000).cast("long").alias("src"), (F.col("s_nationkey") + 30_000_000).cast("long").alias("dst")).unionByName(table(s, d, "nation").select((F.col("n_regionkey") + 20_000_000).cast("long").alias("src"), (F.col("n_nationkey") + 30_000_000).cast("long").alias("dst")))))
