"""Registered queries of the spatial operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.functions import geom as G
from waygraph.operators import diff, indicators, places, select, topology, ways
from waygraph.plans.stages import materialise
from waygraph.sources import fixtures as X

Q, SQL = {}, {}


def register(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame."""

    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def seg(body: str, more: str = "") -> str:
    """SQL over the segments and, if given, further common tables."""
    return f"WITH {X.SEGMENTS_SQL}{',' + more if more else ''} {body}"


#: Ends of segments and their degrees, in SQL.
ENDS = "ends AS (SELECT fid, v AS place, 0 AS side FROM seg UNION ALL SELECT fid, w, 1 FROM seg), deg AS (SELECT place, count(*) AS d FROM ends GROUP BY place)"
#: Ways by name in SQL: runs of consecutive segments of a name.
WAYS = ENDS + """,
isl AS (SELECT *, sum(CASE WHEN pw IS NOT DISTINCT FROM v THEN 0 ELSE 1 END) OVER (PARTITION BY name ORDER BY v) AS run
  FROM (SELECT *, lag(w) OVER (PARTITION BY name ORDER BY v) AS pw FROM seg)),
wy AS (SELECT *, min(fid) OVER (PARTITION BY name, run) AS way FROM isl),
wp AS (SELECT DISTINCT way, v AS place FROM wy UNION SELECT DISTINCT way, w FROM wy),
wends AS (SELECT DISTINCT fid, way, v AS place FROM wy UNION SELECT DISTINCT fid, way, w FROM wy),
wdeg AS (SELECT a.way, count(DISTINCT b.way) AS degree FROM wp a JOIN wp b USING (place) WHERE a.way <> b.way GROUP BY a.way),
wconn AS (SELECT a.way, count(DISTINCT (b.fid, b.place)) AS conn FROM wp a JOIN wends b USING (place) WHERE a.way <> b.way GROUP BY a.way),
wlen AS (SELECT way, sum(length) AS length FROM wy GROUP BY way)"""


def network(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the street lattice, vertices named by lattice key."""
    return topology.build_graph(X.segments(spark, sf_dir), snap=0, key=X.lattice_key)


def named_ways(spark, sf_dir, geometry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ways, edges) with one place per vertex, ways by name."""
    _, edges = network(spark, sf_dir)
    return ways.build_ways(places.one_place_per_vertex(edges), attribute=True, geometry=geometry)


@register("scan_segments", seg("SELECT fid, name, v AS start_v, w AS end_v, 3 AS points, round(length, 6) AS length FROM seg"))
def scan_segments(spark, sf_dir):
    s = X.segments(spark, sf_dir)
    return s.select("fid", "name", X.lattice_key(G.start_point("geom")).alias("start_v"), X.lattice_key(G.end_point("geom")).alias("end_v"), G.num_points("geom").alias("points"), F.round(G.length("geom"), 6).alias("length"))


@register("vertices", seg("SELECT place AS vid, d AS degree, (100*(place % 30) + (place*37) % 11)::DOUBLE AS x, (100*(place // 30) + (place*53) % 13)::DOUBLE AS y FROM deg", ENDS))
def vertices(spark, sf_dir):
    v, _ = network(spark, sf_dir)
    return v.select("vid", "degree", "pt.x", "pt.y")


@register("edges", seg("SELECT fid, v AS start_vtx, w AS end_vtx, a.d + b.d - 2 AS degree, name, round(length, 6) AS length FROM seg JOIN deg a ON a.place = v JOIN deg b ON b.place = w", ENDS))
def edges(spark, sf_dir):
    _, e = network(spark, sf_dir)
    return e.select("fid", "start_vtx", "end_vtx", "degree", "name", F.round("length", 6).alias("length"))


CLUSTER = ENDS + """,
pts AS (SELECT place, (100*(place % 30) + (place*37) % 11) AS x, (100*(place // 30) + (place*53) % 13) AS y FROM deg WHERE d > 1),
near AS (SELECT a.place AS a, b.place AS b FROM pts a JOIN pts b ON b.place IN (a.place+1, a.place-1, a.place+30, a.place-30, a.place+29, a.place-29, a.place+31, a.place-31) AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 92*92),
cc(place, c) AS (SELECT place, place FROM pts UNION SELECT near.b, cc.c FROM cc JOIN near ON near.a = cc.place)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("place_clusters", _recursive(seg("SELECT place AS vid, min(c) AS cluster FROM cc GROUP BY place", CLUSTER)))
def place_clusters(spark, sf_dir):
    v, _ = network(spark, sf_dir)
    return places.clusters(v, 46.0)


@register("places", _recursive(seg("SELECT c AS place, count(*) AS nb_vtx FROM (SELECT place, min(c) AS c FROM cc GROUP BY place UNION ALL SELECT place, place FROM deg WHERE d = 1) GROUP BY c", CLUSTER)))
def places_(spark, sf_dir):
    v, e = network(spark, sf_dir)
    p, _ = places.build_places(materialise(v, "v"), e, 46.0)
    return p.select("place", "nb_vtx")


@register("place_vertices", _recursive(seg("SELECT place AS vertex, min(c) AS place FROM cc GROUP BY place UNION ALL SELECT place, place FROM deg WHERE d = 1", CLUSTER)))
def place_vertices(spark, sf_dir):
    v, e = network(spark, sf_dir)
    return places.build_places(materialise(v, "v"), e, 46.0)[1]


@register("place_edges", seg("SELECT fid, v AS start_pl, w AS end_pl, 1 AS status, a.d + b.d - 2 AS degree, round(length - (CASE WHEN a.d > 1 THEN 1 ELSE 0 END + CASE WHEN b.d > 1 THEN 1 ELSE 0 END) * 4, 1) AS length FROM seg JOIN deg a ON a.place = v JOIN deg b ON b.place = w", ENDS))
def place_edges(spark, sf_dir):
    v, e = network(spark, sf_dir)
    v = materialise(v, "v")
    p, pv = places.build_places(v, e, 4.0)
    out = places.place_edges(e, materialise(p, "p"), pv)
    return out.select("fid", "start_pl", "end_pl", "status", "degree", F.round("length", 1).alias("length"))


@register("ways", seg("SELECT wlen.way AS way_id, round(length, 6) AS length, coalesce(degree, 0) AS degree, coalesce(conn, 0) AS conn, round(CASE WHEN conn > 0 THEN length / conn END, 6) AS spacing FROM wlen LEFT JOIN wdeg USING (way) LEFT JOIN wconn USING (way)", WAYS))
def ways_(spark, sf_dir):
    w, _ = named_ways(spark, sf_dir)
    return w.select("way_id", F.round("length", 6).alias("length"), "degree", "conn", F.round("spacing", 6).alias("spacing"))


#: Ways by angle in SQL: departures of a place pair up in order, one pair a step, if both are free and they deviate by less than 60 degrees.
BY_ANGLE = """dep AS (SELECT fid, v AS place, 0 AS side, atan2(mx - x1, my - y1) AS az FROM seg UNION ALL SELECT fid, w, 1, atan2(mx - x2, my - y2) FROM seg),
dn AS (SELECT place, count(*) AS n FROM dep GROUP BY place),
pp AS (SELECT a.place, row_number() OVER (PARTITION BY a.place ORDER BY a.fid, a.side, b.fid, b.side) AS r, a.fid * 2 + a.side AS a, b.fid * 2 + b.side AS b, a.fid AS fa, b.fid AS fb, n,
  abs(CASE WHEN abs(a.az - b.az) > pi() THEN 2*pi() - abs(a.az - b.az) ELSE abs(a.az - b.az) END - pi()) AS turn FROM dep a JOIN dep b USING (place) JOIN dn USING (place) WHERE (a.fid, a.side) < (b.fid, b.side)),
gr(place, r, gone, kept) AS (SELECT place, 0::BIGINT, []::BIGINT[], false FROM dn UNION ALL
  SELECT place, r, CASE WHEN f THEN list_append(list_append(gone, a), b) ELSE gone END, f FROM (SELECT p.place, p.r, g.gone, p.a, p.b, p.n = 2 OR (p.turn < pi() / 3 AND NOT list_contains(g.gone, p.a) AND NOT list_contains(g.gone, p.b)) AS f FROM gr g JOIN pp p ON p.place = g.place AND p.r = g.r + 1)),
ap AS (SELECT fa, fb FROM gr JOIN pp USING (place, r) WHERE kept), ab AS (SELECT fa AS src, fb AS dst FROM ap UNION ALL SELECT fb, fa FROM ap),
wc(fid, way) USING KEY (fid) AS (SELECT fid, fid FROM seg UNION SELECT e.dst, min(p.way) FROM wc p JOIN ab e ON e.src = p.fid LEFT JOIN recurring.wc AS q ON q.fid = e.dst WHERE p.way < q.way GROUP BY e.dst),
wy AS MATERIALIZED (SELECT seg.*, way FROM seg JOIN wc USING (fid)),"""
ANGLE_WAYS = BY_ANGLE + WAYS[WAYS.index("wp AS ("):] + """,
wo AS (SELECT way, place, count(*) AS n FROM (SELECT way, v AS place FROM wy UNION ALL SELECT way, w FROM wy) GROUP BY way, place),
we AS (SELECT way, coalesce(min(place) FILTER (n % 2 = 1), min(place)) AS start_pl, coalesce(max(place) FILTER (n % 2 = 1), min(place)) AS end_pl FROM wo GROUP BY way)"""


@register("ways_by_angle", _recursive(seg("SELECT wlen.way AS way_id, start_pl, end_pl, round(length, 6) AS length, coalesce(degree, 0) AS degree, coalesce(conn, 0) AS conn, round(CASE WHEN conn > 0 THEN length / conn END, 6) AS spacing FROM wlen JOIN we USING (way) LEFT JOIN wdeg USING (way) LEFT JOIN wconn USING (way)", ANGLE_WAYS)))
def ways_by_angle(spark, sf_dir):
    _, e = network(spark, sf_dir)
    w, _ = ways.build_ways(places.one_place_per_vertex(e), threshold=60.0)
    return w.select("way_id", "start_pl", "end_pl", F.round("length", 6).alias("length"), "degree", "conn", F.round("spacing", 6).alias("spacing"))


@register("way_partition", seg("SELECT fid, way, 0.0::DOUBLE AS dist FROM wy", WAYS))
def way_partition(spark, sf_dir):
    _, e = named_ways(spark, sf_dir)
    return e.select("fid", "way", "dist")


@register("way_places", seg("SELECT way, place FROM wp", WAYS))
def way_places(spark, sf_dir):
    _, e = named_ways(spark, sf_dir)
    return ways.way_places(e)


@register("way_count", seg("SELECT count(DISTINCT way) AS ways FROM wy", WAYS))
def way_count(spark, sf_dir):
    _, e = named_ways(spark, sf_dir)
    return ways.num_ways(e)


@register("way_ends", seg("SELECT way, min(CASE WHEN n % 2 = 1 THEN place END) AS start_pl, max(CASE WHEN n % 2 = 1 THEN place END) AS end_pl FROM (SELECT way, place, count(*) AS n FROM (SELECT way, v AS place FROM wy UNION ALL SELECT way, w FROM wy) GROUP BY way, place) GROUP BY way", WAYS))
def way_ends(spark, sf_dir):
    _, e = named_ways(spark, sf_dir)
    return ways.way_ends(e)


LINES = WAYS + ", lg AS (SELECT a.way AS src, b.way AS dst, max(place) AS place FROM wp a JOIN wp b USING (place) WHERE a.way < b.way GROUP BY ALL)"


@register("way_line_graph", seg("SELECT * FROM lg", LINES))
def way_line_graph(spark, sf_dir):
    _, e = named_ways(spark, sf_dir)
    return ways.line_graph(ways.way_places(e))


ANGLES = WAYS + """,
dep AS (SELECT fid, way, v AS place, 0 AS side, atan2(mx - x1, my - y1) AS az FROM wy2 UNION ALL SELECT fid, way, w, 1, atan2(mx - x2, my - y2) FROM wy2),
ang AS (SELECT a.place, a.fid AS edge_a, a.way AS way_a, b.fid AS edge_b, b.way AS way_b,
  sin(abs(CASE WHEN abs(a.az - b.az) > pi() THEN 2*pi() - abs(a.az - b.az) ELSE abs(a.az - b.az) END - pi())) AS s
  FROM dep a JOIN dep b USING (place) WHERE (a.fid, a.side) < (b.fid, b.side) AND a.way <> b.way),
ang2 AS (SELECT place, edge_a AS edge, way_a AS way, edge_b AS other, s FROM ang UNION ALL SELECT place, edge_b, way_b, edge_a, s FROM ang)"""
ANGLES = ANGLES.replace("dep AS", "wy2 AS (SELECT * FROM wy),\ndep AS", 1)


@register("way_angles", seg("SELECT place, edge_a, way_a, edge_b, way_b, round(s, 6) AS sin FROM ang", ANGLES))
def way_angles(spark, sf_dir):
    _, e = named_ways(spark, sf_dir)
    return indicators.way_angles(e).withColumn("sin", F.round("sin", 6))


@register("way_orthogonality", seg("SELECT way, round(sum(s) / any_value(conn), 6) AS orthog FROM (SELECT way, place, other, min(s) AS s FROM ang2 GROUP BY ALL) JOIN wconn USING (way) GROUP BY way", ANGLES))
def way_orthogonality(spark, sf_dir):
    w, e = named_ways(spark, sf_dir)
    return indicators.way_orthogonality(indicators.way_angles(e), w.select(F.col("way_id").alias("way"), "conn")).withColumn("orthog", F.round("orthog", 6))


@register("edge_orthogonality", seg("SELECT edge AS fid, round(sum(s) / any_value(a.d + b.d - 2), 6) AS orthog FROM (SELECT edge, place, other, min(s) AS s FROM ang2 GROUP BY ALL) JOIN seg ON fid = edge JOIN deg a ON a.place = v JOIN deg b ON b.place = w GROUP BY edge", ANGLES))
def edge_orthogonality(spark, sf_dir):
    _, e = named_ways(spark, sf_dir)
    return indicators.edge_orthogonality(indicators.way_angles(e), e).withColumn("orthog", F.round("orthog", 6))


@register("edge_spacing", seg("SELECT fid, round(CASE WHEN a.d + b.d > 2 THEN length / (a.d + b.d - 2) END, 6) AS spacing FROM seg JOIN deg a ON a.place = v JOIN deg b ON b.place = w", ENDS))
def edge_spacing(spark, sf_dir):
    _, e = network(spark, sf_dir)
    return indicators.edge_spacing(e).withColumn("spacing", F.round("spacing", 6))


@register("edge_line_graph", seg("SELECT DISTINCT a.fid AS src, b.fid AS dst FROM ends a JOIN ends b USING (place) WHERE a.fid < b.fid", ENDS))
def edge_line_graph(spark, sf_dir):
    _, e = network(spark, sf_dir)
    return indicators.edge_line_graph(places.one_place_per_vertex(e))


def searched(links: str = "adj", ids: str = "wi", name: str = "bf") -> str:
    """SQL of a search from every node: ``name(root, node, dist, sigma)``, one level a step, with counts of shortest paths."""
    return f"""{name}0(root, node, dist, sigma) USING KEY (root, node) AS (SELECT id, id, 0, 1.0::DOUBLE FROM {ids}
UNION SELECT p.root, e.dst, any_value(p.dist) + 1, sum(p.sigma) FROM {name}0 p JOIN {links} e ON e.src = p.node LEFT JOIN recurring.{name}0 AS seen ON seen.root = p.root AND seen.node = e.dst WHERE seen.dist IS NULL GROUP BY p.root, e.dst),
{name} AS MATERIALIZED (SELECT * FROM {name}0)"""


def gathered(kind: str, links: str = "adj", name: str = "bf") -> str:
    """SQL of the way back: ``dl(root, node, lvl, sigma, delta)`` from the last level to the first, without the roots."""
    start, part = {"betweenness": ("0.0::DOUBLE", "x.sigma / y.sigma * (1 + y.delta)"), "stress": ("0.0::DOUBLE", "1 + y.delta"), "load": ("1.0::DOUBLE", "y.delta / y.preds")}[kind]
    return f"""pr AS MATERIALIZED (SELECT b.root, b.node, any_value(b.dist) AS dist, any_value(b.sigma) AS sigma, count(u.node) AS preds FROM {name} b JOIN {links} e ON e.dst = b.node LEFT JOIN {name} u ON u.root = b.root AND u.node = e.src AND u.dist = b.dist - 1 GROUP BY b.root, b.node),
dl(root, node, lvl, sigma, delta, preds) AS (SELECT root, node, dist, sigma, {start}, preds FROM pr WHERE dist = (SELECT max(dist) FROM pr)
UNION ALL SELECT x.root, x.node, any_value(x.dist), any_value(x.sigma), {start} + coalesce(sum({part}), 0), any_value(x.preds) FROM pr x LEFT JOIN {links} e ON e.src = x.node LEFT JOIN dl y ON y.root = x.root AND y.node = e.dst WHERE x.dist = (SELECT max(lvl) - 1 FROM dl) AND x.dist >= 1 GROUP BY x.root, x.node)"""


#: The line graph of ways in both directions.
BOTH = LINES + ", adj AS (SELECT src, dst FROM lg UNION ALL SELECT dst, src FROM lg), wi AS (SELECT DISTINCT src AS id FROM adj),"


@register("way_radius", _recursive(seg("SELECT root AS way, sum(dist)::BIGINT AS rtopo, round(sum(dist * length), 3) AS acces FROM bf JOIN wlen ON wlen.way = node GROUP BY root", BOTH + searched())))
def way_radius(spark, sf_dir):
    w, e = named_ways(spark, sf_dir)
    g = materialise(ways.line_graph(ways.way_places(e)), "lg")
    return indicators.topological_radius(g, w.select(F.col("way_id").alias("id"), "length")).select(F.col("id").alias("way"), "rtopo", F.round("acces", 3).alias("acces"))


@register("way_closeness", _recursive(seg("SELECT root AS way, round(CASE WHEN sum(dist) > 0 THEN (count(*) - 1) / sum(dist) * (count(*) - 1) / ((SELECT count(*) FROM wi) - 1) ELSE 0 END, 9) AS closen FROM bf GROUP BY root", BOTH + searched())))
def way_closeness(spark, sf_dir):
    _, e = named_ways(spark, sf_dir)
    return indicators.closeness(materialise(ways.line_graph(ways.way_places(e)), "lg")).select(F.col("id").alias("way"), F.round("closen", 9).alias("closen"))


@register("way_betweenness", _recursive(seg("SELECT id AS way, round(coalesce(v, 0.0) / 2, 6) AS betwee FROM wi LEFT JOIN (SELECT node AS id, sum(delta) AS v FROM dl GROUP BY node) USING (id)", BOTH + searched() + "," + gathered("betweenness"))))
def way_betweenness(spark, sf_dir):
    _, e = named_ways(spark, sf_dir)
    return indicators.betweenness(materialise(ways.line_graph(ways.way_places(e)), "lg")).select(F.col("id").alias("way"), F.round("betwee", 6).alias("betwee"))


@register("way_stress", _recursive(seg("SELECT id AS way, round(coalesce(v, 0.0) / 2, 3) AS use FROM wi LEFT JOIN (SELECT node AS id, sum(sigma * delta) AS v FROM dl GROUP BY node) USING (id)", BOTH + searched() + "," + gathered("stress"))))
def way_stress(spark, sf_dir):
    _, e = named_ways(spark, sf_dir)
    return indicators.stress(materialise(ways.line_graph(ways.way_places(e)), "lg")).select(F.col("id").alias("way"), F.round("use", 3).alias("use"))


@register("edge_classes", seg("""SELECT fid, (min(f) OVER (ORDER BY length, fid ROWS UNBOUNDED PRECEDING) + j)::INT AS class FROM (
SELECT fid, length, j, floor(c / b) - j AS f FROM (SELECT fid, length, row_number() OVER (ORDER BY length, fid) - 1 AS j, coalesce(sum(length) OVER (ORDER BY length, fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, sum(length) OVER () / 10 AS b FROM (SELECT fid, round(length, 3) AS length FROM seg)))"""))
def edge_classes(spark, sf_dir):
    _, e = network(spark, sf_dir)
    return ways.lengths_by_class(e.select("fid", F.round("length", 3).alias("length")), "length", 10)


@register("top_edges", seg("SELECT fid FROM (SELECT fid, round(length, 3) AS l FROM seg) ORDER BY l DESC, fid LIMIT (SELECT (count(*) / 100 * 5)::INT FROM seg WHERE false) + (SELECT floor(count(*) / 100 * 5)::INT FROM seg)"))
def top_edges(spark, sf_dir):
    _, e = network(spark, sf_dir)
    return select.top_features(e.withColumn("l", F.round("length", 3)), "l", 5, "fid")


@register("top_way_edges", seg("SELECT fid, v AS start_pl, w AS end_pl, round(length, 6) AS length FROM wy WHERE way IN (SELECT way FROM wlen LEFT JOIN wdeg USING (way) ORDER BY coalesce(degree, 0) DESC, way LIMIT (SELECT floor(count(*) / 100 * 10)::INT FROM wlen))", WAYS))
def top_way_edges(spark, sf_dir):
    w, e = named_ways(spark, sf_dir)
    return select.edges_by_way_attribute(e, w, "degree", 10).withColumn("length", F.round("length", 6))


@register("edges_around_point", seg("SELECT fid FROM seg WHERE least(CASE WHEN true THEN 1e9 END, sqrt((x1-1000)*(x1-1000)+(y1-400)*(y1-400))) <= 250 AND sqrt((mx-1000)*(mx-1000)+(my-400)*(my-400)) <= 250 AND sqrt((x2-1000)*(x2-1000)+(y2-400)*(y2-400)) <= 250"))
def edges_around_point(spark, sf_dir):
    return select.around_point(X.segments(spark, sf_dir), 1000, 400, 250, "fid", within=True)


@register("edges_in_polygon", seg("SELECT fid FROM seg WHERE x1 > 250.5 AND x1 < 1250.5 AND x2 > 250.5 AND x2 < 1250.5 AND mx > 250.5 AND mx < 1250.5 AND y1 > 50.5 AND y1 < 650.5 AND y2 > 50.5 AND y2 < 650.5 AND my > 50.5 AND my < 650.5"))
def edges_in_polygon(spark, sf_dir):
    ring = [(250.5, 50.5), (1250.5, 50.5), (1250.5, 650.5), (250.5, 650.5), (250.5, 50.5)]
    return select.in_polygon(X.segments(spark, sf_dir), ring, "fid", within=True)


@register("way_horizon", _recursive(seg("SELECT node AS id, min(dist) AS horizon FROM hz GROUP BY node", LINES + """,
adj AS (SELECT src, dst FROM lg UNION ALL SELECT dst, src FROM lg), top AS (SELECT way FROM wlen ORDER BY round(length, 3) DESC, way LIMIT (SELECT floor(count(*) / 100 * 5)::INT FROM wlen)),
hz(node, dist) AS (SELECT way, 0 FROM top UNION SELECT adj.dst, dist + 1 FROM hz JOIN adj ON adj.src = node WHERE dist < 3)""")))
def way_horizon(spark, sf_dir):
    w, e = named_ways(spark, sf_dir)
    w = w.withColumn("l", F.round("length", 3))
    top = select.top_features(w, "l", 5, "way_id").withColumnRenamed("way_id", "id")
    return select.horizon(materialise(ways.line_graph(ways.way_places(e)), "lg"), top, 3)


STATES = X.STATES_SQL


def states(spark, sf_dir):
    """Two states of the network, each with ways."""
    s = X.segments(spark, sf_dir).withColumns({"v": X.lattice_key(G.start_point("geom")), "w": X.lattice_key(G.end_point("geom"))})
    out = []
    for pairs in X.state_pairs(spark, sf_dir):
        _, e = topology.build_graph(s.join(pairs, ["v", "w"], "left_semi").drop("v", "w"), snap=0, key=X.lattice_key)
        out.append(ways.build_ways(places.one_place_per_vertex(e), attribute=True, geometry=False))
    return out


def _diff(spark, sf_dir):
    (_, a), (_, b) = states(spark, sf_dir)
    a, b = a.withColumn("acces", F.lit(None).cast("double")), b.withColumn("acces", F.lit(None).cast("double"))
    return a, b, materialise(diff.paired(a, b), "pairs")


@register("diff_paired", seg("SELECT fid AS fid1, fid AS fid2 FROM sa JOIN sb USING (fid)", STATES))
def diff_paired(spark, sf_dir):
    return _diff(spark, sf_dir)[2].select("fid1", "fid2")


@register("diff_removed", seg("SELECT fid, round(length, 6) AS length FROM sa WHERE fid NOT IN (SELECT fid FROM sb)", STATES))
def diff_removed(spark, sf_dir):
    a, _, p = _diff(spark, sf_dir)
    return diff.removed(a, p).select("fid", F.round("length", 6).alias("length"))


@register("diff_added", seg("SELECT fid, round(length, 6) AS length FROM sb WHERE fid NOT IN (SELECT fid FROM sa)", STATES))
def diff_added(spark, sf_dir):
    _, b, p = _diff(spark, sf_dir)
    return diff.added(b, p).select("fid", F.round("length", 6).alias("length"))


@register("diff_accessibility")
def diff_accessibility(spark, sf_dir):
    st, full = states(spark, sf_dir), []
    for w, e in st:
        g = materialise(ways.line_graph(ways.way_places(e)), "lg")
        r = indicators.topological_radius(g, w.select(F.col("way_id").alias("id"), "length"))
        full.append((indicators.on_edges(e, r, "acces").fillna(0.0, ["acces"]), g))
    (a, ga), (b, gb) = full
    p, _, _ = diff.structural_diff(a, b, ga, gb)
    return p.select("fid1", "fid2", *[F.round(c, 3).alias(c) for c in ("diff", "removed", "added", "delta")])
