"""Registered queries of the graph analytics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from waygraph.operators import indicators, paths, places, sanitize, topology
from waygraph.operators.graph import bipartite as B
from waygraph.operators.graph import centrality as C
from waygraph.operators.graph import cluster as K
from waygraph.operators.graph import matrix as L
from waygraph.operators.graph import structure as V
from waygraph.operators.graph import traverse as T
from waygraph.plans.stages import materialise, table
from waygraph.queries import _recursive, gathered, named_ways, network, register, searched, seg
from waygraph.sources import fixtures as X

#: The street graph in SQL.
ST = "st AS (SELECT v AS src, w AS dst, floor(length)::INT AS w FROM seg), sy AS (SELECT src, dst, w FROM st UNION ALL SELECT dst, src, w FROM st), dg AS (SELECT src AS id, count(*) AS k FROM sy GROUP BY src)"
#: Supplier by part, and the digraph of event types.
SP = "WITH sp AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), kb AS (SELECT dst, count(*) AS b FROM sp GROUP BY dst), kt AS (SELECT src, count(*) AS a FROM sp GROUP BY src)"
EV = "WITH ev0 AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), ev AS (SELECT src, dst, count(*) AS w FROM ev0 WHERE dst IS NOT NULL GROUP BY ALL)"




def iterated(step: str, start: str, most: str, ids: str = "dg", links: str = "sy") -> str:
    """SQL of a power iteration: ``it(n, id, x, err)``; ``step`` is the new value from ``x`` and ``s``, the sum of x over links in."""
    return f"""it(n, id, x, err) AS (SELECT 0, id, {start}, 1e300::DOUBLE FROM {ids}
UNION ALL SELECT n + 1, id, y, sum(abs(y - x)) OVER () FROM (SELECT p.n, p.id, p.x, {step} AS y FROM it p LEFT JOIN (SELECT e.dst AS id, sum(q.x) AS s FROM it q JOIN {links} e ON e.src = q.id GROUP BY e.dst) z USING (id) WHERE p.err >= {most}))"""


#: Core numbers in SQL: for every k nodes of degree below k go, until none does.
CORES = ", cores(k, n, id, was, now) AS (SELECT ks.k, 0, dg.id, (SELECT count(*) + 1 FROM dg), (SELECT count(*) FROM dg) FROM dg, (SELECT unnest(range(1, (SELECT max(k) FROM dg) + 1)) AS k) ks UNION ALL SELECT k, n + 1, id, was, count(*) OVER (PARTITION BY k) FROM (SELECT c.k, c.n, c.id, any_value(c.now) AS was FROM cores c JOIN sy e ON e.src = c.id JOIN cores o ON o.k = c.k AND o.id = e.dst WHERE c.now < c.was GROUP BY c.k, c.n, c.id HAVING count(*) >= c.k)), core AS (SELECT id, max(k)::INT AS core FROM cores c WHERE was = now AND n > 0 GROUP BY id)"


def street(spark, sf_dir):
    """The street graph ``src, dst``."""
    return X.street_graph(spark, sf_dir).select("src", "dst")


def rows_of(spark, sf_dir):
    """Lattice rows as blocks of the street graph: ``id, block``."""
    return V.nodes(street(spark, sf_dir)).select("id", F.floor(F.col("id") / 30).alias("block"))


def simple(name, sql, build):
    """Register a one-line query."""
    register(name, sql)(build)


def r9(df, *names):
    """Columns rounded to 9 digits."""
    return df.withColumns({n: F.round(n, 9) for n in names})


simple("degrees", seg("SELECT id, k AS degree FROM dg", ST), lambda s, d: V.degrees(street(s, d)))
simple("weighted_degrees", seg("SELECT src AS id, sum(w)::BIGINT AS degree FROM sy GROUP BY src", ST), lambda s, d: V.degrees(X.street_graph(s, d), "w"))
simple("degree_histogram", seg("SELECT degree, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(k) FROM dg) + 1)) AS degree) LEFT JOIN (SELECT k AS degree, count(*) AS n FROM dg GROUP BY k) USING (degree)", ST), lambda s, d: V.degree_histogram(street(s, d)))
simple("graph_summary", seg("SELECT n AS nodes, m AS edges, round(2.0*m/(n*(n-1)), 9) AS density, 0 AS selfloops FROM (SELECT (SELECT count(*) FROM dg) AS n, (SELECT count(*) FROM st) AS m)", ST), lambda s, d: r9(V.summary(street(s, d)), "density"))
simple("adjacency_lists", seg("SELECT src AS id, array_to_string(list_sort(list(dst)), ',') AS neighbours FROM sy GROUP BY src", ST), lambda s, d: V.to_adjacency(street(s, d)).select("id", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours")))
simple("edges_from_adjacency", seg("SELECT src, dst FROM st", ST), lambda s, d: V.from_adjacency(V.to_adjacency(street(s, d))))
simple("simple_from_multi", "SELECT l_suppkey AS src, l_partkey AS dst, max(l_orderkey) AS last FROM lineitem GROUP BY ALL", lambda s, d: V.from_edges(table(s, d, "lineitem").select("l_suppkey", "l_partkey", F.col("l_orderkey").alias("last")), "l_suppkey", "l_partkey", "last", directed=True))
simple("weight_checks", EV + " SELECT true AS weighted, false AS negative", lambda s, d: V.weight_checks(X.event_transitions(s, d)))
simple("induced_subgraph", seg("SELECT src, dst FROM st WHERE src IN (SELECT id FROM dg WHERE k >= 4) AND dst IN (SELECT id FROM dg WHERE k >= 4)", ST), lambda s, d: V.subgraph(street(s, d), V.degrees(street(s, d)).filter("degree >= 4")))
simple("restricted_view", seg("SELECT src, dst FROM st WHERE src NOT IN (SELECT id FROM dg WHERE k < 3) AND dst NOT IN (SELECT id FROM dg WHERE k < 3) AND dst <> src + 1", ST), lambda s, d: V.restricted(street(s, d), V.degrees(street(s, d)).filter("degree < 3"), street(s, d).filter("dst = src + 1")))
simple("reversed", EV + " SELECT dst AS src, src AS dst, w FROM ev", lambda s, d: V.reverse(X.event_transitions(s, d)))
simple("common_neighbours", seg("SELECT e.src AS u, e.dst AS v, a.dst AS w FROM st e JOIN sy a ON a.src = e.src JOIN sy b ON b.src = e.dst AND b.dst = a.dst", ST), lambda s, d: V.common_neighbours(street(s, d), street(s, d).select(F.col("src").alias("u"), F.col("dst").alias("v"))))
simple("non_edges_of_rows", seg("SELECT a.id AS src, b.id AS dst FROM dg a JOIN dg b ON a.id // 30 = b.id // 30 AND a.id < b.id WHERE NOT EXISTS (SELECT 1 FROM st WHERE src = a.id AND dst = b.id)", ST), lambda s, d: V.non_edges(street(s, d), (lambda r: r.select(F.col("id").alias("src"), "block").join(r.select(F.col("id").alias("dst"), "block"), "block").filter("src < dst").select("src", "dst"))(rows_of(s, d))))
simple("integer_labels", seg("SELECT id AS old, row_number() OVER (ORDER BY k DESC, id) - 1 AS new FROM dg", ST), lambda s, d: V.integer_labels(street(s, d), ordering="decreasing"))
simple("relabelled", seg("SELECT src + 1000 AS src, dst + 1000 AS dst FROM st", ST), lambda s, d: V.relabel(street(s, d), V.nodes(street(s, d)).select(F.col("id").alias("old"), (F.col("id") + 1000).alias("new"))))
STATE = ST + "," + X.STATES_SQL + ", ga AS (SELECT v AS src, w AS dst FROM sa), gb AS (SELECT v AS src, w AS dst FROM sb)"


def two(s, d):
    """Two states of the street graph."""
    return tuple(g.select(F.col("v").alias("src"), F.col("w").alias("dst")) for g in X.state_pairs(s, d))


simple("graph_intersection", seg("SELECT * FROM ga INTERSECT SELECT * FROM gb", STATE), lambda s, d: V.intersection(*two(s, d)))
simple("graph_difference", seg("SELECT * FROM ga EXCEPT SELECT * FROM gb", STATE), lambda s, d: V.difference(*two(s, d)))
simple("graph_symmetric_difference", seg("(SELECT * FROM ga EXCEPT SELECT * FROM gb) UNION ALL (SELECT * FROM gb EXCEPT SELECT * FROM ga)", STATE), lambda s, d: V.symmetric_difference(*two(s, d)))
simple("graph_composition", seg("SELECT src, dst, max(state) AS state FROM (SELECT src, dst, 1 AS state FROM ga UNION ALL SELECT src, dst, 2 FROM gb) GROUP BY ALL", STATE), lambda s, d: V.compose(*[g.withColumn("state", F.lit(i + 1)) for i, g in enumerate(two(s, d))]))
EP = EV + ", e2 AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ev WHERE src <> dst), es AS (SELECT src, dst FROM e2 UNION ALL SELECT dst, src FROM e2), n AS (SELECT DISTINCT src AS id FROM es)"


def event_pairs(s, d):
    """Undirected graph of event types that follow each other."""
    return V.canonical(X.event_transitions(s, d).filter("src <> dst")).distinct()


def _flat(df):
    return df.select(*[F.concat_ws("/", f"{c}.g", f"{c}.h").alias(c) for c in ("src", "dst")])


simple("cartesian_product", EP + ", p AS (SELECT n.id || '/' || es.src AS a, n.id || '/' || es.dst AS b FROM n, es UNION SELECT es.src || '/' || n.id, es.dst || '/' || n.id FROM n, es) SELECT a AS src, b AS dst FROM p WHERE a < b", lambda s, d: _flat(V.product(event_pairs(s, d), event_pairs(s, d), "cartesian")))
simple("tensor_product", EP + ", p AS (SELECT x.src || '/' || y.src AS a, x.dst || '/' || y.dst AS b FROM es x, es y) SELECT DISTINCT a AS src, b AS dst FROM p WHERE a < b", lambda s, d: _flat(V.product(event_pairs(s, d), event_pairs(s, d), "tensor")))
simple("graph_power", seg("SELECT DISTINCT a.src, b.dst FROM sy a JOIN sy b ON a.dst = b.src WHERE a.src < b.dst UNION SELECT src, dst FROM st", ST), lambda s, d: V.power(street(s, d), 2))
simple("quotient", seg("SELECT least(src//30, dst//30) AS src, greatest(src//30, dst//30) AS dst, count(*) AS weight FROM st WHERE src//30 <> dst//30 GROUP BY ALL", ST), lambda s, d: V.quotient(street(s, d), rows_of(s, d)))
simple("block_facts", seg("SELECT id//30 AS block, count(*) AS nnodes, any_value(coalesce(m, 0)) AS nedges, round(CASE WHEN count(*) > 1 THEN 2.0*any_value(coalesce(m, 0))/(count(*)*(count(*)-1)) ELSE 0 END, 9) AS density FROM dg LEFT JOIN (SELECT src//30 AS b, count(*) AS m FROM st WHERE src//30 = dst//30 GROUP BY 1) ON b = id//30 GROUP BY id//30", ST), lambda s, d: r9(V.block_facts(street(s, d), rows_of(s, d)), "density"))
simple("line_graph", seg("SELECT DISTINCT a.src*100000 + a.dst AS a, b.src*100000 + b.dst AS b FROM st a JOIN st b ON a.src = b.src OR a.src = b.dst OR a.dst = b.src OR a.dst = b.dst WHERE (a.src, a.dst) < (b.src, b.dst)", ST), lambda s, d: V.line_graph(street(s, d)).select((F.col("a.src") * 100000 + F.col("a.dst")).alias("a"), (F.col("b.src") * 100000 + F.col("b.dst")).alias("b")))
simple("directed_line_graph", seg("SELECT a.src*100000 + a.dst AS a, b.src*100000 + b.dst AS b FROM st a JOIN st b ON a.dst = b.src", ST), lambda s, d: V.line_graph(street(s, d), True).select((F.col("a.src") * 100000 + F.col("a.dst")).alias("a"), (F.col("b.src") * 100000 + F.col("b.dst")).alias("b")))
simple("ego_graph", _recursive(seg("SELECT src, dst FROM st WHERE src IN (SELECT node FROM b) AND dst IN (SELECT node FROM b)", ST + ", b(node, dist) AS (SELECT 31, 0 UNION SELECT dst, dist + 1 FROM b JOIN sy ON src = node WHERE dist < 3)")), lambda s, d: V.ego(street(s, d), 31, 3))
simple("stochastic", EV + " SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS w FROM ev", lambda s, d: r9(V.stochastic(X.event_transitions(s, d)), "w"))
simple("edge_boundary", seg("SELECT src, dst FROM sy WHERE src IN (SELECT id FROM dg WHERE k >= 5) AND dst NOT IN (SELECT id FROM dg WHERE k >= 5)", ST), lambda s, d: V.edge_boundary(street(s, d), V.degrees(street(s, d)).filter("degree >= 5")))
simple("node_boundary", seg("SELECT DISTINCT dst AS id FROM sy WHERE src IN (SELECT id FROM dg WHERE k >= 5) AND dst NOT IN (SELECT id FROM dg WHERE k >= 5)", ST), lambda s, d: V.node_boundary(street(s, d), V.degrees(street(s, d)).filter("degree >= 5")))
simple("isolates", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", lambda s, d: V.isolates(table(s, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst")), table(s, d, "customer").select(F.col("c_custkey").alias("id"))))
simple("selfloops", EV + " SELECT * FROM ev WHERE src = dst", lambda s, d: V.selfloops(X.event_transitions(s, d)))

simple("degree_centrality", seg("SELECT id, round(k / ((SELECT count(*) FROM dg) - 1), 9) AS value FROM dg", ST), lambda s, d: r9(C.degree_centrality(street(s, d)), "value"))
simple("out_degree_centrality", EV + ", n AS (SELECT src AS id FROM ev UNION SELECT dst FROM ev) SELECT id, round((SELECT count(*) FROM ev WHERE src = id) / ((SELECT count(*) FROM n) - 1), 9) AS value FROM n", lambda s, d: r9(C.degree_centrality(X.event_transitions(s, d), "src"), "value"))
simple("s_metric", seg("SELECT sum(a.k * b.k)::BIGINT AS value FROM st JOIN dg a ON a.id = src JOIN dg b ON b.id = dst", ST), lambda s, d: C.s_metric(street(s, d)))
simple("rich_club", seg("SELECT k, round(2.0*m/(n*(n-1)), 9) AS value FROM (SELECT t.k, (SELECT count(*) FROM dg WHERE dg.k > t.k) AS n, (SELECT count(*) FROM st JOIN dg a ON a.id = src JOIN dg b ON b.id = dst WHERE a.k > t.k AND b.k > t.k) AS m FROM (SELECT unnest(range(0, (SELECT max(k) FROM dg))) AS k) t) WHERE n > 1", ST), lambda s, d: r9(C.rich_club(street(s, d)), "value"))
simple("overall_reciprocity", EV + " SELECT round((SELECT count(*) FROM ev a JOIN ev b ON a.src = b.dst AND a.dst = b.src) / count(*), 9) AS value FROM ev", lambda s, d: r9(C.overall_reciprocity(X.event_transitions(s, d)), "value"))
simple("reciprocity", EV + ", e AS (SELECT src, dst FROM ev WHERE src <> dst), k AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT id, round(2.0 * (SELECT count(*) FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src = id) / k, 9) AS value FROM k", lambda s, d: r9(C.reciprocity(X.event_transitions(s, d)), "value"))
simple("betweenness_centrality", _recursive(seg("SELECT id, round(coalesce(v, 0.0) / (((SELECT count(*) FROM dg) - 1) * ((SELECT count(*) FROM dg) - 2)), 9) AS value FROM dg LEFT JOIN (SELECT node AS id, sum(delta) AS v FROM dl GROUP BY node) USING (id)", ST + "," + searched("sy", "dg") + "," + gathered("betweenness", "sy"))), lambda s, d: r9(C.betweenness_centrality(street(s, d)), "value"))
simple("edge_betweenness_centrality", _recursive(seg("SELECT least(e.src, e.dst) AS src, greatest(e.src, e.dst) AS dst, round(sum(x.sigma / y.sigma * (1 + y.delta)) / ((SELECT count(*) FROM dg) * ((SELECT count(*) FROM dg) - 1)), 9) AS value FROM bf x JOIN sy e ON e.src = x.node JOIN dl y ON y.root = x.root AND y.node = e.dst AND y.lvl = x.dist + 1 GROUP BY 1, 2", ST + "," + searched("sy", "dg") + "," + gathered("betweenness", "sy"))), lambda s, d: r9(C.edge_betweenness_centrality(street(s, d)), "value"))
simple("closeness_centrality", _recursive(seg("SELECT root AS id, round(CASE WHEN sum(dist) > 0 THEN (count(*) - 1) / sum(dist) * (count(*) - 1) / ((SELECT count(*) FROM dg) - 1) ELSE 0 END, 9) AS value FROM bf GROUP BY root", ST + "," + searched("sy", "dg"))), lambda s, d: r9(C.closeness_centrality(street(s, d)), "value"))
simple("harmonic_centrality", _recursive(seg("SELECT node AS id, round(coalesce(sum(1.0::DOUBLE / nullif(dist, 0)), 0), 9) AS value FROM bf GROUP BY node", ST + "," + searched("sy", "dg"))), lambda s, d: r9(C.harmonic_centrality(street(s, d)), "value"))
simple("load_centrality", _recursive(seg("SELECT id, round(coalesce(v, 0.0) / (((SELECT count(*) FROM dg) - 1) * ((SELECT count(*) FROM dg) - 2)), 9) AS value FROM dg LEFT JOIN (SELECT node AS id, sum(delta - 1) AS v FROM dl GROUP BY node) USING (id)", ST + "," + searched("sy", "dg") + "," + gathered("load", "sy"))), lambda s, d: r9(C.load_centrality(street(s, d)), "value"))
simple("eigenvector_centrality", _recursive(EP + """, ew(n, id, x, err) AS (SELECT 0, id, 1.0::DOUBLE / (SELECT count(*) FROM n), 1e300::DOUBLE FROM n UNION ALL SELECT n + 1, id, y, sum(abs(y - x)) OVER () FROM (SELECT p.n, p.id, p.x, (p.x + coalesce(z.s, 0)) / sqrt(sum((p.x + coalesce(z.s, 0)) * (p.x + coalesce(z.s, 0))) OVER ()) AS y
FROM ew p LEFT JOIN (SELECT e.dst AS id, sum(q.x) AS s FROM ew q JOIN es e ON e.src = q.id GROUP BY e.dst) z ON z.id = p.id WHERE p.err >= (SELECT count(*) FROM n) * 1e-6)) SELECT id, round(x, 9) AS value FROM ew WHERE n = (SELECT max(n) FROM ew)"""), lambda s, d: r9(C.eigenvector_centrality(event_pairs(s, d)), "value"))
simple("katz_centrality", _recursive(seg("SELECT id, round(x / sqrt(sum(x * x) OVER ()), 6) AS value FROM it WHERE n = (SELECT max(n) FROM it)", ST + "," + iterated("0.1 * coalesce(z.s, 0) + 1.0", "0.0::DOUBLE", "(SELECT count(*) FROM dg) * 1e-6"))), lambda s, d: C.katz_centrality(street(s, d)).withColumn("value", F.round("value", 6)))
CS = "cs AS MATERIALIZED (SELECT DISTINCT o_custkey AS src, l_suppkey + 10000000 AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey), ids AS MATERIALIZED (SELECT src AS id FROM cs UNION SELECT dst FROM cs), ot AS (SELECT src, count(*) AS o FROM cs GROUP BY src)"
simple("pagerank", "WITH RECURSIVE " + CS + """, pr(n, id, x, err) AS (SELECT 0, id, 1.0::DOUBLE / (SELECT count(*) FROM ids), 1e300::DOUBLE FROM ids UNION ALL
SELECT n + 1, id, y, sum(abs(y - x)) OVER () FROM (SELECT p.n, p.id, p.x, 0.85 * (coalesce(z.s, 0) + sum(CASE WHEN ot.o IS NULL THEN p.x ELSE 0 END) OVER () / (SELECT count(*) FROM ids)) + 0.15 / (SELECT count(*) FROM ids) AS y
FROM pr p LEFT JOIN ot ON ot.src = p.id LEFT JOIN (SELECT e.dst AS id, sum(q.x / k.o) AS s FROM pr q JOIN cs e ON e.src = q.id JOIN ot k ON k.src = q.id GROUP BY e.dst) z ON z.id = p.id WHERE p.err >= (SELECT count(*) FROM ids) * 1e-6))
SELECT id, round(x, 12) AS value FROM pr WHERE n = (SELECT max(n) FROM pr)""", lambda s, d: C.pagerank(X.customer_suppliers(s, d)).withColumn("value", F.round("value", 12)))
simple("hits", "WITH RECURSIVE " + CS + """, hh(n, id, x, err) AS (SELECT 0, id, 1.0::DOUBLE / (SELECT count(*) FROM ids), 1e300::DOUBLE FROM ids UNION ALL
SELECT n + 1, id, y, sum(abs(y - x)) OVER () FROM (SELECT p.n, p.id, p.x, coalesce(z.s, 0) / max(coalesce(z.s, 0)) OVER () AS y FROM hh p LEFT JOIN (SELECT e.src AS id, sum(a.s) AS s FROM (SELECT e.dst AS id, sum(q.x) AS s FROM hh q JOIN cs e ON e.src = q.id GROUP BY e.dst) a JOIN cs e ON e.dst = a.id GROUP BY e.src) z ON z.id = p.id WHERE p.err >= 1e-8)),
lh AS (SELECT id, x FROM hh WHERE n = (SELECT max(n) FROM hh)), la AS (SELECT e.dst AS id, sum(x) AS a FROM lh JOIN cs e ON e.src = lh.id GROUP BY e.dst)
SELECT id, round(x / sum(x) OVER (), 12) AS hub, round(coalesce(a, 0) / sum(coalesce(a, 0)) OVER (), 12) AS authority FROM lh LEFT JOIN la USING (id)""", lambda s, d: C.hits(X.customer_suppliers(s, d)).select("id", F.round("hub", 12).alias("hub"), F.round("authority", 12).alias("authority")))
simple("global_efficiency", _recursive(seg("SELECT round(sum(1.0::DOUBLE / nullif(dist, 0)) / ((SELECT count(*) FROM dg) * ((SELECT count(*) FROM dg) - 1)), 9) AS value FROM bf", ST + "," + searched("sy", "dg"))), lambda s, d: C.global_efficiency(street(s, d)).withColumn("value", F.round("value", 9)))
simple("wiener_index", _recursive(seg("SELECT CASE WHEN count(*) = (SELECT count(*) FROM dg) * (SELECT count(*) FROM dg) THEN sum(dist) / 2.0::DOUBLE ELSE 'inf'::DOUBLE END AS value FROM bf", ST + "," + searched("sy", "dg"))), lambda s, d: C.wiener_index(street(s, d)))

TR = ST + ", tr AS (SELECT a.src AS a, a.dst AS b, b.dst AS c FROM st a JOIN st b ON a.dst = b.src JOIN st c ON c.src = a.src AND c.dst = b.dst), tn AS (SELECT id, count(*) AS t FROM (SELECT a AS id FROM tr UNION ALL SELECT b FROM tr UNION ALL SELECT c FROM tr) GROUP BY id)"
CL = "CASE WHEN k > 1 THEN 2.0*coalesce(t, 0)/(k*(k-1)) ELSE 0 END"
simple("triangles", seg("SELECT id, coalesce(t, 0) AS triangles FROM dg LEFT JOIN tn USING (id)", TR), lambda s, d: K.triangles(street(s, d)))
simple("clustering", seg(f"SELECT id, round({CL}, 9) AS value FROM dg LEFT JOIN tn USING (id)", TR), lambda s, d: r9(K.clustering(street(s, d)), "value"))
simple("average_clustering", seg(f"SELECT round(avg({CL}), 9) AS value FROM dg LEFT JOIN tn USING (id)", TR), lambda s, d: r9(K.average_clustering(street(s, d)), "value"))
simple("transitivity", seg("SELECT round(3.0*(SELECT count(*) FROM tr)/sum(k*(k-1)/2), 9) AS value FROM dg", TR), lambda s, d: r9(K.transitivity(street(s, d)), "value"))
simple("generalized_degree", seg("SELECT src AS id, m AS multiplicity, count(*) AS edges FROM (SELECT sy.src, sy.dst, (SELECT count(*) FROM sy a JOIN sy b ON a.dst = b.dst WHERE a.src = sy.src AND b.src = sy.dst) AS m FROM sy) GROUP BY ALL", ST), lambda s, d: K.generalized_degree(street(s, d)))
simple("square_clustering", seg("""SELECT id, round(CASE WHEN p > 0 THEN q / p ELSE 0 END, 9) AS value FROM dg LEFT JOIN (SELECT v AS id, sum(q) AS q, sum((ku - (q + 1 + t)) * (kw - (q + 1 + t)) + q) AS p FROM
(SELECT a.src AS v, x.k AS ku, y.k AS kw, (SELECT count(*) FROM sy c JOIN sy d ON c.dst = d.dst WHERE c.src = a.dst AND d.src = b.dst AND c.dst <> a.src) AS q, (SELECT count(*) FROM sy t WHERE t.src = a.dst AND t.dst = b.dst) AS t
FROM sy a JOIN sy b ON a.src = b.src AND a.dst < b.dst JOIN dg x ON x.id = a.dst JOIN dg y ON y.id = b.dst) GROUP BY v) USING (id)""", ST), lambda s, d: r9(K.square_clustering(street(s, d)), "value"))
simple("core_numbers", _recursive(seg("SELECT id, coalesce(core, 0) AS core FROM dg LEFT JOIN core USING (id)", ST + CORES)), lambda s, d: K.core_number(street(s, d)))
simple("k_core", _recursive(seg("SELECT src, dst FROM st WHERE src IN (SELECT id FROM core WHERE core = (SELECT max(core) FROM core)) AND dst IN (SELECT id FROM core WHERE core = (SELECT max(core) FROM core))", ST + CORES)), lambda s, d: K.k_core(street(s, d)))
simple("modularity", seg("SELECT round(sum(coalesce(l, 0)/m - (dsum/(2*m))*(dsum/(2*m))), 9) AS value FROM (SELECT id//30 AS b, sum(k) AS dsum, (SELECT count(*) FROM st)::DOUBLE AS m FROM dg GROUP BY 1) LEFT JOIN (SELECT src//30 AS b, count(*) AS l FROM st WHERE src//30 = dst//30 GROUP BY 1) USING (b)", ST), lambda s, d: r9(K.modularity(street(s, d), rows_of(s, d).withColumnRenamed("block", "label")), "value"))
simple("partition_quality", seg("""SELECT i AS intra_edges, m - i AS inter_edges, ((n*n - q)/2 - (m - i))::BIGINT AS inter_non_edges, round(i/m, 9) AS coverage, round((i + (n*n - q)/2 - (m - i))/(n*(n-1)/2), 9) AS performance
FROM (SELECT (SELECT count(*) FROM st WHERE src//30 = dst//30) AS i, (SELECT count(*) FROM st) AS m, (SELECT count(*) FROM dg) AS n, (SELECT sum(c*c) FROM (SELECT count(*) AS c FROM dg GROUP BY id//30)) AS q)""", ST), lambda s, d: r9(K.partition_quality(street(s, d), rows_of(s, d).withColumnRenamed("block", "label")), "coverage", "performance"))
simple("cut_measures", seg("""SELECT cut, volume, volume_other, round(cut/volume + cut/volume_other, 9) AS normalized_cut, round(cut/least(volume, volume_other), 9) AS conductance, round(cut/least(n, o), 9) AS edge_expansion, round(cut/(volume + volume_other), 9) AS mixing_expansion, round(nn/n, 9) AS node_expansion, round(nb/n, 9) AS boundary_expansion FROM
(SELECT count(*) FILTER (a AND NOT b) AS cut, count(*) FILTER (a) AS volume, count(*) FILTER (NOT a) AS volume_other, count(DISTINCT dst) FILTER (a) AS nn, count(DISTINCT dst) FILTER (a AND NOT b) AS nb FROM (SELECT sy.*, src % 30 < 10 AS a, dst % 30 < 10 AS b FROM sy)), (SELECT count(*) FILTER (id % 30 < 10) AS n, count(*) FILTER (id % 30 >= 10) AS o FROM dg)""", ST), lambda s, d: r9(K.cut_measures(street(s, d), V.nodes(street(s, d)).filter("id % 30 < 10")), "normalized_cut", "conductance", "edge_expansion", "mixing_expansion", "node_expansion", "boundary_expansion"))
simple("constraint", seg("SELECT u AS id, round(sum((p + coalesce(i, 0))*(p + coalesce(i, 0))), 9) AS value FROM (SELECT src AS u, dst AS v, 1.0::DOUBLE/k AS p FROM sy JOIN dg ON id = src) LEFT JOIN (SELECT a.src AS u, b.dst AS v, sum(1.0::DOUBLE/x.k/y.k) AS i FROM sy a JOIN sy b ON a.dst = b.src JOIN dg x ON x.id = a.src JOIN dg y ON y.id = b.src WHERE a.src <> b.dst GROUP BY ALL) USING (u, v) GROUP BY u", ST), lambda s, d: r9(K.constraint(street(s, d)), "value"))
simple("effective_size", seg("SELECT id, round(k - 2.0*coalesce(t, 0)/k, 9) AS value FROM dg LEFT JOIN tn USING (id)", TR), lambda s, d: r9(K.effective_size(street(s, d)), "value"))
simple("triadic_census", seg("""SELECT unnest(['003', '012', '102', '021D', '021U', '021C', '111D', '111U', '030T', '030C', '201', '120D', '120U', '120C', '210', '300']) AS type,
unnest([n*(n-1)*(n-2)//6 - (m*(n-2) - 2*(d+u+c) - 3*t) - d - u - c - t, m*(n-2) - 2*(d+u+c) - 3*t, 0, d, u, c, 0, 0, t, 0, 0, 0, 0, 0, 0, 0])::BIGINT AS n FROM
(SELECT (SELECT count(*) FROM dg) AS n, (SELECT count(*) FROM st) AS m, t, (SELECT sum(o*(o-1)//2) FROM io) - t AS d, (SELECT sum(i*(i-1)//2) FROM io) - t AS u, (SELECT sum(o*i) FROM io) - t AS c FROM (SELECT count(*) AS t FROM tr))""", TR + ", io AS (SELECT id, (SELECT count(*) FROM st WHERE src = id) AS o, (SELECT count(*) FROM st WHERE dst = id) AS i FROM dg)"), lambda s, d: K.triadic_census(street(s, d)))
LP = ST + ", cm AS (SELECT a.src AS u, b.src AS v, a.dst AS x FROM sy a JOIN sy b ON a.dst = b.dst WHERE a.src < b.src AND NOT EXISTS (SELECT 1 FROM st WHERE st.src = a.src AND st.dst = b.src))"
simple("link_scores", seg("SELECT u, v, count(*) AS common, round(sum(1/ln(x.k)), 9) AS adamic_adar, round(sum(1.0::DOUBLE/x.k), 9) AS resource_allocation, round(count(*)/(any_value(a.k) + any_value(b.k) - count(*)), 9) AS jaccard, any_value(a.k)*any_value(b.k) AS preferential_attachment FROM cm JOIN dg x ON x.id = x JOIN dg a ON a.id = u JOIN dg b ON b.id = v GROUP BY u, v".replace("x.id = x ", "x.id = cm.x "), LP), lambda s, d: r9(K.link_scores(street(s, d)), "adamic_adar", "resource_allocation", "jaccard"))
simple("community_link_scores", seg("""SELECT u, v, count(*) AS common, round(sum(1/ln(kx)), 9) AS adamic_adar, round(sum(1.0::DOUBLE/kx), 9) AS resource_allocation, round(count(*)/(any_value(ku) + any_value(kv) - count(*)), 9) AS jaccard, any_value(ku)*any_value(kv) AS preferential_attachment,
count(*) + count(*) FILTER (own) AS cn_community, round(coalesce(sum(1.0::DOUBLE/kx) FILTER (own), 0), 9) AS ra_community, round(CASE WHEN any_value(same) THEN count(*) FILTER (own) / (count(*) - count(*) FILTER (own) + 0.001::DOUBLE) ELSE 0 END, 9) AS within_inter
FROM (SELECT u, v, o.k AS kx, a.k AS ku, b.k AS kv, u//30 = v//30 AS same, u//30 = v//30 AND cm.x//30 = u//30 AS own FROM cm JOIN dg o ON o.id = cm.x JOIN dg a ON a.id = u JOIN dg b ON b.id = v) GROUP BY u, v""", LP), lambda s, d: r9(K.link_scores(street(s, d), None, rows_of(s, d).withColumnRenamed("block", "label")), "adamic_adar", "resource_allocation", "jaccard", "ra_community", "within_inter"))
MX = ST + ", nv AS (SELECT c_custkey AS id, c_mktsegment AS s, c_acctbal AS b FROM customer), mx AS (SELECT a.s AS x, b.s AS y, count(*) AS n FROM sy JOIN nv a ON a.id = src JOIN nv b ON b.id = dst GROUP BY ALL)"


def segment_of(s, d):
    """Market segments and balances of customers as node attributes."""
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"), F.col("c_acctbal").alias("balance"))


simple("attribute_mixing", seg("SELECT * FROM mx", MX), lambda s, d: K.mixing(street(s, d), segment_of(s, d)))
simple("attribute_assortativity", seg("SELECT round((t - ab)/(1 - ab), 9) AS value FROM (SELECT (SELECT sum(n) FILTER (x = y)/sum(n) FROM mx) AS t, (SELECT sum(a*a) FROM (SELECT sum(n)/(SELECT sum(n) FROM mx) AS a FROM mx GROUP BY x)) AS ab)", MX), lambda s, d: r9(K.attribute_assortativity(street(s, d), segment_of(s, d)), "value"))
simple("numeric_assortativity", seg("SELECT round(corr(a.b, b.b), 9) AS value FROM sy JOIN nv a ON a.id = src JOIN nv b ON b.id = dst", MX), lambda s, d: r9(K.numeric_assortativity(street(s, d), segment_of(s, d), "balance"), "value"))
simple("degree_assortativity", seg("SELECT round(corr(a.k, b.k), 9) AS value FROM sy JOIN dg a ON a.id = src JOIN dg b ON b.id = dst", ST), lambda s, d: r9(K.degree_assortativity(street(s, d)), "value"))
simple("average_neighbour_degree", seg("SELECT src AS id, round(avg(k), 9) AS value FROM sy JOIN dg ON id = dst GROUP BY src", ST), lambda s, d: r9(K.average_neighbour_degree(street(s, d)), "value"))
simple("average_degree_connectivity", seg("SELECT a.k AS degree, round(avg(b.k), 9) AS value FROM sy JOIN dg a ON a.id = src JOIN dg b ON b.id = dst GROUP BY a.k", ST), lambda s, d: r9(K.average_degree_connectivity(street(s, d)), "value"))
simple("triangles_as_cliques", seg("SELECT a || ',' || b || ',' || c AS members FROM tr", TR), lambda s, d: K.k_cliques(street(s, d), 3).select(F.array_join(F.col("members").cast("array<string>"), ",").alias("members")))
simple("cliques_per_node", seg("""SELECT id, count(*) AS cliques, max(k)::INT AS largest FROM (SELECT unnest(m) AS id, len(m) AS k FROM (
SELECT [a, b, c, d] AS m FROM q4 UNION ALL SELECT [a, b, c] FROM tr WHERE NOT EXISTS (SELECT 1 FROM sy x JOIN sy y ON x.dst = y.dst JOIN sy z ON z.dst = x.dst WHERE x.src = a AND y.src = b AND z.src = c)
UNION ALL SELECT [src, dst] FROM st WHERE NOT EXISTS (SELECT 1 FROM sy x JOIN sy y ON x.dst = y.dst WHERE x.src = st.src AND y.src = st.dst))) GROUP BY id""", TR + ", q4 AS (SELECT t.a, t.b, t.c, x.dst AS d FROM tr t JOIN st x ON x.src = t.c JOIN st y ON y.src = t.b AND y.dst = x.dst JOIN st z ON z.src = t.a AND z.dst = x.dst)"), lambda s, d: K.cliques_of_nodes(K.maximal_cliques(street(s, d))))
simple("k_clique_communities", _recursive(seg("SELECT DISTINCT c AS community, unnest([a, b, x]) AS id FROM (SELECT l.c, q.a, q.b, q.x FROM kc l JOIN q3 q ON q.n = l.n)", TR + """, q3 AS (SELECT a, b, c AS x, a || ',' || b || ',' || c AS n FROM tr), sd AS (SELECT n, a || '-' || b AS s FROM q3 UNION ALL SELECT n, a || '-' || x FROM q3 UNION ALL SELECT n, b || '-' || x FROM q3), nx AS (SELECT DISTINCT p.n AS f, q.n AS t FROM sd p JOIN sd q USING (s) WHERE p.n <> q.n),
kc(n, c) USING KEY (n) AS (SELECT n, n FROM q3 UNION SELECT e.t, min(p.c) FROM kc p JOIN nx e ON e.f = p.n LEFT JOIN recurring.kc AS r ON r.n = e.t WHERE p.c < r.c GROUP BY e.t)""")), lambda s, d: K.k_clique_communities(street(s, d), 3))
simple("label_propagation", None, lambda s, d: K.asyn_label_propagation(street(s, d)))

CC = ", cc(id, c) USING KEY (id) AS (SELECT id, id FROM dg UNION SELECT e.dst, min(p.c) FROM cc p JOIN sy e ON e.src = p.id LEFT JOIN recurring.cc AS r ON r.id = e.dst WHERE p.c < r.c GROUP BY e.dst)"
simple("connected_components", _recursive(seg("SELECT id, c AS component FROM cc", ST + CC)), lambda s, d: T.components(street(s, d)))
simple("hop_distances", _recursive(seg("SELECT root, node, dist FROM bf", ST + ", z AS (SELECT 0::BIGINT AS id)," + searched("sy", "z"))), lambda s, d: T.hop_distances(street(s, d), s.range(1)))
simple("bfs_tree", _recursive(seg("SELECT min(e.src) AS pred, b.node, any_value(b.dist) AS dist FROM bf b JOIN sy e ON e.dst = b.node JOIN bf a ON a.node = e.src AND a.dist = b.dist - 1 GROUP BY b.node", ST + ", z AS (SELECT 0::BIGINT AS id)," + searched("sy", "z"))), lambda s, d: T.bfs_tree(street(s, d), 0))
simple("weighted_distances", _recursive(seg("SELECT node, dist::DOUBLE AS dist FROM wd", ST + ", wd(node, dist) USING KEY (node) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT e.dst, min(p.dist + e.w) FROM wd p JOIN sy e ON e.src = p.node LEFT JOIN recurring.wd AS r ON r.node = e.dst WHERE r.dist IS NULL OR p.dist + e.w < r.dist GROUP BY e.dst)")), lambda s, d: T.weighted_distances(X.street_graph(s, d), s.range(1)).select("node", "dist"))
simple("eccentricity", _recursive(seg("SELECT root AS id, max(dist) AS value FROM bf WHERE root IN (SELECT node FROM bf WHERE root = (SELECT root FROM bf GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)) GROUP BY root", ST + "," + searched("sy", "dg"))), lambda s, d: T.eccentricity(T.largest_component(street(s, d))))
simple("topological_levels", "SELECT DISTINCT o_custkey AS id, 0 AS level FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT DISTINCT l_suppkey + 10000000, 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT DISTINCT l_partkey + 20000000, 2 FROM lineitem", lambda s, d: T.topological_levels(X.customer_suppliers(s, d).unionByName(X.supplier_parts(s, d).select((F.col("src") + 10_000_000).alias("src"), (F.col("dst") + 20_000_000).alias("dst")))))
simple("maximal_matching", _recursive(seg("SELECT e.src, e.dst FROM mm JOIN es e USING (i) WHERE took", ST + """, es AS (SELECT row_number() OVER (ORDER BY src, dst) AS i, src, dst FROM st),
mm(i, used, took) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL SELECT e.i, CASE WHEN f THEN list_append(list_append(used, e.src), e.dst) ELSE used END, f FROM (SELECT e.*, m.used, NOT list_contains(m.used, e.src) AND NOT list_contains(m.used, e.dst) AS f FROM mm m JOIN es e ON e.i = m.i + 1) e)""")), lambda s, d: T.maximal_matching(street(s, d)))
simple("independent_set", None, lambda s, d: T.independent_set(street(s, d)))
simple("bridges", None, lambda s, d: T.bridges(street(s, d)))
simple("local_bridges", seg("SELECT src, dst FROM st e WHERE NOT EXISTS (SELECT 1 FROM sy a JOIN sy b ON a.dst = b.dst WHERE a.src = e.src AND b.src = e.dst)", ST), lambda s, d: T.local_bridges(street(s, d)))
simple("greedy_color", _recursive(seg("SELECT o.id, colors[len(colors)] AS color FROM gc JOIN od o ON o.i = len(colors)", ST + """, od AS (SELECT row_number() OVER (ORDER BY k DESC, id) AS i, id FROM dg),
nb AS (SELECT o.i, list(q.i) FILTER (q.i < o.i) AS before FROM od o JOIN sy ON src = o.id JOIN od q ON q.id = dst GROUP BY o.i),
gc(colors) AS (SELECT []::INT[] UNION ALL SELECT list_append(colors, list_min(list_filter(range(0, 20), lambda c: NOT list_contains(list_transform(coalesce(before, []), lambda b: colors[b]), c)))::INT) FROM gc JOIN nb ON nb.i = len(colors) + 1)""")), lambda s, d: T.greedy_color(street(s, d)))
simple("is_graphical", seg("SELECT true AS graphical, true AS multigraphical, true AS pseudographical", ST), lambda s, d: T.is_graphical(V.degrees(street(s, d))))
simple("dominating_set", seg("SELECT bool_and(id IN (SELECT src FROM sy WHERE dst % 2 = 0) OR id % 2 = 0) AS value FROM dg", ST), lambda s, d: T.is_dominating(street(s, d), V.nodes(street(s, d)).filter("id % 2 = 0")))

simple("bipartite_density", SP + " SELECT round(count(*)/(count(DISTINCT src)*count(DISTINCT dst)), 9) AS value FROM sp", lambda s, d: r9(B.density(X.supplier_parts(s, d)), "value"))
simple("bipartite_degrees", SP + " SELECT 'top' AS side, src AS id, a AS degree FROM kt UNION ALL SELECT 'bottom', dst, b FROM kb", lambda s, d: B.side_degrees(X.supplier_parts(s, d)))
simple("bipartite_degree_centrality", SP + " SELECT 'top' AS side, src AS id, round(a/(SELECT count(*) FROM kb), 9) AS value FROM kt UNION ALL SELECT 'bottom', dst, round(b/(SELECT count(*) FROM kt), 9) FROM kb", lambda s, d: r9(B.degree_centrality(X.supplier_parts(s, d)), "value"))
PJ = SP + ", pj AS (SELECT x.src AS u, y.src AS v, count(*) AS c, sum(1.0::DOUBLE/(b - 1)) AS nw FROM sp x JOIN sp y USING (dst) JOIN kb USING (dst) WHERE x.src < y.src GROUP BY ALL)"
simple("projection", PJ + " SELECT u, v, c AS w FROM pj", lambda s, d: B.projection(X.supplier_parts(s, d)))
simple("projection_newman", PJ + " SELECT u, v, round(nw, 9) AS w FROM pj", lambda s, d: r9(B.projection(X.supplier_parts(s, d), "newman"), "w"))
simple("projection_jaccard", PJ + " SELECT u, v, round(c/(x.a + y.a - c), 9) AS w FROM pj JOIN kt x ON x.src = u JOIN kt y ON y.src = v", lambda s, d: r9(B.projection(X.supplier_parts(s, d), "jaccard"), "w"))
simple("projection_overlap", PJ + " SELECT u, v, round(c/least(x.a, y.a), 9) AS w FROM pj JOIN kt x ON x.src = u JOIN kt y ON y.src = v", lambda s, d: r9(B.projection(X.supplier_parts(s, d), "overlap"), "w"))
simple("pair_clustering", PJ + ", ov AS (SELECT u, v, c/(x.a + y.a - c) AS w FROM pj JOIN kt x ON x.src = u JOIN kt y ON y.src = v) SELECT id, round(avg(w), 9) AS value FROM (SELECT u AS id, w FROM ov UNION ALL SELECT v, w FROM ov) GROUP BY id", lambda s, d: r9(B.pair_clustering(X.supplier_parts(s, d)), "value"))
simple("robins_alexander", PJ + " SELECT round(4.0*(SELECT sum(c*(c-1)/2) FROM pj)/sum((a-1)*(b-1)), 9) AS value FROM sp JOIN kt USING (src) JOIN kb USING (dst)", lambda s, d: r9(B.robins_alexander(X.supplier_parts(s, d)), "value"))
simple("two_coloring", "SELECT DISTINCT o_custkey AS id, 0 AS color FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT DISTINCT l_suppkey + 10000000, 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey", lambda s, d: B.two_coloring(X.customer_suppliers(s, d)))
simple("node_redundancy", SP + ", x AS (SELECT a.src AS id, a.dst AS p, b.dst AS q FROM sp a JOIN sp b ON a.src = b.src AND a.dst < b.dst), t AS (SELECT p, q FROM x GROUP BY ALL HAVING count(*) > 1) SELECT id, round(count(t.p) / count(*), 9) AS value FROM x LEFT JOIN t USING (p, q) GROUP BY id", lambda s, d: r9(B.node_redundancy(X.supplier_parts(s, d)), "value"))

simple("adjacency_matrix", seg("SELECT src AS i, dst AS j, w::BIGINT AS w FROM sy", ST), lambda s, d: L.adjacency(X.street_graph(s, d), "w"))
simple("incidence_matrix", seg("SELECT fid AS j, v AS i, -1 AS w FROM seg UNION ALL SELECT fid, w, 1 FROM seg"), lambda s, d: L.incidence(network(s, d)[1].select("fid", F.col("start_vtx").alias("src"), F.col("end_vtx").alias("dst")), "fid", True))
simple("laplacian_matrix", seg("SELECT id AS i, id AS j, k AS w FROM dg UNION ALL SELECT src, dst, -1 FROM sy", ST), lambda s, d: L.laplacian(street(s, d)))
simple("normalized_laplacian", seg("SELECT id AS i, id AS j, 1.0::DOUBLE AS w FROM dg UNION ALL SELECT src, dst, round(-1/sqrt(a.k*b.k), 9) FROM sy JOIN dg a ON a.id = src JOIN dg b ON b.id = dst", ST), lambda s, d: r9(L.normalized_laplacian(street(s, d)), "w"))
simple("attribute_matrix", seg("SELECT * FROM (SELECT x, y, n AS w FROM mx)", MX), lambda s, d: L.attribute_matrix(street(s, d), segment_of(s, d)))


def requests(spark, sf_dir):
    """Requests from the first vertex of every lattice row to the last of the next row."""
    n = V.nodes(street(spark, sf_dir))
    r = n.groupBy(F.floor(F.col("id") / 30).alias("row")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return r.select(F.col("row").alias("req"), F.col("lo").alias("source"), "row").join(r.select((F.col("row") - 1).alias("row"), F.col("hi").alias("target")), "row").select("req", "source", "target")


def _graph(spark, sf_dir):
    return materialise(places.edge_graph(places.one_place_per_vertex(network(spark, sf_dir)[1])), "edge-graph")


#: Requests and least sums of a cost in SQL.
REQUESTS = ST + ", rw AS (SELECT id // 30 AS req, min(id) AS lo, max(id) AS hi FROM dg GROUP BY 1), rq AS (SELECT a.req, a.lo, b.hi FROM rw a JOIN rw b ON b.req = a.req + 1)"
COSTS = ", wd(root, node, dist) USING KEY (root, node) AS (SELECT DISTINCT lo, lo, 0::BIGINT FROM rq UNION SELECT p.root, e.dst, min(p.dist + e.c) FROM wd p JOIN we e ON e.src = p.node LEFT JOIN recurring.wd AS r ON r.root = p.root AND r.node = e.dst WHERE r.dist IS NULL OR p.dist + e.c < r.dist GROUP BY p.root, e.dst)"


@register("shortest_paths", _recursive(seg("SELECT req, dist AS length FROM rq JOIN wd ON root = lo AND node = hi", REQUESTS + ", we AS (SELECT src, dst, w::BIGINT AS c FROM sy)" + COSTS)))
def shortest_paths(spark, sf_dir):
    return paths.shortest_path(_graph(spark, sf_dir), requests(spark, sf_dir)).groupBy("req").agg(F.sum("length").alias("length"))


@register("simplest_paths", _recursive(seg("SELECT req, dist AS edges FROM rq JOIN wd ON root = lo AND node = hi", REQUESTS + ", we AS (SELECT src, dst, 1::BIGINT AS c FROM sy)" + COSTS)))
def simplest_paths(spark, sf_dir):
    return paths.simplest_path(_graph(spark, sf_dir), requests(spark, sf_dir)).groupBy("req").agg(F.count(F.lit(1)).alias("edges"))


@register("azimuth_paths")
def azimuth_paths(spark, sf_dir):
    v, e = network(spark, sf_dir)
    p = materialise(v.select(F.col("vid").alias("place"), "pt", "degree"), "p")
    return paths.azimuth_path(places.one_place_per_vertex(e), p, requests(spark, sf_dir)).select("req", "seq", "fid")


@register("naive_azimuth_paths")
def naive_azimuth_paths(spark, sf_dir):
    v, e = network(spark, sf_dir)
    p = materialise(v.select(F.col("vid").alias("place"), "pt", "degree"), "p")
    return paths.azimuth_path(places.one_place_per_vertex(e), p, requests(spark, sf_dir), naive=True).select("req", "seq", "fid")


@register("mesh_paths")
def mesh_paths(spark, sf_dir):
    _, e = network(spark, sf_dir)
    return paths.mesh_path(_graph(spark, sf_dir), e.filter("name in ('E1', 'N3', 'E2', 'N10')").select("fid"), requests(spark, sf_dir)).select("req", "seq", "fid")


@register("edge_graph", seg("SELECT v AS src, w AS dst, floor(length)::INT AS length, fid FROM seg"))
def edge_graph(spark, sf_dir):
    return places.edge_graph(places.one_place_per_vertex(network(spark, sf_dir)[1]))


@register("sanitized_network")
def sanitized_network(spark, sf_dir):
    v, e = topology.build_graph(X.segments(spark, sf_dir), 0.2, 4.0)
    return e.select("fid", F.round("length", 3).alias("length"), "degree")


@register("crossing_points")
def crossing_points(spark, sf_dir):
    return sanitize.crossing_points(X.segments(spark, sf_dir)).select(F.round("pt.x", 6).alias("x"), F.round("pt.y", 6).alias("y"))


@register("edge_closeness")
def edge_closeness(spark, sf_dir):
    g = materialise(indicators.edge_line_graph(places.one_place_per_vertex(network(spark, sf_dir)[1])), "lg")
    return indicators.closeness(g).select(F.col("id").alias("fid"), F.round("closen", 9).alias("closen"))


@register("way_simplest_path")
def way_simplest_path(spark, sf_dir):
    from waygraph.operators import ways as W

    _, e = named_ways(spark, sf_dir)
    e = materialise(e, "e")
    wp = materialise(W.way_places(e), "wp")
    top = wp.agg(F.max("place")).first()[0]
    a, b = (wp.filter(F.col("place") == x).select("way") for x in (0, top))
    return paths.way_simplest_path(e, materialise(W.line_graph(wp), "lg"), a, b, 0, top)
