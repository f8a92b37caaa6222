"""Paths over place edges, for tables of requests (req, source, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waygraph.functions import geom as G
from waygraph.operators.components import connected_components
from waygraph.operators.graph.traverse import paths as follow
from waygraph.operators.ways import departures
from waygraph.plans.kernels import numbered, ordered_ids, relax, routes, search, symmetric
from waygraph.plans.stages import materialise

#: Weight of a free passage inside a mesh component.
SHORTCUT = 0.01


def _steps(routes: DataFrame) -> DataFrame:
    """``req, seq, a, b`` of ``req, path``."""
    s = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("seq"), F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b")))
    return routes.filter(F.size("path") > 1).select("req", F.explode(s).alias("s")).select("req", "s.*")


def with_edges(routes: DataFrame, graph: DataFrame) -> DataFrame:
    """``req, seq, fid`` of node paths on a multigraph (src, dst, length, fid): of parallel edges the shortest, then the least id."""
    g = graph.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), "length", "fid").groupBy("x", "y").agg(F.min(F.struct("length", "fid")).alias("e"))
    s = _steps(routes).withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    return s.join(g, ["x", "y"]).select("req", "seq", F.col("e.fid").alias("fid"), F.col("e.length").alias("length"))


def _routes(steps: DataFrame, requests: DataFrame) -> DataFrame:
    want = requests.select(F.col("source").alias("root"), F.col("target").alias("node")).distinct()
    found = routes(steps, want)
    if found is None:
        d = materialise(relax(steps, requests.select(F.col("source").alias("id")).distinct()), "route")
        found = follow(d, want)
    return requests.join(found, (F.col("source") == F.col("root")) & (F.col("target") == F.col("node"))).select("req", "path")


def shortest_path(graph: DataFrame, requests: DataFrame) -> DataFrame:
    """``req, seq, fid, length``: least sum of lengths; requests without a path are absent."""
    w = graph.select("src", "dst", F.col("length").alias("w"))
    return with_edges(_routes(symmetric(w, "src", "dst", "w"), requests), graph)


def simplest_path(graph: DataFrame, requests: DataFrame) -> DataFrame:
    """``req, seq, fid, length``: fewest edges, ties by least predecessor."""
    w = graph.select("src", "dst", F.lit(1.0).alias("w"))
    return with_edges(_routes(symmetric(w, "src", "dst", "w"), requests), graph)


def azimuth_path(edges: DataFrame, places: DataFrame, requests: DataFrame, naive: bool = False) -> DataFrame:
    """``req, seq, fid, at``: walkers that take the departure closest to the azimuth of their target.

    Naive walkers may not turn back on the edge just used and stop on a repeated
    edge.  Others jump to an adjacent target, avoid dead ends, places already seen
    and, after the first step, measure angles across the plane they came from.
    No walker uses an edge twice, so all end without a limit on steps.
    ``places``: ``place, pt, degree``.
    """
    dep = departures(edges).join(edges.select(F.col("fid").alias("edge"), "start_pl", "end_pl"), "edge")
    dep = dep.select(F.col("place").alias("at"), "edge", "az", F.when(F.col("side") == 0, F.col("end_pl")).otherwise(F.col("start_pl")).alias("to"))
    dep = materialise(dep.join(places.select(F.col("place").alias("to"), "degree"), "to"), "departures")
    pts = places.select("place", "pt")
    w = requests.join(pts.select(F.col("place").alias("source"), F.col("pt").alias("p0")), "source").join(pts.select(F.col("place").alias("target"), F.col("pt").alias("goal")), "target")
    w = w.select("req", F.col("source").alias("at"), "target", "goal", F.col("p0").alias("p"), F.array().cast("array<long>").alias("used"), F.array("source").alias("seen"), F.lit(None).cast("double").alias("came"))
    out, seq = None, 0
    while True:
        seq += 1
        w = materialise(w, "walkers")
        if not w.limit(1).count():
            break
        goal = G.azimuth(F.col("p"), F.col("goal"))
        c = w.join(dep, "at")
        hit = F.col("to") == F.col("target")
        if naive:
            ok = (F.size("used") == 0) | (F.try_element_at("used", F.lit(-1)) != F.col("edge"))
            rank = F.pi() - G.deviation(F.col("az"), goal)
        else:
            ok = hit | ((F.col("degree") > 1) & ~F.array_contains("seen", F.col("to")) & ~F.array_contains("used", F.col("edge")))
            straight = F.pi() - G.deviation(F.col("az"), goal)
            behind = F.coalesce(F.cos(F.col("az") - F.col("came")) < -0.999999, F.lit(False))
            rank = F.when(hit, -1.0).when(behind, 2 * F.pi()).otherwise(straight)
        best = c.filter(ok).groupBy("req").agg(F.min(F.struct(rank.alias("r"), "edge", "to", "az")).alias("b"))
        s = w.join(best, "req").join(pts.select(F.col("place").alias("_to"), F.col("pt").alias("np")), F.col("b.to") == F.col("_to"))
        s = materialise(s.withColumn("again", F.array_contains("used", F.col("b.edge"))), "steps")
        step = s.filter("not again").select("req", F.lit(seq).alias("seq"), F.col("b.edge").alias("fid"), F.col("b.to").alias("at"))
        out = step if out is None else out.unionByName(step)
        w = s.filter("not again and b.to <> target").select("req", F.col("b.to").alias("at"), "target", "goal", F.col("np").alias("p"), F.concat("used", F.array("b.edge")).alias("used"), F.concat("seen", F.array("b.to")).alias("seen"), F.col("b.az").alias("came"))
    return out


def mesh_path(graph: DataFrame, mesh: DataFrame, requests: DataFrame, weighted: bool = False) -> DataFrame:
    """``req, seq, fid, length``: paths with free passage inside the connected parts of a mesh (``fid``).

    Fringe places of a part, those with an edge outside it, are linked by shortcuts
    of weight 0.01 through one node per part (half at each end), so no pairs are
    listed; used shortcuts are expanded inside the part.  Places are numbered first, so
    whatever their ids are they differ from the nodes of parts.
    """
    names = ordered_ids(graph.select(F.explode(F.array("src", "dst")).alias("id")).union(requests.select(F.explode(F.array("source", "target")))))
    graph = materialise(numbered(graph.select("src", "dst", "length", "fid"), names, "src", "dst"), "mesh-graph")
    requests = materialise(numbered(requests.select("req", "source", "target"), names, "source", "target"), "mesh-requests")
    m = graph.join(mesh.select("fid"), "fid", "left_semi")
    part = materialise(connected_components(m, "src", "dst"), "mesh")
    outside = graph.join(mesh.select("fid"), "fid", "left_anti")
    fringe = part.join(outside.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
    ends = requests.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    fringe = fringe.union(part.join(ends, "id", "left_semi")).distinct()
    hub = fringe.select("id", (-F.col("component") - 1).alias("hub"))  # below 0, where no place is
    cost = F.col("length").cast("double") if weighted else F.lit(1.0)
    base = symmetric(outside.select("src", "dst", cost.alias("w")), "src", "dst", "w")
    half = F.lit(SHORTCUT / 2)
    short = hub.select(F.col("id").alias("src"), F.col("hub").alias("dst"), half.alias("w")).unionByName(hub.select(F.col("hub").alias("src"), F.col("id").alias("dst"), half.alias("w")))
    routes = materialise(_routes(base.unionByName(short), requests), "mesh-routes")
    steps = _steps(routes)
    into = steps.filter("b < 0").select("req", "seq", F.col("a").alias("source"))
    outof = steps.filter("a < 0").select("req", (F.col("seq") - 1).alias("seq"), F.col("b").alias("target"))
    legs = materialise(into.join(outof, ["req", "seq"]).filter("source <> target").withColumn("leg", F.struct("req", "seq")), "legs")
    inner = shortest_path(m, legs.select(F.col("leg").alias("req"), "source", "target")) if weighted else simplest_path(m, legs.select(F.col("leg").alias("req"), "source", "target"))
    inner = inner.select(F.col("req.req").alias("req"), F.col("req.seq").alias("s1"), F.col("seq").alias("s2"), "fid", "length")
    plain = with_edges(routes.select("req", "path"), outside).select("req", F.col("seq").alias("s1"), F.lit(0).alias("s2"), "fid", "length")
    w = Window.partitionBy("req").orderBy("s1", "s2")
    return inner.unionByName(plain).select("req", F.row_number().over(w).alias("seq"), "fid", "length")


def way_simplest_paths(edges: DataFrame, line_graph: DataFrame, requests: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """``req, seq, fid``: for every request the fewest changes of way, then shortest hop legs inside each way.

    ``requests`` (req, source, target) names the places, ``sources`` and ``targets`` (req, way)
    the ways to start and end on; of several target ways the nearest, then the least.
    The legs of all requests are settled together: a node of their graph is a
    place on a way, a leg is keyed by request and number.  Requests without a path are absent.
    """
    ways = ordered_ids(line_graph.select(F.explode(F.array("src", "dst")).alias("id")).union(sources.select("way")).union(targets.select("way")))
    starts = ordered_ids(sources.select(F.col("req").alias("id")))
    g = numbered(line_graph.select("src", "dst", "place"), ways, "src", "dst")
    hub = numbered(numbered(sources.select("req", "way"), ways, "way"), starts, "req").select((-F.col("req") - 1).alias("src"), F.col("way").alias("dst"), F.lit(1.0).alias("w"))
    hub = materialise(hub, "way-starts")
    steps = symmetric(g.select("src", "dst", F.lit(1.0).alias("w")), "src", "dst", "w").unionByName(hub)
    goal = numbered(numbered(targets.select("req", "way"), ways, "way"), starts, "req").select((-F.col("req") - 1).alias("root"), F.col("way").alias("node"))
    found = routes(steps, goal, nearest=True)
    if found is None:
        d = materialise(relax(steps, hub.select(F.col("src").alias("id")).distinct()), "way-search")
        best = d.join(goal.distinct(), ["root", "node"], "left_semi").groupBy("root").agg(F.min(F.struct("dist", "node")).alias("s")).select("root", F.col("s.node").alias("node"))
        found = follow(d, best)
    way = materialise(found.select((-F.col("root") - 1).alias("n"), F.slice("path", 2, 1 << 30).alias("path")), "way-routes")
    way = way.join(starts, "n").select(F.col("id").alias("req"), "path").join(requests, "req")
    on = way.select("req", F.size("path").alias("n"), "source", "target", F.posexplode("path").alias("leg", "way"), "path")
    on = on.withColumns({"x": F.when(F.col("leg") + 1 < F.col("n"), F.get("path", F.col("leg") + 1)), "y": F.when(F.col("leg") > 0, F.get("path", F.col("leg") - 1))})
    change = symmetric(g.select("src", "dst", "place"), "src", "dst", "place")
    ahead = change.select(F.col("src").alias("way"), F.col("dst").alias("x"), F.col("place").alias("out"))
    behind = change.select(F.col("src").alias("way"), F.col("dst").alias("y"), F.col("place").alias("in"))
    legs = on.join(ahead, ["way", "x"], "left").join(behind, ["way", "y"], "left")
    legs = legs.select("req", "leg", "way", F.coalesce("in", "source").alias("source"), F.coalesce("out", "target").alias("target")).filter("source <> target")
    legs = materialise(legs.join(ways, F.col("way") == F.col("n")).select("req", "leg", F.struct(F.col("id").alias("way"), F.col("source").alias("place")).alias("source"), F.struct(F.col("id").alias("way"), F.col("target").alias("place")).alias("target")), "way-legs")
    own = edges.select(F.struct("way", F.col("start_pl").alias("place")).alias("src"), F.struct("way", F.col("end_pl").alias("place")).alias("dst"), "length", "fid").join(legs.select(F.col("source.way").alias("w")).distinct(), F.col("src.way") == F.col("w"), "left_semi")
    spots = ordered_ids(own.select(F.explode(F.array("src", "dst")).alias("id")))
    inside = materialise(numbered(own, spots, "src", "dst"), "way-inside")
    asked = materialise(numbered(legs.select(F.struct("req", "leg").alias("req"), "source", "target"), spots, "source", "target"), "way-asked")
    found = simplest_path(inside, asked).select(F.col("req.req").alias("req"), F.col("req.leg").alias("leg"), F.col("seq").alias("s"), "fid")
    return found.select("req", F.row_number().over(Window.partitionBy("req").orderBy("leg", "s")).alias("seq"), "fid")


def way_simplest_path(edges: DataFrame, line_graph: DataFrame, sources: DataFrame, targets: DataFrame, start: int, end: int) -> DataFrame:
    """``seq, fid``: one request of ``way_simplest_paths``, from any source to any target way (``way``); an error if there is no path."""
    spark = edges.sparkSession
    request = spark.createDataFrame([(0, start, end)], "req long, source long, target long")
    one = F.lit(0).cast("long").alias("req")
    out = materialise(way_simplest_paths(edges, line_graph, request, sources.select(one, "way"), targets.select(one, "way")), "way-path")
    if out.isEmpty() and start != end:
        raise ValueError("no path")
    return out.select("seq", "fid")


def path_table(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of paths in order: ``req, seq`` and all edge columns."""
    return steps.select("req", "seq", "fid").join(edges, "fid")


def hop_distance(graph: DataFrame, source: int) -> DataFrame:
    """``node, dist`` in edges from one place."""
    return search(symmetric(graph), graph.sparkSession.range(source, source + 1)).select("node", "dist")
