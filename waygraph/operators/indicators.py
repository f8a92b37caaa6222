"""Indicators of ways and edges: angles, orthogonality, spacing, centralities, radii, classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.functions import geom as G
from waygraph.operators.ways import departures, lengths_by_class, line_graph, way_places
from waygraph.plans.kernels import BROADCAST_EDGES, WORDS, level_sums, per_source, reach_sums, root_batches, search, summed_at, symmetric, waves, weighted_sums
from waygraph.plans.stages import materialise


def way_angles(edges: DataFrame, function=F.sin, name: str = "sin") -> DataFrame:
    """``place, edge_a, way_a, edge_b, way_b, sin``: a function, by default the sine, of the deviation of edge pairs on different ways.

    These rows are the upper half of every place's matrix over its departures.
    """
    d = departures(edges).join(edges.select(F.col("fid").alias("edge"), "way"), "edge")
    x = d.select("place", *[F.col(c).alias(f"{c}_a") for c in ("edge", "side", "way", "az")])
    y = d.select("place", *[F.col(c).alias(f"{c}_b") for c in ("edge", "side", "way", "az")])
    p = x.join(y, "place").filter((F.struct("edge_a", "side_a") < F.struct("edge_b", "side_b")) & (F.col("way_a") != F.col("way_b")))
    return p.select("place", "edge_a", "way_a", "edge_b", "way_b", function(G.deviation(F.col("az_a"), F.col("az_b"))).alias(name))


def _both(angles: DataFrame) -> DataFrame:
    a = angles.select("place", F.col("edge_a").alias("edge"), F.col("way_a").alias("way"), F.col("edge_b").alias("other"), "sin")
    return a.unionByName(angles.select("place", F.col("edge_b").alias("edge"), F.col("way_b").alias("way"), F.col("edge_a").alias("other"), "sin"))


def way_orthogonality(angles: DataFrame, conn: DataFrame) -> DataFrame:
    """``way, orthog``: sum over (place, other edge) of the least sine, over the way's ``conn``."""
    low = _both(angles).groupBy("way", "place", "other").agg(F.min("sin").alias("s")).groupBy("way").agg(F.sum("s").alias("s"))
    return low.join(conn, "way").select("way", F.try_divide("s", "conn").alias("orthog"))


def edge_orthogonality(angles: DataFrame, edges: DataFrame) -> DataFrame:
    """``fid, orthog``: sum of the least sines of other edges over the edge's degree."""
    low = _both(angles).groupBy("edge", "place", "other").agg(F.min("sin").alias("s")).groupBy(F.col("edge").alias("fid")).agg(F.sum("s").alias("s"))
    return low.join(edges.select("fid", "degree"), "fid").select("fid", F.try_divide("s", "degree").alias("orthog"))


def edge_spacing(edges: DataFrame) -> DataFrame:
    """``fid, spacing``: length over degree, null for degree 0."""
    return edges.select("fid", F.when(F.col("degree") > 0, F.col("length") / F.col("degree")).alias("spacing"))


def edge_line_graph(edges: DataFrame) -> DataFrame:
    """``src, dst``: pairs of edges that share an end place, once each."""
    inc = edges.select("fid", F.explode(F.array_distinct(F.array("start_pl", "end_pl"))).alias("place"))
    other = inc.select(F.col("fid").alias("dst"), "place")
    return inc.withColumnRenamed("fid", "src").join(other, "place").filter("src < dst").select("src", "dst").distinct()


def _sources(graph: DataFrame, k: int | None) -> tuple[DataFrame, DataFrame]:
    nodes = graph.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes, nodes if k is None else nodes.orderBy(F.xxhash64("id"), "id").limit(k)


def brandes(graph: DataFrame, kind: str = "betweenness", k: int | None = None, directed: bool = False, endpoints: bool = False, sources: DataFrame | None = None, targets: set | None = None, weight: str | None = None) -> DataFrame:
    """``id, value``: raw sums over sources of dependencies along shortest hop paths, or shortest paths by a positive weight.

    ``kind``: ``betweenness`` (delta), ``stress`` (sigma * delta) or ``load`` (unit
    load split evenly over predecessors).  Each task sums over its sources before
    rows leave it.  ``k`` takes the sources with the smallest hashes.
    """
    nodes, chosen = _sources(graph, k)
    chosen = sources if sources is not None else chosen
    if weight is not None:
        sums = weighted_sums(_weighted(graph, weight, directed), chosen, kind, endpoints, targets)
        return nodes.join(sums, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))
    e = graph if directed else symmetric(graph)

    def run(ids, starts, nbr, at):
        total, n = np.zeros(len(ids)), len(ids)
        one = np.ones(n) if targets is None else np.isin(ids, np.array(sorted(targets), ids.dtype)).astype(float)
        for roots in root_batches(n, at):
            levels = waves(starts, nbr, roots, kind == "stress")
            delta, gains = np.full(len(levels[-1][0]), 1.0 if kind == "load" else 0.0), []
            for k in range(len(levels) - 1, 0, -1):
                cells, sigma, _, by, to, ratio = levels[k]
                node = cells % n
                gain = sigma * delta if kind == "stress" else delta - 1 if kind == "load" else delta
                gains.append((node, gain + 1.0 if endpoints else gain))
                if endpoints:
                    gains.append((roots[cells // n], np.ones(len(cells))))
                if kind == "betweenness":
                    part = ratio * (one[node] + delta)[to]
                elif kind == "stress":
                    part = (1 + delta)[to]
                else:
                    part = (delta / np.bincount(to, minlength=len(cells)))[to]
                delta = np.bincount(by, part, len(levels[k - 1][0])) + (1.0 if kind == "load" else 0.0)
            total += summed_at(gains, n)
        return pd.DataFrame({"id": ids, "value": total})

    def beyond():
        return level_sums(e, chosen, kind, endpoints, targets)

    sums = per_source(e, chosen, "id long, value double", run, beyond).groupBy("id").agg(F.sum("value").alias("value"))
    return nodes.join(sums, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def _weighted(graph: DataFrame, weight: str, directed: bool) -> DataFrame:
    e = graph.select("src", "dst", F.col(weight).alias("w"))
    return e if directed else symmetric(e, "src", "dst", "w")


def edge_brandes(graph: DataFrame, k: int | None = None, directed: bool = False, sources: DataFrame | None = None, targets: set | None = None, weight: str | None = None) -> DataFrame:
    """``src, dst, value``: raw betweenness of edges, by hops or by a positive weight."""
    chosen = sources if sources is not None else _sources(graph, k)[1]
    if weight is not None:
        all_ = graph.select("src", "dst", F.lit(0.0).alias("value"))
        out = weighted_sums(_weighted(graph, weight, directed), chosen, targets=targets, per_edge=True).unionByName(all_)
        if not directed:
            out = out.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "value")
        return out.groupBy("src", "dst").agg(F.sum("value").alias("value"))
    e = graph if directed else symmetric(graph)

    def run(ids, starts, nbr, at):
        total, n = np.zeros(len(nbr)), len(ids)
        one = np.ones(n) if targets is None else np.isin(ids, np.array(sorted(targets), ids.dtype)).astype(float)
        for roots in root_batches(n, at):
            levels = waves(starts, nbr, roots)
            delta, gains = np.zeros(len(levels[-1][0])), []
            for k in range(len(levels) - 1, 0, -1):
                cells, _, edge, by, to, ratio = levels[k]
                part = ratio * (one[cells % n] + delta)[to]
                gains.append((edge, part))
                delta = np.bincount(by, part, len(levels[k - 1][0]))
            total += summed_at(gains, len(nbr))
        return pd.DataFrame({"src": np.repeat(ids, np.diff(starts)), "dst": ids[nbr], "value": total})

    out = per_source(e, chosen, "src long, dst long, value double", run, lambda: level_sums(e, chosen, targets=targets, per_edge=True))
    if not directed:
        out = out.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "value")
    return out.groupBy("src", "dst").agg(F.sum("value").alias("value"))


def betweenness(graph: DataFrame) -> DataFrame:
    """``id, betwee``: unnormalised betweenness of an undirected graph, each pair once."""
    return brandes(graph).select("id", (F.col("value") / 2).alias("betwee"))


def stress(graph: DataFrame, k: int | None = None, normalized: bool = False, endpoints: bool = False, weight: str | None = None) -> DataFrame:
    """``id, use``: shortest paths, by hops or a weight, through each node, each pair once; rescaled when ``k`` sources are drawn."""
    out = _counted(brandes(graph, "stress", k, endpoints=endpoints, weight=weight))
    n = F.col("_n")
    scale = F.lit(1.0) / ((n - 1) * (n - 2)) if normalized else F.lit(0.5)
    if k is not None:
        scale = scale * n / k
    return out.select("id", (F.col("value") * scale).alias("use"))


def _counted(df: DataFrame) -> DataFrame:
    """``df``, written once, with the number of its rows in ``_n``."""
    df = materialise(df, "counted")
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))  # one row


def distance_sums(graph: DataFrame, lengths: DataFrame | None = None, directed: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """``id, reach, total, far, inverse[, weighted]``: nodes reached, summed hops, largest hops, summed 1 / hops, and hops times length.

    From all nodes, or those of ``sources`` (``id``) that have an edge.

    Tasks return one row per source; pairs are listed, and summed where they are
    made, only where the lengths or the graph are too large to broadcast.
    """
    e = graph.select("src", "dst") if directed else symmetric(graph)
    chosen = _sources(graph, None)[0]
    if sources is not None:
        chosen = chosen.join(sources.select("id"), "id", "left_semi")

    def listed():
        pairs = search(e, chosen)
        sums = [F.count(F.lit(1)).alias("reach"), F.sum("dist").alias("total"), F.max("dist").alias("far"), F.coalesce(F.sum(F.when(F.col("dist") > 0, 1.0 / F.col("dist"))), F.lit(0.0)).alias("inverse")]
        if lengths is not None:
            pairs = pairs.join(lengths.select(F.col("id").alias("node"), "length"), "node")
            sums.append(F.sum(F.col("dist") * F.col("length")).alias("weighted"))
        return pairs.groupBy(F.col("root").alias("id")).agg(*sums)

    own = None
    if lengths is not None:
        few = lengths.select("id", "length").dropDuplicates(["id"])
        if few.count() > BROADCAST_EDGES:
            return listed()
        table = few.toPandas().sort_values("id")  # at most BROADCAST_EDGES rows
        own = graph.sparkSession.sparkContext.broadcast((table["id"].to_numpy(np.int64), table["length"].to_numpy(np.float64)))

    def run(ids, starts, nbr, at):
        rows, length = [], None
        if own is not None:
            known, values = own.value
            i = np.minimum(np.searchsorted(known, ids), max(0, len(known) - 1))
            there = known[i] == ids if len(known) else np.zeros(len(ids), bool)
            length = np.where(there, values[i] if len(known) else 0.0, 0.0)
        for k in range(0, len(at), 64 * WORDS):
            roots = at[k : k + 64 * WORDS]
            sums = reach_sums(starts, nbr, roots, length)
            rows.append(pd.DataFrame({"id": ids[roots], **dict(zip(["reach", "total", "far", "inverse", "weighted"], sums, strict=True))}))
        out = pd.concat(rows) if rows else pd.DataFrame(columns=["id", "reach", "total", "far", "inverse", "weighted"])
        return out if length is not None else out.drop(columns="weighted")

    schema = "id long, reach long, total long, far int, inverse double" + (", weighted double" if lengths is not None else "")
    return per_source(e, chosen, schema, run, listed)


def closeness(graph: DataFrame) -> DataFrame:
    """``id, closen``: (r-1)/sum * (r-1)/(n-1), r the nodes reached including itself."""
    n = F.col("_n")
    c = F.when(F.col("total") > 0, (F.col("reach") - 1) / F.col("total") * (F.col("reach") - 1) / (n - 1)).otherwise(F.lit(0.0))
    return _counted(distance_sums(graph)).select("id", c.alias("closen"))


def topological_radius(graph: DataFrame, lengths: DataFrame) -> DataFrame:
    """``id, rtopo, acces``: summed hops to all reachable ways, and hops times way length."""
    return distance_sums(graph, lengths).select("id", F.col("total").alias("rtopo"), F.col("weighted").alias("acces"))


def on_edges(edges: DataFrame, values: DataFrame, *names: str) -> DataFrame:
    """Edges with columns of their way (``id``)."""
    return edges.join(values.select(F.col("id").alias("way"), *names), "way", "left")


def with_indicators(rows: DataFrame, values: list[DataFrame], key: str, classes: list[str] = (), n: int = 10) -> DataFrame:
    """Join indicator tables (keyed by ``key`` or ``id``) and add ``<name>_cl`` classes of equal total length."""
    for v in values:
        v = v.withColumnRenamed("id", key) if "id" in v.columns else v
        rows = rows.join(v, key, "left")
    for c in classes:
        rows = rows.join(lengths_by_class(rows, c, n, key).withColumnRenamed("class", f"{c}_cl"), key)
    return rows


def computed_properties(ways: DataFrame, names: list[str]) -> DataFrame:
    """``name, computed``: whether a column has a value in any row."""
    counts = ways.agg(*[F.count(c).alias(c) for c in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), (F.col(c) > 0).alias("computed")) for c in names])).alias("s")).select("s.*")


#: Attributes of ways that ``way_attributes`` computes, beside those that ways have.
ATTRIBUTES = ("orthog", "rtopo", "acces", "closen", "betwee", "use")


def way_attributes(ways: DataFrame, edges: DataFrame, names: list[str], classes: list[str] = (), n: int = 10) -> DataFrame:
    """``ways`` (``way_id, length, conn, ..``) with the asked attributes and, for those in ``classes``, a column ``<name>_cl``.

    Shared parts are made once: angles for orthogonality, the line graph for all that follow
    it, one search from every way for topological radius, accessibility and closeness.
    Classes have equal total length, nulls first.  ``edges`` are place edges with their ``way``.
    """
    wrong = [x for x in [*names, *classes] if x not in ATTRIBUTES and x not in ways.columns]
    if wrong:
        raise ValueError(f"no such attributes: {wrong}")
    own = materialise(ways, "attribute-ways")
    values = []
    if "orthog" in names:
        values.append(way_orthogonality(way_angles(edges), own.select(F.col("way_id").alias("way"), "conn")).withColumnRenamed("way", "id"))
    if set(names) & set(ATTRIBUTES[1:]):
        graph = materialise(line_graph(way_places(edges)), "attribute-graph")
    if set(names) & {"rtopo", "acces", "closen"}:
        sums = distance_sums(graph, own.select(F.col("way_id").alias("id"), "length") if "acces" in names else None)
        total = F.col("_n")
        closen = F.when(F.col("total") > 0, (F.col("reach") - 1) / F.col("total") * (F.col("reach") - 1) / (total - 1)).otherwise(F.lit(0.0))
        kinds = {"rtopo": F.col("total"), "closen": closen, "acces": F.col("weighted") if "acces" in names else None}
        values.append(_counted(sums).select("id", *[kinds[x].alias(x) for x in ("rtopo", "acces", "closen") if x in names]))
    if "betwee" in names:
        values.append(betweenness(graph))
    if "use" in names:
        values.append(stress(graph))
    return with_indicators(own, values, "way_id", list(classes), n)
