"""Construction, conversion, attributes, set algebra, products and derived graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waygraph.plans.kernels import relax, search, symmetric
from waygraph.plans.stages import materialise


def canonical(edges: DataFrame, *more: str) -> DataFrame:
    """Undirected edges with the smaller end first."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *more)


def nodes(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``id`` of all ends and of ``vertices``."""
    out = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return (out if vertices is None else out.union(vertices.select("id"))).distinct()


def from_edges(rows: DataFrame, source: str = "source", target: str = "target", order: str | None = None, multi: bool = False, directed: bool = False) -> DataFrame:
    """Edge table to graph: simple graphs keep the last row of a pair (by ``order``), multigraphs number them in ``key``."""
    more = [c for c in rows.columns if c not in (source, target)]
    e = rows.select(F.col(source).alias("src"), F.col(target).alias("dst"), *more)
    e = e if directed else canonical(e, *more)
    by = [F.col(order)] if order else [F.col(c) for c in more] or [F.lit(0)]
    if multi:
        return e.withColumn("key", F.row_number().over(Window.partitionBy("src", "dst").orderBy(*by)) - 1)
    if not more:
        return e.distinct()
    return e.groupBy("src", "dst").agg(F.max_by(F.struct(*more), F.struct(*by)).alias("s")).select("src", "dst", *[F.col("s")[c].alias(c) for c in more])


def to_edge_table(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Graph to edge table."""
    return edges.withColumnRenamed("src", source).withColumnRenamed("dst", target)


def to_adjacency(edges: DataFrame, directed: bool = False) -> DataFrame:
    """``id, neighbours`` (sorted)."""
    e = edges.select("src", "dst") if directed else symmetric(edges)
    return e.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def from_adjacency(rows: DataFrame, directed: bool = False) -> DataFrame:
    """Edges of ``id, neighbours``."""
    e = rows.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst"))
    return e.distinct() if directed else canonical(e).distinct()


def degrees(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``id, degree``; a loop counts twice; with ``weight`` the sum of weights."""
    value = F.col(weight) if weight else F.lit(1)
    return edges.select(F.explode(F.array("src", "dst")).alias("id"), value.alias("v")).groupBy("id").agg(F.sum("v").alias("degree"))


def summary(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = False) -> DataFrame:
    """``nodes, edges, density, selfloops``."""
    n = nodes(edges, vertices).agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("selfloops"))
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return n.crossJoin(m).select("nodes", "edges", F.when(pairs > 0, F.col("edges") * (1 if directed else 2) / pairs).otherwise(F.lit(0.0)).alias("density"), "selfloops")  # one row each


def degree_histogram(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Dense ``degree, n`` from 0 to the largest degree."""
    d = nodes(edges, vertices).join(degrees(edges), "id", "left").groupBy(F.coalesce("degree", F.lit(0)).alias("degree")).agg(F.count(F.lit(1)).alias("n"))
    all_ = d.agg(F.max("degree").alias("top")).select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("degree"))
    return all_.join(d, "degree", "left").select("degree", F.coalesce("n", F.lit(0)).alias("n"))


def set_attributes(rows: DataFrame, values: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows with attribute ``name`` taken from ``values`` where given."""
    v = values.select(*key, F.col(name).alias("_new"))
    old = F.col(name) if name in rows.columns else F.lit(None)
    return rows.join(v, key, "left").withColumn(name, F.coalesce("_new", old)).drop("_new")


def weight_checks(edges: DataFrame, weight: str = "w") -> DataFrame:
    """``weighted, negative``: whether all edges have a weight, and any a negative one."""
    return edges.agg(F.bool_and(F.col(weight).isNotNull()).alias("weighted"), F.bool_or(F.coalesce(F.col(weight) < 0, F.lit(False))).alias("negative"))


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def edge_subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges that are in ``keep`` (src, dst)."""
    return edges.join(keep, ["src", "dst"], "left_semi").select(*edges.columns)


def restricted(edges: DataFrame, hide_nodes: DataFrame, hide_edges: DataFrame) -> DataFrame:
    """Edges without hidden nodes and hidden edges."""
    e = edges.join(hide_edges, ["src", "dst"], "left_anti")
    for end in ("src", "dst"):
        e = e.join(hide_nodes.select(F.col("id").alias(end)), end, "left_anti")
    return e.select(*edges.columns)


def filtered(edges: DataFrame, node_filter: Column | None = None, edge_filter: Column | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """A view by predicates: ``edge_filter`` on edge columns, ``node_filter`` on ``attributes`` of both ends."""
    e = edges if edge_filter is None else edges.filter(edge_filter)
    return e if node_filter is None else subgraph(e, attributes.filter(node_filter))


def to_undirected(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One edge per pair; of both directions the attributes of the later by ``order``."""
    return from_edges(edges, "src", "dst", order)


def reverse(edges: DataFrame) -> DataFrame:
    """Edges turned round."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``u, v, w`` for given pairs (u, v): each neighbour w of both."""
    s = symmetric(edges).distinct().filter("src <> dst")
    a = s.select(F.col("src").alias("u"), F.col("dst").alias("w"))
    b = s.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    return pairs.join(a, "u").join(b, ["v", "w"]).filter("w <> u and w <> v").select("u", "v", "w")


def non_neighbours(edges: DataFrame, ids: DataFrame, u) -> DataFrame:
    """Nodes not adjacent to ``u``."""
    near = symmetric(edges).filter(F.col("src") == F.lit(u)).select(F.col("dst").alias("id"))
    return ids.join(near, "id", "left_anti").filter(F.col("id") != F.lit(u))


def non_edges(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Those of the candidate pairs (src, dst) that are no edges."""
    return canonical(candidates).distinct().join(canonical(edges), ["src", "dst"], "left_anti")


def chain(rows: DataFrame, kind: str = "path") -> DataFrame:
    """Edges along ordered rows (``seq, id``): a path, a cycle, or a star around the first.

    Rows are range-partitioned; each takes the next in its partition, and a
    partition's last row the first of the next partition that has any.
    """
    hub = rows.agg(F.min_by("id", "seq").alias("first"), F.min("seq").alias("s0"))
    if kind == "star":
        return rows.join(F.broadcast(hub), F.col("seq") > F.col("s0")).select(F.col("first").alias("src"), F.col("id").alias("dst"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = materialise(rows.select("seq", "id").repartitionByRange(n, "seq").withColumn("p", F.spark_partition_id()), "chain")
    after = d.groupBy("p").agg(F.min_by("id", "seq").alias("head"))
    after = after.select("p", F.lead("head").over(Window.orderBy("p")).alias("after"))  # one row per partition
    out = d.withColumn("dst", F.lead("id").over(Window.partitionBy("p").orderBy("seq"))).join(F.broadcast(after), "p")
    out = out.select(F.col("id").alias("src"), F.coalesce("dst", "after").alias("dst"))
    if kind == "cycle":
        return out.crossJoin(F.broadcast(hub)).select("src", F.coalesce("dst", "first").alias("dst"))
    return out.filter("dst is not null")


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename ends by ``mapping`` (old, new); others keep their names."""
    e = edges
    for end in ("src", "dst"):
        m = mapping.select(F.col("old").alias(end), F.col("new").alias("_n"))
        e = e.join(m, end, "left").withColumn(end, F.coalesce("_n", end)).drop("_n")
    return e.select(*edges.columns)


def integer_labels(edges: DataFrame, first: int = 0, ordering: str = "sorted") -> DataFrame:
    """``old, new``: consecutive integers in order of id, or of degree (``increasing`` or ``decreasing``).

    Positions within range partitions are shifted by the counts before them.
    """
    spark = edges.sparkSession
    d = degrees(edges)
    order = {"sorted": [F.col("id")], "increasing": [F.col("degree"), F.col("id")], "decreasing": [F.desc("degree"), F.col("id")]}[ordering]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(n, *order).withColumn("p", F.spark_partition_id())
    counts = d.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    base = counts.select("p", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # one row per partition
    pos = F.row_number().over(Window.partitionBy("p").orderBy(*order))
    return d.withColumn("r", pos).join(F.broadcast(base), "p").select(F.col("id").alias("old"), (F.col("b") + F.col("r") - 1 + first).cast("long").alias("new"))


def complement(edges: DataFrame, ids: DataFrame, limit: int = 20_000) -> DataFrame:
    """Pairs of nodes that are no edges; refused above ``limit`` nodes, since the result is quadratic."""
    if ids.limit(limit + 1).count() > limit:
        raise ValueError(f"complement of more than {limit} nodes")
    pairs = ids.select(F.col("id").alias("src")).join(ids.select(F.col("id").alias("dst")), F.col("src") < F.col("dst"))
    return pairs.join(canonical(edges), ["src", "dst"], "left_anti")


def union(*graphs: DataFrame) -> DataFrame:
    """Union of graphs with disjoint nodes; an error if two share a node."""
    tagged = reduce(DataFrame.unionByName, [nodes(g).withColumn("g", F.lit(i)) for i, g in enumerate(graphs)])
    if tagged.groupBy("id").agg(F.countDistinct("g").alias("n")).filter("n > 1").limit(1).count():
        raise ValueError("graphs share nodes")
    return reduce(DataFrame.unionByName, graphs)


def disjoint_union(*graphs: DataFrame) -> DataFrame:
    """Union of graphs whose nodes become strings ``<graph>:<id>``."""
    return reduce(DataFrame.unionByName, [g.withColumn("src", F.concat(F.lit(f"{i}:"), F.col("src"))).withColumn("dst", F.concat(F.lit(f"{i}:"), F.col("dst"))) for i, g in enumerate(graphs)])


def intersection(*graphs: DataFrame) -> DataFrame:
    """Edges in all graphs, without attributes."""
    return reduce(DataFrame.intersect, [canonical(g) for g in graphs])


def difference(g: DataFrame, h: DataFrame) -> DataFrame:
    """Edges of g that are not in h, without attributes."""
    return canonical(g).distinct().join(canonical(h), ["src", "dst"], "left_anti")


def symmetric_difference(g: DataFrame, h: DataFrame) -> DataFrame:
    """Edges in exactly one of two graphs."""
    return difference(g, h).unionByName(difference(h, g))


def compose(*graphs: DataFrame) -> DataFrame:
    """All edges of all graphs; of an edge in several the attributes of the last."""
    more = [c for c in graphs[0].columns if c not in ("src", "dst")]
    tagged = reduce(DataFrame.unionByName, [canonical(g, *more).withColumn("_g", F.lit(i)) for i, g in enumerate(graphs)])
    s = tagged.groupBy("src", "dst").agg(F.max_by(F.struct(*more) if more else F.lit(0), "_g").alias("s"))
    return s.select("src", "dst", *[F.col("s")[c].alias(c) for c in more])


def product(g: DataFrame, h: DataFrame, kind: str = "cartesian", root=None) -> DataFrame:
    """Edges of a product of two undirected graphs; nodes are ``struct<g,h>``.

    Kinds: ``tensor``, ``cartesian``, ``lexicographic``, ``strong``, ``rooted``.
    The result has the size of the product, which is what is asked for.
    """
    def node(a, b):
        return F.struct(F.col(a).alias("g"), F.col(b).alias("h"))

    ga, gn = symmetric(g).distinct().select(F.col("src").alias("g1"), F.col("dst").alias("g2")), nodes(g).select(F.col("id").alias("g1"))
    ha, hn = symmetric(h).distinct().select(F.col("src").alias("h1"), F.col("dst").alias("h2")), nodes(h).select(F.col("id").alias("h1"))
    both = ga.crossJoin(ha).select(node("g1", "h1").alias("src"), node("g2", "h2").alias("dst"))
    along_h = gn.crossJoin(ha).select(node("g1", "h1").alias("src"), node("g1", "h2").alias("dst"))
    along_g = ga.crossJoin(hn).select(node("g1", "h1").alias("src"), node("g2", "h1").alias("dst"))
    if kind == "lexicographic":
        out = ga.crossJoin(hn).crossJoin(hn.withColumnRenamed("h1", "h2")).select(node("g1", "h1").alias("src"), node("g2", "h2").alias("dst")).unionByName(along_h)
    elif kind == "rooted":
        out = along_h.unionByName(along_g.filter(F.col("src.h") == F.lit(root)))
    else:
        out = {"tensor": both, "cartesian": along_h.unionByName(along_g), "strong": both.unionByName(along_h).unionByName(along_g)}[kind]
    return out.filter("src < dst").distinct()


def power(edges: DataFrame, k: int) -> DataFrame:
    """Edges between distinct nodes within ``k`` hops."""
    return search(symmetric(edges), None, k).filter("root < node").select(F.col("root").alias("src"), F.col("node").alias("dst"))


def quotient(edges: DataFrame, blocks: DataFrame, weight: str | None = None, multi: bool = False) -> DataFrame:
    """Block graph of ``blocks`` (id, block): ``src, dst, weight`` over crossing edges, or each of them if ``multi``."""
    b = blocks.select(F.col("id").alias("src"), F.col("block").alias("b1"))
    c = blocks.select(F.col("id").alias("dst"), F.col("block").alias("b2"))
    e = edges.join(b, "src").join(c, "dst").filter("b1 <> b2").select(F.least("b1", "b2").alias("src"), F.greatest("b1", "b2").alias("dst"), (F.col(weight) if weight else F.lit(1)).alias("weight"))
    return e if multi else e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def block_facts(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """``block, nnodes, nedges, density`` of every block."""
    n = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("nnodes"))
    inside = edges.join(blocks.select(F.col("id").alias("src"), "block"), "src").join(blocks.select(F.col("id").alias("dst"), F.col("block").alias("b2")), "dst").filter("block = b2")
    m = inside.groupBy("block").agg(F.count(F.lit(1)).alias("nedges"))
    out = n.join(m, "block", "left").fillna(0, ["nedges"])
    return out.withColumn("density", F.when(F.col("nnodes") > 1, 2 * F.col("nedges") / (F.col("nnodes") * (F.col("nnodes") - 1))).otherwise(F.lit(0.0)))


def contracted(edges: DataFrame, u, v, self_loops: bool = True) -> DataFrame:
    """Edges after v is merged into u."""
    out = edges.withColumn("src", F.when(F.col("src") == v, u).otherwise(F.col("src"))).withColumn("dst", F.when(F.col("dst") == v, u).otherwise(F.col("dst")))
    return out if self_loops else out.filter("src <> dst")


def line_graph(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Pairs of edges, as structs, that share an end; of a digraph (u,v) to (v,w), loops allowed."""
    e = edges.select("src", "dst").withColumn("e", F.struct("src", "dst"))
    if directed:
        return e.select(F.col("e").alias("a"), F.col("dst").alias("k")).join(e.select(F.col("e").alias("b"), F.col("src").alias("k")), "k").select("a", "b")
    ends = e.select("e", F.explode(F.array_distinct(F.array("src", "dst"))).alias("k"))
    return ends.select(F.col("e").alias("a"), "k").join(ends.select(F.col("e").alias("b"), "k"), "k").filter("a < b").select("a", "b").distinct()


def ego(edges: DataFrame, n, radius: float = 1, center: bool = True, distance: str | None = None) -> DataFrame:
    """The sub-graph within a radius of a node, in hops or by weight."""
    root = edges.sparkSession.range(1).select(F.lit(n).cast("long").alias("id"))
    if distance is None:
        near = search(symmetric(edges), root, int(radius))
    else:
        near = relax(symmetric(edges.withColumnRenamed(distance, "w"), "src", "dst", "w"), root, radius)
    ids = near.select(F.col("node").alias("id"))
    return subgraph(edges, ids if center else ids.filter(F.col("id") != n))


def stochastic(edges: DataFrame, weight: str = "w") -> DataFrame:
    """Digraph with weights divided by the sum of weights out of their source."""
    return edges.withColumn(weight, F.col(weight) / F.sum(weight).over(Window.partitionBy("src")))


def edge_boundary(edges: DataFrame, inside: DataFrame, outside: DataFrame | None = None) -> DataFrame:
    """Edges from ``inside`` to ``outside`` (default: all other nodes), as src, dst."""
    s = symmetric(edges).distinct().join(inside.select(F.col("id").alias("src")), "src", "left_semi")
    if outside is None:
        return s.join(inside.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
    return s.join(outside.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def node_boundary(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Nodes outside a set that are adjacent to it."""
    return edge_boundary(edges, inside).select(F.col("dst").alias("id")).distinct()


def isolates(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices of degree 0."""
    return vertices.select("id").join(nodes(edges), "id", "left_anti")


def selfloops(edges: DataFrame) -> DataFrame:
    """Edges from a node to itself."""
    return edges.filter("src = dst")


def prefix_tree(paths: DataFrame) -> DataFrame:
    """Trie of ``path`` arrays of strings: ``src, dst`` prefixes, root the empty array; every end has an edge to ``NIL``."""
    p = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("dst")).distinct()
    steps = p.select(F.slice("dst", F.lit(1), F.size("dst") - 1).alias("src"), "dst")
    return steps.unionByName(paths.select(F.col("path").alias("src"), F.array(F.lit("NIL")).alias("dst")).distinct())


def edges_from_lines(lines: DataFrame, simplify: bool = True) -> DataFrame:
    """Directed edges of lines: first point to last, or one per straight piece; other columns are kept."""
    from waygraph.functions import geom as G

    more = [c for c in lines.columns if c != "geom"]
    if simplify:
        return lines.select(G.start_point("geom").alias("src"), G.end_point("geom").alias("dst"), *more, "geom")
    return lines.select(F.explode(G.pieces("geom")).alias("s"), *more).select(F.col("s.a").alias("src"), F.col("s.b").alias("dst"), *more)


def from_wide(rows: DataFrame, key: str = "id") -> DataFrame:
    """A wide adjacency table (one column per target) to ``src, dst, w`` of non-zero cells."""
    cols = [c for c in rows.columns if c != key]
    long = rows.select(F.col(key).alias("src"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("double") for c in cols]))).alias("dst", "w"))
    return long.filter("w <> 0")


def to_wide(edges: DataFrame, limit: int = 1000) -> DataFrame:
    """``src`` and one column of summed weights per target; refused above ``limit`` targets."""
    if edges.select("dst").distinct().limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} columns")
    return edges.groupBy("src").pivot("dst").agg(F.sum("w")).na.fill(0)


def bipartite_edges(rows: DataFrame, top: str, bottom: str) -> DataFrame:
    """``src, dst`` with the top node first."""
    return rows.select(F.col(top).alias("src"), F.col(bottom).alias("dst")).distinct()


def path_graph(spark: SparkSession, edges: list[tuple]) -> DataFrame:
    """A small graph typed in, for tests and examples."""
    return spark.createDataFrame(edges, "src long, dst long" + (", w double" if edges and len(edges[0]) == 3 else ""))
