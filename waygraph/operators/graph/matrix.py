"""Sparse matrices of graphs as long tables (i, j, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.operators.graph.structure import degrees, nodes
from waygraph.plans.kernels import symmetric


def adjacency(edges: DataFrame, weight: str | None = None, directed: bool = False) -> DataFrame:
    """``i, j, w``: summed weights; an undirected loop counts once."""
    e = edges.select("src", "dst", (F.col(weight) if weight else F.lit(1)).alias("w"))
    if not directed:
        e = symmetric(e.filter("src <> dst"), "src", "dst", "w").unionByName(e.filter("src = dst"))
    return e.groupBy(F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.sum("w").alias("w"))


def incidence(edges: DataFrame, key: str, oriented: bool = False, weight: str | None = None) -> DataFrame:
    """``i, j, w``: node by edge; oriented: -1 at the source and 1 at the target; loops are empty."""
    w = F.col(weight) if weight else F.lit(1)
    e = edges.filter("src <> dst")
    ends = F.array(F.struct(F.col("src").alias("i"), (-w if oriented else w).alias("w")), F.struct(F.col("dst").alias("i"), w.alias("w")))
    return e.select(F.col(key).alias("j"), F.explode(ends).alias("s")).select("s.i", "j", "s.w")


def laplacian(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``i, j, w``: D - A of an undirected graph without loops."""
    a = adjacency(edges.filter("src <> dst"), weight)
    d = a.groupBy("i").agg(F.sum("w").alias("w")).select("i", F.col("i").alias("j"), "w")
    return d.unionByName(a.select("i", "j", (-F.col("w")).alias("w")))


def normalized_laplacian(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``i, j, w``: I - D^-1/2 A D^-1/2."""
    a = adjacency(edges.filter("src <> dst"), weight)
    d = a.groupBy(F.col("i").alias("k")).agg(F.sum("w").alias("d"))
    off = a.join(d.select(F.col("k").alias("i"), F.col("d").alias("di")), "i").join(d.select(F.col("k").alias("j"), F.col("d").alias("dj")), "j")
    return off.select("i", "j", (-F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("w")).unionByName(d.select(F.col("k").alias("i"), F.col("k").alias("j"), F.lit(1.0).alias("w")))


def directed_laplacian(edges: DataFrame, alpha: float = 0.95, limit: int = 5000) -> DataFrame:
    """``i, j, w``: I - (P^1/2 W P^-1/2 + transpose) / 2 of a teleporting walk W with stationary P; dense, refused above ``limit`` nodes."""
    from waygraph.operators.graph.centrality import pagerank

    ids = nodes(edges)
    n = ids.count()
    if n > limit:
        raise ValueError(f"more than {limit} nodes")
    p = pagerank(edges, alpha, tol=1e-10, rounds=1000).withColumnRenamed("value", "p")
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    step = edges.join(out, "src").select(F.col("src").alias("i"), F.col("dst").alias("j"), (1 / F.col("k")).alias("w"))
    cells = ids.select(F.col("id").alias("i")).crossJoin(ids.select(F.col("id").alias("j")))  # at most limit squared
    sink = out.select(F.col("src").alias("i"), F.lit(1).alias("o"))
    w = cells.join(step, ["i", "j"], "left").join(sink, "i", "left").withColumn("w", F.when(F.col("o").isNull(), F.lit(1.0 / n)).otherwise(alpha * F.coalesce("w", F.lit(0.0)) + (1 - alpha) / n))
    q = w.join(p.select(F.col("id").alias("i"), F.col("p").alias("pi")), "i").join(p.select(F.col("id").alias("j"), F.col("p").alias("pj")), "j").select("i", "j", (F.sqrt("pi") * F.col("w") / F.sqrt("pj")).alias("q"))
    t = q.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("q").alias("qt"))
    return q.join(t, ["i", "j"]).select("i", "j", (F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - (F.col("q") + F.col("qt")) / 2).alias("w"))


def modularity_matrix(edges: DataFrame, directed: bool = False, limit: int = 5000) -> DataFrame:
    """``i, j, w``: A - k k' / 2m (digraphs: A - out in' / m); dense, refused above ``limit`` nodes."""
    ids = nodes(edges)
    if ids.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} nodes")
    a = adjacency(edges, None, directed)
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    if directed:
        out = ids.join(edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k")), "id", "left").na.fill(0)
        into = ids.join(edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("k")), "id", "left").na.fill(0)
        scale = F.col("m")
    else:
        out = into = degrees(edges).withColumnRenamed("degree", "k")
        scale = 2 * F.col("m")
    cells = out.select(F.col("id").alias("i"), F.col("k").alias("ki")).crossJoin(into.select(F.col("id").alias("j"), F.col("k").alias("kj"))).crossJoin(m)  # at most limit squared
    return cells.join(a, ["i", "j"], "left").select("i", "j", (F.coalesce("w", F.lit(0)) - F.col("ki") * F.col("kj") / scale).alias("w"))


def attribute_matrix(edges: DataFrame, values: DataFrame, weight: str | None = None, normalized: bool = False) -> DataFrame:
    """``x, y, w``: edge weights summed by the values (id, value) of both ends, rows normalised if asked."""
    from pyspark.sql.window import Window

    a = adjacency(edges, weight)
    t = a.join(values.select(F.col("id").alias("i"), F.col("value").alias("x")), "i").join(values.select(F.col("id").alias("j"), F.col("value").alias("y")), "j").groupBy("x", "y").agg(F.sum("w").alias("w"))
    return t.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("x"))) if normalized else t
