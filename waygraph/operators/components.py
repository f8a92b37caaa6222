"""Connected components by alternating large-star and small-star rounds.

Up to TASK_EDGES distinct edges, counted first, are settled in one task, since rounds
would each cost a job for a few megabytes; rows are equal either way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from waygraph.plans.stages import materialise, release


#: Edges that one task writes in a round, or settles alone.
TASK_EDGES = 200_000


def _marked(df: DataFrame, edges: int | None = None) -> tuple[DataFrame, tuple]:
    """Write a round's edges, at most about ``edges`` of them; their count and a sum of hashes are observed on the way."""
    if edges is not None:
        df = df.coalesce(max(1, -(-2 * edges // TASK_EDGES)))
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "cc")
    return out, (seen.get["n"], seen.get["h"])


def _settled(state: DataFrame) -> DataFrame:
    """``id, root`` of a bounded table of edges ``u, v``, by hooking to smaller roots and halving paths."""

    def settle(batches):
        parts = list(batches)
        if not parts:
            return
        e = pd.concat(parts, ignore_index=True)
        codes, names = pd.factorize(pd.concat([e["u"], e["v"]], ignore_index=True), sort=True)
        a, b = codes[: len(e)], codes[len(e) :]
        root = np.arange(len(names))
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
        yield pd.DataFrame({"id": names, "root": names[root]})

    kind = state.schema["u"].dataType.simpleString()
    return state.select("u", "v").coalesce(1).mapInPandas(settle, f"id {kind}, root {kind}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", vertices: DataFrame | None = None, vertex: str = "id", max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """Return ``(id, component)``; the component is the smallest id in it.

    Edges with a null end are ignored, loops only make their vertex known.
    ``vertices`` adds isolated vertices.  Every round keeps at most one row per
    edge, aggregates before it shuffles and is written to shared storage, so
    the work is O(edges) per round for O(log vertices) rounds.  Rows of all nodes are merged:
    as files they are small enough to be broadcast, but not as a table in the driver.  Up to ``task_edges``
    distinct edges are settled in one task instead, with equal rows.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    ids = e.select(F.explode(F.array("a", "b")).alias("id"))
    if vertices is not None:
        ids = ids.union(vertices.select(F.col(vertex).alias("id")).filter("id is not null"))
    ids = ids.distinct()
    state, mark = _marked(e.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if 0 < mark[0] <= task_edges and state.schema["u"].dataType.typeName() in ("long", "integer", "string"):
        return ids.join(_settled(state), "id", "left").select("id", F.coalesce("root", "id").alias("component"))
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u")
        old = state
        state, now = _marked(small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), mark[0])
        release(old)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return ids.join(roots.hint("merge"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))
