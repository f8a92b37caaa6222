"""Kernels of the graph operators: cell joins, searches, relaxation, power iteration.

A search from few sources runs in blocks: nodes are dealt over ranges of their ids, each
block settles alone what reaches it and sends what crosses its border, so the rounds are
counted in blocks passed and not in steps (``settled_in_blocks``).  Searches of a few hops
join a frontier with the edges (``search_on``).
From ``MANY_SOURCES`` sources on, and while the edges are at most ``BROADCAST_EDGES``
(counted first), the adjacency goes to every task as arrays instead and the sources are
dealt over tasks; rows are equal.  Sums along shortest paths go back over the same
levels, for blocks of sources.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from waygraph.functions import geom as G
from waygraph.plans.stages import materialise, release, shared_dir

#: Edges up to which the adjacency is broadcast: two arrays of 8 bytes each, which pass through the driver.
BROADCAST_EDGES = 1_000_000

#: Directed edges of a block that settles alone.
BLOCK_EDGES = 100_000

#: Sources from which whole searches are dealt over tasks; fewer would leave executors idle.
MANY_SOURCES = 16

#: Frontier rows up to which HOPS levels go into one job: beyond it a level is work enough for a job of its own.
SMALL_FRONT = 200_000
HOPS = 8

#: Rows of a frontier for each of its partitions, so that steps of a few rows spread no empty tasks.
PART_ROWS = 20_000


def with_cells(df: DataFrame, line: str, size: float, margin: float = 0.0) -> DataFrame:
    """One row per grid cell (cx, cy) that the bounding box of ``line``, grown by ``margin``, covers."""
    b = G.bounds(F.col(line))

    def span(lo, hi):
        return F.sequence(F.floor((lo - margin) / size), F.floor((hi + margin) / size))

    return df.withColumn("cx", F.explode(span(b["x0"], b["x1"]))).withColumn("cy", F.explode(span(b["y0"], b["y1"])))


def cell_join(left: DataFrame, right: DataFrame, left_line: str, right_line: str, size: float, margin: float, predicate: Column, left_id: str, right_id: str) -> DataFrame:
    """Pairs of rows whose boxes come within ``margin`` and that satisfy ``predicate``, once each.

    Column names of both sides must differ.  Both sides are dealt over grid cells;
    an equi-join on the cell finds candidates and the exact predicate decides.
    """
    a = with_cells(left, left_line, size, margin)
    b = with_cells(right, right_line, size)
    return a.join(b, ["cx", "cy"]).filter(predicate).drop("cx", "cy").dropDuplicates([left_id, right_id])


#: Cells of its box beyond which a polygon is met piece by piece.
SMALL_BOX = 16


def points_in(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """``id, pid``: points (``id, grp, pt``) inside polygons (``pid, grp, rings``) of their group.

    Polygons of at most SMALL_BOX cells meet points by cell.  Of larger ones no row holds
    more than a piece: pieces meet the points of their band of heights, and those that a ray
    to the right crosses are counted; the same test, taken apart.
    """
    b = G.bounds(F.flatten("rings"))
    cells = (F.floor(b["x1"] / size) - F.floor(b["x0"] / size) + 1) * (F.floor(b["y1"] / size) - F.floor(b["y0"] / size) + 1)
    own = polygons.select("pid", F.col("grp").alias("of"), "rings", F.flatten("rings").alias("around"), cells.alias("cells"))
    at = points.select("id", "grp", "pt", F.array("pt").alias("at"))
    inside = F.col("grp").eqNullSafe(F.col("of")) & G.in_polygon(F.col("pt"), F.col("rings"))
    near = cell_join(at, own.filter(F.col("cells") <= SMALL_BOX).drop("cells"), "at", "around", size, 0.0, inside, "id", "pid").select("id", "pid")
    piece = own.filter(F.col("cells") > SMALL_BOX).select("pid", "of", F.explode("rings").alias("ring")).select("pid", "of", F.explode(G.pieces("ring")).alias("s"))
    low, high = F.least("s.a.y", "s.b.y"), F.greatest("s.a.y", "s.b.y")
    piece = piece.filter(low < high).withColumn("band", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    x, y = F.col("pt.x"), F.col("pt.y")
    ax, ay, bx, by = (F.col(f"s.{e}.{c}") for e, c in (("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")))
    crossed = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    met = at.withColumn("band", F.floor(y / size)).join(piece, "band").filter(F.col("grp").eqNullSafe(F.col("of")) & crossed)
    far = met.groupBy("id", "pid").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("id", "pid")
    return near.unionByName(far)


def symmetric(edges: DataFrame, src: str = "src", dst: str = "dst", *more: str) -> DataFrame:
    """Both orientations of every edge."""
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *more).union(edges.select(F.col(dst).alias("src"), F.col(src).alias("dst"), *more))


def adjacency(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(ids, row starts, neighbour positions) of directed ``src, dst``, or None above BROADCAST_EDGES."""
    edges = edges.select("src", "dst").filter("src <> dst").distinct()
    edges = materialise(edges, "adjacency")
    if edges.count() > BROADCAST_EDGES:
        release(edges)
        return None
    e = edges.toPandas()
    release(edges)
    ids = np.unique(np.concatenate([e["src"].to_numpy(), e["dst"].to_numpy()])) if len(e) else np.empty(0, np.int64)
    s, d = np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy())
    order = np.argsort(s, kind="stable")
    return ids, np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(ids)))]).astype(np.int64), d[order].astype(np.int64)


def _neighbours(starts, nbr, nodes):
    n = starts[nodes + 1] - starts[nodes]
    at = np.repeat(starts[nodes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return nbr[at], np.repeat(nodes, n)


def levels_from(starts: np.ndarray, nbr: np.ndarray, root: int, cutoff: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distance, number of shortest paths) of every node from one root; -1 and 0 if unreachable."""
    dist = np.full(len(starts) - 1, -1, np.int64)
    sigma = np.zeros(len(dist))
    dist[root], sigma[root] = 0, 1
    front, level = np.array([root]), 0
    while len(front) and (cutoff is None or level < cutoff):
        to, by = _neighbours(starts, nbr, front)
        new = np.unique(to[dist[to] < 0])
        dist[new] = level + 1
        hit = dist[to] == level + 1
        np.add.at(sigma, to[hit], sigma[by[hit]])
        front, level = new, level + 1
    return dist, sigma


#: Cells of (root, node) that a task searches at a time, and words of 64 roots in reach_sums.
WAVE_CELLS, WORDS = 4_000_000, 16


def _distinct(x, slot):
    """The distinct values of ``x``; ``slot`` is scratch space and holds their positions afterwards."""
    slot[x] = np.arange(len(x))
    x = x[slot[x] == np.arange(len(x))]
    slot[x] = np.arange(len(x))
    return x


def waves(starts: np.ndarray, nbr: np.ndarray, roots: np.ndarray, exact: bool = False):
    """Searches from all ``roots`` at once: a list of levels ``(cells, sigma, edge, by, to, ratio)``, a cell being root's position * n + node.

    ``edge`` are positions in ``nbr`` of the shortest-path edges into the level, ``by`` and ``to``
    the positions of their ends in the cells of the level before and of this one, ``ratio``
    the share of a cell's shortest paths that use the edge.  ``sigma`` is a number of paths times a
    power of two of each cell (numbers beyond doubles keep exact ratios), unless ``exact``.
    """
    n = len(starts) - 1
    seen, slot = np.zeros(len(roots) * n, bool), np.zeros(len(roots) * n, np.int32)
    cells = np.arange(len(roots)) * n + roots
    sigma, power = np.ones(len(cells)), None
    seen[cells] = True
    out = [(cells, sigma, None, None, None, None)]
    node, base, degree = roots, cells - roots, np.diff(starts)
    while True:
        more = degree[node]
        by = np.repeat(np.arange(len(cells)), more)
        edge = (starts[node] - np.cumsum(more) + more)[by]
        edge += np.arange(len(by))
        to = nbr[edge]
        to += base[by]
        own = np.flatnonzero(~seen[to])
        if not len(own):
            return out
        by, edge, to = by[own], edge[own], to[own]
        cells = _distinct(to, slot)
        seen[cells] = True
        to = slot[to]
        node = cells % n
        base = cells - node
        up = sigma[by]
        if power is None and not exact and sigma.max() > 1e250:
            sigma, power = np.frexp(sigma)
            up = sigma[by]
        if power is not None:
            top = np.full(len(cells), np.iinfo(np.int64).min)
            np.maximum.at(top, to, power[by])
            up = np.ldexp(up, np.maximum(power[by] - top[to], -1100).astype(np.int32))
        sigma = np.bincount(to, up, len(cells))
        ratio = up / sigma[to]
        if power is not None:
            sigma, extra = np.frexp(sigma)
            power = top + extra
        out.append((cells, sigma, edge, by, to, ratio))


def root_batches(n: int, at: np.ndarray):
    """Positions of roots in batches of at most WAVE_CELLS cells."""
    size = max(1, WAVE_CELLS // max(1, n))
    for k in range(0, len(at), size):
        yield at[k : k + size]


def summed_at(parts: list, n: int) -> np.ndarray:
    """Sums of values by position below ``n`` of a list of (positions, values)."""
    if not parts:
        return np.zeros(n)
    return np.bincount(np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts]), n)


def reach_sums(starts: np.ndarray, nbr: np.ndarray, roots: np.ndarray, length: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(reach, total, far, inverse, weighted) of each root: nodes reached, sums of hops, largest hops, sums of 1 / hops and of hops times ``length``.

    A node's row of bits says which roots reached it; a level is an or over the rows of its
    predecessors, so all roots of a batch share the scan.
    """
    n, width = len(starts) - 1, -(-len(roots) // 64)
    into = np.argsort(nbr, kind="stable")
    source = np.repeat(np.arange(n), np.diff(starts))[into]
    first = np.concatenate([[0], np.cumsum(np.bincount(nbr, minlength=n))])
    seen, live, slot = np.zeros((n, width), np.uint64), np.zeros((n, width), np.uint64), np.zeros(n, np.int64)
    word, bit = np.arange(len(roots)) // 64, np.uint64(1) << (np.arange(len(roots)) % 64).astype(np.uint64)
    np.bitwise_or.at(seen, (roots, word), bit)
    np.bitwise_or.at(live, (roots, word), bit)
    reach, total, far = np.ones(len(roots), np.int64), np.zeros(len(roots), np.int64), np.zeros(len(roots), np.int64)
    inverse, weighted = np.zeros(len(roots)), np.zeros(len(roots))
    front, level = np.unique(roots), 0
    while len(front):
        level += 1
        more = starts[front + 1] - starts[front]
        cand = nbr[np.repeat(starts[front] - np.cumsum(more) + more, more) + np.arange(more.sum())]
        if not len(cand):
            break
        cand = _distinct(cand, slot)
        more = first[cand + 1] - first[cand]
        begin = np.cumsum(more) - more
        got = np.bitwise_or.reduceat(live[source[np.repeat(first[cand] - begin, more) + np.arange(more.sum())]], begin, axis=0)
        got &= ~seen[cand]
        new = got.any(axis=1)
        if not new.any():
            break
        got, cand = got[new], cand[new]
        seen[cand] |= got
        live[front] = 0
        live[cand] = got
        front = cand
        bits = np.unpackbits(got.view(np.uint8).reshape(len(got), -1), axis=1, bitorder="little")
        full = len(bits) // 255 * 255  # sums of 255 bits fit bytes
        count = bits[:full].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.uint8)
        count = count[: len(roots)]
        reach += count
        total += level * count
        far[count > 0] = level
        inverse += count / level
        if length is not None:
            weighted += level * (length[cand] @ bits[:, : len(roots)])
    return reach, total, far, inverse, weighted


def search(edges: DataFrame, sources: DataFrame | None = None, cutoff: int | None = None, broadcast: bool | None = None) -> DataFrame:
    """``root, node, dist``: hop distances along directed ``src, dst`` from ``sources`` (column ``id``; default all nodes)."""
    spark = edges.sparkSession
    edges = edges.select("src", "dst").filter("src is not null and dst is not null")
    if sources is None:
        sources = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    first = materialise(sources.select(F.col("id").cast("long").alias("root"), F.col("id").cast("long").alias("node"), F.lit(0).alias("dist")).distinct(), "search")
    adj = adjacency(edges) if _dealt(first, broadcast) else None
    if adj is not None:
        shared = spark.sparkContext.broadcast(adj)

        def run(batches):
            ids, starts, nbr = shared.value
            for b in batches:
                for r in b["id"]:
                    i = int(np.searchsorted(ids, r))
                    if i == len(ids) or ids[i] != r:
                        yield pd.DataFrame({"root": [r], "node": [r], "dist": [0]})
                        continue
                    dist, _ = levels_from(starts, nbr, i, cutoff)
                    own = np.flatnonzero(dist >= 0)
                    yield pd.DataFrame({"root": r, "node": ids[own], "dist": dist[own]})

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return first.select(F.col("root").alias("id")).repartition(n, "id").mapInPandas(run, "root long, node long, dist int")
    if cutoff is not None and cutoff <= HOPS:
        return search_on(edges, first, cutoff)
    plain = edges.filter("src <> dst").select("src", "dst").distinct().withColumn("w", F.lit(1.0))
    found = settled_in_blocks(plain, first.select("root", "node", F.col("dist").cast("double").alias("dist"), F.col("root").alias("label")), cutoff)
    return found.select("root", "node", F.col("dist").cast("int").alias("dist"))


def _dealt(first: DataFrame, broadcast: bool | None) -> bool:
    """Whether whole searches from the rows of ``first`` are dealt over tasks."""
    return broadcast if broadcast is not None else first.count() >= MANY_SOURCES


def with_loops(edges: DataFrame, loop: Column, *more: str) -> DataFrame:
    """Edges ``src, dst`` (no loops among them) and a loop of weight ``loop`` at every node, for steps that may stay where they are."""
    stay = edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
    return edges.select("src", "dst", *more).union(stay.select("src", F.col("src").alias("dst"), *[loop.alias(c) for c in more]))


def search_on(edges: DataFrame, first: DataFrame, cutoff: int | None = None) -> DataFrame:
    """``root, node, dist`` from the written rows ``first`` (dist 0): joins of the frontier with ``edges``.

    A job goes HOPS levels on while the frontier has at most SMALL_FRONT rows, else one.
    A level is a join and an aggregate with a partial one before its shuffle; within a job
    rows may also stay, so that the plan is a chain and not a tree.
    """
    plain = edges.select("src", "dst").filter("src <> dst").distinct().withColumn("w", F.lit(1))
    steps = materialise(with_loops(plain, F.lit(0), "w"), "search-edges")
    level, parts, n, size = first, [first], 0, first.count()
    while size and (cutoff is None or n < cutoff):
        k = HOPS if size <= SMALL_FRONT else 1
        k = k if cutoff is None else min(k, cutoff - n)
        reach = in_few_parts(level, size)
        for _ in range(k):
            reach = reach.join(steps, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
            reach = reach.groupBy("root", "node").agg(F.min("dist").alias("dist"))
        n += k
        new, size = counted(reach.join(_union(parts).select("root", "node"), ["root", "node"], "left_anti"), F.col("dist") == n, "search")
        level = new.filter(F.col("dist") == n)
        parts.append(new)
        if len(parts) > 8:
            old, parts = parts, [materialise(_union(parts), "search")]
            level = parts[0].filter(F.col("dist") == n)
            release(*old)
    release(steps)
    return _union(parts)


def _block_settle(starts, nbr, weight, known, fresh, cutoff):
    """Labels (dist, label) that improve in one block, from ``fresh`` ones at its nodes; ``known`` are those of before."""
    best, new, heap = dict(known), {}, []
    for v, d, label in fresh:
        if v not in best or (d, label) < best[v]:
            best[v] = new[v] = (d, label)
    heap = [(d, label, v) for v, (d, label) in new.items()]
    heapq.heapify(heap)
    while heap:
        d, label, u = heapq.heappop(heap)
        if best[u] != (d, label):
            continue
        for k in range(starts[u], starts[u + 1]):
            v, nd = nbr[k], d + weight[k]
            if (cutoff is None or nd <= cutoff) and (v not in best or (nd, label) < best[v]):
                best[v] = new[v] = (nd, label)
                if v >= 0:
                    heapq.heappush(heap, (nd, label, v))
    return new


def node_blocks(edges: DataFrame, count: int) -> DataFrame:
    """``id, blk``: the ends of ``count`` edges dealt over ranges of ids of about BLOCK_EDGES edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    # ids as often as they occur, so that blocks have about equally many edges; equal ids share a range
    cut = ends.repartitionByRange(max(1, -(-count // BLOCK_EDGES)), "id").select("id", F.spark_partition_id().alias("blk")).distinct()
    return materialise(cut, "block-of")


def settled_in_blocks(steps: DataFrame, first: DataFrame, cutoff: float | None = None) -> DataFrame:
    """``root, node, dist, label``: least (sum of ``w``, label) from the rows ``first`` along ``src, dst, w``, w at least 0, src <> dst, pairs unique.

    Nodes are dealt over ranges of their ids of about BLOCK_EDGES edges.  A round gives every
    block that got a better label its edges and what it knew; it settles them alone and
    returns what improved: rows of its own nodes, and rows for nodes of other blocks, which are
    the next round's labels.  Rounds are counted in blocks passed, whatever the depth of the graph.
    """
    edges = steps.select("src", "dst", F.col("w").cast("double").alias("w"))
    count = edges.count()
    block = node_blocks(edges, count)
    into = edges.join(block.select(F.col("id").alias("src"), "blk"), "src").join(block.select(F.col("id").alias("dst"), F.col("blk").alias("to")), "dst")
    into = materialise(into.select("blk", "src", "dst", "to", "w"), "block-edges")
    rows = first.join(block.withColumnRenamed("id", "node"), "node", "left").select(F.coalesce("blk", F.lit(-1)).alias("blk"), "root", "node", "dist", "label")
    fresh = materialise(rows.withColumn("own", F.lit(False)), "block-front")
    alone = fresh.filter("blk = -1").select("root", "node", "dist", "label")  # sources without an edge
    schema = "blk int, root long, node long, dist double, label long, own boolean"

    def settle(labels, e):
        src, dst = e["src"].to_numpy(), e["dst"].to_numpy()
        inner = (e["to"] == e["blk"]).to_numpy()
        ids = np.unique(np.concatenate([src, dst[inner], labels["node"].to_numpy()]))
        far, to = np.unique(dst[~inner], return_inverse=True)  # nodes of other blocks are numbered below 0
        place = dict(zip(dst[~inner].tolist(), e["to"].to_numpy()[~inner].tolist(), strict=True))
        s, d = np.searchsorted(ids, src), np.empty(len(e), np.int64)
        d[inner], d[~inner] = np.searchsorted(ids, dst[inner]), -1 - to
        order = np.argsort(s, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(ids)))]).tolist()
        nbr, weight = d[order].tolist(), e["w"].to_numpy()[order].tolist()
        blk, out = int(labels["blk"].iloc[0]), []
        for root, x in labels.groupby("root"):
            x = x.assign(at=np.searchsorted(ids, x["node"].to_numpy()))
            known = {}
            for v, dist, label in x.loc[x["own"], ["at", "dist", "label"]].itertuples(index=False):
                if v not in known or (dist, label) < known[v]:
                    known[v] = (dist, label)
            new = _block_settle(starts, nbr, weight, known, x.loc[~x["own"], ["at", "dist", "label"]].itertuples(index=False), cutoff)
            if new:
                at = np.fromiter(new, np.int64, len(new))
                node = np.where(at >= 0, ids[np.maximum(at, 0)], far[np.maximum(-1 - at, 0)] if len(far) else 0)
                where = [blk if a >= 0 else place[n] for a, n in zip(at.tolist(), node.tolist(), strict=True)]
                out.append(pd.DataFrame({"blk": where, "root": root, "node": node, "dist": [v[0] for v in new.values()], "label": [v[1] for v in new.values()], "own": at >= 0}))
        return pd.concat(out) if out else pd.DataFrame({"blk": [], "root": [], "node": [], "dist": [], "label": [], "own": []}).astype({"blk": int, "root": int, "node": int, "dist": float, "label": int, "own": bool})

    done: list[DataFrame] = []
    while True:
        live = [r["blk"] for r in fresh.filter("blk >= 0 and not own").select("blk").distinct().collect()]  # at most one row a block
        if not live:
            break
        labels = fresh.filter("not own and blk >= 0").groupBy("blk", "root", "node").agg(F.min(F.struct("dist", "label")).alias("s")).select("blk", "root", "node", "s.dist", "s.label", F.lit(False).alias("own"))
        if done:
            labels = labels.unionByName(_union(done).filter(F.col("blk").isin(live)))
        step = labels.groupBy("blk").cogroup(into.filter(F.col("blk").isin(live)).groupBy("blk")).applyInPandas(_pair(settle), schema)
        new = materialise(step, "block-step")
        fresh = new
        done.append(new.filter("own"))
        if len(done) > 8:
            merged = _union(done).groupBy("blk", "root", "node").agg(F.min(F.struct("dist", "label")).alias("s")).select("blk", "root", "node", "s.dist", "s.label", F.lit(True).alias("own"))
            done = [materialise(merged, "block-known")]
    if not done:
        return alone
    out = _union(done).groupBy("root", "node").agg(F.min(F.struct("dist", "label")).alias("s")).select("root", "node", "s.dist", "s.label")
    return out.unionByName(alone)


#: A distance beyond all others; twice it still fits 32 bits.
FAR = 1 << 29

#: Cells (border node, node) of a block's table of distances.
TABLE_CELLS = 50_000_000

#: Kinds of packed rows ``blk, at, s, cells`` of a block; those of distances from border nodes have their numbers from 0.
IDS, STARTS, NBR, BORDER, MATRIX, ROOTS, HOSTS, REACHED = range(-8, 0)


def hops_from(starts: np.ndarray, nbr: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Hop distances [root, node] of all ``roots`` at once, FAR if unreachable."""
    n, degree = len(starts) - 1, np.diff(starts)
    dist, slot = np.full(len(roots) * n, FAR, np.int32), np.zeros(len(roots) * n, np.int32)
    cells, level = np.arange(len(roots)) * n + roots, 0
    dist[cells] = 0
    while len(cells):
        level += 1
        node = cells % n
        more = degree[node]
        to = nbr[np.repeat(starts[node] - np.cumsum(more) + more, more) + np.arange(more.sum())] + np.repeat(cells - node, more)
        cells = _distinct(to[dist[to] == FAR], slot)
        dist[cells] = level
    return dist.reshape(len(roots), n)


def block_tables(edges: DataFrame) -> DataFrame | None:
    """Packed rows ``blk, at, s, cells``: each block's ids, edges and hop distances from its border nodes inside it.

    ``edges`` has both directions, no loops, pairs unique.  None if borders are so large that
    distances among them, or one block's table, would not fit a task.
    """
    block = node_blocks(edges, edges.count())
    # as files, rows of all nodes are small enough to be broadcast, but not as a table in the driver
    into = edges.join(block.select(F.col("id").alias("src"), "blk").hint("merge"), "src").join(block.select(F.col("id").alias("dst"), F.col("blk").alias("to")).hint("merge"), "dst")
    into = materialise(into.select("blk", "src", "dst", "to"), "block-edges")
    out = F.col("blk") != F.col("to")
    size = into.groupBy("blk").agg(F.countDistinct("src").alias("n"), F.countDistinct(F.when(out, F.col("src"))).alias("b"), F.count_if(out).alias("x"))
    size = size.agg(F.sum(F.col("b") * F.col("b") + F.col("x")).alias("all"), F.max(F.col("b") * F.col("n")).alias("one")).first()
    if (size["all"] or 0) > BROADCAST_EDGES or (size["one"] or 0) > TABLE_CELLS:
        release(block, into)
        return None

    def tables(e):
        src, dst, inner = e["src"].to_numpy(), e["dst"].to_numpy(), (e["blk"] == e["to"]).to_numpy()
        ids = np.unique(src)
        s, d = np.searchsorted(ids, src[inner]), np.searchsorted(ids, dst[inner])
        starts, nbr = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(ids)))]), d[np.argsort(s, kind="stable")]
        border = np.unique(src[~inner])
        dist = hops_from(starts, nbr, np.searchsorted(ids, border))
        crossing = np.stack([src[~inner], dst[~inner]])
        own = dist[:, np.searchsorted(ids, border)]
        rows = [(IDS, ids), (STARTS, starts), (NBR, nbr), (BORDER, np.concatenate([[len(border)], border, crossing.ravel()])), (MATRIX, own), *enumerate(dist)]
        return pd.DataFrame({"blk": np.int32(e["blk"].iloc[0]), "at": [k for k, _ in rows], "s": 0, "cells": [x.astype(np.int32 if k >= 0 or k == MATRIX else np.int64).tobytes() for k, x in rows]})

    packed = materialise(into.groupBy("blk").applyInPandas(tables, PACKED), "block-tables")
    release(block, into)
    return packed


PACKED = "blk int, at int, s long, cells binary"


def _overlay(tables: DataFrame) -> tuple[np.ndarray, list, np.ndarray]:
    """(border nodes, (block, their positions, distances inside it) of each block, positions of edges between blocks); at most BROADCAST_EDGES cells."""
    rows = tables.filter(F.col("at").isin(BORDER, MATRIX)).select("blk", "at", "cells").collect()
    got = {(r["blk"], r["at"]): r["cells"] for r in rows}
    part = {b: np.frombuffer(x, np.int64) for (b, k), x in sorted(got.items()) if k == BORDER}
    ids = np.unique(np.concatenate([x[1 : 1 + x[0]] for x in part.values()]))
    cross = np.concatenate([x[1 + x[0] :].reshape(2, -1) for x in part.values()], axis=1)
    return ids, [(b, np.searchsorted(ids, x[1 : 1 + x[0]]), np.frombuffer(got[b, MATRIX], np.int32).reshape(x[0], x[0])) for b, x in part.items()], np.searchsorted(ids, cross)


def _over_borders(parts: list, cross: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances ``x`` [border node, root] settled over blocks and the edges between them, by sweeps to and fro."""
    while True:
        before = x.copy()
        for way in (1, -1):
            for _, at, inside in parts[::way]:
                own = x[at]
                best = own.copy()
                for k in range(len(at)):
                    np.minimum(best, inside[:, k, None] + own[k], out=best)
                x[at] = best
                mine = np.isin(cross[0], at)
                np.minimum.at(x, cross[1][mine], x[cross[0][mine]] + 1)
        if (x == before).all():
            return x


def _unpacked(x: pd.DataFrame) -> tuple[dict, np.ndarray]:
    """Arrays of a block by kind, and its distances [border node, node]."""
    got = {k: np.frombuffer(c, np.int64) for k, c in zip(x["at"], x["cells"], strict=True) if k in (IDS, STARTS, NBR)}
    rows = x[x["at"] >= 0].sort_values("at")["cells"]
    return got, np.frombuffer(b"".join(rows), np.int32).reshape(len(rows), len(got[IDS]))


def _undominated(x: np.ndarray) -> np.ndarray:
    """The columns of ``x`` that no other column reaches everywhere."""
    x = np.unique(x, axis=1)
    x = x[:, np.argsort(-x.sum(axis=0, dtype=np.int64), kind="stable")]
    kept = np.empty_like(x)
    n = 0
    for k in range(x.shape[1]):
        if not (kept[:, :n] >= x[:, k, None]).all(axis=0).any():
            kept[:, n] = x[:, k]
            n += 1
    return kept[:, :n]


def farthest(tables: DataFrame, overlay, roots: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` (blk, id, low, z) with ``low`` raised to the largest distance to any of ``roots`` (blk, root), in blocks.

    Roots start from the border of their block, go over borders alone (``overlay``, a broadcast), and meet the nodes
    of a block from its border.  Of roots outside a block only those count that lie farthest from
    some combination of its border; those inside are searched if the way over the border does not settle them.
    """
    spark = tables.sparkSession

    def begin(x, r):
        if not len(x) or not len(r):
            return pd.DataFrame({"root": [], "blk": [], "x": []}).astype({"root": int, "blk": int})
        got, dist = _unpacked(x)
        at = np.searchsorted(got[IDS], r["root"].to_numpy())
        return pd.DataFrame({"root": r["root"].to_numpy(), "blk": r["blk"].to_numpy(), "x": [dist[:, k].tobytes() for k in at]})

    hosts = [r["blk"] for r in roots.select("blk").distinct().collect()]  # at most one row a block
    mine = tables.filter(F.col("blk").isin(hosts) & ((F.col("at") >= 0) | (F.col("at") == IDS)))
    first = mine.groupBy("blk").cogroup(roots.groupBy("blk")).applyInPandas(begin, "root long, blk int, x binary")

    def over(batches):
        ids, parts, cross = overlay.value
        place = {b: at for b, at, _ in parts}
        for batch in batches:
            for k in range(0, len(batch), 256):
                own = batch.iloc[k : k + 256]
                x = np.full((len(ids), len(own)), FAR, np.int32)
                for j, (b, c) in enumerate(zip(own["blk"], own["x"], strict=True)):
                    x[place[b], j] = np.frombuffer(c, np.int32)
                x = np.minimum(_over_borders(parts, cross, x), FAR)
                chunk = own["root"].iloc[0]  # names the rows of a chunk
                for b, at, _ in parts:
                    cells = [x[at].tobytes(), own["root"].to_numpy(np.int64).tobytes(), own["blk"].to_numpy(np.int64).tobytes()]
                    yield pd.DataFrame({"blk": np.int32(b), "at": [REACHED, ROOTS, HOSTS], "s": chunk, "cells": cells})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reached = materialise(first.repartition(n, "root").mapInPandas(over, PACKED), "block-reached")

    def meet(x, nodes):
        got, dist = _unpacked(x)
        ids, starts, nbr, blk = got[IDS], got[STARTS], got[NBR], int(nodes["blk"].iloc[0])
        nodes = nodes.sort_values("id")
        low, b, cols, own = nodes["low"].to_numpy().copy(), len(dist), [], []
        for _, c in x[x["at"].isin([ROOTS, HOSTS, REACHED])].groupby("s"):
            c = c.set_index("at")["cells"]
            root, host = np.frombuffer(c[ROOTS], np.int64), np.frombuffer(c[HOSTS], np.int64)
            to = np.frombuffer(c[REACHED], np.int32).reshape(b, len(root))
            cols.append(to[:, host != blk])
            own += [(r, to[:, j]) for j, r in enumerate(root) if host[j] == blk]

        def way(col):
            return (dist + col[:, None]).min(axis=0) if b else np.full(len(ids), FAR, np.int32)

        far = np.concatenate(cols, axis=1) if cols else np.empty((b, 0), np.int32)
        if far.shape[1] and not b:
            low[:] = FAR
        for col in _undominated(far).T if b and far.shape[1] else ():
            np.maximum(low, way(col), out=low)
        near = [(int(np.searchsorted(ids, r)), c) for r, c in own if (way(c) > low).any()]
        for some in root_batches(len(ids), np.arange(len(near))):
            inside = hops_from(starts, nbr, np.array([near[k][0] for k in some]))
            for k, d in zip(some, inside, strict=True):
                np.maximum(low, np.minimum(d, way(near[k][1])), out=low)
        return nodes.assign(low=low)

    use = tables.filter((F.col("at") >= 0) | F.col("at").isin(IDS, STARTS, NBR)).unionByName(reached)
    new = materialise(use.groupBy("blk").cogroup(state.groupBy("blk")).applyInPandas(meet, "blk int, id long, low int, z int"), "farthest")
    release(reached)
    return new


def _pair(function: Callable) -> Callable:
    """A function of two frames; a block without labels gives no rows, one without edges keeps its labels."""

    def run(left, right):
        return function(left, right) if len(left) else left

    return run


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_few_parts(df: DataFrame, rows: int) -> DataFrame:
    """A written table of ``rows`` rows in at most one partition for every PART_ROWS of them."""
    return df.coalesce(1 + rows // PART_ROWS)


def counted(df: DataFrame, condition: Column, name: str) -> tuple[DataFrame, int]:
    """Write ``df``; the number of rows that satisfy ``condition`` is observed on the way."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.when(condition, 1)).alias("n")), name)
    return out, seen.get["n"]


def per_source(edges: DataFrame, sources: DataFrame, schema: str, function: Callable, beyond: Callable | None = None) -> DataFrame:
    """Run ``function(ids, starts, nbr, positions)`` -> DataFrame on each batch of sources, with the adjacency broadcast.

    Batches return partial sums, so only sums leave a task.  Above BROADCAST_EDGES
    ``beyond()`` gives the rows instead.
    """
    adj = adjacency(edges)
    if adj is None:
        return beyond()
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(adj)

    def run(batches):
        ids, starts, nbr = shared.value
        for b in batches:
            own = b["id"].to_numpy()
            at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
            yield function(ids, starts, nbr, at[ids[at] == own] if len(ids) else at[:0])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sources.select(F.col("id").cast("long").alias("id")).repartitionByRange(n, "id").sortWithinPartitions("id").mapInPandas(run, schema)  # near ids are searched together


#: Rows of (source, node) that a block of sources may reach in level_sums.
BLOCK_ROWS = 500_000_000


def level_sums(edges: DataFrame, sources: DataFrame, kind: str = "betweenness", endpoints: bool = False, targets: set | None = None, per_edge: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, value`` (or ``src, dst, value``): the sums of ``brandes`` and ``edge_brandes`` by joins alone, for graphs of any size.

    Numbers of shortest paths are summed level by level from the sources, then
    dependencies level by level back to them.  Sources go in blocks, so that no more
    than about ``block_rows`` rows of (source, node) are held at a time.
    """
    e = materialise(edges.select("src", "dst").filter("src <> dst").distinct(), "level-edges")
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().count()
    own = sources.select(F.col("id").cast("long").alias("id")).distinct()
    blocks = max(1, -(-own.count() * n // block_rows))
    own = materialise(own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))), "level-sources")
    start = F.lit(1.0) if kind == "load" else F.lit(0.0)
    one = F.lit(1.0) if targets is None else F.col("node").isin(sorted(targets)).cast("double")
    key, out = (["src", "dst"] if per_edge else ["id"]), None
    for b in range(blocks):
        levels = [materialise(own.filter(F.col("b") == b).select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(1.0).alias("sigma")), "level")]
        seen = levels[0].select("root", "node")
        while True:
            step = levels[-1].join(e, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma")).join(seen, ["root", "node"], "left_anti")
            step = materialise(step, "level")
            if not step.limit(1).count():
                break
            levels.append(step)
            seen = seen.unionByName(step.select("root", "node"))
        below = levels[-1].withColumn("delta", start)
        for k in range(len(levels) - 1, 0, -1):
            above = levels[k - 1].select("root", F.col("node").alias("src"), F.col("sigma").alias("up"))
            links = below.join(e, F.col("node") == F.col("dst")).join(above, ["root", "src"])
            if kind == "load":
                preds = links.groupBy("root", "node").agg(F.count(F.lit(1)).alias("preds"))
                part = F.col("delta") / F.col("preds")
                links = links.join(preds, ["root", "node"])
            else:
                part = F.lit(1.0) + F.col("delta") if kind == "stress" else F.col("up") / F.col("sigma") * (one + F.col("delta"))
            links = links.withColumn("part", part)
            if per_edge:
                links = materialise(links.select("root", "src", "dst", "part"), "level-links")
                rows = links.groupBy("src", "dst").agg(F.sum("part").alias("value"))
            else:
                gain = F.col("sigma") * F.col("delta") if kind == "stress" else F.col("delta") - 1 if kind == "load" else F.col("delta")
                rows = below.groupBy(F.col("node").alias("id")).agg(F.sum(gain + (1.0 if endpoints else 0.0)).alias("value"))
                if endpoints:
                    rows = rows.unionByName(below.groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("value")))
            out = rows if out is None else out.unionByName(rows)
            sums = links.groupBy("root", F.col("src").alias("node")).agg(F.sum("part").alias("got"))
            below = levels[k - 1].join(sums, ["root", "node"], "left").select("root", "node", "sigma", (start + F.coalesce("got", F.lit(0.0))).alias("delta"))
            below = materialise(below, "level-back")
        if out is not None:
            out = materialise(out.groupBy(*key).agg(F.sum("value").alias("value")), "level-sums")
        release(*levels)
    if out is None:
        return e.select(*([F.col("src"), F.col("dst")] if per_edge else [F.col("src").alias("id")]), F.lit(0.0).alias("value")).limit(0)
    return out


def _settle(starts, nbr, weight, root, cutoff, targets=None, nearest=False):
    """(distances, predecessors) from one root over non-negative weights; of equal sums the least predecessor settled before.

    With ``targets`` (a set, which is emptied) the search ends once all are settled, or the ``nearest``, which is the least of equally near ones.
    """
    dist, pred, done = {root: 0.0}, {root: -1}, set()
    heap = [(0.0, root)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if targets is not None:
            if nearest and u in targets:
                break
            targets.discard(u)
            if not targets:
                break
        for k in range(starts[u], starts[u + 1]):
            v, nd = int(nbr[k]), d + float(weight[k])
            if v in done or (cutoff is not None and nd > cutoff):
                continue
            old = dist.get(v)
            if old is None or nd < old:
                dist[v], pred[v] = nd, u
                heapq.heappush(heap, (nd, v))
            elif nd == old and u < pred[v]:
                pred[v] = u
    return dist, pred


def _relax_broadcast(steps: DataFrame, sources: DataFrame, cutoff: float | None) -> DataFrame:
    """relax() with the weighted adjacency sent to every task and the sources dealt over tasks."""
    spark = steps.sparkSession
    e = steps.toPandas()
    ids = np.unique(np.concatenate([e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64)]))
    s, d = np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy())
    order = np.argsort(s, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(ids)))]).astype(np.int64)
    shared = spark.sparkContext.broadcast((ids, starts, d[order], e["w"].to_numpy(np.float64)[order]))

    def run(batches):
        ids, starts, nbr, w = shared.value
        for b in batches:
            for r in b["id"]:
                i = int(np.searchsorted(ids, r))
                if i == len(ids) or ids[i] != r:
                    yield pd.DataFrame({"root": [r], "node": [r], "dist": [0.0], "pred": pd.array([None], "Int64")})
                    continue
                dist, pred = _settle(starts, nbr, w, i, cutoff)
                at = np.fromiter(dist, np.int64, len(dist))
                p = np.fromiter((pred[k] for k in dist), np.int64, len(dist))
                yield pd.DataFrame({"root": r, "node": ids[at], "dist": list(dist.values()), "pred": pd.array(ids[np.maximum(p, 0)], "Int64").copy()}).assign(pred=lambda x: x["pred"].mask(p < 0))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sources.select(F.col("id").cast("long").alias("id")).distinct().repartition(n, "id").mapInPandas(run, "root long, node long, dist double, pred long")


def routes(steps: DataFrame, wanted: DataFrame, nearest: bool = False) -> DataFrame | None:
    """``root, node, path`` for the pairs ``wanted`` (root, node), by least sums of ``w`` > 0 along ``src, dst, w``, of equal sums the least predecessor.

    With ``nearest`` only for the nearest node of every root, of equally near ones the least.

    Sources are dealt over tasks with the adjacency broadcast, and a search ends once its
    targets are settled.  None, for the caller to do it by joins, from fewer than MANY_SOURCES
    sources, above BROADCAST_EDGES edges, or if a weight is not above 0.
    """
    plain = materialise(steps.filter("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("w").cast("double").alias("w")), "route-edges")
    facts = plain.agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("low")).first()
    wanted = wanted.select(F.col("root").cast("long").alias("root"), F.col("node").cast("long").alias("node")).distinct()
    if not facts["n"] or facts["n"] > BROADCAST_EDGES or facts["low"] <= 0 or wanted.select("root").distinct().count() < MANY_SOURCES:
        return None
    spark = steps.sparkSession
    e = plain.toPandas()  # at most BROADCAST_EDGES rows
    release(plain)
    ids = np.unique(np.concatenate([e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64)]))
    s, d = np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy())
    order = np.argsort(s, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(ids)))]).astype(np.int64)
    shared = spark.sparkContext.broadcast((ids, starts, d[order], e["w"].to_numpy(np.float64)[order]))

    def run(batches):
        ids, starts, nbr, w = shared.value
        for b in batches:
            for r, nodes in zip(b["root"], b["nodes"], strict=True):
                i, found = int(np.searchsorted(ids, r)), []
                if i == len(ids) or ids[i] != r:
                    found = [(r, r, [r])] if r in nodes else []
                else:
                    at = {int(np.searchsorted(ids, x)): int(x) for x in nodes}
                    at = {k: x for k, x in at.items() if k < len(ids) and ids[k] == x}
                    dist, pred = _settle(starts, nbr, w, i, None, set(at), nearest)
                    if nearest:
                        at = {k: at[k] for _, k in sorted((dist[k], k) for k in at if k in dist)[:1]}
                    for k, x in at.items():
                        path = [k] if k in dist else []
                        while path and pred[path[-1]] >= 0:
                            path.append(pred[path[-1]])
                        if path:
                            found.append((r, x, ids[path[::-1]].tolist()))
                yield pd.DataFrame(found, columns=["root", "node", "path"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return wanted.groupBy("root").agg(F.collect_list("node").alias("nodes")).repartition(n, "root").mapInPandas(run, "root long, node long, path array<long>")


#: Roots that a task sweeps at a time, and visits for each node after which roots are searched one by one instead.
SWEPT_ROOTS, VISITS = 256, 64


def _swept(starts, nbr, weight, roots) -> np.ndarray | None:
    """Least sums [node, root] over edges into each node, by sweeps to and fro over the nodes that an end moved before; None beyond VISITS."""
    n = len(starts) - 1
    x = np.full((n, len(roots)), np.inf)
    x[roots, np.arange(len(roots))] = 0.0
    cut, out = starts.tolist(), [[] for _ in range(n)]
    for u in range(n):
        for v in nbr[cut[u] : cut[u + 1]].tolist():
            out[v].append(u)
    stale, weight, visits, turn = bytearray(n), weight[:, None], 0, 1
    for r in roots.tolist():
        for v in out[r]:
            stale[v] = 1
    while any(stale):
        for u in range(n)[::turn]:
            if not stale[u]:
                continue
            stale[u] = 0
            visits += 1
            best = (x[nbr[cut[u] : cut[u + 1]]] + weight[cut[u] : cut[u + 1]]).min(axis=0)
            if (best < x[u]).any():
                np.minimum(x[u], best, out=x[u])
                for v in out[u]:
                    stale[v] = 1
        if visits > VISITS * n:
            return None
        turn = -turn
    return x


def distances_among(steps: DataFrame, ids: DataFrame) -> DataFrame | None:
    """``root, node, dist`` of reachable pairs of ``ids`` (``id``), by least sums of ``w`` along directed ``src, dst, w``.

    The adjacency and the ids are broadcast, and a task searches from many roots at a time.
    None, for the caller to do it otherwise, from fewer than MANY_SOURCES ids, above BROADCAST_EDGES edges or
    ids, or if a weight is below 0.
    """
    plain = materialise(steps.filter("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("w").cast("double").alias("w")), "among-edges")
    facts = plain.agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("low")).first()
    own = materialise(ids.select(F.col("id").cast("long").alias("id")).filter("id is not null").distinct(), "among-ids")
    count = own.count()
    if not facts["n"] or max(facts["n"], count) > BROADCAST_EDGES or facts["low"] < 0 or count < MANY_SOURCES:
        release(plain, own)
        return None
    e = plain.toPandas()  # at most BROADCAST_EDGES rows
    release(plain)
    asked = np.sort(own.toPandas()["id"].to_numpy(np.int64))
    names = np.unique(np.concatenate([e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64), asked]))
    s, d = np.searchsorted(names, e["src"].to_numpy()), np.searchsorted(names, e["dst"].to_numpy())
    order = np.argsort(d, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(names)))]).astype(np.int64)
    shared = steps.sparkSession.sparkContext.broadcast((names, starts, s[order].astype(np.int64), e["w"].to_numpy(np.float64)[order], np.searchsorted(names, asked)))

    def alone(starts, nbr, weight, roots):
        """Columns of ``_swept``, root by root; its edges are turned, so that they lead out of nodes."""
        dst = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.argsort(nbr, kind="stable")
        out = np.concatenate([[0], np.cumsum(np.bincount(nbr, minlength=len(starts) - 1))])
        x = np.full((len(starts) - 1, len(roots)), np.inf)
        for j, r in enumerate(roots.tolist()):
            dist, _ = _settle(out, dst[order], weight[order], r, None)
            x[np.fromiter(dist, np.int64, len(dist)), j] = list(dist.values())
        return x

    def run(batches):
        names, starts, nbr, weight, at = shared.value
        for b in batches:
            for k in range(0, len(b), SWEPT_ROOTS):
                roots = np.searchsorted(names, b["id"].to_numpy()[k : k + SWEPT_ROOTS])
                x = _swept(starts, nbr, weight, roots)
                x = (alone(starts, nbr, weight, roots) if x is None else x)[at]
                for j, r in enumerate(names[roots].tolist()):
                    met = np.flatnonzero(np.isfinite(x[:, j]))
                    yield pd.DataFrame({"root": r, "node": names[at[met]], "dist": x[met, j]})

    return own.repartitionByRange(-(-count // SWEPT_ROOTS), "id").mapInPandas(run, "root long, node long, dist double")


def relax(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, max_rounds: int = 1 << 40, broadcast: bool | None = None) -> DataFrame:
    """``root, node, dist, pred``: least sums of ``w`` along directed ``src, dst, w``; of equal sums the smallest predecessor.

    Rounds join the rows that improved in the round before with the edges; while those are
    at most SMALL_FRONT, a round goes HOPS edges on.  Negative weights are allowed (rounds
    then go one edge on), and a negative cycle raises ``NegativeCycle`` once predecessors
    run in a circle.  From MANY_SOURCES sources on, and with at most BROADCAST_EDGES edges
    (counted first) and no negative weights, whole searches are dealt over tasks instead.
    """
    plain = materialise(edges.filter("src is not null and dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("w").cast("double").alias("w")), "relax-edges")
    facts = plain.agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("low")).first()
    negative = (facts["low"] or 0.0) < 0
    best = materialise(sources.select(F.col("id").cast("long").alias("root"), F.col("id").cast("long").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred")).distinct(), "relax")
    if _dealt(best, broadcast) and facts["n"] <= BROADCAST_EDGES and not negative:
        return _relax_broadcast(plain, sources, cutoff)
    if (facts["low"] or 1.0) > 0 and max_rounds >= 1 << 40:
        d = materialise(settled_in_blocks(plain, best.select("root", "node", "dist", F.col("root").alias("label")), cutoff).select("root", "node", "dist"), "relax-dist")
        up = d.select("root", F.col("node").alias("src"), F.col("dist").alias("ds"))
        back = plain.join(up, "src").join(d.select("root", F.col("node").alias("dst"), F.col("dist").alias("dd")), ["root", "dst"]).filter("ds + w = dd")
        return d.join(back.groupBy("root", F.col("dst").alias("node")).agg(F.min("src").alias("pred")), ["root", "node"], "left").select("root", "node", "dist", "pred")
    nodes = plain.select(F.explode(F.array("src", "dst")).alias("n")).distinct().count()
    steps = materialise(with_loops(plain, F.lit(0.0), "w"), "relax-steps")
    front = old = best
    size = best.count()
    for k in range(max_rounds):
        if negative and (k > nodes or (k >= 8 and k & (k - 1) == 0 and _circular(best, ["root", "node"], nodes))):
            raise NegativeCycle("a cycle of negative weight")
        step = in_few_parts(front, size)
        for _ in range(1 if negative or size > SMALL_FRONT else HOPS):
            stays = F.col("src") == F.col("dst")
            step = step.join(steps, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.when(stays, F.col("pred")).otherwise(F.col("src")).alias("pred"))
            if cutoff is not None:
                step = step.filter(F.col("dist") <= cutoff)
            step = step.groupBy("root", "node").agg(F.min(F.struct("dist", "pred")).alias("s")).select("root", "node", "s.dist", "s.pred")
        joined = best.join(step.select("root", "node", F.col("dist").alias("nd"), F.col("pred").alias("np")), ["root", "node"], "full")
        better = F.col("nd").isNotNull() & (F.col("dist").isNull() | (F.col("nd") < F.col("dist")) | ((F.col("nd") == F.col("dist")) & (F.col("np") < F.col("pred"))))
        nxt = joined.select("root", "node", F.when(better, F.col("nd")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("np")).otherwise(F.col("pred")).alias("pred"), F.coalesce(F.col("nd") < F.col("dist"), F.col("nd").isNotNull() & F.col("dist").isNull(), F.lit(False)).alias("moved"))
        nxt, size = counted(nxt, F.col("moved"), "relax")
        release(old)
        old, best, front = nxt, nxt.drop("moved"), nxt.filter("moved").drop("moved")
        if not size:
            release(plain, steps)
            return best
    raise RuntimeError("relaxation did not settle")


def peel(edges: DataFrame, keep: Column) -> DataFrame:
    """Remove nodes of undirected ``src, dst`` whose ``degree`` fails ``keep``, again and again, until none does."""
    e = materialise(edges.select("src", "dst").filter("src <> dst"), "peel")
    n = e.count()
    while True:
        ok = symmetric(e).groupBy("src").agg(F.count(F.lit(1)).alias("degree")).filter(keep).select(F.col("src").alias("id"))
        e2 = e.join(ok.withColumnRenamed("id", "src"), "src", "left_semi").join(ok.withColumnRenamed("id", "dst"), "dst", "left_semi")
        old, e = e, materialise(e2.select("src", "dst"), "peel")
        release(old)
        m = e.count()
        if m == n:
            return e
        n = m


def list_ranks(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, last, rank`` of chains ``id, next`` (null at the end): the chain's last id and the steps to it.

    Pointer jumping: each round joins every id with what its pointer points to, so a
    chain of n takes log2 n rounds, each written to shared storage.  Ids are unique,
    no two share a next, and there is no cycle (else an error after ``max_rounds``).
    """
    done = F.col("next").isNull()
    state = materialise(links.select("id", F.when(done, F.col("id")).otherwise(F.col("next")).alias("to"), F.when(done, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("rank"), done.alias("ended")), "ranks")
    for _ in range(max_rounds):
        if state.filter("not ended").isEmpty():
            return state.select("id", F.col("to").alias("last"), "rank")
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("rank").alias("more"), F.col("ended").alias("end2"))
        old, state = state, materialise(state.filter("ended").unionByName(state.filter("not ended").join(ahead, "to").select("id", F.col("to2").alias("to"), (F.col("rank") + F.col("more")).alias("rank"), F.col("end2").alias("ended"))), "ranks")
        release(old)
    raise EndlessChain(f"chains of more than 2^{max_rounds} links, or a cycle")


class EndlessChain(RuntimeError):
    """A chain of pointers that does not end."""


class NegativeCycle(ValueError):
    """A cycle whose weights sum to less than 0."""


def ordered_ids(ids: DataFrame) -> DataFrame:
    """``id, n``: the distinct values of a column ``id`` with numbers from 0 up in their order, not gapless.

    Numbers leave all negative values free, so that extra nodes never clash with given ones.
    """
    sorted_ = ids.select("id").filter("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
    return materialise(sorted_.withColumn("n", F.monotonically_increasing_id()), "ordered-ids")


def numbered(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ids in some columns replaced by their numbers (``ordered_ids``)."""
    for c in columns:
        rows = rows.join(names.select(F.col("id").alias(c), F.col("n").alias("_n")), c).drop(c).withColumnRenamed("_n", c)
    return rows


def _circular(best: DataFrame, key: list[str], nodes: int) -> bool:
    """Whether predecessors (``key``, the last of which is the node, and ``pred``) run in a circle: pointer jumping finds no end."""
    point = lambda last: F.struct(*key[:-1], F.col(last).alias("node"))
    links = best.select(point(key[-1]).alias("id"), F.when(F.col("pred").isNotNull(), point("pred")).alias("next"))
    try:
        list_ranks(links, max(1, nodes).bit_length() + 1)
    except EndlessChain:
        return True
    return False


def potentials(edges: DataFrame) -> DataFrame:
    """``node, dist, pred``: least sums of ``w`` along walks of a digraph that may start anywhere at 0; weights may be negative.

    Only rows that improved are joined again.  A cycle of negative weight raises
    ``NegativeCycle``: predecessors then run in a circle, which pointer jumping finds after
    4, 8, 16, .. rounds, and no more rounds than nodes are needed otherwise.
    """
    if not edges.filter("src = dst and w < 0").isEmpty():
        raise NegativeCycle("a loop of negative weight")
    steps = materialise(edges.filter("src <> dst").groupBy("src", "dst").agg(F.min("w").cast("double").alias("w")), "relax-edges")
    best = old = materialise(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.lit(0.0).alias("dist"), F.col("node").alias("pred")).withColumn("pred", F.when(F.lit(False), F.col("pred"))), "potentials")
    nodes, front, k = best.count(), best, 0
    while True:
        step = front.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("pred"))
        step = step.groupBy("node").agg(F.min(F.struct("dist", "pred")).alias("s"))
        lower = F.col("s").isNotNull() & (F.col("s.dist") < F.col("dist"))
        nxt = best.join(step, "node", "left").select("node", F.when(lower, F.col("s.dist")).otherwise(F.col("dist")).alias("dist"), F.when(lower, F.col("s.pred")).otherwise(F.col("pred")).alias("pred"), lower.alias("moved"))
        nxt = materialise(nxt, "potentials")
        release(old)
        old, best, front, k = nxt, nxt.drop("moved"), nxt.filter("moved").drop("moved"), k + 1
        if front.isEmpty():
            return best
        if k > nodes or (k >= 4 and k & (k - 1) == 0 and _circular(best, ["node"], nodes)):
            raise NegativeCycle("a cycle of negative weight")


#: Slices of distance in which weighted sums are taken.
SLICES = 64


def weighted_sums(edges: DataFrame, sources: DataFrame, kind: str = "betweenness", endpoints: bool = False, targets: set | None = None, per_edge: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, value`` (or ``src, dst, value``): the sums of ``level_sums`` along shortest paths by positive weights ``w``.

    The shortest-path edges of every source are kept as rows (root, a, b), dealt over slices
    of the distance of their ends.  Numbers of paths are summed slice by slice outwards; within
    a slice rows that changed are joined again until none does.  The way back is a sum
    over paths too: with y = (1 + delta) / sigma, y(a) is 1 / sigma(a) plus the y of all
    successors; stress starts from 1, load divides by the number of predecessors.
    Sources go in blocks, so that at most about ``block_rows`` rows of (source, node) are held.
    """
    steps = materialise(edges.filter("src <> dst").groupBy("src", "dst").agg(F.min("w").cast("double").alias("w")), "weighted-edges")
    if not steps.filter("w <= 0").isEmpty():
        raise ValueError("weights must be above 0")
    n = steps.select(F.explode(F.array("src", "dst")).alias("id")).distinct().count()
    own = sources.select(F.col("id").cast("long").alias("id")).distinct()
    blocks = max(1, -(-own.count() * n // block_rows))
    own = materialise(own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))), "weighted-sources")
    key, out = (["src", "dst"] if per_edge else ["id"]), None
    for b in range(blocks):
        rows = _weighted_block(steps, own.filter(F.col("b") == b).select("id"), kind, endpoints, targets, per_edge)
        out = rows if out is None else out.unionByName(rows)
    return materialise(out.groupBy(*key).agg(F.sum("value").alias("value")), "weighted-sums")


def _weighted_block(steps: DataFrame, sources: DataFrame, kind: str, endpoints: bool, targets: set | None, per_edge: bool) -> DataFrame:
    spark = steps.sparkSession
    d = materialise(relax(steps, sources).select("root", "node", "dist"), "weighted-dist")
    facts = d.agg(F.max("dist").alias("far")).first()
    low = steps.agg(F.min("w")).first()[0] or 1.0
    # slices no thinner than the least weight: then no edge stays in its slice
    width = max(low * (1 - 1e-9), (facts["far"] or 0.0) / SLICES * (1 + 1e-9))
    slice_of = lambda c: F.floor(F.col(c) / width).cast("int")
    a = d.select("root", F.col("node").alias("a"), F.col("dist").alias("da"))
    c = d.select("root", F.col("node").alias("b"), F.col("dist").alias("db"))
    on = F.abs(F.col("da") + F.col("w") - F.col("db")) <= F.greatest(F.lit(1.0), F.col("db")) * 1e-12
    dag = a.join(steps, F.col("a") == F.col("src")).drop("src").withColumnRenamed("dst", "b").join(c, ["root", "b"]).filter(on)
    dag = dag.select("root", "a", "b", slice_of("da").alias("ka"), slice_of("db").alias("kb"))
    if kind == "load":
        dag = materialise(dag, "weighted-preds")
        dag = dag.join(dag.groupBy("root", "b").agg((1.0 / F.count(F.lit(1))).alias("f")), ["root", "b"])
    else:
        dag = dag.withColumn("f", F.lit(1.0))
    path = shared_dir(spark, "weighted-dag")
    dag = dag.select("root", "a", "b", "f", "ka", "kb")
    dag.repartition("ka", "kb", F.pmod(F.xxhash64("root"), F.lit(8))).write.partitionBy("ka", "kb").parquet(path)
    dag = spark.read.schema(dag.schema).parquet(path)
    pairs = {(r["ka"], r["kb"]) for r in dag.select("ka", "kb").distinct().collect()}  # at most SLICES squared

    def summed(start: dict, of: str, to: str, slices: list[int], weight: Column, name: str) -> dict:
        """``root, node, x`` of each slice: start plus the weighted x of the other ends of the edges ``of`` -> ``to``."""
        done: dict[int, DataFrame] = {}
        for k in slices:
            parts = [start[k]] if k in start else []
            for j in done:
                if (pair := (j, k) if to == "b" else (k, j)) in pairs:
                    e = dag.filter((F.col("ka") == pair[0]) & (F.col("kb") == pair[1]))
                    parts.append(done[j].join(e, (done[j]["root"] == e["root"]) & (done[j]["node"] == e[of])).select(e["root"], F.col(to).alias("node"), (F.col("x") * weight).alias("x")))
            if not parts:
                continue
            x = parts[0]
            for p in parts[1:]:
                x = x.unionByName(p)
            x = front = materialise(x.groupBy("root", "node").agg(F.sum("x").alias("x")), name)
            if (k, k) in pairs:
                e = dag.filter((F.col("ka") == k) & (F.col("kb") == k))
                while True:
                    step = front.join(e, (front["root"] == e["root"]) & (front["node"] == e[of])).select(e["root"], F.col(to).alias("node"), (F.col("x") * weight).alias("x"))
                    front = materialise(step.groupBy("root", "node").agg(F.sum("x").alias("x")), name)
                    if front.isEmpty():
                        break
                    x = materialise(x.unionByName(front).groupBy("root", "node").agg(F.sum("x").alias("x")), name)
            done[k] = x
        return done

    def joined(by: dict) -> DataFrame:
        out = None
        for x in by.values():
            out = x if out is None else out.unionByName(x)
        return out

    slices = sorted({k for pair in pairs for k in pair})
    root = sources.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(1.0).alias("x"))
    if not slices:
        empty = steps.select("src", "dst", F.lit(0.0).alias("value")) if per_edge else steps.select(F.col("src").alias("id"), F.lit(0.0).alias("value"))
        return empty.limit(0)
    sigma = summed({0: root}, "a", "b", slices, F.lit(1.0), "weighted-sigma")
    one = F.lit(1.0) if targets is None else F.col("node").isin(sorted(targets)).cast("double")
    first = one / F.col("x") if kind == "betweenness" else F.lit(1.0)
    start = {k: x.select("root", "node", first.alias("x")) for k, x in sigma.items()}
    back = summed(start, "b", "a", slices[::-1], F.col("f"), "weighted-back")
    s, y = joined(sigma).withColumnRenamed("x", "sigma"), joined(back).withColumnRenamed("x", "y")
    if per_edge:
        up, down = s.withColumnRenamed("node", "a"), y.withColumnRenamed("node", "b")
        rows = dag.join(up, ["root", "a"]).join(down, ["root", "b"])
        return rows.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum(F.col("sigma") * F.col("y")).alias("value"))
    own = (F.col("y") - first_of(kind, one)) * (F.lit(1.0) if kind == "load" else F.col("sigma"))
    inner = s.join(y, ["root", "node"]).filter("root <> node")
    rows = inner.groupBy(F.col("node").alias("id")).agg(F.sum(own + (1.0 if endpoints else 0.0)).alias("value"))
    if endpoints:
        rows = rows.unionByName(inner.groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("value")))
    return rows


def first_of(kind: str, one: Column) -> Column:
    """What a node's own start adds to its sum, in terms of ``sigma``."""
    return one / F.col("sigma") if kind == "betweenness" else F.lit(1.0)
