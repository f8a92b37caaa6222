"""Planar geometry on columns: PT struct<x,y>, LINE array<PT>, RING closed counter-clockwise array<PT>.

Lengths, azimuths, distances and positions are Catalyst expressions.  Hulls,
clipping, merging and simplifying are Arrow-batched functions over single rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PT = "struct<x:double,y:double>"
LINE = f"array<{PT}>"
MLINE = f"array<{LINE}>"
ON_LINE = 1e-2


def point(x, y) -> Column:
    """A point from two numbers or columns."""
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def start_point(line) -> Column:
    return F.element_at(line, 1)


def end_point(line) -> Column:
    return F.element_at(line, -1)


def point_n(line, n: int) -> Column:
    """The n-th point from 1, or from the end if negative."""
    return F.element_at(line, n)


def num_points(line) -> Column:
    return F.size(line)


def distance(p: Column, q: Column) -> Column:
    """Euclidean distance of two points."""
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def pieces(line) -> Column:
    """The line's straight pieces as array<struct<a,b>>."""
    line = F.col(line) if isinstance(line, str) else line
    n = F.size(line)
    return F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(line) -> Column:
    """Sum of the lengths of the pieces."""
    return F.aggregate(pieces(line), F.lit(0.0), lambda acc, s: acc + distance(s["a"], s["b"]))


def azimuth(p: Column, q: Column) -> Column:
    """Angle from north, clockwise, in (-pi, pi]: atan2(dx, dy)."""
    return F.atan2(q["x"] - p["x"], q["y"] - p["y"])


def deviation(a: Column, b: Column) -> Column:
    """Deviation of two departing azimuths from straight on: 0 is straight, pi a full turn back."""
    turn = F.abs(a - b)
    inner = F.when(turn > F.pi(), 2 * F.pi() - turn).otherwise(turn)
    return F.abs(inner - F.pi())


def piece_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from a straight piece."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = dx * dx + dy * dy
    t = F.when(n > 0, ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / n).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt((p["x"] - a["x"] - t * dx) * (p["x"] - a["x"] - t * dx) + (p["y"] - a["y"] - t * dy) * (p["y"] - a["y"] - t * dy))


def line_distance(p: Column, line) -> Column:
    """Distance of a point from a line."""
    return F.array_min(F.transform(pieces(line), lambda s: piece_distance(p, s["a"], s["b"])))


def _side(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def pieces_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """True if two straight pieces share a point, by orientation determinants."""
    s1, s2, s3, s4 = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)

    def within(p, q, r):
        return r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    proper = (F.signum(s1) * F.signum(s2) < 0) & (F.signum(s3) * F.signum(s4) < 0)
    return proper | ((s1 == 0) & within(a, b, c)) | ((s2 == 0) & within(a, b, d)) | ((s3 == 0) & within(c, d, a)) | ((s4 == 0) & within(c, d, b))


def crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The point where two pieces that are not parallel cross, else null."""
    rx, ry, sx, sy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    det = rx * sy - ry * sx
    t = F.when(det != 0, ((c["x"] - a["x"]) * sy - (c["y"] - a["y"]) * sx) / det)
    u = F.when(det != 0, ((c["x"] - a["x"]) * ry - (c["y"] - a["y"]) * rx) / det)
    return F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), point(a["x"] + t * rx, a["y"] + t * ry))


def in_ring(p: Column, ring) -> Column:
    """True if a point lies inside a ring, by ray casting; points on the upper or right edge are outside."""
    def flips(s):
        a, b = s["a"], s["b"]
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(pieces(ring), flips)) % 2 == 1


def in_polygon(p: Column, rings) -> Column:
    """True if a point lies inside a polygon of several rings (holes, parts): a ray from it crosses them an odd number of times."""
    return F.size(F.filter(rings, lambda ring: in_ring(p, ring))) % 2 == 1


def pieces_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """True if two straight pieces cross in a point inside both."""
    return (F.signum(_side(a, b, c)) * F.signum(_side(a, b, d)) < 0) & (F.signum(_side(c, d, a)) * F.signum(_side(c, d, b)) < 0)


def within_polygon(line, rings) -> Column:
    """True if a line lies inside a polygon, concave or with holes: its points and the middles of its pieces do, and no piece crosses a ring."""
    line, rings = (F.col(x) if isinstance(x, str) else x for x in (line, rings))
    middles = F.transform(pieces(line), lambda s: point((s["a"]["x"] + s["b"]["x"]) / 2, (s["a"]["y"] + s["b"]["y"]) / 2))
    crossed = F.exists(rings, lambda ring: F.exists(pieces(ring), lambda e: F.exists(pieces(line), lambda s: pieces_cross(s["a"], s["b"], e["a"], e["b"]))))
    return F.forall(F.concat(line, middles), lambda p: in_polygon(p, rings)) & ~crossed


def meets_polygon(line, rings) -> Column:
    """True if a line shares a point with a polygon: it starts inside, or a piece meets a ring."""
    line, rings = (F.col(x) if isinstance(x, str) else x for x in (line, rings))
    touched = F.exists(rings, lambda ring: F.exists(pieces(ring), lambda e: F.exists(pieces(line), lambda s: pieces_meet(s["a"], s["b"], e["a"], e["b"]))))
    return in_polygon(F.element_at(line, 1), rings) | touched


def oriented(rings) -> Column:
    """The rings of a polygon with outer ones counter-clockwise and holes clockwise, by how many other rings surround each."""
    rings = F.col(rings) if isinstance(rings, str) else rings

    def turned(ring, i):
        middle = point((ring[0]["x"] + ring[1]["x"]) / 2, (ring[0]["y"] + ring[1]["y"]) / 2)
        depth = F.size(F.filter(rings, lambda other, j: (i != j) & in_ring(middle, other)))
        return F.when((ring_area(ring) > 0) == (depth % 2 == 0), ring).otherwise(F.reverse(ring))

    return F.transform(F.filter(rings, lambda r: F.size(r) > 3), turned)


def polygon_area(rings) -> Column:
    """Area of a polygon whose rings are oriented: holes count negative."""
    return F.aggregate(rings, F.lit(0.0), lambda acc, r: acc + ring_area(r))


def within_ring(line, ring) -> Column:
    """True if all points of a line lie inside a ring (exact for convex rings)."""
    return F.forall(line, lambda p: in_ring(p, ring))


def buffer_ring(p: Column, radius: float, quad_segs: int = 30) -> Column:
    """A disc as a closed ring of 4 * quad_segs corners."""
    n = 4 * quad_segs
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: point(p["x"] + radius * F.cos(2 * F.pi() * (i % n) / n), p["y"] + radius * F.sin(2 * F.pi() * (i % n) / n)))


def capsule_ring(a: Column, b: Column, radius: float, quad_segs: int = 8) -> Column:
    """The points within ``radius`` of a straight piece as a closed counter-clockwise ring, its ends half circles of 2 * quad_segs sides."""
    n = 2 * quad_segs
    along = F.atan2(b["y"] - a["y"], b["x"] - a["x"])

    def half(p, first):
        return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: point(p["x"] + radius * F.cos(along + first + F.pi() * i / n), p["y"] + radius * F.sin(along + first + F.pi() * i / n)))

    ring = F.concat(half(b, -F.pi() / 2), half(a, F.pi() / 2))
    return F.concat(ring, F.array(ring[0]))


def bound_to(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _near_interval(a: Column, b: Column, c: Column, d: Column, r: float) -> Column:
    """struct<lo, hi> of the share of piece a-b within ``r`` of piece c-d, null if none: the parts in two discs and a rectangle make one interval."""
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    wx, wy, zx, zy = a["x"] - c["x"], a["y"] - c["y"], a["x"] - d["x"], a["y"] - d["y"]
    # all that follows is in terms of these products
    base = F.struct(*[x.alias(n) for n, x in (("uu", ux * ux + uy * uy), ("vv", vx * vx + vy * vy), ("uv", ux * vx + uy * vy), ("ux", ux * vy - uy * vx), ("wu", wx * ux + wy * uy), ("ww", wx * wx + wy * wy - r * r), ("zu", zx * ux + zy * uy), ("zz", zx * zx + zy * zy - r * r), ("wv", wx * vx + wy * vy), ("wx", wx * vy - wy * vx))])

    def parts(p):
        def disc(half, rest):
            root = F.sqrt(F.greatest(half * half - p["uu"] * rest, F.lit(0.0)))
            hit = half * half >= p["uu"] * rest
            dot = (p["uu"] == 0) & (rest <= 0)
            return F.when((p["uu"] > 0) & hit, (-half - root) / p["uu"]).when(dot, F.lit(0.0)), F.when((p["uu"] > 0) & hit, (-half + root) / p["uu"]).when(dot, F.lit(1.0))

        def slab(start, slope, low, high):
            """Where low <= start + slope t <= high."""
            always = (slope == 0) & (start >= low) & (start <= high)
            x, y = F.when(slope != 0, (low - start) / slope), F.when(slope != 0, (high - start) / slope)
            return F.when(always, F.lit(float("-inf"))).otherwise(F.least(x, y)), F.when(always, F.lit(float("inf"))).otherwise(F.greatest(x, y))

        reach = r * F.sqrt(p["vv"])
        along, across = slab(p["wv"], p["uv"], F.lit(0.0), p["vv"]), slab(p["wx"], p["ux"], -reach, reach)
        first, second = disc(p["wu"], p["ww"]), disc(p["zu"], p["zz"])
        named = {"c0": first[0], "c1": first[1], "d0": second[0], "d1": second[1], "s0": along[0], "s1": along[1], "t0": across[0], "t1": across[1]}
        return F.struct(*[x.alias(n) for n, x in named.items()], (p["vv"] > 0).alias("wide"))

    def joined(q):
        low, high = F.greatest(q["s0"], q["t0"]), F.least(q["s1"], q["t1"])
        ok = q["wide"] & q["s0"].isNotNull() & q["t0"].isNotNull() & (low <= high)
        return F.struct(F.least(q["c0"], q["d0"], F.when(ok, low)).alias("lo"), F.greatest(q["c1"], q["d1"], F.when(ok, high)).alias("hi"))

    def cut(i):
        return F.when((i["lo"] <= 1) & (i["hi"] >= 0), F.struct(F.greatest(i["lo"], F.lit(0.0)).alias("lo"), F.least(i["hi"], F.lit(1.0)).alias("hi")))

    # the three meet, so together they are one interval: least and greatest leave nulls out
    return bound_to(bound_to(bound_to(base, parts), joined), cut)


def box_within(inner: Column, outer: Column, margin: float) -> Column:
    """True if a box (``bounds``) lies in another one grown by a margin."""
    return (inner["x0"] >= outer["x0"] - margin) & (inner["x1"] <= outer["x1"] + margin) & (inner["y0"] >= outer["y0"] - margin) & (inner["y1"] <= outer["y1"] + margin)


def covered(line, by, tolerance: float, slack: float = 1e-9) -> Column:
    """True if every point of a line is within ``tolerance`` of another line; exact up to rounding.

    The part of a piece near a piece of the other line is an interval in closed form; a
    piece is covered if its intervals, in order, leave no gap.
    """
    line, by = (F.col(x) if isinstance(x, str) else x for x in (line, by))

    def whole(s):
        near = F.filter(F.transform(pieces(by), lambda t: _near_interval(s["a"], s["b"], t["a"], t["b"], tolerance)), lambda i: i.isNotNull())
        end = F.aggregate(F.array_sort(near), F.lit(0.0), lambda reach, i: F.when(i["lo"] <= reach + slack, F.greatest(reach, i["hi"])).otherwise(reach))
        return end >= 1 - slack

    return F.forall(pieces(line), whole)


def ring_area(ring) -> Column:
    """Signed area, positive counter-clockwise."""
    return F.aggregate(pieces(ring), F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2


def ring_centroid(ring) -> Column:
    """Centroid by the shoelace formula; of a ring without area the mean of its corners."""
    area = ring_area(ring)

    def moment(axis):
        return F.aggregate(pieces(ring), F.lit(0.0), lambda acc, s: acc + (s["a"][axis] + s["b"][axis]) * (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]))

    def mean(axis):
        return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[axis]) / F.size(ring)

    return F.when(area != 0, point(moment("x") / (6 * area), moment("y") / (6 * area))).otherwise(point(mean("x"), mean("y")))


def bounds(line) -> Column:
    """struct<x0,y0,x1,y1> around a line."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def snap_to_grid(line, grid: float) -> Column:
    """Every coordinate rounded to a multiple of ``grid``."""
    return F.transform(line, lambda p: point(F.round(p["x"] / grid) * grid, F.round(p["y"] / grid) * grid))


def locate(line, p: Column) -> Column:
    """Share of a line's length at which it is nearest to a point; of several places the first."""
    def step(acc, s):
        a, b = s["a"], s["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / n))).otherwise(F.lit(0.0))
        d = piece_distance(p, a, b)
        return F.struct(F.least(acc["d"], d).alias("d"), F.when(d < acc["d"], acc["run"] + t * F.sqrt(n)).otherwise(acc["at"]).alias("at"), (acc["run"] + F.sqrt(n)).alias("run"))

    zero = F.struct(F.lit(float("inf")).alias("d"), F.lit(0.0).alias("at"), F.lit(0.0).alias("run"))
    return F.aggregate(pieces(line), zero, step, lambda acc: F.when(acc["run"] > 0, acc["at"] / acc["run"]).otherwise(F.lit(0.0)))


def interpolate(line, share) -> Column:
    """The point at a share of a line's length."""
    share = F.lit(share) if not isinstance(share, Column) else share
    target = share * length(line)

    def step(acc, s):
        d = distance(s["a"], s["b"])
        here = acc["p"].isNull() & (acc["run"] + d >= target)
        t = F.when(d > 0, (target - acc["run"]) / d).otherwise(F.lit(0.0))
        p = point(s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"]))
        return F.struct(F.when(here, p).otherwise(acc["p"]).alias("p"), (acc["run"] + d).alias("run"))

    zero = F.struct(F.lit(None).cast(PT).alias("p"), F.lit(0.0).alias("run"))
    return F.aggregate(pieces(line), zero, step, lambda acc: F.coalesce(acc["p"], end_point(line)))


def substring(line, a, b) -> Column:
    """The part of a line between two shares of its length, a <= b."""
    a, b = (F.lit(v) if not isinstance(v, Column) else v for v in (a, b))
    total = length(line)

    def run(acc, s):
        d = acc["run"] + distance(s["a"], s["b"])
        keep = (d > a * total) & (d < b * total)
        return F.struct(F.when(keep, F.concat(acc["pts"], F.array(s["b"]))).otherwise(acc["pts"]).alias("pts"), d.alias("run"))

    zero = F.struct(F.array().cast(LINE).alias("pts"), F.lit(0.0).alias("run"))
    middle = F.aggregate(pieces(line), zero, run, lambda acc: acc["pts"])
    return F.concat(F.array(interpolate(line, a)), middle, F.array(interpolate(line, b)))


def canonical(line) -> Column:
    """The line in the direction whose points sort first, so that reversed lines compare equal."""
    back = F.reverse(line)
    return F.when(line <= back, line).otherwise(back)


def wkt_line(line) -> Column:
    """LINESTRING text."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def parse_wkt_lines(text) -> Column:
    """array<LINE> of a LINESTRING or MULTILINESTRING text, null for other types."""
    text = F.col(text) if isinstance(text, str) else text
    body = F.regexp_replace(F.upper(F.trim(text)), r"^(MULTI)?LINESTRING( Z)?\s*", "")
    parts = F.split(F.regexp_replace(body, r"^\(+|\)+$", ""), r"\)\s*,\s*\(")

    def line(part):
        def pt(pair):
            xy = F.split(F.trim(pair), r"\s+")
            return point(F.element_at(xy, 1).cast("double"), F.element_at(xy, 2).cast("double"))

        return F.transform(F.split(part, ","), pt)

    return F.when(F.upper(F.trim(text)).rlike(r"^(MULTI)?LINESTRING"), F.transform(parts, line))


def _array(line) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in line], np.float64).reshape(-1, 2)


def _points(a: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in a]


def hull_points(pts: np.ndarray) -> np.ndarray:
    """Closed counter-clockwise convex hull by monotone chains."""
    pts = np.unique(pts, axis=0)
    if len(pts) < 3:
        return np.concatenate([pts, pts[:1]])

    def half(points):
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = half(pts), half(pts[::-1])
    return np.array(lower[:-1] + upper)


def wrapped(nested) -> Column:
    """Each inner array in a struct ``r``: Arrow batches of arrays of arrays of unequal lengths have no pandas form."""
    nested = F.col(nested) if isinstance(nested, str) else nested
    return F.transform(nested, lambda x: F.struct(x.alias("r")))


def convex_hull():
    """A function of an array of points: the RING of their convex hull."""

    @F.pandas_udf(LINE)
    def hull(points: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else _points(hull_points(_array(p))) for p in points])

    return hull


def clip_outside(line: np.ndarray, ring: np.ndarray | list[np.ndarray]) -> list[np.ndarray]:
    """The parts of a line outside a ring, or outside a polygon of several rings."""
    rings = ring if isinstance(ring, list) else [ring]
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    d = b - a

    def inside(p):
        up = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[:, 0] + d[:, 0] * (p[1] - a[:, 1]) / d[:, 1]
        return bool((up & (p[0] < x)).sum() % 2)

    out, part = [], []
    for p, q in zip(line, line[1:], strict=False):
        r = q - p
        with np.errstate(divide="ignore", invalid="ignore"):
            det = r[0] * d[:, 1] - r[1] * d[:, 0]
            t = ((a[:, 0] - p[0]) * d[:, 1] - (a[:, 1] - p[1]) * d[:, 0]) / det
            u = ((a[:, 0] - p[0]) * r[1] - (a[:, 1] - p[1]) * r[0]) / det
        cuts = np.unique(np.concatenate([[0.0], t[(det != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)], [1.0]]))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if inside(p + (lo + hi) / 2 * r):
                if len(part) > 1:
                    out.append(np.array(part))
                part = []
            else:
                if not part:
                    part = [p + lo * r]
                part.append(p + hi * r)
    if len(part) > 1:
        out.append(np.array(part))
    return out


def line_minus_ring():
    """A function of (LINE, RING): array<LINE> outside the ring."""

    @F.pandas_udf(MLINE)
    def minus(lines: pd.Series, rings: pd.Series) -> pd.Series:
        out = []
        for line, ring in zip(lines, rings, strict=True):
            if line is None or ring is None:
                out.append(None if line is None else [_points(_array(line))])
            else:
                out.append([_points(x) for x in clip_outside(_array(line), _array(ring))])
        return pd.Series(out)

    return minus


def line_minus_rings():
    """A function of (LINE, array<RING>): array<LINE> outside all rings."""

    @F.pandas_udf(MLINE)
    def minus(lines: pd.Series, rings: pd.Series) -> pd.Series:
        out = []
        for line, own in zip(lines, rings, strict=True):
            parts = [_array(line)]
            for ring in [] if own is None else own:
                ring = _array(ring["r"])
                parts = [x for p in parts for x in clip_outside(p, ring)]
            out.append([_points(x) for x in parts])
        return pd.Series(out)

    return lambda line, rings: minus(line, wrapped(rings))


def line_minus_polygon():
    """A function of (LINE, rings of a polygon): array<LINE> outside it; inside its holes counts as outside."""

    @F.pandas_udf(MLINE)
    def minus(lines: pd.Series, polygons: pd.Series) -> pd.Series:
        out = []
        for line, rings in zip(lines, polygons, strict=True):
            if line is None or rings is None or not len(rings):
                out.append(None if line is None else [_points(_array(line))])
            else:
                out.append([_points(x) for x in clip_outside(_array(line), [_array(r["r"]) for r in rings])])
        return pd.Series(out)

    return lambda line, rings: minus(line, wrapped(rings))


def line_minus_polygons():
    """A function of (LINE, array of polygons): array<LINE> outside all of them."""

    @F.pandas_udf(MLINE)
    def minus(lines: pd.Series, polygons: pd.Series) -> pd.Series:
        out = []
        for line, own in zip(lines, polygons, strict=True):
            parts = [_array(line)]
            for rings in [] if own is None else own:
                rings = [_array(r["r"]) for r in rings["p"]]
                parts = [x for p in parts for x in clip_outside(p, rings)]
            out.append([_points(x) for x in parts])
        return pd.Series(out)

    return lambda line, polygons: minus(line, F.transform(polygons, lambda p: F.struct(wrapped(p).alias("p"))))


def merge_lines(lines: list[np.ndarray]) -> list[np.ndarray]:
    """Join lines at points that exactly two ends share; other lines stay apart."""
    ends: dict[tuple, list[int]] = {}
    for i, x in enumerate(lines):
        for p in (x[0], x[-1]):
            ends.setdefault(tuple(p), []).append(i)
    done, out = set(), []

    def grow(path: np.ndarray) -> np.ndarray:
        while True:
            here = [i for i in ends[tuple(path[-1])]]
            nxt = [i for i in here if i not in done]
            if len(here) != 2 or not nxt:
                return path
            i = nxt[0]
            done.add(i)
            x = lines[i] if tuple(lines[i][0]) == tuple(path[-1]) else lines[i][::-1]
            path = np.concatenate([path, x[1:]])

    for i, x in enumerate(lines):
        if i not in done:
            done.add(i)
            out.append(grow(grow(x)[::-1])[::-1])
    return out


def line_merge():
    """A function of array<LINE>: array<LINE> merged at shared ends."""

    @F.pandas_udf(MLINE)
    def merge(lines: pd.Series) -> pd.Series:
        return pd.Series([[_points(y) for y in merge_lines([_array(x["r"]) for x in own])] for own in lines])

    return lambda lines: merge(wrapped(lines))


def simplify(tolerance: float):
    """A function of LINE: Douglas-Peucker with a tolerance."""

    def reduce(p: np.ndarray) -> np.ndarray:
        keep, stack = np.zeros(len(p), bool), [(0, len(p) - 1)]
        keep[[0, -1]] = True
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            d, q = p[b] - p[a], p[a + 1 : b] - p[a]
            n = d @ d
            t = np.clip(q @ d / n, 0, 1) if n else np.zeros(len(q))
            far = np.linalg.norm(q - t[:, None] * d, axis=1)
            i = int(far.argmax())
            if far[i] > tolerance:
                keep[a + 1 + i] = True
                stack += [(a, a + 1 + i), (a + 1 + i, b)]
        return p[keep]

    @F.pandas_udf(LINE)
    def run(lines: pd.Series) -> pd.Series:
        return pd.Series([_points(reduce(_array(x))) for x in lines])

    return run


def wkb_line():
    """A function of LINE: little-endian well-known binary of a LineString."""

    @F.pandas_udf("binary")
    def write(lines: pd.Series) -> pd.Series:
        def one(line):
            a = _array(line)
            return struct.pack("<BII", 1, 2, len(a)) + a.astype("<f8").tobytes()

        return lines.map(one, na_action="ignore")

    return write


def parse_wkb_lines():
    """A function of binary: array<LINE> of a LineString or MultiLineString in either byte order, with or without Z, M and SRID; null for other types."""

    @F.pandas_udf(MLINE)
    def read(data: pd.Series) -> pd.Series:
        def geometry(b: bytes, at: int):
            order = "<" if b[at] == 1 else ">"
            (kind,) = struct.unpack_from(order + "I", b, at + 1)
            at += 5 + (4 if kind & 0x20000000 else 0)
            width = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
            kind &= 0x0FFFFFFF
            width = max(width, 2 + (kind // 1000 in (1, 3)) + (kind // 1000 in (2, 3)))
            (n,) = struct.unpack_from(order + "I", b, at)
            at += 4
            if kind % 1000 == 2:
                a = np.frombuffer(b, order + "f8", n * width, at).reshape(n, width)[:, :2]
                return [_points(a)], at + 8 * n * width
            if kind % 1000 != 5:
                return None, at
            out = []
            for _ in range(n):
                part, at = geometry(b, at)
                out += part
            return out, at

        return data.map(lambda b: geometry(bytes(b), 0)[0], na_action="ignore")

    return read


def wkt_ring(ring) -> Column:
    """POLYGON text of a closed ring."""
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))


def parse_wkt_ring(text) -> Column:
    """The outer ring of a POLYGON text, null for other types; Z and M values are dropped."""
    text = F.col(text) if isinstance(text, str) else text
    outer = F.regexp_extract(text, r"(?i)^\s*(?:SRID=\d+;)?\s*POLYGON\s*(?:ZM|Z|M)?\s*\(\s*\(([^)]*)\)", 1)
    pts = F.transform(F.split(outer, ","), lambda t: F.split(F.trim(t), r"\s+"))
    return F.when(outer != "", F.transform(pts, lambda p: point(F.element_at(p, 1), F.element_at(p, 2))))


def _wkt_rings(body) -> Column:
    """array<array<LINE>> of the text of a multi-polygon: ``((ring, ring), (ring))`` without its outer brackets."""
    def ring(text):
        return F.transform(F.split(F.regexp_replace(text, r"[()]", ""), ","), lambda p: point(F.element_at(F.split(F.trim(p), r"\s+"), 1), F.element_at(F.split(F.trim(p), r"\s+"), 2)))

    return F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), lambda poly: F.transform(F.split(poly, r"\)\s*,\s*\("), ring))


def parse_wkt_polygon(text) -> Column:
    """The oriented rings of a POLYGON or MULTIPOLYGON text, holes and parts in one list; null for other types."""
    text = F.col(text) if isinstance(text, str) else text
    body = F.regexp_extract(text, r"(?is)^\s*(?:SRID=\d+;)?\s*(?:MULTI)?POLYGON\s*(?:ZM|Z|M)?\s*(\(.*\))\s*$", 1)
    return F.when(body != "", oriented(F.flatten(_wkt_rings(body))))


def wkt_polygon(rings) -> Column:
    """MULTIPOLYGON text of oriented rings whose holes follow their outer ring."""
    rings = F.col(rings) if isinstance(rings, str) else rings
    text = F.transform(rings, lambda r: F.concat(F.when(ring_area(r) > 0, F.lit("), (")).otherwise(F.lit(", ")), F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")")))
    return F.concat(F.lit("MULTIPOLYGON ("), F.substring(F.array_join(text, ""), 4, 1 << 30), F.lit("))"))
