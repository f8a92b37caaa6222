"""Sharding by a histogram sort on a hashed key.

Rows are ordered by a hash of their group (equal texts), so a group is one point
of the key space and never straddles a shard.  Splitters are found by counting:
each round counts the exact bytes below evenly spaced probes in every open
interval, in one aggregation, and narrows the interval, until the bytes below a
splitter are within tolerance of its target.  Then rows are exchanged once.

Groups too heavy for the tolerance are placed first, largest on the emptiest
shard; there are at most ``shards / tolerance`` of them, whatever the input.
The splitter targets are what room they leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waygraph.plans.stages import materialise, table

#: Keys are 62-bit hashes.
SPACE = 1 << 62
PROBES = 256


def _targets(total: int, heavy: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """Shard of each heavy key, and the bytes of light keys each shard is to take."""
    load, place = [0] * shards, {}
    for key, size in heavy:
        s = min(range(shards), key=lambda i: (load[i], i))
        place[key] = s
        load[s] += size
    light = total - sum(load)
    # water filling: shards above the common level take no light bytes
    order = sorted(range(shards), key=lambda i: load[i])
    level, used = 0.0, 0
    for n, i in enumerate(order, 1):
        used += load[i]
        level = (light + used) / n
        if n == shards or level <= load[order[n]]:
            break
    room = [max(0.0, level - x) for x in load]
    ends, seen = [], 0.0
    for r in room:
        seen += r
        ends.append(round(seen))
    return place, ends


def _splitters(light: DataFrame, ends: list[int], slack: float, probes: int) -> list[int]:
    """Keys k_1 <= .. <= k_(n-1): about ends[i] light bytes lie at keys below k_(i+1)."""
    total = ends[-1]
    # per splitter: interval of keys and the bytes below its lower end
    state = [(0, SPACE, 0) for _ in ends[:-1]]
    found: dict[int, int] = {i: 0 for i, t in enumerate(ends[:-1]) if t <= 0}
    found |= {i: SPACE for i, t in enumerate(ends[:-1]) if i not in found and t >= total}
    while len(found) < len(state):
        intervals = sorted({s[:2] for i, s in enumerate(state) if i not in found})
        steps = [max(1, -(-(hi - lo) // probes)) for lo, hi in intervals]
        cell = F.lit(None).cast("long")
        for n in reversed(range(len(intervals))):
            (lo, hi), step = intervals[n], steps[n]
            cell = F.when((F.col("key") >= lo) & (F.col("key") < hi), F.expr(f"{n * probes}L + (key - {lo}L) div {step}L")).otherwise(cell)
        counted = dict(light.select(cell.alias("cell"), "bytes").filter("cell is not null").groupBy("cell").agg(F.sum("bytes")).collect())
        for i, (lo, hi, below) in enumerate(state):
            if i in found:
                continue
            n = intervals.index((lo, hi))
            at, best, cut = below, None, (lo, hi, below)
            for c in range(probes):
                start = lo + c * steps[n]
                if start >= hi:
                    break
                inside = counted.get(n * probes + c, 0)
                end = min(hi, start + steps[n])
                if at <= ends[i] <= at + inside:
                    best = (start, at) if ends[i] - at <= at + inside - ends[i] else (end, at + inside)
                    cut = (start, end, at)
                    break
                at += inside
            if best is None:
                found[i] = hi
            elif abs(best[1] - ends[i]) <= slack or steps[n] == 1:
                found[i] = best[0]
            else:
                state[i] = cut
    return [found[i] for i in range(len(state))]


def shard_by_bytes(docs: DataFrame, shards: int = 8, group: str = "text", row: str = "doc_id", size: Column | None = None, tolerance: float = 0.01, probes: int = PROBES) -> DataFrame:
    """All columns of ``docs`` with ``shard`` (0..shards-1) and ``slot`` (gapless from 0 per shard).

    Shards get near equal sums of ``size`` (default: UTF-8 bytes of the group
    text plus 1, null text 0 plus 1) and rows with equal ``group`` share a shard;
    a group larger than a fair share fills its shard alone.  Null is a group of
    its own.  Rows that repeat are placed side by side; long texts are only measured
    and moved; an empty table gives an empty result.  Columns of ``docs`` named
    ``shard`` or ``slot`` are replaced.  Work: one pass for keys, thin counting
    rounds, one exchange of the rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(group), F.lit(0)).cast("long") + 1 if size is None else size
    docs = docs.drop("shard", "slot")
    key = F.shiftrightunsigned(F.xxhash64(F.col(group)), 2)
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(row)), 2)
    parts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    thin = materialise(docs.select(key.alias("key"), spread.alias("spread"), size.alias("bytes")), "shard-keys")
    keys = materialise(thin.groupBy("key").agg(F.sum("bytes").alias("bytes")), "shard-groups")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    slack = tolerance * total / shards / 4
    heavy = [(r["key"], r["bytes"]) for r in keys.filter(F.col("bytes") > slack).orderBy(F.desc("bytes"), "key").collect()]
    place, ends = _targets(total, heavy, shards)
    light = keys.filter(F.col("bytes") <= slack)
    splitters = _splitters(light, ends, slack, probes)

    edges = [0, *splitters, SPACE]
    names = spark.createDataFrame([(k, s) for k, s in place.items()] or [(-1, 0)], "hkey long, hshard int")

    def placed(df: DataFrame) -> DataFrame:
        """Adds shard and the part of the shard: a key range, or for heavy keys a range of the rows' own hashes."""
        df = df.join(F.broadcast(names), F.col("key") == F.col("hkey"), "left")  # at most shards / tolerance * 4 rows
        shard, part = F.lit(shards - 1), F.lit(0).cast("long")
        for s in reversed(range(shards)):
            lo, hi = edges[s], edges[s + 1]
            shard = F.when(F.col("key") < hi, F.lit(s)).otherwise(shard)
            width = max(1, -(-(hi - lo) // parts))
            part = F.when(F.col("key") < hi, F.expr(f"(key - {lo}L) div {width}L")).otherwise(part)
        wide = max(1, -(-SPACE // parts))
        df = df.withColumn("shard", F.coalesce(F.col("hshard"), shard).cast("int"))
        part = F.when(F.col("hshard").isNotNull(), F.expr(f"spread div {wide}L")).otherwise(part)
        return df.withColumn("bucket", (F.col("shard") * parts + part).cast("int")).drop("hkey", "hshard")

    counts = placed(thin).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = docs.columns
    rows = placed(docs.select(F.struct(*own).alias("doc"), key.alias("key"), spread.alias("spread")))
    rows = rows.repartition(shards * parts, "bucket")
    order = [F.col("key"), F.col("spread"), F.col(f"doc.{row}")]
    rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)))
    rows = rows.join(F.broadcast(base), rows["bucket"] == base["b"])  # shards * parts rows
    return rows.select("doc.*", "shard", (F.col("base") + F.col("_row") - 1).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents into shards 0 to 7 of near equal bytes, equal texts together."""
    out = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    body = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
