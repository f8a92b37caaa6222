"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets are the weighted shares of a word budget, each stopped at ``most`` times
its source's size and the excess shared again by weight.  The budget is cut into
blocks of equal words, and blocks are awarded to sources by highest quotients
target / (2 seats + 1).  The divisor rule is house-monotone: the award after the
blocks of output shards 0..k minus that after 0..k-1 is the integer quota of each
source in shard k.  A source's documents are laid end to end in an order drawn by
a seed, and its blocks are dealt from a seeded start, turn after turn: each output
shard takes the blocks of its own quota where the shard before it stopped.  All of this is DataFrame expressions: awards are found from a
divisor that provably gives too few seats and a highest-quotient step over about
three candidates per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waygraph.llm.common import parts_for, ranked
from waygraph.plans.stages import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Words in a block.
BLOCK = 32
#: Least parts of a source whose rows are summed apart.
SALTS = 256
SEED = "mix-1"


def _seeded(*columns) -> F.Column:
    """A 60-bit number drawn from the seed and the columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *columns)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``src, source_size, target`` from a table with one row per source.

    Sources in code-point order, null last, weigh ``weights`` in turn.  The level
    at which targets stop is found in closed form: sources sorted by most*size/weight
    stop one after the other, and the first that does not fixes the level.  One
    window over the sources; their number is that of rows here, not of documents.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("n") % len(weights)).cast("int") + 1)
    t = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("src").isNull(), "src")) - 1).withColumn("w", w)
    t = t.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("turn", F.col("cap") / F.col("w"))
    by = Window.orderBy("turn", "n")
    everything = Window.partitionBy()
    t = t.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share)).withColumn("all_w", F.sum("w").over(everything))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    t = t.withColumn("final", F.min(F.when(F.col("level") <= F.col("turn"), F.struct("turn", "n", "level"))).over(everything)["level"])
    return t.select("src", "n", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("w"))).alias("target"))


def quotas(targets: DataFrame, most: float = 2.0, block: int = BLOCK, shards: int = 1) -> DataFrame:
    """``src, shard, seats``: blocks of each source in each output shard, by Sainte-Lague.

    With s sources and a house of N seats, the divisor (N - s/2)/W awards at most
    N and at least N - s seats, so at most s remain; a source of target t gains at
    most s*t/W + 1 of them, and only that many next quotients are compared.
    A source never gets more seats than ``most`` times its blocks.
    """
    everything = Window.partitionBy()
    t = targets.withColumn("s", F.count(F.lit(1)).over(everything)).withColumn("W", F.sum("target").over(everything))
    t = t.withColumn("top", F.ceil(F.col("source_size") / block) * F.lit(most)).withColumn("top", F.floor("top").cast("long")).withColumn("total", F.round(F.col("W") / block).cast("long"))
    t = t.crossJoin(targets.sparkSession.range(1, shards + 1).select(F.col("id").alias("k")))  # sources times output shards
    t = t.withColumn("house", F.expr(f"total * k div {shards}"))
    divisor = F.greatest(F.lit(0.0), (F.col("house") - F.col("s") / 2) / F.col("W"))
    t = t.withColumn("base", F.when(F.col("W") > 0, F.least(F.col("top"), F.floor(F.col("target") * divisor + 0.5).cast("long"))).otherwise(F.lit(0).cast("long")))
    t = t.withColumn("left", F.col("house") - F.sum("base").over(Window.partitionBy("k")))
    more = F.least(F.col("top") - F.col("base"), F.when(F.col("W") > 0, F.floor(F.col("s") * F.col("target") / F.col("W")).cast("long") + 2).otherwise(F.lit(0).cast("long")))
    c = t.filter(more > 0).select("n", "k", "left", "target", F.explode(F.sequence(F.col("base"), F.col("base") + more - 1)).alias("have"))
    c = c.withColumn("q", F.col("target") / (2 * F.col("have") + 1))
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("q"), "n", "have"))).filter("place <= left")
    won = c.groupBy("n", "k").agg(F.count(F.lit(1)).alias("won"))
    t = t.join(won, ["n", "k"], "left").withColumn("upto", F.col("base") + F.coalesce("won", F.lit(0)))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("n").orderBy("k")), F.lit(0))
    return t.select("src", "n", (F.col("k") - 1).cast("int").alias("shard"), (F.col("upto") - before).alias("seats"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shards: int = 8, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, shard_taken``, one row per row of ``docs``.

    ``shard_taken`` holds the words that each output shard takes, by the source's quota
    in it, and ``taken`` is their sum.  Null text has size 0; null is a source of its own, last in order.  Rows that
    repeat are documents of their own, next to each other in the seeded order.
    An empty table gives an empty result; if all sizes are 0 all targets are 0.
    Very long texts are only counted.  Other columns are not read.
    """
    return _taken(docs, share, most, weights, block, shards, doc_id, source, text).select("doc_id", "source", "size", "source_size", "target", "taken", "shard_taken")


def _taken(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shards: int = 8, doc_id: str = "doc_id", source: str = "source", text: str = "text", more: tuple = ()) -> DataFrame:
    """The rows of ``mix`` with further columns of ``docs`` carried along."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("src"), size.alias("size"), _seeded(F.col(doc_id).cast("string"), F.xxhash64(F.col(text)).cast("string")).alias("draw"), *more)
    d = materialise(d, "mix-sizes")
    d = d.withColumn("part", (F.col("draw") % parts_for(d.count(), SALTS)).cast("int"))
    more = tuple(d.columns[4:-1])
    parts = materialise(d.groupBy("src", "part").agg(F.sum("size").alias("words")), "mix-parts")
    targets = materialise(source_targets(parts.groupBy("src").agg(F.sum("words").alias("source_size")), share, most, weights), "mix-targets")
    own = quotas(targets, most, block, shards).groupBy("n").agg(F.sort_array(F.collect_list(F.struct("shard", "seats"))).alias("own"))
    plan = targets.join(own, "n").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    # the first shard starts at a seeded block, the next where it stops, turn after turn
    plan = plan.withColumn("start", F.when(F.col("blocks") > 0, F.pmod(_seeded(F.lit("start"), F.coalesce(F.concat(F.lit("s"), F.col("src")), F.lit("n"))), F.col("blocks"))).otherwise(F.lit(0)))
    cuts = F.transform(F.sequence(F.lit(0), F.lit(shards)), lambda k: F.col("start") + F.aggregate(F.slice("own", F.lit(1), k), F.lit(0).cast("long"), lambda x, y: x + y["seats"]))
    plan = plan.withColumn("cuts", cuts)
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumnRenamed("src", "s1")
    base = base.join(plan, base["s1"].eqNullSafe(plan["src"])).select(F.col("s1"), F.col("part").alias("p1"), "base", "source_size", "target", "cuts", "blocks")
    run = Window.partitionBy("src", "part").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(run), F.lit(0)))
    d = d.join(base, d["src"].eqNullSafe(base["s1"]) & (d["part"] == base["p1"]))
    lo = F.col("base") + F.col("within")
    hi = lo + F.col("size")

    def words(blocks_taken):
        """Words of the document in so many blocks of its source's line, laid out turn after turn."""
        turns = F.floor(blocks_taken / F.greatest(F.col("blocks"), F.lit(1)))
        rest = (blocks_taken - turns * F.col("blocks")) * block
        return turns * F.col("size") + F.greatest(F.lit(0), F.least(hi, rest) - lo)

    upto = F.transform("cuts", words)
    d = d.withColumn("_upto", upto)
    by_shard = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: (F.get("_upto", k) - F.get("_upto", k - 1)).cast("long"))
    taken = (F.element_at("_upto", -1) - F.get("_upto", F.lit(0))).cast("long")
    return d.select("doc_id", F.col("src").alias("source"), "size", "source_size", "target", taken.alias("taken"), by_shard.alias("shard_taken"), *more)


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in whole documents.

    A document that the mix takes in part, at most two of a source's run, is taken
    whole or not: of the choices for a source the one whose words come nearest to
    its target counts.  Texts without words are not taken.  Rows that share
    doc_id, source and text differ in nothing that the mix sees: what it takes of
    them in all is dealt over them evenly.  Null text is empty, null a source of
    its own, an empty table gives an empty result; columns named like the mix's
    own stay as they are.
    """
    keys = ["_id", "_src", "_sha"]
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    t = materialise(_taken(docs, more=(sha.alias("_sha"),)).filter("size > 0"), "mix-taken")
    # rows alike become one, with their number, before anything is decided
    t = t.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), "_sha").agg(F.count(F.lit(1)).alias("_n"), F.first("size").alias("size"), F.first("target").alias("target"), F.sum("taken").alias("taken"))
    t = materialise(t.withColumn("whole", F.expr("taken div size")).withColumn("part", F.expr("taken % size")), "mix-taken")
    cut = F.collect_list(F.when(F.col("part") > 0, F.struct("size", "_id", "_sha")))  # the two ends of the run
    ends = t.groupBy("_src").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("target"), F.array_sort(cut).alias("ends"))
    choices = F.transform(F.sequence(F.lit(0), F.pow(2, F.size("ends")).cast("int") - 1), lambda c: F.struct(F.abs(F.col("sure") + F.aggregate(F.transform("ends", lambda e, i: e["size"] * (F.floor(c / F.pow(2, i)).cast("long") % 2)), F.lit(0).cast("long"), lambda x, y: x + y) - F.col("target")).alias("off"), c.alias("c")))
    ends = ends.withColumn("c", F.array_min(choices)["c"])
    more = ends.select("_src", F.posexplode("ends").alias("i", "e"), "c").filter(F.floor(F.col("c") / F.pow(2, F.col("i"))).cast("long") % 2 == 1)
    more = more.select(*[F.col(x).alias(f"m{y}") for x, y in (("e._id", "_id"), ("_src", "_src"), ("e._sha", "_sha"))])
    more = more.withColumn("up", F.lit(1))
    t = t.join(more, [t[k].eqNullSafe(more[f"m{k}"]) for k in keys], "left")
    t = materialise(t.select(*keys, "_n", (F.col("whole") + F.coalesce("up", F.lit(0))).alias("_all")).filter("_all > 0"), "mix-times")

    own = docs.columns
    rows = docs.withColumn("_sha", sha)

    def met(these: DataFrame) -> DataFrame:
        names = these.select(*[F.col(k).alias(f"t{k}") for k in keys], "_n", "_all")
        return rows.join(names, rows["doc_id"].eqNullSafe(names["t_id"]) & rows["source"].eqNullSafe(names["t_src"]) & (rows["_sha"] == names["t_sha"]))

    def copies(df: DataFrame) -> DataFrame:
        return df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*own)

    out = copies(met(t.filter("_n = 1")).withColumn("_times", F.col("_all")))
    several = t.filter("_n > 1")
    if several.limit(1).count():
        many = met(several).withColumn("_place", F.monotonically_increasing_id())
        many = ranked(many, ["t_id", "t_src", "t_sha"], [F.col("_place")], F.xxhash64("_place"), parts_for(docs.count()))
        many = many.withColumn("_times", F.expr("_all div _n") + (F.col("rank") < F.expr("_all % _n")).cast("long")).filter("_times > 0")
        out = out.unionByName(copies(many))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard_taken")
