"""Near duplicates by SimHash, with candidates from a pigeonring filter.

A fingerprint is a ring of four segments of 16 bits.  If two differ in at most three
bits, some segment starts a chain of which every prefix of l segments differs in at most
3 l / 4 bits: none in the first, at most one in two, at most two in three, three in all.
(If every start failed, the ring could be covered by chains above their budgets.)

So for each start the budgets of the chain say which bits must be equal: the start, and
by the pigeonhole principle one of two halves of the second segment; of the bits of the
second and third that are left, with two differences at most, one of three parts; of what
is then left one of four parts, and so on.  Each such choice is a mask; two linked
fingerprints are equal under one mask of every level, each mask a part of the last.
Buckets of equal masked bits are joined by an equi-join, the chain is checked, then the
Hamming distance.

Pairs of a bucket are never listed in full.  Every member is first compared with the
bucket's most copied member.  Then only buckets that still hold several components are
looked at, and there only members outside the largest component meet the others.  If that
would be more than ``PAIRS`` comparisons the bucket is dealt over the masks of the next
level, which misses no link.  Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import bounded_batches, join_groups
from waygraph.operators.components import connected_components
from waygraph.plans.stages import materialise, release, table

WORDS, SEED, DIFFER = 3, 42, 3
#: Comparisons in one bucket beyond which it is dealt over the next level.
PAIRS = 200_000
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint_of(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a whole text: bytes.lower and bytes.split know ASCII letters and ASCII white space only."""
    found = text.encode("utf-8").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(1, len(found) - words + 1)
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([digest(line[i:j], seed) for i, j in zip(first[k : k + BLOCK], last[k : k + BLOCK], strict=True)], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long) of every row of ``docs``."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), of(F.coalesce(F.col(text), F.lit(""))).alias("fp"))


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` in ``parts`` runs of nearly equal length."""
    at = [len(bits) * k // parts for k in range(parts + 1)]
    return [bits[i:j] for i, j in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=8)
def masks(level: int) -> tuple[tuple[int, int, int, tuple], ...]:
    """(mask, start, number of the mask it extends, bits it leaves open in order of the chain) of a level from 1."""
    segment = [list(range(16 * s, 16 * s + 16)) for s in range(4)]
    out = []
    if level == 0:
        for s in range(4):
            ring = [b for k in (1, 2, 3) for b in segment[(s + k) % 4]]
            out.append((sum(1 << b for b in segment[s]), s, -1, tuple(ring)))
        return tuple(out)
    for number, (mask, s, _, rest) in enumerate(masks(level - 1)):
        # the chain allows 1 difference in the second segment, 2 in the second and third, 3 in all
        head, allowed = (16, 1) if level == 1 else (24, 2) if level == 2 else (len(rest), 3)
        for part in _cut(list(rest[:head]), allowed + 1):
            out.append((mask | sum(1 << b for b in part), s, number, tuple(b for b in rest if b not in part)))
    return tuple(out)


#: The last level; beyond it at most 2^14 fingerprints share a bucket.
LAST = 6


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def _chained(a: str, b: str, start: str) -> Column:
    """The chain from segment ``start`` keeps its budgets; the whole of it is the Hamming test."""
    x = F.col(a).bitwiseXOR(F.col(b))

    def of(start: int) -> Column:
        seen, ok = 0, F.lit(True)
        for length in range(1, 5):
            s = (start + length - 1) % 4
            seen |= 0xFFFF << 16 * s
            ok &= F.bit_count(x.bitwiseAND(_signed(seen))) <= length * DIFFER // 4
        return ok

    out = of(3)
    for s in range(3):
        out = F.when(F.col(start) == s, of(s)).otherwise(out)
    return out


def _posted(nodes: DataFrame, level: int) -> DataFrame:
    """``nodes`` (fp, ..) with ``mask, start, key`` of the masks of a level; a column ``up`` names the mask to extend."""
    table = [(k, s, up, m - (1 << 64) if m >> 63 else m) for k, (m, s, up, _) in enumerate(masks(level))]
    own = nodes.sparkSession.createDataFrame(table, "mask int, start int, up int, bits long")  # 8 rows at level 1, 6,144 at the last
    rows = nodes.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(3)))) if "up" not in nodes.columns else nodes
    return rows.join(F.broadcast(own), "up").select("fp", "copies", "mask", "start", F.col("fp").bitwiseAND(F.col("bits")).alias("key"))


def links_of(nodes: DataFrame, pairs: int = PAIRS, level: int = 1) -> DataFrame:
    """Edges ``a, b`` over fingerprints (``fp``, distinct, with ``copies``) whose components are those of all links.

    Not every link is an edge: one within a component that others already join may
    be left out.  No two linked fingerprints end in different components.
    """
    members = materialise(_posted(nodes, level), "simhash-buckets")
    links = None
    bucket = ["mask", "key"]
    while True:
        # the most copied member of each bucket of several meets the others
        sizes = materialise(members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("copies", "fp")).alias("top")).filter("n > 1").select("mask", "key", "n", F.col("top.fp").alias("hub")), "simhash-sizes")
        met = materialise(_bucketed(members, sizes), "simhash-members")
        release(members, sizes)
        stars = met.filter((F.col("fp") != F.col("hub")) & _chained("fp", "hub", "start")).select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()
        links = materialise(stars if links is None else links.unionByName(stars), "simhash-links")
        parts = connected_components(links, "a", "b")
        m = met.join(parts.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        m = materialise(m.select("fp", "copies", "mask", "start", "key", "component"), "simhash-classes")
        release(met)
        # counts of components in a bucket; only buckets of several go on
        held = m.groupBy(*bucket, "component").agg(F.count(F.lit(1)).alias("c"))
        facts = held.groupBy(*bucket).agg(F.count(F.lit(1)).alias("classes"), F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("most")).filter("classes > 1")
        facts = facts.select("mask", "key", "n", F.col("most.component").alias("largest"), ((F.col("n") - F.col("most.c")) * F.col("n")).alias("work"))
        facts = materialise(facts, "simhash-open")
        now = materialise(_bucketed(m, facts), "simhash-open-members")
        release(m, facts)
        small = now if level == LAST else now.filter(F.col("work") <= pairs)
        x = small.filter("component <> largest").select(*bucket, "start", F.col("fp").alias("x"), F.col("component").alias("cx"))
        y = small.select(*bucket, F.col("fp").alias("y"), F.col("component").alias("cy"))
        found = x.join(y, bucket).filter((F.col("cx") != F.col("cy")) & _chained("x", "y", "start")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        old, links = links, materialise(links.unionByName(found), "simhash-links")
        release(old)
        rest = now.filter(F.col("work") > pairs).select("fp", "copies", F.col("mask").alias("up"))
        if level == LAST or rest.isEmpty():
            return links
        level += 1
        members = materialise(_posted(rest, level), "simhash-buckets")


def _bucketed(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Members with the facts of their bucket; the rows of a large bucket stay where they are."""
    total = facts.agg(F.sum("n")).first()[0] or 0
    key = F.struct("mask", "key")
    return join_groups(members.withColumn("bucket", key), facts.select(key.alias("bucket"), *[c for c in facts.columns if c not in ("mask", "key")]), "bucket", "n", total).drop("bucket")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, pairs: int = PAIRS) -> DataFrame:
    """Return ``doc_id, fp, component_id, copies``, one row per row of ``docs``.

    Texts are read whole; null text counts as empty, and texts without words have the
    fingerprint zero, linked like any other.  The component id is the smallest
    doc_id that links reach; rows with null ids take part and never name a component
    unless all of its ids are null.  ``copies`` counts the rows of the fingerprint.
    Repeated ids are rows of their own texts.  An empty table gives an empty result;
    other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = materialise(fingerprints(docs, doc_id, text, words), "simhash")
    nodes = materialise(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")), "simhash-nodes")
    links = links_of(nodes.select("fp", "copies"), pairs)
    parts = connected_components(links, "a", "b").withColumnRenamed("id", "fp")
    named = materialise(nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-named")
    per = materialise(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-components")
    known = materialise(join_groups(named.select("fp", "copies", "component"), per, "component", "n", per.agg(F.sum("n")).first()[0] or 0).select("fp", "copies", "component_id"), "simhash-groups")
    total = known.agg(F.sum("copies")).first()[0] or 0
    return join_groups(rows, known, "fp", "copies", total).select("doc_id", "fp", "component_id", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: fingerprints and components of all documents."""
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
