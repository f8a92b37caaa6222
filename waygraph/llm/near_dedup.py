"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Equal texts are one node.  A node is a weighted set of five-word shingles, with
weight tf * idf; its signature is 64 consistent weighted samples, cut into 16
bands of 4.  Nodes that agree on a band are candidates; candidates are verified
by weighted Jaccard similarity of their whole texts, 0.8 or more, and linked.
Classes are the connected components.

Document frequencies are exact and over all distinct texts.  Idf saturates at a
share ``RARE``: rarer shingles share the largest weight, so only the shingles above
it need a table, of at most (mean shingles of a text) / RARE rows.  They are found
in two passes: a shingle that frequent overall is that frequent in some batch, so
batches propose and a second pass counts exactly.

Pairs of a bucket are never listed in full.  Every member is compared with the
bucket's most central member, the one whose other buckets are fullest, which in a
family of edited copies is the original.  Then, only in buckets that still hold
several classes, members of different classes are compared: directly if the
bucket is small; in a large one with the most central member outside the first
one's class, and directly within the small buckets of ``DEEP`` further hashes, each
of ``DEPTH`` of the samples.  These only join classes early.  What is then left, the
members of large buckets that still hold several classes, is compared across
classes by an exact prefix filter: two sets of similarity t share an element
within the first 1 - t of their weight, in any fixed order, and at the first one
the weight left to the lighter rest is at least t / (1 + t) of both weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import bounded_batches, join_groups, maybe_in, one_of_each
from waygraph.operators.components import connected_components
from waygraph.plans.stages import materialise, table

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
#: Share of texts from which a shingle's idf falls below its largest value.
RARE = 0.01
#: Members up to which the classes of a bucket are compared directly.
SMALL = 32
#: Further hashes of members of large buckets, and the samples in each.
DEEP, DEPTH = 48, 12
#: Samples of 64 that a pair must share before its texts are compared; similarity 0.8 gives 51 on average, with deviation 3.2.
AGREE = 36
#: Bits of an entry's number in the table of random draws.
DRAWS = 20
#: Shingles proposed in one counting pass, and entries of the order of the prefix filter.
PROPOSED, ORDERED = 500_000, 1_000_000
#: Rows of one prefix shingle that meet in a task.
HOT = 1000

_U = np.uint64
_POW = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, _U))


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, their counts, and where each text starts.

    Words are runs of bytes above 32.  A text of fewer words is one shingle, a
    text without words the same one shingle.
    """
    hashes, counts, sizes = [], [], []
    for t in texts:
        data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        on = data > 32
        first = np.flatnonzero(on & ~np.concatenate(([False], on[:-1]))) if len(on) else np.empty(0, int)
        if len(first):
            word = np.cumsum(np.bincount(first, minlength=len(data))) - 1  # the word of each byte, or the one before
            pos = np.arange(len(data)) - first[np.maximum(word, 0)]
            value = np.where(on, (data.astype(_U) + _U(1)) * _POW[pos & 255], _U(0))
            h = _mix(np.add.reduceat(value, first) + _U(0x9E37))
            n = max(1, len(h) - words + 1)
            s = np.zeros(n, _U)
            for i in range(min(words, len(h))):
                s = s * _U(0x100000001B3) + h[i : i + n]
            s = _mix(s)
        else:
            s = np.zeros(1, _U)
        u, c = np.unique(s, return_counts=True)
        hashes.append(u)
        counts.append(c)
        sizes.append(len(u))
    starts = np.cumsum([0, *sizes[:-1]]) if sizes else np.empty(0, int)
    return (np.concatenate(hashes), np.concatenate(counts), starts) if sizes else (np.empty(0, _U), np.empty(0, int), starts)


class Idf:
    """Idf of every shingle, in (0, 1]: exact for those of at least ``RARE`` of the texts, 1 for the rest."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, total: int, rare: float = RARE):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        share = np.maximum(df[order] / max(1, total), rare)
        self.values = (1 - np.log(share)) / (1 - np.log(rare))

    def weights(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = counts.astype(np.float64)
        if len(self.hashes):
            i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[i] == hashes
            w[hit] *= self.values[i[hit]]
        return w


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two (ascending hashes, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 1.0


class Sampler:
    """Improved consistent weighted sampling with draws (r, c, beta) from a table indexed by shingle and sample.

    For weight w:  t = floor(ln w / r + beta),  ln a = ln c - r (t - beta) - r;  the
    element of the smallest a and its t are the sample.  r and c are Gamma(2, 1),
    beta is uniform.  The table has 2^DRAWS entries, so shingles of a text of about
    a million words share draws; equal values of a go to the smallest hash, alike
    in every text.  This shifts estimates a little, and texts are verified anyway.
    """

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 7):
        g = np.random.default_rng(seed)
        n = 1 << DRAWS
        self.r = g.gamma(2.0, 1.0, n).astype(np.float32)
        self.c = np.log(g.gamma(2.0, 1.0, n)).astype(np.float32)
        self.beta = g.random(n).astype(np.float32)
        self.odd = g.integers(0, 1 << 63, samples, dtype=np.uint64) * _U(2) + _U(1)
        self.one = self._sortable(self.c + self.r * (self.beta - 1))  # of weight 1, where t = 0

    @staticmethod
    def _sortable(a: np.ndarray) -> np.ndarray:
        """Floats as integers of the same order, in the upper half of 64 bits."""
        b = a.astype(np.float32).view(np.uint32)
        return np.where(b >> 31, ~b, b | np.uint32(1 << 31)).astype(_U) << _U(32)

    def sign(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of samples for each set."""
        out = np.empty((len(starts), len(self.odd)), _U)
        index = np.arange(len(hashes), dtype=_U)
        other = np.flatnonzero(weights != 1.0)
        lw = np.log(weights[other]).astype(np.float32)
        for k, odd in enumerate(self.odd):
            at = (hashes * odd) >> _U(64 - DRAWS)
            key = self.one[at] | index
            if len(other):
                o = at[other]
                t = np.floor(lw / self.r[o] + self.beta[o])
                key[other] = self._sortable(self.c[o] - self.r[o] * (t - self.beta[o] + 1)) | index[other]
            chosen = (np.minimum.reduceat(key, starts) & _U(0xFFFFFFFF)).astype(np.int64)
            t = np.zeros(len(chosen), np.int64)
            odd_ones = np.flatnonzero(weights[chosen] != 1.0)
            if len(odd_ones):
                o = at[chosen[odd_ones]]
                t[odd_ones] = np.floor(np.log(weights[chosen[odd_ones]]).astype(np.float32) / self.r[o] + self.beta[o])
            out[:, k] = _mix(hashes[chosen] + t.view(_U) * _U(0xD6E8FEB86659FD93))
        return out


def _blocks(bodies: list[str], most: int = 1 << 20):
    """Consecutive parts of about ``most`` characters."""
    part, held = [], 0
    for t in bodies:
        if part and held + len(t) > most:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def frequent_shingles(texts: DataFrame, total: int, rare: float = RARE, words: int = WORDS) -> Idf:
    """Exact document frequencies of the shingles in at least ``rare`` of the texts (column ``body``).

    A batch of many texts proposes what is that frequent in it.  A task with so few texts that
    this would be every shingle hands on its counts instead, and those are judged together: what is
    frequent overall is frequent in a batch that proposes, or in all the small ones taken as one.
    """

    def propose(batches):
        held: list[np.ndarray] = []

        def emit(parts):
            u, c = np.unique(np.concatenate(parts), return_counts=True)
            least = max(1, int(np.ceil(rare * len(parts))))
            few = least < 2
            out = pd.DataFrame({"h": u[c >= least].view(np.int64), "n": c[c >= least], "few": few}).astype({"h": "Int64"})
            return pd.concat([out, pd.DataFrame({"h": pd.array([None], "Int64"), "n": [len(parts)], "few": [True]})]) if few else out

        for b in batches:
            for block in _blocks(b["body"].tolist()):
                h, _, starts = shingle_sets(block, words)
                held += np.split(h, starts[1:])
            if len(held) >= 2000:  # the last thousand wait, so that no batch but a lone one is small
                yield emit(held[:1000])
                held = held[1000:]
        if held:
            yield emit(held)

    counts = materialise(texts.select("body").mapInPandas(propose, "h long, n long, few boolean").groupBy("h", "few").agg(F.sum("n").alias("n")), "proposed")
    texts_of_few = counts.filter("h is null").agg(F.sum("n")).first()[0] or 0
    proposed = counts.filter("h is not null").filter(~F.col("few") | (F.col("n") >= rare * texts_of_few)).select("h").distinct()
    slices = max(1, -(-proposed.count() // PROPOSED))
    spark, found = texts.sparkSession, []
    for k in range(slices):
        own = proposed.filter(F.pmod(F.xxhash64("h"), F.lit(slices)) == k)
        names = spark.sparkContext.broadcast(np.sort(own.toPandas()["h"].to_numpy(np.int64).view(_U)))  # about PROPOSED at most

        def count(batches, names=names):
            known = names.value
            for b in batches:
                sums = np.zeros(len(known), np.int64)
                for block in _blocks(b["body"].tolist()):
                    h, _, _ = shingle_sets(block, words)
                    if len(known):
                        i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        sums += np.bincount(i[known[i] == h], minlength=len(known))
                hit = np.flatnonzero(sums)
                yield pd.DataFrame({"h": known[hit].view(np.int64), "n": sums[hit]})

        counted = texts.select("body").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        found.append(counted.filter(F.col("n") >= rare * total).toPandas())  # at most mean set size / rare
    f = pd.concat(found)
    return Idf(f["h"].to_numpy(np.int64).view(_U), f["n"].to_numpy(np.int64), total, rare)


def signatures(nodes: DataFrame, idf, words: int = WORDS) -> DataFrame:
    """``node, keys, sketch``: a hash for each band, and 16 bits of each sample."""

    def sign(batches):
        sampler = Sampler()
        for b in batches:
            keys, sketches = [], []
            for block in _blocks(b["body"].tolist()):
                h, c, starts = shingle_sets(block, words)
                s = sampler.sign(h, idf.value.weights(h, c), starts)
                sketches += [row.tobytes() for row in (s & _U(0xFFFF)).astype("<u2")]
                k = s.reshape(len(starts), BANDS, ROWS)
                band = np.zeros((len(starts), BANDS), _U)
                for r in range(ROWS):
                    band = _mix(band * _U(0x100000001B3) + k[:, :, r])
                keys += list(band.view(np.int64))
            yield pd.DataFrame({"node": b["node"], "keys": keys, "sketch": sketches})

    return nodes.select("node", "body").mapInPandas(sign, "node long, keys array<long>, sketch binary")


def _agree(pairs: DataFrame, sketches: DataFrame, agree: int = AGREE) -> DataFrame:
    """The pairs (a, b) whose signatures share enough samples."""
    x = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    y = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))

    @F.pandas_udf("boolean")
    def enough(p: pd.Series, q: pd.Series) -> pd.Series:
        if not len(p):
            return pd.Series([], dtype=bool)
        u, v = (np.frombuffer(b"".join(map(bytes, s)), "<u2").reshape(len(s), -1) for s in (p, q))
        return pd.Series((u == v).sum(axis=1) >= agree)

    return pairs.join(x, "a").join(y, "b").filter(enough("sa", "sb")).select("a", "b")


def _texts_of(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``nodes`` whose node is in ``ids``; a bitmap of fixed size keeps most others out of the shuffle."""
    return maybe_in(nodes, ids, "node").filter("_maybe").drop("_maybe").join(ids, "node", "left_semi")


def _verified(pairs: DataFrame, nodes: DataFrame, idf, similar: float = SIMILAR, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar."""
    pairs = materialise(pairs, "pairs")
    # hubs repeat in a, so each side is made distinct before they meet
    ids = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()
    own = materialise(_texts_of(ids, nodes), "pair-texts", "zstd")
    joined = pairs.join(own.select(F.col("node").alias("a"), F.col("body").alias("ta")), "a").join(own.select(F.col("node").alias("b"), F.col("body").alias("tb")), "b")

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series, ta: pd.Series, tb: pd.Series) -> pd.Series:
        kept: dict[int, tuple] = {}

        def features(n, t):
            if n not in kept:
                if len(kept) > 200:
                    kept.clear()
                h, c, _ = shingle_sets([t], words)
                kept[n] = (h, idf.value.weights(h, c))
            return kept[n]

        return pd.Series([weighted_jaccard(features(i, x), features(j, y)) for i, j, x, y in zip(a, b, ta, tb, strict=True)], dtype="float64")

    return joined.filter(similarity("a", "b", "ta", "tb") >= similar).select("a", "b")


def deep_keys(sketches: list[bytes], seed: int = 11) -> np.ndarray:
    """One row of DEEP hashes for each sketch, each over DEPTH samples drawn by the seed."""
    g = np.random.default_rng(seed)
    x = np.frombuffer(b"".join(sketches), "<u2").reshape(len(sketches), -1).astype(_U)
    out = np.zeros((len(x), DEEP), _U)
    for f in range(DEEP):
        for c in g.choice(BANDS * ROWS, DEPTH, replace=False):
            out[:, f] = _mix(out[:, f] * _U(0x100000001B3) + x[:, c] + _U(1))
    return out.view(np.int64)


def _across(members: DataFrame, key: list[str]) -> DataFrame:
    """Pairs (a, b) of different components within buckets of bounded size."""
    other = members.select(*key, F.col("node").alias("b"), F.col("component").alias("cb"))
    pairs = members.select(*key, F.col("node").alias("a"), F.col("component").alias("ca")).join(other, key)
    return pairs.filter("a < b and ca <> cb").select("a", "b").distinct()


def _large_pairs(members: DataFrame, sketches: DataFrame, small: int) -> DataFrame:
    """Candidate pairs of members (band, key, node, component, hub, central) of large buckets that hold several classes."""
    hubs = members.filter("node = hub").select("band", "key", F.col("component").alias("first"))
    rest = members.join(hubs, ["band", "key"]).filter("component <> first")
    second = rest.groupBy("band", "key").agg(F.max(F.struct("central", F.col("node").alias("a"), F.col("component").alias("ca"))).alias("s")).select("band", "key", "s.a", "s.ca")
    pairs = members.join(second, ["band", "key"]).filter("component <> ca").select("a", F.col("node").alias("b"))

    def deepen(batches):
        for b in batches:
            k = deep_keys([bytes(x) for x in b["sketch"]]) if len(b) else np.empty((0, DEEP), np.int64)
            yield pd.DataFrame({"node": np.repeat(b["node"].to_numpy(), DEEP), "component": np.repeat(b["component"].to_numpy(), DEEP), "f": np.tile(np.arange(DEEP, dtype=np.int32), len(b)), "key": k.ravel()})

    own = members.select("node", "component").distinct().join(sketches, "node")
    deep = materialise(own.mapInPandas(deepen, "node long, component long, f int, key long"), "deep")
    full = deep.groupBy("f", "key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("hub")).filter("n > 1 and lo < hi").drop("lo", "hi")
    deep = deep.join(full, ["f", "key"])
    stars = deep.filter((F.col("n") > small) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    out = pairs.unionByName(_across(deep.filter(F.col("n") <= small), ["f", "key"])).unionByName(stars)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _prefix_pairs(members: DataFrame, nodes: DataFrame, idf, similar: float = SIMILAR, words: int = WORDS) -> DataFrame:
    """Pairs (a, b) of ``members`` (node, component) of different components that may be similar: an exact prefix filter.

    Any fixed order of shingles is exact.  Shingles that batches met more than
    once come last, by how often; they are at most ORDERED, the most frequent.
    """
    own = materialise(_texts_of(members.select("node").distinct(), nodes).join(members, "node").select("node", "component", "body"), "prefix-texts", "zstd")

    def repeated(batches):
        for b in batches:
            u, c = np.unique(np.concatenate([shingle_sets(block, words)[0] for block in _blocks(b["body"].tolist())] or [np.empty(0, _U)]), return_counts=True)
            yield pd.DataFrame({"h": u[c > 1].view(np.int64), "n": c[c > 1]})

    often = own.select("body").mapInPandas(repeated, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(ORDERED).toPandas().sort_values("h")
    ranks = nodes.sparkSession.sparkContext.broadcast((often["h"].to_numpy(np.int64), often["n"].to_numpy(np.int64)))

    def prefix(batches):
        known, n = ranks.value
        for b in batches:
            parts = []
            for node, comp, t in zip(b["node"], b["component"], b["body"], strict=True):
                h, c, _ = shingle_sets([t], words)
                w, s = idf.value.weights(h, c), h.view(np.int64)
                seen = np.zeros(len(s), np.int64)
                if len(known):
                    i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[i] == s
                    seen[hit] = n[i[hit]]
                order = np.lexsort((s, seen))
                before = np.cumsum(w[order]) - w[order]
                first = before <= (1 - similar) * w.sum() + 1e-9
                parts.append(pd.DataFrame({"node": node, "component": comp, "h": s[order][first], "left": w.sum() - before[first], "whole": w.sum()}))
            if parts:
                yield pd.concat(parts)

    p = materialise(own.mapInPandas(prefix, "node long, component long, h long, left double, whole double"), "prefixes")
    several = p.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    p = materialise(p.join(several.select("h", F.ceil(F.col("n") / HOT).alias("parts")), "h"), "prefixes")
    # rows of a hot shingle are dealt over its parts on one side and copied to each on the other
    x = p.select("h", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.col("node").alias("a"), F.col("component").alias("ca"), F.col("left").alias("la"), F.col("whole").alias("wa"))
    y = p.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("left").alias("lb"), F.col("whole").alias("wb"))
    bound = F.least("la", "lb") >= (F.col("wa") + F.col("wb")) * (similar / (1 + similar)) - 1e-9
    return x.join(y, ["h", "part"]).filter(F.expr("a < b and ca <> cb") & bound).select("a", "b").distinct()


def _open(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members with their ``component``, of the buckets that still hold several classes."""
    m = members.join(classes.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    m = materialise(m, "bucket-classes")
    several = materialise(m.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band", "key"), "several-classes")
    return materialise(m.join(several, ["band", "key"]), "open-buckets")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR, words: int = WORDS, rare: float = RARE, small: int = SMALL) -> DataFrame:
    """Return ``doc_id, class_id, class_size, kept``, one row per row of ``docs``.

    Rows are classed by their texts.  The class id is the smallest doc_id of the
    class, and the row of that id stays; if several texts of the class have it,
    the one of the smallest SHA-256.  Null text counts as empty; texts without
    words are alike.  Rows with a null id are classes of their own with a null
    class id, size 1, and are kept.  Rows that repeat an id with the same text are
    flagged alike; an id that repeats with other texts is a row of each text's
    class.  Texts are read whole, of whatever length; an empty table gives an
    empty result.  Columns other than the two named are not read.
    """
    out = _classed(docs, doc_id, text, similar, words, rare, small)
    return out.select("doc_id", "class_id", "class_size", "kept")


def _classed(docs: DataFrame, doc_id: str, text: str, similar: float, words: int, rare: float, small: int) -> DataFrame:
    """``doc_id, digest, class_id, class_size, kept`` of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    texts = base.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("body").alias("body"))
    # node numbers are unique once written, whatever ids repeat
    nodes = materialise(texts.withColumn("node", F.monotonically_increasing_id()), "distinct-texts", "zstd")
    idf = spark.sparkContext.broadcast(frequent_shingles(nodes, nodes.count(), rare, words))
    signed = materialise(signatures(nodes, idf, words), "signatures")
    sketches = signed.select("node", "sketch")

    posted = signed.select("node", F.posexplode("keys").alias("band", "key"))
    # counts and hubs of buckets are written before they meet the members, so that a large bucket's join can be split
    full = materialise(posted.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket-sizes")
    members = materialise(posted.join(full, ["band", "key"]), "buckets")
    central = members.groupBy("node").agg(F.sum("n").alias("central"))
    members = members.join(central, "node")
    hub = members.groupBy("band", "key").agg(F.max(F.struct("central", "node")).alias("s")).select("band", "key", F.col("s.node").alias("hub"))
    hub = materialise(hub, "bucket-hubs")
    members = materialise(members.join(hub, ["band", "key"]), "buckets")
    stars = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = materialise(_verified(_agree(stars, sketches), nodes, idf, similar, words), "links")
    classes = materialise(connected_components(links, "a", "b"), "classes")

    m = _open(members, classes)
    pairs = _across(m.filter(F.col("n") <= small), ["band", "key"])
    many = m.filter(F.col("n") > small)
    large = bool(many.limit(1).count())
    if large:
        pairs = pairs.unionByName(_large_pairs(many, sketches, small))
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialise(_agree(pairs.distinct().join(done, ["a", "b"], "left_anti"), sketches), "rest")
    links = materialise(links.union(_verified(rest, nodes, idf, similar, words)), "links")
    if large:
        many = _open(many.drop("component"), materialise(connected_components(links, "a", "b"), "classes"))
        if many.limit(1).count():
            pairs = _prefix_pairs(many.select("node", "component").distinct(), nodes, idf, similar, words)
            pairs = _agree(pairs.join(done.union(rest).distinct(), ["a", "b"], "left_anti"), sketches)
            links = materialise(links.union(_verified(pairs, nodes, idf, similar, words)), "links")
    classes = connected_components(links, "a", "b").withColumnRenamed("id", "node")

    named = materialise(nodes.select("digest", "node", "least", "copies").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-nodes")
    per = named.groupBy("component").agg(F.min(F.struct("least", "digest")).alias("first"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    thin = base.select("doc_id", "digest")
    known = join_groups(named.select("digest", "copies", "component"), materialise(per, "near-classes"), "component", "texts", named.count())
    known = materialise(known.select("digest", "copies", "first", "class_size"), "near-digests")
    total = known.agg(F.sum("copies")).first()[0] or 0
    out = join_groups(thin.filter("doc_id is not null"), known, "digest", "copies", total)
    kept = (F.col("doc_id") == F.col("first.least")) & (F.col("digest") == F.col("first.digest"))
    out = out.select("doc_id", "digest", F.col("first.least").alias("class_id"), "class_size", kept.alias("kept"))
    alone = thin.filter("doc_id is null").select("doc_id", "digest", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def drop_near(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, exactly one of each class, with all their columns.

    Of rows that repeat both the id and the text that stay, the one whose other
    columns come first as JSON stays.  Rows with null ids all stay.
    """
    kept = _classed(docs, "doc_id", "text", SIMILAR, WORDS, RARE, SMALL).filter("kept and doc_id is not null").select("doc_id", F.col("digest").alias("_text_sha"))
    rows = docs.withColumn("_text_sha", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    return one_of_each(rows, kept, ["doc_id", "_text_sha"]).select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
