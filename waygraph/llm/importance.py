"""Resampling towards a target distribution, with importance weights of hashed n-grams.

A text is scanned once: its bytes become words joined by single spaces, and the CRC of the
text up to the end of each word is stored.  The CRC of any run of words then follows from
two of these prefixes.  A CRC is linear over GF(2), and reading n more bytes maps the
CRC of a prefix by a fixed matrix; so the CRC of B is that of AB with the mapped CRC of A
cancelled.  The maps are tables of four by 256 entries for each length up to ``TABLED``,
and for powers of two above.

Buckets of n-grams are counted over all documents and all target texts; a text's weight is
the mean gain of its n-grams.  Documents are drawn without replacement by the largest
sums of weight and Gumbel noise.  The ranking needs no global sort in one task: scores
are integers of a bounded range, so their histogram gives each score its first rank, and
equal scores are ranked by id within ranges of ids.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waygraph.llm.common import bounded_batches, parts_for, ranked, slices
from waygraph.plans.stages import materialise, table

BUCKETS, MOST = 10_000, 2
#: Lengths with a shift table of their own.
TABLED = 64
_ALL = np.uint32(0xFFFFFFFF)
_EIGHT = np.uint32(8)
_LOW = np.uint32(255)


def _byte_table() -> np.ndarray:
    """The CRC-32 table of single bytes, polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


BYTE = _byte_table()


def _map(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Apply a linear map given by one table per byte of its argument."""
    return tables[0, x & _LOW] ^ tables[1, (x >> _EIGHT) & _LOW] ^ tables[2, (x >> np.uint32(16)) & _LOW] ^ tables[3, x >> np.uint32(24)]


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables that map the CRC of a prefix over n zero bytes: for each n below TABLED, and for its multiples by powers of two."""
    unit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    each = [unit]
    for _ in range(TABLED):
        each.append(BYTE[each[-1] & _LOW] ^ (each[-1] >> _EIGHT))
    powers = [each.pop()]
    while len(powers) < 32:
        powers.append(_map(powers[-1], powers[-1]))
    return np.stack(each), powers


SHIFTS, POWERS = _shifts()


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What the CRC of a prefix contributes to the CRC ``length`` bytes further on."""
    low = length % TABLED
    out = SHIFTS[low, 0, crc & _LOW] ^ SHIFTS[low, 1, (crc >> _EIGHT) & _LOW] ^ SHIFTS[low, 2, (crc >> np.uint32(16)) & _LOW] ^ SHIFTS[low, 3, crc >> np.uint32(24)]
    high = length // TABLED
    for k in range(int(high.max(initial=0)).bit_length()):
        at = np.flatnonzero(high >> k & 1)
        out[at] = _map(POWERS[k], out[at])
    return out


#: Bytes that separate words become spaces, A-Z become a-z; the rest, all bytes from 128 included, are parts of words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def ngram_crcs(texts: list[bytes], most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC of every run of 1 to ``most`` words, the text it is in, words of each text), by prefix CRCs."""
    crc32 = zlib.crc32
    lens, ends, counts = [], [], []
    for t in texts:
        words = t.translate(_WORDS).split()
        counts.append(len(words))
        lens += map(len, words)
        ends += accumulate(words, lambda c, w: crc32(w, crc32(b" ", c)), initial=crc32(b"")) if words else ()
    # accumulate() gives the CRC before the first word too; every text starts with a space, which cancels out
    counts, lens = np.array(counts, np.int64), np.array(lens, np.int64)
    whole = counts + (counts > 0)
    ends = np.array(ends, np.uint32)
    is_start = np.zeros(len(ends), bool)
    is_start[(np.cumsum(whole) - whole)[counts > 0]] = True
    before, end = ends[np.flatnonzero(~is_start) - 1], ends[~is_start]
    start = BYTE[(before ^ _ALL ^ np.uint32(32)) & _LOW] ^ ((before ^ _ALL) >> _EIGHT) ^ _ALL  # a space further on
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    position = np.arange(len(text)) - first[text]
    place = np.cumsum(lens + 1)
    crcs, of = [], []
    for n in range(1, most + 1):
        last = np.flatnonzero(position >= n - 1)
        begin = last - (n - 1)
        length = place[last] - place[begin] + lens[begin]
        crcs.append(end[last] ^ shift(start[begin], length))
        of.append(text[last])
    return np.concatenate(crcs), np.concatenate(of), counts


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """``bucket, n``: n-grams of all texts in each bucket that has any."""

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for part in slices([t.encode() for t in b["body"]]):
                sums += np.bincount(ngram_crcs(part, most)[0] % np.uint32(buckets), minlength=buckets)
        own = np.flatnonzero(sums)
        yield pd.DataFrame({"bucket": own, "n": sums[own]})

    body = F.coalesce(F.col(text), F.lit("")).alias("body")
    return texts.select(body).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The integer gain of each bucket, from ``bucket_counts`` of both; ``buckets`` numbers reach the driver."""
    rows = documents.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").toPandas().fillna(0)
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    s[rows["bucket"]], t[rows["bucket"]] = rows["s"], rows["t"]
    ratio = (t + 1.0) * (s.sum() + buckets) / ((s + 1.0) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least_words: int = 20, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """Return ``doc_id, n_features, weight, score, rank``, one row per row of ``docs``.

    Drawn are floor(percent * N / 100) of the N rows with at least ``least_words``
    words, those of the highest scores, ties to the smaller id; ``rank`` counts them
    from 1, others have none.  Null text counts as empty, texts without words
    have weight 0.  A null id hashes as an empty one and comes last in ties; rows that
    repeat an id and a score follow each other in any order.  Texts are read whole.  An empty
    table gives an empty result, an empty target only smooths; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    gain = spark.sparkContext.broadcast(gains(bucket_counts(base, "body", buckets, most), bucket_counts(target, text, buckets, most), buckets))

    @F.pandas_udf("n_features long, n_words long, total long")
    def measured(bodies: pd.Series) -> pd.DataFrame:
        table, out = gain.value, []
        for part in slices([t.encode() for t in bodies]):
            crcs, of, words = ngram_crcs(part, most)
            total = np.zeros(len(part), np.int64)
            np.add.at(total, of, table[crcs % np.uint32(buckets)])
            out.append(pd.DataFrame({"n_features": np.bincount(of, minlength=len(part)), "n_words": words, "total": total}))
        return pd.concat(out) if out else pd.DataFrame({"n_features": [], "n_words": [], "total": []}, dtype="int64")

    rows = base.withColumn("m", measured("body")).select("doc_id", "m.n_features", "m.n_words", F.expr("if(m.n_features = 0, 0L, (m.total - pmod(m.total, m.n_features)) div m.n_features)").alias("weight"))
    rows = rows.withColumn("score", F.col("weight") + noise("doc_id", seed))
    return _ranked(materialise(rows, "importance"), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def _ranked(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds ``rank`` to rows of enough words that are drawn."""
    able = F.col("n_words") >= least_words
    histogram = rows.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # one row per score: scores span less than 200,000 values whatever the counts are, as 1000 ln of a ratio of longs does
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    first = materialise(histogram.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))), "importance-scores")
    facts = first.agg(F.sum("n").alias("all")).first()
    draw = percent * (facts["all"] or 0) // 100
    drawn = rows.filter(able).join(F.broadcast(first.filter(F.col("above") < draw).select("score", "above")), "score")
    span = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, parts = span["lo"] or 0, parts_for(span["n"], 8)
    width = ((span["hi"] or 0) - lo) // parts + 1
    # ranges of ids, null ids in the last: rows of a range are numbered after those of the ranges before it
    part = F.least(F.coalesce(F.floor((F.col("doc_id").cast("double") - float(lo)) / float(width)), F.lit(parts)), F.lit(parts - 1))
    placed = ranked(drawn, ["score"], [F.col("doc_id").asc_nulls_last()], part, parts, "place").withColumn("rank", F.col("above") + F.col("place") + 1)
    shown = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    out = placed.select(*shown, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    cut = first.filter(F.col("above") < draw).agg(F.min("score")).first()[0]
    rest = rows if cut is None else rows.filter(~able | (F.col("score") < cut))
    return out.unionByName(rest.select(*shown, none))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all documents drawn towards the distribution of the benchmark texts."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
