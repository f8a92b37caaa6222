"""Exact duplicates by composable polynomial fingerprints.

A chunk of bytes c_0..c_m has the hash  sum (c_j + 1) * B^j  modulo a prime; the
hash of A followed by B is  h(A) + B^len(A) * h(B).  Chunks are hashed on their
own and combined by that shift: inside a batch for ordinary texts, across tasks
for huge ones.  Two bases and primes give 62 bits beside the length.  Texts of
equal fingerprint are then compared chunk by chunk: for every chunk position the
smallest and the largest chunk are aggregated, which stream through map-side
combining, and must be equal.  Fingerprints that fail are split by SHA-256.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import bounded_batches, join_groups, maybe_in, one_of_each, slices
from waygraph.plans.stages import materialise, table

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 918273645)
CHUNK = 4096
#: Texts above this many bytes are cut into segments of this size that any task may hash.
HUGE = 8 << 20
#: Bytes of a chunk in the comparison.
COMPARE = 64 << 10
KEY = ["n_bytes", "f1", "f2"]


def powers(base: int, prime: int, n: int, first: int = 1) -> np.ndarray:
    """first * base^i mod prime for i < n, by doubling."""
    out = np.array([first % prime], dtype=np.uint64)
    step = base % prime
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
        step = step * step % prime
    return out[:n]


def combine(left: int, right: int, left_len: int, base: int, prime: int) -> int:
    """Hash of a concatenation from the hashes of its parts."""
    return (left + pow(base, left_len, prime) * right) % prime


def polynomial(values: list[bytes], base: int, prime: int, chunk: int = CHUNK) -> np.ndarray:
    """Hashes of byte strings: chunk hashes, shifted by the bytes before them and summed."""
    inside = powers(base, prime, chunk + 1)
    out = []
    for part in slices(values):
        lens = np.fromiter(map(len, part), np.int64, len(part)) + 1  # one byte of weight 0 ends each, so that none is empty
        data = np.frombuffer(b"\0".join(part) + b"\0", np.uint8).astype(np.uint64) + np.uint64(1)
        starts = np.cumsum(lens) - lens
        data[starts + lens - 1] = 0
        pos = np.arange(len(data)) - np.repeat(starts, lens)
        at = pos % chunk
        cuts = np.flatnonzero(at == 0)
        p = np.uint64(prime)
        hashes = np.add.reduceat(data * inside[at], cuts) % p
        number = pos[cuts] // chunk
        shift = powers(int(pow(base, chunk, prime)), prime, int(number.max()) + 1)
        hashes = hashes * shift[number] % p
        out.append(np.add.reduceat(hashes, np.flatnonzero(number == 0)) % p)
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def _hash_udf(primes):
    @F.pandas_udf("f1 long, f2 long")
    def fingerprint(data: pd.Series) -> pd.DataFrame:
        values = [bytes(x) for x in data]
        return pd.DataFrame({f"f{i + 1}": polynomial(values, BASES[i], primes[i]) for i in range(2)})

    return fingerprint


def _segment_udf(primes, size):
    @F.pandas_udf("f1 long, f2 long")
    def fingerprint(data: pd.Series, number: pd.Series) -> pd.DataFrame:
        values = [bytes(x) for x in data]
        out = {}
        for i in range(2):
            shift = np.array([pow(BASES[i], int(k) * size, primes[i]) for k in number], dtype=np.uint64)
            out[f"f{i + 1}"] = (polynomial(values, BASES[i], primes[i]).astype(np.uint64) * shift % np.uint64(primes[i])).astype(np.int64)
        return pd.DataFrame(out)

    return fingerprint


def fingerprinted(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), primes=PRIMES, huge: int = HUGE) -> DataFrame:
    """``keep`` columns with ``n_bytes, f1, f2, sha``, one row per row of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], body.cast("binary").alias("body")).withColumn("n_bytes", F.octet_length("body").cast("long"))
    shown = [f"k_{c}" for c in keep] + ["n_bytes"]
    sha = F.sha2(F.col("body"), 256)
    small = base.filter(F.col("n_bytes") <= huge).withColumn("f", _hash_udf(primes)("body"))
    small = small.select(*shown, "f.f1", "f.f2", sha.alias("sha"))
    # huge texts: segments go to any task; sums of shifted hashes combine map-side
    large = base.filter(F.col("n_bytes") > huge).withColumn("sha", sha)
    cut = large.select("sha", "n_bytes", F.posexplode(_pieces("body", "n_bytes", huge)).alias("k", "d")).repartition("sha", "k")
    h = cut.withColumn("f", _segment_udf(primes, huge)("d", "k")).select("sha", "n_bytes", "k", "f.f1", "f.f2").dropDuplicates(["sha", "n_bytes", "k"])
    h = h.groupBy("sha", "n_bytes").agg((F.sum("f1") % primes[0]).alias("f1"), (F.sum("f2") % primes[1]).alias("f2"))
    large = large.select(*shown, "sha").join(h, ["sha", "n_bytes"]).select(*shown, "f1", "f2", "sha")
    out = small.unionByName(large)
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], *KEY, "sha")


def _pieces(body: str, n_bytes: str, size: int) -> F.Column:
    """Consecutive parts of ``size`` bytes; ``body`` is a binary column, so no part encodes the whole again."""
    last = F.greatest(F.lit(0), ((F.col(n_bytes) - 1) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(body), i * size + 1, F.lit(size)))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", primes=PRIMES, huge: int = HUGE, compare: int = COMPARE) -> DataFrame:
    """Return ``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    Null text counts as empty; an empty table gives an empty result.  Of equal
    texts the row with the largest id stays (null ids rank lowest; a group of
    null ids keeps null).  Rows that repeat an id with the same text count in
    ``group_size`` and are flagged alike; an id that repeats with other texts is a
    row of each text's group.  Very long texts are hashed and compared in pieces.
    Columns other than the two named are not read.

    SHA-256 only names rows: it brings the fingerprint of a text, made once, to
    the comparison, and separates texts that a fingerprint wrongly joins.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keys = materialise(fingerprinted(docs, primes=primes, huge=huge), "fingerprints")
    total = keys.count()
    named = materialise(keys.groupBy(*KEY, "sha").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")), "named-texts")
    shared = named.groupBy(*KEY).agg(F.sum("n").alias("n")).filter("n > 1").select(*KEY)
    suspects = materialise(named.join(shared, KEY, "left_semi").select("sha", *KEY), "suspects")
    bodies = maybe_in(docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("body")).withColumn("sha", F.sha2("body", 256)), suspects.select("sha"), "sha")
    chunks = bodies.filter("_maybe").withColumn("n_bytes", F.octet_length("body")).select("sha", F.posexplode(_pieces("body", "n_bytes", compare)).alias("chunk", "bytes"))
    # copies collapse before they move; then texts of one fingerprint meet
    own = chunks.groupBy("sha", "chunk").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi"))
    compared = own.join(suspects, "sha").groupBy(*KEY, "chunk").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    unlike = compared.filter("lo <> hi").select(*KEY).distinct().withColumn("unlike", F.lit(True))
    tied = named.join(unlike, KEY, "left").withColumn("tie", F.when(F.col("unlike"), F.col("sha")).otherwise(F.lit(""))).drop("unlike")
    group = [*KEY, "tie"]
    sizes = tied.groupBy(*group).agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    of = materialise(tied.join(sizes, group).select("sha", "keep_id", "group_size"), "groups")
    out = join_groups(keys.select("doc_id", "sha"), of, "sha", "group_size", total)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, exactly one of each text, with all their columns.

    Of rows that repeat both the id that stays and the text, the one whose other
    columns come first as JSON stays.
    """
    kept = exact_groups(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("_text_sha"))
    rows = docs.withColumn("_text_sha", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    return one_of_each(rows, kept, ["doc_id", "_text_sha"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: exact groups of all documents."""
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
"""
