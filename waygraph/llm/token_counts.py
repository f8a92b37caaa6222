"""Token counts through a digest cache.

Every text is named by a digest of the tokenizer's version digest and its
normalised content.  Counts are looked up in a cache table by that name; only
distinct misses are encoded, once each, and appended to the cache.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import bounded_batches, join_groups, vocabulary
from waygraph.plans.stages import materialise, path_exists, shared_dir, table

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
_LOADED: dict[str, object] = {}


def tokenizer_version(name: str) -> str:
    """Digest of the vocabulary file and of how it is used."""
    with open(vocabulary(name), "rb") as f:
        return hashlib.sha256(f.read() + b"|plain ids, no special tokens").hexdigest()


def counter(name: str):
    """texts -> token counts, by the library the vocabulary file belongs to."""
    if name not in _LOADED:
        path = vocabulary(name)
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[name] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tk = Tokenizer.from_file(path)
            _LOADED[name] = lambda texts: [len(x.ids) for x in tk.encode_batch(texts, add_special_tokens=False)]
    return _LOADED[name]


def _normalised(text: str) -> F.Column:
    """What the digest is taken of: null is empty, nothing else changes, so equal digests have equal counts."""
    return F.coalesce(F.col(text), F.lit(""))


def token_counts(docs: DataFrame, cache: str, tokenizer: str = "piece_bpe_32k.model", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Return ``keep`` columns with ``n_bytes, digest, n_tokens``, one row per row of ``docs``.

    ``cache`` is the folder of the cache table, partitioned by version; it is
    created when absent and appended to.  Rows that repeat have a row each and share
    one cache entry; texts are encoded whole, of whatever length.  Null and empty texts have the count of the empty text.  Other
    columns of ``docs`` are not read, whatever their names.  An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    version = tokenizer_version(tokenizer)
    body = _normalised(text)
    name = F.unhex(F.sha2(F.concat(F.lit(version + "\n"), body), 256))
    thin = docs.select(*[F.col(c) for c in keep], F.octet_length(body).cast("long").alias("n_bytes"), name.alias("digest"))
    misses = docs.select(name.alias("digest"), body.alias("body")).groupBy("digest").agg(F.first("body").alias("body"))
    if path_exists(spark, cache):
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version)
        misses = misses.join(known, "digest", "left_anti")

    def encode(batches):
        count = counter(tokenizer)
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "version": version, "n_tokens": count(b["body"].tolist())})

    misses.select("digest", "body").mapInPandas(encode, CACHE_SCHEMA).write.mode("append").partitionBy("version").parquet(cache)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version)
    # two jobs may have appended the same digest; one row of each is enough
    known = known.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    wanted = materialise(thin.groupBy("digest").agg(F.count(F.lit(1)).alias("_rows")).join(known, "digest"), "token-counts")
    total = wanted.agg(F.sum("_rows")).first()[0] or 0
    return join_groups(thin, wanted, "digest", "_rows", total).select(*keep, "n_bytes", "digest", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: counts of all documents, from a cache that starts empty."""
    counts = token_counts(table(spark, sf_dir, "documents"), shared_dir(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
