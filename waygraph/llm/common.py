"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waygraph.plans.stages import materialise

#: Rows and bytes in one Arrow batch of texts; a single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker, by rows and by bytes.

    Results are lazy, so the limits stay set in the session; limits that are
    already lower are left alone.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int("".join(c for c in spark.conf.get(key) if c in "-0123456789"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def vocabulary(name: str) -> str:
    """A vocabulary file: a path as it stands, or the name of an installed public one."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(values: list, most_bytes: int = 1 << 20) -> Iterator[list]:
    """Consecutive parts of a list of byte strings, each of about ``most_bytes`` or one value."""
    part: list = []
    held = 0
    for v in values:
        if part and held + len(v) > most_bytes:
            yield part
            part, held = [], 0
        part.append(v)
        held += len(v)
    if part:
        yield part


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is ``remainder``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


#: Bits of a membership filter, as a power of two.
FILTER = 26


def maybe_in(df: DataFrame, ids: DataFrame, column: str, flag: str = "_maybe") -> DataFrame:
    """``df`` with a boolean ``flag`` that is false only if its ``column`` is not in ``ids``.

    A bitmap of 2^FILTER bits over hashes, 8 MB whatever the size of ``ids``, is
    broadcast as rows of 4 KB and tested in the JVM.  When it fills up more rows
    are flagged, and callers join or compare exactly anyway.  A null is flagged false.
    """
    cell = F.pmod(F.xxhash64(column), F.lit(1 << FILTER)) + 1
    bits = ids.groupBy(F.bitmap_bucket_number(cell).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("_bits"))
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.col("_bits").isNotNull() & F.col(column).isNotNull() & (F.getbit(byte, (at % 8).cast("int")) == 1)
    out = df.withColumn("_bucket", F.bitmap_bucket_number(cell)).join(F.broadcast(bits), "_bucket", "left")
    return out.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(flag))


#: A group of more than 1 in so many rows is joined by broadcast.
HEAVY = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join (``how``: inner or left) of ``rows`` with one row per group, on ``key``, without gathering a large group in one task.

    ``size`` is a column of ``groups``: rows in the group, of ``total`` in all.
    Groups above total / HEAVY, which are at most HEAVY, are broadcast and their
    rows stay where they are; the others are shuffled and at most that large.
    """
    large = F.col(size) * HEAVY > total
    some = groups.filter(large)
    more = [c for c in groups.columns if c != key]
    tagged = rows.join(F.broadcast(some.withColumn("_large", F.lit(True))), key, "left")
    heavy = tagged.filter("_large").select(*rows.columns, *more)
    light = tagged.filter("_large is null").select(*rows.columns).join(groups.filter(~large), key, how).select(*rows.columns, *more)
    return heavy.unionByName(light)


def one_of_each(df: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose ``keys`` (null is a value) are in ``kept``, exactly one of each.

    ``kept`` may hold a key many times, once for each row of ``df``.  Of rows that
    share a key the one whose other columns come first as JSON stays; they are
    aggregated before they are shuffled.
    """
    counts = materialise(kept.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n")), "kept-keys")

    def those(of: DataFrame) -> DataFrame:
        on = [df[k].eqNullSafe(of[f"_k{i}"]) for i, k in enumerate(keys)]
        return df.join(of, on, "left_semi")

    out = those(counts.filter("_n = 1"))
    several = counts.filter("_n > 1")
    if several.limit(1).count():
        row = F.struct(*[F.col(c) for c in df.columns])
        out = out.unionByName(those(several).groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*"))
    return out


#: Rows that one part of a key holds, about.
PART_ROWS = 1_000_000


def parts_for(rows: int, least: int = 128) -> int:
    """Parts over which the rows of one key are dealt, so that none holds more than about PART_ROWS whatever the key's share."""
    return max(least, -(-rows // PART_ROWS))


def ranked(df: DataFrame, keys: list[str], order: list[Column], salt: Column, salts: int, rank: str = "rank") -> DataFrame:
    """Add ``rank``, gapless from 0 within ``keys``, without gathering a key in one task.

    Rows of a key are dealt over ``salts`` parts by ``salt`` (any stable integer
    of the row).  Parts are counted first; a part's rows are numbered in a window
    of their own and shifted by the counts of the parts before it.  Null keys are
    keys like any other.
    """
    df = df.withColumn("_part", F.pmod(salt, F.lit(salts)).cast("int"))
    on = [*keys, "_part"]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    left = df.withColumn("_row", F.row_number().over(Window.partitionBy(*on).orderBy(*order)))
    cond = [left[c].eqNullSafe(base[c]) for c in on]
    joined = left.join(base, cond).select(*[left[c] for c in left.columns], base["_base"])
    return joined.withColumn(rank, (F.col("_base") + F.col("_row") - 1).cast("long")).drop("_base", "_row", "_part")
