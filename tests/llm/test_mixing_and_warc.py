"""Taken words of every document and output shard against plain Python from the same keys."""

import hashlib
import random
import re

import xxhash

from waygraph.llm import mixing
from waygraph.llm.common import parts_for


def seeded(*parts):
    return int(hashlib.md5("|".join([mixing.SEED, *[p for p in parts if p is not None]]).encode()).hexdigest()[:15], 16)


def words(text):
    return len(re.findall(mixing.WORD, text or ""))


def plain(rows, block, shards, most=2.0):
    """(doc_id, source, size, taken by shard) of rows (doc_id, source, text), from targets and quotas awarded one seat at a time."""
    names = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    size = {s: sum(words(t) for _, x, t in rows if x == s) for s in names}
    left, target, free = 1.5 * sum(size.values()), {}, list(names)
    while free:  # the excess of stopped sources is shared again
        level = left / sum(weight[s] for s in free)
        stopped = [s for s in free if level * weight[s] >= most * size[s]]
        if not stopped:
            target |= {s: level * weight[s] for s in free}
            break
        for s in stopped:
            target[s] = most * size[s]
            left -= target[s]
            free.remove(s)
    seats, house = {s: [0] * shards for s in names}, round(sum(target.values()) / block)
    for n in range(house):
        shard = next(k for k in range(shards) if n < house * (k + 1) // shards)
        able = [s for s in names if sum(seats[s]) < int(most * -(-size[s] // block))]
        best = max(able, key=lambda s: (target[s] / (2 * sum(seats[s]) + 1), -names.index(s)))
        seats[best][shard] += 1
    out = []
    for s in names:
        own = []
        for i, x, t in rows:
            if x == s:
                draw = seeded(None if i is None else str(i), str(42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), 42) >> 63)))
                own.append((draw % parts_for(len(rows), mixing.SALTS), draw, i is not None, i or 0, words(t), i))
        own.sort()
        line = [k for k, r in enumerate(own) for _ in range(r[4])]
        taken = [[0] * shards for _ in own]
        blocks = -(-size[s] // block)
        at = seeded("start", "n" if s is None else "s" + s) % blocks if blocks else 0
        for k in range(shards):
            for _ in range(seats[s][k]):
                for w in line[at % blocks * block : (at % blocks + 1) * block]:
                    taken[w][k] += 1
                at += 1
        out += [(r[5], s, r[4], tuple(t)) for r, t in zip(own, taken, strict=True)]
    return sorted(map(str, out))


def test_mix_equals_plain_python(spark):
    g = random.Random(3)
    rows = [(k if k % 9 else None, g.choice(["a", "a", "a", "b", "c", None, "ü"]), g.choice([None, "", "x", "w " * g.randrange(200), f"word{k} " * 7])) for k in range(150)]
    rows += [(7, "a", "same text")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for block, shards in ((32, 8), (5, 3)):
        got = mixing.mix(df, block=block, shards=shards).collect()
        assert sorted(str((r.doc_id, r.source, r["size"], tuple(r.shard_taken))) for r in got) == plain(rows, block, shards)
        assert all(r.taken == sum(r.shard_taken) <= 2 * r["size"] for r in got)


def test_mix_query_equals_plain_python(spark, sf):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    got = mixing.query(spark, sf).collect()
    source = {i: s for i, s, _ in rows}
    assert sorted(str((r.doc_id, source[r.doc_id], r["size"], tuple(r.shard_taken))) for r in got) == plain(rows, mixing.BLOCK, 8)


def test_targets_may_stop_between_whole_multiples(spark):
    """A limit that is no integer holds for seats too."""
    df = spark.createDataFrame([(k, "a" if k < 90 else "b", "w " * 20) for k in range(100)], "doc_id long, source string, text string")
    got = mixing.mix(df, share=2.0, most=1.5, block=10).collect()
    assert sum(r.taken for r in got if r.source == "b") == 300 and max(r.taken for r in got if r.source == "a") <= 40


def test_warc_headers_are_checked(spark, tmp_path):
    """A stored header that disagrees with its payload is refused, also that of a revisit; urls stay as they came."""
    import pytest

    from waygraph.llm import warc_archive

    pages = spark.createDataFrame([(1, "http://a\nb", "x"), (2, None, "x"), (3, "http://c", "yy")], "page_id long, url string, html string")
    folder = str(tmp_path / "a")
    warc_archive.write_archive(pages, folder)
    assert {(r.page_id, r.url) for r in spark.read.parquet(f"{folder}/records").collect()} == {(1, "http://a\nb"), (2, None), (3, "http://c")}
    for k, (old, new) in enumerate([("Content-Length: 2", "Content-Length: 1"), ("Payload-Digest: sha1:", "Payload-Digest: sha1:A"), ("WARC-Refers-To: <urn:uuid:", "WARC-Refers-To: <urn:uuid:0")]):
        bad = str(tmp_path / f"bad{k}")
        records = spark.read.parquet(f"{folder}/records")
        changed = records.withColumn("header", warc_archive.F.encode(warc_archive.F.replace(warc_archive.F.decode("header", "UTF-8"), warc_archive.F.lit(old), warc_archive.F.lit(new)), "UTF-8"))
        changed.write.parquet(f"{bad}/records")
        spark.read.parquet(f"{folder}/payloads").write.parquet(f"{bad}/payloads")
        with pytest.raises(Exception, match="disagree|no response"):
            warc_archive.read_archive(spark, bad).collect()


def test_base32_digests(spark):
    """Digests equal hashlib's, leading zeros included, and are made without a function of each character."""
    import base64
    import hashlib

    from pyspark.sql import functions as F

    from waygraph.llm.warc_archive import sha1_base32

    df = spark.range(3000).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("data")).withColumn("b", sha1_base32(F.col("data")))
    rows = df.collect()
    assert all(r.b == base64.b32encode(hashlib.sha1(bytes(r.data)).digest()).decode() for r in rows)
    assert any(r.b.startswith("A") for r in rows)
    assert "transform" not in df._jdf.queryExecution().optimizedPlan().toString()
