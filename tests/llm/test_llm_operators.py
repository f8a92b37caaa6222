"""Small cases of the training-data operators: nulls, empties, ties, repeats, clashing names, brute force."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from waygraph.llm import exact_dedup, media_columns, mixing, near_dedup, packing, quality, sharding, token_counts, toxicity, warc_archive
from waygraph.llm.common import ranked, vocabulary

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long words make long texts " * 3000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "a b c d e f g", "en", "s1", 13), (2, "a b c d e f g", "en", "s1", 13), (3, "", "en", "s2", 0), (4, None, None, None, None),
        (5, LONG, "en", "s1", 1), (6, LONG, "en", "s2", 1), (7, "Übergröße naïve 東京 \t x y <|endoftext|>", "de", "s3", 9), (8, " ", "en", "s3", 1),
        (8, " ", "en", "s3", 1), (None, "no id", "en", None, 5), (9, "one", "en", "s3", 3), (10, "a b c d e f g ", "en", "s1", 14),
    ]
    df = spark.createDataFrame(rows, DOC)
    return df.selectExpr("*", "1 as size", "'x' as shard", "2.5 as score", "7 as digest", "0 as node", "'k' as key", "5 as n_bytes", "3 as taken", "1 as body", "2 as bucket", "4 as length")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_token_counts(spark, odd, none, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second run finds every digest in the cache
        got = token_counts.token_counts(odd, cache)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == sorted((str(i), len(t.encode()), len(sp.encode(t))) for i, t in texts(odd))
        stored = spark.read.parquet(cache)
        assert stored.count() == len({t for _, t in texts(odd)})
    got = token_counts.token_counts(odd, cache, "byte_bpe_50k.json")  # another version shares no counts
    assert got.filter("n_tokens is null").count() == 0 and spark.read.parquet(cache).select("version").distinct().count() == 2
    assert token_counts.token_counts(none, str(tmp_path / "c2")).count() == 0


@pytest.mark.parametrize("copies", [1, 60])
def test_sharding(spark, odd, none, copies):
    """Equal texts together, near equal bytes, gapless slots; also with a group of a third of all bytes."""
    more = spark.range(200).selectExpr("id + 100 as doc_id", f"case when id < {copies} then repeat('hot ', 50) else concat('text ', id, repeat('y', cast(id % 50 as int))) end as text")
    out = sharding.shard_by_bytes(odd.select("doc_id", "text", "shard", "size").filter("length(text) < 1000 or text is null").unionByName(more, allowMissingColumns=True), 4).collect()
    assert len(out) == 210
    where, load, slots = {}, Counter(), {}
    for r in out:
        where.setdefault(r.text, set()).add(r.shard)
        load[r.shard] += len((r.text or "").encode()) + 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if copies == 1:
        assert max(load.values()) - min(load.values()) < 0.1 * sum(load.values()) / 4
    else:
        assert max(load.values()) < 1.1 * max(sum(load.values()) / 4, 60 * 201)
    assert sharding.shard_by_bytes(none, 4).count() == 0


def test_mixing(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 12
    sizes = {str(r.source): r.source_size for r in rows}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
    for s in sizes:
        own = [r for r in rows if str(r.source) == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * mixing.BLOCK
        assert own[0].target <= 2 * sizes[s] + 1e-9
    again = mixing.mix(odd.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_rows(odd).columns == odd.columns


def test_mixed_rows(spark, odd):
    """Whole documents, the two cut ones settled for the nearest sum; rows alike share what is taken of them."""
    rows = [(k, "en", f"s{k % 3}", " ".join(["w"] * (5 + 7 * k % 60)), k) for k in range(60)] + [(100, "en", "s0", "r " * 40, k) for k in range(5)] + [(101, "en", "s0", "r " * 40, 7), (101, "en", "s1", "t " * 9, 8), (None, None, None, "x y z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, extra int")
    got = mixing.mixed_rows(docs).collect()
    taken, targets, full = {}, {}, Counter()
    for r in mixing.mix(docs).collect():
        k = (r.doc_id, r.source, r["size"])
        taken[k] = taken.get(k, 0) + r.taken
        targets[r.source] = r.target
    times = Counter((r.doc_id, r.source, len(r.text.split())) for r in got)
    for src in targets:
        sure, cut = 0, []
        for (i, s, n), w in taken.items():
            if s == src:
                sure += w // n * n
                cut += [n] * (w % n > 0)
                assert times[i, s, n] in (w // n, w // n + (w % n > 0))
        assert len(cut) <= 2
        best = min(abs(sure + sum(x for b, x in enumerate(cut) if c >> b & 1) - targets[src]) for c in range(2 ** len(cut)))
        assert abs(sum(n * m for (i, s, n), m in times.items() if s == src) - targets[src]) == pytest.approx(best)
    for r in docs.filter("doc_id = 100").collect():
        full[r.extra] = sum(x.extra == r.extra for x in got if x.doc_id == 100)
    assert max(full.values()) - min(full.values()) <= 1
    assert mixing.mixed_rows(docs.limit(0)).count() == 0


def test_quotas_are_highest_quotients(spark):
    """Seats equal a plain highest-quotient award, for every house on the way."""
    t = [("a", 0, 1000, 700.0), ("b", 1, 300, 260.0), ("c", 2, 90, 31.0), ("d", 3, 10, 9.0)]
    df = spark.createDataFrame(t, "src string, n int, source_size long, target double")
    got = {(r.src, r.shard): r.seats for r in mixing.quotas(df, block=10, shards=5).collect()}
    total, seats, have = round(sum(x[3] for x in t) / 10), {}, dict.fromkeys("abcd", 0)
    ends = [total * k // 5 for k in range(6)]
    for house in range(total):
        best = max((x for x in t if have[x[0]] < 2 * -(-x[2] // 10)), key=lambda x: (x[3] / (2 * have[x[0]] + 1), -x[1]))
        have[best[0]] += 1
        shard = next(k for k in range(5) if house < ends[k + 1])
        seats[best[0], shard] = seats.get((best[0], shard), 0) + 1
    assert {k: v for k, v in got.items() if v} == seats


def test_exact_groups(spark, odd, none):
    for primes, huge, compare in ((exact_dedup.PRIMES, exact_dedup.HUGE, exact_dedup.COMPARE), ((2, 3), exact_dedup.HUGE, 4), (exact_dedup.PRIMES, 1000, 512)):
        got = exact_dedup.exact_groups(odd, primes=primes, huge=huge, compare=compare).collect()
        groups = {}
        for i, t in texts(odd):
            groups.setdefault(t, []).append(i)
        want = []
        for i, t in texts(odd):
            keep = max((x for x in groups[t] if x is not None), default=None)
            want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup.exact_groups(none).count() == 0
    stay = exact_dedup.drop_exact(odd)
    assert stay.columns == odd.columns and sorted(t or "" for _, t in texts(stay)) == sorted({t for _, t in texts(odd)})
    rows = spark.createDataFrame([(5, "A", 1), (9, "A", 2), (5, "B", 3), (8, " ", 5), (8, " ", 4)], "doc_id long, text string, extra int")
    assert sorted(map(tuple, exact_dedup.drop_exact(rows).collect())) == [(5, "B", 3), (8, " ", 4), (9, "A", 2)]


def test_fingerprints_compose():
    a, b = b"some bytes" * 900, b"and more \xff" * 1000
    for base, prime in zip(exact_dedup.BASES, exact_dedup.PRIMES, strict=True):
        x, y, xy = exact_dedup.polynomial([a, b, a + b], base, prime)
        assert exact_dedup.combine(int(x), int(y), len(a), base, prime) == xy
        assert xy == sum((c + 1) * pow(base, i, prime) for i, c in enumerate(a + b)) % prime


def plain_weights(texts, rare=near_dedup.RARE):
    """tf-idf of five-word shingles by plain Python, from the docstring alone."""
    sets = []
    for t in texts:
        words = [w for w in re.split("[\x00- ]+", t) if w]
        sets.append(Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))))
    df = Counter(g for s in sets for g in s)

    def idf(g):
        return (1 - math.log(max(df[g] / len(sets), rare))) / (1 - math.log(rare))

    return [{g: n * idf(g) for g, n in s.items()} for s in sets]


def plain_jaccard(x, y):
    low = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
    return low / (sum(x.values()) + sum(y.values()) - low)


def brute_classes(docs, similar=0.8, rare=near_dedup.RARE):
    """doc_id -> smallest id of its class, from all pairs."""
    rows = [(i, t or "") for i, t in docs if i is not None]
    keys = sorted({t for _, t in rows})
    w = plain_weights(keys, rare)
    up = list(range(len(keys)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    total = [sum(x.values()) for x in w]
    for p in range(len(keys)):
        for q in range(p):
            if min(total[p], total[q]) >= similar * max(total[p], total[q]) - 1e-9 and plain_jaccard(w[p], w[q]) >= similar:
                up[top(p)] = top(q)
    at, least = {t: k for k, t in enumerate(keys)}, {}
    for i, t in rows:
        least[top(at[t])] = min(i, least.get(top(at[t]), i))
    return {i: least[top(at[t])] for i, t in rows}


@pytest.mark.parametrize("small", [32, 6])
def test_near_duplicates(spark, odd, none, small):
    """Classes equal those of comparing all pairs, with direct comparison and with further hashes for large buckets."""
    base = [f"w{i}" for i in range(60)]
    made = [(100 + k, " ".join(base[: 60 - k] + [f"z{k}_{j}" for j in range(k)])) for k in range(0, 30)]
    made += [(200 + k, " ".join(f"u{k}_{j}" for j in range(40))) for k in range(20)]
    docs = odd.select("doc_id", "text", "node", "key").unionByName(spark.createDataFrame(made, "doc_id long, text string"), allowMissingColumns=True)
    got = near_dedup.near_duplicates(docs, small=small).collect()
    want = brute_classes(texts(docs))
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert len(got) == docs.count() and all(r.kept == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, None, 1, True)]
    if small == 32:
        assert near_dedup.near_duplicates(none).count() == 0


def test_near_pairs_within_large_buckets(spark):
    """Pairs of similarity 0.802 in buckets of hundreds of texts that are 0.78 alike: each pair is a class."""
    base = " ".join(f"w{i}" for i in range(267))
    made = [(2 * k + j, " ".join([base, *(f"p{k}_{i}" for i in range(4)), *(f"q{k}_{j}_{i}" for i in range(33))])) for k in range(100) for j in (0, 1)]
    got = near_dedup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), rare=1.0).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: i // 2 * 2 for i in range(200)}


def test_near_family_of_hundreds(spark):
    """Edited copies of one text, 240 of them, among texts that share only a passage with them: every link of brute force is kept."""
    g = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    made = []
    for k in range(240):
        t = list(base)
        for at in g.choice(150, int(g.integers(1, 4)), replace=False):
            t[at] = f"e{k}_{at}"
        made.append((k, " ".join(t)))
    made += [(1000 + k, " ".join([*base[:60], *(f"o{k}_{i}" for i in range(90))])) for k in range(80)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == brute_classes(made)


def test_near_rows_that_repeat_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a, 1), (5, b, 2), (7, a + " x", 3), (5, a, 0), (None, a, 9), (None, None, 8), (3, b, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.class_size, r.kept) for r in got) == [(-1, -1, 1, True), (-1, -1, 1, True), (3, 3, 2, True), (5, 3, 2, False), (5, 5, 3, True), (5, 5, 3, True), (7, 5, 3, False)]
    assert sorted(r.extra for r in near_dedup.drop_near(docs).collect()) == [0, 4, 8, 9]


def test_weighted_sampling_estimates_similarity():
    g = np.random.default_rng(1)
    h = np.sort(g.integers(0, 1 << 63, 400, dtype=np.uint64))
    x, y = g.random(400) * 3 + 0.1, g.random(400) * 3 + 0.1
    s = near_dedup.Sampler(2048).sign(np.concatenate([h, h]), np.concatenate([x, y]), np.array([0, 400]))
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.05


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    out = packing.packed_documents(odd.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    for i, t in texts(odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, k * 4096, len(ids[k * 4096 : (k + 1) * 4096]), zlib.crc32(ids[k * 4096 : (k + 1) * 4096].tobytes())) for k in range(-(-len(ids) // 4096))]
    assert packing.packed_documents(none).count() == 0
    every = packing.packed_documents(odd).collect()  # null ids and repeats are packed too
    assert Counter((r.doc_id, r.piece) for r in every)[8, 0] == 2 and sum(r.piece == 0 for r in every) == 12 and sum(r.doc_id is None for r in every) == 1


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_packing_ids_equal_the_library(name):
    """Words apart or whole texts, as the vocabulary file allows; all texts of a small table and some odd ones."""
    import pyarrow.parquet as pq

    own = packing.encoder(name)
    whole = packing.WholeIds(name)
    odd = ["", " ", "Hello World, it's 12:30", "a\nb", "tab\there\r\n", "<|endoftext|> x<|startoftext|>", "I\u0307stanbul \u00b5 \u017f \u2028 \u200b", "\u1e9e\u00df \ufb01 e\u0301", "\U0001f600 \U0001f468\u200d\U0001f469", "x" * 5000, "don't DON'T 'S"]
    for t in odd + [x or "" for x in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]:
        assert own.text(t) == whole.text(t)


def test_configurations_are_optimal():
    """The linear programme's value equals that of all maximal configurations, by brute force on the dual: no configuration is dearer than 1."""
    from itertools import product

    for sizes, counts, capacity in (([51, 34, 26, 17], [90, 70, 40, 33], 100), ([60, 45, 35, 30, 20, 12], [11, 52, 31, 80, 7, 19], 100)):
        found = packing.configurations(sizes, counts, capacity)
        held = sum(np.array(use) * x for use, x in found)
        assert np.allclose(held, counts) and all(x > -1e-9 for _, x in found)
        prices = np.linalg.inv(np.stack([use for use, _ in found], axis=1)).sum(axis=0)
        assert sum(x for _, x in found) == pytest.approx(float(prices @ np.array(counts)))
        for use in product(*[range(capacity // w + 1) for w in sizes]):
            if np.dot(use, sizes) <= capacity:
                assert np.dot(prices, use) <= 1 + 1e-6


@pytest.mark.parametrize("seed", range(3))
def test_packing_is_tight(spark, seed):
    g = np.random.default_rng(seed)
    n = np.concatenate([g.integers(1, 100, 300), g.integers(1, 64, 300), np.full(100, 7)])
    df = spark.createDataFrame([(int(i), 0, int(x), "e") for i, x in enumerate(n)], "doc_id long, piece int, length long, extra string")
    out = packing.pack(df, capacity=100).collect()
    assert len(out) == len(n)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100
    large = np.sort(n)[::-1]
    bound = max(-(-n.sum() // 100), (large > 50).sum())
    assert len(by) <= 1.01 * bound + 2


def test_media_columns(spark, odd, none, tmp_path):
    rows, index = media_columns.store_texts(odd, str(tmp_path / "m"))
    facts = {r.digest: r for r in media_columns.with_payload_facts(index).collect()}
    got = rows.collect()
    assert len(got) == 12
    assert len(facts) == len({media_columns.pad(t.encode()) for _, t in texts(odd)})
    by = {r.doc_id: r for r in got}
    for i, t in texts(odd):
        p, f = media_columns.pad(t.encode()), facts[by[i].digest]
        assert (by[i].n_bytes, f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (f.width, f.height, f.bit_depth) == (192, len(p) // 192, 8) and f.feature == media_columns.feature(p)
    import tarfile

    names = [m.name for shard in {f.shard for f in facts.values()} for m in tarfile.open(shard)]
    assert sorted(names) == sorted(f"{d}.png" for d in facts)
    assert {r.digest: r.length for r in media_columns.dealt_by_bytes(index.select("digest", "shard", "offset", "length")).collect()} == {d: f.length for d, f in facts.items()}
    small = media_columns.store(spark.range(9).selectExpr("cast(id as string) as digest", "encode(repeat('m', 700), 'UTF-8') as media").coalesce(1), str(tmp_path / "s"), shard_bytes=2000).collect()
    assert len({r.shard for r in small}) >= 5 and sum(len(tarfile.open(p).getmembers()) for p in {r.shard for r in small}) == 9
    rows, index = media_columns.store_texts(none, str(tmp_path / "n"))
    assert rows.count() == 0 and index.count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/1", "<p>x</p>", 1), (2, "http://a/2\r\nX: y", "<p>x</p>", 2), (3, None, None, 3), (4, "http://ü/", "", 4), (5, "u", "ü" * 9000, 5), (None, "n", "<p>x</p>", 6), (5, "u", "ü" * 9000, 5)], "page_id long, url string, html string, digest int")
    folder = str(tmp_path / "w")
    warc_archive.write_archive(pages, folder)
    got = {str(r.page_id): r for r in warc_archive.read_archive(spark, folder).collect()}
    for r in pages.collect():
        b, x = (r.html or "").encode(), got[str(r.page_id)]
        assert (x.payload_bytes, x.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {"1": ("revisit", 2), "2": ("response", None), "3": ("revisit", 4), "4": ("response", None), "5": ("response", None), "None": ("revisit", 2)}
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    twice, more = str(tmp_path / "t"), spark.createDataFrame([(1, "u", "x", 3, 4), (1, "u", "y", 3, 4), (0, "u", "x", 3, 4)], "page_id long, url string, html string, payload int, size int")
    warc_archive.write_archive(more, twice)  # one id with two payloads, and clashing names
    assert sorted((r.page_id, r.payload_digest[:2], r.record_type, r.refers_to) for r in warc_archive.read_archive(spark, twice).collect()) == sorted((i, base64.b32encode(hashlib.sha1(t).digest()).decode()[:2], k, to) for i, t, k, to in ((1, b"x", "response", None), (1, b"y", "response", None), (0, b"x", "revisit", 1)))
    records = {r.page_id: bytes(r.record) for r in warc_archive.reconstruct(spark, folder).collect()}
    head, _, rest = records[2].partition(b"\r\n\r\n")
    assert rest == b"<p>x</p>\r\n\r\n" and b"\r\nX: y" not in head and b"Content-Length: 8" in head
    assert records[1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    bad = str(tmp_path / "bad")
    spark.createDataFrame([("0" * 64, b"other")], "digest string, payload binary").write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"{folder}/records").limit(1).selectExpr("page_id", f"'{'0' * 64}' as digest", "header").write.parquet(f"{bad}/records")
    with pytest.raises(Exception, match="does not match"):
        warc_archive.read_archive(spark, bad).collect()
    empty = str(tmp_path / "e")
    warc_archive.write_archive(pages.limit(0), empty)
    assert warc_archive.read_archive(spark, empty).count() == 0


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.query(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert auc(np.array([got[r.doc_id].score for r in labels]), np.array([r.quality for r in labels])) > 0.95


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels, sample=1200)
    y = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    held = [r for r in docs.collect() if r.doc_id in y]
    flags = np.zeros(1 << toxicity.BITS, bool)
    s = np.array([model.score(toxicity.gram_ids(r.text, flags)) for r in held])
    assert auc(s, np.array([y[r.doc_id] for r in held])) > 0.8  # about 4 % of the labels are wrong


def test_classifiers_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (5, 0, 1), (None, 1, 1), (5, 0, 1), (7, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for rows in (odd, none):
        t = toxicity.scored(rows, toxicity.train(rows, labels))
        q = quality.features(rows).select("doc_id", quality.score_features(quality.train(quality.features(rows), quality.labelled(labels)))("features").alias("score"))
        for df in (t, q):
            assert df.count() == rows.count() and df.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_ranked_is_gapless(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).selectExpr("case when id % 3 = 0 then null else id % 3 end as k", "id")
    out = ranked(df, ["k"], [F.col("id")], F.xxhash64("id"), 16).collect()
    by = {}
    for r in out:
        by.setdefault(r.k, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(out) == 500


def test_pipeline_stages(spark, sf):
    """Every stage against brute force on what the stage before kept."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    good = cp.materialise(cp.filter_quality(spark, docs, sf), "t1")
    assert good.columns == columns and 0 < good.count() <= docs.count()
    exact = cp.materialise(cp.dedup_exact(spark, good, sf), "t2")
    keep = {}
    for i, t in texts(good):
        keep[t] = max(keep.get(t, -1), i)
    assert exact.columns == columns and sorted(i for i, _ in texts(exact)) == sorted(keep.values())
    near = cp.materialise(cp.dedup_near(spark, exact, sf), "t3")
    assert near.columns == columns and {i for i, _ in texts(near)} == set(brute_classes(texts(exact)).values())
    mixed = cp.materialise(cp.mix_sources(spark, near, sf), "t4")
    took = {r.doc_id: (r.taken // r["size"], -(-r.taken // r["size"])) for r in mixing.mix(near).collect() if r["size"]}
    times = Counter(i for i, _ in texts(mixed))
    assert mixed.columns == columns and all(lo <= times[i] <= hi for i, (lo, hi) in took.items()) and times.keys() <= took.keys()
    assert sum(lo != hi for lo, hi in took.values()) <= 2 * near.select("source").distinct().count()
    packed = cp.pack_sequences(spark, mixed, sf).collect()
    whole = Counter()
    for r in packed:
        whole[r.doc_id] += r.piece == 0
    assert whole == Counter(i for i, _ in texts(mixed))


@pytest.fixture(scope="module")
def folders(spark, odd, none, tmp_path_factory):
    """Tables of odd rows and empty tables, as the queries read them."""
    out = []
    for name, docs in (("odd", odd), ("none", none)):
        d = str(tmp_path_factory.mktemp(name))
        docs.write.parquet(f"{d}/documents.parquet")
        labels = [(1, 1, 0), (2, None, None), (5, 0, 1), (None, 1, 1), (5, 0, 1), (7, 1, 0), (9, 0, 1)]
        spark.createDataFrame(labels if name == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        out.append((d, docs))
    return out


def test_queries_on_odd_and_empty_tables(spark, folders):
    """The thin queries: all rows, sizes and check sums of every text, scores in range, equal texts alike."""
    for d, docs in folders:
        rows = sorted((i if i is not None else -1, t) for i, t in texts(docs))
        got = sharding.query(spark, d).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None) for i, t in rows)
        assert all(0 <= r.shard < 8 for r in got)
        for module, modulus, remainder in ((toxicity, 5, 0), (quality, 3, 1)):
            got = module.query(spark, d).collect()
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == [i for i, _ in rows]
            assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % modulus == remainder) for r in got)
            of = dict(rows)
            same = {}
            for r in got:
                same.setdefault(of[-1 if r.doc_id is None else r.doc_id], set()).add(r.score)
            assert all(len(s) == 1 for s in same.values())


def test_pipeline_on_odd_and_empty_tables(spark, folders):
    """Every stage keeps the columns and gives rows of its input only; the whole ends in pieces."""
    import corpus_pipeline as cp

    for d, docs in folders:
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert out.columns == docs.columns and {t for _, t in texts(out)} <= {t for _, t in texts(docs)}
        assert cp.run(spark, d).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
