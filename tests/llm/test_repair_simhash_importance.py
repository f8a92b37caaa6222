"""Conversation repair, SimHash components and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import xxhash

from waygraph.llm import conversations, importance, simhash

ROWS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


# --- conversations ---------------------------------------------------------------------------------------------------


def cheapest(rows):
    """(cost, edits) of rows (initial, must be deleted, truncated), by recursion over whole strings."""

    @lru_cache(None)
    def best(i, state, inserts):
        into = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        found = []
        if inserts < 3:
            cost, edits = best(i, into, inserts + 1)
            found.append((cost + 2, "I" + edits))
        if i == len(rows):
            return min(found + ([(0, "")] if state in ("", "a") else []), default=(math.inf, ""))
        initial, gone, cut = rows[i]
        cost, edits = best(i + 1, state, 0)
        found.append((cost + 3, "D" + edits))
        if not gone:
            cost, edits = best(i + 1, into, 0)
            found.append((cost + 2 + cut, "R" + edits))
            if initial == into or (initial == "s" and state == ""):
                cost, edits = best(i + 1, initial, 0)
                found.append((cost + cut, "K" + edits))
        return min(found)

    return best(0, "", 0)


def report(rows):
    """The expected report of rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds, counts = set(), [], Counter()
    for _, role, text in rows:
        core = text.rstrip(SPACE)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, edits = cheapest(tuple(kinds))
    lines, last, it = [], "", iter(rows)
    for e in edits:
        _, role, text = next(it) if e != "I" else (None, "", "")
        if e != "D":
            role = role if e == "K" else "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out.setdefault(conv, [])
        out[conv] += [(turn, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    return out


def drawn(seed, conversations=60):
    g = random.Random(seed)
    rows = []
    for c in [None, *range(conversations)]:
        for k in range(g.choice([0, 1, 2, 3, 5, 8, 13])):
            turn = g.choice([k, k, k, k + 1, None, k * 3])
            role = g.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "assistant"])
            rows.append((c, turn, role, g.choice(["Fine.", "Fine.", "What", "", " \t", None, f"Word {k}!", f"Word {k}\n", "日本。 ?", "x."])))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_conversation_repair(spark, monkeypatch, small):
    """Every figure of random conversations, from memory and through spilled pieces."""
    if small:
        monkeypatch.setattr(conversations, "CHUNK", 3)
    rows = drawn(5)
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as cid", "2 as live", "'x' as kind", "3 as cost", "true as blank")
    want = damage(rows)
    names = df.select("conv_id")
    got = conversations.repaired(conversations.damaged(df), names, messages=True).collect()
    reports = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got if r.kind == "report"}
    assert len(reports) == sum(r.kind == "report" for r in got) == len(want)
    for c, own in want.items():
        assert reports[c] == report(own), c
        lines = sorted((r.number, f"{r.role}:{r.text}") for r in got if r.kind == "message" and r.conv_id == c)
        assert [n for n, _ in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(x for _, x in lines).encode()).hexdigest() == reports[c][-1]
    assert conversations.repaired(spark.createDataFrame([], ROWS), spark.createDataFrame([], ROWS)).count() == 0


def test_conversation_of_many_batches(spark, monkeypatch):
    """One conversation of thousands of rows beside small ones: several batches, pieces and a repeated message of a third of all rows."""
    monkeypatch.setattr(conversations, "CHUNK", 700)
    rows = [(1, k, "user" if k % 2 else "assistant", "Same." if k % 3 == 0 else f"Text {k}" + "." * (k % 5 > 0)) for k in range(6000)] + drawn(9, 10)
    df = spark.createDataFrame(rows, ROWS)
    got = {r.conv_id: r for r in conversations.repaired(df).collect()}
    own = {}
    for c, t, role, text in rows:
        own.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    for c, rows in own.items():
        if c == 1:  # too deep for the recursion: the parts that need none
            assert got[c].duplicate == 1998 and got[c].gaps == 0 and len(got[c].audit.replace("I", "")) == 6000
        else:
            r = got[c]
            assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == report(rows)
    # the same rows, traced from memory, give the same report
    monkeypatch.setattr(conversations, "CHUNK", 100_000)
    again = {r.conv_id: r for r in conversations.repaired(df).collect()}
    assert again == got


def test_conversation_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: report(own) for c, own in damage(rows).items()}
    got = conversations.query(spark, sf).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


# --- simhash ---------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, differ=3):
    """Smallest fingerprint of each component, by all pairs in blocks."""
    names = np.array(sorted(set(fps)), np.uint64)
    root = list(range(len(names)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(names)):
        for j in np.flatnonzero(np.bitwise_count(names[i + 1 :] ^ names[i]) <= differ) + i + 1:
            root[top(i)] = top(j)
    return {int(n): top(i) for i, n in enumerate(names)}


def expected(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = plain_components([f for _, f in fps])
    least = {}
    for i, f in fps:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    return sorted((str(i), f"{f:016x}", least.get(comp[f])) for i, f in fps)


def test_every_linked_pair_shares_a_mask():
    """Under each level every pair of 3 differences or fewer is equal under a mask whose chain holds, and masks extend their parent."""
    g = random.Random(3)
    for level in (1, 2, 3, 4):
        table = simhash.masks(level)
        assert len(table) == (8, 24, 96, 384)[level - 1]
        up = simhash.masks(level - 1)
        assert all(m & up[p][0] == up[p][0] for m, _, p, _ in table)
        for _ in range(1500):
            x = sum(1 << b for b in g.sample(range(64), g.choice([1, 2, 3, 3, 3])))

            def chain(s):
                return all(sum((x >> 16 * ((s + k) % 4) & 0xFFFF).bit_count() for k in range(n)) <= n * 3 // 4 for n in (1, 2, 3, 4))

            assert any(x & m == 0 and chain(s) for m, s, _, _ in table)


def test_simhash_small_cases(spark):
    long = "many words make long texts " * 20000
    rows = [(1, "A b c d"), (2, "a B c d"), (3, ""), (4, None), (5, " \t\n"), (6, "one two"), (7, long), (8, long + "x"), (None, "a b c d"), (None, "nobody else has this"), (9, "Übung É é   x y"), (9, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as copies", "3 as mask", "4 as n")
    got = simhash.simhash_components(df).collect()
    assert sorted((str(r.doc_id), f"{r.fp % 2**64:016x}", r.component_id) for r in got) == expected(rows)
    assert simhash.simhash_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [simhash.PAIRS, 30, 0])
def test_simhash_links_are_whole(spark, pairs):
    """Dense families, chains of links and lone fingerprints; small limits send buckets down to the last level."""
    g = random.Random(11)
    fps = {g.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        c = g.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in g.sample(range(64), g.choice([1, 2, 3, 4, 5, 6, 7]))) for _ in range(120)} | {c}
    x = g.getrandbits(64)
    for _ in range(60):  # a chain whose ends are far apart
        x ^= sum(1 << b for b in g.sample(range(64), 3))
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, 1) for f in fps], "fp long, copies long")
    links = simhash.links_of(df, pairs).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in links)
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for r in links:
        root[top(r.a % 2**64)] = top(r.b % 2**64)
    want = plain_components(fps)
    pairs_of = lambda c: {frozenset(f for f in fps if c(f) == k) for k in {c(f) for f in fps}}
    assert pairs_of(top) == pairs_of(want.get)


def test_simhash_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.query(spark, sf).collect()) == expected(rows)


# --- importance ------------------------------------------------------------------------------------------------------


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]).encode() for n in (1, 2) for i in range(len(words) - n + 1)]


def plain_resampling(docs, target):
    doc = [(i, *plain_features(t)) for i, t in docs]
    s, t = (Counter(zlib.crc32(f) % 10000 for fs in many for f in fs) for many in ([f for _, _, f in doc], [plain_features(x)[1] for x in target]))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, words, fs in doc:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in (zlib.crc32(f) % 10000 for f in fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = k
    return sorted(tuple(map(str, r[:5])) for r in out)


def test_prefix_crcs():
    """Every n-gram's CRC equals the CRC of its bytes, also for words longer than the shift tables and for runs of four."""
    g = random.Random(1)
    texts = ["", " .,", "One, two-three  FOUR", "É日本 x" * 40, "w" * 5000 + " " + "é" * 700 + " a b", " ".join("x" * g.randrange(1, 300) for _ in range(200)), "a"]
    crcs, of, words = importance.ngram_crcs([t.encode() for t in texts], 4)
    want = []
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        assert words[k] == len(w)
        want += [(k, zlib.crc32(" ".join(w[i : i + n]).encode())) for n in range(1, 5) for i in range(len(w) - n + 1)]
    assert sorted(zip(of.tolist(), crcs.tolist())) == sorted(want)
    assert len(importance.ngram_crcs([])[0]) == 0


def test_resampling_small_cases(spark):
    g = random.Random(2)
    word = lambda: g.choice(["alpha", "Beta", "gamma", "delta9", "é", "日本", "x"])
    rows = [(k, " ".join(word() for _ in range(g.choice([5, 19, 20, 21, 60])))) for k in range(150)] + [(200, None), (201, ""), (202, " .-"), (203, "long " * 30000), (None, "alpha " * 30)]
    rows += [(-7, "alpha " * 25), (1 << 62, "Beta, " * 25)]
    target = ["alpha beta alpha beta", None, "gamma"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as bucket", "3 as n", "4 as rank")
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resampled(docs, aims).collect()
    assert sorted(tuple(map(str, r)) for r in got) == plain_resampling(rows, target)
    assert importance.resampled(docs.limit(0), aims).count() == 0
    assert importance.resampled(docs, aims.limit(0)).count() == len(rows)


def test_equal_scores_are_ranked_by_id(spark):
    """A score that most rows share, dealt over ranges of ids."""
    rows = [(k * 37 % 1000, 50, 5 if k % 3 else 6, 50) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, score long, n_words long").withColumn("weight", importance.F.lit(0).cast("long"))
    got = {r.doc_id: r["rank"] for r in importance._ranked(df, 50, 20).collect()}
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert got == {r[0]: (k if k <= 500 else None) for k, r in enumerate(order, 1)}


def test_importance_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = importance.query(spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and all(t == "bigint" for _, t in got.dtypes)
    assert sorted(tuple(map(str, r)) for r in got.collect()) == plain_resampling(rows, target)
