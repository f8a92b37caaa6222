"""Packing token pieces into sequences by linear grouping and best fit.

Everything that is decided is decided on histograms, whose size is bounded by the
sequence length and not by the data; rows are then placed by rank arithmetic.

1. Pieces longer than an eighth of a sequence are sorted by length and cut into
   groups of equal cardinality; each is rounded up to its group's largest length,
   which leaves a few sizes.
2. How often each configuration of those sizes is used is a linear programme: the
   fewest sequences that cover all counts.  It is solved by column generation: a
   knapsack over the current prices finds the configuration that improves most,
   until none does.  Its solution is rounded down, and what is left is packed
   largest item first, completed by the subset of the other sizes that fills the
   sequence best.  Several numbers of groups are tried; the gaps and the small
   pieces of each plan follow from the histograms, and the plan with the fewest
   sequences is taken.
3. Actual pieces replace the rounded ones: the piece of rank r in the sorted order
   takes the slot of that rank.  True gaps are then summed per sequence.
4. Small pieces go, longest first, into the smallest gap that holds them, as runs
   of ranks against runs of sequences with equal gaps; new sequences open when no
   gap is wide enough.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waygraph.llm.common import bounded_batches, parts_for, ranked, vocabulary
from waygraph.plans.stages import materialise, table

CAPACITY = 4096
#: Numbers of groups that are tried; up to OPTIMISED of them also with optimised configurations.
GROUPS = (8, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192)
OPTIMISED = 48
#: Words whose ids a Python worker keeps, in each of two generations.
CACHE_WORDS = 400_000
#: What a vocabulary file must say of itself for words to be encoded apart; the split pattern is read from the file.
NORMALISER = ["NFC", "Replace", "Lowercase"]
#: Characters that this normaliser leaves alone but for lower case, one to one.
PLAIN = re.compile("[!-~¡-¬®-įı-ſ]+")
_ENCODERS: dict[str, object] = {}


def word_pattern(path: str) -> str | None:
    """The split pattern of a vocabulary whose words can be encoded apart: lower case, white space
    dropped by the pattern, bytes mapped one to one, no post-processing; None for any other file."""
    if not path.endswith(".json"):
        return None
    with open(path) as f:
        d = json.load(f)
    n, p = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
    steps = p.get("pretokenizers") or [{}, {}]
    known = (
        [x["type"] for x in n.get("normalizers", [])] == NORMALISER
        and n["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
        and n["normalizers"][1].get("content") == " "
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and steps[0].get("behavior") == "Removed"
        and steps[0].get("invert") is True
        and not steps[1].get("add_prefix_space")
        and not steps[1].get("use_regex")
        and d.get("post_processor") is None
        and d.get("model", {}).get("type") == "BPE"
        and all(x["content"].startswith("<|") and not x["lstrip"] and not x["rstrip"] for x in d.get("added_tokens", []))
    )
    pattern = steps[0].get("pattern", {}).get("Regex") if known else None
    return pattern if pattern and not regex.search(pattern, " \n\t") else None


class WholeIds:
    """Ids of whole texts by the library, for any vocabulary file."""

    def __init__(self, name: str):
        path = vocabulary(name)
        if path.endswith(".model"):
            import sentencepiece

            self.encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.no_truncation()
            whole.no_padding()
            self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids

    def text(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()


class WordIds(dict):
    """word -> its ids as little-endian 32-bit bytes, filled on demand and bounded.

    The vocabulary drops white space and never merges across it, so a text's ids
    are those of its words one after the other.  Plain words are split here and
    merged by the library's model; all others go through the library whole.
    """

    def __init__(self, name: str, pattern: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.words = regex.compile(pattern)
        self.whole = Tokenizer.from_file(vocabulary(name))
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.old: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _encode(self, word: str) -> bytes:
        if not word:
            return b""
        if "<|" in word or not PLAIN.fullmatch(word):
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        low = word.lower()
        if low != word:
            return self[low]
        if word.isalpha():
            return self._merge([word])
        if word[-1] in ".,;:!?|" and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1]]
        return self._merge(self.words.findall(word))

    def _merge(self, parts: list[str]) -> bytes:
        ids = []
        for p in parts:
            p = p if p.isascii() else "".join(map(self.chars.__getitem__, p.encode()))
            ids += [t.id for t in self.model.tokenize(p)]
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        out = self.old.get(word)
        if out is None:
            out = self._encode(word)
        if len(word) <= 64:
            self[word] = out
        return out

    def text(self, text: str) -> bytes:
        """Ids of a whole text."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(name: str) -> WordIds | WholeIds:
    """One encoder for each vocabulary and Python worker; words apart only where the file allows it."""
    if name not in _ENCODERS:
        pattern = word_pattern(vocabulary(name))
        _ENCODERS[name] = WordIds(name, pattern) if pattern else WholeIds(name)
    return _ENCODERS[name]


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = 1, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` as bytes), at least one row per row of ``docs``.

    A document is the ids of its whole text (null: empty) and then ``end``; only
    longer ones are cut, into pieces of ``capacity`` ids.  Rows that repeat give
    repeated pieces; ids may be null; an empty table gives none.  Other columns are
    not read.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    last = np.array([end], "<u4").tobytes()

    def cut(batches):
        ids = encoder(tokenizer)
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                data = ids.text(t) + last
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    rows.append((d, k, at // 4, len(own) // 4, zlib.crc32(own), own)[: 5 + with_ids])
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(cut, schema)


def _completion(room: int, sizes: list[int], counts: list[int]) -> list[int]:
    """How many of each size fill ``room`` best, larger sizes first among equals."""
    reach: list[tuple[int, int, int] | None] = [None] * (room + 1)  # how a sum was first reached: (sum before, size, uses)
    reach[0] = (0, -1, 0)
    for i, (w, c) in enumerate(zip(sizes, counts, strict=True)):
        if w > room or not c:
            continue
        for s in [s for s in range(room + 1) if reach[s] is not None]:
            for uses in range(1, min(c, (room - s) // w) + 1):
                if reach[s + uses * w] is None:
                    reach[s + uses * w] = (s, i, uses)
        if reach[room] is not None:
            break
    s = max(x for x in range(room + 1) if reach[x] is not None)
    used = [0] * len(sizes)
    while s:
        s, i, uses = reach[s]
        used[i] += uses
    return used


def _dearest(sizes: list[int], prices: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration (uses of each size) of the highest price that fits, by a knapsack over sums."""
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for i, (w, y) in enumerate(zip(sizes, prices.tolist(), strict=True)):
        if y <= 0:
            continue
        for _ in range(capacity // w):  # one more use of this size each time
            better = value[:-w] + y > value[w:] + 1e-12
            if not better.any():
                break
            at = np.flatnonzero(better) + w
            value[at] = value[at - w] + y
            last[at] = i
    use, s = np.zeros(len(sizes)), int(value.argmax())
    while s > 0 and last[s] >= 0:
        use[last[s]] += 1
        s -= sizes[last[s]]
    return use


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used in the fewest (fractional) sequences that hold ``counts`` of ``sizes``.

    Column generation on the cutting-stock programme, by the revised simplex method
    from configurations of one size each.
    """
    basis = np.diag([float(capacity // w) for w in sizes])
    need = np.array(counts, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        use, prices = inverse @ need, inverse.sum(axis=0)
        new = _dearest(sizes, prices, capacity)
        if prices @ new <= 1 + 1e-7:
            break
        step = inverse @ new
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    return [(basis[:, j], float(x)) for j, x in enumerate(np.linalg.inv(basis) @ need)]


def large_plan(hist: dict[int, int], capacity: int, groups: int, optimised: bool = False) -> tuple[np.ndarray, int]:
    """Runs over the ranks of the large pieces, longest first: (first rank, first sequence, slot); and the sequences used."""
    total = sum(hist.values())
    if not total:
        return np.zeros((0, 3), np.int64), 0
    lengths = sorted(hist, reverse=True)
    ends = np.cumsum([hist[x] for x in lengths])
    groups = min(groups, total)
    cuts = [total * j // groups for j in range(groups + 1)]
    sizes = [lengths[int(np.searchsorted(ends, c, side="right"))] for c in cuts[:-1]]  # the largest length of each group
    left = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    taken = list(cuts[:-1])
    runs, sequence = [], 0

    def place(use, times):
        nonlocal sequence
        slot = 0
        for i, n in enumerate(use):
            for _ in range(n):
                runs.append((taken[i], sequence, slot))
                taken[i] += times
                left[i] -= times
                slot += 1
        sequence += times

    if optimised:
        for use, often in configurations(sizes, left, capacity):
            use = [int(round(x)) for x in use]
            times = min([int(often + 1e-6), *(left[i] // n for i, n in enumerate(use) if n)])
            if times > 0 and any(use):
                place(use, times)
    for j in range(groups):
        while left[j]:
            others = [0] * (j + 1) + left[j + 1 :]
            others[j] = left[j] - 1
            use = _completion(capacity - sizes[j], sizes[j:], others[j:])
            use[0] += 1
            use = [0] * j + use
            place(use, min(left[i] // n for i, n in enumerate(use) if n))
    return np.array(sorted(runs), np.int64), sequence


def plan_gaps(hist: dict[int, int], runs: np.ndarray, capacity: int) -> dict[int, int]:
    """Gap -> sequences when pieces of the true lengths take the slots of their ranks."""
    if not len(runs):
        return {}
    lengths = np.array(sorted(hist, reverse=True), np.int64)
    ends = np.cumsum([hist[int(x)] for x in lengths])
    stop = np.append(runs[1:, 0], ends[-1])
    slots: dict[int, list[int]] = {}
    times: dict[int, int] = {}
    for (first, sequence, _), end in zip(runs.tolist(), stop.tolist(), strict=True):
        slots.setdefault(sequence, []).append(first)
        times[sequence] = end - first
    gaps: dict[int, int] = {}
    for sequence, firsts in slots.items():
        n = times[sequence]
        cuts = np.unique(np.concatenate([[0, n], *[ends[np.searchsorted(ends, f, "right") : np.searchsorted(ends, f + n, "left")] - f for f in firsts]]))
        held = sum(lengths[np.searchsorted(ends, f + cuts[:-1], "right")] for f in firsts)
        for g, m in zip((capacity - held).tolist(), np.diff(cuts).tolist(), strict=True):
            gaps[g] = gaps.get(g, 0) + m
    return gaps


def best_plan(hist: dict[int, int], capacity: int, groups: tuple[int, ...]) -> np.ndarray:
    """The large plan whose sequences, after small pieces have filled its gaps, are fewest.

    Plans with optimised configurations come first; a greedy one is taken only if it is strictly better.
    """
    limit = capacity // 8
    large, small = ({k: v for k, v in hist.items() if (k > limit) == side} for side in (True, False))
    plans = [large_plan(large, capacity, n, True)[0] for n in groups if n <= OPTIMISED]
    plans += [large_plan(large, capacity, n)[0] for n in groups]
    return min(plans, key=lambda runs: small_plan(small, plan_gaps(large, runs, capacity), capacity)[1])


def small_plan(hist: dict[int, int], gaps: dict[int, int], capacity: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], int]:
    """Length -> (first ranks, first sequences) of runs, and all sequences; those count from 0 by ascending gap, new ones follow.

    Best fit, longest first: a run of pieces of one length meets a run of
    sequences with one gap.
    """
    classes: dict[int, list[tuple[int, int]]] = {}
    at = 0
    for g in sorted(gaps):
        classes[g] = [(at, gaps[g])]
        at += gaps[g]
    wide = sorted(classes)
    out = {}
    for w in sorted(hist, reverse=True):
        left, rank, firsts, seqs = hist[w], 0, [], []
        while left:
            i = bisect.bisect_left(wide, w)
            if i == len(wide):
                n = -(-left // (capacity // w))
                classes[capacity] = [(at, n)]
                wide.append(capacity)
                at += n
                continue
            g = wide[i]
            first, n = classes[g].pop()
            m = min(n, left)
            if m < n:
                classes[g].append((first + m, n - m))
            elif not classes[g]:
                del classes[g]
                wide.pop(i)
            firsts.append(rank)
            seqs.append(first)
            rank += m
            left -= m
            if g - w not in classes:
                classes[g - w] = []
                bisect.insort(wide, g - w)
            classes[g - w].append((first, m))
        out[w] = (np.array(firsts, np.int64), np.array(seqs, np.int64))
    return out, at


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, length: str = "length", identity: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """All columns of ``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    Lengths are from 1 to ``capacity``; null or other lengths raise an error.
    ``identity`` spreads the rows of a frequent length over tasks and orders
    them; rows that repeat are packed as often as they occur.  An empty table gives
    an empty result; columns that this adds are replaced if they are there already.
    """
    own = pieces.columns
    parts = parts_for(pieces.count())
    rows = pieces.select(F.struct(*own).alias("row"), F.col(length).cast("int").alias("_len"), *[F.col(c).alias(f"_i{n}") for n, c in enumerate(identity)])
    ids = [F.col(f"_i{n}") for n in range(len(identity))]
    rows = materialise(ranked(rows, ["_len"], ids, F.xxhash64(*ids), parts, "_rank"), "pack-ranks")
    hist = {r["_len"]: r["count"] for r in rows.groupBy("_len").count().collect()}  # at most ``capacity`` lengths
    if any(x is None or not 1 <= x <= capacity for x in hist):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    limit = capacity // 8
    large_hist = {k: v for k, v in hist.items() if k > limit}
    runs = best_plan(hist, capacity, groups)
    before = np.zeros(capacity + 2, np.int64)
    for x in range(capacity - 1, limit - 1, -1):
        before[x] = before[x + 1] + large_hist.get(x + 1, 0)

    @F.pandas_udf("seq long, slot int")
    def place_large(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = before[n.to_numpy()] + rank.to_numpy()
        i = np.searchsorted(runs[:, 0], r, side="right") - 1
        return pd.DataFrame({"seq": runs[i, 1] + r - runs[i, 0], "slot": runs[i, 2].astype(np.int32)})

    large = rows.filter(F.col("_len") > limit).withColumn("_p", place_large("_len", "_rank")).select("row", "_len", "_rank", F.col("_p.seq").alias("_bin"), F.col("_p.slot").alias("_slot"))
    large = materialise(large, "pack-large")
    bins = large.groupBy("_bin").agg((F.lit(capacity) - F.sum("_len")).cast("int").alias("_gap"))
    bins = materialise(ranked(bins, ["_gap"], [F.col("_bin")], F.xxhash64("_bin"), parts, "_r"), "pack-gaps")
    gaps = {r["_gap"]: r["count"] for r in bins.groupBy("_gap").count().collect()}  # at most ``capacity`` gaps
    starts, at = [(-1, 0)], 0
    for g in sorted(gaps):
        starts.append((g, at))
        at += gaps[g]
    first = bins.sparkSession.createDataFrame(starts, "_gap int, _first long")
    bins = bins.join(F.broadcast(first), "_gap").select("_bin", (F.col("_first") + F.col("_r")).alias("sequence_id"))
    plan, _ = small_plan({k: v for k, v in hist.items() if k <= limit}, gaps, capacity)

    @F.pandas_udf("long")
    def place_small(n: pd.Series, rank: pd.Series) -> pd.Series:
        n, r = n.to_numpy(), rank.to_numpy()
        out = np.empty(len(n), np.int64)
        for w in np.unique(n):
            own = n == w
            firsts, seqs = plan[int(w)]
            i = np.searchsorted(firsts, r[own], side="right") - 1
            out[own] = seqs[i] + r[own] - firsts[i]
        return pd.Series(out)

    small = rows.filter(F.col("_len") <= limit).select("row", "_len", "_rank", place_small("_len", "_rank").alias("sequence_id"), F.lit(1 << 20).alias("_slot"))
    large = large.join(bins, "_bin").select("row", "_len", "_rank", "sequence_id", "_slot")
    w = Window.partitionBy("sequence_id").orderBy("_slot", F.desc("_len"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    out = large.unionByName(small).withColumn("offset", F.coalesce(F.sum("_len").over(w), F.lit(0)).cast("long"))
    return out.select(*[F.col("row")[c].alias(c) for c in own if c not in ("sequence_id", "offset")], "sequence_id", "offset")


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of all documents and their places, as ``token_pieces`` and ``pack`` define them for odd rows."""
    return pack(materialise(token_pieces(docs), "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents packed into sequences of 4096 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))
