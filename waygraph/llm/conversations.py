"""Conversation structure repair by secondary-sorted streaming.

Rows are repartitioned by conversation and sorted by turn; one ``mapInPandas`` pass
carries the state of a dynamic programme across Arrow batches.  A repaired
conversation reads as nothing, or as an optional system message and then pairs of a
user and an assistant message.  The programme has four states (nothing yet, after the
system message, after a user, after an assistant message); each holds the least cost
of the rows so far and the order of its cheapest edits among those of the other
states, so that ties go to the edits whose initials come first in ASCII.

A row adds three bytes of backpointers.  A conversation of up to ``HELD`` bytes and
``CHUNK`` rows is traced and repaired from memory when it ends.  A larger one spills its
backpointers as rows of a shared table, ``CHUNK`` rows to a piece; a second pass over such
conversations alone reads the pieces last first, and then streams the rows once more.

Messages that repeat earlier ones are found by an aggregate over digests of conversation,
role and text, so no set of seen messages is held in a task.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import bounded_batches, join_groups, maybe_in
from waygraph.plans.stages import materialise, table

#: Bytes and rows of a conversation that are held in memory; rows of one spilled piece.
HELD, CHUNK = 4 << 20, 100_000
#: Costs of the edits.
RELABEL, DELETE, INSERT, CUT = 2, 3, 2, 1
#: A state this much above the cheapest one can never win: the cheapest reaches whatever follows with up to three inserts or deletions.
BEYOND = 8
#: White space of the tests for blank and truncated texts.
SPACE = " \t\n\x0b\x0c\r"

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_KEPT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
_CLOSE = {_START: 0, _ASSISTANT: 0, _USER: 1, _SYSTEM: 2}
_LETTERS = "DKR"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class Programme:
    """Steps of the dynamic programme; a step depends on the kind of row and a bounded set of relative costs, so steps are kept."""

    def __init__(self):
        self.states = [((0, None, None, None), (0, None, None, None))]
        self.numbers = {self.states[0]: 0}
        self.steps: dict = {}

    def step(self, state: int, initial: str, gone: bool, cut: bool) -> tuple[int, int, bytes]:
        """(next state, cost added to all, backpointers) for a row; ``gone`` rows must be deleted, ``cut`` ones cost when they stay."""
        key = (state, initial, gone, cut)
        if key not in self.steps:
            self.steps[key] = self._make(*key)
        return self.steps[key]

    def _make(self, state, initial, gone, cut):
        costs, ranks = self.states[state]
        best: dict = {}
        for p in range(4):
            if costs[p] is None:
                continue
            q = p
            for k in range(3):
                options = [(q, DELETE, "D")]
                if not gone:
                    if (q, initial) in _KEPT:
                        options.append((_KEPT[q, initial], CUT * cut, "K"))
                    options.append((_NEXT[q], RELABEL + CUT * cut, "R"))
                for to, cost, letter in options:
                    found = (costs[p] + k * INSERT + cost, ranks[p], "I" * k + letter, p, k)
                    if to not in best or found < best[to]:
                        best[to] = found
                q = _NEXT[q]
        low = min(x[0] for x in best.values())
        best = {q: x for q, x in best.items() if x[0] - low <= BEYOND}
        order = sorted(best, key=lambda q: best[q][1:3])
        code = 0
        for q, (_, _, edits, p, k) in best.items():
            code |= (p | k << 2 | _LETTERS.index(edits[-1]) << 4) << 6 * q
        after = (tuple(best[q][0] - low if q in best else None for q in range(4)), tuple(order.index(q) if q in best else None for q in range(4)))
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
        return self.numbers[after], low, code.to_bytes(3, "little")

    def close(self, state: int) -> tuple[int, int, int]:
        """(last state, cost added, inserts at the end) of the cheapest way to end here."""
        costs, ranks = self.states[state]
        cost, _, q = min((costs[q] + INSERT * _CLOSE[q], ranks[q], q) for q in range(4) if costs[q] is not None)
        return q, cost, _CLOSE[q]


def trace(codes: bytes, last: int) -> tuple[str, int]:
    """The edits that backpointers give from their last state, and the state before them."""
    out = []
    for i in range(len(codes) - 3, -1, -3):
        c = int.from_bytes(codes[i : i + 3], "little") >> 6 * last
        out.append("I" * (c >> 2 & 3) + _LETTERS[c >> 4 & 3])
        last = c & 3
    return "".join(reversed(out)), last


class _Repaired:
    """Applies edits in order: a digest of the repaired lines, and the lines if asked for."""

    def __init__(self, lines: bool):
        self.sha, self.state, self.n, self.lines = hashlib.sha256(), _START, 0, [] if lines else None

    def _add(self, role: str, text: str, edit: str) -> None:
        self.sha.update(f"{chr(10) * (self.n > 0)}{role}:{text}".encode())
        if self.lines is not None:
            self.lines.append((self.n, role, text, edit))
        self.n += 1

    def insert(self) -> None:
        self.state = _NEXT[self.state]
        self._add("user" if self.state == _USER else "assistant", "", "I")

    def row(self, edit: str, role: str, text: str) -> None:
        if edit == "K":
            self.state = _KEPT[self.state, role[:1]]
            self._add(role, text, edit)
        elif edit == "R":
            self.state = _NEXT[self.state]
            self._add("user" if self.state == _USER else "assistant", text, edit)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_OUT = "kind string, cid string, number long, codes binary, last int, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string, role string, text string"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


class _Conversation:
    """The rows of one conversation, as they come."""

    def __init__(self, cid):
        self.cid, self.state, self.cost, self.codes, self.held, self.bytes = cid, 0, 0, bytearray(), [], 0
        self.pieces, self.count = 0, dict.fromkeys(_COUNTS, 0)
        self.turns, self.low, self.last_turn, self.before, self.initial = 0, None, None, None, None

    def add(self, programme, has_turn, turn, role, text, blank, cut, later, message) -> None:
        if has_turn and turn != self.last_turn:
            self.turns, self.last_turn, self.low = self.turns + 1, turn, turn if self.low is None else self.low
        again = not blank and (later or message == self.before)
        self.before, initial = message, role[:1]
        self.count["blank" if blank else "duplicate" if again else "truncated"] += blank or again or cut
        if self.initial is not None and (self.initial, initial) not in _LEGAL:
            self.count["illegal"] += 1
        self.initial = initial
        self.state, cost, code = programme.step(self.state, initial if initial in ("s", "u", "a") else "", blank or again, cut)
        self.cost += cost
        self.codes += code
        if not self.pieces:
            self.held.append((role, text))
            self.bytes += len(role) + len(text)

    def full(self) -> bool:
        return len(self.codes) >= 3 * CHUNK or (self.bytes > HELD and not self.pieces)

    def spill(self) -> dict:
        out = {"kind": "piece", "cid": self.cid, "number": self.pieces, "codes": bytes(self.codes)}
        self.pieces, self.codes, self.held = self.pieces + 1, bytearray(), []
        return out

    def end(self, programme, lines: bool):
        last, more, inserts = programme.close(self.state)
        self.count |= {"cost": self.cost + more, "gaps": min((1 << 63) - 1, self.last_turn - self.low + 1 - self.turns) if self.turns else 0}
        row = {"kind": "report", "cid": self.cid, "number": -1, "last": last, **self.count}
        if self.pieces:
            if self.codes:
                yield self.spill()
            yield row | {"kind": "large"}
            return
        edits, _ = trace(bytes(self.codes), last)
        made, rows = _Repaired(lines), iter(self.held)
        for e in edits + "I" * inserts:
            if e == "I":
                made.insert()
            else:
                made.row(e, *next(rows))
        yield row | {"audit": edits + "I" * inserts, "repaired_sha256": made.sha.hexdigest()}
        for number, role, text, e in made.lines or []:
            yield {"kind": "message", "cid": self.cid, "number": number, "audit": e, "role": role, "text": text}


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
    return out.astype({c: "Int64" for c in ["number", *_COUNTS]} | {"last": "Int32"})


def _stream(lines: bool):
    def run(batches):
        programme, now = Programme(), None
        for b in batches:
            out = []
            for cid, live, *row in zip(*[b[c].tolist() for c in ("cid", "live", "has_turn", "turn", "role", "text", "blank", "cut", "later", "message")], strict=True):
                if now is None or cid != now.cid:
                    if now is not None:
                        out += now.end(programme, lines)
                    now = _Conversation(cid)
                if live:
                    now.add(programme, *row)
                    if now.full():
                        out.append(now.spill())
            if out:
                yield _frame(out)
        if now is not None:
            yield _frame(list(now.end(programme, lines)))

    return run


def _large_stream(lines: bool):
    def run(batches):
        now, parts, edits, at, made = None, [], "", 0, None

        def finish():
            inserts = len(edits) - at
            for _ in range(inserts):
                made.insert()
            return [now | {"kind": "report", "audit": edits, "repaired_sha256": made.sha.hexdigest()}, *messages()]

        def messages():
            done, made.lines = made.lines or [], [] if lines else None
            return [{"kind": "message", "cid": now["cid"], "number": n, "audit": e, "role": r, "text": t} for n, r, t, e in done]

        for b in batches:
            out = []
            for kind, cid, row in zip(b["kind"], b["cid"], b.to_dict("records"), strict=True):
                if kind == "large":
                    if now is not None:
                        out += finish()
                    now, last = {c: row[c] for c in ["cid", "number", *_COUNTS]}, row["last"]
                    parts, edits, at, made = ["I" * _CLOSE[last]], None, 0, _Repaired(lines)
                elif kind == "piece":
                    part, last = trace(row["codes"], last)
                    parts.append(part)
                else:
                    if edits is None:
                        edits = "".join(reversed(parts))
                    while edits[at] == "I":
                        made.insert()
                        at += 1
                    made.row(edits[at], row["role"], row["text"])
                    at += 1
            out += messages() if made is not None else []
            if out:
                yield _frame(out)
        if now is not None:
            yield _frame(finish())

    return run


def _marked(rows: DataFrame) -> DataFrame:
    """Adds blank, cut, message (a digest of conversation, role and text) and later (an equal message has an earlier turn)."""
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    named = F.concat(*[x for c in ("cid", "role") for x in (F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c), F.lit("")))], F.col("text"))
    rows = rows.withColumns({"blank": core == "", "cut": ~F.substring(core, -1, 1).isin(".", "!", "?"), "message": F.unhex(F.sha2(named, 256)), "at": F.struct("has_turn", "turn")})
    said = rows.filter("not blank").groupBy("message").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).filter("n > 1")
    said = materialise(said, "repeated-messages")
    flagged = maybe_in(rows, said, "message")
    shared = join_groups(flagged.filter("_maybe").drop("_maybe"), said, "message", "n", said.agg(F.sum("n")).first()[0] or 0, "left")
    plain = flagged.filter("not _maybe").drop("_maybe")
    return plain.withColumn("later", F.lit(False)).unionByName(shared.withColumn("later", F.coalesce(F.col("first") < F.col("at"), F.lit(False))).drop("n", "first")).drop("at")


def repaired(rows: DataFrame, conversations: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", messages: bool = False) -> DataFrame:
    """Reports on conversations and, with ``messages``, their repaired messages.

    Columns ``kind, conv_id, number, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, role, text``.  A row of kind ``report`` counts faults of a conversation, with the
    cost and the initials of its cheapest edits; a row of kind ``message`` is the message of that
    ``number`` in the repaired conversation, with its edit as ``audit``.

    Rows of a conversation are taken by turn, null turns first, ties by role and text.
    A null role or text counts as one space, a null id is an id like any other, and a role
    counts by its first character.  ``conversations`` (column ``conv_id``) names those that
    are reported even without rows.  An empty table gives an empty result; other columns
    are not read.  A report holds the edits of a conversation as one text, so it grows with
    the rows of the conversation.  Turn spans beyond 64 bits count as the largest long.
    """
    bounded_batches(rows.sparkSession)
    kind = rows.schema[conv_id].dataType
    space = F.lit(" ")
    t = F.col(turn).cast("long")
    base = rows.select(F.col(conv_id).cast("string").alias("cid"), F.lit(True).alias("live"), t.isNotNull().alias("has_turn"), F.coalesce(t, F.lit(0)).alias("turn"), F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"))
    base = _marked(base)
    if conversations is not None:
        none = {"live": F.lit(False), "has_turn": F.lit(False), "turn": F.lit(0).cast("long"), "role": F.lit(""), "text": F.lit(""), "blank": F.lit(False), "cut": F.lit(False), "message": F.lit(None).cast("binary"), "later": F.lit(False)}
        base = base.unionByName(conversations.select(F.col(conv_id).cast("string").alias("cid")).distinct().withColumns(none))
    order = ["cid", "live", "has_turn", "turn", "role", "text"]
    out = materialise(base.repartition("cid").sortWithinPartitions(*order).mapInPandas(_stream(messages), _OUT), "repairs")
    large = out.filter("kind = 'large'").select("cid")
    done = out.filter("kind in ('report', 'message')")
    if not large.isEmpty():
        own = base.filter("live").join(large.withColumnRenamed("cid", "lid"), F.col("cid").eqNullSafe(F.col("lid")), "left_semi")
        first = out.filter("kind in ('large', 'piece')").withColumns({"ord": F.when(F.col("kind") == "large", F.lit(-(1 << 62))).otherwise(-F.col("number") - 1), "has_turn": F.lit(False), "turn": F.lit(0).cast("long")})
        again = first.unionByName(own.select(F.lit("row").alias("kind"), "cid", "has_turn", "turn", "role", "text", F.lit(0).cast("long").alias("ord")), allowMissingColumns=True)
        again = again.fillna(0, subset=["number", "last", *_COUNTS])  # pandas would turn longs beside nulls into doubles
        order = ["cid", "ord", "has_turn", "turn", "role", "text"]
        done = done.unionByName(again.repartition("cid").sortWithinPartitions(*order).mapInPandas(_large_stream(messages), _OUT))
    return done.select("kind", F.col("cid").cast(kind).alias("conv_id"), "number", *_COUNTS, "audit", "repaired_sha256", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults drawn by the row's conversation and turn; nulls count as one space."""
    space = F.lit(" ")
    pick = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), pick.alias("pick")).filter("pick <> 0")
    text = F.when(F.col("pick") == 1, F.lit("")).when(F.col("pick") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("pick") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("pick") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: damage to all conversations and its cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    out = repaired(damaged(rows), rows.select("conv_id")).filter("kind = 'report'")
    return out.select("conv_id", *_COUNTS, "audit", "repaired_sha256")
