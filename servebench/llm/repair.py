"""Conversation structure repair as a lightest derivation (Knuth's agenda).

A conversation is repaired to roles ``(s?(ua)+)?`` by editing its rows.  Items are
``(i, q)``: rows i.. can be finished from grammar state q.  The axioms are the end states
after the last row; every edit of a row (Keep, Rerole, Delete) or an Insert deduces an item from the
item behind it and puts its letter before that item's audit.  Derivations weigh
(cost, audit); an agenda pops them in the order of (cost, rows covered, audit), which no
deduction lowers, until the goal (0, start) is final.  Of one item, derivations of equal
cost begin with different letters (state and letter fix what follows), so the first letter
orders their audits and no audit is built before the goal is reached.

Rows are range-partitioned by conversation and turn and stream through the tasks in order.  A conversation
inside one partition is repaired there.  One that crosses partitions, however large,
is cut into one segment per partition: each segment gives its costs from
every state to every state (a few numbers), these are chained per conversation, and
every segment is then derived on its own from the costs behind it.  Only the digest
of the repaired text, which SHA-256 defines as a sequence, passes through one task as a
stream of constant memory.

Edge cases: NULL conv_id is a conversation of its own; a NULL role or text counts as one space (so
a row without text is blank and a row without role cannot be kept as it is); rows of one
turn are ordered by role and text; whole copies are neighbours; rows without a turn come first;
an empty table has no conversations; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, prepare

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5                      # what an undeleted truncated row adds
ENDS = ".!?"
BLANKS = " \t\n\x0b\x0c\r"
FAR = 1 << 60
BOUND = 64                         # characters of a text that a range bound may hold

# Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
STATES = range(4)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
MADE = {0: "u", 1: "u", 2: "a", 3: "u"}     # what Rerole and Insert can give in a state
NAMES = {"u": "user", "a": "assistant"}
END_COSTS = [0, FAR, FAR, 0]
LEGAL = {"su", "ua", "au"}


# --- damage -----------------------------------------------------------------
def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage fixed by crc32(``conv_id:turn``) mod 20."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    d = rows.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"),
                    kind.alias("kind")).filter("kind <> 0")
    text = (F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")))
    return d.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))


# --- faults -----------------------------------------------------------------
def _faulty(d: DataFrame) -> DataFrame:
    """Whole copies as one row with ``times``, and ``late``: an earlier turn has the same
    role and text (texts meet by their SHA-256)."""
    d = d.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    d = d.withColumns({"digest": F.unhex(F.sha2(F.concat(F.col("role"), F.lit("\0"), F.col("text")).cast("binary"), 256)),
                       "at": F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))})
    first = (d.groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
             .select(F.col("conv_id").alias("c_"), F.col("digest").alias("d_"), "first"))
    return (d.join(first, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("digest") == F.col("d_")), "left")
            .select("conv_id", "turn", "role", "text", "times", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("late")))


class Row:
    """A row after damage; ``copies`` more of it follow and have to go."""
    __slots__ = ("role", "text", "initial", "gone", "truncated", "copies", "fault")

    def __init__(self, role: str, text: str, times: int, late: bool):
        said = text.rstrip(BLANKS)
        self.role, self.text, self.initial, self.copies = role, text, role[:1], times - 1
        self.fault = "blank" if not said else "duplicate" if late else "truncated" if said[-1] not in ENDS else ""
        self.gone = self.fault in ("blank", "duplicate")
        self.truncated = self.fault == "truncated"


# --- the agenda -------------------------------------------------------------
def lightest(rows: list[Row], behind: list[int], goals: list[int], last: bool = True) -> dict[int, tuple[int, dict]]:
    """For every goal state the least cost of finishing ``rows`` from it, and the edits
    chosen per item.  ``behind``: the cost of each state after the last row.  Rows may be
    inserted before any row and, where ``last``, at the end."""
    n = len(rows)
    agenda = [(cost, 0, "", n, q, None) for q, cost in enumerate(behind) if cost < FAR]
    heapq.heapify(agenda)
    final: dict[tuple[int, int], tuple[int, str, int | None]] = {}
    wanted = {(0, q) for q in goals}
    back: dict[int, list[tuple[int, str]]] = {s: [(q, c) for (q, c), t in NEXT.items() if t == s] for s in STATES}
    while agenda and wanted:
        cost, covered, letter, i, q, came = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final[i, q] = (cost, letter, came)
        wanted.discard((i, q))
        if i < n or last:
            for p, c in back[q]:
                if c == MADE[p] and (i, p) not in final:
                    heapq.heappush(agenda, (cost + INSERT, covered, "I", i, p, q))
        if i:
            r = rows[i - 1]
            away = 2 * r.copies                          # copies are deleted after the row
            if (i - 1, q) not in final:
                heapq.heappush(agenda, (cost + DELETE + away, covered + 1, "D", i - 1, q, q))
            if not r.gone:
                more = away + (TRUNCATED if r.truncated else 0)
                for p, c in back[q]:
                    if (i - 1, p) in final:
                        continue
                    if c == r.initial:
                        heapq.heappush(agenda, (cost + KEEP + more, covered + 1, "K", i - 1, p, q))
                    if c == MADE[p]:
                        heapq.heappush(agenda, (cost + REROLE + more, covered + 1, "R", i - 1, p, q))
    return {q: (final[0, q][0], final) for q in goals if (0, q) in final}


def walk(rows: list[Row], final: dict, q: int) -> Iterator[tuple[str, str | None, int]]:
    """The edits from a goal on: (letters, repaired row or None, state after)."""
    i = 0
    while (step := final[i, q])[2] is not None:
        _, letter, after = step
        if letter == "I":
            yield "I", NAMES[MADE[q]] + ":", after
        else:
            r = rows[i]
            i += 1
            kept = None if letter == "D" else (r.role if letter == "K" else NAMES[MADE[q]]) + ":" + r.text
            yield letter + "D" * r.copies, kept, after
        q = after


# --- facts that add up over segments ----------------------------------------
class Facts:
    """Counts of a run of rows in order; ``add`` takes one more, ``join`` the next run."""
    NAMES = ["low", "high", "turns", "edge", "blank", "duplicate", "truncated", "illegal", "first", "final"]

    def __init__(self, values: dict | None = None):
        v = values or {}
        self.low, self.high, self.edge = v.get("low"), v.get("high"), v.get("edge")    # turns; edge: the last turn seen
        self.turns, self.blank, self.duplicate = v.get("turns", 0), v.get("blank", 0), v.get("duplicate", 0)
        self.truncated, self.illegal = v.get("truncated", 0), v.get("illegal", 0)
        self.first, self.final = v.get("first"), v.get("final")                        # role initials

    def add(self, turn: int | None, row: Row) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += (self.final is not None and self.final + row.initial not in LEGAL) + row.copies * (2 * row.initial not in LEGAL)
        self.first, self.final = row.initial if self.first is None else self.first, row.initial
        # Copies of a blank row are blank; copies of any other row have been seen before.
        self.blank += (1 + row.copies) * (row.fault == "blank")
        self.duplicate += (row.fault == "duplicate") + row.copies * (row.fault != "blank")
        self.truncated += row.truncated

    def join(self, o: Facts) -> None:
        self.illegal += o.illegal + (self.final is not None and o.first is not None and self.final + o.first not in LEGAL)
        self.turns += o.turns - (self.high is not None and self.high == o.low)
        self.low, self.high = o.low if self.low is None else self.low, self.high if o.high is None else o.high
        self.first, self.final = o.first if self.first is None else self.first, self.final if o.final is None else o.final
        self.blank, self.duplicate, self.truncated = self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


# --- tasks ------------------------------------------------------------------
_DONE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FACTS = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, final string"
_OPEN = "conv string, part int, k long, role string, text string, times long, late boolean, costs array<long>"
_STREAM = f"{_OPEN}, {_DONE}, low long, high long, turns long, first string, final string"


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _table(rows: list[dict], schema: str) -> pa.Table:
    return pa.table({n: pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in (x.split() for x in schema.split(", "))})


def _segment(rows: list[Row]) -> list[int]:
    """Costs from each state (upper index) to each state; inserts at the end belong to what follows."""
    out = []
    for end in STATES:
        behind = [FAR] * 4
        behind[end] = 0
        got = lightest(rows, behind, list(STATES), last=False)
        out.append([got[q][0] if q in got else FAR for q in STATES])
    return [out[end][q] for q in STATES for end in STATES]


class Task:
    """One partition's rows, in order: whole conversations repaired, the first and last left open."""

    def __init__(self):
        self.part = TaskContext.get().partitionId()
        self.conv, self.held, self.turns, self.n_closed = None, [], [], 0

    def take(self, conv: str, turn: int | None, r: Row, late: bool) -> list[dict]:
        out = self.close() if self.held and conv != self.conv else []
        self.conv = conv
        self.held.append((r, late))
        self.turns.append(turn)
        return out

    def close(self, last: bool = False) -> list[dict]:
        rows, turns = [r for r, _ in self.held], self.turns
        facts = Facts()
        for t, r in zip(turns, rows):
            facts.add(t, r)
        said = {n: getattr(facts, n) for n in ("blank", "duplicate", "truncated", "illegal")}
        if self.n_closed and not last:
            cost, final = lightest(rows, END_COSTS, [0])[0]
            letters, kept = [], []
            for a, row, _ in walk(rows, final, 0):
                letters.append(a)
                if row is not None:
                    kept.append(row)
            out = [{"conv": self.conv, "k": -2, "gaps": facts.gaps(), "cost": cost, "audit": "".join(letters),
                    "repaired_sha256": hashlib.sha256("\n".join(kept).encode()).hexdigest()} | said]
        else:
            out = [{"conv": self.conv, "part": self.part, "k": -1, "costs": _segment(rows)} | said
                   | {n: getattr(facts, n) for n in ("low", "high", "turns", "first", "final")}]
            out += [{"conv": self.conv, "part": self.part, "k": k, "role": r.role, "text": r.text, "times": r.copies + 1, "late": late}
                    for k, (r, late) in enumerate(self.held)]
        self.n_closed += 1
        self.held, self.turns = [], []
        return out


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, out = Task(), []
    for b in batches:
        for conv, turn, role, text, times, late in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "times", "late"))):
            out += task.take(conv, turn, Row(role, text, times, late), late)
            if len(out) >= 4096:
                yield from _table(out, _STREAM).to_batches()
                out = []
    if task.held:
        out += task.close(last=True)
    if out:
        yield from _table(out, _STREAM).to_batches()


_CHAINED = f"conv string, part int, entry int, behind array<long>, {_FACTS}, cost long, is_last boolean"


def _chain(t: pa.Table) -> pa.Table:
    """Of one conversation's segments (a row each): the cost behind each, facts and cost of the whole."""
    segments = sorted(t.to_pylist(), key=lambda r: r["part"])
    ended = lightest([], END_COSTS, list(STATES))        # nothing is left but inserts at the end
    behind, after = [], [ended[q][0] for q in STATES]
    for s in reversed(segments):
        behind.append(after)
        c = s["costs"]
        after = [min(FAR, *(c[4 * q + e] + after[e] for e in STATES)) for q in STATES]
    facts = Facts()
    for s in segments:
        facts.join(Facts(s))
    whole = {n: getattr(facts, n) for n in _columns(_FACTS)} | {"cost": after[0]}
    return _table([{"conv": s["conv"], "part": s["part"], "behind": b, "is_last": k == len(segments) - 1} | whole
                   for k, (s, b) in enumerate(zip(segments, reversed(behind)))], _CHAINED)


_DERIVED = "conv string, part int, k long, q int, letters string, line string, after int"


def _derived(t: pa.Table, chained: pa.Table) -> pa.Table:
    """Every segment derived from each of its entry states: edits per row (and what is inserted before it)."""
    if not t.num_rows:
        return _table([], _DERIVED)
    t = t.sort_by("k")
    rows = [Row(*x) for x in zip(*(t.column(c).to_pylist() for c in ("role", "text", "times", "late")))]
    c = chained.slice(0, 1).to_pylist()[0]
    last = c["is_last"]
    # At the end of the last segment inserts are edits of their own; elsewhere the costs behind hold them.
    behind = END_COSTS if last else c["behind"]
    got = lightest(rows, behind, list(STATES), last=last)
    out = []
    for q in got:
        for k, (letters, line, after) in enumerate(walk(rows, got[q][1], q)):
            out.append({"conv": c["conv"], "part": c["part"], "k": k, "q": q, "letters": letters, "line": line, "after": after})
    return _table(out, _DERIVED)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows each conversation from its start through its segments' edits, in order."""
    conv, part, state, entry = object(), None, 0, 0
    digest, letters, any_line, out = None, [], False, []

    def close() -> None:
        out.append({"conv": conv, "audit": "".join(letters), "repaired_sha256": digest.hexdigest()})

    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("conv", "part", "q", "letters", "line", "after"))):
            c, p, q, a, line, after = r
            if c != conv:
                if digest is not None:
                    close()
                conv, part, state, digest, letters, any_line = c, None, 0, hashlib.sha256(), [], False
            if p != part:
                part, entry = p, state
            if q != entry:
                continue
            letters.append(a)
            state = after
            if line is not None:
                digest.update((("\n" if any_line else "") + line).encode())
                any_line = True
        if out:
            yield from _table(out, "conv string, audit string, repaired_sha256 string").to_batches()
            out = []
    if digest is not None:
        close()
        yield from _table(out, "conv string, audit string, repaired_sha256 string").to_batches()


def repaired(conversations: DataFrame) -> DataFrame:
    """A row per conv_id of ``conversations``: gaps, the faults, cost, audit and digest of the lightest repair."""
    prepare(conversations.sparkSession)
    # Conversations are known by a text key: NULL has one that no id has.
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    rows = _faulty(damaged(conversations)).select(key.alias("conv"), "turn", "role", "text", "times", "late")
    # A range may begin inside a turn: the bounds hold the beginnings of texts, never whole ones.
    turn = [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role")]
    dealt = rows.repartitionByRange(*turn, F.substring("text", 1, BOUND)).sortWithinPartitions(*turn, F.asc("text"))
    s = cut(dealt.mapInArrow(_stream, _STREAM))
    whole = s.filter("k = -2").select("conv", *_columns(_DONE))
    facts = s.filter("k = -1").select("conv", "part", "costs", *_columns(_FACTS))
    chained = cut(facts.groupBy("conv").applyInArrow(lambda t: _chain(t), _CHAINED))
    derived = (s.filter("k >= 0").select(*_columns(_OPEN)[:-1]).groupBy("conv", "part")
               .cogroup(chained.groupBy("conv", "part")).applyInArrow(_derived, _DERIVED))
    told = (derived.repartition("conv").sortWithinPartitions("conv", "part", "k")
            .mapInArrow(_told, "conv string, audit string, repaired_sha256 string"))
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    crossing = (chained.filter("is_last").join(told, "conv", "left")
                .select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
    done = whole.unionByName(crossing).withColumnRenamed("conv", "key_")
    nothing = hashlib.sha256(b"").hexdigest()
    out = conversations.select("conv_id").distinct().join(done, key == F.col("key_"), "left")
    filled = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _columns(_DONE)[:6]]
    return out.select("conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
