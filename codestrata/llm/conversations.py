"""Structure repair of conversations: the cheapest edits after which a system turn may open and user and assistant alternate.

Items of the deduction are (turns read, state), where the state is what the repaired conversation ends with: nothing yet,
the system turn, a user turn or an assistant turn.  An edit is a hyperedge from an item, together with the turn it reads,
to the next item; its function adds the edit's cost and its letter to the audit.  The functions are superior (a result is
never before its antecedent in the order of cost, then audit) and monotone: two audits of equal cost over the same turns
are never the beginning of one another, since the longer one would hold an insertion more.  So Knuth's agenda pops items
in order of (cost, audit), and an item is final when it is popped.

Long conversations run through the agenda in stretches of WINDOW turns, which start from the items that the stretch before
has finalised.  An item is dropped once another one can do whatever it may still do for less (BEHIND), and what all items
left agree on is written out.  So a task holds a stretch and the open ends of few items, however long a conversation is.

How it runs: turns are damaged or read as they are, marked where their role and text were seen before (a count of digests,
joined back only for those that repeat), sent to the task of their conversation without their text if they have to go,
and sorted; the task streams them.  One conversation is read by one task, because its repaired text and digest are one
sequence; many conversations with the same turns are many conversations.

Defined results
* Nulls are one space, in the fold, in roles and in texts.  A null conv_id is one conversation, a null turn comes first.
  Turns with equal numbers are ordered by role, then text; equal rows stand side by side, all but the first are duplicates.
* The role's first character decides (an unknown role that begins with s, u or a counts as such); an empty role has none.
* Of all fault kinds the first that holds counts: blank, duplicate, truncated.
* Conversations that lose all rows, and empty tables, have results without edits.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.tables import cut, map_batches, table

C = F.col
FOLDS = 20
WINDOW = 64  # turns of one run of the agenda
SPACE = " \t\n\x0b\x0c\r"

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5  # costs; CUT: of a truncated turn that stays
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # what may follow
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAME = {"u": "user", "a": "assistant"}
GOALS = (EMPTY, ASSISTANT)
#: BEHIND[p][q]: what it costs q at most to do whatever p may still do.
BEHIND = {
    EMPTY: {SYSTEM: 12, USER: 7, ASSISTANT: 2},
    SYSTEM: {EMPTY: 0, USER: 5, ASSISTANT: 0},
    USER: {EMPTY: 5, SYSTEM: 5, ASSISTANT: 5},
    ASSISTANT: {EMPTY: 0, SYSTEM: 10, USER: 5},
}
LEGAL = {"su", "ua", "au"}
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the faults that crc32(conv_id:turn) mod 20 plants; a dropped one stays with gone = true."""
    null_as_space = lambda c: F.coalesce(C(c).cast("string"), F.lit(" "))
    key = F.concat(null_as_space("conv_id"), F.lit(":"), null_as_space("turn"))
    fold = F.pmod(F.crc32(key.cast("binary")), F.lit(FOLDS))
    plain = rows.select(
        "conv_id", "turn", null_as_space("role").alias("role"), null_as_space("text").alias("text"), fold.alias("fold")
    )
    text = F.when(C("fold") == 1, "").when(C("fold") == 2, F.translate("text", ".!?", "")).otherwise(C("text"))
    once = plain.select(
        "conv_id",
        "turn",
        F.when(C("fold") == 4, "user").otherwise(C("role")).alias("role"),
        text.alias("text"),
        (C("fold") == 0).alias("gone"),
        F.when(C("fold") == 3, 2).otherwise(1).alias("times"),
    )
    return once.select("conv_id", "turn", "role", "text", "gone", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")


def as_read(rows: DataFrame) -> DataFrame:
    """The rows as they are, with nulls as one space."""
    space = F.lit(" ")
    role, text = (F.coalesce(C(c).cast("string"), space).alias(c) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role, text, F.lit(False).alias("gone"))


def flagged(rows: DataFrame) -> DataFrame:
    """Rows with their fault: CLEAN, BLANK, TRUNCATED, or DUPLICATE of a row with an earlier turn.

    Rows that equal each other in turn as well are told apart later, when they stand side by side.
    """
    digest = F.unhex(F.sha2(F.concat_ws("\x00", F.char_length("role").cast("string"), "role", "text"), 256))
    rows = rows.withColumn("digest", digest)
    rows = rows.withColumn("last", F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)))
    order = F.struct(C("turn").isNotNull().alias("numbered"), "turn")
    live = rows.where(~C("gone") & (C("last") != "")).select("conv_id", "digest", order.alias("at"))
    repeated = live.groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times"))
    repeated = cut(repeated.where("times > 1").select(C("conv_id").alias("c"), C("digest").alias("d"), "first"))
    joined = rows.join(repeated, C("conv_id").eqNullSafe(C("c")) & (C("digest") == C("d")), "left")
    later = F.coalesce(order > C("first"), F.lit(False))
    fault = (
        F.when(C("last") == "", BLANK).when(later, DUPLICATE).when(~C("last").isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN)
    )
    return joined.select("conv_id", "turn", "role", "text", "gone", fault.alias("fault"))


Value = tuple[int, str]  # cost and audit of an item


@lru_cache(maxsize=200_000)
def agenda(turns: tuple[tuple[str, bool, bool], ...], axioms: tuple[tuple[int, int, str], ...], to_goal: bool):
    """Lightest derivations over a stretch of turns: {last state: (cost, audit, the state it started from)}.

    turns: (initial, must go, truncated).  axioms: (state, cost, audit) of the items before the stretch.  With to_goal the
    agenda stops at the first goal item, else it finalises all items at the end of the stretch.
    """
    heap = [(cost, audit, 0, state, state) for state, cost, audit in axioms]
    heapq.heapify(heap)
    final: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str, int]] = {}
    while heap:
        cost, audit, at, state, start = heapq.heappop(heap)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(turns):
            ends[state] = (cost, audit, start)
            if to_goal and state in GOALS:
                return {state: ends[state]}
        for role in NEXT[state]:
            if role != "s" and (at, STATE[role]) not in final:
                heapq.heappush(heap, (cost + INSERT, audit + "I", at, STATE[role], start))
        if at < len(turns):
            initial, must_go, truncated = turns[at]
            heapq.heappush(heap, (cost + DELETE, audit + "D", at + 1, state, start))
            if must_go:
                continue
            stays = cost + (CUT if truncated else 0)
            for role in NEXT[state]:
                if role == initial:
                    heapq.heappush(heap, (stays + KEEP, audit + "K", at + 1, STATE[role], start))
                if role != "s":
                    heapq.heappush(heap, (stays + REROLE, audit + "R", at + 1, STATE[role], start))
    return ends


@dataclass
class Path:
    """An item's open end: letters and repaired turns that are not written out yet."""

    cost: int = 0
    audit: str = ""
    stretches: tuple[tuple[str, tuple], ...] = ()  # (letters, turns) of the stretches in it


@dataclass
class Conversation:
    """One conversation, fed turn by turn in order."""

    conv_id: object
    turns_out: bool
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    turns: int = 0  # distinct numbers
    low: int | None = None
    high: int | None = None
    initial: str | None = None
    before: tuple | None = None
    pending: list[tuple] = field(default_factory=list)
    paths: dict[int, Path] = field(default_factory=lambda: {EMPTY: Path()})
    audit: list[str] = field(default_factory=list)
    cost: int = 0
    ended: str = ""  # initial that the written part ends with
    written: int = 0

    def __post_init__(self) -> None:
        self.hash = hashlib.sha256()
        self.out: list[tuple[int, str, str, str]] = []  # (position, role, text, letter), not handed on yet

    def feed(self, turn: int | None, role: str, text: str | None, fault: int) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        same = (turn, role, text)
        if fault in (CLEAN, TRUNCATED) and self.before == same:
            fault = DUPLICATE
        self.before = same if fault in (CLEAN, TRUNCATED) or self.before == same else None
        self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        self.pending.append((initial, fault in (BLANK, DUPLICATE), fault == TRUNCATED, role, text))
        if len(self.pending) >= WINDOW:
            self.advance(False)

    def advance(self, to_goal: bool) -> None:
        """Runs the agenda over the pending turns and writes out what all items left agree on."""
        base = min(p.cost for p in self.paths.values())
        axioms = tuple(sorted((s, p.cost - base, p.audit) for s, p in self.paths.items()))
        ends = agenda(tuple(t[:3] for t in self.pending), axioms, to_goal)
        if not to_goal:
            best = {s: v[0] for s, v in ends.items()}
            ends = {p: v for p, v in ends.items() if not any(best[p] > best[q] + b for q, b in BEHIND[p].items() if q in best)}
        turns, paths = tuple(self.pending), {}
        for state, (cost, audit, start) in ends.items():
            old = self.paths[start]
            paths[state] = Path(cost + base, audit, (*old.stretches, (audit[len(old.audit) :], turns)))
        self.paths, self.pending = paths, []
        agreed = 0
        first, *others = (p.stretches for p in paths.values())
        while agreed < len(first) and all(len(o) > agreed and o[agreed] == first[agreed] for o in others):
            agreed += 1
        for letters, stretch in first[:agreed]:
            self.write(letters, stretch)
        gone = sum(len(letters) for letters, _ in first[:agreed])
        for p in paths.values():
            p.audit, p.stretches = p.audit[gone:], p.stretches[agreed:]

    def write(self, letters: str, turns: tuple) -> None:
        self.audit.append(letters)
        rest = iter(turns)
        for letter in letters:
            initial, _, _, role, text = ("", False, False, "", "") if letter == "I" else next(rest)
            if letter == "D":
                continue
            if letter != "K":
                initial = "a" if self.ended == "u" else "u"
                role = NAME[initial]
            line = f"{role}:{text or ''}"
            self.hash.update((f"\n{line}" if self.written else line).encode())
            if self.turns_out:
                self.out.append((self.written, role, text or "", letter))
            self.ended, self.written = initial, self.written + 1

    def finish(self) -> None:
        self.advance(True)
        (path,) = self.paths.values()
        self.cost = path.cost

    @property
    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns


REPORT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, n_turns long, "
    "repaired_sha256 string"
)
TURNS = "position long, role string, text string, edit string"


def report_row(c: Conversation) -> tuple:
    counts = c.counts[BLANK], c.counts[DUPLICATE], c.counts[TRUNCATED]
    return (c.conv_id, c.gaps, *counts, c.illegal, c.cost, "".join(c.audit), c.written, c.hash.hexdigest())


def conversations(batches: Iterable[pa.RecordBatch], turns_out: bool) -> Iterator[tuple[Conversation, bool]]:
    """Conversations of sorted rows: each after every batch that it stands in, and with True when it has ended."""
    now: Conversation | None = None
    for batch in batches:
        for conv_id, turn, role, text, gone, fault in zip(*(column.to_pylist() for column in batch.columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    now.finish()
                    yield now, True
                now = Conversation(conv_id, turns_out)
            if not gone:
                now.feed(turn, role, text, fault)
        if now is not None:
            yield now, False
    if now is not None:
        now.finish()
        yield now, True


def arranged(rows: DataFrame) -> DataFrame:
    """Rows of a conversation in one task and in order; what is deleted anyway leaves its text behind."""
    rows = flagged(rows)
    text: Column = F.when(~C("gone") & C("fault").isin(CLEAN, TRUNCATED), C("text"))
    rows = rows.withColumn("text", text).repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", C("turn").asc_nulls_first(), "role", "text")


def emit(df: DataFrame, make, names: list[str], kinds: str, turns_out: bool) -> DataFrame:
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []
        held: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        def typed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if not types:
                    types.append(part.schema.field(0).type)
                    types.extend(pa.string() if "string" in k else pa.int64() for k in kinds.split(", "))
                yield part

        size = 0
        for conversation, ended in conversations(typed(batches), turns_out):
            found = make(conversation, ended)
            held += found
            size += sum(len(v) for row in found for v in row if isinstance(v, str))
            if len(held) >= 4096 or size > 1 << 24:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return map_batches(df, run, f"conv_id {kind}, {kinds}")


def reports(rows: DataFrame) -> DataFrame:
    """One row for each conversation: fault counts, the cheapest repair's cost and audit, and its digest."""
    names = ["conv_id", *(k.split(" ")[0] for k in REPORT.split(", "))]
    return emit(arranged(rows), lambda c, ended: [report_row(c)] if ended else [], names, REPORT, False)


def repaired(rows: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, position, role, text and the edit (K, R or I) that made them."""

    def make(c: Conversation, ended: bool) -> list[tuple]:
        found = [(c.conv_id, *turn) for turn in c.out]
        c.out = []
        return found

    names = ["conv_id", *(k.split(" ")[0] for k in TURNS.split(", "))]
    return emit(arranged(rows), make, names, TURNS, True)


def query(spark, sf_dir):
    return reports(damaged(table(spark, sf_dir, "conversations"))).drop("n_turns")
