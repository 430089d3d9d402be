"""Repair of the role structure of conversations by iterative-deepening A*.

Every turn is kept, given another role or deleted, and empty turns may be inserted,
so that the roles read ``(s?(ua)+)?``. The search goes depth first through the edits
in ASCII order of their letters (Delete, Insert, Keep, Rerole) under a bound on the
cost; the bound rises to the least estimate that it cut off. Cheapest edits are so
found least letters first: the first accepting path is the answer. States that
failed are kept with the budget they failed with.

The edits so far fix the state, and so the role that an insert or a rerole gives:
a list of edits has one cost and one repaired conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed

# Fixed values of the query contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
PRICE = {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}
LEGAL = {"su", "ua", "au"}
OKAY, BLANK, DUPLICATE, CUT = range(4)
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NEEDED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Inserts that end a conversation in this state; ASSISTANT and START may end as they are.
TO_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Turns of a conversation that is repaired as one; longer ones go by segments of SEGMENT turns.
LONGEST, SEGMENT = 512, 64
NO_WAY = 1 << 40
WORD = re.compile(r"[^\x20\x09-\x0D]")
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


class Turn(NamedTuple):
    role: str
    text: str
    fault: int

    @property
    def initial(self) -> str:
        return self.role[:1] or " "


def fault_of(role: str, text: str, seen) -> int:
    """The first of the faults that a turn has; ``seen`` holds earlier (role, text)."""
    if not WORD.search(text):
        return BLANK
    if (role, text) in seen:
        return DUPLICATE
    return OKAY if text.rstrip(BLANKS)[-1] in ".!?" else CUT


def next_state(state: int, letter: str, turn: Turn | None) -> int | None:
    """The state after an edit, or None if it may not stand here."""
    if letter == "D":
        return state
    if letter in "IR":
        return None if letter == "R" and turn.fault in (BLANK, DUPLICATE) else AFTER[NEEDED[state][0]]
    if turn.fault in (BLANK, DUPLICATE):
        return None
    fits = turn.initial == NEEDED[state][0] or (turn.initial == "s" and state == START)
    return AFTER[turn.initial] if fits else None


def estimates(turns: Sequence[Turn], goal: int | None) -> list[int]:
    """A lower bound on the cost of the turns from each place on.

    Blank and repeated turns cost a Delete, cut-off ones at least as much. Of the
    others, an illegal pair of neighbours costs a Rerole at least; pairs that share
    no turn add up. The last turn left must be the assistant's (``goal`` None).
    """
    out = [0] * (len(turns) + 1)
    after, ends = None, goal is None  # the next turn that is sound and not yet in a pair
    for i in range(len(turns) - 1, -1, -1):
        turn = turns[i]
        out[i] = out[i + 1]
        if turn.fault in (BLANK, DUPLICATE):
            out[i] += DELETE
        elif turn.fault == CUT:
            out[i] += DELETE
            after, ends = None, False
        elif after is not None and turn.initial + after not in LEGAL:
            out[i] += REROLE
            after = None
        elif after is None and ends and turn.initial != "a":
            out[i] += REROLE
            ends = False
        else:
            after, ends = turn.initial, False
    return out


def search(turns: Sequence[Turn], start: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and letters of the cheapest edits, ties to the least letters.

    ``goal`` None is the end of a conversation: inserts may follow the last turn and
    the roles must be complete. With a state as goal, ``turns`` are a segment: the
    path ends in that state with the edit of the last turn. None if there is no way.
    """
    n = len(turns)
    if goal is not None and not _reachable(turns, start, goal):
        return None
    if n == 0 and (TO_END[start] == 0 if goal is None else goal == start):
        return 0, ""
    low = estimates(turns, goal)
    needs: dict[tuple[int, int], int] = {}  # states that failed, and what they cost at least from there
    bound = low[0]
    while True:
        path: list[str] = []
        # a frame: place, state, cost so far, edits still to try, the least that the state can cost
        stack = [[0, start, 0, iter("DIKR"), NO_WAY]]
        while stack:
            frame = stack[-1]
            at, state, cost, left, _ = frame
            for letter in left:
                if at == n and (letter != "I" or goal is not None):
                    continue
                turn = turns[at] if at < n else None
                to = next_state(state, letter, turn)
                if to is None:
                    continue
                place = at + (letter != "I")
                price = PRICE[letter] + (TRUNCATED if letter in "KR" and turn.fault == CUT else 0)
                if place < n:
                    rest = max(low[place], needs.get((place, to), 0))
                elif goal is None:
                    rest = INSERT * TO_END[to]
                else:
                    rest = 0 if to == goal else NO_WAY
                if cost + price + rest > bound:
                    frame[4] = min(frame[4], price + rest)
                    continue
                path.append(letter)
                if place == n and rest == 0:
                    return cost + price, "".join(path)
                stack.append([place, to, cost + price, iter("DIKR"), NO_WAY])
                break
            else:
                stack.pop()
                needs[at, state] = frame[4]
                if stack:
                    path.pop()
                    above = stack[-1]
                    above[4] = min(above[4], cost - above[2] + frame[4])
        bound = frame[4]


def _reachable(turns: Sequence[Turn], start: int, goal: int) -> bool:
    """Whether edits lead from one state to the other, the last edit on a turn: each
    state follows from inserts but START, which only deletes keep, and SYSTEM, which
    needs a kept system turn or deletes alone."""
    if goal == start:
        return True
    if goal == START:
        return False
    sound = [t for t in turns if t.fault not in (BLANK, DUPLICATE)]
    if goal == SYSTEM:
        return start == START and any(t.initial == "s" for t in sound)
    return bool(turns)


def repaired(turns: Sequence[Turn], letters: str, state: int = START) -> tuple[list[tuple[str, str]], int]:
    """The turns that edits leave, and the state after them."""
    out, at = [], 0
    for letter in letters:
        turn = None if letter == "I" else turns[at]
        if letter == "K":
            out.append((turn.role, turn.text))
        elif letter != "D":
            out.append((NEEDED[state], turn.text if turn else ""))
        state = next_state(state, letter, turn)
        at += letter != "I"
    return out, state


# ------------------------------------------------------------------ Spark jobs
SUMMARY = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
SQL_TYPE = {pa.int64(): "long", pa.string(): "string"}
ORDER = ["conv_id", "turn", "role", "text"]


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present`` after the damage of the query contract:
    by ``crc32("conv_id:turn") % 20`` a row is dropped (``present`` false), emptied,
    robbed of its ``.!?``, doubled or given to the user. Nulls read as one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return (rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                        text.alias("text"), (F.col("kind") != 0).alias("present"), copies.alias("copy")).drop("copy"))


def repair_conversations(turns: DataFrame, longest: int = LONGEST) -> DataFrame:
    """One row per ``conv_id`` of ``turns`` (``conv_id, turn, role, text`` and, if
    there, ``present``: false for a row that only names its conversation).

    ``gaps``, the counts of ``blank``, ``duplicate``, ``truncated`` and ``illegal``,
    the least ``cost``, ``audit`` (the edits' letters) and ``repaired_sha256`` (of the
    turns left, as ``role:text`` lines). Turns go by ``turn``, nulls first, and rows
    of one turn by role and text. Null ``conv_id`` is one conversation; null roles
    and texts read as one space, and a role without letters fits nowhere. Rows
    that are equal are duplicates of the first. A conversation without turns gives
    zeros and no edits; an empty table no rows. Other columns are not read.

    Conversations of up to ``longest`` turns stream through tasks sorted, one at a
    time. Longer ones are dealt out by place: see ``_long_conversations``.
    """
    return _repair(turns, longest, SUMMARY)


def repaired_turns(turns: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``conv_id, position, role, text`` of the turns that the cheapest edits leave."""
    return _repair(turns, longest, TURNS)


def _repair(turns: DataFrame, longest: int, schema: pa.Schema) -> DataFrame:
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        spaced("role"), spaced("text"), present.alias("present"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("size")).where(F.col("size") > longest)
    sizes = landed(sizes.select(F.col("conv_id").alias("c")), "long-conversations")
    if sizes.isEmpty():
        return _short_conversations(rows, schema)
    is_long = F.col("conv_id").eqNullSafe(F.col("c"))
    return (_short_conversations(rows.join(sizes, is_long, "left_anti"), schema)
            .unionByName(_long_conversations(rows.join(sizes, is_long, "left_semi"), schema)))


class _Writer:
    """Batches of result rows of one of the two schemas."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def result(self, conv, summary: tuple, digest) -> None:
        if self.schema.names == SUMMARY.names:
            self.rows.append((conv, *summary, digest.hexdigest()))

    def turns(self, conv, position: int, left: list[tuple[str, str]]) -> None:
        if self.schema.names == TURNS.names:
            self.rows += [(conv, position + i, *x) for i, x in enumerate(left)]

    def full(self, most: int = 1000) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= most:
            rows, self.rows = self.rows, []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), self.schema.types)], schema=self.schema)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL_TYPE[f.type]}" for f in schema)


class _Joined:
    """sha256 of lines joined by newlines, as they come."""

    def __init__(self):
        self.hash, self.lines = hashlib.sha256(), 0

    def add(self, left: list[tuple[str, str]]) -> None:
        for role, text in left:
            self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def hexdigest(self) -> str:
        return self.hash.hexdigest()


def _stream(batches: Iterator[pa.RecordBatch], columns: Sequence[str]):
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns])


def _short_conversations(rows: DataFrame, schema: pa.Schema) -> DataFrame:
    def run(batches):
        out = _Writer(schema)
        now, held = object(), []
        for conv, *row in _stream(batches, [*ORDER, "present"]):
            if conv != now:
                if held:
                    _whole(out, now, held)
                    yield from out.full()
                now, held = conv, []
            held.append(row)
        if held:
            _whole(out, now, held)
        yield from out.full(1)

    return rows.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(run, _ddl(schema))


def _whole(out: _Writer, conv, rows: list) -> None:
    """The result of one conversation from its sorted rows."""
    seen: set[tuple[str, str]] = set()
    turns, numbers = [], set()
    for turn, role, text, present in rows:
        if present:
            turns.append(Turn(role, text, fault_of(role, text, seen)))
            seen.add((role, text))
            if turn is not None:
                numbers.add(turn)
    faults = [sum(t.fault == f for t in turns) for f in (BLANK, DUPLICATE, CUT)]
    cost, letters = search(turns)
    left, _ = repaired(turns, letters)
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    digest = _Joined()
    digest.add(left)
    out.turns(conv, 0, left)
    out.result(conv, (gaps, *faults, illegal_pairs(turns), cost, letters), digest)


def illegal_pairs(turns: Sequence[Turn]) -> int:
    return sum(a.initial + b.initial not in LEGAL for a, b in zip(turns, turns[1:]))


SEGMENTS = ("part int, seq long, conv_id long, turns array<struct<role:string,text:string,fault:int>>, "
            "costs array<long>, letters array<string>, illegal long, head string, tail string")


def _long_conversations(rows: DataFrame, schema: pa.Schema, segment: int = SEGMENT) -> DataFrame:
    """Conversations with too many turns for one task, without a group per conversation.

    Rows are sorted by ranges over all tasks. Each task cuts them into segments and
    searches every segment from each state to each state. A fold from the last
    segment to the first gives, for each state, the state after it on the cheapest
    way; a fold from the first follows it. Of two ways through one segment that cost
    the same the letters decide alone: both end with the edit of the same turn, so
    none begins the other. Folds stream over sorted rows and hold four numbers. Only
    ``audit`` is held whole, as the result gives it in one row; the hash of the
    repaired lines runs over them in order, so one task reads them past.
    """
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    present = landed(rows.where("present").withColumn("same", key), "long-turns")
    counts = (rows.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(F.col("present"), F.col("turn"))) - F.min(F.when(F.col("present"), F.col("turn"))) + 1
                   - F.count_distinct(F.when(F.col("present"), F.col("turn"))), F.lit(0)).cast("long").alias("gaps")))
    # the first turn of each repeated (role, text); equal rows of that turn are told apart in order
    firsts = (present.groupBy(F.col("conv_id").alias("c"), "same")
              .agg(F.count("*").alias("times"), F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
              .where("times > 1"))
    later = F.col("first").isNotNull() & (F.struct(F.col("turn").isNotNull().alias("known"), "turn") > F.col("first"))
    marked = (present.join(firsts.withColumnRenamed("same", "s"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
              .select(*ORDER, F.coalesce(later, F.lit(False)).alias("later")))

    def cut(batches):
        part, seq = TaskContext.get().partitionId(), 0
        now, held, last = object(), [], None
        for conv, turn, role, text, later in _stream(batches, [*ORDER, "later"]):
            if conv != now or len(held) == segment:
                if held:
                    yield _segment(part, seq, now, held)
                    seq += 1
                now, held = conv, []
            again = later or (conv, turn, role, text) == last
            held.append(Turn(role, text, fault_of(role, text, {(role, text)} if again else ())))
            last = (conv, turn, role, text)
        if held:
            yield _segment(part, seq, now, held)

    segments = landed(marked.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(cut, SEGMENTS), "segments")
    place = ["conv_id", "part", "seq"]

    def backward(batches):
        now, best = object(), []
        for conv, part, seq, costs in _stream(batches, [*place, "costs"]):
            last = conv != now
            if last:
                now, best = conv, [0] * 4
            step, to_end = [0] * 4, [0] * 4
            for q in STATES:
                if last:  # the letters of the last segment reach the end
                    step[q], to_end[q] = START, costs[20 * q + 16]
                else:
                    ways = [(costs[20 * q + 4 * m] + best[m], costs[20 * q + 4 * m + 1], m) for m in STATES]
                    to_end[q], _, step[q] = min(ways)
            best = to_end
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "part": part, "seq": seq, "step": step, "to_end": to_end, "last": last}], STEPS)

    steps = landed(segments.select(*place, "costs").repartition("conv_id")
                   .sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
                   .mapInArrow(backward, "conv_id long, part int, seq long, step array<long>, to_end array<long>, last boolean"), "steps")
    chosen = segments.join(steps.drop("conv_id"), ["part", "seq"])

    def forward(batches):
        out = _Writer(schema)
        now, whole, state = object(), None, START
        names = ["conv_id", "last", "step", "to_end", "letters", "turns", "illegal", "head", "tail"]
        for conv, last, step, to_end, letters, turns, illegal, head, tail in _stream(batches, names):
            if conv != now:
                now, state, whole = conv, START, _Long(to_end[START])
            edits = letters[5 * state + (4 if last else step[state])]
            turns = [Turn(**t) for t in turns]
            left, state = repaired(turns, edits, state)
            out.turns(conv, whole.digest.lines, left)
            whole.add(edits, left, turns, illegal, head, tail)
            if last:
                out.result(conv, (0, *whole.faults[1:], whole.illegal, whole.cost, "".join(whole.edits)), whole.digest)
            yield from out.full()
        yield from out.full(1)

    out = chosen.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(forward, _ddl(schema))
    if schema is TURNS:
        return out
    # conversations of which nothing is left have no segment
    out = counts.withColumnRenamed("conv_id", "c").join(out.drop("gaps"), F.col("c").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("c").alias("conv_id"), "gaps", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(_Joined().hexdigest())).alias("repaired_sha256"))


STEPS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("step", pa.list_(pa.int64())),
                   ("to_end", pa.list_(pa.int64())), ("last", pa.bool_())])


class _Long:
    """Counts, edits and digest of a long conversation as its segments come by."""

    def __init__(self, cost: int):
        self.cost, self.edits, self.faults, self.illegal, self.tail, self.digest = cost, [], [0] * 4, 0, None, _Joined()

    def add(self, edits, left, turns, illegal, head, tail):
        self.edits.append(edits)
        self.digest.add(left)
        for t in turns:
            self.faults[t.fault] += 1
        self.illegal += illegal + (self.tail is not None and self.tail + head not in LEGAL)
        self.tail = tail


def _segment(part, seq, conv, turns: list[Turn]) -> pa.RecordBatch:
    """A segment's row. Per start state: cost and rank of its letters for each end
    state (and padding to four values), then the cost to the conversation's end."""
    costs, letters = [], []
    for q in STATES:
        found = [search(turns, q, m) for m in STATES]
        order = sorted(x[1] for x in found if x)
        for x in found:
            costs += [x[0], order.index(x[1]), 0, 0] if x else [NO_WAY, 0, 0, 0]
        end = search(turns, q)
        costs += [end[0], 0, 0, 0]
        letters += [x[1] if x else "" for x in found] + [end[1]]
    row = {"part": part, "seq": seq, "conv_id": conv, "turns": [t._asdict() for t in turns], "costs": costs,
           "letters": letters, "illegal": illegal_pairs(turns), "head": turns[0].initial, "tail": turns[-1].initial}
    return pa.RecordBatch.from_pylist([row], SEGMENT_TYPE)


SEGMENT_TYPE = pa.schema([
    ("part", pa.int32()), ("seq", pa.int64()), ("conv_id", pa.int64()),
    ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())]))),
    ("costs", pa.list_(pa.int64())), ("letters", pa.list_(pa.string())), ("illegal", pa.int64()),
    ("head", pa.string()), ("tail", pa.string())])
