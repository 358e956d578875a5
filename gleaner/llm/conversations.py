"""Repair of a conversation's structure by the cheapest edits, found in a DAG of tight arcs.

A conversation's rows by turn are read against the pattern ``(s?(ua)+)?`` of role initials. A node is (rows read, state of the pattern), an
arc one edit: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant row 2, and 1 more for a truncated row that
stays; blank and repeated rows must go. Forward and backward minimum costs from both ends tell which arcs are tight, that is, on some cheapest
path. A frontier set of nodes then walks along tight arcs, at each step over those with the least letter, D < I < K < R.

Rows are put in order by range, so that a long conversation lies over several partitions. One that lies inside a partition is repaired there. The
first and last of a partition are given as a 4 x 4 matrix of least costs between states; the driver multiplies these, two for each partition at
most, from both ends, and so has forward and backward costs at each cut. A second pass gives the state in which the walk leaves a stretch for each in which
it may enter, a third walks. Rows that are equal in all columns are counted first and are one step, so no key is too frequent for a range.

Order and cases: rows are ordered by turn (null first), role, text. A null role or text is one space, in the key of the damage also a null id or turn; a
null conv_id is a conversation like any other. Ids and turns are whole numbers. Roles whose initial is none of s, u, a cannot be kept.
Whether a row is a repeat is told by role and text in all of its conversation before it. A conversation without rows has no edits and is
marked by a row with an empty ``edit``. Other columns are not read. An empty table gives an empty result. ``summary`` reads each conversation in one stream, as SHA-256 must,
and holds nothing of it but its edit letters.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import written

FAR = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a; it may end in 0 and 3.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
MADE = (2, 2, 3, 2)  # state after the one row that may be made in a state
ENDS = (0, FAR, FAR, 0)
STARTS = (0, FAR, FAR, FAR)
ROLES = {2: "user", 3: "assistant"}
LEGAL = ("su", "ua", "au")

_KEYS = ["no_conv", "conv", "has_turn", "turn", "role", "text"]
_ENTRY = [("no_conv", pa.bool_()), ("conv", pa.int64()), ("block", pa.int64()), ("seq", pa.int64()), ("has_turn", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("first", pa.bool_()), ("state", pa.string())]
_EDIT = [("step", pa.int32()), ("edit", pa.string()), ("fault", pa.string()), ("new_role", pa.string()), ("cost", pa.int64())]
_SQL = {pa.bool_(): "boolean", pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}


def _ddl(fields) -> str:
    return ", ".join(f"{n} {_SQL[t]}" for n, t in fields)


# ---- one conversation or a stretch of it -------------------------------------------------------------------------


def with_inserts(cost) -> list[int]:
    """Forward costs of a level's states after inserts."""
    a, b, c, d = cost
    c = min(c, a + INSERT, b + INSERT, d + INSERT)
    return [a, b, c, min(d, c + INSERT)]


def before_inserts(cost) -> list[int]:
    """Backward costs of a level's states before inserts."""
    a, b, c, d = cost
    c = min(c, d + INSERT)
    return [min(a, c + INSERT), min(b, c + INSERT), c, min(d, c + INSERT)]


def arcs(step, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a step: (initial, may stay, extra cost of staying, rows)."""
    initial, stays, extra, n = step
    yield "D", DELETE * n, state
    if stays:
        to = NEXT.get(initial, (None,) * 4)[state]
        if to is not None:
            yield "K", KEEP + extra, to
        yield "R", REROLE + extra, MADE[state]


def forward(step, cost) -> list[int]:
    out = [FAR] * 4
    for s in range(4):
        for _, c, t in arcs(step, s):
            out[t] = min(out[t], cost[s] + c)
    return with_inserts(out)


def backward(step, cost) -> list[int]:
    return before_inserts([min(c + cost[t] for _, c, t in arcs(step, s)) for s in range(4)])


def steps_of(role: str, n: int, first: bool, state: str) -> list[tuple[str, tuple]]:
    """(fault, step) of equal rows: one that may stay if it is the first, and all that must go."""
    initial = role[:1]
    if n and state == "blank":
        return [("blank", (initial, False, 0, n))]
    stay = [("truncated", (initial, True, TRUNCATED, 1)) if state == "truncated" else (None, (initial, True, 0, 1))] if n and first else []
    return stay + ([("duplicate", (initial, False, 0, n - len(stay)))] if n > len(stay) else [])


def walk(steps: list, entry, leaving, state: int, last: bool) -> tuple[list[str], int]:
    """Letters of each step (inserts before it included; at the end of a conversation one more string of inserts) and the state at the end.

    ``entry``: forward costs before the first step; ``leaving``: backward costs behind the last.
    """
    ahead = [with_inserts(entry)]
    for s in steps:
        ahead.append(forward(s, ahead[-1]))
    back = [before_inserts(leaving)]
    for s in reversed(steps):
        back.append(backward(s, back[-1]))
    back.reverse()
    least = min(a + b for a, b in zip(ahead[0], back[0], strict=True))
    frontier, out = {state}, []
    for i, step in enumerate(steps):
        letters = ""
        while letters[-1:] in ("", "I"):
            tight = [(x, t) for s in frontier for x, c, t in arcs(step, s) if ahead[i][s] + c + back[i + 1][t] == least]
            tight += [("I", MADE[s]) for s in frontier if ahead[i][s] + INSERT + back[i][MADE[s]] == least]
            if not tight:
                return [], state  # no cheapest path enters in this state
            letter = min(tight)[0]
            frontier = {t for x, t in tight if x == letter}
            letters += letter
        out.append(letters)
    if last:
        letters = ""
        while not frontier & {0, 3}:
            frontier = {MADE[s] for s in frontier}
            letters += "I"
        out.append(letters)
    return out, min(frontier)


def edits_of(entries: list[tuple], letters: list[str], state: int) -> Iterator[tuple]:
    """Rows of _ENTRY and _EDIT. ``entries``: rows of _ENTRY; ``letters`` of their steps as ``walk`` gives them; inserts carry the place of the row behind them."""
    left = iter(letters)
    for e in entries:
        no_conv, conv, block, seq, has_turn, turn, role, text, n, first, kind = e
        at = 0
        for fault, step in steps_of(role, n, first, kind):
            for x in next(left):
                if x == "I":
                    state = MADE[state]
                    yield (no_conv, conv, block, seq, False, 0, None, "", 1, False, None, at, x, None, ROLES[state], INSERT)
                else:
                    cost, state = next((c, t) for y, c, t in arcs(step, state) if y == x)
                    new = None if x == "D" else role if x == "K" else ROLES[state]
                    yield (no_conv, conv, block, seq, has_turn, turn, role, text, step[3], first, kind, at, x, fault, new, cost)
                at += 1
        if not n:
            yield (*e, at, "", None, None, 0)
    no_conv, conv, block, seq = entries[-1][:4]
    for k, _ in enumerate(next(left, "")):
        state = MADE[state]
        yield (no_conv, conv, block, seq, False, 0, None, "", 1, False, None, (1 << 20) + k, "I", None, ROLES[state], INSERT)


def _steps(entries: list[tuple]) -> list[tuple]:
    return [s for e in entries for _, s in steps_of(e[6], e[8], e[9], e[10])]


# ---- tables --------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, n: rows damaged by the checksum of id and turn; n is the number of copies, 0 of a dropped row."""
    c = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" ")).alias("text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit(" ")) for k in ("conv_id", "turn")))
    c = c.withColumn("k", F.crc32(key.cast("binary")) % 20)
    return c.select(
        "conv_id",
        "turn",
        F.expr("CASE k WHEN 0 THEN '' WHEN 4 THEN 'user' ELSE role END AS role"),
        F.expr("CASE WHEN k IN (0, 1) THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '') ELSE text END AS text"),
        F.expr("CASE k WHEN 0 THEN 0L WHEN 3 THEN 2L ELSE 1L END AS n"),
    )


def _entries(rows: DataFrame) -> DataFrame:
    """Equal rows counted, and for each whether it is the first of its conversation with that role and text. Nulls become flags, so that keys join and sort."""
    keyed = rows.select(F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "n")
    counted = keyed.groupBy(*_KEYS).agg(F.sum("n").alias("n"))
    firsts = keyed.where("n > 0").groupBy("no_conv", "conv", "role", "text").agg(F.min(F.struct("has_turn", "turn")).alias("f")).select("no_conv", "conv", "f.has_turn", "f.turn", "role", "text", F.lit(True).alias("first"))
    state = F.expr(r"CASE WHEN NOT text RLIKE '[^\\x20\\x09-\\x0D]' THEN 'blank' WHEN text RLIKE '[.!?][\\x20\\x09-\\x0D]*\\z' THEN 'fine' ELSE 'truncated' END AS state")
    return counted.join(firsts, _KEYS, "left").select(*_KEYS, "n", F.coalesce("first", F.lit(False)).alias("first"), state)


def _batches(rows: Iterator[tuple], fields, most_rows: int = 2000, most_chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size."""
    held, chars = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])

    for r in rows:
        held.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(held) == most_rows or chars > most_chars:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            yield from zip(*(c.to_pylist() for c in b.slice(at, 1000).columns), strict=True)


_FIRST_PASS = [*_ENTRY, *_EDIT, ("matrix", pa.list_(pa.int64()))]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of the conversations inside the partition; rows and matrices (edit null) of its first and last."""

    def rows() -> Iterator[tuple]:
        bare = (None,) * len(_EDIT)
        numbered = ((e[0], e[1], e[6], seq, *e[2:6], *e[7:]) for seq, e in enumerate(_tuples(batches)))
        held, start = [], True
        for key, own in groupby(numbered, lambda e: e[:2]):
            if held:
                steps = _steps(held)
                letters, _ = walk(steps, STARTS, ENDS, 0, True)
                yield from ((*r, None) for r in edits_of(held, letters, 0))
                held = []
            if not start:
                held = list(own)
                continue
            start, matrix, block = False, [with_inserts([0 if s == t else FAR for t in range(4)]) for s in range(4)], 0
            for e in own:  # however long, it is passed on row by row
                block = e[2]
                for s in _steps([e]):
                    matrix = [forward(s, row) for row in matrix]
                yield (*e, *bare, None)
            yield (*key, block, *(None,) * (len(_ENTRY) - 3), *bare, sum(matrix, []))
        if held:
            matrix = [with_inserts([0 if s == t else FAR for t in range(4)]) for s in range(4)]
            for s in _steps(held):
                matrix = [forward(s, row) for row in matrix]
            yield from ((*e, *bare, None) for e in held)
            yield (*held[0][:3], *(None,) * (len(_ENTRY) - 3), *bare, sum(matrix, []))

    return _batches(rows(), _FIRST_PASS)


def _chains(stretches: list) -> dict[tuple, tuple]:
    """(no_conv, conv, block) -> forward costs before it, backward costs behind it, whether it is the last. ``stretches``: rows of those and a matrix."""
    by = defaultdict(list)
    for r in stretches:
        by[r.no_conv, r.conv].append((r.block, [r.matrix[i : i + 4] for i in range(0, 16, 4)]))
    out = {}
    for key, own in by.items():
        own.sort()
        behind, cost = [], list(ENDS)
        for _, m in reversed(own):
            behind.append(cost)
            closed = before_inserts(cost)
            cost = [min(min(FAR, m[s][t] + closed[t]) for t in range(4)) for s in range(4)]
        cost = list(STARTS)
        for (block, m), b in zip(own, reversed(behind), strict=True):
            out[(*key, block)] = (cost, b, block == own[-1][0])
            cost = [min(min(FAR, cost[s] + m[s][t]) for s in range(4)) for t in range(4)]
    return out


def repair(rows: DataFrame) -> DataFrame:
    """The edits of each conversation, in order of block, seq and step. ``rows``: conv_id, turn, role, text, n (copies; 0: none, which only makes the conversation known).

    conv_id, block, seq, step, edit (K, R, D, I; empty for a conversation without rows), turn, role (null: inserted), fault, new_role (null:
    deleted), text, n (equal rows deleted by this edit, else 1) and cost.
    """
    spark = rows.sparkSession
    ordered = _entries(rows).repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS).select("no_conv", "conv", "has_turn", "turn", "role", "text", F.spark_partition_id().cast("long").alias("block"), "n", "first", "state")
    done = written(ordered.mapInArrow(_first_pass, f"{_ddl([*_ENTRY, *_EDIT])}, matrix array<bigint>"))
    stretches = done.where("matrix IS NOT NULL").select("no_conv", "conv", "block", "matrix").collect()  # two for each partition at most
    cuts = spark.sparkContext.broadcast(_chains(stretches))
    names = [n for n, _ in _ENTRY]
    cut = done.where("edit IS NULL AND matrix IS NULL").select(*names).repartition(F.col("block")).sortWithinPartitions("block", "no_conv", "conv", "seq")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for key, own in groupby(_tuples(batches), lambda e: e[:3]):
                steps = _steps(list(own))
                entry, leaving, _ = cuts.value[key]
                for s in range(4):
                    letters, to = walk(steps, entry, leaving, s, False)
                    yield (*key, s, to if len(letters) == len(steps) else -1)

        return _batches(found(), [*_ENTRY[:3], ("state", pa.int64()), ("exit", pa.int64())])

    slim = cut.withColumn("text", F.lit(""))
    leaves = {(r.no_conv, r.conv, r.block, r.state): r.exit for r in slim.mapInArrow(exits, f"{_ddl(_ENTRY[:3])}, state bigint, exit bigint").collect()}  # eight for each partition at most
    enters, state = {}, 0
    for key in sorted(cuts.value):
        state = 0 if key[:2] != (before := next(reversed(enters), (None, None)))[:2] else leaves[(*before, enters[before])]
        enters[key] = state
    entered = spark.sparkContext.broadcast(enters)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for key, own in groupby(_tuples(batches), lambda e: e[:3]):
                entries = list(own)
                entry, leaving, last = cuts.value[key]
                letters, _ = walk(_steps(entries), entry, leaving, entered.value[key], last)
                yield from edits_of(entries, letters, entered.value[key])

        return _batches(found(), [*_ENTRY, *_EDIT])

    edits = done.where("edit IS NOT NULL").drop("matrix").unionByName(cut.mapInArrow(finish, _ddl([*_ENTRY, *_EDIT])))
    return edits.select(F.expr("IF(no_conv, NULL, conv) AS conv_id"), "block", "seq", "step", "edit", F.expr("IF(has_turn, turn, NULL) AS turn"), "role", "fault", "new_role", F.expr("IF(edit = 'D', NULL, text) AS text"), "n", "cost")


class Tally:
    """What the edits of a conversation, read in order, add up to."""

    def __init__(self):
        self.turns, self.low, self.last, self.before = 0, None, None, None
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.cost, self.audit, self.lines, self.digest = 0, 0, [], 0, hashlib.sha256()

    def add(self, edit, turn, role, fault, new_role, text, n, cost) -> None:
        self.audit.append(edit * n if edit == "D" else edit)
        self.cost += cost
        if fault:
            self.count[fault] += n
        if edit and edit != "I":
            if turn is not None and turn != self.last:
                self.low = turn if self.low is None else self.low
                self.last, self.turns = turn, self.turns + 1
            initial = role[:1]
            self.illegal += n - 1 + (self.before is not None and self.before + initial not in LEGAL)
            self.before = initial
        if new_role is not None:
            self.digest.update(f"{chr(10) if self.lines else ''}{new_role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.last - self.low + 1 - self.turns if self.turns else 0
        return gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


_SUMMARY = [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def summary(edits: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, gaps between turns, pairs of roles that may not follow each other, cost, letters of the edits and digest of the repaired rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for conv, own in groupby(_tuples(batches), lambda e: e[0]):
                tally = Tally()
                for e in own:
                    tally.add(*e[1:])
                yield (conv, *tally.row())

        return _batches(found(), _SUMMARY)

    ordered = edits.repartition("conv_id").sortWithinPartitions("conv_id", "block", "seq", "step")
    return ordered.select("conv_id", "edit", "turn", "role", "fault", "new_role", "text", "n", "cost").mapInArrow(run, _ddl(_SUMMARY))
