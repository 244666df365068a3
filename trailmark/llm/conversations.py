"""Repair of conversations: the cheapest edits that make every conversation ``(s?(ua)+)?``, streamed in order of turns.

Rows are repartitioned by conversation once. Windows over that partitioning number the rows by turn (nulls first; equal turns
by role and text, so repeats are adjacent) and mark faults: blank (no character but 20 and 09 to 0D), else duplicate (role and
text seen earlier in the conversation), else truncated (the last other character is none of ``.!?``).

Edits and their initials: Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant message 2.
Blank and duplicate rows must be deleted; an undeleted truncated row costs 1 more. From a state of the pattern an initial leads
to one other state, so a string of initials is one path, and the cheapest path that is ASCII-least takes the least initial of
those that stay cheapest.

The cost to go needs the rows backwards, the edits need them forwards. So each row travels twice in one sorted partition: first
without its text, last turn first, then with its text, first turn first. ``mapInPandas`` carries four costs over batch borders
in the first part and pushes one byte a row (the best initial in each state); the second part pops these bytes. The stack keeps
``HELD`` bytes in memory and the rest in a file of the task, so a conversation of any length needs bounded memory. Python
reads and hands on batches; no conversation is ever a whole.

A null role or text is one space; a null conversation is a conversation. A role without a first character, or with another
than s, u or a, cannot be kept. An empty table gives an empty result. Other columns of the rows are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import ship_package

#: Bytes of a stack that stay in memory.
HELD = 1 << 20
#: Rows of a frame that is handed on.
ROWS = 1_000
#: Blanks of the fault rules.
BLANKS = " \t\n\x0b\x0c\r"

# States of the pattern: nothing yet, behind s, behind u, behind a.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state behind each initial; a conversation may end at _START and _ASSISTANT.
_AFTER = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
#: What an inserted or reroled row must be in each state, and the state behind it.
_FITTING = ("user", "user", "assistant", "user")
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
EDITS = "DIKR"
_DELETE, _INSERT, _KEEP, _REROLE = range(4)
_COST = {"K": 0, "R": 2, "D": 3, "I": 2}
_NEVER = 1 << 40


class Stack:
    """Bytes, last in first out; all but the last ``HELD`` or so are in a file that vanishes with the task."""

    def __init__(self) -> None:
        self.top, self.file, self.spilled = bytearray(), None, 0

    def push(self, value: int) -> None:
        self.top.append(value)
        if len(self.top) >= 2 * HELD:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(self.spilled)
            self.file.write(self.top[:HELD])
            self.spilled += HELD
            del self.top[:HELD]

    def pop(self) -> int:
        if not self.top and self.spilled:
            self.spilled -= HELD
            self.file.seek(self.spilled)
            self.top = bytearray(self.file.read(HELD))
        return self.top.pop()


def _with_inserts(costs: list[int], choice: list[int]) -> tuple[tuple[int, ...], int]:
    """Costs with inserted messages before the row, and the best initials of the four states in one byte; ties take the lesser."""
    for _ in range(3):
        for state in range(4):
            inserted = costs[_NEXT[state]] + _COST["I"]
            if inserted < costs[state] or inserted == costs[state] and choice[state] > _INSERT:
                costs[state], choice[state] = inserted, _INSERT
    return tuple(costs), sum(c << 2 * state for state, c in enumerate(choice))


def last_costs() -> tuple[tuple[int, ...], int]:
    """Costs behind the last row: a message is inserted where the conversation may not end."""
    return _with_inserts([0, _NEVER, _NEVER, 0], [_DELETE] * 4)


def earlier_costs(costs: tuple[int, ...], initial: str, fault: str | None) -> tuple[tuple[int, ...], int]:
    """Costs from before a row on, given those from behind it, and its best initials."""
    before, choice = [], []
    for state in range(4):
        options = [(costs[state] + _COST["D"], _DELETE)]
        if fault not in ("blank", "duplicate"):
            more = int(fault == "truncated")
            if state in _AFTER.get(initial, ()):
                options.append((costs[_AFTER[initial][state]] + more, _KEEP))
            options.append((costs[_NEXT[state]] + _COST["R"] + more, _REROLE))
        cost, letter = min(options)
        before.append(cost)
        choice.append(letter)
    return _with_inserts(before, choice)


class _Planner:
    """``earlier_costs`` by table: costs lie within 6 of each other, so few cases differ."""

    def __init__(self) -> None:
        self.seen: dict[tuple, tuple] = {}

    def step(self, costs: tuple[int, ...], initial: str, fault: str | None) -> tuple[tuple[int, ...], int]:
        least = min(costs)
        key = (tuple(c - least for c in costs), initial if initial in _AFTER else "", fault)
        if key not in self.seen:
            self.seen[key] = earlier_costs(*key)
        made, letters = self.seen[key]
        return tuple(c - min(made) for c in made), letters


_EDIT_NAMES = ["conv", "seq", "edit", "fault", "turn", "role", "role_was", "text"]
_EDIT_SCHEMA = "conv string, seq long, edit string, fault string, turn string, role string, role_was string, text string"


def _edit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a partition, both parts of each conversation, to edits in order."""
    planner, stack, end = _Planner(), Stack(), last_costs()
    costs, state, seq, current, begun, out = end[0], _START, 0, None, False, []

    def inserts(letters: int) -> Iterator[tuple]:
        nonlocal state, seq
        while letters >> 2 * state & 3 == _INSERT:
            yield current, seq, "I", None, None, _FITTING[state], None, ""
            state, seq = _NEXT[state], seq + 1

    def finish() -> None:
        nonlocal costs, state, seq
        if begun and state not in (_START, _ASSISTANT):
            closing = end[1]
            while state not in (_START, _ASSISTANT):
                out.append((current, seq, EDITS[closing >> 2 * state & 3], None, None, _FITTING[state], None, ""))
                state, seq = _NEXT[state], seq + 1
        costs, state, seq = end[0], _START, 0

    for frame in frames:
        for conv, forward, turn, role, fault, text in zip(*(frame[c] for c in ("conv", "forward", "turn", "role", "fault", "text"))):
            if not begun or conv != current:
                finish()
                current, begun = conv, True
            if not forward:
                costs, letters = planner.step(costs, role[:1], fault)
                stack.push(letters)
                continue
            letters = stack.pop()
            out.extend(inserts(letters))
            letter = letters >> 2 * state & 3
            new = role
            if letter == _REROLE:
                new, state = _FITTING[state], _NEXT[state]
            elif letter == _KEEP:
                state = _AFTER[role[0]][state]
            out.append((conv, seq, EDITS[letter], fault, turn, new, role, text))
            seq += 1
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=_EDIT_NAMES)
                out = []
    finish()
    if out:
        yield pd.DataFrame(out, columns=_EDIT_NAMES)


def _ordered_edits(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Edits as strings; those of a conversation are neighbours in one partition, in order."""
    ship_package(rows.sparkSession)
    held = rows.select(
        F.col(conv).cast("string").alias("conv"), F.col(turn).alias("_turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(name) for c, name in ((role, "role"), (text, "text"))],
    ).repartition("conv")
    by_turn = Window.partitionBy("conv").orderBy(F.col("_turn").asc_nulls_first(), "role", "text")
    held = held.withColumn("pos", F.row_number().over(by_turn).cast("long"))
    again = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("pos")) > 1
    shown: Column = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(shown == "", "blank").when(again, "duplicate").when(~F.substring(shown, -1, 1).isin(".", "!", "?"), "truncated")
    )
    held = held.select("conv", F.col("_turn").cast("string").alias("turn"), "role", "text", "pos", fault.alias("fault"))
    back = F.struct(F.lit(False).alias("forward"), (-F.col("pos")).alias("at"), F.lit(None).cast("string").alias("text"))
    ahead = F.struct(F.lit(True).alias("forward"), F.col("pos").alias("at"), F.col("text").alias("text"))
    twice = held.select("conv", "turn", "role", "fault", F.explode(F.array(back, ahead)).alias("_x"))
    twice = twice.select("conv", "_x.forward", "_x.at", "turn", "role", "fault", "_x.text").sortWithinPartitions("conv", "forward", "at")
    return twice.mapInPandas(_edit, _EDIT_SCHEMA)


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """All edits of all conversations: conversation, ``seq`` (their order, from 0), ``edit`` (K, R, D or I), ``fault``, turn, role,
    ``role_was`` and text.

    The repaired conversation is its edits but D, by ``seq``. Inserted rows have no turn, fault or ``role_was``.
    """
    edits = _ordered_edits(rows, conv, turn, role, text)
    return edits.select(
        F.col("conv").cast(rows.schema[conv].dataType).alias(conv), "seq", "edit", "fault",
        F.col("turn").cast(rows.schema[turn].dataType).alias(turn), F.col("role").alias(role), "role_was", F.col("text").alias(text),
    )


_LEGAL = {"su", "ua", "au"}
_AUDIT_NAMES = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_AUDIT_SCHEMA = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Audit:
    """What one conversation's edits add up to; they come in order."""

    def __init__(self, conv: str | None) -> None:
        self.conv, self.first, self.last, self.turns, self.illegal, self.cost = conv, None, None, 0, 0, 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.before, self.letters, self.digest, self.lines = None, bytearray(), hashlib.sha256(), 0

    def add(self, edit: str, fault: str | None, turn: str | None, role: str, role_was: str | None, text: str) -> None:
        self.letters += edit.encode()
        self.cost += _COST[edit] + (fault == "truncated" and edit != "D")
        if fault:
            self.faults[fault] += 1
        if edit != "I":
            if turn is not None and (number := int(turn)) != self.last:
                self.first = number if self.first is None else self.first
                self.last, self.turns = number, self.turns + 1
            self.illegal += self.before is not None and self.before + role_was[:1] not in _LEGAL
            self.before = role_was[:1]
        if edit != "D":
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, self.letters.decode(), self.digest.hexdigest())


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, out = None, []
    for frame in frames:
        for conv, *edit in zip(*(frame[c] for c in ("conv", "edit", "fault", "turn", "role", "role_was", "text"))):
            if now is None or conv != now.conv:
                if now:
                    out.append(now.row())
                now = _Audit(conv)
            now.add(*edit)
        if out:
            yield pd.DataFrame(out, columns=_AUDIT_NAMES)
            out = []
    if now:
        yield pd.DataFrame([now.row()], columns=_AUDIT_NAMES)


def audit_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: gaps in the turns (read as whole numbers), faults, illegal neighbours (initials other than su, ua, au), the
    edits' cost and initials, and the SHA-256 of the repaired ``role:text`` lines."""
    whole = rows.withColumn(turn, F.col(turn).try_cast("long"))
    made = _ordered_edits(whole, conv, turn, role, text).mapInPandas(_fold, _AUDIT_SCHEMA)
    return made.select(F.col("conv").cast(rows.schema[conv].dataType).alias(conv), *_AUDIT_NAMES[1:])
