"""Conversation repair against every possible string of edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest

from tests.conftest import FOLDER
from trailmark.llm import conversations, queries

COST = {"K": 0, "R": 2, "D": 3, "I": 2}
PATTERN = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.findall("[^\x20\x09-\x0D]", text)
        kind = None
        if not shown:
            kind = "blank"
        elif (role, text) in seen:
            kind = "duplicate"
        elif shown[-1] not in ".!?":
            kind = "truncated"
        seen.add((role, text))
        out.append(kind)
    return out


def brute(rows):
    """(cost, audit, repaired lines) by trying all edits with at most ``len(rows) + 2`` inserted messages in all."""
    kinds, best = faults(rows), None
    for inserted in range(len(rows) + 3):
        for where in itertools.combinations_with_replacement(range(len(rows) + 1), inserted):
            slots = [where.count(i) for i in range(len(rows) + 1)]
            options = []
            for i in range(len(rows) + 1):
                options += [[("I", "user", ""), ("I", "assistant", "")]] * slots[i]
                if i < len(rows):
                    _, role, text = rows[i]
                    own = [("D", None, None)]
                    if kinds[i] not in ("blank", "duplicate"):
                        late = int(kinds[i] == "truncated")
                        own += [("K", role, text, late), ("R", "user", text, late), ("R", "assistant", text, late)]
                    options.append(own)
            for chosen in itertools.product(*options):
                kept = [x for x in chosen if x[0] != "D"]
                if any(not x[1] for x in kept) or not PATTERN.fullmatch("".join(x[1][0] for x in kept)):
                    continue
                cost = sum(COST[x[0]] + (x[3] if len(x) > 3 else 0) for x in chosen)
                option = (cost, "".join(x[0] for x in chosen), "\n".join(f"{x[1]}:{x[2]}" for x in kept))
                best = option if best is None else min(best, option)
    return best


def planned(rows):
    """The same by a search over places and states, for longer conversations."""
    kinds, states = faults(rows), {"": "u s", "s": "u", "u": "a", "a": "u"}
    memo = {}

    def go(i, state, inserts):
        if (i, state, inserts) in memo:
            return memo[i, state, inserts]
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, ""))
        if inserts < 4:
            for role in states[state].split():
                if role != "s":
                    cost, letters = go(i, role, inserts + 1)
                    found.append((cost + 2, "I" + letters))
        if i < len(rows):
            cost, letters = go(i + 1, state, 0)
            found.append((cost + 3, "D" + letters))
            if kinds[i] not in ("blank", "duplicate"):
                late = int(kinds[i] == "truncated")
                for role in states[state].split():
                    if rows[i][1][:1] == role:
                        cost, letters = go(i + 1, role, 0)
                        found.append((cost + late, "K" + letters))
                    if role != "s":
                        cost, letters = go(i + 1, role, 0)
                        found.append((cost + 2 + late, "R" + letters))
        memo[i, state, inserts] = min(found, default=(10**9, ""))
        return memo[i, state, inserts]

    sys.setrecursionlimit(20_000)
    return go(0, "", 0)


def other_facts(rows):
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    kinds = faults(rows)
    return gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def made(rng, size):
    turns = [rng.choice([None, *range(size + 2)]) if rng.random() < 0.1 else i for i in range(size)]
    return ordered([(t, rng.choice(["system", "user", "assistant", "assistant", "user", "tool", ""]), rng.choice(["Hi.", "so", "", " \n", "Yes!", "no?  "]) + rng.choice(["", f"{t}."])) for t in turns])


def test_all_edits_of_short_conversations(spark):
    rng, convs = random.Random(5), {}
    for key in range(150):
        convs[key] = made(rng, key % 4)
    convs[None] = ordered([(0, "user", "Hi."), (1, "assistant", "Yes.")])
    rows = [(k, *r) for k, own in convs.items() for r in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    found = {r.conv_id: r for r in conversations.audit_conversations(df).collect()}
    assert set(found) == {k for k, own in convs.items() if own}
    for key, r in found.items():
        cost, audit, lines = brute(convs[key])
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(lines.encode()).hexdigest()), convs[key]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == other_facts(convs[key]), convs[key]


@pytest.mark.parametrize("held", [7, 1 << 20])
def test_long_conversations_spill(spark, monkeypatch, held):
    monkeypatch.setattr(conversations, "HELD", held)
    monkeypatch.setattr(conversations, "ROWS", 5)
    rng, convs = random.Random(held), {}
    for key, size in enumerate([400, 57, 1, 13, 200]):
        convs[str(key)] = made(rng, size)
    rows = [(k, *r, 1) for k, own in convs.items() for r in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, edit int").coalesce(1)
    for r in conversations.audit_conversations(df).collect():
        assert (r.cost, r.audit) == planned(convs[r.conv_id])
    edits = conversations.repair_conversations(df).where("edit <> 'D'").orderBy("conv_id", "seq").collect()
    for key in convs:
        assert PATTERN.fullmatch("".join(r.role[0] for r in edits if r.conv_id == key))


def test_stack_gives_back_in_reverse(monkeypatch):
    monkeypatch.setattr(conversations, "HELD", 4)
    stack, plain, rng = conversations.Stack(), [], random.Random(1)
    for _ in range(3_000):
        if plain and rng.random() < 0.45:
            assert stack.pop() == plain.pop()
        else:
            plain.append(rng.randrange(256))
            stack.push(plain[-1])
    assert [stack.pop() for _ in plain] == plain[::-1]


def test_empty_table_nulls_and_large_ids(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.audit_conversations(spark.createDataFrame([], schema)).count() == 0
    big = 2**60 + 1
    df = spark.createDataFrame([(big, big + 5, None, None), (big, None, "user", None), (None, None, None, "x.")], schema)
    found = {r.conv_id: r for r in conversations.audit_conversations(df).collect()}
    assert (found[big].audit, found[big].cost, found[big].blank, found[big].gaps) == ("DD", 6, 2, 0)
    assert found[None].audit == "D"
    assert {r.turn for r in conversations.repair_conversations(df).collect()} == {big + 5, None}


def test_query(spark):
    raw = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    convs = {}
    for r in raw:
        own = convs.setdefault(r.conv_id, [])
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        own += [] if kind == 0 else [(r.turn, "user" if kind == 4 else r.role, text)] * (2 if kind == 3 else 1)
    found = {r.conv_id: r for r in queries.queries()["op12_conversation_repair"](spark, FOLDER).collect()}
    assert set(found) == set(convs)
    for key, own in convs.items():
        own = ordered(own)
        r = found[key]
        assert (r.cost, r.audit) == planned(own)
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == other_facts(own)


def test_query_keeps_conversations_without_rows(spark, tmp_path):
    gone = next(k for k in range(1_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = queries.queries()["op12_conversation_repair"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
