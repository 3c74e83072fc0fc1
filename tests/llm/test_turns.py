"""Conversation repair against the cheapest path found by trying all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kernspan.llm import turnrepair
from kernspan.llm.queries import op12_turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, lines) over (fault, role, text): a best-first walk over all audits,
    cheapest first, then ASCII-least; states are the rows done and the turns so far."""
    seen = {}
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, done, initials, lines = heapq.heappop(heap)
        tail = (done, initials[-1:], initials == "")
        if done == len(rows) and PATTERN.fullmatch(initials):
            return cost, audit, lines
        if seen.get(tail, (cost + 1,)) <= (cost, audit):
            continue
        seen[tail] = (cost, audit)

        def go(price, letter, used, role, text):
            grown = initials + role[:1]
            ok = grown == "s" or re.fullmatch(r"s?(ua)*u?", grown)
            if role == "" or (ok and len(grown) > len(initials)):
                heapq.heappush(
                    heap,
                    (cost + price, audit + letter, done + used, grown, lines + ((role, text),) * (role != "")),
                )

        for role in ("user", "assistant"):
            go(5, "I", 0, role, "")
        if done < len(rows):
            fault, role, text = rows[done]
            go(2, "D", 1, "", "")
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role:
                    go(extra, "K", 1, role, text)
                for other in ("user", "assistant"):
                    go(1 + extra, "R", 1, other, text)


def expected(conv, rows):
    """The contract's row of one conversation; ``rows`` are (turn, role, text) in order."""
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, known = [], set()
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            fault = "blank"
        elif (role, text) in known:
            fault = "duplicate"
        else:
            fault = "" if re.findall(r"[^\x20\x09-\x0D]", text)[-1] in ".!?" else "truncated"
        known.add((role, text))
        faults.append(fault)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = cheapest([(f, r, t) for f, (_, r, t) in zip(faults, rows)])
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (conv, gaps, *counts, illegal, cost, audit, sha), lines


def place(t):
    return (t[0] is not None, t[0] or 0, t[1], t[2])


def damage(rows):
    """Conversation -> rows (turn, role, text) in order after the contract's damage."""
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        held += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {conv: sorted(held, key=place) for conv, held in out.items()}


def made_up(seed, conversations=250, longest=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "s", "", "User", None]
    texts = ["Yes.", "No!", "Why?", "cut off", " \t", "", None, "a\nb.", "ß 🙂?", "\u0085"]
    rows = []
    for conv in range(conversations):
        clean = rng.random() < 0.4
        for turn in range(rng.randint(1, longest)):
            role = ("user", "assistant")[turn % 2] if clean else rng.choice(roles)
            text = f"text {rng.randrange(9)}." if clean or rng.random() < 0.4 else rng.choice(texts)
            at = rng.choice([turn, turn, turn, turn + 3, None]) if not clean else turn
            rows.append((conv, at, role, text))
    rows += [(None, t, ("user", "assistant")[t % 2], f"null conversation {t}.") for t in range(5)]
    rows += rows[:20] + rows[:1] * 5  # repeated rows
    return rows


def check(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_trying_all(seed):
    rng = random.Random(seed)
    for _ in range(400):
        rows = [
            (rng.choice([None, 1, 2]), rng.choice(["user", "assistant", "system", "x", ""]), rng.choice(["a.", "b", " ", "c?"]))
            for _ in range(rng.randint(0, 8))
        ]
        rows.sort(key=place)
        want, lines = expected(0, rows)
        seen = turnrepair.examine([(*r, 1) for r in rows])
        cost, audit = turnrepair.search(seen.items)
        assert (cost, turnrepair.spelled(seen.items, audit)) == (want[6], want[7])
        assert turnrepair.edited(seen.items, audit) == list(lines)


@pytest.mark.parametrize("limits", [None, (1, 1 << 20), (3, 40)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, limits):
    if limits:
        # tasks of a small table have few rows: short segments make the chains long
        monkeypatch.setattr(turnrepair, "SEGMENT_ROWS", limits[0])
        monkeypatch.setattr(turnrepair, "SEGMENT_BYTES", limits[1])
    rows = made_up(11)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit("taken")).withColumn("seq", F.lit(1))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = op12_turn_repair(spark, str(tmp_path))
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    check(got.collect(), [expected(conv, held)[0] for conv, held in damage(rows).items()])


def chain(rows, size, conv=7):
    """The result of a conversation cut into segments of ``size`` rows, without Spark."""
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    solved, before = [], set()
    for part in parts:
        seen = turnrepair.examine(part, frozenset(before))
        before |= {turnrepair._key(r, t) for _, r, t, _ in part}
        solved.append(seen)
    ways = []
    for seen in solved:
        found = {(a, b): turnrepair.search(seen.items, a, (b,)) for a in range(4) for b in range(4)}
        ways.append({k: v for k, v in found.items() if v})
    reached = {0: (0, "", [])}
    for seen, way in zip(solved, ways):
        following = {}
        for (a, b), (cost, audit) in way.items():
            if a in reached:
                c, said, lines = reached[a]
                new = (c + cost, said + turnrepair.spelled(seen.items, audit), lines + turnrepair.edited(seen.items, audit, a))
                following[b] = min(following.get(b, new), new)
        reached = following
    return min(reached[s] for s in (0, 3) if s in reached)


def test_segments_chain_to_the_whole():
    rng = random.Random(5)
    for _ in range(60):
        rows = sorted(
            ((t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", " ", f"{t}."])) for t in range(rng.randint(1, 24))),
            key=place,
        )
        want, lines = expected(7, rows)
        for size in (1, 3, 7):
            cost, audit, got = chain([(*r, 1) for r in rows], size)
            assert (cost, audit, got) == (want[6], want[7], list(lines))


def test_one_long_conversation_over_many_tasks(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant"]), rng.choice(["same.", f"own {t}.", f"cut {t}"])) for t in range(6000)]
    rows += [(0, 0, "user", "before."), (2, 0, "user", "after."), (2, 1, "assistant", "yes.")]
    rows += [(1, 6000, "user", "many copies.")] * 3000
    got = {r["conv_id"]: r for r in turnrepair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = sorted(((t, r, x) for c, t, r, x in rows if c == 1), key=place)
    seen = turnrepair.examine([(*r, 1) for r in held])
    cost, audit = turnrepair.search(seen.items)
    assert (got[1]["cost"], got[1]["audit"]) == (cost, turnrepair.spelled(seen.items, audit))
    lines = "\n".join(f"{r}:{t}" for r, t in turnrepair.edited(seen.items, audit))
    assert got[1]["repaired_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
    assert [got[1][c] for c in ("blank", "duplicate", "truncated", "illegal", "gaps")] == [
        seen.blank, seen.duplicate, seen.truncated, seen.illegal, 0,
    ]
    assert got[2]["audit"] == "KK" and got[0]["audit"] == "D"


def test_turns_of_repaired_conversations(spark):
    rows = made_up(12, 40)
    turns = turnrepair.repaired_turns(spark.createDataFrame(rows, SCHEMA))
    got = {}
    for r in turns.orderBy("conv_id", "seq", "place").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = {conv: list(expected(conv, sorted(some, key=place))[1]) for conv, some in held.items()}
    assert got == {conv: lines for conv, lines in want.items() if lines}


def test_empty_table(spark):
    assert turnrepair.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
