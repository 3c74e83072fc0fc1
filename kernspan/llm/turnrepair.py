"""Repair of conversation structure by depth-first branch and bound.

A repaired conversation has an optional system turn and then user and assistant turns in
pairs. Rows are kept, given another role or deleted, and empty turns inserted, at least
cost; of the cheapest audits (one letter an edit) the least in ASCII order counts. The
search has an explicit stack. A node is a place among the rows and a state: nothing yet,
after the system turn, after a user or after an assistant. A suffix bound, the cost of
completing a node whatever its audit, prunes what cannot beat the incumbent (cost, audit),
and a table by node drops every prefix that is no better than one seen there.

Rows are sorted over the cluster by conversation and turn, so a long conversation spans
tasks: its rows are cut into segments, each solved on its own from and to every state, and
the segments are chained as a stream. Equal rows travel as one row with a count.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kernspan.llm.tables import stored

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
RE_ROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5

#: rows and bytes of text of a segment, at most (but one row)
SEGMENT_ROWS, SEGMENT_BYTES = 2_048, 8 << 20

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: what may stand after each state; the role a new turn gets there, and the state after it
_NEXT = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: a conversation is empty or ends with an assistant turn
COMPLETE = (NOTHING, ASSISTANT)
_LEGAL = {"su", "ua", "au"}


# ------------------------------------------------------------------------ one segment


@dataclass(frozen=True)
class Item:
    """A row, or a number of rows that must be deleted."""

    role: str = ""
    text: str = ""
    times: int = 1
    forced: bool = False
    cut_off: bool = False

    def kept(self, state: int) -> int | None:
        """The state after keeping the row as it is, None if it may not stand here."""
        first = self.role[:1]
        if first == "s":
            return SYSTEM if state == NOTHING else None
        role, after = _NEXT[state]
        return after if first and role.startswith(first) else None

    def edits(self, state: int) -> Iterator[tuple[str, int, int]]:
        """(letter, cost, next state) of the edits of this row."""
        yield "D", DELETE * self.times, state
        if not self.forced:
            extra = CUT_OFF if self.cut_off else 0
            kept = self.kept(state)
            if kept is not None:
                yield "K", extra, kept
            yield "R", RE_ROLE + extra, _NEXT[state][1]


def suffix_bounds(items: list[Item], ends: tuple[int, ...]) -> list[list[float]]:
    """For each place and state the least cost of getting from there to one of ``ends``."""

    def with_inserts(least: list[float]) -> list[float]:
        for state in (USER, ASSISTANT, USER, NOTHING, SYSTEM):
            least[state] = min(least[state], INSERT + least[_NEXT[state][1]])
        return least

    out = [with_inserts([0.0 if s in ends else math.inf for s in range(4)])]
    for item in reversed(items):
        after = out[-1]
        out.append(with_inserts([min(c + after[s] for _, c, s in item.edits(state)) for state in range(4)]))
    return out[::-1]


def search(items: list[Item], start: int = NOTHING, ends: tuple[int, ...] = COMPLETE) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from ``start`` to one of ``ends``, None if there
    is no way. A number of forced deletions is one letter in this audit."""
    bound = suffix_bounds(items, ends)
    best: tuple[float, str] = (math.inf, "")
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        place, state, cost, audit = stack.pop()
        least = cost + bound[place][state]
        if least > best[0] or least == math.inf or (least == best[0] and audit > best[1][: len(audit)]):
            continue
        if place == len(items) and state in ends:
            best = min(best, (cost, audit))
        known = table.get((place, state))
        if known is not None and known <= (cost, audit):
            continue
        table[place, state] = (cost, audit)
        following = [(place, _NEXT[state][1], cost + INSERT, audit + "I")]
        if place < len(items):
            for letter, price, after in items[place].edits(state):
                following.append((place + 1, after, cost + price, audit + letter))
        # the most promising node is taken next, of equal ones that of the least letter
        following.sort(key=lambda node: (node[2] + bound[node[0]][node[1]], node[3]), reverse=True)
        stack += following
    return None if best[0] == math.inf else (int(best[0]), best[1])


def spelled(items: list[Item], audit: str) -> str:
    """The audit with one letter a row."""
    rows = iter(items)
    return "".join(letter if letter == "I" else letter * next(rows).times for letter in audit)


def edited(items: list[Item], audit: str, start: int = NOTHING) -> list[tuple[str, str]]:
    """(role, text) of the repaired turns."""
    rows, state, out = iter(items), start, []
    for letter in audit:
        if letter == "I":
            role, state = _NEXT[state]
            out.append((role, ""))
            continue
        item = next(rows)
        if letter == "K":
            out.append((item.role, item.text))
            state = item.kept(state)
        elif letter == "R":
            role, state = _NEXT[state]
            out.append((role, item.text))
    return out


def _key(role: str, text: str) -> str:
    """The digest by which a row is known in other segments; ``_row_key`` in Spark."""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def _row_key(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


@dataclass
class Seen:
    """Rows of one segment in order: their faults, and what the search works on."""

    items: list[Item]
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    turns: list[int] | None = None  # the first, the last and the number of distinct ones


def examine(rows: list[tuple], earlier: frozenset = frozenset()) -> Seen:
    """Faults of rows (turn, role, text, copies); ``earlier`` has the digests of rows that
    stand in earlier segments of the conversation."""
    out, known = Seen([]), set()
    for turn, role, text, copies in rows:
        if not copies:
            continue
        if turn is not None:
            if out.turns is None:
                out.turns = [turn, turn, 1]
            elif turn != out.turns[1]:
                out.turns = [out.turns[0], turn, out.turns[2] + 1]
        initial = role[:1]
        if out.last is not None and out.last + initial not in _LEGAL:
            out.illegal += 1
        if out.first is None:
            out.first = initial
        out.last = initial
        out.illegal += copies - 1  # a role never follows itself
        said = text.rstrip(SPACE)
        forced = copies
        if not said:
            out.blank += copies
        elif (role, text) in known or (earlier and _key(role, text) in earlier):
            out.duplicate += copies
        else:
            cut_off = said[-1] not in ENDS
            out.truncated += cut_off
            out.items.append(Item(role, text, cut_off=cut_off))
            forced = copies - 1
            out.duplicate += forced
        known.add((role, text))
        if forced:
            out.items.append(Item(times=forced, forced=True))
    return out


# --------------------------------------------------------------------------- in Spark

_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
_ROW = T.StructType(
    [T.StructField("turn", T.LongType()), *_TURN.fields, T.StructField("copies", T.LongType())]
)


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.LongType()) for name in names]


def _result(conv: T.StructField) -> T.StructType:
    """A conversation (``audit`` is set) or a segment that may be part of one (``rows``)."""
    return T.StructType(
        [
            conv,
            *_long("seq", "gaps", *_COUNTS),
            T.StructField("audit", T.StringType()),
            T.StructField("repaired_sha256", T.StringType()),
            T.StructField("repaired", T.ArrayType(_TURN)),
            T.StructField("rows", T.ArrayType(_ROW)),
        ]
    )


def _gaps(turns: list[int] | None) -> int:
    return 0 if turns is None else turns[1] - turns[0] + 1 - turns[2]


def _digest(lines: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in lines).encode()).hexdigest()


def _whole(rows: list[tuple], keep: bool) -> dict:
    """The result of a conversation that is one segment."""
    seen = examine(rows)
    cost, audit = search(seen.items)
    lines = edited(seen.items, audit)
    return {
        "gaps": _gaps(seen.turns),
        **{name: getattr(seen, name) for name in _COUNTS[:-1]},
        "cost": cost,
        "audit": spelled(seen.items, audit),
        "repaired_sha256": _digest(lines),
        "repaired": [{"role": r, "text": t} for r, t in lines] if keep else None,
    }


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[name].to_pylist() for name in names))


def _segments(
    batches: Iterator[pa.RecordBatch], keep: bool, most_rows: int, most_bytes: int
) -> Iterator[dict]:
    """Sorted rows of a task: conversations that end and begin inside it are solved, what
    may go on in the next task or was begun by the one before is handed on as segments."""
    seq = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    conv, size, inside, begun = None, 0, False, False

    def segment() -> dict:
        return {"rows": [dict(zip(("turn", "role", "text", "copies"), row)) for row in held]}

    for of, *row in _rows(batches, "conv_id", "turn", "role", "text", "copies"):
        if begun and of != conv:
            yield {"conv_id": conv, "seq": seq, **(_whole(held, keep) if inside else segment())}
            held, size, inside, seq = [], 0, True, seq + 1
        elif len(held) >= most_rows or size >= most_bytes:
            yield {"conv_id": conv, "seq": seq, **segment()}
            held, size, inside, seq = [], 0, False, seq + 1
        conv, begun = of, True
        held.append(tuple(row))
        size += 4 * len(row[2])
    if begun:
        yield {"conv_id": conv, "seq": seq, **segment()}


_SOLVED = ("n", "blank", "duplicate", "truncated", "illegal")


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Segments (conv_id, seq, rows, earlier) with the best way between any two states."""
    for conv, seq, rows, earlier in _rows(batches, "conv_id", "seq", "rows", "earlier"):
        seen = examine([(r["turn"], r["role"], r["text"], r["copies"]) for r in rows], frozenset(earlier or ()))
        ways = []
        for start in range(4):
            for end in range(4):
                found = search(seen.items, start, (end,))
                if found is not None:
                    ways.append({"start": start, "end": end, "cost": found[0], "audit": found[1]})
        yield {
            "conv_id": conv,
            "seq": seq,
            **{name: getattr(seen, name) for name in _COUNTS[:-1]},
            "first": seen.first,
            "last": seen.last,
            "turns": seen.turns,
            "ways": ways,
        }


def _before(a: tuple, b: tuple) -> bool:
    """Whether the audit of path a = (start, audit, path before) is less than that of b,
    a path over the same segments; only what differs is put together."""
    said: tuple[list, list] = ([], [])
    while a is not b:
        said[0].append(a[1])
        said[1].append(b[1])
        a, b = a[2], b[2]
    return "".join(reversed(said[0])) < "".join(reversed(said[1]))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Segments by conversation and order: the way that each takes, and on a conversation's
    last segment the numbers of the whole."""
    names = ("conv_id", "seq", *_COUNTS[:-1], "first", "last", "turns", "ways")
    begun, conv = False, None
    seqs: list[int] = []

    def finish() -> Iterator[dict]:
        cost, path = None, None
        for state in COMPLETE:
            if state in reached and (cost is None or reached[state][0] < cost or (reached[state][0] == cost and _before(reached[state][1], path))):
                cost, path = reached[state]
        for number, seq in enumerate(reversed(seqs)):
            start, audit, path = path
            row = {"conv_id": conv, "seq": seq, "start": start, "way": audit}
            if not number:
                row |= {"gaps": _gaps(turns), **total, "cost": cost}
            yield row

    for of, seq, blank, duplicate, truncated, illegal, first, end, span, ways in _rows(batches, *names):
        if not begun or of != conv:
            if begun:
                yield from finish()
            conv, begun, seqs, last, turns = of, True, [], None, None
            total = dict.fromkeys(_COUNTS[:-1], 0)
            reached: dict[int, tuple] = {NOTHING: (0, None)}
        seqs.append(seq)
        for name, value in zip(_COUNTS, (blank, duplicate, truncated, illegal)):
            total[name] += value
        if first is not None:
            total["illegal"] += last is not None and last + first not in _LEGAL
            last = end
        if span is not None:
            again = turns is not None and turns[1] == span[0]
            turns = list(span) if turns is None else [turns[0], span[1], turns[2] + span[2] - again]
        following: dict[int, tuple] = {}
        for way in ways:
            if way["start"] in reached:
                cost, path = reached[way["start"]]
                path, cost = (way["start"], way["audit"], path), cost + way["cost"]
                old = following.get(way["end"])
                if old is None or cost < old[0] or (cost == old[0] and _before(path, old[1])):
                    following[way["end"]] = (cost, path)
        reached = following
    if begun:
        yield from finish()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Repaired segments by conversation and order as one result a conversation."""
    names = ("conv_id", "pieces", "lines", "gaps", *_COUNTS)
    sha, audit, any_line = hashlib.sha256(), [], False
    for conv, said, lines, gaps, *counts in _rows(batches, *names):
        audit.append(said)
        if lines is not None:
            sha.update((b"\n" if any_line else b"") + lines.encode())
            any_line = True
        if gaps is not None:
            row = {"conv_id": conv, "gaps": gaps, **dict(zip(_COUNTS, counts))}
            yield {**row, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
            sha, audit, any_line = hashlib.sha256(), [], False


def _applied(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[dict]:
    """The repaired turns of each segment under the way that was chosen for it."""
    names = ("conv_id", "seq", "rows", "earlier", "start", "way", "gaps", *_COUNTS)
    for conv, seq, rows, earlier, start, way, gaps, *counts in _rows(batches, *names):
        seen = examine([(r["turn"], r["role"], r["text"], r["copies"]) for r in rows], frozenset(earlier or ()))
        lines = edited(seen.items, way, start)
        yield {
            "conv_id": conv,
            "seq": seq,
            "pieces": spelled(seen.items, way),
            "lines": "\n".join(f"{r}:{t}" for r, t in lines) if lines else None,
            "repaired": [{"role": r, "text": t} for r, t in lines] if keep else None,
            "gaps": gaps,
            **dict(zip(_COUNTS, counts)),
        }


def _mapped(df: DataFrame, function, schema: T.StructType) -> DataFrame:
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: _batched(function(batches), arrow), schema)


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "seq")


def _repaired(rows: DataFrame, copies: Column | None, keep: bool) -> tuple[DataFrame, DataFrame]:
    """Results of conversations that one task had whole, and segments of all others with
    the way that is taken through each."""
    slim = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
    )
    gone = F.col("copies") <= 0  # such a row only names its conversation
    slim = slim.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        *[F.when(gone, "").otherwise(F.col(c)).alias(c) for c in ("role", "text")],
        F.when(gone, 0).otherwise(F.col("copies")).alias("copies"),
    )
    distinct = slim.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    ordered = distinct.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    conv = rows.schema["conv_id"]
    conv = T.StructField("conv_id", conv.dataType)
    limits = SEGMENT_ROWS, SEGMENT_BYTES
    cut = stored(_mapped(ordered, lambda it: _segments(it, keep, *limits), _result(conv)), "conversations")

    # rows that stand in an earlier segment of their conversation
    parts = cut.where("audit IS NULL").select("conv_id", "seq", "rows")
    spoken = parts.select("conv_id", "seq", F.explode("rows").alias("row")).where("row.copies > 0")
    spoken = spoken.select("conv_id", "seq", _row_key(F.col("row.role"), F.col("row.text")).alias("key")).distinct()
    first = F.min("seq").over(Window.partitionBy("conv_id", "key"))
    again = spoken.withColumn("first", first).where("first < seq")
    earlier = again.groupBy("seq").agg(F.collect_list("key").alias("earlier"))
    parts = parts.join(earlier, "seq", "left")

    way = T.StructType([*_long("start", "end", "cost"), T.StructField("audit", T.StringType())])
    solved = T.StructType(
        [
            conv,
            *_long("seq", *_COUNTS[:-1]),
            T.StructField("first", T.StringType()),
            T.StructField("last", T.StringType()),
            T.StructField("turns", T.ArrayType(T.LongType())),
            T.StructField("ways", T.ArrayType(way)),
        ]
    )
    chosen = T.StructType([conv, *_long("seq", "start"), T.StructField("way", T.StringType()), *_long("gaps", *_COUNTS)])
    ways = _mapped(_in_order(_mapped(parts, _solved, solved)), _chained, chosen).drop("conv_id")
    applied = T.StructType(
        [
            conv,
            *_long("seq"),
            T.StructField("pieces", T.StringType()),
            T.StructField("lines", T.StringType()),
            T.StructField("repaired", T.ArrayType(_TURN)),
            *_long("gaps", *_COUNTS),
        ]
    )
    return cut, _mapped(parts.join(ways, "seq"), lambda it: _applied(it, keep), applied)


def repair_conversations(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` of every conversation of ``rows(conv_id, turn, role, text)``.

    ``copies`` says how often a row stands in its place; a row with 0 is not there and only
    names its conversation, which may so be empty: zeros, an empty audit and the hash of
    the empty text. Rows are taken by turn (null first), then role, then text. A null role
    or text is one space, a null conv_id is a conversation of its own. A row is blank
    (nothing but white space), else a duplicate (role and text seen earlier), else
    truncated (its last visible character ends no sentence). Blank and duplicate rows are
    deleted, other rows kept, given the role that may stand there, or deleted, and empty
    turns inserted. A role that begins with neither s, u nor a cannot be kept. Other columns
    play no part. A conversation's audit and hash are put together as a stream; the memory
    of a task holds a segment's rows and the conversation's audit.
    """
    cut, parts = _repaired(rows, copies, keep=False)
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    names = ["conv_id", "gaps", *_COUNTS, "audit", "repaired_sha256"]
    schema = T.StructType([f for f in _result(conv) if f.name in names])
    return cut.where("audit IS NOT NULL").select(*names).unionByName(_mapped(_in_order(parts), _hashed, schema))


def repaired_turns(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """``conv_id, seq, place, role, text``: the turns of the repaired conversations, in the
    order of ``seq`` and ``place``; a conversation without turns has no row."""
    cut, parts = _repaired(rows, copies, keep=True)
    both = cut.where("audit IS NOT NULL").select("conv_id", "seq", "repaired").unionByName(
        parts.select("conv_id", "seq", "repaired")
    )
    return both.select("conv_id", "seq", F.posexplode("repaired").alias("place", "turn")).select(
        "conv_id", "seq", "place", "turn.*"
    )
