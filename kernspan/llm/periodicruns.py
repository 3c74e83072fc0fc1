"""Runs of repeating words, found through a Re-Pair grammar of the words.

The words of a document become numbers, and pairs of neighbours that occur at least twice
become nonterminals, the most frequent first, until none does. Pairs that do not touch one
another are replaced in the same round, over all documents of a chunk at once; a pair that
touches a more frequent one waits.

A run crosses the boundary between the halves of the lowest node of the grammar that holds
it whole. So the runs that cross a nonterminal's boundary are computed once, in its first
occurrence, from common extensions to both sides, and moved to all places where the
nonterminal was derived. Boundaries that stay between the symbols of the final sequence
are searched in the same way. Intervals of one period that overlap by a period or more are
one run, which gives the maximal ones. Every run is checked word by word at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: words that are processed together; a longer document is a chunk of its own
CHUNK_WORDS = 400_000
#: a run has at least this many words, and this many periods
LEAST_WORDS, LEAST_PERIODS = 6, 4

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


# ---------------------------------------------------------------------------- grammar


@dataclass
class Grammar:
    """Derived nodes: their rule and where each begins, is parted and ends. ``top`` are
    the places between symbols of the final sequence whose words repeat as a pair."""

    rule: np.ndarray
    start: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    top: np.ndarray


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def re_pair(ids: np.ndarray, doc: np.ndarray) -> Grammar:
    """The grammar of all documents of a chunk; no pair reaches over two documents."""
    n, width = len(ids), int(ids.max(initial=0)) + 1
    none = np.empty(0, np.int64)
    together = np.flatnonzero(doc[1:] == doc[:-1])
    pair = (doc[together] * width + ids[together]) * width + ids[together + 1]
    together = together[_repeated(pair)]
    linked = np.zeros(n, bool)  # between a symbol and the next one
    linked[together] = True
    open_place = np.zeros(n + 1, bool)
    open_place[together + 1] = True

    def only_linked(*columns: np.ndarray) -> list[np.ndarray]:
        near = linked | np.concatenate([[False], linked[:-1]])
        return [c[near] for c in (linked, *columns)]

    linked, symbol, start, end = only_linked(doc * width + ids, np.arange(n), np.arange(n) + 1)
    symbol = np.unique(symbol, return_inverse=True)[1].astype(np.int64)
    fresh = words = int(symbol.max(initial=-1)) + 1
    nodes: list[tuple] = []
    known, named = none, none  # pairs that have a rule, and its number
    while True:
        at = np.flatnonzero(linked)
        pairs, which, count = np.unique(
            (symbol[at] << 31) + symbol[at + 1], return_inverse=True, return_counts=True
        )
        linked[at[count[which] < 2]] = False
        at, which = at[count[which] >= 2], which[count[which] >= 2]
        if not len(at):
            break
        # most frequent first; pairs of equal count in a mixed order, so that few wait long
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((mixed, count))] = np.arange(len(pairs))
        weight = np.full(len(symbol) + 2, -1)
        weight[at + 1] = rank[which]
        own = weight[at + 1]
        first = (own >= weight[at]) & (own >= weight[at + 2])
        chosen = np.flatnonzero(first)
        # of a row of equal pairs, which overlap, every other one
        new_row = np.diff(at[chosen], prepend=-2) != 1
        row_start = np.maximum.accumulate(np.where(new_row, np.arange(len(chosen)), 0))
        chosen = chosen[(np.arange(len(chosen)) - row_start) % 2 == 0]
        taken = np.bincount(which[chosen], minlength=len(pairs))
        waiting = np.bincount(which[~first], minlength=len(pairs))
        # an overlap alone counted twice: such a pair has one place and stays as it is
        linked[at[((taken < 2) & (waiting == 0))[which]]] = False
        chosen = chosen[taken[which[chosen]] >= 2]
        if len(chosen):
            number = np.arange(len(pairs)) + fresh
            fresh += len(pairs)
            seen = np.searchsorted(known, pairs)
            old = np.append(known, -1)[seen] == pairs
            number[old] = named[seen[old]]
            added = ~old & (np.bincount(which[chosen], minlength=len(pairs)) > 0)
            known, named = np.append(known, pairs[added]), np.append(named, number[added])
            order = np.argsort(known)
            known, named = known[order], named[order]

            left, rule = at[chosen], number[which[chosen]]
            nodes.append((rule, start[left], end[left], end[left + 1]))
            symbol[left] = rule
            end[left] = end[left + 1]
            linked[left] = linked[left + 1]
            stays = np.ones(len(symbol), bool)
            stays[left + 1] = False
            linked, symbol, start, end = (c[stays] for c in (linked, symbol, start, end))
        linked, symbol, start, end = only_linked(symbol, start, end)
    rule, begins, middle, ends = (np.concatenate(c) for c in zip(*nodes)) if nodes else (none,) * 4
    open_place[middle] = False
    return Grammar(rule - words, begins, middle, ends, np.flatnonzero(open_place))


# ------------------------------------------------------------------- common extensions


class Extensions:
    """How far words agree from two places on, by prefix hashes and bisection."""

    _BASE = 0xD6E8FEB86659FD93

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        values = np.random.default_rng(7).integers(1, 1 << 63, int(ids.max(initial=0)) + 1, dtype=np.uint64)
        power = np.full(n + 1, self._BASE, np.uint64)
        power[:1] = 1
        self.power = np.multiply.accumulate(power)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[ids] * self.power[:n], dtype=np.uint64)])

    def _equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from a and from b >= a agree over ``length``."""
        first = (self.sums[a + length] - self.sums[a]) * self.power[b - a]
        return first == self.sums[b + length] - self.sums[b]

    def _most(self, limit: np.ndarray, agrees) -> np.ndarray:
        low, high = np.zeros_like(limit), limit.copy()
        while True:
            active = np.flatnonzero(low < high)
            if not len(active):
                return low
            middle = (low[active] + high[active] + 1) // 2
            good = agrees(active, middle)
            low[active[good]] = middle[good]
            high[active[~good]] = middle[~good] - 1

    def forward(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words that agree from a and from b > a on, at most ``limit``."""
        return self._most(limit, lambda i, length: self._equal(a[i], b[i], length))

    def backward(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words that agree up to a and up to b > a, both left out."""
        return self._most(limit, lambda i, length: self._equal(a[i] - length, b[i] - length, length))


class Groups:
    """Places of equal groups of ``size`` words within a document; groups that occur once
    have the number -1."""

    def __init__(self, numbers: np.ndarray, size: int):
        """``numbers`` tell groups apart, negative where there is none."""
        self.size, self.n = size, len(numbers)
        at = np.flatnonzero(numbers >= 0)
        _, which, count = np.unique(numbers[at], return_inverse=True, return_counts=True)
        often = count[which] >= 2
        at, which = at[often], which[often].astype(np.int64)
        self.number = np.full(self.n + 1, -1)
        self.number[at] = which
        self.places = np.sort(which * self.n + at)

    @staticmethod
    def words(ids: np.ndarray, doc: np.ndarray, open_place: np.ndarray) -> Groups:
        """Single words next to a pair that repeats."""
        near = open_place[:-1] | open_place[1:]
        return Groups(np.where(near, doc * (int(ids.max(initial=0)) + 1) + ids, -1), 1)

    def doubled(self, open_place: np.ndarray) -> Groups:
        """Groups of twice the size, each two of this size that meet in an open place."""
        half = self.number[: self.n]
        rest = np.full(self.n, -1)
        rest[: max(0, self.n - self.size)] = half[self.size :]
        meets = np.zeros(self.n, bool)
        meets[: max(0, self.n - self.size)] = open_place[self.size : self.n]
        both = (half >= 0) & (rest >= 0) & meets
        return Groups(np.where(both, half * (self.n + 1) + rest, -1), 2 * self.size)

    def after(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place from ``place`` on of a group, n if there is none."""
        i = np.searchsorted(self.places, number * self.n + np.minimum(place, self.n))
        known = self.places[np.minimum(i, len(self.places) - 1)]
        return np.where((i < len(self.places)) & (known // self.n == number), known % self.n, self.n)

    def before(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The last place up to ``place`` of a group, -1 if there is none."""
        i = np.searchsorted(self.places, number * self.n + place, "right") - 1
        known = self.places[np.maximum(i, 0)]
        return np.where((i >= 0) & (place >= 0) & (known // self.n == number), known % self.n, -1)


# --------------------------------------------------------------------- crossing runs


def crossing_runs(
    low: np.ndarray, middle: np.ndarray, high: np.ndarray, ext: Extensions, groups: Groups, open_place: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, start, end, period) of intervals within [low, high) that cross ``middle``,
    repeat with the period as often as a run must, and cannot be longer in there.

    Such an interval has two periods on one side of the middle. A period of s up to 2 s
    words is the distance to an equal group of s words on that side, so sizes double from
    single words on, and few groups of a size come back so near.
    """
    none = np.empty(0, np.int64)
    found: list[tuple] = [(none,) * 4]
    # a square that was found rules out all periods up to where its period stops holding
    ruled_out = {side: np.zeros(len(middle), np.int64) for side in ("right", "left")}

    def keep(node, start, end, period) -> None:
        size = end - start
        good = (size >= LEAST_WORDS) & (size >= LEAST_PERIODS * period)
        found.append((node[good], start[good], end[good], period[good]))

    def to_right(node: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How far the period goes on from the middle; runs with two periods are kept."""
        m, lo, hi = middle[node], low[node], high[node]
        more = ext.forward(m, m + period, hi - m - period)
        good = more >= period
        i, p, mid = node[good], period[good], m[good]
        back = ext.backward(mid, mid + p, mid - lo[good])
        keep(i, mid - back, mid + p + more[good], p)
        return more

    def to_left(node: np.ndarray, period: np.ndarray) -> np.ndarray:
        m, lo, hi = middle[node], low[node], high[node]
        more = ext.backward(m - period, m, m - period - lo)
        good = more >= period
        i, p, mid = node[good], period[good], m[good]
        on = ext.forward(mid - p, mid, hi[good] - mid)
        keep(i, mid - p - more[good], mid + on, p)
        return more

    while len(groups.places):
        size = groups.size
        tail = np.maximum(middle - size, 0)
        room = np.minimum(np.where(groups.number[middle] >= 0, high - middle, 0) // 2, 2 * size - 1)
        node, least = np.flatnonzero(room >= size), np.full(len(middle), size)
        while len(node):
            start = middle[node] + np.maximum(least[node], ruled_out["right"][node] + 1)
            period = groups.after(groups.number[middle[node]], start) - middle[node]
            fits = period <= room[node]
            node, period = node[fits], period[fits]
            more = to_right(node, period)
            good = more >= period
            ruled_out["right"][node[good]] = np.maximum(ruled_out["right"][node[good]], more[good])
            least[node] = period + 1

        room = np.minimum(np.where((middle >= size) & (groups.number[tail] >= 0), middle - low, 0) // 2, 2 * size - 1)
        node, least = np.flatnonzero(room >= size), np.full(len(middle), size)
        while len(node):
            start = tail[node] - np.maximum(least[node], ruled_out["left"][node] + 1)
            place = groups.before(groups.number[tail[node]], start)
            period = tail[node] - place
            fits = (place >= 0) & (period <= room[node])
            node, period = node[fits], period[fits]
            more = to_left(node, period)
            good = more >= period
            ruled_out["left"][node[good]] = np.maximum(ruled_out["left"][node[good]], more[good])
            least[node] = period + 1
        groups = groups.doubled(open_place)
    return tuple(np.concatenate(c) for c in zip(*found))


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of one period that overlap by the period or more as one."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    far = int(end.max()) + 1
    group = np.cumsum(np.diff(period, prepend=period[0]) != 0)
    reach = np.maximum.accumulate(end + group * far)
    opens = np.ones(len(start), bool)
    opens[1:] = (start + period + group * far)[1:] > reach[:-1]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(start)) - 1
    return start[first], (reach - group * far)[last], period[first]


def _has_smaller_period(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether the words of one period repeat within it a whole number of times."""
    left, prime, block = period, 2, ids[start : start + period]
    while left > 1:
        if left % prime:
            prime = prime + 1 if prime * prime <= left else left
            continue
        while left % prime == 0:
            left //= prime
        step = period // prime
        if np.array_equal(block[:-step], block[step:]):
            return True
    return False


def runs_by_period(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one document, trying every period."""
    out, n = [], len(ids)
    for q in range(1, n // LEAST_PERIODS + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            size = b - a + q
            if size >= max(LEAST_WORDS, LEAST_PERIODS * q) and not _has_smaller_period(ids, a, q):
                out.append((a, size, q))
    return sorted(out, key=lambda run: (run[0], run[2]))


def find_runs(ids: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs, by start and period, of each document of a
    chunk; ``ids`` are the words of all, ``sizes`` how many each document has."""
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    out: list[list] = [[] for _ in sizes]
    if not len(ids):
        return out
    grammar = re_pair(ids, doc)
    open_place = np.zeros(len(ids) + 1, bool)
    open_place[grammar.top] = True
    open_place[grammar.middle] = True
    ext = Extensions(ids)

    # each rule once, in its first occurrence, and the places of the final sequence
    rules, first, which = np.unique(grammar.rule, return_index=True, return_inverse=True)
    own = doc[np.minimum(grammar.top, len(ids) - 1)]
    low = np.concatenate([grammar.start[first], (ends - sizes)[own]])
    middle = np.concatenate([grammar.middle[first], grammar.top])
    high = np.concatenate([grammar.end[first], ends[own]])
    node, start, end, period = crossing_runs(low, middle, high, ext, Groups.words(ids, doc, open_place), open_place)

    # moved to every place where the rule was derived
    order = np.argsort(which, kind="stable")
    uses = np.concatenate([np.bincount(which, minlength=len(rules)), np.ones(len(grammar.top), np.int64)])
    begin = np.concatenate([[0], np.cumsum(uses)[:-1]])
    source = np.concatenate([grammar.start[order], low[len(rules) :]])
    times = uses[node]
    each = np.repeat(np.arange(len(node)), times)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
    shift = source[begin[node[each]] + nth] - low[node[each]]
    start, end, period = _merged(start[each] + shift, end[each] + shift, period[each])

    wrong = set()
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
        d = int(doc[s])
        a, z = int(ends[d] - sizes[d]), int(ends[d])
        longer = (s > a and ids[s - 1] == ids[s - 1 + q]) or (e < z and ids[e] == ids[e - q])
        if longer or not np.array_equal(ids[s : e - q], ids[s + q : e]):
            wrong.add(d)  # two different groups of words with one hash
        elif not _has_smaller_period(ids, s, q):
            out[d].append((s - a, e - s, q))
    for d in wrong:
        out[d] = runs_by_period(ids[ends[d] - sizes[d] : ends[d]])
    return [sorted(runs, key=lambda run: (run[0], run[2])) for runs in out]


# -------------------------------------------------------------------------- documents


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run covers after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    stays = np.cumsum(gone[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(stays).tolist()])


def _chunks(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of the texts, in chunks of documents of bounded size."""
    held: list[list[bytes]] = []
    size = 0
    for text in texts:
        words = (text or b"").split()
        if held and size + len(words) > CHUNK_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    for batch in batches:
        done = 0
        for chunk in _chunks(batch["text"].cast(pa.binary()).to_pylist()):
            flat = pa.array([w for words in chunk for w in words], pa.binary()).dictionary_encode()
            ids = flat.indices.to_numpy().astype(np.int64)
            runs = find_runs(ids, np.array([len(words) for words in chunk]))
            texts = [collapsed(w, r) for w, r in zip(chunk, runs)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"].slice(done, len(chunk)),
                    "n_words": pa.array([len(w) for w in chunk], pa.int64()),
                    "runs": pa.array(
                        [[dict(zip(("start", "length", "period"), r)) for r in of] for of in runs], kind
                    ),
                    "collapsed": pa.array(texts, pa.binary()).cast(pa.string()),
                }
            )
            done += len(chunk)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs(doc_id, text)``.

    A run is a stretch of words with smallest period q, of at least 6 words and 4 q, that
    no neighbouring word extends; ``runs`` has the start (a word number), length and
    period of each, by start, then period. ``collapsed`` has the words that are in no run
    after its first q words, joined by one space. Words are what ASCII white space parts;
    a text that is null or has no words has no runs and collapses to the empty text. Every
    row is on its own, so repeated and null ids do not matter; other columns play no part.
    A document is processed as a whole, in memory proportional to its words.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(_described, schema)


def with_digests(found: DataFrame) -> DataFrame:
    """The longest run of each document (ties: smallest start, then period; none: nulls)
    and digests of all runs and of the collapsed text."""
    longest = F.element_at(
        F.array_sort(
            F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period")))
        ),
        1,
    )
    lines = F.array_join(
        F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), ""
    )
    first = found.withColumn("longest", F.when(F.size("runs") > 0, longest))
    length = -F.col("longest.less")
    return first.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(1000 * length / F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
