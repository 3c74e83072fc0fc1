"""Quality rules: a decision list learned by sequential covering.

``text_statistics`` are built-in column expressions; ``learn`` grows and prunes
one conjunction of thresholds after the other from labelled statistics, each step
being one small aggregation; ``verdict`` is the ordered conditional expression.
No Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernspan.llm.tables import SPACE, let, named_apart, stored, words

WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"

STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_capitals", "n_distinct_words",
)

#: feature -> (numerator, denominator, candidate thresholds)
_SHARES = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.5, 2.0)
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words", _SHARES),
    "chars_per_word": ("word_chars", "n_words", tuple(2.0 + i / 4 for i in range(33))),
    "dup_line_share": ("n_dup_lines", "n_lines", _SHARES),
    "repeat_share": ("n_repeat_words", "n_words", _SHARES),
    "capital_share": ("n_capitals", "word_chars", _SHARES),
    "distinct_share": ("n_distinct_words", "n_words", _SHARES),
    "words": ("n_words", None, tuple(float(2**i) for i in range(6, 21))),
}


# ------------------------------------------------------------------ statistics


def _repeated(ws: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that the array holds twice or more.

    Windows are compared by a 64-bit hash of their word hashes. Only an array with
    a repeated window is sorted, so the usual text costs time linear in its length
    and any other n log n.
    """
    hashes = F.transform(ws, lambda w: F.xxhash64(w))

    def covered(starts: Column) -> Column:
        reach = F.transform(
            starts,
            lambda v, k: F.coalesce(F.least(F.lit(width), F.get(starts, k + 1) - v), F.lit(width)),
        )
        return F.aggregate(reach, F.lit(0), lambda a, v: a + v)

    def among(ordered: Column) -> Column:
        twin = F.filter(
            ordered,
            lambda e, k: F.coalesce(F.get(ordered, k - 1)["key"] == e["key"], F.lit(False))
            | F.coalesce(F.get(ordered, k + 1)["key"] == e["key"], F.lit(False)),
        )
        return let(F.sort_array(F.transform(twin, lambda e: e["at"])), covered)

    def of(keys: Column) -> Column:
        pairs = F.transform(keys, lambda key, k: F.struct(key.alias("key"), k.alias("at")))
        return F.when(
            F.size(F.array_distinct(keys)) < F.size(keys), let(F.sort_array(pairs), among)
        ).otherwise(0)

    def windows(hs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hs) - width)
        return F.transform(
            starts, lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(width)])
        )

    return F.when(
        F.size(ws) > width, let(hashes, lambda hs: let(windows(hs), of))
    ).otherwise(0)


def text_statistics(text: Column | str) -> Column:
    """A struct of counts over the whole text (null counts as empty).

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with
    a word that equal an earlier line), n_repeat_words (words in three-word windows
    found twice or more), n_lines (lines with a word), n_capitals (A-Z), and
    n_distinct_words.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lines = F.filter(
        F.split(text, "\n"), lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0
    )

    def counted(ws: Column, ls: Column) -> Column:
        counts = {
            "n_words": F.size(ws),
            "word_chars": F.length(F.array_join(ws, "")),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
            "n_repeat_words": _repeated(ws, WINDOW),
            "n_lines": F.size(ls),
            "n_capitals": F.regexp_count(text, F.lit("[A-Z]")),
            "n_distinct_words": F.size(F.array_distinct(ws)),
        }
        return F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])

    return let(words(text), lambda ws: let(lines, lambda ls: counted(ws, ls)))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


# ------------------------------------------------------------------- decision list


@dataclass(frozen=True)
class Literal:
    """``feature > threshold`` or ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self, value: Column) -> Column:
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction of literals that rejects a document."""

    literals: tuple[Literal, ...]


def _features(stat: dict[str, Column]) -> dict[str, Column]:
    out = {}
    for name, (top, bottom, _) in FEATURES.items():
        value = stat[top].cast("double")
        if bottom:
            value = F.when(stat[bottom] > 0, value / stat[bottom]).otherwise(0.0)
        out[name] = value
    return out


def verdict(rules: list[Rule], stat: dict[str, Column]) -> Column:
    """Whether a document stays: the first rule that holds rejects it."""
    features, out = _features(stat), None
    for rule in rules:
        holds = reduce(
            lambda a, b: a & b, [one.column(features[one.feature]) for one in rule.literals]
        )
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def _cells(labelled: DataFrame, seed: int) -> DataFrame:
    """Labelled rows counted by (bin of each feature, bad, part): the learning table.

    A bin is the number of candidate thresholds below the value, so every literal
    is a comparison of a bin, and equal rows are one weighted row.
    """
    features = _features({name: F.col(name) for name in STATISTICS})
    bins = [
        sum((features[name] > t).cast("int") for t in grid).alias(name)
        for name, (_, _, grid) in FEATURES.items()
    ]
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(3)) == 0
    return (
        labelled.select(*bins, F.col("bad"), part.alias("pruning"))
        .groupBy(*FEATURES, "bad", "pruning")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _holds(literals: list[tuple[str, bool, int]]) -> Column:
    """Bins above index k are those over the k-th threshold."""
    return reduce(
        lambda a, b: a & b,
        [F.col(f) > k if above else F.col(f) <= k for f, above, k in literals],
        F.lit(True),
    )


def _counts(cells: DataFrame) -> dict[tuple[str, int], list[int]]:
    """(feature, bin) -> [good, bad] in one aggregation; its size is that of the grids."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])
    )
    rows = (
        cells.select(pairs.alias("p"), "bad", "n")
        .groupBy("p.f", "p.b", "bad")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    out: dict[tuple[str, int], list[int]] = {}
    for r in rows:
        out.setdefault((r["f"], r["b"]), [0, 0])[int(r["bad"])] += r["n"]
    return out


def _best_literal(counts, taken) -> tuple[float, tuple[str, bool, int]] | None:
    """The literal of the largest information gain, ties to the first in grid order.

    Thresholds with no row between them split alike; the middle one of such a run is
    taken, which leaves the same room to both sides.
    """
    best = None
    for f, (_, _, grid) in FEATURES.items():
        column = [counts.get((f, b), [0, 0]) for b in range(len(grid) + 1)]
        good, bad = sum(c[0] for c in column), sum(c[1] for c in column)
        if not bad:
            return None
        before = math.log2(bad / (good + bad))
        low = [0, 0]
        for k in range(len(grid)):
            low = [low[0] + column[k][0], low[1] + column[k][1]]
            for above in (True, False):
                p = bad - low[1] if above else low[1]
                n = good - low[0] if above else low[0]
                if not p or p + n == good + bad or (f, above, k) in taken:
                    continue
                gain = p * (math.log2(p / (p + n)) - before)
                if best is None or gain > best[0] + 1e-9:
                    end = k
                    while end + 1 < len(grid) and column[end + 1] == [0, 0]:
                        end += 1
                    best = (gain, (f, above, (k + end) // 2))
    return best


def _covered(cells: DataFrame, prefixes: list[list]) -> list[tuple[int, int]]:
    """(good, bad) that each prefix of a rule covers, in one aggregation."""
    sums = []
    for i, literals in enumerate(prefixes):
        for bad in (False, True):
            hit = _holds(literals) & (F.col("bad") == bad)
            sums.append(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias(f"c{i}{bad}"))
    row = cells.agg(*sums).first()
    return [(row[f"c{i}False"], row[f"c{i}True"]) for i in range(len(prefixes))]


def learn(
    labelled: DataFrame,
    seed: int = 17,
    max_rules: int = 12,
    max_literals: int = 3,
    min_precision: float = 0.9,
    min_covered: int = 3,
) -> list[Rule]:
    """Rules by sequential covering over ``labelled``: STATISTICS, doc_id, bad.

    Two thirds of the rows (by a hash of doc_id) grow a rule literal by literal,
    the rest prunes it: the shortest prefix with the best (bad - good) / (bad + good)
    stays. A rule below ``min_precision`` on all uncovered rows ends the list. All
    counts are over every labelled row; only tables the size of the threshold grids
    reach the driver. Without bad rows there is no rule.
    """
    cells = stored(_cells(labelled, seed), "cells")
    rules: list[Rule] = []
    for _ in range(max_rules):
        grown: list[tuple[str, bool, int]] = []
        for _ in range(max_literals):
            counts = _counts(cells.where(~F.col("pruning") & _holds(grown)))
            best = _best_literal(counts, grown)
            if best is None or best[0] <= 0:
                break
            grown.append(best[1])
        if not grown:
            break
        prefixes = [grown[: i + 1] for i in range(len(grown))]
        worth = [
            (p - n) / (p + n) if p + n else -1.0
            for n, p in _covered(cells.where("pruning"), prefixes)
        ]
        literals = prefixes[worth.index(max(worth))]
        n, p = _covered(cells, [literals])[0]
        if p < min_covered or p < min_precision * (p + n):
            break
        rules.append(
            Rule(tuple(Literal(f, above, FEATURES[f][2][k]) for f, above, k in literals))
        )
        cells = cells.where(~_holds(literals))
    return rules


# ----------------------------------------------------------------------- operator


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statistics of all documents, those of labelled ones that pass the base rules).

    A document labelled more than once is bad if most of its labels say so.
    """
    counted = docs.select("doc_id", text_statistics("text").alias("s"))
    stats = stored(counted.select("doc_id", "s.*"), "stats")
    votes = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((F.avg(F.col("quality")) < 0.5).alias("bad"))
    )
    passed = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return stats, passed.join(votes, "doc_id")


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, list[Rule]]:
    """doc_id, the statistics, ``base_failed`` and ``kept`` per row, and the rules.

    Null or empty texts have no words and fail the base rules. Rows that repeat stay
    repeated; other columns are not read. An empty table gives no rows and no rules.
    """
    stats, labelled = labelled_statistics(docs, labels)
    rules = learn(labelled, **options)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    kept = ~failed & verdict(rules, {n: F.col(n) for n in STATISTICS})
    return stats.select("*", failed.alias("base_failed"), kept.alias("kept")), rules


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is kept, all columns as they are."""
    _, labelled = labelled_statistics(docs, labels)
    rules = learn(labelled, **options)
    (s,) = named_apart(docs, "statistics")
    stat = {n: F.col(s)[n] for n in STATISTICS}
    failed = base_failed(stat["n_words"], stat["n_repeat_words"])
    return docs.withColumn(s, text_statistics("text")).where(~failed & verdict(rules, stat)).drop(s)
