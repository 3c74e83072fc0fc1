"""Mixing sources to target weights: budgets down a domain-language-source tree.

A budget is split among children in proportion to their weights; what a child cannot
hold goes to its siblings, and only what none of them can hold goes to the branches
beside their parent. A leaf's stream is its documents in seeded order, epoch after
epoch, and its selection is the prefix of that stream that fills its budget.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernspan.llm.tables import SPACE, named_apart, stored

LEVELS = ("domain", "lang", "source")
#: ranges of a leaf's order that are summed before one is looked into
ORDER_RANGES = 1 << 14
#: leaves of 40 bytes that are broadcast at most; more are joined by a shuffle
BROADCAST_LEAVES = 100_000


def word_tokens(text: Column | str) -> Column:
    """Words of a text, the tokens a budget counts; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE.replace("[", "[^", 1))).cast("long")


def share_out(children: DataFrame, path: list[str], budget: Column, out: str) -> DataFrame:
    """``children`` with ``out``: the share of ``budget`` (their parent's) of each.

    ``path`` names a child; all but its last column name the parent.

    Columns ``weight`` and ``room`` are the child's target weight and what it can hold.
    Shares are ``min(room, level * weight)`` with the level that uses the budget up; a
    level closes the children in order of room / weight, so running sums in that order
    find it. Children without weight or room get nothing. A window holds the children
    of one parent.
    """
    open_ = (F.col("weight") > 0) & (F.col("room") > 0)
    weight = F.when(open_, F.col("weight").cast("double")).otherwise(0.0)
    room = F.when(open_, F.col("room").cast("double")).otherwise(0.0)
    ratio = F.when(open_, room / weight).otherwise(0.0)
    by = Window.partitionBy(*path[:-1]) if path[:-1] else Window.partitionBy(F.lit(0))
    upto = by.orderBy(ratio, *path).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.sum(room).over(upto) + ratio * (F.sum(weight).over(by) - F.sum(weight).over(upto))
    staged = children.withColumn("full_", filled <= budget * (1 + 1e-12))
    held = F.sum(F.when(F.col("full_"), room).otherwise(0.0)).over(by)
    open_weight = F.sum(F.when(F.col("full_"), 0.0).otherwise(weight)).over(by)
    share = F.when(F.col("full_"), room).otherwise(
        weight * (budget - held) / open_weight
    )
    return staged.withColumn(out, share).drop("full_")


def leaf_budgets(
    leaves: DataFrame,
    budget: Column,
    max_epochs: int,
    weights: dict[str, Column],
) -> DataFrame:
    """Each leaf's ``budget`` in whole tokens, from its ``supply``.

    ``leaves`` has one row per (domain, lang, source). ``weights`` gives the target
    weight of a child by level, over the columns of its path; weights of siblings need
    not add up to one. ``budget`` is an aggregate over ``leaves``, so that it can follow
    the supply.
    """
    room = F.col("supply") * max_epochs
    total = leaves.agg(budget.cast("double").alias("total")).first()["total"] or 0.0
    above: DataFrame | None = None
    for depth in range(1, len(LEVELS) + 1):
        path = list(LEVELS[:depth])
        children = leaves.groupBy(*path).agg(F.sum(room).alias("room"))
        children = children.withColumn("weight", weights[path[-1]])
        given = F.lit(total)
        if above is not None:
            children = _beside(children, above, path[:-1])
            given = F.col("given")
        shared = share_out(children, path, given, "share")
        above = shared.select(*path, F.col("share").alias("given"))
    whole = F.least(F.floor(F.col("given") + 1e-6), room).cast("long")
    return _beside(leaves, above, list(LEVELS)).select(*LEVELS, "supply", whole.alias("budget"))


def _beside(left: DataFrame, right: DataFrame, path: list[str]) -> DataFrame:
    """Left rows with the ``given`` of their row in ``right``; nulls match nulls."""
    named = right.select(*[F.col(c).alias(f"{c}_") for c in path], "given")
    match = reduce(lambda a, b: a & b, [left[c].eqNullSafe(named[f"{c}_"]) for c in path])
    return left.join(named, match).drop(*[f"{c}_" for c in path])


def _order(seed: int, epoch: Column) -> Column:
    """A document's place in the seeded order of an epoch."""
    return F.xxhash64("doc_id", F.lit(seed), epoch)


def plan(
    slim: DataFrame,
    budget: Column,
    weights: dict[str, Column],
    max_epochs: int,
    seed: int,
) -> tuple[DataFrame, DataFrame]:
    """(last, cuts) of a stored table doc_id, domain, lang, source, n_tokens.

    ``cuts`` has one row per leaf: budget, full_epochs, last_tokens (what the last,
    partial epoch has to give), and cut_at, the order of the document it ends in.
    ``last`` has the documents in the range of the order where it ends, with the tokens
    before them. A leaf's order is summed by ranges first; only that one range is put in
    order, so no task sees a whole leaf.
    """
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")).where("supply > 0")
    leaves = stored(leaves, "leaves")
    budgets = stored(leaf_budgets(leaves, budget, max_epochs, weights), "budgets")
    budgets = budgets.withColumn("full_epochs", F.floor(F.col("budget") / F.col("supply")))
    budgets = budgets.withColumn(
        "last_tokens", F.col("budget") - F.col("full_epochs") * F.col("supply")
    ).withColumn("leaf", F.xxhash64(*LEVELS, *[F.col(c).isNull() for c in LEVELS]))
    leaf = F.xxhash64(*LEVELS, *[F.col(c).isNull() for c in LEVELS])
    partial = budgets.where("last_tokens > 0").select("leaf", "full_epochs", "last_tokens")
    placed = (
        slim.where("n_tokens > 0")
        .withColumn("leaf", leaf)
        .join(partial, "leaf")
        .withColumn("place", _order(seed, F.col("full_epochs")))
        .withColumn("range", F.shiftrightunsigned("place", 64 - ORDER_RANGES.bit_length() + 1))
    )
    sums = placed.groupBy("leaf", "range", "last_tokens").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(
        "before < last_tokens and before + n >= last_tokens"
    )
    cut = stored(cut.select("leaf", "range", "before"), "cuts")
    within = Window.partitionBy("leaf").orderBy(F.col("place"), "doc_id", "n_tokens")
    running = within.rowsBetween(Window.unboundedPreceding, -1)
    last = (
        placed.join(cut, ["leaf", "range"])
        .withColumn("ahead", F.col("before") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0)))
        .where("ahead < last_tokens")
    )
    last = stored(last, "last")
    ends = last.groupBy("leaf").agg(F.max("place").alias("cut_at"), F.max("range").alias("cut_range"))
    return last, budgets.join(ends, "leaf", "left")


def slim_table(docs: DataFrame, domain: Column) -> DataFrame:
    return stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"), "lang", "source",
            word_tokens("text").alias("n_tokens"),
        ),
        "tokens",
    )


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, Column],
    budget: Column,
    max_epochs: int = 4,
    seed: int = 7,
) -> DataFrame:
    """One row per document and epoch it is taken in: doc_id, domain, lang, source,
    epoch (from 0), n_tokens, taken_tokens.

    All epochs but a leaf's last take every document whole. The last one takes
    documents in its seeded order until the leaf's budget is filled; the document it
    ends in gives only the first ``taken_tokens`` tokens. Documents without words (null
    text included) are never taken. A null lang or source is a leaf of its own. Rows of
    equal order (repeated ids) are taken shortest first. An empty table gives no rows.
    """
    slim = slim_table(docs, domain)
    last, cuts = plan(slim, budget, weights, max_epochs, seed)
    leaf = F.xxhash64(*LEVELS, *[F.col(c).isNull() for c in LEVELS])
    placed = slim.where("n_tokens > 0").withColumn("leaf", leaf).join(
        cuts.select("leaf", "full_epochs", "cut_range"), "leaf"
    )
    columns = ["doc_id", *LEVELS, "epoch", "n_tokens", "taken_tokens"]
    whole = placed.where("full_epochs > 0").select(
        "*",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("full_epochs") - 1)).alias("epoch"),
        F.col("n_tokens").alias("taken_tokens"),
    )
    place = _order(seed, F.col("full_epochs"))
    ahead = F.shiftrightunsigned(place, 64 - ORDER_RANGES.bit_length() + 1) < F.col("cut_range")
    early = placed.where(ahead).select(
        "*", F.col("full_epochs").alias("epoch"), F.col("n_tokens").alias("taken_tokens")
    )
    ending = last.select(
        "*",
        F.col("full_epochs").alias("epoch"),
        F.least("n_tokens", F.col("last_tokens") - F.col("ahead")).alias("taken_tokens"),
    )
    return whole.select(columns).unionByName(early.select(columns)).unionByName(ending.select(columns))


def keep_mixed(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, Column],
    budget: Column,
    seed: int = 7,
) -> DataFrame:
    """The rows of ``docs`` that one epoch of the mixture takes, whole.

    The document a leaf's prefix ends in stays, with every row of its order (repeated
    ids). Documents without words go. Columns are as they were.
    """
    slim = slim_table(docs, domain)
    _, cuts = plan(slim, budget, weights, 1, seed)
    leaf, dom = named_apart(docs, "leaf", "domain_of_leaf")
    names = {c: F.col(c) for c in ("lang", "source")} | {"domain": F.col(dom)}
    path = [names[c] for c in LEVELS]
    ends = cuts.select(F.col("leaf").alias(leaf), "full_epochs", "cut_range", "cut_at")
    a, b, c, place = named_apart(docs, "full_epochs_", "cut_range_", "cut_at_", "place_")
    ends = ends.toDF(leaf, a, b, c)
    if ends.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:
        ends = F.broadcast(ends)
    taken = (
        docs.withColumn(dom, domain)
        .withColumn(leaf, F.xxhash64(*path, *[p.isNull() for p in path]))
        .join(ends, leaf)
        .withColumn(place, F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed), F.col(a)))
    )
    bits = 64 - ORDER_RANGES.bit_length() + 1
    early = F.shiftrightunsigned(place, bits) < F.col(b)
    at_end = (F.shiftrightunsigned(place, bits) == F.col(b)) & (F.col(place) <= F.col(c))
    stays = (F.col(a) > 0) | F.coalesce(early | at_end, F.lit(False))
    return taken.where(stays & (word_tokens("text") > 0)).select(*docs.columns)
