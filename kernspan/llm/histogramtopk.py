"""Exact top-k search by distributed histogram selection.

Every query row is scored against every row. Instead of moving scores, cells of the
(row group x query group) grid count them in a histogram per query; the counts are added
up in Spark, the bin that holds a query's k-th highest score is cut into finer bins, and
the scores are counted again, until a bin is one integer wide. What reaches that value
is then gathered, a few rows a query, and ties at it go to the smaller id.

Rows travel as packed blocks of 16-bit integers where they fit. Scores are exact: a cell
multiplies in single or double precision only where every partial sum is an integer that
type holds, otherwise in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernspan.llm.tables import stored

#: what a component is multiplied by before it is rounded down
SCALE = 256
#: bins of one refinement step
BINS = 64
#: rows of a row group: from LEAST_ROWS up to MOST_ROWS, with FEW_GROUPS groups between
LEAST_ROWS, MOST_ROWS, FEW_GROUPS = 8_192, 262_144, 64
#: rows of a query group
QUERY_ROWS = 32_768
#: components of one packed block, and scores that a cell holds at once
BLOCK_VALUES = 1 << 20
#: scores beyond this bound (in either direction) count as the bound
MOST_SCORE = 1 << 60

_BLOCK = "block long, dims int, kind string, ids array<long>, wanted array<boolean>, vectors binary, longest double"
_QUERY = "q_block long, q_at int, query_id long, dims int, kind string, vector binary, norm double"


def _matrix(raw: bytes, kind: str, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, np.dtype(kind)).reshape(rows, dims)


def _integers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their lengths, all their components rounded down)."""
    keep = np.asarray(vectors.is_valid())
    lengths = np.where(keep, np.asarray(vectors.value_lengths().fill_null(0)), 0)
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float, copy=False)  # null: nan
    owner = np.repeat(np.arange(len(vectors)), lengths)
    odd = np.zeros(len(vectors), bool)
    odd[owner[~np.isfinite(values)]] = True
    used = ~odd[owner]
    with np.errstate(over="ignore"):
        whole = np.floor(values[used] * scale)
    return keep & ~odd, lengths, np.clip(whole, -np.finfo(float).max, np.finfo(float).max)


def _packed(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, embedding, wanted) as blocks; vectors that take no part are left out."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        usable, lengths, values = _integers(batch["embedding"], scale)
        ids, wanted = (batch[c].filter(pa.array(usable)) for c in ("vec_id", "wanted"))
        lengths = lengths[usable].astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < len(lengths):
            # as many rows as fit, each as wide as the longest of them
            widest = np.maximum.accumulate(lengths[start : start + BLOCK_VALUES])
            fit = np.searchsorted(np.maximum(widest, 1) * np.arange(1, len(widest) + 1), BLOCK_VALUES, "right")
            stop = start + max(1, int(fit))
            part, dims = lengths[start:stop], int(widest[stop - start - 1])
            block = np.zeros((stop - start, dims))
            block[np.arange(dims) < part[:, None]] = values[ends[start] - lengths[start] : ends[stop - 1]]
            small = not block.size or np.abs(block).max() < 1 << 15
            with np.errstate(over="ignore"):
                longest = np.sqrt((block * block).sum(1)).max()
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "dims": pa.array([dims], pa.int32()),
                    "kind": ["i2" if small else "f8"],
                    "ids": pa.array([ids[start:stop]], pa.list_(pa.int64())),
                    "wanted": pa.array([wanted[start:stop]], pa.list_(pa.bool_())),
                    "vectors": pa.array([block.astype("i2" if small else "f8").tobytes()], pa.binary()),
                    "longest": [float(longest)],
                }
            )
            number, start = number + 1, stop


def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted rows of packed blocks, one row each, named by block and place."""
    for batch in batches:
        for row in batch.to_pylist():
            at = np.flatnonzero(row["wanted"])
            rows = _matrix(row["vectors"], row["kind"], len(row["ids"]), row["dims"])[at]
            with np.errstate(over="ignore"):
                norms = np.sqrt((rows.astype(float) ** 2).sum(1))
            n = len(at)
            yield pa.RecordBatch.from_pydict(
                {
                    "q_block": pa.array([row["block"]] * n, pa.int64()),
                    "q_at": pa.array(at, pa.int32()),
                    "query_id": pa.array([row["ids"][i] for i in at], pa.int64()),
                    "dims": pa.array([row["dims"]] * n, pa.int32()),
                    "kind": pa.array([row["kind"]] * n, pa.string()),
                    "vector": pa.array([r.tobytes() for r in rows], pa.binary()),
                    "norm": pa.array(norms, pa.float64()),
                }
            )


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, (rows, queries); a vector has zeros beyond its end."""
    dims = min(rows.shape[1], queries.shape[1])
    a, b = rows[:, :dims], queries[:, :dims]
    most = dims and len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * dims
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = [np.array([int(v) for v in m.ravel()], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -MOST_SCORE, MOST_SCORE).astype(np.int64)


def _scored(rows: pa.Table, queries: pa.Table) -> Iterator[tuple]:
    """A cell piece by piece: (queries' places in the table, scores, row ids, whether the
    id is known, whether row and query are the same row)."""
    q = {c: queries[c].to_pylist() for c in ("q_block", "q_at", "dims", "kind", "vector")}
    shapes: dict = {}
    for place, shape in enumerate(zip(q["kind"], q["dims"])):
        shapes.setdefault(shape, []).append(place)
    blocks, place_of = np.array(q["q_block"]), np.array(q["q_at"])
    for (kind, dims), places in shapes.items():
        places = np.array(places)
        wanted = _matrix(b"".join(q["vector"][p] for p in places), kind, len(places), dims)
        for number in range(len(rows)):
            row = {c: rows[c][number] for c in ("block", "kind", "dims", "vectors", "ids")}
            ids = row["ids"].values
            known = np.asarray(ids.is_valid())
            numbers = np.asarray(ids.fill_null(0))
            block = _matrix(row["vectors"].as_py(), row["kind"].as_py(), len(ids), row["dims"].as_py())
            step = max(1, BLOCK_VALUES // max(1, len(block)))
            for start in range(0, len(places), step):
                part = places[start : start + step]
                own = np.flatnonzero(blocks[part] == row["block"].as_py())
                yield (
                    part,
                    products(block, wanted[start : start + step]),
                    numbers,
                    known,
                    (place_of[part][own], own),
                )


def _counted(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
    """The histogram of a cell, a row for each bin of a query that is not empty."""
    n = len(queries)
    low, span = (queries[c].to_numpy() for c in ("low", "span"))
    width = -(-span // BINS)
    counts = np.zeros((n, BINS), np.int64)
    for part, scores, _, _, (own_row, own_query) in _scored(rows, queries):
        bins = scores - low[part]
        inside = (bins >= 0) & (bins < span[part])
        inside[own_row, own_query] = False
        bins //= width[part]
        bins += np.arange(len(part)) * BINS
        found = np.bincount(bins[inside], minlength=len(part) * BINS)
        counts[part] += found.reshape(len(part), BINS)
    query, bin_no = np.nonzero(counts)
    return pa.table(
        {
            "q_block": queries["q_block"].take(pa.array(query)),
            "q_at": queries["q_at"].take(pa.array(query)),
            "bin": pa.array(bin_no, pa.int32()),
            "n": pa.array(counts[query, bin_no], pa.int64()),
        }
    )


def _reaching(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
    """The rows of a cell above a query's k-th score, and of those at it the ``room`` with
    the smallest ids, all that the whole table can need."""
    low, room = queries["low"].to_numpy(), queries["room"].to_numpy()
    found: list[list] = [[], [], [], []]
    ties: dict[int, list] = {}
    for part, scores, ids, known, (own_row, own_query) in _scored(rows, queries):
        ours = np.ones(scores.shape, bool)
        ours[own_row, own_query] = False
        row, query = np.nonzero(ours & (scores > low[part]))
        for column, values in zip(found, (part[query], ids[row], known[row], scores[row, query])):
            column.append(values)
        row, query = np.nonzero(ours & (scores == low[part]))
        order = np.lexsort((ids[row], ~known[row], query))
        row, query = row[order], query[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        least = nth < room[part[query]]
        for place, i in zip(part[query[least]].tolist(), row[least].tolist()):
            ties.setdefault(place, []).append((not known[i], int(ids[i])))
    for place, at_value in ties.items():
        kept = sorted(at_value)[: room[place]]
        found[0].append(np.full(len(kept), place))
        found[1].append(np.array([i for _, i in kept], np.int64))
        found[2].append(np.array([not lost for lost, _ in kept], bool))
        found[3].append(np.full(len(kept), low[place]))
    place, ids, known, scores = (np.concatenate(c) if c else np.empty(0, np.int64) for c in found)
    place = pa.array(place.astype(np.int64))
    return pa.table(
        {
            **{c: queries[c].take(place) for c in ("q_block", "q_at", "query_id")},
            "vec_id": pa.array(ids.astype(np.int64), mask=~known.astype(bool)),
            "score": pa.array(scores, pa.int64()),
        }
    )


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of highest score for each query row.

    The score is the inner product of ``floor(scale * x)`` of both vectors. A row is a
    query where ``is_query`` is true and a candidate of every query but itself. Vectors
    that are null or hold a null or non-finite component take no part. Equal scores are
    ranked by id, null last; rows that share an id are rows of their own, as queries and
    as candidates. A query with fewer candidates gets them all. Vectors of unequal length
    are multiplied over the components both have; an empty one scores 0. Scores beyond
    2^60 in size count as 2^60. Other columns of ``df`` play no part.
    """
    rows = df.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(embedding).cast("array<double>").alias("embedding"),
        F.coalesce(is_query, F.lit(False)).alias("wanted"),
    )
    blocks = stored(rows.mapInArrow(lambda it: _packed(it, scale), _BLOCK), "blocks")
    queries = blocks.mapInArrow(_query_rows, _QUERY)
    n_rows, n_queries, longest = blocks.agg(
        F.sum(F.size("ids")), F.sum(F.size(F.filter("wanted", lambda w: w))), F.max("longest")
    ).first()
    group = min(max(LEAST_ROWS, (n_rows or 0) // FEW_GROUPS), MOST_ROWS)
    row_groups = max(1, math.ceil((n_rows or 0) / group))
    query_groups = max(1, math.ceil((n_queries or 0) / QUERY_ROWS))

    # no score of a query exceeds the product of its length and the longest row's
    bound = F.least(F.col("norm") * F.lit(longest or 0.0) * (1 + 1e-9) + 1, F.lit(float(MOST_SCORE))).cast("long")
    state = stored(
        queries.withColumn("low", -bound).withColumn("span", 2 * bound + 1).withColumn("above", F.lit(0).cast("long")),
        "queries",
    )
    widest = state.agg(F.max("span")).first()[0] or 1
    data = blocks.drop("wanted", "longest").withColumn("r", F.pmod(F.xxhash64("block"), F.lit(row_groups)))
    data = data.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
    cells = min(row_groups * query_groups, 100_000)

    def grid(queries: DataFrame):
        spread = queries.withColumn("c", F.pmod(F.xxhash64("q_block", "q_at"), F.lit(query_groups)).cast("int"))
        spread = spread.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_groups - 1).cast("long"))))
        left = data.repartition(cells, "r", "c").groupBy("r", "c")
        return left.cogroup(spread.repartition(cells, "r", "c").groupBy("r", "c"))

    own = ["q_block", "q_at"]
    while widest > 1:
        counted = grid(state).applyInArrow(_counted, "q_block long, q_at int, bin int, n long")
        upwards = Window.partitionBy(*own).orderBy(F.desc("bin"))
        bins = (
            counted.groupBy(*own, "bin")
            .agg(F.sum("n").alias("n"))
            .withColumn("reached", F.sum("n").over(upwards))
            .join(state.select(*own, F.col("above").alias("before")), own)
            .where((F.col("before") + F.col("reached") >= k) & (F.col("before") + F.col("reached") - F.col("n") < k))
            .select(*own, "bin", (F.col("before") + F.col("reached") - F.col("n")).alias("now_above"))
        )
        width = F.expr(f"(span + {BINS - 1}) div {BINS}")
        state = stored(
            state.join(bins, own, "left")
            # fewer than k candidates: no value is the k-th, and every score is above
            .withColumn("low", F.when(F.col("bin").isNull(), -MOST_SCORE - 1).otherwise(F.col("low") + F.col("bin") * width))
            .withColumn("span", F.when(F.col("bin").isNull(), 1).otherwise(width).cast("long"))
            .withColumn("above", F.coalesce("now_above", "above"))
            .drop("bin", "now_above"),
            "queries",
        )
        widest = -(-widest // BINS)

    wanted = state.withColumn("room", F.lit(k) - F.col("above")).drop("span", "above", "norm")
    reaching = grid(wanted).applyInArrow(
        _reaching, "q_block long, q_at int, query_id long, vec_id long, score long"
    )
    ranked = Window.partitionBy(*own).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (
        reaching.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
