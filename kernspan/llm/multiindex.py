"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a normalised vector are quantised on their own; a pair of centroids is
a cell. A query walks cells in the order of the summed distances of its halves, taken
from a heap, until they hold enough vectors, and all of those are scored exactly.
Cells are laid out in shards of even size; a large cell is split over several.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kernspan.llm.tables import stored

CENTROIDS = 64
#: vectors the centroids are fitted on, at most
SAMPLE = 20_000
#: a query scores at least this share of all vectors, and at least MIN_CANDIDATES
CANDIDATE_SHARE = 0.5
MIN_CANDIDATES = 2_000
SHARD_ROWS = 5_000
QUERY_BLOCK = 20_000


@dataclass(frozen=True)
class Quantiser:
    """Centroids of the first and of the second half."""

    first: np.ndarray
    second: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _squared(unit[:, :half], self.first), _squared(unit[:, half:], self.second)

    def cell(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(1) * len(self.second) + b.argmin(1)


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 20) -> np.ndarray:
    x = np.unique(x, axis=0)
    centroids = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _squared(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(centroids))[:, None]
        centroids = np.where(held > 0, sums / np.maximum(held, 1), centroids)
    return centroids


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_quantiser(vectors: np.ndarray, centroids: int = CENTROIDS, seed: int = 3) -> Quantiser:
    unit = _unit(vectors)
    half = (unit.shape[1] + 1) // 2
    return Quantiser(_kmeans(unit[:, :half], centroids, seed), _kmeans(unit[:, half:], centroids, seed + 1))


def walk_cells(first: np.ndarray, second: np.ndarray, held: np.ndarray, enough: int) -> list[int]:
    """Cells in the order of ``first[i] + second[j]`` until they hold ``enough`` vectors.

    Only the frontier of pairs that can come next is in the heap: a pair enters when
    both its neighbours of smaller rank have left.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, counts = first[a].tolist(), second[b].tolist(), held.tolist()
    codes_a, codes_b, width = a.tolist(), b.tolist(), len(b)
    heap, left = [(x[0] + y[0], 0, 0)], [0] * len(a)
    out: list[int] = []
    got = 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = codes_a[i] * width + codes_b[j]
        if counts[cell]:
            out.append(cell)
            got += counts[cell]
        left[i] = j + 1
        if i + 1 < len(x) and left[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < len(y) and (i == 0 or left[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return out


def layout(held: np.ndarray, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each cell: small cells share one shard, a
    large one is split."""
    base, splits = np.zeros(len(held), np.int64), np.ones(len(held), np.int64)
    shard = rows = 0
    for cell, n in enumerate(held.tolist()):
        if n >= shard_rows:
            if rows:
                shard, rows = shard + 1, 0
            splits[cell] = -(-n // shard_rows)
            base[cell] = shard
            shard += int(splits[cell])
            continue
        if rows + n > shard_rows:
            shard, rows = shard + 1, 0
        base[cell] = shard
        rows += n
    return base, splits


# ----------------------------------------------------------------------------- tasks


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _coded(quantiser: Quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten().to_numpy(zero_copy_only=False), np.float64)
            x = np.ascontiguousarray(x.reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("vec_id"),
                    pa.array(quantiser.cell(_unit(x)).astype(np.int64)),
                    pa.array([row.tobytes() for row in x], pa.binary()),
                ],
                ["row", "vec_id", "cell", "x"],
            )

    return run


def _placed(base: np.ndarray, splits: np.ndarray, blocks: int):
    """Vectors with their shard, once for each block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            salt = batch.column("salt").to_numpy().astype(np.int64)
            shard = pa.array(base[cell] + salt % splits[cell])
            for block in range(blocks):
                yield pa.RecordBatch.from_arrays(
                    [shard, pa.array(np.full(len(cell), block)), *[batch.column(c) for c in ("row", "vec_id", "cell", "x")]],
                    ["shard", "block", "row", "vec_id", "cell", "x"],
                )

    return run


def _asked(quantiser: Quantiser, held: np.ndarray, base: np.ndarray, splits: np.ndarray, enough: int):
    """Queries with the cells they walk (as bits), once for each shard that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            first, second = quantiser.distances(_unit(x))
            ids, rows, block, raw = (batch.column(c).to_pylist() for c in ("vec_id", "row", "block", "x"))
            for i in range(len(ids)):
                cells = np.array(walk_cells(first[i], second[i], held, enough), np.int64)
                bits = np.zeros(quantiser.cells, bool)
                bits[cells] = True
                shards = set(base[cells].tolist())
                for c in cells[splits[cells] > 1]:
                    shards.update(range(base[c], base[c] + splits[c]))
                n = len(shards)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sorted(shards), pa.int64()),
                        pa.array([block[i]] * n, pa.int64()),
                        pa.array([rows[i]] * n, pa.int64()),
                        pa.array([ids[i]] * n, pa.int64()),
                        pa.array([raw[i]] * n, pa.binary()),
                        pa.array([np.packbits(bits).tobytes()] * n, pa.binary()),
                    ],
                    ["shard", "block", "asker", "query_id", "q", "cells"],
                )

    return run


_FOUND = "asker long, query_id long, vec_id long, score double"


def _scored(k: int):
    """The ``k`` nearest of one shard for each query that visits it."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"asker": [], "query_id": [], "vec_id": [], "score": []}
        if vectors.num_rows and queries.num_rows:
            ids = vectors["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, cell = ids[order], vectors["cell"].to_numpy()[order]
            rows, askers = vectors["row"].to_numpy()[order], queries["asker"].to_numpy()
            x = _matrix(vectors["x"].combine_chunks())[order]
            norm = np.sqrt((x * x).sum(1))
            asked, raw = queries["query_id"].to_numpy(), queries["cells"].to_pylist()
            q = _matrix(queries["q"].combine_chunks())
            for at in range(0, len(asked), 256):
                part = slice(at, at + 256)
                bits = np.unpackbits(np.frombuffer(b"".join(raw[part]), np.uint8).reshape(len(asked[part]), -1), axis=1)
                rough = _unit(q[part]) @ (x / norm[:, None]).T
                open_ = bits[:, cell].astype(bool) & (rows[None, :] != askers[part][:, None])
                rough = np.where(open_, rough, -np.inf)
                kth = np.partition(rough, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                for i in range(len(rough)):
                    # rounding of the matrix product is far below this margin
                    near = np.flatnonzero(open_[i] & (rough[i] >= kth[i] - 1e-9))
                    own = q[at + i]
                    score = (x[near] * own).sum(1) / (norm[near] * np.sqrt((own * own).sum()))
                    best = np.lexsort((ids[near], -score))[:k]
                    out["asker"] += [int(askers[at + i])] * len(best)
                    out["query_id"] += [int(asked[at + i])] * len(best)
                    out["vec_id"] += ids[near[best]].tolist()
                    out["score"] += score[best].tolist()
        return pa.table(
            {
                "asker": pa.array(out["asker"], pa.int64()),
                "query_id": pa.array(out["query_id"], pa.int64()),
                "vec_id": pa.array(out["vec_id"], pa.int64()),
                "score": pa.array(out["score"], pa.float64()),
            }
        )

    return run


# -------------------------------------------------------------------------- operator


def usable(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id and x (doubles) of the rows that take part.

    The numbers are those of one run: write the table before it is used twice."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return vectors.where(
        F.col("vec_id").isNotNull() & finite & F.exists(x, lambda v: v != 0)
    ).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")
    )


def nearest(
    vectors: DataFrame,
    k: int = 5,
    query_every: int = 50,
    centroids: int = CENTROIDS,
    candidate_share: float = CANDIDATE_SHARE,
    min_candidates: int = MIN_CANDIDATES,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each query.

    Queries are the rows whose vec_id is divisible by ``query_every``, candidates all
    rows but the query's own. The score is the cosine of the original vectors in double
    precision; ties go to the smaller vec_id. Null and zero vectors, vectors with null
    or non-finite components, rows without vec_id and vectors of another length than
    most take no part. Rows that share a vec_id are rows of their own, as queries and as
    candidates.
    With fewer than ``min_candidates`` vectors every one is scored. An empty table gives
    no rows. The centroids are fitted on a bounded sample; every vector is indexed.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("x") == sizes["d"])
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id", "x").limit(SAMPLE).select("x").collect()
    if sizes["d"] == 1:  # a second half of zeros does not change a cosine
        rows = rows.select("row", "vec_id", F.concat("x", F.array(F.lit(0.0))).alias("x"))
        drawn = [([*r["x"], 0.0],) for r in drawn]
    quantiser = fit_quantiser(np.array([r[0] for r in drawn]), centroids)
    index = stored(rows.mapInArrow(_coded(quantiser), "row long, vec_id long, cell long, x binary"), "index")
    held = np.zeros(quantiser.cells, np.int64)
    for r in index.groupBy("cell").count().collect():
        held[r["cell"]] = r["count"]
    base, splits = layout(held, shard_rows)
    enough = max(min_candidates, int(np.ceil(candidate_share * held.sum()))) + 1
    query = index.where(F.col("vec_id") % query_every == 0)
    blocks = max(1, -(-query.count() // QUERY_BLOCK))
    asked = query.select(
        "row", "vec_id", "x", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long").alias("block")
    ).mapInArrow(
        _asked(quantiser, held, base, splits, enough),
        "shard long, block long, asker long, query_id long, q binary, cells binary",
    )
    placed = index.withColumn("salt", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 20)).cast("long"))
    placed = placed.mapInArrow(
        _placed(base, splits, blocks), "shard long, block long, row long, vec_id long, cell long, x binary"
    )
    found = (
        placed.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInArrow(_scored(k), _FOUND)
    )
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
