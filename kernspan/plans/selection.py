"""Leverage-based landmark selection.

Every round scores the rows against the current subspaces, keeps each by a hash
coin weighted with its score, cuts to the best ``max_rows`` and refits. The
driver holds numbers only (lambda, totals, the stop rule); landmarks and models
stay tables, cut from their lineage through the shared checkpoint folder once
per round.

The plans read their input once per round, with only ``id`` and ``x``: the scan
that totals the leverage of a round also keeps the candidates of the next draw.
A table of at most
``SPREAD_ROWS`` rows per core is spread over the cores and kept in memory for the
run of a plan; a larger one is copied once, spread likewise, beside the checkpoints,
and its rounds read that copy instead of deriving the rows again. The copy holds the
rows as packed Arrow batches, and coins are hashed beside the scores, for the rows that
can still be drawn.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernspan.functions.kernels import Kernel, cosine, linear
from kernspan.functions.uniform import first_words, hash_uniform
from kernspan.operators import sampling
from kernspan.operators.fit import fit, primal_factor
from kernspan.operators.landmarks import landmark_union
from kernspan.operators.packing import unpack_vectors
from kernspan.operators.score import (
    Space,
    blocks,
    kernel_norm_column,
    leverage_block,
    leverage_min,
    load_models,
    rows_of,
)
from kernspan.operators.spaces import SubspaceCollection
from kernspan.operators.spans import SpannedKernel, spanned
from kernspan.operators.tiles import (
    DeferredModel,
    TiledModel,
    append_landmarks,
    block_leverages,
    fit_tiled,
    row_blocks,
    unpacked,
)
from kernspan.plans.schedules import MultiSpaceSchedule, SingleSpaceSchedule, halving_levels
from kernspan.session import materialize, written

#: feature dimension up to which the primal form is used for scoring
MAX_PRIMAL_DIM = 4096

#: rows per core up to which a plan keeps its input in memory
SPREAD_ROWS = 200_000

#: parts of a larger table's copy per core
COPY_PARTS = 2

#: bytes of a packed cell of that copy: a reader of parquet holds up to 4,096 cells of a row group at once
CELL_BYTES = 32 * 1024

#: rows and bytes that a scan of packed cells puts together
CHUNK_ROWS, CHUNK_BYTES = 10_000, 8 * 1024 * 1024

#: drop of the total leverage that counts as an improvement must exceed this
MIN_GAIN = 1.0

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("round", T.IntegerType()),
        T.StructField("lambda", T.DoubleType()),
        T.StructField("n_landmarks", T.LongType()),
        T.StructField("n_spaces", T.IntegerType()),
        T.StructField("total_leverage", T.DoubleType()),
        T.StructField("is_best", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class Selection:
    """The kept subspaces and one history row per round."""

    spaces: DataFrame
    models: DataFrame | TiledModel | DeferredModel
    lam: float
    history: list[tuple]

    def history_table(self) -> DataFrame:
        return self.spaces.sparkSession.createDataFrame(self.history, HISTORY_SCHEMA)


def _scoring_form(sample: DataFrame, size: int, kernel: Kernel) -> str:
    """Selection only needs leverages: prefer the form with D^2 numbers."""
    if not size:
        raise ValueError("the first sample is empty")
    if not kernel.explicit:
        return "dual"
    return "primal" if sample.select(F.size("x")).first()[0] <= MAX_PRIMAL_DIM else "dual"


def _draw(
    scored: DataFrame,
    seed: int | str,
    round_no: int,
    max_rows: int,
    beta: float | None = None,
    ascending: bool = False,
) -> tuple[DataFrame, int]:
    """Sample by score and keep the ``max_rows`` best: ``ord, id, x, reg``.

    The sample is materialised and comes with its size. Equal scores are ranked
    by the row's coin, so a cut among them is fair.
    """
    with_coin = scored.withColumn("coin", hash_uniform("id", seed, round_no))
    if beta is None:
        kept = sampling.bernoulli_by_score(with_coin, seed, round_no)
    else:
        kept = sampling.bernoulli_two_stage(with_coin, beta, seed, round_no)
    cut = sampling.bottomk_by_score if ascending else sampling.topk_by_score
    rank = F.round("score", sampling.RANK_DIGITS)
    order = [rank.asc() if ascending else rank.desc(), F.col("coin"), F.col("id")]
    drawn = sampling.numbered(cut(kept, max_rows, ties=("coin", "id")), order)
    return _sized(drawn)


def _sized(drawn: DataFrame) -> tuple[DataFrame, int]:
    reg = F.least(F.col("score"), F.lit(1.0)).alias("reg")
    sample = materialize(drawn.select("ord", "id", "x", reg))
    return sample, sample.count()


@dataclass(frozen=True)
class _Coins:
    """The uniforms of ``hash_uniform(id, seed, round_no)``; with ``beta`` only of the ids
    that pass the first of two stages."""

    seed: int | str
    round_no: int
    beta: float | None = None

    def of(self, keys: pa.Array) -> np.ndarray:
        """By the ids' text; NaN, which no score reaches, where there is no coin."""
        keys = keys.cast(pa.binary())
        coins, at = np.full(len(keys), np.nan), np.flatnonzero(np.asarray(keys.is_valid()))
        if self.beta is not None and (limit := max(0, math.ceil(self.beta * 4294967296))) <= 0xFFFFFFFF:
            first = f"{sampling.stage_seed(self.seed)}:{self.round_no}:".encode()
            at = at[first_words(first, keys.take(pa.array(at))) < limit]
        words = first_words(f"{self.seed}:{self.round_no}:".encode(), keys.take(pa.array(at)))
        coins[at] = words / 4294967296.0
        return coins


def _keyed(df: DataFrame) -> DataFrame:
    """With the text that an id's coin is hashed from."""
    return df.select("id", "x", F.col("id").cast("string").cast("binary").alias("key"))


@dataclass(frozen=True)
class _Packed:
    """A copy of ``(id, x)`` whose rows stand in cells, an Arrow stream of some rows each.

    A scan in Python takes over a cell at once and not its rows one by one.
    """

    cells: DataFrame
    row_type: T.StructType

    @classmethod
    def of(cls, df: DataFrame, parts: int) -> _Packed:
        rows = df.select("id", "x")
        cells = _keyed(rows).repartition(parts).mapInArrow(_pack, "cell binary")
        return cls(written(cells, "input"), rows.schema)

    def rows(self) -> DataFrame:
        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _unpack(batches):
                yield batch.select(["id", "x"])

        return self.cells.mapInArrow(unpack, self.row_type)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, CELL_BYTES * len(batch) // max(1, batch.nbytes))
        for start in range(0, len(batch), step):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch.slice(start, step))
            yield pa.RecordBatch.from_pydict({"cell": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, n, size = [], 0, 0
    for batch in batches:
        for cell in batch["cell"]:
            with pa.ipc.open_stream(cell.as_buffer()) as stream:
                parts.append(stream.read_all())
            n, size = n + len(parts[-1]), size + parts[-1].nbytes
            if n >= CHUNK_ROWS or size >= CHUNK_BYTES:
                yield from pa.concat_tables(parts).combine_chunks().to_batches()
                parts, n, size = [], 0, 0
    if parts:
        yield from pa.concat_tables(parts).combine_chunks().to_batches()


def _shared(df: DataFrame, now: list[Space] | None, upcoming: list[Space] | None) -> Broadcast:
    """What the tasks of a reduced scan need; the caller destroys it after the scan."""
    return df.sparkSession.sparkContext.broadcast((now, None if upcoming is now else upcoming))


def _reduced_scan(
    df: DataFrame | _Packed,
    draw: _Coins,
    shared: Broadcast,
    kernel: Kernel,
    factor: float,
    capped: bool = False,
    max_rows: int | None = None,
    need: Callable[[np.ndarray], np.ndarray] | None = None,
    ascending: bool = False,
) -> DataFrame:
    """One scan over ``df(id, x)``: totals and candidates.

    Without spaces k(y, y) is the leverage. With ``ascending`` the lowest scores rank first.

    A row is a candidate when its score under ``upcoming`` reaches its coin, or what
    ``need`` makes of the coins; a row without a coin is none. A task returns its candidates (with ``max_rows`` only as many of the best, all
    that can be among the best of the table) and one row with its part of the
    ``total`` leverage under ``now``. Rows that cannot be among them get no coin.
    """
    packed = isinstance(df, _Packed)
    now, upcoming = shared.value
    widest = max((max(space.factor.shape) for space in [*(now or []), *(upcoming or [])]), default=1)
    id_field = (df.row_type if packed else df.schema)["id"]
    schema = T.StructType(
        [
            T.StructField("id", id_field.dataType),
            T.StructField("x", T.ArrayType(T.DoubleType())),
            T.StructField("coin", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rank", T.DoubleType()),
            T.StructField("total", T.DoubleType()),
        ]
    )
    order = [("rank", "descending"), ("coin", "ascending"), ("id", "ascending")]

    def best(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).sort_by(order).slice(0, max_rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, following = shared.value
        total, held, layout, floor = 0.0, [], None, -np.inf
        for batch in _unpack(batches) if packed else batches:
            batch = batch.filter(batch["x"].is_valid())
            rows, _ = rows_of(batch["x"], batch["id"])
            least = []
            for block in blocks(rows, widest):
                if current is None:
                    under_now = kernel.diagonal(block)
                else:
                    under_now = leverage_block(block, current, kernel).min(axis=1)
                total += float(np.nansum(under_now))
                if following is not None:
                    under_now = leverage_block(block, following, kernel).min(axis=1)
                least.append(under_now)
            # as in sampling: what is no number is neither drawn nor ranked
            score = (np.concatenate(least) if least else np.empty(0)) * factor
            if capped:
                score = np.minimum(score, 1.0)
            rank = np.round(score, sampling.RANK_DIGITS) * (-1.0 if ascending else 1.0)
            # what has max_rows rows before it in this task is not drawn, whatever its coin
            open_to = np.flatnonzero((score >= 0) & (rank >= floor))
            coins = draw.of(batch["key"].take(pa.array(open_to)))
            reached = score[open_to] >= (coins if need is None else need(coins))
            at, coins = open_to[reached], coins[reached]
            chosen = batch.take(pa.array(at))
            table = pa.table(
                {
                    "id": chosen["id"],
                    "x": chosen["x"],
                    "coin": coins,
                    "score": score[at],
                    "rank": rank[at],
                    "total": pa.nulls(len(at), pa.float64()),
                }
            )
            layout = table.schema
            held.append(table)
            if max_rows is None:
                yield from held.pop().to_batches()
            elif sum(map(len, held)) > 4 * max_rows:
                held = [best(held)]
                floor = held[0]["rank"][-1].as_py() if max_rows else np.inf
        if layout is None:
            return
        if max_rows is not None and sum(map(len, held)) > max_rows:
            held = [best(held)]
        part = {field.name: pa.nulls(1, field.type) for field in layout}
        held.append(pa.table({**part, "total": [total]}, schema=layout))
        for table in held:
            yield from table.to_batches()

    return (df.cells if packed else _keyed(df)).mapInArrow(scan, schema)


def _total_and_draw(
    df: DataFrame,
    scanned_from: DataFrame | _Packed,
    models: DataFrame,
    next_models: DataFrame,
    kernel: Kernel,
    factor: float,
    seed: int | str,
    next_round: int,
    max_rows: int,
    beta: float | None = None,
    capped: bool = False,
) -> tuple[float, DataFrame, int]:
    """The total leverage under ``models`` and the sample drawn under ``next_models``.

    The same as ``_total`` followed by ``_draw``, in one scan of ``scanned_from``, which
    holds the rows of ``df``. Models beyond the broadcast bound take those two steps instead.
    """
    now = load_models(models, kernel)
    upcoming = now if next_models is models else load_models(next_models, kernel)
    if len(now) > 1 or len(upcoming) > 1:
        scored = leverage_min(df, next_models, kernel, out="score")
        score = F.col("score") * F.lit(factor)
        scored = scored.withColumn("score", F.least(score, F.lit(1.0)) if capped else score)
        sample, size = _draw(scored, seed, next_round, max_rows, beta)
        return _total(df, models, kernel), sample, size

    need = None if beta is None else partial(np.multiply, beta)
    shared = _shared(df, now[0], upcoming[0])
    scanned = _reduced_scan(
        scanned_from, _Coins(seed, next_round, beta), shared, kernel, factor, capped, max_rows, need
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = scanned.agg(F.sum("total")).first()[0] or 0.0
        sample, size = _best(scanned, max_rows)
    finally:
        scanned.unpersist()
        shared.destroy()
    return total, sample, size


def _best(scanned: DataFrame, max_rows: int) -> tuple[DataFrame, int]:
    """The sample that the candidates of a reduced scan make."""
    order = [F.col("rank").desc(), F.col("coin"), F.col("id")]
    candidates = scanned.filter(F.col("total").isNull()).drop("total")
    ranked = sampling.ranked_limit(candidates, order, max_rows, [-F.col("rank"), F.col("coin")])
    return _sized(sampling.numbered(ranked, order))


def _first_draw(
    df: DataFrame,
    source: DataFrame | _Packed,
    kernel: Kernel,
    factor: float,
    seed: int | str,
    max_rows: int,
    beta: float | None = None,
    capped: bool = False,
    ascending: bool = False,
) -> tuple[DataFrame, int]:
    """The sample of round 0, drawn by the scaled k(y, y); of a packed table in one scan."""
    if not isinstance(source, _Packed):
        score = kernel_norm_column(df, kernel) * F.lit(float(factor))
        scored = df.withColumn("score", F.least(score, F.lit(1.0)) if capped else score)
        return _draw(scored, seed, 0, max_rows, beta, ascending)
    need = None if beta is None else partial(np.multiply, beta)
    shared = _shared(source.cells, None, None)
    scanned = _reduced_scan(
        source, _Coins(seed, 0, beta), shared, kernel, factor, capped, max_rows, need, ascending
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _best(scanned, max_rows)
    finally:
        scanned.unpersist()
        shared.destroy()


def _total(df: DataFrame, models: DataFrame, kernel: Kernel) -> float:
    numbers = F.when(sampling.known("leverage"), F.col("leverage"))
    return leverage_min(df, models, kernel).agg(F.sum(numbers)).first()[0] or 0.0


@contextmanager
def _input(df: DataFrame, n_rows: int | None) -> Iterator[tuple[DataFrame, DataFrame | _Packed, int]]:
    """The table a plan scans repeatedly, what reduced scans read it from, and its row count."""
    rows = df.select("id", "x")
    n_rows = rows.count() if n_rows is None else n_rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if n_rows > SPREAD_ROWS * cores:
        packed = _Packed.of(rows, COPY_PARTS * cores)
        yield packed.rows(), packed, n_rows
        return
    kept = rows.repartition(cores, "id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept, kept, n_rows
    finally:
        kept.unpersist()


def nystrom_bless(
    df: DataFrame,
    kernel: Kernel | None = None,
    seed: int | str = 42,
    max_rows: int = 5000,
    max_rounds: int | None = None,
    n_rows: int | None = None,
) -> Selection:
    """One subspace, redrawn each round under a shrinking lambda.

    ``max_rounds`` ends the schedule early; round 0 counts.
    """
    with _input(df, n_rows) as (rows, source, n_rows):
        plan = SingleSpaceSchedule(n_rows)
        rounds = plan.rounds if max_rounds is None else min(plan.rounds, max_rounds)
        return _bless(rows, source, plan, kernel or linear(), seed, max_rows, rounds)


def _bless(
    df: DataFrame,
    source: DataFrame | _Packed,
    plan: SingleSpaceSchedule,
    kernel: Kernel,
    seed: int | str,
    max_rows: int,
    rounds: int,
) -> Selection:
    factor = plan.score_factor
    sample, size = _first_draw(
        df, source, kernel, factor, seed, max_rows, plan.beta_at(0), capped=True, ascending=True
    )
    form = _scoring_form(sample, size, kernel)
    spaces = models = None
    history = []
    for round_no in range(rounds):
        lam, drawn = plan.lambda_at(round_no), size
        if drawn:
            spaces = sample.select(F.lit(0).alias("space_id"), "*")
            models = fit(spaces, lam * plan.n_rows, kernel, form)
        if round_no + 1 < rounds:
            total, sample, size = _total_and_draw(
                df,
                source,
                models,
                models,
                kernel,
                factor,
                seed,
                round_no + 1,
                max_rows,
                plan.beta_at(round_no + 1),
                capped=True,
            )
        else:
            total = _total(df, models, kernel)
        history.append((round_no, lam, drawn, 1, total, drawn > 0))
    return Selection(spaces, models, lam * plan.n_rows, history)


def nystrom_spaces(
    df: DataFrame,
    kernel: Kernel | None = None,
    seed: int | str = 42,
    max_rows: int = 1000,
    max_spaces: int = 5,
    max_non_improv: int = 10,
    max_rounds: int | None = None,
    n_rows: int | None = None,
) -> Selection:
    """A collection of subspaces, each drawn where the others explain least.

    Stops after ``max_non_improv`` more rounds without than with improvement
    and returns the best collection seen.
    """
    with _input(df, n_rows) as (rows, source, n_rows):
        return _spaces(
            rows,
            source,
            MultiSpaceSchedule(n_rows),
            kernel or linear(),
            seed,
            max_rows,
            max_spaces,
            max_non_improv,
            max_rounds,
        )


def _spaces(
    df: DataFrame,
    source: DataFrame | _Packed,
    plan: MultiSpaceSchedule,
    kernel: Kernel,
    seed: int | str,
    max_rows: int,
    max_spaces: int,
    max_non_improv: int,
    max_rounds: int | None,
) -> Selection:
    lam = plan.lambda_at(0)
    sample, size = _first_draw(df, source, kernel, plan.score_factor, seed, max_rows)
    form = _scoring_form(sample, size, kernel)
    current = SubspaceCollection.create(sample, lam, kernel, max_spaces, form, durable=True)
    best, best_total = current, math.inf
    history, misses, round_no = [], 0, 0
    while True:
        last = max_rounds is not None and round_no + 1 >= max_rounds
        if last:
            total, drawn = _total(df, current.models, kernel), size
        else:
            upcoming = _next_slots(current, plan.lambda_at(round_no + 1), round_no + 1)
            drawn = size
            total, sample, size = _total_and_draw(
                df,
                source,
                current.models,
                upcoming.models,
                kernel,
                plan.score_factor,
                seed,
                round_no + 1,
                max_rows,
            )
        improved = drawn > 0 and total - best_total < -MIN_GAIN
        if improved:
            best, best_total = current, total
            misses = max(0, misses - 1)
        else:
            misses += 1
        history.append((round_no, current.lam, drawn, current.count, total, improved))
        if last or misses >= max_non_improv:
            return Selection(best.spaces, best.models, best.lam, history)
        round_no += 1
        # a collection of one slot has nothing to keep: its slot is replaced
        if size:
            current = upcoming.append_circular(sample, durable=True)
        elif upcoming.lam != current.lam:
            # nothing drawn: the slots stay as they were, under the new lambda
            current = current.update_lambda(upcoming.lam)


def _next_slots(current: SubspaceCollection, lam: float, round_no: int) -> SubspaceCollection:
    """The collection a round draws against: one slot freed when full, new lambda."""
    if current.count == current.capacity and current.capacity > 1:
        current = current.remove((round_no - 1) % (current.capacity - 1))
    return current if lam == current.lam else current.update_lambda(lam)


def nystrom_spaces_packed(packs: DataFrame, **options) -> Selection:
    """The same over packed blocks; equal seeds select equal landmarks."""
    return nystrom_spaces(unpack_vectors(packs), **options)


def _landmarks(accepted: DataFrame, round_no: int) -> DataFrame:
    return accepted.select(
        F.lit(0).alias("space_id"),
        F.lit(round_no).cast("int").alias("ord"),
        "id",
        "x",
        F.lit(1.0).alias("reg"),
    )


def _over(widest: float, coins: np.ndarray) -> np.ndarray:
    return coins / widest if widest > 0 else np.full(len(coins), np.inf)


@dataclass(frozen=True)
class _Moments:
    """A growing landmark set in feature space: the moments are a sum over landmarks, so
    those of the accepted rows are added and nothing is fitted again."""

    lam: float
    kernel: Kernel
    sums: np.ndarray

    @classmethod
    def of(cls, landmarks: DataFrame, lam: float, kernel: Kernel, dim: int) -> _Moments:
        all_in = landmarks.select(
            "id", "x", F.lit(0.0).alias("coin"), F.lit(1.0).alias("score"), F.lit(None).cast("double").alias("total")
        )
        return cls(lam, kernel, _sums(all_in, 1.0, kernel, dim)[2])

    def grow(
        self,
        df: DataFrame | _Packed,
        seed: int | str,
        round_no: int,
        delta: float | None = None,
        most: float | None = None,
    ) -> tuple[_Moments, DataFrame | None, float, int]:
        """Accept rows by their scaled leverage: the next set, the landmarks that came in,
        the total of the scaled leverage and how many landmarks there are more.

        With ``delta`` a row is accepted when coin < score * ln(total / delta),
        else when coin < score. The total is not known before the scan, but no
        leverage exceeds k(y, y): rows that fail even with ``most``, the sum of the
        scaled k(y, y), cannot be accepted, and the scan drops them.
        """
        factor = 1.5 / self.lam
        need = None
        if delta is not None:
            widest = math.log(max(most * (1 + 1e-9) / delta, 1.0))
            need = partial(_over, widest)
        space, kernel = Space(0, primal_factor(self.sums, self.lam), None, True), self.kernel
        if isinstance(kernel, SpannedKernel):
            space, kernel = kernel.scoring(space.factor)
        spaces = [space]
        shared = _shared(df.cells if isinstance(df, _Packed) else df, spaces, spaces)
        coins = _Coins(seed, round_no)
        scanned = materialize(_reduced_scan(df, coins, shared, kernel, factor, need=need))
        shared.destroy()
        total, scale = None, 1.0
        if delta is not None:
            total = (scanned.agg(F.sum("total")).first()[0] or 0.0) * factor
            if total <= 0:
                return self, None, total, 0
            scale = math.log(total / delta)
        seen, size, sums = _sums(scanned, scale, self.kernel, len(self.sums))
        accepted = scanned.filter(F.col("total").isNull() & (F.col("coin") < F.col("score") * F.lit(scale)))
        return (
            replace(self, sums=self.sums + sums),
            _landmarks(accepted, round_no),
            seen * factor if total is None else total,
            size,
        )


#: bytes of partial sums that the driver adds up
SUM_BYTES = 256 * 1024 * 1024


def _sums(scanned: DataFrame, scale: float, kernel: Kernel, dim: int) -> tuple[float, int, np.ndarray]:
    """The total of a reduced scan, and the number and moments of the rows it accepts.

    A task adds up its rows, a few tasks add up what the others found.
    """
    salts = max(1, min(8, SUM_BYTES // (8 * dim * dim)))
    schema = "salt int, total double, m long, sums binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, m, sums = 0.0, 0, np.zeros((dim, dim))
        for batch in batches:
            parts = np.asarray(batch["total"].fill_null(0.0))
            total += float(parts.sum())
            rank = batch["coin"].fill_null(2.0), batch["score"].fill_null(0.0)
            coin, score = (np.asarray(c, dtype=float) for c in rank)
            rows = batch.filter(pa.array((coin < score * scale) & np.asarray(batch["total"].is_null())))
            if len(rows):
                features = kernel.features(rows_of(rows["x"], rows["id"])[0])
                m, sums = m + len(rows), sums + features.T @ features
        salt = TaskContext.get().partitionId() % salts
        yield pa.RecordBatch.from_pydict(
            {"salt": pa.array([salt], pa.int32()), "total": [total], "m": [m], "sums": [sums.tobytes()]}
        )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, m, sums = 0.0, 0, np.zeros(dim * dim)
        for batch in batches:
            for row in batch.to_pylist():
                total, m, salt = total + row["total"], m + row["m"], row["salt"]
                sums += np.frombuffer(row["sums"])
        yield pa.RecordBatch.from_pydict(
            {"salt": pa.array([salt], pa.int32()), "total": [total], "m": [m], "sums": [sums.tobytes()]}
        )

    parts = scanned.select("id", "x", "coin", "score", "total").mapInArrow(add, schema)
    found = parts.groupBy("salt").applyInArrow(join, schema).collect()
    sums = sum((np.frombuffer(row["sums"]) for row in found), np.zeros(dim * dim))
    return sum(row["total"] for row in found), sum(row["m"] for row in found), sums.reshape(dim, dim)


@dataclass(frozen=True)
class _Tiles:
    """A growing landmark set under any kernel: a tiled model that new landmarks extend.
    Tables are given as packed row blocks."""

    model: TiledModel

    def grow(
        self,
        blocks: DataFrame,
        seed: int | str,
        round_no: int,
        delta: float | None = None,
        most: float | None = None,
    ) -> tuple[_Tiles, DataFrame | None, float, int]:
        """As for moments; the scores of a round are written, as packed numbers."""
        factor = 1.5 / self.model.lam
        scores = written(block_leverages(blocks, self.model), "scores")
        total = (scores.agg(F.sum("total")).first()[0] or 0.0) * factor
        if delta is not None and total <= 0:
            return self, None, total, 0
        scale = 1.0 if delta is None else math.log(total / delta)
        scored = sampling.scale_scores(unpacked(blocks, scores, "score"), factor)
        accepted = scored.filter(
            sampling.known("score") & (hash_uniform("id", seed, round_no) < F.col("score") * F.lit(scale))
        )
        added = materialize(_landmarks(accepted, round_no))
        size = added.count()
        return (_Tiles(append_landmarks(self.model, added)) if size else self), added, total, size


#: levels that the copy of a table is partitioned by; deeper ones share the last folder
STORED_LEVELS = 8
#: nested levels a row can have: a table has some thirty at most
DEEPEST_LEVEL = 40


def _leveled(df: DataFrame, seed: int | str) -> DataFrame:
    """A copy of the table ``(id, x, level)`` by folder of nested level."""
    rows = sampling.with_nested_level(df.select("id", "x"), DEEPEST_LEVEL, seed)
    return written(rows.withColumn("part", F.least("level", F.lit(STORED_LEVELS))), "levels", "part")


def _beyond(leveled: DataFrame, depth: int) -> DataFrame:
    """Rows of the copy whose level is above ``depth``; only their folders are read."""
    if depth < 0:
        return leveled
    if depth < STORED_LEVELS:
        return leveled.filter(F.col("part") > depth)
    return leveled.filter((F.col("part") == STORED_LEVELS) & (F.col("level") > depth))


def _growing(
    table: DataFrame,
    spaces: DataFrame,
    lam: float,
    kernel: Kernel,
    model: TiledModel | DeferredModel | None = None,
) -> _Moments | _Tiles:
    """The landmark set in its cheapest form: feature-sized moments where there are any, or
    where the rows of the table span few dimensions under the kernel."""
    if kernel.explicit and (dim := spaces.select(F.size("x")).first()[0]) <= MAX_PRIMAL_DIM:
        return _Moments.of(spaces, lam, kernel, dim)
    known = model.state if isinstance(model, DeferredModel) else None
    if (model is None or known is not None) and not kernel.explicit:
        features = spanned(table, spaces, kernel, known and known.kernel)
        if features is not None:
            if known is not None and features is known.kernel:
                return known
            return _Moments.of(spaces, lam, features, len(features.pivots))
    return _Tiles(model or fit_tiled(spaces, lam, kernel))


def _selected(
    state: _Moments | _Tiles, parts: list[DataFrame], lam: float, kernel: Kernel, history: list[tuple]
) -> Selection:
    spaces = materialize(reduce(landmark_union, parts).repartition("id"))
    if isinstance(state, _Tiles):
        models = state.model
    elif isinstance(state.kernel, SpannedKernel):
        models = DeferredModel(spaces, kernel, lam, state)
    else:
        models = fit(spaces, lam, kernel, "primal")
    return Selection(spaces, models, lam, history)


def nystrom_halving(
    df: DataFrame,
    kernel: Kernel | None = None,
    seed: int | str = 42,
    lam: float = 0.01,
    delta: float = 0.1,
    n_rows: int | None = None,
) -> Selection:
    """Start from the deepest nested level and walk up to the whole table.

    The ``ord`` of a landmark is the round that added it. The table is read once, into a
    copy by level; a round reads the folders of its level, about two copies in all. A
    kernel without a feature map is scored by the features of its span where the rows have
    one, which takes some more scans of the copy, else against a tiled model; the number of
    landmarks has no bound. ``models`` of the result is a ``TiledModel``, or one that is
    fitted when it is first asked for.
    """
    kernel = kernel or cosine()
    leveled = _leveled(df, seed)
    n_rows = leveled.count() if n_rows is None else n_rows
    levels, level_delta = halving_levels(n_rows, delta)
    spaces = materialize(_landmarks(_beyond(leveled, levels - 1), 0))
    size = spaces.count()
    if not size:
        raise ValueError("the first sample is empty")
    state = _growing(leveled, spaces, lam, kernel)
    parts, history, most = [spaces], [(0, lam, size, 1, None, True)], None
    if isinstance(state, _Tiles):
        table = row_blocks(leveled.drop("part").withColumnRenamed("level", "part"), "part")
    else:
        table = leveled
        most = (leveled.agg(F.sum(kernel_norm_column(leveled, kernel))).first()[0] or 0.0) * 1.5 / lam
    for round_no in range(1, levels + 1):
        level_delta *= 3
        depth = levels - 1 - round_no
        if isinstance(state, _Tiles):
            subset = table.filter(F.col("part") > depth)
        else:
            subset = _beyond(table, depth).select("id", "x")
            if isinstance(state.kernel, SpannedKernel):
                # the features cost far more than dealing the rows out evenly
                subset = subset.repartition(4 * subset.sparkSession.sparkContext.defaultParallelism)
        state, added, total, size = state.grow(subset, seed, round_no, level_delta, most)
        parts += [] if added is None else [added]
        history.append((round_no, lam, size, 1, total, True))
    return _selected(state, parts, lam, kernel, history)


def nystrom_refine(
    df: DataFrame,
    spaces: DataFrame,
    kernel: Kernel | None = None,
    seed: int | str = 42,
    lam: float = 0.01,
    rounds: int = 20,
    first_round: int = 1000,
    model: TiledModel | DeferredModel | None = None,
) -> Selection:
    """More rounds over the whole table, accepting when u < scaled leverage.

    ``model`` is the model of ``spaces`` that a selection has given, to go on from.
    """
    kernel = kernel or cosine()
    parts, history = [spaces], []
    with _input(df, None) as (rows, source, _):
        state = _growing(rows, spaces, lam, kernel, model)
        table = row_blocks(rows) if isinstance(state, _Tiles) else source
        for round_no in range(first_round, first_round + rounds):
            state, added, total, size = state.grow(table, seed, round_no)
            parts += [] if added is None else [added]
            history.append((round_no, lam, size, 1, total, True))
        return _selected(state, parts, lam, kernel, history)
