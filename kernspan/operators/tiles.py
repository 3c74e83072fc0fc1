"""Subspaces of any number of landmarks and any kernel, as tables of matrix tiles.

Landmarks are cut into blocks of at most ``TILE``. The matrix G = k(X, X) + lambda P of a
subspace is a table with one row per tile (block row i, block column j <= i), and so are
the root W of its inverse (W'W = G^-1, block lower triangular) and that inverse. A product
of tile tables is one shuffle: the factors are dealt out by the tile of the result they
add to, sorted, and multiplied as a stream, so a task holds three tiles at a time.

The root follows from halves, as for two blocks:

    W11 from G11,  L21 = G21 W11',  S = G22 - L21 L21',  W22 from S,  W21 = -W22 L21 W11

with a dense Cholesky of two diagonal blocks at the end of the recursion. New landmarks
are the second half of that step: the root of those already there is kept.

Rows are scored in packed blocks. Each tile of G^-1 adds its part of k(y, X) G^-1 k(X, y)
to the energy of a row, whatever the order, so row blocks and tiles meet in a grid of
(tile, row group), and no task needs a matrix of landmark size.

Where the kernel has fewer features than a subspace has landmarks, the tiles meet the
features of the landmarks instead: with B = W phi(X) the leverage of a row is
phi(y)' (I - B'B) phi(y). That takes two products of tiles whatever the number of rows,
and then one scan of the rows, which are neither copied nor shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kernspan.functions.kernels import Kernel, linear
from kernspan.operators.score import _id_or_null, row_scorer, rows_of, with_nulls
from kernspan.session import BROADCAST_MAX_BYTES, broadcast_if_small, written

#: landmarks of a block, at most; a tile then takes 8 MB
TILE = 1024
#: diagonal blocks that are factored as one dense matrix
LEAF_BLOCKS = 2
#: numbers of a row block, at most, and rows that meet a tile in one task
BLOCK_VALUES, GROUP_ROWS = 1 << 18, 1 << 16
#: rows that a task scores against a tile at once
STEP_ROWS = 4096
#: tasks of one shuffle, at most
MOST_TASKS = 4096
#: smallest weight of a landmark in the regulariser
MIN_REG = 1e-12


def _fields(*specs: tuple[str, T.DataType]) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in specs]


def _tile_schema(space: T.DataType) -> T.StructType:
    whole = T.IntegerType()
    return T.StructType(
        _fields(
            ("space_id", space), ("i", whole), ("j", whole), ("nb", whole),
            ("rows", whole), ("cols", whole), ("data", T.BinaryType()),
        )
    )


def _matrix(raw: bytes, rows: int, cols: int = -1) -> np.ndarray:
    return np.frombuffer(raw).reshape(rows, cols) if rows else np.empty((0, max(cols, 0)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches one by one; binary values are not copied before use."""
    for batch in batches:
        names = batch.schema.names
        for number in range(batch.num_rows):
            yield {name: batch[name][number].as_py() for name in names}


def _mapped(df: DataFrame, function: Callable, schema: T.StructType) -> DataFrame:
    """``function`` from rows to rows, each a dict, over the partitions of ``df``."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in function(_rows(batches)):
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return df.mapInArrow(run, schema)


def _tasks(wanted: int) -> int:
    return max(1, min(wanted, MOST_TASKS))


def _between(low: Column | int, high: Column | int) -> Column:
    """One row for each number from ``low`` to ``high``; none if there is none."""
    low, high = (c if isinstance(c, Column) else F.lit(c) for c in (low, high))
    return F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))))


# ---------------------------------------------------------------------------- blocks


def landmark_blocks(
    spaces: DataFrame, by: str = "space_id", tile: int = TILE, targets: bool = False
) -> DataFrame:
    """Landmarks ``(space_id, ord, id, x, reg)`` in order, as numbered blocks.

    A row has ``space_id, b, nb, start, n, ids, ords, x, reg``: block b of nb, which begins
    at landmark ``start``; with ``targets`` also those, as ``f``. Landmarks are sorted by
    range, so that no task sees a whole subspace.
    """
    rows = spaces.select(
        F.col(by).alias("space_id"), "ord", "id", F.col("x").cast("array<double>"), "reg",
        *([F.col("targets").cast("array<double>")] if targets else []),
    )
    order = ["space_id", "ord", "id"]
    parts = _tasks(rows.count() // (4 * tile))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    space, ident, place = (rows.schema[c].dataType for c in ("space_id", "id", "ord"))
    schema = T.StructType(
        _fields(
            ("space_id", space), ("seq", T.LongType()), ("n", T.IntegerType()),
            ("ids", T.ArrayType(ident)), ("ords", T.ArrayType(place)),
            ("x", T.BinaryType()), ("reg", T.BinaryType()),
            *([("f", T.BinaryType())] if targets else []),
        )
    )
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, owner = TaskContext.get().partitionId() << 32, None, None

        def block(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            one = {c: part[c].combine_chunks() if part[c].num_chunks != 1 else part[c].chunk(0) for c in part.column_names}
            x, present = rows_of(one["x"], one["id"])
            if present is not None:
                raise ValueError(f"a landmark has no vector (space {owner!r})")
            row = {"space_id": owner, "seq": seq, "n": len(x), "ids": one["id"].to_pylist(), "ords": one["ord"].to_pylist()}
            row |= {"x": x.tobytes(), "reg": np.asarray(one["reg"], dtype=float).tobytes()}
            if targets:
                row["f"] = rows_of(one["targets"], one["id"])[0].tobytes()
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            owners = batch["space_id"].to_pylist()
            edges = [0, *(k for k in range(1, len(owners)) if owners[k] != owners[k - 1]), len(owners)]
            for a, b in zip(edges, edges[1:]):
                if held is not None and owners[a] != owner:
                    yield block(held)
                    held, seq = None, seq + 1
                owner = owners[a]
                part = table.slice(a, b - a)
                held = part if held is None else pa.concat_tables([held, part])
                while held is not None and len(held) >= tile:
                    yield block(held.slice(0, tile))
                    held, seq = held.slice(tile) if len(held) > tile else None, seq + 1
        if held is not None and len(held):
            yield block(held)

    raw = written(ordered.mapInArrow(cut, schema), "blocks")
    within = Window.partitionBy("space_id").orderBy("seq")
    numbers = raw.select("space_id", "seq", "n").select(
        "seq",
        (F.row_number().over(within) - 1).alias("b"),
        F.count(F.lit(1)).over(Window.partitionBy("space_id")).cast("int").alias("nb"),
        (F.sum("n").over(within) - F.col("n")).alias("start"),
    )
    return written(raw.join(numbers, "seq").drop("seq"), "blocks")


def _gram(
    blocks: DataFrame, kernel: Kernel, lam: float, tasks: int, first: int = 0
) -> DataFrame:
    """The tiles (i, j <= i) of k(X, X) + lam P, those of block rows from ``first`` on."""
    b, nb = F.col("b"), F.col("nb")
    block = ["space_id", "nb", "n", "x", "reg"]
    left = blocks.where(b >= first).select(*block, b.alias("i"), _between(0, b).alias("j"), F.lit(0).alias("side"))
    right = blocks.select(*block, _between(F.greatest(b, F.lit(first)), nb - 1).alias("i"), b.alias("j"), F.lit(1).alias("side"))
    key = ["space_id", "i", "j"]
    both = left.unionByName(right).repartition(tasks, *key).sortWithinPartitions(*key, "side")

    def tiles(rows: Iterator[dict]) -> Iterator[dict]:
        upper = None
        for row in rows:
            x = _matrix(row["x"], row["n"])
            if row["side"] == 0:
                upper = x
                continue
            data = kernel.block(upper, x)
            if row["i"] == row["j"] and lam:
                data = data.copy()
                data[np.diag_indices_from(data)] += lam * np.maximum(np.frombuffer(row["reg"]), MIN_REG)
            yield {
                **{c: row[c] for c in ("space_id", "i", "j", "nb")},
                "rows": len(upper),
                "cols": len(x),
                "data": np.ascontiguousarray(data, dtype=float).tobytes(),
            }

    return _mapped(both, tiles, _tile_schema(blocks.schema["space_id"].dataType))


# --------------------------------------------------------------------------- products


def _operand(tiles: DataFrame, side: int, i: Column, j: Column, term: Column, turned: bool = False) -> DataFrame:
    """Tiles as one side of a product: the result tile (i, j) each adds to, and the term."""
    return tiles.select(
        "space_id", "nb", "rows", "cols", "data",
        i.alias("to_i"), j.alias("to_j"), term.cast("int").alias("term"),
        F.lit(side).alias("side"), F.lit(turned).alias("turned"),
    )


def _product(left: DataFrame, right: DataFrame, tasks: int, sign: float = 1.0, plus: DataFrame | None = None) -> DataFrame:
    """plus + sign * sum over terms of left times right, tile by tile."""
    both = left.unionByName(right)
    if plus is not None:
        both = both.unionByName(_operand(plus, -1, F.col("i"), F.col("j"), F.lit(-1)))
    key = ["space_id", "to_i", "to_j"]
    both = both.repartition(tasks, *key).sortWithinPartitions(*key, "term", "side")

    def multiply(rows: Iterator[dict]) -> Iterator[dict]:
        now, total, factor = None, None, None
        for row in rows:
            place = (row["space_id"], row["to_i"], row["to_j"], row["nb"])
            if place != now:
                if total is not None:
                    yield _tile(now, total)
                now, total, factor = place, None, None
            data = _matrix(row["data"], row["rows"], row["cols"])
            if row["turned"]:
                data = data.T
            if row["side"] < 0:
                total = data.copy()
            elif row["side"] == 0:
                factor = (row["term"], data)
            elif factor is not None and factor[0] == row["term"]:
                part = factor[1] @ data
                total = sign * part if total is None else np.add(total, sign * part, out=total)
        if total is not None:
            yield _tile(now, total)

    return _mapped(both, multiply, _tile_schema(left.schema["space_id"].dataType))


def _tile(place: tuple, data: np.ndarray) -> dict:
    names = dict(zip(("space_id", "i", "j", "nb"), place))
    return {**names, "rows": data.shape[0], "cols": data.shape[1], "data": np.ascontiguousarray(data).tobytes()}


def _root(matrix: np.ndarray, floor: float | None) -> tuple[np.ndarray, bool]:
    """R with R'R = M^-1, and whether it is lower triangular; with ``floor``, R'R is the
    inverse of what M has above it."""
    if floor is None:
        try:
            return np.linalg.inv(np.linalg.cholesky(matrix)), True
        except np.linalg.LinAlgError:
            floor = np.abs(matrix).max() * len(matrix) * np.finfo(float).eps
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    keep = values > floor
    return (vectors[:, keep] / np.sqrt(values[keep])).T, False


def _leaf(rows: Iterator[dict], low: int, floor: float | None) -> Iterator[dict]:
    """The root of the few diagonal blocks from ``low`` on, by subspace, as tiles."""

    def done() -> Iterator[dict]:
        ends = np.cumsum([0, *(tile.shape[0] for (i, j), tile in sorted(held.items()) if i == j)])
        whole = np.empty((ends[-1], ends[-1]))
        for (i, j), tile in held.items():
            a, b = slice(ends[i - low], ends[i - low + 1]), slice(ends[j - low], ends[j - low + 1])
            whole[a, b], whole[b, a] = tile, tile.T
        root, lower = _root(whole, floor)
        last = len(ends) - 2
        for i in range(len(ends) - 1):
            for j in range(i + 1):
                part = root[:, ends[j] : ends[j + 1]]
                if lower:
                    yield _tile((owner[0], low + i, low + j, owner[1]), part[ends[i] : ends[i + 1]])
                elif i == last:
                    # without an order of its own, all of it stands in the last block row
                    yield _tile((owner[0], low + i, low + j, owner[1]), part)

    owner, held = None, {}
    for row in rows:
        if owner is not None and owner[0] != row["space_id"]:
            yield from done()
            held = {}
        owner = (row["space_id"], row["nb"])
        held[row["i"], row["j"]] = _matrix(row["data"], row["rows"], row["cols"])
    if owner is not None:
        yield from done()


class _Roots:
    """The recursion of the module's head, for all subspaces at once."""

    def __init__(self, n_spaces: int, floor: float | None):
        self.n_spaces, self.floor = n_spaces, floor

    def of(self, g: DataFrame, low: int, high: int) -> DataFrame:
        """W of the diagonal part [low, high) of the tiles ``g``."""
        if high - low <= LEAF_BLOCKS:
            floor = self.floor
            part = g.where((F.col("i") >= low) & (F.col("i") < high) & (F.col("j") >= low))
            part = part.repartition(_tasks(self.n_spaces), "space_id").sortWithinPartitions("space_id", "i", "j")
            return written(_mapped(part, lambda rows: _leaf(rows, low, floor), g.schema), "tiles", "i")
        middle = (low + high) // 2
        upper = self.of(g, low, middle)
        return upper.unionByName(self.below(g, upper, low, middle, high))

    def below(self, g: DataFrame, w: DataFrame, low: int, middle: int, high: int) -> DataFrame:
        """The rows [middle, high) of W, given those above."""
        i, j, last = F.col("i"), F.col("j"), F.least(F.lit(high), F.col("nb")) - 1
        inside = (i >= middle) & (i < high)
        tasks = _tasks(self.n_spaces * (high - middle) * (middle - low))
        cross = _product(
            _operand(g.where(inside & (j >= low) & (j < middle)), 0, i, _between(j, middle - 1), j),
            _operand(w, 1, _between(middle, last), i, j, turned=True),
            tasks,
        )
        cross = written(cross, "tiles", "i")
        rest = _product(
            _operand(cross, 0, i, _between(middle, i), j),
            _operand(cross, 1, _between(i, last), i, j, turned=True),
            _tasks(self.n_spaces * (high - middle) ** 2 // 2),
            -1.0,
            g.where(inside & (j >= middle)),
        )
        lower = self.of(written(rest, "tiles", "i"), middle, high)
        applied = _product(
            _operand(cross, 0, i, _between(low, j), j),
            _operand(w, 1, _between(middle, last), j, i),
            tasks,
        )
        corner = _product(
            _operand(lower, 0, i, _between(low, middle - 1), j),
            _operand(applied, 1, _between(i, last), j, i),
            tasks,
            -1.0,
        )
        return written(corner, "tiles", "i").unionByName(lower)


# ----------------------------------------------------------------------------- models


@dataclass(frozen=True)
class TiledModel:
    """Subspaces as tables: landmark ``blocks``, tiles of the root W (``factor``) and of
    G^-1 (``inverse``, j <= i). ``n_blocks`` is the most that a subspace has."""

    blocks: DataFrame
    factor: DataFrame
    inverse: DataFrame
    kernel: Kernel
    lam: float
    n_blocks: int
    n_spaces: int
    n_landmarks: int
    floor: float | None


@dataclass(frozen=True)
class DeferredModel:
    """The model of one subspace, ``landmarks``, whose tiles are fitted when they are first
    asked for. ``state`` is what the plan that chose the landmarks can go on from."""

    landmarks: DataFrame
    kernel: Kernel
    lam: float
    state: object
    n_spaces: int = 1

    @cached_property
    def fitted(self) -> TiledModel:
        return fit_tiled(self.landmarks, self.lam, self.kernel)

    @cached_property
    def n_landmarks(self) -> int:
        return self.landmarks.count()

    blocks = property(lambda self: self.fitted.blocks)
    factor = property(lambda self: self.fitted.factor)
    inverse = property(lambda self: self.fitted.inverse)
    n_blocks = property(lambda self: self.fitted.n_blocks)
    floor = property(lambda self: self.fitted.floor)


def _inverse(rows: DataFrame, tasks: int, old: DataFrame | None = None) -> DataFrame:
    """Tiles (j <= i) of ``old`` plus W'W of the given rows of W."""
    i, j = F.col("i"), F.col("j")
    return _product(
        _operand(rows, 0, j, _between(0, j), i, turned=True),
        _operand(rows, 1, _between(j, i), j, i),
        tasks,
        plus=old,
    )


def fit_tiled(
    spaces: DataFrame,
    lam: float,
    kernel: Kernel | None = None,
    by: str = "space_id",
    method: str = "chol",
    tile: int = TILE,
) -> TiledModel:
    """Fit every subspace of a landmark table, however many landmarks each has.

    With ``method='pinv'`` what a block adds to those before it counts only above rounding
    noise, which gives a generalised inverse of a singular matrix: energies of rows are
    those of the pseudo-inverse.
    """
    kernel = kernel or linear()
    blocks = landmark_blocks(spaces, by, tile)
    sizes = blocks.agg(F.max("nb"), F.count_distinct("space_id"), F.sum("n"), F.sum(F.col("nb"))).first()
    n_blocks, n_spaces, n_landmarks, n_tiles = (int(v or 0) for v in sizes)
    if not n_blocks:
        raise ValueError("no landmarks to fit")
    gram = written(_gram(blocks, kernel, lam, _tasks(n_tiles)), "tiles", "i")
    floor = None
    if method == "pinv":
        diagonal = _mapped(gram.where("i = j"), _largest, T.StructType(_fields(("most", T.DoubleType()))))
        largest = diagonal.agg(F.max("most")).first()[0]
        floor = largest * n_landmarks * np.finfo(float).eps
    elif method != "chol":
        raise ValueError(f"method must be 'chol' or 'pinv', not {method!r}")
    factor = _Roots(n_spaces, floor).of(gram, 0, n_blocks)
    inverse = written(_inverse(factor, _tasks(n_tiles)), "tiles", "i")
    return TiledModel(blocks, factor, inverse, kernel, lam, n_blocks, n_spaces, n_landmarks, floor)


def _largest(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        yield {"most": float(np.abs(np.diagonal(_matrix(row["data"], row["rows"]))).max())}


def append_landmarks(model: TiledModel | DeferredModel, spaces: DataFrame, tile: int = TILE) -> TiledModel:
    """The model of a single subspace with more landmarks; its root is kept and extended."""
    if model.n_spaces != 1:
        raise ValueError("landmarks can be appended to a model of one subspace")
    model = model.fitted if isinstance(model, DeferredModel) else model
    added = landmark_blocks(spaces, tile=tile)
    n_added, n_landmarks = added.agg(F.max("nb"), F.sum("n")).first()
    if not n_added:
        return model
    first, last = model.n_blocks, model.n_blocks + n_added
    shift = (F.col("b") + first).cast("int")
    added = added.withColumn("b", shift).withColumn("start", F.col("start") + model.n_landmarks)
    blocks = model.blocks.unionByName(added.select(*model.blocks.columns)).withColumn("nb", F.lit(last))
    gram = written(_gram(blocks, model.kernel, model.lam, _tasks(n_added * last), first), "tiles", "i")
    known = model.factor.withColumn("nb", F.lit(last))
    rows = _Roots(1, model.floor).below(gram, known, 0, first, last)
    old = model.inverse.withColumn("nb", F.lit(last))
    inverse = written(_inverse(rows, _tasks(last * last // 2), old), "tiles", "i")
    return replace(
        model,
        blocks=blocks,
        factor=known.unionByName(rows),
        inverse=inverse,
        n_blocks=last,
        n_landmarks=model.n_landmarks + n_landmarks,
    )


def _entries(tiles: DataFrame, blocks: DataFrame, name: str, index: str) -> DataFrame:
    """Both triangles as rows ``space_id, i, j, value``, named by ``index`` of the blocks."""
    spot = blocks.select("space_id", "b", F.col(index).alias("at"))
    named = tiles.join(spot.select("space_id", F.col("b").alias("i"), F.col("at").alias("at_i")), ["space_id", "i"])
    named = named.join(spot.select("space_id", F.col("b").alias("j"), F.col("at").alias("at_j")), ["space_id", "j"])
    schema = T.StructType(
        [tiles.schema["space_id"], *_fields(("i", T.LongType()), ("j", T.LongType()), (name, T.DoubleType()))]
    )

    def places(at, n: int) -> np.ndarray:
        return np.asarray(at) if isinstance(at, list) else np.arange(at, at + n)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data = _matrix(row["data"], row["rows"])
            i, j = places(row["at_i"], data.shape[0]), places(row["at_j"], data.shape[1])
            for a, b, values in ((i, j, data), (j, i, data.T))[: 1 if row["i"] == row["j"] else 2]:
                yield pa.RecordBatch.from_pydict(
                    {
                        "space_id": pa.array([row["space_id"]] * values.size, batch_type),
                        "i": np.repeat(a, len(b)).astype(np.int64),
                        "j": np.tile(b, len(a)).astype(np.int64),
                        name: np.ascontiguousarray(values).ravel(),
                    }
                )

    batch_type = to_arrow_schema(schema).field("space_id").type
    return named.mapInArrow(entries, schema)


def kernel_gram(spaces: DataFrame, kernel: Kernel | None = None, tile: int = TILE) -> DataFrame:
    """The kernel matrix of each subspace as rows ``space_id, i, j, k`` by landmark ``ord``.

    The result is m^2 rows by definition; they come out of tiles, so m has no bound.
    """
    blocks = landmark_blocks(spaces, tile=tile)
    n_tiles = blocks.agg(F.sum("nb")).first()[0] or 1
    return _entries(_gram(blocks, kernel or linear(), 0.0, _tasks(n_tiles)), blocks, "k", "ords")


def tiled_inverse_entries(model: TiledModel) -> DataFrame:
    """Entries of G^-1 by landmark place: ``space_id, i, j, g_inv``."""
    return _entries(model.inverse, model.blocks, "g_inv", "start")


# ---------------------------------------------------------------------------- scoring


def row_blocks(df: DataFrame, *partition_by: str) -> DataFrame:
    """Rows ``(id, x)`` in packed blocks ``block, n, ids, xs, rest``, written once; ``rest``
    has the other columns, if there are any.

    Blocks have equal values of ``partition_by`` columns, by which readers can prune.
    """
    others = [c for c in df.columns if c not in ("id", "x", *partition_by)]
    rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")] if others else []
    rows = df.select("id", F.col("x").cast("array<double>").alias("x"), *rest, *partition_by)
    lists = {"ids": "id", "xs": "x", **({"rest": "rest"} if others else {})}
    schema = T.StructType(
        [
            *_fields(("block", T.LongType()), ("n", T.IntegerType())),
            *[T.StructField(name, T.ArrayType(rows.schema[c].dataType)) for name, c in lists.items()],
            *[df.schema[c] for c in partition_by],
        ]
    )
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in partition_by))) or [()] * len(batch)
            for key in sorted(set(keys), key=str):
                mine = batch.filter(pa.array([k == key for k in keys])) if partition_by else batch
                width = max(1, (len(mine["x"].flatten()) // max(1, len(mine))))
                step = max(1, BLOCK_VALUES // width)
                for start in range(0, len(mine), step):
                    part = mine.slice(start, step)
                    columns = {
                        "block": pa.array([number], pa.int64()),
                        "n": pa.array([len(part)], pa.int32()),
                        **{name: pa.ListArray.from_arrays([0, len(part)], part[c]) for name, c in lists.items()},
                        **{c: pa.array([v], arrow.field(c).type) for c, v in zip(partition_by, key)},
                    }
                    yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)
                    number += 1

    return written(rows.mapInArrow(pack, schema), "rows", *partition_by)


def _plates(model: TiledModel, groups: int) -> tuple[DataFrame, int]:
    """Tiles of the inverse with the landmarks of both sides, numbered, once per row group."""
    landmarks = model.blocks.select("space_id", "b", "x", "start")
    sides = [
        landmarks.select("space_id", F.col("b").alias(c), F.col("x").alias(f"x_{c}"), F.col("start").alias(f"at_{c}"))
        for c in ("i", "j")
    ]
    plates = model.inverse.join(sides[0], ["space_id", "i"]).join(sides[1], ["space_id", "j"])
    sizes = model.blocks.groupBy("space_id").agg(F.max("nb").cast("long").alias("nb"))
    count = F.col("nb") * (F.col("nb") + 1) / 2
    before = Window.orderBy("space_id").rowsBetween(Window.unboundedPreceding, -1)
    # one row a subspace, a number each
    offsets = sizes.select("space_id", F.coalesce(F.sum(count).over(before), F.lit(0)).alias("offset"))
    n_plates = int(sizes.agg(F.sum(count)).first()[0])
    number = (F.col("offset") + F.col("i") * (F.col("i") + 1) / 2 + F.col("j")).cast("long")
    numbered = plates.join(offsets, "space_id").withColumn("plate", number).drop("offset", "nb", "cols")
    return numbered.withColumn("r", _between(0, groups - 1)), n_plates


def _lesser(
    least: np.ndarray | None, best: np.ndarray | None, leverage: np.ndarray, number: int, norms: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The least leverages with those of one more subspace, and the numbers of their subspaces.

    Leverages that differ by rounding noise are equal, and the first of them wins.
    """
    if least is None:
        return leverage, np.zeros(len(leverage), np.int32)
    better = leverage < least - np.maximum(norms, 1e-300) * 1e-12
    return np.where(better, leverage, least), np.where(better, number, best).astype(np.int32)


def block_leverages(blocks: DataFrame, model: TiledModel) -> DataFrame:
    """``block, best, least, total``: for each row block the least leverage of its rows over
    the subspaces, the number of the subspace (in order of ``space_id``; of equal ones the
    first) as packed arrays, and the sum of those leverages that are numbers. Rows without
    a vector are left out of the arrays.
    """
    kernel = model.kernel
    n_rows = blocks.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-n_rows // GROUP_ROWS))
    plates, n_plates = _plates(model, groups)
    rows = blocks.select("block", "xs", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("r"))
    rows = rows.withColumn("plate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_plates - 1).cast("long"))))
    both = plates.withColumn("side", F.lit(0)).unionByName(rows.withColumn("side", F.lit(1)), allowMissingColumns=True)
    key = ["plate", "r"]
    both = both.repartition(_tasks(n_plates * groups), *key).sortWithinPartitions(*key, "side")
    space = model.blocks.schema["space_id"]
    energy = T.StructType([space, *_fields(("block", T.LongType()), ("part", T.BinaryType()))])
    arrow = to_arrow_schema(energy)

    def energies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plate = None
        for batch in batches:
            for k, side in enumerate(batch["side"].to_pylist()):
                if side == 0:
                    row = {c: batch[c][k].as_py() for c in ("plate", "r", "space_id", "i", "j", "rows", "data", "x_i", "x_j")}
                    data = _matrix(row["data"], row["rows"])
                    sides = [_matrix(row[f"x_{c}"], n) for c, n in zip("ij", data.shape)]
                    twice = 1.0 if row["i"] == row["j"] else 2.0
                    plate = (row["plate"], row["r"])
                    continue
                assert plate == (batch["plate"][k].as_py(), batch["r"][k].as_py())
                y, _ = rows_of(batch["xs"][k].values)
                out = np.empty(len(y))
                for start in range(0, len(y), STEP_ROWS):
                    some = y[start : start + STEP_ROWS]
                    left = kernel.block(some, sides[0])
                    right = left if row["i"] == row["j"] else kernel.block(some, sides[1])
                    out[start : start + STEP_ROWS] = twice * np.einsum("nj,nj->n", left @ data, right)
                yield pa.RecordBatch.from_pylist(
                    [{"space_id": row["space_id"], "block": batch["block"][k].as_py(), "part": out.tobytes()}], schema=arrow
                )

    parts = both.mapInArrow(energies, energy)
    numbers = blocks.select("block", "xs").withColumn("part", F.lit(None).cast("binary"))
    numbers = numbers.withColumn("space_id", F.lit(None).cast(space.dataType))
    joined = parts.withColumn("xs", F.lit(None).cast(blocks.schema["xs"].dataType)).unionByName(numbers)
    joined = joined.repartition(_tasks(-(-n_rows // GROUP_ROWS) * 8), "block")
    # the row without a part comes first, then the parts by subspace
    joined = joined.sortWithinPartitions("block", F.col("part").isNotNull(), "space_id")
    result = T.StructType(
        _fields(("block", T.LongType()), ("best", T.BinaryType()), ("least", T.BinaryType()), ("total", T.DoubleType()))
    )
    final = to_arrow_schema(result)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = norms = least = best = total = space_id = None
        number = -1

        def take() -> None:
            nonlocal least, best
            if total is not None:
                least, best = _lesser(least, best, norms - total, number, norms)

        def done() -> Iterator[pa.RecordBatch]:
            if block is not None:
                take()
                row = {"block": block, "best": best.tobytes(), "least": least.tobytes()}
                row["total"] = float(np.nansum(least)) if len(least) else 0.0
                yield pa.RecordBatch.from_pylist([row], schema=final)

        for batch in batches:
            for k in range(batch.num_rows):
                part = batch["part"][k].as_py()
                if part is None:
                    yield from done()
                    block, norms = batch["block"][k].as_py(), kernel.diagonal(rows_of(batch["xs"][k].values)[0])
                    least = best = total = space_id = None
                    number = -1
                    continue
                owner = batch["space_id"][k].as_py()
                if total is None or owner != space_id:
                    take()
                    total, space_id, number = np.zeros(len(norms)), owner, number + 1
                total = total + np.frombuffer(part)
        yield from done()

    return joined.mapInArrow(reduce, result)


def unpacked(blocks: DataFrame, scores: DataFrame, out: str = "leverage") -> DataFrame:
    """The rows of packed blocks with their scores, ``best`` and ``<out>``; a row without a
    vector has null scores."""
    lists = [c for c in ("ids", "xs", "rest") if c in blocks.columns]
    schema = T.StructType(
        [
            *[T.StructField(c, blocks.schema[c].dataType.elementType) for c in lists],
            *_fields(("best", T.IntegerType()), (out, T.DoubleType())),
        ]
    )
    arrow = to_arrow_schema(schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                columns = [batch[c][k].values for c in lists]
                xs = columns[1]
                present = np.asarray(xs.is_valid()) if xs.null_count else None
                for name, kind in (("best", np.int32), ("least", float)):
                    columns.append(with_nulls(pa.array(np.frombuffer(batch[name][k].as_py(), kind)), present))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    rows = blocks.select("block", *lists).join(scores, "block").mapInArrow(spread, schema)
    rest = [F.col("rest.*")] if "rest" in lists else []
    return rows.select(F.col("ids").alias("id"), F.col("xs").alias("x"), *rest, "best", out)


def _feature_width(model: TiledModel) -> int:
    """Features of a row, or 0 if the kernel has no map to them."""
    if not model.kernel.explicit:
        return 0
    width = model.blocks.select((F.octet_length("x") / 8 / F.col("n")).cast("int")).first()[0]
    return model.kernel.features(np.ones((1, width))).shape[1]


def feature_residuals(model: TiledModel) -> list[tuple[object, np.ndarray]]:
    """``space_id`` and I - B'B of each subspace, in order, for B = W phi(X): what a subspace
    leaves of phi(y) has the square phi(y)' (I - B'B) phi(y). A subspace without a name comes last."""
    kernel, i, j, corner = model.kernel, F.col("i"), F.col("j"), F.lit(0)

    def features(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            phi = kernel.features(_matrix(row["x"], row["n"]))
            yield _tile((row["space_id"], row["b"], 0, row["nb"]), phi)

    landmarks = model.blocks.select("space_id", "b", "nb", "n", "x")
    phi = _mapped(landmarks, features, _tile_schema(model.blocks.schema["space_id"].dataType))
    image = _product(
        _operand(model.factor, 0, i, corner, j),
        _operand(phi, 1, _between(i, F.col("nb") - 1), corner, i),
        _tasks(model.n_spaces * model.n_blocks),
    )
    image = written(image, "tiles")
    energy = _product(
        _operand(image, 0, corner, corner, i, turned=True),
        _operand(image, 1, corner, corner, i),
        _tasks(model.n_spaces),
    )
    found = [(row["space_id"], _matrix(row["data"], row["rows"], row["cols"])) for row in energy.collect()]
    return [
        (name, np.eye(len(matrix)) - (matrix + matrix.T) / 2)
        for name, matrix in sorted(found, key=lambda pair: (pair[0] is None, pair[0]))
    ]


def _feature_leverages(df: DataFrame, model: TiledModel, width: int, out: str) -> DataFrame:
    kernel = model.kernel
    residuals = [matrix for _, matrix in feature_residuals(model)]
    shared = df.sparkSession.sparkContext.broadcast(residuals)

    def compute(rows: np.ndarray) -> np.ndarray:
        phi, norms = kernel.features(rows), kernel.diagonal(rows)
        least = best = None
        for number, matrix in enumerate(shared.value):
            leverage = np.einsum("nj,nj->n", phi @ matrix, phi)
            least, best = _lesser(least, best, leverage, number, norms)
        return np.column_stack([best, least])

    scorer = row_scorer(compute, "array<double>", width)
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("id", "x")]
    rows = df.select("id", F.col("x").cast("array<double>").alias("x"), *others)
    scored = rows.withColumn("_scores", scorer(F.col("x"), _id_or_null(rows)))
    return scored.select(
        "id", "x", *others, F.col("_scores")[0].cast("int").alias("best"), F.col("_scores")[1].alias(out)
    )


def tiled_leverage_min(df: DataFrame, model: TiledModel, out: str = "leverage") -> DataFrame:
    """The rows of ``df`` with the least leverage over the subspaces of the model, and the
    number ``best`` of that subspace in order of ``space_id``. Columns come in the order
    id, x, others."""
    width = _feature_width(model)
    fewer = 0 < width * model.n_spaces <= model.n_landmarks
    if fewer and width * width * model.n_spaces * 8 <= BROADCAST_MAX_BYTES:
        return _feature_leverages(df, model, width, out)
    blocks = row_blocks(df)
    return unpacked(blocks, block_leverages(blocks, model), out)


# ------------------------------------------------------------------ nearest landmarks


def kernel_top(
    df: DataFrame, spaces: DataFrame, kernel: Kernel | None = None, k: int = 10, tile: int = TILE
) -> DataFrame:
    """The k landmarks of largest kernel value for each row: ``id, rank, space_id, ord,
    landmark_id, k`` with ranks from 1.

    Row blocks meet landmark blocks in a grid, each cell keeps k values a row, and those
    are merged by row block: neither a row nor a task ever has all landmarks. Small blocks
    share a cell up to ``TILE`` landmarks, so that a row is sent once for each so many and not
    once a block. Values that agree to nine decimals are ranked by (space_id, ord). Rows
    without a vector have none.
    """
    kernel = kernel or linear()
    landmarks, blocks = landmark_blocks(spaces, tile=tile), row_blocks(df.select("id", "x"))
    sizes = landmarks.groupBy("space_id").agg(F.max("nb").cast("long").alias("nb"))
    before = Window.orderBy("space_id").rowsBetween(Window.unboundedPreceding, -1)
    # one row a subspace, a number each
    offsets = sizes.select("space_id", F.coalesce(F.sum("nb").over(before), F.lit(0)).alias("offset"))
    landmarks = landmarks.join(offsets, "space_id").withColumn("plate", F.col("offset") + F.col("b"))
    n_plates = int(sizes.agg(F.sum("nb")).first()[0] or 0)
    band_plates = max(1, TILE // tile)
    n_bands = max(1, -(-n_plates // band_plates))
    groups = max(1, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // GROUP_ROWS))
    plates = landmarks.select(
        F.floor(F.col("plate") / band_plates).cast("int").alias("band"),
        "plate", F.col("n").alias("m"), F.col("x").alias("landmarks"), _between(0, groups - 1).alias("r"),
    )
    rows = blocks.select(
        "block", "xs", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("r"), _between(0, n_bands - 1).alias("band")
    )
    both = plates.withColumn("side", F.lit(0)).unionByName(rows.withColumn("side", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(_tasks(n_bands * groups), "band", "r").sortWithinPartitions("band", "r", "side", "plate")
    schema = T.StructType(
        _fields(
            ("block", T.LongType()), ("band", T.IntegerType()), ("kept", T.IntegerType()),
            ("values", T.BinaryType()), ("plates", T.BinaryType()), ("places", T.BinaryType()),
        )
    )
    arrow = to_arrow_schema(schema)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, held = None, [], None
        for batch in batches:
            for number, side in enumerate(batch["side"].to_pylist()):
                band = batch["band"][number].as_py()
                if side == 0:
                    if (band, batch["r"][number].as_py()) != cell:
                        cell, parts = (band, batch["r"][number].as_py()), []
                    part = _matrix(batch["landmarks"][number].as_py(), batch["m"][number].as_py())
                    parts.append((batch["plate"][number].as_py(), part))
                    held = None
                    continue
                if held is None:
                    held = np.vstack([part for _, part in parts])
                    plate_of = np.repeat([plate for plate, _ in parts], [len(part) for _, part in parts])
                    place_of = np.concatenate([np.arange(len(part), dtype=np.int32) for _, part in parts])
                y, _ = rows_of(batch["xs"][number].values)
                kept = min(k, len(held))
                values, spots = np.empty((len(y), kept)), np.empty((len(y), kept), np.int32)
                for start in range(0, len(y), STEP_ROWS):
                    some = slice(start, start + STEP_ROWS)
                    found = kernel.block(y[some], held)
                    order = np.argsort(-np.round(found, 9), axis=1, kind="stable")[:, :kept]
                    values[some], spots[some] = np.take_along_axis(found, order, 1), order
                row = {"block": batch["block"][number].as_py(), "band": band, "kept": kept, "values": values.tobytes()}
                row |= {"plates": plate_of[spots].astype(np.int64).tobytes(), "places": place_of[spots].tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    ident = blocks.schema["ids"].dataType.elementType
    long = T.LongType()
    merged_schema = T.StructType(
        _fields(("id", ident), ("rank", T.IntegerType()), ("plate", long), ("place", T.IntegerType()), ("k", T.DoubleType()))
    )
    merged_arrow = to_arrow_schema(merged_schema)
    parts = both.mapInArrow(cells, schema)
    names = blocks.select("block", "ids", "xs")
    joined = parts.unionByName(names, allowMissingColumns=True).repartition(_tasks(8 * groups), "block")
    joined = joined.sortWithinPartitions("block", F.col("band").asc_nulls_first())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = values = plate = places = None

        def done() -> Iterator[pa.RecordBatch]:
            if values is not None and values.size:
                n, kept = values.shape
                columns = [
                    ids.take(pa.array(np.repeat(np.arange(n), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), n)),
                    *(pa.array(a.ravel()) for a in (plate, places, values)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=merged_arrow)

        for batch in batches:
            for number in range(batch.num_rows):
                if not batch["band"][number].is_valid:
                    yield from done()
                    ids, xs = batch["ids"][number].values, batch["xs"][number].values
                    ids, values = ids.filter(xs.is_valid()), None
                    continue
                kept = batch["kept"][number].as_py()
                more = np.frombuffer(batch["values"][number].as_py()).reshape(len(ids), kept)
                spots = np.frombuffer(batch["places"][number].as_py(), np.int32).reshape(len(ids), kept)
                source = np.frombuffer(batch["plates"][number].as_py(), np.int64).reshape(len(ids), kept)
                if values is None:
                    values, plate, places = more, source, spots
                    continue
                everything = [np.hstack(pair) for pair in ((values, more), (plate, source), (places, spots))]
                order = np.argsort(-np.round(everything[0], 9), axis=1, kind="stable")[:, :k]
                values, plate, places = (np.take_along_axis(a, order, 1) for a in everything)
        yield from done()

    top = joined.mapInArrow(merge, merged_schema)
    known = landmarks.select("plate", "space_id", F.posexplode(F.arrays_zip("ords", "ids")).alias("place", "mark"))
    known = known.select("plate", "place", "space_id", F.col("mark.ords").alias("ord"), F.col("mark.ids").alias("landmark_id"))
    return top.join(broadcast_if_small(known), ["plate", "place"]).select("id", "rank", "space_id", "ord", "landmark_id", "k")
