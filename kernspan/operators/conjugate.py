"""Kernel systems (k(X, X) + lambda P) a = f of any size by conjugate gradients.

The unknowns of a subspace are blocks of landmarks, a row each. A step multiplies by the
matrix without keeping it: pairs of blocks meet as in the tiled Gram matrix, each makes its
part of the kernel and adds it to both blocks. All outputs of a subspace, and all
subspaces, take their steps together.

The preconditioner is D + k(X, S) k(S, S)^-1 k(S, X) with D = lambda P and a bounded
sample S of the landmarks, inverted by the Woodbury identity with the matrix

    C = k(S, S) + k(S, X) D^-1 k(X, S)

of sample size. What a step needs from all blocks (its step length, the next direction's
share and the sample's part of the residual) are sums that come with the product, so a step
is one product and one update of the blocks, each written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kernspan.functions.kernels import Kernel
from kernspan.operators.tiles import MIN_REG, TILE, _between, _mapped, _matrix, _tasks, landmark_blocks
from kernspan.session import written

#: landmarks of the preconditioner's sample, or one a block where there are more blocks
SAMPLE = 1024
#: residual, as a share of the first one, at which an output is solved
TOLERANCE = 1e-11
#: steps without a smaller residual after which rounding is taken to have the last word
PATIENCE = 20
#: groups in which matrices of sample size are added first
SALTS = 16

_BYTES = T.BinaryType()


def _schema(space: T.StructField, *names: str, **kinds: T.DataType) -> T.StructType:
    fields = [T.StructField(n, _BYTES) for n in names]
    return T.StructType([space, *[T.StructField(n, k) for n, k in kinds.items()], *fields])


def _add(rows: Iterator[dict], keys: list[str], values: list[str]) -> Iterator[dict]:
    """Rows sorted by ``keys``, with the packed numbers of ``values`` added up."""
    now, sums = None, None
    for row in rows:
        key = [row[k] for k in keys]
        if key != now:
            if now is not None:
                yield {**dict(zip(keys, now)), **{n: s.tobytes() for n, s in zip(values, sums)}}
            now, sums = key, [np.frombuffer(row[n]).copy() for n in values]
        else:
            for total, name in zip(sums, values):
                total += np.frombuffer(row[name])
    if now is not None:
        yield {**dict(zip(keys, now)), **{n: s.tobytes() for n, s in zip(values, sums)}}


def _summed(df: DataFrame, keys: list[str], values: list[str], tasks: int) -> DataFrame:
    schema = T.StructType([df.schema[c] for c in [*keys, *values]])
    ordered = df.select(*keys, *values).repartition(_tasks(tasks), *keys).sortWithinPartitions(*keys)
    return _mapped(ordered, lambda rows: _add(rows, keys, values), schema)


def _samples(blocks: DataFrame, kernel: Kernel, lam: float, n_spaces: int, sample: int) -> DataFrame:
    """``space_id, xs, root``: the sample of each subspace and the root of C^-1."""
    space = blocks.schema["space_id"]

    def pick(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            x = _matrix(row["x"], row["n"])
            some = np.unique(np.linspace(0, len(x) - 1, max(1, min(len(x), sample // row["nb"]))).astype(int))
            yield {"space_id": row["space_id"], "b": row["b"], "n": len(some), "xs": x[some].tobytes()}

    def join(rows: Iterator[dict]) -> Iterator[dict]:
        now, held, n = None, [], 0
        for row in rows:
            if held and row["space_id"] != now:
                yield {"space_id": now, "s": n, "xs": b"".join(held)}
                held, n = [], 0
            now, n = row["space_id"], n + row["n"]
            held.append(row["xs"])
        if held:
            yield {"space_id": now, "s": n, "xs": b"".join(held)}

    def part(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            cross = kernel.block(_matrix(row["xs"], row["s"]), _matrix(row["x"], row["n"]))
            weights = lam * np.maximum(np.frombuffer(row["reg"]), MIN_REG)
            yield {"space_id": row["space_id"], "salt": row["b"] % SALTS, "c": ((cross / weights) @ cross.T).tobytes()}

    def root(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            xs = _matrix(row["xs"], row["s"])
            c = kernel.block(xs, xs) + _matrix(row["c"], row["s"])
            values, vectors = np.linalg.eigh((c + c.T) / 2)
            keep = values > values.max() * len(c) * np.finfo(float).eps
            inverse = vectors[:, keep] / np.sqrt(values[keep])
            yield {**{k: row[k] for k in ("space_id", "s", "xs")}, "root": np.ascontiguousarray(inverse).tobytes()}

    whole = T.IntegerType()
    picked = _mapped(blocks, pick, _schema(space, "xs", b=whole, n=whole))
    ordered = picked.repartition(_tasks(n_spaces), "space_id").sortWithinPartitions("space_id", "b")
    chosen = written(_mapped(ordered, join, _schema(space, "xs", s=whole)), "samples")
    parts = _mapped(blocks.join(chosen, "space_id"), part, _schema(space, "c", salt=whole))
    few = _summed(parts, ["space_id", "salt"], ["c"], n_spaces * SALTS)
    sums = _summed(few, ["space_id"], ["c"], n_spaces).join(chosen, "space_id")
    return written(_mapped(sums, root, _schema(space, "xs", "root", s=whole)), "samples")


def _weights(row: dict, lam: float) -> np.ndarray:
    return lam * np.maximum(np.frombuffer(row["reg"]), MIN_REG)[:, None]


def _block_sums(x: np.ndarray, xs: np.ndarray, d: np.ndarray, r: np.ndarray, kernel: Kernel) -> dict:
    """A block's part of u = k(S, X) D^-1 r and of r D^-1 r, by output."""
    v = r / d
    return {"u": (kernel.block(xs, x) @ v).tobytes(), "rv": (r * v).sum(0).tobytes()}


def solve(
    spaces: DataFrame,
    lam: float,
    kernel: Kernel,
    tile: int = TILE,
    sample: int = SAMPLE,
    max_steps: int = 1000,
) -> DataFrame:
    """``space_id, ord, id, x, alpha`` for landmarks with ``targets``, by subspace.

    Needs lambda > 0. A subspace may have any number of landmarks: a task holds two blocks
    of them and its sample.
    """
    if lam <= 0:
        raise ValueError("the iterative solver needs lambda > 0")
    blocks = landmark_blocks(spaces, tile=tile, targets=True)
    sizes = blocks.agg(F.count_distinct("space_id"), F.count(F.lit(1)), F.sum("nb")).first()
    n_spaces, n_blocks, n_pairs = (int(v or 0) for v in sizes)
    if not n_blocks:
        raise ValueError("no landmarks to fit")
    samples = _samples(blocks, kernel, lam, n_spaces, sample)
    space, whole = blocks.schema["space_id"], T.IntegerType()
    state_schema = _schema(space, "x", "reg", "a", "r", "p", "u", "rv", b=whole, nb=whole, n=whole)
    dot_names = ["pq", "rq", "qq", "uq", "u", "rv"]

    def begin(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            x, r = _matrix(row["x"], row["n"]), _matrix(row["f"], row["n"])
            sums = _block_sums(x, _matrix(row["xs"], row["s"]), _weights(row, lam), r, kernel)
            zero = np.zeros(r.shape).tobytes()
            yield {**row, **sums, "a": zero, "r": r.tobytes(), "p": zero}

    def directed(rows: Iterator[dict]) -> Iterator[dict]:
        """p = z + beta p, where z applies the preconditioner to the residual."""
        for row in rows:
            x, n = _matrix(row["x"], row["n"]), row["n"]
            r, p = _matrix(row["r"], n), _matrix(row["p"], n)
            xs, d = _matrix(row["xs"], row["s"]), _weights(row, lam)
            z = (r - kernel.block(x, xs) @ _matrix(row["w"], row["s"])) / d
            yield {**row, "p": (z + np.frombuffer(row["beta"]) * p).tobytes()}

    def products(rows: Iterator[dict]) -> Iterator[dict]:
        upper = None
        for row in rows:
            x, p = _matrix(row["x"], row["n"]), _matrix(row["p"], row["n"])
            if row["side"] == 0:
                upper = (x, p)
                continue
            k = kernel.block(upper[0], x)
            part = k @ p
            if row["i"] == row["j"]:
                part = part + _weights(row, lam) * p
            yield {"space_id": row["space_id"], "b": row["i"], "q": part.tobytes()}
            if row["i"] != row["j"]:
                yield {"space_id": row["space_id"], "b": row["j"], "q": (k.T @ upper[1]).tobytes()}

    def dots(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            x, n, d = _matrix(row["x"], row["n"]), row["n"], _weights(row, lam)
            q, p, r = (_matrix(row[c], n) for c in ("q", "p", "r"))
            yield {
                **row,
                "pq": (p * q).sum(0).tobytes(),
                "rq": (r * q / d).sum(0).tobytes(),
                "qq": (q * q / d).sum(0).tobytes(),
                "uq": (kernel.block(_matrix(row["xs"], row["s"]), x) @ (q / d)).tobytes(),
            }

    def moved(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            x, n, alpha = _matrix(row["x"], row["n"]), row["n"], np.frombuffer(row["alpha"])
            a, r, p, q = (_matrix(row[c], n) for c in ("a", "r", "p", "q"))
            r = r - alpha * q
            sums = _block_sums(x, _matrix(row["xs"], row["s"]), _weights(row, lam), r, kernel)
            yield {**row, **sums, "a": (a + alpha * p).tobytes(), "r": r.tobytes()}

    def preconditioned(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """u, r D^-1 r, C^-1 u and r z of a subspace."""
        root, rv = _matrix(row["root"], row["s"]), np.frombuffer(row["rv"])
        u = _matrix(row["u"], row["s"])
        w = root @ (root.T @ u)
        return u, rv, w, rv - (u * w).sum(0)

    def ratio(above: np.ndarray, below: np.ndarray) -> np.ndarray:
        safe = (below > 0) & np.isfinite(above)
        return np.where(safe, above / np.where(safe, below, 1.0), 0.0)

    def first_share(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            _, rv, w, _ = preconditioned(row)
            yield {"space_id": row["space_id"], "w": w.tobytes(), "beta": np.zeros(len(rv)).tobytes()}

    def shares(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            u, rv, _, rz = preconditioned(row)
            pq, rq, qq = (np.frombuffer(row[c]) for c in ("pq", "rq", "qq"))
            alpha = ratio(rz, pq)
            after = {
                **row,
                "u": (u - alpha * _matrix(row["uq"], row["s"])).tobytes(),
                "rv": (rv - 2 * alpha * rq + alpha * alpha * qq).tobytes(),
            }
            _, _, w, rz_after = preconditioned(after)
            beta = np.maximum(ratio(rz_after, rz), 0.0)
            yield {"space_id": row["space_id"], "alpha": alpha.tobytes(), "w": w.tobytes(), "beta": beta.tobytes()}

    def with_sample(df: DataFrame) -> DataFrame:
        return df.join(samples.drop("root"), "space_id")

    def by_space(df: DataFrame, names: list[str], function, *out: str) -> DataFrame:
        few = df.withColumn("salt", (F.col("b") % SALTS).cast("int"))
        few = _summed(few, ["space_id", "salt"], names, min(n_spaces * SALTS, n_blocks))
        sums = _summed(few, ["space_id"], names, n_spaces).join(samples, "space_id")
        return _mapped(sums, function, _schema(space, *out))

    state = written(_mapped(with_sample(blocks), begin, state_schema), "state")
    share = by_space(state, ["u", "rv"], first_share, "w", "beta")
    state = written(_mapped(with_sample(state).join(share, "space_id"), directed, state_schema), "state")
    first, least, waited = _residuals(state), np.inf, 0
    b, nb, key = F.col("b"), F.col("nb"), ["space_id", "i", "j"]
    for _ in range(max_steps):
        some = ["space_id", "n", "x", "reg", "p"]
        left = state.select(*some, b.alias("i"), _between(0, b).alias("j"), F.lit(0).alias("side"))
        right = state.select(*some, _between(b, nb - 1).alias("i"), b.alias("j"), F.lit(1).alias("side"))
        pairs = left.unionByName(right).repartition(_tasks(n_pairs), *key).sortWithinPartitions(*key, "side")
        product = _summed(_mapped(pairs, products, _schema(space, "q", b=whole)), ["space_id", "b"], ["q"], n_blocks)
        joined = with_sample(state.join(product, ["space_id", "b"]))
        out = T.StructType([*state_schema, *[T.StructField(c, _BYTES) for c in ("q", "pq", "rq", "qq", "uq")]])
        stepped = written(_mapped(joined, dots, out), "state")
        share = written(by_space(stepped, dot_names, shares, "alpha", "w", "beta"), "share")
        following = with_sample(stepped).join(share, "space_id")

        def step(rows: Iterator[dict]) -> Iterator[dict]:
            yield from directed(moved(rows))

        state = written(_mapped(following, step, state_schema), "state")
        left_over = max((np.sqrt(r / f) for r, f in zip(_residuals(state), first) if f > 0), default=0.0)
        waited = 0 if left_over < least else waited + 1
        least = min(least, left_over)
        if left_over <= TOLERANCE or waited >= PATIENCE:
            break
    return _coefficients(state, blocks, spaces)


def _residuals(state: DataFrame) -> list[float]:
    """r D^-1 r of every subspace and output, in order: a few numbers."""
    total = _summed(state, ["space_id"], ["rv"], 1)
    rows = sorted(total.collect(), key=lambda row: row["space_id"])
    return [float(v) for row in rows for v in np.frombuffer(row["rv"])]


def _coefficients(state: DataFrame, blocks: DataFrame, spaces: DataFrame) -> DataFrame:
    """One row a landmark, from the solved blocks."""
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [*[spaces.schema[c] for c in ("space_id", "ord", "id")], T.StructField("x", numbers), T.StructField("alpha", numbers)]
    )
    arrow = to_arrow_schema(schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                columns = [[row["space_id"]] * n, row["ords"], row["ids"]]
                columns += [_matrix(row[c], n).tolist() for c in ("x", "a")]
                arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    solved = state.select("space_id", "b", "a").join(blocks, ["space_id", "b"])
    return solved.select("space_id", "n", "ords", "ids", "x", "a").mapInArrow(spread, schema)
