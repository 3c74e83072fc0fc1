"""The vector tables the registered queries run on, in Spark and in SQL.

``vectors``   the embeddings: 64 numbers of length one, ten labels
``events``    four numbers per event, scaled to unit variance, five labels
``events_raw``  the same, unscaled
``lineitem``  four very unevenly scaled numbers per order line, three labels

All queries run on whole tables. Landmarks are uniform samples of a table: the
rows with the smallest hash uniform, per subspace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernspan.operators.landmarks import uniform_spaces
from kernspan.operators.stats import standardize

SEED = 42
N_SPACES = 3
LANDMARKS = 16
LAMBDA = 0.1

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
RETURN_FLAGS = ["A", "N", "R"]


def _index(column: str, values: list[str]):
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)) - 1


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    return table.select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def events_raw(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/events.parquet")
    return table.select(
        F.col("event_id").alias("id"),
        _index("event_type", EVENT_TYPES).cast("long").alias("label"),
        F.array(
            "value",
            F.hour("ts").cast("double"),
            F.dayofmonth("ts").cast("double"),
            F.col("user_id").cast("double"),
        ).alias("x"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return standardize(events_raw(spark, sf), by="std")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/lineitem.parquet")
    return table.select(
        F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"),
        _index("l_returnflag", RETURN_FLAGS).cast("long").alias("label"),
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("x"),
    )


def spaces(table: DataFrame, m: int = LANDMARKS, n_spaces: int = N_SPACES) -> DataFrame:
    return uniform_spaces(table, n_spaces, m, SEED)


# ---------------------------------------------------------------- SQL


def _case(column: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values))
    return f"CAST(CASE {column} {arms} END AS BIGINT)"


SQL_RAW = {
    "vectors": """SELECT vec_id AS id, CAST(label AS BIGINT) AS label,
        CAST(embedding AS DOUBLE[]) AS x FROM embeddings""",
    "events_raw": f"""SELECT event_id AS id, {_case('event_type', EVENT_TYPES)} AS label,
        [value, CAST(hour(ts) AS DOUBLE), CAST(day(ts) AS DOUBLE),
         CAST(user_id AS DOUBLE)] AS x FROM events""",
    "lineitem": f"""SELECT l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':'
        || l_linenumber AS id, {_case('l_returnflag', RETURN_FLAGS)} AS label,
        [l_quantity, l_extendedprice, l_discount, l_tax] AS x FROM lineitem""",
}


def uniform(seed: object, round_no: object, part: int = 0) -> str:
    return (
        f"(CAST('0x' || substr(md5('{seed}:{round_no}:' || id), {8 * part + 1}, 8) AS BIGINT)"
        " / 4294967296::DOUBLE)"
    )


def table_ctes(name: str) -> str:
    """CTEs ending in ``t(id, label, x)``."""
    if name != "events":
        return f"t AS MATERIALIZED ({SQL_RAW[name]})"
    return f"""raw AS ({SQL_RAW['events_raw']}),
    moments AS (SELECT pos, avg(v) AS mu, sqrt(var_pop(v)) AS sd
        FROM (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM raw) GROUP BY pos),
    scaling AS (SELECT list(mu ORDER BY pos) AS mu, list(sd ORDER BY pos) AS sd FROM moments),
    t AS MATERIALIZED (SELECT id, label,
        list_transform(x, lambda v, i: (v - mu[i]) / sd[i]) AS x FROM raw, scaling)"""


def space_ctes(m: int = LANDMARKS, n_spaces: int = N_SPACES, seed: object = SEED) -> str:
    """CTE ``sp(space_id, ord, id, x, reg, label)`` of uniform samples of ``t``."""
    parts = []
    for s in range(n_spaces):
        parts.append(
            f"""SELECT {s} AS space_id, rn - 1 AS ord, id, x, 1.0::DOUBLE AS reg, label FROM (
            SELECT *, row_number() OVER (ORDER BY {uniform(seed, s // 4, s % 4)}, id) AS rn FROM t)
            WHERE rn <= {m}"""
        )
    return "sp AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def inverse_root_ctes(rows: str, out: str) -> str:
    """From ``rows(space_id, i, g DOUBLE[])``, the symmetric matrices row by
    row, the CTE ``out(space_id, i, w DOUBLE[])``: row i of L^-1.

    Forward elimination of [G | I] gives the unit lower inverse; dividing row i
    by the root of its pivot gives L^-1.
    """
    return f"""{out}_0 AS (SELECT space_id, len(any_value(g)) AS m,
        list(list_concat(g, list_transform(range(1, len(g) + 1),
            lambda j: CASE WHEN j = i THEN 1.0 ELSE 0.0 END)) ORDER BY i) AS a
        FROM {rows} GROUP BY space_id),
    {out}_e AS (SELECT space_id, m, 1 AS k, a FROM {out}_0
        UNION ALL
        SELECT space_id, m, k + 1, list_transform(a, lambda r, i: CASE WHEN i <= k THEN r
            ELSE list_transform(r, lambda v, j: v - r[k] / a[k][k] * a[k][j]) END)
        FROM {out}_e WHERE k < m),
    {out} AS MATERIALIZED (SELECT space_id, unnest(range(1, m + 1)) AS i,
        unnest(list_transform(a, lambda r, i:
            list_transform(r[m + 1 : 2 * m], lambda v: v / sqrt(r[i])))) AS w
        FROM {out}_e WHERE k = m)"""


KERNEL_SQL = {
    "poly": "(list_inner_product({a}, {b}) + 1) ** 2",
    "custom": "1 / (1 + list_inner_product({a}, {a}) + list_inner_product({b}, {b})"
    " - 2 * list_inner_product({a}, {b}))",
    "linear": "list_inner_product({a}, {b})",
    "cosine": "list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a})"
    " * list_inner_product({b}, {b}))",
    "rbf": "exp(-0.5 * (list_inner_product({a}, {a}) + list_inner_product({b}, {b})"
    " - 2 * list_inner_product({a}, {b})))",
}


def kernel(a: str, b: str, name: str = "linear") -> str:
    return KERNEL_SQL[name].format(a=a, b=b)


def dual_ctes(lam: str = str(LAMBDA), sp: str = "sp", out: str = "w", name: str = "linear") -> str:
    """CTE ``out`` with the rows of L^-1 of every subspace of ``sp``."""
    gram = f"""{out}_g AS (SELECT a.space_id, a.ord + 1 AS i,
        list({kernel('a.x', 'b.x', name)} + CASE WHEN a.ord = b.ord
            THEN ({lam}) * greatest(a.reg, 1e-12) ELSE 0 END ORDER BY b.ord) AS g
        FROM {sp} a JOIN {sp} b ON a.space_id = b.space_id GROUP BY a.space_id, a.ord)"""
    return gram + ",\n    " + inverse_root_ctes(f"{out}_g", out)


def cross_ctes(sp: str = "sp", out: str = "c", t: str = "t", name: str = "linear") -> str:
    """CTE ``out(id, space_id, kv)``: k(X, y) of every row and subspace."""
    return f"""{out} AS MATERIALIZED (SELECT t.id, s.space_id,
        list({kernel('s.x', 't.x', name)} ORDER BY s.ord) AS kv
        FROM {t} t CROSS JOIN {sp} s GROUP BY t.id, s.space_id)"""


def leverage_ctes(w: str = "w", c: str = "c", t: str = "t", name: str = "linear") -> str:
    """CTE ``lev(id, space_id, energy, leverage)``."""
    return f"""lev AS MATERIALIZED (SELECT c.id, c.space_id, any_value({kernel('t.x', 't.x', name)})
        AS k_norm, sum(list_inner_product(w.w, c.kv) ** 2) AS energy,
        any_value({kernel('t.x', 't.x', name)}) - sum(list_inner_product(w.w, c.kv) ** 2) AS leverage
        FROM {c} c JOIN {w} w ON w.space_id = c.space_id JOIN {t} t ON t.id = c.id
        GROUP BY c.id, c.space_id)"""


def primal_ctes(lam: str, sp: str, out: str, dim: int = 4) -> str:
    """CTE ``out(space_id, i, w)``: rows of chol(I + X' (lambda P)^-1 X)^-1.

    leverage(y) is the sum over i of (w_i . y)^2.
    """
    return f"""{out}_p AS (SELECT space_id, i, j, sum(x[i] * x[j] / (({lam}) * greatest(reg, 1e-12)))
            + CASE WHEN i = j THEN 1 ELSE 0 END AS v
        FROM {sp}, (SELECT unnest(range(1, {dim + 1})) AS i) ri, (SELECT unnest(range(1, {dim + 1})) AS j) rj
        GROUP BY space_id, i, j),
    {out}_g AS (SELECT space_id, i, list(v ORDER BY j) AS g FROM {out}_p GROUP BY space_id, i),
    {inverse_root_ctes(f'{out}_g', out)}"""


def min_leverage(t: str, w: str) -> str:
    """SELECT of ``id, x`` and the smallest (primal) leverage ``ml`` of each row.

    Row by row, without grouping: a table may repeat an id.
    """
    return f"""SELECT t.id, t.x, list_min(list_transform(ws, lambda m: list_sum(
        list_transform(m, lambda r: list_inner_product(r, t.x) ** 2)))) AS ml
        FROM {t} t, (SELECT list(wm) AS ws FROM (
        SELECT list(w ORDER BY i) AS wm FROM {w} GROUP BY space_id))"""


def r6(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"
