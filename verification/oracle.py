"""The SQL each registered query is checked against, for DuckDB.

The SQL shares no code with the library: matrices are inverted by elimination
in a recursive CTE, landmarks are ranked by window functions, and leverages of
the selection rounds come from the feature-space form of the inverse.
"""

from __future__ import annotations

from verification import queries as Q
from verification import relations as R
from verification.relations import r6

SQL: dict[str, str] = {}

#: rounds a selection loop is unrolled to; it must have stopped by then
UNROLLED = 40
#: nested levels a halving may have: enough for a billion rows
DEEPEST = 24


def over(name: str, body: str, *ctes: str) -> str:
    """A statement over the table ``name`` as ``t``, with more CTEs before the body."""
    return "WITH RECURSIVE " + ",\n    ".join([R.table_ctes(name), *ctes]) + f"\n{body}"


def exploded(array: str, *keys: str, source: str = "t", digits: int = 6) -> str:
    head = "".join(f"{k}, " for k in keys)
    return (
        f"SELECT {head}pos - 1 AS pos, {r6('v', digits)} AS value FROM (SELECT {head}"
        f"unnest(y) AS v, generate_subscripts(y, 1) AS pos"
        f" FROM (SELECT {head}{array} AS y FROM {source}))"
    )


SPACES = R.space_ctes()
LEVERAGES = [SPACES, R.dual_ctes(), R.cross_ctes(), R.leverage_ctes()]
MIN_SCORES = [
    *LEVERAGES,
    "ml AS MATERIALIZED (SELECT id, min(leverage) AS score FROM lev GROUP BY id)",
]

# ------------------------------------------------------------ sources and sinks

SQL["scan_labeled_csv"] = over(
    "lineitem",
    """SELECT label, 4::BIGINT AS dim, x[1] AS x0, x[2] AS x1, x[3] AS x2, x[4] AS x3,
    count(*) AS n_rows FROM t GROUP BY ALL""",
)
SQL["drop_header_rows"] = over(
    "lineitem",
    "SELECT label || '.0' AS label_text, count(*) AS n_rows FROM t GROUP BY label",
)
SQL["scan_parquet_vectors"] = over("vectors", exploded("x", "id", "label"))
SQL["sink_parquet_vectors"] = over("events_raw", exploded("x", "id", "label"))
_split = R.uniform("split", 0)
SQL["combine_splits"] = over(
    "vectors",
    f"""SELECT id, label, CASE WHEN {_split} < 0.7 THEN 'train' WHEN {_split} < 0.8
    THEN 'valid' ELSE 'test' END AS split, CAST(len(x) AS INTEGER) AS dim FROM t""",
)

# ------------------------------------------------------------ projections, filters

SQL["select_struct_fields"] = over(
    "events", f"SELECT id, label, {r6('x[1]')} AS first FROM t"
)
SQL["assign_row_id"] = "SELECT count(*) AS n_rows, count(*) AS n_ids FROM lineitem"
SQL["vector_dim"] = """SELECT CAST(min(len(embedding)) AS INTEGER) AS min_dim,
    CAST(max(len(embedding)) AS INTEGER) AS max_dim, 'embeddings' AS relation FROM embeddings
    UNION ALL SELECT 4::INTEGER, 4::INTEGER, 'lineitem'
    WHERE EXISTS (SELECT 1 FROM lineitem)"""
SQL["filter_by_ids"] = over(
    "events", "SELECT id, label FROM t WHERE id IN (SELECT id FROM sp)", SPACES
)
SQL["cap_to_one"] = over(
    "events",
    f"""SELECT id, {r6(f'least({Q.SCORE_FACTOR} * sqrt(list_inner_product(x, x)), 1.0)')}
    AS capped FROM t""",
)
SQL["scale_scores"] = over(
    "events", f"SELECT id, {r6(f'score * (1.5 / {R.LAMBDA})')} AS score FROM ml", *MIN_SCORES
)
_probable = "p AS (SELECT id, score * 10.0 AS score FROM ml)"
SQL["bernoulli_by_score"] = over(
    "events",
    f"""SELECT id, {r6('score')} AS score FROM p
    WHERE {R.uniform(R.SEED, 7)} <= least(score, 1.0)""",
    *MIN_SCORES,
    _probable,
)
SQL["bernoulli_two_stage"] = over(
    "events",
    f"""SELECT id, {r6('score')} AS score FROM p
    WHERE {R.uniform(f'{R.SEED}/stage', 7)} < {Q.SAMPLE_SHARE}
    AND {R.uniform(R.SEED, 7)} * {Q.SAMPLE_SHARE} <= score""",
    *MIN_SCORES,
    _probable,
)
SQL["bernoulli_by_scaled_score"] = over(
    "events",
    f"""SELECT id, {r6('score')} AS score FROM ml
    WHERE {R.uniform(R.SEED, 7)} < score * ln((SELECT sum(score) FROM ml) / 0.1)""",
    *MIN_SCORES,
)
SQL["sample_fraction"] = over(
    "lineitem", f"SELECT id FROM t WHERE {R.uniform(R.SEED, 3)} < {Q.SAMPLE_SHARE}"
)


def _levels(seed_round: str, n_levels: int) -> str:
    return "CAST(" + " + ".join(
        f"CAST({seed_round} < {0.5 ** (i + 1)!r} AS INTEGER)" for i in range(n_levels)
    ) + " AS INTEGER)"


SQL["nested_bernoulli_levels"] = over(
    "lineitem", f"SELECT id, {_levels(R.uniform(R.SEED, 0), Q.LEVELS)} AS level FROM t"
)
SQL["level_filter"] = (
    f"SELECT * FROM ({SQL['nested_bernoulli_levels']}) WHERE level > 2"
)

# ------------------------------------------------------------ joins

SQL["landmark_cross_join"] = over(
    "vectors",
    "SELECT t.id, space_id, ord::INTEGER AS ord, sp.id AS landmark_id FROM t CROSS JOIN sp",
    SPACES,
)
SQL["landmark_semi_join"] = over(
    "events", "SELECT space_id, ord::INTEGER AS ord, t.id, t.label FROM t JOIN sp ON sp.id = t.id", SPACES
)
SQL["align_labels_to_landmarks"] = over(
    "events",
    f"SELECT space_id, ord AS pos, {r6('t.label::DOUBLE')} AS value FROM t JOIN sp ON sp.id = t.id",
    SPACES,
)

# ------------------------------------------------------------ aggregates


def _positions(name: str, aggregate: str, digits: int = 6) -> str:
    return over(
        name,
        f"""SELECT pos - 1 AS pos, {r6(aggregate, digits)} AS value FROM (
        SELECT unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM t) GROUP BY pos""",
    )


SQL["vec_sum"] = _positions("lineitem", "sum(v)", 2)
SQL["vec_sum_packed"] = _positions("events", "sum(v)")
SQL["vec_mean"] = _positions("lineitem", "avg(v)")
SQL["vec_var"] = _positions("lineitem", "var_pop(v)", 2)
SQL["vec_var_wide"] = _positions("vectors", "var_pop(v)", 9)
SQL["row_count"] = "SELECT count(*) AS n_rows FROM lineitem"
SQL["label_histogram"] = over(
    "events",
    "SELECT label, count(*) AS n_rows FROM t WHERE id IN (SELECT id FROM sp) GROUP BY label",
    SPACES,
)
SQL["collect_by_label"] = over(
    "events",
    f"""SELECT label, block, label_rows,
    row_number() OVER (PARTITION BY label, block ORDER BY id) - 1 AS pos, id,
    x0, x1, x2, x3 FROM (
    SELECT label, id, label_rows, {', '.join(f"{r6(f'x[{i + 1}]')} AS x{i}" for i in range(4))},
    CAST(floor({R.uniform('pack', 0)} * ceil(label_rows / 500.0::DOUBLE)) AS BIGINT) AS block
    FROM (SELECT *, count(*) OVER (PARTITION BY label) AS label_rows FROM t))""",
)
SQL["total_leverage"] = over(
    "events", f"SELECT {r6('sum(score)', 5)} AS total_leverage FROM ml", *MIN_SCORES
)
_std_lineitem = """moments AS (SELECT pos, avg(v) AS mu, sqrt(var_pop(v)) AS sd FROM (
        SELECT unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM t) GROUP BY pos),
    scaling AS (SELECT list(mu ORDER BY pos) AS mu, list(sd ORDER BY pos) AS sd FROM moments),
    z AS MATERIALIZED (SELECT id, label,
        list_transform(x, lambda v, i: (v - mu[i]) / sd[i]) AS x FROM t, scaling)"""
_lineitem_min = over(
    "lineitem",
    "{body}",
    _std_lineitem,
    R.space_ctes().replace("FROM t)", "FROM z)"),
    R.primal_ctes(str(R.LAMBDA), "sp", "w"),
    f"ml AS (SELECT id, ml AS score FROM ({R.min_leverage('z', 'w')}))",
)
SQL["total_leverage_lineitem"] = _lineitem_min.replace(
    "{body}", f"SELECT {r6('sum(score)', 4)} AS total_leverage FROM ml"
)
SQL["leverage_min_lineitem"] = _lineitem_min.replace(
    "{body}", f"SELECT id, {r6('score')} AS leverage FROM ml"
)
SQL["mean_leverage"] = over(
    "events", f"SELECT {r6('avg(score)')} AS mean_leverage FROM ml", *MIN_SCORES
)
SQL["score_describe"] = over(
    "events",
    f"""SELECT count(score) AS n, {r6('avg(score)')} AS mean, {r6('stddev_samp(score)')} AS stddev,
    {r6('min(score)')} AS min, {r6('max(score)')} AS max FROM ml""",
    *MIN_SCORES,
)
_DECILES = f"""SELECT p / 10.0::DOUBLE AS probability, {r6('score')} AS value
    FROM (SELECT unnest(range(0, 11)) AS p) JOIN (
        SELECT score, row_number() OVER (ORDER BY score) AS rn, count(*) OVER () AS n FROM ml)
    ON rn = greatest(1, -(-p * n // 10))"""
SQL["score_quantiles"] = over("events", _DECILES, *MIN_SCORES)
SQL["space_sizes"] = over(
    "events", "SELECT space_id, count(*) AS n_landmarks FROM sp GROUP BY space_id", SPACES
)

# ------------------------------------------------------------ sorts and set operations

for _name, _direction in (("topk_by_score", "DESC"), ("bottomk_by_score", "ASC")):
    SQL[_name] = over(
        "events",
        f"""SELECT id, {r6('score')} AS score FROM ml
        ORDER BY round(score, 9) {_direction}, id LIMIT {Q.TOP_K}""",
        *MIN_SCORES,
    )
SQL["landmark_union"] = over(
    "events",
    """SELECT space_id, ord::INTEGER AS ord, id FROM sp WHERE space_id < 2
    UNION ALL SELECT space_id, ord::INTEGER AS ord, id FROM sp WHERE space_id > 0""",
    SPACES,
)
SQL["chosen_ids_union"] = over("events", "SELECT DISTINCT id FROM sp", SPACES)

# ------------------------------------------------------------ vector functions

SQL["vec_norm_sqr"] = over("events", f"SELECT id, {r6('list_inner_product(x, x)')} AS norm_sqr FROM t")
SQL["vec_norm"] = over("events", f"SELECT id, {r6('sqrt(list_inner_product(x, x))')} AS norm FROM t")


def _mapped(body: str, name: str = "events", digits: int = 6) -> str:
    return over(name, exploded(f"list_transform(x, lambda v, i: {body})", "id", digits=digits))


SQL["vec_normalize"] = _mapped("v / sqrt(list_inner_product(x, x))")
SQL["vec_add_vec"] = _mapped(f"v + {Q.OFFSETS}[i]")
SQL["vec_mul_vec"] = _mapped(f"v * {Q.OFFSETS}[i]")
SQL["vec_div_vec"] = _mapped(f"v / {Q.OFFSETS}[i]")
SQL["vec_add_scalar"] = _mapped("v + 1.25")
SQL["vec_mul_scalar"] = _mapped("v * -3.0")
SQL["vec_div_scalar"] = _mapped("v / 7.0")
SQL["vec_square"] = _mapped("v * v")
SQL["vec_reciprocal"] = _mapped("CASE WHEN v <> 0 THEN 1 / v END", "events_raw")
SQL["split_array"] = over(
    "vectors",
    f"""SELECT id, (pos - 1) // 8 AS slice, (pos - 1) % 8 AS pos, {r6('v')} AS value FROM (
    SELECT id, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM t)""",
)
SQL["standardize"] = over("lineitem", exploded("x", "id", source="z"), _std_lineitem)
SQL["standardize_by_variance"] = over(
    "events_raw",
    exploded("list_transform(x, lambda v, i: (v - mu[i]) / (sd[i] * sd[i]))", "id", source="z", digits=9),
    _std_lineitem.replace(
        "list_transform(x, lambda v, i: (v - mu[i]) / sd[i]) AS x", "x, mu, sd"
    ),
)
_pixels = """px AS (SELECT id, (pos - 1) // 8 AS r, (pos - 1) % 8 AS c, v FROM (
        SELECT id, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM t))"""
SQL["max_pool"] = over(
    "vectors",
    f"""SELECT id, i * 2 + j AS pos, {r6('max(v)')} AS value
    FROM px, (SELECT unnest(range(0, 2)) AS i) wi, (SELECT unnest(range(0, 2)) AS j) wj
    WHERE r BETWEEN 2 * i AND 2 * i + 2 AND c BETWEEN 2 * j AND 2 * j + 2 GROUP BY id, i, j""",
    _pixels,
)
SQL["avg_pool_normalize"] = over(
    "vectors",
    f"""SELECT id, pos, {r6('v / sqrt(sum(v * v) OVER (PARTITION BY id))')} AS value FROM (
    SELECT id, (r // 2) * 4 + c // 2 AS pos, avg(v) AS v FROM px GROUP BY 1, 2)""",
    _pixels,
)

# ------------------------------------------------------------ packing

_packed = f"""packed AS MATERIALIZED (SELECT *,
        row_number() OVER (PARTITION BY pack_id ORDER BY id) - 1 AS pos,
        count(*) OVER (PARTITION BY pack_id) AS cols FROM (
        SELECT id, x, CAST(floor({R.uniform('pack', 0)} * n_packs) AS BIGINT) AS pack_id
        FROM t, (SELECT greatest(1, ceil(count(*) / {Q.PACK_SIZE}.0)) AS n_packs FROM t)))"""
SQL["repartition_by_size"] = """SELECT count(*) AS n_rows, count(*) // 5000 + 1 AS n_partitions
    FROM lineitem"""
SQL["pack_vectors"] = over(
    "events",
    f"""SELECT pack_id, cols, pos, id, d - 1 AS dim, {r6('v')} AS value FROM (
    SELECT *, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM packed)""",
    _packed,
)
SQL["unpack_vectors"] = over(
    "events",
    f"""SELECT id, {', '.join(f"{r6(f'x[{i + 1}]')} AS x{i}" for i in range(4))},
    {r6('list_inner_product(x, x)')} AS k_norm FROM t""",
)
SQL["explode_scores"] = over(
    "events", f"SELECT {r6('list_inner_product(x, x)')} AS score FROM t"
)

# ------------------------------------------------------------ kernels


def _crosses(name: str, kernel: str) -> str:
    return over(
        name,
        f"""SELECT t.id, space_id, ord::INTEGER AS ord, {r6(R.kernel('sp.x', 't.x', kernel))} AS k
        FROM t CROSS JOIN sp""",
        SPACES,
    )


SQL["kernel_linear"] = _crosses("events", "linear")
SQL["kernel_cosine"] = _crosses("events", "cosine")
SQL["kernel_rbf"] = _crosses("events", "rbf")
SQL["kernel_crosses"] = _crosses("vectors", "linear")
SQL["kernel_norm"] = over("events", f"SELECT id, {r6('list_inner_product(x, x)')} AS k_norm FROM t")
SQL["kernel_norms_packed"] = over(
    "events",
    f"SELECT pack_id, pos, {r6('list_inner_product(x, x)')} AS value FROM packed",
    _packed,
)
SQL["kernel_cross"] = over(
    "vectors",
    f"""SELECT t.id, space_id * {R.LANDMARKS} + ord AS pos,
    {r6(R.kernel('sp.x', 't.x'))} AS value FROM t CROSS JOIN sp""",
    SPACES,
)
SQL["kernel_top"] = over(
    "events",
    f"""SELECT id, rank::INTEGER AS rank, space_id, ord::INTEGER AS ord, landmark_id, {r6('k')} AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(k, 9) DESC, space_id, ord) AS rank FROM (
            SELECT n.row_id, n.id, space_id, ord, sp.id AS landmark_id, {R.kernel('sp.x', 'n.x', 'rbf')} AS k
            FROM (SELECT row_number() OVER () AS row_id, id, x FROM t) n, sp))
    WHERE rank <= {Q.NEAREST}""",
    SPACES,
)
SQL["vec_normalize_packed"] = over(
    "events",
    f"""SELECT pack_id, pos * 4 + d - 1 AS pos, {r6('v')} AS value FROM (
        SELECT pack_id, pos, unnest(y) AS v, generate_subscripts(y, 1) AS d FROM (
        SELECT pack_id, pos, list_transform(x, lambda v: v / sqrt(list_inner_product(x, x))) AS y FROM packed))""",
    _packed.replace(f"{Q.PACK_SIZE}.0", f"{Q.SMALL_PACK}.0"),
)
SQL["kernel_gram"] = over(
    "vectors",
    f"""SELECT a.space_id, a.ord AS i, b.ord AS j, {r6(R.kernel('a.x', 'b.x'))} AS k
    FROM sp a JOIN sp b ON a.space_id = b.space_id""",
    SPACES,
)


def _inverse(w: str, key: str = "space_id", label: str = "space_id") -> str:
    """G^-1 = W'W from the rows of W."""
    return f"""SELECT {key} AS {label}, i2 - 1 AS i, j2 - 1 AS j, {r6('sum(wi * wj)')} AS g_inv FROM (
        SELECT {key}, unnest(w) AS wi, generate_subscripts(w, 1) AS i2, w FROM {w}),
        LATERAL (SELECT unnest(w) AS wj, generate_subscripts(w, 1) AS j2) GROUP BY 1, 2, 3"""


SQL["fit_subspace"] = over("vectors", _inverse("w"), SPACES, R.dual_ctes())
SQL["fit_subspace_pinv"] = SQL["fit_subspace"]
SQL["fit_subspace_tiled"] = SQL["fit_subspace"]


def _projections(name: str, pos: str, spaces: str, kernel: str = "linear") -> str:
    return over(
        name,
        f"""SELECT c.id, {pos} AS pos, {r6('list_inner_product(w.w, c.kv)')} AS value
        FROM c JOIN w ON w.space_id = c.space_id""",
        R.space_ctes(),
        f"s2 AS (SELECT * FROM sp WHERE {spaces})",
        R.dual_ctes(sp="s2", name=kernel),
        R.cross_ctes(sp="s2", name=kernel),
    )


SQL["kernel_proj"] = _projections("events", "w.i - 1", "space_id = 0")
SQL["kernel_projs"] = _projections("vectors", "w.i - 1", "space_id = 0", "rbf")
SQL["kernel_proj_spaces"] = _projections(
    "vectors", f"c.space_id * {R.LANDMARKS} + w.i - 1", "true"
)


def _one_leverage(name: str, kernel: str = "linear") -> str:
    return over(
        name,
        f"SELECT id, {r6('leverage')} AS leverage FROM lev",
        R.space_ctes(),
        "s2 AS (SELECT * FROM sp WHERE space_id = 1)",
        R.dual_ctes(sp="s2", name=kernel),
        R.cross_ctes(sp="s2", name=kernel),
        R.leverage_ctes(name=kernel),
    )


SQL["leverage"] = _one_leverage("vectors")
SQL["leverage_block"] = _one_leverage("events")
SQL["leverage_pinv"] = _one_leverage("vectors")
SQL["leverage_rbf"] = _one_leverage("events", "rbf")
SQL["leverage_poly"] = _one_leverage("events", "poly")
SQL["leverage_custom"] = _one_leverage("events", "custom")
SQL["leverage_tiled_rbf"] = over(
    "events",
    f"SELECT id, {r6('min(leverage)')} AS leverage FROM lev GROUP BY id",
    R.space_ctes(),
    R.dual_ctes(name="rbf"),
    R.cross_ctes(name="rbf"),
    R.leverage_ctes(name="rbf"),
)
# a landmark that is there twice spans what it spans once
SQL["leverage_pinv_deficient"] = over(
    "vectors",
    f"SELECT id, {r6('leverage')} AS leverage FROM lev",
    R.space_ctes(),
    "s2 AS (SELECT * FROM sp WHERE space_id = 1)",
    R.dual_ctes("0.0", sp="s2"),
    R.cross_ctes(sp="s2"),
    R.leverage_ctes(),
)
SQL["leverage_cosine"] = _one_leverage("events", "cosine")
SQL["leverage_pseudo"] = over(
    "events",
    f"SELECT id, {r6('any_value(k_norm) - sum(energy)')} AS leverage FROM lev GROUP BY id",
    *LEVERAGES,
)
SQL["leverage_min"] = over(
    "events", f"SELECT id, {r6('score')} AS leverage FROM ml", *MIN_SCORES
)
SQL["leverage_min_packed"] = over(
    "events",
    f"SELECT pack_id, pos, {r6('score')} AS value FROM packed JOIN ml USING (id)",
    *MIN_SCORES,
    _packed,
)
SQL["cross_leverage_matrix"] = over(
    "events",
    f"""SELECT lev.space_id AS model_id, sp.space_id, {r6('sum(leverage)')} AS total_leverage
    FROM sp JOIN lev ON lev.id = sp.id GROUP BY 1, 2""",
    *LEVERAGES,
)

# ------------------------------------------------------------ collections


def _collection(slots: dict[int, int], lam: float = R.LAMBDA) -> str:
    """A collection whose slot k holds the sample slots[k]."""
    arms = " ".join(f"WHEN {sample} THEN {slot}" for slot, sample in slots.items())
    members = ", ".join(str(sample) for sample in slots.values())
    return over(
        "events",
        f"""SELECT space_id, ord::INTEGER AS ord, id, (SELECT {r6('sum(l)', 5)} FROM
        (SELECT min(leverage) AS l FROM lev GROUP BY id)) AS total_leverage FROM s2""",
        R.space_ctes(),
        f"""s2 AS (SELECT CASE space_id {arms} END AS space_id, ord, id, x, reg
        FROM sp WHERE space_id IN ({members}))""",
        R.dual_ctes(str(lam), sp="s2"),
        R.cross_ctes(sp="s2"),
        R.leverage_ctes(),
    )


SQL["spaces_create"] = _collection({0: 0})
SQL["space_update"] = _collection({0: 2}, 0.5)
SQL["spaces_append"] = _collection({0: 0, 1: 1, 2: 2})
SQL["spaces_append_circular"] = _collection({0: 2, 1: 1})
SQL["spaces_remove"] = _collection({0: 2, 1: 1})
SQL["spaces_update_lambda"] = _collection({0: 0, 1: 1, 2: 2}, 0.5)
def _totals(lam: float) -> str:
    return over(
        "events",
        f"""SELECT {lam}::DOUBLE AS lambda, {r6('sum(l)', 5)} AS total_leverage FROM
        (SELECT min(leverage) AS l FROM lev GROUP BY id)""",
        R.space_ctes(),
        R.dual_ctes(str(lam)),
        R.cross_ctes(),
        R.leverage_ctes(),
    )


SQL["spaces_update_lambda_dual"] = f"({_totals(0.5)}) UNION ALL ({_totals(R.LAMBDA)})"
SQL["spaces_describe"] = over(
    "events",
    f"""SELECT space_id, count(*) OVER (PARTITION BY space_id) AS m, {R.LAMBDA}::DOUBLE AS lambda,
    ord AS pos, id, reg FROM sp""",
    SPACES,
)

# ------------------------------------------------------------ selection


def _drawn(
    scored: str, out: str, round_no: int, rows: int, beta: str | None = None, order: str = "DESC"
) -> str:
    """Sample ``scored(id, x, score)`` and keep the best rows, as ``out``."""
    coin = R.uniform(R.SEED, round_no)
    if beta is None:
        accept = f"{coin} <= least(score, 1.0)"
    else:
        stage = R.uniform(f"{R.SEED}/stage", round_no)
        accept = f"{stage} < {beta} AND {coin} * {beta} <= score"
    return f"""{out} AS MATERIALIZED (SELECT rn - 1 AS ord, id, x, least(score, 1.0) AS reg FROM (
        SELECT *, row_number() OVER (ORDER BY round(score, 9) {order}, {coin}, id) AS rn
        FROM {scored} WHERE {accept}) WHERE rn <= {rows})"""


def _collected(slots: dict[int, str], out: str) -> str:
    """The landmark table of samples placed in slots."""
    return f"{out} AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT {slot} AS space_id, ord, id, x, reg FROM {sample}"
        for slot, sample in slots.items()
    ) + ")"


def _spaces_loop(dim: int) -> tuple[list[str], list[tuple]]:
    """CTEs of all rounds, and per round (lambda, sample, slots, total).

    ``b<i>`` holds the best round so far and the count of misses; once these reach
    the limit it only passes on what it has, whatever later rounds give.
    """
    n = "(SELECT count(*) FROM t)"
    ctes = [
        f"h AS (SELECT greatest(1, CAST(floor(ln({n}) / ln(2)) AS INTEGER)) AS hn)",
        f"f AS (SELECT ln(12 * hn * {n} / 0.9) AS factor FROM h)",
        "q0 AS (SELECT id, x, list_inner_product(x, x) * factor AS score FROM t, f)",
        _drawn("q0", "d0", 0, Q.SELECT_ROWS),
    ]
    rounds = []
    for i in range(UNROLLED):
        lam = f"(SELECT 1.0::DOUBLE / 2 ** least({i}, hn - 1) FROM h)"
        if i:
            gone, last = (i - 1) % (Q.SELECT_SPACES - 1), Q.SELECT_SPACES - 1
            full = f"(SELECT max(space_id) = {last} FROM s{i - 1})"
            drawn = f"(SELECT count(*) > 0 FROM d{i})"
            ctes += [
                # a full collection frees a slot, into which its last one moves
                f"""p{i} AS MATERIALIZED (SELECT CASE WHEN space_id = {last} THEN {gone} ELSE space_id END
                AS space_id, ord, id, x, reg FROM s{i - 1} WHERE NOT ({full} AND space_id = {gone}))""",
                R.primal_ctes(lam, f"p{i}", f"pw{i}", dim),
                f"""q{i} AS (SELECT id, x, ml * factor AS score
                FROM ({R.min_leverage('t', f'pw{i}')}), f)""",
                _drawn(f"q{i}", f"d{i}", i, Q.SELECT_ROWS),
                # an empty draw leaves the collection as it was
                f"""s{i} AS MATERIALIZED (SELECT * FROM p{i} WHERE {drawn} UNION ALL
                SELECT (SELECT max(space_id) + 1 FROM p{i}), ord, id, x, reg FROM d{i} UNION ALL
                SELECT * FROM s{i - 1} WHERE NOT {drawn})""",
            ]
        else:
            ctes.append(_collected({0: "d0"}, "s0"))
        ctes += [
            R.primal_ctes(lam, f"s{i}", f"w{i}", dim),
            f"l{i} AS MATERIALIZED (SELECT sum(ml) AS total FROM ({R.min_leverage('t', f'w{i}')}))",
        ]
        rounds.append((lam, f"d{i}", f"s{i}", f"l{i}"))
    ctes.append("b0 AS MATERIALIZED (SELECT 0 AS best, total, true AS hit, 0 AS misses, true AS ran FROM l0)")
    for i in range(1, UNROLLED):
        going = f"b.misses < {Q.SELECT_MISSES}"
        better = f"l.total - b.total < -1 AND (SELECT count(*) > 0 FROM d{i})"
        ctes.append(
            f"""b{i} AS MATERIALIZED (SELECT CASE WHEN {going} AND {better} THEN {i} ELSE b.best END AS best,
            CASE WHEN {going} AND {better} THEN l.total ELSE b.total END AS total,
            ({better}) AS hit,
            CASE WHEN NOT {going} THEN b.misses WHEN {better} THEN greatest(0, b.misses - 1)
                ELSE b.misses + 1 END AS misses,
            {going} AS ran FROM l{i} l, b{i - 1} b)"""
        )
    return ctes, rounds


def _spaces_sql(name: str, dim: int) -> str:
    loop, rounds = _spaces_loop(dim)
    return over(
        name,
        " UNION ALL ".join(
            f"""SELECT space_id, ord::INTEGER AS ord, id, {r6('reg')} AS reg FROM {s}
            WHERE (SELECT best FROM b{UNROLLED - 1} WHERE misses >= {Q.SELECT_MISSES}) = {i}"""
            for i, (_, _, s, _) in enumerate(rounds)
        ),
        *loop,
    )


SQL["nystrom_spaces"] = _spaces_sql("events", 4)
SQL["nystrom_spaces_packed"] = SQL["nystrom_spaces"]
SQL["nystrom_spaces_full"] = _spaces_sql("vectors", 64)
_loop, _rounds = _spaces_loop(4)
SQL["nystrom_spaces_history"] = over(
    "events",
    " UNION ALL ".join(
        f"""SELECT {i} AS round, {r6(lam, 9)} AS lambda, (SELECT count(*) FROM {d}) AS n_landmarks,
        {r6(f'(SELECT total FROM {total})', 4)} AS total_leverage,
        hit AS is_best FROM b{i} WHERE ran"""
        for i, (lam, d, _, total) in enumerate(_rounds)
    ),
    *_loop,
)


def _bless_loop() -> tuple[list[str], list[tuple]]:
    n = "(SELECT count(*) FROM t)"
    ctes = [
        f"h AS (SELECT CAST(floor(ln(sqrt({n}) / 0.3) / ln(1.5)) AS INTEGER) AS hn)",
        f"f AS (SELECT 54 * ((2 + 0.3 * 0.3) / (0.3 * 0.3)) * ln(12 * hn * {n} / 0.9) AS factor FROM h)",
        "q0 AS (SELECT id, x, least(list_inner_product(x, x) * factor, 1.0) AS score FROM t, f)",
    ]
    rounds = []
    for i in range(UNROLLED):
        lam = f"(1 / 0.3::DOUBLE / 1.5::DOUBLE ** {i})"
        beta = f"(SELECT least(factor / ({lam} * {n}), 1.0) FROM f)"
        ctes += [
            _drawn(f"q{i}", f"d{i}", i, Q.BLESS_ROWS, beta, "ASC" if i == 0 else "DESC"),
            _collected({0: f"d{i}"}, f"s{i}"),
            R.primal_ctes(f"{lam} * {n}", f"s{i}", f"w{i}"),
            f"m{i} AS MATERIALIZED ({R.min_leverage('t', f'w{i}')})",
            f"q{i + 1} AS (SELECT id, x, least(ml * factor, 1.0) AS score FROM m{i}, f)",
        ]
        rounds.append((lam, f"d{i}", f"s{i}", f"m{i}"))
    return ctes, rounds


_bless, _bless_rounds = _bless_loop()
SQL["nystrom_bless"] = over(
    "events",
    " UNION ALL ".join(
        f"""SELECT space_id, ord::INTEGER AS ord, id, {r6('reg')} AS reg FROM {s}
        WHERE (SELECT hn FROM h) = {i + 1}"""
        for i, (_, _, s, _) in enumerate(_bless_rounds)
    ),
    *_bless,
)
SQL["nystrom_bless_history"] = over(
    "events",
    " UNION ALL ".join(
        f"""SELECT {i} AS round, {r6(lam, 9)} AS lambda, (SELECT count(*) FROM {d}) AS n_landmarks,
        {r6(f'(SELECT sum(ml) FROM {m})', 4)} AS total_leverage, true AS is_best
        FROM h WHERE {i} < hn"""
        for i, (lam, d, _, m) in enumerate(_bless_rounds)
    ),
    *_bless,
)

#: rows with unit length: the cosine kernel is then the linear one
UNIT = """u AS MATERIALIZED (SELECT id, list_transform(x, lambda v:
        v / sqrt(list_inner_product(x, x))) AS x FROM t)"""


#: (1 + x.y)^2 of unit vectors of four numbers as products of fifteen features
POLY = """u AS MATERIALIZED (SELECT id, list_concat([1.0::DOUBLE], list_concat(
        list_transform(z, lambda v: sqrt(2) * v), list_concat(list_transform(z, lambda v: v * v),
        [sqrt(2) * z[1] * z[2], sqrt(2) * z[1] * z[3], sqrt(2) * z[1] * z[4],
         sqrt(2) * z[2] * z[3], sqrt(2) * z[2] * z[4], sqrt(2) * z[3] * z[4]]))) AS x
    FROM (SELECT id, list_transform(x, lambda v: v / sqrt(list_inner_product(x, x))) AS z FROM t))"""


def _scaled(landmarks: str, source: str, out: str, dim: int) -> list[str]:
    return [
        R.primal_ctes("0.01", landmarks, f"w_{out}", dim),
        f"""{out} AS MATERIALIZED (SELECT id, x, ml * 150.0 AS score
        FROM ({R.min_leverage(source, f'w_{out}')}))""",
    ]


def _halving_ctes(features: str = UNIT, dim: int = 4) -> list[str]:
    """Levels and deltas of every depth the table may have, up to ``DEEPEST``.

    Rounds beyond the table's own depth start from the same base set and add
    nothing, because their level is empty of candidates.
    """
    deepest = DEEPEST
    steps = []
    for level in range(1, deepest + 1):
        share = 0.5**level
        delta = f"(0.1 / 3.0::DOUBLE ** {level - 1})"
        steps.append(
            f"""CASE WHEN n * {share!r} + sqrt(2 * {share!r} * {1 - share!r} * n * ln(ln(n)))
            <= -192 * ln({delta}) THEN {level} END"""
        )
    u = R.uniform(R.SEED, 0)
    ctes = [
        features,
        f"depth AS (SELECT coalesce({', '.join(steps)}) AS n_levels FROM (SELECT count(*) AS n FROM t))",
        f"""s0 AS MATERIALIZED (SELECT 0 AS space_id, 0 AS ord, id, x, 1.0::DOUBLE AS reg
        FROM u, depth WHERE {u} < 0.5::DOUBLE ** n_levels)""",
    ]
    for r in range(1, deepest + 1):
        # round r scores the rows of level index n_levels - 1 - r, the last one all rows
        ctes += [
            f"""u{r} AS (SELECT id, x FROM u, depth WHERE r_ok AND (whole OR {u} < 0.5::DOUBLE ** (n_levels - {r})))
            """.replace("r_ok", f"{r} <= n_levels").replace("whole", f"{r} = n_levels"),
            *_scaled(f"s{r - 1}", f"u{r}", f"l{r}", dim),
            f"""s{r} AS MATERIALIZED (SELECT * FROM s{r - 1} UNION ALL
            SELECT 0, {r}, id, x, 1.0 FROM l{r}, depth WHERE {R.uniform(R.SEED, r)} < score
            * ln((SELECT sum(score) FROM l{r}) / (0.1 / 3.0::DOUBLE ** (n_levels - 1) * 3.0::DOUBLE ** {r})))""",
        ]
    return ctes


SQL["nystrom_halving"] = over("events", f"SELECT ord, id FROM s{DEEPEST}", *_halving_ctes())


def _refine_ctes(rounds: int = Q.REFINE_ROUNDS, features: str = UNIT, dim: int = 4) -> list[str]:
    """The rounds after a halving: ``r<i>`` holds the landmarks after i of them."""
    ctes = [*_halving_ctes(features, dim), f"r0 AS (SELECT * FROM s{DEEPEST})"]
    for i in range(rounds):
        ctes += [
            *_scaled(f"r{i}", "u", f"x{i}", dim),
            f"""r{i + 1} AS MATERIALIZED (SELECT * FROM r{i} UNION ALL
            SELECT 0, {1000 + i}, id, x, 1.0 FROM x{i} WHERE {R.uniform(R.SEED, 1000 + i)} < score)""",
        ]
    return ctes


SQL["nystrom_refine"] = over(
    "events", f"SELECT ord::INTEGER AS ord, id FROM r{Q.REFINE_ROUNDS}", *_refine_ctes()
)

SQL["nystrom_halving_poly"] = over("events", f"SELECT ord, id FROM s{DEEPEST}", *_halving_ctes(POLY, 15))
SQL["nystrom_refine_poly"] = over(
    "events", f"SELECT ord::INTEGER AS ord, id FROM r{Q.POLY_ROUNDS}", *_refine_ctes(Q.POLY_ROUNDS, POLY, 15)
)

_refined_scores = [
    *_refine_ctes(),
    R.primal_ctes("0.01", f"r{Q.REFINE_ROUNDS}", "wz"),
    f"ml AS MATERIALIZED (SELECT id, ml AS score FROM ({R.min_leverage('u', 'wz')}))",
]
SQL["refined_leverage_describe"] = over(
    "events",
    f"""SELECT count(score) AS n, {r6('avg(score)')} AS mean, {r6('stddev_samp(score)')} AS stddev,
    {r6('min(score)')} AS min, {r6('max(score)')} AS max FROM ml""",
    *_refined_scores,
)
SQL["refined_leverage_quantiles"] = over("events", _DECILES, *_refined_scores)

# ------------------------------------------------------------ models


def _class_ctes(spaces: str | None = None) -> list[str]:
    """Class subspaces of the rows in ``sp``; ``lev`` then holds one row per label."""
    return [
        spaces or R.space_ctes(),
        """chosen AS MATERIALIZED (SELECT label AS space_id,
        row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS ord, id, x, 1.0::DOUBLE AS reg
        FROM t WHERE id IN (SELECT id FROM sp))""",
        R.dual_ctes("(SELECT 1 / sqrt(count(*)) FROM t)", sp="chosen"),
        R.cross_ctes(sp="chosen"),
        R.leverage_ctes(),
        """best AS MATERIALIZED (SELECT id, space_id AS pred_label, leverage AS residual FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(leverage, 9), space_id) AS rn
        FROM lev) WHERE rn = 1)""",
    ]


SQL["fit_class_subspaces"] = over(
    "vectors", _inverse("w", label="label"), *_class_ctes()[:3]
)
for _name, _table in (
    ("classify_max_projection", "vectors"),
    ("classify_max_projection_events", "events"),
):
    SQL[_name] = over(
        _table, f"SELECT id, pred_label, {r6('residual')} AS residual FROM best", *_class_ctes()
    )
SQL["match_summary"] = over(
    "vectors",
    f"""SELECT label = pred_label AS is_match, count(*) AS n_rows,
    {r6('sum(residual)', 5)} AS residual_sum FROM t JOIN best USING (id) GROUP BY 1""",
    *_class_ctes(),
)
SQL["match_summary_held_out"] = SQL["match_summary"].replace(
    "FROM t JOIN best USING (id) GROUP BY 1",
    "FROM t JOIN best USING (id) WHERE id NOT IN (SELECT id FROM sp) GROUP BY 1",
)
_best_spaces = "sp AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT id FROM {s} WHERE (SELECT best FROM b{UNROLLED - 1} WHERE misses >= {Q.SELECT_MISSES}) = {i}"
    for i, (_, _, s, _) in enumerate(_rounds)
) + ")"
# the classes may have thousands of landmarks: their leverages in the feature-space form
SQL["selected_match_summary"] = over(
    "events",
    f"""SELECT label = pred_label AS is_match, count(*) AS n_rows,
    {r6('sum(residual)', 4)} AS residual_sum FROM class_best GROUP BY 1""",
    *_loop,
    _best_spaces,
    """chosen AS MATERIALIZED (SELECT label AS space_id, id, x, 1.0::DOUBLE AS reg
        FROM t WHERE id IN (SELECT id FROM sp))""",
    R.primal_ctes("(SELECT 1 / sqrt(count(*)) FROM t)", "chosen", "cw"),
    # equal up to rounding noise: the smallest label wins
    """class_levs AS MATERIALIZED (SELECT *, min(lev) OVER (PARTITION BY id) AS least FROM (
        SELECT t.id, t.label, list_inner_product(t.x, t.x) AS k, c.space_id,
        list_sum(list_transform(c.wm, lambda r: list_inner_product(r, t.x) ** 2)) AS lev
        FROM t, (SELECT space_id, list(w ORDER BY i) AS wm FROM cw GROUP BY space_id) c)),
    class_best AS (SELECT id, any_value(label) AS label, min(space_id) AS pred_label,
        any_value(least) AS residual FROM class_levs
        WHERE lev <= least + 1e-12 * greatest(k, 1e-300) GROUP BY id)""",
)


SQL["selected_match_summary_tiled"] = SQL["selected_match_summary"]


def _ridge_ctes(outputs: str, target: str) -> list[str]:
    """``alpha(space_id, output, ord, id, x, alpha)`` = W'(W f)."""
    return [
        R.space_ctes(),
        R.dual_ctes(),
        f"""target AS (SELECT space_id, output, list({target} ORDER BY ord) AS f
        FROM sp, ({outputs}) o GROUP BY space_id, output)""",
        """half AS (SELECT w.space_id, output, list(list_inner_product(w.w, f) ORDER BY w.i) AS wf
        FROM w JOIN target ON target.space_id = w.space_id GROUP BY w.space_id, output)""",
        """turned AS (SELECT space_id, c AS i, list(v ORDER BY i) AS col FROM (
        SELECT space_id, i, unnest(w) AS v, generate_subscripts(w, 1) AS c FROM w)
        GROUP BY space_id, c)""",
        """alpha AS MATERIALIZED (SELECT sp.space_id, output, sp.ord, sp.id, sp.x,
        list_inner_product(col, wf) AS alpha
        FROM sp JOIN turned ON turned.space_id = sp.space_id AND turned.i = sp.ord + 1
        JOIN half ON half.space_id = sp.space_id)""",
    ]


_single = _ridge_ctes("SELECT 0 AS output", "label::DOUBLE")
_multi = _ridge_ctes(
    """SELECT label AS class, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS output
    FROM (SELECT DISTINCT label FROM t)""",
    "CASE WHEN label = class THEN 1.0::DOUBLE ELSE 0.0 END",
)
_predicted = """pred AS MATERIALIZED (SELECT t.id, a.space_id, a.output,
        sum(a.alpha * list_inner_product(a.x, t.x)) AS v
        FROM t CROSS JOIN alpha a GROUP BY t.id, a.space_id, a.output)"""
SQL["ridge_fit"] = over(
    "vectors", f"SELECT space_id, ord::INTEGER AS ord, id, {r6('alpha')} AS alpha FROM alpha", *_single
)
SQL["ridge_fit_multi"] = over(
    "vectors", f"SELECT space_id, output, ord::INTEGER AS ord, id, {r6('alpha')} AS alpha FROM alpha", *_multi
)
SQL["ridge_fit_iterative"] = SQL["ridge_fit_multi"]
# in feature space: f(y) = y'(X'P^-1 X + lambda I)^-1 X'P^-1 f, with W'W = (I + S / lambda)^-1
_best_landmarks = "chosen AS MATERIALIZED (" + " UNION ALL ".join(
    f"""SELECT space_id, s.id, s.x, greatest(reg, 1e-12) AS reg, label FROM {s} s JOIN t USING (id)
    WHERE (SELECT best FROM b{UNROLLED - 1} WHERE misses >= {Q.SELECT_MISSES}) = {i}"""
    for i, (_, _, s, _) in enumerate(_rounds)
) + ")"
SQL["ridge_vote_selected"] = over(
    "events",
    """SELECT class AS pred_label, label = class AS is_match, count(*) AS n_rows FROM (
        SELECT row_id, label, class, row_number() OVER (PARTITION BY row_id ORDER BY count(*) DESC, class) AS rn
        FROM firsts GROUP BY row_id, label, class) WHERE rn = 1 GROUP BY 1, 2""",
    *_loop,
    _best_landmarks,
    R.primal_ctes(str(R.LAMBDA), "chosen", "vw"),
    """pulls AS (SELECT space_id, class, list(v ORDER BY pos) AS g FROM (
        SELECT space_id, class, pos, sum(CASE WHEN label = class THEN v / reg ELSE 0 END) AS v FROM (
            SELECT *, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM chosen), (SELECT DISTINCT label AS class FROM t)
        GROUP BY space_id, class, pos) GROUP BY space_id, class)""",
    # the weights of a class in a subspace: W'(W g)
    """weights AS MATERIALIZED (SELECT space_id, class, list(wt ORDER BY pos) AS wt FROM (
        SELECT space_id, class, pos, sum(v * wg) AS wt FROM (
            SELECT vw.space_id, class, list_inner_product(w, g) AS wg, unnest(w) AS v, generate_subscripts(w, 1) AS pos
            FROM vw JOIN pulls ON pulls.space_id = vw.space_id) GROUP BY space_id, class, pos) GROUP BY space_id, class)""",
    """numbered AS MATERIALIZED (SELECT row_number() OVER () AS row_id, label, x FROM t)""",
    """firsts AS (SELECT row_id, label, class FROM (
        SELECT row_id, label, class, row_number() OVER (
            PARTITION BY row_id, space_id ORDER BY list_inner_product(wt, x) DESC, class) AS first
        FROM numbered, weights) WHERE first = 1)""",
)
SQL["ridge_predict"] = over(
    "events", f"SELECT id, {r6('v')} AS pred FROM pred WHERE space_id = 2", *_single, _predicted
)
SQL["ridge_predict_multi"] = over(
    "events",
    f"SELECT id, output::BIGINT AS pos, {r6('v')} AS value FROM pred WHERE space_id = 2",
    *_multi,
    _predicted,
)
SQL["ridge_classify_vote"] = over(
    "vectors",
    """SELECT id, label AS pred_label FROM (
    SELECT id, output, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, output) AS rn FROM (
        SELECT id, space_id, output,
        row_number() OVER (PARTITION BY id, space_id ORDER BY v DESC, output) AS first FROM pred)
    WHERE first = 1 GROUP BY id, output) votes
    JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS output
          FROM (SELECT DISTINCT label FROM t)) names ON names.output = votes.output
    WHERE rn = 1""",
    *_multi,
    _predicted,
)
