"""SimHash near-duplicates through a vantage-point tree over fingerprints.

Equal fingerprints are one node, so copies never pair up. A tree of vantage points
grown from a bounded sample deals the nodes into shards: a node goes to the inner
side of a vantage point if it is no farther than the radius. By the triangle bound a
pair within ``max_bits`` can only be parted at a vantage point if its inner member
lies within ``max_bits`` of the radius, so that member also visits the other side as a
query. Each shard then searches a tree of its own. Shards that stay too large (the
fingerprints of one dense group, which no radius parts well) take an exact way that
needs no shard: two fingerprints are within 2 bits exactly if they share one that is
within 1 bit of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kernspan.llm.components import connected_components
from kernspan.llm.tables import named_apart, stored

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: fingerprints the shared tree is grown from, at most
SAMPLE = 131_072
#: nodes at home in a shard, on average, and sampled ones it has at least
HOME_NODES, LEAF_SAMPLE = 2_000, 16
#: nodes (at home or visiting) a shard may hold before it takes the exact way without shards
SHARD_NODES = 80_000
_SEARCH_LEAF = 64


# -------------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text, as an unsigned number.

    A-Z are lower-cased; the shingles are runs of ``width`` words, repeats included,
    or all words where there are fewer. A bit is set if over half the shingle hashes
    have it. A text without words has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)])
    counts = np.zeros(64, np.int64)
    octets = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for at in range(0, n, 65_536):
        counts += np.unpackbits(octets[at : at + 65_536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _with_fingerprint(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            prints = np.fromiter(
                (fingerprint(texts[i].as_py()) for i in range(batch.num_rows)), np.uint64, batch.num_rows
            )
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array(prints.view(np.int64))], [*rest, name]
            )

    return run


def fingerprints(keyed: DataFrame, name: str = "fp") -> DataFrame:
    """``keyed`` with its ``text`` replaced by the fingerprint as a (signed) long."""
    rest = keyed.drop("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return keyed.mapInArrow(_with_fingerprint(name), f"{schema}, `{name}` long")


# ------------------------------------------------------------------- shared tree


@dataclass(frozen=True)
class Node:
    """A vantage point with its radius and the two sides; leaves are shard numbers."""

    point: int
    radius: int
    inner: Node | int
    outer: Node | int


def _distance(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int64)


def _split(points: np.ndarray, rng: np.random.Generator, reach: int) -> tuple[int, int] | None:
    """A vantage point and radius that part ``points`` best: few near the radius, both
    sides large. None if every way would send most of them to both sides."""
    best = None
    for vantage in rng.choice(points, min(8, len(points)), replace=False):
        d = _distance(points, int(vantage))
        held = np.cumsum(np.bincount(d, minlength=65))
        for radius in range(64):
            inner = held[radius]
            twice = inner - (held[radius - reach] if radius >= reach else 0)
            largest = max(inner, len(points) - inner + twice)
            if best is None or largest < best[0]:
                best = (largest, int(vantage), radius)
    return best[1:] if best and best[0] <= 0.8 * len(points) else None


def grow_tree(sample: np.ndarray, reach: int = MAX_BITS, leaf: int = LEAF_SAMPLE, seed: int = 5):
    """The shared tree over a sample of distinct fingerprints."""
    rng, shards = np.random.default_rng(seed), iter(range(1 << 30))

    def grow(points: np.ndarray, depth: int) -> Node | int:
        found = _split(points, rng, reach) if len(points) >= 2 * leaf and depth < 40 else None
        if found is None:
            return next(shards)
        vantage, radius = found
        inside = _distance(points, vantage) <= radius
        return Node(vantage, radius, grow(points[inside], depth + 1), grow(points[~inside], depth + 1))

    return grow(sample, 0)


def route(points: np.ndarray, tree: Node | int, reach: int = MAX_BITS):
    """(index, shard, home) of every visit: one home shard each, others as a query."""
    out: list[tuple[np.ndarray, int, bool]] = []

    def walk(index: np.ndarray, node: Node | int, home: np.ndarray) -> None:
        if not len(index):
            return
        if isinstance(node, int):
            out.append((index, node, home))
            return
        d = _distance(points[index], node.point)
        # a query that is away from home may have partners on both sides
        inner = np.where(home, d <= node.radius, d <= node.radius + reach)
        outer = d > node.radius - reach
        walk(index[inner], node.inner, (home & (d <= node.radius))[inner])
        walk(index[outer], node.outer, (home & (d > node.radius))[outer])

    walk(np.arange(len(points)), tree, np.ones(len(points), bool))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return (
        np.concatenate([i for i, _, _ in out]),
        np.concatenate([np.full(len(i), s) for i, s, _ in out]),
        np.concatenate([h for _, _, h in out]),
    )


def _routed(tree, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            index, shard, home = route(fp.view(np.uint64), tree, reach)
            for at in range(0, len(index), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[index[part]]), pa.array(shard[part]), pa.array(home[part])],
                    ["fp", "shard", "home"],
                )

    return run


# ------------------------------------------------------------------ search in a shard


def near_pairs(stored_points: np.ndarray, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query index, point index) within ``reach``: a tree search that takes
    all queries down together and drops, at each vantage point, those whose triangle
    bound rules a side out."""

    def walk(points: np.ndarray, asked: np.ndarray, depth: int):
        if not len(points) or not len(asked):
            return
        found = None
        if len(points) > _SEARCH_LEAF and depth < 60:
            vantage = stored_points[points[len(points) // 2]]
            d = _distance(stored_points[points], int(vantage))
            radius = int(np.median(d))
            inside = d <= radius
            if 0 < inside.sum() < len(points):
                found = vantage, radius, inside
        if found is None:
            step = max(1, 2_000_000 // len(points))
            for at in range(0, len(asked), step):
                block = asked[at : at + step]
                far = np.bitwise_count(queries[block][:, None] ^ stored_points[points][None, :])
                q, p = np.nonzero(far <= reach)
                if len(q):
                    yield block[q], points[p]
            return
        vantage, radius, inside = found
        away = _distance(queries[asked], int(vantage))
        yield from walk(points[inside], asked[away <= radius + reach], depth + 1)
        yield from walk(points[~inside], asked[away > radius - reach], depth + 1)

    yield from walk(np.arange(len(stored_points)), np.arange(len(queries)), 0)


def _forest(n: int):
    """A union-find over n items that hooks whole blocks of links at once."""
    parent = np.arange(n)

    def union(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal parent
        while True:
            ra, rb = parent[a], parent[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            if (low == high).all():
                return
            np.minimum.at(parent, high, low)
            while (parent != parent[parent]).any():
                parent = parent[parent]

    return union, lambda: parent


def _linked(reach: int):
    """Links of one shard, one for each node but the first of each group."""

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().astype(np.int64)
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((~home, fp))
        fp, home = fp[order], home[order]
        once = np.concatenate([[True], fp[1:] != fp[:-1]])
        fp, home = fp[once], home[once]
        points = fp.view(np.uint64)
        own = np.flatnonzero(home)
        union, roots = _forest(len(fp))
        for q, p in near_pairs(points[own], points, reach):
            union(q, own[p])
        root = roots()
        apart = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": pa.array(fp[apart]), "b": pa.array(fp[root[apart]])})

    return run


def _midpoint_links(fps: DataFrame) -> DataFrame:
    """Links within 2 bits among ``fps`` by shared neighbours at 1 bit: 65 rows a node,
    at most 65 nodes a group, and a group's nodes are all within 2 bits."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    middle = fps.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")
    )
    least = middle.groupBy("mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return middle.join(least, "mid").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def fingerprint_links(fps: DataFrame, sample: int = SAMPLE, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that connect all pairs within
    ``MAX_BITS`` (their transitive closure is that of all such pairs)."""
    total = fps.count()
    every = max(1, -(-2 * total // sample))
    drawn = fps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).orderBy(F.xxhash64("fp")).limit(sample)
    picked = np.array([r["fp"] for r in drawn.collect()], np.int64).view(np.uint64)
    leaf = max(LEAF_SAMPLE, round(len(picked) * HOME_NODES / max(total, 1)))
    tree = grow_tree(picked, leaf=leaf)
    visits = fps.mapInArrow(_routed(tree, MAX_BITS), "fp long, shard long, home boolean")
    visits = stored(visits, "visits")
    # as many counts as the shared tree has leaves
    sizes = visits.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    large = [r["shard"] for r in sizes.where(F.col("n") > shard_nodes).collect()]
    is_large = F.col("shard").isin(large) if large else F.lit(False)
    links = visits.where(~is_large).groupBy("shard").applyInArrow(_linked(MAX_BITS), "a long, b long")
    if large:
        dense = visits.where(is_large).select("fp").distinct()
        links = links.unionByName(_midpoint_links(dense))
    return links


# ----------------------------------------------------------------------- operator


def near_duplicates(keyed: DataFrame) -> DataFrame:
    """``fp``, ``component_id`` and ``component_fp`` (one of the fingerprints in it) for
    every row of ``keyed``: doc_id, text and others.

    ``component_id`` is the smallest doc_id of the rows that are linked to a row by
    fingerprints within two bits, its own included; rows whose doc_id is null take
    part and have a null component only if no linked row has an id. Null and empty
    texts have fingerprint 0 and are linked like any other. An empty table gives no
    rows. The text is dropped, other columns stay.
    """
    rows = stored(fingerprints(keyed), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    members = connected_components(fingerprint_links(nodes.select("fp")))
    grouped = nodes.join(members, nodes["fp"] == members["node"], "left").select(
        nodes["fp"].alias("node"), "least", F.coalesce("root", "fp").alias("root")
    )
    component = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(component, "root")
    named = named.select("node", "component_id", F.col("root").alias("component_fp"))
    return rows.join(named, rows["fp"] == named["node"]).drop("node")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    found = near_duplicates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays,
    that of the smallest doc_id (rows without id last; of several with that id the one
    of smallest text hash; of equal rows any). Columns are as they were.
    """
    own_id, text_key, place = named_apart(docs, "own_id", "text_key", "place")
    # rows of one component share the key of a row without id only if texts are equal
    keyed = docs.withColumn(
        own_id, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    ).withColumn(text_key, F.xxhash64(F.coalesce("text", F.lit(""))))
    slim = keyed.select(F.col(own_id).alias("doc_id"), F.col(text_key).alias("key"), "text")
    firsts = (
        near_duplicates(slim)
        .groupBy("component_fp")
        .agg(F.min(F.struct("doc_id", "key")).alias("first"))
        .select(F.col("first.doc_id").alias(own_id), F.col("first.key").alias(text_key))
    )
    alike = Window.partitionBy(own_id, text_key).orderBy(text_key)
    kept = keyed.join(firsts, [own_id, text_key], "left_semi")
    kept = kept.withColumn(place, F.row_number().over(alike)).where(F.col(place) == 1)
    return kept.select(*docs.columns)
