"""Substring deduplication and SimHash components against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernspan.llm import simhash, substrings
from kernspan.llm.components import connected_components
from tests.llm.samples import components, documents, fingerprint, frame, prose, without_repeats, words


def expected_removal(rows):
    out = Counter()
    for (i, text), stays in zip(rows, without_repeats(rows), strict=True):
        ws = words(text)
        kept = " ".join(w for w, s in zip(ws, stays, strict=True) if s)
        out[(i, len(ws), len(ws) - sum(stays), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def test_substrings_equal_brute_force(spark):
    rows = documents()
    got = substrings.substring_dedup(frame(spark, rows, clashes=True)).collect()
    want = expected_removal([(r[0], r[1]) for r in rows])
    assert Counter(tuple(r) for r in got) == want
    assert sum(n for (_, _, gone, _), n in want.items() if gone) > 4


def test_blocks_of_any_size_give_the_same(spark):
    """A passage in very many documents, dealt out in many small blocks."""
    passage = prose(3, 40)
    rows = [(i, f"{prose(i, 20)} {passage} {prose(900 + i, 20)}", "en", "s", 0) for i in range(150)]
    measures = {m: m for m in ("n_words", "n_removed", "kept_sha256")}
    want = expected_removal([(r[0], r[1]) for r in rows])
    for flush in (100, 1_000_000):
        got = substrings.remove_repeats(frame(spark, rows).repartition(7), measures, ["doc_id"], flush_windows=flush)
        assert Counter(tuple(r) for r in got.collect()) == want


def test_cut_texts_keep_rows_and_columns(spark):
    rows = documents()
    docs = frame(spark, rows, clashes=True)
    got = substrings.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    stays = without_repeats([(r[0], r[1]) for r in rows])
    want = Counter()
    for row, mask in zip(rows, stays, strict=True):
        ws = words(row[1])
        left = row[1] if all(mask) else " ".join(w for w, s in zip(ws, mask, strict=True) if s)
        want[(row[0], " ".join(words(left)), row[1] is None)] += 1
        if all(mask):
            want[("same", row[0], row[1], row[4])] += 1
    have = Counter()
    for r in got.collect():
        have[(r["doc_id"], " ".join(words(r["text"])), r["text"] is None)] += 1
        if (r["doc_id"], r["text"]) in {(k[1], k[2]) for k in want if k[0] == "same"}:
            have[("same", r["doc_id"], r["text"], r["n_chars"])] += 1
    assert have == want


def test_empty_tables(spark):
    assert substrings.substring_dedup(frame(spark, [])).count() == 0
    assert substrings.without_repeats(frame(spark, [])).count() == 0
    assert simhash.simhash_components(frame(spark, [])).count() == 0
    assert simhash.keep_one_of_each(frame(spark, [])).count() == 0


def test_packed_pairs_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500):
        key = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        doc = rng.integers(-(1 << 62), 1 << 62, n)
        back = substrings.unpack_pairs(substrings.pack_pairs(key, doc))
        assert (back[0] == key).all() and (back[1] == doc).all()


def test_word_hashes_do_not_depend_on_place():
    raw = b"alpha beta  alpha\tgamma beta\nalpha"
    h = substrings.word_hashes(raw, *substrings.word_spans(raw))
    assert h[0] == h[2] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_fingerprints_equal_brute_force():
    for row in documents():
        assert simhash.fingerprint(row[1]) == fingerprint(row[1])


def expected_components(rows):
    roots = components([fingerprint(r[1]) for r in rows])
    groups: dict[int, list] = {}
    for row, root in zip(rows, roots, strict=True):
        groups.setdefault(root, []).append(row[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return Counter((r[0], f"{fingerprint(r[1]):016x}", least[k]) for r, k in zip(rows, roots, strict=True))


def test_components_equal_brute_force(spark):
    rows = documents()
    got = simhash.simhash_components(frame(spark, rows, clashes=True)).collect()
    assert Counter(tuple(r) for r in got) == expected_components(rows)


@pytest.mark.parametrize("shard_nodes", [20_000, 50])
def test_links_connect_all_near_pairs(spark, shard_nodes):
    """Random points, dense balls and chains; with and without the way for large shards."""
    rng = random.Random(4)
    points = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for center in list(points)[:6]:
        for _ in range(120):
            moved = center
            for _ in range(rng.randint(1, 4)):
                moved ^= 1 << rng.randrange(64)
            points.add(moved)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(points)]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.fingerprint_links(fps, sample=200, shard_nodes=shard_nodes)
    found = {r["node"]: r["root"] for r in connected_components(links).collect()}
    roots = components([p & ((1 << 64) - 1) for p in signed])
    for i, p in enumerate(signed):
        group = [q for q, r in zip(signed, roots, strict=True) if r == roots[i]]
        assert found.get(p, p) == min(group)


def test_tree_search_finds_all_pairs():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base ^ np.uint64(1), base[:200] ^ np.uint64(5)]))
    got = {(int(q), int(p)) for qs, ps in simhash.near_pairs(points, points, 2) for q, p in zip(qs, ps, strict=True)}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)}
    tree = simhash.grow_tree(points, leaf=20)
    index, shard, home = simhash.route(points, tree)
    at = {}
    for i, s, h in zip(index, shard, home, strict=True):
        at.setdefault(int(i), {})[int(s)] = bool(h)
    for a, b in got:  # one of each pair visits the other's home
        home_b = next(s for s, h in at[b].items() if h)
        home_a = next(s for s, h in at[a].items() if h)
        assert home_b in at[a] or home_a in at[b]


def test_one_of_each_stays(spark):
    rows = documents()
    docs = frame(spark, rows, clashes=True)
    got = simhash.keep_one_of_each(docs)
    assert got.columns == docs.columns
    roots = components([fingerprint(r[1]) for r in rows])
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(kept) == len(set(roots))
    for root in set(roots):
        group = [r for r, k in zip(rows, roots, strict=True) if k == root]
        ids = [r[0] for r in group if r[0] is not None]
        hit = [k for k in kept if k in {(r[0], r[1]) for r in group}]
        assert len(hit) == 1 and hit[0][0] == (min(ids) if ids else None)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1_000, 1_000 + i) for i in range(1, 300)] + [(7, 7), (5, 6)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(201)} | {1_000 + i: 1_000 for i in range(300)}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    none = connected_components(spark.createDataFrame([(1, 1)], "a long, b long").where(F.lit(False)))
    assert none.count() == 0


def test_query_equals_its_sql(spark, sf):
    from kernspan.llm.queries import QUERIES, SQL
    from verification.check import difference, duckdb_views

    got = QUERIES["op3_substring_dedup"](spark, sf).toPandas()
    assert difference(got, duckdb_views(sf).sql(SQL["op3_substring_dedup"]).df()) == ""
