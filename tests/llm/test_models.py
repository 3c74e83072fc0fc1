"""Multi-index recall, mixing budgets, tool calls and cross-entropy, by brute force."""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernspan.llm import crossentropy, mixing, multiindex, toolcalls
from kernspan.llm.queries import SCHEMAS, tool_messages
from tests.llm.samples import documents, frame, prose, words

# ------------------------------------------------------------------- nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def exact(points: dict[int, np.ndarray], every: int, k: int, more: tuple = ()):
    """Of each query id the nearest rows; ``more`` are rows (id, vector) beside the points."""
    rows = sorted([*points.items(), *more], key=lambda row: row[0])
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], float)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for at, q in enumerate(ids):
        if q % every == 0:
            score = (x * x[at]).sum(1) / (norm * np.sqrt((x[at] * x[at]).sum()))
            order = sorted((i for i in range(len(ids)) if i != at), key=lambda i: (-score[i], ids[i]))[:k]
            out.setdefault(q, []).append([(ids[i], score[i]) for i in order])
    return {q: found[0] if len(found) == 1 else found for q, found in out.items()}


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return dict(out)


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(3)
    points = {i: rng.normal(size=7).astype(np.float32) for i in range(300)}
    for i in range(150, 160):
        points[i] = points[100]  # ties
    rows = [(i, v.tolist(), 0) for i, v in points.items()]
    rows += [(500, None, 0), (550, [0.0] * 7, 0), (600, [1.0] * 6 + [None], 0), (650, [float("nan")] * 7, 0)]
    rows += [(700, [float("inf")] + [1.0] * 6, 0), (750, [1.0, 2.0], 0), (None, [1.0] * 7, 0), rows[3]]
    docs = vectors(spark, rows).withColumn("cell", F.lit("taken")).withColumn("x", F.lit("taken"))
    got, want = found(multiindex.nearest(docs)), exact(points, 50, 5, ((3, points[3]),))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q, v in got.items():
        assert np.allclose([s for _, s in v], [s for _, s in want[q]], rtol=0, atol=1e-15)


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rng = np.random.default_rng(4)
    points = {i: rng.normal(size=4).astype(np.float32) for i in range(60)}
    more = [(50, rng.normal(size=4).astype(np.float32)), (7, points[50]), (7, points[0])]
    rows = [(i, v.tolist(), 0) for i, v in [*points.items(), *more]]
    want = exact(points, 50, 5, tuple(more))
    found_rows = multiindex.nearest(vectors(spark, rows)).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in found_rows if r["query_id"] == 50) == sorted(
        (rank, i) for nearest in want[50] for rank, (i, _) in enumerate(nearest, 1)
    )
    assert [r["vec_id"] for r in sorted(found_rows, key=lambda r: r["rank"]) if r["query_id"] == 0] == [i for i, _ in want[0]]
    assert len(found_rows) == 15


def test_recall_over_several_shards_and_split_cells(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 16))
    points = {i: (centers[i % 30] + 0.4 * rng.normal(size=16)).astype(np.float32) for i in range(3_000)}
    for i in range(1_000):  # a third of all rows in one cell
        points[i] = (np.ones(16) + 0.01 * rng.normal(size=16)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in points.items()]
    df = multiindex.nearest(
        vectors(spark, rows), centroids=16, candidate_share=0.3, min_candidates=100, shard_rows=200
    )
    got, want = found(df), exact(points, 50, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_few_vectors_and_none(spark):
    assert found(multiindex.nearest(vectors(spark, [(0, [1.0, 2.0], 0), (7, [2.0, 4.0], 1)]))) == {
        0: [(7, pytest.approx(1.0))]
    }
    assert multiindex.nearest(vectors(spark, [(50, [3.0], 0)])).count() == 0
    assert found(multiindex.nearest(vectors(spark, [(0, [3.0], 0), (1, [-3.0], 0)]))) == {0: [(1, -1.0)]}
    assert multiindex.nearest(vectors(spark, [])).count() == 0


def test_cells_come_in_order_of_distance():
    rng = np.random.default_rng(2)
    first, second, held = rng.random(9), rng.random(7), rng.integers(0, 3, 63)
    order = sorted((first[i] + second[j], i * 7 + j) for i in range(9) for j in range(7))
    want = [c for _, c in order if held[c]]
    assert multiindex.walk_cells(first, second, held, 10**9) == want
    part = multiindex.walk_cells(first, second, held, 20)
    assert part == want[: len(part)] and held[part].sum() >= 20 > held[part[:-1]].sum()


# ------------------------------------------------------------------------------- mixing


def domain():
    return F.when(F.col("source").isin("src0", "src1"), "a").otherwise("b")


WEIGHTS = {"domain": {"a": 3.0}, "lang": {"en": 4.0, "fr": 0.0}, "source": {"src1": 2.0}}


def weight_columns():
    def by(name):
        out = F.lit(1.0)
        for key, w in WEIGHTS[name].items():
            out = F.when(F.col(name) == key, w).otherwise(out)
        return out

    return {name: by(name) for name in WEIGHTS}


def domain_of(source):
    return "a" if source in ("src0", "src1") else "b"


def fill(budget, rooms, weights):
    """Shares by rounds: whoever is full leaves, the rest is dealt again."""
    share = {c: 0.0 for c in rooms}
    open_ = {c for c in rooms if weights[c] > 0 and rooms[c] > 0}
    while open_ and budget > 1e-9:
        total = sum(weights[c] for c in open_)
        full = {c for c in open_ if rooms[c] - share[c] <= budget * weights[c] / total}
        if not full:
            for c in open_:
                share[c] += budget * weights[c] / total
            break
        for c in full:
            budget -= rooms[c] - share[c]
            share[c] = rooms[c]
        open_ -= full
    return share


def expected_budgets(supply, budget, epochs):
    def below(prefix):
        return sorted({p[: len(prefix) + 1] for p in supply if p[: len(prefix)] == prefix}, key=str)

    def room(prefix):
        return epochs * sum(n for p, n in supply.items() if p[: len(prefix)] == prefix)

    def go(prefix, given, out):
        if len(prefix) == 3:
            out[prefix] = given
            return
        children = below(prefix)
        level = mixing.LEVELS[len(prefix)]
        weights = {c: WEIGHTS[level].get(c[-1], 1.0) for c in children}
        for c, s in fill(given, {c: room(c) for c in children}, weights).items():
            go(c, s, out)

    out: dict = {}
    go((), budget, out)
    return out


@pytest.mark.parametrize(("share", "epochs"), [(0.3, 1), (0.8, 1), (1.7, 3), (5.0, 2)])
def test_budgets_and_prefixes(spark, share, epochs):
    rows = documents()
    docs = frame(spark, rows, clashes=True)
    got = mixing.mix(docs, domain(), weight_columns(), F.sum("supply") * share, max_epochs=epochs, seed=3).collect()
    sized = [(r[0], (domain_of(r[3]), r[2], r[3]), len(words(r[1]))) for r in rows]
    supply = Counter()
    for _, leaf, n in sized:
        supply[leaf] += n
    supply = {k: n for k, n in supply.items() if n}
    budgets = expected_budgets(supply, share * sum(supply.values()), epochs)
    ids = spark.createDataFrame([(r[0],) for r in rows], "doc_id long").distinct()
    place = {}
    for e in range(epochs + 1):
        for r in ids.select("doc_id", mixing._order(3, F.lit(e).cast("long")).alias("p")).collect():
            place[(r["doc_id"], e)] = (r["p"] % (1 << 64), r["p"])
    want = Counter()
    for leaf, given in budgets.items():
        left = min(math.floor(given + 1e-6), epochs * supply[leaf])
        epoch = 0
        own = [(i, n) for i, lf, n in sized if lf == leaf and n]
        while left > 0:
            order = sorted(own, key=lambda d: (place[(d[0], epoch)], d[0] is not None, d[0] or 0, d[1]))
            for i, n in order:
                if left <= 0:
                    break
                want[(i, *leaf, epoch, n, min(n, left))] += 1
                left -= min(n, left)
            epoch += 1
    assert Counter(tuple(r) for r in got) == want


def test_kept_mixture_takes_whole_documents(spark):
    rows = documents()
    docs = frame(spark, rows, clashes=True)
    budget = F.sum("supply") * 0.5
    kept = mixing.keep_mixed(docs, domain(), weight_columns(), budget, seed=3)
    assert kept.columns == docs.columns
    mixed = mixing.mix(docs, domain(), weight_columns(), budget, max_epochs=1, seed=3).collect()
    have = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert set(i for i, _ in have) == {r["doc_id"] for r in mixed}
    assert sum(have.values()) >= len(mixed)
    assert sum(len(words(t)) * n for (_, t), n in have.items()) >= sum(r["taken_tokens"] for r in mixed)


def test_mixing_nothing(spark):
    none = frame(spark, [])
    assert mixing.mix(none, domain(), weight_columns(), F.sum("supply")).count() == 0
    assert mixing.keep_mixed(none, domain(), weight_columns(), F.sum("supply")).count() == 0
    empty = frame(spark, [(1, None, "en", "src0", 0), (2, " ", None, None, 0)])
    assert mixing.mix(empty, domain(), weight_columns(), F.sum("supply")).count() == 0


# --------------------------------------------------------------------------- tool calls

TOOLS: toolcalls.Schemas = {
    "add": {"a": ("number", True), "b": ("number", True), "note": ("string", False)},
    "find": {"q": ("string", True), "deep": ("boolean", False), "keys": ("array", False), "opt": ("object", False)},
}


def call(id_, name, arguments):
    return {"id": id_, "name": name, "arguments": arguments}


def message(*calls):
    return json.dumps({"tool_calls": list(calls)})


def result(id_, content):
    return json.dumps({"tool_call_id": id_, "content": content})


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def by_id(df):
    return {(r["conv_id"], r["call_id"], r["turn"], r["name"]): r for r in df.collect()}


def test_linking_order_and_validation(spark):
    rows = [
        (1, 0, "system", "hello"),
        (1, 1, "assistant", message(
            call("x", "add", {"b": 2, "a": 1.5, "after": ["z"]}),
            call("y", "find", {"q": 3, "deep": "no", "more": 1}),
        )),
        (1, 2, "tool", result("x", "3.5\n\"q\"")),
        (1, 3, "assistant", message(call("z", "find", {"q": "a", "keys": [1], "opt": {"k": None}}))),
        (1, 4, "tool", result("z", "late")),
        (1, 5, "tool", result("z", "later")),
        (1, 6, "assistant", message(call("x", "add", {"a": 1, "b": 2}), call(None, "add", {}), call("w", "fly", {}))),
        (1, 7, "tool", result("orphan", "nobody")),
        (2, 0, "assistant", message(call("x", "add", "{oops"))),
        (2, 1, "assistant", "not json"),
        (2, 2, "assistant", None),
        (2, None, "tool", None),
        (None, 0, "assistant", message(call("n", "add", {"a": 1, "b": None}))),
    ]
    df = messages(spark, rows).withColumn("stage", F.lit("taken")).withColumn("position", F.lit("taken"))
    got = by_id(toolcalls.link_tool_calls(df, TOOLS))
    state = {k: (r["status"], list(r["errors"]), r["result_turn"], r["n_results"]) for k, r in got.items()}
    assert state == {
        (1, "x", 1, "add"): ("linked", [], 2, 1),
        (1, "y", 1, "find"): ("invalid", ["type:deep", "type:q", "unknown:more"], None, 0),
        (1, "z", 3, "find"): ("linked", [], 4, 2),
        (1, "x", 6, "add"): ("duplicate", [], None, 0),
        (1, None, 6, "add"): ("no_id", ["missing:a", "missing:b"], None, 0),
        (1, "w", 6, "fly"): ("invalid", ["unknown_tool"], None, 0),
        (2, "x", 0, "add"): ("invalid", ["not_an_object"], None, 0),
        (None, "n", 0, "add"): ("invalid", ["missing:b"], None, 0),
    }
    order = sorted((r["position"], k[1]) for k, r in got.items() if k[0] == 1)
    assert [p for p, _ in order] == list(range(6)) and [i for _, i in order][:3] == ["y", "z", "x"]
    text = got[(1, "x", 1, "add")]["canonical"]
    assert text == '{"arguments":{"a":1.5,"after":["z"],"b":2},"id":"x","name":"add","result":"3.5\\n\\"q\\""}'
    assert json.loads(got[(2, "x", 0, "add")]["canonical"])["arguments"] is None


def test_random_needs_are_ordered(spark):
    """Calls that need earlier and later ones, and cycles, against depth-first search."""
    rng = random.Random(8)
    rows, needs = [], {}
    for conv in range(12):
        n = rng.randint(1, 14)
        for i in range(n):
            wanted = rng.sample(range(n + 1), k=min(n, rng.choice([0, 0, 1, 1, 2])))
            needs[(conv, str(i))] = [str(w) for w in wanted]
            rows.append((conv, i, "assistant", message(call(str(i), "find", {"q": "s", "after": needs[(conv, str(i))]}))))
    got = toolcalls.link_tool_calls(messages(spark, rows), TOOLS).collect()
    place = {(r["conv_id"], r["call_id"]): r["position"] for r in got}
    cyclic = {(r["conv_id"], r["call_id"]) for r in got if r["status"] == "cycle"}

    def reaches(a, b, seen):
        for w in needs.get(a, []):
            nxt = (a[0], w)
            if nxt in needs and nxt not in seen:
                seen.add(nxt)
                if nxt == b or reaches(nxt, b, seen):
                    return True
        return a == b and (b[0], b[1]) in [(a[0], w) for w in needs.get(a, [])]

    on_cycle = {c for c in needs if reaches(c, c, set())}
    assert {c for c in on_cycle} <= cyclic
    for c in cyclic:  # on a cycle or behind one
        assert c in on_cycle or any(reaches(c, d, set()) for d in on_cycle if d[0] == c[0])
    for c, wanted in needs.items():
        for w in wanted:
            if (c[0], w) in needs and c not in cyclic and (c[0], w) not in cyclic:
                assert place[(c[0], w)] < place[c]
    for conv in range(12):
        assert sorted(p for (v, _), p in place.items() if v == conv) == list(range(sum(c[0] == conv for c in needs)))


def test_long_conversation_is_numbered_through(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(2_000)]
    got = toolcalls.link_tool_calls(tool_messages(messages(spark, rows)), SCHEMAS).orderBy("turn").collect()
    assert [r["position"] for r in got] == list(range(1_000))
    assert {r["status"] for r in got} == {"linked"}
    assert all(r["result_turn"] == r["turn"] + 1 for r in got)
    assert toolcalls.link_tool_calls(messages(spark, []), SCHEMAS).count() == 0


def test_tool_calls_run_no_python(spark):
    plan = toolcalls.link_tool_calls(messages(spark, [(1, 0, "assistant", message(call("x", "find", {"q": "a"})))]), TOOLS)
    shown = plan._jdf.queryExecution().toString()
    assert "Python" not in shown and "Arrow" not in shown


# ------------------------------------------------------------------------- cross-entropy


def test_losses_equal_brute_force(spark):
    rows = documents()
    slots = crossentropy.Slots(word_bits=10, pair_bits=13)
    chosen = {1, 4, 10, 105}
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in chosen] + [(1, 1, 1), (None, 1, 0), (2, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int"
    )
    got = crossentropy.score_against_good(frame(spark, rows, clashes=True), labels, slots).collect()
    cases = [(r[0], slots.of(r[1])) for r in rows]
    counts = [[Counter(), Counter(), Counter()] for _ in range(2)]
    for i, found_ in cases:
        for model in [0, 1] if i in chosen else [1]:
            for kind in range(3):
                counts[model][kind].update(found_[kind].tolist())
    want = Counter()
    for i, found_ in cases:
        n = len(found_[0])
        own = [Counter(f.tolist()) for f in found_]
        losses = []
        for model, (ws, hs, ps) in enumerate(counts):
            seen = i in chosen if model == 0 else True
            less = lambda c, kind, s: c[s] - (own[kind][s] if seen else 0)  # noqa: B023, E731
            total = sum(ws.values()) - (n if seen else 0)
            loss = 0.0
            for w, h, p in zip(*(f.tolist() for f in found_), strict=True):
                single = (less(ws, 0, w) + 0.5) / (total + 0.5 * 1_024)
                pair = less(ps, 2, p)
                loss -= math.log((pair + 4.0 * single) / (max(less(hs, 1, h), pair) + 4.0))
            losses.append(round(loss / n, 6) if n else None)
        want[(i, n, *losses)] += 1
    have = Counter(
        (r["doc_id"], r["n_words"], *(None if v is None else round(v, 6) for v in (r["target_loss"], r["background_loss"])))
        for r in got
    )
    assert have == want
    assert all(r["score"] is None or abs(r["score"] - r["target_loss"] + r["background_loss"]) < 1e-12 for r in got)


def test_held_out_text_like_the_target_scores_lower(spark):
    letters = lambda a, seed, n: " ".join(random.Random(seed).choices([x + y for x in a for y in a], k=n))
    rows = [(i, letters("abcd" if i % 2 else "wxyz", i, 80), "en", "s", 0) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 100, 2)], "doc_id long, quality int, toxic int")
    score = {r["doc_id"]: r["score"] for r in crossentropy.score_against_good(frame(spark, rows), labels).collect()}
    like = [score[i] for i in range(101, 200, 2)]
    unlike = [score[i] for i in range(100, 200, 2)]
    assert max(like) < min(unlike)


def test_scoring_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert crossentropy.score_against_good(frame(spark, []), none).count() == 0
    got = crossentropy.score_against_good(frame(spark, [(1, prose(1, 5), "en", "s", 0), (2, None, None, None, None)]), none)
    assert {r["doc_id"]: r["n_words"] for r in got.collect()} == {1: 5, 2: 0}


def test_counts_are_those_of_words_and_pairs_not_of_slots(spark):
    """Exact counts at the default setting, over several chunks and ranges, with words
    that share the first 18 bits of their hash."""
    rng = random.Random(8)
    found: dict[int, list[str]] = {}
    wide = crossentropy.Slots()
    names = [f"w{i}" for i in range(4_000)]
    for name in names:
        found.setdefault(int(wide.of(name)[0].view(np.uint64)[0]) >> 46, []).append(name)
    shared = [w for ws in found.values() if len(ws) > 1 for w in ws]
    assert shared
    rows = [(i, " ".join(rng.choices(shared, k=30) + rng.choices(names, k=30))) for i in range(60)]
    rows += [(None, rows[3][1]), (7, rows[8][1]), (7, rows[8][1]), (61, None), (62, " ")]
    chosen = set(range(0, 20)) | {61}
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    ids = spark.createDataFrame([(i,) for i in chosen] + [(None,)], "doc_id long")
    got = crossentropy.score(docs, ids, chunk_bytes=2_000, range_pairs=20).collect()
    models = [[Counter(), Counter(), Counter()] for _ in range(2)]
    vocabulary = set()

    def keys(text):
        ws = (text or "").split()
        before = ["", *ws][: len(ws)]
        return ws, before, list(zip(before, ws, strict=True))

    for i, text in rows:
        vocabulary |= set(keys(text)[0])
        for m in [0, 1] if i in chosen else [1]:
            for kind, ks in enumerate(keys(text)):
                models[m][kind].update(ks)
    want = Counter()
    for i, text in rows:
        words_, before, pairs = keys(text)
        if not words_:
            want[(i, 0, None, None)] += 1
            continue
        losses = []
        for m, counts in enumerate(models):
            own = [Counter(k) if m or i in chosen else Counter() for k in (words_, before, pairs)]
            total = sum(counts[0].values()) - sum(own[0].values())
            loss = 0.0
            for w, h, p in zip(words_, before, pairs, strict=True):
                single = (counts[0][w] - own[0][w] + 0.5) / (total + 0.5 * len(vocabulary))
                loss -= math.log((counts[2][p] - own[2][p] + 4 * single) / (counts[1][h] - own[1][h] + 4))
            losses.append(round(loss / len(words_), 9))
        want[(i, len(words_), *losses)] += 1
    have = Counter(
        (r["doc_id"], r["n_words"], *(None if v is None else round(v, 9) for v in (r["target_loss"], r["background_loss"])))
        for r in got
    )
    assert have == want
