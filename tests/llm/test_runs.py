"""Periodic runs against brute force over every period."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernspan.llm import periodicruns
from kernspan.llm.queries import op13_periodic_runs, with_repeats
from tests.llm.samples import documents, frame, words


def brute(ws) -> list[tuple[int, int, int]]:
    """(start, length, period) by the definition."""
    n, out = len(ws), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            s, e = i, j + q
            smaller = any(all(ws[k] == ws[k + d] for k in range(s, e - d)) for d in range(1, q))
            if e - s >= max(6, 4 * q) and not smaller:
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng: random.Random) -> list[int]:
    size = rng.choice([1, 2, 3, 5, 50])
    ws = [rng.randrange(size) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 4)):
        block = [rng.randrange(size) for _ in range(rng.randint(1, 9))]
        long = rng.randint(2, 40)
        at = rng.randint(0, len(ws))
        ws[at:at] = (block * long)[:long]
    return ws


@pytest.mark.parametrize("seed", range(3))
def test_grammar_finds_the_runs_of_every_document(seed):
    rng, seen = random.Random(seed), 0
    for _ in range(150):
        docs = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        ids = np.array([w for d in docs for w in d], np.int64)
        want = [brute(d) for d in docs]
        assert periodicruns.find_runs(ids, np.array([len(d) for d in docs])) == want
        assert [periodicruns.runs_by_period(np.array(d, np.int64)) for d in docs] == want
        seen += sum(map(len, want))
    assert seen > 300


def test_grammar_derives_the_text():
    rng = random.Random(4)
    for _ in range(100):
        ids = np.array(repetitive(rng), np.int64)
        g = periodicruns.re_pair(ids, np.zeros(len(ids), np.int64))
        spelled = {}
        for rule, a, m, b in zip(g.rule, g.start, g.middle, g.end):
            assert a < m < b
            same = spelled.setdefault(int(rule), (ids[a:b].tolist(), int(m - a)))
            assert same == (ids[a:b].tolist(), int(m - a))
        assert len(set(g.middle.tolist())) == len(g.middle)
        for rule in set(g.rule.tolist()):
            assert (g.rule == rule).sum() >= 1


@pytest.mark.parametrize("name", ["one word", "two words", "fibonacci", "long period"])
def test_long_documents(name):
    n = 30_000
    rng = np.random.default_rng(2)
    if name == "one word":
        ids, want = np.zeros(n, np.int64), [(0, n, 1)]
    elif name == "long period":
        ids, want = np.tile(np.arange(n // 5), 5), [(0, n // 5 * 5, n // 5)]
    elif name == "two words":
        ids = rng.integers(0, 2, n)
        want = periodicruns.runs_by_period(ids[:3000])
        ids = ids[:3000]
    else:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        ids, want = np.array(b[:n]), []
    assert periodicruns.find_runs(ids, np.array([len(ids)])) == [want]


def digests(row_id, ws):
    runs = brute(ws)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    s, length, q = best or (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)]
    return (row_id, len(runs), s, length, q, best and 1000 * length // q, *sha, len(ws))


def rewritten(row_id, ws):
    if row_id is None or not ws:
        return ws
    h = zlib.crc32(str(row_id).encode())
    if h % 10:
        return ws
    g, n = h // 10, len(ws)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[a + (i - a) % p] if i >= a else w for i, w in enumerate(ws)]


def awkward():
    rows = [r for r in documents() if len(r[1] or "") < 6_000]
    rows += [(i, " ".join(words(rows[3][1])[: i % 40]), "en", "s", 0) for i in range(1000, 1150)]
    rows += [(2000, "a\x0bb\x0ca\rb\na\tb a b a b c d", "en", "s", 0), (2001, "x x " * 9, "en", "s", 0)]
    return rows


def test_documents_with_awkward_rows(spark, tmp_path):
    rows = awkward()
    docs = frame(spark, rows, clashes=True).withColumn("runs", F.lit("x")).withColumn("collapsed", F.lit("x"))
    got = [tuple(r) for r in periodicruns.with_digests(periodicruns.periodic_runs(docs)).collect()]
    assert sorted(got, key=str) == sorted((digests(r[0], words(r[1])) for r in rows), key=str)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((digests(r[0], rewritten(r[0], words(r[1]))) for r in rows), key=str)
    assert sum(r[1] for r in got) > 10


def test_chunks_of_any_size_and_empty_tables(spark, monkeypatch):
    rows = awkward()
    texts = [r[1].encode() if r[1] is not None else None for r in rows]
    whole = [w for chunk in periodicruns._chunks(texts) for w in chunk]
    monkeypatch.setattr(periodicruns, "CHUNK_WORDS", 50)
    assert [w for chunk in periodicruns._chunks(texts) for w in chunk] == whole
    empty = with_repeats(frame(spark, []))
    assert periodicruns.with_digests(periodicruns.periodic_runs(empty)).collect() == []
