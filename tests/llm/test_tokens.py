"""Token counts under edits and packing, against the tokenizer itself."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kernspan.llm import editcounts, packing
from kernspan.llm.queries import derived_edits
from kernspan.llm.tokens import ChunkTokenizer, vocabulary_path
from tests.llm.samples import documents, frame, prose

ALPHABET = "ab  \n\t'sdlvre123é ñ中文🙂.,!?ABC  ́\x1c<|endoftext|>"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def chunked():
    return ChunkTokenizer(vocabulary_path())


def noise(rng: random.Random, most: int) -> str:
    return "".join(rng.choices(ALPHABET, k=rng.randrange(most)))


def test_ids_are_those_of_the_tokenizer(reference, chunked):
    rng = random.Random(3)
    for text in [noise(rng, 60) for _ in range(3_000)] + [r[1] for r in documents()]:
        assert chunked.ids(text).tolist() == list(reference(text))


def test_memory_starts_anew(reference, monkeypatch):
    monkeypatch.setattr("kernspan.llm.tokens.KNOWN_CHUNKS", 20)
    small, text = ChunkTokenizer(vocabulary_path()), prose(5, 300)
    assert small.ids(text).tolist() == list(reference(text))


def test_edits_follow_the_tokenizer(reference, chunked):
    rng = random.Random(9)
    for round_ in range(60):
        text = prose(round_, rng.randrange(400)) if round_ % 3 else noise(rng, 300)
        counted = editcounts.CountedText.build(chunked, text)
        assert counted.n_tokens == len(reference(text))
        for _ in range(25):
            at, removed = rng.randrange(len(text) + 3), rng.choice([0, 1, 2, 7, 40, 500])
            inserted = rng.choice(["", " ", "x", "  \n", noise(rng, 12), prose(at, 80)])
            counted.edit(at, removed, inserted)
            at = min(at, len(text))
            text = text[:at] + inserted + text[at + removed :]
            assert counted.text == text
            assert (counted.n_tokens, counted.n_chars) == (len(reference(text)), len(text))


def test_an_edit_touches_little(chunked):
    counted = editcounts.CountedText.build(chunked, prose(1, 20_000))
    counted.edit(40_000, 3, "new words")
    assert counted.reencoded < 2_000


def test_edits_of_a_table(spark, reference):
    rows = documents()
    docs = frame(spark, rows, clashes=True).withColumn("edits", derived_edits())
    plain = docs.select("doc_id", "text", "edits").collect()
    done = editcounts.apply_edits(editcounts.count_tokens(docs))
    assert set(docs.columns) - {"edits"} <= set(done.columns)
    want = Counter()
    for r in plain:
        text = r["text"] or ""
        for e in r["edits"]:
            text = text[: e["at"]] + (e["inserted"] or "") + text[e["at"] + e["removed"] :]
        want[(r["doc_id"], text, len(reference(r["text"])), len(reference(text)), len(text))] += 1
    got = Counter(
        (r["doc_id"], r["text"], r["n_tokens_before"], r["n_tokens"], r["n_chars"]) for r in done.collect()
    )
    assert got == want
    assert all(r["token_sums"][1] == r["n_tokens"] for r in done.collect())


def test_null_edits_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, "some text", None), (2, None, [(None, None, "in")]), (3, "abc", [(-5, 99, None), None])],
        "doc_id long, text string, edits array<struct<at:int,removed:int,inserted:string>>",
    )
    done = editcounts.apply_edits(editcounts.count_tokens(docs))
    assert [r["text"] for r in done.orderBy("doc_id").collect()] == ["some text", "in", ""]
    assert editcounts.apply_edits(editcounts.count_tokens(docs.limit(0))).count() == 0


# ----------------------------------------------------------------------------- packing


def check_packing(rows, pieces, reference, capacity):
    ids = [np.array([*reference(r[1]), packing.END_ID], "<u4") for r in rows]
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    for doc_id in {r[0] for r in rows}:
        own = [i for i, r in enumerate(rows) if r[0] == doc_id]
        found = Counter((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in by_doc[doc_id])
        if len(own) == 1:
            at = 0
            for start, length, crc, n in sorted(found):
                assert start == at and n == len(ids[own[0]])
                assert crc == zlib.crc32(ids[own[0]][start : start + length].tobytes())
                at += length
            assert at == len(ids[own[0]])
        else:
            assert sum(n * k[1] for k, n in found.items()) == sum(len(ids[i]) for i in own)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


@pytest.mark.parametrize(("capacity", "shard_docs"), [(2048, 2_000), (64, 5)])
def test_packing_places_every_id_once(spark, reference, capacity, shard_docs):
    rows = documents()
    docs = frame(spark, rows, clashes=True)
    got = packing.pack_documents(docs, capacity=capacity, shard_docs=shard_docs).collect()
    sequences = check_packing(rows, got, reference, capacity)
    total = sum(p["length"] for p in got)
    shards = -(-len(rows) // shard_docs)
    assert len(sequences) <= total // capacity + shards


def test_packing_balances_cost():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 2_048) for _ in range(800)] + [0, 2_048]
    sequences = packing.pack(lengths, 2_048)
    assert len(sequences) == -(-sum(lengths) // 2_048)
    placed = Counter()
    for parts in sequences:
        assert sum(n for _, _, n in parts) <= 2_048
        for d, start, n in parts:
            placed.update((d, start + k) for k in range(n))
    assert placed == Counter((d, k) for d, n in enumerate(lengths) for k in range(n))
    costs = [sum(packing.cost(n) for _, _, n in parts) for parts in sequences]
    assert max(costs) <= packing.cost(2_048) and np.std(costs) < 0.2 * np.mean(costs)


def test_packing_nothing(spark):
    assert packing.pack_documents(frame(spark, [])).count() == 0
    one = packing.pack_documents(frame(spark, [(1, None, None, None, None)])).collect()
    assert [(p["length"], p["doc_tokens"], p["ids_crc32"]) for p in one] == [(1, 1, zlib.crc32(b"\1\0\0\0"))]
