"""The pipeline stage by stage against brute force, each on its own input."""

from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from kernspan.llm import quality
from kernspan.llm.tokens import vocabulary_path
from tests.llm.samples import base_failed, components, fingerprint, without_repeats, words
from tests.llm.test_tokens import check_packing, reference  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows before and after each stage, written and read as the check tool does."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = out[name] = spark.read.parquet(f"{folder}/{k}")
    return {name: df.orderBy("doc_id").collect() for name, df in out.items()}, out


def test_columns_and_order(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "substring_dedup", "source_mixing", "pack_sequences"]
    for name in names[:-1]:
        assert stages[1][name].columns == COLUMNS


def test_rules_keep_what_they_should(spark, sf, stages):
    rows, _ = stages
    scored, _ = quality.score_quality(stages[1]["documents"], spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r["doc_id"] for r in scored.where("kept").collect()}
    assert {r["doc_id"] for r in rows["quality_rules"]} == kept
    assert all(not base_failed(r["text"]) for r in rows["quality_rules"])
    texts = {r["doc_id"]: r["text"] for r in rows["documents"]}
    assert all(texts[r["doc_id"]] == r["text"] for r in rows["quality_rules"])
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    passed = {i for i in good if i in texts and not base_failed(texts[i])}
    assert len(passed & kept) >= 0.97 * len(passed)


def test_one_of_each_component(stages):
    rows = stages[0]["quality_rules"]
    roots = components([fingerprint(r["text"]) for r in rows])
    assert [r["doc_id"] for r in stages[0]["near_duplicates"]] == sorted({rows[k]["doc_id"] for k in roots})


def test_passages_are_cut(stages):
    rows = stages[0]["near_duplicates"]
    masks = without_repeats([(r["doc_id"], r["text"]) for r in rows])
    for before, after, mask in zip(rows, stages[0]["substring_dedup"], masks, strict=True):
        kept = [w for w, s in zip(words(before["text"]), mask, strict=True) if s]
        assert words(after["text"]) == kept
        if all(mask):
            assert after == before


def test_mixture_takes_about_its_share(stages):
    before, after = stages[0]["substring_dedup"], stages[0]["source_mixing"]
    total = lambda rows: sum(len(words(r["text"])) for r in rows)
    assert not set(map(tuple, after)) - set(map(tuple, before))
    longest = max(len(words(r["text"])) for r in before)
    leaves = len({(r["lang"], r["source"]) for r in before})
    assert 0.8 * total(before) - leaves <= total(after) <= 0.8 * total(before) + leaves * longest


def test_sequences_hold_every_id(stages, reference):  # noqa: F811
    rows = [tuple(r) for r in stages[0]["source_mixing"]]
    check_packing(rows, stages[0]["pack_sequences"], reference, 2_048)
    assert vocabulary_path().endswith(".json")


def test_run_gives_the_last_stage(spark, sf, stages):
    got = Counter(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert got == Counter(map(tuple, stages[0]["pack_sequences"]))


def test_every_operator_and_the_pipeline_are_registered(spark, sf):
    queries = __spark_entry__.queries()
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 11)) and "pipeline" in queries
    sizes = {"op7_": 50, "op4_": 50}
    for name, query in queries.items():
        if name.startswith("op") and name[2].isdigit():
            n = query(spark, sf).count()
            assert n >= sizes.get(name[:4], 40)
