"""Quality rules: statistics against brute force, learned lists, and awkward rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kernspan.llm import quality
from tests.llm.samples import base_failed, documents, frame, prose, statistics

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus():
    good = [(i, prose(i, 90), "en", "s", 0) for i in range(1, 121)]
    junk = [(1_000 + i, " ".join(f"{w}$$" for w in prose(i, 90).split()), "en", "s", 0) for i in range(60)]
    loud = [(2_000 + i, prose(500 + i, 90).upper(), "en", "s", 0) for i in range(60)]
    return good, junk, loud


def test_statistics_equal_brute_force(spark):
    rows = documents()
    got = frame(spark, rows, clashes=True).select("text", quality.text_statistics("text").alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r["s"][n] for n in NAMES) == statistics(r["text"])


def test_learned_list_separates_and_orders(spark):
    good, junk, loud = corpus()
    marks = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in junk + loud]
    scored, rules = quality.score_quality(frame(spark, good + junk + loud), labels(spark, marks))
    kept = {r["doc_id"] for r in scored.where("kept").collect()}
    assert kept == {r[0] for r in good if not base_failed(r[1])}
    assert 1 <= len(rules) <= 12
    assert all(1 <= len(rule.literals) <= 3 for rule in rules)


def test_verdict_is_the_ordered_conditional(spark):
    rules = [
        quality.Rule((quality.Literal("symbols_per_word", True, 0.1), quality.Literal("words", False, 128.0))),
        quality.Rule((quality.Literal("repeat_share", True, 0.3),)),
    ]
    rows = frame(spark).select("text", quality.text_statistics("text").alias("s")).select("text", "s.*")
    stat = {n: F.col(n) for n in quality.STATISTICS}
    for r in rows.withColumn("kept", quality.verdict(rules, stat)).collect():
        n = r["n_words"]
        first = n > 0 and r["n_symbols"] / n > 0.1 and n <= 128
        second = n > 0 and r["n_repeat_words"] / n > 0.3
        assert r["kept"] == (not first and not second)


def test_no_labels_no_rules_and_empty_tables(spark):
    scored, rules = quality.score_quality(frame(spark), labels(spark, []))
    assert rules == []
    for r in scored.collect():
        assert r["kept"] == (not r["base_failed"])
    scored, _ = quality.score_quality(frame(spark, []), labels(spark, [(1, 0, 0)]))
    assert scored.count() == 0


def test_awkward_labels(spark):
    good, junk, _ = corpus()
    marks = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in junk]
    marks += [(None, 0, 0), (5, None, 1), (good[0][0], 1, 0), (good[0][0], 0, 0), (9_999_999, 0, 0)]
    _, rules = quality.score_quality(frame(spark, good + junk), labels(spark, marks))
    assert rules


def test_keeping_rows_keeps_columns(spark):
    good, junk, _ = corpus()
    marks = labels(spark, [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in junk])
    docs = frame(spark, good + junk + documents(), clashes=True)
    kept = quality.keep_quality(docs, marks)
    assert kept.columns == docs.columns
    scored, _ = quality.score_quality(docs, marks)
    assert kept.count() == scored.where("kept").count()
    assert kept.where("text is null").count() == 0


def test_no_python_in_the_plan(spark):
    plan = frame(spark).select(quality.text_statistics("text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
