"""Stages keep the user's columns, whatever they are called."""

import corpus_pipeline

NAMES = "n_words long, fail_bits long, kept int, base_failed string, n_lines int, spans string, unit int, part int, whole_row int, m int, body string, tokens string, __keep0 int"
GOOD = "The first words of a text that says enough to be kept by every rule of the policy and more."


def test_user_columns_survive(spark):
    own = tuple(range(2)) + (7, "x", 8, "s", 9, 10, 11, 12, "b", "t", 13)
    rows = [(i, GOOD + f" No {i}.", "en", f"s{i}", 5, *own) for i in range(3)] + [(4, "short", "en", "s4", 5, *own), (None, None, None, None, None, *own), (5, "", "en", "s1", 0, *own)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {NAMES}")
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {r for r in rows[:3]}
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.secret_scan):
        same = stage(spark, docs, "")
        assert same.columns == docs.columns
        assert sorted((tuple(r) for r in same.collect()), key=repr) == sorted(rows, key=repr)
    assert corpus_pipeline.quality_rules(spark, docs.where("false"), "").count() == 0
