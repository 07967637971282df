"""Staged tables."""

from pyspark.sql import functions as F

from folioframe.operators import fields as loc
from folioframe.session import BROADCAST_ROWS, cut_lineage


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_staged_table_of_many_rows_is_not_broadcast(spark):
    """Its files are far below the threshold, its rows are not."""
    wide = spark.range(BROADCAST_ROWS + 1).select("id", F.lit("one label").alias("label"))
    staged = cut_lineage(wide)
    other = spark.range(10 * BROADCAST_ROWS).withColumn("v", F.col("id") * 2)
    for joined in (other.join(staged, "id"), other.join(staged.select("id").distinct(), "id", "left_semi")):
        assert "BroadcastHashJoin" not in _plan(joined)
    assert other.join(staged, "id").count() == BROADCAST_ROWS + 1


def test_empty_and_small_staged_tables(spark):
    small = cut_lineage(spark.range(3))
    assert sorted(r.id for r in small.collect()) == [0, 1, 2]
    assert "BroadcastHashJoin" in _plan(spark.range(10_000_000).join(small, "id"))
    assert cut_lineage(spark.range(3).filter("id > 5")).isEmpty()
    assert cut_lineage(spark.range(3).filter("1 = 0")).isEmpty()


def test_word_groups_search_the_words_once(spark):
    """What a join over tiles found is staged before medians, lines and members each read it."""
    names = "page_id long, {} int, x_ratio double, y_ratio double, width_ratio double, height_ratio double"
    fields = spark.createDataFrame([(1, 1, 0.1, 0.1, 0.5, 0.1)], names.format("field_id"))
    words = spark.createDataFrame(
        [(1, 1, 0.1, 0.1, 0.1, 0.02, "a", 0.5), (1, 2, 0.22, 0.1, 0.1, 0.02, "b", 0.7)], names.format("word_id") + ", text string, confidence double"
    )
    groups = loc.word_groups(loc.search_words(fields, words))
    assert "tile_x" not in _plan(groups)
    assert [(r.text, r.word_count, r.ocr_confidence) for r in groups.collect()] == [("a b", 2, 0.6)]
