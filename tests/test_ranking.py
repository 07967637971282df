"""Pages ranked batch by batch against pages ranked pair by pair."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import ranking, retrieval, signature

REGION = "page_id long, region_id int, label string, x_ratio double, y_ratio double, width_ratio double, height_ratio double, confidence double"
KEYS = ("page_id", "rank", "template_id", "template_page_id", "template_page_number", "score")


def layouts(spark, low, n, seed):
    pick = random.Random(seed)
    pages = [(low + i, i // 3, i % 3 + 1, 800 + 100 * (i % 3), 1000) for i in range(n)]
    found = [(low + i, r, pick.choice(["text", "table", "image"]), *[pick.randrange(1, 9) / 10 for _ in range(4)], 0.9) for i in range(n) for r in range(pick.choice([0, 1, 4, 9]))]
    regions = signature.usable_regions(spark.createDataFrame(found, REGION))
    return signature.layout_signatures(spark.createDataFrame(pages, "page_id long, doc_id long, page_number int, image_width int, image_height int"), regions, maskable=True)


@pytest.fixture(scope="module")
def sides(spark):
    mask = "named_struct('x_ratio', 0D, 'y_ratio', 0D, 'width_ratio', 0.6D, 'height_ratio', {h}D)"
    stored = layouts(spark, 1000, 12, 5).drop("doc_id").withColumnRenamed("page_id", "template_page_id").selectExpr(
        "*", "template_page_id div 2 AS template_id", "CASE template_page_id % 4 WHEN 0 THEN 'main_page' WHEN 1 THEN 'all_pages' END AS detection_mode", "1 AS main_page_number",
        "CASE WHEN template_page_id % 5 > 0 THEN cast(template_page_id div 4 AS int) END AS template_version", f"CASE WHEN template_page_id % 3 = 0 THEN array({mask.format(h=0.7)}, {mask.format(h=0)}) END AS template_masks",
    )
    return layouts(spark, 0, 40, 4).localCheckpoint(), stored.localCheckpoint()


def told(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("k, include, newest, held", [(5, None, None, 1_000_000), (2, 503, "template_version", 30), (None, None, None, 30)])
def test_same_ranking(spark, sides, monkeypatch, k, include, newest, held):
    monkeypatch.setattr(ranking, "HELD_SCORES", held)
    pages, stored = sides
    got = retrieval.ranked_templates(pages, stored, k, include, newest)
    want = retrieval.top_templates(retrieval.score_pairs(retrieval.route_pairs(pages, stored)), k, include, newest)
    names = [*KEYS, "doc_id", *retrieval.SCORES]
    assert told(got, *names) == told(want, *names) and got.count() > 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_same_pairs(spark, sides):
    pages, stored = sides
    names = ["page_id", "template_page_id", "score", *retrieval.SCORES]
    want = told(retrieval.score_pairs(retrieval.route_pairs(pages, stored)), *names)
    assert told(retrieval.scored_templates(pages, stored), *names) == want and want


def test_large_catalog_is_joined(spark, sides, monkeypatch):
    monkeypatch.setattr(retrieval, "CATALOG_ROWS", 3)
    pages, stored = sides
    got = retrieval.ranked_templates(pages, stored)
    monkeypatch.undo()
    assert told(got, *KEYS) == told(retrieval.ranked_templates(pages, stored), *KEYS)


def test_no_templates(spark, sides):
    pages, stored = sides
    assert retrieval.ranked_templates(pages, stored.filter(F.lit(False))).count() == 0
