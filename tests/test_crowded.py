"""Pairs of boxes with and without tiles."""

import pytest

from folioframe.functions.geometry import PIXEL, Box, intersection
from folioframe.operators import spatial, suppress


def _boxes(spark, n, seed):
    return spark.range(n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS page", "id AS box_id", f"cast(abs(hash(id, {seed})) % 900 - 50 AS double) AS x", f"cast(abs(hash(id, {seed + 1})) % 900 - 50 AS double) AS y",
        f"cast(abs(hash(id, {seed + 2})) % 300 AS double) AS width", f"cast(abs(hash(id, {seed + 3})) % 300 AS double) AS height",
    )


@pytest.mark.parametrize("crowd", [0, 256, 10**9])
def test_pairs_are_the_same_whatever_is_tiled(spark, monkeypatch, crowd):
    monkeypatch.setattr(spatial, "CROWD", crowd)
    left, right = _boxes(spark, 600, 1), _boxes(spark, 600, 7)
    touch = lambda l, r: intersection(Box.field(l, PIXEL), Box.field(r, PIXEL)) > 0
    crowded = spatial.crowded_keys(left, right, ["page"])
    if crowd == 256:
        assert [r.page for r in crowded.collect()] == [1]
    got = sorted((r.page, r.l.box_id, r.r.box_id) for r in spatial.pair_overlaps(left, right, ["page"], PIXEL, 128.0, touch, crowded).collect())
    want = sorted((r.page, r.l.box_id, r.r.box_id) for r in spatial.pair_overlaps(left, right, ["page"], PIXEL, 128.0, touch).collect())
    assert got == want and len(set(got)) == len(got) > 1000


def test_boxes_of_small_pages_are_not_copied(spark):
    left, right = _boxes(spark, 600, 1).filter("page > 1"), _boxes(spark, 600, 7).filter("page > 1")
    crowded = spatial.crowded_keys(left, right, ["page"])
    assert spatial.tiles_of(left, ["page"], PIXEL, 128.0, crowded).count() == left.count()
    assert spatial.with_tiles(left, Box.of(PIXEL), 128.0).count() > 800


@pytest.mark.parametrize("rule", [suppress.DETECTED_DUPLICATE, suppress.LAYOUT_NESTED])
def test_suppression_is_the_same_whatever_is_tiled(spark, monkeypatch, rule):
    kept = []
    for crowd in (0, 64, 10**9):
        monkeypatch.setattr(spatial, "CROWD", crowd)
        rows = suppress.greedy_keep(_boxes(spark, 300, 3), ["page"], "box_id", PIXEL, 128.0, rule).collect()
        kept.append(sorted(r.box_id for r in rows))
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) < 300


def test_suppression_copies_no_box_of_a_small_page(spark, monkeypatch):
    seen = []
    whole = suppress.cut_lineage
    monkeypatch.setattr(suppress, "cut_lineage", lambda df: seen.append(whole(df)) or seen[-1])
    boxes = spark.range(400).selectExpr("id div 4 AS page", "id AS box_id", "cast(id % 4 AS double) AS x", "0D AS y", "600D AS width", "600D AS height")
    suppress.greedy_keep(boxes, ["page"], "box_id", PIXEL, 128.0, suppress.DETECTED_DUPLICATE).count()
    loses = next(df for df in seen if "top" in df.columns)
    assert loses.count() == 300  # all but the first box of each page, once
