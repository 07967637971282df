"""Table regions by line topology. Line positions of a table sit in one row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame

from folioframe.functions.numeric import clamp_sql, rnd_sql

# Smallest bands and regions, line coverage, and what a split needs.
BAND_SHARE = 0.12
LINE_IN_BAND = 0.18
FULL_LINE = 0.72
FULL_GRID = 0.80
MIN_CONFIDENCE = 0.72
MIN_CHANGE = 0.33


def split_regions(lines: DataFrame) -> DataFrame:
    """Whether a table splits where the number of vertical segments changes, and the regions.

    lines: table_id, width, height, horizontals ARRAY<INT>, verticals ARRAY<STRUCT<x, top, bottom>>.
    """
    edges = "concat(array(0), horizontals, array(height))"
    bands = (
        f"filter(transform(sequence(0, size(horizontals)), i -> named_struct('top', get({edges}, i), 'bottom', get({edges}, i + 1))),"
        f" b -> b.bottom - b.top >= greatest(24, cast(floor(height * {BAND_SHARE}D) AS int)))"
    )
    crossing = (
        "size(filter(verticals, v -> v.x BETWEEN 2 AND width - 3 AND"
        f" greatest(0, least(v.bottom, b.bottom) - greatest(v.top, b.top)) >= {LINE_IN_BAND}D * (b.bottom - b.top)))"
    )
    step = lines.selectExpr("*", f"{bands} AS bands").selectExpr("*", f"transform(bands, b -> {crossing}) AS counts").selectExpr(
        "*", "size(filter(sequence(1, greatest(1, size(counts) - 1)), i -> i < size(counts) AND get(counts, i) <> get(counts, i - 1))) AS changes",
        "size(array_distinct(counts)) AS kinds",
        "size(filter(verticals, v -> greatest(0, least(v.bottom, array_max(horizontals)) - greatest(v.top, array_min(horizontals)))"
        f" / greatest(1, array_max(horizontals) - array_min(horizontals)) >= {FULL_LINE}D)) / greatest(1, size(verticals)) AS full_ratio",
    ).selectExpr("*", "changes / greatest(1, size(bands) - 1) AS ratio")
    runs = """aggregate(sequence(0, size(bands) - 1), cast(array() AS array<struct<top:int,bottom:int,n:int>>), (a, i) ->
        CASE WHEN size(a) > 0 AND try_element_at(a, -1).n = get(counts, i)
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('top', try_element_at(a, -1).top, 'bottom', get(bands, i).bottom, 'n', get(counts, i))))
        ELSE concat(a, array(named_struct('top', get(bands, i).top, 'bottom', get(bands, i).bottom, 'n', get(counts, i)))) END)"""
    step = step.selectExpr(
        "*", f"CASE WHEN size(bands) >= 2 THEN filter({runs}, r -> r.bottom - r.top >= height * {BAND_SHARE}D) END AS regions",
        rnd_sql(clamp_sql("least(1D, size(horizontals) / 8 * 0.45D + size(verticals) / 6 * 0.35D) + least(1D, ratio) * 0.45D"), 4) + " AS strength",
    )
    reason = f"""CASE WHEN size(horizontals) < 4 OR size(verticals) < 3 THEN 'insufficient_grid_lines' WHEN size(bands) < 2 THEN 'single_grid_topology'
        WHEN full_ratio >= {FULL_GRID} THEN 'full_vertical_grid' WHEN changes <= 0 OR kinds < 2 THEN 'no_topology_change'
        WHEN size(regions) < 2 THEN 'region_split_not_confident' WHEN strength >= {MIN_CONFIDENCE} AND ratio >= {MIN_CHANGE} THEN 'topology_change_detected'
        ELSE 'low_topology_confidence' END"""
    return step.selectExpr("*", f"{reason} AS reason").selectExpr(
        "table_id", "reason", "reason = 'topology_change_detected' AS detected",
        "CASE WHEN reason IN ('topology_change_detected', 'low_topology_confidence') THEN strength ELSE 0D END AS confidence",
        "CASE WHEN reason = 'topology_change_detected' THEN regions ELSE filter(regions, r -> false) END AS regions",
    )
