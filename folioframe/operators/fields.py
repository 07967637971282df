"""Field location: anchors on a page, the transform they imply, and refinement by word boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions.geometry import RATIO, Box, expand_by_share, intersects
from folioframe.functions.numeric import clamp_sql, rnd_sql
from folioframe.functions.text import anchor_form, ratio_bound, sequence_ratio, similarity_form
from folioframe.operators.clusters import axis_clusters
from folioframe.operators.spatial import RATIO_TILE, crowded_keys, pair_overlaps
from folioframe.session import cut_lineage

FIELD = ["page_id", "field_id"]

# Limits of adaptive regions, anchors and transforms.
MIN_SIZE = 0.002
MIN_PROJECTED = 1e-6
MIN_TEXT_SIMILARITY = 0.70
MIN_SPREAD = 0.025
MAX_ERROR = 0.08


def search_words(fields: DataFrame, words: DataFrame) -> DataFrame:
    """Word boxes that strictly intersect the expanded region of a field."""
    region = expand_by_share(Box.of())
    windows = fields.select(
        *FIELD, region.x.alias("x_ratio"), region.y.alias("y_ratio"), region.w.alias("width_ratio"), region.h.alias("height_ratio")
    )
    pairs = pair_overlaps(
        windows, words, ["page_id"], RATIO, RATIO_TILE,
        lambda f, w: intersects(Box.field(f, RATIO), Box.field(w, RATIO)), crowded_keys(fields, words, ["page_id"]),
    )
    return pairs.select("page_id", F.col("l.field_id").alias("field_id"), *[F.col(f"r.{c}").alias(c) for c in words.columns if c != "page_id"])


def word_groups(words: DataFrame) -> DataFrame:
    """Words of a field as lines, and each line as groups of words that stand close together."""
    # Medians, lines and members each read the words, which mostly come from a join over tiles.
    words = cut_lineage(words)
    mids = words.groupBy(*FIELD).agg(
        F.expr("greatest(0.012D, median(greatest(0.001D, height_ratio)) * 0.65D)").alias("tol")
    )
    placed = words.join(mids, FIELD).withColumn("v", F.expr("y_ratio + height_ratio / 2"))
    lines = axis_clusters(placed, FIELD, "v", "tol", "mean").select(*FIELD, "v", F.col("cluster").alias("line"))
    item = F.struct("x_ratio", "v", "word_id", "y_ratio", "width_ratio", "height_ratio", "confidence", "text")
    packed = placed.join(lines, [*FIELD, "v"]).groupBy(*FIELD, "line").agg(F.array_sort(F.collect_list(item)).alias("items"))
    right = rnd_sql("p.l", 6) + " + " + rnd_sql("greatest(0D, p.r - p.l)", 6)
    fold = f"""aggregate(items, cast(array() AS array<struct<l:double,r:double,n:bigint,h:double,w:array<int>>>), (a, e) ->
      element_at(transform(array(try_element_at(a, -1)), p ->
        CASE WHEN p IS NOT NULL AND e.x_ratio - ({right}) <= greatest(0.03D, (p.h + e.height_ratio) / (p.n + 1) * 1.5D)
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('l', least(p.l, e.x_ratio), 'r', greatest(p.r, e.x_ratio + e.width_ratio), 'n', p.n + 1,
               'h', p.h + e.height_ratio, 'w', concat(p.w, array(cast(e.word_id AS int))))))
        ELSE concat(a, array(named_struct('l', e.x_ratio, 'r', e.x_ratio + e.width_ratio, 'n', 1L, 'h', e.height_ratio, 'w', array(cast(e.word_id AS int))))) END), 1))"""
    grouped = packed.withColumn("groups", F.expr(fold))
    members = "filter(items, i -> array_contains(g.w, cast(i.word_id AS int)))"
    flat = grouped.selectExpr(*FIELD, "line", "items", "posexplode(groups) AS (nth, g)").withColumn("members", F.expr(members))
    return flat.selectExpr(
        *FIELD, "line", "nth", "size(members) AS word_count", "array_join(transform(members, m -> m.text), ' ') AS text",
        rnd_sql("array_min(transform(members, m -> m.x_ratio))", 6) + " AS x_ratio",
        rnd_sql("array_min(transform(members, m -> m.y_ratio))", 6) + " AS y_ratio",
        rnd_sql("array_max(transform(members, m -> m.x_ratio + m.width_ratio)) - array_min(transform(members, m -> m.x_ratio))", 6) + " AS width_ratio",
        rnd_sql("array_max(transform(members, m -> m.y_ratio + m.height_ratio)) - array_min(transform(members, m -> m.y_ratio))", 6) + " AS height_ratio",
        rnd_sql("aggregate(members, 0D, (s, m) -> s + m.confidence) / size(members)", 4) + " AS ocr_confidence",
    )


def validate_groups(groups: DataFrame, fields: DataFrame) -> DataFrame:
    """Scores of every word group against its field, with the errors that rule it out."""
    window = expand_by_share(Box.of())
    roi = fields.select(
        *FIELD, *[F.col(n).alias(f"p_{n}") for n in RATIO], window.x.alias("s_x"), window.y.alias("s_y"), window.w.alias("s_w"), window.h.alias("s_h")
    )
    joined = groups.join(roi, FIELD).selectExpr(
        "*", "width_ratio * height_ratio AS area", "greatest(1e-6D, p_width_ratio * p_height_ratio) AS p_area",
        "(p_x_ratio + p_width_ratio / 2) - (x_ratio + width_ratio / 2) AS dx", "(p_y_ratio + p_height_ratio / 2) - (y_ratio + height_ratio / 2) AS dy",
        "greatest(0D, least(p_x_ratio + p_width_ratio, x_ratio + width_ratio) - greatest(p_x_ratio, x_ratio))"
        " * greatest(0D, least(p_y_ratio + p_height_ratio, y_ratio + height_ratio) - greatest(p_y_ratio, y_ratio)) AS common",
    ).selectExpr(
        "*", clamp_sql("area / greatest(1e-6D, s_w * s_h)") + " AS coverage",
        clamp_sql("1D - sqrt(dx * dx + dy * dy) / 0.20D") + " AS distance_score",
        clamp_sql("common / greatest(1e-6D, least(p_width_ratio * p_height_ratio, area))") + " AS overlap_score",
        clamp_sql("common / greatest(1e-6D, p_width_ratio * p_height_ratio + area - common)") + " AS iou_score",
        clamp_sql("least(p_width_ratio, width_ratio) / greatest(p_width_ratio, width_ratio, 1e-6D) * 0.35D"
                  " + least(p_height_ratio, height_ratio) / greatest(p_height_ratio, height_ratio, 1e-6D) * 0.35D"
                  " + least(p_width_ratio * p_height_ratio, area) / greatest(p_width_ratio * p_height_ratio, area, 1e-6D) * 0.30D") + " AS size_similarity",
        clamp_sql("1D - abs(dy) / greatest(p_height_ratio, 1e-6D)") + " AS line_score",
    ).selectExpr(
        "*", clamp_sql("ocr_confidence * 0.20D + least(1D, coverage / 0.35D) * 0.08D + least(1D, word_count / 3) * 0.07D + distance_score * 0.20D"
                       " + overlap_score * 0.20D + iou_score * 0.10D + size_similarity * 0.10D + line_score * 0.05D") + " AS adaptive",
    )
    errors = f"""array_compact(array(
        CASE WHEN NOT (x_ratio >= s_x AND y_ratio >= s_y AND x_ratio + width_ratio <= s_x + s_w + 1e-6D AND y_ratio + height_ratio <= s_y + s_h + 1e-6D) THEN 'outside_search_region' END,
        CASE WHEN width_ratio < {MIN_SIZE} OR height_ratio < {MIN_SIZE} THEN 'roi_too_small' END,
        CASE WHEN area > p_area * 4 THEN 'roi_too_large' END, CASE WHEN word_count <= 0 THEN 'word_count_zero' END,
        CASE WHEN coverage < 0.01 THEN 'coverage_too_low' END, CASE WHEN coverage > 0.92 THEN 'coverage_too_high' END,
        CASE WHEN adaptive < 0.25 THEN 'adaptive_confidence_too_low' END))"""
    rounded = [rnd_sql(n, 4) + f" AS {n}" for n in ("coverage", "distance_score", "overlap_score", "iou_score", "size_similarity", "line_score")]
    scored = joined.selectExpr(
        *FIELD, "line", "nth", "word_count", "text", *RATIO, "ocr_confidence", *rounded, rnd_sql("adaptive", 4) + " AS adaptive_confidence",
        f"{errors} AS errors", "CASE WHEN ocr_confidence < 0.20 THEN array('ocr_confidence_low') ELSE cast(array() AS array<string>) END AS warnings",
    )
    return scored.selectExpr(
        "*", "size(errors) = 0 AS passed",
        rnd_sql(clamp_sql("distance_score * 0.25D + overlap_score * 0.25D + iou_score * 0.15D + size_similarity * 0.15D + line_score * 0.10D"
                          " + ocr_confidence * 0.05D + least(1D, word_count / 3) * 0.05D"), 4) + " AS rank_score",
    )


def refine_fields(fields: DataFrame, words: DataFrame) -> DataFrame:
    """Every field with its refined region, or its own region and the reason for the fallback."""
    scored = validate_groups(word_groups(search_words(fields, words)), fields)
    order = W.partitionBy(*FIELD).orderBy(F.desc("passed"), F.desc("adaptive_confidence"), F.desc("rank_score"), "line", "nth")
    best = scored.withColumn("place", F.row_number().over(order)).filter("place = 1")
    renamed = best.select(
        *FIELD, "passed", "errors", "adaptive_confidence", "word_count", "coverage", "ocr_confidence", *[F.col(n).alias(f"a_{n}") for n in RATIO]
    )
    return fields.join(renamed, FIELD, "left").selectExpr(
        *FIELD, "CASE WHEN passed THEN 'refined' ELSE 'fallback' END AS status",
        *[f"CASE WHEN passed THEN a_{n} ELSE {n} END AS {n}" for n in RATIO],
        "CASE WHEN passed THEN NULL WHEN passed IS NULL THEN 'no_word_boxes_in_search_region' ELSE array_join(errors, ',') END AS fallback_reason",
        "coalesce(adaptive_confidence, 0D) AS adaptive_confidence", "coalesce(word_count, 0) AS word_count",
        "coalesce(coverage, 0D) AS coverage", "coalesce(ocr_confidence, 0D) AS ocr_confidence",
    )


def refinement_summary(refined: DataFrame) -> DataFrame:
    """Counts and means of a refinement, one row per page."""
    def mean(name: str) -> str:
        return rnd_sql(f"sum(cast(floor({name} * 10000D + 0.5D) AS bigint)) / 10000D / count(*)", 4)

    names = ("adaptive_confidence", "coverage", "ocr_confidence")
    return refined.groupBy("page_id").agg(
        F.count_if(F.col("status") == "refined").alias("refined"), F.count_if(F.col("status") == "fallback").alias("fallback"),
        *[F.expr(mean(n)).alias(f"average_{n}") for n in names],
    )


def locate_anchors(anchors: DataFrame, regions: DataFrame) -> DataFrame:
    """The region of a page that reads most like each anchor text, or why there is none.

    anchors: page_id, anchor_id, expected_text; regions: page_id, region_id, text. Ratios are computed only
    where lengths allow the needed similarity.
    """
    wanted = anchors.withColumn("expected", similarity_form(anchor_form(F.col("expected_text"))))
    # Equal texts of a page collapse to their first region before anything is compared.
    pages = regions.select("page_id", "region_id", similarity_form(anchor_form(F.col("text"))).alias("found")).groupBy("page_id", "found").agg(
        F.min("region_id").alias("region_id")
    )
    pairs = wanted.filter("expected <> ''").select("page_id", "anchor_id", "expected").join(pages, "page_id")
    inside, holds = F.contains(F.col("found"), F.col("expected")), F.contains(F.col("expected"), F.col("found"))
    need = (F.col("found") != "") & ~inside & (holds | (ratio_bound(F.col("expected"), F.col("found")) >= MIN_TEXT_SIMILARITY))
    ratio = sequence_ratio(F.col("expected"), F.col("found"), need)
    scored = pairs.withColumn("ratio", ratio).withColumn(
        "similarity",
        F.when(F.col("found") == "", F.lit(0.0)).when(inside, F.lit(1.0)).when(holds, F.greatest(F.col("ratio"), F.lit(0.9))).otherwise(F.col("ratio")),
    )
    best = scored.filter(F.col("similarity") >= MIN_TEXT_SIMILARITY).groupBy("page_id", "anchor_id").agg(
        F.max(F.struct("similarity", (-F.col("region_id")).alias("place"))).alias("best")
    )
    known = regions.select("page_id").distinct().withColumn("has_page", F.lit(True))
    return wanted.join(best, ["page_id", "anchor_id"], "left").join(known, "page_id", "left").selectExpr(
        "page_id", "anchor_id", "best IS NOT NULL AS matched", "-best.place AS region_id", rnd_sql("best.similarity", 4) + " AS similarity",
        "CASE WHEN expected = '' THEN 'expected_text_missing' WHEN has_page IS NULL THEN 'query_page_missing' WHEN best IS NULL THEN 'text_anchor_not_found' END AS failure_reason",
    )


def estimate_transforms(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """Transform of each page from its matched anchors: none, translation, similarity or affine.

    pairs: page_id, anchor_id, sx, sy, dx, dy. Four and more points use the mean translation and are flagged.
    """
    def mean(value: str) -> str:
        # Billionths as whole numbers: the same mean in whatever order tasks finish.
        return f"sum(cast(floor(({value}) * 1e9D + 0.5D) AS bigint)) / 1e9D / count(*)"

    sums = pairs.groupBy("page_id").agg(
        F.count("*").alias("n"), F.expr(mean("dx - sx")).alias("tx"), F.expr(mean("dy - sy")).alias("ty")
    )
    shift_error = pairs.join(sums, "page_id").groupBy("page_id").agg(
        F.expr(mean("sqrt((sx + tx - dx) * (sx + tx - dx) + (sy + ty - dy) * (sy + ty - dy))")).alias("shift_error")
    )
    few = sums.filter("n BETWEEN 2 AND 3").select("page_id")
    points = pairs.join(few, "page_id", "left_semi").groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("anchor_id", "sx", "sy", "dx", "dy"))).alias("p")
    )
    def length(a: int, b: int, side: str) -> str:
        return f"sqrt(power(p[{a}].{side}x - p[{b}].{side}x, 2) + power(p[{a}].{side}y - p[{b}].{side}y, 2))"

    def spread(side: str) -> str:
        return f"CASE WHEN size(p) = 2 THEN {length(0, 1, side)} ELSE greatest({length(0, 1, side)}, {length(0, 2, side)}, {length(1, 2, side)}) END"

    sx, sy, dx, dy = (f"(p[1].{c} - p[0].{c})" for c in ("sx", "sy", "dx", "dy"))
    ux, uy, vx, vy = (f"(p[2].{c} - p[0].{c})" for c in ("sx", "sy", "dx", "dy"))
    square, det = f"({sx} * {sx} + {sy} * {sy})", f"({sx} * {uy} - {sy} * {ux})"
    shaped = points.withColumn("spread", F.expr(f"least({spread('s')}, {spread('d')})")).selectExpr(
        "page_id", "p", "spread", "size(p) AS k",
        f"CASE WHEN size(p) = 2 THEN try_divide({dx} * {sx} + {dy} * {sy}, {square}) ELSE try_divide({dx} * {uy} - {vx} * {sy}, {det}) END AS a",
        f"CASE WHEN size(p) = 2 THEN -try_divide({dy} * {sx} - {dx} * {sy}, {square}) ELSE try_divide({vx} * {sx} - {dx} * {ux}, {det}) END AS b",
        f"CASE WHEN size(p) = 2 THEN try_divide({dy} * {sx} - {dx} * {sy}, {square}) ELSE try_divide({dy} * {uy} - {vy} * {sy}, {det}) END AS c",
        f"CASE WHEN size(p) = 2 THEN try_divide({dx} * {sx} + {dy} * {sy}, {square}) ELSE try_divide({vy} * {sx} - {dy} * {ux}, {det}) END AS d",
    ).selectExpr(
        "page_id", "k", "spread", "a", "b", "c", "d", "p[0].dx - a * p[0].sx - b * p[0].sy AS e", "p[0].dy - c * p[0].sx - d * p[0].sy AS f",
        "a IS NOT NULL AND abs(a * d - b * c) > 1e-6 AND sqrt(a * a + c * c) BETWEEN 0.25 AND 4 AND sqrt(b * b + d * d) BETWEEN 0.25 AND 4 AS valid",
    )
    joined = pages.select("page_id").join(sums, "page_id", "left").join(shift_error, "page_id", "left").join(shaped, "page_id", "left")
    solved = joined.selectExpr("*", f"coalesce(spread >= {MIN_SPREAD} AND valid, false) AS fitted").selectExpr(
        "page_id", "coalesce(n, 0L) AS anchors_matched", "tx", "ty", "a", "b", "c", "d", "e", "f", "fitted",
        "CASE WHEN fitted THEN 0D ELSE coalesce(shift_error, 0D) END AS error",
        f"""CASE WHEN n IS NULL THEN 'no_projection_anchors_matched' WHEN n >= 4 THEN 'homography_not_built'
             WHEN n = 3 AND spread < {MIN_SPREAD} THEN 'anchor_points_too_clustered_for_affine' WHEN n = 3 AND NOT fitted THEN 'affine_degenerate'
             WHEN n = 2 AND spread < {MIN_SPREAD} THEN 'anchor_points_too_clustered_for_partial_affine' WHEN n = 2 AND NOT fitted THEN 'partial_affine_degenerate' END AS note""",
    ).selectExpr("*", f"anchors_matched = 0 OR (anchors_matched >= 2 AND error > {MAX_ERROR}) AS falls_back")
    return solved.selectExpr(
        "page_id", "anchors_matched",
        "CASE WHEN falls_back THEN 'ratio_fallback' WHEN NOT fitted THEN 'translation' WHEN anchors_matched = 2 THEN 'partial_affine' ELSE 'affine' END AS method",
        "CASE WHEN falls_back THEN 1D WHEN fitted THEN a ELSE 1D END AS m11", "CASE WHEN falls_back THEN 0D WHEN fitted THEN b ELSE 0D END AS m12",
        "CASE WHEN falls_back THEN 0D WHEN fitted THEN e ELSE tx END AS m13", "CASE WHEN falls_back THEN 0D WHEN fitted THEN c ELSE 0D END AS m21",
        "CASE WHEN falls_back THEN 1D WHEN fitted THEN d ELSE 1D END AS m22", "CASE WHEN falls_back THEN 0D WHEN fitted THEN f ELSE ty END AS m23",
        rnd_sql("error", 4) + " AS reprojection_error", rnd_sql(clamp_sql(f"1D - error / {MAX_ERROR}D"), 4) + " AS projection_confidence",
        "CASE WHEN anchors_matched >= 2 AND falls_back THEN 'reprojection_error_too_high' ELSE note END AS fallback_reason",
    )


def project_fields(fields: DataFrame, transforms: DataFrame) -> DataFrame:
    """Field regions through the transform of their page, clipped; unusable results fall back to the field.

    transforms: page_id, m11..m23 and, for a full 3 x 3 matrix, m31..m33.
    """
    rows = ["m31", "m32", "m33"]
    full = set(rows) <= set(transforms.columns)
    corners = [("x_ratio", "y_ratio"), ("(x_ratio + width_ratio)", "y_ratio"), ("(x_ratio + width_ratio)", "(y_ratio + height_ratio)"),
               ("x_ratio", "(y_ratio + height_ratio)")]
    scale = [f"(m31 * {x} + m32 * {y} + m33)" if full else "1D" for x, y in corners]
    xs = ", ".join(f"(m11 * {x} + m12 * {y} + m13) / {s}" for (x, y), s in zip(corners, scale))
    ys = ", ".join(f"(m21 * {x} + m22 * {y} + m23) / {s}" for (x, y), s in zip(corners, scale))
    shaped = fields.join(transforms, "page_id").selectExpr(
        *FIELD, *RATIO, f"least({xs}) AS l", f"greatest({xs}) AS r", f"least({ys}) AS t", f"greatest({ys}) AS b"
    ).selectExpr(
        *FIELD, *RATIO, "l < 0 OR t < 0 OR r > 1 OR b > 1 AS outside",
        *[rnd_sql(clamp_sql(v), 6) + f" AS c{v}" for v in ("l", "t")],
        rnd_sql(clamp_sql("r") + " - " + clamp_sql("l"), 6) + " AS cw", rnd_sql(clamp_sql("b") + " - " + clamp_sql("t"), 6) + " AS ch",
        rnd_sql(clamp_sql("x_ratio"), 6) + " AS fx", rnd_sql(clamp_sql("y_ratio"), 6) + " AS fy",
        rnd_sql("greatest(0D, least(1D - " + clamp_sql("x_ratio") + ", width_ratio))", 6) + " AS fw",
        rnd_sql("greatest(0D, least(1D - " + clamp_sql("y_ratio") + ", height_ratio))", 6) + " AS fh",
    )
    size = MIN_PROJECTED
    return shaped.selectExpr("*", f"cw > {size}D AND ch > {size}D AS fits", f"fw > {size}D AND fh > {size}D AS template_fits").selectExpr(
        *FIELD, *[f"CASE WHEN NOT fits AND template_fits THEN {f} ELSE {c} END AS {n}" for n, f, c in
                  zip(RATIO, ("fx", "fy", "fw", "fh"), ("cl", "ct", "cw", "ch"))],
        "fits OR template_fits AS valid", "outside AS outside_image_clipped", "NOT fits AS zero_area",
        "CASE WHEN NOT fits AND template_fits THEN 'invalid_projection_fallback_to_template_roi' END AS fallback_reason",
    )


def field_tests(results: DataFrame) -> DataFrame:
    """Tested, passed and failed fields per template: text needs a reading, images need a region."""
    ok = F.expr(
        "coalesce(CASE WHEN data_type = 'image' THEN width_ratio > 0 AND height_ratio > 0 ELSE trim(coalesce(actual_text, '')) <> '' AND error IS NULL END, false)"
    )
    return results.withColumn("ok", ok).groupBy("template_id").agg(
        F.count("*").alias("tested"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed")
    )
