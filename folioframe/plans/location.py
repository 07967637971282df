"""Anchors, transforms and adaptive refinement of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.numeric import rnd_sql
from folioframe.operators import fields as loc
from folioframe.plans import cleanup, derive
from folioframe.plans.derive import oracle, sql, table
from folioframe.plans.registry import query
from folioframe.plans.sqltext import clamp, rnd

# Words of a page: two per line item, side by side.
sql("words", """
SELECT page_id, line_id * 2 + k.k AS word_id, 'w' || (line_id * 2 + k.k) AS text, x_ratio + k.k * (width_ratio / 2 + 0.01::DOUBLE) AS x_ratio,
  y_ratio + k.k * 0.002::DOUBLE AS y_ratio, width_ratio / 2 AS width_ratio, height_ratio, CAST(10 + (page_id + line_id * 7) % 90 AS DOUBLE) / 100 AS confidence
FROM lines, unnest([0, 1]) AS k(k)""", "lines")


def words(spark: SparkSession, sf: str) -> DataFrame:
    return cleanup.lines(spark, sf).selectExpr("*", "explode(array(0, 1)) AS k").selectExpr(
        "page_id", "line_id * 2 + k AS word_id", "concat('w', line_id * 2 + k) AS text", "x_ratio + k * (width_ratio / 2 + 0.01D) AS x_ratio",
        "y_ratio + k * 0.002D AS y_ratio", "width_ratio / 2 AS width_ratio", "height_ratio", "cast(10 + (page_id + line_id * 7) % 90 AS double) / 100 AS confidence",
    )


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    return cleanup.fields(spark, sf).select("page_id", "field_id", "x_ratio", "y_ratio", "width_ratio", "height_ratio")


FOUND = f"""win AS (SELECT *, {rnd('greatest(0.0::DOUBLE, x_ratio - width_ratio * 0.15::DOUBLE)', 6)} AS sx, {rnd('greatest(0.0::DOUBLE, y_ratio - height_ratio * 0.15::DOUBLE)', 6)} AS sy,
   {rnd('greatest(0.0::DOUBLE, least(1.0::DOUBLE, x_ratio + width_ratio + width_ratio * 0.15::DOUBLE) - greatest(0.0::DOUBLE, x_ratio - width_ratio * 0.15::DOUBLE))', 6)} AS sw,
   {rnd('greatest(0.0::DOUBLE, least(1.0::DOUBLE, y_ratio + height_ratio + height_ratio * 0.15::DOUBLE) - greatest(0.0::DOUBLE, y_ratio - height_ratio * 0.15::DOUBLE))', 6)} AS sh FROM fields),
found AS (SELECT f.page_id, f.field_id, w.word_id, w.text, w.x_ratio, w.y_ratio, w.width_ratio, w.height_ratio, w.confidence FROM win f JOIN words w ON w.page_id = f.page_id
   AND f.sx < w.x_ratio + w.width_ratio AND f.sx + f.sw > w.x_ratio AND f.sy < w.y_ratio + w.height_ratio AND f.sy + f.sh > w.y_ratio)"""


@query("join08_search_words", oracle(f"WITH {FOUND} SELECT page_id, field_id, word_id FROM found", "fields", "words"))
def search_words(spark: SparkSession, sf: str) -> DataFrame:
    return loc.search_words(_fields(spark, sf), words(spark, sf)).select("page_id", "field_id", "word_id")


GROUPED = f"""{FOUND},
m AS (SELECT *, y_ratio + height_ratio / 2 AS v, row_number() OVER (PARTITION BY page_id, field_id ORDER BY y_ratio + height_ratio / 2, x_ratio, word_id) AS rn,
   greatest(0.012::DOUBLE, median(greatest(0.001::DOUBLE, height_ratio)) OVER (PARTITION BY page_id, field_id) * 0.65::DOUBLE) AS tol FROM found),
lw AS (SELECT page_id, field_id, word_id, rn, v AS s, 1::BIGINT AS n, 1 AS line FROM m WHERE rn = 1
  UNION ALL SELECT m.page_id, m.field_id, m.word_id, m.rn, CASE WHEN abs(m.v - lw.s / lw.n) <= m.tol THEN lw.s + m.v ELSE m.v END, CASE WHEN abs(m.v - lw.s / lw.n) <= m.tol THEN lw.n + 1 ELSE 1 END,
    CASE WHEN abs(m.v - lw.s / lw.n) <= m.tol THEN lw.line ELSE lw.line + 1 END FROM lw JOIN m ON m.page_id = lw.page_id AND m.field_id = lw.field_id AND m.rn = lw.rn + 1),
o AS (SELECT m.*, lw.line, row_number() OVER (PARTITION BY page_id, field_id, lw.line ORDER BY x_ratio, v, word_id) AS k FROM m JOIN lw USING (page_id, field_id, word_id)),
gw AS (SELECT page_id, field_id, line, k, word_id, x_ratio AS l, x_ratio + width_ratio AS r, 1::BIGINT AS n, height_ratio AS h, 0 AS nth FROM o WHERE k = 1
  UNION ALL SELECT o.page_id, o.field_id, o.line, o.k, o.word_id, CASE WHEN j THEN least(gw.l, o.x_ratio) ELSE o.x_ratio END, CASE WHEN j THEN greatest(gw.r, o.x_ratio + o.width_ratio) ELSE o.x_ratio + o.width_ratio END,
    CASE WHEN j THEN gw.n + 1 ELSE 1 END, CASE WHEN j THEN gw.h + o.height_ratio ELSE o.height_ratio END, CASE WHEN j THEN gw.nth ELSE gw.nth + 1 END
   FROM gw JOIN (SELECT *, 1 AS one FROM o) o ON o.page_id = gw.page_id AND o.field_id = gw.field_id AND o.line = gw.line AND o.k = gw.k + 1,
     LATERAL (SELECT o.x_ratio - ({rnd('gw.l', 6)} + {rnd('greatest(0.0::DOUBLE, gw.r - gw.l)', 6)}) <= greatest(0.03::DOUBLE, (gw.h + o.height_ratio) / (gw.n + 1) * 1.5::DOUBLE) AS j) x),
grp AS (SELECT page_id, field_id, line, nth, CAST(count(*) AS INTEGER) AS word_count, string_agg(text, ' ' ORDER BY o.k) AS text, {rnd('min(x_ratio)', 6)} AS x_ratio, {rnd('min(y_ratio)', 6)} AS y_ratio,
   {rnd('max(x_ratio + width_ratio) - min(x_ratio)', 6)} AS width_ratio, {rnd('max(y_ratio + height_ratio) - min(y_ratio)', 6)} AS height_ratio,
   {rnd('sum(confidence) / count(*)', 4)} AS ocr_confidence FROM o JOIN gw USING (page_id, field_id, line, word_id) GROUP BY ALL)"""


@query("win03_word_groups", oracle(f"WITH RECURSIVE {GROUPED} SELECT * FROM grp", "fields", "words"))
def word_groups(spark: SparkSession, sf: str) -> DataFrame:
    return loc.word_groups(loc.search_words(_fields(spark, sf), words(spark, sf)))


VALID = f"""{GROUPED},
b AS (SELECT g.*, f.x_ratio AS px, f.y_ratio AS py, f.width_ratio AS pw, f.height_ratio AS ph, sx, sy, sw, sh, g.width_ratio * g.height_ratio AS area,
   (f.x_ratio + f.width_ratio / 2) - (g.x_ratio + g.width_ratio / 2) AS dx, (f.y_ratio + f.height_ratio / 2) - (g.y_ratio + g.height_ratio / 2) AS dy,
   greatest(0.0::DOUBLE, least(f.x_ratio + f.width_ratio, g.x_ratio + g.width_ratio) - greatest(f.x_ratio, g.x_ratio)) * greatest(0.0::DOUBLE, least(f.y_ratio + f.height_ratio, g.y_ratio + g.height_ratio) - greatest(f.y_ratio, g.y_ratio)) AS c
  FROM grp g JOIN win f USING (page_id, field_id)),
s AS (SELECT *, {clamp('area / greatest(1e-6::DOUBLE, sw * sh)')} AS cov, {clamp('1.0::DOUBLE - sqrt(dx * dx + dy * dy) / 0.20::DOUBLE')} AS dist, {clamp('c / greatest(1e-6::DOUBLE, least(pw * ph, area))')} AS ovl,
   {clamp('c / greatest(1e-6::DOUBLE, pw * ph + area - c)')} AS iou, {clamp('least(pw, width_ratio) / greatest(pw, width_ratio, 1e-6::DOUBLE) * 0.35::DOUBLE + least(ph, height_ratio) / greatest(ph, height_ratio, 1e-6::DOUBLE) * 0.35::DOUBLE + least(pw * ph, area) / greatest(pw * ph, area, 1e-6::DOUBLE) * 0.30::DOUBLE')} AS siz,
   {clamp('1.0::DOUBLE - abs(dy) / greatest(ph, 1e-6::DOUBLE)')} AS lin FROM b),
a AS (SELECT *, {clamp('ocr_confidence * 0.20::DOUBLE + least(1.0::DOUBLE, cov / 0.35::DOUBLE) * 0.08::DOUBLE + least(1.0::DOUBLE, word_count / 3) * 0.07::DOUBLE + dist * 0.20::DOUBLE + ovl * 0.20::DOUBLE + iou * 0.10::DOUBLE + siz * 0.10::DOUBLE + lin * 0.05::DOUBLE')} AS ad FROM s),
valid AS (SELECT page_id, field_id, line, nth, word_count, x_ratio, y_ratio, width_ratio, height_ratio, ocr_confidence, {rnd('cov', 4)} AS coverage, {rnd('dist', 4)} AS distance_score, {rnd('ovl', 4)} AS overlap_score,
   {rnd('iou', 4)} AS iou_score, {rnd('siz', 4)} AS size_similarity, {rnd('lin', 4)} AS line_score, {rnd('ad', 4)} AS adaptive_confidence,
   array_to_string(list_filter([CASE WHEN NOT (x_ratio >= sx AND y_ratio >= sy AND x_ratio + width_ratio <= sx + sw + 1e-6::DOUBLE AND y_ratio + height_ratio <= sy + sh + 1e-6::DOUBLE) THEN 'outside_search_region' END,
     CASE WHEN width_ratio < 0.002 OR height_ratio < 0.002 THEN 'roi_too_small' END, CASE WHEN area > greatest(1e-6::DOUBLE, pw * ph) * 4 THEN 'roi_too_large' END, CASE WHEN cov < 0.01 THEN 'coverage_too_low' END,
     CASE WHEN cov > 0.92 THEN 'coverage_too_high' END, CASE WHEN ad < 0.25 THEN 'adaptive_confidence_too_low' END], lambda e: e IS NOT NULL), ',') AS errors FROM a),
ranked AS (SELECT *, errors = '' AS passed, {rnd(clamp('distance_score * 0.25::DOUBLE + overlap_score * 0.25::DOUBLE + iou_score * 0.15::DOUBLE + size_similarity * 0.15::DOUBLE + line_score * 0.10::DOUBLE + ocr_confidence * 0.05::DOUBLE + least(1.0::DOUBLE, word_count / 3) * 0.05::DOUBLE'), 4)} AS rank_score FROM valid)"""
MEASURES = "coverage, distance_score, overlap_score, iou_score, size_similarity, line_score, adaptive_confidence"


@query("sc02_group_validation", oracle(f"WITH RECURSIVE {VALID} SELECT page_id, field_id, line, nth, {MEASURES}, errors, passed, rank_score FROM ranked", "fields", "words"))
def group_validation(spark: SparkSession, sf: str) -> DataFrame:
    fields = _fields(spark, sf)
    groups = loc.word_groups(loc.search_words(fields, words(spark, sf)))
    return loc.validate_groups(groups, fields).select(
        "page_id", "field_id", "line", "nth", *MEASURES.split(", "), F.array_join("errors", ",").alias("errors"), "passed", "rank_score"
    )


REFINED = f"""{VALID},
pick AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY page_id, field_id ORDER BY passed DESC, adaptive_confidence DESC, rank_score DESC, line, nth) = 1),
refined AS (SELECT f.page_id, f.field_id, CASE WHEN passed THEN 'refined' ELSE 'fallback' END AS status, CASE WHEN passed THEN p.x_ratio ELSE f.x_ratio END AS x_ratio, CASE WHEN passed THEN p.width_ratio ELSE f.width_ratio END AS width_ratio,
  CASE WHEN passed THEN NULL WHEN passed IS NULL THEN 'no_word_boxes_in_search_region' ELSE errors END AS fallback_reason, coalesce(adaptive_confidence, 0.0::DOUBLE) AS adaptive_confidence,
  coalesce(word_count, 0) AS word_count, coalesce(coverage, 0.0::DOUBLE) AS coverage, coalesce(ocr_confidence, 0.0::DOUBLE) AS ocr_confidence FROM fields f LEFT JOIN pick p USING (page_id, field_id))"""


@query("win12_refined_fields", oracle(f"WITH RECURSIVE {REFINED} SELECT page_id, field_id, status, x_ratio, width_ratio, fallback_reason, adaptive_confidence, word_count FROM refined", "fields", "words"))
def refined_fields(spark: SparkSession, sf: str) -> DataFrame:
    refined = loc.refine_fields(_fields(spark, sf), words(spark, sf))
    return refined.select("page_id", "field_id", "status", "x_ratio", "width_ratio", "fallback_reason", "adaptive_confidence", "word_count")


def _mean(name: str) -> str:
    return rnd(f"sum(CAST(floor({name} * 10000 + 0.5) AS BIGINT)) / 10000.0::DOUBLE / count(*)", 4) + f" AS average_{name}"


@query("agg15_refinement_summary", oracle(f"""WITH RECURSIVE {REFINED}
SELECT page_id, count(*) FILTER (status = 'refined') AS refined, count(*) FILTER (status = 'fallback') AS fallback, {_mean('adaptive_confidence')}, {_mean('coverage')}, {_mean('ocr_confidence')} FROM refined GROUP BY page_id""", "fields", "words"))
def refinement_summary(spark: SparkSession, sf: str) -> DataFrame:
    return loc.refinement_summary(loc.refine_fields(_fields(spark, sf), words(spark, sf)))


@query("join09_text_anchors")
def text_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors of a conversation page: its opening text, a cropped second text and a foreign passage."""
    turns = table(spark, sf, "conversations")
    benchmark = table(spark, sf, "benchmark")
    total = benchmark.agg(F.count("*").alias("items"))
    opening = turns.filter("turn = 0").selectExpr("conv_id AS page_id", "0 AS anchor_id", "upper(text) AS expected_text")
    cropped = turns.filter("turn = 1").selectExpr("conv_id AS page_id", "1 AS anchor_id", "concat(substr(text, 4), ' tail') AS expected_text")
    foreign = turns.select("conv_id").distinct().crossJoin(F.broadcast(total)).withColumn("item_id", F.expr("conv_id % items")).join(
        benchmark, "item_id"
    ).selectExpr("conv_id AS page_id", "2 AS anchor_id", "text AS expected_text")
    anchors = opening.unionByName(cropped).unionByName(foreign)
    return loc.locate_anchors(anchors, turns.selectExpr("conv_id AS page_id", "turn AS region_id", "text"))


# Matched anchor points of a page: its regions' centres, displaced a little differently on every page.
sql("point_pairs", """
SELECT page_id, region_id AS anchor_id, x_ratio + width_ratio / 2 AS sx, y_ratio + height_ratio / 2 AS sy,
  (x_ratio + width_ratio / 2) * (0.9::DOUBLE + CAST(page_id % 3 AS DOUBLE) / 10) + CAST(page_id % 7 AS DOUBLE) / 100 + CAST(region_id % 3 * (page_id % 5) AS DOUBLE) / 100 AS dx,
  (y_ratio + height_ratio / 2) * (0.9::DOUBLE + CAST(page_id % 3 AS DOUBLE) / 10) - CAST(page_id % 4 AS DOUBLE) / 100 AS dy FROM regions""", "regions")


def point_pairs(spark: SparkSession, sf: str) -> DataFrame:
    cx, cy, grow = "(x_ratio + width_ratio / 2)", "(y_ratio + height_ratio / 2)", "(0.9D + cast(page_id % 3 AS double) / 10)"
    return derive.regions(spark, sf).selectExpr(
        "page_id", "region_id AS anchor_id", f"{cx} AS sx", f"{cy} AS sy",
        f"{cx} * {grow} + cast(page_id % 7 AS double) / 100 + cast(region_id % 3 * (page_id % 5) AS double) / 100 AS dx",
        f"{cy} * {grow} - cast(page_id % 4 AS double) / 100 AS dy",
    )


@query("sc08_transforms", oracle("""
WITH s AS (SELECT page_id, count(*) AS n, sum(CAST(floor((dx - sx) * 1e9 + 0.5) AS BIGINT)) / 1e9 / count(*) AS tx, sum(CAST(floor((dy - sy) * 1e9 + 0.5) AS BIGINT)) / 1e9 / count(*) AS ty FROM point_pairs GROUP BY page_id),
e AS (SELECT page_id, sum(CAST(floor(sqrt((sx + tx - dx) * (sx + tx - dx) + (sy + ty - dy) * (sy + ty - dy)) * 1e9 + 0.5) AS BIGINT)) / 1e9 / count(*) AS err FROM point_pairs JOIN s USING (page_id) GROUP BY page_id),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY anchor_id) AS k FROM point_pairs),
w AS (SELECT a.page_id, a.sx AS x0, a.sy AS y0, a.dx AS u0, a.dy AS v0, b.sx AS x1, b.sy AS y1, b.dx AS u1, b.dy AS v1, c.sx AS x2, c.sy AS y2, c.dx AS u2, c.dy AS v2, s.n FROM s JOIN r a ON a.page_id = s.page_id AND a.k = 1
   JOIN r b ON b.page_id = s.page_id AND b.k = 2 LEFT JOIN r c ON c.page_id = s.page_id AND c.k = 3 WHERE s.n IN (2, 3)),
g AS (SELECT page_id, n, least(greatest(sqrt((x1-x0)**2 + (y1-y0)**2), coalesce(sqrt((x2-x0)**2 + (y2-y0)**2), 0), coalesce(sqrt((x2-x1)**2 + (y2-y1)**2), 0)),
     greatest(sqrt((u1-u0)**2 + (v1-v0)**2), coalesce(sqrt((u2-u0)**2 + (v2-v0)**2), 0), coalesce(sqrt((u2-u1)**2 + (v2-v1)**2), 0))) AS spread,
   CASE WHEN n = 2 THEN ((u1-u0)*(x1-x0) + (v1-v0)*(y1-y0)) / nullif((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0), 0) ELSE ((u1-u0)*(y2-y0) - (u2-u0)*(y1-y0)) / nullif((x1-x0)*(y2-y0) - (y1-y0)*(x2-x0), 0) END AS a,
   CASE WHEN n = 2 THEN -((v1-v0)*(x1-x0) - (u1-u0)*(y1-y0)) / nullif((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0), 0) ELSE ((u2-u0)*(x1-x0) - (u1-u0)*(x2-x0)) / nullif((x1-x0)*(y2-y0) - (y1-y0)*(x2-x0), 0) END AS b,
   CASE WHEN n = 2 THEN ((v1-v0)*(x1-x0) - (u1-u0)*(y1-y0)) / nullif((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0), 0) ELSE ((v1-v0)*(y2-y0) - (v2-v0)*(y1-y0)) / nullif((x1-x0)*(y2-y0) - (y1-y0)*(x2-x0), 0) END AS c,
   CASE WHEN n = 2 THEN ((u1-u0)*(x1-x0) + (v1-v0)*(y1-y0)) / nullif((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0), 0) ELSE ((v2-v0)*(x1-x0) - (v1-v0)*(x2-x0)) / nullif((x1-x0)*(y2-y0) - (y1-y0)*(x2-x0), 0) END AS d FROM w),
f AS (SELECT page_id, spread, coalesce(spread >= 0.025 AND abs(a*d - b*c) > 1e-6 AND sqrt(a*a + c*c) BETWEEN 0.25 AND 4 AND sqrt(b*b + d*d) BETWEEN 0.25 AND 4, false) AS ok FROM g),
z AS (SELECT p.page_id, coalesce(n, 0) AS n, coalesce(ok, false) AS ok, CASE WHEN ok THEN 0.0::DOUBLE ELSE coalesce(err, 0.0::DOUBLE) END AS er FROM layout_pages p LEFT JOIN s USING (page_id) LEFT JOIN e USING (page_id) LEFT JOIN f USING (page_id))
SELECT page_id, n AS anchors_matched, CASE WHEN n = 0 OR (n >= 2 AND er > 0.08) THEN 'ratio_fallback' WHEN NOT ok THEN 'translation' WHEN n = 2 THEN 'partial_affine' ELSE 'affine' END AS method, """
    + rnd("er", 4) + " AS reprojection_error, " + rnd(clamp("1.0::DOUBLE - er / 0.08::DOUBLE"), 4) + " AS projection_confidence FROM z", "point_pairs", "layout_pages"))
def transforms(spark: SparkSession, sf: str) -> DataFrame:
    found = loc.estimate_transforms(point_pairs(spark, sf), derive.layout_pages(spark, sf))
    return found.select("page_id", "anchors_matched", "method", "reprojection_error", "projection_confidence")


sql("matrices", """
SELECT page_id, 0.8::DOUBLE + CAST(page_id % 5 AS DOUBLE) / 10 AS m11, CAST(page_id % 3 AS DOUBLE) / 50 AS m12, CAST(page_id % 9 AS DOUBLE) / 20 - 0.3::DOUBLE AS m13,
  CAST(page_id % 2 AS DOUBLE) / 40 AS m21, 0.9::DOUBLE + CAST(page_id % 4 AS DOUBLE) / 10 AS m22, CAST(page_id % 11 AS DOUBLE) / 20 - 0.5::DOUBLE AS m23,
  CAST(page_id % 6 AS DOUBLE) / 100 AS m31, 0.01::DOUBLE AS m32, 1.0::DOUBLE AS m33 FROM layout_pages""", "layout_pages")

_CORNERS = [("x_ratio", "y_ratio"), ("(x_ratio + width_ratio)", "y_ratio"), ("(x_ratio + width_ratio)", "(y_ratio + height_ratio)"), ("x_ratio", "(y_ratio + height_ratio)")]
_XS = ", ".join(f"(m11 * {x} + m12 * {y} + m13) / (m31 * {x} + m32 * {y} + m33)" for x, y in _CORNERS)
_YS = ", ".join(f"(m21 * {x} + m22 * {y} + m23) / (m31 * {x} + m32 * {y} + m33)" for x, y in _CORNERS)


@query("geo09_projected_fields", oracle(f"""
WITH p AS (SELECT page_id, field_id, x_ratio, y_ratio, width_ratio, height_ratio, least({_XS}) AS l, greatest({_XS}) AS r, least({_YS}) AS t, greatest({_YS}) AS b FROM fields JOIN matrices USING (page_id)),
c AS (SELECT *, {rnd(clamp('l'), 6)} AS cl, {rnd(clamp('t'), 6)} AS ct, {rnd(clamp('r') + ' - ' + clamp('l'), 6)} AS cw, {rnd(clamp('b') + ' - ' + clamp('t'), 6)} AS ch FROM p)
SELECT page_id, field_id, CASE WHEN cw > 1e-6 AND ch > 1e-6 THEN cl ELSE {rnd('x_ratio', 6)} END AS x_ratio, CASE WHEN cw > 1e-6 AND ch > 1e-6 THEN cw ELSE {rnd('width_ratio', 6)} END AS width_ratio,
  true AS valid, l < 0 OR t < 0 OR r > 1 OR b > 1 AS outside_image_clipped, NOT (cw > 1e-6 AND ch > 1e-6) AS zero_area FROM c""", "fields", "matrices"))
def projected_fields(spark: SparkSession, sf: str) -> DataFrame:
    matrices = derive.layout_pages(spark, sf).selectExpr(
        "page_id", "0.8D + cast(page_id % 5 AS double) / 10 AS m11", "cast(page_id % 3 AS double) / 50 AS m12", "cast(page_id % 9 AS double) / 20 - 0.3D AS m13",
        "cast(page_id % 2 AS double) / 40 AS m21", "0.9D + cast(page_id % 4 AS double) / 10 AS m22", "cast(page_id % 11 AS double) / 20 - 0.5D AS m23",
        "cast(page_id % 6 AS double) / 100 AS m31", "0.01D AS m32", "1D AS m33",
    )
    return loc.project_fields(_fields(spark, sf), matrices).select(
        "page_id", "field_id", "x_ratio", "width_ratio", "valid", "outside_image_clipped", "zero_area"
    )


@query("agg14_field_tests", oracle("""
WITH t AS (SELECT l_suppkey AS template_id, CASE WHEN l_returnflag = 'N' THEN l_linenumber % 3 > 0 ELSE l_quantity > 5 AND l_discount <> 0.05 END AS ok FROM lineitem)
SELECT template_id, count(*) AS tested, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM t GROUP BY template_id"""))
def field_tests(spark: SparkSession, sf: str) -> DataFrame:
    results = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS template_id", "CASE WHEN l_returnflag = 'N' THEN 'image' ELSE 'text' END AS data_type",
        "CASE WHEN l_quantity > 5 THEN 'read' ELSE ' ' END AS actual_text", "CASE WHEN l_discount = 0.05D THEN 'failed' END AS error",
        "cast(l_linenumber % 3 AS double) AS width_ratio", "0.5D AS height_ratio",
    )
    return loc.field_tests(results)
