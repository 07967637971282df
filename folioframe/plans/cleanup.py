"""Region geometry, clean-up and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import geometry as geo
from folioframe.functions import similarity as sim
from folioframe.functions.geometry import PIXEL, RATIO, Box
from folioframe.functions.numeric import rnd as rounded
from folioframe.operators import regions, signature, suppress
from folioframe.operators.spatial import PIXEL_TILE, pair_overlaps
from folioframe.plans import derive
from folioframe.plans.derive import oracle, sql, table
from folioframe.plans.registry import query
from folioframe.plans.sqltext import clamp, common, common_px, ratio_sim, rnd

# Detected items in whole pixels of their page.
sql("items", """
SELECT r.page_id, r.region_id AS item_id, r.label, floor(r.x_ratio * p.image_width) AS x, floor(r.y_ratio * p.image_height) AS y,
       floor(r.width_ratio * p.image_width) AS width, floor(r.height_ratio * p.image_height) AS height,
       r.confidence, p.image_width, p.image_height
FROM regions r JOIN layout_pages p USING (page_id)""", "regions", "layout_pages")


def items(spark: SparkSession, sf: str) -> DataFrame:
    joined = derive.regions(spark, sf).join(derive.layout_pages(spark, sf), "page_id")
    return joined.selectExpr(
        "page_id", "region_id AS item_id", "label",
        "cast(floor(x_ratio * image_width) AS double) AS x", "cast(floor(y_ratio * image_height) AS double) AS y",
        "cast(floor(width_ratio * image_width) AS double) AS width",
        "cast(floor(height_ratio * image_height) AS double) AS height",
        "confidence", "image_width", "image_height",
    )


BOXES = ("x", "y", "width", "height")


@query("geo01_box_from_points", oracle("""
SELECT page_id, item_id, least(x, x + width) AS "left", least(y, y + height) AS top,
       greatest(x, x + width) AS "right", greatest(y, y + height) AS bottom FROM items""", "items"))
def box_from_points(spark: SparkSession, sf: str) -> DataFrame:
    corners = F.expr("array(array(x + width, y), array(x, y), array(x, y + height), array(x + width, y + height))")
    boxed = items(spark, sf).select("page_id", "item_id", geo.box_from_points(corners).alias("box"))
    return boxed.filter("box IS NOT NULL").select("page_id", "item_id", "box.*")


@query("geo02_pixel_to_ratio", oracle(f"""
WITH r AS (SELECT page_id, item_id, {clamp('x / image_width')} AS l, {clamp('y / image_height')} AS t,
  {clamp('x / image_width + width / image_width')} AS r0, {clamp('y / image_height + height / image_height')} AS b0 FROM items)
SELECT page_id, item_id, {rnd('l', 6)} AS x_ratio, {rnd('t', 6)} AS y_ratio,
       {rnd('greatest(l, r0) - l', 6)} AS width_ratio, {rnd('greatest(t, b0) - t', 6)} AS height_ratio FROM r""", "items"))
def pixel_to_ratio(spark: SparkSession, sf: str) -> DataFrame:
    box = geo.pixel_to_ratio(Box.of(PIXEL), F.col("image_width"), F.col("image_height"))
    return items(spark, sf).select(
        "page_id", "item_id", box.x.alias("x_ratio"), box.y.alias("y_ratio"), box.w.alias("width_ratio"),
        box.h.alias("height_ratio"),
    )


@query("geo03_expand_boxes", oracle(f"""
WITH s AS (SELECT page_id, region_id, greatest(0.0::DOUBLE, x_ratio - width_ratio * 0.15::DOUBLE) AS l,
    greatest(0.0::DOUBLE, y_ratio - height_ratio * 0.15::DOUBLE) AS t,
    least(1.0::DOUBLE, x_ratio + width_ratio + width_ratio * 0.15::DOUBLE) AS r,
    least(1.0::DOUBLE, y_ratio + height_ratio + height_ratio * 0.15::DOUBLE) AS b,
    greatest(0.0::DOUBLE, x_ratio - pad / image_width) AS pl, greatest(0.0::DOUBLE, y_ratio - pad / image_height) AS pt,
    least(1.0::DOUBLE, x_ratio + width_ratio + pad / image_width) AS pr,
    least(1.0::DOUBLE, y_ratio + height_ratio + pad / image_height) AS pb
  FROM (SELECT r.*, p.image_width, p.image_height, CASE label WHEN 'table' THEN 10.0::DOUBLE WHEN 'text' THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END AS pad
        FROM regions r JOIN layout_pages p USING (page_id)))
SELECT page_id, region_id, {rnd('l', 6)} AS x_ratio, {rnd('t', 6)} AS y_ratio, {rnd('greatest(0.0::DOUBLE, r - l)', 6)} AS width_ratio,
       {rnd('greatest(0.0::DOUBLE, b - t)', 6)} AS height_ratio, {rnd('pl', 6)} AS padded_x, {rnd('pt', 6)} AS padded_y,
       {rnd('greatest(0.0::DOUBLE, pr - pl)', 6)} AS padded_width, {rnd('greatest(0.0::DOUBLE, pb - pt)', 6)} AS padded_height
FROM s""", "regions", "layout_pages"))
def expand_boxes(spark: SparkSession, sf: str) -> DataFrame:
    joined = derive.regions(spark, sf).join(derive.layout_pages(spark, sf), "page_id")
    share = geo.expand_by_share(Box.of())
    pad = F.expr("CASE label WHEN 'table' THEN 10D WHEN 'text' THEN 8D ELSE 0D END")
    pixels = geo.expand_by_pixels(Box.of(), pad, F.col("image_width"), F.col("image_height"))
    out = ["page_id", "region_id"]
    out += [v.alias(n) for v, n in zip((share.x, share.y, share.w, share.h), RATIO)]
    out += [rounded(v, 6).alias(f"padded_{n}") for v, n in zip((pixels.x, pixels.y, pixels.w, pixels.h), BOXES)]
    return joined.select(*out)


INSIDE = "a.x + a.width / 2 BETWEEN b.x AND b.x + b.width AND a.y + a.height / 2 BETWEEN b.y AND b.y + b.height"


@query("geo04_overlap_measures", oracle(f"""
WITH m AS (SELECT a.page_id, a.item_id, b.item_id AS other_id, {common_px('a', 'b')} AS c, a.width * a.height AS aa,
    b.width * b.height AS ba, ({INSIDE}) AS centre_inside,
    (b.x >= a.x AND b.y >= a.y AND b.x + b.width <= a.x + a.width + 1e-6::DOUBLE AND b.y + b.height <= a.y + a.height + 1e-6::DOUBLE) AS contains,
    greatest(0.0::DOUBLE, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) / greatest(1.0::DOUBLE, least(a.x + a.width - a.x, b.x + b.width - b.x)) AS xo
  FROM items a JOIN items b ON a.page_id = b.page_id AND a.item_id < b.item_id
   AND a.x < b.x + b.width AND a.x + a.width > b.x AND a.y < b.y + b.height AND a.y + a.height > b.y)
SELECT page_id, item_id, other_id, {rnd('c / greatest(aa, 1e-6::DOUBLE)', 6)} AS share_inside,
       {rnd('c / greatest(1.0::DOUBLE, least(aa, ba))', 6)} AS share_of_smaller,
       {rnd(clamp('c / greatest(1e-6::DOUBLE, aa + ba - c)'), 6)} AS iou, contains, centre_inside, {rnd('xo', 6)} AS x_overlap
FROM m""", "items"))
def overlap_measures(spark: SparkSession, sf: str) -> DataFrame:
    boxes = items(spark, sf).select("page_id", "item_id", *PIXEL)
    a, b = Box.field(F.col("l"), PIXEL), Box.field(F.col("r"), PIXEL)
    pairs = pair_overlaps(
        boxes, boxes, ["page_id"], PIXEL, PIXEL_TILE,
        lambda l, r: (l["item_id"] < r["item_id"]) & geo.intersects(Box.field(l, PIXEL), Box.field(r, PIXEL)),
    )
    return pairs.select(
        "page_id", F.col("l.item_id").alias("item_id"), F.col("r.item_id").alias("other_id"),
        rounded(geo.share_inside(a, b), 6).alias("share_inside"),
        rounded(geo.share_of_smaller(a, b), 6).alias("share_of_smaller"),
        rounded(geo.iou(a, b), 6).alias("iou"),
        geo.contains(a, b).alias("contains"),
        geo.centre_inside(a, b).alias("centre_inside"),
        rounded(geo.axis_overlap(a.x, a.right, b.x, b.right), 6).alias("x_overlap"),
    )


@query("geo05_region_types", oracle("""
SELECT p_partkey, lower(p_type || '_' || p_name) AS label,
  CASE WHEN contains(lower(p_type || '_' || p_name), 'table') AND NOT contains(lower(p_type || '_' || p_name), 'title')
         AND NOT contains(lower(p_type || '_' || p_name), 'caption') THEN 'table'
       WHEN regexp_matches(lower(p_type || '_' || p_name), 'image|figure|pic|seal|logo|chart') THEN 'image' ELSE 'text' END AS region_type,
  NOT regexp_matches(translate(lower(p_type || '_' || p_name), '_-', '  '), 'header|footer|page number') AS supported
FROM part"""))
def region_types(spark: SparkSession, sf: str) -> DataFrame:
    label = F.lower(F.concat_ws("_", "p_type", "p_name"))
    return table(spark, sf, "part").select(
        "p_partkey", label.alias("label"), regions.region_type(label).alias("region_type"),
        regions.supported_type(label).alias("supported"),
    )


@query("geo07_valid_regions", oracle("""
SELECT i.page_id, i.item_id, i.width >= 4 AND i.height >= 4 AS layout_ok, i.width >= 2 AND i.height >= 2 AS text_ok,
       u.area_ratio FROM items i JOIN usable u ON u.page_id = i.page_id AND u.region_id = i.item_id
WHERE i.width >= 2 AND i.height >= 2""", "items", "usable"))
def valid_regions(spark: SparkSession, sf: str) -> DataFrame:
    usable = signature.usable_regions(derive.regions(spark, sf)).selectExpr("page_id", "region_id AS item_id", "area_ratio")
    sized = items(spark, sf).filter("width >= 2 AND height >= 2")
    return sized.join(usable, ["page_id", "item_id"]).selectExpr(
        "page_id", "item_id", "width >= 4 AND height >= 4 AS layout_ok", "width >= 2 AND height >= 2 AS text_ok", "area_ratio"
    )


@query("join05_text_outside_tables", oracle(f"""
SELECT a.page_id, a.item_id, a.label FROM items a WHERE a.label <> 'text' OR NOT EXISTS (
  SELECT 1 FROM items b WHERE b.page_id = a.page_id AND b.label = 'table'
    AND (({INSIDE}) OR {common_px('a', 'b')} / greatest(a.width * a.height, 1.0::DOUBLE) >= 0.25))""", "items"))
def text_outside_tables(spark: SparkSession, sf: str) -> DataFrame:
    return regions.text_outside_tables(items(spark, sf)).select("page_id", "item_id", "label")


@query("join06_images_without_text", oracle(f"""
SELECT b.page_id, b.item_id, b.label FROM items b WHERE b.label <> 'image' OR NOT EXISTS (
  SELECT 1 FROM items a WHERE a.page_id = b.page_id AND a.label = 'text'
    AND (({INSIDE}) OR {common_px('a', 'b')} / greatest(a.width * a.height, 1.0::DOUBLE) >= 0.35))""", "items"))
def images_without_text(spark: SparkSession, sf: str) -> DataFrame:
    return regions.images_without_text(items(spark, sf)).select("page_id", "item_id", "label")


# Fields of a page: every region is one; even part of the regions is flexible.
sql("fields", """
SELECT page_id, region_id AS field_id, label AS data_type,
       CASE WHEN (page_id + region_id) % 3 = 0 THEN 'flexible' ELSE 'fix' END AS roi_mode,
       x_ratio, y_ratio, width_ratio, height_ratio FROM regions""", "regions")


def fields(spark: SparkSession, sf: str) -> DataFrame:
    return derive.regions(spark, sf).selectExpr(
        "page_id", "region_id AS field_id", "label AS data_type",
        "CASE WHEN (page_id + region_id) % 3 = 0 THEN 'flexible' ELSE 'fix' END AS roi_mode", *RATIO,
    )


def field_overrides(fields_df: DataFrame) -> DataFrame:
    """One stable region per field, and an ignore mask beside it for flexible fields."""
    kinds = F.expr(
        "CASE WHEN roi_mode = 'flexible' THEN array('mask', 'stable') ELSE array('stable') END"
    )
    source = F.expr("CASE WHEN roi_mode = 'flexible' THEN 'flexible_search_boundary' ELSE 'fix_roi' END")
    return (
        fields_df.filter("width_ratio > 0 AND height_ratio > 0")
        .withColumn("kind", F.explode(kinds))
        .withColumn("source", F.when(F.col("kind") == "stable", source))
        .withColumn("confidence", F.when(F.col("kind") == "stable", F.lit(1.0)))
    )


@query("geo08_field_overrides", oracle("""
SELECT page_id, field_id, 'stable' AS kind, CASE WHEN roi_mode = 'flexible' THEN 'flexible_search_boundary' ELSE 'fix_roi' END AS source,
       1.0::DOUBLE AS confidence, x_ratio FROM fields WHERE width_ratio > 0 AND height_ratio > 0
UNION ALL SELECT page_id, field_id, 'mask', NULL, NULL, x_ratio FROM fields
WHERE roi_mode = 'flexible' AND width_ratio > 0 AND height_ratio > 0""", "fields"))
def overrides(spark: SparkSession, sf: str) -> DataFrame:
    return field_overrides(fields(spark, sf)).select("page_id", "field_id", "kind", "source", "confidence", "x_ratio")


@query("join07_masked_regions", oracle(f"""
SELECT u.page_id, u.region_id, u.label FROM usable u WHERE NOT EXISTS (
  SELECT 1 FROM fields m WHERE m.page_id = u.page_id AND m.roi_mode = 'flexible' AND m.width_ratio > 0 AND m.height_ratio > 0
   AND ((u.centre_x BETWEEN m.x_ratio AND m.x_ratio + m.width_ratio AND u.centre_y BETWEEN m.y_ratio AND m.y_ratio + m.height_ratio)
        OR {common('u', 'm')} / greatest(u.width_ratio * u.height_ratio, 1e-6::DOUBLE) >= 0.60))
UNION ALL SELECT page_id, field_id + 1000, data_type FROM fields WHERE width_ratio > 0 AND height_ratio > 0""",
    "usable", "fields"))
def masked_regions(spark: SparkSession, sf: str) -> DataFrame:
    marks = field_overrides(fields(spark, sf))
    kept = signature.drop_masked(
        signature.usable_regions(derive.regions(spark, sf)), marks.filter("kind = 'mask'"), ["page_id"]
    ).select("page_id", "region_id", "label")
    stable = marks.filter("kind = 'stable'").selectExpr("page_id", "field_id + 1000 AS region_id", "data_type AS label")
    return kept.unionByName(stable)


@query("win08_tiny_text", oracle("""
WITH m AS (SELECT page_id, count(*) AS n, median(height) FILTER (height > 0) AS mh, median(width * height) FILTER (width * height > 0) AS ma
           FROM items WHERE label = 'text' GROUP BY page_id)
SELECT i.page_id, i.item_id FROM items i LEFT JOIN m USING (page_id)
WHERE NOT coalesce(i.label = 'text' AND m.n >= 2 AND m.mh > 0 AND m.ma > 0 AND i.height <= m.mh * 0.42::DOUBLE
      AND i.width * i.height <= m.ma * 0.28::DOUBLE AND i.width <= m.mh * 2.5::DOUBLE, false)""", "items"))
def tiny_text(spark: SparkSession, sf: str) -> DataFrame:
    return regions.drop_tiny_text(items(spark, sf)).select("page_id", "item_id")


def _greedy_sql(order: str, test: str) -> str:
    return f"""
WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, label ORDER BY {order}, item_id) AS rn FROM items),
rivals AS (SELECT b.page_id, b.label, b.rn, b.item_id, coalesce(list(a.item_id) FILTER (a.item_id IS NOT NULL), []) AS rivals
  FROM ranked b LEFT JOIN ranked a ON a.page_id = b.page_id AND a.label = b.label AND a.rn < b.rn AND {test}
  GROUP BY ALL),
walk AS (SELECT DISTINCT page_id, label, 0::BIGINT AS step, CAST([] AS INTEGER[]) AS kept FROM items
  UNION ALL SELECT w.page_id, w.label, w.step + 1,
    CASE WHEN list_has_any(w.kept, r.rivals) THEN w.kept ELSE list_append(w.kept, r.item_id) END
  FROM walk w JOIN rivals r ON r.page_id = w.page_id AND r.label = w.label AND r.rn = w.step + 1),
ends AS (SELECT * FROM walk QUALIFY step = max(step) OVER (PARTITION BY page_id, label))
SELECT page_id, label, unnest(kept) AS item_id FROM ends"""


NESTED = (f"{common_px('a', 'b')} / greatest(b.width * b.height, 1.0::DOUBLE) >= 0.88 AND "
          "greatest(b.width * b.height, 1.0::DOUBLE) / greatest(a.width * a.height, 1.0::DOUBLE) <= 0.72")
DUPLICATE = f"{common_px('a', 'b')} / greatest(1.0::DOUBLE, least(a.width * a.height, b.width * b.height)) >= 0.82"


@query("win09_nested_regions", oracle(_greedy_sql("width * height DESC", NESTED), "items"))
def nested_regions(spark: SparkSession, sf: str) -> DataFrame:
    return regions.drop_nested(items(spark, sf)).select("page_id", "label", "item_id")


# Regions drawn wider and less various in place, so that many lie in others.
_FLEXIBLE = ("page_id", "region_id", "label", "floor(x_ratio * 4) / 4 AS x_ratio", "floor(y_ratio * 3) / 3 AS y_ratio",
             "CASE WHEN region_id = 7 THEN 0 ELSE width_ratio * 1.5 END AS width_ratio", "height_ratio * 2 AS height_ratio")
sql("flexible", "SELECT page_id, CAST(region_id AS INTEGER) AS item_id, label, floor(x_ratio * 4) / 4 AS x, floor(y_ratio * 3) / 3 AS y, width_ratio * 1.5::DOUBLE AS width, height_ratio * 2 AS height FROM regions WHERE region_id <> 7", "regions")
HELD = f"{common_px('a', 'b')} / greatest(b.width * b.height, 1e-9::DOUBLE)"
FLEXIBLE_NESTED = f"CASE WHEN b.label = 'text' THEN {HELD} >= 0.88 ELSE {HELD} >= 0.72 OR {common_px('a', 'b')} / greatest(a.width * a.height, 1e-9::DOUBLE) >= 0.72 END"


@query("win09_flexible_regions", oracle(_greedy_sql("width * height DESC", FLEXIBLE_NESTED).replace("FROM items", "FROM flexible"), "flexible"))
def flexible_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Areas of flexible fields without those that lie in a larger one of their kind."""
    areas = derive.regions(spark, sf).selectExpr(*[e.replace("1.5", "1.5D") for e in _FLEXIBLE])
    return regions.drop_flexible_nested(areas).selectExpr("page_id", "label", "cast(region_id AS int) AS item_id")


@query("win10_duplicate_boxes", oracle(_greedy_sql("width * height ASC, y, x", DUPLICATE), "items"))
def duplicate_boxes(spark: SparkSession, sf: str) -> DataFrame:
    kept = suppress.greedy_keep(
        items(spark, sf), ["page_id", "label"], "item_id", PIXEL, PIXEL_TILE, suppress.DETECTED_DUPLICATE
    )
    return kept.select("page_id", "label", "item_id")


SHARE = ("greatest(0.0::DOUBLE, least({s}r, n.x + n.width) - greatest({s}l, n.x)) * greatest(0.0::DOUBLE, least({s}b, n.y + n.height)"
         " - greatest({s}t, n.y)) / greatest(1.0::DOUBLE, least(({s}r - {s}l) * ({s}b - {s}t), n.width * n.height))")


@query("win11_expanded_items", oracle(f"""
WITH RECURSIVE grown AS (SELECT *, CASE label WHEN 'text' THEN 8 WHEN 'table' THEN 2 ELSE 0 END AS pad FROM items),
around AS (SELECT a.page_id, a.item_id, n.x, n.y, n.width, n.height,
      row_number() OVER (PARTITION BY a.page_id, a.item_id ORDER BY n.item_id) AS rn
   FROM items a JOIN items n ON n.page_id = a.page_id AND n.item_id <> a.item_id AND a.label = 'text' AND n.width * n.height > 0),
walk AS (SELECT page_id, item_id, label, x, y, width, height, 0::BIGINT AS step, false AS done,
     greatest(0.0::DOUBLE, x - pad) AS l, greatest(0.0::DOUBLE, y - pad) AS t,
     least(image_width::DOUBLE, x + width + pad) AS r, least(image_height::DOUBLE, y + height + pad) AS b FROM grown
  UNION ALL
  SELECT page_id, item_id, label, x, y, width, height, step + 1, done OR (hit AND bad),
     CASE WHEN NOT hit THEN l WHEN bad THEN x ELSE cl END, CASE WHEN NOT hit THEN t WHEN bad THEN y ELSE ct END,
     CASE WHEN NOT hit THEN r WHEN bad THEN x + width ELSE cr END, CASE WHEN NOT hit THEN b WHEN bad THEN y + height ELSE cb END
  FROM (SELECT *, (cr <= cl OR cb <= ct OR ({SHARE.format(s='c').replace('n.width', 'nw').replace('n.height', 'nh').replace('n.x', 'nx').replace('n.y', 'ny')}) > 0.15) AS bad
    FROM (SELECT w.*, n.x AS nx, n.y AS ny, n.width AS nw, n.height AS nh,
       (NOT w.done AND {SHARE.format(s='w.')} > 0.15) AS hit,
       CASE WHEN w.x + w.width > n.x AND w.x >= n.x + n.width THEN greatest(w.l, n.x + n.width) ELSE w.l END AS cl,
       CASE WHEN w.y + w.height > n.y AND w.y >= n.y + n.height THEN greatest(w.t, n.y + n.height) ELSE w.t END AS ct,
       CASE WHEN w.x + w.width <= n.x THEN least(w.r, n.x) ELSE w.r END AS cr,
       CASE WHEN w.y + w.height <= n.y THEN least(w.b, n.y) ELSE w.b END AS cb
      FROM walk w JOIN around n ON n.page_id = w.page_id AND n.item_id = w.item_id AND n.rn = w.step + 1)))
SELECT page_id, item_id, label, l AS "left", t AS top, r AS "right", b AS bottom
FROM walk QUALIFY step = max(step) OVER (PARTITION BY page_id, item_id)""", "items"))
def expanded_items(spark: SparkSession, sf: str) -> DataFrame:
    boxes = items(spark, sf).drop("image_width", "image_height")
    grown = regions.expand_items(boxes, derive.layout_pages(spark, sf))
    return grown.select("page_id", "item_id", "label", "left", "top", "right", "bottom")


@query("agg02_region_order", oracle("""
SELECT page_id, region_id, label, CAST(row_number() OVER (PARTITION BY page_id ORDER BY label, centre_y, centre_x, region_id) AS INTEGER) AS place
FROM usable""", "usable"))
def region_order(spark: SparkSession, sf: str) -> DataFrame:
    """Places of the whole region list; labels come first, so each label is ranked on its own and shifted."""
    usable = signature.usable_regions(derive.regions(spark, sf))
    placed = regions.row_places(usable, ["page_id", "label"], ["centre_y", "centre_x", "region_id"], 0.125, "inside_label")
    counts = usable.groupBy("page_id").pivot("label", ["image", "table", "text"]).count().na.fill(0)
    shift = F.expr("CASE label WHEN 'image' THEN 0 WHEN 'table' THEN image ELSE image + `table` END")
    return placed.join(counts, "page_id").select(
        "page_id", "region_id", "label", (F.col("inside_label") + shift).cast("int").alias("place")
    )


@query("win06_reading_order", oracle(f"""
SELECT page_id, region_id, {rnd('''(row_number() OVER (PARTITION BY page_id ORDER BY centre_y, centre_x, region_id) - 1)
   / greatest(1, count(*) OVER (PARTITION BY page_id) - 1)''', 6)} AS reading_order FROM usable""", "usable"))
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    ordered = regions.reading_order(signature.usable_regions(derive.regions(spark, sf)))
    return ordered.select("page_id", "region_id", rounded(F.col("reading_order"), 6).alias("reading_order"))


# Text lines of a page: the words of its line items, one box each.
sql("lines", """
SELECT l_orderkey AS page_id, l_linenumber AS line_id, CAST(10 + min(l_suppkey) % 20 AS DOUBLE) / 100 AS x_ratio,
       CAST(5 + l_linenumber * 6 + min(l_partkey) % 10 AS DOUBLE) / 100 AS y_ratio,
       CAST(15 + min(l_partkey) % 45 AS DOUBLE) / 100 AS width_ratio, CAST(2 + min(l_suppkey) % 3 AS DOUBLE) / 100 AS height_ratio
FROM lineitem GROUP BY l_orderkey, l_linenumber""")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("supp"), F.min("l_partkey").alias("part")
    )
    return grouped.selectExpr(
        "l_orderkey AS page_id", "l_linenumber AS line_id", "cast(10 + supp % 20 AS double) / 100 AS x_ratio",
        "cast(5 + l_linenumber * 6 + part % 10 AS double) / 100 AS y_ratio",
        "cast(15 + part % 45 AS double) / 100 AS width_ratio", "cast(2 + supp % 3 AS double) / 100 AS height_ratio",
    )


@query("join10_line_scopes", oracle(f"""
WITH free AS (SELECT * FROM lines u WHERE NOT EXISTS (SELECT 1 FROM regions m WHERE m.page_id = u.page_id AND m.label <> 'text'
    AND {common('u', 'm')} / greatest(u.width_ratio * u.height_ratio, 1e-9::DOUBLE) >= 0.55)),
scoped AS (SELECT u.page_id, u.line_id, m.region_id AS scope FROM free u JOIN regions m ON m.page_id = u.page_id AND m.label = 'text'
    AND {common('u', 'm')} / greatest(u.width_ratio * u.height_ratio, 1e-9::DOUBLE) >= 0.55)
SELECT * FROM scoped UNION ALL SELECT page_id, line_id, NULL FROM free ANTI JOIN scoped USING (page_id, line_id)""", "lines", "regions"))
def line_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return regions.scope_lines(lines(spark, sf), derive.regions(spark, sf)).select("page_id", "line_id", "scope")


@query("win07_paragraphs", oracle("""
WITH near AS (SELECT *, lag(x_ratio) OVER w AS px, lag(y_ratio) OVER w AS py, lag(width_ratio) OVER w AS pw, lag(height_ratio) OVER w AS ph
   FROM lines WINDOW w AS (PARTITION BY page_id ORDER BY y_ratio + height_ratio / 2, x_ratio, line_id)),
mids AS (SELECT page_id, median(height_ratio) AS mh, median(width_ratio) AS mw, median(x_ratio) AS le,
     coalesce(median(CASE WHEN py IS NOT NULL THEN greatest(0.0::DOUBLE, y_ratio - (py + ph)) END), median(height_ratio) * 0.35::DOUBLE) AS mg
   FROM near GROUP BY page_id),
m AS (SELECT *, y_ratio - (py + ph) AS gap, (y_ratio - (py + ph)) / greatest(mg, mh * 0.25::DOUBLE, 1e-9::DOUBLE) AS gr,
     abs(x_ratio - px) / greatest(mw, mh, 1e-9::DOUBLE) AS ir, (x_ratio - le) / greatest(mw, mh, 1e-9::DOUBLE) AS fr,
     greatest(0.0::DOUBLE, least(px + pw, x_ratio + width_ratio) - greatest(px, x_ratio)) / greatest(1e-9::DOUBLE, least(pw, width_ratio)) AS ov
   FROM near JOIN mids USING (page_id)),
e AS (SELECT *, CAST(gr >= 1.85 AND gap >= mh * 0.85::DOUBLE AS INT) AS e1, CAST(ir >= 0.12 AS INT) AS e2, CAST(fr >= 0.16 AND x_ratio > px AS INT) AS e3,
     CAST(pw / greatest(mw, 1e-9::DOUBLE) <= 0.62 AND gr >= 1.25 AS INT) AS e4, CAST(ov <= 0.28 AND gr >= 1.35 AS INT) AS e5 FROM m),
b AS (SELECT *, CASE WHEN px IS NOT NULL AND e1 + e2 + e3 + e4 + e5 >= 2 AND e1 + e2 + e3 >= 1 AND 45 * e1 + 35 * e2 + 45 * e3 + 20 * e4 + 10 * e5 >= 85
     AND (e1 = 1 OR (e3 = 1 AND gr >= 1.35)) AND NOT (ov >= 0.68 AND ir < 0.12 AND gr < 1.85) THEN 1 ELSE 0 END AS starts FROM e),
n AS (SELECT *, CAST(1 + sum(starts) OVER (PARTITION BY page_id ORDER BY y_ratio + height_ratio / 2, x_ratio, line_id
     ROWS UNBOUNDED PRECEDING) AS INTEGER) AS paragraph FROM b)
SELECT page_id, paragraph, count(*) AS line_count, min(x_ratio) AS x_ratio, min(y_ratio) AS y_ratio,
  """ + rnd("least(1.0::DOUBLE, max(x_ratio + width_ratio)) - min(x_ratio)", 6) + " AS width_ratio, "
  + rnd("least(1.0::DOUBLE, max(y_ratio + height_ratio)) - min(y_ratio)", 6) + " AS height_ratio FROM n GROUP BY ALL", "lines"))
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    numbered = regions.paragraph_lines(lines(spark, sf), ["page_id"])
    boxes = regions.paragraph_boxes(numbered, ["page_id"])
    return boxes.select(
        "page_id", "paragraph", "line_count", "x_ratio", "y_ratio",
        rounded(F.col("width_ratio"), 6).alias("width_ratio"), rounded(F.col("height_ratio"), 6).alias("height_ratio"),
    )
