"""Layout signatures, their comparison and the retrieval of templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions.geometry import RATIO
from folioframe.operators import retrieval, signature
from folioframe.operators.joins import bounded_broadcast
from folioframe.plans import derive
from folioframe.plans.derive import oracle, sql
from folioframe.plans.registry import query
from folioframe.plans.sqltext import box_sim, clamp, count_sim, ratio_sim, rnd
from folioframe.session import cut_lineage

sql("usable", f"""
SELECT page_id, region_id, CASE WHEN lower(label) IN ('text', 'table', 'image') THEN lower(label) ELSE 'text' END AS label,
       {rnd(clamp('x_ratio') + ' + ' + clamp('width_ratio') + ' / 2', 6)} AS centre_x,
       {rnd(clamp('y_ratio') + ' + ' + clamp('height_ratio') + ' / 2', 6)} AS centre_y,
       {rnd(clamp(clamp('width_ratio') + ' * ' + clamp('height_ratio')), 6)} AS area_ratio,
       {rnd(clamp('x_ratio'), 6)} AS x_ratio, {rnd(clamp('y_ratio'), 6)} AS y_ratio,
       {rnd(clamp('width_ratio'), 6)} AS width_ratio, {rnd(clamp('height_ratio'), 6)} AS height_ratio,
       {rnd('confidence', 4)} AS confidence
FROM regions WHERE width_ratio > 0 AND height_ratio > 0""", "regions")

sql("cells48", """
SELECT page_id, label,
       CAST(greatest(0, least(3, floor(centre_y * 4))) * 4 + greatest(0, least(3, floor(centre_x * 4))) AS INTEGER) AS cell,
       count(*) AS n, CAST(sum(CAST(floor(area_ratio * 1000000 + 0.5) AS BIGINT)) AS BIGINT) AS area
FROM usable GROUP BY ALL""", "usable")

sql("by_label", """
SELECT page_id, label, CAST(sum(n) AS BIGINT) AS n, least(1.0::DOUBLE, sum(area) / 1000000.0::DOUBLE) AS area,
       sqrt(CAST(sum(least(area, 1000000) * least(area, 1000000)) AS DOUBLE)) AS norm
FROM cells48 GROUP BY ALL""", "cells48")

sql("leaders", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, label ORDER BY centre_y, centre_x, region_id) AS place
               FROM usable) WHERE place <= 20""", "usable")

# Template pages are few; naming them first keeps the comparison a join of every page with those.
sql("t_leaders", "SELECT * FROM leaders SEMI JOIN template_pages ON template_page_id = page_id", "leaders", "template_pages")
sql("t_cells48", "SELECT * FROM cells48 SEMI JOIN template_pages ON template_page_id = page_id", "cells48", "template_pages")

sql("page_pairs", """
SELECT p.page_id, p.doc_id, p.page_number, t.template_page_id, t.template_id, t.page_number AS template_page_number,
       tp.image_width / tp.image_height AS raw_t, p.image_width / p.image_height AS raw_q
FROM layout_pages p JOIN template_pages t ON true JOIN template_versions v ON v.template_id = t.template_id
     JOIN layout_pages tp ON tp.page_id = t.template_page_id
WHERE v.status = 'active' AND CASE WHEN coalesce(v.detection_mode, 'all_pages') = 'main_page'
      THEN t.page_number = coalesce(v.main_page_number, 1) ELSE t.page_number = p.page_number END""",
    "layout_pages", "template_pages", "template_versions")

sql("labels3", "SELECT unnest(['text', 'table', 'image']) AS label")

sql("label_parts", f"""
SELECT x.page_id, x.template_page_id, l.label, coalesce(q.n, 0) AS qn, coalesce(t.n, 0) AS tn,
       {count_sim('coalesce(q.n, 0)', 'coalesce(t.n, 0)')} AS count_part,
       {ratio_sim('coalesce(q.area, 0.0::DOUBLE)', 'coalesce(t.area, 0.0::DOUBLE)')} AS area_part,
       coalesce(q.norm, 0.0::DOUBLE) AS qnorm, coalesce(t.norm, 0.0::DOUBLE) AS tnorm
FROM page_pairs x CROSS JOIN labels3 l
     LEFT JOIN by_label q ON q.page_id = x.page_id AND q.label = l.label
     LEFT JOIN by_label t ON t.page_id = x.template_page_id AND t.label = l.label""", "page_pairs", "labels3", "by_label")

sql("grid_dots", """
SELECT x.page_id, x.template_page_id, q.label,
       CAST(sum(least(q.area, 1000000) * least(t.area, 1000000)) AS DOUBLE) AS dot
FROM page_pairs x JOIN cells48 q ON q.page_id = x.page_id
     JOIN t_cells48 t ON t.page_id = x.template_page_id AND t.label = q.label AND t.cell = q.cell
GROUP BY ALL""", "page_pairs", "cells48", "t_cells48")

sql("shares", f"""
SELECT q.page_id, t.page_id AS template_page_id, q.label, q.place AS qplace, t.place AS tplace, {box_sim('q', 't')} AS s
FROM page_pairs x JOIN leaders q ON q.page_id = x.page_id
     JOIN t_leaders t ON t.page_id = x.template_page_id AND t.label = q.label""", "page_pairs", "leaders", "t_leaders")

WALK = """walk AS (
  SELECT page_id, template_page_id, label, 0::BIGINT AS step, CAST([] AS BIGINT[]) AS used, 0.0::DOUBLE AS total
  FROM (SELECT DISTINCT page_id, template_page_id, label FROM shares)
  UNION ALL
  SELECT page_id, template_page_id, label, step + 1, list_append(used, -best.p), total + best.s
  FROM (SELECT w.page_id, w.template_page_id, w.label, w.step, w.used, w.total,
               max(struct_pack(s := k.s, p := -k.tplace)) AS best
        FROM walk w JOIN shares k ON k.page_id = w.page_id AND k.template_page_id = w.template_page_id
             AND k.label = w.label AND k.qplace = w.step + 1 AND NOT list_contains(w.used, k.tplace)
        GROUP BY ALL))"""

SCORED = f"""WITH RECURSIVE {WALK},
matched AS (SELECT page_id, template_page_id, label, max(total) AS total FROM walk GROUP BY ALL),
parts AS (
  SELECT p.*, CASE WHEN qnorm = 0 AND tnorm = 0 THEN 1.0::DOUBLE WHEN qnorm = 0 OR tnorm = 0 THEN 0.0::DOUBLE
              ELSE {clamp('coalesce(g.dot, 0.0::DOUBLE) / (qnorm * tnorm)')} END AS grid_part,
         CASE WHEN qn = 0 AND tn = 0 THEN 1.0::DOUBLE WHEN qn = 0 OR tn = 0 THEN 0.0::DOUBLE
              ELSE {clamp('m.total / greatest(qn, tn)')} END AS spatial_part
  FROM label_parts p LEFT JOIN grid_dots g USING (page_id, template_page_id, label)
       LEFT JOIN matched m USING (page_id, template_page_id, label)),
wide AS (
  SELECT page_id, template_page_id,
         {", ".join(f"max({c}_part) FILTER (label = '{l}') AS {c}_{l}" for c in ("count", "area", "grid", "spatial") for l in ("text", "table", "image"))}
  FROM parts GROUP BY ALL),
raw AS (
  SELECT x.page_id, x.doc_id, x.page_number, x.template_page_id, x.template_id, x.template_page_number,
         {ratio_sim(rnd('raw_q', 6), rnd('raw_t', 6))} AS a,
         {", ".join(f"(({c}_text + {c}_table + {c}_image) / 3) AS {c[0]}{c[1]}" for c in ("count", "area", "grid", "spatial"))}
  FROM page_pairs x JOIN wide USING (page_id, template_page_id)),
scored AS (
  SELECT page_id, doc_id, page_number, template_page_id, template_id, template_page_number,
         {rnd(clamp('a * 0.15::DOUBLE + co * 0.20::DOUBLE + ar * 0.20::DOUBLE + gr * 0.20::DOUBLE + sp * 0.25::DOUBLE'), 4)} AS score,
         {rnd('a', 4)} AS aspect_score, {rnd('co', 4)} AS label_count_score, {rnd('ar', 4)} AS area_distribution_score,
         {rnd('gr', 4)} AS grid_score, {rnd('sp', 4)} AS spatial_score
  FROM raw),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (
    PARTITION BY page_id, template_id ORDER BY score DESC, template_page_number) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, template_id) AS rank FROM best)
"""
SCORE_NEEDS = ("page_pairs", "label_parts", "grid_dots", "shares")


def page_signatures(spark: SparkSession, sf: str, maskable: bool = False) -> DataFrame:
    pages = derive.layout_pages(spark, sf)
    return signature.layout_signatures(pages, signature.usable_regions(derive.regions(spark, sf)), maskable=maskable)


def template_signatures(spark: SparkSession, sf: str, include: int | None = None, maskable: bool = False) -> DataFrame:
    """The catalog side: few rows, written once, read for every comparison."""
    catalog = derive.template_pages(spark, sf).join(bounded_broadcast(derive.template_versions(spark, sf)), "template_id")
    catalog = cut_lineage(retrieval.eligible_templates(catalog, include))
    ids = bounded_broadcast(catalog.select(F.col("template_page_id").alias("page_id")))
    pages = derive.layout_pages(spark, sf).join(ids, "page_id", "left_semi")
    regions = derive.regions(spark, sf).join(ids, "page_id", "left_semi")
    signatures = signature.layout_signatures(pages, signature.usable_regions(regions), maskable=maskable).drop("doc_id", "page_number")
    stored = signatures.withColumnRenamed("page_id", "template_page_id").join(catalog, "template_page_id")
    return cut_lineage(stored)


def ranked_templates(spark: SparkSession, sf: str, k: int = retrieval.TOP_K) -> DataFrame:
    return retrieval.ranked_templates(page_signatures(spark, sf), template_signatures(spark, sf), k)


@query("sc01_top01_template_retrieval", oracle(SCORED + """
SELECT page_id, CAST(rank AS INTEGER) AS rank, template_id, template_page_id, score, aspect_score, label_count_score,
       area_distribution_score, grid_score, spatial_score FROM ranked WHERE rank <= 5""", *SCORE_NEEDS))
def template_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    ranked = ranked_templates(spark, sf)
    return ranked.select("page_id", "rank", "template_id", "template_page_id", "score", *retrieval.SCORES)


@query("agg06_document_retrieval", oracle(SCORED + f""",
by_doc AS (SELECT doc_id, template_id, count(*) AS matched_pages, max(score) AS best_score,
     {rnd('sum(CAST(floor(score * 10000 + 0.5) AS BIGINT)) / 10000.0::DOUBLE / count(*)', 4)} AS score
   FROM ranked WHERE rank <= 10 GROUP BY ALL)
SELECT doc_id, template_id, matched_pages, best_score, score,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template_id) AS INTEGER) AS rank
FROM by_doc QUALIFY rank <= 10""", *SCORE_NEEDS))
def document_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.document_retrieval(ranked_templates(spark, sf, k=10))


# The included template is a draft; equal scores go to the higher version.
INCLUDED = 8


def _renamed(text: str, *changes: tuple[str, str]) -> str:
    for old, new in changes:
        text = text.replace(old, new)
    return text


# Pairs with the included template: the same chain of views over a wider set of pairs.
_WIDER = (("page_pairs", "pairs_incl"), ("label_parts", "parts_incl"), ("grid_dots", "dots_incl"), ("shares", "shares_incl"))
sql("pairs_incl", _renamed(derive.SQL["page_pairs"][0], ("v.status = 'active'", f"(v.status = 'active' OR v.template_id = {INCLUDED})"), ("t.template_id,", "t.template_id, v.version_number,")), *derive.SQL["page_pairs"][1])
for _old, _new in _WIDER[1:]:
    sql(_new, _renamed(derive.SQL[_old][0], *_WIDER), *[dict(_WIDER).get(n, n) for n in derive.SQL[_old][1]])


@query("top01_included_template", oracle(_renamed(SCORED, *_WIDER, ("(PARTITION BY page_id ORDER BY score DESC, template_id)", "(PARTITION BY page_id ORDER BY score DESC, version_number DESC, best.template_id)"),
    ("ranked AS (SELECT *, row_number()", "ranked AS (SELECT best.*, row_number()"), ("FROM best)", "FROM best JOIN template_versions v ON v.template_id = best.template_id)")) + f"""
SELECT page_id, CAST(rank AS INTEGER) AS rank, template_id, template_page_id, score FROM ranked WHERE rank <= 2 OR template_id = {INCLUDED}""", *[n for _, n in _WIDER]))
def included_template(spark: SparkSession, sf: str) -> DataFrame:
    """Two templates a page, newest version first among equals, and the draft that the user works on wherever it comes."""
    stored = template_signatures(spark, sf, INCLUDED).withColumnRenamed("version_number", "template_version")
    ranked = retrieval.ranked_templates(page_signatures(spark, sf), stored, 2, INCLUDED, "template_version")
    return ranked.select("page_id", "rank", "template_id", "template_page_id", "score")


# Masks of every second template page; the last one has no extent.
MASKS = ((0.0, 0.0, 0.45, 0.6), (0.5, 0.55, 0.3, 0.3), (0.1, 0.9, 0.0, 0.5))
sql("t_masks", "SELECT template_page_id, m.x AS mx, m.y AS my, m.w AS mw, m.h AS mh FROM template_pages, (VALUES " + ", ".join(
    "(" + ", ".join(f"{v}::DOUBLE" for v in m) + ")" for m in MASKS) + ") m(x, y, w, h) WHERE template_page_id % 40 = 0 AND m.w > 0 AND m.h > 0", "template_pages")
# A masked pair has pages of its own: the query page as this template sees it (negative, per pair) and the template page (negative).
sql("pairs_mask", """
SELECT x.*, CASE WHEN k.template_page_id IS NULL THEN x.page_id ELSE -((x.page_id + 1) * 10000000000 + x.template_page_id) END AS qkey,
  CASE WHEN k.template_page_id IS NULL THEN x.template_page_id ELSE -(x.template_page_id + 1) END AS tkey
FROM page_pairs x LEFT JOIN (SELECT DISTINCT template_page_id FROM t_masks) k USING (template_page_id)""", "page_pairs", "t_masks")
_OUTSIDE = "NOT EXISTS (SELECT 1 FROM t_masks m WHERE m.template_page_id = x.template_page_id AND u.centre_x BETWEEN mx AND mx + mw AND u.centre_y BETWEEN my AND my + mh)"
sql("usable_mask", f"""
SELECT u.* FROM usable u UNION ALL SELECT u.* REPLACE (x.qkey AS page_id) FROM usable u JOIN pairs_mask x ON x.page_id = u.page_id AND x.qkey < 0 WHERE {_OUTSIDE}
UNION ALL SELECT u.* REPLACE (x.tkey AS page_id) FROM usable u JOIN (SELECT DISTINCT template_page_id, tkey FROM pairs_mask WHERE tkey < 0) x ON x.template_page_id = u.page_id WHERE {_OUTSIDE}""", "usable", "pairs_mask", "t_masks")
# The template side is named apart again, so that the comparison stays a join of every page with few others.
_FEW = "SELECT * FROM {} SEMI JOIN (SELECT DISTINCT tkey AS page_id FROM pairs_mask) USING (page_id)"
_MASKED = (("t_cells48", "tmask_cells"), ("cells48 q", "cells48_mask q"), ("JOIN t_leaders", "JOIN tmask_leaders"), ("JOIN leaders q", "JOIN leaders_mask q"), ("by_label", "by_label_mask"), ("FROM usable", "FROM usable_mask"),
           ("FROM cells48", "FROM cells48_mask"), ("SELECT q.page_id, t.page_id AS template_page_id", "SELECT x.page_id, x.template_page_id"), ("q.page_id = x.page_id", "q.page_id = x.qkey"),
           ("t.page_id = x.template_page_id", "t.page_id = x.tkey"), ("page_pairs", "pairs_mask"), ("label_parts", "parts_mask"), ("grid_dots", "dots_mask"), ("shares", "shares_mask"))
for _old, _new, _needs in (
    ("cells48", "cells48_mask", ("usable_mask",)), ("by_label", "by_label_mask", ("cells48_mask",)), ("leaders", "leaders_mask", ("usable_mask",)),
    ("label_parts", "parts_mask", ("pairs_mask", "labels3", "by_label_mask")), ("grid_dots", "dots_mask", ("pairs_mask", "cells48_mask", "tmask_cells")), ("shares", "shares_mask", ("pairs_mask", "leaders_mask", "tmask_leaders")),
):
    sql(_new, _renamed(derive.SQL[_old][0], *_MASKED), *_needs)
sql("tmask_cells", _FEW.format("cells48_mask"), "cells48_mask", "pairs_mask")
sql("tmask_leaders", _FEW.format("leaders_mask"), "leaders_mask", "pairs_mask")


@query("join07_masked_retrieval", oracle(_renamed(SCORED, *_MASKED) + """
SELECT page_id, CAST(rank AS INTEGER) AS rank, template_id, template_page_id, score, aspect_score, label_count_score,
       area_distribution_score, grid_score, spatial_score FROM ranked WHERE rank <= 5""", "pairs_mask", "parts_mask", "dots_mask", "shares_mask"))
def masked_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """The retrieval where templates hide parts of the page from the comparison."""
    boxes = ", ".join("named_struct(" + ", ".join(f"'{n}', {v}D" for n, v in zip(RATIO, m)) + ")" for m in MASKS)
    stored = template_signatures(spark, sf, maskable=True).withColumn("template_masks", F.expr(f"CASE WHEN template_page_id % 40 = 0 THEN array({boxes}) END"))
    ranked = retrieval.ranked_templates(page_signatures(spark, sf, maskable=True), stored)
    return ranked.select("page_id", "rank", "template_id", "template_page_id", "score", *retrieval.SCORES)


@query("agg01_layout_signature", oracle(f"""
WITH slots AS (SELECT p.page_id, l.label, g.cell, coalesce(c.n, 0) AS n, least(coalesce(c.area, 0), 1000000) AS area
  FROM layout_pages p CROSS JOIN labels3 l CROSS JOIN (SELECT unnest(range(16)) AS cell) g
  LEFT JOIN cells48 c ON c.page_id = p.page_id AND c.label = l.label AND c.cell = g.cell),
packed AS (SELECT page_id, label, array_to_string(list(n ORDER BY cell), ',') AS counts,
                  array_to_string(list(area ORDER BY cell), ',') AS areas FROM slots GROUP BY ALL)
SELECT p.page_id, {rnd('any_value(p.image_width) / any_value(p.image_height)', 6)} AS page_aspect_ratio,
       CAST(coalesce(sum(b.n), 0) AS BIGINT) AS region_count,
       {", ".join(f"CAST(coalesce(max(b.n) FILTER (k.label = '{l}'), 0) AS BIGINT) AS count_{l}, coalesce(max(b.area) FILTER (k.label = '{l}'), 0.0::DOUBLE) AS area_{l}, max(k.counts) FILTER (k.label = '{l}') AS grid_counts_{l}, max(k.areas) FILTER (k.label = '{l}') AS grid_units_{l}" for l in ("text", "table", "image"))}
FROM layout_pages p JOIN packed k ON k.page_id = p.page_id
     LEFT JOIN by_label b ON b.page_id = p.page_id AND b.label = k.label
GROUP BY p.page_id""", "layout_pages", "labels3", "by_label"))
def layout_signature(spark: SparkSession, sf: str) -> DataFrame:
    signatures = page_signatures(spark, sf)
    out = ["page_id", "page_aspect_ratio", "region_count"]
    for label in signature.LABELS:
        out += [
            f"count_{label}",
            f"area_{label}",
            F.array_join(F.col(f"grid_count_{label}").cast("array<string>"), ",").alias(f"grid_counts_{label}"),
            F.array_join(F.col(f"grid_units_{label}").cast("array<string>"), ",").alias(f"grid_units_{label}"),
        ]
    return signatures.select(*out)
