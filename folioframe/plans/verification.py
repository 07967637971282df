"""Anchor texts, category logits, evidence roll-up and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import text as txt
from folioframe.functions.numeric import rnd_sql
from folioframe.operators import decision
from folioframe.plans import derive
from folioframe.plans.derive import oracle, sql, table
from folioframe.plans.registry import query
from folioframe.plans.sqltext import clamp, rnd

# Every document is read against the benchmark passage its number points to.
sql("readings", """
SELECT d.doc_id, b.item_id AS anchor_id,
       CASE d.doc_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'contains' ELSE 'regex' END AS match_type,
       b.text AS expected_text,
       CASE d.doc_id % 3 WHEN 0 THEN concat('  ', lower(b.text), ' x') WHEN 1 THEN substr(b.text, 5) ELSE d.text END AS actual_text,
       CASE WHEN d.doc_id % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(60 + d.doc_id % 40 AS DOUBLE) / 100 END AS threshold
FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    benchmark = table(spark, sf, "benchmark")
    total = benchmark.agg(F.count("*").alias("items"))
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("doc_text")).crossJoin(F.broadcast(total))
    joined = docs.withColumn("item_id", F.expr("doc_id % items")).join(benchmark, "item_id")
    return joined.selectExpr(
        "doc_id", "item_id AS anchor_id",
        "CASE doc_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'contains' ELSE 'regex' END AS match_type",
        "text AS expected_text",
        "CASE doc_id % 3 WHEN 0 THEN concat('  ', lower(text), ' x') WHEN 1 THEN substr(text, 5) ELSE doc_text END AS actual_text",
        "CASE WHEN doc_id % 5 = 0 THEN 0D ELSE cast(60 + doc_id % 40 AS double) / 100 END AS threshold",
    )


def _form(column: str) -> str:
    zero = "chr(8203) || chr(8204) || chr(8205) || chr(65279)"
    return rf"regexp_replace(lower(translate({column}, {zero}, '')), '[\s\p{{Z}}\x0B\x1C-\x1F\x85]+', '', 'g')"


sql("forms", f"""
SELECT *, regexp_replace(expected, '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS expected_key,
          regexp_replace(actual, '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS actual_key
FROM (SELECT *, {_form('expected_text')} AS expected, {_form('actual_text')} AS actual FROM readings)""", "readings")


@query("txt03_anchor_forms", oracle(
    "SELECT doc_id, anchor_id, md5(expected) AS expected, md5(actual) AS actual, md5(expected_key) AS expected_key,"
    " md5(actual_key) AS actual_key FROM forms", "forms"))
def anchor_forms(spark: SparkSession, sf: str) -> DataFrame:
    forms = txt.normalised_readings(readings(spark, sf))
    return forms.select("doc_id", "anchor_id", *[F.md5(c).alias(c) for c in ("expected", "actual", "expected_key", "actual_key")])


@query("sim03_anchor_evidence", oracle(f"""
SELECT doc_id, anchor_id, actual = expected AS equal, contains(actual, expected) AS holds, contains(expected, actual) AS held,
       regexp_matches(actual, expected) AS pattern_found,
       {rnd('2.0::DOUBLE * least(length(expected_key), length(actual_key)) / greatest(1, length(expected_key) + length(actual_key))', 6)} AS ratio_bound
FROM forms""", "forms"))
def anchor_evidence(spark: SparkSession, sf: str) -> DataFrame:
    forms = txt.normalised_readings(readings(spark, sf))
    bound = txt.ratio_bound(F.col("expected_key"), F.col("actual_key"))
    return forms.select(
        "doc_id", "anchor_id", F.expr("actual = expected AS equal"), F.expr("contains(actual, expected) AS holds"),
        F.expr("contains(expected, actual) AS held"),
        txt._pattern_found(F.col("expected"), F.col("actual")).alias("pattern_found"),
        (F.floor(bound * 1e6 + 0.5) / 1e6).alias("ratio_bound"),
    )


@query("sim01_sim03_anchor_scores")
def anchor_scores(spark: SparkSession, sf: str) -> DataFrame:
    return txt.score_readings(readings(spark, sf)).select(
        "doc_id", "anchor_id", "kind", "text_similarity", "score", "limit", "passed", "failure_reason"
    )


# Checked anchors of a page: its regions, images checked as image anchors.
sql("checked", """
SELECT page_id, region_id AS anchor_id, CASE WHEN label = 'image' THEN 'image' ELSE 'text' END AS anchor_type,
       confidence AS score, CASE WHEN region_id % 4 = 0 THEN NULL WHEN page_id % 5 = 1 THEN 0.004::DOUBLE ELSE CAST(region_id % 3 AS DOUBLE) END AS weight,
       region_id % 2 = 0 AS required, confidence >= 0.6 AS passed FROM regions""", "regions")


def checked(spark: SparkSession, sf: str) -> DataFrame:
    return derive.regions(spark, sf).selectExpr(
        "page_id", "region_id AS anchor_id", "CASE WHEN label = 'image' THEN 'image' ELSE 'text' END AS anchor_type",
        "confidence AS score", "CASE WHEN region_id % 4 = 0 THEN NULL WHEN page_id % 5 = 1 THEN 0.004D ELSE cast(region_id % 3 AS double) END AS weight",
        "region_id % 2 = 0 AS required", "confidence >= 0.6D AS passed",
    )


def _mean(cond: str) -> str:
    w = "greatest(0.0::DOUBLE, coalesce(nullif(weight, 0), 1.0::DOUBLE))"
    s = "floor(score * 10000 + 0.5)"
    return rnd(f"coalesce(sum({w} * {s}) {cond} / nullif(sum({w}) {cond}, 0), 0.0::DOUBLE) / 10000.0::DOUBLE", 4)


@query("agg03_verification_rollup", oracle(f"""
WITH r AS (SELECT page_id, count(*) AS anchors, coalesce(bool_and(passed) FILTER (required), true) AS required_passed,
  count(*) FILTER (required AND NOT passed) AS required_failed, {_mean('')} AS score,
  CASE WHEN count(*) FILTER (anchor_type = 'text') = 0 THEN 1.0::DOUBLE ELSE {_mean("FILTER (anchor_type = 'text')")} END AS text_anchor_score,
  CASE WHEN count(*) FILTER (anchor_type = 'image') = 0 THEN 1.0::DOUBLE ELSE {_mean("FILTER (anchor_type = 'image')")} END AS image_anchor_score,
  count(*) FILTER (anchor_type = 'text') > 0 AS has_text_anchor, count(*) FILTER (anchor_type = 'image') > 0 AS has_image_anchor
  FROM checked GROUP BY page_id)
SELECT p.page_id, coalesce(anchors, 0) AS anchors, coalesce(required_passed, true) AS required_passed, coalesce(required_failed, 0) AS required_failed,
  coalesce(score, 1.0::DOUBLE) AS score, coalesce(text_anchor_score, 1.0::DOUBLE) AS text_anchor_score,
  coalesce(image_anchor_score, 1.0::DOUBLE) AS image_anchor_score, coalesce(has_text_anchor, false) AS has_text_anchor,
  coalesce(has_image_anchor, false) AS has_image_anchor,
  CASE WHEN anchors IS NULL THEN 'no_verification_fields' WHEN required_passed THEN 'verified' ELSE 'failed' END AS status
FROM layout_pages p LEFT JOIN r USING (page_id)""", "checked", "layout_pages"))
def verification_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rollup = decision.verification_rollup(checked(spark, sf), "page_id")
    return decision.with_unanchored(rollup, derive.layout_pages(spark, sf), "page_id")


@query("agg04_required_failures", oracle("""
SELECT page_id, bool_and(passed) AS required_passed, count(*) FILTER (NOT passed) AS failed,
       coalesce(string_agg(CAST(anchor_id AS VARCHAR), ',' ORDER BY anchor_id) FILTER (NOT passed), '') AS failed_anchors
FROM checked WHERE required GROUP BY page_id""", "checked"))
def required_failures(spark: SparkSession, sf: str) -> DataFrame:
    needed = checked(spark, sf).filter("required")
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("anchor_id"))))
    return needed.groupBy("page_id").agg(
        F.bool_and("passed").alias("required_passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.array_join(failed.cast("array<string>"), ",").alias("failed_anchors"),
    )


sql("candidates", """
SELECT o_custkey AS doc_id, o_orderkey % 3 AS template_id, o_orderkey AS page_candidate_id,
       CAST((o_orderkey * 37) % 101 AS DOUBLE) / 100 AS retrieval_score,
       CAST((o_orderkey * 53) % 101 AS DOUBLE) / 100 AS text_anchor_score,
       CAST((o_orderkey * 71) % 2 AS DOUBLE) AS image_anchor_score,
       o_orderkey % 4 <> 0 AS has_text_anchor, o_orderkey % 3 <> 0 AS has_image_anchor, o_orderkey % 7 <> 0 AS required_passed,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 12 AS DOUBLE) / 10 END AS final_confidence_threshold,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 8 AS DOUBLE) / 5 END AS layout_weight,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS DOUBLE) / 5 END AS text_anchor_weight,
       CAST(o_orderkey % 3 AS DOUBLE) / 5 AS image_anchor_weight,
       CAST(o_orderkey % 6 AS DOUBLE) / 10 AS similarity_threshold
FROM orders""")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS doc_id", "o_orderkey % 3 AS template_id", "o_orderkey AS page_candidate_id",
        "cast((o_orderkey * 37) % 101 AS double) / 100 AS retrieval_score",
        "cast((o_orderkey * 53) % 101 AS double) / 100 AS text_anchor_score",
        "cast((o_orderkey * 71) % 2 AS double) AS image_anchor_score",
        "o_orderkey % 4 <> 0 AS has_text_anchor", "o_orderkey % 3 <> 0 AS has_image_anchor", "o_orderkey % 7 <> 0 AS required_passed",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(o_orderkey % 12 AS double) / 10 END AS final_confidence_threshold",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE cast(o_orderkey % 8 AS double) / 5 END AS layout_weight",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE cast(o_orderkey % 4 AS double) / 5 END AS text_anchor_weight",
        "cast(o_orderkey % 3 AS double) / 5 AS image_anchor_weight",
        "cast(o_orderkey % 6 AS double) / 10 AS similarity_threshold",
    )


def _decide_sql(source: str, tail: str) -> str:
    """Common table expressions that turn candidate rows into decided rows named `decided`."""
    rest = "(l + t + i)"
    use = "(el + et + ei)"
    return f"""
s1 AS (SELECT *, CASE WHEN final_confidence_threshold > 0 AND final_confidence_threshold <= 1 THEN final_confidence_threshold ELSE 0.75::DOUBLE END AS threshold,
   {clamp('coalesce(layout_weight, 0.5::DOUBLE)')} AS l, {clamp('coalesce(text_anchor_weight, 0.35::DOUBLE)')} AS t,
   {clamp('coalesce(image_anchor_weight, 0.15::DOUBLE)')} AS i FROM {source}),
s2 AS (SELECT *, CASE WHEN {rest} <= 0 THEN 0.5::DOUBLE ELSE {rnd(f'l / {rest}', 4)} END AS set_layout,
   CASE WHEN {rest} <= 0 THEN 0.35::DOUBLE ELSE {rnd(f't / {rest}', 4)} END AS set_text_anchor,
   CASE WHEN {rest} <= 0 THEN 0.15::DOUBLE ELSE {rnd(f'i / {rest}', 4)} END AS set_image_anchor FROM s1),
s3 AS (SELECT *, set_layout AS el, CASE WHEN has_text_anchor THEN set_text_anchor ELSE 0.0::DOUBLE END AS et,
   CASE WHEN has_image_anchor THEN set_image_anchor ELSE 0.0::DOUBLE END AS ei FROM s2),
s4 AS (SELECT *, CASE WHEN {use} <= 0 THEN 1.0::DOUBLE ELSE {rnd(f'el / {use}', 4)} END AS use_layout,
   CASE WHEN {use} <= 0 THEN 0.0::DOUBLE ELSE {rnd(f'et / {use}', 4)} END AS use_text_anchor,
   CASE WHEN {use} <= 0 THEN 0.0::DOUBLE ELSE {rnd(f'ei / {use}', 4)} END AS use_image_anchor FROM s3),
s5 AS (SELECT *, CASE WHEN use_text_anchor + use_image_anchor > 0 THEN
     {rnd('(text_anchor_score * use_text_anchor + image_anchor_score * use_image_anchor) / (use_text_anchor + use_image_anchor)', 4)} ELSE 0.0::DOUBLE END AS anchor_score,
   {rnd('retrieval_score * use_layout + text_anchor_score * use_text_anchor + image_anchor_score * use_image_anchor', 4)} AS final_score FROM s4),
decided AS (SELECT *, final_score >= threshold AND required_passed AND retrieval_score >= 0.5 AS final_passed,
   CASE WHEN NOT required_passed THEN 'required_verification_failed' WHEN retrieval_score < 0.5 THEN 'layout_score_below_threshold'
        WHEN final_score < threshold THEN 'final_threshold_failed' ELSE 'final_threshold_passed' END AS decision_path FROM s5)
{tail}"""


WEIGHTS = ["threshold", "set_layout", "set_text_anchor", "set_image_anchor", "use_layout", "use_text_anchor", "use_image_anchor"]


@query("sc03_settings", oracle("WITH " + _decide_sql("candidates", f"SELECT page_candidate_id, {', '.join(WEIGHTS)} FROM decided"), "candidates"))
def settings(spark: SparkSession, sf: str) -> DataFrame:
    return decision.resolve_settings(candidates(spark, sf)).select("page_candidate_id", *WEIGHTS)


@query("sc04_decision", oracle("WITH " + _decide_sql("candidates", """
SELECT page_candidate_id, anchor_score, final_score, final_passed, decision_path FROM decided"""), "candidates"))
def final_decision(spark: SparkSession, sf: str) -> DataFrame:
    return decision.decide(candidates(spark, sf)).select(
        "page_candidate_id", "anchor_score", "final_score", "final_passed", "decision_path"
    )


GATED = """gated AS (SELECT * REPLACE (final_passed AND retrieval_score >= coalesce(nullif(similarity_threshold, 0), 0.75) AS final_passed) FROM decided)"""


@query("sc05_layout_gate", oracle("WITH " + _decide_sql("candidates", f""", {GATED}
SELECT page_candidate_id, final_passed FROM gated"""), "candidates"))
def layout_gate(spark: SparkSession, sf: str) -> DataFrame:
    return decision.layout_gate(decision.decide(candidates(spark, sf))).select("page_candidate_id", "final_passed")


STATUS = """status AS (SELECT *, row_number() OVER w AS retrieval_rank,
  CASE WHEN retrieval_score < 0.5 THEN 'layout_rejected' WHEN row_number() OVER w <= 5 AND coalesce(max(CASE WHEN retrieval_score >= 0.5 AND final_passed THEN 1 ELSE 0 END)
      OVER w2, 0) = 0 THEN 'full' ELSE 'lightweight' END AS evaluation_status
  FROM gated WINDOW w AS (PARTITION BY doc_id ORDER BY retrieval_score DESC, page_candidate_id),
   w2 AS (PARTITION BY doc_id ORDER BY retrieval_score DESC, page_candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("win15_evaluation_status", oracle("WITH " + _decide_sql("candidates", f""", {GATED}, {STATUS}
SELECT page_candidate_id, CAST(retrieval_rank AS INTEGER) AS retrieval_rank, evaluation_status FROM status"""), "candidates"))
def evaluation_status(spark: SparkSession, sf: str) -> DataFrame:
    gated = decision.layout_gate(decision.decide(candidates(spark, sf)))
    return decision.evaluation_status(gated, "doc_id").select("page_candidate_id", "retrieval_rank", "evaluation_status")


@query("top02_page_ranking", oracle("WITH " + _decide_sql("candidates", f""", {GATED}, {STATUS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY final_passed DESC, evaluation_status = 'full' DESC, final_score DESC,
   retrieval_score DESC, page_candidate_id) AS rank FROM status)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, page_candidate_id, final_score, rank = 1 AND final_passed AS best FROM ranked"""), "candidates"))
def page_ranking(spark: SparkSession, sf: str) -> DataFrame:
    gated = decision.layout_gate(decision.decide(candidates(spark, sf)))
    ranked = decision.rank_candidates(decision.evaluation_status(gated, "doc_id"), "doc_id")
    return ranked.select("doc_id", "rank", "page_candidate_id", "final_score", F.expr("rank = 1 AND final_passed AS best"))


DOCS = f""", {GATED},
best AS (SELECT * FROM gated QUALIFY row_number() OVER (PARTITION BY doc_id, template_id ORDER BY retrieval_score DESC, page_candidate_id) = 1),
sums AS (SELECT doc_id, template_id, {rnd('sum(CAST(floor(retrieval_score * 10000 + 0.5) AS BIGINT)) / 10000.0::DOUBLE / count(*)', 6)} AS average_score,
    count(*) AS page_count, count(*) FILTER (final_passed) AS matched_pages FROM gated GROUP BY ALL),
docs AS (SELECT b.doc_id, b.template_id, retrieval_score, page_count, matched_pages, average_score, final_score, s.final_passed, decision_path
  FROM (SELECT * EXCLUDE (final_passed), final_score >= threshold AND required_passed AND retrieval_score >= 0.5 AS final_passed FROM best) s
  JOIN best b USING (doc_id, template_id, page_candidate_id, retrieval_score, final_score, decision_path) JOIN sums USING (doc_id, template_id))"""


@query("agg05_document_candidates", oracle("WITH " + _decide_sql("candidates", f"""{DOCS}
SELECT * FROM docs"""), "candidates"))
def document_candidates(spark: SparkSession, sf: str) -> DataFrame:
    gated = decision.layout_gate(decision.decide(candidates(spark, sf)))
    return decision.document_candidates(gated).select(
        "doc_id", "template_id", "retrieval_score", "page_count", "matched_pages", "average_score", "final_score",
        "final_passed", "decision_path",
    )


@query("top03_draft_report", oracle("WITH " + _decide_sql("candidates", f"""{DOCS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY final_score DESC, retrieval_score DESC, template_id) AS rank,
     template_id = doc_id % 3 AS is_draft FROM docs),
chosen AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY final_passed DESC, final_score DESC, retrieval_score DESC, rank) = 1),
draft AS (SELECT doc_id, rank FROM ranked WHERE is_draft)
SELECT c.doc_id, CAST(d.rank AS INTEGER) AS draft_rank, c.template_id AS selected_template, c.final_score AS final_confidence,
  CASE WHEN c.is_draft THEN 'draft' ELSE 'published' END AS selected_type,
  c.final_passed AND c.is_draft AND coalesce(d.rank = 1, false) AS passed, NOT c.is_draft AS warning
FROM chosen c LEFT JOIN draft d ON d.doc_id = c.doc_id"""), "candidates"))
def draft_report(spark: SparkSession, sf: str) -> DataFrame:
    gated = decision.layout_gate(decision.decide(candidates(spark, sf)))
    return decision.draft_report(decision.document_candidates(gated), F.expr("doc_id % 3"))


@query("sc06_alignment_precheck", oracle(f"""
WITH p AS (SELECT q.page_id, q.image_width AS qw, q.image_height AS qh, t.image_width AS tw, t.image_height AS th,
    q.page_id % 11 = 0 AS fallback_used, CASE WHEN q.page_id % 13 = 0 THEN NULL ELSE CAST(q.page_id % 10 AS DOUBLE) END AS e,
    CAST(q.page_id % 12 AS DOUBLE) / 10 AS inl
  FROM layout_pages q JOIN customer c ON c.c_custkey = q.doc_id
       JOIN template_pages tp ON tp.template_id = c.c_nationkey AND tp.page_number = q.page_number
       JOIN layout_pages t ON t.page_id = tp.template_page_id),
m AS (SELECT *, abs(qw / qh - tw / th) / greatest(qw / qh, tw / th, 1e-6::DOUBLE) AS delta,
   CASE WHEN abs(qw - qh) / greatest(qw, qh, 1) <= 0.02 THEN 'square' WHEN qw > qh THEN 'landscape' ELSE 'portrait' END
   = CASE WHEN abs(tw - th) / greatest(tw, th, 1) <= 0.02 THEN 'square' WHEN tw > th THEN 'landscape' ELSE 'portrait' END AS same,
   CASE WHEN e IS NULL THEN 0.0::DOUBLE WHEN e <= 1 THEN 1.0 WHEN e <= 2 THEN 0.90 WHEN e <= 3 THEN 0.80 WHEN e <= 5 THEN 0.65 WHEN e <= 8 THEN 0.45 ELSE 0.20 END AS q FROM p)
SELECT page_id, NOT (same AND delta <= 0.04) OR fallback_used AS should_align,
  CASE WHEN fallback_used THEN 'normalization_fallback_alignment_may_help' WHEN same AND delta <= 0.04 THEN 'normalized_geometry_matches_template'
       ELSE 'geometry_mismatch_alignment_may_help' END AS reason, {rnd('delta', 4)} AS aspect_delta,
  {rnd(clamp('0.7::DOUBLE * q::DOUBLE + 0.3::DOUBLE * ' + clamp('inl')), 4)} AS alignment_score FROM m""", "layout_pages", "template_pages"))
def alignment_precheck(spark: SparkSession, sf: str) -> DataFrame:
    pages = derive.layout_pages(spark, sf)
    nations = table(spark, sf, "customer").selectExpr("c_custkey AS doc_id", "cast(c_nationkey AS bigint) AS template_id")
    sizes = pages.selectExpr("page_id AS template_page_id", "image_width AS template_width", "image_height AS template_height")
    catalog = derive.template_pages(spark, sf).join(sizes, "template_page_id")
    pairs = pages.join(nations, "doc_id").join(catalog, ["template_id", "page_number"]).selectExpr(
        "page_id", "image_width AS query_width", "image_height AS query_height", "template_width", "template_height",
        "page_id % 11 = 0 AS fallback_used",
        "CASE WHEN page_id % 13 = 0 THEN NULL ELSE cast(page_id % 10 AS double) END AS reprojection_error",
        "cast(page_id % 12 AS double) / 10 AS inlier_ratio",
    )
    return decision.alignment_precheck(pairs).select("page_id", "should_align", "reason", "aspect_delta", "alignment_score")


@query("sc07_better_verification", oracle(f"""
WITH s AS (SELECT page_candidate_id, text_anchor_score AS n, CASE WHEN page_candidate_id % 5 = 0 THEN NULL ELSE retrieval_score END AS a FROM candidates)
SELECT page_candidate_id, CASE WHEN a >= n THEN 'aligned' ELSE 'normalized' END AS source_used,
  CASE WHEN a >= n THEN a ELSE n END AS used_score, {rnd('a - n', 4)} AS improvement FROM s""", "candidates"))
def better_verification(spark: SparkSession, sf: str) -> DataFrame:
    scores = candidates(spark, sf).selectExpr(
        "page_candidate_id", "text_anchor_score AS normalized_score",
        "CASE WHEN page_candidate_id % 5 = 0 THEN NULL ELSE retrieval_score END AS aligned_score",
    )
    return decision.better_verification(scores).select("page_candidate_id", "source_used", "used_score", "improvement")


# Category logits of an image: its embedding times ten, one category per dimension.
sql("logits", """
SELECT vec_id AS image_id, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN 1000 ELSE label END AS target, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 10) AS logits,
  CASE vec_id % 3 WHEN 0 THEN CAST(label AS VARCHAR) WHEN 1 THEN '["' || label || '", "' || (label + 1) || '"]' ELSE '' END AS image_category
FROM embeddings""")


def logits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS image_id", "CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN 1000 ELSE label END AS target", "transform(embedding, v -> cast(v AS double) * 10) AS logits",
        """CASE vec_id % 3 WHEN 0 THEN cast(label AS string) WHEN 1 THEN concat('["', label, '", "', label + 1, '"]') ELSE '' END AS image_category""",
    )


sql("logit_rows", """
SELECT image_id, target, image_category, unnest(range(len(logits))) AS pos, unnest(logits) AS v FROM logits""", "logits")


@query("win13_category_evidence", oracle(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, pos) AS rank, max(v) OVER (PARTITION BY image_id) AS top FROM logit_rows),
t AS (SELECT *, sum(exp(v - top)) OVER (PARTITION BY image_id) AS total FROM r),
s AS (SELECT *, {rnd('exp(v - top) / total * 100', 1)} AS share FROM t),
g AS (SELECT image_id, any_value(target) AS target, any_value(top) AS top, any_value(total) AS total, max(v) FILTER (rank = 2) AS second,
   max(v) FILTER (pos = target) AS raw, max(rank) FILTER (pos = target) AS target_rank, max(pos) FILTER (rank = 1) AS predicted,
   {rnd('100.0::DOUBLE - sum(share)', 1)} AS residue, max(share) AS top_share FROM s GROUP BY image_id)
SELECT image_id, target, CAST(predicted AS INTEGER) AS predicted, CAST(target_rank AS INTEGER) AS target_rank, coalesce(target_rank = 1, false) AS passed,
  CASE WHEN target_rank = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS evidence_score, CASE WHEN raw IS NULL THEN 'error' WHEN target_rank = 1 THEN 'matched' ELSE 'mismatched' END AS status, CASE WHEN raw IS NULL THEN 'category_not_found' END AS error,
  {rnd('CASE WHEN target_rank = 1 THEN top - second ELSE raw - top END', 4)} AS score_margin, {rnd('raw', 4)} AS raw_logit,
  {rnd('1 / (1 + exp(-raw))', 4)} AS raw_pair_score, {rnd('exp(raw - top) / total * 100', 2)} AS relative_percentage,
  {rnd('top_share + residue', 1)} AS top_percentage FROM g""", "logit_rows"))
def category_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return decision.category_evidence(logits(spark, sf))


@query("win14_choose_category", oracle("""
WITH c AS (SELECT image_id, CAST(list_position(logits, list_max(logits)) - 1 AS VARCHAR) AS first_place,
  CASE WHEN image_category LIKE '[%' THEN from_json(image_category, '["VARCHAR"]') WHEN image_category = '' THEN CAST([] AS VARCHAR[]) ELSE [image_category] END AS choices FROM logits)
SELECT image_id, CAST(len(choices) AS INTEGER) AS choice_count, CASE WHEN list_contains(choices, first_place) THEN first_place ELSE choices[1] END AS chosen,
  list_contains(choices, first_place) AS passed FROM c""", "logits"))
def choose_category(spark: SparkSession, sf: str) -> DataFrame:
    return decision.choose_category(logits(spark, sf))


@query("sim05_cosine", oracle(f"""
WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda v: CAST(v AS DOUBLE)) AS x, list_transform(b.embedding, lambda v: CAST(v AS DOUBLE)) AS y
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
n AS (SELECT vec_id, list_dot_product(x, y) AS d, sqrt(list_dot_product(x, x)) AS nx, sqrt(list_dot_product(y, y)) AS ny FROM p)
SELECT vec_id, {rnd('CASE WHEN nx = 0 OR ny = 0 THEN 0 ELSE d / (nx * ny) END', 6)} AS strict_cosine,
  {rnd('CASE WHEN nx = 0 AND ny = 0 THEN 1 WHEN nx = 0 OR ny = 0 THEN 0 ELSE ' + clamp('d / (nx * ny)') + ' END', 6)} AS clamped_cosine FROM n"""))
def cosine(spark: SparkSession, sf: str) -> DataFrame:
    from folioframe.functions.numeric import rnd as rounded
    from folioframe.functions.similarity import strict_cosine, vector_similarity

    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return rows.join(following, "vec_id").select(
        "vec_id", rounded(strict_cosine(a, b), 6).alias("strict_cosine"),
        rounded(vector_similarity(a, b), 6).alias("clamped_cosine"),
    )
