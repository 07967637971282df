"""Evidence roll-up and the final decision for match candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions.numeric import clamp_sql, rnd_sql, units

# Default weights and thresholds of the decision, and the evaluation limit per page.
DEFAULT_WEIGHTS = {"layout": 0.50, "text_anchor": 0.35, "image_anchor": 0.15}
DEFAULT_THRESHOLD = 0.75
MIN_LAYOUT_SCORE = 0.50
FULL_EVALUATIONS = 5


def verification_rollup(checked: DataFrame, key: str) -> DataFrame:
    """Weighted scores per template; required anchors must all pass. Weight null or 0 counts as 1."""
    weight = F.greatest(F.lit(0.0), F.coalesce(F.expr("nullif(weight, 0)"), F.lit(1.0)))
    # Decimals, so that the sums are exact and no weight is too small to count.
    w, s = weight.cast("decimal(20,12)"), units(F.col("score"), 4)

    def kind(name: str) -> Column:
        return F.col("anchor_type") == name

    text, image = kind("text"), kind("image")
    sums = checked.groupBy(key).agg(
        F.sum(w).alias("w"), F.sum(w * s).alias("ws"),
        F.sum(F.when(text, w)).alias("tw"), F.sum(F.when(text, w * s)).alias("tws"),
        F.sum(F.when(image, w)).alias("iw"), F.sum(F.when(image, w * s)).alias("iws"),
        F.count("*").alias("anchors"),
        F.coalesce(F.bool_and(F.when(F.col("required"), F.col("passed"))), F.lit(True)).alias("required_passed"),
        F.count_if(F.col("required") & ~F.col("passed")).alias("required_failed"),
    )
    return sums.selectExpr(
        key, "anchors", "required_passed", "required_failed",
        rnd_sql("coalesce(cast(ws AS double) / nullif(cast(w AS double), 0D), 0D) / 10000D", 4) + " AS score",
        "CASE WHEN tw IS NULL THEN 1D ELSE " + rnd_sql("coalesce(cast(tws AS double) / nullif(cast(tw AS double), 0D), 0D) / 10000D", 4) + " END AS text_anchor_score",
        "CASE WHEN iw IS NULL THEN 1D ELSE " + rnd_sql("coalesce(cast(iws AS double) / nullif(cast(iw AS double), 0D), 0D) / 10000D", 4) + " END AS image_anchor_score",
        "tw IS NOT NULL AS has_text_anchor", "iw IS NOT NULL AS has_image_anchor",
        "CASE WHEN required_passed THEN 'verified' ELSE 'failed' END AS status",
    )


def with_unanchored(rollup: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """Templates without anchors pass with full score and no anchor kinds."""
    joined = templates.select(key).join(rollup, key, "left")
    return joined.selectExpr(
        key, "coalesce(anchors, 0L) AS anchors", "coalesce(required_passed, true) AS required_passed",
        "coalesce(required_failed, 0L) AS required_failed", "coalesce(score, 1D) AS score",
        "coalesce(text_anchor_score, 1D) AS text_anchor_score", "coalesce(image_anchor_score, 1D) AS image_anchor_score",
        "coalesce(has_text_anchor, false) AS has_text_anchor", "coalesce(has_image_anchor, false) AS has_image_anchor",
        "coalesce(status, 'no_verification_fields') AS status",
    )


def resolve_settings(candidates: DataFrame) -> DataFrame:
    """Usable threshold, configured weights and the weights left when an anchor kind is absent."""
    names = list(DEFAULT_WEIGHTS)
    threshold = (
        f"CASE WHEN final_confidence_threshold > 0 AND final_confidence_threshold <= 1"
        f" THEN final_confidence_threshold ELSE {DEFAULT_THRESHOLD}D END AS threshold"
    )
    read = [clamp_sql(f"coalesce({n}_weight, {d}D)") + f" AS raw_{n}" for n, d in DEFAULT_WEIGHTS.items()]
    step = candidates.selectExpr("*", threshold, *read)
    total = " + ".join(f"raw_{n}" for n in names)
    configured = [
        f"CASE WHEN {total} <= 0 THEN {d}D ELSE {rnd_sql(f'raw_{n} / ({total})', 4)} END AS set_{n}"
        for n, d in DEFAULT_WEIGHTS.items()
    ]
    step = step.selectExpr("*", *configured).drop(*[f"raw_{n}" for n in names])
    present = {"layout": "true", "text_anchor": "has_text_anchor", "image_anchor": "has_image_anchor"}
    left = {n: f"(CASE WHEN {present[n]} THEN set_{n} ELSE 0D END)" for n in names}
    rest = " + ".join(left.values())
    effective = [
        f"CASE WHEN {rest} <= 0 THEN {1.0 if n == 'layout' else 0.0}D ELSE {rnd_sql(f'{left[n]} / ({rest})', 4)} END AS use_{n}"
        for n in names
    ]
    return step.selectExpr("*", *effective)


def decide(candidates: DataFrame) -> DataFrame:
    """Final score, pass flag and the path that led to it."""
    settled = resolve_settings(candidates)
    scored = settled.selectExpr(
        "*",
        "CASE WHEN use_text_anchor + use_image_anchor > 0 THEN "
        + rnd_sql("(text_anchor_score * use_text_anchor + image_anchor_score * use_image_anchor)"
                  " / (use_text_anchor + use_image_anchor)", 4) + " ELSE 0D END AS anchor_score",
        rnd_sql("retrieval_score * use_layout + text_anchor_score * use_text_anchor"
                " + image_anchor_score * use_image_anchor", 4) + " AS final_score",
    )
    return scored.selectExpr(
        "*",
        f"final_score >= threshold AND required_passed AND retrieval_score >= {MIN_LAYOUT_SCORE} AS final_passed",
        f"""CASE WHEN NOT required_passed THEN 'required_verification_failed'
                 WHEN retrieval_score < {MIN_LAYOUT_SCORE} THEN 'layout_score_below_threshold'
                 WHEN final_score < threshold THEN 'final_threshold_failed' ELSE 'final_threshold_passed' END AS decision_path""",
    )


def layout_gate(decided: DataFrame) -> DataFrame:
    """Page candidates also need the template's own layout threshold."""
    return decided.withColumn(
        "final_passed",
        F.expr(f"final_passed AND retrieval_score >= coalesce(nullif(similarity_threshold, 0D), {DEFAULT_THRESHOLD}D)"),
    )


def evaluation_status(candidates: DataFrame, group: str, include_template: int | None = None) -> DataFrame:
    """Which candidates get a full evaluation: until the first pass, within the limit, plus the included one."""
    order = W.partitionBy(group).orderBy(F.desc("retrieval_score"), "page_candidate_id")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    ranked = candidates.withColumn("retrieval_rank", F.row_number().over(order))
    confident = F.col("retrieval_score") >= MIN_LAYOUT_SCORE
    accepted = F.coalesce(F.max((confident & F.col("final_passed")).cast("int")).over(earlier), F.lit(0)) > 0
    full = confident & ~accepted & (F.col("retrieval_rank") <= FULL_EVALUATIONS)
    if include_template is not None:
        full = full | (confident & (F.col("template_id") == F.lit(include_template)))
    status = F.when(~confident, "layout_rejected").when(full, "full").otherwise("lightweight")
    return ranked.withColumn("evaluation_status", status)


def rank_candidates(candidates: DataFrame, group: str) -> DataFrame:
    """Passing first, fully evaluated next, then by final and retrieval score."""
    order = W.partitionBy(group).orderBy(
        F.desc("final_passed"), F.desc(F.col("evaluation_status") == "full"), F.desc("final_score"),
        F.desc("retrieval_score"), "page_candidate_id",
    )
    return candidates.withColumn("rank", F.row_number().over(order))


def document_candidates(pages: DataFrame) -> DataFrame:
    """Page candidates per document and template: best page decides, without the page-level layout gate."""
    best = F.max_by(
        F.struct("page_candidate_id", "text_anchor_score", "image_anchor_score", "has_text_anchor", "has_image_anchor",
                 "required_passed", "final_confidence_threshold", "layout_weight", "text_anchor_weight",
                 "image_anchor_weight"),
        F.struct("retrieval_score", -F.col("page_candidate_id")),
    )
    grouped = pages.groupBy("doc_id", "template_id").agg(
        F.max("retrieval_score").alias("retrieval_score"),
        F.sum(units(F.col("retrieval_score"), 4)).alias("total"),
        F.count("*").alias("page_count"),
        F.count_if("final_passed").alias("matched_pages"),
        best.alias("best"),
    )
    flat = grouped.select(
        "doc_id", "template_id", "retrieval_score", "page_count", "matched_pages", "best.*",
        F.expr(rnd_sql("total / 10000D / page_count", 6)).alias("average_score"),
    )
    return decide(flat)


def draft_report(candidates: DataFrame, draft: Column) -> DataFrame:
    """Per document: rank of the draft template, the chosen template, pass and warning flags."""
    order = W.partitionBy("doc_id").orderBy(F.desc("final_score"), F.desc("retrieval_score"), "template_id")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).withColumn("is_draft", F.col("template_id") == draft)
    chosen = F.max_by(
        F.struct("template_id", "final_score", "final_passed"), F.struct("final_passed", "final_score", "retrieval_score", -F.col("rank"))
    )
    summary = ranked.groupBy("doc_id").agg(
        F.max(F.when(F.col("is_draft"), F.col("rank"))).alias("draft_rank"),
        F.max(F.when(F.col("is_draft"), F.col("template_id"))).alias("draft_id"),
        chosen.alias("chosen"),
    )
    own = F.coalesce(F.col("chosen.template_id") == F.col("draft_id"), F.lit(False))
    return summary.select(
        "doc_id", "draft_rank", F.col("chosen.template_id").alias("selected_template"),
        F.col("chosen.final_score").alias("final_confidence"),
        F.when(own, "draft").otherwise("published").alias("selected_type"),
        (F.col("chosen.final_passed") & own & F.coalesce(F.col("draft_rank") == 1, F.lit(False))).alias("passed"),
        (~own).alias("warning"),
    )


def category_evidence(logits: DataFrame) -> DataFrame:
    """Rank, margin and shares of the target category. Logits sit in one array per image: no shuffle.

    Needs logits ARRAY<DOUBLE> and target (position). A target outside the logits, or null, is an error with evidence 0 and no rank.
    """
    step = logits.selectExpr(
        "*", "array_max(logits) AS top", "size(logits) AS n", "get(logits, target) AS raw",
    ).selectExpr(
        "*",
        "cast(array_position(logits, top) - 1 AS int) AS predicted",
        "aggregate(logits, 0D, (s, v) -> s + exp(v - top)) AS total",
        "CASE WHEN raw IS NOT NULL THEN aggregate(transform(logits, (v, i) -> CASE WHEN v > raw OR (v = raw AND i < target) THEN 1 ELSE 0 END),"
        " 1, (s, v) -> s + v) END AS target_rank",
        "coalesce(get(sort_array(logits, false), 1), top) AS second",
    ).selectExpr(
        "*", "transform(logits, v -> " + rnd_sql("exp(v - top) / total * 100D", 1) + ") AS shares",
    ).selectExpr("*", rnd_sql("100D - aggregate(shares, 0D, (s, v) -> s + v)", 1) + " AS residue",
                 "cast(array_position(shares, array_max(shares)) - 1 AS int) AS largest")
    return step.selectExpr(
        "image_id", "target", "predicted", "target_rank", "coalesce(target_rank = 1, false) AS passed",
        "CASE WHEN target_rank = 1 THEN 1D ELSE 0D END AS evidence_score",
        "CASE WHEN raw IS NULL THEN 'error' WHEN target_rank = 1 THEN 'matched' ELSE 'mismatched' END AS status",
        "CASE WHEN coalesce(n, 0) <= 0 THEN 'no_active_categories' WHEN raw IS NULL THEN 'category_not_found' END AS error",
        rnd_sql("CASE WHEN target_rank = 1 THEN top - second ELSE raw - top END", 4) + " AS score_margin",
        rnd_sql("raw", 4) + " AS raw_logit",
        rnd_sql("1D / (1D + exp(-raw))", 4) + " AS raw_pair_score",
        rnd_sql("exp(raw - top) / nullif(total, 0D) * 100D", 2) + " AS relative_percentage",
        rnd_sql("element_at(shares, largest + 1) + residue", 1) + " AS top_percentage",
    )


def choose_category(logits: DataFrame) -> DataFrame:
    """Anchors that accept several categories: the first that ranks first, else the first listed.

    Needs image_category (one value or a JSON list of positions) next to the logits.
    """
    raw = "trim(coalesce(image_category, ''))"
    parsed = f"CASE WHEN {raw} LIKE '[%' THEN from_json({raw}, 'array<string>') WHEN {raw} = '' THEN array() ELSE array({raw}) END"
    listed = logits.selectExpr(
        "image_id", "logits", f"filter(transform({parsed}, c -> trim(c)), c -> c <> '') AS choices",
        "cast(array_position(logits, array_max(logits)) - 1 AS string) AS first_place",
    )
    return listed.selectExpr(
        "image_id", "size(choices) AS choice_count",
        "CASE WHEN array_contains(choices, first_place) THEN first_place ELSE get(choices, 0) END AS chosen",
        "array_contains(choices, first_place) AS passed",
    )


# Quality by mean reprojection error in pixels.
ERROR_QUALITY = ((1, 1.0), (2, 0.90), (3, 0.80), (5, 0.65), (8, 0.45))
ASPECT_TOLERANCE = 0.04


def _orientation(side: str) -> str:
    wide, high = f"{side}_width", f"{side}_height"
    return (
        f"CASE WHEN abs({wide} - {high}) / greatest({wide}, {high}, 1) <= 0.02 THEN 'square'"
        f" WHEN {wide} > {high} THEN 'landscape' ELSE 'portrait' END"
    )


def alignment_precheck(pairs: DataFrame) -> DataFrame:
    """Whether a page needs alignment with its template, and the score of an alignment already made."""
    steps = " ".join(f"WHEN reprojection_error <= {e} THEN {q}D" for e, q in ERROR_QUALITY)
    sized = pairs.selectExpr(
        "*", "query_width / greatest(1, query_height) AS qa", "template_width / greatest(1, template_height) AS ta",
        f"CASE WHEN reprojection_error IS NULL OR isnan(reprojection_error) THEN 0D {steps} ELSE 0.20D END AS quality",
    ).selectExpr(
        "*", "abs(qa - ta) / greatest(qa, ta, 1e-6D) AS delta",
        f"{_orientation('query')} = {_orientation('template')} AS same_orientation",
    )
    return sized.selectExpr(
        "*", f"NOT (same_orientation AND delta <= {ASPECT_TOLERANCE}) OR fallback_used AS should_align",
        f"""CASE WHEN fallback_used THEN 'normalization_fallback_alignment_may_help'
             WHEN same_orientation AND delta <= {ASPECT_TOLERANCE} THEN 'normalized_geometry_matches_template'
             ELSE 'geometry_mismatch_alignment_may_help' END AS reason""",
        rnd_sql("delta", 4) + " AS aspect_delta",
        rnd_sql(clamp_sql("0.7D * quality + 0.3D * " + clamp_sql("inlier_ratio")), 4) + " AS alignment_score",
    )


def better_verification(scores: DataFrame) -> DataFrame:
    """The aligned result replaces the normalised one unless it is lower."""
    return scores.selectExpr(
        "*", "coalesce(aligned_score >= normalized_score, false) AS use_aligned",
    ).selectExpr(
        "*", "CASE WHEN use_aligned THEN 'aligned' ELSE 'normalized' END AS source_used",
        "CASE WHEN use_aligned THEN aligned_score ELSE normalized_score END AS used_score",
        rnd_sql("aligned_score - normalized_score", 4) + " AS improvement",
    )
