"""Ranking of template pages for every query page of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions.numeric import clamp, rnd
from folioframe.functions.similarity import count_similarity, grid_similarity, ratio_similarity
from folioframe.operators.joins import CATALOG_ROWS, salted_join
from folioframe.operators.matching import spatial_similarity
from folioframe.operators.ranking import rank_batches
from folioframe.operators.signature import LABELS, without_masked

# Weights of the five parts, and how many templates a page keeps.
WEIGHTS = {"aspect": 0.15, "label_count": 0.20, "area_distribution": 0.20, "grid": 0.20, "spatial": 0.25}
TOP_K = 5
SCORES = [f"{part}_score" for part in WEIGHTS]


def eligible_templates(templates: DataFrame, include_template: int | None = None, active_only: bool = True) -> DataFrame:
    """Templates that may be retrieved: active ones, plus the one named explicitly."""
    if not active_only:
        return templates
    allowed = F.col("status") == "active"
    if include_template is not None:
        allowed = allowed | (F.col("template_id") == F.lit(include_template))
    return templates.filter(allowed)


def route_pairs(queries: DataFrame, templates: DataFrame) -> DataFrame:
    """Query pages next to the template pages they are compared with.

    Main-page templates meet every query page through their main page, all others the page of the same
    number. Route 0 stands for the former, so that both cases are one equi join.
    """
    mode = F.coalesce(F.col("detection_mode"), F.lit("all_pages"))
    main = F.coalesce(F.col("main_page_number"), F.lit(1))
    route = F.when(mode != "main_page", F.col("page_number")).when(F.col("page_number") == main, F.lit(0))
    catalog = templates.withColumn("route", route).filter("route IS NOT NULL")
    catalog = catalog.select(
        "route", *[F.col(c).alias(c if c.startswith("template") else f"t_{c}") for c in templates.columns]
    )
    asked = queries.withColumn("route", F.explode(F.array(F.lit(0), F.col("page_number"))))
    return salted_join(asked, catalog, ["route"], F.col("page_id")).drop("route")


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Five part scores and their weighted sum for pairs of signatures (template side prefixed t_).

    A column `template_masks` hides regions of both sides first.
    """
    if "template_masks" in pairs.columns:
        pairs = apply_masks(pairs).drop("template_masks")

    def mean(parts: list[Column]) -> Column:
        return (parts[0] + parts[1] + parts[2]) / 3

    def both(name: str, label: str) -> tuple[Column, Column]:
        return F.col(f"{name}_{label}"), F.col(f"t_{name}_{label}")

    aspect = ratio_similarity(F.col("page_aspect_ratio"), F.col("t_page_aspect_ratio"))
    counts = mean([count_similarity(*both("count", label)) for label in LABELS])
    areas = mean([ratio_similarity(*both("area", label)) for label in LABELS])
    grids = mean([grid_similarity(*both("grid_units", label), *both("norm", label)) for label in LABELS])
    spatial = mean(
        [spatial_similarity(*both("regions", label), *both("count", label)) for label in LABELS]
    )
    parts = dict(zip(WEIGHTS, (aspect, counts, areas, grids, spatial)))
    raw = pairs.select(
        *[c for c in ("page_id", "page_number", "doc_id") if c in pairs.columns],
        *[c for c in pairs.columns if c.startswith("template")],
        F.col("t_page_number").alias("template_page_number"),
        *[value.alias(f"{part}_score") for part, value in parts.items()],
    )
    total = sum((F.col(f"{part}_score") * weight for part, weight in list(WEIGHTS.items())[1:]),
                F.col("aspect_score") * WEIGHTS["aspect"])
    kept = [c for c in raw.columns if c not in SCORES]
    return raw.select(*kept, rnd(clamp(total), 4).alias("score"), *[rnd(F.col(c), 4).alias(c) for c in SCORES])


def apply_masks(pairs: DataFrame, masks: str = "template_masks") -> DataFrame:
    """Pairs of maskable signatures after the masks of the template were applied to both sides, all inside the row.

    masks: an array of (x_ratio, y_ratio, width_ratio, height_ratio), null or empty for most templates, whose pairs keep what is stored.
    """
    hidden = F.coalesce(F.col(masks), F.array().cast(pairs.schema[masks].dataType))
    sides = [(side, label) for side in ("", "t_") for label in LABELS]
    now: dict[str, Column] = {}
    for side, label in sides:
        now |= without_masked(side, label, hidden)
    wide = pairs.withColumns(now)
    parts = {f"{side}{part}_{label}": F.col(f"{side}_now_{label}.{part}") for side, label in sides for part in ("regions", "count", "area", "grid_units", "norm")}
    return wide.withColumns(parts).drop(*now)


def best_pages(scored: DataFrame) -> DataFrame:
    """The best page of each template for each query page; the earlier page wins a tie."""
    order = W.partitionBy("page_id", "template_id").orderBy(F.desc("score"), "template_page_number")
    return scored.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def top_templates(scored: DataFrame, k: int | None = TOP_K, include_template: int | None = None, newest: str | None = None) -> DataFrame:
    """Ranked templates per query page, all of them without a k; the included template is kept when it falls outside k.

    Equal scores go to the newest version where a column tells it, then to the smaller id.
    """
    age = [] if newest is None else [F.col(newest).desc_nulls_last()]
    order = W.partitionBy("page_id").orderBy(F.desc("score"), *age, "template_id")
    ranked = best_pages(scored).withColumn("rank", F.row_number().over(order))
    keep = F.col("rank") <= k if k is not None else F.lit(True)
    if include_template is not None:
        keep = keep | (F.col("template_id") == F.lit(include_template))
    return ranked.filter(keep)


def ranked_templates(
    queries: DataFrame, templates: DataFrame, k: int | None = TOP_K, include_template: int | None = None, newest: str | None = None
) -> DataFrame:
    """`top_templates` of all routed pairs. Pages meet a catalog counted to be small batch by batch and no pair becomes a row; a larger one is joined."""
    if templates.limit(CATALOG_ROWS + 1).count() <= CATALOG_ROWS:
        return rank_batches(queries, templates, list(WEIGHTS.values()), k, include_template, newest)
    return top_templates(score_pairs(route_pairs(queries, templates)), k, include_template, newest)


def scored_templates(queries: DataFrame, templates: DataFrame) -> DataFrame:
    """`score_pairs` of all routed pairs, in the same two ways."""
    if templates.limit(CATALOG_ROWS + 1).count() <= CATALOG_ROWS:
        return rank_batches(queries, templates, list(WEIGHTS.values()), ranked=False)
    return score_pairs(route_pairs(queries, templates))


def document_retrieval(ranked: DataFrame, limit: int = 10) -> DataFrame:
    """Templates per document: mean score over the pages on which they were retrieved."""
    grouped = ranked.groupBy("doc_id", "template_id").agg(
        F.count("*").alias("matched_pages"),
        F.sum(F.floor(F.col("score") * 10000 + 0.5).cast("bigint")).alias("total"),
        F.max("score").alias("best_score"),
    )
    mean = rnd(F.col("total") / F.lit(10000.0) / F.col("matched_pages"), 4)
    order = W.partitionBy("doc_id").orderBy(F.desc("score"), "template_id")
    return (
        grouped.select("doc_id", "template_id", "matched_pages", "best_score", mean.alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
    )
