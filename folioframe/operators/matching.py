"""Greedy one-to-one matching of regions as array folds.

Both arrays are bounded by construction, and the fold runs in the JVM next to the row it belongs to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.geometry import RATIO, Box
from folioframe.functions.numeric import clamp, let, rnd_sql
from folioframe.functions.similarity import box_similarity
from folioframe.operators.joins import bounded_broadcast
from folioframe.operators.ordering import row_places
from folioframe.operators.spatial import RATIO_TILE


def greedy_total(queries: Column, templates: Column, score: Callable[[Column, Column], Column]) -> Column:
    """Sum of scores when each query region takes the best template region still free."""

    def step(state: Column, query: Column) -> Column:
        # Keys compare by score, then by the earlier place.
        scored = F.transform(state["free"], lambda t: F.struct(score(query, t).alias("s"), (-t["place"]).alias("p")))
        return let(
            F.array_max(scored),
            lambda best: F.when(best.isNull(), state).otherwise(
                F.struct(
                    (state["total"] + best["s"]).alias("total"),
                    F.filter(state["free"], lambda t: t["place"] != -best["p"]).alias("free"),
                )
            ),
        )

    start = F.struct(F.lit(0.0).alias("total"), templates.alias("free"))
    return F.aggregate(queries, start, step, lambda state: state["total"])


def spatial_similarity(queries: Column, templates: Column, n_queries: Column, n_templates: Column) -> Column:
    """Matched score of one label over the longer list; two empty lists agree."""

    def score(q: Column, t: Column) -> Column:
        return box_similarity(Box.field(q, RATIO), Box.field(t, RATIO))

    total = greedy_total(queries, templates, score)
    return (
        F.when((n_queries == 0) & (n_templates == 0), F.lit(1.0))
        .when((n_queries == 0) | (n_templates == 0), F.lit(0.0))
        .otherwise(clamp(total / F.greatest(n_queries, n_templates)))
    )


# A match counts from this score on, and an alignment needs this many of them.
USABLE_MATCH = 0.55
NEEDED_MATCHES = 3


def match_regions(pairs: DataFrame, query_regions: DataFrame, template_regions: DataFrame) -> DataFrame:
    """Greedy region matches of page pairs with a reading-order term.

    Each query region takes the best free template region of its label, so once the template regions of a
    label are used up later query regions get nothing: only as many query regions as the template has can
    match, and both arrays are bounded by the template page. Regions need centre_x, centre_y, area_ratio
    and reading_order.
    """
    fields = [*RATIO, "centre_x", "centre_y", "area_ratio", "reading_order"]
    order = ["centre_y", "centre_x", "region_id"]
    placed = row_places(template_regions, ["page_id", "label"], order, RATIO_TILE)
    catalog = placed.groupBy(F.col("page_id").alias("template_page_id"), "label").agg(
        F.array_sort(F.collect_list(F.struct("place", "region_id", *fields))).alias("t")
    )
    queries = row_places(query_regions, ["page_id", "label"], order, RATIO_TILE, "q_place")
    near = queries.join(pairs, "page_id").join(bounded_broadcast(catalog), ["template_page_id", "label"]).filter("q_place <= size(t)")
    packed = near.groupBy("page_id", "template_page_id", "label").agg(
        F.array_sort(F.collect_list(F.struct("q_place", "region_id", *fields))).alias("q"), F.first("t").alias("t")
    )

    def ratio(a: str, b: str) -> str:
        return f"(CASE WHEN {a} <= 0 AND {b} <= 0 THEN 1D WHEN {a} <= 0 OR {b} <= 0 THEN 0D ELSE least({a}, {b}) / greatest({a}, {b}) END)"

    dx, dy = "(e.centre_x - f.centre_x)", "(e.centre_y - f.centre_y)"
    score = (
        f"greatest(0D, least(1D, 1D - sqrt({dx} * {dx} + {dy} * {dy}) / 0.75D)) * 0.35D"
        f" + ({ratio('e.width_ratio', 'f.width_ratio')} + {ratio('e.height_ratio', 'f.height_ratio')}) / 2 * 0.30D"
        f" + {ratio('e.area_ratio', 'f.area_ratio')} * 0.20D + greatest(0D, least(1D, 1D - abs(e.reading_order - f.reading_order))) * 0.15D"
    )
    fold = f"""aggregate(q, named_struct('free', t, 'out', cast(array() AS array<struct<q:int,t:int,score:double>>)), (a, e) ->
        element_at(transform(array(array_max(transform(a.free, f -> named_struct('s', {score}, 'p', -f.place, 'id', f.region_id)))), best ->
          CASE WHEN best IS NULL THEN a ELSE named_struct('free', filter(a.free, f -> f.place <> -best.p),
            'out', concat(a.out, array(named_struct('q', e.region_id, 't', best.id, 'score', best.s)))) END), 1), a -> a.out)"""
    return packed.selectExpr("page_id", "template_page_id", "label", f"inline({fold})").selectExpr(
        "page_id", "template_page_id", "label", "q AS region_id", "t AS template_region_id", rnd_sql("score", 4) + " AS score"
    )


def alignment_support(matches: DataFrame) -> DataFrame:
    """Usable matches per pair and whether they suffice."""
    return matches.groupBy("page_id", "template_page_id").agg(
        F.count("*").alias("matches"), F.count_if(F.col("score") >= USABLE_MATCH).alias("usable"), F.max("score").alias("best_score")
    ).withColumn("enough", F.col("usable") >= NEEDED_MATCHES)
