"""Clean-up of detected regions: what belongs to a table, what is noise, how boxes grow, how lines join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.geometry import (
    MAX_NEIGHBOUR_OVERLAP,
    PIXEL,
    RATIO,
    TABLE_EDGE_PADDING_PX,
    TEXT_PADDING_PX,
    Box,
    centre_inside,
    intersection,
)
from folioframe.operators.ordering import previous_values, row_places, running_total
from folioframe.operators.spatial import PIXEL_TILE, RATIO_TILE, pair_overlaps, touching_ids
from folioframe.operators.suppress import FLEXIBLE_BLOCK, FLEXIBLE_TEXT, LAYOUT_NESTED, greedy_keep
from folioframe.session import cut_lineage

PAGE_ITEM = ["page_id", "item_id"]

# Shares at which a text box belongs to a table, and an image box only frames text.
TEXT_IN_TABLE = 0.25
TEXT_IN_IMAGE = 0.35
LINE_IN_REGION = 0.55


def region_type(label: Column) -> Column:
    """Detector label to text, table or image."""
    name = F.lower(F.coalesce(label, F.lit("text")))
    table = name.contains("table") & ~name.contains("title") & ~name.contains("caption")
    image = name.rlike("image|figure|pic|seal|logo|chart")
    return F.when(table, "table").when(image, "image").otherwise("text")


def supported_type(label: Column) -> Column:
    """False for page furniture."""
    return ~F.translate(F.lower(label), "_-", "  ").rlike("header|footer|page number")


def text_outside_tables(items: DataFrame) -> DataFrame:
    """Drop text boxes that lie in a table box by centre or by a quarter of their area."""
    def belongs(text: Box, table: Box) -> Column:
        share = intersection(text, table) / F.greatest(text.area, F.lit(1.0))
        return centre_inside(text, table) | (share >= TEXT_IN_TABLE)

    hit = touching_ids(
        items.filter("label = 'text'"), items.filter("label = 'table'"), ["page_id"], PAGE_ITEM, PIXEL, PIXEL_TILE,
        belongs,
    )
    return items.join(hit, PAGE_ITEM, "left_anti")


def images_without_text(items: DataFrame) -> DataFrame:
    """Drop image boxes that hold the centre or 35 % of a text box."""
    def holds(image: Box, text: Box) -> Column:
        share = intersection(text, image) / F.greatest(text.area, F.lit(1.0))
        return centre_inside(text, image) | (share >= TEXT_IN_IMAGE)

    hit = touching_ids(
        items.filter("label = 'image'"), items.filter("label = 'text'"), ["page_id"], PAGE_ITEM, PIXEL, PIXEL_TILE,
        holds,
    )
    return items.join(hit, PAGE_ITEM, "left_anti")


def drop_tiny_text(items: DataFrame) -> DataFrame:
    """Drop text fragments far below the page's median height and area; needs two text boxes."""
    medians = (
        items.filter("label = 'text'")
        .groupBy("page_id")
        .agg(
            F.count("*").alias("n_text"),
            F.expr("median(CASE WHEN height > 0 THEN height END)").alias("mid_height"),
            F.expr("median(CASE WHEN width * height > 0 THEN width * height END)").alias("mid_area"),
        )
        .filter("n_text >= 2 AND mid_height > 0 AND mid_area > 0")
        .drop("n_text")
    )
    tiny = F.expr(
        "label = 'text' AND mid_height IS NOT NULL AND height <= mid_height * 0.42D"
        " AND width * height <= mid_area * 0.28D AND width <= mid_height * 2.5D"
    )
    return items.join(medians, "page_id", "left").filter(~tiny).drop("mid_height", "mid_area")


def drop_nested(items: DataFrame) -> DataFrame:
    return greedy_keep(items, ["page_id", "label"], "item_id", PIXEL, PIXEL_TILE, LAYOUT_NESTED)


def drop_flexible_nested(areas: DataFrame, row_id: str = "region_id") -> DataFrame:
    """Regions of flexible fields in page shares that lie in no larger one of their kind; tables and images fall by the overlap of either side, empty ones always."""
    real = areas.filter("width_ratio * height_ratio > 0")
    block = F.col("label").isin("table", "image")
    texts = greedy_keep(real.filter(~block), ["page_id", "label"], row_id, RATIO, RATIO_TILE, FLEXIBLE_TEXT)
    return texts.unionByName(greedy_keep(real.filter(block), ["page_id", "label"], row_id, RATIO, RATIO_TILE, FLEXIBLE_BLOCK))


def expand_items(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Padded boxes: tables by 2 px, text by 8 px but pulled back from neighbours, images unchanged."""
    sizes = pages.select("page_id", "image_width", "image_height")
    pad = F.when(F.col("label") == "text", F.lit(TEXT_PADDING_PX)).when(
        F.col("label") == "table", F.lit(TABLE_EDGE_PADDING_PX)
    ).otherwise(F.lit(0.0))
    padded = items.join(sizes, "page_id").select(
        *items.columns,
        F.greatest(F.lit(0.0), F.col("x") - pad).alias("l"),
        F.greatest(F.lit(0.0), F.col("y") - pad).alias("t"),
        F.least(F.col("image_width").cast("double"), F.col("x") + F.col("width") + pad).alias("r"),
        F.least(F.col("image_height").cast("double"), F.col("y") + F.col("height") + pad).alias("b"),
    )
    # Only boxes that share area with the padded one can pull it back.
    grown = padded.filter("label = 'text'").selectExpr(
        "page_id", "item_id", "l AS x", "t AS y", "r - l AS width", "b - t AS height"
    )
    neighbours = items.selectExpr("page_id", "item_id", "x", "y", "width", "height")
    near = pair_overlaps(
        grown, neighbours, ["page_id"], PIXEL, PIXEL_TILE,
        lambda g, n: (g["item_id"] != n["item_id"])
        & (intersection(Box.field(g, PIXEL), Box.field(n, PIXEL)) > 0)
        & (n["width"] * n["height"] > 0),
    )
    around = near.groupBy("page_id", F.col("l.item_id").alias("item_id")).agg(
        F.array_sort(
            F.collect_list(
                F.expr("named_struct('id', r.item_id, 'l', r.x, 't', r.y, 'r', r.x + r.width, 'b', r.y + r.height)")
            )
        ).alias("around")
    )
    share = (
        "greatest(0D, least({s}.r, n.r) - greatest({s}.l, n.l)) * greatest(0D, least({s}.b, n.b) - greatest({s}.t, n.t))"
        " / greatest(1D, least(({s}.r - {s}.l) * ({s}.b - {s}.t), (n.r - n.l) * (n.b - n.t)))"
    )
    limit = f"{MAX_NEIGHBOUR_OVERLAP}D"
    step = f"""
      CASE WHEN s.done OR {share.format(s='s')} <= {limit} THEN s
      ELSE element_at(transform(array(named_struct(
          'l', CASE WHEN x + width > n.l AND x >= n.r THEN greatest(s.l, n.r) ELSE s.l END,
          't', CASE WHEN y + height > n.t AND y >= n.b THEN greatest(s.t, n.b) ELSE s.t END,
          'r', CASE WHEN x + width <= n.l THEN least(s.r, n.l) ELSE s.r END,
          'b', CASE WHEN y + height <= n.t THEN least(s.b, n.t) ELSE s.b END, 'done', false)),
        c -> CASE WHEN c.r <= c.l OR c.b <= c.t OR {share.format(s='c')} > {limit}
             THEN named_struct('l', x, 't', y, 'r', x + width, 'b', y + height, 'done', true) ELSE c END), 1) END"""
    fold = f"""aggregate(coalesce(around, array()), named_struct('l', l, 't', t, 'r', r, 'b', b, 'done', false),
                         (s, n) -> {step})"""
    joined = padded.join(around, PAGE_ITEM, "left").withColumn("final", F.expr(fold))
    return joined.select(
        *items.columns, *[F.col(f"final.{side}").alias(name) for side, name in
                          (("l", "left"), ("t", "top"), ("r", "right"), ("b", "bottom"))]
    )


def reading_order(regions: DataFrame) -> DataFrame:
    """Place in reading order scaled to 0..1."""
    placed = row_places(regions, ["page_id"], ["centre_y", "centre_x", "region_id"], RATIO_TILE)
    totals = regions.groupBy("page_id").agg(F.count("*").alias("n"))
    scaled = (F.col("place") - 1) / F.greatest(F.lit(1), F.col("n") - 1)
    return placed.join(totals, "page_id").withColumn("reading_order", scaled).drop("n", "place")


def scope_lines(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines outside blockers next to the text region they belong to; scope null collects the rest.

    A line may fall into several regions and is then read in each of them.
    """
    def inside(line: Column, region: Column) -> Column:
        a, b = Box.field(line, RATIO), Box.field(region, RATIO)
        return intersection(a, b) / F.greatest(a.area, F.lit(1e-9)) >= LINE_IN_REGION

    def blocked(a: Box, b: Box) -> Column:
        return intersection(a, b) / F.greatest(a.area, F.lit(1e-9)) >= LINE_IN_REGION

    key = ["page_id", "line_id"]
    hidden = touching_ids(
        lines, regions.filter("label <> 'text'"), ["page_id"], key, RATIO, RATIO_TILE, blocked
    )
    free = lines.join(hidden, key, "left_anti")
    texts = regions.filter("label = 'text'").select("page_id", "region_id", *RATIO)
    scoped = pair_overlaps(free, texts, ["page_id"], RATIO, RATIO_TILE, inside).select(
        "page_id", *[F.col(f"l.{c}").alias(c) for c in lines.columns if c != "page_id"],
        F.col("r.region_id").alias("scope"),
    )
    rest = free.join(scoped.select(*key), key, "left_anti").withColumn("scope", F.lit(None).cast("int"))
    return scoped.unionByName(rest)


# Evidence thresholds and weights of a paragraph break between two lines.
BREAK = {
    "gap_evidence": "gap_ratio >= 1.85D AND gap >= mid_height * 0.85D",
    "indent_evidence": "indent_ratio >= 0.12D",
    "first_line_evidence": "first_ratio >= 0.16D AND x_ratio > prev_x_ratio",
    "short_evidence": "prev_width_ratio / greatest(mid_width, 1e-9D) <= 0.62D AND gap_ratio >= 1.25D",
    "shift_evidence": "overlap <= 0.28D AND gap_ratio >= 1.35D",
}
BREAK_WEIGHTS = {"gap_evidence": 45, "indent_evidence": 35, "first_line_evidence": 45, "short_evidence": 20,
                 "shift_evidence": 10}


def paragraph_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Every line with the number of its paragraph inside the group."""
    real = lines.filter("width_ratio > 0 AND height_ratio > 0").withColumn(
        "centre_y", F.expr("y_ratio + height_ratio / 2D")
    )
    order = ["centre_y", "x_ratio", "line_id"]
    near = previous_values(real, keys, order, RATIO_TILE, list(RATIO))
    near = cut_lineage(near.withColumn("raw_gap", F.expr("y_ratio - (prev_y_ratio + prev_height_ratio)")))
    mids = near.groupBy(*keys).agg(
        F.expr("median(height_ratio)").alias("mid_height"),
        F.expr("median(width_ratio)").alias("mid_width"),
        F.expr("median(x_ratio)").alias("left_edge"),
        F.expr("median(CASE WHEN raw_gap IS NOT NULL THEN greatest(0D, raw_gap) END)").alias("mid_gap"),
    ).withColumn("mid_gap", F.coalesce("mid_gap", F.expr("mid_height * 0.35D")))
    equal = None
    for key in keys:
        part = F.col(f"a.{key}").eqNullSafe(F.col(f"m.{key}"))
        equal = part if equal is None else equal & part
    joined = near.alias("a").join(mids.alias("m"), equal).select("a.*", "mid_height", "mid_width", "left_edge", "mid_gap")
    measured = joined.selectExpr(
        "*",
        "raw_gap AS gap",
        "raw_gap / greatest(mid_gap, mid_height * 0.25D, 1e-9D) AS gap_ratio",
        "abs(x_ratio - prev_x_ratio) / greatest(mid_width, mid_height, 1e-9D) AS indent_ratio",
        "(x_ratio - left_edge) / greatest(mid_width, mid_height, 1e-9D) AS first_ratio",
        "greatest(0D, least(prev_x_ratio + prev_width_ratio, x_ratio + width_ratio) - greatest(prev_x_ratio, x_ratio))"
        " / greatest(1e-9D, least(prev_width_ratio, width_ratio)) AS overlap",
    ).selectExpr("*", *[f"{test} AS {name}" for name, test in BREAK.items()])

    def total(names, weight=lambda name: 1) -> str:
        return " + ".join(f"CASE WHEN {name} THEN {weight(name)} ELSE 0 END" for name in names)

    primary = list(BREAK)[:3]
    breaks = f"""CASE WHEN prev_x_ratio IS NOT NULL AND {total(BREAK)} >= 2 AND {total(primary)} >= 1
        AND {total(BREAK, BREAK_WEIGHTS.get)} >= 85
        AND (gap_evidence OR (first_line_evidence AND gap_ratio >= 1.35D))
        AND NOT (overlap >= 0.68D AND indent_ratio < 0.12D AND gap_ratio < 1.85D) THEN 1 ELSE 0 END"""
    flagged = cut_lineage(measured.withColumn("starts", F.expr(breaks)).select(*real.columns, "starts"))
    numbered = running_total(flagged, keys, order, RATIO_TILE, "starts", "before")
    return numbered.withColumn("paragraph", (F.col("before") + 1).cast("int")).drop("starts", "before", "centre_y")


def paragraph_boxes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One box per paragraph before padding."""
    return lines.groupBy(*keys, "paragraph").agg(
        F.count("*").alias("line_count"),
        F.greatest(F.lit(0.0), F.min("x_ratio")).alias("x_ratio"),
        F.greatest(F.lit(0.0), F.min("y_ratio")).alias("y_ratio"),
        F.expr("least(1D, max(x_ratio + width_ratio)) - greatest(0D, min(x_ratio))").alias("width_ratio"),
        F.expr("least(1D, max(y_ratio + height_ratio)) - greatest(0D, min(y_ratio))").alias("height_ratio"),
    )
