"""Tables rebuilt from text boxes and cells.

Boxes carry (group_id, box_id, text, confidence, x, y, width, height); cells carry (table_id, row_no,
col_no, text, row_span, col_span, hidden). Boundaries travel as one short array per table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions.geometry import PIXEL, Box, intersection
from folioframe.functions.numeric import clamp_sql, rnd_sql, units
from folioframe.operators.clusters import (
    axis_clusters,
    cluster_centres,
    dominant_interval,
    nearest,
    sweep_centres,
)
from folioframe.operators.spatial import PIXEL_TILE, crowded_keys, pair_overlaps
from folioframe.session import cut_lineage

GROUP = ["group_id"]

# Shape limits and thresholds of table candidates.
MIN_ROWS = 2
MIN_COLUMNS = 2
FINAL_CONFIDENCE = 0.72
FILL_RATIO = 0.20
COLUMN_CONSISTENCY = 0.45
SPARSE_ROWS = 0.70
TIE = 0.03
LOW_READING = 0.65
PRIMARY = "slanext"


def box_medians(boxes: DataFrame) -> DataFrame:
    """Boxes with the medians of their group, by a window, so that they are dealt once and not joined again."""
    over = W.partitionBy(*GROUP)
    return boxes.withColumn("mid_height", F.median("height").over(over)).withColumn("mid_width", F.median("width").over(over))


def with_rows(boxes: DataFrame, factor: float = 0.75, floor: float = 8.0) -> DataFrame:
    """Boxes with the row they fall into: the first row whose mean centre is near enough."""
    sized = box_medians(boxes).withColumn("centre_y", F.expr("y + height / 2"))
    sized = sized.withColumn("row_tolerance", F.expr(f"greatest({floor}D, mid_height * {factor}D)"))
    rows = axis_clusters(sized, GROUP, "centre_y", "row_tolerance", "any")
    rows = rows.selectExpr("group_id", "v AS centre_y", "cluster - 1 AS row_no")
    return sized.join(rows, ["group_id", "centre_y"]).drop("row_tolerance")


def raw_geometry_table(boxes: DataFrame) -> DataFrame:
    """Rows by position, columns by order inside the row: by left edge, then by centre from top to bottom."""
    order = W.partitionBy("group_id", "row_no").orderBy("x", "centre_y", "box_id")
    return with_rows(boxes).withColumn("col_no", (F.row_number().over(order) - 1).cast("int"))


def borderless_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes with row and nearest column; groups with fewer than two columns drop out."""
    rows = with_rows(boxes).withColumn("centre_x", F.expr("x + width / 2"))
    rows = cut_lineage(rows.withColumn("col_tolerance", F.expr("greatest(14D, mid_width * 0.75D)")))
    centres = sweep_centres(rows, GROUP, "centre_x", "col_tolerance").filter(f"size(centres) >= {MIN_COLUMNS}")
    return rows.join(centres, GROUP).selectExpr(
        *[c for c in boxes.columns], "row_no", nearest("centre_x", "centres") + " AS col_no", "size(centres) AS col_count"
    )


def merge_boxes(boxes: DataFrame, keys: list[str], order: str = "y, x, box_id") -> DataFrame:
    """Boxes of one cell as one: texts in the given order, union box, mean confidence."""
    words = f"filter(transform(array_sort(collect_list(struct({order}, text))), w -> trim(w.text)), t -> t <> '')"
    return boxes.groupBy(*keys).agg(
        F.expr(f"array_join({words}, ' ')").alias("text"),
        (F.sum(units(F.col("confidence"), 4)) / F.lit(10000.0) / F.count("*")).alias("confidence"),
        F.count("*").alias("box_count"),
        F.min("x").alias("x"), F.min("y").alias("y"),
        F.expr("greatest(1D, max(x + width) - min(x))").alias("width"),
        F.expr("greatest(1D, max(y + height) - min(y))").alias("height"),
    )


def borderless_cells(boxes: DataFrame) -> DataFrame:
    """Cells of tables without lines; needs two columns and two rows with text."""
    placed = borderless_boxes(boxes)
    cells = merge_boxes(placed, ["group_id", "row_no", "col_no", "col_count"], "x, box_id")  # one line of words, left to right
    usable = cells.filter("text <> ''").groupBy("group_id").agg(F.countDistinct("row_no").alias("rows_used"))
    return cells.join(usable.filter(f"rows_used >= {MIN_ROWS}").select("group_id"), "group_id", "left_semi")


def text_boundaries(boxes: DataFrame, axis: str, limit: Column) -> DataFrame:
    """Boundaries half way between clusters of box centres, from 0 to the limit."""
    size = "width" if axis == "x" else "height"
    sized = boxes.withColumn("limit", limit).withColumn("centre", F.expr(f"{axis} + {size} / 2"))
    mids = sized.groupBy(*GROUP).agg(F.expr(f"greatest(6D, median({size}) * 0.8D)").alias("tol"), F.max("limit").alias("limit"))
    clusters = axis_clusters(sized.drop("limit").join(mids, GROUP), GROUP, "centre", "tol", "last")
    order = W.partitionBy(*GROUP).orderBy("cluster")
    edges = cluster_centres(clusters, GROUP).withColumn("edge", (F.col("centre") + F.lead("centre").over(order)) / 2)
    inner = edges.groupBy(*GROUP).agg(F.collect_list("edge").alias("inner"))
    return mids.join(inner, GROUP).selectExpr(
        "group_id", "`limit`",
        "array_sort(array_distinct(transform(concat(array(0D), inner, array(`limit`)), e ->"
        f" {rnd_sql('greatest(0D, least(`limit`, e))', 3)}))) AS bounds",
    )


def combined_boundaries(text: DataFrame, lines: DataFrame) -> DataFrame:
    """Drawn lines replace inferred boundaries when there are enough of them."""
    gap = "greatest(4D, `limit` * 0.012D)"
    joined = text.join(lines, GROUP, "left").withColumn(
        "inner", F.expr(f"filter(coalesce(lines, array()), p -> p >= {gap} AND p <= `limit` - {gap})")
    )
    drawn = (
        "array_sort(array_distinct(transform(concat(array(0D), inner, array(`limit`)), e -> " + rnd_sql("e", 3) + ")))"
    )
    return joined.withColumn("drawn", F.expr(drawn)).selectExpr(
        "group_id",
        "CASE WHEN size(drawn) >= 3 AND size(drawn) >= greatest(3, cast(floor(size(bounds) * 0.6D) AS int)) THEN drawn ELSE bounds END AS bounds",
        "size(drawn) >= 3 AND size(drawn) >= greatest(3, cast(floor(size(bounds) * 0.6D) AS int)) AS from_lines",
    )


def repeated_alignment(boxes: DataFrame, axis: str, limit: Column) -> DataFrame:
    """Mid-points between neighbouring clusters that both have two supporters; needs four boxes."""
    size = "width" if axis == "x" else "height"
    sized = boxes.withColumn("limit", limit).withColumn("centre", F.expr(f"{axis} + {size} / 2"))
    mids = sized.groupBy(*GROUP).agg(
        F.count("*").alias("n_boxes"), F.max("limit").alias("limit"),
        F.expr(f"greatest(6D, coalesce(median(CASE WHEN {size} > 0 THEN {size} END), greatest(8D, max(`limit`) * 0.02D)) * 0.75D)").alias("tol"),
    ).filter("n_boxes >= 4")
    points = sized.drop("limit").join(mids, GROUP)
    clusters = axis_clusters(points, GROUP, "centre", "tol", "last")
    centres = cluster_centres(clusters, GROUP)
    # Supporters within the tolerance of a centre: values of its own cluster or of a neighbour.
    packed = clusters.groupBy("group_id", "cluster").agg(F.collect_list(F.struct("v", "n")).alias("members"))
    order = W.partitionBy(*GROUP).orderBy("cluster")
    near = centres.join(packed, ["group_id", "cluster"]).join(mids.select("group_id", "tol", "limit"), GROUP)
    near = near.withColumn("around", F.concat(F.coalesce(F.lag("members").over(order), F.array().cast("array<struct<v:double,n:bigint>>")), "members",
                                               F.coalesce(F.lead("members").over(order), F.array().cast("array<struct<v:double,n:bigint>>"))))
    near = near.withColumn("support", F.expr("aggregate(filter(around, m -> abs(m.v - centre) <= tol), 0L, (s, m) -> s + m.n)"))
    near = near.withColumn("edge", (F.col("centre") + F.lead("centre").over(order)) / 2).withColumn(
        "next_support", F.lead("support").over(order)
    )
    return near.filter("support >= 2 AND next_support >= 2 AND edge BETWEEN tol AND `limit` - tol").select("group_id", "edge")


def logical_subrows(boxes: DataFrame, hard: DataFrame) -> DataFrame:
    """Row boundaries refined inside hard bands: boxes that neither align nor overlap start a sub-row."""
    mids = boxes.groupBy(*GROUP).agg(F.expr("median(height)").alias("mid"))
    bands = hard.join(mids, GROUP).selectExpr(
        "group_id", "mid", "bounds", "posexplode(slice(bounds, 1, size(bounds) - 1)) AS (band, top)"
    ).selectExpr("*", "get(bounds, band + 1) AS bottom")
    inside = boxes.join(bands, GROUP).filter("y + height / 2 BETWEEN top AND bottom")
    # One entry per distinct centre and height span; equal spans change neither mean order nor extent.
    spans = inside.groupBy("group_id", "band", "top", "bottom", "mid", F.expr("y + height / 2").alias("c"), F.col("y").alias("t"),
                           F.expr("y + height").alias("b")).agg(F.count("*").alias("n"))
    packed = spans.groupBy("group_id", "band", "top", "bottom", "mid").agg(
        F.array_sort(F.collect_list(F.struct("c", "t", "b", "n"))).alias("entries")
    )
    fold = """aggregate(entries, cast(array() AS array<struct<s:double,n:bigint,t:double,b:double>>), (a, e) ->
      element_at(transform(array(element_at(a, -1)), p ->
        CASE WHEN size(a) > 0 AND abs(e.c - p.s / p.n) <= greatest(6D, mid * 0.65D)
              AND greatest(0D, least(e.b, p.b) - greatest(e.t, p.t)) / greatest(1D, least(e.b - e.t, p.b - p.t)) >= 0.28
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('s', p.s + e.c * e.n, 'n', p.n + e.n, 't', least(p.t, e.t), 'b', greatest(p.b, e.b))))
        ELSE concat(a, array(named_struct('s', e.c * e.n, 'n', e.n, 't', e.t, 'b', e.b))) END), 1),
      a -> transform(a, g -> g.s / g.n))"""
    fold = fold.replace("array(element_at(a, -1))", "array(try_element_at(a, -1))")
    centres = packed.withColumn("centres", F.expr(fold))
    gap = "greatest(3D, mid * 0.45D)"
    inner = centres.selectExpr(
        "group_id",
        "filter(transform(sequence(0, size(centres) - 1), i -> (get(centres, i) + get(centres, i + 1)) / 2),"
        f" e -> e IS NOT NULL AND e - top >= {gap} AND bottom - e >= {gap}) AS edges",
    )
    every = inner.select("group_id", F.explode("edges").alias("edge")).unionByName(
        hard.select("group_id", F.explode("bounds").alias("edge"))
    )
    tol = mids.selectExpr("group_id", "greatest(2D, greatest(3D, mid * 0.45D) * 0.5D) AS tol")
    merged = cluster_centres(axis_clusters(every.join(tol, GROUP), GROUP, "edge", "tol", "last"), GROUP)
    return merged.groupBy(*GROUP).agg(
        F.expr("array_sort(collect_set(" + rnd_sql("greatest(0D, centre)", 3) + "))").alias("bounds")
    )


def logical_subcolumns(boxes: DataFrame, hard: DataFrame, rows: DataFrame) -> DataFrame:
    """Column boundaries refined inside hard bands by gaps that repeat over rows."""
    mids = boxes.groupBy(*GROUP).agg(F.expr("median(width)").alias("mid"))
    bands = hard.join(mids, GROUP).selectExpr(
        "group_id", "mid", "posexplode(slice(bounds, 1, size(bounds) - 1)) AS (band, `left`)", "bounds"
    ).selectExpr("group_id", "mid", "band", "`left`", "get(bounds, band + 1) AS `right`",
                 "greatest(1D, get(bounds, band + 1) - `left`) AS wide")
    row_bands = rows.selectExpr("group_id", "posexplode(slice(bounds, 1, size(bounds) - 1)) AS (row_no, top)", "bounds").selectExpr(
        "group_id", "row_no", "top", "get(bounds, row_no + 1) AS bottom"
    )
    inside = boxes.join(bands, GROUP).filter("x + width / 2 BETWEEN `left` AND `right`")
    placed = inside.join(row_bands, GROUP).filter("y + height / 2 BETWEEN top AND bottom").withColumn(
        "cx", F.expr("x + width / 2")
    )
    key = ["group_id", "band"]
    order = W.partitionBy(*key, "row_no").orderBy("cx", "box_id")
    gaps = placed.withColumn("next_x", F.lead("x").over(order)).filter(
        "next_x - (x + width) >= greatest(6D, mid * 0.45D, wide * 0.045D)"
    ).selectExpr(*key, "row_no", "(x + width + next_x) / 2 AS proposal", "mid", "wide", "`left`", "`right`",
                 "greatest(mid * 0.65D, wide * 0.035D) AS tol")
    proposals = cluster_centres(axis_clusters(gaps, key, "proposal", "tol", "last"), key).selectExpr(
        *key, "cluster", "centre AS edge"
    )
    # Distinct (row, value) pairs are all that support counting looks at.
    near = gaps.select(*key, "row_no", "proposal", "tol").distinct().join(proposals, key).filter("abs(proposal - edge) <= tol")
    support = near.groupBy(*key, "cluster").agg(F.collect_set("row_no").alias("rows"))
    centre_tol = placed.withColumn("tol", F.expr("greatest(mid * 0.55D, wide * 0.035D)"))
    centres = cluster_centres(axis_clusters(centre_tol, key, "cx", "tol", "last"), key)
    repeated = (
        centre_tol.select(*key, "row_no", "cx", "tol").distinct().join(centres, key).filter("abs(cx - centre) <= tol")
        .groupBy(*key, "cluster").agg(F.countDistinct("row_no").alias("n")).filter("n >= 2")
        .select(*key).distinct().withColumn("repeats", F.lit(True))
    )
    wide_boxes = placed.filter("width >= mid * 1.35D")
    spanning = (
        wide_boxes.join(proposals, key).filter(
            "x < edge - greatest(mid * 0.35D, wide * 0.02D) AND x + width > edge + greatest(mid * 0.35D, wide * 0.02D)"
        ).groupBy(*key, "cluster").agg(F.collect_set("row_no").alias("spans"))
    )
    limits = bands.selectExpr(*key, "`left`", "`right`", "greatest(6D, mid * 0.75D) AS min_gap")
    kept = (
        proposals.join(support, [*key, "cluster"]).join(spanning, [*key, "cluster"], "left").join(repeated, key, "left").join(limits, key)
        .filter("(size(rows) >= 2 OR coalesce(repeats, false) OR size(array_union(rows, coalesce(spans, array()))) >= 2)"
                " AND edge BETWEEN `left` + min_gap AND `right` - min_gap")
        .select("group_id", "edge")
    )
    every = kept.unionByName(hard.select("group_id", F.explode("bounds").alias("edge")))
    tol = mids.selectExpr("group_id", "greatest(2D, mid * 0.2D) AS tol")
    merged = cluster_centres(axis_clusters(every.join(tol, GROUP), GROUP, "edge", "tol", "last"), GROUP)
    return merged.groupBy(*GROUP).agg(
        F.expr("array_sort(collect_set(" + rnd_sql("greatest(0D, centre)", 3) + "))").alias("bounds")
    )


def assign_to_grid(boxes: DataFrame, grid: DataFrame) -> DataFrame:
    """Row and column of each box; hard columns limit the choice.

    grid: group_id, row_bounds, col_bounds, hard_bounds, x_tol, y_tol.
    """
    joined = boxes.join(grid, GROUP).withColumn(
        "row_no", F.expr(dominant_interval("y", "(y + height)", "row_bounds", "y_tol"))
    ).withColumn("hard_no", F.expr(dominant_interval("x", "(x + width)", "hard_bounds", "x_tol")))
    # Counting and placing both read the boxes with their intervals, which cost more than anything else here.
    joined = cut_lineage(joined)
    mid = "(get(col_bounds, i) + get(col_bounds, i + 1)) / 2"
    inside = (
        f"filter(sequence(0, size(col_bounds) - 2), i -> size(hard_bounds) < 2 OR {mid} BETWEEN"
        " get(hard_bounds, hard_no) - x_tol AND get(hard_bounds, hard_no + 1) + x_tol)"
    )
    joined = joined.withColumn("allowed", F.expr(inside)).withColumn(
        "allowed", F.expr("CASE WHEN size(allowed) = 0 THEN sequence(0, size(col_bounds) - 2) ELSE allowed END")
    )
    # Only the first row asks how many boxes it has.
    peers = joined.filter("row_no = 0").groupBy("group_id").agg(F.count("*").alias("peers"))
    crossed = (
        "filter(sequence(1, greatest(1, size(col_bounds) - 2)), i -> i <= size(col_bounds) - 2 AND x < get(col_bounds, i) - x_tol"
        " AND x + width > get(col_bounds, i) + x_tol AND (array_contains(allowed, i - 1) OR array_contains(allowed, i)))"
    )
    span, low, high = "greatest(1D, width)", "get(col_bounds, i)", "get(col_bounds, i + 1)"
    score = (
        f"greatest(0D, least(x + width, {high}) - greatest(x, {low})) / {span} * 0.72D + greatest(0D, 1D - abs((x + (x + width)) / 2"
        f" - ({low} + {high}) / 2) / greatest({span}, {high} - {low}, 1D)) * 0.28D"
        f" - CASE WHEN x < {low} - x_tol OR x + width > {high} + x_tol THEN 0.08D ELSE 0D END"
    )
    best = (
        f"element_at(transform(array(transform(allowed, i -> {score})), s -> get(allowed, cast(array_position(s, array_max(s)) AS int) - 1)), 1)"
    )
    return joined.join(peers, GROUP, "left").withColumn("crossed", F.expr(crossed)).selectExpr(
        *boxes.columns, "row_no",
        f"cast(CASE WHEN row_no = 0 AND peers <= 1 AND size(crossed) > 0 THEN greatest(0, array_min(crossed) - 1) ELSE {best} END AS int) AS col_no",
        "row_bounds", "col_bounds", "hard_bounds",
    )


def grid_diagnostics(placed: DataFrame) -> DataFrame:
    """How well placed boxes fit their grid: empty shares, overlaps per axis, hard column violations."""
    measured = placed.selectExpr(
        "group_id", "row_no", "col_no", "trim(coalesce(text, '')) <> '' AS has_text", "size(row_bounds) - 1 AS n_rows", "size(col_bounds) - 1 AS n_cols",
        "greatest(0D, least(y + height, get(row_bounds, row_no + 1)) - greatest(y, get(row_bounds, row_no))) / greatest(1D, height) AS row_fit",
        "greatest(0D, least(x + width, get(col_bounds, col_no + 1)) - greatest(x, get(col_bounds, col_no))) / greatest(1D, width) AS col_fit",
        "(get(col_bounds, col_no) + get(col_bounds, col_no + 1)) / 2 AS mid", "hard_bounds",
        dominant_interval("x", "(x + width)", "hard_bounds", "0D") + " AS hard_no",
    ).withColumn("violates", F.expr(
        "size(hard_bounds) >= 2 AND NOT (mid BETWEEN get(hard_bounds, hard_no) AND get(hard_bounds, hard_no + 1))"
    ))
    # Fits as whole millionths keep the means independent of task order.
    return measured.groupBy("group_id").agg(
        F.count("*").alias("boxes"), F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"),
        F.countDistinct(F.when(F.col("has_text"), F.col("row_no"))).alias("rows_used"), F.countDistinct(F.when(F.col("has_text"), F.col("col_no"))).alias("cols_used"),
        F.sum(units(F.col("row_fit"), 6)).alias("row_sum"), F.sum(units(F.col("col_fit"), 6)).alias("col_sum"),
        F.min("row_fit").alias("row_min"), F.min("col_fit").alias("col_min"), F.count_if("violates").alias("violations"),
    ).selectExpr(
        "group_id", "boxes", rnd_sql("(n_rows - rows_used) / n_rows", 4) + " AS empty_row_ratio",
        rnd_sql("(n_cols - cols_used) / n_cols", 4) + " AS empty_column_ratio",
        rnd_sql(clamp_sql("row_sum / 1000000D / boxes"), 4) + " AS average_row_overlap",
        rnd_sql(clamp_sql("col_sum / 1000000D / boxes"), 4) + " AS average_column_overlap",
        rnd_sql(clamp_sql("row_min"), 4) + " AS minimum_row_overlap",
        rnd_sql(clamp_sql("col_min"), 4) + " AS minimum_column_overlap", "violations",
    )


def compact_columns(placed: DataFrame) -> DataFrame:
    """Drop empty inferred columns and renumber; columns between two hard boundaries stay."""
    used = placed.filter("trim(text) <> ''").groupBy("group_id").agg(F.collect_set("col_no").alias("used"))
    tol = "greatest(2D, (element_at(col_bounds, -1) - get(col_bounds, 0)) * 0.004D)"
    hard = f"exists(hard_bounds, h -> abs(get(col_bounds, {{i}}) - h) <= {tol})"
    keep = (
        "filter(sequence(0, size(col_bounds) - 2), i -> array_contains(coalesce(used, array()), i) OR ("
        + hard.format(i="i") + " AND " + hard.format(i="i + 1") + "))"
    )
    joined = placed.join(used, "group_id", "left").withColumn("kept", F.expr(keep))
    old = [c for c in placed.columns if c not in ("col_no", "row_bounds", "col_bounds", "hard_bounds")]
    return joined.filter("size(kept) = 0 OR array_contains(kept, col_no)").selectExpr(
        *old, "cast(CASE WHEN size(kept) = 0 THEN col_no ELSE array_position(kept, col_no) - 1 END AS int) AS col_no",
        "CASE WHEN size(kept) = 0 THEN 0 ELSE size(col_bounds) - 1 - size(kept) END AS removed_columns",
    )


def owner_cells(boxes: DataFrame, owners: DataFrame) -> DataFrame:
    """The cell that owns each text box, or the reason why none does.

    owners: group_id, owner_id, x, y, width, height and the containment tolerance tol of the table.
    """
    reach = owners.selectExpr(
        "group_id", "owner_id", "x - tol AS x", "y - tol AS y", "width + 2 * tol AS width", "height + 2 * tol AS height",
        "x AS ox", "y AS oy", "width AS ow", "height AS oh", "tol",
    )

    def meets(l: Column, r: Column) -> Column:
        inner, outer = Box.field(l, PIXEL), Box(r["ox"], r["oy"], r["ow"], r["oh"])
        contained = (
            (inner.x >= outer.x - r["tol"]) & (inner.y >= outer.y - r["tol"])
            & (inner.right <= outer.right + r["tol"]) & (inner.bottom <= outer.bottom + r["tol"])
        )
        return (intersection(inner, outer) > 0) | contained

    pairs = pair_overlaps(boxes, reach, GROUP, PIXEL, PIXEL_TILE, meets, crowded_keys(boxes, owners, GROUP)).selectExpr(
        "group_id", "l.box_id AS box_id", "l.x AS x", "l.y AS y", "l.x + l.width AS x2", "l.y + l.height AS y2",
        "r.owner_id AS owner_id", "r.ox AS ox", "r.oy AS oy", "r.ox + r.ow AS ox2", "r.oy + r.oh AS oy2", "r.tol AS tol",
    ).selectExpr(
        "group_id", "box_id", "owner_id",
        "greatest(0D, least(x2, ox2) - greatest(x, ox)) * greatest(0D, least(y2, oy2) - greatest(y, oy))"
        " / greatest(1D, (x2 - x) * (y2 - y)) AS share",
        "greatest(0D, least(y2, oy2) - greatest(y, oy)) / greatest(1D, least(y2 - y, oy2 - oy)) AS row_fit",
        "greatest(0D, least(x2, ox2) - greatest(x, ox)) / greatest(1D, least(x2 - x, ox2 - ox)) AS col_fit",
        "x >= ox - tol AND y >= oy - tol AND x2 <= ox2 + tol AND y2 <= oy2 + tol AS contained",
    ).withColumn("score", F.expr("share * 0.62D + row_fit * 0.2D + col_fit * 0.18D + CASE WHEN contained THEN 0.35D ELSE 0D END"))
    order = W.partitionBy("group_id", "box_id").orderBy(F.desc("score"), "owner_id")
    best = pairs.withColumn("nth", F.row_number().over(order)).withColumn(
        "second", F.coalesce(F.lead("score").over(order), F.lit(0.0))
    ).filter("nth = 1")
    clear = "share >= 0.18 AND row_fit >= 0.35 AND col_fit >= 0.18 AND (score >= second * 1.12D OR contained)"
    settled = best.selectExpr(
        "group_id", "box_id", f"CASE WHEN {clear} THEN owner_id END AS owner_id", rnd_sql("score", 4) + " AS score",
        rnd_sql("second", 4) + " AS second_score", f"CASE WHEN {clear} THEN 'assigned' ELSE 'ambiguous_owner' END AS reason",
    )
    return boxes.select("group_id", "box_id").join(settled, ["group_id", "box_id"], "left").withColumn(
        "reason", F.coalesce("reason", F.lit("no_overlap"))
    )


def column_anchors(cells: DataFrame) -> DataFrame:
    """One anchor per column from its single-span cells, widened to the mid-points of its neighbours.

    cells: group_id, col_no, col_span, x, width.
    """
    single = cells.filter("col_span = 1 AND col_no >= 0").groupBy("group_id", "col_no").agg(
        F.expr("avg(x + width / 2)").alias("centre"), F.min("x").alias("first_left"), F.expr("max(x + width)").alias("last_right")
    )
    widths = cells.groupBy("group_id").agg(F.expr("median(greatest(1D, width))").alias("mid_width"))
    order = W.partitionBy("group_id").orderBy("centre", "col_no")
    near = single.withColumn("before", F.lag("centre").over(order)).withColumn("after", F.lead("centre").over(order))
    near = near.withColumn("anchor", (F.row_number().over(order) - 1).cast("int"))
    gaps = near.groupBy("group_id").agg(F.expr("median(after - centre)").alias("mid_gap"))
    return near.join(gaps, "group_id").join(widths, "group_id").selectExpr(
        "group_id", "anchor", "centre",
        "least(first_left, coalesce((before + centre) / 2, centre - coalesce(mid_gap, mid_width) / 2)) AS `left`",
        "greatest(last_right, coalesce((centre + after) / 2, centre + coalesce(mid_gap, mid_width) / 2)) AS `right`",
    )


def column_spans(boxes: DataFrame, anchors: DataFrame, tolerance: float) -> DataFrame:
    """First column and span of each box by the anchors it covers; otherwise the nearest anchor."""
    packed = anchors.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct("anchor", "centre", "left", "right"))).alias("anchors")
    )
    cover = f"filter(anchors, a -> x <= a.centre + {tolerance}D AND x + width >= a.centre - {tolerance}D)"
    inside = f"filter(anchors, a -> x + width / 2 BETWEEN a.left - {tolerance}D AND a.right + {tolerance}D)"
    closest = nearest("(x + width / 2)", "transform(anchors, a -> a.centre)")
    return boxes.join(packed, "group_id").withColumn("cover", F.expr(cover)).withColumn("holds", F.expr(inside)).selectExpr(
        *boxes.columns,
        f"CASE WHEN size(cover) > 1 THEN cover[0].anchor WHEN size(holds) > 0 THEN holds[0].anchor ELSE {closest} END AS start_col",
        "CASE WHEN size(cover) > 1 THEN element_at(cover, -1).anchor - cover[0].anchor + 1 ELSE 1 END AS span",
    )


def axis_boundaries(cells: DataFrame, index: str, span: str, start: str, size: str, count: DataFrame) -> DataFrame:
    """Boundaries of one axis from median cell edges; missing positions are interpolated.

    count: group_id, n. Positions of one table stay in one array of length n.
    """
    known = cells.filter(f"{span} = 1 AND {index} >= 0").groupBy("group_id", index).agg(
        F.expr(f"(median({start}) + median({start} + {size})) / 2").alias("centre"),
        F.expr(f"greatest(1D, median({start} + {size}) - median({start}))").alias("wide"),
    )
    order = W.partitionBy("group_id").orderBy(index)
    known = known.join(count, "group_id").filter(f"{index} < n").withColumn("gap", F.col("centre") - F.lag("centre").over(order))
    packed = known.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), "centre"))).alias("known"),
        F.expr("median(wide)").alias("mid_wide"), F.expr("median(gap)").alias("mid_gap"), F.max("n").alias("n"),
    )
    before, after = "element_at(filter(known, k -> k.i <= i), -1)", "get(filter(known, k -> k.i >= i), 0)"
    step = "coalesce(mid_gap, mid_wide, 40D)"
    centre = f"""CASE
        WHEN NOT exists(known, k -> k.i <= i) THEN {after}.centre - {step} * ({after}.i - i)
        WHEN NOT exists(known, k -> k.i >= i) THEN {before}.centre + {step} * (i - {before}.i)
        WHEN {before}.i = i THEN {before}.centre
        ELSE {before}.centre + ({after}.centre - {before}.centre) / ({after}.i - {before}.i) * (i - {before}.i) END"""
    centre = centre.replace("element_at(filter(known, k -> k.i <= i), -1)", "try_element_at(filter(known, k -> k.i <= i), -1)")
    dense = packed.withColumn("centres", F.expr(f"transform(sequence(0, n - 1), i -> {centre})"))
    edge = """transform(sequence(0, n), i -> CASE
        WHEN n = 1 THEN centres[0] + (i - 0.5D) * coalesce(mid_wide, 40D)
        WHEN i = 0 THEN centres[0] - (centres[1] - centres[0]) / 2
        WHEN i = n THEN get(centres, n - 1) + (get(centres, n - 1) - get(centres, n - 2)) / 2
        ELSE (get(centres, i - 1) + get(centres, i)) / 2 END)"""
    return dense.selectExpr("group_id", f"{edge} AS bounds")


def reading_confidence(readings: DataFrame, key: str) -> DataFrame:
    """Confidence summary: percentages scaled, unreadable and negative values dropped, blank texts left out."""
    value = F.expr("try_cast(confidence AS double)")
    scaled = F.when(value > 1.0, F.least(F.lit(1.0), value / 100)).otherwise(value)
    usable = (
        readings.filter("trim(coalesce(text, '')) <> ''").withColumn("value", scaled)
        .filter("value IS NOT NULL AND NOT isnan(value) AND value >= 0 AND abs(value) <= 1")
    )
    return usable.groupBy(key).agg(
        F.expr(rnd_sql("sum(cast(floor(value * 1000000D + 0.5D) AS bigint)) / 1000000D / count(*)", 4)).alias("average"),
        F.expr(rnd_sql("min(value)", 4)).alias("minimum"), F.count("*").alias("recognized_count"),
        F.count_if(F.col("value") < LOW_READING).alias("low_confidence_count"),
    )


def table_quality(cells: DataFrame) -> DataFrame:
    """Shape, fill, consistency and score of each table; the names of failed checks as penalties."""
    shape = cells.groupBy("table_id").agg(
        F.expr("max(row_no + row_span)").alias("row_count"), F.expr("max(col_no + col_span)").alias("column_count"),
        F.count_if(~F.col("hidden")).alias("visible"),
        F.count_if(F.expr("NOT hidden AND (row_span > 1 OR col_span > 1)")).alias("merged"),
    )
    filled = cells.filter("NOT hidden AND trim(text) <> ''").groupBy("table_id", "row_no").agg(F.count("*").alias("n"))
    rows = filled.join(shape.select("table_id", "column_count"), "table_id").groupBy("table_id").agg(
        F.sum("n").alias("filled"), F.count("*").alias("rows_used"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.count_if(F.expr("n / column_count < 0.35")).alias("sparse"),
    )
    joined = shape.join(rows, "table_id", "left").na.fill(0, ["filled", "rows_used", "squares", "sparse"])
    measured = joined.selectExpr(
        "*", "filled / (row_count * column_count) AS fill", "rows_used / row_count AS used", "sparse / row_count AS sparse_ratio",
        "CASE WHEN rows_used = 0 THEN 0D ELSE greatest(0D, 1D - sqrt((rows_used * squares - filled * filled) / (rows_used * rows_used)) / column_count) END AS consistency",
        "coalesce(merged / nullif(visible, 0), 0D) AS merged_ratio",
        f"row_count >= {MIN_ROWS} AND column_count >= {MIN_COLUMNS} AND rows_used >= {MIN_ROWS} AS usable_shape",
    )
    score = (
        f"(CASE WHEN row_count >= {MIN_ROWS} AND column_count >= {MIN_COLUMNS} THEN 1D ELSE 0.35D END * 0.30D + fill * 0.24D + used * 0.16D"
        " + consistency * 0.18D + (1D - sparse_ratio) * 0.08D + CASE WHEN visible > 0 THEN 0.08D ELSE 0D END"
        " + CASE WHEN merged_ratio > 0 AND merged_ratio <= 0.35 THEN 0.04D WHEN merged_ratio > 0.65 THEN -0.04D ELSE 0D END)"
        " * CASE WHEN usable_shape THEN 1D ELSE 0.65D END"
    )
    return measured.selectExpr(
        "table_id", "row_count", "column_count", "filled AS non_empty_cell_count", "visible > 0 AS has_structured_cells", "usable_shape",
        rnd_sql("fill", 4) + " AS fill_ratio", rnd_sql("used", 4) + " AS non_empty_row_ratio",
        rnd_sql("consistency", 4) + " AS column_consistency", rnd_sql("sparse_ratio", 4) + " AS sparse_row_ratio",
        rnd_sql("merged_ratio", 4) + " AS merged_cell_ratio", rnd_sql(clamp_sql(score), 4) + " AS structure_score",
        f"""array_compact(array(CASE WHEN NOT usable_shape THEN 'unusable_shape' END, CASE WHEN column_count < {MIN_COLUMNS} THEN 'too_few_columns' END,
            CASE WHEN fill < {FILL_RATIO} THEN 'low_fill_ratio' END, CASE WHEN consistency < {COLUMN_CONSISTENCY} THEN 'low_column_consistency' END,
            CASE WHEN sparse_ratio > {SPARSE_ROWS} THEN 'too_many_sparse_rows' END)) AS penalties""",
    )


def candidate_confidence(quality: DataFrame, readings: DataFrame) -> DataFrame:
    """Structure and reading quality combined, and whether another method should be tried."""
    joined = quality.join(readings, "table_id", "left")
    return joined.selectExpr(
        "*", rnd_sql(clamp_sql("CASE WHEN recognized_count > 0 THEN structure_score * 0.65D + average * 0.35D ELSE structure_score * 0.85D END"), 4)
        + " AS final_confidence",
    ).selectExpr(
        "*",
        f"NOT usable_shape OR row_count <= 0 OR column_count < {MIN_COLUMNS} OR final_confidence < {FINAL_CONFIDENCE} OR fill_ratio < {FILL_RATIO}"
        f" OR column_consistency < {COLUMN_CONSISTENCY} OR sparse_row_ratio > {SPARSE_ROWS} AS try_fallback",
    )


def select_candidate(candidates: DataFrame) -> DataFrame:
    """Best method per table: by confidence, or by structure when the first two are close."""
    first = W.partitionBy("table_id").orderBy(F.desc("final_confidence"), "method")
    ranked = candidates.withColumn("nth", F.row_number().over(first)).withColumn(
        "runner", F.lead("final_confidence").over(first)
    ).withColumn("runner_method", F.lead("method").over(first))
    whole = W.partitionBy("table_id")
    ranked = ranked.withColumn("lead_gap", F.max(F.expr("CASE WHEN nth = 1 THEN final_confidence - runner END")).over(whole)).withColumn(
        "n_candidates", F.count("*").over(whole)
    )
    tie = W.partitionBy("table_id").orderBy(
        F.desc("usable_shape"), F.desc("has_structured_cells"), F.desc(F.col("column_count") > 1), F.desc("non_empty_cell_count"),
        F.desc(F.col("method") == PRIMARY), F.desc("final_confidence"), "method",
    )
    ranked = ranked.withColumn("tied", F.row_number().over(tie))
    chosen = ranked.filter(f"CASE WHEN n_candidates = 1 OR lead_gap > {TIE}D THEN nth = 1 ELSE tied = 1 END")
    reason = f"""CASE WHEN n_candidates = 1 THEN 'only_valid_candidate'
        WHEN lead_gap > {TIE}D AND method = 'borderless_text_clustering' AND runner_method = '{PRIMARY}' THEN 'borderless_improved_low_quality_slanext'
        WHEN lead_gap > {TIE}D THEN 'higher_final_confidence'
        WHEN method = '{PRIMARY}' AND has_structured_cells THEN 'tie_preferred_structured_slanext' ELSE 'tie_breaker' END AS reason"""
    return chosen.selectExpr("table_id", "method", "final_confidence", "n_candidates", reason)


def tail_summary_start(cells: DataFrame, header_rows: int = 1) -> DataFrame:
    """First row of the sparse or spanned tail of each table; the row count when there is none."""
    rows = cells.withColumn("seen", F.expr(f"NOT hidden AND row_no >= {header_rows}")).groupBy("table_id", "row_no").agg(
        F.max(F.expr("row_no + row_span")).alias("row_end"), F.max(F.expr("col_no + col_span")).alias("col_end"), F.max("seen").alias("seen"),
        F.count_if(F.expr("seen AND trim(text) <> ''")).alias("n"), F.max(F.expr("CASE WHEN seen THEN row_span > 1 OR col_span > 1 END")).alias("spanned"),
    )
    whole, upwards = W.partitionBy("table_id"), W.partitionBy("table_id").orderBy(F.desc("row_no")).rowsBetween(W.unboundedPreceding, 0)
    sized = rows.withColumn("row_count", F.max("row_end").over(whole).cast("int")).withColumn("col_count", F.max("col_end").over(whole).cast("int"))
    # A row without visible cells also ends the tail: the last solid or missing row decides.
    solid = "seen AND NOT ((col_count >= 3 AND n > 0 AND n <= greatest(1, cast(floor(col_count * 0.45D) AS int))) OR spanned)"
    tail = sized.withColumn("last_solid", F.max(F.expr(f"CASE WHEN {solid} THEN row_no END")).over(whole)).withColumn(
        "in_tail", F.expr("coalesce(seen AND row_no > coalesce(last_solid, -1), false)")
    ).withColumn("nth", F.sum(F.col("in_tail").cast("int")).over(upwards))
    return tail.groupBy("table_id").agg(
        F.max("row_count").alias("row_count"), F.max("col_count").alias("col_count"),
        F.expr("cast(coalesce(min(CASE WHEN in_tail AND row_no = row_count - nth THEN row_no END), max(row_count)) AS int)").alias("summary_start"),
    )


def assignment_quality(cells: DataFrame) -> DataFrame:
    """Whether the texts of a table sit in the cells that claim them.

    cells: group_id, row_no, col_no, text, x, y, width, height of visible cells.
    """
    owners = cells.selectExpr("group_id", "row_no", "col_no", *PIXEL)
    sources = cells.filter("trim(text) <> ''").selectExpr("group_id", "row_no", "col_no", *PIXEL)
    pairs = pair_overlaps(
        sources, owners, GROUP, PIXEL, PIXEL_TILE,
        lambda l, r: intersection(Box.field(l, PIXEL), Box.field(r, PIXEL)) > 0, crowded_keys(sources, owners, GROUP),
    )
    one, two = Box.field(F.col("l"), PIXEL), Box.field(F.col("r"), PIXEL)
    scored = pairs.select(
        "group_id", F.col("l.row_no").alias("row_no"), F.col("l.col_no").alias("col_no"),
        (intersection(one, two) / F.greatest(F.lit(1.0), one.area)).alias("share"),
        F.expr("l.row_no = r.row_no AND l.col_no = r.col_no AS same"), F.expr("r.row_no AS o_row"), F.expr("r.col_no AS o_col"),
    )
    order = W.partitionBy("group_id", "row_no", "col_no").orderBy(F.desc("share"), "o_row", "o_col")
    best = scored.withColumn("nth", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("share").over(order), F.lit(0.0))).filter(
        "nth = 1 AND share >= 0.2"
    )
    found = best.groupBy("group_id").agg(
        F.count("*").alias("assigned"), F.count_if(F.expr("second > 0.18 OR NOT same")).alias("crossing"),
        F.sum(units(F.expr("CASE WHEN same THEN share ELSE share * 0.75D END"), 6)).alias("total"),
    )
    counts = sources.groupBy("group_id").agg(F.count("*").alias("texts"))
    return cells.select("group_id").distinct().join(counts, "group_id", "left").join(found, "group_id", "left").na.fill(
        0, ["texts", "assigned", "crossing", "total"]
    ).selectExpr(
        "group_id", "texts", "assigned", rnd_sql("coalesce(assigned / nullif(texts, 0), 0D)", 4) + " AS text_coverage",
        rnd_sql("coalesce(crossing / nullif(assigned, 0), 0D)", 4) + " AS cross_boundary_ratio",
        rnd_sql("coalesce(total / 1000000D / nullif(assigned, 0), 0D)", 4) + " AS assignment_consistency",
        "texts > 0 AND assigned / nullif(texts, 0) >= 0.82 AND coalesce(crossing / nullif(assigned, 0), 0D) <= 0.32"
        " AND coalesce(total / 1000000D / nullif(assigned, 0), 0D) >= 0.58 AS passed",
    )
