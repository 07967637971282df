"""Clusters, grids, owners, quality and method choice for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.numeric import rnd_sql
from folioframe.operators import cascade, clusters, dedupe, tables
from folioframe.operators.clusters import axis_clusters, cluster_centres
from folioframe.plans.derive import oracle, sql, table
from folioframe.plans.registry import query
from folioframe.plans.sqltext import clamp, common_px, rnd
from folioframe.session import cut_lineage

# Text boxes of a table: one per line item, placed on two columns.
sql("boxes", """
SELECT l_orderkey AS group_id, l_linenumber AS box_id, concat(min(l_returnflag), CAST(l_linenumber AS VARCHAR)) AS text,
       CAST(50 + (min(l_suppkey) % 50) AS DOUBLE) / 100 AS confidence,
       CAST(10 + ((l_linenumber - 1) % 2) * 110 + min(l_partkey) % 7 AS DOUBLE) AS x,
       CAST(10 + floor((l_linenumber - 1) / 2.0) * 40 + min(l_suppkey) % 5 AS DOUBLE) AS y,
       CAST(40 + min(l_partkey) % 11 AS DOUBLE) AS width, CAST(12 + min(l_suppkey) % 4 AS DOUBLE) AS height
FROM lineitem GROUP BY l_orderkey, l_linenumber""")


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.ascii("l_returnflag")).alias("flag"), F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp")
    )
    return lines.selectExpr(
        "l_orderkey AS group_id", "l_linenumber AS box_id", "concat(chr(flag), l_linenumber) AS text",
        "cast(50 + supp % 50 AS double) / 100 AS confidence",
        "cast(10 + ((l_linenumber - 1) % 2) * 110 + part % 7 AS double) AS x",
        "cast(10 + floor((l_linenumber - 1) / 2.0D) * 40 + supp % 5 AS double) AS y",
        "cast(40 + part % 11 AS double) AS width", "cast(12 + supp % 4 AS double) AS height",
    )


sql("mids", "SELECT group_id, median(height) AS mh, median(width) AS mw FROM boxes GROUP BY group_id", "boxes")


def _tolerance(boxes_df: DataFrame, axis: str, expr: str) -> DataFrame:
    size = "height" if axis == "y" else "width"
    mids = boxes_df.groupBy("group_id").agg(F.expr(expr.format(m=f"median({size})")).alias("tol"))
    return boxes_df.join(mids, "group_id").withColumn("centre", F.expr(f"{axis} + {size} / 2"))


@query("win01_gap_clusters", oracle("""
WITH v AS (SELECT group_id, box_id, y + height / 2 AS c, greatest(6.0::DOUBLE, mh * 0.8::DOUBLE) AS tol FROM boxes JOIN mids USING (group_id)),
f AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY group_id ORDER BY c, box_id) > tol THEN 1 ELSE 0 END AS o FROM v),
n AS (SELECT *, sum(o) OVER (PARTITION BY group_id ORDER BY c, box_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT group_id, CAST(k + 1 AS INTEGER) AS cluster, """ + rnd("avg(c)", 6) + " AS centre, count(*) AS size FROM n GROUP BY ALL", "boxes", "mids"))
def gap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    points = _tolerance(boxes(spark, sf), "y", "greatest(6D, {m} * 0.8D)")
    centres = cluster_centres(axis_clusters(points, ["group_id"], "centre", "tol", "last"), ["group_id"])
    return centres.select("group_id", "cluster", F.expr(rnd_sql("centre", 6)).alias("centre"), "size")


def _walk(order: str, value: str, rule: str) -> str:
    """Row by row clustering; rows holds (sum, count) of each cluster so far."""
    if rule == "mean":
        pick = "CASE WHEN len(w.rows) > 0 AND abs(i.c - w.rows[-1].s / w.rows[-1].n) <= i.tol THEN len(w.rows) ELSE NULL END"
    else:
        pick = "list_position(list_transform(w.rows, lambda r: abs(i.c - r.s / r.n) <= i.tol), true)"
    return f"""
WITH RECURSIVE items AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {order}) AS rn FROM ({value})),
walk AS (SELECT DISTINCT group_id, 0::BIGINT AS step, CAST([] AS STRUCT(s DOUBLE, n BIGINT)[]) AS rows, CAST([] AS BIGINT[]) AS picks FROM items
  UNION ALL
  SELECT group_id, step + 1,
    CASE WHEN hit IS NULL THEN list_append(rows, {{'s': c, 'n': 1::BIGINT}})
      ELSE list_transform(rows, lambda r, k: CASE WHEN k = hit THEN {{'s': r.s + c, 'n': r.n + 1}} ELSE r END) END,
    list_append(picks, coalesce(hit, len(rows) + 1))
  FROM (SELECT w.*, i.c, CAST(nullif({pick}, 0) AS BIGINT) AS hit FROM walk w JOIN items i ON i.group_id = w.group_id AND i.rn = w.step + 1)),
ends AS (SELECT group_id, picks FROM walk QUALIFY step = max(step) OVER (PARTITION BY group_id)),
placed AS (SELECT i.*, CAST(e.picks[i.rn] AS INTEGER) AS cluster FROM items i JOIN ends e USING (group_id))"""


@query("win02_running_mean_clusters", oracle(_walk("c, box_id", """
SELECT group_id, box_id, x + width / 2 AS c, greatest(6.0::DOUBLE, mw * 0.72::DOUBLE) AS tol FROM boxes JOIN mids USING (group_id)""", "mean") + """
SELECT group_id, cluster, """ + rnd("avg(c)", 6) + " AS centre, count(*) AS size FROM placed GROUP BY ALL", "boxes", "mids"))
def running_mean_clusters(spark: SparkSession, sf: str) -> DataFrame:
    points = _tolerance(boxes(spark, sf), "x", "greatest(6D, {m} * 0.72D)")
    centres = cluster_centres(axis_clusters(points, ["group_id"], "centre", "tol", "mean"), ["group_id"])
    return centres.select("group_id", "cluster", F.expr(rnd_sql("centre", 6)).alias("centre"), "size")


ROWS_VALUE = "SELECT b.*, y + height / 2 AS c, x + width / 2 AS cx, greatest(8.0::DOUBLE, mh * 0.75::DOUBLE) AS tol, mw FROM boxes b JOIN mids USING (group_id)"


@query("win04_row_clusters", oracle(_walk("c, x, box_id", ROWS_VALUE, "any") + """
SELECT group_id, box_id, cluster - 1 AS row_no FROM placed""", "boxes", "mids"))
def row_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return tables.with_rows(boxes(spark, sf)).select("group_id", "box_id", "row_no")


@query("tbl04_raw_geometry", oracle(_walk("c, x, box_id", ROWS_VALUE, "any") + """
SELECT group_id, cluster - 1 AS row_no, CAST(row_number() OVER (PARTITION BY group_id, cluster ORDER BY x, y + height / 2, box_id) - 1 AS INTEGER) AS col_no, text
FROM placed""", "boxes", "mids"))
def raw_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return tables.raw_geometry_table(boxes(spark, sf)).select("group_id", "row_no", "col_no", "text")


@query("tbl03_borderless_table", oracle(_walk("c, x, box_id", ROWS_VALUE, "any") + f""",
xs AS (SELECT group_id, cx, greatest(14.0::DOUBLE, mw * 0.75::DOUBLE) AS ct, row_number() OVER (PARTITION BY group_id ORDER BY cx) AS rn FROM placed),
sweep AS (SELECT DISTINCT group_id, 0::BIGINT AS step, CAST([] AS DOUBLE[]) AS centres FROM xs
  UNION ALL SELECT s.group_id, s.step + 1, CASE WHEN len(s.centres) = 0 OR abs(x.cx - s.centres[-1]) > x.ct THEN list_append(s.centres, x.cx)
    ELSE list_append(s.centres[1:-2], (s.centres[-1] + x.cx) / 2) END
  FROM sweep s JOIN xs x ON x.group_id = s.group_id AND x.rn = s.step + 1),
columns AS (SELECT group_id, centres FROM sweep QUALIFY step = max(step) OVER (PARTITION BY group_id)),
cells AS (SELECT p.group_id, p.cluster - 1 AS row_no, len(centres) AS col_count, text, x, y, box_id, confidence, width, height,
   list_position(list_transform(centres, lambda m: abs(p.cx - m)), list_min(list_transform(centres, lambda m: abs(p.cx - m)))) - 1 AS col_no
  FROM placed p JOIN columns c USING (group_id) WHERE len(centres) >= 2),
merged AS (SELECT group_id, row_no, CAST(col_no AS INTEGER) AS col_no, CAST(any_value(col_count) AS INTEGER) AS col_count, string_agg(text, ' ' ORDER BY x, box_id) AS text,
  count(*) AS box_count, {rnd('sum(CAST(floor(confidence * 10000 + 0.5) AS BIGINT)) / 10000.0::DOUBLE / count(*)', 6)} AS confidence, min(x) AS x, min(y) AS y,
  greatest(1.0::DOUBLE, max(x + width) - min(x)) AS width, greatest(1.0::DOUBLE, max(y + height) - min(y)) AS height FROM cells GROUP BY ALL)
SELECT m.* FROM merged m WHERE (SELECT count(DISTINCT row_no) FROM merged k WHERE k.group_id = m.group_id) >= 2""", "boxes", "mids"))
def borderless_table(spark: SparkSession, sf: str) -> DataFrame:
    cells = tables.borderless_cells(boxes(spark, sf))
    return cells.select(
        "group_id", "row_no", "col_no", "col_count", "text", "box_count", F.expr(rnd_sql("confidence", 6)).alias("confidence"), "x", "y", "width", "height"
    )


@query("agg17_medians", oracle("""
SELECT group_id, median(height) AS true_median, median(width) FILTER (width > 45) AS filtered_median,
       list_sort(list(width))[CAST(floor(count(*) / 2.0) AS BIGINT) + 1] AS upper_median FROM boxes GROUP BY group_id""", "boxes"))
def medians(spark: SparkSession, sf: str) -> DataFrame:
    """The upper median comes from a value histogram, so a group costs its distinct values, not its rows."""
    source = boxes(spark, sf)
    counted = source.groupBy("group_id", "width").agg(F.count("*").alias("n"))
    upper = counted.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct("width", "n"))).alias("h"), F.sum("n").alias("total")
    ).selectExpr(
        "group_id",
        """aggregate(h, named_struct('seen', 0L, 'v', cast(null AS double)), (a, e) -> CASE WHEN a.seen <= floor(total / 2D)
             THEN named_struct('seen', a.seen + e.n, 'v', e.width) ELSE a END, a -> a.v) AS upper_median""",
    )
    exact = source.groupBy("group_id").agg(
        F.median("height").alias("true_median"), F.expr("median(CASE WHEN width > 45 THEN width END)").alias("filtered_median")
    )
    return exact.join(upper, "group_id")


@query("agg13_merged_cells", oracle(f"""
SELECT group_id, CAST(floor((box_id - 1) / 4.0) AS INTEGER) AS cell_no, string_agg(text, ' ' ORDER BY y, x, box_id) AS text, count(*) AS box_count,
  {rnd('sum(CAST(floor(confidence * 10000 + 0.5) AS BIGINT)) / 10000.0::DOUBLE / count(*)', 6)} AS confidence,
  min(x) AS x, min(y) AS y, greatest(1.0::DOUBLE, max(x + width) - min(x)) AS width, greatest(1.0::DOUBLE, max(y + height) - min(y)) AS height
FROM boxes GROUP BY group_id, floor((box_id - 1) / 4.0)""", "boxes"))
def merged_cells(spark: SparkSession, sf: str) -> DataFrame:
    keyed = boxes(spark, sf).withColumn("cell_no", F.expr("cast(floor((box_id - 1) / 4D) AS int)"))
    merged = tables.merge_boxes(keyed, ["group_id", "cell_no"])
    return merged.withColumn("confidence", F.expr(rnd_sql("confidence", 6)))


sql("owners", """
SELECT group_id, box_id AS owner_id, CAST(((box_id - 1) % 2) * 110 + 5 + group_id % 30 AS DOUBLE) AS x,
       floor((box_id - 1) / 2.0) * 40 + 5 + group_id % 9 AS y, 70.0::DOUBLE AS width, 18.0::DOUBLE AS height FROM boxes""", "boxes")


def owners(spark: SparkSession, sf: str) -> DataFrame:
    return boxes(spark, sf).selectExpr(
        "group_id", "box_id AS owner_id", "cast(((box_id - 1) % 2) * 110 + 5 + group_id % 30 AS double) AS x",
        "cast(floor((box_id - 1) / 2D) * 40 + 5 + group_id % 9 AS double) AS y", "70D AS width", "18D AS height", "2D AS tol",
    )


@query("join14_owner_cells", oracle(f"""
WITH p AS (SELECT a.group_id, a.box_id, b.owner_id, {common_px('a', 'b')} / greatest(1.0::DOUBLE, (a.x + a.width - a.x) * (a.y + a.height - a.y)) AS share,
   greatest(0.0::DOUBLE, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) / greatest(1.0::DOUBLE, least(a.height, b.height)) AS rf,
   greatest(0.0::DOUBLE, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) / greatest(1.0::DOUBLE, least(a.width, b.width)) AS cf,
   a.x >= b.x - 2 AND a.y >= b.y - 2 AND a.x + a.width <= b.x + b.width + 2 AND a.y + a.height <= b.y + b.height + 2 AS held
  FROM boxes a JOIN owners b USING (group_id)),
s AS (SELECT *, share * 0.62::DOUBLE + rf * 0.2::DOUBLE + cf * 0.18::DOUBLE + CASE WHEN held THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS score FROM p WHERE share > 0 OR held),
r AS (SELECT *, row_number() OVER w AS nth, coalesce(lead(score) OVER w, 0.0::DOUBLE) AS second FROM s WINDOW w AS (PARTITION BY group_id, box_id ORDER BY score DESC, owner_id)),
d AS (SELECT *, share >= 0.18 AND rf >= 0.35 AND cf >= 0.18 AND (score >= second * 1.12::DOUBLE OR held) AS ok FROM r WHERE nth = 1)
SELECT b.group_id, b.box_id, CASE WHEN ok THEN owner_id END AS owner_id, {rnd('score', 4)} AS score, {rnd('second', 4)} AS second_score,
  CASE WHEN d.box_id IS NULL THEN 'no_overlap' WHEN ok THEN 'assigned' ELSE 'ambiguous_owner' END AS reason
FROM boxes b LEFT JOIN d USING (group_id, box_id)""", "boxes", "owners"))
def owner_cells(spark: SparkSession, sf: str) -> DataFrame:
    return tables.owner_cells(boxes(spark, sf), owners(spark, sf))


# Boundaries of a group: its drawn columns and rows.
sql("grids", """
SELECT DISTINCT group_id, [0.0::DOUBLE, 45.0::DOUBLE, 100.0::DOUBLE + group_id % 25, 145.0::DOUBLE, 300.0::DOUBLE] AS cols,
  [0.0::DOUBLE, 36.0::DOUBLE, 75.0::DOUBLE + group_id % 6, 118.0::DOUBLE, 220.0::DOUBLE] AS rows, [0.0::DOUBLE, 100.0::DOUBLE + group_id % 25, 300.0::DOUBLE] AS hard FROM boxes""", "boxes")


def grids(spark: SparkSession, sf: str, seen: DataFrame | None = None) -> DataFrame:
    """Lines of every group that has boxes; `seen`: those boxes, where they are at hand."""
    groups = table(spark, sf, "lineitem").selectExpr("l_orderkey AS group_id") if seen is None else seen.select("group_id")
    return groups.distinct().selectExpr(
        "group_id", "array(0D, 45D, 100D + group_id % 25, 145D, 300D) AS col_bounds",
        "array(0D, 36D, 75D + group_id % 6, 118D, 220D) AS row_bounds", "array(0D, 100D + group_id % 25, 300D) AS hard_bounds",
        "6D AS x_tol", "4D AS y_tol",
    )


def _interval_sql(name: str, source: str, bounds: str, start: str, end: str, tol: str) -> str:
    """Ranks every interval for every box; nth = 1 is the dominant one."""
    return f"""{name} AS (SELECT * FROM (SELECT b.group_id, b.box_id, i - 1 AS idx, row_number() OVER (PARTITION BY b.group_id, b.box_id ORDER BY
   greatest(0.0::DOUBLE, least({end}, g.{bounds}[i + 1]) - greatest({start}, g.{bounds}[i])) / greatest(1.0::DOUBLE, {end} - {start}) * 0.72::DOUBLE
   + greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(({start} + {end}) / 2 - (g.{bounds}[i] + g.{bounds}[i + 1]) / 2) / greatest(greatest(1.0::DOUBLE, {end} - {start}), g.{bounds}[i + 1] - g.{bounds}[i], 1.0::DOUBLE)) * 0.28::DOUBLE
   - CASE WHEN {start} < g.{bounds}[i] - {tol} OR {end} > g.{bounds}[i + 1] + {tol} THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END DESC, i) AS nth
  FROM {source} b JOIN grids g USING (group_id), unnest(range(1, len(g.{bounds}))) AS t(i)) WHERE nth = 1)"""


X, Y = ("b.x", "(b.x + b.width)"), ("b.y", "(b.y + b.height)")


@query("join15_dominant_interval", oracle(f"""
WITH {_interval_sql('c', 'boxes', 'cols', *X, '6')}, {_interval_sql('r', 'boxes', 'rows', *Y, '4')}
SELECT group_id, box_id, CAST(r.idx AS INTEGER) AS row_no, CAST(c.idx AS INTEGER) AS col_no FROM r JOIN c USING (group_id, box_id)""", "boxes", "grids"))
def dominant_intervals(spark: SparkSession, sf: str) -> DataFrame:
    joined = boxes(spark, sf).join(grids(spark, sf), "group_id")
    return joined.selectExpr(
        "group_id", "box_id", clusters.dominant_interval("y", "(y + height)", "row_bounds", "y_tol") + " AS row_no",
        clusters.dominant_interval("x", "(x + width)", "col_bounds", "x_tol") + " AS col_no",
    )


GRID_SQL = f"""
WITH {_interval_sql('h', 'boxes', 'hard', *X, '6')}, {_interval_sql('r', 'boxes', 'rows', *Y, '4')},
al AS (SELECT b.*, r.idx AS row_no, h.idx AS hard_no, g.cols, g.rows, g.hard, list_filter(range(0, len(g.cols) - 1), lambda i:
     (g.cols[i + 1] + g.cols[i + 2]) / 2 BETWEEN g.hard[h.idx + 1] - 6 AND g.hard[h.idx + 2] + 6) AS allowed0
   FROM boxes b JOIN grids g USING (group_id) JOIN h USING (group_id, box_id) JOIN r USING (group_id, box_id)),
pa AS (SELECT *, count(*) OVER (PARTITION BY group_id, row_no) AS peers, CASE WHEN len(allowed0) = 0 THEN range(0, len(cols) - 1) ELSE allowed0 END AS allowed FROM al),
cr AS (SELECT *, list_filter(range(1, len(cols) - 1), lambda i: x < cols[i + 1] - 6 AND x + width > cols[i + 1] + 6
     AND (list_contains(allowed, i - 1) OR list_contains(allowed, i))) AS crossed FROM pa),
sc AS (SELECT group_id, box_id, k, row_number() OVER (PARTITION BY group_id, box_id ORDER BY
   greatest(0.0::DOUBLE, least(x + width, cols[k + 2]) - greatest(x, cols[k + 1])) / greatest(1.0::DOUBLE, width) * 0.72::DOUBLE
   + greatest(0.0::DOUBLE, 1.0::DOUBLE - abs((x + (x + width)) / 2 - (cols[k + 1] + cols[k + 2]) / 2) / greatest(greatest(1.0::DOUBLE, width), cols[k + 2] - cols[k + 1], 1.0::DOUBLE)) * 0.28::DOUBLE
   - CASE WHEN x < cols[k + 1] - 6 OR x + width > cols[k + 2] + 6 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END DESC, k) AS nth FROM cr, unnest(allowed) AS t(k)),
placed AS (SELECT cr.*, CASE WHEN row_no = 0 AND peers <= 1 AND len(crossed) > 0 THEN greatest(0, list_min(crossed) - 1) ELSE sc.k END AS col_no
   FROM cr JOIN sc ON sc.group_id = cr.group_id AND sc.box_id = cr.box_id AND nth = 1)"""


def placed_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return tables.assign_to_grid(boxes(spark, sf), grids(spark, sf))


@query("tbl09_grid_assignment", oracle(GRID_SQL + """
SELECT group_id, box_id, CAST(row_no AS INTEGER) AS row_no, CAST(col_no AS INTEGER) AS col_no FROM placed""", "boxes", "grids"))
def grid_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return placed_boxes(spark, sf).select("group_id", "box_id", "row_no", "col_no")


@query("agg12_grid_diagnostics", oracle(GRID_SQL + f""",
m AS (SELECT *, greatest(0.0::DOUBLE, least(y + height, rows[row_no + 2]) - greatest(y, rows[row_no + 1])) / greatest(1.0::DOUBLE, height) AS rfit,
  greatest(0.0::DOUBLE, least(x + width, cols[col_no + 2]) - greatest(x, cols[col_no + 1])) / greatest(1.0::DOUBLE, width) AS cfit,
  (cols[col_no + 1] + cols[col_no + 2]) / 2 AS mid FROM placed),
h0 AS (SELECT * FROM (SELECT p.group_id, p.box_id, i - 1 AS idx, row_number() OVER (PARTITION BY p.group_id, p.box_id ORDER BY
   greatest(0.0::DOUBLE, least(x + width, hard[i + 1]) - greatest(x, hard[i])) / greatest(1.0::DOUBLE, x + width - x) * 0.72::DOUBLE
   + greatest(0.0::DOUBLE, 1.0::DOUBLE - abs((x + (x + width)) / 2 - (hard[i] + hard[i + 1]) / 2) / greatest(greatest(1.0::DOUBLE, x + width - x), hard[i + 1] - hard[i], 1.0::DOUBLE)) * 0.28::DOUBLE
   - CASE WHEN x < hard[i] OR x + width > hard[i + 1] THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END DESC, i) AS nth FROM placed p, unnest(range(1, len(hard))) AS t(i)) WHERE nth = 1)
SELECT m.group_id, count(*) AS boxes, {rnd('(4 - count(DISTINCT row_no) FILTER (trim(text) <> \'\')) / 4', 4)} AS empty_row_ratio, {rnd('(4 - count(DISTINCT col_no) FILTER (trim(text) <> \'\')) / 4', 4)} AS empty_column_ratio,
  {rnd(clamp('sum(CAST(floor(rfit * 1000000 + 0.5) AS BIGINT)) / 1000000.0::DOUBLE / count(*)'), 4)} AS average_row_overlap,
  {rnd(clamp('sum(CAST(floor(cfit * 1000000 + 0.5) AS BIGINT)) / 1000000.0::DOUBLE / count(*)'), 4)} AS average_column_overlap,
  {rnd(clamp('min(rfit)'), 4)} AS minimum_row_overlap, {rnd(clamp('min(cfit)'), 4)} AS minimum_column_overlap,
  count(*) FILTER (NOT (mid BETWEEN hard[h0.idx + 1] AND hard[h0.idx + 2])) AS violations
FROM m JOIN h0 USING (group_id, box_id) GROUP BY m.group_id""", "boxes", "grids"))
def grid_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return tables.grid_diagnostics(placed_boxes(spark, sf))


@query("tbl10_compact_columns", oracle(GRID_SQL + """,
u AS (SELECT group_id, list(DISTINCT col_no) AS used FROM placed GROUP BY group_id),
k AS (SELECT p.*, list_filter(range(0, len(cols) - 1), lambda i: list_contains(used, i) OR
   (len(list_filter(hard, lambda h: abs(cols[i + 1] - h) <= greatest(2.0, 300 * 0.004))) > 0 AND len(list_filter(hard, lambda h: abs(cols[i + 2] - h) <= greatest(2.0, 300 * 0.004))) > 0)) AS kept
  FROM placed p JOIN u USING (group_id))
SELECT group_id, box_id, CAST(row_no AS INTEGER) AS row_no, CAST(list_position(kept, col_no) - 1 AS INTEGER) AS col_no, CAST(len(cols) - 1 - len(kept) AS INTEGER) AS removed_columns FROM k""", "boxes", "grids"))
def compact_columns(spark: SparkSession, sf: str) -> DataFrame:
    return tables.compact_columns(cut_lineage(placed_boxes(spark, sf))).select("group_id", "box_id", "row_no", "col_no", "removed_columns")


@query("agg18_alignment_support", oracle(f"""
WITH {_interval_sql('c', 'boxes', 'cols', *X, '6')}, n AS (SELECT group_id, count(DISTINCT floor((box_id - 1) / 2.0)) AS rows FROM boxes GROUP BY group_id),
hits AS (SELECT group_id, idx, count(DISTINCT floor((box_id - 1) / 2.0)) AS hits FROM c GROUP BY ALL)
SELECT n.group_id, count(*) FILTER (hits >= 2 AND hits / rows >= 0.45) AS supporting, {rnd('sum(hits) / any_value(rows) / 4', 4)} AS alignment_score
FROM n JOIN hits USING (group_id) GROUP BY n.group_id""", "boxes", "grids"))
def alignment_support(spark: SparkSession, sf: str) -> DataFrame:
    """Share of row clusters that reach each column; columns without hits count as 0."""
    joined = boxes(spark, sf).join(grids(spark, sf), "group_id").selectExpr(
        "group_id", "cast(floor((box_id - 1) / 2D) AS int) AS cluster", "size(col_bounds) - 1 AS n_cols",
        clusters.dominant_interval("x", "(x + width)", "col_bounds", "x_tol") + " AS col_no",
    )
    return support_scores(joined)


def support_scores(hits: DataFrame) -> DataFrame:
    """hits: group_id, cluster, col_no, n_cols, one row per box."""
    totals = hits.groupBy("group_id").agg(F.countDistinct("cluster").alias("n"), F.max("n_cols").alias("n_cols"))
    by_col = hits.groupBy("group_id", "col_no").agg(F.countDistinct("cluster").alias("hits")).join(totals, "group_id")
    return by_col.groupBy("group_id").agg(
        F.count_if(F.expr("hits >= 2 AND hits / n >= 0.45")).alias("supporting"),
        F.expr(rnd_sql("sum(hits) / max(n) / max(n_cols)", 4)).alias("alignment_score"),
    )


@query("tbl05_boundaries", oracle(f"""
WITH v AS (SELECT group_id, box_id, x + width / 2 AS c, greatest(6.0::DOUBLE, mw * 0.8::DOUBLE) AS tol FROM boxes JOIN mids USING (group_id)),
f AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY group_id ORDER BY c, box_id) > tol THEN 1 ELSE 0 END AS o FROM v),
n AS (SELECT *, sum(o) OVER (PARTITION BY group_id ORDER BY c, box_id ROWS UNBOUNDED PRECEDING) AS k FROM f),
m AS (SELECT group_id, k, avg(c) AS centre FROM n GROUP BY ALL),
e AS (SELECT group_id, (centre + lead(centre) OVER (PARTITION BY group_id ORDER BY k)) / 2 AS edge FROM m),
b AS (SELECT group_id, list_sort(list_distinct(list_concat([0.0::DOUBLE, 300.0::DOUBLE], list({rnd('edge', 3)}) FILTER (edge IS NOT NULL)))) AS bounds FROM e GROUP BY group_id),
d AS (SELECT b.group_id, bounds, CASE WHEN b.group_id % 3 = 0 THEN [0.0::DOUBLE, 20.0::DOUBLE, 150.0::DOUBLE, 290.0::DOUBLE, 300.0::DOUBLE] ELSE [0.0::DOUBLE, 300.0::DOUBLE] END AS drawn FROM b)
SELECT group_id, len(drawn) >= 3 AND len(drawn) >= greatest(3, floor(len(bounds) * 0.6)) AS from_lines,
  array_to_string(list_transform(CASE WHEN len(drawn) >= 3 AND len(drawn) >= greatest(3, floor(len(bounds) * 0.6)) THEN drawn ELSE bounds END, lambda v: CAST(CAST(floor(v * 1000 + 0.5) AS BIGINT) AS VARCHAR)), ',') AS bounds FROM d""", "boxes", "mids"))
def boundaries(spark: SparkSession, sf: str) -> DataFrame:
    source = boxes(spark, sf)
    inferred = tables.text_boundaries(source, "x", F.lit(300.0))
    drawn = source.select("group_id").distinct().selectExpr(
        "group_id", "CASE WHEN group_id % 3 = 0 THEN array(1D, 20D, 150D, 290D, 299D) ELSE array(2D) END AS lines"
    )
    joined = tables.combined_boundaries(inferred, drawn)
    return joined.selectExpr(
        "group_id", "from_lines", "array_join(transform(bounds, v -> cast(cast(floor(v * 1000D + 0.5D) AS bigint) AS string)), ',') AS bounds"
    )


@query("tbl06_repeated_alignment", oracle("""
WITH v AS (SELECT group_id, box_id, y + height / 2 AS c, greatest(6.0::DOUBLE, mh * 0.75::DOUBLE) AS tol FROM boxes JOIN mids USING (group_id)
   WHERE group_id IN (SELECT group_id FROM boxes GROUP BY group_id HAVING count(*) >= 4)),
f AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY group_id ORDER BY c, box_id) > tol THEN 1 ELSE 0 END AS o FROM v),
n AS (SELECT *, sum(o) OVER (PARTITION BY group_id ORDER BY c, box_id ROWS UNBOUNDED PRECEDING) AS k FROM f),
m AS (SELECT group_id, k, avg(c) AS centre, any_value(tol) AS tol FROM n GROUP BY ALL),
s AS (SELECT m.*, (SELECT count(*) FROM v WHERE v.group_id = m.group_id AND abs(v.c - m.centre) <= m.tol) AS support FROM m),
e AS (SELECT *, (centre + lead(centre) OVER w) / 2 AS edge, lead(support) OVER w AS ns FROM s WINDOW w AS (PARTITION BY group_id ORDER BY k))
SELECT group_id, """ + rnd("edge", 6) + " AS edge FROM e WHERE support >= 2 AND ns >= 2 AND edge BETWEEN tol AND 220 - tol", "boxes", "mids"))
def repeated_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return tables.repeated_alignment(boxes(spark, sf), "y", F.lit(220.0)).select("group_id", F.expr(rnd_sql("edge", 6)).alias("edge"))


def _bounds_text(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "group_id", "array_join(transform(bounds, v -> cast(cast(floor(v * 1000D + 0.5D) AS bigint) AS string)), ',') AS bounds"
    )


@query("tbl07_logical_subrows")
def logical_subrows(spark: SparkSession, sf: str) -> DataFrame:
    hard = grids(spark, sf).selectExpr("group_id", "array(0D, 75D + group_id % 6, 220D) AS bounds")
    return _bounds_text(tables.logical_subrows(boxes(spark, sf), hard))


@query("tbl08_logical_subcolumns")
def logical_subcolumns(spark: SparkSession, sf: str) -> DataFrame:
    shapes = grids(spark, sf)
    hard = shapes.selectExpr("group_id", "array(0D, 300D) AS bounds")
    rows = shapes.selectExpr("group_id", "row_bounds AS bounds")
    return _bounds_text(tables.logical_subcolumns(boxes(spark, sf), hard, rows))


def _anchor_cells(spark: SparkSession, sf: str) -> DataFrame:
    return boxes(spark, sf).selectExpr(
        "group_id", "box_id", "cast(box_id % 4 AS int) AS col_no", "CASE WHEN box_id % 5 = 0 THEN 2 ELSE 1 END AS col_span",
        "x + (box_id % 4) * 30D AS x", "y", "width", "height",
    )


sql("anchor_cells", """
SELECT group_id, box_id, CAST(box_id % 4 AS INTEGER) AS col_no, CASE WHEN box_id % 5 = 0 THEN 2 ELSE 1 END AS col_span,
  x + (box_id % 4) * 30.0::DOUBLE AS x, y, width, height FROM boxes""", "boxes")

sql("anchors", """
SELECT group_id, CAST(row_number() OVER w - 1 AS INTEGER) AS anchor, centre,
  least(l, coalesce((lag(centre) OVER w + centre) / 2, centre - coalesce(mg, mw) / 2)) AS lo,
  greatest(r, coalesce((centre + lead(centre) OVER w) / 2, centre + coalesce(mg, mw) / 2)) AS hi
FROM (SELECT s.*, g.mg, m.mw FROM (SELECT group_id, col_no, avg(x + width / 2) AS centre, min(x) AS l, max(x + width) AS r FROM anchor_cells WHERE col_span = 1 GROUP BY ALL) s
  JOIN (SELECT group_id, median(gap) AS mg FROM (SELECT group_id, lead(c) OVER (PARTITION BY group_id ORDER BY c) - c AS gap
     FROM (SELECT group_id, avg(x + width / 2) AS c FROM anchor_cells WHERE col_span = 1 GROUP BY group_id, col_no)) GROUP BY group_id) g USING (group_id)
  JOIN (SELECT group_id, median(width) AS mw FROM anchor_cells GROUP BY group_id) m USING (group_id))
WINDOW w AS (PARTITION BY group_id ORDER BY centre, col_no)""", "anchor_cells")


@query("tbl11_column_anchors", oracle(f"""
SELECT group_id, anchor, {rnd('centre', 6)} AS centre, {rnd('lo', 6)} AS lo, {rnd('hi', 6)} AS hi FROM anchors""", "anchors"))
def column_anchors(spark: SparkSession, sf: str) -> DataFrame:
    anchors = tables.column_anchors(_anchor_cells(spark, sf))
    return anchors.selectExpr(
        "group_id", "anchor", rnd_sql("centre", 6) + " AS centre", rnd_sql("`left`", 6) + " AS lo", rnd_sql("`right`", 6) + " AS hi"
    )


@query("join16_column_spans", oracle("""
WITH c AS (SELECT b.group_id, b.box_id, min(anchor) FILTER (cov) AS c0, max(anchor) FILTER (cov) AS c1, count(*) FILTER (cov) AS nc,
   min(anchor) FILTER (ins) AS i0, arg_min(anchor, (dist, anchor)) AS near
  FROM (SELECT b.group_id, b.box_id, a.anchor, b.x <= a.centre + 4 AND b.x + b.width >= a.centre - 4 AS cov,
      b.x + b.width / 2 BETWEEN a.lo - 4 AND a.hi + 4 AS ins, abs((b.x + b.width / 2) - a.centre) AS dist
    FROM anchor_cells b JOIN anchors a USING (group_id)) b GROUP BY ALL)
SELECT group_id, box_id, CASE WHEN nc > 1 THEN c0 WHEN i0 IS NOT NULL THEN i0 ELSE near END AS start_col, CASE WHEN nc > 1 THEN c1 - c0 + 1 ELSE 1 END AS span FROM c""", "anchor_cells", "anchors"))
def column_spans(spark: SparkSession, sf: str) -> DataFrame:
    cells = _anchor_cells(spark, sf)
    return tables.column_spans(cells, tables.column_anchors(cells), 4.0).select("group_id", "box_id", "start_col", "span")


@query("tbl12_axis_boundaries", oracle("""
WITH k AS (SELECT group_id, box_id % 4 AS i, (median(x) + median(x + width)) / 2 AS centre, greatest(1.0::DOUBLE, median(x + width) - median(x)) AS wide
   FROM anchor_cells WHERE col_span = 1 GROUP BY ALL),
g AS (SELECT group_id, median(wide) AS mw, median(gap) AS mg FROM (SELECT *, centre - lag(centre) OVER (PARTITION BY group_id ORDER BY i) AS gap FROM k) GROUP BY group_id),
d AS (SELECT g.group_id, t.i, mw, mg, (SELECT max(k.i) FROM k WHERE k.group_id = g.group_id AND k.i <= t.i) AS bi, (SELECT min(k.i) FROM k WHERE k.group_id = g.group_id AND k.i >= t.i) AS ai
  FROM g, unnest(range(0, 4)) AS t(i)),
c AS (SELECT d.*, b.centre AS bc, a.centre AS ac FROM d LEFT JOIN k b ON b.group_id = d.group_id AND b.i = d.bi LEFT JOIN k a ON a.group_id = d.group_id AND a.i = d.ai),
f AS (SELECT group_id, i, CASE WHEN bi IS NULL THEN ac - coalesce(mg, mw, 40) * (ai - i) WHEN ai IS NULL THEN bc + coalesce(mg, mw, 40) * (i - bi) WHEN bi = i THEN bc
    ELSE bc + (ac - bc) / (ai - bi) * (i - bi) END AS centre FROM c),
l AS (SELECT group_id, list(centre ORDER BY i) AS m FROM f GROUP BY group_id),
e AS (SELECT group_id, [m[1] - (m[2] - m[1]) / 2, (m[1] + m[2]) / 2, (m[2] + m[3]) / 2, (m[3] + m[4]) / 2, m[4] + (m[4] - m[3]) / 2] AS b FROM l)
SELECT group_id, array_to_string(list_transform(b, lambda v: CAST(CAST(floor(v * 1000 + 0.5) AS BIGINT) AS VARCHAR)), ',') AS bounds FROM e""", "anchor_cells"))
def axis_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    cells = _anchor_cells(spark, sf)
    count = cells.select("group_id").distinct().withColumn("n", F.lit(4))
    return _bounds_text(tables.axis_boundaries(cells, "col_no", "col_span", "x", "width", count))


# Cells of a table: a header row, then one row per line item.
sql("cells", """
SELECT o_orderkey AS table_id, 0 AS row_no, 0 AS col_no, 'item' AS text, 1 AS row_span, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS col_span, false AS hidden FROM orders
UNION ALL SELECT o_orderkey, 0, 1, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'status' END, 1, 1, o_orderkey % 5 = 0 FROM orders
UNION ALL SELECT o_orderkey, 0, 2, 'qty', 1, 1, false FROM orders
UNION ALL SELECT l_orderkey, l_linenumber, 0, min(l_returnflag), 1, 1, false FROM lineitem GROUP BY l_orderkey, l_linenumber
UNION ALL SELECT l_orderkey, l_linenumber, 1, min(l_linestatus), 1, 1, false FROM lineitem GROUP BY l_orderkey, l_linenumber
UNION ALL SELECT l_orderkey, l_linenumber, 2, CASE WHEN min(l_suppkey) % 3 = 0 THEN '' ELSE CAST(CAST(min(l_quantity) AS INT) AS VARCHAR) END, 1, 1, false
FROM lineitem GROUP BY l_orderkey, l_linenumber""")

CELL = "array<struct<row_no:int,col_no:int,text:string,row_span:int,col_span:int,hidden:boolean>>"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """One pass over each table: every source row becomes its three cells at once."""
    head = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS table_id",
        f"""inline(cast(array(
            struct(0, 0, 'item', 1, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END, false),
            struct(0, 1, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'status' END, 1, 1, o_orderkey % 5 = 0),
            struct(0, 2, 'qty', 1, 1, false)) AS {CELL}))""",
    )
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.ascii("l_returnflag")).alias("flag"), F.min(F.ascii("l_linestatus")).alias("status"),
        F.min("l_suppkey").alias("supp"), F.min("l_quantity").alias("qty"),
    )
    body = lines.selectExpr(
        "l_orderkey AS table_id",
        f"""inline(cast(array(struct(l_linenumber, 0, chr(flag), 1, 1, false), struct(l_linenumber, 1, chr(status), 1, 1, false),
            struct(l_linenumber, 2, CASE WHEN supp % 3 = 0 THEN '' ELSE cast(cast(qty AS int) AS string) END, 1, 1, false)) AS {CELL}))""",
    )
    return head.unionByName(body)


QUALITY_SQL = f"""
shape AS (SELECT table_id, max(row_no + row_span) AS row_count, max(col_no + col_span) AS column_count, count(*) FILTER (NOT hidden) AS visible,
   count(*) FILTER (NOT hidden AND (row_span > 1 OR col_span > 1)) AS merged FROM cells GROUP BY table_id),
filled AS (SELECT table_id, row_no, count(*) AS n FROM cells WHERE NOT hidden AND trim(text) <> '' GROUP BY ALL),
rs AS (SELECT table_id, sum(n) AS f, count(*) AS u, sum(n * n) AS sq, count(*) FILTER (n / column_count < 0.35) AS sp FROM filled JOIN shape USING (table_id) GROUP BY ALL),
q AS (SELECT s.*, coalesce(f, 0) AS f, coalesce(u, 0) AS u, coalesce(f, 0) / (row_count * column_count) AS fill, coalesce(u, 0) / row_count AS used, coalesce(sp, 0) / row_count AS spr,
   CASE WHEN coalesce(u, 0) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - sqrt((u * sq - f * f) / (u * u)) / column_count) END AS cons,
   coalesce(merged / nullif(visible, 0), 0.0::DOUBLE) AS mr, row_count >= 2 AND column_count >= 2 AND coalesce(u, 0) >= 2 AS ok FROM shape s LEFT JOIN rs USING (table_id)),
quality AS (SELECT table_id, row_count, column_count, CAST(f AS BIGINT) AS non_empty_cell_count, visible > 0 AS has_structured_cells, ok AS usable_shape,
  {rnd('fill', 4)} AS fill_ratio, {rnd('used', 4)} AS non_empty_row_ratio, {rnd('cons', 4)} AS column_consistency, {rnd('spr', 4)} AS sparse_row_ratio, {rnd('mr', 4)} AS merged_cell_ratio,
  {rnd(clamp('''(CASE WHEN row_count >= 2 AND column_count >= 2 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END * 0.30::DOUBLE + fill * 0.24::DOUBLE + used * 0.16::DOUBLE + cons * 0.18::DOUBLE
     + (1.0::DOUBLE - spr) * 0.08::DOUBLE + CASE WHEN visible > 0 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END
     + CASE WHEN mr > 0 AND mr <= 0.35 THEN 0.04::DOUBLE WHEN mr > 0.65 THEN -0.04::DOUBLE ELSE 0.0::DOUBLE END) * CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END'''), 4)} AS structure_score,
  list_filter([CASE WHEN NOT ok THEN 'unusable_shape' END, CASE WHEN column_count < 2 THEN 'too_few_columns' END, CASE WHEN fill < 0.20 THEN 'low_fill_ratio' END,
    CASE WHEN cons < 0.45 THEN 'low_column_consistency' END, CASE WHEN spr > 0.70 THEN 'too_many_sparse_rows' END], lambda p: p IS NOT NULL) AS penalties FROM q)"""


@query("agg10_table_quality", oracle(f"""WITH {QUALITY_SQL}
SELECT * REPLACE (array_to_string(penalties, ',') AS penalties) FROM quality""", "cells"))
def table_quality(spark: SparkSession, sf: str) -> DataFrame:
    quality = tables.table_quality(cells(spark, sf))
    return quality.withColumn("penalties", F.array_join("penalties", ","))


# Raw readings: some percentages, some negative, some unreadable, some without text.
sql("raw_readings", """
SELECT group_id AS table_id, box_id, CASE WHEN box_id % 6 = 0 THEN ' ' ELSE text END AS text,
  CASE box_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(CAST(confidence * 100 AS INTEGER) AS VARCHAR) WHEN 2 THEN '-1' ELSE CAST(confidence AS VARCHAR) END AS confidence FROM boxes""", "boxes")


def raw_readings(spark: SparkSession, sf: str) -> DataFrame:
    return boxes(spark, sf).selectExpr(
        "group_id AS table_id", "box_id", "CASE WHEN box_id % 6 = 0 THEN ' ' ELSE text END AS text",
        "CASE box_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN cast(cast(round(confidence * 100) AS int) AS string) WHEN 2 THEN '-1' ELSE cast(confidence AS string) END AS confidence",
    )


READING_SQL = f"""
rv AS (SELECT table_id, CASE WHEN v > 1 THEN least(1.0::DOUBLE, v / 100) ELSE v END AS v FROM (SELECT table_id, TRY_CAST(confidence AS DOUBLE) AS v FROM raw_readings WHERE trim(text) <> '') WHERE v >= 0),
reading AS (SELECT table_id, {rnd('sum(CAST(floor(v * 1000000 + 0.5) AS BIGINT)) / 1000000.0::DOUBLE / count(*)', 4)} AS average, {rnd('min(v)', 4)} AS minimum,
   count(*) AS recognized_count, count(*) FILTER (v < 0.65) AS low_confidence_count FROM rv GROUP BY table_id)"""


@query("agg09_reading_confidence", oracle(f"WITH {READING_SQL} SELECT * FROM reading", "raw_readings"))
def reading_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return tables.reading_confidence(raw_readings(spark, sf), "table_id")


SCORED_SQL = f"""{QUALITY_SQL}, {READING_SQL},
cand AS (SELECT *, {rnd(clamp('CASE WHEN recognized_count > 0 THEN structure_score * 0.65::DOUBLE + average * 0.35::DOUBLE ELSE structure_score * 0.85::DOUBLE END'), 4)} AS final_confidence
  FROM quality LEFT JOIN reading USING (table_id)),
scored AS (SELECT *, NOT usable_shape OR row_count <= 0 OR column_count < 2 OR final_confidence < 0.72 OR fill_ratio < 0.20 OR column_consistency < 0.45 OR sparse_row_ratio > 0.70 AS try_fallback FROM cand)"""


@query("sc09_candidate_confidence", oracle(f"WITH {SCORED_SQL} SELECT table_id, final_confidence, try_fallback FROM scored", "cells", "raw_readings"))
def candidate_confidence(spark: SparkSession, sf: str) -> DataFrame:
    quality = tables.table_quality(cells(spark, sf))
    scored = tables.candidate_confidence(quality, tables.reading_confidence(raw_readings(spark, sf), "table_id"))
    return scored.select("table_id", "final_confidence", "try_fallback")


SEMI = """table_id % 5 AS line_verticals, table_id % 6 AS hard_columns, table_id % 7 AS logical_columns, table_id % 9 AS detected_boxes,
  table_id % 4 AS recognized_cells, table_id % 3 AS violations, CAST(table_id % 11 AS DOUBLE) / 10 AS row_overlap, CAST(table_id % 8 AS DOUBLE) / 8 AS col_overlap,
  CAST(table_id % 10 AS DOUBLE) / 10 AS empty_column_ratio"""


@query("sc10_reliability", oracle(f"""WITH {SCORED_SQL}, semis AS (SELECT *, {SEMI} FROM scored),
r AS (SELECT table_id, list_filter([{", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in cascade.RELIABILITY.items())}], lambda p: p IS NOT NULL) AS reasons FROM semis)
SELECT table_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM r""", "cells", "raw_readings"))
def semi_reliability(spark: SparkSession, sf: str) -> DataFrame:
    quality = tables.table_quality(cells(spark, sf))
    scored = tables.candidate_confidence(quality, tables.reading_confidence(raw_readings(spark, sf), "table_id"))
    semi = scored.selectExpr("*", *[part.strip() for part in SEMI.split(",")])
    return cascade.reliability(semi).select("table_id", F.array_join("reasons", ",").alias("reasons"), "passed")


sql("methods", """
SELECT o_orderkey % (SELECT count(*) // 3 FROM orders) AS table_id, CASE (o_orderkey // (SELECT count(*) // 3 FROM orders)) WHEN 0 THEN 'slanext' WHEN 1 THEN 'borderless_text_clustering'
   WHEN 2 THEN 'semi_structured_regions' ELSE 'raw_ocr_geometry' END AS method, CAST(50 + (o_orderkey * 37) % 23 AS DOUBLE) / 100 AS final_confidence, o_orderkey % 3 <> 0 AS usable_shape,
  o_orderkey % 2 = 0 AS has_structured_cells, 1 + o_orderkey % 4 AS column_count, o_orderkey % 17 AS non_empty_cell_count FROM orders""")


def methods(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    third = orders.agg(F.expr("cast(floor(count(*) / 3) AS bigint)").alias("third"))
    return orders.crossJoin(F.broadcast(third)).selectExpr(
        "o_orderkey % third AS table_id", "CASE o_orderkey div third WHEN 0 THEN 'slanext' WHEN 1 THEN 'borderless_text_clustering' WHEN 2 THEN 'semi_structured_regions' ELSE 'raw_ocr_geometry' END AS method",
        "cast(50 + (o_orderkey * 37) % 23 AS double) / 100 AS final_confidence", "o_orderkey % 3 <> 0 AS usable_shape",
        "o_orderkey % 2 = 0 AS has_structured_cells", "1 + o_orderkey % 4 AS column_count", "o_orderkey % 17 AS non_empty_cell_count",
    )


@query("top04_best_candidate", oracle("""
WITH r AS (SELECT *, row_number() OVER w AS nth, lead(final_confidence) OVER w AS runner, lead(method) OVER w AS rm, count(*) OVER (PARTITION BY table_id) AS n FROM methods
   WINDOW w AS (PARTITION BY table_id ORDER BY final_confidence DESC, method)),
g AS (SELECT *, max(CASE WHEN nth = 1 THEN final_confidence - runner END) OVER (PARTITION BY table_id) AS gap, row_number() OVER (PARTITION BY table_id ORDER BY usable_shape DESC, has_structured_cells DESC,
   column_count > 1 DESC, non_empty_cell_count DESC, method = 'slanext' DESC, final_confidence DESC, method) AS tied FROM r)
SELECT table_id, method, final_confidence, n AS n_candidates, CASE WHEN n = 1 THEN 'only_valid_candidate' WHEN gap > 0.03 AND method = 'borderless_text_clustering' AND rm = 'slanext' THEN 'borderless_improved_low_quality_slanext'
   WHEN gap > 0.03 THEN 'higher_final_confidence' WHEN method = 'slanext' AND has_structured_cells THEN 'tie_preferred_structured_slanext' ELSE 'tie_breaker' END AS reason
FROM g WHERE CASE WHEN n = 1 OR gap > 0.03 THEN nth = 1 ELSE tied = 1 END""", "methods"))
def best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return tables.select_candidate(methods(spark, sf))


@query("win17_tail_summary", oracle("""
WITH s AS (SELECT table_id, max(row_no + row_span) AS rc, max(col_no + col_span) AS cc FROM cells GROUP BY table_id),
a AS (SELECT s.table_id, rc, cc, t.r, count(*) FILTER (c.row_no IS NOT NULL AND trim(c.text) <> '') AS n, coalesce(bool_or(c.row_span > 1 OR c.col_span > 1), false) AS sp
  FROM s, unnest(range(1, rc)) AS t(r) LEFT JOIN cells c ON c.table_id = s.table_id AND c.row_no = t.r AND NOT c.hidden GROUP BY ALL),
b AS (SELECT *, bool_and((cc >= 3 AND n > 0 AND n <= greatest(1, floor(cc * 0.45))) OR sp) OVER (PARTITION BY table_id ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS tail FROM a)
SELECT s.table_id, rc AS row_count, cc AS col_count, CAST(coalesce(min(r) FILTER (tail), rc) AS INTEGER) AS summary_start FROM s LEFT JOIN (SELECT table_id, r, tail FROM b) b USING (table_id) GROUP BY s.table_id, rc, cc""", "cells"))
def tail_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tables.tail_summary_start(cells(spark, sf))


sql("owned", """
SELECT group_id, box_id AS row_no, 0 AS col_no, CASE WHEN box_id % 5 = 0 THEN '' ELSE text END AS text, x, y, width + group_id % 13 AS width, height + (group_id % 7) * 6 AS height FROM boxes""", "boxes")


@query("agg11_assignment_quality", oracle(f"""
WITH p AS (SELECT a.group_id, a.row_no, b.row_no AS o_row, {common_px('a', 'b')} / greatest(1.0::DOUBLE, a.width * a.height) AS share, a.row_no = b.row_no AS same
  FROM owned a JOIN owned b ON a.group_id = b.group_id AND trim(a.text) <> '' AND {common_px('a', 'b')} > 0),
r AS (SELECT *, row_number() OVER w AS nth, coalesce(lead(share) OVER w, 0.0::DOUBLE) AS second FROM p WINDOW w AS (PARTITION BY group_id, row_no ORDER BY share DESC, o_row)),
f AS (SELECT group_id, count(*) AS assigned, count(*) FILTER (second > 0.18 OR NOT same) AS crossing,
   CAST(sum(CAST(floor(CASE WHEN same THEN share ELSE share * 0.75::DOUBLE END * 1000000 + 0.5) AS BIGINT)) AS BIGINT) AS total FROM r WHERE nth = 1 AND share >= 0.2 GROUP BY group_id),
t AS (SELECT group_id, count(*) FILTER (trim(text) <> '') AS texts FROM owned GROUP BY group_id),
j AS (SELECT t.group_id, texts, coalesce(assigned, 0) AS assigned, coalesce(crossing, 0) AS crossing, coalesce(total, 0) AS total FROM t LEFT JOIN f USING (group_id))
SELECT group_id, texts, assigned, {rnd('coalesce(assigned / nullif(texts, 0), 0.0::DOUBLE)', 4)} AS text_coverage, {rnd('coalesce(crossing / nullif(assigned, 0), 0.0::DOUBLE)', 4)} AS cross_boundary_ratio,
  {rnd('coalesce(total / 1000000.0::DOUBLE / nullif(assigned, 0), 0.0::DOUBLE)', 4)} AS assignment_consistency,
  coalesce(texts > 0 AND assigned / texts >= 0.82 AND coalesce(crossing / nullif(assigned, 0), 0.0) <= 0.32 AND coalesce(total / 1000000.0::DOUBLE / nullif(assigned, 0), 0.0) >= 0.58, false) AS passed FROM j""", "owned"))
def assignment_quality(spark: SparkSession, sf: str) -> DataFrame:
    owned = boxes(spark, sf).selectExpr(
        "group_id", "box_id AS row_no", "0 AS col_no", "CASE WHEN box_id % 5 = 0 THEN '' ELSE text END AS text", "x", "y",
        "width + group_id % 13 AS width", "height + (group_id % 7) * 6 AS height",
    )
    return tables.assignment_quality(owned).withColumn("passed", F.coalesce("passed", F.lit(False)))


@query("tbl15_grid_boxes", oracle("""
WITH s AS (SELECT table_id, max(row_no + row_span) AS rc, max(col_no + col_span) AS cc FROM cells GROUP BY table_id)
SELECT c.table_id, c.row_no, c.col_no, floor(850 * c.col_no / cc + 0.5) AS x, floor(1100 * c.row_no / rc + 0.5) AS y,
  greatest(1.0, floor(850 * (c.col_no + 1) / cc + 0.5) - floor(850 * c.col_no / cc + 0.5)) AS width, greatest(1.0, floor(1100 * (c.row_no + 1) / rc + 0.5) - floor(1100 * c.row_no / rc + 0.5)) AS height
FROM cells c JOIN s USING (table_id)""", "cells"))
def grid_boxes(spark: SparkSession, sf: str) -> DataFrame:
    source = cells(spark, sf)
    shape = source.groupBy("table_id").agg(F.expr("max(row_no + row_span)").alias("rc"), F.expr("max(col_no + col_span)").alias("cc"))
    left, right = "floor(850 * col_no / cc + 0.5D)", "floor(850 * (col_no + 1) / cc + 0.5D)"
    top, bottom = "floor(1100 * row_no / rc + 0.5D)", "floor(1100 * (row_no + 1) / rc + 0.5D)"
    return source.join(shape, "table_id").selectExpr(
        "table_id", "row_no", "col_no", f"cast({left} AS double) AS x", f"cast({top} AS double) AS y",
        f"cast(greatest(1, {right} - {left}) AS double) AS width", f"cast(greatest(1, {bottom} - {top}) AS double) AS height",
    )


@query("set02_stacked_regions", oracle("""
WITH h AS (SELECT o.o_custkey AS doc_id, o.o_orderkey AS region_id, coalesce(max(l_linenumber), 0) + 1 AS rows FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL),
s AS (SELECT *, coalesce(sum(rows) OVER (PARTITION BY doc_id ORDER BY region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, count(*) OVER (PARTITION BY doc_id) AS headers FROM h)
SELECT s.doc_id, s.region_id, CAST(c.row_no + off AS BIGINT) AS row_no, c.col_no, c.text, headers FROM s JOIN cells c ON c.table_id = s.region_id WHERE NOT c.hidden""", "cells"))
def stacked_regions(spark: SparkSession, sf: str) -> DataFrame:
    from folioframe.operators.ordering import running_total

    source = cells(spark, sf)
    heights = source.groupBy("table_id").agg(F.expr("cast(max(row_no + row_span) AS bigint)").alias("rows"))
    docs = table(spark, sf, "orders").selectExpr("o_custkey AS doc_id", "o_orderkey AS table_id").join(heights, "table_id")
    upto = running_total(docs, ["doc_id"], ["table_id"], 100_000.0, "rows", "upto")
    headers = docs.groupBy("doc_id").agg(F.count("*").alias("headers"))
    shifted = upto.join(headers, "doc_id").join(source.filter("NOT hidden"), "table_id")
    return shifted.selectExpr("doc_id", "table_id AS region_id", "row_no + upto - rows AS row_no", "col_no", "text", "headers")


# Texts of one letter, per-cell readings among them whose boxes reach over their neighbours in half of the groups.
sql("assigned", """
SELECT group_id, box_id, concat(' ', substr(text, 1, 1), CASE WHEN box_id % 4 = 1 THEN ' ' ELSE '' END) AS text, CASE WHEN box_id % 3 = 0 OR (group_id % 5 = 0 AND box_id % 3 = 1) THEN 'per_cell_ocr' ELSE 'detection' END AS source,
  CAST(floor(y / 80.0) AS INTEGER) AS row_no, CAST(floor(x / 100.0) AS INTEGER) AS col_no, CASE WHEN box_id % 3 = 0 AND group_id % 2 = 0 THEN x - 130 ELSE x END AS x,
  CASE WHEN box_id % 3 = 0 AND group_id % 2 = 0 THEN y - 44 ELSE y END AS y, CASE WHEN box_id % 3 = 0 AND group_id % 2 = 0 THEN width + 260 ELSE width END AS width,
  CASE WHEN box_id % 3 = 0 AND group_id % 2 = 0 THEN height + 88 ELSE height END AS height FROM boxes""", "boxes")


def assigned_cells(spark: SparkSession, sf: str) -> DataFrame:
    wide = "box_id % 3 = 0 AND group_id % 2 = 0"
    return boxes(spark, sf).selectExpr(
        "group_id", "box_id", "concat(' ', left(text, 1), CASE WHEN box_id % 4 = 1 THEN ' ' ELSE '' END) AS text",
        "CASE WHEN box_id % 3 = 0 OR (group_id % 5 = 0 AND box_id % 3 = 1) THEN 'per_cell_ocr' ELSE 'detection' END AS source", "cast(floor(y / 80D) AS int) AS row_no", "cast(floor(x / 100D) AS int) AS col_no",
        f"CASE WHEN {wide} THEN x - 130 ELSE x END AS x", f"CASE WHEN {wide} THEN y - 44 ELSE y END AS y",
        f"CASE WHEN {wide} THEN width + 260 ELSE width END AS width", f"CASE WHEN {wide} THEN height + 88 ELSE height END AS height",
    )


HELD_SQL = "({inner}.x >= {outer}.x - 2 AND {inner}.y >= {outer}.y - 2 AND {inner}.x + {inner}.width <= {outer}.x + {outer}.width + 2 AND {inner}.y + {inner}.height <= {outer}.y + {outer}.height + 2)"


# The twin walks each group's cells one after the other.
@query("set04_deduplicated_cells", oracle(f"""
WITH g AS (SELECT group_id, list({{'id': box_id, 't': trim(text), 'p': source = 'per_cell_ocr', 'r': row_no, 'c': col_no, 'x': x, 'y': y, 'width': width, 'height': height}}
   ORDER BY source = 'per_cell_ocr' DESC, row_no, col_no, y, x, box_id) AS cells FROM assigned WHERE trim(text) <> '' GROUP BY group_id),
k AS (SELECT group_id, list_reduce(list_transform(cells, lambda x: [x]), lambda kept, more: CASE WHEN len(list_filter(kept, lambda e: e.t = more[1].t AND ((e.r = more[1].r AND e.c = more[1].c)
   OR (more[1].p AND {HELD_SQL.format(inner='e', outer='more[1]')}) OR (e.p AND {HELD_SQL.format(inner='more[1]', outer='e')})))) > 0 THEN kept ELSE kept || more END) AS kept FROM g),
u AS (SELECT group_id, unnest(kept).id AS box_id FROM k)
SELECT group_id, row_no, col_no, text, box_id, source FROM assigned JOIN u USING (group_id, box_id)""", "assigned"))
def deduplicated_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Readings at one place or inside a per-cell reading of the same text, once each."""
    return dedupe.deduplicate_cells(assigned_cells(spark, sf)).select("group_id", "row_no", "col_no", "text", "box_id", "source")
