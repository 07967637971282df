"""Tables in and out: HTML, Markdown, records, summaries, documents, text clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import text as txt
from folioframe.operators import grids
from folioframe.plans.derive import oracle, sql, table
from folioframe.plans.registry import query
from folioframe.plans.tables import CELL, cells
from folioframe.session import cut_lineage
from folioframe.sources import export, html

# Wide tables: a two-row header where the second row only names the spanned columns, then line items;
# lines from the sixth on carry a label and a value only.
sql("wide", """
SELECT o_orderkey AS table_id, 0 AS row_no, u.c AS col_no, CASE u.c WHEN 0 THEN 'item' WHEN 1 THEN 'amount' WHEN 2 THEN '' WHEN 3 THEN 'note' ELSE '' END AS text, 1 AS row_span,
   CASE WHEN u.c = 1 THEN 2 ELSE 1 END AS col_span, u.c = 2 AS hidden FROM orders, unnest(range(0, 5)) AS u(c)
UNION ALL SELECT o_orderkey, 1, u.c, CASE WHEN u.c = 1 THEN 'net' WHEN u.c = 2 THEN 'gross' WHEN o_orderkey % 2 = 0 THEN '' ELSE 'x' || u.c END, 1, 1, false FROM orders, unnest(range(0, 5)) AS u(c)
UNION ALL SELECT l_orderkey, l_linenumber + 1, u.c, CASE WHEN l_linenumber >= 6 AND u.c < 3 THEN '-' WHEN l_linenumber >= 6 AND u.c = 3 THEN 'total ' || l_linenumber
   WHEN min(l_suppkey) % 7 = 0 AND u.c = 2 THEN '..' ELSE CAST((min(l_partkey) + u.c) AS VARCHAR) END, 1, CASE WHEN l_linenumber = 7 AND u.c = 3 THEN 2 ELSE 1 END, l_linenumber = 7 AND u.c = 4
  FROM lineitem, unnest(range(0, 5)) AS u(c) GROUP BY l_orderkey, l_linenumber, u.c""")


def wide(spark: SparkSession, sf: str) -> DataFrame:
    head = table(spark, sf, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).selectExpr("*", "cast(i div 5 AS int) AS r", "cast(i % 5 AS int) AS c").selectExpr(
        "o_orderkey AS table_id", "r AS row_no", "c AS col_no",
        "CASE WHEN r = 0 THEN CASE c WHEN 0 THEN 'item' WHEN 1 THEN 'amount' WHEN 3 THEN 'note' ELSE '' END"
        " WHEN c = 1 THEN 'net' WHEN c = 2 THEN 'gross' WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('x', c) END AS text",
        "1 AS row_span", "CASE WHEN r = 0 AND c = 1 THEN 2 ELSE 1 END AS col_span", "r = 0 AND c = 2 AS hidden",
    )
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    body = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c")).selectExpr(
        "l_orderkey AS table_id", "l_linenumber + 1 AS row_no", "c AS col_no",
        "CASE WHEN l_linenumber >= 6 AND c < 3 THEN '-' WHEN l_linenumber >= 6 AND c = 3 THEN concat('total ', l_linenumber)"
        " WHEN supp % 7 = 0 AND c = 2 THEN '..' ELSE cast(part + c AS string) END AS text",
        "1 AS row_span", "CASE WHEN l_linenumber = 7 AND c = 3 THEN 2 ELSE 1 END AS col_span", "l_linenumber = 7 AND c = 4 AS hidden",
    )
    return head.unionByName(body)


def _grid(source: str) -> str:
    """shape: size of each table; grid: a text for every slot."""
    return f"""
shape AS (SELECT table_id, max(row_no + row_span) AS rc, max(col_no + col_span) AS cc FROM {source} GROUP BY table_id),
grid AS (SELECT s.table_id, rc, cc, r.r AS row_no, k.c AS col_no, coalesce(v.text, '') AS text FROM shape s, unnest(range(0, rc)) AS r(r), unnest(range(0, cc)) AS k(c)
  LEFT JOIN {source} v ON v.table_id = s.table_id AND v.row_no = r.r AND v.col_no = k.c AND NOT v.hidden)"""


# Corrections, empty ones among them, and cells whose text only the recogniser has.
sql("corrected", """
SELECT * REPLACE (CASE WHEN table_id % 5 = 1 AND row_no > 0 AND col_no = 0 THEN '' ELSE text END AS text), CASE WHEN row_no <= 1 THEN NULL WHEN table_id % 5 = 1 THEN 'ocr ' || row_no ELSE 'other' END AS ocr_text,
  CASE WHEN row_no > 1 AND table_id % 4 = 0 AND col_no = 1 THEN 'fixed ' || row_no WHEN row_no > 1 AND table_id % 4 = 2 AND col_no = 0 THEN '' END AS ground_truth FROM wide""", "wide")
sql("as_read", "SELECT * REPLACE (coalesce(ground_truth, nullif(text, ''), ocr_text, '') AS text) FROM corrected", "corrected")


def corrected(spark: SparkSession, sf: str) -> DataFrame:
    return wide(spark, sf).selectExpr(
        "table_id", "row_no", "col_no", "CASE WHEN table_id % 5 = 1 AND row_no > 0 AND col_no = 0 THEN '' ELSE text END AS text", "row_span", "col_span", "hidden",
        "CASE WHEN row_no <= 1 THEN NULL WHEN table_id % 5 = 1 THEN concat('ocr ', row_no) ELSE 'other' END AS ocr_text",
        "CASE WHEN row_no > 1 AND table_id % 4 = 0 AND col_no = 1 THEN concat('fixed ', row_no) WHEN row_no > 1 AND table_id % 4 = 2 AND col_no = 0 THEN '' END AS ground_truth",
    )


@query("tbl02_grid_rows", oracle(f"WITH {_grid('as_read')} SELECT table_id, row_no, string_agg(text, '¦' ORDER BY col_no) AS texts FROM grid GROUP BY ALL", "as_read"))
def grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of every table, blank ones included, as corrected by the user."""
    return grids.grid_rows(corrected(spark, sf)).select("table_id", "row_no", F.array_join("texts", "¦").alias("texts"))


@query("tbl02_cells_from_rows", oracle(f"WITH {_grid('as_read')} SELECT table_id, row_no, col_no, text FROM grid", "as_read"))
def cells_from_rows(spark: SparkSession, sf: str) -> DataFrame:
    return grids.cells_from_rows(grids.grid_rows(corrected(spark, sf))).select("table_id", "row_no", "col_no", "text")


def _markdown(source: str, blank: str = "text") -> str:
    return f"""
lined AS (SELECT table_id, row_no, any_value(cc) AS cc, '| ' || string_agg(replace({blank}, '|', '/'), ' | ' ORDER BY col_no) || ' |' AS line FROM grid GROUP BY ALL),
md AS (SELECT table_id, max(line) FILTER (row_no = 0) || chr(10) || '| ' || array_to_string(list_transform(range(0, any_value(cc)), lambda i: '---'), ' | ') || ' |'
   || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY row_no) FILTER (row_no > 0), '') AS markdown FROM lined GROUP BY table_id)"""


@query("snk03_markdown", oracle(f"WITH {_grid('wide')}, {_markdown('wide', 'trim(text)')} SELECT table_id, markdown FROM md", "wide"))
def markdown(spark: SparkSession, sf: str) -> DataFrame:
    return export.markdown_tables(wide(spark, sf))


@query("snk03_markdown_client", oracle(f"""WITH {_grid('wide')}, {_markdown('wide', "CASE WHEN row_no = 0 AND text = '' THEN 'Column ' || (col_no + 1) ELSE text END")} SELECT table_id, markdown FROM md""", "wide"))
def markdown_client(spark: SparkSession, sf: str) -> DataFrame:
    return export.markdown_tables(wide(spark, sf), number_blank_headers=True)


@query("txt04_parsed_tables", oracle(f"WITH {_grid('cells')}" + """
, present AS (SELECT DISTINCT table_id, row_no, dense_rank() OVER (PARTITION BY table_id ORDER BY row_no) - 1 AS place FROM cells WHERE NOT hidden)
SELECT table_id, CASE WHEN table_id % 3 = 0 THEN row_no ELSE place END AS row_no, string_agg(text, '¦' ORDER BY col_no) AS texts FROM grid LEFT JOIN present USING (table_id, row_no)
WHERE (table_id % 3 = 0 AND rc >= 2) OR (table_id % 3 <> 0 AND place IS NOT NULL) GROUP BY ALL
UNION ALL SELECT table_id, -1, '0¦1¦2' FROM shape WHERE table_id % 3 = 2""", "cells"))
def parsed_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables written as Markdown, JSON rows or JSON objects and read back."""
    source = cells(spark, sf)
    marked = export.markdown_tables(source.filter("table_id % 3 = 0"))
    rows = grids.grid_rows(source.filter("table_id % 3 <> 0"), blank_rows=False).groupBy("table_id").agg(
        F.expr("transform(array_sort(collect_list(struct(row_no, texts))), r -> r.texts)").alias("rows")
    )
    as_json = rows.selectExpr(
        "table_id",
        "CASE WHEN table_id % 3 = 1 THEN to_json(rows) ELSE to_json(transform(rows, r -> map_from_entries(transform(r, (t, i) -> struct(cast(i AS string), t))))) END AS body",
    )
    texts = marked.withColumnRenamed("markdown", "body").unionByName(as_json)
    parsed = export.parse_tables(texts, "body").selectExpr("table_id", "posexplode(rows) AS (row_no, texts)")
    return parsed.selectExpr(
        "table_id", "cast(CASE WHEN table_id % 3 = 2 THEN row_no - 1 ELSE row_no END AS bigint) AS row_no", "array_join(texts, '¦') AS texts"
    )


@query("txt05_padded_rows", oracle("""
WITH l AS (SELECT l_orderkey AS table_id, l_linenumber AS row_no, min(l_partkey) % 4 AS n FROM lineitem GROUP BY ALL), m AS (SELECT table_id, max(n) AS w FROM l GROUP BY table_id)
SELECT table_id, row_no, array_to_string(list_concat(list_transform(range(0, n), lambda i: 'c' || i), list_transform(range(n, w), lambda i: '')), '¦') AS texts, n = 0 AS empty FROM l JOIN m USING (table_id)"""))
def padded_rows(spark: SparkSession, sf: str) -> DataFrame:
    ragged = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row_no")).agg(
        F.expr("cast(min(l_partkey) % 4 AS int)").alias("n")
    ).selectExpr("table_id", "row_no", "transform(filter(sequence(0, 3), i -> i < n), i -> concat(' c', i, ' ')) AS texts")
    return pad_rows(ragged).selectExpr(
        "table_id", "row_no", "array_join(texts, '¦') AS texts", "NOT exists(texts, t -> t <> '') AS empty"
    )


def pad_rows(rows: DataFrame) -> DataFrame:
    """Trim every text and fill short rows up to the widest row of their table."""
    widest = rows.groupBy("table_id").agg(F.max(F.size("texts")).alias("w"))
    return rows.join(widest, "table_id").selectExpr(
        "table_id", "row_no", "concat(transform(texts, t -> trim(t)), array_repeat('', w - size(texts))) AS texts"
    )


@query("win18_header_depth", oracle("""
WITH shape AS (SELECT table_id, max(row_no + row_span) AS rc, max(col_no + col_span) AS cc FROM wide GROUP BY table_id),
k AS (SELECT p.table_id, p.row_no, count(*) FILTER (c.col_no >= p.col_no AND c.col_no < p.col_no + p.col_span) AS child, count(*) FILTER (c.col_no < p.col_no OR c.col_no >= p.col_no + p.col_span) AS outside
  FROM wide p JOIN wide c ON c.table_id = p.table_id AND c.row_no = p.row_no + 1 AND NOT c.hidden AND regexp_matches(c.text, '[A-Za-z0-9ก-๙]')
  WHERE NOT p.hidden AND p.col_span > 1 AND p.row_no = 0 GROUP BY ALL)
SELECT s.table_id, rc AS row_count, cc AS col_count, 1 + CASE WHEN child >= 2 AND outside = 0 THEN 1 ELSE 0 END AS header_rows FROM shape s LEFT JOIN k USING (table_id)""", "wide"))
def header_depth(spark: SparkSession, sf: str) -> DataFrame:
    return grids.header_depth(wide(spark, sf))


HEADER = """depth AS (SELECT DISTINCT o_orderkey AS table_id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS h FROM orders),
keys AS (SELECT table_id, u.c AS col_no, CASE WHEN u.c = 0 THEN 'item' WHEN u.c = 3 THEN 'note' WHEN u.c = 4 THEN 'Column 5' WHEN h = 1 THEN 'amount' WHEN u.c = 1 THEN 'amount net' ELSE 'amount gross' END AS header_key
  FROM depth, unnest(range(0, 5)) AS u(c))"""


@query("tbl17_header_keys", oracle(f"WITH {HEADER} SELECT table_id, CAST(col_no AS INTEGER) AS col_no, header_key FROM keys", "wide"))
def header_keys(spark: SparkSession, sf: str) -> DataFrame:
    source = cut_lineage(wide(spark, sf))
    return grids.header_keys(source, cut_lineage(grids.header_depth(source)))


KINDS = HEADER + f""", {_grid('wide')},
st AS (SELECT g.table_id, g.row_no, any_value(rc) AS rc, any_value(cc) AS cc, any_value(h) AS h, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9ก-๙]')) AS n,
   min(col_no) FILTER (regexp_matches(text, '[A-Za-z0-9ก-๙]')) AS f, max(col_no) FILTER (regexp_matches(text, '[A-Za-z0-9ก-๙]')) AS l FROM grid g JOIN depth USING (table_id) GROUP BY ALL),
sp AS (SELECT st.table_id, st.row_no, coalesce(bool_or(row_span > 1 OR col_span > 1), false) AS sp, coalesce(sum(row_span * col_span - 1), 0) AS score
   FROM st LEFT JOIN wide w ON w.table_id = st.table_id AND w.row_no = st.row_no AND NOT w.hidden GROUP BY ALL),
ty AS (SELECT table_id, list_sort(list(n))[CAST(floor(count(*) / 2.0) AS BIGINT) + 1] AS t FROM st WHERE row_no >= h AND n > 0 GROUP BY table_id),
kinds AS (SELECT st.table_id, st.row_no, CASE WHEN st.row_no < h THEN 'header' WHEN n = 0 THEN 'empty' WHEN
    CAST(st.row_no >= greatest(h, floor(rc * 0.65)) OR st.row_no >= rc - 3 AS INT) + CAST((coalesce(t, 0) >= 3 AND n <= greatest(1, floor(t * 0.6))) OR (coalesce(t, 0) > 0 AND abs(n - t) >= greatest(2, ceil(t * 0.4))) AS INT)
    + CAST(sp AS INT) + CAST(n >= 2 AND n <= greatest(2, ceil(cc * 0.45)) AND l - f >= greatest(1, floor(cc * 0.45)) AS INT) >= 2 THEN 'summary' ELSE 'data' END AS kind
  FROM st LEFT JOIN ty USING (table_id) JOIN sp ON sp.table_id = st.table_id AND sp.row_no = st.row_no)"""


@query("tbl18_row_kinds", oracle(f"WITH {KINDS} SELECT table_id, row_no, kind FROM kinds", "wide"))
def row_kinds(spark: SparkSession, sf: str) -> DataFrame:
    source = cut_lineage(wide(spark, sf))
    return grids.row_kinds(cut_lineage(grids.row_stats(source)), grids.header_depth(source))


SUMMARY = KINDS + """,
body AS (SELECT st.*, sp.sp, sp.score, list(n) OVER w AS ns, list(score) OVER w AS ss FROM st JOIN sp USING (table_id, row_no) WHERE row_no >= h AND n > 0
   WINDOW w AS (PARTITION BY table_id ORDER BY row_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
typ AS (SELECT *, coalesce(list_sort(ns)[len(ns) // 2 + 1], 0) AS t, coalesce(list_sort(ss)[len(ss) // 2 + 1], 0) AS ts FROM body),
begin AS (SELECT *, greatest(2, floor(t * 0.65)) AS lim, row_no >= greatest(h, floor(rc * 0.55)) OR row_no >= rc - 4 AS tail FROM typ
   WHERE row_no > h AND rc > h + 1 AND t >= 3 AND n <= greatest(2, floor(t * 0.6)) AND t - n >= 2),
mem AS (SELECT b.table_id, b.row_no AS start, b.t, b.ts, b.tail, r.row_no, r.sp, r.score FROM begin b JOIN body r ON r.table_id = b.table_id AND r.row_no >= b.row_no AND r.n <= b.lim
   AND r.row_no < coalesce((SELECT min(x.row_no) FROM body x WHERE x.table_id = b.table_id AND x.row_no > b.row_no AND x.n > b.lim), 999999)),
pop AS (SELECT table_id, row_no, col_no, trim(text) AS text, row_number() OVER (PARTITION BY table_id, row_no ORDER BY col_no) AS nth FROM grid WHERE regexp_matches(text, '[A-Za-z0-9ก-๙]')),
prs AS (SELECT m.*, a.col_no AS lc, b.col_no AS vc, a.text AS key, b.text AS value, a.nth FROM mem m JOIN pop a ON a.table_id = m.table_id AND a.row_no = m.row_no JOIN pop b ON b.table_id = m.table_id AND b.row_no = m.row_no AND b.col_no > a.col_no),
cand AS (SELECT table_id, start, lc, vc, count(*) AS n, any_value(t) AS t, 3 + CAST(bool_or(tail) AS INT) + CAST(count(*) >= 2 AS INT) + CAST(bool_or(sp) AS INT) + CAST(bool_or(score > ts) AS INT) + CAST(bool_and(nth <= 2) AS INT) AS ev FROM prs GROUP BY table_id, start, lc, vc),
pick AS (SELECT * FROM cand WHERE ev >= 4 QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY ev DESC, n DESC, t DESC, vc DESC, lc DESC, start) = 1),
summ AS (SELECT p.table_id, p.row_no, p.lc, p.vc, p.key, p.value FROM prs p JOIN pick k ON k.table_id = p.table_id AND k.start = p.start AND k.lc = p.lc AND k.vc = p.vc)"""


@query("win16_summary_pairs", oracle(f"WITH {SUMMARY} SELECT table_id, row_no, CAST(lc AS INTEGER) AS label_col, CAST(vc AS INTEGER) AS value_col, key, value FROM summ", "wide"))
def summary_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return grids.summary_pairs(wide(spark, sf))


@query("tbl19_key_value_records", oracle(f"""WITH {SUMMARY}
SELECT g.table_id, g.row_no, string_agg(k.header_key || '=' || g.text, ';' ORDER BY g.col_no) AS record FROM grid g JOIN keys k ON k.table_id = g.table_id AND k.col_no = g.col_no
JOIN kinds d ON d.table_id = g.table_id AND d.row_no = g.row_no AND d.kind = 'data' ANTI JOIN (SELECT DISTINCT table_id, row_no FROM summ) s ON s.table_id = g.table_id AND s.row_no = g.row_no GROUP BY ALL""", "wide"))
def key_value_records(spark: SparkSession, sf: str) -> DataFrame:
    return grids.key_value_records(wide(spark, sf)).selectExpr(
        "table_id", "row_no", "array_join(transform(entries, e -> concat(e.key, '=', e.value)), ';') AS record"
    )


# The records of corrected tables: the same twin over cells as they are read.
@query("tbl19_corrected_records", oracle(f"""WITH {SUMMARY}
SELECT g.table_id, g.row_no, string_agg(k.header_key || '=' || g.text, ';' ORDER BY g.col_no) AS record FROM grid g JOIN keys k ON k.table_id = g.table_id AND k.col_no = g.col_no
JOIN kinds d ON d.table_id = g.table_id AND d.row_no = g.row_no AND d.kind = 'data' ANTI JOIN (SELECT DISTINCT table_id, row_no FROM summ) s ON s.table_id = g.table_id AND s.row_no = g.row_no GROUP BY ALL""".replace("FROM wide", "FROM as_read").replace("JOIN wide", "JOIN as_read"), "as_read"))
def corrected_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of tables that users have corrected."""
    return grids.key_value_records(corrected(spark, sf)).selectExpr("table_id", "row_no", "array_join(transform(entries, e -> concat(e.key, '=', e.value)), ';') AS record")


@query("tbl20_export_cells", oracle("""
SELECT table_id, row_no, col_no, text, row_span, col_span, text AS ocr_text, CASE WHEN table_id % 2 = 0 THEN upper(text) ELSE text END AS ground_truth FROM cells WHERE NOT hidden""", "cells"))
def export_cells(spark: SparkSession, sf: str) -> DataFrame:
    source = cells(spark, sf).selectExpr("*", "cast(null AS string) AS ocr_text", "CASE WHEN table_id % 2 = 0 THEN upper(text) END AS ground_truth")
    return grids.export_cells(source)


@query("tbl01_html_tables", oracle("""
WITH s AS (SELECT *, dense_rank() OVER (PARTITION BY table_id ORDER BY row_no) - 1 AS place FROM cells)
SELECT table_id, 0 AS table_no, CAST(place AS INTEGER) AS row_no, col_no, CASE WHEN hidden THEN '' ELSE text END AS text, row_span, CASE WHEN hidden THEN 1 ELSE col_span END AS col_span, hidden FROM s
UNION ALL SELECT table_id, 1, 0, c, CASE c WHEN 0 THEN 'caf\u00e9 \u2014 A&lt;' ELSE CAST(table_id AS VARCHAR) END, 1, 1, false FROM (SELECT DISTINCT table_id FROM cells), unnest([0, 1]) AS u(c)""", "cells"))
def html_tables(spark: SparkSession, sf: str) -> DataFrame:
    visible = cells(spark, sf).filter("NOT hidden")
    tag = "concat('<td', CASE WHEN col_span > 1 THEN concat(' colspan=\"', col_span, '\"') ELSE '' END, '>', text, '</td>')"
    rows = visible.groupBy("table_id", "row_no").agg(
        F.expr(f"concat('<tr>', array_join(transform(array_sort(collect_list(struct(col_no, {tag} AS tag))), c -> c.tag), ''), '</tr>')").alias("tr")
    )
    pages = rows.groupBy("table_id").agg(
        F.expr("concat('<html><table border=1>', array_join(transform(array_sort(collect_list(struct(row_no, tr))), r -> r.tr), '\\n'), '</table><p>x</p><table><tr><td>caf&eacute; &#8212;&nbsp;&#x41;&amp;lt;</td><td>', table_id, '</td></tr></table></html>')").alias("page")
    )
    return html.table_cells(pages, "table_id", "page")


# Fields of a document: its orders. Results: line items that name an order, a page, or neither.
sql("rois", "SELECT o_custkey AS doc_id, CASE o_orderkey % 8 WHEN 0 THEN ' ' ELSE concat(CASE WHEN o_orderkey % 8 = 1 THEN ' ' ELSE '' END, CAST(o_orderkey AS VARCHAR)) END AS roi_id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS INTEGER) END AS page, o_orderpriority AS field_name, o_orderkey AS roi_order, CASE o_orderstatus WHEN 'F' THEN 'table' WHEN 'O' THEN 'extract_image' ELSE 'text' END AS roi_type FROM orders")
sql("results", """
SELECT o_custkey AS doc_id, l_orderkey * 10 + l_linenumber AS result_id, CASE l_linenumber % 4 WHEN 0 THEN concat(CAST(l_orderkey AS VARCHAR), ' ') WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE '-1' END AS roi_id,
  CASE WHEN min(l_suppkey) % 4 = 0 THEN NULL ELSE CAST((l_orderkey + min(l_suppkey) % 2) % 3 AS INTEGER) END AS page, min(o_orderpriority) AS field_name,
  CASE min(l_returnflag) WHEN 'A' THEN 'Text' WHEN 'R' THEN 'Ocr_Table' ELSE NULL END AS type FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_orderkey, l_linenumber""")


def rois(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS doc_id", "CASE o_orderkey % 8 WHEN 0 THEN ' ' ELSE concat(CASE WHEN o_orderkey % 8 = 1 THEN ' ' ELSE '' END, cast(o_orderkey AS string)) END AS roi_id",
        "CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN NULL ELSE cast(o_orderkey % 3 AS int) END AS page", "o_orderpriority AS field_name",
        "o_orderkey AS roi_order", "CASE o_orderstatus WHEN 'F' THEN 'table' WHEN 'O' THEN 'extract_image' ELSE 'text' END AS roi_type",
    )


def results(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("supp"), F.min(F.ascii("l_returnflag")).alias("flag"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(
        "o_custkey AS doc_id", "l_orderkey * 10 + l_linenumber AS result_id", "CASE l_linenumber % 4 WHEN 0 THEN concat(cast(l_orderkey AS string), ' ') WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE '-1' END AS roi_id",
        "CASE WHEN supp % 4 = 0 THEN NULL ELSE cast((l_orderkey + supp % 2) % 3 AS int) END AS page", "o_orderpriority AS field_name",
        "CASE chr(flag) WHEN 'A' THEN 'Text' WHEN 'R' THEN 'Ocr_Table' ELSE NULL END AS type",
    )


sql("matched", """
WITH f AS (SELECT *, nullif(trim(roi_id), '') AS id, coalesce(page, 0) AS p FROM rois), q AS (SELECT *, nullif(trim(roi_id), '') AS id FROM results)
SELECT * FROM (SELECT r.doc_id, r.result_id, r.type, f.roi_id AS matched_roi, f.roi_type, CASE WHEN f.id = r.id AND f.p = coalesce(r.page, 0) THEN 'page_and_id' WHEN f.id = r.id AND r.page IS NULL THEN 'id' ELSE 'name' END AS matched_by,
   row_number() OVER (PARTITION BY r.result_id ORDER BY CASE WHEN f.id = r.id AND f.p = coalesce(r.page, 0) THEN 1 WHEN f.id = r.id AND r.page IS NULL THEN 2 ELSE 3 END, f.roi_order) AS nth
  FROM q r JOIN f ON f.doc_id = r.doc_id AND ((f.id = r.id AND (f.p = coalesce(r.page, 0) OR r.page IS NULL)) OR (f.p = coalesce(r.page, 0) AND f.field_name = r.field_name))) WHERE nth = 1""", "results", "rois")


@query("join11_matched_fields", oracle("SELECT r.doc_id, r.result_id, matched_roi, matched_by FROM results r LEFT JOIN matched m ON m.result_id = r.result_id", "results", "matched"))
def matched_fields(spark: SparkSession, sf: str) -> DataFrame:
    return export.match_fields(results(spark, sf), rois(spark, sf)).drop("matched_order")


@query("snk02_result_types", oracle("""
WITH t AS (SELECT r.result_id, CASE WHEN lower(coalesce(m.roi_type, '')) IN ('image', 'extract_image') THEN 'image'
  WHEN lower(coalesce(r.type, '')) IN ('table', 'ocr_table') OR lower(coalesce(m.roi_type, '')) = 'table' THEN 'table' ELSE 'text' END AS result_type FROM results r LEFT JOIN matched m ON m.result_id = r.result_id)
SELECT * FROM t WHERE result_type <> 'image'""", "results", "matched"))
def result_types(spark: SparkSession, sf: str) -> DataFrame:
    found = results(spark, sf)
    matched = export.match_fields(found, rois(spark, sf)).select("doc_id", "result_id", F.col("matched_order").alias("roi_order"))
    kinds = matched.join(rois(spark, sf).select("doc_id", "roi_order", "roi_type"), ["doc_id", "roi_order"], "left").select("result_id", "roi_type")
    typed = export.result_types(found.select("result_id", "type").join(kinds, "result_id"), ["type", "roi_type"])
    return export.included(typed, images=False).select("result_id", "result_type")


@query("snk01_nested_documents", oracle("""
WITH v AS (SELECT conv_id AS doc_id, turn // 2 AS page, role AS name, turn AS pos, CAST(length(text) AS VARCHAR) AS value FROM conversations),
f AS (SELECT doc_id, page, name, min(pos) AS first, CASE WHEN count(*) = 1 THEN '"' || any_value(value) || '"' ELSE '["' || string_agg(value, '","' ORDER BY pos) || '"]' END AS body FROM v GROUP BY ALL),
p AS (SELECT doc_id, page, '{' || string_agg('"' || name || '":' || body, ',' ORDER BY first, name) || '}' AS fields FROM f GROUP BY ALL)
SELECT doc_id, count(*) AS page_count, '{"page_count":' || count(*) || ',"pages":[' || string_agg('{"page":' || (page + 1) || ',"fields":' || fields || '}', ',' ORDER BY page) || ']}' AS document FROM p GROUP BY doc_id"""))
def nested_documents(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "conversations").selectExpr(
        "conv_id AS doc_id", "turn div 2 AS page", "role AS field_name", "turn AS position", "cast(length(text) AS string) AS value"
    )
    return export.nested_documents(export.page_documents(values))


@query("txt06_edited_fields", oracle("""
SELECT role, count(*) AS fields, count(*) FILTER (text IS DISTINCT FROM CASE WHEN turn % 3 = 0 THEN upper(text) WHEN turn % 5 = 1 THEN NULL ELSE text END) AS edited FROM conversations GROUP BY role"""))
def edited_fields(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.expr("CASE WHEN turn % 3 = 0 THEN upper(text) WHEN turn % 5 = 1 THEN NULL ELSE text END")
    edited = ~F.col("text").eqNullSafe(shown)
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("fields"), F.count_if(edited).alias("edited"))


@query("set03_first_seen", oracle("""
SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id"""))
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values in first-seen order; repeats collapse before anything is collected."""
    first = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.groupBy("conv_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(first, role))), r -> r.role), ',')").alias("roles")
    )


@query("txt01_squeezed_lines", oracle(r"""
SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]'),
  lambda l: trim(regexp_replace(l, '[ \t\r\f\x0B]+', ' ', 'g'))), lambda l: l <> ''), chr(10))) AS body FROM documents"""))
def squeezed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(txt.normalise_text(F.col("text"), cleanup=False)).alias("body"))


@query("txt02_noise_cleanup")
def noise_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = table(spark, sf, "documents").select("doc_id", "n_chars", txt.normalise_text(F.col("text")).alias("body"))
    return cleaned.select("doc_id", "n_chars", F.length("body").alias("kept_chars"), F.md5("body").alias("body"))
