"""Catalog views, lookups and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import catalog, retrieval
from folioframe.plans import derive
from folioframe.plans.derive import oracle, sql, table
from folioframe.plans.registry import query


def _parts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Groups are nations, versions customers, pages orders, fields line items, categories regions of the world."""
    return {
        "groups": table(spark, sf, "nation").selectExpr("cast(n_nationkey AS bigint) AS group_id", "n_name AS template_name", "n_regionkey"),
        "versions": table(spark, sf, "customer").selectExpr("c_custkey AS version_id", "cast(c_nationkey AS bigint) AS group_id", "c_name AS version_name", "c_mktsegment AS status"),
        "pages": table(spark, sf, "orders").selectExpr("o_orderkey AS page_id", "o_custkey AS version_id", "cast(o_orderkey % 3 AS int) + 1 AS page_number"),
        "fields": table(spark, sf, "lineitem").selectExpr("l_orderkey AS page_id", "l_orderkey * 100 + l_linenumber AS field_id", "l_returnflag AS data_type", "l_suppkey AS sort_order", "l_quantity AS weight"),
        "categories": table(spark, sf, "region").selectExpr("r_regionkey AS category_id", "r_name AS category_label"),
    }


@query("join01_field_view", oracle("""
SELECT v.c_custkey AS version_id, g.n_name AS template_name, v.c_name AS version_name, p.o_orderkey AS page_id, l.l_orderkey * 100 + l.l_linenumber AS field_id, l.l_returnflag AS data_type
FROM lineitem l JOIN orders p ON p.o_orderkey = l.l_orderkey JOIN customer v ON v.c_custkey = p.o_custkey JOIN nation g ON g.n_nationkey = v.c_nationkey"""))
def field_view(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    view = catalog.field_view(p["fields"], p["pages"], p["versions"], p["groups"])
    return view.select("version_id", "template_name", "version_name", "page_id", "field_id", "data_type")


@query("join01_anchor_view", oracle("""
SELECT v.c_custkey AS version_id, l.l_orderkey * 100 + l.l_linenumber AS field_id, l.l_quantity AS weight, r.r_name AS category_label
FROM lineitem l JOIN orders p ON p.o_orderkey = l.l_orderkey JOIN customer v ON v.c_custkey = p.o_custkey JOIN nation g ON g.n_nationkey = v.c_nationkey
LEFT JOIN region r ON r.r_regionkey = CASE WHEN l.l_linenumber % 2 = 0 THEN l.l_linenumber ELSE NULL END"""))
def anchor_view(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    anchors = p["fields"].withColumn("category_id", F.expr("CASE WHEN field_id % 2 = 0 THEN cast(field_id % 100 AS int) END"))
    view = catalog.anchor_view(anchors, p["pages"], p["versions"], p["groups"], p["categories"])
    return view.select("version_id", "field_id", "weight", "category_label")


@query("join02_version_list", oracle("""
SELECT c_custkey AS version_id, c_name AS version_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS page_count FROM customer"""))
def version_list(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf)
    return catalog.version_list(p["versions"], p["pages"]).select("version_id", "version_name", "page_count")


@query("join03_join04_candidate_pairs", oracle("""
SELECT p.page_id, t.template_page_id, t.template_id, t.page_number AS template_page_number
FROM layout_pages p JOIN template_pages t ON true JOIN template_versions v ON v.template_id = t.template_id
WHERE (v.status = 'active' OR t.template_id = 8) AND CASE WHEN coalesce(v.detection_mode, 'all_pages') = 'main_page'
  THEN t.page_number = coalesce(v.main_page_number, 1) ELSE t.page_number = p.page_number END""", "layout_pages", "template_pages", "template_versions"))
def candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    templates = derive.template_pages(spark, sf).join(derive.template_versions(spark, sf), "template_id").select(
        "template_page_id", "template_id", "page_number", "status", "detection_mode", "main_page_number"
    )
    allowed = retrieval.eligible_templates(templates, include_template=8)
    pages = derive.layout_pages(spark, sf).select("page_id", "page_number")
    pairs = retrieval.route_pairs(pages, allowed)
    return pairs.select("page_id", "template_page_id", "template_id", F.col("t_page_number").alias("template_page_number"))


@query("join17_lookup", oracle("""
SELECT c_custkey, coalesce(a.n_nationkey, b.n_nationkey) AS resolved_id FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CAST(c_nationkey AS VARCHAR) WHEN 1 THEN 'NATION_' || c_nationkey ELSE 'none' END AS v FROM customer) c
LEFT JOIN nation a ON CAST(a.n_nationkey AS VARCHAR) = v LEFT JOIN nation b ON b.n_name = v"""))
def lookup(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE c_custkey % 3 WHEN 0 THEN cast(c_nationkey AS string) WHEN 1 THEN concat('NATION_', c_nationkey) ELSE 'none' END AS asked"
    )
    known = table(spark, sf, "nation").selectExpr("n_nationkey AS id", "n_name AS code")
    return catalog.lookup_by_id_or_code(asked, known, "asked").select("c_custkey", "resolved_id")


@query("set01_template_fields", oracle("""
SELECT l_orderkey * 100 + l_linenumber AS field_id, l_orderkey AS page_id, 'field' AS source, false AS is_anchor, 1.0::DOUBLE AS weight, CASE WHEN l_linenumber % 2 = 0 THEN 'flexible' ELSE 'fix' END AS roi_mode FROM lineitem
UNION ALL SELECT o_orderkey, o_orderkey, 'anchor', true, CASE WHEN o_orderkey % 4 = 0 THEN 1.0::DOUBLE ELSE CAST(o_orderkey % 4 AS DOUBLE) END, 'fix' FROM orders"""))
def template_fields(spark: SparkSession, sf: str) -> DataFrame:
    fields = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 100 + l_linenumber AS field_id", "l_orderkey AS page_id", "CASE WHEN l_linenumber % 2 = 0 THEN 'flexible' ELSE 'fix' END AS roi_mode"
    )
    anchors = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS field_id", "o_orderkey AS page_id", "CASE WHEN o_orderkey % 4 <> 0 THEN cast(o_orderkey % 4 AS double) END AS weight"
    )
    both = catalog.template_fields(fields, anchors)
    return both.select("field_id", "page_id", "source", "is_anchor", "weight", "roi_mode")


@query("agg07_dashboard", oracle("""
SELECT (SELECT count(*) FROM orders) AS template_count, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS draft_template_count, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS active_template_count,
  (SELECT count(*) FROM lineitem WHERE l_returnflag IN ('A', 'N')) AS pending_request_count, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS rejected_request_count"""))
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    templates = table(spark, sf, "orders").selectExpr("CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'draft' ELSE 'validated' END AS status")
    requests = table(spark, sf, "lineitem").selectExpr("CASE l_returnflag WHEN 'A' THEN 'submitted' WHEN 'N' THEN 'in_review' ELSE 'rejected' END AS status")
    return catalog.dashboard(templates, requests)


@query("agg07_status_counts", oracle("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1"))
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.status_counts(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")))


@query("agg07_latest_templates", oracle("SELECT o_orderkey AS template_id, o_orderdate AS updated_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 4"))
def latest_templates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS template_id", "o_orderdate AS updated_at")
    return catalog.latest(rows, [F.desc("updated_at"), F.desc("template_id")])


@query("agg08_next_versions", oracle("""
SELECT c_nationkey AS group_id, max(c_custkey % 50) + 1 AS next_version, count(*) AS version_count FROM customer GROUP BY c_nationkey"""))
def next_versions(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.next_versions(table(spark, sf, "customer").selectExpr("c_nationkey AS group_id", "c_custkey % 50 AS version_number"))


@query("top05_latest_job", oracle("""
SELECT o_custkey AS template_id, o_orderkey AS job_id, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""))
def latest_job(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").selectExpr("o_custkey AS template_id", "o_orderkey AS job_id", "o_orderstatus AS status", "o_orderdate AS requested_at")
    return catalog.latest_per_key(jobs, "template_id", ["requested_at", "job_id"], ["job_id", "status"])


@query("top05_field_order", oracle("""
SELECT o_custkey AS version_id, l_orderkey * 100 + l_linenumber AS field_id, l_quantity AS q, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, l_suppkey, l_shipdate, l_orderkey * 100 + l_linenumber, l_quantity, l_extendedprice) AS INTEGER) AS place
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""))
def field_order(spark: SparkSession, sf: str) -> DataFrame:
    from folioframe.operators.ordering import row_places

    p = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey AS version_id", "o_orderkey % 3 AS page_number")
    lines = table(spark, sf, "lineitem").join(p, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "version_id", "page_number * 1000000000000L + l_suppkey AS lead", "l_shipdate", "l_orderkey * 100 + l_linenumber AS field_id", "l_quantity AS q", "l_extendedprice"
    )
    placed = row_places(lines, ["version_id"], ["lead", "l_shipdate", "field_id", "q", "l_extendedprice"], 1e12)
    return placed.select("version_id", "field_id", "q", "place")


@query("geo06_normalisers", oracle("""
SELECT l_orderkey, l_linenumber, l_quantity AS q, CASE l_linenumber % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'text' WHEN 3 THEN 'currency' ELSE 'image' END AS data_type,
  CASE l_linenumber % 4 WHEN 0 THEN 'paddle_thai_ocr' WHEN 1 THEN 'ocr_table' WHEN 2 THEN 'ocr_text' ELSE 'ocr_text' END AS method,
  CASE WHEN l_linenumber % 2 = 0 THEN 'flexible' ELSE 'fix' END AS roi_mode, CASE WHEN l_linenumber % 3 = 0 THEN 'main_page' ELSE 'all_pages' END AS detection_mode,
  greatest(1, CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN CAST(l_suppkey AS INTEGER) ELSE 1 END) AS main_page, CASE l_linenumber % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS review,
  CASE l_linenumber % 5 WHEN 1 THEN 'table_recognition_v2' WHEN 4 THEN 'extract_image' ELSE 'paddle_thai_ocr' END AS default_method FROM lineitem"""))
def normalisers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity AS q", "element_at(array('string', 'table', 'unknown', 'currency', 'image'), l_linenumber % 5 + 1) AS kind",
        "element_at(array('typhoon_ocr', 'ocr_table', 'else', 'ocr_text'), l_linenumber % 4 + 1) AS how", "CASE WHEN l_linenumber % 2 = 0 THEN 'flexible' ELSE 'loose' END AS mode",
        "CASE WHEN l_linenumber % 3 = 0 THEN 'main_page' END AS detect", "CASE l_linenumber % 3 WHEN 0 THEN 'x' WHEN 1 THEN cast(l_suppkey AS string) ELSE '-4' END AS main",
        "element_at(array('approved', 'rejected', 'lost'), l_linenumber % 3 + 1) AS review",
    )
    kind = catalog.data_type(F.col("kind"))
    return rows.select(
        "l_orderkey", "l_linenumber", "q", kind.alias("data_type"), catalog.extraction_method(F.col("how")).alias("method"), catalog.roi_mode(F.col("mode")).alias("roi_mode"),
        catalog.detection_mode(F.col("detect")).alias("detection_mode"), catalog.main_page(F.col("main")).alias("main_page"),
        catalog.review_status(F.col("review")).alias("review"), catalog.default_method(kind).alias("default_method"),
    )
