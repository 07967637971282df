"""Sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import signature
from folioframe.plans import derive
from folioframe.plans.derive import oracle, sql, table
from folioframe.plans.layout import SCORED, SCORE_NEEDS, template_signatures
from folioframe.plans.registry import query
from folioframe.plans.sqltext import rnd
from folioframe.functions.numeric import rnd_sql
from folioframe.session import shared_folder
from folioframe.sources import files, responses
from folioframe.streaming import detect, jobs


@query("src01_catalog_read", oracle("SELECT c_custkey AS template_id, CAST(c_nationkey AS BIGINT) AS group_id, c_name AS name, c_mktsegment AS status FROM customer"))
def catalog_read(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog table under a fixed schema: only the named columns are read."""
    schema = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING"
    rows = spark.read.schema(schema).parquet(f"{sf}/customer.parquet")
    return rows.selectExpr("c_custkey AS template_id", "cast(c_nationkey AS bigint) AS group_id", "c_name AS name", "c_mktsegment AS status")


@query("src02_json_columns", oracle("""
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events"""))
def json_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Stored JSON where some texts are null, blank or cut off."""
    raw = table(spark, sf, "events").selectExpr(
        "event_id", "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '{\"k\": ' ELSE props END AS body"
    )
    return raw.select("event_id", responses.load_json(F.col("body"), "k BIGINT")["k"].alias("k"))


@query("src03_canonical_json", oracle("""
SELECT doc_id, '{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}' AS body FROM documents"""))
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", responses.dump_json({"source": F.col("source"), "n_chars": F.col("n_chars"), "lang": F.col("lang")}).alias("body"))


def detector_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Detector output per page: half of the pages as polygons beside loose items, half as loose items only, whose keys and depth vary by page."""
    from folioframe.plans.cleanup import items

    rows = items(spark, sf).groupBy("page_id").agg(
        F.expr("array_sort(collect_list(struct(item_id, label, x, y, width, height, confidence)))").alias("i")
    )
    corners = "array(t.x, t.y, t.x + t.width, t.y + t.height)"
    polys = (
        "to_json(named_struct('res', named_struct('dt_polys', transform(i, t -> array(array(t.x, t.y), array(t.x + t.width, t.y), array(t.x + t.width, t.y + t.height), array(t.x, t.y + t.height))),"
        f" 'dt_scores', transform(slice(i, 1, greatest(1, size(i) - 1)), t -> t.confidence)), 'items', transform(i, t -> named_struct('label', t.label, 'bbox', {corners}))))"
    )
    listed = lambda fields: f"transform(i, t -> named_struct({fields}))"
    shapes = [
        f"named_struct('items', {listed(f"'label', t.label, 'bbox', {corners}, 'score', t.confidence")})",
        f"named_struct('pages', array(named_struct('found', {listed(f"'coordinate', {corners}, 'category', t.label, 'prob', t.confidence")})))",
        f"array({listed("'x', t.x, 'y', t.y, 'width', t.width, 'height', t.height, 'meta', named_struct('no', t.item_id), 'block_type', t.label, 'confidence', t.confidence")})",
    ]
    loose = "CASE page_id % 3 " + " ".join(f"WHEN {n} THEN to_json({shape})" for n, shape in enumerate(shapes)) + " END"
    return rows.selectExpr("page_id", f"CASE WHEN page_id % 2 = 0 THEN {polys} ELSE {loose} END AS body")


sql("detected", """
SELECT page_id, CAST(row_number() OVER w - 1 AS INTEGER) AS nth, CASE WHEN page_id % 2 = 0 THEN 'text' ELSE label END AS kind,
  CASE WHEN page_id % 2 = 0 AND count(*) OVER (PARTITION BY page_id) > 1 AND row_number() OVER w = count(*) OVER (PARTITION BY page_id) THEN 0.0::DOUBLE ELSE confidence END AS score, x, y, x + width AS x2, y + height AS y2
FROM items WINDOW w AS (PARTITION BY page_id ORDER BY item_id)""", "items")


@query("src04_detector_items", oracle('SELECT page_id, nth, kind, score, x AS "left", y AS top, x2 AS "right", y2 AS bottom FROM detected', "detected"))
def detector_items(spark: SparkSession, sf: str) -> DataFrame:
    return responses.detection_items(detector_responses(spark, sf), "page_id", "body")


@query("src04_rejected_items", oracle("""
WITH n AS (SELECT page_id, item_id, label, confidence, CAST(row_number() OVER (PARTITION BY page_id ORDER BY item_id) - 1 AS INTEGER) AS nth FROM items)
SELECT DISTINCT page_id, 0 AS nth, NULL AS kind, CAST(NULL AS DOUBLE) AS score, 'malformed_body' AS reason FROM n WHERE page_id % 5 = 0
UNION ALL SELECT page_id, nth, label, confidence, 'no_usable_box' FROM n WHERE page_id % 5 <> 0 AND item_id % 3 = 0""", "items"))
def rejected_items(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies that are cut off and items whose box cannot be read, with the reason."""
    from folioframe.plans.cleanup import items

    corners = "CASE WHEN t.item_id % 3 <> 0 THEN array(array(t.x, t.y), array(t.x + t.width, t.y + t.height)) WHEN t.item_id % 2 = 0 THEN array(array(t.x)) END"
    body = f"to_json(transform(i, t -> named_struct('label', t.label, 'points', {corners}, 'score', t.confidence)), map('ignoreNullFields', 'false'))"
    rows = items(spark, sf).groupBy("page_id").agg(F.expr("array_sort(collect_list(struct(item_id, label, x, y, width, height, confidence)))").alias("i"))
    bodies = rows.selectExpr("page_id", f"CASE WHEN page_id % 5 = 0 THEN substr({body}, 1, 20) ELSE {body} END AS body")
    return responses.rejected_items(bodies, "page_id", "body")


@query("src05_layout_items", oracle("""
SELECT page_id, CAST(nth AS INTEGER) AS nth, label AS kind, CASE WHEN page_id % 2 = 0 THEN 0.0::DOUBLE ELSE confidence END AS score, x AS "left", y AS top, x + width AS "right", y + height AS bottom
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY item_id) - 1 AS nth FROM items) WHERE label IN ('table', 'image')""", "items"))
def layout_items(spark: SparkSession, sf: str) -> DataFrame:
    """Table and image items of every response, polygons beside them or not."""
    return responses.layout_items(detector_responses(spark, sf), "page_id", "body")


@query("src06_recognition", oracle(f"""
WITH t AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL), s AS (SELECT conv_id, {rnd('avg(CAST(turn % 7 AS DOUBLE) / 8)', 6)} AS confidence FROM conversations GROUP BY conv_id)
SELECT conv_id, string_agg(role, ' ' ORDER BY first) AS text, any_value(confidence) AS confidence FROM t JOIN s USING (conv_id) GROUP BY conv_id"""))
def recognition(spark: SparkSession, sf: str) -> DataFrame:
    bodies = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.expr("to_json(transform(array_sort(collect_list(struct(turn, role))), t -> named_struct('rec_text', concat(' ', t.role), 'score', cast(t.turn % 7 AS double) / 8)))").alias("body")
    )
    read = responses.recognition(bodies, "conv_id", "body")
    return read.selectExpr("conv_id", "text", rnd_sql("confidence", 6) + " AS confidence")


@query("src07_sniffed_files", oracle("SELECT doc_id, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'image' END AS source_type FROM documents"))
def sniffed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The texts as file contents, every third one behind a PDF head and 1,500 blanks."""
    raw = table(spark, sf, "documents").selectExpr(
        "doc_id", "n_chars", "encode(CASE WHEN doc_id % 3 = 0 THEN concat(repeat(' \\n\\t', 500), '%PDF-1.7', text) ELSE concat('x', text) END, 'UTF-8') AS content"
    )
    return files.sniff(raw)


@query("src08_retention_scan", oracle("""
WITH f AS (SELECT concat('/jobs/', source, '/', CAST(doc_id AS VARCHAR)) AS path, CAST(n_chars AS BIGINT) AS length,
  TIMESTAMP '2026-01-02 00:00:00' - to_hours(CAST(doc_id % 50 AS BIGINT)) AS changed FROM documents),
o AS (SELECT * FROM f WHERE changed <= TIMESTAMP '2026-01-02 00:00:00' - INTERVAL 24 HOUR),
t AS (SELECT count(*) AS candidate_count, CAST(coalesce(sum(length), 0) AS BIGINT) AS candidate_bytes, count(*) > 200 AS truncated FROM o)
SELECT path, length, candidate_count, candidate_bytes, truncated FROM (SELECT * FROM o ORDER BY path LIMIT 200), t"""))
def retention_scan(spark: SparkSession, sf: str) -> DataFrame:
    """File rows derived from the documents: both outputs, the listed files next to the totals."""
    rows = table(spark, sf, "documents").selectExpr(
        "concat('/jobs/', source, '/', cast(doc_id AS string)) AS path", "cast(n_chars AS bigint) AS length",
        "timestamp'2026-01-02 00:00:00' - make_interval(0, 0, 0, 0, cast(doc_id % 50 AS int)) AS modificationTime",
    )
    totals, shown = files.retention_scan(rows, now=F.lit("2026-01-02 00:00:00").cast("timestamp"))
    return shown.select("path", "length").join(F.broadcast(totals))  # totals: one row


# Status events of OCR jobs: users are jobs, event kinds are states.
sql("job_events", """
SELECT user_id AS job_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE props END AS payload FROM events""")
EVENTS = ["user_id AS job_id", "ts", "event_id AS seq",
          "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status",
          "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE props END AS payload"]


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*EVENTS)


STATES_SQL = """
SELECT job_id, arg_max(status, (ts, seq)) AS status, min(ts) FILTER (status = 'queued') AS requested_at, max(ts) FILTER (status = 'processing') AS started_at, max(ts) FILTER (status IN ('completed', 'failed')) AS completed_at,
  (SELECT CASE WHEN e.status = 'failed' THEN coalesce(e.payload, 'OCR job failed.') END FROM job_events e WHERE e.job_id = j.job_id AND e.status <> 'queued' ORDER BY ts DESC, seq DESC LIMIT 1) AS error_message,
  (SELECT e.payload FROM job_events e WHERE e.job_id = j.job_id AND e.status = 'completed' ORDER BY ts DESC, seq DESC LIMIT 1) AS result FROM job_events j GROUP BY job_id"""


@query("str01_job_states", oracle(STATES_SQL, "job_events"))
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.job_states(job_events(spark, sf))


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{root}/log", f"{root}/checkpoint"


@query("str01_job_state_stream", oracle(STATES_SQL, "job_events"))
def job_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same states through a file stream that runs until the input is used up."""
    sink, checkpoint = _folders(spark, "jobs")
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).selectExpr(*EVENTS)
    jobs.stream_job_states(stream, sink, checkpoint).awaitTermination()
    return jobs.read_job_states(spark, sink)


@query("str02_poll", oracle(f"""
SELECT job_id, status, CASE WHEN status = 'completed' THEN result END AS result, CASE WHEN status = 'failed' THEN error_message END AS error FROM ({STATES_SQL})""", "job_events"))
def poll(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.poll(jobs.job_states(job_events(spark, sf)))


_LEGAL = " OR ".join(f"(f.at = '{a}' AND e.status = '{b}')" for a, b in sorted(jobs.LEGAL))


@query("str03_publish_flow", oracle(f"""
WITH RECURSIVE e AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT DISTINCT job_id, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::VARCHAR AS status, NULL::VARCHAR AS before, false AS legal, 'none' AS at FROM e
  UNION ALL SELECT e.job_id, e.rn, e.seq, e.status, f.at, ({_LEGAL}), CASE WHEN {_LEGAL} THEN e.status ELSE f.at END FROM f JOIN e ON e.job_id = f.job_id AND e.rn = f.rn + 1)
SELECT job_id, seq, status, before, legal FROM f WHERE rn > 0"""))
def publish_flow(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").selectExpr(
        "user_id AS job_id", "ts", "event_id AS seq", "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status"
    )
    return jobs.publish_flow(events)


@query("str04_stream_detection", oracle(SCORED + """
SELECT page_id, CAST(rank AS INTEGER) AS rank, template_id, score FROM ranked WHERE rank <= 5""", *SCORE_NEEDS))
def stream_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Arriving orders are pages; their regions come from the stored line items."""
    sink, checkpoint = _folders(spark, "detect")
    regions = signature.usable_regions(derive.regions(spark, sf))

    def signatures(batch: DataFrame) -> DataFrame:
        pages = derive.pages_from_orders(batch)
        return signature.layout_signatures(pages, regions.join(pages.select("page_id"), "page_id", "left_semi"))

    stream = spark.readStream.schema(table(spark, sf, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    detect.stream_detection(stream, signatures, template_signatures(spark, sf), sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink).select("page_id", "rank", "template_id", "score")
