"""Fixtures with known answers, brute force on small inputs, and hot groups."""

import difflib
import json
import random

from pyspark.sql import functions as F

from folioframe.functions import text as txt
from folioframe.functions.geometry import PIXEL
from folioframe.operators import clusters, decision, fields, ordering, repair, retrieval, signature, suppress, tables
from folioframe.operators.spatial import PIXEL_TILE
from folioframe.sources import export, files, html, responses
from folioframe.streaming import jobs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def reading(expected, actual, kind="contains", threshold=0.70):
    return (expected, actual, kind, threshold)


def test_anchor_scores(spark):
    data = [reading("Thai National ID Card", "i"), reading("PASSPORT", "assport"), reading("PASSPORT", "assport", threshold=0.95),
            reading("Invoice", "the INVOICE no. 1"), reading("a.c", "xxabcxx", "regex"), reading("a(", "a(", "regex"), reading("Total", "T o t a l", "exact", 0.5)]
    df = spark.createDataFrame(data, "expected_text string, actual_text string, match_type string, threshold double").withColumn("i", F.monotonically_increasing_id())
    got = {(r.expected_text, r.match_type, r.threshold): (r.score, r.passed, r.failure_reason) for r in txt.score_readings(df).collect()}
    assert got[("Thai National ID Card", "contains", 0.70)] == (0.0, False, "low_text_similarity")
    assert got[("PASSPORT", "contains", 0.70)][0] >= 0.90 and got[("PASSPORT", "contains", 0.70)][1]
    assert got[("PASSPORT", "contains", 0.95)][2] == "below_threshold"
    assert got[("Invoice", "contains", 0.70)][0] == 1.0
    assert got[("a.c", "regex", 0.70)][0] == 1.0
    assert got[("a(", "regex", 0.70)][0] == 0.0
    assert got[("Total", "exact", 0.5)][0] == 1.0


def test_sequence_ratio_matches_difflib(spark):
    pick = random.Random(3)
    pairs = [("".join(pick.choices("abcd", k=pick.randint(0, 30))), "".join(pick.choices("abcd", k=pick.randint(0, 30)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("r", txt.sequence_ratio(F.col("a"), F.col("b"), F.lit(True)))
    for r in df.collect():
        want = 1.0 if not r.a and not r.b else 0.0 if not r.a or not r.b else difflib.SequenceMatcher(None, r.a, r.b).ratio()
        assert abs(r.r - want) < 1e-12
        bound = 2.0 * min(len(r.a), len(r.b)) / max(1, len(r.a) + len(r.b))
        assert want <= bound + 1e-12 or (not r.a and not r.b)


def test_noise_cleanup(spark):
    data = [(1, "....."), (2, "ชื่อ ..... นางสาวศิรินทร์"), (3, "ประเภท A"), (4, "ABC-123"), (5, "ชื่อ x นาย"), (6, "a\n---\nb  c")]
    df = spark.createDataFrame(data, "i int, t string").select("i", txt.normalise_text(F.col("t")).alias("o"))
    assert rows(df, "i", "o") == [(1, ""), (2, "ชื่อ นางสาวศิรินทร์"), (3, "ประเภท A"), (4, "ABC-123"), (5, "ชื่อ นาย"), (6, "a\nb c")]


def test_category_logits(spark):
    df = spark.createDataFrame([(1, [2.0, 0.0, -1.0], 0), (2, [0.2, 2.0, -1.0], 0), (3, [-10.0, -11.0, -12.0], 0)], "image_id int, logits array<double>, target int")
    assert rows(decision.category_evidence(df), "image_id", "target_rank", "evidence_score") == [(1, 1, 1.0), (2, 2, 0.0), (3, 1, 1.0)]
    odd = spark.createDataFrame([(1, [2.0, 0.0], None), (2, [2.0, 0.0], 5), (3, [], 0)], "image_id int, logits array<double>, target int")
    assert rows(decision.category_evidence(odd), "image_id", "target_rank", "evidence_score", "passed", "error") == [
        (1, None, 0.0, False, "category_not_found"), (2, None, 0.0, False, "category_not_found"), (3, None, 0.0, False, "no_active_categories"),
    ]


def test_small_weights_count(spark):
    checked = spark.createDataFrame([(1, "text", 0.9, 0.004, False, True)], "page_id int, anchor_type string, score double, weight double, required boolean, passed boolean")
    assert rows(decision.verification_rollup(checked, "page_id"), "score") == [(0.9,)]


def test_words_of_a_borderless_cell_read_left_to_right(spark):
    boxes = [(1, 1, "John", 10.0, 11.0), (1, 2, "Smith", 20.0, 10.0), (1, 3, "x", 200.0, 10.0), (1, 4, "a", 14.0, 60.0), (1, 5, "b", 200.0, 60.0)]
    df = spark.createDataFrame(boxes, "group_id int, box_id int, text string, x double, y double").selectExpr("*", "0.9D AS confidence", "40D AS width", "12D AS height")
    assert ("John Smith",) in rows(tables.borderless_cells(df), "text")


def test_blank_texts_fill_no_grid_row(spark):
    placed = spark.createDataFrame([(1, "a", 0, 0), (1, " ", 1, 1)], "group_id int, text string, row_no int, col_no int").selectExpr(
        "*", "5D AS x", "5D AS y", "10D AS width", "10D AS height", "array(0D, 20D, 40D) AS row_bounds", "array(0D, 20D, 40D) AS col_bounds", "array(0D, 40D) AS hard_bounds")
    assert rows(tables.grid_diagnostics(placed), "empty_row_ratio", "empty_column_ratio") == [(0.5, 0.5)]


def test_field_ids_and_pages(spark):
    fields = spark.createDataFrame([(1, " f1 ", None, "n", 1), (1, " ", 0, "blank", 2)], "doc_id int, roi_id string, page int, field_name string, roi_order int")
    results = spark.createDataFrame([(1, 1, "f1", 0, "z"), (1, 2, "  ", 0, "z"), (1, 3, None, None, "n")], "doc_id int, result_id int, roi_id string, page int, field_name string")
    assert rows(export.match_fields(results, fields), "result_id", "matched_roi", "matched_by") == [(1, " f1 ", "page_and_id"), (2, None, None), (3, " f1 ", "name")]


def test_signature_keeps_every_region(spark):
    regions = spark.range(25).selectExpr("1 AS page_id", "id AS region_id", "'text' AS label", "(id % 5) / 5D AS x_ratio", "floor(id / 5) / 5D AS y_ratio", "0.1D AS width_ratio", "0.1D AS height_ratio", "0.9D AS confidence")
    usable = signature.usable_regions(regions)
    assert signature.leading_regions(usable, ["page_id"]).selectExpr("size(regions_text)").first()[0] == 25
    assert signature.leading_regions(usable, ["page_id"], 20).selectExpr("size(regions_text)").first()[0] == 20


def test_html_spans(spark):
    page = "<table><tr><td rowspan=2>a</td><td colspan='2'>b &amp; c</td></tr><tr><th>d</th><td>e</td></tr></table>"
    page += "<p>x</p><table><tr><td>caf&eacute; &#8212;&#x41;&amp;lt; &nosuch;</td></tr></table>"
    cells = html.table_cells(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html")
    assert rows(cells.filter("table_no = 1"), "text") == [("café —A&lt; &nosuch;",)]
    got = rows(cells.filter("NOT hidden AND table_no = 0"), "row_no", "col_no", "text", "row_span", "col_span")
    assert got == [(0, 0, "a", 2, 1), (0, 1, "b & c", 1, 2), (1, 1, "d", 1, 1), (1, 2, "e", 1, 1)]


def test_parse_tables(spark):
    data = [(1, '[["a","b"],["1",null]]'), (2, '[{"k":"1"},{"k":"2","m":"3"}]'), (3, "| a | b |\n|---|:---:|\n| 1 | 2 |"), (4, "(no text found in ROI)"), (5, "plain  text")]
    got = {r.i: r.rows for r in export.parse_tables(spark.createDataFrame(data, "i int, t string"), "t").collect()}
    assert got == {1: [["a", "b"], ["1", ""]], 2: [["k", "m"], ["1", ""], ["2", "3"]], 3: [["a", "b"], ["1", "2"]], 4: None, 5: None}


def test_borderless_table(spark):
    data = [(1, 1, "Name", 0.9, 10.0, 10.0), (1, 2, "Amount", 0.9, 120.0, 10.0), (1, 3, "Alice", 0.9, 10.0, 50.0), (1, 4, "100", 0.9, 120.0, 50.0)]
    boxes = spark.createDataFrame(data, "group_id int, box_id int, text string, confidence double, x double, y double").selectExpr("*", "45D AS width", "15D AS height")
    assert rows(tables.borderless_cells(boxes), "row_no", "col_no", "text") == [(0, 0, "Name"), (0, 1, "Amount"), (1, 0, "Alice"), (1, 1, "100")]


def test_page_against_itself(spark):
    pages = spark.createDataFrame([(1, 1, 1200, 800)], "page_id long, page_number int, image_width int, image_height int")
    data = [(1, 1, "text", 0.10, 0.10, 0.30, 0.08, 0.9), (1, 2, "table", 0.10, 0.35, 0.70, 0.30, 0.9), (1, 3, "image", 0.72, 0.08, 0.18, 0.20, 0.9), (1, 4, "text", 0.1, 0.1, 0.0, 0.1, 0.9)]
    regions = spark.createDataFrame(data, "page_id long, region_id int, label string, x_ratio double, y_ratio double, width_ratio double, height_ratio double, confidence double")
    sig = signature.layout_signatures(pages, signature.usable_regions(regions))
    one = sig.collect()[0]
    assert (one.page_aspect_ratio, one.region_count, one.count_text, len(one.grid_units_text)) == (1.5, 3, 1, 16) and one.area_table > one.area_text
    stored = sig.withColumnRenamed("page_id", "template_page_id").selectExpr("*", "7L AS template_id", "'active' AS status", "cast(null AS string) AS detection_mode", "1 AS main_page_number")
    best = retrieval.top_templates(retrieval.score_pairs(retrieval.route_pairs(sig, stored))).collect()
    assert [(r.template_id, r.rank, r.score) for r in best] == [(7, 1, 1.0)]
    whole = signature.layout_signatures(pages, signature.usable_regions(regions), maskable=True)
    hidden = "array(named_struct('x_ratio', 0D, 'y_ratio', 0D, 'width_ratio', 0.5D, 'height_ratio', 0.3D), named_struct('x_ratio', 0.7D, 'y_ratio', 0D, 'width_ratio', 0D, 'height_ratio', 1D))"
    masked = stored.drop(*[c for c in stored.columns if "_" in c and c.split("_")[-1] in ("text", "table", "image")])
    masked = masked.join(whole.drop("page_number", "image_width", "image_height", "page_aspect_ratio", "region_count").withColumnRenamed("page_id", "template_page_id"), "template_page_id")
    seen = retrieval.apply_masks(retrieval.route_pairs(whole, masked.withColumn("template_masks", F.expr(hidden)))).collect()[0]
    for side in ("", "t_"):
        assert seen[f"{side}count_text"] == 0 and seen[f"{side}area_text"] == 0 and seen[f"{side}norm_text"] == 0 and seen[f"{side}regions_text"] == [] and sum(seen[f"{side}grid_units_text"]) == 0
        assert seen[f"{side}count_table"] == 1 and seen[f"{side}area_table"] == one.area_table and seen[f"{side}grid_units_image"] == one.grid_units_image


def test_multi_page_mean(spark):
    ranked = spark.createDataFrame([(1, 5, 0.9), (1, 5, 0.8), (1, 5, 0.7)], "doc_id int, template_id int, score double")
    assert rows(retrieval.document_retrieval(ranked), "score", "matched_pages") == [(0.8, 3)]


def brute_keep(boxes, rule_share=0.88, ratio=0.72):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[4] * b[5], b[1])):
        area = max(1.0, b[4] * b[5])
        def inside(k):
            w = max(0.0, min(b[2] + b[4], k[2] + k[4]) - max(b[2], k[2]))
            h = max(0.0, min(b[3] + b[5], k[3] + k[5]) - max(b[3], k[3]))
            return w * h / area >= rule_share and area / max(1.0, k[4] * k[5]) <= ratio
        if not any(k[0] == b[0] and inside(k) for k in kept):
            kept.append(b)
    return sorted((k[0], k[1]) for k in kept)


def test_greedy_suppression_on_a_hot_page(spark):
    pick = random.Random(11)
    data = []
    for i in range(400):
        page = 1 if i % 3 else 2
        size = pick.choice([20.0, 60.0, 150.0, 300.0])
        data.append((page, i, float(pick.randint(0, 300)), float(pick.randint(0, 300)), size, size * pick.choice([0.5, 1.0])))
    data += [(1, 1000 + i, 5.0, 5.0, 50.0, 50.0) for i in range(50)]
    df = spark.createDataFrame(data, "page_id int, item_id int, x double, y double, width double, height double")
    got = suppress.greedy_keep(df, ["page_id"], "item_id", PIXEL, PIXEL_TILE, suppress.LAYOUT_NESTED)
    assert rows(got, "page_id", "item_id") == brute_keep(data)


def test_ordered_helpers_cross_buckets(spark):
    pick = random.Random(5)
    data = [(1 if i % 3 else 2, i, pick.choice([0.0, 1.5, 2.0, 7.25, 300.0]), pick.randint(0, 3)) for i in range(120)]
    df = spark.createDataFrame(data, "g int, id int, v double, n int")
    placed = {(r.g, r.id): r.place for r in ordering.row_places(df, ["g"], ["v", "id"], 2.0).collect()}
    back = {(r.g, r.id): r.prev_v for r in ordering.previous_values(df, ["g"], ["v", "id"], 2.0, ["v"]).collect()}
    total = {(r.g, r.id): r.t for r in ordering.running_total(df, ["g"], ["v", "id"], 2.0, "n", "t").collect()}
    for g in (1, 2):
        mine = sorted([d for d in data if d[0] == g], key=lambda d: (d[2], d[1]))
        for k, d in enumerate(mine):
            assert placed[(g, d[1])] == k + 1
            assert back[(g, d[1])] == (mine[k - 1][2] if k else None)
            assert total[(g, d[1])] == sum(m[3] for m in mine[: k + 1])


def brute_clusters(values, tol, rule):
    groups = []
    for v in sorted(values):
        near = [g for g in (groups if rule == "any" else groups[-1:]) if abs(v - (g[-1] if rule == "last" else sum(g) / len(g))) <= tol]
        (near[0] if near else groups.append([]) or groups[-1]).append(v)
    return [(round(sum(g) / len(g), 6), len(g)) for g in groups]


def test_axis_clusters(spark):
    pick = random.Random(7)
    values = [pick.randint(0, 160) / 2 for _ in range(150)]
    df = spark.createDataFrame([(1, v, 3.0) for v in values], "g int, v0 double, tol double")
    for rule in ("last", "mean", "any"):
        got = clusters.cluster_centres(clusters.axis_clusters(df, ["g"], "v0", "tol", rule), ["g"]).orderBy("cluster").collect()
        assert [(round(r.centre, 6), r["size"]) for r in got] == brute_clusters(values, 3.0, rule), rule


def test_publish_flow_blocks(spark, monkeypatch):
    monkeypatch.setattr(jobs, "BLOCK", 7)
    pick = random.Random(2)
    data = [(1 if i % 4 else 2, i, pick.choice(jobs.STATES[1:])) for i in range(90)]
    df = spark.createDataFrame(data, "job_id int, seq long, status string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 400))
    got = {r.seq: (r.before, r.legal) for r in jobs.publish_flow(df).collect()}
    at = {1: "none", 2: "none"}
    for job, seq, status in data:
        legal = (at[job], status) in jobs.LEGAL
        assert got[seq] == (at[job], legal)
        at[job] = status if legal else at[job]


def test_job_failure_message(spark):
    df = spark.createDataFrame([(1, 1, "queued", None), (1, 2, "processing", None), (1, 3, "failed", None), (2, 4, "queued", None), (2, 5, "completed", "{}")],
                               "job_id int, seq long, status string, payload string").withColumn("ts", F.timestamp_seconds("seq"))
    assert rows(jobs.poll(jobs.job_states(df)), "job_id", "status", "error") == [(1, "failed", "OCR job failed."), (2, "completed", None)]


def test_projection_falls_back(spark):
    field = spark.createDataFrame([(1, 1, 0.2, 0.2, 0.3, 0.1), (1, 2, 0.8, 0.2, 0.3, 0.1)], "page_id int, field_id int, x_ratio double, y_ratio double, width_ratio double, height_ratio double")
    far = spark.createDataFrame([(1, 1.0, 0.0, 0.1, 0.0, 1.0, 0.0)], "page_id int, m11 double, m12 double, m13 double, m21 double, m22 double, m23 double")
    got = rows(fields.project_fields(field, far), "field_id", "x_ratio", "width_ratio", "outside_image_clipped", "zero_area")
    assert got == [(1, 0.3, 0.3, False, False), (2, 0.9, 0.1, True, False)]
    away = far.withColumn("m13", F.lit(5.0))
    assert rows(fields.project_fields(field, away), "field_id", "x_ratio", "zero_area") == [(1, 0.2, True), (2, 0.8, True)]


def test_collapse_is_rebuilt(spark):
    cells = [(1, 0, 0, "key", 10.0, 8.0, 60.0, 14.0), (1, 0, 1, "sum", 120.0, 8.0, 60.0, 14.0), (1, 1, 0, "a", 10.0, 40.0, 60.0, 160.0), (1, 1, 1, "b", 120.0, 40.0, 60.0, 160.0)]
    model = spark.createDataFrame(cells, "group_id int, row_no int, col_no int, text string, x double, y double, width double, height double").selectExpr("*", "1 AS row_span", "1 AS col_span")
    seen = [(1, 2 * r + c, f"t{r}{c}", 0.9, 10.0 + 110 * c, 60.0 + 32 * r) for r in range(4) for c in range(2)]
    boxes = spark.createDataFrame(seen, "group_id int, box_id int, text string, confidence double, x double, y double").selectExpr("*", "60D AS width", "14D AS height")
    rebuilt, verdict = repair.repair_collapse(model, boxes)
    assert rows(verdict, "recovered_rows", "recovered_columns", "selected") == [(5, 2, True)]
    assert rows(rebuilt.filter("row_no > 0"), "row_no", "col_no", "text") == [(r + 1, c, f"t{r}{c}") for r in range(4) for c in range(2)]


def test_files_and_json(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b" \n" * 750 + b"%PDF-1.4 x")
    (tmp_path / "b.bin").write_bytes(b"\x89PNG")
    found = files.read_files(spark, str(tmp_path))
    assert [r[0] for r in rows(files.sniff(found), "source_type", "length")] == ["image", "pdf"]
    totals, shown = files.retention_scan(found, hours=24)
    assert rows(totals, "candidate_count", "candidate_bytes", "truncated") == [(0, 0, False)] and shown.count() == 0
    df = spark.createDataFrame([("{\"k\": 1}",), ("oops",), ("",), (None,)], "t string")
    assert [r.v for r in df.select(responses.load_json(F.col("t"), "k int")["k"].alias("v")).collect()] == [1, None, None, None]


def test_responses_of_any_shape(spark):
    """Boxes, labels and scores under every key of the detectors, at any depth; what cannot be read is a reject row."""
    def body(value):
        return json.dumps(value)

    shapes = [
        (1, body({"pages": [{"blocks": [{"layout_bbox": [1, 2, 3, 4], "block_type": "table", "prob": 0.5, "parts": [{"poly": [[5, 6], ["9", 8]], "category": "figure"}]}]}]})),
        (2, body([{"box": [[0, 1], [2, 3]], "region_type": "text", "score": 1}, {"coordinate": [1, 1, 2, 2], "layout_type": "chart", "confidence": 0.25}])),
        (3, body({"boxes": {"a": {"coordinates": [1, 1, 2, 2], "score": "high", "prob": 0.75}, "b": {"x": 1, "y": 2, "width": "3", "height": 4}}})),
        (4, body({"bbox": [], "label": "seal"})),
        (5, "{cut"), (6, None), (7, " "),
        (8, body({"out": [{"res": {"dt_polys": [[[0, 0], [4, 5]], [], [[1, 1], [2, 2]]], "dt_scores": [0.5, 0.5]}}, {"bbox": [1, 2, 3, 4]}]})),
        (9, body({"dt_polys": [[]], "items": [{"points": [[1, 2], [3, 4]]}]})),
    ]
    df = spark.createDataFrame(shapes, "page_id long, body string").repartition(3)
    assert rows(responses.detection_items(df, "page_id", "body"), "page_id", "nth", "kind", "score", "left", "top", "right", "bottom") == [
        (1, 0, "table", 0.5, 1, 2, 3, 4), (1, 1, "figure", 0.0, 5, 6, 9, 8), (2, 0, "text", 1.0, 0, 1, 2, 3), (2, 1, "chart", 0.25, 1, 1, 2, 2),
        (3, 0, "text", 0.75, 1, 1, 2, 2), (3, 1, "text", 0.0, 1, 2, 4, 6), (8, 0, "text", 0.5, 0, 0, 4, 5), (8, 2, "text", 0.0, 1, 1, 2, 2), (9, 0, "text", 0.0, 1, 2, 3, 4),
    ]
    assert rows(responses.rejected_items(df, "page_id", "body"), "page_id", "nth", "reason") == [
        (4, 0, "no_usable_box"), (5, 0, "malformed_body"), (8, 1, "no_usable_box"), (9, 1, "no_usable_box"),
    ]
    texts = [(1, body({"result": [{"lines": {"label": " a\t", "prob": 1}}, {"rec_text": "b", "rec_score": 0.5, "text": "a"}]})), (2, body([{"text": "x", "score": 0.25}])), (3, None), (4, "[")]
    df = spark.createDataFrame(texts, "page_id long, body string")
    assert rows(responses.recognition(df, "page_id", "body"), "page_id", "text", "confidence") == [(1, "a b", 0.75), (2, "x", 0.25), (3, "", 0.0), (4, "", 0.0)]
    assert rows(responses.readings(df, "page_id", "body").filter("reason IS NOT NULL"), "page_id") == [(4,)]


def test_layout_items_beside_polygons(spark):
    """Table and image items count whatever polygons stand beside them; odd shapes, deep bodies and key order included."""
    deep = '{"a":' * 60 + '{"bbox":[0,0,1,1]}' + "}" * 60
    shapes = [
        (1, '{"res":{"dt_polys":[[[0,0],[1,1]]]},"items":[{"label":"table","bbox":[0,0,5,5]},{"label":"text","bbox":[1,1,2,2]},{"type":"figure_title","label":"x","box":[[1,2],[3,4]]}]}'),
        (2, '{"z":{"label":"Seal","bbox":[1,2,3,"4"],"points":[[1,2],[3,4]]},"a":{"label":"chart","x":1,"y":2,"width":"3","height":4}}'),
        (3, deep), (4, '{"bbox": [true, 1, 2, 3], "label": "pic"}'), (5, '{"a":1,"a":{"bbox":[1,2,3,4]}}'), (6, "3"), (7, '[[[{"label":"logo","poly":[[1,1],[2,"3"],"x",[4]]}]]]'),
    ]
    df = spark.createDataFrame([(*r, 1, "k") for r in shapes], "page_id long, body string, nth int, kind string")
    assert rows(responses.layout_items(df, "page_id", "body"), "page_id", "nth", "kind", "left", "top", "right", "bottom") == [
        (1, 0, "table", 0, 0, 5, 5), (1, 2, "image", 1, 2, 3, 4), (2, 0, "image", 1, 2, 3, 4), (2, 1, "image", 1, 2, 4, 6), (4, 0, "image", 1, 1, 2, 3), (7, 0, "image", 1, 1, 2, 3),
    ]
    assert rows(responses.rejected_items(df, "page_id", "body"), "page_id", "reason") == [(3, "nested_too_deep"), (5, "malformed_body")]
    assert responses.detection_items(df.where("false"), "page_id", "body").count() == 0


def test_character_references_of_html(spark):
    """Every numeric reference in and out of range, named ones of the whole table, against the library's own reading."""
    import html as library

    codes = [0, 1, 8, 9, 10, 11, 13, 31, 65, 127, 128, 129, 150, 159, 160, 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFD, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 99999999999999999999]
    names = ["hellip", "mdash", "euro", "nbsp", "eacute", "amp", "lt", "CounterClockwiseContourIntegral", "NotEqualTilde", "nosuchname"]
    texts = [f"a&#{c};b" for c in codes] + [f"a&#x{c:x};b" for c in codes] + [f"a&{n};b" for n in names] + ["a & b &; &#; &#x; c", "&amp;lt;", "&#0000065;"]
    df = spark.createDataFrame([(i, f"<table><tr><td>{t}</td></tr></table>") for i, t in enumerate(texts)], "k int, html string")
    got = {r.k: r.text for r in html.table_cells(df, "k", "html").collect()}
    assert [got[i] for i in range(len(texts))] == [" ".join(library.unescape(t).split()) for t in texts]


def test_texts_with_one_left_edge_go_by_height(spark):
    data = [(1, 1, "low", 10.0, 16.0), (1, 2, "high", 10.0, 10.0), (1, 3, "right", 90.0, 12.0)]
    boxes = spark.createDataFrame(data, "group_id int, box_id int, text string, x double, y double").selectExpr("*", "40D AS width", "15D AS height", "0.9D AS confidence")
    assert rows(tables.raw_geometry_table(boxes), "row_no", "col_no", "text") == [(0, 0, "high"), (0, 1, "low"), (0, 2, "right")]
