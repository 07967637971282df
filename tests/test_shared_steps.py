"""Steps that several queries share: inputs derived once, and lookups and joins that stay small."""

import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from folioframe.operators import cascade, clusters, grids, repair, tables
from folioframe.plans import cascade as plan_cascade
from folioframe.plans import export, pairing, registry
from folioframe.session import cut_lineage
from folioframe.sources import html, responses

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["tbl17_header_keys", "tbl18_row_kinds", "tbl09_grid_assignment", "agg12_grid_diagnostics", "tbl10_compact_columns"])
def test_inputs_are_derived_once(spark, name):
    registry.load()
    assert "lineitem" not in "".join(registry.QUERIES[name](spark, SF).inputFiles())


@pytest.mark.parametrize("name", ["tbl14_collapse_repair", "win16_summary_pairs", "tbl21_method_cascade"])
def test_stages_go_on_from_one_staged_input(spark, monkeypatch, name):
    registry.load()
    scans = []

    def staged(df):
        scans.append(any("lineitem" in f for f in df.inputFiles()))
        return cut_lineage(df)

    for module in (repair, tables, cascade, grids, pairing, plan_cascade, export):
        monkeypatch.setattr(module, "cut_lineage", staged, raising=False)
    registry.QUERIES[name](spark, SF)
    assert sum(scans) == 1


def test_starts_name_the_clusters_of_the_mean_rule(spark):
    pick = random.Random(4)
    data = [(g, pick.randint(0, 90) / 2, 3.0) for g in range(12) for _ in range(25)]
    df = spark.createDataFrame(data, "g int, v double, tol double")
    starts = {r.g: r.starts for r in clusters.cluster_starts(df, ["g"], "v", "tol").collect()}
    for r in clusters.axis_clusters(df, ["g"], "v", "tol", "mean").collect():
        assert r.cluster == sum(s <= r.v for s in starts[r.g]) and r.n == sum(d[:2] == (r.g, r.v) for d in data)


def test_header_keys_leave_body_rows_out_of_the_join(spark):
    data = [(t, r, c, f"{r}{c}", 1, 1, False) for t, depth in ((1, 1), (2, 3)) for r in range(6) for c in range(2)]
    cells = spark.createDataFrame(data, "table_id int, row_no int, col_no int, text string, row_span int, col_span int, hidden boolean")
    depth = spark.createDataFrame([(1, 6, 2, 1), (2, 6, 2, 3)], "table_id int, row_count int, col_count int, header_rows int")
    keys = grids.header_keys(cells, depth)
    assert sorted(tuple(r) for r in keys.collect()) == [(1, 0, "00"), (1, 1, "01"), (2, 0, "00 10 20"), (2, 1, "01 11 21")]
    assert "deepest" in keys._jdf.queryExecution().optimizedPlan().toString()


def test_named_references_lie_in_small_maps(spark):
    names = [n for n in html5 if n.endswith(";")]
    found = html._named("p")
    assert max(part.count("'&") for part in found.split("map(")) < 80
    asked = spark.createDataFrame([(f"&{n}",) for n in [*names, "nosuch;", "x;", "zz", "1;"]], "p string")
    got = {r.p: r.t for r in asked.select("p", F.expr(found).alias("t")).collect()}
    assert {n: got[f"&{n}"] for n in names} == {n: html5[n] for n in names}
    assert [got[f"&{n}"] for n in ("nosuch;", "x;", "zz", "1;")] == [None] * 4


def test_records_come_from_cells_packed_once(spark):
    line = lambda row, texts: [(1, row, c, t, 1, 1, False) for c, t in enumerate(texts) if t is not None]
    data = [(1, 0, 0, "item", 1, 1, False), (1, 0, 1, "amount", 1, 2, False), (1, 0, 2, "", 1, 1, True), (1, 0, 3, "note", 1, 1, False)]
    data += line(1, ["", "net", "gross", ""])
    for row in range(2, 8):
        data += line(row, [f"a{row}", f"b{row}", f"c{row}", f"d{row}"])
    # After a missing row a summary, then a row without a text; the second table has gaps, hidden cells and no summary.
    data += line(9, ["sum", None, None, "9"]) + line(10, ["tax", "", "", "1"]) + line(11, [".", "-", "", " "])
    data += [(2, 0, 0, "k", 1, 1, False), (2, 0, 1, "v", 1, 1, False), (2, 3, 1, "x", 1, 1, False), (2, 4, 0, "y", 1, 1, False), (2, 4, 1, "z", 1, 1, True), (2, 5, 0, "gone", 1, 1, True)]
    cells = spark.createDataFrame(data, "table_id int, row_no int, col_no int, text string, row_span int, col_span int, hidden boolean")
    records = grids.key_value_records(cells)
    got = {(r.table_id, r.row_no): [tuple(e) for e in r.entries] for r in records.collect()}
    heads = ("item", "amount net", "amount gross", "note")
    want = {(1, row): list(zip(heads, (f"a{row}", f"b{row}", f"c{row}", f"d{row}"))) for row in range(2, 8)}
    assert got == {**want, (2, 3): [("k", ""), ("v", "x")], (2, 4): [("k", "y"), ("v", "")]}
    assert records._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 12


def test_records_deal_their_rows_few_times(spark, monkeypatch):
    registry.load()
    dealt = []

    def count(df):
        dealt.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))

    monkeypatch.setattr(grids, "cut_lineage", lambda df: (count(df), cut_lineage(df))[1])
    count(registry.QUERIES["tbl19_corrected_records"](spark, SF))
    assert sum(dealt) <= 15


def test_responses_are_opened_in_blocks_and_keys_looked_up(spark):
    item = '{{"label": "{0}", "bbox": [1, 2, 3, 4], "score": 0.5}}'.format
    nested = lambda depth: '{"in": ' * (depth - 1) + item(f"d{depth}") + "}" * (depth - 1)
    depths = [1, 2, responses.LEVEL_BLOCK, responses.LEVEL_BLOCK + 1, 2 * responses.LEVEL_BLOCK + 1, responses.LEVELS, responses.LEVELS + 1]
    bodies = [(d, nested(d)) for d in depths]
    bodies += [(100, f'[[{item("a{b")}], 7, "{{", {{"x": "{{}}", "deep": [{item("}{")}]}}]'), (101, f'  {{"k": "{{", "o": {item("o")}}}')]
    df = spark.createDataFrame(bodies, "page_id int, body string")
    got = sorted((r.page_id, r.nth, r.kind) for r in responses.detection_items(df, "page_id", "body").collect())
    assert got == [(d, 0, f"d{d}") for d in depths[:-1]] + [(100, 0, "a{b"), (100, 1, "}{"), (101, 0, "o")]
    assert [(r.page_id, r.reason) for r in responses.rejected_items(df, "page_id", "body").collect()] == [(responses.LEVELS + 1, "nested_too_deep")]
    # A path that a variant lacks costs an exception, so keys that may be missing are looked up in the map.
    assert "'$.label'" not in responses.LOOSE and "'$.dt_polys'" not in responses.POLYGONS
