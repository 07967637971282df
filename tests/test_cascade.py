"""De-duplication of assigned cells against a walk in order, and the cascade on tables of six kinds."""

import random

from folioframe.operators import cascade, dedupe
from folioframe.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


def walk(cells):
    """The ids that stay, cell after cell."""
    kept = []
    inside = lambda i, o: None not in i and None not in o and i[0] >= o[0] - 2 and i[1] >= o[1] - 2 and i[0] + i[2] <= o[0] + o[2] + 2 and i[1] + i[3] <= o[1] + o[3] + 2
    for key, text, source, row, col, box in sorted(cells, key=lambda c: (c[2] != "per_cell_ocr", c[3] or 0, c[4] or 0, c[5][1] or 0, c[5][0] or 0, c[0])):
        one = source == "per_cell_ocr"
        if text.strip() and not any(
            text.strip() == t and ((row or 0, col or 0) == (r or 0, c or 0) or (one and inside(b, box)) or (p and inside(box, b))) for _, t, p, r, c, b in kept
        ):
            kept.append((key, text.strip(), one, row, col, box))
    return {k[0] for k in kept}


def test_duplicates_at_a_place_or_inside_a_reading(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for group in range(25):
        cells = []
        for i in range(rng.randint(0, 30)):
            size = rng.choice([5, 20, 60, 200])
            box = (None,) * 4 if rng.random() < 0.1 else (float(rng.randint(0, 220)), float(rng.randint(0, 220)), float(size), float(size))
            cells.append((group * 100 + i, rng.choice(["a", " a ", "b", ""]), rng.choice(["per_cell_ocr", "detection", None]), rng.choice([0, 1, 2, None]), rng.randint(0, 2), box))
        # Readings one inside the other: every second one stays.
        cells += [(group * 100 + 50 + i, "z", "per_cell_ocr", i, 9, (float(i), float(i), 90.0 - 2 * i, 90.0 - 2 * i)) for i in range(6)]
        want |= walk(cells)
        rows += [(group, k, t, s, r, c, *b, "x") for k, t, s, r, c, b in cells]
    schema = "group_id long, box_id long, text string, source string, row_no int, col_no int, x double, y double, width double, height double, value string"
    df = spark.createDataFrame(rows, schema).repartition(6)
    got = dedupe.deduplicate_cells(df)
    assert {r.box_id for r in got.collect()} == want and got.columns == df.columns
    assert dedupe.deduplicate_cells(df.where("false")).count() == 0


def test_every_method_wins_where_it_is_called_for(spark):
    from folioframe.plans.cascade import cascade_inputs

    cells, boxes, readings, lines = (df.cache() for df in cascade_inputs(spark, SF))
    won, chosen = cascade.recognise(cells, boxes, readings, lines)
    rows = won.collect()
    tables = {r.group_id for r in boxes.select("group_id").distinct().collect()}
    assert len(rows) == len(tables) and {r.table_id for r in rows} == tables
    seen = {}
    for r in rows:
        seen.setdefault(r.table_id % 6, set()).add((r.method, r.repair))
    assert ("slanext", "none") in seen[0] and ("slanext", "structure_collapse") in seen[1] and ("slanext", "text_reassignment") in seen[2]
    assert seen[3] == {(cascade.SEMI, "none"), (cascade.RAW, "none")}
    assert seen[4] == {(cascade.BORDERLESS, "none"), (cascade.RAW, "none")}
    assert seen[5] == {(cascade.RAW, "none")}
    assert {r.group_id for r in chosen.select("group_id").distinct().collect()} == tables
    assert chosen.groupBy("group_id", "row_no", "col_no").count().where("count > 1").count() == 0


def test_gates(spark):
    """Who may enter and who wins, one table per gate."""
    facts = "table_id long, method string, final_confidence double, usable_shape boolean, has_structured_cells boolean, row_count int, column_count int, non_empty_cell_count int"
    model = [  # usable, structured, rows, try_fallback, assigned
        (1, True, True, 3, False, True), (2, True, True, 3, False, False), (3, False, True, 3, True, False), (4, False, False, 0, True, False), (5, True, False, 0, True, False), (6, False, True, 1, True, True),
    ]
    primary = spark.createDataFrame([(t, "slanext", 0.6, u, s, n, 2, 4, f, a) for t, u, s, n, f, a in model], facts + ", try_fallback boolean, assignment_passed boolean")
    semi = spark.createDataFrame([(t, cascade.SEMI, 0.9, True, True, 3, 2, 6, p) for t, p in ((1, True), (2, False), (3, True), (5, True))], facts + ", passed boolean")
    borderless = spark.createDataFrame([(t, cascade.BORDERLESS, 0.95, True, True, 3, 2, 6) for t in (1, 2, 3, 4, 5, 6)], facts)
    raw = spark.createDataFrame([(t, cascade.RAW, 0.1, True, True, 3, 2, 6) for t in (1, 2, 3, 4, 5, 6)], facts)
    got = {r.table_id: (r.method, r.reason, r.n_candidates) for r in cascade.choose(primary, semi, borderless, raw).collect()}
    assert got == {
        1: ("slanext", "slanext_passed_quality_gate", 1), 2: ("slanext", "only_valid_candidate", 1), 3: (cascade.SEMI, "forced_semi_after_empty_slanext", 2),
        4: (cascade.BORDERLESS, "ocr_table_fallback_after_unusable_slanext", 2), 5: (cascade.BORDERLESS, "higher_final_confidence", 3),
        6: (cascade.RAW, "raw_ocr_geometry_after_unusable_structure", 2),
    }
