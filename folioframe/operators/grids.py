"""Tables as readers see them: grids, header depth, header keys, row kinds, summaries and records.

Cells carry (table_id, row_no, col_no, text, row_span, col_span, hidden), and ocr_text and ground_truth where there are any: a user's correction is
what a cell says, an empty text gives way to the recognised one (`as_read`). Everything is keyed by table and
row or table and column, so a long table spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.operators.ordering import running_total
from folioframe.session import cut_lineage

MEANINGFUL = "[A-Za-z0-9ก-๙]"
ROWS_PER_BUCKET = 4096.0


def meaningful(text: Column) -> Column:
    return F.trim(text).rlike(MEANINGFUL)


def table_shapes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id").agg(
        F.expr("cast(max(row_no + row_span) AS int)").alias("row_count"),
        F.expr("cast(max(col_no + col_span) AS int)").alias("col_count"),
    )


def as_read(cells: DataFrame) -> DataFrame:
    """Cells with the text that counts: ground truth, even an empty one, before the text, before the recognised text."""
    choices = [F.col("ground_truth")] if "ground_truth" in cells.columns else []
    choices.append(F.when(F.col("text") != "", F.col("text")))
    choices += [F.col("ocr_text")] if "ocr_text" in cells.columns else []
    return cells.withColumn("text", F.coalesce(*choices, F.lit(""))).drop("ground_truth", "ocr_text")


def grid_rows(cells: DataFrame, blank_rows: bool = True) -> DataFrame:
    """One array of texts per table row, padded to the table's width; rows without a visible cell are blank, or left out if not wanted."""
    packed = as_read(cells).filter("NOT hidden").groupBy("table_id", "row_no").agg(
        F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("by_col")
    )
    shapes = table_shapes(cells)
    if blank_rows:
        every = shapes.withColumn("row_no", F.explode(F.sequence(F.lit(0), F.col("row_count") - 1)))
        joined = every.join(packed, ["table_id", "row_no"], "left")
    else:
        joined = packed.join(shapes, "table_id")
    return joined.selectExpr(
        "table_id", "row_no", "row_count", "col_count",
        "transform(sequence(0, col_count - 1), c -> coalesce(by_col[c], '')) AS texts",
    )


def cells_from_rows(rows: DataFrame) -> DataFrame:
    """The inverse: one cell per text."""
    return rows.selectExpr("table_id", "row_no", "posexplode(texts) AS (col_no, text)").selectExpr(
        "table_id", "row_no", "col_no", "text", "1 AS row_span", "1 AS col_span", "false AS hidden"
    )


def header_depth(cells: DataFrame, base: int = 1) -> DataFrame:
    """Header rows: the base count, grown while a spanned row has two child texts below and none outside."""
    visible = as_read(cells).filter("NOT hidden")
    parents = visible.filter(f"col_span > 1 AND row_no >= {base - 1}").selectExpr(
        "table_id", "row_no", "col_no AS first_col", "col_no + col_span AS end_col"
    )
    below = visible.filter(meaningful(F.col("text"))).selectExpr("table_id", "row_no - 1 AS row_no", "col_no")
    # Ranges of one row stay together, so a child is tested against all of them at once.
    ranges = parents.groupBy("table_id", "row_no").agg(F.collect_list(F.struct("first_col", "end_col")).alias("ranges"))
    return _header_rows(table_shapes(cells), below.join(ranges, ["table_id", "row_no"]), base)


def _header_rows(shapes: DataFrame, children: DataFrame, base: int) -> DataFrame:
    """shapes with header_rows; children: table_id, row_no, col_no of each text below a spanned row, ranges of that row."""
    tested = children.selectExpr(
        "table_id", "row_no", "size(filter(ranges, r -> col_no >= r.first_col AND col_no < r.end_col)) AS inside"
    )
    grown = tested.groupBy("table_id", "row_no").agg(
        F.sum("inside").alias("children"), F.count_if(F.col("inside") == 0).alias("outside")
    ).filter("children >= 2 AND outside = 0")
    order = W.partitionBy("table_id").orderBy("row_no")
    chain = grown.withColumn("nth", F.row_number().over(order)).filter(f"row_no = {base - 1} + nth - 1")
    extra = chain.groupBy("table_id").agg(F.count("*").cast("int").alias("extra"))
    return shapes.join(extra, "table_id", "left").selectExpr(
        "table_id", "row_count", "col_count", f"least(row_count, {base}) + coalesce(extra, 0) AS header_rows"
    )


def header_keys(cells: DataFrame, depth: DataFrame) -> DataFrame:
    """One key per column: distinct header texts from top to bottom, spans spread, blanks numbered."""
    # No header reaches below the deepest one, so rows beyond it stay out of the join.
    deepest = depth.agg(F.max("header_rows").alias("deepest"))
    upper = as_read(cells).filter("NOT hidden").join(F.broadcast(deepest), F.col("row_no") < F.col("deepest"))
    columns = depth.selectExpr("table_id", "explode(sequence(0, col_count - 1)) AS col_no")
    return columns.join(_column_keys(upper.join(depth, "table_id")), ["table_id", "col_no"], "left").selectExpr(
        "table_id", "col_no", "coalesce(header_key, concat('Column ', col_no + 1)) AS header_key"
    )


def _column_keys(upper: DataFrame) -> DataFrame:
    """Key of every column that has a header text; upper: the visible cells of all header rows with the depth of their table, others may be among them."""
    heads = upper.filter("row_no < header_rows").selectExpr(
        "table_id", "row_no", "col_no", "regexp_replace(trim(text), '\\\\s+', ' ') AS text", "row_span", "col_span", "header_rows", "col_count"
    ).filter("text <> ''")
    spread = heads.selectExpr(
        "table_id", "row_no AS source_row", "col_no AS source_col", "text",
        "explode(sequence(row_no, least(row_no + row_span, header_rows) - 1)) AS row_no", "col_span", "col_count",
    ).selectExpr(
        "table_id", "source_row", "source_col", "text", "row_no", "explode(sequence(source_col, least(source_col + col_span, col_count) - 1)) AS col_no"
    )
    # A later cell overwrites an earlier one in the same slot.
    slots = spread.groupBy("table_id", "row_no", "col_no").agg(
        F.max_by("text", F.struct("source_row", "source_col")).alias("text")
    )
    parts = slots.groupBy("table_id", "col_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "text"))).alias("parts"))
    return parts.selectExpr("table_id", "col_no", "array_join(array_distinct(transform(parts, p -> p.text)), ' ') AS header_key")


def row_stats(cells: DataFrame) -> DataFrame:
    """Populated cells, their outer columns and span scores of every row; a row without a visible cell has none."""
    filled = meaningful(F.col("text"))
    seen = as_read(cells).filter("NOT hidden").groupBy("table_id", "row_no").agg(
        F.count_if(filled).alias("populated"), F.min(F.when(filled, F.col("col_no"))).alias("first_col"),
        F.max(F.when(filled, F.col("col_no"))).alias("last_col"),
        F.max(F.expr("row_span > 1 OR col_span > 1")).alias("spanned"),
        F.sum(F.expr("row_span * col_span - 1")).alias("span_score"),
    )
    every = table_shapes(cells).selectExpr("table_id", "explode(sequence(0, row_count - 1)) AS row_no")
    return every.join(seen, ["table_id", "row_no"], "left").na.fill(0, ["populated", "span_score"]).na.fill(False, ["spanned"])


def upper_median(counts: DataFrame) -> DataFrame:
    """Upper median of populated counts per table, from a histogram with one entry per distinct count."""
    histogram = counts.groupBy("table_id", "populated").agg(F.count("*").alias("n"))
    return histogram.groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct("populated", "n"))).alias("h"), F.sum("n").alias("total")
    ).selectExpr(
        "table_id",
        """aggregate(h, named_struct('seen', 0L, 'v', 0L), (a, e) -> CASE WHEN a.seen <= floor(total / 2D)
            THEN named_struct('seen', a.seen + e.n, 'v', e.populated) ELSE a END, a -> a.v) AS typical""",
    )


def row_kinds(stats: DataFrame, depth: DataFrame) -> DataFrame:
    """header, empty, data or summary for each row of row_stats; summary needs two of four signs."""
    sized = stats.join(depth, "table_id")
    return _with_kinds(sized, _typical(sized)).select("table_id", "row_no", "kind")


def _typical(sized: DataFrame) -> DataFrame:
    return upper_median(sized.filter("row_no >= header_rows AND populated > 0"))


def _with_kinds(sized: DataFrame, typical: DataFrame) -> DataFrame:
    """Rows that know their table's depth, with its typical count and their kind."""
    return _kinds(sized.join(typical, "table_id", "left").withColumn("typical", F.coalesce("typical", F.lit(0).cast("bigint"))))


def _kinds(joined: DataFrame) -> DataFrame:
    """The kind of rows that know their table's depth and its typical count."""
    near_end = "row_no >= greatest(header_rows, cast(floor(row_count * 0.65D) AS int)) OR row_no >= row_count - 3"
    sparse = "typical >= 3 AND populated <= greatest(1L, floor(typical * 0.6D))"
    differs = "typical > 0 AND abs(populated - typical) >= greatest(2L, ceil(typical * 0.4D))"
    pair = (
        "populated >= 2 AND populated <= greatest(2L, ceil(col_count * 0.45D))"
        " AND last_col - first_col >= greatest(1L, floor(col_count * 0.45D))"
    )
    signs = " + ".join(f"cast(({test}) AS int)" for test in (near_end, f"({sparse}) OR ({differs})", "spanned", pair))
    return joined.selectExpr(
        "*",
        f"CASE WHEN row_no < header_rows THEN 'header' WHEN populated = 0 THEN 'empty' WHEN {signs} >= 2 THEN 'summary' ELSE 'data' END AS kind",
    )


def _measured_rows(rows: DataFrame) -> DataFrame:
    """Rows of packed_rows on the grid that have a text and lie below the header, with the facts of their table and what the rows before them say.

    All of it comes from windows over the rows of a table, so they are dealt once. A region that may be a table's summary starts
    where the populated count drops against the last five rows (`starts`); rows of a region have no more than its `sparse_limit`.
    """
    whole = W.partitionBy("table_id")
    order = whole.orderBy("row_no")
    last5 = order.rowsBetween(-5, -1)
    flat = rows.drop("cells")
    # As in header_depth: a spanned row grows the header if the row right below has two texts inside its spans and none outside.
    inside = "transform(below, c -> size(filter(ranges, r -> c >= r.first_col AND c < r.end_col)))"
    tested = flat.withColumn("row_count", F.max("row_end").over(whole).cast("int")).withColumn("col_count", F.max("col_end").over(whole).cast("int")).withColumn(
        "below", F.when(F.lead("row_no").over(order) == F.col("row_no") + 1, F.lead("cols").over(order))
    ).withColumn("grown", F.expr(
        f"coalesce(CASE WHEN size(ranges) > 0 AND size(below) > 0 THEN aggregate({inside}, 0, (s, n) -> s + n) >= 2 AND NOT exists({inside}, n -> n = 0) END, false)"
    ))
    chain = tested.withColumn("nth", F.sum(F.col("grown").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    sized = chain.withColumn("extra", F.sum(F.expr("cast(grown AND row_no = nth - 1 AS int)")).over(whole)).withColumn(
        "header_rows", F.expr("cast(least(row_count, 1) + extra AS int)")
    ).filter("populated > 0 AND row_no >= header_rows AND row_no < row_count").select(
        "table_id", "row_no", "populated", "spanned", "span_score", "cols", "row_count", "col_count", "header_rows"
    )
    place = F.row_number().over(whole.orderBy("populated"))
    middle = sized.withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn(
        "table_typical", F.max(F.expr("CASE WHEN place = floor(n / 2D) + 1 THEN populated END")).over(whole)
    ).drop("place", "n")
    history = middle.withColumn("counts", F.sort_array(F.collect_list("populated").over(last5))).withColumn(
        "scores", F.sort_array(F.collect_list("span_score").over(last5))
    ).selectExpr(
        "*", "coalesce(get(counts, cast(floor(size(counts) / 2D) AS int)), 0L) AS typical",
        "coalesce(get(scores, cast(floor(size(scores) / 2D) AS int)), 0L) AS typical_span",
    ).drop("counts", "scores")
    starting = history.selectExpr(
        "*", "row_no > header_rows AND row_count > header_rows + 1 AND col_count >= 2 AND typical >= 3"
        " AND populated <= greatest(2L, floor(typical * 0.6D)) AND typical - populated >= 2 AS starts", "greatest(2L, floor(typical * 0.65D)) AS sparse_limit",
        "row_no >= greatest(header_rows, cast(floor(row_count * 0.55D) AS int)) OR row_no >= row_count - 4 AS near_tail")
    return starting.withColumn("top_limit", F.max(F.expr("CASE WHEN starts THEN sparse_limit END")).over(whole))


def _region_rows(measured: DataFrame) -> DataFrame:
    """Rows of every region that may be a table's summary: table_id, start_row, row_no, the signs of both and the row's columns.

    At most the first rows of a sparse run can start a region, so the work stays linear in the rows.
    """
    starts = measured.filter("starts").select("table_id", F.col("row_no").alias("start_row"), "typical", "typical_span", "sparse_limit", "near_tail")
    # Rows above a limit cut the table into runs. A limit is a small number of columns, so a table has few of
    # them; a start meets only the rows of its own run. Tables without a start and columns of rows above every limit stay out.
    rows = measured.filter("top_limit IS NOT NULL").selectExpr(
        "table_id", "row_no", "populated", "spanned", "span_score", "CASE WHEN populated <= top_limit THEN cols END AS cols")
    limits = starts.select("table_id", "sparse_limit").distinct()
    marked = rows.join(limits, "table_id").withColumn("dense", F.expr("CASE WHEN populated > sparse_limit THEN 1 ELSE 0 END"))
    runs = cut_lineage(running_total(cut_lineage(marked), ["table_id", "sparse_limit"], ["row_no"], ROWS_PER_BUCKET, "dense", "run"))
    placed = starts.join(runs.select("table_id", "sparse_limit", F.col("row_no").alias("start_row"), "run"), ["table_id", "sparse_limit", "start_row"])
    members = placed.join(runs.filter("populated <= sparse_limit"), ["table_id", "sparse_limit", "run"]).filter("row_no >= start_row")
    return members.select("table_id", "start_row", "row_no", "typical", "typical_span", "near_tail", "spanned", "span_score", "cols")


def _best_regions(members: DataFrame) -> DataFrame:
    """Start and columns of each table's summary, from the rows of all its regions."""
    labels = members.selectExpr("*", "posexplode(cols) AS (at, label_col)").withColumn("label_nth", F.expr("at + 1"))
    return _best_columns(labels.selectExpr("*", "explode(slice(cols, at + 2, size(cols))) AS value_col").filter("label_col < value_col"))


def _best_columns(pairs: DataFrame) -> DataFrame:
    """Start and columns of each table's summary; pairs: a row of a region with two of its filled columns."""
    grouped = pairs.groupBy("table_id", "start_row", "label_col", "value_col").agg(
        F.count("*").alias("n"), F.max("typical").alias("typical"), F.max("near_tail").alias("near_tail"),
        F.max("spanned").alias("spanned"), F.max(F.expr("span_score > typical_span")).alias("changes"),
        F.min(F.expr("label_nth <= 2")).alias("compact"),
    ).withColumn("evidence", F.expr(
        "3 + cast(near_tail AS int) + cast(n >= 2 AS int) + cast(spanned AS int) + cast(changes AS int) + cast(compact AS int)"
    )).filter("evidence >= 4")
    return grouped.groupBy("table_id").agg(
        F.max(F.struct("evidence", "n", "typical", "value_col", "label_col", (-F.col("start_row")).alias("start"))).alias("best")
    ).selectExpr("table_id", "best.value_col", "best.label_col", "-best.start AS start_row")


def summary_pairs(cells: DataFrame) -> DataFrame:
    """Label and value pairs of the best summary region of each table; cells are packed into rows once."""
    rows = cut_lineage(packed_rows(cells))
    members = cut_lineage(_region_rows(cut_lineage(_measured_rows(rows))))
    taken = "array_contains(cols, label_col) AND array_contains(cols, value_col)"
    chosen = members.select("table_id", "start_row", "row_no", "cols").join(_best_regions(members), ["table_id", "start_row"]).filter(taken).drop("cols")
    texts = rows.filter("populated > 1").selectExpr("table_id", "row_no", "cols", "cells.col_no AS places", "cells.text AS texts").join(chosen, ["table_id", "row_no"])

    def named(column: str) -> str:
        """Texts of the cells at a column that count as filled."""
        return f"explode(transform(filter(arrays_zip(places, texts), c -> c.places = {column} AND trim(c.texts) RLIKE '{MEANINGFUL}'), c -> trim(c.texts)))"

    return texts.selectExpr("*", named("label_col") + " AS key").selectExpr("table_id", "row_no", "label_col", "value_col", "key", named("value_col") + " AS value")


def packed_rows(cells: DataFrame) -> DataFrame:
    """One row per table row that has a cell: its visible cells in order, the columns of the filled ones, the reach of its wide cells, how far its cells
    reach, and its span statistics as in row_stats."""
    seen = as_read(cells).withColumn("visible", ~F.col("hidden")).withColumn("filled", F.col("visible") & meaningful(F.col("text")))
    cell = F.when(F.col("visible"), F.struct("col_no", "text", "row_span", "col_span", "filled"))
    packed = seen.groupBy("table_id", "row_no").agg(
        F.max(F.expr("row_no + row_span")).alias("row_end"), F.max(F.expr("col_no + col_span")).alias("col_end"),
        F.max(F.when(F.col("visible"), F.expr("row_span > 1 OR col_span > 1"))).alias("spanned"),
        F.sum(F.when(F.col("visible"), F.expr("row_span * col_span - 1"))).alias("span_score"),
        F.sort_array(F.collect_list(cell)).alias("cells"),
    ).na.fill(0, ["span_score"]).na.fill(False, ["spanned"])
    spans = "transform(filter(cells, c -> c.col_span > 1), c -> named_struct('first_col', c.col_no, 'end_col', c.col_no + c.col_span))"
    return packed.withColumn("cols", F.expr("transform(filter(cells, c -> c.filled), c -> c.col_no)")).withColumn(
        "ranges", F.expr(f"CASE WHEN spanned AND row_no >= 0 THEN {spans} END")
    ).withColumn("populated", F.size("cols").cast("bigint"))


def key_value_records(cells: DataFrame) -> DataFrame:
    """One record per data row: header key to text for every column.

    Cells are packed into rows once; depth, keys, kinds and the summary are read off the packed rows. A row without a
    visible text is no data row, so blank rows need not be made.
    """
    rows = cut_lineage(packed_rows(cells))
    measured = cut_lineage(_measured_rows(rows))
    # Only tables with a row below the header have records.
    depth = cut_lineage(measured.groupBy("table_id").agg(
        *[F.max(n).alias(n) for n in ("row_count", "col_count", "header_rows")], F.max("table_typical").alias("typical")))

    deepest = depth.agg(F.max("header_rows").alias("deepest"))
    upper = rows.select("table_id", "row_no", "cells").join(F.broadcast(deepest), F.col("row_no") < F.col("deepest"))
    headed = upper.join(depth.select("table_id", "col_count", "header_rows"), "table_id").filter("row_no < header_rows")
    found = _column_keys(headed.selectExpr("table_id", "row_no", "col_count", "header_rows", "inline(cells)")).groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "header_key"))).alias("found"))
    heads = depth.join(found, "table_id", "left").selectExpr(
        "table_id", "row_count", "col_count", "header_rows", "typical", "transform(sequence(0, col_count - 1), c -> coalesce(found[c], concat('Column ', c + 1))) AS heads"
    )

    members = cut_lineage(_region_rows(measured))
    ends = members.groupBy("table_id", "start_row").agg(F.max("row_no").alias("end_row"))
    facts = heads.join(_best_regions(members).join(ends, ["table_id", "start_row"]), "table_id", "left")
    # A table with a row has a header row. What a record needs of the others: their texts, and the texts' columns unless these are the first ones without a gap.
    slim = rows.filter("populated > 0 AND row_no >= 1").selectExpr(
        "table_id", "row_no", "spanned", "cols", "cells.text AS texts", "CASE WHEN cells.col_no <> sequence(0, size(cells) - 1) THEN cells.col_no END AS places")
    placed = slim.join(facts, "table_id").filter("row_no >= header_rows AND row_no < row_count").selectExpr(
        "*", "cast(size(cols) AS bigint) AS populated", "get(cols, 0) AS first_col", "element_at(cols, -1) AS last_col")
    # Every row from a region's start to its end belongs to it; those with both columns are taken as its pairs.
    taken = "row_no BETWEEN start_row AND end_row AND array_contains(cols, label_col) AND array_contains(cols, value_col)"
    records = _kinds(placed.filter(f"NOT coalesce({taken}, false)")).filter("kind = 'data'")
    # Rows with a cell in every column need no lookup by column.
    by_col = "map_from_arrays(coalesce(places, sequence(0, size(texts) - 1)), texts)"
    looked_up = f"element_at(transform(array({by_col}), m -> transform(heads, (h, c) -> coalesce(m[c], ''))), 1)"
    listed = f"CASE WHEN places IS NULL AND size(texts) = col_count THEN texts ELSE {looked_up} END"
    return records.selectExpr("table_id", "row_no", f"zip_with(heads, {listed}, (h, t) -> named_struct('key', h, 'value', t)) AS entries")


def export_cells(cells: DataFrame) -> DataFrame:
    """Visible cells with defaulted spans and texts."""
    return cells.filter("NOT coalesce(hidden, false)").selectExpr(
        "table_id", "row_no", "col_no", "text", "coalesce(row_span, 1) AS row_span", "coalesce(col_span, 1) AS col_span",
        "coalesce(ocr_text, text) AS ocr_text", "coalesce(ground_truth, text) AS ground_truth",
    )
