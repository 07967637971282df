"""Export shapes: Markdown, parsed table texts, results next to their fields, nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.operators.grids import grid_rows


def markdown_tables(cells: DataFrame, number_blank_headers: bool = False) -> DataFrame:
    """One Markdown text per table. The server variant trims cells, the client variant numbers blank headers."""
    rows = grid_rows(cells, blank_rows=False)
    clean = "replace(t, '|', '/')" if number_blank_headers else "replace(trim(t), '|', '/')"
    texts = "texts"
    if number_blank_headers:
        texts = "CASE WHEN row_no = 0 THEN transform(texts, (t, i) -> CASE WHEN t = '' THEN concat('Column ', i + 1) ELSE t END) ELSE texts END"
    lines = rows.selectExpr(
        "table_id", "row_no", "row_count", "col_count",
        f"concat('| ', array_join(transform({texts}, t -> {clean}), ' | '), ' |') AS line",
    )
    packed = lines.groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("lines"),
        F.max("row_count").alias("row_count"), F.max("col_count").alias("col_count"),
    )
    # Rows without visible cells are blank lines of the grid.
    blank = "concat('| ', array_join(array_repeat('', col_count), ' | '), ' |')"
    rule = "concat('| ', array_join(array_repeat('---', col_count), ' | '), ' |')"
    dense = packed.withColumn("by_row", F.expr("map_from_entries(lines)"))
    every = f"transform(sequence(0, row_count - 1), r -> coalesce(by_row[r], {blank}))"
    return dense.withColumn("every", F.expr(every)).selectExpr(
        "table_id", f"array_join(concat(array(every[0], {rule}), slice(every, 2, row_count)), '\\n') AS markdown"
    )


def parse_tables(texts: DataFrame, column: str) -> DataFrame:
    """Rows of a table given as a JSON array of arrays, a JSON array of objects or Markdown; null otherwise."""
    t = f"trim({column})"
    nothing = f"{t} = '' OR rlike({t}, '(?i)^\\\\(?no\\\\s+text\\\\s+found\\\\s+in\\\\s+roi\\\\)?$')"
    step = texts.withColumn("json_rows", F.expr(f"CASE WHEN rlike({t}, '^\\\\[\\\\s*\\\\[') THEN from_json({t}, 'array<array<string>>') END"))
    step = step.withColumn("json_maps", F.expr(f"CASE WHEN rlike({t}, '^\\\\[\\\\s*\\\\{{') THEN from_json({t}, 'array<map<string,string>>') END"))
    step = step.withColumn("keys", F.expr("array_distinct(flatten(transform(json_maps, m -> map_keys(m))))"))
    lines = f"filter(transform(split({t}, '\\\\r?\\\\n'), l -> trim(l)), l -> contains(l, '|'))"
    split = (
        f"filter(transform({lines}, l -> transform(split(regexp_replace(regexp_replace(l, '^\\\\|', ''), '\\\\|$', ''), '\\\\|'), c -> trim(c))),"
        " r -> NOT forall(r, c -> rlike(c, '^:?-{3,}:?$')))"
    )
    step = step.withColumn("marked", F.expr(split))
    parsed = f"""CASE WHEN {nothing} THEN NULL WHEN json_rows IS NOT NULL THEN transform(json_rows, r -> transform(r, c -> coalesce(c, '')))
        WHEN json_maps IS NOT NULL THEN concat(array(keys), transform(json_maps, m -> transform(keys, k -> coalesce(m[k], ''))))
        WHEN size(marked) >= 2 THEN marked END"""
    return step.withColumn("rows", F.expr(parsed)).drop("json_rows", "json_maps", "keys", "marked")


def match_fields(results: DataFrame, fields: DataFrame) -> DataFrame:
    """Each result with its field: same page and id, then any page and id when the result has no page, then
    same page and name. The first field in order wins, so fields collapse to one per key before the joins.

    A missing page of a field is page 0. Ids are compared trimmed; blank ids and `NaN` are none and match nothing.

    results: doc_id, result_id, roi_id, page, field_name; fields: doc_id, roi_id, page, field_name, roi_order.
    """

    def plain_id() -> Column:
        text = F.regexp_replace("roi_id", r"^[\s\u00A0\uFEFF]+|[\s\u00A0\uFEFF]+$", "")
        return F.when((text != "") & (text != "NaN"), text)

    fields = fields.withColumn("own_id", F.col("roi_id")).withColumn("roi_id", plain_id()).withColumn("page", F.coalesce("page", F.lit(0)))
    results = results.withColumn("roi_id", plain_id())
    first = F.min(F.struct("roi_order", F.col("own_id").alias("id")))
    here = results.withColumn("page0", F.coalesce("page", F.lit(0)))
    by_id = fields.groupBy("doc_id", F.col("page").alias("page0"), "roi_id").agg(first.alias("m1"))
    anywhere = fields.groupBy("doc_id", "roi_id").agg(first.alias("m2"))
    by_name = fields.groupBy("doc_id", F.col("page").alias("page0"), "field_name").agg(first.alias("m3"))
    joined = here.join(by_id, ["doc_id", "page0", "roi_id"], "left").join(anywhere, ["doc_id", "roi_id"], "left").join(
        by_name, ["doc_id", "page0", "field_name"], "left"
    )
    return joined.selectExpr(
        "doc_id", "result_id",
        "CASE WHEN m1 IS NOT NULL THEN m1.roi_order WHEN page IS NULL AND m2 IS NOT NULL THEN m2.roi_order ELSE m3.roi_order END AS matched_order",
        "CASE WHEN m1 IS NOT NULL THEN m1.id WHEN page IS NULL AND m2 IS NOT NULL THEN m2.id ELSE m3.id END AS matched_roi",
        "CASE WHEN m1 IS NOT NULL THEN 'page_and_id' WHEN page IS NULL AND m2 IS NOT NULL THEN 'id' WHEN m3 IS NOT NULL THEN 'name' END AS matched_by",
    )


# Markers of image and table results.
IMAGE_MARKERS = ("image", "extract_image")
TABLE_MARKERS = ("table", "table_recognition_v2", "ocr_table")


def result_types(results: DataFrame, markers: list[str]) -> DataFrame:
    """image beats table beats text over the marker columns."""
    lowered = F.array(*[F.lower(F.coalesce(F.col(m), F.lit(""))) for m in markers])
    kind = (
        F.when(F.arrays_overlap(lowered, F.array(*map(F.lit, IMAGE_MARKERS))), "image")
        .when(F.arrays_overlap(lowered, F.array(*map(F.lit, TABLE_MARKERS))), "table")
        .otherwise("text")
    )
    return results.withColumn("result_type", kind)


def included(results: DataFrame, text: bool = True, tables: bool = True, images: bool = True) -> DataFrame:
    """Keep the result types a content switch asks for."""
    wanted = [kind for kind, on in (("text", text), ("table", tables), ("image", images)) if on]
    return results.filter(F.col("result_type").isin(wanted))


def page_documents(values: DataFrame) -> DataFrame:
    """One row per page with a JSON object of its fields; a repeated name becomes an array of its values.

    values: doc_id, page, field_name, position, value.
    """
    fields = values.groupBy("doc_id", "page", "field_name").agg(
        F.min("position").alias("first"), F.array_sort(F.collect_list(F.struct("position", "value"))).alias("all")
    )
    shown = fields.selectExpr(
        "doc_id", "page", "first",
        "substr(to_json(array(field_name)), 2, length(to_json(array(field_name))) - 2) AS name",
        "CASE WHEN size(all) = 1 THEN substr(to_json(array(all[0].value)), 2, length(to_json(array(all[0].value))) - 2)"
        " ELSE to_json(transform(all, a -> a.value)) END AS body",
    )
    return shown.groupBy("doc_id", "page").agg(
        F.expr("concat('{', array_join(transform(array_sort(collect_list(struct(first, name, body))), f -> concat(f.name, ':', f.body)), ','), '}')").alias("fields")
    )


def nested_documents(pages: DataFrame) -> DataFrame:
    """One JSON document per row with its pages in order."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"),
        F.expr(
            "concat('{\"page_count\":', count(*), ',\"pages\":[', array_join(transform(array_sort(collect_list(struct(page, fields))),"
            " p -> concat('{\"page\":', p.page + 1, ',\"fields\":', p.fields, '}')), ','), ']}')"
        ).alias("document"),
    )
