"""Catalog views, lookups, counters and normalisers of template data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Accepted names of each domain.
DATA_TYPES = ("text", "number", "date", "table", "image", "address", "currency")
METHODS = ("ocr_text", "ocr_table", "paddle_thai_ocr", "table_recognition_v2", "extract_image")
REVIEWS = ("pending", "approved", "rejected")


def data_type(value: Column) -> Column:
    return F.when(value == "string", "text").when(value.isin(*DATA_TYPES), value).otherwise("text")


def extraction_method(value: Column) -> Column:
    return F.when(value == "typhoon_ocr", "paddle_thai_ocr").when(value.isin(*METHODS), value).otherwise("ocr_text")


def default_method(kind: Column) -> Column:
    return F.when(kind == "table", "table_recognition_v2").when(kind == "image", "extract_image").otherwise("paddle_thai_ocr")


def roi_mode(value: Column) -> Column:
    return F.when(value == "flexible", "flexible").otherwise("fix")


def detection_mode(value: Column) -> Column:
    return F.when(value == "main_page", "main_page").otherwise("all_pages")


def main_page(value: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(value.try_cast("int"), F.lit(1)))


def review_status(value: Column) -> Column:
    return F.when(value.isin(*REVIEWS), value).otherwise("pending")


def field_view(fields: DataFrame, pages: DataFrame, versions: DataFrame, groups: DataFrame) -> DataFrame:
    return fields.join(pages, "page_id").join(versions, "version_id").join(groups, "group_id")


def anchor_view(anchors: DataFrame, pages: DataFrame, versions: DataFrame, groups: DataFrame, categories: DataFrame) -> DataFrame:
    return field_view(anchors, pages, versions, groups).join(categories, "category_id", "left")


def version_list(versions: DataFrame, pages: DataFrame) -> DataFrame:
    """Versions with their page count; pages are counted before the join."""
    counts = pages.groupBy("version_id").agg(F.count("*").alias("page_count"))
    return versions.join(counts, "version_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0).cast("bigint")))


def lookup_by_id_or_code(values: DataFrame, catalog: DataFrame, value: str) -> DataFrame:
    """Catalog id of a value that is either an id or a code, id first: two equi joins instead of an OR."""
    by_id = catalog.select(F.col("id").cast("string").alias(value), F.col("id").alias("id_hit"))
    by_code = catalog.groupBy(F.col("code").alias(value)).agg(F.min("id").alias("code_hit"))
    return values.join(by_id, value, "left").join(by_code, value, "left").withColumn(
        "resolved_id", F.coalesce("id_hit", "code_hit")
    ).drop("id_hit", "code_hit")


def template_fields(fields: DataFrame, anchors: DataFrame) -> DataFrame:
    """Extraction fields and verification anchors as one table with the defaults of the missing columns."""
    first = fields.withColumn("source", F.lit("field")).withColumn("is_anchor", F.lit(False))
    second = anchors.withColumn("source", F.lit("anchor")).withColumn("is_anchor", F.lit(True))
    both = first.unionByName(second, allowMissingColumns=True)
    return both.withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("roi_mode", F.coalesce("roi_mode", F.lit("fix")))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def dashboard(templates: DataFrame, requests: DataFrame) -> DataFrame:
    """One row of totals by template and request status."""
    left = templates.agg(
        F.count("*").alias("template_count"), F.count_if(F.col("status") == "draft").alias("draft_template_count"),
        F.count_if(F.col("status") == "active").alias("active_template_count"),
    )
    right = requests.agg(
        F.count_if(F.col("status").isin("submitted", "in_review")).alias("pending_request_count"),
        F.count_if(F.col("status") == "rejected").alias("rejected_request_count"),
    )
    return left.crossJoin(F.broadcast(right))


def latest(rows: DataFrame, order: list[Column], n: int = 4) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def next_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("group_id").agg(
        (F.coalesce(F.max("version_number"), F.lit(0)) + 1).alias("next_version"), F.count("*").alias("version_count")
    )


def latest_per_key(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Newest row of each key by max_by, which combines before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("row")).select(key, "row.*")


def ranked(rows: DataFrame, key: str, order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)))
