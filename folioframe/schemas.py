"""Fixed schemas of catalog tables and readers that apply them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG = {
    "template_groups": "group_id BIGINT, name STRING, document_type STRING, category STRING",
    "template_versions": (
        "template_id BIGINT, group_id BIGINT, version_number INT, status STRING, detection_mode STRING, main_page_number INT,"
        " similarity_threshold DOUBLE, final_confidence_threshold DOUBLE, layout_weight DOUBLE, text_anchor_weight DOUBLE,"
        " image_anchor_weight DOUBLE, updated_at TIMESTAMP"
    ),
    "template_pages": "template_page_id BIGINT, template_id BIGINT, page_number INT, layout_signature_json STRING",
    "extraction_fields": (
        "field_id BIGINT, template_page_id BIGINT, field_name STRING, data_type STRING, roi_mode STRING, required BOOLEAN, sort_order INT,"
        " x_ratio DOUBLE, y_ratio DOUBLE, width_ratio DOUBLE, height_ratio DOUBLE, created_at TIMESTAMP"
    ),
    "verification_anchors": (
        "anchor_id BIGINT, template_page_id BIGINT, anchor_type STRING, expected_text STRING, match_type STRING, required BOOLEAN,"
        " weight DOUBLE, image_category STRING, sort_order INT"
    ),
    "ignore_regions": "mask_id BIGINT, template_page_id BIGINT, x_ratio DOUBLE, y_ratio DOUBLE, width_ratio DOUBLE, height_ratio DOUBLE",
    "image_categories": "pos INT, value STRING, label STRING, prompt STRING, match_threshold DOUBLE, margin_threshold DOUBLE, enabled BOOLEAN",
}


def read_catalog(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One catalog table from Parquet with its fixed schema; column pruning and filters reach the files."""
    return spark.read.schema(CATALOG[name]).parquet(f"{root}/{name}")


def read_catalog_jdbc(spark: SparkSession, url: str, name: str, properties: dict[str, str], partitions: int = 8) -> DataFrame:
    """The same table over JDBC, split on its first column so that no single task reads it all."""
    key = CATALOG[name].split()[0]
    bounds = spark.read.jdbc(url, f"(SELECT min({key}) AS lo, max({key}) AS hi FROM {name}) AS b", properties=properties).first()
    low, high = (bounds["lo"] or 0), (bounds["hi"] or 0)
    return spark.read.jdbc(
        url, name, column=key, lowerBound=low, upperBound=high + 1, numPartitions=partitions, properties=properties
    )
