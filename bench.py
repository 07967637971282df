"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from folioframe.plans import registry
from folioframe.session import local_session

HEADLINE = (
    "agg01_layout_signature",
    "sc01_top01_template_retrieval",
    "join05_text_outside_tables",
    "win07_paragraphs",
    "win09_nested_regions",
    "agg05_document_candidates",
    "sim01_sim03_anchor_scores",
    "win13_category_evidence",
    "tbl03_borderless_table",
    "join14_owner_cells",
    "agg10_table_quality",
    "tbl19_key_value_records",
    "tbl01_html_tables",
    "win12_refined_fields",
    "join01_field_view",
    "str01_job_states",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "folioframe-bench")
    registry.load()
    spark.range(1000).selectExpr("sum(id)").collect()
    timings = {}
    for name in HEADLINE:
        started = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
