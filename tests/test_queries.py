"""Registered queries against their SQL twins. FULL=1 runs all of them, otherwise one or two per family."""

import os

import pytest
from compare import compare, duck

from folioframe.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"
QUICK = {
    "agg01_layout_signature", "sc01_top01_template_retrieval", "join05_text_outside_tables", "win07_paragraphs", "win09_nested_regions",
    "sc04_decision", "agg05_document_candidates", "win13_category_evidence", "win04_row_clusters", "tbl03_borderless_table", "join14_owner_cells",
    "agg10_table_quality", "tbl01_html_tables", "tbl19_key_value_records", "win12_refined_fields", "join13_region_matches", "join03_join04_candidate_pairs",
    "src04_detector_items", "str01_job_state_stream", "str03_publish_flow", "txt03_anchor_forms", "tbl16_region_split",
    "src05_layout_items", "src04_rejected_items", "set04_deduplicated_cells", "tbl21_gated_choice", "join07_masked_retrieval", "top01_included_template", "tbl02_grid_rows",
    "tbl19_corrected_records", "win09_flexible_regions", "join13_alignment_support",
}
NAMES = sorted(registry.QUERIES if os.environ.get("FULL") else QUICK)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    ok, note = compare(spark, SF, name, con)
    assert ok, note


def test_every_oracle_belongs_to_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
