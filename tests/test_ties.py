"""Twins on data full of ties: boxes with one centre in every pair."""

import glob
import os

import pytest
from compare import compare

from folioframe.plans import registry

registry.load()


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Groups of six boxes; the two of a line share one centre, every second group also the column's width."""
    folder = str(tmp_path_factory.mktemp("tied"))
    spark.range(720_000).selectExpr(
        "id div 6 AS l_orderkey", "cast(id % 6 + 1 AS int) AS l_linenumber", "(id div 6) * 7 % 2000 + (id % 2) * 7 * (id div 6 % 2) AS l_partkey",
        "(id div 2) % 100 AS l_suppkey", "'A' AS l_returnflag",
    ).coalesce(1).write.parquet(f"{folder}/made")
    (part,) = glob.glob(f"{folder}/made/*.parquet")
    os.symlink(part, f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["win01_gap_clusters", "tbl05_boundaries", "tbl06_repeated_alignment"])
def test_ties_open_one_cluster(spark, tied, name):
    ok, note = compare(spark, tied, name)
    assert ok, note
