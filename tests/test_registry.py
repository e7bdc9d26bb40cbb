"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from checks.compare import compare, connect
from checks.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SOME = (
    "s1_hotspot_scan", "s9_granule_lookup", "g9_dense_cube", "g6_cell_open_top", "n1_median_windows", "n8_opening_cross",
    "n9b_components_8", "t3_percentile_rank", "d2_residual_multiband", "d10_risk_mask", "d12c_persistence_cleanup",
    "d17b_event_detector", "m1_features", "e3_radius_join_centroids", "e6_cell_confusion", "f5_fusion_weighted", "y3_days_by_month",
)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("tables not present")
    return connect(SF)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, con, name):
    note, _, _, ok = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, note


def test_names_and_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
