"""Shapes of physical plans that must hold at any size."""

import os

import pytest

from quakeloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_band_join_is_an_equi_join(spark):
    p = plan(spark, "linkage_candidates")
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_as_of_pushes_down_and_limits_ranks(spark):
    p = plan(spark, "as_of_latest")
    assert "WindowGroupLimit" in p and "props" not in p.split("ReadSchema")[-1]


def test_page_is_a_top_k(spark):
    assert "TakeOrdered" in plan(spark, "event_page")


@pytest.mark.parametrize("name", ["unclassified_events", "already_represented", "source_status", "cell_counts", "slab_samples", "nearest_traces", "registry_upsert"])
def test_no_cross_joins(spark, name):
    p = plan(spark, name)
    assert "Cartesian" not in p and "NestedLoop" not in p


@pytest.mark.parametrize("name", ["catalog_summary", "quality_flags", "b_value_sweep", "mc_goodness_of_fit", "forecast_scores", "tectonic_classes", "as_of_b_value"])
def test_stays_in_the_jvm(spark, name):
    p = plan(spark, name)
    assert "Python" not in p and "InPandas" not in p and "InArrow" not in p
