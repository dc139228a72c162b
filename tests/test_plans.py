"""The plans that are meant: pruned scans, no all-pairs joins, no Python where columns suffice."""

import pytest

from voxloom import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["visible_points", "blend_idw", "tile_membership", "gap_fill_linear", "obj_segments"])
def test_stays_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert not any(word in text for word in ("Pandas", "ArrowEval", "BatchEvalPython", "PythonUDF"))


def test_scan_reads_only_what_it_needs(spark):
    text = plan(spark, "voxel_downsample").split("== Physical Plan ==")[1]
    assert "l_extendedprice" in text and "l_shipdate" not in text and "l_returnflag" not in text


def test_filter_reaches_the_scan(spark):
    assert "GreaterThan(s_suppkey,0)" in plan(spark, "obj_segments")


@pytest.mark.parametrize("name", ["closest_pairs_radius", "chamfer_filter"])
def test_radius_joins_are_equi_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_occlusion_aggregates_before_the_shuffle(spark):
    text = plan(spark, "visible_points").split("== Physical Plan ==")[1]
    assert "partial_min" in text
