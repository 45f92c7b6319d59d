"""What Spark makes of the queries: pruned scans, pushed filters, no products of tables."""

import re

import pytest

from veldmark.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j7_radius", "j8_neighbours", "j4_match", "j5_scale_invariant", "j12_band_pairs", "n2_constellations", "j6_match_arrays", "n20_nearest_by_tag", "g2_reciprocal", "j2_connectors", "v8_affine_sampling", "w6_block_sums", "a19_square_sums", "j21_region_means", "m9_painted", "n17_distance", "n19_haar_like", "n19_patch", "n21_spheres", "n22_nuclei", "sk10_exported"])
def test_no_products(spark, name):
    found = plan(spark, name)
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found


def test_pruned_and_pushed(spark):
    edges = plan(spark, "g1_edge_weights")
    assert re.search(r"ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>", edges)
    assert "StringContains(url,page=2)" in plan(spark, "pf4_substring")
    assert "In(user_id, [3,5,8])" in plan(spark, "pf11_times")


def test_partial_aggregation(spark):
    assert plan(spark, "a8_coloured_edges").count("partial_count") == 1
