"""Plans: what is read, what is shuffled, what runs in Python."""

import re

import pytest

from pointquarry.plans.catalogue import QUERIES


def plan(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in s.split(",") if c}


@pytest.mark.parametrize(
    "name,columns",
    [
        ("hide_noise", {"l_linenumber"}),
        ("bbox_filter", {"l_extendedprice", "l_partkey", "l_linenumber"}),
        ("return_palette", {"l_linenumber"}),
        ("coalesce_islands", {"o_custkey", "o_orderkey", "o_totalprice"}),
        ("inflight_counters", {"user_id", "event_type"}),
    ],
)
def test_only_needed_columns_are_read(spark, sf_dir, name, columns):
    text = plan(spark, sf_dir, name)
    assert read_columns(text) == columns
    assert "number_of_returns" not in text


def test_filters_reach_the_scan(spark, sf_dir):
    assert "IsNotNull(l_extendedprice)" in plan(spark, sf_dir, "bbox_filter")


@pytest.mark.parametrize("name", ["class_profile", "locate_deepest", "nearest_in_node", "ecef", "quantized_positions", "height_ramp", "coalesce_runs", "max_concurrency", "settle_detection", "pct_p50_p95_p99"])
def test_no_python_and_no_nested_loops(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", text)


@pytest.mark.parametrize("name", ["nearest_in_node", "locate_deepest", "region_cache_lookup", "pairs_within"])
def test_pairs_meet_by_keys(spark, sf_dir, name):
    assert "BroadcastNestedLoopJoin" not in plan(spark, sf_dir, name)
