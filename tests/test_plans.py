"""What reaches the scan, and what must not appear in a plan."""

import re

import pytest

from rillflow.plans import catalog

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"custom_aggregate"}))
def test_plans_are_native_without_cartesian_products(spark, name):
    text = plan(catalog.QUERIES[name](spark, DIR))
    assert not re.search("CartesianProduct|Python|Pandas|MapInArrow|BroadcastNestedLoopJoin", text)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.QUERIES["q2_selection"](spark, DIR))
    assert "In(l_partkey" in text and "l_comment" not in text and "l_shipdate" not in text
    text = plan(catalog.QUERIES["q8_new_users"](spark, DIR))
    assert "EqualTo(event_type,purchase)" in text and "EqualTo(event_type,signup)" in text and "props" not in text
    assert "ReadSchema: struct<user_id:bigint,ts:timestamp_ntz" in plan(catalog.QUERIES["q5_mod_counts"](spark, DIR)).replace("ts:timestamp_ntz,user_id:bigint", "user_id:bigint,ts:timestamp_ntz")


def test_windows_aggregate_before_they_shuffle(spark):
    text = plan(catalog.QUERIES["q5_hot_items"](spark, DIR))
    assert text.count("partial_") >= 3 and "Expand" not in text


@pytest.mark.parametrize("name, scans", [("q4_category_average", 2), ("q6_seller_average", 3), ("q4_mod", 2), ("twitch_trend", 2)])
def test_inputs_of_running_sums_are_made_once(spark, name, scans):
    df = catalog.QUERIES[name](spark, DIR)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("FileScan") <= scans
    if name == "q4_category_average":
        assert "ReusedExchange" in final


def test_viewer_queries_keep_one_key(spark):
    df = catalog.QUERIES["twitch_loyalty"](spark, DIR)
    df.collect()
    assert plan(df).split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_running_sums_keep_null_keys(spark):
    from pyspark.sql import functions as F

    from rillflow.operators import running

    rows = [(None, 1, 5), (None, 2, 7), ("a", 1, 1), ("a", None, 2)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    got = running.running_sums(df, ["k"], ["at"], F.col("at"), {"s": F.col("v")}).collect()
    assert sorted((r.k or "", r.at or 0, r.s) for r in got) == [("", 1, 5), ("", 2, 12), ("a", 0, 2), ("a", 1, 3)]
