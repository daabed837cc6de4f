"""Joins with a heavy key, and plans that must not hold what does not scale."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from persona_checks.queries import QUERIES
from persona_spark import scale, session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def skewed(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k"), F.col("id")
    )
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return left, right


def result(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(skewed, monkeypatch, how):
    left, right = skewed
    monkeypatch.setattr(scale, "PROBE_MAX_ROWS", 3)
    monkeypatch.setattr(scale, "BROADCAST_MAX_ROWS", 3)
    monkeypatch.setattr(scale, "HEAVY_MIN_ROWS", 50)
    monkeypatch.setattr(scale, "ROWS_PER_SALT", 100)
    salted, calls = scale.salted_join, []
    monkeypatch.setattr(scale, "salted_join", lambda *a: calls.append(a[5]) or salted(*a))
    expected = result(left.join(right, "k", how))
    for stage in (False, True):
        assert result(scale.lookup_join(left, right, ["k"], how, spread=["id"], stage=stage)) == expected
    assert len(calls) == 2 and max(calls[0].values()) >= 1000
    assert result(scale.lookup_join(left, right, ["k"], how)) == expected


def test_rows_of_a_heavy_key_are_spread(skewed):
    left, right = skewed
    heavy = scale.heavy_keys(left, ["k"], min_rows=900)
    assert list(heavy.values()) == [left.where("k = 0").count()]
    ways = scale._salt_ways(["k"], heavy, 100)
    per_salt = left.where("k = 0").groupBy(F.pmod(F.xxhash64("id"), ways).alias("s")).count().collect()
    assert len(per_salt) == 11 and max(r["count"] for r in per_salt) < 200


def test_size_check(spark):
    df = spark.range(100).withColumn("t", F.repeat(F.lit("x"), 100))
    assert scale.fits_broadcast(df, 100, 20_000)
    assert not scale.fits_broadcast(df, 99, 20_000)
    assert not scale.fits_broadcast(df, 100, 1_000)
    assert scale.staged_fits_broadcast(df) and scale.staged_fits_broadcast(df.limit(0))


def test_shared_folder(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NOT_AT_SCALE = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"refresh_stream", "page_responses", "store_upsert_on_disk", "store_fetch_on_disk"}))
def test_plans(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for bad in NOT_AT_SCALE:
        assert bad not in text
    assert name == "map_examples" or "MapInPandas" not in text
    # Every window has partition keys: in the plan the keys stand in the bracket before the order.
    for window in re.findall(r"Window \[.*", text):
        assert "], [], [" not in window
    assert "SinglePartition" not in text or name == "newest_log"


def test_scans_read_only_what_is_needed(spark):
    text = plan(QUERIES["stored_ids"](spark, SF_DIR))
    assert all("text" not in schema for schema in re.findall(r"ReadSchema: (\S+)", text))
    selected = plan(QUERIES["object_split"](spark, SF_DIR))
    assert all("text" not in schema for schema in re.findall(r"ReadSchema: (\S+)", selected))


def test_no_text_in_the_display_order_sort(spark):
    text = plan(QUERIES["display_order"](spark, SF_DIR))
    assert "text" not in text and "content" not in text
