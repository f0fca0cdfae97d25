"""Physical plans: what reaches the scan, where rows are exchanged, and that nothing leaves the JVM."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from racelake.catalog import views
from racelake.operators.split import time_split
from racelake.plans import results, summaries

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_position_in_a_table_needs_no_single_task(spark):
    rows = spark.range(1000).select(F.col("id").alias("t"), (F.col("id") % 7).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        split = time_split(rows, ["t"])
        found = plan(split)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    # Only the per-block counts meet in one place.
    single = [found[m.end() :].split("\n")[1] for m in re.finditer("Exchange SinglePartition", found)]
    assert len(single) == 1 and "HashAggregate(keys=[__block" in single[0]
    assert split.filter("is_train").count() == 800


def test_form_takes_one_exchange_and_no_python(spark):
    summary = spark.range(200).select(
        F.lit(2020).alias("season"),
        F.concat(F.lit("race_"), F.col("id") % 10).alias("race"),
        F.concat(F.lit("d"), F.col("id") % 20).alias("driver"),
        F.col("id").alias("race_date"),
        *[F.lit(1).alias(c) for c in ("finish_position", "position_gain", "finished_top_10", "finished_top_3", "dnf_flag")],
    )
    found = plan(summaries.driver_recent_form(summary))
    assert found.count("Exchange hashpartitioning") == 1
    assert not re.search("BatchEvalPython|ArrowEvalPython|MapIn", found)


def test_lap_summary_combines_before_the_shuffle_by_hashing(spark):
    laps = views.race_laps(spark, FOLDER).drop("position")
    laps = laps.withColumns({c: F.lit(1) for c in ("grid_position", "finish_position")}).withColumn("race_status", F.lit("x"))
    found = plan(summaries.driver_race_summary(laps))
    assert "HashAggregate" in found and "partial_sum" in found


def test_scans_read_needed_columns_and_push_filters(spark):
    rows = views.season_results(spark, FOLDER).filter("result_id > 100")
    found = plan(results.driver_stats(rows))
    orders = next(line for line in found.split("\n") if "o_orderkey" in line and "ReadSchema" in line)
    assert "GreaterThan(o_orderkey,100)" in orders
    assert "o_comment" not in orders and "o_clerk" not in orders


@pytest.mark.parametrize("name", ["driver_history", "race_features", "silver_results", "null_counts"])
def test_queries_stay_in_the_jvm(spark, name):
    from racelake.catalog.queries import QUERIES

    assert not re.search("EvalPython|MapIn(Pandas|Arrow)|FlatMapGroups", plan(QUERIES[name](spark, FOLDER)))


def test_a_plain_window_is_built_without_a_job(spark):
    from racelake.catalog.queries import QUERIES

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("history", "built only")
    QUERIES["driver_history"](spark, FOLDER)
    # Reading the footers of the tables is the only work.
    assert len(tracker.getJobIdsForGroup("history")) <= 4
    spark.sparkContext.setJobGroup("", "")
