"""What stored layouts save: exchanges, scans, sorts; and what a failed run leaves."""

import glob
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from racelake.plans import datasets, lake as lake_plans, results, summaries, training
from racelake.plans.lake import Lake, lap_rows_for_models, to_gold, to_silver, write_careers
from racelake.sources.bucketed import Layout, layout_of, read_bucketed, stable_bucketed, write_bucketed
from racelake.sources.lookup import PART, look_up, read_lookup, write_lookup
from racelake.sources.ordered_tables import write_in_order
from racelake.sources.tables import read_table, replace_partitions, stored_values, write_table


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df) -> str:
    df.collect()
    return plan(df)


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def silver(spark, seasons=(2021, 2022, 2023), races=4, drivers=6, laps=5):
    keys = spark.range(len(seasons) * races * drivers * laps).select(
        F.element_at(F.array(*[F.lit(s) for s in seasons]), (F.col("id") % len(seasons)).cast("int") + 1).alias("season"),
        (F.floor(F.col("id") / len(seasons)) % races).alias("n"),
        (F.floor(F.col("id") / len(seasons) / races) % drivers).alias("d"),
        (F.floor(F.col("id") / len(seasons) / races / drivers) + 1).cast("int").alias("lap_number"),
    )
    known = {
        "race": F.concat(F.lit("race_"), F.col("n")),
        "driver": F.concat(F.lit("d"), F.col("d")),
        "driver_number": F.col("d").cast("string"),
        "team_name": F.concat(F.lit("t"), F.col("d") % 3),
        "lapstartdate": F.make_timestamp_ntz(F.col("season"), F.col("n") + 1, F.lit(1), F.lit(12), F.col("lap_number"), F.lit(0)),
        "lap_time_ms": (F.lit(90000) + F.col("d") * 100 + F.col("lap_number")).cast("double"),
        "compound": F.when(F.col("lap_number") % 2 == 0, "SOFT"),
        "grid_position": (F.col("d") + 1).cast("int"),
        "finish_position": ((F.col("d") + F.col("n") + F.col("season")) % drivers + 1).cast("int"),
        "race_status": F.when(F.col("d") == 0, "Engine").otherwise("Finished"),
    }
    bare = keys.withColumns(known).drop("n", "d")
    flags = {c: F.lit(c == "is_green") for c in datasets.CONDITIONS if c.startswith("is_") or c == "fresh_tyre"}
    ints = {c: F.lit(1) for c in ("position", "stint", "tyre_life")}
    weather = {c: F.lit(1.0) for c in datasets.CONDITIONS if c not in flags and c not in ints and c != "compound"}
    return bare.withColumns({**flags, **ints, **weather})


# Buckets -------------------------------------------------------------------------------------------------------


def test_bucketed_table_keeps_its_layout(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).select((F.col("id") % 3).cast("int").alias("season"), F.col("id").cast("string").alias("k"), "id")
    layout = Layout(4, ("k",), ("id",), ("season",))
    write_bucketed(df, path, layout)
    assert layout_of(spark, path) == layout and rows(read_bucketed(spark, path)) == rows(df)
    # A run over one season, asking for other buckets: the table keeps its own, and the other seasons their rows.
    write_bucketed(df.filter("season = 1 and id < 50"), path, Layout(9, ("k",), (), ("season",)), within=[1])
    assert layout_of(spark, path) == layout
    assert rows(read_bucketed(spark, path)) == rows(df.filter("season <> 1 or id < 50"))
    # A season without rows is emptied.
    write_bucketed(df.filter("id < 0"), path, layout, within=[2])
    assert rows(read_bucketed(spark, path)) == rows(df.filter("season = 0 or (season = 1 and id < 50)"))
    assert read_table(spark, path).count() == read_bucketed(spark, path).count()
    with pytest.raises(ValueError, match="laid out"):
        write_bucketed(df, path, Layout(4, ("id",), (), ("season",)))


def test_laps_stay_where_they_are_stored(spark, tmp_path, no_broadcast):
    lake = Lake(spark, str(tmp_path))
    lake.write_by_driver(silver(spark), "silver", "laps")
    to_gold(lake)
    laps = lake.read_by_driver("silver", "laps")
    # Windows, summaries and the join with history: nothing at lap grain is exchanged.
    assert "Exchange" not in plan(datasets.lap_dataset(laps))
    assert "Exchange" not in plan(summaries.driver_race_summary(laps))
    ml = lap_rows_for_models(lake)
    found = plan(ml)
    assert "SortMergeJoin" in found and "Exchange" not in found
    by_hand = datasets.lap_ml_table(
        datasets.lap_dataset(laps), lake.read("gold", "driver_recent_form"), lake.read("gold", "constructor_recent_form")
    )
    assert rows(ml) == rows(by_hand) == rows(lake.read("gold", "lap_ml_table")) and ml.count() > 0


def test_laps_are_dealt_to_their_buckets_once(spark, tmp_path, no_broadcast, monkeypatch):
    """Silver laps are joined in the buckets that they are stored in, with Spark's default settings, and by code that is
    short enough for Java to compile; a table keeps the number of buckets that it has."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before, found = spark.conf.get(key), []
    spark.conf.set(key, "true")
    try:
        lake = Lake(spark, str(tmp_path))
        made = silver(spark).select("season", "race", "driver", F.col("lap_number").alias("lapnumber"), "lap_time_ms")
        laps = made.withColumnRenamed("lap_time_ms", "laptime").withColumn("laptime", F.col("laptime").cast("string"))
        lake.write_sessions(laps, "bronze", "laps", ["season", "race"])
        weather = {c: F.lit(1.0) for c in ("airtemp", "humidity", "pressure", "tracktemp", "winddirection", "windspeed")}
        seen = made.withColumnRenamed("lapnumber", "lap_number").drop("lap_time_ms").withColumns({**weather, "rainfall": F.lit(False)})
        lake.write_sessions(seen, "bronze", "lap_weather", ["season", "race"])
        write = lake_plans.write_bucketed

        def spy(df, *rest):
            found.append((plan(df), spark.conf.get("spark.sql.codegen.hugeMethodLimit")))
            write(df, *rest)

        monkeypatch.setattr(lake_plans, "write_bucketed", spy)
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        to_silver(lake)
        to_silver(Lake(spark, str(tmp_path), buckets=lake.buckets + 3))
        assert spark.conf.get(key) == "true" and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535"
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    for text, limit in found:
        exchanges = re.findall(r"Exchange hashpartitioning\((.*?)\), ", text)
        assert len(exchanges) == 2 and {re.sub(r"#\d+", "", e) for e in exchanges} == {f"race, driver, {lake.buckets}"}
        assert limit == "8000"
    stored = lake.read_by_driver("silver", "laps")
    assert stored.count() == made.count() and stored.filter("air_temp = 1.0").count() == made.count()


def test_history_of_drivers_with_two_teams_and_unknown_ones(spark):
    form = spark.createDataFrame(
        [(1, "r", "a", "x", 1.0), (1, "r", "a", "y", 2.0), (1, "r", "b", None, 3.0), (1, "r", None, "x", 4.0)],
        "season int, race string, driver string, team_name string, v double",
    )
    form = form.withColumns({c: F.col("v") for c in summaries.FORM_NAMES}).drop("v")
    teams = form.filter("team_name = 'x'").dropDuplicates(["team_name"]).drop("driver")
    got = datasets.lap_history(form, teams)
    assert got.count() == 4
    sizes = {(r.driver, r.driver_avg_finish_last_3): sorted(r.teams) for r in got.collect()}
    assert sizes == {("a", 1.0): ["x"], ("a", 2.0): ["x"], ("b", 3.0): [], (None, 4.0): ["x"]}


def test_stable_bucketed_serves_windows(spark):
    df = stable_bucketed(spark.range(50).select((F.col("id") % 5).alias("g"), "id"), ["g"], ["id"])
    assert "Exchange" not in plan(df.groupBy("g").agg(F.sum("id"))) and df.count() == 50


# Publishing ----------------------------------------------------------------------------------------------------


def test_a_run_that_fails_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(60).select((F.col("id") % 3).alias("season"), "id")
    replace_partitions(old, path, ["season"])
    bad = old.withColumn("id", F.when(F.col("id") == 59, F.raise_error(F.lit("lost")).cast("long")).otherwise(-F.col("id")))
    for within in (None, [0, 2]):
        with pytest.raises(Exception, match="lost"):
            replace_partitions(bad, path, ["season"], within=within)
        assert rows(read_table(spark, path)) == rows(old)


def test_replaced_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(60).select((F.col("id") % 3).alias("season"), F.concat(F.lit("a b/"), F.col("id") % 2).alias("race"), "id")
    replace_partitions(old, path, ["season", "race"])
    # Season 1 loses a race, season 2 all rows; rows of season 0 are none of this run's business.
    new = old.filter("season = 0 or (season = 1 and race = 'a b/1')").withColumn("id", -F.col("id"))
    replace_partitions(new, path, ["season", "race"], within=[1, 2])
    assert rows(read_table(spark, path)) == rows(old.filter("season = 0").unionByName(new.filter("season = 1")))
    assert stored_values(spark, path, "season") == ["0", "1", "2"]
    replace_partitions(new, path, ["season", "race"])
    assert rows(read_table(spark, path)) == rows(new)
    assert stored_values(spark, str(tmp_path / "absent"), "season") == []


def test_all_seasons_are_one_job(spark, tmp_path):
    lake = Lake(spark, str(tmp_path), seasons=[2021, 2022, 2023])
    table = spark.range(300).select((F.col("id") % 3 + 2021).cast("int").alias("season"), "id")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("publish", "publish")
    lake.write(table, "gold", "t")
    first = len(tracker.getJobIdsForGroup("publish"))
    spark.sparkContext.setJobGroup("again", "again")
    lake.write(table, "gold", "t")
    again = len(tracker.getJobIdsForGroup("again"))
    spark.sparkContext.setJobGroup("other", "other")
    # The rebalancing exchange and the write; inferring the stored schema. Not one for each season.
    assert first <= 3 and again <= 5
    assert lake.read("gold", "t").count() == 300


# Careers -------------------------------------------------------------------------------------------------------


def season_rows(spark, seasons=(2020, 2021, 2022)):
    return spark.range(240).select(
        F.element_at(F.array(*[F.lit(s) for s in seasons]), (F.col("id") % len(seasons)).cast("int") + 1).alias("season"),
        F.concat(F.lit("C"), F.col("id") % 7).alias("code"),
        F.concat(F.lit("t"), F.col("id") % 3).alias("constructor_id"),
        F.when(F.col("id") % 11 != 0, (F.col("id") % 20 + 1).cast("int")).alias("position"),
        (F.col("id") % 9 + 1).cast("int").alias("grid"),
        (F.col("id") % 26).cast("double").alias("points"),
    )


def test_careers_add_up_from_shares(spark):
    df = season_rows(spark).unionByName(spark.createDataFrame([(2020, None, None, None, None, None)], season_rows(spark).schema))
    shares = results.career_shares(df, "code", results.WINNER)
    assert rows(results.merged_careers(shares, "code", "driver_")) == rows(results.driver_stats(df))
    teams = results.career_shares(df, "constructor_id", results.TOP)
    assert rows(results.merged_careers(teams, "constructor_id", "constructor_")) == rows(results.constructor_stats(df))


def test_a_rerun_reads_its_own_season(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    df = season_rows(spark)
    lake.write(df, "silver", "season_results")
    write_careers(lake)
    one = lake.of([2021])
    changed = df.withColumn("position", F.when(F.col("season") == 2021, 1).otherwise(F.col("position")))
    one.write(changed.filter("season = 2021"), "silver", "season_results")
    scan = plan(results.career_shares(one.read("silver", "season_results"), "code"))
    assert re.search(r"PartitionFilters: \[.*season.* (=|IN) .*2021", scan)
    write_careers(one)
    assert rows(read_lookup(spark, lake.path("gold", "driver_stats"))) == rows(results.driver_stats(changed))
    # A lake without shares, and a run of one season: every season gets its share.
    late = Lake(spark, str(tmp_path / "late"))
    late.write(df, "silver", "season_results")
    write_careers(late.of([2021]))
    assert rows(read_lookup(spark, late.path("gold", "constructor_stats"))) == rows(results.constructor_stats(df))


# Form across seasons -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("changed", [[2021], [2022], [2023], [2021, 2023]])
def test_carried_form_of_a_rerun(spark, tmp_path, changed):
    lake = Lake(spark, str(tmp_path), buckets=2)
    laps = silver(spark, laps=2)
    # A driver who sits a season out comes back with the form of the one before.
    laps = laps.filter("not (season = 2022 and driver = 'd4')")
    lake.write_by_driver(laps, "silver", "laps")
    to_gold(lake, carry_over=True)
    again = laps.filter(~(F.col("season").isin(changed) & (F.col("race") == "race_2")))
    one = lake.of(changed)
    one.write_by_driver(again, "silver", "laps")
    to_gold(one, carry_over=True)
    summary = summaries.driver_race_summary(again)
    assert rows(lake.read("gold", "driver_recent_form")) == rows(summaries.driver_recent_form(summary, carry_over=True))
    teams = summaries.constructor_race_summary(summary)
    assert rows(lake.read("gold", "constructor_recent_form")) == rows(summaries.constructor_recent_form(teams, carry_over=True))


def test_state_holds_the_last_races_of_everyone(spark):
    summary = summaries.driver_race_summary(silver(spark, laps=1).filter("not (season = 2022 and driver = 'd4')"))
    state = summaries.form_state(summary, "driver", summaries.DRIVER_FORM, [2021, 2022, 2023])
    counts = {(r.as_of, r.driver): r["count"] for r in state.groupBy("as_of", "driver").count().collect()}
    assert counts[2021, "d0"] == 4 and counts[2022, "d0"] == counts[2023, "d0"] == 5
    assert counts[2022, "d4"] == 4 and len(counts) == 18


# Lookup --------------------------------------------------------------------------------------------------------


def test_few_requests_read_few_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), "id")
    table = table.unionByName(spark.createDataFrame([(None, -1)], "k string, id long"))
    write_lookup(table, path, "k")
    requests = spark.createDataFrame([("k7",), ("k7",), ("k4999",), ("nobody",), (None,)], "k string")
    found = look_up(spark, path, "k", requests)
    assert rows(found) == [(4999, "k4999"), (7, "k7")]
    text = executed(found)
    assert "dynamicpruningexpression" in text and PART in text
    # Four folders at most are read, of 64.
    scan = next(n for n in _nodes(found._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan parquet"))
    assert 0 < scan.metrics().apply("numFiles").value() <= 8
    assert rows(read_lookup(spark, path)) == rows(table)


def _nodes(node):
    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.executedPlan()
    if hasattr(node, "plan") and node.nodeName().endswith("QueryStage"):
        node = node.plan()
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


# Order ---------------------------------------------------------------------------------------------------------


def test_order_survives_storage(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(20000).select((F.col("id") % 2).cast("int").alias("season"), (F.col("id") * 7919 % 20011).alias("t"), "id")
    write_in_order(df.repartition(7), path, ["t", "id"], "place", ["season"], row_group_bytes=4096)
    for season in (0, 1):
        expected = [r.id for r in df.filter(F.col("season") == season).orderBy("t", "id").collect()]
        got = read_table(spark, path).filter(F.col("season") == season).orderBy("place").collect()
        assert [r.id for r in got] == expected and [r.place for r in got] == list(range(1, len(expected) + 1))
        # Files hold ranges of time, one after the other, and row groups inside them too.
        spans, groups = [], []
        for file in glob.glob(f"{path}/season={season}/*.parquet"):
            meta = pq.ParquetFile(file)
            at = meta.schema_arrow.names.index("t")
            stats = [meta.metadata.row_group(i).column(at).statistics for i in range(meta.metadata.num_row_groups)]
            groups += [(s.min, s.max) for s in stats]
            spans.append((min(s.min for s in stats), max(s.max for s in stats)))
        for found in (sorted(spans), sorted(groups)):
            assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
        # A time filter leaves most row groups unread.
        assert len(groups) > 8 and sum(low <= 1500 and high >= 1000 for low, high in groups) <= len(groups) / 3
    assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t,1000)" in plan(read_table(spark, path).filter("t >= 1000"))


def test_lap_table_in_order(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    laps = silver(spark)
    lake.write_by_driver(laps, "silver", "laps")
    to_gold(lake, in_order=True)
    stored = lake.read("gold", "lap_ml_table")
    for season in (2021, 2022, 2023):
        got = [(r.lap_context_time, r.driver, r.lap_number) for r in stored.filter(F.col("season") == season).orderBy("time_order").collect()]
        assert got == sorted(got) and got
    one = lake.of([2022])
    one.write_by_driver(laps.filter("season = 2022 and lap_number < 5"), "silver", "laps")
    to_gold(one, in_order=True)
    again = lake.read("gold", "lap_ml_table")
    assert rows(again.filter("season <> 2022")) == rows(stored.filter("season <> 2022"))
    assert again.filter("season = 2022").agg(F.max("lap_number")).first()[0] == 4


# Run log -------------------------------------------------------------------------------------------------------


def test_logging_a_run_again_replaces_it(spark, tmp_path):
    from racelake.operators.metrics import binary_metrics, class_report, confusion_matrix

    path = str(tmp_path / "runs")
    for run, wrong in (("a b", 1), ("c", 0), ("a b", 0)):
        judged = spark.createDataFrame([(1, 1), (0, 0), (1, 1 - wrong)], "label int, prediction int")
        made = training.Trained(None, judged, binary_metrics(judged), class_report(judged), confusion_matrix(judged, (0, 1)))
        training.log_run(training.run_artefacts(made, run), path)
    got = read_table(spark, path)
    assert got.groupBy("run").count().count() == 2
    per_run = {(r.run, r.artefact): r["count"] for r in got.groupBy("run", "artefact").count().collect()}
    assert per_run == {(run, a): n for run in ("a b", "c") for a, n in (("metrics", 4), ("report", 20), ("confusion", 4))}
    assert {r.value for r in got.filter("artefact = 'metrics'").collect()} == {1.0}


def test_rerun_of_a_table_without_folders(spark, tmp_path):
    write_table(spark.range(3), str(tmp_path / "t"))
    write_table(spark.range(2), str(tmp_path / "t"))
    assert read_table(spark, str(tmp_path / "t")).count() == 2


def test_laps_are_dealt_once(spark, tmp_path):
    """From their numbering on, laps stay in their buckets: joins with weather and results and the windows move none."""
    from racelake.catalog import queries

    spark.range(400).selectExpr(
        "date_add(DATE'1995-01-01', cast(id % 70 AS int)) AS l_shipdate", "id % 7 AS l_suppkey", "id AS l_partkey", "id AS l_orderkey",
        "cast(id % 7 + 1 AS int) AS l_linenumber", "'R' AS l_returnflag", "'F' AS l_linestatus", "cast(id % 50 AS double) AS l_quantity",
        "cast(id * 10 AS double) AS l_extendedprice", "0.05D AS l_discount", "0.02D AS l_tax",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    # One supplier is unknown, one comes twice.
    spark.sql("SELECT explode(array(0, 1, 2, 3, 3, 4, 5)) AS id").selectExpr("cast(id AS bigint) AS s_suppkey", "id % 2 AS s_nationkey").write.parquet(
        str(tmp_path / "supplier.parquet")
    )
    spark.sql("SELECT 0 AS n_nationkey, 'A' AS n_name UNION ALL SELECT 1, 'B'").write.parquet(str(tmp_path / "nation.parquet"))
    silver = queries.silver_race_laps(spark, str(tmp_path))
    rows = queries.datasets.lap_dataset(silver)
    for df in (silver, rows, queries.next_known_compound(spark, str(tmp_path))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == sum(2 if i % 7 == 3 else 1 for i in range(400) if i % 7 != 6)
    # Numbers go from 1 on in each driver's race, and each lap knows the one before.
    by = ["season", "race", "driver"]
    facts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("lap_number").alias("last"), F.count("last_lap_time_ms").alias("known"))
    assert facts.filter("n <> last OR known <> n - 1").count() == 0 and facts.count() > 7
    assert spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled") == "true"


def test_a_carried_lake_exchanges_laps_once(spark, tmp_path, no_broadcast, monkeypatch):
    """Laps are dealt to the lake's buckets before they are numbered, also where a season comes again; silver laps and the
    lap table for models are written from there."""
    from racelake.catalog import lake_queries
    from racelake.sources import tables

    spark.range(600).selectExpr(
        "date_add(DATE'1995-03-01', cast(id % 3 * 365 + id % 40 AS int)) AS l_shipdate", "id % 7 AS l_suppkey", "id AS l_partkey", "id AS l_orderkey",
        "cast(id % 7 + 1 AS int) AS l_linenumber", "'R' AS l_returnflag", "'F' AS l_linestatus", "cast(id % 50 AS double) AS l_quantity",
        "cast(id * 10 AS double) AS l_extendedprice", "0.05D AS l_discount", "0.02D AS l_tax",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(7).selectExpr("id AS s_suppkey", "id % 2 AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.sql("SELECT 0L AS n_nationkey, 'A' AS n_name UNION ALL SELECT 1L, 'B'").write.parquet(str(tmp_path / "nation.parquet"))
    moved = {}

    def spied(write):
        def spy(df, path, *rest, **named):
            placed = named.get("placed", rest[-1] if rest else False) is True
            moved.setdefault(path.split("lake-")[-1].partition("/")[2], []).append((placed, plan(df).count("REPARTITION")))
            write(df, path, *rest, **named)

        return spy

    monkeypatch.setattr(lake_plans, "write_bucketed", spied(lake_plans.write_bucketed))
    monkeypatch.setattr(tables, "write_table", spied(tables.write_table))
    lake = lake_queries._carried_lake(spark, str(tmp_path))
    for table in ("silver/laps", "gold/lap_prediction_dataset", "gold/lap_ml_table"):
        assert moved[table] == [(True, 0)] * 2
    stored = lake.read("silver", "laps")
    assert stored.count() == 600 - stored.sparkSession.read.parquet(str(tmp_path / "lineitem.parquet")).filter(
        "year(l_shipdate) = 1995 and month(l_shipdate) = 3"
    ).count()
    assert rows(lake.read("gold", "lap_ml_table")) == rows(lap_rows_for_models(lake))
