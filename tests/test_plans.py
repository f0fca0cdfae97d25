import datetime

import pytest
from pyspark.sql import functions as F

from racelake import schemas
from racelake.plans import datasets, laps, results, summaries


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(df, **key):
    for name, value in key.items():
        df = df.filter(F.col(name) == value)
    found = df.collect()
    assert len(found) == 1
    return found[0]


# Season results

FLAT = "season string, round string, raceName string, date string, circuitId string, driverId string, code string, " \
       "constructorId string, name string, grid string, position string, points string, laps string, status string"  # fmt: skip


def flat(spark, *places):
    data = [
        ("2021", str(i), "R", "2021-03-28", "c", "max", "VER", "rb", "RB", "3", place, "18.5", "57", "Finished")
        for i, place in enumerate(places)
    ]
    return spark.createDataFrame(data, FLAT)


def test_clean_results(spark):
    raw = flat(spark, "1", "R", "12")
    clean = results.clean_results(raw.union(raw))
    assert clean.columns == schemas.RESULTS.names and clean.count() == 3
    got = one(clean, round=1)
    assert (got.position, got.grid, got.points, got.date, got.given_name) == (None, 3, 18.5, datetime.date(2021, 3, 28), None)


def test_race_features_and_stats(spark):
    clean = results.clean_results(flat(spark, "1", "R", "12", "3", "10"))
    features = results.race_features(clean)
    assert rows(features.select("position", "finished_top_10", "finished_top_3", "position_gain")) == sorted(
        [(1, 1, 1, 2), (None, 0, 0, None), (12, 0, 0, -9), (3, 1, 1, 0), (10, 1, 0, -7)], key=repr
    )
    drivers, teams = results.driver_stats(clean), results.constructor_stats(clean)
    assert drivers.first().asDict() == {
        "code": "VER", "driver_num_races": 5, "driver_avg_position": 6.5, "driver_avg_points": 18.5, "driver_wins": 1,
        "driver_top10_finishes": 3, "driver_podium_finishes": 2, "driver_avg_position_gain": -3.5,
    }
    assert teams.first().constructor_wins == 3
    assert results.constructor_stats(clean, wins_within=1).first().constructor_wins == 1
    dataset = results.season_dataset(features, drivers, teams)
    assert dataset.count() == 5 and set(results.FEATURES) <= set(dataset.columns)


def test_stats_keep_only_numbers_while_combining(spark):
    stats = results.driver_stats(results.race_features(results.clean_results(flat(spark, "1"))))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_avg" in plan


def test_feature_lookup(spark):
    clean = results.clean_results(flat(spark, "1"))
    asked = [(1, "VER", "rb"), (2, "XXX", "rb"), (3, "VER", "none")]
    requests = spark.createDataFrame(
        [(i, 2024, 5, 3, "monza", d, c) for i, d, c in asked],
        "id int, season int, round int, grid int, circuit_id string, driver_id string, constructor_id string",
    )
    found = results.look_up_features(requests, results.driver_stats(clean), results.constructor_stats(clean))
    assert found.columns == ["id", *results.FEATURES, "reason"]
    reasons = {r.id: r.reason for r in found.collect()}
    assert reasons == {1: None, 2: "No driver data found", 3: "No constructor data found"}
    assert [r.id for r in results.accepted(found).collect()] == [1]
    assert results.rejected(found).count() == 2


# Laps


def raw_laps(spark, *times):
    data = [("VER", float(i + 1), t, None, None, "1;2" if i else "12", "nan", "True" if i else "None") for i, t in enumerate(times)]
    return spark.createDataFrame(
        data, "Driver string, LapNumber double, LapTime string, PitInTime string, PitOutTime string, "
        "TrackStatus string, Compound string, FreshTyre string"
    ).withColumns({"season": F.lit(2023), "grand_prix": F.lit("Great Britain")})


def test_bronze(spark):
    got = laps.bronze(raw_laps(spark, "x"), "laps", "Q").first()
    assert (got.race, got.season, got.source_table, got.session_type, got.lapnumber) == ("great_britain", 2023, "laps", "Q", 1.0)


def test_silver_without_other_tables(spark):
    bronze = laps.bronze(raw_laps(spark, "0 days 00:01:30", "NaT", "00:01:31.5"), "laps")
    silver = laps.silver(bronze)
    assert silver.columns[: len(schemas.LAPS.names)] == schemas.LAPS.names
    assert rows(silver.select("lap_number", "lap_time_ms", "compound", "fresh_tyre", "is_green", "is_raining", "grid_position")) == [
        (1, 90000.0, "UNKNOWN", False, False, False, None),
        (3, 91500.0, "UNKNOWN", True, True, False, None),
    ]
    assert dict(silver.dtypes)["lap_number"] == "int" and "session_type" in silver.columns


def test_silver_with_weather_and_results(spark):
    bronze = laps.bronze(raw_laps(spark, "90000", "90001"), "laps")
    key = {"season": F.lit(2023), "race": F.lit("great_britain")}
    names = "driver string, lap_number double, airtemp double, humidity double, pressure double, rainfall boolean, " \
            "tracktemp double, winddirection double, windspeed double"  # fmt: skip
    wet = ("VER", 1.0, 20.0, 50.0, 1000.0, True, 30.0, 180.0, 2.0)
    weather = spark.createDataFrame([wet, wet], names).withColumns(key)
    entry = ("VER", 4.0, 2.0, "Finished", "RB")
    table = "abbreviation string, gridposition double, position double, status string, teamname string"
    entries = spark.createDataFrame([entry, entry], table).withColumns(key)
    silver = laps.silver(bronze, weather, entries)
    assert rows(silver.select("lap_number", "air_temp", "is_raining", "grid_position", "finish_position", "race_status", "team_name")) == [
        (1, 20.0, True, 4, 2, "Finished", "RB"),
        (1, 20.0, True, 4, 2, "Finished", "RB"),
        (2, None, False, 4, 2, "Finished", "RB"),
    ]
    assert laps.silver(bronze, weather, entries, unique_weather=True).count() == 2
    partial = laps.silver(bronze, weather.drop("humidity"), entries).select("lap_number", "air_temp", "humidity")
    assert rows(partial) == [(1, 20.0, None), (1, 20.0, None), (2, None, None)]
    without = laps.silver(bronze, weather.drop("lap_number"), entries)
    assert without.select("air_temp").distinct().collect()[0][0] is None
    untimed = laps.silver(bronze.drop("laptime"), weather, entries)
    assert untimed.count() == 3 and untimed.filter("lap_time_ms is not null").count() == 0


def test_prepare_twice_is_the_same(spark):
    silver = laps.silver(laps.bronze(raw_laps(spark, "90000", "3 days 00:00:00"), "laps"))
    assert rows(laps.prepare(silver)) == rows(silver)


def test_flags(spark):
    df = spark.createDataFrame([(1.0, None, "5"), (None, 2.0, ""), (None, None, None)], "pit_in_time_ms double, pit_out_time_ms double, track_status string")
    got = laps.with_flags(df).select("is_pit_in_lap", "is_pit_out_lap", "is_pit_lap", "is_red_flag", "is_raining")
    assert [tuple(r) for r in got.collect()] == [(True, False, True, True, False), (False, True, True, False, False), (False,) * 5]
    assert tuple(laps.with_flags(spark.range(1)).drop("id").first()) == (False,) * 9


def test_intervals_are_stored_as_text(spark):
    df = spark.createDataFrame(
        [(datetime.timedelta(minutes=1, seconds=27, milliseconds=512),), (datetime.timedelta(days=1, seconds=1),), (datetime.timedelta(seconds=-1),), (None,)],
        "t interval day to second",
    )
    text = laps.storable(df)
    assert [r.t for r in text.collect()] == ["0 days 00:01:27.512000", "1 days 00:00:01", "-1 days +23:59:59", None]
    assert [r[0] for r in text.select(laps.duration_ms(F.col("t"))).collect()] == [87512.0, 86401000.0, None, None]


@pytest.mark.parametrize("split", [False, True])
def test_row_alignment(spark, split):
    a = spark.createDataFrame([("r", t, f"d{t}") for t in range(9)] + [("s", 0, "x")], "race string, t int, driver string")
    b = spark.createDataFrame([("r", 10 * t) for t in range(10)] + [("s", 5)], "race string, at int")
    got = laps.align_rows(a, b, ["race"], ["t"], ["at"], {"driver": "driver"}, split)
    assert rows(got) == sorted([("r", 10 * t, f"d{t}" if t < 9 else None) for t in range(10)] + [("s", 5, "x")], key=repr)


# Summaries


def silver(spark, *data):
    """(race, day, driver, team, lap, time, pit, grid, finish, status)"""
    names = "race string, day int, driver string, team_name string, lap_number int, lap_time_ms double, is_pit_lap boolean, " \
            "grid_position int, finish_position int, race_status string"  # fmt: skip
    start = F.lit("2023-01-01").cast("timestamp_ntz")
    df = spark.createDataFrame(list(data), names)
    return df.withColumns({"season": F.lit(2023), "lapstartdate": start + F.make_dt_interval("day")}).drop("day")


def test_driver_summary(spark):
    df = silver(
        spark,
        ("a", 1, "VER", "RB", 2, 90.0, True, 4, 1, None),
        ("a", 0, "VER", "RB", 1, None, None, None, 2, "Retired"),
        ("a", 2, "VER", "RB", 3, 95.0, False, 5, 1, "Finished"),
        ("a", 2, "HAM", "M", 1, 80.0, False, None, 11, None),
    )
    summary = summaries.driver_race_summary(df)
    got = one(summary, driver="VER")
    assert (got.laps_completed, got.avg_lap_time_ms, got.best_lap_time_ms, got.pit_stop_count) == (3, 92.5, 90.0, 1)
    assert (got.grid_position, got.finish_position, got.race_status) == (4, 2, "Retired")
    assert (got.position_gain, got.finished_top_10, got.finished_top_3, got.dnf_flag) == (2, 1, 1, 1)
    assert got.race_date == datetime.datetime(2023, 1, 1)
    ham = one(summary, driver="HAM")
    assert (ham.position_gain, ham.finished_top_10, ham.dnf_flag) == (None, 0, 0)
    lapped = silver(spark, ("a", 1, "VER", "RB", 2, 90.0, True, 4, 1, "+1 Lap"))
    assert summaries.driver_race_summary(lapped).first().dnf_flag == 1
    assert summaries.driver_race_summary(lapped, ["Finished", "+1 Lap"]).first().dnf_flag == 0


def test_laps_are_combined_before_the_shuffle_without_a_sort(spark):
    df = silver(spark, ("a", 1, "VER", "RB", 2, 90.0, True, 4, 1, None))
    plan = summaries.driver_race_summary(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate") > plan.rindex("SortAggregate") and "Python" not in plan


def test_start_in_milliseconds_is_the_fallback(spark):
    df = silver(spark, ("a", 1, "VER", "RB", 2, 90.0, True, 4, 1, None)).drop("lapstartdate")
    assert summaries.driver_race_summary(df.withColumn("lap_start_time_ms", F.lit(7.0))).first().race_date == 7.0


def season(spark, finishes, driver="VER", year=2023):
    data = [(f"r{i}", i, driver, "RB", 1, 90.0, False, 5, f, "Finished" if f else None) for i, f in enumerate(finishes)]
    return summaries.driver_race_summary(silver(spark, *data).withColumn("season", F.lit(year)))


def test_form(spark):
    finishes = [1, 12, None, 3, 4, 20]
    form = summaries.driver_recent_form(season(spark, finishes)).orderBy("race_date").collect()
    assert [r.avg_finish_last_3 for r in form] == [None, 1.0, 6.5, 6.5, 7.5, 3.5]
    assert [r.avg_finish_last_5 for r in form] == [None, 1.0, 6.5, 6.5, 16 / 3, 5.0]
    assert [r.top_10_count_last_5 for r in form] == [None, 1, 1, 1, 2, 3]
    assert [r.podium_count_last_5 for r in form] == [None, 1, 1, 1, 2, 2]
    assert [r.dnf_count_last_5 for r in form] == [None, 0, 0, 0, 0, 0]
    team = summaries.constructor_recent_form(summaries.constructor_race_summary(season(spark, finishes)))
    assert [r.avg_finish_last_3 for r in team.orderBy("race_date").collect()] == [None, 1.0, 6.5, 6.5, 7.5, 3.5]


def test_form_restarts_each_season_unless_carried_over(spark):
    both = season(spark, [1, 2]).union(season(spark, [3, 4], year=2024)).withColumn("race_date", F.make_date("season", F.lit(1), F.lit(1)))
    fresh = summaries.driver_recent_form(both).orderBy("season", "race").collect()
    assert [r.avg_finish_last_3 for r in fresh] == [None, 1.0, None, 3.0]
    carried = summaries.driver_recent_form(both, carry_over=True, split=True).orderBy("season", "race").collect()
    assert [r.avg_finish_last_3 for r in carried] == [None, 1.0, 1.5, 2.0]


def test_team_summary(spark):
    df = silver(
        spark,
        ("a", 1, "VER", "RB", 1, 90.0, True, 4, 1, "Finished"),
        ("a", 0, "PER", "RB", 1, 100.0, True, 4, 12, "Retired"),
        ("a", 0, "PER", "RB", 2, 110.0, True, 4, 12, "Retired"),
    )
    got = summaries.constructor_race_summary(summaries.driver_race_summary(df)).first()
    assert (got.num_drivers, got.avg_finish_position, got.best_finish_position, got.total_position_gain) == (2, 6.5, 1, -5)
    assert (got.avg_lap_time_ms, got.best_lap_time_ms, got.total_pit_stops) == (97.5, 90.0, 3)
    assert (got.top_10_finishes, got.podium_finishes, got.dnf_count) == (1, 1, 1)


# Datasets


def full_laps(spark, *data):
    """(driver, lap, time, compound)"""
    df = spark.createDataFrame(list(data), "driver string, lap_number int, lap_time_ms double, compound string")
    typed = schemas.conform(df.withColumns({"season": F.lit(2023), "race": F.lit("a"), "team_name": F.lit("RB")}), schemas.LAPS)
    return laps.with_flags(typed.withColumns({"fresh_tyre": F.lit(True), "track_status": F.lit("1")}))


@pytest.mark.parametrize("split", [False, True])
def test_lap_dataset(spark, split):
    data = [("VER", 1, 10.0, "nan"), ("VER", 2, None, "nan"), ("VER", 5, 30.0, "SOFT"), ("VER", 6, 40.0, "nan"), ("HAM", 1, 5.0, "nan")]
    rows_ = datasets.lap_dataset(full_laps(spark, *data), split)
    assert len(rows_.columns) == 34 and rows_.count() == 4
    got = [
        (r.lap_number, r.last_lap_time_ms, r.avg_lap_time_last_2, r.avg_lap_time_last_3, r.last_lap_is_green, r.target_lap_time_ms)
        for r in rows_.filter("driver = 'VER'").orderBy("lap_number").collect()
    ]
    assert got == [(1, None, None, None, None, 10.0), (5, None, 10.0, 10.0, True, 30.0), (6, 30.0, 30.0, 20.0, True, 40.0)]
    known = datasets.known_compound(rows_, split=split)
    assert rows(known.select("driver", "lap_number", "compound")) == [("VER", 1, "SOFT"), ("VER", 5, "SOFT")]


def test_lap_ml_table(spark):
    data = [("VER", 1, 10.0, "UNKNOWN"), ("VER", 2, 20.0, "SOFT"), ("VER", 3, 20.0, "nan")]
    lap_rows = datasets.lap_dataset(full_laps(spark, *data))
    drivers = summaries.driver_recent_form(season(spark, [3, 4]).withColumn("race", F.lit("a")))
    teams = summaries.constructor_recent_form(summaries.constructor_race_summary(season(spark, [3, 4])))
    table = datasets.lap_ml_table(lap_rows, drivers.limit(1), teams)
    assert "lap_context_time" not in table.columns and "driver_number" not in table.columns
    got = table.orderBy("lap_number").collect()
    assert [(r.lap_number, r.compound, r.last_lap_history_available, r.last_lap_time_ms) for r in got] == [(1, "SOFT", 0, 0.0), (2, "SOFT", 1, 10.0)]
    first = got[0]
    assert (first.tyre_life, first.stint, first.fresh_tyre, first.last_lap_is_green, first.constructor_history_available) == (0, 1, 1, 0, 0)
    assert (first.constructor_avg_finish_last_3, first.constructor_dnf_count_last_5) == (10.0, 0)


def test_race_dataset(spark):
    summary = season(spark, [1, 2, 3])
    forms = summaries.driver_recent_form(summary), summaries.constructor_recent_form(summaries.constructor_race_summary(summary))
    dataset = datasets.race_dataset(summary, *forms)
    assert len(dataset.columns) == 19 and dataset.count() == 3
    last = dataset.orderBy("race_date").collect()[-1]
    assert (last.avg_finish_last_3, last.constructor_avg_finish_last_5, last.finished_top_10) == (1.5, 1.5, 1)
