"""Whole lakes, against the same steps in memory."""

import json

import pytest
from pyspark.sql import functions as F

from racelake.plans import datasets, laps, results, summaries
from racelake.plans.lake import Lake, run_laps, run_season_results, to_silver, write_raw_session
from racelake.schemas import RAW_LAPS
from racelake.sources.calendar import build_calendar
from racelake.sources.documents import flatten_results, read_documents


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def session(spark, season, grand_prix, drivers=("VER", "HAM"), n=4):
    meta = dict(season=season, grand_prix=grand_prix, session_type="R", source="p", ingested_at="2024-01-01")
    day = f"{season}-0{len(grand_prix) % 9 + 1}-01"
    lap = [(d, float(i), f"0 days 00:01:{30 + i}", None if i else "0 days 00:10:00", "1", "nan" if i == 1 else "SOFT") for d in drivers for i in range(1, n)]
    table = {
        "laps": spark.createDataFrame(lap, "Driver string, LapNumber double, LapTime string, PitInTime string, TrackStatus string, Compound string")
        .withColumn("LapStartDate", F.lit(day).cast("timestamp_ntz")),
        "lap_weather": spark.createDataFrame(
            [(d, float(i), 20.0, 50.0, 1000.0, i == 2, 30.0, 180.0, 2.0) for d in drivers for i in range(1, n)],
            "driver string, lap_number double, AirTemp double, Humidity double, Pressure double, Rainfall boolean, "
            "TrackTemp double, WindDirection double, WindSpeed double",
        ),
        "results": spark.createDataFrame(
            [(d, float(k + 2), float(k + 1), "Finished", "T") for k, d in enumerate(drivers)],
            "Abbreviation string, GridPosition double, Position double, Status string, TeamName string",
        ),
    }
    return {name: laps.with_metadata(df, **meta) for name, df in table.items()}


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    built = Lake(spark, str(tmp_path_factory.mktemp("lake")))
    for season, race in [(2022, "Spain"), (2022, "Great Britain"), (2023, "Spain")]:
        for name, df in session(spark, season, race).items():
            if (season, name) != (2023, "results"):
                write_raw_session(built, name, df)
    run_laps(built)
    return built


def test_layers(spark, lake):
    silver = lake.read("silver", "laps")
    assert silver.groupBy("season", "race").count().count() == 3 and silver.count() == 18
    assert silver.filter("season = 2023 and team_name is not null").count() == 0
    assert silver.filter("is_raining").count() == 6
    summary = lake.read("gold", "driver_race_summary")
    assert rows(summary) == rows(summaries.driver_race_summary(silver))
    form = summaries.driver_recent_form(summary)
    assert rows(lake.read("gold", "driver_recent_form")) == rows(form)
    assert lake.read("gold", "prediction_dataset").count() == 6
    ml = lake.read("gold", "lap_ml_table")
    again = datasets.lap_ml_table(datasets.lap_dataset(silver), form, summaries.constructor_recent_form(summaries.constructor_race_summary(summary)))
    assert rows(ml) == rows(again.select(ml.columns)) and ml.filter("compound <> 'SOFT'").count() == 0


def test_rerun_of_one_season_leaves_the_others(spark, lake):
    before = rows(lake.read("silver", "laps").filter("season = 2022"))
    write_raw_session(lake, "laps", session(spark, 2023, "Spain", n=6)["laps"])
    one = Lake(spark, lake.root, seasons=[2023])
    run_laps(one)
    after = lake.read("silver", "laps")
    assert after.filter("season = 2023").count() == 10 and rows(after.filter("season = 2022")) == before


def test_a_race_that_loses_its_times_leaves_silver_and_gold(spark, tmp_path):
    built = Lake(spark, str(tmp_path))
    for race in ("Spain", "Great Britain"):
        for name, df in session(spark, 2022, race).items():
            write_raw_session(built, name, df)
    for name, df in session(spark, 2021, "Spain").items():
        write_raw_session(built, name, df)
    run_laps(built)
    again = session(spark, 2022, "Spain")["laps"].withColumn("LapTime", F.lit("NaT"))
    write_raw_session(built, "laps", again)
    one = Lake(spark, built.root, seasons=[2022])
    run_laps(one)
    for layer, table in (("silver", "laps"), ("gold", "driver_race_summary"), ("gold", "lap_prediction_dataset")):
        left = rows(built.read(layer, table).select("season", "race").distinct())
        assert left == [("great_britain", 2022), ("spain", 2021)], table


def test_session_types_stay_apart(spark, tmp_path):
    built = Lake(spark, str(tmp_path))
    for kind, n in (("R", 4), ("Q", 3)):
        frame = session(spark, 2022, "Spain", n=n)["laps"].withColumn("session_type", F.lit(kind))
        write_raw_session(built, "laps", frame)
    assert built.read("raw", "laps").count() == 10
    run_laps(built)
    assert rows(built.read("bronze", "laps").groupBy("session_type").count()) == [(6, "R")]


def test_calendar_limits_sessions(spark, tmp_path):
    small = Lake(spark, str(tmp_path))
    for race in ("Spain", "Great Britain"):
        write_raw_session(small, "laps", session(spark, 2022, race)["laps"])
    run_laps(small, spark.createDataFrame([(2022, 0, "Great Britain")], "season int, race_order int, race string"))
    assert [r.race for r in small.read("silver", "laps").select("race").distinct().collect()] == ["great_britain"]


def test_two_races_in_one_country(spark, tmp_path):
    built = Lake(spark, str(tmp_path))
    for event, n in (("Emilia Romagna Grand Prix", 3), ("Italian Grand Prix", 5)):
        for name, df in session(spark, 2022, "Italy", n=n).items():
            write_raw_session(built, name, df.withColumn("event_name", F.lit(event)), identity="event_name")
    events = spark.createDataFrame(
        [(2022, 1, "Emilia Romagna Grand Prix", "Italy"), (2022, 2, "Italian Grand Prix", "Italy"), (2022, 0, "Test", "Italy")],
        "season int, event_order int, event_name string, country string",
    )
    run_laps(built, build_calendar(events, race="event_name"))
    stored = built.read("gold", "lap_ml_table").select("race").distinct()
    assert rows(stored) == [("emilia_romagna_grand_prix",), ("italian_grand_prix",)]
    assert rows(built.read("silver", "laps").groupBy("race").count()) == [(4, "emilia_romagna_grand_prix"), (8, "italian_grand_prix")]


def test_absent_laps_are_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        to_silver(Lake(spark, str(tmp_path)))


def test_season_results(spark, tmp_path):
    def race(season, number):
        result = {"Driver": {"driverId": "d", "code": "D"}, "Constructor": {"constructorId": "t", "name": "T"},
                  "grid": "2", "position": str(number), "points": "1", "laps": "5", "status": "Finished"}
        return {"season": str(season), "round": str(number), "raceName": "R", "date": f"{season}-01-0{number}",
                "Circuit": {"circuitId": "c", "circuitName": "C"}, "Results": [result]}

    for season in (2021, 2022):
        (tmp_path / f"results_{season}.json").write_text(json.dumps({"Races": [race(season, n) for n in (1, 2)]}, indent=1))
    lake = Lake(spark, str(tmp_path / "lake"))
    run_season_results(lake, [str(tmp_path / f"results_{s}.json") for s in (2021, 2022)])
    clean = results.clean_results(flatten_results(read_documents(spark, str(tmp_path / "results_*.json"))))
    assert rows(lake.read("silver", "season_results")) == rows(clean)
    expected = results.season_dataset(results.race_features(clean), results.driver_stats(clean), results.constructor_stats(clean))
    assert rows(lake.read("gold", "season_dataset")) == rows(expected)


def test_unknown_format_is_not_taken_for_an_absent_table(spark, tmp_path):
    with pytest.raises(Exception, match="no_such_format"):
        Lake(spark, str(tmp_path), fmt="no_such_format").read_optional("raw", "laps", RAW_LAPS)
