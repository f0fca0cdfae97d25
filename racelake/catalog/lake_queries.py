"""Lakes that are run again in part, and stored layouts, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from racelake.catalog import views
from racelake.catalog.oracle import VIEWS, view, with_views
from racelake.catalog.queries import (
    _RATES_SQL,
    ORACLES,
    TEAM_FORM_MEANS,
    _judged,
    _requests,
    joined_race_laps,
    query,
    rounded,
    rounded_sql,
    silver_race_laps,
    stored_laps,
)
from racelake.operators.metrics import binary_metrics, class_report, confusion_matrix
from racelake.operators.relations import union_by_position
from racelake.plans import datasets, laps, results, training
from racelake.plans.lake import BUCKET_KEYS, Lake, run_season_results, to_gold
from racelake.sources import calendar, documents
from racelake.sources.bucketed import stable_bucketed, stay
from racelake.sources.lookup import read_lookup, write_lookup
from racelake.sources.ordered_tables import write_in_order
from racelake.sources.scratch import new_path, stable
from racelake.sources.tables import read_required, read_table, write_table

# A season whose results come again with other grid places, and without a third of them.
_AGAIN = 1995
view("rerun_results")(f"""
SELECT * REPLACE (CASE WHEN season = {_AGAIN} THEN 1 ELSE grid END AS grid) FROM ({VIEWS["season_results"][1]}) s
WHERE NOT (season = {_AGAIN} AND result_id % 3 = 0)""")


def _rerun_lake(spark, sf) -> Lake:
    path = new_path(spark, "lake")
    flat = views.flat_results(views.season_results(spark, sf))
    documents.write_documents(documents.nest_results(flat, ["result_id"]), f"{path}/documents")
    lake = Lake(spark, path)
    run_season_results(lake, f"{path}/documents", multi_line=False)
    again = flat.filter((F.col("season") == str(_AGAIN)) & (F.col("result_id") % 3 != 0)).withColumn("grid", F.lit("1"))
    documents.write_documents(documents.nest_results(again, ["result_id"]), f"{path}/again")
    run_season_results(lake.of([_AGAIN]), f"{path}/again", multi_line=False)
    return lake


@query("career_rerun", with_views("SELECT * FROM driver_stats", "driver_stats", instead={"season_results": "rerun_results"}))
def career_rerun(spark, sf):
    """Careers after one season came again: its shares are replaced, the others are added as they were."""
    return read_lookup(spark, _rerun_lake(spark, sf).path("gold", "driver_stats"))


@query(
    "career_rerun_teams",
    with_views("SELECT * FROM constructor_stats", "constructor_stats", instead={"season_results": "rerun_results"}),
)
def career_rerun_teams(spark, sf):
    return read_lookup(spark, _rerun_lake(spark, sf).path("gold", "constructor_stats"))


# A race that is struck from its season after all seasons were run.
_STRUCK = "season = 1995 AND race = 'race_3'"
view("rerun_laps", "race_weather", "race_results")(
    f"SELECT * FROM ({VIEWS['silver_race_laps'][1]}) s WHERE NOT ({_STRUCK})"
)
for _who, _entity in (("driver", "driver"), ("constructor", "team_name")):
    view(f"{_who}_form_carried", f"{_who}_summary")(
        VIEWS[f"{_who}_form"][1].replace(f"PARTITION BY {_entity}, season", f"PARTITION BY {_entity}")
    )


def _carried_lake(spark, sf) -> Lake:
    lake = Lake(spark, new_path(spark, "lake"))
    # Laps are dealt to the lake's buckets once, before they are numbered, and joined in its own write.
    with stay(spark):
        lake.write_by_driver(joined_race_laps(spark, sf, BUCKET_KEYS), "silver", "laps", placed=True)
    to_gold(lake, carry_over=True)
    one = lake.of([1995])
    again = stable_bucketed(one.read_by_driver("silver", "laps").filter(f"NOT ({_STRUCK})"), BUCKET_KEYS, placed=True)
    with stay(spark):
        one.write_by_driver(again, "silver", "laps", placed=True)
    to_gold(one, carry_over=True)
    return lake


@query(
    "form_carry_rerun",
    with_views("SELECT * FROM driver_form_carried", "driver_form_carried", instead={"silver_race_laps": "rerun_laps"}),
)
def form_carry_rerun(spark, sf):
    """Form across seasons after one season came again, taken up from the state that the season before left."""
    return _carried_lake(spark, sf).read("gold", "driver_recent_form")


@query(
    "form_carry_rerun_teams",
    with_views(
        rounded_sql(TEAM_FORM_MEANS, "constructor_form_carried"),
        "constructor_form_carried",
        instead={"silver_race_laps": "rerun_laps"},
    ),
)
def form_carry_rerun_teams(spark, sf):
    return rounded(_carried_lake(spark, sf).read("gold", "constructor_recent_form"), *TEAM_FORM_MEANS)


@query("feature_lookup_few", f"{ORACLES['feature_lookup']} WHERE q.season = 1995 AND q.round = 3")
def feature_lookup_few(spark, sf):
    """Features of one race's entries from stored careers, of which only their keys' folders are read."""
    rows = stable(views.season_results(spark, sf))
    path = new_path(spark, "careers")
    write_lookup(results.driver_stats(rows), f"{path}/drivers", "code")
    write_lookup(results.constructor_stats(rows), f"{path}/constructors", "constructor_id")
    requests = _requests(rows.filter("season = 1995 AND round = 3"))
    return results.look_up_stored(requests, f"{path}/drivers", f"{path}/constructors")


_REPORT_SQL = ORACLES["class_report"]
_LOG_SQL = f"""
SELECT run, artefact, entry, metric, round(value, 9) AS value FROM (
  SELECT 'metrics' AS artefact, NULL AS entry, unnest(['accuracy', 'f1', 'precision', 'recall']) AS metric,
         unnest([accuracy, CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall)
                 ELSE 0 END, precision, recall]) AS value FROM ({_RATES_SQL}) r
  UNION ALL
  SELECT 'report', class, unnest(['precision', 'recall', 'f1', 'support']), unnest([precision, recall, f1, support::DOUBLE])
  FROM ({_REPORT_SQL}) p
  UNION ALL
  SELECT 'confusion', CAST(label AS VARCHAR), unnest(['predicted_0', 'predicted_1']),
         unnest([predicted_0::DOUBLE, predicted_1::DOUBLE]) FROM ({ORACLES["confusion_matrix"]}) c) a,
  (VALUES ('first'), ('second')) v(run)"""


@query("run_log", _LOG_SQL)
def run_log(spark, sf):
    """Two runs, one of them logged twice: each has one set of numbers, report and confusion matrix."""
    judged, path = _judged(spark, sf), new_path(spark, "runs")
    artefacts = training.Trained(None, judged, binary_metrics(judged), class_report(judged), confusion_matrix(judged))
    for run in ("first", "second", "first"):
        training.log_run(training.run_artefacts(artefacts, run), path)
    return read_table(spark, path).withColumn("value", F.round("value", 9))


_TIME = ["lapstartdate", "driver", "race", "lap_number"]


@query(
    "laps_in_time_order",
    f"""
SELECT season, race, driver, lap_number, lapstartdate, lap_time_ms,
       row_number() OVER (PARTITION BY season ORDER BY {", ".join(_TIME)}) AS time_order
FROM race_laps
QUALIFY lapstartdate >= DATE '1995-03-01' AND lapstartdate < DATE '1995-04-01' OR season <> 1995""",
    "race_laps",
)
def laps_in_time_order(spark, sf):
    """Stored in time order with each lap's place in its season; one season is then read for a month only."""
    path = new_path(spark, "ordered")
    laps = views.race_laps(spark, sf).select("season", "race", "driver", "lap_number", "lapstartdate", "lap_time_ms")
    write_in_order(laps, path, _TIME, "time_order", ["season"])
    month = (F.col("lapstartdate") >= F.lit("1995-03-01").cast("date")) & (F.col("lapstartdate") < F.lit("1995-04-01").cast("date"))
    return read_table(spark, path).filter(month | (F.col("season") != 1995)).select(*laps.columns, "time_order")


# Rows that are doubled, conflicting or without a time -------------------------------------------------------------

view("untimed_laps", "race_weather", "race_results")(
    "SELECT * REPLACE (CASE WHEN lap_number % 9 = 0 OR driver = 'S7' THEN NULL ELSE lap_time_ms END AS lap_time_ms) "
    f"FROM ({VIEWS['silver_race_laps'][1]}) s"
)


@query(
    "lap_rows_untimed",
    with_views("SELECT * FROM lap_rows WHERE target_lap_time_ms IS NOT NULL", "lap_rows", instead={"silver_race_laps": "untimed_laps"}),
)
def lap_rows_untimed(spark, sf):
    """Laps without a time are no targets, but still the lap before the next one."""
    untimed = F.when((F.col("lap_number") % 9 != 0) & (F.col("driver") != "S7"), F.col("lap_time_ms"))
    return datasets.lap_dataset(silver_race_laps(spark, sf).withColumn("lap_time_ms", untimed))


_WEATHER = ", ".join(f"w.{c}" for c in laps.WEATHER)
_DOUBLED = "(SELECT * FROM race_weather UNION ALL SELECT * REPLACE (airtemp + 1 AS airtemp) FROM race_weather WHERE lap_number % 4 = 1)"


def _doubled_weather(rows):
    weather = views.race_weather(rows)
    other = weather.filter("lap_number % 4 = 1").withColumn("airtemp", F.col("airtemp") + 1)
    return union_by_position([weather, other])


@query(
    "laps_with_doubled_weather",
    f"""SELECT l.*, {_WEATHER} FROM race_laps l LEFT JOIN {_DOUBLED} w
     ON l.season = w.season AND l.race = w.race AND l.driver = w.driver AND l.lap_number = w.lap_number""",
    "race_weather",
)
def laps_with_doubled_weather(spark, sf):
    """A lap with two weather rows is there twice."""
    rows = stored_laps(spark, sf)
    return laps.with_weather(rows, _doubled_weather(rows))


@query(
    "laps_with_unique_weather",
    f"""SELECT l.*, {_WEATHER} FROM race_laps l LEFT JOIN race_weather w
     ON l.season = w.season AND l.race = w.race AND l.driver = w.driver AND l.lap_number = w.lap_number""",
    "race_weather",
)
def laps_with_unique_weather(spark, sf):
    """Of two weather rows the one that sorts first stays: here the cooler, as they differ in nothing else."""
    rows = stored_laps(spark, sf)
    return laps.with_weather(rows, _doubled_weather(rows), unique=True)


@query(
    "laps_with_conflicting_results",
    """
SELECT l.* EXCLUDE (team_name), CASE WHEN r.position % 2 = 0 THEN 0 ELSE r.gridposition END AS grid_position,
       r.position AS finish_position, r.status AS race_status, r.teamname AS team_name
FROM race_laps l LEFT JOIN race_results r ON l.season = r.season AND l.race = r.race AND l.driver = r.abbreviation""",
    "race_results",
)
def laps_with_conflicting_results(spark, sf):
    """Of two result rows that disagree, the one with the lower grid place counts, and a known place before none."""
    rows = stored_laps(spark, sf)
    entries = views.race_results(rows)
    other = entries.filter("position % 2 = 0").withColumn("gridposition", F.lit(0))
    worse = entries.filter("position % 2 = 1 and gridposition is not null").withColumn("gridposition", F.col("gridposition") + 1)
    return laps.with_results(rows, union_by_position([entries, other, worse]))


@query("calendar_lookup_document", ORACLES["calendar_lookup"])
def calendar_lookup_document(spark, sf):
    """The calendar as one document over many lines."""
    rows = views.season_results(spark, sf)
    listed = rows.filter("round % 3 <> 0 and season <> 1995").select("season", "round").distinct()
    # A calendar is a list of seasons, so its one document is small.
    names = F.transform(F.array_sort(F.collect_list("round")), lambda m: F.concat(F.lit("Race "), m.cast("string")))
    seasons = listed.groupBy("season").agg(names.alias("races"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("season").cast("string"), "races")))
    text = seasons.agg(F.to_json(entries, {"pretty": "true"}).alias("value"))
    path = new_path(spark, "calendar")
    text.coalesce(1).write.text(path)
    races = calendar.read_calendar(spark, path)
    return calendar.in_calendar(rows.select("season", F.col("race_name").alias("race"), "result_id", "status"), races)


@query(
    "required_table",
    "SELECT 'stored' AS name, count(*) AS n, true AS found FROM orders UNION ALL SELECT 'absent', NULL, false",
)
def required_table(spark, sf):
    """A required table that is there is read; one that isn't is an error that says so."""
    path = new_path(spark, "required")
    write_table(views.table(spark, sf, "orders"), f"{path}/stored")
    parts = []
    for name in ("stored", "absent"):
        try:
            counted = read_required(spark, f"{path}/{name}").agg(F.count(F.lit(1)).alias("n"))
            parts.append(counted.select(F.lit(name).alias("name"), "n", F.lit(True).alias("found")))
        except FileNotFoundError:
            nothing = spark.range(1).select(F.lit(name).alias("name"), F.lit(None).cast("long").alias("n"), F.lit(False).alias("found"))
            parts.append(nothing)
    return union_by_position(parts)
