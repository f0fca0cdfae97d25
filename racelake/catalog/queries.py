"""Every operator and stage bound to the driver's tables, with the same result in DuckDB's SQL.

A query takes (spark, sf_dir) and returns a DataFrame over whole tables. Stages that several later steps read
are stored in between, as the stages of a lake are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racelake.catalog import views
from racelake.catalog.oracle import view, with_views
from racelake.functions import duration_ms, has_token, slug
from racelake.operators.columns import normalize_names, prefix_only, stamp
from racelake.operators.encode import dummies, one_hot_stages
from racelake.operators.metrics import binary_metrics, class_report, confusion_matrix
from racelake.operators.ordered import Past, add_past, add_row_number
from racelake.operators.relations import (
    describe,
    distinct_values,
    global_sort,
    null_counts,
    preview,
    profile,
    quick_stats,
    union_by_name,
    union_by_position,
)
from racelake.operators.split import time_split, time_split_by_date
from racelake.plans import datasets, laps, results, summaries, training
from racelake.plans.lake import Lake, run_laps, run_season_results, to_bronze, to_silver, write_raw_session
from racelake.schemas import schema
from racelake.sources import calendar, documents
from racelake.sources.bucketed import default_buckets, stable_bucketed, stay
from racelake.sources.scratch import new_path, stable
from racelake.sources.tables import read_all, read_optional, read_table, write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str):
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, *needs)
        return run

    return keep


# Race tables -------------------------------------------------------------------------------------------------


def stored_laps(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The lap table, or those of its columns that later steps read."""
    return stable(views.race_laps(spark, sf).select(*(columns or ["*"])))


def silver_race_laps(spark: SparkSession, sf: str) -> DataFrame:
    """Stored in buckets of a driver's race. Laps are dealt to them once, before they are numbered; joins with weather and
    results, and windows over what is returned, leave them there."""
    return stable_bucketed(joined_race_laps(spark, sf, datasets.DRIVER_KEY), datasets.DRIVER_KEY, ["lap_number"], placed=True)


def joined_race_laps(spark: SparkSession, sf: str, keys: Sequence[str]) -> DataFrame:
    """What `silver_race_laps` stores, from laps that are stored in buckets of `keys`."""
    rows = stable_bucketed(views.race_laps(spark, sf, default_buckets(spark), keys), keys, ["lap_number"], placed=True)
    joined = laps.with_results(laps.with_weather(rows, views.race_weather(rows)), views.race_results(rows))
    return joined.drop("rainfall").withColumnsRenamed(laps.SILVER_NAMES)


def driver_summary(spark: SparkSession, sf: str) -> DataFrame:
    """From stored laps, as in a lake. Aggregated straight from the join, the laps of a driver would stay in the
    join's partition, and a hot one could not be split."""
    rows = stored_laps(
        spark, sf, *laps.LAP_KEY, "driver_number", "team_name", "lapstartdate", "lap_time_ms", "is_pit_lap"
    )
    joined = laps.with_results(rows, views.race_results(rows))
    return summaries.driver_race_summary(stable(joined.drop("driver_number")))


def both_forms(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    teams = summaries.constructor_race_summary(summary)
    return summaries.driver_recent_form(summary), summaries.constructor_recent_form(teams)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Means of means depend on the order of addition in the last bits; both sides compare six places."""
    return df.withColumns({c: F.round(c, 6) for c in names})


def rounded_sql(columns: dict[str, str] | tuple[str, ...], source: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in columns)}) FROM {source}"


TEAM_MEANS = ("avg_finish_position", "avg_lap_time_ms")
TEAM_FORM_MEANS = (*TEAM_MEANS, "avg_finish_last_3", "avg_finish_last_5", "avg_position_gain_last_5")
JOINED_MEANS = tuple(f"constructor_{c}" for c in TEAM_FORM_MEANS[2:])


@query("driver_recent_form", "SELECT * FROM driver_form", "driver_form")
def driver_recent_form(spark, sf):
    return summaries.driver_recent_form(driver_summary(spark, sf))


@query("constructor_recent_form", rounded_sql(TEAM_FORM_MEANS, "constructor_form"), "constructor_form")
def constructor_recent_form(spark, sf):
    teams = summaries.constructor_race_summary(driver_summary(spark, sf))
    return rounded(summaries.constructor_recent_form(teams), *TEAM_FORM_MEANS)


query("driver_race_summary", "SELECT * FROM driver_summary", "driver_summary")(driver_summary)


@query("constructor_race_summary", rounded_sql(TEAM_MEANS, "constructor_summary"), "constructor_summary")
def constructor_race_summary(spark, sf):
    return rounded(summaries.constructor_race_summary(driver_summary(spark, sf)), *TEAM_MEANS)


_FORM_SQL = ", ".join(summaries.FORM_NAMES)
_PREFIXED = {p: ", ".join(f"{c} AS {p}_{c}" for c in summaries.FORM_NAMES) for p in ("driver", "constructor")}


@query(
    "race_prediction_dataset",
    rounded_sql(
        JOINED_MEANS,
        f"""(SELECT s.season, s.race, s.race_date, s.driver, s.team_name, s.grid_position, f.* EXCLUDE (season, race, driver),
               c.* EXCLUDE (season, race, team_name), s.finished_top_10
        FROM driver_summary s
        LEFT JOIN (SELECT season, race, driver, {_FORM_SQL} FROM driver_form) f
             ON s.season = f.season AND s.race = f.race AND s.driver = f.driver
        LEFT JOIN (SELECT season, race, team_name, {_PREFIXED["constructor"]} FROM constructor_form) c
             ON s.season = c.season AND s.race = c.race AND s.team_name = c.team_name) d""",
    ),
    "driver_form",
    "constructor_form",
)
def race_prediction_dataset(spark, sf):
    summary = stable(driver_summary(spark, sf))
    return rounded(datasets.race_dataset(summary, *both_forms(summary)), *JOINED_MEANS)


@query("lap_prediction_dataset", "SELECT * FROM lap_rows", "lap_rows")
def lap_prediction_dataset(spark, sf):
    return datasets.lap_dataset(silver_race_laps(spark, sf))


@query("next_known_compound", "SELECT * FROM next_compound", "next_compound")
def next_known_compound(spark, sf):
    rows = stable_bucketed(lap_prediction_dataset(spark, sf), datasets.DRIVER_KEY, ["lap_number"], placed=True)
    return datasets.known_compound(rows)


@query("next_known_blocks", "SELECT * FROM next_compound", "next_compound")
def next_known_blocks(spark, sf):
    return datasets.known_compound(lap_prediction_dataset(spark, sf), split=True)


@query(
    "row_number_blocks",
    "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS n "
    "FROM orders",
)
def row_number_blocks(spark, sf):
    orders = views.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    numbered = add_row_number(orders, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], "n", split=True)
    return numbered.select("o_orderkey", "o_orderstatus", "n")


_LAP_ML_SQL = f"""
SELECT * REPLACE ({", ".join(f"CAST({c} AS INT) AS {c}" for c in datasets.LAP_FLAGS if not c.startswith("last"))},
         coalesce(tyre_life, 0) AS tyre_life, coalesce(stint, 1) AS stint,
         {", ".join(f"coalesce(CAST({c} AS INT), 0) AS {c}" for c in datasets.LAP_FLAGS if c.startswith("last"))},
         {", ".join(f"coalesce({c}, {datasets.HISTORY_DEFAULTS[c]}) AS {c}"
                    for c in datasets.HISTORY_DEFAULTS
                    if not c.startswith("last_lap_is") and c not in JOINED_MEANS)},
         {", ".join(f"round(coalesce({c}, {datasets.HISTORY_DEFAULTS[c]}), 6) AS {c}" for c in JOINED_MEANS)})
FROM (
  SELECT n.* EXCLUDE (lap_context_time, driver_number), f.* EXCLUDE (season, race, driver),
         c.* EXCLUDE (season, race, team_name),
         CASE WHEN driver_avg_finish_last_3 IS NULL THEN 0 ELSE 1 END AS driver_history_available,
         CASE WHEN constructor_avg_finish_last_3 IS NULL THEN 0 ELSE 1 END AS constructor_history_available,
         CASE WHEN last_lap_time_ms IS NULL THEN 0 ELSE 1 END AS last_lap_history_available
  FROM next_compound n
  LEFT JOIN (SELECT season, race, driver, {_PREFIXED["driver"]} FROM driver_form) f
       ON n.season = f.season AND n.race = f.race AND n.driver = f.driver
  LEFT JOIN (SELECT season, race, team_name, {_PREFIXED["constructor"]} FROM constructor_form) c
       ON n.season = c.season AND n.race = c.race AND n.team_name = c.team_name) m
"""


@query("lap_ml_table", _LAP_ML_SQL, "next_compound", "driver_form", "constructor_form")
def lap_ml_table(spark, sf):
    silver = silver_race_laps(spark, sf)
    summary = stable(summaries.driver_race_summary(silver))
    rows = stable_bucketed(datasets.lap_dataset(silver), datasets.DRIVER_KEY, ["lap_number"], placed=True)
    history = stable_bucketed(datasets.lap_history(*both_forms(summary)), datasets.DRIVER_KEY)
    return rounded(datasets.lap_ml_table_as_stored(rows, history), *JOINED_MEANS)


@query(
    "history_flags_and_fill",
    f"""
SELECT season, race, driver,
       {", ".join(f"coalesce({c}, {v}) AS driver_{c}" for c, v in datasets.FORM_DEFAULTS.items())},
       CASE WHEN avg_finish_last_3 IS NULL THEN 0 ELSE 1 END AS driver_history_available
FROM driver_form""",
    "driver_form",
)
def history_flags_and_fill(spark, sf):
    form = summaries.driver_recent_form(driver_summary(spark, sf))
    named = prefix_only(form.select("season", "race", "driver", *summaries.FORM_NAMES), "driver_", summaries.FORM_NAMES)
    flags = {"driver_history_available": "driver_avg_finish_last_3"}
    return datasets.fill(datasets.presence_flags(named, flags), datasets.HISTORY_DEFAULTS)


@query(
    "laps_with_weather",
    """
SELECT l.*, w.airtemp, w.humidity, w.pressure, w.rainfall, w.tracktemp, w.winddirection, w.windspeed
FROM race_laps l LEFT JOIN race_weather w
     ON l.season = w.season AND l.race = w.race AND l.driver = w.driver AND l.lap_number = w.lap_number""",
    "race_weather",
)
def laps_with_weather(spark, sf):
    rows = stored_laps(spark, sf)
    return laps.with_weather(rows, views.race_weather(rows))


@query(
    "laps_with_results",
    """
SELECT l.* EXCLUDE (team_name), r.gridposition AS grid_position, r.position AS finish_position,
       r.status AS race_status, r.teamname AS team_name
FROM race_laps l LEFT JOIN race_results r ON l.season = r.season AND l.race = r.race AND l.driver = r.abbreviation""",
    "race_results",
)
def laps_with_results(spark, sf):
    rows = stored_laps(spark, sf)
    table = views.race_results(rows)
    return laps.with_results(rows, union_by_position([table, table.filter("position % 3 = 0")]))


def _duration_sql(c: str) -> str:
    clock = f"regexp_extract(trim({c}), '^(?:\\d+\\s+days?\\s+)?(\\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d+)?)$', 1)"
    days = f"coalesce(TRY_CAST(regexp_extract(trim({c}), '^(\\d+)\\s+days?', 1) AS DOUBLE), 0.0::DOUBLE)"
    return f"""CASE WHEN regexp_matches(trim({c}), '^\\d+(\\.\\d+)?$') THEN TRY_CAST(trim({c}) AS DOUBLE)
         WHEN {clock} <> '' THEN {days} * 86400000.0::DOUBLE
              + CAST(substr({clock}, 1, 2) AS DOUBLE) * 3600000.0::DOUBLE
              + CAST(substr({clock}, 4, 2) AS DOUBLE) * 60000.0::DOUBLE
              + CAST(substr({clock}, 7) AS DOUBLE) * 1000.0::DOUBLE END"""


_TRACK_SQL = ", ".join(
    f"(';' || coalesce(trackstatus, '') || ';') LIKE '%;{token};%' AS {name}"
    for name, token in laps.TRACK_FLAGS.items()
)
_RAW_COLUMNS = "season, race, driver, lap_number"


@query(
    "silver_laps",
    f"""
SELECT {_RAW_COLUMNS}, lap_time_ms, pit_in_time_ms, pit_out_time_ms, CAST(tyrelife AS INT) AS tyre_life,
       coalesce(compound, 'UNKNOWN') AS compound, coalesce(trackstatus, '') AS track_status,
       coalesce(TRY_CAST(freshtyre AS BOOLEAN), false) AS fresh_tyre,
       pit_in_time_ms IS NOT NULL AS is_pit_in_lap, pit_out_time_ms IS NOT NULL AS is_pit_out_lap,
       (pit_in_time_ms IS NOT NULL OR pit_out_time_ms IS NOT NULL) AS is_pit_lap, {_TRACK_SQL},
       false AS is_raining
FROM (SELECT *, {_duration_sql("laptime")} AS lap_time_ms, {_duration_sql("pitintime")} AS pit_in_time_ms,
             {_duration_sql("pitouttime")} AS pit_out_time_ms FROM raw_laps) d
WHERE lap_time_ms IS NOT NULL""",
    "raw_laps",
)
def silver_laps(spark, sf):
    clean = laps.prepare(stable(views.raw_laps(views.race_laps(spark, sf))))
    names = ["lap_time_ms", "pit_in_time_ms", "pit_out_time_ms", "tyre_life", "compound", "track_status", "fresh_tyre"]
    flags = ["is_pit_in_lap", "is_pit_out_lap", "is_pit_lap", *laps.TRACK_FLAGS, "is_raining"]
    return clean.select(*laps.LAP_KEY, *names, *flags)


@query(
    "pit_flags",
    f"""
SELECT {_RAW_COLUMNS}, pitintime IS NOT NULL AS is_pit_in_lap, pitouttime IS NOT NULL AS is_pit_out_lap,
       (pitintime IS NOT NULL OR pitouttime IS NOT NULL) AS is_pit_lap
FROM (SELECT * REPLACE (nullif(pitintime, 'NaT') AS pitintime, nullif(pitouttime, '') AS pitouttime) FROM raw_laps) r""",
    "raw_laps",
)
def pit_flags(spark, sf):
    raw = views.raw_laps(views.race_laps(spark, sf))
    known = raw.select(
        *laps.LAP_KEY,
        F.nullif("pitintime", F.lit("NaT")).alias("pit_in_time_ms"),
        F.nullif("pitouttime", F.lit("")).alias("pit_out_time_ms"),
    )
    return laps.with_flags(known).select(*laps.LAP_KEY, "is_pit_in_lap", "is_pit_out_lap", "is_pit_lap")


@query(
    "rain_flag",
    f"""
SELECT {", ".join("l." + c for c in laps.LAP_KEY)}, coalesce(w.rainfall, false) AS is_raining
FROM race_laps l LEFT JOIN race_weather w
     ON l.season = w.season AND l.race = w.race AND l.driver = w.driver AND l.lap_number = w.lap_number""",
    "race_weather",
)
def rain_flag(spark, sf):
    rows = stored_laps(spark, sf)
    joined = laps.with_weather(rows.select(*laps.LAP_KEY), views.race_weather(rows))
    return laps.with_flags(joined).select(*laps.LAP_KEY, "is_raining")


# Season results ----------------------------------------------------------------------------------------------


@query("race_features", "SELECT * FROM race_features", "race_features")
def race_features(spark, sf):
    return results.race_features(views.season_results(spark, sf))


@query("driver_career_stats", "SELECT * FROM driver_stats", "driver_stats")
def driver_career_stats(spark, sf):
    return results.driver_stats(views.season_results(spark, sf))


@query("constructor_career_stats", "SELECT * FROM constructor_stats", "constructor_stats")
def constructor_career_stats(spark, sf):
    return results.constructor_stats(views.season_results(spark, sf))


@query(
    "season_prediction_dataset",
    """
SELECT r.*, d.* EXCLUDE (code), c.* EXCLUDE (constructor_id)
FROM race_features r LEFT JOIN driver_stats d ON r.code = d.code
LEFT JOIN constructor_stats c ON r.constructor_id = c.constructor_id""",
    "race_features",
    "driver_stats",
    "constructor_stats",
)
def season_prediction_dataset(spark, sf):
    rows = stable(views.season_results(spark, sf))
    return results.season_dataset(results.race_features(rows), results.driver_stats(rows), results.constructor_stats(rows))


_W = "PARTITION BY code ORDER BY date NULLS FIRST, result_id NULLS FIRST ROWS BETWEEN"


@query(
    "driver_history",
    f"""
SELECT result_id, code, date, avg(position) OVER ({_W} 3 PRECEDING AND 1 PRECEDING) AS avg_position_last_3,
       avg(grid - position) OVER ({_W} 5 PRECEDING AND 1 PRECEDING) AS avg_gain_last_5,
       CAST(sum(CASE WHEN position <= 10 THEN 1 ELSE 0 END) OVER ({_W} 5 PRECEDING AND 1 PRECEDING) AS BIGINT)
           AS top_10_last_5,
       lag(points) OVER (PARTITION BY code ORDER BY date NULLS FIRST, result_id NULLS FIRST) AS last_points
FROM season_results""",
    "season_results",
)
def driver_history(spark, sf, split=False):
    past = [
        Past("avg_position_last_3", "position", 3),
        Past("avg_gain_last_5", "position_gain", 5),
        Past("top_10_last_5", "finished_top_10", 5, "sum"),
        Past("last_points", "points", 1, "value"),
    ]
    rows = results.race_features(views.season_results(spark, sf))
    needed = rows.select("result_id", "code", "date", "position", "position_gain", "finished_top_10", "points")
    known = add_past(needed, ["code"], ["date", "result_id"], past, split)
    return known.select("result_id", "code", "date", *[p.name for p in past])


@query("driver_history_blocks", ORACLES["driver_history"])
def driver_history_blocks(spark, sf):
    return driver_history(spark, sf, split=True)


_FLAT_SQL = "SELECT * EXCLUDE (result_id) FROM flat_results"


@query("flatten_nested_results", _FLAT_SQL, "flat_results")
def flatten_nested_results(spark, sf):
    flat = views.flat_results(views.season_results(spark, sf))
    return documents.flatten_results(documents.nest_results(flat, ["result_id"]))


@query("nested_json_roundtrip", _FLAT_SQL, "flat_results")
def nested_json_roundtrip(spark, sf):
    path = new_path(spark, "documents")
    flat = views.flat_results(views.season_results(spark, sf))
    documents.write_documents(documents.nest_results(flat, ["result_id"]), path)
    return documents.flatten_results(documents.read_documents(spark, path, multi_line=False))


@query("season_documents", _FLAT_SQL, "flat_results")
def season_documents(spark, sf):
    """One multi-line document for each season, written and read back."""
    path = new_path(spark, "documents")
    flat = views.flat_results(views.season_results(spark, sf))
    documents.write_season_documents(documents.season_documents(flat, ["result_id"]), path)
    return documents.flatten_results(documents.read_season_documents(spark, path))


@query("paged_results_merge", _FLAT_SQL, "flat_results")
def paged_results_merge(spark, sf):
    path = new_path(spark, "pages")
    flat = views.flat_results(views.season_results(spark, sf))
    pages = documents.as_pages(documents.nest_results(flat, ["result_id"], page_rows=30))
    documents.write_documents(pages, path)
    return documents.flatten_results(documents.read_pages(spark, path, multi_line=False))


@query(
    "silver_results",
    """
SELECT DISTINCT CAST(season AS INT) AS season, CAST(round AS INT) AS round, "raceName" AS race_name,
       TRY_CAST(date AS DATE) AS date, "circuitId" AS circuit_id, "circuitName" AS circuit_name,
       "driverId" AS driver_id, code, "givenName" AS given_name, "familyName" AS family_name, nationality,
       "constructorId" AS constructor_id, name, CAST(grid AS INT) AS grid, TRY_CAST(position AS INT) AS position,
       CAST(points AS DOUBLE) AS points, CAST(laps AS INT) AS laps, status
FROM flat_results""",
    "flat_results",
)
def silver_results(spark, sf):
    flat = views.flat_results(views.season_results(spark, sf))
    doubled = union_by_position([flat, flat.filter("result_id % 5 = 0")])
    return results.clean_results(doubled.drop("result_id"))


@query("union_seasons", "SELECT * FROM flat_results", "flat_results")
def union_seasons(spark, sf):
    flat = views.flat_results(views.season_results(spark, sf))
    cuts = ["season < '1995'", "season >= '1995' and season < '1998'", "season >= '1998'"]
    return union_by_position([flat.filter(c) for c in cuts])


_PARTS = {"season < 1995": ["status"], "season >= 1995 and season < 1998": ["grid", "points"], "season >= 1998": []}
_PARTS_SQL = """
SELECT * REPLACE (CASE WHEN season >= 1995 THEN status END AS status,
                  CASE WHEN NOT (season >= 1995 AND season < 1998) THEN grid END AS grid,
                  CASE WHEN NOT (season >= 1995 AND season < 1998) THEN points END AS points)
FROM season_results"""


def _parts(spark, sf):
    rows = views.season_results(spark, sf)
    return [rows.filter(cut).drop(*lost) for cut, lost in _PARTS.items()]


@query("union_by_name", _PARTS_SQL, "season_results")
def union_parts_by_name(spark, sf):
    return union_by_name(_parts(spark, sf))


@query("multi_season_load", _PARTS_SQL, "season_results")
def multi_season_load(spark, sf):
    root = new_path(spark, "seasons")
    paths = [f"{root}/part_{i}" for i in range(len(_PARTS))]
    for path, part in zip(paths, _parts(spark, sf), strict=True):
        write_table(part, path)
    return read_all(spark, [*paths, f"{root}/absent"])


@query(
    "feature_lookup",
    f"""
SELECT q.result_id, {", ".join("q." + c for c in results.MODEL_INPUT)},
       {", ".join(f"d.driver_{c}" for c in results.CAREER_FEATURES)},
       {", ".join(f"c.constructor_{c}" for c in results.CAREER_FEATURES)},
       CASE WHEN d.code IS NULL THEN 'No driver data found'
            WHEN c.constructor_id IS NULL THEN 'No constructor data found' END AS reason
FROM (SELECT * REPLACE (CASE WHEN result_id % 13 = 0 THEN 'nobody' ELSE code END AS code,
                        CASE WHEN result_id % 19 = 0 THEN 'no_team' ELSE constructor_id END AS constructor_id)
      FROM season_results) q
LEFT JOIN driver_stats d ON q.code = d.code LEFT JOIN constructor_stats c ON q.constructor_id = c.constructor_id""",
    "season_results",
    "driver_stats",
    "constructor_stats",
)
def feature_lookup(spark, sf):
    rows = stable(views.season_results(spark, sf))
    return results.look_up_features(_requests(rows), results.driver_stats(rows), results.constructor_stats(rows))


def _requests(rows: DataFrame) -> DataFrame:
    key = F.col("result_id")
    return rows.select(
        "result_id",
        F.when(key % 13 == 0, "nobody").otherwise(F.col("code")).alias("code"),
        *["season", "round", "grid", "circuit_id", "driver_id"],
        F.when(key % 19 == 0, "no_team").otherwise(F.col("constructor_id")).alias("constructor_id"),
    )


# Columns and names -------------------------------------------------------------------------------------------


@query(
    "duration_to_ms",
    f"""
SELECT event_id, shape, {_duration_sql("txt")} AS ms
FROM (SELECT event_id, CAST(event_id % 8 AS INT) AS shape,
             CASE event_id % 8 WHEN 0 THEN concat('0 days ', clock) WHEN 1 THEN concat('1 day ', clock)
                  WHEN 2 THEN clock WHEN 3 THEN concat(CAST(n AS STRING), '.25') WHEN 4 THEN CAST(n AS STRING)
                  WHEN 5 THEN concat('-1 days +', clock) WHEN 6 THEN substr(clock, 2) ELSE 'NaT' END AS txt
      FROM (SELECT event_id, n, concat(lpad(CAST(n % 24 AS STRING), 2, '0'), ':',
                   lpad(CAST(n % 60 AS STRING), 2, '0'), ':', lpad(CAST(n % 59 AS STRING), 2, '0'), '.',
                   lpad(CAST(n % 1000 AS STRING), 3, '0'), '000') AS clock
            FROM (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS n FROM events) a) b) c""",
)
def duration_to_ms(spark, sf):
    n = F.floor(F.col("value") * 1000)

    def padded(number, width=2):
        return F.lpad(number.cast("string"), width, "0")

    clock = F.concat(
        padded(n % 24), F.lit(":"), padded(n % 60), F.lit(":"), padded(n % 59), F.lit("."), padded(n % 1000, 3),
        F.lit("000"),
    )
    shape = (F.col("event_id") % 8).cast("int")
    text = (
        F.when(shape == 0, F.concat(F.lit("0 days "), clock))
        .when(shape == 1, F.concat(F.lit("1 day "), clock))
        .when(shape == 2, clock)
        .when(shape == 3, F.concat(n, F.lit(".25")))
        .when(shape == 4, n.cast("string"))
        .when(shape == 5, F.concat(F.lit("-1 days +"), clock))
        .when(shape == 6, F.substring(clock, 2, 100))
        .otherwise("NaT")
    )
    return views.table(spark, sf, "events").select("event_id", shape.alias("shape"), duration_ms(text).alias("ms"))


@query(
    "status_tokens",
    f"""
SELECT event_id, {", ".join(f"(';' || txt || ';') LIKE '%;{t};%' AS {n}" for n, t in laps.TRACK_FLAGS.items())},
       txt LIKE '%1%' AS any_1
FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE
             concat(CAST(event_id % 8 AS STRING), CASE WHEN event_id % 3 = 0 THEN '' ELSE ';' END,
                    CAST(event_id % 7 AS STRING)) END AS txt FROM events) e""",
)
def status_tokens(spark, sf):
    key = F.col("event_id")
    text = F.when(
        key % 10 != 0, F.concat(key % 8, F.when(key % 3 == 0, "").otherwise(";"), (key % 7).cast("string"))
    )
    flags = [has_token(text, token).alias(name) for name, token in laps.TRACK_FLAGS.items()]
    return views.table(spark, sf, "events").select("event_id", *flags, has_token(text, "1", None).alias("any_1"))


@query(
    "normalize_names",
    """
SELECT p_partkey AS part_key, p_name AS part_name, p_brand AS brand_label, p_type AS type_, p_size AS size_mm,
       p_retailprice AS retail_price FROM part""",
)
def normalized_part(spark, sf):
    odd = views.table(spark, sf, "part").toDF("Part Key", " part-name ", "Brand/Label", "Type ", "SIZE_MM", "Retail Price")
    return normalize_names(odd.withColumnRenamed("Type ", "Type-"))


@query(
    "race_slug",
    """
SELECT p_partkey, replace(replace(replace(lower(trim(concat(' ', p_name, ' GP/', p_brand, '-', p_type, ' '))), ' ', '_'),
       '-', '_'), '/', '_') AS race FROM part""",
)
def race_slug(spark, sf):
    name = F.concat(F.lit(" "), "p_name", F.lit(" GP/"), "p_brand", F.lit("-"), "p_type", F.lit(" "))
    return views.table(spark, sf, "part").select("p_partkey", slug(name).alias("race"))


@query(
    "bronze_stamp",
    """
SELECT o_orderkey AS order_key, o_orderpriority AS order_priority, concat('Race ', CAST(month(o_orderdate) AS STRING),
       ' / Open-Cup') AS grand_prix, CAST(year(o_orderdate) AS INT) AS season, 'laps' AS source_table,
       'R' AS session_type, concat('race_', CAST(month(o_orderdate) AS STRING), '___open_cup') AS race
FROM orders""",
)
def bronze_stamp(spark, sf):
    raw = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Order Key"),
        F.col("o_orderpriority").alias("Order-Priority"),
        F.concat(F.lit("Race "), F.month("o_orderdate"), F.lit(" / Open-Cup")).alias("Grand_Prix"),
        F.year("o_orderdate").alias("Season"),
    )
    return laps.bronze(raw, "laps")


@query(
    "ingest_metadata",
    """
SELECT o_orderkey, o_totalprice, CAST(2019 AS INT) AS season, 'Great Britain' AS grand_prix, 'R' AS session_type,
       'provider' AS source, '2024-01-01T00:00:00+00:00' AS ingestion_timestamp FROM orders""",
)
def ingest_metadata(spark, sf):
    rows = views.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return laps.with_metadata(rows, 2019, "Great Britain", "R", "provider", "2024-01-01T00:00:00+00:00")


@query(
    "storable_spans",
    """
SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN
  concat(CAST(days AS STRING), ' days ', CASE WHEN days < 0 THEN '+' ELSE '' END,
         lpad(CAST(rest // 3600000000 AS STRING), 2, '0'), ':',
         lpad(CAST((rest // 60000000) % 60 AS STRING), 2, '0'), ':',
         lpad(CAST((rest // 1000000) % 60 AS STRING), 2, '0'),
         CASE WHEN rest % 1000000 > 0 THEN concat('.', lpad(CAST(rest % 1000000 AS STRING), 6, '0')) ELSE '' END)
  END AS span
FROM (SELECT event_id, days, us - days * 86400000000 AS rest
      FROM (SELECT event_id, us, CAST(floor(us / 86400000000) AS BIGINT) AS days
            FROM (SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-03 00:00:00') AS us FROM events) a) b) c""",
)
def storable_spans(spark, sf):
    span = F.col("ts") - F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    rows = views.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, span).alias("span"))
    return laps.storable(rows)


@query(
    "row_aligned_keys",
    """
SELECT w.event_id, w.event_type, w.value, l.user_id AS driver, l.event_id AS lap_number
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) w
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events
           WHERE event_id % 50 <> 0) l
ON w.event_type = l.event_type AND w.n = l.n""",
)
def row_aligned_keys(spark, sf):
    events = views.table(spark, sf, "events")
    keyed = events.filter("event_id % 50 <> 0").select("event_type", "ts", "event_id", "user_id")
    bare = events.select("event_id", "event_type", "value")
    names = {"user_id": "driver", "event_id": "lap_number"}
    return laps.align_rows(keyed, bare, ["event_type"], ["ts", "event_id"], ["event_id"], names)


# Calendar ----------------------------------------------------------------------------------------------------


@query(
    "calendar_build",
    """
SELECT season, CAST(row_number() OVER (PARTITION BY season ORDER BY result_id) - 1 AS INT) AS race_order, race
FROM (SELECT season, result_id, constructor_id AS race,
             CASE WHEN result_id % 7 = 0 THEN NULL WHEN result_id % 3 = 0 THEN 'Pre-Season Test'
                  ELSE concat(race_name, ' Grand Prix') END AS event_name FROM season_results) e
WHERE event_name LIKE '%Grand Prix%'""",
    "season_results",
)
def calendar_build(spark, sf):
    key = F.col("result_id")
    name = F.when(key % 7 == 0, None).when(key % 3 == 0, "Pre-Season Test").otherwise(F.concat("race_name", F.lit(" Grand Prix")))
    rows = views.season_results(spark, sf)
    events = rows.select("season", name.alias("event_name"), F.col("constructor_id").alias("country"), key)
    return calendar.build_calendar(events, order=["result_id"])


@query(
    "calendar_lookup",
    """
SELECT season, race_name AS race, result_id, status FROM season_results WHERE round % 3 <> 0 AND season <> 1995""",
    "season_results",
)
def calendar_lookup(spark, sf):
    rows = views.season_results(spark, sf)
    listed = rows.filter("round % 3 <> 0 and season <> 1995").select("season", "round").distinct()
    # The months of a year bound this list.
    names = F.transform(F.array_sort(F.collect_list("round")), lambda m: F.concat(F.lit("Race "), m.cast("string")))
    config = listed.groupBy("season").agg(names.alias("races")).select(
        F.to_json(F.map_from_arrays(F.array(F.col("season").cast("string")), F.array("races"))).alias("value")
    )
    path = new_path(spark, "calendar")
    config.write.text(path)
    races = calendar.read_calendar(spark, path, multi_line=False)
    return calendar.in_calendar(
        rows.select("season", F.col("race_name").alias("race"), "result_id", "status"), races
    )


# Whole-table summaries ---------------------------------------------------------------------------------------


_COUNTED = ["season", "race", "position", "stint", "compound", "tyre_life", "lap_time_ms"]


@query(
    "null_counts",
    "SELECT " + ", ".join(f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in _COUNTED)
    + " FROM race_laps",
    "race_laps",
)
def null_counts_of_laps(spark, sf):
    return null_counts(views.race_laps(spark, sf).select(*_COUNTED))


@query(
    "describe_numeric",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev({c}), 6) AS stddev, "
        f"CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM season_results"
        for c in ("grid", "position", "points")
    ),
    "season_results",
)
def describe_numeric(spark, sf):
    table = describe(views.season_results(spark, sf).select("grid", "position", "points"))
    return table.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query(
    "quick_stats",
    'SELECT avg(lap_time_ms) AS avg, min(lap_time_ms) AS min, max(lap_time_ms) AS max FROM race_laps',
    "race_laps",
)
def lap_stats(spark, sf):
    return quick_stats(views.race_laps(spark, sf), "lap_time_ms")


@query("distinct_values", "SELECT DISTINCT driver FROM race_laps", "race_laps")
def distinct_drivers(spark, sf):
    return distinct_values(views.race_laps(spark, sf), "driver")


@query(
    "profile",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS path, '{t}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, "
        "CAST(NULL AS INT) AS min_size, CAST(NULL AS INT) AS max_size, CAST(NULL AS BIGINT) AS sum_size, "
        f"CAST(min({c}) AS VARCHAR) AS sample FROM season_results"
        for c, t in {"season": "int", "date": "date", "code": "string", "position": "int", "points": "double"}.items()
    ),
    "season_results",
)
def profile_results(spark, sf):
    return profile(views.season_results(spark, sf).select("season", "date", "code", "position", "points"))


@query("profile_documents")
def profile_documents(spark, sf):
    return profile(documents.nest_results(views.flat_results(views.season_results(spark, sf)), ["result_id"]))


# Storage -----------------------------------------------------------------------------------------------------


@query(
    "partitioned_overwrite",
    """
SELECT result_id, points + CASE WHEN round = 3 THEN 1000 ELSE 0 END AS points, season, race_name AS race
FROM season_results WHERE NOT (round = 3 AND result_id % 2 = 0)""",
    "season_results",
)
def partitioned_overwrite(spark, sf):
    path = new_path(spark, "sessions")
    rows = views.season_results(spark, sf).select("result_id", "points", "season", F.col("race_name").alias("race"))
    write_table(rows, path, ["season", "race"])
    again = rows.filter("race = 'race_3' and result_id % 2 <> 0").withColumn("points", F.col("points") + 1000)
    write_table(again, path, ["season", "race"], touched_only=True)
    return read_table(spark, path)


@query(
    "optional_table",
    "SELECT l.*, CAST(NULL AS VARCHAR) AS status FROM race_laps l",
    "race_laps",
)
def optional_table(spark, sf):
    absent = read_optional(spark, new_path(spark, "absent"), schema(season="int", race="string", driver="string", status="string"))
    return views.race_laps(spark, sf).join(absent, ["season", "race", "driver"], "left")


# Order and split ---------------------------------------------------------------------------------------------


@query(
    "preview_rows",
    "SELECT * FROM orders ORDER BY o_orderdate NULLS FIRST, o_orderkey NULLS FIRST LIMIT 20",
)
def preview_rows(spark, sf):
    return preview(views.table(spark, sf, "orders"), 20, ["o_orderdate", "o_orderkey"])


@query("global_sort", "SELECT * FROM orders ORDER BY o_orderdate NULLS FIRST, o_custkey, o_orderkey")
def sorted_orders(spark, sf):
    return global_sort(views.table(spark, sf, "orders"), ["o_orderdate", "o_custkey", "o_orderkey"])


@query(
    "time_split",
    """
SELECT result_id, season, round, grid, status,
       row_number() OVER (ORDER BY date, result_id) <= floor(count(*) OVER () * 0.8::DOUBLE) AS is_train
FROM season_results WHERE position IS NOT NULL""",
    "season_results",
)
def time_split_results(spark, sf):
    rows = views.season_results(spark, sf).dropna(subset=["position"])
    needed = rows.select("date", "result_id", "season", "round", "grid", "status")
    return time_split(needed, ["date", "result_id"]).drop("date")


_DATED_SQL = "(SELECT *, CAST(date AS DATE) AS day FROM season_results WHERE position IS NOT NULL)"


@query(
    "time_split_by_date",
    f"""
SELECT result_id, season, round, day <= (
         SELECT max(day) FROM (SELECT day, sum(count(*)) OVER (ORDER BY day) AS so_far FROM {_DATED_SQL} r GROUP BY day) d
         WHERE so_far <= (SELECT floor(count(*) * 0.8::DOUBLE) FROM {_DATED_SQL} r)) AS is_train
FROM {_DATED_SQL} r""",
    "season_results",
)
def time_split_at_a_date(spark, sf):
    """A cut between two days: all results of a day are on one side."""
    rows = views.season_results(spark, sf).dropna(subset=["position"])
    return time_split_by_date(rows.select("date", "result_id", "season", "round"), "date").drop("date")


# Models ------------------------------------------------------------------------------------------------------


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


_RATES_SQL = """
SELECT n_right / n AS accuracy, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision,
       CASE WHEN truth > 0 THEN hit / truth ELSE 0 END AS recall
FROM (SELECT count(*)::DOUBLE AS n, count(*) FILTER (quality = toxic)::DOUBLE AS n_right,
             count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS hit, count(*) FILTER (toxic = 1)::DOUBLE AS said,
             count(*) FILTER (quality = 1)::DOUBLE AS truth FROM labels) c"""


@query(
    "binary_metrics",
    f"""
SELECT accuracy, CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall) ELSE 0 END AS f1,
       precision, recall FROM ({_RATES_SQL}) r""",
)
def metrics_of_labels(spark, sf):
    return binary_metrics(_judged(spark, sf))


def _rounded_report(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "class_report",
    """
WITH r AS (
  SELECT class, precision, recall, hit, support,
         CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall) ELSE 0 END AS f1
  FROM (SELECT CAST(k AS VARCHAR) AS class, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision,
               CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, hit, support
        FROM (SELECT k, count(*) FILTER (quality = k AND toxic = k)::DOUBLE AS hit,
                     count(*) FILTER (toxic = k)::DOUBLE AS said, count(*) FILTER (quality = k) AS support
              FROM labels, (VALUES (0), (1)) v(k) GROUP BY k) c) p)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
       round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
       CAST(sum(support) AS BIGINT) FROM r""",
)
def report_of_labels(spark, sf):
    return _rounded_report(class_report(_judged(spark, sf)))


@query(
    "confusion_matrix",
    """
SELECT CAST(k AS INT) AS label, count(*) FILTER (quality = k AND toxic = 0) AS predicted_0,
       count(*) FILTER (quality = k AND toxic = 1) AS predicted_1
FROM labels, (VALUES (0), (1)) v(k) GROUP BY k""",
)
def confusion_of_labels(spark, sf):
    return confusion_matrix(_judged(spark, sf))


@query(
    "confusion_many_classes",
    """
SELECT CAST(k AS INT) AS label, count(*) FILTER (l_orderkey % 3 = 0) AS predicted_0,
       count(*) FILTER (l_orderkey % 3 = 1) AS predicted_1, count(*) FILTER (l_orderkey % 3 = 2) AS predicted_2,
       0::BIGINT AS predicted_3 FROM (SELECT *, l_linenumber % 4 AS k FROM lineitem) l GROUP BY k""",
)
def confusion_many_classes(spark, sf):
    items = views.table(spark, sf, "lineitem")
    label = (F.col("l_linenumber") % 4).cast("int").alias("label")
    return confusion_matrix(items.select(label, (F.col("l_orderkey") % 3).cast("int").alias("prediction")))


# The priorities and states of the orders table.
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_STATES = ["F", "O", "P"]


def _dummies_sql(skip: int) -> str:
    pairs = [
        *[("o_orderpriority", v) for v in _PRIORITIES[skip:]],
        *[("o_orderstatus", v) for v in _STATES[skip:]],
    ]
    columns = ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, v in pairs)
    return f"SELECT o_orderkey, {columns} FROM orders"


@query("dummies_all", _dummies_sql(0))
def dummies_all(spark, sf):
    orders = views.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return dummies(orders, ["o_orderpriority", "o_orderstatus"])


@query("dummies_drop_first", _dummies_sql(1))
def dummies_drop_first(spark, sf):
    orders = views.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return dummies(orders, ["o_orderpriority", "o_orderstatus"], drop_first=True)


def training_set(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, and the statistics of drivers and constructors."""
    rows = stable(views.season_results(spark, sf))
    drivers, constructors = stable(results.driver_stats(rows)), stable(results.constructor_stats(rows))
    return rows, drivers, constructors


TRAIN_ORDER = ["date", "round", "driver_id", "result_id"]


def _trained(spark, sf, estimator) -> tuple[training.Trained, DataFrame, DataFrame, DataFrame]:
    rows, drivers, constructors = training_set(spark, sf)
    dataset = results.season_dataset(results.race_features(rows), drivers, constructors)
    return training.train(dataset, estimator, TRAIN_ORDER), rows, drivers, constructors


def _dataset(spark: SparkSession, sf: str) -> DataFrame:
    rows, drivers, constructors = training_set(spark, sf)
    features = results.race_features(rows)
    known = F.when(F.col("result_id") % 23 != 0, F.col(training.TARGET))
    return results.season_dataset(features.withColumn(training.TARGET, known), drivers, constructors)


_DATASET_SQL = """(SELECT r.* REPLACE (CASE WHEN result_id % 23 <> 0 THEN finished_top_10 END AS finished_top_10),
       d.* EXCLUDE (code), c.* EXCLUDE (constructor_id)
FROM race_features r LEFT JOIN driver_stats d ON r.code = d.code
LEFT JOIN constructor_stats c ON r.constructor_id = c.constructor_id)"""
_DATASET_NEEDS = ("race_features", "driver_stats", "constructor_stats")


@query(
    "training_rows",
    f"""
SELECT result_id, driver_id, grid, driver_num_races, constructor_num_races, finished_top_10,
       row_number() OVER (ORDER BY date NULLS FIRST, round, driver_id, result_id) <= floor(count(*) OVER () * 0.8::DOUBLE)
           AS is_train
FROM {_DATASET_SQL} t WHERE finished_top_10 IS NOT NULL""",
    *_DATASET_NEEDS,
)
def training_rows(spark, sf):
    """Preparation and split: rows without a target go, the first four fifths in time are for training."""
    split = time_split(training.prepare_training(_dataset(spark, sf), TRAIN_ORDER), TRAIN_ORDER)
    return split.select(
        "result_id", "driver_id", "grid", "driver_num_races", "constructor_num_races", training.TARGET, "is_train"
    )


@query(
    "one_hot_decoded",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 AND o_orderpriority <> '5-LOW' THEN o_orderpriority END AS decoded
FROM orders""",
)
def one_hot_decoded(spark, sf):
    """Vectors back to categories: unknown ones and nulls have no slot."""
    value = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority"))
    orders = views.table(spark, sf, "orders").select("o_orderkey", value.alias("value"))
    model = Pipeline(stages=one_hot_stages(["value"])).fit(orders.filter("value <> '5-LOW'"))
    labels = F.array(*[F.lit(x) for x in model.stages[0].labelsArray[0]])
    slot = F.array_position(vector_to_array("value_vector"), 1.0)
    decoded = F.when(slot > 0, F.get(labels, slot.cast("int") - 1)).alias("decoded")
    return model.transform(orders).select("o_orderkey", decoded)


@query(
    "assembled_features",
    f"""
SELECT result_id, {", ".join(f"round(coalesce(CAST({c} AS DOUBLE), 0), 6) AS {c}" for c in training.NUMERIC)}
FROM {_DATASET_SQL} t WHERE finished_top_10 IS NOT NULL""",
    *_DATASET_NEEDS,
)
def assembled_features(spark, sf):
    """The numbers of each row as the estimators get them, behind the one-hot slots."""
    rows = training.model_ready(training.prepare_training(_dataset(spark, sf), TRAIN_ORDER))
    stages = training.build_model(training.logistic_regression()).getStages()[:-1]
    fitted = Pipeline(stages=stages).fit(rows)
    # Only the slots asked for are spread out: with all of them a row is as wide as there are keys.
    slots = sum(fitted.stages[0].sizes)
    tail = VectorSlicer(inputCol="features", outputCol="tail", indices=[slots + i for i, _ in enumerate(training.NUMERIC)])
    vectors = tail.transform(fitted.transform(rows)).withColumn("__tail", vector_to_array("tail"))
    tail = {c: F.get("__tail", F.lit(i)) for i, c in enumerate(training.NUMERIC)}
    return vectors.select("result_id", *[F.round(v, 6).alias(c) for c, v in tail.items()])


@query(
    "model_reload",
    f"""
SELECT (count(*) - CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT))::BIGINT AS rows_scored, 0::BIGINT AS disagreements
FROM {_DATASET_SQL} t WHERE finished_top_10 IS NOT NULL""",
    *_DATASET_NEEDS,
)
def model_reload(spark, sf):
    """A model that was saved and loaded predicts as the fitted one does."""
    trained = training.train(_dataset(spark, sf), training.logistic_regression(iterations=20), TRAIN_ORDER)
    path = new_path(spark, "model")
    training.save_model(trained.model, path)
    plain = trained.predictions.drop(*[c for c in trained.predictions.columns if c.endswith(("_index", "_vector"))])
    again = training.load_model(path).transform(
        plain.withColumnRenamed("prediction", "before").drop("features", "rawPrediction", "probability")
    )
    return again.agg(
        F.count(F.lit(1)).alias("rows_scored"), F.count_if(F.col("prediction") != F.col("before")).alias("disagreements")
    )


@query(
    "score_reasons",
    """
SELECT result_id, CASE WHEN result_id % 13 = 0 THEN 'No driver data found'
                       WHEN result_id % 19 = 0 THEN 'No constructor data found' END AS reason,
       (result_id % 13 = 0 OR result_id % 19 = 0) AS unscored FROM season_results""",
    "season_results",
)
def score_reasons(spark, sf):
    """Every request comes back: with a prediction, or with the reason why there is none."""
    scored = score_batch(spark, sf)
    return scored.select("result_id", "reason", F.col("prediction").isNull().alias("unscored"))


@query("train_top10")
def train_top10(spark, sf):
    return _trained(spark, sf, training.random_forest())[0].metrics


@query("train_logistic")
def train_logistic(spark, sf):
    return _trained(spark, sf, training.logistic_regression())[0].report


@query("score_batch")
def score_batch(spark, sf):
    """The forest, saved and loaded, on every request."""
    trained, rows, drivers, constructors = _trained(spark, sf, training.random_forest())
    path = new_path(spark, "model")
    training.save_model(trained.model, path)
    return training.score(training.load_model(path), _requests(rows), drivers, constructors)


# Results that a single feature decides, so that any right model predicts them all: grid is the first place or the last.
_DECIDED = {"grid": "CASE WHEN grid <= 10 THEN 1 ELSE 20 END", "position": "CASE WHEN grid <= 10 THEN 1 ELSE 20 END"}


def _separable(spark, sf):
    rows = stable(views.season_results(spark, sf).withColumns({c: F.expr(sql).cast("int") for c, sql in _DECIDED.items()}))
    drivers, constructors = stable(results.driver_stats(rows)), stable(results.constructor_stats(rows))
    return rows, drivers, constructors, results.season_dataset(results.race_features(rows), drivers, constructors)


@query(
    "train_separable",
    """
SELECT model, result_id, CASE WHEN grid <= 10 THEN 1 ELSE 0 END AS prediction FROM (
  SELECT *, row_number() OVER (ORDER BY date NULLS FIRST, round, driver_id, result_id) > floor(count(*) OVER () * 0.8::DOUBLE)
         AS is_test FROM season_results) r, (VALUES ('forest'), ('logistic')) v(model)
WHERE is_test""",
    "season_results",
)
def train_separable(spark, sf):
    """Both models on results that are decided by the grid place: every held-out row is predicted right."""
    dataset = stable(_separable(spark, sf)[-1])
    models = {"forest": training.random_forest(trees=10, depth=3, features="all"), "logistic": training.logistic_regression(100)}
    trained = training.train_each(dataset, list(models.values()), TRAIN_ORDER)
    found = [
        stamp(one.predictions, model=name).select("model", "result_id", F.col("prediction").cast("int").alias("prediction"))
        for name, one in zip(models, trained, strict=True)
    ]
    return union_by_position(found)


@query(
    "score_separable",
    """
SELECT result_id, CASE WHEN reason IS NULL THEN CASE WHEN grid <= 10 THEN 1 ELSE 0 END END AS prediction,
       CASE WHEN reason IS NULL THEN CASE WHEN grid <= 10 THEN 'Top 10' ELSE 'Not Top 10' END END AS label, reason
FROM (SELECT *, CASE WHEN result_id % 13 = 0 THEN 'No driver data found'
                     WHEN result_id % 19 = 0 THEN 'No constructor data found' END AS reason FROM season_results) r""",
    "season_results",
)
def score_separable(spark, sf):
    """A forest that was saved and loaded gives every request its label, or the reason why there is none."""
    rows, drivers, constructors, dataset = _separable(spark, sf)
    model = training.train(dataset, training.random_forest(trees=10, depth=3, features="all"), TRAIN_ORDER, whole_days=True).model
    path = new_path(spark, "model")
    training.save_model(model, path)
    scored = training.score(training.load_model(path), _requests(rows), drivers, constructors)
    return scored.select("result_id", "prediction", "label", "reason")


@query(
    "metric_log",
    f"""
SELECT run, metric, value FROM (
  SELECT 'first' AS run, unnest(['accuracy', 'f1', 'precision', 'recall']) AS metric,
         unnest([accuracy, CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall)
                 ELSE 0 END, precision, recall]) AS value FROM ({_RATES_SQL}) r
  UNION ALL
  SELECT 'second', unnest(['accuracy', 'f1', 'precision', 'recall']),
         unnest([accuracy, CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall)
                 ELSE 0 END, precision, recall]) FROM ({_RATES_SQL}) r) m""",
)
def metric_log(spark, sf):
    path = new_path(spark, "metrics")
    for run in ("first", "second"):
        training.log_metrics(binary_metrics(_judged(spark, sf)), run, path)
    return read_table(spark, path)


# Whole lakes -------------------------------------------------------------------------------------------------


@query("lake_season_results", "SELECT * FROM lake_rows", "lake_rows")
def lake_season_results(spark, sf):
    path = new_path(spark, "lake")
    flat = views.flat_results(views.season_results(spark, sf))
    documents.write_documents(documents.nest_results(flat, ["result_id"]), f"{path}/documents")
    lake = Lake(spark, path)
    run_season_results(lake, f"{path}/documents", multi_line=False)
    return lake.read("gold", "race_features")


view("lake_silver", "raw_laps", "race_weather", "race_results")(f"""
SELECT d.season, d.race, d.driver, d.lap_number, l.driver_number, l.lapstartdate, d.lap_time_ms,
       CAST(NULL AS INT) AS position, CAST(NULL AS INT) AS stint, coalesce(d.compound, 'UNKNOWN') AS compound,
       CAST(d.tyrelife AS INT) AS tyre_life, coalesce(TRY_CAST(d.freshtyre AS BOOLEAN), false) AS fresh_tyre,
       d.pit_in IS NOT NULL AS is_pit_in_lap, d.pit_out IS NOT NULL AS is_pit_out_lap,
       (d.pit_in IS NOT NULL OR d.pit_out IS NOT NULL) AS is_pit_lap, {_TRACK_SQL},
       coalesce(w.rainfall, false) AS is_raining, w.airtemp AS air_temp, w.humidity, w.pressure,
       w.tracktemp AS track_temp, w.winddirection AS wind_direction, w.windspeed AS wind_speed,
       r.gridposition AS grid_position, r.position AS finish_position, r.status AS race_status, r.teamname AS team_name
FROM (SELECT *, {_duration_sql("laptime")} AS lap_time_ms, {_duration_sql("pitintime")} AS pit_in,
             {_duration_sql("pitouttime")} AS pit_out FROM raw_laps) d
JOIN race_laps l ON d.season = l.season AND d.race = l.race AND d.driver = l.driver AND d.lap_number = l.lap_number
LEFT JOIN race_weather w ON d.season = w.season AND d.race = w.race AND d.driver = w.driver
     AND d.lap_number = w.lap_number
LEFT JOIN race_results r ON d.season = r.season AND d.race = r.race AND d.driver = r.abbreviation
WHERE d.lap_time_ms IS NOT NULL
""")
ORACLES["lake_laps"] = with_views(
    _LAP_ML_SQL, "next_compound", "driver_form", "constructor_form", instead={"silver_race_laps": "lake_silver"}
)


def _raw_table(df: DataFrame, session_type: str = "R") -> DataFrame:
    metadata = {"source": "provider", "ingestion_timestamp": "2024-01-01T00:00:00+00:00", "session_type": session_type}
    return stamp(df.withColumn("grand_prix", F.col("race")).drop("race"), **metadata)


def _raw_lake(spark: SparkSession, sf: str) -> Lake:
    """A lake with the raw session tables of every season and race. Laps are dealt to buckets of a driver's race once."""
    rows = stable_bucketed(views.race_laps(spark, sf, default_buckets(spark)), datasets.DRIVER_KEY, ["lap_number"], placed=True)
    lake = Lake(spark, new_path(spark, "lake"))

    texts = views.raw_laps(rows).withColumnsRenamed(
        {"laptime": "LapTime", "pitintime": "PitInTime", "pitouttime": "PitOutTime", "trackstatus": "TrackStatus",
         "freshtyre": "FreshTyre", "compound": "Compound", "tyrelife": "TyreLife", "lap_number": "LapNumber"}
    )
    dates = rows.select(*laps.LAP_KEY, "lapstartdate", "driver_number").withColumnsRenamed(
        {"lapstartdate": "LapStartDate", "driver_number": "DriverNumber", "lap_number": "LapNumber"}
    )
    with stay(spark):
        write_raw_session(lake, "laps", _raw_table(texts.join(dates, ["season", "race", "driver", "LapNumber"])))
        write_raw_session(lake, "lap_weather", _raw_table(views.race_weather(rows)))
        write_raw_session(lake, "results", _raw_table(views.race_results(rows)))
    return lake


@query("lake_laps")
def lake_laps(spark, sf):
    """Raw session tables of every season and race through all layers to the lap table for models."""
    lake = _raw_lake(spark, sf)
    run_laps(lake)
    return rounded(lake.read("gold", "lap_ml_table"), *JOINED_MEANS)


@query(
    "lake_rerun",
    """
SELECT season, race, driver, lap_number, lap_time_ms FROM lake_silver WHERE NOT (season = 1995 AND race = 'race_3')""",
    "lake_silver",
)
def lake_rerun(spark, sf):
    """A race that comes again without times loses its rows, and another session type changes nothing."""
    lake = _raw_lake(spark, sf)
    to_bronze(lake)
    to_silver(lake)
    race = lake.read("raw", "laps").filter("season = 1995 and race = 'race_3'").drop("session_type")
    untimed = stable(race.withColumn("LapTime", F.lit("NaT")))
    write_raw_session(lake, "laps", stamp(untimed, session_type="R"))
    other = stable(lake.read("raw", "laps").filter("season = 1995 and race = 'race_4'").drop("session_type"))
    write_raw_session(lake, "laps", stamp(other, session_type="Q"))
    again = Lake(spark, lake.root, seasons=[1995])
    to_bronze(again)
    to_silver(again)
    return lake.read("silver", "laps").select("season", "race", "driver", "lap_number", "lap_time_ms")
