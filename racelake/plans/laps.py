"""Laps: raw session tables to bronze to one clean row for each driver and lap."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from racelake.functions import duration_ms, has_token, is_known, slug, to_double
from racelake.operators.columns import fill, normalize_names, rename_present, stamp
from racelake.operators.ordered import add_row_number
from racelake.operators.relations import left_enrich
from racelake.schemas import LAPS, TYPES, fitted

log = logging.getLogger(__name__)

# Column names, codes and defaults.
SILVER_NAMES = {
    "lapnumber": "lap_number",
    "laptime": "lap_time_ms",
    "sector1time": "sector1_time_ms",
    "sector2time": "sector2_time_ms",
    "sector3time": "sector3_time_ms",
    "pitintime": "pit_in_time_ms",
    "pitouttime": "pit_out_time_ms",
    "lapstarttime": "lap_start_time_ms",
    "trackstatus": "track_status",
    "tyrelife": "tyre_life",
    "freshtyre": "fresh_tyre",
    "isaccurate": "is_accurate",
    "drivernumber": "driver_number",
    "airtemp": "air_temp",
    "tracktemp": "track_temp",
    "winddirection": "wind_direction",
    "windspeed": "wind_speed",
}
DURATIONS = [
    "lap_time_ms",
    "sector1_time_ms",
    "sector2_time_ms",
    "sector3_time_ms",
    "pit_in_time_ms",
    "pit_out_time_ms",
    "lap_start_time_ms",
    "q1",
    "q2",
    "q3",
    "time",
]
EXTRA_TYPES = {"laps": "int", "points": "double"}
DEFAULTS = {
    "fresh_tyre": False,
    "rainfall": False,
    "deleted": False,
    "fastf1generated": False,
    "is_accurate": False,
    "compound": "UNKNOWN",
    "track_status": "",
}
TRACK_FLAGS = {"is_green": "1", "is_yellow": "2", "is_safety_car": "4", "is_red_flag": "5", "is_vsc": "6"}
WEATHER = ["airtemp", "humidity", "pressure", "rainfall", "tracktemp", "winddirection", "windspeed"]
RESULT_NAMES = {
    "abbreviation": "driver",
    "gridposition": "grid_position",
    "position": "finish_position",
    "status": "race_status",
    "teamname": "team_name",
}
LAP_KEY = ["season", "race", "driver", "lap_number"]
ENTRY_KEY = ["season", "race", "driver"]


# Raw ---------------------------------------------------------------------------------------------------------


def storable(df: DataFrame) -> DataFrame:
    """Intervals as duration text (`0 days 00:01:27.512000`); null stays null."""
    spans = [f.name for f in df.schema if isinstance(f.dataType, T.DayTimeIntervalType)]
    return df.withColumns({c: _span_text(c) for c in spans})


def _span_text(name: str) -> Column:
    def part(unit: str, micros: int) -> Column:
        return (F.expr(f"extract({unit} from `{name}`)") * F.lit(micros).cast("long")).cast("long")

    micros = part("DAY", 86_400_000_000) + part("HOUR", 3_600_000_000) + part("MINUTE", 60_000_000)
    micros = micros + part("SECOND", 1_000_000)
    days = F.floor(micros / 86_400_000_000).cast("long")
    rest = micros - days * 86_400_000_000
    seconds = F.floor(rest / 1_000_000).cast("long")
    fraction = rest % 1_000_000
    clock = F.format_string(
        "%d days %s%02d:%02d:%02d",
        days,
        F.when(days < 0, "+").otherwise(""),
        F.floor(seconds / 3600).cast("int"),
        F.floor(seconds / 60).cast("int") % 60,
        seconds % 60,
    )
    text = F.when(fraction > 0, F.concat(clock, F.format_string(".%06d", fraction))).otherwise(clock)
    return F.when(F.col(name).isNotNull(), text)


def with_metadata(
    df: DataFrame, season: int, grand_prix: str, session_type: str, source: str, ingested_at: str
) -> DataFrame:
    """The five ingest columns. The time is an argument, so that a rerun gives the same rows."""
    return stamp(
        df,
        season=season,
        grand_prix=grand_prix,
        session_type=session_type,
        source=source,
        ingestion_timestamp=ingested_at,
    )


def align_rows(
    rows: DataFrame,
    other: DataFrame,
    by: Sequence[str],
    rows_order: Sequence[str],
    other_order: Sequence[str],
    columns: dict[str, str],
    split: bool = False,
) -> DataFrame:
    """`other` with the columns of the row at the same place in `rows`, place being the order within `by`.

    `columns` maps names in `rows` to names in the result.
    """
    number = "__place"
    given = add_row_number(rows, by, rows_order, number, split)
    named = given.select(*by, number, *[F.col(c).alias(new) for c, new in columns.items()])
    return left_enrich(add_row_number(other, by, other_order, number, split), named, [*by, number]).drop(number)


# Bronze ------------------------------------------------------------------------------------------------------


def bronze(raw: DataFrame, table: str, session_type: str = "R") -> DataFrame:
    """Tidy names, source stamp and the partition keys of every session in `raw` at once: `season`, and `race`
    as the slug of the grand prix."""
    tidy = normalize_names(raw)
    race = F.col("race") if "race" in tidy.columns else F.col("grand_prix")
    return stamp(tidy, source_table=table, session_type=session_type).withColumns(
        {"season": F.col("season").cast("int"), "race": slug(race)}
    )


# Silver ------------------------------------------------------------------------------------------------------


def with_weather(laps: DataFrame, weather: DataFrame, unique: bool = False) -> DataFrame:
    """Laps with their weather. A lap with two weather rows appears twice, unless `unique`."""
    return left_enrich(laps, weather, LAP_KEY, WEATHER, unique)


def with_results(laps: DataFrame, results: DataFrame) -> DataFrame:
    """Laps with grid, finish, status and team of their driver's one result row in the race."""
    named = results.select("season", "race", *[F.col(c).alias(new) for c, new in RESULT_NAMES.items()])
    added = [c for c in named.columns if c not in ENTRY_KEY]
    return left_enrich(laps.drop(*added), named, ENTRY_KEY, unique=True)


def prepare(laps: DataFrame, separator: str | None = ";") -> DataFrame:
    """Typed, filled and flagged laps; laps without a time are dropped, unless the table has no times at all.

    Columns of the silver table that the input lacks become typed nulls, other columns pass.
    """
    named = rename_present(laps, SILVER_NAMES)
    types = dict(named.dtypes)

    def typed(name: str) -> Column:
        if name not in types:
            return F.lit(None).cast(wanted[name])
        if name in DURATIONS:
            return _milliseconds(F.col(name), types[name])
        return fitted(F.col(name), wanted[name]) if name in wanted else F.col(name)

    wanted = {f.name: f.dataType for f in LAPS} | {c: TYPES[t] for c, t in EXTRA_TYPES.items()}
    columns = [*LAPS.names, *[c for c in named.columns if c not in LAPS.names]]
    timed = named.select(*[typed(c).alias(c) for c in columns])
    if "lap_time_ms" in types:
        timed = timed.filter(F.col("lap_time_ms").isNotNull())
    else:
        log.warning("a lap table without lap times: all its laps are kept")
    return with_flags(fill(timed, DEFAULTS), separator)


def _milliseconds(value: Column, dtype: str) -> Column:
    return duration_ms(value) if dtype == "string" else F.when(value >= 0, to_double(value))


def with_flags(laps: DataFrame, separator: str | None = ";") -> DataFrame:
    """Pit, track-status and rain flags; a column that is absent sets no flag."""
    none = F.lit(False)

    def known(name: str) -> Column:
        return is_known(F.col(name)) if name in laps.columns else none

    def status(token: str) -> Column:
        return has_token(F.col("track_status"), token, separator) if "track_status" in laps.columns else none

    rain = F.coalesce(F.col("rainfall"), none) if "rainfall" in laps.columns else none
    return laps.withColumns(
        {
            "is_pit_in_lap": known("pit_in_time_ms"),
            "is_pit_out_lap": known("pit_out_time_ms"),
            "is_pit_lap": known("pit_in_time_ms") | known("pit_out_time_ms"),
            **{name: status(token) for name, token in TRACK_FLAGS.items()},
            "is_raining": rain,
        }
    )


def silver(
    laps: DataFrame,
    weather: DataFrame | None = None,
    results: DataFrame | None = None,
    separator: str | None = ";",
    unique_weather: bool = False,
) -> DataFrame:
    """Bronze tables, any number of sessions, to clean laps. A missing table, or one without its key columns,
    leaves its columns null; so does a single column that is missing."""

    def usable(table: DataFrame | None, name: str, keys: Sequence[str]) -> bool:
        missing = [] if table is None else [c for c in keys if c not in table.columns]
        if missing:
            log.warning("%s is left out, it lacks %s", name, ", ".join(missing))
        return table is not None and not missing

    def filled(table: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
        missing = [c for c in columns if c not in table.columns]
        if missing:
            log.warning("%s has no %s", name, ", ".join(missing))
        return table.withColumns({c: F.lit(None).cast("string") for c in missing})

    keyed = rename_present(laps, {"lapnumber": "lap_number"})
    keyed = keyed.withColumn("lap_number", fitted(F.col("lap_number"), T.IntegerType()))
    if usable(weather, "weather", LAP_KEY):
        placed = filled(weather, WEATHER, "weather").withColumn("lap_number", fitted(F.col("lap_number"), T.IntegerType()))
        keyed = with_weather(keyed.drop(*WEATHER), placed, unique_weather)
    if usable(results, "results", ["season", "race", "abbreviation"]):
        keyed = with_results(keyed, filled(results, list(RESULT_NAMES), "results"))
    return prepare(keyed, separator)
