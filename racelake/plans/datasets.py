"""Feature tables: race prediction, lap prediction, and the lap table for models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelake.functions import null_when
from racelake.operators.columns import fill, first_present, flags_to_int, prefix_only, presence_flags
from racelake.operators.ordered import Past, add_next_known, add_past
from racelake.operators.relations import left_enrich
from racelake.plans.summaries import FORM_NAMES, TEAM_RACE

# Keys, columns and defaults.
DRIVER_KEY = ["season", "race", "driver"]
CONTEXT = ["season", "race", "driver", "driver_number", "team_name", "lap_number"]
CONDITIONS = [
    "position",
    "stint",
    "compound",
    "tyre_life",
    "fresh_tyre",
    "is_pit_lap",
    "is_pit_in_lap",
    "is_pit_out_lap",
    "is_green",
    "is_yellow",
    "is_safety_car",
    "is_red_flag",
    "is_vsc",
    "air_temp",
    "humidity",
    "pressure",
    "track_temp",
    "wind_direction",
    "wind_speed",
    "is_raining",
]
LAP_HISTORY = [
    Past("last_lap_time_ms", "lap_time_ms", 1, "value"),
    Past("last_lap_is_green", "is_green", 1, "value"),
    Past("last_lap_is_yellow", "is_yellow", 1, "value"),
    Past("last_lap_is_safety_car", "is_safety_car", 1, "value"),
    Past("avg_lap_time_last_2", "lap_time_ms", 2),
    Past("avg_lap_time_last_3", "lap_time_ms", 3),
]
LAP_FLAGS = [
    "fresh_tyre",
    "is_pit_lap",
    "is_pit_in_lap",
    "is_pit_out_lap",
    "is_green",
    "is_yellow",
    "is_safety_car",
    "is_red_flag",
    "is_vsc",
    "last_lap_is_green",
    "last_lap_is_yellow",
    "last_lap_is_safety_car",
    "is_raining",
]
NO_COMPOUND = ("nan", "UNKNOWN")
TYRE_DEFAULTS = {"tyre_life": 0, "stint": 1}
HISTORY_FLAGS = {
    "driver_history_available": "driver_avg_finish_last_3",
    "constructor_history_available": "constructor_avg_finish_last_3",
    "last_lap_history_available": "last_lap_time_ms",
}
FORM_DEFAULTS = {
    "avg_finish_last_3": 10,
    "avg_finish_last_5": 10,
    "avg_position_gain_last_5": 0,
    "top_10_count_last_5": 0,
    "podium_count_last_5": 0,
    "dnf_count_last_5": 0,
}
HISTORY_DEFAULTS = {
    **{f"driver_{c}": v for c, v in FORM_DEFAULTS.items()},
    **{f"constructor_{c}": v for c, v in FORM_DEFAULTS.items()},
    **{p.name: 0 for p in LAP_HISTORY},
}


def race_dataset(summary: DataFrame, driver_form: DataFrame, team_form: DataFrame) -> DataFrame:
    """Each driver's race with both forms and the top-10 target."""
    teams = prefix_only(team_form.select(*TEAM_RACE, *FORM_NAMES), "constructor_", FORM_NAMES)
    joined = left_enrich(left_enrich(summary, driver_form, DRIVER_KEY, FORM_NAMES), teams, TEAM_RACE)
    return joined.select(
        "season",
        "race",
        "race_date",
        "driver",
        "team_name",
        "grid_position",
        *FORM_NAMES,
        *[f"constructor_{c}" for c in FORM_NAMES],
        "finished_top_10",
    )


def lap_dataset(laps: DataFrame, split: bool = False) -> DataFrame:
    """Each timed lap with what was known from the laps before it; the target is its own time.

    Laps without a time are dropped last: they still count as the previous lap.
    """
    started = first_present(laps, "lapstartdate", "lap_start_time_ms").alias("lap_context_time")
    needed = laps.select(*CONTEXT, started, *CONDITIONS, "lap_time_ms")
    known = add_past(needed, DRIVER_KEY, ["lap_number"], LAP_HISTORY, split)
    return known.select(
        *CONTEXT,
        "lap_context_time",
        *CONDITIONS,
        *[p.name for p in LAP_HISTORY],
        F.col("lap_time_ms").alias("target_lap_time_ms"),
    ).filter(F.col("target_lap_time_ms").isNotNull())


def known_compound(
    laps: DataFrame, sentinels: Sequence[str] = NO_COMPOUND, split: bool = False
) -> DataFrame:
    """An unknown compound takes the next known one of the race; laps with none to come are dropped."""
    marked = laps.withColumn("compound", null_when(F.col("compound"), *sentinels))
    filled = add_next_known(marked, DRIVER_KEY, ["lap_number"], "compound", split=split)
    return filled.filter(F.col("compound").isNotNull())


def history_filled(df: DataFrame) -> DataFrame:
    """Flags for which history exists, then defaults in place of the missing history."""
    return fill(presence_flags(df, HISTORY_FLAGS), HISTORY_DEFAULTS)


def lap_history(driver_form: DataFrame, team_form: DataFrame) -> DataFrame:
    """Both forms at the grain of a driver's race: the driver's own under its prefix, and `teams`, a map from the teams
    the driver raced for in it to the team's form. Nothing here is as long as a lap table."""
    drivers = prefix_only(driver_form.select(*DRIVER_KEY, "team_name", *FORM_NAMES), "driver_", FORM_NAMES)
    teams = team_form.select(*TEAM_RACE, F.struct(*FORM_NAMES).alias("form"))
    entered = left_enrich(drivers, teams, TEAM_RACE)
    own = F.struct(*[f"driver_{c}" for c in FORM_NAMES])
    known = F.col("team_name").isNotNull() & F.col("form").isNotNull()
    gathered = entered.groupBy(*DRIVER_KEY).agg(
        F.collect_list(own).alias("own"),
        F.map_from_entries(F.collect_set(F.when(known, F.struct("team_name", "form")))).alias("teams"),
    )
    return gathered.select(*DRIVER_KEY, "teams", F.inline("own"))


def lap_ml_table_as_stored(
    laps: DataFrame, history: DataFrame, sentinels: Sequence[str] = NO_COMPOUND, ordered: bool = True, keep_time: bool = False
) -> DataFrame:
    """`lap_ml_table` for laps and history (of the same laps) in buckets of the driver's key: the fill and the only
    join go by that key, so laps stay where they are stored."""
    filled = fill(known_compound(laps, sentinels), TYRE_DEFAULTS)
    team = F.try_element_at("teams", F.col("team_name"))
    joined = left_enrich(filled, history, DRIVER_KEY)
    return _completed(
        joined.select(*[c for c in joined.columns if c != "teams"], *[team[c].alias(f"constructor_{c}") for c in FORM_NAMES]),
        ordered,
        keep_time,
    )


def lap_ml_table(
    laps: DataFrame,
    driver_form: DataFrame,
    team_form: DataFrame,
    sentinels: Sequence[str] = NO_COMPOUND,
    split: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """The lap dataset with both forms, without gaps, in time order.

    The compound is filled before the joins, so that the window sorts narrow rows.
    """
    drivers = prefix_only(driver_form.select(*DRIVER_KEY, *FORM_NAMES), "driver_", FORM_NAMES)
    teams = prefix_only(team_form.select(*TEAM_RACE, *FORM_NAMES), "constructor_", FORM_NAMES)
    filled = fill(known_compound(laps, sentinels, split), TYRE_DEFAULTS)
    return _completed(left_enrich(left_enrich(filled, drivers, DRIVER_KEY), teams, TEAM_RACE), ordered)


TIME_ORDER = ["lap_context_time", "driver", "lap_number"]


def _completed(joined: DataFrame, ordered: bool, keep_time: bool = False) -> DataFrame:
    complete = history_filled(flags_to_int(joined, LAP_FLAGS))
    if ordered:
        complete = complete.orderBy(*TIME_ORDER)
    return complete.drop("driver_number") if keep_time else complete.drop("lap_context_time", "driver_number")
