"""Race summaries and recent form of drivers and constructors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from racelake.functions import as_flag, at_most, differs, gain
from racelake.operators.columns import first_present
from racelake.operators.ordered import Past, add_past
from racelake.plans.results import PODIUM, TOP

# Keys, and the status of a finisher.
DRIVER_RACE = ["season", "race", "driver", "team_name"]
TEAM_RACE = ["season", "race", "team_name"]
ENTRY_FACTS = ["grid_position", "finish_position", "race_status"]
FINISHED = ("Finished",)


def driver_race_summary(laps: DataFrame, finished: Sequence[str] = FINISHED) -> DataFrame:
    """One row for each driver, race and team: laps, lap times, stops, grid, finish, status and derived flags.

    Grid, finish and status are the first known value in lap order. They hardly vary within a race, so laps
    are first combined by key and these values, where every running total is a number and the hash aggregate
    needs no sort; picking the first value then works on a row or two for each driver and race.
    """
    started = first_present(laps, "lapstartdate", "lap_start_time_ms")
    combined = laps.groupBy(*DRIVER_RACE, *ENTRY_FACTS).agg(
        F.min(started).alias("race_date"),
        F.count("*").alias("laps"),
        F.count("lap_time_ms").alias("timed"),
        F.sum("lap_time_ms").alias("time"),
        F.min("lap_time_ms").alias("best"),
        F.sum(as_flag(F.col("is_pit_lap"))).alias("stops"),
        F.min("lap_number").alias("first_lap"),
    )

    def first_known(name: str) -> Column:
        value = F.col(name)
        return F.min(F.when(value.isNotNull(), F.struct("first_lap", name)))[name].alias(name)

    summary = combined.groupBy(*DRIVER_RACE).agg(
        F.min("race_date").alias("race_date"),
        F.sum("laps").alias("laps_completed"),
        (F.sum("time") / F.sum("timed")).alias("avg_lap_time_ms"),
        F.min("best").alias("best_lap_time_ms"),
        F.sum("stops").alias("pit_stop_count"),
        *[first_known(c) for c in ENTRY_FACTS],
    )
    finish = F.col("finish_position")
    return summary.withColumns(
        {
            "position_gain": gain(F.col("grid_position"), finish),
            "finished_top_10": at_most(finish, TOP),
            "finished_top_3": at_most(finish, PODIUM),
            "dnf_flag": differs(F.col("race_status"), *finished),
        }
    )


def constructor_race_summary(drivers: DataFrame) -> DataFrame:
    """One row for each team and race, from the drivers' summaries; drivers weigh alike in the lap-time mean."""
    return drivers.groupBy(*TEAM_RACE).agg(
        F.min("race_date").alias("race_date"),
        F.count("*").alias("num_drivers"),
        F.avg("finish_position").alias("avg_finish_position"),
        F.min("finish_position").alias("best_finish_position"),
        F.sum("position_gain").alias("total_position_gain"),
        F.avg("avg_lap_time_ms").alias("avg_lap_time_ms"),
        F.min("best_lap_time_ms").alias("best_lap_time_ms"),
        F.sum("pit_stop_count").alias("total_pit_stops"),
        F.sum("finished_top_10").alias("top_10_finishes"),
        F.sum("finished_top_3").alias("podium_finishes"),
        F.sum("dnf_flag").alias("dnf_count"),
    )


def form(finish: str, gained: str, top: str, podium: str, dnf: str) -> list[Past]:
    """The six trailing measures over the three or five races before."""
    return [
        Past("avg_finish_last_3", finish, 3),
        Past("avg_finish_last_5", finish, 5),
        Past("avg_position_gain_last_5", gained, 5),
        Past("top_10_count_last_5", top, 5, "sum"),
        Past("podium_count_last_5", podium, 5, "sum"),
        Past("dnf_count_last_5", dnf, 5, "sum"),
    ]


DRIVER_FORM = form("finish_position", "position_gain", "finished_top_10", "finished_top_3", "dnf_flag")
TEAM_FORM = form("avg_finish_position", "total_position_gain", "top_10_finishes", "podium_finishes", "dnf_count")
FORM_NAMES = [p.name for p in DRIVER_FORM]


def recent_form(
    summary: DataFrame, entity: str, past: Sequence[Past], carry_over: bool = False, split: bool = False
) -> DataFrame:
    """`summary` with form over the entity's earlier races, restarting each season unless `carry_over`.

    A summary holds one row for each race of an entity, so a group is as long as a season. Where that is not
    so (`carry_over`, rows without a driver or team), pass `split`.
    """
    by = [entity] if carry_over else [entity, "season"]
    return add_past(summary, by, RACE_ORDER, past, split)


#: Rows of a summary that a form can look back at, and the order of an entity's races.
DEPTH = max(p.rows for p in DRIVER_FORM)
RACE_ORDER = ["race_date", "race"]


def carried_form(
    summary: DataFrame, entity: str, past: Sequence[Past], before: DataFrame | None = None, split: bool = False
) -> DataFrame:
    """Form across seasons for a summary of some seasons, taken up from the state that the season before left."""
    if before is None:
        return recent_form(summary, entity, past, carry_over=True, split=split)
    earlier = before.select(entity, *RACE_ORDER, *_measures(past)).withColumn("__earlier", F.lit(True))
    rows = summary.withColumn("__earlier", F.lit(False)).unionByName(earlier, allowMissingColumns=True)
    done = add_past(rows, [entity], RACE_ORDER, past, split)
    return done.filter(~F.col("__earlier")).drop("__earlier")


def form_state(
    summary: DataFrame, entity: str, past: Sequence[Past], seasons: Sequence[int], before: DataFrame | None = None
) -> DataFrame:
    """What form after each of `seasons` (`as_of`) has to know: the last races of every entity up to then.

    Entities that don't race in a season keep what they had, so one season's state is enough to go on from. Rows are
    cut to the last few of each entity and season before they are spread over the seasons that follow.
    """
    columns = [entity, *RACE_ORDER, *_measures(past)]
    rows = summary.select("season", *columns)
    if before is not None:
        rows = rows.unionByName(before.select(F.lit(None).cast(rows.schema["season"].dataType).alias("season"), *columns))
    latest = [F.desc(c) for c in RACE_ORDER]
    depth = max(p.rows for p in past)

    def last_of(df: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*latest))
        return df.withColumn("__rank", rank).filter(F.col("__rank") <= depth).drop("__rank")

    ends = F.array(*[F.lit(s).cast("int") for s in sorted(seasons)])
    follows = F.filter(ends, lambda s: F.coalesce(s >= F.col("season"), F.lit(True)))
    spread = last_of(rows, entity, "season").withColumn("as_of", F.explode(follows)).drop("season")
    return last_of(spread, entity, "as_of").select("as_of", *columns)


def _measures(past: Sequence[Past]) -> list[str]:
    return list(dict.fromkeys(p.source for p in past))


def driver_recent_form(summary: DataFrame, carry_over: bool = False, split: bool = False) -> DataFrame:
    return recent_form(summary, "driver", DRIVER_FORM, carry_over, split)


def constructor_recent_form(summary: DataFrame, carry_over: bool = False, split: bool = False) -> DataFrame:
    return recent_form(summary, "team_name", TEAM_FORM, carry_over, split)
