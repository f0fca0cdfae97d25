"""The race calendar: which races belong to which season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racelake.functions import slug
from racelake.operators.ordered import add_row_number

# Fixed value: what the name of a race weekend contains.
RACE_WEEKEND = "Grand Prix"


def read_calendar(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """`{"2019": ["Australia", …], …}` as rows (season int, race_order int, race string)."""
    try:
        text = spark.read.text(path, wholetext=multi_line)
    except AnalysisException as problem:
        raise FileNotFoundError(f"no calendar at {path}") from problem
    seasons = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("season", "races"))
    return seasons.select(
        F.col("season").try_cast("int").alias("season"), F.posexplode("races").alias("race_order", "race")
    )


def races_of(calendar: DataFrame, season: int) -> DataFrame:
    """The races of a season in order; no rows for a season that the calendar lacks."""
    return calendar.filter(F.col("season") == season).orderBy("race_order")


def build_calendar(
    events: DataFrame,
    season: str = "season",
    event_name: str = "event_name",
    country: str = "country",
    order: Sequence[str] = ("event_order",),
    split: bool = False,
    race: str | None = None,
) -> DataFrame:
    """Rows (season, race_order, race) of the race weekends among `events`; an event without a name is none.

    A race is called by its country, or by the column `race`; the event's name also tells two races in one country apart.
    """
    weekends = events.filter(F.coalesce(F.col(event_name).contains(RACE_WEEKEND), F.lit(False)))
    numbered = add_row_number(weekends, [season], list(order), "__n", split)
    return numbered.select(
        F.col(season).alias("season"), (F.col("__n") - 1).cast("int").alias("race_order"), F.col(race or country).alias("race")
    )


def in_calendar(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """The rows of `df` (season, race slug) whose race is in the calendar."""
    listed = calendar.select("season", slug(F.col("race")).alias("race"))
    return df.join(listed, ["season", "race"], "left_semi")
