"""Season results: documents to typed rows, career statistics, race features, prediction dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelake.functions import as_flag, at_most, gain
from racelake.operators.columns import prefix_except, rename_present
from racelake.operators.relations import distinct_rows, left_enrich
from racelake.schemas import RESULTS, conform
from racelake.sources.lookup import look_up

# Names after cleaning, and the places that count.
CLEAN_NAMES = {
    "raceName": "race_name",
    "circuitId": "circuit_id",
    "circuitName": "circuit_name",
    "driverId": "driver_id",
    "givenName": "given_name",
    "familyName": "family_name",
    "constructorId": "constructor_id",
}
TOP, PODIUM, WINNER = 10, 3, 1


def clean_results(flat: DataFrame) -> DataFrame:
    """Typed, snake-case, without repeated rows. Values that do not parse become null."""
    return distinct_rows(conform(rename_present(flat, CLEAN_NAMES), RESULTS))


def race_features(results: DataFrame) -> DataFrame:
    """Each result with its top-10 and podium flags and places gained; an unknown place is neither."""
    place = F.col("position")
    return results.withColumns(
        {
            "finished_top_10": at_most(place, TOP),
            "finished_top_3": at_most(place, PODIUM),
            "position_gain": gain(F.col("grid"), place),
        }
    )


def career_stats(results: DataFrame, key: str, prefix: str, wins_within: int = WINNER) -> DataFrame:
    """Seven measures for each `key` over all its results, the raced one included.

    Only sums and counts are kept while combining, so a heavy key is reduced before the shuffle.
    """
    place = F.col("position")

    def finishes(limit: int):
        return F.sum(as_flag(place <= limit))

    stats = results.groupBy(key).agg(
        F.count("*").alias("num_races"),
        F.avg(place).alias("avg_position"),
        F.avg("points").alias("avg_points"),
        finishes(wins_within).alias("wins"),
        finishes(TOP).alias("top10_finishes"),
        finishes(PODIUM).alias("podium_finishes"),
        F.avg(gain(F.col("grid"), place)).alias("avg_position_gain"),
    )
    return prefix_except(stats, prefix, [key])


def career_shares(results: DataFrame, key: str, wins_within: int = WINNER) -> DataFrame:
    """What each season adds to the career of each `key`: sums and counts, which can be added up."""
    place, gained = F.col("position"), gain(F.col("grid"), F.col("position"))

    def within(limit: int):
        return F.sum(as_flag(place <= limit))

    return results.groupBy("season", key).agg(
        F.count("*").alias("num_races"),
        F.sum(place).alias("position_sum"),
        F.count(place).alias("position_n"),
        F.sum("points").alias("points_sum"),
        F.count("points").alias("points_n"),
        within(wins_within).alias("wins"),
        within(TOP).alias("top10_finishes"),
        within(PODIUM).alias("podium_finishes"),
        F.sum(gained).alias("gain_sum"),
        F.count(gained).alias("gain_n"),
    )


def merged_careers(shares: DataFrame, key: str, prefix: str) -> DataFrame:
    """`career_stats` from the shares of any seasons."""

    def mean(name: str):
        n = F.sum(f"{name}_n")
        return F.when(n > 0, F.sum(f"{name}_sum") / n)

    stats = shares.groupBy(key).agg(
        F.sum("num_races").alias("num_races"),
        mean("position").alias("avg_position"),
        mean("points").alias("avg_points"),
        *[F.sum(c).alias(c) for c in ("wins", "top10_finishes", "podium_finishes")],
        mean("gain").alias("avg_position_gain"),
    )
    return prefix_except(stats, prefix, [key])


def driver_stats(results: DataFrame) -> DataFrame:
    return career_stats(results, "code", "driver_")


def constructor_stats(results: DataFrame, wins_within: int = TOP) -> DataFrame:
    """`constructor_wins` counts top-10 places by default, as existing tables do; `wins_within=1` counts wins."""
    return career_stats(results, "constructor_id", "constructor_", wins_within)


def season_dataset(features: DataFrame, drivers: DataFrame, constructors: DataFrame) -> DataFrame:
    return left_enrich(left_enrich(features, drivers, ["code"]), constructors, ["constructor_id"])


# The model's columns, in order.
MODEL_INPUT = ["season", "round", "grid", "circuit_id", "driver_id", "constructor_id"]
CAREER_FEATURES = [
    "avg_points",
    "avg_position",
    "num_races",
    "top10_finishes",
    "podium_finishes",
    "avg_position_gain",
]
FEATURES = [
    *MODEL_INPUT,
    *[f"driver_{c}" for c in CAREER_FEATURES],
    *[f"constructor_{c}" for c in CAREER_FEATURES],
]


def look_up_features(requests: DataFrame, drivers: DataFrame, constructors: DataFrame) -> DataFrame:
    """The model's columns for each request (with `code`; `driver_id` is taken as the code if there is none),
    and `reason`: null, or which key is unknown."""
    if "code" not in requests.columns:
        requests = requests.withColumn("code", F.col("driver_id"))
    wanted = season_dataset(
        requests,
        drivers.select("code", *[f"driver_{c}" for c in CAREER_FEATURES]),
        constructors.select("constructor_id", *[f"constructor_{c}" for c in CAREER_FEATURES]),
    )
    # The texts of both reasons. num_races is a count, so it is null only where the join found nothing.
    reason = F.when(F.col("driver_num_races").isNull(), "No driver data found").when(
        F.col("constructor_num_races").isNull(), "No constructor data found"
    )
    others = [c for c in requests.columns if c not in FEATURES and c != "code"]
    return wanted.select(*others, *FEATURES, reason.alias("reason"))


def look_up_stored(
    requests: DataFrame, driver_path: str, constructor_path: str, fmt: str = "parquet"
) -> DataFrame:
    """`look_up_features` from career tables that `write_lookup` has stored: a few requests read the folders of their
    keys, not all careers."""
    if "code" not in requests.columns:
        requests = requests.withColumn("code", F.col("driver_id"))
    spark = requests.sparkSession
    drivers = look_up(spark, driver_path, "code", requests, fmt)
    constructors = look_up(spark, constructor_path, "constructor_id", requests, fmt)
    return look_up_features(requests, drivers, constructors)


def accepted(looked_up: DataFrame) -> DataFrame:
    return looked_up.filter(F.col("reason").isNull()).drop("reason")


def rejected(looked_up: DataFrame) -> DataFrame:
    return looked_up.filter(F.col("reason").isNotNull())
