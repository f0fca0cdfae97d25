"""The driver's tables seen as race tables (the definitions of FIXTURES.md, in DataFrame form).

lineitem: supplier = driver, nation = team, month = race. orders: customer = driver, nation = constructor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racelake.operators.ordered import add_row_number
from racelake.sources.scratch import stable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def race_laps(
    spark: SparkSession, sf_dir: str, buckets: int | None = None, keys: Sequence[str] = ("season", "race", "driver")
) -> DataFrame:
    """With `buckets`, rows are dealt by `keys` (of season, race and driver) to so many partitions before they are numbered:
    their only exchange, as the drivers' teams (two numbers for each) are broadcast."""
    items = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("month"),
        "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    known = items.join(F.broadcast(suppliers) if buckets else suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    race, driver = F.concat(F.lit("race_"), F.col("month")), F.concat(F.lit("S"), F.col("l_suppkey"))
    by = ["season", "month", "l_suppkey"]
    if buckets:
        by = ["season", "race", "driver"]
        known = known.withColumns({"race": race, "driver": driver}).drop("month").repartition(buckets, *keys)
        race, driver = F.col("race"), F.col("driver")
    laps = add_row_number(known, by, order, "lap")
    n, line = F.col("lap").cast("int"), F.col("l_linenumber")
    return laps.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "season",
        race.alias("race"),
        driver.alias("driver"),
        F.col("l_suppkey").cast("string").alias("driver_number"),
        F.col("n_name").alias("team_name"),
        n.alias("lap_number"),
        F.col("l_shipdate").alias("lapstartdate"),
        F.when(n % 11 != 0, F.col("l_quantity").cast("int")).alias("position"),
        F.when(n != 1, 1 + F.floor(n / 4).cast("int")).alias("stint"),
        F.when(n == 1, "nan")
        .when(F.col("l_returnflag") == "R", "SOFT")
        .when(F.col("l_returnflag") == "A", "HARD")
        .otherwise("MEDIUM")
        .alias("compound"),
        F.when(n != 1, n % 4).alias("tyre_life"),
        (F.col("l_returnflag") == "N").alias("fresh_tyre"),
        (line == 6).alias("is_pit_in_lap"),
        (line == 7).alias("is_pit_out_lap"),
        line.isin(6, 7).alias("is_pit_lap"),
        (F.col("l_linestatus") == "F").alias("is_green"),
        (line % 3 == 0).alias("is_yellow"),
        (line == 5).alias("is_safety_car"),
        (F.col("l_discount") > 0.095).alias("is_red_flag"),
        (line == 4).alias("is_vsc"),
        (F.col("l_tax") > 0.065).alias("is_raining"),
        F.floor("l_extendedprice").cast("double").alias("lap_time_ms"),
    )


def race_weather(laps: DataFrame) -> DataFrame:
    """Every fifth lap has no weather."""
    ms = F.col("lap_time_ms")
    return laps.filter(F.col("lap_number") % 5 != 0).select(
        "season", "race", "driver", "lap_number",
        (ms % 17 + 15).alias("airtemp"),
        (ms % 61 + 30).alias("humidity"),
        (ms % 31 + 990).alias("pressure"),
        F.col("is_raining").alias("rainfall"),
        (ms % 23 + 25).alias("tracktemp"),
        (ms % 360).alias("winddirection"),
        (ms % 9).alias("windspeed"),
    )


def race_results(laps: DataFrame) -> DataFrame:
    """One row for each driver and race; every 13th driver has no grid slot."""
    entries = laps.groupBy("season", "race", "driver", "driver_number", "team_name").agg(
        F.count("*").alias("laps"), F.min("lap_time_ms").alias("best")
    )
    race = ["season", "race"]
    entries = stable(entries.withColumn("fewer", -F.col("laps")))
    started = add_row_number(entries, race, ["best", "driver"], "grid")
    placed = add_row_number(started, race, ["fewer", "best", "driver"], "place")
    return placed.select(
        *race,
        F.col("driver").alias("abbreviation"),
        F.col("team_name").alias("teamname"),
        F.when(F.col("driver_number").cast("int") % 13 != 0, F.col("grid").cast("int")).alias("gridposition"),
        F.col("place").cast("int").alias("position"),
        F.when(F.col("laps") < 3, "Retired")
        .when(F.col("laps") % 5 == 0, "+1 Lap")
        .when(F.col("laps") != 7, "Finished")
        .alias("status"),
    )


def raw_laps(laps: DataFrame) -> DataFrame:
    """Text durations, token lists, blanks."""
    n, ms = F.col("lap_number"), F.col("lap_time_ms").cast("int")

    def two(number):
        return F.lpad(number.cast("int").cast("string"), 2, "0")

    text = F.concat(
        F.lit("0 days "), two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"),
        two(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("000"),
    )
    return laps.withColumns({"txt": text, "ms": ms}).select(
        "season", "race", "driver", "lap_number",
        F.when(n % 9 == 0, "NaT")
        .when(n % 7 == 0, F.concat(F.col("ms").cast("string"), F.lit(".5")))
        .when(n % 4 == 0, F.substring("txt", 8, 100))
        .when(n % 10 != 0, F.col("txt"))
        .alias("laptime"),
        F.when(F.col("is_pit_in_lap"), F.col("txt")).otherwise("NaT").alias("pitintime"),
        F.when(F.col("is_pit_out_lap"), F.col("txt")).otherwise("").alias("pitouttime"),
        F.when(F.col("is_green") & F.col("is_yellow"), "1;2")
        .when(F.col("is_green"), "1")
        .when(F.col("is_yellow"), "2")
        .when(F.col("is_safety_car"), "4;6")
        .when(F.col("is_vsc"), "12")
        .alias("trackstatus"),
        F.when(F.col("fresh_tyre"), "True").when(F.col("is_raining"), "None").otherwise("False").alias("freshtyre"),
        F.when(F.col("compound") != "nan", F.col("compound")).alias("compound"),
        F.col("tyre_life").cast("double").alias("tyrelife"),
    )


def season_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, month = F.col("o_orderkey"), F.month("o_orderdate")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.year("o_orderdate").alias("season"),
        month.alias("round"),
        F.to_date("o_orderdate").alias("date"),
        key.alias("result_id"),
        F.concat(F.lit("race_"), month).alias("race_name"),
        F.concat(F.lit("circuit_"), month).alias("circuit_id"),
        F.col("c_name").alias("driver_id"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("code"),
        F.concat(F.lit("team_"), F.col("c_nationkey")).alias("constructor_id"),
        (key * 7 % 20 + 1).cast("int").alias("grid"),
        F.when(key % 17 != 0, (key % 20 + 1).cast("int")).alias("position"),
        F.floor(F.col("o_totalprice") / 10000).cast("double").alias("points"),
        F.when(F.col("o_orderstatus") == "F", "Finished")
        .when(F.col("o_orderstatus") == "O", "+1 Lap")
        .otherwise("Retired")
        .alias("status"),
    )


def flat_results(results: DataFrame) -> DataFrame:
    """`season_results` as texts under the names of the documents, with `result_id` for order."""
    key = F.col("result_id")
    return results.select(
        "result_id",
        F.col("season").cast("string").alias("season"),
        F.col("round").cast("string").alias("round"),
        F.col("race_name").alias("raceName"),
        F.when(key % 97 == 0, "unknown").otherwise(F.col("date").cast("string")).alias("date"),
        F.col("circuit_id").alias("circuitId"),
        F.concat(F.lit("Circuit "), F.col("round")).alias("circuitName"),
        F.col("driver_id").alias("driverId"),
        "code",
        F.concat(F.lit("Given "), key % 31).alias("givenName"),
        F.concat(F.lit("Family "), F.col("code")).alias("familyName"),
        F.when(key % 11 != 0, F.concat(F.lit("N"), key % 7)).alias("nationality"),
        F.col("constructor_id").alias("constructorId"),
        F.concat(F.lit("Team "), F.col("constructor_id")).alias("name"),
        F.col("grid").cast("string").alias("grid"),
        F.coalesce(F.col("position").cast("string"), F.lit("R")).alias("position"),
        F.col("points").cast("string").alias("points"),
        (key % 70).cast("string").alias("laps"),
        "status",
    )
