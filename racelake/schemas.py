"""Declared table shapes, and bringing any input to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from racelake.functions import known_text, to_bool, to_date, to_double, to_int, to_time

_CASTS = {
    T.StringType: known_text,
    T.IntegerType: to_int,
    T.DoubleType: to_double,
    T.BooleanType: to_bool,
    T.DateType: to_date,
    T.TimestampNTZType: to_time,
}


TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in columns.items()])


def fitted(value: Column, dtype: T.DataType) -> Column:
    """`value` as `dtype`, null where it does not fit."""
    cast = _CASTS.get(type(dtype))
    return cast(value) if cast else value.try_cast(dtype)


def conform(df: DataFrame, target: T.StructType, keep_others: bool = True) -> DataFrame:
    """`df` with all columns of `target` in their types: cast if present, null if not. Other columns follow."""
    declared = [
        (fitted(F.col(f.name), f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in target
    ]
    others = [c for c in df.columns if c not in target.names] if keep_others else []
    return df.select(*declared, *others)


# Table columns.
METADATA = {
    "season": "int",
    "grand_prix": "string",
    "session_type": "string",
    "source": "string",
    "ingestion_timestamp": "string",
}
RAW_LAPS = schema(
    Driver="string", DriverNumber="string", Team="string", Compound="string", TrackStatus="string",
    LapNumber="double", Stint="double", TyreLife="double", Position="double",
    SpeedI1="double", SpeedI2="double", SpeedFL="double", SpeedST="double",
    LapTime="string", Sector1Time="string", Sector2Time="string", Sector3Time="string",
    PitInTime="string", PitOutTime="string", LapStartTime="string", Time="string",
    LapStartDate="timestamp_ntz",
    FreshTyre="boolean", Deleted="boolean", FastF1Generated="boolean", IsAccurate="boolean",
    **METADATA,
)
RAW_LAP_WEATHER = schema(
    driver="string", lap_number="double",
    AirTemp="double", Humidity="double", Pressure="double", TrackTemp="double",
    WindSpeed="double", WindDirection="double", Rainfall="boolean",
    **METADATA,
)
RAW_RESULTS = schema(
    Abbreviation="string", Status="string", TeamName="string", GridPosition="double", Position="double",
    **METADATA,
)
RESULTS = schema(
    season="int", round="int", race_name="string", date="date", circuit_id="string", circuit_name="string",
    driver_id="string", code="string", given_name="string", family_name="string", nationality="string",
    constructor_id="string", name="string", grid="int", position="int", points="double", laps="int",
    status="string",
)
LAPS = schema(
    season="int", race="string", driver="string", lap_number="int",
    driver_number="string", lapstartdate="timestamp_ntz",
    lap_time_ms="double", sector1_time_ms="double", sector2_time_ms="double", sector3_time_ms="double",
    pit_in_time_ms="double", pit_out_time_ms="double", lap_start_time_ms="double",
    speedi1="double", speedi2="double", speedfl="double", speedst="double",
    position="int", tyre_life="int", stint="int", compound="string", track_status="string",
    fresh_tyre="boolean", deleted="boolean", fastf1generated="boolean", is_accurate="boolean", rainfall="boolean",
    air_temp="double", humidity="double", pressure="double", track_temp="double",
    wind_direction="double", wind_speed="double",
    grid_position="int", finish_position="int", race_status="string", team_name="string",
)
