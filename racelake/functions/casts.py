"""Casts that give null, never an error, on a value that does not fit.

They behave alike with ANSI mode on and off, and NaN counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that a pandas object column leaves for "no value".
MISSING_TEXT = ("None", "nan", "NaT", "<NA>")


def null_when(value: Column, *sentinels: str) -> Column:
    """`value`, or null where it equals one of `sentinels`."""
    return F.when(~value.isin(*sentinels), value)


def known_text(value: Column) -> Column:
    return null_when(value.cast("string"), *MISSING_TEXT)


def to_double(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def to_int(value: Column) -> Column:
    # By way of double, so that the text '5.0' is 5 and NaN is null, not 0.
    return to_double(value).try_cast("int")


def to_bool(value: Column) -> Column:
    return value.try_cast("boolean")


def to_date(value: Column) -> Column:
    return value.try_cast("date")


def to_time(value: Column) -> Column:
    return value.try_cast("timestamp_ntz")
