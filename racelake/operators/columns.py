"""Renaming, stamping, filling: one projection for each step."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racelake.functions import as_flag, tidy


def normalize_names(df: DataFrame) -> DataFrame:
    names = [tidy(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns with the same normalised name: {clashes}")
    return df.toDF(*names)


def rename_present(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renames the columns that exist; a new name that is already taken stays with its owner."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if new not in df.columns})


def prefix_except(df: DataFrame, prefix: str, keys: Iterable[str]) -> DataFrame:
    kept = set(keys)
    return df.toDF(*[c if c in kept else f"{prefix}{c}" for c in df.columns])


def prefix_only(df: DataFrame, prefix: str, names: Iterable[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in names})


def stamp(df: DataFrame, **literals: Any) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in literals.items()})


def fill(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Replaces nulls by defaults that take the column's own type; absent columns are left out."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: F.coalesce(c, F.lit(value).cast(types[c])) for c, value in defaults.items() if c in types}
    )


def flags_to_int(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in names})


def presence_flags(df: DataFrame, sources: Mapping[str, str]) -> DataFrame:
    """New name -> column: 1 where that column has a value. To be taken before any fill."""
    return df.withColumns({name: as_flag(F.col(c).isNotNull()) for name, c in sources.items()})


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of `names` that the table has."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"none of {list(names)} among {df.columns}")
