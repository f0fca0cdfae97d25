from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; unknown counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def at_most(value: Column, limit: int) -> Column:
    return as_flag(value <= limit)


def differs(value: Column, *expected: str) -> Column:
    return as_flag(~value.isin(*expected))


def gain(start: Column, end: Column) -> Column:
    """Places gained between `start` and `end`; null if either is unknown."""
    return start - end


def is_known(value: Column) -> Column:
    return value.isNotNull()


def has_token(value: Column, token: str, separator: str | None = ";") -> Column:
    """Whether `token` is an element of a delimited text; null and blank text hold no token.

    `separator=None` reads the text as a run of one-character tokens.
    """
    text = F.coalesce(value.cast("string"), F.lit(""))
    if separator is None:
        return text.contains(token)
    edge = F.lit(separator)
    return F.concat(edge, text, edge).contains(f"{separator}{token}{separator}")
