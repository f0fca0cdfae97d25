from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted texts and the milliseconds in each unit.
PLAIN_NUMBER = r"^\d+(\.\d+)?$"
DURATION = r"^(\d+\s+days?\s+)?\d{2}:\d{2}:\d{2}(\.\d+)?$"
DAY_MS, HOUR_MS, MINUTE_MS, SECOND_MS = 86_400_000.0, 3_600_000.0, 60_000.0, 1_000.0


def duration_ms(value: Column) -> Column:
    """Milliseconds of a duration text.

    `1 day 00:00:01`, `0 days 00:01:27.512` and `00:01:30` are read as durations, a plain number is taken as
    milliseconds already, and everything else (blank, `NaT`, negative, one-digit hours) is null.

    A text with a colon can only be a duration, one without only a number, so each value meets one pattern.
    The fields of a valid duration sit at fixed places around its first colon.
    """
    text = F.trim(value.cast("string"))
    colon = F.instr(text, ":")

    def field(start: int, length: int) -> Column:
        return text.substr(colon + start, F.lit(length)).try_cast("double")

    days = F.when(text.contains("d"), F.substring_index(text, "d", 1).try_cast("double")).otherwise(0.0)
    total = days * DAY_MS + field(-2, 2) * HOUR_MS + field(1, 2) * MINUTE_MS + field(4, 32) * SECOND_MS
    return F.when(colon > 0, F.when(text.rlike(DURATION), total)).otherwise(
        F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))
    )
