"""Column expressions. Nothing here touches a session or a DataFrame."""

from racelake.functions.casts import MISSING_TEXT, known_text, null_when, to_bool, to_date, to_double, to_int, to_time
from racelake.functions.durations import duration_ms
from racelake.functions.flags import as_flag, at_most, differs, gain, has_token, is_known
from racelake.functions.names import slug, tidy

__all__ = [
    "MISSING_TEXT",
    "as_flag",
    "at_most",
    "differs",
    "duration_ms",
    "gain",
    "has_token",
    "is_known",
    "known_text",
    "null_when",
    "slug",
    "tidy",
    "to_bool",
    "to_date",
    "to_double",
    "to_int",
    "to_time",
]
