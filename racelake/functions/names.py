from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that become an underscore in names and slugs.
BREAKS = " -/"
FILLERS = "_" * len(BREAKS)


def tidy(name: str) -> str:
    """Column-name form of a header: trimmed, lower case, breaks as underscores."""
    return name.strip().lower().translate(str.maketrans(BREAKS, FILLERS))


def slug(value: Column) -> Column:
    """The same rule on values."""
    return F.translate(F.lower(F.trim(value)), BREAKS, FILLERS)
