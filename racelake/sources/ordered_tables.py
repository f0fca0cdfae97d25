"""Tables that keep their order when they are stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from racelake.operators.ordered import add_row_number
from racelake.sources.tables import replace_partitions


def write_in_order(
    df: DataFrame,
    path: str,
    order: Sequence[str],
    name: str,
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
    within: Sequence | None = None,
    row_group_bytes: int | None = None,
) -> None:
    """Stores rows in `order` with their place (`name`, from 1), counted in each partition folder.

    Files hold ranges of places, one after the other, and rows are sorted inside: a filter on the leading column of
    `order` or on the place skips files and row groups by their statistics, and sorting by the place brings the order
    back. Places come from a range sort in blocks, so neither a large folder nor the whole table meets in one task.
    Name enough columns in `order` to leave no ties.
    """
    numbered = add_row_number(df, list(partition_by), order, name, split=True)

    def write(rows: DataFrame) -> None:
        keys = [*partition_by, name]
        writer = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.format(fmt).mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
        if row_group_bytes:
            writer = writer.option("parquet.block.size", row_group_bytes)
        writer.save(path)

    if partition_by:
        replace_partitions(numbered, path, partition_by, fmt, within, write)
    else:
        write(numbered)
