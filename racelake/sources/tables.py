"""Columnar tables: optional and required reads, whole and per-session replacement."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from racelake.operators.relations import union_by_name

log = logging.getLogger(__name__)

# What Spark reports for a path that is absent or holds no data file.
ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "DELTA_TABLE_NOT_FOUND")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """A table of any installed format. Partition folders become columns, and filters on them prune folders."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def read_optional(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", skip_unreadable: bool = False
) -> DataFrame:
    """The table, or a typed table without rows when there is none at `path`.

    A table that is there but cannot be opened is an error, unless `skip_unreadable` treats it as absent. The
    stored schema is kept, as columns beyond `schema` may exist.
    """
    try:
        return read_table(spark, path, fmt=fmt)
    except Exception as problem:
        if not (skip_unreadable or is_absent(problem)):
            raise
        log.warning("going on without the table at %s: %s", path, str(problem).splitlines()[0])
        return spark.createDataFrame([], schema)


def is_absent(problem: Exception) -> bool:
    return isinstance(problem, AnalysisException) and problem.getCondition() in ABSENT


def read_required(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    try:
        return read_table(spark, path, fmt=fmt)
    except AnalysisException as problem:
        if not is_absent(problem):
            raise
        raise FileNotFoundError(f"no table at {path}") from problem


def read_all(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Several stored parts with unlike schemas as one table, absent parts left out."""
    parts = []
    for path in paths:
        try:
            parts.append(read_required(spark, path, fmt))
        except FileNotFoundError:
            log.warning("no part at %s", path)
    if not parts:
        raise ValueError(f"no data in any of {list(paths)}")
    return union_by_name(parts)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
    touched_only: bool = False,
    placed: bool = False,
) -> None:
    """Replaces the table at `path`, or with `touched_only` just the partitions that `df` has rows for.

    Partitioned rows are brought together first, so that a partition becomes few files; a partition too large
    for one task is split by its size. `placed` rows are written from where they are.
    """
    if partition_by and not placed:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(fmt).mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if touched_only:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def replace_partitions(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    fmt: str = "parquet",
    within: Sequence | None = None,
    write: Callable[[DataFrame], None] | None = None,
    placed: bool = False,
) -> None:
    """Replaces the partitions of the table at `path` whose first column is in `within`, or all of them, also those
    that `df` has no rows for.

    One job computes and writes all rows. They stay aside until it has succeeded and are then put in place of the old
    partitions, so a run that fails or is killed before leaves the old table as it was. Partitions that got no file are
    emptied after that. `write` may do the writing, replacing the partitions it has rows for; `placed` as in `write_table`.
    """
    spark = df.sparkSession
    column = partition_by[0]
    if fmt == "delta":
        writer = df.write.format(fmt).mode("overwrite").partitionBy(*partition_by)
        if within is not None:
            values = ", ".join(repr(v) for v in within) or "null"
            writer = writer.option("replaceWhere", f"{column} IN ({values})")
        writer.save(path)
        return
    if within is not None:
        df = df.filter(F.col(column).isin(list(within)))
    before = stored_files(spark, path, fmt)
    (write or (lambda rows: write_table(rows, path, partition_by, fmt, touched_only=True, placed=placed)))(df)
    untouched = before & stored_files(spark, path, fmt)
    folders = {file.rsplit("/", 1)[0] for file in untouched}
    wanted = None if within is None else {f"{column}={v}" for v in within}
    rest = df.drop(*partition_by).limit(0)
    root = path.rstrip("/").split("/")[-1]
    for folder in sorted(folders):
        first = folder.rpartition(f"/{root}/")[2].split("/")[0]
        if wanted is None or first in wanted:
            spark.createDataFrame([], rest.schema).write.format(fmt).mode("overwrite").save(folder)


def stored_files(spark: SparkSession, path: str, fmt: str = "parquet") -> set[str]:
    """Paths of a table's files; none where there is no table."""
    try:
        return {unquote(file) for file in read_required(spark, path, fmt).inputFiles()}
    except FileNotFoundError:
        return set()


def stored_values(spark: SparkSession, path: str, column: str, fmt: str = "parquet") -> list[str]:
    """Values of a partition column, as the folders have them; none where there is no table. No file is opened."""
    inside = f"/{column}="
    return sorted({file.split(inside)[1].split("/")[0] for file in stored_files(spark, path, fmt) if inside in file})
