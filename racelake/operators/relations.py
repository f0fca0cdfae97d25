"""Joins, de-duplication, unions and whole-table summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def left_enrich(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, unique: bool = False
) -> DataFrame:
    """Every left row with the matching right rows' `columns`.

    Repeated right keys repeat the left row, unless `unique` asks for one right row for each key. No strategy
    is forced: a small right side is broadcast by its measured size, a hot left key is split at run time.
    """
    right = right if columns is None else right.select(*keys, *columns)
    if unique:
        right = one_per_key(right, keys, [c for c in right.columns if c not in keys])
    return left.join(right, list(keys), "left")


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the first in `order`, a null after every value. Copies are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order]]
    places = [part for i, c in enumerate(ranked) for part in (F.col(c).isNull().alias(f"__{i}"), F.col(c))]
    first = df.groupBy(*keys).agg(F.min(F.struct(*places)).alias("first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"first.`{c}`") for c in df.columns])


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def union_by_position(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def union_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    """A column that one part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def null_counts(df: DataFrame) -> DataFrame:
    """One row: nulls of each column; null when there are no rows."""
    return df.agg(*[F.sum(F.col(_quoted(c)).isNull().cast("int")).alias(c) for c in df.columns])


def quick_stats(df: DataFrame, column: str) -> DataFrame:
    value = F.col(column)
    return df.agg(F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def preview(df: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def global_sort(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order)


def describe(df: DataFrame) -> DataFrame:
    """One row for each number or text column: count, mean, deviation, least and greatest value (as text),
    in a single pass."""
    fields = [f for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType))]

    def measures(field: T.StructField) -> Column:
        c = F.col(_quoted(field.name))
        number = c.cast("double") if isinstance(field.dataType, T.NumericType) else c.try_cast("double")
        return F.struct(
            F.lit(field.name).alias("column"),
            F.count(c).alias("count"),
            F.avg(number).alias("mean"),
            F.stddev(number).alias("stddev"),
            F.min(c).cast("string").alias("min"),
            F.max(c).cast("string").alias("max"),
        )

    return df.agg(F.array(*[measures(f) for f in fields]).alias("all")).select(F.inline("all"))


def profile(df: DataFrame) -> DataFrame:
    """One row for each column and nested field: type, rows, nulls, array sizes, a sample value.

    Fields inside arrays are listed with their type; their values are counted by the array's own size.
    """
    leaves = list(_paths(df.schema))

    def facts(path: str, dtype: T.DataType, inside_array: bool) -> Column:
        c = F.lit(None) if inside_array else F.col(path)
        size = F.size(c) if isinstance(dtype, T.ArrayType) and not inside_array else F.lit(None).cast("int")
        size = F.when(size >= 0, size)
        return F.struct(
            F.lit(path.replace("`", "")).alias("path"),
            F.lit(dtype.simpleString()).alias("type"),
            F.count(F.lit(1)).alias("rows"),
            (F.lit(None).cast("long") if inside_array else F.count(F.lit(1)) - F.count(c)).alias("nulls"),
            F.min(size).alias("min_size"),
            F.max(size).alias("max_size"),
            F.sum(size).alias("sum_size"),
            (F.min(c.cast("string")) if isinstance(dtype, T.AtomicType) and not inside_array
             else F.lit(None).cast("string")).alias("sample"),
        )

    return df.agg(F.array(*[facts(*leaf) for leaf in leaves]).alias("all")).select(F.inline("all"))


def _quoted(name: str) -> str:
    return f"`{name}`"


def _paths(schema: T.StructType, prefix: str = "", inside_array: bool = False):
    for field in schema:
        path, dtype = f"{prefix}`{field.name}`", field.dataType
        yield path, dtype, inside_array
        if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
            yield from _paths(dtype.elementType, f"{path}.", True)
        elif isinstance(dtype, T.StructType):
            yield from _paths(dtype, f"{path}.", inside_array)
