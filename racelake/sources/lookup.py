"""Tables that are asked for a few keys: hash folders of the key, which a join prunes at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from racelake.sources.scratch import stable
from racelake.sources.tables import read_required, replace_partitions

PART = "key_part"
PARTS = 64


def part_of(key: str, parts: int = PARTS) -> Column:
    """The folder of a key; a null key is in the first."""
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(parts)), F.lit(0)).cast("int")


def write_lookup(df: DataFrame, path: str, key: str, fmt: str = "parquet") -> None:
    """Replaces the table at `path`, in folders by the key's hash and sorted by key inside."""

    def write(rows: DataFrame) -> None:
        placed = rows.repartition(PART).sortWithinPartitions(PART, key)
        writer = placed.write.format(fmt).mode("overwrite").partitionBy(PART)
        writer.option("partitionOverwriteMode", "dynamic").save(path)

    replace_partitions(df.withColumn(PART, part_of(key)), path, [PART], fmt, write=write)


def read_lookup(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_required(spark, path, fmt).drop(PART)


def look_up(spark: SparkSession, path: str, key: str, requests: DataFrame, fmt: str = "parquet") -> DataFrame:
    """The rows of the table at `path` whose key is among the requests'.

    Keys are stored first, so that their size is known. If they are small enough to be broadcast, they prune the
    folders: the scan reads those of the keys asked for and no others. With more of them it is a plain join.
    """
    table = read_required(spark, path, fmt)
    keys = stable(requests.select(key).distinct().withColumn(PART, part_of(key)))
    # The comparison holds for every row; a filter is what makes the optimiser take the side for a selective one.
    wanted = keys.filter(F.col(PART) >= 0)
    return table.join(wanted, [PART, key], "left_semi").drop(PART)
