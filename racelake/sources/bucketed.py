"""Tables whose rows lie in hash buckets of their keys, so that joins and windows on the keys move nothing.

The layout is stored beside the files (`_layout`, which readers of the folder skip), not in a metastore: a session
registers the folder under a name of its own and gets the buckets back. A folder keeps the number of buckets that it
was made with.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from contextlib import nullcontext
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from racelake.session import set_inside
from racelake.sources.scratch import new_path
from racelake.sources.tables import is_absent, replace_partitions

LAYOUT = "_layout"
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"
# Joins by a bucket's keys and others exchange nothing, and buckets are read as such even where no operator asks for it.
_STAY = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


@dataclass(frozen=True)
class Layout:
    """`buckets` by hash of `keys`, each sorted by `order`; folders by `partition_by`."""

    buckets: int
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def layout_of(spark: SparkSession, path: str) -> Layout | None:
    try:
        stored = spark.read.text(f"{path}/{LAYOUT}").first()
    except Exception as problem:
        if is_absent(problem):
            return None
        raise
    fields = json.loads(stored[0])
    return Layout(**{k: v if k == "buckets" else tuple(v) for k, v in fields.items()})


def write_bucketed(
    df: DataFrame, path: str, layout: Layout, within: Sequence | None = None, placed: bool = False
) -> None:
    """Replaces the table at `path`, or those of its partitions whose first column is in `within`.

    Rows are exchanged once, by the keys; a bucket is one file for each partition folder. `placed=True` leaves that
    exchange out for rows that come from as many buckets of the same keys; where they don't, the table is the same in
    more files. Partitions are replaced as `replace_partitions` does it; a table without folders is replaced as a
    whole, and not readable meanwhile.
    """
    spark = df.sparkSession
    kept = layout_of(spark, path)
    if kept is not None and (kept.keys, kept.partition_by) != (layout.keys, layout.partition_by):
        raise ValueError(f"{path} is laid out by {kept}")
    layout = kept or layout

    def write(rows: DataFrame) -> None:
        name = _registered(spark, path, layout, rows.schema, known=kept is not None)
        rows = rows if placed else rows.repartition(layout.buckets, *layout.keys)
        with _dynamic(spark):
            rows.select(spark.table(name).columns).write.mode("overwrite").insertInto(name)

    if layout.partition_by:
        replace_partitions(df, path, layout.partition_by, within=within, write=write)
    else:
        write(df)
    if kept is None or not layout.partition_by:
        text = spark.range(1, numPartitions=1).select(F.lit(json.dumps(asdict(layout))).alias("value"))
        text.write.mode("overwrite").text(f"{path}/{LAYOUT}")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table at `path` with its buckets."""
    layout = layout_of(spark, path)
    if layout is None:
        raise FileNotFoundError(f"no bucketed table at {path}")
    return spark.table(_registered(spark, path, layout))


def stable_bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), placed: bool = False) -> DataFrame:
    """`df` stored like `stable` does, in buckets of `keys`. `placed` rows come from such buckets and stay put, also where
    they are joined by more columns than `keys`."""
    spark = df.sparkSession
    path, layout = new_path(spark, "bucketed"), Layout(default_buckets(spark), tuple(keys), tuple(order))
    with stay(spark) if placed else nullcontext():
        write_bucketed(df, path, layout, placed=placed)
    return spark.table(_registered(spark, path, layout, df.schema))


def stay(spark: SparkSession):
    """Jobs inside leave rows in their buckets, also where they are joined by more columns than the buckets' keys."""
    return set_inside(spark, _STAY)


def _dynamic(spark: SparkSession):
    """Inserts replace the partitions they have rows for; tables of the catalogue take that from the session only."""
    return set_inside(spark, {OVERWRITE_MODE: "dynamic"})


def _registered(
    spark: SparkSession, path: str, layout: Layout, schema: T.StructType | None = None, known: bool = True
) -> str:
    """A name for the folder in the session's catalogue, with its buckets and the partitions that are there now."""
    schema = schema or spark.read.parquet(path).schema
    folders = [f for f in schema if f.name in layout.partition_by]
    columns = [f for f in schema if f.name not in layout.partition_by] + folders
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    name = f"bucketed_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    keys = ", ".join(f"`{c}`" for c in layout.keys)
    order = ", ".join(f"`{c}`" for c in (*layout.keys, *layout.order))
    by = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in layout.partition_by)})" if layout.partition_by else ""
    spark.sql(
        f"CREATE TABLE {name} ({ddl}) USING parquet {by} "
        f"CLUSTERED BY ({keys}) SORTED BY ({order}) INTO {layout.buckets} BUCKETS LOCATION '{path}'"
    )
    if layout.partition_by and known:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return name
