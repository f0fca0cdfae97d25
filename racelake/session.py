"""Session settings that the stages are tuned for. They are advice: every stage works with Spark's defaults."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Java's compiler leaves methods of more than 8,000 bytes to the interpreter. Wide projections in one generated method
# are longer, and several times faster where Spark evaluates them without generating one.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Plans are adapted to measured sizes: small sides are broadcast, small partitions joined, and a hot key's
    # partition is split, even at the price of one more exchange.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Tables in buckets of (race, driver) are joined on (season, race, driver) as they are.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Recording the call site of each column expression takes longer than planning it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    **COMPILED,
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


@contextmanager
def set_inside(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """For the jobs inside alone."""
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
