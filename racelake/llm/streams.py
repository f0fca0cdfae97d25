"""Rows of a key in order, streamed through one task without being held.

What one row of output has to sum up in order (a digest, a text that goes on) is read row by row, so that a key of any
length needs no more memory than its longest row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROWS, _BYTES = 1024, 4 << 20

Rows = Iterator[tuple]


def in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of equal keys in one partition and adjacent, in `order`, nulls first."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def stream(rows: DataFrame, work: Callable[[Rows], Iterable[tuple]], schema: pa.Schema, spark_schema: str) -> DataFrame:
    """`work` on each partition's rows, which it gets one by one as tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in work(tuples(batches)):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, str))
            if len(held) >= _ROWS or size >= _BYTES:
                yield as_batch(held, schema)
                held, size = [], 0
        if held:
            yield as_batch(held, schema)

    return rows.mapInArrow(run, spark_schema)


def tuples(batches: Iterable[pa.RecordBatch]) -> Rows:
    for batch in batches:
        for first in range(0, batch.num_rows, _ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(first, _ROWS).columns), strict=True)


def as_batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema)


def digests(rows: DataFrame, key: str, part: Column, separator: str = "\n") -> DataFrame:
    """SHA-256 (lowercase hex) of each key's `part`s in UTF-8 with `separator` in between, as `digest`.

    `rows` must hold each key's rows adjacent and in their order, as `in_order` and functions on its partitions do.
    """
    between = separator.encode()

    def hashed(found: Rows) -> Iterator[tuple]:
        now, running = None, None
        for name, text in found:
            if running is None or name != now:
                if running is not None:
                    yield now, running.hexdigest()
                now, running = name, hashlib.sha256()
            else:
                running.update(between)
            running.update(text.encode())
        if running is not None:
            yield now, running.hexdigest()

    kind = dict(rows.dtypes)[key]
    arrow = pa.schema([(key, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("digest", pa.string())])
    return stream(rows.select(key, part.alias("part")), hashed, arrow, f"{key} {kind}, digest string")


def same(left: str, right: str) -> Column:
    """Equality for joins where null is a key like any other."""
    return F.col(left).eqNullSafe(F.col(right))
