"""Comparing the members of groups of any size in tasks of bounded size.

A large group is cut into blocks; every pair of blocks is a unit of work, and a member travels to each unit of its
block. Units arrive sorted, so a task holds one unit at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = ["group", "i", "j"]


def block_pairs(members: DataFrame, size: str, block: int, member: str) -> DataFrame:
    """`members` (with `group` and the group's `size`) once for each unit: `i` <= `j` are its blocks, `own` says
    which of the two the row is from. A group of up to `block` members is one unit."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    every = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return every.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", size)


def by_unit(
    rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str, keys: Sequence[str] = UNIT
) -> DataFrame:
    """`work` on the rows of every unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            codes = np.stack([held.column(k).to_numpy() for k in keys])
            edges = np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1
            begun = 0
            for end in edges:
                if (made := work(held.slice(begun, end - begun).combine_chunks())) is not None:
                    yield made
                begun = end
            held = held.slice(begun)
        if held is not None and (made := work(held.combine_chunks())) is not None:
            yield made

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def roots(n: int, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each of `n` places the smallest one that `pairs` connect it with."""
    root = np.arange(n)
    while True:
        a, b = root[pairs[0]], root[pairs[1]]
        low = np.minimum(a, b)
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after
