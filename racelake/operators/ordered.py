"""Operators on ordered groups: trailing values, row numbers, next known value.

Each has two exact forms, and the caller says which one to use; nothing is measured. By default it is a plain
window: one exchange on the group keys, and a group is sorted in one task. With `split=True` the rows are
range-partitioned on (group keys, order), so that a group of any size is spread over many tasks, and the little
that a block needs from its neighbours is carried over:

* trailing values need the last few rows before the block (`n` rows for each block),
* row numbers need the count of the group's earlier rows (one number for each block),
* the next known value needs one value for each block.

What is carried grows with the number of blocks, not with the rows of a block, so broadcasting it is bounded. The
number of blocks follows the stored size of the rows. Group keys may be null; null is a group like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from racelake.sources.scratch import stable

# Stored bytes that make one block.
BLOCK_BYTES = 64 << 20

BLOCK, POS, HALO = "__block", "__pos", "__halo"
_POS_BITS = 33


@dataclass(frozen=True)
class Past:
    """A column taken from the `rows` rows before the current one: their `mean` or `sum`, or the `value`
    exactly `rows` rows back."""

    name: str
    source: str
    rows: int
    how: str = "mean"

    def over(self, window: WindowSpec) -> Column:
        if self.how == "value":
            return F.lag(self.source, self.rows).over(window).alias(self.name)
        if self.how not in ("mean", "sum"):
            raise ValueError(f"unknown kind of trailing value: {self.how}")
        reduced = F.avg(self.source) if self.how == "mean" else F.sum(self.source)
        return reduced.over(window.rowsBetween(-self.rows, -1)).alias(self.name)


def add_past(
    df: DataFrame, by: Sequence[str], order: Sequence[str], past: Sequence[Past], split: bool = False
) -> DataFrame:
    """`df` with the trailing columns `past`, never looking at the current row."""
    if not split:
        window = Window.partitionBy(*by).orderBy(*order)
        return df.select("*", *[p.over(window) for p in past])

    blocks = cut(df, by, order)
    depth = max(p.rows for p in past)
    rows = blocks.withColumn(HALO, F.lit(False)).unionByName(_rows_before(blocks, by, depth, df.columns))
    window = Window.partitionBy(*by, BLOCK).orderBy(POS)
    return (
        rows.select("*", *[p.over(window) for p in past])
        .filter(~F.col(HALO))
        .select(*df.columns, *[p.name for p in past])
    )


def add_row_number(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, split: bool = False
) -> DataFrame:
    """`df` with the 1-based position of each row in its group, as a bigint.

    With `by` empty this is the position in the whole table, always computed in blocks.
    """
    if not by:
        blocks = cut(df, by, order)
        return _with_table_position(blocks).select(*df.columns, (F.col("__at") + 1).alias(name))
    if not split:
        number = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
        return df.select("*", number.alias(name))

    blocks = cut(df, by, order)
    inside = F.row_number().over(Window.partitionBy(*by, BLOCK).orderBy(POS))
    numbered = blocks.select("*", inside.alias("__inside"))
    return _join_block(numbered, _rows_in_earlier_blocks(blocks, by), by).select(
        *df.columns, (F.col("__inside") + F.coalesce("__before", F.lit(0))).alias(name)
    )


def add_running_sum(
    df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, str], split: bool = False
) -> DataFrame:
    """`df` with the sum of each key of `sums` from the group's first row to this one, as the value names it.

    Rows that tie in `order` are added one by one. A sum of nothing but nulls is null.
    """
    if not split:
        so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(so_far).alias(n) for c, n in sums.items()])

    blocks = cut(df, by, order)
    inside = Window.partitionBy(*by, BLOCK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.select("*", *[F.sum(c).over(inside).alias(f"__in_{n}") for c, n in sums.items()])
    earlier = _sums_in_earlier_blocks(blocks, by, sums)
    total = {
        n: F.when(
            F.coalesce(f"__in_{n}", f"__before_{n}").isNotNull(),
            F.coalesce(f"__in_{n}", F.lit(0)) + F.coalesce(f"__before_{n}", F.lit(0)),
        )
        for n in sums.values()
    }
    return _join_block(summed, earlier, by).select(*df.columns, *[c.alias(n) for n, c in total.items()])


def add_next_known(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    source: str,
    name: str | None = None,
    split: bool = False,
) -> DataFrame:
    """`df` with `source` replaced (or copied to `name`) by its first non-null value from this row on.

    The window runs backwards, which needs one pass; a frame that is open at the far end would be evaluated
    anew for each row.
    """
    name = name or source
    if not split:
        backwards = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
        return df.withColumn(name, _latest(source, backwards))

    blocks = cut(df, by, order)
    backwards = Window.partitionBy(*by, BLOCK).orderBy(F.desc(POS))
    filled = blocks.withColumn("__filled", _latest(source, backwards))
    joined = _join_block(filled, _known_in_later_blocks(blocks, by, source), by)
    return joined.select(*df.columns, "__filled", "__later").withColumn(
        name, F.coalesce("__filled", "__later")
    ).drop("__filled", "__later")


def add_table_position(df: DataFrame, order: Sequence[str], name: str, total: str) -> DataFrame:
    """`df` with the 0-based position of each row in the whole ordered table and the number of rows."""
    placed = _with_table_position(cut(df, (), order))
    return placed.select(*df.columns, F.col("__at").alias(name), F.col("__total").alias(total))


def cut(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partitioned rows with their block number and position in it.

    Range bounds come from a sample and would differ if the plan ran twice, so the result is made stable. The rows
    are stored before that too: sampling reads them once more, and their size says how many blocks there are.
    """
    keys = [*by, *order]
    rows = stable(df)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranged = rows.repartitionByRange(max(parts, -(-stored // BLOCK_BYTES)), *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    return stable(ranged.withColumn("__place", place)).select(
        *df.columns,
        F.shiftright("__place", _POS_BITS).cast("int").alias(BLOCK),
        F.col("__place").bitwiseAND((1 << _POS_BITS) - 1).alias(POS),
    )


def _latest(source: str, window: WindowSpec) -> Column:
    return F.last(source, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def _sizes(blocks: DataFrame) -> DataFrame:
    """One row for each block."""
    return blocks.groupBy(BLOCK).agg(F.count("*").alias("__size"))


def _heads(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first row's group of each block: the only group that can go on from an earlier block."""
    return blocks.filter(F.col(POS) == 0).select(*by, BLOCK)


def _tails(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """The last row's group of each block: the only group that can go on into a later block."""
    last = blocks.join(F.broadcast(_sizes(blocks)), BLOCK).filter(F.col(POS) == F.col("__size") - 1)
    return last.select(*by, BLOCK)


def _join_block(rows: DataFrame, per_block: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """`rows` with the one row that its block and group has in `per_block`; a null key equals a null key."""
    right = per_block.withColumnsRenamed({c: f"__of_{c}" for c in (*by, BLOCK)})
    same = [F.col(BLOCK) == F.col(f"__of_{BLOCK}"), *[F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by]]
    return rows.join(F.broadcast(right), reduce(lambda a, b: a & b, same), how)


def _rows_of(blocks: DataFrame, ends: DataFrame, by: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """The rows of each block's head or tail group."""
    return _join_block(blocks, ends, by, "inner").select(*by, BLOCK, POS, *extra)


def _rows_before(blocks: DataFrame, by: Sequence[str], depth: int, columns: Sequence[str]) -> DataFrame:
    """For each block, the last `depth` rows of its first group that lie in earlier blocks."""
    placed = blocks.join(F.broadcast(_sizes(blocks)), BLOCK)
    near_end = F.col(POS) >= F.col("__size") - depth
    # First row and last `depth` rows of each block. Walking back from a block's first row, `depth` rows from
    # the end of the previous block always come before that block's own first row.
    edges = placed.filter(near_end | (F.col(POS) == 0)).withColumn("__near_end", near_end)
    row = F.when(F.col("__near_end"), F.struct(*columns))
    walk = Window.partitionBy(*by).orderBy(BLOCK, POS).rowsBetween(-depth, -1)
    found = edges.select("*", F.collect_list(row).over(walk).alias("__rows")).filter(F.col(POS) == 0)
    return found.select(BLOCK, F.posexplode("__rows").alias("__n", "__row")).select(
        "__row.*",
        BLOCK,
        (F.col("__n").cast("long") - depth).alias(POS),
        F.lit(True).alias(HALO),
    )


def _rows_in_earlier_blocks(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    counted = _sums_in_earlier_blocks(blocks.withColumn("__one", F.lit(1)), by, {"__one": "rows"})
    return counted.withColumnRenamed("__before_rows", "__before")


def _sums_in_earlier_blocks(blocks: DataFrame, by: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """For each block, the sums over its first group's rows in earlier blocks, as `__before_…`."""
    rows = _rows_of(blocks, _tails(blocks, by), by, list(sums))
    runs = rows.groupBy(*by, BLOCK).agg(*[F.sum(c).alias(f"__run_{n}") for c, n in sums.items()])
    # At one block the head sorts first, so that the block's own run is not counted.
    ends = runs.withColumn("__head", F.lit(False)).unionByName(
        _heads(blocks, by).withColumn("__head", F.lit(True)), allowMissingColumns=True
    )
    earlier = Window.partitionBy(*by).orderBy(BLOCK, F.desc("__head")).rowsBetween(Window.unboundedPreceding, -1)
    before = {n: F.sum(f"__run_{n}").over(earlier).alias(f"__before_{n}") for n in sums.values()}
    known = F.coalesce(*[F.col(f"__before_{n}") for n in before]).isNotNull()
    return (
        ends.select("*", *before.values())
        .filter(F.col("__head") & known)
        .select(*by, BLOCK, *[f"__before_{n}" for n in before])
    )


def _known_in_later_blocks(blocks: DataFrame, by: Sequence[str], source: str) -> DataFrame:
    heads = _rows_of(blocks, _heads(blocks, by), by, [source]).filter(F.col(source).isNotNull())
    known = heads.groupBy(*by, BLOCK).agg(F.min_by(source, POS).alias("__known"))
    tails = _tails(blocks, by).withColumn("__tail", F.lit(True))
    ends = known.withColumn("__tail", F.lit(False)).unionByName(tails, allowMissingColumns=True)
    later = (
        Window.partitionBy(*by)
        .orderBy(F.desc(BLOCK), F.desc("__tail"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ends.select("*", F.last("__known", ignorenulls=True).over(later).alias("__later"))
        .filter("__tail and __later is not null")
        .select(*by, BLOCK, "__later")
    )


def _with_table_position(blocks: DataFrame) -> DataFrame:
    sizes = _sizes(blocks)
    # One row for each block, so these windows over the whole of `sizes` are small at any data size.
    everything = Window.partitionBy(F.lit(0))
    starts = sizes.select(
        BLOCK,
        (F.sum("__size").over(everything.orderBy(BLOCK)) - F.col("__size")).alias("__start"),
        F.sum("__size").over(everything).alias("__total"),
    )
    return blocks.join(F.broadcast(starts), BLOCK).withColumn("__at", F.col("__start") + F.col(POS))
