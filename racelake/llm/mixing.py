"""Mixing sources to target weights as a time-varying curriculum.

Each source has a token target and a weight schedule over training time. The integral of the schedule is the
source's cumulative demand; a document's place among its source's tokens, put through the inverse of that demand,
is its position in training. Documents are then range-sorted by position.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from racelake.llm.words import WORD_PATTERN
from racelake.operators.ordered import BLOCK, POS, cut
from racelake.sources.scratch import stable

#: Relative weight of a source at the start, middle and end of training; sources take these in turn.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
KEY = ["id", "source", "size", "content"]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def source_targets(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Shares of the sum of `sizes` by weight, none above `cap` times its size; the excess goes to the others."""
    targets, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= cap * sizes[i]]
        for i in full or open_:
            targets[i] = cap * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def _cumulative(schedule: Sequence[float]) -> list[float]:
    """Integral of a piecewise linear schedule from 0 to each of its evenly spaced knots."""
    width, sums = 1.0 / (len(schedule) - 1), [0.0]
    for a, b in zip(schedule, schedule[1:], strict=False):
        sums.append(sums[-1] + width * (a + b) / 2)
    return sums


def inverse_demand(share: Column, knots: int) -> Column:
    """The time at which a source has had `share` of its demand; columns `weight` and `demand` hold the schedule."""
    width = 1.0 / (knots - 1)
    wanted = share * F.col("demand")[knots - 1]

    def inside(k: int) -> Column:
        a, b = F.col("weight")[k], F.col("weight")[k + 1]
        left = F.greatest(wanted - F.col("demand")[k], F.lit(0.0))
        root = F.sqrt(F.greatest(a * a + 2 * (b - a) * left / width, F.lit(0.0)))
        step = F.when(a + root > 0, 2 * left / (a + root)).otherwise(F.lit(0.0))
        return F.lit(k * width) + F.least(step, F.lit(width))

    found = inside(knots - 2)
    for k in reversed(range(knots - 2)):
        found = F.when(wanted <= F.col("demand")[k + 1], inside(k)).otherwise(found)
    return found


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    cap: float = 3.0,
    rounds: int = 4,
) -> DataFrame:
    """One row for each document: `id, source, size, content, n_rows, source_size, target, copies, positions`.

    Sources in code point order, null last, take `weights` and `schedules` in turn. All documents of a source are
    taken as often as its target allows; of what is left, documents in the order of a hash are taken once more
    while they fit, in `rounds` passes, so that what remains open is less than the smallest document that was
    passed over. Documents are taken whole. Ties and reruns are settled by the hash and the id.

    A document is all rows with one id, source and text: they are taken alike and count together. Null or empty
    texts have size 0 and are never taken; a long text counts all its words, and only its number and hash travel; an empty
    table gives an empty plan. Other columns are not looked at.
    The number of sources is taken to be that of a configuration: their totals pass through the driver.
    """
    spark = docs.sparkSession
    knots = len(schedules[0])
    if any(len(s) != knots or min(s) < 0 or max(s) <= 0 for s in schedules) or knots < 2:
        raise ValueError("schedules need the same number of knots, two at least, and no negative weight")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("content"),
    )
    items = stable(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows")))
    totals = items.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("total")).collect()
    totals = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["total"] for r in totals]
    ratio = [weights[i % len(weights)] for i in range(len(sizes))]
    targets = source_targets(sizes, ratio, cap)
    table = []
    for i, (row, target) in enumerate(zip(totals, targets, strict=True)):
        base = math.floor(target / sizes[i] + 1e-9) if sizes[i] else 0
        schedule = [float(x) for x in schedules[i % len(schedules)]]
        extra = max(0.0, target - base * sizes[i])
        table.append((row["source"], i, sizes[i], target, base, extra, schedule, _cumulative(schedule)))
    shape = T.StructType(
        [
            T.StructField("source", docs.schema[source].dataType),
            T.StructField("s", T.IntegerType()),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
            T.StructField("base", T.IntegerType()),
            T.StructField("extra", T.DoubleType()),
            T.StructField("weight", T.ArrayType(T.DoubleType())),
            T.StructField("demand", T.ArrayType(T.DoubleType())),
        ]
    )
    known = spark.createDataFrame(table, shape)
    named = known.select(F.col("source").alias("__source"), "s")
    numbered = items.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    spread = numbered.withColumn("order", F.xxhash64("id", "content"))
    blocks = cut(spread, ["s"], ["order", "id", "size", "content"]).withColumn("more", F.lit(False))

    amount = F.col("size") * F.col("n_rows")
    for _ in range(rounds):
        taken = blocks.groupBy("s").agg(F.sum(F.when(F.col("more"), amount).otherwise(0)).alias("had"))
        open_ = known.join(taken, "s").select("s", (F.col("extra") + 0.5 - F.col("had")).alias("open"))
        fits = ~F.col("more") & (amount > 0) & (amount <= F.col("open"))
        # One row for each source, as `known` has.
        summed = _running(blocks.join(F.broadcast(open_), "s"), F.when(fits, amount).otherwise(0), "upto")
        chosen = F.col("more") | (fits & (F.col("upto") <= F.col("open")))
        blocks = stable(summed.withColumn("more", chosen).drop("open", "upto"))

    every = _running(blocks, amount, "all_upto")
    placed = _running(every, F.when(F.col("more"), amount).otherwise(0), "more_upto")
    sums = blocks.groupBy("s").agg(F.sum(F.when(F.col("more"), amount).otherwise(0)).alias("had"))
    facts = known.drop("source").join(sums, "s")
    full = F.col("base") * F.col("source_size") + F.col("had")
    passes = F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("base") - 1)).otherwise(F.array().cast("array<int>"))
    passes = F.when(F.col("base") > 0, passes).otherwise(F.array().cast("array<int>"))

    def position(middle: Column) -> Column:
        return inverse_demand(F.least(middle / F.col("full"), F.lit(1.0)), knots)

    again = F.col("base") * F.col("source_size") + F.col("more_upto") - amount / 2
    first = F.transform(passes, lambda k: position(k * F.col("source_size") + F.col("all_upto") - amount / 2))
    last = F.when(F.col("more"), F.array(position(again))).otherwise(F.array().cast("array<double>"))
    return (
        placed.join(F.broadcast(facts), "s")
        .withColumn("full", full.cast("double"))
        .withColumn("positions", F.concat(first, last))
        .select(*KEY, "n_rows", "source_size", "target", F.size("positions").alias("copies"), "positions")
    )


def _running(blocks: DataFrame, amount: Column, name: str) -> DataFrame:
    """`blocks` with the running sum of `amount` in each `s`: inside a block, plus what earlier blocks hold."""
    inside = Window.partitionBy("s", BLOCK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    sums = blocks.select("s", BLOCK, amount.alias("__sum")).groupBy("s", BLOCK).agg(F.sum("__sum").alias("__sum"))
    # One row for each block and source.
    earlier = Window.partitionBy("s").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("s", BLOCK, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    summed = blocks.withColumn("__inside", F.sum(amount).over(inside)).join(before, ["s", BLOCK])
    return summed.withColumn(name, F.col("__inside") + F.col("__before")).drop("__inside", "__before")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The training set: rows of `docs`, each as often as `plan_mix` takes it, range-sorted by position.

    Columns are those of `docs`; nulls, repeats, ties and empty tables are as for the plan.
    """
    plan = plan_mix(docs, id_col, text, source, **options).select(
        *[F.col(k).alias(f"__{k}") for k in KEY], F.explode("positions").alias("__position")
    )
    keyed = docs.withColumns(
        {
            "__of_id": F.col(id_col),
            "__of_source": F.col(source),
            "__of_size": word_count(F.col(text)),
            "__of_content": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        }
    )
    same = reduce(lambda a, b: a & b, [F.col(f"__of_{k}").eqNullSafe(F.col(f"__{k}")) for k in KEY])
    ordered = keyed.join(plan, same).repartitionByRange("__position", "__of_id")
    return ordered.sortWithinPartitions("__position", "__of_id").select(*docs.columns)
