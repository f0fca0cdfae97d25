"""How filters interact: what each removes at each step of every order in which they can be applied.

Documents are first counted by part and by the set of filters they fail (a mask). Every such cell then folds across
the array of all orders, with `transform` over orders and `aggregate` over an order's steps, into one weighted struct
for each order and step; the structs of a part's cells are added element by element. Nothing but the cells is
shuffled, and a part has at most two to the number of filters of them, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Orders grow with the factorial of the number of filters, and each is folded for every cell.
MOST_FILTERS = 6
COUNTS = ["kept", "removed", "redundant", "unique_fails"]


HASH = ["text_h1", "text_h2"]


def text_hash(text: Column) -> list[Column]:
    """128 bits of a text in two columns; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias(HASH[0]), F.xxhash64(F.lit(1), text).alias(HASH[1])]


def with_copies(docs: DataFrame, id_col: str, name: str) -> DataFrame:
    """`docs` (with the columns of `text_hash`) and a flag `name`: whether a row with a smaller id has the same text.

    Rows that share both text and id are no copies of each other. A row without an id has no smaller one and is
    none. Texts are compared by their 128-bit hashes. The smallest id of each text is aggregated before the shuffle;
    it returns by (text, id), so that a text in a third of all rows is spread by its ids.
    """
    least = docs.filter(F.col(id_col).isNotNull()).groupBy(*HASH).agg(F.min(id_col).alias("__least"))
    first = least.select(*[F.col(c).alias(f"__of_{c}") for c in HASH], "__least")
    same = [F.col(c) == F.col(f"__of_{c}") for c in HASH]
    joined = docs.join(first, [*same, F.col(id_col) == F.col("__least")], "left")
    later = F.col(id_col).isNotNull() & F.col("__least").isNull()
    return joined.select(*[c for c in docs.columns if c != name], later.alias(name))


def audit_filters(
    docs: DataFrame, fails: Mapping[str, Column], part: Column, losses: Mapping[str, Column]
) -> DataFrame:
    """One row for each part, order of filters and step.

    `fails` says for each filter (a name of one letter) whether a document fails it, null meaning that it doesn't.
    `losses` names conditions whose documents are counted where they are removed. Returned are `part` (null: an empty
    text), `filter_order`, `step` (from 1), `filter`, and as longs: documents `kept` after the step, `removed` by it,
    `redundant` (they fail its filter but had gone before), `unique_fails` (they fail its filter and no other), one
    column for each loss, and `shapley`, which adds up what the filter removes over all orders. A part that loses
    nothing has its zeros; a table without rows gives none. Every row counts, repeated ones too; other columns of
    `docs` are not looked at, so they can't clash. Texts of any length are the caller's: only conditions come in.
    """
    letters = "".join(fails)
    if len(letters) != len(fails) or not 1 <= len(fails) <= MOST_FILTERS:
        raise ValueError(f"filters are 1 to {MOST_FILTERS} single letters")
    mask = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(0) for i, c in enumerate(fails.values())],
    )
    flagged = docs.select(
        F.coalesce(part, F.lit("")).alias("part"),
        mask.alias("mask"),
        *[F.coalesce(c, F.lit(False)).cast("long").alias(name) for name, c in losses.items()],
    )
    cells = flagged.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("docs"), *[F.sum(name).alias(name) for name in losses]
    )
    steps = len(letters)
    orders = F.lit(["".join(p) for p in permutations(letters)])
    fields = [*COUNTS, *losses]
    folded = cells.select("part", F.flatten(F.transform(orders, lambda o: _fold(o, letters, fields, losses))).alias("of"))

    def added(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(*[(x[f] + y[f]).alias(f) for f in fields]))

    gathered = folded.groupBy("part").agg(F.collect_list("of").alias("all"))
    rest = F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))
    summed = gathered.select("part", F.aggregate(rest, F.element_at("all", 1), added).alias("sums"))
    # Both are computed once for each part: outside the explosion, and without a filter on its input.
    charged = summed.select("part", "sums", _shapley(orders, letters).alias("by_filter"))
    placed = charged.select("part", F.posexplode_outer("sums").alias("at", "sum"), "by_filter")
    order = F.element_at(orders, F.floor(F.col("at") / steps).cast("int") + 1)
    step = (F.col("at") % steps + 1).cast("int")
    named = placed.select("part", order.alias("filter_order"), step.alias("step"), "sum", "by_filter")
    letter = F.expr("substring(filter_order, step, 1)")
    return named.select(
        "part", "filter_order", "step", letter.alias("filter"), "sum.*", F.element_at("by_filter", letter).alias("shapley")
    )


def _fold(order: Column, letters: str, fields: Sequence[str], losses: Mapping[str, Column]) -> Column:
    """One order's steps: whether the cell is still there, and what each step does to it."""
    shape = f"array<struct<{', '.join(f'{f}: bigint' for f in fields)}>>"
    start = F.struct(F.lit(True).alias("here"), F.array().cast(shape).alias("made"))

    def count(condition: Column, weight: str = "docs") -> Column:
        return F.when(condition, F.col(weight)).otherwise(F.lit(0).cast("long"))

    def step(state: Column, letter: Column) -> Column:
        bit = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(letters) for x in (c, 1 << i)]), letter)
        fails = F.col("mask").bitwiseAND(bit) != 0
        gone, stays = state["here"] & fails, state["here"] & ~fails
        made = F.struct(
            count(stays).alias("kept"),
            count(gone).alias("removed"),
            count(~state["here"] & fails).alias("redundant"),
            count(F.col("mask") == bit).alias("unique_fails"),
            *[count(gone, name).alias(name) for name in losses],
        )
        return F.struct(stays.alias("here"), F.concat(state["made"], F.array(made)).alias("made"))

    return F.aggregate(F.split(order, ""), start, step, lambda state: state["made"])


def _shapley(orders: Column, letters: str) -> Column:
    """For each filter, what it removes at whichever step it stands, added over all orders."""
    at = F.flatten(F.transform(orders, lambda o: F.split(o, "")))

    def removed(letter: str) -> Column:
        pairs = F.zip_with(at, F.col("sums"), lambda x, y: F.when(x == letter, y["removed"]).otherwise(F.lit(0).cast("long")))
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, b: a + b)

    return F.create_map(*[x for c in letters for x in (F.lit(c), removed(c))])
