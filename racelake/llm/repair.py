"""Repairing the structure of conversations by the cheapest edits.

A conversation should hold an optional system turn and then user and assistant turns in alternation, the assistant's
last. Turns are kept, given another role, deleted or inserted, each at a cost. The cheapest sequence of edits is found
by iterative-deepening A*: depth-first search that tries edits in ASCII order under a bound on cost plus what the rest
costs at least, the bound growing until a path is accepted. States that failed are remembered with the budget they
failed with, so that they are not searched again. The first path accepted is the answer: none is cheaper, and of those
that cost as much it is the ASCII-least.

Rows are range-partitioned by conversation and order and numbered; blocks of them are searched. A conversation inside
a block is one search. One that is longer than a piece, or goes on in another block, is searched for every pair of
states that a piece may begin and end in, and the pieces are then folded, which gives the same edits: two paths between
the same states at the same cost never begin with one another, as the longer one would only add insertions.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racelake.llm.streams import Rows, in_order, stream
from racelake.sources.scratch import stable

#: Costs of the edits; a turn that breaks off and is not deleted costs `CUT_OFF` more.
RETITLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5

#: What has been read so far: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ACCEPTING = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The next turn that a state expects, for edits that may choose its role.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Pairs of adjacent roles that need no repair.
LEGAL = ("su", "ua", "au")

#: Rows that one search covers, and rows of a block.
PIECE_ROWS, BLOCK_ROWS = 64, 1024

HASH = ["__h1", "__h2"]
#: A row as the search sees it: its role's initial (empty: it must be deleted), and whether it breaks off.
Turn = tuple[str, bool]
#: Cheapest cost and edits for each pair of states that a piece begins and ends in.
Table = dict[tuple[int, int], tuple[int, str]]


class Search:
    """Cheapest edits of `turns` that end in one of `goals`."""

    def __init__(self, turns: Sequence[Turn], goals: Sequence[int]) -> None:
        self.turns, self.goals = turns, set(goals)
        #: What the turns from each one on cost at least, and whether one of them can open with the system.
        self.least, self.system = [0] * (len(turns) + 1), [False] * (len(turns) + 1)
        for i in range(len(turns) - 1, -1, -1):
            initial, cut_off = turns[i]
            late = CUT_OFF * cut_off
            keep = late if initial in ("s", "u", "a") else RETITLE + late
            self.least[i] = self.least[i + 1] + (min(DELETE, keep) if initial else DELETE)
            self.system[i] = self.system[i + 1] or initial == "s"
        self.failed: dict[tuple[int, int], int] = {}

    def run(self, start: int) -> tuple[int, str] | None:
        # Deleting every turn and inserting up to two reaches all goals that can be reached but one: a system turn
        # has to be kept for it, perhaps one that breaks off.
        most = DELETE * len(self.turns) + 2 * INSERT
        for bound in range(self.least[0], most + 1):
            edits: list[str] = []
            if self._accepts(0, start, bound, edits):
                return bound, "".join(reversed(edits))
        return None

    def _reachable(self, at: int, state: int) -> bool:
        if self.goals & {USER, ASSISTANT}:
            return True
        if START in self.goals and state == START:
            return True
        return SYSTEM in self.goals and (state == SYSTEM or (state == START and self.system[at]))

    def _accepts(self, at: int, state: int, left: int, edits: list[str]) -> bool:
        """Whether the turns from `at` on can be repaired for `left`; if so, `edits` gets the edits, last ones first."""
        if left < self.least[at] or not self._reachable(at, state):
            return False
        if at == len(self.turns) and state in self.goals:
            return True
        if self.failed.get((at, state), -1) >= left:
            return False
        for edit, place, then, cost in self._edits(at, state):
            if self._accepts(place, then, left - cost, edits):
                edits.append(edit)
                return True
        self.failed[at, state] = left
        return False

    def _edits(self, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Edits in ASCII order: their letter, the turn and state after them, their cost."""
        inside, then = at < len(self.turns), _NEXT[state]
        if inside:
            yield "D", at + 1, state, DELETE
        yield "I", at, then, INSERT
        if inside and self.turns[at][0]:
            initial, cut_off = self.turns[at]
            late = CUT_OFF * cut_off
            if initial == "s" and state == START:
                yield "K", at + 1, SYSTEM, late
            if initial == ROLES[then][0]:
                yield "K", at + 1, then, late
            yield "R", at + 1, then, RETITLE + late


def table_of(turns: Sequence[Turn], starts: Sequence[int], goals: Sequence[int]) -> Table:
    """Cheapest edits for each start and goal; pairs that no edits connect are left out."""
    found: Table = {}
    for goal in goals:
        search = Search(turns, [goal])
        for start in starts:
            if (best := search.run(start)) is not None:
                found[start, goal] = best
    return found


def joined(first: Table, second: Table) -> Table:
    """Cheapest edits of two pieces in a row, ASCII-least where they cost as much."""
    best: Table = {}
    for (start, middle), (cost, edits) in first.items():
        for (begin, goal), (more, others) in second.items():
            if begin == middle:
                path = (cost + more, edits + others)
                best[start, goal] = min(best.get((start, goal), path), path)
    return best


def repair_table(turns: Sequence[Turn], open_start: bool, open_end: bool, piece_rows: int = PIECE_ROWS) -> Table:
    """All that later folding needs to know of turns in a row; one search where they are a whole conversation."""
    starts = STATES if open_start else (START,)
    if len(turns) <= piece_rows:
        if open_start or open_end:
            return table_of(turns, starts, STATES if open_end else ACCEPTING)
        cost, edits = Search(turns, ACCEPTING).run(START)
        return {(START, ASSISTANT): (cost, edits)}
    table = table_of(turns[:piece_rows], starts, STATES)
    for first in range(piece_rows, len(turns), piece_rows):
        piece = turns[first : first + piece_rows]
        last = first + piece_rows >= len(turns)
        table = joined(table, table_of(piece, STATES, ACCEPTING if last and not open_end else STATES))
    return table


class Path:
    """The cheapest edits up to here for each state, with what all of them begin with kept apart."""

    def __init__(self) -> None:
        self.common: list[str] = []
        self.best: dict[int, tuple[int, str]] = {START: (0, "")}

    def extend(self, table: Table) -> None:
        after: dict[int, tuple[int, str]] = {}
        for (start, goal), (cost, edits) in table.items():
            if start in self.best:
                before = self.best[start]
                path = (before[0] + cost, before[1] + edits)
                after[goal] = min(after.get(goal, path), path)
        shared = len(os.path.commonprefix([edits for _, edits in after.values()]))
        self.common.append(next(iter(after.values()))[1][:shared])
        self.best = {state: (cost, edits[shared:]) for state, (cost, edits) in after.items()}

    def result(self) -> tuple[int, str]:
        cost, edits = min(self.best[state] for state in ACCEPTING if state in self.best)
        return cost, "".join(self.common) + edits


STRIPPED = " \t\n\x0b\x0c\r"
_COUNTS = ["turns", "blank", "duplicate", "truncated", "illegal", "cost"]
_SEGMENT = (
    "conv_id {kind}, block bigint, first bigint, last bigint, distinct bigint, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, opens string, closes string, rows bigint, "
    "options array<struct<start int, goal int, cost bigint, edits string>>"
)
_REPORT = (
    "conv_id {kind}, turns bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string"
)
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_OPTION = pa.struct([("start", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])


def _schema(text: str, kind: str) -> tuple[pa.Schema, str]:
    text = text.format(kind=kind)
    plain = text.split("array<")[0].rstrip(" ").removesuffix("options").rstrip(", ")
    fields = [(n, _ARROW[t]) for n, t in (part.split() for part in plain.split(", "))]
    return pa.schema([*fields, *([("options", pa.list_(_OPTION))] if "options" in text else [])]), text


def repair_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """A report with one row for each conversation, and the repaired turns.

    A conversation's rows are taken by turn, null first, rows of one turn by role and then by their text's hash. A row
    counts by its first fault: `blank` (nothing but white space; null counts so), `duplicate` (its role and text came
    earlier in the conversation, a null text being an empty one), `truncated` (its last character that is no white
    space isn't one of `.!?`). The report holds the number of rows (`turns`), missing turns (`gaps`), faults, pairs of
    adjacent roles that are not in `LEGAL` (`illegal`), the `cost` of the cheapest edits and their initials (`audit`):
    Keep, Rerole, Delete, Insert. Blank and duplicate rows must be deleted. A role counts by its first letter; any but
    s, u and a, a null or empty one too, has to be changed or deleted.

    Repaired turns are `conv_id`, `place` (from 0), `role`, `text` and `edit`, a conversation's rows adjacent and in
    order; inserted ones have an empty text. A conversation of which all is deleted has none. A null id is a
    conversation like any other. Other columns are left out, so clashing names do no harm; repeated rows are
    duplicates; texts may be as long as a row holds; an empty table gives two empty ones.
    """
    kind = dict(turns.select(F.col(conv).alias("c")).dtypes)["c"]
    value = F.coalesce(F.col(text), F.lit(""))
    named = F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        named.alias("role"),
        F.xxhash64(value).alias(HASH[0]),
        F.xxhash64(F.lit(1), value).alias(HASH[1]),
        value.alias("text"),
    )
    report = stable(_report(rows, kind))
    return report, _repaired(rows, report, kind)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows without their texts, numbered in order; a conversation of any length is spread over partitions."""
    end = F.right(F.btrim("text", F.lit(STRIPPED)), F.lit(1))
    narrow = rows.select(
        "conv_id",
        "turn",
        "role",
        *HASH,
        (end == "").alias("blank"),
        (~end.isin(".", "!", "?")).alias("truncated"),
        # Rows that are alike in all else are spread too.
        F.monotonically_increasing_id().alias("__id"),
    )
    order = ["conv_id", "turn", "role", *HASH, "__id"]
    return stable(
        narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    )


def _report(rows: DataFrame, kind: str) -> DataFrame:
    placed = _placed(rows)
    first = placed.groupBy("conv_id", "role", *HASH).agg(F.min("at").alias("at"))
    seen = F.col("__first").isNull()
    marked = placed.join(first.select("at", F.lit(True).alias("__first")), "at", "left").select(
        "conv_id",
        F.shiftright("at", BLOCK_ROWS.bit_length() - 1).alias("block"),
        "at",
        "turn",
        F.left("role", F.lit(1)).alias("initial"),
        "blank",
        (~F.col("blank") & seen).alias("duplicate"),
        (~F.col("blank") & ~seen & F.col("truncated")).alias("truncated"),
    )
    arrow, schema = _schema(_SEGMENT, kind)
    blocks = in_order(marked.select("block", "conv_id", "at", *marked.columns[3:]), ["block"], ["at"])
    segments = stream(blocks, _segments, arrow, schema)
    arrow, schema = _schema(_REPORT, kind)
    return stream(in_order(segments, ["conv_id"], ["block"]), _folded, arrow, schema)


def _segments(rows: Rows) -> Iterator[tuple]:
    """Every conversation's part of each block. The first and the last one of a block may go on beyond it."""
    for block, inside in groupby(rows, itemgetter(0)):
        parts = groupby(inside, itemgetter(1))
        part = next(parts, None)
        opened = True
        while part is not None:
            conv, held = part[0], list(part[1])
            part = next(parts, None)
            yield _segment(conv, block, held, opened, part is None)
            opened = False


def _segment(conv, block: int, held: list[tuple], open_start: bool, open_end: bool) -> tuple:
    turns = [row[3] for row in held if row[3] is not None]
    initials = [row[4] for row in held]
    wanted = [("" if row[5] or row[6] else row[4] or "?", row[7]) for row in held]
    table = repair_table(wanted, open_start, open_end)
    return (
        conv,
        block,
        turns[0] if turns else None,
        turns[-1] if turns else None,
        len(set(turns)),
        *[sum(row[i] for row in held) for i in (5, 6, 7)],
        _illegal(initials),
        initials[0],
        initials[-1],
        len(held),
        [{"start": s, "goal": g, "cost": c, "edits": e} for (s, g), (c, e) in table.items()],
    )


def _illegal(initials: Sequence[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _folded(segments: Rows) -> Iterator[tuple]:
    for conv, parts in groupby(segments, itemgetter(0)):
        path, low, high, distinct, rows, last = Path(), None, None, 0, 0, None
        counts = [0, 0, 0, 0]
        for _, _, first, final, different, *more, opens, closes, n, options in parts:
            if first is not None:
                distinct += different - (high == first)
                low, high = first if low is None else low, final
            counts = [a + b for a, b in zip(counts, more, strict=True)]
            if last is not None:
                counts[3] += _illegal([last, opens])
            rows, last = rows + n, closes
            path.extend({(o["start"], o["goal"]): (o["cost"], o["edits"]) for o in options})
        gaps = 0 if low is None else high - low + 1 - distinct
        yield conv, rows, gaps, *counts, *path.result()


def _repaired(rows: DataFrame, report: DataFrame, kind: str) -> DataFrame:
    """Edits go before the rows of their conversation, which then stream past them."""
    order = ["row", "turn", "role", *HASH]
    texts = rows.select("conv_id", F.lit(1).alias("row"), "turn", "role", *HASH, "text")
    none = F.lit(None).cast("long")
    audits = report.select(
        "conv_id",
        F.lit(0).alias("row"),
        none.alias("turn"),
        F.lit("").alias("role"),
        *[none.alias(h) for h in HASH],
        F.col("audit").alias("text"),
    )
    ordered = in_order(texts.unionByName(audits), ["conv_id"], order).select("conv_id", "row", "role", "text")
    arrow = pa.schema([("conv_id", _ARROW[kind]), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    return stream(ordered, _edited, arrow, f"conv_id {kind}, place bigint, role string, text string, edit string")


def _edited(rows: Rows) -> Iterator[tuple]:
    for conv, held in groupby(rows, itemgetter(0)):
        audit = iter(next(held)[3])
        state, place = START, 0
        edit = next(audit, None)
        while edit is not None:
            _, _, role, text = (None, None, None, "") if edit == "I" else next(held)
            if edit != "D":
                state = SYSTEM if edit == "K" and state == START and role[:1] == "s" else _NEXT[state]
                yield conv, place, role if edit == "K" else ROLES[state], text, edit
                place += 1
            edit = next(audit, None)
