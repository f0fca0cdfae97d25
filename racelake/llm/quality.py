"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racelake.llm.words import SPACE_CLASS, WORD_PATTERN

WINDOW = 8

# Frequent function words of the four languages; a word may carry other characters at its ends.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are at an or from "
    "de la le les et des un une en du dans est que pour pas au elle il qui sur "
    "der die das und zu den von im mit nicht sich für auf dem ein eine ist des "
    "el los las y que del por con su al una no para se"
).split()


@dataclass(frozen=True)
class Rule:
    """`least` <= `of` / `per` <= `most`; a ratio over zero is 0. Either bound may be missing."""

    name: str
    of: str
    per: str | None = None
    least: float | None = None
    most: float | None = None

    def passes(self) -> Column:
        value = F.col(self.of).cast("double")
        if self.per:
            value = F.when(F.col(self.per) > 0, value / F.col(self.per)).otherwise(F.lit(0.0))
        checks = [value >= F.lit(self.least)] if self.least is not None else []
        checks += [value <= F.lit(self.most)] if self.most is not None else []
        return reduce(lambda a, b: a & b, checks, F.lit(True))


#: The production table. Symbols, stop words, words in capitals and lines (repeated, or with a bullet) are shares; lengths
#: are code points.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=1.5, most=30.0),
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.25),
    Rule("stop_words_per_word", "n_stop_words", "n_words", least=0.02),
    Rule("shouted_words", "n_shouted", "n_words", most=0.5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("list_lines", "n_list_lines", "n_lines", most=0.9),
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where `body` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")


def repeated_window_words(tokens: Column, size: int = WINDOW) -> Column:
    """Words of `tokens` that lie in a window of `size` (a power of two) found twice or more.

    Windows are compared by a 64-bit hash, doubled from words; only texts with an equal pair are looked at twice.
    """

    def doubled(step: int, hashes: Column) -> Column:
        if step == size:
            return F.slice(hashes, 1, F.greatest(F.size(hashes) - size + 1, F.lit(0)))
        pairs = bound(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))))
        return doubled(2 * step, pairs)

    def covered(found: Column) -> Column:
        at = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            def kept(x: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(s, k - 1)["h"])
                twice = x["h"].eqNullSafe(before) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])
                return F.when(twice, x["i"])

            return F.array_sort(F.filter(F.transform(s, kept), lambda p: p.isNotNull()))

        def total(p: Column) -> Column:
            spans = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(size)), F.lit(size)))
            return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

        return bound(bound(at, repeated), total)

    def count(found: Column) -> Column:
        has = F.size(F.array_distinct(found)) < F.size(found)
        return F.when(has, covered(found)).otherwise(F.lit(0).cast("long"))

    return bound(doubled(1, F.transform(tokens, lambda w: F.xxhash64(w))), count)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with one bigint column for each measure that a rule can name. A null text has no words and no lines."""
    value = F.coalesce(F.col(text), F.lit(""))
    stop = rf"(?iu)^[^\p{{L}}\p{{N}}]*(?:{'|'.join(sorted(set(STOP_WORDS)))})[^\p{{L}}\p{{N}}]*$"
    held = docs.withColumn("__text", value).withColumn("__words", words(F.col("__text")))
    whole, tokens = F.col("__text"), F.col("__words")
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD_PATTERN))
    list_line = F.filter(lines, lambda line: line.rlike(rf"^{SPACE_CLASS}*[-*•|]"))
    measured = {
        "n_words": F.size(tokens),
        "word_chars": F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_list_lines": F.size(list_line),
        "n_stop_words": F.size(F.filter(tokens, lambda w: w.rlike(stop))),
        "n_shouted": F.size(F.filter(tokens, lambda w: (F.upper(w) == w) & (F.lower(w) != w))),
        "n_repeat_words": repeated_window_words(tokens),
    }
    return held.withColumns({k: v.cast("long") for k, v in measured.items()}).drop("__text", "__words")


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Every row of `docs` with its measures, `base_failed`, the names of the `broken` rules, and `kept`.

    Base: fewer than 20 words, or over 30 % of the words in repeated windows of eight. Rows are judged alone, so
    repeated rows and ties are judged alike; a null or empty text has no words and fails; a long text is judged whole,
    within its row; an empty table gives an empty one. Columns of `docs` named like a result are replaced by it. Nothing is shuffled.
    """
    results = (
        "n_words word_chars n_symbols n_lines n_dup_lines n_list_lines n_stop_words n_shouted n_repeat_words "
        "base_failed broken kept __text __words"
    ).split()
    clean = docs.drop(*[c for c in results if c != text])
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    broken = F.filter(
        F.array(*[F.when(~rule.passes(), F.lit(rule.name)) for rule in rules] or [F.lit(None).cast("string")]),
        lambda name: name.isNotNull(),
    )
    judged = measures(clean, text).withColumns({"base_failed": base, "broken": broken})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
