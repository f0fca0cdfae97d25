"""Language identification by compression.

A text is compressed with one zstandard raw-content dictionary for each language; the language whose dictionary
gives the smallest output is chosen, and the choice is rejected where the runner-up is nearly as small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Where a margin is narrow, sizes are summed over these levels too: a size is a whole number of bytes, so the sizes of
#: a short text differ by few steps.
FINER = (1, 5, 12, 19)
RESULT = "lang_pred string, score double, rejected boolean"


@dataclass
class LanguageModel:
    """Lower-case sample text for each language. Texts are lower-cased and compressed in pieces of `piece_bytes`,
    so that the dictionary counts in all of a long text and not only at its start."""

    dictionaries: dict[str, bytes]
    piece_bytes: int = 1024
    level: int = 9
    min_margin: float = 0.001
    _compressors: dict[tuple[str, int], zstandard.ZstdCompressor] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_compressors": {}}

    def sizes(self, text: str, levels: Sequence[int]) -> list[tuple[int, str]]:
        """Compressed size for each language, smallest first, summed over `levels`; ties go to the name that sorts
        first."""
        raw = text.lower().encode("utf-8", "surrogatepass")
        parts = [raw[i : i + self.piece_bytes] for i in range(0, len(raw), self.piece_bytes)]
        ways = {name: [self._compressor(name, level) for level in levels] for name in sorted(self.dictionaries)}
        return sorted((sum(len(c.compress(p)) for c in way for p in parts), name) for name, way in ways.items())

    def _compressor(self, name: str, level: int) -> zstandard.ZstdCompressor:
        if (name, level) not in self._compressors:
            data = zstandard.ZstdCompressionDict(self.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self._compressors[name, level] = zstandard.ZstdCompressor(
                level=level, dict_data=data, write_content_size=False
            )
        return self._compressors[name, level]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, relative margin over the runner-up, and whether the choice is rejected."""
        if not self.dictionaries or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        for levels in ([self.level], [self.level, *FINER]):
            ranked = self.sizes(text, levels)
            if len(ranked) == 1:
                return ranked[0][1], 1.0, False
            (best, name), (second, _) = ranked[:2]
            margin = 1.0 - best / second
            if margin >= self.min_margin:
                return name, margin, False
        return name, margin, True


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = 256,
    dictionary_bytes: int = 32 << 10,
    **options,
) -> LanguageModel:
    """Dictionaries from a bounded sample: for each language, the `sample_rows` labelled texts that are first by a
    hash of the text. Whole texts are cut into pieces of `dictionary_bytes // sample_rows` bytes. Each text gives the
    piece that is first by a hash, then each the second, and so on until `dictionary_bytes` are full; a piece counts
    once in a language, so openings that many texts share take the room of one. Null texts and languages are not
    learned from. The driver holds the dictionaries only."""
    labelled = docs.filter(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull())
    texts = labelled.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("order"), F.col(text).alias("text"))
    # First in each of 16 parts of a language, then of what is left: no task gets more than 16 * `sample_rows` of one.
    chosen = texts.select("lang", "order").distinct().withColumn("part", F.pmod("order", F.lit(16)))
    for keys in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("order"))
        chosen = chosen.withColumn("rank", rank).filter(F.col("rank") <= sample_rows)
    named = texts.join(F.broadcast(chosen.select("lang", "order")), ["lang", "order"])
    whole = named.groupBy("lang", "order").agg(F.min(F.lower("text").cast("binary")).alias("raw"))

    size = max(1, dictionary_bytes // sample_rows)
    starts = F.sequence(F.lit(1), F.length("raw"), F.lit(size))
    cut = F.transform(starts, lambda at: F.substring(F.col("raw"), at, F.lit(size)))
    hashed = F.sort_array(F.transform(F.array_distinct(cut), lambda p: F.struct(F.xxhash64(p).alias("h"), p.alias("p"))))
    each = whole.select("lang", "order", F.posexplode(hashed).alias("turn", "piece"))
    once = each.groupBy("lang", F.col("piece.p").alias("content")).agg(F.min(F.struct("turn", "order")).alias("place"))
    before = Window.partitionBy("lang").orderBy("place", "content").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0))
    taken = once.withColumn("used", used).filter(F.col("used") + F.length("content") <= dictionary_bytes).collect()
    found: dict[str, list[tuple[int, bytes]]] = {}
    for row in taken:
        found.setdefault(row["lang"], []).append((row["used"], bytes(row["content"])))
    return LanguageModel({k: b"\n".join(c for _, c in sorted(v)) for k, v in sorted(found.items())}, **options)


def identify(model: LanguageModel) -> Column:
    """A function of a text column that returns `RESULT`, in Arrow batches."""

    @F.pandas_udf(RESULT)
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(map(model.predict, texts), columns=["lang_pred", "score", "rejected"])

    return language


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: Sequence[str] = ("*",)) -> DataFrame:
    """Every row of `docs` with `lang_pred`, `score` (0 to 1) and `rejected`.

    Texts that are null, empty or without a letter are `und`, score 0, rejected; so is every text if no language
    was learned. Ties between languages go to the name that sorts first, with score 0. Rows are judged alone by
    their whole text, so repeats get the same answer. Clashing columns are replaced.
    """
    clean = docs.drop(*[c for c in ("lang_pred", "score", "rejected") if c != text])
    return clean.select(*keep, identify(model)(F.col(text)).alias("__found")).select("*", "__found.*").drop("__found")
