"""Small tables with the odd rows that every operator must stand, and brute-force helpers."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "ba ko ri ten mu sol qua ver dim pla zu ger nok fi sa tor".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, row string"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def documents(spark, rows=None):
    """Plain texts, copies, near copies, repeated rows, nulls in every column, empty and long texts; columns that clash."""
    if rows is None:
        rng = random.Random(7)
        texts = [sentence(rng, rng.randint(1, 120)) for _ in range(30)]
        line = "This very line is shared by many documents, over and over."
        texts += [f"{sentence(rng, 30)}\n  {line.upper()} \n{sentence(rng, 5)}" for _ in range(8)]
        base = sentence(rng, 90).split()
        texts += [" ".join(base)] * 3 + [" ".join(base[:k] + ["odd"] + base[k + 1 :]) for k in (3, 40, 88)]
        texts += [sentence(rng, 6000), "", " \t\n", "a", "one two three", "### 12", "x\n" * 50, "Ä ß ▁ é z"]
        rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}") for i, t in enumerate(texts)]
        rows += [(900, None, None, None), (None, texts[0], "en", "s1"), rows[2], rows[2], (901, texts[5], None, None)]
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", 1, "clash") for r in rows], SCHEMA)


def collected(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
