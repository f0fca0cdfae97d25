"""Mixing and language ID against plain Python, hashes included."""

from __future__ import annotations

import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash
import zstandard

from racelake.llm import language, mixing
from corpus import collected, documents, words


def hash64(*values, seed=42):
    """Hashes of the values, one seeding the next; nulls leave the seed as it is."""
    for value in values:
        if value is not None:
            raw = struct.pack("<q", value) if isinstance(value, int) else value if isinstance(value, bytes) else value.encode()
            seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def demand(weights, at):
    """Share of the integral of a schedule, linear between its knots, that lies before `at`."""
    grid = np.linspace(0.0, 1.0, len(weights))
    x = np.unique(np.concatenate([grid, [at]]))
    y = np.interp(x, grid, weights)
    pieces = np.diff(x) * (y[1:] + y[:-1]) / 2
    return pieces[x[1:] <= at].sum() / pieces.sum()


def test_mixing_takes_the_rows_and_places_that_a_loop_takes(spark):
    docs = documents(spark)
    held = defaultdict(int)
    for i, text, source in collected(docs, "doc_id", "text", "source"):
        held[i, source, len(words(text)), hash64(text or "")] += 1
    names = sorted({k[1] for k in held}, key=lambda s: (s is None, s or ""))
    sizes = [sum(k[2] * n for k, n in held.items() if k[1] == s) for s in names]
    targets = mixing.source_targets(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))], 3.0)
    want = {}
    for k, source in enumerate(names):
        rows = [(key, key[2] * n) for key, n in held.items() if key[1] == source]
        rows.sort(key=lambda r: (hash64(r[0][0], r[0][3]), r[0][0] is not None, r[0][0] or 0, r[0][2], r[0][3]))
        base = int(targets[k] / sizes[k] + 1e-9) if sizes[k] else 0
        extra, more = targets[k] - base * sizes[k], set()
        for _ in range(4):
            free, upto = extra + 0.5 - sum(n for key, n in rows if key in more), 0
            fit = [(key, n) for key, n in rows if key not in more and 0 < n <= free]
            for key, n in fit:
                upto += n
                if upto <= free:
                    more.add(key)
        had, before, before_more = sum(n for key, n in rows if key in more), 0, 0
        for key, n in rows:
            middles = [p * sizes[k] + before + n / 2 for p in range(base)] if n else []
            before += n
            if key in more:
                middles.append(base * sizes[k] + before_more + n / 2)
                before_more += n
            full = base * sizes[k] + had
            want[key] = (held[key], [m / full for m in middles], mixing.SCHEDULES[k % len(mixing.SCHEDULES)])
    got = collected(mixing.plan_mix(docs), "id", "source", "size", "content", "n_rows", "positions")
    assert len(got) == len(want) and sum(len(g[5]) for g in got) > len(got)
    for *key, n_rows, positions in got:
        rows, shares, schedule = want[tuple(key)]
        assert n_rows == rows
        assert [demand(schedule, p) for p in positions] == pytest.approx(shares, abs=1e-9)


def dictionaries_by_hand(rows, sample_rows, room):
    by_lang = defaultdict(dict)
    for text, lang in rows:
        if lang is not None and text is not None and any(map(str.isalpha, text)):
            by_lang[lang][hash64(text)] = text.lower().encode()
    found = {}
    for lang, texts in by_lang.items():
        size, places = max(1, room // sample_rows), {}
        for order in sorted(texts)[:sample_rows]:
            raw = texts[order]
            cut = {raw[at : at + size] for at in range(0, len(raw), size)}
            for turn, piece in enumerate(sorted(cut, key=lambda p: (hash64(p), p))):
                places[piece] = min(places.get(piece, (turn, order)), (turn, order))
        used, taken = 0, []
        for piece in sorted(places, key=lambda p: (places[p], p)):
            if used + len(piece) <= room:
                taken.append(piece)
            used += len(piece) + 1
        found[lang] = b"\n".join(taken)
    return found


@pytest.mark.parametrize("sample_rows, room", [(256, 32 << 10), (5, 400)])
def test_language_is_that_of_the_smallest_output(spark, sample_rows, room):
    docs = documents(spark)
    rows = collected(docs, "text", "lang")
    model = language.fit(docs, sample_rows=sample_rows, dictionary_bytes=room)
    expected = dictionaries_by_hand(rows, sample_rows, room)
    assert model.dictionaries == expected

    def size(text, lang, levels):
        raw, total = text.lower().encode(), 0
        for level in levels:
            data = zstandard.ZstdCompressionDict(expected[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            tool = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False)
            total += sum(len(tool.compress(raw[at : at + 1024])) for at in range(0, len(raw), 1024))
        return total

    for text, found, score, rejected in collected(
        language.identify_languages(docs, model), "text", "lang_pred", "score", "rejected"
    ):
        if text is None or not any(map(str.isalpha, text)):
            assert (found, score, rejected) == ("und", 0.0, True)
            continue
        for levels in ([9], [9, 1, 5, 12, 19]):
            (best, name), (second, _) = sorted((size(text, lang, levels), lang) for lang in expected)[:2]
            if 1 - best / second >= 0.001:
                break
        assert (found, rejected) == (name, 1 - best / second < 0.001) and score == pytest.approx(1 - best / second)
