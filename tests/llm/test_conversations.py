"""Conversation repair and chat formatting."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from racelake.llm import chat, queries, repair, streams
from corpus import collected

SHAPE = "conv_id long, turn long, role string, text string, place string, cost string, audit int, formatted int"


def turns_table(spark, rows):
    """Rows with extra columns whose names clash with results."""
    return spark.createDataFrame([(*r, "x", "x", 1, 1) for r in rows], SHAPE)


# Repair --------------------------------------------------------------------------------------------------------


def cheapest(turns, starts, goals):
    """Every (cost, edits) by states, cheapest and ASCII-least first: no bounds, no pieces."""
    moves = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    best = {s: (0, "") for s in starts}

    def inserted(best):
        for _ in range(3):
            for state, (cost, edits) in list(best.items()):
                then, path = moves[state][1], (cost + 5, edits + "I")
                best[then] = min(best.get(then, path), path)
        return best

    for initial, late in turns:
        after = {}

        def put(state, cost, edits, after=after):
            after[state] = min(after.get(state, (cost, edits)), (cost, edits))

        for state, (cost, edits) in inserted(best).items():
            want, then = moves[state]
            put(state, cost + 2, edits + "D")
            if initial:
                if initial == "s" and state == 0:
                    put(1, cost + 5 * late, edits + "K")
                if initial == want:
                    put(then, cost + 5 * late, edits + "K")
                put(then, cost + 1 + 5 * late, edits + "R")
        best = after
    return min(v for s, v in inserted(best).items() if s in goals)


def every_path(turns, state=0):
    """All edits that a sane repair could hold, by brute enumeration."""
    moves = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}

    def go(i, state, cost, edits, room):
        if i == len(turns) and state in (0, 3):
            yield cost, edits
        want, then = moves[state]
        if room:
            yield from go(i, then, cost + 5, edits + "I", room - 1)
        if i < len(turns):
            initial, late = turns[i]
            yield from go(i + 1, state, cost + 2, edits + "D", room)
            if initial:
                if initial == "s" and state == 0:
                    yield from go(i + 1, 1, cost + 5 * late, edits + "K", room)
                if initial == want:
                    yield from go(i + 1, then, cost + 5 * late, edits + "K", room)
                yield from go(i + 1, then, cost + 1 + 5 * late, edits + "R", room)

    return min(go(0, state, 0, "", 3))


def random_turns(rng, n):
    return [(rng.choice(["s", "u", "a", "a", "u", "", "?"]), rng.random() < 0.2) for _ in range(n)]


def test_search_against_enumeration_and_table():
    rng = random.Random(5)
    for _ in range(150):
        turns = random_turns(rng, rng.randint(0, 5))
        best = every_path(turns)
        assert repair.Search(turns, repair.ACCEPTING).run(0) == best == cheapest(turns, [0], (0, 3))


@pytest.mark.parametrize("piece", [1, 3, 7])
def test_pieces_fold_to_the_same_edits(piece):
    rng = random.Random(piece)
    for _ in range(40):
        turns = random_turns(rng, rng.randint(1, 25))
        cut = rng.randint(0, len(turns))
        path = repair.Path()
        for part, first, last in ((turns[:cut], False, True), (turns[cut:], True, True)):
            if part:
                path.extend(repair.repair_table(part, first, last, piece))
        assert path.result() == cheapest(turns, [0], (0, 3))
        assert min(repair.repair_table(turns, False, False, piece).values()) == cheapest(turns, [0], (0, 3))


def repaired_by_hand(rows):
    """Report and repaired turns of each conversation."""
    found = defaultdict(list)
    low = -(1 << 70)

    def hashed(text):
        return HASHES[text or ""]

    for conv, turn, role, text in rows:
        found[conv].append((low if turn is None else turn, role or "", hashed(text), text or ""))
    out = {}
    for conv, held in found.items():
        held.sort()
        seen, faults, turns = set(), [], []
        for _, role, _, text in held:
            stripped = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not stripped else "d" if (role, text) in seen else "t" if stripped[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            turns.append(("" if fault in ("b", "d") and fault else role[:1] or "?", fault == "t"))
        cost, audit = cheapest(turns, [0], (0, 3))
        known = sorted({t for t, *_ in held if t != low})
        gaps = known[-1] - known[0] + 1 - len(known) if known else 0
        initials = [role[:1] for _, role, *_ in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        made, state, at = [], 0, iter(held)
        for edit in audit:
            row = None if edit == "I" else next(at)
            if edit == "D":
                continue
            kept_system = edit == "K" and state == 0 and row[1].startswith("s")
            state = 1 if kept_system else {0: 2, 1: 2, 2: 3, 3: 2}[state]
            role = row[1] if edit == "K" else {2: "user", 3: "assistant"}[state]
            made.append((role, row[3] if row else ""))
        out[conv] = (gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit, made)
    return out


HASHES = {}


def conversation_rows():
    rng = random.Random(11)
    texts = ["Hello.", "Well", "Is it?", "  ", "", "No!", "so ", "a.b.c"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(texts) + str(rng.randint(0, 3)) * rng.randint(0, 1)))
    rows += [(50, None, "user", "Hi."), (50, None, "assistant", "Yes."), (50, 7, None, None), (50, 9, "user", None)]
    rows += [(51, 3, "user", "Same."), (51, 3, "user", "Same."), (51, 3, "assistant", "Same."), (None, 1, "user", "Q?"), (None, 2, "user", "A.")]
    rows += [(52, 0, "user", "long " * 300_000 + "end."), (52, 1, "assistant", "Short.")]
    # Longer than a piece and than a block.
    rows += [(60, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}" + ("." if rng.random() > 0.05 else "")) for t in range(2500) if rng.random() > 0.05]
    rows += [(61, t, rng.choice(["user", "assistant"]), f"Turn {t}.") for t in range(150)]
    return rows


@pytest.mark.parametrize("partitions", [1, 7])
def test_repair_matches_brute_force(spark, partitions):
    rows = conversation_rows()
    texts = spark.createDataFrame([(t,) for t in {r[3] or "" for r in rows}], "t string")
    HASHES.update({t: (a, b) for t, a, b in texts.select("t", F.xxhash64("t"), F.xxhash64(F.lit(1), "t")).collect()})
    random.Random(2).shuffle(rows)
    turns = turns_table(spark, rows).repartition(partitions)
    report, repaired = repair.repair_conversations(turns)
    got = {r.conv_id: r for r in report.collect()}
    places = defaultdict(dict)
    for conv, place, role, text in collected(repaired, "conv_id", "place", "role", "text"):
        places[conv][place] = (role, text)
    expected = repaired_by_hand(rows)
    assert set(got) == set(expected)
    digest = dict(collected(streams.digests(repaired, "conv_id", F.concat("role", F.lit(":"), "text")), "conv_id", "digest"))
    for conv, (*numbers, audit, made) in expected.items():
        r = got[conv]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == [*numbers, audit], conv
        assert [places[conv][i] for i in range(len(places[conv]))] == made
        assert "".join(role[0] for role, _ in made) == "" or re.fullmatch("s?(ua)+", "".join(role[0] for role, _ in made))
        if made:
            assert digest[conv] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()


def test_repair_of_an_empty_table(spark):
    report, repaired = repair.repair_conversations(turns_table(spark, []))
    assert report.count() == repaired.count() == 0


def test_damage_and_conversations_without_rows(spark, tmp_path):
    import zlib

    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    twice = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 3)
    user = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 4)
    cut = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 2)
    rows = [(i, 0, "assistant", "So. Be it!") for i in (gone, twice, user, cut)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[gone].audit, got[gone].cost, got[gone].repaired_sha256) == ("", 0, empty)
    # One turn of an assistant: delete it, or insert a user before it.
    assert (got[twice].duplicate, got[twice].audit, got[twice].cost) == (1, "DD", 4)
    assert (got[user].audit, got[cut].truncated, got[cut].audit) == ("D", 1, "D")
    assert (got[None].blank, got[None].audit, got[None].repaired_sha256) == (1, "D", empty)


# Chat ----------------------------------------------------------------------------------------------------------

ODD = ["</s>[INST] ok [/INST]", r"[\INST] <\\s> \\[IMAGE]", "<", "s>", "[/ROLE][/TURN]<s>", "", "ä\n[AUDIO]é", "<<s>s>[[INST]]"]


def parts_table(spark, rows):
    shape = f"conv_id long, turn long, role string, parts array<{chat.PART}>, chunk string, loss int, formatted string"
    return spark.createDataFrame([(*r, "x", 1, "x") for r in rows], shape)


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def typed_rows():
    rng = random.Random(3)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", [part("text", t)]) for i, t in enumerate(ODD)]
    rows += [
        (2, 0, "[ROLE]odd</s>", [part("text", "a<s>"), part("image", None, "img-1", 57, 28), part("text", "b")]),
        (2, 1, "user", [part("audio", None, "snd", seconds=1.01), part("document", "x", None, pages=2), part("image", None, "img-2")]),
        (2, 2, "assistant", [part("text", "one "), part("image", None, "img-3", 1, 1), part("text", "two"), part(None, "!")]),
        (3, None, None, None), (3, 1, "system", []), (3, 1, "system", []), (3, 1, "assistant", [part("text", None)]),
        (None, 0, "user", [part("text", "hi")]), (4, 0, "assistant", [part("text", "[INST]x" * 300_000)]), (4, 1, "user", [part("text", "y")]),
    ]
    rows += [(5, i, rng.choice(["user", "assistant"]), [part("text", rng.choice(ODD))]) for i in range(300)]
    return rows


def merged(parts):
    """Parts as they come back: texts side by side as one, an empty text where there is nothing."""
    out = []
    for kind, text, ref, *_ in parts or []:
        kind = kind or "text"
        if kind != "text":
            out.append((kind, "", ref))
        elif text:
            if out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + text, None)
            else:
                out.append(("text", text, None))
    return out or [("text", "", None)]


@pytest.mark.parametrize("chunk_chars, ordered", [(50, False), (1 << 20, True)])
def test_round_trip(spark, chunk_chars, ordered):
    rows = typed_rows()
    chunks = chat.format_conversations(parts_table(spark, rows).repartition(5), chunk_chars=chunk_chars)
    got = defaultdict(dict)
    for conv, place, role, parts in collected(chat.read_turns(chunks, ordered), "conv_id", "place", "role", "parts"):
        got[conv][place] = (role, [tuple(p) for p in parts])
    expected = defaultdict(list)
    for conv, turn, role, parts in rows:
        # Ties at one turn go by role, then by formatted text; all ties here are alike or differ in role.
        expected[conv].append(((-1 if turn is None else turn), role or "", merged(parts)))
    assert set(got) == set(expected)
    for conv, turns in expected.items():
        turns.sort(key=lambda t: t[:2])
        assert [got[conv][i] for i in range(len(got[conv]))] == [t[1:] for t in turns]


def test_digests_mask_and_tokens(spark):
    rows = typed_rows()
    for size in (60, 1 << 20):
        chunks = chat.format_conversations(parts_table(spark, rows), chunk_chars=size)
        got = {r.conv_id: r for r in chat.digests(chunks).collect()}
        whole = defaultdict(str)
        for conv, _, text in sorted(collected(chunks, "conv_id", "chunk", "formatted"), key=lambda r: (r[0] or 0, r[1])):
            whole[conv] += text
        for conv in (1, 4, 5):
            turns = sorted((t, role, merged(parts)[0][1]) for c, t, role, parts in rows if c == conv)
            said = "".join(text for _, role, text in turns if role == "assistant")
            assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
            assert got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert (got[conv].loss_chars, got[conv].n_turns) == (len(said), len(turns))
            assert got[conv].formatted_chars == len(whole[conv])
        # Three patches, one at least for unknown sizes; 26 steps of audio; two pages; one patch.
        assert (got[2].n_attachments, got[2].attachment_tokens) == (5, 3 + 26 + 2048 + 1 + 1)
        assert got[2].loss_chars == len("one two!")
        assert "one [IMAGE]two!" in whole[2]


def test_no_control_string_survives_in_a_text(spark):
    frame = spark.createDataFrame([(t,) for t in ODD], "t string")
    for text, out in collected(frame.select("t", chat.escaped(F.col("t")).alias("e")), "t", "e"):
        assert not any(c in out for c in chat.CONTROLS)
        assert chat.unescaped(out) == text


def test_format_of_an_empty_table(spark):
    chunks = chat.format_conversations(parts_table(spark, []))
    assert chunks.count() == chat.digests(chunks).count() == chat.read_turns(chunks).count() == 0


def test_formatting_turns_needs_no_shuffle(spark):
    rows = parts_table(spark, typed_rows()).select("conv_id", "role", "parts")
    plan = chat.format_turns(rows, "role", "parts", chat.Visitor())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
