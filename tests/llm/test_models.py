"""Mixing, language model, pieces, toxicity."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from racelake.llm import interpolation, mixing, pieces, toxicity
from corpus import collected, documents, sentence, words


def test_targets_stop_at_the_cap():
    assert mixing.source_targets([100, 100, 100], [1, 2, 3], 3.0) == pytest.approx([50, 100, 150])
    assert mixing.source_targets([10, 1000, 10], [1, 1, 3], 3.0) == pytest.approx([30, 960, 30])
    assert mixing.source_targets([0, 5], [1, 1], 3.0) == pytest.approx([0, 5])
    assert mixing.source_targets([], [], 3.0) == []


def test_plan_meets_targets_and_repeats(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(1, 60)), "en", rng.choice(["a", "b", "Z", None])) for i in range(400)]
    docs = documents(spark, [*rows, (500, None, None, "only-empty"), rows[3], (None, "x y", "en", "a")])
    plan = mixing.plan_mix(docs)
    again = sorted(collected(mixing.plan_mix(docs.repartition(7)), "id", "source", "copies", "positions"), key=repr)
    assert sorted(collected(plan, "id", "source", "copies", "positions"), key=repr) == again
    size, taken, target = Counter(), Counter(), {}
    for source, n, rows_, copies, total, goal, at in collected(
        plan, "source", "size", "n_rows", "copies", "source_size", "target", "positions"
    ):
        size[source] += n * rows_
        taken[source] += n * rows_ * copies
        target[source] = (goal, total)
        assert copies <= 3 and len(at) == copies and all(0 <= t <= 1 for t in at) and (n or not copies)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goals = mixing.source_targets([size[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))], 3.0)
    for name, goal in zip(names, goals, strict=True):
        assert target[name] == (pytest.approx(goal), size[name])
        assert abs(taken[name] - goal) <= 10


def test_mix_returns_rows_in_order_of_their_schedule(spark):
    rng = random.Random(6)
    docs = documents(spark, [(i, sentence(rng, 20), "en", "early" if i % 2 else "late") for i in range(200)])
    mixed = mixing.mix(docs, weights=(1, 1), schedules=((1.0, 0.0), (0.0, 1.0)))
    assert mixed.columns == docs.columns
    order = [r["source"] for r in mixed.collect()]
    assert len(order) == 200
    assert order[:50].count("early") > 40 and order[-50:].count("late") > 40
    assert mixing.mix(docs.limit(0)).count() == 0


def test_inverse_demand_is_the_inverse(spark):
    schedule = [1.5, 0.0, 0.5]
    sums = mixing._cumulative(schedule)
    frame = spark.range(0, 101).select((F.col("id") / 100).alias("u")).withColumns(
        {"weight": F.array(*map(F.lit, schedule)), "demand": F.array(*map(F.lit, sums))}
    )

    def demand(t: float) -> float:
        k = min(int(t * 2), 1)
        x, (a, b) = t - k / 2, schedule[k : k + 2]
        return sums[k] + a * x + (b - a) * x * x

    for u, t in collected(frame.withColumn("t", mixing.inverse_demand(F.col("u"), 3)), "u", "t"):
        assert demand(t) == pytest.approx(u * sums[-1], abs=1e-9)


def lm_by_hand(rows, train, tune, iterations):
    """The same model with dictionaries; returns (tokens, known, base, score) by row."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [["<s>", *words((t or "").translate(fold)), "</s>"] for _, t in rows]

    def counts(which):
        one, two = Counter(), Counter()
        for text, use in zip(texts, which, strict=True):
            if use:
                one.update(text[1:])
                two.update(zip(text, text[1:], strict=False))
        one["<s>"] = one["</s>"]
        return one, two, sum(v for k, v in one.items() if k != "<s>")

    everything, main = counts(train), counts([a and not b for a, b in zip(train, tune, strict=True)])
    vocabulary = len([k for k, v in everything[0].items() if v and k != "<s>"])

    def estimates(model, a, b):
        one, two, total = model
        context = one[a]
        return int(math.log2(context)) + 1 if context else 0, np.array(
            [1 / (vocabulary + 1), one[b] / max(total, 1), two[a, b] / max(context, 1)]
        )

    weights = np.full((65, 3), 1 / 3)
    for _ in range(iterations if main[2] else 0):
        sums = np.zeros((65, 3))
        for text, use in zip(texts, tune, strict=True):
            for a, b in zip(text, text[1:], strict=False) if use else ():
                k, parts = estimates(main, a, b)
                sums[k] += parts * weights[k] / (parts * weights[k]).sum()
        if not sums.sum():
            break
        sums[sums.sum(axis=1) == 0] = sums.sum(axis=0)
        weights = sums / sums.sum(axis=1, keepdims=True)
    else:
        weights = np.round(weights, 6) + 1e-6
        weights /= weights.sum(axis=1, keepdims=True)
    out = []
    for text in texts:
        score = base = 0.0
        for a, b in zip(text, text[1:], strict=False):
            k, parts = estimates(everything, a, b)
            score += math.log10((parts * weights[k]).sum())
            base += math.log10((everything[0][b] + 1) / (everything[2] + vocabulary + 1))
        out.append((len(text) - 1, sum(everything[0][b] > 0 for b in text[1:]), base, score))
    return out


def test_language_model_matches_dictionaries(spark):
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(collected(docs, "doc_id", "text"))
    train, tune = [i % 5 != 2 for i, _ in rows], [i % 5 == 3 for i, _ in rows]
    got = interpolation.score_texts(docs, F.col("doc_id") % 5 != 2, F.col("doc_id") % 5 == 3, iterations=4)
    found = sorted(collected(got, "doc_id", "n_tokens", "n_known", "base_score", "score"))
    for mine, expected in zip(found, lm_by_hand(rows, train, tune, 4), strict=True):
        assert mine[1:3] == expected[:2]
        assert mine[3:] == pytest.approx(expected[2:], rel=1e-5)


def test_language_model_without_training_rows_and_rows(spark):
    docs = documents(spark)
    got = collected(interpolation.score_texts(docs, F.lit(False), F.lit(True)), "n_known", "train_tokens", "score")
    # Nothing to train on: one over the size of an empty vocabulary and one for every token.
    assert len(got) == docs.count() and {g[:2] for g in got} == {(0, 0)}
    assert all(abs(g[2]) < 1e-9 for g in got)
    assert interpolation.score_texts(docs.limit(0), F.lit(True), F.lit(True)).count() == 0


def test_ids_are_decoded_list_by_list():
    """Lists of a slice are decoded together: null, empty and sliced ones, and bytes that are no text alone."""
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    codec = pieces.Pieces(library.serialized_model_proto())
    texts = ["zero", "a b  c", "", " lead", "naïve \u4e16\n\ttab", "hello hello"]
    ids = [None, *[library.encode(t) for t in texts], [codec.bytes[0xE4]]]
    lists = pa.array(ids, pa.list_(pa.int32()))
    assert codec.decode(lists) == [None, *texts, "\ufffd"] and codec.decode(lists.slice(2, 3)) == texts[1:4]
    assert codec.decode(lists.slice(0, 0)) == []
    with pytest.raises(ValueError, match="null"):
        codec.decode(pa.array([[1, None]], pa.list_(pa.int32())))


def test_pieces_equal_the_library_and_round_trip(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = documents(spark).unionByName(spark.createDataFrame(
        [(i, t, "en", "s", 0, "x", 1, "y") for i, t in enumerate(["  two  spaces ", "tab\tnew\n\nline", "日本語 ok", "naïve café!!", "a" * 300])],
        documents(spark).schema,
    ))
    encoded = pieces.encode_texts(docs)
    assert encoded.columns == [*docs.columns, "ids"]
    for text, ids in collected(encoded, "text", "ids"):
        assert ids == (None if text is None else library.encode(text))
    for text, decoded in collected(pieces.decode_pieces(encoded), "text", "decoded"):
        assert decoded == (None if text is None else text.replace("▁", " "))
    assert pieces.encode_texts(docs.limit(0)).count() == 0


def test_a_unigram_model_takes_the_best_path():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type = 1
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix = "identity", True
    model.normalizer_spec.remove_extra_whitespaces = False
    for piece, score, kind in [("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2, 1), ("ab", -2.5, 1), ("▁a", -2.2, 1), ("▁ab", -6, 1)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    codec = pieces.Pieces(model.SerializeToString())
    ids = [np.frombuffer(x, "<i4").tolist() for x in codec.encode(["ab", "abab a", "c"])]
    assert ids == [[5, 3], [5, 3, 4, 5], [1, 0]]


def test_toxicity_chain(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 40) + (" Nasty!" if i % 4 == 0 else "") + (" spam" if i % 3 == 0 else ""), "en", "s") for i in range(300)]
    docs = documents(spark, [*rows, (900, None, None, None), (901, "", "en", "s"), (None, "nasty", "en", "s"), rows[0]])
    labels = spark.createDataFrame(
        [(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(0, 200)] + [(None, 1, 1), (7, None, None), (5000, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    chain = toxicity.fit_chain(docs, labels)
    assert [link.before for link in chain.models] == [[], ["p_quality"]]
    scored = chain.score(docs.withColumn("p_toxic", F.lit("clash")))
    assert scored.count() == docs.count()
    held = [(i, p) for i, p in collected(scored, "doc_id", "p_toxic") if i is not None and 200 <= i < 300]
    assert all((p >= 0.5) == (i % 4 == 0) for i, p in held)
    assert chain.score(docs.limit(0)).count() == 0


def test_toxicity_without_labels(spark):
    docs = documents(spark)
    chain = toxicity.fit_chain(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert set(collected(chain.score(docs), "p_toxic")) == {(0.0,)}
