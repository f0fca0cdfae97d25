"""Near-duplicate vectors, Jaccard join, components, and the pipeline."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from racelake.llm import jaccard, language, mixing, neighbours, pieces
from racelake.llm.components import connected_components
from racelake.llm.groups import roots
from corpus import collected, documents, sentence, words


def united(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)] + [(7, 7)]
    edges = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = dict(collected(connected_components(edges), "node", "component"))
    expected = united({x for p in pairs for x in p}, pairs)
    assert all(got.get(n, n) == c for n, c in expected.items())
    assert connected_components(edges.limit(0)).count() == 0


def test_roots():
    assert roots(6, (np.array([5, 3, 1]), np.array([3, 2, 0]))).tolist() == [0, 0, 2, 2, 4, 2]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("node_block, set_block", [(512, 256), (3, 2)])
def test_jaccard_groups(spark, node_block, set_block):
    docs = documents(spark)
    rows = collected(docs, "doc_id", "text")
    got = jaccard.jaccard_groups(docs, node_block=node_block, set_block=set_block)
    out = collected(got, "doc_id", "class_id", "n_links", "kept")
    assert len(out) == len(rows)
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links, pairs = Counter(), []
    for (x, (i, a)), (y, (j, b)) in combinations(enumerate(sets), 2):
        if a and b and len(a & b) >= 0.8 * len(a | b):
            links[x] += 1
            links[y] += 1
            pairs.append((i, j))
    expected = united({i for i, _ in sets}, pairs)
    want = sorted((i, expected[i], links[x], i == expected[i]) for x, (i, _) in enumerate(sets))
    assert sorted(o for o in out if o[0] is not None) == want
    assert [o for o in out if o[0] is None] == [(None, None, 0, True)]
    assert jaccard.jaccard_groups(docs.limit(0)).count() == 0


def audit_of(links, chance):
    """The counts expected of `links` links in every band, where one tree finds `chance(depth)` of them."""
    audit = np.zeros((jaccard.BANDS, jaccard.DEPTH, 4), np.int64)
    for depth in range(1, jaccard.DEPTH + 1):
        q, n = chance(depth), jaccard.TREES
        once, twice = n * q * (1 - q) ** (n - 1), n * (n - 1) / 2 * q**2 * (1 - q) ** (n - 2)
        audit[:, depth - 1] = [0, round(links * once), round(links * twice), round(links * (1 - (1 - q) ** n))]
    return audit


def test_depth_follows_the_recall_found():
    nothing = audit_of(0, lambda d: 0.5)
    assert jaccard.next_depth(nothing, 8, 0.8, 0.0) is None
    k = jaccard.next_depth(nothing, 8, 0.8, 0.999)
    assert jaccard.meeting_chance(0.8, k) >= 0.999 > jaccard.meeting_chance(0.8, k + 1)
    assert jaccard.next_depth(nothing, k, 0.8, 0.999) is None
    # Links that are found in every tree need no shorter prefix, links that are hardly found need one and end at 1.
    assert jaccard.next_depth(audit_of(10**6, lambda d: 0.9), 8, 0.8, 0.999) is None
    worse = audit_of(10**6, lambda d: 0.8**d)
    assert abs(jaccard.forest_recall(worse, 8, 0.8, 0.999) - jaccard.meeting_chance(0.8, 8)) < 0.01
    assert jaccard.next_depth(worse, 8, 0.8, 0.99) == 6
    assert jaccard.next_depth(audit_of(10**6, lambda d: 0.05), 8, 0.8, 0.999) == 1
    # Links that met nowhere but were verified with their group count as missed.
    unmet = audit_of(10**6, lambda d: 0.9)
    unmet[0, 7] = [5000, 0, 0, 10**6]
    assert jaccard.forest_recall(unmet, 8, 0.8, 0.999) < 0.996


def test_forest_is_descended_until_recall_is_met(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(400):
        w = sentence(rng, 104).split()
        texts += [" ".join(w), " ".join(w[:50] + ["odd"] + w[51:90] + ["odd"] + w[91:])]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = jaccard._sketch(5)
    classes = rows.mapInArrow(found, jaccard.SKETCH).selectExpr("row rep", "1L texts", "s1", "s2", "signature")
    classes.write.mode("overwrite").saveAsTable("forest_classes")
    try:
        links, passes = jaccard.forest_links(rows, spark.table("forest_classes"), target_recall=0.99)
        got = {tuple(sorted(r)) for r in collected(links.filter("a <> b"), "a", "b")}
        assert dict(collected(links.groupBy("links").count(), "links", "count")) == {1: 2 * len(got)}
    finally:
        spark.sql("drop table forest_classes")
    assert passes[0][0] == jaccard.DEPTH and len(passes) > 1
    assert all(recall < 0.99 for _, recall in passes[:-1]) and passes[-1][1] >= 0.99
    want = {(2 * k, 2 * k + 1) for k in range(400)}
    assert got <= want and len(got) >= 0.99 * len(want)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, label string, links int")


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [centre + 0.08 * rng.normal(size=16) for _ in range(int(rng.integers(1, 60)))]
    table = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    table += [(1000 + k, table[3][1]) for k in range(5)] + [(2000, [2.0 * x for x in table[3][1]])]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0, None] * 8), (3004, [math.nan] * 16), (3005, [math.inf] + [0.0] * 15), (3006, [1.0, 2.0])]
    got = collected(
        neighbours.near_duplicate_vectors(vectors(spark, [*table, *odd, (None, table[0][1])]), shards=3, beam=4, block_rows=64),
        "vec_id", "n_links", "component_id", "kept",
    )
    matrix = np.array([v for _, v in table])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    near = matrix @ matrix.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in table]
    component = united(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    want = sorted((i, int(near[k].sum()), component[i], i == component[i]) for k, i in enumerate(ids))
    assert sorted(g for g in got if g[0] is not None and g[0] < 3000) == want
    assert sorted(g for g in got if g[0] is not None and g[0] >= 3000) == [(i, 0, i, True) for i, _ in odd]
    assert [g for g in got if g[0] is None] == [(None, 0, None, True)]


def test_links_of_small_groups_are_audited_beside_a_large_one(spark):
    rng = np.random.default_rng(3)
    rows = [*rng.normal(size=(1500, 48))]
    rows += [rows[k] + 0.35 * rng.normal(size=48) for k in range(12)]
    centre = rng.normal(size=48)
    rows += [centre + 0.1 * rng.normal(size=48) for _ in range(200)]
    matrix = np.array(rows)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    near = matrix @ matrix.T >= 0.9
    np.fill_diagonal(near, False)
    component = united(range(len(rows)), list(zip(*np.nonzero(near), strict=True)))
    want = sorted((k, int(near[k].sum()), component[k]) for k in range(len(rows)))
    for some in (len(rows), 1512):
        table = vectors(spark, [(k, [float(x) for x in v]) for k, v in enumerate(rows[:some])])
        got = neighbours.near_duplicate_vectors(table, beam=1, block_rows=256)
        assert sorted(collected(got, "vec_id", "n_links", "component_id")) == want[:some]


def test_beams_are_widened_until_both_ends_are_found(spark):
    rng = np.random.default_rng(4)
    rows = [*rng.normal(size=(900, 48))]
    rows += [rows[k] + 0.2 * rng.normal(size=48) for k in range(600)]
    table = vectors(spark, [(k, [float(x) for x in v]) for k, v in enumerate(rows)])
    got = collected(neighbours.near_duplicate_vectors(table, beam=1, block_rows=256, audit_linked=20), "vec_id", "n_links")
    assert sum(n for _, n in got) >= 0.98 * 1200
    # A pair is found for both of its vectors or for none.
    assert all(dict(got)[k] == dict(got)[900 + k] for k in range(600))


@pytest.mark.parametrize("pairs", [0, 6, 700])
def test_graphs_answer_small_and_link_poor_tables(spark, monkeypatch, pairs):
    """Nothing but a bounded audit is searched exactly, and what the graphs found is the result."""
    rng = np.random.default_rng(5)
    rows = [*rng.normal(size=(1300, 32))]
    rows += [rows[k] + 0.3 * rng.normal(size=32) for k in range(pairs)]
    asked, query = [], neighbours._query

    def watched(blocks, graphs, shards, tasks, threshold, beam):
        asked.append((beam, sum(neighbours._table(b.nodes).num_rows for b in blocks.select("nodes").collect())))
        return query(blocks, graphs, shards, tasks, threshold, beam)

    monkeypatch.setattr(neighbours, "_query", watched)
    table = vectors(spark, [(k, [float(x) for x in v]) for k, v in enumerate(rows)])
    got = collected(neighbours.near_duplicate_vectors(table, audit_rows=60, audit_linked=60), "vec_id", "n_links", "recall")
    matrix = np.array(rows)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    near = matrix @ matrix.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(n for _, n, _ in got) >= 0.99 * near.sum()
    assert all(n <= near[k].sum() and r >= 0.99 for k, n, r in got)
    assert [n for beam, n in asked if beam] == [len(rows) + 60] * (len(asked) // 2)
    assert all(n <= 60 + 60 + 2 * 60 for beam, n in asked if not beam)


def test_probes_lie_within_the_threshold():
    probe = neighbours._turned(0.9)
    rng = np.random.default_rng(1)
    rows = [rng.normal(size=24) for _ in range(200)]
    frame = pd.DataFrame({"key": [f"{7 * k:016x}" for k in range(200)], "vector": [v.tobytes() for v in rows], "node": range(200)})
    (made,) = probe(iter([frame]))
    turned = np.array([np.frombuffer(v) for v in made["vector"]])
    cosine = np.einsum("nd,nd->n", turned, np.array(rows)) / np.linalg.norm(turned, axis=1) / np.linalg.norm(rows, axis=1)
    assert (cosine >= 0.9).all() and cosine.min() < 0.92 and made["node"].tolist() == [-1 - k for k in range(200)]


def test_vectors_of_an_empty_table(spark):
    assert neighbours.near_duplicate_vectors(vectors(spark, [])).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    base = sentence(rng, 60)
    line = "a line that every document of this corpus carries, word for word"
    rows = [(i, f"{sentence(rng, rng.randint(30, 60))}\n{line}", "en" if i % 2 else "fr", f"s{i % 3}") for i in range(40)]
    rows += [(50, base, "en", "s1"), (51, base + " more", "en", "s1"), (52, "123 456", "en", "s2"), (53, None, "en", "s2")]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "mixing", "pieces"]
    kept = stages["language"](spark, docs, "")
    assert {r[0] for r in collected(kept, "doc_id")} >= set(range(40)) and not {52, 53} & {r[0] for r in collected(kept, "doc_id")}
    cleaned = stages["lines"](spark, docs, "")
    held = [i for i, t in collected(cleaned, "doc_id", "text") if t and line in t]
    assert held == [39] and cleaned.count() == len(rows) and cleaned.columns == docs.columns
    apart = {r[0] for r in collected(stages["near_duplicates"](spark, docs, ""), "doc_id")}
    assert apart == {r[0] for r in rows} - {51}
    mixed = stages["mixing"](spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert set(stages["pieces"](spark, docs, "").columns) == {*docs.columns, "ids", "n_pieces"}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in collected(whole, "doc_id")} <= apart - {52, 53}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def chain_by_hand(rows, model, codec):
    """The stages but mixing, one after the other, on (doc_id, text, source): those columns and the piece ids."""
    rows = [r for r in rows if not model.predict(r[1])[2]]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    held = defaultdict(set)
    for i, text, _ in rows:
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    gone = lambda i, line: len(held[key(line)]) >= 5 and max(held[key(line)]) != i
    rows = [(i, "\n".join(x for x in t.split("\n") if not gone(i, x)), s) for i, t, s in rows]
    sets = [(i, shingles(t)) for i, t, _ in rows]
    pairs = [(i, j) for (i, a), (j, b) in combinations(sets, 2) if a and b and len(a & b) >= 0.8 * len(a | b)]
    smallest = united({i for i, _ in sets}, pairs)
    rows = [r for r in rows if smallest[r[0]] == r[0]]
    return [(i, t, s, codec.encode(t)) for i, t, s in rows]


def test_pipeline_equals_a_chain_by_hand(spark, tmp_path):
    rng = random.Random(13)
    line = "a line that every document of this corpus carries, word for word"
    rows = [(i, f"{sentence(rng, rng.randint(30, 60))}\n{line}", "en" if i % 2 else "fr", f"s{i % 3}") for i in range(40)]
    base = sentence(rng, 60)
    rows += [(50, base, "en", "s1"), (51, base + " more", "en", "s1"), (52, "123 456", "en", "s2"), (53, None, "en", "s2")]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    before = chain_by_hand([(i, t, s) for i, t, _, s in rows], language.fit(docs), library)
    # Copies come from the plan for the rows that the chain by hand leaves, which has tests of its own.
    left = documents(spark, [(i, t, None, s) for i, t, s, _ in before])
    copies = dict(collected(mixing.plan_mix(left), "id", "copies"))
    want = Counter()
    for i, text, source, ids in before:
        want[i, text, source, tuple(ids), len(ids)] += copies[i]
    got = corpus_pipeline.run(spark, str(tmp_path))
    found = Counter((i, t, s, tuple(ids), n) for i, t, s, ids, n in collected(got, "doc_id", "text", "source", "ids", "n_pieces"))
    assert found == +want and len(found) > 20
