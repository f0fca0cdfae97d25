"""A bigram language model with deleted interpolation.

Maximum-likelihood estimates of order two, one and zero are mixed with weights that depend on how often the
context was seen. The weights are learned by expectation-maximisation on a part of the training texts that is
deleted from the counts for that purpose; scores use the counts of all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from racelake.llm.chunks import chunk_rows, indexed, key_sums, pack, unpack, with_sums
from racelake.llm.words import mix, row_slices, words_of
from racelake.sources.scratch import stable

# Stand for the end of a text and for the place before its first word.
_END, _START = np.uint64(0x9D5C_11C8_4E1A_7B02), np.uint64(0x51E3_6A0F_B2C9_4D77)
_FACTOR = np.uint64(0x9E37_79B9_7F4A_7C15)
_ONE = np.uint64(1)
CLASSES = 65
#: Text that is hashed at once; several numbers are held for each of its bytes meanwhile.
SLICE_BYTES = 1 << 18
RESOLVED = "chunk bigint, rows binary, counts binary, tuning binary"


def context_class(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the binary logarithm of its count."""
    return np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, rows one after the other, and each row's first token; every row ends with the end."""
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for start, end in row_slices(texts, SLICE_BYTES):
        words = words_of(texts.slice(start, end - start))
        hashes.append(words.hashes(lower=True))
        sizes.append(words.per_row())
    per_row = np.concatenate(sizes)
    first = np.concatenate([[0], np.cumsum(per_row + 1)])
    tokens = np.full(int(first[-1]), _END, np.uint64)
    is_word = np.ones(len(tokens), bool)
    is_word[first[1:] - 1] = False
    tokens[is_word] = np.concatenate(hashes)
    return tokens, first


def _keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of every token's word and pair (even and odd), and the row offsets."""
    tokens, first = _tokens(texts)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = _START
    return tokens & ~_ONE, mix(before * _FACTOR + tokens) | _ONE, first


def _text_column(table: pa.Table) -> pa.Array:
    return table.column("text").combine_chunks()


def _contexts(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each token's context was followed by anything: a word as often as it was seen, the place before
    the first word as often as the end."""
    found = np.empty_like(words)
    found[1:] = words[:-1]
    found[first[:-1]] = words[first[1:] - 1]
    return found


def score_texts(
    docs: DataFrame, train: Column, tune: Column, id_col: str = "doc_id", text: str = "text", iterations: int = 12
) -> DataFrame:
    """One row for each row of `docs`: id, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`.

    `train` says which rows are learned from; those of them with `tune` set the mixture weights (null is false).
    Tokens are words with A-Z lower-cased, and one end for each text. A null or empty text is one end. Repeated
    rows are learned from as often as they stand there. With nothing to train on, every probability is one over
    the size of the vocabulary and one. Scores are log10. Words and pairs are told apart by 64-bit hashes. Other
    columns are not looked at.
    """
    picked = docs.select(
        F.col(id_col).alias("id"),
        F.col(text).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
        (F.coalesce(train, F.lit(False)) & F.coalesce(tune, F.lit(False))).alias("tune"),
    )
    chunks = chunk_rows(picked, "text")

    def flags(table: pa.Table, first: np.ndarray) -> np.ndarray:
        """Counts of each token: in training, and in the deleted part."""
        rows = np.stack([table.column(c).to_numpy().astype(np.int32) for c in ("train", "tune")], axis=1)
        return np.repeat(rows, np.diff(first), axis=0)

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        words, pairs, first = _keys(_text_column(table))
        keys, at = indexed(np.concatenate([words, pairs]))
        columns = flags(table, first).T
        counts = [np.bincount(at, np.concatenate([c, c]), len(keys)) for c in columns]
        return keys, np.stack(counts, axis=1).astype(np.int64)

    def facts(keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
        words = sums[(keys & _ONE) == 0]
        return np.array([(words[:, 0] > 0).sum(), *words.sum(axis=0)], np.int64)

    def resolve(table: pa.Table, sums: np.ndarray) -> pa.Table:
        words, pairs, first = _keys(_text_column(table))
        n = len(words)
        keys = np.concatenate([words, pairs])
        del words, pairs
        at = indexed(keys)[1]
        del keys
        learned, left_out = (np.ascontiguousarray(c) for c in sums.reshape(-1, 2).astype(np.int64).T)
        one, two = learned[at[:n]], learned[at[n:]]
        tuned = np.flatnonzero(flags(table, first)[:, 1])
        main = one - left_out[at[:n]]
        deleted = _histogram(main[tuned], (two - left_out[at[n:]])[tuned], _contexts(main, first)[tuned])
        rows = pa.table({"id": table.column("id"), "n_tokens": pa.array(np.diff(first))})
        return pa.table(
            {
                "chunk": pa.array([0], pa.int64()),
                "rows": pa.array([pack(rows)], pa.binary()),
                "counts": pa.array([pack(pa.table({"one": one, "two": two}))], pa.binary()),
                "tuning": pa.array([pack(deleted)], pa.binary()),
            }
        )

    # Stored, as every later step reads the sums; so are the counts found for each token.
    replies = stable(key_sums(chunks, keys_of, 2, lambda sums: sums.astype("<u8"), facts))
    vocabulary, total, deleted = _facts(replies)
    resolved = stable(with_sums(chunks, replies, "<u8", resolve, RESOLVED))
    weights = learn_weights(resolved, vocabulary, total - deleted, iterations)

    shape = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)])
    for name in ("n_tokens", "n_known", "train_tokens"):
        shape.add(name, T.LongType())
    for name in ("base_score", "score"):
        shape.add(name, T.DoubleType())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, counts = unpack(rows), unpack(counts)
                one, two = counts.column("one").to_numpy(), counts.column("two").to_numpy()
                first = np.concatenate([[0], np.cumsum(rows.column("n_tokens").to_numpy())])
                context = _contexts(one, first)
                parts = _estimates(one, two, context, vocabulary, total)
                mixed = (parts * weights[context_class(context)]).sum(axis=1)
                base = np.log10((one + 1) / (total + vocabulary + 1))
                yield pa.record_batch(
                    [
                        rows.column("id").combine_chunks(),
                        pa.array(np.diff(first)),
                        pa.array(np.add.reduceat((one > 0).astype(np.int64), first[:-1])),
                        pa.array(np.full(rows.num_rows, total, np.int64)),
                        pa.array(np.add.reduceat(base, first[:-1])),
                        pa.array(np.add.reduceat(np.log10(mixed), first[:-1])),
                    ],
                    names=shape.names,
                )

    return resolved.select("rows", "counts").mapInArrow(score, shape)


def _histogram(one: np.ndarray, two: np.ndarray, context: np.ndarray) -> pa.Table:
    """Each different (one, two, context) with how often (`n`) it is there: steps of the expectation need no more."""
    order = np.lexsort((one, two, context))
    columns = {"one": one[order], "two": two[order], "context": context[order]}
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns.values()], axis=0)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(order)))
    return pa.table({**{name: c[first] for name, c in columns.items()}, "n": counts})


def _facts(replies: DataFrame) -> tuple[int, int, int]:
    """Distinct words in training, tokens in training, tokens in the deleted part: one row for each bucket."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, np.int64) for x in batch.column("counts").to_pylist()]
            yield pa.record_batch({n: pa.array([int(r[i]) for r in rows], pa.int64()) for i, n in enumerate("abc")})

    found = replies.filter(F.col("chunk") == -1).select("counts").mapInArrow(numbers, "a bigint, b bigint, c bigint")
    return tuple(x or 0 for x in found.agg(F.sum("a"), F.sum("b"), F.sum("c")).first())


def _estimates(one: np.ndarray, two: np.ndarray, context: np.ndarray, vocabulary: int, total: int) -> np.ndarray:
    """Uniform, word and pair estimates of each token."""
    flat = np.full(len(one), 1.0 / (vocabulary + 1))
    return np.stack([flat, one / max(total, 1), two / np.maximum(context, 1)], axis=1)


def learn_weights(resolved: DataFrame, vocabulary: int, total: int, iterations: int) -> np.ndarray:
    """Mixture weights for each context class, `CLASSES` rows of three.

    Each step reads the deleted part's counts where they lie and brings three numbers for each class to the driver.
    A class without deleted tokens gets the weights of all together.
    """
    if not total:
        return np.tile([1.0, 0.0, 0.0], (CLASSES, 1))
    weights = np.full((CLASSES, 3), 1 / 3)
    for _ in range(iterations):
        now = weights

        def expected(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((CLASSES, 3))
            for batch in batches:
                for payload in batch.column(0).to_pylist():
                    one, two, context, n = (c.to_numpy() for c in unpack(payload).columns)
                    kind = context_class(context)
                    shares = _estimates(one, two, context, vocabulary, total) * now[kind]
                    shares *= (n / np.maximum(shares.sum(axis=1), 1e-300))[:, None]
                    for i in range(3):
                        sums[:, i] += np.bincount(kind, shares[:, i], CLASSES)
            used = np.flatnonzero(sums.sum(axis=1))
            columns = {n: pa.array(sums[used, i]) for i, n in enumerate("abc")}
            yield pa.record_batch({"class": pa.array(used, pa.int64()), **columns})

        each = resolved.select("tuning").mapInArrow(expected, "class bigint, a double, b double, c double")
        rows = each.groupBy("class").agg(F.sum("a"), F.sum("b"), F.sum("c")).orderBy("class").collect()
        sums = np.zeros((CLASSES, 3))
        for row in rows:
            sums[row[0]] = row[1:]
        pooled = sums.sum(axis=0)
        if not pooled.sum():
            return weights
        sums[sums.sum(axis=1) == 0] = pooled
        weights = sums / sums.sum(axis=1, keepdims=True)
    # Rounded, so that the order in which tasks were summed does not show; no weight is zero.
    weights = np.round(weights, 6) + 1e-6
    return weights / weights.sum(axis=1, keepdims=True)
