"""Removal of word sequences that stand elsewhere too, by Rabin-Karp hashes of all windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from racelake.llm.chunks import chunk_rows, combine, key_sums, with_sums
from racelake.llm.words import Words, row_slices, windows, words_of

WINDOW = 35


def _window_hashes(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, list[Words]]:
    """All windows of a text column: index of the first word (counted over the column), hash; and the words."""
    at, hashes, pieces, before = [], [], [], 0
    for start, end in row_slices(column):
        words = words_of(column.slice(start, end - start))
        first, found = windows(words.hashes(), words.first_of_row(), size)
        at.append(first + before)
        hashes.append(found)
        pieces.append(words)
        before += len(words)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    return np.concatenate(at), np.concatenate(hashes), pieces


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row for each row of `docs`: id, `n_words`, `n_removed`, `spans` (removed intervals of words, maximal,
    end excluded) and `text`, the words that stay joined by one space.

    A window of `size` words is repeated if its sequence also starts anywhere else, in the same row or another;
    all its words go. Windows are judged on the input. Rows with equal texts repeat each other, whatever their
    ids, so all of them lose their long enough texts. Null and empty texts have no words; texts below `size`
    words have no window and stay. Other columns are not looked at. An empty table gives an empty one. Windows
    are equal if their 64-bit hashes are.
    """
    kind = docs.schema[id_col].dataType
    shape = T.StructType(
        [
            T.StructField(id_col, kind),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end")]))),
            T.StructField(text, T.StringType()),
        ]
    )
    chunks = chunk_rows(docs.select(id_col, text), text)

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, hashes, _ = _window_hashes(_one(table, text), size)
        keys, counts = combine(hashes, np.ones((len(hashes), 1), np.int64))
        return keys, np.minimum(counts, 2)

    def result(table: pa.Table, repeated: np.ndarray) -> pa.Table:
        at, hashes, pieces = _window_hashes(_one(table, text), size)
        keys = np.unique(hashes)
        starts = at[repeated.astype(bool)[np.searchsorted(keys, hashes)]] if len(keys) else at
        total = sum(map(len, pieces))
        change = np.zeros(total + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + size, -1)
        gone = np.cumsum(change[:-1]) > 0
        n_words, n_removed, spans, kept, before = [], [], [], [], 0
        for words in pieces:
            edges = words.first_of_row()
            mask = gone[before : before + len(words)]
            before += len(words)
            removed = np.concatenate([[0], np.cumsum(mask)])
            for row in range(words.rows):
                first, last = edges[row], edges[row + 1]
                lost = int(removed[last] - removed[first])
                n_words.append(int(last - first))
                n_removed.append(lost)
                spans.append(_runs(mask[first:last]) if lost else [])
                kept.append(_join(words, int(first), int(last), mask if lost else None))
        return pa.table(
            {
                id_col: table.column(id_col),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                text: pa.array(kept, pa.string()),
            }
        )

    replies = key_sums(chunks, keys_of, 1, lambda sums: (sums[:, 0] >= 2).astype(np.uint8))
    return with_sums(chunks, replies, "u1", result, shape)


def _one(table: pa.Table, text: str) -> pa.Array:
    column = table.column(text)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())


def _runs(mask: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _join(words: Words, first: int, last: int, gone: np.ndarray | None) -> str:
    if first == last:
        return ""
    if gone is None:
        return b" ".join(words.data[words.start[first] : words.end[last - 1]].tobytes().split()).decode()
    return b" ".join(words.text(i) for i in range(first, last) if not gone[i]).decode()
