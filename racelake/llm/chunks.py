"""Documents packed into chunks, and counting of keys over all chunks.

A chunk is a row with some megabytes of documents, compressed. Keys (64-bit hashes) of a chunk are combined in the
chunk, cut by value into buckets and summed for each bucket; every chunk then gets the sums of its own keys back.
A key that is in a third of all rows sends one number for each chunk, so no task gets more than its share.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelake.llm.words import row_slices
from racelake.sources.scratch import new_path

CHUNK_BYTES = 3 << 20
CHUNK_SCHEMA = "chunk bigint, payload binary"
ASK_SCHEMA = "bucket int, chunk bigint, keys binary, counts binary"
REPLY_SCHEMA = "chunk bigint, bucket int, counts binary"
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")

#: A chunk's keys, sorted and distinct, and for each a row of counts.
Keys = tuple[np.ndarray, np.ndarray]


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_ZSTD) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    with pa.ipc.open_stream(payload) as stream:
        return stream.read_all().combine_chunks()


_LIBC = ctypes.CDLL(ctypes.util.find_library("c"))


def give_back() -> None:
    """Hands freed memory back to the system. Workers are used again and again, and what their allocators keep between
    tasks would count against the executor for good."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def chunk_rows(docs: DataFrame, text: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """`docs` as stored chunks of about `chunk_bytes` of text; a longer text is a chunk of its own.

    A chunk never spans two tasks. It is written before it is used, so its number and content stay as they are.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            row = pa.record_batch({"chunk": pa.array([first + made]), "payload": pa.array([pack(_joined(held))])})
            held.clear()
            made += 1
            return row

        for batch in batches:
            column = batch.schema.get_field_index(text)
            for start, end in row_slices(batch.column(column), chunk_bytes):
                part = batch.slice(start, end - start)
                more = part.column(column).nbytes
                if held and size + more > chunk_bytes:
                    yield flush()
                    size = 0
                held.append(part)
                size += more
        if held:
            yield flush()

    spark = docs.sparkSession
    path = new_path(spark, "chunks")
    chunks = docs.mapInArrow(cut, CHUNK_SCHEMA)
    # Rows are large, so the writer looks at its size often.
    writer = chunks.write.option("parquet.block.size.row.check.min", 4).option("compression", "uncompressed")
    writer.option("parquet.page.size.row.check.min", 2).parquet(path)
    return spark.read.schema(chunks.schema).parquet(path)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def combine(keys: np.ndarray, counts: np.ndarray) -> Keys:
    """Sorted distinct keys with their counts (one column each) summed."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first, axis=0)


def indexed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them. Only the distinct ones are sorted."""
    coded = pa.array(keys).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    place = np.empty(len(found), np.int32)
    place[order] = np.arange(len(found), dtype=np.int32)
    return found[order], place[coded.indices.to_numpy()]


def _planes(values: np.ndarray) -> bytes:
    """The bytes of the numbers, all first bytes first; sorted keys compress better so."""
    return np.ascontiguousarray(values.reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted keys; one more for the end. Buckets are equal ranges of all 64-bit keys."""
    step = (1 << 64) // buckets
    starts = np.array([i * step for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]])


def key_sums(
    chunks: DataFrame,
    keys_of: Callable[[pa.Table], Keys],
    width: int,
    shown: Callable[[np.ndarray], np.ndarray],
    facts: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Replies to every chunk: for each bucket, `shown(sums)` of the chunk's keys in sorted order, as bytes.

    `keys_of` gives a chunk's keys and `width` counts for each. `facts` sees each bucket's distinct keys and sums
    and adds a reply to chunk -1.
    """
    buckets = 4 * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(*(batch.column(c).to_pylist() for c in ("chunk", "payload")), strict=True):
                keys, counts = keys_of(unpack(payload))
                give_back()
                edges = bucket_edges(keys, buckets)
                used = np.flatnonzero(np.diff(edges))
                yield pa.record_batch(
                    {
                        "bucket": pa.array(used, pa.int32()),
                        "chunk": pa.array(np.full(len(used), chunk), pa.int64()),
                        "keys": pa.array([_planes(keys[edges[b] : edges[b + 1]]) for b in used], pa.binary()),
                        "counts": pa.array(
                            [_planes(counts[edges[b] : edges[b + 1]].astype("<u4")) for b in used], pa.binary()
                        ),
                    }
                )

    def reply(table: pa.Table) -> pa.Table:
        asked = [_from_planes(k, "<u8") for k in table.column("keys").to_pylist()]
        counts = [_from_planes(c, "<u4").reshape(-1, width) for c in table.column("counts").to_pylist()]
        keys = np.concatenate(asked)
        distinct, sums = combine(keys, np.concatenate(counts).astype(np.int64))
        del counts
        where, answers, at = np.searchsorted(distinct, keys), [], 0
        for part in asked:
            answers.append(_planes(shown(sums[where[at : at + len(part)]])))
            at += len(part)
        chunk = table.column("chunk").to_pylist()
        if facts:
            chunk.append(-1)
            answers.append(facts(distinct, sums).tobytes())
        del asked, keys, distinct, sums, where
        give_back()
        bucket = table.column("bucket")[0].as_py()
        return pa.table(
            {
                "chunk": pa.array(chunk, pa.int64()),
                "bucket": pa.array([bucket] * len(chunk), pa.int32()),
                "counts": pa.array(answers, pa.binary()),
            }
        )

    asks = chunks.mapInArrow(ask, ASK_SCHEMA)
    return asks.groupBy("bucket").applyInArrow(reply, REPLY_SCHEMA)


def with_sums(
    chunks: DataFrame, replies: DataFrame, kind: str, result: Callable[[pa.Table, np.ndarray], pa.Table], schema: str
) -> DataFrame:
    """`result(documents of a chunk, sums)` for every chunk; the sums stand in the order of the chunk's keys."""

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = sorted(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist(), strict=True))
        sums = np.concatenate([_from_planes(c, kind) for _, c in parts] or [np.zeros(0, kind)])
        made = result(unpack(left.column("payload")[0].as_py()), sums)
        give_back()
        return made

    answered = replies.filter(F.col("chunk") >= 0)
    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(fill, schema)
