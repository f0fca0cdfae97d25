"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

Marked words (a run of word marks and what follows) are sorted, which is the order of a depth-first walk through
their trie; forward states of a common prefix are computed once. For a unigram model the state of a prefix is the
best score and its last piece. For a BPE model it is the last piece of the prefix's own encoding: the only piece
that stays apart from the piece before it when both are merged together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path
from struct import Struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from racelake.llm.chunks import give_back
from racelake.llm.words import row_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_NORMAL, _UNKNOWN, _BYTE, _USER = 1, 2, 6, 4
_BPE, _UNIGRAM = 2, 1
#: An id as the bytes of an int32.
_ID = Struct("<i").pack
#: Text encoded at a time.
SLICE_BYTES = 4 << 20
#: Ids decoded at a time.
SLICE_IDS = 1 << 20
#: Words whose pieces a task remembers, and pairs of pieces that a worker does; beyond, it starts anew.
REMEMBERED, REMEMBERED_PAIRS = 400_000, 250_000


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.model_type not in (_BPE, _UNIGRAM):
            raise ValueError("only BPE and unigram models that leave the text as it is can be used")
        self.is_bpe, self.prefixed = spec.model_type == _BPE, norm.add_dummy_prefix
        self.ids: dict[str, int] = {}
        self.score: list[float] = [p.score for p in proto.pieces]
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        self.decoded: list[bytes] = []
        for i, piece in enumerate(proto.pieces):
            if piece.type in (_NORMAL, _USER):
                self.ids[piece.piece] = i
            elif piece.type == _BYTE:
                self.bytes[int(piece.piece[3:5], 16)] = i
            elif piece.type == _UNKNOWN:
                self.unknown = i
            plain = piece.piece.replace(MARK, " ").encode() if piece.type in (_NORMAL, _USER) else b""
            self.decoded.append(plain)
        for value, i in self.bytes.items():
            self.decoded[i] = bytes([value])
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on after a word's end, so words can't be encoded one by one")
        self.longest = max(map(len, self.ids), default=1)
        self.packed = {piece: _ID(i) for piece, i in self.ids.items()}
        # A character without a piece of its own never merges, so it is a unit by itself.
        known = "".join(re.escape(p) for p in self.ids if len(p) == 1 and p != MARK)
        self.units = re.compile(f"{MARK}*[{known}]+|{MARK}+|." if known else ".", re.DOTALL)
        self.lowest = min(self.score, default=0.0) - 10.0
        self._apart: dict[tuple[str, str], bool] = {}
        self.memory: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The merges of a BPE model, one at a time: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, left: str, right: str) -> bool:
        """Whether two pieces next to each other stay as they are."""
        key = (left, right)
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) >= REMEMBERED_PAIRS:
                self._apart.clear()
            found = self._apart[key] = self.merged(left + right) == [left, right]
        return found

    def _last(self, word: str, end: int, lasts: list[str]) -> str:
        """The last piece of the encoding of `word[:end]` by a BPE model, where `lasts` are those of shorter prefixes.

        One piece fits. Most often it is that of the prefix before with one character more, which is tried first.
        """
        ids, remembered = self.ids, self._apart.get
        start = end - len(lasts[-1]) - 1
        piece = word[start:end]
        if start and piece in ids and remembered((lasts[start], piece)):
            return piece
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            piece = word[start:end]
            if piece not in ids:
                continue
            if not start:
                if self.merged(piece) == [piece]:
                    return piece
                continue
            fits = remembered((lasts[start], piece))
            if fits or (fits is None and self.apart(lasts[start], piece)):
                return piece
        return word[end - 1 : end]

    def _best(self, word: str, end: int, lasts: list[str], scores: list[float]) -> tuple[float, str]:
        """The last piece of the best encoding of `word[:end]` by a unigram model, and its score."""
        best: tuple[float, str] | None = None
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            piece = word[start:end]
            i = self.ids.get(piece)
            if i is not None and (best is None or scores[start] + self.score[i] > best[0]):
                best = (scores[start] + self.score[i], piece)
        return best or (scores[-1] + self.lowest, word[end - 1 : end])

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Pieces of distinct words, as int32 bytes. Sorted words are the leaves of a trie walked depth-first; `lasts` and
        `scores` are the forward states of a word's prefixes."""
        before, lasts, scores = "", [""], [0.0]
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del lasts[shared + 1 :]
            size = len(word)
            if self.is_bpe:
                for end in range(shared + 1, size + 1):
                    lasts.append(self._last(word, end, lasts))
            else:
                del scores[shared + 1 :]
                for end in range(shared + 1, size + 1):
                    score, last = self._best(word, end, lasts, scores)
                    lasts.append(last)
                    scores.append(score)
            before, end, found = word, size, []
            while end:
                piece = lasts[end]
                known = self.packed.get(piece)
                found.append(known if known is not None else b"".join([_ID(self.bytes.get(b, self.unknown)) for b in piece.encode()]))
                end -= len(piece)
            found.reverse()
            yield word, b"".join(found)

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        split = [
            None if t is None else self.units.findall((MARK if self.prefixed and t else "") + t.replace(" ", MARK))
            for t in texts
        ]
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        new = set().union(*filter(None, split)) - self.memory.keys()
        self.memory.update(self.encode_words(new))
        get = self.memory.__getitem__
        return [None if units is None else b"".join(map(get, units)) for units in split]

    def decode(self, lists: pa.ListArray) -> list[str | None]:
        """The texts of lists of ids, null for null."""
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        parts = pa.array(self.decoded, pa.binary()).take(lists.flatten())
        if parts.null_count:
            raise ValueError("an id is null")
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, parts, mask=lists.is_null()), b"")
        return [None if b is None else b.decode("utf-8", "replace")[1 if self.prefixed and b[:1] == b" " else 0 :] for b in joined.to_pylist()]


@lru_cache(2)
def pieces_of(model: bytes) -> Pieces:
    return Pieces(model)


def _shared(df: DataFrame, path: str) -> Broadcast:
    """The model file, read by the driver: executors need not have it. Its size is that of a vocabulary."""
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encode_texts(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Every row of `docs` with its piece ids. A null text gives null, an empty one no pieces.

    Characters without a piece become byte pieces (or the unknown piece where the model has none). Rows are encoded
    alone by their whole text; repeats get the same ids. A column named like the result is replaced.
    """
    shared, docs = _shared(docs, model), docs.drop(ids) if ids != text else docs
    shape = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What the stages before have left in this worker counts against the executor too.
        give_back()
        codec = pieces_of(shared.value)
        for batch in batches:
            # More words at a time share more prefixes.
            for start, end in row_slices(batch.column(at), SLICE_BYTES):
                part = batch.slice(start, end - start)
                found = codec.encode(part.column(at).to_pylist())
                sizes = np.array([0 if f is None else len(f) // 4 for f in found])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                values = pa.array(np.frombuffer(b"".join(f or b"" for f in found), "<i4"))
                missing = pa.array([f is None for f in found])
                lists = pa.ListArray.from_arrays(offsets, values, mask=missing)
                yield pa.record_batch([*part.columns, lists], names=shape.names)
        # Workers outlive their tasks; what they keep would count against the next stage's memory.
        codec.memory.clear()
        give_back()

    return docs.mapInArrow(run, shape)


def decode_pieces(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """Every row of `df` with the text of its piece ids; null for null. Bytes that are no UTF-8 are replaced."""
    shared, df = _shared(df, model), df.drop(text) if ids != text else df
    shape = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces_of(shared.value)
        for batch in batches:
            # Lists that are longer than this together are looked at one after another.
            upto = np.cumsum(batch.column(at).value_lengths().fill_null(0).to_numpy(), dtype=np.int64) // SLICE_IDS
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(upto)) + 1):
                part = batch.slice(int(rows[0]) if len(rows) else 0, len(rows))
                texts = codec.decode(part.column(at))
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=shape.names)

    return df.mapInArrow(run, shape)
