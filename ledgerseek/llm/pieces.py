"""Operator 2: SentencePiece encoding and decoding through a table of distinct chunks.

The model's pieces hold whitespace markers only in front, so no merge crosses from a
word into the marker after it: the segmentation of a text is the concatenation of the
segmentations of its marked words.  Each worker keeps a table *distinct chunk -> ids*;
a batch of texts is cut into chunks, chunks that the table lacks are segmented once by
the library, and ids are joined back by position.  No shuffle; memory is bounded by the
table's limit and by the chunk of text in work.

Defined results: a null text is encoded as the empty text (only the end id); null ids
decode to null; equal texts have equal ids, repeated rows come out as often as they occur; an empty table gives
no rows; texts of any length are encoded whole.  Other columns pass through untouched by name (``keep``).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import CHUNK_BYTES, by_bytes, tune

MARK = "▁"
_RUNS = re.compile(" *[^ ]+| +$")
_CODECS: dict[str, "ChunkCodec"] = {}


class ChunkCodec:
    """Distinct-chunk table over one model file."""

    #: Chunks in the newer of the table's two halves; the older half goes when the newer is full.
    LIMIT = 100_000

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()) if not self.sp.is_control(i)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("this model has pieces that cross a whitespace marker")
        self.end = self.pack([self.sp.eos_id()])
        self.mark = self.sp.piece_to_id(MARK)
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def pack(ids: Sequence[int]) -> bytes:
        return array("i", ids).tobytes()

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """A table with all of ``chunks``; each one that it lacks is segmented once."""
        new = [c for c in chunks if c not in self.table]
        if len(self.table) + len(new) > self.LIMIT:
            self.older, self.table = self.table, {}
            new = list(chunks)
        lacking = []
        for c in new:
            ids = self.older.get(c)
            if ids is None:
                lacking.append(c)
            else:
                self.table[c] = ids
        # A chunk is its text after the first marker, which the library's dummy prefix puts back.
        for c, ids in zip(lacking, self.sp.encode(lacking, num_threads=1)):
            self.table[c] = self.pack(ids if c else [self.mark])
        return self.table

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts, each with the end id."""
        cut: list[list[str]] = []
        for t in texts:
            if not t:
                cut.append([])
                continue
            if MARK in t:
                t = t.replace(MARK, " ")
            words = t.split(" ")
            if "" in words:  # runs of spaces: markers belong to the word behind them
                words = [c[1:] for c in _RUNS.findall(" " + t)]
            cut.append(words)
        table = self.learn(set().union(*cut))
        parts = [b"".join([table[c] for c in words]) + self.end for words in cut]
        offsets = np.zeros(len(parts) + 1, np.int32)
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        return offsets, np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids, num_threads=1) if ids else []


def codec(model: str) -> ChunkCodec:
    if model not in _CODECS:
        _CODECS[model] = ChunkCodec(model)
    return _CODECS[model]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``ids array<int>``: every whole text's ids and the end id."""
    tune(docs.sparkSession)
    model = model or default_model()
    keep = list(keep)
    src = docs.select(*keep, docs[text].alias("__text"))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in by_bytes(batches, "__text"):
            offsets, ids = c.encode(b.column(len(keep)).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), lists], [*keep, "ids"])

    return src.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str | None = None, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``ids`` as of :func:`encode` and ``decoded``, the library's decode(ids), in one pass: one
    Python worker a task holds the model and the chunk table."""
    tune(docs.sparkSession)
    model = model or default_model()
    keep = list(keep)
    src = docs.select(*keep, docs[text].alias("__text"))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in by_bytes(batches, "__text", CHUNK_BYTES // 2):
            offsets, ids = c.encode(b.column(len(keep)).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            texts = c.decode([ids[a:e].tolist() for a, e in zip(offsets[:-1], offsets[1:])])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), lists, pa.array(texts, pa.string())], [*keep, "ids", "decoded"])

    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and ``to``: the library's decode(ids)."""
    tune(encoded.sparkSession)
    model = model or default_model()
    schema = T.StructType([*encoded.schema.fields, T.StructField(to, T.StringType())])
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                values = part.column(at).to_pylist()
                found = iter(c.decode([x for x in values if x is not None]))
                texts = [None if x is None else next(found) for x in values]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(run, schema)
