"""Operator 4: language identification by prediction by partial matching (PPM).

Each language has a byte context tree of order 3 (contexts of 0 to 3 bytes) with escape
probabilities by method C: in a context seen ``n`` times with ``d`` distinct successors, a
successor seen ``c`` times costs ``-log2(c / (n + d))`` bits and an escape to the next
shorter context ``-log2(d / (n + d))``; below order 0 every byte costs 8 bits.  Contexts
that a language has never seen cost nothing and are passed over.  The statistics are
frozen after training, so the code length of a text is a sum of table entries, found for
all bytes of a batch at once: (three bytes -> longest context of any language) and
(context, byte -> one cost per language).

Text form: Unicode lower case, UTF-8; ASCII other than letters becomes one space.

Training takes a bounded, deterministic sample of the labelled texts: for each label about
``train_docs`` distinct texts of lowest hash (all of them if fewer), each once, as counts.  A model above
``MOST_BYTES`` (very many labels and alphabets) is refused rather than shipped.  Scoring
reads every whole text; lang, source and doc_id are never inputs of a prediction.

Defined results: null text or text with no letter -> ``und`` with score 0; no labelled row
at all -> ``und``; ties between languages go to the label that sorts first; rows repeat
as often as they occur; an empty table gives no rows; texts of any length are read whole; kept columns pass through
whatever their names.  ``score`` is the winner's share of 2^-(bits a byte), scaled by
``sharpness``, between 0 and 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, tune

ORDER = 3
#: largest cost table that is shipped to the workers
MOST_BYTES = 400_000_000
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, text number of each byte): every text starts with a space, runs of spaces are one."""
    raw = [b" " + (t or "").lower().encode("utf-8", "replace") for t in texts]
    data = _FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) for r in raw])
    keep = np.ones(len(data), bool)
    if len(data) > 1:
        keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (owner[1:] != owner[:-1])
    return data[keep], owner[keep]


def grams(data: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each byte the three bytes before it in its own text (0 where there is none) and itself, as one uint32."""
    out = data.astype(np.uint32)
    for back in range(1, ORDER + 1):
        before = np.zeros(len(data), np.uint32)
        if len(data) > back:
            same = owner[back:] == owner[:-back]
            before[back:] = np.where(same, data[:-back], 0)
        out |= before << np.uint32(8 * back)
    return out


class Model:
    """Frozen context trees of all languages, as tables."""

    def __init__(self, counts: dict[str, dict[int, int]]):
        """counts: language -> (three bytes before and the byte, as uint32) -> times seen."""
        self.langs = sorted(counts)
        symbols = sorted({g & 255 for c in counts.values() for g in c} | {0})
        self.symbol = np.full(256, len(symbols), np.int32)  # the last column: bytes never seen
        self.symbol[symbols] = np.arange(len(symbols))
        n = len(symbols) + 1
        trees = []  # per language, per order: context -> row of counts
        for lang in self.langs:
            tree: list[dict[int, np.ndarray]] = [{} for _ in range(ORDER + 1)]
            for gram, times in counts[lang].items():
                s = self.symbol[gram & 255]
                for order in range(ORDER + 1):
                    context = (gram >> 8) & ((1 << 8 * order) - 1)
                    # a context that reaches over the start of the text is none
                    if order and not context >> 8 * (order - 1):
                        break
                    row = tree[order].get(context)
                    if row is None:
                        row = tree[order][context] = np.zeros(n, np.int64)
                    row[s] += times
            trees.append(tree)
        self.contexts: list[tuple[int, int]] = [(0, 0)]
        for order in range(1, ORDER + 1):
            self.contexts += sorted((order, c) for c in set().union(*(t[order] for t in trees)))
        at = {c: i for i, c in enumerate(self.contexts)}
        if (size := len(self.contexts) * n * len(self.langs) * 4) > MOST_BYTES:
            raise ValueError(f"a model of {len(self.langs)} languages takes {size} bytes: train on fewer texts a label or fewer labels")
        self.cost = np.zeros((len(self.contexts), n, len(self.langs)), np.float32)
        for k, tree in enumerate(trees):
            for i, (order, context) in enumerate(self.contexts):
                base = np.full(n, 8.0) if order == 0 else self.cost[at[self._shorter(order, context, at)], :, k]
                row = tree[order].get(context)
                if row is None:
                    self.cost[i, :, k] = base
                    continue
                total, distinct = row.sum(), np.count_nonzero(row)
                seen = row > 0
                self.cost[i, :, k] = base - np.log2(distinct / (total + distinct))
                self.cost[i, seen, k] = -np.log2(row[seen] / (total + distinct))
        self.cost = self.cost.reshape(len(self.contexts) * n, len(self.langs))
        self.width = n
        self._ctx: np.ndarray | None = None

    @staticmethod
    def _shorter(order: int, context: int, at: dict) -> tuple[int, int]:
        while order:
            order -= 1
            context &= (1 << 8 * order) - 1
            if (order, context) in at:
                return order, context
        return 0, 0

    def context_table(self) -> np.ndarray:
        """Row of the longest known context for each three (byte classes): built once in each worker."""
        if self._ctx is None:
            n = self.width
            table = np.zeros((n, n, n), np.int32)
            for i, (order, context) in enumerate(self.contexts):
                s = [self.symbol[(context >> 8 * b) & 255] for b in range(order)]  # nearest byte first
                if order == 1:
                    table[:, :, s[0]] = i
                elif order == 2:
                    table[:, s[1], s[0]] = i
                elif order == 3:
                    table[s[2], s[1], s[0]] = i
            self._ctx = table.reshape(-1)
        return self._ctx

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ctx": None}

    def bits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(code length of each text in each language, bytes of each text's folded form)."""
        data, owner = folded(texts)
        s, n = self.symbol[data], self.width
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = np.append(starts, len(owner))[1:]
        # before its start a text has class symbol[0], which no context holds
        prev = []
        for back in range(1, ORDER + 1):
            p = np.empty_like(s)
            p[back:] = s[:-back]
            for k in range(back):
                p[(starts + k)[starts + k < ends]] = self.symbol[0]
            prev.append(p)
        row = self.context_table()[(prev[2] * n + prev[1]) * n + prev[0]] * n + s
        total = np.add.reduceat(np.take(self.cost, row, axis=0), starts, axis=0, dtype=np.float64)
        return total, ends - starts

    def predict(self, texts: list[str | None], sharpness: float) -> tuple[list[str], list[float]]:
        if not texts or not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        bits, size = self.bits(texts)
        rate = (bits - bits.min(1, keepdims=True)) / size[:, None]
        share = np.exp2(-sharpness * rate)
        share /= share.sum(1, keepdims=True)
        best = bits.argmin(1)
        known = [bool(t and _LETTER.search(t)) for t in texts]
        langs = [self.langs[b] if k else "und" for b, k in zip(best, known)]
        return langs, [float(share[i, b]) if known[i] else 0.0 for i, b in enumerate(best)]


def train(labelled: DataFrame, train_docs: int = 1500, text: str = "text", lang: str = "lang") -> Model:
    """Context trees from ``labelled`` (text, lang): about ``train_docs`` rows a label, chosen by hash of the text.

    Only counts of distinct 4-byte strings reach the driver, from at most
    ``train_docs`` texts a label.
    """
    tune(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    per_lang = rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not per_lang:
        return Model({})
    names = [r["lang"] for r in per_lang]
    share = F.create_map(*(F.lit(x) for r in per_lang for x in (r["lang"], min(1.0, train_docs / r["n"]))))
    spot = F.pmod(F.col("h"), F.lit(1_000_003)) / F.lit(1_000_003)
    sample = rows.where(spot < share[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in total.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            total.clear()

        held = 0
        for b in by_bytes(batches, "text"):
            langs = np.array(b.column(1).to_pylist(), object)
            for name in set(langs):
                at = np.flatnonzero(langs == name)
                texts = b.column(0).take(pa.array(at)).to_pylist()
                g = grams(*folded(texts))
                total.setdefault(name, []).append(g)
                held += len(g)
            if held > 8_000_000:
                yield from flush()
                held = 0
        yield from flush()

    found = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[int, int]] = {name: {} for name in names}
    table = found.toArrow()
    for name, g, n in zip(table["lang"].to_pylist(), table["gram"].to_pylist(), table["n"].to_pylist()):
        counts[name][g] = n
    return Model({k: v for k, v in counts.items() if v})


def predict(docs: DataFrame, model: Model, keep: list[Column | str] = ("doc_id",), text: str = "text", sharpness: float = 8.0) -> DataFrame:
    """``keep`` columns, ``lang_pred string`` and ``score double`` for every row of ``docs``."""
    spark = docs.sparkSession
    tune(spark)
    src = docs.select(*keep, F.col(text).alias("__text"))
    names = src.columns[:-1]
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shipped = spark.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in by_bytes(batches, "__text"):
            langs, scores = m.predict(b.column(len(names)).to_pylist(), sharpness)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return src.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, least: float, text: str = "text", sharpness: float = 8.0) -> DataFrame:
    """The rows of ``docs`` (all columns) with a language whose score is above ``least``."""
    spark = docs.sparkSession
    tune(spark)
    at = docs.columns.index(text)
    shipped = spark.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in by_bytes(batches, text):
            langs, scores = m.predict(b.column(at).to_pylist(), sharpness)
            yield b.filter(pa.array([lang != "und" and score > least for lang, score in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that training may see: doc_id's CRC-32 mod 4 is not 2."""
    return docs.where(~held_out(docs))


def held_out(docs: DataFrame) -> Column:
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2, F.lit(False))
