"""Operator 5: quality classifier by co-training of two views.

* Content view: hashed distinct tokens of the whole text and character shares.
* Metadata view: source, language, size and combinations; it never sees the text.

Features of every document are found in one pass and written in the shared folder; the
later passes read those numbers, not the texts.

Each view adds two signals: a logistic regression on the labelled sample, and a naive Bayes
log ratio (how much likelier a feature is in one class) on labelled rows and pseudo-labels.
In each round a pass over *all* documents scores both views; where one is sure (calibrated
probability at least ``sure``) the document's features count for that class in the ratio of
the *other* view.  Tasks send vectors of sums, added as a tree, so what travels is bounded by the number
of features and every confident document counts, whatever the size of the corpus.  A view's
two signals are calibrated (Platt) on labelled rows kept out of the training, and a last
logistic step on those rows combines the two calibrated views.  Every document is scored.

Only the labelled sample is bounded: at most ``max_labelled`` documents, those of lowest hash
of doc_id; their feature numbers reach the driver.  The same procedure fits any 0/1 column
of ``labels``; the query fits quality and toxicity and keeps documents that are good and not toxic.

Defined results: no usable labels, or labels of one class only -> that class's rate (0.5
without any); null and empty texts have no tokens and are scored by what is left; null
metadata is a value of its own; conflicting labels of a doc_id count by their mean (0.5
and more is 1); of rows that share a doc_id the one of the smallest features is learned from; repeated rows
count and come out as often as they occur; pseudo-labels don't depend on order; an empty table gives no rows;
texts of any length are read whole, other columns are not.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, by_bytes, tune

_TOKEN = re.compile(r"\w+|[^\w\s]+")
CONTENT, META, SHARES = 1 << 16, 1 << 10, 6
#: Features in one vector of sums (divides both views' sizes), and tasks whose vectors are added first.
SLICE, TEAM = 1 << 10, 256


class _Slots(dict):
    """Token -> hashed feature."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        slot = SHARES + zlib.crc32(token.encode("utf-8", "replace")) % (CONTENT - SHARES)
        if len(token) <= 64:
            self[token] = slot
        return slot


_SLOTS = _Slots()


def content_features(text: str | None) -> np.ndarray:
    """Numbers of the features that hold: distinct tokens, and thresholds of character shares."""
    if not text:
        return np.empty(0, np.int32)
    tokens = _TOKEN.findall(text)
    slots = {_SLOTS[t.lower()] for t in set(tokens)}
    marks = sum(not t[0].isalnum() for t in tokens) / max(1, len(tokens))
    upper = sum(t.isupper() and len(t) > 1 for t in tokens) / max(1, len(tokens))
    digit = sum(t[0].isdigit() for t in tokens) / max(1, len(tokens))
    slots |= {i for i, on in enumerate((marks > 0.3, marks > 0.45, upper > 0.2, upper > 0.5, digit > 0.1, len(slots) < 0.3 * len(tokens))) if on}
    return np.sort(np.fromiter(slots, np.int32, len(slots)))


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    size = "none" if n_chars is None else str(int(n_chars).bit_length())
    parts = (f"s{source}", f"l{lang}", f"n{size}", f"s{source}l{lang}", f"l{lang}n{size}")
    return np.array(sorted({zlib.crc32(p.encode("utf-8", "replace")) % META for p in parts}), np.int32)


def _matrix(rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, row numbers)."""
    sizes = [len(r) for r in rows]
    return np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """Logistic regression on binary features, Adam on the full batch with weight decay."""

    size: int
    weight: np.ndarray | None = None
    bias: float = 0.0

    def fit(self, rows: Sequence[np.ndarray], y: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-4) -> "Logistic":
        col, row = _matrix(rows)
        w, bias = np.zeros(self.size), 0.0
        m, v, mb, vb = np.zeros(self.size), np.zeros(self.size), 0.0, 0.0
        # both classes weigh the same
        weigh = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
        for t in range(1, steps + 1):
            err = (_sigmoid(np.bincount(row, w[col], len(y)) + bias) - y) * weigh
            g, gb = np.bincount(col, err[row], self.size) + decay * w, err.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            fix1, fix2 = 1 - 0.9**t, 1 - 0.999**t
            w -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-6)
            bias -= rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-6)
        self.weight, self.bias = w, float(bias)
        return self

    def raw(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        col, row = _matrix(rows)
        return np.bincount(row, self.weight[col], len(rows)) + self.bias


@dataclass
class View:
    """Both signals of a view and their calibration."""

    size: int
    logistic: Logistic
    labelled: np.ndarray  # feature counts of the labelled rows, a line for each class
    ratio: np.ndarray | None = None
    line: tuple[float, ...] = (1.0, 0.0, 0.0)

    @classmethod
    def fit(cls, size: int, rows: Sequence[np.ndarray], y: np.ndarray) -> "View":
        counts = [np.bincount(_matrix([r for r, z in zip(rows, y) if z == c])[0], minlength=size) for c in (0, 1)]
        return cls(size, Logistic(size).fit(rows, y), np.stack(counts))

    def count(self, pseudo: np.ndarray, rows: Sequence[np.ndarray], y: np.ndarray) -> None:
        """Log ratio of labelled and pseudo-labelled counts, calibrated on ``rows``."""
        n = self.labelled + pseudo + 0.5
        ratio = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
        self.ratio = ratio
        self.ratio = ratio / max(1e-9, float(self._mean_ratio(rows).std()))
        self.line = _line(self._signals(rows), y)

    def _mean_ratio(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        col, row = _matrix(rows)
        return np.bincount(row, self.ratio[col], len(rows)) / np.maximum(1, [len(r) for r in rows])

    def _signals(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([self.logistic.raw(rows), self._mean_ratio(rows)], 1)

    def logit(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        return self._signals(rows) @ np.array(self.line[:2]) + self.line[2]


def _line(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic weights and bias of few columns, by Newton steps; targets are smoothed as Platt proposed."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = _sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - target) + ridge * w)
        w -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return tuple(w)


@dataclass
class CoTrained:
    """Both calibrated views and their combination; ``rate`` answers where nothing could be fitted."""

    content: View | None = None
    meta: View | None = None
    mix: tuple[float, ...] = (1.0, 0.0, 0.0)
    rate: float = 0.5

    def score(self, content: Sequence[np.ndarray], meta: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(content view, metadata view, combined) probabilities."""
        if self.content is None:
            same = np.full(len(content), self.rate)
            return same, same, same
        c, m = self.content.logit(content), self.meta.logit(meta)
        return _sigmoid(c), _sigmoid(m), _sigmoid(self.mix[0] * c + self.mix[1] * m + self.mix[2])


def _pick(rows: Sequence[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    return [rows[i] for i in at]


@dataclass
class _Fit:
    """One target's labelled rows; every fourth is kept out for calibration."""

    content: list[np.ndarray]
    meta: list[np.ndarray]
    y: np.ndarray

    def __post_init__(self) -> None:
        y = self.y
        self.model = CoTrained(rate=float(y.mean()) if len(y) else 0.5)
        if len(y) < 8 or len(set(y.tolist())) < 2:
            return
        out = np.arange(len(y)) % 4 == 3
        if len(set(y[out].tolist())) < 2 or len(set(y[~out].tolist())) < 2:
            out[:] = False
        fit = np.flatnonzero(~out)
        self.cal = np.flatnonzero(out) if out.any() else fit
        self.model.content = View.fit(CONTENT, _pick(self.content, fit), y[fit])
        self.model.meta = View.fit(META, _pick(self.meta, fit), y[fit])

    def update(self, pseudo: np.ndarray) -> None:
        """Both views and their combination from the pseudo-labels' counts (class, feature of either view)."""
        if self.model.content is None:
            return
        content, meta, y = _pick(self.content, self.cal), _pick(self.meta, self.cal), self.y[self.cal]
        self.model.content.count(pseudo[:, :CONTENT], content, y)
        self.model.meta.count(pseudo[:, CONTENT:], meta, y)
        self.model.mix = _line(np.stack([self.model.content.logit(content), self.model.meta.logit(meta)], 1), y)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, content, meta): the feature numbers of every row."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            content = [content_features(t) for t in b.column(1).to_pylist()]
            meta = [meta_features(*x) for x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.list_(pa.int32())), pa.array(meta, pa.list_(pa.int32()))], ["doc_id", "content", "meta"])

    return src.mapInArrow(run, "doc_id long, content array<int>, meta array<int>")


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column."""
    return np.split(column.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(column).to_numpy())[:-1]) if len(column) else []


def pseudo_counts(table: DataFrame, models: dict[str, CoTrained], sure: float) -> dict[str, np.ndarray]:
    """For each model, how often each feature (content, then meta) occurs in the documents of which the other view is sure."""
    width, names = CONTENT + META, list(models)
    shipped = table.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), 2, width), np.int64)
        for b in batches:
            rows = _lists(b.column(0)), _lists(b.column(1))
            for k, name in enumerate(names):
                model = shipped.value[name]
                if model.content is None:
                    continue
                content, meta, _ = model.score(*rows)
                for view, p, start, size in ((rows[0], meta, 0, CONTENT), (rows[1], content, CONTENT, META)):
                    for label, strength in ((1, p), (0, 1 - p)):
                        col, _ = _matrix(_pick(view, np.flatnonzero(strength >= sure)))
                        sums[k, label, start : start + size] += np.bincount(col, minlength=size)
        parts = sums.reshape(-1, SLICE)
        for i in np.flatnonzero(parts.any(1)):
            team = TaskContext.get().partitionId() // TEAM
            yield pa.RecordBatch.from_arrays([pa.array([team], pa.int32()), pa.array([i], pa.int32()), pa.array([parts[i].tobytes()], pa.binary())], ["team", "part", "sums"])

    def added(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), np.int64) for x in rows["sums"]], axis=0)
        return pa.table({"part": rows["part"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    # vectors are added as a tree, a team of tasks first: at most one vector a model, class and slice reaches the driver
    sent = table.select("content", "meta").mapInArrow(run, "team int, part int, sums binary")
    once = sent.groupBy("team", "part").applyInArrow(added, "part int, sums binary")
    total = once.groupBy("part").applyInArrow(added, "part int, sums binary").toArrow()
    sums = np.zeros((len(names) * 2 * width // SLICE, SLICE))
    for i, line in zip(total["part"].to_pylist(), total["sums"].to_pylist()):
        sums[i] = np.frombuffer(line, np.int64)
    return dict(zip(names, sums.reshape(len(names), 2, width)))


def _train(table: DataFrame, labels: DataFrame, targets: Sequence[str], max_labelled: int, rounds: int, sure: float) -> dict[str, CoTrained]:
    """The models from a written table of :func:`features`."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.avg(F.col(t).cast("double")).alias(t) for t in targets))
    marked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # a proven bound for the broadcast
    # one row a doc_id, so that what reaches the driver keeps the bound
    rows = table.join(F.broadcast(marked), "doc_id").groupBy("doc_id", *targets).agg(F.min(F.struct("content", "meta")).alias("r"))
    own = rows.select("doc_id", "r.content", "r.meta", *targets).toArrow().to_pylist()
    own.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    fits = {}
    for t in targets:
        at = [r for r in own if r[t] is not None]
        fits[t] = _Fit([np.array(r["content"], np.int32) for r in at], [np.array(r["meta"], np.int32) for r in at], np.array([float(r[t] >= 0.5) for r in at]))
        fits[t].update(np.zeros((2, CONTENT + META)))
    models = {t: fit.model for t, fit in fits.items()}
    if any(model.content is not None for model in models.values()):
        for _ in range(rounds):
            for t, pseudo in pseudo_counts(table, models, sure).items():
                fits[t].update(pseudo)
    return models


def train(docs: DataFrame, labels: DataFrame, targets: Sequence[str], max_labelled: int = 8000, rounds: int = 3, sure: float = 0.95) -> dict[str, CoTrained]:
    """One co-trained pair for each 0/1 column of ``labels(doc_id, ...)``; all of ``docs`` is the unlabelled pool."""
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    models = _train(scratch.put(features(docs), "features"), labels, targets, max_labelled, rounds, sure)
    scratch.drop("features")
    return models


def _score(table: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    shipped = table.sparkSession.sparkContext.broadcast(models)
    names = ["doc_id", *(f"{t}{x}" for t in models for x in ("_content", "_meta", ""))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, meta = _lists(b.column(1)), _lists(b.column(2))
            found = [pa.array(p) for m in shipped.value.values() for p in m.score(content, meta)]
            yield pa.RecordBatch.from_arrays([b.column(0), *found], names)

    return table.select("doc_id", "content", "meta").mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names[1:])]))


def score(docs: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    """``doc_id`` and, for each model t, ``t_content``, ``t_meta`` and ``t`` (combined), all probabilities."""
    tune(docs.sparkSession)
    return _score(features(docs), models)


def train_and_score(docs: DataFrame, labels: DataFrame, targets: Sequence[str], max_labelled: int = 8000, rounds: int = 3, sure: float = 0.95) -> DataFrame:
    """:func:`score` of :func:`train`, with one pass over the texts."""
    tune(docs.sparkSession)
    table = Scratch(docs.sparkSession, "quality").put(features(docs), "features")
    return _score(table, _train(table, labels, targets, max_labelled, rounds, sure))
