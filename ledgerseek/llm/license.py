"""Operator 6: license scan with ordered signature rules.

Hundreds of regexes (:mod:`license_rules`) are gated by keywords: a substring test finds which
keywords a text holds, and only their rules run.  Overlapping detections are resolved in
order: higher priority first, then longer, then earlier rule; a detection whose interval
lies inside one already taken is suppressed.  Beside them stand the base places: positions
of the base phrases in the text's word sequence, which are never suppressed.

Words are runs of ASCII digits, ASCII letters (lower-cased) and all non-ASCII characters.
The scan is a single pass over each whole text: no shuffle, memory bounded by the chunk.

Defined results: null and empty texts have no words, places or detections; rows repeat as
often as they occur; an empty table gives no rows; texts of any length are read whole, in time that follows
their length; kept columns pass through whatever their names.  ``score`` is the highest priority among detections over 100, at
least 0.5 where there is a base place, 0 without either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, tune
from .license_rules import RULES, Signature

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: every byte of ASCII that is no word character becomes a space, A-Z become a-z
_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Scanner:
    def __init__(self, rules: Sequence[Signature] = RULES, phrases: dict[str, str] = PHRASES):
        self.rules = rules
        self.by_keyword: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            self.by_keyword.setdefault(r.keyword, []).append(k)
        self.phrases = [(re.compile(rb"(?= " + p.replace(" ", " +").encode() + rb" )"), label) for p, label in phrases.items()]

    def words(self, text: str) -> tuple[int, list[tuple[int, str]]]:
        """(number of words, base places as (word, label) in order)."""
        plain = b" " + text.encode("utf-8", "replace").translate(_WORDS) + b" "
        blank = np.frombuffer(plain, np.uint8) == 32
        starts = np.flatnonzero(blank[:-1] & ~blank[1:])  # the blank before each word
        places = []
        for regex, label in self.phrases:
            if regex.pattern.split(b" ")[1].split(b" +")[0] not in plain:
                continue
            found = np.searchsorted(starts, np.array([m.start() for m in regex.finditer(plain)], np.int64))
            places += [(int(w), label) for w in found]
        return len(starts), sorted(places)

    def detect(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) of the detections that stay, in order; places are code points."""
        lower = text.translate(_ASCII_LOWER)
        held = [word for word in self.by_keyword if word in lower]
        if not held:
            return []
        found = [(m.start(), m.end(), k) for word in held for k in self.by_keyword[word] for m in self.rules[k].pattern.finditer(lower)]
        found.sort(key=lambda d: (-self.rules[d[2]].priority, d[0] - d[1], d[2], d[0]))
        # taken intervals by start, as a tree of largest ends: whether one that starts no later reaches as far
        place = {a: i + 1 for i, a in enumerate(sorted({d[0] for d in found}))}
        reach = [0] * (len(place) + 1)
        taken: list[tuple[int, int, int]] = []
        for d in found:
            i, furthest = place[d[0]], 0
            while i:
                furthest = max(furthest, reach[i])
                i &= i - 1
            if furthest >= d[1]:
                continue
            taken.append(d)
            i = place[d[0]]
            while i < len(reach):
                reach[i] = max(reach[i], d[1])
                i += i & -i
        return sorted(taken)


_OWN: list[Scanner] = []


def scanner() -> Scanner:
    if not _OWN:
        _OWN.append(Scanner())
    return _OWN[0]


_BASE = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())]))
_FOUND = T.ArrayType(
    T.StructType([T.StructField("label", T.StringType()), T.StructField("priority", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)
_ARROW_BASE = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
_ARROW_FOUND = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, keep: Sequence[Column | str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``n_words long``, ``base array<struct<word, label>>`` and
    ``detections array<struct<label, priority, start, end>>`` of every whole text."""
    tune(docs.sparkSession)
    src = docs.select(*keep, F.col(text).alias("__text"))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("base", _BASE), T.StructField("detections", _FOUND)]
    schema = T.StructType([*src.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for b in by_bytes(batches, "__text"):
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            counted = [s.words(t) for t in texts]
            found = [[{"label": s.rules[k].label, "priority": s.rules[k].priority, "start": a, "end": e} for a, e, k in s.detect(t)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:-1],
                    pa.array([n for n, _ in counted], pa.int64()),
                    pa.array([[{"word": w, "label": label} for w, label in places] for _, places in counted], _ARROW_BASE),
                    pa.array(found, _ARROW_FOUND),
                ],
                schema.names,
            )

    return src.mapInArrow(run, schema)
