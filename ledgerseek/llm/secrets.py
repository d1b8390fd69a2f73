"""Operator 7: secret scans through a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived: trigrams every match must
contain, with AND for neighbouring parts and OR for alternatives.  Each chunk of texts gets
an inverted index (trigram -> texts) of the trigrams that any rule asks for; the postings
are intersected and joined by the rule's query, and only the candidate texts are verified
with the regex.  A rule without mandatory trigrams scans all texts.  The index is local to
a chunk, so nothing is shuffled and memory is bounded by the chunk.

Spans are (kind, start, end) in code points, end exclusive, of the whole match.  Each kind
is matched leftmost and without overlaps; overlapping spans of different kinds all stay.

Defined results: null and empty texts have no spans; rows repeat as often as they occur;
a span's order is start, then rule order; an empty table gives no rows; texts of any length are read whole, other
columns pass through whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, tune


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: group whose length must be at least ``least`` characters, else the match is dropped
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The first three are the base kinds.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # shorter runs never pass the length test, so they need not be matched
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("temporary_access", r"\bASIA[A-Z0-9]{16}\b"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("github_fine", r"\bgithub_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"\bglpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"https://hooks\.slack\.com/services/[A-Za-z0-9/_-]{20,}"),
    Rule("stripe", r"\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google_api", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("google_oauth", r"\bya29\.[A-Za-z0-9_-]{20,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("npm", r"\bnpm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"\bpypi-AgEI[A-Za-z0-9_-]{40,}"),
    Rule("sendgrid", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("hub_model", r"\bhf_[A-Za-z]{30,}"),
    Rule("bot_key", r"\bsk-[A-Za-z0-9_-]{32,}"),
    Rule("bearer", r"\bbearer\x20+[A-Za-z0-9._~+/=-]{20,}", 0, 0, True),
    Rule("basic_auth", r"\bauthorization:\x20*basic\x20+[A-Za-z0-9+/=]{12,}", 0, 0, True),
    Rule("url_login", r"\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[^\s/]+"),
    Rule("account_key", r"\bAccountKey=[A-Za-z0-9+/]{40,}={0,2}"),
    Rule("shopify", r"\bshp(?:at|ca|pa|ss)_[a-f0-9]{32}\b"),
    Rule("twilio", r"\b(?:AC|SK)[0-9a-f]{32}\b"),
    Rule("mailchimp", r"\b[0-9a-f]{32}-us[0-9]{1,2}\b"),
    Rule("client_secret", r"""client_secret["']?\x20*[:=]\x20*["']?[A-Za-z0-9._~-]{16,}""", 0, 0, True),
)
BASE = ("assign", "access", "hex")

# ---------------------------------------------------------------------------------------
# Regex -> Boolean trigram query.  A query is True (no condition), a string of three bytes'
# text, ("and", {...}) or ("or", {...}); all in ASCII lower case, as the index is.

Query = object
MOST_STRINGS, WIDEST_CLASS = 64, 8


def _both(op: str, parts: Sequence[Query]) -> Query:
    flat: set = set()
    for p in parts:
        if p is True:
            if op == "or":
                return True
        elif isinstance(p, tuple) and p[0] == op:
            flat |= p[1]
        else:
            flat.add(p)
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _of_strings(strings: set[str]) -> Query:
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) if s.isascii() else True for s in strings])


def _exact(node: Sequence) -> set[str] | None:
    """All strings that a parsed part matches, lower-cased, if they are few."""
    out = {""}
    for op, arg in node:
        if op is C.LITERAL:
            step: set[str] | None = {chr(arg).lower() if arg < 128 else chr(arg)}
        elif op is C.IN:
            step = set()
            for o, a in arg:
                if o is C.LITERAL:
                    step.add(chr(a).lower() if a < 128 else chr(a))
                elif o is C.RANGE and a[1] - a[0] < WIDEST_CLASS:
                    step |= {chr(x).lower() for x in range(a[0], a[1] + 1)}
                else:
                    return None
            if len(step) > WIDEST_CLASS:
                return None
        elif op is C.SUBPATTERN:
            step = _exact(arg[3])
        elif op is C.BRANCH:
            found = [_exact(x) for x in arg[1]]
            step = None if None in found else set().union(*found)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 4:
            one = _exact(arg[2])
            step = None if one is None else {"".join(p) for k in range(arg[0], arg[1] + 1) for p in product(one, repeat=k)} if len(one) ** arg[1] <= MOST_STRINGS else None
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            step = {""}
        else:
            return None
        if step is None or len(out) * len(step) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in step}
    return out


def _query(node: Sequence) -> Query:
    """Conjunction over the runs of exact parts and the inner parts between them."""
    parts: list[Query] = []
    run = {""}
    for item in node:
        one = _exact([item])
        if one is not None and len(run) * len(one) <= MOST_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        parts.append(_of_strings(run))
        run = {""} if one is None else one
        op, arg = item
        if one is not None:
            continue
        if op is C.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif op is C.BRANCH:
            parts.append(_both("or", [_query(x) for x in arg[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            parts.append(_query(arg[2]))
    parts.append(_of_strings(run))
    return _both("and", parts)


def trigram_query(pattern: str) -> Query:
    """Boolean query that holds for every text with a match (True: no mandatory trigram)."""
    return _query(parser.parse(pattern, re.ASCII))


def _trigrams(q: Query) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*(_trigrams(x) for x in q[1]))


class Scanner:
    """Rules with their trigram queries."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = rules
        self.regex = [r.regex() for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.trigrams = sorted(set().union(*map(_trigrams, self.queries)))
        self.at = {t: i for i, t in enumerate(self.trigrams)}
        self.slot = np.zeros(1 << 21, np.uint16)  # trigram of ASCII as 21 bits -> its number from 1
        for t, i in self.at.items():
            a, b, c = t.encode()
            self.slot[a << 14 | b << 7 | c] = i + 1

    def postings(self, texts: list[str]) -> np.ndarray:
        """(text, trigram) -> whether the text contains it."""
        raw = [t.encode("utf-8", "replace").lower() for t in texts]
        data = np.frombuffer(b"\0".join(raw) + b"\0\0", np.uint8)
        data = np.where(data < 128, data, 0).astype(np.int32)  # no trigram holds other bytes
        found = self.slot[(data[:-2] << 14) | (data[1:-1] << 7) | data[2:]]
        places = np.flatnonzero(found)
        ends = np.cumsum([len(r) + 1 for r in raw])
        table = np.zeros((len(texts), len(self.trigrams) + 1), bool)
        table[np.searchsorted(ends, places, "right"), found[places]] = True
        return table[:, 1:]

    def candidates(self, q: Query, table: np.ndarray) -> np.ndarray:
        if q is True:
            return np.ones(len(table), bool)
        if isinstance(q, str):
            return table[:, self.at[q]]
        parts = [self.candidates(x, table) for x in q[1]]
        return np.logical_and.reduce(parts) if q[0] == "and" else np.logical_or.reduce(parts)

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule number, end) in order."""
        whole = [t or "" for t in texts]
        out: list[list[tuple[int, int, int]]] = [[] for _ in whole]
        table = self.postings(whole)
        for k, (rule, regex, q) in enumerate(zip(self.rules, self.regex, self.queries)):
            for i in np.flatnonzero(self.candidates(q, table)):
                for m in regex.finditer(whole[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _lists(found: list[list[tuple[int, int, int]]], rules: tuple[Rule, ...]) -> pa.Array:
    return pa.array([[{"kind": rules[k].kind, "start": a, "end": e} for a, k, e in spans] for spans in found], _ARROW_SPANS)


def scan(docs: DataFrame, keep: Sequence[Column | str] = ("doc_id",), rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``keep`` columns and ``spans array<struct<kind, start, end>>`` of every whole text."""
    tune(docs.sparkSession)
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for b in by_bytes(batches, "__text"):
            found = s.scan(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(found, rules)], schema.names)

    return src.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """Text with every maximal union of overlapping spans put as ``mask``."""
    out, at = [], 0
    end = -1
    for a, _, e in spans:
        if a >= end:
            if end >= 0:
                at = end
            out += [text[at:a], mask]
            end = e
        else:
            end = max(end, e)
    return "".join(out) + text[max(end, 0) :]


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its ``text`` put as ``mask``: same rows, same columns; null stays null."""
    tune(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for b in by_bytes(batches, text):
            texts = b.column(at).to_pylist()
            out = [masked(t, spans, mask) if spans else t for t, spans in zip(texts, s.scan(texts))]
            columns = list(b.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
