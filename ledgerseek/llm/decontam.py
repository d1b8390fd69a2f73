"""Operator 1: benchmark decontamination by CGK embedding, bit-sampling LSH and edit verification.

A document is contaminated by an item if some stretch of its words is within
``floor(edits * n)`` word edits of the item's n words (words: Unicode lower-cased runs of
letters and digits).

1. *Gate* (loses nothing).  With k allowed edits, the item-sized window at a match keeps all
   but 3k + 1 of the item's neighbouring word pairs, so windows with fewer pairs of the
   benchmark than that are passed over; counts come from running sums over all windows.
2. *CGK embedding* (Chakraborty, Goldenberg, Koucky 2016).  A window is walked for 3n steps;
   each step writes the word at the cursor and moves on by a random bit of (step, word).
   Windows at small edit distance are then at small Hamming distance.
3. *Bit-sampling LSH.*  ``walks`` embeddings with ``tables`` samples of ``sample`` positions
   each; a window that shares a sample with an item of its size is a candidate.
4. *Verification.*  Myers' bit-parallel alignment gives the exact edit distance of the item
   to the best stretch around the candidates; a second pass backwards finds its start.

Sampling loses most where a long item has lost words, so items of more than ``direct_words``
words skip steps 2 and 3: each window that passes the gate is verified.  Items of fewer than
``least_words`` words, too short for edits, are found where all their words stand in order (distance 0).

The benchmark is read in blocks of at most ``block_items`` items and ``block_bytes`` of
text, each shipped to the workers; a larger benchmark makes more passes, never a larger
broadcast.  Documents are never shuffled.

Defined results: null or empty texts match nothing; items that are null or without a word
match nothing; equal items are all reported; an item is reported once for a document row, at its nearest
stretch (the first of equal ones); repeated document rows are reported as often as they occur; an empty
benchmark or corpus gives no rows; texts of any length are read whole; other columns pass
through :func:`clean` whatever their names and are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, mix, rolling, tune

_WORD = re.compile(r"[^\W_]+")
#: text probed at once: each probe has a fixed cost for every item size
PROBE_BYTES = 2_000_000


@dataclass(frozen=True)
class Settings:
    edits: float = 0.2
    least_words: int = 8
    direct_words: int = 100
    walks: int = 16
    tables: int = 4
    sample: int = 2
    seed: int = 20


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def best_stretch(pattern: Sequence[int], text: Sequence[int], most: int) -> tuple[int, int] | None:
    """(edit distance, end) of the stretch of ``text`` nearest to ``pattern``; None above ``most``. Myers 1999."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += (1 if ph & high else 0) - (1 if mh & high else 0)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= most and (best is None or score < best[0]):
            best = score, j + 1
    return best


class Index:
    """One block of benchmark items, ready to probe."""

    def __init__(self, items: list[tuple[int, str]], s: Settings = Settings()):
        self.s = s
        cut = [(i, words_of(t)) for i, t in items]
        cut = [(i, w) for i, w in cut if w]
        self.vocab = {w: k + 1 for k, w in enumerate(sorted({x for _, w in cut for x in w}))}  # 0: any other word
        coded = [(i, np.array([self.vocab[x] for x in w], np.int64)) for i, w in cut]
        self.items = [(i, w) for i, w in coded if len(w) >= s.least_words]
        self.short = self._by_key([(k, w) for k, (_, w) in enumerate(coded) if len(w) < s.least_words])
        self.names = coded
        self.n_words = len(self.vocab) + 1
        self.sizes = sorted({len(w) for _, w in self.items})
        self.longest = self.sizes[-1] if self.sizes else 0
        rng = np.random.default_rng(s.seed)
        self.random_word = mix(np.arange(self.n_words, dtype=np.uint64) + np.uint64(s.seed))
        self.steps = rng.integers(0, 2**63, (s.walks, 3 * self.longest), dtype=np.uint64) | np.uint64(1)
        # word pairs of the items, each with the sizes of its items as bits (sizes beyond 64 share bits)
        codes = [w[:-1] * self.n_words + w[1:] for _, w in self.items]
        bits = [np.full(len(w) - 1, 1 << self.sizes.index(len(w)) % 64, np.uint64) for _, w in self.items]
        self.pairs, where = np.unique(np.concatenate(codes) if codes else np.empty(0, np.int64), return_inverse=True)
        self.pair_sizes = np.zeros(len(self.pairs), np.uint64)
        if codes:
            np.bitwise_or.at(self.pair_sizes, where, np.concatenate(bits))
        # beyond about 2n steps a walk has left its window
        self.samples = np.array([rng.integers(0, 2 * n, (s.walks, s.tables, s.sample)) for n in self.sizes]).reshape(-1, s.walks, s.tables, s.sample)
        text = np.concatenate([w for _, w in self.items]) if codes else np.empty(0, np.int64)
        sizes = np.array([len(w) for _, w in self.items], np.int64)
        #: for each walk and table: sorted keys of the items, and the items in that order
        self.stored = {}
        self.direct: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            if len(w) > s.direct_words:
                self.direct.setdefault(len(w), []).append(k)
        if codes:
            starts = np.cumsum(sizes) - sizes
            for walk in range(s.walks):
                for t, keys in enumerate(self.keys(text, starts, sizes, walk)):
                    order = np.argsort(keys, kind="stable")
                    self.stored[walk, t] = keys[order], order

    @staticmethod
    def _keys(words: np.ndarray, n: int) -> np.ndarray:
        """A key for each run of ``n`` words."""
        return rolling(words.astype(np.uint64), n)

    def _by_key(self, items: list[tuple[int, np.ndarray]]) -> dict[int, dict[int, list[tuple[int, np.ndarray]]]]:
        """Size -> key -> items of few words."""
        out: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        for k, w in items:
            out.setdefault(len(w), {}).setdefault(int(self._keys(w, len(w))[0]), []).append((k, w))
        return out

    def few_words(self, text: np.ndarray, firsts: list[int], out: list[list[tuple[int, int, int, int, int]]]) -> None:
        """Adds the items of few words at the first place of each text that has them whole; texts lie in ``text`` behind ``firsts``, with zeros between them."""
        for n, by_key in self.short.items():
            known = np.array(sorted(by_key), np.uint64)
            places = self._keys(text, n)
            at = np.minimum(np.searchsorted(known, places), len(known) - 1)
            seen: set[tuple[int, int]] = set()
            for p in np.flatnonzero(known[at] == places):
                d = int(np.searchsorted(firsts, p, "right")) - 1
                for k, w in by_key[int(places[p])]:
                    if (d, k) not in seen and (text[p : p + n] == w).all():
                        seen.add((d, k))
                        out[d].append((self.names[k][0], n, 0, int(p) - firsts[d], int(p) - firsts[d] + n))

    def edits(self, n: int) -> int:
        return int(self.s.edits * n + 1e-9)

    def needed(self, n: int) -> int:
        """Benchmark word pairs in an item-sized window at a match, at least."""
        return max(1, n - 1 - (3 * self.edits(n) + 1))

    def keys(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
        """(tables, windows) sampled keys of one walk over windows of the given starts and sizes."""
        words = self.random_word[text]
        wanted = self.samples[np.searchsorted(self.sizes, sizes), walk]  # (windows, tables, sample)
        # windows in falling order of their last wanted step: those still walking are the first ones
        last = wanted.max((1, 2))
        order = np.argsort(-last, kind="stable")
        starts, sizes, wanted = starts[order], sizes[order], wanted[order]
        going = np.searchsorted(-last[order], -np.arange(int(last.max()) + 1), "right")
        trace = np.zeros((len(going), len(starts)), np.uint64)
        at = np.zeros(len(starts), np.int64)
        for step, m in enumerate(going.tolist()):
            here = at[:m]
            inside = here < sizes[:m]
            seen = np.where(inside, words[np.minimum(starts[:m] + here, len(words) - 1)], np.uint64(0))
            trace[step, :m] = seen
            here += ((seen * self.steps[walk, step]) >> np.uint64(63)).astype(np.int64) & inside
        line = np.arange(len(starts))
        out = np.tile(mix(sizes.astype(np.uint64)), (self.s.tables, 1))
        for t in range(self.s.tables):
            for k in range(self.s.sample):
                out[t] = mix(out[t] ^ trace[wanted[:, t, k], line])
        back = np.empty_like(out)
        back[:, order] = out
        return back

    def probe(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text (item id, words of the item, distance, start word, end word), one for each contaminating item."""
        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
        if not self.names or not texts:
            return out
        cut = [words_of(t) for t in texts]
        pad = max(self.longest, self.s.least_words)  # other words behind each text, so that windows may reach over its end
        get = self.vocab.get
        parts, firsts, total = [], [], 0
        gap = np.zeros(pad, np.int64)
        for w in cut:
            firsts.append(total)
            parts += [np.fromiter(map(get, w, repeat(0)), np.int64, len(w)), gap]
            total += len(w) + pad
        text = np.concatenate(parts)
        self.few_words(text, firsts, out)
        if not self.items:
            return out
        known = (text[:-1] > 0) & (text[1:] > 0)
        places = np.flatnonzero(known)
        code = text[places] * self.n_words + text[places + 1]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        same = self.pairs[at] == code
        held = np.zeros(len(text), np.uint64)  # sizes of the items that hold the pair at this place
        held[places[same]] = self.pair_sizes[at[same]]
        run = np.append(np.int32(0), np.cumsum(held > 0, dtype=np.int32))
        last = len(text) - pad
        low = min(self.needed(n) for n in self.sizes)
        starts = np.flatnonzero(run[self.longest - 1 : self.longest - 1 + last] - run[:last] >= low)
        found: dict[tuple[int, int], list[int]] = {}
        if not len(starts):
            return out
        # Only the text under those starts is looked at further.
        edge = np.zeros(len(text) + 1, np.int32)
        edge[starts] += 1
        np.subtract.at(edge, starts + self.longest, 1)
        under = np.cumsum(edge[:-1]) > 0
        spot = (np.cumsum(under) - 1)[starts]
        held = held[under]
        window_starts, window_sizes = [], []
        for j, n in enumerate(self.sizes):
            run = np.append(np.int32(0), np.cumsum((held >> np.uint64(j % 64)) & np.uint64(1), dtype=np.int32))
            fit = starts[run[spot + n - 1] - run[spot] >= self.needed(n)]
            window_starts.append(fit)
            window_sizes.append(np.full(len(fit), n, np.int64))
        window_starts, window_sizes = np.concatenate(window_starts), np.concatenate(window_sizes)
        owner = np.searchsorted(np.array(firsts), window_starts, "right") - 1
        whole = window_sizes > self.s.direct_words
        for d, a, n in zip(owner[whole].tolist(), window_starts[whole].tolist(), window_sizes[whole].tolist()):
            for k in self.direct[n]:
                found.setdefault((d, k), []).append(a)
        owner, window_starts, window_sizes = owner[~whole], window_starts[~whole], window_sizes[~whole]
        for a in range(0, len(window_starts), 10_000):
            some, sizes, docs = window_starts[a : a + 10_000], window_sizes[a : a + 10_000], owner[a : a + 10_000]
            for walk in range(self.s.walks):
                for t, own in enumerate(self.keys(text, some, sizes, walk)):
                    stored, order = self.stored[walk, t]
                    lo, hi = np.searchsorted(stored, own, "left"), np.searchsorted(stored, own, "right")
                    for i in np.flatnonzero(hi > lo):
                        for k in order[lo[i] : hi[i]].tolist():
                            if len(self.items[k][1]) == sizes[i]:
                                found.setdefault((int(docs[i]), k), []).append(int(some[i]))
        for (d, k), at_starts in found.items():
            item = self.items[k][1].tolist()
            n, most = len(item), self.edits(len(item))
            best = None
            begin, end = firsts[d], firsts[d] + len(cut[d])
            reach: list[list[int]] = []
            for a in sorted(set(at_starts)):  # candidates that overlap are one region
                lo, hi = max(begin, a - most), min(end, a + n + most)
                if reach and lo <= reach[-1][1]:
                    reach[-1][1] = max(reach[-1][1], hi)
                else:
                    reach.append([lo, hi])
            for lo, hi in reach:
                hit_at = best_stretch(item, text[lo:hi].tolist(), most)
                if hit_at and (best is None or hit_at[0] < best[0]):
                    stop = lo + hit_at[1]
                    back = best_stretch(item[::-1], text[max(lo, stop - n - most) : stop][::-1].tolist(), hit_at[0])
                    best = hit_at[0], stop - (back[1] if back else n) - begin, stop - begin
            if best:
                out[d].append((self.items[k][0], n, *best))
        return out


def blocks(bench: DataFrame, block_items: int, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of bounded size, read one at a time."""
    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    parts = max(-(-size["n"] // block_items), -(-(size["b"] or 0) // block_bytes))
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield sorted(((r["item_id"], r["text"]) for r in own), key=lambda r: (r[0] is None, r))


def matches(docs: DataFrame, bench: DataFrame, settings: Settings = Settings(), block_items: int = 20_000, block_bytes: int = 16_000_000) -> DataFrame:
    """``doc_id, item_id, n_item_words, distance, start_word, end_word``: one row for each document row and contaminating item."""
    spark = docs.sparkSession
    tune(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["doc_id", "item_id", "n_item_words", "distance", "start_word", "end_word"]
    schema = "doc_id long, item_id long, n_item_words int, distance int, start_word int, end_word int"
    out = None
    for items in blocks(bench, block_items, block_bytes):
        shipped = spark.sparkContext.broadcast((items, settings))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = Index(*shipped.value)
            for b in by_bytes(batches, "text", PROBE_BYTES):
                ids = b.column(0).to_pylist()
                rows = [(i, *m) for i, found in zip(ids, index.probe(b.column(1).to_pylist())) for m in found]
                if rows:
                    kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, bench: DataFrame, settings: Settings = Settings(), block_items: int = 20_000, block_bytes: int = 16_000_000) -> DataFrame:
    """The rows of ``docs`` (all columns) that no benchmark item contaminates."""
    spark = docs.sparkSession
    tune(spark)
    at = docs.columns.index("text")
    for items in blocks(bench, block_items, block_bytes):
        shipped = spark.sparkContext.broadcast((items, settings))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = Index(*shipped.value)
            for b in by_bytes(batches, "text", PROBE_BYTES):
                yield b.filter(pa.array([not found for found in index.probe(b.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs
