"""Operator 10: substring dedup by fixed-block anchors.

A window is ``n`` neighbouring words of one document.  A word goes if a window that covers
it also starts in a document with a smaller doc_id.

Any window of n words holds a whole block of ``(n + 1) // 2`` words that starts at a
multiple of that length.  So

1. *Anchors.*  The non-overlapping blocks of every document are the reference index; every
   rolling window of block length probes it.  A hash is an anchor if it is a block of one
   document and occurs in another.  Documents travel in parcels (by hash of doc_id, about
   ``parcel_bytes`` of text), and a parcel sends each distinct hash once with two flags, so
   a passage in a third of all documents costs one entry a parcel, not one a document.
2. *Extension.*  In each parcel, windows that hold an anchor are hashed whole, by two
   hashes of 64 and 63 bits, and sent, again once a distinct pair of hashes, with the parcel's
   smallest doc_id and whether it has several; the answer is the smallest doc_id of each
   window that occurs in several documents.
3. *Removal.*  Each parcel marks the words under windows whose answer is smaller than the
   own doc_id; runs of such windows are the maximal exact repeats.

Words aren't compared: two different windows count as one where all 127 bits agree, which
1e13 windows do with probability below 1e-12.  An anchor's 64 bits only choose where
windows are looked up, so an agreement there by chance removes nothing.

Hashes travel as packed arrays by bucket, buckets in number to the data, so a
task's memory is bounded by the bucket and parcel size.  Tables between the steps are
written in the shared folder.

Defined results: null or blank text -> no words, nothing removed, kept text empty; a null
doc_id is never smaller and loses nothing; equal doc_ids don't remove from each other;
repeated rows come out as often as they occur; ties of equal texts go to the smallest doc_id; an empty table gives
no rows; texts of any length are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, rolling, tune

_WORDS = WordHashes()
#: Of the second window hash; its lowest bit carries whether a parcel has the window in several documents.
_FACTOR, _SEVERAL = 0xD1342543DE82EF95, np.int64(1)
_SIEVE_BITS = 22
_WIRE = "bucket int, parcel int, hashes binary, extra binary"


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _send(parcel: int, hashes: np.ndarray, extra: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries by bucket, one row each."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    hashes, extra, bucket = hashes[order], extra[order], bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
    ends = np.append(starts, len(bucket))[1:]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[starts].astype(np.int32)),
            pa.array(np.full(len(starts), parcel, np.int32)),
            pa.array([hashes[a:e].tobytes() for a, e in zip(starts, ends)], pa.binary()),
            pa.array([extra[a:e].tobytes() for a, e in zip(starts, ends)], pa.binary()),
        ],
        ["bucket", "parcel", "hashes", "extra"],
    )


def _bucket(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a bucket: hashes, extras, parcels."""
    h = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["hashes"]]
    e = [np.frombuffer(x.as_buffer(), kind) for x in table["extra"]]
    parcels = np.repeat(table["parcel"].to_numpy(), [len(x) for x in h])
    return np.concatenate(h), np.concatenate(e), parcels


def _answers(bucket: int, parcels: np.ndarray, hashes: np.ndarray, extra: np.ndarray) -> pa.Table:
    """Entries back to their parcels, one row for each."""
    order = np.argsort(parcels, kind="stable")
    parcels, hashes, extra = parcels[order], hashes[order], extra[order]
    starts = np.flatnonzero(np.diff(parcels, prepend=-1))
    ends = np.append(starts, len(parcels))[1:]
    return pa.table(
        {
            "bucket": pa.array(np.full(len(starts), bucket, np.int32)),
            "parcel": pa.array(parcels[starts].astype(np.int32)),
            "hashes": pa.array([hashes[a:e].tobytes() for a, e in zip(starts, ends)], pa.binary()),
            "extra": pa.array([extra[a:e].tobytes() for a, e in zip(starts, ends)], pa.binary()),
        }
    )


def _replies(table: pa.Table, kind: type, wide: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A parcel's answers, sorted by hash; extras of ``wide`` values are lines of an array."""
    if not table.num_rows:
        return np.empty(0, np.uint64), np.empty(0, kind).reshape(-1, *[wide] * (wide > 1))
    h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table["hashes"]])
    e = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table["extra"]])
    order = np.argsort(h)
    return h[order], (e.reshape(-1, wide) if wide > 1 else e)[order]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted ``known``, -1 if absent."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _probe(parcel: int, table: pa.Table, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 1: a parcel's distinct block-length hashes; flag 1: a block, flag 2: in several documents."""
    ids = table["doc_id"].to_pylist()
    hashes, flags, owners = [], [], []
    for i, text in zip(ids, table["text"].to_pylist()):
        h = rolling(_hashes(_split(text)), block)
        if len(h) and i is not None:
            hashes.append(h)
            flags.append((np.arange(len(h)) % block == 0).astype(np.uint8))
            owners.append(np.full(len(h), i, np.int64))
    if not hashes:
        return
    h, f, o = np.concatenate(hashes), np.concatenate(flags), np.concatenate(owners)
    order = np.argsort(h)
    h, f, o = h[order], f[order], o[order]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    several = np.minimum.reduceat(o, starts) != np.maximum.reduceat(o, starts)
    yield _send(parcel, h[starts], np.maximum.reduceat(f, starts) | (several.astype(np.uint8) << 1), buckets)


def _anchors(bucket: int, table: pa.Table) -> pa.Table:
    """Hashes that are a block somewhere and occur in two documents or more."""
    h, f, parcels = _bucket(table, np.uint8)
    order = np.argsort(h)
    h, f, parcels = h[order], f[order], parcels[order]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    sizes = np.diff(np.append(starts, len(h)))
    good = ((sizes > 1) | (np.bitwise_or.reduceat(f, starts) & 2 > 0)) & (np.bitwise_or.reduceat(f, starts) & 1 > 0)
    keep = np.repeat(good, sizes)
    return _answers(bucket, parcels[keep], h[keep], f[keep])


def _order(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """An order by both hashes; by the first alone where equal ones never have different seconds."""
    order = np.argsort(h)
    first, second = h[order], check[order]
    return np.lexsort((check, h)) if ((first[1:] == first[:-1]) & (second[1:] != second[:-1])).any() else order


def _sieve(known: np.ndarray) -> np.ndarray:
    """Which leading bits occur in ``known``: most hashes that aren't in it end here, before a search."""
    out = np.zeros(1 << _SIEVE_BITS, bool)
    out[known >> np.uint64(64 - _SIEVE_BITS)] = True
    return out


def _changes(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where a new pair of hashes begins, in arrays sorted by both."""
    return np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])))


def _find(h: np.ndarray, check: np.ndarray, known: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Place of each pair of hashes in the pairs sorted by ``known``, -1 if absent."""
    at = _among(h, known)
    left = np.flatnonzero(at >= 0)
    while len(left := left[checks[at[left]] != check[left]]):
        at[left] += 1
        over = (at[left] >= len(known)) | (known[np.minimum(at[left], len(known) - 1)] != h[left])
        at[left[over]] = -1
        left = left[~over]
    return at


def _windows(words: list[bytes], anchors: np.ndarray, sieve: np.ndarray, n: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, second hashes) of the windows of ``n`` words that hold an anchor."""
    none = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(words) < n:
        return none
    w = _hashes(words)
    blocks = rolling(w, block)
    held = sieve[blocks >> np.uint64(64 - _SIEVE_BITS)]
    held[held] = _among(blocks[held], anchors) >= 0
    hit = np.cumsum(np.append(0, held))
    span = n - block + 1  # anchors that a window can hold
    starts = np.flatnonzero(hit[span:] > hit[:-span])
    if not len(starts):
        return none
    return starts, rolling(w, n)[starts], rolling(w, n, _FACTOR)[starts].view(np.int64) & ~_SEVERAL


def _extend(parcel: int, table: pa.Table, replies: pa.Table, n: int, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 2: a parcel's distinct windows around anchors, with its smallest doc_id and whether it has several."""
    anchors, _ = _replies(replies, np.uint8)
    sieve = _sieve(anchors)
    hashes, checks, owners = [], [], []
    for i, text in zip(table["doc_id"].to_pylist(), table["text"].to_pylist()):
        if i is None or not len(anchors):
            continue
        _, h, check = _windows(_split(text), anchors, sieve, n, block)
        if len(h):
            hashes.append(h)
            checks.append(check)
            owners.append(np.full(len(h), i, np.int64))
    if not hashes:
        return
    h, check, o = np.concatenate(hashes), np.concatenate(checks), np.concatenate(owners)
    order = _order(h, check)
    h, check, o = h[order], check[order], o[order]
    starts = _changes(h, check)
    low = np.minimum.reduceat(o, starts)
    several = low != np.maximum.reduceat(o, starts)
    yield _send(parcel, h[starts], np.stack([low, check[starts] | several], 1), buckets)


def _smallest(bucket: int, table: pa.Table) -> pa.Table:
    """For windows in several documents: the smallest doc_id, to parcels that hold a larger one."""
    h, e, parcels = _bucket(table, np.int64)
    own, mark = e.reshape(-1, 2).T
    check, several = mark & ~_SEVERAL, (mark & _SEVERAL) > 0
    order = _order(h, check)
    h, check, own, several, parcels = h[order], check[order], own[order], several[order], parcels[order]
    starts = _changes(h, check)
    low = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, len(h))))
    keep = several | (own > low)
    return _answers(bucket, parcels[keep], h[keep], np.stack([low, check], 1)[keep])


def _remove(table: pa.Table, anchors: pa.Table, replies: pa.Table, n: int, block: int) -> Iterator[pa.RecordBatch]:
    """Step 3: words that stay."""
    known_anchors, _ = _replies(anchors, np.uint8)
    known, extra = _replies(replies, np.int64, 2)
    low, checks = extra.T.copy()
    sieve = _sieve(known_anchors)
    out = []
    for i, text in zip(table["doc_id"].to_pylist(), table["text"].to_pylist()):
        words = _split(text)
        gone = np.zeros(0, bool)
        if i is not None and len(known):
            starts, h, check = _windows(words, known_anchors, sieve, n, block)
            at = _find(h, check, known, checks)
            starts = starts[(at >= 0) & (low[np.maximum(at, 0)] < i)]
            if len(starts):
                edge = np.zeros(len(words) + 1, np.int64)
                edge[starts] += 1
                np.subtract.at(edge, starts + n, 1)
                gone = np.cumsum(edge[:-1]) > 0
        kept = words if not gone.any() else [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
        if len(out) == 256:
            yield _rows(out)
            out = []
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, n: int = 13, parcel_bytes: int = 6_000_000, bucket_entries: int = 1_500_000) -> DataFrame:
    """``doc_id, n_words, n_removed, kept string`` (kept words joined by one space) for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "substring")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parcels, buckets = total // parcel_bytes + 1, total // 6 // bucket_entries + 1
    block = (n + 1) // 2
    # rows without a doc_id are spread by their text
    spot = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(parcels))
    posted = docs.select(spot.cast("int").alias("parcel"), "doc_id", "text")

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_probe(key[0].as_py(), table, block, buckets), _WIRE_ARROW)

    def extend(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _WIRE_ARROW.empty_table()
        return pa.Table.from_batches(_extend(key[0].as_py(), table, replies, n, block, buckets), _WIRE_ARROW)

    def by_bucket(f):
        return lambda key, table: f(key[0].as_py(), table)

    def remove(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        step = replies["step"].to_numpy()
        first, second = replies.filter(pa.array(step == 1)), replies.filter(pa.array(step == 2))
        return pa.Table.from_batches(_remove(table, first, second, n, block), _OUT_ARROW)

    probes = posted.groupBy("parcel").applyInArrow(probe, _WIRE)
    anchors = scratch.put(probes.groupBy("bucket").applyInArrow(by_bucket(_anchors), _WIRE), "anchors")
    wide = posted.groupBy("parcel").cogroup(anchors.groupBy("parcel")).applyInArrow(extend, _WIRE)
    answers = scratch.put(wide.groupBy("bucket").applyInArrow(by_bucket(_smallest), _WIRE), "answers")
    replies = anchors.withColumn("step", F.lit(1)).union(answers.withColumn("step", F.lit(2)))
    return posted.groupBy("parcel").cogroup(replies.groupBy("parcel")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


_WIRE_ARROW = pa.schema([("bucket", pa.int32()), ("parcel", pa.int32()), ("hashes", pa.binary()), ("extra", pa.binary())])
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
