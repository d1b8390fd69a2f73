"""Operator 3: near-duplicate groups by SuperMinHash, banding, full-set verification and union-find.

* A document's set: distinct ``n``-word shingles of its whole text, A-Z lower-cased (the
  whole word sequence as one shingle if it is shorter), as 64-bit hashes.
* Equal sets collapse first (128-bit fingerprint, an aggregation with partial minima), so
  thousands of copies become one representative and are never paired.
* SuperMinHash (Ertl 2017): every element draws ranks in the order of its own random
  permutation, correlated over the slots; work stops for a text once no later rank can
  lower any slot.  The signature's ``bands * rows`` slots give ``bands`` keys.
* Shingles that only one bucket member has bound its similarity to any other: members that
  can't reach the threshold leave, and pairs that can't are never made.  Nothing is lost.
* A bucket's members are joined to its centre, the member with the fewest shingles of its
  own, i.e. the likeliest source of the others (a star, never all pairs).  The links are
  verified on full sets, first each document's most shared centre, then the other centres
  where the groups still differ.  For buckets that still hold members of different groups
  :func:`cross_pairs` finds the cross-group pairs that can reach the threshold, so nothing
  that the stars missed is lost.
* Groups come from :func:`components` over written tables in the shared folder.

Bands of 5 rows miss a pair at similarity 0.85 with probability (1 - 0.85^5)^25 < 1e-6;
pairs must share two bands (miss < 1e-5).

Defined results: null or wordless text -> empty set, its own group, linked with nothing;
null doc_id -> no group (component_id null, kept true); rows that share a doc_id are one
document, linked by what any of them links; repeated rows come out as often as they occur;
an empty table gives no rows; texts of any length are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, by_bytes, mix, rolling, trim, tune
from .components import components

BANDS, ROWS = 25, 5
_WORDS = WordHashes()


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(words) < n:
        return rolling(hashes, len(words)) + np.uint64(len(words))
    return np.unique(rolling(hashes, n))


def superminhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """(n_sets, m) signature slots of sets given as elements with owners, all sets at once.

    Step j gives every element its j-th rank (a uniform number plus j) at the j-th place of
    its permutation (an incremental Fisher-Yates shuffle); a set leaves when all of its
    slots are below j + 1.
    """
    slots = np.full(n_sets * m, np.inf)
    state, who = elements.astype(np.uint64), owner.astype(np.int64)
    order: np.ndarray | None = None
    first = None
    for j in range(m):
        if not len(state):
            break
        state = mix(state)
        rank = (state >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
        pick = j + (mix(state ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m - j)).astype(np.int64)
        if j == 0:
            place = first = pick
        else:
            lines = np.arange(len(state))
            if order is None:
                order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(state), 1))
                order[lines, first], order[:, 0] = 0, first
            place = order[lines, pick].astype(np.int64)
            order[lines, pick] = order[:, j]
        np.minimum.at(slots, who * m + place, rank)
        going = slots.reshape(n_sets, m).max(1) > j + 1
        keep = going[who]
        if not keep.all():
            state, who = state[keep], who[keep]
            first = first[keep] if order is None else None
            order = None if order is None else order[keep]
    return slots.reshape(n_sets, m)


def band_keys(slots: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit keys."""
    bits = np.ascontiguousarray(slots[:, : bands * rows]).view(np.uint64).reshape(len(slots), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), bits.shape[:2]).copy()
    for k in range(rows):
        out = mix(out ^ bits[:, :, k])
    return out.astype(np.int64)


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, fp binary, keys array<long>) of every row; fp and keys are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            sets = [shingles(t, n) for t in b.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            keys: list[np.ndarray | None] = [None] * len(sets)
            if len(full):
                slots = superminhash(np.concatenate([sets[i] for i in full]), np.repeat(np.arange(len(full)), sizes[full]), len(full), bands * rows)
                for i, line in zip(full, band_keys(slots, bands, rows)):
                    keys[i] = line
            fps = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "fp", "keys"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, fp binary, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose full sets have 100 * intersection >= percent * union.

    Rows come sorted by b (the centre) out of the join, so a centre's set is made once.
    """
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for i, (ta, tb) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if tb != last_text:
                    last_text, last = tb, shingles(tb, n)
                own = shingles(ta, n)
                common = len(np.intersect1d(own, last, assume_unique=True))
                if common and 100 * common >= percent * (len(own) + len(last) - common):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))
        trim()

    return both.mapInArrow(run, "a long, b long").distinct()


def own_shingles(texts: DataFrame, n: int) -> DataFrame:
    """(id, h): the shingles of ``texts(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            sets = [shingles(t, n) for t in b.column(1).to_pylist()]
            ids = np.repeat(b.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).view(np.int64))], ["id", "h"])

    return texts.select("doc_id", "text").mapInArrow(run, "id long, h long")


def _bound(size_a: str, own_a: str, size_b: str, own_b: str, percent: int) -> str:
    """SQL: whether two sets can reach the similarity, given how many shingles each has alone (true if a size is unknown)."""
    most = f"least({size_a} - {own_a}, {size_b} - {own_b})"
    return f"coalesce(100 * {most} >= {percent} * ({size_a} + {size_b} - {most}), true)"


def cross_pairs(inside: DataFrame, texts: DataFrame, scratch: Scratch, n: int, percent: int, rare: int = 8, cells: int = 16) -> DataFrame:
    """``a, b``: the pairs of ``inside(key, id, size, g)`` from different groups that can reach the similarity.

    A shingle is rare if no more than ``rare`` members have it, so all who share it are
    known.  The pairs that share a rare shingle are listed from those shingles; all other
    pairs have at most their frequent shingles in common, which leaves few of a bucket's
    pairs.  Holders are found in two steps, by (shingle, cell of the id) as smallest,
    largest and count, then by shingle: a frequent shingle never gathers its members.
    """
    nodes = scratch.put(inside.groupBy("id").agg(F.min("g").alias("g"), F.min("size").alias("size")), "inside-nodes")
    some = texts.join(nodes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    each = own_shingles(some, n).join(nodes.select("id", "g"), "id")
    cell = F.pmod(F.xxhash64("id"), F.lit(cells))
    held = each.groupBy("h", cell.alias("cell")).agg(F.min(F.struct("id", "g")).alias("lo"), F.max(F.struct("id", "g")).alias("hi"), F.count("*").alias("n"))
    held = held.groupBy("h").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.collect_list(F.array("lo", "hi")).alias("who"))
    held = held.where(f"n <= {rare} and most <= 2").select(F.array_distinct(F.flatten("who")).alias("who"))
    held = scratch.put(held, "rare")
    counts = held.select(F.explode("who").alias("x")).groupBy(F.col("x.id").alias("id")).agg(F.count("*").alias("r"))
    nodes = scratch.put(nodes.join(counts, "id", "left").select("id", "g", "size", F.coalesce("r", F.lit(0)).alias("r")), "rare-nodes")
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("g").alias(f"g{x}"), F.col("size").alias(f"s{x}"), F.col("r").alias(f"r{x}"))

    shared = held.where("size(who) > 1").select(
        F.explode(F.expr("flatten(transform(who, x -> transform(filter(who, y -> y.id < x.id and y.g <> x.g), y -> named_struct('a', x.id, 'b', y.id))))")).alias("p")
    )
    shared = shared.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")).join(side("a"), "a").join(side("b"), "b")
    both = "n + least(sa - ra, sb - rb)"
    shared = shared.where(f"coalesce(100 * ({both}) >= {percent} * (sa + sb - ({both})), true)").select("a", "b")

    line = inside.select("key", "id").join(nodes, "id")
    line = scratch.put(line.where(f"size is null or 100 * (size - r) >= {percent} * size"), "frequent")
    close = (
        line.select("key", F.col("id").alias("a"), F.col("g").alias("ga"), F.col("size").alias("sa"), F.col("r").alias("ra"))
        .join(line.select("key", F.col("id").alias("b"), F.col("g").alias("gb"), F.col("size").alias("sb"), F.col("r").alias("rb")), "key")
        .where("a > b and ga <> gb").where(_bound("sa", "ra", "sb", "rb", percent))
        .groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2").select("a", "b")
    )
    return shared.union(close).distinct()


def groups(docs: DataFrame, n: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = scratch.put(sketches(docs, n, bands, rows), "sketch")
    known = sketch.where("doc_id is not null and fp is not null")
    reps = scratch.put(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")

    # Bucket members: one row for each representative and band, in buckets of two or more.
    lone = known.select("fp", "doc_id", "keys").join(reps, (known["fp"] == reps["fp"]) & (known["doc_id"] == reps["rep"]))
    rows_ = lone.select(F.explode("keys").alias("key"), F.col("rep").alias("id"))
    rows_ = scratch.put(rows_, "rows")
    shared = scratch.put(
        rows_.groupBy("key").agg(F.min("id").alias("c"), F.max("id").alias("top")).where("c <> top").select("key", "c"), "shared"
    )
    met = scratch.put(rows_.join(shared, "key").select("key", "id").distinct(), "met")
    scratch.drop("rows", "shared")
    wanted = met.select(F.col("id").alias("doc_id")).distinct()
    texts = scratch.put(docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")

    # A shingle of one member alone is shared with nobody: the rest bounds its similarities.
    alone = own_shingles(texts, n).groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("top")).where("id = top")
    alone = alone.groupBy("id").agg(F.count("*").alias("u"))
    sizes = known.groupBy(F.col("doc_id").alias("id")).agg(F.min("n_shingles").alias("size"), F.min("fp").alias("f1"), F.max("fp").alias("f2"))
    nodes = wanted.select(F.col("doc_id").alias("id")).join(sizes, "id").join(alone, "id", "left")
    # (a doc_id with several sets has no bound)
    nodes = scratch.put(nodes.select("id", F.when(F.col("f1") == F.col("f2"), F.col("size")).alias("size"), F.coalesce("u", F.lit(0)).alias("u")), "nodes")
    members = met.join(nodes.where(f"size is null or 100 * (size - u) >= {percent} * size"), "id")
    members = scratch.put(members, "pruned")
    hubs = scratch.put(members.groupBy("key").agg(F.min(F.struct("u", "id", "size")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"), "hubs")
    members = scratch.put(
        members.join(hubs, "key").select("key", "id", "size", "u", F.col("hub.id").alias("c"), F.col("hub.size").alias("c_size"), F.col("hub.u").alias("c_u")), "members"
    )
    scratch.drop("met", "pruned", "hubs")

    within = members.where("id <> c").where(_bound("size", "u", "c_size", "c_u", percent))
    star = scratch.put(within.groupBy(F.col("id").alias("a"), F.col("c").alias("b")).agg(F.count("*").alias("n"), F.min("c_u").alias("u")).where("n >= 2"), "star")
    best = star.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("u"), -F.col("b"))).alias("b"))

    # Rows that share a doc_id but not a set make their representatives one document.
    twice = known.groupBy("doc_id").agg(F.min("fp").alias("f1"), F.max("fp").alias("f2")).where("f1 <> f2").select("doc_id")
    same = known.join(twice, "doc_id", "left_semi").select("doc_id", "fp").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    links = scratch.put(verified(best, texts, n, percent).union(same), "links-1")
    found = scratch.put(components(links, scratch, "cc1"), "groups-1")

    def grouped(frame: DataFrame, column: str, to: str, found: DataFrame) -> DataFrame:
        names = found.select(F.col("node").alias(column), F.col("component").alias("__c"))
        return frame.join(names, column, "left").withColumn(to, F.coalesce("__c", column)).drop("__c")

    open_star = grouped(grouped(star.join(best, ["a", "b"], "left_anti"), "a", "ca", found), "b", "cb", found).where("ca <> cb").select("a", "b")
    links = scratch.put(links.union(verified(open_star, texts, n, percent)), "links-2")
    found = scratch.put(components(links, scratch, "cc2"), "groups-2")

    # Buckets that still hold several groups: their cross-group pairs, less those already tried.
    named = scratch.put(grouped(members.select("key", "id", "size", "u"), "id", "g", found), "named")
    mixed = scratch.put(named.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("key"), "mixed")
    inside = scratch.put(named.join(mixed, "key", "left_semi"), "inside")
    rest = cross_pairs(inside, texts, scratch, n, percent).join(star, ["a", "b"], "left_anti")
    links = scratch.put(links.union(verified(rest, texts, n, percent)), "links-3")
    found = scratch.put(components(links, scratch, "cc3"), "groups-3")
    scratch.drop("texts", "named", "mixed", "inside", "inside-nodes", "rare", "rare-nodes", "frequent", "members", "star", "nodes", "links-1", "links-2", "groups-1", "groups-2")

    of_fp = scratch.put(grouped(reps, "rep", "component_id", found).select("fp", "component_id"), "of_fp")
    return (
        sketch.select("doc_id", "n_shingles", "fp")
        .join(of_fp, "fp", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
