"""Operator 8: nearest neighbours by inner product over shifted space-filling curves.

1. Equal vectors collapse to one with its ``k + 1`` smallest ids (a window with a group
   limit, so a vector that a third of all rows share ships few rows a task).
2. Distinct vectors are cut into ranges of norm, so that a long one doesn't squeeze the
   others into few cells.  A range spans a factor of ``spread`` at most, or ``least_block``
   rows.  Inner product becomes distance on a sphere: rows gain a last coordinate that lifts
   all to the largest norm of their range, queries gain a zero and enter every range.  Each
   of ``curves`` orderings rotates, projects to ``dims`` coordinates, shifts at random and
   takes the Hilbert index; a range's orderings are curves of their own.
3. (curve, key) is range-partitioned and sorted by Spark, without the vectors.  Ranks follow
   from the counts of the sorted partitions, joined as a table.
4. *Window.*  It is fitted, not set: for ``sample`` queries of lowest hash (a documented
   bound) the exact neighbours are found by one pass over all rows, and the window is the
   least rank distance, on the nearest of the curves, that reaches a share ``target`` of
   them.  The number of curves is the one of 4, 8 and ``curves`` that is cheapest at
   that.  Data of low intrinsic dimension get windows of a few rows whatever their number; data
   without structure (isotropic vectors of many dimensions) get windows in proportion to the rows,
   and a range whose windows would meet half as many rows as it has is scanned whole, once and exactly.
5. Vectors travel to (curve, block of ranks) once for each curve, queries to the blocks that
   their window meets; blocks that no query meets stay away.  A block holds its queries and the best few of
   each, and its rows stream past them, scored on original vectors in double precision; so a block may be
   of any length.  Blocks travel in tiles as wide as two windows, whose lists are merged before they leave the task: a query
   puts out at most two short lists a curve, or one for each of the ``SLICES`` blocks of a range that is scanned
   whole, whatever the number of rows.  Lists are merged and re-ranked at the end.  Queries of
   one block are split in chunks, so a task's memory is bounded wherever they crowd.

Defined results: vectors that are null, empty, zero, hold null or non-finite components or
have another length than most take no part; fewer candidates than ``k`` -> all of them;
ties go to the smaller vec_id; rows that repeat a vec_id with one vector count once; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tune

#: queries that meet one block of rows at once
CHUNK = 16_384
#: most rows of a block of a window; windows above 4 times that meet more blocks, not more tiles
WIDEST = 262_144
#: blocks of a range that is scanned whole: no more of them for more rows, so that lists grow with the queries alone
SLICES = 8
#: rows scored at once
STREAM = 2048


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index (int64) of integer points (rows) with ``bits`` bits a coordinate (Skilling 2004)."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) > 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def orderings(dim: int, curves: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(projection, shift) of each curve, in the lifted space of dim + 1 coordinates."""
    rng = np.random.default_rng(seed)
    p = min(dims, dim + 1)
    return [(np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0][:, :p], rng.uniform(0, 1, p)) for _ in range(curves)]


def curve_keys(unit: np.ndarray, order: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    """Keys of points on the unit sphere: coordinates within four standard deviations, shifted by up to a fifth of that."""
    projection, shift = order
    y = unit @ projection * np.sqrt(unit.shape[1])
    cells = ((y + 4) / 8 + 0.2 * shift) / 1.2 * (1 << bits)
    return hilbert(np.clip(cells, 0, (1 << bits) - 1).astype(np.int64), bits)


def norm_ranges(bins: list[tuple[float, float, int]], spread: float, block: int) -> list[tuple[float, float, int]]:
    """(least norm, largest norm, rows) of each range, longest first, from those of narrow bins of norm.

    A range takes the next bin while its norms stay within ``spread``, or while its rows fit
    in one block, which every window covers.
    """
    out: list[tuple[float, float, int]] = []
    for low, high, n in sorted(bins, reverse=True):
        if out and (out[-1][1] <= spread * low or out[-1][2] + n <= block):
            out[-1] = (low, out[-1][1], out[-1][2] + n)
        else:
            out.append((low, high, n))
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise the k best (score, id), best first, ties to the smaller id."""
    if scores.shape[1] > k:
        worst = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        width = int((scores >= worst).sum(1).max())  # all that tie with the last
        at = np.argsort(-scores, axis=1, kind="stable")[:, : max(width, k)]
    else:
        at = np.argsort(-scores, axis=1, kind="stable")
    s, i = np.take_along_axis(scores, at, 1), ids[at]
    order = np.lexsort((i, -s))[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


@dataclass(frozen=True)
class Reach:
    """How one range is read: on its first ``curves`` curves, ``around`` blocks on either side of a query's own; ``whole``: all blocks of one curve."""

    curves: int
    around: int
    whole: bool


@dataclass(frozen=True)
class Fit:
    """Window and block in ranks, and how each range is read."""

    window: int
    block: int
    ranges: tuple[Reach, ...]
    #: rows scored for each query, all curves and ranges
    candidates: int


def fit_window(distances: np.ndarray, sizes: list[int], target: float, least_block: int) -> Fit:
    """The cheapest of 4, 8, ... and all curves whose windows hold a share ``target`` of the sample's neighbours.

    ``distances``: (neighbours of the sample, curves) rank distances.
    """
    best = None
    most = distances.shape[1]
    for c in sorted({min(most, x) for x in (4, 8, most)}):
        near = np.sort(distances[:, :c].min(1))
        window = int(near[min(len(near) - 1, int(np.ceil(target * len(near))) - 1)]) if len(near) else 0
        block = int(min(WIDEST, max(least_block, -(-window // 4))))
        around = max(1, -(-window // block))
        # windows read and ship a row on several curves, a scan once
        own = [Reach(1, 0, True) if 2 * c * (2 * around + 1) * block >= n else Reach(c, around, False) for n in sizes]
        cost = sum(n if r.whole else c * (2 * around + 1) * block for n, r in zip(sizes, own))
        if best is None or cost < best.candidates:
            best = Fit(window, block, tuple(own), cost)
    return best


def _places(q: np.ndarray) -> np.ndarray:
    """Place of each row in its run of equal ``q``."""
    first = np.flatnonzero(np.append(True, np.diff(q) != 0))
    return np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))


def whole_block(n: int) -> int:
    """Rows of a block where all ``n`` of a range are scanned."""
    return -(-n // min(SLICES, -(-n // 1024)))


def _top(q: np.ndarray, i: np.ndarray, s: np.ndarray, take: int) -> np.ndarray:
    """Places of the best ``take`` rows (q, i, s) of each q, each i once, best first, ties to the smaller i."""
    order = np.lexsort((-s, i, q))
    once = np.append(True, (np.diff(q[order]) != 0) | (np.diff(i[order]) != 0))
    order = order[once]
    order = order[np.lexsort((i[order], -s[order], q[order]))]
    return order[_places(q[order]) < take]


def _scores(ask: np.ndarray, data: np.ndarray, ids: np.ndarray, take: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, scores, ids): the best of ``data`` for slices of ``ask``, whose score tables hold about a million numbers."""
    step = max(1, 1_000_000 // max(1, len(data)))
    for a in range(0, len(ask), step):
        yield a, *_best(ask[a : a + step] @ data.T, ids, take)


def _spread(rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for q, s, i in rows:
        n = s.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, n)), pa.array(i.reshape(-1)), pa.array(s.reshape(-1))], ["query", "id", "score"])


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each run of equal ``by``; a run that goes on in the next batch comes in parts."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in by], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            yield tuple(keys[at].tolist()), b.slice(at, end - at)


def _blocks(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by ``by``."""
    held: list[pa.RecordBatch] = []
    last = None
    for key, b in _runs(batches, by):
        if held and key != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(b)
        last = key
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.float64)


class Nearest:
    """The best ``take`` of all rows offered so far for each query, ties to the smaller id; nothing else of them is kept."""

    def __init__(self, ids: np.ndarray, e: np.ndarray, take: int):
        self.ids, self.e, self.take = ids, e, take
        self.n = np.zeros(len(ids), np.int64)
        self.near, self.scores = np.zeros((len(ids), take), np.int64), np.zeros((len(ids), take))

    def offer(self, ids: np.ndarray, e: np.ndarray) -> None:
        step = max(1, 1_000_000 // max(1, len(ids)))
        for a in range(0, len(self.ids), step):
            s = self.e[a : a + step] @ e.T
            # A row below the last of a full list can't enter it; of many that can, the best ``take`` and their ties are looked at.
            least = np.where(self.n == self.take, self.scores[:, -1], -np.inf)[a : a + step, None]
            on = ~(s < least)
            many = np.flatnonzero(on.sum(1) > 2 * self.take)
            if len(many):
                on[many] &= ~(s[many] < -np.partition(-s[many], self.take - 1, axis=1)[:, self.take - 1 : self.take])
            q, r = np.nonzero(on)
            if len(q):
                self._merge(q + a, ids[r], s[q, r])

    def _merge(self, q: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
        had = np.unique(q)
        row, place = np.nonzero(np.arange(self.take) < self.n[had, None])
        q, i, s = np.append(q, had[row]), np.append(i, self.near[had[row], place]), np.append(s, self.scores[had[row], place])
        at = _top(q, i, s, self.take)
        place = _places(q[at])
        self.near[q[at], place], self.scores[q[at], place] = i[at], s[at]
        self.n[had] = np.bincount(q[at], minlength=len(self.n))[had]

    def batch(self) -> pa.RecordBatch:
        row, place = np.nonzero(np.arange(self.take) < self.n[:, None])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.near[row, place]), pa.array(self.scores[row, place])], ["query", "id", "score"])


def _streamed(batches: Iterator[pa.RecordBatch], by: list[str], dim: int, take: int) -> Iterator[tuple[list, pa.RecordBatch]]:
    """(group, the best of each of its queries); sorted by ``by`` and falling kind: a group's queries (1) come before its rows (0)."""
    group, asked, waiting, found = None, [], [], None

    def offer():
        if waiting:
            found.offer(np.concatenate([i for i, _ in waiting]), np.concatenate([e for _, e in waiting]))
            waiting.clear()

    for (*key, kind), b in _runs(batches, [*by, "kind"]):
        if key != group:
            if found:
                offer()
                yield group, found.batch()
            group, asked, found = key, [], None
        part = b.column(b.schema.get_field_index("id")).to_numpy(), _matrix(b.column(b.schema.get_field_index("e")), dim)
        if kind:
            asked.append(part)
        elif asked:
            found = found or Nearest(np.concatenate([i for i, _ in asked]), np.concatenate([e for _, e in asked]), take)
            waiting.append(part)
            if sum(len(i) for i, _ in waiting) >= STREAM:
                offer()
    if found:
        offer()
        yield group, found.batch()


class _Space:
    """Distinct vectors of one table, their norm ranges and their curves."""

    def __init__(self, vectors: DataFrame, is_query: Column, k: int, scratch: Scratch):
        self.spark, self.scratch, self.k = vectors.sparkSession, scratch, k
        # single-precision input travels as it is and is widened where it is scored
        narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
        e = F.col("embedding") if narrow else F.col("embedding").cast("array<double>")
        v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), is_query.alias("q"))
        fine = v.where(
            "vec_id is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(e, x -> x <> 0)"
        ).withColumn("d", F.size("e"))
        lengths = fine.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        self.dim = lengths["d"] if lengths else 0
        fine = fine.where(F.col("d") == self.dim).select("vec_id", "e", F.coalesce("q", F.lit(False)).alias("q"))
        # Distinct vectors by their smallest id, with the k + 1 smallest ids.
        same = Window.partitionBy("e").orderBy("vec_id")
        few = fine.select("e", "vec_id").withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
        self.distinct = scratch.put(few.groupBy("e").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("rep", F.array_min("ids")), "distinct")
        asking = fine.where("q").select("vec_id", "e").distinct().join(self.distinct.select("e", "rep"), "e")
        self.asking = scratch.put(asking.select(F.col("vec_id").alias("query_id"), "rep"), "asking")
        asked = self.asking.select("rep").distinct().withColumn("q", F.lit(True))
        self.points = scratch.put(self.distinct.select("rep", "e").join(asked, "rep", "left").select(F.col("rep").alias("id"), "e", F.coalesce("q", F.lit(False)).alias("q")), "points")

    def ranges(self, spread: float, least: int) -> list[tuple[float, float, int]]:
        norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        bins = self.points.select(norm.alias("norm")).groupBy(F.floor(F.log("norm") / float(np.log(spread) / 8)))
        bins = bins.agg(F.min("norm").alias("low"), F.max("norm").alias("high"), F.count("*").alias("n"))
        return norm_ranges([(r["low"], r["high"], r["n"]) for r in bins.collect()], spread, least)  # bounded by the exponents of a float

    def ranked(self, ranges: list[tuple[float, float, int]], curves: int, dims: int, bits: int, seed: int) -> DataFrame:
        """``curve, id, kind, rank``: 0 a row, 1 a query; a query's rank is that of the next row."""
        lows, highs = (np.array([r[at] for r in ranges]) for at in (0, 1))
        orders, dim = orderings(self.dim, curves, dims, seed), self.dim

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                ids, x = b.column(0).to_numpy(), _matrix(b.column(1), dim)
                ask = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
                length = np.linalg.norm(x, axis=1, keepdims=True)
                query = np.hstack([x[ask] / length[ask], np.zeros((len(ask), 1))])
                of = np.minimum((length < lows).sum(1), len(ranges) - 1)
                for g, norm in enumerate(highs):
                    at = np.flatnonzero(of == g)
                    both = np.vstack([np.hstack([x[at], np.sqrt(np.maximum(norm**2 - length[at] ** 2, 0))]) / norm, query])
                    if not len(both):
                        continue
                    kind = pa.array(np.repeat([0, 1], [len(at), len(ask)]).astype(np.int8))
                    whole = pa.array(np.concatenate([ids[at], ids[ask]]))
                    for c, order in enumerate(orders):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(both), g * curves + c, np.int32)), pa.array(curve_keys(both, order, bits)), whole, kind], ["curve", "key", "id", "kind"]
                        )

        rows = curves * sum(r[2] for r in ranges)
        line = self.scratch.put(self.points.mapInArrow(keyed, "curve int, key long, id long, kind byte"), "keyed")
        line = line.repartitionByRange(rows // 250_000 + 1, "curve", "key", "id").withColumn("part", F.spark_partition_id())
        line = self.scratch.put(line, "parts")
        self.scratch.drop("keyed")
        # One count for each (curve, partition): offsets of the ranks.
        counts = line.groupBy("curve", "part").agg(F.sum(1 - F.col("kind")).alias("n"))
        before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        within = Window.partitionBy("curve", "part").orderBy("key", "id", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rank = F.col("start") + F.sum(1 - F.col("kind")).over(within) - (1 - F.col("kind"))
        out = self.scratch.put(line.join(starts, ["curve", "part"]).select("curve", "id", "kind", rank.cast("long").alias("rank")), "ranked")
        self.scratch.drop("parts")
        return out

    def exact(self, sample: int) -> list[tuple[int, int]]:
        """(query, neighbour) pairs of ``sample`` queries, by one pass over all rows."""
        some = self.points.where("q").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "e").collect()
        ids = np.array([r["id"] for r in some], np.int64)
        asked, take, dim = np.array([r["e"] for r in some], np.float64).reshape(-1, self.dim), self.k + 1, self.dim

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for b in batches:
                    if b.num_rows:
                        for a, s, i in _scores(asked, _matrix(b.column(1), dim), b.column(0).to_numpy(), take):
                            yield ids[a : a + len(s)], s, i

            held: list[pa.RecordBatch] = []
            for b in _spread(rows()):
                held.append(b)
                if sum(x.num_rows for x in held) > 2_000_000:
                    held = [_reduced(held, take)]
            if held:
                yield _reduced(held, take)

        found = self.points.select("id", "e").mapInArrow(scan, "query long, id long, score double")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        found = found.withColumn("place", place).where(F.col("place") <= take).where("query <> id").where(F.col("place") <= take)
        return [(r["query"], r["id"]) for r in found.select("query", "id").collect()]  # at most sample * (k + 1) rows

    def distances(self, ranked: DataFrame, pairs: list[tuple[int, int]], curves: int) -> np.ndarray:
        """(pairs, curves) distances of rank, in the neighbour's range."""
        if not pairs:
            return np.empty((0, curves))
        table = F.broadcast(self.spark.createDataFrame(pairs, "query long, id long"))  # bounded by the sample
        own = ranked.where("kind = 0").join(table, "id").select("curve", "query", "id", F.col("rank").alias("r"))
        asks = ranked.where("kind = 1").join(F.broadcast(table.select("query").distinct()), F.col("id") == F.col("query"), "left_semi")
        asks = asks.select("curve", F.col("id").alias("query"), F.col("rank").alias("at"))
        got = own.join(asks, ["curve", "query"]).select("query", "id", (F.col("curve") % curves).alias("c"), F.abs(F.col("r") - F.col("at")).alias("d")).toArrow()
        line = {p: i for i, p in enumerate(pairs)}
        out = np.full((len(pairs), curves), np.inf)
        for q, i, c, d in zip(*(got[n].to_pylist() for n in ("query", "id", "c", "d"))):
            out[line[q, i], c] = d
        return out


def _reduced(batches: list[pa.RecordBatch], take: int) -> pa.RecordBatch:
    """The best of each query in ``batches(query, id, score)``."""
    q, i, s = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in range(3))
    at = _top(q, i, s, take)
    return pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(i[at]), pa.array(s[at])], ["query", "id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, curves: int = 16, dims: int = 8, bits: int = 4, least_block: int = 64,
            target: float = 0.93, sample: int = 256, seed: int = 7, spread: float = 1.25, report: list[Fit] | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each row of ``vectors(vec_id, embedding)`` with ``is_query``.

    ``report`` receives the fitted window.
    """
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "ann")
    space = _Space(vectors, is_query, k, scratch)
    if not space.dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranges = space.ranges(spread, least_block)
    ranked = space.ranked(ranges, curves, dims, bits, seed)
    fit = fit_window(space.distances(ranked, space.exact(sample), curves), [r[2] for r in ranges], target, least_block)
    if report is not None:
        report.append(fit)

    # Every (curve, block) that is read, for each chunk of the queries that meet it.
    wide = [whole_block(n) if r.whole else fit.block for (_, _, n), r in zip(ranges, fit.ranges)]
    spot = [(g, r.curves, r.around, r.whole, wide[g], -(-ranges[g][2] // wide[g])) for g, r in enumerate(fit.ranges)]
    known = F.broadcast(spark.createDataFrame(spot, "g int, used int, around int, whole boolean, wide long, blocks long"))  # one row a range
    line = ranked.withColumn("g", F.floor(F.col("curve") / curves).cast("int")).join(known, "g").where(F.col("curve") % curves < F.col("used"))
    line = line.withColumn("block", F.least(F.floor(F.col("rank") / F.col("wide")), F.col("blocks") - 1))
    asks = line.where("kind = 1").withColumn("width", F.when(F.col("whole"), F.col("blocks")).otherwise(2 * F.col("around") + 1))
    crowd = asks.groupBy("curve", "block").agg(F.ceil(F.count("*") * F.max("width") / CHUNK).alias("chunks"))
    low = F.when(F.col("whole"), 0).otherwise(F.greatest(F.col("block") - F.col("around"), F.lit(0)))
    high = F.when(F.col("whole"), F.col("blocks") - 1).otherwise(F.least(F.col("block") + F.col("around"), F.col("blocks") - 1))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    # A window is 2 * around + 1 blocks long, a tile 4 * around: it meets two tiles at most.
    tile = F.when(F.col("whole"), F.col("block")).otherwise(F.floor(F.col("block") / (4 * F.col("around"))))
    asks = asks.join(crowd, ["curve", "block"]).where(F.col("blocks") > 0).select("curve", chunk.alias("chunk"), "id", "whole", "around", F.explode(F.sequence(low, high)).alias("block"))
    asks = scratch.put(asks.select("curve", tile.alias("tile"), "chunk", "block", "id"), "asks")
    by = ["curve", "tile", "chunk", "block"]
    needed = asks.select(*by).distinct()
    rows = line.where("kind = 0").select("curve", "block", "id").join(needed, ["curve", "block"])
    both = rows.select(*by, F.lit(0).alias("kind"), "id").union(asks.select(*by, F.lit(1).alias("kind"), "id"))
    sent = both.join(space.points.select("id", "e"), "id").repartition(*by[:3]).sortWithinPartitions(*by, F.desc("kind"))
    take, dim = k + 1, space.dim

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most, last = [], 0, 400_000, None
        for (*tile, _), b in _streamed(batches, by, dim, take):
            if n > 400_000 and tile != last:  # only whole tiles leave
                held = [_reduced(held, take)]
                n, most = held[0].num_rows, 400_000
                if n > 200_000:
                    yield held[0]
                    held, n = [], 0
            elif n > most:
                held = [_reduced(held, take)]
                n = held[0].num_rows
                most = max(400_000, 2 * n)
            held.append(b)
            n += b.num_rows
            last = tile
        if held:
            yield _reduced(held, take)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of each query, out of rows sorted by query."""
        held, n = [], 0
        for t in _blocks(batches, ["query"]):
            held += t.to_batches()
            n += t.num_rows
            if n > 200_000:
                yield _reduced(held, take)
                held, n = [], 0
        if held:
            yield _reduced(held, take)

    near = sent.select(*by, "kind", "id", "e").mapInArrow(scored, "query long, id long, score double")
    near = near.repartition("query").sortWithinPartitions("query").mapInArrow(merged, "query long, id long, score double")
    near = scratch.put(near, "near")
    # Back to all ids: those of equal vectors and those that ask with an equal vector.
    wide = near.join(space.distinct.select(F.col("rep").alias("id"), "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
    each = space.asking.join(wide, F.col("rep") == F.col("query")).where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = scratch.put(out, "out")
    scratch.drop("distinct", "asking", "points", "ranked", "asks", "near")
    return out
