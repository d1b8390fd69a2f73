"""Matches: filter, group to transactions, rank in the block, page by cursor and limit.

One plan for a whole range: block range and predicate at the scan, one exchange by block
for grouping and ranking, a top-k for a limit.  Ranks are taken over all matches of a
block before cursor and limit cut the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import Fields, compile_predicate
from ..plans import sqe
from ..plans.bounds import PREFIX_LENGTH, Cursor
from ..sources.bindings import Binding
from ..sources.shards import shard_base


@dataclass(frozen=True)
class Query:
    """A parsed filter; ``validate`` may raise on field names, ``rename`` and ``rewrite`` transform fields and values."""

    expr: sqe.Expression
    names: frozenset[str] = field(default_factory=frozenset)

    @staticmethod
    def of(text: str, rename: Callable[[str], str] | None = None, rewrite: Callable[[str, sqe.Literal], str] | None = None,
           validate: Callable[[Collection[str]], None] | None = None) -> Query:
        expr = sqe.parse(text)
        if rename or rewrite:
            expr = sqe.transform(expr, rename, rewrite)
        names = frozenset(sqe.fields(expr))
        if validate:
            validate(names)
        return Query(expr, names)

    @property
    def fingerprint(self) -> str:
        return sqe.fingerprint(self.expr)

    def predicate(self, fields: Fields) -> Column:
        return compile_predicate(self.expr, fields)


def documents(spark: SparkSession, sf_dir: str, binding: Binding, query: Query, low: int, high: int) -> DataFrame:
    """Matching documents of ``[low, high]``."""
    docs = binding.docs(spark, sf_dir, query.names, low, high)
    return docs.where(F.col("block_num").between(low, high)).where(query.predicate(binding.fields))


def transactions(docs: DataFrame, descending: bool = False, collect: Callable[[], Sequence[Column]] | None = None) -> DataFrame:
    """``block_num, trx_idx, trx_id, match_index, action_idxs`` of matching documents: one row for each transaction.

    ``collect`` is the collector hook: further aggregates over a transaction's matching documents (named columns).
    The exchange by block serves the grouping and the ranking; a block is bounded.
    """
    more = list(collect()) if collect else []
    grouped = docs.repartition("block_num").groupBy("block_num", "trx_idx", "trx_id").agg(F.array_sort(F.collect_list("action_idx")).alias("actions"), *more)
    extra = grouped.columns[4:]
    place = Window.partitionBy("block_num").orderBy(F.desc("trx_idx") if descending else F.asc("trx_idx"))
    return grouped.select(
        "block_num", "trx_idx", "trx_id", (F.row_number().over(place) - 1).cast("long").alias("match_index"),
        F.array_join(F.col("actions").cast("array<string>"), ",").alias("action_idxs"), *extra,
    )


def prefix(c: Column | str = "trx_id") -> Column:
    return F.substring(c, 1, PREFIX_LENGTH)


def cursor_text(head_id: str = "") -> Column:
    return F.concat(F.lit("1:"), F.col("block_num").cast("string"), F.lit(f":{head_id}:"), prefix())


def after_cursor(matches: DataFrame, cursor: Cursor, descending: bool) -> DataFrame:
    """Matches strictly behind the cursor in the direction of travel; none if its transaction doesn't match.

    The anchor is looked up in the cursor's block only.
    """
    if not cursor.trx_prefix:
        return matches.where(F.col("block_num") < cursor.block if descending else F.col("block_num") > cursor.block)
    order = F.desc("trx_idx") if descending else F.asc("trx_idx")
    anchor = matches.where(F.col("block_num") == cursor.block).where(F.col("trx_id").startswith(cursor.trx_prefix)).orderBy(order).select("trx_idx").first()
    if anchor is None:
        return matches.where(F.lit(False))
    b, i = F.col("block_num"), F.col("trx_idx")
    if descending:
        return matches.where((b < cursor.block) | ((b == cursor.block) & (i < anchor[0])))
    return matches.where((b > cursor.block) | ((b == cursor.block) & (i > anchor[0])))


def in_order(matches: DataFrame, descending: bool = False) -> DataFrame:
    to = F.desc if descending else F.asc
    return matches.orderBy(to("block_num"), to("trx_idx"))


def page(found: DataFrame, descending: bool = False, limit: int = 0, cursor: Cursor | None = None, archive_compat: bool = False,
         payload: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Result rows of ranked transactions, in traversal order; ``payload`` is the decoration hook: it adds columns to the rows of the page."""
    if cursor is not None:
        found = after_cursor(found, cursor, descending)
    found = in_order(found, descending)
    if limit:
        found = found.limit(limit)
    own = {"block_num", "trx_idx", "trx_id", "match_index", "action_idxs"}
    extra = [c for c in found.columns if c not in own]
    if payload:
        found = payload(found)
        extra = [c for c in found.columns if c not in own]
    rank = F.lit(0).cast("long") if archive_compat else F.col("match_index")
    return found.select("block_num", prefix().alias("trx_id_prefix"), rank.alias("match_index"), "action_idxs", cursor_text().alias("cursor"), F.col("block_num").alias("irr_block_num"), *extra)


def find(spark: SparkSession, sf_dir: str, binding: Binding, query: Query, low: int, high: int, descending: bool = False,
         limit: int = 0, cursor: Cursor | None = None, archive_compat: bool = False) -> DataFrame:
    """``block_num, trx_id_prefix, match_index, action_idxs, cursor, irr_block_num``, in traversal order."""
    if cursor is not None:  # the page starts in the cursor's block, whose ranks need all its matches
        low, high = (low, min(high, cursor.block)) if descending else (max(low, cursor.block), high)
    return page(transactions(documents(spark, sf_dir, binding, query, low, high), descending), descending, limit, cursor, archive_compat)


@dataclass(frozen=True)
class Outcome:
    """What a page says beside its rows."""

    limit_reached: bool
    range_completed: bool


def outcome(page: DataFrame, limit: int, covered: bool = True) -> Outcome:
    """``limit_reached`` also when exactly ``limit`` rows existed."""
    reached = bool(limit) and page.count() == limit
    return Outcome(reached, covered and not reached)


def first_matches(spark: SparkSession, sf_dir: str, binding: Binding, query: Query, low: int, high: int, limit: int, descending: bool = False, shards: int = 4) -> DataFrame:
    """A small limit over a huge range: windows of shards, four times as wide each time, until the limit is reached."""
    width = shards * binding.shard_size
    out, at, left = None, (high if descending else low), limit
    while left and low <= at <= high:
        a, b = (max(low, at - width + 1), at) if descending else (at, min(high, at + width - 1))
        page = find(spark, sf_dir, binding, query, a, b, descending, left)
        found = page.count()
        left -= found
        if found:
            out = page if out is None else out.union(page)
        at, width = (a - 1 if descending else b + 1), 4 * width
    return out if out is not None else find(spark, sf_dir, binding, query, low, low, descending).where(F.lit(False))


def undo(spark: SparkSession, sf_dir: str, binding: Binding, query: Query, blocks: list[int]) -> DataFrame:
    """Matches of forked blocks to take back: newest block first, matches within a block backwards; ranks count forwards."""
    docs = binding.docs(spark, sf_dir, query.names).where(F.col("block_num").isin(blocks)).where(query.predicate(binding.fields))
    found = transactions(docs).orderBy(F.desc("block_num"), F.desc("match_index"))
    return found.select(
        "block_num", prefix().alias("trx_id_prefix"), "match_index", "action_idxs", F.lit(max(0, min(blocks) - 1)).cast("long").alias("irr_block_num"), F.lit(True).alias("undo")
    )


def undo_by_id(docs: DataFrame, query: Query, fields: Fields, dead: DataFrame) -> DataFrame:
    """Matches to take back of exactly the blocks in ``dead(id)``, out of ``docs`` with a block ``id``: two blocks of one number are told apart.

    Newest block first, matches within a block backwards; ranks count forwards.  ``irr_block_num`` is the block below the lowest dead one.
    """
    found = docs.join(dead.select("id").distinct(), "id", "left_semi").where(query.predicate(fields))
    grouped = found.groupBy("id", "block_num", "trx_idx", "trx_id").agg(F.array_sort(F.collect_list("action_idx")).alias("actions"))
    place = Window.partitionBy("id").orderBy("trx_idx")
    lowest = docs.join(dead.select("id").distinct(), "id", "left_semi").agg(F.greatest(F.min("block_num") - 1, F.lit(0)).alias("irr_block_num"))  # one row
    rows = grouped.select(
        "id", "block_num", prefix().alias("trx_id_prefix"), (F.row_number().over(place) - 1).cast("long").alias("match_index"),
        F.array_join(F.col("actions").cast("array<string>"), ",").alias("action_idxs"), F.lit(True).alias("undo"),
    )
    return rows.join(F.broadcast(lowest)).orderBy(F.desc("block_num"), F.desc("id"), F.desc("match_index"))


def empty_shards(spark: SparkSession, sf_dir: str, binding: Binding, query: Query, low: int = 0, high: int = 1 << 60) -> DataFrame:
    """``query_fp, shard_size, shard_base`` of the shards in which a request of ``[low, high]`` finds nothing.

    A shard that the request covers in part only is not listed: its other blocks are not known.
    """
    size = binding.shard_size
    base = shard_base("block_num", size).alias("shard_base")
    every = binding.docs(spark, sf_dir, (), low, high).where(F.col("block_num").between(low, high)).select(base).distinct()
    every = every.where((F.col("shard_base") >= low) & (F.col("shard_base") + size - 1 <= high))
    hit = documents(spark, sf_dir, binding, query, low, high).select(base).distinct()
    return every.join(hit, "shard_base", "left_anti").select(F.lit(query.fingerprint).alias("query_fp"), F.lit(size).alias("shard_size"), "shard_base")


class EmptyResults:
    """Empty shards of earlier queries, kept in a Parquet table beside the store: entries expire after ``days``."""

    def __init__(self, spark: SparkSession, path: str, days: int = 30):
        self.spark, self.path, self.days = spark, path, days

    def publish(self, empty: DataFrame) -> None:
        """Appends ``query_fp, shard_size, shard_base``; a query's rows lie in a folder of its own, so reading prunes."""
        rows = empty.withColumn("at", F.current_timestamp())
        rows.repartition("query_fp").write.mode("append").partitionBy("query_fp").parquet(self.path)

    def of(self, query: Query, size: int) -> DataFrame:
        """``query_fp, shard_size, shard_base`` known to be empty for this query."""
        schema = "shard_size int, shard_base long, at timestamp, query_fp string"
        try:
            known = self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException:  # nothing was published yet
            known = self.spark.createDataFrame([], schema)
        fresh = F.col("at") > F.current_timestamp() - F.make_interval(days=F.lit(self.days))
        return known.where((F.col("query_fp") == query.fingerprint) & (F.col("shard_size") == size) & fresh).select("query_fp", "shard_size", "shard_base").distinct()


@dataclass
class QueryMetrics:
    """What a listing cost: filled by Spark while the listing runs, through an observation of its rows."""

    began: float = field(default_factory=time.perf_counter)
    seconds: float = 0.0
    matches: int = 0
    shards_with_matches: int = 0
    lowest: int | None = None
    highest: int | None = None

    def watch(self, found: DataFrame, shard_size: int) -> tuple[DataFrame, Callable[[], QueryMetrics]]:
        """(the same rows, a function that gives the figures once they have been read)."""
        seen = Observation()
        base = shard_base("block_num", shard_size)
        watched = found.observe(seen, F.count("*").alias("n"), F.approx_count_distinct(base).alias("s"), F.min("block_num").alias("lo"), F.max("block_num").alias("hi"))

        def done() -> QueryMetrics:
            got = seen.get
            self.seconds, self.matches, self.shards_with_matches = time.perf_counter() - self.began, got["n"], got["s"]
            self.lowest, self.highest = got["lo"], got["hi"]
            return self

        return watched, done


def skipping(docs: DataFrame, empty: DataFrame, query: Query, size: int) -> DataFrame:
    """``docs`` without the shards known to be empty for this query (an anti-join, so the list may be long)."""
    own = empty.where((F.col("query_fp") == query.fingerprint) & (F.col("shard_size") == size)).select("shard_base")
    return docs.withColumn("shard_base", shard_base("block_num", size)).join(own, "shard_base", "left_anti").drop("shard_base")
