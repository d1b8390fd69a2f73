"""A store of shards: staged, checked, published, followed, cleaned, and read with pruning.

``path/docs/shard_run=<id>`` holds the documents that were published at once, in files as :mod:`.shards` has them, and ``path/meta/shard_run=<id>`` one row
of boundaries for each of their shards.  Both are written in a staging folder, checked, and moved to their places by renames, the one of ``meta``
last; a reader takes the runs that ``meta`` has, so it sees whole shards only.  Files and renames follow the documents, not the shards; the driver has a row a file, and the shards' numbers where it returns them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.bounds import RangeError
from ..plans.segments import Segment
from . import shards

META = "shard_base long, start_num long, start_id string, start_time timestamp, end_num long, end_id string, end_time timestamp, n_blocks long, n_docs long"


def boundaries(docs: DataFrame, size: int) -> DataFrame:
    """First and last block of each shard with id and time, out of ``docs(block_num, block_id, block_time)``; see META."""
    blocks = docs.groupBy("block_num").agg(F.min("block_id").alias("id"), F.min(F.col("block_time").cast("timestamp")).alias("time"), F.count("*").alias("n"))
    end = lambda f, x: f(F.col(x), F.col("block_num"))
    return blocks.groupBy(shards.shard_base("block_num", size).alias("shard_base")).agg(
        F.min("block_num").alias("start_num"), end(F.min_by, "id").alias("start_id"), end(F.min_by, "time").alias("start_time"),
        F.max("block_num").alias("end_num"), end(F.max_by, "id").alias("end_id"), end(F.max_by, "time").alias("end_time"),
        F.count("*").alias("n_blocks"), F.sum("n").alias("n_docs"),
    )


def faults(meta: DataFrame, size: int, first_block: int = 0) -> DataFrame:
    """``shard_base, faults array<string>``: all that is wrong with each shard's boundaries and blocks; empty for a whole shard."""
    return meta.select("shard_base", _faults(size, first_block).alias("faults"))


def _faults(size: int, first_block: int) -> Column:
    start = F.greatest(F.col("shard_base"), F.lit(first_block))
    last = F.col("shard_base") + size - 1
    tests = {
        "start has no id": F.coalesce("start_id", F.lit("")) == "",
        "end has no id": F.coalesce("end_id", F.lit("")) == "",
        "start has no time": F.col("start_time").isNull(),
        "end has no time": F.col("end_time").isNull(),
        "end is block 0": F.col("end_num") == 0,
        "first block is missing": F.col("start_num") != start,
        "last block is missing": F.col("end_num") != last,
        "blocks are missing": F.col("n_blocks") != F.col("end_num") - F.col("start_num") + 1,
    }
    return F.filter(F.array(*(F.when(bad, name) for name, bad in tests.items())), lambda x: x.isNotNull())


def analyze(meta: DataFrame, size: int, first_block: int = 0) -> DataFrame:
    """The report on a store: boundaries, counts and faults of every shard, and whether the next shard follows without a gap."""
    following = meta.select((F.col("shard_base") - size).alias("shard_base"), F.lit(True).alias("followed"))
    return meta.join(faults(meta, size, first_block), "shard_base").join(following, "shard_base", "left").withColumn("followed", F.coalesce("followed", F.lit(False)))


@dataclass
class ShardStore:
    """Shards of ``size`` blocks under ``path``."""

    spark: SparkSession
    path: str
    size: int
    first_block: int = 0
    #: block filter hook: runs on blocks' documents before anything else reads them
    block_filter: Callable[[DataFrame], DataFrame] | None = None

    def _files(self, name: str):
        return shards.hadoop_path(self.spark, f"{self.path}/{name}")

    def _delete(self, name: str) -> None:
        path, files = self._files(name)
        files.delete(path, True)

    def _names(self, name: str) -> list[str]:
        """Names of what a folder has; none if there is no folder."""
        path, files = self._files(name)
        return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []

    def _listed(self) -> DataFrame:
        """:meth:`meta` with the run that a shard is in."""
        schema = f"{META}, shard_run string"
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.path}/meta")
        except AnalysisException:
            found = self.spark.createDataFrame([], schema)
        return found.dropDuplicates(["shard_base"])

    def meta(self) -> DataFrame:
        """Boundaries of the published shards."""
        return self._listed().drop("shard_run")

    def publish(self, docs: DataFrame, whole: bool = True) -> list[int]:
        """Stages, checks and publishes the shards of ``docs``; the bases published.  Shards with faults (``whole``) or
        that are there already are left out.  The list is one number a shard."""
        run = self._publish(self.block_filter(docs) if self.block_filter else docs, whole)
        if run is None:
            return []
        return sorted(r[0] for r in self.spark.read.parquet(f"{self.path}/meta/{run}").select("shard_base").collect())

    def _publish(self, docs: DataFrame, whole: bool, rest: str | None = None) -> str | None:
        """The run published, None if no shard was; the documents of all other shards go to the folder ``rest``.

        Files whose shards are all published are moved; the others only are written again.
        """
        staging, run = f"staging-{uuid.uuid4().hex}", f"shard_run=r{uuid.uuid4().hex}"
        at = f"{self.path}/{staging}"
        shards.write_sorted(docs, f"{at}/sorted")
        staged = self.spark.read.parquet(f"{at}/sorted")
        meta = boundaries(staged, self.size).where("shard_base is not null").join(self.meta().select("shard_base"), "shard_base", "left_anti")
        if whole:
            meta = meta.where(F.size(_faults(self.size, self.first_block)) == 0)
        meta.write.parquet(f"{at}/meta")
        own = self.spark.read.parquet(f"{at}/meta").select("shard_base")
        files = shards.shards_of_files(self.spark, f"{at}/sorted", self.size).join(own.withColumn("own", F.lit(True)), "shard_base", "left")
        is_own = F.coalesce("own", F.lit(False))
        found = files.groupBy("file").agg(F.bool_and(is_own).alias("all"), F.bool_or(is_own).alias("some"), F.min("shard_base").alias("lo"), F.max("shard_base").alias("hi")).collect()  # one row a file
        base = shards.shard_base("block_num", self.size) == F.col("shard_base")
        if mixed := [f"{at}/sorted/{r['file']}" for r in found if r["some"] and not r["all"]]:
            shards.write_sorted(self.spark.read.parquet(*mixed).join(own, base, "left_semi"), f"{at}/again")
            shards.put_all_in_place(self.spark, f"{at}/again", f"{at}/docs", self.size)
        if rest and (left := [f"{at}/sorted/{r['file']}" for r in found if not r["all"]]):
            self.spark.read.parquet(*left).join(own, base, "left_anti").write.parquet(rest)
        shards.put_in_place(self.spark, f"{at}/sorted", [(r["file"], r["lo"], r["hi"]) for r in found if r["all"]], f"{at}/docs")
        published = any(r["some"] for r in found)
        if published:  # the rows of the shards come last: what meta lists is in place
            shards.move(self.spark, f"{at}/docs", f"{self.path}/docs/{run}")
            shards.move(self.spark, f"{at}/meta", f"{self.path}/meta/{run}")
        self._delete(staging)
        return run if published else None

    def _take(self, batch: DataFrame, number: int) -> None:
        """Publishes the shards that are complete with one micro-batch and what earlier ones left; what this one leaves is
        ``inbox/batch=<number>``.  A restart that repeats the batch finds its predecessor's there."""
        docs = self.block_filter(batch) if self.block_filter else batch
        numbers = sorted(int(name.partition("=")[2]) for name in self._names("inbox"))
        earlier = [n for n in numbers if n < number]
        if earlier and any(name.endswith(".parquet") for name in self._names(f"inbox/batch={earlier[-1]}")):
            docs = docs.unionByName(self.spark.read.parquet(f"{self.path}/inbox/batch={earlier[-1]}"))
        done = self.meta().select(F.col("shard_base").alias("__done"))
        rest = f"inbox/batch={number}"
        self._delete(rest)
        self._publish(docs.join(done, shards.shard_base("block_num", self.size) == F.col("__done"), "left_anti"), True, f"{self.path}/{rest}")
        path, files = self._files(rest)
        files.mkdirs(path)
        for n in earlier[:-1]:
            self._delete(f"inbox/batch={n}")

    def ingest(self, docs: DataFrame, follow: bool = False):
        """Batch documents are published at once; those of a stream by the same way as their shards become complete.

        A stream stops when it has caught up; with ``follow`` the running query is returned.
        """
        if not docs.isStreaming:
            return self.publish(docs)
        sink = docs.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.path}/checkpoint")
        if follow:
            return sink.start()
        sink.trigger(availableNow=True).start().awaitTermination()
        return sorted(r["shard_base"] for r in self.meta().select("shard_base").collect())

    def check_contiguous(self) -> None:
        """Raises where a shard is missing between the first and the last one."""
        own = self.meta().select("shard_base")
        got = own.agg(F.min("shard_base").alias("lo"), F.max("shard_base").alias("hi"), F.count("*").alias("n")).first()
        if got["n"] and got["hi"] - got["lo"] != (got["n"] - 1) * self.size:
            gap = shards.next_unindexed(own, self.size, got["lo"]).first()[0]
            raise ValueError(f"the store has no shard {gap}, but later ones")

    def clean(self, start: int, stop: int = 0) -> list[int]:
        """Removes the shards outside [start, stop); the bases removed."""
        meta = self._listed()
        stay = shards.within(meta, start, stop)
        gone = sorted(r[0] for r in meta.join(stay.select("shard_base"), "shard_base", "left_anti").select("shard_base").collect())
        if not gone:
            return gone
        staging = f"staging-{uuid.uuid4().hex}"
        stay.repartition("shard_run").write.partitionBy("shard_run").parquet(f"{self.path}/{staging}/meta")
        stale, cut = [], {}
        for run in self._names("meta"):
            for first in self._names(f"docs/{run}"):
                for last in self._names(f"docs/{run}/{first}"):
                    lo, hi = (int(x.partition("=")[2]) for x in (first, last))
                    if lo < start or (stop and hi >= stop):
                        stale.append(f"docs/{run}/{first}/{last}")
                        if hi >= start and not (stop and lo >= stop):
                            cut.setdefault(run, []).append(f"{self.path}/{stale[-1]}")
        for run, paths in cut.items():  # files with shards on both sides are written again
            kept = shards.within(self.spark.read.parquet(*paths).withColumn("shard_base", shards.shard_base("block_num", self.size)), start, stop)
            shards.write_sorted(kept, f"{self.path}/{staging}/{run}")
        self._delete("meta")
        shards.move(self.spark, f"{self.path}/{staging}/meta", f"{self.path}/meta")
        for name in stale:
            self._delete(name)
        for run in cut:
            shards.put_all_in_place(self.spark, f"{self.path}/{staging}/{run}", f"{self.path}/docs/{run}", self.size)
        for run in set(self._names("docs")) - set(self._names("meta")):
            self._delete(f"docs/{run}")
        self._delete(staging)
        return gone

    def segment(self, name: str, tier: int = 0, moving: bool = True) -> Segment | None:
        """What the store serves, for the planner: None while it is empty."""
        got = self.meta().agg(F.min("start_num").alias("lo"), F.max("end_num").alias("hi")).first()
        return None if got["lo"] is None else Segment(name, got["lo"], got["hi"], got["hi"], tier, moving_head=moving)

    def read(self, low: int, high: int) -> DataFrame:
        """Documents of a range: the range is a filter on partitions and, by the files' order, on row groups."""
        return shards.read(self.spark, f"{self.path}/docs", low, high, self.size, [name for name in self._names("meta") if name.startswith("shard_run=")])

    def check_bounds(self, low: int, high: int, descending: bool = False) -> None:
        """Raises for a request whose first block the store does not hold."""
        own = self.segment("own")
        edge = high if descending else low
        if own is None or not own.tail <= edge <= own.head:
            raise RangeError(f"block {edge} is not in this store" + ("" if own is None else f", which holds {own.tail} to {own.head}"))
