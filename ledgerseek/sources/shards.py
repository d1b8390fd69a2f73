"""Shard store: documents in Parquet by block range, with boundaries, integrity, gaps and retention.

A shard holds the blocks ``[base, base + size - 1]``.  Files are sorted by block and hold as many shards as fit, so their number
follows the documents, not the shards; a file lies in ``shard_base=<its first shard>/shard_last=<its last one>``, so ranges prune folders and row groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shard_base(block: Column | str, size: int) -> Column:
    b = F.col(block) if isinstance(block, str) else block
    return b - F.pmod(b, F.lit(size))


def write_sorted(docs: DataFrame, path: str) -> None:
    """Documents into sorted files; a range partitioning splits large shards over tasks, and small shards share a file."""
    out = docs.drop("shard_base").repartitionByRange("block_num").sortWithinPartitions("block_num", "trx_idx", "action_idx")
    out.write.option("compression", "zstd").parquet(path)


def shards_of_files(spark: SparkSession, path: str, size: int) -> DataFrame:
    """``file, shard_base``: the shards that each file of :func:`write_sorted` has documents of."""
    return spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), shard_base("block_num", size).alias("shard_base")).distinct()


def hadoop_path(spark: SparkSession, path: str):
    """(the path, its file system)."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return to, to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def move(spark: SparkSession, path: str, to: str) -> None:
    """A rename to a place that is free; raises where it is taken or the rename fails."""
    (source, files), (target, _) = hadoop_path(spark, path), hadoop_path(spark, to)
    files.mkdirs(target.getParent())
    if files.exists(target) or not files.rename(source, target):
        raise OSError(f"{path} can't be moved to {to}")


def put_in_place(spark: SparkSession, path: str, files: Iterable[tuple[str, int | None, int | None]], to: str) -> None:
    """``files`` (name, first shard, last shard) of :func:`write_sorted` into the folders of their shards under ``to``."""
    for name, first, last in files:
        first, last = ("__HIVE_DEFAULT_PARTITION__" if base is None else base for base in (first, last))
        move(spark, f"{path}/{name}", f"{to}/shard_base={first}/shard_last={last}/{name}")


def put_all_in_place(spark: SparkSession, path: str, to: str, size: int) -> None:
    spans = shards_of_files(spark, path, size).groupBy("file").agg(F.min("shard_base"), F.max("shard_base"))
    put_in_place(spark, path, map(tuple, spans.collect()), to)  # one row a file


def write(docs: DataFrame, path: str, size: int) -> None:
    """Documents into files by shards, under a new ``path``."""
    write_sorted(docs, path)
    put_all_in_place(docs.sparkSession, path, path, size)


def read(spark: SparkSession, path: str, low: int, high: int, size: int, runs: Sequence[str] | None = None) -> DataFrame:
    """Documents of a range: partition filter and row-group filter; of the folders ``runs`` under ``path`` only, if given."""
    docs = spark.read.option("basePath", path).parquet(*([path] if runs is None else [f"{path}/{r}" for r in runs]))
    docs = docs.where((F.col("shard_base") <= high) & (F.col("shard_last") >= low - low % size)).where(F.col("block_num").between(low, high))
    return docs.withColumn("shard_base", shard_base("block_num", size)).drop("shard_last", "shard_run")


def within(shards: DataFrame, start: int, stop: int) -> DataFrame:
    """Shards of the range that is served: bases from ``start`` on and below ``stop`` (0: no end)."""
    return shards.where((F.col("shard_base") >= start) & (F.lit(stop == 0) | (F.col("shard_base") < stop)))


def stop_before(blocks: DataFrame, stop: int) -> DataFrame:
    """The stop block itself is left out."""
    return blocks.where(F.col("block_num") < stop)


def summary(docs: DataFrame, size: int) -> DataFrame:
    """``shard_base, start_num, end_num, n_blocks, n_docs``."""
    blocks = docs.groupBy("block_num").agg(F.count("*").alias("n"))
    return blocks.groupBy(shard_base("block_num", size).alias("shard_base")).agg(
        F.min("block_num").alias("start_num"), F.max("block_num").alias("end_num"), F.count("*").alias("n_blocks"), F.sum("n").alias("n_docs")
    )


def integrity(docs: DataFrame, size: int, first_block: int = 0) -> DataFrame:
    """``shard_base, n_blocks, lo, hi, ok``: a shard is whole if it has all its blocks; the chain's first shard may start late."""
    first = F.when(F.col("shard_base") == first_block - first_block % size, first_block % size).otherwise(0)
    return summary(docs, size).select(
        "shard_base", "n_blocks", F.col("start_num").alias("lo"), F.col("end_num").alias("hi"),
        ((F.col("n_blocks") == size - first) & (F.col("end_num") - F.col("start_num") == size - 1 - first)).alias("ok"),
    )


def gaps(docs: DataFrame, size: int) -> DataFrame:
    """``prev_block, next_block`` on either side of each hole inside a shard."""
    blocks = docs.select("block_num").distinct()
    after = F.lead("block_num").over(Window.partitionBy(shard_base("block_num", size)).orderBy("block_num"))
    return blocks.select(F.col("block_num").alias("prev_block"), after.alias("next_block")).where("next_block > prev_block + 1")


def next_unindexed(shards: DataFrame, size: int, start: int = 0) -> DataFrame:
    """``next_base``: the first base from ``start`` on that ``shards(shard_base)`` lacks."""
    own = shards.where(F.col("shard_base") >= start).select("shard_base")
    following = own.select((F.col("shard_base") + size).alias("shard_base"))
    first = own.sparkSession.range(1).select(F.lit(start).cast("long").alias("shard_base"))
    return following.union(first).join(own, "shard_base", "left_anti").agg(F.min("shard_base").alias("next_base"))


def contiguous_prefix(shards: DataFrame, size: int, start: int = 0) -> DataFrame:
    """The shards before the first gap."""
    gap = F.broadcast(next_unindexed(shards, size, start))  # one row
    return shards.join(gap, (F.col("shard_base") < F.col("next_base")) & (F.col("shard_base") >= start)).select("shard_base")


def retained(shards: DataFrame, irreversible: int, blocks: int, size: int, leeway: int = 0) -> DataFrame:
    """Shards that stay when the last ``blocks`` blocks (and ``leeway`` shards more) are kept; never below block 0."""
    target = max(0, irreversible - blocks - leeway * size)
    return shards.where(F.col("shard_base") >= target - target % size)
