"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import fresh_dir

#: Text handled at once inside a Python worker; numpy work arrays are a small multiple of it.
CHUNK_BYTES = 1_000_000


def tune(spark: SparkSession) -> None:
    """Session settings the operators rely on: small Arrow batches (long texts) and early removal of shuffle files."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Scratch:
    """Written tables in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = fresh_dir(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _in(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        """Removes tables that no later plan reads."""
        for name in names:
            path, files = self._in(name)
            files.delete(path, True)

    def paths(self, pattern: str) -> list[str]:
        """Tables whose names match."""
        path, files = self._in(pattern)
        return [found.getPath().toString() for found in files.globStatus(path)]


def trim() -> None:
    """Gives memory that a task has freed back to the machine: Python workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if release:
        release(0)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``limit`` bytes of ``column`` (at least one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = values.is_valid().to_numpy(zero_copy_only=False) * np.nan_to_num(
            pa.compute.binary_length(values).to_numpy(zero_copy_only=False).astype("f8")
        )
        group = (np.cumsum(sizes) // limit).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    trim()


class WordHashes(dict):
    """64-bit hash of each word (bytes), computed once for each distinct word while it stays in the table."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise on uint64."""
    z = values.astype(np.uint64, copy=True)
    z += np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def rolling(words: np.ndarray, n: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of ``n`` neighbouring word hashes (length len(words) - n + 1, at least 0); another odd factor gives another hash."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(factor)
        out += words[k : k + m]
    return mix(out)
