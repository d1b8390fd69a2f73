"""The folder that driver and executors share, for tables and checkpoints between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset on a single machine, a folder beside the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, path: str) -> DataFrame:
    """All rows of a stream that has caught up, through a table under ``path`` (restarts go on from its checkpoint)."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
