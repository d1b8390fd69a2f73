"""Bindings: how a set of tables reads as a ledger (blocks of transactions of actions).

A binding's ``docs`` are one row for each action: ``block_num, trx_idx, trx_id, action_idx``
and the asked fields.  Tables that no asked field needs are not joined.  A range of blocks is
given as one of the tables' own columns (order day, event number), so it is pushed down to their scans;
windows are partitioned by block, so ranks don't change.  Lines have no block of their own: they are joined by key, and
:mod:`.store` keeps them with their ranks, block and shard for repeated reading.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import Fields

KEYS = ("block_num", "trx_idx", "trx_id", "action_idx")


@dataclass(frozen=True)
class Binding:
    name: str
    fields: Fields
    #: (spark, sf_dir, field names, lowest block or None, highest block or None) -> documents
    docs: Callable[..., DataFrame]
    shard_size: int


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: first day of the LEDGER chain
EPOCH = "1995-01-01"
_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


#: blocks of a range beyond which its end is no date that Spark can state
_LAST_DAY = 2_000_000


def ledger_transactions(spark: SparkSession, sf_dir: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Orders as transactions; the order day is the block."""
    orders = read(spark, sf_dir, "orders")
    day = date.fromisoformat(EPOCH)
    stamp = lambda n: F.lit((day + timedelta(days=n)).isoformat()).cast(orders.schema["o_orderdate"].dataType)
    if low is not None and low > -_LAST_DAY // 4:
        orders = orders.where(F.col("o_orderdate") >= stamp(min(low, _LAST_DAY)))
    if high is not None and high < _LAST_DAY:
        orders = orders.where(F.col("o_orderdate") < stamp(max(high + 1, -_LAST_DAY // 4)))
    orders = orders.withColumn("block_num", F.datediff("o_orderdate", F.lit(EPOCH)).cast("long"))
    rank = F.row_number().over(Window.partitionBy("block_num").orderBy("o_orderkey")) - 1
    return orders.select("block_num", rank.alias("trx_idx"), F.col("o_orderkey").cast("string").alias("trx_id"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def _ledger(spark: SparkSession, sf_dir: str, fields: Collection[str], low: int | None = None, high: int | None = None) -> DataFrame:
    trx = ledger_transactions(spark, sf_dir, low, high)
    if "segment" in fields:
        trx = trx.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    line = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    if {"brand", "ptype", "promo"} & set(fields):
        line = line.join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    place = Window.partitionBy("block_num", "o_orderkey").orderBy(*_LINE_ORDER)
    docs = trx.join(line, "o_orderkey").withColumn("action_idx", F.row_number().over(place) - 1)
    own = {
        "returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"),
        "tag": F.array("l_returnflag", "l_linestatus"), "urgent": F.col("o_orderpriority") == "1-URGENT", "big": F.col("l_quantity") > 25,
        "segment": F.col("c_mktsegment") if "segment" in fields else None,
    }
    if {"brand", "ptype", "promo"} & set(fields):
        own |= {"brand": F.col("p_brand"), "ptype": F.col("p_type"), "promo": F.when(F.col("p_type") == "PROMO", F.col("p_brand"))}
    return docs.select(*KEYS, *(own[f].alias(f) for f in own if f in fields))


LEDGER = Binding(
    "ledger",
    Fields(
        {f: f for f in ("returnflag", "linestatus", "status", "priority", "segment", "brand", "ptype", "promo")}, {"tag": "tag"}, {"urgent": "urgent", "big": "big"}
    ),
    _ledger, 100,
)


def _events(spark: SparkSession, sf_dir: str, fields: Collection[str], low: int | None = None, high: int | None = None) -> DataFrame:
    events = read(spark, sf_dir, "events")
    if low is not None:
        events = events.where(F.col("event_id") >= low * 20)
    if high is not None and high < 1 << 58:
        events = events.where(F.col("event_id") < (high + 1) * 20)
    return event_docs(events, fields)


def event_docs(events: DataFrame, fields: Collection[str]) -> DataFrame:
    """20 events a block, 2 a transaction."""
    own = {
        "event_type": F.col("event_type"), "kind2": F.when(F.col("event_type").isin("click", "view"), F.col("event_type")),
        "props.k": F.get_json_object("props", "$.k"), "high": F.col("value") > 100,
    }
    return events.select(
        F.expr("event_id div 20").alias("block_num"),
        F.expr("cast(event_id % 20 div 2 as int)").alias("trx_idx"),
        F.expr("cast(event_id div 2 as string)").alias("trx_id"),
        F.expr("cast(event_id % 2 as int)").alias("action_idx"),
        *(c.alias(f) for f, c in own.items() if f in fields),
    )


EVENTS = Binding("events", Fields({"event_type": "event_type", "kind2": "kind2", "props.k": "`props.k`"}, {}, {"high": "high"}), _events, 10)
