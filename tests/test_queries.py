import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerseek import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_duckdb(name, same_as_duckdb):
    same_as_duckdb(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["block_num", "trx_id_prefix"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def scans(df):
    """The plan with whole lists of filters."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_prunes_and_needs_no_unasked_join(spark, tmp_path):
    from ledgerseek.operators import matching as op
    from ledgerseek.operators.matching import Query
    from ledgerseek.sources.store import ShardStore

    df = op.documents(spark, "/root/testdata/sf0.001", catalog.LEDGER, Query.of("returnflag:R"), 100, 400)
    plan = scans(df)
    assert "c_mktsegment" not in plan and "p_brand" not in plan and "l_comment" not in plan
    assert "GreaterThanOrEqual(o_orderdate,1995-04-11" in plan and "LessThan(o_orderdate,1996-02-06" in plan
    plan = scans(op.documents(spark, "/root/testdata/sf0.001", catalog.EVENTS, Query.of("event_type:error"), 0, 10))
    assert "EqualNullSafe(event_type,error)" in plan and "GreaterThanOrEqual(event_id,0)" in plan and "LessThan(event_id,220)" in plan

    store, query = ShardStore(spark, str(tmp_path / "s"), 100), Query.of("returnflag:R")
    docs = catalog.LEDGER.docs(spark, "/root/testdata/sf0.001", ("returnflag",)).withColumn("block_id", F.lit("b")).withColumn("block_time", F.current_timestamp())
    store.publish(docs, whole=False)
    read = store.read(150, 320).where(query.predicate(catalog.LEDGER.fields))
    plan = scans(read)
    assert "(shard_base#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualNullSafe(returnflag,R)" in plan and "GreaterThanOrEqual(block_num,150)" in plan and "Exchange" not in plan and "Join" not in plan
    assert read.count() == op.documents(spark, "/root/testdata/sf0.001", catalog.LEDGER, query, 150, 320).count() > 0
