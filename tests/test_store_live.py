import os
import shutil

import pytest
from pyspark.sql import functions as F

from ledgerseek import catalog
from ledgerseek.config import EngineConfig
from ledgerseek.functions.text import chunk_map
from ledgerseek.operators import matching as op
from ledgerseek.operators.matching import EmptyResults, Query, QueryMetrics
from ledgerseek.plans import sqe
from ledgerseek.plans.bounds import RangeError
from ledgerseek.plans.segments import Segment
from ledgerseek.sources.bindings import EVENTS
from ledgerseek.sources.store import ShardStore, boundaries, faults
from ledgerseek.streaming.forks import IRREVERSIBLE, NEW, UNDO, Follow, dead_blocks, follow, live_rows, progress, trimmed
from ledgerseek.plans.bounds import Cursor

SF = "/root/testdata/sf0.001"


def blocks_of(spark):
    at = F.col("block_num").cast("string")
    return EVENTS.docs(spark, SF, ("event_type",)).withColumn("block_id", at).withColumn("block_time", F.timestamp_seconds("block_num"))


def test_store_publishes_whole_shards_once(spark, tmp_path):
    seen = []
    store = ShardStore(spark, str(tmp_path / "s"), 10, block_filter=lambda d: seen.append(1) or d.where("block_num <> 999"))
    docs = blocks_of(spark).where("block_num < 45 and block_num <> 33")
    assert store.publish(docs) == [0, 10, 20] and seen and store.publish(docs) == []  # 30 has a hole, 40 is not whole
    assert store.read(0, 1000).count() == docs.where("block_num < 30").count()
    assert store.publish(docs.where("block_num >= 40"), whole=False) == [40]
    with pytest.raises(ValueError, match="no shard 30"):
        store.check_contiguous()
    assert store.clean(10, 40) == [0, 40] and [r[0] for r in store.meta().select("shard_base").orderBy("shard_base").collect()] == [10, 20]
    store.check_contiguous()
    assert store.segment("a") == Segment("a", 10, 29, 29, moving_head=True)
    store.check_bounds(12, 5000)
    with pytest.raises(RangeError, match="holds 10 to 29"):
        store.check_bounds(5, 12)
    with pytest.raises(RangeError):
        ShardStore(spark, str(tmp_path / "none"), 10).check_bounds(0, 1)


def test_boundary_faults(spark):
    rows = [(0, "a"), (1, "b"), (10, None), (12, "c"), (19, "d")]
    docs = spark.createDataFrame(rows, "block_num long, block_id string").withColumn("block_time", F.when(F.col("block_num") < 19, F.current_timestamp()))
    found = {r[0]: r[1] for r in faults(boundaries(docs, 10), 10).collect()}
    assert found == {0: ["last block is missing"], 10: ["start has no id", "end has no time", "blocks are missing"]}
    assert faults(boundaries(docs.where("block_num = 1"), 2), 2, first_block=1).first()["faults"] == []


def steps(spark, tmp_path, name, batches, request):
    path = str(tmp_path / name)
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame([("c", n, i, p, lib, a, f'[{{"trx_idx":0,"trx_id":"t{i}","action_idxs":"0"}}]') for n, i, p, lib, a in rows],
                                      "chain string, num long, id string, prev_id string, lib_num long, arrival long, matches string")
        frame.coalesce(1).write.parquet(f"{path}/b{k}")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b*")
    out = f"{path}-out"
    follow(stream, request=request).writeStream.format("parquet").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    rows = live_rows(spark.read.parquet(f"{out}/rows")).orderBy("seq", "place").collect()
    return [(r["step"], r["block_id"], r["live_marker"]) for r in rows], rows


def test_live_requests(spark, tmp_path):
    one = [(1, "a1", "r", 0, 1), (2, "x2", "a1", 0, 2), (2, "a2", "a1", 0, 3)]
    two = [(3, "a3", "a2", 1, 4), (4, "a4", "a3", 3, 5)]
    want = [(NEW, "a1", False), (NEW, "x2", False), (UNDO, "x2", False), (NEW, "a2", False), (NEW, "a3", False), (NEW, "a4", False)]
    cut, rows = steps(spark, tmp_path, "cut", [one, two], Follow())
    whole, _ = steps(spark, tmp_path, "whole", [one + two], Follow())
    assert cut == whole == want  # however the stream is cut
    assert rows[0]["cursor"] == "1:1:a1:ta1" and rows[2]["undo"] and rows[0]["match_index"] == 0
    # the gate opens once: the other branch's block 2 is taken back although it came before; low drops, high ends
    gated, _ = steps(spark, tmp_path, "gated", [one, two], Follow(gate=3, low=3, high=3))
    assert gated == [(NEW, "a3", False)]
    final, _ = steps(spark, tmp_path, "final", [one, two], Follow(reversible=False, marker_interval=2, marker_after=1))
    assert final == [(IRREVERSIBLE, "a1", False), (IRREVERSIBLE, "a1", True), (IRREVERSIBLE, "a2", False), (IRREVERSIBLE, "a3", False), (IRREVERSIBLE, "a3", True)]


def test_live_bounds_forks_and_tail(spark):
    with pytest.raises(RangeError):
        Follow(low=5).check(100, 50)
    with pytest.raises(RangeError):
        Follow(low=80, high=70).check(100, 50)
    blocks = spark.createDataFrame([(1, "a1", "r", 0), (2, "a2", "a1", 0), (3, "a3", "a2", 1), (2, "x2", "a1", 0), (3, "x3", "x2", 0)], "num long, id string, prev_id string, lib_num long")
    dead = dead_blocks(blocks, Cursor(3, "x3"), "a3", depth=50)
    assert sorted(map(tuple, dead.collect())) == [(2, "x2"), (3, "x3")]
    assert dead_blocks(blocks, Cursor(2, "a2"), "a3", depth=50).isEmpty()
    with pytest.raises(RangeError, match="branch that was left"):
        dead_blocks(blocks, Cursor(3, "x3"), "a3", descending=True, depth=50)
    assert progress(blocks, Segment("live", 0, 2, 2)) == Segment("live", 0, 2, 3)
    stay, tail = trimmed(blocks, 2, 2, least=1)
    assert stay.count() == 4 and tail == 2 and trimmed(blocks, 400, 2)[1] == 100


def test_hooks_and_settings(spark, tmp_path):
    query = Query.of("event_type:error")
    known = EmptyResults(spark, str(tmp_path / "e"))
    assert known.of(query, 10).isEmpty()
    empty = op.empty_shards(spark, SF, EVENTS, Query.of("event_type:none"), 5, 39)
    assert sorted(r["shard_base"] for r in empty.collect()) == [10, 20, 30]
    known.publish(empty)
    assert known.of(Query.of("event_type:none"), 10).count() == 3 and known.of(query, 10).isEmpty() and known.of(Query.of("event_type:none"), 20).isEmpty()
    watched, done = QueryMetrics().watch(op.find(spark, SF, EVENTS, query, 0, 30), 10)
    n = len(watched.collect())
    got = done()
    assert got.matches == n > 0 and got.shards_with_matches == 4 and got.highest == 30 and got.seconds > 0
    assert EngineConfig(shard_size=10, start_block=-15).start(100) == 80 and EngineConfig(first_streamable_block=2, start_block=2).start(100) == 2
    assert EngineConfig(truncation_low_block_num=-50).chain([Segment("a", 0, 90, 100)]).lowest == 50
    for wrong in ({"shard_size": 0}, {"start_block": 9, "stop_block": 9}, {"stop_block": -1}):
        with pytest.raises(ValueError):
            EngineConfig(**wrong)
    row = spark.createDataFrame([(bytes.fromhex("00ab1000ff"),)], "b binary").select(chunk_map(F.col("b"), 2, 4).alias("m")).first()
    assert row["m"] == {"c0": "ab", "c1": "1000", "c2": "ff"}
    names = []
    assert sqe.visit(sqe.parse("a:1 -(b:2 OR c:3)"), lambda n: names.append(type(n).__name__), lambda n: names.append("/")) and names[0] == "And" and names[-1] == "/"
    assert not sqe.visit(sqe.parse("a:1 b:2"), after=lambda n: False)


def files_under(path):
    return [os.path.join(d, x) for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")]


def test_files_follow_documents_not_shards(spark, tmp_path):
    docs = blocks_of(spark)
    store, n = ShardStore(spark, str(tmp_path / "s"), 1), docs.select("block_num").distinct().count()
    assert store.publish(docs.where("block_num % 7 <> 3"), whole=False) == [b for b in range(n) if b % 7 != 3] and n > 40
    assert store.publish(docs, whole=False) == [b for b in range(n) if b % 7 == 3]  # files of shards old and new are parted
    assert len(files_under(tmp_path)) <= 2 * (4 + 4)  # two runs of documents and boundaries on four partitions
    rows = lambda d: sorted(map(tuple, d.select("block_num", "trx_id", "action_idx", "shard_base").collect()))
    want = docs.withColumn("shard_base", F.col("block_num"))
    assert rows(store.read(0, 1000)) == rows(want) and rows(store.read(3, 9)) == rows(want.where("block_num between 3 and 9"))
    assert store.clean(5, 33) == [*range(5), *range(33, n)] and store.clean(5, 33) == []
    assert rows(store.read(0, 1000)) == rows(want.where("block_num between 5 and 32"))
    assert rows(spark.read.option("basePath", f"{store.path}/docs").parquet(f"{store.path}/docs").withColumn("shard_base", F.col("block_num"))) == rows(want.where("block_num between 5 and 32"))  # the files are cut too
    assert store.publish(docs, whole=False) == [*range(5), *range(33, n)] and rows(store.read(0, 1000)) == rows(want)
    assert store.clean(1000) == list(range(n)) and store.meta().isEmpty() and not files_under(f"{store.path}/docs")


def test_what_meta_does_not_list_is_not_read(spark, tmp_path):
    docs, store = blocks_of(spark), ShardStore(spark, str(tmp_path / "s"), 10)
    store.publish(docs.where("block_num < 20"))
    (run,) = os.listdir(f"{store.path}/meta")
    shutil.copytree(f"{store.path}/docs/{run}", f"{store.path}/docs/{run}0")  # as if a publisher had died between its renames
    assert store.read(0, 1000).count() == docs.where("block_num < 20").count()


def test_micro_batches_carry_what_they_leave(spark, tmp_path):
    docs, store = blocks_of(spark), ShardStore(spark, str(tmp_path / "s"), 10)
    cuts = [docs.where("block_num < 14"), docs.where("block_num between 14 and 17"), docs.where("block_num between 18 and 29 or block_num = 35"), docs.where("block_num between 30 and 34 or block_num > 35")]
    known = [[0], [0], [0, 10, 20], [0, 10, 20, 30, 40]]
    left = [docs.where("block_num between 10 and 13"), docs.where("block_num between 10 and 17"), docs.where("block_num = 35"), docs.where("block_num > 49")]
    for k, (batch, bases, rest) in enumerate(zip(cuts, known, left)):
        for _ in range(2):  # a restart repeats a batch
            store._take(batch, k)
            assert sorted(r[0] for r in store.meta().select("shard_base").collect()) == bases
            held = files_under(f"{store.path}/inbox/batch={k}")
            assert (spark.read.parquet(*held).count() if held else 0) == rest.count()
    assert sorted(os.listdir(f"{store.path}/inbox")) == ["batch=2", "batch=3"]
    assert store.read(0, 49).count() == docs.where("block_num < 50").count()


def test_follow_reads_tables_of_many_files(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    rows = lambda d: sorted(map(tuple, catalog.QUERIES["store_follow"](spark, d).collect()))
    assert rows(str(tmp_path)) == rows(SF) != []
