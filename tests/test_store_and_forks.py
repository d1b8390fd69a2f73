import json

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerseek.operators import matching as op
from ledgerseek.operators.matching import Query
from ledgerseek.plans.bounds import Cursor
from ledgerseek.sources import shards
from ledgerseek.sources.bindings import EVENTS, LEDGER
from ledgerseek.streaming.forks import IRREVERSIBLE, NEW, UNDO, Block, ForkTree, canonical, follow

SF = "/root/testdata/sf0.001"


def test_store(spark, tmp_path):
    docs = EVENTS.docs(spark, SF, ("event_type",))
    path = str(tmp_path / "store")
    shards.write(docs, path, 10)
    got = shards.read(spark, path, 12, 33, 10)
    rows = lambda d: sorted(map(tuple, d.select("block_num", "trx_id", "action_idx", "event_type").collect()))
    assert rows(got) == rows(docs.where("block_num between 12 and 33"))
    assert all(r["ok"] for r in shards.integrity(got.where("block_num between 20 and 29"), 10).collect())
    broken = docs.where("block_num <> 25")
    assert [tuple(r) for r in shards.gaps(broken, 10).collect()] == [(24, 26)]
    assert [r["shard_base"] for r in shards.integrity(broken, 10).collect() if not r["ok"]] == [20]
    late = docs.where("block_num between 3 and 9")
    assert [r["ok"] for r in shards.integrity(late, 10, first_block=3).collect()] == [True]
    own = spark.createDataFrame([(0,), (10,), (30,)], "shard_base long")
    assert shards.next_unindexed(own, 10).first()[0] == 20 and shards.next_unindexed(own, 10, 30).first()[0] == 40 and shards.next_unindexed(own, 10, 20).first()[0] == 20
    assert sorted(r[0] for r in shards.contiguous_prefix(own, 10).collect()) == [0, 10]
    assert sorted(r[0] for r in shards.retained(own, 35, 12, 10).collect()) == [30] and shards.retained(own, 5, 12, 10, 5).count() == 3


def test_pages_make_up_the_whole(spark):
    query = Query.of("status:F returnflag:R")
    for down in (False, True):
        whole = [tuple(r) for r in op.find(spark, SF, LEDGER, query, 100, 200, down).collect()]
        pages, cursor = [], None
        while True:
            page = op.find(spark, SF, LEDGER, query, 100, 200, down, 7, cursor)
            rows = page.collect()
            pages += map(tuple, rows)
            if not op.outcome(page, 7).limit_reached:
                break
            cursor = Cursor.parse(rows[-1]["cursor"])
        assert pages == whole
        assert [tuple(r) for r in op.first_matches(spark, SF, LEDGER, query, 100, 200, 9, down, 1).collect()] == whole[:9]


@st.composite
def trees(draw):
    """Blocks with random parents among the last few, in an order that may put children first."""
    blocks = [Block(1, "b1", "root", 0)]
    for n in range(draw(st.integers(1, 14))):
        parent = draw(st.sampled_from(blocks[-4:]))
        lib = max(0, parent.num - 5) if draw(st.booleans()) else parent.lib_num
        blocks.append(Block(parent.num + 1, f"n{n}", parent.id, max(lib, parent.lib_num)))
    if len(blocks) > 3:
        i = draw(st.integers(1, len(blocks) - 2))
        blocks[i], blocks[i + 1] = blocks[i + 1], blocks[i]
    return blocks


@settings(deadline=None)
@given(trees())
def test_news_less_undos_are_the_chain(blocks):
    tree, chain, final = ForkTree(), [], []
    for b in blocks:
        for step, x in tree.add(b):
            if step == NEW:
                assert not chain or x.prev_id == chain[-1].id
                chain.append(x)
            elif step == UNDO:
                assert chain.pop().id == x.id and x not in final
            else:
                assert step == IRREVERSIBLE and x in chain
                final.append(x)
        tree = ForkTree.load(tree.dump())
    assert [x.id for x in chain[len(final) :]] == [x.id for x in tree.path(tree.head)] and chain[: len(final)] == final


def test_reorganisation():
    b = {i: Block(n, i, p, 0) for n, i, p in ((1, "a", "r"), (2, "b", "a"), (2, "B", "a"), (3, "C", "B"))}
    tree = ForkTree()
    assert [(s, x.id) for i in "abBC" for s, x in tree.add(b[i])] == [(NEW, "a"), (NEW, "b"), (UNDO, "b"), (NEW, "B"), (NEW, "C")]
    assert [(s, x.id) for s, x in tree.add(Block(4, "D", "C", 2))] == [(NEW, "D"), (IRREVERSIBLE, "a"), (IRREVERSIBLE, "B")]
    assert tree.add(Block(2, "late", "a", 0)) == [] and set(tree.blocks) == {"C", "D"}


def test_stream(spark, tmp_path):
    rows = [("c", 1, "a", "r", 0, 0), ("c", 2, "b", "a", 0, 1), ("c", 2, "B", "a", 0, 2), ("c", 3, "C", "B", 0, 3), ("c", 4, "D", "C", 2, 4)]
    blocks = spark.createDataFrame([(*r, json.dumps([r[2]]) if r[2] != "D" else "[]") for r in rows], "chain string, num long, id string, prev_id string, lib_num long, arrival long, matches string")
    blocks.write.json(str(tmp_path / "in"))
    for reversible, want in ((True, [("new", "a"), ("new", "b"), ("undo", "b"), ("new", "B"), ("new", "C")]), (False, [("irreversible", "a"), ("irreversible", "B")])):
        name = f"steps_{reversible}"
        out = follow(spark.readStream.schema(blocks.schema).json(str(tmp_path / "in")), reversible=reversible)
        out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        assert [tuple(r) for r in spark.sql(f"SELECT step, block_id FROM {name} ORDER BY seq").collect()] == want


def test_canonical(spark):
    blocks = spark.createDataFrame([(1, "a", "r"), (2, "b", "a"), (2, "x", "a"), (3, "c", "b")], "num long, id string, prev_id string")
    assert sorted(r["id"] for r in canonical(blocks, "c", 2).collect()) == ["b", "c"]
