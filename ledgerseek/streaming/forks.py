"""Live matches of a chain with forks: NEW, UNDO and IRREVERSIBLE steps of a block stream.

:class:`ForkTree` is the rule; :func:`follow` runs it as keyed state of a stream (key: the
chain).  Finality comes with the blocks (``lib_num``), so no event-time watermark is used:
state is pruned below the last irreversible block.  Predicates run before the state, which
keeps only the matches of a block.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.bounds import PREFIX_LENGTH, Cursor, RangeError
from ..plans.segments import Segment

NEW, UNDO, IRREVERSIBLE = "new", "undo", "irreversible"


@dataclass(frozen=True)
class Block:
    num: int
    id: str
    prev_id: str
    lib_num: int
    payload: str = "[]"


@dataclass
class ForkTree:
    """Reversible blocks by id.

    The head is the highest linked block, the first seen among equals.  A longer branch
    undoes the old one down to the common ancestor (descending) and adds the new one
    (ascending).  The head's ``lib_num`` makes its ancestors irreversible (ascending) and
    prunes everything at or below it, and branches that don't descend from it.  A block
    whose parent is unknown waits; one at or below the last irreversible block is dropped.
    """

    blocks: dict[str, Block] = field(default_factory=dict)
    linked: dict[str, None] = field(default_factory=dict)  # in the order of linking
    waiting: list[str] = field(default_factory=list)
    head: str = ""
    lib_num: int = -1
    lib_id: str = ""
    started: bool = False

    def add(self, block: Block) -> list[tuple[str, Block]]:
        if block.id in self.blocks or (self.started and block.num <= self.lib_num):
            return []
        self.blocks[block.id] = block
        self.waiting.append(block.id)
        steps: list[tuple[str, Block]] = []
        moved = True
        while moved:
            moved = False
            for i in list(self.waiting):
                b = self.blocks[i]
                if not self.started or b.prev_id == self.lib_id or b.prev_id in self.linked:
                    if not self.started:
                        self.started, self.lib_id, self.lib_num = True, b.prev_id, min(b.lib_num, b.num - 1)
                    self.waiting.remove(i)
                    self.linked[i] = None
                    moved = True
                    steps += self._lead(b)
                    break
        return steps

    def path(self, id_: str) -> list[Block]:
        """From the first reversible ancestor up to the block."""
        out = []
        while id_ in self.blocks and id_ in self.linked:
            out.append(self.blocks[id_])
            id_ = self.blocks[id_].prev_id
        return out[::-1]

    def _lead(self, b: Block) -> list[tuple[str, Block]]:
        if self.head and self.head in self.blocks and b.num <= self.blocks[self.head].num:
            return []
        old, new = self.path(self.head), self.path(b.id)
        common = 0
        while common < min(len(old), len(new)) and old[common].id == new[common].id:
            common += 1
        steps = [(UNDO, x) for x in reversed(old[common:])] + [(NEW, x) for x in new[common:]]
        self.head = b.id
        final = [x for x in new if x.num <= b.lib_num]
        if final:
            steps += [(IRREVERSIBLE, x) for x in final]
            self.lib_id, self.lib_num = final[-1].id, final[-1].num
            self._prune()
        return steps

    def _prune(self) -> None:
        """Keeps what descends from the last irreversible block, and blocks above it that wait."""
        keep: set[str] = set()
        for i in self.linked:  # parents come before children
            b = self.blocks[i]
            if b.prev_id == self.lib_id or b.prev_id in keep:
                keep.add(i)
        self.linked = {i: None for i in self.linked if i in keep}
        self.waiting = [i for i in self.waiting if self.blocks[i].num > self.lib_num]
        self.blocks = {i: self.blocks[i] for i in [*self.linked, *self.waiting]}
        if self.head not in self.blocks:
            self.head = ""

    def dump(self) -> str:
        return json.dumps({"b": [[b.num, b.id, b.prev_id, b.lib_num, b.payload] for b in self.blocks.values()], "l": list(self.linked), "w": self.waiting,
                           "h": self.head, "n": self.lib_num, "i": self.lib_id, "s": self.started})

    @staticmethod
    def load(text: str) -> ForkTree:
        d = json.loads(text)
        return ForkTree({b[1]: Block(*b) for b in d["b"]}, dict.fromkeys(d["l"]), d["w"], d["h"], d["n"], d["i"], d["s"])


_OUT = T.StructType([
    T.StructField("chain", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("step", T.StringType()), T.StructField("block_num", T.LongType()),
    T.StructField("block_id", T.StringType()), T.StructField("irr_block_num", T.LongType()), T.StructField("matches", T.StringType()), T.StructField("marker", T.BooleanType()),
])
_BLOCK = T.StructType([
    T.StructField("num", T.LongType()), T.StructField("prev_id", T.StringType()), T.StructField("lib_num", T.LongType()), T.StructField("payload", T.StringType()),
    T.StructField("linked", T.BooleanType()), T.StructField("place", T.LongType()),
])
_CHAIN = T.StructType([
    T.StructField("head", T.StringType()), T.StructField("lib_num", T.LongType()), T.StructField("lib_id", T.StringType()), T.StructField("started", T.BooleanType()),
    T.StructField("seq", T.LongType()), T.StructField("marked", T.LongType()), T.StructField("open_new", T.BooleanType()), T.StructField("open_irr", T.BooleanType()),
    T.StructField("done", T.BooleanType()), T.StructField("place", T.LongType()),
])


@dataclass(frozen=True)
class Follow:
    """What a live request asks for."""

    reversible: bool = True
    #: an empty row every so many new blocks (0: never), once the block ``marker_after`` (the head when the request came) was reached
    marker_interval: int = 0
    marker_after: int = 0
    #: opens once, at the first block that is so high; lower blocks of other branches pass afterwards
    gate: int | None = None
    #: blocks below are dropped, whatever the gate did
    low: int | None = None
    #: the last block: nothing follows it
    high: int | None = None

    def check(self, irreversible: int, tail: int, descending: bool = False) -> None:
        """Raises for a request whose first block a live segment with this tail does not hold."""
        edge = self.high if descending else self.low
        if edge is not None and edge < tail:
            raise RangeError(f"block {edge} is below the live segment, which starts at {tail}")
        if self.low is not None and self.high is not None and self.high < self.low:
            raise RangeError(f"high block {self.high} is below low block {self.low}")
        if not self.reversible and self.high is not None and descending and self.high > irreversible:
            raise RangeError(f"block {self.high} is not irreversible yet")


class ForkProcessor(StatefulProcessor):
    """State of one chain: its reversible blocks by id, of which a batch rewrites those that changed, and one row of counters."""

    def __init__(self, follow: Follow):
        self.follow = follow

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chain = handle.getValueState("chain", _CHAIN)
        self.blocks = handle.getMapState("blocks", T.StructType([T.StructField("id", T.StringType())]), _BLOCK)

    def _load(self) -> tuple[ForkTree, list, dict]:
        tree, counters = ForkTree(), [0, -1, False, False, False, 0]
        before: dict[str, tuple] = {}
        if self.chain.exists():
            tree.head, tree.lib_num, tree.lib_id, tree.started, *counters = self.chain.get()
            rows = sorted(((k[0], tuple(v)) for k, v in self.blocks.iterator()), key=lambda r: r[1][5])
            for id_, v in rows:
                before[id_] = v
                tree.blocks[id_] = Block(v[0], id_, v[1], v[2], v[3])
                if v[4]:
                    tree.linked[id_] = None
                else:
                    tree.waiting.append(id_)
        return tree, counters, before

    def _save(self, tree: ForkTree, counters: list, before: dict) -> None:
        for id_ in before:
            if id_ not in tree.blocks:
                self.blocks.removeKey((id_,))
        for id_ in [*tree.linked, *tree.waiting]:
            b, linked = tree.blocks[id_], id_ in tree.linked
            if id_ not in before or before[id_][4] != linked:
                counters[5] += 1
                self.blocks.updateValue((id_,), (b.num, b.prev_id, b.lib_num, b.payload, linked, counters[5]))
        self.chain.update((tree.head, tree.lib_num, tree.lib_id, tree.started, *counters))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tree, counters, before = self._load()
        seq, marked, open_new, open_irr, done, place = counters
        f, out = self.follow, []
        for r in pd.concat(list(rows)).sort_values("arrival", kind="stable").itertuples(index=False):
            for step, b in tree.add(Block(int(r.num), r.id, r.prev_id, int(r.lib_num), r.matches)):
                final = step == IRREVERSIBLE
                if final == f.reversible or done:
                    continue
                passed = f.gate is None or b.num >= f.gate
                open_new, open_irr = open_new or (passed and not final), open_irr or (passed and final)
                if not (open_irr if final else open_new) or (f.low is not None and b.num < f.low):
                    continue
                if f.high is not None and b.num > f.high:
                    done = True
                    continue
                irr = b.num if final else max(tree.lib_num, 0)
                if b.payload != "[]":
                    out.append((key[0], seq, step, b.num, b.id, irr, b.payload, False))
                    seq += 1
                if step != UNDO and f.marker_interval and b.num >= f.marker_after and b.num >= marked + f.marker_interval:
                    out.append((key[0], seq, step, b.num, b.id, irr, "[]", True))
                    seq, marked = seq + 1, b.num
                # irreversible blocks are never taken back, so the last one ends the request
                done = done or (final and b.num == f.high)
        self._save(tree, [seq, marked, open_new, open_irr, done, place], before)
        if out:
            yield pd.DataFrame(out, columns=_OUT.names)

    def close(self) -> None:
        pass


def follow(blocks: DataFrame, marker_interval: int = 0, reversible: bool = True, request: Follow | None = None) -> DataFrame:
    """Steps of a stream ``chain, num, id, prev_id, lib_num, arrival, matches (JSON array)``.

    For a reversible request NEW and UNDO rows, else IRREVERSIBLE rows only; blocks without matches give no row.  Which of
    two branches came first is a matter of ``arrival`` alone, however the stream is cut into batches.  The state needs the RocksDB
    provider, which is set for the session.
    """
    blocks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    request = request or Follow(reversible, marker_interval)
    steps = blocks.groupBy("chain").transformWithStateInPandas(ForkProcessor(request), _OUT, "Append", "None")
    return steps.withColumn("undo", F.col("step") == UNDO)


MATCHES = "array<struct<trx_idx: int, trx_id: string, action_idxs: string>>"


def index_blocks(docs: DataFrame, by: tuple[str, ...] = ("block_num",)) -> DataFrame:
    """One row a block (``by``) with its documents as ``docs array<struct>``."""
    return docs.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("trx_idx", "action_idx", *(F.col(f"`{c}`") for c in docs.columns if c not in (*by, "trx_idx", "action_idx"))))).alias("docs"))


def block_matches(docs: Column, predicate: Callable[[Column], Column]) -> Column:
    """The matches (JSON of MATCHES, in order) of one block's ``docs array<struct>``: a filter on each row, before any state."""
    hits = F.filter(docs, predicate)

    def one(t: Column) -> Column:
        own = F.filter(hits, lambda d: d["trx_idx"] == t)
        actions = F.array_join(F.transform(F.array_sort(F.transform(own, lambda d: d["action_idx"])), lambda a: a.cast("string")), ",")
        return F.struct(t.alias("trx_idx"), F.element_at(own, 1)["trx_id"].alias("trx_id"), actions.alias("action_idxs"))

    return F.to_json(F.transform(F.array_sort(F.array_distinct(F.transform(hits, lambda d: d["trx_idx"]))), one))


def live_rows(steps: DataFrame) -> DataFrame:
    """One row a match (and a marker): rank in the block, cursor with the block's id, irreversible block, undo flag.

    In order of ``seq, place``: forwards within a block, backwards where it is taken back; ranks count forwards either way.
    """
    rows = steps.select("*", F.posexplode_outer(F.from_json("matches", MATCHES)).alias("match_index", "m"))
    prefix = F.substring(F.coalesce("m.trx_id", F.lit("")), 1, PREFIX_LENGTH)
    place = F.when(F.col("undo"), -F.col("match_index")).otherwise(F.col("match_index"))
    return rows.select(
        "chain", "seq", F.coalesce(place, F.lit(0)).alias("place"), "step", "block_num", "block_id", prefix.alias("trx_id_prefix"), F.col("match_index").cast("long").alias("match_index"),
        F.col("m.action_idxs").alias("action_idxs"), F.concat(F.lit("1:"), F.col("block_num").cast("string"), F.lit(":"), "block_id", F.lit(":"), prefix).alias("cursor"),
        "irr_block_num", "undo", F.col("marker").alias("live_marker"),
    )


def still_valid(cursor: Cursor, canonical_blocks: DataFrame, irreversible: int) -> bool:
    """Whether the chain still has the cursor's block: one at or below the last irreversible block must carry the canonical ``id``."""
    if not cursor.head_id or cursor.block > irreversible:
        return True
    return not canonical_blocks.where((F.col("num") == cursor.block) & (F.col("id") == cursor.head_id)).isEmpty()


def dead_blocks(blocks: DataFrame, cursor: Cursor, head_id: str, descending: bool = False, depth: int = 10_000) -> DataFrame:
    """``num, id`` of the blocks from the cursor's down to its branch's root that the head's branch doesn't have.

    A descending request can't go on from a dead block: :class:`RangeError`.
    """
    chain = canonical(blocks, head_id, depth)
    dead = canonical(blocks, cursor.head_id, depth).join(chain.select("id"), "id", "left_anti").select("num", "id")
    if descending and not dead.isEmpty():
        raise RangeError(f"the cursor's block {cursor.block} is on a branch that was left; a descending request can't go on there")
    return dead


def trimmed(blocks: DataFrame, irreversible: int, published_tail: int, least: int = 300) -> tuple[DataFrame, int]:
    """(the buffered ``blocks`` that stay, the tail to publish next).

    Two passes: blocks go once a tail above them was published by the pass before, so readers that saw the old tail are served; ``least`` blocks
    below the last irreversible one always stay.
    """
    return blocks.where(F.col("num") >= published_tail), max(published_tail, irreversible - least)


def progress(blocks: DataFrame, segment: Segment) -> Segment:
    """The segment with head and last irreversible block as of ``blocks(num, lib_num)``, never backwards (for ``foreachBatch``)."""
    got = blocks.agg(F.max("num").alias("head"), F.max("lib_num").alias("irr")).first()
    return replace(segment, head=max(segment.head, got["head"] or 0), irr=max(segment.irr, got["irr"] or 0))


def canonical(blocks: DataFrame, head_id: str, depth: int) -> DataFrame:
    """``num, id``: the ``depth`` newest blocks of the head's branch, found by walking parents (orphans vanish)."""
    spark = blocks.sparkSession
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(depth + 10))
    return spark.sql(
        """
        WITH RECURSIVE chain(num, id, prev_id, n) AS (
          SELECT num, id, prev_id, 1 FROM {blocks} WHERE id = :head
          UNION ALL
          SELECT b.num, b.id, b.prev_id, c.n + 1 FROM {blocks} b JOIN chain c ON b.id = c.prev_id WHERE c.n < :depth)
        SELECT num, id FROM chain""",
        args={"head": head_id, "depth": depth},
        blocks=blocks.select("num", "id", "prev_id"),
    )
