"""The engine's own queries on the LEDGER and EVENTS bindings, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.predicates import compile_predicate
from .functions.text import chunk_map as chunks_of
from .functions.text import first_chunks, trim_zeros
from .operators import matching as op
from .operators.matching import Query
from .plans.bounds import Chain, Cursor, LegacyRequest, Request, resolve
from .plans.segments import Segment, chain_of, is_covered, nth_highest_irreversible, plan
from .sources import shards
from .sources.shared import drained, fresh_dir
from .sources.store import ShardStore, analyze, boundaries
from .sources.bindings import EVENTS, LEDGER, Binding, event_docs, ledger_transactions, read
from .streaming import forks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = 'returnflag:R -(priority:"1-URGENT" OR linestatus:F)'
FLAGSHIP_SQL = "returnflag = 'R' AND NOT (priority = '1-URGENT' OR linestatus = 'F')"
ALL = 1 << 40

# --- statements ----------------------------------------------------------------------

_LEDGER_SQL = """t AS (
  SELECT date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS block_num, CAST(o_orderkey AS VARCHAR) AS trx_id, o_orderkey, o_custkey,
         row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) - 1 AS trx_idx, o_orderstatus AS status, o_orderpriority AS priority
  FROM orders),
a AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS action_idx
  FROM lineitem),
docs AS (
  SELECT t.*, CAST(a.action_idx AS INTEGER) AS action_idx, l_returnflag AS returnflag, l_linestatus AS linestatus, c_mktsegment AS segment, p_brand AS brand, p_type AS ptype,
         CASE WHEN p_type = 'PROMO' THEN p_brand END AS promo, priority = '1-URGENT' AS urgent, l_quantity > 25 AS big
  FROM t JOIN a ON a.l_orderkey = t.o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey)"""
_EVENTS_SQL = """docs AS (
  SELECT event_id // 20 AS block_num, CAST((event_id % 20) // 2 AS INTEGER) AS trx_idx, CAST(event_id // 2 AS VARCHAR) AS trx_id, CAST(event_id % 2 AS INTEGER) AS action_idx,
         event_type, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS kind2, json_extract_string(props, '$.k') AS k, value > 100 AS high, event_id, ts
  FROM events)"""
_SOURCE = {"ledger": _LEDGER_SQL, "events": _EVENTS_SQL}


def _docs_sql(binding: Binding, where: str, low: int = 0, high: int = ALL) -> str:
    return f"WITH {_SOURCE[binding.name]} SELECT block_num, trx_id, action_idx FROM docs WHERE {where} AND block_num BETWEEN {low} AND {high}"


def _match_sql(binding: Binding, where: str, low: int = 0, high: int = ALL, down: bool = False) -> str:
    """CTEs up to ``m``: one row for each matching transaction, with its place ``pos`` in the whole result."""
    way = "DESC" if down else "ASC"
    return f"""WITH {_SOURCE[binding.name]},
g AS (
  SELECT block_num, trx_idx, trx_id, string_agg(action_idx, ',' ORDER BY action_idx) AS action_idxs
  FROM docs WHERE {where} AND block_num BETWEEN {low} AND {high} GROUP BY block_num, trx_idx, trx_id),
m AS (
  SELECT block_num, substr(trx_id, 1, 12) AS trx_id_prefix, row_number() OVER (PARTITION BY block_num ORDER BY trx_idx {way}) - 1 AS match_index, action_idxs,
         '1:' || block_num || '::' || substr(trx_id, 1, 12) AS cursor, row_number() OVER (ORDER BY block_num {way}, trx_idx {way}) AS pos
  FROM g)
"""


_STD = ("block_num", "trx_id_prefix", "match_index", "action_idxs", "cursor")
_STD_SQL = f"SELECT {', '.join(_STD)} FROM m"


def _query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _documents(name: str, binding: Binding, text: str, where: str, low: int = 0, high: int = ALL, **how) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op.documents(spark, sf_dir, binding, Query.of(text, **how), low, high).select("block_num", "trx_id", "action_idx")

    _query(name, _docs_sql(binding, where, low, high))(run)


def _matches(name: str, text: str, sql: str, columns: tuple[str, ...] = _STD, **how) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op.find(spark, sf_dir, LEDGER, Query.of(text), how.get("low", 0), how.get("high", ALL), **{k: v for k, v in how.items() if k not in ("low", "high")}).select(*columns)

    _query(name, sql)(run)


# --- matches ------------------------------------------------------------------------

_flag, _flag_down = _match_sql(LEDGER, FLAGSHIP_SQL), _match_sql(LEDGER, FLAGSHIP_SQL, down=True)
_matches("flagship", FLAGSHIP, _flag + _STD_SQL + " WHERE pos <= 50", limit=50)
_documents("term_eq", LEDGER, "segment:BUILDING", "segment = 'BUILDING'")
_documents("bool_true", LEDGER, "urgent:true", "urgent")
_documents("bool_false", LEDGER, "urgent:false", "NOT urgent")
_documents("bool_quoted", LEDGER, 'urgent:"true"', "false")
_documents("term_in", LEDGER, 'priority:["1-URGENT", "2-HIGH",]', "priority IN ('1-URGENT', '2-HIGH')")
_documents("term_in_empty", LEDGER, "priority:[]", "false")
_documents("and_terms", LEDGER, "returnflag:A && linestatus:O status:F", "returnflag = 'A' AND linestatus = 'O' AND status = 'F'")
_documents("or_terms", LEDGER, 'brand:"Brand#13" || ptype:PROMO', "(brand = 'Brand#13' OR ptype = 'PROMO')")
_documents("not_term", LEDGER, '-promo:"Brand#13"', "NOT coalesce(promo = 'Brand#13', false)")
_documents("not_group", LEDGER, 'returnflag:R -(linestatus:F OR priority:"5-LOW")', "returnflag = 'R' AND NOT (linestatus = 'F' OR priority = '5-LOW')")
_documents("not_only", EVENTS, "-kind2:click -kind2:view", "event_type NOT IN ('click', 'view')", 0, ALL)
_documents("paren_mix", LEDGER, "(segment:BUILDING OR segment:MACHINERY) (returnflag:N -(status:P))", "segment IN ('BUILDING', 'MACHINERY') AND returnflag = 'N' AND NOT status = 'P'")
_documents("nested_field", EVENTS, "props.k:87", "k = '87'", 0, ALL)
_documents("block_range", LEDGER, "returnflag:A", "returnflag = 'A'", 730, 760)
_documents("field_transform", LEDGER, "FLAG:r", "returnflag = 'R'", rename=lambda f: "returnflag" if f == "FLAG" else "", rewrite=lambda f, v: v.value.upper())
_documents("tag_contains", LEDGER, "tag:R -tag:F big:true", "returnflag = 'R' AND linestatus <> 'F' AND big")

_group = ("block_num", "trx_id_prefix", "action_idxs")
_index = ("block_num", "trx_id_prefix", "match_index", "action_idxs")
_r, _r_down = _match_sql(LEDGER, "returnflag = 'R'"), _match_sql(LEDGER, "returnflag = 'R'", down=True)
_matches("group_trx", "returnflag:R", _r + f"SELECT {', '.join(_group)} FROM m", _group)
_matches("match_index", "returnflag:R", _r + f"SELECT {', '.join(_index)} FROM m", _index)
_matches("match_index_desc", "returnflag:R", _r_down + f"SELECT {', '.join(_index)} FROM m", _index, descending=True)
_matches("archive_result", "returnflag:R", _r + "SELECT block_num, trx_id_prefix, CAST(0 AS BIGINT) AS match_index, action_idxs, cursor, block_num AS irr_block_num FROM m", (*_STD, "irr_block_num"), archive_compat=True)
_matches("cursor_string", "segment:BUILDING", _match_sql(LEDGER, "segment = 'BUILDING'") + "SELECT block_num, cursor FROM m", ("block_num", "cursor"))
_matches("cursor_missing", FLAGSHIP, _flag + _STD_SQL + " WHERE false", cursor=Cursor(120, "", "none"), limit=50)
_matches("cursor_block_only", FLAGSHIP, _flag + _STD_SQL + " WHERE block_num > 120", cursor=Cursor(120))
for _name, _down in (("limit_asc", False), ("limit_desc", True)):
    _matches(_name, "status:F", _match_sql(LEDGER, "status = 'F'", down=_down) + _STD_SQL + " WHERE pos <= 25", limit=25, descending=_down)


def _resumed(down: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = Query.of(FLAGSHIP)
        page = op.find(spark, sf_dir, LEDGER, query, 0, ALL, down, 50).select("cursor").collect()  # one page
        at = Cursor.parse(page[-1][0]) if page else None
        return op.find(spark, sf_dir, LEDGER, query, 0, ALL, down, 50, at).select(*_STD)

    return run


_query("cursor_resume", _flag + _STD_SQL + " WHERE pos BETWEEN 51 AND 100")(_resumed(False))
_query("cursor_resume_desc", _flag_down + _STD_SQL + " WHERE pos BETWEEN 51 AND 100")(_resumed(True))


@_query("first_matches", _flag + _STD_SQL + " WHERE pos <= 50")
def first_matches(spark, sf_dir):
    return op.first_matches(spark, sf_dir, LEDGER, Query.of(FLAGSHIP), 0, _head(spark, sf_dir), 50, shards=1).select(*_STD)


def _positions(down: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Global places without one task for all rows: rank in the block plus the matches of the blocks before."""
        found = op.transactions(op.documents(spark, sf_dir, LEDGER, Query.of("status:P"), 0, ALL), down)
        per_block = found.groupBy("block_num").agg(F.count("*").alias("n"))  # one row a block
        order = F.desc("block_num") if down else F.asc("block_num")
        before = per_block.select("block_num", F.coalesce(F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        return found.join(before, "block_num").select((F.col("before") + F.col("match_index") + 1).alias("pos"), "block_num", op.prefix().alias("trx_id_prefix")).orderBy("pos")

    return run


for _name, _down in (("sort_asc", False), ("sort_desc", True)):
    _query(_name, _match_sql(LEDGER, "status = 'P'", down=_down) + "SELECT pos, block_num, trx_id_prefix FROM m")(_positions(_down))


@_query("undo_order", _match_sql(LEDGER, "returnflag = 'R'", 100, 102) + """SELECT row_number() OVER (ORDER BY block_num DESC, match_index DESC) AS seq, block_num, trx_id_prefix,
 match_index, CAST(99 AS BIGINT) AS irr_block_num, true AS undo FROM m""")  # fmt: skip
def undo_order(spark, sf_dir):
    found = op.undo(spark, sf_dir, LEDGER, Query.of("returnflag:R"), [100, 101, 102])  # few blocks of a dead fork
    seq = F.row_number().over(Window.orderBy(F.desc("block_num"), F.desc("match_index"))).cast("long")
    return found.select(seq.alias("seq"), "block_num", "trx_id_prefix", "match_index", "irr_block_num", "undo")


# --- ranges and federation -----------------------------------------------------------


def _head(spark: SparkSession, sf_dir: str) -> int:
    return ledger_transactions(spark, sf_dir).agg(F.max("block_num")).first()[0]


@_query("range_relative", f"WITH {_LEDGER_SQL} SELECT block_num, trx_id, action_idx FROM docs WHERE status = 'O' AND block_num >= (SELECT max(block_num) FROM t) - 30")
def range_relative(spark, sf_dir):
    head = _head(spark, sf_dir)
    at = resolve(Request(low=-31, high=-1), Chain(head, head))
    return op.documents(spark, sf_dir, LEDGER, Query.of("status:O"), at.low, at.high).select("block_num", "trx_id", "action_idx")


@_query("range_legacy", _docs_sql(LEDGER, "status = 'O'", 100, 300))
def range_legacy(spark, sf_dir):
    head = _head(spark, sf_dir)
    at = resolve(LegacyRequest(300, 200, descending=True), Chain(head, head))
    return op.documents(spark, sf_dir, LEDGER, Query.of("status:O"), at.low, at.high).select("block_num", "trx_id", "action_idx")


_TIERS = [Segment("old", 0, 499, 499, tier=1), Segment("recent", 500, 3000, 3000, tier=2)]


@_query("federated_union", f"WITH {_LEDGER_SQL} SELECT CASE WHEN block_num < 500 THEN 'old' ELSE 'recent' END AS segment_id, block_num, trx_id, action_idx FROM docs WHERE status = 'F' AND block_num <= 1000")
def federated_union(spark, sf_dir):
    query, out = Query.of("status:F"), None
    for s in plan(_TIERS, 0, 1000)[0]:
        part = op.documents(spark, sf_dir, LEDGER, query, s.low, s.high).select(F.lit(s.segment.id).alias("segment_id"), "block_num", "trx_id", "action_idx")
        out = part if out is None else out.union(part)
    return out


def _years(spark: SparkSession, sf_dir: str) -> list[Segment]:
    """One archive segment for each order year (a handful of rows), from the year before's last block on."""
    orders = read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.datediff("o_orderdate", F.lit("1995-01-01")).alias("b"))
    rows = orders.groupBy("y").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).orderBy("y").collect()
    return [Segment(str(r["y"]), rows[k - 1]["hi"] if k else r["lo"], r["hi"], r["hi"], moving_head=True) for k, r in enumerate(rows)]


_YEARS_SQL = "y AS (SELECT year(o_orderdate) AS y, max(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) AS hi FROM orders GROUP BY 1)"


@_query("head_info", f"WITH {_YEARS_SQL} SELECT max(hi) AS head, max(hi) AS irr FROM y")
def head_info(spark, sf_dir):
    c = chain_of(_years(spark, sf_dir))
    return spark.createDataFrame([(c.head, c.irreversible)], "head long, irr long")


@_query("contiguous_coverage", f"""WITH {_YEARS_SQL}, s AS (SELECT y, lag(hi) OVER (ORDER BY y) AS before FROM y)
SELECT 'all' AS name, count(*) FILTER (WHERE before IS NULL AND y > (SELECT min(y) FROM y)) = 0 AS covered FROM s
UNION ALL SELECT 'without 1997', NOT EXISTS (SELECT 1 FROM y WHERE y = 1997) OR (SELECT max(y) = 1997 OR min(y) = 1997 FROM y)""")  # fmt: skip
def contiguous_coverage(spark, sf_dir):
    own = _years(spark, sf_dir)
    head = max(s.head for s in own)
    cases = [("all", is_covered(own, head, own[0].tail)), ("without 1997", is_covered([s for s in own if s.id != "1997"], head, own[0].tail))]
    return spark.createDataFrame(cases, "name string, covered boolean")


@_query("nth_highest", f"WITH {_YEARS_SQL} SELECT hi AS irr_block FROM y ORDER BY hi DESC LIMIT 1 OFFSET 1")
def nth_highest(spark, sf_dir):
    return spark.createDataFrame([(nth_highest_irreversible(_years(spark, sf_dir), 2),)], "irr_block long")


# --- sources, shards, integrity ------------------------------------------------------


@_query("scan_blocks", f"WITH {_EVENTS_SQL} SELECT block_num, count(*) AS n_docs, min(ts) AS first_ts, max(ts) AS last_ts FROM docs GROUP BY block_num")
def scan_blocks(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("block_num", F.expr("event_id div 20"))
    return events.groupBy("block_num").agg(F.count("*").alias("n_docs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@_query("map_docs", f"WITH {_LEDGER_SQL} SELECT block_num, trx_id, action_idx, returnflag, priority FROM docs")
def map_docs(spark, sf_dir):
    return LEDGER.docs(spark, sf_dir, ("returnflag", "priority")).select("block_num", "trx_id", "action_idx", "returnflag", "priority")


_SHARDS_SQL = f"WITH {_LEDGER_SQL}, s AS (SELECT block_num - block_num % 100 AS shard_base, count(DISTINCT block_num) AS n_blocks, count(*) AS n_docs, min(block_num) AS lo, max(block_num) AS hi FROM docs GROUP BY 1) "


def _ledger_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.summary(LEDGER.docs(spark, sf_dir, ()), LEDGER.shard_size)


@_query("shard_assign", _SHARDS_SQL + "SELECT shard_base, n_blocks, n_docs FROM s")
def shard_assign(spark, sf_dir):
    return _ledger_shards(spark, sf_dir).select("shard_base", "n_blocks", "n_docs")


@_query("shard_boundaries", _SHARDS_SQL + "SELECT shard_base, lo AS start_num, hi AS end_num FROM s")
def shard_boundaries(spark, sf_dir):
    return _ledger_shards(spark, sf_dir).select("shard_base", "start_num", "end_num")


@_query("stop_block", f"WITH {_EVENTS_SQL} SELECT block_num, count(*) AS n_docs FROM docs WHERE block_num < 25 GROUP BY block_num")
def stop_block(spark, sf_dir):
    return shards.stop_before(EVENTS.docs(spark, sf_dir, ()), 25).groupBy("block_num").agg(F.count("*").alias("n_docs"))


_HOLED_SQL = _SHARDS_SQL + ", own AS (SELECT shard_base FROM s WHERE shard_base % 700 <> 600), gap AS (SELECT min(b) AS next_base FROM range(0, (SELECT max(shard_base) + 200 FROM own), 100) AS r(b) WHERE b NOT IN (SELECT shard_base FROM own)) "


@_query("next_unindexed", _HOLED_SQL + "SELECT next_base FROM gap")
def next_unindexed(spark, sf_dir):
    return shards.next_unindexed(_ledger_shards(spark, sf_dir).where("shard_base % 700 <> 600"), LEDGER.shard_size)


@_query("contiguous_prefix", _HOLED_SQL + "SELECT shard_base FROM own, gap WHERE shard_base < next_base")
def contiguous_prefix(spark, sf_dir):
    return shards.contiguous_prefix(_ledger_shards(spark, sf_dir).where("shard_base % 700 <> 600"), LEDGER.shard_size)


@_query("retention", _SHARDS_SQL + "SELECT shard_base FROM s WHERE shard_base >= ((SELECT max(block_num) FROM t) - 500) // 100 * 100")
def retention(spark, sf_dir):
    return shards.retained(_ledger_shards(spark, sf_dir).select("shard_base"), _head(spark, sf_dir), 500, LEDGER.shard_size)


@_query("integrity_gaps", f"""WITH {_LEDGER_SQL}, b AS (SELECT DISTINCT block_num FROM docs),
n AS (SELECT block_num AS prev_block, lead(block_num) OVER (PARTITION BY block_num // 100 ORDER BY block_num) AS next_block FROM b)
SELECT prev_block, next_block FROM n WHERE next_block > prev_block + 1""")  # fmt: skip
def integrity_gaps(spark, sf_dir):
    return shards.gaps(LEDGER.docs(spark, sf_dir, ()), LEDGER.shard_size)


@_query("integrity_counts", _SHARDS_SQL + "SELECT shard_base, n_blocks, lo, hi, n_blocks = 100 AND hi - lo = 99 AS ok FROM s")
def integrity_counts(spark, sf_dir):
    return shards.integrity(LEDGER.docs(spark, sf_dir, ()), LEDGER.shard_size)


@_query("prefix_scan", f"WITH {_EVENTS_SQL} SELECT trx_id, count(*) AS n FROM docs WHERE trx_id LIKE '12%' GROUP BY trx_id")
def prefix_scan(spark, sf_dir):
    return EVENTS.docs(spark, sf_dir, ()).where(F.col("trx_id").startswith("12")).groupBy("trx_id").agg(F.count("*").alias("n"))


@_query("warmup_count", f"WITH {_EVENTS_SQL} SELECT block_num - block_num % 10 AS shard_base, count(*) AS n FROM docs WHERE event_type = 'error' GROUP BY 1")
def warmup_count(spark, sf_dir):
    found = op.documents(spark, sf_dir, EVENTS, Query.of("event_type:error"), 0, ALL)
    return found.groupBy(shards.shard_base("block_num", EVENTS.shard_size).alias("shard_base")).agg(F.count("*").alias("n"))


_RARE = "event_type:error props.k:87"


@_query("empty_shards", f"WITH {_EVENTS_SQL} SELECT DISTINCT block_num - block_num % 10 AS shard_base FROM docs EXCEPT SELECT block_num - block_num % 10 FROM docs WHERE event_type = 'error' AND k = '87'")
def empty_shards(spark, sf_dir):
    return op.empty_shards(spark, sf_dir, EVENTS, Query.of(_RARE)).select("shard_base")


@_query("shard_skipping", f"WITH {_EVENTS_SQL} SELECT block_num, trx_id, action_idx FROM docs WHERE event_type = 'error' AND k = '87'")
def shard_skipping(spark, sf_dir):
    query = Query.of(_RARE)
    docs = op.skipping(EVENTS.docs(spark, sf_dir, query.names), op.empty_shards(spark, sf_dir, EVENTS, query), query, EVENTS.shard_size)
    return docs.where(query.predicate(EVENTS.fields)).select("block_num", "trx_id", "action_idx")


@_query("trim_zero", "SELECT event_id, CASE WHEN event_id = 0 THEN '0' ELSE ltrim(lpad(CAST(event_id AS VARCHAR), 8, '0'), '0') END AS trimmed FROM events")
def trim_zero(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", trim_zeros(F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("trimmed"))


@_query("chunk_map", """SELECT CAST(o_orderkey AS VARCHAR) AS trx_id, substr(p, 1, 4) AS c0, substr(p, 5, 4) AS c1, substr(p, 9, 4) AS c2
FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 16, '0') AS p FROM orders)""")  # fmt: skip
def chunk_map(spark, sf_dir):
    chunks = first_chunks(F.lpad(F.col("o_orderkey").cast("string"), 16, "0"), 4, 2)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("trx_id"), *(c.alias(f"c{k}") for k, c in enumerate(chunks)))


# --- streams -------------------------------------------------------------------------


@_query("stream_filter", f"WITH {_EVENTS_SQL} SELECT block_num, trx_id, action_idx FROM docs WHERE event_type = 'error'")
def stream_filter(spark, sf_dir):
    """A file stream run until it has caught up, into a table in the shared folder."""
    schema, query = read(spark, sf_dir, "events").schema, Query.of("event_type:error")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    docs = event_docs(source, query.names).where(query.predicate(EVENTS.fields)).select("block_num", "trx_id", "action_idx")
    return drained(docs, fresh_dir(spark, "stream"))


@_query("canonical_desc", f"""WITH {_EVENTS_SQL}, h AS (SELECT max(block_num) AS head FROM docs),
g AS (SELECT block_num, trx_idx, trx_id, string_agg(action_idx, ',' ORDER BY action_idx) AS action_idxs FROM docs, h WHERE event_type = 'error' AND block_num > head - 30 GROUP BY 1, 2, 3)
SELECT block_num, trx_id AS trx_id_prefix, row_number() OVER (PARTITION BY block_num ORDER BY trx_idx DESC) - 1 AS match_index, action_idxs,
       row_number() OVER (ORDER BY block_num DESC, trx_idx DESC) AS pos FROM g""")  # fmt: skip
def canonical_desc(spark, sf_dir):
    """The last 30 blocks of the head's branch, newest first; every fifth block also has an orphan twin, which must vanish."""
    query = Query.of("event_type:error")
    docs = EVENTS.docs(spark, sf_dir, query.names)
    blocks = docs.select("block_num").distinct()
    id_ = lambda tag, n: F.concat(F.lit(tag), n.cast("string"))
    real = blocks.select(F.col("block_num").alias("num"), id_("b", F.col("block_num")).alias("id"), id_("b", F.col("block_num") - 1).alias("prev_id"))
    orphans = blocks.where("block_num % 5 = 0").select(F.col("block_num").alias("num"), id_("x", F.col("block_num")).alias("id"), id_("b", F.col("block_num") - 1).alias("prev_id"))
    head = blocks.agg(F.max("block_num")).first()[0]
    chain = forks.canonical(real.union(orphans), f"b{head}", 30)
    tagged = docs.withColumn("id", id_("b", F.col("block_num"))).union(docs.where("block_num % 5 = 0").withColumn("id", id_("x", F.col("block_num"))))
    found = tagged.where(query.predicate(EVENTS.fields)).join(F.broadcast(chain.select("id")), "id", "left_semi")  # 30 rows
    matches = op.transactions(found, descending=True)
    pos = F.row_number().over(Window.orderBy(F.desc("block_num"), F.desc("trx_idx"))).cast("long")  # 30 blocks
    return matches.select("block_num", op.prefix().alias("trx_id_prefix"), "match_index", "action_idxs", pos.alias("pos"))


def _event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVENTS' documents with a block id and time: ``b<num>``; every fifth block has a twin ``x<num>``, which came first."""
    docs = EVENTS.docs(spark, sf_dir, ("event_type",))
    own = docs.withColumn("id", F.concat(F.lit("b"), F.col("block_num").cast("string")))
    twin = docs.where("block_num % 5 = 0 and block_num > 0").withColumn("id", F.concat(F.lit("x"), F.col("block_num").cast("string")))
    return own.union(twin)


def _block_stream(spark: SparkSession, sf_dir: str, query: Query) -> DataFrame:
    """The blocks as a file stream of rows for :func:`forks.follow`, matched block by block before any state; finality is twelve blocks behind."""
    rows = forks.index_blocks(_event_blocks(spark, sf_dir), ("id", "block_num")).withColumnRenamed("block_num", "num")
    path = fresh_dir(spark, "blocks")
    rows.write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return stream.select(
        F.lit("events").alias("chain"), "num", "id", F.concat(F.lit("b"), (F.col("num") - 1).cast("string")).alias("prev_id"), F.greatest(F.col("num") - 12, F.lit(-1)).alias("lib_num"),
        (2 * F.col("num") + F.col("id").startswith("b").cast("int")).alias("arrival"),
        forks.block_matches(F.col("docs"), lambda d: compile_predicate(query.expr, replace(EVENTS.fields, root=d))).alias("matches"),
    )


_LIVE_SQL = f"""WITH {_EVENTS_SQL}, h AS (SELECT max(block_num) AS head FROM docs),
g AS (SELECT block_num, trx_id AS trx_id_prefix, trx_idx, string_agg(action_idx, ',' ORDER BY action_idx) AS action_idxs FROM docs WHERE event_type = 'error' GROUP BY 1, 2, 3),
r AS (SELECT block_num, trx_id_prefix, row_number() OVER (PARTITION BY block_num ORDER BY trx_idx) - 1 AS match_index, action_idxs FROM g),
steps AS (
  SELECT r.*, 'new' AS step, 'b' || block_num AS block_id FROM r, h WHERE block_num % 5 <> 0 OR block_num = 0 OR block_num < head
  UNION ALL SELECT r.*, 'new', 'x' || block_num FROM r WHERE block_num % 5 = 0 AND block_num > 0
  UNION ALL SELECT r.*, 'undo', 'x' || block_num FROM r, h WHERE block_num % 5 = 0 AND block_num > 0 AND block_num < head)
"""
_LIVE = ("step", "block_num", "block_id", "trx_id_prefix", "match_index", "action_idxs", "cursor", "undo")
_LIVE_COLUMNS = "step, block_num, block_id, trx_id_prefix, match_index, action_idxs, '1:' || block_num || ':' || block_id || ':' || trx_id_prefix AS cursor, step = 'undo' AS undo"


def _live(name: str, sql: str, request: forks.Follow) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        steps = forks.follow(_block_stream(spark, sf_dir, Query.of("event_type:error")), request=request)
        return forks.live_rows(drained(steps, fresh_dir(spark, name))).select(*_LIVE)

    _query(name, sql)(run)


_live("live_steps", _LIVE_SQL + f"SELECT {_LIVE_COLUMNS} FROM steps", forks.Follow())
_live("live_final", _LIVE_SQL + f"""SELECT 'irreversible' AS step, block_num, block_id, trx_id_prefix, match_index, action_idxs,
 '1:' || block_num || ':' || block_id || ':' || trx_id_prefix AS cursor, false AS undo
FROM (SELECT r.*, 'b' || block_num AS block_id FROM r, h WHERE block_num <= head - 12 AND block_num BETWEEN 10 AND 60)""", forks.Follow(reversible=False, low=10, high=60, gate=10))  # fmt: skip


@_query("live_markers", f"WITH {_EVENTS_SQL} SELECT DISTINCT block_num, '1:' || block_num || ':b' || block_num || ':' AS cursor FROM docs WHERE block_num >= 21 AND (block_num - 21) % 7 = 0 AND block_num <= (SELECT max(block_num) FROM docs) - 12")
def live_markers(spark, sf_dir):
    """Empty rows of an irreversible request every seven blocks, from the head of its time (21) on."""
    request = forks.Follow(reversible=False, marker_interval=7, marker_after=21)
    rows = forks.live_rows(drained(forks.follow(_block_stream(spark, sf_dir, Query.of("event_type:error")), request=request), fresh_dir(spark, "markers")))
    return rows.where("live_marker").select("block_num", "cursor")


@_query("undo_by_id", _LIVE_SQL + """SELECT 'x' || block_num AS id, block_num, trx_id_prefix, match_index, action_idxs, CAST(9 AS BIGINT) AS irr_block_num, true AS undo FROM r WHERE block_num IN (10, 15)""")
def undo_by_id(spark, sf_dir):
    """The twins of blocks 10 and 15 are taken back; the blocks of the same numbers that stayed are not."""
    dead = spark.createDataFrame([("x10",), ("x15",)], "id string")
    found = op.undo_by_id(_event_blocks(spark, sf_dir), Query.of("event_type:error"), EVENTS.fields, dead)
    return found.select("id", "block_num", "trx_id_prefix", "match_index", "action_idxs", "irr_block_num", "undo")


@_query("fork_resume", _LIVE_SQL + """SELECT 'x' || block_num AS id, block_num, trx_id_prefix, match_index, true AS undo FROM r WHERE block_num = 20
UNION ALL SELECT 'b' || block_num, block_num, trx_id_prefix, match_index, false FROM r, h WHERE block_num BETWEEN 20 AND 34""")  # fmt: skip
def fork_resume(spark, sf_dir):
    """A cursor on a block that was left: its branch's matches are taken back, then the listing starts again at the lowest dead block, without the cursor."""
    query, at = Query.of("event_type:error"), Cursor.parse("1:20:x20:40")
    docs = _event_blocks(spark, sf_dir)
    blocks = docs.where("block_num <= 34").select(F.col("block_num").alias("num"), "id", F.concat(F.lit("b"), (F.col("block_num") - 1).cast("string")).alias("prev_id")).distinct()
    dead = forks.dead_blocks(blocks, at, "b34", depth=100)
    low = dead.agg(F.min("num")).first()[0]
    gone = op.undo_by_id(docs, query, EVENTS.fields, dead).select("id", "block_num", "trx_id_prefix", "match_index", "undo")
    again = op.transactions(op.documents(spark, sf_dir, EVENTS, query, low, 34))
    return gone.union(again.select(F.concat(F.lit("b"), F.col("block_num").cast("string")), "block_num", op.prefix(), "match_index", F.lit(False)))


@_query("cursor_valid", "SELECT * FROM (VALUES ('1:20:b20:', true), ('1:20:x20:', false), ('1:30:x30:', true), ('1:20::', true)) AS t(cursor, valid)")
def cursor_valid(spark, sf_dir):
    """At irreversible block 25: the twin of block 20 is dead, that of block 30 can still be taken back."""
    chain = EVENTS.docs(spark, sf_dir, ()).select(F.col("block_num").alias("num"), F.concat(F.lit("b"), F.col("block_num").cast("string")).alias("id"))
    cases = ["1:20:b20:", "1:20:x20:", "1:30:x30:", "1:20::"]
    return spark.createDataFrame([(c, forks.still_valid(Cursor.parse(c), chain, 25)) for c in cases], "cursor string, valid boolean")


# --- the shard store -----------------------------------------------------------------


def _ledger_store(spark: SparkSession, sf_dir: str, fields: tuple[str, ...]) -> ShardStore:
    """LEDGER with its ranks and ``fields`` in a store: days without orders are no faults here."""
    store = ShardStore(spark, fresh_dir(spark, "store"), LEDGER.shard_size)
    docs = LEDGER.docs(spark, sf_dir, fields).withColumn("block_id", F.col("block_num").cast("string")).withColumn("block_time", F.lit(None).cast("timestamp"))
    store.publish(docs, whole=False)
    return store


@_query("store_flagship", _flag + _STD_SQL + " WHERE pos <= 50")
def store_flagship(spark, sf_dir):
    """The flagship out of the store: terms and range are filters of the scan, ranks are read, nothing is joined."""
    query = Query.of(FLAGSHIP)
    docs = _ledger_store(spark, sf_dir, tuple(query.names)).read(0, ALL).where(query.predicate(LEDGER.fields))
    return op.page(op.transactions(docs), limit=50).select(*_STD)


@_query("store_range", _docs_sql(LEDGER, "returnflag = 'A'", 730, 760))
def store_range(spark, sf_dir):
    query = Query.of("returnflag:A")
    return _ledger_store(spark, sf_dir, ("returnflag",)).read(730, 760).where(query.predicate(LEDGER.fields)).select("block_num", "trx_id", "action_idx")


_BOUNDS_SQL = f"""WITH {_EVENTS_SQL}, b AS (SELECT block_num, count(*) AS n, min(ts) AS t FROM docs GROUP BY 1),
s AS (SELECT block_num - block_num % 10 AS shard_base, min(block_num) AS start_num, max(block_num) AS end_num, min(t) AS start_time, max(t) AS end_time, count(*) AS n_blocks, CAST(sum(n) AS BIGINT) AS n_docs FROM b GROUP BY 1) """


@_query("store_boundaries", _BOUNDS_SQL + """SELECT shard_base, start_num, 'b' || start_num AS start_id, epoch_us(start_time) AS start_us, end_num, 'b' || end_num AS end_id, epoch_us(end_time) AS end_us,
 n_blocks, n_docs, n_blocks = 10 AS valid, EXISTS (SELECT 1 FROM s AS x WHERE x.shard_base = s.shard_base + 10) AS followed FROM s""")  # fmt: skip
def store_boundaries(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    docs = event_docs(events, ("event_type",)).select("block_num").join(events.select(F.expr("event_id div 20").alias("block_num"), "ts").groupBy("block_num").agg(F.min("ts").alias("t")), "block_num")
    docs = docs.select("block_num", F.concat(F.lit("b"), F.col("block_num").cast("string")).alias("block_id"), F.col("t").cast("timestamp").alias("block_time"))
    report = analyze(boundaries(docs, EVENTS.shard_size), EVENTS.shard_size)
    return report.select(
        "shard_base", "start_num", "start_id", F.unix_micros("start_time").alias("start_us"), "end_num", "end_id", F.unix_micros("end_time").alias("end_us"),
        "n_blocks", "n_docs", (F.size("faults") == 0).alias("valid"), "followed",
    )


@_query("store_follow", _BOUNDS_SQL + "SELECT shard_base, n_docs FROM s WHERE n_blocks = 10")
def store_follow(spark, sf_dir):
    """A stream into the store: shards are published as they become whole.  The path is a pattern, which streams take for a file and for a folder of files."""
    events = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    docs = event_docs(events, ("event_type",)).withColumn("block_id", F.concat(F.lit("b"), F.col("block_num").cast("string"))).withColumn("block_time", F.timestamp_seconds(F.col("block_num")))
    store = ShardStore(spark, fresh_dir(spark, "follow"), EVENTS.shard_size)
    store.ingest(docs)
    return store.meta().select("shard_base", "n_docs")


@_query("empty_cached", f"WITH {_EVENTS_SQL} SELECT DISTINCT block_num - block_num % 10 AS shard_base FROM docs WHERE block_num BETWEEN 10 AND 59 EXCEPT SELECT block_num - block_num % 10 FROM docs WHERE event_type = 'error' AND k = '87'")
def empty_cached(spark, sf_dir):
    """A request of blocks 5 to 64 covers five shards; those without a match are kept in a table and read again."""
    query, known = Query.of(_RARE), op.EmptyResults(spark, fresh_dir(spark, "empty"))
    known.publish(op.empty_shards(spark, sf_dir, EVENTS, query, 5, 64))
    return known.of(query, EVENTS.shard_size).select("shard_base")


@_query("chunk_hex", "SELECT o_orderkey, CASE WHEN h = '' THEN '0' ELSE h END AS c0 FROM (SELECT o_orderkey, ltrim(lower(hex(substr(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 1, 2))), '0') AS h FROM orders)")
def chunk_hex(spark, sf_dir):
    key = F.lpad(F.col("o_orderkey").cast("string"), 8, "0").cast("binary")
    return read(spark, sf_dir, "orders").select("o_orderkey", chunks_of(key, 2, 1)["c0"].alias("c0"))


@_query("collected", f"""WITH {_LEDGER_SQL} SELECT block_num, substr(trx_id, 1, 12) AS trx_id_prefix, string_agg(action_idx, ',' ORDER BY action_idx) AS action_idxs,
 count(DISTINCT linestatus) AS n_status, upper(min(priority)) AS label FROM docs WHERE returnflag = 'R' GROUP BY 1, 2""")  # fmt: skip
def collected(spark, sf_dir):
    """The collector hook adds aggregates of a transaction's matches, the payload hook columns of a result row."""
    docs = op.documents(spark, sf_dir, LEDGER, Query.of("returnflag:R -(linestatus:none OR priority:none)"), 0, ALL)
    found = op.transactions(docs, collect=lambda: [F.count_distinct("linestatus").alias("n_status"), F.min("priority").alias("p")])
    rows = op.page(found, payload=lambda rows: rows.withColumn("label", F.upper("p")))
    return rows.select("block_num", "trx_id_prefix", "action_idxs", "n_status", "label")
