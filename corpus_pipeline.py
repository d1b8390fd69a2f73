"""Corpus pipeline: language ID, near-dedup, decontamination, secret scan, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
a DataFrame; all but the last return the columns of documents.  Between stages tables are
written as Parquet and read again.  An empty table of documents runs through all stages and
gives no rows; texts of any length are read whole; further columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerseek.llm import decontam, langid, neardup, pieces, secrets
from ledgerseek.llm.common import Scratch

#: A document whose best language has no more than this share of the code-length score is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: Similarity in percent from which the near_dedup stage links documents (op3's contract is 85), and its bands of rows:
#: a pair at exactly 0.80 shares fewer than two of them with probability below 1e-5.
NEAR_PERCENT, NEAR_BANDS, NEAR_ROWS = 80, 28, 4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null, no letter) or without a clear one; repeated rows share one decision."""
    model = langid.train(langid.learnable(docs))
    return langid.accepted(docs, model, LEAST_LANGUAGE_SCORE)


def _once(rows: DataFrame) -> DataFrame:
    """One of the rows that agree in doc_id and text: the first by their other columns."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in ("doc_id", "text")]
    place, hashed = f"{max(rows.columns, key=len)}_place", F.xxhash64("text")
    numbered = rows.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", hashed, "text").orderBy(*(rest or [F.lit(0)]))))
    return numbered.where(F.col(place) == 1).select(rows.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the document with the smallest doc_id.

    Rows that share a kept doc_id: each text of theirs once (the row whose other columns sort first), as different texts
    are different documents.  Rows without a doc_id are in no group: likewise each text once.  Null and
    wordless texts are groups of their own and stay.
    """
    groups = neardup.groups(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS, rows=NEAR_ROWS)
    scratch, name = Scratch(spark, "pipeline"), f"{max(docs.columns, key=len)}_kept"
    kept = scratch.put(groups.where("kept and doc_id is not null").select(F.col("doc_id").alias(name)).groupBy(name).count(), "kept")
    named = docs.join(kept.select(name), F.col(name) == F.col("doc_id").cast("long"), "left_semi")
    nameless = docs.where("doc_id is null")
    again = kept.where("count > 1").select(name)
    if not again.isEmpty():
        shared = F.col(name) == F.col("doc_id").cast("long")
        named = named.join(again, shared, "left_anti").union(_once(named.join(again, shared, "left_semi")))
    return named if nameless.isEmpty() else named.union(_once(nameless))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, exactly or within a fifth of its words; null and empty texts stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in texts; n_chars follows the text. No document goes; null stays null."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and whether the decoded text is the text again; a null text is encoded as the empty one."""
    return pieces.round_trip(docs, keep=["doc_id", "text"]).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("sentencepiece", tokenize),
]

ORACLE_SQL = None  # PPM scores, sketches and token ids are beyond SQL: tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written in the shared folder and read again."""
    scratch = Scratch(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
