"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``, whatever else those are called: a row travels as one
struct beside the columns that an operator reads.

Defined results: rows with a null id take part in the quality and encoding stages only and are kept by the others.
Null and empty texts fail the quality rules. Rows that share an id share the later stages' verdicts. An empty table
passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm.bpe import encode
from courtside.llm.decontaminate import leaks
from courtside.llm.line_dedup import dedup_lines
from courtside.llm.near_dups import near_duplicates
from courtside.llm.quality_rules import judge_quality
from courtside.shared import materialize
from courtside.tables import table


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    judged = judge_quality(_packed(docs), table(spark, sf_dir, "labels"), F.col("quality") == 0, keep=("__row",))
    return judged.where("kept").select("__row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which only white space is left were repeats, and go."""
    cleaned = dedup_lines(_packed(docs))
    cleaned = cleaned.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    row = F.col("__row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars")))
    return cleaned.select(row.alias("__row")).select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group linked by five-word shingles at a similarity of 0.8 or more."""
    groups = near_duplicates(docs, percent=80, size=5, rows=5, bands=30)
    gone = materialize(groups.where("NOT kept").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    gone = materialize(leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hash of the text that they decode to."""
    # small blocks: workers and executors still hold what the stages before took
    encoded = encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True, max_pieces=60_000, block_bytes=1_500_000)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("BPE", encode_bpe)]

#: Near-dedup, tiling and BPE have no SQL form; tests of the operators hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
