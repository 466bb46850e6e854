"""The corpus pipeline: quality rules, near copies, repeated passages, leaks, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last give
the columns of ``documents``.

Defined results: null texts count as empty and go in the first stage (no
words); rows of one id and one text are one document; documents whose text
consists of repeats only go with it; an empty table gives an empty result;
extra columns are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import decontam, lpf, packing, quality, setsketch
from lexiforge.llm.common import columns_of, own_prefix, read_table, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep."""
    row = f"{own_prefix(docs)}row"
    judged = quality.fertility(docs.withColumn(row, F.struct(*columns_of(docs))), keep=[row])
    return judged.where("kept").select(f"{row}.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group of near copies (five-word shingles, overlap 0.8)."""
    found = setsketch.near_duplicates(docs, k=5, percent=80)
    p = own_prefix(docs)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(f"{p}id"), F.col("th").alias(f"{p}th")).distinct()
    keyed = docs.withColumn(f"{p}h", F.xxhash64(F.col("text").cast("string")))
    kept = keyed.join(stays, (F.col(f"{p}h") == F.col(f"{p}th")) & F.col("doc_id").eqNullSafe(F.col(f"{p}id")), "left_semi")
    return kept.dropDuplicates(["doc_id", f"{p}h"]).select(columns_of(docs))  # rows of one id and text are one document


#: Bytes of a repeated passage: what fifty words of short prose take.
PASSAGE = 256


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less every later copy of a passage of ``PASSAGE`` bytes; what is left empty goes."""
    cut = lpf.remove_repeats(docs, length=PASSAGE, keep="first")
    left = cut.where(F.col("text").isNull() | (F.length("text") > 0))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(columns_of(docs)) if "n_chars" in docs.columns else left


def leaked_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    name = f"{own_prefix(docs)}id"
    leaks = decontam.leaks(docs, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stage(leaks, "leaks"), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_copies),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", leaked_benchmarks),
    ("packing", packed),
]

#: Tokenisers and suffix order are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
