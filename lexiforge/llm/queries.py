"""Queries of the training-data operators over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import castore, crossparse, decontam, editcount, histsort, lpf, packing, quality, replytree, setsketch
from lexiforge.llm.common import read_table, stage


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fertility(read_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the words of passages of over 50 words that stand elsewhere (they may be shorter than 400 bytes)."""
    docs = read_table(spark, sf_dir, "documents")
    judged = lpf.judge_texts(docs).select("tid", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return lpf.repeated_words(docs).join(judged, "tid").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histsort.histogram_sort(read_table(spark, sf_dir, "documents"), key="doc_id")
    text = F.coalesce("text", F.lit("")).cast("binary")
    return placed.select("doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.near_duplicates(read_table(spark, sf_dir, "documents"), k=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op7_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crossparse.fold_of() == 2
    trained = crossparse.train(docs.where(~held_out))
    return crossparse.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), trained, keep=["doc_id", "held_out"])


def op8_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = castore.new_store(read_table(spark, sf_dir, "documents"))
    contents = castore.read_contents(spark, path).select("root", F.crc32("ids").alias("ids_crc32"))
    return castore.read_recipes(spark, path).join(contents, "root").select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits in every document: a word replaced, a phrase put in, a stretch cut out."""
    n = F.length("text")
    edit = lambda at, cut, put: F.struct(F.floor(at).cast("int").alias("at"), F.lit(cut).alias("cut"), F.lit(put).alias("put"))
    edits = F.array(edit(n / 4, 6, "Revised"), edit(n / 2, 0, " (see section 12, below) "), edit(3 * n / 4, 40, ""))
    # the trees are kept in a table, as they would be between edits
    trees = stage(editcount.build_trees(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "trees")
    done = editcount.apply_edits(trees.withColumn("edits", edits), keep=["doc_id", "n_tokens"])
    return done.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_leaves", "n_leaves_encoded", "n_chars_encoded", F.crc32(F.col("edited_text").cast("binary")).alias("edited_crc32"))


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tree = replytree.chain_by_turn(rows.unionByName(replytree.probe_rows(spark)))
    done = replytree.read_back(replytree.format_paths(tree))
    return done.select(F.col("tree_id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES = {
    "op1_fertility": op1_fertility,
    "op2_packing": op2_packing,
    "op3_templates": op3_templates,
    "op4_repeats": op4_repeats,
    "op5_histogram_sort": op5_histogram_sort,
    "op6_setsketch": op6_setsketch,
    "op7_cross_parsing": op7_cross_parsing,
    "op8_store": op8_store,
    "op9_edit_counts": op9_edit_counts,
    "op10_reply_trees": op10_reply_trees,
}

ORACLE_SQL: dict[str, str] = {}
