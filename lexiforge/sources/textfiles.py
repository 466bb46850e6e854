"""Positional text files: line i of one file belongs to line i of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What counts as white space in exported text.
WHITE_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def one_line(text: Column) -> Column:
    """A text on one line, its white space collapsed."""
    return F.trim(F.regexp_replace(text, WHITE_SPACE, " "))


def export(store: DataFrame, path: str, order: str = "url") -> None:
    """Rows with URL and text as two folders of lines in the same order."""
    both = store.where(F.col("url").isNotNull() & F.col("clean_text").isNotNull() & (F.col("clean_text") != ""))
    ranged = both.select(order if order == "url" else F.col(order), one_line(F.col("clean_text")).alias("text"), *([] if order == "url" else ["url"])).repartitionByRange(order).sortWithinPartitions(order)
    ranged.select(F.col("text").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/text")
    ranged.select(F.col("url").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/url")


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines with their place from 0; the sizes of the splits, in the order of the files, give what comes before each."""
    split = ["file", "block"]
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias(name), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    sizes = lines.groupBy(*split).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).orderBy(*split).collect()  # one row a split
    before, starts = 0, []
    for r in sizes:
        starts.append((r.file, r.block, before - r.first))
        before += r.n
    known = spark.createDataFrame(starts, "file string, block long, shift long")
    return lines.join(F.broadcast(known), split).select((F.col("at") + F.col("shift")).alias("doc_id"), name)


def load(spark: SparkSession, text_path: str, url_path: str, max_docs: int = -1) -> DataFrame:
    """(doc_id, url, text) of two line files; ids count from 0, the shorter file ends it.

    max_docs: at most so many documents (negative: all).
    """
    both = _numbered(spark, url_path, "url").join(_numbered(spark, text_path, "text"), "doc_id")
    return both if max_docs < 0 else both.where(F.col("doc_id") < max_docs)


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): one a line, trimmed, in lower case, once each."""
    from lexiforge.functions import stemmer

    words = F.btrim("value", F.lit(" \t\r\n"))
    return spark.read.option("lineSep", "\n").text(path).select(F.translate(words, stemmer.UPPER[:33], stemmer.LOWER[:32] + "ё").alias("word")).where("word <> ''").distinct()
