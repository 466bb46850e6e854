"""Inverted and forward index as relations.

The canonical inverted index is the set of rows (term, doc_id); lists per term
are an aggregate of it, in blocks of documents.  Terms are de-duplicated per
document before the exchange, so the shuffle carries each posting once.  Stored,
postings are sorted by term, so a search reads the row groups of its terms only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import stemmer, tokenizer
from lexiforge.sources.storage import spread


def postings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", stem: bool = False, max_docs: int = -1, stop_words: DataFrame | None = None, fix_yo: bool = False) -> DataFrame:
    """(term, doc_id), each pair once.

    max_docs: only ids below it (negative: all).  stop_words: a table of
    ``word`` whose terms are left out.
    """
    docs = docs if max_docs < 0 else docs.where(F.col(doc_id) < max_docs)
    terms = tokenizer.distinct_terms(spread(docs.select(doc_id, text)), text, doc_id, fix_yo).select("term", F.col(doc_id).alias("doc_id"))
    if stem:
        terms = stemmer.with_stems(terms).where("stem <> ''").select(F.col("stem").alias("term"), "doc_id").distinct()
    if stop_words is not None:
        terms = terms.join(stop_words.select(tokenizer.lower(F.col("word")).alias("term")).distinct(), "term", "left_anti")
    return terms


def posting_lists(posted: DataFrame, block_docs: int = 1 << 20) -> DataFrame:
    """(term, block, doc_ids ascending): a term's list in blocks of ``block_docs`` ids, so no row grows with the corpus."""
    return posted.groupBy("term", F.floor(F.col("doc_id") / block_docs).alias("block")).agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def forward(docs: DataFrame, url: str = "url", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, url)."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))


def index_sizes(posted: DataFrame, forward_rows: DataFrame) -> DataFrame:
    """Bytes of both indexes in their binary form, in closed form.

    A list takes 12 bytes, its term and 4 a document; a document 12 and its
    URL; each file 4.
    """
    terms = posted.groupBy("term").count().select(F.lit(True).alias("is_term"), (F.lit(12) + F.octet_length("term") + 4 * F.col("count")).cast("long").alias("bytes"))
    both = terms.unionByName(forward_rows.select(F.lit(False).alias("is_term"), (F.lit(12) + F.octet_length("url")).cast("long").alias("bytes")))
    total = lambda side: (F.coalesce(F.sum(F.when(side, F.col("bytes"))), F.lit(0)) + 4).cast("long")
    return both.agg(total(F.col("is_term")).alias("inverted_bytes"), F.count_if("is_term").alias("unique_terms"), total(~F.col("is_term")).alias("forward_bytes"), F.count_if(~F.col("is_term")).alias("documents"))


def write_index(posted: DataFrame, forward_rows: DataFrame, path: str) -> None:
    """Postings in ranges of terms, sorted, so a lookup prunes row groups; documents by id."""
    posted.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    forward_rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/forward")


def load_inverted(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id) of a stored index."""
    return spark.read.parquet(f"{path}/postings").select("term", "doc_id")


def load_forward(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, url) of a stored index."""
    return spark.read.parquet(f"{path}/forward").select("doc_id", "url")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Inverted and forward index; fails if either is not there."""
    return load_inverted(spark, path), load_forward(spark, path)
