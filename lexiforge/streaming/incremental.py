"""Incremental index: documents arrive as files, new postings are appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiforge.operators import index, store

STORE = "url string, source_name string, raw_html string, clean_text string, content_hash string, crawled_at long, created_at long"


def index_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, stem: bool = False, files: str = "*.parquet", nested: bool = False) -> StreamingQuery:
    """Append (term, doc_id) of every new file of the folder ``source`` (names like ``files``) to ``out``.

    ``source`` may be a pattern; it then takes the files it matches and those in the folders it matches.
    ``nested`` takes those of folders within too, as of a table written in partitions.

    A batch replayed after a failure overwrites its own folder, so postings are
    written exactly once; the checkpoint keeps which files are done.
    """

    def append(batch: DataFrame, number: int) -> None:
        index.postings(batch, stem=stem).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{out}/batch={number}")

    docs = spark.readStream.schema(schema).option("pathGlobFilter", files).option("recursiveFileLookup", nested).parquet(source)
    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_stream(spark: SparkSession, source: str, out: str, checkpoint: str, now: int, days: int) -> StreamingQuery:
    """Merge every new file of fetched pages (url, raw_html, clean_text, source_name) into the store under ``out``.

    Change is told by content hash.  A batch reads the version before it and
    writes its own, so one replayed after a failure gives the same store; the
    version before stays until the next batch, older ones may go.  Stop the
    query (``query.stop()``) to end between batches; ``maxFilesPerTrigger`` of
    the source limits its rate, and ``query.recentProgress`` tells how far it is.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("url").agg(F.max(F.struct("raw_html", "clean_text", "source_name")).alias("p")).select("url", "p.*")  # a page met twice in a batch counts once
        old = spark.read.schema(STORE).parquet(f"{out}/version={number - 1}") if number else spark.createDataFrame([], STORE)
        store.merge(old, last, now, days).select(*[c.split()[0] for c in STORE.split(", ")]).write.mode("overwrite").parquet(f"{out}/version={number}")

    pages = spark.readStream.schema("url string, raw_html string, clean_text string, source_name string").option("maxFilesPerTrigger", 1000).parquet(source)
    return pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, out: str) -> DataFrame:
    """The latest version of the store."""
    versions = spark.read.option("basePath", out).parquet(f"{out}/version=*")
    latest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == latest).drop("version")


def read_postings(spark: SparkSession, out: str) -> DataFrame:
    """The index so far; a document sent twice counts once."""
    return spark.read.parquet(out).select("term", "doc_id").distinct()
