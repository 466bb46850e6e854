"""Boolean search over postings.

A query is read by the document tokenizer: one term, or two terms around AND,
OR or NOT.  Terms of queries are not stemmed unless asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import stemmer, tokenizer
from lexiforge.sources.storage import numbered

OPERATORS = ("and", "or", "not")
#: Terms of a batch that are pushed to the files as a filter; a larger batch meets the index in a join alone.
_PUSHED = 1000


class UnsupportedQuery(ValueError):
    """A query of another shape, in strict mode."""


def parse_query(spark, query: str, stem_query: bool = False) -> list[str]:
    """Tokens of a query."""
    c = tokenizer.tokens(F.lit(query))
    if stem_query:
        c = F.transform(c, lambda t: F.when(F.lower(t).isin(*OPERATORS), t).otherwise(stemmer.stem(t)))
    return spark.range(1).select(c.alias("t")).first().t


def lookup(posted: DataFrame, term: str) -> DataFrame:
    """Documents with a term; over a stored index the filter reaches the files."""
    return posted.where(F.col("term") == term).select("doc_id").distinct()


def search(posted: DataFrame, query: str, strict: bool = False, stem_query: bool = False) -> DataFrame:
    """(doc_id) of the documents a query finds, ascending.

    A query of another shape finds nothing; with ``strict`` it raises.
    """
    parts = parse_query(posted.sparkSession, query, stem_query)
    if len(parts) == 1:
        return lookup(posted, parts[0]).orderBy("doc_id")
    if len(parts) == 3 and parts[1].lower() in OPERATORS:
        # one scan serves both terms: the operator is a condition on which of them a document has
        left, right = parts[0], parts[2]
        own = posted.where(F.col("term").isin(left, right)).groupBy("doc_id").agg(F.max(F.col("term") == left).alias("l"), F.max(F.col("term") == right).alias("r"))
        kept = {"and": F.col("l") & F.col("r"), "or": F.col("l") | F.col("r"), "not": F.col("l") & ~F.col("r")}[parts[1].lower()]
        return own.where(kept).select("doc_id").orderBy("doc_id")
    if strict and parts:
        raise UnsupportedQuery(query)
    return posted.select("doc_id").where(F.lit(False))


def with_urls(found: DataFrame, forward_rows: DataFrame) -> DataFrame:
    """Results numbered from 1 by document, with URLs ('' where unknown)."""
    named = found.join(forward_rows, "doc_id", "left").select("doc_id", F.coalesce("url", F.lit("")).alias("url"))
    return numbered(named, [F.asc("doc_id")], "n").select("n", "doc_id", "url")


def batch_search(posted: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) for a table of queries (query_id, query), in one join."""
    parsed = queries.select("query_id", tokenizer.tokens(F.col("query")).alias("t"))
    op = F.when(F.size("t") == 1, F.lit("one")).when((F.size("t") == 3) & F.lower(F.get("t", F.lit(1))).isin(*OPERATORS), F.lower(F.get("t", F.lit(1))))
    shaped = parsed.select("query_id", op.alias("op"), F.get("t", F.lit(0)).alias("l"), F.get("t", F.lit(2)).alias("r")).where("op is not null")
    sides = shaped.select("query_id", "op", F.explode(F.array(F.struct(F.col("l").alias("term"), F.lit(1).alias("side")), F.struct(F.col("r").alias("term"), F.lit(2).alias("side")))).alias("x")).select("query_id", "op", "x.term", "x.side")
    asked = sides.where("term is not null")
    few = [r.term for r in asked.select("term").distinct().limit(_PUSHED + 1).collect()]
    reached = posted.where(F.col("term").isin(few)) if len(few) <= _PUSHED else posted  # a few terms are a filter on the files
    hit = reached.join(asked, "term").groupBy("query_id", "op", "doc_id").agg(F.max(F.col("side") == 1).alias("l"), F.max(F.col("side") == 2).alias("r"))
    kept = F.when(F.col("op") == "and", F.col("l") & F.col("r")).when(F.col("op") == "or", F.col("l") | F.col("r")).when(F.col("op") == "not", F.col("l") & ~F.col("r")).otherwise(F.col("l"))
    return hit.where(kept).select("query_id", "doc_id")
