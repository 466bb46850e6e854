"""Vocabulary statistics: frequencies, Zipf ranks and fit, lengths, stem groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions import stemmer, tokenizer
from lexiforge.sources.storage import numbered, spread


def term_frequency(docs: DataFrame, text: str = "text", stem: bool = False) -> DataFrame:
    """(term, freq) of texts that are not blank: tokens of letters only or digits only; stems after the filter.

    Tokens are counted first; rules and stemmer see the vocabulary, not its occurrences.
    """
    rows = spread(docs.select(text)).where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    freqs = tokenizer.term_counts(rows, text).where(tokenizer.is_alnum_token(F.col("term")))
    return stemmer.stem_terms(freqs, "term").groupBy(F.col("stem").alias("term")).agg(F.sum("freq").alias("freq")) if stem else freqs


def zipf_ranks(freqs: DataFrame) -> DataFrame:
    """(rank, term, freq, theoretical) by falling frequency, then term.

    The vocabulary is sorted in ranges, never in one task; the ranges' sizes
    give each range its first rank.
    """
    ranked = numbered(freqs.select("term", "freq"), [F.desc("freq"), F.asc("term")], "rank")
    top = ranked.agg(F.max("freq")).first()[0]
    return ranked.select("rank", "term", "freq", (F.lit(top).cast("long") / F.col("rank")).alias("theoretical"))


def zipf_r_squared(ranked: DataFrame) -> DataFrame:
    """R squared of the line of slope -1 through (ln rank, ln freq), with the points' number.

    NaN under two points; of equal frequencies 1 if the line fits, else 0.
    """
    lf, s = F.ln("freq"), F.ln("freq") + F.ln("rank")
    figures = ranked.agg(F.count(F.lit(1)).alias("n"), F.var_pop(s).alias("res"), F.var_pop(lf).alias("tot"), F.min("freq").alias("low"), F.max("freq").alias("high"), F.sum("freq").alias("total"))
    flat = F.when(F.col("res") < 1e-18, 1.0).otherwise(0.0)
    r2 = F.when(F.col("n") < 2, float("nan")).when(F.col("low") == F.col("high"), flat).otherwise(1 - F.col("res") / F.col("tot"))
    return figures.select("n", F.coalesce("total", F.lit(0)).alias("total"), r2.alias("r_squared"))


def length_stats(freqs: DataFrame) -> DataFrame:
    """Tokens, distinct ones and their lengths in characters, from frequencies."""
    n = F.char_length("term")
    return freqs.agg(
        F.coalesce(F.sum("freq"), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("unique_tokens"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("longest_chars"),
        F.coalesce(F.min(n), F.lit(0)).cast("long").alias("shortest_chars"), F.coalesce(F.sum(n * F.col("freq")) / F.sum("freq"), F.lit(0.0)).alias("avg_chars"),
    )


def stem_change(words: DataFrame) -> DataFrame:
    """Share of distinct words (column ``word``) that stemming changes, in percent."""
    changed = stemmer.stem_terms(words.select("word").distinct()).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("word") != F.col("stem")).alias("changed"))
    return changed.select("n", "changed", F.when(F.col("n") > 0, F.lit(100.0) * F.col("changed") / F.col("n")).otherwise(0.0).alias("percentage_changed"))


def stem_groups(words: DataFrame, top: int = 5, shown: int = 5) -> DataFrame:
    """The ``top`` stems with most words; if no stem has two, the first groups of one.

    Words are ranked within their stem by a sort, so a group is never held whole;
    a group keeps the ``shown`` words it shows.
    """
    ranked = stemmer.stem_terms(words.select("word").distinct()).withColumn("at", F.row_number().over(Window.partitionBy("stem").orderBy("word")))
    first = F.array_sort(F.collect_list(F.when(F.col("at") <= shown, F.col("word"))))
    sized = ranked.groupBy("stem").agg(F.max("at").alias("size"), F.array_join(first, " ").alias("originals"))
    return sized.select("stem", "size", "originals").orderBy((F.col("size") < 2), F.desc("size"), "stem").limit(top)


def top_terms(freqs: DataFrame, n: int = 5) -> DataFrame:
    return freqs.orderBy(F.desc("freq"), "term").limit(n)
