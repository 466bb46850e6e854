"""Domain tokenizer as Catalyst expressions.

Text is cut at white space and most ASCII punctuation (``- / % + .`` stay in
tokens), dots are trimmed from both ends, and a token is kept if one of the
rules below recognises it.  Kept tokens are lower-cased for the Latin and
Russian alphabets only, except those whose spelling carries meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Compound prefixes, abbreviations, vitamins and elements the rules recognise.
PREFIXES = ("альфа", "бета", "гамма", "дельта", "омега", "орто", "мета", "пара", "цис", "транс", "изо", "нео", "псевдо")
ABBREVIATIONS = ("в/м", "в/в", "п/к", "в/б", "в/кап", "мг", "мл", "г", "кг", "ед", "мкг", "ммоль", "нмоль", "моль", "л", "см", "мм", "таб", "кап", "амп", "фл", "уп", "шт")
VITAMINS = (
    "A", "B", "C", "D", "E", "K", "PP", "H", "P", "U", "F",
    "B1", "B2", "B3", "B4", "B5", "B6", "B7", "B8", "B9", "B10", "B11", "B12", "D2", "D3", "D4", "D5", "K1", "K2", "K3", "K4", "K5",
)

# The letters whose case the tokenizer knows; capital Ё becomes й.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ" + "Ё"
LOWER = "abcdefghijklmnopqrstuvwxyz" + "абвгдежзийклмнопрстуфхцчшщъыьэюя" + "й"
LOWER_FIXED_YO = LOWER[:-1] + "ё"

#: What separates tokens.
SEPARATORS = r"[\t-\r !-$&-*,:-@\[-\x60{-~]+"
_WORD = r"[A-Za-z\x{80}-\x{10FFFF}]"
#: Numeric shapes kept as they are spelt.
VERBATIM = (
    r"^(?:[0-9]*\.[0-9]*-[0-9]*\.[0-9]*|[0-9]*%|[0-9]+-[0-9]+|[0-9]+\.[0-9]+)\z"
    r"|^[0-9]+(?:\.[0-9]+)?°C|^[0-9]+-[0-9]+°C"
)
#: Shapes kept in normal form, besides those.
KEPT = rf"/|^(?:[0-9]+|[A-Za-z])-{_WORD}+\z|^{_WORD}+\z"
PREFIXED = "^(?:" + "|".join(PREFIXES) + ")-"


def lower(c: Column, fix_yo: bool = False) -> Column:
    """Lower case of A-Z, А-Я and Ё (to й, as indexes expect; to ё with ``fix_yo``)."""
    return F.translate(c, UPPER, LOWER_FIXED_YO if fix_yo else LOWER)


def preprocess(text: Column) -> Column:
    """Separators replaced by single spaces."""
    return F.regexp_replace(text, SEPARATORS, " ")


def clean(raw: Column) -> Column:
    """A raw token without dots at its ends."""
    return F.btrim(raw, F.lit("."))


def is_vitamin(t: Column) -> Column:
    return t.isin(*VITAMINS)


#: What most tokens are: kept as they stand, whatever the other rules say.
_PLAIN = r"^[a-z]+\z"


def is_kept(t: Column) -> Column:
    """Does a cleaned token pass one of the rules?"""
    return F.when(t.rlike(_PLAIN), True).otherwise(t.rlike(KEPT) | t.rlike(VERBATIM) | lower(t).rlike(PREFIXED) | is_vitamin(t))


def normalize(t: Column, fix_yo: bool = False) -> Column:
    """Normal form of a kept token; a degree sign before c or C ends it."""
    at = F.locate("°", t)
    degree = (at > 0) & F.substring(t, at + 1, F.lit(1)).isin("c", "C")
    spelt = t.rlike(VERBATIM) | is_vitamin(t)
    return F.when(t.rlike(_PLAIN) | spelt, t).when(degree, F.concat(F.substring(t, F.lit(1), at), F.lit("C"))).otherwise(lower(t, fix_yo))


def tokens(text: Column, fix_yo: bool = False) -> Column:
    """Tokens of a text in order, as an array (empty for null)."""
    raw = F.transform(F.split(F.coalesce(text, F.lit("")), SEPARATORS), clean)
    return F.transform(F.filter(raw, lambda t: (t != "") & is_kept(t)), lambda t: normalize(t, fix_yo))


def _terms_of(pieces: DataFrame, keep: list, fix_yo: bool) -> DataFrame:
    cut = pieces.select(*keep, clean(F.col("raw")).alias("raw")).where((F.col("raw") != "") & is_kept(F.col("raw")))
    return cut.select(*keep, normalize(F.col("raw"), fix_yo).alias("term"))


def distinct_terms(df: DataFrame, text: str = "text", key: str = "doc_id", fix_yo: bool = False) -> DataFrame:
    """(key, term), each pair once; a text's repeated pieces are dropped before any rule looks at them."""
    raw = df.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.split(text, SEPARATORS))).alias("raw"))
    return _terms_of(raw, [key], fix_yo).distinct()


def term_counts(df: DataFrame, text: str = "text", fix_yo: bool = False) -> DataFrame:
    """(term, freq) over all texts; pieces are counted as they are spelt, and the rules look at each spelling once."""
    raw = df.where(F.col(text).isNotNull()).select(F.explode(F.split(text, SEPARATORS)).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return _terms_of(raw, ["n"], fix_yo).groupBy("term").agg(F.sum("n").alias("freq"))


def explode_terms(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), fix_yo: bool = False) -> DataFrame:
    """One row per token, ``term`` beside the kept columns; stays in generated code throughout."""
    raw = df.where(F.col(text).isNotNull()).select(*keep, F.explode(F.split(text, SEPARATORS)).alias("raw"))
    return _terms_of(raw, list(keep), fix_yo)


def explode_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), fix_yo: bool = False) -> DataFrame:
    """One row per token with its place in the token list."""
    return df.select(*keep, F.posexplode(tokens(F.col(text), fix_yo)).alias("pos", "token"))


def is_alnum_token(t: Column) -> Column:
    """All letters, or all digits (superscripts included)."""
    return t.rlike(r"^\p{L}+\z") | t.rlike(r"^[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]+\z")


def token_stats(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokens per text and their lengths in bytes; zeros for texts without tokens."""
    sizes = F.transform(tokens(F.col(text)), lambda t: F.octet_length(t))
    n = F.size("sizes")
    total = F.aggregate("sizes", F.lit(0), lambda a, x: a + x)
    return df.select(key, sizes.alias("sizes")).select(
        key,
        n.cast("long").alias("total_tokens"),
        F.when(n > 0, total / n).otherwise(0.0).alias("avg_token_length_bytes"),
        F.coalesce(F.array_min("sizes"), F.lit(0)).cast("long").alias("shortest_token_bytes"),
        F.coalesce(F.array_max("sizes"), F.lit(0)).cast("long").alias("longest_token_bytes"),
    )
