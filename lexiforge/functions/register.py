"""SQL names for the functions: tokenize, stem, normalize_url, extract_page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import pages, stemmer, tokenizer


def tokenize_sql(text: str = "text") -> str:
    """The tokenizer as an expression of Spark SQL."""
    quote = lambda s: "r'" + s + "'"
    low = f"translate(t, '{tokenizer.UPPER}', '{tokenizer.LOWER}')"
    vitamins = ", ".join(f"'{v}'" for v in tokenizer.VITAMINS)
    spelt = f"(t rlike {quote(tokenizer.VERBATIM)} or t in ({vitamins}))"
    kept = f"({spelt} or t rlike {quote(tokenizer.KEPT)} or {low} rlike {quote(tokenizer.PREFIXED)})"
    degree = "locate('°', t) > 0 and substring(t, locate('°', t) + 1, 1) in ('c', 'C')"
    normal = f"case when {spelt} then t when {degree} then concat(substring(t, 1, locate('°', t)), 'C') else {low} end"
    cut = f"transform(split(coalesce({text}, ''), {quote(tokenizer.SEPARATORS)}), r -> trim(both '.' from r))"
    return f"transform(filter({cut}, t -> t <> '' and {kept}), t -> {normal})"


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL in this session."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tokenize(text STRING) RETURNS ARRAY<STRING> RETURN {tokenize_sql()}")
    part = lambda i: rf"regexp_extract(url, r'(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', {i})"
    host = rf"case lower({part(1)}) when 'http' then regexp_replace(lower({part(2)}), r':80\z', '') when 'https' then regexp_replace(lower({part(2)}), r':443\z', '') else lower({part(2)}) end"
    single = f"regexp_replace({part(3)}, '/{{2,}}', '/')"
    short = rf"case when {single} in ('', '/') then '/' else regexp_replace({single}, r'/+\z', '') end"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_url(url STRING) RETURNS STRING RETURN case when {part(1)} = '' then url else concat(lower({part(1)}), '://', {host}, {short}, case when {part(4)} = '?' then '' else {part(4)} end) end")

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        known = {w: stemmer.stem_word(w) for w in words.dropna().unique()}
        return words.map(known).astype(object).where(words.notna(), None)

    @F.pandas_udf("clean_text string, extracted_urls array<string>")
    def extract_page(html: pd.Series, url: pd.Series, parser: pd.Series, base: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pages.PARSERS[p](h or "", u or "", b) for h, u, p, b in zip(html, url, parser, base, strict=True)], columns=["clean_text", "extracted_urls"])

    spark.udf.register("stem", stem)
    spark.udf.register("extract_page", extract_page)
