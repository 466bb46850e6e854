"""Named queries over the standard tables, each with the same result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import pages, register, stemmer, tokenizer, urls
from lexiforge.operators import crawl, index, lexstats, search, store
from lexiforge.plans import goldens
from lexiforge.sources import config, storage, textfiles
from lexiforge.streaming import incremental

NOW, DAYS = 1_700_000_000, 7
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


# -- tokens in SQL -----------------------------------------------------------

_VITAMINS = ", ".join(f"'{v}'" for v in tokenizer.VITAMINS)
_LOW = f"translate(t, '{tokenizer.UPPER}', '{tokenizer.LOWER}')"
_SPELT = f"(regexp_matches(t, '{tokenizer.VERBATIM}') OR t IN ({_VITAMINS}))"
_KEPT = f"({_SPELT} OR regexp_matches(t, '{tokenizer.KEPT}') OR regexp_matches({_LOW}, '{tokenizer.PREFIXED}'))"
_NORMAL = f"CASE WHEN {_SPELT} THEN t WHEN instr(t, '°') > 0 AND substr(t, instr(t, '°') + 1, 1) IN ('c', 'C') THEN left(t, instr(t, '°')) || 'C' ELSE {_LOW} END"


def _terms_sql(table: str = "documents", key: str = "doc_id", where: str = "true", name: str = "terms") -> str:
    cut = f"SELECT {key}, trim(r, '.') AS t FROM (SELECT {key}, unnest(regexp_split_to_array(text, '{tokenizer.SEPARATORS}')) AS r FROM {table} WHERE {where})"
    return f"{name} AS (SELECT {key}, {_NORMAL} AS term FROM ({cut}) WHERE t <> '' AND {_KEPT})"


def _tokens_sql(text: str = "text") -> str:
    raw = f"list_transform(regexp_split_to_array(coalesce({text}, ''), '{tokenizer.SEPARATORS}'), lambda r: trim(r, '.'))"
    return f"list_transform(list_filter({raw}, lambda t: t <> '' AND {_KEPT}), lambda t: {_NORMAL})"


_POSTED = _terms_sql() + ", posted AS (SELECT DISTINCT term, doc_id FROM terms)"
_ALNUM = r"(regexp_matches(term, '^\p{L}+\z') OR regexp_matches(term, '^[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]+\z'))"
_FREQ = _terms_sql(where="trim(coalesce(text, '')) <> ''") + f", freqs AS (SELECT term, count(*) AS freq FROM terms WHERE {_ALNUM} GROUP BY term)"


# -- tokens and index --------------------------------------------------------


@query(f"WITH x AS (SELECT doc_id, {_tokens_sql()} AS toks FROM documents) SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, unnest(toks) AS token FROM x")
def tokenize_documents(spark, sf_dir):
    return tokenizer.explode_tokens(_docs(spark, sf_dir))


@query(
    f"WITH x AS (SELECT doc_id, list_transform({_tokens_sql()}, lambda t: strlen(t)) AS n FROM documents) SELECT doc_id, CAST(len(n) AS BIGINT) AS total_tokens, "
    "round(CASE WHEN len(n) > 0 THEN list_sum(n) / len(n) ELSE 0 END, 6) AS avg_token_length_bytes, CAST(coalesce(list_min(n), 0) AS BIGINT) AS shortest_token_bytes, CAST(coalesce(list_max(n), 0) AS BIGINT) AS longest_token_bytes FROM x"
)
def token_stats_per_doc(spark, sf_dir):
    return tokenizer.token_stats(_docs(spark, sf_dir)).withColumn("avg_token_length_bytes", F.round("avg_token_length_bytes", 6))


@query(f"WITH {_POSTED} SELECT term, doc_id FROM posted")
def inverted_index(spark, sf_dir):
    return index.postings(_docs(spark, sf_dir))


@query(f"WITH {_POSTED} SELECT term, doc_id // 256 AS block, list_aggregate(list_sort(list(doc_id)), 'string_agg', ',') AS doc_ids FROM posted GROUP BY term, doc_id // 256")
def posting_lists(spark, sf_dir):
    return index.posting_lists(index.postings(_docs(spark, sf_dir)), block_docs=256).select("term", "block", F.array_join("doc_ids", ",").alias("doc_ids"))


@query(f"WITH {_POSTED}, {stemmer.sql_chain('(SELECT DISTINCT term AS word FROM posted)')} SELECT DISTINCT stem AS term, doc_id FROM posted JOIN stems ON term = word WHERE stem <> ''")
def inverted_index_stemmed(spark, sf_dir):
    return index.postings(_docs(spark, sf_dir), stem=True)


@query(f"WITH {_POSTED} SELECT term, count(*) AS df FROM posted GROUP BY term")
def term_document_frequency(spark, sf_dir):
    return index.document_frequency(index.postings(_docs(spark, sf_dir)))


def _forward(spark, sf_dir):
    return index.forward(_docs(spark, sf_dir).withColumn("url", F.concat(F.lit("https://corpus.example/"), "source", F.lit("/"), F.col("doc_id").cast("string"))))


_FORWARD = "fwd AS (SELECT doc_id, 'https://corpus.example/' || source || '/' || doc_id AS url FROM documents)"


@query(f"WITH {_FORWARD} SELECT doc_id, url FROM fwd")
def forward_index(spark, sf_dir):
    return _forward(spark, sf_dir)


@query(
    f"WITH {_POSTED}, {_FORWARD}, d AS (SELECT term, count(*) AS df FROM posted GROUP BY term) SELECT (SELECT CAST(4 + sum(12 + strlen(term) + 4 * df) AS BIGINT) FROM d) AS inverted_bytes, "
    "(SELECT count(*) FROM d) AS unique_terms, (SELECT CAST(4 + sum(12 + strlen(url)) AS BIGINT) FROM fwd) AS forward_bytes, (SELECT count(*) FROM fwd) AS documents"
)
def index_size_bytes(spark, sf_dir):
    return index.index_sizes(index.postings(_docs(spark, sf_dir)), _forward(spark, sf_dir))


@query("WITH " + _terms_sql(where="doc_id < 100") + " SELECT DISTINCT term, doc_id FROM terms")
def index_max_docs(spark, sf_dir):
    return index.postings(_docs(spark, sf_dir), max_docs=100)


@query(f"WITH {_POSTED} SELECT term, doc_id FROM posted WHERE term NOT IN ('the', 'of', 'and', 'der', 'die', 'la', 'le', 'de')")
def stopword_filter(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in "The of and der die la le de".split()], "word string")
    return index.postings(_docs(spark, sf_dir), stop_words=words)


# -- stored index ------------------------------------------------------------

_BUILT: dict[tuple[str, str], str] = {}


def build_index(spark: SparkSession, sf_dir: str) -> str:
    """Build the index of the documents and store it; searches then read it.  Gives its path."""
    path = f"{storage.shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.write_index(index.postings(_docs(spark, sf_dir)), _forward(spark, sf_dir), path)
    _BUILT[spark.sparkContext.applicationId, sf_dir] = path
    return path


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored index, built by the first search of a session."""
    return index.load_index(spark, _BUILT.get((spark.sparkContext.applicationId, sf_dir)) or build_index(spark, sf_dir))


def _posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[0]


@query(f"WITH {_POSTED} SELECT term, doc_id FROM posted")
def stored_inverted_index(spark, sf_dir):
    return _posted(spark, sf_dir)


@query(f"WITH {_FORWARD} SELECT doc_id, url FROM fwd")
def stored_forward_index(spark, sf_dir):
    return _index(spark, sf_dir)[1]


# -- search ------------------------------------------------------------------


def _search(text: str, **options):
    return lambda spark, sf_dir: search.search(_posted(spark, sf_dir), text, **options)


def _has(term: str) -> str:
    return f"SELECT doc_id FROM posted WHERE term = '{term}'"


for _name, _text, _sql in (
    ("search_single", "tion", _has("tion")),
    ("search_and", "the AND of", f"{_has('the')} INTERSECT {_has('of')}"),
    ("search_or", "der or la", f"{_has('der')} UNION {_has('la')}"),
    ("search_not", "the NOT was", f"{_has('the')} EXCEPT {_has('was')}"),
    ("search_missing_term", "qqqq OR the", f"{_has('qqqq')} UNION {_has('the')}"),
    ("search_unknown_op_empty", "the XOR of", "SELECT doc_id FROM posted WHERE false"),
    ("search_unsupported_arity_empty", "the of and was", "SELECT doc_id FROM posted WHERE false"),
):
    QUERIES[_name] = _search(_text)
    SQL[_name] = f"WITH {_POSTED} {_sql}"


@query(f"WITH {_POSTED}, {_FORWARD}, hit AS ({_has('the')} INTERSECT {_has('of')}) SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, coalesce(url, '') AS url FROM hit LEFT JOIN fwd USING (doc_id)")
def search_with_url(spark, sf_dir):
    posted, forward = _index(spark, sf_dir)
    return search.with_urls(search.search(posted, "the AND of"), forward)


_BATCH = ((1, "the"), (2, "the AND of"), (3, "der OR la"), (4, "the NOT was"), (5, "a b c d"), (6, "the XOR of"), (7, "!!!"))


@query(
    f"WITH {_POSTED} SELECT 1 AS query_id, doc_id FROM ({_has('the')}) UNION ALL SELECT 2, doc_id FROM ({_has('the')} INTERSECT {_has('of')}) "
    f"UNION ALL SELECT 3, doc_id FROM ({_has('der')} UNION {_has('la')}) UNION ALL SELECT 4, doc_id FROM ({_has('the')} EXCEPT {_has('was')})"
)
def batch_search(spark, sf_dir):
    return search.batch_search(_posted(spark, sf_dir), spark.createDataFrame(_BATCH, "query_id int, query string"))


# -- vocabulary --------------------------------------------------------------


def _freqs(spark, sf_dir):
    return lexstats.term_frequency(_docs(spark, sf_dir))


@query(f"WITH {_FREQ} SELECT term, freq FROM freqs")
def term_frequency(spark, sf_dir):
    return _freqs(spark, sf_dir)


@query(f"WITH {_FREQ}, {stemmer.sql_chain('(SELECT term AS word FROM freqs)')} SELECT stem AS term, CAST(sum(freq) AS BIGINT) AS freq FROM freqs JOIN stems ON term = word GROUP BY stem")
def term_frequency_stemmed(spark, sf_dir):
    return lexstats.term_frequency(_docs(spark, sf_dir), stem=True)


_RANKED = _FREQ + ", ranked AS (SELECT row_number() OVER (ORDER BY freq DESC, term) AS rank, term, freq, max(freq) OVER () AS top FROM freqs)"


@query(f"WITH {_RANKED} SELECT rank, term, freq FROM ranked")
def zipf_rank(spark, sf_dir):
    return lexstats.zipf_ranks(_freqs(spark, sf_dir)).select("rank", "term", "freq")


@query(f"WITH {_RANKED} SELECT rank, top / rank AS theoretical FROM ranked")
def zipf_theoretical(spark, sf_dir):
    return lexstats.zipf_ranks(_freqs(spark, sf_dir)).select("rank", "theoretical")


@query(f"WITH {_RANKED} SELECT count(*) AS n, CAST(sum(freq) AS BIGINT) AS total, round(1 - var_pop(ln(freq) + ln(rank)) / var_pop(ln(freq)), 6) AS r_squared FROM ranked")
def zipf_r_squared(spark, sf_dir):
    return lexstats.zipf_r_squared(lexstats.zipf_ranks(_freqs(spark, sf_dir))).withColumn("r_squared", F.round("r_squared", 6))


@query(
    f"WITH {_FREQ} SELECT CAST(sum(freq) AS BIGINT) AS total_tokens, count(*) AS unique_tokens, max(length(term)) AS longest_chars, min(length(term)) AS shortest_chars, round(sum(length(term) * freq) / sum(freq), 6) AS avg_chars FROM freqs"
)
def lexical_length_stats(spark, sf_dir):
    return lexstats.length_stats(_freqs(spark, sf_dir)).withColumn("avg_chars", F.round("avg_chars", 6))


@query(f"WITH {_FREQ} SELECT term, freq FROM freqs ORDER BY freq DESC, term LIMIT 5")
def top_terms(spark, sf_dir):
    return lexstats.top_terms(_freqs(spark, sf_dir))


RUSSIAN = (
    "бегающий бегающая бегать бегали дом дома домами красивый красивейший убежав сделанный кардиомиопатия гипертензии головокружение ВИЧ-инфекция computer "
    "ибупрофен ацетилсалициловая ёлка ёлочка пёстрый сердцёбиение я он ВИЧ HIV аппендэктомия рентгенография антикоагулянты обследование проведенное вчера болезни лежащая лежащий говоривший состав мотив"
).split()
_WORDS = "(VALUES " + ", ".join(f"('{w}')" for w in RUSSIAN) + ") AS given(word)"


def _words(spark):
    return spark.createDataFrame([(w,) for w in RUSSIAN], "word string")


@query("SELECT word, stem FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in goldens.stems()) + ") AS known(word, stem)")
def stem_goldens(spark, sf_dir):
    return stemmer.stem_terms(spark.createDataFrame([(w,) for w, _ in goldens.stems()], "word string"))


@query(f"WITH {stemmer.sql_chain(_WORDS)} SELECT count(*) AS n, count(*) FILTER (word <> stem) AS changed, round(100.0 * count(*) FILTER (word <> stem) / count(*), 6) AS percentage_changed FROM stems")
def stem_change_pct(spark, sf_dir):
    return lexstats.stem_change(_words(spark)).withColumn("percentage_changed", F.round("percentage_changed", 6))


@query(
    f"WITH {stemmer.sql_chain(_WORDS)}, g AS (SELECT stem, list_sort(list(DISTINCT word)) AS o FROM stems GROUP BY stem) "
    "SELECT stem, CAST(len(o) AS INTEGER) AS size, array_to_string(o[1:5], ' ') AS originals FROM g ORDER BY len(o) < 2, len(o) DESC, stem LIMIT 5"
)
def stem_groups_top5(spark, sf_dir):
    return lexstats.stem_groups(_words(spark))


_VOCABULARY = f"{_FREQ}, {stemmer.sql_chain('(SELECT term AS word FROM freqs)')}"


def _vocabulary(spark, sf_dir):
    return _freqs(spark, sf_dir).select(F.col("term").alias("word"))


@query(f"WITH {_VOCABULARY} SELECT count(*) AS n, count(*) FILTER (word <> stem) AS changed, round(CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (word <> stem) / count(*) ELSE 0 END, 6) AS percentage_changed FROM stems")
def stem_change_documents(spark, sf_dir):
    return lexstats.stem_change(_vocabulary(spark, sf_dir)).withColumn("percentage_changed", F.round("percentage_changed", 6))


@query(
    f"WITH {_VOCABULARY}, g AS (SELECT stem, list_sort(list(DISTINCT word)) AS o FROM stems GROUP BY stem) "
    "SELECT stem, CAST(len(o) AS INTEGER) AS size, array_to_string(o[1:5], ' ') AS originals FROM g ORDER BY len(o) < 2, len(o) DESC, stem LIMIT 5"
)
def stem_groups_documents(spark, sf_dir):
    return lexstats.stem_groups(_vocabulary(spark, sf_dir))


@query("SELECT id, tokens FROM (VALUES " + ", ".join(f"({i}, '{want}')" for i, (_, want) in enumerate(goldens.TOKENS)) + ") AS known(id, tokens)")
def tokenizer_goldens(spark, sf_dir):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(goldens.TOKENS)], "id int, text string")
    return rows.select("id", F.array_join(tokenizer.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({_tokens_sql()}, ' ') AS tokens FROM documents")
def sql_tokenize(spark, sf_dir):
    register.register(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("lexiforge_documents")
    return spark.sql("SELECT doc_id, array_join(tokenize(text), ' ') AS tokens FROM lexiforge_documents")


@query("SELECT word, stem FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in goldens.stems()) + ") AS known(word, stem)")
def sql_stem(spark, sf_dir):
    register.register(spark)
    spark.createDataFrame([(w,) for w, _ in goldens.stems()], "word string").createOrReplaceTempView("lexiforge_words")
    return spark.sql("SELECT word, stem(word) AS stem FROM lexiforge_words")


# -- store -------------------------------------------------------------------


def _store(spark, sf_dir):
    i = F.col("doc_id")
    return _docs(spark, sf_dir).select(
        F.concat(F.lit("https://corpus.example/"), i.cast("string")).alias("url"), F.col("source").alias("source_name"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("raw_html"), F.col("text").alias("clean_text"),
        F.sha2("text", 256).alias("content_hash"), F.when(i % 5 != 0, F.lit(NOW) - (i % 14) * 86400).alias("crawled_at"), (i * 60).alias("created_at"), "doc_id",
    )


_STORE = (
    f"store AS (SELECT 'https://corpus.example/' || doc_id AS url, source AS source_name, '<p>' || text || '</p>' AS raw_html, text AS clean_text, sha256(text) AS content_hash, "
    f"CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {NOW} - (doc_id % 14) * 86400 END AS crawled_at, doc_id * 60 AS created_at, doc_id FROM documents)"
)
_STALE = f"crawled_at <= {NOW - DAYS * 86400}"


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", store.content_hash("text").alias("content_hash"))


@query(
    f"WITH {_STORE}, old AS (SELECT * FROM store WHERE doc_id % 11 <> 0), new AS (SELECT url, CASE WHEN doc_id % 7 = 0 THEN sha256(clean_text || '!') ELSE content_hash END AS h FROM store) "
    f"SELECT new.url, CASE WHEN old.url IS NULL THEN 'created' WHEN h <> content_hash THEN 'updated' WHEN {_STALE} THEN 'rechecked_no_changes' ELSE 'no_changes_recently_checked' END AS status, "
    f"(old.url IS NULL OR h <> content_hash OR coalesce({_STALE}, false)) AS applied FROM new LEFT JOIN old USING (url)"
)
def upsert_status(spark, sf_dir):
    rows = _store(spark, sf_dir)
    new = rows.select("url", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("clean_text", F.lit("!")), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return store.change_status(rows.where("doc_id % 11 <> 0"), new, NOW, DAYS)


@query(
    f"WITH {_STORE}, old AS (SELECT * FROM store WHERE doc_id % 11 <> 0), new AS (SELECT url, raw_html || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END AS html FROM store WHERE doc_id % 3 = 0) "
    "SELECT coalesce(new.url, old.url) AS url, CASE WHEN new.url IS NOT NULL THEN sha256(html) ELSE content_hash END AS content_hash, "
    f"CASE WHEN new.url IS NOT NULL THEN {NOW} ELSE coalesce(crawled_at, 0) END AS crawled_at, coalesce(created_at, {NOW}) AS created_at FROM new FULL JOIN old ON new.url = old.url"
)
def upsert_merge(spark, sf_dir):
    rows = _store(spark, sf_dir)
    batch = rows.where("doc_id % 3 = 0").select("url", F.concat("raw_html", F.when(F.col("doc_id") % 7 == 0, "!").otherwise("")).alias("raw_html"), "clean_text", "source_name")
    return store.merge(rows.where("doc_id % 11 <> 0"), batch, NOW, DAYS).select("url", "content_hash", F.coalesce("crawled_at", F.lit(0)).alias("crawled_at"), "created_at")


@query(f"WITH {_STORE} SELECT url, CASE WHEN crawled_at IS NULL THEN 1 ELSE 2 END AS priority, created_at FROM store WHERE source_name = 'src3' AND (crawled_at IS NULL OR {_STALE}) ORDER BY 2, 3, 1 LIMIT 1")
def crawl_frontier_next(spark, sf_dir):
    return store.frontier(_store(spark, sf_dir), NOW, DAYS, "src3")


@query(f"WITH {_STORE} SELECT url FROM store EXCEPT SELECT url FROM store WHERE doc_id % 3 = 0")
def urls_to_add(spark, sf_dir):
    rows = _store(spark, sf_dir)
    return store.urls_to_add(rows.where("doc_id % 3 = 0"), rows)


@query(
    f"WITH {_STORE} SELECT count(*) AS total_documents, count(*) FILTER (crawled_at IS NULL) AS never_crawled, count(crawled_at) AS crawled, count(*) FILTER ({_STALE}) AS need_recheck, "
    "CAST(sum(length(raw_html)) AS BIGINT) AS total_raw_size, CAST(sum(length(clean_text)) AS BIGINT) AS total_clean_size, round(avg(length(raw_html)), 6) AS avg_raw_size, round(avg(length(clean_text)), 6) AS avg_clean_size, count(raw_html) AS docs_with_html, count(clean_text) AS docs_with_text FROM store"
)
def crawl_stats_global(spark, sf_dir):
    return store.global_stats(_store(spark, sf_dir), NOW, DAYS).withColumns({c: F.round(c, 6) for c in ("avg_raw_size", "avg_clean_size")})


@query(
    f"WITH {_STORE} SELECT source_name, count(*) AS total, count(crawled_at) AS crawled, count(*) FILTER ({_STALE}) AS need_recheck, CAST(sum(length(raw_html)) AS BIGINT) AS raw_size, CAST(sum(length(clean_text)) AS BIGINT) AS clean_size, "
    "round(sum(length(raw_html)) / count(*), 6) AS avg_raw_size, round(sum(length(clean_text)) / count(*), 6) AS avg_clean_size FROM store WHERE source_name <> '' GROUP BY source_name"
)
def crawl_stats_by_source(spark, sf_dir):
    return store.source_stats(_store(spark, sf_dir), NOW, DAYS).withColumns({c: F.round(c, 6) for c in ("avg_raw_size", "avg_clean_size")})


@query(f"WITH {_STORE}, c AS (SELECT source_name, count(crawled_at) AS crawled FROM store GROUP BY source_name) SELECT source_name, crawled, 40 - crawled AS pages_left FROM c WHERE crawled < 40")
def source_quota(spark, sf_dir):
    rows = _store(spark, sf_dir)
    return store.within_quota(rows, rows.select("source_name", F.lit(40).cast("long").alias("max_pages")).distinct())


@query(
    "WITH s AS (SELECT CAST(doc_id AS BIGINT) * doc_id * doc_id * 37 AS bytes, doc_id FROM documents) SELECT doc_id, bytes, CASE WHEN coalesce(bytes, 0) = 0 THEN '0 B' WHEN bytes < 1024 THEN printf('%.2f B', CAST(bytes AS DOUBLE)) "
    "WHEN bytes < 1048576 THEN printf('%.2f KB', bytes / 1024.0::DOUBLE) WHEN bytes < 1073741824 THEN printf('%.2f MB', bytes / 1048576.0::DOUBLE) ELSE printf('%.2f GB', bytes / 1073741824.0::DOUBLE) END AS size FROM s"
)
def readable_sizes(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", (F.col("doc_id") * F.col("doc_id") * F.col("doc_id") * 37).alias("bytes"))
    return rows.withColumn("size", store.format_size("bytes"))


@query(f"SELECT doc_id, trim(regexp_replace(text, '{textfiles.WHITE_SPACE}', ' ', 'g'), ' ') AS line FROM documents WHERE text IS NOT NULL")
def export_clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", textfiles.one_line(F.col("text")).alias("line"))


# -- URLs and links ----------------------------------------------------------

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


@query(
    f"WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '{_URL}', 1)) AS s, lower(regexp_extract(url, '{_URL}', 2)) AS h, regexp_replace(regexp_extract(url, '{_URL}', 3), '/{{2,}}', '/', 'g') AS path, regexp_extract(url, '{_URL}', 4) AS q FROM pages) "
    r"SELECT page_id, CASE WHEN s = '' THEN url ELSE s || '://' || CASE s WHEN 'http' THEN regexp_replace(h, ':80\z', '') WHEN 'https' THEN regexp_replace(h, ':443\z', '') ELSE h END || "
    r"CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+\z', '') END || CASE WHEN q = '?' THEN '' ELSE q END END AS url_key FROM p"
)
def normalize_url_store(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.store_key(F.col("url")).alias("url_key"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '(?s)#.*', ''), '/+\z', '') AS url_key FROM pages")
def normalize_url_parser(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.page_key(F.col("url")).alias("url_key"))


_HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']"""


@query(
    f"WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS h FROM pages), a AS (SELECT page_id, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN h WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, '/') THEN 'https://site.example' || h "
    r"WHEN starts_with(h, '?') THEN 'https://site.example' || h ELSE 'https://site.example/' || h END AS u FROM l WHERE h <> '' AND NOT regexp_matches(h, '^(?:#|javascript:|mailto:)')) "
    r"SELECT DISTINCT page_id, regexp_replace(regexp_replace(u, '(?s)#.*', ''), '/+\z', '') AS link FROM a"
)
def extract_links(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(urls.page_links(F.col("html"), "https://site.example")).alias("link"))


_NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
SITEMAPS = (
    (1, f"<sitemapindex {_NS}><sitemap><loc>https://e.ru/s1.xml</loc></sitemap><sitemap><loc>/s2.xml#x</loc></sitemap></sitemapindex>"),
    (2, f"<urlset {_NS}><url><loc>https://e.ru/a/</loc></url><url><loc>https://e.ru/b?x=1</loc></url></urlset>"),
    (3, "<urlset><url><loc>https://e.ru/a/</loc></url></urlset>"),
    (4, "<urlset"),
)


@query("SELECT * FROM (VALUES (1, 'https://e.ru/s1.xml'), (1, 'https://e.ru/s2.xml'), (2, 'https://e.ru/a'), (2, 'https://e.ru/b?x=1')) AS found(id, link)")
def sitemap_urls(spark, sf_dir):
    rows = spark.createDataFrame(list(SITEMAPS), "id int, xml string").withColumn("url", F.lit("https://e.ru/sitemap.xml"))
    return rows.select("id", F.explode(pages.extract(F.col("xml"), F.col("url"), "rlsnet", "https://e.ru").getField("extracted_urls")).alias("link"))


@query("SELECT layout, clean_text, links FROM (VALUES " + ", ".join(f"('{x[0]}', '{x[2]}', '{x[3]}')" for x in goldens.PAGES) + ") AS known(layout, clean_text, links)")
def page_goldens(spark, sf_dir):
    """Both page layouts, through the registered SQL function."""
    register.register(spark)
    spark.createDataFrame([x[:2] for x in goldens.PAGES], "layout string, html string").createOrReplaceTempView("lexiforge_pages")
    rows = spark.sql("SELECT layout, extract_page(html, 'https://e.ru/p', layout, 'https://e.ru') AS p FROM lexiforge_pages")
    return rows.select("layout", F.col("p.clean_text").alias("clean_text"), F.array_join("p.extracted_urls", " ").alias("links"))


def _extracted(spark, sf_dir, parser):
    rows = _table(spark, sf_dir, "pages").select("page_id", pages.extract(F.col("html"), F.col("url"), parser, "https://site.example").alias("p"))
    return rows.select("page_id", F.col("p.clean_text").alias("clean_text"), F.array_join("p.extracted_urls", " ").alias("links"))


@query()
def page_clean_text(spark, sf_dir):
    """Text and links of whole pages; a tree is beyond SQL."""
    return _extracted(spark, sf_dir, "isgeotar")


@query()
def page_article(spark, sf_dir):
    """The same by the article parser."""
    return _extracted(spark, sf_dir, "rlsnet")


@query("SELECT page_id, clean_text IS NOT NULL AND len(string_split(trim(clean_text, ' ' || chr(9) || chr(10) || chr(12) || chr(13)), chr(10))) > 1 AS has_article FROM (SELECT page_id, html AS clean_text FROM pages)")
def article_filter(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", pages.has_article(F.col("html")).alias("has_article"))


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query(
    f"WITH l AS (SELECT doc_id, list_transform({_LINES}, lambda x: [x]) AS lines FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN len(lines) = 0 THEN 0 ELSE "
    "len(list_reduce(lines, lambda acc, x: CASE WHEN len(list_filter(acc, lambda s: contains(s, x[1]) OR contains(x[1], s))) > 0 THEN acc ELSE list_concat(acc, x) END)) END AS n_lines FROM l"
)
def distinct_lines(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(pages.uncontained_lines(F.col("text"))).cast("long").alias("n_lines"))


# -- crawl scans -------------------------------------------------------------


@query("SELECT s AS source_name, CAST(i AS INTEGER) AS page, 'https://' || s || '.example/drugs?page=' || i || '&pageSize=200' AS url FROM (VALUES ('a'), ('b')) AS x(s), generate_series(1, 154) AS g(i)")
def listing_addresses(spark, sf_dir):
    return crawl.listing_addresses(spark.createDataFrame([("a", "https://a.example"), ("b", "https://b.example")], "source_name string, base_url string"))


def _listings(spark, sf_dir):
    """Pages as fetched listings: page i is listing i, its links moved under /drugs/."""
    rows = _table(spark, sf_dir, "pages")
    return rows.select(F.format_string("https://site.example/drugs?page=%d&pageSize=200", "page_id").alias("url"), F.regexp_replace("html", "(?i)href=([\"'])/", "href=$1/drugs/").alias("html"))


def _scanned(spark, sf_dir):
    addresses = crawl.listing_addresses(spark.createDataFrame([("s", "https://site.example")], "source_name string, base_url string"))
    return crawl.scan_listing(addresses, _listings(spark, sf_dir), "https://site.example")


_DRUG_HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']"""
_SCANNED = (
    f"l AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?i)href=([\"''])/', 'href=\\1/drugs/', 'g'), '{_DRUG_HREF}', 1) AS hs FROM pages WHERE page_id BETWEEN 1 AND 154), "
    "o AS (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM l), w AS (SELECT * FROM o WHERE contains(h, '/drugs/') AND h NOT IN ('/drugs', '/drugs/', '/drugs?') AND length(h) - length(replace(h, '/', '')) >= 2), "
    "k AS (SELECT page_id, i, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN h WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, '/') OR starts_with(h, '?') THEN 'https://site.example' || h ELSE 'https://site.example/' || h END AS u FROM w), "
    "n AS (SELECT page_id, i, regexp_replace(regexp_replace(u, '(?s)#.*', ''), '/+\\z', '') AS url FROM k), f AS (SELECT page_id, url, min(i) AS i FROM n WHERE contains(url, '/drugs/') AND url <> 'https://site.example/drugs' GROUP BY page_id, url), "
    "p AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place FROM f), scanned AS (SELECT 's' AS source_name, CAST(min(page_id) AS INTEGER) AS page, CAST(arg_min(place, page_id) AS INTEGER) AS place, url FROM p GROUP BY url)"
)


@query(f"WITH {_SCANNED} SELECT source_name, page, place, url FROM scanned")
def listing_scan(spark, sf_dir):
    return _scanned(spark, sf_dir)


@query(f"WITH {_SCANNED}, c AS (SELECT page, place FROM scanned WHERE page = (SELECT min(page) FROM scanned) ORDER BY place LIMIT 1) SELECT s.source_name, s.page, s.place, s.url FROM scanned s, c WHERE (s.page, s.place) > (c.page, c.place)")
def listing_resume(spark, sf_dir):
    """The scan behind a checkpoint at its first link."""
    items = _scanned(spark, sf_dir)
    state = items.orderBy("page", "place").limit(1).select("source_name", F.col("url").alias("current_url"), F.col("page").alias("current_page"))
    return crawl.after_checkpoint(items, state)


@query(r"SELECT DISTINCT regexp_replace(regexp_replace(url, '(?s)#.*', ''), '/+\z', '') AS url FROM pages")
def sitemap_scan(spark, sf_dir):
    """An index of sitemaps of a hundred pages each, read in two levels."""
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    listed = lambda c, tag: F.concat(F.lit(f"<{tag}><loc>"), c, F.lit(f"</loc></{tag}>"))
    inside = lambda c, tag: F.concat(F.lit(f"<{tag} {_NS}>"), F.array_join(F.collect_list(c), ""), F.lit(f"</{tag}>"))
    child = F.format_string("https://site.example/sitemap-%d.xml", F.floor(F.col("page_id") / 100))
    children = _table(spark, sf_dir, "pages").groupBy(child.alias("url")).agg(inside(listed(escaped, "url"), "urlset").alias("html"))
    top = children.agg(F.lit("https://site.example/sitemap.xml").alias("url"), inside(listed(F.col("url"), "sitemap"), "sitemapindex").alias("html"))
    return crawl.scan_sitemaps(children.unionByName(top), "https://site.example/sitemap.xml", "https://site.example")


@query(f"WITH {_STORE} SELECT url FROM store WHERE crawled_at IS NULL OR crawled_at <= {NOW - DAYS * 86400}")
def addresses_to_fetch(spark, sf_dir):
    rows = _store(spark, sf_dir)
    return crawl.to_fetch(rows, rows, NOW, DAYS)


@query("SELECT source AS source_name, CAST(count(*) AS BIGINT) AS processed_count FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY source UNION ALL SELECT 'src2', CAST(7 AS BIGINT)")
def crawler_state(spark, sf_dir):
    """Checkpoints: one put in anew, one cleared, each read by its source."""
    states = _docs(spark, sf_dir).where("source is not null").groupBy(F.col("source").alias("source_name")).agg(F.count(F.lit(1)).alias("processed_count"))
    changed = store.clear_state(store.save_state(states, spark.createDataFrame([("src2", 7)], "source_name string, processed_count long")), "src1")
    return changed.where("source_name <> 'src2'").unionByName(store.load_state(changed, "src2"))


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_seen(spark, sf_dir):
    return store.first_seen(_docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id")


_CONFIG = """
logic:
  recheck_interval_days: 7
  user_agent: "Bot/1.0"  # a name
sources:
  first:
    name: "one"
    base_url: "https://one.example"
    start_url: "https://one.example/drugs?page=1"
    parser: "isgeotar"
    max_pages: 30000
  second:
    base_url: 'https://two.example'
    parser: rlsnet
"""


@query("SELECT * FROM (VALUES ('one', 'https://one.example', 'https://one.example/drugs?page=1', 'isgeotar', CAST(30000 AS BIGINT)), ('second', 'https://two.example', NULL, 'rlsnet', NULL)) AS s(source_name, base_url, start_url, parser, max_pages)")
def configured_sources(spark, sf_dir):
    return config.sources(spark, config.parse(_CONFIG))


# -- files and streams -------------------------------------------------------


@query(
    f"WITH {_STORE}, kept AS (SELECT url, trim(regexp_replace(clean_text, '{textfiles.WHITE_SPACE}', ' ', 'g'), ' ') AS text FROM store WHERE clean_text <> '') SELECT row_number() OVER (ORDER BY url) - 1 AS doc_id, url, text FROM kept"
)
def positional_files(spark, sf_dir):
    """Export to two files of lines, then load them by position."""
    path = f"{storage.shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    textfiles.export(_store(spark, sf_dir), path)
    return textfiles.load(spark, f"{path}/text", f"{path}/url").select("doc_id", "url", "text")


@query("SELECT word FROM (VALUES ('the'), ('и'), ('ёж')) AS w(word)")
def stop_word_file(spark, sf_dir):
    path = f"{storage.shared_dir(spark)}/words-{uuid.uuid4().hex}"
    spark.createDataFrame([("the",), (" И \t",), ("",), ("the\r",), ("ёж",)], "value string").write.text(path)
    return textfiles.stop_words(spark, path)


@query(f"WITH {_POSTED} SELECT term, doc_id FROM posted")
def stream_index(spark, sf_dir):
    """The index as a stream of files of documents; the table may be one file or a folder of files."""
    path = f"{storage.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = f"{sf_dir}/documents.parque[t]"  # a pattern: a stream takes no plain path of a single file
    incremental.index_stream(spark, table, "doc_id long, text string", f"{path}/index", f"{path}/checkpoint", files="*", nested=True).awaitTermination()
    return incremental.read_postings(spark, f"{path}/index")


@query(f"SELECT 'https://corpus.example/' || doc_id AS url, sha256('<p>' || text || '</p>') AS content_hash, CAST({NOW} AS BIGINT) AS crawled_at FROM documents")
def stream_merge(spark, sf_dir):
    """Pages merged into the store as they arrive, batch by batch."""
    path = f"{storage.shared_dir(spark)}/store-{uuid.uuid4().hex}"
    _store(spark, sf_dir).select("url", "raw_html", "clean_text", "source_name").write.parquet(f"{path}/in")
    incremental.merge_stream(spark, f"{path}/in", f"{path}/store", f"{path}/checkpoint", NOW, DAYS).awaitTermination()
    return incremental.read_store(spark, f"{path}/store").select("url", "content_hash", "crawled_at")


@query("SELECT * FROM (VALUES ('/drugs/a'), ('/drugs/b')) AS found(path)")
def listing_links(spark, sf_dir):
    html = '<a href="/drugs/a/">A</a><a class="x" href="/drugs/b#t">B</a><a href="/drugs/">all</a><a href="/about">x</a><a href="/drugs/a">again</a>'
    rows = spark.createDataFrame([(html,)], "html string")
    return rows.select(F.explode(urls.listing_links(F.col("html"), "https://e.ru")).alias("u")).select(F.replace("u", F.lit("https://e.ru"), F.lit("")).alias("path"))


@query(
    f"WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS h FROM pages), w AS (SELECT * FROM l WHERE contains(h, '/drugs/') AND h NOT IN ('/drugs', '/drugs/', '/drugs?') AND length(h) - length(replace(h, '/', '')) >= 2), "
    r"a AS (SELECT page_id, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN h WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, '/') OR starts_with(h, '?') OR starts_with(h, '#') THEN 'https://site.example' || h ELSE 'https://site.example/' || h END AS u FROM w), "
    r"k AS (SELECT DISTINCT page_id, regexp_replace(regexp_replace(u, '(?s)#.*', ''), '/+\z', '') AS link FROM a) SELECT page_id, link FROM k WHERE contains(link, '/drugs/') AND link <> 'https://site.example/drugs'"
)
def listing_links_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(urls.listing_links(F.col("html"), "https://site.example")).alias("link"))
