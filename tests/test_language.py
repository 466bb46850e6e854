import math
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiforge.functions import pages, stemmer, tokenizer, urls
from lexiforge.operators import crawl, index, lexstats, search, store
from lexiforge.plans import goldens
from lexiforge.sources import config, storage, textfiles

TOKENS = [*goldens.TOKENS, (None, "")]
CORPUS = [(0, "глюкоза 5.5 раствор"), (1, "глюкоза в/в"), (2, "антибиотик пенициллин"), (3, "антибиотик в/м"), (4, "раствор раствор")]
SEARCHES = [
    ("глюкоза", [0, 1]), ("глюкоза AND 5.5", [0]), ("в/в OR в/м", [1, 3]), ("антибиотик NOT пенициллин", [3]), ("раствор and глюкоза", [0]), ("раствор", [0, 4]),
    ("нет OR глюкоза", [0, 1]), ("глюкоза AND 100", []), ("глюкоза XOR раствор", []), ("NOT глюкоза", []), ("!!!", []),
]


def test_tokens(spark):
    df = spark.createDataFrame(TOKENS, "text string, want string").select("want", F.array_join(tokenizer.tokens(F.col("text")), " ").alias("got"))
    assert [(r.want, r.got) for r in df.collect() if r.want != r.got] == []


def test_exploded_terms_equal_arrays(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "doc_id int, text string")
    assert sorted(r.term for r in tokenizer.explode_terms(df).collect()) == sorted(t for _, w in TOKENS for t in w.split())


def test_stems(spark):
    want = dict(goldens.stems())
    assert {w: stemmer.stem_word(w) for w in want} == want
    got = stemmer.stem_terms(spark.createDataFrame([(w,) for w in want], "word string"))
    assert {r.word: r.stem for r in got.collect()} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE given(word VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?)", [[w] for w in want])
    assert dict(con.execute(f"WITH {stemmer.sql_chain('given')} SELECT word, stem FROM stems").fetchall()) == want


def test_search(spark):
    posted = index.postings(spark.createDataFrame(CORPUS, "doc_id long, text string")).cache()
    for text, want in SEARCHES:
        assert [r.doc_id for r in search.search(posted, text).collect()] == want, text
    queries = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(SEARCHES)], "query_id int, query string")
    got = sorted((r.query_id, r.doc_id) for r in search.batch_search(posted, queries).collect())
    assert got == [(i, d) for i, (_, docs) in enumerate(SEARCHES) for d in docs]
    with pytest.raises(search.UnsupportedQuery):
        search.search(posted, "a b c", strict=True)


def test_zipf(spark):
    def fit(points):
        return lexstats.zipf_r_squared(spark.createDataFrame(points, "rank long, freq long")).first().r_squared

    assert abs(fit([(1, 8), (2, 4), (4, 2)]) - 1) < 1e-9
    assert fit([(1, 5), (2, 5)]) == 0
    assert fit([(1, 5)]) != fit([(1, 5)])


def test_change_status(spark):
    now = 1_700_000_000
    old = spark.createDataFrame([("b", "h1", now - 86400), ("c", "h1", now - 8 * 86400), ("d", "h1", now - 7 * 86400), ("e", "h1", now - 86400)], "url string, content_hash string, crawled_at long")
    new = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h1"), ("d", "h1"), ("e", "h1")], "url string, content_hash string")
    got = {r.url: (r.status, r.applied) for r in store.change_status(old, new, now, 7).collect()}
    assert got == {"a": ("created", True), "b": ("updated", True), "c": ("rechecked_no_changes", True), "d": ("rechecked_no_changes", True), "e": ("no_changes_recently_checked", False)}


def test_urls(spark):
    cases = [
        ("HTTP://Example.COM:80//a//b/?q=1#x", "http://example.com/a/b?q=1"), ("https://h:443", "https://h/"), ("https://h/", "https://h/"), ("https://h/A/?utm_source=f", "https://h/A?utm_source=f"),
    ]
    df = spark.createDataFrame(cases, "u string, want string").withColumn("got", urls.store_key(F.col("u")))
    assert [tuple(r) for r in df.where("want <> got").collect()] == []
    df = spark.createDataFrame([("https://h/a/#t", "https://h/a"), ("https://h/", "https://h"), ("/x/", "https://h/x")], "u string, want string").withColumn("got", urls.page_key(F.col("u"), "https://h"))
    assert [tuple(r) for r in df.where("want <> got").collect()] == []


def test_pages():
    article = (
        '<html><head><title>T</title><script type="application/ld+json">{"headline":"Аспирин","articleBody":"Текст статьи"}</script></head><body>'
        '<h2 class="structure-heading">Фармакология</h2><div><a href="/x">Анальгетик</a><a href="/y">НПВС</a></div></body></html>'
    )
    assert pages.article_page(article, "https://e.ru/p", "https://e.ru") == ("Аспирин\nТекст статьи\nФармакология: Анальгетик; НПВС", ["https://e.ru/x", "https://e.ru/y"])
    assert pages.sitemap_urls("<urlset", "https://e.ru") == []


def test_every_query_has_columns_of_its_sql():
    from lexiforge.plans import catalog

    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_statistics_and_listings_follow_the_tables(spark, tmp_path):
    from lexiforge.plans import catalog

    texts = [(0, "дом дома домами computer 100"), (1, "дому, бегать бегали"), (2, " "), (3, None), (4, "дома")]
    html = '<a href="/drugs/a/">A</a><a class="x" href="drugs/b">no</a><a href="x/drugs/b#t">B</a><a href="/drugs/">all</a><a href="https://o.ru/drugs/c">C</a><a href="/drugs/a">again</a>'
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "https://site.example/l", html), (2, "https://site.example/m", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = {}
    for name in ("stem_change_documents", "stem_groups_documents", "listing_links_pages"):
        got[name] = sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
        assert got[name] == sorted(con.execute(catalog.SQL[name]).fetchall()), name
    assert got["stem_change_documents"][0][0] == 7
    assert ("дом", 4, "дом дома домами дому") in got["stem_groups_documents"]
    assert got["listing_links_pages"] == [(1, "https://o.ru/drugs/c"), (1, "https://site.example/drugs/a"), (1, "https://site.example/x/drugs/b")]


def test_readable_sizes(spark, tmp_path):
    from lexiforge.plans import catalog

    spark.createDataFrame([(i,) for i in (0, 1, 3, 10, 100, 512, 1000)], "doc_id long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(tuple(r) for r in catalog.QUERIES["readable_sizes"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(catalog.SQL["readable_sizes"]).fetchall())
    assert [r[2] for r in got] == ["0 B", "37.00 B", "999.00 B", "36.13 KB", "35.29 MB", "4.62 GB", "34.46 GB"]


def test_readable_sizes_of_large_ids(spark, tmp_path):
    from lexiforge.plans import catalog

    ids = [392499, 420558, 427308, 473089, 489776, 491471, 544859, 608639, 629000, -198236, -608639, None]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = {r[0]: tuple(r) for r in catalog.QUERIES["readable_sizes"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: r for r in con.execute(catalog.SQL["readable_sizes"]).fetchall()}
    assert got[392499][2] == "2083615204.71 GB" and got[427308][2] == "2688592143.55 GB"


def test_sizes_round_the_binary_value(spark):
    def want(n):
        for unit in ("B", "KB", "MB", "GB"):
            if n < 1024.0 or unit == "GB":
                return f"{n:.2f} {unit}"
            n /= 1024.0

    ties = [(2 * j + 1) / 200 for j in (*range(0, 400), *range(20000, 20400), 99999)]
    sizes = [x * 1024.0**k for t in ties for x in (math.nextafter(t, 0), t, math.nextafter(t, math.inf)) for k in range(4)]
    rows = spark.createDataFrame([(x, want(x)) for x in [*sizes, *(-x for x in sizes if x < 4)]], "n double, want string").withColumn("got", store.format_size("n"))
    assert [tuple(r) for r in rows.where("got <> want or got is null").take(5)] == []


def test_addresses_resolve_as_the_standard_library_does(spark):
    bases = ["https://h", "https://h/", "https://h/a", "https://h/a/b/", "https://h/a/b/c?q=1", "http://h/../x/y"]
    links = ["x", "x/", "/x/", "./x", "../x", "../../x", "../../../x", "/a/../b", "/./a", "a/./b/../c", "..", ".", "a/..", "?q=2", "x?y=1#z", "//other/p", "http://o/a/../b", "mailto:a@b", "/a//b"]
    df = spark.createDataFrame([(b, x) for b in bases for x in links], "base string, link string").withColumn("got", urls.absolute(F.col("link"), F.col("base")))
    wrong = [(r.base, r.link, r.got, urljoin(r.base, r.link)) for r in df.collect() if r.got != urljoin(r.base, r.link)]
    assert wrong == []


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"https://e.ru/{i}", t) for i, t in CORPUS], "doc_id long, url string, text string")
    index.write_index(index.postings(docs), index.forward(docs), f"{tmp_path}/i")
    posted, forward = index.load_index(spark, f"{tmp_path}/i")
    for text, want in SEARCHES:
        found = search.with_urls(search.search(posted, text), forward).collect()
        assert [(r.n, r.doc_id, r.url) for r in sorted(found)] == [(k + 1, d, f"https://e.ru/{d}") for k, d in enumerate(want)], text
    plan = posted.where("term = 'раствор'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term" in plan
    assert sorted((r.term, r.block, r.doc_ids) for r in index.posting_lists(posted, 2).where("term = 'раствор'").collect()) == [("раствор", 0, [0]), ("раствор", 2, [4])]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        index.load_index(spark, f"{tmp_path}/none")


def test_rows_are_numbered_across_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b")).repartition(9)
    got = storage.numbered(df, [F.desc("a"), F.asc("b")], "n").orderBy("n").collect()
    assert [(r.a, r.b) for r in got] == sorted(((i % 7, i) for i in range(5000)), key=lambda x: (-x[0], x[1])) and [r.n for r in got] == list(range(1, 5001))
    assert storage.numbered(df.limit(0), [F.asc("b")], "n").count() == 0


def test_lines_keep_their_places_over_splits(spark, tmp_path):
    (tmp_path / "text").write_text("".join(f"text {i}\n" for i in range(3000)))
    (tmp_path / "url").write_text("".join(f"u{i}\n" for i in range(2990)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = textfiles.load(spark, f"{tmp_path}/text", f"{tmp_path}/url")
        assert sorted((r.doc_id, r.url, r.text) for r in got.collect()) == [(i, f"u{i}", f"text {i}") for i in range(2990)]
        assert textfiles.load(spark, f"{tmp_path}/text", f"{tmp_path}/url", 5).count() == 5 and textfiles.load(spark, f"{tmp_path}/text", f"{tmp_path}/url", 0).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_crawl_scans(spark):
    addresses = crawl.listing_addresses(spark.createDataFrame([("s", "https://h")], "source_name string, base_url string"))
    assert addresses.count() == 154 and addresses.orderBy("page").first().url == "https://h/drugs?page=1&pageSize=200"
    link = lambda *names: "".join(f'<a href="/drugs/{n}/">x</a>' for n in names)
    fetched = spark.createDataFrame([("https://h/drugs?page=1&pageSize=200", link("a", "b", "a")), ("https://h/drugs?page=3&pageSize=200", link("b", "c"))], "url string, html string")
    items = crawl.scan_listing(addresses, fetched, "https://h")
    assert sorted(map(tuple, items.collect())) == [("s", 1, 0, "https://h/drugs/a"), ("s", 1, 1, "https://h/drugs/b"), ("s", 3, 1, "https://h/drugs/c")]
    left = lambda *state: sorted(r.url[-1] for r in crawl.after_checkpoint(items, spark.createDataFrame(list(state), "source_name string, current_url string, current_page int")).collect())
    assert left(("s", "https://h/drugs/a", 1)) == ["b", "c"] and left(("s", "gone", 3)) == ["c"] and left(("other", "x", 9)) == ["a", "b", "c"]
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    maps = [("https://h/s.xml", f"<sitemapindex {ns}><sitemap><loc>https://h/1.xml</loc></sitemap><sitemap><loc>/gone.xml</loc></sitemap></sitemapindex>"), ("https://h/1.xml", f"<urlset {ns}><url><loc>https://h/p/</loc></url></urlset>"), ("https://h/2.xml", "<urlset")]
    assert [r.url for r in crawl.scan_sitemaps(spark.createDataFrame(maps, "url string, html string"), "https://h/s.xml", "https://h").collect()] == ["https://h/p"]
    rows = spark.createDataFrame([("a", 10), ("b", None), ("c", 86400 * 9)], "url string, crawled_at long")
    assert sorted(r.url for r in crawl.to_fetch(rows, rows, 86400 * 10, 7).collect()) == ["a", "b"]


def test_lines_contained_in_others():
    assert pages.distinct_lines("abc\n b \n\nxyz\nxyzz\nq") == "abc\nxyz\nq"


def test_configuration():
    got = config.parse('db:\n  host: mongodb\n  port: 27017\nlogic:\n  delay: 0.5\n  agent: "A b/1.0"\n# note\n\nsources:\n  one:\n    on: true\n    url: "https://h/x?a=1"\n')
    assert got == {"db": {"host": "mongodb", "port": 27017}, "logic": {"delay": 0.5, "agent": "A b/1.0"}, "sources": {"one": {"on": True, "url": "https://h/x?a=1"}}}
    with pytest.raises(ValueError, match="not a map"):
        config.parse("- a\n")


def test_functions_of_sql(spark):
    from lexiforge.functions import register

    register.register(spark)
    r = spark.sql("SELECT normalize_url('HTTP://Example.COM:80//a//b/?q=1#x') AS u, normalize_url('https://h:443') AS v, tokenize('Хранить при 25°C') AS t, stem('дома') AS s, stem(CAST(NULL AS STRING)) AS n").first()
    assert (r.u, r.v, r.t, r.s, r.n) == ("http://example.com/a/b?q=1", "https://h/", ["хранить", "при", "25°C"], "дом", None)


def test_index_stream_takes_a_file_or_a_folder(spark, tmp_path):
    from lexiforge.plans import catalog

    whole = spark.createDataFrame([*CORPUS, (5, None), (6, "")], "doc_id long, text string")
    whole.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    whole.select("doc_id").write.parquet(f"{tmp_path}/folder/documents.parquets")  # another table, not to be read
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/folder/documents.parquet/*.parquet')")
    (tmp_path / "file").mkdir()
    con.execute(f"COPY documents TO '{tmp_path}/file/documents.parquet' (FORMAT parquet)")
    want = sorted(con.execute(catalog.SQL["stream_index"]).fetchall())
    assert len(want) > 5
    whole.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 2)).write.partitionBy("lang").parquet(f"{tmp_path}/partitions/documents.parquet")
    for at in ("folder", "file", "partitions"):
        assert sorted(tuple(r) for r in catalog.QUERIES["stream_index"](spark, f"{tmp_path}/{at}").collect()) == want, at


def test_store_stream_replays_and_tells_changes(spark, tmp_path):
    from lexiforge.streaming import incremental

    schema = "url string, raw_html string, clean_text string, source_name string"
    for n, rows in enumerate(([("a", "1", "1", "s"), ("b", "1", "1", "s")], [("a", "2", "2", "s"), ("c", "1", "1", "s"), ("c", "1", "1", "s")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.merge_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", 1000 + n, 7).awaitTermination()
    got = {r.url: (r.raw_html, r.crawled_at, r.created_at) for r in incremental.read_store(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": ("2", 1001, 1000), "b": ("1", 1000, 1000), "c": ("1", 1001, 1001)}
