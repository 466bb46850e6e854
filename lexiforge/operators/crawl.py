"""Crawl scans as relations: addresses are generated, pages are a table of what was fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import pages, urls

#: Pages of a listing and links a page (fixed values).
LISTING_PAGES, PAGE_SIZE = 154, 200


def listing_addresses(sources: DataFrame, n_pages: int = LISTING_PAGES, page_size: int = PAGE_SIZE) -> DataFrame:
    """(source_name, page, url) of every listing page of ``sources`` (source_name, base_url)."""
    numbered = sources.select("source_name", "base_url", F.explode(F.sequence(F.lit(1), F.lit(n_pages))).alias("page"))
    return numbered.select("source_name", "page", F.format_string(f"%s/drugs?page=%d&pageSize={page_size}", "base_url", "page").alias("url"))


def scan_listing(addresses: DataFrame, fetched: DataFrame, base: str) -> DataFrame:
    """(source_name, page, place, url): item links of the listing pages in ``fetched`` (url, html), each link where it is first seen.

    Pages that were not fetched are passed over.
    """
    found = addresses.join(fetched.select("url", "html"), "url").select("source_name", "page", F.posexplode(urls.listing_links(F.col("html"), base)).alias("place", "link"))
    first = found.groupBy("source_name", "link").agg(F.min(F.struct("page", "place")).alias("at"))
    return first.select("source_name", "at.page", "at.place", F.col("link").alias("url"))


def after_checkpoint(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items (source_name, page, place, url) behind the checkpoint (source_name, current_url, current_page) of their source.

    A source without one starts at the beginning; if its page no longer lists
    the last item, that page starts over.
    """
    last = items.select("source_name", F.col("url").alias("current_url"), F.col("page").alias("current_page"), F.col("place").alias("last_place"))
    known = state.select("source_name", "current_url", "current_page").join(last, ["source_name", "current_url", "current_page"], "left")
    done = F.struct("page", "place") <= F.struct("current_page", F.coalesce("last_place", F.lit(-1)))
    return items.join(known, "source_name", "left").where(F.col("current_page").isNull() | ~done).select(items.columns)


def scan_sitemaps(fetched: DataFrame, start_url: str, base: str) -> DataFrame:
    """(url): article addresses, from the index at ``start_url`` to its sitemaps to their locations, each once.

    fetched: (url, html) of what was fetched, sitemaps included.
    """
    locations = lambda df: df.select(F.explode(pages.sitemap(F.col("html"), F.lit(base))).alias("url")).distinct()
    children = locations(fetched.where(F.col("url") == start_url))
    return locations(fetched.join(children, "url", "left_semi"))


def to_fetch(addresses: DataFrame, store: DataFrame, now: int, days: int) -> DataFrame:
    """Addresses that the store (url, crawled_at) lacks, never crawled or holds too long."""
    fresh = store.where(F.col("crawled_at") > now - days * 86400).select("url")
    return addresses.select("url").distinct().join(fresh, "url", "left_anti")
