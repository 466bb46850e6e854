"""URL normal forms as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/")
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.lit("/"))).otherwise(kept)
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(F.lit("/"), F.regexp_replace(closed, "^/+", ""))).otherwise(path)


def absolute(url: Column, base: str | Column | None) -> Column:
    """``url`` against ``base`` (scheme://host[/path]), a text or a column of page addresses; URLs with a scheme stay."""
    if base is None or isinstance(base, str) and not base:
        return url
    base = F.lit(base) if isinstance(base, str) else base
    part = lambda i: F.regexp_extract(base, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)(//[^/?#]*)([^?#]*)(\?[^#]*)?", i)
    scheme, root, bare = part(1), F.concat(part(1), part(2)), F.concat(part(1), part(2), part(3))
    path, rest = F.regexp_extract(url, r"(?s)^([^?#]*)(.*)", 1), F.regexp_extract(url, r"(?s)^([^?#]*)(.*)", 2)
    folder = F.concat(F.regexp_replace(part(3), r"[^/]*\z", ""), F.lit("/"))
    joined = F.regexp_replace(F.concat(F.lit("/"), folder, path), "/{2,}", "/")  # empty segments of a relative path go
    return (
        F.when(url.rlike(_SCHEME), url).when(url.startswith("//"), F.concat(scheme, url)).when(url == "", base).when(url.startswith("#"), F.concat(F.regexp_replace(base, "(?s)#.*", ""), url))
        .when(url.startswith("?"), F.concat(bare, url)).when(url.startswith("/"), F.concat(root, _without_dots(path), rest)).otherwise(F.concat(root, _without_dots(joined), rest))
    )


def store_key(url: Column, base: str | Column | None = None) -> Column:
    """Key of the store: scheme and host in lower case, default ports, repeated and trailing slashes and the fragment gone."""
    u = absolute(url, base)
    part = lambda i: F.regexp_extract(u, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", i)
    scheme, host, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
    bare = F.when((scheme == "http"), F.regexp_replace(host, r":80\z", "")).when(scheme == "https", F.regexp_replace(host, r":443\z", "")).otherwise(host)
    single = F.regexp_replace(path, "/{2,}", "/")
    short = F.when(single.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(single, r"/+\z", ""))
    return F.when(scheme == "", u).otherwise(F.concat(scheme, F.lit("://"), bare, short, F.when(query == "?", "").otherwise(query)))


def page_key(url: Column, base: str | Column | None = None) -> Column:
    """Form used for links on pages: absolute, without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(absolute(url, base), "(?s)#.*", ""), r"/+\z", "")


def listing_links(html: Column, base: str) -> Column:
    """Distinct item links of a listing page, in order of appearance."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    wanted = F.filter(hrefs, lambda h: h.contains("/drugs/") & ~h.isin("/drugs", "/drugs/", "/drugs?") & (F.length(h) - F.length(F.replace(h, F.lit("/"))) >= 2))
    full = F.transform(wanted, lambda h: page_key(h, base))
    return F.array_distinct(F.filter(full, lambda u: u.contains("/drugs/") & (u != base + "/drugs")))


def page_links(html: Column, base: str | Column) -> Column:
    """Distinct links of a page in normal form; fragments, scripts and mail addresses left out."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    wanted = F.filter(hrefs, lambda h: (h != "") & ~h.rlike("^(?:#|javascript:|mailto:)"))
    return F.array_distinct(F.transform(wanted, lambda h: page_key(h, base)))
