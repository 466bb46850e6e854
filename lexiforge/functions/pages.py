"""Text and links of HTML pages and sitemaps, in Arrow batches.

Pages need a tree, which no SQL function gives; the standard library's parser
builds one per page inside ``mapInArrow``-style vectorised functions.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset("script style button svg img link meta".split())
_SITEMAP = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
# Labels that count as no content, and words that mark boilerplate.
NO_CONTENT = frozenset(("нет данных", "none", "—", "-", ""))
NOTICE_WORDS = ("cookie", "политика", "©", "copyright", "rights")
#: Patterns of advertising in bare strings, and those that count in whole sections besides (fixed values).
ADVERT_STRINGS = re.compile(r"реклама|внимание!|информация исключительно|специалист.*здравоохранения|описание проверено", re.I)
ADVERT = re.compile(r"реклама|внимание!|информация исключительно|специалист.*здравоохранения|описание проверено|крылов.*юрий.*федорович|опыт работы.*лет", re.I)
ADVERT_PATHS = ("/ads/", "/advert/", "/reklama/", "/banner/", "?utm_", "#")


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict, parent: Node | None):
        self.name, self.attrs, self.children, self.parent = name, attrs, [], parent

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def strings(self):
        for c in self.children:
            if isinstance(c, Node):
                yield from c.strings()
            else:
                yield c

    def find_all(self, *names: str, where=lambda n: True) -> list[Node]:
        return [n for n in self.walk() if (not names or n.name in names) and where(n)]

    def find(self, *names: str, where=lambda n: True) -> Node | None:
        return next((n for n in self.walk() if (not names or n.name in names) and where(n)), None)

    def text(self, separator: str = "") -> str:
        return separator.join(s for s in (x.strip() for x in self.strings()) if s)

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]

    @property
    def classes(self) -> str:
        return self.attrs.get("class") or ""


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _squeeze(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def unique_text(node: Node) -> str:
    """Distinct text nodes in order, on one line; silent elements left out."""
    seen: dict[str, None] = {}

    def visit(n: Node):
        for c in n.children:
            if not isinstance(c, Node):
                if c.strip():
                    seen.setdefault(c.strip())
            elif c.name not in _SILENT:
                visit(c)

    visit(node)
    return " ".join(_squeeze(s) for s in seen)


def distinct_lines(text: str) -> str:
    """Lines in order, less those that an earlier line contains or is contained in."""
    kept: list[str] = []
    for line in (x.strip() for x in text.split("\n")):
        if line and not any(line in k or k in line for k in kept):
            kept.append(line)
    return "\n".join(kept)


def link_key(url: str, base: str) -> str:
    """Absolute form of a link without fragment and trailing slashes."""
    full = url if urlparse(url).scheme else urljoin(base, url)
    return full.split("#")[0].rstrip("/")


def _links(root: Node, base: str | None, wanted) -> list[str]:
    if not base:
        return []
    hrefs = [a.attrs["href"] for a in root.find_all("a", where=lambda n: "href" in n.attrs)]
    keys = [link_key(h, base) for h in hrefs if h and not h.startswith(("#", "javascript:", "mailto:"))]
    return list(dict.fromkeys(k for k in keys if k and wanted(k)))


def label_page(html: str, url: str, base: str | None = None) -> tuple[str, list[str]]:
    """Pages of label and content elements, told by their data-test-id."""
    root = tree(html)
    head = root.find("title")
    title = head.text().replace("- Информация о препарате - ЛС ГЭОТАР", "").strip().replace("ЛС ГЭОТАР", "").strip() if head else ""
    title = re.sub(r"\s*-\s*$", "", title)
    for n in root.find_all(*_SILENT, "form", "input", "select"):
        n.drop()
    by_id: dict[str, Node] = {}
    for n in root.find_all(where=lambda n: n.attrs.get("data-test-id")):
        by_id.setdefault(n.attrs["data-test-id"], n)
    holds = lambda s: any(x in s for x in ("content", "value", "cms"))
    parts, labels = [title] if title else [], set()
    for key, n in by_id.items():
        is_item = "info-item" in key and not holds(key)
        if not ("label" in key or is_item and (n.find("h3") or "label" in n.classes.split())):
            continue
        for extra in n.find_all("a"):
            extra.drop()
        label = _squeeze(n.text())
        if not label or label in labels:
            continue
        labels.add(label)
        around = n.parent.find("div", "span", where=lambda m: holds(m.attrs.get("data-test-id", "")) or holds(m.classes)) if n.parent else None
        if around is None and (stem := re.match(r"(.+?)-(?:label|title|header)", key)):
            around = next((by_id[f"{stem[1]}-{x}"] for x in ("content", "value", "cms") if f"{stem[1]}-{x}" in by_id), None)
        content = distinct_lines(unique_text(around)) if around else ""
        if not content and n.parent:
            lines = n.parent.text("\n").split("\n")
            content = "\n".join(lines[1:] if lines[0].strip() == label else lines).strip()
        if content.lower() in NO_CONTENT:
            continue
        parts += [f"{label}: {content}"] if "\n" not in content else [f"{label}:", *(f"  {x.strip()}" for x in content.split("\n") if x.strip())]
    if len(parts) <= 1:
        for h in root.find_all("h3"):
            label, after = _squeeze(h.text()), _next(root, h, "div")
            content = unique_text(after) if after else ""
            if len(label) > 1 and content and content.lower() != "нет данных":
                parts.append(f"{label}: {content}")
    text = "\n".join({_squeeze(p): p for p in reversed(parts) if _squeeze(p)}[k] for k in dict.fromkeys(_squeeze(p) for p in parts) if k)
    if len(text.split("\n")) < 3:
        main = root.find("main") or root.find("div", where=lambda n: re.search("container|main|content", n.classes)) or root.find("body")
        lines = [x.strip() for x in (unique_text(main) if main else "").split("\n")]
        lines = [x for x in lines if len(x) > 10 and not any(w in x.lower() for w in NOTICE_WORDS)]
        if lines:
            text += "\n\n" + "\n".join(lines[:20])
    return text.strip(), _links(root, base, lambda k: "/drugs/" in k or base in k)


def _next(root: Node, after: Node, name: str) -> Node | None:
    """The first element of that name behind ``after`` in the document."""
    passed = False
    for n in root.walk():
        if n is after:
            passed = True
        elif passed and n.name == name:
            return n
    return None


def _words(s: str) -> set[str]:
    return set(re.sub(r"[^\w\s]", "", s.lower()).split())


def _apart(parts: list[str], least: int, share: float) -> list[str]:
    """Parts in order, less those that share too many words with an earlier one."""
    kept, seen = [], []
    for p in parts:
        words = _words(p)
        if words and not any(len(words & s) > max(least, share * len(words)) for s in seen):
            kept.append(p.strip())
            seen.append(words)
    return kept


def article_page(html: str, url: str, base: str | None = None) -> tuple[str, list[str]]:
    """Articles with linked-data headline and body and sections under structure headings."""
    if "отсутствует в БД РЛС" in html:
        return "", []
    root = tree(html)
    title = body = ""
    for script in root.find_all("script", where=lambda n: n.attrs.get("type") == "application/ld+json"):
        data = "".join(script.strings())
        if m := re.search(r'"articleBody"\s*:\s*"([^"]+)"', data):
            body = _squeeze(m[1].replace('\\"', '"').replace("\\n", " ").replace("\\t", " "))
        if m := re.search(r'"headline"\s*:\s*"([^"]+)"', data):
            title = m[1].strip()
            break
    head = root.find("title")
    title = title or (head.text() if head else "")
    gone = re.compile(r"banner|advert|реклама|reklama|modal|popup", re.I)
    for n in root.find_all(where=lambda n: n.name in ("script", "style", "link", "meta", "button", "nav", "menu", "header", "footer", "aside") or gone.search(n.classes)):
        n.drop()
    sections: dict[str, str] = {}
    for h in root.find_all("h2", where=lambda n: "structure-heading" in n.classes.split()):
        name = h.text()
        if name in sections:
            continue
        sections[name] = ""
        after = _next(root, h, "div")
        content = "; ".join(t for t in (a.text() for a in after.find_all("a")) if t) if after else ""
        if not content:
            siblings = h.parent.children[h.parent.children.index(h) + 1 :]
            stop = next((i for i, s in enumerate(siblings) if isinstance(s, Node) and s.name == "h2"), len(siblings))
            texts = [_squeeze(re.sub(r"<[^>]+>", "", s.text() if isinstance(s, Node) else s)) for s in siblings[:stop]]
            advert = [(ADVERT if isinstance(s, Node) else ADVERT_STRINGS).search(t) for s, t in zip(siblings, texts, strict=False)]
            content = " ".join(_apart([t for t, a in zip(texts, advert, strict=True) if len(t) > 2 and not a], 3, 0.5))
        if "Состав и форма выпуск" in name and (table := root.find("div", where=lambda n: "table-responsive" in n.classes.split())):
            rows = [[c.text() for c in r.find_all("td", "th")] for r in table.find_all("tr")]
            content = " ".join(f"{r[0]}: {r[1]}" for r in rows if len(r) >= 2 and r[0] and r[1]) or content
        content = _squeeze(_squeeze(re.sub(r"<[^>]+>", "", content)).replace(name, ""))
        own = _words(content)
        if content and not ADVERT.search(content) and not (body and len(own & _words(body)) > max(5, 0.7 * len(own))):
            sections[name] = content
    parts = _apart([p for p in (title, body, *(f"{k}: {v}" for k, v in sections.items() if v)) if p.strip()], 5, 0.6)
    if len(parts) <= 1:
        return "", []
    lines = "\n".join(parts).split("\n")
    if len(lines) > 3:
        before = _words(" ".join(lines[:-3]))
        lines = lines[:-3] + [x for x in lines[-3:] if (w := _words(x)) and len(w & before) < max(3, 0.5 * len(w))]
    return "\n".join(lines).strip(), _links(root, base, lambda k: base in k and not any(p in k for p in ADVERT_PATHS))


def sitemap_urls(xml: str, base: str) -> list[str]:
    """Locations of a sitemap or a sitemap index; nothing for anything else."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    kind = "sitemap" if "sitemapindex" in root.tag else "url" if "urlset" in root.tag else None
    found = [e.find(f"{_SITEMAP}loc") for e in root.iter(f"{_SITEMAP}{kind}")] if kind else []
    return [link_key(e.text, base) for e in found if e is not None and e.text]


def sitemap(xml: Column, base: Column) -> Column:
    """Locations of sitemaps as an array of links in page form."""

    @F.pandas_udf("array<string>")
    def run(x: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sitemap_urls(a, c or "") for a, c in zip(x, b, strict=True)])

    return run(xml, base)


def has_article(text: Column) -> Column:
    """More than one line once trimmed: a page of one line holds no article."""
    return F.coalesce(F.size(F.split(F.btrim(text, F.lit(" \t\r\n\f")), "\n")) > 1, F.lit(False))


def uncontained_lines(text: Column) -> Column:
    """``distinct_lines`` as an array column (spaces trimmed), without leaving the JVM."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")
    step = lambda acc, x: F.when(F.exists(acc, lambda s: F.contains(s, x) | F.contains(x, s)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(lines, F.expr("cast(array() as array<string>)"), step)


def article_or_sitemap(html: str, url: str, base: str | None = None) -> tuple[str, list[str]]:
    if url.endswith(".xml") or "sitemap" in url.lower():
        return f"Sitemap: {url}", sitemap_urls(html, base or url)
    return article_page(html, url, base)


#: Page parsers by the names that sources are configured with.
PARSERS = {"isgeotar": label_page, "rlsnet": article_or_sitemap}


def extract(html: Column, url: Column, parser: str, base: str | None = None) -> Column:
    """struct(clean_text, extracted_urls) of pages; a page that breaks the parser is empty."""
    parse = PARSERS[parser]

    @F.pandas_udf("clean_text string, extracted_urls array<string>")
    def run(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(h, u, strict=True):
            try:
                out.append(parse(x or "", y or "", base))
            except (ValueError, RecursionError, AttributeError, IndexError):
                out.append(("", []))
        return pd.DataFrame(out, columns=["clean_text", "extracted_urls"])

    return run(html, url)
