"""Field extraction from page HTML, run per Arrow batch over a pages table.

The helper below builds a small element tree with the standard library parser and
answers the handful of selector forms collectors use: ``tag``, ``.class``,
``tag.class`` and ``tag[attr*='text']``.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmarket.functions.text import absolute_url, parse_row_text, ROW_FIELDS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HIDDEN_TEXT = frozenset(("script", "style", "template"))
SELECTOR = re.compile(
    r"(?P<tag>[a-zA-Z][\w-]*)?(?:\.(?P<cls>[\w-]+))?(?:\[(?P<attr>[\w-]+)\*='(?P<part>[^']*)'\])?$"
)


class Element:
    def __init__(self, tag: str, attrs=(), parent: "Element | None" = None):
        self.tag, self.attrs, self.parent = tag, dict(attrs), parent
        self.children: list[Element | str] = []

    def descendants(self):
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, Element):
                stack.extend(reversed(node.children))

    def text(self, separator: str) -> str:
        """Stripped, non-empty text pieces joined; script and style text is left out."""
        pieces, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                if node.strip():
                    pieces.append(node.strip())
            elif node.tag not in HIDDEN_TEXT:
                stack.extend(reversed(node.children))
        return separator.join(pieces)

    def matches(self, selector: dict) -> bool:
        classes = (self.attrs.get("class") or "").split()
        return (
            (not selector["tag"] or self.tag == selector["tag"].lower())
            and (not selector["cls"] or selector["cls"] in classes)
            and (not selector["attr"] or selector["part"] in (self.attrs.get(selector["attr"]) or ""))
        )

    def select(self, selector: str):
        found = SELECTOR.match(selector)
        if not selector or not found:
            raise ValueError(f"unsupported selector: {selector!r}")
        want = found.groupdict()
        return (n for n in self.descendants() if isinstance(n, Element) and n.matches(want))

    def closest(self, tags) -> "Element | None":
        node = self.parent
        while node is not None and node.tag not in tags:
            node = node.parent
        return node


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Element("")

    def handle_starttag(self, tag, attrs):
        element = Element(tag, attrs, self.open)
        self.open.children.append(element)
        if tag not in VOID_TAGS:
            self.open = element

    def handle_startendtag(self, tag, attrs):
        self.open.children.append(Element(tag, attrs, self.open))

    def handle_endtag(self, tag):
        node = self.open
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        siblings = self.open.children
        if siblings and isinstance(siblings[-1], str):
            siblings[-1] += data
        else:
            siblings.append(data)


def parse_html(html: str | None) -> Element:
    builder = _TreeBuilder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def extract_links(pages: DataFrame, path: str, base_url: str, key: str = "page_id") -> DataFrame:
    """Absolute addresses of all anchors whose href contains ``path``; JVM only."""
    pattern = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'>]*)["']"""
    hrefs = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    return (
        pages.select(key, F.posexplode(F.filter(hrefs, lambda h: h.contains(path))).alias("pos", "href"))
        .where("href <> ''")
        .select(key, "pos", absolute_url("href", base_url).alias("job_url"))
    )


def extract_listings(
    pages: DataFrame,
    path: str,
    base_url: str,
    page: str = "page",
    containers: tuple[str, ...] = ("li", "div", "tr"),
) -> DataFrame:
    """One row per listing link: its position, address and the fields of its row text.

    The text comes from the closest enclosing container, or the link itself.
    """
    selector = f"a[href*='{path}']"

    def scan(batches):
        for batch in batches:
            rows = []
            for number, html in zip(batch["page"], batch["html"]):
                for pos, link in enumerate(parse_html(html).select(selector)):
                    text = (link.closest(containers) or link).text(" | ")
                    if link.attrs.get("href") and text:
                        rows.append((number, pos, link.attrs["href"], text))
            yield pd.DataFrame(rows, columns=["page", "pos", "href", "raw_row_text"])

    found = pages.select(F.col(page).cast("bigint").alias("page"), "html").mapInPandas(
        scan, "page bigint, pos int, href string, raw_row_text string"
    )
    found = found.withColumn("_row", parse_row_text("raw_row_text"))
    fields = [F.col(f"_row.{f}").alias(f) for f in (*ROW_FIELDS, "date_posted")]
    return found.select(
        "page", "pos", *fields, absolute_url("href", base_url).alias("job_url"), "raw_row_text"
    )


def extract_cards(
    pages: DataFrame, card: str, fields: dict[str, str], keys: tuple[str, ...] = ("page_id",)
) -> DataFrame:
    """One row per element matching ``card``, one column per ``field: selector``.

    Missing fields are null; ``job_url`` reads the href, others the joined text.
    """
    names = list(fields)

    def pick(element: Element, name: str):
        found = next(element.select(fields[name]), None)
        if found is None:
            return None
        return found.attrs.get("href") if name == "job_url" else found.text("")

    def scan(batches):
        for batch in batches:
            rows = [
                (*row[:-1], pos, *(pick(element, n) for n in names))
                for row in batch.itertuples(index=False, name=None)
                for pos, element in enumerate(parse_html(row[-1]).select(card))
            ]
            yield pd.DataFrame(rows, columns=[*keys, "pos", *names])

    source = pages.select(*keys, "html")
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema[:-1])
    schema = f"{key_types}, pos int, " + ", ".join(f"{n} string" for n in names)
    return source.mapInPandas(scan, schema)


def extract_details(
    pages: DataFrame, fields: dict[str, str], key: str = "job_url", separator: str = " "
) -> DataFrame:
    """First match per selector on each detail page; empty text becomes null."""
    names = list(fields)

    def first_text(root: Element, selector: str):
        found = next(root.select(selector), None)
        return (found.text(separator) or None) if found is not None else None

    def scan(batches):
        for batch in batches:
            rows = []
            for name, html in zip(batch["key"], batch["html"]):
                root = parse_html(html)
                rows.append((name, *(first_text(root, fields[n]) for n in names)))
            yield pd.DataFrame(rows, columns=["key", *names])

    source = pages.select(F.col(key).alias("key"), "html")
    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{n} string" for n in names)
    return source.mapInPandas(scan, schema).withColumnRenamed("key", key)
