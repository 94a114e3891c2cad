"""HTML to columns: one Arrow function gives a page's tree in flat form, all the
rest is expressions over it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib import parse

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.text import text
from ..shipping import ship

LAST_CHANCE, SIMILAR = "Dernière chance pour postuler", "Concours similaires"
_S = T.StringType()
PAGE = T.StructType(
    [
        T.StructField("text", _S),
        T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", _S), T.StructField("text", _S)]))),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("tag", _S), T.StructField("text", _S)]))),
        T.StructField("items", T.ArrayType(T.ArrayType(_S))),
        T.StructField("deposit_link", _S),
    ]
)
_BLOCKS = {"h2", "h3", "h4", "div", "p"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Strings of the page in order, and for each open element where they began."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.strings: list[str] = []
        self.open: list[tuple[str, int, int]] = []
        self.nodes: list[list] = []  # tag, first string, one after the last, href

    def handle_starttag(self, tag, attrs):
        self.nodes.append([tag, len(self.strings), None, dict(attrs).get("href")])
        if tag not in _VOID:
            self.open.append((tag, len(self.nodes) - 1, 0))

    def handle_startendtag(self, tag, attrs):
        self.nodes.append([tag, len(self.strings), len(self.strings), dict(attrs).get("href")])

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            for _, node, _ in self.open[at:]:
                self.nodes[node][2] = len(self.strings)
            del self.open[at:]

    def handle_data(self, data):
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.strings.append(data)


_SPACE = re.compile(r"\s+")


def _clean(s: str) -> str:
    return _SPACE.sub(" ", s).strip()


def _read(html: str | None) -> tuple:
    page = _Page()
    page.feed(html or "")
    page.close()
    strings = page.strings
    held = lambda n: [s.strip() for s in strings[n[1] : n[2] if n[2] is not None else len(strings)] if s.strip()]
    links = [{"href": n[3], "text": _clean(" ".join(held(n)))} for n in page.nodes if n[0] == "a" and n[3] is not None]
    blocks = [{"tag": n[0], "text": _clean(" ".join(held(n)))} for n in page.nodes if n[0] in _BLOCKS]
    items = [[_clean(z).lstrip("-• ") for x in held(n) for z in x.splitlines() if _clean(z)] for n in page.nodes if n[0] == "li"]
    site = next((i for i, s in enumerate(strings) if "site de dépôt" in s.lower() and ":" in s.lower().split("site de dépôt", 1)[1][:40]), None)
    link = None if site is None else next((n[3] for n in page.nodes if n[0] == "a" and n[3] is not None and n[1] > site), None)
    return " ".join(s.strip() for s in strings if s.strip()), links, blocks, items, link


def _head(html: str) -> tuple:
    return _read(re.split(LAST_CHANCE.replace(" ", r"\s+"), html or "", maxsplit=1, flags=re.IGNORECASE)[0])


def listing_links(html: str) -> list[str]:
    """The paths of a listing page's links to detail pages, each once, in order;
    for the reader, which must know when to stop."""
    paths = [parse.urlsplit(link["href"]).path for link in _head(html)[1]]
    return list(dict.fromkeys(p for p in paths if re.match(V.DETAIL_PATH, p)))


def listing_facts(html: str) -> tuple[int, list[str]]:
    """(official count, links) of a listing page; a page without a counter is
    refused."""
    counts = re.findall(V.RESULTS, _head(html)[0], re.IGNORECASE)
    digits = re.sub(r"\D", "", counts[-1]) if counts else ""
    if not digits:
        raise ValueError("the page has no counter of results")
    return int(digits), listing_links(html)


#: column of a detail page and the label its block starts with
_HEADINGS = {"administration": "Administration qui recrute", "published": "Date de publication", "until": "Délai de dépôt des candidatures", "held": "Date du concours"}
_PLAIN = ("positions", "job_name", "grade", "recruitment_type", "application_type", "application_site", "contest_code")
DETAIL = T.StructType([*[T.StructField(c, _S) for c in (*_HEADINGS, *_PLAIN)], T.StructField("specialties", T.ArrayType(_S))])
_DASH = re.compile(r"\s+-\s+")


def _detail(html: str | None) -> dict:
    """A detail page's headings (what follows a label in the first block that
    starts with it) and labelled list items (the last one of a label counts)."""
    _, _, blocks, items, link = _read(html)
    row: dict = {}
    for column, label in _HEADINGS.items():
        hit = next((b["text"] for b in blocks if b["text"].lower().startswith(label.lower())), "")
        row[column] = hit[len(label) :].strip()
    found: dict[str, list[str]] = {}
    for lines in items:
        label, colon, rest = lines[0].partition(":") if lines else ("", "", "")
        key = V.DETAIL_LABELS.get(_clean(label).lower()) if colon else None
        if key:
            found[key] = [v for v in (_clean(rest).lstrip("-• "), *lines[1:]) if v]
    row |= {c: " ".join(found.get(c, [])) for c in _PLAIN}
    row["application_site"] = row["application_site"] or link or ""
    parts = [_clean(p) for v in found.get("specialties", []) for p in _DASH.split(v)]
    row["specialties"] = list(dict.fromkeys(p for p in parts if p))
    return row


@F.pandas_udf(DETAIL)
def _detail_of(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_detail(h) for h in html], columns=DETAIL.names)


@F.pandas_udf(PAGE)
def _page_of(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(h) for h in html], columns=["text", "links", "blocks", "items", "deposit_link"])


class _Links(HTMLParser):
    """The targets of the page's links, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.found.append(href)


def _hrefs(html: str | None) -> list[str]:
    page = _Links()
    page.feed(html or "")
    page.close()
    return page.found


#: Links that a task holds before it hands them on; those of a page stay together.
LINKS = 4096


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column is the html."""
    for b in batches:
        rows, pos, hrefs = [], [], []
        for i, html in enumerate(b.columns[-1], 1):
            found = _hrefs(html.as_py())
            rows += [i - 1] * len(found)
            pos += range(len(found))
            hrefs += found
            if rows and (len(rows) >= LINKS or i == b.num_rows):
                kept = b.select(range(b.num_columns - 1)).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(pos, pa.int32()), pa.array(hrefs, pa.string())], names=[*kept.schema.names, "pos", "href"])
                rows, pos, hrefs = [], [], []


def links(pages: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """The columns `keep`, pos and href of each link of each page, as page() finds
    them. A page is parsed once and goes before the next one, its links are handed
    on a few thousand at a time: a task holds no more, however large its batch."""
    ship(pages.sparkSession)
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("pos", T.IntegerType()), T.StructField("href", _S)])
    return pages.select(*keep, html).mapInArrow(_linked, schema)


def detail(html: Column) -> Column:
    ship()
    return _detail_of(html)


def page(html: Column) -> Column:
    ship()
    return _page_of(html)


def before(html: Column | str, mark: str) -> Column:
    """A page up to a mark (its words, however spaced or written)."""
    pattern = r"(?iU)" + mark.replace(" ", r"\s+")
    return F.try_element_at(F.split(text(html), pattern, 2), F.lit(1))


