"""Facts from the parsed tree of a page: visible text, links, tables, and people listed on it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HIDDEN = frozenset("script style noscript template svg".split())
_BLOCKS = frozenset("p div li ul ol tr td th table h1 h2 h3 h4 h5 h6 br section article main header footer aside nav dd dt dl button form".split())


class _Page(HTMLParser):
    """Collects visible text by block, links with their text, and table cells by row."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden = 0
        self.text: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.rows: list[list[str]] = []
        self.href: str | None = None
        self.link_text: list[str] = []
        self.cell: list[str] | None = None
        self.title = ""
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.hidden += tag in _HIDDEN
        self.in_title = tag == "title"
        if tag in _BLOCKS:
            self.text.append("\n")
        if tag == "a":
            self.href, self.link_text = dict(attrs).get("href") or "", []
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in _HIDDEN and self.hidden > 0
        self.in_title = False
        if tag in _BLOCKS:
            self.text.append("\n")
        if tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join("".join(self.link_text).split())))
            self.href = None
        elif tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.text.append(data)
            if self.href is not None:
                self.link_text.append(data)
            if self.cell is not None:
                self.cell.append(data)


def parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def visible_text(html: str | None) -> str:
    """Text a reader sees, one block per line, blanks collapsed; empty for null."""
    lines = (" ".join(x.split()) for x in "".join(parsed(html).text).split("\n"))
    return "\n".join(x for x in lines if x)


_FACTS = T.StructType([T.StructField("title", T.StringType()), T.StructField("visible", T.StringType()), T.StructField("n_links", T.IntegerType()), T.StructField("n_rows", T.IntegerType())])


@F.pandas_udf(_FACTS)
def _facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for html in batch:
            page = parsed(html)
            lines = (" ".join(x.split()) for x in "".join(page.text).split("\n"))
            out.append((" ".join(page.title.split()), "\n".join(x for x in lines if x), len(page.links), sum(bool(r) for r in page.rows)))
        yield pd.DataFrame(out, columns=["title", "visible", "n_links", "n_rows"])


def page_facts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``page_title, visible, n_links, n_rows`` in place of the markup."""
    out = pages.withColumn("_f", _facts(html_col))
    keep = [c for c in pages.columns if c not in (html_col, "title", "visible", "n_links", "n_rows")]
    return out.select(*keep, F.col("_f.title").alias("page_title"), "_f.visible", "_f.n_links", "_f.n_rows")


_NAME = r"(?:[A-ZÀ-ÞŁŚŠŽĐ][\w'’.-]*\s+){1,4}(?:(?:van|von|de|del|der|da|ter|la)\s+){0,2}[A-ZÀ-ÞŁŚŠŽĐ][\w'’-]+"
_LISTED = re.compile(rf"^(?P<name>{_NAME}),\s+(?P<title>[^\d@]{{3,80}})$", re.U)
_PEOPLE = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("title", T.StringType())]))


@F.pandas_udf(_PEOPLE)
def _people(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([[(i, m["name"], m["title"]) for i, line in enumerate(visible_text(h).split("\n")) if (m := _LISTED.match(line))] for h in batch])


def listed_people(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 2) -> DataFrame:
    """``page_id, pos, name, title`` for blocks of the form "name, title", on pages that have at least ``least`` of them."""
    rows = pages.select(F.col(id_col).alias("page_id"), _people(html_col).alias("_p")).where(F.size("_p") >= least)
    return rows.select("page_id", F.explode("_p").alias("p")).select("page_id", "p.pos", "p.name", "p.title")
