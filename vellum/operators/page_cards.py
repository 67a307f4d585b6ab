"""People on directory pages whose layout is more than a table or a list: cards, accordions, teasers, split names, data in scripts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.emails import ADDRESS
from vellum.functions.urls import PROFILE_PATHS
from vellum.operators.page_people import looks_like_person, looks_like_post

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Regions that hold no people; elements that may be a card; words of classes that say they are, and that they aren't.
_SKIPPED = frozenset("nav footer script style noscript header form".split())
_CARDS = frozenset("article li div section tr".split())
_CARD_WORDS = ("person", "people", "faculty", "profile", "card", "member", "team")
_OTHER_WORDS = ("nav", "menu", "footer", "header", "search", "filter")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Headers of columns that hold parts of names, and fields of data in scripts.
_FIRST, _LAST = ("first name", "firstname", "given name", "vorname", "prénom", "nombre", "имя"), ("last name", "lastname", "surname", "family name", "nachname", "nom", "apellidos", "фамилия")
_JSON_NAME, _JSON_TITLE = ("name", "fullName", "displayName"), ("jobTitle", "title", "position", "role")
_JSON_URL, _JSON_MAIL = ("url", "profileUrl", "link"), ("email", "mail")


class Element:
    """An element with its attributes, children and text in order."""

    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += [p for p in reversed(e.parts) if isinstance(p, Element)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            p = stack.pop()
            if isinstance(p, str):
                out.append(p)
            elif p.tag not in ("script", "style"):
                out.append(" ")
                stack += [*reversed(p.parts)]
        return " ".join("".join(out).split())

    def classes(self) -> str:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".lower()

    def within(self, tags: frozenset[str]) -> bool:
        e: Element | None = self
        while e is not None and e.tag not in tags:
            e = e.parent
        return e is not None


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def tree(html: str | None) -> Element:
    """The page as a tree; what is left open ends with the page."""
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def mail_in(e: Element) -> str:
    """The first address of a mail link, or in the text, in lower case; empty if there is none."""
    for a in e.walk():
        if a.tag == "a" and a.attrs.get("href", "").lower().startswith("mailto:"):
            return a.attrs["href"][7:].split("?")[0].strip().lower()
    m = re.search(ADDRESS, e.text())
    return m.group().lower() if m else ""


def profile_in(e: Element, url: str, name: str = "") -> str:
    """The address of a person's page: the link with the name, else the first whose path says so; empty if there is none."""
    links = [a for a in e.walk() if a.tag == "a" and a.attrs.get("href") and not a.attrs["href"].lower().startswith(("#", "mailto:", "tel:", "javascript:"))]
    for a in links:
        if name and name in a.text():
            return urljoin(url, a.attrs["href"])
    for a in links:
        if any(w in urlsplit(a.attrs["href"]).path.lower() for w in PROFILE_PATHS):
            return urljoin(url, a.attrs["href"])
    return ""


def _person_in(e: Element) -> str:
    """The first heading, link or strong text that looks like a person."""
    for tags in (_HEADINGS, {"a"}, {"strong", "b"}, {"span", "p", "div", "td"}):
        for x in e.walk():
            if x.tag in tags and x is not e and looks_like_person(t := x.text()):
                return t
    return ""


def _post_in(e: Element, name: str) -> str:
    """The first text of a leaf that names a post and isn't the name."""
    for x in e.walk():
        if not any(isinstance(p, Element) and p.tag not in ("a", "b", "strong", "em", "i", "span", "br") for p in x.parts):
            t = x.text()
            rest = t.removeprefix(name).lstrip(" ,–—-|")
            if t and t != name and rest and looks_like_post(rest):
                return rest
    return ""




def _cards(page: list[Element], url: str) -> Iterator[tuple[Element, str, str, str, str]]:
    is_card = lambda e: e.tag in _CARDS and any(w in e.classes() for w in _CARD_WORDS) and not any(w in e.classes() for w in _OTHER_WORDS)
    for e in page:
        if is_card(e) and not e.within(_SKIPPED) and not any(x is not e and is_card(x) and _person_in(x) for x in e.walk()):
            name = _person_in(e)
            if name and (title := _post_in(e, name)):
                yield e, name, title, profile_in(e, url, name), mail_in(e)


def _accordions(page: list[Element], url: str) -> Iterator[tuple[Element, str, str, str, str]]:
    by_id = {e.attrs["id"]: e for e in page if e.attrs.get("id")}
    for e in page:
        panel = None
        if e.tag == "summary" and e.parent is not None and e.parent.tag == "details":
            panel = e.parent
        elif e.tag in ("button", "a") and (target := e.attrs.get("aria-controls") or e.attrs.get("data-target", "").lstrip("#")):
            panel = by_id.get(target)
        if panel is not None and looks_like_person(name := e.text()):
            if title := _post_in(panel, name):
                yield e, name, title, profile_in(panel, url, name), mail_in(panel)


def _teasers(page: list[Element], url: str) -> Iterator[tuple[Element, str, str, str, str]]:
    for e in page:
        if e.tag == "a" and e.attrs.get("href") and any(x.tag in _HEADINGS | {"strong", "p", "div"} for x in e.walk() if x is not e):
            name = _person_in(e)
            if name and (title := _post_in(e, name)):
                yield e, name, title, urljoin(url, e.attrs["href"]), mail_in(e)


def _split_names(page: list[Element], url: str) -> Iterator[tuple[Element, str, str, str, str]]:
    columns: dict[str, int] = {}
    for row in (e for e in page if e.tag == "tr"):
        cells = [c for c in row.walk() if c.tag in ("td", "th")]
        labels = [c.text().casefold().strip(" :") for c in cells]
        if any(x in _FIRST for x in labels) and any(x in _LAST for x in labels):
            columns = {"first": next(i for i, x in enumerate(labels) if x in _FIRST), "last": next(i for i, x in enumerate(labels) if x in _LAST)}
        elif columns and len(cells) > max(columns.values()):
            name = f"{cells[columns['first']].text()} {cells[columns['last']].text()}"
            title = next((c.text() for i, c in enumerate(cells) if i not in columns.values() and looks_like_post(c.text())), "")
            if looks_like_person(name):
                yield row, name, title, profile_in(row, url), mail_in(row)


def _single_cells(page: list[Element], url: str) -> Iterator[tuple[Element, str, str, str, str]]:
    for row in (e for e in page if e.tag == "tr"):
        cells = [c for c in row.walk() if c.tag == "td"]
        if len(cells) == 1:
            name, _, title = cells[0].text().partition(", ")
            title = re.sub(rf"[\s,;]*(?:{ADDRESS}|\+?\d[\d ()/-]{{5,}}).*$", "", title)
            if looks_like_person(name) and looks_like_post(title):
                yield row, name, title, profile_in(row, url, name), mail_in(row)


def _in_scripts(page: list[Element], url: str) -> Iterator[tuple[Element, str, str, str, str]]:
    def objects(x: object) -> Iterator[dict]:
        stack = [x]
        while stack:
            v = stack.pop()
            if isinstance(v, dict):
                yield v
                stack += [*reversed(v.values())]
            elif isinstance(v, list):
                stack += [*reversed(v)]

    first = lambda d, keys: next((str(d[k]).strip() for k in keys if d.get(k) and not isinstance(d[k], dict | list)), "")
    decoder = json.JSONDecoder()
    for e in page:
        if e.tag != "script":
            continue
        code = "".join(p for p in e.parts if isinstance(p, str))
        at = 0
        while m := re.compile(r"[\[{]\s*[\[{\"]").search(code, at):
            try:
                data, at = decoder.raw_decode(code, m.start())
            except ValueError:
                at = m.start() + 1
                continue
            for d in objects(data):
                name, title = first(d, _JSON_NAME), first(d, _JSON_TITLE)
                if looks_like_person(name) and looks_like_post(title):
                    link = first(d, _JSON_URL)
                    yield e, name, title, urljoin(url, link) if link else "", first(d, _JSON_MAIL).removeprefix("mailto:").lower()


def _links(page: list[Element], url: str, least: int) -> Iterator[tuple[Element, str, str, str, str]]:
    """Links to people's pages; with ``least`` only those under a folder that so many of them share."""
    found = []
    for e in page:
        href = e.attrs.get("href", "") if e.tag == "a" else ""
        if href and not e.within(_SKIPPED) and any(w in urlsplit(href).path.lower() for w in PROFILE_PATHS):
            label = e.text()
            name, _, title = label.partition(", ")
            if looks_like_person(name) and (not title or looks_like_post(title)):
                target = urljoin(url, href)
                found.append((target.rsplit("/", 1)[0].split("?")[0], e, name, title, target))
    folders = [f[0] for f in found]
    for folder, e, name, title, target in found:
        if folders.count(folder) >= least:
            near = e.parent if e.parent is not None and len(e.parent.text()) < 400 else e
            yield e, name, title or _post_in(near, name), target, mail_in(near)


#: The ways people are found, the more certain first; the last takes any link to a person's page.
WAYS = ("cards", "accordion", "teasers", "split", "cell", "script", "repeated", "links")


def people_in(html: str | None, url: str) -> list[tuple[str, int, str, str, str, str, str]]:
    """(way, place, name, title, profile address, mail, section) of everyone found, by every way; a missing title is empty."""
    page = list(tree(html).walk())
    ways = {
        "cards": _cards(page, url), "accordion": _accordions(page, url), "teasers": _teasers(page, url), "split": _split_names(page, url), "cell": _single_cells(page, url),
        "script": _in_scripts(page, url), "repeated": _links(page, url, 2), "links": _links(page, url, 1),
    }
    places = {id(e): i for i, e in enumerate(page)}
    headings = [(places[id(x)], t) for x in page if x.tag in ("h2", "h3", "h4") and (t := x.text()) and not looks_like_person(t)]
    section = lambda e: next((t for i, t in reversed(headings) if i < places[id(e)]), "")
    return [(way, n, name, title, link, mail, section(e)) for way, found in ways.items() for n, (e, name, title, link, mail) in enumerate(found)]


_ROWS = T.ArrayType(T.StructType([T.StructField("way", T.StringType()), T.StructField("place", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("name", "title", "profile_url", "email", "section"))]))


@F.pandas_udf(_ROWS)
def _people(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for html, url in batches:
        yield pd.Series([people_in(h, u or "") for h, u in zip(html, url, strict=True)])


def card_people(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "final_url") -> DataFrame:
    """``page_id, way, place, name, title, profile_url, email, section``; null or empty markup gives no rows.

    A person whose title isn't there comes out with an empty one, to be looked up later. Repeated pages give repeated rows.
    """
    return pages.select(F.col(id_col).alias("page_id"), F.explode(_people(html_col, url_col)).alias("p")).select("page_id", "p.*")


def best_way(found: DataFrame, least: int = 2) -> DataFrame:
    """Per page the people of the most certain way that has ``least`` of them with a title, else of the first that has any.

    One aggregation over (page, way) counts, joined back to the rows; a page's rows never have to stand in one task.
    """
    rank = F.array_position(F.array(*map(F.lit, WAYS)), F.col("way"))
    counts = found.groupBy("page_id", rank.alias("rank")).agg(F.count_if(F.col("title") != "").alias("n"))
    best = counts.groupBy("page_id").agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("rank"))), F.min("rank")).alias("rank"))
    return found.withColumn("rank", rank).join(best, ["page_id", "rank"]).drop("rank")
