"""People on directory pages, by several strategies run over the same tree, and the cascade that chooses among them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vellum.functions.emails import ADDRESS
from vellum.functions.urls import page_key

_SKIP = frozenset("script style noscript nav footer header form".split())
_WORDS = r"[^\W\d_][\w'’.-]*"
_PERSON = re.compile(rf"^(?:(?:Prof|Dr|Mr|Mrs|Ms)\.?\s+)*{_WORDS}(?:\s+{_WORDS}){{1,5}}$", re.U)
# Words that occur in names of posts and not in names of people.
_POST = re.compile(r"(?i)\b(?:prof(?:essor\w*)?|lecturer|reader|fellow|research\w*|scientist|instructor|dean|chair|librarian|manager|dozent\w*|mitarbeiter\w*|rat|lehrkraft|ma[iî]tre|charg[ée]e?|direct(?:eur|rice)|ing[ée]nieure?|catedr[áa]tic[oa]|titular|ayudante|investigador[a]?|docente?|доцент|профессор|преподаватель|сотрудник|öğretim)\b|教授|讲师|研究员|助教|フェロー|교수|أستاذ")
# Headers of table columns.
_HEADERS = {"name": ("name", "nom", "nombre", "имя", "姓名", "氏名"), "title": ("title", "position", "role", "titel", "funktion", "fonction", "cargo", "должность", "职称", "職名"), "email": ("email", "e-mail", "mail", "courriel", "correo", "почта", "邮箱")}


def looks_like_person(text: str) -> bool:
    """Two to six words that start like a name and don't name a post."""
    return bool(_PERSON.match(text)) and len(text) <= 80 and not _POST.search(text) and sum(w[:1].isupper() for w in text.split()) >= 2


def looks_like_post(text: str) -> bool:
    return bool(_POST.search(text)) and len(text) <= 140 and "@" not in text


class _Events(HTMLParser):
    """The page as a flat list of (kind, text, href): headings, items, cells, paragraphs and links, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip = 0
        self.events: list[tuple[str, str, str]] = []
        self.rows: list[list[tuple[str, str, bool]]] = []
        self.stack: list[tuple[str, list[str], list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.skip += tag in _SKIP
        if tag == "tr":
            self.rows.append([])
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "td", "th", "dd", "dt", "div"):
            self.stack.append((tag, [], []))
        elif tag == "a" and self.stack and not self.skip:
            self.stack[-1][2].append(dict(attrs).get("href") or "")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        if any(t == tag for t, _, _ in self.stack):
            while self.stack:
                t, text, hrefs = self.stack.pop()
                line = " ".join("".join(text).split())
                href = hrefs[0] if hrefs else ""
                if line or hrefs:
                    self.events.append((t, line, href))
                if t in ("td", "th") and self.rows:
                    self.rows[-1].append((line, href, t == "th"))
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.stack and not self.skip:
            self.stack[-1][1].append(data)


def _mail(text: str, href: str) -> str:
    if href.lower().startswith("mailto:"):
        return href[7:].split("?")[0].strip().lower()
    m = re.search(ADDRESS, text)
    return m.group().lower() if m else ""


def people_on(html: str | None, url: str) -> list[tuple[str, int, str, str, str, str]]:
    """(strategy, ordinal, name, title, profile address, mail) of everything that looks like a listed person."""
    page = _Events()
    page.feed(html or "")
    page.close()
    out: list[tuple[str, int, str, str, str, str]] = []
    link = lambda h: urljoin(url, h) if h and not h.startswith(("#", "mailto:", "javascript:")) else ""
    head: dict[str, int] = {}
    for cells in page.rows:  # tables with headers, and rows whose first cells are a person and a post
        labels = [c[0].casefold().strip(" :") for c in cells]
        if any(c[2] for c in cells) and any(x in _HEADERS["name"] for x in labels):
            head = {k: i for k, names in _HEADERS.items() for i, x in enumerate(labels) if x in names}
        elif cells and head and len(cells) > max(head.values()):
            name = cells[head["name"]]
            if looks_like_person(name[0]):
                title = cells[head["title"]][0] if "title" in head else ""
                out.append(("table", len(out), name[0], title, link(name[1]), next((m for c in cells if (m := _mail(c[0], c[1]))), "")))
        elif len(cells) > 1 and looks_like_person(cells[0][0]):
            title = next((c[0] for c in cells[1:] if looks_like_post(c[0])), "")
            if title:
                out.append(("row", len(out), cells[0][0], title, link(cells[0][1]), next((m for c in cells if (m := _mail(c[0], c[1]))), "")))
    events = page.events
    for i, (tag, text, href) in enumerate(events):
        if tag in ("li", "p", "dd", "div") and ", " in text:
            name, _, title = text.partition(", ")
            if looks_like_person(name) and looks_like_post(title):
                out.append(("listed", len(out), name, re.sub(rf"\s*{ADDRESS}.*$", "", title), link(href), _mail(text, href)))
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "dt") and looks_like_person(text):
            following = []
            for t, x, h in events[i + 1 : i + 8]:
                if t in ("h1", "h2", "h3", "dt"):
                    break
                following.append((x, h))
            title = next((x for x, _ in following if looks_like_post(x)), "")
            if title:
                out.append(("profile" if tag == "h1" else "card", len(out), text, title, link(href), next((m for x, h in following if (m := _mail(x, h))), "")))
    return out


_ROWS = T.ArrayType(T.StructType([T.StructField("strategy", T.StringType()), T.StructField("ordinal", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("name", "title", "profile_url", "email"))]))


@F.pandas_udf(_ROWS)
def _people(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for html, url in batches:
        yield pd.Series([people_on(h, u or "") for h, u in zip(html, url, strict=True)])


#: Strategies, the more certain first.
STRATEGIES = ("table", "row", "card", "listed", "profile")


def page_people(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "final_url") -> DataFrame:
    """``page_id, strategy, ordinal, name, title, profile_url, email`` of all strategies; null or empty markup gives no rows."""
    return pages.select(F.col(id_col).alias("page_id"), F.explode(_people(html_col, url_col)).alias("p")).select("page_id", "p.*")


def chosen_people(found: DataFrame, least: int = 2) -> DataFrame:
    """Per page the people of the first strategy that has ``least`` of them, or one for ``profile``; the first of equal ones."""
    w = Window.partitionBy("page_id")
    rank = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    counted = found.withColumn("n", F.count("*").over(Window.partitionBy("page_id", "strategy"))).withColumn("rank", rank)
    fit = counted.where((F.col("n") >= least) | (F.col("strategy") == "profile"))
    best = fit.withColumn("first", F.min("rank").over(w)).where("rank = first")
    key = F.when(F.col("profile_url") != "", page_key(F.col("profile_url"))).otherwise(F.concat_ws("|", F.lower("name"), F.lower("title")))
    return best.groupBy("page_id", "strategy", key.alias("k")).agg(F.min_by(F.struct("ordinal", "name", "title", "profile_url", "email"), "ordinal").alias("r")).select("page_id", "strategy", "r.*")


def next_page(html: str | None, url: str) -> str:
    """Address of the next page of a listing: a link marked as next or labelled so, on the same host and path; else empty."""
    for attrs, label in re.findall(r"<a\b([^>]*)>(.*?)</a>", html or "", re.S | re.I):
        href = re.search(r"""href\s*=\s*["']([^"']+)""", attrs)
        text = re.sub(r"<[^>]+>", "", label).strip().casefold()
        if href and (re.search(r"""rel\s*=\s*["']?next""", attrs, re.I) or text in ("next", "next page", "weiter", "suivant", "siguiente", "próxima", "далее", "下一页", "次へ", "›", "»", ">")):
            target = urljoin(url, href.group(1))
            if target.split("?")[0].split("#")[0] == url.split("?")[0].split("#")[0] and target != url:
                return target
    return ""
