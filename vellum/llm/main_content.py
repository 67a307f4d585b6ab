"""The main body of web pages, by composite text density.

For every DOM node the characters per tag are computed, adjusted for the characters and tags inside links; a node's sum is
that of its children's densities. The subtree with the greatest sum is the core of the body; on the path from there towards
``<body>``, the highest element that is at least as dense as the core takes its place. The page's top heading then joins: the
smallest element below ``<body>`` that has both, or the heading alone where there is none. Blocks of links inside are cut away again, and labels for sharing, printing and the like go by their
wording. A page whose whole body is an error message, a notice or filler has no body.

The tree exists only inside an Arrow batch in Python; pages never meet each other, so nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.residue import ERRORS, FILLER, FILLER_LEAST, FILLER_ONLY_LEAST, FILLER_ONLY_WORD, FILLER_SHARE, FILLER_WORD, NOTICES, REFERENCE

_TOKEN = re.compile(r"<!--.*?-->|<(script|style|template)\b.*?</\1\s*>|<![^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i img input ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Tags that end an open one of the same kind, and how far up that may reach.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "p": ({"p"}, {"div", "td", "li", "main", "section", "article", "aside"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"})}
_FRAME_TAGS = frozenset("nav header footer aside form button noscript dialog select".split())
_SPACE = re.compile(r"\s+")

# Labels that belong to the frame wherever they stand, as whole lines, in the seven languages of the pages.
LABELS = re.compile(
    r"(?i)(?:(?:share|e-?mail|print|save|bookmark|cite|download)(?: this)?(?: page| article| profile)?|share on .{0,30}|search(?: this site| the site)?|(?:last )?(?:updated|modified|changed)(?: on)?|skip to (?:main )?(?:content|navigation)|(?:back )?to top|top of page|print(?:able)? (?:version|view)"
    r"|(?:seite )?(?:teilen|drucken|empfehlen)|suche|letzte änderung|zuletzt (?:geändert|aktualisiert)|(?:zum|zur) (?:inhalt|navigation)(?: springen)?|nach oben|seitenanfang"
    r"|(?:partager|imprimer|rechercher)(?: (?:cette page|la page|sur le site))?|mis à jour le|dernière (?:mise à jour|modification)|aller au contenu|haut de (?:la )?page|retour en haut"
    r"|(?:compartir|imprimir|buscar)(?: (?:esta página|en el sitio))?|última (?:actualización|modificación)|(?:ir|saltar) al contenido|volver arriba"
    r"|поделиться|печать|версия для печати|поиск(?: по сайту)?|(?:обновлено|последнее обновление)|(?:к|перейти к) содержанию|наверх"
    r"|分享(?:到.{0,6})?|打印(?:本页)?|(?:站内)?搜索|(?:更新时间|最后更新)|跳(?:到|至|转到)正文|返回顶部|回到顶部"
    r"|(?:このページを)?共有(?:する)?|印刷(?:する)?|(?:サイト内)?検索|最終更新(?:日)?|本文へ(?:移動|スキップ)?|(?:ページ上部|ページトップ|トップ)へ(?:戻る)?)"
    r"[\s:：.…]*(?:\d[\d.:/ -]*)?"
)


def _python(pattern: str) -> re.Pattern[str]:
    """A JVM pattern of ``residue`` for Python: script classes are spelled out."""
    for name, chars in ((r"\p{IsHan}", "一-龥"), (r"\p{IsHiragana}", "ぁ-ん"), (r"\p{IsKatakana}", "ァ-ヶ"), (r"[\p{L}]", r"[^\W\d_]"), (r"[\p{L}-]", r"(?:[^\W\d_]|-)"), (r"[\p{L} ]", r"(?:[^\W\d_]| )"), (r"\p{Zs}", r" ")):
        pattern = pattern.replace(name, chars)
    return re.compile(pattern.replace(r"[\p{L}]*error", r"\w*error").replace(r"\p{L}", "a-zà-öø-ÿ").replace("(?ium)", "(?im)"))


_RESIDUE = [_python(p) for p in (ERRORS, NOTICES, FILLER, REFERENCE)]


_FILLER_ONLY_WORD, _FILLER_WORD, _ANY_WORD = (re.compile(p, re.I) for p in (FILLER_ONLY_WORD, FILLER_WORD, r"[^\W\d_]+"))


def _dummy_copy(line: str) -> bool:
    """Most words of the line, and of each of its sentences, are those of dummy copy."""
    if len(_FILLER_ONLY_WORD.findall(line)) < FILLER_ONLY_LEAST or len(_FILLER_WORD.findall(line)) < FILLER_LEAST:
        return False
    return all(len(_FILLER_WORD.findall(s)) >= FILLER_SHARE * len(_ANY_WORD.findall(s)) for s in re.split(r"(?<=[.!?。！？…])\s+", line))


def is_residue(line: str) -> bool:
    """The whole line is an error message, a notice, filler or a bare reference number."""
    return any(p.match(line) for p in _RESIDUE) or _dummy_copy(line)


class Node:
    """An element with what the densities need: characters, tags, and those of them inside links."""

    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "first", "last")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.first = self.last = 0  # blocks [first, last) lie inside


def parse(html: str) -> tuple[Node, list[tuple[str, Node]]]:
    """The tree and its blocks: pieces of text between block tags, in page order, each with the element it stands in."""
    root = node = Node("body", None)
    blocks: list[tuple[str, Node]] = []
    text: list[str] = []
    holder: Node | None = None
    links = 0
    head = html.lower().find("<body")
    blocks_append = blocks.append

    def flush() -> None:
        nonlocal holder
        if text:
            line = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if line:
                blocks_append((line, holder))
        holder = None

    for m in _TOKEN.finditer(html, max(head, 0)):
        raw = m.group(5)
        if raw is not None:
            text.append(raw)
            n = len(raw.strip())
            if n:
                if holder is None:
                    holder = node
                    while holder.tag in _INLINE and holder.parent:
                        holder = holder.parent
                node.chars += n
                if links:
                    node.link_chars += n
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "body" or tag == "html":
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
        if m.group(2):
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                while node is not up:
                    node.last = len(blocks)
                    links -= node.tag == "a"
                    node = node.parent
                node.last = len(blocks)
                links -= node.tag == "a"
                node = node.parent
            continue
        if tag in _VOID or m.group(4).endswith("/"):
            node.tags += 1
            continue
        if tag in _CLOSES:
            same, stop = _CLOSES[tag]
            up = node
            while up is not root and up.tag not in stop and up.tag not in same:
                up = up.parent
            if up.tag in same:
                while node is not up.parent:
                    node.last = len(blocks)
                    links -= node.tag == "a"
                    node = node.parent
        child = Node(tag, node)
        child.first = len(blocks)
        node.children.append(child)
        node.tags += 1
        if tag == "a":
            links += 1
            node.link_tags += 1
        node = child
    flush()
    while node is not root:
        node.last = len(blocks)
        node = node.parent
    root.last = len(blocks)
    return root, blocks


def densities(root: Node) -> list[Node]:
    """Fill in densities and sums for every node, bottom up; returns the nodes in page order."""
    order = [root]
    for node in order:
        order.extend(node.children)
    for node in reversed(order):
        for c in node.children:
            node.chars += c.chars
            node.tags += c.tags
            node.link_chars += c.link_chars
            node.link_tags += c.link_tags
    page_ratio = root.link_chars / max(root.chars, 1)
    for node in order:
        chars, link = node.chars, node.link_chars
        if not chars:
            continue
        plain = max(chars - link, 1)
        base = math.log(chars / plain * link + page_ratio * chars + math.e)
        adjusted = chars / max(link, 1) * (max(node.tags, 1) / max(node.link_tags, 1))
        node.density = chars / max(node.tags, 1) * math.log(max(adjusted, 1.0)) / base if adjusted > 1 else 0.0
    for node in order:
        node.total = sum(c.density for c in node.children) or (node.density if not node.children else 0.0)
    return order


def _frame(node: Node) -> bool:
    up: Node | None = node
    while up is not None:
        if up.tag in _FRAME_TAGS:
            return True
        up = up.parent
    return False


def _link_block(node: Node) -> bool:
    return node.tag not in _INLINE and node.tag not in ("h1", "p", "li", "td", "dd") and node.link_chars > 0.5 * node.chars


#: The branch with the top heading has the core if its greatest sum is at least this share of the page's greatest; it may be short.
HEADING_SHARE = 0.1
# Tags that hold text themselves, for pages whose text stands right below <body>.
_TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p ul ol dl table tbody tr pre blockquote figure address dd dt li td th".split())


def _branch(node: Node, root: Node) -> Node:
    """The child of the root that ``node`` is in."""
    while node.parent is not root and node.parent is not None:
        node = node.parent
    return node


def select_body(root: Node, order: list[Node], blocks: list[tuple[str, Node]]) -> list[Node]:
    """The elements that hold the page's body, in page order."""
    heads = [n for n in order if n.tag == "h1" and not _frame(n)]
    candidates = [n for n in order if n is not root and n.tag not in _INLINE and not _frame(n)]
    if not heads and (residue := [b for b in blocks if is_residue(b[0]) and not _frame(b[1])]):
        candidates = [n for n in candidates if n.first <= blocks.index(residue[0]) < n.last] or candidates
    if not candidates:
        return [root]
    core = max(candidates, key=lambda n: n.total)
    head = heads[0] if heads else None
    if head is not None and head.parent is not root:
        beside = [n for n in candidates if _branch(n, root) is _branch(head, root)]
        if beside and max(n.total for n in beside) >= HEADING_SHARE * core.total:
            core = max(beside, key=lambda n: n.total)
    body, up = core, core.parent
    while up is not None and up is not root:  # the path's threshold
        if up.density >= (core.density if head is not None else root.density):
            body = up
        up = up.parent
    if head is None or body.first <= head.first < body.last:
        return [body]
    up = body
    while up is not root and not up.first <= head.first < up.last:
        up = up.parent
    if up is not root:
        return [up]
    if _branch(body, root).tag in _TEXT_TAGS:  # the text stands right below <body>: what follows the heading there
        return [n for n in root.children if n.first >= head.first and n.tag in _TEXT_TAGS]
    return sorted([body, head], key=lambda n: n.first)


def body_blocks(html: str) -> tuple[list[str], list[bool]]:
    """All blocks of the page, and which of them belong to its body."""
    root, blocks = parse(html)
    order = densities(root)
    keep = [False] * len(blocks)
    stack = []
    for body in select_body(root, order, blocks):
        keep[body.first : body.last] = [True] * (body.last - body.first)
        stack += body.children
    while stack:
        n = stack.pop()
        if n.tag in _FRAME_TAGS or _link_block(n):
            keep[n.first : n.last] = [False] * (n.last - n.first)
        else:
            stack.extend(n.children)
    heading = {n.first for n in order if n.tag == "h1"}
    for i, (line, holder) in enumerate(blocks):
        if keep[i] and LABELS.fullmatch(line):
            keep[i] = False
    rest = [line for i, (line, _) in enumerate(blocks) if keep[i] and i not in heading]
    lead = [line for i, (line, _) in enumerate(blocks) if keep[i] and i in heading]
    if (rest or lead) and all(map(is_residue, rest)) and (rest or all(map(is_residue, lead))):
        keep = [False] * len(blocks)
    return [line for line, _ in blocks], keep


def body_lines(html: str | None, text: str | None) -> list[int]:
    """Numbers, from 1, of the lines of ``text`` that belong to the body of ``html``.

    Blocks and lines are matched in order; a line that no block has takes the side of the line before it. Null or empty
    html or text has no body.
    """
    if not html or not text:
        return []
    blocks, keep = body_blocks(html)
    out: list[int] = []
    at, side = 0, False
    where: dict[str, list[int]] | None = None
    for no, line in enumerate(text.split("\n"), 1):
        line = _SPACE.sub(" ", line).strip()
        if not line:
            continue
        if at < len(blocks) and blocks[at] == line:
            side = keep[at]
            at += 1
        else:
            if where is None:
                where = {}
                for i, b in enumerate(blocks):
                    where.setdefault(b, []).append(i)
            later = [i for i in where.get(line, ()) if i >= at]
            if later:
                at = later[0] + 1
                side = keep[later[0]]
        if side:
            out.append(no)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _numbers(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for html, text in batches:
        yield pd.Series([body_lines(h, t) for h, t in zip(html, text, strict=True)])


def main_lines(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``page_id, line_no`` for every non-blank line of the text that belongs to the page's body."""
    rows = pages.where(F.length(html_col) > 0).where(F.length(text_col) > 0)
    return rows.select(F.col(id_col).alias("page_id"), F.explode(_numbers(F.col(html_col), F.col(text_col))).alias("line_no"))


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``page_id, body``: the body's lines in order, one per line; empty where a page has no body."""
    texts = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), texts.alias("_t"), F.split(texts, "\n", -1).alias("_lines"), F.coalesce(F.col(html_col), F.lit("")).alias("_h"))
    rows = rows.withColumn("_n", _numbers(F.col("_h"), F.col("_t")))
    return rows.select("page_id", F.array_join(F.transform("_n", lambda i: F.get("_lines", i - 1)), "\n").alias("body"))
