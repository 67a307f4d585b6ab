"""Text read in the wrong character encoding: finding it, and restoring what can be restored.

For every pair of encodings the garbled form of each expected character is computed beforehand, and one automaton finds
all of them in a text at once. Only matched spans are replaced, so correct text around them stays as it is. Characters of
single-byte and double-byte encodings have no distinctive form of their own; runs of them are decoded as a whole and
accepted when the result is ordinary text of one script. Rows without any suspicious character never leave the JVM.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.skew import spread_join
from vellum.session import cut_lineage

#: Encodings in which UTF-8 bytes were read by mistake. Bytes that an encoding leaves undefined stay as control characters.
WRONG_READERS = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp850", "cp437", "cp1254", "cp1250", "cp866", "koi8_r", "iso8859_15", "iso8859_2")
#: Encodings in which a text was written, when it was then read as Latin-1 or Windows-1252.
LEGACY_WRITERS = ("gbk", "shift_jis", "euc_jp", "euc_kr", "cp1251", "cp1256", "koi8_r", "cp1253", "big5", "cp874")
#: Encodings in which Latin text of Windows-1252 was read, which leaves letters that can't stand where they do.
LATIN_READERS = ("cp1251", "mac_roman", "cp850")

# The characters expected in correct text, as code point ranges.
EXPECTED_RANGES = (
    (0x0080, 0x017F), (0x0192, 0x0192), (0x0218, 0x021B), (0x02C6, 0x02C6), (0x02DC, 0x02DC), (0x0386, 0x03CE), (0x0401, 0x0401), (0x0410, 0x044F), (0x0451, 0x0451),
    (0x0404, 0x0407), (0x0454, 0x0457), (0x0490, 0x0491), (0x060C, 0x060C), (0x061B, 0x061B), (0x061F, 0x061F),
    (0x0621, 0x064A), (0x0E01, 0x0E5B), (0x1EA0, 0x1EF9), (0x2010, 0x2026), (0x2030, 0x2030), (0x2039, 0x203A),
    (0x20AC, 0x20AC), (0x2116, 0x2116), (0x2122, 0x2122), (0x3000, 0x3011), (0x3041, 0x30FC), (0x4E00, 0x9FA5),
    (0xAC00, 0xD7A3), (0xFF01, 0xFF5E), (0x0531, 0x0587), (0x05B0, 0x05EA), (0x0900, 0x0DFF), (0x10A0, 0x10FF), (0x1F300, 0x1FAFF), (0x20000, 0x2A6DF),
)


def _expected(ch: str) -> bool:
    o = ord(ch)
    return any(a <= o <= b for a, b in EXPECTED_RANGES)


@lru_cache
def _byte_table(encoding: str) -> tuple[str, ...]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache
def _reverse_table(encoding: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_byte_table(encoding))))}


@lru_cache
def _western_bytes() -> dict[str, int]:
    """Characters of Latin-1 and Windows-1252 to their byte."""
    return {chr(b): b for b in range(256)} | {c: b for c, b in _reverse_table("cp1252").items() if ord(c) > 255}


@lru_cache
def _automaton():  # noqa: ANN202
    """Garbled forms of all expected characters for all readers; of three-byte forms the first two characters."""
    import ahocorasick

    forms: dict[str, set[tuple[str, int]]] = {}
    for reader in WRONG_READERS:
        table = _byte_table(reader)
        for a, b in EXPECTED_RANGES:
            for o in range(a, b + 1):
                raw = chr(o).encode()
                forms.setdefault(table[raw[0]] + table[raw[1]], set()).add((reader, len(raw)))
    auto = ahocorasick.Automaton()
    for form, readers in forms.items():
        auto.add_word(form, tuple(sorted(readers, key=lambda x: (WRONG_READERS.index(x[0]), x[1]))))
    auto.make_automaton()
    return auto


# Characters that ordinarily stand before others, so that one such pair alone proves nothing.
_WEAK_LEADS = set("РСВ—–„‚“”’‘…»«ÐðÑÎÏ─╬╧ß▀ÉÈÊËÌÍÓÒÔÕÖØÙÇÆ")


#: Readers whose garbled forms may consist of nothing but Cyrillic letters; such a stretch is taken for words unless small letters stand before capitals.
_CYRILLIC_READERS = ("cp866", "koi8_r")
_CYRILLIC_ONLY, _ODD_CASE = re.compile(r"[А-яЁё]+"), re.compile(r"[а-яё][А-ЯЁ]")


def _form_at(text: str, at: int, reader: str) -> tuple[int, str] | None:
    """Width and character of the garbled form that starts at ``at``, if there is one for this reader."""
    back = _reverse_table(reader)
    lead = back.get(text[at], 0)
    width = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    piece = text[at : at + width]
    if not width or len(piece) < width:
        return None
    try:
        ch = bytes(back[c] for c in piece).decode()
    except (KeyError, UnicodeDecodeError, ValueError):
        return None
    return (width, ch) if _expected(ch) else None


def _utf8_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, reader, character) of every garbled form, leftmost first, without overlaps.

    Of the readers that explain a form, the one that explains the longest stretch from there on takes all of it.
    """
    hits: list[tuple[int, int, str, str]] = []
    free = 0
    for last, readers in _automaton().iter(text):
        start = last - 1
        if start < free:
            continue
        best: list[tuple[int, int, str, str]] = []
        for reader in dict.fromkeys(r for r, _ in readers):
            chain, at = [], start
            while at < len(text) and (form := _form_at(text, at, reader)):
                chain.append((at, at + form[0], reader, form[1]))
                at += form[0]
            if reader in _CYRILLIC_READERS and chain and all(_CYRILLIC_ONLY.fullmatch(text, *x[:2]) for x in chain):
                if not any(x[1] - x[0] == 4 for x in chain) and len(_ODD_CASE.findall(text, start, at)) < 2:
                    continue
            if chain and (not best or at > best[-1][1]):
                best = chain
        if best:
            hits += best
            free = best[-1][1]
    return hits


def _trusted(text: str, hits: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Drop what may be ordinary text: a lone weak pair, or letters in the middle of a word of such letters."""
    starts, ends = {h[0] for h in hits}, {h[1] for h in hits}
    out = []
    for start, end, reader, ch in hits:
        joined = start in ends or end in starts
        if not joined and end - start == 2 and text[start] in _WEAK_LEADS:
            continue
        around = (text[start - 1] if start and start not in ends else "") + (text[end] if end < len(text) and end not in starts else "")
        if "À" <= text[start] <= "ÿ" and any("à" <= c <= "ÿ" for c in around):
            continue
        out.append((start, end, reader, ch))
    return out


_RUN = re.compile(r"(?<![A-Za-zĀ-ɏ])[\u0080-ÿŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™](?:[ \x40-\x7e]?[\u0080-ÿŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™])+[\x40-\x7e]?")
_LETTERS3 = re.compile(r"(?<![A-Za-zĀ-ɏ])[À-ÿ]{3,}(?![A-Za-zĀ-ɏ])")


def _solid(m: re.Match[str]) -> bool:
    """Enough letters of Latin-1 in the run, which ordinary punctuation doesn't give, and no other script right before it."""
    before = m.string[m.start() - 1] if m.start() else " "
    return sum(1 for c in m.group() if "\u0080" <= c <= "ÿ" and c not in "«»\u00a0") >= 3 and before <= "\u02ff"


def _script(ch: str) -> str:
    o = ord(ch)
    for name, ranges in (("han", ((0x4E00, 0x9FA5),)), ("kana", ((0x3041, 0x30FC),)), ("hangul", ((0xAC00, 0xD7A3),)), ("cyrillic", ((0x410, 0x44F), (0x401, 0x401), (0x451, 0x451))), ("arabic", ((0x621, 0x64A),)), ("greek", ((0x386, 0x3CE),)), ("thai", ((0xE01, 0xE5B),))):
        if any(a <= o <= b for a, b in ranges):
            return name
    return "ascii" if o < 128 else "other"


def _common_han(ch: str) -> bool:
    """In the first level of GB 2312, the characters in everyday use."""
    try:
        raw = ch.encode("gb2312")
    except UnicodeEncodeError:
        return False
    return len(raw) == 2 and 0xB0 <= raw[0] <= 0xD7


def _common_traditional(ch: str) -> bool:
    """In the first level of Big5, the characters in everyday use."""
    try:
        raw = ch.encode("big5")
    except UnicodeEncodeError:
        return False
    return len(raw) == 2 and 0xA4 <= raw[0] <= 0xC6


@lru_cache(20_000)
def _legacy(run: str) -> str | None:
    """The run as text of a legacy encoding, if it is ordinary text of one script in it."""
    table = _western_bytes()
    try:
        raw = bytes(table[c] for c in run)
    except KeyError:
        return None
    best: tuple[float, str] | None = None
    for writer in LEGACY_WRITERS:
        try:
            out = raw.decode(writer)
        except UnicodeDecodeError:
            continue
        scripts = [_script(c) for c in out if not c.isspace()]
        n = len(scripts)
        wide = writer in ("gbk", "shift_jis", "euc_jp", "euc_kr", "big5")
        if wide:
            hangul, kana, han = (scripts.count(x) for x in ("hangul", "kana", "han"))
            common = sum(1 for c in out if (_common_traditional if writer == "big5" else _common_han)(c))
            good = max(hangul if writer == "euc_kr" else 0, kana + (common if writer != "euc_kr" else 0))
            if good < 2 or good < 0.75 * n or (writer == "euc_kr" and han):
                continue
            score = good / n + 0.1 * (writer == "gbk") - 0.05 * (writer == "big5") + 0.05 * (kana > 0 and writer != "gbk")
        else:
            letters = max(scripts.count(x) for x in ("cyrillic", "arabic", "greek", "thai"))
            words = [w for w in re.split(r"[\s\x00-\x40\[-`{-~]+", run) if w]
            if letters < 3 or letters < n - scripts.count("ascii") or not any(len(w) >= 3 for w in words):
                continue
            low = sum(c.islower() for c in out) / n
            cased = low if writer in ("cp1251", "koi8_r") else 0.45
            score = 0.3 + 0.5 * cased + (0.25 if writer == "cp1251" and (out.isupper() or out[0].isupper() or low > 0.6) else 0)
        if best is None or score > best[0]:
            best = (score, out)
    return best[1] if best else None


_HAN_RUN = re.compile(r"[¤§¨°±·×÷‐-㏿一-龥-︰-￥]{3,}")


def _read_as_gbk(run: str) -> str | None:
    """UTF-8 bytes that were read as GBK, if the whole run goes back."""
    for cut in (run, run[:-1]):
        if len(cut) < 2:
            break
        try:
            out = cut.encode("gb18030").decode("utf-8")
        except UnicodeError:
            continue
        if any(_script(c) in ("han", "kana", "hangul") for c in out) and all(_expected(c) for c in out) and len(out) < len(cut):
            return out + run[len(cut) :]
    return None


# How often each letter occurs in Russian, per thousand.
_RUSSIAN = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяё", (80, 16, 45, 17, 30, 85, 9, 16, 74, 12, 35, 44, 32, 67, 110, 28, 47, 55, 63, 26, 3, 10, 5, 14, 7, 4, 1, 19, 17, 3, 6, 20, 1), strict=True))
_CYRILLIC_WORDS = re.compile(r"[А-яЁё]{2,}(?:[. ]+[А-яЁё]{2,})*")


def _russian_score(text: str) -> float:
    letters = [c for c in text.lower() if c in _RUSSIAN]
    odd_case = sum(a.islower() and b.isupper() for a, b in zip(text, text[1:], strict=False))
    return sum(math.log(_RUSSIAN[c]) for c in letters) / max(len(letters), 1) - 1.5 * (odd_case > 0)


def _other_cyrillic(run: str) -> str | None:
    """Text of one Cyrillic encoding that was read in another, if it is clearly more like Russian that way."""
    if len(run) < 4:
        return None
    best, out = _russian_score(run) + 0.7, None
    for written, read in (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5")):
        try:
            back = run.encode(read).decode(written)
        except UnicodeError:
            continue
        if all(c in _RUSSIAN or c in ". " for c in back.lower()) and (score := _russian_score(back)) > best:
            best, out = score, back
    return out


# Letters of Cyrillic that look like no Latin one, letters of Latin that look like no Cyrillic one.
_ONLY_CYRILLIC = "бвгджзийлмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯђѓєљњќћўџґЂЃЄЉЊЌЋЎЏҐ"
_ONLY_LATIN = "dfgjlnqrstuvwzDFGLNQRSUVWZ"
#: Letters in Latin words that can't stand there: one of Cyrillic, or a capital with an accent between small letters.
_STRAY = re.compile(rf"(?<![^\W\d_])[A-Za-z]*[{_ONLY_CYRILLIC}][A-Za-z{_ONLY_CYRILLIC}]*(?![^\W\d_])|(?<![^\W\d_])[A-Za-zÀ-ÿ]*[a-z][À-ÞŒŸ][a-zÀ-ÿ]*(?![^\W\d_])")
# Accented letters of Western Europe, the more frequent first.
_BY_USE = "éèáóíñüöäçàêãõâôîúûùëïßåøæ"


def _latin_word(word: str) -> str | None:
    """A Latin word whose accented letters were read in another encoding, if every stray letter goes back to a common one."""
    strays = [c for i, c in enumerate(word) if c in _ONLY_CYRILLIC or ("À" <= c <= "Þ" or c in "ŒŸ") and i and word[i - 1].islower()]
    if sum(c in _ONLY_LATIN for c in word) < 2 or 3 * len(strays) > len(word):
        return None
    best, out = len(_BY_USE) * len(word), None
    for reader in LATIN_READERS:
        if (reader == "cp1251") != any(c in _ONLY_CYRILLIC for c in strays):
            continue
        try:
            back = {c: c.encode(reader).decode("cp1252") for c in strays}
        except UnicodeError:
            continue
        if any(c not in _BY_USE for c in back.values()):
            continue
        cost = sum(_BY_USE.index(back[c]) for c in strays)
        if cost < best:
            best, out = cost, "".join(back.get(c, c) for c in word)
    return out


# A question mark where a letter was lost. Addresses, whose query starts with one, are cut out beforehand.
_ADDRESS = re.compile(r"\S*(?:://|www\.|\?\w+=|\.\w+\?)\S*")
_LOST_LETTER = re.compile(r"(?:(?<=[^\W\d_])\?+(?=[^\W\d_A-Z])|(?<=[A-Z])\?+(?=[A-Z])|(?:^|(?<=[\s('\"’\[-]))\?+(?=[^\W\d_]))")
_ONLY_MARKS = re.compile(r"^[\s()/.,-]*\?[\s?()/.,-]*$", re.M)


def _lost(text: str, short: bool) -> bool:
    if "�" in text:
        return True
    if "?" not in text:
        return False
    bare = _ADDRESS.sub(" ", text)
    if _LOST_LETTER.search(bare):
        return True
    if short:
        return bool(_ONLY_MARKS.match(text) or re.search(r"\w\s+\?\s+\w|\w\?\?|[^\W\d_]{3}\?$", bare))
    return bool(re.search(r"(?m)^[\s()/.,-]*\?{2,}[\s?()/.,-]*$", bare))


def restore(text: str | None, short: bool = False) -> tuple[bool, str | None, bool]:
    """Whether ``text`` is garbled anywhere, the text as far as it can be restored, and whether characters are lost.

    ``short`` is for single values (titles), where a lone question mark between words also stands for a lost character.
    Null and empty text are not garbled and come back as they are.
    """
    if not text:
        return False, text, False
    lost = _lost(text, short)
    now = text
    seen = set()
    while now not in seen:  # text may have been misread more than once
        seen.add(now)
        before = now
        hits = _trusted(now, _utf8_spans(now))
        covered = {i for h in hits for i in range(h[0], h[1])}
        # a run that the garbled forms explain only in part, and a legacy encoding as a whole, is the latter's
        whole = [m for m in _RUN.finditer(now) if hits and _solid(m) and any(i not in covered and now[i] > "\x7f" for i in range(*m.span())) and _legacy(m.group())]
        if whole:
            for m in reversed(whole):
                now = now[: m.start()] + _legacy(m.group()) + now[m.end() :]
            continue
        if hits:
            parts, at = [], 0
            for start, end, _reader, ch in hits:
                parts += [now[at:start], ch]
                at = end
            now = "".join([*parts, now[at:]])
            continue
        now = _HAN_RUN.sub(lambda m: _read_as_gbk(m.group()) or m.group(), now)
        now = _CYRILLIC_WORDS.sub(lambda m: _other_cyrillic(m.group()) or m.group(), now)
        now = _RUN.sub(lambda m: (_solid(m) and _legacy(m.group())) or m.group(), now)
        now = _LETTERS3.sub(lambda m: _legacy(m.group()) or m.group(), now)
        now = _STRAY.sub(lambda m: _latin_word(m.group()) or m.group(), now)
        if now == before:
            break
    control = re.search(r"[\u0080-\u0084\u0086-\u009f]", text) is not None
    return now != text or lost or control, now, lost or (control and re.search(r"[\u0080-\u0084\u0086-\u009f]", now) is not None)


def _char_class(chars: set[str]) -> str:
    """A character class of the JVM's regular expressions with exactly these characters."""
    points, parts = sorted(map(ord, chars)), []
    for o in points:
        if parts and parts[-1][1] == o - 1:
            parts[-1][1] = o
        else:
            parts.append([o, o])
    return "[" + "".join(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if b > a else "") for a, b in parts) + "]"


def _form_pattern() -> str:
    """The garbled forms of all expected characters for all readers, from the same tables as the automaton."""
    cyrillic, others, starts = [], [], set()
    for reader in WRONG_READERS:
        table = _byte_table(reader)
        after: dict[tuple[int, str], set[str]] = {}
        for a, b in EXPECTED_RANGES:
            for o in range(a, b + 1):
                raw = chr(o).encode()
                after.setdefault((len(raw), table[raw[0]]), set()).add(table[raw[1]])
        leads: dict[tuple[int, str], set[str]] = {}
        for (width, lead), second in after.items():
            leads.setdefault((width, _char_class(second)), set()).add(lead)
        any_last = _char_class({table[x] for x in range(0x80, 0xC0)})
        forms = [_char_class(first) + second + any_last * (width - 2) for (width, second), first in leads.items()]
        if reader in _CYRILLIC_READERS:  # a chain of forms has one with another character somewhere
            letters, trail = _char_class({c for c in table if _CYRILLIC_ONLY.fullmatch(c)}), _char_class({table[x] for x in range(0x80, 0xC0) if not _CYRILLIC_ONLY.fullmatch(table[x])})
            cyrillic.append(rf"{letters}{trail}|{letters}{letters}{trail}|[а-яёЁ][А-ЯЁ]")
            leads = {k: {c for c in v if not _CYRILLIC_ONLY.fullmatch(c)} for k, v in leads.items()}
            forms = [_char_class(first) + second + any_last * (width - 2) for (width, second), first in leads.items() if first]
        if reader == "cp1251":
            cyrillic += forms
        else:
            others += forms
            starts |= set().union(*leads.values(), set())
    return rf"(?=[Ѐ-ӿ])(?:{'|'.join(cyrillic)})|(?={_char_class(starts)})(?:{'|'.join(others)})"


# The characters of a run that count in ``_solid``, and those that don't.
_SOLID_1252 = r"[\u0080-\u009f¡-ª¬-º¼-ÿ]"
_THIN_1252 = r"[\u00a0«»ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]"

#: A necessary condition for ``restore`` to find anything, evaluated in the JVM: one alternative for each way it can find something.
#: All but the lost letters start at a character outside ASCII, so the others are passed over with one look.
_FOREIGN = "|".join(
    (
        r"�|[\u0080-\u009f]",
        _form_pattern(),
        # three letters of Latin-1 in one run
        rf"{_SOLID_1252}(?:(?:[ \x40-\x7e]?{_THIN_1252})*[ \x40-\x7e]?{_SOLID_1252}){{2}}",
        _HAN_RUN.pattern.replace("{3,}", "{3}"),
        # Cyrillic words of four characters or more in all
        r"[А-яЁё]{4}|[А-яЁё]{2}[А-яЁё]?[. ]+[А-яЁё]{2}",
        # letters that can't stand in a Latin word
        r"[Ѐ-ԯ](?:(?<=[A-Za-z].)|(?=[A-Za-z]))|[À-ÞŒŸ](?<=[a-z].)",
    )
)
SUSPICIOUS = rf"(?=[^\x00-\x7f])(?:{_FOREIGN})|[^\W\d_]\?\Z|\?(?:[\p{{L}}\p{{Nl}}\p{{No}}?]|(?<=[\s\x1c-\x1f]\?)[\s\x1c-\x1f])|\A[\s\x1c-\x1f()/.,-]*\?"


#: Values of plain ASCII without a question mark are never garbled.
_MAYBE = r"_text rlike '[^\\x00-\\x3e\\x40-\\x7f]'"


def suspicious(value: Column) -> Column:
    return value.rlike("(?U)" + SUSPICIOUS)


_OUT = T.StructType([T.StructField("garbled", T.BooleanType()), T.StructField("restored", T.StringType()), T.StructField("lost", T.BooleanType())])


def restored(value: Column, short: bool = False) -> Column:
    """``struct(garbled, restored, lost)`` of a text column."""

    @F.pandas_udf(_OUT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([restore(x, short) for x in batch], columns=["garbled", "restored", "lost"])

    # non-deterministic by declaration, so that the optimiser evaluates it once, where it stands
    return run.asNondeterministic()(value)


def garbled_distinct(rows: DataFrame, text_col: str, short: bool = False) -> DataFrame:
    """``_text, n_rows, _r`` for each distinct garbled text."""
    distinct = cut_lineage(rows.select(F.col(text_col).alias("_text")).where(_MAYBE).groupBy("_text").agg(F.count("*").alias("n_rows")))
    seen = distinct.where(suspicious(F.col("_text")))  # once a value: below the grouping it would be once a row
    return seen.withColumn("_r", restored(F.col("_text"), short)).where("_r.garbled")


def garbled_values(rows: DataFrame, id_col: str, text_col: str, short: bool = False) -> DataFrame:
    """``row_id, restored, lost`` of the rows whose text is garbled. Null and empty texts are not; ids may repeat."""
    seen = rows.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("_text")).where(_MAYBE)
    if short:  # titles repeat a lot: each distinct value is looked at once
        seen = spread_join(seen, cut_lineage(garbled_distinct(seen, "_text", True)), ["_text"], "row_id", count="n_rows")
    else:
        seen = seen.where(suspicious(F.col("_text"))).withColumn("_r", restored(F.col("_text"))).where("_r.garbled")
    return seen.select("row_id", F.col("_r.restored").alias("restored"), F.col("_r.lost").alias("lost"))
