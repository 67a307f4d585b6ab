"""Freely typed values mapped to the entries of a reference list, and misses reported.

Each distinct value is brought to plain words and cut at its separators into heads (what may be the entry's name, with
abbreviations written out and inverted parts turned round). Heads that stand in the dictionary match at once. The others
are looked up within a bounded edit distance by symmetric deletes: the strings that arise from a head by dropping up to two
characters are joined with those of the dictionary, which Spark makes from the reference list and which is broadcast if its
bytes allow it. How long a head may be, in words and letters, follows from the longest name of the list. Candidates are
ranked by a weighted Damerau-Levenshtein distance, then by how often an entry is used. A value none of whose heads comes near
an entry is reported with the entry 0. Further names of entries are a table that the caller may give.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.lookalikes import CYRILLIC_LIKE, GREEK_LIKE
from vellum.llm.mojibake import restore
from vellum.operators.skew import BROADCAST_BYTES
from vellum.session import cut_lineage

# What short forms stand for, several where languages differ.
SHORT_FORMS = {
    "prof": "professor|professeure|profesora", "profa": "profesora", "a/prof": "associate professor", "assoc": "associate", "asst": "assistant", "assist": "assistant", "sr": "senior", "snr": "senior", "sen": "senior",
    "lect": "lecturer", "princ": "principal", "prin": "principal", "tchg": "teaching", "res": "research", "instr": "instructor", "adj": "adjunct", "vis": "visiting", "em": "emeritus", "emer": "emeritus",
    "hon": "honorary", "clin": "clinical", "sci": "scientist", "lab": "laboratory", "mgr": "manager", "acad": "academic", "dept": "department", "doct": "doctoral", "cand": "candidate", "invest": "investigator|investigadora",
    "investig": "investigadora|investigator", "inv": "investigadora", "wiss": "wissenschaftlicher", "mitarb": "mitarbeiter", "akad": "akademischer", "ak": "akademischer", "univ": "universites|universitats", "jun": "junior",
    "conf": "conferences", "rech": "recherche", "dir": "directrice", "ch": "chargee", "ing": "ingenieure", "aux": "auxiliar", "conv": "convidado", "tit": "titular", "ayte": "ayudante", "ayud": "ayudante", "dr": "doctor",
    "posdoc": "posdoctoral", "postdoctoral": "postdoctoral|posdoctoral", "catedr": "catedratico", "доц": "доцент", "проф": "профессор", "каф": "кафедры", "ст": "старший", "преп": "преподаватель", "вед": "ведущий", "науч": "научный",
    "сотр": "сотрудник", "ogr": "ogretim", "gor": "gorevlisi", "f": "fur", "fuer": "fur", "bes": "besondere", "apl": "ausserplanmassiger", "priv": "privat", "doz": "dozent", "أ": "أستاذ", "استاذ": "أستاذ", "agreg": "agregacao",
}
# Further names of the entries of the list of academic titles, by entry; a table for ``entries_of_values``.
OTHER_NAMES = {
    "Professor": "full professor|university professor", "Lecturer": "university lecturer", "Reader": "university reader", "Instructor": "course instructor", "Researcher": "academic researcher", "Dean": "faculty dean|dean of faculty",
    "Professor of Practice": "practice professor", "Emeritus Professor": "professor emeritus|emerita professor|professor emerita", "Department Chair": "chair of department|chair of the department|head of department", "Laboratory Manager": "lab manager",
    "Postdoctoral Researcher": "postdoc|post doc|post doc researcher|postdoc researcher|post doctoral researcher|postdoctoral fellow", "Doctoral Candidate": "phd candidate|ph d candidate|phd student|doctoral student", "Teaching Assistant": "t a|ta",
    "Principal Investigator": "p i|pi", "Universitätsprofessorin": "univ prof|univ prof in|univ professorin|universitatsprof|universitatsprofessor", "Juniorprofessorin": "juniorprof|juniorprof in|jun prof|jun prof in|junior prof|junior prof in|juniorprofessor|junior professorin",
    "Außerplanmäßiger Professor": "apl prof|apl professor", "Privatdozent": "pd|priv doz|privdoz|privatdoz|privat dozent", "Wissenschaftlicher Mitarbeiter": "wimi|wiss mitarb|wiss ma", "Lehrkraft für besondere Aufgaben": "lfba|lfb", "Akademischer Rat": "ak rat|akad rat",
    "Maître de conférences": "mcf|maitre de conf", "Professeure des universités": "pu|prof des univ|professeur des universites", "Ingénieure d'études": "ige|ing d etudes|ingenieur d etudes", "Directrice de recherche": "dr cnrs|directeur de recherche", "Chargée de recherche": "charge de recherche",
    "Profesora titular": "prof a titular|prof tit|profesor titular|titular de universidad", "Catedrático": "catedratico de universidad|catedratica", "Ayudante doctor": "ayudante dr|ayudante doctora", "Investigadora posdoctoral": "investigadora postdoctoral|investigador posdoctoral",
    "Professor auxiliar convidado com agregação": "prof aux conv c agregacao|professor auxiliar convidado c agregacao", "Доцент": "доцент кафедры", "Ведущий научный сотрудник": "внс", "Старший преподаватель": "ст преп", "教授": "正教授", "讲师": "专任讲师", "助理研究员": "助研", "副教授": "副教", "特任助教": "助教特任",
    "أستاذ مشارك": "استاذ مشارك", "Öğretim görevlisi": "ogr gor",
}
_SEPARATOR_WORDS = frozenset("of in at and und et y for the".split())
_LATIN = {**GREEK_LIKE, **CYRILLIC_LIKE}
_CYRILLIC = {v: k for k, v in CYRILLIC_LIKE.items() if v.isalpha() and k.isalpha()}
_CJK = re.compile(r"[぀-ヿ一-鿿가-힣]")
_INVISIBLE = re.compile(r"[­͏؜​-‏‪-‮⁠-⁤﻿ـ]")


def one_script(text: str) -> str:
    """Look-alikes exchanged word by word; a value that has letters of Cyrillic alone stays Cyrillic."""
    if not any(c in _LATIN for c in text):
        return text
    cyrillic = sum("\u0400" <= c <= "\u04ff" for c in text)
    own = any("\u0400" <= c <= "\u04ff" and c not in _LATIN for c in text) or cyrillic > sum("a" <= c <= "z" for c in text.lower())
    latin_value = any("a" <= c <= "z" for c in text.lower())
    out = []
    for word in re.split(r"([\W_]+)", text):
        latin = any("a" <= c <= "z" for c in word.lower())
        if any(c in _LATIN for c in word):
            back = "".join(_CYRILLIC.get(c, c) for c in word)
            plain = "".join(_LATIN.get(c, c) for c in word)
            if own and latin and not any("a" <= c <= "z" for c in back.lower()):
                word = back
            elif all(ord(c) < 0x370 for c in plain) and (latin or (latin_value and not own)):
                word = plain
            elif latin:
                word = back
        out.append(word)
    return "".join(out)


def fold(text: str) -> str:
    """Lower case without accents, in plain characters of one script a word."""
    t = one_script(unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)))
    t = t.casefold().replace("ı", "i").replace("ł", "l").replace("ø", "o").replace("đ", "d")
    kept = "".join(c for c in unicodedata.normalize("NFD", t) if not 0x300 <= ord(c) <= 0x36F)
    kept = unicodedata.normalize("NFC", kept)
    return re.sub("[\u0622\u0623\u0625\u0653\u0654\u0655]", lambda m: "\u0627" if m.group() < "\u0650" else "", kept)


def words_and_breaks(text: str) -> list[str]:
    """Words, with ``|`` wherever a separator stands. Signs that stand in for all blanks of a value count as blanks."""
    t = fold(text).replace("’", "'")
    if " " not in t.strip():
        for sign in "_.-":
            if sign in t.strip(" .-_") and re.search(rf"\w\{sign}+\w", t):
                t = t.replace(sign, " ")
    t = re.sub(r"(?<![^\W\d_])a/\s?prof", " aprof ", t)
    t = re.sub(r"(?<![^\W\d_])c/\s?(?=agreg)", "c ", t)
    t = re.sub(r"(?<![^\W\d_])ass't", "asst", t).replace("・", "" if _CJK.search(t) else " ")
    t = re.sub(r"(?<![^\W\d_])ph\.?\s?d\b", "phd", t)
    t = re.sub(r"[.'_*\"!?�-]+", lambda m: m.group() if "?" in m.group() or "�" in m.group() else " ", t)
    out: list[str] = []
    for w in re.findall(r"[\w?�]+|[^\w\s]", t):
        if w in _SEPARATOR_WORDS:
            out += ["|", w]
        elif re.fullmatch(r"[?�]+", w) and len(w) < 3:  # a dash that was lost
            out.append("|")
        elif re.match(r"[\w?�]", w):
            if out and out[-1] != "|" and _CJK.match(w) and _CJK.match(out[-1]):
                out[-1] += w
            else:
                out.append(w)
        else:
            out.append("|")
    return out


_SHORT = {fold(k): [fold(x) for x in v.split("|")] for k, v in SHORT_FORMS.items()}


def _spelled_out(words: list[str]) -> list[str]:
    choices = []
    for w in words:
        if w == "aprof":
            choices.append(["associate professor"])
        else:
            choices.append([w, *[x for x in _SHORT.get(w, ()) if x != w]])
    return [" ".join(combo) for combo in product(*choices)]


def heads(text: str, most_words: int = 8) -> list[tuple[int, str]]:
    """(priority, head): what in ``text`` may name an entry of up to ``most_words`` words; a lower priority goes first."""
    parts: list[list[str]] = [[]]
    for w in words_and_breaks(text):
        if w == "|":
            if parts[-1]:
                parts.append([])
        else:
            parts[-1].append(w)
    parts = [p for p in parts if p]
    if not parts:
        return []
    bare = [[w for w in p if w not in _SEPARATOR_WORDS] for p in parts]
    found: dict[str, int] = {}

    def add(words: list[str], priority: int) -> None:
        if len(words) > most_words:  # longer than any name
            return
        glue = "" if words and all(_CJK.search(w) for w in words) else " "
        for h in [glue.join(words)] if glue == "" else _spelled_out(words):
            found.setdefault(h, priority)

    if len(parts) > 1:
        if parts[1][0] not in _SEPARATOR_WORDS:
            add(bare[1] + bare[0], 0)
        for k in range(min(len(parts), most_words), 1, -1):
            if len(parts) >= k:
                add([w for p in parts[:k] for w in p], 1)
                add([w for p in bare[:k] for w in p], 2)
    add(parts[0], 3)
    if any("?" in h or "�" in h for h in found):
        for h, p in list(found.items()):
            found.setdefault("~" + re.sub(r"[?�]", "", h), p)
    return [(p, h) for h, p in found.items() if h.strip("~ ")]


def own_name(title: str) -> str:
    return " ".join(w for w in words_and_breaks(title) if w != "|")


def names_of(title: str, further: list[str]) -> set[str]:
    """All written-out names of an entry, folded the way heads are."""
    out: set[str] = set()
    for name in [title, *further]:
        if not name:
            continue
        plain = " ".join(w for w in words_and_breaks(name) if w != "|")
        glue = "".join(plain.split()) if _CJK.search(plain) else plain
        out.add(glue)
        out.add(" ".join(w for w in plain.split() if w not in _SEPARATOR_WORDS) or plain)
        digraphs = fold(name.lower().replace("ä", "ae").replace("ö", "oe").replace("ü", "ue"))
        out.add(" ".join(w for w in words_and_breaks(digraphs) if w != "|"))
        lossy = "".join(c for c in name.casefold() if c.isascii()) if any(c.isascii() and c.isalpha() for c in name) else ""
        sharp = "".join(c for c in name.lower() if c.isascii()) if lossy else ""
        for x in {lossy, sharp} - {""}:
            if any(not c.isascii() for c in name):
                out.add("~" + " ".join(w for w in words_and_breaks(x) if w != "|"))
        if not all(c.isascii() for c in name):  # forms garbled beyond letter-by-letter repair
            for written, read in (("utf-8", "gbk"), ("utf-8", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251")):
                try:
                    g = name.encode(written).decode(read, "replace")
                except UnicodeError:
                    continue
                out |= {"=" + "".join(g.casefold().split()), "=" + "".join(restore(g, True)[1].casefold().split())}
    return {x for x in out if x.strip("~= ")}


_ALLOWED = [0, 0, 0, 0, 1, 1, 1, 1, 1, 2]


def allowed_distance(name: str) -> int:
    """Edits that a head may be away from a name: none for short names and for scripts of syllables and signs."""
    if name[0] in "~=" or (_CJK.search(name) and len(name) < 6):
        return 0
    return _ALLOWED[min(len(name), len(_ALLOWED) - 1)]


def weighted_distance(a: str, b: str) -> float:
    """Damerau-Levenshtein with weights: 0.8 for swapped neighbours, 0.7 for a doubled letter, 1.5 for another first letter."""
    n, m = len(a), len(b)
    prev2: list[float] = []
    prev = [j * 1.0 for j in range(m + 1)]
    for i in range(1, n + 1):
        row = [i * 1.0] + [0.0] * m
        for j in range(1, m + 1):
            x, y = a[i - 1], b[j - 1]
            drop = 1.5 if i == 1 else 0.7 if a[i - 2] == x else 1.0
            add = 1.5 if j == 1 else 0.7 if b[j - 2] == y else 1.0
            swap = 0.0 if x == y else 1.5 if i == 1 and j == 1 else 1.0
            best = min(prev[j] + drop, row[j - 1] + add, prev[j - 1] + swap)
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, prev2[j - 2] + 0.8)
            row[j] = best
        prev2, prev = prev, row
    return prev[m]


def deletes(text: str, most: int) -> set[str]:
    """The text itself and what is left of it when up to ``most`` characters are dropped."""
    out = layer = {text}
    for _ in range(most):
        layer = {x[:i] + x[i + 1 :] for x in layer for i in range(len(x))}
        out = out | layer
    return out


def _heads(value: Column, most_words: int) -> Column:
    """Array of (priority, head) of a value."""

    def all_heads(text: str) -> list[tuple[int, str]]:
        back = restore(text, True)
        out = heads(back[1], most_words)
        if back[0]:
            out += [(4, "=" + "".join(re.split(r"[;|@,(/]", x)[0].casefold().split()).strip(".")) for x in {text, back[1]}]
        elif re.search(r"[Ѐ-ӿ]", text):
            out.append((4, "=" + "".join(text.casefold().split()).strip(".")))
        return out

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("h", T.StringType())])))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([all_heads(x) for x in batch])

    return run.asNondeterministic()(value)  # evaluated once, where it stands


@F.pandas_udf(T.ArrayType(T.StringType()))
def _deletes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([list(deletes(x, 0 if x[:1] in ("~", "=") else 2 if len(x) >= 8 else 1)) for x in batch])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("own", T.BooleanType())])))
def _names(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for title, further in batches:
        yield pd.Series([[(n, n == own_name(t)) for n in sorted(names_of(t, list(f)))] for t, f in zip(title, further, strict=True)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("d", T.StringType()), T.StructField("most", T.IntegerType())])))
def _name_deletes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([[(d, most) for d in deletes(n, most)] if (most := allowed_distance(n)) else [] for n in batch])


@F.pandas_udf(T.DoubleType())
def _cost(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for head, name in batches:
        yield pd.Series([weighted_distance(a, b) for a, b in zip(head, name, strict=True)], dtype="float64")


def dictionary_names(entries: DataFrame, further: DataFrame | None = None) -> DataFrame:
    """``name, title_id`` for every name of every entry. An entry's own name wins over another entry's further names."""
    listed = entries.select("title_id", "title").where("title_id is not null and title != ''").distinct()
    if further is None:
        named = listed.withColumn("_f", F.array().cast("array<string>"))
    else:
        more = further.select("title", F.col("name").alias("_n")).where("_n != ''").groupBy("title").agg(F.collect_set("_n").alias("_f"))
        named = listed.join(more, "title", "left").withColumn("_f", F.coalesce("_f", F.array().cast("array<string>")))
    names = cut_lineage(named.select("title_id", F.explode(_names("title", "_f")).alias("_x")).select("title_id", "_x.name", "_x.own"))
    owned = names.groupBy("name").agg(F.max("own").alias("_owned"))
    return names.join(owned, "name").where("own = _owned").select("name", "title_id").distinct()


def entries_of_values(values: DataFrame, entries: DataFrame, value_col: str = "value", further: DataFrame | None = None) -> DataFrame:
    """``value, title_id, cost, n_rows`` for every distinct non-empty value; ``title_id`` is 0 and ``cost`` null where none matches.

    Null and blank values have no row. Ties go to the cheaper head, then to the entry used by more values, then to the
    smaller id. ``further`` (``title, name``) has further names of entries. ``n_rows`` is how often a value occurs. Only sums
    come to the driver: of the names' bytes, and their greatest lengths.
    """
    spark = values.sparkSession
    names = cut_lineage(dictionary_names(entries, further))
    n_words = F.size(F.split("name", " ")) + F.when(F.col("name").rlike(r"[\x{3040}-\x{9fff}\x{ac00}-\x{d7a3}]"), F.length("name")).otherwise(0)
    most_words, most_letters, name_bytes = names.agg(F.max(n_words), F.max(F.length("name")), F.sum(F.octet_length("name") + 24)).first()
    small = lambda size, df: F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df.hint("merge")
    distinct = values.select(F.col(value_col).alias("value")).where(F.col("value").rlike(r"(?U)\S")).groupBy("value").agg(F.count("*").alias("n_rows"))
    # Few bytes but much work a row: an explicit number of parts, which small sizes don't merge again. The hash as the key
    # keeps the shuffle, which would be dropped as a repetition of the one for the distinct values.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = cut_lineage(distinct.repartition(parts, F.xxhash64("value")).withColumn("_hs", _heads(F.col("value"), (most_words or 0) + 2)))
    headed = distinct.select("value", F.explode_outer("_hs").alias("_h")).select("value", "_h.p", "_h.h")
    exact = headed.join(small(name_bytes, names), F.col("h") == F.col("name")).groupBy("value").agg(F.min(F.struct("p", "title_id")).alias("_e")).select("value", "_e.title_id", F.lit(0.0).alias("cost"))
    used = small(name_bytes, exact.groupBy("title_id").agg(F.count("*").alias("_used")))
    # the others, within a bounded edit distance
    missed = headed.join(exact.select("value"), "value", "left_anti").where(~F.col("h").rlike("^[~=]") & (F.length("h") >= 4) & (F.length("h") <= (most_letters or 0) + 2))
    dictionary = cut_lineage(names.select("name", "title_id", F.explode(_name_deletes("name")).alias("_x")).select("_x.d", "name", "title_id", "_x.most"))
    dictionary = small(dictionary.agg(F.sum(F.octet_length("d") + F.octet_length("name") + 40)).first()[0], dictionary)
    heads_missed = missed.select("h").distinct().repartition(parts, F.xxhash64("h")).select("h", F.explode(_deletes("h")).alias("d"))
    pairs = heads_missed.join(dictionary, "d").select("h", "name", "title_id", "most").distinct().repartition(parts, F.xxhash64("h", "name"))
    pairs = pairs.withColumn("cost", _cost("h", "name")).where(F.col("cost") <= F.col("most") + 0.05)
    ranked = missed.join(pairs, "h").join(used, "title_id", "left")
    best = ranked.groupBy("value").agg(F.min(F.struct(F.ceil("cost").alias("steps"), "p", "cost", -F.coalesce("_used", F.lit(0)), "title_id")).alias("_b"))
    found = exact.unionByName(best.select("value", "_b.title_id", "_b.cost"))
    return distinct.join(found, "value", "left").select("value", F.coalesce("title_id", F.lit(0)).alias("title_id"), "cost", "n_rows")
