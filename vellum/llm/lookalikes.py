"""Text that looks the same in different characters, brought to one form.

Distinct values fall into words; words with a character outside ASCII are exploded to positioned code points, the others stay
whole. The code points are joined with one broadcast table made by rule from the Unicode database: decompositions, invisible
characters, spaces, hyphens, and for look-alike letters the letter of the other script, which is taken where the word around
it is of that script. Combining marks are put in order of their class, clusters are recomposed by a second broadcast join,
and the strings are rebuilt. The tables are bounded by Unicode itself (under 25,000 rows), so broadcasting them doesn't
depend on the data. Words wholly of one script keep their letters.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.skew import spread_join
from vellum.session import cut_lineage

# Letters of Greek and Cyrillic and the Latin letter that looks the same.
GREEK_LIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
}
CYRILLIC_LIKE = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "а": "a", "в": "b", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ѵ": "v", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï",
}
# Characters without width, spaces other than the plain one, hyphens other than the plain one.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\u2043\u2212\ufe63\uff0d"
_STYLED_TAGS = ("<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<super>", "<sub>", "<initial>", "<medial>", "<final>", "<isolated>")


def _styled(ch: str, tag: str) -> bool:
    """Forms that stand for plain letters; raised digits, ordinals, fractions and the like keep their meaning."""
    o = ord(ch)
    if tag in ("<super>", "<sub>"):
        return ch.isalpha() and o > 0x2000 or 0x1D2C <= o <= 0x1D6A
    if tag == "<compat>":
        return 0xFB00 <= o <= 0xFB4F or 0x01C4 <= o <= 0x01F3 or o in (0x0132, 0x0133)
    return tag in _STYLED_TAGS


@lru_cache
def character_rows() -> tuple[tuple[str, list[tuple[str, int]]], ...]:
    """(character, its parts with their combining class) for every character that is replaced or decomposed."""
    rows = []
    for o in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= o <= 0xDFFF or 0xAC00 <= o <= 0xD7A3:
            continue
        ch = chr(o)
        parts = None
        if ch in INVISIBLE:
            parts = ""
        elif ch in SPACES:
            parts = " "
        elif ch in HYPHENS:
            parts = "-"
        elif d := unicodedata.decomposition(ch):
            if d[0] != "<":
                parts = unicodedata.normalize("NFD", ch)
            elif _styled(ch, d.split()[0]):
                parts = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch))
        elif unicodedata.combining(ch) or 0x1100 <= o <= 0x11FF:
            parts = ch
        if parts is not None:
            rows.append((ch, [(c, 255 if 0x1160 <= ord(c) <= 0x11FF else unicodedata.combining(c)) for c in parts]))
    return tuple(rows)


@lru_cache
def composition_rows() -> tuple[tuple[str, str], ...]:
    """(decomposed cluster, composed character) for every character that composes."""
    rows = []
    for o in range(0xC0, 0x30000):
        if 0xD800 <= o <= 0xDFFF:
            continue
        ch = chr(o)
        apart = unicodedata.normalize("NFD", ch)
        if len(apart) > 1 and unicodedata.normalize("NFC", apart) == ch:
            rows.append((apart, ch))
    return tuple(rows)


def _apart(text: str) -> list[tuple[str, int]]:
    return [(c, unicodedata.combining(c)) for c in unicodedata.normalize("NFD", text)]


@lru_cache
def mapping_rows() -> tuple[tuple, ...]:
    """(character, parts, parts of the Latin look-alike, parts of the Cyrillic look-alike); null where there is none."""
    parts = dict(character_rows())
    latin = GREEK_LIKE | CYRILLIC_LIKE
    cyrillic = {v: k for k, v in CYRILLIC_LIKE.items() if v.isalpha()}
    return tuple((c, parts.get(c), _apart(latin[c]) if c in latin else None, _apart(cyrillic[c]) if c in cyrillic else None) for c in sorted({*parts, *latin, *cyrillic}))


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    part = "array<struct<c:string,k:int>>"
    chars = spark.createDataFrame(list(mapping_rows()), f"ch string, parts {part}, latin {part}, cyrillic {part}")
    pairs = spark.createDataFrame(list(composition_rows()), "apart string, composed string")
    return F.broadcast(chars), F.broadcast(pairs)


_WORDS = r"([\p{L}\p{M}\p{Cf}Ͱ-ϿЀ-ԯ]+|[^\p{L}\p{M}\p{Cf}]+)"
_LIKE = "".join(GREEK_LIKE) + "".join(CYRILLIC_LIKE)


def _count(value: Column, inside: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{inside}]", ""))


def _target(word: Column) -> Column:
    """The script, 'latin' or 'cyrillic', for which look-alikes in the word are exchanged; null where they stay."""
    latin, greek, cyrillic = (_count(word, s) for s in (r"\p{IsLatin}", r"\p{IsGreek}", r"\p{IsCyrillic}"))
    # what would be left of the other script if all look-alikes were exchanged
    left = _count(word, r"\p{IsGreek}\p{IsCyrillic}&&[^" + _LIKE + "]")
    left_latin = _count(word, r"\p{IsLatin}&&[^" + "".join(v for v in CYRILLIC_LIKE.values() if v.isalpha()) + "]")
    all_cyrillic = (left_latin == 0) & (F.col("_own_letters") > 0)
    alien = word.rlike(f"^[{_LIKE}]+$") & (F.col("_latin_words") > 0) & (F.col("_own_letters") == 0)
    return (
        F.when((latin > 0) & (cyrillic > 0) & all_cyrillic, "cyrillic")
        .when((latin > 0) & (greek + cyrillic > 0) & ((left == 0) | (latin + greek + cyrillic - left > left)), "latin")
        .when((latin > 0) & (cyrillic > 0), "cyrillic")
        .when((latin == 0) & (greek + cyrillic > 0) & alien, "latin")
    )


def canonical_forms(values: DataFrame, value_col: str = "value") -> DataFrame:
    """``value, n_rows, canonical`` for each distinct value with a character outside ASCII; null values have no row.

    ``n_rows`` is how often the value occurs. An empty value or one of plain ASCII is its own form and has no row. Very long
    values are only exploded, never cut.
    """
    spark = values.sparkSession
    chars, pairs = _tables(spark)
    v = values.select(F.col(value_col).alias("value")).where(F.col("value").rlike(r"[^\x00-\x7f]")).groupBy("value").agg(F.count("*").alias("n_rows"))
    # few bytes but much work a row: an explicit number of parts, which small sizes don't merge again
    v = v.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("value"))
    foreign = F.when(F.col("value").rlike(r"[\p{IsGreek}\p{IsCyrillic}]"), _count(F.col("value"), r"\p{IsGreek}\p{IsCyrillic}&&[^" + _LIKE + "]")).otherwise(0)
    words = v.select("value", "n_rows", F.regexp_extract_all("value", F.lit(_WORDS), 1).alias("_ws"), _count(F.col("value"), r"\p{IsLatin}").alias("_latin_words"), foreign.alias("_own_letters"))
    words = words.select("value", "n_rows", "_latin_words", "_own_letters", F.posexplode(F.transform("_ws", lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get("_ws", i + 1).rlike(r"^\p{M}"), F.lit(False)).alias("m")))).alias("_n", "_x"))
    word = F.col("_x.w")
    mixed = F.when(word.rlike(r"[\p{IsGreek}\p{IsCyrillic}]"), _target(word))
    whole = ~word.rlike(r"[^\x00-\x7f]") & ~F.col("_x.m")
    words = words.select("value", "n_rows", "_n", mixed.alias("_to"), whole.alias("_plain"), F.when(whole, F.array(word)).otherwise(F.regexp_extract_all(word, F.lit(r"(?s)(.)"), 1)).alias("_cs"))
    points = words.select("value", "n_rows", "_n", "_to", F.posexplode("_cs").alias("_p", "ch"))
    other = F.when(F.col("_to") == "latin", F.col("latin")).when(F.col("_to") == "cyrillic", F.col("cyrillic"))
    own = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("k")))
    parts = points.join(chars, "ch", "left").select("value", "n_rows", "_n", "_p", F.coalesce(other, "parts", own).alias("_parts"))
    lines = parts.groupBy("value", "n_rows").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_p", "_parts"))), lambda x: x["_parts"])).alias("_seq"))
    # A cluster is a character of class 0 with what follows it of other classes; marks are ordered by class within it.
    starts = F.filter(F.transform("_seq", lambda x, i: F.when((x["k"] == 0) | (i == 0), i)), lambda i: i.isNotNull())
    lines = lines.select("value", "n_rows", "_seq", starts.alias("_starts"))
    cluster = F.transform("_starts", lambda s, j: F.slice("_seq", s + 1, F.coalesce(F.get("_starts", j + 1), F.size("_seq")) - s))
    by_class = lambda xs: F.transform(F.array_sort(F.transform(xs, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["c"].alias("c")))), lambda x: x["c"])
    ordered = F.transform(cluster, lambda xs: F.when(F.size(xs) > 1, by_class(xs)).otherwise(F.transform(xs, lambda x: x["c"])))
    lines = cut_lineage(lines.select("value", "n_rows", ordered.alias("_clusters")))
    # Only clusters of several characters can change; the others stay in the row they are in.
    several = lambda cs: F.size(cs) > 1
    multi = lines.select("value", F.posexplode("_clusters").alias("_i", "_cs")).where(F.size("_cs") > 1)
    # the whole cluster composes, else its first two characters, else nothing: one join for both
    tried = F.array(F.struct(F.lit(0).alias("t"), F.array_join("_cs", "").alias("apart")), F.struct(F.lit(1).alias("t"), F.concat(F.get("_cs", F.lit(0)), F.get("_cs", F.lit(1))).alias("apart")))
    rest = F.array_join(F.slice("_cs", 3, F.greatest(F.size("_cs"), F.lit(3))), "")
    multi = multi.select("value", "_i", rest.alias("_rest"), F.explode(tried).alias("_t")).select("value", "_i", "_rest", "_t.t", "_t.apart").join(pairs, "apart", "left")
    form = F.when(F.col("t") == 0, F.coalesce("composed", "apart")).otherwise(F.concat("composed", "_rest"))
    multi = multi.groupBy("value", "_i").agg(F.min(F.struct(F.when(F.col("composed").isNull(), 2).otherwise(F.col("t")).alias("r"), F.col("t").alias("t"), form.alias("s"))).alias("_b"))
    changed = multi.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_b.s"))).alias("_m"))
    flat = F.array_join(F.transform("_clusters", lambda cs, i: F.coalesce(F.try_element_at(F.col("_m"), i), F.array_join(cs, ""))), "")
    plain = lines.where(~F.exists("_clusters", several)).select("value", "n_rows", F.array_join(F.flatten("_clusters"), "").alias("canonical"))
    composed = lines.where(F.exists("_clusters", several)).join(changed, "value").select("value", "n_rows", flat.alias("canonical"))
    return plain.unionByName(composed)


def stored_differently(rows: DataFrame, id_col: str, fields: list[str], leave_out: DataFrame | None = None) -> DataFrame:
    """``record_id, field_name, value, canonical`` of the values whose consistent form differs from what is stored.

    ``leave_out`` has the columns ``field_name, value`` of values that are to be left alone. Null and empty values are
    never cases; a row repeated comes out repeated.
    """
    one = [rows.select(F.col(id_col).alias("record_id"), F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]
    long = one[0]
    for other in one[1:]:
        long = long.unionByName(other)
    long = long.where(F.col("value").rlike(r"[^\x00-\x7f]"))
    changed = cut_lineage(canonical_forms(long).where("canonical != value"))
    out = spread_join(long, changed, ["value"], "record_id", count="n_rows")
    if leave_out is not None:
        out = out.join(leave_out.select("field_name", "value").distinct(), ["field_name", "value"], "left_anti")
    return out.select("record_id", "field_name", "value", "canonical")
