"""Names of people: cleaned, taken apart, and told from other text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import ascii_key, space, umlaut_key

# Words that occur in labels of a page and not in names.
NON_NAME_WORDS = ("about", "contact", "privacy", "policy", "home", "directory", "faculty", "staff", "research", "education", "search", "people", "website", "personal", "main", "navigation")
# Parts of text that stands where a name should.
NON_PERSON_MARKERS = ("cookie", "privacy", "navigation", "site search", "read more", "view abstract", "contact information", "opening hours")
# Words of a name field that are no part of the name.
STOP_WORDS = (
    "adjunct", "assistant", "associate", "chair", "department", "docent", "doctor", "dr", "emeritus", "faculty", "fellow", "lecturer", "phd", "physics", "postdoc",
    "postdoctoral", "prof", "professor", "researcher", "scientist", "senior", "staff", "university", "visiting",
)
# Local parts of mailboxes that belong to no single person.
GENERIC_LOCAL_PARTS = (
    "admin", "admissions", "advising", "communications", "contact", "department", "dean", "enquiries", "enquiry", "faculty", "help", "info", "media", "office", "press",
    "school", "secretariat", "support", "tiedotus", "webmaster", "firstnamelastname", "namesurname", "nombreapellido", "usuario", "user",
)


def cleaned_name(name: Column) -> Column:
    """Blanks collapsed, a final degree and signs around the name dropped."""
    one = F.regexp_replace(space(name), r"\s+,", ",")
    return F.regexp_replace(F.regexp_replace(one, r"(?i)\s+(?:Ph\.?D\.?|MD|M\.D\.|Sc\.?D\.?)$", ""), r"^[ |,;-]+|[ |,;-]+$", "")


def without_roles(name: Column, roles: list[str]) -> Column:
    """The name without roles at its end, however many stand there; text inside the name stays."""
    ends = "|".join(r"\Q" + r + r"\E" for r in sorted(roles, key=len, reverse=True) if r.strip())
    plain = F.regexp_replace(space(name), r"^[ ,|]+|[ ,|]+$", "")
    return F.regexp_replace(F.regexp_replace(plain, rf"(?iU)(?:(?:\s+|,\s*)(?:{ends})[\s,|]*)+$", ""), r"^[ ,|]+|[ ,|]+$", "") if ends else plain


def last_name(name: Column) -> Column:
    """What stands before a comma, else the last of two or more words, else nothing."""
    words = F.split(F.trim(name), r"\s+")
    return F.when(name.contains(","), F.trim(F.substring_index(name, ",", 1))).when(F.size(words) >= 2, F.element_at(words, -1)).otherwise("")


def looks_like_name(name: Column) -> Column:
    """Two to six words of at most 80 characters, one with a capital, none a label of a page."""
    words = F.split(F.trim(name), r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[.,]+|[.,]+$", ""))
    return F.coalesce((F.length(name) <= 80) & F.size(words).between(2, 6) & ~F.arrays_overlap(bare, F.array(*map(F.lit, NON_NAME_WORDS))) & name.rlike(r"[A-Z][a-zA-Z'.-]+"), F.lit(False))


def is_non_person(name: Column) -> Column:
    """A question mark or a part that no name has."""
    low = F.lower(space(F.coalesce(name, F.lit(""))))
    return low.rlike(r"\?|" + "|".join(NON_PERSON_MARKERS))


def name_tokens(name: Column) -> Column:
    """Words of a name as they may stand in a mail address: an array for each word, without accents and with German digraphs."""
    bare = F.regexp_replace(F.lower(name), r"\b(?:prof(?:essor)?|dr|ph\.?d|msc|bsc)\b\.?", " ")
    words = F.filter(F.regexp_extract_all(bare, F.lit(r"([\p{L}]+)"), 1), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) >= 2))
    plain = lambda w: F.translate(w, "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿžšśćčłńőğıřěůż", "aaaaaaceeeeiiiinoooooouuuuyyzssccłnogıreuz")
    return F.array_distinct(F.transform(words, lambda w: F.array_sort(F.array_distinct(F.array(plain(w), umlaut_key(w))))))


def eligible_mail(mail: Column, domain: Column) -> Column:
    """A mailbox of one person on the domain or below it."""
    from vellum.functions.urls import within, without_www

    local = ascii_key(F.substring_index(mail, "@", 1))
    return mail.rlike(r"^[A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$") & within(F.substring_index(mail, "@", -1), without_www(domain)) & (local != "") & ~local.isin(*GENERIC_LOCAL_PARTS)


def normal_title_of(value: str | None) -> str | None:
    return None if value is None else " ".join(unicodedata.normalize("NFKC", value).split())


@F.pandas_udf(T.StringType())
def _normal_title(values: pd.Series) -> pd.Series:
    return values.map(normal_title_of)


def normal_title(value: Column) -> Column:
    """Compatibility forms composed and blanks collapsed; values of plain ASCII stay in the JVM."""
    foreign = value.rlike(r"[^\x00-\x7f]")
    return F.when(foreign, _normal_title(F.when(foreign, value))).otherwise(space(value))
