"""Text keys: what two spellings must share to count as the same."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def space(value: Column) -> Column:
    """White space of any kind collapsed to single blanks, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def unicode_key(value: Column) -> Column:
    """Lower-case letters and digits of any script."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def umlaut_key(value: Column) -> Column:
    """``unicode_key`` with German umlauts written as two letters."""
    out = F.lower(value)
    for letter, two in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(letter), F.lit(two))
    return unicode_key(out)


def ascii_key_of(value: str | None) -> str | None:
    """Latin letters without accents and digits; empty for names in other scripts."""
    if value is None:
        return None
    apart = unicodedata.normalize("NFKD", value)
    return re.sub(r"[^a-z0-9]", "", "".join(c for c in apart if not unicodedata.combining(c)).casefold())


@F.pandas_udf(T.StringType())
def _ascii_key(values: pd.Series) -> pd.Series:
    return values.map(ascii_key_of)


def ascii_key(value: Column) -> Column:
    """``ascii_key_of`` as a column; values of plain ASCII stay in the JVM."""
    plain = F.regexp_replace(F.lower(value), "[^a-z0-9]", "")
    return F.when(value.rlike(r"[^\x00-\x7f]"), _ascii_key(F.when(value.rlike(r"[^\x00-\x7f]"), value))).otherwise(plain)


def mail_key(value: Column) -> Column:
    """A mail address in lower case without blanks around it."""
    return F.lower(F.trim(value))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank; empty text if there is none."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit(""))
