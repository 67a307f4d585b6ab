"""Mail addresses in text and markup: plain, spelled out, escaped and encoded ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


def addresses(text: Column) -> Column:
    """Distinct addresses of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({ADDRESS})"), 1))


def spelled_out(text: Column) -> Column:
    """``name [at] host [dot] tld`` and the like written as an address; escapes of the at sign resolved."""
    out = F.regexp_replace(text, r"(?i)\\u0040|\\x40|&#0*64;|&#x0*40;|&commat;|%40", "@")
    out = F.regexp_replace(out, r"(?i)(?<=[\w.-])\s*[\[({]\s*(?:at|@|arroba)\s*[\])}]\s*(?=[\w-])", "@")
    return F.regexp_replace(out, r"(?i)(?<=[\w-])\s*[\[({]\s*(?:dot|punkt|punto|point|\.)\s*[\])}]\s*(?=[\w-])", ".")


def joined_parts(html: Column) -> Column:
    """Addresses of elements that hold the local part and the domain in two attributes."""
    two = r"""(?i)data-(?:email-)?(?:local|user)\s*=\s*["']([^"']+)["'][^>]*data-(?:email-)?domain\s*=\s*["']([^"']+)["']"""
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(two), 1).alias("local"), F.regexp_extract_all(html, F.lit(two), 2).alias("domain"))


def unprotected_of(code: str | None) -> str | None:
    """Hexadecimal bytes whose first is the key all others were combined with; null if that gives no address."""
    try:
        raw = bytes.fromhex(code or "")
    except ValueError:
        return None
    if len(raw) < 2:
        return None
    return "".join(chr(b ^ raw[0]) for b in raw[1:])


@F.pandas_udf(T.StringType())
def unprotected(codes: pd.Series) -> pd.Series:
    return codes.map(unprotected_of)
