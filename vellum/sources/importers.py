"""Scans of tabular inputs in several formats, all columns as trimmed text, header names resolved by aliases."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import first_filled


def header_key(name: str) -> str:
    """Letters and digits of a header in one form, without case."""
    return "".join(c for c in unicodedata.normalize("NFKC", name).casefold() if c.isalnum())


def cleaned(rows: DataFrame) -> DataFrame:
    """Every column as text without blanks around it, null as empty; a byte order mark in the first header is dropped."""
    names = [c.lstrip("﻿").strip() for c in rows.columns]
    return rows.select(*(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(n) for c, n in zip(rows.columns, names, strict=True) if n))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    return cleaned(spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").csv(path))


def json_rows(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Objects of a JSON list, or of the first non-empty of ``records``, ``data`` and ``rows`` of a JSON object."""
    item = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
    whole = spark.read.option("wholetext", True).text(path)
    listed = F.from_json("value", item)
    inner = [F.from_json(F.get_json_object("value", f"$.{name}"), item) for name in ("records", "data", "rows")]
    filled = lambda c: F.when(F.size(c) > 0, c)
    is_list = F.ltrim("value").startswith("[")
    rows = whole.select(F.explode(F.when(is_list, listed).otherwise(F.coalesce(*map(filled, inner)))).alias("m")).where("m is not null")
    return cleaned(rows.select(*(F.col("m")[f].alias(f) for f in fields)))


def text_rows(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """One row per line that isn't blank."""
    return cleaned(spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias(name)))


def resolved(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns named by ``aliases``: each takes the first filled of the input columns whose header is one of its aliases."""
    by_key: dict[str, str] = {}
    for c in rows.columns:
        by_key.setdefault(header_key(c), c)
    out: list[Column] = []
    for name, names in aliases.items():
        found = [F.col(f"`{by_key[header_key(a)]}`") for a in names if header_key(a) in by_key]
        out.append((first_filled(*found) if found else F.lit("")).alias(name))
    return rows.select(*out)


_LINK = re.compile(r"https?://[^\s,，;；]+")


def url_lines(pasted: DataFrame, col: str = "raw") -> DataFrame:
    """``line, url, state`` for every address in pasted text: the first of equal ones is ``valid``, later ones ``duplicate``.

    A line that has text but no address is ``invalid``. Equality ignores the case of scheme and host and the fragment.
    """
    from pyspark.sql.window import Window

    from vellum.functions.urls import page_key

    lines = pasted.select(F.posexplode(F.split(col, "\r?\n")).alias("line", "text")).where(F.trim("text") != "")
    found = F.regexp_extract_all("text", F.lit(f"({_LINK.pattern})"), 1)
    each = lines.select((F.col("line") + 1).alias("line"), F.trim("text").alias("text"), F.posexplode_outer(F.when(F.size(found) > 0, found)).alias("n", "u"))
    each = each.withColumn("url", F.coalesce(F.regexp_replace("u", r"[)\]},，;；]+$", ""), "text"))
    nth = F.row_number().over(Window.partitionBy(page_key(F.col("url"))).orderBy("line", "n"))
    state = F.when(F.col("u").isNull(), "invalid").when(nth == 1, "valid").otherwise("duplicate")
    return each.select("line", "url", state.alias("state"))


def require_unique(rows: DataFrame, key: Column, what: str) -> DataFrame:
    """``rows``; fails with the first repeated keys if any key other than the empty one repeats."""
    repeated = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where("n > 1 and k != ''").orderBy("k").limit(3).collect()
    if repeated:
        raise ValueError(f"{what} repeats: " + ", ".join(str(r[0]) for r in repeated))
    return rows
