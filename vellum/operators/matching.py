"""Matches between tables by keys, by shared words, and by phrases found in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import unicode_key


def longest_phrase(value: Column, phrases: list[str], otherwise: str = "") -> Column:
    """The longest of ``phrases`` that the value contains, in any letter case; equal lengths go by the alphabet.

    The phrases become one expression, so the list should be a fixed one of some hundreds at most.
    """
    low = F.lower(value)
    out = F.lit(otherwise)
    for phrase in sorted(phrases, key=lambda p: (len(p), [-ord(c) for c in p])):
        out = F.when(low.contains(phrase.lower()), F.lit(phrase)).otherwise(out)
    return out


def best_by_shared_words(people: DataFrame, items: DataFrame, group: str, least: int = 4) -> DataFrame:
    """``id, item, score``: for each person the item of the same group that shares most letters in whole words.

    ``people`` has ``id, <group>, words``, ``items`` has ``item, <group>, words`` (arrays). Only pairs with a word of at least
    ``least`` letters in common meet, by an equality join on group and word, so nothing is paired with everything. Ties go
    to the smaller item; without a common word there is no row.
    """
    word = lambda df, *keep: df.select(*keep, group, F.explode(F.array_distinct("words")).alias("w")).where(F.length("w") >= least)
    shared = word(people, "id").join(word(items, "item").distinct(), [group, "w"])
    scored = shared.groupBy("id", "item").agg(F.sum(F.length("w")).alias("score"))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "item")).alias("b"))
    return best.select("id", "b.item", (-F.col("b.s")).alias("score"))


def linked_rows(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """``left_id, right_id, how``: by address where both have the same, else by name where just one row of the group has it.

    Both have ``id, <group>, url, name``. Of several rows with an address the one with the smallest id counts.
    """
    name = unicode_key(F.col("name"))
    by_url = right.where("url != ''").groupBy("url").agg(F.min("id").alias("right_id"))
    by_name = right.where(name != "").groupBy(group, name.alias("k")).agg(F.min("id").alias("right_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    first = left.join(by_url, "url").select(F.col("id").alias("left_id"), "right_id", F.lit("url").alias("how"))
    rest = left.withColumn("k", name).join(by_url.select("url"), "url", "left_anti").join(by_name, [group, "k"])
    return first.unionByName(rest.select(F.col("id").alias("left_id"), "right_id", F.lit("name").alias("how")))


def grounded(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """``quotes`` (``id, pos, url, quote``) with ``found``: null if the page isn't there, else whether its text has the quote.

    ``pages`` has ``url, text``, one row per address. Blanks are compared as single ones, letter case is ignored.
    """
    flat = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", " "))
    joined = quotes.join(pages.select("url", flat(F.col("text")).alias("_t")), "url", "left")
    return joined.select("id", "pos", F.when(F.col("_t").isNotNull(), F.col("_t").contains(flat(F.trim("quote")))).alias("found"))
