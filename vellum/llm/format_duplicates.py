"""Duplicates hidden by formatting differences.

A record is a set of (field name, value) pairs after normalisation. Every pair is hashed, and the hashes are combined by
addition, which does not depend on order, so neither fields nor query parameters need sorting. Records are grouped by that
fingerprint (128 bits in four sums) and the fields are then compared with those of the group's first record, again as
multisets. Only a group with more rows than one task should have is spread, over as many tasks as its number asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.skew import HOT_ROWS
from vellum.session import cut_lineage

# Characters that may stand around or after an address without being part of it.
_AROUND = r"""[.,;:!?'"`()<>\[\]{}|/\\#&\u00b4\u00ab\u00bb\u2018-\u201f\u2026\u3001\u3002\uff0c\uff1b\uff1a\uff01\uff1f\uff08\uff09]"""
_BLANK = r"[\s\p{Z}\u200b-\u200f\u2060\ufeff\u00ad]+"


def bare(value: Column) -> Column:
    """Lower case, no white space, no punctuation around the value; null becomes empty."""
    packed = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), _BLANK, ""))
    return F.regexp_replace(packed, f"^{_AROUND}+|{_AROUND}+$", "")


def address_base(url: Column) -> Column:
    """A bare address without its query: one slash where several stood, none at the end of the path."""
    path = F.regexp_replace(F.regexp_extract(url, r"^([^?]*)", 1), r"(?<!:)/{2,}|(?<=:/)/{2,}", "/")
    return F.regexp_replace(path, r"/+$", "")


def address_fields(url: Column) -> Column:
    """The query's non-empty fields, in the order found."""
    return F.filter(F.split(F.regexp_extract(url, r"\?(.*)$", 1), "[&;]"), lambda x: x != "")


def _sum_of_hashes(pairs: Column, seed: int, high: bool) -> Column:
    def half(x: Column) -> Column:
        h = F.xxhash64(F.lit(seed), x["name"], x["value"])
        return F.shiftrightunsigned(h, 32) if high else h.bitwiseAND(F.lit(0xFFFFFFFF))

    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, x: acc + half(x))


def multiset_fingerprint(pairs: Column) -> Column:
    """A 128-bit fingerprint of an array of (name, value) structs that does not depend on their order."""
    return F.struct(*(_sum_of_hashes(pairs, seed, high).alias(f"h{seed}{int(high)}") for seed in (7, 11) for high in (False, True)))


FINGERPRINT = ["h70", "h71", "h110", "h111"]


def _same_multiset(a: Column, b: Column) -> Column:
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return (F.size(a) == F.size(b)) & F.forall(a, lambda x: times(a, x) == times(b, x))


def normalized_records(rows: DataFrame, id_col: str = "record_id", url_col: str = "profile_url", email_col: str = "email") -> DataFrame:
    """``_id``, the normalised fields and the fingerprint of every row that has an address or an e-mail."""
    out = rows.select(F.col(id_col).alias("_id"), bare(F.col(url_col)).alias("_url"), bare(F.col(email_col)).alias("_mail"))
    out = out.where("_id is not null and (_url != '' or _mail != '')")
    out = out.select("_id", "_mail", address_base(F.col("_url")).alias("_base"), address_fields(F.col("_url")).alias("_fields"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    pairs = F.concat(
        F.array(pair("base", F.col("_base")), pair("mail", F.col("_mail"))),
        F.transform("_fields", lambda x: pair("field", x)),
    )
    return out.withColumn("_fp", multiset_fingerprint(pairs)).select("_id", "_base", "_mail", "_fields", *(F.col(f"_fp.{h}").alias(h) for h in FINGERPRINT))


def format_duplicates(rows: DataFrame, id_col: str = "record_id", url_col: str = "profile_url", email_col: str = "email", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``keep_id, record_id``: every record that repeats another, with the first of its set.

    Null equals empty; a row with neither address nor e-mail, or without an id, is nobody's copy. A row repeated under
    the same id is one record. If different records ever shared a fingerprint, each kind of them is a set of its own: the
    rows that differ from the group's first are compared among themselves. Other columns, whatever their names, play no
    part; an empty table gives no rows.
    """
    normal = cut_lineage(normalized_records(rows, id_col, url_col, email_col))
    groups = normal.groupBy(*FINGERPRINT).agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    groups = cut_lineage(groups.withColumn("_salts", F.ceil(F.col("_n") / hot_rows).cast("int")))
    hot = F.broadcast(groups.where("_salts > 1").select(*FINGERPRINT, "_salts"))  # at most one row for each ``hot_rows`` records
    salts = F.coalesce("_salts", F.lit(1))
    salted = normal.join(hot, FINGERPRINT, "left").withColumn("_salt", F.when(salts > 1, F.pmod(F.xxhash64("_id"), salts)).otherwise(0).cast("int")).drop("_salts")
    spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).select(*FINGERPRINT, "_first", "_salts", "_salt")
    joined = salted.join(spread.hint("merge"), [*FINGERPRINT, "_salt"])
    # the first record of each group goes to every task of the group; the copies stay where the join above has put them
    firsts = joined.where("_id = _first").select(*FINGERPRINT, "_salts", F.col("_base").alias("_base1"), F.col("_mail").alias("_mail1"), F.col("_fields").alias("_fields1")).distinct()
    firsts = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    compared = joined.where("_id != _first").join(firsts.hint("merge"), [*FINGERPRINT, "_salt"])
    same = (F.col("_base") == F.col("_base1")) & (F.col("_mail") == F.col("_mail1")) & _same_multiset(F.col("_fields"), F.col("_fields1"))
    compared = compared.select("_first", "_id", "_base", "_mail", "_fields", *FINGERPRINT, same.alias("_same"))
    copies = compared.where("_same").select(F.col("_first").alias("keep_id"), F.col("_id").alias("record_id"))
    # two kinds of records under one fingerprint: hardly ever a row
    kind = [*FINGERPRINT, "_base", "_mail", "_key"]
    others = compared.where(~F.col("_same")).withColumn("_key", F.array_sort("_fields"))
    least = others.groupBy(*kind).agg(F.min("_id").alias("keep_id"))
    more = others.join(least, kind).where("_id != keep_id").select("keep_id", F.col("_id").alias("record_id"))
    return copies.unionByName(more).distinct()
