"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is spread over one task for each so many of them.
HOT_ROWS = 100_000
#: Tables of up to so many bytes are broadcast, once their size is known; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def hot_keys(rows: DataFrame, keys: list[str], count: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``_hk, _salts`` for every key with more than ``hot_rows`` rows, by the hash of the key.

    ``rows`` is counted, or has the counts already, one row a key, in ``count``. There is at most one such key for each
    ``hot_rows`` rows, 12 bytes each, so the table can be broadcast: 12 MB for 10^11 rows.
    """
    key = F.xxhash64(*keys)
    n = rows.groupBy(key.alias("_hk")).agg((F.sum(count) if count else F.count("*")).alias("_n"))
    return n.where(F.col("_n") > hot_rows).select("_hk", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], spread_by: str, how: str = "inner", count: str | None = None, hot_rows: int = HOT_ROWS, base: DataFrame | None = None, shuffled: bool = True) -> DataFrame:
    """Join ``rows`` with ``few``; the rows of a hot key go to as many tasks as their number asks for.

    Only the hot keys' rows of ``few`` are repeated. ``count`` names a column of ``few`` (one row a key) with the number of
    ``rows`` of the key, else they are counted, in ``base`` if given: a table with the same keys that costs less to read. ``how`` is inner, left, left_semi or left_anti. Null keys never match. The
    tables are joined by shuffle, since both may grow; with ``shuffled`` off Spark may broadcast ``few`` where its measured
    bytes are under the session's threshold. Without a hot key nothing is repeated.
    """
    hot = F.broadcast(hot_keys(few if count else rows if base is None else base, keys, count, hot_rows))
    salts = F.coalesce("_salts", F.lit(1))
    salted = rows.withColumn("_hk", F.xxhash64(*keys)).join(hot, "_hk", "left").withColumn("_salt", F.when(salts > 1, F.pmod(F.xxhash64(spread_by), salts)).otherwise(0).cast("int")).drop("_hk", "_salts")
    repeated = few.withColumn("_hk", F.xxhash64(*keys)).join(hot, "_hk", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hk", "_salts")
    return salted.join(repeated.hint("merge") if shuffled else repeated, [*keys, "_salt"], how).drop("_salt")
