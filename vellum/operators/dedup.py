"""Duplicates by key: first rows, most complete rows, and the order-dependent scan over several keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.components import connected_components
from vellum.session import cut_lineage


def first_per_key(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of each key; rows with a null or empty key are dropped. Aggregates before it shuffles rows."""
    whole = F.struct(*(F.col(c) for c in rows.columns))
    keyed = rows.where(key.isNotNull() & (key != "")).select(key.alias("_k"), order.alias("_o"), whole.alias("_r"))
    return keyed.groupBy("_k").agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def most_complete_per_key(rows: DataFrame, key: Column, order: Column, filled: list[str]) -> DataFrame:
    """For each key the row with most of ``filled`` filled, the earlier among equals, at the place of the key's first row.

    Adds ``first_at`` and ``n_rows``. Rows with an empty key stand for themselves only if the caller gives them one.
    """
    score = sum((F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", 1).otherwise(0) for c in filled), F.lit(0))
    whole = F.struct(*(F.col(c) for c in rows.columns))
    keyed = rows.select(key.alias("_k"), order.alias("_o"), score.alias("_s"), whole.alias("_r"))
    best = keyed.groupBy("_k").agg(F.max_by("_r", F.struct("_s", -F.col("_o"))).alias("_r"), F.min("_o").alias("first_at"), F.count("*").alias("n_rows"))
    return best.select("_r.*", "first_at", "n_rows")


def coalesced_per_key(rows: DataFrame, key: Column, order: str, fields: list[str], mail: str) -> DataFrame:
    """One row per key, as a scan in order would leave it: a later row takes the place of the row kept so far if it has more
    of ``fields`` and ``mail`` filled, and whichever is kept takes over a mail address that it lacks.

    Adds ``first_at``, the place of the key's first row. Only the first row of each of the (fields filled, mail filled)
    classes can ever change anything, so a key is reduced to at most twice as many rows as there are counts before it is
    scanned, and no group has to stand in one task. Rows with a null key are dropped.
    """
    filled = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    n_filled = sum((F.when(filled(c), 1).otherwise(0) for c in fields), F.lit(0))
    whole = F.struct(*(F.col(c) for c in rows.columns))
    classes = rows.select(key.alias("_k"), F.col(order).alias("_o"), n_filled.alias("_n"), F.when(filled(mail), F.col(mail)).alias("_m"), whole.alias("_r")).where("_k is not null")
    firsts = classes.groupBy("_k", "_n", F.col("_m").isNotNull().alias("_has")).agg(F.min_by(F.struct("_o", "_n", "_m", "_r"), "_o").alias("_x"))
    held = firsts.groupBy("_k").agg(F.array_sort(F.collect_list("_x")).alias("_xs"))
    score = lambda n, m: n + F.when(m.isNotNull(), 1).otherwise(0)
    first = F.get("_xs", F.lit(0))
    start = F.struct(first["_n"].alias("n"), first["_m"].alias("m"), first["_r"].alias("r"))

    def step(kept: Column, x: Column) -> Column:
        better = score(x["_n"], x["_m"]) > score(kept["n"], kept["m"])
        own, other = F.when(better, x["_m"]).otherwise(kept["m"]), F.when(better, kept["m"]).otherwise(x["_m"])
        return F.struct(F.when(better, x["_n"]).otherwise(kept["n"]).alias("n"), F.coalesce(own, other).alias("m"), F.when(better, x["_r"]).otherwise(kept["r"]).alias("r"))

    kept = held.select("_k", first["_o"].alias("first_at"), F.aggregate(F.slice("_xs", 2, F.size("_xs")), start, step).alias("_b"))
    columns = [F.col(f"_b.r.{c}").alias(c) if c != mail else F.coalesce(F.col("_b.m"), F.lit("")).alias(c) for c in rows.columns]
    return kept.select(*columns, "first_at")


def greedy_first(rows: DataFrame, id_col: str, keys: list[str], order_col: str) -> DataFrame:
    """``id, kept``: rows in order, each kept unless a kept row before it shares one of its non-empty keys.

    A rejected row blocks nothing, so this isn't the first row of each key. Rows sharing no key with any other are kept at
    once; the others are scanned component by component, each component in one task.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(order_col).alias("o"), *(F.nullif(F.col(k), F.lit("")).alias(k) for k in keys))
    long = base.select("id", "o", F.explode(F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in keys))).alias("k")).where("k is not null")
    shared = long.groupBy("k").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    edges = cut_lineage(long.join(shared, "k").select("id", "head", "o", "k"))
    parts = connected_components(edges.select("id", "head"), "id", "head")
    held = edges.groupBy("id", "o").agg(F.collect_list("k").alias("ks")).join(parts, F.col("id") == F.col("node")).select("component", "o", "id", "ks")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, taken = None, set()
        for frame in frames:
            kept = []
            for component, ks in zip(frame["component"], frame["ks"], strict=True):
                if component != part:
                    part, taken = component, set()
                free = taken.isdisjoint(ks)
                if free:
                    taken.update(ks)
                kept.append(free)
            yield pd.DataFrame({"id": frame["id"], "kept": kept})

    id_type = base.schema["id"].dataType.simpleString()
    scanned = held.repartition("component").sortWithinPartitions("component", "o", "id").mapInPandas(scan, f"id {id_type}, kept boolean")
    return base.select("id").join(scanned, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))
