"""Counts and summaries over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rollup_by(rows: DataFrame, key: str) -> DataFrame:
    """``key, n``."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def exploded_counts(rows: DataFrame, array_col: str, name: str) -> DataFrame:
    """How often each item of an array column occurs; null and empty arrays add nothing."""
    return rows.select(F.explode(array_col).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def running_total(rows: DataFrame, by: str, order: list[str], amount: Column, name: str = "total") -> DataFrame:
    """Adds the sum of non-negative ``amount`` up to and including each row of its group."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(F.greatest(amount, F.lit(0.0))).over(w))


def carried(rows: DataFrame, by: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds the last non-null ``value`` up to each row of its group: the heading in effect."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def first_rule(value: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Name of the first (name, phrase) whose phrase stands in the value as whole words, in any letter case."""
    out = F.lit(otherwise)
    for name, phrase in reversed(rules):
        out = F.when(value.rlike(rf"(?iU)(?<!\w)(?:{phrase})(?!\w)"), F.lit(name)).otherwise(out)
    return out
