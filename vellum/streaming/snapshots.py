"""Snapshots of a page that grows as it is scrolled: which of them bring something new, and when to stop."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

_OUT = "page string, round int, n_new int, stopped boolean"
_STATE = "seen array<string>, unchanged int"


def new_per_round(snapshots: DataFrame) -> DataFrame:
    """``page, round, n_new`` from ``page, round, keys``: keys that no earlier round of the page had. For tables at rest."""
    each = snapshots.select("page", "round", F.explode_outer("keys").alias("key"))
    first = each.groupBy("page", "key").agg(F.min("round").alias("round")).where("key is not null").groupBy("page", "round").agg(F.count("*").cast("int").alias("n_new"))
    rounds = snapshots.select("page", "round").distinct()
    return rounds.join(first, ["page", "round"], "left").select("page", "round", F.coalesce("n_new", F.lit(0)).alias("n_new"))


def quiet_after(rounds: DataFrame, patience: int) -> DataFrame:
    """``page, stop_round``: the round in which nothing new has come for the ``patience``-th time in a row."""
    w = Window.partitionBy("page").orderBy("round")
    run = F.sum(F.when(F.col("n_new") > 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    quiet = rounds.withColumn("_g", run).where("n_new = 0").withColumn("_n", F.row_number().over(Window.partitionBy("page", "_g").orderBy("round")))
    return quiet.where(F.col("_n") == patience).groupBy("page").agg(F.min("round").alias("stop_round"))


def watch(snapshots: DataFrame, patience: int = 2) -> DataFrame:
    """The same over a stream of ``page, round, keys``: one row per snapshot, with a state per page that holds the keys seen.

    Rounds of a page that come in one batch are taken in order. A page that has stopped stays stopped, and of it the state
    keeps nothing but that.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, unchanged = (set(state.get[0]), state.get[1]) if state.exists else (set(), 0)
        rows = pd.concat(list(frames)).sort_values("round")
        out = []
        for number, keys in zip(rows["round"], rows["keys"], strict=True):
            stopped = unchanged >= patience
            new = set() if stopped or keys is None else set(keys) - seen
            seen |= new
            unchanged = unchanged if stopped else 0 if new else unchanged + 1
            out.append((key[0], int(number), len(new), unchanged >= patience))
        state.update(([] if unchanged >= patience else sorted(seen), unchanged))
        yield pd.DataFrame(out, columns=["page", "round", "n_new", "stopped"])

    return snapshots.groupBy("page").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
