"""Filling containers of a fixed number of tokens with texts, leaving little room and cutting only what can't fit.

Lengths are bucketed: dynamic programming over the global length histogram, which has at most as many entries as the
capacity, chooses the boundaries that minimise padding. Batches within a token budget are then formed, still on the histogram, in one
of two ways. ``bucket_layout`` forms them inside each bucket, as many texts a batch as the bucket's bound allows; a text
longer than half a container then has one to itself. ``layout`` mixes buckets: a container takes the longest bucket left and
fills up with the longest that fit, and every such pattern is repeated as often as its buckets allow. Either way a text finds
its container from its rank in its bucket alone, so no group of texts ever has to stand in one task, whatever the size of the
corpus. The tokenizer's files are read on every executor from the folder given, which has to exist there.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vellum.session import cut_lineage

CAPACITY = 2048
BUCKETS = 256
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Ranks are given out in blocks of about so many texts of one bucket.
ROWS_A_BLOCK = 100_000


@lru_cache
def _encoding(folder: str, vocabulary: str):  # noqa: ANN202
    import tiktoken

    spec = importlib.util.spec_from_file_location("vellum_tokenizer_files", f"{folder}/__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(f"{folder}/{vocabulary}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for null and empty text."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(folder, vocabulary)
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(x)) if x else 0 for x in batch], dtype="int32")

    return count(text)


def bucket_boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of the buckets with the least padding. ``counts[l]`` is the number of texts of length ``l``.

    Dynamic programming over (number of buckets, last boundary); the last boundary is the greatest length present.
    """
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > 0]
    if len(lengths) <= buckets:
        return [int(x) for x in lengths]
    n = np.concatenate([[0], np.cumsum(counts[lengths])]).astype(np.float64)
    total = np.concatenate([[0], np.cumsum(counts[lengths] * lengths)]).astype(np.float64)
    # cost[i, j]: padding of one bucket with the lengths i..j-1
    upper = lengths.astype(np.float64)
    cost = upper[None, :] * (n[None, 1:] - n[:-1, None]) - (total[None, 1:] - total[:-1, None])
    cost[np.tril_indices(len(lengths), -1)] = np.inf
    best = cost[0].copy()
    back = []
    for _ in range(buckets - 1):
        through = best[:-1, None] + cost[1:, :]
        at = np.argmin(through, axis=0)
        new = np.minimum(best, through[at, np.arange(len(lengths))])
        back.append(np.where(new < best, at, -1))
        best = new
    out, j = [], len(lengths) - 1
    for step in reversed(back):
        if step[j] >= 0:
            out.append(int(lengths[j]))
            j = int(step[j])
    return sorted({*out, int(lengths[j])})


def layout(bounds: list[int], counts: list[int], capacity: int) -> tuple[list[list[tuple[int, int, int, int]]], int]:
    """For each bucket its segments (first rank, texts a container, first container, first slot); and the containers used.

    The largest bucket left opens a container, which is then filled with the largest that fit. A pattern is repeated until
    one of its buckets runs short, so there are at most about twice as many patterns as buckets.
    """
    left = list(counts)
    used = [0] * len(bounds)
    segments: list[list[tuple[int, int, int, int]]] = [[] for _ in bounds]
    container = 0
    top = len(bounds) - 1
    while top >= 0:
        if not left[top]:
            top -= 1
            continue
        room, pattern, at = capacity, [], top
        while at >= 0:
            fit = min(room // bounds[at], left[at])
            if fit:
                pattern.append((at, fit))
                room -= fit * bounds[at]
            at -= 1
        times = min(left[b] // k for b, k in pattern)
        slot = 0
        for b, k in pattern:
            segments[b].append((used[b], k, container, slot))
            used[b] += k * times
            left[b] -= k * times
            slot += k
        container += times
    return segments, container


def bucket_layout(bounds: list[int], counts: list[int], capacity: int) -> tuple[list[list[tuple[int, int, int, int]]], int]:
    """The same for batches inside each bucket: one segment a bucket, with as many texts a container as its bound allows."""
    segments, container = [], 0
    for bound, n in zip(bounds, counts, strict=True):
        each = capacity // bound
        segments.append([(0, each, container, 0)])
        container += -(-n // each)
    return segments, container


def contained(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, buckets: int = BUCKETS, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, mixed: bool = True) -> DataFrame:
    """``doc_id, part_no, start_token, n_tokens, container_id, slot`` for every non-blank text.

    A text longer than a container is cut into full containers and one rest; no other text is cut. Null and blank texts
    have no place. Repeated texts and ids each get their own place; an empty table gives no rows. The token counts are
    written to the checkpoint folder once and read for the histogram and for the ranks. ``mixed`` batches take texts of
    several buckets, the others of one.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).where(F.col("_text").rlike(r"(?U)\S"))
    sizes = rows.select("doc_id", token_count(F.col("_text"), folder, vocabulary).alias("_n")).where("_n > 0")
    sizes = cut_lineage(sizes)
    rest = F.col("_n") % capacity
    histogram = sizes.where(rest > 0).groupBy(rest.alias("_l")).agg(F.count("*").alias("_c")).collect()  # at most `capacity` rows
    full = sizes.agg(F.sum(F.floor(F.col("_n") / capacity))).first()[0] or 0
    counts = np.zeros(capacity, dtype=np.int64)
    for row in histogram:
        counts[row["_l"]] = row["_c"]
    bounds = bucket_boundaries(counts, buckets)
    starts = [0, *bounds]
    in_bucket = [int(counts[a + 1 : b + 1].sum()) for a, b in zip(starts, bounds, strict=False)]
    segments, n_mixed = (layout if mixed else bucket_layout)(bounds, in_bucket, capacity)

    # ranks of the rests within their bucket: blocks of hashed ids, each with an offset
    bounds_at = np.array(bounds)
    blocks = max(1, int(np.ceil(max(in_bucket, default=0) / ROWS_A_BLOCK)))
    spark = documents.sparkSession
    of_length = spark.createDataFrame([(int(x), int(np.searchsorted(bounds_at, x))) for x in np.flatnonzero(counts)], "_l int, _b int")
    parts = sizes.where(rest > 0).select("doc_id", "_n", rest.alias("_l"), F.pmod(F.xxhash64("doc_id", "_n"), F.lit(blocks)).cast("int").alias("_k"))
    parts = parts.join(F.broadcast(of_length), "_l")
    offsets = parts.groupBy("_b", "_k").agg(F.count("*").alias("_c"))
    offsets = offsets.withColumn("_offset", F.sum("_c").over(Window.partitionBy("_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_b", "_k").orderBy("doc_id", "_n")) - 1)
    # the offsets grow with the blocks; ranks and offsets are partitioned alike, so the join moves only the offsets
    ranked = ranked.join(offsets.select("_b", "_k", F.coalesce("_offset", F.lit(0)).alias("_offset")), ["_b", "_k"])
    ranked = ranked.withColumn("_r", F.col("_r") + F.col("_offset"))

    tables = [tuple(np.array(c, dtype=np.int64) for c in zip(*s, strict=True)) if s else None for s in segments]

    @F.pandas_udf(T.StructType([T.StructField("container", T.LongType()), T.StructField("slot", T.IntegerType())]))
    def place(bucket: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(rank), 2), dtype=np.int64)
        b, r = bucket.to_numpy(), rank.to_numpy()
        for x in np.unique(b):
            first, each, base, slot = tables[x]
            mine = b == x
            at = np.searchsorted(first, r[mine], side="right") - 1
            inside = r[mine] - first[at]
            out[mine, 0] = base[at] + inside // each[at]
            out[mine, 1] = slot[at] + inside % each[at]
        return pd.DataFrame({"container": out[:, 0], "slot": out[:, 1].astype("int32")})

    whole = F.floor(F.col("_n") / capacity).cast("int")
    placed = ranked.withColumn("_p", place(F.col("_b"), F.col("_r"))).select(
        "doc_id",
        whole.alias("part_no"),
        (whole * capacity).alias("start_token"),
        F.col("_l").alias("n_tokens"),
        F.col("_p.container").alias("container_id"),
        F.col("_p.slot").alias("slot"),
    )
    if not full:
        return placed
    # full containers are numbered after the mixed ones, by blocks of ids in the same way
    fulls = sizes.where(F.col("_n") >= capacity).select("doc_id", "_n", F.explode(F.sequence(F.lit(0), whole - 1)).alias("part_no"))
    full_blocks = max(1, int(np.ceil(full / ROWS_A_BLOCK)))
    fulls = fulls.withColumn("_k", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(full_blocks)).cast("int"))
    # one row for each ROWS_A_BLOCK full containers; offsets within thousands of blocks, and the thousands' own before them
    before = cut_lineage(fulls.groupBy("_k").agg(F.count("*").alias("_c")).withColumn("_m", F.floor(F.col("_k") / 1000)))
    earlier = lambda by, order: F.coalesce(F.sum("_c").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    thousands = before.groupBy("_m").agg(F.sum("_c").alias("_c")).withColumn("_one", F.lit(0)).withColumn("_offset_m", earlier("_one", "_m"))
    before = before.withColumn("_offset", earlier("_m", "_k")).join(thousands.select("_m", "_offset_m"), "_m").select("_k", (F.col("_offset") + F.col("_offset_m")).alias("_offset"))
    fulls = fulls.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("doc_id", "part_no", "_n")) - 1).join(before.select("_k", "_offset"), "_k")
    fulls = fulls.select(
        "doc_id",
        "part_no",
        (F.col("part_no") * capacity).alias("start_token"),
        F.lit(capacity).alias("n_tokens"),
        (F.lit(n_mixed) + F.col("_r") + F.col("_offset")).cast("bigint").alias("container_id"),
        F.lit(0).alias("slot"),
    )
    return placed.unionByName(fulls)
