"""Test passages inside a training corpus, found by spaced-seed hashing.

Texts become tokens (words; single characters in Chinese and kana), each hashed once in the JVM. Fixed masks pick five of the
tokens in a window and ignore the others, so a changed word in the gap doesn't hide a hit. The corpus has one seed for each
mask and place; the test items have further ones in which one token is dropped, or an added one stands in the gap, so dropped
and added words cost the corpus nothing. Every passage of twelve tokens with up to two of them changed, dropped or added has
a seed in common with its item (all 622 forms were tried, and so they are in the tests); so has one of twenty with three.

A Bloom filter of the test items' seeds, of a fixed size, drops the corpus seeds that can't meet one before anything is
exploded or shuffled. What is left is joined on the seed, and only (document, item) pairs with a hit are verified, by
chaining runs of equal tokens around the hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.skew import BROADCAST_BYTES, spread_join
from vellum.session import cut_lineage

#: Windows of tokens; 1 is looked at, 0 is ignored.
MASKS = ("111011", "11111")
LEAST_WORDS, LEAST_CHARACTERS, ONE_IN = 12, 20, 6
#: Bits of the Bloom filter (2 MB) and hashes a seed. A test set that fills it up lets more seeds through to the join, which stays exact.
BLOOM_BITS, BLOOM_HASHES = 1 << 24, 4

_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
# Odd multipliers, one for each place of a mask.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def tokens(text: Column) -> Column:
    """Lower-case words, and single characters where a script has no spaces; punctuation and spacing are left out."""
    low = F.lower(F.coalesce(text, F.lit("")))
    apart = F.when(low.rlike(f"[{_ALONE}]"), F.regexp_replace(low, f"([{_ALONE}])", " $1 ")).otherwise(low)
    return F.filter(F.split(apart, r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def variants(mask: str) -> list[list[int]]:
    """Places, from the first, that a mask looks at in an item: as they are, with one token dropped, with one added in a gap."""
    at = [i for i, c in enumerate(mask) if c == "1"]
    out = [at]
    for k in range(1, len(at)):
        out.append(at[:k] + [i + 1 for i in at[k:]])
        if at[k] - at[k - 1] > 1:
            out.append(at[:k] + [i - 1 for i in at[k:]])
    return out


def seeds_at(hashes: np.ndarray, places: list[int], mask_no: int) -> np.ndarray:
    """The seed of every place of ``hashes`` that has room for ``places``; one for each, in order."""
    n = len(hashes) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, mask_no + 1, np.uint64)
    for p, factor in zip(places, _FACTORS, strict=True):
        out += (hashes[p : p + n].view(np.uint64) ^ (hashes[p : p + n].view(np.uint64) >> np.uint64(29))) * np.uint64(factor)
    return out ^ (out >> np.uint64(32))


@F.pandas_udf(T.ArrayType(T.LongType()))
def item_seeds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All seeds of an item, those with a dropped or added token included."""
    for batch in batches:
        yield pd.Series([np.unique(np.concatenate([seeds_at(np.asarray(h, np.int64), v, m) for m, mask in enumerate(MASKS) for v in variants(mask)])).view(np.int64) for h in batch])


def _bits_of(seed: Column) -> Column:
    """The bits of the Bloom filter that a seed sets."""
    part = BLOOM_BITS.bit_length() - 1
    return F.array(*(F.shiftrightunsigned(seed, (64 - part) * k // (BLOOM_HASHES - 1)).bitwiseAND(BLOOM_BITS - 1) + 1 for k in range(BLOOM_HASHES)))


def _bloom(seeds: DataFrame) -> np.ndarray:
    """The Bloom filter as bytes, built by executors in pieces of 4 KB; ``BLOOM_BITS`` bounds what comes to the driver."""
    bit = seeds.select(F.explode(_bits_of(F.col("_seed"))).alias("_b"))
    pieces = bit.groupBy(F.expr("bitmap_bucket_number(_b)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_b))").alias("m"))
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for n, m in pieces.collect():  # piece n has the bits 32768 (n - 1) + 1 to 32768 n
        out[(n - 1) * 4096 : n * 4096] = np.frombuffer(bytes(m), np.uint8)
    return out


def might_contain(bloom: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    part = BLOOM_BITS.bit_length() - 1
    there = np.ones(len(seeds), bool)
    for k in range(BLOOM_HASHES):
        b = (seeds >> np.uint64((64 - part) * k // (BLOOM_HASHES - 1))) & np.uint64(BLOOM_BITS - 1)
        b = b.astype(np.int64)
        there &= (bloom[b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0
    return there


def _with_hits(docs: DataFrame, bloom: np.ndarray) -> DataFrame:
    """The documents with a seed that may be a test item's: ``doc_id, _t`` (hashed tokens), ``_hits`` (seed and place)."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)
    masks = [variants(m)[0] for m in MASKS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.values.to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy()
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for m, places in enumerate(masks):
                s = seeds_at(flat, places, m)
                hit = np.flatnonzero(might_contain(shared.value, s))
                row = np.searchsorted(ends, hit, side="right") - 1
                inside = hit + places[-1] < ends[row + 1]  # a window doesn't reach into the next document
                found.append((hit[inside], s[hit[inside]]))
            at = np.concatenate([f[0] for f in found])
            seed = np.concatenate([f[1] for f in found]).view(np.int64)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, seed = at[order], seed[order]
            row = np.searchsorted(ends, at, side="right") - 1
            rows, first = np.unique(row, return_index=True)
            cuts = np.append(first, len(row)).astype(np.int32)
            hits = pa.StructArray.from_arrays([pa.array((at - ends[row]).astype(np.int32)), pa.array(seed)], ["at", "seed"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists.take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(cuts), hits)], ["doc_id", "_t", "_hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc_id {kind}, _t array<bigint>, _hits array<struct<at:int,seed:bigint>>")


def holds_passage(item: list, doc: list, least: int, one_in: int = ONE_IN) -> bool:
    """True if ``doc`` has ``least`` consecutive tokens of ``item``, up to one in ``one_in`` of them changed, dropped or added."""
    where: dict = {}
    wanted = set(item)
    for j, w in enumerate(doc):
        if w in wanted:
            where.setdefault(w, []).append(j)
    runs: list[tuple[int, int, int]] = []  # start in item, start in doc, length
    n, m = len(item), len(doc)
    for i, w in enumerate(item):
        for j in where.get(w, ()):
            if i and j and item[i - 1] == doc[j - 1]:
                continue
            k = 1
            while i + k < n and j + k < m and item[i + k] == doc[j + k]:
                k += 1
            runs.append((i, j, k))
    runs.sort()
    most = max(1, n // one_in)

    def enough(span: int, edits: int) -> bool:
        length = max(span, least)
        return edits + (length - span) <= length // one_in

    by_start: dict[int, list[int]] = {}
    for x, (i, _, _) in enumerate(runs):
        by_start.setdefault(i, []).append(x)
    for x, (i0, j0, k0) in enumerate(runs):
        if k0 < 2 and least <= n:
            continue
        if enough(k0, 0):
            return True
        best = {(x, 0): 0}
        frontier = [(x, i0 + k0, j0 + k0, 0)]  # run, next in item, next in doc, edits
        while frontier:
            _, ie, je, edits = frontier.pop()
            for start in range(max(i0, ie - 3), ie + 4):
                for y in by_start.get(start, ()):
                    i, j, k = runs[y]
                    cut = max(ie - i, je - j, 0)
                    if cut >= k or j + cut - je > 3:
                        continue
                    i, j, k = i + cut, j + cut, k - cut
                    cost = edits + max(i - ie, j - je)
                    if cost == edits or cost > most:
                        continue
                    end = (y, i + k)
                    if best.get(end, most + 1) <= cost:
                        continue
                    best[end] = cost
                    if enough(i + k - i0, cost):
                        return True
                    frontier.append((y, i + k, j + k, cost))
    return False


@F.pandas_udf(T.BooleanType())
def _verified(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for item, doc, least in batches:
        yield pd.Series([holds_passage(a.tolist(), b.tolist(), int(n)) for a, b, n in zip(item, doc, least, strict=True)], dtype=bool)


def leaked_items(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id``: every document that holds a passage of a test item.

    Null and blank texts on either side hold nothing; an item shorter than the least passage can't leak. Repeated documents
    come out once each under their ids; a document repeated under the same id comes out once.
    """
    hashed = lambda text: F.transform(tokens(text), lambda t: F.xxhash64(t))
    chinese = F.length(F.regexp_replace(F.col("text"), f"[^{_ALONE}]", "")) * 2 > F.length("text")
    tests = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    tests = tests.select("item_id", hashed(F.col("text")).alias("_t"), F.when(chinese, LEAST_CHARACTERS).otherwise(LEAST_WORDS).alias("_least"))
    tests = cut_lineage(tests.where(F.size("_t") >= F.col("_least") - F.floor(F.col("_least") / ONE_IN)))
    test_seeds = cut_lineage(tests.select("item_id", F.explode(item_seeds("_t")).alias("_seed")).distinct())
    docs = documents.select(F.col(doc_col).alias("doc_id"), hashed(F.col(text_col)).alias("_t")).where("doc_id is not null")
    near = cut_lineage(_with_hits(docs, _bloom(test_seeds)))
    n_seeds = test_seeds.count()
    n_tokens = tests.agg(F.sum(F.size("_t") + 4)).first()[0] or 0

    def joined(rows: DataFrame, few: DataFrame, key: str, size: int) -> DataFrame:
        return rows.join(F.broadcast(few), key) if size <= BROADCAST_BYTES else spread_join(rows, few, [key], "doc_id")

    hits = near.select("doc_id", F.explode("_hits").alias("_x")).select("doc_id", F.col("_x.at").alias("_at"), F.col("_x.seed").alias("_seed"))
    pairs = joined(hits, test_seeds, "_seed", 16 * n_seeds).groupBy("doc_id", "item_id").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    found = near.select("doc_id", "_t").join(pairs, "doc_id")
    found = joined(found, tests.withColumnRenamed("_t", "_item"), "item_id", 8 * n_tokens)
    reach = F.size("_item") + 10
    first = F.greatest(F.col("_from") - reach, F.lit(0))
    found = found.withColumn("_part", F.slice("_t", first + 1, F.col("_to") + reach - first + 5))
    return found.where(_verified(F.col("_item"), F.col("_part"), F.col("_least"))).select("doc_id", "item_id").distinct()
