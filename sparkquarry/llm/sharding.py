"""Sharding: sampled splitters.

Records get a key (hash of the text, then the id), so equal texts lie together and no key is hot.
A size-weighted sample of keys gives quantile boundaries of fine ranges; ranges that hold too many
bytes are subdivided from a denser sample of their own. Exact totals of the ranges then give each
record its place in the whole order, and shards are cut at equal shares of the bytes, so sizes
differ by little more than one record.

Only ids, sizes and hashes are shuffled, never texts. Null text: no bytes, size 1. A null id sorts
first. Equal rows are told apart by their place alone. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_table

LEAST = -(1 << 63)


def _range_of(splitters: list[tuple[int, int]]):
    """A vectorised function from (key, id) to the number of splitters that are not greater."""
    keys = np.array([k for k, _ in splitters], np.int64)
    ids = np.array([i for _, i in splitters], np.int64)

    @F.pandas_udf(T.IntegerType())
    def find(key: pd.Series, doc: pd.Series) -> pd.Series:
        k, d = key.to_numpy(np.int64), doc.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = low.copy()
        for x in np.unique(low[high > low]):  # keys that splitters cut: go on by id
            rows = np.flatnonzero((low == x) & (high > low))
            out[rows] = x + np.searchsorted(ids[x : high[rows[0]]], d[rows], "right")
        return pd.Series(out.astype(np.int32))

    return find


def _quantiles(sample: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Up to n-1 boundaries that cut the sorted sample into n equal parts."""
    sample = sorted(sample)
    return sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []


def shard_documents(
    docs: DataFrame, shards: int = 16, *, rows_per_range: int = 50_000, per_range: int = 32, rounds: int = 4,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, group_key and range of every row.

    ``rows_per_range``: mean rows of a fine range (at least 64 and at most 65,536 ranges are made);
    ``per_range``: expected sample keys of each; a range over twice the mean bytes is subdivided.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = shared_table(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group_key"),
            F.coalesce(docs[id_col].cast("long"), F.lit(LEAST)).alias("sort_id"),
        ),
        "sharding-base",
    )
    rows, total = base.agg(F.count("*"), F.sum("size")).first()
    total = total or 0
    ranges = min(65_536, max(64, math.ceil((rows or 0) / rows_per_range)))
    chance = (F.xxhash64("sort_id", "group_key", F.lit(17)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)

    def sample(df: DataFrame, rate: float) -> list[tuple[int, int]]:
        """Keys drawn with a chance in proportion to their size (at most 1)."""
        found = df.where(chance < F.least(F.lit(1.0), F.col("size") * F.lit(rate))).select("group_key", "sort_id")
        return [tuple(x) for x in found.collect()]

    splitters = _quantiles(sample(base, ranges * per_range / max(total, 1)), ranges)
    for k in range(rounds):
        placed = base.withColumn("range", _range_of(splitters)("group_key", "sort_id"))
        held = {r["range"]: r["bytes"] for r in placed.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}
        over = {i: b for i, b in held.items() if b > 2 * total / ranges}
        if not over or k == rounds - 1:
            break
        rate = ranges * per_range * 4 ** (k + 1) / total
        drawn = sample(placed.where(F.col("range").isin(list(over))), rate)
        more, by_range = set(splitters), {}
        for key in drawn:
            by_range.setdefault(bisect_right(splitters, key), []).append(key)
        for i, keys in by_range.items():
            more.update(_quantiles(keys, math.ceil(over.get(i, 0) * ranges / total)))
        if len(more) == len(splitters):
            break
        splitters = sorted(more)

    in_range = Window.partitionBy("range").orderBy("group_key", "sort_id")
    ranked = base.withColumn("range", _range_of(splitters)("group_key", "sort_id"))
    totals = ranked.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b")).orderBy("range").collect()
    rows_before, bytes_before, before = {}, {}, [0, 0]
    for r in totals:
        rows_before[r["range"]], bytes_before[r["range"]] = before
        before = [before[0] + r["n"], before[1] + r["b"]]
    starts = base.sparkSession.createDataFrame(
        [(i, rows_before[i], bytes_before[i]) for i in rows_before] or [(0, 0, 0)], "range int, rows_before long, bytes_before long"
    )
    placed = (
        ranked.withColumns({"row": F.row_number().over(in_range).cast("long"), "upto": F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0))})
        .join(starts, "range")
        .select(
            "doc_id", "size", "text_crc32", "group_key", "range",
            (F.col("rows_before") + F.col("row") - 1).alias("place"),
            F.least(F.lit(shards - 1), F.floor((F.col("bytes_before") + F.col("upto") - F.col("size") / 2) * shards / max(total, 1))).cast("int").alias("shard"),
        )
    )
    placed = shared_table(placed, "sharding-placed")
    first = {r["shard"]: r["p"] for r in placed.groupBy("shard").agg(F.min("place").alias("p")).collect()}
    begins = F.lit([first.get(i, 0) for i in range(shards)])
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - begins[F.col("shard")]).cast("long").alias("slot"), "group_key", "range"
    )
