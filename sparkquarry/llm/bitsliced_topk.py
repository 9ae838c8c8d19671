"""Exact top-k search on a bit-sliced index.

Vectors are quantised to floor(scale * x) and kept in shards of bounded size. In a shard the top
``slice_bits`` bits of each attribute become bit slices: bitmaps over the shard's rows, in id order.
For a query the slices are multiplied by small integer weights and added with bitmap arithmetic
(ripple-carry adders on whole bitmaps) to a bit-sliced lower bound of each score. The k best bounds
are selected from the most significant slice downward; every row whose upper bound reaches the k-th
best lower bound is a boundary row and is resolved by its exact integer score. Shard results, k a
query at most, meet in a ranked window.

Queries are dealt in blocks to all shards, so neither side of a task is unbounded. Null vectors and
vectors with null or non-finite components, or of another length than the first of the shard pair,
take no part. Ties go to the smaller id; equal vectors are found each for itself. A query never finds
rows of its own id. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

SCHEMA = "query_id long, vec_id long, score long"


def bit_slices(values: np.ndarray, bits: int) -> np.ndarray:
    """Slices (attributes, bits, words) of unsigned values (rows, attributes), least significant first."""
    rows, attributes = values.shape
    words = -(-rows // 64)
    padded = np.zeros((words * 64, attributes), np.uint64)
    padded[:rows] = values
    out = np.empty((attributes, bits, words), np.uint64)
    for b in range(bits):
        plane = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[:, b] = np.ascontiguousarray(np.packbits(plane.T, axis=1, bitorder="little")).view(np.uint64)
    return out


def add_shifted(total: np.ndarray, slices: np.ndarray, shift: int) -> None:
    """Adds ``slices`` * 2**shift to the bit-sliced ``total`` (planes, words), in place."""
    carry = np.zeros_like(total[0])
    for k in range(shift, len(total)):
        if k - shift < len(slices):
            x = slices[k - shift]
            half = total[k] ^ x
            carry, total[k] = (total[k] & x) | (carry & half), half ^ carry
        else:
            total[k], carry = total[k] ^ carry, total[k] & carry
            if not carry.any():
                break


def select_top(total: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the rows with the k largest sums, ties at the boundary included."""
    sure, open_ = np.zeros_like(valid), valid.copy()
    have = 0
    for plane in total[::-1]:
        above = open_ & plane
        n = int(np.bitwise_count(above).sum())
        if have + n >= k:
            open_ = above
        else:
            sure |= above
            have += n
            open_ &= ~plane
    return sure | open_


def _rows(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


class SliceIndex:
    """The bit-sliced index of one shard."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, slice_bits: int, weight_bits: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.least = self.values.min(0)
        span = int((self.values - self.least).max())
        self.low_bits = max(0, span.bit_length() - slice_bits)
        self.high = (self.values - self.least) >> self.low_bits
        self.low_most = ((self.values - self.least) & ((1 << self.low_bits) - 1)).max(0)
        self.slices = bit_slices(self.high.astype(np.uint64), slice_bits)
        self.flipped = bit_slices((self.high.max(0) - self.high).astype(np.uint64), slice_bits)
        self.high_most = self.high.max(0)
        self.slice_bits, self.weight_bits = slice_bits, weight_bits

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows of this shard."""
        ids, n = self.ids, len(self.ids)
        words = self.slices.shape[2]
        shift = max(0, int(np.abs(query).max()).bit_length() - self.weight_bits)
        weight = np.abs(query) >> shift
        planes = int(np.sum(weight * ((1 << self.slice_bits) - 1))).bit_length() + 1
        total = np.zeros((planes, words), np.uint64)
        for d in np.flatnonzero(weight):
            source = self.slices[d] if query[d] > 0 else self.flipped[d]
            for b in range(int(weight[d]).bit_length()):
                if weight[d] >> b & 1:
                    add_shifted(total, source, b)
        valid = np.zeros(words * 64, np.uint8)
        valid[:n] = ids != query_id
        valid = np.packbits(valid, bitorder="little").view(np.uint64)
        # score = base + 2**(low_bits+shift) * sum + rest, with 0 <= rest <= slack
        best = _rows(select_top(total, valid, k), n)
        if not len(best):
            return best, best
        sums = np.zeros(n, np.int64)
        for p, plane in enumerate(total):
            sums += np.unpackbits(plane.view(np.uint8), bitorder="little")[:n].astype(np.int64) << p
        low_q = np.abs(query) - (weight << shift)
        slack = int(np.sum(low_q * self.high_most) << self.low_bits) + int(np.sum(np.abs(query) * self.low_most))
        unit = 1 << (self.low_bits + shift)
        floor = np.sort(sums[best])[::-1][min(k, len(best)) - 1]
        reach = floor - -(-2 * slack // unit) - 1
        rows = np.flatnonzero((sums >= reach) & (ids != query_id))
        exact = self.values[rows] @ query
        order = np.lexsort((ids[rows], -exact))[:k]
        return ids[rows][order], exact[order]


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a long; null where a component is null or not finite."""
    x = lambda v: v.cast("double") * scale
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(vector, lambda v: F.floor(x(v)).cast("long")))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, *, scale: int = 1024, rows_per_shard: int = 16_384, queries_per_block: int = 4_096,
    slice_bits: int = 6, weight_bits: int = 6, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each query row."""
    base = shared_table(
        vectors.select(vectors[id_col].cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), quantised(vectors[vector_col], scale).alias("v"))
        .where("v IS NOT NULL AND vec_id IS NOT NULL"),
        "vectors",
    )
    rows, asked = base.agg(F.count("*"), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0))).first()
    shards, blocks = max(1, math.ceil(rows / rows_per_shard)), max(1, math.ceil(asked / queries_per_block))
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = base.select("vec_id", "v", spread(shards, 1).alias("shard"), all_(blocks).alias("block"))
    queries = base.where("is_query").select("vec_id", "v", spread(blocks, 2).alias("block"), all_(shards).alias("shard"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            def arrays(t):
                v = t.column("v").combine_chunks()
                return t.column("vec_id").to_numpy(), np.diff(v.offsets.to_numpy()), v

            ids, sizes, values = arrays(left)
            q_ids, q_sizes, q_values = arrays(right)
            flat, q_flat = values.flatten().to_numpy(), q_values.flatten().to_numpy()
            starts, q_starts = np.cumsum(sizes) - sizes, np.cumsum(q_sizes) - q_sizes
            for size in np.unique(sizes):
                rows, asked = np.flatnonzero(sizes == size), np.flatnonzero(q_sizes == size)
                if not len(asked):
                    continue
                index = SliceIndex(ids[rows], flat[starts[rows][:, None] + np.arange(size)], slice_bits, weight_bits)
                for i in asked:
                    found, score = index.top(int(q_ids[i]), q_flat[q_starts[i] : q_starts[i] + size], k)
                    out_q.append(np.full(len(found), q_ids[i]))
                    out_v.append(found)
                    out_s.append(score)
        cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
        return pa.table({"query_id": cat(out_q), "vec_id": cat(out_v), "score": cat(out_s)})

    found = candidates.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(search, SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
