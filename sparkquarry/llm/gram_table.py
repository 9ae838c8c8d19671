"""Prediction by partial matching whose contexts are all kept, as a Spark table.

Symbols are the 256 bytes and ``END``, which stands before and behind a text. A gram is a symbol behind the four
before it. Every gram of every text has a row with its count in the training texts; nothing is left out, so the
table grows with the corpus. Probabilities are those of ``ppm``: in each context of up to four symbols a symbol seen
there has c / (n + d), the escape d / (n + d) goes to the shorter context without the symbols seen, the shortest
is uniform.

Contexts that end alike depend on each other, so rows are dealt by the latest two symbols: a task holds all it needs of
orders 2 to 4, and orders 0 and 1 (257 * 257 counts at most) come from the driver. Tasks look the grams of the highest
counts up in a table of ``SLOTS``; all others meet their code lengths in a join.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

SYMBOLS, END, BITS, ORDER = 257, 256, 9, 4
#: Grams that tasks look up without a join, at most.
TOP_GRAMS = 500_000
SLOT_BITS = 21
#: Rows of whole contexts that a worker computes at a time.
ROWS = 200_000
HELD = 1 << BITS * (ORDER + 1)


def grams(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each position as one number: the four symbols before it, the latest in the high bits, then the symbol."""
    wide, starts = symbols.astype(np.int64), offsets[:-1]
    out, n = wide.copy(), len(wide)
    for k in range(1, ORDER + 1):
        past = np.empty(n, np.int64)
        past[k:] = wide[: max(0, n - k)]
        past[:k] = END
        for j in range(k):
            at = starts + j
            past[at[at < n]] = END
        out |= past << BITS * (ORDER + 1 - k)
    return out


def low_orders(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probabilities (symbol before, symbol) of order 1, from the counts by symbol before << BITS | symbol."""
    cells = np.zeros((SYMBOLS, SYMBOLS))
    cells[keys >> BITS, keys & (1 << BITS) - 1] = counts
    p = np.full((1, SYMBOLS), 1 / SYMBOLS)
    for c in (cells.sum(0, keepdims=True), cells):
        seen = c > 0
        n, d = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        unseen = np.where(seen, 0, p).sum(1, keepdims=True)
        total = np.where(d < SYMBOLS, n + d, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(n > 0, np.where(seen, c / total, d / total * p / unseen), p)
    return p


def code_lengths(keys: np.ndarray, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Code length of each gram; ``keys``, ascending: all grams that occur behind their latest two symbols."""
    symbol = keys & (1 << BITS) - 1
    p = low[keys >> BITS * ORDER, symbol]
    for order in range(2, ORDER + 1):
        cells, first, of = np.unique((keys >> BITS * (ORDER + 1 - order)) << BITS | symbol, return_index=True, return_inverse=True)
        c, shorter, context = np.bincount(of, counts, len(cells)), p[first], cells >> BITS
        new = np.append(True, context[1:] != context[:-1])
        at, group, seen = np.flatnonzero(new), np.cumsum(new) - 1, c > 0
        n, d = np.add.reduceat(c, at), np.add.reduceat(seen.astype(np.int64), at)
        # the sum of the unseen cells at hand bounds what rounding may take away
        unseen = np.maximum(1 - np.add.reduceat(np.where(seen, shorter, 0), at), np.add.reduceat(np.where(seen, 0, shorter), at))
        unseen = np.maximum(unseen, 1e-15)
        total = np.where(d < SYMBOLS, n + d, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(seen, c / total[group], (d / total / unseen)[group] * shorter)
        p = np.where(n[group] > 0, own, shorter)[of]
    return -np.log2(p)


def lengths_table(counted: DataFrame) -> DataFrame:
    """(gram, uses, bits) of every gram; ``counted``: key (HELD is set in those of held-out texts) and n."""
    gram = F.col("key").bitwiseAND(HELD - 1)
    found = counted.groupBy(gram.alias("gram")).agg(F.sum("n").alias("uses"), F.sum(F.when(F.col("key") < HELD, F.col("n")).otherwise(0)).alias("n"))
    found = shared_table(found, "grams")
    symbol = F.col("gram").bitwiseAND((1 << BITS) - 1)
    pair = F.shiftleft(F.shiftright("gram", BITS * ORDER), BITS).bitwiseOR(symbol)
    few = found.where("n > 0").groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    low = low_orders(few.column("pair").to_numpy(), few.column("n").to_numpy())
    held_low = counted.sparkSession.sparkContext.broadcast(low)
    latest = BITS * (ORDER - 1)

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        rows, most = 0, ROWS

        def done(whole: bool):
            nonlocal held, rows, most
            gram, uses, n = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(gram) if whole else int(np.searchsorted(gram, gram[-1] >> latest << latest))
            held, rows = [(gram[cut:], uses[cut:], n[cut:])], len(gram) - cut
            most = max(ROWS, 2 * rows)
            if cut:
                bits = code_lengths(gram[:cut], n[:cut], held_low.value)
                yield pa.RecordBatch.from_arrays([pa.array(gram[:cut]), pa.array(uses[:cut]), pa.array(bits)], names=["gram", "uses", "bits"])

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
                rows += batch.num_rows
                if rows >= most:
                    yield from done(False)
        if rows:
            yield from done(True)

    dealt = found.select("gram", "uses", "n", F.shiftright("gram", latest).alias("latest")).repartition("latest").drop("latest")
    return shared_table(dealt.sortWithinPartitions("gram").mapInArrow(run, "gram long, uses long, bits double"), "gram-lengths")


@dataclass
class TopGrams:
    """Grams of high counts by slot of their hash; of those in one slot the most used stays here."""

    keys: np.ndarray
    bits: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def of(cls, lengths: DataFrame, most: int = TOP_GRAMS) -> "TopGrams":
        scale = F.floor(F.log2("uses") * 8).cast("int")  # sizes of counts, so that no sort meets the whole table
        least, total = None, 0
        for size, n in sorted(((r["size"], r["n"]) for r in lengths.groupBy(scale.alias("size")).agg(F.count("*").alias("n")).collect()), reverse=True):
            total += n
            if total > most:
                break
            least = size
        found = lengths.where(scale >= least if least is not None else F.lit(False)).toArrow()
        keys, uses, bits = (found.column(c).to_numpy() for c in ("gram", "uses", "bits"))
        order = np.lexsort((keys, -uses))
        order = order[np.sort(np.unique(slots(keys[order]), return_index=True)[1])]
        return cls(keys[order], bits[order])

    def look_up(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code lengths, 0 where unknown; which are known)."""
        held = _tables.get(self.name)
        if held is None:
            keys, bits = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS)
            at = slots(self.keys)
            keys[at], bits[at] = self.keys, self.bits
            _tables.clear()  # one model at a time in a worker
            _tables[self.name] = held = (keys, bits)
        at = slots(grams)
        known = held[0][at] == grams
        return np.where(known, held[1][at], 0.0), known


def slots(grams: np.ndarray) -> np.ndarray:
    return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
