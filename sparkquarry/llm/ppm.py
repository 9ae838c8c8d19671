"""Prediction by partial matching over bytes, with frozen statistics, for several models at once.

Symbols are the 256 bytes; 0xFF, which no UTF-8 text holds, stands for what lies before a text. A trie
of contexts of up to three bytes, shared by all models, keeps those of the greatest share of any model's
training bytes, summed over the models, so that a model of few texts gets its contexts too; it is closed
under dropping the oldest byte. In each node a byte seen there has probability c / (n + d) (n: count, d:
distinct bytes; escape method C); the escape d / (n + d) goes to the shorter context, where the bytes already
seen are excluded. Probabilities of a node add up to 1.

Counting runs over all training texts in two passes: contexts, then (model, node, byte) cells. The most
telling contexts are taken in Spark; what reaches the driver is bounded by nodes * 256 cells a model.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table, sums, text_blocks

SYMBOLS, END, ORDER, BITS = 256, 255, 3, 8
#: Bytes of text that a worker handles at a time.
BLOCK = 1 << 20
#: Positions whose code lengths are held at a time.
STEP = 1 << 18
#: Nodes of a trie whose codes are computed at a time.
NODES_AT_ONCE = 2048
#: Keys whose counts a worker holds before they go to Spark.
MOST_KEYS = 1_000_000


def contexts(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes before each position as one number, the latest in the low bits; what lies before a text is END."""
    n, out = len(symbols), np.zeros(len(symbols), np.uint32)
    starts = offsets[:-1]
    for k in range(ORDER):
        past = np.full(n, END, np.uint32)
        past[k + 1 :] = symbols[: max(0, n - k - 1)]
        for j in range(k + 1):
            at = starts + j
            past[at[at < n]] = END
        out |= past << np.uint32(BITS * k)
    return out


@dataclass
class Trie:
    """Contexts by order; node 0 is the empty context."""

    codes: list[np.ndarray]  # of orders 1..ORDER, ascending
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        self.first = np.cumsum([1, *map(len, self.codes)])  # first node of orders 1.. and the number of nodes
        self.size = int(self.first[-1])
        if self.size > 1 << 16:
            raise ValueError("a trie has at most 65,536 nodes")

    def nodes(self, order: int) -> slice:
        return slice(int(self.first[order - 1]), int(self.first[order])) if order else slice(0, 1)

    def parents(self, order: int) -> np.ndarray:
        if order == 1:
            return np.zeros(len(self.codes[0]), np.int64)
        return self.first[order - 2] + np.searchsorted(self.codes[order - 2], self.codes[order - 1] & np.uint32((1 << BITS * (order - 1)) - 1))

    def table(self) -> np.ndarray:
        """The deepest node of each of the 256**3 contexts."""
        held = _tables.get(self.name)
        if held is None:
            held = np.zeros(1, np.uint16)
            for k, codes in enumerate(self.codes):
                held = np.tile(held, SYMBOLS)
                held[codes] = np.arange(self.first[k], self.first[k + 1])
            _tables.clear()  # one model at a time in a worker
            _tables[self.name] = held
        return held

    def full(self, counts: np.ndarray) -> np.ndarray:
        """Counts (nodes, SYMBOLS) of every node, from those of the deepest nodes."""
        for k in range(ORDER, 0, -1):
            np.add.at(counts, self.parents(k), counts[self.nodes(k)])
        return counts

    def bits(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths of each byte in each node, and in each node what a byte unseen there takes beyond its code in the parent."""
        p, escape = np.empty_like(counts), np.zeros(self.size)
        for k in range(ORDER + 1):
            nodes, parents = self.nodes(k), self.parents(k) if k else None
            # some nodes at a time: what is held beside the counts and the codes does not grow with them
            for at in range(nodes.start, nodes.stop, NODES_AT_ONCE):
                own = slice(at, min(at + NODES_AT_ONCE, nodes.stop))
                c = counts[own]
                shorter = p[parents[own.start - nodes.start : own.stop - nodes.start]] if k else np.full((1, SYMBOLS), 1 / SYMBOLS)
                n, seen = c.sum(1, keepdims=True), c > 0
                d = seen.sum(1, keepdims=True)
                unseen = np.where(seen, 0, shorter).sum(1, keepdims=True)
                open_ = unseen > 0
                total = np.where(open_, n + d, n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    part = np.where(open_, d / total / unseen, 0)
                    p[own] = np.where(n > 0, np.where(seen, c / total, part * shorter), shorter)
                    escape[own] = np.where((n > 0) & open_, -np.log2(part), 0)[:, 0]
        np.maximum(p, 1e-300, out=p)
        return np.negative(np.log2(p, out=p), out=p), escape


_tables: dict[str, np.ndarray] = {}


def free_tables() -> None:
    """At the end of a task: a worker that lives on holds no table meanwhile."""
    _tables.clear()


@dataclass
class Codes:
    """Code lengths of several models over one trie: a row of ``cells`` for each byte that some model saw in a node."""

    trie: Trie
    index: np.ndarray  # (nodes * SYMBOLS): the row, or -1
    cells: np.ndarray  # (rows, models)
    escape: np.ndarray  # (nodes, models)
    parent: np.ndarray  # (nodes)

    @classmethod
    def of_cells(cls, trie: Trie, keys: np.ndarray, counts: np.ndarray, models: int) -> "Codes":
        """keys: (model * nodes + node) * SYMBOLS + byte, of the deepest nodes."""
        size = trie.size * SYMBOLS
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        cut = np.searchsorted(keys, size * np.arange(models + 1))

        def full(model: int) -> np.ndarray:
            own = np.zeros(size)
            own[keys[cut[model] : cut[model + 1]] - model * size] = counts[cut[model] : cut[model + 1]]
            return trie.full(own.reshape(trie.size, SYMBOLS))

        seen = np.zeros((trie.size, SYMBOLS), bool)
        seen[0] = True
        for m in range(models):
            seen |= full(m) > 0
        rows = np.flatnonzero(seen)
        index = np.full(size, -1, np.int32)
        index[rows] = np.arange(len(rows))
        cells, escape = np.zeros((len(rows), models), np.float32), np.zeros((trie.size, models), np.float32)
        for m in range(models):
            bits, escape[:, m] = trie.bits(full(m))
            cells[:, m] = bits.ravel()[rows]
        parent = np.concatenate([np.zeros(1, np.int64), *(trie.parents(k) for k in range(1, ORDER + 1))])
        return cls(trie, index, cells, escape, parent)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each model (texts, models)."""
        nodes = self.trie.table()[contexts(data, offsets)]
        out = np.zeros((len(offsets) - 1, self.cells.shape[1]))
        for start in range(0, len(data), STEP):
            symbol = data[start : start + STEP].astype(np.int64)
            node = nodes[start : start + STEP].astype(np.int64)
            row = self.index[node * SYMBOLS + symbol]
            value = self.cells[np.maximum(row, 0)]
            left = np.flatnonzero(row < 0)
            value[left] = 0
            while len(left):
                value[left] += self.escape[node[left]]
                node[left] = self.parent[node[left]]
                row = self.index[node[left] * SYMBOLS + symbol[left]]
                value[left[row >= 0]] += self.cells[row[row >= 0]]
                left = left[row < 0]
            stop = start + len(symbol)
            inside = slice(max(0, int(np.searchsorted(offsets, start, "right")) - 1), int(np.searchsorted(offsets, stop, "left")) + 1)
            own = np.clip(offsets[inside], start, stop) - start
            out[inside.start : inside.start + len(own) - 1] += sums(value, own)
        return out


def _counted(docs: DataFrame, text: str, key_of, schema: str = "key long, n long"):
    """Counts of keys over whole texts: summed in each task, then by Spark. ``key_of``: (slice, bytes, offsets) to keys."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys = np.concatenate([k for k, _ in held])
            counts = np.concatenate([c for _, c in held])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[at], np.add.reduceat(counts, at)

        def sent(keys, counts):
            for at in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 200_000].astype(np.int64)), pa.array(counts[at : at + 200_000].astype(np.int64))], names=["key", "n"])

        for part, data, offsets in text_blocks(batches, text, BLOCK):
            keys = np.sort(key_of(part, data, offsets))
            if len(keys):
                at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                held.append((keys[at], np.diff(np.append(at, len(keys)))))
            if len(held) >= 12:
                held = [merged()]
                if len(held[0][0]) > MOST_KEYS:
                    yield from sent(*held.pop())
        free_tables()
        if held:
            yield from sent(*merged())

    return docs.mapInArrow(run, schema).groupBy("key").agg(F.sum("n").alias("n"))


def arrays(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a bounded count table."""
    found = counted.toArrow()
    return found.column("key").to_numpy(), found.column("n").to_numpy()


def _models(part, group: str, offsets: np.ndarray) -> np.ndarray:
    """The model of each byte of a block."""
    of = part.column(part.schema.get_field_index(group)).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(of, np.diff(offsets))


def choose_contexts(docs: DataFrame, text: str, read, group: str, most: int) -> Trie:
    """The trie of the ``most`` - 1 contexts of the greatest shares; ``read``: bytes as the model reads them."""
    counted = _counted(docs, text, lambda part, data, offsets: contexts(read(data), offsets) | _models(part, group, offsets) << BITS * ORDER)
    counted = shared_table(counted.select((F.shiftright("key", BITS * ORDER)).alias("model"), F.col("key").bitwiseAND((1 << BITS * ORDER) - 1).alias("code"), "n"), "contexts")
    totals = F.broadcast(counted.groupBy("model").agg(F.sum("n").alias("total")))  # a row a model
    # whole numbers, so that a context's share is never under that of a longer one
    share = F.floor(F.col("n") / F.col("total") * float(1 << 50)).alias("share")
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("order"), F.col("code").bitwiseAND((1 << BITS * k) - 1).alias("code")) for k in range(1, ORDER + 1)])).alias("c")
    shares = counted.join(totals, "model").select(share, ends).groupBy("c.order", "c.code").agg(F.sum("share").alias("share"))
    top = shares.orderBy(F.desc("share"), "order", "code").limit(most - 1).select("order", "code").toArrow()
    order, code = (top.column(c).to_numpy() for c in ("order", "code"))
    return Trie([np.sort(code[order == k]).astype(np.uint32) for k in range(1, ORDER + 1)])


def count_cells(docs: DataFrame, text: str, read, group: str, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Keys ((model * nodes + node) * SYMBOLS + byte) of the deepest nodes and their counts."""

    def key_of(part, data, offsets):
        data = read(data)
        nodes = trie.table()[contexts(data, offsets)].astype(np.int64)
        return (_models(part, group, offsets) * trie.size + nodes) * SYMBOLS + data

    return arrays(_counted(docs, text, key_of))
