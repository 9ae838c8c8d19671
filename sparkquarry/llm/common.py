"""What the corpus operators share: shared-folder tables and whole texts as bytes in numpy."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that goes to a Python worker, at most (one longer row is a batch of its own).
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of Arrow batches to BATCH_BYTES, so that memory does not grow with the length of texts."""
    have = spark.conf.get(_BATCH_SETTING)
    if not have.rstrip("b").isdigit() or not 0 < int(have.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder serves a local session (tests); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="sparkquarry-")
    return base.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends here, and a
    lost executor costs only the tasks that read from it."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a side of a join may be broadcast.
BROADCAST_ROWS = 250_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most that many rows; beyond that the
    join shuffles both sides. For tables of narrow rows that are cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def crc_of_id(column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary array's bytes, concatenated, and the n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def text_blocks(batches, column: str, most: int):
    """Slices of the batches with whole texts of about ``most`` bytes together (one longer text is
    a slice of its own), each as (slice, bytes, offsets)."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        data, offsets = text_bytes(batch.column(i))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (along axis 0) in each [offsets[i], offsets[i+1]); 0 for an empty one."""
    out = np.zeros((len(offsets) - 1,) + values.shape[1:], np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=out.dtype)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of A-Z-lowered bytes, never across documents.

    Returns (64-bit hash of each word, document of each word, words per document).
    """
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n_docs, np.int64)
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * _power(_FACTOR, len(data)), out=total[1:])
    hashes = mix64((total[end] - total[start]) * _power(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(offsets, start, "right") - 1
    return hashes, doc, np.bincount(doc, minlength=n_docs)


def spans(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the maximal runs of one ``kind`` other than 0 (one number a byte), never across documents."""
    n = len(kind)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    first = np.append(True, kind[1:] != kind[:-1])
    first[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], n)
    inside = kind[start] != 0
    start, end = start[inside], end[inside]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each span of A-Z-lowered bytes; works on about ``most`` bytes at a time, so that a long text needs no more."""
    out, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + most, "right")))
        low, part = start[at], data[start[at] : end[to - 1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((LOWER[part].astype(np.uint64) + np.uint64(1)) * _power(_FACTOR, len(part)), out=total[1:])
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = mix64((total[e] - total[s]) * _power(_INVERSE, len(part))[s] + (e - s).astype(np.uint64))
        at = to
    return out
