"""Suffix-array dedup: removes every byte covered by a ``length``-byte string that starts elsewhere too.

All strings of ``length`` bytes are judged, over all texts and within one. They are dealt to shards by
content: the key of a string is the smallest hash of the 32-byte strings in it, so equal strings
have equal keys, and consecutive strings with one key form a run whose bytes are a snippet. Snippets
whose key occurs once can't repeat and go no further. Equal snippets are merged with their number (one
that has its key alone then repeats as a whole), shards of whole keys are sorted by induced sorting, and permuted common prefixes tell which starts
share ``length`` bytes with another start.

A key with too many bytes for one shard (a passage in very many documents, each with its own
surroundings) is split by where the strings lie around the key's place and by the bytes that all
strings of such a cell have in common, into cells of 64, 8, then 1 starts; at 1 a cell is a string,
and equal ones merge. So no shard grows with a hot passage, and no string is dropped or capped.

Null texts are empty; texts shorter than ``length`` keep all bytes. Rows equal in id and text count as
several documents: they remove each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, shared_table, text_blocks
from .sais import permuted_common_prefixes, suffix_array, words_at

GRAM, PLACE_BITS = 32, 26
BLOCK = 1 << 20
#: Bytes of snippets that one suffix array holds, and those of one key from which it is split.
SHARD_BYTES, KEY_BYTES = 1 << 20, 1 << 18
CELLS = (64, 8, 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    w = words_at(data)
    n = len(data) - GRAM + 1
    out = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, factor in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0x27D4EB2F165667C5)):
        out += w[k : k + n] * np.uint64(factor)
    return mix64(out)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one key: (text, first start, number of starts, place of the key, key), places within the text."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64)
    hashes = _gram_hashes(data)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = _sliding_least((hashes & ~mask) | (np.arange(len(hashes), dtype=np.uint64) & mask), length - GRAM + 1)
    place = (least & mask).astype(np.int64)
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes >= length)
    steps = np.zeros(len(place) + 1, np.int64)
    np.add.at(steps, offsets[full], 1)
    np.add.at(steps, offsets[full + 1] - length + 1, -1)
    valid = np.cumsum(steps[:-1]) > 0
    first = valid.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    first[offsets[full]] = True
    start = np.flatnonzero(first)
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(place)), offsets[doc + 1] - length + 1)
    at = place[start] if len(data) <= 1 << PLACE_BITS else start + ((place[start] - start) & int(mask))
    return doc, start - offsets[doc], end - start, at - offsets[doc], hashes[at]


def _content(data: bytes) -> tuple[int, int]:
    """128 bits of a hash of the bytes as two signed numbers."""
    digest = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _ranges(marked: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True as (first, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def repeated_starts(snippets: list[bytes], times: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each snippet the ranges of starts whose ``length`` bytes start elsewhere too; ``times``: how often a snippet occurs."""
    sizes = np.array([len(s) for s in snippets], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    data = np.frombuffer(b"\0".join(snippets) + b"\0\0", np.uint8)
    symbols = data.astype(np.int64) + 2
    symbols[ends], symbols[-1] = 1, 0
    begins = ends - sizes
    of = np.repeat(np.arange(len(snippets)), sizes + 1)
    left = np.append(ends[of] - np.arange(len(of)), 0)
    sa = suffix_array(symbols, 258)
    shared = permuted_common_prefixes(data, left, sa)[sa]
    head = np.flatnonzero(shared < length)  # suffixes up to the next head share ``length`` bytes
    weight = np.append(np.array(times, np.int64)[of], 0)[sa]
    total = np.repeat(np.add.reduceat(weight, head), np.diff(np.append(head, len(sa))))
    again = np.zeros(len(sa), bool)
    again[sa] = (total >= 2) & (left[sa] >= length)
    return [_ranges(again[b:e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]


_SORTED = "c1 long, c2 long, ranges array<struct<a:int,b:int>>"


def _sort_shards(pieces: DataFrame, length: int, total_bytes: int) -> DataFrame:
    """Repeated ranges of the pieces (key, c1, c2, n, bytes); all pieces of a key in one shard."""

    def run(batches):
        held, size, last = [], 0, None

        def flush():
            found = repeated_starts([x[3] for x in held], [x[2] for x in held], length)
            rows = [(x[0], x[1], r) for x, r in zip(held, found, strict=True) if r]
            c1, c2, ranges = zip(*rows, strict=True) if rows else ((), (), ())
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in r] for r in ranges], kind)], names=["c1", "c2", "ranges"])

        for batch in batches:
            for key, *piece in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != last and size >= SHARD_BYTES:
                    yield flush()
                    held, size = [], 0
                held.append(piece)
                size += len(piece[3])
                last = key
        if held:
            yield flush()

    shards = max(1, -(-total_bytes // (4 * SHARD_BYTES)))
    spread = pieces.select("key", "c1", "c2", "n", "bytes").repartition(int(shards), "key").sortWithinPartitions("key")
    return spread.mapInArrow(run, _SORTED)


def _cut(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """Cells of ``width`` starts: (key, c1, c2, n, bytes, place, p1, p2, base) with the piece they come from."""

    def run(batches):
        for batch in batches:
            rows = []
            for c1, c2, n, data, place in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                starts = len(data) - length + 1
                at = 0
                while at < starts:
                    cell = (place - at) // width
                    low, high = cell * width, min(cell * width + width, length - GRAM + 1) - 1
                    to = min(starts, place - low + 1)
                    common = data[place - low : place - high + length]
                    key = _content(cell.to_bytes(4, "little") + common)[0]
                    part = data[at : to + length - 1]
                    rows.append((key, *_content(part), n, part, place - at, c1, c2, at))
                    at = to
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 4 else pa.int32() if i in (5, 8) else pa.int64()) for i, c in enumerate(columns)], names=["key", "c1", "c2", "n", "bytes", "place", "p1", "p2", "base"])

    return pieces.select("c1", "c2", "n", "bytes", "place").mapInArrow(run, "key long, c1 long, c2 long, n long, bytes binary, place int, p1 long, p2 long, base int")


def _merged(pieces: DataFrame) -> DataFrame:
    """Equal pieces of a key as one, with their number; keys with one occurrence go."""
    merged = pieces.groupBy("key", "c1", "c2").agg(F.sum("n").alias("n"), F.first("bytes", ignorenulls=True).alias("bytes"), F.first("place").alias("place"))
    return shared_table(merged, "suffix-pieces")


def _classify(pieces: DataFrame, widths: tuple[int, ...], length: int) -> DataFrame:
    by_key = pieces.groupBy("key").agg(F.sum("n").alias("times"), F.sum(F.octet_length("bytes")).alias("size"), F.count("*").alias("contents"))
    live = by_key.where("times >= 2")
    several = live.where("contents >= 2")
    total = several.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    # one content that occurs again: each of its strings does
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("starts").alias("b")))
    measured = pieces.select("key", "c1", "c2", (F.octet_length("bytes") - length + 1).cast("int").alias("starts"))  # no bytes go to the join
    alike = measured.join(live.where("contents = 1"), "key").select("c1", "c2", whole.alias("ranges"))
    return alike.unionByName(_sort_keys(pieces.join(several, "key"), total, widths, length))


def _sort_keys(pieces: DataFrame, total, widths: tuple[int, ...], length: int) -> DataFrame:
    """Repeated ranges of pieces whose keys have several contents; keys of more than KEY_BYTES go on in cells."""
    if not widths or total[1] <= KEY_BYTES:
        return _sort_shards(pieces, length, total[0])
    cells = shared_table(_cut(pieces.where(F.col("size") > KEY_BYTES), widths[0], length), "suffix-cells")
    inner = _classify(_merged(cells), widths[1:], length)
    back = (
        cells.select("c1", "c2", "p1", "p2", "base").join(inner, ["c1", "c2"])
        .select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), F.transform("ranges", lambda r: F.struct((r["a"] + F.col("base")).alias("a"), (r["b"] + F.col("base")).alias("b"))).alias("ranges"))
    )
    return _sort_shards(pieces.where(F.col("size") <= KEY_BYTES), length, total[0]).unionByName(back)


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def dedup(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs as byte ranges) and kept (bytes) of every row."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", *_text_key(F.col("text")))
    long_ = docs.where(F.octet_length("text") >= length).select("t1", "t2", "text")

    def runs(batches):
        for part, data, offsets in text_blocks(batches, "text", BLOCK):
            doc, start, starts, _, key = runs_of(data, offsets, length)
            t1, t2 = (part.column(i).to_numpy()[doc] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(t1), pa.array(t2), pa.array(start.astype(np.int32)), pa.array(starts.astype(np.int32))], names=["key", "t1", "t2", "start", "starts"])

    found = shared_table(long_.mapInArrow(runs, "key long, t1 long, t2 long, start int, starts int"), "suffix-runs")
    keys = found.groupBy("key").agg(F.count("*").alias("times")).where("times >= 2").select("key")
    live = found.join(keys, "key", "left_semi").groupBy("t1", "t2").agg(F.collect_set("start").alias("live"))

    def snippets(batches):
        for part, data, offsets in text_blocks(batches, "text", BLOCK):
            doc, start, starts, place, key = runs_of(data, offsets, length)
            wanted = part.column(3)
            live_doc = np.repeat(np.arange(part.num_rows), wanted.value_lengths().fill_null(0).to_numpy())
            live_start = wanted.flatten().to_numpy()
            scale = int(max(start.max(initial=0), live_start.max(initial=0))) + 1
            kept = np.flatnonzero(np.isin(doc * scale + start, live_doc * scale + live_start))
            t1, t2 = (part.column(i).to_numpy() for i in (0, 1))
            raw, sent, rows = data.tobytes(), set(), []
            for i in kept.tolist():
                at = int(offsets[doc[i]] + start[i])
                piece = raw[at : at + int(starts[i]) + length - 1]
                content = _content(piece)
                rows.append((*content, None if content in sent else piece))
                sent.add(content)
            c1, c2, pieces = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[kept].view(np.int64)), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(np.ones(len(kept), np.int64)), pa.array(pieces, pa.binary()), pa.array((place - start)[kept].astype(np.int32)), pa.array(t1[doc[kept]]), pa.array(t2[doc[kept]]), pa.array(start[kept].astype(np.int32))],
                names=["key", "c1", "c2", "n", "bytes", "place", "t1", "t2", "start"],
            )

    snips = shared_table(
        long_.join(live, ["t1", "t2"]).select("t1", "t2", "text", "live").mapInArrow(snippets, "key long, c1 long, c2 long, n long, bytes binary, place int, t1 long, t2 long, start int"),
        "suffix-snippets",
    )
    repeated = _classify(_merged(snips), CELLS, length)
    by_text = (
        snips.select("c1", "c2", "t1", "t2", "start").distinct().join(repeated, ["c1", "c2"])
        .select("t1", "t2", F.explode("ranges").alias("r"), "start")
        .groupBy("t1", "t2").agg(F.collect_set(F.struct((F.col("r.a") + F.col("start")).alias("a"), (F.col("r.b") + F.col("start")).alias("b"))).alias("ranges"))
    )

    def remove(batches):
        for part, data, offsets in text_blocks(batches, "text", BLOCK):
            raw, ranges = data.tobytes(), part.column(2).to_pylist()
            spans, kept = [], []
            for i, r in enumerate(ranges):
                text = raw[offsets[i] : offsets[i + 1]]
                own: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"] + length - 1) for x in r or ()):
                    if own and a <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], b)
                    else:
                        own.append([a, b])
                at, left = 0, []
                for a, b in own:
                    left.append(text[at:a])
                    at = b
                spans.append([{"a": a, "b": b} for a, b in own])
                kept.append(b"".join([*left, text[at:]]))
            sizes = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(sizes - np.array([len(k) for k in kept], np.int64)), pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.join(by_text, ["t1", "t2"], "left").select("doc_id", "text", "ranges")
        .mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>, kept binary")
    )
