"""Media columns: texts stored as lossless WebP pictures, read back and described.

A text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are the rows of 64 RGB pixels
of one or more pictures (``ROWS`` rows at most each), whose files one after another are the stored
form. What is described is decoded from those files, never taken from the input: nothing but
stored bytes enters the reader, and a text that would not come back is an error, not a result.

A null text is empty: one row of spaces. Equal texts have equal files and values. Extra columns are
ignored. Work is by block of rows where the table is read, without a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_blocks
from .webp_lossless import decode_many, encode_many

WIDTH, ROW_BYTES = 64, 192
#: Rows of a picture at most: long texts become several, so that many streams can be read in step.
ROWS = 48
BLOCK = 8 << 20
NAMES = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")


def stored(payload: np.ndarray) -> list[np.ndarray]:
    """The pictures of a payload."""
    return [payload[at : at + ROWS * ROW_BYTES] for at in range(0, len(payload), ROWS * ROW_BYTES)]


def files_of(media: bytes) -> list[bytes]:
    """The files that follow each other in the stored form."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def feature(pixels: np.ndarray) -> str:
    """Size, mean of each channel and a coarse histogram of the pixels."""
    rgb = pixels.reshape(-1, 3)
    mean = rgb.sum(0, dtype=np.int64) // len(rgb)
    bins = np.bincount(pixels >> 5, minlength=8) * 1000 // len(pixels)
    return f"{WIDTH}x{len(rgb) // WIDTH};{'-'.join(map(str, mean))};{'-'.join(map(str, bins))}"


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the digest columns and ``media``, the stored bytes."""
    bounded_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for part, data, offsets in text_blocks(batches, "text", BLOCK):
            sizes = np.diff(offsets)
            pictures, owner = [], []
            for i in range(part.num_rows):
                payload = np.full(max(1, -(-int(sizes[i]) // ROW_BYTES)) * ROW_BYTES, 32, np.uint8)
                payload[: sizes[i]] = data[offsets[i] : offsets[i + 1]]
                own = stored(payload)
                pictures += own
                owner.append(len(own))
            files, at, medias = encode_many(pictures, WIDTH), 0, []
            for n in owner:
                medias.append(b"".join(files[at : at + n]))
                at += n
            found = [files_of(m) for m in medias]
            read, at, rows = decode_many([f for own in found for f in own]), 0, []
            for i, own in enumerate(found):
                pixels = np.concatenate(read[at : at + len(own)])
                at += len(own)
                back, media = pixels.tobytes(), medias[i]
                if back[: sizes[i]] != data[offsets[i] : offsets[i + 1]].tobytes():
                    raise ValueError("a stored text did not come back")
                rows.append((int(sizes[i]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels), media))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], names=NAMES)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")
