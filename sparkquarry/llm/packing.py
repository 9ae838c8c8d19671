"""Packing: hierarchical multi-length packing of token sequences.

Documents are tokenised and packed where they are read, with no shuffle: a task buffers whole
tokenised documents up to ``buffer_tokens``, packs the buffer and goes on. In a buffer

1. whole windows of the largest context size are cut off long documents;
2. the rest of each document is routed to a tier, the smallest context size that holds it;
3. each tier, longest first, is packed into windows of its own size, whose gaps are filled from
   the shorter tiers: the longest piece that fits, again and again, then a cut piece;
4. a last window that nothing is left to fill is cut at powers of two, so nothing is padded;
5. sequences are dealt to step groups in a snake by attention cost, so that steps weigh the same.

Tokens: ids of the tokenizer without special tokens, then ``end_id``. A null or empty text has only
the end. Equal rows are packed as separate documents. Extra input columns are ignored; a null id
stays null. A retried task gives the same pieces: ids depend on the partition and order alone.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import _FACTOR, _INVERSE, _power, bounded_batches, mix64, text_blocks

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "window int, step_group long"
)
#: Words whose ids a task keeps, in each of two generations; this bounds its memory.
KEPT_WORDS = 300_000
#: Byte-level vocabularies spell a byte that has no visible Latin-1 character as the next one from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLED = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
#: A word of Latin letters with marks behind it: the tokenizer splits it just there.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?%&$#*|]*)")
_SPACE, _MARK, _PLAIN, _ODD = np.zeros((4, 256), bool)
_SPACE[[32, *range(9, 14)]] = True
_MARK[33:127] = True
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_ODD[[0xC2, *range(0xCC, 256), *range(0x1C, 0x20), 0x7F]] = True


class WordTokenizer:
    """Ids of a tokenizer that drops white space and splits there.

    Each block of texts is cut into words at spaces and single full stops or commas, its distinct
    words (by 64-bit hash) are encoded once and kept for later blocks, and the ids are gathered.
    Plain words go to the tokenizer's model at once, other words through all of it, and texts with
    characters that normalisation or white-space rules could touch, or with the spelling of an added (special)
    token, are encoded whole, so that ids are the tokenizer's own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids are kept in 16 bits: vocabularies of at most 65,536 entries")
        #: Spellings that the tokenizer takes out of a text before it splits words.
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.ids: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        plain = _WORD.fullmatch(text)
        if not plain:
            return self.whole(text)
        word = plain[1].lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_SPELLED)
        ids = [x.id for x in self.model.tokenize(word)]
        if plain[2]:
            ids += [x.id for x in self.model.tokenize(plain[2])]
        return array("H", ids).tobytes()

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids (unsigned 16-bit) of each text of the block."""
        n_docs = len(offsets) - 1
        if not len(data):
            return [np.zeros(0, "<u2")] * n_docs
        alone = ((data == 46) | (data == 44)).nonzero()[0]
        inner = alone[(alone > 0) & (alone < len(data) - 1)]
        around = [(_SPACE | _PLAIN)[data[inner + d]] for d in (-1, 1)]
        before = data[np.maximum(inner - 2, 0)]  # a two-byte Latin letter may end or begin beside the mark
        letter = (before >= 0xC3) & (before <= 0xC9) & (data[inner - 1] >= 0x80) & (data[inner - 1] != 0x97) & (data[inner - 1] != 0xB7)
        inner = inner[(around[0] | letter) & around[1]]
        first = ~_SPACE[data]
        stops = np.zeros(len(data), bool)
        stops[inner] = True
        inside = first.copy()
        first[1:] &= ~inside[:-1] | stops[1:] | stops[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = inside[edges]
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(data)))  # up to the next word; spaces behind are cut off below
        space_after = np.flatnonzero(~inside)
        if len(space_after):
            nearest = np.append(space_after, len(data))[np.searchsorted(space_after, start)]
            length = np.minimum(length, nearest - start)
        doc = np.searchsorted(offsets, start, "right") - 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_FACTOR, len(data)), out=total[1:])
        hashes = mix64((total[start + length] - total[start]) * _power(_INVERSE, len(data))[start] + length.astype(np.uint64))
        _, at, of = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.ids) > KEPT_WORDS:
            self.old, self.ids = self.ids, {}
        found, raw = [], data.tobytes()
        for key, begin, end in zip(hashes[at].tolist(), start[at].tolist(), (start[at] + length[at]).tolist(), strict=True):
            ids = self.ids.get(key)
            if ids is None:
                ids = self.old.get(key)
                self.ids[key] = ids = self.word(raw[begin:end].decode("utf-8", "replace")) if ids is None else ids
            found.append(ids)
        sizes = np.array([len(x) for x in found], np.int64) // 2
        pool, begins = np.frombuffer(b"".join(found), "<u2"), np.cumsum(sizes) - sizes
        each = sizes[of]
        ends = np.cumsum(each)
        ids = pool[np.repeat(begins[of] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.append(0, ends)[np.searchsorted(doc, np.arange(n_docs + 1))]
        out = [ids[cut[i] : cut[i + 1]] for i in range(n_docs)]
        odd = [np.flatnonzero(_ODD[data])] + [np.array([m.start() for m in re.finditer(re.escape(x), raw)], np.int64) for x in self.added if x in raw]
        for i in np.unique(np.searchsorted(offsets, np.concatenate(odd), "right") - 1):
            out[i] = np.frombuffer(self.whole(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")), "<u2")
        return out


def pack(lengths: list[int], tiers: tuple[int, ...]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Packs documents of these lengths: (window, pieces (document, start, length)) per sequence."""
    top, out = tiers[-1], []
    pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (length, document, start), ascending

    def tier_of(length: int) -> int:
        return next(i for i, size in enumerate(tiers) if length <= size)

    for doc, n in enumerate(lengths):
        whole = n - n % top
        out += [(top, [(doc, at, top)]) for at in range(0, whole, top)]
        if n > whole:
            pools[tier_of(n - whole)].append((n - whole, doc, whole))
    for pool in pools:
        pool.sort()
    for t in range(len(tiers) - 1, -1, -1):
        size = tiers[t]
        while pools[t]:
            length, doc, start = pools[t].pop()
            pieces, gap = [(doc, start, length)], size - length
            while gap:
                for pool in pools[t::-1]:  # the longest piece that fits
                    i = bisect_right(pool, (gap, 1 << 62))
                    if i:
                        length, doc, start = pool.pop(i - 1)
                        break
                else:
                    pool = next((p for p in pools[: t + 1] if p), None)
                    if pool is None:
                        break
                    rest, doc, start = pool.pop(0)  # the shortest is cut
                    insort(pools[tier_of(rest - gap)], (rest - gap, doc, start + gap))
                    length = gap
                pieces.append((doc, start, length))
                gap -= length
            if not gap:
                out.append((size, pieces))
            else:
                out += _at_powers(pieces)
    return out


def _at_powers(pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    left, out, pieces = sum(p[2] for p in pieces), [], pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left, need, own = left - size, size, []
        while need:
            doc, start, length = pieces.pop()
            if length > need:
                pieces.append((doc, start + need, length - need))
                length = need
            own.append((doc, start, length))
            need -= length
        out.append((size, own))
    return out


def step_groups(sequences: list, per_step: int) -> list[int]:
    """Step of each sequence: by falling attention cost, dealt to and fro over the steps."""
    steps = max(1, -(-len(sequences) // per_step))
    cost = [sum(p[2] * p[2] for p in pieces) for _, pieces in sequences]
    out = [0] * len(sequences)
    for rank, i in enumerate(sorted(range(len(sequences)), key=lambda i: (-cost[i], i))):
        turn, at = divmod(rank, steps)
        out[i] = steps - 1 - at if turn % 2 else at
    return out


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int = 1,
    per_step: int = 64, buffer_tokens: int = 6_000_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece. ``tiers``: rising powers of two; the last is the sequence length."""

    def run(batches):
        # of this task only: a worker that lives on would hold all words it has met
        tokenizer, partition = WordTokenizer(tokenizer_path), TaskContext.get().partitionId()
        ids, tokens, held, next_sequence, next_step = [], [], 0, partition << 32, partition << 32

        def flush():
            nonlocal next_sequence, next_step
            sequences = pack([len(x) for x in tokens], tiers)
            steps = step_groups(sequences, per_step)
            rows = []
            for k, (window, pieces) in enumerate(sequences):
                offset = 0
                for doc, start, length in pieces:
                    crc = zlib.crc32(tokens[doc][start : start + length].astype("<u4").tobytes())
                    rows.append((ids[doc], start, length, crc, len(tokens[doc]), next_sequence + k, offset, window, next_step + steps[k]))
                    offset += length
            next_sequence += len(sequences)
            next_step += max(steps, default=-1) + 1
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 7 else pa.int64()) for i, c in enumerate(columns)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for part, data, offsets in text_blocks(batches, "text", 1 << 20):
            ids += part.column(0).to_pylist()
            for x in tokenizer.encode_block(data, offsets):
                tokens.append(np.append(x, np.uint16(end_id)))
                held += len(x) + 1
            if held >= buffer_tokens:
                yield flush()
                ids, tokens, held = [], [], 0
        if tokens:
            yield flush()

    bounded_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
