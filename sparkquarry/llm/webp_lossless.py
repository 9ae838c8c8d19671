"""Lossless WebP in Python and numpy.

``decode`` reads any still lossless stream: prefix codes (also several by meta image), back-references,
the colour cache, and the predictor, cross-colour, subtract-green and palette transforms. ``decode_many``
reads many at once: streams that hold literals of one known set of prefix codes are decoded in step,
a symbol of every stream at a time, all others one by one. ``encode_many`` writes pictures of many equal
rows with back-references and pictures of few colours with a palette. Where pixels repeat or are near
those around them it tries transforms, copies, the colour cache and codes of the picture's own, and
keeps them if the file shrinks; all else is literals under one fixed set of prefix codes.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

# --- fixed values of the format -------------------------------------------------------------
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
# --------------------------------------------------------------------------------------------
#: Near pixels by distance code: by distance, then by column, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """Reads bits, the least significant first."""

    def __init__(self, data: bytes):
        self.value, self.at, self.size = int.from_bytes(data, "little"), 0, 8 * len(data)
        self.data = data

    def read(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        out = int.from_bytes(self.data[first:last], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > self.size:
            raise ValueError("the stream ends early")
        return out


class PrefixCode:
    """A canonical prefix code, read with one table of the longest length."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if not used:
            used = [(0, 0)]
        self.single = used[0][1] if len(used) == 1 else None
        self.most = 0 if self.single is not None else max(n for n, _ in used)
        if self.single is None:
            if sum(1 << (self.most - n) for n, _ in used) != 1 << self.most:
                raise ValueError("a prefix code is not complete")
            self.symbols = np.zeros(1 << self.most, np.int64)
            self.lengths = np.zeros(1 << self.most, np.int64)
            code, last = 0, 0
            for n, s in sorted(used):
                code <<= n - last
                last = n
                self.symbols[_reversed(code, n) :: 1 << n] = s
                self.lengths[_reversed(code, n) :: 1 << n] = n
                code += 1
            self.table = list(zip(self.symbols.tolist(), self.lengths.tolist(), strict=True))

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        first = bits.at >> 3
        window = int.from_bytes(bits.data[first : first + 4], "little") >> (bits.at & 7) & ((1 << self.most) - 1)
        symbol, n = self.table[window]
        bits.at += n
        if bits.at > bits.size:
            raise ValueError("the stream ends early")
        return symbol


def _reversed(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0


def _read_code(bits: Bits, size: int) -> PrefixCode:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return PrefixCode(lengths)
    own = [0] * len(CODE_LENGTH_ORDER)
    for k in range(bits.read(4) + 4):
        own[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = PrefixCode(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            last = symbol or last
            at += 1
        else:
            times, value = ((3 + bits.read(2), last), (3 + bits.read(3), 0), (11 + bits.read(7), 0))[symbol - 16]
            if at + times > size:
                raise ValueError("code lengths run over")
            lengths[at : at + times] = [value] * times
            at += times
    return PrefixCode(lengths)


def _prefixed(symbol: int, bits: Bits) -> int:
    """Value of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: Bits, width: int, height: int, outer: bool) -> np.ndarray:
    """Entropy-coded pixels as ARGB numbers (height, width)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else None
    meta, block = None, 0
    if outer and bits.read(1):
        block = bits.read(3) + 2
        meta = (_pixels(bits, -(-width >> block), -(-height >> block), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    else:
        groups = 1
    sizes = (LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCE_CODES)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    out, n, at = [0] * (width * height), width * height, 0
    green, red, blue, alpha, distance = codes[0]
    while at < n:
        if meta is not None:
            green, red, blue, alpha, distance = codes[meta[(at // width) >> block, (at % width) >> block]]
        symbol = green.read(bits)
        if symbol < LITERALS:
            r = red.read(bits)
            b = blue.read(bits)
            new = [alpha.read(bits) << 24 | r << 16 | symbol << 8 | b]
        elif symbol < LITERALS + LENGTH_CODES:
            length = _prefixed(symbol - LITERALS, bits)
            code = _prefixed(distance.read(bits), bits)
            if code > len(NEAR):
                back = code - len(NEAR)
            else:
                x, y = NEAR[code - 1]
                back = max(1, x + y * width)
            if back > at or at + length > n:
                raise ValueError("a back-reference leaves the picture")
            new = (out[at - back : at] * (-(-length // back)))[:length]
        else:
            new = [cache[symbol - LITERALS - LENGTH_CODES]]
        out[at : at + len(new)] = new
        at += len(new)
        if cache is not None:
            for x in new:
                cache[(CACHE_FACTOR * x & 0xFFFFFFFF) >> (32 - cache_bits)] = x
    return np.array(out, np.int64).reshape(height, width)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(4, height, width): alpha, red, green, blue."""
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)])


def _argb(c: np.ndarray) -> np.ndarray:
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def _predicted(mode: int, left, top, corner, beyond) -> list[int]:
    """Prediction of a pixel from its neighbours (each a list of four channels)."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode <= 4:
        return (left, top, beyond, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, beyond), top)
    if mode == 6:
        return mean(left, corner)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(corner, top)
    if mode == 9:
        return mean(top, beyond)
    if mode == 10:
        return mean(mean(left, corner), mean(top, beyond))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    clamp = lambda v: min(255, max(0, v))
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    half = lambda d: d // 2 if d >= 0 else -(-d // 2)
    return [clamp(m + half(m - c)) for m, c in zip(mean(left, top), corner, strict=True)]


def _unpredict(argb: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width = argb.shape
    mode = (modes >> 8) & 255
    rows: list[list[list[int]]] = []
    for y, row in enumerate(_channels(argb).transpose(1, 2, 0).tolist()):
        above = rows[-1] if rows else None
        for x, rest in enumerate(row):
            if y == 0:
                p = row[x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                p = above[0]
            else:
                beyond = above[x + 1] if x + 1 < width else row[0]  # past the right edge comes the row's own first pixel
                p = _predicted(int(mode[y >> block, x >> block]), row[x - 1], above[x], above[x - 1], beyond)
            row[x] = [(a + b) & 255 for a, b in zip(rest, p, strict=True)]
        rows.append(row)
    return _argb(np.array(rows, np.int64).transpose(2, 0, 1))


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _uncross(argb: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    height, width = argb.shape
    f = factors[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]
    green_to_red, green_to_blue, red_to_blue = _signed(f), _signed(f >> 8), _signed(f >> 16)
    a, r, g, b = _channels(argb)
    r = (r + (green_to_red * _signed(g) >> 5)) & 255
    b = (b + (green_to_blue * _signed(g) >> 5) + (red_to_blue * _signed(r) >> 5)) & 255
    return _argb(np.stack([a, r, g, b]))


def _unpalette(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    n = len(palette)
    pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    index = argb >> 8 & 255
    if pack:
        bits = 8 >> pack
        parts = [index >> bits * k & ((1 << bits) - 1) for k in range(1 << pack)]
        index = np.stack(parts, 2).reshape(len(index), -1)[:, :width]
    return np.where(index < n, palette[np.minimum(index, n - 1)], 0)


def _frame(media: bytes) -> bytes:
    """The stream in a file."""
    if media[:4] != b"RIFF" or media[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(media[16:20], "little")
    if len(media) < 20 + size or media[20:21] != b"\x2f":
        raise ValueError("a WebP file is cut short")
    return media[20 : 20 + size]


def decode(media: bytes) -> np.ndarray:
    """The picture as (height, width) ARGB numbers."""
    bits = Bits(_frame(media))
    bits.read(8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, full = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            data = _pixels(bits, -(-width >> block), -(-height >> block), False)
            undo.append((_unpredict if kind == PREDICTOR else _uncross, data, block))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = _channels(_pixels(bits, n, 1, False))
            undo.append((_unpalette, _argb(np.cumsum(steps, 2) & 255)[0], width))
            width = -(-width >> (3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0))
        else:
            undo.append((lambda argb, *_: _argb(_channels(argb) + np.array([0, 1, 0, 1])[:, None, None] * (argb >> 8 & 255) & 255), None, None))
    out = _pixels(bits, width, height, True)
    for f, data, block in reversed(undo):
        out = f(out, data, block)
    if out.shape != (height, full):
        raise ValueError("transforms do not fit the picture")
    return out


# --- writing --------------------------------------------------------------------------------
class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> "Writer":
        self.value |= value << self.n
        self.n += n
        return self

    def code(self, code: tuple[int, int]) -> "Writer":
        return self.put(*code)

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


def code_lengths(weights: list[float], most: int = 15) -> list[int]:
    """Lengths of a Huffman code (0 where the weight is 0); weights are evened out until none is over ``most``."""
    weights = list(weights)
    while True:
        heap = [(w, i, (i,)) for i, w in enumerate(weights) if w > 0]
        lengths = [0] * len(weights)
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, i, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            for s in left + right:
                lengths[s] += 1
            heapq.heappush(heap, (a + b, i, left + right))
        if max(lengths) <= most:
            return lengths if any(lengths) else [int(w > 0) for w in weights]  # a lone symbol is written with length 1
        floor = sum(weights) / (1 << most - 2)
        weights = [max(w, floor) if w > 0 else 0 for w in weights]


def canonical(lengths: list[int]) -> list[tuple[int, int]]:
    """(code as written, length) of each symbol; a lone symbol takes no bits."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    out, code, last = [(0, 0)] * len(lengths), 0, 0
    if len(used) > 1:
        for n, s in used:
            code <<= n - last
            last = n
            out[s] = (_reversed(code, n), n)
            code += 1
    return out


def put_code(w: Writer, lengths: list[int]) -> list[tuple[int, int]]:
    """Writes a prefix code and returns its codes."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used) and all(lengths[s] == 1 for s in used):
        w.put(1, 1).put(len(used) - 1 if used else 0, 1).put(1, 1).put(used[0] if used else 0, 8)
        if len(used) == 2:
            w.put(used[1], 8)
        return canonical(lengths)
    counts = [0.0] * len(CODE_LENGTH_ORDER)
    for n in lengths:
        counts[n] += 1
    own = code_lengths(counts, 7)
    if sum(1 for n in own if n) == 1:
        own[own.index(max(own))] = 1
    codes = canonical(own)
    w.put(0, 1).put(15, 4)
    for s in CODE_LENGTH_ORDER:
        w.put(own[s], 3)
    w.put(0, 1)
    for n in lengths:
        w.code(codes[n])
    return canonical(lengths)


def _text_weights() -> list[float]:
    """Weights of bytes as text has them: by rank in a plain order of letters, others even."""
    order = b" etaoinrshldcumfgpywbvk.,\nxjqz" + bytes(range(0x41, 0x5B)) + b"\xc3" + bytes(range(0xA0, 0xC0)) + b"0123456789-'\""
    weights = [1 / 4000] * 256
    for rank, b in enumerate(order):
        weights[b] = 1 / (rank + 4)
    return weights


def _head(width: int, height: int) -> Writer:
    return Writer().put(0x2F, 8).put(width - 1, 14).put(height - 1, 14).put(0, 4)


@lru_cache(1)
def _literal_stream() -> tuple[int, int, np.ndarray, np.ndarray, PrefixCode]:
    """The fixed set of prefix codes as written (value, bits), the code and length of each byte, and its reader."""
    lengths = code_lengths(_text_weights())
    w = Writer().put(0, 3)  # no transform, no cache, one set of codes
    codes = put_code(w, lengths + [0] * LENGTH_CODES)
    put_code(w, lengths)
    put_code(w, lengths)
    put_code(w, [0] * 255 + [1])
    put_code(w, [1] + [0] * (DISTANCE_CODES - 1))
    code, size = (np.array(x, np.int64) for x in zip(*codes[:256], strict=True))
    return w.value, w.n, code, size, PrefixCode(lengths)


def _file(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(stream) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + pad


def _value_code(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    top = (value - 1).bit_length() - 1
    second = value - 1 >> top - 1 & 1
    return 2 * top + second, value - 1 & ((1 << top - 1) - 1), top - 1


def encode_with_rows(rgb: np.ndarray) -> bytes:
    """A picture whose repeated rows become back-references; ``rgb``: (height, width, 3)."""
    height, width, _ = rgb.shape
    w = _head(width, height).put(0, 3)
    same = np.zeros(height, bool)
    same[1:] = (rgb[1:] == rgb[:-1]).all((1, 2))
    literal = rgb[~same].reshape(-1, 3)
    counts = [np.bincount(literal[:, k], minlength=256).tolist() for k in range(3)]
    reds, greens, blues = counts
    greens += [0] * LENGTH_CODES
    refs = _row_references(same, width)
    for s, _, _ in refs:
        greens[LITERALS + s] += 1
    codes = [put_code(w, code_lengths(c)) for c in (greens, reds, blues)]
    put_code(w, [0] * 255 + [1])
    put_code(w, [1] + [0] * (DISTANCE_CODES - 1))
    green, red, blue = codes
    y, refs = 0, iter(refs)
    while y < height:
        if not same[y]:
            for r, g, b in rgb[y].tolist():
                w.code(green[g]).code(red[r]).code(blue[b])
            y += 1
            continue
        run = y
        while run < height and same[run]:
            run += 1
        for _ in range(-(-(run - y) * width // 4096)):
            s, extra, n = next(refs)
            w.code(green[LITERALS + s]).put(extra, n)  # distance code 1, the pixel above, takes no bits
        y = run
    return _file(w.bytes())


def _row_references(same: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    out, run = [], 0
    for s in [*same.tolist(), False]:
        if s:
            run += width
        else:
            while run:
                out.append(_value_code(min(run, 4096)))
                run -= min(run, 4096)
    return out


def encode_with_palette(rgb: np.ndarray) -> bytes:
    """A picture of at most 16 colours as indices into them, several in a pixel."""
    height, width, _ = rgb.shape
    argb = (255 << 24) | rgb[..., 0].astype(np.int64) << 16 | rgb[..., 1].astype(np.int64) << 8 | rgb[..., 2]
    palette, index = np.unique(argb, return_inverse=True)
    n = len(palette)
    pack = 3 if n <= 2 else 2 if n <= 4 else 1
    bits, per = 8 >> pack, 1 << pack
    index = np.pad(index.reshape(height, width), ((0, 0), (0, -width % per))).reshape(height, -1, per)
    packed = (index << bits * np.arange(per)).sum(2)
    w = _head(width, height).put(1, 1).put(PALETTE, 2).put(n - 1, 8)
    steps = _channels(palette[None, :])
    steps[:, :, 1:] = (steps[:, :, 1:] - steps[:, :, :-1]) & 255
    w.put(0, 1)  # the palette: no cache
    _put_literals(w, steps)
    w.put(0, 1).put(0, 2)  # no more transforms, no cache, one set of codes
    zero = np.zeros_like(packed)
    _put_literals(w, np.stack([zero + 255, zero, packed, zero]))
    return _file(w.bytes())


def _put_literals(w: Writer, channels: np.ndarray) -> None:
    a, r, g, b = (c.ravel().tolist() for c in channels)
    codes = []
    for values, more in ((g, LENGTH_CODES), (r, 0), (b, 0), (a, 0)):
        codes.append(put_code(w, code_lengths(np.bincount(values, minlength=256).tolist()) + [0] * more))
    put_code(w, [1] + [0] * (DISTANCE_CODES - 1))
    for values in zip(g, r, b, a, strict=True):
        for code, value in zip(codes, values, strict=True):
            w.code(code[value])


def _few_colours(x: np.ndarray) -> bool:
    pixels = x.reshape(-1, 3).astype(np.int64) @ np.array([65536, 256, 1])
    return len(np.unique(pixels[:64])) <= 16 and len(pixels) <= 1 << 13 and len(np.unique(pixels)) <= 16


#: Of a picture's pixels, what is distinct at most, and of its bytes, what equals the byte above or before at least, for transforms to be tried.
MOST_DISTINCT, LEAST_EQUAL = 0.2, 0.3
CACHE_BITS, LEAST_COPY, MOST_COPY, MODES = 6, 3, 4096, (1, 2, 4, 7, 12)


def _predict_all(c: np.ndarray, mode: int) -> np.ndarray:
    """What is left of each pixel of (4, height, width) under one predictor."""
    left, top, corner = (np.zeros_like(c) for _ in range(3))
    left[:, :, 1:], top[:, 1:], corner[:, 1:, 1:] = c[:, :, :-1], c[:, :-1], c[:, :-1, :-1]
    guess = {1: left, 2: top, 4: corner, 7: left + top >> 1, 12: (left + top - corner).clip(0, 255)}[mode].copy()
    guess[:, 0] = left[:, 0]
    guess[:, 1:, 0] = top[:, 1:, 0]
    guess[:, 0, 0] = (255, 0, 0, 0)
    return (c - guess) & 255


def _cross_factors(c: np.ndarray) -> tuple[int, int, int]:
    """green to red, green to blue and red to blue in 32nds, by least squares."""
    red, green, blue = (_signed(x) for x in c[1:])
    fit = lambda x, y: int(np.clip(np.rint(32 * (x * y).sum() / max(1, (x * x).sum())), -128, 127))
    green_to_blue = fit(green, blue)
    return fit(green, red), green_to_blue, fit(red, blue - (green_to_blue * green >> 5))


def _cross(c: np.ndarray, factors: tuple[int, int, int]) -> np.ndarray:
    a, r, g, b = c
    left_r = r - (factors[0] * _signed(g) >> 5)
    left_b = b - (factors[1] * _signed(g) >> 5) - (factors[2] * _signed(r) >> 5)
    return np.stack([a, left_r & 255, g, left_b & 255])


def _entropy(c: np.ndarray) -> float:
    """Bits that the channels take under codes of their own."""
    counts = np.stack([np.bincount(x.ravel(), minlength=256) for x in c])
    return float((counts * np.log2(np.maximum(1, counts.sum(1, keepdims=True)) / np.maximum(1, counts))).sum())


def _steps(argb: np.ndarray, width: int, cache_bits: int) -> list[tuple]:
    """The pixels as copies (length, distance), entries of the colour cache and literals."""
    near = {max(1, x + y * width): k for k, (x, y) in reversed(list(enumerate(NEAR, 1)))}
    flat = argb.ravel()
    pixels, n = flat.tolist(), len(flat)
    slots = ((CACHE_FACTOR * flat & 0xFFFFFFFF) >> (32 - cache_bits)).tolist()
    keys = (flat[:-2] * 0x9E3779B1 ^ flat[1:-1] * 0x85EBCA6B ^ flat[2:] * 0xC2B2AE35).tolist() if n > 2 else []
    keys += [None] * (n - len(keys))
    held, last, out, at = [0] * (1 << cache_bits), {None: None}, [], 0
    while at < n:
        back, length = last.get(keys[at]), 1
        if back is not None and pixels[back : back + LEAST_COPY] == pixels[at : at + LEAST_COPY]:
            length = LEAST_COPY
            while at + length < n and length < MOST_COPY and pixels[back + length] == pixels[at + length]:
                length += 1
            out.append((_value_code(length), _value_code(near.get(at - back, at - back + len(NEAR)))))
            for k in range(at, at + length):
                held[slots[k]] = pixels[k]
        elif held[slots[at]] == pixels[at]:
            out.append((slots[at],))
        else:
            out.append((pixels[at],) * 3)
            held[slots[at]] = pixels[at]
        last[keys[at]] = at  # a copy is found again by its first and last pixels
        last[keys[at + length - 1]] = at + length - 1
        last[None] = None
        at += length
    return out


def encode_with_transforms(rgb: np.ndarray) -> bytes:
    """A picture under those transforms that leave least, with copies, the colour cache and prefix codes of its own."""
    height, width, _ = rgb.shape
    whole = np.concatenate([np.full((1, height, width), 255, np.int64), rgb.transpose(2, 0, 1).astype(np.int64)])
    mode, best = 0, None
    if max((rgb[1:] == rgb[:-1]).mean(), (rgb[:, 1:] == rgb[:, :-1]).mean()) >= LEAST_EQUAL:
        mode = min(MODES, key=lambda m: _entropy(_predict_all(whole, m)))
    for predicted in (False, True)[: 1 + (mode > 0)]:
        base = _predict_all(whole, mode) if predicted else whole
        factors = _cross_factors(base)
        green = np.stack([base[0], (base[1] - base[2]) & 255, base[2], (base[3] - base[2]) & 255])
        for last, c in ((None, base), (SUBTRACT_GREEN, green), (CROSS_COLOUR, _cross(base, factors))):
            bits = _entropy(c) + 60 * predicted + 60 * (last == CROSS_COLOUR)
            if best is None or bits < best[0]:
                best = bits, predicted, last, factors, c
    _, predicted, last, factors, c = best
    w = _head(width, height)
    if predicted:
        _put_block_image(w.put(1, 1).put(PREDICTOR, 2), (255, 0, mode, 0))
    if last == SUBTRACT_GREEN:
        w.put(1, 1).put(SUBTRACT_GREEN, 2)
    elif last == CROSS_COLOUR:
        green_to_red, green_to_blue, red_to_blue = (f & 255 for f in factors)
        _put_block_image(w.put(1, 1).put(CROSS_COLOUR, 2), (255, red_to_blue, green_to_blue, green_to_red))
    steps = _steps(_argb(c), width, CACHE_BITS)
    w.put(0, 1).put(1, 1).put(CACHE_BITS, 4).put(0, 1)  # no more transforms, a cache, one set of codes
    counts = [[0] * n for n in (LITERALS + LENGTH_CODES + (1 << CACHE_BITS), LITERALS, LITERALS, LITERALS, DISTANCE_CODES)]
    for x in steps:
        if len(x) == 3:
            for k, s in enumerate((8, 16, 0, 24)):
                counts[k][x[0] >> s & 255] += 1
        elif len(x) == 2:
            counts[0][LITERALS + x[0][0]] += 1
            counts[4][x[1][0]] += 1
        else:
            counts[0][LITERALS + LENGTH_CODES + x[0]] += 1
    green, red, blue, alpha, distance = (put_code(w, code_lengths(n)) for n in counts)
    for x in steps:
        if len(x) == 3:
            w.code(green[x[0] >> 8 & 255]).code(red[x[0] >> 16 & 255]).code(blue[x[0] & 255]).code(alpha[x[0] >> 24])
        elif len(x) == 2:
            (s, extra, n), (d, more, m) = x
            w.code(green[LITERALS + s]).put(extra, n).code(distance[d]).put(more, m)
        else:
            w.code(green[LITERALS + LENGTH_CODES + x[0]])
    return _file(w.bytes())


def _put_block_image(w: Writer, argb: tuple[int, int, int, int]) -> None:
    """What a transform has for its only block: blocks of 512 pixels a side, more than a picture here has."""
    w.put(7, 3).put(0, 1)
    _put_literals(w, np.array(argb, np.int64).reshape(4, 1, 1))


def _repeats(x: np.ndarray, row: int) -> bool:
    """Whether transforms, copies and the cache may make a payload smaller."""
    if len(x) <= row:
        return False
    if (x[row:] == x[:-row]).mean() >= LEAST_EQUAL or (x[3:] == x[:-3]).mean() >= LEAST_EQUAL:
        return True
    pixels = np.sort(x.reshape(-1, 3).astype(np.int32) @ np.array([65536, 256, 1], np.int32))
    return 1 + int(np.count_nonzero(np.diff(pixels))) <= MOST_DISTINCT * len(pixels)


def encode_many(payloads: list[np.ndarray], width: int) -> list[bytes]:
    """Each payload (bytes, a multiple of 3 * width) as a file of RGB rows."""
    out: list[bytes | None] = [None] * len(payloads)
    plain = []
    for i, x in enumerate(payloads):
        rows = x.reshape(-1, 3 * width)
        if len(rows) > 2 and 2 * int((rows[1:] == rows[:-1]).all(1).sum()) >= len(rows):
            out[i] = encode_with_rows(rows.reshape(len(rows), width, 3))
        elif _few_colours(x):
            out[i] = encode_with_palette(rows.reshape(len(rows), width, 3))
        else:
            if max(width, len(rows)) <= 512 and _repeats(x, 3 * width):
                tried = encode_with_transforms(rows.reshape(len(rows), width, 3))
                if 8 * len(tried) < 8 * 25 + _literal_stream()[1] + int(_literal_stream()[3][x].sum()):
                    out[i] = tried
                    continue
            plain.append(i)
    if plain:
        value, head, code, size, _ = _literal_stream()
        data = np.concatenate([payloads[i] for i in plain]).reshape(-1, 3)[:, [1, 0, 2]].ravel()
        sizes = np.array([len(payloads[i]) for i in plain], np.int64)
        cut = np.append(0, np.cumsum(sizes))
        total = np.append(0, np.cumsum(size[data]))
        bits = total[cut[1:]] - total[cut[:-1]]
        used = 40 + head + bits
        base = np.append(0, np.cumsum(-(-used // 32) + 1))  # each stream begins at a 32-bit word
        at = total[:-1] + np.repeat(32 * base[:-1] + 40 + head - total[cut[:-1]], sizes)
        word = at >> 5
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        whole = np.add.reduceat(code[data] << (at & 31), first).view(np.uint64)
        words = np.zeros(int(base[-1]) + 1, np.uint64)
        words[word[first]] = whole & np.uint64(0xFFFFFFFF)
        words[word[first] + 1] |= whole >> np.uint64(32)
        raw = words.astype("<u4").tobytes()
        for k, i in enumerate(plain):
            h = _head(width, len(payloads[i]) // (3 * width)).put(value, head)
            n, begin = -(-h.n // 8), 4 * int(base[k])
            top = bytes(x | y for x, y in zip(h.value.to_bytes(n, "little")[-1:], raw[begin + n - 1 : begin + n], strict=True))
            out[i] = _file(h.value.to_bytes(n, "little")[:-1] + top + raw[begin + n : begin - int(-used[k] // 8)])
    return out


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The RGB bytes of each file, row by row."""
    value, head, _, _, reader = _literal_stream()
    known, known_bytes, tail = value.to_bytes(-(-head // 8), "little"), head // 8, head % 8
    out: list[np.ndarray | None] = [None] * len(files)
    plain: list[tuple[int, int, bytes]] = []
    for i, media in enumerate(files):
        stream = _frame(media)
        h = int.from_bytes(stream[:5], "little") >> 8
        n = ((h & 0x3FFF) + 1) * ((h >> 14 & 0x3FFF) + 1)
        rest = stream[5:]
        if h >> 28 == 0 and rest[:known_bytes] == known[:known_bytes] and (not tail or (rest[known_bytes] ^ known[known_bytes]) & ((1 << tail) - 1) == 0):
            plain.append((i, 3 * n, stream))
        else:
            argb = decode(media)
            out[i] = np.stack([argb >> s & 255 for s in (16, 8, 0)], 2).astype(np.uint8).ravel()
    plain.sort(key=lambda x: -x[1])
    for k in range(0, len(plain), 4096):
        part = plain[k : k + 4096]
        sizes = np.array([n for _, n, _ in part])
        begin = np.cumsum([0, *(len(s) for _, _, s in part)])
        data = np.frombuffer(b"".join(s for _, _, s in part) + b"\0" * 8, np.uint8)
        words = data[:-3].astype(np.uint32)
        for j in (1, 2, 3):
            words |= data[j : len(data) - 3 + j].astype(np.uint32) << np.uint32(8 * j)
        at = begin[:-1] * 8 + 40 + head
        symbols = np.zeros((int(sizes[0]), len(part)), np.uint8)
        mask = np.uint32((1 << reader.most) - 1)
        symbol_of, length_of = reader.symbols.astype(np.uint8), reader.lengths
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # streams with more symbols than the step
        for step in range(int(sizes[0])):
            m = int(live[step])
            own = at[:m]
            window = (words[own >> 3] >> (own & 7).astype(np.uint32)) & mask
            symbols[step, :m] = symbol_of[window]
            own += length_of[window]
        if (at > begin[1:] * 8).any():
            raise ValueError("the stream ends early")
        for j, (i, n, _) in enumerate(part):
            out[i] = symbols[:n, j].reshape(-1, 3)[:, [1, 0, 2]].ravel()
    return out
