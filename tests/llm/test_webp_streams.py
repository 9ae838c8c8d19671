"""The WebP reader on streams written here step by step from the format: each transform, the colour cache, several codes."""

import numpy as np
import pytest

from sparkquarry.llm import webp_lossless as webp

RNG = np.random.default_rng(7)
BLACK = (255, 0, 0, 0)
FACTOR = 0x1E35A7BD


def _picture(height: int, width: int) -> np.ndarray:
    """(height, width, 4): alpha, red, green, blue; a gradient with noise, and pixels that come again."""
    y, x = np.mgrid[:height, :width]
    out = np.stack([255 - (x % 3), x * 5 + y, y * 7 + x, x * y], 2) + RNG.integers(0, 9, (height, width, 4))
    out[RNG.random((height, width)) < 0.3] = (255, 10, 20, 30)
    return out % 256


def _numbers(p: np.ndarray) -> np.ndarray:
    return (p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]).astype(np.int64)


def _slot(number: int, bits: int) -> int:
    return (FACTOR * number % (1 << 32)) >> (32 - bits)


def _put_pixels(w: webp.Writer, p: np.ndarray, *, outer: bool = False, cache: int = 0, groups: np.ndarray | None = None, copies: dict | None = None) -> None:
    """Pixels as literals, cache entries where the cache holds them, and copies {position: (length, distance code)}."""
    height, width = p.shape[:2]
    w.put(1, 1).put(cache, 4) if cache else w.put(0, 1)
    if outer:
        if groups is None:
            w.put(0, 1)
        else:  # blocks of 4 by 4 pixels; the group's number is in red and green
            w.put(1, 1).put(0, 3)
            _put_pixels(w, np.stack([groups * 0, groups >> 8, groups & 255, groups * 0], 2))
    flat, held, at, steps = p.reshape(-1, 4).tolist(), [0] * (1 << cache), 0, []
    while at < len(flat):
        group = int(groups[at // width // 4, at % width // 4]) if groups is not None else 0
        length, code = (copies or {}).get(at, (1, 0))
        number = int(_numbers(np.array(flat[at])))
        if code:
            steps.append((group, "copy", webp._value_code(length), webp._value_code(code)))
        elif cache and held[_slot(number, cache)] == number:
            steps.append((group, "cache", _slot(number, cache), None))
        else:
            steps.append((group, "literal", flat[at], None))
        for pixel in flat[at : at + length]:
            n = int(_numbers(np.array(pixel)))
            if cache:
                held[_slot(n, cache)] = n
        at += length
    written = []
    for g in range(1 + (int(groups.max()) if groups is not None else 0)):
        counts = [[0] * (280 + ((1 << cache) if cache else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
        for group, kind, a, b in steps:
            if group != g:
                continue
            if kind == "literal":
                for k, v in zip((3, 1, 0, 2), a, strict=True):
                    counts[k][v] += 1
            elif kind == "cache":
                counts[0][280 + a] += 1
            else:
                counts[0][256 + a[0]] += 1
                counts[4][b[0]] += 1
        written.append([webp.put_code(w, webp.code_lengths(c)) for c in counts])
    for group, kind, a, b in steps:
        green, red, blue, alpha, distance = written[group]
        if kind == "literal":
            w.code(green[a[2]]).code(red[a[1]]).code(blue[a[3]]).code(alpha[a[0]])
        elif kind == "cache":
            w.code(green[280 + a])
        else:
            w.code(green[256 + a[0]]).put(a[1], a[2]).code(distance[b[0]]).put(b[1], b[2])


def _expected(mode, left, top, corner, beyond):
    """The fourteen predictions in the words of the format."""
    average = lambda a, b: (a + b) // 2
    if mode == 11:
        guess = left + top - corner
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    half = average(left, top)
    return {
        0: np.array(BLACK), 1: left, 2: top, 3: beyond, 4: corner, 5: average(average(left, beyond), top), 6: average(left, corner), 7: half, 8: average(corner, top),
        9: average(top, beyond), 10: average(average(left, corner), average(top, beyond)), 12: np.clip(left + top - corner, 0, 255), 13: np.clip(half + np.trunc((half - corner) / 2).astype(int), 0, 255),
    }[mode]


def _predictor(w: webp.Writer, p: np.ndarray) -> np.ndarray:
    height, width = p.shape[:2]
    modes = np.arange(-(-height // 4) * -(-width // 4)).reshape(-(-height // 4), -1) % 14
    w.put(1, 1).put(0, 2).put(0, 3)
    _put_pixels(w, np.stack([modes * 0, modes * 0, modes, modes * 0], 2))
    out = p.copy()
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = p[0, x - 1] if x else np.array(BLACK)
            elif x == 0:
                guess = p[y - 1, 0]
            else:
                guess = _expected(int(modes[y // 4, x // 4]), p[y, x - 1], p[y - 1, x], p[y - 1, x - 1], p[y - 1, x + 1] if x + 1 < width else p[y, 0])
            out[y, x] = (p[y, x] - guess) % 256
    return out


def _cross_colour(w: webp.Writer, p: np.ndarray) -> np.ndarray:
    height, width = p.shape[:2]
    factors = RNG.integers(0, 256, (-(-height // 4), -(-width // 4), 3))  # red to blue, green to blue, green to red
    w.put(1, 1).put(1, 2).put(0, 3)
    _put_pixels(w, np.concatenate([np.full((*factors.shape[:2], 1), 255), factors], 2))
    signed = lambda v: v - 256 if v > 127 else v
    out = p.copy()
    for y in range(height):
        for x in range(width):
            red_blue, green_blue, green_red = (signed(int(v)) for v in factors[y // 4, x // 4])
            red, green = signed(int(p[y, x, 1])), signed(int(p[y, x, 2]))
            out[y, x, 1] = (p[y, x, 1] - (green_red * green // 32)) % 256
            out[y, x, 3] = (p[y, x, 3] - (green_blue * green // 32) - (red_blue * red // 32)) % 256
    return out


def _green(w: webp.Writer, p: np.ndarray) -> np.ndarray:
    w.put(1, 1).put(2, 2)
    return (p - p[..., 2:3] * np.array([0, 1, 0, 1])) % 256


def _palette(w: webp.Writer, p: np.ndarray) -> np.ndarray:
    colours, index = np.unique(p.reshape(-1, 4), axis=0, return_inverse=True)
    index = index.reshape(p.shape[:2])
    w.put(1, 1).put(3, 2).put(len(colours) - 1, 8)
    _put_pixels(w, np.diff(colours, axis=0, prepend=np.zeros((1, 4), int))[None] % 256)
    bits = 1 if len(colours) <= 2 else 2 if len(colours) <= 4 else 4 if len(colours) <= 16 else 8
    out = np.zeros((p.shape[0], -(-p.shape[1] * bits // 8), 4), int)
    for x in range(p.shape[1]):
        out[:, x * bits // 8, 2] |= index[:, x] << x * bits % 8
    return out


def _read(p: np.ndarray, *transforms, **options) -> np.ndarray:
    w, rest = webp._head(p.shape[1], p.shape[0]), p
    for t in transforms:
        rest = t(w, rest)
    w.put(0, 1)
    _put_pixels(w, rest, outer=True, **options)
    return webp.decode(webp._file(w.bytes()))


@pytest.mark.parametrize("transforms", [(), (_predictor,), (_cross_colour,), (_green,), (_predictor, _cross_colour, _green), (_green, _predictor)])
@pytest.mark.parametrize("size", [(1, 1), (1, 9), (11, 1), (19, 23), (32, 61)])
def test_transforms(transforms, size):
    p = _picture(*size)
    assert (_read(p, *transforms) == _numbers(p)).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    table = np.unique(RNG.integers(0, 256, (colours, 4)), axis=0)
    p = table[RNG.integers(0, len(table), (13, 21))]
    assert (_read(p, _palette) == _numbers(p)).all()
    assert (_read(p, _palette, _predictor) == _numbers(p)).all()


@pytest.mark.parametrize("bits", [1, 4, 11])
def test_colour_cache(bits):
    p = _picture(17, 29)
    assert (_read(p, cache=bits) == _numbers(p)).all()
    assert (_read(p, _predictor, cache=bits) == _numbers(p)).all()


def test_groups_of_codes():
    p = _picture(18, 22)
    groups = RNG.integers(0, 3, (5, 6))
    groups[0, 0] = 2
    assert (_read(p, groups=groups) == _numbers(p)).all()
    assert (_read(p, _predictor, _green, groups=groups, cache=5) == _numbers(p)).all()


def test_copies_by_distance_codes():
    # fixed values of the format: its first near distances
    first = [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1)]
    assert webp.NEAR[: len(first)] == first and len(webp.NEAR) == 120
    width = 20
    for code in (1, 2, 3, 4, 6, 9, 10, 18, 120 + 1, 120 + 37, 120 + 150):
        p = _picture(16, width)
        flat = p.reshape(-1, 4)
        back = code - 120 if code > 120 else first[code - 1][0] + first[code - 1][1] * width
        at, length = 200, 77
        for k in range(length):  # a copy may run into itself
            flat[at + k] = flat[at + k - back]
        assert (_read(p, copies={at: (length, code)}, cache=3) == _numbers(p)).all()


def test_streams_that_are_cut_short():
    w = webp._head(8, 8).put(0, 1)
    _put_pixels(w, _picture(8, 8), outer=True)
    media = webp._file(w.bytes()[:-20])
    with pytest.raises(ValueError):
        webp.decode(media)
    with pytest.raises(ValueError):
        webp.decode(media[:30])


def _transforms_of(media: bytes) -> tuple[set, bool]:
    """Kinds of transforms of a stream without a palette, each of one block, and whether it has a colour cache."""
    bits, kinds = webp.Bits(webp._frame(media)), set()
    bits.read(40)
    while bits.read(1):
        kinds.add(kind := bits.read(2))
        if kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
            bits.read(3)
            webp._pixels(bits, 1, 1, False)
    return kinds, bool(bits.read(1))


def test_writer_uses_transforms_cache_and_copies():
    width, rows = 64, 40
    ramp = ((np.arange(rows)[:, None] * 3 + np.arange(width) * 5) % 251)[:, :, None]
    noise = RNG.integers(0, 2, (rows, width, 1))
    phrase = np.frombuffer((b"a phrase of thirty-one letters. " * 300)[: rows * width * 3], np.uint8)
    pictures = {
        "green": np.repeat(RNG.integers(0, 256, (rows, width, 1)), 3, 2),
        "cross": np.concatenate([(lambda g: [(g // 2) & 255, g, (g // 4) & 255])(RNG.integers(0, 128, (rows, width, 1)))], 0).transpose(1, 2, 0, 3)[..., 0],
        "predictor": ramp + np.array([0, 9, 70]) + noise,
        "copies": phrase.reshape(rows, width, 3),
    }
    for name, p in pictures.items():
        p = (p.astype(np.int64) % 256).astype(np.uint8)
        media = webp.encode_with_transforms(p)
        assert (webp.decode_many([media])[0] == p.ravel()).all(), name
    kinds = {name: _transforms_of(webp.encode_with_transforms((p.astype(np.int64) % 256).astype(np.uint8)))[0] for name, p in pictures.items()}
    assert kinds["green"] & {webp.SUBTRACT_GREEN, webp.CROSS_COLOUR} and webp.CROSS_COLOUR in kinds["cross"]
    flat = np.repeat(np.cumsum(RNG.random((rows, width, 1)) < 0.4, 1), 3, 2) * np.array([1, 2, 3])  # most pixels equal the one before
    odd = np.frombuffer((b"a phrase of thirty-five letters, so " * 300)[1 : 1 + rows * width * 3], np.uint8).copy()
    odd = np.resize(odd[:35], rows * width * 3)
    table = np.array([[i, 255 - i, i * 7 % 256] for i in range(40)], np.uint8)
    payloads = [(flat % 256).astype(np.uint8).ravel(), odd, table[RNG.integers(0, 40, (rows, width))].ravel()]
    files = webp.encode_many(payloads, width)
    assert all((a == b).all() for a, b in zip(webp.decode_many(files), payloads, strict=True))
    assert webp.PREDICTOR in _transforms_of(files[0])[0] and all(_transforms_of(f)[1] for f in files)
    assert len(files[1]) < 600
