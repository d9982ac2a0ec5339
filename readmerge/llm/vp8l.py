"""Lossless WebP (VP8L): a decoder of the whole format, and an encoder of sample streams for storage.

Bits are read least significant first.  A picture is coded as five prefix codes (green with lengths and cache entries,
red, blue, alpha, distance), may copy earlier pixels or take them from a hashed colour cache, and may be under up to
four transforms.  Pixels are rows of (alpha, red, green, blue) bytes.
"""

from __future__ import annotations

import heapq
import math
import struct

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
SIGNATURE = 0x2F
LOOK = 15  # the longest code; tables for so many bits decode several symbols at once


class Bits:
    """A reader of little-endian bits; reading past the end gives zeros for one word, then fails."""

    def __init__(self, data: bytes):
        self.data, self.pos, self.end = data + bytes(8), 0, 8 * len(data)

    def read(self, n: int) -> int:
        i = self.pos >> 3
        v = int.from_bytes(self.data[i : i + 4], "little") >> (self.pos & 7) & ((1 << n) - 1)
        self.pos += n
        if self.pos > self.end + 32:
            raise ValueError("the stream ends too early")
        return v


#: The bits of each LOOK-bit number in opposite order.
REVERSED = np.zeros(1 << LOOK, np.int64)
for _i in range(LOOK):
    REVERSED |= (np.arange(1 << LOOK) >> _i & 1) << (LOOK - 1 - _i)


def _canonical(lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.asarray(lengths, np.int64)
    used = np.flatnonzero(a)
    used = used[np.argsort(a[used], kind="stable")]
    step = 1 << (LOOK - a[used])
    return used, a[used], REVERSED[(np.cumsum(step) - step) & ((1 << LOOK) - 1)]


def canonical(lengths) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of each symbol that has a length."""
    return list(zip(*(x.tolist() for x in _canonical(lengths)), strict=True))


class Code:
    """A prefix code; ``pairs`` has symbol and length for the next bits that ``mask`` takes."""

    def __init__(self, lengths):
        used, n, _ = _canonical(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:  # takes no bits
            self.mask, self.pairs = 0, [(int(used[0]), 0)]
            return
        width = int(n[-1])
        if int((1 << (width - n)).sum()) != 1 << width:
            raise ValueError("a prefix code that is not complete")
        self.mask = (1 << width) - 1
        each, place = list(zip(used.tolist(), n.tolist(), strict=True)), np.repeat(np.arange(len(used)), 1 << (width - n))
        self.pairs = [each[i] for i in place[REVERSED[np.arange(1 << width) << (LOOK - width)]].tolist()]

    def read(self, bits: Bits) -> int:
        i = bits.pos >> 3
        symbol, n = self.pairs[int.from_bytes(bits.data[i : i + 4], "little") >> (bits.pos & 7) & self.mask]
        bits.pos += n
        return symbol


#: Code lengths read before: by alphabet and first 64 bits, (bits taken, their value, lengths).
_read: dict[tuple[int, int], list[tuple[int, int, list[int]]]] = {}


def read_lengths(bits: Bits, alphabet: int) -> list[int]:
    """Code lengths of one prefix code; codes that many files share are parsed once."""
    i, skip = bits.pos >> 3, bits.pos & 7
    ahead = int.from_bytes(bits.data[i : i + 512], "little") >> skip
    key = alphabet, ahead & 0xFFFFFFFFFFFFFFFF
    for n, value, lengths in _read.get(key, ()):
        if ahead & ((1 << n) - 1) == value and bits.pos + n <= bits.end:
            bits.pos += n
            return lengths
    begin = bits.pos
    lengths = _parse_lengths(bits, alphabet)
    if (n := bits.pos - begin) <= 4000:
        if len(_read) > 256:
            _read.clear()
        same = _read.setdefault(key, [])
        same[4:] = []  # pictures' own codes rarely come again
        same.insert(0, (n, ahead & ((1 << n) - 1), lengths))
    return lengths


def _parse_lengths(bits: Bits, alphabet: int) -> list[int]:
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        found = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in found:
            if s >= alphabet:
                raise ValueError("a symbol beyond the alphabet")
            lengths[s] = 1
        return lengths
    own = [0] * 19
    for s in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[s] = bits.read(3)
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, previous = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at, previous = at + 1, s or previous
            continue
        n, value = (3 + bits.read(2), previous) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        if at + n > alphabet:
            raise ValueError("a run of code lengths beyond the alphabet")
        lengths[at : at + n] = [value] * n
        at += n
    if bits.pos > bits.end:
        raise ValueError("the stream ends too early")
    return lengths


_codes: dict[bytes, Code] = {}
_triples: dict[bytes, list[tuple[int, int]]] = {}
_uses: dict[bytes, int] = {}
OFTEN = 4  # uses of codes from which on a table pays
NO_TRIPLE = [(0, 255)]  # every pixel needs more


def _code_of(lengths: list[int]) -> Code:
    """The code of these lengths; codes that many files share are made once."""
    key = bytes(lengths)
    if key not in _codes:
        if len(_codes) > 256:
            _codes.clear()
        _codes[key] = Code(lengths)
    return _codes[key]


def _triple(red: list[int], blue: list[int], alpha: list[int], total: int) -> list[tuple[int, int]]:
    """For the next LOOK bits: red, blue and alpha of a pixel in place, and the bits taken (255: they need more).

    Kept by the lengths of the codes.  Where there is no such table, one is made if the picture's size makes it pay.
    """
    key = bytes(red) + bytes(blue) + bytes(alpha)
    uses = _uses[key] = _uses.get(key, 0) + 1
    if len(_uses) > 4096:
        _uses.clear()
    if key not in _triples and (uses >= OFTEN or total >= 2048):
        if len(_triples) > 16:
            _triples.clear()
        at, taken, value = np.arange(1 << LOOK), np.zeros(1 << LOOK, np.int64), np.zeros(1 << LOOK, np.int64)
        for lengths, shift in ((red, 16), (blue, 0), (alpha, 24)):
            c = _code_of(lengths)
            symbol, n = np.array(c.pairs)[at >> np.minimum(taken, LOOK) & c.mask].T
            value |= symbol << shift
            taken += n
        _triples[key] = list(zip(value.tolist(), np.where(taken > LOOK, 255, taken).tolist(), strict=True))
    return _triples.get(key, NO_TRIPLE)


def _number(bits: Bits, symbol: int) -> int:
    """The value of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded picture, as rows of (a, r, g, b)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache too large")
    groups, block, which = 1, 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        wide = -(-width // (1 << block))
        meta = _pixels(bits, wide, -(-height // (1 << block)), False)
        which = (meta[:, 1].astype(int) << 8 | meta[:, 2]).tolist()
        groups = max(which) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    total = width * height
    codes = []
    for _ in range(groups):
        g = [read_lengths(bits, n) for n in sizes]
        codes.append([*map(_code_of, g), _triple(*g[1:4], total // groups)])
    out: list[int] = []
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift, noted = 32 - cache_bits, 0
    raw = np.frombuffer(bits.data + bytes(16), np.uint8)
    words = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(raw) - 8,), (1,))
    windows = (words & np.uint64((1 << 60) - 1)).tolist()  # 53 bits or more from each byte on
    (green, red, blue, alpha, far, three), pos = codes[0], bits.pos
    (gt, gm), (rt, rm), (bt, bm), (at_, am) = ((c.pairs, c.mask) for c in (green, red, blue, alpha))
    look, add = len(three) - 1, out.append
    try:
        while len(out) < total:
            if which:
                x, y = len(out) % width, len(out) // width
                green, red, blue, alpha, far, three = codes[which[(y >> block) * wide + (x >> block)]]
                (gt, gm), (rt, rm), (bt, bm), (at_, am) = ((c.pairs, c.mask) for c in (green, red, blue, alpha))
                look = len(three) - 1
            for _ in range(1 if which else total - len(out)):  # as many items at most
                w = windows[pos >> 3] >> (pos & 7)
                s, n = gt[w & gm]
                if s < 256:
                    v, taken = three[w >> n & look]
                    if taken < 255:
                        pos += n + taken
                        add(v | s << 8)
                        continue
                    w >>= n
                    r, n_red = rt[w & rm]
                    w >>= n_red
                    v, n_blue = bt[w & bm]
                    pos += n + n_red + n_blue
                    a, n = at_[windows[pos >> 3] >> (pos & 7) & am]
                    pos += n
                    add(v | s << 8 | r << 16 | a << 24)
                elif s < 280:
                    bits.pos = pos + n
                    n = _number(bits, s - 256)
                    d = _number(bits, far.read(bits))
                    pos, at = bits.pos, len(out)
                    if d > len(NEAR):
                        d -= len(NEAR)
                    else:
                        x, y = NEAR[d - 1]
                        d = max(1, x + y * width)
                    if d > at or at + n > total:
                        raise ValueError("a copy from outside the picture")
                    out += out[at - d : at - d + n] if d >= n else (out[-d:] * (n // d + 1))[:n]
                    break
                else:
                    pos += n
                    for v in out[noted:]:  # entries are made when they are first needed
                        cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
                    noted = len(out)
                    add(cache[s - 280])
    except IndexError:
        raise ValueError("the stream ends too early") from None
    if pos > bits.end:
        raise ValueError("the stream ends too early")
    bits.pos = pos
    return np.array(out, ">u4").view(np.uint8).reshape(total, 4)


def _average(a, b):
    return (a.astype(np.int64) + b) >> 1


def _predict(mode: int, left, top, top_right, top_left) -> np.ndarray:
    """The prediction of one pixel (int64 arrays of four channels)."""
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return _average(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        guess = left + top - top_left
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = _average(left, top)
    return np.clip(mean + np.trunc((mean - top_left) / 2).astype(np.int64), 0, 255)


def _unpredict(px: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    p = px.astype(np.int64).reshape(height, width, 4)
    wide = -(-width // (1 << block))
    p[0, 0] += [255, 0, 0, 0]
    p[0] = np.cumsum(p[0], 0)  # the top row leans on its left neighbours
    p[0] &= 255
    flat = p.reshape(-1, 4)
    for y in range(1, height):
        row = y * width
        flat[row] = (flat[row] + flat[row - width]) & 255
        for x in range(1, width):
            i = row + x
            mode = int(modes[(y >> block) * wide + (x >> block)]) & 15
            flat[i] = (flat[i] + _predict(mode, flat[i - 1], flat[i - width], flat[i - width + 1], flat[i - width - 1])) & 255
    return flat.astype(np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int64)


def _uncross(px: np.ndarray, width: int, height: int, block: int, factors: np.ndarray) -> np.ndarray:
    wide = -(-width // (1 << block))
    y, x = np.divmod(np.arange(width * height), width)
    red_blue, green_blue, green_red = (_signed(factors[(y >> block) * wide + (x >> block), c]) for c in (1, 2, 3))
    green = _signed(px[:, 2])
    red = (px[:, 1] + (green_red * green >> 5)) & 255
    blue = (px[:, 3] + (green_blue * green >> 5) + (red_blue * _signed(red) >> 5)) & 255
    return np.stack([px[:, 0], red, px[:, 2], blue], 1).astype(np.uint8)


def _unindex(px: np.ndarray, width: int, height: int, packed: int, table: np.ndarray) -> np.ndarray:
    per = 1 << packed
    bits = 8 >> packed
    cells = px[:, 2].reshape(height, -1).astype(np.int64)
    index = (cells[:, :, None] >> (np.arange(per) * bits) & ((1 << bits) - 1)).reshape(height, -1)[:, :width].ravel()
    return np.concatenate([table, np.zeros((256 - len(table), 4), np.uint8)])[index]


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and pixels (a, r, g, b) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless picture in the file")
        n = struct.unpack_from("<I", data, at + 4)[0]
        at += 8 + n + (n & 1)
    n = struct.unpack_from("<I", data, at + 4)[0]
    bits = Bits(data[at + 8 : at + 8 + n])
    if bits.read(8) != SIGNATURE:
        raise ValueError("a wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            block = bits.read(3) + 2
            own = _pixels(bits, -(-wide // (1 << block)), -(-height // (1 << block)), False)
            undo.append((_unpredict, wide, height, block, own[:, 2]) if kind == 0 else (_uncross, wide, height, block, own))
        elif kind == 2:
            undo.append((lambda px, *_: np.stack([px[:, 0], px[:, 1] + px[:, 2], px[:, 2], px[:, 3] + px[:, 2]], 1), wide, height))
        else:
            size = bits.read(8) + 1
            table = np.cumsum(_pixels(bits, size, 1, False), 0, dtype=np.uint8)
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((_unindex, wide, height, packed, table))
            wide = -(-wide // (1 << packed))
    px = _pixels(bits, wide, height, True)
    if bits.pos > bits.end:
        raise ValueError("the stream ends too early")
    for f, *args in reversed(undo):
        px = f(px, *args)
    return width, height, px


# --- encoding of samples -------------------------------------------------------------------------------------------


def huffman(weights, most: int = 15) -> list[int]:
    """Code lengths for positive weights, at most ``most`` bits (weights are flattened until they fit)."""
    w = [float(x) for x in weights]
    while True:
        heap = [(x, i, (i,)) for i, x in enumerate(w) if x > 0]
        lengths = [0] * len(w)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                lengths[i] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max(lengths) <= most:
            return lengths
        floor = max(w) / 4096
        w = [x and max(x, floor) + floor for x in w]


MOST = 11  # the longest code of a picture's own codes
FAR = (1 << 20) - len(NEAR)
LONGEST = 4096


def _lengths(count: np.ndarray) -> list[int]:
    """Code lengths for a picture's own counts, at most MOST bits (small counts are raised until they fit)."""
    out, some = [0] * len(count), np.flatnonzero(count)
    if len(some) < 2:
        for s in some.tolist():
            out[s] = 1
        return out
    weight, floor = count[some].astype(float), count.sum() / 4096
    while True:
        by = np.argsort(weight, kind="stable")
        leaf, n = weight[by].tolist(), len(some)
        up, made, a, b = [0] * (2 * n - 1), [], 0, 0
        for node in range(n, 2 * n - 1):
            total = 0.0
            for _ in range(2):
                if a < n and (b >= len(made) or leaf[a] <= made[b]):
                    up[a], total, a = node, total + leaf[a], a + 1
                else:
                    up[n + b], total, b = node, total + made[b], b + 1
            made.append(total)
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[up[node]] + 1
        if max(depth) <= MOST:
            break
        weight, floor = np.maximum(weight, floor), floor * 2
    for s, d in zip(some[by].tolist(), depth, strict=False):
        out[s] = d
    return out


def _runs(lengths: list[int]) -> np.ndarray:
    """Code lengths as rows of symbol, extra value and extra bits, runs shortened."""
    out, x = [], np.array(lengths)
    begin = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    for n, many in zip(x[begin].tolist(), np.diff(begin, append=len(x)).tolist(), strict=True):
        if n:
            out += (n, 0, 0)
            many -= 1
        while many > 2:
            if n:
                k = min(many, 6)
                out += (16, k - 3, 2)
            else:
                k = min(many, 138)
                out += (18, k - 11, 7) if k > 10 else (17, k - 3, 3)
            many -= k
        out += (n, 0, 0) * many
    return np.array(out, np.int64).reshape(-1, 3)


def _fields(*pairs: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([v for v, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64)


_KINDS = np.array(CODE_LENGTH_ORDER)
_THREE = np.full(19, 3)


def _code(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Header (values, bits), codes and sizes of a picture's own code for symbols of these counts."""
    size, code = np.zeros(len(count), np.int64), np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if len(some) < 2 and (not len(some) or some[0] < 256):
        return *_fields((1, 1), (0, 1), (1, 1), (int(some[0]) if len(some) else 0, 8)), code, size
    lengths = _lengths(count)
    if len(some) > 1:
        used, n, c = _canonical(lengths)
        size[used], code[used] = n, c
    runs = _runs(lengths)
    own = np.array(huffman(np.bincount(runs[:, 0], minlength=19).tolist(), 7))
    words, bits = np.zeros(19, np.int64), own.copy()
    if own.any():
        used, _, c = _canonical(own)
        words[used] = c
    else:  # one kind of length only, which takes no bits
        own[runs[0, 0]] = 1
    value = words[runs[:, 0]] | runs[:, 1] << bits[runs[:, 0]]
    head = np.concatenate([[0, 15], own[_KINDS], [0], value]).astype(np.uint64)
    return head, np.concatenate([[1, 4], _THREE, [1], bits[runs[:, 0]] + runs[:, 2]]), code, size


def _symbol(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, extra values and extra bits of lengths or distances."""
    w = v - 1
    top = np.maximum(np.frexp(np.maximum(w, 1).astype(float))[1] - 1, 1)
    extra = np.where(v > 4, top - 1, 0)
    return np.where(v > 4, 2 * top + (w >> (top - 1) & 1), w), w & ((1 << extra) - 1), extra


def _bits_for(counts: list[np.ndarray]) -> float:
    """About the bits of symbols of several codes with these counts, and of the codes."""
    c = np.concatenate(counts)
    c = c[c > 0]
    totals = [n for x in counts if (n := int(x.sum()))]
    return sum(n * math.log2(n) for n in totals) - float(c @ np.log2(c)) + 5 * len(c)


_near: dict[int, dict[int, int]] = {}


def _distances(d: np.ndarray, width: int) -> np.ndarray:
    if width not in _near:
        if len(_near) > 64:
            _near.clear()
        _near[width] = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    return np.array([_near[width].get(x, x + len(NEAR)) for x in d.tolist()], np.int64)


def _copies(v: np.ndarray) -> list[tuple[int, int, int]]:
    """Copies of three pixels or more as (place, length, distance), each from the last place that has its first two pixels."""
    n = len(v)
    if n < 4:
        return []
    pair = v[:-1].astype(np.uint64) | v[1:].astype(np.uint64) << np.uint64(32)
    order = np.argsort(pair, kind="stable")
    same = np.flatnonzero(pair[order[1:]] == pair[order[:-1]])
    if not len(same):
        return []
    before = dict(zip(order[same + 1].tolist(), order[same].tolist(), strict=True))
    out, free, x = [], 0, v.tolist()
    for i in sorted(before):
        if i < free or i - before[i] > FAR:
            continue
        d, end = i - before[i], i + 2
        most = min(n, i + LONGEST)
        while end < most and x[end] == x[end - d]:
            end += 1
        if end - i > 2:
            out.append((i, end - i, d))
            free = end
    return out


CACHE = 7  # bits of the colour cache


def _letters(upper: bool, accents: bool = False) -> np.ndarray:
    """Weights of bytes of prose: they fall along a fixed order of letters; bytes that prose never has have none."""
    order = "etanoirshdlucmgfypwbvkqxjz"
    w = np.zeros(256)
    w[32:127] = 0.3
    w[128:160], w[160:192], w[192:198] = 0.5, 4.0 if accents else 1.0, 0.5
    w[0xC3], w[0] = 40 if accents else 6, 2
    w[[32, 10]], w[[44, 46]] = (150, 8), (9, 12)
    for i, c in enumerate(order):
        main, rare = (c.upper(), c) if upper else (c, c.upper())
        w[ord(main)], w[ord(rare)] = 100 * 0.87**i, 1.0
    return w


class _Shared:
    """Codes that many files share, so that neither side has to make them anew."""

    def __init__(self, w: np.ndarray):
        w = w / w.sum()
        lengths, cached = 0.02 * 0.7 ** np.arange(24), np.full(1 << CACHE, 0.1 / (1 << CACHE))
        scale = lambda x: np.where(x > 0, np.maximum(1, np.round(1e6 * x)), 0).astype(np.int64)
        first, rest, far = _code(scale(np.concatenate([w, lengths, cached]))), _code(scale(w)), _code(scale(0.5 + np.arange(40) / 20))
        self.codes = [first, rest, rest, rest, far]
        self.bits = sum(int(c[1].sum()) for c in self.codes)

        self.price = np.concatenate([np.where(c[3] > 0, c[3], 1 << 30) for c in self.codes])  # a byte without a code rules the set out

def _picture(v: np.ndarray, width: int, main: bool, shared: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
    """(values, bits) of an entropy-coded picture with copies and a colour cache where it pays.

    With codes of its own, or by ``shared`` codes, if these suit it (else None).
    """
    n = len(v)
    taken = np.zeros(n, bool)
    copies = np.array(_copies(v), np.int64).reshape(-1, 3)
    for a, m, _ in copies.tolist():
        taken[a + 1 : a + m] = True
    at = np.flatnonzero(~taken)
    x = v[at]
    far = np.zeros(n, bool)
    far[copies[:, 0]] = True
    copied = far[at]
    blue, green, red, alpha = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).astype(np.int64)
    (length, dist), (l_value, d_value), (l_extra, d_extra) = (y.reshape(2, -1) for y in _symbol(np.concatenate([copies[:, 1], _distances(copies[:, 2], width)])))
    d_count = np.bincount(dist, minlength=40)

    def counts(bits):
        first, plain = green.copy(), ~copied
        if bits:
            slots = (v * np.uint32(CACHE_FACTOR) >> np.uint32(32 - bits)).astype(np.uint16)  # short numbers sort faster
            order = np.argsort(slots, kind="stable")
            hit = np.zeros(n, bool)
            hit[order[1:]] = (v[order[1:]] == v[order[:-1]]) & (slots[order[1:]] == slots[order[:-1]])
            cached = hit[at] & plain
            first[cached] = 280 + slots[at[cached]].astype(np.int64)
            plain &= ~cached
        first[copied] = 256 + length
        each = np.bincount(np.concatenate([red[plain], blue[plain] + 256, alpha[plain] + 512]), minlength=768)
        return first, plain, [np.bincount(first, minlength=280 + (1 << bits if bits else 0)), *each.reshape(3, 256), d_count]

    cache, codes = 0, None
    other = counts(CACHE) if n > 8 else None
    if shared:
        if other is None:
            return None
        own = _bits_for(other[2])
        price = BITS + PRICES @ np.concatenate(other[2])
        best = int(np.argmin(price))
        if price[best] > max(1.1 * own + 300, min(0.69 * 32 * n + 950, 1.4 * own + 1500)):  # codes of its own would save much
            return None
        codes, cache, (first, plain, count) = SHARED[best].codes, CACHE, other
    else:
        first, plain, count = counts(0)
        if other and _bits_for(other[2]) < _bits_for(count):
            cache, (first, plain, count) = CACHE, other
    head = [(1, 1), (cache, 4)] if cache else [(0, 1)]
    if main:
        head.append((0, 1))
    codes = codes or [*map(_code, count)]
    value, size = codes[0][2][first], codes[0][3][first]
    for (*_, code, bits), symbol in zip(codes[1:4], (red, blue, alpha), strict=True):
        value[plain] |= code[symbol[plain]] << size[plain].astype(np.uint64)
        size[plain] += bits[symbol[plain]]
    for more, bits in ((l_value, l_extra), (codes[4][2][dist], codes[4][3][dist]), (d_value, d_extra)):
        value[copied] |= more.astype(np.uint64) << size[copied].astype(np.uint64)
        size[copied] += bits
    parts = [_fields(*head), *(c[:2] for c in codes), (value, size)]
    return np.concatenate([v for v, _ in parts]), np.concatenate([n for _, n in parts])


SHARED = [_Shared(w) for w in (_letters(False), _letters(False, True), _letters(True))]
BITS, PRICES = np.array([x.bits for x in SHARED]), np.stack([x.price for x in SHARED])


def _argb(px: np.ndarray) -> np.ndarray:
    """Pixels (a, r, g, b) as numbers."""
    return np.ascontiguousarray(px, np.uint8).view(">u4").ravel().astype(np.uint32)


def _channels(variants: np.ndarray) -> np.ndarray:
    """About the bits of each variant (variant, pixel, channel), by the counts of its channels' values."""
    m, n, _ = variants.shape
    count = np.bincount((variants + (np.arange(4 * m, dtype=np.int32) * 256).reshape(m, 1, 4)).ravel(), minlength=1024 * m).reshape(m, 1024)
    some = count > 0
    return 4 * n * math.log2(n) - (count * np.log2(np.where(some, count, 1))).sum(1) + 5 * some.sum(1)


def _predicted(px: np.ndarray, width: int) -> list[np.ndarray]:
    """Differences from the prediction of each of MODES."""
    flat = np.concatenate([np.zeros((width + 1, 4), np.uint8), px])
    n, o = len(px), width + 1
    left, top, corner = (flat[o - k : o - k + n] for k in (1, width, width + 1))
    slope = np.clip(left.astype(np.int16) + top - corner, 0, 255).astype(np.uint8)
    out = []
    for guess in (left, top, slope):
        r = px - guess
        r[::width] = (px - top)[::width]
        r[:width] = (px - left)[:width]
        r[0] = px[0] - np.array([255, 0, 0, 0], np.uint8)
        out.append(r)
    return out


def _crossed(px: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Red and blue less their share of green, and the factors (of green in red, of green in blue)."""
    out, green, factors = px.copy(), _signed(px[:, 2]), []
    square = int(green @ green)
    for c in (1, 3):
        f = int(np.clip(round(32 * int(green @ _signed(px[:, c])) / square), -128, 127)) if square else 0
        out[:, c] = (px[:, c] - (f * green >> 5)) & 255
        factors.append(f & 255)
    return out, factors


MODES = (1, 2, 12)  # left, top, gradient


def _less_green(px: np.ndarray) -> np.ndarray:
    out = px.copy()
    out[:, [1, 3]] -= px[:, [2]]
    return out


def _coded(px: np.ndarray, width: int, height: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, bits) of a picture from its transforms on: by shared codes if they suit it, else as its channels' counts favour."""
    v = _argb(px)
    if plain := _picture(v, width, True, True):
        return [_LAST, plain]
    crossed, factors = _crossed(px)
    cost = _channels(np.stack([px, *_predicted(px, width), crossed, _less_green(px)]))
    cost[4] += 60
    cost[5] += 3
    distinct = np.unique(v)
    k = len(distinct)
    if 2 * k <= len(v) and k <= 256:
        index = np.searchsorted(distinct, v)
        c = np.bincount(index)
        if len(v) * math.log2(len(v)) - float(c @ np.log2(c)) + 25 * k < cost.min():
            packed = 3 if k <= 2 else 2 if k <= 4 else 1 if k <= 16 else 0
            per, bits = 1 << packed, 8 >> packed
            wide = -(-width // per)
            cells = np.zeros((height, wide * per), np.int64)
            cells[:, :width] = index.reshape(height, width)
            cells = (cells.reshape(height, wide, per) << np.arange(per) * bits).sum(2).ravel()
            table = np.diff(distinct.astype(">u4").view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8))
            return [_fields((1, 1), (3, 2), (k - 1, 8)), _picture(_argb(table), k, False), _LAST, _picture((cells << 8).astype(np.uint32), wide, True)]
    best = int(cost.argmin())
    places = (-(-width // 512)) * (-(-height // 512))
    flat = lambda pixel: _picture(np.full(places, pixel, np.uint32), -(-width // 512), False)  # noqa: E731  one value for all blocks
    steps = []
    if 0 < best < 4:
        steps += [_fields((1, 1), (0, 2), (7, 3)), flat(MODES[best - 1] << 8)]
        px = _predicted(px, width)[best - 1]
        crossed, factors = _crossed(px)
        again = _channels(np.stack([px, crossed, _less_green(px)])) + [0, 60, 3]
        best = (0, 4, 5)[int(again.argmin())]
    if best == 4:
        steps += [_fields((1, 1), (1, 2), (7, 3)), flat(factors[1] << 8 | factors[0])]
        px = crossed
    elif best == 5:
        steps.append(_fields((1, 1), (2, 2)))
        px = _less_green(px)
    return [*steps, _LAST, _picture(_argb(px), width, True)]


_LAST = np.zeros(1, np.uint64), np.ones(1, np.int64)  # the bit that ends the list of transforms


def encode(samples: np.ndarray, width: int, height: int) -> bytes:
    """The WebP file of width x height pixels whose samples stand in coding order (green, red, blue, alpha)."""
    parts = [_fields((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)), *_coded(samples.reshape(-1, 4)[:, [3, 1, 0, 2]], width, height)]
    value, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    end = np.cumsum(n)
    begin = end - n
    words = np.zeros((int(end[-1]) + 63) // 64 + 1, "<u8")
    slot, shift = begin >> 6, (begin & 63).astype(np.uint64)
    first = np.concatenate([[0], np.flatnonzero(slot[1:] != slot[:-1]) + 1])
    words[slot[first]] |= np.bitwise_or.reduceat(value << shift, first)
    over = np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    words[slot[first] + 1] |= np.bitwise_or.reduceat(over, first)
    body = words.tobytes()[: (int(end[-1]) + 7) // 8]
    pad = bytes(len(body) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 4 + 8 + len(body) + len(pad), b"WEBP", b"VP8L", len(body)) + body + pad
