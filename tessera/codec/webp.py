"""WebP: the container with animation, lossless decoding with all transforms, and lossless encoding.

Lossy pictures come back as unsupported. The encoder takes green from red and
blue and writes one group of prefix codes without back references.
"""

from __future__ import annotations

import struct

import numpy as np

from tessera.codec import Malformed, Unsupported, check_budget
from tessera.codec.blend import source_over

# Fixed values of the format: order of code length codes, and offsets (x, y) of the 120 short distances.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


class _Bits:
    """Least significant bit first; reading past the end is damage."""

    def __init__(self, raw: bytes):
        self.value, self.left = int.from_bytes(raw[:64], "little"), 8 * len(raw[:64])
        self.raw, self.at = raw, 64

    def get(self, n: int) -> int:
        if self.left < n:
            part = self.raw[self.at : self.at + 64]
            self.at += 64
            self.value |= int.from_bytes(part, "little") << self.left
            self.left += 8 * len(part)
            if self.left < n:
                raise Malformed("WEBP: data is cut off")
        got = self.value & ((1 << n) - 1)
        self.value >>= n
        self.left -= n
        return got


class _Prefix:
    """Canonical code as a dictionary from (length, code) to symbol; a lone symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.lone = used[0][1] if len(used) == 1 else None
        if not used:
            raise Malformed("WEBP: empty prefix code")
        self.codes, code, before = {}, 0, 0
        if self.lone is None:
            if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
                raise Malformed("WEBP: incomplete prefix code")
            for n, s in sorted(used):
                code <<= n - before
                before = n
                self.codes[n, code] = s
                code += 1

    def read(self, bits: _Bits) -> int:
        if self.lone is not None:
            return self.lone
        code = n = 0
        while n < 15:
            code, n = code << 1 | bits.get(1), n + 1
            got = self.codes.get((n, code))
            if got is not None:
                return got
        raise Malformed("WEBP: bad prefix code")


def _prefix(bits: _Bits, size: int) -> _Prefix:
    lengths = [0] * size
    if bits.get(1):
        two = bits.get(1)
        symbols = [bits.get(8 if bits.get(1) else 1)] + ([bits.get(8)] if two else [])
        for s in symbols:
            if s >= size:
                raise Malformed("WEBP: symbol beyond the alphabet")
            lengths[s] = 1
        return _Prefix(lengths)
    own = [0] * 19
    for i in range(4 + bits.get(4)):
        own[LENGTH_ORDER[i]] = bits.get(3)
    table, most = _Prefix(own), size
    if bits.get(1):
        most = 2 + bits.get(2 + 2 * bits.get(3))
    at, before = 0, 8
    while at < size and most:
        most -= 1
        s = table.read(bits)
        if s < 16:
            lengths[at] = s
            at, before = at + 1, s or before
            continue
        value, n = (before, 3 + bits.get(2)) if s == 16 else (0, 3 + bits.get(3)) if s == 17 else (0, 11 + bits.get(7))
        if at + n > size:
            raise Malformed("WEBP: code lengths")
        lengths[at : at + n] = [value] * n
        at += n
    return _Prefix(lengths)


def _extended(bits: _Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.get(extra) + 1


def _coded(bits: _Bits, width: int, height: int, main: bool) -> list[int]:
    """Pixels (a, r, g, b packed) of an entropy-coded image."""
    cache_bits = bits.get(4) if bits.get(1) else 0
    if cache_bits > 11:
        raise Malformed("WEBP: colour cache")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    which, groups, block = None, 1, 0
    if main and bits.get(1):
        block = bits.get(3) + 2
        across = (width + (1 << block) - 1) >> block
        which = [p >> 8 & 0xFFFF for p in _coded(bits, across, (height + (1 << block) - 1) >> block, False)]
        groups = max(which) + 1
    sizes = (280 + len(cache), 256, 256, 256, 40)
    codes = [[_prefix(bits, n) for n in sizes] for _ in range(groups)]
    out: list[int] = []
    total, cached = width * height, 0
    while len(out) < total:
        at = len(out)
        g = codes[which[(at // width >> block) * across + (at % width >> block)]] if which else codes[0]
        s = g[0].read(bits)
        if s < 256:
            r, b, a = g[1].read(bits), g[2].read(bits), g[3].read(bits)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n, d = _extended(bits, s - 256), _extended(bits, g[4].read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise Malformed("WEBP: back reference")
            for _ in range(n):
                out.append(out[-d])
        else:
            while cached < len(out):
                cache[(0x1E35A7BD * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out.append(cache[s - 280])
    return out


def _bytes(pixels: list[int], width: int) -> np.ndarray:
    """(height, width, 4) as a, r, g, b."""
    return np.array(pixels, ">u4").view(np.uint8).reshape(-1, width, 4)


def _mean(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b)]


def _guess(mode, left, top, corner, right):
    """Prediction from the neighbours left, above, above left and above right."""
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode < 11:
        if mode == 5:
            return _mean(_mean(left, right), top)
        if mode == 10:
            return _mean(_mean(left, corner), _mean(top, right))
        pairs = {6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}
        return _mean(*pairs[mode])
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner))
        to_top = sum(abs(x - c) for x, c in zip(left, corner))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, corner)]
    half = _mean(left, top)
    return [min(255, max(0, h + int((h - c) / 2))) for h, c in zip(half, corner)]


def _unpredict(image: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width = image.shape[:2]
    rows: list[list] = []
    for y in range(height):
        row: list = []
        residual = image[y].tolist()
        for x in range(width):
            if y == 0:
                guess = row[x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                guess = rows[y - 1][0]
            else:
                up = rows[y - 1]
                guess = _guess(int(modes[y >> block, x >> block, 2]) & 15, row[x - 1], up[x], up[x - 1], up[x + 1] if x + 1 < width else row[0])
            row.append([(v + g) & 255 for v, g in zip(residual[x], guess)])
        rows.append(row)
    return np.array(rows, np.uint8)


def _uncross(image: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    height, width = image.shape[:2]
    f = factors.repeat(1 << block, 0).repeat(1 << block, 1)[:height, :width].view(np.int8).astype(np.int64)
    green, out = image[..., 2].view(np.int8).astype(np.int64), image.copy()
    red = (image[..., 1] + (f[..., 3] * green >> 5)).astype(np.uint8)
    blue = image[..., 3] + (f[..., 2] * green >> 5) + (f[..., 1] * red.view(np.int8).astype(np.int64) >> 5)
    out[..., 1], out[..., 3] = red, blue.astype(np.uint8)
    return out


def decode_lossless(raw: bytes, size: tuple[int, int] | None = None) -> np.ndarray:
    bits = _Bits(raw)
    if bits.get(8) != 0x2F:
        raise Malformed("WEBP: lossless signature")
    width, height = bits.get(14) + 1, bits.get(14) + 1
    has_alpha = bits.get(1)
    if bits.get(3):
        raise Malformed("WEBP: lossless version")
    if size and size != (width, height):
        raise Malformed("WEBP: sizes disagree")
    check_budget(width, height, len(raw))
    steps, now = [], width
    while bits.get(1):
        kind = bits.get(2)
        if any(kind == k for k, *_ in steps):
            raise Malformed("WEBP: transform given twice")
        if kind < 2:
            block = bits.get(3) + 2
            w, h = (now + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            steps.append((kind, now, _bytes(_coded(bits, w, h, False), w), block))
        elif kind == 2:
            steps.append((kind, now, None, 0))
        else:
            n = bits.get(8) + 1
            table = np.cumsum(_bytes(_coded(bits, n, 1, False), n)[0], 0, dtype=np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, now, table, pack))
            now = (now + (1 << pack) - 1) >> pack
    image = _bytes(_coded(bits, now, height, True), now)
    for kind, wide, data, n in reversed(steps):
        if kind == 0:
            image = _unpredict(image, data, n)
        elif kind == 1:
            image = _uncross(image, data, n)
        elif kind == 2:
            image = image.copy()
            image[..., 1] += image[..., 2]
            image[..., 3] += image[..., 2]
        else:
            index = image[..., 2].astype(int)
            if n:
                per = 8 >> n
                shifts = np.arange(0, 8, per)
                index = ((index[:, :, None] >> shifts) & ((1 << per) - 1)).reshape(height, -1)[:, :wide]
            whole = np.zeros((256, 4), np.uint8)
            whole[: len(data)] = data
            image = whole[index]
    out = image[..., [1, 2, 3, 0]].copy()
    if not has_alpha:
        out[..., 3] = 255
    return out


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > end:
            raise Malformed("WEBP: chunk is cut off")
        yield kind, data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)


def _picture(parts) -> np.ndarray:
    for kind, body in parts:
        if kind == b"VP8L":
            return decode_lossless(body)
        if kind == b"VP8 ":
            raise Unsupported("WEBP: lossy pictures are not decoded by this build")
    raise Malformed("WEBP: no image")


def decode_frames(data: bytes, max_frames: int | None = None):
    """(frames, plays): composited canvases with delays; a still is one frame without delay."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Malformed("WEBP: no header")
    end = min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    parts = list(_chunks(data, 12, end))
    if not any(k == b"ANMF" for k, _ in parts):
        return [(_picture(parts), 0)], 1
    canvas, plays, out, dispose = None, 0, [], None
    total = sum(k == b"ANMF" for k, _ in parts)
    for kind, body in parts:
        if kind == b"VP8X":
            width, height = 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
            check_budget(width, height, len(data), 8, total)
            canvas = np.zeros((height, width, 4), np.uint8)
        elif kind == b"ANIM":
            plays = struct.unpack_from("<H", body, 4)[0]
        elif kind == b"ANMF":
            if canvas is None or len(body) < 16:
                raise Malformed("WEBP: frame without a canvas")
            if max_frames is not None and len(out) >= max_frames:
                break
            x, y, w, h, ms = (int.from_bytes(body[3 * i : 3 * i + 3], "little") for i in range(5))
            x, y, w, h = 2 * x, 2 * y, w + 1, h + 1
            if x + w > canvas.shape[1] or y + h > canvas.shape[0]:
                raise Malformed("WEBP: frame outside the canvas")
            if dispose:
                canvas[dispose[1] : dispose[1] + dispose[3], dispose[0] : dispose[0] + dispose[2]] = 0
            own = _picture(_chunks(body, 16, len(body)))
            if own.shape[:2] != (h, w):
                raise Malformed("WEBP: sizes disagree")
            part = canvas[y : y + h, x : x + w]
            part[...] = own if body[15] & 2 else source_over(own, part)
            dispose = (x, y, w, h) if body[15] & 1 else None
            out.append((canvas.copy(), ms if ms > 10 else 100))
    return out, plays


def decode(data: bytes) -> np.ndarray:
    return decode_frames(data, 1)[0][0][0]


class _Writer:
    def __init__(self):
        self.value, self.n = 0, 0
        self.out = bytearray()

    def put(self, value: int, n: int):
        self.value |= value << self.n
        self.n += n
        while self.n >= 8:
            self.out.append(self.value & 255)
            self.value >>= 8
            self.n -= 8

    def code(self, code: int, n: int):
        """Codes go in from their first bit, values from their last."""
        self.put(int(f"{code:0{n}b}"[::-1], 2) if n else 0, n)


def _lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Package-merge over symbols that occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), int)
    if len(used) < 2:
        out[used] = 1
        return out
    base = sorted((int(counts[s]), (int(s),)) for s in used)
    row: list = []
    for _ in range(limit):
        pairs = [(row[i][0] + row[i + 1][0], row[i][1] + row[i + 1][1]) for i in range(0, len(row) - 1, 2)]
        row = sorted(base + pairs, key=lambda v: v[0])
    for _, symbols in row[: 2 * len(base) - 2]:
        for s in symbols:
            out[s] += 1
    return out


def _write_prefix(w: _Writer, counts: np.ndarray):
    """Writes a code for a histogram; gives (code, bits) by symbol."""
    used = np.flatnonzero(counts)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        w.put(1, 1)
        w.put(0, 1)
        w.put(1, 1)
        w.put(int(used[0]) if len(used) else 0, 8)
        return {int(used[0]) if len(used) else 0: (0, 0)}
    lengths = _lengths(counts, 15)
    own = _lengths(np.bincount(lengths, minlength=19), 7)
    if np.count_nonzero(own) == 1:
        own[0 if not own[0] else 1] = 1  # a code of two, so that every length takes a bit
    w.put(0, 1)
    w.put(15, 4)
    for s in LENGTH_ORDER:
        w.put(int(own[s]), 3)
    w.put(0, 1)
    codes = _canonical(own)
    for n in lengths.tolist():
        w.code(*codes[n])
    return _canonical(lengths)


def _canonical(lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    out, code, before = {}, 0, 0
    for n, s in sorted((int(n), s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        before = n
        out[s] = (code, n)
        code += 1
    return out


def encode(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]
    if max(width, height) > 16384:
        raise ValueError(f"{width}x{height} is beyond 16384 a side")
    alpha = bool((image[..., 3] < 255).any())
    w = _Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(alpha, 1)
    w.put(0, 3)
    w.put(1, 1)
    w.put(2, 2)  # green is taken from red and blue
    w.put(0, 1)
    w.put(0, 1)  # no colour cache
    w.put(0, 1)  # one group of codes
    r, g, b, a = (image[..., i].reshape(-1) for i in range(4))
    planes = [g, r - g, b - g, a]
    codes = [_write_prefix(w, np.bincount(p, minlength=280 if i == 0 else 256)) for i, p in enumerate(planes)]
    _write_prefix(w, np.zeros(40, int))
    for values in zip(*(p.tolist() for p in planes)):
        for table, v in zip(codes, values):
            w.code(*table[v])
    if w.n:
        w.put(0, 8 - w.n)
    body = bytes(w.out)
    chunk = struct.pack("<4sI", b"VP8L", len(body)) + body + b"\0" * (len(body) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(chunk), b"WEBP") + chunk
