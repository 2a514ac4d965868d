"""JPEG: Huffman-coded baseline, extended and progressive decoding at 8 bits, and baseline encoding.

Entropy decoding yields coefficient blocks; dequantization, the inverse
transform, upsampling and colour are array operations over all blocks or rows.
The inverse transform is the integer one with 12 fractional bits whose outputs
are rounded after each pass, and chroma is upsampled with 3:1 weights.
"""

from __future__ import annotations

import struct
from operator import itemgetter

import numpy as np

from tessera.codec import Malformed, Unsupported, check_budget


def zigzag_order() -> np.ndarray:
    """Row-major places of the 64 coefficients along the anti-diagonals, alternating direction."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


ZIGZAG = zigzag_order()
PLACES = ZIGZAG.tolist()
#: Blocks of all components that are transformed in one call.
TOGETHER = 1 << 12


class _Huffman:
    """Codes looked up by 16 bits: symbol and length."""

    def __init__(self, counts, symbols):
        if len(symbols) != sum(counts):
            raise Malformed("JPEG: Huffman table")
        spans, sizes, at = [], [], 0
        for n in range(1, 17):
            spans += [bytes([v]) * (1 << (16 - n)) for v in symbols[at : at + counts[n - 1]]]
            sizes.append(bytes([n]) * (counts[n - 1] << (16 - n)))
            at += counts[n - 1]
        self.symbol, self.size = b"".join(spans), b"".join(sizes)
        if len(self.size) > 1 << 16:
            raise Malformed("JPEG: Huffman table")
        self.symbol, self.size = self.symbol.ljust(1 << 16, b"\0"), self.size.ljust(1 << 16, b"\0")


class _Bits:
    """Most significant bit first, with stuffed zero bytes already removed; reads past the end give zeros."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.acc, self.n = raw, 0, 0, 0

    def _fill(self):
        part = self.raw[self.at : self.at + 6]
        if not part and self.at > len(self.raw) + 64:
            raise Malformed("JPEG: scan data is cut off")
        self.at += 6
        self.acc = ((self.acc & ((1 << self.n) - 1)) << 48) | int.from_bytes(part.ljust(6, b"\0"), "big")
        self.n += 48

    def get(self, k: int) -> int:
        if not k:
            return 0
        if self.n < k:
            self._fill()
        self.n -= k
        return (self.acc >> self.n) & ((1 << k) - 1)

    def symbol(self, table: _Huffman) -> int:
        if self.n < 16:
            self._fill()
        peek = (self.acc >> (self.n - 16)) & 0xFFFF
        size = table.size[peek]
        if not size:
            raise Malformed("JPEG: bad code")
        self.n -= size
        return table.symbol[peek]

    def signed(self, k: int) -> int:
        v = self.get(k)
        return v if not k or v >> (k - 1) else v - (1 << k) + 1


class _Component:
    def __init__(self, name, h, v, table):
        self.name, self.h, self.v, self.table, self.dc = name, h, v, table, 0


def _segments(data: bytes):
    """(marker, body, scan data with restart intervals apart)."""
    if data[:2] != b"\xff\xd8":
        raise Malformed("JPEG: no start")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xFF, 0) or 0xD0 <= marker <= 0xD8 or marker == 1:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            return
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) < size - 2:
            raise Malformed("JPEG: segment is cut off")
        at += 2 + size
        scans = []
        if marker == 0xDA:
            start = at
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    at = len(data)
                    break
                if data[at + 1] == 0:
                    at += 2
                elif 0xD0 <= data[at + 1] <= 0xD7:
                    scans.append(data[start:at].replace(b"\xff\0", b"\xff"))
                    at += 2
                    start = at
                elif data[at + 1] == 0xFF:
                    at += 1
                else:
                    break
            scans.append(data[start:at].replace(b"\xff\0", b"\xff"))
        yield marker, body, scans


class _Decoder:
    def __init__(self, data: bytes):
        self.quant, self.huffman, self.parts = {}, {}, []
        self.restart, self.adobe, self.size, self.progressive, self.scans = 0, -1, None, False, 0
        for marker, body, scans in _segments(data):
            if marker == 0xDB:
                self._tables(body)
            elif marker == 0xC4:
                self._codes(body)
            elif marker == 0xDD:
                self.restart = struct.unpack_from(">H", body)[0]
            elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif marker in (0xC0, 0xC1, 0xC2):
                self._frame(marker, body, len(data))
            elif 0xC3 <= marker <= 0xCF and marker != 0xCC:
                raise Unsupported(f"JPEG: frame type {marker:#x}")
            elif marker == 0xDA:
                self._scan(body, scans)
        if self.size is None or not self.scans:
            raise Malformed("JPEG: no image")

    def _tables(self, body):
        at = 0
        while at < len(body):
            wide, name = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            if at + 1 + n > len(body):
                raise Malformed("JPEG: quantization table")
            table = np.zeros(64, np.int64)
            table[ZIGZAG] = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1)
            self.quant[name], at = table, at + 1 + n

    def _codes(self, body):
        at = 0
        while at + 17 <= len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.huffman[body[at]] = _Huffman(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, marker, body, length):
        if self.size is not None or len(body) < 6:
            raise Malformed("JPEG: frame header")
        depth, height, width, n = struct.unpack_from(">BHHB", body)
        if depth != 8:
            raise Unsupported(f"JPEG: {depth} bits")
        if n not in (1, 3, 4) or len(body) < 6 + 3 * n:
            raise Malformed("JPEG: components")
        check_budget(width, height, length)
        self.size, self.progressive = (width, height), marker == 0xC2
        for i in range(n):
            name, hv, table = body[6 + 3 * i : 9 + 3 * i]
            if not (1 <= hv >> 4 <= 4 and 1 <= hv & 15 <= 4):
                raise Malformed("JPEG: sampling")
            self.parts.append(_Component(name, hv >> 4, hv & 15, table))
        self.hmax, self.vmax = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.across, self.down = -(-width // (8 * self.hmax)), -(-height // (8 * self.vmax))
        for c in self.parts:
            c.width, c.height = -(-width * c.h // self.hmax), -(-height * c.v // self.vmax)
            c.rows, c.columns = self.down * c.v, self.across * c.h
            c.blocks = np.zeros((c.rows * c.columns, 64), np.int32)

    def _scan(self, body, intervals):
        if self.size is None or len(body) < 1 or len(body) < 4 + 2 * body[0]:
            raise Malformed("JPEG: scan header")
        chosen = []
        for i in range(body[0]):
            name, tables = body[1 + 2 * i : 3 + 2 * i]
            part = next((c for c in self.parts if c.name == name), None)
            if part is None:
                raise Malformed("JPEG: scan component")
            chosen.append((part, self.huffman.get(tables >> 4), self.huffman.get(16 + (tables & 15))))
        low, high, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
        if not self.progressive:
            low, high, approx = 0, 63, 0
        if low > high or high > 63 or (self.progressive and low and len(chosen) > 1):
            raise Malformed("JPEG: spectral selection")
        units = []
        if len(chosen) == 1:
            c = chosen[0][0]
            for y in range(-(-c.height // 8)):
                units += [[(0, y * c.columns + x)] for x in range(-(-c.width // 8))]
        else:
            for y in range(self.down):
                for x in range(self.across):
                    units.append([(i, (y * c.v + v) * c.columns + x * c.h + h) for i, (c, _, _) in enumerate(chosen) for v in range(c.v) for h in range(c.h)])
        step = self.restart or len(units)
        for k, first in enumerate(range(0, len(units), step)):
            if k >= len(intervals):
                break
            bits, self.run = _Bits(intervals[k]), 0
            for c, _, _ in chosen:
                c.dc = 0
            for unit in units[first : first + step]:
                for i, at in unit:
                    part, dc, ac = chosen[i]
                    self._block(bits, part, part.blocks[at], dc, ac, low, high, approx >> 4, approx & 15)
        self.scans += 1

    def _block(self, bits, part, block, dc, ac, low, high, before, shift):
        if low == 0 and (not self.progressive or before == 0):
            if dc is None:
                raise Malformed("JPEG: no DC table")
            part.dc += bits.signed(min(bits.symbol(dc), 16))
            block[0] = ((part.dc << shift) + 0x80000000) % 0x100000000 - 0x80000000
        elif low == 0:
            block[0] |= bits.get(1) << shift
        if high == 0 or (self.progressive and low == 0):
            return
        if ac is None:
            raise Malformed("JPEG: no AC table")
        k = max(low, 1)
        if self.progressive and before:
            return self._refine(bits, block, ac, k, high, 1 << shift)
        if self.run:
            self.run -= 1
            return
        while k <= high:
            rs = bits.symbol(ac)
            r, s = rs >> 4, rs & 15
            if s == 0:
                if r == 15:
                    k += 16
                    continue
                if self.progressive:
                    self.run = (1 << r) - 1 + bits.get(r)
                return
            k += r
            if k > 63:
                raise Malformed("JPEG: coefficient beyond the block")
            block[PLACES[k]] = bits.signed(s) << shift
            k += 1

    def _refine(self, bits, block, ac, k, high, bit):
        def correct(place):
            if bits.get(1) and not int(block[place]) & bit:
                block[place] += bit if block[place] > 0 else -bit

        if not self.run:
            while k <= high:
                rs = bits.symbol(ac)
                r, s = rs >> 4, rs & 15
                value = 0
                if s == 0:
                    if r < 15:
                        self.run = (1 << r) + bits.get(r)
                        break
                else:
                    value = bit if bits.get(1) else -bit
                while k <= high:
                    place = PLACES[k]
                    k += 1
                    if block[place]:
                        correct(place)
                    elif r == 0:
                        if value:
                            block[place] = value
                        break
                    else:
                        r -= 1
        if self.run:
            while k <= high:
                if block[PLACES[k]]:
                    correct(PLACES[k])
                k += 1
            self.run -= 1

    def planes(self, side: int = 8) -> list[np.ndarray]:
        """Stored samples of each component, whole blocks included, with blocks of side x side."""
        if any(c.table not in self.quant for c in self.parts):
            raise Malformed("JPEG: no quantization table")
        scaled = [c.blocks.astype(np.int64) * self.quant[c.table] for c in self.parts]
        turned = inverse if side == 8 else lambda blocks: inverse_small(blocks, side)
        if sum(map(len, scaled)) <= TOGETHER:  # small pictures: one transform of all components
            made = np.split(turned(np.concatenate(scaled)), np.cumsum([len(x) for x in scaled[:-1]]))
        else:
            made = map(turned, scaled)
        out = []
        for c, pixels in zip(self.parts, made):
            out.append(pixels.reshape(c.rows, c.columns, side, side).swapaxes(1, 2).reshape(c.rows * side, c.columns * side))
        return out


def _fixed(x: float) -> int:
    return int(x * 4096 + 0.5) if x >= 0 else int(x * 4096 - 0.5)


def _pass(s):
    """One dimension of the inverse transform over the first axis: even and odd halves, 12 fractional bits."""
    turn = (s[2] + s[6]) * _fixed(0.5411961)
    a, b = turn + s[6] * _fixed(-1.847759065), turn + s[2] * _fixed(0.765366865)
    c, d = (s[0] + s[4]) * 4096, (s[0] - s[4]) * 4096
    even = [c + b, d + a, d - a, c - b]
    all_odd = (s[7] + s[3] + s[5] + s[1]) * _fixed(1.175875602)
    p71, p53 = all_odd + (s[7] + s[1]) * _fixed(-0.899976223), all_odd + (s[5] + s[3]) * _fixed(-2.562915447)
    p73, p51 = (s[7] + s[3]) * _fixed(-1.961570560), (s[5] + s[1]) * _fixed(-0.390180644)
    odd = [
        s[1] * _fixed(1.501321110) + p71 + p51,
        s[3] * _fixed(3.072711026) + p53 + p73,
        s[5] * _fixed(2.053119869) + p53 + p51,
        s[7] * _fixed(0.298631336) + p71 + p73,
    ]
    return even, odd


def inverse(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 8, 8) of dequantized blocks (n, 64)."""
    s = blocks.reshape(-1, 8, 8)
    even, odd = _pass([s[:, i, :] for i in range(8)])
    mid = np.stack([(e + 512 + o) >> 10 for e, o in zip(even, odd)] + [(e + 512 - o) >> 10 for e, o in zip(even[::-1], odd[::-1])], 1)
    even, odd = _pass([mid[:, :, i] for i in range(8)])
    bias = 65536 + (128 << 17)
    out = np.stack([(e + bias + o) >> 17 for e, o in zip(even, odd)] + [(e + bias - o) >> 17 for e, o in zip(even[::-1], odd[::-1])], 2)
    return np.clip(out, 0, 255).astype(np.uint8)


def _taller(p: np.ndarray) -> np.ndarray:
    """Both output rows of each row, unrounded: three parts of it and one of the neighbour, summing to four."""
    above, below = np.concatenate([p[:1], p[:-1]]), np.concatenate([p[1:], p[-1:]])
    return np.stack([3 * p + above, 3 * p + below], 1).reshape(-1, p.shape[1])


def _wider(p: np.ndarray) -> np.ndarray:
    left, right = np.concatenate([p[:, :1], p[:, :-1]], 1), np.concatenate([p[:, 1:], p[:, -1:]], 1)
    return np.stack([3 * p + left, 3 * p + right], 2).reshape(len(p), -1)


def upsample(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    p = plane.astype(np.int64)
    if (across, down) == (2, 1):
        return (_wider(p) + 2) >> 2
    if (across, down) == (1, 2):
        return (_taller(p) + 2) >> 2
    if (across, down) == (2, 2):
        return (_wider(_taller(p)) + 8) >> 4
    return p.repeat(across, 1).repeat(down, 0)


def _rgb(y, cb, cr):
    fixed = {k: int(v * 4096 + 0.5) << 8 for k, v in {"r": 1.402, "gr": 0.71414, "gb": 0.34414, "b": 1.772}.items()}
    base, cb, cr = (y << 20) + (1 << 19), cb - 128, cr - 128
    sums = [base + cr * fixed["r"], base - cr * fixed["gr"] + ((cb * -fixed["gb"]) & -65536), base + cb * fixed["b"]]
    return [np.clip(v >> 20, 0, 255) for v in sums]


def _multiply(x, y):
    t = x * y + 128
    return (t + (t >> 8)) >> 8


def inverse_small(blocks: np.ndarray, side: int) -> np.ndarray:
    """Samples (n, side, side) of dequantized blocks at a half, a quarter or an eighth of their size: averages of the full ones."""
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    means = basis.reshape(8, side, 8 // side).mean(2)
    return np.clip(np.floor(means.T @ blocks.reshape(-1, 8, 8) @ means + 128.5), 0, 255).astype(np.uint8)


def components(data: bytes, reduction: int = 1) -> list[np.ndarray]:
    """Stored components at full size (or a half, a quarter, an eighth, rounded up), before colour conversion."""
    d = _Decoder(data)
    width, height = (-(-n // reduction) for n in d.size)
    out = []
    for c, plane in zip(d.parts, d.planes(8 // reduction)):
        plane = plane[: -(-c.height // reduction), : -(-c.width // reduction)]
        if d.hmax % c.h or d.vmax % c.v:
            rows, columns = np.arange(height) * c.v // d.vmax, np.arange(width) * c.h // d.hmax
            out.append(plane[rows][:, columns].astype(np.int64))
        else:
            out.append(upsample(plane, d.hmax // c.h, d.vmax // c.v)[:height, :width])
    return out, d


def frame_kind(data: bytes) -> int | None:
    """Marker of the frame header."""
    return next((marker for marker, _, _ in _segments(data) if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)), None)


def decode(data: bytes, reduction: int = 1) -> np.ndarray:
    """r, g, b, a; with a reduction of 2, 4 or 8 the inverse transform itself gives the smaller picture."""
    if reduction not in (1, 2, 4, 8):
        raise ValueError("reductions of 1, 2, 4 and 8")
    if frame_kind(data) == 0xC3:
        from tessera.codec import jpeg_lossless, scale

        return scale.reduced(jpeg_lossless.decode(data), reduction)
    planes, d = components(data, reduction)
    names = bytes(c.name for c in d.parts)
    if len(planes) == 1:
        rgb = planes * 3
    elif len(planes) == 3:
        rgb = planes if d.adobe == 0 or (d.adobe < 0 and names == b"RGB") else _rgb(*planes)
    elif d.adobe == 2:
        rgb = [_multiply(255 - v, planes[3]) for v in _rgb(*planes[:3])]
    else:
        rgb = [_multiply(v, planes[3]) for v in planes[:3]]
    alpha = np.full(planes[0].shape, 255)
    return np.stack([*rgb, alpha], -1).astype(np.uint8)


# Fixed values of the format's example tables, in natural (row) order.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
] + [99] * 32


def _quality(table, quality):
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


def _code_lengths(counts: dict[int, int]):
    """Canonical table of at most 16 bits, no code of ones only: (counts of each length, symbols)."""
    leaves = sorted((n, s) for s, n in counts.items()) + [(1 << 60, 256)]  # the last one keeps the all-ones code free
    order = [s for _, s in sorted(leaves, key=lambda x: x[0] if x[1] != 256 else 0)]
    weight = {s: (0 if s == 256 else n) for n, s in leaves}
    row, depth = [], dict.fromkeys(order, 0)
    base = sorted(((weight[s], (s,)) for s in order), key=itemgetter(0))
    for _ in range(16):
        pairs = [(row[i][0] + row[i + 1][0], row[i][1] + row[i + 1][1]) for i in range(0, len(row) - 1, 2)]
        before, row = row, sorted(base + pairs, key=itemgetter(0))
        if row == before:  # so are all later ones
            break
    for _, symbols in row[: 2 * len(order) - 2]:
        for s in symbols:
            depth[s] += 1
    depth[256] = max(depth.values()) if len(order) > 1 else 1
    by = sorted((d, s) for s, d in depth.items() if s != 256)
    all_sizes = [d for d, _ in by]
    sizes = [all_sizes.count(n) for n in range(1, 17)]
    return sizes, [s for _, s in by]


def _forward(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    h, w = plane.shape
    blocks = plane.reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8) - 128.0
    made = (basis @ blocks @ basis.T).reshape(-1, 64)
    return np.rint(made / table).astype(np.int64)[:, ZIGZAG]


def _events(blocks: np.ndarray, order: np.ndarray):
    """(DC symbol or AC symbol, extra bits, their number) of each block in coding order."""
    before, out = 0, []
    for at in order:
        block = blocks[at].tolist()
        step, before = block[0] - before, block[0]
        n = abs(step).bit_length()
        unit = [(0, n, step if step >= 0 else step + (1 << n) - 1, n)]
        last = max((i for i in range(1, 64) if block[i]), default=0)
        run = 0
        for v in block[1 : last + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                unit.append((1, 0xF0, 0, 0))
                run -= 16
            n = abs(v).bit_length()
            unit.append((1, run << 4 | n, v if v > 0 else v + (1 << n) - 1, n))
            run = 0
        if last < 63:
            unit.append((1, 0, 0, 0))
        out.append(unit)
    return out


def _entropy(units, count: int, bands: tuple[int, ...] = (0, 1)) -> tuple[list[bytes], bytes]:
    """Huffman tables and scan data; units: (blocks, coding order, blocks a unit, table class) of each component.

    bands: 0 for DC values, 1 for AC values, which a progressive scan has apart.
    """
    events = [[[e for e in one if e[0] in bands] for one in _events(blocks, order)] for blocks, order, _, _ in units]
    counts: dict[int, dict[int, int]] = {}
    for own, (_, _, _, kind_of) in zip(events, units):
        for one in own:
            for kind, symbol, _, _ in one:
                table = counts.setdefault(2 * kind_of + kind, {})
                table[symbol] = table.get(symbol, 0) + 1
    coded, head = {}, []
    for i in sorted({2 * u[3] + kind for u in units for kind in bands}):
        sizes, symbols = _code_lengths(counts.get(i) or {0: 1})
        code, codes, at = 0, {}, 0
        for n in range(1, 17):
            for _ in range(sizes[n - 1]):
                codes[symbols[at]] = (code, n)
                code, at = code + 1, at + 1
            code <<= 1
        coded[i] = codes
        head.append(bytes([(i % 2) << 4 | i // 2, *sizes, *symbols]))
    acc, n, out = 0, 0, bytearray()
    for m in range(count):
        for own, (_, _, per, kind_of) in zip(events, units):
            for one in own[m * per : (m + 1) * per]:
                for kind, symbol, extra, size in one:
                    code, bits = coded[2 * kind_of + kind][symbol]
                    acc, n = (acc << bits | code) << size | extra, n + bits + size
                    while n >= 8:
                        byte = acc >> (n - 8) & 255
                        out += b"\xff\0" if byte == 255 else bytes([byte])
                        n -= 8
                    acc &= (1 << n) - 1
    if n:
        byte = (acc << (8 - n) | (1 << (8 - n)) - 1) & 255
        out += b"\xff\0" if byte == 255 else bytes([byte])
    return head, bytes(out)


def encode(image: np.ndarray, quality: int = 90) -> bytes:
    """Baseline with optimal codes; chroma is halved both ways up to quality 90. Alpha is dropped."""
    height, width = image.shape[:2]
    if not 1 <= quality <= 100 or max(width, height) > 65535:
        raise ValueError(f"quality {quality} or size {width}x{height}")
    r, g, b = (image[..., i].astype(float) for i in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b, -0.168735892 * r - 0.331264108 * g + 0.5 * b + 128, 0.5 * r - 0.418687589 * g - 0.081312411 * b + 128]
    half = quality <= 90
    unit = 16 if half else 8
    pad = ((0, -height % unit), (0, -width % unit))
    planes = [np.pad(p, pad, mode="edge") for p in planes]
    if half:
        planes[1:] = [p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3)) for p in planes[1:]]
    tables = [_quality(LUMA, quality), _quality(CHROMA, quality), _quality(CHROMA, quality)]
    blocks = [_forward(p, t) for p, t in zip(planes, tables)]
    down, across = planes[0].shape[0] // unit, planes[0].shape[1] // unit
    k = unit // 8
    place = np.arange(len(blocks[0])).reshape(down, k, across, k).swapaxes(1, 2).reshape(-1)
    units = [(blocks[0], place, k * k, 0)] + [(x, np.arange(len(x)), 1, 1) for x in blocks[1:]]
    head, out = _entropy(units, down * across)

    def segment(marker, body):
        return struct.pack(">BBH", 255, marker, len(body) + 2) + body

    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22 if half else 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])
    parts = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    parts += [segment(0xDB, bytes([i]) + tables[i][ZIGZAG].astype(np.uint8).tobytes()) for i in (0, 1)]
    parts += [segment(0xC0, frame), *(segment(0xC4, h) for h in head), segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0]))]
    return b"".join([*parts, out, b"\xff\xd9"])


def _progressive_scans(d: _Decoder) -> list[tuple[int, bytes, bytes]]:
    """(marker, body, data) segments: all DC values without their last bit, those bits, then each component's AC band."""
    out, everyone = [], []
    for c in d.parts:
        at = np.arange(c.rows * c.columns).reshape(c.rows, c.columns)
        own = at[: -(-c.height // 8), : -(-c.width // 8)].reshape(-1)
        whole = own if len(d.parts) == 1 else at.reshape(d.down, c.v, d.across, c.h).swapaxes(1, 2).reshape(-1)
        everyone.append((c, own, whole, 1 if len(d.parts) == 1 else c.v * c.h))
    count = len(everyone[0][2]) // everyone[0][3]
    coarse = []
    for i, (c, _, whole, per) in enumerate(everyone):
        dc = np.zeros((len(c.blocks), 64), np.int64)
        dc[:, 0] = c.blocks[:, 0] >> 1
        coarse.append((dc, whole, per, min(i, 1)))
    head, data = _entropy(coarse, count, bands=(0,))
    out += [(0xC4, h, b"") for h in head]
    names = bytes([len(d.parts)]) + b"".join(bytes([c.name, 0x10 if i else 0]) for i, (c, *_) in enumerate(everyone))
    out.append((0xDA, names + bytes([0, 0, 1]), data))
    bits = [int(c.blocks[whole[m * per + j], 0]) & 1 for m in range(count) for c, _, whole, per in everyone for j in range(per)]
    packed = np.packbits(np.array(bits + [1] * (-len(bits) % 8), np.uint8)).tobytes().replace(b"\xff", b"\xff\0")
    out.append((0xDA, names + bytes([0, 0, 0x10]), packed))
    for i, (c, own, _, _) in enumerate(everyone):
        head, data = _entropy([(c.blocks[:, ZIGZAG], own, 1, min(i, 1))], len(own), bands=(1,))
        out += [(0xC4, h, b"") for h in head]
        out.append((0xDA, bytes([1, c.name, 0x01 if i else 0, 1, 63, 0]), data))
    return out


def repack(data: bytes, progressive: bool = False) -> bytes:
    """The same pixels and other segments with optimal codes, in one scan or progressively; the file itself when that is not smaller."""
    try:
        d = _Decoder(data)
        kept, tables = [], 0
        for marker, body, _ in _segments(data):
            if marker == 0xDB:
                tables += 1
            if marker not in (0xC0, 0xC1, 0xC2, 0xC4, 0xDA, 0xDD):
                kept.append(struct.pack(">BBH", 255, marker, len(body) + 2) + body)
        if tables > len(d.quant):  # a table given twice may differ between scans
            return data
        units, count = [], d.across * d.down
        for i, c in enumerate(d.parts):
            at = np.arange(c.rows * c.columns).reshape(c.rows, c.columns)
            if len(d.parts) == 1:
                at, per = at[: -(-c.height // 8), : -(-c.width // 8)], 1
                count = at.size
            else:
                at, per = at.reshape(d.down, c.v, d.across, c.h).swapaxes(1, 2), c.v * c.h
            units.append((c.blocks[:, ZIGZAG], at.reshape(-1), per, min(i, 1)))
        if progressive:
            scans = _progressive_scans(d)
        else:
            head, out = _entropy(units, count)
            names = b"".join(bytes([c.name, 0x11 if i else 0]) for i, c in enumerate(d.parts))
            scans = [*((0xC4, h, b"") for h in head), (0xDA, bytes([len(d.parts)]) + names + bytes([0, 63, 0]), out)]
    except (Malformed, KeyError, struct.error, IndexError):
        return data
    n = len(d.parts)
    frame = struct.pack(">BHHB", 8, d.size[1], d.size[0], n) + b"".join(bytes([c.name, c.h << 4 | c.v, c.table]) for c in d.parts)
    parts = [b"\xff\xd8", *kept]
    for marker, body, scan in [(0xC2 if progressive else 0xC0, frame, b""), *scans]:
        parts.append(struct.pack(">BBH", 255, marker, len(body) + 2) + body + scan)
    made = b"".join([*parts, b"\xff\xd9"])
    return made if len(made) < len(data) else data
