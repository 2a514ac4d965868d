"""Lossless JPEG (predicted samples with Huffman-coded differences) of 2 to 16 bits, read and written.

Differences are read one by one; predictions from the left, from above and from
both with the corner are prefix sums over whole rows, the other ones go sign by
sign.
"""

from __future__ import annotations

import struct

import numpy as np

from tessera.codec import Malformed, Unsupported, check_budget, jpeg


class _Part:
    def __init__(self, name: int, h: int, v: int):
        self.name, self.h, self.v, self.samples = name, h, v, None


def _predicted(diffs: np.ndarray, predictor: int, initial: int, starts: set[int]) -> np.ndarray:
    """Samples, modulo 65,536; rows in `starts` are predicted from the left alone, the first sign from the middle."""
    out = np.zeros_like(diffs)
    for y, row in enumerate(diffs):
        if y in starts:
            out[y] = (np.cumsum(row) + initial) & 0xFFFF
            continue
        above = out[y - 1]
        first = int(above[0] + row[0]) & 0xFFFF
        if predictor == 1:
            out[y] = (np.cumsum(np.concatenate([[first], row[1:]]))) & 0xFFFF
        elif predictor in (2, 3):
            out[y, 0] = first
            out[y, 1:] = (row[1:] + (above[1:] if predictor == 2 else above[:-1])) & 0xFFFF
        elif predictor == 4:
            steps = row[1:] + above[1:] - above[:-1]
            out[y] = np.cumsum(np.concatenate([[first], steps])) & 0xFFFF
        else:
            line, up, left = [first], above.tolist(), first
            for x, d in enumerate(row.tolist()[1:], 1):
                b, c = up[x], up[x - 1]
                guess = left + ((b - c) >> 1) if predictor == 5 else b + ((left - c) >> 1) if predictor == 6 else (left + b) >> 1
                left = (guess + d) & 0xFFFF
                line.append(left)
            out[y] = line
    return out


def planes(data: bytes) -> tuple[list[np.ndarray], int, int, list[_Part]]:
    """Samples of each component at full size, their precision, the Adobe transform (-1: none) and the components."""
    tables, parts, restart, adobe, frame = {}, [], 0, -1, None
    for marker, body, intervals in jpeg._segments(data):
        if marker == 0xC4:
            at = 0
            while at + 17 <= len(body):
                n = sum(body[at + 1 : at + 17])
                tables[body[at]] = jpeg._Huffman(body[at + 1 : at + 17], body[at + 17 : at + 17 + n])
                at += 17 + n
        elif marker == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker == 0xC3:
            if frame is not None or len(body) < 6:
                raise Malformed("JPEG: frame header")
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if not 2 <= depth <= 16 or n not in (1, 3, 4) or len(body) < 6 + 3 * n or not width or not height:
                raise Malformed("JPEG: frame header")
            check_budget(width, height, len(data))
            for i in range(n):
                name, hv, _ = body[6 + 3 * i : 9 + 3 * i]
                if not (1 <= hv >> 4 <= 4 and 1 <= hv & 15 <= 4):
                    raise Malformed("JPEG: sampling")
                parts.append(_Part(name, hv >> 4, hv & 15))
            frame = (width, height, depth, max(p.h for p in parts), max(p.v for p in parts))
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise Unsupported(f"JPEG: frame type {marker:#x}")
        elif marker == 0xDA:
            _scan(body, intervals, frame, parts, tables, restart)
    if frame is None or any(p.samples is None for p in parts):
        raise Malformed("JPEG: no image")
    width, height, depth, hmax, vmax = frame
    out = []
    for p in parts:
        if hmax % p.h or vmax % p.v:
            rows, columns = np.arange(height) * p.v // vmax, np.arange(width) * p.h // hmax
            out.append(p.samples[rows][:, columns])
        else:
            size = -(-height * p.v // vmax), -(-width * p.h // hmax)
            out.append(jpeg.upsample(p.samples[: size[0], : size[1]], hmax // p.h, vmax // p.v)[:height, :width])
    return out, depth, adobe, parts


def _scan(body, intervals, frame, parts, tables, restart) -> None:
    if frame is None or len(body) < 4 + 2 * body[0]:
        raise Malformed("JPEG: scan header")
    width, height, depth, hmax, vmax = frame
    chosen = []
    for i in range(body[0]):
        name, table = body[1 + 2 * i : 3 + 2 * i]
        part = next((p for p in parts if p.name == name), None)
        if part is None or table >> 4 not in tables:
            raise Malformed("JPEG: scan component")
        chosen.append((part, tables[table >> 4]))
    predictor, _, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
    shift = approx & 15
    if not 1 <= predictor <= 7 or shift >= depth:
        raise Malformed("JPEG: predictor")
    single = len(chosen) == 1
    across, down = -(-width // hmax), -(-height // vmax)
    if single:
        p = chosen[0][0]
        across, down = -(-width * p.h // hmax), -(-height * p.v // vmax)
    boxes = [(1, 1) if single else (p.h, p.v) for p, _ in chosen]
    read = [np.zeros((down * v, across * h), np.int64) for h, v in boxes]
    step, starts = restart or across * down, [{0} for _ in chosen]
    for k, begin in enumerate(range(0, across * down, step)):
        if k >= len(intervals):
            break  # what is missing has no differences
        if begin and begin % across == 0:
            for own, (_, v) in zip(starts, boxes):
                own.add(begin // across * v)
        bits = jpeg._Bits(intervals[k])
        for unit in range(begin, min(begin + step, across * down)):
            my, mx = divmod(unit, across)
            for (_, table), (h, v), diffs in zip(chosen, boxes, read):
                for y in range(my * v, my * v + v):
                    for x in range(mx * h, mx * h + h):
                        n = bits.symbol(table)
                        if n > 16:
                            raise Malformed("JPEG: difference category")
                        diffs[y, x] = 32768 if n == 16 else bits.signed(n)
    mask = (1 << depth) - 1
    for (p, _), diffs, own in zip(chosen, read, starts):
        p.samples = (_predicted(diffs, predictor, 1 << (depth - shift - 1), own) << shift) & mask


def decode(data: bytes) -> np.ndarray:
    """r, g, b, a of 8 bits, with the colour rules of the other JPEG frames."""
    got, depth, adobe, parts = planes(data)
    full = (1 << depth) - 1
    if depth > 8:
        eight = [g >> (depth - 8) for g in got]
    else:
        eight = [g * 255 // full for g in got]
    plain = adobe == 0 or (adobe < 0 and bytes(p.name for p in parts) == b"RGB")
    if len(eight) == 4 or (depth > 8 and len(eight) == 3 and not plain):
        raise Unsupported("JPEG: lossless ink, or YCbCr of more than 8 bits")
    rgb = eight * 3 if len(eight) == 1 else eight if plain else jpeg._rgb(*eight)
    return np.stack([*rgb, np.full(rgb[0].shape, 255)], -1).astype(np.uint8)


def encode(samples: np.ndarray, depth: int = 8, predictor: int = 1, restart_rows: int = 0) -> bytes:
    """Samples (height, width, 1 or 3) as one scan with optimal codes; three components are red, green and blue."""
    height, width, n = samples.shape
    if n not in (1, 3) or not 2 <= depth <= 16 or not 1 <= predictor <= 7 or max(height, width) > 65535:
        raise ValueError("1 or 3 components of 2 to 16 bits, predictors 1 to 7, sides up to 65,535")
    s = samples.astype(np.int64)
    left, above, corner = np.roll(s, 1, 1), np.roll(s, 1, 0), np.roll(np.roll(s, 1, 0), 1, 1)
    guess = [left, above, corner, left + above - corner, left + ((above - corner) >> 1), above + ((left - corner) >> 1), (left + above) >> 1][predictor - 1]
    guess[:, 0] = above[:, 0]
    first = slice(None, None, restart_rows) if restart_rows else slice(0, 1)
    guess[first, 1:] = s[first, :-1]
    guess[first, 0] = 1 << (depth - 1)
    diffs = (s - guess + 32767) % 65536 - 32767  # -32767 to 32768
    magnitude = np.abs(diffs)
    size = np.zeros_like(magnitude)
    for k in range(17):
        size[magnitude >= 1 << k] = k + 1
    found, counts = np.unique(size, return_counts=True)
    lengths, symbols = jpeg._code_lengths(dict(zip(found.tolist(), counts.tolist())))
    codes, code, at = {}, 0, 0
    for k in range(1, 17):
        for _ in range(lengths[k - 1]):
            codes[symbols[at]] = f"{code:0{k}b}"
            code, at = code + 1, at + 1
        code <<= 1

    def interval(rows):
        bits = []
        for d, k in zip(diffs[rows].reshape(-1).tolist(), size[rows].reshape(-1).tolist()):
            bits.append(codes[k])
            if 0 < k < 16:
                bits.append(f"{d if d > 0 else d + (1 << k) - 1:0{k}b}")
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        return np.packbits(np.frombuffer(text.encode(), np.uint8) & 1).tobytes().replace(b"\xff", b"\xff\0")

    step = restart_rows or height
    scan = b""
    for k, y in enumerate(range(0, height, step)):
        scan += (bytes([255, 0xD0 + (k - 1) % 8]) if k else b"") + interval(slice(y, y + step))
    names = b"RGB" if n == 3 else b"\1"
    part = lambda marker, body: struct.pack(">BBH", 255, marker, len(body) + 2) + body
    out = b"\xff\xd8" + part(0xC3, struct.pack(">BHHB", depth, height, width, n) + b"".join(bytes([c, 17, 0]) for c in names))
    out += part(0xC4, bytes([0, *lengths, *symbols]))
    out += part(0xDD, struct.pack(">H", restart_rows * width)) if restart_rows else b""
    return out + part(0xDA, bytes([n]) + b"".join(bytes([c, 0]) for c in names) + bytes([predictor, 0, 0])) + scan + b"\xff\xd9"
