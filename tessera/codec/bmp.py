"""BMP: 1 to 32 bits, bit fields, run lengths, both row orders; 24- and 32-bit encoding."""

from __future__ import annotations

import struct

import numpy as np

from tessera.codec import Malformed, Unsupported, check_budget


def header(data: bytes) -> dict:
    if data[:2] != b"BM" or len(data) < 26:
        raise Malformed("BMP: no header")
    offset, size = struct.unpack_from("<II", data, 10)
    if size == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", data, 18)
        kind, colours = 0, 0
    elif size in (40, 52, 56, 64, 108, 124) and len(data) >= 14 + min(size, 40):
        width, height, _, bits, kind = struct.unpack_from("<iiHHI", data, 18)
        colours = struct.unpack_from("<I", data, 46)[0]
    else:
        raise Malformed(f"BMP: header of {size} bytes")
    return {"offset": offset, "size": size, "width": width, "height": abs(height), "top_down": height < 0, "bits": bits, "kind": kind, "colours": colours}


def _scaled(values: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros(values.shape, np.int64)
    shift = (mask & -mask).bit_length() - 1
    full = mask >> shift
    return (((values.astype(np.int64) & mask) >> shift) * 255 + full // 2) // full


def decode(data: bytes) -> np.ndarray:
    h = header(data)
    width, height, bits, kind = h["width"], h["height"], h["bits"], h["kind"]
    if kind in (4, 5):
        raise Unsupported("BMP: embedded JPEG or PNG")
    if kind not in (0, 1, 2, 3, 6) or bits not in (1, 2, 4, 8, 16, 24, 32):
        raise Malformed("BMP: compression or depth")
    check_budget(width, height, len(data), bits)
    masks = (0x7C00, 0x3E0, 0x1F, 0) if bits == 16 else (0xFF0000, 0xFF00, 0xFF, 0)
    at = 14 + h["size"]
    if kind in (3, 6):
        n = 4 if kind == 6 or h["size"] >= 56 else 3
        if len(data) < 54 + 4 * n:
            raise Malformed("BMP: masks are cut off")
        masks = struct.unpack_from(f"<{n}I", data, 54) + (0,) * (4 - n)
        if h["size"] == 40:
            at += 4 * n
    if bits <= 8:
        entry = 3 if h["size"] == 12 else 4
        n = min(h["colours"] or 1 << bits, 1 << bits)
        table = np.frombuffer(data[at : at + n * entry], np.uint8)
        table = table[: len(table) // entry * entry].reshape(-1, entry)[:, 2::-1]
        palette = np.zeros((256, 3), np.uint8)
        palette[: len(table)] = table
    if kind in (1, 2):
        index = _runs(data[h["offset"] :], width, height, 4 if kind == 2 else 8)
        rgb, alpha = palette[index], np.full((height, width), 255)
    else:
        stride = (width * bits + 31) // 32 * 4
        raw = data[h["offset"] : h["offset"] + stride * height]
        if len(raw) < stride * height:
            raise Malformed("BMP: too little pixel data")
        rows, alpha = np.frombuffer(raw, np.uint8).reshape(height, stride), np.full((height, width), 255)
        if bits <= 8:
            shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
            index = ((rows[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(height, -1)[:, :width]
            rgb = palette[index]
        elif bits == 24:
            rgb = rows[:, : width * 3].reshape(height, width, 3)[..., ::-1]
        else:
            values = np.ascontiguousarray(rows[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4")
            rgb = np.stack([_scaled(values, m) for m in masks[:3]], -1)
            mask = masks[3] or (0xFF000000 if bits == 32 and kind == 0 else 0)
            if mask:
                found = _scaled(values, mask)
                if found.any():  # an alpha channel of zeros only means none
                    alpha = found
    out = np.concatenate([rgb, alpha[..., None]], -1).astype(np.uint8)
    return out if h["top_down"] else out[::-1].copy()


def _runs(raw: bytes, width: int, height: int, bits: int) -> np.ndarray:
    """Indices of run-length data, first row first as stored."""
    out, x, y, at = np.zeros((height, width), np.uint8), 0, 0, 0

    def nibbles(values, n):
        return [v >> 4 if i % 2 == 0 else v & 15 for i, v in ((i, values[i // 2]) for i in range(n))] if bits == 4 else values[:n]

    while at + 1 < len(raw) and y < height:
        n, v = raw[at], raw[at + 1]
        at += 2
        if n:
            run = nibbles([v] * ((n + 1) // 2), n) if bits == 4 else [v] * n
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            break
        elif v == 2:
            if at + 1 >= len(raw):
                break
            x, y, at = x + raw[at], y + raw[at + 1], at + 2
            continue
        else:
            size = (v + 1) // 2 if bits == 4 else v
            if at + size > len(raw):
                raise Malformed("BMP: run data is cut off")
            run = nibbles(raw[at : at + size], v)
            at += size + size % 2
        part = list(run)[: max(0, width - x)]
        out[y, x : x + len(part)] = part
        x += len(run)
    return out


def encode(image: np.ndarray) -> bytes:
    """24 bits, or 32 bits with masks when a pixel is not opaque; rows from the bottom."""
    height, width = image.shape[:2]
    alpha = bool((image[..., 3] < 255).any())
    if alpha:
        rows = np.ascontiguousarray(image[::-1][..., [2, 1, 0, 3]]).reshape(height, -1)
        info = struct.pack("<IiiHHIIiiII", 108, width, height, 1, 32, 3, rows.size, 2835, 2835, 0, 0)
        info += struct.pack("<5I", 0xFF0000, 0xFF00, 0xFF, 0xFF000000, 0x73524742) + bytes(48)
    else:
        rows = np.ascontiguousarray(image[::-1][..., [2, 1, 0]]).reshape(height, -1)
        rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
        info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    offset = 14 + len(info)
    return struct.pack("<2sIII", b"BM", offset + rows.size, 0, offset) + info + rows.tobytes()
