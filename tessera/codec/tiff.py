"""TIFF: strips and tiles, PackBits, LZW, Deflate, differencing, page chains; 8- and 16-bit Deflate encoding."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tessera.codec import Malformed, Refused, Unsupported, check_budget, fax

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
#: Fax compressions: one-dimensional rows at byte bounds, T.4, T.6.
FAX = (2, 3, 4)
#: Most bytes that one image may inflate to.
MAX_BYTES = 1 << 30


def _order(data: bytes) -> str:
    if data[:4] == b"II*\0":
        return "<"
    if data[:4] == b"MM\0*":
        return ">"
    raise Malformed("TIFF: no header")


def directory(data: bytes, at: int) -> tuple[dict[int, list], int]:
    """Tags with their values (byte strings for unsigned and opaque bytes) and the next offset."""
    e = _order(data)
    if at + 2 > len(data):
        raise Malformed("TIFF: directory offset")
    n = struct.unpack_from(e + "H", data, at)[0]
    if not n or at + 6 + 12 * n > len(data):
        raise Malformed("TIFF: directory is cut off")
    tags = {}
    for i in range(n):
        tag, kind, count, value = struct.unpack_from(e + "HHII", data, at + 2 + 12 * i)
        size = _SIZES.get(kind, 0) * count
        place = at + 10 + 12 * i if size <= 4 else value
        if not size or place + size > len(data):
            continue
        if kind in _LETTERS:
            tags[tag] = list(struct.unpack_from(f"{e}{count}{_LETTERS[kind]}", data, place))
        else:
            tags[tag] = [data[place : place + size]]
    return tags, struct.unpack_from(e + "I", data, at + 2 + 12 * n)[0]


def pages(data: bytes, limit: int = 1 << 16) -> list[dict[int, list]]:
    """Directories of the chain; damage or a loop ends it after the first page."""
    at, seen, out = struct.unpack_from(_order(data) + "I", data, 4)[0] if len(data) >= 8 else 0, set(), []
    while at and at not in seen and len(out) < limit:
        seen.add(at)
        try:
            tags, at = directory(data, at)
        except Malformed:
            if not out:
                raise
            break
        out.append(tags)
    if not out:
        raise Malformed("TIFF: no page")
    return out


def packbits(raw: bytes, most: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw) and len(out) < most:
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:most])


def lzw(raw: bytes, most: int) -> bytes:
    """MSB-first LZW whose code size grows one code early."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, size, before, out = list(first), 9, None, bytearray()
    acc = bits = 0
    for byte in raw:
        acc = (acc << 8 | byte) & 0xFFFFFF
        bits += 8
        while bits >= size:
            bits -= size
            code = (acc >> bits) & ((1 << size) - 1)
            if code == 256:
                table, size, before = list(first), 9, None
                continue
            if code == 257 or len(out) >= most:
                return bytes(out[:most])
            if before is None:
                if code > 255:
                    raise Malformed("TIFF: first LZW code")
                entry = table[code]
            elif code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = before + before[:1]
            else:
                raise Malformed("TIFF: LZW code out of order")
            if before is not None and len(table) < 4096:
                table.append(before + entry[:1])
            size = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
            out += entry
            before = entry
    return bytes(out[:most])


def _unpacked(raw: bytes, method: int, most: int) -> bytes:
    if method == 1:
        out = raw[:most]
    elif method == 5:
        out = lzw(raw, most)
    elif method in (8, 32946):
        try:
            out = zlib.decompressobj(-15).decompress(raw[2:], most)
        except zlib.error as e:
            raise Malformed(f"TIFF: {e}") from None
    elif method == 32773:
        out = packbits(raw, most)
    else:
        raise Unsupported(f"TIFF: compression {method}")
    if len(out) < most:
        raise Malformed("TIFF: too little image data")
    return out


def _fax_lines(raw: bytes, f: dict, columns: int, rows: int) -> bytes:
    """Packed rows of a fax block; a set bit is black."""
    k = {2: 0, 3: f["fax"] & 1, 4: -1}[f["method"]]
    got = fax.decode(raw, k, columns, rows, byte_align=f["method"] == 2)
    if len(got) < rows:
        raise Malformed("TIFF: too little image data")
    return np.packbits(got, axis=1).tobytes()


def facts(data: bytes, tags: dict[int, list]) -> dict:
    """What a page's directory declares, checked; the same refusals as decoding."""

    def one(tag, default=None):
        got = tags.get(tag)
        return got[0] if got and isinstance(got[0], int) else default

    width, height = one(256), one(257)
    if not width or not height:
        raise Malformed("TIFF: size")
    samples = one(277, 1)
    bits = tags.get(258, [1] * samples)
    photometric = one(262)
    if photometric is None or not all(isinstance(b, int) for b in bits):
        raise Malformed("TIFF: fields")
    extra = tags.get(338, [])
    check_budget(width, height, len(data), min(bits) * samples)
    if width * height * samples * max(1, max(bits) // 8) > MAX_BYTES:
        raise Refused("TIFF: image buffer beyond 1 GiB")
    reason = None
    if len(set(bits)) != 1 or bits[0] not in (1, 2, 4, 8, 16):
        reason = f"TIFF: bits {bits}"
    elif photometric not in (0, 1, 2, 3):
        reason = f"TIFF: photometric {photometric}"
    elif one(259, 1) in FAX and (bits != [1] or photometric not in (0, 1)):
        reason = f"TIFF: fax of bits {bits}"
    elif one(259, 1) not in (1, 5, 8, 32946, 32773, *FAX):
        reason = f"TIFF: compression {one(259)}"
    elif one(317, 1) not in (1, 2) or (one(317, 1) == 2 and bits[0] < 8):
        reason = f"TIFF: predictor {one(317)}"
    elif one(339, 1) not in (1, 4) or one(266, 1) not in (1, 2):
        reason = "TIFF: sample format or fill order"
    return {
        "width": width, "height": height, "bits": bits[0], "samples": samples, "photometric": photometric, "planar": one(284, 1),
        "method": one(259, 1), "predictor": one(317, 1), "extra": extra, "reason": reason, "fill": one(266, 1), "orientation": one(274, 1), "fax": one(292, 0),
        "tile": (one(322), one(323)) if one(322) else None, "rows": min(one(278, height) or height, height),
        "offsets": tags.get(324) or tags.get(273) or [], "counts": tags.get(325) or tags.get(279) or [],
    }


def samples16(data: bytes, page: int = 0) -> tuple[np.ndarray, dict]:
    """Raw samples (height, width, samples) of a page, and its facts."""
    chain = pages(data)
    if not 0 <= page < len(chain):
        raise ValueError(f"page {page} of {len(chain)}")
    f = facts(data, chain[page])
    if f["reason"]:
        raise Unsupported(f["reason"])
    e, width, height, bits = _order(data), f["width"], f["height"], f["bits"]
    planes = f["samples"] if f["planar"] == 2 else 1
    per = f["samples"] // planes
    bw, bh = f["tile"] or (width, f["rows"])
    if not bw or not bh:
        raise Malformed("TIFF: block size")
    across, down = -(-width // bw), -(-height // bh)
    if len(f["offsets"]) < across * down * planes or len(f["counts"]) < across * down * planes:
        raise Malformed("TIFF: block offsets")
    out = np.zeros((down * bh, across * bw, f["samples"]), np.uint16)
    for i in range(across * down * planes):
        plane, at = divmod(i, across * down)
        y, x = divmod(at, across)
        rows = bh if f["tile"] else min(bh, height - y * bh)
        stride = (bw * per * bits + 7) // 8
        raw = data[f["offsets"][i] : f["offsets"][i] + f["counts"][i]]
        if f["fill"] == 2:
            raw = raw.translate(bytes(int(f"{b:08b}"[::-1], 2) for b in range(256)))
        lines = _fax_lines(raw, f, bw, rows) if f["method"] in FAX else _unpacked(raw, f["method"], stride * rows)
        lines = np.frombuffer(lines, np.uint8).reshape(rows, stride)
        if bits == 16:
            block = lines.reshape(rows, -1).view(e + "u2").reshape(rows, bw, per).astype(np.uint16)
        elif bits == 8:
            block = lines.reshape(rows, bw, per).astype(np.uint16)
        else:
            shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
            block = ((lines[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(rows, -1)[:, : bw * per].reshape(rows, bw, per).astype(np.uint16)
        if f["predictor"] == 2:
            block = np.cumsum(block, 1, dtype=np.uint16) & ((1 << bits) - 1)
        out[y * bh : y * bh + rows, x * bw : x * bw + bw, plane * per : plane * per + per] = block
    return out[:height, :width], {**f, "palette": chain[page].get(320)}


def decode(data: bytes, page: int = 0) -> np.ndarray:
    raw, f = samples16(data, page)
    full, kind = (1 << f["bits"]) - 1, f["photometric"]
    eight = (raw >> 8 if f["bits"] == 16 else raw * (255 // full)).astype(np.int64)
    base = 3 if kind == 2 else 1
    if raw.shape[2] < base:
        raise Malformed("TIFF: too few samples")
    if kind == 3:
        if not f["palette"] or len(f["palette"]) < 3 << f["bits"]:
            raise Malformed("TIFF: palette")
        table = (np.array(f["palette"][: 3 << f["bits"]]) >> 8).reshape(3, -1).T
        rgb = table[raw[..., 0]]
    elif kind == 2:
        rgb = eight[..., :3]
    else:
        gray = 255 - eight[..., :1] if kind == 0 else eight[..., :1]
        rgb = gray.repeat(3, -1)
    alpha = np.full(raw.shape[:2], 255, np.int64)
    if raw.shape[2] > base and f["extra"] and f["extra"][0] in (1, 2):
        alpha = eight[..., base]
        if f["extra"][0] == 1:  # colours were multiplied by alpha
            safe = np.maximum(alpha, 1)[..., None]
            rgb = np.where(alpha[..., None] > 0, np.minimum(255, (rgb * 255 + safe // 2) // safe), 0)
    return np.concatenate([rgb, alpha[..., None]], -1).astype(np.uint8)


def _directory(out: bytearray, link: int, entries: list, order: str) -> int:
    """Writes a directory at the end and its place at `link`; gives the place of the next one's link."""
    body = bytearray(struct.pack(order + "H", len(entries)))
    at = len(out)
    spare = at + 2 + 12 * len(entries) + 4
    tail = bytearray()
    for tag, kind, values in entries:
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        body += struct.pack(order + "HHI", tag, kind, len(values))
        if len(raw) <= 4:
            body += raw.ljust(4, b"\0")
        else:
            body += struct.pack(order + "I", spare + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
    struct.pack_into(order + "I", out, link, at)
    out += body + struct.pack(order + "I", 0) + tail
    return at + len(body)


def encode(images: list[np.ndarray], order: str = "<") -> bytes:
    """Pages of gray or colour, with alpha when a pixel is not opaque; uint8 or uint16 samples, Deflate, differenced."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0))
    link = 4
    for page, image in enumerate(images):
        deep = image.dtype == np.uint16
        full = 65535 if deep else 255
        gray = bool((image[..., 0] == image[..., 1]).all() and (image[..., 1] == image[..., 2]).all())
        alpha = bool((image[..., 3] < full).any())
        planes = ([0] if gray else [0, 1, 2]) + ([3] if alpha else [])
        samples = image[..., planes]
        height, width, n = samples.shape
        moved = samples.copy()
        moved[:, 1:] -= samples[:, :-1]
        rows = max(1, 8192 // (width * n * (2 if deep else 1)))
        strips = [zlib.compress(np.ascontiguousarray(moved[y : y + rows]).astype(order + ("u2" if deep else "u1")).tobytes()) for y in range(0, height, rows)]
        offsets = []
        for s in strips:
            offsets.append(len(out))
            out += s + b"\0" * (len(s) % 2)
        entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [16 if deep else 8] * n), (259, 3, [8]), (262, 3, [1 if gray else 2]),
                   (273, 4, offsets), (277, 3, [n]), (278, 4, [rows]), (279, 4, [len(s) for s in strips]), (284, 3, [1])]
        if len(images) > 1:
            entries.append((297, 3, [page, len(images)]))
        entries.append((317, 3, [2]))
        if alpha:
            entries.append((338, 3, [2]))
        link = _directory(out, link, entries, order)
    return bytes(out)


def encode_bilevel(image: np.ndarray, method: int = 4) -> bytes:
    """A page of black and white, by luma below and from 128 on, as fax codes: one-dimensional (2) or two-dimensional (4)."""
    black = ((image[..., :3].astype(np.int64) @ np.array([77, 150, 29])) >> 8 < 128).astype(np.uint8)
    raw = fax.encode(black, 0 if method == 2 else -1)
    out = bytearray(b"II*\0" + bytes(4)) + raw + b"\0" * (len(raw) % 2)
    height, width = black.shape
    entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [1]), (259, 3, [method]), (262, 3, [0]), (273, 4, [8]), (277, 3, [1]),
               (278, 4, [height]), (279, 4, [len(raw)])]
    _directory(out, 4, entries, "<")
    return bytes(out)
