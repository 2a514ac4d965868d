"""PNG and APNG: all colour types and depths, filters, Adam7, animation."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tessera.codec import Malformed, Unsupported, check_budget

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Adam7 passes: first column, first row, column step, row step (fixed values).
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def chunks(data: bytes):
    """(type, body) in order; checksums of critical chunks and frame data are verified."""
    if data[:8] != SIGNATURE:
        raise Malformed("PNG: no signature")
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            raise Malformed(f"PNG: chunk {kind!r} is cut off")
        if kind in (b"IHDR", b"PLTE", b"IDAT", b"IEND", b"fdAT", b"fcTL", b"acTL"):
            if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
                raise Malformed(f"PNG: checksum of {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise Malformed("PNG: no IEND")


def inflate(parts: list[bytes], size: int) -> bytes:
    """Exactly `size` bytes of a zlib stream; its checksum and what follows are not looked at."""
    raw = b"".join(parts)
    try:
        out = zlib.decompressobj(-15).decompress(raw[2:], size + 1)
    except zlib.error as e:
        raise Malformed(f"PNG: {e}") from None
    if len(out) < size:
        raise Malformed("PNG: too little image data")
    return out[:size]


def unfilter(raw: bytes, rows: int, stride: int, bpp: int) -> np.ndarray:
    lines = np.frombuffer(raw, np.uint8).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride), np.uint8)
    pad = -stride % bpp
    for y in range(rows):
        kind, line, up = int(lines[y, 0]), lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            wide = np.pad(line, (0, pad)).reshape(-1, bpp)
            out[y + 1] = np.cumsum(wide, 0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            out[y + 1] = line + up
        elif kind in (3, 4):
            row, x, above = [0] * bpp + [0] * stride, line.tolist(), [0] * bpp + up.tolist()
            for i in range(stride):
                a, b = row[i], above[i + bpp]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = above[i]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[i + bpp] = (x[i] + guess) & 255
            out[y + 1] = row[bpp:]
        else:
            raise Malformed(f"PNG: filter {kind}")
    return out[1:]


def _samples(lines: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    rows = len(lines)
    if depth == 16:
        return lines.reshape(rows, width, channels, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth < 8:
        per = 8 // depth
        shifts = np.arange(8 - depth, -1, -depth, dtype=np.uint8)
        lines = ((lines[:, :, None] >> shifts) & ((1 << depth) - 1)).reshape(rows, -1)[:, : width * channels]
        assert per
    return lines.reshape(rows, width, channels).astype(np.uint16)


def _plane(raw_parts, width, height, head) -> np.ndarray:
    """Samples (height, width, channels) of one image's data."""
    _, _, depth, colour, interlace = head
    channels = _CHANNELS[colour]
    bpp = max(1, channels * depth // 8)
    boxes = _PASSES if interlace else [(0, 0, 1, 1)]
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in boxes]
    sizes = [(max(w, 0), max(h, 0)) for w, h in sizes]
    strides = [(w * channels * depth + 7) // 8 for w, _ in sizes]
    raw = inflate(raw_parts, sum(h * (s + 1) for (w, h), s in zip(sizes, strides) if w and h))
    out, at = np.zeros((height, width, channels), np.uint16), 0
    for (x, y, dx, dy), (w, h), stride in zip(boxes, sizes, strides):
        if w and h:
            lines = unfilter(raw[at : at + h * (stride + 1)], h, stride, bpp)
            out[y::dy, x::dx] = _samples(lines, w, channels, depth)
            at += h * (stride + 1)
    return out


def _rgba16(plane: np.ndarray, head, palette, trns) -> np.ndarray:
    """Samples as 16-bit r, g, b, a."""
    depth, colour = head[2], head[3]
    full = (1 << depth) - 1
    if colour == 3:
        if palette is None:
            raise Malformed("PNG: no palette")
        at = plane[..., 0].astype(int)
        if at.max(initial=0) >= len(palette):
            raise Malformed("PNG: index beyond the palette")
        alpha = np.full(len(palette), 255, np.uint16)
        if trns:
            own = np.frombuffer(trns, np.uint8)[: len(palette)]
            alpha[: len(own)] = own
        return np.concatenate([palette[at], alpha[at][..., None]], -1).astype(np.uint16) * 257
    wide = (plane.astype(np.uint32) * (65535 // full)).astype(np.uint16)
    opaque = np.full(plane.shape[:2] + (1,), 65535, np.uint16)
    colour_part = wide[..., :1].repeat(3, -1) if colour in (0, 4) else wide[..., :3]
    alpha = wide[..., -1:] if colour in (4, 6) else opaque
    if trns and colour in (0, 2):
        key = np.frombuffer(trns[: 2 * _CHANNELS[colour]], ">u2")
        if len(key) == _CHANNELS[colour]:
            alpha = np.where((plane == key).all(-1, keepdims=True), 0, alpha).astype(np.uint16)
    return np.concatenate([colour_part, alpha], -1)


def _parse(data: bytes, max_frames: int | None = None):
    head, palette, trns, plays, declared = None, None, None, 1, 0
    default, images, current = [], [], None
    for kind, body in chunks(data):
        if head is None and kind not in (b"IHDR", b"CgBI"):
            raise Malformed("PNG: IHDR is not first")
        if kind == b"CgBI":
            raise Unsupported("PNG: Apple variant")
        if kind == b"IHDR":
            if len(body) != 13:
                raise Malformed("PNG: IHDR length")
            width, height, depth, colour, method, filters, interlace = struct.unpack(">IIBBBBB", body)
            if depth not in _DEPTHS.get(colour, ()) or method or filters or interlace > 1:
                raise Malformed("PNG: header fields")
            check_budget(width, height, len(data), depth * _CHANNELS[colour])
            head = (width, height, depth, colour, interlace)
        elif kind == b"PLTE":
            if len(body) % 3 or not 3 <= len(body) <= 768:
                raise Malformed("PNG: palette length")
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.uint16)
        elif kind == b"tRNS":
            trns = body
        elif kind == b"acTL" and len(body) >= 8:
            declared, plays = struct.unpack_from(">II", body)
        elif kind == b"fcTL":
            if max_frames is not None and len(images) >= max_frames:
                break
            if len(body) != 26:
                raise Malformed("PNG: frame control length")
            _, w, h, x, y, num, den, dispose, blend = struct.unpack(">IIIIIHHBB", body)
            if not w or not h or x + w > head[0] or y + h > head[1]:
                raise Malformed("PNG: frame outside the canvas")
            current = {"box": (x, y, w, h), "delay": num * 1000 // (den or 100), "dispose": dispose, "blend": blend, "data": []}
            images.append(current)
        elif kind == b"IDAT":
            default.append(body)
            if current is not None:
                current["data"].append(body)
        elif kind == b"fdAT" and current is not None:
            current["data"].append(body[4:])
    if head is None or not default:
        raise Malformed("PNG: no image data")
    images = [f for f in images if f["data"]]
    if declared and max_frames is None and len(images) != declared:
        raise Malformed("PNG: frame count")
    return head, palette, trns, plays, default, images


def decode16(data: bytes) -> np.ndarray:
    head, palette, trns, _, default, _ = _parse(data)
    return _rgba16(_plane(default, head[0], head[1], head), head, palette, trns)


def decode(data: bytes) -> np.ndarray:
    return (decode16(data) >> 8).astype(np.uint8)


def decode_frames(data: bytes, max_frames: int | None = None):
    """(frames, plays): each frame is (canvas, delay in ms); stills are one frame without delay."""
    from tessera.codec.blend import source_over

    head, palette, trns, plays, default, images = _parse(data, max_frames)
    if not images:
        return [((_rgba16(_plane(default, head[0], head[1], head), head, palette, trns) >> 8).astype(np.uint8), 0)], 1
    check_budget(head[0], head[1], len(data), head[2] * _CHANNELS[head[3]], len(images))
    canvas, out = np.zeros((head[1], head[0], 4), np.uint8), []
    for i, f in enumerate(images[:max_frames]):
        x, y, w, h = f["box"]
        own = (_rgba16(_plane(f["data"], w, h, head), head, palette, trns) >> 8).astype(np.uint8)
        before = canvas.copy()
        part = canvas[y : y + h, x : x + w]
        part[...] = own if f["blend"] == 0 else source_over(own, part)
        out.append((canvas.copy(), f["delay"] if f["delay"] > 10 else 100))
        if f["dispose"] == 1 or (f["dispose"] == 2 and i == 0):
            canvas[y : y + h, x : x + w] = 0
        elif f["dispose"] == 2:
            canvas = before
    return out, plays


def _filtered(rows: np.ndarray, bpp: int) -> bytes:
    """Rows with the filter of the least sum of absolute signed differences; the lower number wins ties."""
    x = rows.astype(np.int16)
    a = np.pad(x, ((0, 0), (bpp, 0)))[:, : x.shape[1]]
    b = np.pad(x, ((1, 0), (0, 0)))[: len(x)]
    c = np.pad(a, ((1, 0), (0, 0)))[: len(x)]
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
    tried = np.stack([x, x - a, x - b, x - ((a + b) >> 1), x - paeth]).astype(np.uint8)
    cost = np.where(tried < 128, tried, 256 - tried.astype(np.int64)).sum(2)
    best = cost.argmin(0)
    picked = tried[best, np.arange(len(x))]
    return np.concatenate([best[:, None].astype(np.uint8), picked], 1).tobytes()


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _body(image: np.ndarray, alpha: bool) -> bytes:
    bpp = 4 if alpha else 3
    return zlib.compress(_filtered(np.ascontiguousarray(image[..., :bpp]).reshape(len(image), -1), bpp))


def encode(image: np.ndarray, extra: list[tuple[bytes, bytes]] = ()) -> bytes:
    """RGB, or RGBA when a pixel is not opaque; extra chunks come before the data."""
    alpha = bool((image[..., 3] < 255).any())
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 6 if alpha else 2, 0, 0, 0)
    parts = [SIGNATURE, _chunk(b"IHDR", head), *(_chunk(k, v) for k, v in extra)]
    return b"".join([*parts, _chunk(b"IDAT", _body(image, alpha)), _chunk(b"IEND", b"")])


def encode_frames(frames: list[tuple[np.ndarray, int]], plays: int = 0) -> bytes:
    """An animation: the first frame whole, later ones as the box of changed pixels."""
    if len(frames) == 1:
        return encode(frames[0][0])
    first = frames[0][0]
    alpha = any(bool((f[..., 3] < 255).any()) for f, _ in frames)
    head = struct.pack(">IIBBBBB", first.shape[1], first.shape[0], 8, 6 if alpha else 2, 0, 0, 0)
    parts = [SIGNATURE, _chunk(b"IHDR", head), _chunk(b"acTL", struct.pack(">II", len(frames), plays))]
    order, before = 0, None
    for image, delay in frames:
        x = y = 0
        w, h = first.shape[1], first.shape[0]
        if before is not None:
            ys, xs = np.nonzero((image != before).any(-1))
            x, y, w, h = (int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1) if len(xs) else (0, 0, 1, 1)
        parts.append(_chunk(b"fcTL", struct.pack(">IIIIIHHBB", order, w, h, x, y, min(delay, 65535), 1000, 0, 0)))
        body = _body(image[y : y + h, x : x + w], alpha)
        parts.append(_chunk(b"IDAT", body) if before is None else _chunk(b"fdAT", struct.pack(">I", order + 1) + body))
        order += 1 if before is None else 2
        before = image
    return b"".join([*parts, _chunk(b"IEND", b"")])
