"""GIF: LZW, tables, interlace, disposal, loops; exact or median-cut palettes."""

from __future__ import annotations

import struct

import numpy as np

from tessera.codec import Malformed, check_budget


def lzw_decode(raw: bytes, least: int, most: int) -> bytes:
    """Up to `most` bytes of LSB-first LZW codes; an early end is allowed."""
    clear, stop = 1 << least, (1 << least) + 1
    first = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, size, before, out, length = list(first), least + 1, None, bytearray(), 0
    acc = bits = 0
    for byte in raw:
        acc |= byte << bits
        bits += 8
        while bits >= size:
            code = acc & ((1 << size) - 1)
            acc >>= size
            bits -= size
            if code == clear:
                table, size, before = list(first), least + 1, None
                continue
            if code == stop or len(out) >= most:
                return bytes(out[:most])
            if before is None:
                if code >= clear:
                    raise Malformed("GIF: first code")
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = before + before[:1]
                else:
                    raise Malformed("GIF: code out of order")
                if len(table) < 4096:
                    table.append(before + entry[:1])
                    if len(table) == 1 << size and size < 12:
                        size += 1
            out += entry
            before = entry
            length += 1
    return bytes(out[:most])


def lzw_encode(values: bytes, least: int) -> bytes:
    clear, stop = 1 << least, (1 << least) + 1
    out, acc, bits = bytearray(), 0, 0

    def put(code, size):
        nonlocal acc, bits
        acc |= code << bits
        bits += size
        while bits >= 8:
            out.append(acc & 255)
            acc >>= 8
            bits -= 8

    table, size = {bytes([i]): i for i in range(clear)}, least + 1
    put(clear, size)
    run = b""
    for v in values:
        longer = run + bytes([v])
        if longer in table:
            run = longer
            continue
        put(table[run], size)
        if len(table) + 2 < 4096:
            table[longer] = len(table) + 2
            if len(table) + 2 > 1 << size and size < 12:
                size += 1
        else:
            put(clear, size)
            table, size = {bytes([i]): i for i in range(clear)}, least + 1
        run = bytes([v])
    if run:
        put(table[run], size)
    put(stop, size)
    if bits:
        out.append(acc & 255)
    return bytes(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while True:
        if at >= len(data):
            raise Malformed("GIF: data is cut off")
        n = data[at]
        if n == 0:
            return b"".join(out), at + 1
        if at + 1 + n > len(data):
            raise Malformed("GIF: block is cut off")
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _table(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 << ((flags & 7) + 1)
    if at + n > len(data):
        raise Malformed("GIF: colour table is cut off")
    return np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n


def walk(data: bytes):
    """Header, then what follows it: ('loop', repeats), ('image', ...). Ends at the trailer, or after a whole image."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise Malformed("GIF: no header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    check_budget(width, height, len(data))
    at, table = 13, None
    if flags & 0x80:
        table, at = _table(data, at, flags)
    yield "screen", (width, height)
    control, images = (0, 0, None), 0
    while True:
        if at >= len(data):
            if images:
                return
            raise Malformed("GIF: no image")
        kind = data[at]
        if kind == 0x3B:
            if not images:
                raise Malformed("GIF: no image")
            return
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                control = ((body[0] >> 2) & 7, struct.unpack_from("<H", body, 1)[0], body[3] if body[0] & 1 else None)
            elif label == 0xFF and body[:11] in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and len(body) >= 14 and body[11] == 1:
                yield "loop", struct.unpack_from("<H", body, 12)[0]
        elif kind == 0x2C:
            if at + 10 > len(data):
                raise Malformed("GIF: image header is cut off")
            x, y, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
            at, colours = at + 10, table
            if own & 0x80:
                colours, at = _table(data, at, own)
            if at >= len(data) or not 1 <= data[at] <= 11:
                raise Malformed("GIF: code size")
            least = data[at]
            body, at = _blocks(data, at + 1)
            yield "image", (x, y, w, h, bool(own & 0x40), colours, least, body, control)
            images, control = images + 1, (0, 0, None)
        else:
            raise Malformed(f"GIF: block {kind:#x}")


def decode_frames(data: bytes, max_frames: int | None = None):
    """(frames, plays): composited canvases with delays; plays 0 is forever, 1 without the extension."""
    out, plays, canvas = [], 1, None
    for kind, value in walk(data):
        if kind == "screen":
            canvas = np.zeros((value[1], value[0], 4), np.uint8)
        elif kind == "loop":
            plays = value + 1 if value else 0
        else:
            if max_frames is not None and len(out) >= max_frames:
                break
            check_budget(canvas.shape[1], canvas.shape[0], len(data), 8, len(out) + 1)
            x, y, w, h, interlaced, colours, least, body, (dispose, delay, clear) = value
            if colours is None:
                raise Malformed("GIF: no colour table")
            check_budget(max(w, 1), max(h, 1), len(data))
            raw = lzw_decode(body, least, w * h)
            if len(raw) < w * h:
                raise Malformed("GIF: too little image data")
            index = np.frombuffer(raw, np.uint8).reshape(h, w)
            if interlaced:
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(index)
                straight[order] = index
                index = straight
            before = canvas.copy()
            bottom, right = min(y + h, canvas.shape[0]), min(x + w, canvas.shape[1])
            part = index[: max(0, bottom - y), : max(0, right - x)]
            shown = np.ones(part.shape, bool) if clear is None else part != clear
            if (part[shown] >= len(colours)).any():
                raise Malformed("GIF: index beyond the table")
            box = canvas[y:bottom, x:right]
            box[shown] = np.concatenate([colours[part[shown]], np.full((int(shown.sum()), 1), 255, np.uint8)], 1)
            out.append((canvas.copy(), 100 if delay <= 1 else delay * 10))
            if dispose == 2:
                canvas[y:bottom, x:right] = 0
            elif dispose == 3:
                canvas = before
    return out, plays


def decode(data: bytes) -> np.ndarray:
    return decode_frames(data, 1)[0][0][0]


def palette_of(rgb: np.ndarray, most: int) -> np.ndarray:
    """Sorted colours when there are few enough, else the means of a median cut."""
    colours, n = np.unique(rgb.reshape(-1, 3), axis=0, return_counts=True)
    if len(colours) <= most:
        return colours
    boxes = [np.arange(len(colours))]
    while len(boxes) < most:
        spans = [np.ptp(colours[b].astype(int), axis=0).max() if len(b) > 1 else -1 for b in boxes]
        at = int(np.argmax(spans))
        if spans[at] <= 0:
            break
        box = boxes.pop(at)
        axis = int(np.ptp(colours[box].astype(int), axis=0).argmax())
        box = box[np.argsort(colours[box, axis], kind="stable")]
        half = np.cumsum(n[box])
        cut = min(max(1, int(np.searchsorted(half, half[-1] / 2))), len(box) - 1)
        boxes += [box[:cut], box[cut:]]
    means = [np.rint(np.average(colours[b], axis=0, weights=n[b])) for b in boxes]
    return np.unique(np.array(means, np.uint8), axis=0)


def encode_frames(frames: list[tuple[np.ndarray, int]], plays: int = 1) -> bytes:
    """Whole frames, each with its own palette; alpha under 128 is transparent and frames are cleared after showing."""
    if not 0 <= plays <= 65536:
        raise ValueError(f"{plays} plays")
    height, width = frames[0][0].shape[:2]
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x70, 0, 0)]
    if plays != 1:
        parts.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", max(0, plays - 1)) + b"\0")
    several = len(frames) > 1
    for image, delay in frames:
        clear = image[..., 3] < 128
        holes = bool(clear.any())
        colours = palette_of(image[..., :3][~clear], 255 if holes else 256) if not clear.all() else np.zeros((1, 3), np.uint8)
        flat = image[..., :3].reshape(-1, 3).astype(np.int32)
        kinds, back = np.unique(flat, axis=0, return_inverse=True)
        near = np.concatenate([((kinds[i : i + 1024, None] - colours[None].astype(np.int32)) ** 2).sum(-1).argmin(1) for i in range(0, len(kinds), 1024)])
        index = near[back.reshape(-1)].astype(np.uint8)
        if holes:
            index[clear.reshape(-1)] = len(colours)
        bits = max(2, (len(colours) + holes - 1).bit_length())
        table = np.zeros((1 << bits, 3), np.uint8)
        table[: len(colours)] = colours
        flags = ((2 if several else 0) << 2) | holes
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, (delay + 5) // 10, len(colours) if holes else 0) + b"\0")
        parts.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, height, 0x80 | (bits - 1)) + table.tobytes() + bytes([bits]))
        body = lzw_encode(index.tobytes(), bits)
        parts += [bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)] + [b"\0"]
    return b"".join([*parts, b"\x3b"])


def encode(image: np.ndarray) -> bytes:
    return encode_frames([(image, 0)])
