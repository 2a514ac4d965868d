"""Header facts of image files without decoding pixels."""

from __future__ import annotations

import struct

from tessera.codec import Malformed, Refused, Unsupported, bmp, check_budget, gif, jpeg, png, scale, tiff, webp

FIELDS = [
    "format", "width", "height", "bit_depth", "has_alpha", "frame_count", "loop_count", "orientation", "is_decodable",
    "unsupported_reason", "page_count", "color_channels",
]


def sniff(data: bytes) -> str | None:
    if data[:8] == png.SIGNATURE:
        return "PNG"
    if data[:3] == b"\xff\xd8\xff":
        return "JPEG"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "GIF"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "WEBP"
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "TIFF"
    if data[:3] == b"II\xbc" and data[3:4] in (b"\0", b"\1"):
        return "JXR"
    if data[:8] == b"\0\0\0\x0cjP  " or data[:2] == b"\xff\x4f":
        return "JP2"
    if data[:2] == b"\xff\x0a" or data[:12] == b"\0\0\0\x0cJXL \r\n\x87\n":
        return "JXL"
    if data[4:8] == b"ftyp":
        size = struct.unpack(">I", data[:4])[0]
        box = data[: min(size, len(data))]
        if {box[8:12], *(box[i : i + 4] for i in range(16, len(box) - 3, 4))} & {b"avif", b"avis"}:
            return "AVIF"
    return "BMP" if data[:2] == b"BM" else None


def exif_orientation(block: bytes) -> int | None:
    """Tag 274 of the first directory; anything odd is no orientation."""
    try:
        e = {b"II": "<", b"MM": ">"}[block[:2]]
        at = struct.unpack_from(e + "I", block, 4)[0]
        for i in range(min(struct.unpack_from(e + "H", block, at)[0], 512)):
            tag, kind, n, value = struct.unpack_from(e + "HHIH", block, at + 2 + 12 * i)
            if tag == 274:
                return value if kind == 3 and n == 1 and 1 <= value <= 8 else None
    except (KeyError, struct.error):
        pass
    return None


def _info(form, width, height, depth, alpha, channels, frames=1, loops=1, orientation=1, pages=1, reason=None):
    return dict(zip(FIELDS, (form, width, height, depth, alpha, frames, loops, orientation, reason is None, reason, pages, channels), strict=True))


def _png(data):
    if len(data) < 33 or data[12:16] != b"IHDR":
        raise Malformed("PNG: no IHDR")
    width, height, depth, colour = struct.unpack_from(">IIBB", data, 16)
    alpha, frames, loops, at, reason = colour in (4, 6), 1, 1, 8, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind in (b"IDAT", b"fdAT", b"IEND"):
            break
        if kind == b"tRNS":
            alpha = True
        elif kind == b"acTL" and size >= 8 and at + 16 <= len(data):
            frames, loops = struct.unpack_from(">II", data, at + 8)
        elif kind == b"CgBI":
            reason = "PNG: Apple variant"
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 3, 4: 1, 6: 3}.get(colour, 0)
    reason = reason or _budget(width, height, len(data), depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 1))
    return _info("PNG", width, height, depth, alpha, channels, max(frames, 1), loops, reason=reason)


def _budget(width, height, length, bits):
    try:
        check_budget(width, height, length, bits)
    except Refused as e:
        return str(e)
    return None


def _jpeg(data):
    at, orientation = 2, 1
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Malformed("JPEG: no marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 1 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            orientation = exif_orientation(data[at + 10 : at + 2 + size]) or orientation
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 10 > len(data):
                break
            depth, height, width, parts = struct.unpack_from(">BHHB", data, at + 4)
            reason = _budget(width, height, len(data), 8)
            if (marker > 0xC2 or depth != 8) and not (marker == 0xC3 and 2 <= depth <= 16):
                reason = f"JPEG: frame type {marker:#x} with {depth} bits"
            return _info("JPEG", width, height, depth, False, parts, orientation=orientation, reason=reason)
        if marker in (0xD9, 0xDA) or size < 2:
            break
        at += 2 + size
    raise Malformed("JPEG: no frame header")


def _gif(data):
    frames, loops, alpha, size = 0, 1, False, (0, 0)
    for kind, value in gif.walk(data):
        if kind == "screen":
            size = value
        elif kind == "loop":
            loops = value + 1 if value else 0
        else:
            frames += 1
            alpha = alpha or value[8][2] is not None
    return _info("GIF", *size, 8, alpha, 3, frames, loops)


def _bmp(data):
    h = bmp.header(data)
    reason = "BMP: embedded JPEG or PNG" if h["kind"] in (4, 5) else _budget(h["width"], h["height"], len(data), h["bits"] or 8)
    return _info("BMP", h["width"], h["height"], min(h["bits"], 8), h["bits"] == 32, 3, reason=reason)


def _tiff(data, page):
    chain = tiff.pages(data)
    if not 0 <= page < len(chain):
        raise ValueError(f"page {page} of {len(chain)}")
    f = tiff.facts(data, chain[page])
    orientation = f["orientation"] if 1 <= f["orientation"] <= 8 else 1
    channels = {0: 1, 1: 1, 2: 3, 3: 3}.get(f["photometric"], 0)
    return _info("TIFF", f["width"], f["height"], f["bits"], bool(f["extra"]), channels, orientation=orientation, pages=len(chain), reason=f["reason"])


def _webp(data):
    size, alpha, frames, loops, at, image, lossy = None, False, 0, 1, 12, False, False
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + n]
        if kind == b"VP8X" and len(body) >= 10:
            size = (1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little"))
            alpha = bool(body[0] & 16)
        elif kind == b"ANIM" and len(body) >= 6:
            loops = struct.unpack_from("<H", body, 4)[0]
        elif kind == b"ANMF":
            frames, image = frames + 1, True
            lossy = lossy or b"VP8 " in body[16:28]
        elif kind == b"VP8L" and len(body) >= 5:
            bits, image = struct.unpack_from("<I", body, 1)[0], True
            size = size or (1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
            alpha = alpha or bool(bits >> 28 & 1)
        elif kind == b"VP8 " and len(body) >= 10:
            w, h = struct.unpack_from("<HH", body, 6)
            size, image, lossy = size or (w & 0x3FFF, h & 0x3FFF), True, True
        elif kind == b"ALPH":
            alpha = True
        at += 8 + n + (n & 1)
    if size is None:
        raise Malformed("WEBP: no size")
    reason = "WEBP: no image" if not image else "WEBP: lossy pictures are not decoded by this build" if lossy else _budget(*size, len(data), 8)
    return _info("WEBP", *size, 8, alpha, 3, max(frames, 1), loops, reason=reason)


def _jp2(data):
    at = data.find(b"\xff\x4f\xff\x51")
    if at < 0 or at + 42 > len(data):
        raise Malformed("JP2: no codestream")
    x1, y1, x0, y0 = struct.unpack_from(">IIII", data, at + 8)
    parts, depth = struct.unpack_from(">HB", data, at + 40)
    return _info("JP2", x1 - x0, y1 - y0, (depth & 127) + 1, parts in (2, 4), 1 if parts < 3 else 3, reason="JP2: pixels are not decoded by this build")


def _boxes(data, at, end):
    """(type, start, end) of ISO media boxes."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise Malformed("box is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Malformed("box is cut off")
        yield kind, at + head, at + size
        at += size


def _avif(data):
    size, depth, channels, turn, mirror, alpha = None, 8, 3, 0, None, b"urn:mpeg:mpegB:cicp:systems:auxiliary:alpha" in data
    frames = 1
    for kind, a, b in _boxes(data, 0, len(data)):
        if kind != b"meta":
            continue
        for kind2, c, d in _boxes(data, a + 4, b):
            if kind2 != b"iprp":
                continue
            for kind3, e, f in _boxes(data, c, d):
                for kind4, g, h in _boxes(data, e, f) if kind3 == b"ipco" else ():
                    if kind4 == b"ispe" and size is None and h - g >= 12:
                        size = struct.unpack_from(">II", data, g + 4)
                    elif kind4 == b"pixi" and h - g >= 6:
                        channels, depth = data[g + 4], data[g + 5]
                    elif kind4 == b"irot":
                        turn = data[g] & 3
                    elif kind4 == b"imir":
                        mirror = data[g] & 1
    if size is None:
        raise Malformed("AVIF: no image size")
    # quarter turns against the clock, then a mirror: 0 upside down, 1 left to right
    plain, mirrored = (1, 8, 3, 6), {0: (4, 5, 2, 7), 1: (2, 7, 4, 5)}
    orientation = plain[turn] if mirror is None else mirrored[mirror][turn]
    return _info("AVIF", *size, depth, alpha, min(channels, 3), frames, orientation=orientation, reason="AVIF: pixels are not decoded by this build")


def _jxl(data):
    if data[:2] != b"\xff\x0a":
        parts = [(a + 4 * (kind == b"jxlp"), b) for kind, a, b in _boxes(data, 0, len(data)) if kind in (b"jxlc", b"jxlp")]
        data = b"".join(data[a:b] for a, b in parts)
        if data[:2] != b"\xff\x0a":
            raise Malformed("JXL: no codestream")
    value, at = int.from_bytes(data[2:18], "little"), 0

    def bits(n):
        nonlocal at
        at += n
        return value >> (at - n) & ((1 << n) - 1)

    def side(small):
        return 8 * (bits(5) + 1) if small else bits((9, 13, 18, 30)[bits(2)]) + 1

    small = bits(1)
    height = side(small)
    ratio = bits(3)
    shapes = {1: (1, 1), 2: (12, 10), 3: (4, 3), 4: (3, 2), 5: (16, 9), 6: (5, 4), 7: (2, 1)}
    width = height * shapes[ratio][0] // shapes[ratio][1] if ratio else side(small)
    if 16 + at > 8 * len(data):
        raise Malformed("JXL: header is cut off")
    return _info("JXL", width, height, 8, False, 3, reason="JXL: pixels and the rest of the header are not decoded by this build")


def _jxr(data):
    if len(data) < 8:
        raise Malformed("JXR: no header")
    at, found = struct.unpack_from("<I", data, 4)[0], {}
    if at + 2 > len(data):
        raise Malformed("JXR: directory offset")
    for i in range(struct.unpack_from("<H", data, at)[0]):
        tag, kind, _, value = struct.unpack_from("<HHII", data, at + 2 + 12 * i)
        found[tag] = value & 0xFFFF if kind == 3 else value
    if not found.get(0xBC80) or not found.get(0xBC81):
        raise Malformed("JXR: no image size")
    return _info("JXR", found[0xBC80], found[0xBC81], 8, bool(found.get(0xBCC2)), 3, reason="JXR: pixels are not decoded by this build")


def probe(data: bytes, page: int = 0) -> dict:
    """Header facts; only TIFF has pages after the first."""
    form = sniff(data)
    if form == "TIFF":
        return _tiff(data, page)
    if page:
        raise ValueError("only TIFF has further pages")
    walkers = {"PNG": _png, "JPEG": _jpeg, "GIF": _gif, "BMP": _bmp, "WEBP": _webp, "JP2": _jp2, "AVIF": _avif, "JXL": _jxl, "JXR": _jxr}
    if form is None:
        raise Malformed(f"unknown format: {len(data)} bytes, {data[:4].hex()}")
    return walkers[form](data)


def decode(data: bytes, page: int = 0, reduction: int = 1):
    """The first composited image of a file, as r, g, b, a; JPEG files are reduced by their inverse transform, others by averages."""
    form = sniff(data)
    if reduction != 1:
        return jpeg.decode(data, reduction) if form == "JPEG" and reduction in (2, 4, 8) else scale.reduced(decode(data, page), reduction)
    if page and form != "TIFF":
        raise ValueError("only TIFF has further pages")
    if form == "TIFF":
        return tiff.decode(data, page)
    tools = {"PNG": png, "BMP": bmp, "GIF": gif, "JPEG": jpeg, "WEBP": webp}
    if form is None:
        raise Malformed(f"unknown format: {len(data)} bytes, {data[:4].hex()}")
    if form not in tools:
        raise Unsupported(f"{form}: pixels are not decoded by this build")
    return tools[form].decode(data)


def decode_frames(data: bytes, max_frames: int | None = None):
    """(frames, plays); a still is one frame without delay that plays once."""
    form = sniff(data)
    if form == "PNG":
        return png.decode_frames(data, max_frames)
    if form == "GIF":
        return gif.decode_frames(data, max_frames)
    if form == "WEBP":
        return webp.decode_frames(data, max_frames)
    return [(decode(data), 0)], 1


def decode16(data: bytes, page: int = 0):
    """Samples (height, width, channels) of 16 bits: gray, gray and alpha, colour, or colour and alpha.

    PNG and TIFF keep their depth; other formats' bytes are widened.
    """
    import numpy as np

    form = sniff(data)
    if page and form != "TIFF":
        raise ValueError("only TIFF has further pages")
    if form == "TIFF":
        raw, f = tiff.samples16(data, page)
        if f["photometric"] in (1, 2) and len(f["extra"]) == raw.shape[2] - (3 if f["photometric"] == 2 else 1) <= 1 and f["extra"] != [1]:
            return (raw.astype(np.uint32) * 65535 // ((1 << f["bits"]) - 1)).astype(np.uint16)
    if form == "PNG":
        wide, colour = png.decode16(data), data[25]
        return {0: wide[..., :1], 4: wide[..., [0, 3]], 2: wide[..., :3]}.get(colour, wide) if (wide[..., 3] == 65535).all() or colour != 2 else wide
    image = decode(data, page)
    return image.astype(np.uint16) * 257
