"""Metadata blocks of JPEG, PNG and WebP files, and motion photos."""

from __future__ import annotations

import re
import struct
import zlib

from tessera.codec import Malformed, jpeg, png, probe

EXIF, XMP, ICC = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"ICC_PROFILE\0"


def _jpeg_icc(pieces: dict[int, tuple[int, bytes]]) -> bytes | None:
    """Profile pieces in the order of their numbers, if all are there."""
    if not pieces:
        return None
    total = next(iter(pieces.values()))[0]
    if set(pieces) != set(range(1, total + 1)) or any(t != total for t, _ in pieces.values()):
        return None
    return b"".join(pieces[i][1] for i in range(1, total + 1))


def read(data: bytes) -> dict:
    """exif, xmp and icc of a file; the first of each wins, damage ends the search, other formats have none."""
    out: dict = {"exif": None, "xmp": None, "icc": None}
    form = probe.sniff(data)
    try:
        if form == "JPEG":
            pieces: dict[int, tuple[int, bytes]] = {}
            for marker, body, _ in jpeg._segments(data):
                if marker == 0xE1 and body.startswith(EXIF) and out["exif"] is None:
                    out["exif"] = body[len(EXIF) :]
                elif marker == 0xE1 and body.startswith(XMP) and out["xmp"] is None:
                    out["xmp"] = body[len(XMP) :].decode("utf-8", "replace")
                elif marker == 0xE2 and body.startswith(ICC) and len(body) > 14:
                    pieces.setdefault(body[12], (body[13], body[14:]))
                elif marker == 0xDA:
                    break
            out["icc"] = _jpeg_icc(pieces)
        elif form == "PNG":
            for kind, body in png.chunks(data):
                if kind == b"eXIf" and out["exif"] is None:
                    out["exif"] = body
                elif kind == b"iTXt" and body.startswith(b"XML:com.adobe.xmp\0\0\0") and out["xmp"] is None:
                    out["xmp"] = body.split(b"\0", 5)[5].decode("utf-8", "replace")
                elif kind == b"iCCP" and out["icc"] is None:
                    name, _, rest = body.partition(b"\0")
                    out["icc"] = zlib.decompressobj().decompress(rest[1:], 1 << 24)
        elif form == "WEBP":
            at = 12
            while at + 8 <= len(data):
                kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
                body = data[at + 8 : at + 8 + n]
                if kind == b"EXIF" and out["exif"] is None:
                    out["exif"] = body.removeprefix(EXIF)
                elif kind == b"XMP " and out["xmp"] is None:
                    out["xmp"] = body.decode("utf-8", "replace")
                elif kind == b"ICCP" and out["icc"] is None:
                    out["icc"] = body
                at += 8 + n + (n & 1)
    except (Malformed, zlib.error, struct.error, IndexError):
        pass
    return out


def png_chunks(exif: bytes | None = None, xmp: str | None = None, icc: bytes | None = None) -> list[tuple[bytes, bytes]]:
    """Chunks for `png.encode` that carry metadata."""
    out = []
    if icc:
        out.append((b"iCCP", b"ICC profile\0\0" + zlib.compress(icc)))
    if exif:
        out.append((b"eXIf", exif))
    if xmp:
        out.append((b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + xmp.encode()))
    return out


def into_jpeg(data: bytes, exif: bytes | None = None, xmp: str | None = None, icc: bytes | None = None) -> bytes:
    """The file with metadata segments behind its start; blocks beyond a segment's size are left out, profiles are split."""
    parts = []
    for head, body in ((EXIF, exif), (XMP, xmp.encode() if xmp else None)):
        if body and len(head) + len(body) <= 65533:
            parts.append(struct.pack(">BBH", 255, 0xE1, len(head) + len(body) + 2) + head + body)
    if icc:
        pieces = [icc[i : i + 65519] for i in range(0, len(icc), 65519)]
        if len(pieces) <= 255:
            for i, p in enumerate(pieces):
                body = ICC + bytes([i + 1, len(pieces)]) + p
                parts.append(struct.pack(">BBH", 255, 0xE2, len(body) + 2) + body)
    return data[:2] + b"".join(parts) + data[2:]


def motion_photo(data: bytes) -> tuple[int, int, str] | None:
    """(offset, length, kind) of the video behind a photo: container lengths, micro video offset, or a marked trailer."""
    xmp = read(data)["xmp"] or ""
    if re.search(r'(?:GCamera|Camera):MotionPhoto\s*=\s*"1"', xmp):
        found = re.search(r'Item:Semantic\s*=\s*"MotionPhoto"[^>]*?Item:Length\s*=\s*"(\d+)"', xmp) or re.search(
            r'Item:Length\s*=\s*"(\d+)"[^>]*?Item:Semantic\s*=\s*"MotionPhoto"', xmp
        )
        if found and 0 < int(found[1]) < len(data):
            return len(data) - int(found[1]), int(found[1]), "motion_photo"
    found = re.search(r'GCamera:MicroVideoOffset\s*=\s*"(\d+)"', xmp)
    if re.search(r'GCamera:MicroVideo\s*=\s*"1"', xmp) and found and 0 < int(found[1]) < len(data):
        return len(data) - int(found[1]), int(found[1]), "micro_video"
    at = data.rfind(b"MotionPhoto_Data")
    if at >= 0 and data[at + 20 : at + 24] == b"ftyp":
        return at + 16, len(data) - at - 16, "trailer"
    return None


def remove_motion(data: bytes) -> bytes:
    """The file without its video; a photo without one comes back as it is."""
    found = motion_photo(data)
    if not found:
        return data
    cut = found[0] - 16 if found[2] == "trailer" else found[0]
    kept = data[:cut]
    for name in (rb"MotionPhoto", rb"MicroVideo"):  # the marks keep their length, so no offsets move
        kept = re.sub(rb'(Camera:' + name + rb'\s*=\s*)"1"', rb'\1"0"', kept)
    return kept
