"""Which colours a file declares, and the conversion of its pixels to sRGB.

PNG: code points, then profile, sRGB, and gamma with chromaticities; other
formats have a profile. The first declaration that can be read decides; one that
is nearly sRGB changes nothing. Damaged declarations are as absent. High dynamic
range code points (16 and 18) are not converted.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tessera.codec import Malformed, icc, metadata
from tessera.functions.samples import GAMMAS, PRIMARIES

MAX_ICC = 16 << 20
#: Cone responses of Bradford's adaptation.
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])


def png_color(data: bytes) -> dict:
    """Colour chunks before the first image data; the first valid one of each kind counts."""
    out, at = {}, 8

    def take(name, value):
        if value is not None:
            out.setdefault(name, value)

    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind in (b"IDAT", b"IEND") or len(body) < n:
            break
        if kind == b"iCCP":
            take("icc", _profile(body))
        elif kind == b"sRGB" and n == 1 and body[0] < 4:
            take("srgb", body[0])
        elif kind == b"gAMA" and n == 4:
            take("gamma", struct.unpack(">i", body)[0] if 0 < struct.unpack(">i", body)[0] else None)
        elif kind == b"cHRM" and n == 32:
            values = struct.unpack(">8i", body)
            take("chromaticities", values if min(values) >= 0 else None)
        elif kind == b"cICP" and n == 4:
            take("cicp", tuple(body))
        elif kind == b"cLLi" and n == 8:
            take("content_light", struct.unpack(">2I", body))
        elif kind == b"mDCv" and n == 24:
            take("mastering", struct.unpack(">8H2I", body))
        at += 12 + n
    return out


def _profile(body: bytes) -> bytes | None:
    name, nul, rest = body.partition(b"\0")
    if not nul or not 1 <= len(name) <= 79 or rest[:1] != b"\0":
        return None
    try:
        made = zlib.decompressobj().decompress(rest[1:], MAX_ICC + 1)
    except zlib.error:
        return None
    sized = 132 <= len(made) <= MAX_ICC and struct.unpack_from(">I", made)[0] == len(made)
    return made if sized else None


def bmp_icc(data: bytes) -> bytes | None:
    """The embedded profile of a version 5 header."""
    if len(data) < 138 or struct.unpack_from("<I", data, 14)[0] != 124 or data[70:74] != b"DEBM":
        return None
    at, size = struct.unpack_from("<II", data, 126)
    return data[14 + at : 14 + at + size] if size and 14 + at + size <= len(data) else None


def gif_icc(data: bytes) -> bytes | None:
    """Blocks of the application extension ICCRGBG1 012."""
    at = data.find(b"\x21\xff\x0bICCRGBG1012")
    if at < 0:
        return None
    at, out = at + 14, b""
    while at < len(data) and data[at]:
        out += data[at + 1 : at + 1 + data[at]]
        at += 1 + data[at]
    return out or None


def declared(data: bytes) -> dict:
    """Colour declarations of a file; a PNG's have the key png."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return {"png": True, "gray": len(data) > 25 and data[25] in (0, 4), **png_color(data)}
    made = bmp_icc(data) if data[:2] == b"BM" else gif_icc(data) if data[:3] == b"GIF" else metadata.read(data)["icc"]
    return {"icc": made} if made else {}


def to_xyz(corners) -> np.ndarray:
    """Matrix from linear light of primaries (x and y of red, green, blue, white) to XYZ, white at Y = 1."""
    x, y = np.array(corners, float).reshape(4, 2).T
    if (y <= 0).any():
        raise ValueError("chromaticities without luminance")
    columns = np.stack([x / y, np.ones(4), (1 - x - y) / y])
    return columns[:, :3] * np.linalg.solve(columns[:, :3], columns[:, 3])


def _to_srgb_matrix(corners) -> np.ndarray:
    own, srgb = to_xyz(corners), to_xyz(PRIMARIES[1])
    white, wanted = BRADFORD @ own.sum(1), BRADFORD @ srgb.sum(1)
    adapt = np.linalg.inv(BRADFORD) @ np.diag(wanted / white) @ BRADFORD
    return np.linalg.inv(srgb) @ adapt @ own


def _from_srgb(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0.04045, v / 12.92, ((np.maximum(v, 0) + 0.055) / 1.055) ** 2.4)


def _power(gamma: float):
    return lambda v: np.maximum(v, 0) ** gamma


def _code_points(told: dict):
    primaries, transfer, matrix, full = told["cicp"]
    corners = PRIMARIES.get(1 if primaries == 2 else primaries)
    transfer = 13 if transfer == 2 else transfer
    if matrix or corners is None or (transfer != 13 and transfer not in GAMMAS):
        return None
    return _from_srgb if transfer == 13 else _power(GAMMAS[transfer]), corners, not full


def _gamma_and_corners(told: dict):
    gamma, where = told.get("gamma"), told.get("chromaticities")
    curve = _power(100_000 / gamma) if gamma and 10_000 <= gamma <= 1_000_000 else None
    corners = None
    if where:
        try:
            corners = [v / 100_000 for v in (*where[2:], *where[:2])]
            np.linalg.inv(_to_srgb_matrix(corners))
        except (ValueError, np.linalg.LinAlgError):
            corners = None
    if curve is None and corners is None:
        return None
    return curve or _from_srgb, corners or PRIMARIES[1], False


def to_srgb(image: np.ndarray, data: bytes) -> np.ndarray:
    """Pixels of a decoded file in sRGB by what the file declares; alpha is kept."""
    told = declared(data)
    if not told.get("png"):
        return icc.to_srgb(image, told.get("icc"))
    found = _code_points(told) if "cicp" in told else None
    if found is None and "icc" in told:
        try:
            icc.tags(told["icc"])
            return icc.to_srgb(image, told["icc"])
        except (Malformed, struct.error):
            pass
    if found is None and "srgb" in told:
        return image
    found = found or _gamma_and_corners(told)
    if found is None:
        return image
    curve, corners, narrow = found
    matrix = np.eye(3) if told["gray"] else _to_srgb_matrix(corners)

    def shown(colours):
        v = colours / 255.0
        light = curve((v * 255 - 16) / 219 if narrow else v) @ matrix.T
        return icc.encode_srgb(light) * 255

    steps = np.arange(0, 256, 5)[:, None] * np.concatenate([np.eye(3), np.ones((1, 3))])[:, None, :]
    if not told["gray"] and not narrow and np.abs(shown(steps.reshape(-1, 3)) - steps.reshape(-1, 3)).max() <= 0.1:
        return image  # nearly sRGB
    colours, back = np.unique(image[..., :3].reshape(-1, 3), axis=0, return_inverse=True)
    made = np.floor(shown(colours) + 0.5).astype(np.uint8)
    return np.concatenate([made[back.reshape(-1)].reshape(*image.shape[:2], 3), image[..., 3:]], -1)
