"""ICC profiles with curves and a matrix (or one gray curve), and their conversion to sRGB.

Profiles with lookup tables and CMYK profiles are left alone: conversion then
gives the image unchanged, as it does for a profile of another colour space
than the image's and for one that is nearly sRGB already.
"""

from __future__ import annotations

import struct

import numpy as np

from tessera.codec import Malformed

# sRGB primaries adapted to the D50 connection space (columns red, green, blue).
SRGB_D50 = np.array([
    [0.4360747, 0.3850649, 0.1430804],
    [0.2225045, 0.7168786, 0.0606169],
    [0.0139322, 0.0971045, 0.7141733],
])
#: Exponents and parameter counts of the parametric curve types.
PARAMETERS = {0: 1, 1: 3, 2: 4, 3: 5, 4: 7}


def tags(icc: bytes) -> dict[str, bytes]:
    if len(icc) < 132 or icc[36:40] != b"acsp":
        raise Malformed("ICC: no header")
    out = {}
    for i in range(min(struct.unpack_from(">I", icc, 128)[0], 256)):
        if 144 + 12 * i > len(icc):
            raise Malformed("ICC: tag table is cut off")
        name, at, size = struct.unpack_from(">4sII", icc, 132 + 12 * i)
        if at + size > len(icc):
            raise Malformed("ICC: tag is cut off")
        out[name.decode("latin-1")] = icc[at : at + size]
    return out


def color_space(icc: bytes) -> str | None:
    return icc[16:20].decode("latin-1").rstrip() if len(icc) >= 128 else None


def description(icc: bytes) -> str | None:
    """Text of the description tag, in its version 2 or version 4 form."""
    try:
        body = tags(icc).get("desc", b"")
        if body[:4] == b"desc":
            n = struct.unpack_from(">I", body, 8)[0]
            return body[12 : 12 + n].split(b"\0")[0].decode("ascii", "replace")
        if body[:4] == b"mluc" and struct.unpack_from(">I", body, 8)[0]:
            n, at = struct.unpack_from(">II", body, 20)
            return body[at : at + n].decode("utf-16-be", "replace")
    except (Malformed, struct.error):
        pass
    return None


def curve(body: bytes):
    """A function from 0..1 to 0..1: identity, gamma, sampled or parametric."""
    kind = body[:4]
    if kind == b"curv":
        n = struct.unpack_from(">I", body, 8)[0]
        if n == 0:
            return lambda v: v
        if n == 1:
            gamma = struct.unpack_from(">H", body, 12)[0] / 256
            return lambda v: v**gamma
        table = np.frombuffer(body, ">u2", n, 12) / 65535
        return lambda v: np.interp(v, np.linspace(0, 1, n), table)
    if kind == b"para":
        form = struct.unpack_from(">H", body, 8)[0]
        if form not in PARAMETERS:
            raise Malformed("ICC: curve type")
        p = [x / 65536 for x in struct.unpack_from(f">{PARAMETERS[form]}i", body, 12)]
        g, a, b, c, d, e, f = p[0], *(p[1:] + [0.0] * 6)[:6]
        if form == 0:
            return lambda v: v**g
        if form < 3:  # one exponent above -b/a, and a constant below it
            low = c if form == 2 else 0.0
            return lambda v: np.where(v >= -b / a, np.maximum(a * v + b, 0) ** g + low, low)
        high, line = (e, f) if form == 4 else (0.0, 0.0)
        return lambda v: np.where(v >= d, np.maximum(a * v + b, 0) ** g + high, c * v + line)
    raise Malformed("ICC: curve")


def _xyz(body: bytes) -> np.ndarray:
    if body[:4] != b"XYZ " or len(body) < 20:
        raise Malformed("ICC: colorant")
    return np.array(struct.unpack_from(">3i", body, 8)) / 65536


def encode_srgb(v: np.ndarray) -> np.ndarray:
    v = np.clip(v, 0, 1)
    return np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055)


def to_srgb(image: np.ndarray, icc: bytes | None) -> np.ndarray:
    """The image in sRGB; alpha is kept. Distinct colours are converted once."""
    if not icc:
        return image
    try:
        found, space = tags(icc), color_space(icc)
        if space == "RGB" and {"rXYZ", "gXYZ", "bXYZ", "rTRC", "gTRC", "bTRC"} <= set(found) and "A2B0" not in found:
            matrix = np.linalg.inv(SRGB_D50) @ np.stack([_xyz(found[c + "XYZ"]) for c in "rgb"], 1)
            curves = [curve(found[c + "TRC"]) for c in "rgb"]
        elif space == "GRAY" and "kTRC" in found and (image[..., :1] == image[..., 1:3]).all():
            matrix, curves = np.eye(3), [curve(found["kTRC"])] * 3
        else:
            return image
        colours, back = np.unique(image[..., :3].reshape(-1, 3), axis=0, return_inverse=True)
        light = np.stack([f(colours[:, i] / 255.0) for i, f in enumerate(curves)], 1)
        made = np.rint(encode_srgb(light @ matrix.T) * 255).astype(np.uint8)
    except (Malformed, struct.error, ValueError, ZeroDivisionError, np.linalg.LinAlgError):
        return image
    if np.abs(made.astype(int) - colours).max(initial=0) <= 1:
        return image
    return np.concatenate([made[back.reshape(-1)].reshape(*image.shape[:2], 3), image[..., 3:]], -1)


def build(space: str, parts: dict[str, bytes]) -> bytes:
    """A small version 4 profile from tag bodies."""
    at, table, body = 132 + 12 * len(parts), b"", b""
    for name, raw in parts.items():
        raw += b"\0" * (-len(raw) % 4)
        table += struct.pack(">4sII", name.encode(), at + len(body), len(raw))
        body += raw
    head = bytearray(128)
    struct.pack_into(">I4xI4s4s4s", head, 0, at + len(body), 0x04000000, b"mntr", space.ljust(4).encode(), b"XYZ ")
    head[36:40] = b"acsp"
    return bytes(head) + struct.pack(">I", len(parts)) + table + body
