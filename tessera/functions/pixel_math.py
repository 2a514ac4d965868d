"""Exact integer pixel arithmetic as Column expressions (64-bit, channels apart)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of a decoded image, in pixels (fixed values).
MAX_PIXELS, MIN_PIXELS, EXPANSION = 1 << 28, 1 << 20, 4096

CHANNELS = ("r", "g", "b")


def div(a, b) -> Column:
    """Integer quotient, toward zero."""
    return F.call_function("div", _col(a), _col(b))


def _col(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def rounded(total, n) -> Column:
    """total / n to the nearest integer, halves up; both are not negative."""
    total, n = _col(total), _col(n)
    return div(total + div(n, F.lit(2)), n)


def ceil_div(a, b) -> Column:
    return div(_col(a) + _col(b) - 1, b)


def clamp_byte(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v))


def multiply_255(c, a) -> Column:
    """c * a / 255 with one rounding, as 8-bit blending does it; also premultiplies."""
    t = _col(c) * _col(a) + 128
    return F.shiftright(t + F.shiftright(t, 8), 8)


def luma(r, g, b) -> Column:
    return F.shiftright(77 * _col(r) + 150 * _col(g) + 29 * _col(b), 8)


def source_over(src: dict[str, Column], dst: dict[str, Column]) -> dict[str, Column]:
    """Straight-alpha compositing of a, r, g, b; opaque and transparent sides pass through whole."""
    sa, da = src["a"], dst["a"]
    keep = da * (255 - sa)
    total = sa * 255 + keep
    out = {"a": div(total + 127, F.lit(255))}
    for c in CHANNELS:
        out[c] = div(src[c] * sa * 255 + dst[c] * keep + div(total, F.lit(2)), F.when(total > 0, total).otherwise(1))
    whole_src, whole_dst = (sa == 255) | ((sa != 0) & (da == 0)), sa == 0
    return {c: F.when(whole_src, src[c]).when(whole_dst, dst[c]).otherwise(v) for c, v in out.items()}


def ycbcr_to_rgb(y, cb, cr) -> dict[str, Column]:
    """Fixed-point colour conversion with 20 fractional bits; the green term of cb loses its low 16 bits."""
    fixed = {k: int(v * 4096 + 0.5) << 8 for k, v in {"r": 1.402, "gr": 0.71414, "gb": 0.34414, "b": 1.772}.items()}
    base, cb, cr = _col(y) * (1 << 20) + (1 << 19), _col(cb) - 128, _col(cr) - 128
    masked = (cb * -fixed["gb"]).bitwiseAND(F.lit(-65536).cast("bigint"))
    sums = {"r": base + cr * fixed["r"], "g": base - cr * fixed["gr"] + masked, "b": base + cb * fixed["b"]}
    return {c: clamp_byte(F.shiftright(v, 20)) for c, v in sums.items()}


def fitted(width, height, max_width, max_height) -> tuple[Column, Column]:
    """Sides of an image scaled down into a box; its own sides when it fits."""
    w, h, mw, mh = map(_col, (width, height, max_width, max_height))
    fits, wide = (w <= mw) & (h <= mh), mw * h <= mh * w
    one = F.lit(1).cast("bigint")
    fw = F.when(fits, w).when(wide, mw).otherwise(F.greatest(one, div(w * mh, h)))
    fh = F.when(fits, h).when(wide, F.greatest(one, div(h * mw, w))).otherwise(mh)
    return fw, fh


def reduction_for(width, height, to_width, to_height) -> Column:
    """Largest of 8, 4, 2 and 1 whose reduced sides still cover the target."""
    w, h, tw, th = map(_col, (width, height, to_width, to_height))
    out = F.lit(1)
    for r in (2, 4, 8):
        out = F.when((ceil_div(w, F.lit(r)) >= tw) & (ceil_div(h, F.lit(r)) >= th), F.lit(r)).otherwise(out)
    return out


def pixel_cap(length, bits=8) -> Column:
    """Most pixels that a file of so many bytes may claim."""
    expansion = div(F.lit(EXPANSION * 8), F.least(_col(bits), F.lit(8)))
    cap = F.greatest(F.lit(MIN_PIXELS), _col(length).cast("bigint") * expansion)
    return F.least(F.lit(MAX_PIXELS).cast("bigint"), cap)


def fits_budget(width, height, length, bits=8) -> Column:
    w, h = _col(width).cast("bigint"), _col(height).cast("bigint")
    return (w > 0) & (h > 0) & (w * h <= pixel_cap(length, bits))


def frames_fit(width, height, frames, length, bits=8) -> Column:
    w, h, n = (_col(v).cast("bigint") for v in (width, height, frames))
    return (w > 0) & (h > 0) & (n > 0) & (w * h <= div(pixel_cap(length, bits), F.when(n > 0, n).otherwise(1)))


def frame_delay(centiseconds) -> Column:
    """Milliseconds of a GIF delay: one centisecond or less plays as 100 ms."""
    cs = _col(centiseconds)
    return F.when(cs <= 1, F.lit(100)).otherwise(cs * 10)


def swaps_axes(orientation) -> Column:
    return _col(orientation).isin(5, 6, 7, 8)


def valid_orientation(orientation) -> Column:
    o = _col(orientation)
    return F.when(o.between(1, 8), o).otherwise(F.lit(1))


def oriented(orientation, x, y, width, height) -> tuple[Column, Column]:
    """Where a stored pixel goes when the image is turned upright (EXIF values 1 to 8)."""
    o, x, y = valid_orientation(orientation), _col(x), _col(y)
    right, below = _col(width) - 1 - x, _col(height) - 1 - y
    nx = F.when(o.isin(2, 3), right).when(o == 5, y).when(o.isin(6, 7), below).when(o == 8, y).otherwise(x)
    ny = F.when(o.isin(3, 4), below).when(o.isin(5, 6), x).when(o.isin(7, 8), right).otherwise(y)
    return nx, ny


def sniff(content) -> Column:
    """Format name from a file's first bytes, or null; the weakest magic comes last."""
    data = _col(content)

    def begins(hexes: str, at: int = 1) -> Column:
        return F.substring(data, at, len(hexes) // 2) == F.unhex(F.lit(hexes))

    brand = F.substring(data, 9, 4)
    avif = F.lit(False)
    size = F.conv(F.hex(F.substring(data, 1, 4)), 16, 10).cast("bigint")
    for slot in range(9, 105, 4):  # major brand, then compatible brands inside the ftyp box
        if slot == 13:
            continue
        brand = F.substring(data, slot, 4)
        avif = avif | ((size >= slot + 3) & brand.isin(bytearray(b"avif"), bytearray(b"avis")))
    return (
        F.when(begins("89504E470D0A1A0A"), "PNG")
        .when(begins("FFD8FF"), "JPEG")
        .when(begins("474946383761") | begins("474946383961"), "GIF")
        .when(begins("52494646") & begins("57454250", 9), "WEBP")
        .when(begins("49492A00") | begins("4D4D002A"), "TIFF")
        .when(begins("4949BC00") | begins("4949BC01"), "JXR")
        .when(begins("0000000C6A502020") | begins("FF4F"), "JP2")
        .when(begins("FF0A") | begins("0000000C4A584C200D0A870A"), "JXL")
        .when(begins("66747970", 5) & avif, "AVIF")
        .when(begins("424D"), "BMP")
    )


def big_endian(content, at: int, size: int) -> Column:
    """Unsigned integer at a byte offset, null past the end."""
    raw = F.substring(_col(content), at + 1, size)
    return F.when(F.length(raw) == size, F.conv(F.hex(raw), 16, 10).cast("bigint"))


def little_endian(content, at: int, size: int) -> Column:
    parts = [big_endian(content, at + i, 1) * (1 << (8 * i)) for i in range(size)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total
