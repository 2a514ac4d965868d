"""Exact sample arithmetic of the codecs as Column expressions: colour transforms, ranges, code points, box rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.functions import pixel_math as pm


def reversible_forward(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """The reversible colour transform of JPEG 2000: luma and two differences."""
    return {"y": F.shiftright(r + 2 * g + b, 2), "u": b - g, "v": r - g}


def reversible_inverse(y: Column, u: Column, v: Column) -> dict[str, Column]:
    g = y - F.shiftright(u + v, 2)
    return {"r": v + g, "g": g, "b": u + g}


def modular_color(kind: int, a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Undoes one of the 42 reversible colour transforms of modular images: seven kinds in six orders of channels."""
    if not 0 <= kind < 42:
        raise ValueError(f"no colour transform {kind}")
    order, form = divmod(kind, 7)
    if form == 6:  # luma with two chroma differences
        base = a - F.shiftright(c, 1)
        green = c + base
        blue = base - F.shiftright(b, 1)
        made = (b + blue, green, blue)
    else:
        third = c + a if form % 2 else c
        second = {0: b, 1: b + a, 2: b + F.shiftright(a + third, 1)}[form // 2]
        made = (a, second, third)
    out: list = [None] * 3
    for place, value in zip((order % 3, (order + 1 + order // 3) % 3, (order + 2 - order // 3) % 3), made):
        out[place] = value
    return tuple(out)


def reference_levels(code: Column, black: tuple[int, int], white: tuple[int, int]) -> Column:
    """A stored sample as 0 to 255 between its reference black and white, two fractions; halves round up."""
    span = white[0] * black[1] - black[0] * white[1]
    if not black[1] or not white[1] or not span:
        raise ValueError("reference black and white need a range")
    top = (code * black[1] - black[0]) * (white[1] * 255 * 65536)
    fixed = pm.div(top, F.lit(abs(span))) * (1 if span > 0 else -1)
    return pm.clamp_byte(F.shiftright(fixed + 32768, 16))


#: Fixed values of ITU-T H.273, table 4: Kr and Kb of matrix coefficients; others read as those of BT.601.
MATRIX = {1: (0.2126, 0.0722), 4: (0.30, 0.11), 7: (0.212, 0.087), 9: (0.2627, 0.0593)}
#: Matrix coefficients that are not a linear transform of the samples, or not defined.
REFUSED_MATRICES = (10, 11, 13, 14)


def yuv_to_rgb(y: Column, u: Column, v: Column, matrix: int = 6, full_range: bool = False, depth: int = 8) -> dict[str, Column]:
    """Samples of 4:4:4 pictures as red, green and blue of the same depth, rounded once."""
    if matrix in REFUSED_MATRICES or matrix > 14:
        raise ValueError(f"matrix coefficients {matrix}")
    top = (1 << depth) - 1
    scale = 1 << (depth - 8)
    bias, span = (0.0, float(top)) if full_range else (16.0 * scale, 219.0 * scale)
    middle, chroma = float(1 << (depth - 1)), float(top) if full_range else 224.0 * scale
    luma = (y - bias) / span
    if matrix == 0:
        made = {"r": (v - bias) / span, "g": luma, "b": (u - bias) / span}
    else:
        cb, cr = (u - middle) / chroma, (v - middle) / chroma
        if matrix == 8:
            base = luma - cb
            made = {"r": base + cr, "g": luma + cb, "b": base - cr}
        else:
            kr, kb = MATRIX.get(matrix, (0.299, 0.114))
            kg = 1.0 - kr - kb
            made = {"r": luma + 2 * (1 - kr) * cr, "b": luma + 2 * (1 - kb) * cb}
            made["g"] = luma - (2 * (kr * (1 - kr) * cr + kb * (1 - kb) * cb)) / kg
    unit = {c: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) for c, x in made.items()}
    return {c: F.floor(unit[c] * top + 0.5) for c in ("r", "g", "b")}


def widened(v: Column, bits: int) -> Column:
    """A sample of `bits` bits as 16 bits, by repeating its bits."""
    out, at = F.lit(0).cast("bigint"), 16 - bits
    while at > -bits:
        out = out.bitwiseOR(F.shiftleft(v.cast("bigint"), at) if at >= 0 else F.shiftright(v.cast("bigint"), -at))
        at -= bits
    return out


def half_value(bits: Column) -> Column:
    """The number that a half-precision pattern stands for; denormal ones read as 0."""
    e, m = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
    sign = F.when(bits.bitwiseAND(F.lit(32768)) != 0, -1.0).otherwise(1.0)
    value = sign * (1.0 + m / 1024.0) * F.pow(F.lit(2.0), e.cast("double")) / 32768.0
    return F.when(e == 0, 0.0).when(e < 31, value).when(m == 0, sign * float("inf")).otherwise(float("nan"))


def linear_to_16(value: Column, alpha: bool = False) -> Column:
    """Linear light as a 16-bit sRGB sample; alpha stays linear; no number and below 0 is 0."""
    shown = value if alpha else color.linear_to_srgb(value)
    inner = F.least(F.floor(shown * 65535 + 0.5), F.lit(65535))
    return F.when(F.isnan(value) | (value <= 0), F.lit(0)).when(value >= 1, F.lit(65535)).otherwise(inner).cast("bigint")


def fixed_value(v: Column, bits: int) -> Column:
    """Signed fixed-point samples of wide-range pictures: 13 fraction bits of 16, 24 of 32."""
    return v / (8192.0 if bits == 16 else 16777216.0)


#: Fixed values of ITU-T H.273, table 2: x and y of red, green, blue and white.
PRIMARIES = {
    1: (0.64, 0.33, 0.30, 0.60, 0.15, 0.06, 0.3127, 0.3290),
    4: (0.67, 0.33, 0.21, 0.71, 0.14, 0.08, 0.310, 0.316),
    5: (0.64, 0.33, 0.29, 0.60, 0.15, 0.06, 0.3127, 0.3290),
    6: (0.630, 0.340, 0.310, 0.595, 0.155, 0.070, 0.3127, 0.3290),
    7: (0.630, 0.340, 0.310, 0.595, 0.155, 0.070, 0.3127, 0.3290),
    8: (0.681, 0.319, 0.243, 0.692, 0.145, 0.049, 0.310, 0.316),
    9: (0.708, 0.292, 0.170, 0.797, 0.131, 0.046, 0.3127, 0.3290),
    11: (0.680, 0.320, 0.265, 0.690, 0.150, 0.060, 0.314, 0.351),
    12: (0.680, 0.320, 0.265, 0.690, 0.150, 0.060, 0.3127, 0.3290),
    22: (0.630, 0.340, 0.295, 0.605, 0.155, 0.077, 0.3127, 0.3290),
}
#: Transfer code points that a display reads with a plain power (1 is linear).
GAMMAS = {1: 2.4, 4: 2.2, 5: 2.8, 6: 2.4, 7: 2.4, 8: 1.0, 11: 2.4, 12: 2.4, 14: 2.4, 15: 2.4}


def transfer(code: int, v: Column) -> Column:
    """Light of a coded value of 0 to 1: relative, in nits for code 16, of the scene for 18; null for codes not read."""
    if code in GAMMAS:
        return F.pow(v, F.lit(GAMMAS[code]))
    known = {13: color.srgb_to_linear, 16: color.pq_to_nits, 18: color.hlg_to_scene}
    return known[code](v) if code in known else F.lit(None).cast("double")


def box_orientation(quarter_turns, mirror_axis) -> Column:
    """EXIF orientation of a picture turned so many quarters anticlockwise and then mirrored (null: not; 0: top for bottom)."""
    mirrored = mirror_axis.isNotNull()
    turns = F.pmod(-F.coalesce(quarter_turns, F.lit(0)) + F.when(mirror_axis == 0, 2).otherwise(0), F.lit(4))
    plain, flipped = F.array(*map(F.lit, (1, 6, 3, 8))), F.array(*map(F.lit, (2, 5, 4, 7)))
    at = (turns + 1).cast("int")
    return F.when(mirrored, F.element_at(flipped, at)).otherwise(F.element_at(plain, at)).cast("bigint")


def clean_aperture(width, height, side_x, side_y, offset_x, offset_y) -> Column:
    """Crop box (x, y, w, h) of a clean aperture; sides and offsets of the centre are fractions (numerator, denominator).

    Null where it names no box of whole samples inside the picture, or the whole picture.
    """
    (wn, wd), (hn, hd), (xn, xd), (yn, yd) = side_x, side_y, offset_x, offset_y
    good = (wd > 0) & (hd > 0) & (xd > 0) & (yd > 0) & (wn >= 0) & (hn >= 0)
    wd, hd, xd, yd = (F.when(good, d) for d in (wd, hd, xd, yd))
    w, h = pm.div(wn, wd), pm.div(hn, hd)
    left2, top2 = (width - w) * xd + 2 * xn, (height - h) * yd + 2 * yn
    left, top = pm.div(left2, 2 * xd), pm.div(top2, 2 * yd)
    whole = (wn % wd == 0) & (hn % hd == 0) & (left2 % (2 * xd) == 0) & (top2 % (2 * yd) == 0)
    inside = (w > 0) & (h > 0) & (left >= 0) & (top >= 0) & (left + w <= width) & (top + h <= height)
    part = (left != 0) | (top != 0) | (w != width) | (h != height)
    return F.when(good & whole & inside & part, F.struct(left.alias("x"), top.alias("y"), w.alias("w"), h.alias("h")))


def gain_map_covers(width, height, map_width, map_height) -> Column:
    """Whether a gain map has the picture's aspect, within a sample."""
    return F.abs(map_width * height - map_height * width) <= width + height


def samples_fit(width, height, channels, most: int = 1 << 30) -> Column:
    """The ceiling of samples of one picture, checked before any is made."""
    return width * height * channels <= most
