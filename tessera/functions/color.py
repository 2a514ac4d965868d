"""Colour transfer curves as double Column expressions, and ICC header fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of ITU-R BT.2100 and IEC 61966-2-1.
PQ_M1, PQ_M2 = 2610 / 16384, 2523 / 32
PQ_C1, PQ_C2, PQ_C3 = 3424 / 4096, 2413 / 128, 2392 / 128
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073
#: Nits of diffuse white, and of the peak when a file states none.
WHITE_NITS, DEFAULT_PEAK = 203.0, 1000.0


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def pq_to_nits(v: Column) -> Column:
    p = F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / PQ_M2))
    return 10000.0 * F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / (PQ_C2 - PQ_C3 * p), F.lit(1 / PQ_M1))


def nits_to_pq(nits: Column) -> Column:
    y = F.pow(F.greatest(nits, F.lit(0.0)) / 10000.0, F.lit(PQ_M1))
    return F.pow((PQ_C1 + PQ_C2 * y) / (1.0 + PQ_C3 * y), F.lit(PQ_M2))


def hlg_to_scene(v: Column) -> Column:
    return F.when(v <= 0.5, v * v / 3.0).otherwise((F.exp((v - HLG_C) / HLG_A) + HLG_B) / 12.0)


def gamma_valid(gamma: Column) -> Column:
    """A gAMA value (times 100,000) that is within the range taken seriously."""
    return gamma.between(10_000, 1_000_000)


def hdr_peak(content_light: Column, mastering: Column) -> Column:
    """Peak luminance to map from: content light level, else the mastering display, else the default."""
    return F.coalesce(F.when(content_light > 0, content_light), F.when(mastering > 0, mastering), F.lit(DEFAULT_PEAK))


def narrow_to_full(v: Column, bits: int = 8) -> Column:
    """Narrow-range code values as 0 to 1; values beyond stay beyond."""
    return (v - 16.0) / 219.0 if bits == 8 else (v - 4096.0) / 56064.0


def icc_color_space(icc: Column) -> Column:
    """The four signs at byte 16 of an ICC header, without trailing spaces; null when it is too short."""
    return F.when(F.length(icc) >= 128, F.rtrim(F.substring(icc, 17, 4).cast("string")))
