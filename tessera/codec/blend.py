"""Compositing on arrays, with the integer rules of `functions.pixel_math`."""

from __future__ import annotations

import numpy as np


def source_over(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    s, d = src.astype(np.int64), dst.astype(np.int64)
    sa, da = s[..., 3:], d[..., 3:]
    keep = da * (255 - sa)
    total = sa * 255 + keep
    mixed = (s[..., :3] * sa * 255 + d[..., :3] * keep + total // 2) // np.maximum(total, 1)
    out = np.concatenate([mixed, (total + 127) // 255], -1)
    out = np.where(sa == 0, d, np.where((sa == 255) | (da == 0), s, out))
    return out.astype(np.uint8)
