"""Turns, crops and exact area averages on arrays: the array form of the relational operators."""

from __future__ import annotations

import numpy as np


def fitted(width: int, height: int, max_width: int, max_height: int) -> tuple[int, int]:
    """Sides of an image scaled down into a box; its own sides when it fits."""
    if width <= max_width and height <= max_height:
        return width, height
    if max_width * height <= max_height * width:
        return max_width, max(1, height * max_width // width)
    return max(1, width * max_height // height), max_height


def oriented(image: np.ndarray, orientation: int) -> np.ndarray:
    """The image turned upright by its EXIF value; values out of range change nothing."""
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return image


def _overlaps(source: int, target: int) -> np.ndarray:
    """Weights (target, source): overlap of each source position with each bin, in units of 1 / (source * target)."""
    low, high = np.arange(source) * target, (np.arange(source) + 1) * target
    start = np.arange(target)[:, None] * source
    return np.maximum(0, np.minimum(high, start + source) - np.maximum(low, start)).astype(np.int64)


def _by_alpha(weighted: np.ndarray, alpha: np.ndarray, n) -> np.ndarray:
    safe = np.maximum(alpha, 1)[..., None]
    rgb = np.where(alpha[..., None] > 0, (weighted + safe // 2) // safe, 0)
    return np.concatenate([rgb, ((alpha + n // 2) // n)[..., None]], -1).astype(np.uint8)


def downscaled(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Exact area average, colour weighed by alpha; as two matrix products."""
    if not (1 <= width <= image.shape[1] and 1 <= height <= image.shape[0]):
        raise ValueError(f"target {width}x{height} is outside {image.shape[1]}x{image.shape[0]}")
    if image.shape[1::-1] == (width, height):
        return image
    v = image.astype(np.int64)
    v[..., :3] *= v[..., 3:]
    rows, columns = _overlaps(image.shape[0], height), _overlaps(image.shape[1], width)
    sums = np.einsum("yYc,xY->yxc", np.tensordot(rows, v, (1, 0)), columns, optimize=True)
    return _by_alpha(sums[..., :3], sums[..., 3], image.shape[0] * image.shape[1])


def reduced(image: np.ndarray, r: int) -> np.ndarray:
    """Averages of r x r blocks; edge blocks use the pixels they have."""
    if r not in (1, 2, 4, 8):
        raise ValueError(f"reduction {r}")
    if r == 1:
        return image
    v = image.astype(np.int64)
    v[..., :3] *= v[..., 3:]
    ys, xs = np.arange(0, image.shape[0], r), np.arange(0, image.shape[1], r)
    sums = np.add.reduceat(np.add.reduceat(v, ys, 0), xs, 1)
    n = np.diff([*ys, image.shape[0]])[:, None] * np.diff([*xs, image.shape[1]])[None]
    return _by_alpha(sums[..., :3], sums[..., 3], n)


def scaled(image: np.ndarray, max_width: int, max_height: int) -> np.ndarray:
    return downscaled(image, *fitted(image.shape[1], image.shape[0], max_width, max_height))
