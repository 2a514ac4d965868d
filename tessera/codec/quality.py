"""SSIMULACRA 2: a perceptual score of a distorted image against its reference; 100 means identical.

Both images go to linear light and a perceptual opponent space. At up to six
scales, halved in linear light, local means and variances under a blur of
sigma 1.5 give a structural error map and two edge maps; their 1- and 4-norms
are weighed and mapped to the score. The blur is a sum of three cosines over a
finite window, so it is a plain convolution here; its amplitudes are the ones
nearest to a Gaussian's that keep the sum and the variance.
"""

from __future__ import annotations

import numpy as np

SIGMA, SCALES, C2 = 1.5, 6, 0.0009

# Opponent space, offsets, weights of the 108 norms (channel, scale, norm, map), and the final curve.
ABSORBANCE = np.array([
    [0.30, 1 - 0.078 - 0.30, 0.078],
    [0.23, 1 - 0.078 - 0.23, 0.078],
    [0.24342268924547819, 0.20476744424496821, 1 - 0.24342268924547819 - 0.20476744424496821],
])
BIAS = 0.0037930732552754493
WEIGHTS = [
    0.0, 0.0007376606707406586, 0.0, 0.0, 0.0007793481682867309, 0.0, 0.0, 0.0004371155730107379, 0.0,
    1.1041726426657346, 0.00066284834129271, 0.00015231632783718752, 0.0, 0.0016406437456599754, 0.0,
    1.8422455520539298, 11.441172603757666, 0.0, 0.0007989109436015163, 0.000176816438078653, 0.0,
    1.8787594979546387, 10.94906990605142, 0.0, 0.0007289346991508072, 0.9677937080626833, 0.0,
    0.00014003424285435884, 0.9981766977854967, 0.00031949755934435053, 0.0004550992113792063, 0.0, 0.0,
    0.0013648766163243398, 0.0, 0.0, 0.0, 0.0, 0.0, 7.466890328078848, 0.0, 17.445833984131262,
    0.0006235601634041466, 0.0, 0.0, 6.683678146179332, 0.00037724407979611296, 1.027889937768264,
    225.20515300849274, 0.0, 0.0, 19.213238186143016, 0.0011401524586618361, 0.001237755635509985,
    176.39317598450694, 0.0, 0.0, 24.43300999870476, 0.28520802612117757, 0.0004485436923833408, 0.0, 0.0,
    0.0, 34.77906344483772, 44.835625328877896, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
    0.0008680556573291698, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0005313191874358747, 0.0, 0.00016533814161379112,
    0.0, 0.0, 0.0, 0.0, 0.0, 0.0004179171803251336, 0.0017290828234722833, 0.0, 0.0020827005846636437,
    0.0, 0.0, 8.826982764996862, 23.19243343998926, 0.0, 95.1080498811086, 0.9863978034400682,
    0.9834382792465353, 0.0012286405048278493, 171.2667255897307, 0.9807858872435379, 0.0, 0.0, 0.0,
    0.0005130064588990679, 0.0, 0.00010854057858411537,
]
CURVE = (0.9562382616834844, 2.326765642916932, -0.020884521182843837, 6.248496625763138e-05, 0.6276336467831387)


def blur_kernel(sigma: float = SIGMA) -> np.ndarray:
    """Weights at offsets -N to N."""
    n = round(3.2795 * sigma + 0.2546)
    k, turns = np.arange(-n, n + 1), np.array([1, 3, 5]) * np.pi / (2 * n)
    waves = np.cos(turns[:, None] * k)
    near = np.exp(-0.5 * sigma**2 * turns**2) / n
    held = np.stack([waves.sum(1), ((n * n - k * k) * waves).sum(1)])
    lack = np.array([1.0, n * n - sigma**2]) - held @ near
    return (near + held.T @ np.linalg.solve(held @ held.T, lack)) @ waves


def _blur(plane: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Over the last two axes."""
    n = len(kernel) // 2
    for axis in (-2, -1):
        size = plane.shape[axis]
        wide = np.zeros([k + 2 * n * (i == plane.ndim + axis) for i, k in enumerate(plane.shape)])
        at = lambda i: (..., slice(i, i + size), slice(None)) if axis == -2 else (..., slice(i, i + size))  # noqa: B023, E731
        wide[at(n)] = plane
        plane = sum(w * wide[at(i)] for i, w in enumerate(kernel))
    return plane


def _linear(image: np.ndarray, background: float) -> np.ndarray:
    alpha = image[..., 3:] / 255.0
    v = alpha * (image[..., :3] / 255.0) + (1 - alpha) * background
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def _opponent(rgb: np.ndarray) -> np.ndarray:
    long, middle, short = np.moveaxis(np.cbrt(np.maximum(rgb @ ABSORBANCE.T + BIAS, 0)) - np.cbrt(BIAS), -1, 0)
    x, y = 0.5 * (long - middle), 0.5 * (long + middle)
    return np.stack([x * 14 + 0.42, y + 0.01, short - y + 0.55])


def _halved(rgb: np.ndarray) -> np.ndarray:
    *many, height, width, _ = rgb.shape
    rgb = np.pad(rgb, [(0, 0)] * len(many) + [(0, height % 2), (0, width % 2), (0, 0)], mode="edge")
    return (rgb[..., ::2, ::2, :] + rgb[..., ::2, 1::2, :] + rgb[..., 1::2, ::2, :] + rgb[..., 1::2, 1::2, :]) * 0.25


def _norms(a: np.ndarray, b: np.ndarray, kernel: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Means and means of fourth powers of the structural, artifact and lost-detail maps of planes (..., height, width)."""
    ma, mb = _blur(a, kernel), _blur(b, kernel)
    va, vb, both = (_blur(p, kernel) - m for p, m in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
    error = np.maximum(1 - (1 - (ma - mb) ** 2) * (2 * both + C2) / (va + vb + C2), 0)
    edge = (1 + np.abs(b - mb)) / (1 + np.abs(a - ma)) - 1
    maps = (error, np.maximum(edge, 0), np.maximum(-edge, 0))
    flat = [m.reshape(*m.shape[:-2], -1) for m in maps]
    return [(m.mean(-1), (m**4).mean(-1)) for m in flat]


def _scores(references: np.ndarray, distorted: np.ndarray, background: float) -> list[float]:
    """Scores of images of one size; every figure is that of the image alone."""
    a, b, kernel, found = _linear(references, background), _linear(distorted, background), blur_kernel(), []
    for scale in range(SCALES):
        if min(a.shape[1:3]) < 8:
            break
        found.append(_norms(_opponent(a), _opponent(b), kernel))
        if scale + 1 < SCALES:
            a, b = _halved(a), _halved(b)
    out = []
    for i in range(len(references)):
        values = [abs(float(s[m][n][c, i]) ** (0.25 if n else 1)) for c in range(3) for s in found for n in range(2) for m in range(3)]
        total = CURVE[0] * sum(w * v for w, v in zip(WEIGHTS, values))
        total = CURVE[1] * total + CURVE[2] * total**2 + CURVE[3] * total**3
        out.append(100.0 - 10.0 * total ** CURVE[4] if total > 0 else 100.0)
    return out


def _score(reference: np.ndarray, distorted: np.ndarray, background: float) -> float:
    return _scores(reference[None], distorted[None], background)[0]


def ssimulacra2_many(references: np.ndarray, distorted: np.ndarray) -> list[float]:
    """Scores of pairs (n, height, width, 4); a reference with alpha counts on the worse of two grays."""
    out, opaque = np.zeros(len(references)), (references[..., 3] == 255).all((1, 2))
    if opaque.any():
        out[opaque] = _scores(references[opaque], distorted[opaque], 0.5)
    if not opaque.all():
        a, b = references[~opaque], distorted[~opaque]
        out[~opaque] = np.minimum(_scores(a, b, 0.1), _scores(a, b, 0.9))
    return out.tolist()


def ssimulacra2(reference: np.ndarray, distorted: np.ndarray) -> float:
    """Score of two r, g, b, a images of one size."""
    if reference.shape != distorted.shape:
        raise ValueError(f"sizes {reference.shape[1::-1]} and {distorted.shape[1::-1]} differ")
    return ssimulacra2_many(reference[None], distorted[None])[0]
