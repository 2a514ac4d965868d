import numpy as np
import pytest

from tessera.codec import jpeg, quality


def scene(width=96, height=64):
    y, x = np.mgrid[0:height, 0:width]
    rng = np.random.default_rng(1)
    base = 120 + 60 * np.sin(x / 9) + 40 * np.cos(y / 7)
    rgb = np.stack([base, base[::-1], 255 - base], -1) + rng.normal(0, 6, (height, width, 3))
    return np.concatenate([np.clip(rgb, 0, 255), np.full((height, width, 1), 255)], -1).astype(np.uint8)


def recursive(n, impulse, size):
    """The blur as three second-order recursions over a row, for comparison with the kernel."""
    kernel = quality.blur_kernel()
    turns = np.array([1, 3, 5]) * np.pi / (2 * n)
    waves = np.cos(turns[:, None] * np.arange(-n, n + 1))
    beta = np.linalg.lstsq(waves.T, kernel, rcond=None)[0]
    x = np.zeros(size + 4 * n)
    x[2 * n + impulse] = 1
    out = np.zeros(size)
    for b, w in zip(beta, turns):
        y = np.zeros(len(x))
        for i in range(n + 1, len(x) - n + 1):
            y[i] = -b * np.cos(w * (n + 1)) * (x[i - n - 1] + (x[i + n - 1] if i + n - 1 < len(x) else 0)) + 2 * np.cos(w) * y[i - 1] - y[i - 2]
        out += y[2 * n : 2 * n + size]
    return out


def test_kernel():
    k = quality.blur_kernel()
    n = len(k) // 2
    assert n == 5 and abs(k.sum() - 1) < 1e-12 and abs((k * np.arange(-n, n + 1) ** 2).sum() - 2.25) < 1e-9
    assert abs(k[0]) < 1e-12 and np.allclose(k, k[::-1])
    assert np.allclose(recursive(n, 20, 41)[20 - n : 20 + n + 1], k, atol=1e-9)
    assert len(quality.WEIGHTS) == 108


def test_identity_and_order():
    image = scene()
    assert quality.ssimulacra2(image, image) == 100
    scores = [quality.ssimulacra2(image, jpeg.decode(jpeg.encode(image, q))) for q in (10, 40, 75, 95, 100)]
    assert scores == sorted(scores) and scores[-1] > 90 and scores[0] < 40
    assert quality.ssimulacra2(image[:7], image[:7] // 2) == 100  # too small to be scored


def test_alpha_takes_the_worse_background():
    image = scene()
    image[:20, :20, 3] = 0
    other = image.copy()
    other[:20, :20, 3] = 255
    both = [quality._score(image, other, b) for b in (0.1, 0.9)]
    assert quality.ssimulacra2(image, other) == min(both) < 90
    with pytest.raises(ValueError):
        quality.ssimulacra2(image, image[1:])


def test_many_scores_are_those_of_each_alone():
    """Pairs of one size in one call: the same bits, in far fewer array operations."""
    rng, pairs = np.random.default_rng(4), []
    for _ in range(40):
        image = rng.integers(0, 256, (17, 23, 4)).astype(np.uint8)
        if len(pairs) % 3:
            image[..., 3] = 255
        pairs.append((image, np.clip(image + rng.normal(0, len(pairs), image.shape), 0, 255).astype(np.uint8)))
    a, b = (np.stack(p) for p in zip(*pairs))
    many = quality.ssimulacra2_many(a, b)
    assert many == [quality.ssimulacra2(*p) for p in pairs] and len(set(many)) == 40


def test_scores_of_mixed_sizes_and_damage(spark):
    from tessera.codec import bmp, png
    from tessera.sources import images

    rows, want = [], {}
    for i in range(60):
        image = scene(9 + i % 3 * 40, 8 + i % 2 * 9)
        other = image if i % 7 == 0 else jpeg.decode(jpeg.encode(image, 30 + i))
        rows.append((i, png.encode(image), bmp.encode(other[:-1] if i % 11 == 3 else other) if i % 13 != 5 else None if i % 2 else b"BM"))
        want[i] = None if i % 11 == 3 or i % 13 == 5 else quality.ssimulacra2(image, other)
    frame = spark.createDataFrame(rows, "i int, a binary, b binary")
    assert {r.i: r.score for r in images.quality_scores(frame, "a", "b").collect()} == want


def test_tiles_are_gathered_once_and_not_joined(spark, sf_dir):
    from tessera.plans import catalog

    for name in ("q01_score_of_lossless", "q01_score_of_jpeg"):
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1
