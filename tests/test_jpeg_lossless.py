import numpy as np
import pytest

from tessera.codec import Malformed, jpeg, jpeg_lossless, probe, scale


@pytest.mark.parametrize("predictor", range(1, 8))
@pytest.mark.parametrize("depth", [2, 8, 12, 16])
def test_samples_come_back(predictor, depth):
    rng = np.random.default_rng(predictor)
    for shape in ((1, 1, 1), (5, 7, 3), (9, 4, 1)):
        samples = rng.integers(0, 1 << depth, shape)
        for rows in (0, 2):
            got, bits, adobe, _ = jpeg_lossless.planes(jpeg_lossless.encode(samples, depth, predictor, rows))
            assert bits == depth and adobe == -1
            assert (np.stack(got, -1) == samples).all()


def test_pixels_probe_and_damage():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (6, 5, 3))
    raw = jpeg_lossless.encode(rgb)
    got = probe.decode(raw)
    assert (got[..., :3] == rgb).all() and (got[..., 3] == 255).all()
    info = probe.probe(raw)
    assert (info["width"], info["height"], info["bit_depth"], info["is_decodable"]) == (5, 6, 8, True)
    deep = rng.integers(0, 1 << 12, (4, 4, 1))
    assert (probe.decode(jpeg_lossless.encode(deep, 12))[..., :1] == deep >> 4).all()
    with pytest.raises(Malformed):
        probe.decode(raw[:30])


@pytest.mark.parametrize("reduction", [2, 4, 8])
def test_reduced_transform_is_near_block_averages(reduction):
    y, x = np.mgrid[:45, :61]
    image = np.full((45, 61, 4), 255, np.uint8)
    image[..., :3] = np.clip(128 + 100 * np.sin(x / 9)[..., None] * np.cos(y / 7)[..., None], 0, 255)
    raw = jpeg.encode(image, 95)
    got, want = jpeg.decode(raw, reduction), scale.reduced(jpeg.decode(raw), reduction)
    assert got.shape == want.shape
    inner = np.abs(got[:-1, :-1].astype(int) - want[:-1, :-1])
    assert inner.mean() < 0.6 and inner.max() <= 3
