import itertools
import random

import numpy as np
import pytest

from tessera.codec import Malformed, fax, tiff


def test_codes_are_free_of_prefixes():
    for codes in (*fax.RUN_CODES, fax.MODES):
        for a, b in itertools.permutations(codes, 2):
            assert not b.startswith(a)
    assert [len(c) for c in fax.RUN_CODES] == [104, 104]


def images():
    rng, rnd = np.random.default_rng(1), random.Random(1)
    for columns, rows in ((1, 1), (8, 3), (37, 20), (64, 5), (3000, 4)):
        for share in (0.0, 0.03, 0.5, 1.0):
            yield (rng.random((rows, columns)) < share).astype(np.uint8)
        smooth = np.zeros((rows, columns), np.uint8)
        for y in range(rows):
            a = rnd.randint(0, columns)
            smooth[y, a : a + rnd.randint(0, columns)] = 1
        yield smooth


@pytest.mark.parametrize("k", [-1, 0])
def test_round_trip(k):
    for image in images():
        raw = fax.encode(image, k)
        assert (fax.decode(raw, k, image.shape[1], len(image), byte_align=k == 0) == image).all()
        if k < 0:
            assert (fax.decode(raw, k, image.shape[1]) == image).all()


def test_mixed_rows():
    image = next(i for i in images() if i.shape == (20, 37))
    # an end of line with its tag before every row: all one-dimensional
    rows = "".join("0" * 11 + "1" + "1" + "".join(f"{b:08b}" for b in fax.encode(line[None], 0)) for line in image)
    bits = "".join("0" * 11 + "11" + "".join(fax._run_bits(b - a, i & 1) for i, (a, b) in enumerate(zip([0, *c], [*c, 37]))) for c in map(fax._changes, image))
    assert (fax.decode(fax._packed(bits), 1, 37, 20) == image).all() and rows


def test_damage_and_limits():
    image = next(i for i in images() if i.shape == (20, 37) and i.any())
    raw = fax.encode(image, 0)
    with pytest.raises(Malformed):
        fax.decode(raw[: len(raw) // 2], 0, 37, 20, byte_align=True)
    assert len(fax.decode(fax.encode(image)[:10], -1, 37, 20)) < 20
    with pytest.raises(Malformed):
        fax.decode(raw, -1, 0, 1)


@pytest.mark.parametrize("method", [2, 4])
def test_tiff(method):
    for image in images():
        rgba = np.full((*image.shape, 4), 255, np.uint8)
        rgba[..., :3] = (255 * (1 - image))[..., None]
        assert (tiff.decode(tiff.encode_bilevel(rgba, method)) == rgba).all()
