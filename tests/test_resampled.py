import numpy as np
import pytest

from tessera.operators import derived


def bilinear(image, to_width, to_height):
    """Four corners of every target pixel, in whole numbers."""
    out, (height, width) = {}, image.shape[:2]

    def corners(t, source, target):
        at = min(max((2 * t + 1) * source - target, 0), 2 * target * (source - 1))
        first, share = divmod(at, 2 * target)
        return (first, 2 * target - share), (min(first + 1, source - 1), share)

    for y in range(to_height):
        for x in range(to_width):
            total = sum(image[j, i].astype(int) * w * v for i, w in corners(x, width, to_width) for j, v in corners(y, height, to_height))
            out[x, y] = tuple(int(v) for v in (total + 2 * to_width * to_height) // (4 * to_width * to_height))
    return out


def rows(spark, image, img_id=1, without=()):
    height, width = image.shape[:2]
    cells = [(img_id, x, y, *(int(v) for v in image[y, x])) for y in range(height) for x in range(width) if (x, y) not in without]
    return spark.createDataFrame(cells, "img_id bigint, x bigint, y bigint, a bigint, r bigint, g bigint, b bigint")


@pytest.mark.parametrize("sizes", [(8, 8, 16, 16), (5, 3, 7, 11), (7, 9, 3, 2), (1, 1, 4, 3), (2, 6, 2, 1), (33, 1, 4, 1)])
def test_any_sizes(spark, sizes):
    width, height, to_width, to_height = sizes
    image = np.random.default_rng(3).integers(0, 256, (height, width, 4))
    got = derived.resampled(rows(spark, image), *sizes).collect()
    assert {(r.x, r.y): (r.a, r.r, r.g, r.b) for r in got} == bilinear(image, to_width, to_height) and len(got) == to_width * to_height


def test_pixels_without_all_corners_are_left_out(spark):
    image = np.full((8, 8, 4), 200)
    got = derived.resampled(rows(spark, image, without={(7, 7)}), 8, 8, 16, 16).collect()
    lost = {(x, y) for x in (13, 14, 15) for y in (13, 14, 15)}
    assert {(r.x, r.y) for r in got} == {(x, y) for x in range(16) for y in range(16)} - lost
    assert {r.r for r in got} == {200}


def test_nothing_is_joined_or_broadcast(spark):
    plan = derived.resampled(rows(spark, np.zeros((8, 8, 4), int)), 8, 8, 16, 16)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
