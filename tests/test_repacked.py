import numpy as np

from tessera.codec import jpeg, png
from tessera.plans import catalog
from tessera.sources import images


def test_repacking_is_compared_within_the_task(spark, sf_dir):
    plan = catalog.queries()["e11_repack_keeps_pixels"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_differing_pixels(spark):
    image = np.random.default_rng(2).integers(0, 256, (6, 5, 4)).astype(np.uint8)
    other, clear = image.copy(), image.copy()
    other[0, 0, 1] ^= 1
    other[5, 4, 2] ^= 1
    clear[..., 3] = 255  # alpha does not count
    files = [image, other, clear, image[:4, :3]]
    a, b, c, d = (png.encode(i) for i in files)
    rows = [(0, a, a), (1, a, b), (2, a, c), (3, a, d), (4, d, a), (5, a, b"BM"), (6, None, a), (7, b"BM", None), (8, d, png.encode(image[:3, :4]))]
    got = images.differing_pixels(spark.createDataFrame(rows, "img_id int, p binary, q binary"), "p", "q").collect()
    assert {r.img_id: r.different for r in got} == {0: 0, 1: 2, 2: 0, 3: 18, 4: 18, 5: 30, 6: 30, 8: 6}


def test_components_are_transformed_together(monkeypatch):
    image, calls, whole = np.random.default_rng(5).integers(0, 256, (40, 24, 4)).astype(np.uint8), [], jpeg.inverse
    monkeypatch.setattr(jpeg, "inverse", lambda blocks: calls.append(len(blocks)) or whole(blocks))
    data = jpeg.encode(image, 80)
    together = jpeg.decode(data)
    assert len(calls) == 1
    monkeypatch.setattr(jpeg, "TOGETHER", 1)
    assert (jpeg.decode(data) == together).all() and len(calls) == 4
