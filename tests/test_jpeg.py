import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.codec import Malformed, jpeg, probe


def scene(width, height):
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([x * 3 % 256, y * 4 % 256, (x + y) * 2 % 256, np.full_like(x, 255)], -1).astype(np.uint8)


def test_zigzag_is_the_standard_walk():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))


def test_inverse_transform_is_near_the_real_one():
    rng = np.random.default_rng(1)
    blocks = rng.integers(-60, 60, (50, 64))
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    want = np.clip(basis.T @ blocks.reshape(-1, 8, 8) @ basis + 128, 0, 255)
    assert np.abs(jpeg.inverse(blocks).astype(float) - want).max() <= 1.01


@pytest.mark.parametrize("size", [(1, 1), (8, 8), (16, 16), (17, 33), (61, 40)])
@pytest.mark.parametrize("quality", [40, 90, 95])
def test_round_trip(size, quality):
    image = np.clip(scene(*size).astype(int) // 2 + 40, 0, 255).astype(np.uint8)
    image[..., 3] = 255
    data = jpeg.encode(image, quality)
    got = jpeg.decode(data)
    assert got.shape == image.shape and np.abs(got.astype(int) - image).mean() < (14 if quality < 90 else 7)
    info = probe.probe(data)
    assert (info["width"], info["height"], info["color_channels"], info["is_decodable"]) == (*size, 3, True)


def test_second_decoder_agrees(spark, tmp_path, monkeypatch):
    image = scene(48, 32)
    for q in (60, 95):
        (tmp_path / f"{q}.jpg").write_bytes(jpeg.encode(image, q))
    wide = _plain(image, 70, monkeypatch)
    (tmp_path / "70.jpg").write_bytes(jpeg.repack(wide, progressive=True))
    rows = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    assert len(rows) == 3
    for r in rows:
        other = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, 3)[..., ::-1].astype(int)
        q = int(r.origin.rpartition("/")[2][:2])
        own = jpeg.decode((tmp_path / f"{q}.jpg").read_bytes())[..., :3].astype(int)
        assert np.abs(own - other).mean() < (3 if q < 95 else 1.5)


def _plain(image, quality, monkeypatch):
    """A file with codes of eight bits for every symbol, which leaves room to repack."""

    def flat(counts):
        symbols = sorted({*counts, *range(0, 250, 5)})
        return [0, 0, 0, 0, 0, 0, 0, len(symbols)] + [0] * 8, symbols

    monkeypatch.setattr(jpeg, "_code_lengths", flat)
    data = jpeg.encode(image, quality)
    monkeypatch.undo()
    return data


def test_repacked_files_are_smaller_and_equal(monkeypatch):
    for quality in (60, 95):
        data = _plain(scene(50, 37), quality, monkeypatch)
        small = jpeg.repack(data)
        assert len(small) < len(data) and (jpeg.decode(small) == jpeg.decode(data)).all()
        assert jpeg.repack(small) == small
        spread = jpeg.repack(data, progressive=True)
        assert b"\xff\xc2" in spread and (jpeg.decode(spread) == jpeg.decode(data)).all()
        again = jpeg.repack(spread)
        assert (jpeg.decode(again) == jpeg.decode(data)).all()
    assert jpeg.repack(b"junk") == b"junk"


def test_damage():
    data = jpeg.encode(scene(20, 20), 80)
    with pytest.raises(Malformed):
        jpeg.decode(data[:30])
    assert F is not None
