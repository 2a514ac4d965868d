import struct

import numpy as np

from tessera.codec import icc


def gamma(value):
    return b"curv\0\0\0\0" + struct.pack(">IH", 1, int(value * 256))


def xyz(column):
    return b"XYZ \0\0\0\0" + struct.pack(">3i", *(round(v * 65536) for v in column))


def picture():
    image = np.random.default_rng(1).integers(0, 256, (9, 8, 4), np.uint8)
    return image


def profile(matrix, curve):
    return icc.build("RGB", {**{c + "XYZ": xyz(matrix[:, i]) for i, c in enumerate("rgb")}, **{c + "TRC": curve for c in "rgb"}})


def test_srgb_itself_changes_nothing():
    para = b"para\0\0\0\0" + struct.pack(">HH5i", 3, 0, *(round(v * 65536) for v in (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)))
    image = picture()
    assert icc.to_srgb(image, profile(icc.SRGB_D50, para)) is image


def test_gamma_and_swapped_primaries():
    image = picture()
    got = icc.to_srgb(image, profile(icc.SRGB_D50[:, [1, 0, 2]], gamma(1.8)))
    light = (image[..., [1, 0, 2]] / 255) ** 1.8
    want = np.rint(icc.encode_srgb(light) * 255)
    assert np.abs(got[..., :3] - want).max() <= 1 and (got[..., 3] == image[..., 3]).all()


def test_gray_tables_and_mismatch():
    image = picture()
    table = b"curv\0\0\0\0" + struct.pack(">I3H", 3, 0, 16384, 65535)
    gray = icc.build("GRAY", {"kTRC": table})
    assert icc.to_srgb(image, gray) is image  # a gray profile on a colour image
    flat = image.copy()
    flat[..., 1] = flat[..., 2] = flat[..., 0]
    want = np.rint(icc.encode_srgb(np.interp(flat[..., 0] / 255, [0, 0.5, 1], [0, 0.25, 1])) * 255)
    assert np.abs(icc.to_srgb(flat, gray)[..., 0] - want).max() <= 1


def test_text_and_damage():
    named = icc.build("RGB", {"desc": b"mluc\0\0\0\0" + struct.pack(">II4sII", 1, 12, b"enUS", 8, 28) + "Wide".encode("utf-16-be")})
    assert icc.description(named) == "Wide" and icc.color_space(named) == "RGB"
    image = picture()
    for raw in (b"", b"short", bytes(200), named, profile(np.zeros((3, 3)), b"para\0\0\0\0\0\x09\0\0")):
        assert icc.to_srgb(image, raw) is image
