import struct

import numpy as np
import pytest

from tessera.codec import Malformed, Unsupported, probe, webp


def picture(width, height, seed=1, levels=256):
    image = (np.random.default_rng(seed).integers(0, levels, (height, width, 4)) * (256 // levels)).astype(np.uint8)
    return image


@pytest.mark.parametrize("size", [(1, 1), (3, 5), (16, 16), (33, 20)])
@pytest.mark.parametrize("levels", [1, 2, 7, 256])
def test_round_trip(size, levels):
    image = picture(*size, levels=levels)
    data = webp.encode(image)
    assert (webp.decode(data) == image).all()
    info = probe.probe(data)
    assert (info["width"], info["height"], info["is_decodable"]) == (*size, True)


def _stream(width, height, write):
    w = webp._Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    write(w)
    w.put(0, 8 - w.n if w.n else 0)
    return bytes(w.out)


def _image(w, planes, main):
    """An entropy-coded image of literal a, r, g, b planes."""
    w.put(0, 1)
    if main:
        w.put(0, 1)
    a, r, g, b = planes
    codes = [webp._write_prefix(w, np.bincount(p, minlength=280 if i == 0 else 256)) for i, p in enumerate((g, r, b, a))]
    webp._write_prefix(w, np.zeros(40, int))
    for values in zip(g.tolist(), r.tolist(), b.tolist(), a.tolist()):
        for table, v in zip(codes, values):
            w.code(*table[v])


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    image = picture(9, 6, seed=mode)
    argb = image[..., [3, 0, 1, 2]].astype(int).tolist()
    residual = np.zeros((6, 9, 4), np.uint8)
    for y in range(6):
        for x in range(9):
            if y == 0:
                guess = argb[y][x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                guess = argb[y - 1][0]
            else:
                guess = webp._guess(mode, argb[y][x - 1], argb[y - 1][x], argb[y - 1][x - 1], argb[y - 1][x + 1] if x < 8 else argb[y][0])
            residual[y, x] = [(v - g) % 256 for v, g in zip(argb[y][x], guess)]

    def write(w):
        w.put(1, 1)
        w.put(0, 2)
        w.put(2, 3)
        n = 1
        _image(w, [np.zeros(n, int), np.zeros(n, int), np.full(n, mode), np.zeros(n, int)], False)
        w.put(0, 1)
        _image(w, [residual[..., i].reshape(-1).astype(int) for i in range(4)], True)

    assert (webp.decode_lossless(_stream(9, 6, write)) == image).all()


def test_palette_and_packing():
    index = np.array([[0, 1, 1, 0, 1], [1, 1, 0, 0, 0]])
    colours = np.array([[10, 20, 30, 40], [200, 100, 50, 25]])  # a, r, g, b

    def write(w):
        w.put(1, 1)
        w.put(3, 2)
        w.put(1, 8)
        steps = np.array([colours[0], (colours[1] - colours[0]) % 256])
        _image(w, [steps[:, i] for i in range(4)], False)
        w.put(0, 1)
        packed = np.array([sum(int(v) << i for i, v in enumerate(row)) for row in index])
        _image(w, [np.zeros(2, int), np.zeros(2, int), packed, np.zeros(2, int)], True)

    assert (webp.decode_lossless(_stream(5, 2, write)) == colours[index][..., [1, 2, 3, 0]]).all()


def test_animation_blends_and_disposes():
    def frame(x, y, image, flags, ms=50):
        body = b"".join(v.to_bytes(3, "little") for v in (x // 2, y // 2, image.shape[1] - 1, image.shape[0] - 1, ms)) + bytes([flags])
        own = webp.encode(image)[12:]
        return struct.pack("<4sI", b"ANMF", len(body + own)) + body + own

    red = np.full((4, 4, 4), [255, 0, 0, 255], np.uint8)
    half = np.full((2, 2, 4), [0, 0, 255, 128], np.uint8)
    parts = struct.pack("<4sI", b"VP8X", 10) + bytes([2, 0, 0, 0, 3, 0, 0, 3, 0, 0]) + struct.pack("<4sIIH", b"ANIM", 6, 0, 2)
    parts += frame(0, 0, red, 2) + frame(2, 2, half, 1, 5) + frame(0, 0, half, 2)
    frames, plays = webp.decode_frames(struct.pack("<4sI4s", b"RIFF", 4 + len(parts), b"WEBP") + parts)
    assert plays == 2 and [ms for _, ms in frames] == [50, 100, 50]
    assert frames[1][0][2, 2].tolist() == [127, 0, 128, 255] and frames[2][0][3, 3].tolist() == [0, 0, 0, 0]


def test_damage_and_lossy():
    data = webp.encode(picture(8, 8))
    with pytest.raises(Malformed):
        webp.decode(data[:-20])
    lossy = struct.pack("<4sI4s4sI", b"RIFF", 22, b"WEBP", b"VP8 ", 10) + b"\x10\0\0\x9d\x01\x2a\x08\0\x08\0"
    with pytest.raises(Unsupported):
        webp.decode(lossy)
    assert not probe.probe(lossy)["is_decodable"]
