"""Codecs: round trips, hand-made variants, and damage."""

import struct
import zlib

import numpy as np
import pytest

from tessera.codec import Malformed, Refused, bmp, gif, png, probe, tiff
from tessera.sources.images import guarded


def picture(width, height, seed=1, alpha=True):
    rng = np.random.default_rng(seed)
    image = rng.integers(0, 256, (height, width, 4), np.uint8)
    if not alpha:
        image[..., 3] = 255
    return image


SIZES = [(1, 1), (3, 5), (8, 8), (17, 9), (64, 33)]


@pytest.mark.parametrize("width,height", SIZES)
@pytest.mark.parametrize("alpha", [True, False])
def test_lossless_round_trips(width, height, alpha):
    image = picture(width, height, alpha=alpha)
    for tool in (png, bmp):
        assert (tool.decode(tool.encode(image)) == image).all()
    for order in "<>":
        assert (tiff.decode(tiff.encode([image], order)) == image).all()
    deep = np.random.default_rng(2).integers(0, 65536, (height, width, 4)).astype(np.uint16)
    raw, _ = tiff.samples16(tiff.encode([deep]))
    assert (raw == deep).all()


def test_gif_exact_palette_and_many_colours():
    few = picture(20, 20)
    few[..., :3] = few[..., :3] // 64 * 64
    few[..., 3] = np.where(few[..., 3] < 128, 0, 255)
    few[few[..., 3] == 0] = 0
    assert (gif.decode(gif.encode(few)) == few).all()
    many = picture(60, 60, alpha=False)
    error = np.abs(gif.decode(gif.encode(many)).astype(int) - many).mean()
    assert 0 < error < 25
    gray = np.repeat(np.arange(256, dtype=np.uint8).reshape(16, 16, 1), 3, 2)
    whole = np.concatenate([gray, np.full((16, 16, 1), 255, np.uint8)], 2)
    assert (gif.decode(gif.encode(np.tile(whole, (30, 30, 1)))) == np.tile(whole, (30, 30, 1))).all()


def _png(width, height, depth, colour, rows, interlace=0, extra=()):
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlace)
    parts = [png.SIGNATURE, png._chunk(b"IHDR", head), *(png._chunk(k, v) for k, v in extra)]
    return b"".join([*parts, png._chunk(b"IDAT", zlib.compress(rows)), png._chunk(b"IEND", b"")])


def test_png_small_depths_palette_and_transparency():
    for depth in (1, 2, 4):
        per, full = 8 // depth, (1 << depth) - 1
        values = np.arange(per * 2) % (full + 1)
        packed = bytes(sum(int(v) << (8 - depth * (i + 1)) for i, v in enumerate(values[k : k + per])) for k in (0, per))
        got = png.decode(_png(per * 2, 1, depth, 0, b"\0" + packed))
        assert (got[0, :, 0] == values * 255 // full).all() and (got[..., 3] == 255).all()
    palette = (b"PLTE", bytes([1, 2, 3, 4, 5, 6]))
    got = png.decode(_png(2, 1, 8, 3, b"\0\0\1", extra=[palette, (b"tRNS", b"\x80")]))
    assert got.tolist() == [[[1, 2, 3, 128], [4, 5, 6, 255]]]
    got = png.decode(_png(2, 1, 8, 2, b"\0" + bytes([9, 9, 9, 7, 7, 7]), extra=[(b"tRNS", struct.pack(">3H", 9, 9, 9))]))
    assert got[0, :, 3].tolist() == [0, 255]
    with pytest.raises(Malformed):
        png.decode(_png(2, 1, 8, 3, b"\0\0\2", extra=[palette]))


def test_png_interlaced():
    image = picture(13, 11, alpha=False)
    rows = b""
    for x, y, dx, dy in png._PASSES:
        part = image[y::dy, x::dx, :3]
        if part.size:
            rows += b"".join(b"\0" + r.tobytes() for r in part)
    assert (png.decode(_png(13, 11, 8, 2, rows, interlace=1)) == image).all()


@pytest.mark.parametrize("kind", range(5))
def test_png_each_filter(kind):
    image = picture(7, 6, seed=kind, alpha=False)[..., :3]
    x = image.reshape(6, -1).astype(int)
    out = b""
    for y in range(6):
        row = []
        for i in range(21):
            a = x[y, i - 3] if i >= 3 else 0
            b = x[y - 1, i] if y else 0
            c = x[y - 1, i - 3] if y and i >= 3 else 0
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((x[y, i] - [0, a, b, (a + b) // 2, best][kind]) % 256)
        out += bytes([kind, *map(int, row)])
    assert (png.decode(_png(7, 6, 8, 2, out))[..., :3] == image).all()


def test_apng_frames_delays_and_plays():
    frames = [(picture(9, 7, seed=i), 40 * i) for i in range(4)]
    got, plays = png.decode_frames(png.encode_frames(frames, 3))
    assert plays == 3 and [d for _, d in got] == [100, 40, 80, 120]
    assert all((a == b).all() for (a, _), (b, _) in zip(got, frames))
    assert len(png.decode_frames(png.encode_frames(frames, 3), 2)[0]) == 2
    assert probe.probe(png.encode_frames(frames, 3))["frame_count"] == 4


def test_gif_loops_and_delays():
    frames = [(np.full((4, 4, 4), 255 - 40 * i, np.uint8) | np.array([0, 0, 0, 255], np.uint8), d) for i, d in enumerate((0, 10, 20, 70))]
    for plays in (0, 1, 5):
        got, n = gif.decode_frames(gif.encode_frames(frames, plays))
        assert n == plays and [d for _, d in got] == [100, 100, 20, 70]
    data = gif.encode_frames(frames, 1)
    assert len(gif.decode_frames(data[:-1])[0]) == 4  # a missing trailer after a whole frame is allowed
    with pytest.raises(ValueError):
        gif.encode_frames(frames, 70000)


def test_tiff_pages_and_compressions():
    images = [picture(5, 3), picture(7, 2, alpha=False), np.repeat(picture(4, 6)[..., :1], 4, 2)]
    data = tiff.encode(images)
    assert len(tiff.pages(data)) == 3 and all((tiff.decode(data, i) == x).all() for i, x in enumerate(images))
    assert probe.probe(data)["page_count"] == 3
    with pytest.raises(ValueError):
        tiff.decode(data, 3)
    assert tiff.packbits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 7]), 100) == bytes([1, 2, 3, 9, 9, 9, 7])
    assert tiff.lzw(bytes.fromhex("800000") and _tiff_lzw(bytes(range(256)) * 30), 7680) == bytes(range(256)) * 30


def _tiff_lzw(data):
    table, size, acc, n, run = {bytes([i]): i for i in range(256)}, 9, 256, 9, b""
    for v in data:
        longer = run + bytes([v])
        if longer in table:
            run = longer
            continue
        acc, n = acc << size | table[run], n + size
        table[longer] = len(table) + 2
        nxt = len(table) + 2
        if nxt > 4094:
            acc, n = acc << 12 | 256, n + 12
            table, size = {bytes([i]): i for i in range(256)}, 9
        else:
            size = 12 if nxt > 2047 else 11 if nxt > 1023 else 10 if nxt > 511 else 9
        run = bytes([v])
    acc, n = acc << size | table[run], n + size
    acc, n = acc << size | 257, n + size
    pad = -n % 8
    return (acc << pad).to_bytes((n + pad) // 8, "big")


def test_bmp_palette_runs_and_orders():
    palette = bytes([0, 0, 255, 0, 0, 255, 0, 0])
    info = struct.pack("<IiiHHIIiiII", 40, 4, -2, 1, 8, 0, 0, 0, 0, 2, 0)
    head = struct.pack("<2sIII", b"BM", 0, 0, 62)
    got = bmp.decode(head + info + palette + bytes([0, 1, 0, 1, 1, 1, 0, 0]))
    assert got[..., :3].tolist() == [[[255, 0, 0], [0, 255, 0]] * 2, [[0, 255, 0]] * 2 + [[255, 0, 0]] * 2]
    info = struct.pack("<IiiHHIIiiII", 40, 4, 2, 1, 8, 1, 0, 0, 0, 2, 0)
    got = bmp.decode(head + info + palette + bytes([4, 1, 0, 0, 0, 3, 0, 1, 0, 0, 0, 1]))
    assert got[1, :, 1].tolist() == [255] * 4 and got[0, :, 1].tolist() == [0, 255, 0, 0]


def test_zero_alpha_means_opaque():
    info = struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 32, 0, 0, 0, 0, 0, 0)
    got = bmp.decode(struct.pack("<2sIII", b"BM", 0, 0, 54) + info + bytes([1, 2, 3, 0]))
    assert got.tolist() == [[[3, 2, 1, 255]]]


def test_budget_refuses_before_work():
    head = struct.pack(">IIBBBBB", 100000, 100000, 8, 2, 0, 0, 0)
    data = png.SIGNATURE + png._chunk(b"IHDR", head) + png._chunk(b"IDAT", b"") + png._chunk(b"IEND", b"")
    with pytest.raises(Refused):
        png.decode(data)
    assert not probe.probe(data)["is_decodable"]


def test_mutations_give_typed_results_only():
    image = picture(9, 8)
    seeds = [png.encode(image), bmp.encode(image), gif.encode(image), tiff.encode([image, image]), png.encode_frames([(image, 5), (image // 2, 9)])]
    state = 0x9E3779B9
    for data in seeds:
        for _ in range(250):
            state ^= state << 13 & 0xFFFFFFFF
            state ^= state >> 17
            state ^= state << 5 & 0xFFFFFFFF
            hurt = bytearray(data)
            if state % 5 == 0:
                hurt = hurt[: state % len(hurt)]
            else:
                hurt[state % len(hurt)] ^= 1 << (state >> 8) % 8 if state % 2 else 255
            for work in (lambda d: probe.decode(d), lambda d: probe.decode_frames(d), lambda d: probe.probe(d)):
                status, error, _ = guarded(lambda d=bytes(hurt), w=work: w(d))
                assert status in ("ok", "malformed", "unsupported", "refused")


def test_probe_agrees_with_decode():
    for width, height in SIZES:
        for alpha in (True, False):
            image = picture(width, height, alpha=alpha)
            for data in (png.encode(image), bmp.encode(image), gif.encode(image), tiff.encode([image])):
                info = probe.probe(data)
                assert (info["width"], info["height"], info["is_decodable"]) == (width, height, True)


def test_exif_orientation():
    for order, letters in (("<", b"II"), (">", b"MM")):
        for value in range(0, 10):
            block = letters + struct.pack(order + "HIHHHIHHI", 42, 8, 1, 274, 3, 1, value, 0, 0)
            assert probe.exif_orientation(block) == (value if 1 <= value <= 8 else None)
    assert probe.exif_orientation(b"junk") is None


@pytest.mark.parametrize("orientation", range(0, 10))
def test_orientation_and_scaling_on_arrays(orientation):
    from tessera.codec import scale

    image = picture(5, 3)
    got = scale.oriented(image, orientation)
    for y in range(3):
        for x in range(5):
            r, b = 4 - x, 2 - y
            nx = {2: r, 3: r, 5: y, 6: b, 7: b, 8: y}.get(orientation, x)
            ny = {3: b, 4: b, 5: x, 6: x, 7: r, 8: r}.get(orientation, y)
            assert (got[ny, nx] == image[y, x]).all()


def test_area_average_by_hand():
    from fractions import Fraction

    from tessera.codec import scale

    image = picture(7, 5)
    for w, h in ((3, 2), (7, 1), (1, 5), (6, 4)):
        got = scale.downscaled(image, w, h)
        for ty in range(h):
            for tx in range(w):
                total, sums = Fraction(0), [Fraction(0)] * 4
                for y in range(5):
                    for x in range(7):
                        wy = max(Fraction(0), min(Fraction(y + 1), Fraction((ty + 1) * 5, h)) - max(Fraction(y), Fraction(ty * 5, h)))
                        wx = max(Fraction(0), min(Fraction(x + 1), Fraction((tx + 1) * 7, w)) - max(Fraction(x), Fraction(tx * 7, w)))
                        a = int(image[y, x, 3])
                        total += wx * wy
                        sums = [s + wx * wy * (a if c == 3 else a * int(image[y, x, c])) for c, s in enumerate(sums)]
                want = [int(sums[c] / sums[3] + Fraction(1, 2)) if sums[3] else 0 for c in range(3)]
                assert got[ty, tx].tolist() == [*want, int(sums[3] / total + Fraction(1, 2))]
    assert scale.reduced(image, 8).shape == (1, 1, 4) and scale.reduced(image, 1) is image
    assert scale.fitted(100, 50, 30, 30) == (30, 15) and scale.fitted(3, 4, 9, 9) == (3, 4)


def _box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_probes_of_late_formats():
    props = _box(b"ispe", struct.pack(">III", 0, 640, 480)) + _box(b"pixi", bytes([0, 0, 0, 0, 3, 10, 10, 10])) + _box(b"irot", b"\3")
    avif = _box(b"ftyp", b"avif\0\0\0\0avif") + _box(b"meta", bytes(4) + _box(b"iprp", _box(b"ipco", props)))
    info = probe.probe(avif)
    assert (info["format"], info["width"], info["height"], info["bit_depth"], info["orientation"], info["is_decodable"]) == ("AVIF", 640, 480, 10, 6, False)
    value, n = 0, 0
    for v, k in ((0, 1), (1, 2), (479, 13), (0, 3), (1, 2), (639, 13)):
        value, n = value | v << n, n + k
    codestream = b"\xff\x0a" + value.to_bytes(12, "little")
    whole = _box(b"JXL ", b"\r\n\x87\n") + _box(b"jxlc", codestream)
    for data in (codestream, whole):
        info = probe.probe(data)
        assert (info["format"], info["width"], info["height"]) == ("JXL", 640, 480)
    jxr = b"II\xbc\x01" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 0xBC80, 4, 1, 33) + struct.pack("<HHII", 0xBC81, 4, 1, 44) + bytes(4)
    info = probe.probe(jxr)
    assert (info["format"], info["width"], info["height"]) == ("JXR", 33, 44)
    for data in (avif, whole, jxr):
        for cut in range(4, len(data), 3):
            assert guarded(lambda d=data[:cut]: probe.probe(d))[0] in ("ok", "malformed", "unsupported", "refused")
        assert guarded(lambda d=data: probe.decode(d))[0] == "unsupported"
