import struct
import zlib

import numpy as np

from tessera.codec import declared, icc, metadata, png


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def with_chunks(image, *chunks):
    raw = png.encode(image)
    return raw[:33] + b"".join(chunk(k, b) for k, b in chunks) + raw[33:]


def picture():
    image = np.full((16, 16, 4), 255, np.uint8)
    image[..., 0] = np.arange(256).reshape(16, 16)
    image[..., 1] = 255 - image[..., 0]
    image[..., 2] = image[..., 0] * 7
    return image


def test_first_chunk_of_a_kind_and_ranges():
    got = declared.png_color(with_chunks(picture(), (b"gAMA", struct.pack(">I", 45455)), (b"gAMA", struct.pack(">I", 1)), (b"sRGB", b"\x09"),
                                         (b"cHRM", struct.pack(">8i", -1, *range(7))), (b"cICP", b"\x01\x0d\0\x01"), (b"iCCP", b"name\0\0junk")))
    assert got == {"gamma": 45455, "cicp": (1, 13, 0, 1)}


def test_gamma_alone_is_a_power_curve():
    image = picture()
    got = declared.to_srgb(image, with_chunks(image, (b"gAMA", struct.pack(">I", 100_000))))
    v = image[..., :3] / 255
    want = np.floor(255 * np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055) + 0.5)
    assert (got[..., :3] == want).all() and (got[..., 3] == 255).all()


def test_order_of_declarations():
    image, gamma = picture(), (b"gAMA", struct.pack(">I", 100_000))
    assert (declared.to_srgb(image, with_chunks(image, (b"sRGB", b"\0"), gamma)) == image).all()
    assert (declared.to_srgb(image, with_chunks(image, (b"cICP", b"\x01\x0d\0\x01"), gamma)) == image).all()
    linear = declared.to_srgb(image, with_chunks(image, (b"cICP", b"\x01\x08\0\x01"), (b"sRGB", b"\0")))
    assert (linear == declared.to_srgb(image, with_chunks(image, gamma))).all()
    unread = declared.to_srgb(image, with_chunks(image, (b"cICP", b"\x01\x10\0\x01"), gamma))
    assert (unread == linear).all()  # code points that are not read leave it to the next declaration


def test_primaries_keep_white_and_grays():
    image = np.full((1, 256, 4), 255, np.uint8)
    image[0, :, :3] = np.arange(256)[:, None]
    got = declared.to_srgb(image, with_chunks(image, (b"cICP", b"\x09\x0d\0\x01")))
    assert (got == image).all()
    red = np.full((1, 1, 4), 255, np.uint8)
    red[0, 0, 1:3] = 0
    wide = red.copy()
    wide[0, 0, :3] = 200, 30, 30
    assert declared.to_srgb(wide, with_chunks(wide, (b"cICP", b"\x09\x0d\0\x01")))[0, 0, 0] > 200


def test_profiles_of_other_formats():
    made = icc.build("GRAY", {"kTRC": b"curv\0\0\0\0" + struct.pack(">IH", 1, 256)})
    head = bytearray(14 + 124)
    head[:2] = b"BM"
    struct.pack_into("<I", head, 14, 124)
    head[70:74] = b"DEBM"
    struct.pack_into("<II", head, 126, 124, len(made))
    assert declared.bmp_icc(bytes(head) + made) == made and declared.bmp_icc(bytes(head)) is None
    blocks = b"".join(bytes([len(made[i : i + 255])]) + made[i : i + 255] for i in range(0, len(made), 255)) + b"\0"
    assert declared.declared(b"GIF89a" + bytes(7) + b"\x21\xff\x0bICCRGBG1012" + blocks) == {"icc": made}
    assert declared.declared(with_chunks(picture(), *metadata.png_chunks(icc=made)))["icc"] == made
