import math

import numpy as np
from pyspark.sql import functions as F

from tessera.codec import jpeg, metadata, png
from tessera.functions import color


def picture():
    image = np.random.default_rng(1).integers(0, 256, (6, 5, 4), np.uint8)
    image[..., 3] = 255
    return image


def test_png_and_jpeg_metadata_round_trip():
    exif, xmp, icc = b"II*\0\x08\0\0\0", "<x:xmpmeta>ü</x:xmpmeta>", bytes(range(256)) * 600
    got = metadata.read(png.encode(picture(), metadata.png_chunks(exif, xmp, icc)))
    assert got == {"exif": exif, "xmp": xmp, "icc": icc}
    file = metadata.into_jpeg(jpeg.encode(picture()), exif, xmp, icc)
    assert metadata.read(file) == {"exif": exif, "xmp": xmp, "icc": icc}
    assert (jpeg.decode(file) == jpeg.decode(jpeg.encode(picture()))).all()
    assert metadata.read(b"BM") == {"exif": None, "xmp": None, "icc": None}
    broken = file.replace(b"ICC_PROFILE\0\x02", b"ICC_PROFILE\0\x07")
    assert metadata.read(broken)["icc"] is None


def test_motion_photos():
    photo = jpeg.encode(picture())
    video = b"\0\0\0\x18ftypmp42" + bytes(40)
    google = metadata.into_jpeg(photo, xmp=f'<a GCamera:MotionPhoto="1"><b Item:Semantic="MotionPhoto" Item:Length="{len(video)}"/></a>') + video
    micro = metadata.into_jpeg(photo, xmp=f'<a GCamera:MicroVideo="1" GCamera:MicroVideoOffset="{len(video)}"/>') + video
    trailer = photo + b"MotionPhoto_Data" + video
    for data, kind in ((google, "motion_photo"), (micro, "micro_video"), (trailer, "trailer")):
        at, n, found = metadata.motion_photo(data)
        assert found == kind and data[at : at + n] == video
        still = metadata.remove_motion(data)
        assert metadata.motion_photo(still) is None and (jpeg.decode(still) == jpeg.decode(photo)).all()
    assert metadata.motion_photo(photo) is None and metadata.remove_motion(photo) == photo


def test_transfer_curves(spark):
    v = F.col("id") / 100.0
    rows = spark.range(101).select(
        v.alias("v"), color.linear_to_srgb(color.srgb_to_linear(v)).alias("srgb"), color.nits_to_pq(color.pq_to_nits(v)).alias("pq"),
        color.hlg_to_scene(v).alias("hlg"), color.pq_to_nits(v).alias("nits"),
    ).collect()
    for r in rows:
        assert math.isclose(r.srgb, r.v, abs_tol=1e-4) and math.isclose(r.pq, r.v, abs_tol=1e-6)
    assert math.isclose(rows[100].nits, 10000, rel_tol=1e-9) and math.isclose(rows[100].hlg, 1, rel_tol=1e-5)
    assert math.isclose(rows[50].hlg, 1 / 12, rel_tol=1e-9)


def test_icc_and_peak(spark):
    icc = bytes(16) + b"RGB " + bytes(108)
    r = spark.createDataFrame([(bytearray(icc), 0.0, 600.0)], "icc binary, c double, m double").select(
        color.icc_color_space(F.col("icc")).alias("s"), color.hdr_peak(F.col("c"), F.col("m")).alias("p"),
        color.hdr_peak(F.col("c"), F.lit(None).cast("double")).alias("d"), color.narrow_to_full(F.lit(235.0)).alias("n"),
    ).first()
    assert (r.s, r.p, r.d, r.n) == ("RGB", 600.0, 1000.0, 1.0)
