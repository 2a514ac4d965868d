"""Queries that write tiles as files and read them back; lossless codecs have the tiles themselves as oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pixels as px
from tessera.plans.pixel_queries import FRAMES, TILES, _reduce_sql, _scale_sql
from tessera.sources import images

_made: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        _made[f.__name__] = (f, sql)
        return f

    return add


def queries():
    return {name: f for name, (f, _) in _made.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _made.items() if sql}


@query(_scale_sql(3, 3))
def encode_probe_decode_scale(spark, d):
    """Tiles to BMP files; the probe decides which are decoded; pixels are averaged to 3x3."""
    files = images.encode_images(px.tiles(spark, d), "bmp").withColumn("info", images.probe_column(F.col("content")))
    good = files.where("info.is_decodable and info.width = 8 and info.height = 8")
    return px.downscale(images.decode_pixels(good), 8, 8, 3, 3)


SAME = TILES + " SELECT img_id, x, y, a, r, g, b FROM tiles"


def _round_trip(spark, d, form):
    return images.decode_pixels(images.encode_images(px.tiles(spark, d), form)).select(*px.PIXEL)


@query(SAME)
def r15_bmp_round_trip(spark, d):
    return _round_trip(spark, d, "bmp")


@query(SAME)
def r15_png_round_trip(spark, d):
    return _round_trip(spark, d, "png")


@query(SAME)
def r15_tiff_round_trip(spark, d):
    return _round_trip(spark, d, "tiff")


@query(TILES + " SELECT img_id, x, y, " + ", ".join(f"CASE WHEN a < 128 THEN 0 ELSE {v} END AS {c}" for c, v in (("a", "255::BIGINT"), ("r", "r"), ("g", "g"), ("b", "b"))) + " FROM tiles")
def r15_gif_round_trip(spark, d):
    return _round_trip(spark, d, "gif")


@query(TILES + """ SELECT img_id, 'ok' AS status, 'PNG' AS format, 8 AS width, 8 AS height, 8 AS bit_depth, bool_or(a < 255) AS has_alpha,
  1 AS frame_count, 1 AS page_count, 3 AS color_channels, true AS is_decodable FROM tiles GROUP BY img_id""")
def s03_s06_probe_png(spark, d):
    files = images.encode_images(px.tiles(spark, d), "png").withColumn("info", images.probe_column(F.col("content")))
    names = ["status", "format", "width", "height", "bit_depth", "has_alpha", "frame_count", "page_count", "color_channels", "is_decodable"]
    return files.select("img_id", *(F.col(f"info.{n}").alias(n) for n in names))


def _animations(spark, d, form):
    """Every animation as one file of all its frames."""
    fr = px.frames(px.tiles(spark, d))
    return images.encode_animations(fr, form).select(F.col("anim_id").alias("img_id"), "content")


@query(FRAMES + " SELECT anim_id AS img_id, frame_idx, x, y, a, r, g, b FROM frames")
def d07_apng_frames(spark, d):
    return images.decode_pixels(_animations(spark, d, "png"), frames=True)


@query(FRAMES + " SELECT anim_id AS img_id, frame_idx, x, y, " + ", ".join(f"CASE WHEN a < 128 THEN 0 ELSE {v} END AS {c}" for c, v in (("a", "255::BIGINT"), ("r", "r"), ("g", "g"), ("b", "b"))) + " FROM frames")
def d07_gif_frames(spark, d):
    return images.decode_pixels(_animations(spark, d, "gif"), frames=True)


@query(FRAMES + " SELECT DISTINCT anim_id AS img_id, frame_idx AS page, 8::BIGINT AS width, 8::BIGINT AS height FROM frames")
def s16_tiff_pages(spark, d):
    return images.tiff_pages(_animations(spark, d, "tiff"))


@query(FRAMES + " SELECT anim_id AS img_id, 'ok' AS status, count(DISTINCT frame_idx) AS frames, CASE WHEN count(DISTINCT frame_idx) = 1 THEN 1 ELSE 0 END AS plays FROM frames GROUP BY anim_id")
def d07_status(spark, d):
    got = images.decode_status(_animations(spark, d, "png"))
    return got.select("img_id", "status", "frames", F.col("plays").cast("int").alias("plays"))


@query(None)
def d02_pages_of_documents(spark, d):
    """Documents' bytes are no images: every row must come back as malformed, none may end the job."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    head = F.element_at(F.array(*(F.unhex(F.lit(m)) for m in ("89504E470D0A1A0A", "424D", "474946383961", "49492A00"))), (F.col("doc_id") % 4 + 1).cast("int"))
    files = docs.select(F.col("doc_id").alias("img_id"), F.concat(head, F.col("text").cast("binary")).alias("content"))
    return images.decode_status(files).select("img_id", "status")


@query(TILES + " SELECT img_id, 'ok' AS status, 'JPEG' AS format, 8 AS width, 8 AS height, 3 AS color_channels FROM tiles GROUP BY img_id")
def s07_probe_jpeg(spark, d):
    files = images.encode_images(px.tiles(spark, d), "jpeg").withColumn("info", images.probe_column(F.col("content")))
    return files.select("img_id", *(F.col(f"info.{n}").alias(n) for n in ("status", "format", "width", "height", "color_channels")))


@query(None)
def f03_jpeg_pixels(spark, d):
    """Tiles through the JPEG encoder and decoder: lossy, so without an exact oracle."""
    return images.decode_pixels(images.encode_images(px.tiles(spark, d), "jpeg")).select(*px.PIXEL)


@query(SAME)
def r15_webp_round_trip(spark, d):
    return _round_trip(spark, d, "webp")


@query("SELECT vec_id AS img_id, 100.0::DOUBLE AS score FROM embeddings")
def q01_score_of_lossless(spark, d):
    """Tiles as PNG against the same tiles as BMP: every score is 100."""
    both = images.encode_forms(px.tiles(spark, d), {"left": "png", "right": "bmp"})
    return images.quality_scores(both, "left", "right").select("img_id", "score")


@query(None)
def q01_score_of_jpeg(spark, d):
    """Tiles against their JPEG form; real numbers, so without an exact oracle."""
    both = images.encode_forms(px.tiles(spark, d), {"left": "png", "right": "jpeg"})
    return images.quality_scores(both, "left", "right").select("img_id", "score")


@query("SELECT vec_id AS img_id, 0::BIGINT AS different FROM embeddings")
def e11_repack_keeps_pixels(spark, d):
    """Pixels of JPEG files before and after repacking; none may differ."""
    files = images.encode_images(px.tiles(spark, d), "jpeg")
    both = files.withColumn("repacked", images.repack_column(F.col("content"), progressive=True))
    return images.differing_pixels(both, "content", "repacked")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS xmp, CASE WHEN doc_id % 3 = 0 THEN 500 + doc_id % 100 END AS video_length FROM documents")
def m01_m11_metadata(spark, d):
    """XMP packets and motion photo marks written into JPEG files and read back."""
    from tessera.codec import jpeg, metadata

    @F.pandas_udf("binary")
    def write(ids, langs):
        import numpy as np

        photo = jpeg.encode(np.full((8, 8, 4), 255, np.uint8))
        out = []
        for i, lang in zip(ids, langs, strict=True):
            n = 500 + i % 100
            xmp = lang if i % 2 == 0 else None
            if i % 3 == 0:
                xmp = (xmp or "") + f'\n<a GCamera:MicroVideo="1" GCamera:MicroVideoOffset="{n}"/>'
            out.append(metadata.into_jpeg(photo, xmp=xmp) + (bytes(n) if i % 3 == 0 else b""))
        return ids.map(dict(zip(ids, out, strict=True)))

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    files = docs.select("doc_id", write("doc_id", "lang").alias("content")).withColumn("m", images.metadata_column(F.col("content")))
    first = F.nullif(F.substring_index("m.xmp", "\n", 1), F.lit(""))
    return files.select("doc_id", first.alias("xmp"), F.col("m.video_length").alias("video_length"))


@query(_scale_sql(3, 3))
def d05_decode_scaled(spark, d):
    """Files decoded into a 3x5 box within the task."""
    return images.decode_pixels(images.encode_images(px.tiles(spark, d), "webp"), box=(3, 5)).select(*px.PIXEL)


@query(_reduce_sql(4))
def d04_decode_reduced(spark, d):
    return images.decode_pixels(images.encode_images(px.tiles(spark, d), "png"), reduction=4).select(*px.PIXEL)


@query(TILES + """, z AS (SELECT img_id, bool_or(a < 255) AS alpha FROM tiles GROUP BY img_id),
  s AS (SELECT img_id, x, y, unnest([0, 1, 2, 3]) AS c, unnest([r, g, b, a]) * 257 AS v FROM tiles)
  SELECT img_id, x, y, c::BIGINT AS c, v FROM s JOIN z USING (img_id) WHERE c < 3 OR alpha""")
def d03_samples16(spark, d):
    return images.decode_samples16(images.encode_images(px.tiles(spark, d), "tiff16"))


@query(FRAMES + """ SELECT anim_id AS img_id, x, y + 8 * frame_idx AS y, 255::BIGINT AS a, l AS r, l AS g, l AS b
  FROM (SELECT *, CASE WHEN (77 * r + 150 * g + 29 * b) >> 8 < 128 THEN 0 ELSE 255 END::BIGINT AS l FROM frames)""")
def d12_fax_pages(spark, d):
    """Every animation as one column of tiles, in black and white, through two-dimensional fax codes in TIFF."""
    fr = px.frames(px.tiles(spark, d))
    page = fr.select(F.col("anim_id").alias("img_id"), "x", (F.col("y") + 8 * F.col("frame_idx")).alias("y"), "a", "r", "g", "b")
    return images.decode_pixels(images.encode_images(page, "tiff-fax")).select(*px.PIXEL)


_SRGB = "floor((CASE WHEN {0} / 255 <= 0.0031308 THEN {0} / 255 * 12.92 ELSE 1.055 * pow({0} / 255, 1 / 2.4) - 0.055 END) * 255 + 0.5)::BIGINT"


@query(TILES + " SELECT img_id, x, y, a, " + ", ".join(_SRGB.format(c) + f" AS {c}" for c in "rgb") + " FROM tiles")
def c01_declared_linear(spark, d):
    """PNG tiles that declare linear light (gamma 1), decoded to sRGB."""
    import struct
    import zlib

    body = b"gAMA" + struct.pack(">I", 100_000)
    chunk = struct.pack(">I", 4) + body + struct.pack(">I", zlib.crc32(body))
    whole = F.col("content")
    marked = F.concat(F.substring(whole, 1, 33), F.lit(chunk), F.substring(whole, 34, 1 << 30))
    files = images.encode_images(px.tiles(spark, d), "png").withColumn("content", marked)
    return images.decode_pixels(files, srgb=True).select(*px.PIXEL)


@query("SELECT doc_id, doc_id % 4 = 3 AS claimed FROM documents")
def s17_claims(spark, d):
    """Magic bytes before whole texts: only what may be a TIFF further on is taken."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    head = F.element_at(F.array(*(F.unhex(F.lit(m)) for m in ("89504E470D0A1A0A", "424D", "524946460000000057454250", "49492A00"))), (F.col("doc_id") % 4 + 1).cast("int"))
    files = docs.select("doc_id", F.concat(head, F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("content"))
    return files.select("doc_id", images.claims_column(F.col("content")).alias("claimed"))


@query(TILES + " SELECT img_id, x, y, 255::BIGINT AS a, r, g, b FROM tiles")
def f05_jpeg_lossless(spark, d):
    """Colours of the tiles through lossless JPEG; alpha is not stored."""
    return _round_trip(spark, d, "jpeg-lossless")


@query(TILES + """ SELECT img_id, (x // 4) AS x, (y // 4) AS y, 255::BIGINT AS a, 40 + (img_id % 5) * 30 AS r, 40 + (img_id % 5) * 30 AS g, 40 + (img_id % 5) * 30 AS b
  FROM tiles WHERE x % 4 = 0 AND y % 4 = 0""")
def f08_jpeg_reduced(spark, d):
    """Even gray tiles written as JPEG and read at a quarter of their size by the inverse transform."""
    gray = (40 + (F.col("img_id") % 5) * 30).cast("bigint")
    t = px.tiles(spark, d).select("img_id", "x", "y", F.lit(255).cast("bigint").alias("a"), *(gray.alias(c) for c in "rgb"))
    return images.decode_pixels(images.encode_images(t, "jpeg"), reduction=4).select(*px.PIXEL)
