"""Image files as tables: header facts, pixels, frames and encoded bytes around the numpy codecs.

Every column of results carries a status (ok, malformed, unsupported, refused)
and an error text, so damage in one file never ends a job; only a caller's own
errors do. Work is map-only in Arrow batches of few rows. Decoded pixels are
handed on in bounded slices.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import pixel_math as pm
from tessera.codec import Malformed, Refused, Unsupported, bmp, declared, gif, jpeg, jpeg_lossless, png, probe, scale, tiff, webp

#: Rows of an Arrow slice that are decoded together, pixel rows of one result batch, and pixels that are scored together.
ROWS, PIXELS, SCORED = 32, 1 << 18, 1 << 15

INFO = (
    "status string, error string, format string, width int, height int, bit_depth int, has_alpha boolean, frame_count int, "
    "loop_count bigint, orientation int, is_decodable boolean, unsupported_reason string, page_count int, color_channels int"
)


def read_images(spark: SparkSession, path: str, most_bytes: int = 1 << 30) -> DataFrame:
    """path, length, content and status of files; unused content is never read.

    Files of most_bytes and more come back without content and as refused: two
    scans, whose size tests are pushed down, so no such file is ever loaded.
    """
    files = spark.read.format("binaryFile").load(path)
    good = files.where(F.col("length") < most_bytes).select("path", "length", "content", F.lit("ok").alias("status"))
    large = files.where(F.col("length") >= most_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("refused").alias("status"))
    return good.unionByName(large)


def claims_column(content: Column, prefix: int = 1 << 16) -> Column:
    """Whether this build takes a file on, judged by its first bytes as a loader sees them.

    A file whose prefix probes as decodable is taken; WebP is probed whole, and
    TIFF and JPEG 2000, whose headers may lie further on, are taken if the probe fails.
    """
    form = pm.sniff(content)
    head = F.when(form == "WEBP", content).when(form.isNotNull(), F.substring(content, 1, prefix))

    @F.arrow_udf("boolean")
    def run(forms, heads):  # one file at a time is copied out of the Arrow batch, and only the answer is kept
        taken = []
        for form, x in zip(forms, heads, strict=True):
            status, _, got = guarded(lambda x=x: probe.probe(x.as_py())) if x.is_valid else ("malformed", None, None)
            taken.append(got["is_decodable"] if status == "ok" else x.is_valid and form.as_py() in ("TIFF", "JP2"))
        return pa.array(taken, pa.bool_())

    return run(form, head)


def guarded(work):
    """(status, error, value) of a codec call."""
    try:
        return "ok", None, work()
    except Unsupported as e:
        return "unsupported", str(e), None
    except Refused as e:
        return "refused", str(e), None
    except (Malformed, IndexError, struct.error, zlib.error, OverflowError, MemoryError) as e:
        return "malformed", f"{e}" or type(e).__name__, None


def probe_column(content: Column, page: int = 0) -> Column:
    """Header facts as a struct. Non-deterministic by declaration: a filter and a projection then share one call."""

    @F.pandas_udf(INFO)
    def run(data):
        import pandas as pd

        rows = []
        for x in data:
            status, error, got = ("malformed", "no content", None) if x is None else guarded(lambda x=x: probe.probe(bytes(x), page))
            rows.append((status, error, *(got[f] if got else None for f in probe.FIELDS)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in INFO.split(", ")])

    return run.asNondeterministic()(content)


_PIXEL_SCHEMA = "img_id bigint, frame_idx bigint, x bigint, y bigint, a bigint, r bigint, g bigint, b bigint"
_PIXEL_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _PIXEL_SCHEMA.split(", ")])


def _pixel_batches(img_id: int, frame: int, image: np.ndarray):
    height, width = image.shape[:2]
    rows = max(1, PIXELS // width)
    for y in range(0, height, rows):
        part = image[y : y + rows].astype(np.int64).reshape(-1, 4)
        n = len(part)
        ys, xs = np.divmod(np.arange(n), width)
        cols = [np.full(n, img_id), np.full(n, frame), xs, ys + y, part[:, 3], part[:, 0], part[:, 1], part[:, 2]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_PIXEL_ARROW)


def _upright(data: bytes, image: np.ndarray) -> np.ndarray:
    status, _, info = guarded(lambda: probe.probe(data))
    return scale.oriented(image, info["orientation"]) if status == "ok" else image


def decode_pixels(
    images: DataFrame, id_col: str = "img_id", content_col: str = "content", frames: bool = False, max_frames: int | None = None,
    page: int = 0, upright: bool = False, box: tuple[int, int] | None = None, reduction: int = 1, srgb: bool = False,
) -> DataFrame:
    """Pixel rows of every file that decodes; with frames, of every composited frame.

    upright turns by EXIF; reduction averages blocks, box scales down into a
    width and height, both within the task, so no full-size pixels leave it. srgb
    converts from the colours that the file declares, before anything else.
    """

    def fused(data):  # the inverse transform of JPEG gives smaller pictures itself
        return not frames and reduction in (2, 4, 8) and data[:2] == b"\xff\xd8"

    def fit(data, image):
        image = declared.to_srgb(image, data) if srgb else image
        image = _upright(data, image) if upright else image
        image = image if fused(data) else scale.reduced(image, reduction)
        return scale.scaled(image, *box) if box else image

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                for img_id, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if data is None or img_id is None:
                        continue
                    if frames:
                        status, _, got = guarded(lambda d=data: probe.decode_frames(d, max_frames))
                        shown = [f for f, _ in got[0]] if status == "ok" else []
                    else:
                        status, _, got = guarded(lambda d=data: probe.decode(d, page, reduction if fused(d) else 1))
                        shown = [got] if status == "ok" else []
                    for i, image in enumerate(shown):
                        yield from _pixel_batches(img_id, i, fit(data, image))

    return images.select(F.col(id_col).cast("bigint"), content_col).mapInArrow(run, _PIXEL_SCHEMA)


def decode_status(images: DataFrame, id_col: str = "img_id", content_col: str = "content") -> DataFrame:
    """img_id, status, error, frames, plays and delays_ms of decoding every file in full."""
    schema = pa.schema([("img_id", pa.int64()), ("status", pa.string()), ("error", pa.string()), ("frames", pa.int64()), ("plays", pa.int64()), ("delays_ms", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            rows = []
            for img_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                status, error, got = guarded(lambda d=data: probe.decode_frames(d)) if data is not None else ("malformed", "no content", None)
                rows.append((img_id, status, error, len(got[0]) if got else None, got[1] if got else None, [ms for _, ms in got[0]] if got else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return images.select(F.col(id_col).cast("bigint"), content_col).mapInArrow(run, "img_id bigint, status string, error string, frames bigint, plays bigint, delays_ms array<bigint>")


def tiff_pages(images: DataFrame, id_col: str = "img_id", content_col: str = "content", limit: int = 1 << 16) -> DataFrame:
    """A row for each page of every TIFF: img_id, page, width, height."""
    schema = pa.schema([("img_id", pa.int64()), ("page", pa.int64()), ("width", pa.int64()), ("height", pa.int64())])

    def run(batches):
        for b in batches:
            rows = []
            for img_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                status, _, chain = guarded(lambda d=data: tiff.pages(d, limit)) if data is not None else ("malformed", None, None)
                for i, tags in enumerate(chain if status == "ok" else []):
                    rows.append((img_id, i, tags.get(256, [None])[0], tags.get(257, [None])[0]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return images.select(F.col(id_col).cast("bigint"), content_col).mapInArrow(run, "img_id bigint, page bigint, width bigint, height bigint")


ENCODERS = {"jpeg": jpeg.encode, "png": png.encode, "bmp": bmp.encode, "gif": gif.encode, "tiff": lambda image: tiff.encode([image]), "webp": webp.encode, "tiff-fax": tiff.encode_bilevel, "jpeg-lossless": lambda image: jpeg_lossless.encode(image[..., :3]), "tiff16": lambda image: tiff.encode([image.astype(np.uint16) * 257])}


def _gathered(px: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of an image in one row: its sides and packed values in row order. A group is one image, whose size is bounded."""
    packed = F.col("r") * (1 << 24) + F.col("g") * (1 << 16) + F.col("b") * 256 + F.col("a")
    cell = F.struct(F.col("y"), F.col("x"), packed.alias("v"))
    gathered = px.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("cells"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return gathered.select(*keys, "w", "h", F.transform("cells", lambda c: c["v"]).alias("v"))


def _image(width, height, values) -> np.ndarray:
    return np.asarray(values, np.int64).astype(">u4").view(np.uint8).reshape(height, width, 4)


def encode_forms(px: DataFrame, forms: dict[str, str]) -> DataFrame:
    """img_id and a column of files for each format by name: the pixels are gathered once."""

    def written(form: str):
        work = ENCODERS[form]

        @F.pandas_udf("binary")
        def run(w, h, v):
            import pandas as pd

            return pd.Series([work(_image(*row)) for row in zip(w, h, v, strict=True)])

        return run("w", "h", "v")

    return _gathered(px, ["img_id"]).select("img_id", *(written(form).alias(name) for name, form in forms.items()))


def encode_images(px: DataFrame, form: str) -> DataFrame:
    """img_id and content: pixel rows written as files of a format."""
    return encode_forms(px, {"content": form})


def encode_animations(fr: DataFrame, form: str, delay_ms: int = 100, plays: int = 0) -> DataFrame:
    """anim_id and content: frame rows (anim_id, frame_idx, pixels) as GIF or APNG files, or TIFF pages."""
    tools = {"gif": lambda f: gif.encode_frames(f, plays), "png": lambda f: png.encode_frames(f, plays), "tiff": lambda f: tiff.encode([i for i, _ in f])}
    work = tools[form]

    @F.pandas_udf("binary")
    def run(frames):
        import pandas as pd

        return pd.Series([work([(_image(f["w"], f["h"], f["v"]), delay_ms) for f in row]) for row in frames])

    rows = _gathered(fr, ["anim_id", "frame_idx"])
    listed = rows.groupBy("anim_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "w", "h", "v"))).alias("frames"))
    return listed.select("anim_id", run("frames").alias("content"))


def quality_scores(pairs: DataFrame, reference_col: str, distorted_col: str, out_col: str = "score") -> DataFrame:
    """pairs with the perceptual score of two columns of file bytes; null where one can't be decoded or sizes differ."""
    from tessera.codec import quality

    @F.pandas_udf("double")
    def run(left, right):
        import pandas as pd

        out, waiting, held = [None] * len(left), {}, 0

        def score():
            for rows in waiting.values():
                at, a, b = zip(*rows, strict=True)
                for i, found in zip(at, quality.ssimulacra2_many(np.stack(a), np.stack(b)), strict=True):
                    out[i] = found
            waiting.clear()

        for i, both in enumerate(zip(left, right, strict=True)):
            a, b = (guarded(lambda x=x: probe.decode(bytes(x)))[2] if x is not None else None for x in both)
            if a is None or b is None or a.shape != b.shape:
                continue
            if held and held + a[..., 0].size > SCORED:
                score()
                held = 0
            waiting.setdefault(a.shape, []).append((i, a, b))
            held += a[..., 0].size
        score()
        return pd.Series(out, dtype="float64")

    return pairs.withColumn(out_col, run(F.col(reference_col), F.col(distorted_col)))


def differing_pixels(pairs: DataFrame, left_col: str, right_col: str, id_col: str = "img_id") -> DataFrame:
    """img_id and different: pixels whose colours differ between two columns of files, or that only one has; no row where neither decodes."""
    schema = pa.schema([("img_id", pa.int64()), ("different", pa.int64())])

    def counted(a, b):
        if a is None or b is None:
            return (b if a is None else a)[..., 0].size
        height, width = (min(n, m) for n, m in zip(a.shape[:2], b.shape[:2]))
        wrong = (a[:height, :width, :3] != b[:height, :width, :3]).any(-1).sum()
        return int(wrong) + a[..., 0].size + b[..., 0].size - 2 * height * width

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                rows = []
                for img_id, *both in zip(*(c.to_pylist() for c in whole.slice(at, ROWS).columns), strict=True):
                    a, b = (guarded(lambda d=data: probe.decode(d))[2] if data is not None else None for data in both)
                    if img_id is not None and (a is not None or b is not None):
                        rows.append((img_id, counted(a, b)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return pairs.select(F.col(id_col).cast("bigint"), left_col, right_col).mapInArrow(run, "img_id bigint, different bigint")


def repack_column(content: Column, progressive: bool = False) -> Column:
    """JPEG files with smaller codes and the same pixels; other bytes come back as they are."""

    @F.pandas_udf("binary")
    def run(data):
        return data.map(lambda x: None if x is None else jpeg.repack(bytes(x), progressive))

    return run(content)


METADATA = "exif binary, xmp string, icc binary, video_offset bigint, video_length bigint, video_kind string"


def metadata_column(content: Column) -> Column:
    """EXIF, XMP and ICC blocks, and where a motion photo's video lies."""

    @F.pandas_udf(METADATA)
    def run(data):
        import pandas as pd

        from tessera.codec import metadata

        rows = []
        for x in data:
            raw = bytes(x) if x is not None else b""
            got, video = metadata.read(raw), metadata.motion_photo(raw) or (None, None, None)
            rows.append((got["exif"], got["xmp"], got["icc"], *video))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in METADATA.split(", ")])
        return out.astype({"video_offset": "Int64", "video_length": "Int64"})

    return run(content)


def decode_samples16(images: DataFrame, id_col: str = "img_id", content_col: str = "content", page: int = 0) -> DataFrame:
    """img_id, x, y, c, v: 16-bit samples of every file that decodes, in its own channels."""
    schema = pa.schema([(n, pa.int64()) for n in ("img_id", "x", "y", "c", "v")])

    def run(batches):
        for b in batches:
            for img_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                status, _, got = guarded(lambda d=data: probe.decode16(d, page)) if data is not None else ("malformed", None, None)
                if status != "ok":
                    continue
                height, width, n = got.shape
                rows = max(1, PIXELS // (width * n))
                for y in range(0, height, rows):
                    part = got[y : y + rows]
                    ys, xs, cs = (g.reshape(-1) for g in np.indices(part.shape))
                    cols = [np.full(part.size, img_id), xs, ys + y, cs, part.reshape(-1).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    return images.select(F.col(id_col).cast("bigint"), content_col).mapInArrow(run, "img_id bigint, x bigint, y bigint, c bigint, v bigint")
