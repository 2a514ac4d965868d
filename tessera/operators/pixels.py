"""Relational operators on pixel rows: img_id, anim_id, x, y, a, r, g, b (all BIGINT but for names).

One row is one pixel, so projections turn images, filters crop them, and
aggregations scale them. Images never meet, except frame by frame, so every
shuffle is by image and partial sums are made before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import pixel_math as pm

CHANNELS = pm.CHANNELS
PIXEL = ["img_id", "x", "y", "a", "r", "g", "b"]


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as an 8x8 image; `label` groups images into animations."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = e.select(F.col("vec_id").alias("img_id"), F.col("label").cast("bigint").alias("anim_id"), F.posexplode("embedding").alias("i", "e"))
    q = cells.select("img_id", "anim_id", F.col("i").cast("bigint").alias("i"), F.floor((F.col("e").cast("double") + 1.0) * 127.5).cast("bigint").alias("v"))
    i, v, img = F.col("i"), F.col("v"), F.col("img_id")
    alpha = F.when((img + i) % 7 == 0, 0).when((img + i) % 5 == 0, 128).otherwise(255).cast("bigint")
    return q.select(
        "img_id", "anim_id", (i % 8).alias("x"), pm.div(i, F.lit(8)).alias("y"), alpha.alias("a"),
        v.alias("r"), ((v * 7 + i) % 256).alias("g"), ((v * 13 + img) % 256).alias("b"),
    )


def orient(px: DataFrame, orientation, width, height) -> DataFrame:
    nx, ny = pm.oriented(orientation, "x", "y", width, height)
    return px.withColumns({"x": nx.cast("bigint"), "y": ny.cast("bigint")})


#: Turns and mirrors as the EXIF value that they undo.
TURNS = {
    "rotate90": 6, "rotate180": 3, "rotate270": 8, "flip_horizontal": 2, "flip_vertical": 4, "transpose": 5, "transverse": 7,
}


def turn(px: DataFrame, name: str, width, height) -> DataFrame:
    return orient(px, F.lit(TURNS[name]), width, height)


def crop(px: DataFrame, x: int, y: int, width: int, height: int, of_width: int, of_height: int) -> DataFrame:
    """A window moved to the origin; a window outside the image is the caller's error."""
    if x < 0 or y < 0 or width < 1 or height < 1 or x + width > of_width or y + height > of_height:
        raise ValueError(f"crop {width}x{height} at ({x}, {y}) is outside {of_width}x{of_height}")
    inside = px.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return inside.withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def image_flags(px: DataFrame) -> DataFrame:
    """Per image: has_transparency and is_gray."""
    gray = (F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))
    return px.groupBy("img_id").agg(F.bool_or(F.col("a") < 255).alias("has_transparency"), F.bool_and(gray).alias("is_gray"))


def reduce_by(px: DataFrame, r: int) -> DataFrame:
    """Averages of r x r blocks; colour weighs by alpha, edge blocks use the pixels they have."""
    sums = {c: F.sum(F.col(c) * F.col("a")).alias(f"s{c}") for c in CHANNELS}
    keys = [F.col("img_id"), pm.div("x", F.lit(r)).alias("x"), pm.div("y", F.lit(r)).alias("y")]
    out = px.groupBy(*keys).agg(F.sum("a").alias("sa"), F.count(F.lit(1)).alias("n"), *sums.values())
    return out.select("img_id", "x", "y", pm.rounded("sa", "n").alias("a"), *_by_alpha())


def _by_alpha():
    safe = F.when(F.col("sa") > 0, F.col("sa")).otherwise(1)
    return [F.when(F.col("sa") > 0, pm.rounded(F.col(f"s{c}"), safe)).otherwise(0).cast("bigint").alias(c) for c in CHANNELS]


def _bins(axis: str, source: int, target: int, name: str) -> list:
    """The target bins that a source position overlaps, with the overlap."""
    low, high = F.col(axis) * target, (F.col(axis) + 1) * target
    bins = F.sequence(pm.div(low, F.lit(source)), pm.div(high - 1, F.lit(source)))
    return F.transform(bins, lambda d: F.struct(d.alias("d"), (F.least(high, (d + 1) * source) - F.greatest(low, d * source)).alias("w")))


def downscale(px: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Exact area average. Each pixel is dealt to the one or few bins per axis that it overlaps, so no join is needed."""
    if not (1 <= to_width <= width and 1 <= to_height <= height):
        raise ValueError(f"target {to_width}x{to_height} is outside {width}x{height}")
    dealt = px.withColumn("bx", F.explode(_bins("x", width, to_width, "x"))).withColumn("by", F.explode(_bins("y", height, to_height, "y")))
    w = F.col("bx.w") * F.col("by.w")
    sums = [F.sum(w * F.col("a") * F.col(c)).alias(f"s{c}") for c in CHANNELS]
    out = dealt.groupBy("img_id", F.col("bx.d").alias("x"), F.col("by.d").alias("y")).agg(
        F.sum(w * F.col("a")).alias("sa"), F.sum(w).alias("n"), *sums
    )
    return out.select("img_id", "x", "y", pm.rounded("sa", "n").alias("a"), *_by_alpha())


def frames(px: DataFrame) -> DataFrame:
    """Pixels with frame_idx: an animation's images in the order of their ids."""
    order = px.select("anim_id", "img_id").distinct()
    order = order.withColumn("frame_idx", F.row_number().over(Window.partitionBy("anim_id").orderBy("img_id")).cast("bigint") - 1)
    return px.join(order, ["anim_id", "img_id"])


def composite_opaque(fr: DataFrame) -> DataFrame:
    """Frames drawn over each other where transparent pixels let the canvas through (no disposal)."""
    shown = Window.partitionBy("anim_id", "x", "y").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = [F.last(F.when(F.col("a") > 0, F.col(c)), ignorenulls=True).over(shown).alias(c) for c in ("a", "r", "g", "b")]
    out = fr.select("anim_id", "frame_idx", "x", "y", *drawn)
    return out.fillna(0, ["a", "r", "g", "b"])


def frame_pairs(fr: DataFrame) -> DataFrame:
    """Each pixel beside the same pixel of the frame before (prefix p), from the second frame on."""
    before = Window.partitionBy("anim_id", "x", "y").orderBy("frame_idx")
    lagged = fr.withColumns({f"p{c}": F.lag(c).over(before) for c in ("a", "r", "g", "b")})
    return lagged.where("frame_idx > 0")


def changed_boxes(fr: DataFrame) -> DataFrame:
    """Smallest box of changed pixels of every frame (a pixel at the origin if none), and whether drawing over is exact."""
    pairs = frame_pairs(fr)
    same = F.lit(True)
    for c in ("a", "r", "g", "b"):
        same = same & (F.col(c) == F.col(f"p{c}"))
    x, y = F.when(~same, F.col("x")), F.when(~same, F.col("y"))
    found = pairs.groupBy("anim_id", "frame_idx").agg(
        F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"),
        F.count(x).alias("changed"), F.bool_and(same | (F.col("a") == 255)).alias("over_is_exact"),
    )
    zero = F.lit(0).cast("bigint")
    return found.select(
        "anim_id", "frame_idx", F.coalesce("x0", zero).alias("x0"), F.coalesce("y0", zero).alias("y0"),
        (F.coalesce("x1", zero) - F.coalesce("x0", zero) + 1).alias("w"), (F.coalesce("y1", zero) - F.coalesce("y0", zero) + 1).alias("h"),
        "changed", "over_is_exact",
    )


def squared_error(fr: DataFrame) -> DataFrame:
    """Per frame pair: the sum of squared channel differences and the samples, from which PSNR follows."""
    terms = sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in CHANNELS), F.lit(0).cast("bigint"))
    return frame_pairs(fr).groupBy("anim_id", "frame_idx").agg(F.sum(terms).alias("squared"), (F.count(F.lit(1)) * 3).alias("samples"))


def psnr(squared, samples):
    return 10 * F.log10(65025.0 * F.col(samples) / F.col(squared))


def histogram(px: DataFrame) -> DataFrame:
    """Colours of each image with their count and their place in the sorted palette."""
    counted = px.groupBy("img_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("img_id").orderBy("r", "g", "b")).cast("bigint") - 1
    return counted.withColumn("palette_idx", place)


def running_sum_mod256(px: DataFrame, channel: str) -> DataFrame:
    """Undoes horizontal differencing: prefix sums of a row, modulo 256."""
    row = Window.partitionBy("img_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return px.withColumn(channel, F.sum(channel).over(row) % 256)


def difference_mod256(px: DataFrame, channel: str) -> DataFrame:
    """Horizontal differencing: each sample minus the one before, modulo 256."""
    before = F.coalesce(F.lag(channel).over(Window.partitionBy("img_id", "y").orderBy("x")), F.lit(0).cast("bigint"))
    return px.withColumn(channel, F.pmod(F.col(channel) - before, F.lit(256).cast("bigint")))


def schedule(delays: DataFrame, key: str, order: str, delay: str) -> DataFrame:
    """Cumulative start and end of each frame, and the length of a loop, saturated at 32 bits."""
    by = Window.partitionBy(key)
    upto = by.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(delay).over(upto)
    return delays.withColumns(
        {"end_ms": ends, "start_ms": ends - F.col(delay), "loop_ms": F.least(F.sum(delay).over(by), F.lit(2147483647).cast("bigint"))}
    )


def frame_at(scheduled: DataFrame, key: str, order: str, elapsed, loops) -> DataFrame:
    """The frame due at an elapsed time: the first whose end lies beyond it within the loop; the last after all loops."""
    elapsed, loops = pm._col(elapsed), pm._col(loops)
    total = F.max("end_ms").over(Window.partitionBy(key))
    held = (total <= 0) | ((loops != 0) & (pm.div(elapsed, F.when(total > 0, total).otherwise(1)) >= loops))
    t = F.pmod(elapsed, F.when(total > 0, total).otherwise(1))
    due = scheduled.withColumns({"held": held, "t": t}).where(F.col("held") | (F.col("end_ms") > F.col("t")))
    return due.groupBy(key).agg(F.when(F.bool_and("held"), F.max(order)).otherwise(F.min(order)).alias("frame"))
