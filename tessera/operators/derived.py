"""Images derived from other images: grids, overlays, sample expressions, blends and resampled frames.

All are plain DataFrame operators on pixel rows. Grids, overlays and expressions
are map-only up to one aggregate a pixel; nothing gathers an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import pixel_math as pm

CHANNELS = ("a", "r", "g", "b")


def grid_mosaic(tiles: DataFrame, columns: int, tile_width: int, tile_height: int, width, height) -> DataFrame:
    """Tiles (key anim_id, place frame_idx) joined row by row and cropped to width x height."""
    x = (F.col("frame_idx") % columns) * tile_width + F.col("x")
    y = pm.div(F.col("frame_idx"), F.lit(columns)) * tile_height + F.col("y")
    placed = tiles.select("anim_id", x.alias("x"), y.alias("y"), *CHANNELS, *(["rows"] if "rows" in tiles.columns else []))
    return placed.where((F.col("x") < width) & (F.col("y") < height)).select("anim_id", "x", "y", *CHANNELS)


def overlay(inputs: DataFrame, offset_x: Column, offset_y: Column, width: int, height: int, fill: dict[str, int]) -> DataFrame:
    """Inputs without half-transparent pixels drawn in the order of frame_idx at offsets on a filled canvas.

    A pixel shows the last input that covers it with alpha over 0, so a partial
    maximum by frame is all that crosses the network.
    """
    moved = inputs.select("anim_id", "frame_idx", (F.col("x") + offset_x).alias("x"), (F.col("y") + offset_y).alias("y"), *CHANNELS)
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1) & (F.col("a") > 0)
    axes = [F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(c) for c, n in (("x", width), ("y", height))]
    canvas = inputs.select("anim_id").distinct().select("anim_id", axes[0]).select("anim_id", "x", axes[1])
    canvas = canvas.select("anim_id", F.lit(-1).cast("bigint").alias("frame_idx"), "x", "y", *(F.lit(fill[c]).cast("bigint").alias(c) for c in CHANNELS))
    top = F.max_by(F.struct(*CHANNELS), "frame_idx").alias("top")
    drawn = moved.where(inside).unionByName(canvas).groupBy("anim_id", "x", "y").agg(top)
    return drawn.select("anim_id", "x", "y", *(F.col(f"top.{c}").alias(c) for c in CHANNELS))


def sample_transform(tokens: list, inputs: list[Column], bits: int = 32, depth: int = 8) -> Column:
    """A postfix expression over the samples of its inputs, in signed arithmetic of `bits` that saturates.

    A token is an input's number from 1 on, an operator's code, or (0, constant).
    The result is clipped to `depth` bits. Precisions up to 32 bits are covered.
    """
    if bits not in (8, 16, 32):
        raise ValueError("precisions of 8, 16 and 32 bits")
    low, high, stack = -(1 << (bits - 1)), (1 << (bits - 1)) - 1, []

    def held(v: Column) -> Column:
        return F.least(F.greatest(v, F.lit(low)), F.lit(high)).cast("bigint")

    def power(a: Column, b: Column) -> Column:  # a power that a double can't hold exactly is beyond 32 bits anyway
        odd = F.abs(b % 2) == 1
        steep = held(F.pow(a.cast("double"), F.least(b, F.lit(64)).cast("double")).cast("decimal(38,0)"))
        steep = F.when(b > 64, F.when((a < 0) & odd, F.lit(low)).otherwise(F.lit(high))).otherwise(steep)
        fixed = F.when(a == 0, F.lit(0)).when(a == 1, F.lit(1)).when(a == -1, F.when(odd, F.lit(-1)).otherwise(F.lit(1)))
        return F.coalesce(fixed, F.when(b < 0, F.lit(0)), steep).cast("bigint")

    single = {
        64: lambda a: held(-a), 65: lambda a: held(F.abs(a)), 66: F.bitwise_not,
        67: lambda a: F.when(a <= 0, F.lit(0)).otherwise(F.length(F.bin(a)) - 1).cast("bigint"),
    }
    double = {
        128: lambda a, b: held(a + b), 129: lambda a, b: held(a - b), 130: lambda a, b: held(a * b),
        131: lambda a, b: F.when(b == 0, a).otherwise(held(pm.div(a, F.when(b != 0, b)))),
        132: lambda a, b: a.bitwiseAND(b), 133: lambda a, b: a.bitwiseOR(b), 134: lambda a, b: a.bitwiseXOR(b),
        135: power, 136: F.least, 137: F.greatest,
    }
    for token in tokens:
        if isinstance(token, tuple):
            stack.append(F.lit(token[1]).cast("bigint"))
        elif 1 <= token <= len(inputs):
            stack.append(inputs[token - 1].cast("bigint"))
        elif token in single and stack:
            stack.append(single[token](stack.pop()))
        elif token in double and len(stack) > 1:
            right = stack.pop()
            stack.append(double[token](stack.pop(), right))
        else:
            raise ValueError(f"token {token} with {len(stack)} values on the stack")
    if len(stack) != 1:
        raise ValueError(f"{len(stack)} values are left on the stack")
    return F.least(F.greatest(stack[0], F.lit(0)), F.lit((1 << depth) - 1)).cast("bigint")


def _single(c: Column) -> Column:
    return c.cast("float")


def blended(mode: str, under: dict[str, Column], over: dict[str, Column], clamp: bool = False, premultiplied: bool = False) -> dict[str, Column]:
    """Channels a, r, g, b (floats, 1 is full) of `over` drawn on `under`, each step in single precision.

    Modes: replace, add, multiply, blend (by alpha) and weighted (added by alpha).
    """
    one = F.lit(1.0).cast("float")
    within = (lambda v: F.least(F.greatest(v, F.lit(0.0).cast("float")), one)) if clamp else (lambda v: v)
    names = ("r", "g", "b")
    if mode == "replace":
        return dict(over)
    if mode == "add":
        return {c: _single(under[c] + over[c]) for c in (*names, "a")}
    if mode == "multiply":
        return {c: _single(under[c] * within(over[c])) for c in (*names, "a")}
    alpha = within(over["a"])
    if mode == "weighted":
        return {c: _single(under[c] + _single(over[c] * alpha)) for c in names} | {"a": under["a"]}
    if mode != "blend":
        raise ValueError(f"no blend mode {mode}")
    keep = _single(one - alpha)
    whole = _single(one - _single(keep * _single(one - under["a"])))
    if premultiplied:
        return {c: _single(over[c] + _single(under[c] * keep)) for c in names} | {"a": whole}
    share = F.when(whole > 0, _single(1.0 / whole)).otherwise(F.lit(0.0).cast("float"))
    mixed = {c: _single(_single(over[c] * alpha) + _single(_single(under[c] * under["a"]) * keep)) for c in names}
    return {c: _single(mixed[c] * share) for c in names} | {"a": whole}


def _reached(axis: str, source: int, target: int, name: str) -> Column:
    """The target positions d that have a source position as a corner, its weight w of 2 * target parts, and their number of corners n."""
    x, parts = F.col(axis), 2 * target
    first = lambda n: F.ceil((parts * (x + n) + target - source) / (2 * source)).cast("bigint")
    low, high = F.when(x > 1, first(-1)).otherwise(0).cast("bigint"), F.when(x < source - 1, first(1) - 1).otherwise(target - 1).cast("bigint")
    at = lambda d: F.least(F.greatest((2 * d + 1) * source - target, F.lit(0)), F.lit(parts * (source - 1))).cast("bigint")
    told = lambda d: F.struct(d.alias("d"), (parts - F.abs(at(d) - parts * x)).alias("w"), F.when(at(d) < parts * (source - 1), 2).otherwise(1).cast("bigint").alias("n"))
    return F.when(x.between(0, source - 1) & (low <= high), F.transform(F.sequence(low, F.greatest(low, high)), told)).alias(name)


def resampled(px: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Bilinear resampling of images with their centres aligned, exact and rounded once, halves up.

    Each pixel is dealt to the target pixels that have it as one of their corners,
    so nothing is joined or sent to the driver. A target pixel without all its
    corners isn't there.
    """
    even = px.select("img_id", "x", "y", *CHANNELS).repartition(int(px.sparkSession.conf.get("spark.sql.shuffle.partitions")), "img_id")
    dealt = even.select("img_id", F.explode(_reached("x", width, to_width, "cx")).alias("cx"), "y", *CHANNELS)
    dealt = dealt.select("img_id", "cx", F.explode(_reached("y", height, to_height, "cy")).alias("cy"), *CHANNELS)
    w, whole = F.col("cx.w") * F.col("cy.w"), F.lit(4 * to_width * to_height).cast("bigint")
    sums = [F.sum(w * F.col(c)).alias(f"s{c}") for c in CHANNELS]
    keys = [F.col("img_id"), F.col("cx.d").alias("x"), F.col("cy.d").alias("y")]
    found = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("met"), F.max(F.col("cx.n") * F.col("cy.n")).alias("corners"), *sums)
    return found.where("met = corners").select("img_id", "x", "y", *(pm.rounded(f"s{c}", whole).alias(c) for c in CHANNELS))
