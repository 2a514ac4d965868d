"""Queries of derived images and sample arithmetic, each beside the SQL that states it independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import samples as sm
from tessera.operators import derived
from tessera.operators import pixels as px
from tessera.plans.pixel_queries import FRAMES, SIZES, TILES, _sizes

_made: dict[str, tuple] = {}


def query(sql: str):
    def add(f):
        _made[f.__name__] = (f, sql)
        return f

    return add


def queries():
    return {name: f for name, (f, _) in _made.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _made.items()}


@query(FRAMES + """, n AS (SELECT anim_id, ((max(frame_idx) // 5) + 1) * 8 - 3 AS h FROM frames GROUP BY anim_id)
  SELECT anim_id, (frame_idx % 5) * 8 + x AS x, (frame_idx // 5) * 8 + y AS y, a, r, g, b FROM frames JOIN n USING (anim_id)
  WHERE (frame_idx % 5) * 8 + x < 37 AND (frame_idx // 5) * 8 + y < h""")
def g14_grid(spark, d):
    """Every animation's images as tiles of five columns, cropped to 37 columns and three rows less than they have."""
    fr = px.frames(px.tiles(spark, d))
    rows = fr.groupBy("anim_id").agg((F.floor(F.max("frame_idx") / 5) + 1).alias("rows"))
    return derived.grid_mosaic(fr.join(rows, "anim_id"), 5, 8, 8, 37, F.col("rows") * 8 - 3)


@query(FRAMES + """, d AS (SELECT anim_id, frame_idx, x + (frame_idx * 3) % 7 - 2 AS x, y + (frame_idx * 5) % 9 - 3 AS y, 255 AS a, r, g, b
    FROM frames WHERE a > 0),
  c AS (SELECT DISTINCT anim_id, -1 AS frame_idx, cx.x AS x, cy.y AS y, 255 AS a, 10 AS r, 20 AS g, 30 AS b FROM frames,
    (SELECT unnest(range(12)) AS x) cx, (SELECT unnest(range(10)) AS y) cy),
  o AS (SELECT * FROM d WHERE x BETWEEN 0 AND 11 AND y BETWEEN 0 AND 9 UNION ALL SELECT * FROM c)
  SELECT anim_id, x, y, a::BIGINT AS a, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY anim_id, x, y ORDER BY frame_idx DESC) AS k FROM o) WHERE k = 1""")
def g15_overlay(spark, d):
    fr = px.frames(px.tiles(spark, d)).withColumn("a", F.when(F.col("a") > 0, 255).otherwise(0).cast("bigint"))
    k = F.col("frame_idx")
    return derived.overlay(fr, (k * 3) % 7 - 2, (k * 5) % 9 - 3, 12, 10, {"a": 255, "r": 10, "g": 20, "b": 30})


@query(TILES + """ SELECT img_id, x, y, greatest(0, least(255, CASE WHEN g = 0 THEN greatest(-32768, least(32767, r * b - 9000))
    ELSE CAST(trunc(greatest(-32768, least(32767, greatest(-32768, least(32767, r * b)) - 9000)) / g) AS BIGINT) END))::BIGINT AS quotient,
  greatest(0, least(255, least(xor(r, g), b | 5)))::BIGINT AS mixed,
  greatest(0, least(255, CASE WHEN r = 0 THEN 0 ELSE length(bin(r)) - 1 END + (g & 15) * (g & 15)))::BIGINT AS grown FROM tiles""")
def g16_sample_transform(spark, d):
    """Three postfix expressions over red, green and blue: in 16 bits with saturation, with bits, and with logarithm and power."""
    ins = [F.col(c) for c in "rgb"]
    made = {
        "quotient": derived.sample_transform([1, 3, 130, (0, 9000), 129, 2, 131], ins, 16),
        "mixed": derived.sample_transform([1, 2, 134, 3, (0, 5), 133, 136], ins),
        "grown": derived.sample_transform([1, 67, 2, (0, 15), 132, (0, 2), 135, 128], ins),
    }
    return px.tiles(spark, d).select("img_id", "x", "y", *(v.alias(c) for c, v in made.items()))


@query(f"WITH s AS ({SIZES}) " + """SELECT k, CASE k % 12 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 3 WHEN 3 THEN 7 WHEN 4 THEN 2 WHEN 5 THEN 8
  WHEN 6 THEN 2 WHEN 7 THEN 5 WHEN 8 THEN 1 WHEN 9 THEN 5 WHEN 10 THEN 4 ELSE 6 END::BIGINT AS orientation,
  CASE WHEN cw <= w AND ch <= h AND (w - cw) % 2 = 0 AND (h - ch) % 2 = 0 AND (cw < w OR ch < h) THEN (w - cw) // 2 END AS x,
  CASE WHEN cw <= w AND ch <= h AND (w - cw) % 2 = 0 AND (h - ch) % 2 = 0 AND (cw < w OR ch < h) THEN (h - ch) // 2 END AS y
  FROM (SELECT *, mw AS cw, mh AS ch FROM s)""")
def g17_box_orientation(spark, d):
    """Quarter turns and mirrors (four turns by two axes and none) as EXIF values, and centred clean apertures."""
    k, zero, one = F.col("k"), F.lit(0), F.lit(1)
    turns, axis = F.pmod(k, F.lit(4)), F.when(k % 3 < 2, k % 3)
    box = sm.clean_aperture(F.col("w"), F.col("h"), (F.col("mw") * 3, F.lit(3)), (F.col("mh"), one), (zero, one), (zero, F.lit(5)))
    s = _sizes(spark, d).select("k", sm.box_orientation(turns, axis).alias("orientation"), box.alias("box"))
    return s.select("k", "orientation", F.col("box.x").alias("x"), F.col("box.y").alias("y"))


@query(TILES + """ SELECT img_id, x, y, CASE WHEN r % 32 = 0 THEN 0 ELSE least(65535, floor(CASE WHEN v <= 0.0031308 THEN v * 12.92
    ELSE 1.055 * pow(v, 1 / 2.4) - 0.055 END * 65535 + 0.5)) END::BIGINT AS half,
  CASE WHEN f <= 0 THEN 0 WHEN f >= 1 THEN 65535 ELSE floor(f * 65535 + 0.5) END::BIGINT AS fixed,
  (g % 32) * 2048 + (g % 32) * 64 + (g % 32) * 2 + (g % 32) // 16 AS wide
  FROM (SELECT *, (1 + (g * 4 % 1024) / 1024) * pow(2, r % 14) / 32768 * (CASE WHEN r % 32 = 0 THEN 0 ELSE 1 END) AS v, (b * 97 - 9000) / 8192 AS f FROM
    (SELECT img_id, x, y, CASE WHEN r % 14 = 0 THEN 0 ELSE r END AS r, g, b FROM tiles))""")
def g36_wide_samples(spark, d):
    """Half and fixed-point linear samples as 16 bits, and five bits widened."""
    t = px.tiles(spark, d).withColumn("r", F.when(F.col("r") % 14 == 0, 0).otherwise(F.col("r")))
    e = F.when(F.col("r") % 32 == 0, 0).otherwise(F.col("r") % 14)
    bits = (F.shiftleft(e, 10) + F.col("g") * 4 % 1024).cast("bigint")
    fixed = sm.fixed_value(F.col("b") * 97 - 9000, 16)
    return t.select("img_id", "x", "y", sm.linear_to_16(sm.half_value(bits)).alias("half"), sm.linear_to_16(fixed, alpha=True).alias("fixed"),
                    sm.widened(F.col("g") % 32, 5).alias("wide"))


@query(TILES + " SELECT img_id, x, y, r, g, b, CAST(floor((r + 2 * g + b) / 4) AS BIGINT) AS luma, b - g AS u, r - g AS v FROM tiles")
def g41_reversible_color(spark, d):
    """The reversible transform of JPEG 2000 forward and back: the colours are those of before."""
    t = px.tiles(spark, d)
    t = t.select("img_id", "x", "y", *(v.alias({"y": "luma"}.get(c, c)) for c, v in sm.reversible_forward(F.col("r"), F.col("g"), F.col("b")).items()))
    return t.select("*", *(v.alias(c) for c, v in sm.reversible_inverse(F.col("luma"), F.col("u"), F.col("v")).items()))


def _modular_sql(kind: int) -> str:
    order, form = divmod(kind, 7)
    if form == 6:
        base = "(r - (b >> 1))"
        blue = f"({base} - (g >> 1))"
        made = [f"(g + {blue})", f"(b + {base})", blue]
    else:
        third = "(b + r)" if form in (1, 3, 5) else "b"
        made = ["r", ["g", "g", "(g + r)", "(g + r)", f"(g + ((r + {third}) >> 1))", f"(g + ((r + {third}) >> 1))"][form], third]
    places = [[0, 1, 2], [1, 2, 0], [2, 0, 1], [0, 2, 1], [1, 0, 2], [2, 1, 0]][order]
    return " UNION ALL ".join([f"SELECT img_id, x, y, {kind} AS kind, " + ", ".join(f"{made[places.index(k)]} AS c{k}" for k in range(3)) + " FROM tiles"])


@query(TILES + " " + " UNION ALL ".join(_modular_sql(k) for k in range(0, 42, 5)))
def g23_modular_color(spark, d):
    """Nine of the 42 reversible colour transforms undone, which cover all kinds and all orders of channels."""
    t, out = px.tiles(spark, d), None
    for kind in range(0, 42, 5):
        made = sm.modular_color(kind, F.col("r"), F.col("g"), F.col("b"))
        some = t.select("img_id", "x", "y", F.lit(kind).alias("kind"), *(v.alias(f"c{i}") for i, v in enumerate(made)))
        out = some if out is None else out.union(some)
    return out


@query(TILES + """ SELECT img_id, x, y, greatest(0, least(255, floor(floor((r - 16) * 255 * 65536.0 / 219) / 65536 + CASE WHEN r < 16 THEN 0 ELSE 0.5 END)))::BIGINT AS studio,
  greatest(0, least(255, 255 - g))::BIGINT AS reversed FROM tiles""")
def g46_reference_levels(spark, d):
    """Samples between reference black and white: studio range, and white below black."""
    t = px.tiles(spark, d)
    return t.select("img_id", "x", "y", sm.reference_levels(F.col("r"), (16, 1), (235, 1)).alias("studio"), sm.reference_levels(F.col("g"), (510, 2), (0, 1)).alias("reversed"))


_UNIT = "floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {})) * 255 + 0.5)::BIGINT"


@query(TILES + """, n AS (SELECT img_id, x, y, (r::DOUBLE - 16.0) / 219.0 AS l, (g::DOUBLE - 128.0) / 224.0 AS u, (b::DOUBLE - 128.0) / 224.0 AS v,
    r::DOUBLE / 255.0 AS fl, (g::DOUBLE - 128.0) / 255.0 AS fu, (b::DOUBLE - 128.0) / 255.0 AS fv FROM tiles)
  SELECT img_id, x, y, """ + ", ".join(_UNIT.format(e) + f" AS {n}" for n, e in (
    ("r", "l + (2::DOUBLE * (1::DOUBLE - 0.2126::DOUBLE)) * v"), ("b", "l + (2::DOUBLE * (1::DOUBLE - 0.0722::DOUBLE)) * u"),
    ("g", "l - (2::DOUBLE * ((0.2126::DOUBLE * (1::DOUBLE - 0.2126::DOUBLE)) * v + (0.0722::DOUBLE * (1::DOUBLE - 0.0722::DOUBLE)) * u)) / (1.0::DOUBLE - 0.2126::DOUBLE - 0.0722::DOUBLE)"),
    ("lifted_r", "fl - fu + fv"), ("lifted_g", "fl + fu"), ("lifted_b", "fl - fu - fv"))) + " FROM n")
def c18_yuv_to_rgb(spark, d):
    """4:4:4 samples by the matrix of BT.709 in limited range, and by luma with green and orange chroma in full range."""
    t, made = px.tiles(spark, d), {}
    yuv = [F.col(c).cast("double") for c in "rgb"]
    made |= sm.yuv_to_rgb(*yuv, matrix=1)
    made |= {f"lifted_{c}": v for c, v in sm.yuv_to_rgb(*yuv, matrix=8, full_range=True).items()}
    return t.select("img_id", "x", "y", *(v.alias(c) for c, v in made.items()))


@query(TILES + """ SELECT img_id, x, y, floor(pow(r / 255, 2.4) * 4000 + 0.5)::BIGINT AS video, floor(pow(r / 255, 2.2) * 4000 + 0.5)::BIGINT AS power,
  floor(CASE WHEN r / 255 <= 0.04045 THEN r / 255 / 12.92 ELSE pow((r / 255 + 0.055) / 1.055, 2.4) END * 4000 + 0.5)::BIGINT AS srgb,
  floor(CASE WHEN r / 255 <= 0.5 THEN (r / 255) * (r / 255) / 3 ELSE (exp((r / 255 - 0.55991073) / 0.17883277) + 0.28466892) / 12 END * 4000 + 0.5)::BIGINT AS scene
  FROM tiles""")
def c09_transfers(spark, d):
    v = F.col("r") / 255
    light = {n: F.floor(sm.transfer(code, v) * 4000 + 0.5) for n, code in (("video", 1), ("power", 4), ("srgb", 13), ("scene", 18))}
    return px.tiles(spark, d).select("img_id", "x", "y", *(x.alias(n) for n, x in light.items()))


@query(f"WITH s AS ({SIZES}) SELECT k, abs(mw * h - mh * w) <= w + h AS covers, w * h * 60 <= 1073741824 AS fits FROM s")
def m08_gain_map_aspect(spark, d):
    """Which gain maps have their picture's aspect, and which pictures stay below the ceiling of samples (B04)."""
    s = _sizes(spark, d)
    return s.select("k", sm.gain_map_covers(*(F.col(c) for c in ("w", "h", "mw", "mh"))).alias("covers"), sm.samples_fit(F.col("w"), F.col("h"), 60).alias("fits"))


_F32 = {c: (f"({c}::FLOAT / 255::FLOAT)", f"(p{c}::FLOAT / 255::FLOAT)") for c in "argb"}
_KEEP = f"(1::FLOAT - {_F32['a'][0]})"
_ALL = f"(1::FLOAT - {_KEEP} * (1::FLOAT - {_F32['a'][1]}))"


def _blend_sql(c: str) -> str:
    top, low = _F32[c]
    alpha, low_alpha = _F32["a"]
    if c == "a":
        modes = [top, f"{low} + {top}", f"{low} * {top}", low, _ALL]
    else:
        share = f"CASE WHEN {_ALL} > 0 THEN 1::FLOAT / {_ALL} ELSE 0::FLOAT END"
        modes = [top, f"{low} + {top}", f"{low} * {top}", f"{low} + {top} * {alpha}", f"({top} * {alpha} + ({low} * {low_alpha}) * {_KEEP}) * ({share})"]
    return "CASE frame_idx % 5 " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(modes)) + " END"


@query(FRAMES + " SELECT anim_id, frame_idx, x, y, " + ", ".join(f"floor(({_blend_sql(c)})::DOUBLE * 4096)::BIGINT AS {c}" for c in "argb") + " FROM pairs")
def w05_float_blending(spark, d):
    """Each frame on the one before, by one of five modes in turn, in single precision."""
    pairs = px.frame_pairs(px.frames(px.tiles(spark, d)))
    unit = lambda c: (F.col(c).cast("float") / F.lit(255.0).cast("float")).cast("float")
    over, under = {c: unit(c) for c in "argb"}, {c: unit(f"p{c}") for c in "argb"}
    made = [derived.blended(m, under, over) for m in ("replace", "add", "multiply", "weighted", "blend")]
    out = []
    for c in "argb":
        value = made[0][c]
        for i in range(1, 5):
            value = F.when(F.col("frame_idx") % 5 == i, made[i][c]).otherwise(value)
        out.append(F.floor(value.cast("double") * 4096).alias(c))
    return pairs.select("anim_id", "frame_idx", "x", "y", *out)


@query(TILES + """, f AS (SELECT unnest(range(16)) AS t), p AS (SELECT t, least(greatest((t + 0.5) / 2 - 0.5, 0), 7)::DOUBLE AS pos FROM f),
  c AS (SELECT t, floor(pos)::BIGINT AS lo, least(floor(pos) + 1, 7)::BIGINT AS hi, pos - floor(pos) AS w FROM p)
  SELECT q.img_id, cx.t AS x, cy.t AS y, """ + ", ".join(
    f"floor((q.{c} * (1 - cx.w) + s.{c} * cx.w) * (1 - cy.w) + (u.{c} * (1 - cx.w) + v.{c} * cx.w) * cy.w + 0.5)::BIGINT AS {c}" for c in "argb") + """
  FROM c cx, c cy, tiles q JOIN tiles s ON q.img_id = s.img_id JOIN tiles u ON q.img_id = u.img_id JOIN tiles v ON q.img_id = v.img_id
  WHERE q.x = cx.lo AND q.y = cy.lo AND s.x = cx.hi AND s.y = cy.lo AND u.x = cx.lo AND u.y = cy.hi AND v.x = cx.hi AND v.y = cy.hi""")
def w14_resampled(spark, d):
    """Images of 8x8 scaled to 16x16 bilinearly."""
    return derived.resampled(px.tiles(spark, d), 8, 8, 16, 16)
