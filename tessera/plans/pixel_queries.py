"""Relational queries on the tile images, each beside the SQL that states it independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import pixel_math as pm
from tessera.operators import pixels as px

TILES = """
WITH u AS (SELECT vec_id AS img_id, label AS anim_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS e FROM embeddings),
q AS (SELECT img_id, CAST(anim_id AS BIGINT) AS anim_id, CAST(i AS BIGINT) AS i,
  CAST(floor((CAST(e AS DOUBLE) + 1.0) * 127.5) AS BIGINT) AS v FROM u),
tiles AS (SELECT img_id, anim_id, i % 8 AS x, i // 8 AS y,
  CAST(CASE WHEN (img_id + i) % 7 = 0 THEN 0 WHEN (img_id + i) % 5 = 0 THEN 128 ELSE 255 END AS BIGINT) AS a,
  v AS r, (v * 7 + i) % 256 AS g, (v * 13 + img_id) % 256 AS b FROM q)"""
FRAMES = TILES + """,
ord AS (SELECT anim_id, img_id, row_number() OVER (PARTITION BY anim_id ORDER BY img_id) - 1 AS frame_idx
  FROM (SELECT DISTINCT anim_id, img_id FROM tiles)),
frames AS (SELECT t.*, frame_idx FROM tiles t JOIN ord USING (anim_id, img_id)),
pairs AS (SELECT c.anim_id, c.frame_idx, c.x, c.y, c.a, c.r, c.g, c.b, p.a AS pa, p.r AS pr, p.g AS pg, p.b AS pb
  FROM frames c JOIN frames p ON c.anim_id = p.anim_id AND c.frame_idx = p.frame_idx + 1 AND c.x = p.x AND c.y = p.y)"""

_made: dict[str, tuple] = {}


def query(sql: str):
    def add(f):
        _made[f.__name__] = (f, sql)
        return f

    return add


def queries():
    return {name: f for name, (f, _) in _made.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _made.items() if sql}


def _out(frame):
    return frame.select(*px.PIXEL)


def _turn_sql(x: str, y: str) -> str:
    return TILES + f" SELECT img_id, {x} AS x, {y} AS y, a, r, g, b FROM tiles"


@query(TILES + " SELECT img_id, x, y, a, r, g, b FROM tiles")
def r00_tiles(spark, d):
    return _out(px.tiles(spark, d))


@query(_turn_sql("7 - y", "x"))
def t01_rotate90(spark, d):
    return _out(px.turn(px.tiles(spark, d), "rotate90", 8, 8))


@query(_turn_sql("7 - x", "7 - y"))
def t02_rotate180(spark, d):
    return _out(px.turn(px.tiles(spark, d), "rotate180", 8, 8))


@query(_turn_sql("y", "7 - x"))
def t03_rotate270(spark, d):
    return _out(px.turn(px.tiles(spark, d), "rotate270", 8, 8))


@query(TILES + " SELECT img_id, 'h' AS axis, 7 - x AS x, y, a, r, g, b FROM tiles UNION ALL SELECT img_id, 'v', x, 7 - y, a, r, g, b FROM tiles")
def t04_flip(spark, d):
    t = px.tiles(spark, d)
    sides = [px.turn(t, f"flip_{n}", 8, 8).withColumn("axis", F.lit(n[0])).select("axis", *px.PIXEL) for n in ("horizontal", "vertical")]
    return sides[0].unionByName(sides[1])


@query(TILES + " SELECT img_id, x - 2 AS x, y - 1 AS y, a, r, g, b FROM tiles WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4")
def t05_crop(spark, d):
    return _out(px.crop(px.tiles(spark, d), 2, 1, 5, 4, 8, 8))


@query(_turn_sql("y", "x"))
def t06_transpose(spark, d):
    return _out(px.turn(px.tiles(spark, d), "transpose", 8, 8))


@query(_turn_sql("7 - y", "7 - x"))
def t07_transverse(spark, d):
    return _out(px.turn(px.tiles(spark, d), "transverse", 8, 8))


@query(TILES + """ SELECT img_id, img_id % 10 AS orientation,
  CASE img_id % 10 WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y WHEN 8 THEN y ELSE x END AS x,
  CASE img_id % 10 WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 7 - x WHEN 8 THEN 7 - x ELSE y END AS y,
  a, r, g, b FROM tiles""")
def t08_oriented(spark, d):
    t = px.tiles(spark, d).withColumn("orientation", F.col("img_id") % 10)
    return px.orient(t, "orientation", 8, 8).select("orientation", *px.PIXEL)


@query(TILES + " SELECT img_id, a, r, g, b FROM tiles WHERE x = 3 AND y = 5")
def t09_pixel_at(spark, d):
    return px.tiles(spark, d).where("x = 3 and y = 5").select("img_id", "a", "r", "g", "b")


@query(TILES + " SELECT img_id, bool_or(a < 255) AS has_transparency, bool_and(r = g AND g = b) AS is_gray FROM tiles GROUP BY img_id")
def t10_t11_flags(spark, d):
    return px.image_flags(px.tiles(spark, d))


@query(TILES + """, s AS (SELECT img_id, x, y, unnest([0, 1, 2, 3]) AS c, unnest([r, g, b, a]) * 257 AS v FROM tiles)
  SELECT img_id, x, y, c, v, v // 256 AS high FROM s""")
def t12_t13_widen_and_narrow(spark, d):
    t = px.tiles(spark, d).selectExpr("img_id", "x", "y", "stack(4, 0, r, 1, g, 2, b, 3, a) as (c, s)")
    return t.select("img_id", "x", "y", "c", (F.col("s") * 257).alias("v"), pm.div(F.col("s") * 257, F.lit(256)).alias("high"))


SIZES = "SELECT o_orderkey AS k, 1 + o_orderkey % 5000 AS w, 1 + (o_orderkey * 7919) % 4000 AS h, 1 + o_custkey % 900 AS mw, 1 + (o_custkey * 31) % 700 AS mh FROM orders"


def _sizes(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(k.alias("k"), (1 + k % 5000).alias("w"), (1 + (k * 7919) % 4000).alias("h"), (1 + c % 900).alias("mw"), (1 + (c * 31) % 700).alias("mh"))


@query(f"WITH s AS ({SIZES}) " + """SELECT k, k % 10 AS o, CASE WHEN k % 10 BETWEEN 1 AND 8 THEN k % 10 ELSE 1 END AS valid,
  CASE WHEN k % 10 BETWEEN 5 AND 8 THEN h ELSE w END AS display_w, CASE WHEN k % 10 BETWEEN 5 AND 8 THEN w ELSE h END AS display_h FROM s""")
def t14_orientation_rules(spark, d):
    s = _sizes(spark, d).withColumn("o", F.col("k") % 10)
    swap = pm.swaps_axes(pm.valid_orientation("o"))
    return s.select("k", "o", pm.valid_orientation("o").cast("bigint").alias("valid"), F.when(swap, F.col("h")).otherwise(F.col("w")).alias("display_w"),
                    F.when(swap, F.col("w")).otherwise(F.col("h")).alias("display_h"))


FIT = f"""WITH s AS ({SIZES}), f AS (SELECT *,
  CASE WHEN w <= mw AND h <= mh THEN w WHEN mw * h <= mh * w THEN mw ELSE greatest(1, w * mh // h) END AS fw,
  CASE WHEN w <= mw AND h <= mh THEN h WHEN mw * h <= mh * w THEN greatest(1, h * mw // w) ELSE mh END AS fh FROM s)"""


@query(FIT + " SELECT k, w, h, mw, mh, fw, fh FROM f")
def a01_fitted_size(spark, d):
    fw, fh = pm.fitted("w", "h", "mw", "mh")
    return _sizes(spark, d).withColumns({"fw": fw, "fh": fh})


@query(FIT + """ SELECT k, fw, fh, CASE WHEN (w + 7) // 8 >= fw AND (h + 7) // 8 >= fh THEN 8 WHEN (w + 3) // 4 >= fw AND (h + 3) // 4 >= fh THEN 4
  WHEN (w + 1) // 2 >= fw AND (h + 1) // 2 >= fh THEN 2 ELSE 1 END AS reduction FROM f""")
def a07_reduction(spark, d):
    s = a01_fitted_size(spark, d)
    return s.select("k", "fw", "fh", pm.reduction_for("w", "h", "fw", "fh").alias("reduction"))


@query(f"WITH s AS ({SIZES}) " + """SELECT k, greatest(1, floor(w * least(1.0, mw / w::DOUBLE)))::BIGINT AS target FROM s""")
def a08_target_side(spark, d):
    share = F.least(F.lit(1.0), F.col("mw") / F.col("w"))
    return _sizes(spark, d).select("k", F.greatest(F.lit(1), F.floor(F.col("w") * share)).cast("bigint").alias("target"))


def _by_alpha_sql(inner: str) -> str:
    colours = ", ".join(f"CASE WHEN sa = 0 THEN 0 ELSE (s{c} + sa // 2) // sa END AS {c}" for c in "rgb")
    return f"{inner} SELECT img_id, x, y, (sa + n // 2) // n AS a, {colours} FROM s"


def _reduce_sql(r: int) -> str:
    return _by_alpha_sql(TILES + f""", s AS (SELECT img_id, x // {r} AS x, y // {r} AS y, sum(a)::BIGINT AS sa, count(*) AS n,
  sum(r * a)::BIGINT AS sr, sum(g * a)::BIGINT AS sg, sum(b * a)::BIGINT AS sb FROM tiles GROUP BY ALL)""")


def _scale_sql(w: int, h: int) -> str:
    return _by_alpha_sql(TILES + f""", s AS (SELECT img_id, bx.d AS x, by_.d AS y, sum(wx * wy * a)::BIGINT AS sa, sum(wx * wy)::BIGINT AS n,
  sum(wx * wy * a * r)::BIGINT AS sr, sum(wx * wy * a * g)::BIGINT AS sg, sum(wx * wy * a * b)::BIGINT AS sb
  FROM (SELECT t.*, bx.d AS dx, by_.d AS dy, least((x + 1) * {w}, (bx.d + 1) * 8) - greatest(x * {w}, bx.d * 8) AS wx,
      least((y + 1) * {h}, (by_.d + 1) * 8) - greatest(y * {h}, by_.d * 8) AS wy, bx, by_
    FROM tiles t JOIN (SELECT unnest(range({w})) AS d) bx ON x * {w} < (bx.d + 1) * 8 AND (x + 1) * {w} > bx.d * 8
    JOIN (SELECT unnest(range({h})) AS d) by_ ON y * {h} < (by_.d + 1) * 8 AND (y + 1) * {h} > by_.d * 8) GROUP BY ALL)""")


@query(_scale_sql(3, 3))
def a02_scaled_into_box(spark, d):
    return px.downscale(px.tiles(spark, d), 8, 8, 3, 3)  # an 8x8 image into a 3x5 box is 3x3


@query(_scale_sql(5, 3))
def a03_downscaled_5x3(spark, d):
    return px.downscale(px.tiles(spark, d), 8, 8, 5, 3)


@query(FRAMES.replace("tiles AS (SELECT", "tiles AS (SELECT") + """ SELECT anim_id, frame_idx, f.x // 4 AS x, f.y // 4 AS y, (sum(a)::BIGINT + 8) // 16 AS a
  FROM frames f GROUP BY ALL""")
def a04_animation_scaled(spark, d):
    fr = px.frames(px.tiles(spark, d))
    small = px.reduce_by(fr, 4).join(fr.select("img_id", "anim_id", "frame_idx").distinct(), "img_id")
    return small.select("anim_id", "frame_idx", "x", "y", "a")


@query(_reduce_sql(2))
def a05_reduced_by_2(spark, d):
    return px.reduce_by(px.tiles(spark, d), 2)


@query(_reduce_sql(3))
def a05_reduced_by_3(spark, d):
    return px.reduce_by(px.tiles(spark, d), 3)


@query(TILES + """ SELECT img_id, x // 2 AS x, y // 2 AS y, (sum(r)::BIGINT + count(*) // 2) // count(*) AS c, (sum(g)::BIGINT + count(*) // 2) // count(*) AS m,
  (sum(b)::BIGINT + count(*) // 2) // count(*) AS ye, (sum(255 - a)::BIGINT + count(*) // 2) // count(*) AS k FROM tiles GROUP BY ALL""")
def a06_ink_reduced(spark, d):
    t = px.tiles(spark, d).withColumn("k0", 255 - F.col("a"))
    n = F.count(F.lit(1))
    sums = [pm.rounded(F.sum(c), n).alias(o) for c, o in (("r", "c"), ("g", "m"), ("b", "ye"), ("k0", "k"))]
    return t.groupBy("img_id", pm.div("x", F.lit(2)).alias("x"), pm.div("y", F.lit(2)).alias("y")).agg(*sums)


@query(FRAMES + """, o AS (SELECT *, a * 255 + pa * (255 - a) AS den FROM pairs) SELECT anim_id, frame_idx, x, y,
  CASE WHEN a = 255 OR (a <> 0 AND pa = 0) THEN a WHEN a = 0 THEN pa ELSE (den + 127) // 255 END AS a,
  CASE WHEN a = 255 OR (a <> 0 AND pa = 0) THEN r WHEN a = 0 THEN pr ELSE (r * a * 255 + pr * pa * (255 - a) + den // 2) // den END AS r,
  CASE WHEN a = 255 OR (a <> 0 AND pa = 0) THEN g WHEN a = 0 THEN pg ELSE (g * a * 255 + pg * pa * (255 - a) + den // 2) // den END AS g,
  CASE WHEN a = 255 OR (a <> 0 AND pa = 0) THEN b WHEN a = 0 THEN pb ELSE (b * a * 255 + pb * pa * (255 - a) + den // 2) // den END AS b FROM o""")
def w01_source_over(spark, d):
    pairs = px.frame_pairs(px.frames(px.tiles(spark, d)))
    over = pm.source_over({c: F.col(c) for c in "argb"}, {c: F.col(f"p{c}") for c in "argb"})
    return pairs.select("anim_id", "frame_idx", "x", "y", *(v.alias(c) for c, v in over.items()))


@query(FRAMES + "".join([" SELECT anim_id, frame_idx, x, y"] + [
    f", coalesce(last_value(CASE WHEN a > 0 THEN {c} END IGNORE NULLS) OVER w, 0) AS {c}" for c in "argb"]) +
    " FROM frames WINDOW w AS (PARTITION BY anim_id, x, y ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def w02_composite(spark, d):
    return px.composite_opaque(px.frames(px.tiles(spark, d)))


EVENTS = "WITH e AS (SELECT user_id AS anim, event_id AS f, event_id % 12 AS cs, (event_id % 12) * 10 AS ms, event_id % 4 AS den FROM events)"


def _events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id")
    return e.select(F.col("user_id").alias("anim"), k.alias("f"), (k % 12).alias("cs"), ((k % 12) * 10).alias("ms"), (k % 4).alias("den"))


@query(EVENTS + """ SELECT f, CASE WHEN cs <= 1 THEN 100 ELSE cs * 10 END AS gif_ms, CASE WHEN ms <= 10 THEN 100 ELSE ms END AS other_ms,
  (ms + 5) // 10 AS raw_cs, CASE WHEN cs * 1000 // (CASE WHEN den = 0 THEN 100 ELSE den END) <= 10 THEN 100
  ELSE cs * 1000 // (CASE WHEN den = 0 THEN 100 ELSE den END) END AS apng_ms FROM e""")
def w06_w07_delays(spark, d):
    e, hundred = _events(spark, d), F.lit(100)
    num = pm.div(F.col("cs") * 1000, F.when(F.col("den") == 0, hundred).otherwise(F.col("den")))
    return e.select("f", pm.frame_delay("cs").alias("gif_ms"), F.when(F.col("ms") <= 10, hundred).otherwise(F.col("ms")).alias("other_ms"),
                    pm.div(F.col("ms") + 5, F.lit(10)).alias("raw_cs"), F.when(num <= 10, hundred).otherwise(num).alias("apng_ms"))


@query(EVENTS + " SELECT f, CASE WHEN cs = 0 THEN 0 WHEN cs = 11 THEN 1 ELSE cs + 1 END AS plays FROM e")
def w08_loop_count(spark, d):
    cs = F.col("cs")  # 11 stands for a file without the extension
    return _events(spark, d).select("f", F.when(cs == 0, F.lit(0)).when(cs == 11, F.lit(1)).otherwise(cs + 1).alias("plays"))


@query(EVENTS + " SELECT anim, least(sum(CASE WHEN cs <= 1 THEN 100 ELSE cs * 10 END)::BIGINT, 2147483647) AS duration_ms FROM e GROUP BY anim")
def w09_duration(spark, d):
    total = F.least(F.sum(pm.frame_delay("cs")), F.lit(2147483647).cast("bigint"))
    return _events(spark, d).groupBy("anim").agg(total.alias("duration_ms"))


@query(EVENTS + """, s AS (SELECT *, sum(CASE WHEN cs <= 1 THEN 100 ELSE cs * 10 END) OVER (PARTITION BY anim ORDER BY f)::BIGINT AS e,
  sum(CASE WHEN cs <= 1 THEN 100 ELSE cs * 10 END) OVER (PARTITION BY anim)::BIGINT AS total FROM e)
  SELECT anim, CASE WHEN (anim * 37 + 500) // total >= 2 THEN max(f) ELSE min(f) FILTER (e > (anim * 37 + 500) % total) END AS frame FROM s GROUP BY anim, total""")
def w10_frame_at(spark, d):
    timed = px.schedule(_events(spark, d).withColumn("delay", pm.frame_delay("cs")), "anim", "f", "delay")
    return px.frame_at(timed, "anim", "f", F.col("anim") * 37 + 500, F.lit(2).cast("bigint"))


@query(FRAMES + " SELECT img_id, anim_id, frame_idx, x, y, a, r, g, b FROM frames WHERE frame_idx < 3")
def w11_max_frames(spark, d):
    return px.frames(px.tiles(spark, d)).where("frame_idx < 3").select("anim_id", "frame_idx", *px.PIXEL)


@query(FRAMES + """, z AS (SELECT *, a = pa AND r = pr AND g = pg AND b = pb AS same FROM pairs)
  SELECT anim_id, frame_idx, coalesce(min(x) FILTER (NOT same), 0) AS x0, coalesce(min(y) FILTER (NOT same), 0) AS y0,
  coalesce(max(x) FILTER (NOT same), 0) - coalesce(min(x) FILTER (NOT same), 0) + 1 AS w,
  coalesce(max(y) FILTER (NOT same), 0) - coalesce(min(y) FILTER (NOT same), 0) + 1 AS h,
  count(*) FILTER (NOT same) AS changed, bool_and(same OR a = 255) AS over_is_exact FROM z GROUP BY ALL""")
def w12_w13_changed_box(spark, d):
    return px.changed_boxes(px.frames(px.tiles(spark, d)))


@query(TILES + """, f AS (SELECT img_id, x, y, (r << 20) + 524288 AS yy, g - 128 AS cb, b - 128 AS cr FROM tiles)
  SELECT img_id, x, y, greatest(0, least(255, (yy + cr * 1470208) >> 20)) AS r,
  greatest(0, least(255, (yy - cr * 748800 + ((cb * -360960) - ((cb * -360960) % 65536 + 65536) % 65536)) >> 20)) AS g,
  greatest(0, least(255, (yy + cb * 1858048) >> 20)) AS b FROM f""")
def c14_ycbcr(spark, d):
    rgb = pm.ycbcr_to_rgb("r", "g", "b")
    return px.tiles(spark, d).select("img_id", "x", "y", *(v.alias(c) for c, v in rgb.items()))


@query(TILES + "".join([" SELECT img_id, x, y"] + [f", ({c} * a + 128 + (({c} * a + 128) >> 8)) >> 8 AS {c}" for c in "rgb"]) + " FROM tiles")
def c15_multiply(spark, d):
    return px.tiles(spark, d).select("img_id", "x", "y", *(pm.multiply_255(c, "a").alias(c) for c in "rgb"))


@query(TILES + " SELECT img_id, x, y, (77 * r + 150 * g + 29 * b) >> 8 AS luma FROM tiles")
def c16_luma(spark, d):
    return px.tiles(spark, d).select("img_id", "x", "y", pm.luma("r", "g", "b").alias("luma"))


@query(TILES + " SELECT img_id, r, g, b, count(*) AS n, row_number() OVER (PARTITION BY img_id ORDER BY r, g, b) - 1 AS palette_idx FROM tiles GROUP BY img_id, r, g, b")
def e06_histogram(spark, d):
    return px.histogram(px.tiles(spark, d))


@query(FRAMES + """ SELECT anim_id, frame_idx, sum((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb))::BIGINT AS squared,
  count(*) * 3 AS samples FROM pairs GROUP BY ALL""")
def q02_squared_error(spark, d):
    return px.squared_error(px.frames(px.tiles(spark, d)))


@query(f"WITH s AS ({SIZES}) " + """SELECT k, w * 60 AS w, h * 60 AS h, mw * 50 AS bytes, 1 + mh AS frames,
  w * h * 3600 <= least(268435456, greatest(1048576, mw * 50 * 4096)) AS fits, w * h * 3600 <= 268435456 AS fits_absolute,
  w * h * 3600 <= least(268435456, greatest(1048576, mw * 50 * 4096)) // (1 + mh) AS frames_fit FROM s""")
def b01_b02_budget(spark, d):
    s = _sizes(spark, d).select("k", (F.col("w") * 60).alias("w"), (F.col("h") * 60).alias("h"), (F.col("mw") * 50).alias("bytes"), (1 + F.col("mh")).alias("frames"))
    return s.withColumns({"fits": pm.fits_budget("w", "h", "bytes"), "fits_absolute": F.col("w") * F.col("h") <= pm.MAX_PIXELS,
                          "frames_fit": pm.frames_fit("w", "h", "frames", "bytes")})


@query(TILES + " SELECT img_id, x, y, sum(r) OVER (PARTITION BY img_id, y ORDER BY x)::BIGINT % 256 AS r FROM tiles")
def r16_predictor(spark, d):
    return px.running_sum_mod256(px.tiles(spark, d), "r").select("img_id", "x", "y", "r")


@query(TILES + " SELECT img_id, x, y, r FROM tiles")
def r16_predictor_round_trip(spark, d):
    t = px.tiles(spark, d)
    return px.running_sum_mod256(px.difference_mod256(t, "r"), "r").select("img_id", "x", "y", "r")


#: The first bytes of each format.
MAGICS = [
    ("PNG", "89504E470D0A1A0A"), ("JPEG", "FFD8FFE0"), ("GIF", "474946383961"), ("WEBP", "524946460000000057454250"), ("TIFF", "49492A00"),
    ("JXR", "4949BC01"), ("JP2", "FF4FFF51"), ("JXL", "FF0A"), ("AVIF", "0000001466747970617669660000000061766966"), ("BMP", "424D"),
]


@query("SELECT doc_id, CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(MAGICS)) + " END AS format FROM documents")
def s01_sniff(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    head = F.when(F.lit(False), F.lit(b""))
    for i, (_, magic) in enumerate(MAGICS):
        head = head.when(F.col("doc_id") % 11 == i, F.unhex(F.lit(magic)))
    content = F.concat(head.otherwise(F.lit(b"")), F.col("text").cast("binary"))
    return docs.select("doc_id", pm.sniff(content).alias("format"))


@query(f"WITH s AS ({SIZES}) SELECT k, w, h FROM s")
def s06_s09_fixed_headers(spark, d):
    s = _sizes(spark, d)
    be = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), *(F.unhex(F.lpad(F.hex(c), 8, "0")) for c in ("w", "h")))
    return s.select("k", be.alias("png")).select("k", pm.big_endian("png", 16, 4).alias("w"), pm.big_endian("png", 20, 4).alias("h"))
