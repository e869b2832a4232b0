"""Raster queries over the synthetic pictures, each with its DuckDB form where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixloom.functions import color
from pixloom.functions.color import RGB
from pixloom.operators import bandcodec, bands, diffuse, geometry, highcolor, histogram, palette, quantize, validate
from pixloom.operators.geometry import Crop
from pixloom.plans.bridge import PIX_SQL, SIDE, frames, pixels
from pixloom.sources import sniff, writers
from pixloom.sources.loader import decode_files

Query = Callable[[SparkSession, str], DataFrame]

#: Eight corners of the colour cube moved inwards: a fixed palette for the index queries.
CUBE_8 = [(r, g, b) for r in (64, 192) for g in (64, 192) for b in (64, 192)]


def _cols(*names: str) -> list:
    return [F.col(n) for n in names]


def _long(df: DataFrame) -> DataFrame:
    """Whole numbers as long, as DuckDB's side gives them."""
    return df.select(*[F.col(n).cast("long").alias(n) if t in ("int", "tinyint", "smallint") else F.col(n) for n, t in df.dtypes])


def _digest(df: DataFrame, *names: str) -> DataFrame:
    """Per picture: rows, sums, and sums weighted by the place of the pixel."""
    place = F.col("y") * 1009 + F.col("x") * 31 + 1
    aggs = [F.count("*").alias("n")]
    for n in names:
        aggs += [F.sum(n).alias(f"{n}_sum"), F.sum(F.col(n) * place).alias(f"{n}_placed")]
    return df.groupBy("image_id").agg(*aggs)


def _digest_sql(source: str, *names: str, ctes: str = "") -> str:
    parts = ["count(*) AS n"]
    for n in names:
        parts += [f"CAST(sum({n}) AS BIGINT) AS {n}_sum", f"CAST(sum({n} * (y * 1009 + x * 31 + 1)) AS BIGINT) AS {n}_placed"]
    return f"WITH {PIX_SQL}{ctes} SELECT image_id, {', '.join(parts)} FROM {source} GROUP BY image_id"


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# --- projections ---------------------------------------------------------------

_WORDS = ("RGB555", "RGB565", "BGR555", "BGR565")


def _word_sql(kind: str) -> str:
    s, m, u = (11, 63, 2) if kind.endswith("565") else (10, 31, 3)
    high, mid, low = f"((w >> {s}) & 31) << 3", f"((w >> 5) & {m}) << {u}", "(w & 31) << 3"
    a, b = (high, low) if kind.startswith("RGB") else (low, high)
    return f"SELECT image_id, '{kind}' AS kind, y, x, {a} AS r2, {mid} AS g2, {b} AS b2 FROM words"


@query("p1_unpack_words", f"WITH {PIX_SQL}, words AS (SELECT *, r * 256 + g AS w FROM pix), made AS ("
       + " UNION ALL ".join(map(_word_sql, _WORDS)) + """)
SELECT image_id, kind, CAST(sum(r2) AS BIGINT) AS r_sum, CAST(sum(g2) AS BIGINT) AS g_sum, CAST(sum(b2) AS BIGINT) AS b_sum,
       CAST(sum(r2 * (y * 8 + x + 1)) AS BIGINT) AS r_placed FROM made GROUP BY image_id, kind""")
def p1_unpack_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.col("r") * 256 + F.col("g")
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), *[v.cast("long").alias(c) for c, v in zip(RGB, color.unpack16(word, k))]) for k in _WORDS
    ])
    made = pixels(spark, sf_dir).select("image_id", "y", "x", F.explode(kinds).alias("p")).select("image_id", "y", "x", "p.*")
    return made.groupBy("image_id", "kind").agg(
        *[F.sum(c).alias(f"{c}_sum") for c in RGB], F.sum(F.col("r") * (F.col("y") * 8 + F.col("x") + 1)).alias("r_placed")
    )


@query("p2_reorder_bytes", _digest_sql("(SELECT image_id, y, x, b AS r, r AS g, g AS b FROM pix)", *RGB))
def p2_reorder_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The bytes of a pixel in store order are alpha, g, r, b read as "AGRB"-like ABGR: g -> blue, r -> green, b -> red.
    made = color.reorder([F.lit(0), F.col("g"), F.col("r"), F.col("b")], "ABGR8888")
    return _digest(pixels(spark, sf_dir).select("image_id", "y", "x", *[v.alias(c) for c, v in zip(RGB, made)]), *RGB)


@query("p5_unpack_bits", f"""WITH {PIX_SQL}, cut AS (
  SELECT image_id, y, x * (8 // d.bits) + k AS x, d.bits, (r >> (8 - d.bits - k * d.bits)) & ((1 << d.bits) - 1) AS v
  FROM pix, (VALUES (1), (2), (4)) d(bits), range(0, 8) t(k) WHERE k < 8 // d.bits)
SELECT image_id, CAST(bits AS BIGINT) AS bits, count(*) AS n, CAST(sum(v) AS BIGINT) AS v_sum,
       CAST(sum(v * (y * 1009 + x * 31 + 1)) AS BIGINT) AS v_placed FROM cut GROUP BY image_id, bits""")
def p5_unpack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = [F.struct(F.lit(bits).cast("long").alias("bits"), F.lit(k).alias("k"), color.sub_pixel(F.col("r"), F.lit(k), bits).cast("long").alias("v"))
            for bits in (1, 2, 4) for k in range(8 // bits)]
    cut = pixels(spark, sf_dir).select("image_id", "y", "x", F.explode(F.array(*cuts)).alias("c")).select("image_id", "y", "x", "c.*")
    made = cut.withColumn("x", F.col("x") * F.call_function("div", F.lit(8), F.col("bits")) + F.col("k"))
    place = F.col("y") * 1009 + F.col("x") * 31 + 1
    return made.groupBy("image_id", "bits").agg(F.count("*").alias("n"), F.sum("v").alias("v_sum"), F.sum(F.col("v") * place).alias("v_placed"))


#: Pixel formats by how their 64 bytes (the red samples of a picture, in order) are cut into one row of pixels.
_LETTERS = ("RGB888", "BGR888", "RGBA8888", "ARGB8888", "BGRA8888", "ABGR8888", "AG88", "GA88", "G8")
_PACKED = ("G1", "G2", "G4", "PAL1", "PAL2", "PAL4", "PAL8")


def _normal_sql(kind: str) -> str:
    letters, n = kind.rstrip("0123456789"), color.BYTES_PER_PIXEL.get(kind, 1)
    if kind in _WORDS:
        s, m, u = (11, 63, 2) if kind.endswith("565") else (10, 31, 3)
        word = "(v[2 * k + 1] * 256 + v[2 * k + 2])"
        parts = [f"(({word} >> {s}) & 31) << 3", f"(({word} >> 5) & {m}) << {u}", f"({word} & 31) << 3"]
        return f"SELECT image_id, '{kind}' AS kind, 'RGB888' AS made, [{', '.join(parts if letters == 'RGB' else parts[::-1])}] AS p, k FROM bytes, range(32) t(k)"
    if kind in _LETTERS:
        at = [letters.index("G")] * 3 if "R" not in letters else [letters.index(c) for c in "RGB"]
        parts = ", ".join(f"v[{n} * k + {i + 1}]" for i in at)
        return f"SELECT image_id, '{kind}' AS kind, 'RGB888' AS made, [{parts}] AS p, k FROM bytes, range({64 // n}) t(k)"
    bits, made = int(kind.lstrip("GPAL")), "PAL8" if kind.startswith("PAL") else "G8"
    per = 8 // bits
    return f"SELECT image_id, '{kind}', '{made}', [(v[k // {per} + 1] >> (8 - {bits} - k % {per} * {bits})) & {(1 << bits) - 1}], k FROM bytes, range({64 * per}) t(k)"


@query("p4_normalise", f"WITH {PIX_SQL}, bytes AS (SELECT image_id, list(r ORDER BY y, x) AS v FROM pix GROUP BY image_id), made AS ("
       + " UNION ALL ".join(_normal_sql(k) for k in (*_WORDS, *_LETTERS, *_PACKED)) + """),
flat AS (SELECT image_id, kind, made, k * len(p) + j - 1 AS place, p[j] AS value, len(p) AS planes FROM made, range(1, 4) t(j) WHERE j <= len(p))
SELECT image_id, kind, made, count(*) // any_value(planes) AS width, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * (place + 1)) AS BIGINT) AS placed
FROM flat GROUP BY image_id, kind, made""")
def p4_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixloom.sources.pixelformat import raw_frames

    kinds = (*_WORDS, *_LETTERS, *_PACKED)
    pixels_of = {k: 64 // color.BYTES_PER_PIXEL[k] if k in color.BYTES_PER_PIXEL else 64 * 8 // color.BITS_PER_PIXEL[k] for k in kinds}
    forms = F.array(*[F.struct(F.lit(k).alias("pixelformat"), F.lit(n).alias("width")) for k, n in pixels_of.items()])
    # Every third byte of a packed picture is a red sample.
    red = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.hex(F.substring("pixels", i * 3 + 1, F.lit(1)))), ""))
    raw = frames(spark, sf_dir).select("image_id", red.alias("pixels"), F.explode(forms).alias("form")).select(
        F.concat_ws("/", F.col("image_id").cast("string"), "form.pixelformat").alias("source"), "form.width", F.lit(1).alias("height"),
        "form.pixelformat", "pixels", F.lit(None).cast("binary").alias("palette"),
    )
    made = raw_frames(raw, expand=False)
    flat = made.select(
        F.split("source", "/")[0].cast("long").alias("image_id"), F.split("source", "/")[1].alias("kind"), F.col("pixelformat").alias("made"),
        F.col("width").cast("long").alias("width"), F.posexplode(F.transform(
            F.sequence(F.lit(1), F.octet_length("pixels")), lambda i: F.conv(F.hex(F.substring("pixels", i, F.lit(1))), 16, 10).cast("long")
        )).alias("at", "value"),
    )
    return flat.groupBy("image_id", "kind", "made", "width").agg(F.sum("value").alias("total"), F.sum(F.col("value") * (F.col("at") + 1)).alias("placed"))


@query("p7_blend_alpha", _digest_sql(
    "(SELECT image_id, y, x, (r * a + 16 * (255 - a)) >> 8 AS r, (g * a + 32 * (255 - a)) >> 8 AS g, (b * a + 48 * (255 - a)) >> 8 AS b "
    "FROM (SELECT *, (r + g + b) % 256 AS a FROM pix))", *RGB))
def p7_blend_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    alpha = (F.col("r") + F.col("g") + F.col("b")) % 256
    px = pixels(spark, sf_dir).withColumn("a", alpha)
    return _digest(px.select("image_id", "y", "x", *[color.over(F.col(c), F.col("a"), F.lit(v)).alias(c) for c, v in zip(RGB, (16, 32, 48))]), *RGB)


@query("p9_percent_round_trip", _digest_sql(
    "(SELECT image_id, y, x, (r * 100 + 127) // 255 AS p, (((r * 100 + 127) // 255) * 255 + 50) // 100 AS back FROM pix)", "p", "back"))
def p9_percent_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).select("image_id", "y", "x", color.to_percent(F.col("r")).alias("p"))
    return _digest(px.withColumn("back", color.from_percent(F.col("p"))), "p", "back")


_HLS = """, span AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM pix),
hls AS (SELECT image_id, y, x, CASE WHEN hi = lo THEN 0 WHEN r = hi THEN 120 + (g - b) * 60 // (hi - lo)
  WHEN g = hi THEN 240 + (b - r) * 60 // (hi - lo) WHEN r < g THEN 360 + (r - g) * 60 // (hi - lo) ELSE (r - g) * 60 // (hi - lo) END AS h,
  ((hi + lo) * 100 + 255) // 510 AS l, CASE WHEN hi = lo THEN 0 WHEN ((hi + lo) * 100 + 255) // 510 < 50 THEN (hi - lo) * 100 // (hi + lo)
  ELSE (hi - lo) * 100 // (510 - hi - lo) END AS s FROM span)"""


@query("p11_rgb_to_hls", _digest_sql("hls", "h", "l", "s", ctes=_HLS))
def p11_rgb_to_hls(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = color.rgb_to_hls(*_cols(*RGB))
    return _digest(pixels(spark, sf_dir).select("image_id", "y", "x", *[v.alias(n) for n, v in zip("hls", made)]), "h", "l", "s")


_BACK = _HLS + """, ends AS (SELECT *, (h + 240) % 360 AS hue, s * (1.0::DOUBLE - abs(l / 50.0::DOUBLE - 1.0)) / 2.0 AS half FROM hls),
sides AS (SELECT *, l + half AS hi, l - half AS lo, hue // 60 AS k FROM ends),
ramps AS (SELECT *, lo + (hi - lo) * ((hue - k * 60) / 60.0::DOUBLE) AS up, lo + (hi - lo) * (((k + 1) * 60 - hue) / 60.0::DOUBLE) AS down FROM sides),
rgb2 AS (SELECT image_id, y, x,
  (CAST(trunc(CASE k WHEN 0 THEN hi WHEN 1 THEN down WHEN 2 THEN lo WHEN 3 THEN lo WHEN 4 THEN up ELSE hi END) AS BIGINT) * 255 + 50) // 100 AS r,
  (CAST(trunc(CASE k WHEN 0 THEN up WHEN 1 THEN hi WHEN 2 THEN hi WHEN 3 THEN down WHEN 4 THEN lo ELSE lo END) AS BIGINT) * 255 + 50) // 100 AS g,
  (CAST(trunc(CASE k WHEN 0 THEN lo WHEN 1 THEN lo WHEN 2 THEN up WHEN 3 THEN hi WHEN 4 THEN hi ELSE down END) AS BIGINT) * 255 + 50) // 100 AS b FROM ramps)"""


@query("p12_hls_to_rgb", _digest_sql("rgb2", *RGB, ctes=_BACK))
def p12_hls_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pixels(spark, sf_dir).select("image_id", "y", "x", *[v.alias(n) for n, v in zip("hls", color.rgb_to_hls(*_cols(*RGB)))])
    return _digest(made.select("image_id", "y", "x", *[v.alias(c) for c, v in zip(RGB, color.hls_to_rgb(*_cols(*"hls")))]), *RGB)


@query("p15_parse_colour", r"""WITH specs AS (
  SELECT o_orderkey, '#' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, CAST(3 * (1 + o_orderkey % 4) AS INTEGER)) AS spec FROM orders),
cut AS (SELECT o_orderkey, substr(spec, 2) AS d, (length(spec) - 1) // 3 AS w FROM specs)
SELECT o_orderkey, CASE WHEN w = 1 THEN 16 * CAST('0x' || substr(d, 1, 1) AS BIGINT) ELSE CAST('0x' || substr(d, 1, 2) AS BIGINT) END AS r,
  CASE WHEN w = 1 THEN 16 * CAST('0x' || substr(d, 2, 1) AS BIGINT) ELSE CAST('0x' || substr(d, w + 1, 2) AS BIGINT) END AS g,
  CASE WHEN w = 1 THEN 16 * CAST('0x' || substr(d, 3, 1) AS BIGINT) ELSE CAST('0x' || substr(d, 2 * w + 1, 2) AS BIGINT) END AS b FROM cut""")
def p15_parse_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    digits = F.substr(F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.lit(1), (3 * (1 + F.col("o_orderkey") % 4)).cast("int"))
    return orders.select("o_orderkey", color.parse_colour(F.concat(F.lit("#"), digits)).alias("c")).select("o_orderkey", "c.r", "c.g", "c.b")


_SIZED = ("G1", "G2", "G4", "PAL1", "RGB888", "BGRA8888", "RGB565", "G8")


@query("p16_frame_bytes", """WITH s AS (SELECT o_orderkey, o_orderkey % 97 + 1 AS w, o_orderkey % 53 AS h FROM orders)
SELECT o_orderkey, k.kind, CASE WHEN k.bits < 8 THEN ((w * k.bits + 7) // 8) * h ELSE w * (k.bits // 8) * h END AS bytes
FROM s, (VALUES ('G1', 1), ('G2', 2), ('G4', 4), ('PAL1', 1), ('RGB888', 24), ('BGRA8888', 32), ('RGB565', 16), ('G8', 8)) k(kind, bits)""")
def p16_frame_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 97 + 1).alias("w"), (F.col("o_orderkey") % 53).alias("h"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), color.frame_bytes(k, F.col("w"), F.col("h")).cast("long").alias("bytes")) for k in _SIZED])
    return sizes.select("o_orderkey", F.explode(kinds).alias("k")).select("o_orderkey", "k.kind", "k.bytes")


# --- filters -------------------------------------------------------------------


@query("f1_crop", _digest_sql("(SELECT image_id, y - 1 AS y, x - 2 AS x, r FROM pix WHERE x >= 2 AND x < 7 AND y >= 1 AND y < 5)", "r"))
def f1_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(geometry.crop(pixels(spark, sf_dir), Crop(5, 4, 2, 1), SIDE, SIDE), "r")


@query("f2_systematic_sample", f"WITH {PIX_SQL} SELECT image_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM "
       "(SELECT image_id, y * 300000 + x AS pos FROM pix) WHERE pos % (300000 * 8 // 18383) = 0 GROUP BY image_id")
def f2_systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The pictures stand in the left columns of a raster 300000 pixels wide, so that the stride is more than one.
    return histogram.sampled(pixels(spark, sf_dir), 300_000, SIDE).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


# --- aggregations ----------------------------------------------------------------

_HIST = """, hist AS (SELECT image_id, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS bucket, least(count(*), 65535) AS n, min(y * 8 + x) AS first_pos
  FROM pix GROUP BY ALL), coloured AS (SELECT *, (bucket >> 10) * 8 AS r, ((bucket >> 5) & 31) * 8 AS g, (bucket & 31) * 8 AS b FROM hist)"""


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(histogram.sampled(pixels(spark, sf_dir), SIDE, SIDE))


@query("a1_color_histogram", f"WITH {PIX_SQL}{_HIST} SELECT image_id, bucket, n, first_pos FROM hist")
def a1_color_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_hist(spark, sf_dir))


@query("a2_dominant_colors", f"""WITH {PIX_SQL}{_HIST}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bucket) AS rank, count(*) OVER (PARTITION BY image_id) AS colours FROM coloured)
SELECT image_id, rank, bucket, n, r, g, b, colours FROM ranked WHERE rank <= 3""")
def a2_dominant_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = _hist(spark, sf_dir).withColumn("colours", F.count("*").over(Window.partitionBy("image_id")))
    return histogram.dominant(histogram.with_colour(hist), 3).select("image_id", "rank", "bucket", "n", *RGB, "colours")


def _box_sql() -> str:
    spread = {c: f"(max({c}) - min({c}))" for c in RGB}
    top = f"greatest({', '.join(spread.values())})"
    lum = {c: f"({spread[c]} * CAST({w} AS DOUBLE))" for c, w in zip(RGB, ("0.2989", "0.5866", "0.1145"))}
    ltop = f"greatest({', '.join(lum.values())})"
    parts = ["count(*) AS colours", "CAST(sum(n) AS BIGINT) AS n"]
    parts += [f"{e}({c}) AS {c}_{e}" for c in RGB for e in ("min", "max")]
    for name, v, best in (("by_norm", spread, top), ("by_luminosity", lum, ltop)):
        parts.append(f"CAST(CASE WHEN {v['r']} = {best} THEN 0 WHEN {v['g']} = {best} THEN 1 ELSE 2 END AS BIGINT) AS {name}")
    for c in RGB:
        parts += [f"(min({c}) + max({c})) // 2 AS {c}_center", f"CAST(sum({c}) // count(*) AS BIGINT) AS {c}_mean", f"CAST(sum({c} * n) // sum(n) AS BIGINT) AS {c}_pixel_mean"]
    return f"WITH {PIX_SQL}{_HIST} SELECT image_id, {', '.join(parts)} FROM coloured GROUP BY image_id"


@query("a3_box_statistics", _box_sql())
def a3_box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.box_stats(_hist(spark, sf_dir))


@query("w3_median_split", f"""WITH {PIX_SQL}{_HIST}, ranked AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY image_id) AS size, sum(n) OVER (PARTITION BY image_id) AS total,
         coalesce(sum(n) OVER (PARTITION BY image_id ORDER BY g, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM coloured WINDOW w AS (PARTITION BY image_id ORDER BY g, bucket))
SELECT image_id, bucket, n, i = 1 OR (before < total // 2 AND i < size) AS lower FROM ranked""")
def w3_median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.median_split(_hist(spark, sf_dir), "g")


# --- palettes --------------------------------------------------------------------

_CUBE_SQL = ", cube(i, pr, pg, pb) AS (VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(CUBE_8)) + ")"


def _nearest_sql(source: str, weight: int = 1) -> str:
    return f""", near AS (SELECT image_id, y, x, arg_min(i, ((r - pr) * (r - pr) * {weight} + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 1000 + i) AS idx
  FROM {source}, cube GROUP BY ALL)"""


@query("j1_palette_expand", _digest_sql("(SELECT image_id, y, x, pr AS r, pg AS g, pb AS b FROM near JOIN cube ON i = idx)", *RGB, ctes=_CUBE_SQL + _nearest_sql("pix")))
def j1_palette_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = quantize.quantize(pixels(spark, sf_dir), CUBE_8)
    # One row with a palette for each picture: an array of at most 256 colours.
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"))
    colours = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(p, RGB)]) for p in CUBE_8])
    return _digest(quantize.expand(indexed, ids.select("image_id", colours.alias("palette"))), *RGB)


@query("j2_nearest_color", _digest_sql("near", "idx", ctes=_CUBE_SQL + _nearest_sql("pix", 2)))
def j2_nearest_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(quantize.quantize(pixels(spark, sf_dir), CUBE_8, red_weight=2), "idx")


@query("j3_nearest_by_bucket", _digest_sql("cached", "idx", ctes=_CUBE_SQL + """, keyed AS (SELECT *, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS bucket FROM pix),
firsts AS (SELECT image_id, bucket, arg_min(r, y * 8 + x) AS r, arg_min(g, y * 8 + x) AS g, arg_min(b, y * 8 + x) AS b FROM keyed GROUP BY ALL),
found AS (SELECT image_id, bucket, arg_min(i, ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 1000 + i) AS idx FROM firsts, cube GROUP BY ALL),
cached AS (SELECT k.image_id, y, x, idx FROM keyed k JOIN found f ON k.image_id = f.image_id AND k.bucket = f.bucket)"""))
def j3_nearest_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(quantize.nearest_by_bucket(histogram.sampled(pixels(spark, sf_dir), SIDE, SIDE), CUBE_8), "idx")


@query("j4_two_colors", _digest_sql("(SELECT image_id, y, x, CAST(r + g + b >= 256 AS BIGINT) AS dark, CAST(r + g + b < 256 AS BIGINT) AS light FROM pix)", "dark", "light"))
def j4_two_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("r") + F.col("g") + F.col("b")
    return _digest(pixels(spark, sf_dir).select("image_id", "y", "x", quantize.mono_index(total).alias("dark"), quantize.mono_index(total, True).alias("light")), "dark", "light")


def _mask_sql(kind: str) -> str:
    made = []
    for k, c in enumerate(RGB):
        mask = f"((((x + {k * 67}) + y * 236) * 119) & 255) / 128.0::DOUBLE - 1" if kind == "additive" else f"((xor(x + {k * 29}, y * 149) * 1234) & 511) / 256.0::DOUBLE - 1"
        made.append(f"greatest(0, least(255, CAST(trunc({c} + ({mask}) * 32) AS BIGINT))) AS {c}")
    return f", toned AS (SELECT image_id, y, x, {', '.join(made)} FROM pix)"


for _kind, _name in (("additive", "d6_ordered_additive"), ("xor", "d7_ordered_xor")):
    query(_name, _digest_sql("near", "idx", ctes=_CUBE_SQL + _mask_sql(_kind) + _nearest_sql("toned")))(
        lambda spark, sf_dir, kind=_kind: _digest(quantize.quantize(pixels(spark, sf_dir), CUBE_8, kind), "idx")
    )


@query("a8_palette_compaction", f"""WITH {PIX_SQL}{_CUBE_SQL}{_nearest_sql("pix")}, used AS (SELECT image_id, idx, min(y * 8 + x) AS first FROM near GROUP BY ALL)
SELECT image_id, CAST(idx AS BIGINT) AS idx, row_number() OVER (PARTITION BY image_id ORDER BY first) - 1 AS new_idx FROM used""")
def a8_palette_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.renumbered(quantize.quantize(pixels(spark, sf_dir), CUBE_8), SIDE)


_BASIC_SQL = "[0, 128, 0, 128, 0, 128, 0, 192, 128, 255, 0, 255, 0, 255, 0, 255]", "[0, 0, 128, 128, 0, 0, 128, 192, 128, 0, 255, 255, 0, 0, 255, 255]", "[0, 0, 0, 0, 128, 128, 128, 192, 128, 0, 0, 0, 255, 255, 255, 255]"
_VT_SQL = "[20, 80, 20, 80, 20, 80, 53, 26, 33, 60, 33, 60, 33, 60, 80, 0]", "[20, 13, 80, 20, 80, 80, 53, 26, 33, 26, 60, 33, 60, 60, 80, 0]", "[80, 13, 20, 80, 80, 20, 53, 26, 60, 26, 33, 60, 60, 33, 80, 0]"
_STEPS_SQL = "[0, 95, 135, 175, 215, 255]"


@query("d15_builtin_palettes", f"""WITH gray AS (
  SELECT 'gray' || b.bits AS name, v AS idx, v * 255 // ((1 << bits) - 1) AS level FROM (VALUES (1), (2), (4), (8)) b(bits), range(256) t(v) WHERE v < (1 << b.bits)),
basic AS (SELECT i AS idx, {_BASIC_SQL[0]}[i + 1] AS r, {_BASIC_SQL[1]}[i + 1] AS g, {_BASIC_SQL[2]}[i + 1] AS b FROM range(16) t(i)),
made AS (
  SELECT name, idx, level AS r, level AS g, level AS b FROM gray
  UNION ALL SELECT 'mono', v, 255 * v, 255 * v, 255 * v FROM range(2) t(v)
  UNION ALL SELECT 'monolight', v, 255 * (1 - v), 255 * (1 - v), 255 * (1 - v) FROM range(2) t(v)
  UNION ALL SELECT 'xterm16', * FROM basic
  UNION ALL SELECT 'xterm256', * FROM basic
  UNION ALL SELECT 'xterm256', 16 + i, {_STEPS_SQL}[i // 36 + 1], {_STEPS_SQL}[i // 6 % 6 + 1], {_STEPS_SQL}[i % 6 + 1] FROM range(216) t(i)
  UNION ALL SELECT 'xterm256', 232 + i, 8 + 10 * i, 8 + 10 * i, 8 + 10 * i FROM range(24) t(i)
  UNION ALL SELECT 'vt340mono', i, p * 255 // 100, p * 255 // 100, p * 255 // 100
    FROM (SELECT i, [13, 26, 40, 6, 20, 33, 46, 0][i % 8 + 1] AS p FROM range(16) t(i))
  UNION ALL SELECT 'vt340color', i, {_VT_SQL[0]}[i + 1] * 255 // 100, {_VT_SQL[1]}[i + 1] * 255 // 100, {_VT_SQL[2]}[i + 1] * 255 // 100 FROM range(16) t(i))
SELECT name, CAST(idx AS BIGINT) AS idx, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM made""")
def d15_builtin_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, i, *c) for name in quantize.BUILTIN for i, c in enumerate(quantize.builtin_palette(name))]
    return spark.createDataFrame(rows, "name string, idx long, r long, g long, b long")


# --- resampling ------------------------------------------------------------------


@query("r0_nearest", _digest_sql("(SELECT p.image_id, ty AS y, tx AS x, r, g, b FROM pix p JOIN range(0, 13) a(tx) ON p.x = tx * 8 // 13 JOIN range(0, 5) d(ty) ON p.y = ty * 8 // 5)", *RGB))
def r0_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(geometry.resize(pixels(spark, sf_dir), SIDE, SIDE, 13, 5, "nearest"), *RGB)


_KERNEL_SQL = {
    "bilinear": ("CASE WHEN d < 1 THEN 1 - d ELSE 0 END", 1),
    "welsh": ("CASE WHEN d < 1 THEN 1 - d * d ELSE 0 END", 1),
    "bicubic": ("CASE WHEN d <= 1 THEN (d - 2) * d * d + 1 WHEN d <= 2 THEN 4 + d * (d * (5 - d) - 8) ELSE 0 END", 2),
    "gaussian": ("exp(d * d * -2) * sqrt(2 / pi())", 1),
    "hanning": ("cos(d * pi()) * 0.5 + 0.5", 1),
    "hamming": ("cos(d * pi()) * 0.46::DOUBLE + 0.54::DOUBLE", 1),
} | {
    f"lanczos{n}": (f"CASE WHEN d = 0 THEN 1 WHEN d < {n} THEN (sin(pi() * d) / (pi() * d)) * (sin(pi() * d / {n}) / (pi() * d / {n})) ELSE 0 END", max(3, n))
    for n in (2, 3, 4)
}


def _axis_sql(name: str, to: int, kernel: str) -> str:
    weigh, n = _KERNEL_SQL[kernel]
    if to >= SIDE:
        center = f"(t + 0.5::DOUBLE) * {SIDE} / {to}"
        reach = f"s >= trunc(greatest(c - {n}, 0)) AND s <= trunc(least(c + {n}, {SIDE - 1}))"
        off = "s + 0.5::DOUBLE - c"
    else:
        center = "t + 0.5::DOUBLE"
        reach = f"s >= greatest(floor((c - {n}) * {SIDE} / {to}), 0) AND s <= least(floor((c + {n}) * {SIDE} / {to}), {SIDE - 1})"
        off = f"(s + 0.5::DOUBLE) * {to} / {SIDE} - c"
    return f""", {name} AS (SELECT t, s, CAST({weigh} AS DOUBLE) AS w FROM (SELECT t, s, abs({off}) AS d FROM
  (SELECT t, s, {center} AS c FROM range(0, {to}) a(t), range(0, {SIDE}) b(s)) WHERE {reach}))"""


def _resize_sql(kernel: str, to_width: int, to_height: int) -> str:
    ctes = _axis_sql("ax", to_width, kernel) + _axis_sql("ay", to_height, kernel) + f""", sums AS (
  SELECT image_id, ay.t AS y, ax.t AS x, sum(ax.w * ay.w) AS total, {', '.join(f'sum({c} * ax.w * ay.w) AS {c}' for c in RGB)}
  FROM pix JOIN ax ON ax.s = pix.x JOIN ay ON ay.s = pix.y GROUP BY ALL),
scaled AS (SELECT image_id, y, x, {', '.join(f'greatest(0, least(255, CAST(floor(round({c} / total, 9)) AS BIGINT))) AS {c}' for c in RGB)} FROM sums WHERE total > 0)"""
    return _digest_sql("scaled", *RGB, ctes=ctes)


for _k, _kernel in enumerate(("bilinear", "welsh", "bicubic", "lanczos2", "lanczos3", "lanczos4", "gaussian", "hanning", "hamming")):
    _to = (12, 12) if _k % 2 == 0 else (5, 11)  # enlarging, and reducing along x
    query(f"r{_k + 1}_{_kernel}", _resize_sql(_kernel, *_to))(
        lambda spark, sf_dir, kernel=_kernel, to=_to: _digest(geometry.resize(pixels(spark, sf_dir), SIDE, SIDE, *to, kernel), *RGB)
    )


# --- bands and runs ----------------------------------------------------------------

_PLANES = _CUBE_SQL + _nearest_sql("pix") + ", planes AS (SELECT image_id, y // 6 AS band, idx, x, bit_or(1 << (y % 6)) AS bits FROM near GROUP BY ALL)"


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.quantize(pixels(spark, sf_dir), CUBE_8)


@query("a9_band_planes", f"WITH {PIX_SQL}{_PLANES} SELECT image_id, band, CAST(idx AS BIGINT) AS idx, x, CAST(bits AS BIGINT) AS bits FROM planes")
def a9_band_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.planes(_indexed(spark, sf_dir))


@query("w6_run_lengths", f"""WITH {PIX_SQL}{_CUBE_SQL}{_nearest_sql("pix")}, marked AS (
  SELECT *, CASE WHEN idx <> lag(idx) OVER (PARTITION BY image_id, y ORDER BY x) THEN 1 ELSE 0 END AS new FROM near),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY image_id, y ORDER BY x) AS run FROM marked)
SELECT image_id, y, min(x) AS start, CAST(min(idx) AS BIGINT) AS idx, count(*) AS n,
  CASE WHEN count(*) > 3 THEN '!' || count(*) || chr(CAST(63 + min(idx) AS INTEGER)) ELSE repeat(chr(CAST(63 + min(idx) AS INTEGER)), count(*)) END AS text
FROM numbered GROUP BY image_id, y, run""")
def w6_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.runs(_indexed(spark, sf_dir)).withColumn("text", bands.run_text(F.char(F.col("idx") + 63), F.col("n")))


@query("w7_band_intervals", f"""WITH {PIX_SQL}{_PLANES}, marked AS (
  SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY image_id, band, idx ORDER BY x) > 10 THEN 1 ELSE 0 END AS new FROM (SELECT * REPLACE (x * 5 AS x) FROM planes)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY image_id, band, idx ORDER BY x) AS island FROM marked),
nodes AS (SELECT image_id, band, CAST(idx AS BIGINT) AS idx, min(x) AS sx, max(x) + 1 AS mx FROM numbered GROUP BY image_id, band, idx, island)
SELECT *, row_number() OVER (PARTITION BY image_id, band ORDER BY sx, mx DESC, idx) AS place FROM nodes""")
def w7_band_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Columns stand five apart, so that two that are missing between two others part an interval.
    wide = bands.planes(_indexed(spark, sf_dir)).withColumn("x", F.col("x") * 5)
    return bands.drawing_order(bands.intervals(wide))


@query("c2_palette_text", f"""WITH {PIX_SQL}, colours AS (SELECT image_id, x AS idx, r, g, b FROM pix WHERE y = 0)
SELECT image_id, string_agg('#' || idx || ';2;' || ((r * 100 + 127) // 255) || ';' || ((g * 100 + 127) // 255) || ';' || ((b * 100 + 127) // 255), '' ORDER BY idx) AS palette_text
FROM colours GROUP BY image_id""")
def c2_palette_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.palette_text(pixels(spark, sf_dir).where("y = 0").select("image_id", F.col("x").alias("idx"), *RGB))


# --- order-dependent operators: recursive SQL where it can say them; tests hold all against plain models --------


def _with_palettes(spark: SparkSession, sf_dir: str, colours: int) -> DataFrame:
    return frames(spark, sf_dir).join(palette.median_cut(_hist(spark, sf_dir), colours), "image_id")


def _median_cut_sql(wanted: int) -> str:
    """Box by box: the first box of several colours is cut at its median, then boxes go by weight."""
    weight = "list_sum(list_transform(x, lambda e: e.n))"
    sample = "CASE plane WHEN 0 THEN e.r WHEN 1 THEN e.g ELSE e.b END"
    spread = {c: f"(list_max(list_transform(boxes[spot], lambda e: e.{c})) - list_min(list_transform(boxes[spot], lambda e: e.{c})))" for c in RGB}
    middle = {c: f"(list_min(list_transform(x, lambda e: e.{c})) + list_max(list_transform(x, lambda e: e.{c}))) // 2" for c in RGB}
    level = ", ".join(f"'{c}': CAST({m} AS BIGINT)" for c, m in middle.items())
    return f"""WITH RECURSIVE {PIX_SQL}{_HIST}, cut AS (
  SELECT image_id, 1 AS k, CAST(len(entries) AS BIGINT) AS before, CASE WHEN len(entries) <= {wanted} THEN list_transform(entries, lambda e: [e]) ELSE [entries] END AS boxes
  FROM (SELECT image_id, list({{'r': r, 'g': g, 'b': b, 'n': n}} ORDER BY first_pos) AS entries FROM coloured GROUP BY image_id)
  UNION ALL
  SELECT image_id, k + 1, before, list_transform(list_sort(list_transform(
      list_append(list_transform(boxes, lambda x, i: CASE WHEN i = spot THEN own[1:half] ELSE x END), own[half + 1:]),
      lambda x, i: {{'lighter': -{weight}, 'place': i, 'entries': x}})), lambda x: x.entries)
  FROM (SELECT *, least(len(own) - 1, list_position(list_transform(running, lambda v: v >= running[len(running)] // 2), true)) AS half
    FROM (SELECT *, list_transform(range(1, len(own) + 1), lambda j: list_sum(list_transform(own[1:j], lambda e: e.n))) AS running
      FROM (SELECT *, list_transform(list_sort(list_transform(boxes[spot], lambda e: {{'first': {sample}, 'r': e.r, 'g': e.g, 'b': e.b, 'n': e.n}})),
                                     lambda e: {{'r': e.r, 'g': e.g, 'b': e.b, 'n': e.n}}) AS own
        FROM (SELECT *, CASE WHEN {spread["r"]} >= {spread["g"]} AND {spread["r"]} >= {spread["b"]} THEN 0 WHEN {spread["g"]} >= {spread["b"]} THEN 1 ELSE 2 END AS plane
          FROM (SELECT *, list_position(list_transform(boxes, lambda x: len(x) > 1), true) AS spot FROM cut WHERE len(boxes) < {wanted}) WHERE spot > 0))))),
palettes AS (SELECT image_id, list_transform(arg_max(boxes, k), lambda x: {{{level}}}) AS cube, max(before) AS origcolors FROM cut GROUP BY image_id)
"""


@query("w4_median_cut", _median_cut_sql(8) + """SELECT image_id, array_to_string(list_transform(cube, lambda c: printf('%02x%02x%02x', c.r, c.g, c.b)), '') AS palette,
       CAST(len(cube) AS BIGINT) AS ncolors, origcolors FROM palettes""")
def w4_median_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.median_cut(_hist(spark, sf_dir), 8).withColumn("palette", F.lower(F.hex("palette")))


def _with_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures with one palette of eight colours, more than which they have."""
    colours = bytes(v for c in CUBE_8 for v in c)
    return frames(spark, sf_dir).select("*", F.lit(colours).alias("palette"), F.lit(8).cast("long").alias("ncolors"), F.lit(99).cast("long").alias("origcolors"))


def _cube_palettes_sql() -> str:
    cube = "[" + ", ".join(f"{{'r': {r}, 'g': {g}, 'b': {b}}}" for r, g, b in CUBE_8) + "]"
    return f"WITH RECURSIVE {PIX_SQL}, palettes AS (SELECT DISTINCT image_id, {cube} AS cube, 99 AS origcolors FROM pix)"


def _diffusion_sql(kernel: str, palettes: str | None = None) -> str:
    """Pixel by pixel: the lists of samples, with the answers so far and those that 15-bit buckets keep."""
    spreads = {
        "floyd-steinberg": "pos % 8 < 7 AND pos // 8 < 7", "atkinson": "pos // 8 < 6", "jarvis": "pos < 6 * 8 - 2", "stucki": "pos < 6 * 8 - 2", "burkes": "pos < 7 * 8 - 2",
    }[kernel]

    def moved(c: str) -> str:
        error = f"({c}s[pos + 1] - cube[best + 1].{c})"
        cases = " ".join(
            f"WHEN i = pos + {1 + down * 8 + right} THEN greatest(0, least(255, v + sign({error}) * (abs({error}) * {num} // {den})))"
            for down, right, num, den in diffuse.KERNELS[kernel]
        )
        return f"CASE WHEN spread AND {spreads} THEN list_transform({c}s, lambda v, i: CAST(CASE {cases} ELSE v END AS BIGINT)) ELSE {c}s END"

    return f"""{palettes or _cube_palettes_sql()}, step AS (
  SELECT image_id, 0 AS pos, list(r ORDER BY y, x) AS rs, list(g ORDER BY y, x) AS gs, list(b ORDER BY y, x) AS bs, [CAST(0 AS BIGINT)][:0] AS idx,
         [CAST(0 AS BIGINT)][:0] AS keys, any_value(cube) AS cube, any_value(origcolors) > len(any_value(cube)) AS spread
  FROM pix JOIN palettes USING (image_id) GROUP BY image_id
  UNION ALL
  SELECT image_id, pos + 1, {moved("r")}, {moved("g")}, {moved("b")}, list_append(idx, best), list_append(keys, key), cube, spread
  FROM (SELECT *, CASE WHEN list_position(keys, key) > 0 THEN idx[list_position(keys, key)] ELSE CAST(list_position(away, list_min(away)) - 1 AS BIGINT) END AS best
        FROM (SELECT *, (rs[pos + 1] >> 3 << 10) | (gs[pos + 1] >> 3 << 5) | (bs[pos + 1] >> 3) AS key,
                     list_transform(cube, lambda c: (rs[pos + 1] - c.r) * (rs[pos + 1] - c.r) + (gs[pos + 1] - c.g) * (gs[pos + 1] - c.g) + (bs[pos + 1] - c.b) * (bs[pos + 1] - c.b)) AS away
              FROM step WHERE pos < 64))),
done AS (SELECT image_id, idx, cube, array_to_string(list_transform(idx, lambda v: printf('%02x', v)), '') AS indices FROM step WHERE pos = 64)
"""


for _k, _kernel in enumerate(diffuse.KERNELS):
    if _kernel != "none":
        query(f"d{_k}_{_kernel.replace('-', '_')}", _diffusion_sql(_kernel) + "SELECT image_id, indices, CAST(8 AS BIGINT) AS ncolors FROM done")(
            lambda spark, sf_dir, kernel=_kernel: diffuse.diffuse_frames(_with_cube(spark, sf_dir), kernel).select(
                "image_id", F.lower(F.hex("indices")).alias("indices"), "ncolors"
            )
        )


# Band by band and sweep by sweep: what starts behind the pen is drawn, what starts before it waits for the next sweep.  No picture is
# wider than a gap, so a colour is one island of a band.
_STREAM_SQL = """, islands AS (
  SELECT image_id, band, {'s': list_position(list_transform(bits, lambda v: v > 0), true) - 1, 'e': 8 - list_position(list_reverse(list_transform(bits, lambda v: v > 0)), true) + 1,
                          'c': c, 'bits': bits} AS node
  FROM (SELECT image_id, band, c, list_transform(range(8), lambda x: list_sum(list_transform(range(CASE band WHEN 0 THEN 6 ELSE 2 END),
          lambda row: CASE WHEN idx[(band * 6 + row) * 8 + x + 1] = c THEN 1 << row ELSE 0 END))) AS bits
        FROM (SELECT image_id, idx, band, unnest(range(len(cube))) AS c FROM (SELECT image_id, idx, cube, unnest(range(2)) AS band FROM done)))
  WHERE list_sum(bits) > 0),
bands AS (SELECT image_id, band, list(node ORDER BY node.s, node.e DESC, node.c) AS nodes FROM islands GROUP BY image_id, band),
pen AS (
  SELECT image_id, 0 AS band, a.nodes AS todo, a.nodes[:0] AS later, b.nodes AS second, CAST(0 AS BIGINT) AS x, CAST(-1 AS BIGINT) AS active, '' AS drawn, false AS ended
  FROM bands a JOIN bands b USING (image_id) WHERE a.band = 0 AND b.band = 1
  UNION ALL
  SELECT image_id, CASE WHEN busy OR again THEN band ELSE band + 1 END, CASE WHEN busy THEN todo[2:] WHEN again THEN later ELSE second END,
         CASE WHEN waits THEN list_append(later, node) WHEN busy THEN later ELSE later[:0] END, second,
         CASE WHEN waits THEN x WHEN busy THEN node.e ELSE 0 END, CASE WHEN busy AND NOT waits THEN node.c ELSE active END,
         drawn || CASE WHEN waits THEN ''
           WHEN busy THEN CASE WHEN node.c <> active THEN '#' || node.c ELSE '' END || array_to_string(list_transform(starts, lambda a, k:
             CASE WHEN coalesce(starts[k + 1], len(ink) + 1) - a > 3 THEN '!' || (coalesce(starts[k + 1], len(ink) + 1) - a) || chr(CAST(63 + ink[a] AS INTEGER))
                  ELSE repeat(chr(CAST(63 + ink[a] AS INTEGER)), coalesce(starts[k + 1], len(ink) + 1) - a) END), '')
           WHEN again THEN '$' WHEN band = 0 THEN '-' ELSE '' END,
         NOT busy AND NOT again AND band = 1
  FROM (SELECT *, list_filter(range(1, len(ink) + 1), lambda i: i = 1 OR ink[i] <> ink[i - 1]) AS starts
    FROM (SELECT *, todo[1] AS node, len(todo) > 0 AS busy, len(todo) > 0 AND todo[1].s < x AS waits, len(todo) = 0 AND len(later) > 0 AS again,
                 list_concat(list_transform(range(x, todo[1].s), lambda v: CAST(0 AS HUGEINT)), todo[1].bits[todo[1].s + 1:todo[1].e]) AS ink
          FROM pen WHERE NOT ended))),
streams AS (
  SELECT image_id, chr(27) || 'Pq"1;1;8;8' || array_to_string(list_transform(cube, lambda c, i:
           '#' || (i - 1) || ';2;' || (c.r * 100 + 127) // 255 || ';' || (c.g * 100 + 127) // 255 || ';' || (c.b * 100 + 127) // 255), '') || drawn || chr(27) || chr(92) AS stream
  FROM pen JOIN done USING (image_id) WHERE ended)
"""


@query("c3_encode_stream", _diffusion_sql("atkinson", _median_cut_sql(8)) + _STREAM_SQL + """SELECT image_id, CAST(length(stream) AS BIGINT) AS bytes, sha256(stream) AS sha256,
  CAST(NULL AS VARCHAR) AS message FROM streams""")
def c3_encode_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bandcodec.encode_frames(diffuse.diffuse_frames(_with_palettes(spark, sf_dir, 8)))
    return made.select("image_id", F.octet_length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("sha256"), "message")


# What is read back is what was written: indices, and colours in whole per cents.
@query("c10_decode_stream", _diffusion_sql("atkinson") + """SELECT image_id, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, indices,
  array_to_string(list_transform(cube, lambda c: printf('%02x%02x%02x', ((c.r * 100 + 127) // 255 * 255 + 50) // 100, ((c.g * 100 + 127) // 255 * 255 + 50) // 100, ((c.b * 100 + 127) // 255 * 255 + 50) // 100)), '') AS colours,
  CAST(NULL AS VARCHAR) AS message FROM done""")
def c10_decode_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bandcodec.decode_streams(bandcodec.encode_frames(diffuse.diffuse_frames(_with_cube(spark, sf_dir))))
    return back.select(
        "image_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.lower(F.hex("indices")).alias("indices"),
        F.lower(F.hex("registers")).alias("colours"), "message",
    )


def _high_sql(kernel: str) -> str:
    """15-bit dithering pixel by pixel, and the picture that the stream's whole per cents give back."""
    plus, low_rows, low_columns, shares = highcolor.KERNELS[kernel]

    def moved(c: str) -> str:
        lost = f"(({c}s[pos + 1] & 7) + {plus})"
        cases = " ".join(f"WHEN i = pos + {1 + down * 8 + right} THEN least(255, v + {lost} * {num} // {den})" for down, right, num, den in shares)
        return f"CASE WHEN pos % 8 < {8 - low_columns} AND pos // 8 < {8 - low_rows} THEN list_transform({c}s, lambda v, i: CAST(CASE {cases} ELSE v END AS BIGINT)) ELSE {c}s END"

    shown = ", ".join(f"((({c}s[i] >> 3 << 3) * 100 + 127) // 255 * 255 + 50) // 100" for c in RGB)
    return f"""WITH RECURSIVE {PIX_SQL}, step AS (
  SELECT image_id, 0 AS pos, list(r ORDER BY y, x) AS rs, list(g ORDER BY y, x) AS gs, list(b ORDER BY y, x) AS bs FROM pix GROUP BY image_id
  UNION ALL SELECT image_id, pos + 1, {moved("r")}, {moved("g")}, {moved("b")} FROM step WHERE pos < 64)
SELECT image_id, 8 AS width, 8 AS height, CAST(NULL AS VARCHAR) AS message,
       sha256(unhex(array_to_string(list_transform(range(1, 65), lambda i: printf('%02x%02x%02x', {shown})), ''))) AS pixels_sha256
FROM step WHERE pos = 64"""


@query("c7_high_color", _high_sql("floyd-steinberg"))
def c7_high_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = highcolor.encode_high_frames(frames(spark, sf_dir), "floyd-steinberg")
    back = decode_files(made.select(F.col("image_id").cast("string").alias("path"), F.col("data").alias("content")), reqcolours=0)
    return back.select(F.col("source").cast("long").alias("image_id"), "width", "height", "message", F.sha2("pixels", 256).alias("pixels_sha256"))


@query("k4_write_png", _diffusion_sql("atkinson") + """SELECT image_id, 8 AS width, 8 AS height,
  sha256(unhex(array_to_string(list_transform(idx, lambda v: printf('%02x%02x%02x', cube[v + 1].r, cube[v + 1].g, cube[v + 1].b)), ''))) AS pixels_sha256,
  CAST(NULL AS VARCHAR) AS message FROM done""")
def k4_write_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = writers.to_png(diffuse.diffuse_frames(_with_cube(spark, sf_dir)))
    back = decode_files(written.select(F.col("image_id").cast("string").alias("path"), F.col("png").alias("content")))
    return back.select(
        F.col("source").cast("long").alias("image_id"), F.col("width"), F.col("height"), F.sha2("pixels", 256).alias("pixels_sha256"), "message"
    )


@query("k2_macro_text", f"""WITH {PIX_SQL} SELECT image_id, chr(27) || 'P3;0;1!z' || lower(hex(CAST(image_id AS VARCHAR))) || chr(27) || chr(92) AS macro FROM pix GROUP BY image_id""")
def k2_macro_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"))
    return ids.select("image_id", bands.macro_text(F.col("image_id").cast("string").cast("binary"), 3).alias("macro"))


# --- sniffing, checks, small texts ---------------------------------------------------

#: Synthetic file beginnings by remainder of the order key, in hexadecimal.
_HEADS = (("bands", "1B50303B31712231"), ("pnm", "50360A"), ("jpeg", "FFD8FFE0"), ("png", "89504E470D0A1A0A"), ("gif", "474946383961"), ("bmp", "424D"), (None, "0A"), (None, "414243"))


@query("s4_format_sniff", "SELECT o_orderkey, v.kind AS format FROM orders JOIN (VALUES "
       + ", ".join(f"({i}, {'NULL' if k is None else repr(k)})" for i, (k, _) in enumerate(_HEADS)) + f") v(i, kind) ON o_orderkey % {len(_HEADS)} = v.i")
def s4_format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    head = F.element_at(F.array(*[F.lit(h) for _, h in _HEADS]), (F.col("o_orderkey") % len(_HEADS) + 1).cast("int"))
    return orders.select("o_orderkey", sniff.format_of(F.unhex(head)).alias("format"))


@query("f3_transparent_key", f"WITH {PIX_SQL}{_CUBE_SQL}{_nearest_sql('pix')} SELECT image_id, y // 6 AS band, CAST(idx AS BIGINT) AS idx, x, "
       "CAST(bit_or(1 << (y % 6)) AS BIGINT) AS bits FROM near WHERE idx <> 3 GROUP BY ALL")
def f3_transparent_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.planes(_indexed(spark, sf_dir), transparent=3)


@query("f5_validation", """SELECT o_orderkey, CASE WHEN w <= 0 OR h <= 0 THEN 'a side is not positive' WHEN w > 1000000 OR h > 1000000 THEN 'a side is too long'
  WHEN n < 2 OR n > 256 THEN 'a palette has 2 to 256 colours' END AS message,
  CAST(w <= 0 OR h <= 0 OR w > 1000000 OR h > 1000000 OR n < 2 OR n > 256 AS BIGINT) AS status
FROM (SELECT o_orderkey, o_orderkey % 5 AS w, (o_orderkey % 7) * 200000 AS h, o_orderkey % 300 AS n FROM orders)""")
def f5_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    sizes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", (key % 5).alias("width"), (key % 7 * 200_000).alias("height"), (key % 300).alias("ncolors")
    )
    return validate.with_status(sizes, ncolors="ncolors").select("o_orderkey", "message", "status")


@query("p13_bucket", _digest_sql("(SELECT image_id, y, x, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS bucket FROM pix)", "bucket"))
def p13_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pixels(spark, sf_dir).select("image_id", "y", "x", color.bucket15(*_cols(*RGB)).alias("bucket")), "bucket")


@query("a10_bounding_box", f"WITH {PIX_SQL}{_CUBE_SQL}{_nearest_sql('pix')} SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM near WHERE idx = 0 GROUP BY image_id")
def a10_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = _indexed(spark, sf_dir).where("idx = 0")
    return drawn.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


@query("c1_header_text", """SELECT o_orderkey, chr(27) || 'Pq"1;1;' || (o_orderkey % 97 + 1) || ';' || (o_orderkey % 53 + 1) AS header FROM orders""")
def c1_header_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", bands.header(key % 97 + 1, key % 53 + 1).alias("header"))
