"""Queries on pixels: reductions, statistics, pointwise functions, stretches, stencils and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, pixel, spectral
from ..operators import compose, geometry, kernels, lists, reduce, stencil, stretch
from ..sources.images import images, pixels, to_images, to_pixels
from .registry import query, r4, s4

KEYS = ["grp", "y", "x"]
IMG = ["image_id", "y", "x", "v"]


def _reduction(name: str, how: str) -> None:
    def f(spark, sf_dir):
        return reduce.reduce_pixels(pixels(spark, sf_dir), how)

    f.__name__ = name
    query(f"WITH {{px}} SELECT grp, y, x, {how}(v) AS v FROM px GROUP BY grp, y, x")(f)


for _how in ("avg", "min", "max", "median"):
    _reduction(f"pixel_{_how}_by_label", _how)


def _clip(keys: str, sigma: float, how: str) -> str:
    return f"""WITH {{px}}, s AS (SELECT {keys}, avg(v) AS m, stddev_pop(v) AS sd FROM px GROUP BY {keys})
SELECT {keys}, coalesce({how}(CASE WHEN abs(v - m) <= {sigma} * sd THEN v END), any_value(m)) AS v FROM px JOIN s USING ({keys}) GROUP BY {keys}"""


@query(_clip("grp, y, x", 1.0, "avg"))
def pixel_avg2_by_label(spark, sf_dir):
    return reduce.clipped(pixels(spark, sf_dir), KEYS, 1.0)


@query(_clip("grp, y, x", 1.0, "median"))
def pixel_median2_by_label(spark, sf_dir):
    return reduce.clipped(pixels(spark, sf_dir), KEYS, 1.0, "median")


@query(_clip("image_id", 1.5, "avg"))
def img_avg2(spark, sf_dir):
    return reduce.clipped(pixels(spark, sf_dir), ["image_id"], 1.5)


@query(_clip("image_id", 1.5, "median"))
def img_median2(spark, sf_dir):
    return reduce.clipped(pixels(spark, sf_dir), ["image_id"], 1.5, "median")


@query(f"WITH {{px}}, w AS (SELECT *, image_id % 5 + 1 AS w FROM px) SELECT grp, y, x, {s4('sum(w * v) / sum(w)')} AS v FROM w GROUP BY grp, y, x")
def weighted_avg_by_label(spark, sf_dir):
    out = reduce.weighted_avg(pixels(spark, sf_dir).withColumn("w", F.col("image_id") % 5 + 1))
    return out.withColumn("v", r4(F.col("v")))


@query(
    f"""WITH {{px}}, w AS (SELECT *, image_id % 5 + 1 AS w FROM px), m AS (SELECT grp, y, x, sum(w * v) / sum(w) AS m FROM w GROUP BY grp, y, x),
s AS (SELECT grp, y, x, sqrt(sum(w * (v - m) * (v - m)) / sum(w)) AS s FROM w JOIN m USING (grp, y, x) GROUP BY grp, y, x)
SELECT grp, y, x, {s4("coalesce(sum(CASE WHEN abs(v - m) <= 1.5 * s THEN w * v END) / sum(CASE WHEN abs(v - m) <= 1.5 * s THEN w END), any_value(m))")} AS v
FROM w JOIN m USING (grp, y, x) JOIN s USING (grp, y, x) GROUP BY grp, y, x"""
)
def weighted_avg2_by_label(spark, sf_dir):
    out = reduce.weighted_clipped_avg(pixels(spark, sf_dir).withColumn("w", F.col("image_id") % 5 + 1), 1.5)
    return out.withColumn("v", r4(F.col("v")))


@query(f"WITH {{px}} SELECT image_id, avg(v) AS mean, min(v) AS low, max(v) AS high, median(v) AS median, {s4('stddev_samp(v)')} AS sd, count(v) AS n FROM px GROUP BY image_id")
def img_stats(spark, sf_dir):
    return reduce.image_stats(pixels(spark, sf_dir)).withColumn("sd", r4(F.col("sd")))


@query(f"WITH {{px}} SELECT image_id, {s4('quantile_cont(v, 0.3)')} AS v FROM px GROUP BY image_id")
def img_percentile(spark, sf_dir):
    return reduce.image_percentile(pixels(spark, sf_dir), 30).withColumn("v", r4(F.col("v")))


@query("WITH {px} SELECT image_id, avg(v) AS mean, count(v) AS n FROM px WHERE v BETWEEN 30000 AND 36000 GROUP BY image_id")
def range_mask_avg(spark, sf_dir):
    out = reduce.image_stats(pixels(spark, sf_dir), pixel.value_range(30000, 36000)).filter("n > 0")
    return out.select("image_id", "mean", "n")


@query("WITH {px} SELECT image_id, avg(v) AS mean, median(v) AS median FROM px WHERE ((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5)) / 9.0 BETWEEN 0.25 AND 1 GROUP BY image_id")
def annulus_mask_avg(spark, sf_dir):
    return reduce.image_stats(pixels(spark, sf_dir), pixel.annulus(3.5, 3.5, 3.0, 0.5, 1.0)).select("image_id", "mean", "median")


@query("WITH {px} SELECT image_id, avg(v) AS mean FROM px WHERE NOT (v BETWEEN 30000 AND 36000) GROUP BY image_id")
def inverted_mask_avg(spark, sf_dir):
    return reduce.image_stats(pixels(spark, sf_dir), ~pixel.value_range(30000, 36000)).filter("n > 0").select("image_id", "mean")


@query("WITH {px} SELECT grp, y, avg(v) AS mean, min(v) AS low, max(v) AS high, count(*) AS n FROM px GROUP BY CUBE (grp, y)")
def stats_cube(spark, sf_dir):
    return reduce.statistics_cube(pixels(spark, sf_dir))


def _pointwise(name: str, column, sql: str) -> None:
    def f(spark, sf_dir):
        return pixels(spark, sf_dir).select("image_id", "y", "x", column(F.col("v")).alias("v"))

    f.__name__ = name
    query(f"WITH {{px}} SELECT image_id, y, x, {sql} AS v FROM px")(f)


_pointwise("clamp", lambda v: pixel.limit(v, 20000, 40000), "least(greatest(v, 20000), 40000)::DOUBLE")
_pointwise("scale_to_unit", lambda v: r4(pixel.scale_to_unit(v)), s4("least(greatest(v / 65535, 0), 1)"))
_pointwise("scale_from_unit", lambda v: pixel.scale_from_unit(v - 40000), "least(greatest((v - 40000) * 65535, 0), 65535)::DOUBLE")
_pointwise("pow_pixels", lambda v: r4(F.pow(v / 65535, F.lit(1.7))), s4("pow(v / 65535, 1.7)"))
_pointwise("exp_pixels", lambda v: r4(F.exp(v / 65535)), s4("exp(v / 65535)"))
_pointwise("log_pixels", lambda v: r4(pixel.log(v, 10.0)), s4("ln(v) / ln(10)"))
_pointwise("divide_pixels", lambda v: pixel.divide(v - 32767, v - 32768), "CASE WHEN v = 32768 THEN 'inf'::DOUBLE ELSE (v - 32767) / (v - 32768) END")
_pointwise("adjust_contrast", lambda v: pixel.adjust_contrast(v, 110, 150), "CASE WHEN v < 28160 THEN 0 WHEN v > 38400 THEN 38400 ELSE v END::DOUBLE")
_pointwise(
    "curve_transform",
    lambda v: r4(pixel.curve_transform(v, 30000, 35000)),
    s4("least(greatest(5000.0 / (30000.0 * 30000.0 - 30000.0 * 65535) * v * v + (1 - 5000.0 / (30000.0 * 30000.0 - 30000.0 * 65535) * 65535) * v, 0), 65535)"),
)
_pointwise("mtf", lambda v: r4(pixel.mtf(v, 100, 0.3, 200)), s4("65535 * CASE WHEN v <= 25600 THEN 0 WHEN v >= 51200 THEN 1 ELSE (0.3 - 1) * ((v - 25600) / 25600) / ((2 * 0.3 - 1) * ((v - 25600) / 25600) - 0.3) END"))
_pointwise(
    "sigmoid_stretch",
    lambda v: r4(pixel.sigmoid(v, 0.5, 8.0)),
    s4("least(greatest(65535 * (1 / (1 + exp(-8.0 * (v / 65535 - 0.5))) - 1 / (1 + exp(4.0))) / (1 / (1 + exp(-4.0)) - 1 / (1 + exp(4.0))), 0), 65535)"),
)
_pointwise("disk_fill", lambda v: F.when(pixel.within_disk(3.5, 3.5, 3.0), F.lit(0.0)).otherwise(v), "CASE WHEN (x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5) <= 9 THEN 0 ELSE v END::DOUBLE")
_pointwise("disk_mask", lambda v: F.when(pixel.within_disk(3.5, 3.5, 3.0), F.lit(1.0)).otherwise(F.lit(0.0)), "CASE WHEN (x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5) <= 9 THEN 1 ELSE 0 END::DOUBLE")
_pointwise("draw_rect", lambda v: F.when(pixel.on_rectangle(1, 2, 5, 4), F.lit(65535.0)).otherwise(v), "CASE WHEN x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 5 AND NOT (x BETWEEN 2 AND 4 AND y BETWEEN 3 AND 4) THEN 65535 ELSE v END::DOUBLE")
_pointwise("draw_circle", lambda v: F.when(pixel.on_circle(3.5, 3.5, 3.0), F.lit(65535.0)).otherwise(v), "CASE WHEN abs(sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5)) - 3) <= 0.5 THEN 65535 ELSE v END::DOUBLE")
_pointwise("draw_line", lambda v: F.when(pixel.on_segment(1, 1, 6, 1), F.lit(65535.0)).otherwise(v), "CASE WHEN y = 1 AND x BETWEEN 1 AND 6 THEN 65535 ELSE v END::DOUBLE")
_pointwise("asinh_pixels", lambda v: r4(pixel.asinh(v, 10000.0, 5.0)), s4("least(greatest(65535 * asinh(greatest(v - 10000, 0) / 65535 * 5) / asinh(5.0), 0), 65535)"))


def _stretch(name: str, operator, sql: str, exact: bool = True) -> None:
    def f(spark, sf_dir):
        out = operator(pixels(spark, sf_dir)).select(*IMG)
        return out if exact else out.withColumn("v", r4(F.col("v")))

    f.__name__ = name
    query(sql)(f)


_OWN = "WITH {px}, s AS (SELECT image_id, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_samp(v) AS sd FROM px GROUP BY image_id) SELECT image_id, y, x, %s AS v FROM px JOIN s USING (image_id)"
_stretch("invert", stretch.invert, _OWN % "hi - v")
_stretch("lift", lambda p: stretch.lift(p.withColumn("v", F.col("v") - 40000)), _OWN.replace("floor(", "floor(") % "v - 40000 - least(lo - 40000, 0)")
_stretch("linear_stretch", stretch.linear_stretch, _OWN % s4("CASE WHEN hi = lo THEN v ELSE 65535 / (hi - lo) * (v - lo) END"), False)
_stretch("range_expansion", stretch.range_expansion, _OWN % s4("v * (65535 / hi)"), False)
_stretch("adjust_gamma", lambda p: stretch.adjust_gamma(p, 0.7), _OWN % s4("pow(v / hi, 0.7) * 65535"), False)
_stretch(
    "asinh_stretch",
    lambda p: stretch.asinh_stretch(p, 10000.0, 5.0),
    "WITH {px}, a AS (SELECT image_id, y, x, least(greatest(65535 * asinh(greatest(v - 10000, 0) / 65535 * 5) / asinh(5.0), 0), 65535) AS v FROM px), s AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM a GROUP BY image_id) "
    f"SELECT image_id, y, x, {s4('65535 / (hi - lo) * (v - lo)')} AS v FROM a JOIN s USING (image_id)",
    False,
)
_stretch(
    "equalize",
    stretch.equalize,
    "WITH {px}, s AS (SELECT image_id, avg(v) AS m, stddev_samp(v) AS sd FROM px GROUP BY image_id), g AS (SELECT avg(m) AS gm, avg(sd) AS gs FROM s) "
    f"SELECT image_id, y, x, {s4('least(greatest((v - m) * (gs / sd) + gm, 0), 65535)')} AS v FROM px JOIN s USING (image_id), g",
    False,
)
_NEAR = "r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM px), q AS (SELECT image_id, max(v) FILTER (k = floor(0.05 * (n - 1) + 0.5)) AS p0, max(v) FILTER (k = floor(0.95 * (n - 1) + 0.5)) AS p1 FROM r GROUP BY image_id)"
_stretch("percentile_stretch", lambda p: stretch.percentile_stretch(p, 5, 95), f"WITH {{px}}, {_NEAR} SELECT image_id, y, x, {s4('least(greatest((v - p0) * (65535 / (p1 - p0)), 0), 65535)')} AS v FROM px JOIN q USING (image_id)", False)
_UNIT = "CASE WHEN {x} <= 0 THEN 0 WHEN {x} >= 1 THEN 1 ELSE ({m} - 1) * {x} / ((2 * {m} - 1) * {x} - {m}) END"
_stretch(
    "mtf_autostretch",
    stretch.mtf_autostretch,
    "WITH {px}, a AS (SELECT image_id, median(v) / 65535 AS med FROM px GROUP BY image_id), b AS (SELECT image_id, any_value(med) AS med, 1.4826 * median(abs(v / 65535 - med)) AS mad FROM px JOIN a USING (image_id) GROUP BY image_id), "
    f"c AS (SELECT image_id, least(greatest(med - 2.8 * mad, 0), 1) AS lo, med FROM b), d AS (SELECT image_id, lo, {_UNIT.format(x='(med - lo)', m='0.25')} AS mid FROM c) "
    f"SELECT image_id, y, x, {s4('65535 * ' + _UNIT.format(x='((v / 65535 - lo) / (1 - lo))', m='mid'))} AS v FROM px JOIN d USING (image_id)",
    False,
)


@query("WITH {px}, h AS (SELECT image_id, CAST(least(greatest(floor(v * 64 / 65535 + 0.5), 0), 63) AS INT) AS bin, count(*) AS n FROM px GROUP BY ALL) SELECT image_id, bin, n, sum(n) OVER (PARTITION BY image_id ORDER BY bin)::BIGINT AS cumulative FROM h")
def histogram_cdf(spark, sf_dir):
    return stretch.histogram(pixels(spark, sf_dir), 64)


def _clahe(tile: int, clip: float, bins: int = 64) -> str:
    """The clipped and running shares of each tile's histogram, and their blend between the centres of tiles."""
    n = 8 // tile
    return f"""b AS (SELECT *, least(floor(v * {bins} / 65536), {bins - 1}) AS b FROM px), c AS (SELECT image_id, y // {tile} AS ty, x // {tile} AS tx, b, count(*) AS n FROM b GROUP BY ALL),
f AS (SELECT t.image_id, t.ty, t.tx, g.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT image_id, ty, tx FROM c) t CROSS JOIN generate_series(0, {bins - 1}) g(b) LEFT JOIN c ON c.image_id = t.image_id AND c.ty = t.ty AND c.tx = t.tx AND c.b = g.b),
k AS (SELECT *, least(n, {clip} * t / {bins}) AS k FROM (SELECT *, sum(n) OVER (PARTITION BY image_id, ty, tx) AS t FROM f)),
s AS (SELECT image_id, ty, tx, b, sum(k + e) OVER (PARTITION BY image_id, ty, tx ORDER BY b) / t AS share FROM (SELECT *, (t - sum(k) OVER (PARTITION BY image_id, ty, tx)) / {bins} AS e FROM k)),
p AS (SELECT image_id, y, x, b, (y + 0.5) / {tile} - 0.5 AS fy, (x + 0.5) / {tile} - 0.5 AS fx FROM b),
w AS (SELECT image_id, y, x, b, least(greatest(floor(fy) + dy, 0), {n - 1}) AS ty, least(greatest(floor(fx) + dx, 0), {n - 1}) AS tx,
  (CASE dy WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE dx WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM p, (VALUES (0), (1)) i(dy), (VALUES (0), (1)) j(dx))
SELECT w.image_id, w.y, w.x, {s4("65535 * sum(w.w * s.share)")} AS v FROM w JOIN s ON s.image_id = w.image_id AND s.ty = w.ty AND s.tx = w.tx AND s.b = w.b GROUP BY w.image_id, w.y, w.x"""


@query("WITH {px}, " + _clahe(4, 2.0))
def clahe(spark, sf_dir):
    return stretch.clahe(images(spark, sf_dir), 8, 8, 4, 64, 2.0).withColumn("v", r4(F.col("v")))


_stretch("box_blur3", stencil.blur, f"WITH {{px}}, {{box}} SELECT image_id, y, x, {s4('least(greatest(s / 9, 0), 65535)')} AS v FROM box", False)
_stretch("sharpen3", stencil.sharpen, f"WITH {{px}}, {{box}} SELECT image_id, y, x, {s4('least(greatest(2 * v - (s - v) / 8, 0), 65535)')} AS v FROM box", False)
_stretch("unsharp_mask", lambda p: stencil.unsharp_mask(p, 0.5), f"WITH {{px}}, {{box}} SELECT image_id, y, x, {s4('v + 0.5 * (v - least(greatest(s / 9, 0), 65535))')} AS v FROM box", False)
_LAP = """lap AS (SELECT a.image_id, a.y, a.x, sum(b.v * (CASE WHEN dy = 0 THEN -2 ELSE 1 END) * (CASE WHEN dx = 0 THEN -2 ELSE 1 END)) AS r FROM px a, (VALUES (-1), (0), (1)) dy(dy), (VALUES (-1), (0), (1)) dx(dx), px b
  WHERE b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx AND a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY ALL)"""


@query(f"WITH {{px}}, {_LAP}, k AS (SELECT image_id, abs(r) AS r, row_number() OVER (PARTITION BY image_id ORDER BY abs(r)) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM lap WHERE r <> 0) SELECT image_id, {s4('1.4826 * r / 6')} AS sigma FROM k WHERE k = n // 2 + 1")
def noise_sigma(spark, sf_dir):
    return stencil.noise_sigma(pixels(spark, sf_dir)).withColumn("sigma", r4(F.col("sigma")))


@query(f"WITH {{px}}, {_LAP} SELECT image_id, {s4('avg(r * r)')} AS sharpness FROM lap GROUP BY image_id")
def sharpness(spark, sf_dir):
    return stencil.sharpness(pixels(spark, sf_dir)).withColumn("sharpness", r4(F.col("sharpness")))


@query(
    """WITH {px} SELECT a.image_id, a.y, a.x, (r.v - l.v) * (r.v - l.v) + (d.v - u.v) * (d.v - u.v) AS v FROM px a
JOIN px l ON l.image_id = a.image_id AND l.y = a.y AND l.x = greatest(a.x - 1, 0) JOIN px r ON r.image_id = a.image_id AND r.y = a.y AND r.x = least(a.x + 1, 7)
JOIN px u ON u.image_id = a.image_id AND u.x = a.x AND u.y = greatest(a.y - 1, 0) JOIN px d ON d.image_id = a.image_id AND d.x = a.x AND d.y = least(a.y + 1, 7)"""
)
def gradient(spark, sf_dir):
    return stencil.gradient(pixels(spark, sf_dir)).select(*IMG)


@query("WITH {px} SELECT a.image_id, a.y, a.x, sum(b.v) AS v FROM px a JOIN px b ON a.image_id = b.image_id AND b.y <= a.y AND b.x <= a.x GROUP BY ALL")
def integral_image(spark, sf_dir):
    return geometry.integral_image(pixels(spark, sf_dir)).select(*IMG)


@query(
    f"""WITH {{px}}, d AS (SELECT d, exp(-d * d / 2.0) AS w FROM generate_series(-2, 2) g(d))
SELECT a.image_id, a.y, a.x, {s4("sum(p.w * q.w * b.v) / (SELECT sum(w) * sum(w) FROM d)")} AS v FROM px a, d p, d q, px b
WHERE b.image_id = a.image_id AND b.y = least(greatest(a.y + p.d, 0), 7) AND b.x = least(greatest(a.x + q.d, 0), 7) GROUP BY a.image_id, a.y, a.x"""
)
def gaussian_blur(spark, sf_dir):
    return stencil.gaussian_blur(pixels(spark, sf_dir), 1.0, 2).select("image_id", "y", "x", r4(F.col("v")).alias("v"))


def _geometry(name: str, operator, sql: str) -> None:
    def f(spark, sf_dir):
        return operator(pixels(spark, sf_dir).select(*IMG))

    f.__name__ = name
    query("WITH {px} " + sql)(f)


_geometry("hflip", lambda p: geometry.hflip(p, 8), "SELECT image_id, y, CAST(7 - x AS INT) AS x, v FROM px")
_geometry("vflip", lambda p: geometry.vflip(p, 8), "SELECT image_id, CAST(7 - y AS INT) AS y, x, v FROM px")
_geometry("rotate_left", lambda p: geometry.rotate_left(p, 8), "SELECT image_id, CAST(7 - x AS INT) AS y, y AS x, v FROM px")
_geometry("rotate_right", lambda p: geometry.rotate_right(p, 8), "SELECT image_id, x AS y, CAST(7 - y AS INT) AS x, v FROM px")
_geometry("crop", lambda p: geometry.crop(p, 2, 1, 4, 9), "SELECT image_id, CAST(y - 1 AS INT) AS y, CAST(x - 2 AS INT) AS x, v FROM px WHERE x BETWEEN 2 AND 5 AND y >= 1")
_geometry("autocrop2", lambda p: geometry.autocrop(p, 3.5, 3.5, 2.0, 1.1, 2), "SELECT image_id, CAST(y - 1 AS INT) AS y, CAST(x - 1 AS INT) AS x, v FROM px WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6")
_geometry(
    "crop_rect",
    lambda p: geometry.crop_rect(p, 3.5, 3.5, 10, 4, 7.0),
    ", g AS (SELECT vec_id AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM embeddings, generate_series(0, 3) a(y), generate_series(0, 9) b(x)) SELECT g.image_id, g.y, g.x, coalesce(p.v, 7) AS v FROM g LEFT JOIN px p ON p.image_id = g.image_id AND p.y = g.y + 2 AND p.x = g.x - 1",
)
_geometry("fit_canvas", lambda p: geometry.fit_canvas(p.filter("image_id % 2 = 0 or (x < 4 and y < 6)")), "SELECT image_id, CAST(y + CASE WHEN image_id % 2 = 0 THEN 0 ELSE 1 END AS INT) AS y, CAST(x + CASE WHEN image_id % 2 = 0 THEN 0 ELSE 2 END AS INT) AS x, v FROM px WHERE image_id % 2 = 0 OR (x < 4 AND y < 6)")


@query("WITH {px}, p AS (SELECT grp, min(image_id) AS a, max(image_id) AS b FROM px GROUP BY grp) SELECT grp, y, x, v FROM px JOIN p USING (grp) WHERE image_id = a UNION ALL SELECT grp, y, CAST(x + 8 AS INT), v FROM px JOIN p USING (grp) WHERE image_id = b")
def side_by_side(spark, sf_dir):
    px = pixels(spark, sf_dir)
    ends = images(spark, sf_dir).groupBy("grp").agg(F.min("image_id").alias("a"), F.max("image_id").alias("b"))
    one, two = (px.join(ends.select("grp", F.col(c).alias("image_id")), ["grp", "image_id"]).select("grp", "y", "x", "v") for c in "ab")
    return geometry.side_by_side(one, two, 8)


@query("WITH {px}, p AS (SELECT grp, min(image_id) AS a, max(image_id) AS b FROM px GROUP BY grp) SELECT grp, y, x, v FROM px JOIN p USING (grp) WHERE image_id = a UNION ALL SELECT grp, CAST(y + 8 AS INT), x, v FROM px JOIN p USING (grp) WHERE image_id = b")
def top_bottom(spark, sf_dir):
    px = pixels(spark, sf_dir)
    ends = images(spark, sf_dir).groupBy("grp").agg(F.min("image_id").alias("a"), F.max("image_id").alias("b"))
    one, two = (px.join(ends.select("grp", F.col(c).alias("image_id")), ["grp", "image_id"]).select("grp", "y", "x", "v") for c in "ab")
    return geometry.top_bottom(one, two, 8)


@query(
    """WITH {px}, o AS (SELECT vec_id AS image_id, row_number() OVER (ORDER BY vec_id) - 1 AS o FROM embeddings)
SELECT o // 3 AS sheet, CAST(y + 1 + CASE o % 3 WHEN 2 THEN 9 ELSE 0 END AS INT) AS y, CAST(x + 1 + CASE o % 3 WHEN 0 THEN 0 ELSE 9 END AS INT) AS x, v FROM px JOIN o USING (image_id)"""
)
def collage(spark, sf_dir):
    return geometry.collages(pixels(spark, sf_dir).withColumn("list", F.lit(0)), "XX/.X", 8, 8, 1, "list").drop("list")


@query(
    """WITH {px}, o AS (SELECT vec_id AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS o FROM embeddings)
SELECT grp, o // 3 AS sheet, CAST(y + 1 + CASE o % 3 WHEN 2 THEN 9 ELSE 0 END AS INT) AS y, CAST(x + 1 + CASE o % 3 WHEN 0 THEN 0 ELSE 9 END AS INT) AS x, v FROM px JOIN o USING (image_id)"""
)
def collage_groups(spark, sf_dir):
    return geometry.collages(pixels(spark, sf_dir), "XX/.X", 8, 8, 1)


def _taps(y: str, x: str) -> str:
    return f""", t AS (SELECT image_id, y, x, {y} AS sy, {x} AS sx FROM px), w AS (SELECT t.*, floor(sy) + dy AS ty, floor(sx) + dx AS tx,
  (CASE WHEN dy = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN dx = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w FROM t, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx))
SELECT w.image_id, w.y, w.x, {s4("CASE WHEN count(*) > count(p.v) THEN 0 ELSE sum(w.w * p.v) END")} AS v FROM w LEFT JOIN px p ON p.image_id = w.image_id AND p.y = w.ty AND p.x = w.tx WHERE w.w > 0 GROUP BY w.image_id, w.y, w.x"""


_geometry("rotate_deg", lambda p: geometry.rotate(p, 8, 8, 0.5235987755982988).withColumn("v", r4(F.col("v"))), _taps("(y - 3.5) * 0.8660254037844387 - (x - 3.5) * 0.49999999999999994 + 3.5", "(x - 3.5) * 0.8660254037844387 + (y - 3.5) * 0.49999999999999994 + 3.5"))
_geometry("radius_rescale", lambda p: geometry.radius_rescale(p, 8, 8, F.lit(2.0) + F.col("image_id") % 2, 4.0).withColumn("v", r4(F.col("v"))), _taps("(y - 3.5) * ((2.0 + image_id % 2) / 4) + 3.5", "(x - 3.5) * ((2.0 + image_id % 2) / 4) + 3.5"))


_GRID = ", g AS (SELECT vec_id AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM embeddings, generate_series(0, {h}) a(y), generate_series(0, {w}) b(x))"


@query("WITH {px}" + _GRID.format(h=11, w=11) + _taps("(y - 5.5) * (8 / 12) + 3.5", "(x - 5.5) * (8 / 12) + 3.5").replace("FROM px)", "FROM g)"))
def rescale_rel(spark, sf_dir):
    return geometry.rescale(images(spark, sf_dir), 8, 8, 12, 12).withColumn("v", r4(F.col("v")))


_geometry("rotate_and_scale", lambda p: geometry.rotate_and_scale(p, 8, 8, 0.5235987755982988, 2.0).withColumn("v", r4(F.col("v"))), _taps("(y - 3.5) * 0.43301270189221935 - (x - 3.5) * 0.24999999999999997 + 3.5", "(x - 3.5) * 0.43301270189221935 + (y - 3.5) * 0.24999999999999997 + 3.5"))


@query("WITH {px}" + _GRID.format(h=5, w=9) + _taps("(y - 2.5) * ((2.0 + image_id % 2) / 4) + 3.5", "(x - 4.5) * ((2.0 + image_id % 2) / 4) + 3.5").replace("FROM px)", "FROM g)"))
def radius_rescale2(spark, sf_dir):
    return geometry.radius_rescale2(images(spark, sf_dir), 8, 8, F.lit(2.0) + F.col("image_id") % 2, 4.0, 10, 6).withColumn("v", r4(F.col("v")))


def _disk():
    """A disk that differs by image, as columns; _DISK_SQL has the same."""
    return F.lit(3.0) + F.col("image_id") % 2, F.lit(3.5), F.lit(2.0) + F.col("image_id") % 3 / 2


_DISK_SQL = "((x - (3.0 + image_id % 2)) * (x - (3.0 + image_id % 2)) + (y - 3.5) * (y - 3.5) <= (2.0 + (image_id % 3) / 2.0) * (2.0 + (image_id % 3) / 2.0))"


@query(f"WITH {{px}} SELECT image_id, avg(v) AS mean, count(*) AS n FROM px WHERE {_DISK_SQL} GROUP BY image_id")
def disk_by_image(spark, sf_dir):
    return pixels(spark, sf_dir).filter(pixel.within_disk(*_disk())).groupBy("image_id").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH {px}, d AS (SELECT vec_id AS image_id, ceil(2 * (2.0 + (vec_id % 3) / 2.0) * 1.1 / 2) * 2 AS side, 3.0 + vec_id % 2 AS cx FROM embeddings),
b AS (SELECT image_id, side, floor(cx - side / 2 + 0.5) AS l, floor(3.5 - side / 2 + 0.5) AS t FROM d)
SELECT image_id, CAST(y - t AS INT) AS y, CAST(x - l AS INT) AS x, v FROM px JOIN b USING (image_id) WHERE x BETWEEN l AND l + side - 1 AND y BETWEEN t AND t + side - 1"""
)
def autocrop_by_image(spark, sf_dir):
    return geometry.autocrop(pixels(spark, sf_dir).select(*IMG), *_disk(), 1.1, 2)


@query("WITH {px}, b AS (SELECT vec_id AS image_id, CAST(vec_id % 3 AS INT) AS top, CAST(vec_id % 4 AS INT) AS \"left\", 6 AS bottom, 7 AS \"right\" FROM embeddings) SELECT b.*, sum(v) AS total FROM b JOIN px USING (image_id) WHERE y BETWEEN top AND bottom AND x BETWEEN \"left\" AND \"right\" GROUP BY ALL")
def area_sum(spark, sf_dir):
    boxes = images(spark, sf_dir).select("image_id", (F.col("image_id") % 3).cast("int").alias("top"), (F.col("image_id") % 4).cast("int").alias("left"), F.lit(6).alias("bottom"), F.lit(7).alias("right"))
    return geometry.area_sum(pixels(spark, sf_dir), boxes)


@query(
    f"""WITH {{px}}, k AS (SELECT * FROM (VALUES (-1, -1, 1.0), (-1, 0, 2.0), (-1, 1, -1.0), (0, -1, 0.5), (0, 0, 4.0), (0, 1, -2.0), (1, -1, 0.0), (1, 0, 1.0), (1, 1, 0.5)) k(dy, dx, w))
SELECT a.image_id, a.y, a.x, {s4("least(greatest(sum(w / 6 * b.v), 0), 65535)")} AS v FROM px a, k, px b
WHERE b.image_id = a.image_id AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7) GROUP BY a.image_id, a.y, a.x"""
)
def convolve(spark, sf_dir):
    done = kernels.convolve(images(spark, sf_dir), [[1, 2, -1], [0.5, 4, -2], [0, 1, 0.5]], 1 / 6)
    return to_pixels(done).select("image_id", "y", "x", r4(F.col("v")).alias("v"))


@query(f"WITH {{px}}, e AS (SELECT *, row_number() OVER (PARTITION BY grp, y, x ORDER BY abs(v - 32768), image_id) - 1 AS r, count(*) OVER (PARTITION BY grp, y, x) AS n FROM px), w AS (SELECT *, 1 / (1 + exp((r / greatest(n - 1, 1) - 0.4) / 0.1)) AS w FROM e) SELECT grp, y, x, {s4('sum(w * v) / sum(w)')} AS v FROM w GROUP BY grp, y, x")
def stack_local(spark, sf_dir):
    own = pixels(spark, sf_dir).withColumn("err", F.abs(F.col("v") - 32768))
    return reduce.stack_local(own, 0.4).withColumn("v", r4(F.col("v")))


@query()
def image_sketch(spark, sf_dir):
    return reduce.image_sketch(pixels(spark, sf_dir))


@query("WITH {px} SELECT image_id, CAST(CASE WHEN pixel_shift < 0 THEN 7 - y ELSE y END AS INT) AS y, CAST(CASE WHEN grp % 2 = 0 THEN 7 - x ELSE x END AS INT) AS x, v FROM px")
def conditional_flip(spark, sf_dir):
    out = compose.flipped_where(pixels(spark, sf_dir), F.col("grp") % 2 == 0, F.col("pixel_shift") < 0, F.lit(8), F.lit(8))
    return out.select(*IMG)


@query("WITH {px} SELECT image_id, y, x, CASE WHEN v <= 30000 THEN 0 WHEN v >= 36000 THEN 65535 ELSE v END AS v FROM px")
def cutoff(spark, sf_dir):
    return compose.cutoff(pixels(spark, sf_dir).select(*IMG), 30000, 36000)


@query("WITH {px}, c AS (SELECT image_id, y, x, CASE WHEN v <= 30000 THEN 0 WHEN v >= 36000 THEN 65535 ELSE v END AS v FROM px), m AS (SELECT image_id, max(v) AS m FROM c GROUP BY image_id) SELECT image_id, y, x, m - v AS v FROM c JOIN m USING (image_id)")
def stretching_chain(spark, sf_dir):
    return compose.chain(pixels(spark, sf_dir).select(*IMG), lambda p: compose.cutoff(p, 30000, 36000), stretch.invert)


_LINEAR = "CASE WHEN hi = lo THEN v ELSE 65535.0 / (hi - lo) * (v - lo) END"


@query(f"WITH {{px}}, c AS (SELECT image_id, y, x, CASE WHEN {_DISK_SQL} THEN 0 ELSE v END AS v FROM px), m AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM c GROUP BY image_id) SELECT image_id, y, x, {s4(_LINEAR)} AS v FROM c JOIN m USING (image_id)")
def coronagraph(spark, sf_dir):
    return compose.coronagraph(pixels(spark, sf_dir).select(*IMG), pixel.within_disk(*_disk())).withColumn("v", r4(F.col("v")))


@query(
    f"""WITH {{px}}, d AS (SELECT a.image_id, a.y, a.x, a.v - b.v AS v FROM px a JOIN px b ON b.image_id = a.image_id + 1 AND a.y = b.y AND a.x = b.x),
l AS (SELECT image_id, y, x, v - least(min(v) OVER (PARTITION BY image_id), 0) AS v FROM d), m AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM l GROUP BY image_id)
SELECT image_id, y, x, {s4(_LINEAR)} AS v FROM l JOIN m USING (image_id)"""
)
def helium(spark, sf_dir):
    return compose.helium(*_pairs(spark, sf_dir)).select("image_id", "y", "x", r4(F.col("v")).alias("v"))


_SHIFT = "c AS (SELECT image_id, y, sum(v * x) / sum(v) AS c FROM px GROUP BY image_id, y), s AS (SELECT image_id, y, c - avg(c) OVER (PARTITION BY image_id ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS shift FROM c)"


@query(f"WITH {{px}}, {_SHIFT} SELECT image_id, y, {s4('shift')} AS shift FROM s")
def jagging(spark, sf_dir):
    return compose.jagging(pixels(spark, sf_dir)).withColumn("shift", r4(F.col("shift")))


@query(
    f"""WITH {{px}}, {_SHIFT}, a AS (SELECT px.image_id, px.y, px.x, least(greatest(px.x + shift, 0), 7) AS pos FROM px JOIN s USING (image_id, y)),
t AS (SELECT image_id, y, x, floor(pos) + d AS tx, CASE d WHEN 1 THEN pos - floor(pos) ELSE 1 - (pos - floor(pos)) END AS w FROM a, (VALUES (0), (1)) k(d))
SELECT t.image_id, t.y, t.x, {s4('sum(w * p.v)')} AS v FROM t JOIN px p ON p.image_id = t.image_id AND p.y = t.y AND p.x = t.tx WHERE w > 0 GROUP BY t.image_id, t.y, t.x"""
)
def jagging_corrected(spark, sf_dir):
    return compose.jagging_corrected(pixels(spark, sf_dir)).withColumn("v", r4(F.col("v")))


@query()
def auto_contrast(spark, sf_dir):
    return compose.auto_contrast(_disks(spark, sf_dir), 8, 8)


_BAYER = {"r": "y % 2 = 0 AND x % 2 = 0", "g": "y % 2 <> x % 2", "b": "y % 2 = 1 AND x % 2 = 1"}


def _plane(c: str) -> str:
    known = _BAYER[c]
    near = known.replace("y", "b.y").replace("x", "b.x")
    own = known.replace("y", "a.y").replace("x", "a.x")
    return f"CASE WHEN {own} THEN any_value(a.v) ELSE sum(b.v * w) FILTER ({near}) / sum(w) FILTER ({near}) END AS {c}"


@query(
    f"""WITH {{px}}, n AS (SELECT a.image_id, a.y, a.x, a.v, b.y AS ny, b.x AS nx, b.v AS nv FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1)
SELECT a.image_id, a.y, a.x, {", ".join(map(_plane, "rgb"))} FROM (SELECT image_id, y, x, v FROM px) a JOIN (SELECT image_id, y AS ay, x AS ax, ny AS y, nx AS x, nv AS v, (2.0 - abs(y - ny)) * (2 - abs(x - nx)) AS w FROM n) b ON a.image_id = b.image_id AND a.y = b.ay AND a.x = b.ax GROUP BY a.image_id, a.y, a.x"""
)
def demosaic(spark, sf_dir):
    return compose.demosaic(pixels(spark, sf_dir))


@query(f"WITH {{px}}, {_LAP} SELECT image_id, avg(r * r) AS sharpness FROM lap GROUP BY image_id ORDER BY sharpness DESC, image_id LIMIT 1")
def richest_focus(spark, sf_dir):
    return compose.richest_focus(pixels(spark, sf_dir))


@query()
def voigt_fit(spark, sf_dir):
    from ..operators import frames

    return compose.voigt_fit(frames.profile(pixels(spark, sf_dir)))


@query("SELECT vec_id AS image_id, 8 AS width, 8 AS height, list_transform(embedding, lambda e: floor((CAST(e AS DOUBLE) + 1) * 32767.5)) AS data FROM embeddings")
def dense_round_trip(spark, sf_dir):
    return to_images(pixels(spark, sf_dir))


_SPLIT = "a AS (SELECT grp, y, x, image_id, v FROM px WHERE image_id % 3 = 0), b AS (SELECT grp, y, x, image_id + 1 AS nxt, v FROM px)"


def _pairs(spark, sf_dir):
    px = pixels(spark, sf_dir).select(*IMG)
    return px, px.withColumn("image_id", F.col("image_id") - 1)


@query("WITH {px} SELECT a.image_id, a.y, a.x, a.v - b.v AS v FROM px a JOIN px b ON b.image_id = a.image_id + 1 AND a.y = b.y AND a.x = b.x")
def signed_diff(spark, sf_dir):
    return lists.arithmetic(*_pairs(spark, sf_dir), lambda a, b: a - b, ("image_id", "y", "x")).select(*IMG)


@query("WITH {px} SELECT a.image_id, a.y, a.x, a.v * b.v AS v FROM px a JOIN px b ON b.image_id = a.image_id + 1 AND a.y = b.y AND a.x = b.x")
def image_multiply(spark, sf_dir):
    return lists.arithmetic(*_pairs(spark, sf_dir), lambda a, b: a * b, ("image_id", "y", "x")).select(*IMG)


@query(f"WITH {{px}} SELECT a.image_id, a.y, a.x, {s4('0.299 * a.v + 0.587 * b.v + 0.114 * c.v')} AS v FROM px a JOIN px b ON b.image_id = a.image_id + 1 AND a.y = b.y AND a.x = b.x JOIN px c ON c.image_id = a.image_id + 2 AND a.y = c.y AND a.x = c.x")
def rgb_mono(spark, sf_dir):
    px = pixels(spark, sf_dir).select("image_id", "y", "x", F.col("v").alias("r"))
    g, b = (px.select((F.col("image_id") - k).alias("image_id"), "y", "x", F.col("r").alias(n)) for k, n in ((1, "g"), (2, "b")))
    rgb = px.join(g, ["image_id", "y", "x"]).join(b, ["image_id", "y", "x"])
    return rgb.select("image_id", "y", "x", r4(color.mono(F.col("r"), F.col("g"), F.col("b"))).alias("v"))


#: Hue, saturation and lightness of three neighbours as a colour, the saturation raised to a power, and back.
_SATURATE = """c AS (SELECT a.image_id, a.y, a.x, a.v / 65535 AS r, b.v / 65535 AS g, c.v / 65535 AS b FROM px a JOIN px b ON b.image_id = a.image_id + 1 AND a.y = b.y AND a.x = b.x JOIN px c ON c.image_id = a.image_id + 2 AND a.y = c.y AND a.x = c.x),
m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c),
h AS (SELECT image_id, y, x, (hi + lo) / 2 AS l, CASE WHEN hi = lo THEN 0 WHEN hi + lo > 1 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS s,
  CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (g - b) / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END / 6 AS h FROM m),
q AS (SELECT image_id, y, x, h, l, CASE WHEN l < 0.5 THEN l * (1 + z) ELSE l + z - l * z END AS q FROM (SELECT *, pow(s, pow(2, -1.5)) AS z FROM h)),
t AS (SELECT image_id, y, x, q, 2 * l - q AS p, n, CASE WHEN t < 0 THEN t + 1 WHEN t >= 1 THEN t - 1 ELSE t END AS t FROM (SELECT *, h + d AS t FROM q, (VALUES ('r', 1 / 3), ('g', 0), ('b', -1 / 3)) k(n, d))),
v AS (SELECT image_id, y, x, n, CASE WHEN t < 1 / 6 THEN p + (q - p) * 6 * t WHEN t < 1 / 2 THEN q WHEN t < 2 / 3 THEN p + (q - p) * (2 / 3 - t) * 6 ELSE p END AS v FROM t)"""


@query(f"WITH {{px}}, {_SATURATE} SELECT image_id, y, x, {', '.join(s4('max(v) FILTER (n = ' + repr(c) + ')') + f' AS {c}' for c in 'rgb')} FROM v GROUP BY image_id, y, x")
def saturate(spark, sf_dir):
    px = pixels(spark, sf_dir).select("image_id", "y", "x", (F.col("v") / 65535).alias("r"))
    g, b = (px.select((F.col("image_id") - k).alias("image_id"), "y", "x", F.col("r").alias(n)) for k, n in ((1, "g"), (2, "b")))
    rgb = px.join(g, ["image_id", "y", "x"]).join(b, ["image_id", "y", "x"])
    return rgb.select("image_id", "y", "x", *(r4(c).alias(n) for c, n in zip(color.saturate(F.col("r"), F.col("g"), F.col("b"), 1.5), "rgb", strict=True)))


_CURVE = "least(greatest(({to} - {at}) * 256.0 / (({at} * 256.0) * ({at} * 256.0) - ({at} * 256.0) * 65535) * v * v + (1 - ({to} - {at}) * 256.0 / (({at} * 256.0) * ({at} * 256.0) - ({at} * 256.0) * 65535) * 65535) * v, 0), 65535)"


@query(f"WITH {{px}} SELECT image_id, y, x, {s4(_CURVE.format(at=84, to=139))} AS r, {s4(_CURVE.format(at=95, to=20))} AS g, {s4(_CURVE.format(at=218, to=65))} AS b FROM px")
def colorize2(spark, sf_dir):
    channels = color.colorize(F.col("v"), (84, 139), (95, 20), (218, 65))
    return pixels(spark, sf_dir).select("image_id", "y", "x", *(r4(c).alias(n) for c, n in zip(channels, "rgb", strict=True)))


def _disks(spark, sf_dir):
    """Dense images with a disk that differs by image."""
    return kernels.with_disk(images(spark, sf_dir), *_disk())


def _kernel(name: str, operator, source=images, flat: bool = True) -> None:
    def f(spark, sf_dir):
        out = operator(source(spark, sf_dir))
        return to_pixels(out) if flat else out

    f.__name__ = name
    query()(f)


def _first(dense):
    return dense.filter("image_id = 0")


_kernel("poly_fit_2d", kernels.poly_fit_2d, _disks)
_kernel("bg_model", kernels.bg_model, _disks)
_kernel("neutralize_bg", kernels.neutralize_bg, _disks)
_kernel("rl_decon", kernels.rl_decon)
_kernel("flat_correction", kernels.flat_correction, _disks)
_kernel("fix_geometry", kernels.fix_geometry)
_kernel("resample", lambda d: kernels.resample(d, 12, 10))
_kernel("dedistort", lambda d: kernels.dedistort(d, _first(d), 8, 4))
_kernel("laplacian_blend", lambda d: kernels.laplacian_blend(d, d.withColumn("image_id", F.col("image_id") - 1)))
_kernel("ellipse_fit", kernels.ellipse_fit, flat=False)
_kernel("displacement", lambda d: kernels.displacement(d, _first(d)), flat=False)
_kernel("tile_displacement", lambda d: kernels.tile_displacement(d, _first(d), 4, 2), flat=False)
_kernel("angular_correlation", lambda d: kernels.angular_correlation(d, _first(d)), flat=False)
_kernel("stack", lambda d: kernels.stack_images(d, _first(d), "grp", 8, 4), flat=False)


@query(f"WITH {{px}}, r AS (SELECT image_id, y, avg(v) AS m FROM px GROUP BY image_id, y), f AS (SELECT image_id, y, avg(m) OVER (PARTITION BY image_id ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / m AS f FROM r) SELECT image_id, y, x, {s4('v * f')} AS v FROM px JOIN f USING (image_id, y)")
def fix_banding(spark, sf_dir):
    return kernels.fix_banding(pixels(spark, sf_dir)).select("image_id", "y", "x", r4(F.col("v")).alias("v"))


@query(f"WITH {{px}}, c AS (SELECT image_id, x, median(v) AS m FROM px GROUP BY image_id, x), s AS (SELECT image_id, x, avg(m) OVER (PARTITION BY image_id ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS b FROM c) SELECT image_id, y, x, {s4('b')} AS v FROM px JOIN s USING (image_id, x)")
def column_bg_model(spark, sf_dir):
    return kernels.column_bg_model(pixels(spark, sf_dir)).withColumn("v", r4(F.col("v")))


@query(f"SELECT o_orderkey, {s4('epoch_us(o_orderdate) / 86400e6 + 2440587.5')} AS jd, CAST(floor((epoch_us(o_orderdate) / 86400e6 + 2440587.5 - 2398167.2763889) / 27.2753) + 1 AS INT) AS rotation FROM orders")
def carrington_rotation(spark, sf_dir):
    from ..sources.images import table

    ts = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", r4(spectral.julian_date(ts)).alias("jd"), spectral.carrington_rotation(ts).alias("rotation"))


@query(
    f"""WITH t AS (SELECT o_orderkey, jd, (jd - 2451545.0) / 36525 AS t FROM (SELECT o_orderkey, epoch_us(o_orderdate) / 86400e6 + 2440587.5 AS jd FROM orders)),
a AS (SELECT *, radians(357.52911 + 35999.05029 * t) AS m, radians(73.6667 + 1.3958333 * (jd - 2396758) / 36525) AS node, radians(23.4392911 - 0.0130042 * t) AS obliquity FROM t),
l AS (SELECT *, radians(280.46646 + 36000.76983 * t + (1.914602 - 0.004817 * t) * sin(m) + 0.019993 * sin(2 * m) - 0.00569) AS lon FROM a)
SELECT o_orderkey, {s4("degrees(atan(-cos(lon) * tan(obliquity)) + atan(-cos(lon - node) * tan(radians(7.25))))")} AS p, {s4("degrees(asin(sin(lon - node) * sin(radians(7.25))))")} AS b0 FROM l"""
)
def solar_angles(spark, sf_dir):
    from ..sources.images import table

    p, b0 = spectral.solar_angles(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", r4(p).alias("p"), r4(b0).alias("b0"))


@query("SELECT vec_id AS image_id, floor((656.2808 + (vec_id % 31 - 15) * 0.0183) * 100 + 0.5) / 100 AS wave, floor((vec_id % 31 - 15) * 0.0183 * 100 + 0.5) / 100 AS px2a, floor((vec_id % 7) / 0.183 * 100 + 0.5) / 100 AS a2px, floor((656.5 - 656.2808) / 0.0183 * 100 + 0.5) / 100 AS found FROM embeddings")
def wavelengths(spark, sf_dir):
    shift = F.col("pixel_shift")
    return images(spark, sf_dir).select(
        "image_id",
        spectral.wavelength(656.2808, shift, 0.0183).alias("wave"),
        spectral.px2a(shift, 0.0183).alias("px2a"),
        spectral.a2px((F.col("image_id") % 7).cast("double"), 0.183).alias("a2px"),
        spectral.find_shift(F.lit(656.5), 656.2808, 0.0183).alias("found"),
    )
