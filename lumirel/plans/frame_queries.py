"""Queries on frames: reconstruction, line profiles, detections, backgrounds, metadata and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixel
from ..operators import compose, frames, joins, stretch
from ..sources.images import images, pixels, table
from .pixel_queries import _clahe
from .registry import query, r4, s4


@query("WITH {px}, m AS (SELECT image_id, avg(v) AS m FROM px GROUP BY image_id) SELECT y, x, avg(v) AS v FROM px JOIN m USING (image_id) WHERE m > 0.99 * (SELECT max(m) FROM m) GROUP BY y, x")
def average_image(spark, sf_dir):
    return frames.average_image(pixels(spark, sf_dir), 0.99)


@query("WITH {px} SELECT image_id, x, arg_min(y, (v, y)) AS y FROM px GROUP BY image_id, x")
def line_minimum(spark, sf_dir):
    return frames.line_minimum(pixels(spark, sf_dir))


@query(
    f"""WITH {{px}}, t AS (SELECT * FROM (VALUES (-1.0), (0.0), (1.5)) s(shift), (VALUES (-2, 1.0), (-1, 4.0), (0, 6.0), (1, 4.0), (2, 1.0)) w(d, w))
SELECT shift::DOUBLE AS pixel_shift, image_id AS y, x, {s4("sum(w * v) / sum(w)")} AS v FROM px, t WHERE y = floor(3.2 + 0.1 * x + shift + 0.5) + d GROUP BY shift, image_id, x"""
)
def reconstruct(spark, sf_dir):
    out = frames.reconstruct(pixels(spark, sf_dir), F.lit(3.2) + 0.1 * F.col("x"), [-1.0, 0.0, 1.5])
    return out.withColumn("v", r4(F.col("v")))


_PROFILE = "pr AS (SELECT image_id, y, avg(v) AS v FROM px GROUP BY image_id, y)"


@query(f"WITH {{px}}, {_PROFILE}, e AS (SELECT image_id, max(v) AS continuum, min(v) AS core FROM pr GROUP BY image_id) SELECT image_id, continuum, core, {s4('sum((continuum - v) * y) / sum(continuum - v)')} AS gravity, {s4('(continuum - core) / continuum')} AS depth FROM pr JOIN e USING (image_id) GROUP BY image_id, continuum, core")
def line_statistics(spark, sf_dir):
    out = frames.line_statistics(frames.profile(pixels(spark, sf_dir)))
    return out.withColumn("gravity", r4(F.col("gravity"))).withColumn("depth", r4(F.col("depth")))


@query(
    f"""WITH {{px}}, {_PROFILE}, c AS (SELECT a.image_id, o AS "offset", corr(a.v, r.v) AS score FROM pr a JOIN generate_series(-2, 2) g(o) ON true JOIN pr r ON r.image_id = 0 AND a.y = r.y + o GROUP BY a.image_id, o HAVING count(*) >= 4)
SELECT image_id, CAST(arg_max("offset", (score, -abs("offset"), "offset")) AS INT) AS "offset", {s4("max(score)")} AS score FROM c GROUP BY image_id"""
)
def locate_line(spark, sf_dir):
    profiles = frames.profile(pixels(spark, sf_dir))
    return frames.locate(profiles, profiles.filter("image_id = 0"), [-2, -1, 0, 1, 2]).withColumn("score", r4(F.col("score")))


@query("WITH {px}, c AS (SELECT image_id, x, avg(v) AS mean FROM px GROUP BY image_id, x), s AS (SELECT image_id, avg(mean) AS m, stddev_pop(mean) AS s FROM c GROUP BY image_id) SELECT image_id, x, mean FROM c JOIN s USING (image_id) WHERE mean > m + 1.0 * s")
def column_outliers(spark, sf_dir):
    return frames.column_outliers(pixels(spark, sf_dir), 1.0)


@query("WITH {px}, b AS (SELECT image_id, x FROM px WHERE y = 3 AND v > 32000), r AS (SELECT image_id, x, x - row_number() OVER (PARTITION BY image_id ORDER BY x) AS k FROM b) SELECT image_id, min(x) AS first, max(x) AS last, count(*) AS n FROM r GROUP BY image_id, k")
def bright_areas(spark, sf_dir):
    return frames.areas(pixels(spark, sf_dir).filter("y = 3 and v > 32000"), "image_id", "x")


_BEST = "best AS (SELECT image_id, grp, arg_max(y, (v, -y, -x)) AS cy, arg_max(x, (v, -y, -x)) AS cx FROM px GROUP BY image_id, grp)"


@query(f"WITH {{px}}, {_BEST} SELECT px.image_id, CAST(y - cy + 1 AS INT) AS y, CAST(x - cx + 1 AS INT) AS x, v FROM px JOIN best USING (image_id) WHERE y BETWEEN cy - 1 AND cy + 1 AND x BETWEEN cx - 1 AND cx + 1")
def crop_regions(spark, sf_dir):
    px = pixels(spark, sf_dir).select("image_id", "y", "x", "v")
    return frames.crop_regions(px, frames.brightest_regions(px))


@query()
def crop_ar(spark, sf_dir):
    """All regions of each image, where crop_regions takes the box around its brightest pixel."""
    px = pixels(spark, sf_dir).select("image_id", "y", "x", "v")
    return frames.crop_active_regions(px, frames.active_regions(px, 1.0), 1, 0.5)


@query(f"WITH {{px}}, {_BEST} SELECT a.image_id, arg_min(b.image_id, ((a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx), b.image_id)) AS anchor_id, min((a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx))::DOUBLE AS d2 FROM best a JOIN best b ON a.grp = b.grp AND a.image_id <> b.image_id AND (a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx) <= 4 GROUP BY a.image_id")
def nearest_region(spark, sf_dir):
    found = frames.brightest_regions(pixels(spark, sf_dir)).join(images(spark, sf_dir).select("image_id", "grp"), "image_id")
    return frames.nearest_region(found, found, 2.0)


@query(f"WITH {{px}}, m AS (SELECT image_id, x // 4 AS k, y, median(v) AS m FROM px GROUP BY image_id, x // 4, y), d AS (SELECT image_id, k, y, avg(m) OVER (PARTITION BY image_id, k ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - m AS d FROM m) SELECT px.image_id, px.y, x, {s4('v + d')} AS v FROM px JOIN d ON d.image_id = px.image_id AND d.y = px.y AND d.k = px.x // 4")
def destripe(spark, sf_dir):
    return frames.destripe(pixels(spark, sf_dir), 4, 2).select("image_id", "y", "x", r4(F.col("v")).alias("v"))


@query(f"WITH {{px}}, b AS (SELECT image_id, avg(v) AS bg FROM px WHERE NOT ((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5) <= 9) GROUP BY image_id) SELECT image_id, y, x, {s4('greatest(v - 0.9 * bg, 0)')} AS v FROM px JOIN b USING (image_id)")
def remove_bg(spark, sf_dir):
    return frames.remove_bg(pixels(spark, sf_dir), pixel.within_disk(3.5, 3.5, 3.0)).select("image_id", "y", "x", r4(F.col("v")).alias("v"))


@query(f"WITH {{px}}, k AS (SELECT *, floor(sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5))) AS k FROM px), b AS (SELECT image_id, k, quantile_cont(v, 0.1) AS bg FROM k GROUP BY image_id, k) SELECT image_id, y, x, {s4('greatest(v - bg, 0)')} AS v FROM k JOIN b USING (image_id, k)")
def ring_background(spark, sf_dir):
    return frames.ring_background(pixels(spark, sf_dir), 3.5, 3.5, 10).select("image_id", "y", "x", r4(F.col("v")).alias("v"))


@query(f"WITH {{px}}, {_PROFILE} SELECT image_id, floor(regr_slope(v, y) * 1e6 + 0.5) / 1e6 AS slope, floor(regr_intercept(v, y) * 1e6 + 0.5) / 1e6 AS intercept FROM pr GROUP BY image_id")
def linear_regression(spark, sf_dir):
    out = frames.profile(pixels(spark, sf_dir)).groupBy("image_id").agg(F.regr_slope("v", "y").alias("slope"), F.regr_intercept("v", "y").alias("intercept"))
    return out.select("image_id", *((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("slope", "intercept")))


@query("WITH {px} SELECT r.grp, r.image_id AS red_id, b.image_id AS blue_id, r.y, r.x, r.v - b.v AS v FROM px r JOIN px b ON r.grp = b.grp AND r.y = b.y AND r.x = b.x AND b.pixel_shift = -r.pixel_shift AND r.pixel_shift > 0")
def doppler_pairs(spark, sf_dir):
    return frames.doppler_pairs(images(spark, sf_dir))


@query("WITH {px} SELECT grp, image_id, avg(v) AS mean, count(*) AS n FROM px GROUP BY ROLLUP (grp, image_id)")
def stats_rollup(spark, sf_dir):
    return pixels(spark, sf_dir).rollup("grp", "image_id").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))


@query("WITH {px}, m AS (SELECT vec_id + 1 AS image_id, label AS other_grp FROM embeddings) SELECT image_id, y, x, v, other_grp FROM px JOIN m USING (image_id)")
def copy_metadata(spark, sf_dir):
    other = images(spark, sf_dir).select((F.col("image_id") + 1).alias("image_id"), F.col("grp").alias("other_grp"))
    return pixels(spark, sf_dir).select("image_id", "y", "x", "v").join(other, "image_id")


@query("SELECT event_id, strftime(ts, '%Y%m%d') || '/' || event_type || '_' || lpad(CAST(event_id AS VARCHAR), 6, '0') || '.fits' AS path FROM events")
def output_paths(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("/"), "event_type", F.lit("_"), F.lpad(F.col("event_id").cast("string"), 6, "0"), F.lit(".fits")).alias("path"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages")
def source_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, (count(*) - 1) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS fps FROM events GROUP BY ALL HAVING max(ts) > min(ts)")
def frame_rate(spark, sf_dir):
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    by = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("a"), F.max(ts).alias("b")).filter("b > a").select("event_type", "day", ((F.col("n") - 1) / ((F.col("b") - F.col("a")) / 1e6)).alias("fps"))


@query(f"WITH {{px}}, d AS (SELECT a.image_id, b.image_id AS other_id, corr(a.v, b.v) AS c FROM px a JOIN px b ON a.grp = b.grp AND a.y = b.y AND a.x = b.x AND b.image_id > a.image_id GROUP BY a.image_id, b.image_id) SELECT image_id, other_id, {s4('c')} AS c FROM d WHERE c > 0.25")
def correlated_images(spark, sf_dir):
    return joins.correlated(images(spark, sf_dir), 0.25).withColumn("c", r4(F.col("c")))


@query()
def correlated_all_images(spark, sf_dir):
    """correlated_images under the name that it had when that was of one group."""
    return joins.correlated(images(spark, sf_dir), 0.25).withColumn("c", r4(F.col("c")))


@query(
    """WITH {px}, pr AS (SELECT image_id, y, avg(v) AS v FROM px GROUP BY image_id, y), e AS (SELECT image_id, (max(v) + min(v)) / 2 AS half, arg_min(y, (v, y)) AS core FROM pr GROUP BY image_id),
n AS (SELECT image_id, y, v, lead(v) OVER w AS v2, lead(y) OVER w AS y2 FROM pr WINDOW w AS (PARTITION BY image_id ORDER BY y)),
c AS (SELECT image_id, core, y + (half - v) / (v2 - v) * (y2 - y) AS pos FROM n JOIN e USING (image_id) WHERE v2 IS NOT NULL AND (v > half) <> (v2 > half))
SELECT image_id, floor((min(pos) FILTER (pos > core) - max(pos) FILTER (pos <= core)) * 10000 + 0.5) / 10000 AS fwhm FROM c GROUP BY image_id"""
)
def line_fwhm(spark, sf_dir):
    return frames.fwhm(frames.profile(pixels(spark, sf_dir))).withColumn("fwhm", r4(F.col("fwhm")))


@query("WITH {px}, l AS (SELECT image_id, x, arg_min(y, (v, y)) AS y FROM px GROUP BY image_id, x) SELECT image_id, 1 - min(y) AS low, 6 - max(y) AS high FROM l GROUP BY image_id")
def pixel_shift_range(spark, sf_dir):
    return frames.pixel_shift_range(frames.line_minimum(pixels(spark, sf_dir)), 8, 1)


@query()
def polynomial_fit(spark, sf_dir):
    """The line of each frame as a parabola over its columns."""
    return frames.polynomial_fit(frames.line_minimum(pixels(spark, sf_dir)), 2)


@query(f"WITH {{px}}, {_BEST} SELECT px.image_id, y, x, CASE WHEN (y BETWEEN cy - 1 AND cy + 1) AND (x BETWEEN cx - 1 AND cx + 1) AND (y IN (cy - 1, cy + 1) OR x IN (cx - 1, cx + 1)) THEN 65535.0 ELSE v END AS v FROM px JOIN best USING (image_id)")
def ar_overlay(spark, sf_dir):
    px = pixels(spark, sf_dir).select("image_id", "y", "x", "v")
    return compose.overlay_regions(px, frames.brightest_regions(px))


@query(
    f"""WITH {{px}}, p AS (SELECT image_id, grp, CAST(image_id % 5 * 4 AS INT) AS top, CAST(image_id % 7 * 4 AS INT) AS "left" FROM (SELECT vec_id AS image_id, label AS grp FROM embeddings)),
w AS (SELECT px.grp, y + top AS y, x + "left" AS x, v, least(y + 1, 8 - y) * least(x + 1, 8 - x) AS w FROM px JOIN p USING (image_id)) SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, {s4('sum(w * v) / sum(w)')} AS v FROM w GROUP BY y, x"""
)
def mosaic(spark, sf_dir):
    px = pixels(spark, sf_dir).select("image_id", "y", "x", "v")
    places = images(spark, sf_dir).select("image_id", (F.col("image_id") % 5 * 4).cast("int").alias("top"), (F.col("image_id") % 7 * 4).cast("int").alias("left"))
    return compose.mosaic(px, places).withColumn("v", r4(F.col("v")))


_SHARE = "65535 * sum(w.w * s.share)"
_PASSES = " UNION ALL ".join(f"(WITH {{px}}, {_clahe(tile, 1.5).replace(s4(_SHARE), _SHARE)})" for tile in (2, 4, 8))


@query(f"SELECT image_id, y, x, {s4('avg(v)')} AS v FROM ({_PASSES}) GROUP BY image_id, y, x")
def clahe2(spark, sf_dir):
    return stretch.clahe(images(spark, sf_dir), 8, 8, (2, 4, 8), 64, 1.5).withColumn("v", r4(F.col("v")))
