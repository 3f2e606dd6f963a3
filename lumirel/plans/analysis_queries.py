"""Queries that analyse frames and series: borders and lines, drift, atlas search, positions of images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pixel import annulus
from ..operators import atlas, consensus, evolution, frames, kernels, lines, lists, mosaics, oscillation, scatter, stencil, stretch
from ..sources.images import images, pixels, table, to_pixels
from ..sources.tables import written
from .registry import query, r4, s4


@query(
    f"""WITH {{px}}, m AS (SELECT image_id, x, avg(v) * avg(v) AS m FROM px GROUP BY image_id, x), e AS (SELECT image_id, min(m) AS low, max(m) AS high FROM m GROUP BY image_id),
n AS (SELECT image_id, x, (m - low) / nullif(high - low, 0) AS m FROM m JOIN e USING (image_id)),
l AS (SELECT image_id, x, m, lag(x) OVER w AS xa, lag(m) OVER w AS ma, lead(x) OVER w AS xb, lead(m) OVER w AS mb FROM n WINDOW w AS (PARTITION BY image_id ORDER BY x)),
b AS (SELECT image_id, min(x) FILTER (m > 0.3) AS "left", max(x) FILTER (m > 0.3) AS "right", arg_min(coalesce(xa + (0.3 - ma) * (x - xa) / (m - ma), x), x) FILTER (m > 0.3) AS sl, arg_max(coalesce(xb + (0.3 - mb) * (x - xb) / (m - mb), x), x) FILTER (m > 0.3) AS sr FROM l GROUP BY image_id)
SELECT image_id, "left", "right", {s4("sl")} AS sub_left, {s4("sr")} AS sub_right FROM b"""
)
def line_borders(spark, sf_dir):
    out = lines.borders(pixels(spark, sf_dir), share=0.3)
    return out.withColumn("sub_left", r4(F.col("sub_left"))).withColumn("sub_right", r4(F.col("sub_right")))


_ROUND = """f{n} AS (SELECT image_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k{n} GROUP BY image_id),
o{n} AS (SELECT k.image_id, x, y, y - a - b * x AS r FROM k{n} k JOIN f{n} f ON k.image_id = f.image_id),
c{n} AS (SELECT image_id, median(r) AS m FROM o{n} GROUP BY image_id),
s{n} AS (SELECT o.image_id, any_value(m) AS m, 1.4826 * median(abs(r - m)) AS s FROM o{n} o JOIN c{n} c ON o.image_id = c.image_id GROUP BY o.image_id),
t{n} AS (SELECT o.image_id, x, y, s, abs(r - m) > 2 * s AND s >= 0.01 AS far FROM o{n} o JOIN s{n} s ON o.image_id = s.image_id),
g{n} AS (SELECT image_id, count(*) FILTER (far) > 0 AND count(*) FILTER (NOT far) >= 4 AS goes FROM t{n} GROUP BY image_id),
k{m} AS (SELECT t.image_id, x, y FROM t{n} t JOIN g{n} g ON t.image_id = g.image_id WHERE NOT (far AND goes))"""


@query(
    f"""WITH {{px}}, k0 AS (SELECT image_id, x, arg_min(y, (v, y)) AS y FROM px GROUP BY image_id, x), {_ROUND.format(n=0, m=1)}, {_ROUND.format(n=1, m=2)}
SELECT image_id, {s4("regr_intercept(y, x)")} AS intercept, {s4("regr_slope(y, x)")} AS slope, count(*) AS n, 8 - count(*) AS n_rejected FROM k2 GROUP BY image_id"""
)
def robust_line(spark, sf_dir):
    """The darkest pixels of each frame's columns as a straight line without outliers, in two rounds."""
    points = frames.line_minimum(pixels(spark, sf_dir))
    fit = lines.robust_fit(points, 1, kappa=2.0, rounds=2, least=4)
    return fit.select("image_id", r4(F.col("coefficients")[0]).alias("intercept"), r4(F.col("coefficients")[1]).alias("slope"), "n", "n_rejected")


@query()
def frame_analysis(spark, sf_dir):
    """Borders and the weighted parabola of the line of each frame."""
    return lines.analyzed(pixels(spark, sf_dir).select("image_id", "y", "x", "v"), kappa=3.0)


@query()
def frame_realignment(spark, sf_dir):
    """Frames whose line lies a pixel or more off the mean profile of all frames, followed anew."""
    px = pixels(spark, sf_dir).select("image_id", "y", "x", "v")
    fits = written(lines.analyzed(px), "fits")
    mean = lines.straightened(px, fits, 3).groupBy("y").agg(F.avg("v").alias("v"))
    return lines.realigned(px, fits, written(mean, "mean"), 3, 2)


@query()
def oscillations(spark, sf_dir):
    """Periods in the hourly means of each type of event, weighted by their counts."""
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    series = table(spark, sf_dir, "events").groupBy("event_type", hour.alias("y")).agg(F.avg("value").alias("v"), F.count("value").alias("w"))
    return oscillation.oscillations(series, "event_type")


@query(
    f"""WITH {{px}}, p AS (SELECT grp, y * 8 + x AS y, avg(v) AS v FROM px GROUP BY ALL), a AS (SELECT event_id AS pos, value AS v FROM events),
c AS (SELECT grp, pos - y AS pos, corr(p.v, a.v) AS score FROM p JOIN a ON true GROUP BY grp, pos - y HAVING count(*) = 64),
w AS (SELECT *, max(score) OVER (PARTITION BY grp ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS best, max(score) OVER (PARTITION BY grp ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS before FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, pos) AS rank FROM w WHERE score >= best AND (before IS NULL OR score > before))
SELECT grp, CAST(rank AS INT) AS rank, pos, {s4("score")} AS score FROM r WHERE rank <= 3"""
)
def atlas_peaks(spark, sf_dir):
    """Where the mean image of each group lies best in the series of all events."""
    rows = pixels(spark, sf_dir).groupBy("grp", (F.col("y") * 8 + F.col("x")).alias("y")).agg(F.avg("v").alias("v"))
    series = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("value").alias("v"))
    return atlas.search(rows, series, 3, 16, key="grp").select("grp", "rank", "pos", r4(F.col("score")).alias("score"))


@query()
def consensus_positions(spark, sf_dir):
    """Where each image lies against the others of its group."""
    return consensus.positions(images(spark, sf_dir))


@query()
def consensus_reference(spark, sf_dir):
    """The mean image of each group, of images moved to where they agree to lie."""
    return consensus.consensus(images(spark, sf_dir))


_RING = "((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5)) / 9.0 BETWEEN 0.25 AND 1"
_LAP = """lap AS (SELECT a.image_id, a.y, a.x, sum(b.v * (CASE WHEN dy = 0 THEN -2 ELSE 1 END) * (CASE WHEN dx = 0 THEN -2 ELSE 1 END)) AS r FROM px a, (VALUES (-1), (0), (1)) dy(dy), (VALUES (-1), (0), (1)) dx(dx), px b
  WHERE b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx AND a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY ALL)"""


def _ring():
    return annulus(3.5, 3.5, 3.0, 0.5, 1.0)


@query(f"WITH {{px}}, {_LAP}, k AS (SELECT image_id, abs(r) AS r, row_number() OVER (PARTITION BY image_id ORDER BY abs(r)) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM lap WHERE r <> 0 AND {_RING}) SELECT image_id, {s4('1.4826 * r / 6')} AS sigma FROM k WHERE k = n // 2 + 1")
def noise_sigma_masked(spark, sf_dir):
    return stencil.noise_sigma(pixels(spark, sf_dir), _ring()).withColumn("sigma", r4(F.col("sigma")))


@query(
    f"""WITH {{px}}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM px WHERE {_RING}),
q AS (SELECT image_id, max(v) FILTER (k = floor(0.05 * (n - 1) + 0.5)) AS p0, max(v) FILTER (k = floor(0.95 * (n - 1) + 0.5)) AS p1 FROM r GROUP BY image_id),
t AS (SELECT image_id, max(v) AS top FROM px GROUP BY image_id)
SELECT image_id, y, x, {s4('least(greatest((v - p0) * (65535 / (greatest(p1, top) - p0)), 0), 65535)')} AS v FROM px JOIN q USING (image_id) JOIN t USING (image_id)"""
)
def percentile_stretch_masked(spark, sf_dir):
    out = stretch.percentile_stretch(pixels(spark, sf_dir), 5, 95, 2, _ring())
    return out.select("image_id", "y", "x", r4(F.col("v")).alias("v"))


_UNIT = "CASE WHEN {x} <= 0 THEN 0 WHEN {x} >= 1 THEN 1 ELSE ({m} - 1) * {x} / ((2 * {m} - 1) * {x} - {m}) END"


@query(
    f"WITH {{px}}, a AS (SELECT image_id, median(v) / 65535 AS med FROM px WHERE {_RING} GROUP BY image_id), b AS (SELECT image_id, any_value(med) AS med, 1.4826 * median(abs(v / 65535 - med)) AS mad FROM px JOIN a USING (image_id) WHERE {_RING} GROUP BY image_id), "
    f"c AS (SELECT image_id, least(greatest(med - 2.8 * mad, 0), 1) AS lo, med FROM b), d AS (SELECT image_id, lo, {_UNIT.format(x='(med - lo)', m='0.25')} AS mid FROM c) "
    f"SELECT image_id, y, x, {s4('65535 * ' + _UNIT.format(x='((v / 65535 - lo) / (1 - lo))', m='mid'))} AS v FROM px JOIN d USING (image_id)"
)
def mtf_autostretch_masked(spark, sf_dir):
    out = stretch.mtf_autostretch(pixels(spark, sf_dir), mask=_ring())
    return out.select("image_id", "y", "x", r4(F.col("v")).alias("v"))


@query("WITH {px} SELECT y, x, median(v) AS v FROM px GROUP BY y, x")
def continuum_where_nothing_is_kept(spark, sf_dir):
    """No image is so far from the line, so it is the median of all."""
    return lists.continuum(pixels(spark, sf_dir), least_shift=100.0, or_all=True)


def _disks(spark, sf_dir):
    return kernels.with_disk(images(spark, sf_dir), 3.5, 3.5, 2.5)


@query(
    f"""WITH {{px}}, w AS (SELECT i, [1, 3, 5, 3, 1][i + 3] AS w FROM generate_series(-2, 2) s(i))
SELECT a.image_id, a.y, a.x, {s4("sum(b.v * p.w * q.w) / 169")} AS v FROM px a, w p, w q, px b WHERE b.image_id = a.image_id AND b.y = least(greatest(a.y + p.i, 0), 7) AND b.x = least(greatest(a.x + q.i, 0), 7) GROUP BY a.image_id, a.y, a.x"""
)
def convolve_wide(spark, sf_dir):
    one = [1, 3, 5, 3, 1]
    out = to_pixels(scatter.convolve_wide(images(spark, sf_dir), [[a * b / 169 for a in one] for b in one]))
    return out.withColumn("v", r4(F.col("v")))


@query()
def deghost(spark, sf_dir):
    return to_pixels(scatter.deghost(_disks(spark, sf_dir)))


@query()
def descatter(spark, sf_dir):
    return to_pixels(scatter.descatter(_disks(spark, sf_dir)))


_SURFACE = """l AS (SELECT image_id, x, y, v, s, 1 - abs(y - (3.2 + 0.1 * x) - s) AS w FROM px, (VALUES (-1.0), (0.0), (1.5), (6.0)) t(s)),
f AS (SELECT image_id, x, s, CASE WHEN sum(w) > 0.999999 THEN sum(w * v) END AS v FROM l WHERE w > 0 GROUP BY image_id, x, s)"""
_SHIFTS = [-1.0, 0.0, 1.5, 6.0]


def _surface(spark, sf_dir):
    return evolution.line_surface(pixels(spark, sf_dir), F.lit(3.2) + 0.1 * F.col("x"), _SHIFTS, 6562.8, 0.05)


@query(f"WITH {{px}}, {_SURFACE} SELECT image_id, x, s::DOUBLE AS shift, floor((6562.8 + s * 0.05) * 10000 + 0.5) / 10000 AS wavelength, {s4('v')} AS v FROM f WHERE v IS NOT NULL")
def line_surface(spark, sf_dir):
    rows = _surface(spark, sf_dir).select("image_id", "x", F.explode(F.arrays_zip("shifts", "wavelengths", "values")).alias("p"))
    return rows.filter("p.values is not null").select("image_id", "x", F.col("p.shifts").alias("shift"), r4(F.col("p.wavelengths")).alias("wavelength"), r4(F.col("p.values")).alias("v"))


@query(f"WITH {{px}}, {_SURFACE} SELECT image_id, s::DOUBLE AS shift, {s4('avg(v)')} AS v, count(v) AS n FROM f WHERE x BETWEEN 2 AND 5 GROUP BY image_id, s HAVING count(v) > 0")
def profile_evolution(spark, sf_dir):
    out = evolution.profile_evolution(_surface(spark, sf_dir), 2, 5)
    return out.filter("n > 0").select("image_id", "shift", r4(F.col("v")).alias("v"), "n")


@query(f"WITH {{px}}, {_SURFACE}, a AS (SELECT abs(s) AS shell, image_id AS y, x, avg(v) AS v FROM f GROUP BY abs(s), image_id, x) SELECT shell::DOUBLE AS shell, {s4('1 + 0.2 * (1 - shell / 6.0)')} AS radius, y, x, {s4('v')} AS v FROM a WHERE v IS NOT NULL")
def shells(spark, sf_dir):
    out = evolution.shells(_surface(spark, sf_dir), 0.2).filter("v is not null")
    return out.select("shell", r4(F.col("radius")).alias("radius"), "y", "x", r4(F.col("v")).alias("v"))


@query()
def detection_tracks(spark, sf_dir):
    """What stands out in images of a group that follow each other, of all groups in one plan."""
    return evolution.tracks(pixels(spark, sf_dir).select("image_id", "grp", "y", "x", "v"), 3.0, by="grp")


@query("WITH {px}, l AS (SELECT grp, y, x, image_id, v, lead(v) OVER (PARTITION BY grp, y, x ORDER BY image_id) AS n FROM px) SELECT CAST(s AS INT) AS step, y, x, v + (n - v) * s / 4.0 AS v FROM l, generate_series(1, 3) t(s) WHERE n IS NOT NULL")
def transition_table(spark, sf_dir):
    """Transitions by a table function of SQL."""
    evolution.register(spark)
    return spark.sql("SELECT step, y, x, v FROM transition(TABLE({px}) PARTITION BY (grp, y, x) ORDER BY (image_id), 3)", px=pixels(spark, sf_dir))


@query()
def mosaic_places(spark, sf_dir):
    """Where the images of each group would lie on one canvas, by the overlaps that agree."""
    return mosaics.places(images(spark, sf_dir))
