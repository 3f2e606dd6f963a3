"""Kernels that SQL can't express, against direct computations; and sources, by round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumirel.functions import color, pixel
from lumirel.operators import geometry, kernels, lists, reduce, stencil, stretch
from lumirel.sources import fits, ser
from lumirel.streaming import frames


def image(spark, data, image_id=0):
    rows = [(image_id, y, x, float(v)) for y, row in enumerate(data) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v double")


def dense(df):
    rows = df.collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1))
    for r in rows:
        out[r.y, r.x] = r.v
    return out


def stack_of(spark, *data):
    rows = [(i, len(d[0]), len(d), [float(v) for row in d for v in row]) for i, d in enumerate(data)]
    return spark.createDataFrame(rows, "image_id long, width int, height int, data array<double>")


def arrays(df):
    return {r.image_id: np.array(r.data).reshape(r.height, r.width) for r in df.collect()}


def test_poly_fit_restores_a_polynomial_by_disks_of_their_own(spark):
    y, x = np.indices((9, 12))
    data = 100 + 3 * x - 2 * y + 0.5 * x * y
    own = kernels.with_disk(stack_of(spark, data, data, data[:7, :7]), F.lit(4.0) + F.col("image_id") % 2, 3.0, 3.5)
    for i, out in arrays(kernels.poly_fit_2d(own, degree=2)).items():
        h, w = out.shape
        inside = (x[:h, :w] - 4 - i % 2) ** 2 + (y[:h, :w] - 3) ** 2 <= 3.5**2
        assert np.allclose(out[inside], data[:h, :w][inside]) and (out[~inside] == 0).all()


def test_bg_model_restores_a_plane(spark):
    y, x = np.indices((16, 16))
    data = 500 + 4.0 * x + 2.0 * y
    own = kernels.with_disk(stack_of(spark, data), 8, 8, 5)
    assert np.allclose(arrays(kernels.bg_model(own, sigma=10))[0], data, rtol=1e-3)
    assert np.allclose(arrays(kernels.bg_model(own, sigma=10, step=2))[0], data, rtol=1e-3)
    assert arrays(kernels.neutralize_bg(own, 3))[0].max() < 20


def smooth(seed, n=64):
    rng = np.random.default_rng(seed)
    f = np.fft.fft2(rng.random((n, n)))
    k = np.hypot(*np.meshgrid(np.fft.fftfreq(n), np.fft.fftfreq(n)))
    out = np.real(np.fft.ifft2(f * np.exp(-((k / 0.12) ** 2))))
    return (out - out.min()) / np.ptp(out) * 60000


def test_displacement_between_pixels(spark):
    base = smooth(5)
    y, x = np.indices(base.shape).astype(float)
    moved = kernels.sample(base, y - 2.3, x + 1.4)
    found = {r.image_id: (r.dy, r.dx) for r in kernels.displacement(stack_of(spark, base, moved), stack_of(spark, base)).collect()}
    assert np.allclose(found[0], (0, 0), atol=0.02) and np.allclose(found[1], (2.3, -1.4), atol=0.3)


def test_dedistort_follows_a_field(spark):
    base = smooth(6)
    y, x = np.indices(base.shape).astype(float)
    bent = kernels.sample(base, y + 2 * np.sin(x / 20), x + 1.5 * np.cos(y / 25))
    out = arrays(kernels.dedistort(stack_of(spark, base, bent), stack_of(spark, base), 24, 8))
    inner = np.s_[8:-8, 8:-8]
    assert np.abs(out[0] - base).max() < 1e-6
    assert np.abs(out[1] - base)[inner].mean() < 0.5 * np.abs(bent - base)[inner].mean()
    with pytest.raises(Exception, match="same dimensions"):
        kernels.dedistort(stack_of(spark, base[:32]), stack_of(spark, base)).collect()


def test_resampling_keeps_smooth_images(spark):
    base = smooth(7)
    for kind in ("bilinear", "bicubic", "lanczos"):
        big = kernels.resample(stack_of(spark, base), 128, 128, kind)
        back = arrays(kernels.resample(big, 64, 64, kind))[0]
        assert np.abs(back - base)[6:-6, 6:-6].mean() < 400
    y, x = np.indices((5, 5)).astype(float)
    assert np.allclose(kernels.sample(base, y, x), base[:5, :5])


def ellipse_image(cx, cy, rx, ry, angle, n=96):
    y, x = np.indices((n, n))
    u = (x - cx) * np.cos(angle) + (y - cy) * np.sin(angle)
    v = (y - cy) * np.cos(angle) - (x - cx) * np.sin(angle)
    return 50000 / (1 + np.exp((np.hypot(u / rx, v / ry) - 1) * 40))


def test_ellipse_fit_drops_outliers_and_geometry_is_fixed(spark):
    data = ellipse_image(50, 44, 36, 27, 0.4)
    dirty = data.copy()
    dirty[5:8, 80:86] = 65000
    found = {r.image_id: r for r in kernels.ellipse_fit(stack_of(spark, data, dirty), share=0.06).collect()}
    for r in found.values():
        assert np.allclose((r.cx, r.cy, r.rx, r.ry), (50, 44, 36, 27), atol=0.6) and abs(r.angle - 0.4) < 0.03
    images = stack_of(spark, data)
    again = kernels.ellipse_fit(kernels.fix_geometry(images, kernels.ellipse_fit(images, share=0.06)), share=0.06).first()
    assert abs(again.rx - again.ry) < 0.7 and abs(again.rx - 36) < 0.8


def test_blend_takes_the_stronger_detail(spark):
    base = smooth(8)
    flat = np.full_like(base, base.mean())
    assert np.allclose(arrays(kernels.laplacian_blend(stack_of(spark, base), stack_of(spark, base)))[0], base)
    out = arrays(kernels.laplacian_blend(stack_of(spark, base), stack_of(spark, flat)))[0]
    assert np.corrcoef(out.ravel(), base.ravel())[0, 1] > 0.9


def test_angular_correlation_finds_a_rotation(spark):
    base = smooth(9)
    y, x = np.indices(base.shape) - 31.5
    t = np.radians(7)
    turned = kernels.sample(base, y * np.cos(t) - x * np.sin(t) + 31.5, x * np.cos(t) + y * np.sin(t) + 31.5)
    got = {r.image_id: r.degrees for r in kernels.angular_correlation(stack_of(spark, base, turned), stack_of(spark, base), 12).collect()}
    assert got == {0: 0.0, 1: 7.0}


def test_rl_decon_sharpens(spark):
    data = np.full((11, 11), 100.0)
    data[5, 5] = 5000
    soft = kernels.convolved(data[None], np.outer([0.25, 0.5, 0.25], [0.25, 0.5, 0.25]))[0]
    assert arrays(kernels.rl_decon(stack_of(spark, soft)))[0][5, 5] > soft[5, 5]


def test_weights_and_sizes_are_checked(spark):
    two = image(spark, np.ones((2, 2))).withColumn("grp", F.lit(0))
    for bad in (-1.0, float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="weights must be"):
            reduce.weighted_avg(two.withColumn("w", F.lit(bad).cast("double"))).collect()
    mixed = two.union(image(spark, np.ones((3, 2)), 1).withColumn("grp", F.lit(0)))
    with pytest.raises(Exception, match="same dimensions"):
        reduce.same_dimensions(mixed).collect()
    assert reduce.same_dimensions(two).count() == 4


def test_polynomial_fit_restores_coefficients(spark):
    from lumirel.operators import frames as profiles

    rows = [(k, float(x), 3.0 - 2.0 * x + 0.25 * k * x * x) for k in (1, 2) for x in range(12)] + [(3, 1.0, 1.0)]
    got = {r.image_id: r.coefficients for r in profiles.polynomial_fit(spark.createDataFrame(rows, "image_id long, x double, y double"), 2).collect()}
    assert np.allclose(got[1], [3, -2, 0.25]) and np.allclose(got[2], [3, -2, 0.5]) and got[3] is None


def test_gaussian_blur_keeps_a_constant(spark):
    assert np.allclose(dense(stencil.gaussian_blur(image(spark, np.full((5, 7), 17.0)), 1.0, 2)), 17.0)


def test_clahe_is_within_range_and_spreads(spark):
    rng = np.random.default_rng(1)
    data = 30000 + rng.random((16, 16)) * 3000
    out = dense(stretch.clahe(image(spark, data), 16, 16, 8, 256, 4.0))
    assert 0 <= out.min() and out.max() <= 65535.0001
    assert np.ptp(out) > np.ptp(data)


def test_rescale_keeps_a_gradient(spark):
    data = np.tile(np.arange(8.0), (8, 1))
    out = dense(geometry.rescale(image(spark, data), 8, 8, 16, 16))
    assert np.allclose(np.diff(out[8, 2:14]), 0.5)


def test_weighted_average_of_constants(spark):
    both = image(spark, np.full((2, 2), 10.0)).union(image(spark, np.full((2, 2), 20.0), 1)).withColumn("grp", F.lit(0)).withColumn("w", F.when(F.col("image_id") == 0, 1.0).otherwise(3.0))
    assert (dense(reduce.weighted_clipped_avg(both, 2.5)) == 17.5).all()
    assert (dense(reduce.weighted_avg(both.withColumn("w", F.lit(0.0)))) == 0).all()


def test_hsl_round_trip(spark):
    rgb = spark.range(200).select(*((F.rand(i) * 0.98 + 0.01).alias(c) for i, c in enumerate("rgb")))
    r, g, b = (F.col(c) for c in "rgb")
    back = color.from_hsl(*color.to_hsl(r, g, b))
    off = rgb.select(F.max(sum((F.abs(x - y) for x, y in zip((r, g, b), back, strict=True)), F.lit(0.0)))).first()[0]
    assert off < 1e-9


def test_ieee_division(spark):
    row = spark.range(1).select(*(pixel.divide(F.lit(a), F.lit(0.0)) for a in (1.0, -1.0, 0.0))).first()
    assert row[0] == float("inf") and row[1] == float("-inf") and row[2] != row[2]


def test_filters_drop_absent_values(spark):
    rows = spark.createDataFrame([("a.ser", None), ("b.fits", 2.0)], "file_name string, pixel_shift double")
    assert lists.filter_list(rows, "pixelShift", "!=", 5.0).count() == 1
    assert lists.filter_list(rows, "fileName", "ends-with", ".ser").count() == 1
    assert lists.filter_list(rows, "fileName", ">", "a").count() == 0
    assert lists.filter_list(rows, "nothing", "==", "a").count() == 0


def test_ser_round_trip(spark, tmp_path):
    data = np.random.default_rng(2).integers(0, 65535, (5, 4, 6))
    ticks = [638000000000000000 + i * 400000 for i in range(5)]
    ser.write(str(tmp_path / "a.ser"), data, ticks)
    got = ser.read_frames(spark, str(tmp_path))
    assert [list(r.data) for r in got.orderBy("frame_id").collect()] == data.reshape(5, -1).tolist()
    assert ser.read_frames(spark, str(tmp_path), 1, 2).count() == 2
    assert ser.estimate_fps(got).first().fps == pytest.approx(25.0)
    with pytest.raises(ValueError):
        ser.header(b"nothing")


def test_fits_round_trip(spark, tmp_path):
    data = np.arange(12, dtype=float).reshape(3, 4)
    (tmp_path / "a.fits").write_bytes(fits.encode(data, {"OBSERVER": "me"}))
    row = fits.read(spark, str(tmp_path)).first()
    assert row.data == data.ravel().tolist() and row.meta["OBSERVER"] == "me"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = frames.running_mean(frames.frames(spark, str(tmp_path / "in"), events.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.event_type, r.n) for r in spark.table("means").collect()) == sorted((r.event_type, r.n) for r in frames.running_mean(events).collect())
