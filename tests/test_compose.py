"""Composed operators, against direct computations on small images."""

import numpy as np
from pyspark.sql import functions as F

from lumirel.operators import compose, kernels, stretch


def image(spark, data, image_id=0):
    rows = [(image_id, y, x, float(v)) for y, row in enumerate(data) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v double")


def dense(df, column="v"):
    rows = df.collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1))
    for r in rows:
        out[r.y, r.x] = r[column]
    return out


def test_demosaic_of_a_flat_colour(spark):
    y, x = np.indices((6, 6))
    bayer = np.where((y % 2 == 0) & (x % 2 == 0), 10.0, np.where((y % 2 == 1) & (x % 2 == 1), 30.0, 20.0))
    out = compose.demosaic(image(spark, bayer))
    for column, value in (("r", 10), ("g", 20), ("b", 30)):
        assert np.allclose(dense(out, column), value)


def test_mosaic_of_a_cut_image(spark):
    whole = np.random.default_rng(3).random((8, 12)) * 100
    panels = image(spark, whole[:, :7]).union(image(spark, whole[:, 5:], 1))
    places = spark.createDataFrame([(0, 0, 0), (1, 0, 5)], "image_id long, top int, left int")
    assert np.allclose(dense(compose.mosaic(panels, places)), whole)


def test_overlay_draws_borders_only(spark):
    two = image(spark, np.ones((5, 5))).union(image(spark, np.ones((5, 5)), 1))
    boxes = spark.createDataFrame([(0, 1, 1, 3, 3)], "image_id long, top int, left int, bottom int, right int")
    out = dense(compose.overlay_regions(two, boxes, 9.0).filter("image_id = 0"))
    assert (out == 9).sum() == 8 and out[2, 2] == 1
    assert dense(compose.overlay_regions(two, boxes, 9.0).filter("image_id = 1")).max() == 1


def test_voigt_fit_restores_a_line(spark):
    x = np.arange(40.0)
    u = (x - 18.3) / 3.0
    v = 1000 - 400 * (0.3 / (1 + u * u) + 0.7 * np.exp(-np.log(2) * u * u))
    rows = spark.createDataFrame([(0, int(i), float(a)) for i, a in enumerate(v)], "image_id long, y int, v double")
    p = compose.voigt_fit(rows).first()
    assert abs(p.centre - 18.3) < 1e-3 and abs(p.depth - 400) < 1 and abs(p.width - 3) < 0.01 and abs(p.mix - 0.3) < 0.01


def test_chain_and_cutoff(spark):
    out = compose.chain(image(spark, [[0, 100], [200, 300]]), stretch.linear_stretch, lambda p: compose.cutoff(p, 0, 65535, 1, 2))
    assert dense(out).tolist() == [[1.0, 21845.0], [43690.0, 2.0]]


def test_contrast_and_coronagraph_stay_in_range(spark):
    data = 20000 + np.random.default_rng(4).random((8, 8)) * 20000
    for out in (compose.auto_contrast(kernels.with_disk(kernels.from_pixels(image(spark, data)), 3.5, 3.5, 3), 8, 8), compose.coronagraph(image(spark, data), F.col("x") < 4)):
        got = dense(out)
        assert got.min() >= 0 and got.max() <= 65535.0001


def test_jagging_finds_a_moved_row(spark):
    data = np.zeros((7, 9))
    data[:, 4] = 100
    data[3] = np.roll(data[3], 2)
    found = {r.y: r.shift for r in compose.jagging(image(spark, data)).collect()}
    assert max(found, key=found.get) == 3
