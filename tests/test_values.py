"""Values of operators that SQL doesn't say: backgrounds, displacement fields, stacks, sketches."""

import numpy as np
from pyspark.sql import functions as F

from lumirel.operators import kernels, reduce

DENSE = "image_id long, grp int, width int, height int, data array<double>"
N = 64
Y, X = np.indices((N, N)).astype(float)


def images(spark, *stack):
    return spark.createDataFrame([(i, 0, im.shape[1], im.shape[0], im.ravel().tolist()) for i, im in enumerate(stack)], DENSE)


def got(df):
    return {r.image_id: np.array(r.data).reshape(r.height, r.width) for r in df.collect()}


def scene(dy=0.0, dx=0.0):
    out = np.zeros((N, N))
    for a, b, c, d in np.random.default_rng(4).random((90, 4)):
        out += 1000 * (0.3 + c) * np.exp(-((Y - a * 76 + 6 - dy) ** 2 + (X - b * 76 + 6 - dx) ** 2) / (2 * (1.2 + 2 * d) ** 2))
    return out


def test_neutralized_background_is_flat(spark):
    plane = 500 + 4 * X + 2 * Y + 0.03 * X * Y
    disk = np.hypot(X - 32, Y - 32) <= 15
    df = kernels.with_disk(images(spark, plane + 20000 * disk), 32.0, 32.0, 16.0)
    for rounds in (1, 3):
        out = got(kernels.neutralize_bg(df, rounds))[0]
        assert out[np.hypot(X - 32, Y - 32) > 16].max() < 1e-3 * plane.max()
        assert np.abs(out[disk] - 20000).max() < 1
    model = got(kernels.bg_model(df))[0]
    assert np.abs(model - plane).max() < 1
    ring = got(kernels.bg_model(kernels.with_disk(images(spark, np.where(np.hypot(X - 32, Y - 32) < 24, plane - 900, 9e4)), 32.0, 32.0, 16.0), ring=(1.1, 1.4)))[0]
    assert np.abs(ring - plane + 900)[np.hypot(X - 32, Y - 32) < 22].max() < 1


def test_fields_of_moved_images(spark):
    df = images(spark, scene(), scene(2, -1), np.ones((N, N)))
    rows = kernels.tile_displacement(df, df.filter("image_id = 0"), 32, 8).collect()
    inner = [r for r in rows if r.image_id == 1 and r.confidence > 0]
    # A faded window draws a tile's shift towards 0; dedistort measures again on what it made.
    assert len(inner) == 16 and 1.4 < np.median([r.dy for r in inner]) < 2.4
    assert -1.4 < np.median([r.dx for r in inner]) < -0.4
    assert all(abs(r.dy) < 1e-6 and abs(r.dx) < 1e-6 for r in rows if r.image_id == 0) and all(r.confidence == 0 for r in rows if r.image_id == 2)
    assert sorted({r.ty for r in rows}) == [16, 24, 32, 40]


def test_stack_is_nearer_than_the_plain_mean(spark):
    moved = [scene(), scene(1.5, -1), scene(-1, 2), scene(0.5, 1)]
    df = images(spark, *moved)
    stacked = kernels.stack_images(df, df.filter("image_id = 0"), tile=32, step=8).collect()
    out = np.zeros((N, N))
    for r in stacked:
        out[r.y, r.x] = r.v
    inner = np.s_[8:-8, 8:-8]
    off, plain = (np.abs(a - scene())[inner].mean() for a in (out, np.mean(moved, axis=0)))
    assert len(stacked) == N * N and off < 0.5 * plain
    same = kernels.stack_images(images(spark, scene(), scene()), images(spark, scene()), tile=32, step=8)
    assert np.allclose([r.v for r in same.orderBy("y", "x").collect()], scene().ravel())


def test_sketches_stay_within_their_error(spark):
    rng = np.random.default_rng(0)
    data = {i: rng.integers(0, 3000, 20000).astype(float) for i in range(2)}
    px = spark.createDataFrame([(i, float(v)) for i, vs in data.items() for v in vs], "image_id long, v double")
    for accuracy in (50, 10000):
        for r in reduce.image_sketch(px, accuracy).collect():
            own = np.sort(data[r.image_id])
            for q, v in zip((0.25, 0.5, 0.75), r.quartiles, strict=True):
                low, high = np.searchsorted(own, v), np.searchsorted(own, v, side="right")
                assert low - 1 <= q * len(own) + len(own) / accuracy and high + 1 >= q * len(own) - len(own) / accuracy
            assert abs(r.distinct - len(np.unique(own))) < 0.15 * len(np.unique(own))
    assert reduce.image_sketch(px.filter(F.lit(False))).count() == 0
