"""The box around the brightest pixel of an image, and what queries make of it."""

from lumirel.operators import frames
from lumirel.plans import frame_queries  # noqa: F401
from lumirel.plans.registry import QUERIES


def table(spark, tmp_path, spots):
    """embeddings of images that are dark but for one pixel at (y, x); two of them where a second one is given."""
    rows = [(i, [1.0 if k in {8 * y + x for y, x in at} else 0.0 for k in range(64)], g) for i, (g, *at) in spots.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_nearest_region_goes_by_the_brightest_pixel(spark, tmp_path):
    """A second function of the same name gave boxes of connected pixels, which have no centre."""
    d = table(spark, tmp_path, {1: (0, (2, 2), (5, 5)), 2: (0, (2, 4)), 3: (0, (7, 7)), 4: (1, (2, 2))})
    got = sorted(tuple(r) for r in QUERIES["nearest_region"](spark, d).collect())
    assert got == [(1, 2, 4.0), (2, 1, 4.0)]
    boxes = {r.image_id: (r.top, r.left, r.bottom, r.right) for r in frames.brightest_regions(spark.createDataFrame([(0, 3, 1, 5.0), (0, 1, 4, 5.0)], "image_id long, y int, x int, v double")).collect()}
    assert boxes == {0: (0, 3, 2, 5)}


def test_overlay_is_around_the_brightest_pixel(spark, tmp_path):
    """Boxes of all connected pixels were drawn."""
    d = table(spark, tmp_path, {1: (0, (0, 2), (6, 5)), 2: (0, (4, 4))})
    drawn = {(r.image_id, r.y, r.x) for r in QUERIES["ar_overlay"](spark, d).filter("v = 65535").collect()}
    around = {(2, y, x) for y in (3, 4, 5) for x in (3, 4, 5)}
    # Of equal pixels the first counts; both are at the peak themselves.
    assert drawn == around | {(1, 0, 1), (1, 0, 2), (1, 0, 3), (1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 6, 5)}


def test_crop_is_the_brightest_pixels_box(spark, tmp_path):
    """Whole images were given, as all their pixels touch."""
    d = table(spark, tmp_path, {1: (0, (7, 3)), 2: (0, (4, 4))})
    got = {(r.image_id, r.y, r.x): r.v for r in QUERIES["crop_regions"](spark, d).collect()}
    assert set(got) == {(2, y, x) for y in range(3) for x in range(3)} | {(1, y, x) for y in range(2) for x in range(3)}
    assert {k for k, v in got.items() if v == 65535} == {(1, 1, 1), (2, 1, 1)}
