"""What grows with a table: rows that steps make, what they shuffle, and odd inputs that larger tables hold."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumirel.operators import compose, evolution, frames, geometry, joins, kernels, stretch
from lumirel.plans import frame_queries, pixel_queries, registry  # noqa: F401
from lumirel.sources.images import as_images, images, pixels, to_images, to_pixels


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def values(df):
    return {(r.image_id, r.y, r.x): r.v for r in df.collect()}


def test_shares_of_tiles_are_no_rows(spark, sf_dir):
    """Rows of 64 bins a tile outgrew images, and were broadcast."""
    for out in (stretch.clahe(pixels(spark, sf_dir), 8, 8, 2, 64, 1.5), stretch.clahe(images(spark, sf_dir), 8, 8, (2, 4, 8), 64, 1.5)):
        assert "Join" not in plan(out) and "Window" not in plan(out)
    few = images(spark, sf_dir).filter("image_id < 5")
    one, two, both = (values(stretch.clahe(few, 8, 8, t, 64, 1.1)) for t in (2, 4, (2, 4)))
    assert len(both) == 5 * 64 and all(np.isclose(v, (one[k] + two[k]) / 2) for k, v in both.items())
    assert values(stretch.clahe(to_pixels(few), 8, 8, 2, 64, 1.1)) == one


def test_contrast_is_one_pass_over_images(spark, sf_dir):
    out = compose.auto_contrast(kernels.with_disk(images(spark, sf_dir), 3.5, 3.5, 2.5), 8, 8)
    assert "Join" not in plan(out) and "Aggregate" not in plan(out)


def test_absent_pixels_are_null(spark):
    rows = spark.createDataFrame([(0, 0, 1, 5.0), (0, 2, 0, 7.0), (0, 1, 2, None), (1, 0, 0, 9.0)], "image_id long, y int, x int, v double")
    got = {r.image_id: (r.width, r.height, r.data) for r in to_images(rows).collect()}
    assert got == {0: (3, 3, [None, 5.0, None, None, None, None, 7.0, None, None]), 1: (1, 1, [9.0])}
    assert as_images(to_images(rows)).filter("image_id = 1").first().data == [9.0]
    assert set(values(stretch.clahe(rows, 3, 3, 2, 4, 2.0))) == {(0, 0, 1), (0, 2, 0), (1, 0, 0)}


def test_clahe_queries_shuffle_nothing(spark, sf_dir):
    for name in ("clahe", "clahe2"):
        out = plan(registry.QUERIES[name](spark, sf_dir))
        assert "Join" not in out and "Aggregate" not in out


def test_resampling_shuffles_images_only(spark, sf_dir):
    dense = images(spark, sf_dir).filter("image_id < 3")
    assert "Join" not in plan(geometry.rescale(dense, 8, 8, 12, 12)) and "Aggregate" not in plan(geometry.rescale(dense, 8, 8, 12, 12))
    out = geometry.rescale(to_pixels(dense), 8, 8, 12, 12)
    assert "Join" not in plan(out) and plan(out).count("Aggregate") == 1
    assert values(out) == values(geometry.rescale(dense, 8, 8, 12, 12))
    # An absent or null tap gives the fill, as does one outside.
    rows = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 1, 1, 3.0), (0, 0, 2, None), (0, 1, 2, 5.0)], "image_id long, y int, x int, v double")
    moved = values(geometry.gather(rows, 3, 2, F.col("y").cast("double"), F.col("x") + 0.5, -1.0))
    assert moved == {(0, 0, 0): 1.5, (0, 0, 1): -1.0, (0, 0, 2): -1.0, (0, 1, 0): -1.0, (0, 1, 1): 4.0, (0, 1, 2): -1.0}


def test_regions_of_one_place_meet_once(spark):
    """All regions of a group at one place were compared with each other."""
    rows = [(i, "a", 3, 3) for i in range(3000)] + [(5000, "a", 4, 3), (5001, "a", 9, 9), (1, "b", 3, 3), (5002, "c", 0, 0), (5002, "c", 0, 1)]
    found = spark.createDataFrame(rows, "image_id long, grp string, cy int, cx int")
    out = frames.nearest_region(found, found, 2.0).persist()
    got = {r.image_id: (r.anchor_id, r.d2) for r in out.collect()}
    assert got == {0: (1, 0.0), 5000: (0, 1.0)} | {i: (0, 0.0) for i in range(1, 3000)}
    met = frames.nearest_region(found, found, 2.0)
    text = met._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text


def test_pairs_meet_as_images(spark):
    """Each pixel of a pair was a row of the join."""
    rows = [(1, "a", 2, 2, 3.0, [5.0, 6.0, 7.0, None]), (2, "a", 2, 2, -3.0, [1.0, 1.0, 1.0, 1.0]), (3, "a", 2, 2, -3.0, [0.0, 0.0]), (4, "b", 2, 2, -3.0, [9.0] * 4), (5, "a", 2, 2, 0.0, [9.0] * 4)]
    out = frames.doppler_pairs(spark.createDataFrame(rows, "image_id long, grp string, width int, height int, pixel_shift double, data array<double>"))
    assert "_s" in plan(out) and plan(out).index("Generate") < plan(out).index("Join")
    got = sorted((r.red_id, r.blue_id, r.y, r.x, r.v) for r in out.collect() if r.v is not None)
    assert got == [(1, 2, 0, 0, 4.0), (1, 2, 0, 1, 5.0), (1, 2, 1, 0, 6.0), (1, 3, 0, 0, 5.0), (1, 3, 0, 1, 6.0)]
    assert out.filter("v is null").count() == 1


def test_points_in_ranges_are_written_small(spark, tmp_path):
    """Pairs came in the order of the points' table, so each took as many bits on disk as a range's number has."""
    rng = np.random.default_rng(5)
    at, low = rng.uniform(-500, 2500, 4000), rng.uniform(0, 4000, 1000)
    at[:500] = 700.5
    points = spark.createDataFrame([(i, float(v)) for i, v in enumerate(at)] + [(4000, None)], "id long, v double")
    ranges = spark.createDataFrame([(j, float(v), float(v) + 500) for j, v in enumerate(low)] + [(1000, None, 4.0)], "r long, low double, high double")
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero((low <= at[:, None]) & (at[:, None] <= low + 500)), strict=True)}
    out = joins.range_join(points, ranges, F.col("v"), "low", "high", 500.0).select("id", "r")
    out.write.parquet(str(tmp_path / "out"))
    back = [(r.id, r.r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(back) == len(want) and set(back) == want
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.5 * len(want)
    few = joins.range_join(points, ranges, F.col("v"), "low", "high", 500.0, rows=300, most=10).select("id", "r").collect()
    many = joins.range_join(points, ranges, F.col("v"), "low", "high", 500.0, rows=300).select("id", "r").collect()
    assert len(few) == len(many) == len(want) and {tuple(r) for r in few} == {tuple(r) for r in many} == want
    assert joins.range_join(points.limit(0), ranges, F.col("v"), "low", "high", 500.0).count() == 0


def test_regions_of_many_images_are_one_call(spark):
    """Each image was a call of its own, all in one task where their few pixels made one small partition."""
    rng = np.random.default_rng(11)
    sizes = {i: (1, 3) if i % 7 else (60, 50) for i in range(-3, 60)}
    rows = [(i, int(y) - 5, int(x)) for i, s in sizes.items() for y, x in zip(*np.nonzero(rng.random(s) < 0.35), strict=True)]
    all_ = pd.DataFrame(rows, columns=["image_id", "y", "x"]).sample(frac=1, random_state=1)
    alone = pd.concat([frames._components(one) for _, one in all_.groupby("image_id")])
    want = sorted(map(tuple, alone.values.tolist()))
    assert len({r[:2] for r in want}) == len(want) > 200 and sum(r[-1] for r in want) == len(rows)
    assert sorted(map(tuple, frames._components(all_).values.tolist())) == want
    out = frames.regions(spark.createDataFrame(all_))
    with_null = spark.createDataFrame(all_).unionByName(spark.sql("select null image_id, 1L y, 1L x"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert sorted(map(tuple, out.collect())) == want
        assert sorted(map(tuple, frames.regions(with_null).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert frames.regions(spark.createDataFrame(all_).limit(0)).count() == 0
    px = pixels(spark, "/root/testdata/sf0.001")
    assert "FlatMapGroupsInPandas" not in plan(frames.active_regions(px)) and "FlatMapGroupsInPandas" not in plan(frames.regions(evolution.outlying(px)))
