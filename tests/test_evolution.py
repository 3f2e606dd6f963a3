"""Profiles over time, tracks of detections, table functions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumirel.operators import evolution, frames
from lumirel.plans import analysis_queries  # noqa: F401
from lumirel.plans.registry import QUERIES


def pixels(spark, *images, ids=None):
    rows = [(i, y, x, float(v)) for i, image in zip(ids or range(len(images)), images, strict=True) for y, row in enumerate(image) for x, v in enumerate(row)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "y", "x", "v"])).selectExpr("image_id", "cast(y as int) y", "cast(x as int) x", "v")


def test_surface_follows_each_frames_own_line(spark):
    y, x = np.indices((20, 12)).astype(float)
    lines = {0: [8.0, 0.25], 1: [5.0, 0.0, 0.05]}
    data = [100 + 7 * (y - np.polynomial.polynomial.polyval(x, c)) for c in lines.values()]
    fits = spark.createDataFrame(list(lines.items()), "image_id long, coefficients array<double>")
    own = pixels(spark, *data).join(fits, "image_id")
    got = evolution.line_surface(own, evolution.polynomial(), [-2.0, 0.0, 0.5, 30.0], 500.0, 0.1).collect()
    assert len(got) == 24
    for r in got:
        assert np.allclose(r["values"][:3], [86, 100, 103.5]) and r["values"][3] is None and np.allclose(r.wavelengths, [499.8, 500, 500.05, 503])


def test_shells_join_both_wings(spark):
    y, x = np.indices((9, 3)).astype(float)
    surface = evolution.line_surface(pixels(spark, 100 + 10 * np.abs(y - 4) + (y > 4)), F.lit(4.0), [-2.0, -1.0, 0.0, 1.0, 2.0, 4.5])
    got = {(r.shell, r.x): (r.radius, r.v) for r in evolution.shells(surface, 0.3).collect()}
    assert np.isclose(got[0.0, 1][0], 1.3) and got[0.0, 1][1] == 100 and got[2.0, 0][1] == 120.5 and np.isclose(got[4.5, 2][0], 1.0) and got[4.5, 2][1] is None


def planted():
    rng = np.random.default_rng(3)
    images = [1000 + 50 * np.arange(40)[None, :] + rng.normal(size=(30, 40)) for _ in range(14)]
    boxes = {}
    for k in range(2, 7):
        images[k][4 + k : 7 + k, 10:12] += 60
        boxes.setdefault("moving", []).append(k)
    for k in (1, 2, 9):
        images[k][20:22, 30:33] -= 80
    images[12][0, 0] += 90
    return images


def test_tracks_of_planted_blobs(spark):
    got = evolution.tracks(pixels(spark, *planted()), 9.0).collect()
    rows = sorted((r.first, r.last, r.n_frames, r.n_pixels, r.top, r.left, r.bottom, r.right) for r in got)
    assert rows == [(1, 2, 2, 12, 20, 30, 21, 32), (2, 6, 5, 30, 6, 10, 12, 11), (9, 9, 1, 6, 20, 30, 21, 32), (12, 12, 1, 1, 0, 0, 0, 0)]
    assert all(r.peak > 30 for r in got)
    wide = evolution.tracks(pixels(spark, *planted()), 9.0, least=2, gap=7).collect()
    assert sorted((r.first, r.last, r.n_frames) for r in wide) == [(1, 9, 3), (2, 6, 5)]
    flat = pixels(spark, np.ones((4, 4)))
    assert evolution.tracks(flat).count() == 0 and evolution.tracks(flat.limit(0)).count() == 0


def test_tracks_equal_links_by_force(spark):
    rng = np.random.default_rng(8)
    images = [(rng.random((12, 90)) < 0.03) * 500.0 + rng.normal(size=(12, 90)) for _ in range(9)]
    got = evolution.tracks(pixels(spark, *images), 20.0, gap=2, reach=2).collect()
    blobs = []
    for k, image in enumerate(images):
        todo = set(zip(*(a.tolist() for a in np.nonzero(image > 200)), strict=True))
        while todo:
            own, edge = set(), [todo.pop()]
            while edge:
                p = edge.pop()
                own.add(p)
                near = {q for q in todo if abs(q[0] - p[0]) <= 1 and abs(q[1] - p[1]) <= 1}
                todo -= near
                edge += near
            ys, xs = zip(*own, strict=True)
            blobs.append((k, min(ys), min(xs), max(ys), max(xs), len(own)))
    name = list(range(len(blobs)))
    for _ in blobs:
        for i, a in enumerate(blobs):
            for j, b in enumerate(blobs):
                if 0 < abs(a[0] - b[0]) <= 2 and b[1] - 2 <= a[3] and b[3] + 2 >= a[1] and b[2] - 2 <= a[4] and b[4] + 2 >= a[2]:
                    name[i] = name[j] = min(name[i], name[j])
    want = pd.DataFrame(blobs, columns=["k", "t", "l", "b", "r", "n"]).assign(track=name).groupby("track").agg(first=("k", "min"), last=("k", "max"), n=("n", "sum"), t=("t", "min"), l=("l", "min"), b=("b", "max"), r=("r", "max"))
    assert sorted((r.first, r.last, r.n_pixels, r.top, r.left, r.bottom, r.right) for r in got) == sorted(map(tuple, want.values.tolist()))


def test_table_functions_give_the_rows_of_the_operators(spark):
    px = pixels(spark, *planted()[:3])
    level = px.groupBy("image_id").agg((F.avg("v") + F.stddev_pop("v")).alias("t"))
    bright = px.join(level, "image_id").filter("v > t").select("image_id", "y", "x")
    evolution.register(spark)
    got = spark.sql("SELECT * FROM active_regions(TABLE({bright}) PARTITION BY image_id)", bright=bright)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, frames.active_regions(px, 1.0).collect()))
    none = spark.sql("SELECT * FROM active_regions(TABLE({bright}) PARTITION BY image_id)", bright=bright.limit(0))
    assert none.count() == 0


def test_tracks_follow_the_images_of_a_group(spark, tmp_path):
    """Only images of following ids were linked, of whatever groups, so links within a group were left out and others made."""
    rng = np.random.default_rng(12)
    groups = {i: (None, 0, 1, 7)[k] for i, k in zip(np.cumsum(rng.integers(1, 40, 120)).tolist(), rng.integers(0, 4, 120).tolist(), strict=True)}
    data = {i: (0.01 * rng.normal(size=64) + 0.4 * (rng.random(64) < 0.04)).astype(np.float32) for i in groups}
    spark.createDataFrame([(i, data[i].tolist(), groups[i]) for i in groups], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    blobs, at = [], {}
    for i, g in groups.items():
        at[g] = at.get(g, 0) + 1
        image = np.floor((data[i].astype(float) + 1) * 32767.5).reshape(8, 8)
        off = np.abs(image - np.median(image, axis=0))
        y, x = np.nonzero(off > 3 * 1.4826 * np.median(off))
        own = frames._components(pd.DataFrame({"image_id": i, "y": y, "x": x}))
        blobs += [(g, at[g], i, *r) for r in own[["top", "left", "bottom", "right", "n"]].itertuples(index=False, name=None)]
    name = list(range(len(blobs)))
    for _ in range(200):
        before = list(name)
        for p, a in enumerate(blobs):
            for q, b in enumerate(blobs):
                if a[0] == b[0] and abs(a[1] - b[1]) == 1 and b[3] - 1 <= a[5] and b[5] + 1 >= a[3] and b[4] - 1 <= a[6] and b[6] + 1 >= a[4]:
                    name[p] = name[q] = min(name[p], name[q])
        if name == before:
            break
    want = []
    for k in set(name):
        own = [b for b, n in zip(blobs, name, strict=True) if n == k]
        ids = {b[2] for b in own}
        want.append((min(ids), max(ids), len(ids), sum(b[7] for b in own), min(b[3] for b in own), min(b[4] for b in own), max(b[5] for b in own), max(b[6] for b in own)))
    got = QUERIES["detection_tracks"](spark, str(tmp_path)).collect()
    assert sorted((r.first, r.last, r.n_frames, r.n_pixels, r.top, r.left, r.bottom, r.right) for r in got) == sorted(want)
    assert max(r.n_frames for r in got) > 3
    places = evolution.numbered(spark.createDataFrame([(i, groups[i]) for i in groups], "image_id long, grp int"), "grp", 50).collect()
    order = {g: sorted(i for i in groups if groups[i] == g) for g in set(groups.values())}
    assert len(places) == 120 and all(order[r.grp][r.frame - 1] == r.image_id for r in places)
