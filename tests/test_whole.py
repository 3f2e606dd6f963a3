"""Results over whole tables: every image, group and region takes part."""

import re

import numpy as np
import pytest

from lumirel.operators import frames, geometry, joins, lists
from lumirel.plans import frame_queries, list_queries, registry  # noqa: F401
from lumirel.sources.images import images


def arrays(spark, sf_dir):
    rows = images(spark, sf_dir).orderBy("image_id").collect()
    return [r.image_id for r in rows], [r.grp for r in rows], np.array([r.data for r in rows])


def nearest(ids, data, queries, k):
    """By brute force: (query, image, squared distance, place)."""
    out = []
    for q in queries:
        d2 = ((data - data[ids.index(q)]) ** 2).sum(axis=1)
        best = sorted((d, i) for d, i in zip(d2, ids, strict=True) if i != q)[:k]
        out += [(q, i, d, place) for place, (d, i) in enumerate(best, 1)]
    return sorted(out)


def test_nearest_images_of_every_hundredth(spark, sf_dir):
    ids, _, data = arrays(spark, sf_dir)
    got = registry.QUERIES["knn_all_images"](spark, sf_dir).select("q_id", "image_id", "d2", "place").collect()
    assert sorted(map(tuple, got)) == nearest(ids, data, [i for i in ids if i % 100 == 0], 3)


def test_nearest_images_in_blocks_with_ties(spark):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "image_id long, data array<double>")
    # Blocks of five images: most near images of a query lie in other blocks, and many are tied.
    got = joins.nearest_images(df.filter("image_id % 2 = 0"), df, 7, block_values=20).select("q_id", "image_id", "d2", "place").collect()
    assert sorted(map(tuple, got)) == nearest(list(range(60)), data, range(0, 60, 2), 7)


def test_nearest_images_are_not_more_than_there_are(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, None)], "image_id long, data array<double>")
    got = joins.nearest_images(df, df, 3).select("q_id", "image_id", "d2", "place").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 4.0, 1), (2, 1, 4.0, 1)]


def test_collages_place_all_images(spark):
    rows = [(g, i, 0, 0, float(i)) for g, i in [(0, 5), (0, 1), (0, 9000), (0, 30), (None, 7), (1, 2)]]
    px = spark.createDataFrame(rows, "grp int, image_id long, y int, x int, v double")
    got = geometry.collages(px, "X/X", 1, 1, 0, ids=10).select("grp", "sheet", "y", "x", "v").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(0, 0, 0, 0, 1.0), (0, 0, 1, 0, 5.0), (0, 1, 0, 0, 30.0), (0, 1, 1, 0, 9000.0), (None, 0, 0, 0, 7.0), (1, 0, 0, 0, 2.0)], key=str)


def correlated(ids, keys, data, least):
    """By brute force: the correlation of each pair of a key's images, where it is above a bound."""
    out = {}
    for a, (i, k) in enumerate(zip(ids, keys, strict=True)):
        for b, (j, o) in enumerate(zip(ids, keys, strict=True)):
            if i < j and k == o and np.ptp(data[a]) and np.ptp(data[b]) and (c := np.corrcoef(data[a], data[b])[0, 1]) > least:
                out[i, j] = c
    return out


def test_correlated_images_of_all_groups(spark, sf_dir):
    ids, keys, data = arrays(spark, sf_dir)
    want = correlated(ids, keys, data, 0.25)
    rows = registry.QUERIES["correlated_all_images"](spark, sf_dir).collect()
    got = {(r.image_id, r.other_id): r.c for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-4 for p in want)
    assert len({keys[ids.index(i)] for i, _ in got}) > 1


def test_correlated_images_of_a_large_group_in_blocks(spark):
    rng = np.random.default_rng(8)
    data = rng.random((90, 6)) * 1000
    data[4] = 7.1
    keys = [0] * 80 + [1] * 9 + [None]
    df = spark.createDataFrame([(i, k, x.tolist()) for i, (k, x) in enumerate(zip(keys, data, strict=True))], "image_id long, grp int, data array<double>")
    rows = joins.correlated(df, 0.3, block_values=60).collect()
    want = correlated(range(89), keys[:89], data[:89], 0.3)
    assert sorted((r.image_id, r.other_id) for r in rows) == sorted(want)
    assert all(abs(r.c - want[r.image_id, r.other_id]) < 1e-9 for r in rows)


def flood(mask):
    """Components by brute force, as sets of places, in the order of their first pixels."""
    left, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}, []
    while left:
        todo, own = [min(left)], set()
        while todo:
            y, x = todo.pop()
            if (y, x) in left:
                left.remove((y, x))
                own.add((y, x))
                todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        out.append(own)
    return out


def test_all_active_regions_of_an_image(spark):
    rng = np.random.default_rng(6)
    data = rng.random((6, 14, 17))
    rows = [(i, y, x, float(v)) for i, d in enumerate(data) for (y, x), v in np.ndenumerate(d)] + [(9, y, x, 5.0) for y in range(3) for x in range(3)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, v double")
    got = {}
    for r in frames.active_regions(px, 0.5).collect():
        got.setdefault(r.image_id, {})[r.region] = (r.top, r.left, r.bottom, r.right, r.n)
    assert set(got) == set(range(6))
    for i, d in enumerate(data):
        want = [(min(y for y, _ in c), min(x for _, x in c), max(y for y, _ in c), max(x for _, x in c), len(c)) for c in flood(d > d.mean() + 0.5 * d.std())]
        assert [got[i][k] for k in range(len(got[i]))] == want
        assert len(want) > 1


def test_each_region_is_cropped(spark):
    data = np.zeros((20, 30))
    data[2:6, 3:9], data[10:18, 20:28], data[15, 2] = 100, 90, 95
    px = spark.createDataFrame([(0, y, x, float(v)) for (y, x), v in np.ndenumerate(data)], "image_id long, y int, x int, v double")
    out = {}
    for r in frames.crop_active_regions(px, frames.active_regions(px, 1.0), 4, 0.5).collect():
        out.setdefault(r.region, {})[r.y, r.x] = r.v
    boxes = [data[1:7, 2:11], data[8:20, 18:30]]
    assert sorted(out) == [0, 1]
    for region, box in enumerate(boxes):
        assert out[region] == {(y, x): v for (y, x), v in np.ndenumerate(box)}
    whole = {}
    for r in frames.crop_active_regions(px, frames.active_regions(px, 1.0), 1, 0.0).collect():
        whole[r.region] = whole.get(r.region, 0) + 1
    assert whole == {0: 24, 1: 64, 2: 1}


@pytest.mark.parametrize("means", [range(40), [5] * 40, [1e9, *range(39)], [3, 3, 2, 2, 1] * 8, [7]])
def test_continuum_ranks_only_the_images_at_the_cut(spark, means):
    rows = [(i, 9.0, 0, 0, float(m)) for i, m in enumerate(means)]
    px = spark.createDataFrame(rows, "image_id long, pixel_shift double, y int, x int, v double")
    out = lists.continuum(px, saturated=2e9, keep=0.6)
    best = sorted(((-m, i) for i, m in enumerate(means)))[: int(0.6 * len(means))]
    assert [r.v for r in out.collect()] == ([float(np.median([-m for m, _ in best]))] if best else [])
    # No window over all images: those that order image_id are dealt by bucket.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "image_id" in plan
    assert all(w.startswith("_b#") for w in re.findall(r"windowspecdefinition\(([^()]*image_id#[^()]*)", plan))
