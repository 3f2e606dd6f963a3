"""Cut images put together again without given places."""

import numpy as np
import pytest

from lumirel.operators import compose, mosaics
from lumirel.plans import analysis_queries

DENSE = "image_id long, grp int, width int, height int, data array<double>"


def scene(seed, h=110, w=150):
    rng = np.random.default_rng(seed)
    y, x = np.indices((h, w)).astype(float)
    out = rng.normal(size=(h, w)) * 5
    for a, b, c, d in rng.random((150, 4)):
        out += 1000 * c * np.exp(-((y - a * h) ** 2 + (x - b * w) ** 2) / (2 * (1.5 + 4 * d) ** 2))
    return out


def cut(image, grp, start, tops=(0, 28, 57), lefts=(0, 45, 88), h=50, w=60):
    places, rows = {}, []
    for i, t in enumerate(tops):
        for j, left in enumerate(lefts):
            k = start + 3 * i + j
            # A scan isn't a perfect grid.
            a, b = min(t + (j % 2), image.shape[0] - h), min(left + (i % 2) * 2, image.shape[1] - w)
            places[k] = (a, b)
            rows.append((k, grp, w, h, image[a : a + h, b : b + w].ravel().tolist()))
    return places, rows


@pytest.mark.parametrize("run", [8, 2])
def test_places_of_cut_images(spark, run):
    want, rows = {}, []
    for grp in (0, 1):
        own, more = cut(scene(grp), grp, 100 * grp)
        want[grp] = own
        rows += more
    rows += [(500, 0, 50, 60, None), (501, 1, 2, 2, [1.0] * 4), (502, 1, 60, 50, np.random.default_rng(9).normal(size=3000).tolist())]
    panels = spark.createDataFrame(rows, DENSE)
    got = mosaics.places(panels, run=run).collect()
    assert {(r.grp, r.image_id): (r.top, r.left) for r in got} == {(g, k): p for g, own in want.items() for k, p in own.items()}
    if run == 8:
        done = {}
        for r in mosaics.assembled(panels).collect():
            done.setdefault(r.grp, {})[r.y, r.x] = r.v
        for grp in (0, 1):
            image = scene(grp)
            assert len(done[grp]) > 0.9 * image.size
            assert max(abs(v - image[y, x]) for (y, x), v in done[grp].items()) < 1e-9


def test_overlaps_are_told_from_chance():
    image = scene(3)
    assert mosaics.overlap(image[:50, :60], image[20:70, 30:90])[:2] == (20, 30)
    assert mosaics.overlap(image[20:70, 30:90], image[:50, :60])[:2] == (-20, -30)
    noise = np.random.default_rng(1).normal(size=(2, 50, 60))
    found = mosaics.overlap(*noise)
    assert found is None or found[2] < mosaics.LEAST_CONFIDENCE


def test_mosaics_by_key(spark):
    rows = [(i, g, y, x, float(v)) for i, g, v in ((0, 0, 1), (1, 0, 2), (2, 1, 7)) for y in range(2) for x in range(2)]
    px = spark.createDataFrame(rows, "image_id long, grp int, y int, x int, v double")
    put = spark.createDataFrame([(0, 0, 0), (1, 0, 2), (2, 5, 5)], "image_id long, top int, left int")
    got = {(r.grp, r.y, r.x): r.v for r in compose.mosaic(px, put, "grp").collect()}
    assert got == {(0, y, x): 1.0 + (x > 1) for y in range(2) for x in range(4)} | {(1, y, x): 7.0 for y in (5, 6) for x in (5, 6)}


def test_query_runs_on_the_whole_table(spark, sf_dir):
    got = analysis_queries.mosaic_places(spark, sf_dir).toPandas()
    assert got.image_id.is_unique and (got.top >= 0).all() and (got.left >= 0).all()
