"""Lines on frames, drift, atlas search and positions of images: planted cases, and plain enumeration."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumirel.operators import atlas, consensus, kernels, lines, oscillation
from lumirel.plans import analysis_queries, registry


def frame(spark, *data):
    rows = [(i, y, x, float(v)) for i, image in enumerate(data) for y, row in enumerate(image) for x, v in enumerate(row)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "y", "x", "v"])).selectExpr("image_id", "cast(y as int) y", "cast(x as int) x", "v")


def spectrum(a, b, c, seed=0, faint=12, height=60, width=90):
    """A frame with a deep line at a x^2 + b x + c and a fainter one below it, dark beside its lit columns."""
    y, x = np.indices((height, width)).astype(float)
    mid = a * x * x + b * x + c
    out = 1000 - 600 * np.exp(-(((y - mid) / 2) ** 2)) - 350 * np.exp(-(((y - mid - faint) / 1.5) ** 2)) + np.random.default_rng(seed).normal(size=y.shape)
    out[:, :7] *= 0.02
    out[:, 80:] *= 0.02
    return out


def test_borders_lie_between_columns(spark):
    image = np.zeros((4, 8))
    image[:, 2], image[:, 3:6], image[:, 6] = 30, 100, 50
    flat = np.ones((4, 8))
    dark = np.zeros((4, 8))
    got = {r.image_id: r for r in lines.borders(frame(spark, image, flat, dark), threshold=40).collect()}
    assert (got[0].left, got[0].right) == (3, 6)
    assert got[0].sub_left == pytest.approx(2 + 10 / 70) and got[0].sub_right == pytest.approx(6 + 10 / 50)
    assert got[1].left is None and got[2].right is None
    auto = {r.image_id: r for r in lines.borders(frame(spark, image, flat)).collect()}
    assert (auto[0].left, auto[0].right, auto[1].left) == (2, 6, None)
    whole = lines.borders(frame(spark, image + 100), threshold=1).first()
    assert (whole.sub_left, whole.sub_right) == (0, 7)


def test_parabolas_of_frames(spark):
    planted = [(0.002, -0.2, 30), (-0.001, 0.15, 20), (0.0, 0.05, 25)]
    got = lines.analyzed(frame(spark, *(spectrum(*p, seed=i) for i, p in enumerate(planted)))).collect()
    x = np.arange(7, 80)
    for r in got:
        a, b, c = planted[r.image_id]
        assert (r.left, r.right) == (7, 79) and r.n > 65
        assert np.abs(np.polynomial.polynomial.polyval(x, r.coefficients) - (a * x * x + b * x + c)).max() < 0.3


def test_realigned_on_the_fainter_line(spark):
    frames = frame(spark, spectrum(0.001, -0.1, 20), spectrum(0.0, 0.1, 24, 1))
    fits = lines.analyzed(frames)
    # The profile around the fainter line, in rows from it.
    y = np.arange(-20, 21)
    wanted = 1000 - 350 * np.exp(-((y / 1.5) ** 2)) - 600 * np.exp(-(((y + 12) / 2) ** 2))
    reference = spark.createDataFrame([(int(a), float(v)) for a, v in zip(y, wanted, strict=True)], "y int, v double")
    got = {r.image_id: r for r in lines.realigned(frames, fits, reference, 8, 14).collect()}
    x = np.arange(7, 80)
    for i, (a, b, c) in enumerate([(0.001, -0.1, 32), (0.0, 0.1, 36)]):
        assert got[i].realigned and np.abs(np.polynomial.polynomial.polyval(x, got[i].coefficients) - (a * x * x + b * x + c)).max() < 0.4
    own = {r.image_id: r for r in lines.realigned(frames, fits, lines.straightened(frames, fits, 20).groupBy("y").agg(F.avg("v").alias("v")), 8, 5).collect()}
    assert not own[0].realigned and own[0].coefficients == {r.image_id: r for r in fits.collect()}[0].coefficients


@pytest.mark.parametrize(("spread", "some"), [("median", 4), ("moments", 1)])
def test_robust_fit_without_outliers(spark, spread, some):
    rng = np.random.default_rng(4)
    rows, clean = [], {}
    for k in range(4):
        x = np.arange(60.0)
        y = 3 + 0.5 * x - 0.01 * k * x * x + 0.05 * rng.normal(size=60)
        bad = rng.choice(60, some * k, replace=False)
        clean[k] = np.polynomial.polynomial.polyfit(np.delete(x, bad), np.delete(y, bad), 2)
        y[bad] += rng.choice([-1, 1], len(bad)) * (20 + 5 * rng.random(len(bad)))
        rows += [(k, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    rows += [(7, 1.0, 2.0), (7, 1.0, 3.0), (8, None, 1.0)]
    got = {r.image_id: r for r in lines.robust_fit(spark.createDataFrame(rows, "image_id long, x double, y double"), rounds=8, spread=spread).collect()}
    for k in range(4):
        x = np.arange(60)
        off = np.polynomial.polynomial.polyval(x, got[k].coefficients) - np.polynomial.polynomial.polyval(x, clean[k])
        assert np.abs(off).max() < 0.1 and got[k].n_rejected >= some * k and got[k].n + got[k].n_rejected == 60
    assert got[7].coefficients is None and got[8].n == 0


def series(spark, **named):
    rows = [(k, i, float(v), float(w)) for k, (vs, ws) in named.items() for i, (v, w) in enumerate(zip(vs, ws, strict=True))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["k", "y", "v", "w"]))


def test_planted_oscillations_and_noise(spark):
    rng = np.random.default_rng(42)
    y = np.arange(1500)
    sine = 2.3 * np.sin(2 * np.pi * y / 87 + 0.7)
    gap = np.where((y >= 600) & (y < 700), 0.0, 1.0)
    z = np.arange(3000)
    drift = 2 * np.sin(np.cumsum(2 * np.pi / (28 + 8 * np.sin(2 * np.pi * z / 1500))))
    spikes = 1.5 * np.sin(2 * np.pi * y / 120) + 0.3 * rng.normal(size=1500)
    spikes[100::100] += 15
    data = series(
        spark,
        sine=(sine + 0.001 * y - 0.5 + 0.5 * rng.normal(size=1500), gap),
        noise=(0.8 * rng.normal(size=1500), y * 0 + 1),
        small=(0.1 * np.sin(2 * np.pi * y / 90) + 0.05 * rng.normal(size=1500), y * 0 + 1),
        drift=(drift + 0.4 * rng.normal(size=3000), z * 0 + 1),
        spikes=(spikes, y * 0 + 1),
        short=(sine[:32], y[:32] * 0 + 1),
        flat=(y * 0 + 5.0, y * 0 + 1),
        unknown=(y[:80] * 0, y[:80] * 0),
    )
    got = {r.k: r for r in oscillation.oscillations(data, "k").collect()}
    assert {k for k, r in got.items() if r.significant} == {"sine", "drift", "spikes"}
    assert abs(got["sine"].period - 87) < 0.5 and abs(got["sine"].amplitude - 2.3) < 0.1 and got["sine"].kind == "sine"
    assert np.sqrt(np.mean((np.array(got["sine"].shifts) - sine) ** 2)) < 0.1
    assert got["drift"].kind == "band" and np.sqrt(np.mean((np.array(got["drift"].shifts) - drift) ** 2)) < 0.5
    assert abs(got["spikes"].period - 120) < 1 and abs(got["spikes"].amplitude - 1.5) < 0.1
    assert got["short"].kind == got["flat"].kind == got["unknown"].kind == "none" and got["short"].shifts == []


def test_steadied_disk(spark):
    """A disk whose lines are moved to and fro is round again."""
    h, w, r = 400, 300, 110
    y, x = np.indices((h, w)).astype(float)
    half = np.sqrt(np.maximum(0, 1 - ((y[:, 0] - 200) / 180) ** 2)) * r
    shift = 3 * np.sin(2 * np.pi * np.arange(h) / 45)
    soft = lambda d: 30000 / (1 + np.exp(np.clip(-d / 1.5, -50, 50)))
    image = soft(x - (150 - half[:, None] + shift[:, None])) * soft(150 + half[:, None] + shift[:, None] - x) / 30000
    edges = [(0, int(i), float(150 - half[i] + shift[i]), float(150 + half[i] + shift[i])) for i in range(h) if half[i] > 20]
    edges += [(0, 200, None, 5.0)]
    ellipse = spark.createDataFrame([(0, 150.0, 200.0, 180.0, 110.0, float(np.pi / 2))], "image_id long, cx double, cy double, rx double, ry double, angle double")
    limb = oscillation.limb_shifts(spark.createDataFrame(edges, "image_id long, y long, left double, right double"), ellipse, w)
    found = oscillation.oscillations(limb)
    images = spark.createDataFrame([(0, w, h, image.ravel().tolist()), (1, w, h, image.ravel().tolist()), (2, w, h, None)], "image_id long, width int, height int, data array<double>")
    got = {r.image_id: np.array(r.data).reshape(h, w) for r in oscillation.steadied(images, found).collect()}
    assert set(got) == {0, 1} and np.array_equal(got[1], image)
    rows = slice(80, 320)
    edge = lambda a: (a[rows] > 15000).argmax(1)
    assert np.abs(edge(image) - (150 - half[rows])).max() > 2.5 and np.abs(edge(got[0]) - (150 - half[rows])).max() < 1.5


@pytest.mark.parametrize(("block", "pack"), [(1 << 16, 256), (128, 2)])
def test_atlas_search_by_force(spark, block, pack):
    rng = np.random.default_rng(0)
    n, gaps = 700, {300, 301, 650}
    a = np.cumsum(rng.normal(size=n))
    places = [i for i in range(n) if i not in gaps]
    reference = spark.createDataFrame(pd.DataFrame({"pos": [i + 100 for i in places], "v": a[places]}))
    planted, rows = {}, []
    for k in range(5):
        m, s, o = [12, 20][k % 2], 1 + (k % 3 == 0), int(rng.integers(0, n - 60))
        planted[k] = (a[o : o + m * s : s] * 3 + 5 + 0.05 * rng.normal(size=m), o, s)
        rows += [(k, y + 3, float(v)) for y, v in enumerate(planted[k][0])]
    rows += [(90, y, 1.0) for y in range(5)] + [(91, y, float(y * y)) for y in (0, 2, 3, 4)] + [(92, 0, None), (93, 0, 1.0)]
    profiles = spark.createDataFrame(rows, "image_id long, y int, v double")
    own = a.copy()
    own[list(gaps)] = np.nan

    def force(p, s):
        score = np.full(n, -2.0)
        for o in range(n - (len(p) - 1) * s):
            part = own[o : o + (len(p) - 1) * s + 1 : s]
            if np.isfinite(part).all():
                score[o] = np.corrcoef(p, part)[0, 1]
        return {o: score[o] for o in range(n) if score[o] > -2 and score[max(0, o - 7) : o].max(initial=-3) < score[o] >= score[o + 1 : o + 8].max(initial=-3)}

    found = atlas.search(profiles, reference, 3, 8, (0.0,), (1, 2), block=block, pack=pack)
    got = found.toPandas().sort_values(["image_id", "rank"])
    assert set(got.image_id) == set(planted)
    for k, (p, _, _) in planted.items():
        best = {}
        for s in (1, 2):
            for o, v in force(p, s).items():
                best[o] = max(best.get(o, (-9, 0)), (v, -s))
        want = sorted((-v, o + 100, -s) for o, (v, s) in best.items())[:3]
        mine = [(-r.score, r.pos, r.stride) for r in got[got.image_id == k].itertuples()]
        assert np.allclose(np.array(want), np.array(mine))
    named = {r.image_id: (r.pos, r.stride) for r in atlas.identified(found).collect()}
    assert named == {k: (o + 100, s) for k, (_, o, s) in planted.items()}
    assert atlas.search(profiles.limit(0), reference).count() == 0 and atlas.search(profiles, reference.limit(0)).count() == 0


def test_broadened_atlas_is_found(spark):
    rng = np.random.default_rng(2)
    a = rng.random(400)
    wide = atlas.broadened(a, 2.0)
    reference = spark.createDataFrame(pd.DataFrame({"pos": range(400), "v": a}))
    profiles = spark.createDataFrame(pd.DataFrame({"image_id": 1, "y": range(40), "v": wide[210:250]}))
    best = atlas.search(profiles, reference, 2, 8, (0.0, 1.0, 2.0)).filter("rank = 1").first()
    assert (best.pos, best.sigma) == (210, 2.0) and best.score > 0.9999
    noise = spark.createDataFrame(pd.DataFrame({"image_id": 1, "y": range(40), "v": rng.random(40)}))
    assert atlas.identified(atlas.search(noise, reference)).count() == 0


def blobs(dy, dx, size=40):
    y, x = np.indices((size, size)).astype(float)
    out = np.zeros((size, size))
    for a, b, c, d in np.random.default_rng(9).random((50, 4)):
        out += 1000 * (0.3 + c) * np.exp(-((y - a * 52 + 6 - dy) ** 2 + (x - b * 52 + 6 - dx) ** 2) / (2 * (1.2 + 2 * d) ** 2))
    return out


def stack(spark, shifts, key=lambda i: i >= 11):
    rows = [(i, int(key(i)), 40, 40, blobs(*s).ravel().tolist()) for i, s in enumerate(shifts)]
    rows += [(90, 1, 40, 40, None), (91, 1, 40, 40, [1.0] * 1600), (92, 0, 2, 2, [1.0, 2.0, 3.0, 4.0])]
    return spark.createDataFrame(rows, "image_id long, grp int, width int, height int, data array<double>")


@pytest.mark.parametrize(("run", "segment"), [(8, 512), (3, 5)])
def test_planted_positions(spark, run, segment):
    shifts = np.random.default_rng(1).normal(size=(17, 2)) * 1.5
    images = stack(spark, shifts)
    got = consensus.positions(images, run=run, segment=segment).toPandas()
    assert set(got.image_id) == set(range(17))
    for _, own in got.groupby("grp"):
        want = shifts[own.image_id]
        assert np.abs(own[["dy", "dx"]].to_numpy() - (want - want.mean(0))).max() < 0.45
    ids = consensus.numbered(images.select("grp", "image_id"), "grp", ["image_id"])
    own = images.drop("grp").join(ids, "image_id")
    assert consensus.links(own, run=run).count() == (3 * 11 - 6) + (3 * 6 - 6)


@pytest.mark.parametrize("segment", [512, 7])
def test_links_that_agree_are_met_exactly_and_outliers_count_less(spark, segment):
    p = np.random.default_rng(3).normal(size=(40, 2))
    rows = [(k, a, b, *map(float, p[b] - p[a]), 1.0) for k in (0, None) for a in range(40) for b in range(a + 1, min(40, a + 4))]
    kind = "grp int, a long, b long, dy double, dx double, w double"
    got = consensus.synchronised(spark.createDataFrame(rows, kind), segment=segment).toPandas()
    for _, own in got.groupby("grp", dropna=False):
        assert len(own) == 40 and np.allclose(own.sort_values("r")[["dy", "dx"]], p - p.mean(0))
    rows = [r for r in rows if r[0] == 0]
    rows[20] = (*rows[20][:3], 30.0, -30.0, 1.0)
    off = [np.abs(consensus.synchronised(spark.createDataFrame(rows, kind), rounds=n, segment=segment).toPandas().sort_values("r")[["dy", "dx"]].to_numpy() - (p - p.mean(0))).max() for n in (1, 4)]
    assert off[1] < 0.1 < off[0] or off[1] < 0.05 * off[0]


def test_numbers_of_rows_by_key(spark):
    rows = [(k, i) for k in (0, 1, None) for i in range(50 if k == 0 else 7)]
    got = consensus.numbered(spark.createDataFrame(rows, "grp int, i int").repartition(5), "grp", ["i"]).collect()
    assert {(r.grp, r.i): r.r for r in got} == {(k, i): i for k, i in rows}


def test_references_by_mode(spark):
    images = stack(spark, [(0, 0), (0.5, 0), (-0.5, 0), (0, 0)], key=lambda i: 0).filter("image_id < 90")
    arrays = np.array([np.array(r.data) for r in images.orderBy("image_id").collect()])
    manual = spark.createDataFrame([(2,), (3,)], "image_id long")
    sharp = [float(np.abs(a).sum()) for a in arrays]
    assert len(sharp) == 4

    def made(mode, **more):
        r = consensus.reference_images(images, mode, **more).first()
        return np.array(r.data)

    assert np.array_equal(made("first"), arrays[0]) and np.allclose(made("average"), arrays.mean(0)) and np.allclose(made("median"), np.median(arrays, axis=0))
    assert np.array_equal(made("manual", manual=manual), arrays[2])
    assert any(np.array_equal(made("sharpness"), a) for a in arrays) and any(np.array_equal(made("eccentricity"), a) for a in arrays)
    # Away from the edges the consensus is the scene, sharper than the plain mean of moved images.
    inner = np.s_[6:-6, 6:-6]
    off = [np.abs(made(m).reshape(40, 40)[inner] - blobs(0, 0)[inner]).mean() for m in ("consensus", "average")]
    assert off[0] < 1.5 * off[1] + 5
    with pytest.raises(ValueError):
        consensus.references(images, "best")


@pytest.mark.parametrize("name", ["frame_analysis", "frame_realignment", "oscillations", "consensus_positions", "consensus_reference"])
def test_queries_without_sql_run_on_their_tables(spark, sf_dir, name):
    assert hasattr(analysis_queries, name)
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) == {"frame_analysis": 500, "frame_realignment": 500, "oscillations": 5, "consensus_positions": 500, "consensus_reference": 640}[name]


def test_spectra_give_the_shift_of_images():
    a, b = blobs(1.5, -2.0), blobs(0, 0)
    assert kernels.phase_shift(a, b) == kernels.spectral_shift(kernels.spectrum(a), kernels.spectrum(b))
    dy, dx, _ = kernels.phase_shift(a, b)
    assert abs(dy - 1.5) < 0.5 and abs(dx + 2) < 0.5
