"""Automatic contrast against its steps written out, pixel by pixel."""

import math

import numpy as np
import pytest

from lumirel.operators import compose, kernels

M = 65535.0


def neutralized(d, cx, cy, r, bg):
    h, w = d.shape
    step, level, pedestal, found = max(1, max(w, h) // 32), math.inf, -1, False
    terms = lambda y, x: [1, x / (w - 1), y / (h - 1), (x / (w - 1)) ** 2, x / (w - 1) * y / (h - 1), (y / (h - 1)) ** 2]
    for _ in range(25):
        at = [(y, x) for y in range(0, h, step) for x in range(0, w, step) if math.hypot(x - cx, y - cy) > 1.05 * r]
        v = np.array([d[p] for p in at])
        m, s = (v.mean(), math.sqrt(((v - v.mean()) ** 2).sum() / (len(v) - 1))) if len(v) > 1 else (0, -1)
        kept = [(terms(*p), d[p]) for p in at if d[p] > 0 and m - 1.5 * s < d[p] < m + 1.5 * s]
        if len(kept) < 6:
            break
        a, b = np.array([k[0] for k in kept]), np.array([k[1] for k in kept])
        c = np.linalg.solve(a.T @ a + 1e-6 * np.eye(6), a.T @ b)
        model = np.array([[min(max(float(np.dot(c, terms(y, x))), 0), M) for x in range(w)] for y in range(h)])
        now = model.mean()
        if now == 0 or now > level:
            break
        level, d = now, np.clip(d - (1 - bg) * model, 0, M)
        if pedestal == -1 or (not found and now < 0.5 * pedestal):
            pedestal = now
        else:
            found = True
    return d + max(pedestal, 0) / 2


def equalized(d, tile, clip):
    h, w = d.shape
    b = [[min(max(math.floor(v * (M / d.max() if d.max() else 0) * 63 / M + 0.5), 0), 63) for v in row] for row in d]
    cdf = {}
    for ty in range(math.ceil(h / tile)):
        for tx in range(math.ceil(w / tile)):
            own = [b[y][x] for y in range(ty * tile, min(h, ty * tile + tile)) for x in range(tx * tile, min(w, tx * tile + tile))]
            n = [own.count(i) for i in range(64)]
            limit = int(clip * len(own) / 64)
            over = sum(max(0, k - limit) for k in n)
            n = [min(k, limit) + over // 64 + (i < over % 64) for i, k in enumerate(n)]
            cdf[ty, tx] = np.cumsum(n) / sum(n)

    def ends(p, size):
        t, half = p // tile, tile // 2
        if p <= half or p >= size - 1 - half:
            return [(t, 1.0)]
        low = t - 1 if p <= t * tile + tile / 2 else t
        share = (p - (low * tile + tile / 2)) / tile
        return [(low, 1 - share), (low + 1, share)]

    return np.array([[M * sum(p * q * cdf[ty, tx][b[y][x]] for ty, p in ends(y, h) for tx, q in ends(x, w)) for x in range(w)] for y in range(h)])


def lifted(d, cx, cy, r):
    h, w = d.shape
    bins = sorted(min(max(math.floor(v * 65536 / M + 0.5), 0), 65535) for v in d.ravel())
    k = int(d.size * 0.05)
    floor = max(bins[k - 1] if k else 0, 0.005 * M)
    box = [(y, x) for y in range(h) for x in range(w) if int(max(0, cx - r)) <= x <= int(min(w - 1, cx + r)) and int(max(0, cy - r)) <= y <= int(min(h - 1, cy + r))]
    seen = sorted(int(d[p]) for p in box if math.hypot(p[1] - cx, p[0] - cy) <= r and d[p] > floor)
    middle, target = (seen[len(seen) // 2 - 1] if len(seen) > 1 else 0), 0.45 * M
    if not floor < middle < target:
        return d
    a, b = 0.01, 1e4
    while b - a >= 1e-8:
        m = (a + b) / 2
        a, b = (a, m) if math.asinh(m * (middle - floor) / (M - floor)) > (target - floor) / (M - floor) * math.asinh(m) else (m, b)
    out, beta, c = d.copy(), (a + b) / 2, 0.25 / (target * (target - M))
    for y in range(h):
        for x in range(w):
            if d[y, x] > floor:
                u = floor + (M - floor) * math.asinh(beta * (d[y, x] - floor) / (M - floor)) / math.asinh(beta)
                s = min(max((((x - cx) ** 2 + (y - cy) ** 2) / r**2 - 0.85) / 0.2, 0), 1)
                out[y, x] = min(max(u + (1 - s * s * (3 - 2 * s)) * (c * u**3 - c * (M + target) * u**2 + (1 + c * target * M) * u - u), 0), M)
    return out


def plain(d, cx, cy, r, gamma, bg, prominences):
    sky = neutralized(d, cx, cy, r, bg) if bg < 1 else d
    around, s = sky.copy(), 1.005 * r
    for y in range(int(max(0, cy - s)), int(min(d.shape[0] - 1, cy + s))):
        for x in range(int(max(0, cx - s)), int(min(d.shape[1] - 1, cx + s))):
            around[y, x] = 0 if math.hypot(x - cx, y - cy) <= s else around[y, x]
    a, b = np.linalg.solve([[16**2, 16], [M**2, M]], [int(min(max(16 * (1 + prominences), 16), 255)), M])
    around = equalized(around, 8, 0.8)
    local = 0.6 * equalized(sky, 16, 1.1) + 0.4 * (a * around**2 + b * around)
    return np.clip(lifted(0.8 * M * (sky / max(sky.max(), 1e-7)) ** gamma + 0.2 * local, cx, cy, r), 0, M)


@pytest.mark.parametrize("given", [{}, {"bg": 0.8, "prominences": 2.0, "gamma": 1.2}, {"bg": 1.0}])
def test_every_step_of_automatic_contrast(spark, given):
    """Pedestal, prominences' own contrast, the second blend and the lift of the disk were missing, and the background was subtracted whole, however its level went."""
    rng = np.random.default_rng(1)
    want, rows = {}, []
    for i, (h, w, r, disk, sky) in enumerate([(36, 44, 12.0, 9000, 2500), (8, 8, 2.5, 20000, 12000), (8, 8, 2.5, 100, 32000), (70, 50, 15.0, 40000, 500), (8, 8, 2.5, 0, 0)]):
        cx, cy = w / 2 - 0.5, h / 2 - 1.25
        y, x = np.indices((h, w))
        image = np.clip(sky * (1 + 0.01 * x) + disk * (np.hypot(x - cx, y - cy) <= r) + (disk + sky) / 8 * rng.normal(size=(h, w)), 0, M)
        rows.append((i, w, h, image.ravel().tolist(), cx, cy, r))
        want[i] = plain(image, cx, cy, r, given.get("gamma", 1.5), given.get("bg", 0.5), given.get("prominences", 0.0))
    rows.append((9, 2, 1, [1.0, None], 0.0, 0.0, 1.0))
    rows.append((10, 2, 2, [1.0, 2.0, 4e4, 7e4], None, None, None))
    df = spark.createDataFrame(rows, f"{kernels.DENSE}, cx double, cy double, radius double")
    got = {}
    for p in compose.auto_contrast(df, 0, 0, **given).collect():
        got.setdefault(p.image_id, {})[p.y, p.x] = p.v
    for i, image in want.items():
        own = np.array([[got[i][y, x] for x in range(image.shape[1])] for y in range(image.shape[0])])
        assert np.allclose(own, image, rtol=1e-6, atol=0.01), i
    assert all(math.isnan(v) for v in got[9].values()) and got[10][1, 1] == M


def test_contrast_refuses_what_makes_no_sense(spark):
    df = spark.createDataFrame([], f"{kernels.DENSE}, cx double, cy double, radius double")
    for given in ({"gamma": 0.5}, {"bg": 0.0}, {"bg": 1.5}, {"prominences": -1.0}):
        with pytest.raises(ValueError):
            compose.auto_contrast(df, 8, 8, **given)
    assert compose.auto_contrast(df, 8, 8).count() == 0
