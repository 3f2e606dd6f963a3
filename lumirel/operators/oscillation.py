"""Periodic drift of scan lines: found in a series of displacements, told from noise, and taken out of images.

A series is (key, y, v, w): a displacement v of line y with a weight w, 0 or null where nothing was measured. Series are
independent; each is worked on whole by one task, so its length is bounded by an image's height, while any number of series are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import DENSE, _dense_batch, sample

# Windows and gates of the test of significance, which results follow from.
LEAST_SAMPLES = 64
#: Lines; shorter periods are taken for noise.
LEAST_PERIOD = 8.0
OVERSAMPLING = 8
LEAST_AMPLITUDE = 0.25
#: Part of the variance that a sinusoid has to explain.
LEAST_GAIN = 0.2
OUTLIER_SIGMA = 4.0
#: A second harmonic below this part of the first is left out.
LEAST_HARMONIC = 0.1
#: Lines of a window of the averaged periodogram, at most and at least.
WINDOW, LEAST_WINDOW = 512, 64
#: A peak's mean power is so much at least, and so many times the median.
PEAK_POWER, PEAK_RATIO = 0.025, 4.0
#: Smoothing of lines; with peaks, a part of the shortest period but not less than the second number.
SMOOTHING, LEAST_SMOOTHING, PERIOD_PARTS = 3.0, 2.0, 12.0
#: What is left of noise in a smoothed curve, by root mean square: at least, and against what smoothing leaves of white noise.
LEAST_RMS, NOISE_RATIO = 0.18, 2.0
#: Values of a design matrix that are held at once.
HELD = 1 << 21


def _fits(v: np.ndarray, w: np.ndarray, frequencies: np.ndarray, harmonics: int) -> tuple[np.ndarray, np.ndarray]:
    """(residual sums of squares, coefficients) of weighted fits of an offset, a trend and harmonics at each frequency.

    Coefficients are offset, trend, then sine and cosine of each harmonic; a fit without a solution has an infinite sum.
    """
    n, at = len(v), np.flatnonzero(w > 0)
    k = 2 + 2 * harmonics
    y, own, weight = at.astype(float), v[at], w[at]
    rss, coefficients = np.full(len(frequencies), np.inf), np.zeros((len(frequencies), k))
    step = max(1, HELD // max(1, k * len(at)))
    for a in range(0, len(frequencies), step):
        phase = 2 * np.pi * frequencies[a : a + step, None] * y
        basis = [np.ones_like(phase), np.broadcast_to((y - n / 2) / n, phase.shape)]
        for h in range(1, harmonics + 1):
            basis += [np.sin(h * phase), np.cos(h * phase)]
        x = np.stack(basis, axis=2)
        normal, right = np.einsum("fnk,n,fnl->fkl", x, weight, x, optimize=True), np.einsum("fnk,n->fk", x, weight * own)
        good = np.linalg.matrix_rank(normal, hermitian=True) == k
        solved = np.linalg.solve(np.where(good[:, None, None], normal, np.eye(k)), right[..., None])[..., 0]
        left = own - np.einsum("fnk,fk->fn", x, solved)
        rss[a : a + step] = np.where(good, (weight * left * left).sum(1), np.inf)
        coefficients[a : a + step] = solved
    return rss, coefficients


def _smooth(v: np.ndarray, w: np.ndarray, sigma: float) -> np.ndarray:
    """Weighted Gaussian means; gaps count for nothing, and where nothing is near it is 0."""
    half = int(min(np.ceil(4 * sigma), len(v)))
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    top, bottom = (np.convolve(x, kernel)[half : half + len(v)] for x in (w * v, w))
    return np.where(bottom > 1e-6, top / np.maximum(bottom, 1e-6), 0.0)


def _clipped(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights, 0 for samples that are far from a smoothed curve."""
    w = w.copy()
    for _ in range(2):
        off = v - _smooth(v, w, SMOOTHING)
        own = w > 0
        if not own.any():
            break
        middle = np.median(off[own])
        sigma = 1.4826 * np.median(np.abs(off[own] - middle))
        if sigma == 0:
            break
        w[own & (np.abs(off - middle) > OUTLIER_SIGMA * sigma)] = 0.0
    return w


def significant_periods(v: np.ndarray, w: np.ndarray, first: int, last: int) -> list[tuple[float, float]] | None:
    """(period, power) of the peaks of the periodogram's mean over half-overlapping windows; None if the series is too short for one."""
    window = min(WINDOW, (last - first + 1) // 2)
    if window < LEAST_WINDOW:
        return None
    frequencies = np.arange(2 / window, 1 / LEAST_PERIOD, 1 / (2 * window))
    power, windows = np.zeros(len(frequencies)), 0
    for a in range(first, last + 2 - window, window // 2):
        own, weight = v[a : a + window], w[a : a + window]
        if (weight > 0).sum() < window // 4:
            continue
        flat = _fits(own, weight, np.zeros(1), 0)[0][0]
        if not np.isfinite(flat) or flat <= 0:
            continue
        rss = _fits(own, weight, frequencies, 1)[0]
        power += np.where(np.isfinite(rss), 1 - rss / flat, 0.0)
        windows += 1
    if not windows:
        return None
    power /= windows
    least = max(PEAK_POWER, PEAK_RATIO * float(np.median(power)))
    inner = power[1:-1]
    peaks = np.flatnonzero((inner >= power[:-2]) & (inner >= power[2:]) & (inner >= least)) + 1
    return [(float(1 / frequencies[i]), float(power[i])) for i in peaks]


def _sine(v: np.ndarray, w: np.ndarray, span: int) -> tuple[float, float, float, np.ndarray] | None:
    """(rss, period, amplitude, shifts) of the best sinusoid with a second harmonic."""
    low, step = 2 / span, 1 / (OVERSAMPLING * span)
    frequencies = low + step * np.arange(int(np.floor((1 / LEAST_PERIOD - low) / step)) + 1)
    rss = _fits(v, w, frequencies, 1)[0]
    i = int(np.argmin(rss))
    if not np.isfinite(rss[i]):
        return None
    best = frequencies[i]
    if 0 < i < len(rss) - 1:
        bend = rss[i - 1] - 2 * rss[i] + rss[i + 1]
        part = 0.5 * (rss[i - 1] - rss[i + 1]) / bend if np.isfinite(bend) and bend > 0 else 0.0
        if abs(part) <= 1 and _fits(v, w, np.array([best + part * step]), 1)[0][0] <= rss[i]:
            best += part * step
    rss, coefficients = _fits(v, w, np.array([best]), 2)
    if not np.isfinite(rss[0]):
        return None
    a1, b1, a2, b2 = coefficients[0, 2:]
    if np.hypot(a2, b2) < LEAST_HARMONIC * np.hypot(a1, b1):
        a2 = b2 = 0.0
    phase = 2 * np.pi * best * np.arange(len(v))
    shifts = a1 * np.sin(phase) + b1 * np.cos(phase) + a2 * np.sin(2 * phase) + b2 * np.cos(2 * phase)
    return float(rss[0]), float(1 / best), float(np.hypot(a1, b1)), shifts


def _band(v: np.ndarray, w: np.ndarray, first: int, last: int, peaks: list[tuple[float, float]]) -> tuple[float, float, float, np.ndarray, float, float] | None:
    """(rss, period, amplitude, shifts, rms, noise) of the curve between a narrow and a wide smoothing, faded out at both ends."""
    span = last - first + 1
    if peaks:
        narrow = max(LEAST_SMOOTHING, min(p for p, _ in peaks) / PERIOD_PARTS)
        wide = min(max(2 * max(p for p, _ in peaks), 8 * narrow), span / 4)
        period = max(peaks, key=lambda p: p[1])[0]
    else:
        narrow, wide, period = SMOOTHING, max(8 * SMOOTHING, span / 6), span / 4
    base = _smooth(v, w, wide)
    shifts = np.zeros(len(v))
    inside = np.arange(first, last + 1)
    edge = np.minimum(inside - first, last - inside)
    taper = max(8, round(period))
    fade = np.where(edge < taper, 0.5 * (1 - np.cos(np.pi * edge / taper)), 1.0)
    shifts[inside] = (_smooth(v, w, narrow) - base)[inside] * fade
    total = w[inside].sum()
    if total <= 0:
        return None
    rss = float((w * (v - base - shifts) ** 2)[inside].sum())
    rms = float(np.sqrt((w * shifts * shifts)[inside].sum() / total))
    steps = np.diff(v)[(w[1:] > 0) & (w[:-1] > 0)]
    noise = float(np.sqrt(steps.var() / 2)) if len(steps) > 1 else 0.0
    return rss, period, float(np.sqrt(2) * rms), shifts, rms, noise / np.sqrt(2 * np.sqrt(np.pi) * narrow)


def find(v: np.ndarray, w: np.ndarray) -> tuple[str, bool, float, float, float, np.ndarray] | None:
    """(kind, significant, period, amplitude, gain, shifts) of the better model of a series, a sinusoid or a band; None without enough samples."""
    own = np.flatnonzero(w > 0)
    if len(own) < LEAST_SAMPLES:
        return None
    first, last = int(own[0]), int(own[-1])
    span = last - first + 1
    if 2 / span >= 1 / LEAST_PERIOD:
        return None
    w = _clipped(v, w)
    peaks = significant_periods(v, w, first, last)
    flat = _fits(v, w, np.zeros(1), 0)[0][0]
    if not np.isfinite(flat) or flat <= 1e-20 * (w * v * v).sum():
        return None
    sine, band = _sine(v, w, span), _band(v, w, first, last, peaks or [])
    if sine is None and band is None:
        return None
    if sine is not None and (band is None or sine[0] <= band[0]):
        rss, period, amplitude, shifts = sine
        gain = 1 - rss / flat
        return "sine", (peaks is None or bool(peaks)) and amplitude >= LEAST_AMPLITUDE and gain >= LEAST_GAIN, period, amplitude, gain, shifts
    rss, period, amplitude, shifts, rms, noise = band
    return "band", bool(peaks) and rms >= max(LEAST_RMS, NOISE_RATIO * noise), period, amplitude, 1 - rss / flat, shifts


def oscillations(series: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, kind, significant, period, amplitude, gain, first, shifts): the periodic part of each series(key, y, v, w).

    shifts holds the model from line first on, one value a line. A series with fewer than LEAST_SAMPLES lines, or on a straight line, has
    kind none and no shifts; one whose best model might be noise isn't significant. Null values and weights count as gaps, repeated lines by their mean.
    """
    own = series.select(key, F.col("y").cast("long").alias("y"), F.col("v").cast("double").alias("v"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    own = own.filter("y is not null").withColumn("w", F.when(F.col("v").isNull() | F.isnan("v") | ~(F.col("w") > 0), 0.0).otherwise(F.col("w"))).withColumn("v", F.when(F.col("w") > 0, F.col("v")).otherwise(0.0))
    lines = own.groupBy(key, "y").agg(F.avg(F.when(F.col("w") > 0, F.col("v"))).alias("v"), F.max("w").alias("w"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf.y.min())
        n = int(pdf.y.max()) - first + 1
        v, w = np.zeros(n), np.zeros(n)
        at = (pdf.y - first).to_numpy()
        w[at] = pdf.w.to_numpy()
        v[at] = np.nan_to_num(pdf.v.to_numpy(float))
        found = find(v, w / w.max() if w.max() > 0 else w)
        kind, significant, period, amplitude, gain, shifts = found or ("none", False, None, None, None, np.zeros(0))
        return pd.DataFrame([[pdf[key].iloc[0], kind, significant, period, amplitude, gain, first, shifts.tolist()]], columns=[key, "kind", "significant", "period", "amplitude", "gain", "first", "shifts"])

    kind = series.schema[key].dataType.simpleString()
    return lines.groupBy(key).applyInPandas(one, f"{key} {kind}, kind string, significant boolean, period double, amplitude double, gain double, first long, shifts array<double>")


def limb_shifts(edges: DataFrame, ellipses: DataFrame, width: int) -> DataFrame:
    """(image_id, y, v, w): how far both limbs of each line, edges(image_id, y, left, right), are moved together against the fitted ellipse.

    ellipses has image_id, cy, cx, ry, rx, angle, as ellipse_fit gives them. Weights are chord lengths. Lines whose
    chord leaves the image, that have one limb only, or a limb further off than a hundredth of the axes' sum times two, are left out.
    """
    c, s = F.cos("angle"), F.sin("angle")
    dy = F.col("y") - F.col("cy")
    # (dx c + dy s)^2 / rx^2 + (dy c - dx s)^2 / ry^2 = 1, solved for dx.
    qa = c * c / (F.col("rx") * F.col("rx")) + s * s / (F.col("ry") * F.col("ry"))
    qb = 2 * dy * c * s * (1 / (F.col("rx") * F.col("rx")) - 1 / (F.col("ry") * F.col("ry")))
    qc = dy * dy * (s * s / (F.col("rx") * F.col("rx")) + c * c / (F.col("ry") * F.col("ry"))) - 1
    own = edges.join(ellipses.select("image_id", "cy", "cx", "ry", "rx", "angle"), "image_id").withColumn("_q", qb * qb - 4 * qa * qc).filter("_q >= 0")
    own = own.withColumn("_l", F.col("cx") + (-qb - F.sqrt("_q")) / (2 * qa)).withColumn("_r", F.col("cx") + (-qb + F.sqrt("_q")) / (2 * qa))
    limit = F.lit(2) * (F.col("rx") + F.col("ry")) / 100
    own = own.filter((F.col("_l") >= 0) & (F.col("_r") < width) & (F.abs(F.col("left") - F.col("_l")) <= limit) & (F.abs(F.col("right") - F.col("_r")) <= limit))
    return own.select("image_id", "y", ((F.col("left") - F.col("_l") + F.col("right") - F.col("_r")) / 2).alias("v"), (F.col("_r") - F.col("_l")).alias("w"))


def steadied(images: DataFrame, found: DataFrame) -> DataFrame:
    """Dense images whose lines are moved back by the significant oscillation found in them (see oscillations), between pixels; others stay."""
    models = found.filter("significant").select("image_id", "first", "shifts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in ("width", "height", "data", "first", "shifts")}
                if not row["data"].is_valid:
                    continue
                w, h = row["width"].as_py(), row["height"].as_py()
                image = row["data"].values.to_numpy(zero_copy_only=False).reshape(h, w)
                if row["shifts"].is_valid:
                    first, model = row["first"].as_py(), row["shifts"].values.to_numpy(zero_copy_only=False)
                    shifts = np.zeros(h)
                    lines = np.arange(max(first, 0), min(first + len(model), h))
                    shifts[lines] = model[lines - first]
                    y, x = np.indices(image.shape).astype(float)
                    moved = sample(image, y, x + shifts[:, None], "lanczos")
                    image = np.where(np.abs(shifts[:, None]) < 1e-3, image, moved)
                yield _dense_batch(batch.column("image_id").slice(i, 1), image[None])

    return images.select("image_id", "width", "height", "data").join(models, "image_id", "left").mapInArrow(run, DENSE)
