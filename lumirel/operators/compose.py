"""Operators composed of others, and kernels on profiles: contrast, overlays, Bayer planes, mosaics, line fits."""

from __future__ import annotations

from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixel import PEAK
from ..sources.images import to_pixels
from . import contrast, kernels, lists, stencil, stretch
from .geometry import _moved


def chain(pixels: DataFrame, *steps) -> DataFrame:
    """Stretches one after the other."""
    return fold(lambda p, step: step(p), steps, pixels)


def cutoff(pixels: DataFrame, low: float, high: float, low_fill: float = 0.0, high_fill: float = PEAK) -> DataFrame:
    """Values at and below low, or at and above high, become the fills."""
    return pixels.withColumn("v", F.when(F.col("v") <= low, F.lit(float(low_fill))).when(F.col("v") >= high, F.lit(float(high_fill))).otherwise(F.col("v")))


def auto_contrast(images: DataFrame, width: int, height: int, gamma: float = 1.5, iterations: int = 25, bg: float = 0.5, prominences: float = 0.0) -> DataFrame:
    """Images whose sky is taken away, with local contrast on and around the disk, and whose disk is bright enough.

    A surface of the sky is subtracted again and again while its level falls, bg being the part that stays (1: none is subtracted), and half of the
    level comes back. Then 0.8 of the image by gamma and 0.2 of local contrasts: 0.6 of the whole image's, 0.4 of what is around the disk, which
    prominences stretch. Last the disk's median is lifted to 0.45 of the peak (see contrast.lifted) and values are limited.

    images are dense, of any size, with the columns of a disk; those without a disk are only lifted, and those with an unknown pixel become unknown.
    """
    if gamma < 1 or not 0 < bg <= 1 or prominences < 0:
        raise ValueError("gamma must be 1 or more, bg above 0 and at most 1, prominences 0 or more")

    def kernel(stack: np.ndarray, cx: float | None, cy: float | None, radius: float | None) -> np.ndarray:
        disk = None if None in (cx, cy, radius) or not radius > 0 else (cx, cy, radius)
        known = np.isfinite(stack).all(axis=(1, 2))
        out = np.full(stack.shape, np.nan)
        if stack.size and known.any():
            out[known] = contrast.auto_contrast(stack[known], disk, gamma, bg, prominences, iterations)
        return out

    return to_pixels(kernels.per_stack(images, kernel, kernels.DISK))


def coronagraph(pixels: DataFrame, inside: Column) -> DataFrame:
    """The disk filled with 0 and what is around it stretched."""
    return stretch.linear_stretch(pixels.withColumn("v", F.when(inside, F.lit(0.0)).otherwise(F.col("v"))))


def overlay_regions(pixels: DataFrame, boxes: DataFrame, value: float = PEAK) -> DataFrame:
    """Images with the outlines of their boxes; images without boxes stay as they are."""
    y, x = F.col("y"), F.col("x")
    inside = y.between(F.col("top"), F.col("bottom")) & x.between(F.col("left"), F.col("right"))
    border = inside & ((y == F.col("top")) | (y == F.col("bottom")) | (x == F.col("left")) | (x == F.col("right")))
    drawn = pixels.join(boxes.select("image_id", "top", "left", "bottom", "right"), "image_id", "left").groupBy("image_id", "y", "x", "v")
    return drawn.agg(F.coalesce(F.bool_or(border), F.lit(False)).alias("_b")).select("image_id", "y", "x", F.when(F.col("_b"), F.lit(float(value))).otherwise(F.col("v")).alias("v"))


def demosaic(pixels: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """(image_id, y, x, r, g, b) of a Bayer image: each plane is the mean of its known pixels in the 3 by 3 box, weighted by nearness."""
    at = {"R": [], "G": [], "B": []}
    for i, c in enumerate(pattern):
        at[c].append((i // 2, i % 2))
    out = pixels
    for c, places in at.items():
        known = fold(lambda a, b: a | b, [(F.col("y") % 2 == p) & (F.col("x") % 2 == q) for p, q in places])
        masked = pixels.select("image_id", "y", "x", F.when(known, F.col("v")).otherwise(0.0).alias("v"))
        ones = pixels.select("image_id", "y", "x", F.when(known, 1.0).otherwise(0.0).alias("v"))
        total, weight = (_tent(p) for p in (masked, ones))
        plane = total.join(weight.withColumnRenamed("s", "_w"), ["image_id", "y", "x"])
        plane = plane.select("image_id", "y", "x", (F.col("s") / F.col("_w")).alias("_p"))
        # A known pixel keeps its value.
        out = out.join(plane, ["image_id", "y", "x"]).withColumn(c.lower(), F.when(known, F.col("v")).otherwise(F.col("_p"))).drop("_p")
    return out.select("image_id", "y", "x", "r", "g", "b")


def _tent(pixels: DataFrame) -> DataFrame:
    """Sums of the 3 by 3 box weighted 1 2 1 both ways; nothing counts beyond the edges."""
    from pyspark.sql import Window

    def along(name: str, w) -> Column:
        return F.coalesce(F.lag(name).over(w), F.lit(0.0)) + 2 * F.col(name) + F.coalesce(F.lead(name).over(w), F.lit(0.0))

    rows = pixels.withColumn("_r", along("v", Window.partitionBy("image_id", "y").orderBy("x")))
    return rows.withColumn("s", along("_r", Window.partitionBy("image_id", "x").orderBy("y"))).select("image_id", "y", "x", "s")


def mosaic(panels: DataFrame, places: DataFrame, key: str | None = None) -> DataFrame:
    """Panels at their places (image_id, top, left) on one canvas, or one for each key; where they overlap, the mean weighted by nearness to a panel's centre."""
    sizes = panels.groupBy("image_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    own = panels.join(sizes.join(places, "image_id"), "image_id")
    weight = F.least(F.col("y") + 1, F.col("_h") - F.col("y")) * F.least(F.col("x") + 1, F.col("_w") - F.col("x"))
    put = _moved(own.withColumn("_weight", weight), F.col("y") + F.col("top"), F.col("x") + F.col("left"))
    return put.groupBy(*([key] if key else []), "y", "x").agg((F.sum(F.col("_weight") * F.col("v")) / F.sum("_weight")).alias("v"))


def helium(line: DataFrame, continuum: DataFrame) -> DataFrame:
    """A weak line's image: the line less the continuum, raised and stretched."""
    return stretch.linear_stretch(stretch.lift(lists.arithmetic(line, continuum, lambda a, b: a - b, ("image_id", "y", "x"))))


def jagging(frames: DataFrame, around: int = 2) -> DataFrame:
    """(image_id, y, shift): how far each row's centre of light is from that of the rows around it."""
    from pyspark.sql import Window

    centre = frames.groupBy("image_id", "y").agg((F.sum(F.col("v") * F.col("x")) / F.nullif(F.sum("v"), F.lit(0.0))).alias("_c"))
    near = Window.partitionBy("image_id").orderBy("y").rowsBetween(-around, around)
    return centre.select("image_id", "y", (F.col("_c") - F.avg("_c").over(near)).alias("shift"))


def jagging_corrected(frames: DataFrame, around: int = 2) -> DataFrame:
    """Rows moved back by their shift (see jagging), interpolated between pixels; beyond an edge the row's own edge pixel counts."""
    wide = frames.groupBy("image_id", "y").agg(F.max("x").alias("_w")).join(jagging(frames, around), ["image_id", "y"])
    at = frames.select("image_id", "y", "x").join(wide, ["image_id", "y"]).withColumn("_at", F.least(F.greatest(F.col("x") + F.col("shift"), F.lit(0.0)), F.col("_w").cast("double")))
    part = F.col("_at") - F.floor("_at")
    taps = F.array(*(F.struct((F.floor("_at") + d).cast("int").alias("tx"), (part if d else 1 - part).alias("w")) for d in (0, 1)))
    taps = at.select("image_id", "y", "x", F.explode(taps).alias("t")).filter("t.w > 0").select("image_id", "y", "x", "t.tx", "t.w")
    source = frames.select("image_id", "y", F.col("x").alias("tx"), "v")
    return taps.join(source, ["image_id", "y", "tx"]).groupBy("image_id", "y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def flipped_where(pixels: DataFrame, horizontal: Column, vertical: Column, width: Column, height: Column) -> DataFrame:
    """Images flipped by conditions on their own columns."""
    return _moved(pixels, F.when(vertical, height - 1 - F.col("y")).otherwise(F.col("y")), F.when(horizontal, width - 1 - F.col("x")).otherwise(F.col("x")))


def voigt_fit(profiles: DataFrame, rounds: int = 60) -> DataFrame:
    """(image_id, centre, depth, width, mix, continuum): a pseudo-Voigt line fitted to each profile (image_id, y, v) by damped least squares."""

    def shape(p: np.ndarray, x: np.ndarray) -> np.ndarray:
        u = (x - p[0]) / max(abs(p[2]), 1e-3)
        return p[4] - p[1] * (p[3] / (1 + u * u) + (1 - p[3]) * np.exp(-np.log(2) * u * u))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y")
        x, v = pdf.y.to_numpy(float), pdf.v.to_numpy(float)
        p = np.array([x[v.argmin()], np.ptp(v), max(1.0, len(x) / 8), 0.5, v.max()])
        damp, cost = 1e-2, np.inf
        for _ in range(rounds):
            r = v - shape(p, x)
            steps = 1e-6 * np.maximum(1, np.abs(p))
            jac = np.stack([(shape(p + np.eye(5)[i] * steps[i], x) - shape(p, x)) / steps[i] for i in range(5)], axis=1)
            a = jac.T @ jac
            try:
                q = p + np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-9), jac.T @ r)
            except np.linalg.LinAlgError:
                # A step of too little damping for what the profile tells.
                damp *= 4
                continue
            now = float(((v - shape(q, x)) ** 2).sum())
            if now < cost:
                p, cost, damp = q, now, damp / 3
            else:
                damp *= 4
        return pd.DataFrame([[int(pdf.image_id.iloc[0]), p[0], p[1], abs(p[2]), min(max(p[3], 0.0), 1.0), p[4]]], columns=["image_id", "centre", "depth", "width", "mix", "continuum"])

    return profiles.select("image_id", "y", "v").groupBy("image_id").applyInPandas(fit, "image_id long, centre double, depth double, width double, mix double, continuum double")


def richest_focus(pixels: DataFrame) -> DataFrame:
    """The sharpest image of all: (image_id, sharpness); ties go to the smallest image_id."""
    return stencil.sharpness(pixels).orderBy(F.desc("sharpness"), "image_id").limit(1)
