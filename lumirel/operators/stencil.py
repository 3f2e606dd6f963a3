"""Stencils as windows over rows and columns; borders repeat the edge pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PEAK = 65535.0


def along_row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_column():
    return Window.partitionBy("image_id", "x").orderBy("y")


def taps(value: str, window, radius: int) -> list[Column]:
    """The value at each distance from -radius to radius along a window, with the edges repeated."""
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    near = [F.coalesce(F.lag(value, d).over(window), first) for d in range(radius, 0, -1)]
    far = [F.coalesce(F.lead(value, d).over(window), last) for d in range(1, radius + 1)]
    return [*near, F.col(value), *far]


def separable(pixels: DataFrame, weights: list[float], out: str = "v") -> DataFrame:
    """A sum weighted along rows, then along columns."""
    radius = len(weights) // 2
    along = sum((w * t for w, t in zip(weights, taps("v", along_row(), radius), strict=True)), F.lit(0.0))
    rows = pixels.withColumn("_r", along)
    down = sum((w * t for w, t in zip(weights, taps("_r", along_column(), radius), strict=True)), F.lit(0.0))
    return rows.withColumn(out, down).drop("_r")


def box_sum(pixels: DataFrame, size: int, out: str = "s") -> DataFrame:
    """pixels with the sum of the size by size box around each pixel."""
    return separable(pixels, [1.0] * size, out)


def clamped(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(PEAK))


def blur(pixels: DataFrame, size: int = 3) -> DataFrame:
    return box_sum(pixels, size).withColumn("v", clamped(F.col("s") / (size * size))).drop("s")


def sharpen(pixels: DataFrame, size: int = 3) -> DataFrame:
    """Twice the pixel less the mean of its neighbours."""
    return box_sum(pixels, size).withColumn("v", clamped(2 * F.col("v") - (F.col("s") - F.col("v")) / (size * size - 1))).drop("s")


def unsharp_mask(pixels: DataFrame, strength: float = 1.0, size: int = 3) -> DataFrame:
    soft = box_sum(pixels, size)
    return soft.withColumn("v", F.col("v") + strength * (F.col("v") - clamped(F.col("s") / (size * size)))).drop("s")


def gaussian_blur(pixels: DataFrame, sigma: float, radius: int) -> DataFrame:
    import math

    raw = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    return separable(pixels, [w / sum(raw) for w in raw])


def gradient(pixels: DataFrame) -> DataFrame:
    """Squared size of the central differences along both axes."""
    left, _, right = taps("v", along_row(), 1)
    up, _, down = taps("v", along_column(), 1)
    both = pixels.withColumn("_gx", right - left).withColumn("_gy", down - up)
    return both.withColumn("v", F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")).drop("_gx", "_gy")


def laplacian(pixels: DataFrame, out: str = "v") -> DataFrame:
    """The 3 by 3 response 1 -2 1 / -2 4 -2 / 1 -2 1, of pixels that have all neighbours."""
    a, b, c = (F.lag("v").over(along_row()), F.col("v"), F.lead("v").over(along_row()))
    rows = pixels.withColumn("_r", a - 2 * b + c)
    a, b, c = (F.lag("_r").over(along_column()), F.col("_r"), F.lead("_r").over(along_column()))
    return rows.withColumn(out, a - 2 * b + c).drop("_r").filter(F.col(out).isNotNull())


def noise_sigma(pixels: DataFrame, mask: Column | None = None) -> DataFrame:
    """1.4826 times the upper median of the Laplacian's nonzero responses, over 6; of those at pixels of a mask, if there is one."""
    response = laplacian(pixels, "r")
    response = (response if mask is None else response.filter(mask)).select("image_id", F.abs("r").alias("r")).filter("r > 0")
    w = Window.partitionBy("image_id")
    ranked = response.select("image_id", "r", F.row_number().over(w.orderBy("r")).alias("_k"), F.count(F.lit(1)).over(w).alias("_n"))
    middle = ranked.filter(F.col("_k") == F.floor(F.col("_n") / 2) + 1)
    return middle.select("image_id", (1.4826 * F.col("r") / 6).alias("sigma"))


def sharpness(pixels: DataFrame) -> DataFrame:
    """Mean squared Laplacian of each image."""
    return laplacian(pixels, "r").groupBy("image_id").agg(F.avg(F.col("r") * F.col("r")).alias("sharpness"))
