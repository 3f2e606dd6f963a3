"""Stretches that need a statistic of the whole image: an aggregate per image, joined back by image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixel import PEAK, asinh, limit, mtf_unit
from ..sources.images import as_images, to_pixels
from . import kernels
from .reduce import nearest_rank


def with_image(pixels: DataFrame, **aggregates) -> DataFrame:
    """pixels with columns of per-image aggregates; aggregates combine before their shuffle, and images stay whole."""
    stats = pixels.groupBy("image_id").agg(*(a.alias(n) for n, a in aggregates.items()))
    return pixels.join(stats, "image_id")


def linear_stretch(pixels: DataFrame, high: float = PEAK) -> DataFrame:
    """Values from 0 to high; a flat image stays as it is."""
    own = with_image(pixels, _lo=F.min("v"), _hi=F.max("v"))
    flat = F.col("_hi") == F.col("_lo")
    scale = high / F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo"))
    return own.withColumn("v", F.when(flat, F.col("v")).otherwise(scale * (F.col("v") - F.col("_lo")))).drop("_lo", "_hi")


def invert(pixels: DataFrame) -> DataFrame:
    return with_image(pixels, _hi=F.max("v")).withColumn("v", F.col("_hi") - F.col("v")).drop("_hi")


def lift(pixels: DataFrame) -> DataFrame:
    """Raises an image with negative values so that its lowest is 0."""
    return with_image(pixels, _lo=F.min("v")).withColumn("v", F.col("v") - F.least("_lo", F.lit(0.0))).drop("_lo")


def range_expansion(pixels: DataFrame) -> DataFrame:
    return with_image(pixels, _hi=F.max("v")).withColumn("v", F.col("v") * (PEAK / F.greatest("_hi", F.lit(1e-7)))).drop("_hi")


def adjust_gamma(pixels: DataFrame, gamma: float) -> DataFrame:
    return with_image(pixels, _hi=F.greatest(F.max("v"), F.lit(1e-7))).withColumn("v", F.pow(F.col("v") / F.col("_hi"), F.lit(float(gamma))) * PEAK).drop("_hi")


def asinh_stretch(pixels: DataFrame, black: float, stretch: float) -> DataFrame:
    return linear_stretch(pixels.withColumn("v", asinh(F.col("v"), black, stretch)))


def equalize(pixels: DataFrame) -> DataFrame:
    """Every image gets the mean of the means and the mean of the deviations; a flat image only the mean."""
    stats = pixels.groupBy("image_id").agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    goal = stats.agg(F.avg("_m").alias("_gm"), F.avg("_s").alias("_gs"))
    own = pixels.join(stats.join(F.broadcast(goal)), "image_id")
    ratio = F.when(F.col("_s") > 0, F.col("_gs") / F.nullif(F.col("_s"), F.lit(0.0))).otherwise(F.lit(0.0))
    return own.withColumn("v", limit((F.col("v") - F.col("_m")) * ratio + F.col("_gm"))).drop("_m", "_s", "_gm", "_gs")


def percentile_stretch(pixels: DataFrame, low: float, high: float, clip: int = 1, mask: Column | None = None) -> DataFrame:
    """Linear between two nearest-rank percentiles, of the pixels of a mask if there is one; an image that the mask has no pixel of stays.

    clip 0 keeps values beyond, 1 limits them to 0..PEAK, and 2 too, but with the image's brightest pixel as its white point if that is brighter.
    """
    found = nearest_rank(pixels if mask is None else pixels.filter(mask), low, high)
    own = pixels.join(found, "image_id", "inner" if mask is None else "left")
    if clip == 2:
        own = with_image(own, _top=F.max("v")).withColumn("p1", F.when(F.col("p1").isNotNull(), F.greatest("p1", "_top"))).drop("_top")
    span = F.when(F.col("p1") > F.col("p0"), F.col("p1") - F.col("p0")).otherwise(F.lit(1.0))
    v = (F.col("v") - F.col("p0")) * (PEAK / span)
    return own.withColumn("v", F.when(F.col("p0").isNull(), F.col("v")).otherwise(limit(v) if clip else v)).drop("p0", "p1")


def mtf_autostretch(pixels: DataFrame, shadows_clip: float = -2.8, target: float = 0.25, mask: Column | None = None) -> DataFrame:
    """Midtone transfer whose shadows and midtones follow from each image's median and absolute deviation, of the pixels of a mask if there is one.

    An image that the mask has no pixel of stays as it is.
    """
    use = lambda c: c if mask is None else F.when(mask, c)
    middle = pixels.groupBy("image_id").agg((F.median(use(F.col("v"))) / PEAK).alias("_med"))
    own = pixels.join(middle, "image_id").withColumn("_x", F.col("v") / PEAK)
    mad = own.groupBy("image_id").agg((1.4826 * F.median(use(F.abs(F.col("_x") - F.col("_med"))))).alias("_mad"))
    own = own.join(mad, "image_id")
    shadow = F.least(F.greatest(F.col("_med") + shadows_clip * F.col("_mad"), F.lit(0.0)), F.lit(1.0))
    own = own.withColumn("_lo", shadow).withColumn("_mid", mtf_unit(F.col("_med") - F.col("_lo"), target))
    span = F.when(F.col("_lo") < 1, 1 - F.col("_lo")).otherwise(F.lit(1.0))
    stretched = PEAK * mtf_unit((F.col("_x") - F.col("_lo")) / span, F.col("_mid"))
    return own.withColumn("v", F.when(F.col("_med").isNull(), F.col("v")).otherwise(stretched)).drop("_med", "_x", "_mad", "_lo", "_mid")


def histogram(pixels: DataFrame, bins: int = 256, key: str = "image_id") -> DataFrame:
    """Counts by bin, round(v * bins / PEAK) limited to the bins, and their running total."""
    b = F.least(F.greatest(F.floor(F.col("v") * bins / PEAK + 0.5), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = pixels.groupBy(key, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("cumulative", F.sum("n").over(Window.partitionBy(key).orderBy("bin")))


def clahe(pixels: DataFrame, width: int, height: int, tile: int | tuple[int, ...], bins: int, clip: float) -> DataFrame:
    """Contrast-limited adaptive equalisation of a pixel relation or of dense images; with tiles of several sides, the mean of them all.

    Shares of tiles are never rows: images stay whole in a kernel, and their pixels are shuffled once if they come as pixels.
    """
    tiles = tile if isinstance(tile, tuple) else (tile,)
    return to_pixels(kernels.clahe(as_images(pixels), width, height, tiles, bins, clip)).filter(~F.isnan("v"))
