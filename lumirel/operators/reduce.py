"""Reductions over the images of a list (per pixel) and over the pixels of an image.

Both are the same aggregates under different keys: (key, y, x) or image_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reduce_pixels(pixels: DataFrame, how: str, key: str = "grp") -> DataFrame:
    """One image per key: how is avg, min, max or median of each pixel; partial aggregates combine before the shuffle."""
    return pixels.groupBy(key, "y", "x").agg(getattr(F, how)("v").alias("v"))


def clipped(pixels: DataFrame, keys: list[str], sigma: float, how: str = "avg") -> DataFrame:
    """Sigma-clipped mean or median by keys: values within sigma population deviations of the mean, else the mean."""
    stats = pixels.groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    kept = F.when(F.abs(F.col("v") - F.col("_m")) <= sigma * F.col("_s"), F.col("v"))
    out = pixels.join(stats, keys).groupBy(*keys).agg(getattr(F, how)(kept).alias("v"), F.first("_m").alias("_m"))
    return out.select(*keys, F.coalesce("v", "_m").alias("v"))


def checked_weight(weight: str = "w") -> Column:
    """A weight that raises an error unless it is finite and not negative."""
    w = F.col(weight).cast("double")
    good = w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < float("inf"))
    return F.when(good, w).otherwise(F.raise_error(F.lit("weights must be finite and not negative")))


def same_dimensions(pixels: DataFrame, key: str = "grp") -> DataFrame:
    """pixels, with an error where the images of a key differ in size; sizes are aggregates, one row a key."""
    sizes = pixels.groupBy(key, "image_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    odd = sizes.groupBy(F.col(key).alias("_k")).agg(((F.min("_h") != F.max("_h")) | (F.min("_w") != F.max("_w"))).alias("_odd"))
    out = pixels.join(odd, F.col(key).eqNullSafe(F.col("_k")))
    return out.withColumn("v", F.when(F.col("_odd"), F.raise_error(F.lit("images must have the same dimensions"))).otherwise(F.col("v"))).drop("_k", "_odd")


def stack_local(pixels: DataFrame, best: float, softness: float = 0.1, error: str = "err", key: str = "grp") -> DataFrame:
    """Per pixel, the mean of a key's images weighted by how good each is there: a logistic step at the best share of the ranks of an error column."""
    w = Window.partitionBy(key, "y", "x")
    place = (F.row_number().over(w.orderBy(error, "image_id")) - 1) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))
    own = pixels.withColumn("_w", 1 / (1 + F.exp((place - best) / softness)))
    return own.groupBy(key, "y", "x").agg((F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("v"))


def image_sketch(pixels: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Approximate quartiles and number of distinct values of each image, from sketches of bounded size that merge before the shuffle."""
    return pixels.groupBy("image_id").agg(F.percentile_approx("v", [0.25, 0.5, 0.75], accuracy).alias("quartiles"), F.approx_count_distinct("v").alias("distinct"))


def weighted_avg(pixels: DataFrame, weight: str = "w", key: str = "grp") -> DataFrame:
    """sum(w * v) / sum(w) of each pixel; 0 where weights add up to 0. A weight that is null, negative or not finite raises an error."""
    pixels = pixels.withColumn(weight, checked_weight(weight))
    total = F.sum(weight)
    return pixels.groupBy(key, "y", "x").agg(F.when(total == 0, F.lit(0.0)).otherwise(F.sum(F.col(weight) * F.col("v")) / total).alias("v"))


def weighted_clipped_avg(pixels: DataFrame, sigma: float, weight: str = "w", key: str = "grp") -> DataFrame:
    """Weighted mean of the values within sigma weighted population deviations of the weighted mean, else that mean."""
    keys = [key, "y", "x"]
    pixels = pixels.withColumn(weight, checked_weight(weight))
    w, v = F.col(weight), F.col("v")
    mean = pixels.groupBy(*keys).agg((F.sum(w * v) / F.sum(w)).alias("_m"))
    with_mean = pixels.join(mean, keys)
    spread = with_mean.groupBy(*keys).agg(F.sqrt(F.sum(w * F.pow(v - F.col("_m"), 2)) / F.sum(w)).alias("_s"))
    kept = with_mean.join(spread, keys).withColumn("_w", F.when(F.abs(v - F.col("_m")) <= sigma * F.col("_s"), w))
    out = kept.groupBy(*keys).agg((F.sum(F.col("_w") * v) / F.sum("_w")).alias("v"), F.first("_m").alias("_m"))
    return out.select(*keys, F.coalesce("v", "_m").alias("v"))


def image_stats(pixels: DataFrame, mask: Column | None = None) -> DataFrame:
    """Mean, extremes, median and deviation of the (masked) pixels of each image."""
    v = F.when(mask, F.col("v")) if mask is not None else F.col("v")
    return pixels.groupBy("image_id").agg(
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n")
    )


def image_percentile(pixels: DataFrame, p: float, mask: Column | None = None) -> DataFrame:
    """Percentile with linear interpolation between ranks."""
    v = F.when(mask, F.col("v")) if mask is not None else F.col("v")
    return pixels.groupBy("image_id").agg(F.percentile(v, F.lit(p / 100)).alias("v"))


def nearest_rank(pixels: DataFrame, *percents: float, key: str = "image_id") -> DataFrame:
    """Percentiles by the nearest rank, round(p / 100 * (n - 1)): p0, p1 and so on."""
    w = Window.partitionBy(key)
    ranked = pixels.select(key, "v", (F.row_number().over(w.orderBy("v")) - 1).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    return ranked.groupBy(key).agg(*(F.max(F.when(F.col("_r") == F.floor(p / 100 * (F.col("_n") - 1) + 0.5), F.col("v"))).alias(f"p{i}") for i, p in enumerate(percents)))


def statistics_cube(pixels: DataFrame) -> DataFrame:
    """Mean and extremes by every combination of group and row, in one pass."""
    return pixels.cube("grp", "y").agg(F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
