"""Images and pixels of the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense images, one row each: image_id, grp, width, height, pixel_shift, data (row-major)."""
    value = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 32767.5).cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.col("label").alias("grp"),
        F.lit(SIDE).alias("width"),
        F.lit(SIDE).alias("height"),
        (F.col("vec_id") % 31 - 15).cast("double").alias("pixel_shift"),
        value.alias("data"),
    )


def to_pixels(dense: DataFrame) -> DataFrame:
    """Dense images as a pixel relation; their other columns stay."""
    rest = [c for c in dense.columns if c not in ("data", "width", "height")]
    flat = dense.select(*rest, "width", F.posexplode("data").alias("i", "v"))
    return flat.select(*rest, F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "v")


def to_images(pixels: DataFrame) -> DataFrame:
    """A pixel relation as dense images: image_id, width, height, data; pixels that are absent are null."""
    grouped = pixels.groupBy("image_id").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("cells")
    )
    size = F.col("width") * F.col("height")
    place = lambda c: c["y"] * F.col("width") + c["x"]
    none = lambda n: F.array_repeat(F.lit(None).cast("double"), n.cast("int"))
    # Each cell after as many nulls as are missing before it.
    gaps = F.transform("cells", lambda c, i: F.concat(none(place(c) - F.when(i > 0, place(F.get("cells", i - 1))).otherwise(-1) - 1), F.array(c["v"].cast("double"))))
    sparse = F.concat(F.flatten(gaps), none(size - 1 - place(F.get("cells", F.size("cells") - 1))))
    return grouped.select("image_id", "width", "height", F.when(F.size("cells") == size, F.col("cells.v")).otherwise(sparse).alias("data"))


def as_images(rows: DataFrame) -> DataFrame:
    """Dense images as they are, and a pixel relation as dense images."""
    return rows if "data" in rows.columns else to_images(rows)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, grp, pixel_shift, y, x, v of all images."""
    return to_pixels(images(spark, sf_dir))
