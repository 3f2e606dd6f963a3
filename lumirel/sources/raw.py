"""Lossless images with their metadata, kept as Parquet; and folders of images chosen by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_raw(images: DataFrame, path: str, partition: str | None = None) -> DataFrame:
    """Writes dense images, all columns of theirs, and returns them unchanged."""
    out = images.write.mode("overwrite")
    (out.partitionBy(partition) if partition else out).parquet(path)
    return images


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def choose_files(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(path, name, modificationTime, length) of the files in a folder whose whole name matches a pattern; contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).filter(F.col("name").rlike(f"^(?:{pattern})$"))


def output_path(template: str, **columns) -> F.Column:
    """A path by a template of names in braces, each a Column."""
    parts, rest = [], template
    for name in sorted(columns, key=lambda n: template.find("{" + n + "}")):
        before, found, rest_ = rest.partition("{" + name + "}")
        if found:
            parts += [F.lit(before), columns[name].cast("string")]
            rest = rest_
    return F.concat(*parts, F.lit(rest))
