"""Geometry as projections of coordinates, and resampling as a gather of four neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.images import as_images


def _moved(pixels: DataFrame, y: Column, x: Column) -> DataFrame:
    return pixels.select(*(y.cast("int").alias("y") if c == "y" else x.cast("int").alias("x") if c == "x" else F.col(c) for c in pixels.columns))


def hflip(pixels: DataFrame, width: int) -> DataFrame:
    return _moved(pixels, F.col("y"), width - 1 - F.col("x"))


def vflip(pixels: DataFrame, height: int) -> DataFrame:
    return _moved(pixels, height - 1 - F.col("y"), F.col("x"))


def rotate_left(pixels: DataFrame, width: int) -> DataFrame:
    return _moved(pixels, width - 1 - F.col("x"), F.col("y"))


def rotate_right(pixels: DataFrame, height: int) -> DataFrame:
    return _moved(pixels, F.col("x"), height - 1 - F.col("y"))


def crop(pixels: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    """A rectangle, moved to the origin; what reaches beyond the image is left out."""
    inside = pixels.filter(F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1))
    return _moved(inside, F.col("y") - top, F.col("x") - left)


def autocrop(pixels: DataFrame, cx: Column | float, cy: Column | float, radius: Column | float, factor: float = 1.1, rounding: int = 16) -> DataFrame:
    """A centred square of factor times the disk's diameter, rounded up to a multiple; the disk may be columns, and differ by image."""
    cx, cy, radius = (c if isinstance(c, Column) else F.lit(float(c)) for c in (cx, cy, radius))
    side = F.ceil(2 * radius * factor / rounding) * rounding
    left, top = F.floor(cx - side / 2 + 0.5), F.floor(cy - side / 2 + 0.5)
    inside = pixels.filter(F.col("x").between(left, left + side - 1) & F.col("y").between(top, top + side - 1))
    return _moved(inside, F.col("y") - top, F.col("x") - left)


def crop_rect(pixels: DataFrame, cx: float, cy: float, width: int, height: int, fill: float = 0.0) -> DataFrame:
    """A rectangle of a fixed size around a centre; pixels beyond the image are filled."""
    left, top = math.floor(cx - width / 2 + 0.5), math.floor(cy - height / 2 + 0.5)
    ids = pixels.select("image_id").distinct()
    grid = ids.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    inside = crop(pixels.select("image_id", "y", "x", "v"), left, top, width, height)
    return grid.join(inside, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.coalesce("v", F.lit(fill)).alias("v"))


def side_by_side(left: DataFrame, right: DataFrame, left_width: int) -> DataFrame:
    """Two images of one key next to each other."""
    return left.unionByName(_moved(right, F.col("y"), F.col("x") + left_width))


def top_bottom(top: DataFrame, bottom: DataFrame, top_height: int) -> DataFrame:
    return top.unionByName(_moved(bottom, F.col("y") + top_height, F.col("x")))


def collage(pixels: DataFrame, pattern: str, width: int, height: int, padding: int, ordinal: str) -> DataFrame:
    """Images at the X of a pattern's rows, in the order of an ordinal column; '.' leaves a place free."""
    rows = pattern.replace(";", "/").split("/")
    places = [(r, c) for r, row in enumerate(rows) for c, sign in enumerate(row) if sign.upper() == "X"]
    spots = pixels.sparkSession.createDataFrame([(i, padding + r * (height + padding), padding + c * (width + padding)) for i, (r, c) in enumerate(places)], f"`{ordinal}` int, _dy int, _dx int")
    placed = pixels.join(F.broadcast(spots), ordinal)
    return placed.select((F.col("y") + F.col("_dy")).cast("int").alias("y"), (F.col("x") + F.col("_dx")).cast("int").alias("x"), "v")


def collages(pixels: DataFrame, pattern: str, width: int, height: int, padding: int, key: str = "grp", ids: int = 4096) -> DataFrame:
    """(key, sheet, y, x, v): all images of each key in the order of image_id, on as many sheets of a pattern as they fill.

    Ordinals come from images and not from pixels: they are numbered within ranges of so many
    ids, and start where the counts of the ranges before end.
    """
    n = pattern.upper().count("X")
    own = pixels.select(key, "image_id").distinct().withColumn("_r", F.floor(F.col("image_id") / ids))
    before = Window.partitionBy(key).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy(key, "_r").agg(F.count(F.lit(1)).alias("_n")).select(F.col(key).alias("_k"), F.col("_r").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = own.withColumn("_o", F.row_number().over(Window.partitionBy(key, "_r").orderBy("image_id")) - 1)
    ordinal = F.col("_o") + F.col("_before")
    at = numbered.join(counts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_s")))
    at = at.select(F.col(key).alias("_k"), F.col("image_id").alias("_id"), F.floor(ordinal / n).alias("sheet"), (ordinal % n).cast("int").alias("_place"))
    placed = pixels.join(at, F.col(key).eqNullSafe(F.col("_k")) & (F.col("image_id") == F.col("_id")))
    rows = pattern.replace(";", "/").split("/")
    places = [(r, c) for r, row in enumerate(rows) for c, sign in enumerate(row) if sign.upper() == "X"]
    spots = pixels.sparkSession.createDataFrame([(i, padding + r * (height + padding), padding + c * (width + padding)) for i, (r, c) in enumerate(places)], "_place int, _dy int, _dx int")
    return placed.join(F.broadcast(spots), "_place").select(key, "sheet", (F.col("y") + F.col("_dy")).cast("int").alias("y"), (F.col("x") + F.col("_dx")).cast("int").alias("x"), "v")


def fit_canvas(pixels: DataFrame) -> DataFrame:
    """All images centred on a canvas of the largest width and height."""
    sizes = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    largest = sizes.agg(F.max("w").alias("max_w"), F.max("h").alias("max_h"))
    shift = sizes.join(F.broadcast(largest)).select("image_id", F.floor((F.col("max_w") - F.col("w")) / 2).alias("_dx"), F.floor((F.col("max_h") - F.col("h")) / 2).alias("_dy"))
    return pixels.join(shift, "image_id").select("image_id", (F.col("y") + F.col("_dy")).cast("int").alias("y"), (F.col("x") + F.col("_dx")).cast("int").alias("x"), "v")


def gather(pixels: DataFrame, width: int, height: int, source_y: Column, source_x: Column, fill: float = 0.0) -> DataFrame:
    """Images of width by height whose pixel (y, x) is interpolated bilinearly at (source_y, source_x) of the source.

    pixels may be dense images too. An image stays one row, of which each target pixel reads its four taps: nothing but the image itself is shuffled,
    and that only if it comes as pixels. A target of which a tap lies outside of the source gets the fill.
    """
    own = as_images(pixels).filter(F.size("data") > 0).select("image_id", F.col("width").alias("_w"), F.col("data").alias("_data"))
    rows = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    grid = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    at = grid.select("*", source_y.alias("_sy"), source_x.alias("_sx")).filter("_sy is not null and _sx is not null")
    fy, fx = F.col("_sy") - F.floor("_sy"), F.col("_sx") - F.floor("_sx")
    base = at.select("*", F.floor("_sy").cast("int").alias("_y0"), F.floor("_sx").cast("int").alias("_x0"), fy.alias("_fy"), fx.alias("_fx"))

    def tap(dy: int, dx: int) -> Column:
        ty, tx = F.col("_y0") + dy, F.col("_x0") + dx
        w = (F.col("_fy") if dy else 1 - F.col("_fy")) * (F.col("_fx") if dx else 1 - F.col("_fx"))
        v = F.when((ty >= 0) & (tx >= 0) & (tx < F.col("_w")), F.get("_data", ty * F.col("_w") + tx))
        return F.when(w > 0, w * v).otherwise(0.0)

    total = tap(0, 0) + tap(0, 1) + tap(1, 0) + tap(1, 1)
    return base.select("image_id", "y", "x", F.coalesce(total, F.lit(float(fill))).alias("v"))


def rescale(pixels: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Bilinear resize that keeps the centre in place."""
    return gather(
        pixels,
        new_width,
        new_height,
        (F.col("y") - (new_height - 1) / 2) * (height / new_height) + (height - 1) / 2,
        (F.col("x") - (new_width - 1) / 2) * (width / new_width) + (width - 1) / 2,
    )


def rotate(pixels: DataFrame, width: int, height: int, radians: float, fill: float = 0.0) -> DataFrame:
    """Rotation around the centre, by inverse mapping."""
    cy, cx, c, s = (height - 1) / 2, (width - 1) / 2, math.cos(radians), math.sin(radians)
    dy, dx = F.col("y") - cy, F.col("x") - cx
    return gather(pixels, width, height, dy * c - dx * s + cy, dx * c + dy * s + cx, fill)


def radius_rescale(pixels: DataFrame, width: int, height: int, radius: Column, target: float) -> DataFrame:
    """Images whose disk (of a radius known by image) has the target radius, on the same canvas."""
    scale = radius / target
    return gather(pixels, width, height, (F.col("y") - (height - 1) / 2) * scale + (height - 1) / 2, (F.col("x") - (width - 1) / 2) * scale + (width - 1) / 2)


def rotate_and_scale(pixels: DataFrame, width: int, height: int, radians: float, scale: float, fill: float = 0.0) -> DataFrame:
    """Rotation around the centre and scaling by a factor on the same canvas, by inverse mapping."""
    cy, cx, c, s = (height - 1) / 2, (width - 1) / 2, math.cos(radians) / scale, math.sin(radians) / scale
    dy, dx = F.col("y") - cy, F.col("x") - cx
    return gather(pixels, width, height, dy * c - dx * s + cy, dx * c + dy * s + cx, fill)


def radius_rescale2(pixels: DataFrame, width: int, height: int, radius: Column, target: float, new_width: int, new_height: int) -> DataFrame:
    """Images whose disk (of a radius known by image) has the target radius, centred on a canvas of another size."""
    scale = radius / target
    return gather(pixels, new_width, new_height, (F.col("y") - (new_height - 1) / 2) * scale + (height - 1) / 2, (F.col("x") - (new_width - 1) / 2) * scale + (width - 1) / 2)


def area_sum(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes(image_id, top, left, bottom, right), ends included, with total: the sum of the box by four corners of the integral image.

    Boxes lie within their images.
    """
    names = ["image_id", "top", "left", "bottom", "right"]
    corners = F.array(*(F.struct(y.alias("y"), x.alias("x"), F.lit(sign).alias("sign")) for y, x, sign in (
        (F.col("bottom"), F.col("right"), 1), (F.col("top") - 1, F.col("right"), -1), (F.col("bottom"), F.col("left") - 1, -1), (F.col("top") - 1, F.col("left") - 1, 1)
    )))
    at = boxes.select(*names, F.explode(corners).alias("c")).filter("c.y >= 0 and c.x >= 0").select(*names, "c.y", "c.x", "c.sign")
    sums = integral_image(pixels.select("image_id", "y", "x", "v"))
    return at.join(sums, ["image_id", "y", "x"]).groupBy(*names).agg(F.sum(F.col("sign") * F.col("v")).alias("total"))


def integral_image(pixels: DataFrame) -> DataFrame:
    """Sums of all pixels above and to the left, each included."""
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("_r", F.sum("v").over(row)).withColumn("v", F.sum("_r").over(column)).drop("_r")
