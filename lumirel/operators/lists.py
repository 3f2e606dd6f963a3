"""Lists of images as relations with an ordinal: filters, orders, choices and conditionals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Subjects of the filter by spelling, and comparison names by spelling: fixed values.
SUBJECTS = {"fileName": "file_name", "file-name": "file_name", "dirName": "dir_name", "dir-name": "dir_name", "pixelShift": "pixel_shift", "pixel-shift": "pixel_shift", "date": "ts", "datetime": "ts", "dateTime": "ts", "time": "time"}
COMPARE = {"==": "eq", "eq": "eq", "equals": "eq", "=": "eq", ">": "gt", "gt": "gt", "<": "lt", "lt": "lt", "<=": "le", "le": "le", ">=": "ge", "ge": "ge", "!=": "ne", "ne": "ne", "not-equals": "ne", "contains": "contains", "starts-with": "startswith", "starts_with": "startswith", "ends-with": "endswith", "ends_with": "endswith"}

#: Buckets that means of images are counted by.
BUCKETS = 4096


def filter_list(rows: DataFrame, subject: str, function: str, value) -> DataFrame:
    """Rows whose subject compares so with a value; an absent subject, and an unknown one, drops the row.

    Times of day compare as HH:mm:ss. Text has no order, so > on text keeps nothing.
    """
    column = SUBJECTS.get(subject)
    if column is None or function not in COMPARE:
        return rows.filter(F.lit(False))
    subject_col = F.date_format("ts", "HH:mm:ss") if column == "time" else F.col(column)
    how = COMPARE[function]
    if how in ("contains", "startswith", "endswith"):
        return rows.filter(getattr(subject_col.cast("string"), how)(value))
    if how in ("gt", "lt", "le", "ge") and column in ("file_name", "dir_name"):
        return rows.filter(F.lit(False))
    other = F.to_timestamp(F.lit(value)) if column == "ts" else F.lit(value)
    tests = {"eq": subject_col == other, "ne": subject_col != other, "gt": subject_col > other, "lt": subject_col < other, "ge": subject_col >= other, "le": subject_col <= other}
    return rows.filter(tests[how])


def sort_list(rows: DataFrame, order: str = "shift", ordinal: str = "ordinal") -> DataFrame:
    """Rows by date, shift (0 where absent) or file_name, with ' desc' or ' asc'; unknown keys keep the list's order."""
    name, _, direction = order.partition(" ")
    keys = {"date": F.col("ts"), "shift": F.coalesce("pixel_shift", F.lit(0.0)), "file_name": F.coalesce("file_name", F.lit(""))} if name in ("date", "shift", "file_name") else {}
    if not keys:
        return rows.orderBy(ordinal)
    key = keys[name]
    return rows.orderBy(key.desc() if direction == "desc" else key.asc(), ordinal)


def get_at(rows: DataFrame, index: int, ordinal: str = "ordinal") -> DataFrame:
    return rows.filter(F.col(ordinal) == index)


def minus(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """All of left that is equal to nothing in right; repeated rows of left stay."""
    return left.join(right.select(*on), on, "left_anti")


def image_range(rows: DataFrame, first: float, last: float, step: float = 1.0) -> DataFrame:
    """Images at the shifts from first to last; the test is a list of values, which reaches the scan."""
    shifts, at = [], first
    while step and (at <= last if step > 0 else at >= last):
        shifts.append(float(int(at * 100 + (0.5 if at >= 0 else -0.5))) / 100)
        at += step
    return rows.filter(F.col("pixel_shift").isin(shifts)) if shifts else rows.filter(F.lit(False))


def all_pixels(pixels: DataFrame, test: Column) -> DataFrame:
    """(image_id, holds): whether a test holds for every pixel."""
    return pixels.groupBy("image_id").agg(F.bool_and(test).alias("holds"))


def choose(pixels: DataFrame, test: Column, then: Column, other: Column) -> DataFrame:
    """Each image's pixels by one expression where the test holds for all its pixels, else by the other."""
    return pixels.join(all_pixels(pixels, test), "image_id").withColumn("v", F.when(F.col("holds"), then).otherwise(other)).drop("holds")


def arithmetic(a: DataFrame, b: DataFrame, how, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Two images pixel by pixel; how makes a Column of the two values.

    With only y and x as keys, b is one image and each image of a meets it; with more keys images meet by those, and images without a
    partner are left out. Images that meet and differ in size raise an error: sizes are aggregates of one row an
    image, and whether any differ is one row, so no pixel is shuffled for it.
    """
    left, right = a.withColumnRenamed("v", "_a"), b.select(*keys, F.col("v").alias("_b"))
    by = [k for k in keys if k not in ("y", "x")]
    size = lambda df, names, side: df.groupBy(*names).agg(F.max("y").alias(f"_{side}y"), F.max("x").alias(f"_{side}x"))
    own = size(a, by or [c for c in ("image_id",) if c in a.columns], "l")
    other = size(b, by, "r")
    met = own.join(other, by) if by else own.join(F.broadcast(other))
    odd = met.agg(F.coalesce(F.max((F.col("_ly") != F.col("_ry")) | (F.col("_lx") != F.col("_rx"))), F.lit(False)).alias("_odd"))
    checked = F.when(F.col("_odd"), F.raise_error(F.lit("images must have the same dimensions"))).otherwise(how(F.col("_a"), F.col("_b")))
    return left.join(F.broadcast(odd)).join(right, list(keys)).withColumn("v", checked).drop("_a", "_b", "_odd")


def continuum(pixels: DataFrame, least_shift: float = 8.0, saturated: float = 60000.0, keep: float = 0.8, or_all: bool = False) -> DataFrame:
    """The pixel-wise median of images far from the line, without those that are saturated or dark.

    Per-image aggregates come first, so that the cut is found among images and not pixels:
    their means are counted by bucket, buckets above the cut are taken whole, and only the
    images of the bucket that holds it are ranked. Where no image is kept there are no rows, or with or_all the median of all images.
    """
    far = pixels.filter(F.abs("pixel_shift") >= least_shift)
    stats = far.groupBy("image_id").agg(F.avg("v").alias("mean"), F.avg((F.col("v") >= saturated).cast("double")).alias("burnt"))
    cut = stats.agg(F.floor(F.lit(keep) * F.count(F.lit(1))).alias("_cut"))
    fine = stats.filter("burnt < 0.125").select("image_id", "mean")
    ends = fine.agg(F.min("mean").alias("_low"), F.max("mean").alias("_high"))
    # Bucket 0 has the largest means; a bucket never rises as the mean does.
    at = F.floor((F.col("_high") - F.col("mean")) / (F.col("_high") - F.col("_low")) * BUCKETS)
    bucket = F.when(F.col("mean").isNull(), BUCKETS).when(F.col("_high") > F.col("_low"), F.least(at, F.lit(BUCKETS - 1))).otherwise(0)
    dealt = fine.join(F.broadcast(ends)).select("image_id", "mean", bucket.cast("int").alias("_b"))
    above = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    placed = dealt.join(F.broadcast(counts.join(F.broadcast(cut)).filter("_above < _cut")), "_b")
    place = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc("mean"), "image_id"))
    ranked = placed.filter("_above + _n > _cut").withColumn("_place", place).filter("_above + _place <= _cut")
    best = placed.filter("_above + _n <= _cut").select("image_id").union(ranked.select("image_id"))
    if not or_all:
        return far.join(best, "image_id", "left_semi").groupBy("y", "x").agg(F.median("v").alias("v"))
    best = best.withColumn("_kept", F.lit(True))
    kept = best.agg(F.count(F.lit(1)).alias("_total"))
    own = pixels.join(best, "image_id", "left").join(F.broadcast(kept))
    chosen = own.filter(((F.abs("pixel_shift") >= least_shift) & F.col("_kept")) | (F.col("_total") == 0))
    return chosen.groupBy("y", "x").agg(F.median("v").alias("v"))


def reference_image(scores: DataFrame, column: str, key: str, most: bool = True) -> DataFrame:
    """Per key, the image of the largest (or smallest) score; ties go to the smallest image_id."""
    rank = F.max(F.struct(column, F.negative("image_id").alias("n"))) if most else F.min(F.struct(column, "image_id"))
    out = scores.groupBy(key).agg(rank.alias("m"))
    return out.select(key, (F.negative("m.n") if most else F.col("m.image_id")).alias("image_id"))


def transition(pixels: DataFrame, steps: int, key: str = "grp", easing: str = "linear") -> DataFrame:
    """steps images between each image of a list and the next, in the order of image_id."""
    w = Window.partitionBy(key, "y", "x").orderBy("image_id")
    pairs = pixels.withColumn("_next", F.lead("v").over(w)).filter("_next is not null")
    out = pairs.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    t = F.col("step") / (steps + 1)
    eased = {"linear": t, "ease_in": t * t, "ease_out": 1 - (1 - t) * (1 - t), "ease_in_out": F.when(t < 0.5, 2 * t * t).otherwise(1 - 2 * (1 - t) * (1 - t))}[easing]
    return out.withColumn("v", F.col("v") + (F.col("_next") - F.col("v")) * eased).drop("_next")


def stack_best(pixels: DataFrame, errors: DataFrame, best: float, decay: float = -3.0, key: str = "grp") -> DataFrame:
    """Weighted mean of the best share of each key's images, with weights exp(decay * error / largest error)."""
    w = Window.partitionBy(key)
    ranked = errors.select(key, "image_id", F.exp(decay * F.col("error") / F.greatest(F.max("error").over(w), F.lit(1e-12))).alias("w"), F.row_number().over(w.orderBy("error", "image_id")).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    chosen = ranked.filter(F.col("_r") <= F.ceil(best * F.col("_n"))).select("image_id", "w")
    return pixels.join(chosen, "image_id").groupBy(key, "y", "x").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
