"""How a line's profile changes along the slit and over time, detections that last, and regions as table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..sources.tables import written
from . import frames as frame_ops


def line_surface(frames: DataFrame, line: Column, shifts: list[float], wavelength: float = 0.0, dispersion: float = 1.0, by: tuple[str, ...] = ("image_id", "x")) -> DataFrame:
    """(image_id, x, shifts, wavelengths, values): for each column of each frame, the light at shifts from the line, read between rows.

    line is the line's row as a Column of x and of further columns of frames, such as coefficients of a fit of its own for each frame (see
    polynomial). A place outside of the frame has null. All shifts are sums of one aggregate by (image_id, x), which combine before the only shuffle.
    """
    own = frames.withColumn("_at", line)

    def near(s: float) -> Column:
        return 1 - F.abs(F.col("y") - F.col("_at") - s)

    total = [F.sum(F.when(near(s) > 0, near(s) * F.col("v"))) for s in shifts]
    weight = [F.sum(F.when(near(s) > 0, near(s))) for s in shifts]
    values = F.array(*(F.when(w > 0.999999, t) for t, w in zip(total, weight, strict=True)))
    axis = F.array(*(F.lit(float(s)) for s in shifts))
    waves = F.array(*(F.lit(float(wavelength + s * dispersion)) for s in shifts))
    return own.groupBy(*by).agg(values.alias("values")).select(*by, axis.alias("shifts"), waves.alias("wavelengths"), "values")


def polynomial(coefficients: str = "coefficients", x: str = "x") -> Column:
    """The value at x of a polynomial whose coefficients are an array column, the constant first."""
    return F.expr(f"aggregate(reverse({coefficients}), 0d, (a, c) -> a * {x} + c)")


def profile_evolution(surface: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """(image_id, shift, wavelength, v, n): the mean profile of each frame's columns from low to high, of a line_surface; n columns had a value."""
    inside = (F.col("x") >= low if low is not None else F.lit(True)) & (F.col("x") <= high if high is not None else F.lit(True))
    rows = surface.filter(inside).select("image_id", F.explode(F.arrays_zip("shifts", "wavelengths", "values")).alias("p"))
    return rows.groupBy("image_id", F.col("p.shifts").alias("shift"), F.col("p.wavelengths").alias("wavelength")).agg(F.avg("p.values").alias("v"), F.count("p.values").alias("n"))


def shells(surface: DataFrame, depth: float) -> DataFrame:
    """(shell, radius, y, x, v): an image for each distance from the line's centre, whose rows are the frames: both wings' mean, on a sphere that is the larger the nearer to the centre.

    The centre lies at radius 1 + depth and the outermost shift at radius 1, as light of the core comes from higher layers. A wing without a value leaves the other's.
    """
    rows = surface.select("image_id", "x", F.explode(F.arrays_zip("shifts", "values")).alias("p")).select(F.col("image_id").alias("y"), "x", F.abs("p.shifts").alias("shell"), F.col("p.values").alias("v"))
    furthest = F.expr("array_max(transform(shifts, s -> abs(s)))")
    most = surface.select(furthest.alias("_most")).limit(1)
    own = rows.groupBy("shell", "y", "x").agg(F.avg("v").alias("v")).join(F.broadcast(most))
    radius = 1 + depth * (1 - F.coalesce(F.col("shell") / F.nullif("_most", F.lit(0.0)), F.lit(0.0)))
    return own.select("shell", radius.alias("radius"), "y", "x", "v")


def outlying(frames: DataFrame, sigma: float = 3.0) -> DataFrame:
    """(image_id, y, x, v, score): pixels of each frame that stand out from their column, by more than sigma of the frame's own scatter.

    A column's level is its median; the scatter is 1.4826 times the median distance from it, of all columns of a frame. Frames without scatter have none.
    """
    level = frames.groupBy("image_id", "x").agg(F.median("v").alias("_m"))
    off = frames.join(level, ["image_id", "x"]).withColumn("_d", F.col("v") - F.col("_m"))
    scatter = off.groupBy("image_id").agg((1.4826 * F.median(F.abs("_d"))).alias("_s"))
    own = off.join(scatter, "image_id").filter((F.col("_s") > 0) & (F.abs("_d") > sigma * F.col("_s")))
    return own.select("image_id", "y", "x", "v", (F.col("_d") / F.col("_s")).alias("score"))


def linked(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links(a, b): the smallest node that is reachable, by label passes that are written and end when none changes."""
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a is not null and b is not null").distinct(), "links")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        low = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("_low"))
        near = labels.join(low, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("_was"), F.least("component", "_low").alias("component"))
        # The label of a label sees twice as far.
        ahead = labels.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        step = written(near.join(ahead, "component", "left").select("node", "_was", F.least("component", "_next").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.filter("component <> _was").isEmpty():
            return labels


def numbered(frames: DataFrame, by: str, span: int = 1 << 16) -> DataFrame:
    """(image_id, by, frame): the place of each image among those of its group, by image_id.

    Images are numbered within spans of image_id, so that a large group is dealt over tasks; what came before a span is a sum of one row a span.
    """
    ids = frames.select("image_id", by).distinct().withColumn("_span", F.floor(F.col("image_id") / span))
    before = Window.partitionBy(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.groupBy(by, "_span").count().select(F.col(by).alias("_by"), F.col("_span").alias("_of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = ids.withColumn("_n", F.row_number().over(Window.partitionBy(by, "_span").orderBy("image_id")))
    return own.join(counts, (F.col("_span") == F.col("_of")) & F.col(by).eqNullSafe(F.col("_by"))).select("image_id", by, (F.col("_before") + F.col("_n")).alias("frame"))


def tracks(frames: DataFrame, sigma: float = 3.0, least: int = 1, gap: int = 1, reach: int = 1, by: str | None = None) -> DataFrame:
    """(track, first, last, n_frames, n_pixels, peak, top, left, bottom, right): what stands out from its columns in frames that follow each other.

    Pixels of a frame that stand out (see outlying) and touch are a blob, of least pixels or more; blobs no more than gap frames apart whose
    boxes, widened by reach pixels, meet are one track, named by its first blob. Blobs meet by an equi-join on frames and cells of the
    slit, so no blob is compared with all others. image_id numbers the frames; with by, a column, the images of each of its values are frames
    of their own, in order of image_id, whatever other images have ids between theirs.
    """
    found = outlying(frames, sigma)
    flags = written(found.select("image_id", "y", "x", F.abs("score").alias("score")), "found")
    boxes = frame_ops.regions(flags).filter(F.col("n") >= least)
    named = F.format_string("%012d.%06d", "image_id", "region")
    boxes = boxes.withColumn("blob", named)
    placed = boxes.join(numbered(frames, by).withColumnRenamed(by, "_g"), "image_id") if by else boxes.withColumns({"_g": F.lit(0), "frame": F.col("image_id")})
    boxes = written(placed, "blobs")
    # Pixels that belong to no counted blob are in no box of their frame, or in one that they don't belong to; peaks are of a box.
    inside = flags.join(boxes.select("image_id", "blob", "top", "left", "bottom", "right"), "image_id").filter("y between top and bottom and x between left and right")
    peaks = inside.groupBy("blob").agg(F.max("score").alias("peak"))
    cell = 64
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    own = boxes.select("_g", "frame", "blob", "top", "left", "bottom", "right", cells(F.col("left"), F.col("right")).alias("_c"))
    other = boxes.select(F.col("_g").alias("_h"), F.explode(F.sequence(F.col("frame") - gap, F.col("frame") - 1)).alias("_f"), F.col("blob").alias("b"), F.col("top").alias("_t"), F.col("left").alias("_l"), F.col("bottom").alias("_b"), F.col("right").alias("_r"))
    other = other.withColumn("_d", cells(F.col("_l") - reach, F.col("_r") + reach))
    met = own.join(other, (F.col("frame") == F.col("_f")) & (F.col("_c") == F.col("_d")) & F.col("_g").eqNullSafe(F.col("_h"))).filter((F.col("_t") - reach <= F.col("bottom")) & (F.col("_b") + reach >= F.col("top")) & (F.col("_l") - reach <= F.col("right")) & (F.col("_r") + reach >= F.col("left")))
    labels = linked(met.select(F.col("blob").alias("a"), "b").distinct())
    all_ = boxes.join(labels.select(F.col("node").alias("blob"), "component"), "blob", "left").join(peaks, "blob", "left").withColumn("track", F.coalesce("component", "blob"))
    ends = (F.min("image_id").alias("first"), F.max("image_id").alias("last"), F.countDistinct("image_id").alias("n_frames"), F.sum("n").alias("n_pixels"), F.max("peak").alias("peak"))
    return all_.groupBy("track").agg(*ends, F.min("top").alias("top"), F.min("left").alias("left"), F.max("bottom").alias("bottom"), F.max("right").alias("right"))


@udtf(returnType=frame_ops.BOXES)
class ActiveRegions:
    """The regions of one image's pixels, which a partition of the table argument holds: image_id, y, x of those above a threshold."""

    def __init__(self):
        self.rows: list[tuple] = []

    def eval(self, row):
        self.rows.append((row["image_id"], row["y"], row["x"]))

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            found = frame_ops._components(pd.DataFrame(self.rows, columns=["image_id", "y", "x"]))
            yield from (tuple(int(v) for v in r) for r in found[["image_id", "region", "top", "left", "bottom", "right", "n"]].itertuples(index=False))


@udtf(returnType="step int, y int, x int, v double")
class Transition:
    """steps values between each value of a pixel and its next one, of a partition by pixel that is ordered by image."""

    def __init__(self):
        self.last = None

    def eval(self, row, steps: int):
        if self.last is not None and row["v"] is not None:
            for step in range(1, steps + 1):
                yield step, row["y"], row["x"], self.last + (row["v"] - self.last) * step / (steps + 1)
        self.last = row["v"]


def register(spark: SparkSession) -> None:
    """Makes the table functions callable from SQL.

        SELECT * FROM active_regions(TABLE(bright) PARTITION BY image_id)
        SELECT * FROM transition(TABLE(px) PARTITION BY (grp, y, x) ORDER BY (image_id), 3)
    """
    spark.udtf.register("active_regions", ActiveRegions)
    spark.udtf.register("transition", Transition)
