"""Spectral lines on frames: borders of the lit columns, the line followed column by column, and a robust polynomial through it.

Frames are a pixel relation. A frame's columns become arrays once, in one shuffle by (image_id, x); minima,
centroids and depths are expressions on these arrays, and only points travel on. Fits are sums of powers, for all frames in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import frames as frame_ops

#: How far a line may step from one column to the next, and how far around a minimum its continuum is looked for.
STEP = 4
CONTINUUM_WINDOW = 16
#: The part of a line's depth that counts for its centre.
CENTRE_SHARE = 0.25
LEAST_POINTS = 8
LEAST_SIGMA = 0.01


def borders(frames: DataFrame, threshold: float | None = None, share: float = 0.05) -> DataFrame:
    """(image_id, left, right, sub_left, sub_right): the first and the last lit column of each frame, and where between columns the light crosses the threshold.

    Lit are columns whose mean is above threshold; without one, columns whose squared mean is above a share of the way
    from the frame's darkest to its brightest. A frame without lit columns has nulls; a border at a frame's edge is that column.
    """
    columns = frames.groupBy("image_id", "x").agg(F.avg("v").alias("_m"))
    if threshold is None:
        columns = columns.withColumn("_m", F.col("_m") * F.col("_m"))
        ends = columns.groupBy("image_id").agg(F.min("_m").alias("_low"), F.max("_m").alias("_high"))
        columns = columns.join(ends, "image_id").withColumn("_m", (F.col("_m") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)))
    level = share if threshold is None else threshold
    w = Window.partitionBy("image_id").orderBy("x")
    near = columns.select("image_id", "x", "_m", F.lag(F.struct("x", "_m")).over(w).alias("_before"), F.lead(F.struct("x", "_m")).over(w).alias("_behind"))
    lit = F.col("_m") > level

    def crossing(side: str) -> Column:
        at = F.col(f"{side}.x") + (level - F.col(f"{side}._m")) * (F.col("x") - F.col(f"{side}.x")) / F.nullif(F.col("_m") - F.col(f"{side}._m"), F.lit(0.0))
        return F.coalesce(at, F.col("x").cast("double"))

    left = F.min(F.when(lit, F.struct("x", crossing("_before").alias("at")))).alias("l")
    right = F.max(F.when(lit, F.struct("x", crossing("_behind").alias("at")))).alias("r")
    found = near.groupBy("image_id").agg(left, right)
    return found.select("image_id", F.col("l.x").alias("left"), F.col("r.x").alias("right"), F.col("l.at").alias("sub_left"), F.col("r.at").alias("sub_right"))


def _columns(frames: DataFrame) -> DataFrame:
    """(image_id, x, col, minima): each column's values from the top, and its local minima as (y, v)."""
    cells = F.sort_array(F.collect_list(F.struct("y", "v"))).alias("_c")
    own = frames.groupBy("image_id", "x").agg(cells).select("image_id", "x", F.col("_c.v").alias("col"))
    inner = F.expr("filter(sequence(1, size(col) - 2), i -> col[i] < col[i - 1] and col[i] <= col[i + 1])")
    minima = F.when(F.size("col") > 2, F.transform(inner, lambda i: F.struct(i.alias("y"), F.get("col", i).alias("v")))).otherwise(F.expr("array()"))
    return own.withColumn("minima", minima)


def _followed(start: str, side: str, step: int) -> str:
    """SQL of the points that follow from row `start`, in the order of the columns `side`: of each column the minimum nearest to the last point, if it is near."""
    near = f"array_min(transform(filter(c.minima, m -> abs(m.y - a.at) <= {step}), m -> struct(abs(m.y - a.at) as d, m.v as v, m.y as y)))"
    return f"""aggregate({side}, struct(cast({start} as int) as at, cast(array() as array<struct<x: int, y: int, v: double>>) as points),
      (a, c) -> named_struct('at', coalesce({near}.y, a.at), 'points',
        if({near}.y is null, a.points, array_append(a.points, struct(c.x as x, cast({near}.y as int) as y, cast({near}.v as double) as v))))).points"""


def line_points(frames: DataFrame, limits: DataFrame, around: DataFrame | None = None, step: int = STEP) -> DataFrame:
    """(image_id, x, y, depth): the line of each frame between its borders (see borders), its centre in each column and its depth there.

    The line is followed to both sides from the column in the middle: from its darkest minimum and from its second
    darkest, whichever leads along darker pixels; or, with around(image_id, y), from the minimum nearest to
    that row. A column without a minimum within step rows of the last point has no point. The centre is that of the darkness of the
    pixels on end that are less than a quarter of the depth above the minimum, or of a parabola where these are fewer than three; depth counts from the brightest pixel within
    CONTINUUM_WINDOW rows, and columns without depth are left out.
    """
    columns = written(_columns(frames), "columns")
    within = columns.join(limits.select("image_id", "left", "right"), "image_id").filter((F.col("x") >= F.coalesce("left", F.lit(0))) & F.coalesce(F.col("x") <= F.col("right"), F.lit(True)))
    rows = within.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), "minima"))).alias("cols"))
    rows = rows.withColumn("mid", F.expr("(cols[0].x + cols[size(cols) - 1].x + 1) div 2"))
    middle = F.expr("coalesce(filter(cols, c -> c.x = mid)[0].minima, array())")
    if around is None:
        seeds = F.slice(F.array_sort(F.transform(middle, lambda m: F.struct(m["v"].alias("v"), m["y"].alias("y")))), 1, 2)
    else:
        rows = rows.join(around.select("image_id", F.col("y").alias("_near")), "image_id")
        seeds = F.slice(F.array_sort(F.transform(middle, lambda m: F.struct(F.abs(m["y"] - F.col("_near")).alias("d"), m["v"].alias("v"), m["y"].alias("y")))), 1, 1)
    rows = rows.withColumn("seed", F.explode(seeds))
    own = "array(struct(mid as x, cast(seed.y as int) as y, cast(seed.v as double) as v))"
    left, right = _followed("seed.y", "reverse(filter(cols, c -> c.x < mid))", step), _followed("seed.y", "filter(cols, c -> c.x > mid)", step)
    paths = rows.select("image_id", "seed", F.expr(f"concat({own}, {left}, {right})").alias("points"))
    mean = F.expr("aggregate(points, 0d, (a, p) -> a + p.v) / size(points)")
    best = paths.groupBy("image_id").agg(F.min(F.struct(mean.alias("mean"), F.col("seed.y").alias("y"), "points"))["points"].alias("points"))
    points = best.select("image_id", F.explode("points").alias("p")).select("image_id", "p.x", "p.y", "p.v")
    near = points.join(columns.select("image_id", F.col("x").cast("int").alias("x"), "col"), ["image_id", "x"])
    near = near.withColumn("lo", F.greatest(F.col("y") - CONTINUUM_WINDOW, F.lit(0))).withColumn("hi", F.least(F.col("y") + CONTINUUM_WINDOW, F.size("col") - 1))
    near = near.withColumn("depth", F.array_max(F.expr("slice(col, lo + 1, hi - lo + 1)")) - F.col("v")).filter("depth > 0").withColumn("top", F.col("v") + CENTRE_SHARE * F.col("depth"))
    near = near.withColumn("first", F.expr("coalesce(array_max(filter(sequence(lo, y), i -> col[i] > top)), lo - 1) + 1"))
    near = near.withColumn("last", F.expr("coalesce(array_min(filter(sequence(y, hi), i -> col[i] > top)), hi + 1) - 1"))
    weight = F.expr("aggregate(sequence(first, last), 0d, (a, i) -> a + (top - col[i]))")
    moment = F.expr("aggregate(sequence(first, last), 0d, (a, i) -> a + (top - col[i]) * i)")
    # A narrower line has the place of the lowest point of a parabola through three pixels.
    bend = F.expr("get(col, y - 1) - 2 * v + get(col, y + 1)")
    lowest = F.col("y") + F.coalesce(0.5 * F.expr("get(col, y - 1) - get(col, y + 1)") / F.nullif(bend, F.lit(0.0)), F.lit(0.0))
    centre = F.when((F.col("last") - F.col("first") >= 2) & (weight > 0), moment / weight).otherwise(lowest)
    return near.select("image_id", "x", centre.alias("y"), "depth")


def robust_fit(points: DataFrame, order: int = 2, key: str = "image_id", weight: str | None = None, kappa: float = 3.0, rounds: int = 3, least: int = LEAST_POINTS, spread: str = "median") -> DataFrame:
    """(key, coefficients, n, n_rejected, sigma): least-squares polynomial of each key's points(key, x, y), constant first, without outliers.

    A round fits all keys' polynomials by sums of powers and takes away the points that are more than kappa sigma from
    the middle of the residuals: their median and 1.4826 times the median distance from it, or with spread="moments"
    their mean and deviation, which need no more than sums of a key of any size. A key is done when none of its points goes, its sigma is below
    LEAST_SIGMA, or fewer than least points would stay; rounds end when all keys are done, or after so many. sigma is
    that of the last round. Points with a null or a weight that isn't positive count for nothing; keys with too few different x have null coefficients.
    """
    own = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    kept = own.filter("x is not null and y is not null and w > 0").withColumn("open", F.lit(True))
    kept = written(kept, "points")
    state = None
    for _ in range(rounds):
        fit = frame_ops.polynomial_fit(kept, order, key, weight="w")
        value = F.expr("aggregate(reverse(coefficients), 0d, (a, c) -> a * x + c)")
        off = kept.join(fit, key).withColumn("r", F.col("y") - value)
        if spread == "median":
            off = off.join(off.groupBy(key).agg(F.median("r").alias("m")), key)
            off = off.join(off.groupBy(key).agg((1.4826 * F.median(F.abs(F.col("r") - F.col("m")))).alias("s")), key)
        else:
            off = off.join(off.groupBy(key).agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s")), key)
        far = F.coalesce(F.abs(F.col("r") - F.col("m")) > kappa * F.col("s"), F.lit(False)) & (F.col("s") >= LEAST_SIGMA)
        off = written(off.select(key, "x", "y", "w", "s", far.alias("far")), "points")
        tally = off.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("far").cast("long")).alias("gone"), F.first("s").alias("s"))
        tally = written(tally.select(key, "s", ((F.col("gone") > 0) & (F.col("n") - F.col("gone") >= least)).alias("goes")), "points")
        kept = off.join(tally.select(key, "goes"), key).filter("not (far and goes)").select(key, "x", "y", "w")
        state = tally
        if tally.filter("goes").isEmpty():
            break
        kept = written(kept, "points")
    fit = frame_ops.polynomial_fit(kept, order, key, weight="w").join(kept.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)
    total = own.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    out = total.join(fit, key, "left")
    out = out.join(state.select(key, F.col("s").alias("sigma")), key, "left") if state is not None else out.withColumn("sigma", F.lit(None).cast("double"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return out.select(key, "coefficients", n.alias("n"), (F.col("_all") - n).alias("n_rejected"), "sigma")


def analyzed(frames: DataFrame, threshold: float | None = None, around: DataFrame | None = None, kappa: float = 3.0, rounds: int = 3) -> DataFrame:
    """(image_id, left, right, coefficients, n, n_rejected, sigma): borders of each frame and the parabola of its line, weighted by the line's depth."""
    limits = written(borders(frames, threshold), "borders")
    fit = robust_fit(line_points(frames, limits, around), weight="depth", kappa=kappa, rounds=rounds)
    return limits.select("image_id", "left", "right").join(fit, "image_id", "left")


def straightened(frames: DataFrame, fits: DataFrame, window: int) -> DataFrame:
    """(image_id, y, v): mean profile across the line, y rows away from it, within window rows: each column is read between pixels around the fitted line.

    Columns that a window leaves the frame in count only where they have pixels on both sides of the place.
    """
    line = F.expr("aggregate(reverse(coefficients), 0d, (a, c) -> a * x + c)")
    inside = F.col("x").between(F.coalesce("left", F.lit(0)), F.coalesce("right", F.lit(2**31 - 1)))
    own = frames.join(fits.select("image_id", "left", "right", "coefficients"), "image_id").filter(inside).withColumn("_at", line)
    # A pixel serves the place below it and the place above it on the shifted grid.
    low = F.ceil(F.col("y") - F.col("_at")) - 1
    taps = F.array(*(F.struct((low + d).cast("int").alias("y"), (1 - F.abs(F.col("y") - F.col("_at") - (low + d))).alias("w")) for d in (0, 1)))
    dealt = own.select("image_id", "x", "v", F.explode(taps).alias("t")).filter((F.col("t.w") > 0) & (F.abs("t.y") <= window))
    places = dealt.groupBy("image_id", "x", F.col("t.y").alias("y")).agg(F.sum(F.col("t.w") * F.col("v")).alias("v"), F.sum("t.w").alias("w")).filter("w > 0.999999")
    return places.groupBy("image_id", "y").agg(F.avg("v").alias("v"))


def realigned(frames: DataFrame, fits: DataFrame, reference: DataFrame, window: int, reach: int, least: float = 1.0) -> DataFrame:
    """fits with those frames fitted anew whose line isn't the one that the reference profile (y, v) is centred on.

    The straightened profile of each frame is held against the reference at up to reach rows to both sides; if it agrees best least rows away
    or more, the line is followed again from there. Frames without a profile, and those that the new place lies outside of, keep their fit.
    """
    # Read several times below; a plan that holds them each time would be many times as large.
    fits = written(fits, "fits")
    found = frame_ops.locate(straightened(frames, fits, window + reach), reference, list(range(-reach, reach + 1)))
    middle = F.expr("(coalesce(left, 0) + coalesce(right, 0)) / 2")
    line = F.expr("aggregate(reverse(coefficients), 0d, (a, c) -> a * _mid + c)")
    seeds = fits.withColumn("_mid", middle).withColumn("_at", line).join(found.filter(F.abs("offset") >= least), "image_id")
    height = frames.groupBy("image_id").agg(F.max("y").alias("_top"))
    seeds = written(seeds.join(height, "image_id").select("image_id", (F.col("_at") + F.col("offset")).alias("y"), "_top").filter("y >= 0 and y <= _top").select("image_id", "y"), "seeds")
    own = frames.join(seeds.select("image_id"), "image_id", "left_semi")
    limits = fits.select("image_id", "left", "right").join(seeds.select("image_id"), "image_id", "left_semi")
    anew = robust_fit(line_points(own, limits, seeds), weight="depth")
    names = ("coefficients", "n", "n_rejected", "sigma")
    anew = anew.filter("coefficients is not null").select("image_id", F.struct(*names).alias("_new"))
    out = fits.join(anew, "image_id", "left")
    return out.select("image_id", "left", "right", *(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in names), F.col("_new").isNotNull().alias("realigned"))
