"""Pointwise functions of a pixel value, as Column expressions that stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PEAK = 65535.0


def limit(v: Column, low: float = 0.0, high: float = PEAK) -> Column:
    return F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: by zero it is infinite, of zero by zero it is not a number."""
    zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def log(v: Column, base: float) -> Column:
    """Logarithm to a base; not a number below zero, minus infinity at zero."""
    return F.when(v > 0, F.log(v) / math.log(base)).when(v == 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))


def scale_to_unit(v: Column, clamp: bool = True) -> Column:
    return limit(v / PEAK, 0, 1) if clamp else v / PEAK


def scale_from_unit(v: Column, clamp: bool = True) -> Column:
    return limit(v * PEAK) if clamp else v * PEAK


def adjust_contrast(v: Column, low: int, high: int) -> Column:
    """Values below low become 0 and those above high become high; both are given in 8 bits."""
    return F.when(v < low * 256, F.lit(0.0)).when(v > high * 256, F.lit(high * 256.0)).otherwise(v)


def curve_transform(v: Column, at: float, to: float, protect_low: float = 0.0, protect_high: float = PEAK) -> Column:
    """A parabola through (0, 0), (at, to) and (PEAK, PEAK), between the protected ends."""
    a = (to - at) / (at * at - at * PEAK)
    b = 1 - a * PEAK
    return F.when((v > protect_low) & (v < protect_high), limit(a * v * v + b * v)).otherwise(v)


def mtf_unit(x: Column, midtones) -> Column:
    """Midtone transfer of a value in 0..1."""
    m = midtones if isinstance(midtones, Column) else F.lit(float(midtones))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise((m - 1) * x / ((2 * m - 1) * x - m))


def mtf(v: Column, shadows: float = 0, midtones: float = 1.0, highlights: float = 255) -> Column:
    """Midtone transfer between shadows and highlights, which are given in 8 bits."""
    low, high = shadows * 256.0, highlights * 256.0
    return PEAK * mtf_unit((v - low) / (high - low), midtones)


def sigmoid(v: Column, midpoint: float = 0.5, steepness: float = 10.0) -> Column:
    """A logistic curve that keeps 0 and PEAK in place."""

    def curve(x: float) -> float:
        return 1 / (1 + math.exp(-steepness * (x - midpoint)))

    low, high = curve(0), curve(1)
    return limit(PEAK * (1 / (1 + F.exp(-steepness * (v / PEAK - midpoint))) - low) / (high - low))


def asinh(v: Column, black: float, stretch: float) -> Column:
    """Inverse hyperbolic sine stretch above a black point."""
    return limit(PEAK * F.asinh(F.greatest(v - black, F.lit(0.0)) / PEAK * stretch) / math.asinh(stretch))


def within_disk(cx: float, cy: float, radius: float) -> Column:
    """Whether a pixel is in a disk: the conic of its border is not positive."""
    return F.pow(F.col("x") - cx, 2) + F.pow(F.col("y") - cy, 2) - radius * radius <= 0


def annulus(cx: float, cy: float, radius: float, low: float | None, high: float | None) -> Column:
    """A mask of pixels whose distance from the centre is within low and high, in radii."""
    r2 = (F.pow(F.col("x") - cx, 2) + F.pow(F.col("y") - cy, 2)) / (radius * radius)
    inner = r2 >= low * low if low is not None else F.lit(True)
    return inner & (r2 <= high * high) if high is not None else inner


def value_range(low: float | None, high: float | None) -> Column:
    v = F.col("v")
    inner = v >= low if low is not None else F.lit(True)
    return inner & (v <= high) if high is not None else inner


def on_circle(cx: float, cy: float, radius: float, thickness: float = 1.0) -> Column:
    return F.abs(F.hypot(F.col("x") - cx, F.col("y") - cy) - radius) <= thickness / 2


def on_rectangle(left: int, top: int, width: int, height: int, thickness: int = 1) -> Column:
    x, y = F.col("x"), F.col("y")
    outer = x.between(left, left + width - 1) & y.between(top, top + height - 1)
    inner = x.between(left + thickness, left + width - 1 - thickness) & y.between(top + thickness, top + height - 1 - thickness)
    return outer & ~inner


def on_segment(x1: float, y1: float, x2: float, y2: float, thickness: float = 1.0) -> Column:
    """Pixels within half the thickness of a line segment."""
    dx, dy = x2 - x1, y2 - y1
    t = limit(((F.col("x") - x1) * dx + (F.col("y") - y1) * dy) / max(1e-12, dx * dx + dy * dy), 0, 1)
    return F.hypot(F.col("x") - x1 - t * dx, F.col("y") - y1 - t * dy) <= thickness / 2
