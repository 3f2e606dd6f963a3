"""Colour: planes, luminance, and hue-saturation-lightness as Column expressions over r, g, b in 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PEAK = 65535.0


def mono(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    grey = d == 0
    safe = F.when(grey, F.lit(1.0)).otherwise(d)
    sat = F.when(grey, F.lit(0.0)).otherwise(safe / F.when(light > 0.5, F.greatest(2 - top - low, F.lit(1e-12))).otherwise(F.greatest(top + low, F.lit(1e-12))))
    hue = F.when(grey, F.lit(0.0)).when(top == r, (g - b) / safe + F.when(g < b, 6.0).otherwise(0.0)).when(top == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4) / 6
    return hue, sat, light


def from_hsl(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    q = F.when(light < 0.5, light * (1 + s)).otherwise(light + s - light * s)
    p = 2 * light - q

    def channel(shift: float) -> Column:
        t = F.pmod(h + shift, F.lit(1.0))
        return F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)

    return channel(1 / 3), channel(0.0), channel(-1 / 3)


def saturate(r: Column, g: Column, b: Column, factor: float) -> tuple[Column, Column, Column]:
    """Saturation to the power 2 to the -factor."""
    h, s, light = to_hsl(r, g, b)
    return from_hsl(h, F.pow(s, F.lit(2.0**-factor)), light)


def colorize(v: Column, r: tuple[float, float], g: tuple[float, float], b: tuple[float, float]) -> tuple[Column, ...]:
    """A mono value as colour: each channel a parabola through (in, out), given in 8 bits."""

    def curve(at: float, to: float) -> Column:
        at, to = at * 256.0, to * 256.0
        a = (to - at) / (at * at - at * PEAK)
        return F.least(F.greatest(a * v * v + (1 - a * PEAK) * v, F.lit(0.0)), F.lit(PEAK))

    return curve(*r), curve(*g), curve(*b)
