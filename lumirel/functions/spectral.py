"""Wavelengths, pixel shifts, and the solar ephemeris of a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIGHT_KM_S = 299792.458
#: Start and length, in days, of the numbered synodic rotations.
ROTATION_EPOCH, ROTATION_DAYS = 2398167.2763889, 27.2753


def round2(v: Column) -> Column:
    """Two decimals, halves upward."""
    return F.floor(v * 100 + 0.5).cast("double") / 100


def a2px(angstroms: Column, dispersion: Column | float) -> Column:
    return round2(angstroms / dispersion)


def px2a(shift: Column, dispersion: Column | float) -> Column:
    return round2(shift * dispersion)


def wavelength(line: Column | float, shift: Column, dispersion: Column | float) -> Column:
    return round2(line + shift * dispersion)


def find_shift(wave: Column, line: Column | float, dispersion: Column | float) -> Column:
    return round2((wave - line) / dispersion)


def doppler_speed(shift: Column, dispersion: Column | float, line: Column | float) -> Column:
    """Kilometres a second of a shift in pixels."""
    return shift * dispersion / line * LIGHT_KM_S


def julian_date(ts: Column) -> Column:
    """Days since noon, 1 January 4713 BC, of a UTC timestamp."""
    return F.unix_micros(ts.cast("timestamp")).cast("double") / 86400e6 + 2440587.5


def carrington_rotation(ts: Column) -> Column:
    return (F.floor((julian_date(ts) - ROTATION_EPOCH) / ROTATION_DAYS) + 1).cast("int")


def solar_angles(ts: Column) -> tuple[Column, Column]:
    """Position angle P and heliographic latitude B0 of the disk's centre, in degrees, by Meeus' low-accuracy series."""
    jd = julian_date(ts)
    t = (jd - 2451545.0) / 36525
    rad = F.radians
    anomaly = rad(357.52911 + 35999.05029 * t)
    true = 280.46646 + 36000.76983 * t + (1.914602 - 0.004817 * t) * F.sin(anomaly) + 0.019993 * F.sin(2 * anomaly)
    node = rad(73.6667 + 1.3958333 * (jd - 2396758) / 36525)
    tilt, obliquity = rad(F.lit(7.25)), rad(23.4392911 - 0.0130042 * t)
    lon = rad(true - 0.00569)
    x = F.atan(-F.cos(lon) * F.tan(obliquity))
    y = F.atan(-F.cos(lon - node) * F.tan(tilt))
    return F.degrees(x + y), F.degrees(F.asin(F.sin(lon - node) * F.sin(tilt)))


def ticks_to_timestamp(ticks: Column) -> Column:
    """A timestamp from ticks of 100 ns since the year 1; none where ticks aren't positive."""
    return F.when(ticks > 0, F.timestamp_micros((F.floor(ticks / 10) - 62135596800000000).cast("long")))
