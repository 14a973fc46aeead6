"""Scalar functions of columns: packing, missing values, geometry and physics. Missing is null throughout; NaN is never kept."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants.
G, MOLAR_MASS, GAS = 9.80665, 0.0289644, 8.31432
R_DRY, CP = GAS / MOLAR_MASS, 1004.0
EARTH_RADIUS = 6371000.0
T0 = 273.15
STANDARD_P, STANDARD_T = 1013.25, 288.15


def c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# --------------------------------------------------------------------------- packing and missing values


def missing(value: Column, fill: float | None = None) -> Column:
    """Null for NaN and for the fill value."""
    out = F.when(F.isnan(value), None).otherwise(value)
    return out if fill is None else F.nullif(out, F.lit(fill))


def filled(value: Column, fill: float) -> Column:
    return F.coalesce(value, F.lit(fill))


def unpack(value: Column, scale: float = 1.0, offset: float = 0.0, fill: float | None = None) -> Column:
    """Packed number -> physical value."""
    return missing(value.cast("double"), fill) * scale + offset


def pack(value: Column, scale: float = 1.0, offset: float = 0.0, fill: float | None = None, kind: str = "int") -> Column:
    """Physical value -> packed number, rounded half away from zero for whole-number kinds."""
    x = (value - offset) / scale
    x = x if kind in ("double", "float") else F.round(x, 0)
    return (x if fill is None else F.coalesce(x, F.lit(float(fill)))).cast(kind)


def rescale(value: Column, old: tuple[float, float, float], new: tuple[float, float, float]) -> Column:
    """From one (fill, scale, offset) to another."""
    (fill, scale, offset), (to_fill, to_scale, to_offset) = old, new
    return F.coalesce((F.nullif(value.cast("double"), F.lit(float(fill))) * scale + offset - to_offset) / to_scale, F.lit(float(to_fill)))


def to_precision(value: Column, step: float) -> Column:
    """The nearest multiple of a step."""
    return F.round(value / step, 0) * step


def clamp(value: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Within a valid range; null stays null (``greatest`` and ``least`` alone would pass it over)."""
    out = value
    if high is not None:
        out = F.least(out, c(high))
    if low is not None:
        out = F.greatest(out, c(low))
    return F.when(value.isNotNull(), out)


# --------------------------------------------------------------------------- geometry


def longitude180(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def central_angle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Angle between two points on a sphere, in radians; arguments in degrees."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.acos(clamp(F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d), -1.0, 1.0))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return central_angle(lon1, lat1, lon2, lat2) * EARTH_RADIUS


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial direction from the first point to the second, radians clockwise from north."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))


# --------------------------------------------------------------------------- vertical coordinates


def ln_pressure(p0: Column, level: Column) -> Column:
    return p0 * F.exp(-level)


def sigma_pressure(top: Column, sigma: Column, surface: Column) -> Column:
    return top + sigma * (surface - top)


def pressure_sigma(top: Column, pressure: Column, surface: Column) -> Column:
    return F.try_divide(pressure - top, surface - top)


def hybrid_pressure(ap: Column, b: Column, surface: Column) -> Column:
    return ap + b * surface


def hybrid_pressure_p0(a: Column, p0: Column, b: Column, surface: Column) -> Column:
    return a * p0 + b * surface


def hybrid_height(a: Column, b: Column, orography: Column) -> Column:
    return a + b * orography


def ocean_s_g1(s: Column, stretch: Column, depth: Column, critical: Column, surface: Column) -> Column:
    """Depth, positive downwards, of a terrain-following level of the first kind."""
    x = critical * s + (depth - critical) * stretch
    return -(x + surface * (1.0 + F.try_divide(x, depth)))


def ocean_s_g2(s: Column, stretch: Column, depth: Column, critical: Column, surface: Column) -> Column:
    """Depth, positive downwards, of a terrain-following level of the second kind."""
    x = F.try_divide(critical * s + depth * stretch, depth + critical)
    return -(surface + (surface + depth) * x)


def standard_altitude(pressure_hpa: Column) -> Column:
    """Altitude of a pressure in an isothermal standard atmosphere."""
    return F.when(pressure_hpa > 0, -F.ln(pressure_hpa / STANDARD_P) * (R_DRY * STANDARD_T / G))


def standard_pressure(altitude: Column) -> Column:
    return F.exp(-altitude * (G / (R_DRY * STANDARD_T))) * STANDARD_P


def virtual_temperature(specific_humidity: Column, temperature: Column) -> Column:
    return temperature * (1.0 + (1 / MOL_WEIGHT_RATIO - 1) * specific_humidity)


def layer_thickness(p_low: Column, p_high: Column, virtual: Column) -> Column:
    """Metres between two pressures, the lower level first."""
    ratio = F.try_divide(p_low, p_high)
    return F.when(ratio > 0, F.ln(ratio) * virtual * (R_DRY / G))


# --------------------------------------------------------------------------- temperature, humidity, wind


def theta_to_temperature(theta: Column, pressure_hpa: Column) -> Column:
    return theta * F.pow(pressure_hpa / 1000.0, F.lit(R_DRY / CP))


# Fixed values of the humidity formulas: pressures in Pa, temperatures in K, relative humidity in percent.
MOL_WEIGHT_RATIO = 0.622
SATURATION = (610.78, 17.269, 273.16, 35.86)
DEWPOINT = (17.625, 243.04)


def saturation_pressure(temperature: Column) -> Column:
    """Over water, in Pa."""
    at_zero, slope, zero, offset = SATURATION
    return at_zero * F.exp(F.try_divide(slope * (temperature - zero), temperature - offset))


def specific_to_relative(specific: Column, temperature: Column, pressure: Column) -> Column:
    """Relative humidity in percent, 0 to 100; pressure in Pa."""
    return clamp(F.try_divide(100.0 * specific * pressure, saturation_pressure(temperature) * MOL_WEIGHT_RATIO), 0.0, 100.0)


def relative_to_specific(relative: Column, temperature: Column, pressure: Column) -> Column:
    """Specific humidity, not below 0; relative humidity in percent, pressure in Pa."""
    return clamp(F.try_divide(relative * 0.01 * saturation_pressure(temperature) * MOL_WEIGHT_RATIO, pressure), 0.0)


def dewpoint_to_relative(dewpoint: Column, temperature: Column) -> Column:
    """Relative humidity in percent, 100 at most."""
    slope, offset = DEWPOINT
    part = lambda k: F.try_divide(slope * (k - T0), offset + (k - T0))
    return clamp(100.0 * F.exp(part(dewpoint) - part(temperature)), None, 100.0)


def omega_to_w(omega: Column, pressure: Column, temperature: Column) -> Column:
    """Vertical wind in m/s from Pa/s, Pa and K."""
    return F.try_divide(-omega * temperature * (R_DRY / G), pressure)


def rotate(u: Column, v: Column, angle: Column) -> tuple[Column, Column]:
    """A vector turned by an angle in radians."""
    return u * F.cos(angle) - v * F.sin(angle), u * F.sin(angle) + v * F.cos(angle)


def turn_direction(direction: Column, angle: Column) -> Column:
    """A direction in degrees, less an angle in radians, into [0, 360)."""
    return F.pmod(direction - F.degrees(angle), F.lit(360.0))


PI = math.pi
