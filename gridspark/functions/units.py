"""Unit conversion: linear maps between units or compounds of one dimension, times since an epoch, and logarithms of a quantity."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .specs import time_unit

# Dimension, factor and offset of each unit: base = factor * x + offset.
UNITS: dict[str, tuple[str, float, float]] = {
    "1": ("", 1, 0), "%": ("", 0.01, 0), "percent": ("", 0.01, 0),
    "m": ("length", 1, 0), "meter": ("length", 1, 0), "metre": ("length", 1, 0), "km": ("length", 1000, 0), "cm": ("length", 0.01, 0), "mm": ("length", 0.001, 0), "ft": ("length", 0.3048, 0),
    "Pa": ("pressure", 1, 0), "hPa": ("pressure", 100, 0), "kPa": ("pressure", 1000, 0), "mbar": ("pressure", 100, 0), "millibar": ("pressure", 100, 0), "bar": ("pressure", 1e5, 0), "atm": ("pressure", 101325, 0),
    "K": ("temperature", 1, 0), "kelvin": ("temperature", 1, 0), "degC": ("temperature", 1, 273.15), "celsius": ("temperature", 1, 273.15), "degree_celsius": ("temperature", 1, 273.15), "degF": ("temperature", 5 / 9, 273.15 - 160 / 9),
    "s": ("time", 1, 0), "min": ("time", 60, 0), "h": ("time", 3600, 0), "day": ("time", 86400, 0),
    "m/s": ("speed", 1, 0), "m s-1": ("speed", 1, 0), "km/h": ("speed", 1 / 3.6, 0), "kt": ("speed", 1852 / 3600, 0), "knot": ("speed", 1852 / 3600, 0),
    "rad": ("angle", 1, 0), "radian": ("angle", 1, 0), "degree": ("angle", math.pi / 180, 0), "degrees": ("angle", math.pi / 180, 0), "degree_east": ("angle", math.pi / 180, 0), "degrees_east": ("angle", math.pi / 180, 0), "degree_north": ("angle", math.pi / 180, 0), "degrees_north": ("angle", math.pi / 180, 0),
    "kg": ("mass", 1, 0), "g": ("mass", 0.001, 0), "kg m-2": ("area density", 1, 0), "kg/m2": ("area density", 1, 0), "Pa/s": ("pressure change", 1, 0), "hPa/s": ("pressure change", 100, 0), "m2/s2": ("energy by mass", 1, 0), "J/kg": ("energy by mass", 1, 0),
}
LOG = re.compile(r"\s*(ln|log|lg)\s*\(\s*re\s*:?\s*([0-9.eE+-]*)\s*(.+?)\s*\)\s*$")
BASES = {"ln": math.e, "log": 10.0, "lg": 10.0}


# Symbol, factor to base units and powers of m, kg, s, K, A, mol, cd, rad of units in compounds; and decimal prefixes.
PARTS = {
    "m": (1, (1, 0, 0, 0, 0, 0, 0, 0)), "g": (1e-3, (0, 1, 0, 0, 0, 0, 0, 0)), "s": (1, (0, 0, 1, 0, 0, 0, 0, 0)), "K": (1, (0, 0, 0, 1, 0, 0, 0, 0)),
    "A": (1, (0, 0, 0, 0, 1, 0, 0, 0)), "mol": (1, (0, 0, 0, 0, 0, 1, 0, 0)), "cd": (1, (0, 0, 0, 0, 0, 0, 1, 0)), "rad": (1, (0, 0, 0, 0, 0, 0, 0, 1)),
    "N": (1, (1, 1, -2, 0, 0, 0, 0, 0)), "Pa": (1, (-1, 1, -2, 0, 0, 0, 0, 0)), "J": (1, (2, 1, -2, 0, 0, 0, 0, 0)), "W": (1, (2, 1, -3, 0, 0, 0, 0, 0)),
    "Hz": (1, (0, 0, -1, 0, 0, 0, 0, 0)), "C": (1, (0, 0, 1, 0, 1, 0, 0, 0)), "V": (1, (2, 1, -3, 0, -1, 0, 0, 0)), "L": (1e-3, (3, 0, 0, 0, 0, 0, 0, 0)), "l": (1e-3, (3, 0, 0, 0, 0, 0, 0, 0)),
}
PREFIXES = {"": 1.0, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12}
#: Powers of units in the table that compounds may hold too, by their dimension there.
POWERS = {"": (0, 0, 0, 0, 0, 0, 0, 0), "length": (1, 0, 0, 0, 0, 0, 0, 0), "pressure": (-1, 1, -2, 0, 0, 0, 0, 0), "temperature": (0, 0, 0, 1, 0, 0, 0, 0), "time": (0, 0, 1, 0, 0, 0, 0, 0), "speed": (1, 0, -1, 0, 0, 0, 0, 0), "angle": (0, 0, 0, 0, 0, 0, 0, 1), "mass": (0, 1, 0, 0, 0, 0, 0, 0), "area density": (-2, 1, 0, 0, 0, 0, 0, 0), "pressure change": (-1, 1, -3, 0, 0, 0, 0, 0), "energy by mass": (2, 0, -2, 0, 0, 0, 0, 0)}
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
DIVIDED = re.compile(r"\s*(?:/|per\b)\s*")
SYMBOL = re.compile(r"([A-Za-z%_]+)(?:(?:\^|\*\*)?([+-]?\d+))?")


def _part(symbol: str) -> tuple[float, tuple[int, ...]] | None:
    if symbol in UNITS:
        kind, factor, _ = UNITS[symbol]  # in a compound a difference of temperatures is meant
        return factor, POWERS[kind]
    for prefix, scale in PREFIXES.items():
        if symbol.startswith(prefix) and symbol[len(prefix) :] in PARTS:
            factor, powers = PARTS[symbol[len(prefix) :]]
            return scale * factor, powers
    return None


def _known(unit: str) -> tuple[tuple[int, ...], float, float]:
    """Powers of the base units, factor and offset: one unit of the table, or a compound of numbers and powers of units.

    Factors are joined by spaces, ``.`` or ``*``; what follows ``/`` or the word ``per`` divides, one factor only. There are no brackets.
    """
    text = unit.strip() or "1"
    if text in UNITS:
        kind, factor, offset = UNITS[text]
        return POWERS[kind], factor, offset
    factor, powers, at, sign = 1.0, [0] * 8, 0, 1
    while at < len(text):
        if m := DIVIDED.match(text, at):
            if sign < 0:
                raise ValueError(f"unknown unit {unit!r}")
            sign, at = -1, m.end()
        elif m := NUMBER.match(text, at):
            value = float(m[0])
            if not value:
                raise ValueError(f"unknown unit {unit!r}")
            factor, sign, at = factor * value**sign, 1, m.end()
        elif (m := SYMBOL.match(text, at)) and (part := _part(m[1])):
            n = sign * int(m[2] or 1)
            factor, sign, at = factor * part[0] ** n, 1, m.end()
            powers = [a + n * b for a, b in zip(powers, part[1], strict=True)]
        elif at and text[at] in " .*" and sign > 0:
            at += 1
        else:
            raise ValueError(f"unknown unit {unit!r}")
    if sign < 0:
        raise ValueError(f"unknown unit {unit!r}")
    return tuple(powers), factor, 0.0


def is_time(unit: str) -> bool:
    """Whether a unit counts from an epoch."""
    try:
        time_unit(unit)
    except ValueError:
        return False
    return True


def linear(source: str, target: str) -> tuple[float, float]:
    """Slope and offset from one unit to another; ValueError if they aren't convertible."""
    if is_time(source) and is_time(target):
        (a, e), (b, f) = time_unit(source), time_unit(target)
        return a / b, (e - f).total_seconds() / b
    (d, a, p), (e, b, q) = _known(source), _known(target)
    if d != e:
        raise ValueError(f"{source!r} can't be converted to {target!r}")
    return a / b, (p - q) / b


def convertible(source: str, target: str) -> bool:
    try:
        convert(F.lit(0.0), source, target) if LOG.match(source) or LOG.match(target) else linear(source, target)
    except ValueError:
        return False
    return True


def convert(value: Column, source: str, target: str) -> Column:
    """A column in another unit. An empty unit on either side means no conversion; logarithms of numbers that aren't positive are null."""
    if not source.strip() or not target.strip() or source == target:
        return value
    if m := LOG.match(source):
        return convert(F.pow(F.lit(BASES[m[1]]), value) * float(m[2] or 1), m[3], target)
    if m := LOG.match(target):
        x = convert(value, source, m[3]) / float(m[2] or 1)
        return F.when(x > 0, F.ln(x) / math.log(BASES[m[1]]))
    slope, offset = linear(source, target)
    out = value if slope == 1 else value * slope
    return out + offset if offset else out
