"""Operators that iterate over a whole field: one numpy array per field, in a grouped Arrow-backed function.

A field (one time and level) is the unit of work and is bounded by the grid's size, not by the length of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.columns import EARTH_RADIUS

G, R = 9.80665, 8.31432 / 0.0289644


def by_field(df: DataFrame, value: str, kernel: Callable[[np.ndarray], np.ndarray], keys: Iterable[str], x: str = "x", y: str = "y") -> DataFrame:
    """``keys, y, x, value`` with ``kernel`` applied to each field as a dense array [y, x]; missing is NaN inside."""
    keys = list(keys)
    schema = T.StructType([*(df.schema[c] for c in [*keys, y, x]), T.StructField(value, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = pdf[y].to_numpy(), pdf[x].to_numpy()
        field = np.full((rows.max() + 1, cols.max() + 1), np.nan)
        field[rows, cols] = pdf[value].to_numpy(float, na_value=np.nan)
        out = pdf[[*keys, y, x]].copy()
        v = kernel(field)[rows, cols]
        out[value] = pd.Series(v, index=out.index, dtype="Float64").mask(np.isnan(v))
        return out

    return df.select(*keys, y, x, value).groupBy(*keys).applyInPandas(run, schema)


def _fronts(holes: np.ndarray) -> list[np.ndarray]:
    """The holes inside the border, as flat places, by the sum of row and column.

    A sweep in row order uses values of this sweep above and to the left, of the last one below and to the right. So does going
    through these fronts, each of which is a few array operations.
    """
    y, x = np.nonzero(holes[1:-1, 1:-1])
    at, front = (y + 1) * holes.shape[1] + x + 1, y + x
    order = np.argsort(front, kind="stable")
    return np.split(at[order], np.flatnonzero(np.diff(front[order])) + 1) if len(at) else []


def fill(field: np.ndarray, criterion: float = 0.01, relaxation: float = 1.6, rounds: int = 100) -> np.ndarray:
    """Missing values by a Laplace equation with the defined ones fixed and no flow over the border.

    Over-relaxation in row order, from the mean as a first guess; every tenth round ends it if no correction exceeds ``criterion`` times the
    defined values' mean deviation.
    """
    hole = np.isnan(field)
    if not hole.any() or hole.all():
        return field.copy()
    known = field[~hole]
    mean = known.mean()
    limit = criterion * np.abs(known - mean).mean() * relaxation
    out = np.where(hole, mean, field)
    flat, width, fronts = out.ravel(), field.shape[1], _fronts(hole)
    left, right, top, bottom = hole[1:-1, 0], hole[1:-1, -1], hole[0], hole[-1]
    for k in range(rounds):
        most = 0.0
        for at in fronts:
            step = relaxation * ((flat[at + 1] + flat[at - 1] + flat[at + width] + flat[at - width]) * 0.25 - flat[at])
            flat[at] += step
            most = max(most, np.abs(step).max())
        if k % 10 == 0 and k < rounds - 5 and most <= limit:
            break
        if width > 1:
            out[1:-1, 0] = np.where(left, out[1:-1, 1], out[1:-1, 0])
            out[1:-1, -1] = np.where(right, out[1:-1, -2], out[1:-1, -1])
        if len(out) > 1:
            out[0] = np.where(top, out[1], out[0])
            out[-1] = np.where(bottom, out[-2], out[-1])
    return out


def creep(field: np.ndarray, repeat: int = 20, weight: int = 2, default: float | None = None) -> np.ndarray:
    """Defined values grow into the holes until nothing is left to change.

    Holes start at the field's mean or at ``default``. Sweeps in row order give each hole inside the border that has a neighbour with a weight
    the mean of itself and its four neighbours; an original neighbour weighs ``weight``, one filled before 1, another nothing. A hole changes
    ``repeat`` times at most. The border follows its inner neighbours afterwards. A field without any defined value stays as it is.
    """
    hole = np.isnan(field)
    if not hole.any() or hole.all():
        return field.copy()
    out = np.where(hole, np.nanmean(field) if default is None else default, field)
    sure = np.where(hole, 0, weight).astype(float)
    flat, w, left, width = out.ravel(), sure.ravel(), np.full(field.size, repeat), field.shape[1]
    fronts, changed, rounds = _fronts(hole), True, 0
    while changed and rounds < (~hole).sum():
        changed, rounds = False, rounds + 1
        for at in fronts:
            total = w[at + 1] + w[at - 1] + w[at + width] + w[at - width]
            grown = (total > 0) & (left[at] > 0)
            at, total = at[grown], total[grown]
            if len(at):
                around = w[at + 1] * flat[at + 1] + w[at - 1] * flat[at - 1] + w[at + width] * flat[at + width] + w[at - width] * flat[at - width]
                flat[at] = (flat[at] + around) / (1 + total)
                w[at] = 1
                left[at] -= 1
                changed = True

    def follow(edge: tuple, inner: tuple) -> None:
        out[edge] = np.where(hole[edge], (out[edge] + out[inner] * sure[inner]) / (1 + sure[inner]), out[edge])
        sure[edge] = np.where(hole[edge], 1, sure[edge])

    for _ in range(repeat):
        if width > 1:
            follow((slice(1, -1), 0), (slice(1, -1), 1))
            follow((slice(1, -1), -1), (slice(1, -1), -2))
        if len(out) > 1:
            follow((0, slice(None)), (1, slice(None)))
            follow((-1, slice(None)), (-2, slice(None)))
    return out


def distances(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres [y, x] to the next column and to the next row; the last ones have those before them."""
    lo, la = np.radians(lon), np.radians(lat)

    def along(axis: int) -> np.ndarray:
        a, b = (np.take(f, range(f.shape[axis] - 1), axis) for f in (lo, la)), (np.take(f, range(1, f.shape[axis]), axis) for f in (lo, la))
        (lo0, la0), (lo1, la1) = a, b
        half = np.sin((la1 - la0) / 2) ** 2 + np.cos(la0) * np.cos(la1) * np.sin((lo1 - lo0) / 2) ** 2
        d = 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.clip(half, 0, 1)))
        return np.concatenate((d, np.take(d, [-1], axis)), axis)

    return along(1), along(0)


def vertical_velocity(u: np.ndarray, v: np.ndarray, t: np.ndarray, ap: np.ndarray, b: np.ndarray, ps: np.ndarray, zs: np.ndarray, step: tuple[float, float], dist_x: np.ndarray, dist_y: np.ndarray) -> np.ndarray:
    """Upward wind [z, y, x] on hybrid levels, from continuity and the hydrostatic equation; level 0 is the top and has none.

    ``ap`` (Pa) and ``b`` are the levels' coefficients, ``ps`` the surface pressure in Pa and ``zs`` the surface's height; ``step`` are the grid's
    steps in metres on the map and ``dist_x``, ``dist_y`` the distances on the ground to the next column and row.
    """
    levels = len(ap)
    # Half levels between the levels, from the ground up.
    half_a, half_b = np.zeros(levels + 1), np.zeros(levels + 1)
    half_b[levels] = 1.0
    for k in range(levels - 1, 0, -1):
        half_a[k], half_b[k] = 2 * ap[k] - half_a[k + 1], 2 * b[k] - half_b[k + 1]
    half = half_a[:, None, None] + half_b[:, None, None] * ps
    thick = np.diff(half, axis=0)
    log_ratio, share = np.zeros_like(thick), np.full_like(thick, np.log(2.0))
    log_ratio[1:] = np.log(half[2:] / half[1:-1])
    share[1:] = 1 - half[1:-1] * log_ratio[1:] / thick[1:]
    rt = R * t
    layers = rt * log_ratio
    geopotential = zs * G + np.cumsum(layers[::-1], axis=0)[::-1] - layers + rt * share
    scale_x, scale_y = dist_x / step[0], dist_y / step[1]
    along_x = lambda f: (f[:, 1:-1, 2:] - f[:, 1:-1, :-2]) / (2 * step[0])
    along_y = lambda f: (f[:, 2:, 1:-1] - f[:, :-2, 1:-1]) / (2 * step[1])
    core = (slice(None), slice(1, -1), slice(1, -1))
    divergence = (along_x(scale_y * u * thick) + along_y(scale_x * v * thick)) / (scale_x * scale_y)[core[1:]]
    divergence[0] = 0.0
    above = np.cumsum(divergence, axis=0) - divergence
    out = np.zeros_like(u)
    mass = rt[core] * (log_ratio[core] * above + share[core] * divergence) / thick[core]
    slope = along_x(geopotential) / scale_x[core[1:]] + along_y(geopotential) / scale_y[core[1:]]
    out[core] = (mass + slope) / G
    out[:, 0, 1:-1], out[:, -1, 1:-1] = out[:, 1, 1:-1], out[:, -2, 1:-1]
    out[:, :, 0], out[:, :, -1] = out[:, :, 1], out[:, :, -2]
    out[0] = 0.0
    return out
