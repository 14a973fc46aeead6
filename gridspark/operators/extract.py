"""Subsets of a grid in long form: one row per cell, an integer column per dimension, value columns beside them.

Filters are plain predicates, so they reach the scan; a dimension is counted again from 0 after a subset. Axis tables
``(index, value)`` are small and their selected positions are worked out by Spark, never on the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import longitude180
from ..functions.specs import dotted
from ..functions.units import convert


def select_variables(df: DataFrame, names: Iterable[str], dims: Iterable[str], auxiliary: Iterable[str] = ()) -> DataFrame:
    """Keeps the dimensions, the named variables and auxiliary ones; names that don't exist are passed over."""
    wanted = [*dims, *dict.fromkeys([*names, *auxiliary])]
    return df.select(*(c for c in dict.fromkeys(wanted) if c in df.columns))


def remove_variables(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def reduce_dimension(df: DataFrame, dim: str, start: int, size: int) -> DataFrame:
    """``size`` positions from ``start`` on, counted from 0 again."""
    if start < 0 or size < 1:
        raise ValueError("start and size must name positions")
    return df.where(F.col(dim).between(start, start + size - 1)).withColumn(dim, F.col(dim) - start)


def reduce_dimension_start_end(df: DataFrame, dim: str, start: int, end: int, length: int) -> DataFrame:
    """Up to ``end``, which is included; an end of 0 or less counts from the back."""
    last = end if end > 0 else length - 1 + end
    if not 0 <= start <= last < length:
        raise ValueError(f"{start}..{last} is not in 0..{length - 1}")
    return reduce_dimension(df, dim, start, last - start + 1)


def pick_dimension(df: DataFrame, dim: str, positions: str | Iterable[int]) -> DataFrame:
    """The given positions (a dotted list or numbers), in order and once each, counted from 0 again."""
    picked = sorted({int(p) for p in (dotted(positions) if isinstance(positions, str) else positions)})
    if not picked:
        raise ValueError("no positions")
    if len(picked) == picked[-1] - picked[0] + 1:
        return reduce_dimension(df, dim, picked[0], len(picked))
    place = F.create_map(*(F.lit(x) for k, p in enumerate(picked) for x in (p, k)))
    return df.where(F.col(dim).isin(picked)).withColumn(dim, place[F.col(dim)])


def axis_of(df: DataFrame, dim: str, value: str) -> DataFrame:
    """The axis of a dimension: ``(dim, value)``."""
    return df.groupBy(dim).agg(F.first(value, ignorenulls=True).alias(value))


def _tolerance(axis: DataFrame, value: Column) -> DataFrame:
    """One percent of the first step, or 1e-5 for a single value."""
    first = axis.select(F.min_by(value, "_d").alias("_a")).crossJoin(axis.where("_d = 1").select(F.first(value).alias("_b")))
    return first.select(F.coalesce(F.abs(F.col("_b") - F.col("_a")) * 0.01, F.lit(1e-5)).alias("_tol"))


def reduce_axis(df: DataFrame, dim: str, value: str, low: float | None, high: float | None, unit: str = "", axis_unit: str = "", axis: DataFrame | None = None) -> DataFrame:
    """Positions whose axis value lies within limits, with a tolerance of one percent of the first step; ascending or descending.

    ``axis`` is the axis table ``(dim, value)``; with it the cells are read once and their partitions pruned by the selected
    positions. By default it is gathered from the cells.
    """
    axis = (axis_of(df, dim, value) if axis is None else axis).select(F.col(dim).alias("_d"), F.col(value).cast("double").alias("_v"))
    limits = [None if x is None else convert(F.lit(float(x)), unit, axis_unit) for x in (low, high)]
    axis = axis.crossJoin(F.broadcast(_tolerance(axis, F.col("_v"))))  # one row
    lo, hi = limits
    if lo is not None and hi is not None:
        lo, hi = F.least(lo, hi), F.greatest(lo, hi)
    keep = F.lit(True)
    if lo is not None:
        keep = keep & (F.col("_v") >= lo - F.col("_tol"))
    if hi is not None:
        keep = keep & (F.col("_v") <= hi + F.col("_tol"))
    kept = axis.where(keep).select("_d")
    kept = kept.crossJoin(F.broadcast(kept.agg(F.min("_d").alias("_first"))))  # one row
    return df.join(kept, F.col(dim) == F.col("_d")).withColumn(dim, F.col(dim) - F.col("_first")).drop("_d", "_first")


def reduce_time(df: DataFrame, time: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """Times within limits, which are included; an open end has no limit.

    Limits have the column's own kind of timestamp: a cast of the column would keep the filter from the scan.
    """
    kind = dict(df.dtypes)[time]
    limit = lambda v: F.expr(f"timestamp_ntz'{v.isoformat(sep=' ')}'") if kind == "timestamp_ntz" else F.lit(v)
    out = df
    if start is not None:
        out = out.where(F.col(time) >= limit(start))
    return out if end is None else out.where(F.col(time) <= limit(end))


def bounding_box(df: DataFrame, south: float, north: float, west: float, east: float, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat", points: DataFrame | None = None) -> DataFrame:
    """Rows and columns of the grid that have a point in the box; a west beyond the east goes over the date line.

    The result is a rectangle, so it can hold points outside the box. Row and column numbers are kept. ``points`` is the table
    ``(x, y, lon, lat)`` of the grid; with it the cells, which have one row for each time and level, are read once.
    """
    if not (-90 <= south <= north <= 90 and -180 <= west <= 180 and -180 <= east <= 180):
        raise ValueError("not a bounding box")
    at = longitude180(F.col(lon))
    across = (at >= west) & (at <= east) if west <= east else (at >= west) | (at <= east)
    inside = (df if points is None else points).where(F.col(lat).between(south, north) & across).select(x, y)
    return df.join(inside.select(x).distinct(), x, "left_semi").join(inside.select(y).distinct(), y, "left_semi")


def find_variables(attributes: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Names of variables whose attributes match all patterns; ``attributes(var, name, value)``."""
    test = F.lit(False)
    for name, pattern in patterns.items():
        test = test | ((F.col("name") == name) & F.col("value").rlike(f"^(?:{pattern})$"))
    return attributes.where(test).groupBy("var").agg(F.countDistinct("name").alias("n")).where(F.col("n") == len(patterns)).select("var")
