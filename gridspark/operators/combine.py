"""Datasets put together: joined along a dimension, stacked, united, nested, and updated."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import convert


def join_existing(parts: Sequence[DataFrame], t: str, lengths: Sequence[int] | None = None) -> DataFrame:
    """Datasets end to end along ``t``, in their order; a variable that one lacks is missing there.

    ``lengths`` are the datasets' lengths along ``t``; unknown ones are counted (one small aggregate per dataset).
    """
    if not parts:
        raise ValueError("nothing to join")
    if lengths is None:
        lengths = [(p.agg(F.max(t)).first()[0] if k < len(parts) - 1 else -1) for k, p in enumerate(parts)]
        lengths = [0 if n is None else n + 1 for n in lengths]
    offset, moved = 0, []
    for p, n in zip(parts, lengths, strict=True):
        moved.append(p.withColumn(t, F.col(t) + offset))
        offset += n
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), moved)


def join_new(parts: Sequence[DataFrame], name: str, variables: Iterable[str], dims: Iterable[str], coordinates: Sequence | None = None) -> DataFrame:
    """Datasets stacked along a new outer dimension; its coordinate is numeric if all given are, else text."""
    given = list(coordinates) if coordinates is not None else [f"location_{k}" for k in range(len(parts))]
    if len(given) != len(parts):
        raise ValueError("a coordinate for each dataset is needed")
    try:
        given = [float(v) for v in given]
    except (TypeError, ValueError):
        given = [str(v) for v in given]
    keep = [*dims, *variables]
    each = [p.select(*(c for c in keep if c in p.columns)).withColumns({name: F.lit(k), f"{name}_value": F.lit(v)}) for k, (p, v) in enumerate(zip(parts, given, strict=True))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


def union(parts: Sequence[DataFrame], dims: Iterable[str]) -> DataFrame:
    """All variables of all datasets on the same dimensions; of one that several have, the first's."""
    dims = list(dims)
    out = parts[0]
    for p in parts[1:]:
        new = [c for c in p.columns if c not in out.columns]
        if new:
            out = out.join(p.select(*dims, *new), dims, "full_outer")
    return out


def overlay(base: DataFrame, top: DataFrame, dims: Iterable[str], values: Iterable[str], base_unit: str = "", top_unit: str = "") -> DataFrame:
    """Top where it has a value, base elsewhere, in the top's unit."""
    dims, values = list(dims), list(values)
    over = top.select(*dims, *(F.col(v).alias(f"_top_{v}") for v in values))
    out = base.join(over, dims, "left")
    return out.withColumns({v: F.coalesce(F.col(f"_top_{v}"), convert(F.col(v), base_unit, top_unit)) for v in values}).drop(*(f"_top_{v}" for v in values))


def smoothing_weight(x: Column, y: Column, width: int, height: int, transition: int, border: int) -> Column:
    """Share of the inner grid in its cells: 0 in the border, 1 in the core, linear between; distances to a corner of the core are Euclidean."""
    edge = border + transition
    out = lambda i, n: F.greatest(F.lit(edge) - i, i - (n - 1 - edge), F.lit(0))
    away = F.hypot(out(x, width).cast("double"), out(y, height).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - away / max(transition, 1)))


def merge_smooth(inner: DataFrame, outer: DataFrame, dims: Iterable[str], value: str, width: int, height: int, transition: int = 5, border: int = 2, outer_if_missing: bool = True, x: str = "x", y: str = "y") -> DataFrame:
    """Values on the inner grid with smoothed borders; ``outer`` is on the same grid. A missing inner value has the outer one, if wished."""
    other = outer.select(*dims, F.col(value).alias("_outer"))
    both = inner.join(other, list(dims), "left")
    a, i, o = smoothing_weight(F.col(x), F.col(y), width, height, transition, border), F.col(value), F.col("_outer")
    mixed = F.when(o.isNull(), i).when(i.isNull(), o if outer_if_missing else None).otherwise(a * i + (1.0 - a) * o)
    return both.withColumn(value, mixed).drop("_outer")


def merged_axis(inner: Sequence[float], outer: Sequence[float]) -> list[float]:
    """The inner axis, which must have one step, extended by that step over the outer's extent."""
    step = inner[1] - inner[0]
    if any(abs(b - a - step) > 1e-4 * abs(step) for a, b in zip(inner, inner[1:], strict=False)):
        raise ValueError("the inner axis has no constant step")
    lo, hi = min(outer), max(outer)
    if min(inner) < lo or max(inner) > hi:
        raise ValueError("the inner axis leaves the outer")
    s = abs(step)
    down, up = int((min(inner) - lo) / s + 1e-9), int((hi - max(inner)) / s + 1e-9)
    out = [min(inner) + k * s for k in range(-down, len(inner) + up)]
    return out if step > 0 else out[::-1]


def upsert(target: DataFrame, source: DataFrame, coordinates: Iterable[str], values: Iterable[str], fixed: Iterable[str] = ()) -> DataFrame:
    """Source slices written into the target by matching coordinate values; new values of other than ``fixed`` dimensions are added."""
    coordinates, values = list(coordinates), list(values)
    src = source.select(*coordinates, F.lit(True).alias("_new"), *(F.col(v).alias(f"_new_{v}") for v in values))
    for dim in fixed:  # a short axis: only source cells that the target's axis has
        src = src.join(target.select(dim).distinct(), dim, "left_semi")
    out = target.select(*coordinates, *values).join(src, coordinates, "full_outer")
    return out.select(*coordinates, *(F.when(F.col("_new"), F.col(f"_new_{v}")).otherwise(F.col(v)).alias(v) for v in values))
