"""Vertical and time interpolation.

Each cell's levels are gathered once into a sorted column, an array as long as there are levels, whatever the number of targets; a
target's brackets are then the levels around it in that array: the nearest at or below it and the next above, or the outermost two
where one side has none (extrapolation). Values are bracketed by coordinate, so a missing value at a bracket makes the result missing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp
from ..functions.sizes import small

METHODS = ("linear", "linear_weak_extra", "linear_no_extra", "linear_const_extra", "log", "loglog", "nearest")


def between(a: Column, b: Column, za: Column, zb: Column, z: Column, method: str) -> Column:
    """The value at z from those at za and zb."""
    if method == "nearest":
        return F.when(F.abs(z - za) <= F.abs(zb - z), a).otherwise(b)
    if method in ("log", "loglog"):
        scale = F.ln if method == "log" else (lambda x: F.ln(F.ln(x + 2.718281828459045)))
        ok = (za > 0) & (zb > 0) & (z > 0)
        za, zb, z = (F.when(ok, scale(F.when(ok, x))) for x in (za, zb, z))
    f = F.try_divide(z - za, zb - za)
    if method == "linear_const_extra":
        f = clamp(f, 0.0, 1.0)
    value = F.when(f == 0, a).when(f == 1, b).otherwise(a + f * (b - a))
    if method == "linear_no_extra":
        return F.when(f.between(0, 1), value)
    if method == "linear_weak_extra":
        return F.when(f.between(-1, 2), value)
    if method in ("linear", "linear_const_extra", "log", "loglog"):
        return value
    raise ValueError(f"unknown method {method!r}")


def interpolate(df: DataFrame, z: Column, values: Iterable[str], targets: DataFrame, target: str, cell: Iterable[str], method: str = "linear", on: Iterable[str] = ()) -> DataFrame:
    """``cell`` columns, those of ``targets``, and the values at each target coordinate.

    ``targets`` holds the coordinate ``target``; with no common columns ``on``, it is a short list of levels that every cell gets,
    otherwise each cell has its own. A target that meets a level exactly has its value.
    """
    cell, values, on = list(cell), list(values), list(on)
    rows = df.withColumn("_z", z).where("_z is not null")
    columns = rows.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("_z", *values))).alias("_p"))
    both = columns.join(targets, on) if on else columns.join(small(targets))
    at, p = F.col(target), F.col("_p")
    both = both.withColumn("_n", F.size(F.filter(p, lambda q: q["_z"] <= at)))
    low = F.greatest(F.lit(1), F.least(F.size(p) - 1, F.col("_n")))
    both = both.withColumns({"_a": F.get(p, low - 1), "_b": F.get(p, low), "_at": F.get(p, F.col("_n") - 1)})
    out = [F.when(F.col("_at")["_z"] == at, F.col("_at")[v]).otherwise(between(F.col("_a")[v], F.col("_b")[v], F.col("_a")["_z"], F.col("_b")["_z"], at, method)).alias(v) for v in values]
    return both.select(*dict.fromkeys([*cell, *targets.columns]), *out)


def within_validity(value: Column, z: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Null where the target lies outside the range in which the vertical coordinate holds (above the ground, not below the sea floor)."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (z >= low)
    if high is not None:
        ok = ok & (z <= high)
    return F.when(ok, value)


def interpolate_time(df: DataFrame, t: str, times: DataFrame, target: str, values: Iterable[str], cell: Iterable[str], axis: DataFrame | None = None) -> DataFrame:
    """Values at new times, by the pair of steps around each, or the two at the end: linear, one step outside at most.

    ``axis`` holds the steps ``t``; by default those of the data. A step of the axis without any data is an absent slice, in whose
    place the pair's other slice is taken. A cell that one of two slices lacks is missing in the result; one in neither is not in it.
    An axis of one step gives its values at all times.

    Each cell goes to the few targets around its step by one equi-join with a table of times, and both sides meet in one aggregate.
    """
    cell, values = list(cell), list(values)
    have = df.select(F.col(t).alias("_t")).distinct()
    steps = have if axis is None else axis.select(F.col(t).alias("_t")).distinct()
    pairs = interpolate_pairs(steps, "_t", times, target)
    if axis is None:
        pairs = pairs.withColumns({"_has_a": F.lit(True), "_has_b": F.lit(True)})
    else:
        for k in ("a", "b"):
            pairs = pairs.join(have.select(F.col("_t").alias(f"_t{k}"), F.lit(True).alias(f"_has_{k}")), f"_t{k}", "left").withColumn(f"_has_{k}", F.col(f"_has_{k}").isNotNull())
    role = lambda k: F.struct(F.col(f"_t{k}").alias("t"), F.lit(k).alias("side"))
    roles = pairs.withColumn("_role", F.explode(F.array_distinct(F.array(role("a"), role("b"))))).withColumn("_t", F.col("_role.t"))
    rows = df.select(*cell, F.col(t).alias("_t"), *values).join(roles, "_t")
    keys = [*cell, target, "_ta", "_tb", "_has_a", "_has_b"]
    side = lambda v, k: F.max(F.when(F.col("_role.side") == k, F.col(v))).alias(f"_{v}{k}")
    both = rows.groupBy(*keys).agg(*(side(v, k) for v in values for k in ("a", "b")))
    number = lambda x: F.unix_micros(x.cast("timestamp")).cast("double") if dict(df.dtypes)[t].startswith("timestamp") else x.cast("double")
    out = []
    for v in values:
        a, b = F.col(f"_{v}a"), F.col(f"_{v}b")
        inside = between(a, b, number(F.col("_ta")), number(F.col("_tb")), number(F.col(target)), "linear_weak_extra")
        out.append(F.when(~F.col("_has_a"), b).when(~F.col("_has_b") | (F.col("_ta") == F.col("_tb")), a).otherwise(inside).alias(v))
    return both.select(*cell, target, *out)


def interpolate_pairs(axis: DataFrame, t: str, times: DataFrame, target: str) -> DataFrame:
    """``(target, _ta, _tb)``: the last axis value below each target and the first that isn't; at the ends the last or the first two, of an axis of one value that one twice.

    Only distinct times are ordered as a whole.
    """
    steps = axis.selectExpr(f"{t} as _v", f"lag({t}) over (order by {t}) as _before", f"lead({t}) over (order by {t}) as _after", "0 as _kind")
    both = steps.unionByName(times.select(F.col(target).alias("_v"), F.lit(1).alias("_kind")).distinct(), allowMissingColumns=True)
    low = "last(if(_kind = 0, struct(_v, _before), null), true) over (order by _v, _kind desc rows between unbounded preceding and current row)"
    high = "first(if(_kind = 0, struct(_v, _after), null), true) over (order by _v, _kind desc rows between current row and unbounded following)"
    near = both.selectExpr("_v", "_kind", f"{low} as _low", f"{high} as _high").where("_kind = 1 and (_low is not null or _high is not null)")
    first = "if(_low is null, _high._v, if(_high is null, coalesce(_low._before, _low._v), _low._v))"
    return near.selectExpr(f"_v as `{target}`", f"{first} as _ta", "if(_high is null, _low._v, if(_low is null, coalesce(_high._after, _high._v), _high._v)) as _tb")
