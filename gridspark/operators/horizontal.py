"""Horizontal interpolation between grids, as joins of points with their neighbour cells.

A target point has a position in the source grid, a fractional column and row. Backward methods explode each target's few neighbours
and join them to the source by cell, so the source is shuffled once whatever its size; forward methods give each source cell its
target and aggregate there, with partial sums before the shuffle.

``keys`` are the source's other dimensions, such as time and level: each of its slices is interpolated to all points. Several values can
be interpolated at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EARTH_RADIUS, central_angle

FORWARD = ("sum", "mean", "median", "min", "max")


def position(value: Column, start: float, step: float, circle: float | None = None) -> Column:
    """Fractional index of a value on a regular axis; with ``circle`` (360 for longitudes) values are moved next to the axis first."""
    x = (value - start) / step
    return x if circle is None else F.pmod(x + 0.5, F.lit(abs(circle / step))) - 0.5


def positions_on(points: DataFrame, value: str, axis: list[float]) -> DataFrame:
    """``points`` with ``position`` on an irregular axis, ascending or descending: linear between its values, and beyond its ends.

    The axis is one array constant, searched by halving.
    """
    if not axis:
        raise ValueError("an axis needs values")
    if len(axis) == 1:
        return points.withColumn("position", F.when(F.col(value) == axis[0], F.lit(0.0)))
    sign, v = (1.0 if axis[-1] >= axis[0] else -1.0), F.col(value)
    steps = [1 << k for k in range((len(axis) - 2).bit_length() - 1, -1, -1)]
    constant = F.split(F.lit(",".join(repr(float(a)) for a in axis)), ",").cast("array<double>")
    last = len(axis) - 2
    ahead = lambda at, step: (at + step <= last) & (v * sign >= F.get(constant, at + step) * sign)
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at)) if steps else F.lit(0)
    out = points.withColumn("_at", at)
    low, high = F.get(constant, F.col("_at")), F.get(constant, F.col("_at") + 1)
    return out.withColumn("position", F.when(~F.isnan(v), F.col("_at") + (v - low) / (high - low))).drop("_at")


def _neighbours(points: DataFrame, px: str, py: str, offsets: range) -> DataFrame:
    """A row per neighbour cell (_x, _y) of each point, with its offsets from the cell at or before the point."""
    grid = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in offsets for j in offsets]
    rows = points.withColumns({"_fx": F.floor(px).cast("int"), "_fy": F.floor(py).cast("int")}).withColumn("_o", F.explode(F.array(*grid)))
    return rows.withColumns({"_x": F.col("_fx") + F.col("_o.i"), "_y": F.col("_fy") + F.col("_o.j")})


def _names(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _each(points: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The points of each slice, which are the result's rows."""
    return source.select(*keys).distinct().crossJoin(points) if keys else points


def _weighted(source: DataFrame, points: DataFrame, near: DataFrame, value: str | Sequence[str], id: str, x: str, y: str, keys: list[str]) -> DataFrame:
    """Weighted sums over ``near(id, _x, _y, _w, _n)``, missing where fewer than ``_n`` cells have a value.

    ``near`` has many rows for each point, which Spark's estimates don't see: an outer join keeps it from ever being broadcast.
    """
    names = _names(value)
    src = source.select(F.col(x).alias("_x"), F.col(y).alias("_y"), *keys, *(F.col(v).alias(f"_v{k}") for k, v in enumerate(names)))
    sums = [F.when(F.count(f"_v{k}") == F.max("_n"), F.sum(F.col("_w") * F.col(f"_v{k}"))).alias(v) for k, v in enumerate(names)]
    got = near.join(src, ["_x", "_y"], "left").groupBy(*keys, id).agg(*sums)
    return _each(points, source, keys).join(got, [*keys, id], "left")


def nearest(source: DataFrame, points: DataFrame, value: str | Sequence[str], px: str = "px", py: str = "py", x: str = "x", y: str = "y", keys: Iterable[str] = ()) -> DataFrame:
    """Value of the cell around each point; null outside."""
    keys = list(keys)
    at = _each(points.withColumns({"_x": F.round(px).cast("int"), "_y": F.round(py).cast("int")}), source, keys)
    src = source.select(F.col(x).alias("_x"), F.col(y).alias("_y"), *keys, *_names(value))
    return at.join(src, [*keys, "_x", "_y"], "left").drop("_x", "_y")


def bilinear(
    source: DataFrame, points: DataFrame, value: str | Sequence[str], id: str = "id", px: str = "px", py: str = "py", x: str = "x", y: str = "y", shape: tuple[int, int] | None = None, keys: Iterable[str] = ()
) -> DataFrame:
    """Mean of four cells weighted by distance. In the outer half of the border's cells it is linear along the border only, in a corner the nearest cell.

    A missing cell makes the result missing, whatever its weight. ``shape`` is the source's (columns, rows); by default those of its largest cell.
    """
    at = points.select(id, px, py).where(~F.isnan(px) & ~F.isnan(py))
    if shape:
        at = at.withColumns({"_nx": F.lit(shape[0]), "_ny": F.lit(shape[1])})
    else:
        at = at.join(F.broadcast(source.agg((F.max(x) + 1).alias("_nx"), (F.max(y) + 1).alias("_ny"))))  # one row

    def side(p: str, n: str) -> Column:
        low = F.floor(p)
        within = (low >= 0) & (low + 1 < F.col(n))
        cell = lambda c, w: F.struct(c.cast("int").alias("at"), w.cast("double").alias("w"))
        return F.when(within, F.array(cell(low, low + 1 - F.col(p)), cell(low + 1, F.col(p) - low))).otherwise(F.array(cell(F.round(p), F.lit(1.0))))

    near = at.withColumns({"_is": side(px, "_nx"), "_js": side(py, "_ny")})
    near = near.withColumn("_n", F.size("_is") * F.size("_js")).withColumn("_i", F.explode("_is")).withColumn("_j", F.explode("_js"))
    near = near.select(id, "_n", F.col("_i.at").alias("_x"), F.col("_j.at").alias("_y"), (F.col("_i.w") * F.col("_j.w")).alias("_w"))
    return _weighted(source, points, near, value, id, x, y, list(keys))


def bicubic(source: DataFrame, points: DataFrame, value: str | Sequence[str], id: str = "id", px: str = "px", py: str = "py", x: str = "x", y: str = "y", keys: Iterable[str] = ()) -> DataFrame:
    """Cubic convolution with a = -0.5 over 4 x 4 cells, all of which must be there."""

    def weight(d: Column, k: Column) -> Column:
        t = F.abs(d - k)
        inner, outer = (1.5 * t - 2.5) * t * t + 1.0, ((-0.5 * t + 2.5) * t - 4.0) * t + 2.0
        return F.when(t <= 1, inner).when(t < 2, outer).otherwise(0.0)

    near = _neighbours(points.select(id, px, py), px, py, range(-1, 3))
    dx, dy = F.col(px) - F.col("_fx"), F.col(py) - F.col("_fy")
    near = near.select(id, "_x", "_y", (weight(dx, F.col("_o.i")) * weight(dy, F.col("_o.j"))).alias("_w"), F.lit(16).alias("_n"))
    return _weighted(source, points, near, value, id, x, y, list(keys))


def forward(source: DataFrame, value: str, px: str, py: str, width: int, height: int, how: str, undefined: bool = False, keys: Iterable[str] = ()) -> DataFrame:
    """``keys, ox, oy, value``: source cells gathered in the target cell around their position (px, py), for the whole target grid.

    Missing values are passed over; with ``undefined`` one makes the target cell missing. The median of an even number is the upper one.
    """
    keys = list(keys)
    rows = source.withColumns({"ox": F.round(px).cast("int"), "oy": F.round(py).cast("int")}).where(F.col("ox").between(0, width - 1) & F.col("oy").between(0, height - 1))
    v = F.col(value)
    if how == "median":
        # Equal values are counted before they are put in order; no cell's values are gathered in one row.
        w = Window.partitionBy(*keys, "ox", "oy")
        rows = rows.groupBy(*keys, "ox", "oy", value).agg(F.count("*").alias("_n"), F.count(v).alias("_defined"))
        rows = rows.withColumns({"_upto": F.sum("_defined").over(w.orderBy(v.asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_all": F.sum("_defined").over(w)})
        rank = F.floor(F.col("_all") / 2) + 1
        agg, whole = F.max(F.when((rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_defined")), v)), F.sum("_defined") == F.sum("_n")
    else:
        agg, whole = {"sum": F.sum(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v)}[how], F.count(v) == F.count("*")
    if undefined:
        agg = F.when(whole, agg)
    got = rows.groupBy(*keys, "ox", "oy").agg(agg.alias(value))
    spark = source.sparkSession
    cells = spark.range(width * height).select((F.col("id") % width).cast("int").alias("ox"), F.floor(F.col("id") / width).cast("int").alias("oy"))
    if keys:
        cells = source.select(*keys).distinct().join(cells)
    return cells.join(got, [*keys, "ox", "oy"], "left")


#: Halvings of the cube around the sphere at most (boxes of 12 m on the earth), those before boxes are compared at all, and places in the
#: fullest box that need no more of them.
HALVINGS, FIRST, PLACES = 20, 3, 32
#: Chords that differ by less are compared by the formula of the distance, which is exact to some 1e-8 of the radius.
SLACK = 1e-7


def _places(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Rows with a place (neither null nor infinite), with its box (_0, _1, _2) after all halvings."""
    a, b, n, inf = F.radians(lon), F.radians(lat), 1 << HALVINGS, F.lit(math.inf)
    axes = (F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b))
    whole = df.where((F.abs(lon) < inf) & (F.abs(lat) < inf))
    return whole.withColumns({f"_{k}": F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((c + 1.0) * (n / 2)))).cast("int") for k, c in enumerate(axes)})


def _box(level: int, to: str) -> list[Column]:
    return [F.shiftright(f"_{k}", HALVINGS - level).alias(f"{to}{k}") for k in range(3)]


def _depth(src: DataFrame) -> int:
    """Halvings until no box has more than PLACES rows; one job, a row for each row and halving."""
    boxes = src.withColumn("_level", F.explode(F.sequence(F.lit(FIRST), F.lit(HALVINGS)))).select("_level", *(F.expr(f"shiftright(_{k}, {HALVINGS} - _level)").alias(f"_b{k}") for k in range(3)))
    fullest = boxes.groupBy("_level", "_b0", "_b1", "_b2").count().groupBy("_level").agg(F.max("count").alias("n")).collect()
    return min((r["_level"] for r in fullest if r["n"] <= PLACES), default=HALVINGS if fullest else FIRST)


def _near_boxes(src: DataFrame, at: DataFrame, chord: float, depth: int) -> DataFrame:
    """Pairs of boxes (_t0, _t1, _t2, _s0, _s1, _s2) of ``at`` and ``src`` after ``depth`` halvings that can hold a place and the one nearest to it.

    Only pairs that are left go on to the next halving. Of a box's partners those stay that aren't farther at their nearest than another one
    is at its farthest, nor farther than ``chord``; their number depends on how boxes lie, not on how many places they hold.
    """
    pairs = None
    for level in range(FIRST, depth + 1):
        side = 2.0 / (1 << level)
        mine, theirs = at.select(*_box(level, "_t")).distinct(), src.select(*_box(level, "_s")).distinct()
        if pairs is None:
            both = mine.crossJoin(theirs)
        else:
            up = lambda df, c: df.withColumns({f"{c}{k}p": F.shiftright(f"{c}{k}", 1) for k in range(3)})
            both = pairs.select(*(F.col(f"_{c}{k}").alias(f"_{c}{k}p") for c in "ts" for k in range(3)))
            both = both.join(up(mine, "_t"), [f"_t{k}p" for k in range(3)]).join(up(theirs, "_s"), [f"_s{k}p" for k in range(3)])
        apart = [F.abs(F.col(f"_t{k}") - F.col(f"_s{k}")).cast("double") for k in range(3)]
        nearest = F.sqrt(sum((F.greatest(d - 1.0, F.lit(0.0)) * side) * (F.greatest(d - 1.0, F.lit(0.0)) * side) for d in apart))
        farthest = F.sqrt(sum(((d + 1.0) * side) * ((d + 1.0) * side) for d in apart))
        both = both.withColumns({"_near": nearest, "_far": farthest}).where(F.col("_near") <= chord + SLACK)
        both = both.withColumn("_best", F.min("_far").over(Window.partitionBy("_t0", "_t1", "_t2")))
        pairs = both.where(F.col("_near") <= F.col("_best") + SLACK).select(*(f"_{c}{k}" for c in "ts" for k in range(3)))
    return pairs


def coordinate_nearest(source: DataFrame, points: DataFrame, value: str, radius: float, lon: str = "lon", lat: str = "lat", cell: str = "cell") -> DataFrame:
    """Value of the source point nearest to each point on the sphere, within ``radius`` metres, by lon and lat of both.

    Each place counts once, however many rows are there, and the cube around the sphere is halved until its boxes hold a few source places;
    a point meets those in boxes that can hold its nearest one, so the pairs compared grow with the points and not with the source's
    density. Ties, to the millimetre, go to the smallest source cell.
    """
    src = source.select(F.col(lon).alias("_lon"), F.col(lat).alias("_lat"), F.struct(F.col(cell).alias("_cell"), F.col(value).alias("_v")).alias("_s"))
    src = _places(src.groupBy("_lon", "_lat").agg(F.min("_s").alias("_s")), "_lon", "_lat")
    at = _places(points.select(F.col(lon).alias("_plon"), F.col(lat).alias("_plat")).distinct(), "_plon", "_plat")
    depth = _depth(src)
    pairs = _near_boxes(src, at, 2 * math.sin(min(radius / EARTH_RADIUS, math.pi) / 2), depth)
    both = pairs.join(at.select("_plon", "_plat", *_box(depth, "_t")), ["_t0", "_t1", "_t2"]).join(src.select("_lon", "_lat", "_s", *_box(depth, "_s")), ["_s0", "_s1", "_s2"])
    both = both.withColumn("_d", central_angle(F.col("_plon"), F.col("_plat"), F.col("_lon"), F.col("_lat")) * EARTH_RADIUS).where(F.col("_d") <= radius)
    best = both.groupBy("_plon", "_plat").agg(F.min(F.struct(F.round("_d", 3).alias("_r"), F.col("_s._cell").alias("_cell"), F.col("_s._v").alias("_v"))).alias("_b"), F.min("_d").alias("distance"))
    best = best.select(F.col("_plon").alias(lon), F.col("_plat").alias(lat), F.col("_b._v").alias("_v"), "distance")
    return points.join(best, [lon, lat], "left").select(*points.columns, F.col("_v").alias(value), "distance")


def cross_section(corners: list[tuple[float, float]], dx: float, dy: float) -> list[tuple[float, float]]:
    """Points along straight lines through corners in a grid with steps dx and dy; each corner once."""
    out = [corners[0]] if corners else []
    for (x0, y0), (x1, y1) in zip(corners, corners[1:], strict=False):
        n = max(1, int(max(abs((x1 - x0) / dx), abs((y1 - y0) / dy))))
        out += [(x0 + (x1 - x0) * k / n, y0 + (y1 - y0) * k / n) for k in range(1, n + 1)]
    return out


def nearest_rank(df: DataFrame, by: Iterable[str], order: Iterable[Column | str]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
