"""A dataset, its cells and schema together, with a method per operator; and runs of operators from a configuration.

Methods return new datasets and run nothing; Spark plans the whole chain at once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projections import north_angle, parse, transform
from ..functions.sizes import small
from ..operators import combine, extract, horizontal, process, quality, stats, vertical


@dataclass(frozen=True)
class GridDataset:
    """``df``: a row per cell with the dimension columns ``dims`` (outermost first) and variables; ``t``, ``x`` and ``y`` name dimensions."""

    df: DataFrame
    dims: tuple[str, ...]
    t: str | None = "t"
    x: str = "x"
    y: str = "y"

    @property
    def variables(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.dims]

    @property
    def cell(self) -> list[str]:
        return [d for d in self.dims if d != self.t]

    def with_df(self, df: DataFrame) -> GridDataset:
        return replace(self, df=df)

    # subsets
    def select(self, *names: str) -> GridDataset:
        return self.with_df(extract.select_variables(self.df, names, self.dims))

    def remove(self, *names: str) -> GridDataset:
        return self.with_df(extract.remove_variables(self.df, names))

    def reduce_dimension(self, dim: str, start: int, size: int) -> GridDataset:
        return self.with_df(extract.reduce_dimension(self.df, dim, start, size))

    def pick_dimension(self, dim: str, positions) -> GridDataset:
        return self.with_df(extract.pick_dimension(self.df, dim, positions))

    def reduce_time(self, column: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> GridDataset:
        return self.with_df(extract.reduce_time(self.df, column, start, end))

    def reduce_axis(self, dim: str, value: str, low: float | None, high: float | None, unit: str = "", axis_unit: str = "") -> GridDataset:
        return self.with_df(extract.reduce_axis(self.df, dim, value, low, high, unit, axis_unit))

    def bounding_box(self, south: float, north: float, west: float, east: float, lon: str = "lon", lat: str = "lat") -> GridDataset:
        return self.with_df(extract.bounding_box(self.df, south, north, west, east, self.x, self.y, lon, lat))

    # values
    def mask(self, value: str, status: Column | str, rule, fill: float | None = None) -> GridDataset:
        over = [self.t] if self.t else []
        return self.with_df(quality.mask(self.df, value, F.col(status) if isinstance(status, str) else status, rule, over, fill))

    def quality(self, text: str, kinds: Callable[[str, str | None, str], DataFrame] | None = None) -> GridDataset:
        """The rules of a quality document, in order; rules for variables that don't exist are passed over.

        A status in a file of its own is read by ``kinds(path, kind, variable)``, by default ``read``, and holds for all cells along the
        dimensions that it lacks. ValueError if it has dimensions that this dataset lacks.
        """
        out = self
        for r in quality.rules_of(text):
            if r.variable not in out.variables:
                continue
            if r.file is None:
                out = out.mask(r.variable, r.status, r.use, r.fill)
                continue
            status = kinds(r.file, r.kind, r.status) if kinds else read(self.df.sparkSession, r.file, r.kind, r.status)
            dims = [c for c in status.columns if c != r.status and not c.endswith("_value")]
            if not set(dims) <= set(self.dims):
                raise ValueError(f"{r.status} has more dimensions than {r.variable}")
            out = out.with_df(quality.mask_by(out.df, r.variable, status, r.status, r.use, dims, r.fill, [self.t] if self.t else []))
        return out

    def accumulate(self, *values: str) -> GridDataset:
        df = self.df
        for v in values:
            df = process.accumulate(df, v, self.t, self.cell)
        return self.with_df(df)

    def deaccumulate(self, *values: str) -> GridDataset:
        df = self.df
        for v in values:
            df = process.deaccumulate(df, v, self.t, self.cell)
        return self.with_df(df)

    def transform(self, name: str, fn: Callable[[Column], Column]) -> GridDataset:
        return self.with_df(self.df.withColumn(name, fn(F.col(name))))

    def locate(self, proj: str, x_value: str, y_value: str) -> GridDataset:
        """Adds lon and lat from a projection and the axes' values."""
        lon, lat = parse(proj).inverse(F.col(x_value), F.col(y_value))
        return self.with_df(self.df.withColumns({"lon": lon, "lat": lat}))

    def rotate_to_latlon(self, u: str, v: str, proj: str, lon: str = "lon", lat: str = "lat") -> GridDataset:
        return self.with_df(process.rotate_vectors(self.df, u, v, north_angle(parse(proj), F.col(lon), F.col(lat))))

    def rotate_all_to_latlon(self, standard_names: dict[str, str], proj: str, lon: str = "lon", lat: str = "lat") -> GridDataset:
        """Every vector on the map's axes turned to east and north; vectors are told by their variables' standard names."""
        return self.with_df(process.rotate_all(self.df, standard_names, north_angle(parse(proj), F.col(lon), F.col(lat))))

    # interpolation
    def to_levels(self, z: Column, levels: list[float], values: list[str], zdim: str, method: str = "linear") -> GridDataset:
        cell = [d for d in self.dims if d != zdim]
        targets = self.df.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(levels)], f"{zdim} int, {zdim}_value double")
        out = vertical.interpolate(self.df, z, values, targets, f"{zdim}_value", cell, method)
        return replace(self, df=out, dims=(*cell, zdim))

    def to_times(self, column: str, times: list[dt.datetime], values: list[str]) -> GridDataset:
        targets = self.df.sparkSession.createDataFrame([(t,) for t in times], f"target {dict(self.df.dtypes)[column]}")
        out = vertical.interpolate_time(self.df, column, targets, "target", values, self.cell)
        return replace(self, df=out.withColumnRenamed("target", column), dims=(column, *self.cell), t=column)

    @property
    def slices(self) -> list[str]:
        """The dimensions that tell fields apart, with their axes' values."""
        own = [d for d in self.dims if d not in (self.x, self.y)]
        return [*own, *(f"{d}_value" for d in own if f"{d}_value" in self.df.columns)]

    def _on(self, at: DataFrame, value: str | Sequence[str], method: str) -> DataFrame:
        """Every field at the points ``(id, px, py)``."""
        methods = {"nearest": horizontal.nearest, "nearestneighbor": horizontal.nearest, "bilinear": horizontal.bilinear, "bicubic": horizontal.bicubic}
        if method not in methods:
            raise ValueError(f"unknown method {method!r}")
        return methods[method](self.df, at, value, x=self.x, y=self.y, keys=self.slices)

    def _fields(self, out: DataFrame, value: str | Sequence[str], row: Column, column: Column, *more: str) -> GridDataset:
        """Fields on other points, with this dataset's further dimensions."""
        own = [d for d in self.dims if d not in (self.x, self.y)]
        values = [value] if isinstance(value, str) else list(value)
        df = out.select(*self.slices, row.alias(self.y), column.alias(self.x), *more, *values)
        return replace(self, df=df, dims=(*own, self.y, self.x), t=self.t if self.t in own else None)

    def to_grid(self, value: str | Sequence[str], x_axis: list[float], y_axis: list[float], source: tuple[float, float, float, float], proj: str | None = None, own_proj: str | None = None, method: str = "bilinear") -> GridDataset:
        """Fields on new axes, each time and level by itself; ``source`` gives start and step of the own axes in x and in y.

        ``method``: nearest, bilinear or bicubic, or forward_ or forward_undef_ with sum, mean, median, min or max, which gather the own cells in the
        new one around each. With their own lon and lat in the cells ``to_coordinates`` needs no regular source.
        """
        if method.startswith("forward_"):
            return self._gathered(value, x_axis, y_axis, source, proj, own_proj, method)
        spark = self.df.sparkSession
        xs = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x_axis)], "ox int, xv double")
        ys = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y_axis)], "oy int, yv double")
        at = ys.join(small(xs))  # axes: the target grid itself
        px, py = (F.col("xv"), F.col("yv")) if proj is None else transform(parse(proj), parse(own_proj), F.col("xv"), F.col("yv"))
        x0, dx, y0, dy = source
        at = at.select((F.col("oy") * len(x_axis) + F.col("ox")).alias("id"), "ox", "oy", horizontal.position(px, x0, dx).alias("px"), horizontal.position(py, y0, dy).alias("py"))
        return self._fields(self._on(at, value, method), value, F.col("oy"), F.col("ox"))

    def _gathered(self, value: str | Sequence[str], x_axis: list[float], y_axis: list[float], source: tuple[float, float, float, float], proj: str | None, own_proj: str | None, method: str) -> GridDataset:
        how = method.removeprefix("forward_").removeprefix("undef_")
        if how not in horizontal.FORWARD:
            raise ValueError(f"unknown method {method!r}")
        x, y = source[0] + source[1] * F.col(self.x), source[2] + source[3] * F.col(self.y)
        if proj is not None:
            x, y = transform(parse(own_proj), parse(proj), x, y)
        undefined, out = method.startswith("forward_undef_"), None
        for v in [value] if isinstance(value, str) else value:
            cells = self.df.select(*self.slices, v, x.alias("_x"), y.alias("_y"))
            cells = horizontal.positions_on(cells, "_x", x_axis).withColumnRenamed("position", "_px")
            cells = horizontal.positions_on(cells, "_y", y_axis).withColumnRenamed("position", "_py")
            one = horizontal.forward(cells, v, "_px", "_py", len(x_axis), len(y_axis), how, undefined, self.slices)
            out = one if out is None else out.join(one, [*self.slices, "oy", "ox"])
        return self._fields(out, value, F.col("oy"), F.col("ox"))

    def to_coordinates(self, value: str | Sequence[str], x_axis: list[float], y_axis: list[float], radius: float, proj: str | None = None, lon: str = "lon", lat: str = "lat") -> GridDataset:
        """A field on new axes (longitudes and latitudes, or those of ``proj``): the value of the own cell nearest on the sphere within ``radius`` metres.

        The own cells need longitudes and latitudes only, on no regular axes.
        """
        spark = self.df.sparkSession
        xs = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x_axis)], "ox int, xv double")
        ys = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y_axis)], "oy int, yv double")
        at = ys.join(small(xs))  # axes: the target grid itself
        to_lon, to_lat = (F.col("xv"), F.col("yv")) if proj is None else parse(proj).inverse(F.col("xv"), F.col("yv"))
        at = at.select((F.col("oy").cast("long") * len(x_axis) + F.col("ox")).alias("id"), "ox", "oy", to_lon.alias("lon"), to_lat.alias("lat"))
        own = self.df.groupBy(F.struct(self.y, self.x).alias("cell")).agg(F.first(lon).alias("lon"), F.first(lat).alias("lat"))  # all fields share their points
        near = horizontal.coordinate_nearest(own, at, "cell", radius)
        near = near.select("id", "ox", "oy", F.col("cell")[self.x].alias("px"), F.col("cell")[self.y].alias("py"))
        return self._fields(self._on(near, value, "nearest"), value, F.col("oy"), F.col("ox"))

    def like(self, value: str | Sequence[str], template: DataFrame, source: tuple[float, float, float, float], own_proj: str = "+proj=latlong", method: str = "bilinear", lon: str = "lon", lat: str = "lat") -> GridDataset:
        """A field on the points ``(y, x, lon, lat)`` of a template, whatever their arrangement."""
        own = parse(own_proj)
        px, py = own.forward(F.col("lon"), F.col("lat"))
        x0, dx, y0, dy = source
        at = template.select(F.struct(self.y, self.x).alias("id"), F.col(lon).alias("lon"), F.col(lat).alias("lat")).distinct()
        at = at.select("id", "lon", "lat", horizontal.position(px, x0, dx, 360.0 if own.name == "latlong" else None).alias("px"), horizontal.position(py, y0, dy).alias("py"))
        return self._fields(self._on(at, value, method), value, F.col("id")[self.y], F.col("id")[self.x], "lon", "lat")

    def to_points(self, value: str | Sequence[str], lonlat: list[tuple[float, float]], source: tuple[float, float, float, float], own_proj: str, method: str = "nearest") -> GridDataset:
        """Values at points given by longitude and latitude, as a row x = 0, 1, ... with y = 0."""
        spark, own = self.df.sparkSession, parse(own_proj)
        at = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(lonlat)], "id int, lon double, lat double")
        px, py = own.forward(F.col("lon"), F.col("lat"))
        x0, dx, y0, dy = source
        at = at.select("id", "lon", "lat", horizontal.position(px, x0, dx, 360.0 if own.name == "latlong" else None).alias("px"), horizontal.position(py, y0, dy).alias("py"))
        return self._fields(self._on(at, value, method), value, F.lit(0), F.col("id"), "lon", "lat")

    def cross_section(self, value: str | Sequence[str], corners: list[tuple[float, float]], source: tuple[float, float, float, float], proj: str, method: str = "bilinear") -> GridDataset:
        """Values along straight lines, on this grid's map, through corners given by longitude and latitude."""
        spark, own = self.df.sparkSession, parse(proj)
        x, y = own.forward(F.col("lon"), F.col("lat"))
        ends = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(corners)], "k int, lon double, lat double").select("k", x.alias("x"), y.alias("y"))
        line = horizontal.cross_section([(r["x"], r["y"]) for r in ends.orderBy("k").collect()], source[1], source[3])  # a few corners
        at = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(line)], "id int, xv double, yv double")
        lon, lat = own.inverse(F.col("xv"), F.col("yv"))
        at = at.select("id", lon.alias("lon"), lat.alias("lat"), horizontal.position(F.col("xv"), source[0], source[1]).alias("px"), horizontal.position(F.col("yv"), source[2], source[3]).alias("py"))
        return self._fields(self._on(at, value, method), value, F.lit(0), F.col("id"), "lon", "lat")

    # several datasets
    def join_existing(self, *others: GridDataset) -> GridDataset:
        return self.with_df(combine.join_existing([self.df, *(o.df for o in others)], self.t))

    def union(self, *others: GridDataset) -> GridDataset:
        return self.with_df(combine.union([self.df, *(o.df for o in others)], self.dims))

    def overlay(self, top: GridDataset, *values: str) -> GridDataset:
        return self.with_df(combine.overlay(self.df, top.df, self.dims, values))

    def nest(self, inner: GridDataset, value: str, inner_axes: tuple[list[float], list[float]], outer_axes: tuple[list[float], list[float]], transition: int = 5, border: int = 2, method: str = "bilinear") -> GridDataset:
        """This field with a finer one inside: on the inner axes, extended over this one's extent, the inner borders passing smoothly into it."""
        (xi, yi), (xo, yo) = inner_axes, outer_axes
        regular = lambda a: (a[0], a[1] - a[0])
        wide = [combine.merged_axis(i, o) for i, o in ((xi, xo), (yi, yo))]
        around = self.to_grid(value, *wide, (*regular(xo), *regular(yo)), method=method)
        near = self.to_grid(value, xi, yi, (*regular(xo), *regular(yo)), method=method)
        smooth = combine.merge_smooth(inner.df, near.df, near.dims, value, len(xi), len(yi), transition, border, x=self.x, y=self.y)
        shift = [min(range(len(w)), key=lambda k, w=w, i=i: abs(w[k] - i[0])) for w, i in zip(wide, (xi, yi), strict=True)]
        moved = smooth.withColumns({self.x: F.col(self.x) + shift[0], self.y: F.col(self.y) + shift[1]})
        return around.with_df(combine.overlay(around.df, moved, around.dims, [value]))

    def upsert(self, source: GridDataset, *values: str) -> GridDataset:
        return self.with_df(combine.upsert(self.df, source.df, self.dims, values or self.variables))

    def stats(self, value: str, *by: str) -> DataFrame:
        return stats.field_stats(self.df, value, by or [d for d in self.dims if d not in (self.x, self.y)])

    def write(self, path: str, partition_by: str | None = None, mode: str = "error") -> None:
        w = self.df.write.mode(mode)
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)


# --------------------------------------------------------------------------- files

#: The first bytes of each kind of file.
MAGIC = {b"CDF\x01": "netcdf3", b"CDF\x02": "netcdf3", b"CDF\x05": "netcdf3", b"PAR1": "parquet", b"ORC": "orc"}
ENDS = {".nc": "netcdf3", ".nc3": "netcdf3", ".cdf": "netcdf3", ".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".json": "json"}


def kind_of(spark: SparkSession, path: str) -> str:
    """The kind of a path: by the first bytes of a file, else by its name; ``netcdf3`` for ``glob:`` patterns and ``parquet`` for other folders."""
    if path.startswith("glob:"):
        return "netcdf3"
    named = next((k for e, k in ENDS.items() if path.endswith(e)), None)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at) and fs.getFileStatus(at).isFile():
        stream = fs.open(at)
        try:
            first = bytes(b & 0xFF for b in (stream.read() for _ in range(4)) if b >= 0)
        finally:
            stream.close()
        return next((k for m, k in MAGIC.items() if first.startswith(m)), named or "parquet")
    return named or "parquet"


def read(spark: SparkSession, path: str, kind: str | None = None, variable: str | None = None) -> DataFrame:
    """Cells of a path: by the given kind, else by what ``kind_of`` finds; ``netcdf3`` needs a variable."""
    kind = kind or kind_of(spark, path)
    if kind == "netcdf3":
        from ..sources.netcdf3 import NetCDF3

        spark.dataSource.register(NetCDF3)
        return spark.read.format("netcdf3").option("variable", variable).load(path)
    return spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {})).load(path)
