"""Runs of operators from an ini text."""

from __future__ import annotations

import configparser
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.projections import north_angle, parse
from ..functions.specs import axis_values, dotted, parse_time, time_values
from ..operators import derive, extract, process, slabs
from .dataset import GridDataset, read

#: Sections in the order in which they are applied, whatever their order in the text.
ORDER = ("process", "qualityExtract", "extract", "timeInterpolate", "interpolate", "verticalInterpolate", "merge", "qualityExtract2")

#: The keys of each section.
KEYS = {
    "process": "deaccumulateVariable accumulateVariable rotateVector.direction rotateVector.x rotateVector.y rotateVector.angle rotateVector.all rotateVector.projString addVerticalVelocity addVerticalVelocity.step addGeopotentialHeight",
    "qualityExtract": "variable status use fill config",
    "extract": "reduceDimension.name reduceDimension.start reduceDimension.end pickDimension.name pickDimension.list reduceTime.column reduceTime.start reduceTime.end reduceVerticalAxis.name reduceVerticalAxis.unit reduceVerticalAxis.axisUnit reduceVerticalAxis.start reduceVerticalAxis.end reduceToBoundingBox.south reduceToBoundingBox.north reduceToBoundingBox.west reduceToBoundingBox.east selectVariables removeVariable",
    "timeInterpolate": "column timeSpec variables start end",
    "interpolate": "variable method xAxisValues yAxisValues projString source sourceProjString distanceOfInterest latitudeValues longitudeValues vcross template preprocess postprocess",
    "verticalInterpolate": "axis level1 variables dimension method dataConversion",
    "merge": "inner.file inner.type inner.cfg variable innerXAxisValues innerYAxisValues xAxisValues yAxisValues smoothing method",
}
KEYS["qualityExtract2"] = KEYS["qualityExtract"]


def listed(text: str) -> list[str]:
    return [x.strip() for x in text.replace("\n", ",").split(",") if x.strip()]


def slab_process(text: str) -> Callable:
    """``fill2d(criterion,relaxation,rounds)`` or ``creepfill2d(repeat,weight[,default])``, each value with or without ``name=``."""
    m = re.fullmatch(r"\s*(fill2d|creepfill2d)\(([^)]*)\)\s*", text)
    values = [float(v.split("=")[-1]) for v in listed(m[2])] if m else []
    if m and m[1] == "fill2d" and len(values) == 3:
        return lambda field: slabs.fill(field, values[0], values[1], int(values[2]))
    if m and m[1] == "creepfill2d" and len(values) in (2, 3):
        return lambda field: slabs.creep(field, int(values[0]), int(values[1]), *values[2:])
    raise ValueError(f"unknown process {text!r}")


def smoothing(text: str) -> tuple[int, int]:
    """``LINEAR(transition,border)``, or ``LINEAR`` alone for 5 and 2."""
    m = re.fullmatch(r"LINEAR(?:\(([^,]+),([^,]+)\))?", text.strip())
    if not m:
        raise ValueError(f"unknown smoothing {text!r}")
    return (int(m[1]), int(m[2])) if m[1] else (5, 2)


def run_config(dataset: GridDataset, text: str, kinds: Callable[[str, str | None, str], DataFrame] | None = None) -> GridDataset:
    """Applies the sections of an ini text; ValueError for sections and keys that don't exist.

    Lists are separated by commas. A dimension has its values beside it as ``<dimension>_value``.

    * process: accumulateVariable, deaccumulateVariable; rotateVector.direction (latlon or grid) with .x and .y, with .all
      (``variable:standard_name`` pairs) or with .angle, and .projString of the map (cells have lon and lat); addVerticalVelocity, with the
      map's steps in .step; addGeopotentialHeight
    * qualityExtract, qualityExtract2: variable, status, use, fill; config, a file of rules
    * extract: reduceDimension.name/start/end and pickDimension.name/list (several dimensions: lists, those of pickDimension between
      semicolons); reduceTime.column/start/end; reduceVerticalAxis.name/start/end/unit/axisUnit; reduceToBoundingBox.south/north/west/east;
      selectVariables, removeVariable
    * timeInterpolate: column, timeSpec, variables, and for relative specs start and end
    * interpolate: variable (several are possible), method, preprocess, postprocess, source (start and step of the own axes in x and y) and
      sourceProjString; to xAxisValues and yAxisValues of projString, to the points latitudeValues and longitudeValues, through the corners
      ``lon lat`` of vcross, or to the points of template; coord_nearestneighbor needs distanceOfInterest in metres instead of source
    * verticalInterpolate: dataConversion (several between commas), axis, level1, variables, dimension, method
    * merge: inner.file, inner.type, inner.cfg (a text of this kind for it), variable, the two grids' axis values, smoothing, method

    ``kinds(path, kind, variable)`` reads other files, by default ``read``.
    """
    config = configparser.ConfigParser(strict=False)
    config.optionxform = str
    config.read_string(text)
    if unknown := set(config.sections()) - set(ORDER):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    for name in config.sections():
        if unknown := [k for k in config[name] if k not in KEYS[name].split()]:
            raise ValueError(f"unknown keys in {name}: {unknown}")
    steps = {"process": _process, "qualityExtract": _quality, "qualityExtract2": _quality, "extract": _extract, "timeInterpolate": _times, "interpolate": _interpolate, "verticalInterpolate": _levels, "merge": _merge}
    opener = kinds or (lambda path, kind, variable: read(dataset.df.sparkSession, path, kind, variable))
    out = dataset
    for name in ORDER:
        if config.has_section(name):
            out = steps[name](out, config[name], opener)
    return out


def _process(out: GridDataset, c, _) -> GridDataset:
    out = out.deaccumulate(*listed(c.get("deaccumulateVariable", ""))).accumulate(*listed(c.get("accumulateVariable", "")))
    if direction := c.get("rotateVector.direction"):
        if direction not in ("latlon", "grid"):
            raise ValueError(f"rotateVector.direction is latlon or grid, not {direction!r}")
        angle = north_angle(parse(c["rotateVector.projString"]), F.col("lon"), F.col("lat"))
        angle, df = angle if direction == "latlon" else -angle, out.df
        xs, ys, turned = (listed(c.get(f"rotateVector.{k}", "")) for k in ("x", "y", "angle"))
        if len(xs) != len(ys):
            raise ValueError("rotateVector.x and rotateVector.y have different lengths")
        if not (xs or turned or "rotateVector.all" in c):
            raise ValueError("rotateVector.x and rotateVector.y, rotateVector.all or rotateVector.angle is needed")
        for u, v in zip(xs, ys, strict=True):
            df = process.rotate_vectors(df, u, v, angle)
        if not xs and "rotateVector.all" in c:
            names = dict(p.split(":", 1) for p in listed(c["rotateVector.all"]))
            df = process.rotate_all(df, names, angle if direction == "latlon" else -angle, to_earth=direction == "latlon")
        for v in turned:
            df = process.rotate_direction(df, v, angle)
        out = out.with_df(df)
    if "addVerticalVelocity" in c and c.getboolean("addVerticalVelocity"):
        z = next(d for d in out.dims if d not in (out.t, out.y, out.x))
        step = tuple(float(v) for v in listed(c.get("addVerticalVelocity.step", "1000,1000")))
        where = {"lon": "lon", "lat": "lat"} if {"lon", "lat"} <= set(out.df.columns) else {}
        w = derive.add_vertical_velocity(out.df, out.t, z, out.y, out.x, step=step, **where)
        out = out.with_df(out.df.join(w, list(out.dims), "left"))
    if "addGeopotentialHeight" in c and c.getboolean("addGeopotentialHeight"):
        z = next(d for d in out.dims if d not in (out.t, out.y, out.x))
        df = derive.altitude(out.df, [d for d in out.dims if d != z])
        out = out.with_df(df.withColumnRenamed("altitude", "geopotential_height") if "geopotential_height" not in out.df.columns else out.df)
    return out


def _quality(out: GridDataset, c, kinds) -> GridDataset:
    if "config" in c:
        with open(c["config"]) as f:
            out = out.quality(f.read(), kinds)
    return out.mask(c["variable"], c["status"], c["use"], c.getfloat("fill", fallback=None)) if "variable" in c else out


def _extract(out: GridDataset, c, _) -> GridDataset:
    if "reduceDimension.name" in c:
        dims, starts, ends = (listed(c.get(f"reduceDimension.{k}", "")) for k in ("name", "start", "end"))
        for k, d in enumerate(dims):
            start, end = (int(v[k]) if k < len(v) else 0 for v in (starts, ends))
            length = out.df.agg(F.max(d)).first()[0] + 1
            out = out.with_df(extract.reduce_dimension_start_end(out.df, d, start, end, length))
    if "pickDimension.name" in c:
        for d, positions in zip(listed(c["pickDimension.name"]), c["pickDimension.list"].split(";"), strict=True):
            out = out.pick_dimension(d, positions)
    if "reduceTime.start" in c or "reduceTime.end" in c:
        out = out.reduce_time(c.get("reduceTime.column", out.t), *(parse_time(c[k]) if (k := f"reduceTime.{e}") in c else None for e in ("start", "end")))
    if "reduceVerticalAxis.name" in c:
        d = c["reduceVerticalAxis.name"]
        low, high = (c.getfloat(f"reduceVerticalAxis.{k}", fallback=None) for k in ("start", "end"))
        out = out.reduce_axis(d, f"{d}_value", low, high, c.get("reduceVerticalAxis.unit", ""), c.get("reduceVerticalAxis.axisUnit", ""))
    if "reduceToBoundingBox.south" in c:
        out = out.bounding_box(*(c.getfloat(f"reduceToBoundingBox.{k}") for k in ("south", "north", "west", "east")))
    if "selectVariables" in c:
        out = out.select(*listed(c["selectVariables"]))
    return out.remove(*listed(c["removeVariable"])) if "removeVariable" in c else out


def _times(out: GridDataset, c, _) -> GridDataset:
    ends = [parse_time(c[k]) if k in c else None for k in ("start", "end")]
    return out.to_times(c["column"], time_values(c["timeSpec"], *ends), listed(c["variables"]))


def _interpolate(out: GridDataset, c, kinds) -> GridDataset:
    values, method = listed(c["variable"]), c.get("method", "nearestneighbor")
    source = tuple(float(v) for v in listed(c.get("source", "")))
    own = c.get("sourceProjString", "+proj=latlong")

    def each(data: GridDataset, key: str) -> GridDataset:
        if key not in c:
            return data
        kernel, df, keys = slab_process(c[key]), data.df, [d for d in data.dims if d not in (data.y, data.x)]
        for v in values:
            done = slabs.by_field(df, v, kernel, keys, data.x, data.y)
            df = df.drop(v).join(done, [*keys, data.y, data.x])
        return data.with_df(df)

    out = each(out, "preprocess")
    if "latitudeValues" in c:
        lats, lons = (axis_values(c[k]) for k in ("latitudeValues", "longitudeValues"))
        out = out.to_points(values, list(zip(lons, lats, strict=True)), source, own, method)
    elif "vcross" in c:
        out = out.cross_section(values, [tuple(float(v) for v in p.split()) for p in listed(c["vcross"])], source, own, method)
    elif "template" in c:
        out = out.like(values, kinds(c["template"], None, "lon"), source, own, method)
    else:
        axes = [axis_values(c[k]) for k in ("xAxisValues", "yAxisValues")]
        proj = c.get("projString")
        if method in ("coord_nearestneighbor", "coord_kdtree"):
            out = out.to_coordinates(values, *axes, c.getfloat("distanceOfInterest"), proj)
        else:
            out = out.to_grid(values, *axes, source, proj, own if proj else None, method)
    return each(out, "postprocess")


def _levels(out: GridDataset, c, _) -> GridDataset:
    out = out.with_df(derive.convert_by(out.df, *listed(c.get("dataConversion", ""))))
    return out.to_levels(F.col(c["axis"]), [float(v) for v in dotted(c["level1"])], listed(c["variables"]), c["dimension"], c.get("method", "linear")) if "level1" in c else out


def _merge(out: GridDataset, c, kinds) -> GridDataset:
    value = c["variable"]
    inner = GridDataset(kinds(c["inner.file"], c.get("inner.type"), value), out.dims, out.t, out.x, out.y)
    if "inner.cfg" in c:
        with open(c["inner.cfg"]) as f:
            inner = run_config(inner, f.read(), kinds)
    axes = [tuple(axis_values(c[f"{k}{a}"]) for a in ("XAxisValues", "YAxisValues")) if k else tuple(axis_values(c[a]) for a in ("xAxisValues", "yAxisValues")) for k in ("inner", "")]
    return out.nest(inner, value, *axes, *smoothing(c.get("smoothing", "LINEAR(5,2)")), c.get("method", "bilinear"))
