"""Datasets opened from NcML: files with changed names, kinds and values, and aggregations of them, read one variable at a time."""

from __future__ import annotations

import math
import os
import re
import warnings
import xml.etree.ElementTree as ET
from collections.abc import Callable, Sequence
from copy import deepcopy
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pack
from ..functions.sizes import small
from ..operators.combine import union
from ..sources import netcdf3
from .dataset import GridDataset, read
from .schema import GridSchema, Var, _tag, aggregation, apply_ncml

WHOLE = ("byte", "short", "int", "long")


@dataclass(frozen=True)
class Opened:
    """``cells(name)`` gives a row per cell of a variable: its dimensions' positions and ``value``. ``path`` is set for a plain NetCDF file."""

    schema: GridSchema
    cells: Callable[[str], DataFrame]
    path: str | None = None

    def dataset(self, *names: str) -> GridDataset:
        """Variables on the same dimensions, with a ``<dimension>_value`` column for each dimension that has a coordinate variable."""
        dims = self.schema.variables[names[0]].dims
        if any(set(self.schema.variables[n].dims) != set(dims) or n in dims for n in names):
            raise ValueError(f"{', '.join(names)} are not variables on the same dimensions")
        df = union([self.cells(n).withColumnRenamed("value", n) for n in names], dims)
        for d in dims:
            axis = self.schema.variables.get(d)
            if axis is not None and axis.dims == [d]:
                df = df.join(small(self.cells(d).withColumnRenamed("value", f"{d}_value")), d, "left")
        unlimited = self.schema.unlimited
        return GridDataset(df, tuple(dims), t=unlimited if unlimited in dims else None)


def schema_of(path: str) -> GridSchema:
    """The schema of a NetCDF classic file."""
    with open(path, "rb") as f:
        h = netcdf3.read_header(f, os.path.getsize(path))
    kinds = {">i1": "byte", "S1": "char", ">i2": "short", ">i4": "int", ">f4": "float", ">f8": "double", ">u1": "byte", ">u2": "short", ">u4": "int", ">i8": "long", ">u8": "long"}
    return GridSchema(dict(h.dims), h.unlimited, {n: Var(kinds[v.kind], v.dims, v.attrs) for n, v in h.variables.items()}, h.attrs)


def _file_cells(spark: SparkSession, path: str, name: str, dims: Sequence[str]) -> DataFrame:
    value = f"{name}_value" if name in dims else name
    return read(spark, path, "netcdf3", name).select(*dims, F.col(value).alias("value"))


def open_file(spark: SparkSession, path: str) -> Opened:
    schema = schema_of(path)
    return Opened(schema, lambda name: _file_cells(spark, path, name, schema.variables[name].dims), path)


def _grid(spark: SparkSession, dims: Sequence[str], lengths: Sequence[int]) -> DataFrame:
    """All cells in row order; ``id`` is a cell's place."""
    out, step = spark.range(math.prod(lengths)), math.prod(lengths)
    for d, n in zip(dims, lengths, strict=True):
        step //= max(n, 1)
        out = out.withColumn(d, F.expr(f"(id div {max(step, 1)}) % {max(n, 1)}").cast("int"))
    return out


def _listed(spark: SparkSession, dims: Sequence[str], lengths: Sequence[int], values: Sequence) -> DataFrame:
    text = any(isinstance(v, str) for v in values)
    table = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"id long, value {'string' if text else 'double'}")
    return _grid(spark, dims, lengths).join(table, "id").select(*dims, "value")


def _blank(spark: SparkSession, dims: Sequence[str], lengths: Sequence[int]) -> DataFrame:
    return _grid(spark, dims, lengths).select(*dims, F.lit(None).cast("double").alias("value"))


def _numbers(values: Sequence[str]) -> list:
    """Numbers if all are, else the texts."""
    try:
        return [float(v) for v in values]
    except ValueError:
        return list(values)


# --------------------------------------------------------------------------- opening


def open_ncml(spark: SparkSession, text: str, folder: str = "") -> Opened:
    """A dataset from NcML text; paths that are not absolute are taken from ``folder``.

    A ``netcdf`` element has a location, one aggregation, or neither (a schema of its own), and changes what it finds: removals, new
    names, attributes, kinds (whole-number kinds round) and ``values``. Several aggregations beside each other are passed over with a
    warning, as are scanned files that can't be read. ValueError: an unknown aggregation, a wrong number of values.
    """
    return _element(spark, ET.fromstring(text), folder)


def _element(spark: SparkSession, root: ET.Element, folder: str) -> Opened:
    found = [e for e in root if _tag(e) == "aggregation"]
    if len(found) > 1:
        warnings.warn("several aggregations: none is read", stacklevel=2)
    if len(found) == 1:
        base = _aggregated(spark, found[0], folder)
    elif root.get("location") and not found:
        base = _located(spark, root.get("location"), folder)
    else:
        base = Opened(GridSchema(), lambda name: _no_data(name))
    return _changed(spark, base, root)


def _no_data(name: str) -> DataFrame:
    raise ValueError(f"{name} has no data")


def _located(spark: SparkSession, location: str, folder: str) -> Opened:
    path, *kind = location.split()
    path = os.path.join(folder, path.removeprefix("file://").removeprefix("file:"))
    if kind[:1] == ["ncml"]:
        with open(path) as f:
            return open_ncml(spark, f.read(), os.path.dirname(path))
    return open_file(spark, path)


def _changed(spark: SparkSession, base: Opened, root: ET.Element) -> Opened:
    view = [e for e in root if _tag(e) != "aggregation"]
    if not view:
        return base
    schema = apply_ncml(ET.tostring(root, encoding="unicode"), base.schema)
    variables = [e for e in view if _tag(e) == "variable"]
    old_name = {e.get("name"): e.get("orgName") for e in variables if e.get("orgName")}
    new_dim = {e.get("orgName"): e.get("name") for e in view if _tag(e) == "dimension" and e.get("orgName")}
    rounded = {e.get("name") for e in variables if e.get("type", "").lower() in WHOLE}
    values = {e.get("name"): v for e in variables for v in e if _tag(v) == "values"}
    given = {n: _values(v, n, schema) for n, v in values.items()}

    def cells(name: str) -> DataFrame:
        v = schema.variables[name]
        lengths = [schema.dims[d] for d in v.dims]
        if name in given:
            start, step, listed = given[name]
            if listed is not None:
                return _listed(spark, v.dims, lengths, listed)
            return _grid(spark, v.dims, lengths).select(*v.dims, (F.lit(start) + step * F.col("id")).alias("value"))
        source = old_name.get(name, name)
        if source not in base.schema.variables:
            return _no_data(name)
        df = base.cells(source)
        df = df.select(*(F.col(d).alias(new_dim.get(d, d)) for d in base.schema.variables[source].dims), "value")
        if name in rounded:
            scale, offset = (float(v.attrs.get(k, z)) for k, z in (("scale_factor", 1), ("add_offset", 0)))
            df = df.withColumn("value", pack(F.col("value"), scale, offset, kind="long") * scale + offset)
        return df

    return Opened(schema, cells)


def _values(e: ET.Element, name: str, schema: GridSchema) -> tuple[float, float, list | None]:
    start, step, text = e.get("start"), e.get("increment"), (e.text or "").strip()
    if (start is None) != (step is None) or (start is not None) == bool(text):
        raise ValueError(f"values of {name}: either start and increment, or a list")
    if start is not None:
        return float(start), float(step), None
    v = schema.variables[name]
    listed = [x.strip() for x in text.split(e.get("separator"))]
    if len(listed) != math.prod(schema.dims[d] for d in v.dims):
        raise ValueError(f"{len(listed)} values for {name} with the dimensions {v.dims}")
    return 0.0, 0.0, listed if v.kind.lower() in ("string", "char") else [float(x) for x in listed]


# --------------------------------------------------------------------------- aggregations


def scanned(folder: str, pattern: str, subdirs: bool = True) -> list[str]:
    """Files below a folder whose names match as a whole, in order of path."""
    out = []
    for at, below, names in os.walk(folder):
        below.sort()
        out += [os.path.join(at, n) for n in names if re.fullmatch(pattern, n)]
        if not subdirs:
            break
    return sorted(out)


def _aggregated(spark: SparkSession, e: ET.Element, folder: str) -> Opened:
    a = aggregation(ET.tostring(e, encoding="unicode"))
    parts = [(_element(spark, x, folder), x.get("coordValue")) for x in e if _tag(x) == "netcdf"]
    for s in a["scans"]:
        at, *kind = s["location"].split()
        pattern = f".*{re.escape(s['suffix'])}" if s.get("suffix") else s.get("regExp", "")
        for path in scanned(os.path.join(folder, at), pattern, s.get("subdirs", "").lower() != "false"):
            try:
                parts.append((_located(spark, " ".join([path, *kind]), ""), None))
            except (OSError, ValueError) as error:
                warnings.warn(f"{path} can't be read: {error}", stacklevel=2)
    if not parts:
        return Opened(GridSchema(), _no_data)
    opened, coordinates = [p for p, _ in parts], [c for _, c in parts]
    if a["type"] == "joinExisting":
        return joined(spark, opened, coordinates)
    if a["type"] == "joinNew":
        return stacked(spark, opened, a["dim"], a["variables"], coordinates)
    return united(spark, opened)


def _agrees(schema: GridSchema, part: GridSchema, name: str, but: str | None = None) -> bool:
    """Whether a part has the variable on the same dimensions of the same lengths."""
    v, w = schema.variables[name], part.variables.get(name)
    return w is not None and v.dims == w.dims and all(schema.dims[d] == part.dims[d] for d in v.dims if d != but)


def _take_rest(schema: GridSchema, owner: dict[str, int], k: int, part: GridSchema, joined_names: set[str]) -> None:
    """Adds a part's variables that no part before had and whose dimensions fit; others are left out."""
    for n, v in part.variables.items():
        if n in joined_names or n in owner:
            continue
        known = [d for d in v.dims if d in schema.dims]
        fits = all(schema.dims[d] == part.dims[d] and (d == schema.unlimited) == (d == part.unlimited) for d in known)
        fresh = [d for d in v.dims if d not in schema.dims]
        if not fits or (part.unlimited in fresh and schema.unlimited):
            warnings.warn(f"{n} of part {k} is on other dimensions and left out", stacklevel=2)
            continue
        for d in fresh:
            schema.dims[d] = part.dims[d]
            schema.unlimited = d if d == part.unlimited else schema.unlimited
        schema.variables[n], owner[n] = deepcopy(v), k


def united(spark: SparkSession, parts: Sequence[Opened]) -> Opened:
    """All variables of all parts, each from the first part that has it."""
    schema, owner = GridSchema(dict(parts[0].schema.dims), parts[0].schema.unlimited, {}, dict(parts[0].schema.attrs)), {}
    for k, p in enumerate(parts):
        _take_rest(schema, owner, k, p.schema, set())
    return Opened(schema, lambda name: parts[owner[name]].cells(name))


def joined(spark: SparkSession, parts: Sequence[Opened], coordinates: Sequence[str | None]) -> Opened:
    """Parts end to end along the unlimited dimension: missing values where a part lacks a variable or has it on other dimensions.

    ``coordinates``: each part's values of the dimension's variable, separated by white space or commas; all parts have them or none.
    """
    t = next((p.schema.unlimited for p in parts if p.schema.unlimited), None)
    lengths = [p.schema.dims[t] if t and p.schema.unlimited == t else 0 for p in parts]
    axis: list[str] = []
    for n, c in zip(lengths, coordinates, strict=True):
        own = re.split(r"[\s,]+", c.strip()) if c and n else []
        if own and len(own) != n:
            raise ValueError(f"expected {n} but found {len(own)} coordinates in {c!r}")
        axis += own
    if axis and len(axis) != sum(lengths):
        raise ValueError("some parts have coordinates and others have none")
    schema, names, owner = GridSchema(dict(parts[0].schema.dims), t, {}, dict(parts[0].schema.attrs)), set(), {}
    for k, (p, n) in enumerate(zip(parts, lengths, strict=True)):
        s = p.schema
        for name, v in s.variables.items():
            if n and t in v.dims and name not in schema.variables and all(schema.dims.get(d, s.dims[d]) == s.dims[d] for d in v.dims if d != t):
                schema.dims.update({d: s.dims[d] for d in v.dims if d not in schema.dims})
                schema.variables[name] = deepcopy(v)
                names.add(name)
        _take_rest(schema, owner, k, GridSchema(s.dims, s.unlimited, {m: v for m, v in s.variables.items() if t is None or t not in v.dims}), names)
    if t:
        schema.dims[t] = sum(lengths)

    def cells(name: str) -> DataFrame:
        if name not in names:
            return parts[owner[name]].cells(name)
        v = schema.variables[name]
        if name == t and axis:
            return _listed(spark, v.dims, [schema.dims[t]], _numbers(axis))
        kind = lambda k: "blank" if not _agrees(schema, parts[k].schema, name, t) else "file" if parts[k].path and v.dims[0] == t else "own"
        pieces, shift = [], 0
        for what, run in groupby([k for k, n in enumerate(lengths) if n], kind):
            run = list(run)
            for some in [run] if what == "file" else [[k] for k in run]:
                n = sum(lengths[k] for k in some)
                if what == "file":  # neighbouring files are one read, however many
                    df = _file_cells(spark, "\n".join(parts[k].path for k in some), name, v.dims)
                elif what == "own":
                    df = parts[some[0]].cells(name)
                else:
                    df = _blank(spark, v.dims, [n if d == t else schema.dims[d] for d in v.dims])
                pieces.append(df.withColumn(t, (F.col(t) + shift).cast("int")))
                shift += n
        return reduce(DataFrame.unionByName, pieces)

    return Opened(schema, cells)


def stacked(spark: SparkSession, parts: Sequence[Opened], dim: str, variables: Sequence[str], coordinates: Sequence[str | None]) -> Opened:
    """The named variables along a new outer dimension, a place for each part; other variables as in a union.

    The dimension's variable has the coordinates, as numbers if all are; a part without one has ``location_`` and its number.
    """
    axis = _numbers([c or f"location_{k}" for k, c in enumerate(coordinates)])
    first = parts[0].schema
    schema, owner, inner = GridSchema(dict(first.dims), None, {}, dict(first.attrs)), {}, GridSchema(dict(first.dims))
    for k, p in enumerate(parts):
        s = p.schema
        for name in variables:
            if name in s.variables and name not in inner.variables and all(inner.dims.get(d, s.dims[d]) == s.dims[d] for d in s.variables[name].dims):
                inner.variables[name] = s.variables[name]
                inner.dims.update({d: s.dims[d] for d in s.variables[name].dims})
        schema.dims.update({d: n for d, n in inner.dims.items() if d not in schema.dims})
        _take_rest(schema, owner, k, GridSchema(s.dims, None, s.variables), set(variables))
    for name, v in inner.variables.items():
        schema.variables[name] = Var(v.kind, [dim, *v.dims], dict(v.attrs))
    schema.dims[dim], schema.unlimited = len(parts), dim
    schema.variables[dim] = Var("double" if isinstance(axis[0], float) else "string", [dim])

    def cells(name: str) -> DataFrame:
        if name == dim:
            return _listed(spark, [dim], [len(parts)], axis)
        if name not in inner.variables:
            return parts[owner[name]].cells(name)
        v = inner.variables[name]
        blank = lambda: _blank(spark, v.dims, [inner.dims[d] for d in v.dims])
        each = [p.cells(name) if _agrees(inner, p.schema, name) else blank() for p in parts]
        return reduce(DataFrame.unionByName, [df.withColumn(dim, F.lit(k)) for k, df in enumerate(each)]).select(dim, *v.dims, "value")

    return Opened(schema, cells)
