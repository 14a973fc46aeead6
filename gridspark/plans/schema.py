"""Dataset schemas: dimensions, variables, attributes; roles of axes; editing; NcML text."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from copy import deepcopy
from dataclasses import dataclass, field

from ..functions.units import convertible, is_time


@dataclass
class Var:
    kind: str = "double"
    dims: list[str] = field(default_factory=list)
    attrs: dict = field(default_factory=dict)


@dataclass
class GridSchema:
    dims: dict[str, int] = field(default_factory=dict)
    unlimited: str | None = None
    variables: dict[str, Var] = field(default_factory=dict)
    attrs: dict = field(default_factory=dict)

    def role(self, name: str) -> str | None:
        """What an axis is: time, reference_time, realization, lon, lat, x, y, pressure, height, depth or z."""
        v = self.variables.get(name)
        if v is None:
            return None
        std, units, axis = (str(v.attrs.get(k, "")) for k in ("standard_name", "units", "axis"))
        if std == "forecast_reference_time":
            return "reference_time"
        if std == "time" or is_time(units) or axis == "T":
            return "time"
        if std == "realization":
            return "realization"
        if std == "longitude" or re.fullmatch(r"degrees?_?E(ast)?", units, re.I):
            return "lon"
        if std == "latitude" or re.fullmatch(r"degrees?_?N(orth)?", units, re.I):
            return "lat"
        if std in ("projection_x_coordinate", "grid_longitude") or axis == "X":
            return "x"
        if std in ("projection_y_coordinate", "grid_latitude") or axis == "Y":
            return "y"
        if std == "depth" or (v.attrs.get("positive") == "down" and units and convertible(units, "m")):
            return "depth"
        if units and convertible(units, "hPa") and units not in ("1", ""):
            return "pressure"
        if std in ("height", "altitude"):
            return "height"
        return "z" if "formula_terms" in v.attrs or axis == "Z" or "positive" in v.attrs else None

    def auxiliary(self, names) -> list[str]:
        """Variables that the named ones refer to: their axes, coordinates, grid mapping, formula terms, and what those need."""
        out, todo = [], list(names)
        while todo:
            v = self.variables.get(n := todo.pop())
            if v is None:
                continue
            out.append(n)
            more = [*v.dims, *str(v.attrs.get("coordinates", "")).split(), *str(v.attrs.get("grid_mapping", "")).split(), *re.findall(r":\s*(\S+)", str(v.attrs.get("formula_terms", "")))]
            todo += [m for m in more if m in self.variables and m not in out and m not in todo]
        return [n for n in self.variables if n in out]

    def find(self, dims=(), **patterns: str) -> list[str]:
        """Variables with attributes that match, on all of ``dims``."""
        ok = lambda v: all(k in v.attrs and re.fullmatch(p, str(v.attrs[k])) for k, p in patterns.items()) and set(dims) <= set(v.dims)
        return [n for n, v in self.variables.items() if ok(v)]

    def edited(self, remove=(), rename_dims=None, rename=None, retype=None, attributes=None, remove_attributes=(), unlimited=None) -> GridSchema:
        """A changed copy. Removals come first, then dimensions, then variables, kinds and attributes."""
        s = deepcopy(self)
        for n in remove:
            s.variables.pop(n, None)
        for var, name in remove_attributes:
            (s.attrs if var is None else s.variables[var].attrs).pop(name, None)
        for old, new in (rename_dims or {}).items():
            s.dims = {new if d == old else d: n for d, n in s.dims.items()}
            s.unlimited = new if s.unlimited == old else s.unlimited
            for v in s.variables.values():
                v.dims = [new if d == old else d for d in v.dims]
        for old, new in (rename or {}).items():
            s.variables = {new if n == old else n: v for n, v in s.variables.items()}
        for n, kind in (retype or {}).items():
            s.variables[n].kind = kind
        for (var, name), value in (attributes or {}).items():
            (s.attrs if var is None else s.variables[var].attrs)[name] = value
        if unlimited is not None:
            s.unlimited = unlimited or None
        return s

    def without_unused_dims(self) -> GridSchema:
        s = deepcopy(self)
        used = {d for v in s.variables.values() for d in v.dims}
        s.dims = {d: n for d, n in s.dims.items() if d in used}
        return s

    def to_ncml(self) -> str:
        root = ET.Element("netcdf", xmlns="http://www.unidata.ucar.edu/namespaces/netcdf/ncml-2.2")
        for d, n in self.dims.items():
            ET.SubElement(root, "dimension", name=d, length=str(n), **({"isUnlimited": "true"} if d == self.unlimited else {}))
        put = lambda at, a: [ET.SubElement(at, "attribute", name=k, value=" ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v), **({} if isinstance(v, str) else {"type": "int" if isinstance(v, int) else "double"})) for k, v in a.items()]
        put(root, self.attrs)
        for n, v in self.variables.items():
            put(ET.SubElement(root, "variable", name=n, type=v.kind, shape=" ".join(v.dims)), v.attrs)
        ET.indent(root)
        return ET.tostring(root, encoding="unicode")


def _attribute(e: ET.Element):
    text, kind = e.get("value", e.text or ""), e.get("type", "string").lower()
    if kind in ("string", "char"):
        return text
    parts = [(int if kind in ("byte", "short", "int", "long") else float)(x) for x in text.split(e.get("separator"))]
    return parts[0] if len(parts) == 1 else parts


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def apply_ncml(text: str, base: GridSchema | None = None) -> GridSchema:
    """A schema from NcML, as a view of ``base`` or standing alone. Groups are not supported."""
    root, s = ET.fromstring(text), deepcopy(base) if base else GridSchema()
    kids = list(root)
    if any(_tag(e) == "group" for e in kids):
        raise ValueError("groups are not supported")
    for e in kids:
        if _tag(e) == "remove":
            name, kind = e.get("name"), e.get("type")
            if kind == "variable":
                s.variables.pop(name, None)
            elif kind == "dimension":
                s.dims.pop(name, None)
            elif kind == "attribute":
                s.attrs.pop(name, None)
    for e in kids:
        if _tag(e) == "dimension":
            name, old = e.get("name"), e.get("orgName")
            if old:
                s = s.edited(rename_dims={old: name})
            if e.get("length"):
                s.dims[name] = int(e.get("length"))
            if e.get("isUnlimited"):
                s.unlimited = name if e.get("isUnlimited") == "true" else None if s.unlimited == name else s.unlimited
    for e in kids:
        if _tag(e) == "variable":
            name, old = e.get("name"), e.get("orgName")
            if old:
                s = s.edited(rename={old: name})
            v = s.variables.setdefault(name, Var())
            v.kind = e.get("type", v.kind)
            v.dims = e.get("shape").split() if e.get("shape") is not None else v.dims
            for a in e:
                if _tag(a) == "remove":
                    v.attrs.pop(a.get("name"), None)
                elif _tag(a) == "attribute":
                    if a.get("orgName"):
                        v.attrs[a.get("name")] = v.attrs.pop(a.get("orgName"))
                    if a.get("value") is not None or a.text:
                        v.attrs[a.get("name")] = _attribute(a)
        elif _tag(e) == "attribute":
            s.attrs[e.get("name")] = _attribute(e)
    return s


def aggregation(text: str) -> dict:
    """An NcML aggregation element: type, dimension, variables, locations with coordinates, and scans."""
    root = ET.fromstring(text)
    e = root if _tag(root) == "aggregation" else next(x for x in root.iter() if _tag(x) == "aggregation")
    if e.get("type") not in ("joinExisting", "joinNew", "union"):
        raise ValueError(f"unknown aggregation {e.get('type')!r}")
    out = {"type": e.get("type"), "dim": e.get("dimName"), "variables": [], "parts": [], "scans": []}
    for x in e:
        if _tag(x) == "netcdf":
            out["parts"].append((x.get("location"), x.get("coordValue")))
        elif _tag(x) == "variableAgg":
            out["variables"].append(x.get("name"))
        elif _tag(x) == "scan":
            out["scans"].append({k: x.get(k) for k in ("location", "suffix", "regExp", "subdirs") if x.get(k)})
    return out
