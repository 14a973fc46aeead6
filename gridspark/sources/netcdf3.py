"""NetCDF classic files (CDF-1, CDF-2 and CDF-5): a parser, a writer, and a Spark data source.

``spark.dataSource.register(NetCDF3)`` and ``spark.read.format("netcdf3").option("variable", "t2m").load(path)`` give a row per cell:
an index per dimension, the coordinate of each dimension that has one, and the value (unpacked, missing as null). Each partition reads
its own range of the outermost dimension from the file, so a file is read by many tasks and none holds it whole.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Type codes of the format, with numpy kinds and Spark types.
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
CODES = {v: k for k, v in KINDS.items()}
DIMENSION, VARIABLE, ATTRIBUTE = 0x0A, 0x0B, 0x0C


@dataclass
class Variable:
    name: str
    dims: list[str]
    attrs: dict
    kind: str
    begin: int = 0
    record: bool = False


@dataclass
class Header:
    dims: dict[str, int] = field(default_factory=dict)
    unlimited: str | None = None
    attrs: dict = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    record_size: int = 0

    def shape(self, v: Variable) -> list[int]:
        return [self.dims[d] for d in v.dims]


class _Reader:
    def __init__(self, f: BinaryIO):
        self.f = f
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF classic file")
        self.wide, self.offset = (">q" if magic[3] == 5 else ">i"), (">i" if magic[3] == 1 else ">q")

    def number(self, form: str | None = None) -> int:
        form = form or self.wide
        return struct.unpack(form, self.f.read(struct.calcsize(form)))[0]

    def name(self) -> str:
        n = self.number()
        text = self.f.read(n).decode()
        self.f.read(-n % 4)
        return text

    def attributes(self) -> dict:
        out = {}
        self.number(">i")
        for _ in range(self.number()):
            name, kind, n = self.name(), KINDS[self.number(">i")], self.number()
            raw = self.f.read(n * np.dtype(kind).itemsize)
            self.f.read(-len(raw) % 4)
            if kind == "S1":
                out[name] = raw.decode("utf-8", "replace").rstrip("\0")
            else:
                v = np.frombuffer(raw, kind).astype(np.dtype(kind).newbyteorder("=")).tolist()
                out[name] = v[0] if n == 1 else v
        return out


def read_header(f: BinaryIO, size: int | None = None) -> Header:
    r, h = _Reader(f), Header()
    records = r.number()
    r.number(">i")
    names = []
    for _ in range(r.number()):
        name, n = r.name(), r.number()
        names.append(name)
        h.dims[name] = n
        if n == 0:
            h.unlimited = name
    h.attrs = r.attributes()
    r.number(">i")
    for _ in range(r.number()):
        name = r.name()
        dims = [names[r.number()] for _ in range(r.number())]
        attrs, kind = r.attributes(), KINDS[r.number(">i")]
        r.number()
        v = Variable(name, dims, attrs, kind, r.number(r.offset), bool(dims) and dims[0] == h.unlimited)
        h.variables[name] = v
    moving = [v for v in h.variables.values() if v.record]
    sizes = [int(np.prod([h.dims[d] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(v.kind).itemsize for v in moving]
    h.record_size = sizes[0] if len(sizes) == 1 else sum(s + -s % 4 for s in sizes)
    if records < 0 and h.record_size and size is not None:  # still being written
        records = (size - min(v.begin for v in moving)) // h.record_size
    if h.unlimited:
        h.dims[h.unlimited] = max(records, 0)
    return h


def read_slab(f: BinaryIO, h: Header, v: Variable, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Positions start to stop of the outermost dimension, as stored."""
    shape, kind = h.shape(v), np.dtype(v.kind)
    if not shape:
        f.seek(v.begin)
        return np.frombuffer(f.read(kind.itemsize), kind)
    stop = shape[0] if stop is None else min(stop, shape[0])
    inner = int(np.prod(shape[1:], dtype=np.int64))
    if not v.record:
        f.seek(v.begin + start * inner * kind.itemsize)
        data = np.frombuffer(f.read((stop - start) * inner * kind.itemsize), kind)
    else:
        parts = []
        for k in range(start, stop):
            f.seek(v.begin + k * h.record_size)
            parts.append(np.frombuffer(f.read(inner * kind.itemsize), kind))
        data = np.concatenate(parts) if parts else np.zeros(0, kind)
    return data.reshape([max(stop - start, 0), *shape[1:]])


def physical(v: Variable, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unpacked values and where they are missing."""
    raw = data.astype(np.float64)
    bad = np.isnan(raw)
    for name in ("_FillValue", "missing_value"):
        if isinstance(v.attrs.get(name), (int, float)):
            bad |= raw == v.attrs[name]
    return raw * v.attrs.get("scale_factor", 1.0) + v.attrs.get("add_offset", 0.0), bad


def write(path: str, dims: dict[str, int], variables: Sequence[tuple[str, Sequence[str], dict, np.ndarray]], attrs: dict | None = None, unlimited: str | None = None) -> None:
    """A CDF-2 file; ``variables``: name, dimensions, attributes, values. Records of the unlimited dimension are interleaved."""
    names = list(dims)

    def text(s: str) -> bytes:
        b = s.encode()
        return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)

    def attributes(a: dict) -> bytes:
        if not a:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", ATTRIBUTE, len(a))
        for k, v in a.items():
            if isinstance(v, str):
                raw, code, n = v.encode(), 2, len(v.encode())
            else:
                x = np.atleast_1d(np.asarray(v))
                x = x.astype(">i4" if x.dtype.kind in "iu" and x.dtype.itemsize >= 4 else x.dtype.newbyteorder(">"))
                raw, code, n = x.tobytes(), CODES[x.dtype.str.replace("|", ">")], len(x)
            out += text(k) + struct.pack(">ii", code, n) + raw + b"\0" * (-len(raw) % 4)
        return out

    arrays = []
    for _, _, _, v in variables:
        x = np.asarray(v)
        if x.dtype.kind == "i" and x.dtype.itemsize == 8:
            x = x.astype(np.int32)
        arrays.append(x.astype(x.dtype.newbyteorder(">")))
    moving = [bool(d) and d[0] == unlimited for _, d, _, _ in variables]
    sizes = [x[0].nbytes if m and len(x) else x.nbytes for x, m in zip(arrays, moving, strict=True)]
    padded = [s if sum(moving) == 1 and m else s + -s % 4 for s, m in zip(sizes, moving, strict=True)]

    def header(begins: Sequence[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", dims[unlimited] if unlimited else 0)
        out += struct.pack(">ii", DIMENSION, len(dims)) if dims else struct.pack(">ii", 0, 0)
        for n, size in dims.items():
            out += text(n) + struct.pack(">i", 0 if n == unlimited else size)
        out += attributes(attrs or {})
        out += struct.pack(">ii", VARIABLE, len(variables)) if variables else struct.pack(">ii", 0, 0)
        for (n, d, a, _), x, size, begin in zip(variables, arrays, padded, begins, strict=True):
            out += text(n) + struct.pack(">i", len(d)) + b"".join(struct.pack(">i", names.index(k)) for k in d) + attributes(a)
            out += struct.pack(">ii", CODES[x.dtype.str.replace("|", ">")], size) + struct.pack(">q", begin)
        return out

    at = len(header([0] * len(variables)))
    begins = [0] * len(variables)
    for wanted in (False, True):
        for k, m in enumerate(moving):
            if m == wanted:
                begins[k] = at
                at += padded[k]
    with open(path, "wb") as f:
        f.write(header(begins))
        for x, m, p in zip(arrays, moving, padded, strict=True):
            if not m:
                f.write(x.tobytes().ljust(p, b"\0"))
        for t in range(dims[unlimited] if unlimited else 0):
            for x, m, p in zip(arrays, moving, padded, strict=True):
                if m:
                    f.write(x[t : t + 1].tobytes().ljust(p, b"\0"))


# --------------------------------------------------------------------------- Spark data source


def files_of(path: str) -> list[str]:
    """Files of a path, a folder, or a ``glob:`` pattern, in order of name; of paths on lines of their own, in that order."""
    if "\n" in path:
        return path.split("\n")
    if path.startswith("glob:"):
        return sorted(glob.glob(path[5:], recursive=True))
    path = path.removeprefix("file://")
    return sorted(os.path.join(path, n) for n in os.listdir(path) if not n.startswith((".", "_"))) if os.path.isdir(path) else [path]


@dataclass
class Slab(InputPartition):
    path: str
    start: int
    stop: int
    shift: int

    def __init__(self, path: str, start: int, stop: int, shift: int):
        super().__init__(None)
        self.path, self.start, self.stop, self.shift = path, start, stop, shift


class NetCDF3(DataSource):
    """Options: path (file, folder or ``glob:`` pattern; the files are joined along the outermost dimension), variable, rows (cells per partition)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def _first(self) -> tuple[Header, Variable]:
        path = files_of(self.options["path"])[0]
        with open(path, "rb") as f:
            h = read_header(f, os.path.getsize(path))
        return h, h.variables[self.options["variable"]]

    def schema(self) -> T.StructType:
        h, v = self._first()
        out = [T.StructField(d, T.IntegerType()) for d in v.dims]
        out += [T.StructField(f"{d}_value", T.DoubleType()) for d in v.dims if d in h.variables and h.variables[d].dims == [d]]
        return T.StructType(out if v.name in v.dims else [*out, T.StructField(v.name, T.DoubleType())])  # an axis has its values beside it

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Source(self.options["path"], self.options["variable"], int(self.options.get("rows", 1 << 20)), schema)


class _Source(DataSourceReader):
    def __init__(self, path: str, variable: str, rows: int, schema: T.StructType):
        self.path, self.variable, self.rows, self.out = path, variable, rows, schema

    def partitions(self) -> Sequence[InputPartition]:
        out, shift = [], 0
        for path in files_of(self.path):
            with open(path, "rb") as f:
                h = read_header(f, os.path.getsize(path))
            shape = h.shape(h.variables[self.variable]) or [1]
            step = max(1, self.rows // max(1, int(np.prod(shape[1:], dtype=np.int64))))
            out += [Slab(path, k, min(k + step, shape[0]), shift) for k in range(0, shape[0], step)]
            shift += shape[0]
        return out

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            h = read_header(f, os.path.getsize(partition.path))
            v = h.variables[self.variable]
            data, bad = physical(v, read_slab(f, h, v, partition.start, partition.stop))
            index = np.indices(data.shape).reshape(data.ndim, -1) if v.dims else np.zeros((0, data.size), int)
            columns = {}
            for k, d in enumerate(v.dims):
                at = index[k] + (partition.start if k == 0 else 0)
                if f"{d}_value" in self.out.names:
                    columns[f"{d}_value"] = pa.array(read_slab(f, h, h.variables[d]).astype(float)[at])
                columns[d] = pa.array((at + (partition.shift if k == 0 else 0)).astype(np.int32))
        if v.name not in v.dims:
            columns[v.name] = pa.array(data.ravel(), mask=bad.ravel())
        yield pa.RecordBatch.from_arrays([columns[n] for n in self.out.names], names=self.out.names)
