"""Near-duplicate embeddings by collision counting over one-dimensional projections.

Each of many tables sorts the vectors by a random projection, within cells that the signs of a few other projections give. Two
vectors collide in a table if they share the cell and one lies in the window around the other on the sorted projection. Pairs with
enough collisions over all tables are verified by their cosine in double precision.

Calibration: signs of a pair with cosine c agree with probability 1 - acos(c) / pi each, and its projections differ by a normal
variable of standard deviation |x - y|. The cells keep their expected size, so the number of signs grows with the logarithm of the
number of vectors; the number of tables is the least with which a pair at the very threshold reaches ``COLLISIONS`` with a
probability of ``RECALL``. Sorting without cells was ruled out: on 64 dimensions a window that a pair at the threshold hits 9
times in 10 holds 43 % of all other vectors, whatever their number, so that all counts are quadratic.

Every row carries its places in all tables, so a block of a cell can count a pair's collisions by itself, and only the block of
the first table in which the pair collides takes it up: no pair is ever written out. A pair that reaches the count collides in
one of the first ``tables - COLLISIONS + 1`` tables, so rows are posted in these only. A block returns each vector's number of links and
its least reachable vector, which is no more than it was given, however many pairs link. A cell of more than ``BLOCK`` rows is cut by a hash
into parts; each pair of parts is a block.

Equal vectors are one class, whatever their number, and enter the tables once.

Defined results: a vector that is null, empty or zero, or holds a null or a component that isn't finite, links with nothing.
Vectors of different lengths don't link. Repeated rows are further vectors. A null id is its own component. Input columns other than
the two are ignored. A cosine of exactly the threshold links. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, small, table

COSINE = 0.9
RECALL = 0.985
COLLISIONS = 2
#: Half-width of the windows, in units of a projection on a vector of normal variables.
WINDOW = 0.8
#: Vectors a cell should hold, were they spread evenly, and the most that one block holds of each of its two parts.
CELL, BLOCK = 2000, 4096
SEED = 20240501
#: Rows of a block whose cosines are computed at once, and pairs whose places are compared at once.
STRIP, PAIRS = 128, 1 << 14


def calibrate(n: int, cosine: float = COSINE, recall: float = RECALL, collisions: int = COLLISIONS) -> tuple[int, int]:
    """Signs per cell and tables for ``n`` vectors."""
    signs = min(30, max(0, math.ceil(math.log2(max(n, 1) / CELL))))
    p = (1 - math.acos(cosine) / math.pi) ** signs * math.erf(WINDOW / math.sqrt(2 * (2 - 2 * cosine)))
    tables = collisions
    while sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(collisions)) > 1 - recall:
        tables += 1
    return signs, tables


def classes(vectors: DataFrame, id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``(_id, _k1, _k2)``, keys null for vectors that can't link; and per distinct vector its least id, count and components."""
    v = F.col(f"`{vector}`")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    plain = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))  # one zero only
    rows = vectors.select(F.col(f"`{id}`").alias("_id"), F.when(good, plain).alias("_v"))
    rows = rows.withColumns({"_k1": F.when(F.col("_v").isNotNull(), F.xxhash64("_v")), "_k2": F.when(F.col("_v").isNotNull(), F.xxhash64(F.lit(1), "_v"))})
    one = rows.where("_v is not null").groupBy("_k1", "_k2").agg(F.min("_id").alias("id"), F.count("*").alias("n"), F.first("_v").alias("v"))
    return rows.drop("_v"), one.withColumn("node", F.monotonically_increasing_id())


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Tables:
    """Places of vectors in all tables: a cell and a projection in each."""

    def __init__(self, signs: int, tables: int):
        self.signs, self.tables, self.planes = signs, tables, {}

    def of(self, b: pa.RecordBatch, column: int):
        """Parts of a batch: row numbers, vectors, cells and projections (rows by tables)."""
        sizes = np.diff(b.column(column).offsets.to_numpy())
        flat, starts = b.column(column).flatten().to_numpy(), np.cumsum(sizes) - sizes
        for d in np.unique(sizes).tolist():
            if d not in self.planes:
                self.planes[d] = np.random.default_rng(SEED + d).standard_normal((d, self.tables * (self.signs + 1)))
            at = np.flatnonzero(sizes == d)
            for part in np.array_split(at, max(1, len(at) * self.tables // 100_000)):
                x = flat[starts[part][:, None] + np.arange(d)]
                p = (_unit(x) @ self.planes[d]).reshape(len(part), self.tables, self.signs + 1)
                yield part, x, (p[:, :, : self.signs] > 0) @ (1 << np.arange(self.signs, dtype=np.int64)) + (np.int64(d) << self.signs), p[:, :, self.signs].astype(np.float32)

    def sizes(self, used: int):
        """Rows (t, cell, size) of the first ``used`` tables, added up within batches."""

        def run(batches):
            for b in batches:
                for _, _, cells, _ in self.of(b, 0):
                    for t in range(used):
                        cell, n = np.unique(cells[:, t], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), t, np.int32)), pa.array(cell), pa.array(n)], names=["t", "cell", "size"])

        return run

    def rows(self, used: int):
        """Rows (t, cell, node, n, d, v, cells, places) of every vector in the first ``used`` tables."""

        def run(batches):
            for b in batches:
                node, n = b.column(0).to_numpy(), b.column(1).to_numpy()
                for part, x, cells, places in self.of(b, 2):
                    short = x.astype(np.float32)
                    vectors = short if (short == x).all() else x  # half the bytes where nothing is lost
                    blob = [pa.array([r.tobytes() for r in np.ascontiguousarray(m, np.int32 if m.dtype == np.int64 else m.dtype)], pa.binary()) for m in (vectors, cells & ((1 << self.signs) - 1), places)]
                    for t in range(used):
                        fixed = [np.full(len(part), t, np.int32), np.ascontiguousarray(cells[:, t]), node[part], n[part], np.full(len(part), x.shape[1], np.int32)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, fixed), *blob], names=["t", "cell", "node", "n", "d", "v", "cells", "places"])

        return run


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of ``a`` and ``b`` in a forest in which no parent is larger than its child."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    dot = lambda p, q: sum((p * q).tolist())  # noqa: E731 (one product after the other, as SQL adds them)
    return dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)))


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Vectors of length ``d``, each kept in single or in double precision, in double precision."""
    blobs = column.to_pylist()
    if all(len(v) == 4 * d for v in blobs):
        return np.frombuffer(b"".join(blobs), np.float32).reshape(-1, d).astype(np.float64)
    return np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * d else np.float64).astype(np.float64) for v in blobs])


def block(t: int, parts: tuple[int, int], rows: pa.Table, cosine: float, collisions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's rows: which have links whose first collision is in table ``t``, how many (equal vectors counted), and the row of the least node that they reach."""
    d = rows.column("d")[0].as_py()
    x = _matrix(rows.column("v"), d)
    cells = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.int32).reshape(len(x), -1)
    places = np.frombuffer(b"".join(rows.column("places").to_pylist()), np.float32).reshape(len(x), -1).astype(np.float64)
    n, side = rows.column("n").to_numpy(), rows.column("side").to_numpy()
    order = np.lexsort((rows.column("node").to_numpy(), places[:, t]))
    x, cells, places, n, side = x[order], cells[order], places[order], n[order], side[order]
    u, p = _unit(x), places[:, t]
    coarse = u.astype(np.float32)
    ends = np.searchsorted(p, p + (WINDOW + 1e-6), "right")
    linked, parent, found = np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), bool)
    for s in range(0, len(x), STRIP):
        e = min(s + STRIP, len(x))
        to = int(ends[e - 1])
        i, j = np.divmod(np.flatnonzero(coarse[s:e] @ coarse[s:to].T >= cosine - 1e-4), to - s)
        i, j = i + s, j + s
        keep = (j > i) & (j < ends[i])
        if parts[0] != parts[1]:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            both = (cells[a] == cells[b]) & (np.abs(places[a] - places[b]) <= WINDOW)
            counted = (both.sum(1) >= collisions) & (both.argmax(1) == t)
            a, b = a[counted], b[counted]
            cos = np.einsum("ij,ij->i", u[a], u[b])
            right = cos >= cosine
            for m in np.flatnonzero(np.abs(cos - cosine) < 1e-9).tolist():
                right[m] = _exact(x[a[m]], x[b[m]]) >= cosine
            a, b = a[right], b[right]
            linked += np.bincount(a, n[b], len(x)).astype(np.int64) + np.bincount(b, n[a], len(x)).astype(np.int64)
            found[a] = found[b] = True
            _join(parent, a, b)
    at = np.flatnonzero(found)
    return order[at], linked[at], order[parent[at]]


def links(spark: SparkSession, known: DataFrame, scratch: Scratch, cosine: float = COSINE) -> DataFrame:
    """``(node, linked, root)`` for each block and class with links in it: how many vectors of other classes, and a class reached by links."""
    signs, tables = calibrate(known.count(), cosine)
    used, places = tables - COLLISIONS + 1, Tables(signs, tables)
    # Cells beyond a block: at most one for each BLOCK rows.
    sizes = known.select("v").mapInArrow(places.sizes(used), "t int, cell long, size long").groupBy("t", "cell").agg(F.sum("size").alias("size"))
    large = scratch.write(sizes.where(f"size > {BLOCK}").selectExpr("t", "cell", f"cast(ceil(size / {BLOCK}) as int) as cuts"), "large")
    rows = known.select("node", "n", "v").mapInArrow(places.rows(used), "t int, cell long, node long, n long, d int, v binary, cells binary, places binary")
    rows = rows.join(small(large, large.count(), 32), ["t", "cell"], "left").withColumn("side", F.coalesce(F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"), F.lit(0)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)))
    rows = rows.select("t", "cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "n", "d", "v", "cells", "places")

    def run(key, group):
        t, _, i, j = (k.as_py() for k in key)
        at, linked, root = block(t, (i, j), group, cosine, COLLISIONS)
        node = group.column("node").to_numpy()
        return pa.table({"node": node[at], "linked": linked, "root": node[root]})

    return scratch.write(rows.groupBy("t", "cell", "i", "j").applyInArrow(run, "node long, linked long, root long"), "links")


def near_duplicates(spark: SparkSession, vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``id``, n_links, component_id (the smallest id reachable by links) and kept of each row."""
    scratch = Scratch(spark, "embeddings")
    rows, known = classes(vectors, id, vector)
    known = scratch.write(known, "classes")
    found = links(spark, known, scratch, cosine)
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    comp = known.join(components(spark, edges, scratch), "node", "left").join(linked, "node", "left")
    comp = scratch.write(comp.select("_k1", "_k2", "id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("comp", "node").alias("comp")), "comp")
    least = scratch.write(comp.groupBy("comp").agg(F.min("id").alias("component_id")), "least")
    out = rows.join(comp.join(least, "comp").select("_k1", "_k2", "n_links", "component_id"), ["_k1", "_k2"], "left")
    component = F.when(F.col("_id").isNull() | F.col("_k1").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def op3_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
