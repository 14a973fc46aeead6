"""What the operators share: tables, scratch tables in the shared folder, components, and byte-level word hashing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of whole texts that a Python worker gets at once in writes to scratch tables.
TEXT_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; read by Spark only, so any path that Spark resolves will do."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


# --------------------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where it is unset, and only in local mode, a temporary folder is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        got = sc._jsc.sc().getCheckpointDir()
        if got.isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridspark-"))
            got = sc._jsc.sc().getCheckpointDir()
        where = got.get()
    return where.rstrip("/")


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes folders in whatever file system they are; missing ones do no harm."""
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written to the shared folder; they cut lineage and survive lost executors.

    ``write`` returns the table read again. ``drop`` deletes one that nothing reads any more; what is left goes when the
    driver ends, since results that are still to be run may read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gridspark-{name}-{uuid.uuid4().hex}"
        self._named: list[str] = []
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    @contextlib.contextmanager
    def _batches(self, rows: int | None):
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        try:
            self.spark.conf.set(key, str(rows or before))
            yield
        finally:
            self.spark.conf.set(key, before)

    def write(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """``batch``: rows per Arrow batch in this write, where rows are long."""
        path = self.path(name)
        with self._batches(batch):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def write_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """As ``write``, in buckets of ``key``: what groups or joins by the key afterwards need not shuffle this side."""
        called = f"gridspark_{name}_{uuid.uuid4().hex}"
        with self._batches(TEXT_ROWS):
            df.write.option("compression", "zstd").option("path", self.path(name)).bucketBy(buckets, key).saveAsTable(called)
        self._named.append(called)
        return self.spark.table(called)

    def drop(self, *tables: DataFrame | None) -> None:
        delete(self.spark, *(t._scratch_path for t in tables if t is not None))

    def _end(self) -> None:
        try:
            for called in self._named:
                self.spark.sql(f"drop table if exists {called}")
            delete(self.spark, self.root)
        except Exception:  # the session may be gone already
            pass


def small(df: DataFrame, rows: int, bytes_per_row: int, limit: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows prove it to be under ``limit`` bytes, else as it is (a shuffle join)."""
    return F.broadcast(df) if rows * bytes_per_row <= limit else df


def split_join(spark: SparkSession, left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, rows: int, by: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``key``; left rows of a frequent key are dealt over several partitions.

    ``sizes(key, n)`` are rows of ``left`` for each key and ``rows`` is their sum, or more. A key is frequent if it has more than an even share
    of a partition. There are fewer such keys than partitions, which bounds what is broadcast, and each is cut into shares by a
    hash of ``by``. ``how``: inner, left or left_semi.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, -(-rows // parts))
    hot = F.broadcast(sizes.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("_cuts")))
    cut = left.join(hot, key, "left").withColumn("_cut", F.coalesce(F.pmod(F.xxhash64(by), F.col("_cuts")).cast("int"), F.lit(0))).drop("_cuts")
    copies = right.join(hot, key, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), F.coalesce("_cuts", F.lit(1)) - 1))).drop("_cuts")
    return cut.join(copies, [key, "_cut"], how).drop("_cut")


# --------------------------------------------------------------------------- components


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large and small stars.

    Returns ``(node, comp)``: each node of an edge with the smallest node it can reach. Every round is joins and partial
    aggregates only; a hub's neighbours are neither gathered into one row nor joined in one partition. Rounds are written to the
    shared folder. No edges: no rows.
    """
    known = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    known = scratch.write(known, "cc")
    state = None
    n = known.count()
    while True:
        both = known.union(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Both uses of the aggregate name all its columns, so that they share one exchange.
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        star = split_join(spark, both, least.where("n > 0").select("u", F.least("u", "m").alias("m")), "u", least.where("m is not null").select("u", "n"), 2 * n, "v")
        large = scratch.write(star.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        # Small star: below each node only its smaller neighbours remain after the large star, as u > v in every edge.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        down = split_join(spark, large, least.where("n > 0").select("u", "m"), "u", least.where("m is not null").select("u", "n"), 2 * n, "v")
        star = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.write(star, "cc")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        n = now[0]
        scratch.drop(known, large)
        known = new
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = known.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return known.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)


# --------------------------------------------------------------------------- text as bytes

_B = np.uint64(0x9E3779B97F4A7C55)  # odd, so that it has an inverse modulo 2**64
_BI = np.uint64(pow(int(_B), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits each depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["b"]) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("b", _B), ("i", _BI)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["b"], _POWERS["i"]


class Chunk:
    """Some documents' UTF-8 bytes end to end, their words, and 64-bit hashes of byte ranges.

    A word is a run of bytes other than 0x20 and 0x09-0x0D inside one document. Ranges' hashes are polynomial prefix sums, so a
    whole chunk takes a few vector operations. Two different ranges share a hash with a probability of about 2**-64.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.raw, self.offsets = data, offsets
        self.data = LOWER[data] if lower else data
        self.space = SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        word = ~self.space
        before = np.concatenate(([True], self.space[:-1])) | edge[:-1] if len(data) else np.zeros(0, bool)
        after = np.concatenate((self.space[1:], [True])) | edge[1:] if len(data) else np.zeros(0, bool)
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each document's words, and one past the last
        self.n_words = np.diff(self.first)
        self._sums = None

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each range."""
        b, inverse = _powers(len(self.data))
        if self._sums is None:
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * b[: len(self.data)])))
        return mix((self._sums[ends] - self._sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def words(self) -> np.ndarray:
        return self.ranges(self.starts, self.ends)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flags, one for each byte, each document has."""
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)))
        return np.diff(sums[self.offsets])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)


def chunks(column: pa.Array, limit: int = 1 << 20, lower: bool = False) -> Iterator[tuple[int, int, Chunk]]:
    """Row ranges of a string column with at most ``limit`` bytes each (one row at least), nulls as empty."""
    column = column.fill_null("") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield at, to, Chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add, in any letter case: an operator's output replaces them."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


def arrow_map(df: DataFrame, text: str, fn, fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """``fn(text column) -> list of arrays`` over record batches; ``keep`` (default all) columns go along, new ones replace their namesakes."""
    names = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    at = df.columns.index(text)
    spots = [df.columns.index(c) for c in kept]

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in spots), *fn(b.column(at))], names=[*kept, *names])

    return df.mapInArrow(run, schema)
