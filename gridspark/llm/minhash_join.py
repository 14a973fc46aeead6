"""MinHash near-duplicates by an inverted join over signature coordinates.

Every distinct shingle set (documents with equal sets are one class) has ``COORDINATES`` minimum hashes and is posted under each
coordinate-value pair. Two classes are candidates if they share ``LEAST`` coordinates or more. Three rules keep the join small
without losing a candidate:

* Pairs that only one class has are dropped; a class with fewer than ``LEAST`` other ones has no candidates.
* Prefixes: with a class's pairs ordered from rare to common, two classes that share ``LEAST`` of them share one among all but the
  last ``LEAST - 1``, so only these prefixes are joined, and very common pairs hardly ever are. The rest of the pairs is skipped;
  a candidate's collisions are counted on the two whole signatures.
* Groups: in each posting list, all are first compared with one hub. Those found in one component need no further links between
  them: a group of thousands of copies costs a star. What members of different components of a list remain are joined by the
  prefixes of their shingle sets, where copies with many changes of their own meet nobody.

Candidates are confirmed on their full shingle sets. ``LEAST`` is calibrated: at a similarity of exactly 0.75 a pair shares
fewer than 14 of 32 coordinates with a probability of about 1e-4, and less above.

Defined results: a null text, or one without words, has an empty set, is its own component and links with nothing. With fewer than
five words the whole sequence is the one shingle. Repeated rows share a component. A null id is its own component. Input columns
named like an output are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT_ROWS, Chunk, Scratch, arrow_map, chunks, components, mix, small, split_join, table

WORDS = 5
COORDINATES = 32
LEAST = 14
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 75

_WEIGHTS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_SHORT = mix(np.arange(101, 101 + WORDS, dtype=np.uint64))
_TURNS = mix(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(5001, 5001 + COORDINATES, dtype=np.uint64))


def shingles(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all shingles of a chunk and their documents' numbers, in order of documents."""
    h, doc = c.words(), c.doc_of_word()
    long = c.n_words >= WORDS
    out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= WORDS:
        n = len(h) - WORDS + 1
        w = np.zeros(n, np.uint64)
        for k in range(WORDS):
            w += h[k : k + n] * _WEIGHTS[k]
        at = np.flatnonzero(doc[:n] == doc[WORDS - 1 :])
        out, of = mix(w[at]), doc[at]
    short = np.flatnonzero(~long & (c.n_words > 0))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(WORDS - 1):
            has = c.n_words[short] > k
            whole[has] += h[c.first[short[has]] + k] * _WEIGHTS[k]
        out, of = np.concatenate((out, mix(whole + _SHORT[c.n_words[short]]))), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def _distinct(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the first of each (document, hash), in order of documents."""
    return np.sort(np.unique(mix(h + mix(doc.astype(np.uint64) + np.uint64(77))), return_index=True)[1])


def sign(column: pa.Array) -> list[pa.Array]:
    """n_shingles, two words of a digest of the set, and the signature (null for an empty set)."""
    counts, first, second, signatures = [], [], [], []
    for _, _, c in chunks(column, lower=True):
        h, doc = shingles(c)
        at = _distinct(h, doc)
        h, doc = h[at], doc[at]
        n = np.bincount(doc, minlength=len(c.n_words))
        full = np.flatnonzero(n)
        starts = np.searchsorted(doc, full)
        a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        sig = np.zeros((COORDINATES, len(n)), np.int64)
        if len(full):
            a[full], b[full] = np.add.reduceat(mix(h ^ np.uint64(0x5555)), starts), np.add.reduceat(mix(h + np.uint64(0x3333)), starts)
            for k in range(COORDINATES):
                sig[k, full] = np.minimum.reduceat(h * _TURNS[k] + _SHIFTS[k], starts).view(np.int64)
        counts.append(n)
        first.append(a.view(np.int64))
        second.append(b.view(np.int64))
        signatures += [s if k else None for s, k in zip(sig.T, n, strict=True)]
    cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64())
    return [cat(counts), cat(first), cat(second), pa.array(signatures, pa.list_(pa.int64()))]


def shingle_sets(column: pa.Array) -> list[pa.Array]:
    """Each text's sorted distinct shingle hashes, 8 bytes each."""
    out = []
    for _, _, c in chunks(column, lower=True):
        h, doc = shingles(c)
        cuts = np.searchsorted(doc, np.arange(len(c.n_words) + 1))
        out += [np.unique(h[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [pa.array(out, pa.binary())]


SIGNED = [T.StructField("n_shingles", T.LongType()), T.StructField("_s1", T.LongType()), T.StructField("_s2", T.LongType()), T.StructField("_sig", T.ArrayType(T.LongType()))]


class Join:
    """The join's steps over classes ``(node, n, sig, id, k1, k2)``, each on written tables."""

    def __init__(self, spark: SparkSession, docs: DataFrame, text: str, id: str):
        self.spark, self.scratch, self.text = spark, Scratch(spark, "minhash"), text
        t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        self.docs = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"), F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(1), t).alias("_k2"))
        self.signed = self.scratch.write(arrow_map(self.docs, "_text", sign, SIGNED, ["_id", "_k1", "_k2"]), "signed", TEXT_ROWS)
        one = self.signed.where("n_shingles > 0").groupBy("_s1", "_s2").agg(F.min("_id").alias("id"), F.first("_sig").alias("sig"), F.first("n_shingles").alias("n"), F.first(F.struct("_id", "_k1", "_k2")).alias("row"))
        self.classes = self.scratch.write(one.withColumn("node", F.monotonically_increasing_id()), "classes")

    def prefixes(self) -> DataFrame:
        """``(key, node, weight)``: each class under the pairs of its prefix; weight: how often all its pairs are posted."""
        posted = self.classes.select("node", F.posexplode("sig").alias("at", "value")).select("node", F.xxhash64("at", "value").alias("key"))
        shared = self.shared(posted, "key", COORDINATES * self.classes.count())
        ranked = shared.selectExpr("node", "key", "count(*) over (partition by node) as n", "sum(posts) over (partition by node) as weight", "row_number() over (partition by node order by posts, key) as rank")
        return self.scratch.write(ranked.where(f"n >= {LEAST} and rank <= n - {LEAST} + 1").select("key", "node", "weight"), "prefixes")

    def shared(self, posted: DataFrame, key: str, rows: int) -> DataFrame:
        """The ``rows`` rows of ``posted`` under keys that are posted twice or more, with their number ``posts``."""
        common = posted.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        return split_join(self.spark, posted, common.select(key, F.col("n").alias("posts")), key, common, rows, "node")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """``(node, set)`` of the nodes that can have links; texts are read again for these only."""
        wanted = self.scratch.write(nodes.join(self.classes, "node").select("node", F.col("row._id").alias("i"), F.col("row._k1").alias("k1"), F.col("row._k2").alias("k2")), "wanted")
        n = wanted.count()
        got = self.docs.join(small(wanted, n, 32), F.col("_id").eqNullSafe(F.col("i")) & (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")))
        got = arrow_map(got.select("node", "_text"), "_text", shingle_sets, [T.StructField("set", T.BinaryType())], ["node"])
        return self.scratch.write(got.dropDuplicates(["node"]), "sets", TEXT_ROWS)

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of ``pairs(hub, node)``, those with enough equal coordinates and a similarity of SIMILAR or more on the full sets, as ``(a, b)`` with a < b.

        A hub may be in very many pairs. Its pairs are dealt over partitions, and each partition is sent the hub's set once.
        """
        side = lambda c: self.classes.select(F.col("node").alias(c), F.col("sig").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
        sizes = pairs.groupBy("hub").agg(F.count("*").alias("n"))
        near = split_join(self.spark, pairs, side("hub"), "hub", sizes, pairs.count(), "node").join(side("node"), "node")
        equal = F.aggregate(F.zip_with("shub", "snode", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        near = near.where((100 * F.least("nhub", "nnode") >= SIMILAR * F.greatest("nhub", "nnode")) & (equal >= LEAST)).select("hub", "node")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        near = self.scratch.write(near.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int")), "near")
        # A hub's set comes first in each of its parts, then the other sets of the pairs.
        first = near.select("hub", "part").distinct().join(sets.withColumnRenamed("node", "hub"), "hub").select("hub", "part", F.lit(None).cast("long").alias("node"), "set")
        rows = first.union(near.join(sets, "node").select("hub", "part", "node", "set")).repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("node"))

        def keep(batches):
            hub = None
            for r in batches:
                a, b = [], []
                for h, node, x in zip(r.column(0).to_pylist(), r.column(2).to_pylist(), r.column(3), strict=True):
                    q = np.frombuffer(x.as_buffer(), np.uint64)
                    if node is None:
                        hub = q.copy()  # the batch's memory is given back
                        continue
                    common = len(hub) + len(q) - len(np.union1d(hub, q))
                    if 100 * common >= SIMILAR * (len(hub) + len(q) - common):
                        a.append(min(h, node))
                        b.append(max(h, node))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return self.scratch.write(rows.mapInArrow(keep, "a long, b long"), "links", TEXT_ROWS)

    def linked(self) -> DataFrame:
        """``(node, comp)`` of the classes with links."""
        lists = self.prefixes()
        sets = self.sets(lists.select("node").distinct())
        # The hub shares most with the others: of copies with few or many changes, one with few.
        hubs = lists.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"), F.count("*").alias("n"))
        posts, sizes = lists.count(), hubs.where("hub is not null").select("key", "n")
        star = split_join(self.spark, lists, hubs.where("n > 0").select("key", "hub"), "key", sizes, posts, "node").where("node <> hub").select("hub", "node").distinct()
        star = self.scratch.write(star, "star")
        links = self.confirmed(star, sets)
        found = self.scratch.write(components(self.spark, links, self.scratch), "found")
        # What is left: members of different components of a list; a list of two has been compared already.
        labelled = lists.join(found, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
        left = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low <> high and size > 2").select("key")
        left = self.scratch.write(split_join(self.spark, labelled, left, "key", sizes, posts, "node", "left_semi").select("node", "comp").distinct(), "left")
        seen = star.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node"))
        more = self.confirmed(self.scratch.write(self.by_shingles(left, sets).join(seen, ["hub", "node"], "left_anti"), "pairs"), sets)
        return components(self.spark, links.union(more), self.scratch)

    def by_shingles(self, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs ``(hub, node)``, the lesser node first, of ``nodes(node, comp)`` in different components that can reach SIMILAR, by the same join on the sets themselves.

        Of a set of n shingles, rare ones first, one among n - ceil(0.75 n) + 1 is shared with every similar set, and the first
        shared one leaves as many others as the two sizes ask for. A copy with many changes has its own shingles first, so what it
        shares comes too late in its order to meet anybody, however large its group.
        """

        def rows(batches):
            for r in batches:
                each = [np.frombuffer(x.as_buffer(), np.int64) for x in r.column(2)]
                n = np.array([len(x) for x in each], np.int64)
                for k in range(0, len(each), 256):
                    m = n[k : k + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(r.column(c).to_numpy()[k : k + 256], m)) for c in (0, 1)] + [pa.array(np.repeat(m, m)), pa.array(np.concatenate(each[k : k + 256]))], names=["node", "comp", "n", "shingle"])

        posted = nodes.join(sets, "node").select("node", "comp", "set").mapInArrow(rows, "node long, comp long, n long, shingle long")
        posted = self.scratch.write(posted, "shingles", TEXT_ROWS)
        ranked = self.shared(posted, "shingle", posted.count()).selectExpr("node", "comp", "n", "shingle", "n - count(*) over (partition by node) + row_number() over (partition by node order by posts, shingle) as rank")
        prefix = self.scratch.write(ranked.where(f"rank <= n - (n * {SIMILAR} + 99) div 100 + 1").select("shingle", "node", "comp", "n", "rank"), "prefix")
        self.scratch.drop(posted)
        # Most of a list is often one component; it needs no pairs of its own.
        sizes = prefix.groupBy("shingle", "comp").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("shingle").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("parts"), F.sum("size").alias("n")).where("parts > 1")
        sizes = largest.where("main is not null").select("shingle", "n")
        lists = self.scratch.write(split_join(self.spark, prefix, largest.where("n > 0").select("shingle", "main"), "shingle", sizes, prefix.count(), "node"), "lists")
        rest = lists.where("comp <> main").select("shingle", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("rank").alias("rx"))
        # The first shingle that two sets share leaves them enough others: those after it in both.
        enough = f"100 * least(n, nx) >= {SIMILAR} * greatest(n, nx) and {100 + SIMILAR} * (1 + least(n - rank, nx - rx)) >= {SIMILAR} * (n + nx)"
        return rest.join(lists, "shingle").where(f"comp <> cx and (comp = main or node > x) and {enough}").select(F.least("x", "node").alias("hub"), F.greatest("x", "node").alias("node")).distinct()

    def result(self) -> DataFrame:
        """``(_id, n_shingles, component_id)`` per row."""
        comp = self.classes.join(self.linked(), "node", "left").select("_s1", "_s2", "id", F.coalesce("comp", "node").alias("comp"))
        comp = self.scratch.write(comp, "comp")
        # Written, so that the join by component has exchanges of its own and Spark can split a large component.
        least = self.scratch.write(comp.groupBy("comp").agg(F.min("id").alias("component_id")), "least")
        out = self.signed.select("_id", "n_shingles", "_s1", "_s2").join(comp.join(least, "comp").select("_s1", "_s2", "component_id"), ["_s1", "_s2"], "left")
        own = F.col("_id").isNull() | (F.col("n_shingles") == 0)
        return out.select("_id", "n_shingles", F.when(own, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id``, n_shingles, component_id (the smallest id reachable by links) and kept of each row."""
    out = Join(spark, docs, text, id).result()
    return out.select(F.col("_id").alias(id), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` without those that are not the first of their component. Ids are taken to be unique; rows without one stay."""
    found = Scratch(spark, "dedup").write(near_duplicates(spark, docs, text, id).where("not kept").select(F.col(id).alias("_gone")).distinct(), "gone")
    return docs.join(small(found, found.count(), 16), docs[id] == F.col("_gone"), "left_anti")


def op7_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents", "doc_id", "text"))
