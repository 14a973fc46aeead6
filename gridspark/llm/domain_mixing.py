"""Mixing sources to target weights with soft membership.

A classifier learned from the labelled rows gives every document a posterior over domains (clean, toxic, low quality). Rates, how
many copies of each document the mixture takes on average, start at 1; projected gradients of a least-squares problem then change
them, never below 0, until the expected token total of each domain, the sum of tokens x posterior x rate over documents, meets its target.

With shares of all tokens as the weights of documents, and the inverse of the domains' overlap (without directions that the
posteriors hardly tell apart) as the weights of residuals, the problem's largest curvature is 1, so steps of length 1 never raise the error. A document's rate depends only on its posterior and on
the steps so far, a few numbers each; an iteration is one pass that sums them, and only sums by domain reach the driver. Tokens are words
between white space here, as the weights of documents; a text without white space weighs 1.

Defined results: a null or empty text has 0 tokens and no influence on the totals, but has a posterior and a rate. Labels without
both marks, or of ids not in the table, are left out; with fewer than two domains labelled, all documents have equal posteriors.
Repeated rows get equal rates, and equal copies if their ids are equal. A target of a domain without tokens can't be met; the error
is then the least possible. Input columns named like an output are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT_ROWS, Chunk, Scratch, arrow_map, chunks, mix, table

LOG = logging.getLogger(__name__)
DOMAINS = ("clean", "toxic", "low")
#: The classifier is fitted on so many labelled rows at most, the first in the order of a hash of their ids, and has so many words.
MAX_TRAIN = 4000
MAX_WORDS = 300
#: Weights of the domains in the mixture, and its tokens as a multiple of the input's.
WEIGHTS = {"clean": 0.9, "toxic": 0.02, "low": 0.08}
BUDGET = 1.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SHAPES = 6


def shapes(c: Chunk) -> np.ndarray:
    """Of each document marks of its shape: of signs, capitals, exclamations, repeated words, few words, and a constant."""
    n = np.maximum(c.n_words, 1)
    upper, lower = (c.raw >= 65) & (c.raw <= 90), (c.raw >= 97) & (c.raw <= 122)
    letters = np.maximum(c.per_doc(upper | lower), 1)
    h, doc = c.words(), c.doc_of_word()
    again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=len(n)) if len(h) > 1 else np.zeros(len(n))
    marks = [c.per_doc(_SYMBOL[c.raw]) / n > 0.2, c.per_doc(upper) / letters > 0.5, c.per_doc(c.raw == 0x21) / n > 0.2, again / n > 0.3, c.n_words < 50, np.ones(len(n), bool)]
    return np.stack(marks, axis=1).astype(float)


def distinct_words(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct words in lower case, and the documents' numbers."""
    h, doc = c.words(), c.doc_of_word()
    at = np.unique(mix(h + mix(doc.astype(np.uint64) + np.uint64(9))), return_index=True)[1]
    return h[at].view(np.int64), doc[at]


class Classifier:
    """Softmax regression on the presence of chosen words and on shapes."""

    def __init__(self, words: np.ndarray, weights: np.ndarray | None = None):
        self.words = np.sort(words.astype(np.int64))
        self.weights = weights
        self.absent = np.zeros(len(DOMAINS))  # a cost that rules out domains without labelled rows

    def features(self, c: Chunk) -> np.ndarray:
        x = np.zeros((len(c.n_words), len(self.words) + SHAPES))
        x[:, len(self.words) :] = shapes(c)
        if len(self.words):
            h, doc = c.words().view(np.int64), c.doc_of_word()
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            x[doc[hit], at[hit]] = 1
        return x

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.2, rounds: int = 200) -> Classifier:
        """Gradient descent with momentum on the ridged likelihood."""
        one = np.eye(len(DOMAINS))[y]
        self.absent = np.where(one.sum(0) > 0, 0.0, -1e9)
        w = np.zeros((x.shape[1], len(DOMAINS)))
        step, speed = 4 * len(x) / (np.linalg.norm(x, 2) ** 2 + ridge), np.zeros_like(w)
        for k in range(rounds):
            ahead = w + k / (k + 3) * speed
            p = _softmax(x @ ahead + self.absent)
            new = ahead - step * (x.T @ (p - one) + ridge * ahead) / len(x)
            speed, w = new - w, new
        self.weights = np.round(w, 9)
        return self

    def posterior(self, c: Chunk) -> np.ndarray:
        if self.weights is None:
            return np.full((len(c.n_words), len(DOMAINS)), 1 / len(DOMAINS))
        return _softmax(self.features(c) @ self.weights + self.absent)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id") -> Classifier:
    """Fits the classifier on ``labels(doc_id, quality, toxic)``."""
    scratch = Scratch(spark, "domains")
    domain = F.when(F.col("toxic") > 0, 1).when(F.col("quality") <= 0, 2).otherwise(0)
    marked = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").alias("_label"), domain.alias("domain"))
    marked = marked.groupBy("_label").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("_label"), "_label").limit(MAX_TRAIN)
    rows = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(marked), F.col("_id") == F.col("_label")).select("_id", "domain", "_text")
    rows = scratch.write(rows.dropDuplicates(["_id"]), "train")
    totals = dict.fromkeys(range(len(DOMAINS)), 0) | {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    if sum(n > 0 for n in totals.values()) < 2:
        return Classifier(np.zeros(0, np.int64))

    def words(batches):
        for b in batches:
            for at, to, c in chunks(b.column(2), lower=True):
                h, doc = distinct_words(c)
                kind = b.column(1).to_numpy()[at:to][doc]
                order = np.lexsort((kind, h))
                h, kind = h[order], kind[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])))) if len(h) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(kind[new].astype(np.int32)), pa.array(np.diff(np.append(new, len(h))))], names=["word", "domain", "n"])

    counted = rows.mapInArrow(words, "word long, domain int, n long").groupBy("word").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("domain") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in totals)).where("n >= 5")
    all_rows = sum(totals.values())
    best: set[int] = set()
    for k, total in totals.items():
        rate = total / all_rows
        if 0 < rate < 1:
            z = (F.col(f"n{k}") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
            best |= {r["word"] for r in counted.withColumn("z", z).where("z >= 4").orderBy(F.desc("z"), "word").limit(MAX_WORDS // len(DOMAINS)).collect()}
    model = Classifier(np.array(sorted(best), np.int64))

    def featured(batches):
        for b in batches:
            for at, to, c in chunks(b.column(2), lower=True):
                x = model.features(c)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), pa.array(list(x.astype(np.int8)), pa.list_(pa.int8()))], names=["id", "domain", "x"])

    got = sorted(rows.mapInArrow(featured, "id long, domain int, x array<tinyint>").collect(), key=lambda r: r["id"])  # at most MAX_TRAIN short rows
    return model.fit(np.array([r["x"] for r in got], float), np.array([r["domain"] for r in got]))


def predicted(spark: SparkSession, docs: DataFrame, model: Classifier, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with n_tokens (words) and a posterior per domain."""
    sent = spark.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list[pa.Array]:
        got = [(c.n_words, sent.value.posterior(c)) for _, _, c in chunks(column, lower=True)]
        p = np.concatenate([x for _, x in got]) if got else np.zeros((0, len(DOMAINS)))
        return [pa.array(np.concatenate([n for n, _ in got]).astype(np.int64) if got else [], pa.int64()), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(DOMAINS)))]

    return arrow_map(docs, text, run, [T.StructField("n_tokens", T.LongType()), *(T.StructField(f"p_{d}", T.DoubleType()) for d in DOMAINS)], keep)


def moved(rate: Column, step: np.ndarray, most: float | None) -> Column:
    """Rates after a projected step: by the step's part for each domain, not below 0 and not above ``most``."""
    for d, x in zip(DOMAINS, step.tolist(), strict=True):
        rate = rate + F.col(f"p_{d}") * F.lit(x)
    rate = F.greatest(F.lit(0.0), rate)
    return rate if most is None else F.least(F.lit(most), rate)


def fit_rates(scratch: Scratch, rows: DataFrame, targets: dict[str, float] | None = None, factors: dict[str, float] | None = None, most: float | None = None, tolerance: float = 1e-6, still: float = 1e-5, rounds: int = 500) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``rows`` with ``rate``; and the domains' expected totals reached and wanted, as shares of the input's tokens.

    ``targets`` gives each domain's share of the input's tokens; or ``factors`` multiplies the share it has. Steps go on until the totals are met
    within ``tolerance`` or a step changes them by no more than ``still``, both as sums over the domains: then rates in the allowed range come
    nearer very slowly, if at all. Every 16 steps the rates are written, so that plans stay short.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    n = F.col("n_tokens")
    k = len(DOMAINS)
    first = rows.agg(F.sum(n), *(F.sum(n * x) for x in p), *(F.sum(n * x * y) for x in p for y in p)).first()
    total = float(first[0] or 0)
    start = 1.0 if most is None else min(1.0, most)
    rows = rows.withColumn("rate", F.lit(start))
    if not total:
        return rows, np.zeros(k), np.zeros(k)
    now, overlap = np.array(first[1 : 1 + k], float) / total, np.array(first[1 + k :], float).reshape(k, k) / total
    want = np.array([targets[d] for d in DOMAINS]) if targets is not None else now * np.array([factors[d] for d in DOMAINS])
    # Relative to the domains' shares; directions in which the posteriors hardly tell domains apart are not moved along.
    scale = np.where(now > 0, 1 / np.sqrt(np.maximum(now, 1e-300)), 0.0)
    inverse = scale[:, None] * np.linalg.pinv(scale[:, None] * overlap * scale, rcond=0.02, hermitian=True) * scale
    now = now * start
    rate = F.col("rate")
    for taken in range(1, rounds + 1):
        if np.abs(want - now).sum() <= tolerance:
            break
        rate, before = moved(rate, np.round(inverse @ (want - now), 12), most), now
        now = np.array(rows.agg(*(F.sum(n * x * rate) for x in p)).first(), float) / total
        if np.abs(now - before).sum() <= still:
            break
        if taken % 16 == 0:
            rows, rate = scratch.write(rows.withColumn("rate", rate), "rates"), F.col("rate")
    if np.abs(want - now).sum() > 1e-3:
        LOG.warning("totals reached %s, wanted %s, as shares of the input's tokens", dict(zip(DOMAINS, now.round(6).tolist(), strict=True)), dict(zip(DOMAINS, want.round(6).tolist(), strict=True)))
    return rows.withColumn("rate", rate), now, want


def mixed(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", keep: list[str] | None = None, weights: dict[str, float] | None = None, budget: float = BUDGET, factors: dict[str, float] | None = None, most: float | None = None) -> DataFrame:
    """``keep`` columns with n_tokens, posteriors, rate and copies: the rate rounded to a whole number by a hash of the id, so that its mean is the rate.

    ``most`` bounds the rates. The result's attribute ``totals`` holds the totals reached and wanted of each domain, as shares of the input's tokens.
    """
    names = {"n_tokens", "rate", "copies", *(f"p_{d}" for d in DOMAINS)}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    scratch = Scratch(spark, "mixing")
    rows = scratch.write(predicted(spark, docs, learn(spark, docs, labels, text, id), text, keep), "posteriors", TEXT_ROWS)
    targets = None if factors else {d: budget * w for d, w in (weights or WEIGHTS).items()}
    rows, now, want = fit_rates(scratch, rows, targets, factors, most)
    even = F.pmod(F.xxhash64(F.col(f"`{id}`").cast("string"), F.lit("mixing")), F.lit(1 << 32)) / float(1 << 32)
    out = rows.withColumn("rate", F.round("rate", 9)).withColumn("copies", F.floor(F.col("rate") + even).cast("int"))
    out.totals = {d: (float(a), float(b)) for d, a, b in zip(DOMAINS, now, want, strict=True)}
    return out


def drawn(spark: SparkSession, docs: DataFrame, labels: DataFrame, factors: dict[str, float]) -> DataFrame:
    """The rows of ``docs`` that are drawn, with its own columns: a mixture that repeats nothing, so rates are 1 at most. ``totals`` as for ``mixed``."""
    added = {"n_tokens", "rate", "copies", *(f"p_{d}" for d in DOMAINS)}
    names = {c: f"_own_{c}" if c.lower() in added else c for c in docs.columns}
    rows = mixed(spark, docs.withColumnsRenamed(names), labels, factors=factors, most=1.0)
    out = rows.where("copies >= 1").select(*(F.col(f"`{to}`").alias(c) for c, to in names.items()))
    out.totals = rows.totals
    return out


def op9_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), keep=["doc_id"])
