"""Toxicity through a noisy channel.

Disguised words (leetspeak, letters spaced out, letters repeated) become character lattices: each written character may stand for
some letters, or for none, and a space within a run of short tokens for nothing or for a word's end. Viterbi decoding under a character language model, which is counted over all texts, restores the
likeliest word, and a linear classifier scores the restored text.

The classifier learns from the labels which words and word beginnings mark toxic texts; it is fitted on at most ``MAX_TRAIN``
labelled rows, the first in the order of a hash of their ids. The language model's counts are a table of at most CLASSES ** 3 rows.

Defined results: a null or empty text gets the score of a text without marked words. Repeated rows get equal scores. A null id is
not held out. With no labelled rows of both kinds, all scores are 0. Input columns named like an output are replaced. An empty
table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Scratch, arrow_map, chunks, table

MAX_TRAIN = 6000
MAX_FEATURES = 400
THRESHOLD = 0.7
BEGINNINGS = (3, 4, 5, 6)
#: A beginning counts once more when a text has so many words with it.
OFTEN = 3

# Which letters a written sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
SIGN_COST, REPEAT_COST = 0.7, 0.3
#: Cost of a space that stands for nothing.
GLUE_COST = 0.3
#: Cost of a sign that stands for nothing: of one that has no letter, or of one to three or more that have.
DROP_COST, DROP_LETTER_COST = 1.0, (12.0, 8.0, 1.0)
#: Before and after a word these are punctuation.
PUNCTUATION = "!|(<+¡"
#: Runs of tokens of one or two characters, and of one, by the tokens' lengths.
SHORT, SINGLE = re.compile(b"[\x01\x02]{2,}"), re.compile(b"\x01{4,}")
EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”‘’…–—¿¡"

# Bytes by class: 0 is whatever ends a word, a-z are 1-26, other UTF-8 bytes share the rest.
CLASSES = 64
CLASS = np.zeros(256, np.int64)
CLASS[97:123] = np.arange(1, 27)
CLASS[0x80:0xC0] = 27 + np.arange(64) % 32
CLASS[0xC0:0x100] = 59 + np.arange(64) % 5


def trigrams(batches):
    """Counts of the triples of byte classes in a task's texts."""
    total = np.zeros(CLASSES**3, np.int64)
    for b in batches:
        for _, _, c in chunks(b.column(0)):
            k = np.concatenate(([0], CLASS[LOWER[c.raw]], [0]))
            total += np.bincount(k[:-2] * CLASSES**2 + k[1:-1] * CLASSES + k[2:], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Cost (negative logarithm) of each byte class after the two before it, from all texts."""
    rows = docs.select(F.col(f"`{text}`")).mapInArrow(trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CLASSES**3)
    for r in rows:  # at most CLASSES ** 3
        n[r["gram"]] = r["n"]
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    one = (n.sum((0, 1)) + 1) / (n.sum() + CLASSES)
    two = (n.sum(0) + 5 * one) / (n.sum((0, 2))[:, None] + 5)
    three = (n + 5 * two[None]) / (n.sum(2)[:, :, None] + 5)
    return -np.log(three).astype(np.float32)


def _written(path: tuple) -> str:
    out = []
    while path:
        path, s = path
        out.append(s)
    return "".join(reversed(out))


class Decoder:
    """Restores a disguised word."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.known: dict[str, list[int]] = {}

    def _classes(self, s: str) -> list[int]:
        if (x := self.known.get(s)) is None:
            x = self.known[s] = CLASS[np.frombuffer(s.encode(), np.uint8)].tolist() if s else []
        return x

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For each run of a sign, what it may stand for and at which cost."""
        out, i = [], 0
        while i < len(word):
            c, j = word[i], i
            while j < len(word) and word[j] == c:
                j += 1
            n, i = j - i, j
            if c == " ":
                out.append([(" ", 0.0), ("", GLUE_COST)])
            elif c.isalpha():
                if n == 1:
                    out.append([(c, 0.0)])
                elif n == 2:
                    out.append([(c + c, 0.0), (c, 4.0)])
                else:
                    out.append([(c, REPEAT_COST), (c + c, REPEAT_COST)])
            else:
                letters = SIGNS.get(c, "")
                loose = not letters or c in PUNCTUATION and (i == len(word) or i == n)
                out.append([("", DROP_COST if loose else DROP_LETTER_COST[min(n, 3) - 1])] + [(x, SIGN_COST) for x in letters] + ([(x + x, SIGN_COST) for x in letters] if n > 1 else []))
        return out

    def decode(self, word: str) -> str:
        """Viterbi over states of the last two classes."""
        costs, states = self.costs, {(0, 0): (0.0, ())}
        for options in self.lattice(word):
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in states.items():
                for s, extra in options:
                    x, y, total = a, b, cost + extra
                    for k in self._classes(s):
                        total += float(costs[x, y, k])
                        x, y = y, k
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = (total, (path, s))
            states = new
        return min((cost + float(costs[a, b, 0]), _written(path)) for (a, b), (cost, path) in states.items())[1]


def plain(word: str) -> bool:
    """Whether a word has letters only and no letter twice in a row."""
    return word.isalpha() and not any(a == b for a, b in zip(word, word[1:], strict=False))


class Reader:
    """Gives the forms of a text's words: as written without what surrounds them, and restored."""

    MEMORY = 1 << 20
    #: Longer runs of short tokens hardly come again.
    LONG = 24

    def __init__(self, costs: np.ndarray):
        self.decoder = Decoder(costs)
        self.forms: dict[str, tuple[str, ...]] = {}

    def of(self, token: str) -> tuple[str, ...]:
        if (x := self.forms.get(token)) is None:
            if " " in token:
                x = tuple(sorted({w for w in self.decoder.decode(token).split(" ") if w} - set(token.split(" "))))
                if len(token) > self.LONG:
                    return x
                if len(self.forms) >= self.MEMORY:
                    self.forms.clear()
                self.forms[token] = x
                return x
            core = token.strip(EDGES)
            x = {core} if core else set()
            if not plain(token) and any(c.isalnum() for c in token):
                x.add(core if plain(core) and token.rstrip(EDGES) == core else self.decoder.decode(token))
            x.discard("")
            if len(self.forms) >= self.MEMORY:
                self.forms.clear()
            x = self.forms[token] = tuple(sorted(x))
        return x

    @staticmethod
    def tokens(text: str) -> Counter:
        """The text's words in lower case and how often each occurs.

        Further entries are the runs of short tokens, with their spaces, and the letters of a run put together.
        """
        words = text.lower().split()
        counts = Counter(words)
        sizes = bytes([min(n, 3) for n in map(len, words)])
        for m in SINGLE.finditer(sizes):
            counts["".join(words[m.start() : m.end()])] += 1
        for m in SHORT.finditer(sizes):
            counts[" ".join(words[m.start() : m.end()])] += 1
        return counts


def features(counts: Counter, reader: Reader) -> set[str]:
    """A text's words, and the beginnings of its words (apart if there are OFTEN or more)."""
    out, begins = set(), Counter()
    for token, n in counts.items():
        for w in reader.of(token):
            out.add(w)
            for k in BEGINNINGS:
                if len(w) > k:
                    begins[w[:k]] += n
    for b, n in begins.items():
        out.add(f"{b} ")
        if n >= OFTEN:
            out.add(f"{b}  ")
    return out


def general(precision: dict[str, float], slack: float = 0.01) -> list[str]:
    """Features in the given order, without those that a more general one, a shorter beginning of the same, makes no worse.

    So a marked beginning has one weight, and not parts of it in every longer word that was seen with it.
    """

    def wider(f: str) -> list[str]:
        stem = f.rstrip(" ")
        out = [f"{stem[:k]} " for k in BEGINNINGS if k < len(stem)]
        return [*out, f"{stem} "] if f.endswith("  ") else out

    return [f for f, p in precision.items() if not any(precision.get(g, -1.0) >= p - slack for g in wider(f))]


class Model:
    """Marked words and beginnings with their weights."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.weights = dict(zip(names, weights.tolist(), strict=True))
        self.bias = bias
        self.tokens: dict[str, tuple] = {}

    def score(self, counts: Counter, reader: Reader) -> float:
        found, begins = set(), Counter()
        for token, n in counts.items():
            if (x := self.tokens.get(token)) is None:
                forms = reader.of(token)
                words = tuple(w for w in forms if w in self.weights)
                starts = tuple(w[:k] for w in forms for k in BEGINNINGS if len(w) > k and (f"{w[:k]} " in self.weights or f"{w[:k]}  " in self.weights))
                x = (words, starts) if words or starts else ()
                if " " not in token or len(token) <= Reader.LONG:
                    if len(self.tokens) >= Reader.MEMORY:
                        self.tokens.clear()
                    self.tokens[token] = x
            if x:
                found.update(x[0])
                for s in x[1]:
                    begins[s] += n
        for s, n in begins.items():
            found.add(f"{s} ")
            if n >= OFTEN:
                found.add(f"{s}  ")
        z = self.bias + math.fsum(self.weights.get(f, 0.0) for f in sorted(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge, by Newton's method."""
    x1 = np.hstack((x, np.ones((len(x), 1))))
    w, pull = np.zeros(x1.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pull), x1.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, costs: np.ndarray, text: str = "text") -> Model:
    """Fits the model on ``labels(doc_id, toxic)``; the caller leaves out what is to be held out."""
    scratch, lm = Scratch(spark, "toxicity"), spark.sparkContext.broadcast(costs)
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    rows = docs.select(F.col("doc_id").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).select("_id", "toxic", "_text")
    rows = scratch.write(rows, "train").repartition(spark.sparkContext.defaultParallelism)

    def tally(batches):
        reader, seen, toxic = Reader(lm.value), Counter(), Counter()
        for b in batches:
            for t, label in zip(b.column(2), b.column(1).to_pylist(), strict=True):
                f = features(Reader.tokens(t.as_py() or ""), reader)
                seen.update(f)
                if label:
                    toxic.update(f)
        names = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([seen[f] for f in names], pa.int64())], names=["f", "toxic", "n"])

    total = rows.agg(F.count("*"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0))).first()
    n, bad = int(total[0]), int(total[1] or 0)
    if not bad or bad == n:
        return Model([], np.zeros(0), -30.0)
    counted = rows.mapInArrow(tally, "f string, toxic long, n long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    rate = bad / n
    gain = F.col("toxic") - F.col("n") * F.lit(rate)
    best = counted.where(F.col("toxic") >= 3).withColumn("z", gain / F.sqrt(F.col("n") * rate * (1 - rate))).where("z >= 4").orderBy(F.desc("z"), "f").limit(5 * MAX_FEATURES).collect()
    names = sorted(general({r["f"]: (r["toxic"] + 0.5) / (r["n"] + 1) for r in best})[:MAX_FEATURES])
    if not names:
        return Model([], np.zeros(0), math.log(rate / (1 - rate)))
    index = {f: i for i, f in enumerate(names)}

    def found(batches):
        reader = Reader(lm.value)
        for b in batches:
            hits = [sorted(index[f] for f in features(Reader.tokens(t.as_py() or ""), reader) if f in index) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(bool(v)) for v in b.column(1).to_pylist()], pa.int32()), pa.array(hits, pa.list_(pa.int32()))], names=["id", "toxic", "hits"])

    sample = sorted(rows.mapInArrow(found, "id long, toxic int, hits array<int>").collect())  # at most MAX_TRAIN rows of ids and few numbers
    x = np.zeros((len(sample), len(names)))
    for i, r in enumerate(sample):
        x[i, r["hits"]] = 1
    weights, bias = fit(x, np.array([r["toxic"] for r in sample], float))
    return Model(names, np.round(weights, 9), round(bias, 9))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns with score and predicted."""
    costs = language_model(docs, text)
    model = spark.sparkContext.broadcast(learn(spark, docs, labels, costs, text))
    lm = spark.sparkContext.broadcast(costs)
    readers: list[Reader] = []  # one per task, kept between its batches

    def run(texts: pa.Array) -> list[pa.Array]:
        if not readers:
            readers.append(Reader(lm.value))
        return [pa.array([model.value.score(Reader.tokens(t.as_py() or ""), readers[0]) for t in texts], pa.float64())]

    out = arrow_map(docs, text, run, [T.StructField("score", T.DoubleType())], keep)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~fold)
    scored = score(spark, table(spark, sf_dir, "documents", "doc_id", "text"), labels, keep=["doc_id"])
    return scored.select("doc_id", fold.alias("held_out"), "score", "predicted")
