"""Quality rules as weak supervision.

Each rule grades a document from 2 (surely good) to -2 (surely bad) or abstains (0). Expectation-maximisation over the counts of
vote patterns estimates how often each rule gives each grade to good documents and to bad ones, and the share of the good ones; a
document is kept if its posterior probability of being good reaches a threshold. No vote alone rejects a document: one bad vote of a rule
that errs is outweighed, and several doubtful ones add up. Only the two base rules of ``base_failed`` are outside the model.

Most bad documents break one rule only, in which case votes depend on each other within the bad documents as a whole. So there is a
kind of bad documents for each rule, told apart by where the estimation starts: in that kind the rule's grades are mostly bad ones. All
shares and rates are estimated; priors worth ``STRENGTH`` of the documents, whatever their number, keep them off 0 and 1.

Patterns are counted over all documents; there are at most 5 ** (number of rules) of them, so the driver's part is bounded by
the rules and not by the data.

Defined results: a null or empty text has no words (all counts 0) and is ``base_failed``. Repeated rows get equal results.
Input columns named like an output are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT_ROWS, Scratch, arrow_map, chunks, mix, table

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs"]
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def count(column: pa.Array) -> list[pa.Array]:
    """The COUNTS of each text, as arrays of 64-bit integers."""
    out = []
    for _, _, c in chunks(column):
        docs = len(c.n_words)
        words = ~c.space
        counts = {"n_words": c.n_words, "word_chars": c.per_doc(words & ((c.raw & 0xC0) != 0x80)), "n_symbols": c.per_doc(_SYMBOL[c.raw]), "n_bangs": c.per_doc(c.raw == 0x21)}
        upper = (c.raw >= 65) & (c.raw <= 90)
        counts |= {"n_upper": c.per_doc(upper), "n_letters": c.per_doc(upper | ((c.raw >= 97) & (c.raw <= 122)))}
        # Lines with a word; those equal to an earlier one of the document.
        breaks = np.flatnonzero(c.raw == 0x0A)
        starts = np.unique(np.concatenate((c.offsets[:-1], breaks + 1)))
        starts = starts[starts < len(c.raw)]
        ends = np.minimum(np.append(starts[1:], len(c.raw)), len(c.raw))
        ends = np.where((ends > starts) & (c.raw[ends - 1] == 0x0A) if len(starts) else np.zeros(0, bool), ends - 1, ends)
        filled = np.searchsorted(c.starts, ends) > np.searchsorted(c.starts, starts)
        starts, ends = starts[filled], ends[filled]
        doc = np.searchsorted(c.offsets, starts, "right") - 1
        doc_key = np.arange(docs, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        lines = np.bincount(doc, minlength=docs)
        _, at = np.unique(mix(c.ranges(starts, ends) + doc_key[doc]), return_index=True)
        counts |= {"n_lines": lines, "n_dup_lines": lines - np.bincount(doc[at], minlength=docs)}
        # Words inside 3-word windows that a text has twice or more.
        h, doc = c.words(), c.doc_of_word()
        repeated = np.zeros(len(h), bool)
        if len(h) >= 3:
            w = mix(h[:-2] * np.uint64(0x8CB92BA72F3D8DD7) + h[1:-1] * np.uint64(0xD1342543DE82EF95) + h[2:] + doc_key[doc[:-2]])
            at = np.flatnonzero(doc[:-2] == doc[2:])
            w = w[at]
            order = np.argsort(w, kind="stable")
            s = w[order]
            same = s[1:] == s[:-1]
            twice = np.zeros(len(s), bool)
            twice[1:] |= same
            twice[:-1] |= same
            at = at[order[twice]]
            for k in range(3):
                repeated[at + k] = True
        counts["n_repeat_words"] = np.bincount(doc[repeated], minlength=docs)
        out.append(np.stack([counts[k].astype(np.int64) for k in COUNTS]))
    all_of = np.concatenate(out, axis=1) if out else np.zeros((len(COUNTS), 0), np.int64)
    return [pa.array(x) for x in all_of]


def _ratio(a: str, b: str):
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _grade(*steps: tuple) -> F.Column:
    """The grade of the first condition that holds, else -2."""
    out = F.lit(-2)
    for grade, holds in reversed(steps):
        out = F.when(holds, grade).otherwise(out)
    return out


def votes() -> dict:
    """Name -> a column of grades 2, 1, -1, -2, or 0 (abstains). All are ratios of counts, so they behave alike at every length."""
    mean = _ratio("word_chars", "n_words")
    symbols, lines = _ratio("n_symbols", "n_words"), _ratio("n_dup_lines", "n_lines")
    upper, bangs = _ratio("n_upper", "n_letters"), _ratio("n_bangs", "n_words")
    unless = lambda silent, vote: F.when(silent, 0).otherwise(vote)
    return {
        "mean_word": unless(F.col("n_words") == 0, _grade((2, mean.between(4, 6)), (1, mean.between(3, 7)), (-1, mean.between(2, 10)))),
        "symbols": unless(F.col("n_words") == 0, _grade((2, symbols <= 0.01), (1, symbols <= 0.05), (-1, symbols <= 0.3))),
        "dup_lines": unless(F.col("n_lines") < 3, _grade((2, lines <= 0.05), (1, lines <= 0.2), (-1, lines <= 0.4))),
        "upper": unless(F.col("n_letters") < 20, _grade((2, upper <= 0.1), (1, upper <= 0.3), (-1, upper <= 0.6))),
        "bangs": unless(F.col("n_words") == 0, _grade((2, bangs <= 0.02), (1, bangs <= 0.1), (-1, bangs <= 0.3))),
    }


LEVELS = np.array([-2, -1, 1, 2])
#: Where rates start, and what the priors hold: shares of the LEVELS for good documents, for the rule that names a kind of bad ones, and for others there.
GOOD, NAMED, OTHERS = (0.002, 0.02, 0.12, 0.858), (0.5, 0.4, 0.06, 0.04), (0.1, 0.1, 0.15, 0.65)
SHARE_GOOD, STRENGTH = 0.85, 0.002


class Model:
    """Shares of good documents and of each kind of bad ones (class 0 and the others), and ``rates[class, rule, level]`` of the votes.

    Abstaining says nothing.
    """

    def __init__(self, rules: list[str], strength: float = STRENGTH):
        n = len(rules)
        self.rules, self.strength = rules, strength
        self.shares = np.array([SHARE_GOOD, *[(1 - SHARE_GOOD) / n] * n])
        self.rates = np.tile(np.array(OTHERS), (n + 1, n, 1))
        self.rates[0] = GOOD
        self.rates[np.arange(1, n + 1), np.arange(n)] = NAMED
        self._before = self.shares, self.rates

    @property
    def prior(self) -> float:
        return float(self.shares[0])

    @property
    def good(self) -> np.ndarray:
        """Of each rule's votes on good documents, the share of bad ones."""
        return self.rates[0, :, LEVELS < 0].sum(0)

    @property
    def bad(self) -> np.ndarray:
        """Of each rule's votes on bad documents, the share of bad ones."""
        return np.einsum("c,crl->r", self.shares[1:], self.rates[1:, :, LEVELS < 0]) / self.shares[1:].sum()

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """Posterior probabilities of the classes, a row for each pattern."""
        cast = patterns[:, :, None] == LEVELS
        ll = np.log(self.shares) + np.einsum("prl,crl->pc", cast, np.log(self.rates))
        p = np.exp(ll - ll.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self.classes(patterns)[:, 0]

    def fit(self, patterns: np.ndarray, weights: np.ndarray, rounds: int = 1000, tolerance: float = 1e-9) -> Model:
        """Expectation-maximisation over vote patterns and how many documents have each, until nothing changes by more than ``tolerance``."""
        total = weights.sum()
        cast = patterns[:, :, None] == LEVELS if len(patterns) else None
        shares, rates = self._before
        for _ in range(rounds if len(patterns) and total else 0):
            w = self.classes(patterns) * (weights / total)[:, None]
            old = self.shares, self.rates
            self.shares = (w.sum(0) + self.strength * shares) / (1 + self.strength)
            seen = np.einsum("pc,prl->crl", w, cast) + self.strength * shares[:, None, None] * rates
            self.rates = seen / seen.sum(axis=2, keepdims=True)
            if max(np.abs(x - y).max() for x, y in zip(old, (self.shares, self.rates), strict=True)) < tolerance:
                break
        return self

    def accuracies(self) -> dict[str, float]:
        """Of each rule, the estimated share of its votes that are right."""
        right = self.prior * (1 - self.good) + (1 - self.prior) * self.bad
        return dict(zip(self.rules, right.tolist(), strict=True))


def score_quality(spark: SparkSession, docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> tuple[DataFrame, Model]:
    """``docs`` (its ``keep`` columns, default all) with the COUNTS, ``base_failed``, ``posterior`` and ``kept``; and the fitted model.

    One pass over the texts. The counts, with the kept columns, are written to the shared folder, since both the fit and the
    verdict read them.
    """
    scratch = Scratch(spark, "quality")
    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"base_failed", "posterior", "kept", "_pattern"}]
    rules = votes()
    pattern = F.lit(0)
    for v in rules.values():
        pattern = pattern * 5 + v + 2
    counted = scratch.write(arrow_map(docs, text, count, fields, kept).withColumn("_pattern", pattern.cast("int")), "counts", TEXT_ROWS)
    seen = counted.groupBy("_pattern").count().collect()  # at most 5 ** rules rows
    codes = np.array([r["_pattern"] for r in seen], np.int64)
    patterns = codes[:, None] // 5 ** np.arange(len(rules) - 1, -1, -1) % 5 - 2
    model = Model(list(rules)).fit(patterns, np.array([r["count"] for r in seen], float))
    if len(codes):
        table_of = F.create_map(*chain.from_iterable((F.lit(int(c)), F.lit(float(p))) for c, p in zip(codes, model.posterior(patterns), strict=True)))
        posterior = table_of[F.col("_pattern")]
    else:
        posterior = F.lit(model.prior)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = counted.withColumns({"base_failed": failed, "posterior": posterior})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).drop("_pattern"), model


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns."""
    added = {*COUNTS, "base_failed", "posterior", "kept"}
    names = {c: f"_own_{c}" if c.lower() in added else c for c in docs.columns}  # outputs would replace these columns
    scored, _ = score_quality(spark, docs.withColumnsRenamed(names))
    return scored.where("kept").select(*(F.col(f"`{to}`").alias(c) for c, to in names.items()))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored, _ = score_quality(spark, docs, keep=["doc_id"])
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 9).alias("posterior"))
