"""The posterior and the verdict of quality rules against an expectation-maximisation written out row by row."""

import math

import pytest

from gridspark.llm import quality_rules as q

CLEAN = "the quick brown foxes jumped over seven lazy dogs near the river bank while people watched them quietly from there "


def texts():
    words = CLEAN.split()
    out = [(f"{' '.join(words[(i * 7 + k * 3) % len(words)] + str(k) * (k % 3 == 0) for k in range(60 + i % 9))}", "good") for i in range(160)]
    out += [(" ".join(f"{w}{k}#$%" for k, w in enumerate(words * 3)), "symbols") for _ in range(12)]
    out += [(" ".join(f"{w}{k}" for k, w in enumerate(words * 3)).upper() + "!" * 40, "loud") for _ in range(12)]
    out += [("\n".join(f"line of words number {k * (k % 3 == 0)} stays here" for k in range(40)), "lines") for _ in range(5)]
    out += [(out[0][0] + " a #tag" * (1 + k), "one doubtful vote") for k in range(3)] + [(None, "empty"), ("", "empty"), ("few words", "short")]
    return out


def brute(votes):
    """Posterior of each row, by the written-out sums over rows, classes, rules and grades."""
    levels, rules = [-2, -1, 1, 2], range(len(votes[0]))
    first = [q.SHARE_GOOD] + [(1 - q.SHARE_GOOD) / len(votes[0])] * len(votes[0])
    start = [[list(q.GOOD if c == 0 else q.NAMED if c == r + 1 else q.OTHERS) for r in rules] for c in range(len(first))]
    shares, rates, n = list(first), [[list(x) for x in c] for c in start], len(votes)
    for _ in range(1000):
        post = []
        for row in votes:
            p = [shares[c] * math.prod(rates[c][r][levels.index(row[r])] for r in rules if row[r]) for c in range(len(shares))]
            post.append([x / sum(p) for x in p])
        before = [list(shares), [[list(x) for x in c] for c in rates]]
        for c in range(len(shares)):
            shares[c] = (sum(p[c] for p in post) / n + q.STRENGTH * first[c]) / (1 + q.STRENGTH)
            for r in rules:
                got = [sum(p[c] for p, row in zip(post, votes, strict=True) if row[r] == x) / n + q.STRENGTH * first[c] * start[c][r][k] for k, x in enumerate(levels)]
                rates[c][r] = [g / sum(got) for g in got]
        if max(abs(a - b) for c in range(len(shares)) for a, b in [(shares[c], before[0][c]), *((x, y) for r in rules for x, y in zip(rates[c][r], before[1][c][r], strict=True))]) < 1e-9:
            break
    out = []
    for row in votes:
        p = [shares[c] * math.prod(rates[c][r][levels.index(row[r])] for r in rules if row[r]) for c in range(len(shares))]
        out.append(p[0] / sum(p))
    return out


def test_posterior_and_verdict(spark):
    rows = [(i, t) for i, (t, _) in enumerate(texts())]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").repartition(3)
    scored, model = q.score_quality(spark, df)
    got = sorted(scored.withColumns({f"v_{k}": v for k, v in q.votes().items()}).collect(), key=lambda r: r["doc_id"])
    want = brute([[r[f"v_{k}"] for k in model.rules] for r in got])
    for r, p in zip(got, want, strict=True):
        assert r["posterior"] == pytest.approx(p, abs=1e-6) and r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5), r
    kinds = [k for _, k in texts()]
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert [(i, k) for i, k in enumerate(kinds) if kept[i] != (k in ("good", "one doubtful vote"))] == []


def test_votes_add_up():
    """One bad vote of an unreliable rule is outweighed; grades that are merely doubtful can reject together."""
    import numpy as np

    patterns = np.array([[2, 2, 2], [-1, 2, 2], [-2, -1, 2], [-1, -1, -1], [1, 1, 1], [1, 1, -1]])
    model = q.Model(list("abc")).fit(patterns, np.array([900.0, 60, 5, 20, 2, 10]))
    p = model.posterior(patterns)
    assert p[0] > 0.9 and p[1] > 0.5 > p[3] and p[1] > p[2]
