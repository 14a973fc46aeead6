"""Steps that must not grow with their tables: what is sent to every executor, and pairs that are compared."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import horizontal


@pytest.mark.parametrize("method", [horizontal.bilinear, horizontal.bicubic])
def test_neighbours_of_points_are_not_broadcast(spark, method):
    """Points explode into more rows than Spark's estimates show; those must not pass through the driver."""
    i = F.col("id")
    source = spark.range(2_000_000).select((i % 20).cast("int").alias("x"), (i / 20 % 20).cast("int").alias("y"), i.cast("double").alias("v")).groupBy("x", "y").agg(F.avg("v").alias("v"))
    at = spark.range(1000).select("id", (i * 7 % 190 / 10.0).alias("px"), (i * 13 % 190 / 10.0).alias("py"))
    out = method(source, at, "v")
    steps = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = lambda line: next(k for k, c in enumerate(line) if c.isalpha())
    below = lambda k: [line for n, line in enumerate(steps) if n > k and all(depth(x) > depth(steps[k]) for x in steps[k + 1 : n + 1])]
    joins = [k for k, line in enumerate(steps) if "BroadcastHashJoin" in line and "BuildLeft" in line]
    assert not [k for k in joins if any("Generate explode" in line for line in below(k))]
    assert out.count() == 1000


def joined(df):
    """Rows of the result, and the most rows that a join in its plan made."""
    rows, most = df.collect(), 0
    open_ = [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName()
        if "Join" in kind or "Cartesian" in kind:
            most = max(most, node.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            open_ += [node.children().apply(k) for k in range(node.children().size())]
    return rows, most


def somewhere(rng, kind, n):
    if kind == "copies":
        return [(float(k * 53 % 40), float(k * 29 % 8)) for k in range(n)]
    if kind == "pole":
        return [(rng.uniform(-180, 180), 90 - abs(rng.gauss(0, 2))) for _ in range(n)]
    if kind == "seam":
        return [(rng.choice([-180, 180]) + rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(n)]
    return [({"near": 10, "far": 14}[kind] + rng.gauss(0, 0.01), 60 + rng.gauss(0, 0.01)) for _ in range(n)]  # two heaps


@pytest.mark.parametrize(("kind", "other", "radius"), [("copies", "copies", 9e5), ("pole", "pole", 9e5), ("seam", "seam", 9e5), ("near", "far", 9e5)])
def test_nearest_places_without_all_pairs(spark, kind, other, radius):
    """As by comparing all, and pairs grow with the points, not with points times the source's density."""
    rng = random.Random(3)
    at, src = somewhere(rng, kind, 1000), somewhere(rng, other, 4000)
    gone = [(None, 1.0), (1.0, None), (math.nan, 1.0), (math.inf, 1.0)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(at + gone)], "id long, lon double, lat double")
    source = spark.createDataFrame([(k, *p, k * 0.5) for k, p in enumerate(src + gone)], "cell long, lon double, lat double, v double")
    rows, most = joined(horizontal.coordinate_nearest(source, points, "v", radius))
    got = {r["id"]: (r["v"], r["distance"]) for r in rows}
    assert sorted(got) == list(range(1004)) and all(got[k] == (None, None) for k in range(1000, 1004))
    a, b = (np.radians(np.array(x)) for x in (at, src))
    cos = np.sin(a[:, None, 1]) * np.sin(b[None, :, 1]) + np.cos(a[:, None, 1]) * np.cos(b[None, :, 1]) * np.cos(b[None, :, 0] - a[:, None, 0])
    far = np.arccos(np.clip(cos, -1, 1)) * 6371000
    for k, d in enumerate(far):
        if d.min() > radius:
            assert got[k] == (None, None), k
        else:
            assert got[k][1] == pytest.approx(d.min(), abs=0.2) and far[k, int(got[k][0] * 2)] <= d.min() + 0.2, k
            if kind == other == "copies":
                assert got[k][0] == np.flatnonzero(d <= d.min() + 1e-3)[0] * 0.5, k
    assert most <= 250_000, most
