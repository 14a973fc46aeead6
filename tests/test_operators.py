import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import combine, extract, horizontal, process, quality, slabs, stats, vertical


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(t, x, float(10 * t + x)) for t in range(4) for x in range(5)], "t int, x int, v double")


def test_subsets(grid):
    assert rows(extract.reduce_dimension(grid, "x", 1, 2).where("t = 0"), "x") == [(0, 0, 1.0), (0, 1, 2.0)]
    assert extract.reduce_dimension_start_end(grid, "x", 1, -1, 5).select("x").distinct().count() == 3
    assert rows(extract.pick_dimension(grid, "x", [4, 0, 4]).where("t = 1"), "x") == [(1, 0, 10.0), (1, 1, 14.0)]
    for bad in (lambda: extract.reduce_dimension_start_end(grid, "x", 1, 9, 5), lambda: extract.pick_dimension(grid, "x", [])):
        with pytest.raises(ValueError):
            bad()


def test_axis_tolerance_and_units(spark):
    g = spark.createDataFrame([(k, 1000.0 - 100 * k, float(k)) for k in range(6)], "z int, p double, v double")
    got = rows(extract.reduce_axis(g, "z", "p", 60000.0, 80000.0 - 90, "Pa", "hPa"), "z")
    assert [r[1] for r in got] == [800.0, 700.0, 600.0] and [r[0] for r in got] == [0, 1, 2]
    assert extract.reduce_axis(g, "z", "p", None, 750.0).count() == 3


def test_bounding_box(spark):
    g = spark.createDataFrame([(x, y, x * 10.0 - 180, y * 10.0 - 90) for x in range(36) for y in range(19)], "x int, y int, lon double, lat double")
    assert extract.bounding_box(g, 0, 20, 170, -170).select("lon").distinct().count() == 3
    with pytest.raises(ValueError):
        extract.bounding_box(g, 10, 0, 0, 1)


def test_accumulate_and_back(spark):
    g = spark.createDataFrame([(t, 0, v) for t, v in enumerate([None, 2.0, None, 4.0, 5.0])], "t int, x int, v double")
    assert [r[2] for r in rows(process.accumulate(g, "v", "t", ["x"]), "t")] == [None, 2.0, None, None, None]
    assert [r[2] for r in rows(process.deaccumulate(g, "v", "t", ["x"]), "t")] == [None, 2.0, None, None, 1.0]
    times = spark.createDataFrame([(i, 0, 1179309600.0 + 3600 * i) for i in range(4)], "t int, x int, v double")
    assert [r[2] for r in rows(process.deaccumulate(times, "v", "t", ["x"]), "t")] == [1179309600.0, 3600.0, 3600.0, 3600.0]


def test_quality(spark):
    g = spark.createDataFrame([(0, x, float(x), s) for x, s in enumerate([1.0, 2.0, 3.0, None])], "t int, x int, v double, s double")
    left = lambda rule: [r[2] for r in rows(quality.mask(g, "v", F.col("s"), rule, ["t"]), "x")]
    assert left("highest") == [None, None, 2.0, None] and left("lowest") == [0.0, None, None, None] and left("min:2") == [None, 1.0, 2.0, None]
    assert left([1, 3]) == [0.0, None, 2.0, None] and left("all") == [0.0, 1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        quality.allowed(F.col("s"), "best")


@pytest.mark.parametrize(
    ("method", "want"),
    [
        ("linear", [50, 150, 250, 350, 450]), ("linear_weak_extra", [None, 150, 250, 350, None]),
        ("linear_no_extra", [None, None, 250, None, None]), ("linear_const_extra", [200, 200, 250, 300, 300]), ("nearest", [200, 200, 200, 300, 300]),
    ],
)
def test_extrapolation(spark, method, want):
    g = spark.createDataFrame([(0, 2.0, 200.0), (0, 3.0, 300.0)], "c int, z double, v double")
    t = spark.createDataFrame([(z,) for z in (0.5, 1.5, 2.5, 3.5, 4.5)], "target double")
    got = [r[2] for r in rows(vertical.interpolate(g, F.col("z"), ["v"], t, "target", ["c"], method), "target")]
    assert got == [None if w is None else pytest.approx(w) for w in want]


@pytest.mark.parametrize(("method", "want"), [("log", {500: 729.073, 1500: 1158.482, 200: 370.927, 800: 912.781}), ("loglog", {500: 763.1873, 200: 408.0904, 800: 926.384})])
def test_logarithms(spark, method, want):
    g = spark.createDataFrame([(0, 1000.0, 1000.0), (0, 100.0, 100.0)], "c int, z double, v double")
    t = spark.createDataFrame([(float(z),) for z in want], "target double")
    got = {r[1]: r[2] for r in rows(vertical.interpolate(g, F.col("z"), ["v"], t, "target", ["c"], method), "target")}
    assert got == {float(k): pytest.approx(v, abs=2e-3) for k, v in want.items()}


def test_exact_level_and_missing(spark):
    g = spark.createDataFrame([(0, 1.0, 10.0), (0, 2.0, None), (0, 3.0, 30.0)], "c int, z double, v double")
    t = spark.createDataFrame([(1.0,), (1.5,), (3.0,)], "target double")
    assert [r[2] for r in rows(vertical.interpolate(g, F.col("z"), ["v"], t, "target", ["c"]), "target")] == [10.0, None, 30.0]


def test_times(spark):
    g = spark.createDataFrame([(dt.datetime(2020, 1, 1, h), 0, float(h)) for h in (0, 6, 12)], "ts timestamp_ntz, x int, v double")
    t = spark.createDataFrame([(dt.datetime(2020, 1, 1, 3),), (dt.datetime(2020, 1, 1, 12),), (dt.datetime(2020, 1, 1, 15),), (dt.datetime(2020, 1, 2, 0),)], "target timestamp_ntz")
    assert [r[2] for r in rows(vertical.interpolate_time(g, "ts", t, "target", ["v"], ["x"]), "target")] == [3.0, 12.0, 15.0, None]


def test_horizontal(spark):
    g = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (0, 1, 2.0), (1, 1, 1 + math.sqrt(2))], "x int, y int, v double")
    at = spark.createDataFrame([(0, 0.3, 0.0), (1, 0.0, 0.3), (2, 1.5, 0.5), (3, 1.0, 1.0), (4, 0.5, -0.5)], "id int, px double, py double")
    assert [r[3] for r in rows(horizontal.bilinear(g, at, "v"), "id")] == [pytest.approx(1.3), pytest.approx(1.3), None, pytest.approx(1 + math.sqrt(2)), None]
    wide = spark.createDataFrame([(x, y, float(v)) for y in range(4) for x, v in enumerate((1, 2, 2, 1))], "x int, y int, v double")
    at = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 1.5), (2, 1.5, 1.0), (3, 0.5, 1.0), (4, 2.5, 1.0)], "id int, px double, py double")
    assert [r[3] for r in rows(horizontal.bicubic(wide, at, "v"), "id")] == [pytest.approx(2), pytest.approx(2), pytest.approx(2.125), None, None]
    pos = lambda axis: [r[1] for r in rows(horizontal.positions_on(spark.createDataFrame([(k, float(v)) for k, v in enumerate((-3, 5, 1.3, 2, 6))], "k int, v double"), "v", axis).select("k", "position"), "k")]
    assert pos([1, 2, 3, 4, 5]) == pytest.approx([-4, 4, 0.3, 1, 5]) and pos([5, 4, 3, 2, 1]) == pytest.approx([8, 0, 3.7, 3, -1])


def test_forward_median_is_the_upper(spark):
    g = spark.createDataFrame([(0.1, 0.0, v) for v in (1.0, 2.0, 3.0, 4.0, None)], "px double, py double, v double")
    assert horizontal.forward(g, "v", "px", "py", 1, 1, "median").first()["v"] == 3.0
    assert horizontal.forward(g, "v", "px", "py", 2, 1, "mean", undefined=True).collect()[0]["v"] is None
    assert horizontal.forward(g, "v", "px", "py", 2, 1, "sum").count() == 2


def test_nearest_on_the_sphere(spark):
    r = np.random.default_rng(3)
    src = [(i, float(a), float(b), float(i)) for i, (a, b) in enumerate(zip(r.uniform(-180, 180, 300), np.degrees(np.arcsin(r.uniform(-1, 1, 300))), strict=True))]
    at = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(-180, 180, 200), np.degrees(np.arcsin(r.uniform(-1, 1, 200))), strict=True))] + [(200, 179.9, 10.0), (201, 0.0, 90.0), (202, -180.0, -90.0)]
    got = {x["id"]: x["v"] for x in horizontal.coordinate_nearest(spark.createDataFrame(src, "cell int, lon double, lat double, v double"), spark.createDataFrame(at, "id int, lon double, lat double"), "v", 8e5).collect()}
    xyz = lambda p: np.array([(math.cos(math.radians(b)) * math.cos(math.radians(a)), math.cos(math.radians(b)) * math.sin(math.radians(a)), math.sin(math.radians(b))) for _, a, b, *_ in p])
    d = 6371000 * np.arccos(np.clip(xyz(at) @ xyz(src).T, -1, 1))
    for k, (i, *_) in enumerate(at):
        j = int(d[k].argmin())
        assert got[i] == (float(j) if d[k, j] <= 8e5 else None)


def test_combining(spark, grid):
    more = grid.withColumn("w", F.lit(1.0))
    both = combine.join_existing([grid, more], "t")
    assert both.count() == 40 and both.agg(F.max("t")).first()[0] == 7 and both.where("w is null").count() == 20
    new = combine.join_new([grid, grid], "run", ["v"], ["t", "x"], ["a", "2"])
    assert {r[0] for r in new.select("run_value").distinct().collect()} == {"a", "2"}
    up = combine.upsert(grid, spark.createDataFrame([(9, 1, 7.0), (0, 0, None)], "t int, x int, v double"), ["t", "x"], ["v"])
    assert up.count() == 21 and up.where("t = 0 and x = 0").first()["v"] is None and up.where("t = 9").first()["v"] == 7.0
    with pytest.raises(ValueError):
        combine.join_new([grid], "run", ["v"], ["t", "x"], [])


def test_stats(spark):
    g = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 4.0), (0, 9.0), (0, None), (1, None)], "t int, v double")
    got = {r["t"]: r for r in stats.field_stats(g, "v", ["t"]).collect()}
    assert (got[0]["n_def"], got[0]["n_undef"], got[0]["median"], got[0]["stddev"]) == (4, 1, 4.0, pytest.approx(np.std([1, 2, 4, 9], ddof=1)))
    assert got[1]["median"] is None and got[1]["n_undef"] == 1
    with pytest.raises(ValueError):
        stats.only_value(g, "t")


def test_filling(spark):
    y, x = np.mgrid[0:12, 0:9]
    field = x + 2.0 * y
    holes = field.copy()
    holes[3:6, 2:5] = np.nan
    out = slabs.fill(holes, 1e-6, 1.6, 400)
    assert np.abs(out - field)[3:6, 2:5].max() < 0.01 and (out[0] == field[0]).all()
    crept = slabs.creep(holes)
    assert not np.isnan(crept).any() and (crept[0] == field[0]).all() and crept.min() >= field.min()
    assert np.isnan(slabs.creep(np.full((2, 2), np.nan), default=3.0)).all()  # nothing defined, nothing grows
    df = spark.createDataFrame([(0, int(j), int(i), None if np.isnan(v) else float(v)) for (j, i), v in np.ndenumerate(holes)], "t int, y int, x int, v double")
    assert slabs.by_field(df, "v", slabs.fill, ["t"]).where("v is null").count() == 0


def test_vertical_velocity_is_zero_without_divergence():
    u = np.ones((4, 5, 6)) * 3
    flat, b = np.ones((5, 6)), (np.arange(4) + 0.5) / 4
    w = slabs.vertical_velocity(u, u, u * 90, np.zeros(4), b, flat * 1e5, flat * 0, (1.0, 1.0), flat, flat)
    assert np.abs(w).max() < 1e-9
