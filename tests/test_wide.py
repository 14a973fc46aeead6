"""Statistics and medians without whole fields in one task, axis tables, quality documents, templates and file kinds."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridspark.operators import extract, horizontal, quality, stats
from gridspark.plans.dataset import GridDataset, kind_of


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_field_stats_like_sorting(spark, n):
    rng = random.Random(n)
    kinds = [lambda: rng.gauss(0, 1), lambda: rng.choice([-1.0, 0.0, -0.0, 2.0]), lambda: 273.0 + rng.random(), lambda: rng.choice([1e308, -1e308, 5e-324, math.inf, -math.inf])]
    cells = [(k, kinds[k]() if rng.random() < 0.9 else None) for k in range(4) for _ in range(n)] + [(4, None), (None, 3.0), (None, 1.0)]
    got = {r["t"]: r for r in stats.field_stats(spark.createDataFrame(cells, "t int, v double"), "v", ["t"]).collect()}
    assert set(got) == {0, 1, 2, 3, 4, None}
    for t, r in got.items():
        have = sorted(v for k, v in cells if k == t and v is not None)
        assert (r["n_def"], r["n_undef"]) == (len(have), sum(k == t and v is None for k, v in cells))
        assert r["median"] == (have[len(have) // 2] if have else None)
        assert (r["least"], r["largest"]) == ((have[0], have[-1]) if have else (None, None))


def test_field_stats_of_everything_and_over_fields(spark):
    df = spark.createDataFrame([(t, float(t * i)) for t in range(3) for i in range(5)], "t int, v double")
    (r,) = stats.field_stats(df, "v", []).collect()
    all_values = sorted(float(t * i) for t in range(3) for i in range(5))
    assert (r["n_def"], r["median"], r["mean"]) == (15, all_values[7], statistics.mean(all_values))
    (m,) = stats.over_fields(stats.field_stats(df, "v", ["t"])).collect()
    assert (m["least"], m["largest"], m["mean"], m["n_def"]) == (0.0, 8.0, statistics.mean(all_values), 15)
    assert stats.field_stats(df.limit(0), "v", ["t"]).count() == 0


def test_ranges_never_fall(spark):
    values = sorted([math.inf, -math.inf, 0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, -1.0, *(random.Random(1).gauss(0, 1e3) for _ in range(500))])
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(stats.value_range(F.col("v"))).collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("undefined", [False, True])
def test_forward_median_like_sorting(spark, undefined):
    rng = random.Random(5)
    cells = [(rng.uniform(-0.4, 3.4), rng.uniform(-0.4, 1.4), rng.choice([1.0, 2.0, 3.0, rng.random(), None if rng.random() < 0.2 else 4.0])) for _ in range(60)]
    got = horizontal.forward(spark.createDataFrame(cells, "px double, py double, v double"), "v", "px", "py", 4, 2, "median", undefined)
    for r in got.collect():
        mine = [v for x, y, v in cells if (round(x), round(y)) == (r["ox"], r["oy"])]
        have = sorted(v for v in mine if v is not None)
        want = None if not have or (undefined and len(have) < len(mine)) else have[len(have) // 2]
        assert r["v"] == want


def test_axis_and_point_tables(spark):
    df = spark.createDataFrame([(t, z, 100.0 * z, float(t + z)) for t in range(2) for z in range(6)], "t int, z int, p double, v double")
    axis = df.select("z", "p").distinct()
    assert rows(extract.reduce_axis(df, "z", "p", 200, 400, axis=axis), "t", "z") == rows(extract.reduce_axis(df, "z", "p", 200, 400), "t", "z")
    grid = spark.createDataFrame([(t, y, x, 10.0 * x, 10.0 * y) for t in range(2) for y in range(3) for x in range(4)], "t int, y int, x int, lon double, lat double")
    points = grid.where("t = 0").select("x", "y", "lon", "lat")
    got = rows(extract.bounding_box(grid, 5, 15, 15, 35, points=points), "t", "y", "x")
    assert got == rows(extract.bounding_box(grid, 5, 15, 15, 35), "t", "y", "x") and len(got) == 4


RULES = """<cdmQualityConfig>
  <variable name="v"><status_flag_variable name="s"><allowed_values>1,2,...,4</allowed_values></status_flag_variable></variable>
  <variable name="w" fillValue="-999"><status_flag_variable name="land" file="mask.parquet"><allowed_values use="min:1"/></status_flag_variable></variable>
  <variable name="absent"><status_flag_variable name="s"><allowed_values use="all"/></status_flag_variable></variable>
</cdmQualityConfig>"""


def test_quality_document(spark):
    df = spark.createDataFrame([(t, x, 1.0, 2.0, float(x)) for t in range(2) for x in range(6)], "t int, x int, v double, w double, s double")
    land = spark.createDataFrame([(x, float(x % 2)) for x in range(5)], "x int, land double")
    asked = []
    out = GridDataset(df, ("t", "x")).quality(RULES, lambda *a: asked.append(a) or land)
    assert asked == [("mask.parquet", None, "land")]
    for r in out.df.collect():
        assert r["v"] == (1.0 if 1 <= r["x"] <= 4 else None)
        assert r["w"] == (2.0 if r["x"] < 5 and r["x"] % 2 else -999.0)
    with pytest.raises(ValueError):
        GridDataset(df, ("t",)).quality(RULES, lambda *a: land)


@pytest.mark.parametrize("text", ["<other/>", '<cdmQualityConfig><variable name="v"/></cdmQualityConfig>', '<cdmQualityConfig><variable name="v"><status_flag_variable name="s"/></variable></cdmQualityConfig>', '<cdmQualityConfig><variable name="v"><status_flag_variable name="s" type="netcdf3"><allowed_values use="all"/></status_flag_variable></variable></cdmQualityConfig>'])
def test_quality_document_that_cannot_be_applied(text):
    with pytest.raises(ValueError):
        quality.rules_of(text)


def test_template_and_coordinates(spark):
    df = spark.createDataFrame([(y, x, float(x), float(y), x + 10.0 * y) for y in range(4) for x in range(5)], "y int, x int, lon double, lat double, v double")
    grid = GridDataset(df, ("y", "x"), t=None)
    template = spark.createDataFrame([(0, 0, 1.5, 2.5), (0, 1, 0.25, 0.0), (3, 7, 40.0, 40.0)], "y int, x int, lon double, lat double")
    got = {(r["y"], r["x"]): r["v"] for r in grid.like("v", template, (0.0, 1.0, 0.0, 1.0)).df.collect()}
    assert got[0, 0] == pytest.approx(26.5) and got[0, 1] == pytest.approx(0.25) and got[3, 7] is None
    near = {(r["y"], r["x"]): r["v"] for r in grid.to_coordinates("v", [0.1, 3.9, 20.0], [0.9, 2.2], 60000.0).df.collect()}
    assert near == {(0, 0): 10.0, (0, 1): 14.0, (0, 2): None, (1, 0): 20.0, (1, 1): 24.0, (1, 2): None}


def test_kinds_by_first_bytes(spark, tmp_path):
    for name, data, want in (("a.nc", b"CDF\x01....", "netcdf3"), ("b.dat", b"CDF\x05....", "netcdf3"), ("c.nc", b"PAR1....", "parquet"), ("d.csv", b"x,y\n1,2\n", "csv"), ("e.json", b"", "json")):
        (tmp_path / name).write_bytes(data)
        assert kind_of(spark, str(tmp_path / name)) == want
    assert kind_of(spark, f"glob:{tmp_path}/*.x") == "netcdf3" and kind_of(spark, str(tmp_path)) == "parquet" and kind_of(spark, str(tmp_path / "none.orc")) == "orc"
