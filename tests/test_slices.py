"""Horizontal interpolation of datasets with times and levels: each field by itself, against the field alone."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.plans.dataset import GridDataset

SOURCE, XS, YS = (0.0, 1.0, 50.0, 1.0), [0.4, 1.5, 2.6, 9.0], [50.3, 51.5, 49.0]


@pytest.fixture(scope="module")
def grid(spark):
    rng = random.Random(3)
    rows = [(t, z, y, x, t * 3600.0, float(x), 50.0 + y, rng.random() if rng.random() < 0.9 else None, rng.random()) for t in range(3) for z in range(2) for y in range(5) for x in range(6) if (t, y, x) != (1, 2, 2)]
    df = spark.createDataFrame(rows, "t int, z int, y int, x int, t_value double, lon double, lat double, v double, w double")
    return GridDataset(df, ("t", "z", "y", "x"))


def fields(data, *names):
    return {(r["t"], r["z"], r["y"], r["x"]): tuple(r[n] for n in names) for r in data.df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], nan_ok=True) if None not in a[k] + b[k] else a[k] == b[k]


def apart(grid, call):
    """The same by one field after the other."""
    out = {}
    for t in range(3):
        for z in range(2):
            one = GridDataset(grid.df.where(f"t = {t} and z = {z}").drop("t", "z", "t_value"), ("y", "x"), t=None)
            for name in ("v", "w"):
                for r in call(one, name).df.collect():
                    out.setdefault((t, z, r["y"], r["x"]), []).append(r[name])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("method", ["nearest", "bilinear", "bicubic", "forward_mean", "forward_undef_max", "forward_median"])
def test_to_grid(grid, method):
    call = lambda g, v: g.to_grid(v, XS, YS, SOURCE, method=method)
    out = call(grid, ["v", "w"])
    assert out.dims == ("t", "z", "y", "x") and out.t == "t" and out.df.where("t = 2").agg(F.min("t_value"), F.max("t_value")).first()[:] == (7200.0, 7200.0)
    got = fields(out, "v", "w")
    assert len(got) == 3 * 2 * 3 * 4
    close(got, apart(grid, call))


def test_points_templates_and_sections(spark, grid):
    latlon = "+proj=latlong"
    close(fields(grid.to_points(["v", "w"], [(1.2, 52.1), (2.0, 52.0), (40.0, 0.0)], SOURCE, latlon, "bilinear"), "v", "w"), apart(grid, lambda g, v: g.to_points(v, [(1.2, 52.1), (2.0, 52.0), (40.0, 0.0)], SOURCE, latlon, "bilinear")))
    close(fields(grid.cross_section(["v", "w"], [(0, 50), (4, 52)], SOURCE, latlon), "v", "w"), apart(grid, lambda g, v: g.cross_section(v, [(0, 50), (4, 52)], SOURCE, latlon)))
    template = spark.createDataFrame([(0, 0, 1.1, 51.9), (0, 1, 3.3, 53.0)], "y int, x int, lon double, lat double")
    close(fields(grid.like(["v", "w"], template, SOURCE), "v", "w"), apart(grid, lambda g, v: g.like(v, template, SOURCE)))


def test_nearest_by_coordinates_is_the_same_cell_for_all_fields(grid):
    got = fields(grid.to_coordinates("v", [1.9, 30.0], [52.1], 60000.0), "v")
    own = fields(grid, "v")
    for t in range(3):
        for z in range(2):  # at t = 1 the cell isn't there, and no other takes its place
            assert got[t, z, 0, 0] == own.get((t, z, 2, 2), (None,)) and got[t, z, 0, 1] == (None,)


def test_nesting_each_time(spark):
    outer = GridDataset(spark.createDataFrame([(t, y, x, 100.0 * t + x) for t in range(2) for y in range(6) for x in range(6)], "t int, y int, x int, v double"), ("t", "y", "x"))
    inner = GridDataset(spark.createDataFrame([(t, y, x, 1000.0 * (t + 1)) for t in range(2) for y in range(7) for x in range(7)], "t int, y int, x int, v double"), ("t", "y", "x"))
    axis_o, axis_i = [10.0 * k for k in range(6)], [20.0 + 2 * k for k in range(7)]
    got = {(r["t"], r["y"], r["x"]): r["v"] for r in outer.nest(inner, "v", (axis_i, axis_i), (axis_o, axis_o), 1, 1).df.collect()}
    assert len(got) == 2 * 26 * 26 and got[0, 13, 13] == 1000.0 and got[1, 13, 13] == 2000.0 and got[1, 0, 0] == 100.0 and got[0, 0, 25] == 5.0
