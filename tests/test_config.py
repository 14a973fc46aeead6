"""Runs from ini texts: their order, and each section against the operator that it stands for."""

import math

import pytest
from pyspark.sql import functions as F

from gridspark.functions.projections import north_angle, parse
from gridspark.operators import process
from gridspark.plans.config import run_config, slab_process, smoothing
from gridspark.plans.dataset import GridDataset

PROJ = "+proj=stere +lat_0=90 +lon_0=10 +lat_ts=60 +a=6371000 +e=0"


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(t, z, y, x, 1000.0 - 100 * z, float(5 * x), 50.0 + y, float(1 + t + 10 * x + 100 * y + z), math.sin(x + y) * 9, 4.0 - t) for t in range(3) for z in range(3) for y in range(4) for x in range(5)]
    return GridDataset(spark.createDataFrame(rows, "t int, z int, y int, x int, z_value double, lon double, lat double, v double, u double, w double"), ("t", "z", "y", "x"))


def cells(data, *names):
    return sorted(tuple(round(r[n], 9) if isinstance(r[n], float) else r[n] for n in (*data.dims, *names)) for r in data.df.collect())


def test_processes_come_before_extraction_whatever_the_order_in_the_text(grid):
    text = "[extract]\nreduceDimension.name=t,x\nreduceDimension.start=1,0\nreduceDimension.end=2,1\n[process]\naccumulateVariable=v\n"
    got = {(r["t"], r["z"], r["y"], r["x"]): r["v"] for r in run_config(grid, text).df.collect()}
    assert len(got) == 2 * 3 * 4 * 2 and got[0, 0, 0, 0] == 1 + 2 and got[1, 0, 0, 1] == 11 + 12 + 13  # sums since the first time, which is cut away afterwards


def test_interpolation_comes_before_levels(grid):
    text = "[verticalInterpolate]\naxis=z_value\nlevel1=950\nvariables=v\ndimension=level\n[interpolate]\nvariable=v\nmethod=bilinear\nxAxisValues=0.5,1.5\nyAxisValues=1\nsource=0,1,0,1\n"
    flat = text.replace("dimension=level", "dimension=z")
    out = run_config(grid, flat)
    got = {(r["t"], r["x"]): r["v"] for r in out.df.collect()}
    assert got == {(t, k): pytest.approx(1 + t + 10 * (k + 0.5) + 100 + 0.5) for t in range(3) for k in range(2)}


def test_vectors(grid):
    angle = north_angle(parse(PROJ), F.col("lon"), F.col("lat"))
    turned = grid.with_df(process.rotate_vectors(grid.df, "u", "w", angle))
    head = f"[process]\nrotateVector.projString={PROJ}\nrotateVector.direction="
    assert cells(run_config(grid, head + "latlon\nrotateVector.x=u\nrotateVector.y=w\n"), "u", "w") == cells(turned, "u", "w")
    assert cells(run_config(grid, head + "latlon\nrotateVector.all=u:x_wind,w:y_wind\n"), "u", "w") == cells(turned, "u", "w")
    back = run_config(turned, head + "grid\nrotateVector.all=u:eastward_wind,w:northward_wind\n")
    assert cells(back, "u", "w") == cells(grid, "u", "w") == cells(run_config(turned, head + "grid\nrotateVector.x=u\nrotateVector.y=w\n"), "u", "w")
    assert cells(run_config(grid, head + "latlon\nrotateVector.angle=v\n"), "v") == cells(grid.with_df(process.rotate_direction(grid.df, "v", angle)), "v")
    for bad in ("north\nrotateVector.x=u\nrotateVector.y=w\n", "latlon\n", "latlon\nrotateVector.x=u,v\nrotateVector.y=w\n"):
        with pytest.raises(ValueError):
            run_config(grid, head + bad)


def test_extraction(grid):
    out = run_config(grid, "[extract]\npickDimension.name=t,y\npickDimension.list=0,2;1\nreduceVerticalAxis.name=z\nreduceVerticalAxis.unit=hPa\nreduceVerticalAxis.axisUnit=hPa\nreduceVerticalAxis.start=850\nreduceVerticalAxis.end=1000\nselectVariables=v\n")
    assert {(r["t"], r["z"], r["y"]) for r in out.df.collect()} == {(t, z, 0) for t in range(2) for z in range(2)} and out.variables == ["v"]
    with pytest.raises(ValueError):
        run_config(grid, "[extract]\nreduceDimension.name=x\nreduceDimension.end=9\n")


def test_places(spark, grid):
    one = "[interpolate]\nvariable=v,u\nsource=0,5,50,1\nsourceProjString=+proj=latlong\n"
    points = run_config(grid, one + "method=bilinear\nlatitudeValues=51,52.5\nlongitudeValues=7.5,0\n")
    got = {(r["t"], r["z"], r["x"]): r["v"] for r in points.df.collect()}
    assert len(got) == 18 and got[2, 1, 0] == pytest.approx(1 + 2 + 15 + 100 + 1) and got[0, 0, 1] == pytest.approx(1 + 250)
    line = run_config(grid, one + "vcross=0 50,20 50\nmethod=bilinear\n")
    assert [r["v"] for r in line.df.where("t = 0 and z = 0").orderBy("x").collect()] == pytest.approx([1, 11, 21, 31, 41])
    template = spark.createDataFrame([(0, 0, 5.0, 53.0)], "y int, x int, lon double, lat double")
    at = run_config(grid, one + "template=t.nc\n", lambda path, kind, variable: template)
    assert {r["v"] for r in at.df.where("t = 1 and z = 0").collect()} == {1 + 1 + 10 + 300.0}
    near = run_config(grid, "[interpolate]\nvariable=v\nmethod=coord_kdtree\ndistanceOfInterest=90000\nxAxisValues=5.3,90\nyAxisValues=51.2\n")
    assert cells(near, "v")[:2] == [(0, 0, 0, 0, 111.0), (0, 0, 0, 1, None)]


def test_fills_before_and_after(grid):
    holes = grid.with_df(grid.df.withColumn("v", F.when((F.col("x") != 2) | (F.col("y") != 2), F.col("v"))))
    text = "[interpolate]\nvariable=v\nmethod=bilinear\nsource=0,1,0,1\nxAxisValues=1.5,2\nyAxisValues=1.5,2\n"
    assert run_config(holes, text).df.where("v is null").count() == 9 * 4
    for key in ("preprocess", "postprocess"):
        for how in ("creepfill2d(repeat=20,weight=2,defaultValue=0.0)", "fill2d(critx=0.01,cor=1.6,maxLoop=100)"):
            filled = run_config(holes, text + f"{key}={how}\n").df
            assert filled.count() == 36 and (key == "postprocess" or filled.where("v is null").count() == 0)
    for bad in ("creep(1,2)", "fill2d(1,2)", "creepfill2d(1)", "creepfill2d(1,2,3,4)"):
        with pytest.raises(ValueError):
            slab_process(bad)


def test_merge_and_its_own_text(spark, tmp_path):
    outer = GridDataset(spark.createDataFrame([(t, y, x, 100.0 * t) for t in range(2) for y in range(6) for x in range(6)], "t int, y int, x int, v double"), ("t", "y", "x"))
    inner = spark.createDataFrame([(t, y, x, 1000.0 * (t + 1)) for t in range(2) for y in range(7) for x in range(7)], "t int, y int, x int, v double")
    (tmp_path / "inner.cfg").write_text("[process]\naccumulateVariable=v\n")
    text = f"[merge]\ninner.file=i.nc\ninner.cfg={tmp_path}/inner.cfg\nvariable=v\nxAxisValues=0,10,...,50\nyAxisValues=0,10,...,50\ninnerXAxisValues=20,22,...,32\ninnerYAxisValues=20,22,...,32\nsmoothing=LINEAR(1,1)\n"
    got = {(r["t"], r["y"], r["x"]): r["v"] for r in run_config(outer, text, lambda path, kind, variable: inner).df.collect()}
    assert got[0, 13, 13] == 1000.0 and got[1, 13, 13] == 3000.0 and got[1, 0, 0] == 100.0
    assert smoothing("LINEAR") == (5, 2) and smoothing("LINEAR(3, 1)") == (3, 1)
    with pytest.raises(ValueError):
        smoothing("CUBIC(1,2)")


def test_what_does_not_exist(grid):
    for bad in ("[nothing]\na=1", "[extract]\nreduceDimensions.name=x\n", "[process]\naccumulate=v\n"):
        with pytest.raises(ValueError):
            run_config(grid, bad)
