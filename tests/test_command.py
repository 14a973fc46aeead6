import numpy as np
import pytest

from gridspark.__main__ import main
from gridspark.plans.dataset import GridDataset
from gridspark.sources import grib, netcdf3


def test_command(spark, tmp_path):
    v = np.arange(24, dtype=np.float32).reshape(3, 2, 4)
    netcdf3.write(str(tmp_path / "a.nc"), {"t": 3, "y": 2, "x": 4}, [("v", ["t", "y", "x"], {"units": "K"}, v)], {}, "t")
    (tmp_path / "c.ini").write_text("[process]\naccumulateVariable=v\n")
    base = ["--input", str(tmp_path / "a.nc")]
    assert 'name="v"' in main([*base, "--print", "schema"]) and main([*base, "--print", "size"]) == "96"
    main([*base, "--variable", "v", "--config", str(tmp_path / "c.ini"), "--output", str(tmp_path / "o")], spark)
    got = {(r["t"], r["y"], r["x"]): r["v"] for r in spark.read.parquet(str(tmp_path / "o/cells")).collect()}
    assert got[2, 1, 3] == v[:, 1, 3].sum()
    assert main([*base, "--variable", "v", "--print", "stats"], spark).count("Row") == 3


def test_messages_of_a_file(spark, tmp_path):
    import datetime as dt

    m = grib.message(np.ones((2, 2)), 0, 0, 1, 1, dt.datetime(2020, 1, 1))
    (tmp_path / "a.grib").write_bytes(m + m)
    assert main(["--input", str(tmp_path / "a.grib"), "--print", "messages"], spark).count("Row") == 2
    a, b = grib.keys(m), grib.keys(grib.message(np.ones((2, 2)), 0.0005, 0, 1, 1, dt.datetime(2020, 1, 1)))
    assert grib.same_grid(a, b) and not grib.same_grid(a, b, 0) and not grib.same_grid(a, grib.keys(grib.message(np.ones((2, 3)), 0, 0, 1, 1, dt.datetime(2020, 1, 1))))


def test_nesting(spark):
    outer = [(y, x, 100.0 + x * 10 + y * 10) for y in range(6) for x in range(6)]
    inner = [(y, x, 500.0) for y in range(13) for x in range(13)]
    o = GridDataset(spark.createDataFrame(outer, "y int, x int, v double"), ("y", "x"), t=None)
    i = GridDataset(spark.createDataFrame(inner, "y int, x int, v double"), ("y", "x"), t=None)
    axis_o, axis_i = [10.0 * k for k in range(6)], [14.0 + k * 2 for k in range(13)]
    got = {(r["y"], r["x"]): r["v"] for r in o.nest(i, "v", (axis_i, axis_i), (axis_o, axis_o), 3, 1).df.collect()}
    assert len(got) == 26 * 26 and got[0, 0] == 100 and got[7 + 6, 7 + 6] == 500
    assert got[7, 7] == pytest.approx(100 + 14 + 14) and 128 < got[7 + 3, 7 + 6] < 500


def test_points_and_sections(spark):
    cells = [(y, x, float(x + 100 * y)) for y in range(9) for x in range(36)]
    g = GridDataset(spark.createDataFrame(cells, "y int, x int, v double"), ("y", "x"), t=None)
    source, proj = (-180.0, 10.0, -40.0, 10.0), "+proj=latlong"
    got = [r["v"] for r in g.to_points("v", [(0, 0), (179, 40), (-174, 0), (0, 80)], source, proj).df.orderBy("x").collect()]
    assert got == [418.0, 800.0, 401.0, None]
    line = g.cross_section("v", [(0, 0), (40, 0), (40, 20)], source, proj).df.orderBy("x").collect()
    assert [r["v"] for r in line] == pytest.approx([418, 419, 420, 421, 422, 522, 622]) and line[-1]["lat"] == pytest.approx(20)


def test_ncml_as_input(spark, tmp_path):
    from gridspark.sources import netcdf3

    for name, k in (("a", 0), ("b", 2)):
        netcdf3.write(str(tmp_path / f"{name}.nc"), {"t": 2, "x": 3}, [("t", ["t"], {}, np.arange(k, k + 2) * 1.0), ("v", ["t", "x"], {}, np.full((2, 3), k + 1.0))], {}, "t")
    path = tmp_path / "both.ncml"
    path.write_text('<netcdf><aggregation type="joinExisting"><scan location="." suffix=".nc"/></aggregation><variable name="w" orgName="v"/></netcdf>')
    assert 'length="4"' in main(["--input", str(path), "--print", "schema"], spark) and "'w'" in main(["--input", str(path), "--variable", "w", "--output", str(tmp_path / "out")], spark)
    assert {(r["t"], r["w"]) for r in spark.read.parquet(str(tmp_path / "out" / "cells")).collect()} == {(0, 1.0), (1, 1.0), (2, 3.0), (3, 3.0)}
