import datetime as dt

import numpy as np
import pytest

from gridspark.plans import dataset as ds
from gridspark.plans.config import run_config
from gridspark.plans.schema import GridSchema, Var, aggregation, apply_ncml
from gridspark.sources import netcdf3
from gridspark.streaming import slices


def make(path, start=0, n=3):
    t = np.arange(start, start + n) * 3600.0
    v = (np.arange(n * 2 * 4).reshape(n, 2, 4) + 100 * start).astype(np.int16)
    v[0, 0, 0] = -99
    netcdf3.write(str(path), {"t": n, "y": 2, "x": 4}, [("t", ["t"], {"units": "seconds since 2000-01-01"}, t), ("x", ["x"], {"axis": "X"}, np.arange(4, dtype=np.float32)), ("v", ["t", "y", "x"], {"scale_factor": 0.5, "add_offset": 10.0, "_FillValue": np.int16(-99)}, v)], {"title": "é"}, "t")
    return v


def test_header_and_slabs(tmp_path):
    v = make(tmp_path / "a.nc")
    with open(tmp_path / "a.nc", "rb") as f:
        h = netcdf3.read_header(f)
        assert h.dims == {"t": 3, "y": 2, "x": 4} and h.unlimited == "t" and h.attrs["title"] == "é" and h.variables["v"].attrs["scale_factor"] == 0.5
        assert (netcdf3.read_slab(f, h, h.variables["v"], 1, 3) == v[1:]).all()
        assert (netcdf3.read_slab(f, h, h.variables["x"]) == np.arange(4)).all()
    with pytest.raises(ValueError), open(__file__, "rb") as f:
        netcdf3.read_header(f)


def test_spark_source_joins_files(spark, tmp_path):
    v = [make(tmp_path / "a.nc"), make(tmp_path / "b.nc", 3)]
    spark.dataSource.register(netcdf3.NetCDF3)
    df = spark.read.format("netcdf3").option("variable", "v").option("rows", 8).load(str(tmp_path))
    got = {(r["t"], r["y"], r["x"]): r["v"] for r in df.collect()}
    both = np.concatenate(v)
    assert len(got) == both.size and df.rdd.getNumPartitions() == 6
    assert got[0, 0, 0] is None and got[4, 1, 2] == both[4, 1, 2] * 0.5 + 10 and df.where("t = 3").first()["t_value"] == 3 * 3600.0
    assert ds.read(spark, f"glob:{tmp_path}/b*.nc", variable="v").count() == 24


def schema():
    return GridSchema({"t": 4, "z": 2, "unused": 9}, "t", {"t": Var("double", ["t"], {"units": "hours since 2000-01-01"}), "z": Var("double", ["z"], {"units": "hPa", "positive": "down", "formula_terms": "ap: ap b: b ps: ps"}), "ap": Var("double", ["z"]), "b": Var("double", ["z"]), "ps": Var("float", ["t"]), "ta": Var("short", ["t", "z"], {"standard_name": "air_temperature", "coordinates": "lon"}), "lon": Var("float", [], {"units": "degrees_east"})})


def test_schema():
    s = schema()
    assert (s.role("t"), s.role("z"), s.role("lon"), s.role("ta")) == ("time", "pressure", "lon", None)
    assert s.auxiliary(["ta"]) == ["t", "z", "ap", "b", "ps", "ta", "lon"] and s.find(standard_name="air_.*") == ["ta"]
    assert "unused" not in s.without_unused_dims().dims
    e = s.edited(remove=["lon"], rename_dims={"t": "time"}, rename={"ta": "temp"}, retype={"ps": "double"}, attributes={("temp", "units"): "K"})
    assert e.unlimited == "time" and e.variables["temp"].dims == ["time", "z"] and e.variables["temp"].attrs["units"] == "K" and "lon" not in e.variables and s.unlimited == "t"


def test_ncml():
    s = schema()
    again = apply_ncml(s.to_ncml())
    assert again.dims == s.dims and again.unlimited == "t" and again.variables["ta"].attrs == s.variables["ta"].attrs
    view = apply_ncml('<netcdf><remove type="variable" name="lon"/><dimension name="time" orgName="t" isUnlimited="false"/><variable name="T" orgName="ta" type="double"><attribute name="n" type="int" value="3 4"/></variable><attribute name="x" value="y"/></netcdf>', s)
    assert view.unlimited is None and view.variables["T"].attrs["n"] == [3, 4] and view.variables["T"].kind == "double" and view.attrs["x"] == "y"
    a = aggregation('<netcdf><aggregation type="joinNew" dimName="run"><variableAgg name="v"/><netcdf location="a.nc" coordValue="1"/><scan location="d" suffix=".nc"/></aggregation></netcdf>')
    assert a == {"type": "joinNew", "dim": "run", "variables": ["v"], "parts": [("a.nc", "1")], "scans": [{"location": "d", "suffix": ".nc"}]}
    for bad in ('<netcdf><group name="g"/></netcdf>',):
        with pytest.raises(ValueError):
            apply_ncml(bad)


def test_config_run(spark):
    rows = [(t, y, x, float(t + x), dt.datetime(2020, 1, 1 + t)) for t in range(4) for y in range(3) for x in range(5)]
    g = ds.GridDataset(spark.createDataFrame(rows, "t int, y int, x int, v double, ts timestamp_ntz"), ("t", "y", "x"))
    out = run_config(g, "[process]\naccumulateVariable=v\n[extract]\nreduceDimension.name=x\nreduceDimension.start=1\nreduceDimension.end=3\nreduceTime.column=ts\nreduceTime.end=2020-01-03\nselectVariables=v\n")
    assert out.variables == ["v"] and out.df.count() == 3 * 3 * 3
    assert out.df.where("t = 2 and x = 0 and y = 0").first()["v"] == 1 + 2 + 3
    to = g.with_df(g.df.where("t = 0")).to_grid("v", [0.5, 1.5], [0.0, 1.0], (0.0, 1.0, 0.0, 1.0))
    assert {(r["y"], r["x"]): r["v"] for r in to.df.collect()}[0, 1] == 1.5
    with pytest.raises(ValueError):
        run_config(g, "[nothing]\na=1")


def test_streams(spark, tmp_path):
    rows = [(dt.datetime(2020, 1, 1 + t), t, x, float(t + x) if (t, x) != (2, 1) else None) for t in range(4) for x in range(2)]
    df = spark.createDataFrame(rows, "ts timestamp, t int, x int, v double")
    for t in range(4):
        df.where(f"t = {t}").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = slices.read_slices(spark, str(tmp_path / "in"), df.schema, 4)
    q = slices.running_sums(stream, "t", "v", ["x"]).writeStream.format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["x"], r["t"]): r["v"] for r in spark.table("sums").collect()}
    assert got == {(0, 0): 0.0, (0, 1): 1.0, (0, 2): 3.0, (0, 3): 6.0, (1, 0): 1.0, (1, 1): 3.0, (1, 2): None, (1, 3): None}
    w = slices.windowed(stream, "ts", "v", ["x"], "2 days").writeStream.format("memory").queryName("wins").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    w.awaitTermination()
    assert sum(r["n"] for r in spark.table("wins").collect()) == 7
    slices.append_slices(stream, str(tmp_path / "out"), str(tmp_path / "c3"), "t").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
