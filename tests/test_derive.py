import math
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import columns as fc
from gridspark.operators import derive
from gridspark.plans.schema import GridSchema, Var
from gridspark.sources import netcdf3, sinks


def test_conversions(spark):
    df = spark.createDataFrame([(300.0, 500.0, 0.0005, 0.5)], "air_potential_temperature double, air_pressure double, specific_humidity double, w double")
    out = derive.convert_by(df, "theta2T", "specific2relative;out=rh", "omega2vwind;omega=w;out=up").first()
    t = 300 * 0.5 ** (fc.R_DRY / fc.CP)
    assert out["air_temperature"] == pytest.approx(t) and out["rh"] == pytest.approx(100 * 0.0005 * 50000 / (0.622 * 610.78 * math.exp(17.269 * (t - 273.16) / (t - 35.86)))) and out["up"] == pytest.approx(-fc.R_DRY * t * 0.5 / (fc.G * 50000))
    with pytest.raises(ValueError):
        derive.convert_by(df, "nothing;a=b")


def test_formula_terms(spark):
    cells = spark.createDataFrame([(t, z) for t in range(2) for z in range(3)], "t int, z int")
    ab = spark.createDataFrame([(z, 10.0 * z, 1 - z / 4) for z in range(3)], "z int, hyam double, hybm double")
    ps = spark.createDataFrame([(0, 1000.0), (1, 900.0)], "t int, sp double")
    df = derive.broadcast_terms(cells, (ab, ["z"]), (ps, ["t"]))
    p = derive.coordinate("atmosphere_hybrid_sigma_pressure_coordinate", "ap: hyam b: hybm ps: sp")
    got = {(r["t"], r["z"]): r["p"] for r in df.withColumn("p", p).collect()}
    assert got[1, 2] == 20 + 0.5 * 900 and derive.GIVES["ocean_s_coordinate_g1"] == "depth"
    with pytest.raises(ValueError):
        derive.coordinate("ocean_sigma_coordinate", "a: b")


def test_altitude_order(spark):
    rows = [(0, z, 900.0 - 100 * z, 280.0, 1000.0, 50.0) for z in range(3)]
    df = spark.createDataFrame(rows, "t int, z int, air_pressure double, air_temperature double, surface_air_pressure double, surface_altitude double")
    layers = [r["altitude"] for r in derive.altitude(df, ["t"]).orderBy("z").collect()]
    assert layers == sorted(layers) and layers[0] == pytest.approx(50 + np.log(1000 / 900) * 280 * fc.R_DRY / fc.G)
    assert derive.altitude(df.withColumn("geopotential_height", F.lit(1.0)), ["t"]).first()["altitude"] == 1.0
    assert derive.altitude(df.select("t", "z", "air_pressure"), ["t"]).where("z = 0").first()["altitude"] == pytest.approx(8434.5 * np.log(1013.25 / 900), rel=1e-3)
    assert derive.height_from_altitude(derive.altitude(df, ["t"])).where("z = 0").first()["height"] == pytest.approx(layers[0] - 50)


def test_template_levels(spark):
    df = spark.createDataFrame([(c, float(z), float(z * 10 + c)) for c in range(2) for z in range(5)], "c int, z double, v double")
    tpl = spark.createDataFrame([(0, 0, 0.5), (1, 0, 2.25)], "c int, level int, target double")
    got = {r["c"]: r["v"] for r in derive.to_template(df, F.col("z"), ["v"], tpl, "target", ["c"]).collect()}
    assert got == {0: 5.0, 1: 23.5}


def test_vertical_velocity(spark):
    """Air that flows apart at all heights sinks; the top level has no wind."""
    rows = [(0, z, y, x, float(x), 0.0, 280.0, 0.0, (z + 0.5) / 4, 1e5, 0.0) for z in range(4) for y in range(3) for x in range(5)]
    df = spark.createDataFrame(rows, "t int, z int, y int, x int, x_wind double, y_wind double, air_temperature double, ap double, b double, surface_air_pressure double, surface_altitude double")
    got = {(r["z"], r["y"], r["x"]): r["upward_air_velocity"] for r in derive.add_vertical_velocity(df).collect()}
    assert got[0, 1, 2] == 0 and got[3, 1, 2] > got[1, 1, 2] > 0 and got[3, 0, 0] == got[3, 1, 1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(t, y, x, None if (t, y, x) == (1, 0, 0) else t * 10.0 + y + x / 4) for t in range(3) for y in range(2) for x in range(4)], "t int, y int, x int, v double")
    s = GridSchema({"t": 3, "y": 2, "x": 4, "gone": 7}, "t", {"v": Var("double", ["t", "y", "x"], {"units": "K"})})
    sinks.write_parquet(df, str(tmp_path / "p"), s, "t")
    back, schema = sinks.read_parquet(spark, str(tmp_path / "p"))
    assert back.count() == 24 and schema.variables["v"].attrs == {"units": "K"} and "gone" not in schema.dims
    (tmp_path / "nc").mkdir()
    assert sinks.write_netcdf(df, str(tmp_path / "nc"), "v", ["t", "y", "x"], {"y": 2, "x": 4}, "t", "short", 0.25, 1.0).count() == 3
    spark.dataSource.register(netcdf3.NetCDF3)
    again = spark.read.format("netcdf3").option("variable", "v").load(str(tmp_path / "nc"))
    want = {(r["t"], r["y"], r["x"]): r["v"] for r in df.collect()}
    assert {(r["t"], r["y"], r["x"]): r["v"] for r in again.collect()} == want
    sinks.write_nothing(df)
