import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridspark.functions import columns as fc
from gridspark.functions import projections as pr
from gridspark.functions import units
from gridspark.functions.specs import axis_values, dotted, time_values
from gridspark.operators.combine import merged_axis
from gridspark.operators.horizontal import cross_section


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_dotted_lists():
    assert dotted("10,20,...,35") == [10, 20, 30, 35]
    assert dotted("20,10,...,-35") == [20, 10, 0, -10, -20, -30, -35]
    assert len(dotted("1.2,2.4,...,6")) == 5 and len(dotted("6,4.8,...,-1.2")) == 7 and len(dotted("90,89.96,...,50")) == 1001
    assert dotted("1,5,9") == [1, 5, 9]
    with pytest.raises(ValueError):
        dotted("1,...,5")


def test_axes():
    assert len(axis_values("-450000,-400000,...,50000")) == 11
    assert axis_values("0,50000,...,x,x+50000;relativeStart=0", 30000, 230000) == [0, 50000, 100000, 150000, 200000, 250000]
    with pytest.raises(ValueError):
        axis_values("0,5,...,x")


def test_times():
    t = time_values("2000-01-01 00:00:00,2000-01-01 04:00:00,...,2000-01-02 08:00:00")
    assert len(t) == 9 and t[-1] == dt.datetime(2000, 1, 2, 8)
    t = time_values("0,3,...,x,x+3;relativeUnit=hours since 2000-01-01 00:00:00", dt.datetime(2001, 1, 2), dt.datetime(2001, 1, 3, 8))
    assert len(t) == 12 and t[0] == dt.datetime(2001, 1, 2) and t[-1] == dt.datetime(2001, 1, 3, 9)


def test_units(spark):
    assert units.linear("km", "m") == (1000, 0)
    assert one(spark, units.convert(F.lit(1000.0), "hPa", "ln(re 1Pa)")) == pytest.approx(11.512925, abs=1e-6)
    assert one(spark, units.convert(F.lit(20.0), "degC", "degF")) == pytest.approx(68)
    assert one(spark, units.convert(F.lit(2.0), "days since 2000-01-01", "hours since 2000-01-02")) == 24
    assert not units.convertible("km", "s") and units.convertible("hPa", "bar") and units.is_time("hours since 2000-01-01")
    with pytest.raises(ValueError):
        units.linear("km", "s")


@pytest.mark.parametrize("source, target, slope", [("kg m-2 s-1", "g/m2 h-1", 3.6e6), ("W m-2", "kg s-3", 1), ("J/kg", "m2 s-2", 1), ("km h-1", "m s-1", 1 / 3.6), ("m^3", "L", 1000), ("10 m", "km", 0.01), ("hPa/h", "Pa s-1", 1 / 36), ("N.m", "kJ", 1e-3), ("mg per m**3", "kg m-3", 1e-6), ("K km-1", "degC/m", 1e-3), ("m", "mm", 1000), ("1e-3 kg", "g", 1), ("% m", "m", 0.01)])
def test_compound_units(source, target, slope):
    got, offset = units.linear(source, target)
    assert got == pytest.approx(slope) and offset == 0


@pytest.mark.parametrize("bad", ["furlong", "m//s", "m/", "kg m-2 q", "/", "0 m", "m-", "(m)"])
def test_unknown_units(bad):
    with pytest.raises(ValueError):
        units.linear(bad, "m")
    assert not units.convertible(bad, "m")


def test_packing(spark):
    new = lambda v: one(spark, fc.rescale(F.lit(v), (-32686, 2, 0), (-2.7e11, 0.5, 1)))
    assert [new(0.0), new(-32686.0), new(1.0)] == [-2, -2.7e11, 2]
    assert one(spark, fc.pack(F.lit(None).cast("double"), 0.1, 1, -99)) == -99 and one(spark, fc.missing(F.lit(float("nan")))) is None
    assert one(spark, fc.clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None and one(spark, fc.clamp(F.lit(5.0), 0.0, 1.0)) == 1.0


def test_vertical_coordinates(spark):
    sigma = [one(spark, fc.sigma_pressure(F.lit(0.0), F.lit(s), F.lit(1015.0))) for s in (1, 0.9, 0.8, 0.5, 0.1)]
    assert sigma == pytest.approx([1015, 913.5, 812, 507.5, 101.5])
    hybrid = [one(spark, fc.hybrid_pressure_p0(F.lit(a), F.lit(1000.0), F.lit(b), F.lit(1015.0))) for a, b in ((1, 0.0), (5, 0.00011835), (0.00098881774, 0.98881774))]
    assert hybrid == pytest.approx([1000, 5000.12, 1004.639], abs=1e-2)
    assert one(spark, fc.hybrid_height(F.lit(11.0), F.lit(1.1), F.lit(21.0))) == pytest.approx(11 + 1.1 * 21)
    assert one(spark, fc.standard_pressure(fc.standard_altitude(F.lit(500.0)))) == pytest.approx(500)
    assert one(spark, fc.relative_to_specific(fc.specific_to_relative(F.lit(0.005), F.lit(290.0), F.lit(90000.0)), F.lit(290.0), F.lit(90000.0))) == pytest.approx(0.005)


def test_rotation_keeps_length(spark):
    u, v = fc.rotate(F.lit(3.0), F.lit(-4.0), F.lit(0.7))
    assert one(spark, u * u + v * v) == pytest.approx(25)
    assert one(spark, fc.turn_direction(F.lit(10.0), F.lit(math.pi / 2))) == pytest.approx(280)


A = "+a=6371000 +e=0"


@pytest.mark.parametrize("text", [f"+proj=stere +lat_0=90 +lon_0=-32 +lat_ts=60 {A}", f"+proj=lcc +lat_0=63 +lon_0=15 +lat_1=63 +lat_2=63 {A}", f"+proj=ob_tran +o_proj=latlong +lon_0=-40 +o_lat_p=22 {A}", f"+proj=merc +lat_ts=20 {A}", f"+proj=laea +lat_0=60 +lon_0=10 {A}", f"+proj=utm +zone=33 {A}", f"+proj=omerc +lonc=5 +lat_0=55 +alpha=40 +gamma=40 {A}", f"+proj=geos +lon_0=5 +h=35785831 {A}", f"+proj=aea +lat_0=60 +lon_0=10 +lat_1=43 +lat_2=62 {A}"])
def test_projection_round_trip(spark, text):
    p = pr.parse(text)
    points = spark.createDataFrame([(lo / 2, la / 2) for lo in range(-30, 50, 7) for la in range(90, 150, 7)], "lon double, lat double")
    x, y = p.forward(F.col("lon"), F.col("lat"))
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    got = points.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect()
    assert all(abs(r["lon"] - r["lon2"]) < 1e-6 and abs(r["lat"] - r["lat2"]) < 1e-6 for r in got)


def test_projection_attributes():
    text = f"+proj=stere +lat_0=90 +lon_0=-32 +lat_ts=60 {A}"
    attrs = pr.to_cf(text)
    assert attrs["grid_mapping_name"] == "polar_stereographic"
    del attrs["proj4"]
    back = pr.parse(pr.from_cf(attrs))
    assert back.name == "stere" and back.keys["lat_ts"] == 60 and back.keys["lon_0"] == -32 and not back.degrees
    with pytest.raises(ValueError):
        pr.parse("+proj=nothing")


def test_lines_and_axes():
    line = cross_section([(0, 0), (4, 2), (4, 5)], 1, 1)
    assert len(line) == 8 and line[4] == (4, 2) and len(set(line)) == 8
    assert merged_axis([2, 3, 4], [0, 1, 5]) == [0, 1, 2, 3, 4, 5] and merged_axis([4, 3, 2], [0, 5]) == [5, 4, 3, 2, 1, 0]
    with pytest.raises(ValueError):
        merged_axis([2, 3, 9], [0, 10])
