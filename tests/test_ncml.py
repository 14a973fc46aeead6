"""NcML on data: aggregations, scans, coordinates, changed names and kinds, given values."""

import numpy as np
import pytest

from gridspark.plans import ncml
from gridspark.sources import netcdf3


def make(path, start, n, extra=None, x=4):
    t = np.arange(start, start + n) * 1.0
    v = np.arange(n * x).reshape(n, x) + 100.0 * start
    more = [] if extra is None else [("extra", ["t", "x"], {}, np.full((n, x), float(extra)))]
    netcdf3.write(str(path), {"t": n, "x": x}, [("t", ["t"], {"units": "hours since 2000-01-01"}, t), ("x", ["x"], {"axis": "X"}, np.arange(x) * 10.0), ("v", ["t", "x"], {}, v), *more], {"title": str(start)}, "t")
    return v


@pytest.fixture
def files(tmp_path):
    (tmp_path / "sub").mkdir()
    return tmp_path, [make(tmp_path / "a.nc", 0, 2), make(tmp_path / "b.nc", 2, 3, extra=7), make(tmp_path / "sub" / "c.nc", 5, 1)]


def cells(opened, name):
    dims = opened.schema.variables[name].dims
    df = opened.cells(name)
    assert df.columns == [*dims, "value"]
    got = {tuple(r[d] for d in dims): r["value"] for r in df.collect()}
    assert len(got) == np.prod([opened.schema.dims[d] for d in dims], dtype=int)
    return got


def agg(kind, inside, attrs="", more=""):
    return f'<netcdf xmlns="http://www.unidata.ucar.edu/namespaces/netcdf/ncml-2.2"><aggregation type="{kind}" {attrs}>{inside}</aggregation>{more}</netcdf>'


def test_join_existing(spark, files):
    folder, v = files
    o = ncml.open_ncml(spark, agg("joinExisting", '<netcdf location="a.nc"/><netcdf location="b.nc"/><netcdf location="sub/c.nc"/>'), str(folder))
    both = np.concatenate(v)
    assert o.schema.dims == {"t": 6, "x": 4} and o.schema.unlimited == "t" and o.schema.attrs["title"] == "0"
    assert cells(o, "v") == {(t, x): both[t, x] for t in range(6) for x in range(4)}
    assert cells(o, "t") == {(t,): float(t) for t in range(6)} and cells(o, "x") == {(x,): 10.0 * x for x in range(4)}
    assert cells(o, "extra") == {(t, x): 7.0 if 2 <= t < 5 else None for t in range(6) for x in range(4)}  # missing where a part lacks it
    g = o.dataset("v", "extra")
    assert g.dims == ("t", "x") and g.t == "t"
    r = g.df.where("t = 5 and x = 3").first()
    assert (r["v"], r["extra"], r["t_value"], r["x_value"]) == (503.0, None, 5.0, 30.0)
    assert o.cells("v")._jdf.queryExecution().toString().count("Union") == 0  # plain files are one read
    with pytest.raises(ValueError):
        o.dataset("v", "x")


def test_parts_of_other_lengths_are_missing(spark, files):
    folder, v = files
    make(folder / "wide.nc", 9, 2, x=5)
    o = ncml.open_ncml(spark, agg("joinExisting", '<netcdf location="a.nc"/><netcdf location="wide.nc"/><netcdf location="b.nc"/>'), str(folder))
    got = cells(o, "v")
    assert all(got[t, x] is None for t in (2, 3) for x in range(4)) and got[4, 1] == v[1][0, 1] and cells(o, "t")[3,] == 10.0


def test_coordinates_of_parts(spark, files):
    folder, _ = files
    o = ncml.open_ncml(spark, agg("joinExisting", '<netcdf location="a.nc" coordValue="10 20"/><netcdf location="b.nc" coordValue="30, 40 50"/>'), str(folder))
    assert cells(o, "t") == {(k,): 10.0 * (k + 1) for k in range(5)}
    assert {r["t_value"] for r in o.dataset("v").df.where("t = 3").collect()} == {40.0}
    for wrong in ('coordValue="1 2 3"', 'coordValue="1"'):
        with pytest.raises(ValueError):
            ncml.open_ncml(spark, agg("joinExisting", f'<netcdf location="a.nc" {wrong}/>'), str(folder))
    with pytest.raises(ValueError):
        ncml.open_ncml(spark, agg("joinExisting", '<netcdf location="a.nc" coordValue="1 2"/><netcdf location="b.nc"/>'), str(folder))


def test_scan(spark, files):
    folder, _ = files
    (folder / "bad.nc").write_bytes(b"nothing")
    length = lambda scan: ncml.open_ncml(spark, agg("joinExisting", scan), str(folder)).schema.dims.get("t", 0)
    with pytest.warns(UserWarning):
        assert length('<scan location="." suffix=".nc"/>') == 6
    with pytest.warns(UserWarning):
        assert length('<scan location=". netcdf" suffix=".nc" subdirs="false"/>') == 5
    assert length('<scan location="." regExp="[bc]\\.nc"/>') == 4
    assert length('<scan location="." suffix=".none"/>') == 0


def test_join_new(spark, files):
    folder, v = files
    make(folder / "d.nc", 7, 2)
    text = '<variableAgg name="v"/><netcdf location="a.nc" {}/><netcdf location="b.nc" {}/><netcdf location="d.nc" {}/>'
    o = ncml.open_ncml(spark, agg("joinNew", text.format('coordValue="17"', 'coordValue="19"', 'coordValue="23"'), 'dimName="run"'), str(folder))
    assert o.schema.dims["run"] == 3 and o.schema.unlimited == "run" and o.schema.variables["v"].dims == ["run", "t", "x"]
    got = cells(o, "v")
    assert got[0, 1, 2] == v[0][1, 2] and got[2, 0, 0] == 700.0 and all(got[1, t, x] is None for t in range(2) for x in range(4))
    assert cells(o, "run") == {(0,): 17.0, (1,): 19.0, (2,): 23.0} and cells(o, "t") == {(0,): 0.0, (1,): 1.0}
    o = ncml.open_ncml(spark, agg("joinNew", text.format("", 'coordValue="19"', ""), 'dimName="run"'), str(folder))
    assert cells(o, "run") == {(0,): "location_0", (1,): "19", (2,): "location_2"}


def test_union(spark, files):
    folder, v = files
    make(folder / "e.nc", 4, 2, extra=3)
    with pytest.warns(UserWarning):  # b has extra on other lengths
        o = ncml.open_ncml(spark, agg("union", '<netcdf location="a.nc"/><netcdf location="b.nc"/><netcdf location="e.nc"/>'), str(folder))
    assert set(o.schema.variables) == {"t", "x", "v", "extra"}
    assert cells(o, "v")[1, 1] == v[0][1, 1] and set(cells(o, "extra").values()) == {3.0}


def test_views(spark, files):
    folder, v = files
    text = '''<netcdf location="a.nc netcdf"><remove type="variable" name="x"/><dimension name="time" orgName="t"/><variable name="time" orgName="t"/>
      <variable name="w" orgName="v" type="int"><attribute name="scale_factor" type="double" value="40"/></variable>
      <variable name="x" shape="x" type="double"><values start="5" increment="2.5"/></variable>
      <variable name="name" shape="time" type="string"><values separator=";">one;two</values></variable><variable name="two" shape="time x" type="double"><values>1 2 3 4 5 6 7 8</values></variable></netcdf>'''
    o = ncml.open_ncml(spark, text, str(folder))
    assert cells(o, "w") == {(t, x): 40.0 * round(v[0][t, x] / 40 + 1e-9) for t in range(2) for x in range(4)}
    assert cells(o, "time") == {(0,): 0.0, (1,): 1.0} and cells(o, "x") == {(k,): 5 + 2.5 * k for k in range(4)} and cells(o, "name") == {(0,): "one", (1,): "two"}
    assert cells(o, "two")[1, 2] == 7.0 and o.dataset("w", "two").df.where("time = 1 and x = 3").first()["x_value"] == 12.5
    for bad in ('<values start="1"/>', "<values>1 2 3</values>", '<values start="1" increment="1">1 2 3 4</values>', "<values/>"):
        with pytest.raises(ValueError):
            ncml.open_ncml(spark, f'<netcdf location="a.nc"><variable name="x">{bad}</variable></netcdf>', str(folder))


def test_nested_and_nothing(spark, files):
    folder, v = files
    (folder / "in.ncml").write_text(agg("joinExisting", '<netcdf location="a.nc"/><netcdf location="b.nc"/>'))
    o = ncml.open_ncml(spark, agg("joinExisting", '<netcdf location="in.ncml ncml"/><netcdf location="sub/c.nc"><variable name="v"><attribute name="n" value="1"/></variable></netcdf>'), str(folder))
    both = np.concatenate(v)
    assert cells(o, "v") == {(t, x): both[t, x] for t in range(6) for x in range(4)}
    assert ncml.open_ncml(spark, "<netcdf/>").schema.variables == {}
    with pytest.warns(UserWarning):
        twice = '<aggregation type="union"/>' * 2
        assert ncml.open_ncml(spark, f"<netcdf>{twice}</netcdf>").schema.variables == {}
    with pytest.raises(ValueError):
        ncml.open_ncml(spark, agg("forecast", ""))
    empty = ncml.open_ncml(spark, '<netcdf><dimension name="x" length="2"/><variable name="q" shape="x" type="int"/></netcdf>')
    with pytest.raises(ValueError):
        empty.cells("q")
