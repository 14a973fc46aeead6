"""Queries answer for every row of their tables, held against brute force on tables larger than the smallest ones."""

import datetime as dt
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridspark import catalog

N = 1100
SUPPLIERS = 40


def position(i):
    return i * 7 % 190 / 10.0 - 0.3, i * 13 % 200 / 10.0 - 0.2


def lonlat(i):
    return float(i * 37 % 360 - 180), float(i * 17 % 140 - 70)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    put = lambda name, **columns: pq.write_table(pa.table(columns), d / f"{name}.parquet")
    ids = list(range(1, N + 1))
    put("customer", c_custkey=pa.array(ids, pa.int64()), c_acctbal=[float(i) for i in ids])
    cells = [(x, y) for x in range(20) for y in range(20)]
    put("lineitem", l_suppkey=pa.array([x for x, _ in cells], pa.int64()), l_partkey=pa.array([y for _, y in cells], pa.int64()), l_quantity=[1.0 + x * x + 0.7 * y for x, y in cells])
    keys = list(range(1, SUPPLIERS + 1))
    put("supplier", s_suppkey=pa.array(keys, pa.int64()), s_acctbal=[10.0 * k for k in keys])
    days = [(t, u) for t in range(9) for u in range(3)]
    put("events", ts=pa.array([dt.datetime(2024, 1, 3) + dt.timedelta(days=t) for t, _ in days], pa.timestamp("us")), user_id=pa.array([u for _, u in days], pa.int64()), value=[1.0 + t * t + u for t, u in days])
    return str(d)


def cubic(t):
    t = abs(t)
    return (1.5 * t - 2.5) * t * t + 1 if t <= 1 else ((-0.5 * t + 2.5) * t - 4) * t + 2 if t < 2 else 0.0


def around(px, py, reach, weight):
    """Weighted sum over the cells around a position; none if one with a weight is missing."""
    total = 0.0
    for x in range(math.floor(px) + reach[0], math.floor(px) + reach[1] + 1):
        for y in range(math.floor(py) + reach[0], math.floor(py) + reach[1] + 1):
            w = weight(px - x) * weight(py - y)
            if w or reach[0] < 0:
                if not (0 <= x < 20 and 0 <= y < 20):
                    return None
                total += w * (1.0 + x * x + 0.7 * y) * catalog.FACTOR
    return total


def linear(px, py):
    """Along each axis linear between two cells, or the nearest one beside the outermost cells."""

    def side(p):
        f = math.floor(p)
        if 0 <= f and f + 1 < 20:
            return [(f, 1 - (p - f)), (f + 1, p - f)]
        r = math.floor(abs(p) + 0.5) * (1 if p >= 0 else -1)
        return [(r, 1.0)] if 0 <= r < 20 else []

    cells = [(x, y, v * w) for x, v in side(px) for y, w in side(py)]
    return sum(w * (1.0 + x * x + 0.7 * y) * catalog.FACTOR for x, y, w in cells) if cells else None


@pytest.mark.parametrize("name", ["nearest", "bilinear", "bicubic"])
def test_positions_of_all_points(spark, tables, name):
    got = {r["id"]: r["v"] for r in catalog.QUERIES[f"hint_{name}"].run(spark, tables).collect()}
    assert sorted(got) == list(range(1, N + 1))
    for i, v in got.items():
        px, py = position(i)
        if name == "nearest":
            x, y = (math.floor(p) + (p - math.floor(p) >= 0.5) for p in (px, py))
            want = (1.0 + x * x + 0.7 * y) * catalog.FACTOR if 0 <= x < 20 and 0 <= y < 20 else None
        else:
            want = around(px, py, (-1, 2), cubic) if name == "bicubic" else linear(px, py)
        assert v == (None if want is None else pytest.approx(want, abs=1e-3)), i


def test_nearest_cells_of_all_points(spark, tables):
    def angle(a, b):
        (lo, la), (so, sa) = ([math.radians(v) for v in p] for p in (a, b))
        return math.acos(max(-1.0, min(1.0, math.sin(la) * math.sin(sa) + math.cos(la) * math.cos(sa) * math.cos(lo - so))))

    got = {r["id"]: r for r in catalog.QUERIES["hint_coord_nearest"].run(spark, tables).collect()}
    assert sorted(got) == list(range(1, N + 1))
    cells = {k: (float(k * 53 % 360 - 180), float(k * 29 % 160 - 80)) for k in range(1, SUPPLIERS + 1)}
    for i, r in got.items():
        far, k = min((round(angle(lonlat(i), at) * 6371000, 3), k) for k, at in cells.items())
        if far > 900000:
            assert r["v"] is None and r["distance"] is None, i
        else:
            assert r["v"] == 10.0 * k and abs(r["distance"] - far) <= 1, i


def test_relative_times_over_the_whole_axis(spark, tables):
    got = {(r["x"], r["target"]): r["v"] for r in catalog.QUERIES["time_interp_relative_spec"].run(spark, tables).collect()}
    start, value = dt.datetime(2024, 1, 3), lambda t, u: (1.0 + t * t + u) * catalog.FACTOR
    hours = range(0, 8 * 24 + 7, 6)  # from the first day to six hours after the last
    assert sorted(got) == sorted((u, start + dt.timedelta(hours=h)) for u in range(3) for h in hours)
    for (u, at), v in got.items():
        f = (at - start) / dt.timedelta(days=1)
        a = min(int(f), 7)
        assert v == pytest.approx(value(a, u) + (f - a) * (value(a + 1, u) - value(a, u)), abs=1e-3), (u, at)


@pytest.mark.parametrize("name", ["merc", "polar_stere", "sinu", "cea", "laea", "lcc", "tmerc"])
def test_projections_of_all_points(spark, tables, name):
    got = {r["id"]: r for r in catalog.QUERIES[f"proj_{name}"].run(spark, tables).collect()}
    assert sorted(got) == list(range(1, N + 1))
    opposite = [i for i in got if name == "laea" and lonlat(i) == (-180.0, -50.0)]  # of the centre, where it is undefined
    assert [i for i, r in got.items() if not r["back"]] == opposite
    assert [i for i, r in got.items() if r["x"] is None or r["y"] is None] == opposite
    if name == "sinu":
        for i, r in got.items():
            lon, lat = lonlat(i)
            assert r["x"] == pytest.approx(math.radians(lon) * math.cos(math.radians(lat)) * 6371, abs=2e-3) and r["y"] == pytest.approx(math.radians(lat) * 6371, abs=2e-3), i


def test_round_trips_of_all_points(spark, tables):
    got = {r["projection"].split()[0]: r for r in catalog.QUERIES["proj_roundtrip_all"].run(spark, tables).collect()}
    for name in ("latlong", "merc", "cea", "sinu", "utm"):
        assert (got[f"+proj={name}"]["points"], got[f"+proj={name}"]["back"]) == (N, N), name
