"""Operators against values worked out from the definitions, cell by cell."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import columns as fc
from gridspark.operators import horizontal, process, slabs, vertical


def test_bilinear_beside_the_border(spark):
    """Half a cell beyond the outermost cells it is linear along the border, in corners the nearest; further out nothing."""
    g = spark.createDataFrame([(x, y, float(10 * y + x * x)) for x in range(4) for y in range(4)], "x int, y int, v double")
    at = [(-0.3, 1.0, 10.0), (3.4, 1.5, 24.0), (1.5, -0.4, 2.5), (-0.3, -0.3, 0.0), (3.0, 3.0, 39.0), (-0.5, 1.0, None), (1.0, 3.5, None), (2.5, 2.5, 31.5), (float("nan"), 1.0, None)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(at)], "id int, px double, py double")
    for shape in (None, (4, 4)):
        got = {r["id"]: r["v"] for r in horizontal.bilinear(g, df, "v", shape=shape).collect()}
        assert [got[k] for k in range(len(at))] == [None if w is None else pytest.approx(w) for *_, w in at]
    hole = g.where("not (x = 2 and y = 1)")
    got = {r["id"]: r["v"] for r in horizontal.bilinear(hole, df, "v").collect()}
    assert got[1] == pytest.approx(24.0) and got[7] == pytest.approx(31.5)
    on_line = spark.createDataFrame([(0, 1.0, 1.0)], "id int, px double, py double")
    assert horizontal.bilinear(hole, on_line, "v").first()["v"] is None  # a missing cell counts even with no weight


def test_long_axes(spark):
    r = np.random.default_rng(1)
    axis = np.sort(r.uniform(-1000, 1000, 3000)).tolist()
    values = [*r.uniform(-1100, 1100, 300).tolist(), axis[0], axis[-1], axis[1234]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    for a in (axis, axis[::-1], [3.0, 5.0]):
        got = {x["k"]: x["position"] for x in horizontal.positions_on(df, "v", a).collect()}
        up = a if a[-1] > a[0] else a[::-1]
        for k, v in enumerate(values):
            i = min(max(int(np.searchsorted(up, v, "right")) - 1, 0), len(a) - 2)
            want = i + (v - up[i]) / (up[i + 1] - up[i])
            assert got[k] == pytest.approx(want if up is a else len(a) - 1 - want, abs=1e-6)


def test_times_with_absent_slices(spark):
    day = lambda h: dt.datetime(2020, 1, 1, h)
    g = spark.createDataFrame([(day(0), 0, 0.0), (day(6), 0, 6.0), (day(6), 1, 60.0), (day(12), 1, 120.0), (day(12), 0, 12.0)], "ts timestamp_ntz, x int, v double")
    times = spark.createDataFrame([(day(3),), (day(9),), (day(21),)], "target timestamp_ntz")
    got = {(r["target"].hour, r["x"]): r["v"] for r in vertical.interpolate_time(g, "ts", times, "target", ["v"], ["x"]).collect()}
    assert got == {(3, 0): 3.0, (3, 1): None, (9, 0): 9.0, (9, 1): 90.0, (21, 0): None, (21, 1): None}  # no more than one step outside
    axis = spark.createDataFrame([(day(h),) for h in (0, 6, 12, 18)], "ts timestamp_ntz")
    got = {(r["target"].hour, r["x"]): r["v"] for r in vertical.interpolate_time(g, "ts", times, "target", ["v"], ["x"], axis).collect()}
    assert got[21, 0] == 12.0 and got[21, 1] == 120.0  # the last slice is absent, so the one before it counts
    one = vertical.interpolate_time(g.where("v = 6"), "ts", times, "target", ["v"], ["x"]).collect()
    assert sorted((r["target"].hour, r["v"]) for r in one) == [(3, 6.0), (9, 6.0), (21, 6.0)]
    assert vertical.interpolate_time(g.limit(0), "ts", times, "target", ["v"], ["x"]).count() == 0


def creep_by_cells(field, repeat, weight, default):
    f = field.copy()
    hole, (ny, nx) = np.isnan(field), field.shape
    f[hole] = np.nanmean(field) if default is None else default
    w, left = np.where(hole, 0, weight), np.where(hole, repeat, 0)
    rounds, going = 0, True
    while going and rounds < (~hole).sum():
        going, rounds = False, rounds + 1
        for y in range(1, ny - 1):
            for x in range(1, nx - 1):
                beside = [(y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)]
                total = sum(w[c] for c in beside)
                if left[y, x] and total:
                    f[y, x] = (f[y, x] + sum(w[c] * f[c] for c in beside)) / (1 + total)
                    w[y, x], going = 1, True
                    left[y, x] -= 1
    for _ in range(repeat):
        sides = [((y, c), (y, n)) for y in range(1, ny - 1) for c, n in ((0, 1), (nx - 1, nx - 2))] + [((c, x), (n, x)) for x in range(nx) for c, n in ((0, 1), (ny - 1, ny - 2))]
        for edge, inner in sides:
            if hole[edge]:
                f[edge] = (f[edge] + w[inner] * f[inner]) / (1 + w[inner])
                w[edge] = 1
    return f


def fill_by_cells(field, criterion, relaxation, rounds):
    f, hole, (ny, nx) = field.copy(), np.isnan(field), field.shape
    mean = np.nanmean(field)
    f[hole] = mean
    limit = criterion * np.abs(field[~hole] - mean).mean() * relaxation
    for n in range(rounds):
        most = 0.0
        for y in range(1, ny - 1):
            for x in range(1, nx - 1):
                if hole[y, x]:
                    step = relaxation * ((f[y, x + 1] + f[y, x - 1] + f[y + 1, x] + f[y - 1, x]) / 4 - f[y, x])
                    f[y, x] += step
                    most = max(most, abs(step))
        if n < rounds - 5 and n % 10 == 0 and most <= limit:
            break
        for y in range(1, ny - 1):
            for c, k in ((0, 1), (nx - 1, nx - 2)):
                if hole[y, c]:
                    f[y, c] = f[y, k]
        for x in range(nx):
            for c, k in ((0, 1), (ny - 1, ny - 2)):
                if hole[c, x]:
                    f[c, x] = f[k, x]
    return f


@pytest.mark.parametrize("seed", range(6))
def test_fills_by_cells(seed):
    r = np.random.default_rng(seed)
    field = r.normal(10, 4, (9 + seed, 14 - seed))
    field[r.random(field.shape) < (0.3, 0.7, 0.95)[seed % 3]] = np.nan
    field[4, 4] = 7.0
    for repeat, weight, default in ((20, 2, None), (3, 5, None), (20, 2, 1.5)):
        assert slabs.creep(field, repeat, weight, default) == pytest.approx(creep_by_cells(field, repeat, weight, default), abs=1e-9)
    for criterion, rounds in ((0.01, 100), (1e-6, 37)):
        assert slabs.fill(field, criterion, 1.6, rounds) == pytest.approx(fill_by_cells(field, criterion, 1.6, rounds), abs=1e-9)


def test_creeping_reaches_far_holes():
    field = np.full((60, 60), np.nan)
    field[5, 5], field[50, 12] = 1.0, 9.0
    assert slabs.creep(field, 60) == pytest.approx(creep_by_cells(field, 60, 2, None), abs=1e-9)
    field[:, :3] = np.arange(60)[:, None]
    grown = slabs.creep(field)
    assert (grown[2:-2, 3:-1] != np.nanmean(field)).all() and grown == pytest.approx(creep_by_cells(field, 20, 2, None), abs=1e-9)


def test_vertical_velocity_by_cells():
    r = np.random.default_rng(2)
    nz, ny, nx, (dx, dy) = 5, 6, 7, (1000.0, 2000.0)
    u, v, t = r.normal(5, 3, (nz, ny, nx)), r.normal(0, 3, (nz, ny, nx)), r.normal(270, 5, (nz, ny, nx))
    ps, zs = r.normal(1e5, 300, (ny, nx)), r.uniform(0, 200, (ny, nx))
    hx, hy = r.uniform(0.9, 1.1, (ny, nx)), r.uniform(0.9, 1.1, (ny, nx))
    ah, bh = [2000.0 * k * (nz - k) for k in range(nz + 1)], [(k / nz) ** 2 for k in range(nz + 1)]
    ap, b = [(p + q) / 2 for p, q in zip(ah, ah[1:], strict=False)], [(p + q) / 2 for p, q in zip(bh, bh[1:], strict=False)]
    gas, g = 8.31432 / 0.0289644, 9.80665
    p = lambda k, y, x: ah[k] + bh[k] * ps[y, x]
    dp = lambda k, y, x: p(k + 1, y, x) - p(k, y, x)
    ln = lambda k, y, x: math.log(p(k + 1, y, x) / p(k, y, x)) if k else 0.0
    alpha = lambda k, y, x: 1 - p(k, y, x) * ln(k, y, x) / dp(k, y, x) if k else math.log(2)

    def phi(k, y, x):
        return zs[y, x] * g + sum(gas * t[m, y, x] * ln(m, y, x) for m in range(k + 1, nz)) + gas * t[k, y, x] * alpha(k, y, x)

    def div(k, y, x):
        along_x = hy[y, x + 1] * u[k, y, x + 1] * dp(k, y, x + 1) - hy[y, x - 1] * u[k, y, x - 1] * dp(k, y, x - 1)
        along_y = hx[y + 1, x] * v[k, y + 1, x] * dp(k, y + 1, x) - hx[y - 1, x] * v[k, y - 1, x] * dp(k, y - 1, x)
        return (along_x / (2 * dx) + along_y / (2 * dy)) / (hx[y, x] * hy[y, x])

    got = slabs.vertical_velocity(u, v, t, np.array(ap), np.array(b), ps, zs, (dx, dy), hx * dx, hy * dy)
    for k in range(1, nz):
        for y in range(1, ny - 1):
            for x in range(1, nx - 1):
                above = sum(div(m, y, x) for m in range(1, k))
                w1 = gas * t[k, y, x] * (ln(k, y, x) * above + alpha(k, y, x) * div(k, y, x)) / dp(k, y, x)
                w2 = (phi(k, y, x + 1) - phi(k, y, x - 1)) / (2 * dx * hx[y, x]) + (phi(k, y + 1, x) - phi(k, y - 1, x)) / (2 * dy * hy[y, x])
                assert got[k, y, x] == pytest.approx((w1 + w2) / g, rel=1e-9)
    assert (got[0] == 0).all() and (got[2, 0, 1:-1] == got[2, 1, 1:-1]).all() and (got[2, :, 0] == got[2, :, 1]).all()


def test_vectors_by_standard_names(spark):
    names = {"u10": "x_wind_10m", "v10": "y_wind_10m", "ice_u": "sea_ice_x_velocity", "ice_v": "sea_ice_y_velocity", "e": "eastward_wind", "n": "northward_wind", "t": "air_temperature", "lonely": "sea_water_x_velocity"}
    assert process.vector_pairs(names) == [("u10", "v10", "map"), ("ice_u", "ice_v", "map"), ("e", "n", "earth")]
    dims = {k: ["y", "x"] for k in names} | {"ice_v": ["t", "y", "x"]}
    assert ("ice_u", "ice_v", "map") not in process.vector_pairs(names, dims)
    assert process.counterpart("eastward_derivative_of_northward_sea_ice_velocity") == "northward_derivative_of_northward_sea_ice_velocity"
    df = spark.createDataFrame([(1.0, 0.0, 2.0, 0.0)], "u10 double, v10 double, e double, n double")
    known = {k: v for k, v in names.items() if k in df.columns}
    got = process.rotate_all(df, known, F.lit(math.pi / 2)).first()
    assert (got["u10"], got["v10"], got["e"], got["n"]) == (pytest.approx(0), pytest.approx(1), 2.0, 0.0)
    got = process.rotate_all(df, known, F.lit(math.pi / 2), to_earth=False).first()
    assert (got["u10"], got["e"], got["n"]) == (1.0, pytest.approx(0), pytest.approx(-2))


@pytest.mark.parametrize(("method", "want"), [("forward_mean", [0.5, 2.5, None]), ("forward_sum", [1.0, 5.0, None]), ("forward_max", [1.0, 3.0, None]), ("forward_undef_mean", [None, 2.5, None])])
def test_datasets_gather_cells(spark, method, want):
    """Own columns 0 to 3 lie at 0, 10, 20, 30; new ones at 5, 25, 45; one own cell is missing."""
    from gridspark.plans.dataset import GridDataset

    df = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (0, 2, 2.0), (0, 3, 3.0), (1, 0, None)], "y int, x int, v double")
    g = GridDataset(df, ("y", "x"), t=None).to_grid("v", [5.0, 25.0, 45.0], [0.0, 100.0], (0.0, 10.0, 0.0, 1.0), method=method)
    got = {(r["y"], r["x"]): r["v"] for r in g.df.collect()}
    assert [got[0, k] for k in range(3)] == want and [got[1, k] for k in range(3)] == [None] * 3
    with pytest.raises(ValueError):
        GridDataset(df, ("y", "x"), t=None).to_grid("v", [5.0, 25.0], [0.0, 1.0], (0.0, 10.0, 0.0, 1.0), method="forward_most")


def test_humidity(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    es = 610.78 * math.exp(17.269 * (280 - 273.16) / (280 - 35.86))
    assert one(fc.specific_to_relative(F.lit(0.004), F.lit(280.0), F.lit(95000.0))) == pytest.approx(100 * 0.004 * 95000 / (es * 0.622))
    assert one(fc.specific_to_relative(F.lit(0.04), F.lit(280.0), F.lit(95000.0))) == 100 and one(fc.specific_to_relative(F.lit(-0.1), F.lit(280.0), F.lit(95000.0))) == 0
    assert one(fc.relative_to_specific(F.lit(60.0), F.lit(280.0), F.lit(95000.0))) == pytest.approx(0.6 * es * 0.622 / 95000)
    assert one(fc.dewpoint_to_relative(F.lit(273.15), F.lit(283.15))) == pytest.approx(100 * math.exp(-17.625 * 10 / 253.04))
    assert one(fc.dewpoint_to_relative(F.lit(290.0), F.lit(280.0))) == 100
