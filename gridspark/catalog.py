"""Queries over the driver's tables, one or more per operator, each with the DuckDB SQL of the same result.

Grids are built from the tables by aggregates, so that SQL can build the same: ``events`` gives values by day and user group, ``lineitem``
fields on a 20 x 20 grid and columns of seven levels, ``customer`` points on the sphere. Doubles are rounded to four decimals.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as fc
from .functions import projections as pr
from .functions.specs import dotted, time_values
from .functions.units import convert
from .operators import combine, derive, extract, horizontal, process, quality, slabs, stats, vertical


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}
DIGITS = 4
#: Keeps values off the ties of rounding, where the order of a sum would decide.
FACTOR = 1.047197551


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = Query(fn, sql)
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(c) + 0.0, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --------------------------------------------------------------------------- grids

EVENTS = "events_grid as (select cast(date_diff('day', date '2024-01-01', cast(ts as date)) as int) as t, cast(user_id % 10 as int) as x, sum(value) * 1.047197551 as v from events group by all)"
PART = "part_grid as (select cast(l_suppkey % 20 as int) as x, cast(l_partkey % 20 as int) as y, avg(l_quantity) * 1.047197551 as v from lineitem group by all)"
COL = "col_grid as (select cast(year(l_shipdate) as int) as t, cast(l_linenumber as int) as z, (1000.0 - 120.0 * (l_linenumber - 1))::double as p, avg(l_extendedprice) * 1.047197551 as v from lineitem group by all)"
LONLAT = "points as (select c_custkey as id, ((c_custkey * 37) % 360 - 180)::double as lon, ((c_custkey * 17) % 140 - 70)::double as lat, c_acctbal * 1.047197551 as v from customer)"
UV = "uv_grid as (select cast(year(l_shipdate) as int) as t, cast(l_suppkey % 20 as int) as x, cast(l_partkey % 20 as int) as y, avg(l_discount) * 1.047197551 as u, avg(l_tax) * 1.047197551 as v from lineitem group by all)"
STATUS = "status_grid as (select cast(year(o_orderdate) as int) as t, cast(o_custkey % 20 as int) as x, sum(o_totalprice) * 1.047197551 as v, cast(max(case o_orderstatus when 'O' then 2 when 'F' then 1 else 0 end) + count(*) % 3 as double) as status from orders group by all)"


def events_grid(spark, d):
    return table(spark, d, "events").groupBy(F.datediff("ts", F.lit("2024-01-01")).alias("t"), (F.col("user_id") % 10).cast("int").alias("x")).agg((F.sum("value") * FACTOR).alias("v"))


def part_grid(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).cast("int").alias("x"), (F.col("l_partkey") % 20).cast("int").alias("y")).agg((F.avg("l_quantity") * FACTOR).alias("v"))


def col_grid(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("t"), F.col("l_linenumber").cast("int").alias("z")).agg((F.avg("l_extendedprice") * FACTOR).alias("v"))
    return g.withColumn("p", 1000.0 - (F.col("z") - 1) * 120.0)


def points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), ((k * 37) % 360 - 180).cast("double").alias("lon"), ((k * 17) % 140 - 70).cast("double").alias("lat"), (F.col("c_acctbal") * FACTOR).alias("v"))


def uv_grid(spark, d):
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("t"), (F.col("l_suppkey") % 20).cast("int").alias("x"), (F.col("l_partkey") % 20).cast("int").alias("y")).agg((F.avg("l_discount") * FACTOR).alias("u"), (F.avg("l_tax") * FACTOR).alias("v"))


def status_grid(spark, d):
    code = F.when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("t"), (F.col("o_custkey") % 20).cast("int").alias("x")).agg((F.sum("o_totalprice") * FACTOR).alias("v"), (F.max(code) + F.count("*") % 3).cast("double").alias("status"))


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --------------------------------------------------------------------------- subsets


@query(f"with {EVENTS}, acc as (select t, x, v - coalesce(lag(v) over (partition by x order by t), 0) as v from events_grid where t between 3 and 25) select t, count(v) as n_def, count(*) - count(v) as n_undef, round(sum(v), 4) as total, round(avg(v), 4) as mean, round(list_sort(list(v))[cast(floor(count(v) / 2) as bigint) + 1], 4) as median, round(min(v), 4) as least, round(max(v), 4) as largest, round(stddev_samp(v), 4) as stddev from acc group by t")
def events_field_stats(spark, d):
    g = events_grid(spark, d).where(F.col("t").between(3, 25))
    g = process.deaccumulate(g, "v", "t", ["x"])
    return rounded(stats.field_stats(g, "v", ["t"]))


@query(f"with {UV} select t, x, y, round(u, 4) as u from uv_grid")
def extract_select(spark, d):
    return rounded(extract.select_variables(uv_grid(spark, d), ["u", "nothing"], ["t", "x", "y"]))


@query(f"with {UV} select t, x, y, round(v, 4) as v from uv_grid")
def extract_remove(spark, d):
    return rounded(extract.remove_variables(uv_grid(spark, d), ["u"]))


@query(f"with {PART} select x - 4 as x, y, round(v, 4) as v from part_grid where x between 4 and 9")
def extract_reduce_dim(spark, d):
    return rounded(extract.reduce_dimension(part_grid(spark, d), "x", 4, 6))


@query(f"with {PART} select x - 4 as x, y, round(v, 4) as v from part_grid where x between 4 and 16")
def extract_reduce_dim_from_end(spark, d):
    return rounded(extract.reduce_dimension_start_end(part_grid(spark, d), "x", 4, -3, 20))


@query(f"with {PART} select cast(case x when 1 then 0 when 4 then 1 when 7 then 2 when 10 then 3 else 4 end as int) as x, y, round(v, 4) as v from part_grid where x in (1, 4, 7, 10, 12)")
def extract_pick_dim(spark, d):
    return rounded(extract.pick_dimension(part_grid(spark, d), "x", "1,4,...,10,12"))


@query("select event_id, ts, round(value, 4) as value from events where ts >= timestamp '2024-01-05 06:00:00' and ts <= timestamp '2024-01-09 18:00:00'")
def extract_reduce_time(spark, d):
    e = extract.reduce_time(table(spark, d, "events"), "ts", dt.datetime(2024, 1, 5, 6), dt.datetime(2024, 1, 9, 18))
    return rounded(e.select("event_id", "ts", "value"))


@query(f"with {COL} select t, z - (select min(z) from col_grid where p between 400 - 1.2 and 761.2) as z, round(p, 4) as p, round(v, 4) as v from col_grid where p between 398.8 and 761.2")
def extract_reduce_vertical(spark, d):
    return rounded(extract.reduce_axis(col_grid(spark, d), "z", "p", 40000.0, 76000.0, "Pa", "hPa").select("t", "z", "p", "v"))


_BOX = "with {L}, g as (select id, cast(id % 30 as int) as x, cast(id // 30 as int) as y, lon, lat, v from points), i as (select x, y from g where lat between {s} and {n} and {c}) select id, x, y, lon, lat, round(v, 4) as v from g where x in (select x from i) and y in (select y from i)"


def _box_grid(spark, d):
    return points(spark, d).select("id", (F.col("id") % 30).cast("int").alias("x"), F.floor(F.col("id") / 30).cast("int").alias("y"), "lon", "lat", "v")


@query(_BOX.format(L=LONLAT, s=-10, n=20, c="lon between -20 and 30"))
def extract_bbox(spark, d):
    return rounded(extract.bounding_box(_box_grid(spark, d), -10, 20, -20, 30))


@query(_BOX.format(L=LONLAT, s=0, n=25, c="(lon >= 165 or lon <= -170)"))
def extract_bbox_wrap180(spark, d):
    return rounded(extract.bounding_box(_box_grid(spark, d), 0, 25, 165, -170))


# --------------------------------------------------------------------------- packing and units


@query(f"with {PART} select x, y, cast(round((v - 25) / 0.01) as int) as packed, round(round((v - 25) / 0.01) * 0.01 + 25, 4) as v from part_grid")
def scale_offset_pack(spark, d):
    g = part_grid(spark, d).withColumn("packed", fc.pack(F.col("v"), 0.01, 25.0, -32767))
    return rounded(g.select("x", "y", "packed", fc.unpack(F.col("packed"), 0.01, 25.0, -32767).alias("v")))


@query("select s_suppkey, round(coalesce((nullif(cast(s_nationkey as double), 3) * 2 + 1 - 5) / 0.5, -99.0), 4) as v from supplier")
def scale_change_fill(spark, d):
    return rounded(table(spark, d, "supplier").select("s_suppkey", fc.rescale(F.col("s_nationkey"), (3, 2, 1), (-99, 0.5, 5)).alias("v")))


@query("select s_suppkey, nullif(s_nationkey, 7) as v from supplier")
def fill_to_null(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", fc.missing(F.col("s_nationkey").cast("double"), 7).cast("int").alias("v"))


@query(f"with {PART} select x, y, round(greatest(25.0, least(26.0, v)), 4) as v from part_grid")
def valid_range_clamp(spark, d):
    return rounded(part_grid(spark, d).withColumn("v", fc.clamp(F.col("v"), 25.0, 26.0)))


@query(f"with {COL} select t, z, round(p * 100, 4) as pa, round(p / 1000, 4) as bar, round(z * 1.8::double + 32, 4) as f, round(ln(p * 100), 4) as ln_pa from col_grid")
def unit_convert(spark, d):
    c = F.col
    return rounded(col_grid(spark, d).select("t", "z", convert(c("p"), "hPa", "Pa").alias("pa"), convert(c("p"), "mbar", "bar").alias("bar"), convert(c("z").cast("double"), "degC", "degF").alias("f"), convert(c("p"), "hPa", "ln(re 1 Pa)").alias("ln_pa")))


@query("select event_id, round((epoch_us(ts) / 1e6 - epoch_us(timestamp '2000-01-01') / 1e6) / 3600, 4) as hours from events")
def unit_convert_time(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return rounded(table(spark, d, "events").select("event_id", convert(seconds, "seconds since 1970-01-01", "hours since 2000-01-01").alias("hours")))


@query(f"with {PART} select x, y, round(round(v / 0.25) * 0.25, 4) as v from part_grid")
def round_to_precision(spark, d):
    return rounded(part_grid(spark, d).withColumn("v", fc.to_precision(F.col("v"), 0.25)))


# --------------------------------------------------------------------------- along time, and vectors


@query(f"with {EVENTS}, g as (select t, x, case when (t * 7 + x) % 23 = 0 then null else v end as v from events_grid), f as (select *, row_number() over (partition by x order by t) as n from g), s as (select *, sum(case when v is null and n > 1 then 1 else 0 end) over w as broken, sum(coalesce(v, 0)) over w as total from f window w as (partition by x order by t)) select t, x, round(case when broken > 0 then null when n = 1 then v else total end, 4) as v from s")
def accumulate(spark, d):
    g = events_grid(spark, d).withColumn("v", F.when((F.col("t") * 7 + F.col("x")) % 23 != 0, F.col("v")))
    return rounded(process.accumulate(g, "v", "t", ["x"]))


@query(f"with {EVENTS}, g as (select t, x, case when (t * 7 + x) % 23 = 0 then null else v end as v from events_grid), f as (select *, row_number() over w as n, lag(v) over w as b from g window w as (partition by x order by t)) select t, x, round(case n when 1 then v when 2 then v - coalesce(b, 0) else v - b end, 4) as v from f")
def deaccumulate(spark, d):
    g = events_grid(spark, d).withColumn("v", F.when((F.col("t") * 7 + F.col("x")) % 23 != 0, F.col("v")))
    return rounded(process.deaccumulate(g, "v", "t", ["x"]))


@query(f"with {EVENTS} select t, x, round(v, 3) as v from events_grid")
def accumulate_roundtrip(spark, d):
    g = process.accumulate(events_grid(spark, d), "v", "t", ["x"])
    return process.deaccumulate(g, "v", "t", ["x"]).withColumn("v", F.round("v", 3))


_ANGLE = "(x * 0.1 - y * 0.05)"


def _angle():
    return F.col("x") * 0.1 - F.col("y") * 0.05


@query(f"with {UV} select t, x, y, round(u * cos{_ANGLE} - v * sin{_ANGLE}, 4) as u, round(u * sin{_ANGLE} + v * cos{_ANGLE}, 4) as v from uv_grid")
def rotate_vector(spark, d):
    return rounded(process.rotate_vectors(uv_grid(spark, d), "u", "v", _angle()))


@query(f"with {UV} select t, x, y, round(u, 4) as u, round(v, 4) as v from uv_grid")
def vector_roundtrip(spark, d):
    g = process.rotate_vectors(uv_grid(spark, d).withColumn("a", _angle()), "u", "v", "a")
    return rounded(process.rotate_vectors(g, "u", "v", -F.col("a")).drop("a"))


@query(f"with {PART}, a as (select x, y, v * 14 - degrees{_ANGLE} as r from part_grid) select x, y, round(r - 360 * floor(r / 360), 4) as v from a")
def rotate_direction(spark, d):
    return rounded(process.rotate_direction(part_grid(spark, d).withColumn("v", F.col("v") * 14), "v", _angle()))


_GEO = "acos(greatest(-1, least(1, sin(radians({b})) * sin(radians({d})) + cos(radians({b})) * cos(radians({d})) * cos(radians({c} - {a})))))"


@query(f"with g as (select distinct cast(l_suppkey % 20 as int) as x, cast(l_partkey % 20 as int) as y from lineitem), h as (select x, y, x * 1.5 - 10 as lon, y * 0.75 + 50 as lat from g), d as (select *, case when lead(lon) over r is not null then {_GEO.format(a='lon', b='lat', c='lead(lon) over r', d='lead(lat) over r')} * 6371000 end as dx, case when lead(lon) over c is not null then {_GEO.format(a='lon', b='lat', c='lead(lon) over c', d='lead(lat) over c')} * 6371000 end as dy from h window r as (partition by y order by x), c as (partition by x order by y)) select x, y, round(coalesce(dx, lag(dx) over (partition by y order by x)), 2) as dx, round(coalesce(dy, lag(dy) over (partition by x order by y)), 2) as dy from d")
def grid_distance(spark, d):
    g = part_grid(spark, d).select("x", "y", (F.col("x") * 1.5 - 10).alias("lon"), (F.col("y") * 0.75 + 50).alias("lat"))
    return process.grid_distance(g).select("x", "y", F.round("dx", 2).alias("dx"), F.round("dy", 2).alias("dy"))


# --------------------------------------------------------------------------- quality


def _quality(name, rule, test):
    sql = f"with {STATUS} select t, x, round(case when {test} then v end, 4) as v from status_grid"

    def run(spark, d):
        return rounded(quality.mask(status_grid(spark, d), "v", F.col("status"), rule, ["t"]).select("t", "x", "v"))

    QUERIES[f"quality_{name}"] = Query(run, sql)


_quality("values", [1.0, 3.0], "status in (1, 3)")
_quality("value_list", "values=0,2,...,4", "status in (0, 2, 4)")
_quality("min", "min:2", "status >= 2")
_quality("max", "max:2", "status <= 2")
_quality("highest", "highest", "status = max(status) over (partition by t)")
_quality("lowest", "lowest", "status = min(status) over (partition by t)")
_quality("all", "all", "true")


@query(f"with {STATUS} select t, x, round(case when status between 1 and 3 and status <> 2 and status >= 1 then v else -999 end, 4) as v from status_grid")
def quality_defined_fill(spark, d):
    return rounded(quality.mask(status_grid(spark, d), "v", quality.defined(F.col("status"), 1, 3, 2), "min:1", fill=-999.0).select("t", "x", "v"))


@query(f"with {COL} select c.t, z, round(case when c.t % 3 <> 0 then v end, 4) as v from col_grid c")
def quality_broadcast_levels(spark, d):
    g = col_grid(spark, d)
    status = g.select("t").distinct().withColumn("ok", (F.col("t") % 3).cast("double"))
    return rounded(quality.mask_by(g, "v", status, "ok", "min:1", ["t"]).select("t", "z", "v"))


# --------------------------------------------------------------------------- datasets together


def _halves(spark, d):
    g = events_grid(spark, d)
    return g.where("t < 12").withColumn("w", F.col("v") * 2), g.where("t >= 12").withColumn("t", F.col("t") - 12)


@query(f"with {EVENTS} select t, x, round(v, 4) as v, round(case when t < 12 then v * 2 end, 4) as w from events_grid")
def agg_join_existing(spark, d):
    a, b = _halves(spark, d)
    return rounded(combine.join_existing([a, b], "t", [12, 18]).select("t", "x", "v", "w"))


@query(f"with {EVENTS} select t, x, round(v, 4) as v from events_grid")
def agg_join_existing_counted(spark, d):
    a, b = _halves(spark, d)
    return rounded(combine.join_existing([a.drop("w"), b], "t"))


@query(f"with {EVENTS} select case when t < 12 then t else t - 12 end as t, x, round(v, 4) as v, cast(case when t < 12 then 0 else 1 end as int) as run, case when t < 12 then 'location_0' else 'location_1' end as run_value from events_grid")
def agg_join_new(spark, d):
    a, b = _halves(spark, d)
    return rounded(combine.join_new([a, b], "run", ["v"], ["t", "x"]))


@query(f"with {EVENTS} select case when t < 12 then t else t - 12 end as t, x, round(v, 4) as v, cast(case when t < 12 then 0 else 1 end as int) as run, case when t < 12 then 17.5 else 19.0 end::double as run_value from events_grid")
def agg_join_new_coord(spark, d):
    a, b = _halves(spark, d)
    return rounded(combine.join_new([a, b], "run", ["v"], ["t", "x"], ["17.5", "19"]))


@query(f"with {UV}, {PART}, a as (select x, y, avg(u) as u from uv_grid where x < 15 group by all) select coalesce(a.x, p.x) as x, coalesce(a.y, p.y) as y, round(u, 4) as u, round(p.v, 4) as v from a full join (select * from part_grid where y > 2) p on a.x = p.x and a.y = p.y")
def agg_union(spark, d):
    a = uv_grid(spark, d).where("x < 15").groupBy("x", "y").agg(F.avg("u").alias("u"))
    return rounded(combine.union([a, part_grid(spark, d).where("y > 2")], ["x", "y"]))


@query(f"with {PART}, n as (select x, y + 3 as y, v * 10 as v from part_grid where x < 6) select coalesce(n.x, p.x) as x, coalesce(n.y, p.y) as y, round(case when n.x is not null then n.v else p.v end, 4) as v from part_grid p full join n on n.x = p.x and n.y = p.y")
def fill_writer_upsert(spark, d):
    g = part_grid(spark, d)
    return rounded(combine.upsert(g, g.where("x < 6").select("x", (F.col("y") + 3).alias("y"), (F.col("v") * 10).alias("v")), ["x", "y"], ["v"]))


@query(f"with {PART}, n as (select x + 17 as x, y, v * 10 as v from part_grid where x < 6) select coalesce(n.x, p.x) as x, coalesce(n.y, p.y) as y, round(case when n.x is not null then n.v else p.v end, 4) as v from part_grid p full join (select * from n where x in (select x from part_grid)) n on n.x = p.x and n.y = p.y")
def fill_writer_fixed_dim(spark, d):
    g = part_grid(spark, d)
    return rounded(combine.upsert(g, g.where("x < 6").select((F.col("x") + 17).alias("x"), "y", (F.col("v") * 10).alias("v")), ["x", "y"], ["v"], fixed=["x"]))


@query(f"with {PART} select p.x, p.y, round(coalesce(t.v, p.v), 4) as v from part_grid p left join (select x, y, v + 100 as v from part_grid where (x + y) % 3 = 0) t using (x, y)")
def overlay_top_over_base(spark, d):
    g = part_grid(spark, d)
    return rounded(combine.overlay(g, g.where("(x + y) % 3 = 0").withColumn("v", F.col("v") + 100), ["x", "y"], ["v"]))


@query(f"with {PART} select p.x, p.y, round(coalesce(t.v, p.v * 100), 4) as v from part_grid p left join (select x, y, v * 7 as v from part_grid where x > 11) t using (x, y)")
def overlay_unit_convert(spark, d):
    g = part_grid(spark, d)
    return rounded(combine.overlay(g, g.where("x > 11").withColumn("v", F.col("v") * 7), ["x", "y"], ["v"], "hPa", "Pa"))


@query(f"with {PART}, g as (select x, y, v, 100 - v as o, sqrt(power(greatest(7 - x, x - 12, 0), 2) + power(greatest(7 - y, y - 12, 0), 2)) as away from part_grid), w as (select *, greatest(0, least(1, 1 - away / 5.0)) as a from g) select x, y, round(a * v + (1 - a) * o, 4) as v from w")
def border_smoothing_linear(spark, d):
    g = part_grid(spark, d)
    return rounded(combine.merge_smooth(g, g.withColumn("v", 100 - F.col("v")), ["x", "y"], "v", 20, 20))


# --------------------------------------------------------------------------- time


def _times_sql(times):
    return "times as (select q::double as target from (values " + ", ".join(f"({t})" for t in times) + ") v(q))"


_T = [-0.5, 0.0, 3.25, 7.0, 28.5, 29.0, 29.75, 31.5]


def _pairs_sql(rows: str, number: str) -> str:
    """The steps around each target and the two values of each cell there."""
    return f"""ax as (select t, lag(t) over (order by t) as b, lead(t) over (order by t) as n from (select distinct t from {rows})),
    lo as (select target, max(t) as lo from times left join ax on t < target group by target), hi as (select target, min(t) as hi from times left join ax on t >= target group by target),
    p as (select target, case when lo is null then hi when hi is null then coalesce((select b from ax where t = lo), lo) else lo end as ta, case when hi is null then lo when lo is null then coalesce((select n from ax where t = hi), hi) else hi end as tb from lo join hi using (target)),
    i as (select target, x, {number.format('target')} - {number.format('ta')} as num, {number.format('tb')} - {number.format('ta')} as den, max(case when t = ta then v end) as va, max(case when t = tb then v end) as vb from p join {rows} on t = ta or t = tb group by target, x, ta, tb),
    f as (select *, num / nullif(den, 0) as f from i) select x, target, round(case when den = 0 or f = 0 then va when f = 1 then vb when f between -1 and 2 then va + f * (vb - va) end, 4) as v from f"""


@query(f"with {EVENTS}, {_times_sql(_T)}, {_pairs_sql('events_grid', '({})::double')}")
def time_interp_weak_extra(spark, d):
    times = values(spark, [(t,) for t in _T], "target double")
    return rounded(vertical.interpolate_time(events_grid(spark, d), "t", times, "target", ["v"], ["x"]))


_DAYS = "select x, t, v from events_grid"
_SPEC = "0,6,...,x,x+6;relativeUnit=hours since 2024-01-01 00:00:00"


@query(f"with {EVENTS}, daily as (select timestamp '2024-01-01' + interval (t) day as t, x, v from events_grid), times as (select unnest(generate_series((select min(t) from daily), (select max(t) from daily) + interval 6 hour, interval 6 hour)) as target), {_pairs_sql('daily', 'epoch_us({})::double')}")
def time_interp_relative_spec(spark, d):
    daily = events_grid(spark, d).select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(t)").alias("ts"), "x", "v")
    first, last = table(spark, d, "events").agg(*(f(F.datediff("ts", F.lit("2024-01-01"))) for f in (F.min, F.max))).first()
    times = [] if first is None else time_values(_SPEC, *(dt.datetime(2024, 1, 1) + dt.timedelta(days=t) for t in (first, last)))
    targets = values(spark, [(t,) for t in times], "target timestamp_ntz")
    return rounded(vertical.interpolate_time(daily, "ts", targets, "target", ["v"], ["x"]))


# --------------------------------------------------------------------------- vertical interpolation

_LEVELS = [1050.0, 1000.0, 850.0, 640.0, 333.0, 200.0, 100.0]


def _between_sql(method, f):
    inner = f"case when {f} = 0 then a.v when {f} = 1 then b.v else a.v + {f} * (b.v - a.v) end"
    return {"linear_no_extra": f"case when {f} between 0 and 1 then {inner} end", "linear_weak_extra": f"case when {f} between -1 and 2 then {inner} end", "nearest": "case when abs(target - a.p) <= abs(b.p - target) then a.v else b.v end"}.get(method, inner)


def _vertical(method):
    scale = {"log": "ln({})", "loglog": "ln(ln({} + exp(1)))"}.get(method, "{}")
    f = f"(({scale.format('target')} - {scale.format('a.p')}) / ({scale.format('b.p')} - {scale.format('a.p')}))"
    if method == "linear_const_extra":
        f = f"greatest(0, least(1, {f}))"
    levels = ", ".join(f"({x}::double)" for x in _LEVELS)
    sql = f"""with {COL}, levels(target) as (values {levels}), ranked as (select t, z, p, v, row_number() over (partition by t order by p) as n, count(*) over (partition by t) as of from col_grid),
    low as (select t, target, greatest(1, least(of - 1, count(*) filter (where p <= target))) as n from ranked, levels group by t, target, of)
    select t, target, round(case when a.p = target then a.v when b.p = target then b.v else {_between_sql(method, f)} end, 4) as v from low join ranked a using (t, n) join ranked b on b.t = low.t and b.n = low.n + 1"""

    def run(spark, d):
        targets = values(spark, [(x,) for x in _LEVELS], "target double")
        return rounded(vertical.interpolate(col_grid(spark, d), F.col("p"), ["v"], targets, "target", ["t"], method))

    QUERIES[f"vint_{method}"] = Query(run, sql)


for _m in vertical.METHODS:
    _vertical(_m)


@query(f"with {COL}, m as (select t, (900.0 - (t % 5) * 37)::double as target from (select distinct t from col_grid)), r as (select c.*, target from col_grid c join m using (t)), l as (select t, target, max(p) filter (where p <= target) as pa, min(p) filter (where p > target) as pb from r group by all) select l.t, round(target, 4) as target, round(a.v + (target - pa) / (pb - pa) * (b.v - a.v), 4) as v from l join col_grid a on a.t = l.t and a.p = pa join col_grid b on b.t = l.t and b.p = pb")
def vint_to_axis(spark, d):
    g = col_grid(spark, d)
    targets = g.select("t").distinct().withColumn("target", 900.0 - (F.col("t") % 5) * 37)
    return rounded(vertical.interpolate(g, F.col("p"), ["v"], targets, "target", ["t"], on=["t"]))


@query(f"with {COL} select t, z, round(case when p >= 400 and p <= 900 then v end, 4) as v from col_grid")
def vint_validity_range(spark, d):
    return rounded(col_grid(spark, d).select("t", "z", vertical.within_validity(F.col("v"), F.col("p"), F.lit(400.0), F.lit(900.0)).alias("v")))


# --------------------------------------------------------------------------- vertical coordinates and physics


def _physics(name, column: Callable[[], Column], sql: str):
    def run(spark, d):
        return rounded(col_grid(spark, d).select("t", "z", column().alias("v")))

    QUERIES[name] = Query(run, f"with {COL} select t, z, round({sql}, 4) as v from col_grid")


_Z, _P, _V = (lambda: F.col("z").cast("double")), (lambda: F.col("p")), (lambda: F.col("v"))
_PS, _PS_SQL = (lambda: 1000.0 + F.col("t") % 7), "(1000.0 + t % 7)"
_TK, _TK_SQL = (lambda: 290.0 - F.col("z") * 6.5), "(290.0 - z * 6.5)"
_RG = f"{fc.R_DRY / fc.G!r}"
_physics("vtrans_ln_p", lambda: fc.ln_pressure(F.lit(1000.0), _Z()), "1000.0 * exp(-z)")
_physics("vtrans_sigma", lambda: fc.sigma_pressure(F.lit(10.0), 1.0 - _Z() / 10, _PS()), f"10 + (1.0 - z / 10.0) * ({_PS_SQL} - 10)")
_physics("vtrans_sigma_inverse", lambda: fc.pressure_sigma(F.lit(10.0), _P(), _PS()), f"(p - 10) / ({_PS_SQL} - 10)")
_physics("vtrans_hybrid_ap", lambda: fc.hybrid_pressure(_Z() * 11, 1.0 - _Z() / 8, _PS()), f"z * 11.0 + (1.0 - z / 8.0) * {_PS_SQL}")
_physics("vtrans_hybrid_a", lambda: fc.hybrid_pressure_p0(_Z() / 90, F.lit(1000.0), 1.0 - _Z() / 8, _PS()), f"z / 90.0 * 1000.0 + (1.0 - z / 8.0) * {_PS_SQL}")
_physics("vtrans_hybrid_height", lambda: fc.hybrid_height(_Z() * 100, 1.0 - _Z() / 8, _V() / 100), "z * 100.0 + (1.0 - z / 8.0) * (v / 100)")
_physics("vtrans_ocean_g1", lambda: fc.ocean_s_g1(-_Z() / 8, -_Z() * _Z() / 64, _V() / 100, F.lit(5.0), F.lit(0.5)), "-((5 * (-z / 8.0) + (v / 100 - 5) * (-z * z / 64.0)) + 0.5 * (1 + (5 * (-z / 8.0) + (v / 100 - 5) * (-z * z / 64.0)) / (v / 100)))")
_physics("vtrans_ocean_g2", lambda: fc.ocean_s_g2(-_Z() / 8, -_Z() * _Z() / 64, _V() / 100, F.lit(5.0), F.lit(0.5)), "-(0.5 + (0.5 + v / 100) * ((5 * (-z / 8.0) + v / 100 * (-z * z / 64.0)) / (v / 100 + 5)))")
_physics("std_altitude", lambda: fc.standard_altitude(_P()), f"-ln(p / 1013.25) * {fc.R_DRY * 288.15 / fc.G!r}")
_physics("std_pressure", lambda: fc.standard_pressure(_Z() * 1000), f"exp(-z * 1000.0 * {fc.G / (fc.R_DRY * 288.15)!r}) * 1013.25")
_physics("theta_to_t", lambda: fc.theta_to_temperature(_TK(), _P()), f"{_TK_SQL} * power(p / 1000, {fc.R_DRY / fc.CP!r})")
_ES = "(610.78 * exp(17.269 * ({t} - 273.16) / ({t} - 35.86)))"
_DEW = "17.625 * ({t} - 273.15) / (243.04 + ({t} - 273.15))"
_physics("specific_to_relative", lambda: fc.specific_to_relative(_Z() * 0.001, _TK(), _P() * 100), f"greatest(0, least(100, 100 * z * 0.001 * p * 100 / ({_ES.format(t=_TK_SQL)} * 0.622)))")
_physics("relative_to_specific", lambda: fc.relative_to_specific(_Z() * 10, _TK(), _P() * 100) * 1000, f"z * 10.0 * 0.01 * {_ES.format(t=_TK_SQL)} * 0.622 / (p * 100) * 1000")
_physics("dewpoint_to_relative", lambda: fc.dewpoint_to_relative(_TK() - _Z(), _TK()), f"least(100, 100 * exp({_DEW.format(t=f'({_TK_SQL} - z)')} - {_DEW.format(t=_TK_SQL)}))")
_physics("omega_to_w", lambda: fc.omega_to_w(_Z() - 3.5, _P() * 100, _TK()), f"-(z - 3.5::double) * {_TK_SQL} * {_RG} / (p * 100)")


@query(f"with {COL} select t, z, round(z * 11.0 + (1.0 - z / 8.0) * {_PS_SQL}, 4) as v from col_grid")
def add_pressure_4d(spark, d):
    g = col_grid(spark, d).withColumns({"ap": _Z() * 1100, "b": 1.0 - _Z() / 8, "surface_air_pressure": _PS() * 100})
    return rounded(derive.convert_by(g, "add4Dpressure;unit=Pa").select("t", "z", F.col("air_pressure4D").alias("v")))


@query(f"with {COL} select t, z, round(z * 10.0 + v / {fc.G}, 4) as v from col_grid")
def height_to_altitude(spark, d):
    g = col_grid(spark, d).withColumns({"height": _Z() * 10, "surface_geopotential": F.col("v")})
    return rounded(derive.altitude_from_height(g).select("t", "z", F.col("altitude").alias("v")))


@query(f"with {COL}, g as (select t, z, p, {_TK_SQL} as tv, {_PS_SQL} + 10 as ps, coalesce(lag(p) over (partition by t order by p desc), {_PS_SQL} + 10) as below from col_grid) select t, z, round(12.5 + sum(ln(below / p) * tv * {_RG}) over (partition by t order by p desc), 3) as altitude from g")
def hypsometric_altitude(spark, d):
    g = col_grid(spark, d).withColumns({"tv": _TK(), "ps": _PS() + 10, "zs": F.lit(12.5)})
    return process.hypsometric_altitude(g, "z", "p", "tv", "zs", "ps", ["t"]).select("t", "z", F.round("altitude", 3).alias("altitude"))


# --------------------------------------------------------------------------- horizontal interpolation

_AT = "spots as (select id, (id * 7 % 190) / 10.0 - 0.3 as px, (id * 13 % 200) / 10.0 - 0.2 as py from points)"


def _at(spark, d):
    i = F.col("id")
    return points(spark, d).select("id", (i * 7 % 190 / 10.0 - 0.3).alias("px"), (i * 13 % 200 / 10.0 - 0.2).alias("py"))


@query(f"with {LONLAT}, {PART}, {_AT} select id, round(px, 4) as px, round(py, 4) as py, round(g.v, 4) as v from spots left join part_grid g on g.x = round(px) and g.y = round(py)")
def hint_nearest(spark, d):
    return rounded(horizontal.nearest(part_grid(spark, d), _at(spark, d), "v").select("id", "px", "py", "v"))


_BILINEAR = """sz as (select max(x) + 1 as nx, max(y) + 1 as ny from part_grid), c as (select id, px, py, floor(px) >= 0 and floor(px) + 1 < nx as inx, floor(py) >= 0 and floor(py) + 1 < ny as iny from {0}, sz),
n as (select id, case when inx then floor(px) + i else round(px) end as x, case when iny then floor(py) + j else round(py) end as y, (case when not inx then 1 when i = 0 then floor(px) + 1 - px else px - floor(px) end) * (case when not iny then 1 when j = 0 then floor(py) + 1 - py else py - floor(py) end) as w from c, (values (0), (1)) a(i), (values (0), (1)) b(j) where (inx or i = 0) and (iny or j = 0)),
s as (select id, case when count(v) = count(*) then sum(w * v) end as v from n left join part_grid g using (x, y) group by id)"""


@query(f"with {LONLAT}, {PART}, {_AT}, {_BILINEAR.format('spots')} select id, round(px, 4) as px, round(py, 4) as py, round(s.v, 4) as v from spots left join s using (id)")
def hint_bilinear(spark, d):
    return rounded(horizontal.bilinear(part_grid(spark, d), _at(spark, d), "v"))


_CUBIC = "case when abs({0}) <= 1 then (1.5 * abs({0}) - 2.5) * abs({0}) * abs({0}) + 1 when abs({0}) < 2 then ((-0.5 * abs({0}) + 2.5) * abs({0}) - 4) * abs({0}) + 2 else 0 end"


@query(f"with {LONLAT}, {PART}, {_AT}, o(i) as (values (-1), (0), (1), (2)), n as (select id, floor(px) + a.i as x, floor(py) + b.i as y, ({_CUBIC.format('(px - floor(px) - a.i)')}) * ({_CUBIC.format('(py - floor(py) - b.i)')}) as w from spots, o a, o b), s as (select id, sum(w * v) as s, count(v) as n from n left join part_grid g using (x, y) group by id) select id, round(px, 4) as px, round(py, 4) as py, round(case when n = 16 then s end, 4) as v from spots left join s using (id)")
def hint_bicubic(spark, d):
    return rounded(horizontal.bicubic(part_grid(spark, d), _at(spark, d), "v"))


@query(f"with {LONLAT} select id, round((lon + 180) / 7.5 + 0.5 - 48 * floor(((lon + 180) / 7.5 + 0.5) / 48) - 0.5, 4) as circular, round((lon - 5) / 2.5, 4) as straight from points")
def hint_positions(spark, d):
    p = points(spark, d)
    return rounded(p.select("id", horizontal.position(F.col("lon"), -180.0, 7.5, 360.0).alias("circular"), horizontal.position(F.col("lon"), 5.0, 2.5).alias("straight")))


@query(f"with {LONLAT} select id, round(case when lat < -30 then (lat + 60) / 30 when lat < 0 then 1 + (lat + 30) / 30 when lat < 10 then 2 + lat / 10 else 3 + (lat - 10) / 50 end, 4) as position from points")
def hint_positions_irregular(spark, d):
    return rounded(horizontal.positions_on(points(spark, d), "lat", [-60.0, -30.0, 0.0, 10.0, 60.0]).select("id", "position"))


def _forward(how, undefined):
    agg = {"sum": "sum(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)", "median": "list_sort(list(v) filter (where v is not null))[cast(floor(count(v) / 2) as bigint) + 1]"}[how]
    agg = f"case when count(v) = count(*) then {agg} end" if undefined else agg
    sql = f"with {LONLAT}, g as (select cast(round((lon + 180) / 20.0) as int) as ox, cast(round((lat + 70) / 16.0) as int) as oy, case when id % 11 = 0 then null else v end as v from points), a as (select ox, oy, {agg} as v from g where ox between 0 and 17 and oy between 0 and 7 group by ox, oy), c as (select cast(a.i as int) as ox, cast(b.i as int) as oy from range(18) a(i), range(8) b(i)) select ox, oy, round(v, 4) as v from c left join a using (ox, oy)"

    def run(spark, d):
        g = points(spark, d).select(((F.col("lon") + 180) / 20.0).alias("px"), ((F.col("lat") + 70) / 16.0).alias("py"), F.when(F.col("id") % 11 != 0, F.col("v")).alias("v"))
        return rounded(horizontal.forward(g, "v", "px", "py", 18, 8, how, undefined))

    QUERIES[f"hint_forward_{'undef_' * undefined}{how}"] = Query(run, sql)


for _how in horizontal.FORWARD:
    _forward(_how, False)
    _forward(_how, True)


@query("with s as (select s_suppkey as cell, ((s_suppkey * 53) % 360 - 180)::double as lon, ((s_suppkey * 29) % 160 - 80)::double as lat, s_acctbal as v from supplier), " + LONLAT + f", d as (select id, cell, s.v, {_GEO.format(a='p.lon', b='p.lat', c='s.lon', d='s.lat')} * 6371000 as d from points p, s), b as (select id, arg_min(v, row(round(d, 3), cell)) as v, min(d) as distance from d where d <= 900000 group by id) select id, round(b.v, 4) as v, round(distance, 0) as distance from (select id from points) left join b using (id)")
def hint_coord_nearest(spark, d):
    k = F.col("s_suppkey")
    source = table(spark, d, "supplier").select(k.alias("cell"), ((k * 53) % 360 - 180).cast("double").alias("lon"), ((k * 29) % 160 - 80).cast("double").alias("lat"), F.col("s_acctbal").alias("v"))
    at = points(spark, d).select("id", "lon", "lat")
    got = horizontal.coordinate_nearest(source, at, "v", 900000.0)
    return rounded(got.select("id", "v", F.round("distance", 0).alias("distance")))


# --------------------------------------------------------------------------- projections

_R = pr.RADIUS


def _projected(name, proj, x, y, back="true"):
    def run(spark, d):
        p = pr.parse(proj)
        px, py = (F.when(~F.isnan(c), c) for c in p.forward(F.col("lon"), F.col("lat")))  # null where it is undefined
        lon, lat = p.inverse(F.col("x"), F.col("y"))
        out = points(spark, d).select("id", "lon", "lat", px.alias("x"), py.alias("y"))
        near = F.abs(fc.longitude180(lon - F.col("lon") + 0.0)) * F.cos(F.radians("lat"))
        return out.select("id", F.round(F.col("x") / 1000 + 0.0, 3).alias("x"), F.round(F.col("y") / 1000 + 0.0, 3).alias("y"), ((near < 1e-5) & (F.abs(lat - F.col("lat")) < 1e-5) & F.col("x").isNotNull()).alias("back"))

    sql = f"with {LONLAT}, q as (select id, radians(lon) as l, radians(lat) as b, lon, lat from points) select id, round(({x}) / 1000 + 0.0, 3) as x, round(({y}) / 1000 + 0.0, 3) as y, {back} as back from q"
    QUERIES[f"proj_{name}"] = Query(run, sql)


_projected("merc", "+proj=merc +lat_ts=30 +a=6371000 +e=0", f"l * {_R} * cos(radians(30))", f"ln(tan(b / 2 + pi() / 4)) * {_R} * cos(radians(30))")
_projected("polar_stere", "+proj=stere +lat_0=90 +lon_0=0 +lat_ts=60 +a=6371000 +e=0", f"{_R} * (1 + sin(radians(60))) * tan(pi() / 4 - b / 2) * sin(l)", f"-{_R} * (1 + sin(radians(60))) * tan(pi() / 4 - b / 2) * cos(l)")
_projected("sinu", "+proj=sinu +a=6371000 +e=0", f"l * cos(b) * {_R}", f"b * {_R}")
_projected("cea", "+proj=cea +lat_ts=40 +a=6371000 +e=0", f"l * cos(radians(40)) * {_R}", f"sin(b) / cos(radians(40)) * {_R}")
_OPPOSITE = "(lon = -180 and lat = -50)"  # of the centre: undefined
_K = f"(case when {_OPPOSITE} then null else sqrt(2 / (1 + sin(radians(50)) * sin(b) + cos(radians(50)) * cos(b) * cos(l))) end)"
_projected("laea", "+proj=laea +lat_0=50 +lon_0=0 +a=6371000 +e=0", f"{_R} * {_K} * cos(b) * sin(l)", f"{_R} * {_K} * (cos(radians(50)) * sin(b) - sin(radians(50)) * cos(b) * cos(l))", f"not {_OPPOSITE}")
_N = "sin(radians(60))"
_F = f"(cos(radians(60)) * power(tan(pi() / 4 + radians(30)), {_N}) / {_N} * {_R})"
_projected("lcc", "+proj=lcc +lat_0=60 +lon_0=0 +lat_1=60 +lat_2=60 +a=6371000 +e=0", f"{_F} * power(tan(pi() / 4 + b / 2), -{_N}) * sin({_N} * l)", f"{_F} * power(tan(pi() / 4 + radians(30)), -{_N}) - {_F} * power(tan(pi() / 4 + b / 2), -{_N}) * cos({_N} * l)")
_projected("tmerc", "+proj=tmerc +lon_0=0 +lat_0=0 +k=0.9996 +a=6371000 +e=0", f"atanh(cos(b) * sin(l)) * {_R} * 0.9996", f"atan2(tan(b), cos(l)) * {_R} * 0.9996")


@query(f"with {LONLAT}, q as (select id, radians(lon - 10) as l, radians(lat) as b from points) select id, round(degrees(atan2(cos(b) * sin(l), sin(radians(30)) * cos(b) * cos(l) + cos(radians(30)) * sin(b))) + 0.0, 3) as x, round(degrees(asin(sin(radians(30)) * sin(b) - cos(radians(30)) * cos(b) * cos(l))) + 0.0, 3) as y from q where abs(abs(degrees(atan2(cos(b) * sin(l), sin(radians(30)) * cos(b) * cos(l) + cos(radians(30)) * sin(b)))) - 180) > 1e-6")
def proj_rotated_pole(spark, d):
    p = pr.parse("+proj=ob_tran +o_proj=latlong +lon_0=10 +o_lat_p=30 +a=6371000 +e=0")
    x, y = p.forward(F.col("lon"), F.col("lat"))
    return points(spark, d).select("id", F.round(x + 0.0, 3).alias("x"), F.round(y + 0.0, 3).alias("y")).where(F.abs(F.abs(x) - 180) > 1e-6)


@query()
def proj_roundtrip_all(spark, d):
    """Every supported projection: how many points come back to where they were."""
    a = "+a=6371000 +e=0"
    defs = [f"+proj=latlong {a}", f"+proj=ob_tran +o_proj=latlong +lon_0=-40 +o_lat_p=22 {a}", f"+proj=stere +lat_0=90 +lon_0=-32 +lat_ts=60 {a}", f"+proj=stere +lat_0=40 +lon_0=10 {a}", f"+proj=merc +lon_0=5 {a}", f"+proj=lcc +lat_0=63 +lon_0=15 +lat_1=30 +lat_2=60 {a}", f"+proj=laea +lat_0=52 +lon_0=10 {a}", f"+proj=cea +lat_ts=30 {a}", f"+proj=sinu +lon_0=20 {a}", f"+proj=ortho +lat_0=40 +lon_0=10 {a}", f"+proj=aeqd +lat_0=40 +lon_0=10 {a}", f"+proj=aea +lat_0=40 +lon_0=10 +lat_1=43 +lat_2=62 {a}", f"+proj=utm +zone=33 {a}", f"+proj=omerc +lonc=5 +lat_0=30 +alpha=40 +gamma=40 {a}", f"+proj=geos +lon_0=0 +h=35785831 {a}", f"+proj=nsper +lat_0=20 +lon_0=5 +h=3000000 {a}"]
    p, out = points(spark, d), None
    for text in defs:
        q = pr.parse(text)
        x, y = q.forward(F.col("lon"), F.col("lat"))
        rows = p.select("lon", "lat", x.alias("x"), y.alias("y")).where(~F.isnan("x") & ~F.isnan("y"))
        lon, lat = q.inverse(F.col("x"), F.col("y"))
        off = fc.central_angle(F.col("lon"), F.col("lat"), lon, lat)
        one = rows.agg(F.lit(text).alias("projection"), F.count("x").alias("points"), F.count_if(off < 1e-6).alias("back"))
        out = one if out is None else out.union(one)
    return out


@query(f"with {LONLAT}, c as (select unnest({[[float(a), float(b)] for a, b in horizontal.cross_section([(2.0, 3.0), (12.0, 5.0), (15.0, 17.0)], 1.0, 1.0)]}::double[][]) as c), {PART} select round(c[1], 4) as px, round(c[2], 4) as py, round(g.v, 4) as v from c left join part_grid g on g.x = round(c[1]) and g.y = round(c[2])")
def vcross_points(spark, d):
    line = horizontal.cross_section([(2.0, 3.0), (12.0, 5.0), (15.0, 17.0)], 1.0, 1.0)
    at = values(spark, line, "px double, py double")
    return rounded(horizontal.nearest(part_grid(spark, d), at, "v").select("px", "py", "v"))


# --------------------------------------------------------------------------- statistics, and fields as a whole


@query(f"with {PART} select cast(count(*) as bigint) as cells, cast(count(*) * (4 + 4 + 8) as bigint) as bytes from part_grid")
def dataset_size(spark, d):
    return part_grid(spark, d).agg(F.count("*").alias("cells"), (F.count("*") * stats.dataset_bytes({"n": 1}, {"x": ("int", ["n"]), "y": ("int", ["n"]), "v": ("double", ["n"])})).alias("bytes"))


@query(f"with {COL} select t, count(v) as n_def, count(*) - count(v) as n_undef, round(sum(v), 4) as total, round(avg(v), 4) as mean, round(list_sort(list(v))[cast(floor(count(v) / 2) as bigint) + 1], 4) as median, round(min(v), 4) as least, round(max(v), 4) as largest, round(stddev_samp(v), 4) as stddev from col_grid group by t")
def field_stats(spark, d):
    return rounded(stats.field_stats(col_grid(spark, d), "v", ["t"]))


def _holes(spark, d):
    g = uv_grid(spark, d)
    return g.select("t", "x", "y", F.when((F.col("x") * 7 + F.col("y") * 3) % 5 != 0, F.col("u")).alias("u"))


@query()
def fill2d(spark, d):
    return slabs.by_field(_holes(spark, d), "u", slabs.fill, ["t"])


@query()
def creepfill2d(spark, d):
    return slabs.by_field(_holes(spark, d), "u", slabs.creep, ["t"])


@query()
def creepfillval2d(spark, d):
    return slabs.by_field(_holes(spark, d), "u", lambda f: slabs.creep(f, default=0.0), ["t"])


@query("select '10,20,...,35' as spec, unnest([10.0, 20.0, 30.0, 35.0])::double as v")
def dotted_list(spark, d):
    return values(spark, [("10,20,...,35", float(v)) for v in dotted("10,20,...,35")], "spec string, v double")


# --------------------------------------------------------------------------- derived variables and datasets


@query(f"with {COL}, ab as (select distinct z, z * 11.0::double as ap, 1.0 - z / 8.0 as b from col_grid), ps as (select t, 1000.0 + t % 7 as ps from (select distinct t from col_grid)) select t, z, round(ap + b * ps, 4) as p from col_grid join ab using (z) join ps using (t)")
def vtrans_formula_terms(spark, d):
    g = col_grid(spark, d).select("t", "z")
    ab = g.select("z").distinct().select("z", (F.col("z") * 11.0).alias("hyam"), (1.0 - F.col("z") / 8.0).alias("hybm"))
    ps = g.select("t").distinct().select("t", (F.col("t") % 7 + 1000.0).alias("sp"))
    both = derive.broadcast_terms(g, (ab, ["z"]), (ps, ["t"]))
    return rounded(both.select("t", "z", derive.coordinate("atmosphere_hybrid_sigma_pressure_coordinate", "ap: hyam b: hybm ps: sp").alias("p")))


@query(f"with {COL}, k as (select t, z, p, {_TK_SQL} * power(p / 1000, {fc.R_DRY / fc.CP!r}) as tk from col_grid) select t, z, round(tk, 4) as air_temperature, round(greatest(0, least(100, 100 * z * 0.0001 * p * 100 / ({_ES.format(t='tk')} * 0.622))), 4) as relative_humidity, round(-(z - 3.5::double) * tk * {_RG} / (p * 100), 4) as w from k")
def pressure_conversions(spark, d):
    g = col_grid(spark, d).withColumns({"air_potential_temperature": _TK(), "air_pressure": F.col("p"), "specific_humidity": F.col("z") * 0.0001, "omega": F.col("z") - 3.5})
    out = derive.convert_by(g, "theta2T", "specific2relative", "omega2vwind;omega=omega;out=w")
    return rounded(out.select("t", "z", "air_temperature", "relative_humidity", "w"))


@query(f"with {COL} select t, z, round(-ln(p / 1013.25) * {fc.R_DRY * 288.15 / fc.G!r}, 3) as altitude from col_grid")
def altitude_standard(spark, d):
    return derive.altitude(col_grid(spark, d).withColumn("air_pressure", F.col("p")), ["t"]).select("t", "z", F.round("altitude", 3).alias("altitude"))


@query(f"with {PART}, q as (select a.i + 12 * b.i as id, 1.5 + a.i * 1.25 as px, 2.25 + b.i * 1.5 as py from range(12) a(i), range(10) b(i)), {_BILINEAR.format('q')} select cast(id // 12 as int) as y, cast(id % 12 as int) as x, round(v, 4) as v from s")
def dataset_to_grid(spark, d):
    from .plans.dataset import GridDataset

    g = GridDataset(part_grid(spark, d), ("y", "x"), t=None)
    out = g.to_grid("v", [1.5 + 1.25 * i for i in range(12)], [2.25 + 1.5 * j for j in range(10)], (0.0, 1.0, 0.0, 1.0))
    return rounded(out.df)


_SPOTS = "slices as (select distinct t from uv_grid), spots as (select cast(b.i as int) as y, cast(a.i as int) as x, cast(round(0.2 + 0.8 * a.i) as int) as sx, cast(round(0.3 + 0.9 * b.i) as int) as sy from range(20) a(i), range(23) b(i))"


@query(f"with {UV}, {_SPOTS} select slices.t, spots.y, spots.x, round(f.u, 4) as u, round(f.v, 4) as v from slices cross join spots left join uv_grid f on f.t = slices.t and f.x = spots.sx and f.y = spots.sy")
def dataset_fields_to_grid(spark, d):
    from .plans.dataset import GridDataset

    g = GridDataset(uv_grid(spark, d), ("t", "y", "x"))
    return rounded(g.to_grid(["u", "v"], [0.2 + 0.8 * i for i in range(20)], [0.3 + 0.9 * j for j in range(23)], (0.0, 1.0, 0.0, 1.0), method="nearest").df)


@query(f"with {EVENTS}, a as (select t, x, sum(v) over (partition by x order by t) as v from events_grid) select t, x - 2 as x, round(v, 4) as v from a where x between 2 and 8")
def config_run(spark, d):
    from .plans.config import run_config
    from .plans.dataset import GridDataset

    g = GridDataset(events_grid(spark, d), ("t", "x"))
    return rounded(run_config(g, "[extract]\nreduceDimension.name=x\nreduceDimension.start=2\nreduceDimension.end=8\n[process]\naccumulateVariable=v\n").df)


@query("select unnest(['t2m', 'rh']) as var")
def find_variables(spark, d):
    rows = [("t2m", "standard_name", "air_temperature"), ("t2m", "units", "K"), ("rh", "standard_name", "air_humidity"), ("rh", "units", "1"), ("ps", "standard_name", "surface_pressure"), ("ps", "units", "Pa"), ("x", "standard_name", "air_x")]
    return extract.find_variables(values(spark, rows, "var string, name string, value string"), {"standard_name": "air_.*", "units": ".*"})


@query(f"with {UV}, g as (select *, atan2(x * 50000.0 + 200000, y * 50000.0 + 100000) as l from uv_grid) select t, x, y, round(u * cos(l) + v * sin(l) + 0.0, 3) as u, round(v * cos(l) - u * sin(l) + 0.0, 3) as v, 0.0::double as change from g")
def vector_to_latlon(spark, d):
    """Winds on a polar grid turned to east and north; their speed stays."""
    p = pr.parse("+proj=stere +lat_0=90 +lon_0=0 +lat_ts=60 +a=6371000 +e=0")
    g = uv_grid(spark, d).withColumns({"px": F.col("x") * 50000.0 + 200000.0, "py": F.col("y") * -50000.0 - 100000.0})
    lon, lat = p.inverse(F.col("px"), F.col("py"))
    g = g.withColumns({"lon": lon, "lat": lat, "before": F.hypot("u", "v")})
    out = process.rotate_all(g, {"u": "x_wind", "v": "y_wind"}, pr.north_angle(p, F.col("lon"), F.col("lat")))
    return out.select("t", "x", "y", *(F.round(F.col(c) + 0.0, 3).alias(c) for c in ("u", "v")), (F.round(F.hypot("u", "v") - F.col("before"), 3) + 0.0).alias("change"))


def hybrid(levels: int) -> tuple[list[float], list[float]]:
    """Coefficients of levels between half levels that go from no pressure to the surface's."""
    half = [(20000.0 * (k / levels) * (1 - k / levels), (k / levels) ** 2) for k in range(levels + 1)]
    return tuple([(p[i] + q[i]) / 2 for p, q in zip(half, half[1:], strict=False)] for i in (0, 1))


@query()
def vertical_velocity(spark, d):
    """Seven levels above each year's field of winds."""
    levels = values(spark, [(k, a, b) for k, (a, b) in enumerate(zip(*hybrid(7), strict=True))], "z int, ap double, b double")
    g = uv_grid(spark, d).join(F.broadcast(levels))
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    g = g.select("t", "z", "y", "x", (F.col("u") * (z + 1) * 100).alias("x_wind"), (F.col("v") * (z + 1) * 100).alias("y_wind"), (220.0 + z * 10).alias("air_temperature"), "ap", "b", (101000.0 - x * 20).alias("surface_air_pressure"), (y * 15.0).alias("surface_altitude"), (x * 0.5).alias("lon"), (60.0 + y * 0.25).alias("lat"))
    return rounded(derive.add_vertical_velocity(g, step=(25000.0, 25000.0), lon="lon", lat="lat"))
