"""Derived variables: conversions asked for by name, vertical coordinates from formula terms, and vertical velocity."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as fc
from ..functions.sizes import small
from ..functions.units import convert
from . import process, slabs, vertical

# --------------------------------------------------------------------------- conversions

Conversion = Callable[[DataFrame, dict[str, str]], DataFrame]


def _theta(df: DataFrame, o: dict[str, str]) -> DataFrame:
    """temperature from potential temperature"""
    return df.withColumn(o.get("out", "air_temperature"), fc.theta_to_temperature(F.col(o.get("theta", "air_potential_temperature")), F.col(o.get("pressure", "air_pressure"))))


def _humidity(df: DataFrame, o: dict[str, str]) -> DataFrame:
    """relative humidity in percent from specific humidity; pressure in hPa; with theta, temperature is derived first"""
    t = F.col(o.get("temperature", "air_temperature"))
    p = F.col(o.get("pressure", "air_pressure"))
    if "theta" in o:
        t = fc.theta_to_temperature(F.col(o["theta"]), p)
    return df.withColumn(o.get("out", "relative_humidity"), fc.specific_to_relative(F.col(o.get("specific", "specific_humidity")), t, p * 100.0))


def _omega(df: DataFrame, o: dict[str, str]) -> DataFrame:
    """upward wind from the change of pressure; pressure in hPa"""
    p = F.col(o.get("pressure", "air_pressure"))
    return df.withColumn(o.get("out", "upward_air_velocity"), fc.omega_to_w(F.col(o.get("omega", "lagrangian_tendency_of_air_pressure")), p * 100.0, F.col(o.get("temperature", "air_temperature"))))


def _pressure(df: DataFrame, o: dict[str, str]) -> DataFrame:
    """pressure of every cell, in hPa, from hybrid coefficients and the surface pressure"""
    p = fc.hybrid_pressure(F.col(o.get("ap", "ap")), F.col(o.get("b", "b")), F.col(o.get("ps", "surface_air_pressure")))
    return df.withColumn(o.get("out", "air_pressure4D"), convert(p, o.get("unit", "hPa"), "hPa"))


CONVERSIONS: dict[str, Conversion] = {"theta2T": _theta, "specific2relative": _humidity, "omega2vwind": _omega, "add4Dpressure": _pressure}


def convert_by(df: DataFrame, *operations: str) -> DataFrame:
    """Applies operations like ``name;key=value;key=value`` in turn."""
    for text in operations:
        name, *rest = [p.strip() for p in text.split(";")]
        if name not in CONVERSIONS:
            raise ValueError(f"unknown conversion {name!r}")
        options = dict(p.split("=", 1) for p in rest if p)
        df = CONVERSIONS[name](df, {k.strip(): v.strip() for k, v in options.items()})
    return df


# --------------------------------------------------------------------------- vertical coordinates

FORMULAS: dict[str, Callable[[dict[str, Column]], Column]] = {
    "atmosphere_ln_pressure_coordinate": lambda c: fc.ln_pressure(c["p0"], c["lev"]),
    "atmosphere_sigma_coordinate": lambda c: fc.sigma_pressure(c["ptop"], c["sigma"], c["ps"]),
    "atmosphere_hybrid_sigma_pressure_coordinate": lambda c: fc.hybrid_pressure(c["ap"], c["b"], c["ps"]) if "ap" in c else fc.hybrid_pressure_p0(c["a"], c["p0"], c["b"], c["ps"]),
    "atmosphere_hybrid_height_coordinate": lambda c: fc.hybrid_height(c["a"], c["b"], c["orog"]),
    "ocean_s_coordinate_g1": lambda c: fc.ocean_s_g1(c["s"], c["C"], c["depth"], c["depth_c"], c["eta"]),
    "ocean_s_coordinate_g2": lambda c: fc.ocean_s_g2(c["s"], c["C"], c["depth"], c["depth_c"], c["eta"]),
}
#: What each formula gives, and between which terms it holds.
GIVES = {k: "depth" if k.startswith("ocean") else "altitude" if "height" in k else "pressure" for k in FORMULAS}


def terms_of(text: str) -> dict[str, str]:
    """``ap: hyam b: hybm ps: sp`` -> names by term."""
    words = text.split()
    return {w.rstrip(":"): v for w, v in zip(words[::2], words[1::2], strict=True)}


def coordinate(standard_name: str, formula_terms: str) -> Column:
    """The vertical coordinate of every cell of a frame that has the terms as columns (joined on the dimensions that they have)."""
    if standard_name not in FORMULAS:
        raise ValueError(f"no transformation for {standard_name!r}")
    names = terms_of(formula_terms)
    columns = {k: F.col(v) for k, v in names.items()}
    return FORMULAS[standard_name](columns)


def broadcast_terms(df: DataFrame, *terms: tuple[DataFrame, list[str]]) -> DataFrame:
    """Joins variables of fewer dimensions, each on those that it has."""
    for other, dims in terms:
        df = df.join(other, dims, "left") if dims else df.join(small(other))
    return df


def altitude(df: DataFrame, cell: Iterable[str], pressure: str = "air_pressure") -> DataFrame:
    """``altitude`` from what is there: geopotential height, else layers integrated from the surface, else a standard atmosphere."""
    have = set(df.columns)
    if "geopotential_height" in have:
        return df.withColumn("altitude", F.col("geopotential_height"))
    if {"air_temperature", "surface_air_pressure", "surface_altitude"} <= have:
        virtual = fc.virtual_temperature(F.col("specific_humidity"), F.col("air_temperature")) if "specific_humidity" in have else F.col("air_temperature")
        out = process.hypsometric_altitude(df.withColumn("_tv", virtual), "z", pressure, "_tv", "surface_altitude", "surface_air_pressure", cell)
        return out.drop("_tv")
    return df.withColumn("altitude", fc.standard_altitude(F.col(pressure)))


def altitude_from_height(df: DataFrame) -> DataFrame:
    """``altitude`` from ``height`` above a surface whose altitude or geopotential is there."""
    ground = F.col("surface_altitude") if "surface_altitude" in df.columns else F.col("surface_geopotential") / fc.G
    return df.withColumn("altitude", F.col("height") + ground)


def height_from_altitude(df: DataFrame) -> DataFrame:
    return df.withColumn("height", F.col("altitude") - F.col("surface_altitude"))


def to_template(df: DataFrame, z: Column, values: Iterable[str], template: DataFrame, target: str, cell: Iterable[str], method: str = "linear") -> DataFrame:
    """Values at the coordinates that a template variable has in each cell: ``template(cell, level, target)``."""
    return vertical.interpolate(df, z, values, template, target, cell, method, on=cell)


# --------------------------------------------------------------------------- vertical velocity


def add_vertical_velocity(
    df: DataFrame, t: str = "t", z: str = "z", y: str = "y", x: str = "x", u: str = "x_wind", v: str = "y_wind", temperature: str = "air_temperature", ap: str = "ap", b: str = "b",
    ps: str = "surface_air_pressure", zs: str = "surface_altitude", step: tuple[float, float] = (1000.0, 1000.0), lon: str | None = None, lat: str | None = None,
) -> DataFrame:
    """``upward_air_velocity`` of each cell, from a time's whole field (the unit of work) on hybrid levels, the top first.

    Coefficients ``ap`` and surface pressure in Pa; ``step`` is the grid's on the map, in metres. With ``lon`` and ``lat`` distances on the ground
    are those between neighbours, else the steps.
    """
    schema = T.StructType([*(df.schema[c] for c in (t, z, y, x)), T.StructField("upward_air_velocity", T.DoubleType())])
    given = [c for c in (lon, lat) if c]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = tuple(pdf[c].to_numpy() for c in (z, y, x))
        shape = tuple(a.max() + 1 for a in at)

        def dense(name: str) -> np.ndarray:
            out = np.full(shape, np.nan)
            out[at] = pdf[name].to_numpy(float, na_value=np.nan)
            return out

        level = lambda name: np.nanmax(dense(name), axis=(1, 2))
        ground = lambda name: np.nanmax(dense(name), axis=0)
        distances = slabs.distances(ground(lon), ground(lat)) if len(given) == 2 else [np.full(shape[1:], s) for s in step]
        w = slabs.vertical_velocity(dense(u), dense(v), dense(temperature), level(ap), level(b), ground(ps), ground(zs), step, *distances)
        out = pdf[[t, z, y, x]].copy()
        got = w[at]
        out["upward_air_velocity"] = pd.Series(got, index=out.index, dtype="Float64").mask(np.isnan(got))
        return out

    return df.select(t, z, y, x, u, v, temperature, ap, b, ps, zs, *given).groupBy(t).applyInPandas(run, schema)
