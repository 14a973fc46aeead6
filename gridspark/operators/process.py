"""Operators along the unlimited dimension and on vectors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance, rotate, turn_direction


def accumulate(df: DataFrame, value: str, t: str, cell: Iterable[str]) -> DataFrame:
    """Running sums along ``t`` per cell. A missing value counts as 0 in the first step only; later ones make the rest missing."""
    w = Window.partitionBy(*cell).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(*cell).orderBy(t)) == 1
    out = df.withColumn("_first", first)
    v = F.col(value)
    broken = F.sum(F.when(v.isNull() & ~F.col("_first"), 1).otherwise(0)).over(w)
    return out.withColumn(value, F.when(broken == 0, F.when(F.col("_first"), v).otherwise(F.sum(F.coalesce(v, F.lit(0.0))).over(w)))).drop("_first")


def deaccumulate(df: DataFrame, value: str, t: str, cell: Iterable[str]) -> DataFrame:
    """Differences along ``t`` per cell; the first value stays, and counts as 0 for the second if it is missing."""
    w = Window.partitionBy(*cell).orderBy(t)
    v, n = F.col(value), F.row_number().over(w)
    before = F.lag(v).over(w)
    return df.withColumn(value, F.when(n == 1, v).when(n == 2, v - F.coalesce(before, F.lit(0.0))).otherwise(v - before))


def rotate_vectors(df: DataFrame, u: str, v: str, angle: Column | str) -> DataFrame:
    """Both components turned by an angle in radians, a column here or one joined beforehand."""
    a = F.col(angle) if isinstance(angle, str) else angle
    x, y = rotate(F.col(u), F.col(v), a)
    return df.withColumns({u: x, v: y})


def rotate_direction(df: DataFrame, name: str, angle: Column | str) -> DataFrame:
    return df.withColumn(name, turn_direction(F.col(name), F.col(angle) if isinstance(angle, str) else angle))


# Standard names of vectors' components along x on the map; those along y have "y" or "northward" instead.
MAP_VECTORS = """
x_wind
grid_eastward_wind
sea_water_x_velocity
x_sea_water_velocity
barotropic_sea_water_x_velocity
bolus_sea_water_x_velocity
surface_geostrophic_sea_water_x_velocity
sea_ice_x_velocity
sea_ice_x_transport
sea_ice_x_displacement
sea_surface_wave_stokes_drift_x_velocity
land_ice_x_velocity
land_ice_basal_x_velocity
land_ice_vertical_mean_x_velocity
ocean_heat_x_transport
ocean_salt_x_transport
ocean_volume_x_transport
""".split()
# Standard names of vectors' components to the east; those to the north have "northward" instead.
EARTH_VECTORS = """
atmosphere_eastward_stress_due_to_gravity_wave_drag
baroclinic_eastward_sea_water_velocity
barotropic_eastward_sea_water_velocity
bolus_eastward_sea_water_velocity
downward_eastward_momentum_flux_in_air
downward_eastward_momentum_flux_in_air_due_to_diffusion
downward_eastward_stress_at_sea_ice_base
eastward_atmosphere_dry_static_energy_transport_across_unit_distance
eastward_atmosphere_water_transport_across_unit_distance
eastward_atmosphere_water_vapor_transport_across_unit_distance
eastward_derivative_of_northward_sea_ice_velocity
eastward_mass_flux_of_air
eastward_momentum_flux_correction
eastward_sea_ice_displacement
eastward_sea_ice_velocity
eastward_sea_water_velocity
eastward_sea_water_velocity_assuming_no_tide
eastward_transformed_eulerian_mean_air_velocity
eastward_transformed_eulerian_mean_velocity
eastward_water_vapor_flux_in_air
eastward_water_vapor_flux
eastward_water_vapor_transport_across_unit_distance_in_atmosphere_layer
eastward_wind
eastward_wind_shear
geostrophic_eastward_wind
product_of_eastward_sea_water_velocity_and_salinity
product_of_eastward_sea_water_velocity_and_temperature
product_of_eastward_wind_and_air_temperature
product_of_eastward_wind_and_geopotential_height
product_of_eastward_wind_and_omega
product_of_eastward_wind_and_specific_humidity
product_of_eastward_wind_and_upward_air_velocity
surface_downward_eastward_stress
surface_eastward_sea_water_velocity
surface_geostrophic_eastward_sea_water_velocity
surface_eastward_geostrophic_sea_water_velocity
surface_geostrophic_eastward_sea_water_velocity_assuming_sea_level_for_geoid
surface_eastward_geostrophic_sea_water_velocity_assuming_sea_level_for_geoid
tendency_of_eastward_wind
tendency_of_eastward_wind_due_to_advection
tendency_of_eastward_wind_due_to_convection
tendency_of_eastward_wind_due_to_diffusion
tendency_of_eastward_wind_due_to_eliassen_palm_flux_divergence
tendency_of_eastward_wind_due_to_gravity_wave_drag
tendency_of_eastward_wind_due_to_nonorographic_gravity_wave_drag
tendency_of_eastward_wind_due_to_numerical_artefacts
tendency_of_eastward_wind_due_to_orographic_gravity_wave_drag
upward_eastward_momentum_flux_in_air_due_to_nonorographic_eastward_gravity_waves
upward_flux_of_eastward_momentum_due_to_nonorographic_eastward_gravity_waves
upward_eastward_momentum_flux_in_air_due_to_nonorographic_westward_gravity_waves
upward_flux_of_eastward_momentum_due_to_nonorographic_westward_gravity_waves
upward_eastward_momentum_flux_in_air_due_to_orographic_gravity_waves
upward_flux_of_eastward_momentum_due_to_orographic_gravity_waves
upward_eastward_stress_at_sea_ice_base
""".split()


def counterpart(standard_name: str) -> str:
    """The name of the component along y or to the north."""
    return standard_name.replace("eastward", "northward") if "eastward" in standard_name else standard_name.replace("x_", "y_")


def vector_pairs(standard_names: dict[str, str], dims: dict[str, Sequence[str]] | None = None) -> list[tuple[str, str, str]]:
    """``(u, v, axes)`` of the variables that are components of a vector; axes: ``map`` or ``earth``.

    A variable's standard name begins with a known one, and its partner's with that one's counterpart (``x_wind_10m`` is a component too);
    partners have the same dimensions. A variable is in one vector only, the first that is found.
    """
    out, used = [], set()
    for axes, names in (("map", MAP_VECTORS), ("earth", EARTH_VECTORS)):
        for name in names:
            first = [v for v, s in standard_names.items() if s.startswith(name)]
            second = [v for v, s in standard_names.items() if s.startswith(counterpart(name))]
            for u in first:
                free = [v for v in second if u not in used and v not in used and v != u and (dims is None or list(dims[u]) == list(dims[v]))]
                if free:
                    out.append((u, free[0], axes))
                    used |= {u, free[0]}
    return out


def rotate_all(df: DataFrame, standard_names: dict[str, str], angle: Column | str, dims: dict[str, Sequence[str]] | None = None, to_earth: bool = True) -> DataFrame:
    """Every vector on the map's axes turned by ``angle`` to east and north, or every one to east and north turned back."""
    for u, v, axes in vector_pairs(standard_names, dims):
        if axes == ("map" if to_earth else "earth"):
            a = F.col(angle) if isinstance(angle, str) else angle
            df = rotate_vectors(df, u, v, a if to_earth else -a)
    return df


def grid_distance(df: DataFrame, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Metres to the next point along x and along y; the last column and row have those of the ones before."""
    out = df
    for name, along, other in (("dx", x, y), ("dy", y, x)):
        w = Window.partitionBy(other).orderBy(along)
        d = distance(F.col(lon), F.col(lat), F.lead(lon).over(w), F.lead(lat).over(w))
        out = out.withColumn(name, d).withColumn(name, F.coalesce(F.col(name), F.lag(name).over(w)))
    return out


def hypsometric_altitude(df: DataFrame, z: str, pressure: str, virtual: str, surface_altitude: str, surface_pressure: str, cell: Iterable[str]) -> DataFrame:
    """``altitude`` of each level: thicknesses of the layers added up from the surface, whichever way levels are numbered."""
    from ..functions.columns import layer_thickness

    w = Window.partitionBy(*cell).orderBy(F.desc(pressure))
    below = F.coalesce(F.lag(pressure).over(w), F.col(surface_pressure))
    step = layer_thickness(below, F.col(pressure), F.col(virtual))
    out = df.withColumn("_step", step)
    return out.withColumn("altitude", F.col(surface_altitude) + F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
