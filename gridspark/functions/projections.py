"""Map projections as column expressions: (lon, lat) in degrees to (x, y) in metres and back, on a sphere.

A definition is a PROJ string, read by ``parse``. Supported: latlong, ob_tran of latlong (rotated pole), stere, merc, lcc, laea, cea,
sinu, ortho, aeqd, aea, tmerc/utm/etmerc, omerc (by its equatorial pole), geos and nsper. An ellipsoid is taken as the sphere of its
semi-major axis; ``exact`` tells if a definition is on a sphere. Anything else raises ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clamp, longitude180

RADIUS = 6371000.0
ELLIPSOIDS = {"WGS84": 6378137.0, "GRS80": 6378137.0, "sphere": 6370997.0}


@dataclass(frozen=True)
class Projection:
    name: str
    radius: float = RADIUS
    exact: bool = True
    keys: dict[str, float] = field(default_factory=dict)
    forward: Callable[[Column, Column], tuple[Column, Column]] | None = None
    inverse: Callable[[Column, Column], tuple[Column, Column]] | None = None

    @property
    def degrees(self) -> bool:
        """Whether the axes are angles."""
        return self.name in ("latlong", "ob_tran")


def parse(text: str) -> Projection:
    words = dict((w.lstrip("+").split("=", 1) + [""])[:2] for w in text.split())
    name = {"longlat": "latlong", "lonlat": "latlong", "utm": "tmerc", "etmerc": "tmerc", "gstmerc": "tmerc"}.get(words.get("proj", ""), words.get("proj", ""))
    keys = {k: float(v) for k, v in words.items() if _is_number(v)}
    radius = keys.get("R", keys.get("a", ELLIPSOIDS.get(words.get("ellps", words.get("datum", "")), RADIUS)))
    exact = "R" in keys or keys.get("e", 1.0) == 0 or keys.get("b", 0) == radius or not {"ellps", "datum", "a", "rf"} & set(words)
    if "utm" in text and words.get("proj") == "utm":
        keys |= {"lon_0": 6 * keys["zone"] - 183, "lat_0": 0.0, "k": 0.9996, "x_0": 500000.0, "y_0": 10_000_000.0 if "south" in words else 0.0}
    try:
        make = MAKERS[name]
    except KeyError:
        raise ValueError(f"unsupported projection {text!r}") from None
    forward, inverse = make(keys, radius)
    dx, dy = keys.get("x_0", 0.0), keys.get("y_0", 0.0)
    if dx or dy:
        f0, i0 = forward, inverse
        forward = lambda lon, lat: tuple(a + b for a, b in zip(f0(lon, lat), (dx, dy), strict=True))
        inverse = lambda x, y: i0(x - dx, y - dy)
    return Projection(name, radius, exact, keys, forward, inverse)


def _is_number(v: str) -> bool:
    try:
        float(v)
    except ValueError:
        return False
    return True


def _unit(x: Column) -> Column:
    return clamp(x, -1.0, 1.0)


def _degrees(lon: Column, lat: Column, lon0: float) -> tuple[Column, Column]:
    return longitude180(F.degrees(lon) + lon0), F.degrees(lat)


def _centre(k: dict[str, float]) -> tuple[float, float, float]:
    lat0 = math.radians(k.get("lat_0", 0.0))
    return k.get("lon_0", 0.0), math.sin(lat0), math.cos(lat0)


def _latlong(k, r):
    return (lambda lon, lat: (lon, lat)), (lambda x, y: (longitude180(x), y))


def _turned(lon: Column, lat: Column, sin_p: float, cos_p: float) -> tuple[Column, Column]:
    """Radians in a system whose pole lies at the angle p from the old equator, on longitude pi."""
    a, cos_lat = F.cos(lon), F.cos(lat)
    lat2 = F.asin(_unit(sin_p * F.sin(lat) - cos_p * cos_lat * a))
    return F.atan2(cos_lat * F.sin(lon), sin_p * cos_lat * a + cos_p * F.sin(lat)), lat2


def _ob_tran(k, r):
    """Rotated pole: the new pole at latitude o_lat_p; axes in degrees."""
    p, lon0, turn = math.radians(k.get("o_lat_p", 90.0)), k.get("lon_0", 0.0), k.get("o_lon_p", 0.0)

    def forward(lon, lat):
        x, y = _turned(F.radians(lon - lon0), F.radians(lat), math.sin(p), math.cos(p))
        return longitude180(F.degrees(x) + turn), F.degrees(y)

    def inverse(x, y):
        a, b = F.radians(x - turn), F.radians(y)
        lat = F.asin(_unit(math.sin(p) * F.sin(b) + math.cos(p) * F.cos(b) * F.cos(a)))
        lon = F.atan2(F.cos(b) * F.sin(a), math.sin(p) * F.cos(b) * F.cos(a) - math.cos(p) * F.sin(b))
        return _degrees(lon, lat, lon0)

    return forward, inverse


def _azimuthal(k, r, scale_of: Callable[[Column], Column], angle_of: Callable[[Column], Column], seen=None):
    """``scale_of`` the cosine of the distance from the centre; ``angle_of`` the distance on the map over the radius."""
    lon0, s0, c0 = _centre(k)

    def forward(lon, lat):
        d, b = F.radians(lon - lon0), F.radians(lat)
        cosine = _unit(s0 * F.sin(b) + c0 * F.cos(b) * F.cos(d))
        scale = scale_of(cosine)
        scale = F.when(seen(cosine), scale) if seen else scale
        return r * scale * F.cos(b) * F.sin(d), r * scale * (c0 * F.sin(b) - s0 * F.cos(b) * F.cos(d))

    def inverse(x, y):
        rho = F.hypot(x, y)
        a = angle_of(rho / r)
        there = rho > 1e-9
        lat = F.when(there, F.asin(_unit(F.cos(a) * s0 + F.try_divide(y * F.sin(a) * c0, rho)))).otherwise(math.atan2(s0, c0))
        lon = F.when(there, F.atan2(x * F.sin(a), rho * c0 * F.cos(a) - y * s0 * F.sin(a))).otherwise(0.0)
        return _degrees(lon, lat, lon0)

    return forward, inverse


def _stere(k, r):
    scale = k.get("k", k.get("k_0", 1.0))
    if "lat_ts" in k and abs(abs(k.get("lat_0", 0.0)) - 90) < 1e-9:
        scale = (1 + math.sin(math.radians(abs(k["lat_ts"])))) / 2
    return _azimuthal(k, r, lambda c: F.try_divide(F.lit(2.0 * scale), 1.0 + c), lambda q: 2.0 * F.atan(q / (2.0 * scale)))


def _laea(k, r):
    return _azimuthal(k, r, lambda c: F.sqrt(F.try_divide(F.lit(2.0), 1.0 + c)), lambda q: 2.0 * F.asin(_unit(q / 2.0)))


def _ortho(k, r):
    return _azimuthal(k, r, lambda c: F.lit(1.0), lambda q: F.asin(_unit(q)), seen=lambda c: c >= 0)


def _aeqd(k, r):
    return _azimuthal(k, r, lambda c: F.when(c < 1.0 - 1e-14, F.try_divide(F.acos(c), F.sqrt(1.0 - c * c))).otherwise(1.0), lambda q: q)


def _nsper(k, r):
    p = 1 + k["h"] / r
    angle = lambda q: F.asin(_unit(F.try_divide(p - F.sqrt(clamp(1.0 - q * q * ((p + 1) / (p - 1)), 0.0)), (p - 1) / q + q / (p - 1))))
    return _azimuthal(k, r, lambda c: F.try_divide(F.lit(p - 1), p - c), lambda q: F.when(q > 0, angle(q)).otherwise(0.0), seen=lambda c: c > 1 / p)


def _merc(k, r):
    lon0, scale = k.get("lon_0", 0.0), math.cos(math.radians(k["lat_ts"])) if "lat_ts" in k else k.get("k_0", k.get("k", 1.0))
    return (lambda lon, lat: (F.radians(longitude180(lon - lon0)) * (r * scale), F.ln(F.tan(F.radians(lat) / 2.0 + math.pi / 4)) * (r * scale))), (
        lambda x, y: _degrees(x / (r * scale), F.atan(F.sinh(y / (r * scale))), lon0)
    )


def _cea(k, r):
    lon0, c = k.get("lon_0", 0.0), math.cos(math.radians(k.get("lat_ts", 0.0)))
    return (lambda lon, lat: (F.radians(longitude180(lon - lon0)) * (r * c), F.sin(F.radians(lat)) * (r / c))), (lambda x, y: _degrees(x / (r * c), F.asin(_unit(y * (c / r))), lon0))


def _sinu(k, r):
    lon0 = k.get("lon_0", 0.0)
    return (lambda lon, lat: (F.radians(longitude180(lon - lon0)) * F.cos(F.radians(lat)) * r, F.radians(lat) * r)), (
        lambda x, y: _degrees(F.when(F.abs(F.cos(y / r)) > 1e-12, F.try_divide(x, F.cos(y / r) * r)).otherwise(0.0), y / r, lon0)
    )


def _parallels(k) -> tuple[float, float]:
    one = k.get("lat_1", k.get("lat_0", 0.0))
    return math.radians(one), math.radians(k.get("lat_2", one))


def _lcc(k, r):
    lon0, lat0, (p1, p2) = k.get("lon_0", 0.0), math.radians(k.get("lat_0", k.get("lat_1", 0.0))), _parallels(k)
    t = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(p1) if abs(p1 - p2) < 1e-10 else math.log(math.cos(p1) / math.cos(p2)) / math.log(t(p2) / t(p1))
    f = math.cos(p1) * t(p1) ** n / n * k.get("k_0", 1.0)
    rho0 = r * f / t(lat0) ** n if abs(lat0) < math.pi / 2 else 0.0

    def forward(lon, lat):
        rho = F.pow(F.tan(F.radians(lat) / 2.0 + math.pi / 4), F.lit(-n)) * (r * f)
        a = F.radians(longitude180(lon - lon0)) * n
        return rho * F.sin(a), rho0 - rho * F.cos(a)

    def inverse(x, y):
        s = math.copysign(1, n)
        rho = F.hypot(x, rho0 - y) * s
        lat = F.when(F.abs(rho) > 1e-9, 2.0 * F.atan(F.pow(F.try_divide(F.lit(r * f), rho), F.lit(1 / n))) - math.pi / 2).otherwise(s * math.pi / 2)
        return _degrees(F.atan2(x * s, (rho0 - y) * s) / n, lat, lon0)

    return forward, inverse


def _aea(k, r):
    lon0, lat0, (p1, p2) = k.get("lon_0", 0.0), math.radians(k.get("lat_0", 0.0)), _parallels(k)
    n = (math.sin(p1) + math.sin(p2)) / 2
    c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    rho0 = r * math.sqrt(c - 2 * n * math.sin(lat0)) / n

    def forward(lon, lat):
        rho = F.sqrt(clamp(c - F.sin(F.radians(lat)) * (2 * n), 0.0)) * (r / n)
        a = F.radians(longitude180(lon - lon0)) * n
        return rho * F.sin(a), rho0 - rho * F.cos(a)

    def inverse(x, y):
        s = math.copysign(1, n)
        q = F.hypot(x, rho0 - y) * (n / r)
        return _degrees(F.atan2(x * s, (rho0 - y) * s) / n, F.asin(_unit((c - q * q) / (2 * n))), lon0)

    return forward, inverse


def _tmerc(k, r):
    lon0, lat0, scale = k.get("lon_0", 0.0), math.radians(k.get("lat_0", 0.0)), r * k.get("k_0", k.get("k", 1.0))

    def forward(lon, lat):
        d, b = F.radians(longitude180(lon - lon0)), F.radians(lat)
        return F.atanh(F.cos(b) * F.sin(d)) * scale, (F.atan2(F.tan(b), F.cos(d)) - lat0) * scale

    def inverse(x, y):
        a, d = x / scale, y / scale + lat0
        return _degrees(F.atan2(F.sinh(a), F.cos(d)), F.asin(_unit(F.sin(d) / F.cosh(a))), lon0)

    return forward, inverse


def _omerc(k, r):
    """Mercator along the great circle through the centre with azimuth alpha; axes turned back to north."""
    lat0, lonc, alpha = math.radians(k.get("lat_0", 0.0)), math.radians(k.get("lonc", k.get("lon_0", 0.0))), math.radians(k.get("alpha", 90.0))
    scale, gamma = r * k.get("k_0", k.get("k", 1.0)), math.radians(k.get("gamma", k.get("alpha", 90.0)))
    pole = math.asin(math.cos(lat0) * math.sin(alpha))
    pole_lon = lonc + math.atan2(-math.cos(alpha), -math.sin(lat0) * math.sin(alpha))
    sp, cp = math.sin(pole), math.cos(pole)

    def along(d, b):  # longitude along the circle and sine of the latitude from it
        return F.atan2(F.cos(b) * F.sin(d), cp * F.sin(b) - sp * F.cos(b) * F.cos(d)), sp * F.sin(b) + cp * F.cos(b) * F.cos(d)

    d0 = lonc - pole_lon
    start = math.atan2(math.cos(lat0) * math.sin(d0), cp * math.sin(lat0) - sp * math.cos(lat0) * math.cos(d0))
    north = math.sin(gamma), math.cos(gamma)

    def forward(lon, lat):
        u, s = along(F.radians(lon) - pole_lon, F.radians(lat))
        u = F.pmod(u - start + math.pi, F.lit(2 * math.pi)) - math.pi
        u, v = -u * scale, F.atanh(_unit(s)) * scale
        return u * north[0] - v * north[1], u * north[1] + v * north[0]

    def inverse(x, y):
        u, v = (x * north[0] + y * north[1]) / scale, (y * north[0] - x * north[1]) / scale
        t, q = start - u, F.tanh(v)
        w = 1.0 / F.cosh(v)
        lat = F.asin(_unit(sp * q + cp * w * F.cos(t)))
        lon = F.atan2(w * F.sin(t), cp * q - sp * w * F.cos(t))
        return longitude180(F.degrees(lon + pole_lon)), F.degrees(lat)

    return forward, inverse


def _geos(k, r):
    lon0, h = k.get("lon_0", 0.0), k["h"]
    p = 1 + h / r

    def forward(lon, lat):
        d, b = F.radians(lon - lon0), F.radians(lat)
        x, y, z = F.cos(b) * F.cos(d), F.cos(b) * F.sin(d), F.sin(b)
        seen = (p - x) * x - y * y - z * z > 0
        return F.when(seen, F.atan(F.try_divide(y, p - x)) * h), F.when(seen, F.atan(F.try_divide(z, F.hypot(y, p - x))) * h)

    def inverse(x, y):
        ty = F.tan(x / h)
        tz = F.tan(y / h) * F.sqrt(1.0 + ty * ty)
        a = 1.0 + ty * ty + tz * tz
        under = p * p - a * (p * p - 1)
        far = F.when(under >= 0, (p - F.sqrt(clamp(under, 0.0))) / a)
        px, py, pz = p - far, far * ty, far * tz
        return _degrees(F.atan2(py, px), F.asin(_unit(pz)), lon0)

    return forward, inverse


MAKERS = {"latlong": _latlong, "ob_tran": _ob_tran, "stere": _stere, "laea": _laea, "ortho": _ortho, "aeqd": _aeqd, "nsper": _nsper, "merc": _merc, "cea": _cea, "sinu": _sinu, "lcc": _lcc, "aea": _aea, "tmerc": _tmerc, "omerc": _omerc, "geos": _geos}


def transform(source: Projection, target: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    """Points of one projection in another."""
    return target.forward(*source.inverse(x, y))


def north_angle(p: Projection, lon: Column, lat: Column, step: float = 1e-4) -> Column:
    """Angle, in radians, by which a vector on the map's axes is turned to give one along east and north."""
    from .columns import bearing

    x, y = p.forward(lon, lat)
    up = p.inverse(x, y + (step if p.degrees else 10.0))
    return -bearing(lon, lat, *up)


#: CF grid mapping -> PROJ name and the attributes of its parameters.
CF = {
    "latitude_longitude": ("latlong", {}),
    "rotated_latitude_longitude": ("ob_tran", {"o_lat_p": "grid_north_pole_latitude"}),
    "polar_stereographic": ("stere", {"lat_0": "latitude_of_projection_origin", "lon_0": "straight_vertical_longitude_from_pole", "lat_ts": "standard_parallel", "k": "scale_factor_at_projection_origin"}),
    "stereographic": ("stere", {"lat_0": "latitude_of_projection_origin", "lon_0": "longitude_of_projection_origin", "lat_ts": "standard_parallel", "k": "scale_factor_at_projection_origin"}),
    "mercator": ("merc", {"lon_0": "longitude_of_projection_origin", "lat_ts": "standard_parallel", "k_0": "scale_factor_at_projection_origin"}),
    "lambert_conformal_conic": ("lcc", {"lat_0": "latitude_of_projection_origin", "lon_0": "longitude_of_central_meridian", "lat_1": "standard_parallel"}),
    "lambert_azimuthal_equal_area": ("laea", {"lat_0": "latitude_of_projection_origin", "lon_0": "longitude_of_projection_origin"}),
    "lambert_cylindrical_equal_area": ("cea", {"lon_0": "longitude_of_central_meridian", "lat_ts": "standard_parallel"}),
    "albers_conical_equal_area": ("aea", {"lat_0": "latitude_of_projection_origin", "lon_0": "longitude_of_central_meridian", "lat_1": "standard_parallel"}),
    "azimuthal_equidistant": ("aeqd", {"lat_0": "latitude_of_projection_origin", "lon_0": "longitude_of_projection_origin"}),
    "orthographic": ("ortho", {"lat_0": "latitude_of_projection_origin", "lon_0": "longitude_of_projection_origin"}),
    "sinusoidal": ("sinu", {"lon_0": "longitude_of_projection_origin"}),
    "transverse_mercator": ("tmerc", {"lat_0": "latitude_of_projection_origin", "lon_0": "longitude_of_central_meridian", "k_0": "scale_factor_at_central_meridian"}),
    "oblique_mercator": ("omerc", {"lat_0": "latitude_of_projection_origin", "lonc": "longitude_of_projection_origin", "alpha": "azimuth_of_central_line", "k_0": "scale_factor_at_projection_origin"}),
    "geostationary": ("geos", {"lon_0": "longitude_of_projection_origin", "lat_0": "latitude_of_projection_origin", "h": "perspective_point_height"}),
    "vertical_perspective": ("nsper", {"lat_0": "latitude_of_projection_origin", "lon_0": "longitude_of_projection_origin", "h": "perspective_point_height"}),
}


def from_cf(attributes: dict) -> str:
    """The PROJ string of a grid mapping variable's attributes."""
    if "proj4" in attributes:
        return attributes["proj4"]
    name, names = CF[attributes["grid_mapping_name"]]
    out = [f"+proj={name}"]
    if name == "ob_tran":
        out += ["+o_proj=latlong", f"+lon_0={float(attributes['grid_north_pole_longitude']) - 180:g}", f"+o_lon_p={float(attributes.get('north_pole_grid_longitude', 0)):g}"]
    for key, attribute in names.items():
        if attribute in attributes:
            v = attributes[attribute]
            v = list(v) if isinstance(v, (list, tuple)) else [v]
            out.append(f"+{key}={float(v[0]):.12g}")
            if key == "lat_1":
                out.append(f"+lat_2={float(v[-1]):.12g}")
    for key, attribute in (("x_0", "false_easting"), ("y_0", "false_northing")):
        if attributes.get(attribute):
            out.append(f"+{key}={float(attributes[attribute]):.12g}")
    radius = attributes.get("earth_radius", attributes.get("semi_major_axis", RADIUS))
    round_earth = "semi_minor_axis" not in attributes and float(attributes.get("inverse_flattening", 0)) <= 0
    return " ".join([*out, f"+a={float(radius):.12g}", "+e=0" if round_earth else f"+rf={attributes.get('inverse_flattening', 0)}", "+no_defs"])


def to_cf(text: str) -> dict:
    """Attributes of a grid mapping variable for a PROJ string."""
    p = parse(text)
    cf = next(k for k, (name, _) in CF.items() if name == p.name and not (k == "polar_stereographic" and abs(p.keys.get("lat_0", 0)) != 90))
    out = {"grid_mapping_name": cf, "earth_radius": p.radius, "proj4": text}
    for key, attribute in CF[cf][1].items():
        if key in p.keys:
            out[attribute] = [p.keys["lat_1"], p.keys["lat_2"]] if key == "lat_1" and "lat_2" in p.keys else p.keys[key]
    if p.name == "ob_tran":
        out |= {"grid_north_pole_longitude": p.keys.get("lon_0", 0.0) + 180}
    return out
