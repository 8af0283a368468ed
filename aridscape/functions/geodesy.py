"""WGS84 <-> UTM as Column arithmetic (Krueger series, fourth order).

Everything stays inside whole-stage code generation; no row leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_A = 6378137.0
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_K0 = 0.9996
_E0 = 500000.0
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = 2 * math.sqrt(_N) / (1 + _N)

# Series coefficients in the third flattening n.
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def utm_zone(epsg: str) -> tuple[int, bool]:
    """(zone, is_north) of an ``EPSG:326zz`` / ``EPSG:327zz`` code."""
    code = int(epsg.split(":")[-1])
    if code // 100 not in (326, 327) or not 1 <= code % 100 <= 60:
        raise ValueError(f"{epsg} is not a WGS84 UTM code")
    return code % 100, code // 100 == 326


def with_utm(df: DataFrame, lon: str, lat: str, epsg: str, x: str = "x", y: str = "y") -> DataFrame:
    """Add easting and northing in metres.

    Each stage is its own projection: intermediate angles are referenced many
    times and must stay columns, not be copied into one huge expression.
    """
    zone, north = utm_zone(epsg)
    false_north = 0.0 if north else 10_000_000.0
    sin_lat = F.sin(F.radians(lat))
    staged = df.withColumns(
        {
            "_d": F.radians(F.col(lon) - F.lit(6.0 * zone - 183.0)),
            "_t": F.sinh(F.atanh(sin_lat) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * sin_lat)),
        }
    ).withColumns(
        {
            "_xi": F.atan2(F.col("_t"), F.cos("_d")),
            "_eta": F.atanh(F.sin("_d") / F.sqrt(F.lit(1.0) + F.col("_t") * F.col("_t"))),
        }
    )
    xi, eta = F.col("_xi"), F.col("_eta")
    east, up = eta, xi
    for j, a in enumerate(_FORWARD, start=1):
        east = east + F.lit(a) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
        up = up + F.lit(a) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
    return staged.withColumns(
        {x: F.lit(_E0) + east * (_K0 * _RADIUS), y: F.lit(false_north) + up * (_K0 * _RADIUS)}
    ).drop("_d", "_t", "_xi", "_eta")


def with_lonlat(df: DataFrame, x: str, y: str, epsg: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add longitude and latitude in degrees; staged like ``with_utm``."""
    zone, north = utm_zone(epsg)
    false_north = 0.0 if north else 10_000_000.0
    staged = df.withColumns(
        {
            "_xi0": (F.col(y) - F.lit(false_north)) / (_K0 * _RADIUS),
            "_eta0": (F.col(x) - F.lit(_E0)) / (_K0 * _RADIUS),
        }
    )
    xi0, eta0 = F.col("_xi0"), F.col("_eta0")
    xi, eta = xi0, eta0
    for j, b in enumerate(_INVERSE, start=1):
        xi = xi - F.lit(b) * F.sin(xi0 * (2.0 * j)) * F.cosh(eta0 * (2.0 * j))
        eta = eta - F.lit(b) * F.cos(xi0 * (2.0 * j)) * F.sinh(eta0 * (2.0 * j))
    staged = staged.withColumns({"_xi": xi, "_eta": eta}).withColumn("_chi", F.asin(F.sin("_xi") / F.cosh("_eta")))
    chi = F.col("_chi")
    phi = chi
    for j, d in enumerate(_LATITUDE, start=1):
        phi = phi + F.lit(d) * F.sin(chi * (2.0 * j))
    return staged.withColumns(
        {
            lon: F.degrees(F.atan2(F.sinh("_eta"), F.cos("_xi"))) + F.lit(6.0 * zone - 183.0),
            lat: F.degrees(phi),
        }
    ).drop("_xi0", "_eta0", "_xi", "_eta", "_chi")


GEOGRAPHIC = "EPSG:4326"


def with_transformed(df: DataFrame, x: str, y: str, source: str, target: str, out_x: str, out_y: str) -> DataFrame:
    """Coordinates of ``source`` in ``target``; each is geographic or UTM."""
    if source == target:
        return df.withColumns({out_x: F.col(x), out_y: F.col(y)})
    if source == GEOGRAPHIC:
        return with_utm(df, x, y, target, out_x, out_y)
    if target == GEOGRAPHIC:
        return with_lonlat(df, x, y, source, out_x, out_y)
    return with_utm(with_lonlat(df, x, y, source, "_lon", "_lat"), "_lon", "_lat", target, out_x, out_y).drop("_lon", "_lat")
