"""Coordinate checks and the transverse Mercator projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard import fixed_values as fv
from panelyard.functions.cleaning import to_number
from panelyard.operators.explore import value_counts

# WGS84 and UTM.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
FALSE_EASTING = 500_000.0
FALSE_NORTHING_SOUTH = 10_000_000.0


def with_coordinates(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Numeric lon_num and lat_num (null when unusable) and the reason in coord_status."""
    x, y = to_number(F.col(lon)), to_number(F.col(lat))
    missing = (F.trim(F.coalesce(F.col(lon).cast("string"), F.lit(""))) == "") | (
        F.trim(F.coalesce(F.col(lat).cast("string"), F.lit(""))) == ""
    )
    status = (
        F.when(missing, "missing")
        .when(x.isNull() | y.isNull(), "non_numeric")
        .when((F.abs(y) > 90) | (F.abs(x) > 180), "out_of_range")
        .otherwise("ok")
    )
    checked = df.withColumn("coord_status", status)
    ok = F.col("coord_status") == "ok"
    return checked.withColumns({"lon_num": F.when(ok, x), "lat_num": F.when(ok, y)})


def coordinate_report(df: DataFrame, lon: str, lat: str) -> DataFrame:
    return value_counts(with_coordinates(df, lon, lat), "coord_status")


def in_utm_reach(lon: Column, lat: Column, zone: int = fv.UTM_ZONE) -> Column:
    """Whether the projection is finite and sensible at a coordinate."""
    turn = F.radians(lon - F.lit(6.0 * zone - 183.0))
    return (F.abs(lat) < 90) & (F.abs(F.sin(turn)) * F.cos(F.radians(lat)) < 0.9895)


def with_utm(df: DataFrame, lon: str, lat: str, zone: int = fv.UTM_ZONE, south: bool = True, x: str = "easting", y: str = "northing") -> DataFrame:
    """Easting and northing in metres (Krueger series to fourth order, well below a millimetre near the zone)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
        13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
        61 / 240 * n**3 - 103 / 140 * n**4,
        49561 / 161280 * n**4,
    ]
    ecc = 2 * math.sqrt(n) / (1 + n)
    s, t, turn, xi, eta = (F.col(c) for c in ("_s", "_t", "_turn", "_xi", "_eta"))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    # one step per line of the formula: a single expression would repeat its parts many times over
    steps = [
        {"_s": F.sin(F.radians(lat)), "_turn": F.radians(F.col(lon) - F.lit(6.0 * zone - 183.0))},
        {"_t": F.sinh(F.atanh(s) - F.lit(ecc) * F.atanh(F.lit(ecc) * s))},
        {"_xi": F.atan2(t, F.cos(turn)), "_eta": F.atanh(F.sin(turn) / F.sqrt(1 + t * t))},
        {
            x: F.lit(FALSE_EASTING) + F.lit(UTM_SCALE * radius) * east,
            y: F.lit(FALSE_NORTHING_SOUTH if south else 0.0) + F.lit(UTM_SCALE * radius) * north,
        },
    ]
    out = df
    for step in steps:
        out = out.withColumns(step)
    return out.drop("_s", "_t", "_turn", "_xi", "_eta")
