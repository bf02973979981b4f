"""Grid arithmetic and the one map projection the tables use."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

CHIP = 224

# Ellipsoid and parallels of the conterminous-US Albers projection (EPSG:5070).
A_AXIS = 6378137.0
E2 = 0.006694380022903416
LAT1, LAT2, LAT0, LON0 = 29.5, 45.5, 23.0, -96.0


def pixel_xy(row: Column, col: Column, a: Column, b: Column, c: Column,
             d: Column, e: Column, f: Column) -> tuple[Column, Column]:
    """Centre coordinates of a pixel under affine (a..f)."""
    cx, cy = col + 0.5, row + 0.5
    return a * cx + b * cy + c, d * cx + e * cy + f


def chip_of(index: Column, chip: int = CHIP) -> Column:
    """Offset of the whole-tile chip that holds a row or column."""
    return (F.floor(index / F.lit(chip)) * chip).cast("int")


def sample_id(crop: Column, state: Column, year: Column, row_off: Column, col_off: Column) -> Column:
    return F.concat(F.lower(crop), F.lit("_"), state, F.lit("_"), year.cast("string"),
                    F.lit("_r"), row_off.cast("string"), F.lit("_c"), col_off.cast("string"))


def _q(phi: float) -> float:
    e, s = math.sqrt(E2), math.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)


def albers_constants() -> dict[str, float]:
    """Cone constant, scale and origin radius of the projection (Snyder's formulas)."""
    p0, p1, p2 = (math.radians(x) for x in (LAT0, LAT1, LAT2))
    n = (_m(p1) ** 2 - _m(p2) ** 2) / (_q(p2) - _q(p1))
    c = _m(p1) ** 2 + n * _q(p1)
    return {"n": n, "c": c, "rho0": A_AXIS * math.sqrt(c - n * _q(p0)) / n, "qp": _q(math.pi / 2),
            "s2": E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040,
            "s4": 23 * E2**2 / 360 + 251 * E2**3 / 3780, "s6": 761 * E2**3 / 45360}


def lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude (degrees) of a projected point, via authalic latitude."""
    k = albers_constants()
    dy = F.lit(k["rho0"]) - y
    rho = F.sqrt(x * x + dy * dy)
    theta = F.atan2(x, dy)
    q = (F.lit(k["c"]) - rho * rho * F.lit(k["n"] ** 2 / A_AXIS**2)) / F.lit(k["n"])
    beta = F.asin(q / F.lit(k["qp"]))
    phi = (beta + F.lit(k["s2"]) * F.sin(2 * beta) + F.lit(k["s4"]) * F.sin(4 * beta)
           + F.lit(k["s6"]) * F.sin(6 * beta))
    return F.degrees(theta / F.lit(k["n"])) + F.lit(LON0), F.degrees(phi)


def location_coords(lat: Column, lon: Column) -> Column:
    return F.array(lat, lon)


def hann(i: Column, n: int, floor: float = 0.05) -> Column:
    """Floored Hann weight of position ``i`` in a window of ``n``."""
    return F.greatest(F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * math.pi / (n - 1)) * i), F.lit(floor))
