"""Geometry without geometry libraries: transverse Mercator, squares, overlap, pixel grids.

Column functions where arithmetic is enough; pandas functions (Arrow batches) for polygons.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import computed_once

# WGS84 ellipsoid and UTM scale.
SEMI_MAJOR, FLATTENING, SCALE = 6_378_137.0, 1 / 298.257223563, 0.9996

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger's series to the third order.
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _zone(epsg: int) -> tuple[float, float]:
    return math.radians((epsg % 100) * 6 - 183), 0.0 if epsg < 32700 else 10_000_000.0


def to_utm(lat: np.ndarray, lon: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    centre, north = _zone(epsg)
    phi, lam = np.radians(lat), np.radians(lon) - centre
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, a in enumerate(_FORWARD, 1))
    y = xi + sum(a * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, a in enumerate(_FORWARD, 1))
    return 500_000 + SCALE * _RADIUS * x, north + SCALE * _RADIUS * y


def from_utm(x: np.ndarray, y: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    centre, north = _zone(epsg)
    xi, eta = (np.asarray(y) - north) / (SCALE * _RADIUS), (np.asarray(x) - 500_000) / (SCALE * _RADIUS)
    a = xi - sum(b * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, b in enumerate(_BACK, 1))
    c = eta - sum(b * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, b in enumerate(_BACK, 1))
    chi = np.arcsin(np.sin(a) / np.cosh(c))
    phi = chi + sum(d * np.sin(2 * k * chi) for k, d in enumerate(_LATITUDE, 1))
    return np.degrees(phi), np.degrees(centre + np.arctan2(np.sinh(c), np.cos(a)))


def _zone_columns(epsg: Column) -> tuple[Column, Column]:
    return F.radians((epsg % 100) * 6 - 183), F.when(epsg < 32700, 0.0).otherwise(10_000_000.0)


def utm_of(lat: Column, lon: Column, epsg: Column) -> Column:
    """to_utm as a column: array(x, y)."""
    centre, north = _zone_columns(epsg)
    e = 2 * math.sqrt(_N) / (1 + _N)

    def series(z: Column) -> Column:
        xi, eta = z[0], z[1]
        x = eta + sum((a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(_FORWARD, 1)), F.lit(0.0))
        y = xi + sum((a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(_FORWARD, 1)), F.lit(0.0))
        return F.array(500_000 + SCALE * _RADIUS * x, north + SCALE * _RADIUS * y)

    def angles(p: Column) -> Column:
        t, lam = p[0], p[1]
        return computed_once(F.array(F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))), series)

    sine = F.sin(F.radians(lat))
    t = computed_once(sine, lambda s: F.sinh(F.atanh(s) - e * F.atanh(e * s)))
    return computed_once(F.array(t, F.radians(lon) - centre), angles)


def lat_lon_of(x: Column, y: Column, epsg: Column) -> Column:
    """from_utm as a column: array(lat, lon)."""
    centre, north = _zone_columns(epsg)

    def series(z: Column) -> Column:
        a = z[0] - sum((b * F.sin(2 * k * z[0]) * F.cosh(2 * k * z[1]) for k, b in enumerate(_BACK, 1)), F.lit(0.0))
        c = z[1] - sum((b * F.cos(2 * k * z[0]) * F.sinh(2 * k * z[1]) for k, b in enumerate(_BACK, 1)), F.lit(0.0))
        return computed_once(F.array(a, c), angles)

    def angles(z: Column) -> Column:
        chi = F.asin(F.sin(z[0]) / F.cosh(z[1]))
        phi = computed_once(chi, lambda h: h + sum((d * F.sin(2 * k * h) for k, d in enumerate(_LATITUDE, 1)), F.lit(0.0)))
        return F.array(F.degrees(phi), F.degrees(centre + F.atan2(F.sinh(z[1]), F.cos(z[0]))))

    return computed_once(F.array((y - north) / (SCALE * _RADIUS), (x - 500_000) / (SCALE * _RADIUS)), series)


def between_zones(x: Column, y: Column, epsg: Column, to: Column) -> Column:
    """array(x, y) in another UTM zone; the same numbers in the same one."""
    there = computed_once(lat_lon_of(x, y, epsg), lambda p: utm_of(p[0], p[1], to))
    return F.when(epsg == to, F.array(x, y)).otherwise(there)


def square(lat: float, lon: float, epsg: int, size_km: float) -> tuple[list[list[float]], float]:
    """A square of size_km about a point: its closed ring of (lon, lat) and its area in square km."""
    x, y = (float(v) for v in to_utm(np.array(lat), np.array(lon), epsg))
    h = size_km * 500
    xs, ys = np.array([x - h, x + h, x + h, x - h, x - h]), np.array([y - h, y - h, y + h, y + h, y - h])
    la, lo = from_utm(xs, ys, epsg)
    return [[float(a), float(b)] for a, b in zip(lo, la, strict=True)], ring_area(np.stack([xs, ys], 1)) / 1e6


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def to_wkb(ring: Sequence[Sequence[float]]) -> bytes:
    """A polygon of one ring as well-known binary, little endian."""
    return struct.pack("<BIII", 1, 3, 1, len(ring)) + np.array([list(p) for p in ring], dtype="<f8").tobytes()


def from_wkb(data: bytes) -> list[list[float]]:
    """The outer ring of a little-endian polygon."""
    order, kind, _, points = struct.unpack_from("<BIII", data)
    if order != 1 or kind != 3:
        raise ValueError("no little-endian polygon")
    return np.frombuffer(data, dtype="<f8", count=2 * points, offset=13).reshape(-1, 2).tolist()


def wkb(ring: str) -> Column:
    return F.pandas_udf(lambda rings: rings.map(to_wkb), "binary")(ring)


def ring_of(data: str) -> Column:
    return F.pandas_udf(lambda rows: rows.map(from_wkb), "array<array<double>>")(data)


def snapped(low: Column, high: Column, step: float = 20.0) -> tuple[Column, Column]:
    """Bounds snapped outward to the pixel grid."""
    return F.floor(low / step) * step, F.ceil(high / step) * step


def grid_mask(ring: Sequence[Sequence[float]], step: float = 20.0) -> tuple[tuple[float, float, float, float], np.ndarray]:
    """(left, bottom, right, top) of the snapped grid, and which pixel centres lie inside the ring."""
    p = np.array([list(q[:2]) for q in ring])
    (left, bottom), (right, top) = np.floor(p.min(0) / step) * step, np.ceil(p.max(0) / step) * step
    xs, ys = np.arange(left + step / 2, right, step), np.arange(top - step / 2, bottom, -step)
    gx, gy = np.meshgrid(xs, ys)
    inside = np.zeros(gx.shape, dtype=bool)
    for (x1, y1), (x2, y2) in zip(p, np.roll(p, -1, 0), strict=True):
        crosses = (y1 > gy) != (y2 > gy)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= crosses & (gx < (x2 - x1) * (gy - y1) / (y2 - y1) + x1)
    return (float(left), float(bottom), float(right), float(top)), inside
