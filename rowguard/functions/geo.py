"""Distances between coordinate pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Mean earth radius and the WGS-84 ellipsoid, in metres.
EARTH_RADIUS_M = 6371008.8
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563


def haversine_m(lat1, long1, lat2, long2) -> Column:
    """Great-circle distance in metres as one code-generated expression."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (lat1, long1, lat2, long2)]
    y1, x1, y2, x2 = cols
    half_y = F.sin(F.radians(y2 - y1) / 2)
    half_x = F.sin(F.radians(x2 - x1) / 2)
    h = half_y * half_y + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * half_x * half_x
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_between(lat1: np.ndarray, long1: np.ndarray, lat2: np.ndarray, long2: np.ndarray) -> np.ndarray:
    """The same distance as ``haversine_m`` over arrays."""
    half_y = np.sin(np.radians(lat2 - lat1) / 2)
    half_x = np.sin(np.radians(long2 - long1) / 2)
    h = half_y * half_y + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * half_x * half_x
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(32)


def nearly_opposite_m(lat1, long1, lat2, long2, rounds: int = 80) -> np.ndarray:
    """Geodesic length for any two points by Newton's method on the first azimuth (Karney, 2013), over arrays in degrees.

    With the point farther from the equator first and south, the longitude reached at the second latitude
    grows with the azimuth from 0 at north to half a turn at south, so the azimuth is kept between bounds
    and a step that leaves them halves them instead. Integrals along the arc are Gauss sums: the integrands
    are so nearly constant that 32 nodes leave nothing but rounding.
    """
    y1, x1, y2, x2 = (np.radians(np.asarray(v, dtype="float64")) for v in (lat1, long1, lat2, long2))
    f, b = WGS84_F, WGS84_A * (1 - WGS84_F)
    second = f * (2 - f) / (1 - f) ** 2  # second eccentricity, squared
    span = np.abs((x2 - x1 + np.pi) % (2 * np.pi) - np.pi)
    beta = np.stack([np.arctan((1 - f) * np.tan(y)) for y in (y1, y2)])
    far = np.abs(beta[1]) > np.abs(beta[0])
    first, last = np.where(far, beta[1], beta[0]), np.where(far, beta[0], beta[1])
    turned = np.where(first > 0, -1.0, 1.0)
    first, last = np.minimum(first * turned, -1e-150), last * turned
    s1, c1, s2, c2 = np.sin(first), np.cos(first), np.sin(last), np.cos(last)

    def path(azimuth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longitude reached, its derivative by the azimuth, and length."""
        sa, ca = np.sin(azimuth), np.cos(azimuth)
        sa0, ca0 = sa * c1, np.hypot(ca, sa * s1)
        ca2 = np.sqrt(np.maximum((ca * c1) ** 2 + (c2 - c1) * (c2 + c1), 0.0)) / c2
        arcs = np.arctan2(s1, ca * c1), np.arctan2(s2, ca2 * c2)
        turns = [np.arctan2(sa0 * np.sin(arc), np.cos(arc)) for arc in arcs]
        k2 = second * ca0**2
        half = (arcs[1] - arcs[0]) / 2
        spots = (arcs[0] + half)[..., None] + half[..., None] * _NODES
        bulge = k2[..., None] * np.sin(spots) ** 2
        root = np.sqrt(1 + bulge)
        east = (turns[1] - turns[0]) - f * sa0 * half * (((2 - f) / (1 + (1 - f) * root)) @ _WEIGHTS)
        swell = half * ((bulge / root) @ _WEIGHTS)
        (sin1, cos1), (sin2, cos2) = [(np.sin(arc), np.cos(arc)) for arc in arcs]
        reduced = np.sqrt(1 + k2 * sin2**2) * cos1 * sin2 - np.sqrt(1 + k2 * sin1**2) * sin1 * cos2 - cos1 * cos2 * swell
        return east, (1 - f) * reduced / (ca2 * c2), b * half * (root @ _WEIGHTS)

    low, high = np.zeros(span.shape), np.full(span.shape, np.pi)
    azimuth = np.full(span.shape, np.pi / 2 + 0.1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(rounds):
            east, slope, length = path(azimuth)
            over = east > span
            low, high = np.where(over, low, azimuth), np.where(over, azimuth, high)
            step = azimuth - (east - span) / slope
            halved = ~(np.isfinite(step) & (step > low) & (step < high))
            moved = np.where(halved, (low + high) / 2, step)
            if np.all(np.abs(moved - azimuth) < 1e-15):
                break
            azimuth = moved
    return length


def ellipsoid_m(lat1, long1, lat2, long2) -> np.ndarray:
    """Geodesic length in metres on WGS-84 by Vincenty's inverse formula (1975), over arrays.

    Nearly opposite points, where that iteration does not settle, are solved by Newton's method.
    """
    y1, x1, y2, x2 = (np.radians(np.asarray(v, dtype="float64")) for v in (lat1, long1, lat2, long2))
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(y1)), np.arctan((1 - WGS84_F) * np.tan(y2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    span = (x2 - x1 + np.pi) % (2 * np.pi) - np.pi
    lam = span.copy()
    settled = np.zeros(lam.shape, dtype=bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            s_sig = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            c_sig = su1 * su2 + cu1 * cu2 * cl
            sig = np.arctan2(s_sig, c_sig)
            s_alpha = np.where(s_sig > 0, cu1 * cu2 * sl / s_sig, 0.0)
            c2_alpha = 1 - s_alpha**2
            c_mid = np.where(c2_alpha > 1e-15, c_sig - 2 * su1 * su2 / c2_alpha, 0.0)
            c = WGS84_F / 16 * c2_alpha * (4 + WGS84_F * (4 - 3 * c2_alpha))
            turn = sig + c * s_sig * (c_mid + c * c_sig * (2 * c_mid**2 - 1))
            new = span + (1 - c) * WGS84_F * s_alpha * turn
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if settled.all():
                break
        u_sq = c2_alpha * (WGS84_A**2 - b**2) / b**2
        big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
        big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
        inner = c_sig * (2 * c_mid**2 - 1) - big_b / 6 * c_mid * (4 * s_sig**2 - 3) * (4 * c_mid**2 - 3)
        length = b * big_a * (sig - big_b * s_sig * (c_mid + big_b / 4 * inner))
    good = settled & (np.abs(lam) <= np.pi) & np.isfinite(length)
    if not good.all():
        parts = [np.broadcast_to(np.asarray(v, dtype="float64"), length.shape)[~good] for v in (lat1, long1, lat2, long2)]
        length = np.array(length, dtype="float64")
        length[~good] = nearly_opposite_m(*parts)
    return length


@F.pandas_udf(DoubleType())
def _ellipsoid(lat1: pd.Series, long1: pd.Series, lat2: pd.Series, long2: pd.Series) -> pd.Series:
    parts = [s.to_numpy(dtype="float64", na_value=np.nan) for s in (lat1, long1, lat2, long2)]
    usable = np.isfinite(np.vstack(parts)).all(axis=0)
    out = np.full(len(lat1), np.nan)
    if usable.any():
        out[usable] = np.round(ellipsoid_m(*(p[usable] for p in parts)), 2)
    return pd.Series(out).astype("Float64").where(usable, pd.NA)


def with_distance(pairs: DataFrame, lat1: str, long1: str, lat2: str, long2: str, out: str = "distance_m") -> DataFrame:
    """Add the ellipsoidal distance in metres, 2 decimals; null when a point is missing or off the globe."""
    from rowguard.functions.predicates import is_valid_point

    ok = is_valid_point(lat1, long1) & is_valid_point(lat2, long2)
    args = [F.when(ok, F.col(c).try_cast("double")) for c in (lat1, long1, lat2, long2)]
    return pairs.withColumn(out, _ellipsoid(*args))
