"""Grids in degrees or transverse Mercator zones to spherical Mercator, in numpy, one scene at a time.

The zone projection is Krueger's series in the third flattening, good to well
below a millimetre inside a zone. The new grid has square pixels as long as the
old ones along the scene's diagonal and covers the mapped border of the scene.
"""

from __future__ import annotations

import numpy as np

from orbitframe.operators.kernels import mercator, unmercator

# The WGS 84 ellipsoid and the zones' scale, false easting and false northing.
RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EAST = 500_000.0
FALSE_NORTH = 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
_E = np.sqrt(FLATTENING * (2 - FLATTENING))
_RECTIFYING = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# The series' coefficients, from conformal to rectifying latitude and back.
_TO = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_FROM = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)

#: Points on each side of a scene whose images bound the new grid.
BORDER_POINTS = 21


def zone_of(epsg: int) -> tuple[int, bool] | None:
    """Zone and whether it is a southern one; None where the code is no such zone."""
    zone, south = epsg % 100, epsg // 100 == 327
    return (zone, south) if epsg // 100 in (326, 327) and 1 <= zone <= 60 else None


def _meridian(zone: int) -> float:
    return 6.0 * zone - 183.0


def to_zone(lon: np.ndarray, lat: np.ndarray, zone: int, south: bool) -> tuple[np.ndarray, np.ndarray]:
    """Degrees to easting and northing."""
    turn, phi = np.radians(np.asarray(lon, float) - _meridian(zone)), np.radians(np.asarray(lat, float))
    t = np.sinh(np.arctanh(np.sin(phi)) - _E * np.arctanh(_E * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(turn)), np.arctanh(np.sin(turn) / np.hypot(1, t))
    x, y = eta.copy(), xi.copy()
    for k, c in enumerate(_TO, 1):
        x += c * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
        y += c * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
    return FALSE_EAST + SCALE * _RECTIFYING * x, SCALE * _RECTIFYING * y + (FALSE_NORTH if south else 0.0)


def from_zone(east: np.ndarray, north: np.ndarray, zone: int, south: bool) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing to degrees."""
    y = (np.asarray(north, float) - (FALSE_NORTH if south else 0.0)) / (SCALE * _RECTIFYING)
    x = (np.asarray(east, float) - FALSE_EAST) / (SCALE * _RECTIFYING)
    xi, eta = y.copy(), x.copy()
    for k, c in enumerate(_FROM, 1):
        xi -= c * np.sin(2 * k * y) * np.cosh(2 * k * x)
        eta -= c * np.cos(2 * k * y) * np.sinh(2 * k * x)
    target = np.sin(xi) / np.hypot(np.sinh(eta), np.cos(xi))  # tangent of the conformal latitude
    tau = target.copy()
    for _ in range(6):  # Newton, from conformal to geographic
        root = np.hypot(1, tau)
        s = np.sinh(_E * np.arctanh(_E * tau / root))
        here = tau * np.hypot(1, s) - s * root
        tau += (target - here) / np.hypot(1, here) * (1 + (1 - _E**2) * tau**2) / ((1 - _E**2) * root)
    return _meridian(zone) + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))), np.degrees(np.arctan(tau))


def _to_degrees(epsg: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x, y) if epsg == 4326 else from_zone(x, y, *zone_of(epsg))


def _from_degrees(epsg: int, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (lon, lat) if epsg == 4326 else to_zone(lon, lat, *zone_of(epsg))


def known(epsg: int | None) -> bool:
    return epsg == 4326 or (epsg is not None and zone_of(int(epsg)) is not None)


def mercator_grid(height: int, width: int, transform: tuple[float, ...], epsg: int) -> tuple[int, int, float, float, float]:
    """Rows, columns, pixel size, left and top of the scene's grid in Mercator metres."""
    a, b, c, d, e, f = transform
    along = np.linspace(0, 1, BORDER_POINTS)
    low, high = np.zeros(BORDER_POINTS), np.ones(BORDER_POINTS)
    col, row = width * np.concatenate([along, along, low, high]), height * np.concatenate([low, high, along, along])
    x, y = mercator(*_to_degrees(epsg, a * col + b * row + c, d * col + e * row + f))
    size = float(np.hypot(x[-1] - x[0], y[-1] - y[0]) / np.hypot(width, height))
    count = lambda v: max(1, int((v.max() - v.min()) / size + 0.5))
    return count(y), count(x), size, float(x.min()), float(y.max())


def to_mercator(bands: list[np.ndarray], transform: tuple[float, ...], epsg: int) -> tuple[list[np.ndarray], tuple[float, ...]]:
    """Byte bands resampled bilinearly to the Mercator grid; pixels from outside the scene are 0.

    Rows of the new grid are made a few at a time, so that positions need less
    room than the scene.
    """
    if not known(epsg):
        raise ValueError(f"no projection to Mercator from EPSG {epsg}")
    height, width = bands[0].shape
    a, b, c, d, e, f = transform
    rows, cols, size, left, top = mercator_grid(height, width, transform, epsg)
    out = [np.zeros((rows, cols), np.uint8) for _ in bands]
    at_once = max(1, (1 << 18) // cols)
    det = a * e - b * d
    for start in range(0, rows, at_once):
        y, x = np.meshgrid(top - (np.arange(start, min(rows, start + at_once)) + 0.5) * size, left + (np.arange(cols) + 0.5) * size, indexing="ij")
        sx, sy = _from_degrees(epsg, *unmercator(x, y))
        col, row = (e * (sx - c) - b * (sy - f)) / det, (a * (sy - f) - d * (sx - c)) / det
        inside = (col >= 0) & (col < width) & (row >= 0) & (row < height)
        c0, r0 = np.floor(col - 0.5).astype(int), np.floor(row - 0.5).astype(int)
        fc, fr = col - 0.5 - c0, row - 0.5 - r0
        cl, ch = np.clip(c0, 0, width - 1), np.clip(c0 + 1, 0, width - 1)
        rl, rh = np.clip(r0, 0, height - 1), np.clip(r0 + 1, 0, height - 1)
        for band, made in zip(bands, out, strict=True):
            upper = band[rl, cl] * (1 - fc) + band[rl, ch] * fc
            lower = band[rh, cl] * (1 - fc) + band[rh, ch] * fc
            made[start : start + len(y)] = np.where(inside, np.clip(np.rint(upper * (1 - fr) + lower * fr), 0, 255), 0).astype(np.uint8)
    return out, (size, 0.0, left, 0.0, -size, top)
