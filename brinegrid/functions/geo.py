"""Longitudes, tiles, pixels, and interpolation arithmetic as Column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond this latitude the Mercator projection has no tile.
MERCATOR_LIMIT = 85.0511287798066


def normalize_lon(lon: Column, grid_min: float, grid_max: float) -> Column:
    """A longitude in the convention of a grid: 0..360 if it starts at 0 or more and passes 180, else -180..180. One wrap only."""
    if grid_min >= 0 and grid_max > 180:
        return F.when(lon < 0, lon + 360).otherwise(lon)
    return F.when(lon > 180, lon - 360).otherwise(lon)


def matrix_size(zoom: int | Column) -> tuple[Column, Column]:
    """Columns and rows of the geodetic tile matrix."""
    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    two = F.lit(2.0)
    return F.pow(two, z + 1).cast("int"), F.pow(two, z).cast("int")


def _clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def _tile_float(lon: Column, lat: Column, zoom) -> tuple[Column, Column]:
    w, h = matrix_size(zoom)
    return (lon + 180.0) / (F.lit(360.0) / w), (F.lit(90.0) - lat) / (F.lit(180.0) / h)


def geodetic_tile(lon: Column, lat: Column, zoom) -> tuple[Column, Column]:
    """Tile column and row, clamped to the matrix."""
    w, h = matrix_size(zoom)
    x, y = _tile_float(lon, lat, zoom)
    return _clamp(F.floor(x).cast("int"), 0, w - 1), _clamp(F.floor(y).cast("int"), 0, h - 1)


def geodetic_pixel(lon: Column, lat: Column, zoom, pixels: int = 256) -> tuple[Column, Column]:
    """Pixel within the tile, 0..pixels - 1, rounded half to even."""
    x, y = _tile_float(lon, lat, zoom)
    col, row = geodetic_tile(lon, lat, zoom)
    at = lambda v, t: _clamp(F.rint((v - t) * (pixels - 1)).cast("int"), 0, pixels - 1)
    return at(x, col), at(y, row)


def _mercator_float(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    n = float(2**zoom)
    phi = F.radians(lat)
    x = (lon + 180.0) / 360.0 * n
    y = (F.lit(1.0) - F.ln(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / math.pi) / 2.0 * n
    ok = lat.between(-MERCATOR_LIMIT, MERCATOR_LIMIT)
    return F.when(ok, x), F.when(ok, y)


def mercator_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Tile x and y, truncated toward zero and not clamped; null beyond the projection's limit."""
    x, y = _mercator_float(lat, lon, zoom)
    return x.cast("int"), y.cast("int")


def mercator_pixel(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    x, y = _mercator_float(lat, lon, zoom)
    return ((x - x.cast("int")) * 256).cast("int"), ((y - y.cast("int")) * 256).cast("int")


def bilinear(q11: Column, q12: Column, q21: Column, q22: Column, tx: Column, ty: Column) -> Column:
    """Null if any corner is null."""
    upper = q11 * (1.0 - tx) + q12 * tx
    lower = q21 * (1.0 - tx) + q22 * tx
    return upper * (1.0 - ty) + lower * ty


def regular_step(axis: list[float], tolerance: float = 1e-9) -> float | None:
    """The axis's step if it is evenly spaced (ascending or descending), else None."""
    if len(axis) < 2:
        return None
    step = (axis[-1] - axis[0]) / (len(axis) - 1)
    return step if all(abs(axis[0] + k * step - v) <= tolerance * max(1.0, abs(v)) for k, v in enumerate(axis)) and step else None


def cell_index(x: Column, axis: list[float]) -> Column:
    """The axis index at or below x (in index order), clamped to 0..n - 2. Arithmetic on even axes, binary search on others."""
    n = len(axis)
    step = regular_step(axis)
    if step:
        return _clamp(F.floor((x - axis[0]) / step).cast("int"), 0, max(0, n - 2))

    @F.pandas_udf("int")
    def search(v: pd.Series) -> pd.Series:
        import numpy as np

        up = np.asarray(axis)
        i = np.searchsorted(up, v, side="right") - 1 if up[0] < up[-1] else n - 1 - np.searchsorted(up[::-1], v, side="left")
        return pd.Series(np.clip(i, 0, max(0, n - 2))).where(v.notna().to_numpy())

    return search(x)


def axis_fraction(x: Column, axis: list[float], index: Column) -> Column:
    """Where x lies between index and index + 1, as a share of the cell; 0.5 for a cell of no width."""
    step = regular_step(axis)
    if step:
        return (x - (F.lit(axis[0]) + index * F.lit(step))) / F.lit(step)
    values = F.array(*[F.lit(float(v)) for v in axis])
    a, z = values[index], values[index + 1]
    return F.when(z == a, 0.5).otherwise((x - a) / (z - a))
