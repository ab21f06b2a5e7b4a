"""Looking points up in a time x latitude x longitude grid.

A grid is a dense long table (ti, j, i, v): land and gaps are rows with a null value. Its axes are short and live on the
driver. The four corners of a cell are packed into one row (or whole tiles of cells into arrays), so that one equi-join
serves interpolation and its nearest-cell fallback alike.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import columns as C
from ..functions import geo

DAY_US = 86_400_000_000
EPOCH = dt.datetime(1970, 1, 1)


def micros(t: dt.datetime) -> int:
    d = t - EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


@dataclass(frozen=True)
class Grid:
    """cells: (ti, j, i, v), dense. Axes in index order; lats and lons ascend."""

    cells: DataFrame
    times: tuple[dt.datetime, ...]
    lats: tuple[float, ...]
    lons: tuple[float, ...]

    def normalized(self, lon: Column) -> Column:
        return geo.normalize_lon(lon, min(self.lons), max(self.lons))


def nearest_time(ts: Column, times: Sequence[dt.datetime], tolerance_days: int | None = None) -> Column:
    """struct(delta, ti): the slice nearest in time, the earlier one on a tie; null beyond the tolerance (inclusive). No join.

    On an even axis two candidates are compared; else all slices of the axis, which is short.
    """
    axis = [micros(t) for t in times]
    us = C.wall_micros(ts)
    n, step = len(axis), (axis[-1] - axis[0]) // max(1, len(axis) - 1)
    if n > 2 and step > 0 and all(axis[0] + k * step == a for k, a in enumerate(axis)):
        low = F.least(F.greatest(F.floor((us - axis[0]) / step).cast("int"), F.lit(0)), F.lit(n - 2))
        cand = F.array(*[F.struct(F.abs(us - (F.lit(axis[0]) + k.cast("bigint") * step)).alias("delta"), k.alias("ti")) for k in (low, low + 1)])
    else:
        cand = F.array(*[F.struct(F.abs(us - a).alias("delta"), F.lit(k).alias("ti")) for k, a in enumerate(axis)])
    best = F.array_min(cand)
    ok = us.isNotNull()
    if tolerance_days is not None:
        ok = ok & (best["delta"] <= tolerance_days * DAY_US)
    return F.when(ok, best)


def bracketing_times(ts: Column, times: Sequence[dt.datetime]) -> tuple[Column, Column]:
    """(index of the slice at or before, share of the way to the next), clamped to the axis."""
    axis = F.array(*[F.lit(micros(t)).cast("bigint") for t in times])
    us = C.wall_micros(ts)
    low = F.least(F.greatest(F.size(F.filter(axis, lambda a: a <= us)) - 1, F.lit(0)), F.lit(max(0, len(times) - 2)))
    a, z = axis[low], axis[F.least(low + 1, F.lit(len(times) - 1))]
    share = F.when(z == a, 0.0).otherwise((us - a) / (z - a))
    return low, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def pack_corners(cells: DataFrame) -> DataFrame:
    """(ti, j, i, q11, q12, q21, q22): each cell with its neighbours at i + 1, j + 1 and both. Windows stay within a slice's row or column."""
    right = Window.partitionBy("ti", "j").orderBy("i")
    up = Window.partitionBy("ti", "i").orderBy("j")
    c = cells.select("ti", "j", "i", F.col("v").alias("q11"), F.lead("v").over(right).alias("q12"))
    return c.select("ti", "j", "i", "q11", "q12", F.lead("q11").over(up).alias("q21"), F.lead("q12").over(up).alias("q22"))


def tile_grid(grid: Grid, side: int = 64) -> DataFrame:
    """(ti, tj, tk, vs): tiles of side x side cells with one row and column of the next tile, values in row order.

    For grids too large to broadcast: the join then moves one array per tile and slice, not one row per cell. A grid that
    is not dense raises, as its rows would be taken for others.
    """
    n, m = len(grid.lats), len(grid.lons)
    spread = lambda x: F.array_distinct(F.array(F.floor(x / side), F.floor((x - 1) / side)))
    t = grid.cells.select("ti", "j", "i", "v", F.explode(spread(F.col("j"))).alias("tj")).where("tj >= 0")
    t = t.select("*", F.explode(spread(F.col("i"))).alias("tk")).where("tk >= 0")
    t = t.groupBy("ti", "tj", "tk").agg(F.sort_array(F.collect_list(F.struct("j", "i", "v"))).alias("vs"))
    whole = F.least(F.lit(side + 1), n - F.col("tj") * side) * F.least(F.lit(side + 1), m - F.col("tk") * side)
    values = F.transform("vs", lambda x: x["v"])
    return t.select("ti", "tj", "tk", F.when(F.size("vs") == whole, values).otherwise(F.raise_error(F.lit("the grid is not dense"))).alias("vs"))


def place(points: DataFrame, grid: Grid, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points with j, i (cell, clamped), tx, ty (share of the cell), inside, and nj, ni (nearest cell, clamped)."""
    x = grid.normalized(C.quoted(lon))
    y = C.quoted(lat)
    p = points.withColumns({"_x": x, "_y": y})
    j, i = geo.cell_index(F.col("_y"), list(grid.lats)), geo.cell_index(F.col("_x"), list(grid.lons))
    p = p.withColumns({"j": j, "i": i})
    p = p.withColumns({"ty": geo.axis_fraction(F.col("_y"), list(grid.lats), F.col("j")), "tx": geo.axis_fraction(F.col("_x"), list(grid.lons), F.col("i"))})
    inside = F.col("_y").between(grid.lats[0], grid.lats[-1]) & F.col("_x").between(grid.lons[0], grid.lons[-1])
    # half way counts as the larger coordinate; outside, the edge is the nearest
    return p.withColumns({"inside": inside, "nj": F.when(F.col("ty") >= 0.5, F.col("j") + 1).otherwise(F.col("j")), "ni": F.when(F.col("tx") >= 0.5, F.col("i") + 1).otherwise(F.col("i"))}).drop("_x", "_y")


def _nearest_corner() -> Column:
    up, right = F.col("nj") > F.col("j"), F.col("ni") > F.col("i")
    return F.when(up & right, F.col("q22")).when(up, F.col("q21")).when(right, F.col("q12")).otherwise(F.col("q11"))


def _with_corners(placed: DataFrame, grid: Grid, tile: int | None, keys: Sequence[str] = ("ti",), how: str = "left") -> DataFrame:
    if tile is None:
        return placed.join(pack_corners(grid.cells), [*keys, "j", "i"], how)
    tiles = tile_grid(grid, tile)
    width = F.least(F.lit(tile + 1), len(grid.lons) - F.floor(F.col("i") / tile) * tile)  # tiles at the edge are narrower
    at = (F.col("j") % tile) * width + F.col("i") % tile + 1
    p = placed.withColumns({"tj": F.floor(F.col("j") / tile), "tk": F.floor(F.col("i") / tile)}).join(tiles, [*keys, "tj", "tk"], how)
    get = lambda k: F.try_element_at("vs", (at + k).cast("int"))
    return p.withColumns({"q11": get(0), "q12": get(1), "q21": get(width), "q22": get(width + 1)}).drop("vs", "tj", "tk")


def lookup(points: DataFrame, grid: Grid, tolerance_days: int = 31, lat: str = "lat", lon: str = "lon", time: str = "timestamp", tile: int | None = None, fallback: bool = True, interpolate: bool = True) -> DataFrame:
    """points with sst, sst_missing, sst_source (`interp`, `nearest`, `missing`) and time_tolerance_days.

    Nearest slice within the tolerance (inclusive; the earlier on a tie); bilinear value where the point is within the
    axes and no corner is null; else the nearest cell on each axis, at any distance; else missing. lon is kept as given.
    """
    p = points.withColumn("ti", nearest_time(C.quoted(time), grid.times, tolerance_days)["ti"])
    p = _with_corners(place(p, grid, lat, lon), grid, tile)
    made = F.when(F.col("inside"), geo.bilinear(*[F.col(q) for q in ("q11", "q12", "q21", "q22", "tx", "ty")])) if interpolate else F.lit(None).cast("double")
    near = _nearest_corner() if fallback else F.lit(None).cast("double")
    p = p.withColumns({"_i": made, "_n": near})
    source = F.when(F.col("_i").isNotNull(), "interp").when(F.col("_n").isNotNull(), "nearest").otherwise("missing")
    value = F.coalesce("_i", "_n")
    return p.select(*[C.quoted(c) for c in points.columns], value.alias("sst"), value.isNull().alias("sst_missing"), source.alias("sst_source"), F.lit(tolerance_days).alias("time_tolerance_days"))


def lookup_extrapolating(points: DataFrame, grid: Grid, ti: int = 0, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Bilinear from the clamped cell with weights beyond 0..1 outside the axes, always at slice ti; no fallback."""
    p = _with_corners(place(points.withColumn("ti", F.lit(ti)), grid, lat, lon), grid, None)
    q = [F.col(x) for x in ("q11", "q12", "q21", "q22")]
    value = geo.bilinear(*q, F.col("tx"), F.col("ty"))
    return p.select(*[C.quoted(c) for c in points.columns], value.alias("sst"), value.isNull().alias("sst_missing"))


def lookup_linear_in_time(points: DataFrame, grid: Grid, lat: str = "lat", lon: str = "lon", time: str = "timestamp") -> DataFrame:
    """Trilinear: bilinear at the two bracketing slices, blended; outside the time axis the edge slice. Nulls fall back to nearest slice and cell."""
    low, share = bracketing_times(C.quoted(time), grid.times)
    p = place(points.withColumns({"t0": low, "share": share}), grid, lat, lon)
    packed = pack_corners(grid.cells)
    made = F.when(F.col("inside"), geo.bilinear(*[F.col(q) for q in ("q11", "q12", "q21", "q22", "tx", "ty")]))
    for k in (0, 1):
        g = packed.withColumnsRenamed({"ti": "_ti", "j": "_j", "i": "_i"})
        same = (F.col("_ti") == F.least(F.col("t0") + k, F.lit(len(grid.times) - 1))) & (F.col("_j") == F.col("j")) & (F.col("_i") == F.col("i"))
        p = p.join(g, same, "left").drop("_ti", "_j", "_i")
        p = p.withColumns({f"b{k}": made, f"c{k}": _nearest_corner()}).drop("q11", "q12", "q21", "q22")
    blend = F.col("b0") * (1.0 - F.col("share")) + F.col("b1") * F.col("share")
    near = F.when(F.col("share") > 0.5, F.col("c1")).otherwise(F.col("c0"))
    value = F.coalesce(blend, near)
    return p.select(*[C.quoted(c) for c in points.columns], value.alias("sst"), value.isNull().alias("sst_missing"))


def lookup_by_period(points: DataFrame, cells: DataFrame, grid: Grid, period: str, how: str = "left") -> DataFrame:
    """One grid per period (a column of points and of cells, e.g. year or day), each of one slice.

    how = left keeps points whose period has no grid, with a null value and the flag set; inner drops them.
    """
    p = place(points, grid)
    right, up = Window.partitionBy(period, "j").orderBy("i"), Window.partitionBy(period, "i").orderBy("j")
    c = cells.select(period, "j", "i", F.col("v").alias("q11"), F.lead("v").over(right).alias("q12"))
    c = c.select(period, "j", "i", "q11", "q12", F.lead("q11").over(up).alias("q21"), F.lead("q12").over(up).alias("q22"))
    p = p.join(c, [period, "j", "i"], how)
    made = F.when(F.col("inside"), geo.bilinear(*[F.col(q) for q in ("q11", "q12", "q21", "q22", "tx", "ty")]))
    value = F.coalesce(made, _nearest_corner())
    return p.select(*[C.quoted(c) for c in points.columns], value.alias("sst"), value.isNull().alias("sst_missing"))


def first_provider(df: DataFrame, providers: dict[str, Column], out: str = "sst") -> DataFrame:
    """The first provider with a value, in order, and its name in {out}_provider; null where none has one."""
    name = F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in providers.items()])
    value = F.coalesce(*providers.values())
    return df.withColumns({out: value, f"{out}_missing": value.isNull(), f"{out}_provider": name})
