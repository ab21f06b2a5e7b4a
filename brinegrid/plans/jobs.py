"""The pipeline's jobs: each is one logical plan from sources to a sink."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import columns as C
from ..operators import lookup, quality
from ..sources import csv_union, discover, sinks
from ..sources.grid_source import GridDataSource


class InputMissing(RuntimeError):
    """Nothing to read, or no usable columns (exit code 1)."""

    code = 1


class NoProvider(RuntimeError):
    """No source of values is at hand (exit code 2)."""

    code = 2


def combine(spark: SparkSession, root: str, out: str, years=None, overwrite: bool = False, dry_run: bool = False, loose: bool = True) -> DataFrame:
    """All fleet CSV files under root, loose or zipped, as one CSV table with the union of their columns. dry_run returns the sources."""
    found = discover.discover_sources(spark, root, years, loose=loose, exclude=[out])
    if dry_run:
        return discover.sources_table(spark, found)
    if not found:
        raise InputMissing(f"no CSV files or archives under {root}")
    table = csv_union.read_sources(spark, found)
    sinks.write_csv(table, out, overwrite)
    return table


def split_by_year(table: DataFrame, out: str, time: str | None = None, format: str = "csv") -> DataFrame:
    """One folder per year; rows without a readable time are dropped. Returns rows per year."""
    name = C.resolve_column(table.columns, C.TIME_NAMES, time, table.columns[0] if table.columns else None)
    if name is None:
        raise InputMissing("the table has no columns")
    stamp = C.free_name(table.columns, "_stamp")
    rows = table.withColumn(stamp, C.coerce_time(C.quoted(name))).where(F.col(stamp).isNotNull())
    sinks.write_by_year(rows, out, stamp, format)
    return rows.groupBy(F.year(stamp).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def read_grid(spark: SparkSession, paths: Iterable[str], variable: str | None = None, depth_index: int | None = None, bbox: tuple | None = None) -> DataFrame:
    """Array files as one long table; slices are numbered anew by time over all files."""
    spark.dataSource.register(GridDataSource)
    r = spark.read.format("brine_grid").option("path", ",".join(paths))
    for k, v in (("variable", variable), ("depth_index", depth_index), ("bbox", ",".join(map(str, bbox)) if bbox else None)):
        if v is not None:
            r = r.option(k, str(v))
    return r.load()


def build_grid(spark: SparkSession, paths: list[str], out: str, **options) -> DataFrame:
    """Array files to the grid table (year, ti, t, j, i, lat, lon, v), partitioned by year and slice."""
    if not paths:
        raise InputMissing("no grid files")
    raw = read_grid(spark, paths, **options)
    # the time axis is short: a few hundred distinct slices a year
    times = [r["t"] for r in raw.select("t").distinct().orderBy("t").collect()]
    number = {}
    for t in times:
        number.setdefault(t.year, []).append(t)
    index = spark.createDataFrame([(t, y, k) for y, ts in number.items() for k, t in enumerate(ts)], "t timestamp_ntz, year int, ti int")
    cells = raw.drop("ti", "file").join(F.broadcast(index), "t").select("year", "ti", "t", "j", "i", "lat", "lon", "v")
    sinks.write_grid(cells, out)
    return spark.read.parquet(out)


def grid_of_year(table: DataFrame, year: int) -> lookup.Grid:
    """The grid of one year of a table written by build_grid. Axes are read from the slices' distinct coordinates."""
    own = table.where(F.col("year") == year)
    times = tuple(r["t"] for r in own.select("ti", "t").distinct().orderBy("ti").collect())
    lats = own.where("ti = 0").select("j", "lat").distinct().orderBy("j").collect()
    lons = own.where("ti = 0").select("i", "lon").distinct().orderBy("i").collect()
    low_j, low_i = min(r["j"] for r in lats), min(r["i"] for r in lons)
    cells = own.select("ti", (F.col("j") - low_j).alias("j"), (F.col("i") - low_i).alias("i"), "v")
    return lookup.Grid(cells, times, tuple(r["lat"] for r in lats), tuple(r["lon"] for r in lons))


def extract_year(points: DataFrame, grid_table: DataFrame, year: int, tolerance_days: int = 31, tile: int | None = 64) -> DataFrame:
    p = points.where(C.in_years(F.col("timestamp"), [year]))
    return lookup.lookup(p, grid_of_year(grid_table, year), tolerance_days, tile=tile)


def extract(points: DataFrame, grid_table: DataFrame, out: str | None = None, years: Iterable[int] | None = None, tolerance_days: int = 31, keep_missing_years: bool = True, tile: int | None = 64, max_rows: int = 0) -> DataFrame:
    """Points of all years looked up in the grids of their years. Years without a grid come out missing (or, on demand, not at all)."""
    have = sorted(r["year"] for r in grid_table.select("year").distinct().collect())
    if not have:
        raise NoProvider("the grid table is empty")
    wanted = [y for y in have if years is None or y in set(years)]
    frames = [extract_year(points, grid_table, y, tolerance_days, tile) for y in wanted]
    out_df = frames[0] if frames else None
    for f in frames[1:]:
        out_df = out_df.unionByName(f)
    if keep_missing_years or out_df is None:
        rest = points.where(~F.year("timestamp").isin(wanted))
        if years is not None:
            rest = rest.where(F.year("timestamp").isin(list(years)))
        none = rest.withColumns({"sst": F.lit(None).cast("double"), "sst_missing": F.lit(True), "sst_source": F.lit("missing"), "time_tolerance_days": F.lit(tolerance_days)})
        out_df = none if out_df is None else out_df.unionByName(none)
    if out:
        sinks.write_by_year(out_df, out, max_rows=max_rows)
        return points.sparkSession.read.parquet(out)
    return out_df


def report(enriched: DataFrame) -> DataFrame:
    return quality.report_lines(quality.by_year(enriched, F.year("timestamp")))
