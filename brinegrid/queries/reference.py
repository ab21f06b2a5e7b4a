"""Queries of the enrichment operators over the driver tables, with their SQL.

Points and grids are derived from the tables' keys by arithmetic, the same in Spark and in SQL; expression order is kept
equal, so that doubles are equal without rounding. Sums and means are rounded, as their order of addition differs.
"""

from __future__ import annotations

import datetime as dt
import json
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import columns as C
from ..functions import geo, text
from ..operators import lookup as L
from ..operators import quality, stratify
from ..plans import fallback, jobs
from ..plans.jobs import read_grid
from ..session import fresh_path
from ..sources import csv_union
from ..sources.discover import Source, expand_years, list_files
from ..sources.grid_source import located, open_store, surface_level, write_netcdf

TIMES = tuple(dt.datetime(2024, 1, 1) + dt.timedelta(days=6 * k) for k in range(6))
LATS = tuple(-85.0 + 10 * k for k in range(18))
LONS = tuple(-180.0 + 10 * k for k in range(36))
T0, STEP = L.micros(TIMES[0]), 6 * L.DAY_US
TOLERANCE = 2


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("MMSI"),
        F.col("ts").alias("timestamp"),
        (((F.col("user_id") * 37 + F.col("event_id") * 13) % 1801) / 10.0 - 90.0).alias("lat"),
        (((F.col("event_id") * 97 + F.col("user_id") * 11) % 5401) / 10.0 - 180.0).alias("lon"),
    )


def order_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").alias("timestamp"),
        F.year("o_orderdate").alias("year"),
        (((F.col("o_custkey") * 37 + F.col("o_orderkey") * 13) % 1701) / 10.0 - 85.0).alias("lat"),
        (((F.col("o_orderkey") * 97 + F.col("o_custkey") * 11) % 3501) / 10.0 - 180.0).alias("lon"),
    )


def grid(spark: SparkSession) -> L.Grid:
    n = spark.range(len(TIMES) * len(LATS) * len(LONS))
    ti, j, i = (F.col("id") / 648).cast("int"), (F.col("id") / 36).cast("int") % 18, (F.col("id") % 36).cast("int")
    c = n.select(ti.alias("ti"), j.cast("int").alias("j"), i.alias("i"))
    return L.Grid(c.withColumn("v", F.when((F.col("ti") * 7 + F.col("j") * 3 + F.col("i") * 5) % 11 != 0, ((F.col("ti") * 1000 + F.col("j") * 37 + F.col("i") * 3) % 301) / 10.0)), TIMES, LATS, LONS)


def period_cells(spark: SparkSession, name: str, first: int, n: int, step: int = 1) -> DataFrame:
    """One slice per period; every step-th number from first on has a grid."""
    c = spark.range(n * 648).select((F.lit(first) + (F.col("id") / 648).cast("int") * step).cast("int").alias(name), ((F.col("id") / 36).cast("int") % 18).cast("int").alias("j"), (F.col("id") % 36).cast("int").alias("i"))
    return c.withColumn("v", F.when((F.col(name) * 7 + F.col("j") * 3 + F.col("i") * 5) % 11 != 0, ((F.col(name) * 10 + F.col("j") * 37 + F.col("i") * 3) % 301) / 10.0))


EVENTS_SQL = """p0 as (select event_id, cast(user_id as varchar) as "MMSI", ts as "timestamp",
      ((user_id * 37 + event_id * 13) % 1801) / 10e0 - 90e0 as lat, ((event_id * 97 + user_id * 11) % 5401) / 10e0 - 180e0 as lon from events)"""
ORDERS_SQL = """p0 as (select o_orderkey, o_orderdate as "timestamp", cast(year(o_orderdate) as int) as year,
      ((o_custkey * 37 + o_orderkey * 13) % 1701) / 10e0 - 85e0 as lat, ((o_orderkey * 97 + o_custkey * 11) % 3501) / 10e0 - 180e0 as lon from orders)"""
GRID_SQL = """g as (select t.range as ti, j.range as j, i.range as i,
      case when (t.range * 7 + j.range * 3 + i.range * 5) % 11 <> 0 then ((t.range * 1000 + j.range * 37 + i.range * 3) % 301) / 10e0 end as v
      from range(6) t, range(18) j, range(36) i)"""
TIME_SQL = f"""p1 as (select *, least(greatest(cast(floor((epoch_us("timestamp") - {T0}) / {STEP}e0) as bigint), 0), 4) as k from p0),
    p2 as (select *, abs(epoch_us("timestamp") - ({T0} + k * {STEP})) as d0, abs(epoch_us("timestamp") - ({T0} + (k + 1) * {STEP})) as d1 from p1),
    p3 as (select *, least(d0, d1) as delta, case when d0 <= d1 then k else k + 1 end as ti0 from p2),
    p4 as (select *, case when delta <= {TOLERANCE * L.DAY_US} then ti0 end as ti from p3)"""


def place_sql(source: str, name: str = "q") -> str:
    return f"""{name}0 as (select *, case when lon > 180 then lon - 360e0 else lon end as x from {source}),
    {name}1 as (select *, least(greatest(cast(floor((lat - -85e0) / 10e0) as bigint), 0), 16) as j, least(greatest(cast(floor((x - -180e0) / 10e0) as bigint), 0), 34) as i from {name}0),
    {name}2 as (select *, (lat - (-85e0 + j * 10e0)) / 10e0 as ty, (x - (-180e0 + i * 10e0)) / 10e0 as tx, lat between -85 and 85 and x between -180 and 170 as inside from {name}1),
    {name} as (select *, case when ty >= 0.5e0 then j + 1 else j end as nj, case when tx >= 0.5e0 then i + 1 else i end as ni from {name}2)"""


def corners_sql(points: str, grid_name: str, key: str, point_key: str | None = None, join: str = "left join") -> str:
    pk = point_key or key
    return f"""select p.*, a.v as q11, b.v as q12, c.v as q21, d.v as q22, n.v as near
      from {points} p {join} {grid_name} a on a.{key} = p.{pk} and a.j = p.j and a.i = p.i
      left join {grid_name} b on b.{key} = p.{pk} and b.j = p.j and b.i = p.i + 1
      left join {grid_name} c on c.{key} = p.{pk} and c.j = p.j + 1 and c.i = p.i
      left join {grid_name} d on d.{key} = p.{pk} and d.j = p.j + 1 and d.i = p.i + 1
      left join {grid_name} n on n.{key} = p.{pk} and n.j = p.nj and n.i = p.ni"""


BILINEAR = "((q11 * (1e0 - tx) + q12 * tx) * (1e0 - ty) + (q21 * (1e0 - tx) + q22 * tx) * ty)"
INTERP = f"case when inside then {BILINEAR} end"


def lookup_sql(columns: str, tail: str = "") -> str:
    return f"with {EVENTS_SQL}, {GRID_SQL}, {TIME_SQL}, {place_sql('p4')}, r as ({corners_sql('q', 'g', 'ti')}), s as (select *, {INTERP} as made from r) select {columns} from s {tail}"


# step 1 and 2: lookups


def grid_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return L.lookup(event_points(spark, sf), grid(spark), TOLERANCE)


def grid_lookup_tiled(spark: SparkSession, sf: str) -> DataFrame:
    return L.lookup(event_points(spark, sf), grid(spark), TOLERANCE, tile=8)


def nearest_time(spark: SparkSession, sf: str) -> DataFrame:
    best = L.nearest_time(F.col("timestamp"), TIMES, TOLERANCE)
    return event_points(spark, sf).select("event_id", best["ti"].alias("ti"), best["delta"].alias("delta_us"))


def nearest_time_tie(spark: SparkSession, sf: str) -> DataFrame:
    """Points half way between two slices of a year's first days: the earlier slice."""
    p = order_points(spark, sf)
    half = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")) + F.make_dt_interval(F.lit(3) + 6 * (F.col("o_orderkey") % 5).cast("int"))
    best = L.nearest_time(half, TIMES)
    return p.select("o_orderkey", best["ti"].alias("ti"))


def bilinear_only(spark: SparkSession, sf: str) -> DataFrame:
    return L.lookup(event_points(spark, sf), grid(spark), TOLERANCE, fallback=False).select("event_id", "sst", "sst_missing")


def nearest_cell(spark: SparkSession, sf: str) -> DataFrame:
    return L.lookup(event_points(spark, sf), grid(spark), TOLERANCE, interpolate=False).select("event_id", "sst", "sst_missing")


def lookup_extrapolate(spark: SparkSession, sf: str) -> DataFrame:
    return L.lookup_extrapolating(event_points(spark, sf), grid(spark)).select("event_id", "sst", "sst_missing")


def lookup_time_linear(spark: SparkSession, sf: str) -> DataFrame:
    return L.lookup_linear_in_time(event_points(spark, sf), grid(spark)).select("event_id", "sst", "sst_missing")


# step 3: one grid per period, providers


def lookup_missing_year_left(spark: SparkSession, sf: str) -> DataFrame:
    return L.lookup_by_period(order_points(spark, sf), period_cells(spark, "year", 1995, 4), grid(spark), "year").select("o_orderkey", "year", "sst", "sst_missing")


def lookup_year_inner(spark: SparkSession, sf: str) -> DataFrame:
    return L.lookup_by_period(order_points(spark, sf), period_cells(spark, "year", 1995, 4), grid(spark), "year", "inner").select("o_orderkey", "year", "sst", "sst_missing")


def lookup_by_day(spark: SparkSession, sf: str) -> DataFrame:
    p = event_points(spark, sf).withColumn("day", F.day(F.date_trunc("DAY", "timestamp")))
    return L.lookup_by_period(p, period_cells(spark, "day", 2, 15, 2), grid(spark), "day").select("event_id", "day", "sst", "sst_missing")


def provider_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    local = L.lookup(event_points(spark, sf), grid(spark), TOLERANCE).select("event_id", F.col("sst").alias("local"))
    library = F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 30).cast("double"))
    remote = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 25).cast("double"))
    return L.first_provider(local, {"library": library, "local": F.col("local"), "http": remote}).drop("local")


PERIOD_SQL = """{name}s as (select {first} + t.range * {step} as {name} from range({n}) t),
    g as (select {name}, j.range as j, i.range as i, case when ({name} * 7 + j.range * 3 + i.range * 5) % 11 <> 0 then (({name} * 10 + j.range * 37 + i.range * 3) % 301) / 10e0 end as v
      from {name}s, range(18) j, range(36) i)"""


def period_sql(points: str, source: str, name: str, first: int, n: int, step: int, columns: str, join: str = "left join") -> str:
    return f"with {points}, {PERIOD_SQL.format(name=name, first=first, n=n, step=step)}, {place_sql(source)}, r as ({corners_sql('q', 'g', name, None, join)}), s as (select *, coalesce({INTERP}, near) as sst from r) select {columns}, sst, sst is null as sst_missing from s"


# step 4: quality


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """vessel_points with readings no thermometer gives (fill values and the like) set to null, so that they count as missing."""
    sst = F.col("sst")
    return table(spark, sf, "vessel_points").withColumn("sst", F.when(sst.between(*C.VALUE_RANGE), sst))


def qc_by_year(spark: SparkSession, sf: str) -> DataFrame:
    v = measured(spark, sf)
    q = quality.by_year(v, F.year("timestamp"), quantiles={})
    return q.withColumn("mean_sst", F.round("mean_sst", 6))


def qc_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    v = measured(spark, sf)
    return quality.by_year(v, F.year("timestamp")).select("year", F.round("median_sst", 6).alias("median_sst"), F.round("p99_sst", 6).alias("p99_sst"))


def qc_overall_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return quality.with_total(measured(spark, sf), F.year("timestamp"))


def qc_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of the flagship's output, per source of the value."""
    return grid_lookup(spark, sf).groupBy("sst_source").agg(F.count(F.lit(1)).alias("n"), F.min("sst").alias("min_sst"), F.max("sst").alias("max_sst"))


def qc_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.report_lines(quality.by_year(measured(spark, sf).where("timestamp is not null"), F.year("timestamp"), quantiles={})).select("year", "line")


# step 5: coercion, filters, counts


def dirty_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as text with planted bad times and coordinates."""
    k = F.col("o_orderkey")
    return order_points(spark, sf).select(
        k.cast("string").alias("mmsi"),
        F.when(k % 11 == 0, "2013-02-30").when(k % 13 == 0, F.lit(None)).otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("Time"),
        F.when(k % 7 == 0, "n/a").when(k % 17 == 0, "NaN").otherwise(F.col("lat").cast("string")).alias("Latitude"),
        F.col("lon").cast("string").alias("long"),
    )


def coerce_and_drop(spark: SparkSession, sf: str) -> DataFrame:
    return C.canonical_points(dirty_orders(spark, sf))


def split_year_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written to one folder per year, and counted."""
    ship = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("timestamp"))
    return jobs.split_by_year(ship, fresh_path(spark, "split"), format="parquet")


def distinct_years(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vessel_points").select(F.year("timestamp").alias("year")).where("year is not null").distinct()


def year_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Years given as text, trimmed, blanks dropped; compared as ranges of time so that the scan can use them."""
    years = expand_years("1996, ,1998")
    return table(spark, sf, "lineitem").where(C.in_years(F.col("l_shipdate"), years)).select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"))


def bbox_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vessel_points").where(F.col("lat").between(-20, 35) & F.col("lon").between(-60, 40)).select("obs_id", "lat", "lon")


def depth_surface(spark: SparkSession, sf: str) -> DataFrame:
    deep = table(spark, sf, "events").select("event_id", (F.col("event_id") % 4).cast("int").alias("depth_idx"), "value")
    return deep.where(F.col("depth_idx") == surface_level([5.0, -0.5, 0.5, 10.0])).select("event_id", "value")


# step 6: unions


def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return stratify.union_by_name(table(spark, sf, "customer"), table(spark, sf, "supplier"))


def union_samples(spark: SparkSession, sf: str) -> DataFrame:
    v = stratify.first_per_stratum(table(spark, sf, "vessel_points").select("obs_id", "chunk_id", "lat", "lon"), F.col("chunk_id"), [F.col("obs_id")], 1000)
    f = stratify.first_per_stratum(table(spark, sf, "fleet_daily"), F.col("flag"), [F.col("fleet_id")], 1000).select("fleet_id", "flag", F.col("cell_ll_lat").alias("lat"), F.col("cell_ll_lon").alias("lon"))
    return C.tell_nan(stratify.union_by_name(v, f))


# step 7: geo functions


def lon_normalize(spark: SparkSession, sf: str) -> DataFrame:
    p = event_points(spark, sf)
    return p.select("event_id", geo.normalize_lon(F.col("lon"), -180.0, 179.0).alias("half"), geo.normalize_lon(F.col("lon") - 180, 0.0, 359.0).alias("whole"))


def tile_geodetic(spark: SparkSession, sf: str) -> DataFrame:
    p = event_points(spark, sf)
    col, row = geo.geodetic_tile(geo.normalize_lon(F.col("lon"), -180, 179), F.col("lat"), 6)
    return p.select("event_id", col.alias("tilecol"), row.alias("tilerow"))


def pixel_in_tile(spark: SparkSession, sf: str) -> DataFrame:
    p = event_points(spark, sf)
    i, j = geo.geodetic_pixel(geo.normalize_lon(F.col("lon"), -180, 179), F.col("lat"), 6)
    return p.select("event_id", i.alias("i"), j.alias("j"))


def tile_mercator(spark: SparkSession, sf: str) -> DataFrame:
    p = event_points(spark, sf)
    x, y = geo.mercator_tile(F.col("lat"), geo.normalize_lon(F.col("lon"), -180, 179), 4)
    return p.select("event_id", x.alias("x"), y.alias("y"))


# step 8: text functions


def json_first_number(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", text.json_first_number(F.col("props")).alias("number"))


def json_first_number_or_flag(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.lit('{"a":"9","b":'), F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, "null").otherwise("false"), F.lit(',"c":'), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", text.json_first_number_or_flag(made).alias("number"))


def text_first_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.text_first_number(F.col("text")).alias("number"))


# The example server and layer.
BASE, LAYER = "https://tiles.example.invalid/wmts", "SST/daily/thetao"


def feature_url(spark: SparkSession, sf: str) -> DataFrame:
    p = event_points(spark, sf)
    x = geo.normalize_lon(F.col("lon"), -180, 179)
    col, row = geo.geodetic_tile(x, F.col("lat"), 6)
    i, j = geo.geodetic_pixel(x, F.col("lat"), 6)
    base = F.when(F.col("event_id") % 3 == 0, BASE).when(F.col("event_id") % 3 == 1, BASE + "?").otherwise(BASE + "?key=1")
    return p.select("event_id", text.feature_url(base, LAYER, "EPSG:4326", F.lit(6), col, row, i, j, text.utc_time(F.col("timestamp"))).alias("url"))


def iso_time(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", text.utc_time(F.col("ts")).alias("utc"), text.plain_time(F.col("ts")).alias("plain"), F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("day"))


# The first sample point's latitude and longitude, and the day and time of all.
SAMPLE_LAT, SAMPLE_LON, SAMPLE_TIME = -10.0, 20.0, "-06-15T00:00:00Z"


def synthetic_points(spark: SparkSession, sf: str) -> DataFrame:
    """Three example points for each year that the orders cover."""
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    k = years.select("year", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return k.select("year", (F.lit(SAMPLE_LAT) + F.col("k")).alias("lat"), (F.lit(SAMPLE_LON) + F.col("k")).alias("lon"), F.concat(F.col("year").cast("string"), F.lit(SAMPLE_TIME)).alias("time"))


def year_from_name(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("combined_"), F.year("o_orderdate").cast("string"), F.lit(".csv"))
    return table(spark, sf, "orders").select("o_orderkey", text.year_in_name(name).alias("year"), text.last_part(F.lit("chunk_missing_17")).alias("part"))


def request_parameters(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "pilot_results")
    return d.select("request_id", text.encoded_parameters({"LAYER": F.lit(LAYER), "TIME": F.coalesce("time", F.lit(""))}).alias("query"))


# step 9: samples


def sample_per_year(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vessel_points").select("obs_id", F.year("timestamp").alias("year"), "lat", "lon")
    return stratify.per_stratum(v, F.col("year"), F.col("obs_id"), 25)


def quota_missing(spark: SparkSession, sf: str) -> DataFrame:
    return fallback.missing_points(table(spark, sf, "vessel_points"), 100, 8).select("obs_id", "year", "lat", "lon")


def first_n_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return stratify.first_per_stratum(table(spark, sf, "documents").select("source", "doc_id", "lang"), F.col("source"), [F.col("doc_id")], 20)


# step 11: plan and pilot


def plan_simulate(spark: SparkSession, sf: str) -> DataFrame:
    """Sampled lookups per year with their addresses, as the plan lists them."""
    v = table(spark, sf, "vessel_points").where(C.usable_lat(F.col("lat"), F.col("lon")) & C.usable_lon(F.col("lat"), F.col("lon")))
    return fallback.plan_requests(v.where("timestamp is not null"), per_year=5, zoom=6, base=BASE, layer=LAYER)


def pilot_report(spark: SparkSession, sf: str) -> DataFrame:
    r = quality.pilot_report(table(spark, sf, "pilot_results"))
    return r.withColumns({c: F.round(c, 6) for c in ("fill_rate", "latency_p50", "latency_p90")})


# step 10: sources; each query writes its input in the shared folder first


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    path = fresh_path(spark, name)
    files, at = located(path)
    files.create_dir(at, recursive=True)
    return path


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def _zipped(df: DataFrame, folder: str, parts: int) -> list[str]:
    """Write df, all texts, as CSV members of ZIP archives, one archive for each of so many tasks; null is written as nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = located(folder)
        name = f"{at}/fleet-{TaskContext.get().partitionId()}.zip"
        with files.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, b in enumerate(batches):
                z.writestr(f"d/part-{k}.CSV", b.to_pandas().to_csv(index=False))
            z.writestr("readme.txt", "no table")
        yield pa.RecordBatch.from_arrays([pa.array([folder.rstrip("/") + "/" + name.rsplit("/", 1)[1]])], names=["path"])

    return sorted(r["path"] for r in df.repartition(parts, *df.columns).mapInArrow(run, "path string").collect())


def zip_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables with different columns as members of several archives, read back united."""
    folder = _folder(spark, "zip")
    fleet = table(spark, sf, "fleet_daily").select("fleet_id", "date", "flag", "geartype", "mmsi_present")
    paths = _zipped(_text(fleet), folder, 4) + _zipped(_text(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")), _folder(spark, "zip"), 3)
    return csv_union.read_sources(spark, [Source("zip", p) for p in paths])


def mixed_header_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    for t in ("customer", "supplier"):
        table(spark, sf, t).write.csv(f"{path}/{t}", header=True)
    return csv_union.read_csv_files(spark, [p for p in list_files(spark, path) if p.endswith(".csv")])


def _example_grid(spark: SparkSession, levels: int = 0) -> str:
    """The example grid as a NetCDF file; with levels, values rise by 100 from level to level, and the second one is at the surface."""
    v = np.array([[[((t * 1000 + j * 37 + i * 3) % 301) / 10 if (t * 7 + j * 3 + i * 5) % 11 else -999.0 for i in range(36)] for j in range(18)] for t in range(6)])
    path = _folder(spark, "grid") + "/grid.nc"
    dims = {"time": 6, **({"depth": levels} if levels else {}), "lat": 18, "lon": 36}
    if levels:
        v = np.stack([np.where(v == -999, v, v + 100 * k) for k in range(levels)], axis=1)
    extra = {"depth": (("depth",), np.array([5.0, 0.5, 10.0, 20.0][:levels]), {})} if levels else {}
    write_netcdf(path, dims, {"time": (("time",), np.arange(6) * 6.0, {"units": "days since 2024-01-01"}), **extra, "lat": (("lat",), np.array(LATS), {}), "lon": (("lon",), np.array(LONS), {}), "thetao": (tuple(dims), v, {"_FillValue": np.float64(-999)})}, "time")
    return path


def grid_source_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The example grid as a NetCDF file, read back by the data source."""
    return read_grid(spark, [_example_grid(spark)]).select("ti", "t", "j", "i", "lat", "lon", "v")


def grid_source_window(spark: SparkSession, sf: str) -> DataFrame:
    """A box of the level next to the surface, and one of a fixed level."""
    path = _example_grid(spark, 3)
    surface = read_grid(spark, [path], bbox=(-20, 35, -60, 40)).withColumn("level", F.lit("surface"))
    fixed = read_grid(spark, [path], depth_index=2, bbox=(-20, 35, -60, 40)).withColumn("level", F.lit("third"))
    return surface.unionByName(fixed).select("level", "ti", "j", "i", "lat", "lon", "v")


def zarr_source_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The example grid as a Zarr v2 store with compressed chunks, read back in a box."""
    folder = _folder(spark, "grid") + "/grid.zarr"
    files, at = located(folder)
    source = open_store(_example_grid(spark))

    def put(name: str, data: bytes) -> None:
        with files.open_output_stream(f"{at}/{name}") as f:
            f.write(data)

    for name, dims, chunks in (("time", ["time"], [6]), ("lat", ["lat"], [18]), ("lon", ["lon"], [36]), ("thetao", ["time", "lat", "lon"], [2, 7, 10])):
        a = np.ascontiguousarray(source.read(name)).astype("<f8")
        files.create_dir(f"{at}/{name}", recursive=True)
        attrs = {"_ARRAY_DIMENSIONS": dims, **({"units": "days since 2024-01-01"} if name == "time" else {"_FillValue": -999.0} if name == "thetao" else {})}
        put(f"{name}/.zattrs", json.dumps(attrs).encode())
        put(f"{name}/.zarray", json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": chunks, "dtype": "<f8", "compressor": {"id": "zlib", "level": 1}, "fill_value": "NaN", "order": "C", "filters": None}).encode())
        for idx in np.ndindex(*[-(-s // c) for s, c in zip(a.shape, chunks)]):
            block = np.zeros(chunks)
            part = a[tuple(slice(k * c, (k + 1) * c) for k, c in zip(idx, chunks))]
            block[tuple(slice(0, s) for s in part.shape)] = part
            put(f"{name}/" + ".".join(map(str, idx)), zlib.compress(block.tobytes()))
    return read_grid(spark, [folder], bbox=(-20, 35, -60, 40)).select("ti", "t", "j", "i", "lat", "lon", "v")


def pilot_run(spark: SparkSession, sf: str) -> DataFrame:
    """The plan's requests answered by a deterministic stand-in for the server."""

    def fetch(url: str) -> tuple[int, str]:
        col, row = (int(url.split(f"{k}=")[1].split("&")[0]) for k in ("TILECOL", "TILEROW"))
        return (503, "503 busy") if row % 4 == 0 else (200, '{"ok": true, "value": "%d", "sst": [%d.5]}' % (row, col))

    done = fallback.run_pilot(plan_simulate(spark, sf), fetch, rate=0)
    return done.select("obs_id", "sst_wmts", "status", "attempts", "error")


# step 12: beyond parity


def graph_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Vessels and observations per six hours."""
    v = table(spark, sf, "vessel_points").where("timestamp is not null").select(F.window(F.col("timestamp").cast("timestamp"), "6 hours").start.cast("timestamp_ntz").alias("snapshot"), C.vessel_key(F.col("MMSI")).alias("vessel"))
    return v.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("vessel").alias("n_vessels"))


def node_features(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vessel_points").where(C.usable_value(F.col("sst"), F.col("sst_missing")) & C.vessel_key(F.col("MMSI")).isNotNull())
    g = v.groupBy(C.vessel_key(F.col("MMSI")).alias("vessel")).agg(F.count(F.lit(1)).alias("n"), F.avg("sst").alias("mean_sst"), F.stddev("sst").alias("sd_sst"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return g.withColumns({"mean_sst": F.round("mean_sst", 6), "sd_sst": F.round("sd_sst", 6)})


LON_HALF = "case when lon > 180 then lon - 360 else lon end"
TILES = f"with {EVENTS_SQL}, t as (select *, {LON_HALF} as x, (({LON_HALF}) + 180e0) / (360e0 / 128) as fx, (90e0 - lat) / (180e0 / 64) as fy from p0), u as (select *, least(greatest(cast(floor(fx) as int), 0), 127) as tilecol, least(greatest(cast(floor(fy) as int), 0), 63) as tilerow from t), w as (select *, least(greatest(cast(round_even((fx - tilecol) * 255, 0) as int), 0), 255) as i, least(greatest(cast(round_even((fy - tilerow) * 255, 0) as int), 0), 255) as j from u)"
SST_NULL = "(sst is null or isnan(sst))"
NO_SST = "not coalesce(sst between -2.5e0 and 40e0 and not isnan(sst), false)"
FLAG = f"(coalesce(sst_missing, {NO_SST}) or {NO_SST})"
MD5 = "md5(cast({0} as varchar)), cast({0} as varchar)"
URL_SQL = f"""concat(case when {{k}} % 3 = 0 then '{BASE}?' when {{k}} % 3 = 1 then '{BASE}?' else '{BASE}?key=1&' end, 'SERVICE=WMTS&REQUEST=GetFeatureInfo&VERSION=1.0.0&LAYER={LAYER}&STYLE=&TILEMATRIXSET=EPSG:4326&TILEMATRIX=6&TILEROW=', tilerow, '&TILECOL=', tilecol, '&I=', i, '&J=', j, '&INFOFORMAT=application/json&FORMAT=image/png&TIME=', strftime({{t}}, '%Y-%m-%dT%H:%M:%SZ'))"""
LAT_OK = "coalesce(lat between -90 and 90 and not isnan(lat), false) and not coalesce(lat = 0 and lon = 0, false)"
LON_OK = "coalesce(lon between -180 and 360 and not isnan(lon), false) and not coalesce(lat = 0 and lon = 0, false)"

SQL = {
    "grid_lookup": lookup_sql(f"""event_id, "MMSI", "timestamp", lat, lon, coalesce(made, near) as sst, coalesce(made, near) is null as sst_missing,
        case when made is not null then 'interp' when near is not null then 'nearest' else 'missing' end as sst_source, {TOLERANCE} as time_tolerance_days"""),
    "nearest_time": f"with {EVENTS_SQL}, {TIME_SQL} select event_id, ti, case when ti is not null then delta end as delta_us from p4",
    "nearest_time_tie": "select o_orderkey, o_orderkey % 5 as ti from orders",
    "bilinear_only": lookup_sql("event_id, made as sst, made is null as sst_missing"),
    "nearest_cell": lookup_sql("event_id, near as sst, near is null as sst_missing"),
    "lookup_extrapolate": f"with {EVENTS_SQL}, {GRID_SQL}, p4 as (select *, 0 as ti from p0), {place_sql('p4')}, r as ({corners_sql('q', 'g', 'ti')}) select event_id, {BILINEAR} as sst, {BILINEAR} is null as sst_missing from r",
    "lookup_time_linear": f"""with {EVENTS_SQL}, {GRID_SQL},
        p4 as (select *, least(greatest(cast(floor((epoch_us("timestamp") - {T0}) / {STEP}e0) as bigint), 0), 4) as t0 from p0),
        p5 as (select *, t0 + 1 as t1, least(greatest((epoch_us("timestamp") - ({T0} + t0 * {STEP})) / {STEP}e0, 0e0), 1e0) as share from p4), {place_sql('p5')},
        a as (select event_id, {INTERP} as b0, near as c0 from ({corners_sql('q', 'g', 'ti', 't0')})),
        b as (select event_id, {INTERP} as b1, near as c1 from ({corners_sql('q', 'g', 'ti', 't1')})),
        s as (select q.event_id, coalesce(b0 * (1e0 - share) + b1 * share, case when share > 0.5 then c1 else c0 end) as sst from q join a using (event_id) join b using (event_id))
        select event_id, sst, sst is null as sst_missing from s""",
    "lookup_missing_year_left": period_sql(ORDERS_SQL, "p0", "year", 1995, 4, 1, "o_orderkey, year"),
    "lookup_year_inner": period_sql(ORDERS_SQL, "p0", "year", 1995, 4, 1, "o_orderkey, year", "join"),
    "lookup_by_day": period_sql(EVENTS_SQL + ', pd as (select *, cast(day("timestamp") as int) as day from p0)', "pd", "day", 2, 15, 2, "event_id, day"),
    "provider_coalesce": lookup_sql("""event_id, coalesce(case when event_id % 5 = 0 then cast(event_id % 30 as double) end, made, near, case when event_id % 3 = 0 then cast(event_id % 25 as double) end) as sst,
        event_id % 5 <> 0 and coalesce(made, near) is null and event_id % 3 <> 0 as sst_missing,
        case when event_id % 5 = 0 then 'library' when coalesce(made, near) is not null then 'local' when event_id % 3 = 0 then 'http' end as sst_provider"""),
    "qc_by_year": f"""select cast(year("timestamp") as int) as year, count(*) as total, count(*) filter ({FLAG}) as missing, count(*) filter (not {FLAG}) as present,
        min(sst) filter (not {FLAG}) as min_sst, max(sst) filter (not {FLAG}) as max_sst, round(avg(sst) filter (not {FLAG}), 6) as mean_sst from vessel_points group by 1""",
    "qc_quantiles": f"""select cast(year("timestamp") as int) as year, round(quantile_cont(sst, 0.5) filter (not {FLAG}), 6) as median_sst, round(quantile_cont(sst, 0.99) filter (not {FLAG}), 6) as p99_sst from vessel_points group by 1""",
    "qc_overall_rollup": f"""with v as (select cast(year("timestamp") as int) as year, {FLAG} as f from vessel_points)
        select year, grouping(year) = 1 as is_total, count(*) as total, count(*) filter (f) as missing, count(*) filter (not f) as present from v group by rollup (year)""",
    "qc_lookup": lookup_sql("case when made is not null then 'interp' when near is not null then 'nearest' else 'missing' end as sst_source, count(*) as n, min(coalesce(made, near)) as min_sst, max(coalesce(made, near)) as max_sst", "group by 1"),
    "qc_report": f"""with v as (select cast(year("timestamp") as int) as year, count(*) as total, count(*) filter ({FLAG}) as missing, count(*) filter (not {FLAG}) as present, min(sst) filter (not {FLAG}) as lo, avg(sst) filter (not {FLAG}) as mean from vessel_points where "timestamp" is not null group by 1)
        select year, concat('Year ', year, ': total=', format('{{:,}}', total), ' missing=', format('{{:,}}', missing), ' present=', format('{{:,}}', present), ' min=', coalesce(printf('%.3f', lo), 'n/a'), ' mean=', coalesce(printf('%.3f', mean), 'n/a')) as line from v""",
    "coerce_and_drop": f"""with {ORDERS_SQL} select cast(o_orderkey as varchar) as "MMSI", "timestamp", lat, lon from p0 where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 17 <> 0""",
    "split_year_counts": "select cast(year(l_shipdate) as int) as year, count(*) as n from lineitem group by 1",
    "distinct_years": """select distinct cast(year("timestamp") as int) as year from vessel_points where "timestamp" is not null""",
    "year_filter": "select l_orderkey, l_linenumber, cast(year(l_shipdate) as int) as year from lineitem where year(l_shipdate) in (1996, 1998)",
    "bbox_filter": "select obs_id, lat, lon from vessel_points where lat between -20 and 35 and lon between -60 and 40 and not isnan(lat) and not isnan(lon)",
    "depth_surface": "select event_id, value from events where event_id % 4 = 1",
    "union_by_name": "select * from customer union all by name select * from supplier",
    "union_samples": """with u as (select obs_id, chunk_id, lat, lon, null as fleet_id, null as flag from (select *, row_number() over (partition by chunk_id order by obs_id) as rn from vessel_points) where rn <= 1000
        union all select null, null, cell_ll_lat, cell_ll_lon, fleet_id, flag from (select *, row_number() over (partition by flag order by fleet_id) as rn from fleet_daily) where rn <= 1000)
        select * replace (case when not isnan(lat) then lat end as lat, case when not isnan(lon) then lon end as lon), coalesce(isnan(lat), false) as lat_is_nan, coalesce(isnan(lon), false) as lon_is_nan from u""",
    "lon_normalize": f"with {EVENTS_SQL} select event_id, {LON_HALF} as half, case when lon - 180 < 0 then lon - 180 + 360 else lon - 180 end as whole from p0",
    "tile_geodetic": f"{TILES} select event_id, tilecol, tilerow from w",
    "pixel_in_tile": f"{TILES} select event_id, i, j from w",
    "tile_mercator": f"""with {EVENTS_SQL}, m as (select *, {LON_HALF} as x0 from p0) select event_id,
        case when lat between -85.0511287798066e0 and 85.0511287798066e0 then cast(trunc((x0 + 180e0) / 360e0 * 16e0) as int) end as x,
        case when lat between -85.0511287798066e0 and 85.0511287798066e0 then cast(trunc((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * 16e0) as int) end as y from m""",
    "json_first_number": "select event_id, try_cast(json_extract_string(props, '$.k') as double) as number from events",
    "json_first_number_or_flag": "select event_id, case event_id % 3 when 0 then 1e0 when 1 then cast(event_id as double) else 0e0 end as number from events",
    "text_first_number": "select doc_id, try_cast(regexp_extract(text, '[-+]?[0-9]*[.]?[0-9]+') as double) as number from documents",
    "feature_url": f"""{TILES} select event_id, {URL_SQL.format(k="event_id", t='"timestamp"')} as url from w""",
    "iso_time": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as utc, case when epoch_us(ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end as plain, cast(date_trunc('day', ts) as timestamp) as day from events",
    "synthetic_points": "select y.year, -10e0 + k.range as lat, 20e0 + k.range as lon, concat(y.year, '-06-15T00:00:00Z') as time from (select distinct cast(year(o_orderdate) as int) as year from orders) y, range(3) k",
    "year_from_name": "select o_orderkey, cast(year(o_orderdate) as int) as year, '17' as part from orders",
    "request_parameters": "select request_id, concat('LAYER=', url_encode('SST/daily/thetao'), '&TIME=', url_encode(coalesce(time, ''))) as query from pilot_results",
    "sample_per_year": f"""select obs_id, year, lat, lon from (select obs_id, cast(year("timestamp") as int) as year, lat, lon, row_number() over (partition by year("timestamp") order by {MD5.format('obs_id')}) as rn from vessel_points) where rn <= 25""",
    "quota_missing": f"""select obs_id, year, lat, lon from (select obs_id, cast(year("timestamp") as int) as year, lat, lon, row_number() over (partition by year("timestamp") order by {MD5.format('obs_id')}) as rn from vessel_points where {SST_NULL} and "timestamp" is not null) where rn <= 12""",
    "first_n_per_source": "select source, doc_id, lang from (select *, row_number() over (partition by source order by doc_id) as rn from documents) where rn <= 20",
    "plan_simulate": f"""with v as (select obs_id, cast(year("timestamp") as int) as year, "timestamp" as ts, lat, case when lon > 180 then lon - 360 else lon end as x, lon,
            row_number() over (partition by year("timestamp") order by {MD5.format('obs_id')}) as rn from vessel_points where {LAT_OK} and {LON_OK} and "timestamp" is not null),
        t as (select *, (x + 180e0) / (360e0 / 128) as fx, (90e0 - lat) / (180e0 / 64) as fy from v where rn <= 5),
        u as (select *, least(greatest(cast(floor(fx) as int), 0), 127) as tilecol, least(greatest(cast(floor(fy) as int), 0), 63) as tilerow from t),
        w as (select *, least(greatest(cast(round_even((fx - tilecol) * 255, 0) as int), 0), 255) as i, least(greatest(cast(round_even((fy - tilerow) * 255, 0) as int), 0), 255) as j from u)
        select obs_id, year, lat, lon, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as time, tilecol, tilerow, i, j, {URL_SQL.format(k='0', t='ts')} as url from w""",
    "pilot_report": """with r as (select year, latency_ms, coalesce(status between 200 and 299, false) as ok, sst_wmts is not null and not isnan(sst_wmts) as has from pilot_results)
        select year, count(*) as rows_requested, count(*) filter (ok and has) as rows_filled, round(avg(case when ok and has then 1e0 else 0e0 end), 6) as fill_rate,
          round(quantile_cont(cast(latency_ms as double), 0.5), 6) as latency_p50, round(quantile_cont(cast(latency_ms as double), 0.9), 6) as latency_p90, count(*) filter (not ok) as n_errors from r group by year""",
    "graph_snapshots": """select time_bucket(interval 6 hours, "timestamp", timestamp '1970-01-01') as snapshot, count(*) as n_rows,
        count(distinct case when trim(MMSI) <> '' then regexp_replace(trim(MMSI), '[.]0$', '') end) as n_vessels from vessel_points where "timestamp" is not null group by 1""",
    "node_features": """select regexp_replace(trim(MMSI), '[.]0$', '') as vessel, count(*) as n, round(avg(sst), 6) as mean_sst, round(stddev(sst), 6) as sd_sst, min("timestamp") as first_seen, max("timestamp") as last_seen
        from vessel_points where trim(coalesce(MMSI, '')) <> '' and sst between -2.5e0 and 40e0 and not isnan(sst) and not coalesce(sst_missing, false) group by 1""",
}
SQL["grid_lookup_tiled"] = SQL["grid_lookup"]
SQL["zip_csv_scan"] = """select cast(fleet_id as varchar) as fleet_id, coalesce(cast("date" as varchar), '') as date, coalesce(flag, '') as flag, coalesce(geartype, '') as geartype, coalesce(cast(mmsi_present as varchar), '') as mmsi_present,
    null as o_orderkey, null as o_orderstatus from fleet_daily union all select null, null, null, null, null, cast(o_orderkey as varchar), o_orderstatus from orders"""
SQL["mixed_header_scan"] = """select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey, cast(c_acctbal as varchar) as c_acctbal, c_mktsegment,
    cast(s_suppkey as varchar) as s_suppkey, s_name, cast(s_nationkey as varchar) as s_nationkey, cast(s_acctbal as varchar) as s_acctbal from (select * from customer union all by name select * from supplier)"""
SQL["grid_source_scan"] = f"""with {GRID_SQL} select cast(ti as int) as ti, timestamp '2024-01-01' + to_days(cast(ti * 6 as int)) as t, cast(j as int) as j, cast(i as int) as i, -85e0 + j * 10e0 as lat, -180e0 + i * 10e0 as lon, v from g"""
BOX = "-85e0 + j * 10e0 between -20 and 35 and -180e0 + i * 10e0 between -60 and 40"
SQL["grid_source_window"] = f"""with {GRID_SQL} select level, cast(ti as int) as ti, cast(j as int) as j, cast(i as int) as i, -85e0 + j * 10e0 as lat, -180e0 + i * 10e0 as lon, v + up as v
    from g, (values ('surface', 100e0), ('third', 200e0)) x(level, up) where {BOX}"""
SQL["zarr_source_scan"] = SQL["grid_source_scan"] + f" where {BOX}"
SQL["pilot_run"] = f"""with p as ({SQL["plan_simulate"]}) select obs_id, case when tilerow % 4 <> 0 then tilecol + 0.5e0 end as sst_wmts, case when tilerow % 4 = 0 then 503 else 200 end as status, 1 as attempts, null as error from p"""

QUERIES = {
    f.__name__: f
    for f in (
        grid_lookup, grid_lookup_tiled, nearest_time, nearest_time_tie, bilinear_only, nearest_cell, lookup_extrapolate, lookup_time_linear,
        lookup_missing_year_left, lookup_year_inner, lookup_by_day, provider_coalesce,
        qc_by_year, qc_quantiles, qc_overall_rollup, qc_lookup, qc_report,
        coerce_and_drop, split_year_counts, distinct_years, year_filter, bbox_filter, depth_surface,
        union_by_name, union_samples, lon_normalize, tile_geodetic, pixel_in_tile, tile_mercator,
        json_first_number, json_first_number_or_flag, text_first_number, feature_url, iso_time, synthetic_points, year_from_name, request_parameters,
        sample_per_year, quota_missing, first_n_per_source, plan_simulate, pilot_report, graph_snapshots, node_features,
        zip_csv_scan, mixed_header_scan, grid_source_scan, grid_source_window, zarr_source_scan, pilot_run,
    )
}
