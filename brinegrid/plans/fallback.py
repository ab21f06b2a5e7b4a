"""Planning and running remote lookups for values that are still missing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import stratify
from ..operators.quality import pilot_report


def plan_requests(points: DataFrame, per_year: int, zoom: int, base: str, layer: str, matrix_set: str = "EPSG:4326", key: str = "obs_id", time: str = "timestamp") -> DataFrame:
    """Up to per_year points of each year (in hash order), with tile, pixel and address."""
    p = points.select(key, F.year(time).alias("year"), F.col(time).alias("_t"), "lat", "lon")
    p = stratify.per_stratum(p, F.col("year"), F.col(key), per_year)
    x = geo.normalize_lon(F.col("lon"), -180.0, 179.0)
    col, row = geo.geodetic_tile(x, F.col("lat"), zoom)
    i, j = geo.geodetic_pixel(x, F.col("lat"), zoom)
    p = p.select(key, "year", "lat", "lon", text.utc_time(F.col("_t")).alias("time"), col.alias("tilecol"), row.alias("tilerow"), i.alias("i"), j.alias("j"))
    return p.withColumn("url", text.feature_url(base, layer, matrix_set, F.lit(zoom), F.col("tilecol"), F.col("tilerow"), F.col("i"), F.col("j"), F.col("time")))


def plan_document(plan: DataFrame, layer: str, zoom: int, sample_size: int, matrix_set: str = "EPSG:4326", generated_at: dt.datetime | None = None) -> DataFrame:
    """The plan as one JSON document. It lists the sampled points only, a bounded number."""
    # The keys of the document, here and in pilot_document.
    row = F.struct("lat", "lon", "time", "tilecol", "tilerow", "i", "j", "url")
    years = plan.groupBy(F.col("year").cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(row)).alias("examples"))
    entry = F.struct(F.col("n").alias("examples_count"), "examples")
    doc = years.agg(F.map_from_entries(F.collect_list(F.struct("y", entry))).alias("years"))
    when = F.lit(text_time(generated_at)) if generated_at else text.utc_time(F.current_timestamp())
    return doc.select(F.to_json(F.struct(F.lit(layer).alias("layer"), F.lit(matrix_set).alias("tilematrixset"), F.lit(zoom).alias("tilematrix_example"), "years", F.lit(sample_size).alias("sample_size_requested"), when.alias("generated_at")), {"pretty": "true"}).alias("plan"))


def text_time(t: dt.datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%SZ")


def missing_points(enriched: DataFrame, total: int, n_years: int, key: str = "obs_id", time: str = "timestamp") -> DataFrame:
    """A quota of rows without a value for each year."""
    gone = enriched.where((F.col("sst").isNull() | F.isnan("sst")) & F.col(time).isNotNull())
    return stratify.quota_per_stratum(gone.withColumn("year", F.year(time)), F.col("year"), F.col(key), total, n_years)


def run_pilot(plan: DataFrame, fetch, **options) -> DataFrame:
    """The plan's rows with sst_wmts, status, latency_ms, attempts and error; failed requests stay in."""
    from ..sources.http_lookup import fetch_rows

    return fetch_rows(plan, fetch, **options)


def pilot_document(results: DataFrame, generated_at: dt.datetime | None = None) -> DataFrame:
    r = pilot_report(results).select(F.col("year").cast("string").alias("y"), F.struct("rows_requested", "rows_filled").alias("s"), "rows_requested")
    when = F.lit(text_time(generated_at)) if generated_at else text.utc_time(F.current_timestamp())
    doc = r.agg(F.sum("rows_requested").alias("total_requested"), F.map_from_entries(F.collect_list(F.struct("y", "s"))).alias("per_year"))
    return doc.select(F.to_json(F.struct(when.alias("generated_at"), "total_requested", "per_year")).alias("report"))
