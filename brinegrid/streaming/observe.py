"""Streams of observations: the same operators on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lookup, records


def read_points(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files in a folder, a bounded number per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def enrich(points: DataFrame, grid: lookup.Grid, tolerance_days: int = 31) -> DataFrame:
    """The lookup on a stream: stateless, against a static grid."""
    return lookup.lookup(points, grid, tolerance_days)


def split_valid(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed rows and failures of a stream of raw records."""
    parsed = records.parse_records(lines)
    return records.valid_records(parsed), records.failed_records(parsed)


def without_redeliveries(points: DataFrame, keys: list[str], time: str = "timestamp", delay: str = "40 days") -> DataFrame:
    """Rows once per key; state is kept as long as late deliveries are expected."""
    return points.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_quality(points: DataFrame, time: str = "timestamp", width: str = "6 hours", delay: str = "40 days") -> DataFrame:
    """Rows, missing and mean per window, final once the watermark has passed."""
    p = points.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    ok = F.col("sst").isNotNull() & ~F.isnan("sst")
    return p.groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("missing"), F.avg(F.when(ok, F.col("sst"))).alias("mean_sst"))


def append_parquet(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Exactly-once files; with once, all that is there now, then stop."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
