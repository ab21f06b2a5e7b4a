"""Quality statistics of an enriched table, per year and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import columns as C
from ..functions.text import fixed, thousands


def _stats(value: Column, flag: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(flag).alias("missing"),
        F.count_if(~flag).alias("present"),
        F.min(F.when(~flag, value)).alias("min_sst"),
        F.max(F.when(~flag, value)).alias("max_sst"),
        F.avg(F.when(~flag, value)).alias("mean_sst"),
    ]


def missing_flag(df: DataFrame, value: str = "sst", flag: str = "sst_missing") -> Column:
    """The flag, or where it is null or absent, whether the value is null or NaN."""
    v = C.quoted(value)
    own = v.isNull() | F.isnan(v)
    return F.coalesce(C.quoted(flag), own) | own if flag in df.columns else own


def exact_quantiles(df: DataFrame, by: Column, value: Column, qs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(year, one column per quantile): exact, with linear interpolation between neighbours, over non-null values.

    The built-in exact percentile holds all distinct values of a group in one task's memory. Here approximate quantiles
    give a bracket of a few ten-thousandths of a group around each quantile; what lies below is only counted, before the
    shuffle, and only the values within the bracket are sorted. Groups without values don't come out; a null group does.
    """
    d = df.select(by.alias("year"), value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    ends = [x for q in qs.values() for x in (max(0.0, q - 3 / accuracy), min(1.0, q + 3 / accuracy))]
    brackets = d.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", F.array(*[F.lit(x) for x in ends]), accuracy).alias("b")).withColumnRenamed("year", "g")
    few = F.col("n") <= accuracy  # neighbours in rank can lie outside such a bracket: all values are sorted
    low = lambda k: F.when(few, float("-inf")).otherwise(F.col("b")[2 * k])
    high = lambda k: F.when(few, float("inf")).otherwise(F.col("b")[2 * k + 1])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), low(k).alias("low"), high(k).alias("high"), (F.lit(q) * (F.col("n") - 1)).alias("h")) for k, q in enumerate(qs.values())]))
    x = d.join(brackets, F.col("year").eqNullSafe(F.col("g"))).select("year", "v", each.alias("e")).where("v <= e.high")
    counts = x.groupBy("year", "e.k", "e.h", F.when(F.col("v") >= F.col("e.low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("year", "k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("z", upto).withColumn("a", F.col("z") - F.col("c"))
    at = lambda r: F.max(F.when((F.col("a") <= r) & (r < F.col("z")), F.col("v")))
    share = F.col("h") - F.floor("h")
    got = ranked.groupBy("year", "k", "h").agg(at(F.floor("h")).alias("v0"), at(F.ceil("h")).alias("v1"))
    got = got.withColumn("x", F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise(F.col("v0") * (1 - share) + F.col("v1") * share))
    return got.groupBy("year").agg(*[F.max(F.when(F.col("k") == k, F.col("x"))).alias(n) for k, n in enumerate(qs)])


def by_year(df: DataFrame, year: Column, value: str = "sst", flag: str = "sst_missing", quantiles: dict[str, float] | None = None) -> DataFrame:
    """Per year: total, missing, present, min, max, mean, and exact quantiles (linear interpolation) of the present values."""
    v, f = C.quoted(value), missing_flag(df, value, flag)
    qs = quantiles if quantiles is not None else {"median_sst": 0.5, "p99_sst": 0.99}
    stats = df.groupBy(year.alias("year")).agg(*_stats(v, f))
    if not qs:
        return stats
    exact = exact_quantiles(df, year, F.when(~f, v), qs).withColumnRenamed("year", "_year")
    return stats.join(exact, F.col("year").eqNullSafe(F.col("_year")), "left").drop("_year")


def with_total(df: DataFrame, year: Column, value: str = "sst", flag: str = "sst_missing") -> DataFrame:
    """Per year and, with a null year and is_total, overall: rows, missing, present."""
    f = missing_flag(df, value, flag)
    d = df.select(year.alias("year"), f.alias("_f"))
    return d.rollup("year").agg(F.grouping("year").cast("boolean").alias("is_total"), F.count(F.lit(1)).alias("total"), F.count_if("_f").alias("missing"), F.count_if(~F.col("_f")).alias("present"))


def files_by_year(df: DataFrame, year: Column) -> DataFrame:
    """How many files hold rows of each year; df must come straight from a file source."""
    return df.groupBy(year.alias("year")).agg(F.count_distinct(F.col("_metadata.file_path")).alias("n_files"))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and an observation that holds rows and missing values once an action on it has run: progress without a second pass.

    A stage that is run again after a loss counts again, so these are for progress, not for checks.
    """
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), F.count_if(missing_flag(df)).alias("missing")), o


def report_lines(stats: DataFrame) -> DataFrame:
    """One line of text per row of by_year: thousands separators, three decimals."""
    text = F.concat(
        F.lit("Year "), F.col("year").cast("string"), F.lit(": total="), thousands(F.col("total")), F.lit(" missing="), thousands(F.col("missing")), F.lit(" present="), thousands(F.col("present")),
        F.lit(" min="), F.coalesce(fixed(F.col("min_sst")), F.lit("n/a")), F.lit(" mean="), F.coalesce(fixed(F.col("mean_sst")), F.lit("n/a")),
    )
    return stats.select("year", text.alias("line"))


def pilot_report(results: DataFrame, year: str = "year", value: str = "sst_wmts", status: str = "status", latency: str = "latency_ms") -> DataFrame:
    """Per year: requested, filled, fill rate, latency p50 and p90, and the number of errors (status not 2xx or null)."""
    ok = C.quoted(status).between(200, 299)
    filled = C.nan_to_null(C.quoted(value)).isNotNull() & F.coalesce(ok, F.lit(False))
    return results.groupBy(C.quoted(year).alias("year")).agg(
        F.count(F.lit(1)).alias("rows_requested"),
        F.count_if(filled).alias("rows_filled"),
        F.avg(filled.cast("double")).alias("fill_rate"),
        F.percentile(C.quoted(latency), 0.5).alias("latency_p50"),
        F.percentile(C.quoted(latency), 0.9).alias("latency_p90"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_errors"),
    )
