"""Command line: python -m brinegrid.cli JOB ... Exit codes: 1 input, 2 no provider."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import columns as C
from .plans import fallback, jobs
from .session import ship_package
from .sources import discover, http_lookup, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="brinegrid")
    sub = p.add_subparsers(dest="job", required=True)
    c = sub.add_parser("combine", help="CSV files and archives into one table")
    c.add_argument("root")
    c.add_argument("out")
    c.add_argument("--years", help="2012,2015 or 2012-2015")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    s = sub.add_parser("split", help="a CSV table into one folder per year")
    s.add_argument("table")
    s.add_argument("out")
    s.add_argument("--time")
    g = sub.add_parser("grid", help="NetCDF classic or Zarr v2 into the grid table")
    g.add_argument("paths", nargs="+")
    g.add_argument("--out", required=True)
    g.add_argument("--variable")
    g.add_argument("--depth-index", type=int)
    g.add_argument("--bbox", type=lambda x: tuple(json.loads(f"[{x}]")), help="lat0,lat1,lon0,lon1")
    e = sub.add_parser("extract", help="points looked up in the grid table")
    e.add_argument("points")
    e.add_argument("grid")
    e.add_argument("out")
    e.add_argument("--years")
    e.add_argument("--tolerance-days", type=int, default=31)
    e.add_argument("--skip-missing-years", action="store_true")
    e.add_argument("--sample", type=int, help="only the first rows")
    e.add_argument("--rows-per-file", type=int, default=0)
    for k in ("time", "lat", "lon", "vessel"):
        e.add_argument(f"--{k}")
    q = sub.add_parser("report", help="quality per year")
    q.add_argument("table")
    f = sub.add_parser("fallback", help="plan or run remote lookups")
    f.add_argument("table")
    f.add_argument("out")
    f.add_argument("--mode", choices=["simulate", "sample"], default="simulate")
    f.add_argument("--base", required=True)
    f.add_argument("--layer", required=True)
    f.add_argument("--zoom", type=int, default=4)
    f.add_argument("--sample-size", type=int, default=5)
    f.add_argument("--rate", type=float, default=3.0)
    f.add_argument("--workers", type=int, default=4)
    f.add_argument("--user-variable", default="")
    f.add_argument("--password-variable", default="")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("brinegrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    try:
        if a.job == "combine":
            done = jobs.combine(spark, a.root, a.out, a.years, a.overwrite, a.dry_run)
            if a.dry_run:
                done.show(200, False)
        elif a.job == "split":
            jobs.split_by_year(spark.read.csv(a.table, header=True), a.out, a.time).orderBy("year").show()
        elif a.job == "grid":
            jobs.build_grid(spark, a.paths, a.out, variable=a.variable, depth_index=a.depth_index, bbox=a.bbox)
        elif a.job == "extract":
            raw = spark.read.parquet(a.points) if a.points.endswith(".parquet") else spark.read.csv(a.points, header=True)
            points = C.canonical_points(raw.limit(a.sample) if a.sample else raw, a.time, a.lat, a.lon, a.vessel)
            years = [int(y) for y in discover.expand_years(a.years)] if a.years else None
            jobs.extract(points, spark.read.parquet(a.grid), a.out, years, a.tolerance_days, not a.skip_missing_years, max_rows=a.rows_per_file)
        elif a.job == "report":
            jobs.report(spark.read.parquet(a.table)).orderBy("year").show(100, False)
        else:
            table = spark.read.parquet(a.table)
            if "obs_id" not in table.columns:
                table = table.withColumn("obs_id", F.xxhash64(*[C.quoted(c) for c in table.columns]))
            if a.mode == "simulate":
                plan = fallback.plan_requests(table, a.sample_size, a.zoom, a.base, a.layer)
                sinks.write_document(fallback.plan_document(plan, a.layer, a.zoom, a.sample_size), a.out)
            else:
                n_years = table.select(F.year("timestamp")).distinct().count()
                plan = fallback.plan_requests(fallback.missing_points(table, a.sample_size, n_years), a.sample_size, a.zoom, a.base, a.layer)
                fetch = http_lookup.http_get(http_lookup.basic_auth(a.user_variable, a.password_variable))
                done = fallback.run_pilot(plan, fetch, rate=a.rate, workers=a.workers)
                sinks.write_by_year(done.withColumn("timestamp", F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))), a.out + "/pilot")
                sinks.write_document(fallback.pilot_document(done), a.out + "/report")
    except (jobs.InputMissing, jobs.NoProvider) as e:
        print(e, file=sys.stderr)
        return e.code
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
