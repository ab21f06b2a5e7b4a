"""Finding input files by name. Listings are driver-side, through the file system the path belongs to."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed value: how archives and folders of the fleet data are named.
FLEET_PREFIX = "fleet-daily-csvs-100-v3-"


@dataclass(frozen=True)
class Source:
    """kind is `file` or `zip`."""

    kind: str
    path: str


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> list[str]:
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    it, out = fs.listFiles(base, recursive), []
    while it.hasNext():
        out.append(it.next().getPath().toString())
    return sorted(out)


def expand_years(years: Iterable[int | str] | str | None) -> list[str]:
    """`2012,2015`, `2012-2015`, or a list of either, as single years. Blanks are dropped."""
    if years is None:
        return []
    parts = years.split(",") if isinstance(years, str) else [str(y) for y in years]
    out: list[str] = []
    for p in (x.strip() for x in parts):
        span = re.fullmatch(r"(\d{4})\s*-\s*(\d{4})", p)
        out += [str(y) for y in range(int(span[1]), int(span[2]) + 1)] if span else [p] if p else []
    return list(dict.fromkeys(out))


def discover_sources(spark: SparkSession, root: str, years=None, prefix: str = FLEET_PREFIX, loose: bool = False, exclude: Iterable[str] = ()) -> list[Source]:
    """ZIPs and folders of CSV files under root whose name starts with prefix and holds one of the years; ZIPs first, sorted.

    loose adds CSV files lying directly in root. exclude names outputs of earlier runs, which are never inputs.
    """
    wanted, skip = expand_years(years), {e.rstrip("/").rsplit("/", 1)[-1] for e in exclude}
    zips, files = [], []
    clean = root.rstrip("/")
    for path in list_files(spark, root):
        plain = re.sub(r"^file:/+", "/", path)
        rest = plain[len(re.sub(r"^file:/+", "/", clean)) :].strip("/").split("/")
        top, name = rest[0], rest[-1]
        if name in skip or top in skip:
            continue
        if top.startswith(prefix) and (not wanted or any(y in top for y in wanted)):
            if len(rest) == 1 and top.lower().endswith(".zip"):
                zips.append(Source("zip", path))
            elif len(rest) > 1 and name.lower().endswith(".csv"):
                files.append(Source("file", path))
        elif loose and len(rest) == 1 and name.lower().endswith(".csv"):
            files.append(Source("file", path))
    return zips + files


def sources_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The dry run: what would be read."""
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("path", T.StringType())])
    return spark.createDataFrame([(s.kind, s.path) for s in sources], schema)


def years_of_files(paths: Iterable[str], pattern: str = r"combined_(\d+)\.csv$", default: Iterable[int] = range(2012, 2020)) -> list[int]:
    """Years in file names, sorted; the default where no name has one."""
    found = sorted({int(m[1]) for p in paths if (m := re.search(pattern, p))})
    return found or list(default)


def grid_files_of_year(paths: Iterable[str], year: int, pattern: str = r"_mean_{year}\d*\.nc$") -> list[str]:
    return sorted(p for p in paths if re.search(pattern.format(year=year), p))


def daily_path(template: str, day) -> str:
    """A per-day store's address: {year}, {month} and {day} in the template, zero-padded."""
    return template.format(year=f"{day.year:04d}", month=f"{day.month:02d}", day=f"{day.day:02d}")
