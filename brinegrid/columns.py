"""Column resolution by candidate names, coercion, and missing-value rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Candidate names by role, in priority order.
TIME_NAMES = ("timestamp", "time", "datetime", "date")
LAT_NAMES = ("lat", "latitude", "cell_ll_lat")
LON_NAMES = ("lon", "longitude", "long", "cell_ll_lon")
ID_NAMES = ("mmsi", "mmsi_id", "mmsi_present")
GRID_VARIABLES = ("thetao", "sst", "tos")

ROLES = {"time": TIME_NAMES, "lat": LAT_NAMES, "lon": LON_NAMES, "id": ID_NAMES}


def free_name(taken: Iterable[str], name: str) -> str:
    """name, with underscores appended until it differs (ignoring case) from every taken one."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def resolve_column(columns: Sequence[str], candidates: Sequence[str], override: str | None = None, fallback: str | None = None) -> str | None:
    """The first candidate present, ignoring case. An override must exist. Of two columns that differ only by case, the later one counts."""
    if override is not None:
        if override in columns:
            return override
        low = {c.lower(): c for c in columns}
        if override.lower() in low:
            return low[override.lower()]
        raise ValueError(f"no column named {override!r} among {list(columns)}")
    low = {c.lower(): c for c in columns}
    for c in candidates:
        if c.lower() in low:
            return low[c.lower()]
    return fallback


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clean_floats(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column; applied once, at the source."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[nan_to_null(quoted(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else quoted(f.name) for f in df.schema])


def tell_nan(df: DataFrame, suffix: str = "_is_nan") -> DataFrame:
    """NaN becomes null in every floating column, with a column beside it that tells NaN from null (never null itself)."""
    out, taken = [], list(df.columns)
    for f in df.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            name = free_name(taken, f.name + suffix)
            taken.append(name)
            out += [nan_to_null(c).alias(f.name), F.coalesce(F.isnan(c), F.lit(False)).alias(name)]
        else:
            out.append(c)
    return df.select(*out)


def coerce_time(c: Column) -> Column:
    """Timestamp without zone; null where the text is no timestamp."""
    return c.try_cast("timestamp_ntz")


def coerce_number(c: Column) -> Column:
    """Double; null where it is no number, and for NaN."""
    return nan_to_null(c.try_cast("double"))


def in_years(time: Column, years: Iterable[int | str]) -> Column:
    """Whether a time lies in one of the years, as ranges of time, so that a scan can skip by it. Null times don't."""
    cond = F.lit(False)
    for y in map(int, years):
        start, end = (F.make_timestamp_ntz(F.lit(n), *[F.lit(k) for k in (1, 1, 0, 0, 0)]) for n in (y, y + 1))
        cond = cond | ((time >= start) & (time < end))
    return cond


def wall_micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone and its changes of clock."""
    t = c.cast("timestamp_ntz")
    seconds = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    return F.unix_date(t.cast("date")).cast("bigint") * 86_400_000_000 + F.hour(t).cast("bigint") * 3_600_000_000 + F.minute(t).cast("bigint") * 60_000_000 + seconds


def micros_of(df: DataFrame, name: str) -> Column:
    """wall_micros of a column, in the cheapest way that is right for its type and the session's zone."""
    c, kind = quoted(name), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return wall_micros(c.try_cast("timestamp_ntz"))
    utc = df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")
    return F.unix_micros(c.cast("timestamp")) if utc or isinstance(kind, T.TimestampType) else wall_micros(c)


def canonical_points(df: DataFrame, time: str | None = None, lat: str | None = None, lon: str | None = None, vessel: str | None = None, drop_incomplete: bool = True) -> DataFrame:
    """Any observation table as (MMSI string, timestamp, lat, lon).

    Rows whose time, lat or lon is null or cannot be read are dropped unless drop_incomplete is false. A table without a
    vessel column gets null there; without time, lat or lon column this raises ValueError.
    """
    names = df.columns
    found = {
        "timestamp": resolve_column(names, TIME_NAMES, time),
        "lat": resolve_column(names, LAT_NAMES, lat),
        "lon": resolve_column(names, LON_NAMES, lon),
    }
    lacking = [k for k, v in found.items() if v is None]
    if lacking:
        raise ValueError(f"no column for {', '.join(lacking)} among {names}")
    who = resolve_column(names, ID_NAMES, vessel)
    out = df.select(
        (quoted(who).cast("string") if who else F.lit(None).cast("string")).alias("MMSI"),
        coerce_time(quoted(found["timestamp"])).alias("timestamp"),
        coerce_number(quoted(found["lat"])).alias("lat"),
        coerce_number(quoted(found["lon"])).alias("lon"),
    )
    return out.na.drop(subset=["timestamp", "lat", "lon"]) if drop_incomplete else out


# Rules of the position tables: when a field counts as usable.
VALUE_RANGE = (-2.5, 40.0)


def usable_lat(lat: Column, lon: Column) -> Column:
    """Never null. NaN compares as larger than any number, so the range excludes it."""
    return F.coalesce(lat.between(-90, 90) & ~F.coalesce((lat == 0) & (lon == 0), F.lit(False)), F.lit(False))


def usable_lon(lat: Column, lon: Column) -> Column:
    return F.coalesce(lon.between(-180, 360) & ~F.coalesce((lat == 0) & (lon == 0), F.lit(False)), F.lit(False))


def usable_value(value: Column, flag: Column, bounds: tuple[float, float] = VALUE_RANGE) -> Column:
    return F.coalesce(value.between(*bounds), F.lit(False)) & ~F.coalesce(flag, F.lit(False))


def vessel_key(mmsi: Column) -> Column:
    """The vessel without outer spaces and without a final `.0`; null for null and blank."""
    t = F.trim(mmsi.cast("string"))
    t = F.when(F.endswith(t, F.lit(".0")), F.left(t, F.length(t) - 2)).otherwise(t)
    return F.when(F.trim(t) != "", t)
