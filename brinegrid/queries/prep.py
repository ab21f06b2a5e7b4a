"""Queries of the general data-preparation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import columns as C
from ..operators import compaction, drift, hotdeck, proximity, records


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    fills = hotdeck.find_fills(table(spark, sf, "vessel_points"))
    marks = fills.select(F.col("o").alias("obs_id"), "fill", F.explode(F.flatten(F.array_repeat("fill.marks", F.col("n_rows").cast("int")))).alias("m"))
    # a mark counts with its value and donors, or (without any usable value in the table) with neither
    made = F.when(F.col("m.field") == "lat", F.col("fill.lat")).when(F.col("m.field") == "lon", F.col("fill.lon")).when(F.col("m.field") == "sst", F.col("fill.value")).otherwise(F.col("fill.flag").cast("double"))
    return marks.where((made.isNotNull() & (F.size("m.donors") > 0)) | (F.col("m.level") == "none")).select("obs_id", F.col("m.field").alias("field"))


def p1_filled(spark: SparkSession, sf: str) -> DataFrame:
    return hotdeck.fill_from_similar(table(spark, sf, "vessel_points")).select("obs_id", "MMSI", "timestamp", "fill.lat", "fill.lon", F.col("fill.value").alias("sst"), F.col("fill.flag").alias("sst_missing"), "fill.marks")


def p1_from_donors(spark: SparkSession, sf: str) -> DataFrame:
    """Per field, how many gaps were filled, and how many of the values are those of one of their donors."""
    v = table(spark, sf, "vessel_points")
    m = hotdeck.find_fills(v).select("o", "fill", F.explode("fill.marks").alias("m")).select("o", F.col("m.field").alias("field"), F.explode("m.donors").alias("donor"), "fill")
    value = lambda lat, sst, flag: F.when(F.col("field") == "lat", lat).when(F.col("field") == "sst", sst).when(F.col("field") == "sst_missing", flag.cast("double"))
    m = m.where("field <> 'lon'")  # a longitude is turned around its closest donor and may differ in its last digit
    own = v.select(F.col("obs_id").alias("donor"), F.when(C.usable_lat(F.col("lat"), F.col("lon")), F.col("lat")).alias("lat"), F.when(C.usable_value(F.col("sst"), F.col("sst_missing")), F.col("sst")).alias("sst"), "sst_missing")
    both = m.join(own, "donor").select("o", "field", (value(F.col("fill.lat"), F.col("fill.value"), F.col("fill.flag")) == value(F.col("lat"), F.col("sst"), F.col("sst_missing"))).alias("same"))
    each = both.groupBy("o", "field").agg(F.max("same").alias("same"))
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("n_filled"), F.count_if("same").alias("n_from_donors"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return records.failed_records(records.parse_records(table(spark, sf, "raw_lines"))).select("line_id")


def p2_valid(spark: SparkSession, sf: str) -> DataFrame:
    return records.valid_records(records.parse_records(table(spark, sf, "raw_lines")))


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return records.failure_report(records.parse_records(table(spark, sf, "raw_lines")))


def p2_files(spark: SparkSession, sf: str) -> DataFrame:
    """Records and failures of each file."""
    r = records.failure_report(records.parse_records(table(spark, sf, "raw_lines").where("line_no is distinct from 1")))
    return r.groupBy("file_name").agg(F.sum("n_rows").alias("n_records"), F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n_rows"))), F.lit(0)).alias("n_failed"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return proximity.pairs_within(table(spark, sf, "vessel_points")).select("obs_a", "obs_b")


# Corners of example regions as (lat, lon); the second crosses the date line, the third has a hole.
REGIONS = {
    "gulf": [[(18.0, -98.0), (31.0, -98.0), (30.0, -81.0), (21.0, -87.0)]],
    "dateline": [[(-25.0, 160.0), (-10.0, 170.0), (5.0, 195.0), (-30.0, 205.0)]],
    "ring": [[(-60.0, -60.0), (20.0, -60.0), (20.0, 60.0), (-60.0, 60.0)], [(-40.0, -30.0), (0.0, -35.0), (5.0, 30.0), (-45.0, 25.0)]],
    "north": [[(40.0, -179.5), (85.0, -179.5), (85.0, 179.5), (40.0, 179.5), (55.0, 10.0), (45.0, -20.0)]],
}
EDGES = [(name, *a, *b) for name, rings in REGIONS.items() for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]])]


def p3_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The regions that hold each usable position, for quite large regions."""
    v = table(spark, sf, "vessel_points").where(C.usable_lat(F.col("lat"), F.col("lon")) & C.usable_lon(F.col("lat"), F.col("lon")))
    v = v.withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")))
    edges = spark.createDataFrame(EDGES, "region_id string, lat1 double, lon1 double, lat2 double, lon2 double")
    return proximity.containing_regions(v, edges, "obs_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf, "drift_files")).select("file_id", "column_name", "change_kind")


def p4_consistent(spark: SparkSession, sf: str) -> DataFrame:
    return drift.consistent_table(table(spark, sf, "drift_files"))


def p4_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """The role columns of the one table."""
    t = drift.consistent_table(table(spark, sf, "drift_files")).select("file_id", "row_no", "time", "lat", "lon", "id")
    return t.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


def p4_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    return drift.new_alternatives(table(spark, sf, "drift_files"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that were too small, told from the compacted rows (written and checked first)."""
    done = compaction.compact(table(spark, sf, "vessel_points"))
    sizes = compaction.chunk_sizes(spark.read.parquet(done.path), table(spark, sf, "chunk_files"))
    return sizes.where("small").select("chunk_id")


def p6_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All rows as compacted; NaN is told from null in columns of its own, as NaN equals nothing in a comparison."""
    done = compaction.compact(table(spark, sf, "vessel_points"))
    return C.tell_nan(spark.read.parquet(done.path))


LAT_OK = "coalesce(lat between -90 and 90 and not isnan(lat), false) and not coalesce(lat = 0 and lon = 0, false)"
LON_OK = "coalesce(lon between -180 and 360 and not isnan(lon), false) and not coalesce(lat = 0 and lon = 0, false)"

RAW = r"""f as (
            select *, regexp_full_match(line, '([^,"\r\n]*|"([^"]|"")*")(,([^,"\r\n]*|"([^"]|"")*")){7}') as whole,
                   regexp_extract(line, '^([^,"\r\n]*|"(?:[^"]|"")*"),', 1) as a,
                   regexp_extract(line, '^(?:[^,"\r\n]*|"(?:[^"]|"")*"),([^,"\r\n]*|"(?:[^"]|"")*"),', 1) as b,
                   regexp_extract(line, '^(?:[^,"\r\n]*|"(?:[^"]|"")*"),(?:[^,"\r\n]*|"(?:[^"]|"")*"),([^,"\r\n]*|"(?:[^"]|"")*"),', 1) as c
            from raw_lines where line_no is distinct from 1),
        g as (
            select *, trim(trim(a, '"'), ' ') as d,
                   case when regexp_full_match(trim(trim(b, '"'), ' '), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim(trim(b, '"'), ' ') as double) end as lat,
                   case when regexp_full_match(trim(trim(c, '"'), ' '), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim(trim(c, '"'), ' ') as double) end as lon
            from f),
        h as (select *, coalesce(whole and regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}')
            and year(try_cast(d as date)) between 2012 and 2019 and lat between -90 and 90 and lon between -180 and 180, false) as valid from g)"""
ROLE = "case when {0} in ('timestamp', 'time', 'datetime', 'date') then 'time' when {0} in ('lat', 'latitude', 'cell_ll_lat') then 'lat' when {0} in ('lon', 'longitude', 'long', 'cell_ll_lon') then 'lon' when {0} in ('mmsi', 'mmsi_id', 'mmsi_present') then 'id' end"

FILES = f"""f as (select file_id, feed, file_date, string_split(replace(replace(ltrim(content, chr(65279)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) as lines from drift_files),
        h as (select file_id, k.range as k, lower(trim(trim(trim(trim(string_split(lines[1], ',')[k.range + 1]), chr(65279)), '"'))) as name from f, range(200) k where k.range < len(string_split(lines[1], ','))),
        r as (select file_id, row_number() over (partition by file_id order by n) as row_no, line from (select file_id, unnest(lines[2:]) as line, unnest(range(len(lines) - 1)) as n from f) where line <> ''),
        c as (select h.file_id, row_no, k, name, trim(trim(trim(string_split(line, ',')[k + 1]), '"')) as x from h join r on r.file_id = h.file_id)"""

SQL = {
    "p4_alternatives": f"""with {FILES}, t as (select feed, name, case when regexp_full_match(x, '[+-]?[0-9]+') then 'integer' when regexp_full_match(x, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then 'decimal' else 'text' end as tag,
            min(row(file_date, c.file_id)) as seen from c join f on f.file_id = c.file_id where x <> '' group by 1, 2, 3),
        s as (select *, min(seen) over (partition by feed, name) as start from t)
        select feed, name as column_name, tag as new_type, seen[2] as file_id, 'alternative' as change_kind from s where seen <> start""",
    "p4_canonical": f"""with {FILES}, v as (select file_id, row_no, {ROLE.format("name")} as role, x,
              k + 1000 * list_position(['timestamp', 'time', 'datetime', 'date', 'lat', 'latitude', 'cell_ll_lat', 'lon', 'longitude', 'long', 'cell_ll_lon', 'mmsi', 'mmsi_id', 'mmsi_present'], name) as p from c where x <> ''),
        w as (select *, case when regexp_full_match(x, '[0-9]{{9,10}}([.][0-9]*)?') then epoch_ms(cast(floor(cast(x as double)) as bigint) * 1000)
                when regexp_full_match(x, '[0-9]{{8}}') then try_cast(concat(x[:4], '-', x[5:6], '-', x[7:]) as timestamp) else try_cast(rtrim(x, 'Z') as timestamp) end as t,
              case when regexp_full_match(x, '.*[SWsw]') then -1e0 else 1e0 end * try_cast(trim(rtrim(upper(x), 'NSEW')) as double) as d from v where role is not null)
        select r.file_id, r.row_no, strftime(min_by(t, p) filter (role = 'time' and t is not null), '%Y-%m-%d %H:%M:%S') as time, min_by(d, p) filter (role = 'lat' and d is not null) as lat,
          min_by(d, p) filter (role = 'lon' and d is not null) as lon, min_by(x, p) filter (role = 'id') as id
        from r left join w on w.file_id = r.file_id and w.row_no = r.row_no group by 1, 2""",
    "p1_found": f"""
        select obs_id, 'lat' as field from vessel_points where not ({LAT_OK})
        union all select obs_id, 'lon' from vessel_points where not ({LON_OK})
        union all select obs_id, 'sst' from vessel_points
            where not (coalesce(sst between -2.5e0 and 40e0 and not isnan(sst), false) and not coalesce(sst_missing, false))
        union all select obs_id, 'sst_missing' from vessel_points where sst_missing is null""",
    "p1_from_donors": """select field, count(*) as n_filled, count(*) as n_from_donors from (__P1__) where field <> 'lon' group by 1""",
    "p2_files": f"with {RAW} select file_name, count(*) as n_records, count(*) filter (not valid) as n_failed from h group by 1",
    "p2_found": f"with {RAW} select line_id from h where not valid",
    "p2_valid": f"""with {RAW}, e as (select *, regexp_extract_all(line, '([^,"\\r\\n]*|"(?:[^"]|"")*")(?:,|$)', 1) as x from h where valid),
        u as (select *, list_transform(x, lambda t: case when starts_with(t, '"') then replace(t[2:-2], '""', '"') else t end) as y from e)
        select cast(d as date) as date, lat as cell_ll_lat, lon as cell_ll_lon, y[4] as flag, y[5] as geartype, try_cast(y[6] as double) as hours, try_cast(y[7] as double) as fishing_hours,
          try_cast(y[8] as int) as mmsi_present, line_id, file_name, line_no, line from u""",
    "p3_regions": f"""
        with e(r, y1, x1, y2, x2) as (values {", ".join(f"('{n}', {a}e0, {b}e0, {c}e0, {d}e0)" for n, a, b, c, d in EDGES)}),
        v as (select obs_id, lat as py, case when lon > 180 then lon - 360 else lon end + k.range * 360 - 360 as px from vessel_points, range(3) k where {LAT_OK} and {LON_OK})
        select distinct obs_id, r as region_id from (
            select obs_id, px, r, sum(case when (y1 <= py) <> (y2 <= py) and x1 + (py - y1) / nullif(y2 - y1, 0) * (x2 - x1) > px then 1 else 0 end) as n from v, e group by 1, 2, 3) where n % 2 = 1""",
    "p4_found": f"""
        with f as (select file_id, lag(file_id) over (partition by feed order by file_date, file_id) as before,
                string_split(replace(replace(ltrim(content, chr(65279)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) as lines from drift_files),
        h as (select file_id, k.range as k, lower(trim(trim(trim(trim(string_split(lines[1], ',')[k.range + 1]), chr(65279)), '"'))) as name from f, range(200) k where k.range < len(string_split(lines[1], ','))),
        r as (select file_id, unnest(lines[2:]) as line from f),
        c as (select h.file_id, h.name, max(case when trim(x) = '' then 0 when regexp_full_match(trim(x), '[+-]?[0-9]+') then 0 when regexp_full_match(trim(x), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then 1 else 2 end) as kind
            from (select h.file_id, h.name, coalesce(string_split(r.line, ',')[h.k + 1], '') as x from h left join r on r.file_id = h.file_id and r.line <> '') h group by 1, 2),
        n as (select file_id, role, min(name) as name from (select file_id, name, {ROLE.format("name")} as role from h) where role is not null group by 1, 2 having count(*) = 1),
        m as (select f.file_id, f.before, a.name as old, b.name as new from f join n a on a.file_id = f.before join n b on b.file_id = f.file_id and b.role = a.role where a.name <> b.name),
        k as (select file_id, before, old, new from m union all
            select f.file_id, f.before, a.name, b.name from f join c a on a.file_id = f.before join c b on b.file_id = f.file_id and b.name = a.name
            where not exists (select 1 from m where m.file_id = f.file_id and (m.old = a.name or m.new = a.name)))
        select file_id, new as column_name, 'renamed' as change_kind from m
        union all select f.file_id, b.name, 'added' from f join c b on b.file_id = f.file_id where f.before is not null and not exists (select 1 from c a where a.file_id = f.before and a.name = b.name) and not exists (select 1 from m where m.file_id = f.file_id and m.new = b.name)
        union all select f.file_id, a.name, 'removed' from f join c a on a.file_id = f.before where not exists (select 1 from c b where b.file_id = f.file_id and a.name = b.name) and not exists (select 1 from m where m.file_id = f.file_id and m.old = a.name)
        union all select k.file_id, k.new, 'retyped' from k join c a on a.file_id = k.before and a.name = k.old join c b on b.file_id = k.file_id and b.name = k.new where a.kind <> b.kind""",
    "p3_found": f"""
        with v as (
            select obs_id, regexp_replace(trim(MMSI), '[.]0$', '') as vessel, "timestamp" as ts, lat, lon,
                   cast(floor(epoch(timestamp) / 600) as bigint) as k, cast(floor(lat * 50) as bigint) as s
            from vessel_points where {LAT_OK} and {LON_OK} and timestamp is not null and trim(coalesce(MMSI, '')) <> ''),
        w as (select v.*, v.k + dk.range - 1 as k2, v.s + ds.range - 1 as s2 from v, range(3) dk, range(3) ds)
        select least(a.obs_id, b.obs_id) as obs_a, greatest(a.obs_id, b.obs_id) as obs_b
        from v a join w b on a.k = b.k2 and a.s = b.s2 and a.obs_id < b.obs_id and a.vessel <> b.vessel
        where abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000
          and 2 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
              + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 1e0""",
    "p6_found": """
        select c.chunk_id from chunk_files c left join (select chunk_id, count(*) as n from vessel_points group by chunk_id) v on v.chunk_id = c.chunk_id
        group by c.chunk_id having coalesce(max(v.n), 0) < 200""",
    "p6_rows": "select * replace (" + ", ".join(f"case when not isnan({c}) then {c} end as {c}" for c in ("lat", "lon", "sst")) + "), " + ", ".join(f"coalesce(isnan({c}), false) as {c}_is_nan" for c in ("lat", "lon", "sst")) + " from vessel_points",
}

SQL["p1_from_donors"] = SQL["p1_from_donors"].replace("__P1__", SQL["p1_found"])

QUERIES = {f.__name__: f for f in (p1_found, p1_filled, p1_from_donors, p2_found, p2_valid, p2_report, p2_files, p3_found, p3_regions, p4_found, p4_consistent, p4_canonical, p4_alternatives, p6_found, p6_rows)}
