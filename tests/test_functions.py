import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from brinegrid import columns as C
from brinegrid.functions import geo, text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(("lon", "low", "high", "want"), [(-10.0, 0, 359, 350), (10.0, 0, 359, 10), (190.0, -180, 179, -170), (-10.0, -180, 179, -10), (180.0, -180, 179, 180)])
def test_normalize_lon(spark, lon, low, high, want):
    n = geo.normalize_lon(F.lit(lon), low, high)
    assert one(spark, n.alias("x")).x == want
    assert one(spark, geo.normalize_lon(n, low, high).alias("x")).x == want


@pytest.mark.parametrize(("lon", "lat", "want"), [(0.0, 0.0, (64, 32, 0, 0)), (180.0, -90.0, (127, 63, 255, 255)), (-122.5, 45.0, (20, 16, 113, 0)), (18.4, -33.9, (70, 44, 138, 14))])
def test_geodetic(spark, lon, lat, want):
    c = [*geo.geodetic_tile(F.lit(lon), F.lit(lat), 6), *geo.geodetic_pixel(F.lit(lon), F.lit(lat), 6)]
    assert tuple(one(spark, *[x.alias(str(k)) for k, x in enumerate(c)])) == want


@pytest.mark.parametrize(("lat", "lon", "want"), [(0.0, 0.0, (8, 8, 0, 0)), (45.0, -122.5, (2, 5, 142, 193)), (-33.9, 18.4, (8, 9, 209, 154)), (60.0, 180.0, (16, 4, 0, 165)), (89.0, 0.0, (None,) * 4)])
def test_mercator(spark, lat, lon, want):
    c = [*geo.mercator_tile(F.lit(lat), F.lit(lon), 4), *geo.mercator_pixel(F.lit(lat), F.lit(lon), 4)]
    assert tuple(one(spark, *[x.alias(str(k)) for k, x in enumerate(c)])) == want


def test_bilinear(spark):
    q = [F.lit(x) for x in (0.0, 10.0, 20.0, 30.0, 0.25, 0.5)]
    assert one(spark, geo.bilinear(*q).alias("x")).x == 12.5
    q[3] = F.lit(None).cast("double")
    assert one(spark, geo.bilinear(*q).alias("x")).x is None


def test_irregular_axis(spark):
    axis = [0.0, 1.0, 4.0, 10.0]
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (3.9,), (4.0,), (10.0,), (99.0,)], "x double")
    got = [r.i for r in df.select(geo.cell_index(F.col("x"), axis).alias("i")).collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2, 2]
    r = df.where("x = 0.5").select(geo.axis_fraction(F.col("x"), axis, geo.cell_index(F.col("x"), axis)).alias("t")).first()
    assert r.t == 0.5


@pytest.mark.parametrize(
    ("doc", "want"),
    [('{"a":{"b":"12","c":[null,true,{"d":-3.5e1}]},"e":7}', -35.0), ('{"type":"x 9","v":"q\\"8\\"","k":[4]}', 4.0), ("[]", None), ('{"v":null}', None), ("not json 404 x", None), (None, None)],
)
def test_json_first_number(spark, doc, want):
    assert spark.createDataFrame([(doc,)], "d string").select(text.json_first_number(F.col("d")).alias("x")).first().x == want


def test_text_first_number(spark):
    assert one(spark, text.text_first_number(F.lit("not json 404 x")).alias("x")).x == 404.0
    assert one(spark, text.text_first_number(F.lit("none")).alias("x")).x is None


def test_times(spark):
    t = F.lit(dt.datetime(2015, 6, 1, 2, 3, 4, 50)).cast("timestamp_ntz")
    r = one(spark, text.utc_time(t).alias("u"), text.plain_time(t).alias("p"), text.plain_time(F.date_trunc("day", t)).alias("d"))
    assert tuple(r) == ("2015-06-01T02:03:04Z", "2015-06-01T02:03:04.000050", "2015-06-01T00:00:00")


def test_rounding_is_half_even(spark):
    assert [r.x for r in spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double").select(F.rint("v").alias("x")).collect()] == [0, 2, 2]


def test_resolve_column():
    assert C.resolve_column(["MMSI", "Lat", "LONG"], C.LON_NAMES) == "LONG"
    assert C.resolve_column(["time", "timestamp"], C.TIME_NAMES) == "timestamp"
    assert C.resolve_column(["lat", "LAT"], C.LAT_NAMES) == "LAT"
    assert C.resolve_column(["a"], C.LAT_NAMES) is None
    assert C.resolve_column(["a"], C.LAT_NAMES, fallback="a") == "a"
    with pytest.raises(ValueError, match="no column"):
        C.resolve_column(["a"], C.LAT_NAMES, "b")


def test_canonical_points(spark):
    df = spark.createDataFrame([("1", "2013-02-30", "1", "2"), ("2", "2013-02-28 01:00:00", "x", "2"), ("3", "2013-02-28", "1.5", "NaN"), ("4", "2013-02-28", "1.5", "2")], "mmsi_present string, Date string, Latitude string, long string")
    rows = C.canonical_points(df).collect()
    assert [(r.MMSI, r.timestamp, r.lat, r.lon) for r in rows] == [("4", dt.datetime(2013, 2, 28), 1.5, 2.0)]
    assert C.canonical_points(df, drop_incomplete=False).count() == 4
    with pytest.raises(ValueError, match="lat"):
        C.canonical_points(df.drop("Latitude"))


def test_clean_floats(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int")
    assert [r.x for r in C.clean_floats(df).orderBy("k").collect()] == [None, 2.0]


def test_vessel_key(spark):
    df = spark.createDataFrame([(" 12.0",), ("12",), ("",), ("  ",), (None,), (".0",)], "m string")
    assert [r.v for r in df.select(C.vessel_key(F.col("m")).alias("v")).collect()] == ["12", "12", None, None, None, None]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/St_Johns"])
def test_micros_do_not_depend_on_the_zone(spark, zone):
    times = [dt.datetime(2015, 3, 29, 2, 30), dt.datetime(2015, 10, 25, 2, 30, 1, 7), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), None]
    want = [None if t is None else round((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for t in times]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t, str(t) if t else "x", k) for k, t in enumerate(times)], "t timestamp_ntz, s string, k int")
        r = df.select("k", C.micros_of(df, "t").alias("a"), C.wall_micros(F.col("t")).alias("b"), C.micros_of(df, "s").alias("c")).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [x.a for x in r] == [x.b for x in r] == [x.c for x in r] == want


def test_free_name():
    assert C.free_name(["fill", "FILL_"], "fill") == "fill__"
    assert not math.isnan(1.0)
