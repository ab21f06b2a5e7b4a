import datetime as dt

import pytest
from pyspark.sql import functions as F

from brinegrid.operators import lookup as L

DAY = dt.timedelta(days=1)
T = dt.datetime(2020, 1, 1)


def grid(spark, f, times=(T, T + 30 * DAY), lats=(0.0, 10.0, 20.0), lons=(-20.0, -10.0, 0.0, 10.0)):
    rows = [(ti, j, i, f(ti, y, x)) for ti in range(len(times)) for j, y in enumerate(lats) for i, x in enumerate(lons)]
    return L.Grid(spark.createDataFrame(rows, "ti int, j int, i int, v double"), tuple(times), tuple(lats), tuple(lons))


def points(spark, rows):
    return spark.createDataFrame(rows, "k int, timestamp timestamp_ntz, lat double, lon double")


def run(df):
    return {r.k: (r.sst, r.sst_source) for r in df.collect()}


@pytest.mark.parametrize("tile", [None, 2])
def test_affine_field_is_exact(spark, tile):
    g = grid(spark, lambda ti, y, x: 2 * y + x + ti)
    p = points(spark, [(1, T, 3.0, 4.0), (2, T, 10.0, -10.0), (3, T, 20.0, 10.0), (4, T + DAY, 0.0, -20.0)])
    got = run(L.lookup(p, g, tile=tile))
    assert got == {1: (10.0, "interp"), 2: (10.0, "interp"), 3: (50.0, "interp"), 4: (-20.0, "interp")}


@pytest.mark.parametrize("tile", [None, 2])
def test_null_corner_and_edges(spark, tile):
    g = grid(spark, lambda ti, y, x: None if (y, x) == (10.0, -10.0) else y)
    p = points(spark, [(1, T, 5.0, -17.5), (2, T, 99.0, -17.5), (3, T, 10.0, -11.0), (4, T, -50.0, 300.0)])
    got = run(L.lookup(p, g, tile=tile))
    assert got[1] == (10.0, "nearest")  # half way: the larger latitude
    assert got[2] == (20.0, "nearest")  # outside: the edge cell
    assert got[3] == (None, "missing")  # the nearest cell itself is null
    assert got[4] == (0.0, "nearest")


def test_time_ties_and_tolerance(spark):
    g = grid(spark, lambda ti, y, x: float(ti))
    p = points(spark, [(1, T + 15 * DAY, 0.0, 0.0), (2, T + 61 * DAY, 0.0, 0.0), (3, T + 61 * DAY + dt.timedelta(seconds=1), 0.0, 0.0), (4, T + 16 * DAY, 0.0, 0.0), (5, None, 0.0, 0.0)])
    got = run(L.lookup(p, g, 31))
    assert [got[k][0] for k in range(1, 6)] == [0.0, 1.0, None, 1.0, None]


def test_even_and_uneven_axes_agree(spark):
    even = [T + k * 6 * DAY for k in range(5)]
    odd = [*even, even[-1] + 100 * DAY]
    df = spark.range(0, 30 * 24, 5).select((F.lit(T - 2 * DAY).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("t"))
    r = df.select(L.nearest_time(F.col("t"), even)["ti"].alias("a"), L.nearest_time(F.col("t"), odd)["ti"].alias("b")).collect()
    assert all(x.a == x.b for x in r)


def test_extrapolation_and_time_blend(spark):
    g = grid(spark, lambda ti, y, x: y + 30.0 * ti)
    p = points(spark, [(1, T + 15 * DAY, 30.0, 0.0), (2, T + 15 * DAY, 5.0, 0.0)])
    assert {r.k: r.sst for r in L.lookup_extrapolating(p, g).collect()} == {1: 30.0, 2: 5.0}
    assert {r.k: r.sst for r in L.lookup_linear_in_time(p, g).collect()} == {1: 20.0, 2: 20.0}


def test_empty_points(spark):
    g = grid(spark, lambda ti, y, x: y)
    assert L.lookup(points(spark, []), g).count() == 0


def test_plan_has_no_python_and_one_join(spark):
    g = grid(spark, lambda ti, y, x: y)
    plan = L.lookup(points(spark, [(1, T, 1.0, 1.0)]), g)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert plan.count("Join ") <= 2
