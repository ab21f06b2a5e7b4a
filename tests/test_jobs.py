import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinegrid import cli
from brinegrid.operators import quality, stratify
from brinegrid.plans import fallback, jobs
from brinegrid.sources.grid_source import write_netcdf
from brinegrid.streaming import observe

T = dt.datetime(2015, 1, 1)


@pytest.fixture
def grid_file(tmp_path):
    data = np.array([[[y + x + 100.0 * t for x in (0, 10, 20)] for y in (0, 10)] for t in range(2)])
    write_netcdf(str(tmp_path / "g.nc"), {"time": 2, "lat": 2, "lon": 3}, {"time": (("time",), np.array([0.0, 20.0]), {"units": "days since 2015-01-01"}), "lat": (("lat",), np.array([0.0, 10.0]), {}), "lon": (("lon",), np.array([0.0, 10.0, 20.0]), {}), "sst": (("time", "lat", "lon"), data, {})}, "time")
    return str(tmp_path / "g.nc")


def points(spark):
    return spark.createDataFrame([("1", T, 5.0, 5.0), ("2", T + dt.timedelta(days=19), 5.0, 15.0), ("3", dt.datetime(2016, 1, 1), 5.0, 5.0)], "MMSI string, timestamp timestamp_ntz, lat double, lon double")


def test_pipeline(spark, tmp_path, grid_file):
    table = jobs.build_grid(spark, [grid_file], str(tmp_path / "grid"))
    got = {r.MMSI: (r.sst, r.sst_source) for r in jobs.extract(points(spark), table, str(tmp_path / "out")).collect()}
    assert got == {"1": (10.0, "interp"), "2": (120.0, "interp"), "3": (None, "missing")}
    assert jobs.extract(points(spark), table, keep_missing_years=False).count() == 2
    assert jobs.extract(points(spark), table, years=[2016]).count() == 1
    lines = [r.line for r in jobs.report(spark.read.parquet(str(tmp_path / "out"))).orderBy("year").collect()]
    assert lines[0].startswith("Year 2015: total=2 missing=0 present=2 min=10.000 mean=65.000")
    assert lines[1].endswith("min=n/a mean=n/a")
    # again: nothing doubles
    jobs.extract(points(spark), table, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_combine_and_split(spark, tmp_path):
    d = tmp_path / "fleet-daily-csvs-100-v3-2012"
    d.mkdir()
    (d / "a.csv").write_text("date,lat\n2012-01-01,1\nbad,2\n")
    (d / "b.csv").write_text("lat,lon,date\n3,4,2013-05-05\n")
    out = str(tmp_path / "combined")
    assert jobs.combine(spark, str(tmp_path), out, dry_run=True).count() == 2
    jobs.combine(spark, str(tmp_path), out)
    jobs.combine(spark, str(tmp_path), out, overwrite=True)
    back = spark.read.csv(out, header=True)
    assert back.count() == 3
    n = {r.year: r.n for r in jobs.split_by_year(back, str(tmp_path / "years")).collect()}
    assert n == {2012: 1, 2013: 1}
    assert spark.read.csv(str(tmp_path / "years"), header=True).count() == 2
    with pytest.raises(jobs.InputMissing):
        jobs.combine(spark, str(tmp_path / "none"), out)


def test_command_line(spark, tmp_path, grid_file):
    points(spark).write.parquet(str(tmp_path / "p.parquet"))
    assert cli.main(["grid", grid_file, "--out", str(tmp_path / "grid"), "--bbox", "0,10,0,20"]) == 0
    assert cli.main(["extract", str(tmp_path / "p.parquet"), str(tmp_path / "grid"), str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).where("sst is not null").count() == 2
    assert cli.main(["report", str(tmp_path / "o")]) == 0
    assert cli.main(["fallback", str(tmp_path / "o"), str(tmp_path / "plan"), "--base", "http://x.invalid", "--layer", "L"]) == 0
    assert '"layer"' in "".join(r.value for r in spark.read.text(str(tmp_path / "plan")).collect())
    assert cli.main(["combine", str(tmp_path / "none"), str(tmp_path / "c")]) == 1


def test_pilot(spark):
    df = spark.createDataFrame([(k, T + dt.timedelta(days=400 * (k % 2)), 1.0 + k, 2.0, None if k % 2 else float(k)) for k in range(12)], "obs_id long, timestamp timestamp_ntz, lat double, lon double, sst double")
    missing = fallback.missing_points(df, 4, 2)
    assert missing.count() == 2
    plan = fallback.plan_requests(df, 3, 6, "http://x.invalid/w?", "L")
    assert plan.count() == 6
    assert plan.where(~F.col("url").startswith("http://x.invalid/w?SERVICE=WMTS&")).count() == 0
    done = fallback.run_pilot(plan, lambda u: (200, "7.5") if "TIME=2015" in u else (500, "1"), rate=1000, workers=2)
    r = {x.year: x for x in quality.pilot_report(done).collect()}
    assert (r[2015].rows_requested, r[2015].rows_filled, r[2016].rows_filled, r[2016].n_errors) == (3, 3, 0, 3)
    assert '"total_requested":6' in fallback.pilot_document(done).first().report


def test_quota_and_samples(spark):
    df = spark.createDataFrame([(2012 if k < 10 else 2013, k) for k in range(11)], "year int, k int")
    assert sorted(r.year for r in stratify.quota_per_stratum(df, F.col("year"), F.col("k"), 5, 2).collect()) == [2012, 2012, 2013]
    assert stratify.quota_per_stratum(df, F.col("year"), F.col("k"), 1, 2).count() == 1
    again = lambda: sorted(r.k for r in stratify.per_stratum(df, F.col("year"), F.col("k"), 3).collect())
    assert again() == again()


def test_quality_flags(spark):
    df = spark.createDataFrame([(2012, 1.0, False), (2012, float("nan"), False), (2012, 5.0, True), (2012, 2.0, None), (2013, None, None)], "y int, sst double, sst_missing boolean")
    r = {x.year: x for x in quality.by_year(df, F.col("y")).collect()}
    assert (r[2012].total, r[2012].missing, r[2012].present, r[2012].mean_sst, r[2012].median_sst) == (4, 2, 2, 1.5, 1.5)
    assert (r[2013].missing, r[2013].mean_sst) == (1, None)


def test_exact_quantiles_equal_the_built_in(spark):
    r = np.random.default_rng(1)
    rows = [(None if k % 7 == 0 else int(k % 3), float(x)) for k, x in enumerate(np.round(r.normal(0, 5, 4000), 1))]
    rows += [(9, 1.0), (8, 1.0), (8, 2.0), (7, None), (7, float("nan"))] + [(6, 4.0)] * 500
    df = spark.createDataFrame(rows, "y int, x double")
    qs = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 0.99, "e": 1.0}
    got = {x.year: tuple(x)[1:] for x in quality.exact_quantiles(df, F.col("y"), F.col("x"), qs, accuracy=100).collect()}
    want = {x.y: tuple(x)[1:] for x in df.where("x is not null and not isnan(x)").groupBy("y").agg(*[F.percentile("x", q) for q in qs.values()]).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_files_and_counters(spark, tmp_path):
    df = spark.createDataFrame([(T, None), (T, 1.0)], "timestamp timestamp_ntz, sst double")
    for k in range(3):
        df.coalesce(1).write.parquet(str(tmp_path / f"f/part={k}"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert quality.files_by_year(back, F.year("timestamp")).first().n_files == 3
    seen, o = quality.counted(back, "progress")
    seen.write.format("noop").mode("overwrite").save()
    assert o.get == {"rows": 6, "missing": 3}


def test_stream(spark, tmp_path, grid_file):
    src = str(tmp_path / "src")
    p = points(spark)
    p.write.parquet(src)
    table = jobs.build_grid(spark, [grid_file], str(tmp_path / "grid"))
    stream = observe.enrich(observe.read_points(spark, src, p.schema), jobs.grid_of_year(table, 2015))
    observe.append_parquet(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    p.limit(1).write.mode("append").parquet(src)
    observe.append_parquet(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4


def test_stream_dedup_and_windows(spark, tmp_path):
    src = str(tmp_path / "src")
    df = spark.createDataFrame([("a", T, 1.0), ("a", T, 1.0), ("b", T + dt.timedelta(hours=1), None), ("c", T + dt.timedelta(days=200), 2.0)], "MMSI string, timestamp timestamp_ntz, sst double")
    df.write.parquet(src)
    s = observe.without_redeliveries(observe.read_points(spark, src, df.schema), ["MMSI", "timestamp"])
    observe.append_parquet(s, str(tmp_path / "d"), str(tmp_path / "dc")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3
    w = observe.windowed_quality(observe.read_points(spark, src, df.schema))
    q = w.writeStream.format("memory").queryName("wq").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "wc")).start()
    q.awaitTermination()
    r = spark.sql("select total, missing from wq").collect()
    assert [tuple(x) for x in r] == [(3, 1)]


def test_split_and_reunite_is_the_identity(spark, tmp_path):
    rows = [(dt.datetime(2012 + k % 5, 1 + k % 12, 1 + k % 28), k, None if k % 3 else float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, k int, sst double")
    jobs.split_by_year(df, str(tmp_path / "y"), format="parquet")
    back = spark.read.parquet(str(tmp_path / "y")).select("timestamp", "k", "sst")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    q = quality.by_year(back, F.year("timestamp")).collect()
    assert all(r.total == r.present + r.missing for r in q)
    assert sum(r.total for r in q) == 200


def test_union_keeps_all_rows(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, 4)] * 2, "y int, z int")
    u = stratify.union_by_name(a, b)
    assert u.columns == ["x", "y", "z"]
    assert sorted(map(tuple, u.collect()), key=str) == sorted([(1, 2, None), (None, 3, 4), (None, 3, 4)], key=str)
