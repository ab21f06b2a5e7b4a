import csv
import datetime as dt
import io
import re

import pytest
from pyspark.sql import functions as F

from brinegrid.columns import ROLES
from brinegrid.operators import drift as D

SCHEMA = "file_id long, feed string, file_date date, content string"
DAY = dt.date(2015, 1, 1)


def files(spark, contents, feed="a"):
    return spark.createDataFrame([(k, feed, DAY + dt.timedelta(days=k), c) for k, c in enumerate(contents)], SCHEMA)


def changes(spark, *contents):
    return sorted((r.file_id, r.column_name, r.change_kind) for r in D.schema_changes(files(spark, contents)).collect())


def test_kinds(spark):
    a = "date,lat,lon,hours\n2015-01-01,1.5,2,3\n"
    assert changes(spark, a, a) == []
    assert changes(spark, a, "hours,lon,lat,date\n3,2,1.5,2015-01-01\n") == []
    assert changes(spark, a, "time,lat,lon,hours\n2015-01-01,1.5,2,3\n") == [(1, "time", "renamed")]
    assert changes(spark, a, "time,lat,lon,hours\n17,1.5,2,3\n") == [(1, "time", "renamed"), (1, "time", "retyped")]
    assert changes(spark, a, "date,lat,lon\n2015-01-01,1.5,2\n") == [(1, "hours", "removed")]
    assert changes(spark, a, "date,lat,lon,hours,x\n2015-01-01,1.5,2.5,3,1\n") == [(1, "lon", "retyped"), (1, "x", "added")]
    # two columns of a role: no rename
    assert changes(spark, a, "date,latitude,cell_ll_lat,lon,hours\n2015-01-01,1.5,1.5,2,3\n") == [(1, "cell_ll_lat", "added"), (1, "lat", "removed"), (1, "latitude", "added")]


def test_spellings_are_no_change(spark):
    a = "date,lat\n2015-01-01,1.5\n"
    for b in ('﻿date,lat\n2015-01-01,1.5\n', '"DATE", Lat \r\n2015-01-01,1.5\r\n', "date,lat\r2015-01-01,1.5", '﻿"Date","LAT"\n2015-01-01,1.5\n'):
        assert changes(spark, a, b) == []


@pytest.mark.parametrize(("values", "kind"), [(["1", "+2", " -3 ", ""], "integer"), (["", " "], "integer"), ([], "integer"), (["1", "2.5"], "decimal"), (["1e5"], "decimal"), ([".5", "5."], "decimal"), (["1", "x"], "text"), (["nan"], "text"), (["1_0"], "text"), (["٣"], "text")])
def test_types(spark, values, kind):
    df = files(spark, ["x,y\n" + "".join(f"{v},1\n" for v in values)])
    row = D.infer_schemas(df).select(F.col("columns")[0].alias("c")).select(D.type_of(F.col("c")).alias("k")).first()
    assert row.k == kind


def test_empty_null_and_feeds(spark):
    assert changes(spark) == []
    assert changes(spark, None, "", "a\n1\n", "a\n1\n", None) == [(2, "a", "added"), (4, "a", "removed")]
    df = files(spark, ["a\n1\n"], "x").unionByName(files(spark, ["b\n1\n"], "y")).withColumns({"columns": F.lit(1), "old": F.lit(2), "new": F.lit(3), "day": F.lit(4)})
    assert D.schema_changes(df).count() == 0
    same_day = spark.createDataFrame([(2, None, None, "b\n1\n"), (1, None, None, "a\n1\n")], SCHEMA)
    assert sorted((r.file_id, r.column_name, r.change_kind) for r in D.schema_changes(same_day).collect()) == [(2, "a", "removed"), (2, "b", "added")]


def brute(rows):
    """(file, name, kind) by plain Python over files in order."""
    out = set()
    feeds = {}
    role = {n: r for r, ns in ROLES.items() for n in ns}
    for fid, feed, day, text in sorted(rows, key=lambda r: (r[1], r[2])):
        recs = list(csv.reader(io.StringIO(text.lstrip("﻿"), newline="")))
        names = [n.strip().strip("﻿").strip('"').lower() for n in recs[0]]
        types = {}
        for k, n in enumerate(names):
            vals = [r[k].strip() for r in recs[1:] if r and r[k].strip()]
            types[n] = "i" if all(re.fullmatch(r"[+-]?[0-9]+", v) for v in vals) else "d" if all(re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", v) for v in vals) else "t"
        if feed in feeds:
            old = feeds[feed]
            gone, come = set(old) - set(types), set(types) - set(old)
            pairs = {n: n for n in set(old) & set(types)}
            for r in ROLES:
                a, b = [n for n in old if role.get(n) == r], [n for n in types if role.get(n) == r]
                if len(a) == len(b) == 1 and a != b:
                    out.add((fid, b[0], "renamed"))
                    gone.discard(a[0])
                    come.discard(b[0])
                    pairs[a[0]] = b[0]
            out |= {(fid, n, "removed") for n in gone} | {(fid, n, "added") for n in come} | {(fid, b, "retyped") for a, b in pairs.items() if old[a] != types[b]}
        feeds[feed] = types
    return out


def test_driver_table_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/drift_files.parquet")
    rows = [tuple(r) for r in df.select("file_id", "feed", "file_date", "content").collect()]
    got = [(r.file_id, r.column_name, r.change_kind) for r in D.schema_changes(df).collect()]
    assert len(got) == len(set(got)) > 10
    assert set(got) == brute(rows)


def test_fused_schema_and_table(spark):
    df = files(spark, ["time,lat,long,x\n2015-01-01,1.5,2E,7\n", "Datetime,LAT,lon,x,z\n2015-01-02,2.5,3 W,7.5,q\n", "date,latitude,lon,x\nbad,,4,oops\n"])
    f = {r.name: r for r in D.fused_schema(df).collect()}
    assert f["x"].alternatives == ["integer", "decimal", "text"]
    assert (f["x"].kind, f["x"].n_files, f["lat"].role) == ("text", 3, "lat")
    t = {r.file_id: r for r in D.consistent_table(df).collect()}
    assert [(t[k].lat, t[k].lon) for k in range(3)] == [(1.5, 2.0), (2.5, -3.0), (None, 4.0)]
    assert t[2].time is None
    assert t[0].time == dt.datetime(2015, 1, 1)
    assert (t[0].x.integer, t[0].x.decimal, t[0].x.text, t[0].x.canonical) == (7, None, None, "7")
    assert (t[1].x.decimal, t[2].x.text, t[1].z, t[0].z) == (7.5, "oops", "q", None)


def test_role_columns_keep_every_value(spark):
    df = files(spark, ["time,lat,mmsi\n1337178420,bad,n1\n20120516,5,3\n1337178420.5,2N,1 hulls\nsoon,,\n20121399,1.5,3.0\n", "date\n2012-05-16\n"])
    t = {(r.file_id, r.row_no): r for r in D.consistent_table(df).collect()}
    first = dt.datetime(2012, 5, 16, 14, 27)
    assert [t[0, k].time for k in range(1, 6)] == [first, dt.datetime(2012, 5, 16), first + dt.timedelta(seconds=0.5), None, None]
    assert (t[0, 1].time_.raw, t[0, 1].time_.integer, t[0, 1].time_.canonical) == ("1337178420", 1337178420, first)
    assert (t[0, 4].time_.raw, t[0, 4].time_.text, t[0, 5].time_.raw) == ("soon", "soon", "20121399")
    assert (t[0, 1].lat, t[0, 1].lat_.text, t[0, 3].lat_.raw, t[0, 3].lat_.canonical, t[0, 4].lat_) == (None, "bad", "2N", 2.0, None)
    assert [(t[0, k].mmsi.integer, t[0, k].mmsi.decimal, t[0, k].mmsi.text, t[0, k].id) for k in (1, 2, 3, 5)] == [(None, None, "n1", "n1"), (3, None, None, "3"), (None, None, "1 hulls", "1 hulls"), (None, 3.0, None, "3.0")]
    assert (t[1, 1].time_, t[1, 1].date.text, t[1, 1].time) == (None, "2012-05-16", dt.datetime(2012, 5, 16))


def test_two_columns_of_a_role(spark):
    df = files(spark, ["latitude,cell_ll_lat,mmsi,mmsi_present,time,date\n23.0,-31.38,1,3,1337178420,2012-05-16\nbad,4,,5,soon,2012-05-17\n", "lat,LAT,lat,x,X\n1,2,3,7,8\nbad,,4,,9\nbad,,,,\n"])
    t = {(r.file_id, r.row_no): r for r in D.consistent_table(df).collect()}
    a, b = t[0, 1], t[0, 2]
    assert (a.lat, a.latitude.canonical, a.cell_ll_lat.canonical, a.id, a.mmsi_present.integer) == (23.0, 23.0, -31.38, "1", 3)
    assert (a.time, a.date.canonical) == (dt.datetime(2012, 5, 16, 14, 27), dt.datetime(2012, 5, 16))
    assert (b.lat, b.latitude.raw, b.id, b.time, b.time_.raw, b.repeats) == (4.0, "bad", "5", dt.datetime(2012, 5, 17), "soon", None)
    assert (t[1, 1].lat, t[1, 1].repeats, t[1, 1].x) == (1.0, {"lat": ["2", "3"], "x": ["8"]}, 7)
    assert (t[1, 2].lat, t[1, 2].repeats, t[1, 2].x) == (4.0, {"lat": ["4"]}, 9)
    assert (t[1, 3].lat, t[1, 3].repeats) == (None, None)


def test_table_of_nothing(spark):
    assert D.consistent_table(files(spark, [])).count() == 0
    assert D.consistent_table(files(spark, [None, "", "a,b\n"])).count() == 0
    with pytest.raises(ValueError, match="distinct"):
        D.consistent_table(files(spark, ["a,b,c\n1,2,3\n"]), most_columns=2)


def test_huge_fields_surplus_cells_and_odd_quotes(spark):
    long = "q" * 140_000
    content = f'a,b\n"{long},x",2\n1,2,3,,4\n"un""quoted"tail,7\n" ""q"" ",\nplain"quote,8\n\n"two\nlines",9\n"open,1\n2'
    df = files(spark, [content, "a,b\n1\n"])
    rows = {(r.file_id, r.row_no): r for r in D.united_rows(df).collect()}
    cells = [rows[0, k].cells for k in range(1, 8)]
    assert cells == [{"a": long + ",x", "b": "2"}, {"a": "1", "b": "2"}, {"a": 'un"quotedtail', "b": "7"}, {"a": '"q"'}, {"a": 'plain"quote', "b": "8"}, {"a": "two\nlines", "b": "9"}, {"a": "open,1\n2"}]
    assert (rows[0, 2].surplus, rows[0, 1].surplus, rows[1, 1].cells) == (["3", "4"], None, {"a": "1"})
    s = {r.file_id: r for r in D.infer_schemas(df).collect()}
    assert (s[0].surplus, s[1].surplus) == (3, 0)
    assert [c.blank for c in s[0]["columns"]] == [0, 2]
    t = {(r.file_id, r.row_no): r for r in D.consistent_table(df).collect()}
    assert (t[0, 2].surplus, t[0, 3].surplus) == (["3", "4"], None)


def test_alternatives_that_appear(spark):
    df = files(spark, ["x,y\n1,\n2,\n", "x,y\n1,a\n", "x,y\n1,2\noops,3\n2.5,4\n", "x,x\nbad,2.5\n"])
    got = sorted((r.file_id, r.column_name, r.new_type) for r in D.new_alternatives(df).collect())
    assert got == [(2, "x", "decimal"), (2, "x", "text"), (2, "y", "integer")]
    assert D.new_alternatives(df.limit(0)).count() == 0


def test_files_before_are_found_across_months(spark):
    days = [0, 3, 40, 41, 200, 900, 901]
    rows = [(k, f, DAY + dt.timedelta(days=d), f"c{k % 3},d\n1,2\n") for f in ("u", None) for k, d in enumerate(days)] + [(50, "u", None, "e\n1\n")]
    got = {(r.file_id, r.column_name, r.change_kind) for r in D.schema_changes(spark.createDataFrame(rows, SCHEMA).where("feed = 'u'")).collect()}
    want = {(k, f"c{k % 3}", "added") for k in range(7)} | {(k, f"c{(k - 1) % 3}", "removed") for k in range(1, 7)} | {(0, "d", "added"), (0, "e", "removed")}
    assert got == want
    assert D.schema_changes(spark.createDataFrame(rows, SCHEMA).where("feed is null")).count() == 12
