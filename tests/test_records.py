import csv
import datetime as dt
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinegrid.operators import records as R

GOOD = "2015-01-17,48.55,64.94,XGL,pots,4.2935,0.3799,3"


def judge(spark, lines, schema="line_id long, line_no int, line string"):
    df = spark.createDataFrame([(k, 2, x) for k, x in enumerate(lines)], schema)
    out = R.parse_records(df).orderBy("line_id").collect()
    return out


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        (GOOD, None),
        ('"2015-01-17"," 48.55 ",64.94,XGL,"a, ""b""\nc",4,0,3', None),
        ("2015-01-17, 48.5 ,-180,,,,,", None),
        ("2015-01-17,+4.85e1,.5,x,y,z,w,q", None),
        ("2015-01-17,5.,-0,x,y,z,w,q", None),
        (None, "no record"),
        ("", "too few fields"),
        ("2015-01-17,1,2,3,4,5,6", "too few fields"),
        (GOOD + ",9", "too many fields"),
        ('2015-01-17,1,2,"pots,4,5,6,7', "quote never closed"),
        ('2015-01-17,1,2,po"ts,x,4,5,6', "quote inside a plain field"),
        ('2015-01-17,1,2,"pots" ,x,4,5,6', "text after a closing quote"),
        ('2015-01-17,1,2, "pots",x,4,5,6', "quote inside a plain field"),
        ("2015-01-17,1,2,po\nts,x,4,5,6", "line break outside quotes"),
        ("2015-02-30,1,2,a,b,c,d,e", "no such day"),
        ("2015-2-3,1,2,a,b,c,d,e", "not a date"),
        ("2020-01-01,1,2,a,b,c,d,e", "year out of range"),
        ("2015-01-17,nan,2,a,b,c,d,e", "not a number"),
        ("2015-01-17,1_0,2,a,b,c,d,e", "not a number"),
        ("2015-01-17,١,2,a,b,c,d,e", "not a number"),
        ("2015-01-17,90.1,2,a,b,c,d,e", "out of range"),
        ("2015-01-17,1,-180.5,a,b,c,d,e", "out of range"),
        ("2015-01-17,1,1e999,a,b,c,d,e", "out of range"),
    ],
)
def test_reasons(spark, line, reason):
    r = judge(spark, [line])[0]
    assert (r.error.reason if r.error else None) == reason
    assert (r.record is None) == (reason is not None)


def test_typed_values_and_offsets(spark):
    a, b, c = judge(spark, [GOOD, '2015-01-17,1,2,"é",po"t,4,5,6', "2015-01-17,x,2,a,b,c,d,e"])
    assert (a.record.date.isoformat(), a.record.cell_ll_lat, a.record.geartype, a.record.mmsi_present) == ("2015-01-17", 48.55, "pots", 3)
    assert b.error.offset == len('2015-01-17,1,2,"é",po'.encode())
    assert (c.error.field, c.error.offset) == ("cell_ll_lat", 11)


def test_header_lines_are_no_case(spark):
    df = spark.createDataFrame([(1, 1, "date,x"), (2, 2, "date,x"), (3, None, "date,x")], "line_id long, line_no int, line string")
    out = {r.line_id: r for r in R.parse_records(df).collect()}
    assert out[1].error is None
    assert out[1].record is None
    assert out[2].error.reason == out[3].error.reason == "too few fields"


def test_empty_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 2, GOOD, "a", 1)] * 2 + [(2, 2, "x", "b", 2)], "line_id long, line_no int, line string, record string, date int")
    out = R.parse_records(df)
    assert out.columns[-2:] == ["record_", "error"]
    valid = R.valid_records(out)
    assert valid.count() == 2
    assert valid.columns[0] == "date"
    assert "date_" in valid.columns
    assert R.failed_records(out).count() == 1
    assert R.parse_records(df.limit(0)).count() == 0


def test_long_records(spark):
    big = "x" * 1_000_000
    ok = f'2015-01-17,1,2,"{big},""{big}",b,c,d,e'
    a, b = judge(spark, [ok, ok[:-10].replace('b,', '"b,')])
    assert a.error is None
    assert len(a.record.flag) == 2_000_002
    assert b.error.reason == "quote never closed"


def brute(data: bytes):
    """State by state."""
    state, seps, err = R.START, [], -1
    for k, c in enumerate(data):
        kind = int(R.CLASS[c])
        if kind == R.COMMA and state not in (R.QUOTED, R.BROKEN):
            seps.append(k)
        new = int(R.NEXT[kind, state])
        if new == R.BROKEN and state != R.BROKEN:
            err = k
        state = new
    return seps, err, state


@pytest.mark.parametrize("chunk", [1, 2, 3, 8, 64])
def test_chunked_states_equal_the_sequential_ones(chunk):
    r = random.Random(chunk)
    recs = ["".join(r.choice('ab,,""\n') for _ in range(r.randrange(40))).encode() for _ in range(200)]
    data = np.frombuffer(b"".join(recs), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in recs])]).astype(np.int64)
    seps, owner, err, last = R.tokenize(data, off, chunk)
    for k, x in enumerate(recs):
        s, e, state = brute(x)
        assert [p - off[k] for p in seps[owner == k]] == s
        assert (err[k] - off[k] if err[k] >= 0 else -1) == e
        assert last[k] == state


def test_fields_equal_the_csv_reader(spark):
    r = random.Random(1)
    rows = [["2015-01-17", "1", "2"] + ["".join(r.choice('ab",\n é') for _ in range(6)) for _ in range(2)] + ["1", "2", "3"] for _ in range(100)]
    lines = []
    for x in rows:
        f = io.StringIO()
        csv.writer(f, lineterminator="").writerow(x)
        lines.append(f.getvalue())
    for x, got in zip(rows, judge(spark, lines)):
        assert [got.record.flag, got.record.geartype] == x[3:5]


def test_report(spark):
    df = spark.createDataFrame([(1, 2, GOOD, "f"), (2, 3, "x", "f")], "line_id long, line_no int, line string, file_name string")
    assert {(r.reason, r.n_rows) for r in R.failure_report(R.parse_records(df)).collect()} == {(None, 1), ("too few fields", 1)}
    assert re.fullmatch("[a-z ]+", R.parse_records(df).where("error is not null").select(F.col("error.reason")).first()[0])


def test_records_of_whole_files(spark):
    r = random.Random(7)
    lines = []
    for k in range(300):
        f = io.StringIO()
        csv.writer(f, lineterminator="").writerow(["".join(r.choice('ab",\n\r é') for _ in range(r.randrange(12))) for _ in range(3)] + ["x"])
        lines.append(f.getvalue())
    files = [(1, "\n".join(lines) + "\n", "m"), (2, "\r\n".join(lines), "m"), (3, "\r".join(lines), "m"), (4, None, "m"), (5, "", "m"), (6, 'a\n\nb"c\nd\n"e\nf', "m")]
    df = spark.createDataFrame(files, "file_id long, content string, line string")
    got = {}
    for x in R.split_records(df).orderBy("file_id", "line_no").collect():
        got.setdefault(x.file_id, []).append(x)
    for k in (1, 2, 3):
        assert [x.line_ for x in got[k]] == lines
        assert [x.line_no for x in got[k]] == list(range(1, 301))
        data = files[k - 1][1].encode()
        assert all(data[x.offset :].startswith(x.line_.encode()) for x in got[k])
        assert {x.line for x in got[k]} == {"m"}
    assert [(x.line_no, x.line_) for x in got[6]] == [(1, "a"), (3, 'b"c'), (4, "d"), (5, '"e\nf')]
    assert set(got) == {1, 2, 3, 6}
    parsed = R.parse_records(R.split_records(df.where("file_id = 6").drop("line")))
    assert {x.error.reason for x in parsed.where("error is not null").collect()} == {"quote inside a plain field", "too few fields", "quote never closed"}


def test_other_layouts_and_unread_fields(spark):
    layout = (R.Field("k", "integer", True, 1, 9), R.Field("day", "date"), R.Field("x", "number"), R.Field("note"))
    lines = ["1,2020-02-29,1.5,a", "12,2020-01-01,1,b", "x,2020-01-01,1,c", "2,soon,oops,d", "3,,,e", "4,2020-01-01,1", " 5 ,1999-12-31,1e400,"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "n int, line string")
    out = {r.n: r for r in R.parse_records(df, number_col=None, layout=layout).collect()}
    assert {k: r.error.reason for k, r in out.items() if r.error} == {1: "out of range", 2: "not a number", 5: "too few fields"}
    assert (tuple(out[0].record), out[0].unread) == ((1, dt.date(2020, 2, 29), 1.5, "a"), [])
    assert (tuple(out[3].record), out[3].unread, out[1].unread) == ((2, None, None, "d"), ["day", "x"], None)
    assert (tuple(out[4].record), out[4].unread) == ((3, None, None, "e"), [])
    assert R.valid_records(R.parse_records(df, number_col=None, layout=layout)).columns == ["k", "day", "x", "note", "n", "line"]
