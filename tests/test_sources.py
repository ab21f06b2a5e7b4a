import datetime as dt
import gzip
import json
import struct
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brinegrid.sources import csv_union, discover, http_lookup, sinks
from brinegrid.sources.grid_source import GridDataSource, NetCDF, decode_times, open_store, unblosc, write_netcdf


def text(path, s):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(s)
    return str(path)


@pytest.fixture
def fleet(tmp_path):
    pre = discover.FLEET_PREFIX
    text(tmp_path / f"{pre}2012" / "sub" / "a.CSV", "x,y\n1,2\n")
    text(tmp_path / f"{pre}2013" / "b.csv", "y,z\n3,4\n")
    text(tmp_path / f"{pre}2013" / "readme.txt", "no")
    text(tmp_path / "loose.csv", "x\n9\n")
    text(tmp_path / "combined.csv", "x\n8\n")
    with zipfile.ZipFile(tmp_path / f"{pre}2014.zip", "w") as z:
        z.writestr("d/x.CSV", 'w,x\n"5, ""five""\nmore",6\n')
        z.writestr("y.csv", "")
        z.writestr("readme.txt", "no")
    (tmp_path / f"{pre}2015.zip").write_bytes(b"not a zip")
    return tmp_path


def test_discover(spark, fleet):
    names = lambda **kw: [(s.kind, s.path.rsplit("/", 1)[-1]) for s in discover.discover_sources(spark, str(fleet), **kw)]
    assert names(years="2012-2014") == [("zip", f"{discover.FLEET_PREFIX}2014.zip"), ("file", "a.CSV"), ("file", "b.csv")]
    assert names(years="2013") == [("file", "b.csv")]
    assert ("file", "loose.csv") in names(loose=True)
    assert ("file", "combined.csv") not in names(loose=True, exclude=["somewhere/combined.csv"])
    assert discover.discover_sources(spark, str(fleet / "absent")) == []


def test_years():
    assert discover.expand_years("2012, ,2014-2016") == ["2012", "2014", "2015", "2016"]
    assert discover.years_of_files(["a/combined_2015.csv", "combined_2013.csv", "x"]) == [2013, 2015]
    assert discover.years_of_files([]) == list(range(2012, 2020))
    assert discover.grid_files_of_year(["q_mean_201501.nc", "q_mean_201401.nc"], 2015) == ["q_mean_201501.nc"]
    assert discover.daily_path("s/{year}/{month}/{day}", dt.date(2015, 2, 3)) == "s/2015/02/03"


def test_union_of_headers_and_archives(spark, fleet):
    df = csv_union.read_sources(spark, discover.discover_sources(spark, str(fleet)))
    assert df.columns == ["w", "x", "y", "z"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([('5, "five"\nmore', "6", None, None), (None, "1", "2", None), (None, None, "3", "4")], key=str)
    zips = [s.path for s in discover.discover_sources(spark, str(fleet)) if s.kind == "zip"]
    assert sorted(r.member for r in csv_union.zip_members(spark, zips).collect()) == ["d/x.CSV", "y.csv"]
    assert csv_union.read_sources(spark, []).count() == 0
    assert csv_union.aligned(df, ["z", "q"]).columns == ["z", "q"]


def test_headers(spark, tmp_path):
    assert csv_union.read_header(spark, text(tmp_path / "e.csv", "")) == []
    assert csv_union.read_header(spark, text(tmp_path / "b.csv", '﻿a,"b, c"\n1,2\n')) == ["a", "b, c"]
    assert csv_union.union_columns([["b", "a"], ["c", "a"]]) == ["b", "a", "c"]


def test_many_headers_equal_single_ones(spark, tmp_path):
    paths = [text(tmp_path / f"p {k}" / "a.csv", f'c{k % 3},"d e"\n1,2\n') for k in range(12)] + [text(tmp_path / "empty.csv", "")]
    assert csv_union.read_headers(spark, paths, few=3) == csv_union.read_headers(spark, paths)
    df = csv_union.read_csv_files(spark, paths)
    assert (df.count(), set(df.columns)) == (12, {"c0", "c1", "c2", "d e"})


def test_multiline_and_doubled_quotes(spark, tmp_path):
    p = text(tmp_path / "m.csv", 'a,b\n"x ""y""\nz",1\n')
    assert [tuple(r) for r in csv_union.read_csv_files(spark, [p], multiline=True).collect()] == [('x "y"\nz', "1")]


def test_first_rows(spark, tmp_path):
    a = text(tmp_path / "a.csv", "x\n" + "".join(f"{k}\n" for k in range(50)))
    b = text(tmp_path / "b.csv", "y\n1\n")
    df = csv_union.first_rows_per_file(spark, [a, b], 10)
    assert sorted(int(r.x) for r in df.where("x is not null").collect()) == list(range(10))
    assert df.count() == 11


LATS, LONS = np.array([0.0, 1.0, 2.0]), np.array([10.0, 20.0])
DATA = np.arange(2 * 2 * 3 * 2, dtype="f4").reshape(2, 2, 3, 2)
DATA[0, 1, 2, 1] = -999


def netcdf(path, record):
    write_netcdf(
        str(path),
        {"time": 2, "depth": 2, "latitude": 3, "longitude": 2},
        {
            "time": (("time",), np.array([0.0, 24.0]), {"units": "hours since 2015-01-01 12:00:00"}),
            "depth": (("depth",), np.array([5.0, 0.5], "f4"), {}),
            "latitude": (("latitude",), LATS, {}),
            "longitude": (("longitude",), LONS, {}),
            "other": (("time",), np.array([1, 2], "i2"), {}),
            "thetao": (("time", "depth", "latitude", "longitude"), DATA, {"_FillValue": np.float32(-999), "scale_factor": np.float64(0.5)}),
        },
        record,
    )
    return str(path)


def zarr(path, how):
    def arr(name, a, chunks, attrs, dims):
        d = path / name
        d.mkdir(parents=True)
        (d / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": chunks, "dtype": a.dtype.str, "compressor": {"id": how} if how else None, "fill_value": "NaN" if a.dtype.kind == "f" else 0, "order": "C", "filters": None}))
        (d / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims, **attrs}))
        for idx in np.ndindex(*[-(-s // c) for s, c in zip(a.shape, chunks)]):
            block = np.full(chunks, 0, a.dtype)
            part = a[tuple(slice(k * c, (k + 1) * c) for k, c in zip(idx, chunks))]
            block[tuple(slice(0, s) for s in part.shape)] = part
            raw = block.tobytes()
            raw = zlib.compress(raw) if how == "zlib" else gzip.compress(raw) if how == "gzip" else raw
            (d / ".".join(map(str, idx))).write_bytes(raw)

    arr("time", np.array([0, 1], "i8"), [2], {"units": "days since 2015-01-01"}, ["time"])
    arr("lat", LATS, [2], {}, ["lat"])
    arr("lon", LONS, [2], {}, ["lon"])
    arr("sst", np.where(DATA[:, 1] == -999, np.nan, DATA[:, 1]).astype("<f8"), [1, 2, 2], {}, ["time", "lat", "lon"])
    return str(path)


@pytest.mark.parametrize("record", [None, "time"])
def test_netcdf(spark, tmp_path, record):
    p = netcdf(tmp_path / "a.nc", record)
    nc = NetCDF(p)
    assert np.array_equal(nc.read("thetao"), DATA)
    assert nc.read("other").tolist() == [1, 2]
    spark.dataSource.register(GridDataSource)
    r = spark.read.format("brine_grid").option("path", p)
    df = r.load()
    assert df.rdd.getNumPartitions() == 2
    got = {(x.ti, x.j, x.i): x.v for x in df.collect()}
    assert len(got) == 12
    assert got[(0, 0, 1)] == DATA[0, 1, 0, 1] * 0.5
    assert got[(0, 2, 1)] is None
    assert df.where("ti = 1").first().t == dt.datetime(2015, 1, 2, 12)
    assert {x.v for x in r.option("depth_index", "0").option("bbox", "1,2,10,10").load().where("ti = 0").collect()} == {DATA[0, 0, 1, 0] * 0.5, DATA[0, 0, 2, 0] * 0.5}


@pytest.mark.parametrize("how", [None, "zlib", "gzip"])
def test_zarr(spark, tmp_path, how):
    p = zarr(tmp_path / "g.zarr", how)
    spark.dataSource.register(GridDataSource)
    got = {(x.ti, x.j, x.i): x.v for x in spark.read.format("brine_grid").option("path", p).load().collect()}
    assert len(got) == 12
    assert got[(1, 2, 0)] == DATA[1, 1, 2, 0]
    assert got[(0, 2, 1)] is None


def test_unreadable_arrays(tmp_path):
    (tmp_path / "h.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 50)
    with pytest.raises(ValueError, match="HDF5"):
        open_store(str(tmp_path / "h.nc"))
    with pytest.raises(ValueError, match="quantize"):
        open_store(zarr(tmp_path / "z.zarr", "quantize")).read("sst")
    with pytest.raises(ValueError, match="units"):
        decode_times(np.array([1]), "fortnights after 1900")


def test_http(spark):
    def fetch(url):
        k = int(url.rsplit("/", 1)[-1])
        if k == 3:
            raise OSError("down")
        return (404, "404 none") if k == 2 else (200, '{"flag": true, "v": [%d.5]}' % k)

    df = spark.createDataFrame([(k, f"http://x.invalid/{k}") for k in range(6)], "k int, url string")
    out = {r.k: r for r in http_lookup.fetch_rows(df, fetch, rate=1000, workers=2, backoff=0.01).collect()}
    assert [out[k].sst_wmts for k in range(6)] == [0.5, 1.5, None, None, 4.5, 5.5]
    assert (out[2].status, out[2].attempts, out[2].error) == (404, 1, None)
    assert (out[3].status, out[3].attempts, out[3].error) == (None, 3, "OSError: down")


def test_http_rate(spark):
    df = spark.createDataFrame([(f"u/{k}",) for k in range(8)], "url string").coalesce(1)
    began = time.monotonic()
    http_lookup.fetch_rows(df, lambda u: (200, "1"), rate=20, workers=1)
    assert time.monotonic() - began >= 7 / 20


def test_auth(monkeypatch):
    assert http_lookup.basic_auth("NO_SUCH_USER", "NO_SUCH_PASS") == {}
    monkeypatch.setenv("U_TEST", "a")
    monkeypatch.setenv("P_TEST", "b")
    assert http_lookup.basic_auth("U_TEST", "P_TEST") == {"Authorization": "Basic YTpi"}


def test_year_sink_replaces(spark, tmp_path):
    out = str(tmp_path / "years")
    df = spark.createDataFrame([(dt.datetime(2012 + k % 3, 1, 1), k) for k in range(30)], "timestamp timestamp_ntz, k int")
    sinks.write_by_year(df, out)
    sinks.write_by_year(df.where("year(timestamp) = 2013"), out)
    back = spark.read.parquet(out)
    assert back.count() == 30
    plan = back.where(F.col("year") == 2013)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def blosc(data: bytes, size: int, block: int, codec: int, how: str | None, flags: int) -> bytes:
    """A blosc 1 buffer, as the format is described."""
    offsets, body, at = [], b"", 16 + 4 * -(-len(data) // block)
    for k in range(0, len(data), block):
        b = np.frombuffer(data[k : k + block], np.uint8)
        n = len(b)
        if flags & 1:
            m = n // size * size
            b = np.concatenate([b[:m].reshape(-1, size).T.ravel(), b[m:]])
        elif flags & 4:
            m = n // size // 8 * 8 * size
            bits = np.unpackbits(b[:m].reshape(-1, size), axis=1, bitorder="little")
            b = np.concatenate([np.packbits(bits.T, axis=1, bitorder="little").ravel(), b[m:]])
        streams = size if not flags & 16 and block // size >= 128 and n == block else 1
        offsets.append(at + len(body))
        for part in np.split(b, streams):
            raw = part.tobytes()
            packed = zlib.compress(raw) if how == "zlib" else pa.compress(raw, how, asbytes=True)
            packed = packed if len(packed) < len(raw) else raw
            body += struct.pack("<i", len(packed)) + packed
    total = at + len(body)
    return struct.pack("<BBBBIII", 2, 1, flags | codec << 5, size, len(data), block, total) + struct.pack(f"<{len(offsets)}i", *offsets) + body


@pytest.mark.parametrize(("codec", "how"), [(1, "lz4_raw"), (2, "snappy"), (3, "zlib"), (4, "zstd")])
@pytest.mark.parametrize("flags", [0, 1, 4, 16, 17])
def test_blosc(codec, how, flags):
    rng = np.random.default_rng(1)
    for n, block in ((3000, 8192), (1000, 8000), (7, 8192), (1025, 2048)):
        data = np.round(rng.normal(10, 3, n), 1).tobytes()
        assert unblosc(blosc(data, 8, block, codec, how, flags)) == data
    plain = struct.pack("<BBBBIII", 2, 1, 2, 8, 5, 5, 21) + b"12345"
    assert unblosc(plain) == b"12345"
    with pytest.raises(ValueError, match="blosclz"):
        unblosc(struct.pack("<BBBBIII", 2, 1, 1, 8, 8, 8, 30) + b"\0" * 14)


@pytest.mark.parametrize("record", [None, "time"])
def test_windows_equal_slices(tmp_path, record):
    p = netcdf(tmp_path / "w.nc", record)
    a = open_store(p)
    b = open_store(zarr(tmp_path / "w.zarr", "zlib"))
    for store, name in ((a, "thetao"), (a, "other"), (a, "depth"), (b, "sst"), (b, "lat")):
        whole = store.read(name)
        for window in (((1, 2),), ((0, 2), (1, 2)), ((0, 1), (0, 1), (1, 3)), tuple((0, n) for n in whole.shape), tuple((n - 1, n) for n in whole.shape), ((1, 1),)):
            window = tuple((min(x, n), min(z, n)) for (x, z), n in zip(window, whole.shape))
            assert np.array_equal(store.read(name, window), whole[tuple(slice(*w) for w in window)], equal_nan=True)


def test_damaged_archives_and_members_are_told(spark, tmp_path):
    good, bad, torn = tmp_path / "a.zip", tmp_path / "b.zip", tmp_path / "c.zip"
    long = "q" * 200_000
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("x.csv", f'a,b\n1,2,3\n"{long}",5\n')
    bad.write_bytes(b"no archive at all")
    with zipfile.ZipFile(torn, "w") as z:
        z.writestr("y.csv", "a,b\n" + "7,8\n" * 50)
        z.writestr("z.csv", "a,c\n9,10\n")
    raw = bytearray(torn.read_bytes())
    at = raw.index(b"7,8")
    raw[at : at + 3] = b"6,6"  # its checksum no longer holds
    torn.write_bytes(bytes(raw))
    paths = [str(p) for p in (good, bad, torn)]
    rows = csv_union.read_zip_rows(spark, paths).collect()
    ok = {(r.member, r.row_no): r for r in rows if r.error is None}
    assert (ok["x.csv", 1].cells, ok["x.csv", 1].surplus) == ({"a": "1", "b": "2"}, ["3"])
    assert (ok["x.csv", 2].cells["a"], ok["z.csv", 1].cells) == (long, {"a": "9", "c": "10"})
    assert sorted((r.archive.rsplit("/", 1)[1], r.member) for r in csv_union.bad_sources(spark, paths).collect()) == [("b.zip", None), ("c.zip", "y.csv")]
    assert csv_union.read_sources(spark, [discover.Source("zip", p) for p in paths]).where("c = '10'").count() == 1


def test_rows_that_do_not_fit_their_header_are_kept(spark, tmp_path):
    p = text(tmp_path / "m.csv", "a,b\n1,2\n3,4,5\n6\n")
    got = sorted(map(tuple, csv_union.read_csv_files(spark, [p], misfits="line").collect()))
    assert got == [("1", "2", None), ("3", "4", "3,4,5"), ("6", None, "6")]
