import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brinegrid.operators import hotdeck as H
from brinegrid.operators.hotdeck import fill_from_similar

SCHEMA = "obs_id long, MMSI string, timestamp timestamp_ntz, lat double, lon double, sst double, sst_missing boolean"
T = dt.datetime(2015, 3, 1)
NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def at(h):
    return T + dt.timedelta(hours=h)


def by_id(df):
    return {r.obs_id: r.fill for r in df.collect()}


def test_every_kind_of_gap(spark):
    rows = [
        (1, "7", at(0), 10.0, 20.0, 15.0, False),
        (2, " 7.0 ", at(2), 10.2, 20.2, 16.0, False),
        (3, "7", at(1), None, 20.1, 15.5, False),
        (4, "7", at(1), 0.0, 0.0, 15.5, False),
        (5, "7", at(1), 10.1, 20.1, NAN, False),
        (6, "7", at(1), 10.1, 20.1, 15.4, True),
        (7, "7", at(1), 10.1, 20.1, 15.4, None),
        (8, None, at(1), 95.0, 361.0, 15.4, False),
        (9, "", None, None, NAN, None, None),
    ]
    got = by_id(fill_from_similar(frame(spark, rows), neighbours=1))
    fields = {k: sorted(m.field for m in f.marks) for k, f in got.items()}
    assert fields == {1: [], 2: [], 3: ["lat"], 4: ["lat", "lon"], 5: ["sst"], 6: ["sst"], 7: ["sst_missing"], 8: ["lat", "lon"], 9: ["lat", "lon", "sst", "sst_missing"]}
    assert got[3].lat in (10.0, 10.1, 10.2)
    assert {m.level for m in got[3].marks} == {"vessel"}
    assert set(got[3].marks[0].donors) <= {1, 2, 5, 6, 7}
    assert got[7].flag is True  # that of 6, at the same place and time
    assert sorted(got[7].marks[0].donors) == [2, 6]
    assert {m.level for m in got[8].marks} == {"similar"}
    assert {m.level for m in got[9].marks} == {"global"}
    assert all(f.lat is not None and f.lon is not None and f.value is not None and f.flag is not None for f in got.values())


def test_place_gives_the_value(spark):
    rows = [(k, str(k), at(k), 10.5, 20.5, 15.0, False) for k in range(4)] + [(9, "99", at(2), 10.6, 20.6, None, True)]
    f = by_id(fill_from_similar(frame(spark, rows)))[9]
    assert (f.value, f.marks[0].level) == (15.0, "place")


def test_date_line(spark):
    rows = [(1, "7", at(0), 1.0, 179.9, 15.0, False), (2, "7", at(1), 1.0, None, 15.0, False), (3, "7", at(2), 1.0, 180.1, 15.0, False)]
    f = by_id(fill_from_similar(frame(spark, rows)))[2]
    assert abs(abs(f.lon) - 180) <= 0.1 + 1e-9


def test_empty_and_hopeless(spark):
    assert fill_from_similar(frame(spark, [])).count() == 0
    f = by_id(fill_from_similar(frame(spark, [(1, "7", at(0), None, None, None, None)])))[1]
    assert {m.level for m in f.marks} == {"none"}
    assert f.value is None


def test_extra_and_clashing_columns(spark):
    df = frame(spark, [(1, "7", at(0), 1.0, 2.0, 3.0, False), (2, "7", at(1), None, 2.0, 3.0, False)]).withColumns({"fill": F.lit("x"), "block": F.lit(1), "rec": F.lit(None).cast("string"), "v": F.array(F.lit(1)), "la": F.lit(5)})
    out = fill_from_similar(df)
    assert out.columns == [*df.columns, "fill_"]
    assert {r.obs_id: (r.fill, r.la) for r in out.collect()} == {1: ("x", 5), 2: ("x", 5)}


def test_repeated_rows_are_kept(spark):
    rows = [(1, "7", at(0), 1.0, 2.0, 3.0, False)] * 3 + [(2, "7", at(0), None, 2.0, 3.0, False)] * 2
    out = fill_from_similar(frame(spark, rows))
    assert out.count() == 5
    assert out.where("obs_id = 2 and fill.lat = 1.0").count() == 2


def test_rows_without_time_take_donors_too(spark):
    far = [(k, "far", at(k), 60.0 + k / 100, -100.0, 2.0 + k / 100, False) for k in range(100, 140)]
    own = [(1, "7", at(0), 10.0, 20.0, 15.0, False), (2, "7", at(1), 11.0, 21.0, 16.0, False), (3, "7", None, 12.0, 22.0, 17.0, False)]
    late = [(11, "7", None, None, 21.1, 16.1, False), (12, "7", None, None, None, None, None), (13, None, None, 10.1, 20.1, None, None), (14, "x", None, None, None, 15.2, False), (15, "y", None, 60.9, None, None, None), (16, "z", None, None, None, None, False)]
    got = by_id(fill_from_similar(frame(spark, far + own + late), neighbours=1))
    marks = {k: {m.field: (m.level, sorted(m.donors)) for m in got[k].marks} for k in range(11, 17)}
    assert (marks[11], got[11].lat) == ({"lat": ("vessel", [2, 3])}, 11.0)
    assert {l for l, _ in marks[12].values()} == {"vessel"}
    assert (10.0 <= got[12].lat <= 12.0, 15.0 <= got[12].value <= 17.0, got[12].flag) == (True, True, False)
    assert (marks[13]["sst"][0], got[13].value, got[13].flag) == ("place", 15.0, False)
    assert (marks[14]["lat"], got[14].lat) == (("similar", [1, 2]), 10.0)
    assert marks[15]["sst"][0] == "similar" and got[15].value < 4
    assert {l for l, _ in marks[16].values()} == {"global"}


@pytest.fixture(scope="module")
def random_rows():
    r = random.Random(3)
    rows = []
    for k in range(600):
        v = r.choice(["1", "1", "1", "2", "3", None])
        rows.append((k, v, at(r.randrange(2000)), r.choice([None, r.uniform(-5, 5), r.uniform(-5, 5)]), r.uniform(-5, 5), r.choice([None, 10 + r.random()]), r.choice([None, False])))
    return rows


def test_where_partitions_are_cut_changes_nothing(spark, random_rows):
    """One block or a few rows to a partition, read whole or a few rows at a time: the donors are the same."""
    df = frame(spark, random_rows)
    key = lambda d: sorted((r.obs_id, str(r.fill)) for r in d.collect())
    plain = key(fill_from_similar(df))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        assert key(fill_from_similar(df)) == plain
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def brute_found(rows, k):
    """For every (block, kind, side): the k nearest donors of each seeker, by plain Python. rows: (block, x, gives, want)."""
    out = {}
    for i, (block, x, gives, want) in enumerate(rows):
        for c in range(6):
            if want >> c & 1:
                own = [j for j, r in enumerate(rows) if r[0] == block and r[2][c // 2]]
                out[i, c] = [j for j in own if j > i][:k] if c % 2 else [j for j in reversed(own) if j < i][:k]
    return out


@pytest.mark.parametrize("seed", range(25))
def test_scan_in_parts_equals_brute_force(seed, monkeypatch):
    """Rows of several partitions, each read in small parts, with a second step for their ends."""
    r = random.Random(seed)
    n, k = r.randrange(1, 120), r.randrange(1, 4)
    rows = []
    for block in sorted(r.randrange(r.choice([2, 12])) for _ in range(n)):
        gives = [r.random() < r.choice([0.05, 0.7]) for _ in range(3)]
        rows.append((block, len(rows), gives, sum(3 << (2 * c) for c in range(3) if not gives[c] and r.random() < 0.4)))
    fields = [("block", pa.int64()), ("x", pa.int64()), ("level", pa.string()), ("o", pa.int64()), ("v", pa.int64()), ("t", pa.int64()), ("la", pa.float64()), ("lo", pa.float64()), ("s", pa.float64()), ("f", pa.bool_())]
    item = pa.struct([("kind", pa.int32()), ("level", pa.string()), ("o", pa.int64()), ("t", pa.int64()), ("la", pa.float64()), ("lo", pa.float64()), ("s", pa.float64()), ("f", pa.bool_())])
    schema = pa.schema([*fields, ("lack", pa.int32()), ("end", pa.bool_()), ("c", pa.list_(item))])
    full = [dict(block=b, x=x, level="v", o=x, v=0, t=x, la=1.0 if g[0] else None, lo=1.0 if g[0] else None, s=1.0 if g[1] else None, f=True if g[2] else None, give=True, want=w) for b, x, g, w in rows]
    types = pa.schema([*fields, ("give", pa.bool_()), ("want", pa.int32())])

    def scan(part, final):
        s, out = H._Scan(k, schema, final), []
        while part:
            m = r.randrange(1, 30)
            out += [x for b in s.step(pa.Table.from_pylist(part[:m], types)) for x in b.to_pylist()]
            part = part[m:]
        return out + [x for b in s.step(None) for x in b.to_pylist()]

    first, left = [], full
    while left:
        m = r.randrange(1, 60)
        first += scan(left[:m], False)
        left = left[m:]
    rest = sorted(({**{c: x[c] for c, _ in fields}, "give": x["end"], "want": x["lack"]} for x in first if x["end"] or x["lack"]), key=lambda x: (x["block"], x["x"]))
    got = {}
    for x in [x for x in first if not x["end"]] + scan(rest, True):
        for d in x["c"]:
            got.setdefault((x["o"], d["kind"] * 2 + (d["o"] > x["o"])), []).append(d["o"])
    want = {key: sorted(v) for key, v in brute_found(rows, k).items() if v}
    assert {key: sorted(v) for key, v in got.items()} == want
    assert sorted(x["o"] for x in first if not x["end"]) == [x for _, x, _, w in rows if w]


@pytest.mark.parametrize("k", [1, 3])
def test_donors_are_the_nearest_in_time(spark, random_rows, k):
    """Latitudes of known vessels: all donors used are among the k nearest on each side, the closest of them, and the value is one of theirs."""
    got = by_id(fill_from_similar(frame(spark, random_rows), neighbours=k))
    order = lambda x: (x[2], x[0])
    for row in random_rows:
        if row[3] is None and row[1] is not None:
            donors = sorted((x for x in random_rows if x[1] == row[1] and x[3] is not None), key=order)
            near = [x for x in donors if order(x) < order(row)][-k:] + [x for x in donors if order(x) > order(row)][:k]
            far = lambda x: abs((x[2] - row[2]).total_seconds()) / 3600 / 6 + 2 * abs(x[4] - row[4]) + (abs(x[5] - row[5]) if x[5] and row[5] else 0)
            want = [x[0] for x in sorted(near, key=lambda x: (far(x), x[0]))]
            mark = next(m for m in got[row[0]].marks if m.field == "lat")
            assert len(mark.donors) == min(4, len(near))
            assert set(mark.donors) <= set(want)
            if k == 1:
                assert set(mark.donors) == set(want)
            assert got[row[0]].lat in {x[3] for x in near}


def test_many_strays_take_the_other_way(spark, monkeypatch):
    far = [(k, "far", at(k), 60.0 + k / 100, -100.0, 2.0 + k / 100, False) for k in range(100, 140)]
    own = [(1, "7", at(0), 10.0, 20.0, 15.0, False), (2, "7", at(1), 11.0, 21.0, 16.0, False), (3, "7", None, 12.0, 22.0, 17.0, False)]
    late = [(11, "7", None, None, 21.1, 16.1, False), (12, "7", None, None, None, None, None), (13, None, None, 10.1, 20.1, None, None), (14, "x", None, None, None, 15.2, False), (15, "y", None, 60.9, None, None, None), (16, "z", None, None, None, None, False), (17, "w", at(3), None, None, None, None), (18, None, at(5), None, None, 3.3, None)]
    key = lambda: sorted((r.obs_id, str(r.fill)) for r in fill_from_similar(frame(spark, far + own + late)).collect())
    plain = key()
    monkeypatch.setattr(H, "FEW_STRAYS", 0)
    assert key() == plain


def test_other_types(spark):
    rows = [(1, "7", at(0), 1.0, 2.0, 3.0, False), (2, "7", at(1), None, 2.0, 3.0, False), (3, "8", None, None, None, None, None)]
    df = frame(spark, rows).select(F.concat(F.lit("id"), "obs_id").alias("obs_id"), F.col("MMSI").cast("long").alias("MMSI"), F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("lat").cast("float").alias("lat"), F.col("lon").cast("decimal(9,4)").alias("lon"), "sst", "sst_missing")
    got = by_id(fill_from_similar(df))
    assert (got["id2"].lat, list(got["id2"].marks[0].donors)) == (1.0, ["id1"])
    assert [m.level for m in got["id3"].marks] == ["global"] * 4
    daily = by_id(fill_from_similar(df.withColumn("timestamp", F.col("timestamp").cast("date"))))
    assert daily["id2"].lat == 1.0


def test_held_out_values_are_filled_better_than_by_the_median(spark):
    """Readings and positions of the driver's table are hidden and filled again."""
    v = spark.read.parquet("/root/testdata/sf0.01/vessel_points.parquet").select("obs_id", "MMSI", "timestamp", "lat", "lon", "sst", "sst_missing")
    v = v.where("lat between -90 and 90 and lon between -180 and 180 and sst between -2.5 and 40 and not sst_missing and not (lat = 0 and lon = 0) and timestamp is not null").cache()
    hide = F.pmod(F.xxhash64("obs_id"), F.lit(20))
    gaps = v.withColumn("sst", F.when(hide != 0, F.col("sst"))).withColumn("lat", F.when(hide != 1, F.col("lat")))
    f = fill_from_similar(gaps).select("obs_id", "fill.*").join(v.select("obs_id", "lat", "sst").toDF("obs_id", "true_lat", "true_sst"), "obs_id")
    middle = v.agg(F.percentile("sst", 0.5).alias("sst"), F.percentile("lat", 0.5).alias("lat")).first()
    err = lambda a, b: F.avg(F.abs(a - F.col(b)))
    s = f.where(hide == 0).agg(err(F.col("value"), "true_sst").alias("own"), err(F.lit(middle.sst), "true_sst").alias("median")).first()
    p = f.where(hide == 1).agg(err(F.col("lat"), "true_lat").alias("own"), err(F.lit(middle.lat), "true_lat").alias("median")).first()
    print(s, p)
    assert s.own < 0.6 * s.median
    assert p.own < p.median
