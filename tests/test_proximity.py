import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from brinegrid.operators import proximity as P

T = dt.datetime(2016, 5, 1)
SCHEMA = "obs_id long, MMSI string, timestamp timestamp_ntz, lat double, lon double"


def km(a, b):
    y1, x1, y2, x2 = map(math.radians, (a[3], a[4], b[3], b[4]))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * P.EARTH_KM * math.asin(min(1, math.sqrt(h)))


def brute(rows, limit=1.0, minutes=10):
    ok = [r for r in rows if r[1] and r[1].strip() and r[2] and r[3] is not None and r[4] is not None and -90 <= r[3] <= 90 and -180 <= r[4] <= 360 and not (r[3] == 0 and r[4] == 0)]
    v = lambda r: r[1].strip().removesuffix(".0")
    return {(min(a[0], b[0]), max(a[0], b[0])) for k, a in enumerate(ok) for b in ok[:k] if a[0] != b[0] and v(a) != v(b) and abs(a[2] - b[2]) <= dt.timedelta(minutes=minutes) and km(a, b) <= limit}


def found(spark, rows, **kw):
    got = [(r.obs_a, r.obs_b) for r in P.pairs_within(spark.createDataFrame(rows, SCHEMA), **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("centre", [(0.05, 0.001), (10.0, 180.0), (-59.95, -0.0), (89.995, 50.0), (-89.999, 200.0), (45.1, 359.99), (89.2, -179.9)])
def test_pairs_equal_brute_force(spark, centre):
    r = random.Random(str(centre))
    rows = []
    for k in range(150):
        lat = centre[0] + r.uniform(-0.02, 0.02)
        lon = centre[1] + r.uniform(-0.02, 0.02) / max(0.01, math.cos(math.radians(min(89.9, abs(lat)))))
        if abs(lat) > 90:
            lat = math.copysign(180 - abs(lat), lat)
            lon += 180
        lon = (lon + 180) % 360 - 180
        rows.append((k, r.choice(["1", "1.0", " 2", "3", "4", None, " "]), T + dt.timedelta(seconds=r.randrange(0, 5400)), lat, lon if r.random() < 0.5 or lon >= 0 else lon + 360))
    want = brute(rows)
    assert want
    assert found(spark, rows) == want


def test_limits_are_included(spark):
    one_km = math.degrees(1.0 / P.EARTH_KM) * (1 - 1e-12)
    rows = [(1, "a", T, 0.0, 10.0), (2, "b", T + dt.timedelta(minutes=10), one_km, 10.0), (3, "c", T + dt.timedelta(minutes=20, microseconds=1), one_km, 10.0), (4, "d", T, 0.0, 10.0 + 1.01 * one_km)]
    assert found(spark, rows) == {(1, 2)}


def test_left_out_rows(spark):
    rows = [(1, "a", T, 1.0, 1.0), (2, None, T, 1.0, 1.0), (3, "  ", T, 1.0, 1.0), (4, "b", None, 1.0, 1.0), (5, "c", T, float("nan"), 1.0), (6, "d", T, None, 1.0), (7, "e", T, 0.0, 0.0), (8, "f", T, 0.0, 0.0), (9, "a.0", T, 1.0, 1.0), (10, "g", T, 1.0, 361.0)]
    assert found(spark, rows) == set()
    assert found(spark, []) == set()


def test_ties_repeats_and_extra_columns(spark):
    rows = [(1, "a", T, 1.0, 1.0), (2, "b", T, 1.0, 1.0), (2, "b", T, 1.0, 1.0), (1, "c", T, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"s": F.lit(1), "c": F.lit("x"), "edge": F.lit(2), "id": F.lit(3)})
    assert {(r.obs_a, r.obs_b) for r in P.pairs_within(df).collect()} == {(1, 2)}


@pytest.mark.parametrize(("km_", "minutes", "spread", "strip"), [(30, 90, 1, 0.1), (3000, 60, 90, 5.0), (0.05, 600, 0.001, 0.1), (300, 0, 10, 1.0)])
def test_other_limits(spark, km_, minutes, spread, strip):
    r = random.Random(5)
    rows = [(k, str(k % 7), T + dt.timedelta(minutes=r.randrange(600)), r.uniform(-1, 1) * spread, r.uniform(-1, 1) * 2 * spread) for k in range(200)]
    assert found(spark, rows, km=km_, minutes=minutes, strip=strip) == brute(rows, km_, minutes)


def ring(name, pts):
    return [(name, a[0], a[1], b[0], b[1]) for a, b in zip(pts, [*pts[1:], pts[0]])]


EDGES = "region_id string, lat1 double, lon1 double, lat2 double, lon2 double"


def inside(spark, pts, edges, **kw):
    p = spark.createDataFrame([(k, *x) for k, x in enumerate(pts)], "k int, lat double, lon double")
    return {(r.k, r.region_id) for r in P.containing_regions(p, spark.createDataFrame(edges, EDGES), "k", **kw).collect()}


def test_square_with_hole_and_boundary(spark):
    e = ring("s", [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]) + ring("s", [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)])
    pts = [(0.5, 0.5), (2.0, 2.0), (0.0, 2.0), (4.0, 4.0), (2.0, 0.0), (5.0, 2.0), (2.0, -1.0), (1.0, 2.0), (0.0, 0.0), (2.0, 3.5)]
    assert inside(spark, pts, e) == {(k, "s") for k in (0, 2, 3, 4, 7, 8, 9)}
    assert inside(spark, pts, e, boundary=False) == {(0, "s"), (9, "s")}


def test_date_line_and_vertices(spark):
    e = ring("w", [(-1.0, 179.0), (1.0, 179.0), (2.0, 180.0), (1.0, 181.0), (-1.0, 181.0)])
    assert inside(spark, [(0.0, 179.5), (0.0, -179.5), (1.0, -179.9), (1.0, 170.0), (0.0, 178.9), (0.0, 180.5)], e) == {(0, "w"), (1, "w"), (2, "w"), (5, "w")}


def test_random_polygons(spark):
    r = random.Random(2)
    edges, polys = [], {}
    for n in range(5):
        c = (r.uniform(-20, 20), r.uniform(-20, 20))
        pts = [(c[0] + d * math.sin(a), c[1] + d * math.cos(a)) for a, d in ((k * math.pi / 6, r.uniform(1, 9)) for k in range(12))]
        polys[str(n)] = pts
        edges += ring(str(n), pts)
    points = [(r.uniform(-30, 30), r.uniform(-30, 30)) for _ in range(300)]

    def holds(poly, p):
        c = False
        for (y1, x1), (y2, x2) in zip(poly, [*poly[1:], poly[0]]):
            if (y1 <= p[0]) != (y2 <= p[0]) and x1 + (p[0] - y1) / (y2 - y1) * (x2 - x1) > p[1]:
                c = not c
        return c

    r.shuffle(edges)
    assert inside(spark, points, edges + edges[:5]) == {(k, n) for k, p in enumerate(points) for n, poly in polys.items() if holds(poly, p)}


def test_no_regions(spark):
    assert inside(spark, [(0.0, 0.0), (None, 1.0), (float("nan"), 1.0)], []) == set()
    assert inside(spark, [], ring("s", [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0)])) == set()


def test_the_parity_decides(spark, monkeypatch):
    """Without crossings nothing is inside anything; with one for both sides of a box, nothing is near anything."""
    rows = [(1, "a", T, 1.0, 1.0), (2, "b", T, 1.0, 1.0005)]
    e = ring("s", [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)])
    assert (found(spark, rows), inside(spark, [(2.0, 2.0)], e)) == ({(1, 2)}, {(0, "s")})
    for made in (0, 1):
        monkeypatch.setattr(P, "crossing", lambda *a, made=made: F.lit(made))
        assert found(spark, rows) == set()
        assert made or inside(spark, [(2.0, 2.0)], e) == set()


def test_shuffled_regions_equal_sent_ones(spark):
    r = random.Random(8)
    edges = []
    for n in range(12):
        c = (r.uniform(-60, 60), r.uniform(-180, 180))
        edges += ring(f"r{n}", [(c[0] + 25 * math.sin(k), c[1] + r.uniform(5, 60) * math.cos(k)) for k in range(6)])
    pts = [(r.uniform(-89, 89), r.uniform(-180, 360)) for _ in range(300)] + [(c[1], c[2]) for c in edges[:20]]
    sent = inside(spark, pts, edges)
    assert sent and sent == inside(spark, pts, edges, few_edges=0, strip=3.0, cell=7.0)


def test_a_hot_bin_is_split(spark):
    """One hour and place with most rows: the join is split where it is skewed, and the pairs stay the same."""
    rows = [(k, str(k % 3000), T + dt.timedelta(seconds=k % 3000), 10.0 + (k % 997) / 20000, 20.0 + (k % 991) / 20000) for k in range(4000)]
    rows += [(10_000 + k, str(k), T + dt.timedelta(hours=k), -40.0, float(k)) for k in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = sorted(map(tuple, P.pairs_within(df, minutes=0.1).select("obs_a", "obs_b").collect()))
    # partitions of a few KB, so that this one counts as skewed
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        out = P.pairs_within(df.repartition(8), minutes=0.1).select("obs_a", "obs_b")
        split = sorted(map(tuple, out.collect()))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert plain and split == plain
    assert "skew=true" in plan
