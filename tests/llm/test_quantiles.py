import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinegrid.llm import quantiles as Q


def test_codes_keep_order():
    r = random.Random(1)
    xs = [0.0, -0.0, 1.0, 2.0, 0.5, 1 - 2**-24, 1 + 2**-23, 2**-126, 2**-149, 2**-130, -1.5, 3.4e38, -3.4e38, float("inf"), float("-inf"), 1e300]
    xs += [r.uniform(-50, 50) for _ in range(300)] + [2.0**k for k in range(-140, 128)] + [float(np.nextafter(np.float32(2.0**k), np.float32(0))) for k in range(-120, 127)] + [-(10.0 ** r.uniform(-40, 38)) for _ in range(200)]
    got = list(zip(xs, Q.encode(np.array(xs)).tolist()))
    with np.errstate(over="ignore"):
        singles = np.array([x for x, _ in got]).astype(np.float32).astype(np.float64)
    back = Q.decode(np.array([c for _, c in got]))
    assert np.array_equal(back, singles)
    order = np.argsort([c for _, c in got], kind="stable")
    assert (singles[order][1:] >= singles[order][:-1]).all()
    assert all(0 <= c < 2**32 for _, c in got)


def test_hash_equals_spark(spark):
    df = spark.createDataFrame([(0, 0), (5, 3), (2**31, 7), (123456789, 20)], "node long, level int").crossJoin(spark.range(5).select(F.col("id").cast("int").alias("r")))
    for x in df.withColumn("h", F.xxhash64("node", "level", "r")).collect():
        assert Q.node_hash(x.node, x.level, np.array([x.r]))[0] == x.h


def ranks(values, est):
    v = np.sort(np.float32(values).astype(float))
    return np.searchsorted(v, est, "left") / len(v), np.searchsorted(v, est, "right") / len(v)


def check(values, rows, eps=Q.EPSILON):
    for r in rows:
        low, high = ranks(values, r.value)
        assert low - eps <= r.q <= high + eps, (r, low, high)


QS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "negative"])
def test_rank_error(spark, kind):
    rng = np.random.default_rng(3)
    v = {"normal": rng.normal(15, 8, 20_000), "ties": rng.integers(0, 5, 20_000).astype(float), "wide": 10 ** rng.uniform(-30, 30, 20_000), "negative": -rng.exponential(3, 20_000)}[kind]
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    check(v, Q.quantiles(Q.sketch(df, "x"), QS).collect())


def test_merging_equals_one_pass_and_deletes(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, 6000)
    df = spark.createDataFrame([(k % 3, float(x)) for k, x in enumerate(v)], "part int, x double")
    cells = lambda s: sorted(map(tuple, s.collect()), key=str)
    one = Q.sketch(df, "x")
    parts = [Q.sketch(df.where(F.col("part") == k), "x") for k in range(3)]
    assert cells(Q.merge_sketches(parts)) == cells(one) == cells(Q.sketch(df, "x", chunk_rows=50))
    many = df.withColumn("g", F.when(F.col("part") != 1, F.concat(F.lit("g"), F.expr("hash(x) % 40"))))
    assert cells(Q.sketch(many, "x", by=["g", "part"], most_groups=2, chunk_rows=500)) == cells(Q.sketch(many, "x", by=["g", "part"]))
    assert cells(Q.drop_column_from_sketch(Q.sketch(df, "x", by=["part"]), "part")) == cells(one)
    signed = df.withColumn("w", F.lit(1)).unionByName(df.where("part = 2").withColumn("w", F.lit(-1)))
    assert cells(Q.sketch(signed, "x", weight="w")) == cells(Q.merge_sketches(parts[:2]))
    gone = df.withColumn("w", F.lit(1)).unionByName(df.withColumn("w", F.lit(-1)))
    assert Q.sketch(gone, "x", weight="w").count() == 0


def test_groups_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None), ("b", float("nan")), ("c", float("inf")), ("c", float("-inf"))], "g string, x double").withColumns({"extra": F.lit(1), "cell": F.lit("x")})
    got = {(r.g, r.q): (r.n, r.value) for r in Q.quantiles(Q.sketch(df, "x", by=["g"]), [0.0, 1.0], by=["g"]).collect()}
    assert got == {("a", 0.0): (2, 1.0), ("a", 1.0): (2, 3.0), (None, 0.0): (1, 5.0), (None, 1.0): (1, 5.0), ("c", 0.0): (2, float("-inf")), ("c", 1.0): (2, float("inf"))}
    assert Q.quantiles(Q.sketch(df.limit(0), "x", by=["g"]), [0.5], by=["g"]).count() == 0
    with pytest.raises(ValueError, match="name"):
        Q.sketch(df, "x", by=["cell"])
    with pytest.raises(ValueError, match="0..1"):
        Q.quantiles(Q.sketch(df, "x"), [1.5])


def test_sketch_levels_really_use_the_signed_rows(spark):
    """With few buckets, estimates still hold within a wider bound: collisions cancel."""
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, 20_000)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    s = Q.sketch(df, "x", width=256, depth=5)
    check(v, Q.quantiles(s, [0.1, 0.5, 0.9], width=256, depth=5).collect(), 0.05)
    assert s.count() <= 33 * 5 * 256
