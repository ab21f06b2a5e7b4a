import pytest
from pyspark.sql import functions as F

from brinegrid.llm import sampling as S


def keys(df):
    return sorted(r.id for r in df.collect())


def test_size_and_determinism(spark):
    df = spark.range(0, 10_000, 1, 7)
    a = S.sample(S.sample_state(df, 100, 1))
    assert a.count() == 100
    assert a.columns == ["id"]
    assert keys(a) == keys(S.sample(S.sample_state(df, 100, 1)))
    assert keys(a) != keys(S.sample(S.sample_state(df, 100, 2)))


def test_it_is_the_bottom_k_of_the_keys(spark):
    df = spark.range(0, 5000, 1, 5)
    whole = df.withColumn("u", F.rand(9)).orderBy("u").limit(50)
    assert keys(S.sample_state(df, 50, 9)) == keys(whole)


def test_every_row_is_equally_likely(spark):
    n, k, runs = 200, 40, 150
    df = spark.range(0, n, 1, 4).withColumn("piece", F.col("id") % 3).cache()
    counts = [0] * n
    states = None
    for seed in range(runs):
        st = df.withColumn(S.KEY, F.rand(seed)).orderBy(S.KEY).limit(k).select("id", F.lit(seed).alias("seed")) if seed % 10 else S.sample_state(df, k, seed).select("id", F.lit(seed).alias("seed"))
        states = st if states is None else states.unionByName(st)
        if seed % 10 == 9:
            for r in states.collect():
                counts[r.id] += 1
            states = None
    expected = k * runs / n
    chi2 = sum((c - expected) ** 2 / (expected * (1 - k / n)) for c in counts)
    assert 120 < chi2 < 300  # 199 degrees of freedom: four deviations either way


def test_pieces_merge_to_a_fair_sample(spark):
    k = 30
    hits = [0, 0]
    for seed in range(12):
        small = S.sample_state(spark.range(0, 100), k, 2 * seed)
        large = S.sample_state(spark.range(100, 1000), k, 2 * seed + 1)
        ids = keys(S.sample(S.merge_states([small, large], k)))
        assert len(ids) == k == len(set(ids))
        hits[0] += sum(i < 100 for i in ids)
        hits[1] += sum(i >= 100 for i in ids)
    assert abs(hits[0] - 36) < 4 * (360 * 0.1 * 0.9) ** 0.5
    a, b, c = (S.sample_state(spark.range(x, x + 50), 10, x) for x in (0, 100, 200))
    assert keys(S.merge_states([S.merge_states([a, b], 10), c], 10)) == keys(S.merge_states([c, b, a], 10))


def test_small_empty_nulls_repeats(spark):
    assert S.sample_state(spark.range(0), 5, 1).count() == 0
    assert S.sample_state(spark.range(3), 5, 1).count() == 3
    df = spark.createDataFrame([(None, "x" * 100_000)] * 4, "a int, b string")
    assert S.sample_state(df, 3, 1).count() == 3
    with pytest.raises(ValueError, match="least 1"):
        S.sample_state(df, 0, 1)
    with pytest.raises(ValueError, match="there already"):
        S.sample_state(df.withColumn(S.KEY, F.lit(1.0)), 3, 1)
    with pytest.raises(ValueError, match="no states"):
        S.merge_states([], 3)
