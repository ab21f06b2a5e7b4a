import pytest
from pyspark.sql import functions as F

from brinegrid.operators import compaction as K


def rows(df):
    return sorted(map(str, df.collect()))


def test_same_rows_fewer_files(spark, tmp_path):
    src = str(tmp_path / "many")
    df = spark.createDataFrame([(k % 7, float("nan") if k % 5 == 0 else k / 3, None if k % 4 == 0 else "x" * (k % 9)) for k in range(400)], "MMSI int, sst double, note string")
    df = df.unionByName(df.where("MMSI = 1"))
    df.repartition(60).write.parquet(src)
    many = spark.read.parquet(src)
    done = K.compact(many, str(tmp_path / "few"))
    assert done.files == 1 < len(many.inputFiles())
    assert done.rows == many.count()
    assert rows(spark.read.parquet(done.path)) == rows(many)
    with pytest.raises(FileExistsError):
        K.compact(many, str(tmp_path / "few"))


def test_settings_come_back(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    K.compact(spark.range(10).toDF("k"))
    assert spark.conf.get(key, None) == before


def test_checksum_tells_multisets_apart(spark):
    c = lambda df: df.agg(K.multiset_checksum(df).alias("c")).first().c
    a = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, s string")
    assert c(a) == c(a.repartition(3))
    for other in (a.limit(2), a.unionByName(a.limit(1)), a.withColumn("s", F.coalesce("s", F.lit(""))), a.withColumn("k", F.col("k") + 1)):
        assert c(other) != c(a)


def test_mismatch_commits_nothing(spark, tmp_path, monkeypatch):
    calls = iter(range(10))
    real = K.multiset_checksum
    monkeypatch.setattr(K, "multiset_checksum", lambda df: real(df, next(calls)))
    with pytest.raises(K.ChecksumMismatch):
        K.compact(spark.range(5).toDF("k"), str(tmp_path / "out"))
    assert not any(tmp_path.iterdir())


def test_empty_maps_and_nested(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, [1, None], (1, {"x": "y"}))] * 2, "m map<string,int>, a array<int>, s struct<i:int,m:map<string,string>>")
    assert K.compact(df).rows == 2
    done = K.compact(df.limit(0))
    assert (done.rows, spark.read.parquet(done.path).columns) == (0, ["m", "a", "s"])


def test_layout_and_target(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.md5(F.col("id").cast("string")).alias("s"))
    done = K.compact(df, target_bytes=100_000, layout=("k",))
    assert 3 <= done.files <= 12  # about 850 kB are shuffled
    assert done.rows == 20_000


def test_chunk_sizes(spark):
    data = spark.createDataFrame([(1,)] * 250 + [(2,)] * 199 + [(None,)] * 5 + [(9,)], "chunk_id long")
    manifest = spark.createDataFrame([(1, 3), (2, None), (2, 7), (3, 500), (None, 1)], "chunk_id long, n int")
    got = {r.chunk_id: (r.n_rows, r.small) for r in K.chunk_sizes(data, manifest).collect()}
    assert got == {1: (250, False), 2: (199, True), 3: (0, True)}
