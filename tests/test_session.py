import pytest

from brinegrid import session as S


def test_the_clusters_folder_is_used(spark):
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        assert S.shared_dir(spark) == given.rstrip("/")
    assert S.fresh_path(spark, "a") != S.fresh_path(spark, "a")


def test_own_folder_where_none_is_set():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        applicationId = "app-test"
        master = "local[2]"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    first = S.shared_dir(Session())
    assert first.startswith("file:///")
    assert S.shared_dir(Session()) == first
    Context.master, Context.applicationId = "spark://somewhere:7077", "app-far"
    with pytest.raises(RuntimeError):
        S.shared_dir(Session())


def test_intermediate_tables_are_in_a_folder_deleted_at_the_end(spark):
    path = S.fresh_path(spark, "t")
    folder = path.rsplit("/", 1)[0]
    fs, p = S.hadoop_path(spark, folder)
    assert fs.exists(p) and folder.endswith(spark.sparkContext.applicationId)
    assert fs.cancelDeleteOnExit(p) and fs.deleteOnExit(p)


def test_materialized_tables_keep_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    back = S.materialize(df, "t")
    assert back.schema == df.schema
    assert sorted(map(tuple, back.collect())) == [(1, None), (2, "x")]
    assert "parquet" in back._jdf.queryExecution().executedPlan().toString()
