"""Queries of the operators for training text and training numbers, with their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import columns as C
from . import leakage, packing, quantiles, sampling, splitting


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def usable(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vessel_points")
    return v.where(C.usable_value(F.col("sst"), F.col("sst_missing")))


def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    state = sampling.sample_state(usable(spark, sf).select("obs_id", "chunk_id", "sst"), 1000, seed=20)
    return sampling.sample(state)


def p5_size(spark: SparkSession, sf: str) -> DataFrame:
    """How many are chosen, and whether all are different usable readings; states of chunks with even and odd numbers (or none), merged."""
    v = usable(spark, sf).select("obs_id", "sst", F.pmod(F.coalesce("chunk_id", F.lit(0).cast("bigint")), F.lit(2)).alias("piece"))
    states = [sampling.sample_state(v.where(F.col("piece") == k), 1000, seed=k) for k in (0, 1)]
    s = sampling.sample(sampling.merge_states(states, 1000))
    return s.join(v, "obs_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("obs_id").alias("n_different"))


def p7_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Per year, from sketches per year and month merged by addition."""
    v = usable(spark, sf).where("timestamp is not null").select(F.year("timestamp").alias("year"), F.month("timestamp").alias("month"), "sst")
    monthly = quantiles.sketch(v, "sst", by=["year", "month"])
    return quantiles.quantiles(quantiles.drop_column_from_sketch(monthly, "month"), [0.5, 0.9, 0.99], by=["year"])


def p7_within_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the rank of each estimate is within the stated error, checked against all values."""
    v = usable(spark, sf).where("timestamp is not null").select(F.year("timestamp").alias("year"), "sst")
    est = quantiles.quantiles(quantiles.sketch(v, "sst", by=["year"]), [0.5, 0.9, 0.99], by=["year"])
    grid = est.groupBy("year").pivot("q", [0.5, 0.9, 0.99]).agg(F.first("value")).toDF("y", "a", "b", "c")
    near = F.col("sst").cast("float").cast("double")  # estimates are single-precision numbers
    out = v.join(F.broadcast(grid), F.col("year") == F.col("y")).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(near < F.col(x)).alias(f"{x}_low") for x in "abc"],
        *[F.count_if(near <= F.col(x)).alias(f"{x}_high") for x in "abc"],
    )
    e = quantiles.EPSILON
    ok = [(F.col(f"{x}_low") <= (q + e) * F.col("n")) & (F.col(f"{x}_high") >= (q - e) * F.col("n")) for x, q in (("a", 0.5), ("b", 0.9), ("c", 0.99))]
    return out.select("year", "n", *[k.alias(f"p{p}_within") for k, p in zip(ok, (50, 90, 99))])


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf, "documents"))


def p8_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that came out, whether all containers hold, and whether only texts longer than a container are divided."""
    c = packing.pack_texts(table(spark, sf, "documents"))
    full = c.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("s"), F.max(F.col("container_offset") + F.col("n_tokens")).alias("e"))
    text = c.groupBy("doc_id").agg(F.sum("n_tokens").alias("s"), F.count(F.lit(1)).alias("pieces"))
    a = full.agg(F.max(F.greatest("s", "e")).alias("most"), F.bool_and(F.col("s") == F.col("e")).alias("no_gaps"))
    b = text.agg(F.count(F.lit(1)).alias("n_texts"), F.bool_and(F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("s") / packing.CAPACITY))).alias("divided_only_if_long"))
    one = lambda d: d.withColumn("k", F.lit(1))
    return one(a).join(one(b), "k").select("n_texts", (F.col("most") <= packing.CAPACITY).alias("all_fit"), "no_gaps", "divided_only_if_long")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_texts(table(spark, sf, "documents")).where("piece_no = 0 and n_pieces > 1").select("doc_id")


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_texts(table(spark, sf, "documents"))


SQL = {
    "p5_size": """select least(1000, count(*)) as n, least(1000, count(*)) as n_different from vessel_points
        where sst between -2.5e0 and 40e0 and not isnan(sst) and not coalesce(sst_missing, false)""",
    "p8_whole": "select count(distinct doc_id) as n_texts, true as all_fit, true as no_gaps, true as divided_only_if_long from documents",
    "p7_within_bound": """
        select year("timestamp") as year, count(*) as n, true as p50_within, true as p90_within, true as p99_within
        from vessel_points where timestamp is not null and sst between -2.5e0 and 40e0 and not isnan(sst) and not coalesce(sst_missing, false)
        group by 1""",
}

QUERIES = {f.__name__: f for f in (p5_sample, p5_size, p7_quantiles, p7_within_bound, p8_containers, p8_whole, p9_found, p10_found, p10_pieces)}
