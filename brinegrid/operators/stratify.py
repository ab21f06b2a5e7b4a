"""Bounded, reproducible samples per stratum: ordered by a hash of the key, so any engine picks the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column) -> list[Column]:
    k = key.cast("string")
    return [F.md5(k), k]


def per_stratum(df: DataFrame, stratum: Column, key: Column, k: int) -> DataFrame:
    """Up to k rows of each stratum (a sample in hash order). The window's group limit runs before the shuffle, so a hot stratum sends k rows per task."""
    w = Window.partitionBy(stratum).orderBy(*hash_order(key))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def first_per_stratum(df: DataFrame, stratum: Column, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def quota_per_stratum(df: DataFrame, stratum: Column, key: Column, total: int, n_strata: int) -> DataFrame:
    """max(1, total // n_strata) rows of each stratum, at most total; what a stratum doesn't use is not given to others."""
    picked = per_stratum(df, stratum, key, max(1, total // max(1, n_strata)))
    return picked if n_strata <= total else picked.orderBy(stratum, *hash_order(key)).limit(total)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows, columns by name in first-seen order, absent ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
