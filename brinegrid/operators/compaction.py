"""Consolidating many small files into few of good size, without losing or duplicating a record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import columns as C
from ..session import fresh_path, hadoop_path, rebalanced


class ChecksumMismatch(RuntimeError):
    """What was written is not, as a multiset, what was read; nothing was committed."""


def _hashable(c: Column, kind: T.DataType) -> Column:
    """Maps can't be hashed; their sorted entries can. Variants and the like go through JSON."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(c))
    if "map<" in kind.simpleString():
        return F.to_json(F.struct(c.alias("x")))
    return c


def multiset_checksum(df: DataFrame, seed: int = 0) -> Column:
    """One struct for all rows: count, sum and xor of row hashes. Order doesn't matter, repeats do."""
    row = F.xxhash64(F.lit(seed), *[F.struct(C.quoted(f.name).isNull(), _hashable(C.quoted(f.name), f.dataType)) for f in df.schema])
    return F.struct(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("total"), F.bit_xor(row).alias("mixed"))


@dataclass(frozen=True)
class Compaction:
    """A committed compaction: where the rows are, how many, and their checksum."""

    path: str
    rows: int
    files: int
    checksum: tuple


def compact(df: DataFrame, path: str | None = None, target_bytes: int = 256 << 20, layout: tuple[str, ...] = ()) -> Compaction:
    """Write all rows of df, repeats included, to path in files of about target_bytes of shuffled data each.

    The REBALANCE hint shuffles the rows evenly (or by the layout columns, then split where those are skewed); AQE merges
    or splits the output partitions by their measured sizes. Rows go to a staging folder first; its checksum is compared
    with the source's and only then is it renamed to path. path must not exist yet. Without path, a new folder
    in the shared folder is used, which is deleted when the driver ends. The source is read once for its checksum and once to be
    written: a checksum observed in passing would count the tasks twice that a lost executor makes run again. An empty table gives one empty file. Column names that differ only by case raise.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "compacted")
    staging = path.rstrip("/") + "._staging"
    fs, final = hadoop_path(spark, path)
    if fs.exists(final):
        raise FileExistsError(path)
    before = df.agg(multiset_checksum(df).alias("c")).first()["c"]
    with rebalanced(spark, target_bytes):
        df.hint("rebalance", *[C.quoted(c) for c in layout]).write.parquet(staging)
    written = spark.read.schema(df.schema).parquet(staging)
    after = written.agg(multiset_checksum(written).alias("c")).first()["c"]
    if tuple(before) != tuple(after):
        fs.delete(hadoop_path(spark, staging)[1], True)
        raise ChecksumMismatch(f"{tuple(before)} read, {tuple(after)} written")
    if not fs.rename(hadoop_path(spark, staging)[1], final):
        raise OSError(f"{staging} could not be renamed to {path}")
    return Compaction(path, after["n"], len(spark.read.parquet(path).inputFiles()), tuple(after))


def chunk_sizes(compacted: DataFrame, manifest: DataFrame, chunk_col: str = "chunk_id", least_rows: int = 200) -> DataFrame:
    """(chunk_id, n_rows, small): every chunk of the manifest with its rows among the compacted ones; small below least_rows.

    Chunks without rows count 0. The manifest's own counts are not used: they can be null or wrong. A chunk listed twice
    comes out once; null chunk ids take no part. Counts are pre-aggregated, so a hot chunk is no hot task.
    """
    n = compacted.groupBy(C.quoted(chunk_col).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    listed = manifest.select(C.quoted(chunk_col).alias("k")).where("k is not null").distinct()
    rows = F.coalesce("n", F.lit(0).cast("bigint"))
    return listed.join(n, F.col("k") == F.col("chunk"), "left").select(F.col("k").alias(chunk_col), rows.alias("n_rows"), (rows < least_rows).alias("small"))
