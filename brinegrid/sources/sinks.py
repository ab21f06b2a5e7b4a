"""Writing tables and documents. Outputs are folders of parts; writing again replaces what is written, never doubles it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import rebalanced


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One header per part; columns are the union the table was read with."""
    df.write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def write_by_year(df: DataFrame, path: str, time: str = "timestamp", format: str = "parquet", max_rows: int = 0, target_bytes: int = 128 << 20) -> None:
    """One folder per year (year=YYYY). Years in df replace those folders, other years stay.

    Rows are rebalanced by year first, so that each year gets files of good size, a hot year several tasks, and no task
    writes small files into every year.
    """
    with rebalanced(df.sparkSession, target_bytes):
        w = df.withColumn("year", F.year(time)).hint("rebalance", "year").write.mode("overwrite").partitionBy("year").option("partitionOverwriteMode", "dynamic")
        if max_rows:
            w = w.option("maxRecordsPerFile", max_rows)
        w.option("header", "true").format(format).save(path)


def write_grid(cells: DataFrame, path: str, target_bytes: int = 128 << 20) -> None:
    """The grid table, partitioned by year and slice, so that a lookup of a year and slice prunes to its files."""
    with rebalanced(cells.sparkSession, target_bytes):
        cells.hint("rebalance", "year", "ti").write.mode("overwrite").partitionBy("year", "ti").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_document(doc: DataFrame, path: str) -> None:
    """A one-row text or JSON document."""
    doc.coalesce(1).write.mode("overwrite").text(path)
