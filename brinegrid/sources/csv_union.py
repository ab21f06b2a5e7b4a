"""CSV files with differing headers, loose or inside ZIP archives, as one table of text columns.

Read together, Spark maps all files to the first header by position. So files are grouped by header, each group is read
with its own schema, and the groups are united by name.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..columns import quoted
from ..operators import stratify
from .discover import Source


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The names in a file's first line; [] for an empty file. Malformed bytes become U+FFFD, a byte-order mark is dropped."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return next(csv.reader(io.StringIO((line or "").lstrip("\ufeff"))), [])


def read_headers(spark: SparkSession, paths: list[str], few: int = 200) -> dict[str, list[str]]:
    """The header of every file. A few are read by the driver, one line each; many by a job over their first blocks."""
    if len(paths) <= few:
        return {p: read_header(spark, p) for p in paths}
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    first = lines.where("at = 0").groupBy("p").agg(F.min_by("value", "id").alias("head"))
    plain = lambda p: re.sub(r"^file:/+", "/", unquote(p))
    found = {plain(r["p"]): next(csv.reader(io.StringIO((r["head"] or "").lstrip("\ufeff"))), []) for r in first.toLocalIterator()}
    return {p: found.get(plain(p), []) for p in paths}


def union_columns(headers: Iterable[list[str]]) -> list[str]:
    """All names, in the order they are first seen."""
    return list(dict.fromkeys(n for h in headers for n in h))


def _unique(names: list[str]) -> list[str]:
    """Names fit for one schema: empty and repeated ones (ignoring case) get a number."""
    out, seen = [], set()
    for k, n in enumerate(names):
        new = n or f"unnamed_{k}"
        while new.lower() in seen:
            new += f"_{k}"
        seen.add(new.lower())
        out.append(new)
    return out


def read_csv_files(spark: SparkSession, paths: list[str], multiline: bool = False, misfits: str | None = None) -> DataFrame:
    """All rows of all files, every value a string; columns a file lacks are null.

    Quotes inside quoted fields are doubled. With multiline, quoted fields may hold line breaks; a file is then one task's work.
    misfits names a last column for the whole text of rows that have more or fewer cells than their header (else null): what
    lies beyond the header is only there.
    """
    groups = _by_header(spark, paths)
    if not groups:
        return spark.createDataFrame([], T.StructType([]))
    frames = []
    for header, own in groups.items():
        names = _unique(list(header))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *([misfits] if misfits else [])]])
        r = spark.read.schema(schema).options(header=True, encoding="UTF-8", mode="PERMISSIVE", multiLine=multiline, enforceSchema=True, quote='"', escape='"')
        frames.append((r.option("columnNameOfCorruptRecord", misfits) if misfits else r).csv(own))
    out = stratify.union_by_name(*frames)
    return out.select(*[quoted(c) for c in out.columns if c != misfits], *([quoted(misfits)] if misfits else []))


#: What reading an archive or a member can end with when it is damaged, encrypted or packed in an unknown way.
_DAMAGE = (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, csv.Error)


def zip_members(spark: SparkSession, paths: list[str], suffix: str = ".csv") -> DataFrame:
    """(archive, member): the members of ZIP archives with that suffix, ignoring case. Unreadable archives have none."""
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField("member", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if n.lower().endswith(suffix)]
                except zipfile.BadZipFile:
                    continue
                yield pd.DataFrame({"archive": path, "member": names})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, schema)


def read_zip_rows(spark: SparkSession, paths: list[str], batch: int = 20_000) -> DataFrame:
    """(archive, member, row_no, cells, surplus, error): every CSV row of every member as a map of names to texts.

    surplus holds the cells beyond the header (else null). An archive that cannot be opened, and a member that cannot be read
    to its end, give one row with the reason in error and neither row_no nor cells; what came before it stays.
    An archive is one task's work, read as a stream, member by member; a member needs not fit into memory, an archive does
    (2 GB at most).
    """
    text = T.StringType()
    schema = T.StructType([T.StructField("archive", text), T.StructField("member", text), T.StructField("row_no", T.LongType()), T.StructField("cells", T.MapType(text, text)), T.StructField("surplus", T.ArrayType(text)), T.StructField("error", text)])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        member = None
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for member in (n for n in z.namelist() if n.lower().endswith(".csv")):
                    try:
                        with z.open(member) as f:
                            rows = csv.reader(io.TextIOWrapper(f, encoding="utf-8-sig", errors="replace", newline=""))
                            names = _unique(next(rows, []))
                            for no, r in enumerate(rows, 1):
                                yield path, member, no, list(zip(names, r)), r[len(names) :] or None, None
                    except _DAMAGE as e:
                        yield path, member, None, None, None, f"{type(e).__name__}: {e}"
        except _DAMAGE as e:
            yield path, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                rows = rows_of(path.as_py(), content.as_py())
                while part := list(itertools.islice(rows, batch)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, schema)


def bad_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(archive, member, error): archives and members that could not be read, or not to their end."""
    return read_zip_rows(spark, paths).where("error is not null").select("archive", "member", "error")


def zip_columns(spark: SparkSession, paths: list[str]) -> list[str]:
    """The union of the headers in ZIP archives; only first lines are unpacked."""
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                with z:
                    for m in (n for n in z.namelist() if n.lower().endswith(".csv")):
                        try:
                            with z.open(m) as f:
                                head = next(csv.reader(io.TextIOWrapper(f, encoding="utf-8-sig", errors="replace", newline="")), [])
                        except _DAMAGE:  # told by bad_sources
                            continue
                        yield pd.DataFrame([(path, m, _unique(head))], columns=schema.names)

    found = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, schema)
    distinct = found.groupBy("names").agg(F.min(F.struct("archive", "member")).alias("first")).orderBy("first").collect()  # one row per distinct header
    return union_columns([r["names"] for r in distinct])


def read_sources(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """Everything in one table of text columns, in first-seen order of names: archives first, as discovered."""
    zips = [s.path for s in sources if s.kind == "zip"]
    files = [s.path for s in sources if s.kind == "file"]
    frames = []
    if zips:
        cells = read_zip_rows(spark, zips).where("error is null")
        frames.append(cells.select(*[F.col("cells")[n].alias(n) for n in zip_columns(spark, zips)]))
    if files:
        frames.append(read_csv_files(spark, files))
    return stratify.union_by_name(*frames) if frames else spark.createDataFrame([], T.StructType([]))


def first_rows_per_file(spark: SparkSession, paths: list[str], n: int = 1000) -> DataFrame:
    """The first n rows of each file, with its path: a preview, in file order."""
    frames = []
    for header, own in _by_header(spark, paths).items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in _unique(list(header))])
        df = spark.read.csv(own, schema=schema, header=True)
        df = df.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
        frames.append(stratify.first_per_stratum(df, F.col("source_file"), [F.col("_at"), F.col("_id")], n).drop("_at", "_id"))
    return stratify.union_by_name(*frames)


def _by_header(spark: SparkSession, paths: list[str]) -> dict[tuple, list[str]]:
    out: dict[tuple, list[str]] = {}
    for p, h in read_headers(spark, paths).items():
        if h:
            out.setdefault(tuple(h), []).append(p)
    return out


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with exactly these columns, absent ones null, others dropped."""
    have = set(df.columns)
    return df.select(*[quoted(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])
