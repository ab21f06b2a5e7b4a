"""Schemas that drift between files: inference, change report, and one consistent table.

Each file yields a schema as a tagged union: per column the number of values of every type (integer, decimal, text,
blank). Schemas are fused by adding these counts, in parallel, so no alternative is lost; alternatives that appear are
reported. A column with conflicting alternatives is split into typed branches, beside a canonical conversion. Files are
read by the quote-aware tokenizer of records.py, whole Arrow batches at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import columns as C
from ..session import materialize
from . import records as R

INTEGER = re.compile(r"[+-]?\d+", re.ASCII)
DECIMAL = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", re.ASCII)
TAGS = ("integer", "decimal", "text", "blank")


def plain_name(name: str) -> str:
    """Without byte-order mark, outer blanks and quotes, in lower case."""
    old = None
    while old != name:
        old = name
        name = name.strip().strip("\ufeff").strip('"').strip("'")
    return name.lower()


_ODD = re.compile(r'"((?:[^"]+|"")*)"?(.*)', re.S)


@dataclass
class _Cells:
    """The cells of several files, in order: the trimmed text of each, its file, row (0: the header) and column, and of every file
    the names of its header and the number of rows under it."""

    text: pa.Array
    file: np.ndarray
    row: np.ndarray
    column: np.ndarray
    names: list[list[str]]
    rows: np.ndarray


def _cells(contents: pa.Array) -> _Cells:
    """Line ends of any kind, a byte-order mark and empty lines don't count; a null or empty file has no header."""
    n = len(contents)
    data, offsets = R.raw_bytes(pc.replace_substring_regex(contents, "^\\x{feff}+", ""))
    seps, owner, _, _ = R.tokenize(data, offsets, 256, R.NEXT_LENIENT, (R.COMMA, R.BREAK))
    fields = np.bincount(owner, minlength=n) + 1
    last = np.cumsum(fields) - 1
    inner = np.ones(int(fields.sum()), bool)
    inner[last] = False
    end, start = np.empty(len(inner), np.int64), np.empty(len(inner), np.int64)
    end[last], end[inner] = offsets[1:], seps
    begins = np.zeros(len(inner), bool)
    begins[last - fields + 1] = True
    start[begins], start[~begins] = offsets[:-1], seps + 1
    file = np.repeat(np.arange(n), fields)
    line_end = np.ones(len(inner), bool)
    line_end[inner] = data[seps] != ord(",")
    first = np.concatenate([[True], line_end[:-1]]) if len(inner) else line_end
    at = np.nonzero(first)[0]
    line = np.cumsum(first) - 1
    width = np.diff(np.append(at, len(first)))
    empty = (width == 1) & (end[at] == start[at])
    keep = ~empty[line]
    start, end, file, line, first = start[keep], end[keep], file[keep], line[keep], first[keep]
    no = np.cumsum(first) - 1  # of the line among those kept
    column = np.arange(len(first)) - np.nonzero(first)[0][no] if len(first) else no
    lines = np.bincount(file[first], minlength=n)
    row = no - (np.cumsum(lines) - lines)[file]
    text = R.texts_of(data, start, end)
    odd = np.nonzero((end > start) & (data[np.minimum(start, len(data) - 1)] == ord('"')) & ((end - start == 1) | (data[end - 1] != ord('"'))))[0] if len(data) else []
    if len(odd):  # something follows the closing quote, or it never closes
        fixed = text.to_pylist()
        for k in odd:
            m = _ODD.fullmatch(data[start[k] : end[k]].tobytes().decode("utf-8", "replace"))
            fixed[k] = m[1].replace('""', '"') + m[2]
        text = pa.array(fixed, pa.large_string())
    names: list[list[str]] = [[] for _ in range(n)]
    head = np.nonzero(row == 0)[0]
    for f, x in zip(file[head].tolist(), text.take(pa.array(head)).to_pylist()):
        names[f].append(plain_name(x))
    return _Cells(pc.utf8_trim_whitespace(text), file, row, column, names, np.maximum(lines - 1, 0))


def _tags(text: pa.Array) -> np.ndarray:
    """Of trimmed texts: 0 integer, 1 decimal, 2 text, 3 blank."""
    blank = pc.equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    return np.where(blank, 3, np.where(R.matches(text, "[+-]?[0-9]+"), 0, np.where(R.matches(text, R.NUMBER), 1, 2)))


FILE_SCHEMA = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("position", T.IntegerType()), *[T.StructField(t, T.LongType()) for t in TAGS]]))
_FILE_ARROW = pa.list_(pa.struct([("name", pa.string()), ("position", pa.int32()), *[(t, pa.int64()) for t in TAGS]]))


def _schemas(contents: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The tagged unions of files, and how many cells lie beyond their headers."""
    c = _cells(contents)
    width = np.array([len(x) for x in c.names], np.int64)
    base = np.cumsum(width) - width
    body = c.row > 0
    inside = body & (c.column < width[c.file])
    counts = np.bincount((base[c.file[inside]] + c.column[inside]) * 4 + _tags(c.text.filter(pa.array(inside))), minlength=int(width.sum()) * 4).reshape(-1, 4)
    counts[:, 3] += np.repeat(c.rows, width) - counts.sum(axis=1)  # cells that a short row lacks are blank
    flat = pa.StructArray.from_arrays(
        [pa.array([x for n in c.names for x in n], pa.string()), pa.array((np.arange(len(counts)) - np.repeat(base, width)).astype(np.int32)), *[pa.array(counts[:, k].astype(np.int64)) for k in range(4)]],
        fields=list(_FILE_ARROW.value_type),
    )
    columns = pa.ListArray.from_arrays(pa.array(np.append(base, width.sum()).astype(np.int32)), flat).cast(_FILE_ARROW)
    return columns, pa.array(np.bincount(c.file[body & ~inside], minlength=len(contents)).astype(np.int64))


def infer_schemas(files: DataFrame, content_col: str = "content") -> DataFrame:
    """files without their content, with columns `columns`, the tagged union of every file, and `surplus`, the number of cells
    beyond its header. No shuffle. Existing columns of those names are kept; the new ones get underscores."""
    rest = [f for f in files.schema.fields if f.name != content_col]
    name = C.free_name([f.name for f in rest], "columns")
    more = C.free_name([name, *[f.name for f in rest]], "surplus")
    schema = T.StructType([*rest, T.StructField(name, FILE_SCHEMA), T.StructField(more, T.LongType())])
    at = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in R.parts_of(b, at):
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *_schemas(part.column(at))], names=schema.names)

    return files.select(*[C.quoted(f.name) for f in rest], C.quoted(content_col)).mapInArrow(run, schema)


def type_of(c: Column) -> Column:
    """The narrowest type all non-blank values have; integer where there are none."""
    return F.when(c["text"] > 0, "text").when(c["decimal"] > 0, "decimal").otherwise("integer")


def role_of(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for role, names in C.ROLES.items():
        out = F.when(name.isin(*names), role).otherwise(out)
    return out


def schema_changes(files: DataFrame, file_id: str = "file_id", feed: str = "feed", date: str = "file_date", content_col: str = "content") -> DataFrame:
    """(file_id, column_name, change_kind, old_name, old_type, new_type): each file against the file before it in its feed.

    change_kind is `renamed`, `added`, `removed` or `retyped`; names are those of plain_name. A column renamed keeps its
    role (time, lat, lon, id), of which both files have exactly one column. Files of equal date are ordered by id; the
    first of a feed has no changes. A file that is null or empty has no columns. A name that occurs twice in a header
    counts once for changes (its values together), but twice when the columns of a role are counted. Files with a null
    feed form one feed; null dates come first. An empty table gives an empty result; extra columns are ignored.

    Schemas (one small row per file) are written to the shared folder once. They are sorted per feed and month; the last file
    of a month is carried into the next one that has files, so no feed is a task of its own.
    """
    s = infer_schemas(files.select(C.quoted(file_id).alias("fid"), C.quoted(feed).alias("feed"), C.quoted(date).alias("day"), C.quoted(content_col).alias("content")))
    short = F.transform("columns", lambda c: F.struct(c["name"].alias("name"), type_of(c).alias("type"), role_of(c["name"]).alias("role")))
    month = F.coalesce(F.year("day") * 12 + F.month("day"), F.lit(-(10**6)))  # null dates come first
    s = materialize(s.select("fid", "feed", "day", short.alias("new"), month.alias("month")), "schemas")
    w = Window.partitionBy("feed", "month").orderBy("day", "fid")
    ends = s.groupBy("feed", "month").agg(F.max_by("new", F.struct("day", "fid")).alias("last"))
    carried = ends.select(F.col("feed").alias("cfeed"), F.col("month").alias("cmonth"), F.lag("last").over(Window.partitionBy("feed").orderBy("month")).alias("carried")).where("carried is not null")
    s = s.withColumns({"before": F.lag("new").over(w), "first": F.row_number().over(w) == 1})
    s = s.join(carried, F.col("feed").eqNullSafe(F.col("cfeed")) & (F.col("month") == F.col("cmonth")), "left")
    s = s.withColumn("old", F.when(F.col("first"), F.col("carried")).otherwise(F.col("before"))).where("old is not null")
    roles = list(C.ROLES)

    def only(side: str, role: str) -> Column:
        own = F.filter(side, lambda c: c["role"] == role)
        return F.when(F.size(own) == 1, own[0]["name"])

    # pairs of (old name, new name): renamed by role, else the same name
    s = s.withColumn("renames", F.filter(F.array(*[F.struct(only("old", r).alias("o"), only("new", r).alias("n")) for r in roles]), lambda x: (x["o"] != x["n"])))
    names = lambda side: F.array_distinct(F.transform(side, lambda c: c["name"]))
    s = s.withColumns({"old_names": names("old"), "new_names": names("new"), "gone": F.transform("renames", lambda x: x["o"]), "come": F.transform("renames", lambda x: x["n"])})

    def kind(side: str, name: Column) -> Column:
        """The widest type of the columns of that name."""
        types = F.transform(F.filter(side, lambda c: c["name"] == name), lambda c: c["type"])
        return F.when(F.array_contains(types, "text"), "text").when(F.array_contains(types, "decimal"), "decimal").otherwise("integer")

    def change(name: Column, what: str, old: Column, a: Column, b: Column) -> Column:
        return F.struct(name.alias("column_name"), F.lit(what).alias("change_kind"), old.alias("old_name"), a.alias("old_type"), b.alias("new_type"))

    none = F.lit(None).cast("string")
    same = F.array_intersect(F.array_except("old_names", "gone"), F.array_except("new_names", "come"))
    kept = F.concat("renames", F.transform(same, lambda n: F.struct(n.alias("o"), n.alias("n"))))
    kept = F.transform(kept, lambda x: F.struct(x["o"].alias("o"), x["n"].alias("n"), kind("old", x["o"]).alias("a"), kind("new", x["n"]).alias("b")))
    both = F.concat(F.transform("renames", lambda x: F.struct(x["o"].alias("o"), x["n"].alias("n"))), F.array().cast("array<struct<o:string,n:string>>"))
    out = F.concat(
        F.transform(both, lambda x: change(x["n"], "renamed", x["o"], none, none)),
        F.transform(F.array_except(F.array_except("new_names", "old_names"), "come"), lambda n: change(n, "added", none, none, none)),
        F.transform(F.array_except(F.array_except("old_names", "new_names"), "gone"), lambda n: change(n, "removed", n, none, none)),
        F.transform(F.filter(kept, lambda x: x["a"] != x["b"]), lambda x: change(x["n"], "retyped", x["o"], x["a"], x["b"])),
    )
    return s.select(F.col("fid").alias(file_id), F.explode(out).alias("c")).select(file_id, "c.*")


def new_alternatives(files: DataFrame, file_id: str = "file_id", feed: str = "feed", date: str = "file_date", content_col: str = "content") -> DataFrame:
    """(feed, column_name, new_type, file_id, change_kind): every alternative (integer, decimal or text) that a column had in no
    earlier file of its feed, with the file in which it appears and change_kind `alternative`.

    What a column holds in its first file with any value is no news. A value counts by itself: one text among integers is
    an alternative beside them. Files of equal date are ordered by id, null dates come first, files with a null feed form
    one feed; a name that occurs twice in a header counts once. Extra columns are ignored; an empty table gives an empty
    result. The fused union of a feed is never sorted: the first file of each alternative is a minimum.
    """
    s = infer_schemas(files.select(C.quoted(file_id).alias("fid"), C.quoted(feed).alias("feed"), C.quoted(date).alias("day"), C.quoted(content_col).alias("content")))
    c = s.select("feed", F.struct("day", "fid").alias("at"), F.explode("columns").alias("c"))
    tags = F.array(*[F.when(F.col("c")[t] > 0, t) for t in TAGS[:3]])
    c = c.select("feed", "at", F.col("c.name").alias("column_name"), F.explode(tags).alias("new_type")).where("new_type is not null")
    first = c.groupBy("feed", "column_name", "new_type").agg(F.min("at").alias("at"))
    w = Window.partitionBy("feed", "column_name")  # three rows at most
    news = first.withColumn("start", F.min("at").over(w)).where(F.col("at") != F.col("start"))
    return news.select("feed", "column_name", "new_type", F.col("at.fid").alias(file_id), F.lit("alternative").alias("change_kind"))


def fused_schema(files: DataFrame, content_col: str = "content") -> DataFrame:
    """(name, role, integer, decimal, text, blank, n_files, alternatives, kind): the tagged union of all files, one row per column name."""
    s = infer_schemas(files.select(C.quoted(content_col).alias("content"))).select(F.explode("columns").alias("c"))
    fused = s.groupBy(F.col("c.name").alias("name")).agg(*[F.sum(f"c.{t}").alias(t) for t in TAGS], F.count(F.lit(1)).alias("n_files"))
    alts = F.filter(F.array(*[F.when(F.col(t) > 0, t) for t in TAGS[:3]]), lambda x: x.isNotNull())
    whole = F.struct(*TAGS)
    return fused.select("name", role_of(F.col("name")).alias("role"), *TAGS, "n_files", alts.alias("alternatives"), type_of(whole).alias("kind"))


def hemisphere_number(text: Column) -> Column:
    """A coordinate as a number: `52.95`, `52.95E`, `52.95 W`; letters S and W make it negative. Null for anything else."""
    num = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*([NSEWnsew]?)\s*$", 1).try_cast("double")
    letter = F.upper(F.regexp_extract(text, r"([NSEWnsew]?)\s*$", 1))
    return F.when(letter.isin("S", "W"), -num).otherwise(num)


def time_value(text: Column) -> Column:
    """A timestamp without zone: whatever coerce_time reads, a day written YYYYMMDD, or seconds since 1970 in UTC (9 or 10 digits, perhaps with a fraction). Null for anything else."""
    day = F.regexp_replace(text, r"^\s*(\d{4})(\d{2})(\d{2})\s*$", "$1-$2-$3")
    seconds = F.regexp_extract(text, r"^\s*\+?(\d{9,10}(?:\.\d*)?)\s*$", 1).try_cast("decimal(18,6)")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.when(seconds.isNotNull(), epoch).otherwise(C.coerce_time(day))


#: How the values of a role are read.
READ = {"time": time_value, "lat": hemisphere_number, "lon": hemisphere_number, "id": lambda text: text}


def united_rows(files: DataFrame, file_id: str = "file_id", content_col: str = "content") -> DataFrame:
    """All rows of all files: file_id, row_no, cells (a map from name to text), repeats (from a name that occurs twice in a
    header to its further values, or null), surplus (the cells beyond the header, or null).

    Blank cells are left out. Any number of names will do, as they are no columns. No shuffle.
    """
    texts = T.ArrayType(T.StringType())
    schema = T.StructType([files.schema[file_id], T.StructField("row_no", T.LongType()), T.StructField("cells", T.MapType(T.StringType(), T.StringType())), T.StructField("repeats", T.MapType(T.StringType(), texts)), T.StructField("surplus", texts)])
    strings = pa.list_(pa.string())

    def united(part: pa.RecordBatch) -> pa.RecordBatch:
        c = _cells(part.column(1))
        total = int(c.rows.sum())
        before = np.cumsum(c.rows) - c.rows
        full = (c.row > 0) & ~pc.equal(pc.binary_length(c.text), 0).to_numpy(zero_copy_only=False)
        file, column = c.file[full], c.column[full]
        row = before[file] + c.row[full] - 1
        value = c.text.filter(pa.array(full)).cast(pa.string())
        # the number of each header's names in a list of all names
        width = np.array([len(x) for x in c.names], np.int64)
        base = np.cumsum(width) - width
        every, inverse = np.unique(np.array([x for n in c.names for x in n], dtype=object), return_inverse=True) if width.sum() else (np.zeros(0, object), np.zeros(0, np.int64))
        inside = column < width[file]
        name = np.full(len(row), -1, np.int64)
        name[inside] = inverse[base[file[inside]] + column[inside]]
        _, once = np.unique(row * (len(every) + 1) + name, return_index=True)
        shown = np.zeros(len(row), bool)
        shown[once] = True
        shown &= inside
        at = np.nonzero(shown)[0]
        bounds = np.searchsorted(row[at], np.arange(total + 1)).astype(np.int32)
        cells = pa.MapArray.from_arrays(pa.array(bounds), pa.array(every, pa.string()).take(pa.array(name[at])), value.take(pa.array(at)))
        more: list = [None] * total
        for k in np.nonzero(inside & ~shown)[0].tolist():
            held = more[row[k]] = more[row[k]] or {}
            held.setdefault(every[name[k]], []).append(value[k].as_py())
        beyond: list = [None] * total
        for k in np.nonzero(~inside)[0].tolist():
            beyond[row[k]] = [*(beyond[row[k]] or []), value[k].as_py()]
        own = np.repeat(np.arange(len(c.rows)), c.rows)
        repeats = pa.array([None if m is None else list(m.items()) for m in more], pa.map_(pa.string(), strings))
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(np.arange(total) - before[own] + 1), cells, repeats, pa.array(beyond, strings)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in R.parts_of(b, 1):
                yield united(part)

    return files.select(C.quoted(file_id), C.quoted(content_col)).mapInArrow(run, schema)


def consistent_table(files: DataFrame, file_id: str = "file_id", content_col: str = "content", most_columns: int = 2000) -> DataFrame:
    """All rows of all files in one table: file_id, row_no, time, lat, lon, id, then one column per name, in order of name.

    The four role columns are filled from whatever spelling a file uses (the first in priority order whose value the role
    can read). If a name occurs twice in a header its first value counts, and the column `repeats` maps the name to
    the others (null where there are none); roles read those last. The last column, `surplus`, has the cells of a row that
    its header has no name for. A column with
    one type has that type; one with alternatives is a struct of typed branches (integer, decimal, text; the branch the
    value has is set) plus `canonical`, the value in the widest type. The column of a name with a role is always such a
    struct, with the text as written in `raw` and the value as the role reads it in `canonical`; it is null where the file
    has no such value, and `time`, `lat` and `lon` as names of a file become `time_`, `lat_` and `lon_`. Times may be
    written as seconds since 1970 or YYYYMMDD; lat and lon are numbers, also if written with a hemisphere letter. What a
    role cannot read is null there and stays in `raw` and its branch. Blank values are null. The number of distinct
    columns is bounded by most_columns; beyond it this raises ValueError, and united_rows has the same rows with maps.
    """
    names = fused_schema(files, content_col).select("name", "role", "alternatives", "kind").limit(most_columns + 1).collect()
    if len(names) > most_columns:
        raise ValueError(f"more than {most_columns} distinct column names")
    long = united_rows(files, file_id, content_col)
    cell = lambda n: F.col("cells")[n]
    again = lambda n, read: F.filter(F.transform(F.col("repeats")[n], read), lambda v: v.isNotNull())
    seen = {n["name"] for n in names}

    def role(r: str) -> Column:
        own = [n for n in C.ROLES[r] if n in seen]
        more = F.when(F.col("repeats").isNotNull(), F.coalesce(*[F.get(again(n, READ[r]), F.lit(0)) for n in own], READ[r](F.lit(None).cast("string"))))
        return F.coalesce(*[READ[r](cell(n)) for n in own], more)

    out = [C.quoted(file_id), F.col("row_no"), *[role(r).alias(r) for r in C.ROLES]]
    taken = [file_id, "row_no", "time", "lat", "lon", "id"]
    spark_type = {"integer": "bigint", "decimal": "double", "text": "string"}
    for n in sorted(names, key=lambda n: n["name"]):
        v = cell(n["name"])
        tag = F.when(v.rlike(f"^{INTEGER.pattern}$"), "integer").when(v.rlike(f"^{DECIMAL.pattern}$"), "decimal").otherwise("text")
        branches = [F.when(tag == a, v.try_cast(spark_type[a])).alias(a) for a in n["alternatives"]]
        if n["role"]:
            v = F.when(v.isNotNull(), F.struct(v.alias("raw"), *branches, READ[n["role"]](v).alias("canonical")))
        elif len(n["alternatives"]) > 1:
            v = F.struct(*branches, v.try_cast(spark_type[n["kind"]]).alias("canonical"))
        else:
            v = v.try_cast(spark_type[n["kind"]])
        name = C.free_name(taken, n["name"] or "unnamed")
        taken.append(name)
        out.append(v.alias(name))
    for n in ("repeats", "surplus"):
        taken.append(C.free_name(taken, n))
        out.append(F.col(n).alias(taken[-1]))
    return long.select(*out)
