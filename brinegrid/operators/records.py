"""Separating the records that fail to parse, with the reason and its offset.

A quote-aware finite-state tokenizer runs over the raw bytes of a whole Arrow batch at once. Records are cut into
chunks; for every chunk the transition function (state before -> state after) is computed for all start states
together, the functions of a record's chunks are composed to get each chunk's true start state, and a second pass from
those states finds field separators and the first error. So a record of any length costs the same per byte, and no
Python code runs per byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import columns as C

START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
OTHER, COMMA, QUOTE, BREAK, PAD = range(5)
# The next state by byte class (rows) and state (columns).
NEXT = np.array(
    [
        [PLAIN, PLAIN, QUOTED, BROKEN, BROKEN],
        [START, START, QUOTED, START, BROKEN],
        [QUOTED, BROKEN, CLOSED, QUOTED, BROKEN],
        [BROKEN, BROKEN, QUOTED, BROKEN, BROKEN],
        [START, PLAIN, QUOTED, CLOSED, BROKEN],
    ],
    dtype=np.uint8,
)
#: The same for files that are read leniently: a quote inside a plain field is text, and so is what follows a closing quote.
NEXT_LENIENT = np.array(
    [
        [PLAIN, PLAIN, QUOTED, PLAIN, PLAIN],
        [START, START, QUOTED, START, START],
        [QUOTED, PLAIN, CLOSED, QUOTED, PLAIN],
        [START, START, QUOTED, START, START],
        [START, PLAIN, QUOTED, CLOSED, BROKEN],
    ],
    dtype=np.uint8,
)
#: The strict rules for whole files, where a line break outside quotes ends a record, and a broken one too.
NEXT_IN_FILE = NEXT.copy()
NEXT_IN_FILE[BREAK] = [START, START, QUOTED, START, START]
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[ord(",")], CLASS[ord('"')], CLASS[ord("\n")], CLASS[ord("\r")] = COMMA, QUOTE, BREAK, BREAK



@dataclass(frozen=True)
class Field:
    """A field of a record: its name, kind (date, number, integer or text), whether a record fails that lacks a readable value, and
    the limits of a value (years for dates), both included."""

    name: str
    kind: str = "text"
    strict: bool = False
    low: float | None = None
    high: float | None = None


# The fields of the fleet files, the years they cover and the ranges of positions.
FLEET = (
    Field("date", "date", True, 2012, 2019),
    Field("cell_ll_lat", "number", True, -90, 90),
    Field("cell_ll_lon", "number", True, -180, 180),
    Field("flag"),
    Field("geartype"),
    Field("hours", "number"),
    Field("fishing_hours", "number"),
    Field("mmsi_present", "integer"),
)
BLOCK_BYTES = 4 << 20
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"


def _compose(chunk_fn: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state at the start of each chunk. chunk_fn: (chunks, states); first: index of the record's first chunk, per chunk.

    Functions are composed by doubling: after step k each chunk holds the composition of up to 2^k chunks ending with it.
    """
    n = len(chunk_fn)
    upto = chunk_fn.copy()
    at = np.arange(n)
    step, longest = 1, int((at - first).max(initial=0)) + 1
    while step < longest:
        has = at - step >= first
        idx = at[has]
        upto[idx] = np.take_along_axis(upto[idx], upto[idx - step], axis=1)
        step *= 2
    begin = np.full(n, START, dtype=np.uint8)
    later = at > first
    begin[later] = upto[at[later] - 1, START]
    return begin


def tokenize(data: np.ndarray, offsets: np.ndarray, chunk: int = 64, table: np.ndarray = NEXT, marks: tuple[int, ...] = (COMMA,)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data: bytes of all records; offsets: n + 1 bounds. Returns the positions of separators (of the classes marks, outside
    quotes), the record of each separator, the position of each record's first error (-1: none) and each record's last
    state."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    parts = np.maximum(1, -(-size // chunk))
    owner = np.repeat(np.arange(n), parts)
    first = np.repeat(np.cumsum(parts) - parts, parts)
    begin_at = offsets[:-1][owner] + (np.arange(len(owner)) - first) * chunk
    length = np.minimum(chunk, offsets[1:][owner] - begin_at)
    grid = begin_at[:, None] + np.arange(chunk)[None, :]
    inside = np.arange(chunk)[None, :] < length[:, None]
    kinds = np.full(grid.shape, PAD, dtype=np.uint8)
    kinds[inside] = CLASS[data[grid[inside]]]
    fn = np.tile(np.arange(5, dtype=np.uint8), (len(owner), 1))
    for c in range(chunk):
        fn = table[kinds[:, c][:, None], fn]
    state = _compose(fn, first)
    want = np.isin(np.arange(5), marks)
    seps, breaks = np.zeros(grid.shape, dtype=bool), np.zeros(grid.shape, dtype=bool)
    for c in range(chunk):
        k = kinds[:, c]
        seps[:, c] = want[k] & (state != QUOTED) & ((state != BROKEN) | (k == BREAK))
        new = table[k, state]
        breaks[:, c] = (new == BROKEN) & (state != BROKEN)
        state = new
    error = np.full(n, -1, dtype=np.int64)
    e_row, e_col = np.nonzero(breaks)
    error[owner[e_row[::-1]]] = grid[e_row[::-1], e_col[::-1]]  # the first of each is written last
    last = np.zeros(n, dtype=np.uint8)
    last[owner] = state  # the last chunk of a record is written last
    s_row, s_col = np.nonzero(seps)
    return grid[s_row, s_col], owner[s_row], error, last


#: Spark and Arrow types by kind of field.
_KINDS = {"date": (T.DateType(), pa.date32()), "number": (T.DoubleType(), pa.float64()), "integer": (T.IntegerType(), pa.int32()), "text": (T.StringType(), pa.string())}
ERROR = T.StructType([T.StructField("reason", T.StringType()), T.StructField("field", T.StringType()), T.StructField("offset", T.LongType())])
ERROR_ARROW = pa.struct([("reason", pa.string()), ("field", pa.string()), ("offset", pa.int64())])


# Reasons, numbered in the order in which they are tried.
REASONS = ("", "no record", "line break outside quotes", "quote inside a plain field", "text after a closing quote", "quote never closed", "too few fields", "too many fields", "not a date", "no such day", "year out of range", "not a number", "out of range")
_CODE = {r: k for k, r in enumerate(REASONS)}
_MONTH_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _texts_raw(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an array of strings."""
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.repeat(starts - off[:-1], size) + np.arange(off[-1])
    raw = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[at]))])
    try:
        return raw.cast(pa.large_string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())


def texts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Fields as texts; outer quotes and doubled inner ones are undone."""
    quoted = (ends > starts) & (data[np.minimum(starts, max(0, len(data) - 1))] == ord('"')) if len(data) else np.zeros(len(starts), bool)
    return pc.replace_substring(_texts_raw(data, starts + quoted, ends - quoted), '""', '"')


def matches(text: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(text, rf"\A(?:{pattern})\z").to_numpy(zero_copy_only=False).astype(bool)


def _numbers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and which texts are plain decimal numbers; NaN for the others. Spaces around don't count."""
    t = pc.utf8_trim(text, " ")
    ok = matches(t, NUMBER)
    out = np.full(len(t), np.nan)
    plain = pc.replace_substring_regex(t.filter(pa.array(ok)), r"\A\+", "")
    try:
        out[ok] = plain.cast(pa.float64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:  # beyond a double's range
        out[ok] = [float(x) for x in plain.to_pylist()]
    return out, ok


def _integers(text: pa.Array) -> pa.Array:
    t = pc.utf8_trim(text, " ")
    ok = matches(t, "[+-]?[0-9]{1,15}")
    x = np.zeros(len(t), np.int64)
    x[ok] = pc.replace_substring_regex(t.filter(pa.array(ok)), r"\A\+", "").cast(pa.int64()).to_numpy(zero_copy_only=False)
    return pa.array(x, mask=~(ok & (x >= -(2**31)) & (x < 2**31))).cast(pa.int32())


def _days(text: pa.Array, low: float | None, high: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and the code of what is wrong (0: nothing)."""
    t = pc.utf8_trim(text, " ")
    ok = matches(t, DATE)
    y, m, d = (np.zeros(len(t), np.int64) for _ in range(3))
    good = t.filter(pa.array(ok))
    for x, (a, z) in ((y, (0, 4)), (m, (5, 7)), (d, (8, 10))):
        x[ok] = pc.utf8_slice_codeunits(good, a, z).cast(pa.int64()).to_numpy(zero_copy_only=False)
    leap = (m == 2) & ((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)))
    real = ok & (m >= 1) & (m <= 12) & (d >= 1) & (d <= _MONTH_DAYS[np.clip(m, 0, 12)] + leap) & (y > 0)
    days = ((y - 1970) * 12 + m - 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1
    code = np.where(~ok, _CODE["not a date"], np.where(~real, _CODE["no such day"], np.where(_outside(y, low, high), _CODE["year out of range"], 0)))
    return days, code


def _outside(x: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    return ~((x >= (-np.inf if low is None else low)) & (x <= (np.inf if high is None else high)))


def _values(field: Field, text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a field, null where they can't be read, and the code of what is wrong (0: nothing)."""
    if field.kind == "text":
        return text.cast(pa.string()), np.zeros(len(text), np.int64)
    if field.kind == "date":
        days, code = _days(text, field.low, field.high)
        return pa.array(days.astype(np.int32), mask=code > 0).cast(pa.date32()), code
    x, ok = _numbers(text)
    code = np.where(~ok, _CODE["not a number"], np.where(_outside(x, field.low, field.high), _CODE["out of range"], 0))
    if field.kind == "number":
        return pa.array(x, mask=code > 0), code
    whole = _integers(text)
    return whole, np.where(whole.is_null().to_numpy(zero_copy_only=False), np.maximum(code, _CODE["not a number"]), code)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 bounds of n texts; null is empty."""
    texts = pc.fill_null(pa.concat_arrays([texts.cast(pa.large_string())]), "")
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)), offsets


def parts_of(batch: pa.RecordBatch, at: int, most_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of a few MB of the texts in column at: the tokenizer's arrays take about twenty times that."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    k = 0
    while k < batch.num_rows:
        z = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + most_bytes, side="right")))
        yield batch.slice(k, z - k)
        k = z


def _spread(values: pa.Array, rows: np.ndarray, n: int) -> pa.Array:
    """values at rows of n, null elsewhere."""
    at = np.zeros(n, np.int64)
    at[rows] = np.arange(len(rows))
    there = np.zeros(n, bool)
    there[rows] = True
    return values.take(pa.array(at, mask=~there))


def _read(lines: pa.Array, header: np.ndarray, layout: tuple[Field, ...]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Unread fields, records and errors of one batch; all are null for header lines."""
    n = len(lines)
    null = lines.is_null().to_numpy(zero_copy_only=False)
    data, offsets = raw_bytes(lines)
    seps, owner, broken, last = tokenize(data, offsets)
    begin, end = offsets[:-1], offsets[1:]
    fields = np.bincount(owner, minlength=n) + 1
    want = len(layout)

    code, where, which = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    many = np.minimum(bounds[:-1] + want - 1, np.maximum(len(seps) - 1, 0))
    for wrong, reason, at in (
        (null, "no record", None),
        (broken >= 0, None, broken),
        (last == QUOTED, "quote never closed", end),
        (fields < want, "too few fields", end),
        (fields > want, "too many fields", seps[many] if len(seps) else end),
    ):
        new = wrong & (code == 0) & ~header
        if reason is None:
            what = data[np.maximum(broken, 0)] if len(data) else np.zeros(n, np.uint8)
            code[new] = np.where((what == 10) | (what == 13), _CODE["line break outside quotes"], np.where(what == 34, _CODE["quote inside a plain field"], _CODE["text after a closing quote"]))[new]
        else:
            code[new] = _CODE[reason]
        if at is not None:
            where[new] = (at - begin)[new]

    rows = np.nonzero((code == 0) & ~header)[0]
    cuts = np.empty((len(rows), want + 1), np.int64)
    cuts[:, 0], cuts[:, want] = begin[rows] - 1, end[rows]
    if len(rows):
        cuts[:, 1:want] = seps[bounds[rows][:, None] + np.arange(want - 1)]
    f = [texts_of(data, cuts[:, k] + 1, cuts[:, k + 1]) for k in range(want)]
    read = [_values(x, t) for x, t in zip(layout, f)]
    for k, (x, (_, bad)) in enumerate(zip(layout, read)):
        if x.strict:
            new = (bad > 0) & (code[rows] == 0)
            code[rows[new]], which[rows[new]], where[rows[new]] = bad[new], k, (cuts[:, k] + 1 - begin[rows])[new]

    good = code[rows] == 0
    keep = pa.array(good)
    there = np.zeros(n, bool)
    there[rows[good]] = True
    types = [pa.field(x.name, _KINDS[x.kind][1]) for x in layout]
    record = pa.StructArray.from_arrays([_spread(v.filter(keep), rows[good], n) for v, _ in read], fields=types, mask=pa.array(~there))
    # what is written in a free field but can't be read as its type
    unread = np.zeros((n, want), bool)
    for k, (x, (_, bad)) in enumerate(zip(layout, read)):
        if not x.strict and x.kind != "text":
            unread[rows, k] = (bad > 0) & good & ~pc.equal(pc.binary_length(pc.utf8_trim(f[k], " ")), 0).to_numpy(zero_copy_only=False)
    row, col = np.nonzero(unread)
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array([x.name for x in layout]).take(pa.array(col)))
    words = pa.array(REASONS).take(pa.array(code))
    names = pa.array([x.name for x in layout]).take(pa.array(which, mask=which < 0))
    error = pa.StructArray.from_arrays([words, names, pa.array(where, mask=where < 0)], fields=list(ERROR_ARROW), mask=pa.array(code == 0))
    return lists.take(pa.array(np.arange(n), mask=~there)), record, error


def parse_records(df: DataFrame, line_col: str = "line", number_col: str | None = "line_no", layout: Sequence[Field] = FLEET) -> DataFrame:
    """Every row of df with three more columns: `unread` (of valid rows, the names of free fields that hold something their type can't
    read), `record` (a struct of the layout's fields; null for failures) and `error` (reason, field, offset in bytes from the
    record's start; null for valid rows). All are null for header lines (number_col = 1).

    Existing columns of those names are kept; the new ones then get underscores. A null line fails as `no record`, an
    empty one as `too few fields`. Repeated rows are judged each for itself. Strict fields must be readable and within their
    limits; the others are free: what can't be read as their type is null. An empty table gives an empty result. No shuffle.
    """
    taken = df.columns
    layout = tuple(layout)
    rec, err, odd = (C.free_name(taken, n) for n in ("record", "error", "unread"))
    record = T.StructType([T.StructField(x.name, _KINDS[x.kind][0]) for x in layout])
    schema = T.StructType([*df.schema.fields, T.StructField(odd, T.ArrayType(T.StringType())), T.StructField(rec, record), T.StructField(err, ERROR)])
    at = taken.index(line_col)
    num = taken.index(number_col) if number_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts_of(b, at):
                header = pc.fill_null(pc.equal(part.column(num), 1), False).to_numpy(zero_copy_only=False).astype(bool) if num is not None else np.zeros(part.num_rows, bool)
                yield pa.RecordBatch.from_arrays([*part.columns, *_read(part.column(at), header, layout)], names=schema.names)

    return df.mapInArrow(run, schema)


def split_records(files: DataFrame, content_col: str = "content") -> DataFrame:
    """The records of whole CSV files: files without their content, with columns line_no (1 is the header), line and
    offset (in bytes). A line break within quotes belongs to the record; CR LF, CR and LF end one. Empty lines between
    records are dropped but counted; a file that is null or empty has no records. A quote that is never closed takes in the
    rest of its file, as one record that fails. Existing columns of those names are kept; the new ones get underscores.

    A file is one row, cut into chunks whose states are composed, so its size makes no difference per byte.
    """
    rest = [f for f in files.schema.fields if f.name != content_col]
    names = [f.name for f in rest]
    for n in ("line_no", "line", "offset"):
        names.append(C.free_name(names, n))
    schema = T.StructType([*rest, T.StructField(names[-3], T.IntegerType()), T.StructField(names[-2], T.StringType()), T.StructField(names[-1], T.LongType())])
    at = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                text = b.column(at)[k].as_py()
                if not text:
                    continue
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                ends = tokenize(data, np.array([0, len(data)]), 256, NEXT_IN_FILE, (BREAK,))[0]
                pair = (data[ends] == 10) & (ends > 0) & (data[np.maximum(ends - 1, 0)] == 13)  # CR LF is one end
                start = np.concatenate([[0], ends + 1])
                stop = np.concatenate([ends, [len(data)]])
                keep = np.concatenate([~pair, [start[-1] < len(data)]])
                no = np.cumsum(keep)
                keep &= stop > start
                line = _texts_raw(data, start[keep], stop[keep])
                n = len(line)
                same = [c.slice(k, 1).take(pa.array(np.zeros(n, np.int64))) for c in b.columns[:at]]
                yield pa.RecordBatch.from_arrays([*same, pa.array(no[keep].astype(np.int32)), line.cast(pa.string()), pa.array(start[keep].astype(np.int64))], names=names)

    return files.select(*[C.quoted(f.name) for f in rest], C.quoted(content_col)).mapInArrow(run, schema)


def _added(parsed: DataFrame) -> tuple[str, str, str]:
    """The columns that parse_records added: unread, record, error."""
    return tuple(parsed.columns[-3:])


def valid_records(parsed: DataFrame) -> DataFrame:
    """The typed rows, with what identified them. Field names of the record win; clashing input columns get underscores."""
    added = _added(parsed)
    names = list(parsed.schema[added[1]].dataType.names)
    others = []
    for c in parsed.columns:
        if c not in added:
            new = C.free_name(names, c)
            names.append(new)
            others.append(C.quoted(c).alias(new))
    return parsed.where(C.quoted(added[1]).isNotNull()).select(f"{added[1]}.*", *others)


def failed_records(parsed: DataFrame) -> DataFrame:
    """The other rows, with reason, field and offset."""
    odd, rec, err = _added(parsed)
    return parsed.where(C.quoted(err).isNotNull()).drop(rec, odd)


def failure_report(parsed: DataFrame, by: str = "file_name") -> DataFrame:
    """Rows, failures and failures by reason for each file."""
    reason = C.quoted(_added(parsed)[2])["reason"]
    return parsed.groupBy(by, reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))
