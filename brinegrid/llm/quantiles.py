"""Mergeable percentiles of numeric columns: dyadic Count-sketches.

Values are encoded as integers of `bits` bits that keep their order. For every binary resolution there is one signed
Count-sketch of the codes cut to that resolution. A sketch is a table (keys, cell, value), merged by adding values; deletions are additions of weight -1. Quantiles are found by going down the levels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import columns as C

BITS, WIDTH, DEPTH = 32, 2048, 5
#: Stated rank error, as a share of all values, for WIDTH and DEPTH as above.
EPSILON = 0.01
RESERVED = {"cell", "v", "w", "_x", "band", "cells", "vs", "n", "q", "value", "one"}


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about so many rows."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def encode(x: np.ndarray) -> np.ndarray:
    """x's order as integers in [0, 2^32): the bits of the single-precision form, the sign folded in. -0.0 counts as 0.0."""
    with np.errstate(over="ignore"):
        bits = (np.asarray(x, np.float64).astype(np.float32) + np.float32(0)).view(np.uint32).astype(np.int64)
    return np.where(bits >> 31 == 1, 2**31 - 1 - (bits & (2**31 - 1)), bits + 2**31)


def decode(code: np.ndarray) -> np.ndarray:
    code = np.asarray(code, dtype=np.int64)
    bits = np.where(code >= 2**31, code - 2**31, (2**31 - 1 - code) | (1 << 31)).astype(np.uint32)
    return bits.view(np.float32).astype(np.float64)


def _exact_levels(bits: int, width: int) -> int:
    """From this level on, the nodes fit into the buckets: they are counted exactly."""
    return max(0, bits - (width.bit_length() - 1))


#: Levels whose cells travel together; rows of a chunk; groups a task holds as dense arrays (2.7 MB each with the default sizes).
BAND, CHUNK_ROWS, MOST_GROUPS = 8, 200_000, 24


def _add(dense: np.ndarray, codes: np.ndarray, weights: np.ndarray, bits: int, width: int, depth: int) -> None:
    """Add the codes of one group to its sketch (levels, rows, buckets)."""
    exact = _exact_levels(bits, width)
    for level in range(bits, -1, -1):
        node = codes >> level
        if level >= exact:
            dense[level, 0] += np.bincount(node, weights, width).astype(np.int64)
            continue
        at = node_start(node)
        for row in range(depth):
            h = node_end(at, level, row)
            dense[level, row] += np.bincount(np.mod(h, width), np.where((h >> 40) & 1 == 1, weights, -weights), width).astype(np.int64)


def sketch(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None, width: int = WIDTH, depth: int = DEPTH, bits: int = BITS, chunk_rows: int = CHUNK_ROWS, most_groups: int = MOST_GROUPS) -> DataFrame:
    """(by..., cell, v): the sketch of df's values per group. weight: a column of +1 / -1 (insert, delete).

    cell numbers (level, hash row, bucket): (level x depth + row) x width + bucket. Null and NaN values are left out;
    infinities are values. Rows become a sketch where they are read: every task adds them to arrays of its groups, a chunk at
    a time, and gives these away when they are many. Only sketches are shuffled, so a hot group costs no hot task, and values
    that are all different cost no more shuffling than rounded ones. Grouping columns may hold nulls (a group of its own). An
    empty table gives an empty sketch. Grouping columns can't be named as in RESERVED.
    """
    if RESERVED & {b.lower() for b in by}:
        raise ValueError(f"by must not name one of {sorted(RESERVED)}")
    x = C.quoted(value).cast("double")
    w = C.quoted(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    by = list(by)
    given = df.where(x.isNotNull() & ~F.isnan(x)).select(*[C.quoted(b) for b in by], x.alias("_x"), w.alias("w"))
    fields = [given.schema[b] for b in by]
    part = T.StructType([*fields, T.StructField("band", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("vs", T.ArrayType(T.LongType()))])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    size, span = (bits + 1) * depth * width, BAND * depth * width

    def given_away(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for key, dense in held.items():
            flat = dense.reshape(-1)
            cells = np.nonzero(flat)[0]
            cuts = np.searchsorted(cells, np.arange(0, size + span, span))
            n = len(cuts) - 1
            lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), a) for a in (pa.array(cells.astype(np.int32)), pa.array(flat[cells]))]
            yield pa.RecordBatch.from_arrays([*[pa.array([k] * n, t) for k, t in zip(key, kinds)], pa.array(np.arange(n, dtype=np.int32)), *lists], names=part.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for t in chunks(batches, chunk_rows):
            group = np.zeros(t.num_rows, np.int64)
            for b in by:  # groups are numbered column by column
                codes = t[b].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
                _, group = np.unique(group * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
            codes, weights = encode(t["_x"].to_numpy()), t["w"].to_numpy()
            pairs, inverse = np.unique(group << bits | codes, return_inverse=True)
            total = np.bincount(inverse, weights).astype(np.int64)
            _, first = np.unique(group, return_index=True)
            keys = list(zip(*[t[b].take(pa.array(first)).to_pylist() for b in by])) if by else [()] * len(first)
            cuts = np.searchsorted(pairs >> bits, np.arange(len(first) + 1))
            for g, key in enumerate(keys):
                if key not in held:
                    if len(held) >= most_groups:
                        yield from given_away(held)
                        held.clear()
                    held[key] = np.zeros((bits + 1, depth, width), np.int64)
                own = slice(cuts[g], cuts[g + 1])
                _add(held[key], pairs[own] & ((1 << bits) - 1), total[own], bits, width, depth)
        yield from given_away(held)

    def merged(t: pa.Table) -> pa.Table:
        band = t["band"][0].as_py()
        dense = np.zeros(span, np.int64)
        for cells, vs in zip(t["cells"], t["vs"]):
            dense[cells.values.to_numpy() - band * span] += vs.values.to_numpy()
        at = np.nonzero(dense)[0]
        zero = pa.array(np.zeros(len(at), np.int64))
        return pa.table([*[t[b].take(zero) for b in by], pa.array((at + band * span).astype(np.int32)), pa.array(dense[at])], names=[*by, "cell", "v"])

    out = T.StructType([*fields, T.StructField("cell", T.IntegerType()), T.StructField("v", T.LongType())])
    return given.mapInArrow(run, part).groupBy(*[C.quoted(b) for b in by], "band").applyInArrow(merged, out)


def merge_sketches(sketches: Sequence[DataFrame]) -> DataFrame:
    """The sketch of all data together. Sketches must have the same columns and the same width, depth and bits."""
    all_of = reduce(DataFrame.unionByName, sketches)
    return all_of.groupBy(*[c for c in all_of.columns if c != "v"]).agg(F.sum("v").alias("v")).where("v <> 0")


def drop_column_from_sketch(s: DataFrame, *names: str) -> DataFrame:
    """A coarser sketch: per chunk or day -> over all of them, by addition."""
    return merge_sketches([s.drop(*names)])


# the JVM's xxhash64 of (long node, int level, int row), vectorized; checked against Spark in the tests
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _fmix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed + _P5 + np.uint64(8)
    h ^= _rot(x * _P2, 31) * _P1
    return _fmix(_rot(h, 27) * _P1 + _P4)


def _hash_int(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed + _P5 + np.uint64(4)
    h = h ^ (x * _P1)
    return _fmix(_rot(h, 23) * _P2 + _P3)


def node_start(node: np.ndarray) -> np.ndarray:
    """The part of the hash that depends on the node only."""
    with np.errstate(over="ignore"):
        return _hash_long(np.asarray(node).astype(np.uint64), np.uint64(42))


def node_end(start: np.ndarray, level: int, row: int | np.ndarray) -> np.ndarray:
    """xxhash64(node, level, row) from node_start(node), as signed numbers."""
    with np.errstate(over="ignore"):
        return _hash_int(np.asarray(row).astype(np.uint64), _hash_int(np.uint64(level), start)).astype(np.int64)


def node_hash(node: int, level: int, rows: np.ndarray) -> np.ndarray:
    """xxhash64(node, level, row) for all rows."""
    return node_end(node_start(np.array([node])), level, rows)


def _descend(cells: np.ndarray, exact: int, width: int, depth: int, bits: int, total: int, q: float) -> int:
    """The code of the value whose rank is q x total. cells: (level, row, bucket)."""
    rows = np.arange(depth)
    target, node = q * total, 0
    for level in range(bits - 1, -1, -1):
        left = node * 2
        if level >= exact:
            n = cells[level, 0, left]
        else:
            h = node_hash(left, level, rows)
            signs = np.where((h >> 40) & 1 == 1, 1, -1)
            n = np.median(signs * cells[level, rows, np.mod(h, width)])
        n = max(0, n)
        if target < n:
            node = left
        else:
            target -= n
            node = left + 1
    return node


def quantiles(s: DataFrame, qs: Sequence[float], by: Sequence[str] = (), width: int = WIDTH, depth: int = DEPTH, bits: int = BITS) -> DataFrame:
    """(by..., n, q, value): the values at ranks q of each group of a sketch; rank error at most EPSILON x n with the
    default width and depth (probability over 0.99 per group; values as single-precision numbers).

    One task holds one group's sketch, whose size is fixed by width, depth and bits, however many values went in. A group
    whose weights add up to nothing has no row. q in 0..1, else ValueError.
    """
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("q must be in 0..1")
    exact, qs = _exact_levels(bits, width), list(qs)
    fields = [s.schema[b] for b in by]
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("q", T.DoubleType()), T.StructField("value", T.DoubleType())])
    by = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros((bits + 1) * depth * width, dtype=np.int64)
        np.add.at(cells, pdf["cell"].to_numpy(), pdf["v"].to_numpy())
        cells = cells.reshape(bits + 1, depth, width)
        total = int(cells[bits, 0, 0])
        if total <= 0:
            return pd.DataFrame(columns=schema.names)
        codes = [_descend(cells, exact, width, depth, bits, total, min(q, 1 - 0.5 / total)) for q in qs]
        out = pd.DataFrame({"n": total, "q": qs, "value": decode(np.array(codes))})
        for k, b in enumerate(by):
            out.insert(k, b, [pdf[b].iloc[0]] * len(qs))
        return out

    keyed = s if by else s.withColumn("one", F.lit(1))
    return keyed.groupBy(*(by or ["one"])).applyInPandas(run, schema)
