"""Uniform samples of fixed size from data of unknown length: bottom-k by independent random keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "sample_key"


def _smallest(k: int, at: int):
    """Keeps the k rows with the smallest keys of a partition, in memory for k + one batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        bound = np.inf
        for b in batches:
            if not b.num_rows:
                continue
            if bound < np.inf:
                b = b.filter(pc.less(b.column(at), bound))
                if not b.num_rows:
                    continue
            t = pa.Table.from_batches([b])
            kept = t if kept is None else pa.concat_tables([kept, t])
            if kept.num_rows > k:
                keys = kept.column(at).to_numpy()
                kept = kept.take(pa.array(np.argpartition(keys, k - 1)[:k]))
                bound = float(keys[np.argpartition(keys, k - 1)[k - 1]])
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return run


def _merge(df: DataFrame, k: int, fan: int) -> DataFrame:
    """The k smallest of all partitions. Heaps are merged over a tree: first over all shuffle partitions, then fan to one;
    a task streams what it gets through its own heap, so none holds more than k rows and a batch."""
    at = df.columns.index(KEY)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        df = df.repartition(n, F.xxhash64(KEY)).mapInArrow(_smallest(k, at), df.schema)
        if n == 1:
            return df
        n = -(-n // fan)


def sample_state(df: DataFrame, k: int, seed: int, fan: int = 64) -> DataFrame:
    """df's k rows with the smallest random keys, as rows of df plus `sample_key`: a state that can be stored and merged.

    Every row gets an independent uniform key in [0, 1); each partition keeps its k smallest in a heap, and heaps are
    merged over a tree. So every row is equally likely to be chosen, repeated rows each for itself, and the data's size
    is not needed. With fewer than k rows all are kept; an empty table gives an empty state. k >= 1. Rows with nulls are
    rows like any other: filter first. Different pieces of data need different seeds.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if KEY in df.columns:
        raise ValueError(f"a column named {KEY} is there already: pass states to merge_states, or rename it")
    keyed = df.withColumn(KEY, F.rand(seed))
    schema = T.StructType([*df.schema.fields, T.StructField(KEY, T.DoubleType())])
    at = len(df.columns)
    return _merge(keyed.mapInArrow(_smallest(k, at), schema), k, fan)


def merge_states(states: list[DataFrame], k: int, fan: int = 64) -> DataFrame:
    """The state of all pieces together: the k smallest keys of their states. Order doesn't matter."""
    if not states:
        raise ValueError("no states")
    return _merge(reduce(DataFrame.unionByName, states), k, fan)


def sample(state: DataFrame) -> DataFrame:
    """The chosen rows of a state, without their keys."""
    return state.drop(KEY)
