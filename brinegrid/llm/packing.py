"""Packing texts into containers of fixed capacity: hierarchical, by length, over any number of texts.

Lengths are whole numbers up to the capacity, so how many texts there are of each length says all that packing needs.
That histogram (at most `capacity` numbers, however large the corpus) is packed on the driver, many equal containers at
a time: texts are routed to tiers of context sizes, the longest tier opens containers, and the gaps of long windows are
filled from the shorter tiers, best fit first. The plan says which ranks of each length go into which containers, and
every text finds its own container from its length and rank, without any text meeting another.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import columns as C
from ..session import materialize
from .tokens import default_path, encode, encoding

CAPACITY = 2048
TIERS = (256, 512, 1024, 2048)


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """(id_col, n_tokens): one row per row of df. A null or empty text has 0 tokens. No shuffle."""
    path = vocabulary or default_path()
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(encode(enc, t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=schema.names)

    return df.select(C.quoted(id_col), C.quoted(text_col)).mapInArrow(run, schema)


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY, tiers: Sequence[int] = TIERS) -> list[tuple]:
    """Packs counts of lengths. Returns rows (length, rank_from, rank_to, container_from, per_container, offset, tier).

    Items of that length with ranks in [rank_from, rank_to) lie per_container to a container, in containers numbered on
    from container_from, the first of each at offset. Every step empties either a length or a set of equal gaps, so steps
    and rows depend on the number of different lengths, not on the number of items.
    """
    plan: list[tuple] = []
    given: dict[int, int] = defaultdict(int)
    gaps: dict[int, list] = defaultdict(list)  # gap -> runs [first container, containers, tier]
    order: list[int] = []
    made = 0

    def leave(gap: int, run: list) -> None:
        if gap not in gaps or not gaps[gap]:
            bisect.insort(order, gap)
        gaps[gap].append(run)

    def put(n: int, k: int, run: list, per: int, offset: int, items: int) -> None:
        plan.append((n, given[n], given[n] + items, run[0], per, offset, run[2]))
        given[n] += items

    for low, high in reversed(list(zip((0, *tiers), tiers))):
        for n in sorted((x for x in histogram if low < x <= high), reverse=True):
            left = histogram[n]
            while left:
                at = bisect.bisect_left(order, n)
                if at < len(order):  # the smallest gap that holds one: as many as fit into each container of one run
                    gap = order[at]
                    run = gaps[gap].pop()
                    if not gaps[gap]:
                        order.pop(at)
                    per = min(gap // n, left)
                    boxes = min(run[1], left // per)
                    if boxes < run[1]:
                        leave(gap, [run[0] + boxes, run[1] - boxes, run[2]])
                    put(n, 0, [run[0], boxes, run[2]], per, capacity - gap, per * boxes)
                    left -= per * boxes
                    if gap - per * n:
                        leave(gap - per * n, [run[0], boxes, run[2]])
                else:
                    per = min(capacity // n, left)
                    boxes = left // per
                    run = [made, boxes, high]
                    made += boxes
                    put(n, 0, run, per, 0, per * boxes)
                    left -= per * boxes
                    if capacity - per * n:
                        leave(capacity - per * n, run)
    return plan


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tiers: Sequence[int] = TIERS, group: int = 64, vocabulary: str | None = None) -> DataFrame:
    """(id_col, piece_no, token_start, n_tokens, container_id, container_offset, tier, step_group): where every text lies.

    A text of up to capacity tokens is one piece and never divided; a longer one is divided into full pieces and a rest.
    No container holds more than capacity tokens; every token lies in exactly one. tier is the context size of the longest
    text in the container; step_group numbers sets of about `group` containers that hold an equal share of every tier, so
    that steps cost the same. Null and empty texts come out once with 0 tokens and no container. Repeated rows and ids are
    packed each for itself; texts of equal length are ranked by where they are stored. An empty table gives an empty
    result. The last tier must be the capacity.

    Texts are read once; from then on a row is a few numbers. Ranks come from counts per (length, partition), so a length
    that a third of all texts share is no hot task.
    """
    if tiers[-1] != capacity or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must rise and end with the capacity")
    counts = token_counts(df, id_col, text_col, vocabulary)
    whole = F.floor((F.col("n_tokens") + capacity - 1) / capacity)
    pieces = counts.select(C.quoted(id_col).alias("id"), F.col("n_tokens").alias("all"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(whole - 1, F.lit(0).cast("bigint")))).alias("piece_no"))
    pieces = pieces.select("id", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("bigint"), F.col("all") - F.col("piece_no") * capacity).cast("int").alias("n_tokens"))
    # written once: text is tokenized once, and part and row stay what they are if a task is run again
    pieces = materialize(pieces.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "pieces")
    filled = pieces.where("n_tokens > 0")
    by_part = filled.groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["n_tokens"]: r["n"] for r in by_part.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_containers(histogram, capacity, tiers)
    before = by_part.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))).drop("n")
    ranked = filled.withColumn("own", F.row_number().over(Window.partitionBy("n_tokens", "part").orderBy("row")) - 1)
    ranked = ranked.join(before, ["n_tokens", "part"]).select("id", "piece_no", "token_start", "n_tokens", (F.col("before") + F.col("own")).alias("rank"))

    p = np.array(sorted(plan), dtype=np.int64).reshape(-1, 7)
    totals = {t: int(sum((q[2] - q[1]) // q[4] for q in plan if q[5] == 0 and q[6] == t)) for t in tiers}
    # containers of one tier, in order, are spread evenly over the groups
    n_groups = max(1, sum(totals.values()) // group)
    opened = np.array(sorted((q[3], (q[2] - q[1]) // q[4], q[6]) for q in plan if q[5] == 0), dtype=np.int64).reshape(-1, 3)
    within = np.zeros(len(opened), dtype=np.int64)
    for t in tiers:
        own = opened[:, 2] == t
        within[own] = np.cumsum(opened[own, 1]) - opened[own, 1]
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("token_start", T.LongType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("container_id", T.LongType()),
            T.StructField("container_offset", T.IntegerType()),
            T.StructField("tier", T.IntegerType()),
            T.StructField("step_group", T.LongType()),
        ]
    )
    wide = np.int64(1) << 44

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = p[:, 0] * wide + p[:, 1]
        for b in batches:
            n, rank = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy()
            q = p[np.searchsorted(starts, n * wide + rank, side="right") - 1]
            k = rank - q[:, 1]
            box = q[:, 3] + k // q[:, 4]
            run = np.searchsorted(opened[:, 0], box, side="right") - 1
            step = (within[run] + box - opened[run, 0]) % n_groups
            made = [box, (q[:, 5] + (k % q[:, 4]) * n).astype(np.int32), q[:, 6].astype(np.int32), step]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *map(pa.array, made)], names=schema.names)

    none = pieces.where("n_tokens = 0").select(F.col("id").alias(id_col), "piece_no", "token_start", "n_tokens", F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("container_offset"), F.lit(None).cast("int").alias("tier"), F.lit(None).cast("bigint").alias("step_group"))
    return ranked.mapInArrow(place, schema).unionByName(none) if plan else none
