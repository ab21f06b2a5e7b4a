"""Filling missing fields from similar records: nearest-neighbour hot deck.

Records are hash-blocked on what was observed of them (vessel; one-degree cell; a band of a known field). Within a
block, in order of time, the nearest donors before and after each incomplete record are found for every field; the closest
of all these by a distance over time, place and value give the weighted median (numbers) or the majority (categories).

Blocks are range-partitioned by (block, time), so a hot block lies in many partitions. Each partition is read in order, a
part at a time; what lies at its ends is told apart, and records that lack donors there find them in a second, small step
among the donors at the ends of partitions. So where the cuts lie changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import columns as C
from ..session import materialize

HOUR = 3_600_000_000
#: Added to the distance of a donor by how it was found.
LEVELS = {"vessel": 0.0, "place": 0.5, "similar": 5.0, "global": 50.0}
#: What is filled: positions, values, flags. A bit of a mask stands for each and for the side (before, after).
KINDS = ("p", "s", "f")
SELF = ("o", "v", "t", "la", "lo", "s", "f")
#: Where a record stands on an axis that it is asked on without having a place there: at its end.
LAST = 10**18
#: Records without donors of vessel or place that are sent to all tasks; more of them meet donors by the shuffle all others take.
FEW_STRAYS = 10_000
#: Rows that are looked at together.
PART_ROWS = 200_000


def _wrap(x: Column) -> Column:
    """Degrees of longitude into [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def _bits(kind: int) -> int:
    return 3 << (2 * kind)


def _found(block: np.ndarray, gives: list[np.ndarray], want: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows in order of (block, place in it). For every kind and side: for each row that wants it, the k nearest givers of its
    block, nearest first, as (wanting rows, their givers; -1 where there are fewer)."""
    out = []
    for kind in range(3):
        donors = np.nonzero(gives[kind])[0]
        for side in range(2):
            rows = np.nonzero(want & (1 << (2 * kind + side)))[0]
            at = np.searchsorted(donors, rows)[:, None] + (np.arange(k)[None, :] if side else -1 - np.arange(k)[None, :])
            ok = (at >= 0) & (at < len(donors))
            who = np.where(ok, donors[np.clip(at, 0, max(0, len(donors) - 1))] if len(donors) else -1, -1)
            out.append((rows, np.where((who >= 0) & (block[who] == block[rows][:, None]), who, -1)))
    return out


class _Scan:
    """One partition of rows in order of (block, x, o), read part by part. See _matched for the columns."""

    def __init__(self, k: int, schema: pa.Schema, final: bool):
        self.k, self.schema, self.final = k, schema, final
        self.rows: pa.Table | None = None
        self.fresh = 0  # rows kept from before, whose wants are settled but for self.pending
        self.pending = np.zeros(0, np.int64)
        self.first: int | None = None  # the first block
        self.head = [k] * 3  # its donors that are still to be told
        self.told = np.zeros(0, bool)  # of the rows kept: told as an end

    def step(self, new: pa.Table | None) -> Iterator[pa.RecordBatch]:
        """Take in more rows (None: there are no more) and give what is settled."""
        t = new if self.rows is None else self.rows if new is None else pa.concat_tables([self.rows, new])
        if t is None or not t.num_rows:
            return
        n = t.num_rows
        block = t["block"].to_numpy()
        give = t["give"].to_numpy().astype(bool)
        valid = lambda c: t[c].is_valid().to_numpy().astype(bool)
        gives = [give & valid("la") & valid("lo"), give & valid("s"), give & valid("f")]
        want = t["want"].to_numpy().copy()
        want[: self.fresh] = self.pending
        told = np.zeros(n, bool)
        told[: self.fresh] = self.told
        if self.first is None:
            self.first = block[0]
        open_block = block == block[-1] if new is not None else np.zeros(n, bool)
        lack = np.zeros(n, np.int32)
        wait = np.zeros(n, bool)
        asked = want != 0
        pieces = []
        for c, (rows, who) in enumerate(_found(block, gives, want, self.k)):
            short = who[:, -1] < 0
            if c % 2:
                wait[rows[short & open_block[rows]]] = True
                beyond = short & (block[rows] == block[-1])
            else:
                beyond = short & (block[rows] == self.first)
            if not self.final:
                lack[rows[beyond]] |= 1 << c
            pieces.append((c, rows, who, beyond & (not self.final)))
        ready = asked & ~wait
        if ready.any() or (new is None and not self.final):
            yield from self._settled(t, ready, lack, pieces)
        # the first donors of the first block, the last ones of the last
        ends = []
        if not self.final:
            for kind in range(3):
                seen = np.nonzero(gives[kind][self.fresh :] & (block[self.fresh :] == self.first))[0][: self.head[kind]] + self.fresh
                self.head[kind] -= len(seen)
                ends.append(seen)
                if new is None:
                    ends.append(np.nonzero(gives[kind] & (block == block[-1]))[0][-self.k :])
            at = np.unique(np.concatenate(ends))
            at = at[~told[at]]
            told[at] = True
            if len(at):
                yield self._batch(t.take(pa.array(at)), np.zeros(len(at), np.int32), True, np.zeros(len(at) + 1, np.int64), t, np.zeros(0, np.int64), np.zeros(0, np.int64))
        if new is None:
            self.rows = None
            return
        begin = int(np.argmax(open_block))
        keep = int(np.argmax(wait)) if wait.any() else n
        for kind in range(3):
            before = np.nonzero(gives[kind][begin:keep])[0]
            if len(before):
                keep = min(keep, begin + int(before[-self.k :][0])) if len(before) >= self.k else min(keep, begin + int(before[0]))
        self.rows, self.fresh = t.slice(keep), n - keep
        self.pending, self.told = np.where(wait, want, 0)[keep:], told[keep:]

    def _settled(self, t: pa.Table, ready: np.ndarray, lack: np.ndarray, pieces: list) -> Iterator[pa.RecordBatch]:
        at = np.nonzero(ready)[0]
        if not len(at):
            return
        place = np.full(len(ready), -1, np.int64)
        place[at] = np.arange(len(at))
        owner, donor, combo = [], [], []
        for c, rows, who, beyond in pieces:
            use = (who >= 0) & (ready[rows] & ~beyond)[:, None]
            owner.append(np.broadcast_to(place[rows][:, None], who.shape)[use])
            donor.append(who[use])
            combo.append(np.full(int(use.sum()), c // 2))
        owner, donor, combo = np.concatenate(owner), np.concatenate(donor), np.concatenate(combo)
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(at) + 1))
        yield self._batch(t.take(pa.array(at)), lack[at], False, bounds, t, donor[order], combo[order])

    def _batch(self, rows: pa.Table, lack: np.ndarray, end: bool, bounds: np.ndarray, t: pa.Table, donor: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        kept = ("block", "x", "level", *SELF)
        d = t.select(["o", "t", "la", "lo", "s", "f"]).take(pa.array(donor)).combine_chunks()
        item = self.schema.field("c").type.value_type
        one = lambda col, kind_: (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).cast(kind_)
        flat = pa.StructArray.from_arrays([pa.array(kind.astype(np.int32)), one(rows["level"], pa.string()).take(pa.array(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))), *[one(d[c], item.field(c).type) for c in ("o", "t", "la", "lo", "s", "f")]], fields=list(item))
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat).cast(self.schema.field("c").type)
        return pa.RecordBatch.from_arrays([*[one(rows[c], self.schema.field(c).type) for c in kept], pa.array(lack), pa.array(np.full(rows.num_rows, end)), lists], schema=self.schema)


def _scanned(sorted_rows: DataFrame, k: int, final: bool) -> DataFrame:
    """_Scan over every partition: block, x, level, the seeker's own columns, lack (mask of what may be beyond the partition), end
    (whether the row is no seeker but a donor at an end), c (donors: kind, level, o, t, la, lo, s, f)."""
    kinds = {f.name: f.dataType for f in sorted_rows.schema.fields}
    item = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("level", T.StringType()), *[T.StructField(c, kinds[c]) for c in ("o", "t", "la", "lo", "s", "f")]])
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in ("block", "x", "level", *SELF)], T.StructField("lack", T.IntegerType()), T.StructField("end", T.BooleanType()), T.StructField("c", T.ArrayType(item))])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held, size = _Scan(k, arrow, final), [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= PART_ROWS:
                yield from scan.step(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from scan.step(pa.Table.from_batches(held))
        yield from scan.step(None)

    return sorted_rows.mapInArrow(run, schema)


def _matched(rows: DataFrame, k: int, name: str) -> DataFrame:
    """rows: block, x, level, give (may be a donor), want (mask of kinds and sides it seeks) and the columns of SELF. For every
    seeker: level, its own columns and c, the k nearest donors on both sides of x in its block, for each kind it wants; in one
    row of step 1, and in another one of step 2 if not all of them were found in the first.

    The first step is written to the shared folder; the second one takes what it could not settle: seekers at the ends of
    partitions, and the donors there, at most 12k rows for each partition.
    """
    one = _scanned(rows.repartitionByRange("block", "x", "o").sortWithinPartitions("block", "x", "o"), k, False)
    one = materialize(one, name)
    rest = one.where("end or lack != 0").select("block", "x", "level", F.col("end").alias("give"), F.col("lack").alias("want"), *SELF)
    two = _scanned(rest.repartition("block").sortWithinPartitions("block", "x", "o"), k, True)
    had = one.where("not end").select("level", *SELF, "c", F.lit(1).alias("step"))
    return had.unionByName(two.select("level", *SELF, "c", F.lit(2).alias("step")))


def _axis(c: str) -> Column:
    """Where a record stands on an axis: microseconds, or millionths of a degree."""
    return F.col(c) if c == "t" else F.round(F.col(c) * 1_000_000).cast("bigint")


def _key(name: str) -> Column:
    """What records of a block have in common; `all` holds every record."""
    cell = (F.floor(F.least(F.col("la"), F.lit(89.999999))) + 90) * 360 + F.floor(F.col("lo")) + 180
    return {"vessel": F.col("v"), "place": F.when(F.col("la").isNotNull() & F.col("lo").isNotNull(), cell.cast("bigint")), "value": F.floor("s").cast("bigint"), "parallel": F.floor(F.col("la") / 5).cast("bigint"), "all": F.lit(0).cast("bigint")}[name]


def _block(name: str, axis: str) -> Column:
    return F.when(_key(name).isNotNull(), F.xxhash64(F.lit(name), F.lit(axis), _key(name)))


def _asks(stray: DataFrame) -> DataFrame:
    """Where seekers are asked for that found no donors of vessel or place, or have no time: one row per seeker and level, with
    rank (levels are tried in its order), of (name, axis) blocks."""
    timed = F.col("t").isNotNull()
    own = F.when(F.col("la").isNotNull(), "la").when(F.col("lo").isNotNull(), "lo").when(F.col("s").isNotNull(), "s")

    def ask(level: str, name: str, axis: str, when: Column, x: Column | None = None) -> Column:
        return F.when(when & _block(name, axis).isNotNull(), F.struct(F.lit(level).alias("level"), _block(name, axis).alias("block"), _key(name).alias("key"), (_axis(axis) if x is None else x).alias("x"), F.lit(f"{name} {axis}").alias("deck")))

    end = F.lit(LAST).cast("bigint")
    tries = [
        *[ask("vessel", "vessel", a, ~timed & (own == a)) for a in ("la", "lo", "s")],
        ask("vessel", "vessel", "t", ~timed & own.isNull(), end),
        ask("place", "place", "la", ~timed),
        ask("similar", "value", "t", timed),
        ask("similar", "parallel", "t", timed & F.col("s").isNull()),
        *[ask("similar", "all", a, ~timed & (own == a)) for a in ("la", "lo", "s")],
        ask("global", "all", "t", F.lit(True), F.coalesce("t", end)),
    ]
    a = stray.select(*SELF, "want", F.posexplode(F.array(*tries)).alias("rank", "a")).where("a is not null")
    return a.select(*SELF, "want", "rank", "a.*")


def _decks(decks: list[str]) -> Column:
    """The blocks of a donor in the given decks, each with its place there."""
    at = [F.struct(_block(*d.split()).alias("block"), _axis(d.split()[1]).alias("x")) for d in decks]
    return F.filter(F.array(*at), lambda b: b["block"].isNotNull() & b["x"].isNotNull())


def _strays(base: DataFrame, stray: DataFrame, k: int) -> DataFrame:
    """(columns of SELF, c) for seekers without donors so far: those of the first level that has any, for each kind.

    Few of them are sent to all tasks, and each partition of the donors tells its k nearest on each side; otherwise seekers
    and the donors of the blocks asked for go through _matched.
    """
    asks = _asks(stray)
    few = asks.limit(10 * FEW_STRAYS + 1).collect()
    if not few:
        return stray.select(*SELF).withColumn("c", F.lit(None).cast("array<int>")).where("false")
    donors = base.where("(la is not null and lo is not null) or s is not null or f is not null")
    if len(few) > 10 * FEW_STRAYS:
        decks = sorted(r["deck"] for r in asks.select("deck").distinct().collect())
        donors = donors.select(*SELF, F.explode(_decks(decks)).alias("b")).select("b.*", *SELF)
        sought = asks.select("block").distinct()
        givers = donors.join(sought, "block", "left_semi").select("block", "x", F.lit(None).cast("string").alias("level"), F.lit(True).alias("give"), F.lit(0).alias("want"), *SELF)
        seekers = asks.select("block", "x", F.concat(F.lpad(F.col("rank").cast("string"), 2, "0"), "level").alias("level"), F.lit(False).alias("give"), "want", *SELF)
        got = _matched(givers.unionByName(seekers), k, "strays").select(*SELF, F.explode("c").alias("d"))
        got = got.select(*SELF, F.col("d.kind").alias("kind"), F.substring("d.level", 1, 2).cast("int").alias("rank"), F.struct("d.kind", F.expr("substring(d.level, 3)").alias("level"), *[f"d.{c}" for c in ("o", "t", "la", "lo", "s", "f")]).alias("d"))
    else:
        got = _sent(donors, few, base, k)
    w = Window.partitionBy(*SELF, "kind")
    best = got.withColumn("least", F.min("rank").over(w)).where("rank = least")
    return best.groupBy(*SELF).agg(F.collect_set("d").alias("c"))


def _keys(name: str, t: pa.Table) -> np.ndarray:
    """The same as _key, of a table whose rows all have it."""
    num = lambda c: t[c].to_numpy()
    if name == "place":
        return (np.floor(np.minimum(num("la"), 89.999999)).astype(np.int64) + 90) * 360 + np.floor(num("lo")).astype(np.int64) + 180
    return {"vessel": lambda: num("v"), "value": lambda: np.floor(num("s")).astype(np.int64), "parallel": lambda: np.floor(num("la") / 5).astype(np.int64), "all": lambda: np.zeros(t.num_rows, np.int64)}[name]()


#: The columns a deck is made of.
_MADE_OF = {"vessel": ("v",), "place": ("la", "lo"), "value": ("s",), "parallel": ("la",), "all": ()}


def _sent(donors: DataFrame, asks: list, base: DataFrame, k: int) -> DataFrame:
    """(columns of SELF, kind, rank, d): the k nearest donors on each side of every ask, which are sent to all tasks."""
    kinds = {f.name: f.dataType for f in base.schema.fields}
    given = ("o", "t", "la", "lo", "s", "f")
    schema = T.StructType([T.StructField("ask", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("x", T.LongType()), *[T.StructField(c, kinds[c]) for c in given]])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    decks = {}
    for d in sorted({r["deck"] for r in asks}):
        own = [n for n, r in enumerate(asks) if r["deck"] == d]
        pick = lambda c, kind: np.array([asks[n][c] for n in own], kind)  # noqa: B023, E731
        decks[d] = (np.array(own), pick("key", np.int64), pick("x", np.int64), pick("want", np.int32))

    def near(t: pa.Table, deck: str) -> pa.RecordBatch | None:
        """t: donors in order of id."""
        name, axis = deck.split()
        own, keys, xs, wants = decks[deck]
        t = t.filter(np.logical_and.reduce([t[c].is_valid().to_numpy() for c in {*_MADE_OF[name], axis}]))
        key = _keys(name, t)
        t, key = t.filter(use := np.isin(key, keys)), key[use]
        n, m = t.num_rows, len(own)
        if not n:
            return None
        at = t[axis].to_numpy() if axis == "t" else np.round(t[axis].to_numpy() * 1_000_000).astype(np.int64)
        x, key = np.concatenate([at, xs]), np.concatenate([key, keys])
        order = np.lexsort((np.concatenate([np.ones(n, np.int8), np.zeros(m, np.int8)]), x, key))
        valid = lambda c: np.concatenate([t[c].is_valid().to_numpy().astype(bool), np.zeros(m, bool)])[order]
        found = _found(key[order], [valid("la") & valid("lo"), valid("s"), valid("f")], np.concatenate([np.zeros(n, np.int32), wants])[order], k)
        ask, combo, who = [], [], []
        for c, (rows, got) in enumerate(found):
            use = got >= 0
            ask.append(own[np.broadcast_to(order[rows][:, None], got.shape)[use] - n])
            who.append(order[got[use]])
            combo.append(np.full(int(use.sum()), c))
        ask, combo, who = (np.concatenate(z) for z in (ask, combo, who))
        d = t.take(pa.array(who)).combine_chunks()
        one = lambda c: (d[c].combine_chunks() if isinstance(d[c], pa.ChunkedArray) else d[c]).cast(arrow.field(c).type)
        return pa.RecordBatch.from_arrays([pa.array(ask.astype(np.int32)), pa.array((combo // 2).astype(np.int32)), pa.array((combo % 2).astype(np.int32)), pa.array(x[who]), *[one(c) for c in given]], schema=arrow)

    def all_near(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).sort_by("o")
        yield from (b for d in decks if (b := near(t, d)) is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= PART_ROWS:
                yield from all_near(held)
                held, size = [], 0
        if held:
            yield from all_near(held)

    got = donors.select(*SELF).mapInArrow(run, schema)
    side = F.when(F.col("side") == 0, -F.col("x")).otherwise(F.col("x"))
    got = got.withColumn("n", F.row_number().over(Window.partitionBy("ask", "kind", "side").orderBy(side, F.col("o")))).where(F.col("n") <= k)
    table = base.sparkSession.createDataFrame([(n, r["rank"], r["level"], *[r[c] for c in SELF]) for n, r in enumerate(asks)], T.StructType([T.StructField("n_", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("level", T.StringType()), *[T.StructField(f"{c}_", kinds[c]) for c in SELF]]))
    own = got.join(F.broadcast(table), F.col("ask") == F.col("n_"))
    return own.select(*[F.col(f"{c}_").alias(c) for c in SELF], "kind", "rank", F.struct("kind", "level", *given).alias("d"))


def _weighted(cand: Column, value) -> Column:
    """Lower weighted median of value(donor) over candidates with weight w."""
    arr = F.array_sort(F.transform(cand, lambda x: F.struct(value(x["d"]).alias("v"), x["w"].alias("w"))))
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x["w"])
    start = F.struct(F.lit(0.0).alias("a"), F.lit(None).cast("double").alias("r"))
    return F.aggregate(
        arr,
        start,
        lambda st, x: F.struct((st["a"] + x["w"]).alias("a"), F.when(st["r"].isNull() & (st["a"] + x["w"] >= total / 2 - 1e-12), x["v"]).otherwise(st["r"]).alias("r")),
    )["r"]


def _base(df: DataFrame, id_col: str, vessel_col: str, time_col: str, lat_col: str, lon_col: str, value_col: str, flag_col: str, value_range: tuple[float, float]) -> list[Column]:
    """The columns of SELF: id, hash of the vessel, time, and the usable fields."""
    lat, lon, val, flag = (C.quoted(x) for x in (lat_col, lon_col, value_col, flag_col))
    vessel = C.vessel_key(C.quoted(vessel_col))
    return [
        C.quoted(id_col).alias("o"),
        F.when(vessel.isNotNull(), F.xxhash64(vessel)).alias("v"),
        C.micros_of(df, time_col).alias("t"),
        F.when(C.usable_lat(lat, lon), lat.cast("double")).alias("la"),
        F.when(C.usable_lon(lat, lon), F.when(lon > 180, lon.cast("double") - 360).otherwise(lon.cast("double"))).alias("lo"),
        F.when(C.usable_value(val, flag, value_range), val.cast("double")).alias("s"),
        flag.cast("boolean").alias("f"),
    ]


def find_fills(
    df: DataFrame,
    id_col: str = "obs_id",
    vessel_col: str = "MMSI",
    time_col: str = "timestamp",
    lat_col: str = "lat",
    lon_col: str = "lon",
    value_col: str = "sst",
    flag_col: str = "sst_missing",
    value_range: tuple[float, float] = C.VALUE_RANGE,
    neighbours: int = 3,
    donors: int = 4,
) -> DataFrame:
    """For the rows of df that lack a field: the columns of SELF (o is the id), n_rows (rows of df equal in all these) and fill.

    fill.lat, fill.lon, fill.value, fill.flag hold the usable or filled values; fill.marks is an array with one
    struct(field, level, donors) for each field that was filled. level tells where the closest donor was found: `vessel`, `place`,
    `similar` (the band of a known field, or next to the row by a known field where it has no time), `global` (of all rows:
    next in time, or the latest ones if there is no time either); `none` means that the table has no usable value at all (it stays
    null). donors are the ids of the records copied from, the closest first.

    neighbours: the nearest donors in time on each side, in the block of the vessel and in that of the place; donors: how many
    of all these are used, the closest by a distance over hours, degrees, value and level.
    """
    base = df.select(*_base(df, id_col, vessel_col, time_col, lat_col, lon_col, value_col, flag_col, value_range))
    field_of = {"lat": lat_col, "lon": lon_col, "value": value_col, "flag": flag_col}
    has = {"p": F.col("la").isNotNull() & F.col("lo").isNotNull(), "s": F.col("s").isNotNull(), "f": F.col("f").isNotNull()}
    masks = {n: F.when(~has[n], F.lit(_bits(k))).otherwise(0) for k, n in enumerate(KINDS)}
    want = masks["p"] + masks["s"] + masks["f"]
    known = F.col("t").isNotNull()

    by_vessel = known & F.col("v").isNotNull()
    by_place = known & has["p"] & (has["s"] | has["f"] | (F.col("want") > 0))
    # what has neither goes through by itself, so that every row that lacks something comes out
    alone = (F.col("want") > 0) & ~by_vessel & ~by_place
    levels = ("vessel", "place", "none")
    n = F.col("n")
    rows = base.withColumn("want", want).select("*", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("n"))
    rows = rows.where(F.when(n == 0, by_vessel).when(n == 1, by_place).otherwise(alone))
    block = F.when(n == 0, _block("vessel", "t")).when(n == 1, _block("place", "t")).otherwise(F.xxhash64("o", "t", "la", "lo", "s", "f"))
    level = F.when(n == 0, levels[0]).when(n == 1, levels[1]).otherwise(levels[2])
    rows = rows.select(block.alias("block"), F.coalesce("t", F.lit(0).cast("bigint")).alias("x"), level.alias("level"), (n < 2).alias("give"), "want", *SELF)
    got = _matched(rows, neighbours, "candidates")
    nothing = F.array().cast(got.schema["c"].dataType)
    # rows equal in all columns have equal donors: one of them speaks for all
    found = [F.coalesce(F.max(F.when((F.col("level") == n) & (F.col("step") == k), F.col("c"))), nothing) for n in levels[:2] for k in (1, 2)]
    got = got.groupBy(*SELF).agg(F.concat(*found).alias("c"), F.greatest(*[F.count_if((F.col("level") == n) & (F.col("step") == 1)) for n in levels]).alias("n_rows"))
    of = lambda k: F.filter("c", lambda x: x["kind"] == k)
    missing = sum(((F.when(~has[n] & (F.size(of(k)) == 0), F.lit(_bits(k))).otherwise(0)) for k, n in enumerate(KINDS)), F.lit(0))
    stray = got.select(*SELF, missing.cast("int").alias("want")).where("want > 0")
    more = _strays(base, stray, neighbours)
    same = None
    for c in SELF:
        one = F.col(c).eqNullSafe(F.col(f"{c}_"))
        same = one if same is None else same & one
    if "kind" in more.schema["c"].dataType.simpleString():
        more = more.select(*[F.col(c).alias(f"{c}_") for c in SELF], F.col("c").alias("more"))
        got = got.join(more, same, "left").select(*SELF, "n_rows", F.concat("c", F.coalesce("more", nothing)).alias("c"))

    def far(d: Column) -> Column:
        hours = F.coalesce(F.abs(d["t"] - F.col("t")) / HOUR, F.lit(0.0))
        degrees = F.coalesce(F.abs(d["la"] - F.col("la")), F.lit(0.0)) + F.coalesce(F.abs(_wrap(d["lo"] - F.col("lo"))) * F.coalesce(F.col("wide"), F.cos(F.radians(d["la"]))), F.lit(0.0))
        level = F.lit(0.0)
        for n, z in LEVELS.items():
            level = F.when(d["level"] == n, z).otherwise(level)
        return hours / 6 + degrees * 2 + F.coalesce(F.abs(d["s"] - F.col("s")), F.lit(0.0)) + level

    got = got.withColumn("wide", F.cos(F.radians("la")))
    rated = F.transform("c", lambda x: F.struct(x["kind"].alias("kind"), x["o"].alias("o"), x["t"].alias("t"), far(x).alias("far"), x.alias("d")))
    got = got.withColumn("c", F.array_sort(rated))
    # a donor found twice counts once, by the nearer level; then the closest come first, ties in order of id
    again = lambda x, at: F.coalesce((F.get("c", at - 1)["kind"] == x["kind"]) & F.get("c", at - 1)["o"].eqNullSafe(x["o"]) & F.get("c", at - 1)["t"].eqNullSafe(x["t"]), F.lit(False))
    got = got.withColumn("c", F.filter("c", lambda x, at: (at == 0) | ~again(x, at)))
    got = got.withColumn("c", F.array_sort(F.transform("c", lambda x: F.struct(x["kind"].alias("kind"), x["far"].alias("far"), x["o"].alias("o"), x["d"].alias("d"), (1.0 / (1.0 + x["far"])).alias("w")))))
    todo = got.select(*SELF, "n_rows", *[F.slice(of(k), 1, donors).alias(f"c{n}") for k, n in enumerate(KINDS)])
    todo = todo.withColumn("ref", F.get("cp", F.lit(0))["d"]["lo"])
    yes = F.aggregate("cf", F.lit(0.0), lambda acc, x: acc + F.when(x["d"]["f"], x["w"]).otherwise(-x["w"]))
    new = {
        "lat": ("cp", F.col("la"), _weighted(F.col("cp"), lambda d: d["la"])),
        "lon": ("cp", F.col("lo"), _wrap(F.col("ref") + _weighted(F.col("cp"), lambda d: _wrap(d["lo"] - F.col("ref"))))),
        "value": ("cs", F.col("s"), _weighted(F.col("cs"), lambda d: d["s"])),
        "flag": ("cf", F.col("f"), F.when(F.size("cf") > 0, yes > 0)),
    }
    marks, values = [], {}
    for name, (cand, own, made) in new.items():
        values[name] = F.coalesce(own, made)
        level = F.coalesce(F.get(cand, F.lit(0))["d"]["level"], F.lit("none"))
        marks.append(F.when(own.isNull(), F.struct(F.lit(field_of[name]).alias("field"), level.alias("level"), F.transform(cand, lambda x: x["o"]).alias("donors"))))
    marks_col = F.filter(F.array(*marks), lambda x: x.isNotNull())
    return todo.select(*SELF, "n_rows", F.struct(*[v.alias(k) for k, v in values.items()], marks_col.alias("marks")).alias("fill"))


def fill_from_similar(
    df: DataFrame,
    id_col: str = "obs_id",
    vessel_col: str = "MMSI",
    time_col: str = "timestamp",
    lat_col: str = "lat",
    lon_col: str = "lon",
    value_col: str = "sst",
    flag_col: str = "sst_missing",
    value_range: tuple[float, float] = C.VALUE_RANGE,
    neighbours: int = 3,
    donors: int = 4,
) -> DataFrame:
    """Every input row, once, with all its columns and a struct column `fill`, as find_fills describes it.

    Usable: lat in -90..90, lon in -180..360 and not both 0; value within value_range and not flagged missing; flag not
    null. Null and NaN are not usable. Rows with a null time or blank vessel are filled from what else is known of them:
    without time, donors are those of the vessel, else of the place, else of all rows, next to the row by a known field.
    Repeated rows are filled each for itself, all alike, and may serve each other as donors; ties in time are ordered by id, tied
    weights of the flag give false. An empty table gives an empty result. A column named `fill` is kept; the new one is
    then `fill_`. Longitudes are compared modulo 360; fill.lon is in -180..180.

    Only the fields above go through the search; rows that lack something (and no others) are then joined with their fill.
    """
    args = (id_col, vessel_col, time_col, lat_col, lon_col, value_col, flag_col, value_range)
    fills = find_fills(df, *args, neighbours=neighbours, donors=donors)
    name = C.free_name(df.columns, "fill")
    row = df.select(F.struct(*[C.quoted(c) for c in df.columns]).alias("row"), *_base(df, *args))
    need = F.col("la").isNull() | F.col("lo").isNull() | F.col("s").isNull() | F.col("f").isNull()
    no_marks = F.array().cast(fills.schema["fill"].dataType["marks"].dataType)
    whole = row.where(~need).select("row.*", F.struct(F.col("la").alias("lat"), F.col("lo").alias("lon"), F.col("s").alias("value"), F.col("f").alias("flag"), no_marks.alias("marks")).alias(name))
    same = None
    for c in SELF:
        one = F.col(c).eqNullSafe(F.col(f"{c}_"))
        same = one if same is None else same & one
    fills = fills.select(*[F.col(c).alias(f"{c}_") for c in SELF], F.col("fill").alias("made"))
    done = row.where(need).join(fills, same).select("row.*", F.col("made").alias(name))
    return done.unionByName(whole)
