"""Points in regions, and points near other points, by crossing parity.

A ray is sent from each point along its parallel of latitude; the point is inside a region if the ray crosses the
region's edges an odd number of times. Edges are binned into latitude strips, so that a point meets only edges of its
own strip. For pairs of near points, the region of a point is a box that holds the whole disc around it; the exact
great-circle distance is checked on what the parity lets through. Boundaries are decided explicitly: an edge counts for
its lower end only, points on an edge are told by on_edge, and boxes are drawn a little larger than their discs, so that
no point of a disc lies on its box.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import columns as C

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def crossing(py: Column, px: Column, y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    """1 if a ray eastward from (px, py) crosses the edge, else 0.

    An edge counts for its lower end but not for its upper one, so a ray through a shared vertex is counted once, and
    horizontal edges never count.
    """
    spans = (y1 <= py) != (y2 <= py)
    at = x1 + (py - y1) / F.when(y2 == y1, F.lit(None)).otherwise(y2 - y1) * (x2 - x1)
    return F.when(spans & (at > px), 1).otherwise(0)


def on_edge(py: Column, px: Column, y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    """Whether the point lies on the edge, ends included."""
    side = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    return (side == 0) & py.between(F.least(y1, y2), F.greatest(y1, y2)) & px.between(F.least(x1, x2), F.greatest(x1, x2))


#: Edges of regions are sent to every task up to this number (about 100 bytes each); beyond it points and edges are shuffled.
FEW_EDGES = 200_000


def _binned_edges(edges: DataFrame, region_id: str, strip: float, cell: float) -> DataFrame:
    """(r, e, lat1, lon1, lat2, lon2, strip, cell): every edge in each latitude strip it touches and each longitude cell from
    which a ray can meet it: from its region's west end to its own east end. Regions that run across the date line are
    repeated a whole turn away, so that points between -180 and 180 meet them."""
    e = edges.select(C.quoted(region_id).alias("r"), *[C.quoted(c).cast("double").alias(c) for c in ("lat1", "lon1", "lat2", "lon2")])
    e = e.where("r is not null and lat1 is not null and lon1 is not null and lat2 is not null and lon2 is not null and not isnan(lat1) and not isnan(lon1) and not isnan(lat2) and not isnan(lon2)")
    e = e.distinct().withColumn("e", F.xxhash64("lat1", "lon1", "lat2", "lon2"))
    ends = e.groupBy(F.col("r").alias("er")).agg(F.min(F.least("lon1", "lon2")).alias("west"), F.max(F.greatest("lon1", "lon2")).alias("east"))
    # turns that bring some of the region between -180 and 180
    turns = F.sequence(F.ceil((F.lit(-180.0) - F.col("east")) / 360), F.floor((F.lit(180.0) - F.col("west")) / 360))
    ends = ends.select("er", "west", F.explode(turns).alias("turn"))
    e = e.join(ends, F.col("r") == F.col("er")).withColumns({c: F.col(c) + F.col("turn") * 360 for c in ("lon1", "lon2", "west")})
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    e = e.withColumn("strip", F.explode(F.sequence(F.floor(low / strip), F.floor(high / strip))))
    # an edge wholly west of -180 is met by no ray
    first = F.floor(F.greatest("west", F.lit(-180.0)) / cell)
    last = F.floor(F.least(F.greatest("lon1", "lon2"), F.lit(180.0)) / cell)
    e = e.where(F.greatest("lon1", "lon2") >= -180).withColumn("cell", F.explode(F.sequence(first, last)))
    return e.drop("er", "west", "turn")


def containing_regions(points: DataFrame, edges: DataFrame, point_id: str, region_id: str = "region_id", lat: str = "lat", lon: str = "lon", strip: float = 0.5, boundary: bool = True, cell: float = 5.0, few_edges: int = FEW_EDGES) -> DataFrame:
    """(point_id, region_id), once for each point and region that contains it.

    edges: region_id, lat1, lon1, lat2, lon2, one row per edge of the region's closed rings, in any order; holes are
    further rings. Longitudes of a region run on across the date line (179 -> 181), so edges are never cut there; points
    may have any longitude. Points on an edge or vertex belong to the region if boundary is true,
    else they don't. Points with null or NaN position, edges with a null end, and null ids take no part; repeated points
    (same id and place) and repeated edges count once. Empty inputs give an empty result. Extra columns are ignored.

    Edges are binned by latitude strip and longitude cell. They are sent to all tasks if, counted, they are no more than
    few_edges rows (points are then not shuffled); else points and edges meet by a shuffle join on their bin, of which AQE
    splits the hot ones. Rays that meet an edge are grouped by point and region, pre-aggregated before the shuffle.
    """
    x = C.quoted(lon).cast("double")
    p = points.select(C.quoted(point_id).alias("p"), C.quoted(lat).cast("double").alias("py"), F.when(x >= 180, x - 360 * F.floor((x + 180) / 360)).when(x < -180, x - 360 * F.floor((x + 180) / 360)).otherwise(x).alias("px"))
    p = p.where("p is not null and not isnan(py) and not isnan(px)")
    p = p.withColumns({"ps": F.floor(F.col("py") / strip), "pc": F.floor(F.col("px") / cell)})
    e = _binned_edges(edges, region_id, strip, cell)
    if e.limit(few_edges + 1).count() <= few_edges:
        e = F.broadcast(e)
    args = [F.col(c) for c in ("py", "px", "lat1", "lon1", "lat2", "lon2")]
    # an edge wholly west of the point is neither crossed nor touched
    met = p.join(e, (F.col("ps") == F.col("strip")) & (F.col("pc") == F.col("cell")) & (F.greatest("lon1", "lon2") >= F.col("px")))
    met = met.withColumns({"n": crossing(*args), "touch": on_edge(*args).cast("int")}).where("n = 1 or touch = 1")
    # a repeated point meets an edge again: edges are counted once each
    once = met.groupBy("p", "py", "px", "r", "e").agg(F.max("n").alias("n"), F.max("touch").alias("touch"))
    rays = once.groupBy("p", "py", "px", "r").agg(F.sum("n").alias("n"), F.max("touch").alias("touch"))
    inside = F.col("n") % 2 == 1
    ok = (inside | (F.col("touch") == 1)) if boundary else (inside & (F.col("touch") == 0))
    return rays.where(ok).select(F.col("p").alias(point_id), F.col("r").alias(region_id)).distinct()


def pairs_within(
    df: DataFrame,
    id_col: str = "obs_id",
    vessel_col: str = "MMSI",
    time_col: str = "timestamp",
    lat_col: str = "lat",
    lon_col: str = "lon",
    km: float = 1.0,
    minutes: float = 10.0,
    strip: float = 0.1,
    bin_minutes: int = 60,
) -> DataFrame:
    """(obs_a, obs_b, km, seconds): pairs of rows of different vessels, both limits included, obs_a < obs_b.

    Positions are as given, longitudes modulo 360; vessels are compared by columns.vessel_key. Rows with a null time,
    null or blank vessel, or unusable position (columns.usable_lat, usable_lon) take no part. Rows with equal ids are no
    pair; a row repeated with equal id, time and place pairs once. Across the date line and around the poles pairs are
    found like elsewhere. An empty table gives an empty result; extra columns are ignored.

    Each row goes once, as a point, into its own (time bin, latitude strip, longitude cell), and, as a region, into
    every bin its box reaches: the later of two rows is looked for in the box of the earlier one, over the next
    `minutes`. The two edges of a box that a ray can cross lie on meridians and span the same strips, so they travel as
    one row (centre and half width) and part after the join. Crossings are grouped by point and region; a point is in the
    box if their number is odd. The grouping has its own shuffle, so AQE's skew join can split a hot bin; nothing is
    salted beforehand. Boxes touch one or two strips, cells and bins (1.4 copies on average).
    """
    half = math.degrees(km / EARTH_KM) * (1 + 1e-6) + 1e-9  # a little more than the disc: nothing lies on the box itself
    span, width = int(minutes * 60e6), int(bin_minutes * 60e6)
    lat, lon = C.quoted(lat_col), C.quoted(lon_col)
    base = df.where(C.usable_lat(lat, lon) & C.usable_lon(lat, lon) & C.quoted(time_col).isNotNull()).select(
        C.quoted(id_col).alias("id"),
        F.xxhash64(C.vessel_key(C.quoted(vessel_col))).alias("v"),
        C.vessel_key(C.quoted(vessel_col)).isNotNull().alias("known"),
        C.micros_of(df, time_col).alias("t"),
        lat.cast("double").alias("y"),
        F.pmod(lon.cast("double"), F.lit(360.0)).alias("x"),
    )
    base = base.where("known and id is not null").drop("known")

    def strip_of(y: Column) -> Column:
        return F.floor((y + 90) / strip).cast("int")

    def cells(s: Column) -> Column:
        """Longitude cells of a strip: as wide as the strip is high, seen at its end nearer to a pole."""
        top = F.greatest(F.abs(s * strip - 90), F.abs((s + 1) * strip - 90))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(top, F.lit(90.0)))) / strip).cast("int"))

    points = base.withColumn("s", strip_of(F.col("y"))).withColumn("c", (F.floor(F.col("x") / 360 * cells(F.col("s"))) % cells(F.col("s"))).cast("int")).withColumn("b", F.floor(F.col("t") / width))
    # half the box's width in degrees; all around where the disc holds a pole
    reach = F.when(F.abs("y") + half >= 90, 180.0).otherwise(F.degrees(F.asin(F.sin(F.lit(math.radians(half))) / F.cos(F.radians("y")))) * (1 + 1e-6) + 1e-9)
    r = base.select(F.col("id").alias("rid"), F.col("v").alias("rv"), F.col("t").alias("rt"), F.col("y").alias("ry"), F.col("x").alias("rx"), reach.alias("w"))
    r = r.withColumn("b", F.explode(F.sequence(F.floor(F.col("rt") / width), F.floor((F.col("rt") + span) / width))))
    r = r.withColumn("s", F.explode(F.sequence(strip_of(F.greatest(F.col("ry") - half, F.lit(-90.0))), strip_of(F.least(F.col("ry") + half, F.lit(90.0))))))
    n = cells(F.col("s"))
    west, east = F.floor((F.col("rx") - F.col("w")) / 360 * n), F.floor((F.col("rx") + F.col("w")) / 360 * n)
    r = r.withColumn("c", F.explode(F.when(east - west + 1 >= n, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.transform(F.sequence(west, east), lambda k: F.pmod(k, n.cast("bigint")))))).withColumn("c", F.col("c").cast("int"))
    met = points.join(
        r,
        (points["s"] == r["s"])
        & (points["c"] == r["c"])
        & (points["b"] == r["b"])
        & (F.col("v") != F.col("rv"))
        & (F.col("id") != F.col("rid"))
        & ((F.col("t") > F.col("rt")) | ((F.col("t") == F.col("rt")) & (F.col("id") > F.col("rid"))))
        & (F.col("t") - F.col("rt") <= span),
    ).drop(r["s"], r["c"], r["b"])
    # seen from the box's centre; a disc that holds a pole reaches all around, and its box from -180 to 180
    off = F.pmod(F.col("x") - F.col("rx") + 180, F.lit(360.0)) - 180
    edge = F.explode(F.array(-F.col("w"), F.col("w")))
    met = met.select("id", "rid", "t", "rt", "y", "x", "ry", "rx", off.alias("off"), edge.alias("side"))
    rays = crossing(F.col("y"), F.col("off"), F.col("ry") - half, F.col("side"), F.col("ry") + half, F.col("side"))
    # a repeated row crosses the same edge again, so each of the two edges counts once
    place = ["id", "rid", "t", "rt", "y", "x", "ry", "rx"]
    sides = [F.max(F.when(F.col("side") < 0, F.col("ray"))).alias("west"), F.max(F.when(F.col("side") >= 0, F.col("ray"))).alias("east")]
    crossed = met.withColumn("ray", rays).where("ray = 1").groupBy(*place).agg(*sides)
    inside = (F.coalesce("west", F.lit(0)) + F.coalesce("east", F.lit(0))) % 2 == 1
    far = haversine_km(F.col("ry"), F.col("rx"), F.col("y"), F.col("x"))
    near = crossed.where(inside).withColumn("km", far).where(F.col("km") <= km)
    return near.select(F.least("id", "rid").alias("obs_a"), F.greatest("id", "rid").alias("obs_b"), "km", ((F.col("t") - F.col("rt")) / 1e6).alias("seconds")).distinct()
