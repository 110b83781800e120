"""Points near points and points in regions, by grid cells, latitude strips and ray crossings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0


def placed(df: DataFrame, lat: str, lon: str) -> Column:
    """Whether the coordinates are a place: not null or NaN, not both 0, within ±90 and ±180."""
    la, lo = F.col(lat), F.col(lon)
    return la.isNotNull() & lo.isNotNull() & ~F.isnan(la) & ~F.isnan(lo) & ~((la == 0) & (lo == 0)) & (F.abs(la) <= 90) & (F.abs(lo) <= 180)


def sphere_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_M) -> Column:
    """Great-circle metres (haversine); null if a coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def near(points: DataFrame, key: str, lat: str, lon: str, metres: float) -> DataFrame:
    """(key_a, key_b, metres): pairs of different keys, key_a < key_b, at most ``metres`` apart on the sphere.

    Equal positions are folded first: cells join distinct positions only, and keys are attached to the pairs found.
    A latitude row is one distance high and has as many longitude cells as fit its narrowest parallel, so a position
    probes the few cells its distance touches, over the 180th meridian and at the poles too. Null keys and positions
    that are no place give no pairs; a key at several positions counts with each; repeated rows count once.
    """
    step = metres / RADIUS_M * 180 / math.pi * (1 + 1e-9)
    pos = points.where(placed(points, lat, lon) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(lat).alias("la"), F.col(lon).alias("lo")).distinct()
    spots = pos.select("la", "lo").distinct()
    row = F.floor((F.col("la") + 90) / step).cast("long")

    def cells(r: Column) -> Column:
        edge = F.greatest(F.abs(r * step - 90), F.abs((r + 1) * step - 90))
        return F.greatest(F.lit(1), F.floor(360 / step * F.cos(F.radians(F.least(F.lit(90.0), edge))))).cast("long")

    home = spots.withColumn("r", row).withColumn("c", F.pmod(F.floor((F.col("lo") + 180) / 360 * cells(F.col("r"))).cast("long"), cells(F.col("r"))))
    probe = spots.withColumn("r", F.explode(F.array(row - 1, row, row + 1))).withColumn("n", cells(F.col("r")))
    worst = F.least(F.lit(90.0), F.abs(F.col("la")) + step)
    reach = F.when(F.cos(F.radians(worst)) * 180 <= step, F.lit(180.0)).otherwise(F.least(F.lit(180.0), F.lit(step) / F.greatest(F.lit(1e-12), F.cos(F.radians(worst)))))
    at = lambda x: F.floor((x + 180) / 360 * F.col("n")).cast("long")
    # at most once round: near a pole the row has few cells and all of them are probed
    span = F.sequence(at(F.col("lo") - reach), F.least(at(F.col("lo") + reach), at(F.col("lo") - reach) + F.col("n") - 1))
    probe = probe.withColumn("c", F.explode(F.array_distinct(F.transform(span, lambda x: F.pmod(x, F.col("n"))))))
    a, b = home.alias("a"), probe.alias("b")
    met = a.join(b, (F.col("a.r") == F.col("b.r")) & (F.col("a.c") == F.col("b.c")) & ((F.col("a.la") < F.col("b.la")) | ((F.col("a.la") == F.col("b.la")) & (F.col("a.lo") <= F.col("b.lo")))))
    d = sphere_m(F.col("a.la"), F.col("a.lo"), F.col("b.la"), F.col("b.lo"))
    met = met.select(F.col("a.la").alias("la"), F.col("a.lo").alias("lo"), F.col("b.la").alias("la2"), F.col("b.lo").alias("lo2"), d.alias("metres")).where(F.col("metres") <= metres)
    left = pos.select(F.col("k").alias("ka"), "la", "lo")
    right = pos.select(F.col("k").alias("kb"), F.col("la").alias("la2"), F.col("lo").alias("lo2"))
    pairs = met.join(left, ["la", "lo"]).join(right, ["la2", "lo2"]).where(F.col("ka") != F.col("kb"))
    return pairs.groupBy(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).agg(F.min("metres").alias("metres"))


def holding(points: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region: str, ring_lat: str, ring_lon: str, strip: float = 0.01, tile: float = 0.05) -> DataFrame:
    """(key_a, key_b): points and the regions that hold them, by crossing parity in the plane of degrees.

    Edges are binned into latitude strips and the longitude tiles of their region's extent; a point meets the edges of
    its strip and tile, and its region holds it if an odd number of them crosses the ray from the point eastwards. An
    edge counts its lower end and not its upper, so a corner on the ray counts once and level edges never. A point
    exactly on an edge or corner is held. Rings may run either way and repeat the first corner or not; fewer than three
    corners, unequal lists, and null corners hold nothing. Null keys and points that are no place are left out.
    """
    ok = F.col(region).isNotNull() & (F.size(ring_lat) == F.size(ring_lon)) & (F.size(ring_lat) >= 3) & ~F.exists(ring_lat, lambda x: x.isNull()) & ~F.exists(ring_lon, lambda x: x.isNull())
    rings = regions.where(ok).select(F.col(region).alias("g"), F.col(ring_lat).alias("la"), F.col(ring_lon).alias("lo")).distinct().withColumn("ring", F.xxhash64("la", "lo"))
    edges = rings.select(
        "g", "ring", F.array_min("lo").alias("west"), F.array_max("lo").alias("east"),
        F.explode(F.transform("la", lambda y, i: F.struct(y.alias("y1"), F.get("lo", i).alias("x1"), F.get("la", (i + 1) % F.size("la")).alias("y2"), F.get("lo", (i + 1) % F.size("la")).alias("x2")))).alias("e"),
    ).select("g", "ring", "west", "east", "e.*")
    cell = lambda x, size: F.floor(x / size).cast("long")
    edges = edges.withColumn("s", F.explode(F.sequence(cell(F.least("y1", "y2"), strip), cell(F.greatest("y1", "y2"), strip)))).withColumn("t", F.explode(F.sequence(cell(F.col("west"), tile), cell(F.col("east"), tile))))
    pos = points.where(placed(points, lat, lon) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(lat).alias("py"), F.col(lon).alias("px")).distinct()
    spots = pos.select("py", "px").distinct().withColumn("s", cell(F.col("py"), strip)).withColumn("t", cell(F.col("px"), tile))
    met = spots.join(edges, ["s", "t"])
    y1, y2, x1, x2, py, px = (F.col(c) for c in ("y1", "y2", "x1", "x2", "py", "px"))
    side = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
    on = (side == 0) & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))
    crosses = ((y1 <= py) != (y2 <= py)) & (px < x1 + (py - y1) / (y2 - y1) * (x2 - x1))
    hit = met.where(on | crosses).groupBy("py", "px", "g", "ring").agg(F.max(on.cast("int")).alias("on"), F.sum(crosses.cast("int")).alias("n"))
    held = hit.where((F.col("on") == 1) | (F.col("n") % 2 == 1)).select("py", "px", F.col("g").alias("key_b")).distinct()
    return pos.join(held, ["py", "px"]).select(F.col("k").alias("key_a"), "key_b").distinct()
