"""Operators on ordered sequences (trips of visits): pairs, gaps, interpolation, roll-over, outliers.

All work on one partition key and order, so that chained ones share a shuffle and a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo


def _w(key: str | list[str], order: str | list[str]):
    keys, orders = ([x] if isinstance(x, str) else x for x in (key, order))
    return W.partitionBy(*keys).orderBy(*orders)


def known(c: str, w, ahead: bool = False) -> Column:
    """The nearest value before (or ahead) that is not null."""
    return F.first(c, True).over(w.rowsBetween(1, W.unboundedFollowing)) if ahead else F.last(c, True).over(w.rowsBetween(W.unboundedPreceding, -1))


def segments(df: DataFrame, key: str = "trip_id", order: str = "seq") -> DataFrame:
    """Adjacent rows paired: from_*, to_* names and positions, metres (null if a position is missing) and secs from departure to arrival."""
    w = _w(key, order)
    nxt = lambda c: F.lead(c).over(w)
    out = df.select(key, order, F.col("name").alias("from_name"), nxt("name").alias("to_name"), F.col("stop_id").alias("from_id"), nxt("stop_id").alias("to_id"), "lat", "lon", nxt("lat").alias("lat2"), nxt("lon").alias("lon2"), (nxt("arr") - F.col("dep")).alias("secs"))
    return out.where("to_name is not null").withColumn("metres", geo.sphere_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))


def speed_verdict(metres: Column, secs: Column, fast: float = 60.0, slow: float = 2.0, far_km: float = 0.5) -> Column:
    """missing, zero_time, too_fast, too_slow, or empty."""
    kmh = geo.speed(metres, secs)
    return (
        F.when(metres.isNull() | secs.isNull(), "missing").when(secs <= 0, F.when(metres > far_km * 1000, "zero_time").otherwise(""))
        .when(kmh > fast, "too_fast").when((kmh < slow) & (metres > far_km * 1000), "too_slow").otherwise("")
    )


def cumulative(df: DataFrame, key: str = "trip_id", order: str = "seq", lat: str = "lat", lon: str = "lon", out: str = "dist") -> DataFrame:
    """Running distance along a sequence; the first row has 0."""
    w = _w(key, order)
    step = geo.sphere_m(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
    return df.withColumn(out, F.coalesce(step, F.lit(0.0))).withColumn(out, F.sum(out).over(w.rowsBetween(W.unboundedPreceding, 0)))


def collapse(df: DataFrame, key: str, order: str, values: list[str], out: str = "pos") -> DataFrame:
    """Rows that differ from the row before in ``values``, numbered anew from 0."""
    w = _w(key, order)
    same = F.lit(True)
    for v in values:
        same = same & F.lag(v).over(w).eqNullSafe(F.col(v))
    first = F.lag(F.lit(1)).over(w).isNull()
    kept = df.withColumn("__keep", first | ~same).where("__keep").drop("__keep")
    return kept.withColumn(out, F.row_number().over(w) - 1)


def roll_over(df: DataFrame, key: str = "trip_id", order: str = "seq", minute: str = "m", window: int = 180, out: str = "rolled") -> DataFrame:
    """Minutes with 24 hours added from each step back on whose gap over midnight is at most ``window``; unknown minutes stay null and are stepped over."""
    w = _w(key, order)
    t, p = F.col(minute), known(minute, w)
    jump = F.coalesce(((t < p) & (t + 1440 - p <= window)).cast("int"), F.lit(0))
    return df.withColumn("__jump", jump).withColumn(out, t + 1440 * F.sum("__jump").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__jump")


def roll_over_adjusted(times: Column, window: int = 180) -> Column:
    """The roll-over that compares with the adjusted time before, over an array of minutes."""
    before = lambda acc: F.try_element_at(F.filter(acc, lambda x: x.isNotNull()), F.lit(-1))
    step = lambda acc, t: F.concat(acc, F.array(F.when((t < before(acc)) & (t + 1440 - before(acc) <= window), t + 1440).otherwise(t)))
    return F.aggregate(times, F.slice(times, 1, 0), step)


def islands(df: DataFrame, key: str, order: str, value: str, gap: float, out: str = "island") -> DataFrame:
    """1-D clusters: a new one starts where ``value`` is more than ``gap`` beyond the row before."""
    w = _w(key, [value, order])
    return df.withColumn("__new", F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))).withColumn(out, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def monotonic(df: DataFrame, key: str = "trip_id", order: str = "seq", value: str = "arr") -> DataFrame:
    """Per sequence: whether values never fall, and the largest fall (null if there is no pair)."""
    w = _w(key, order)
    step = df.withColumn("__fall", known(value, w) - F.col(value))
    return step.groupBy(key).agg(F.coalesce(F.max("__fall") <= 0, F.lit(True)).alias("monotonic"), F.max("__fall").alias("largest_fall"))


def interpolate(df: DataFrame, key: str = "trip_id", order: str = "seq", lat: str = "lat", lon: str = "lon", anchor: Column | None = None) -> DataFrame:
    """``df`` with ilat, ilon, gap: positions of rows without one, by row index between the nearest known neighbours."""
    w = _w(key, order)
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull() & (F.lit(True) if anchor is None else anchor)
    k = df.withColumn("__k", F.row_number().over(w)).withColumn("__p", F.when(known, F.struct("__k", F.col(lat).alias("la"), F.col(lon).alias("lo"))))
    k = k.withColumn("__a", F.last("__p", True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("__b", F.first("__p", True).over(w.rowsBetween(1, W.unboundedFollowing)))
    f = (F.col("__k") - F.col("__a.__k")) / (F.col("__b.__k") - F.col("__a.__k"))
    need = ~known
    mix = lambda c: F.when(need, F.col(f"__a.{c}") + (F.col(f"__b.{c}") - F.col(f"__a.{c}")) * f)
    return k.withColumn("ilat", mix("la")).withColumn("ilon", mix("lo")).withColumn("gap", F.when(need, F.col("__b.__k") - F.col("__a.__k"))).drop("__k", "__p", "__a", "__b")


def interpolated_stops(df: DataFrame, stop: str = "stop_id", **kw) -> DataFrame:
    """Stops without a position with the medians of their visits' interpolations, latitude and longitude apart."""
    i = interpolate(df, **kw).where("ilat is not null")
    return i.groupBy(stop).agg(F.median("ilat").alias("lat"), F.median("ilon").alias("lon"), F.count(F.lit(1)).alias("n_visits"))


def off_route(df: DataFrame, key: str = "trip_id", order: str = "seq", stop: str = "stop_id") -> DataFrame:
    """(stop, metres): least distance, over all visits, of a stop from the segment between the nearest located visits of other stops.

    In a trip a stop may come twice in a row; the neighbours skip all rows of the stop itself. First and last visits give no distance.
    """
    located = df.where("lat is not null and lon is not null")
    p = F.struct(F.col(order).alias("o"), F.col(stop).alias("id"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    w = _w(key, order)
    # the row before, or, where that is the stop itself, the latest row before that of another stop
    run = located.withColumn("__p", p).withColumn("__new", F.coalesce((F.lag(stop).over(w) != F.col(stop)).cast("int"), F.lit(1))).withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    edge = run.groupBy(key, "__run").agg(F.min_by("__p", order).alias("first"), F.max_by("__p", order).alias("last"))
    e = W.partitionBy(key).orderBy("__run")
    edge = edge.withColumn("prev", F.lag("last").over(e)).withColumn("next", F.lead("first").over(e)).where("prev is not null and next is not null")
    v = run.join(edge.select(key, "__run", "prev", "next"), [key, "__run"])
    xy = lambda a, o: geo.planar(F.col(a), F.col(o), F.col("prev.la"), F.col("prev.lo"))
    (px, py), (bx, by) = xy("lat", "lon"), xy("next.la", "next.lo")
    return v.select(stop, geo.segment(px, py, F.lit(0.0), F.lit(0.0), bx, by).alias("metres")).groupBy(stop).agg(F.min("metres").alias("metres"))


def headings(df: DataFrame, key: str = "trip_id", order: str = "seq", stop: str = "stop_id") -> DataFrame:
    """(stop, east, north): sum of unit vectors from the visit before to the visit after; ends stand for themselves."""
    w = _w(key, order)
    located = df.where("lat is not null and lon is not null")
    f = lambda fn, c: F.coalesce(fn(c).over(w), F.col(c))
    h = located.select(stop, *[f(F.lag, c).alias(f"a{c}") for c in ("lat", "lon")], *[f(F.lead, c).alias(f"b{c}") for c in ("lat", "lon")])
    east = (F.col("blon") - F.col("alon")) * F.cos(F.radians((F.col("alat") + F.col("blat")) / 2))
    h = h.select(stop, east.alias("e"), (F.col("blat") - F.col("alat")).alias("n")).withColumn("l", F.hypot("e", "n"))
    return h.where("l > 0").groupBy(stop).agg(F.sum(F.col("e") / F.col("l")).alias("east"), F.sum(F.col("n") / F.col("l")).alias("north"))


def anomalies(df: DataFrame, group: str, trip: str, order: str, name: str, minute: str, threshold: float = 5.0, agree: float = 3.0, least: int = 2) -> DataFrame:
    """Cells whose time does not fit: (group, trip, order, name, minute, backward, level, suggestion).

    A cell is expected the pair's median interval after the cell before and before the cell after; medians need
    ``least`` samples. Two expectations within ``agree`` minutes and a deviation of ``threshold`` or a step back give
    level high with a suggestion; other steps back give low.
    """
    w = _w([group, trip], order)
    c = df.select(group, trip, order, name, minute).withColumn("pn", F.lag(name).over(w)).withColumn("pm", F.lag(minute).over(w)).withColumn("nn", F.lead(name).over(w)).withColumn("nm", F.lead(minute).over(w))
    pair = c.where("pn is not null").groupBy(group, F.col("pn").alias("x"), F.col(name).alias("y")).agg(F.median(F.col(minute) - F.col("pm")).alias("med"), F.count(F.col(minute) - F.col("pm")).alias("n")).where(F.col("n") >= least).drop("n")
    before = pair.select(group, F.col("x").alias("pn"), F.col("y").alias(name), F.col("med").alias("mb"))
    after = pair.select(group, F.col("x").alias(name), F.col("y").alias("nn"), F.col("med").alias("ma"))
    c = c.join(before, [group, "pn", name], "left").join(after, [group, name, "nn"], "left")
    e1, e2, t = F.col("pm") + F.col("mb"), F.col("nm") - F.col("ma"), F.col(minute)
    back = F.coalesce(t < F.col("pm"), F.lit(False)) | F.coalesce(t > F.col("nm"), F.lit(False))
    ok = F.coalesce(F.abs(e1 - e2) <= agree, F.lit(False))
    mid = (e1 + e2) / 2
    high = ok & ((F.abs(t - mid) >= threshold) | back)
    level = F.when(high, "high").when(back, "low")
    return c.select(group, trip, order, name, minute, back.alias("backward"), level.alias("level"), F.when(ok, mid).alias("suggestion")).where("level is not null")


def chain_conflicts(df: DataFrame, chain: str, start: str, end: str, origin: str, terminal: str, ident: str, order: str | None = None) -> DataFrame:
    """Neighbours in a vehicle's chain: error where the next departs before this arrives, warning where the places differ; in the order of ``order``, or else of the starts."""
    w = _w(chain, [order or start, ident])
    n = df.withColumn("next_id", F.lead(ident).over(w)).withColumn("ns", F.lead(start).over(w)).withColumn("no", F.lead(origin).over(w)).where("next_id is not null")
    verdict = F.when(F.col("ns") < F.col(end), "overlap").when(F.col("no") != F.col(terminal), "moved")
    return n.select(chain, F.col(ident).alias("this_id"), "next_id", verdict.alias("verdict")).where("verdict is not null")


def link_candidates(trips: DataFrame, ident: str, origin: str, terminal: str, dep: str, arr: str, gap: int, near: int = 0) -> DataFrame:
    """(a, b): b starts where a ends, at most ``gap`` later (a band join on the place and on time buckets one gap wide)."""
    a = trips.select(F.col(ident).alias("a"), F.col(terminal).alias("place"), F.col(arr).alias("t")).withColumn("bucket", F.explode(F.array(F.floor(F.col("t") / gap), F.floor(F.col("t") / gap) + 1)))
    b = trips.select(F.col(ident).alias("b"), F.col(origin).alias("place"), F.col(dep).alias("u")).withColumn("bucket", F.floor(F.col("u") / gap))
    return a.join(b, ["place", "bucket"]).where((F.col("u") - F.col("t")).between(near, gap) & (F.col("a") != F.col("b"))).select("a", "b", "place", (F.col("u") - F.col("t")).alias("wait"))


def first_last(df: DataFrame, key: str = "trip_id", order: str = "seq") -> DataFrame:
    """One row a sequence: first and last stop and time (null where that is unknown), earliest known departure, number of rows, and whether it is a loop."""
    f = df.groupBy(key).agg(F.min_by("stop_id", order).alias("origin"), F.max_by("stop_id", order).alias("terminal"), F.min_by("dep", order).alias("start"), F.max_by("arr", order).alias("end"), F.min("dep").alias("first_dep"), F.count(F.lit(1)).alias("n"))
    return f.withColumn("loop", (F.col("origin") == F.col("terminal")) & (F.col("n") > 1))
