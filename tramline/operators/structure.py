"""Nested timetable documents to feed tables, reshaping, fares and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spatial import sphere_m


def documents(visits: DataFrame, block: Column) -> DataFrame:
    """Visits as extract documents: block, trips: array of (ord, trip_id, cells: array of (seq, name, time))."""
    cell = F.struct("seq", "name", F.col("a").alias("time"))
    t = visits.groupBy(block.alias("block"), "trip_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    t = t.withColumn("ord", F.row_number().over(W.partitionBy("block").orderBy("trip_id")))
    return t.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("ord", "trip_id", "cells"))).alias("trips"))


def cells(docs: DataFrame) -> DataFrame:
    """Documents exploded: block, ord, trip_id, pos, name, time."""
    t = docs.select("block", F.explode("trips").alias("t"))
    return t.select("block", "t.ord", "t.trip_id", F.posexplode("t.cells").alias("pos", "c")).select("block", "ord", "trip_id", "pos", "c.name", "c.time")


def registry(cell_rows: DataFrame, group: Column, key: str = "name") -> DataFrame:
    """Stops of each group by name: where each was first seen, and a dense id by name."""
    g = cell_rows.groupBy(group.alias("grp"), key).agg(F.min_by("block", F.struct("block", "ord", "pos")).alias("first_block"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("new_id", F.format_string("S%03d", F.row_number().over(W.partitionBy("grp").orderBy(key))))


def service_of(trips: DataFrame, per_trip: DataFrame, per_block: DataFrame, default: str) -> DataFrame:
    """Service by trip, else by block, else the default: (trip_id, service_id, origin)."""
    j = trips.join(per_trip.select("trip_id", F.col("service_id").alias("s1")), "trip_id", "left").join(per_block.select("block", F.col("service_id").alias("s2")), "block", "left")
    return j.select("trip_id", F.coalesce("s1", "s2", F.lit(default)).alias("service_id"), F.when(F.col("s1").isNotNull(), "trip").when(F.col("s2").isNotNull(), "block").otherwise("default").alias("origin"))


def chains(links: DataFrame) -> DataFrame:
    """(trip_id, block_id): vehicle chains, one array of trips a row, numbered B%03d in the order of their first trip."""
    n = links.select("trips", F.row_number().over(W.partitionBy("grp").orderBy(F.get("trips", F.lit(0)))).alias("i"), "grp")
    return n.select("grp", F.explode("trips").alias("trip_id"), F.format_string("B%03d", "i").alias("block_id"))


def boarding_type(explicit: Column, name: Column, marker: str) -> Column:
    """Explicit value, else 2 where the name holds the marker, else 0."""
    return F.coalesce(explicit, F.when(name.contains(marker), 2).otherwise(0))


def board_codes(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Pick-up and drop-off codes by rules whose null keys stand for anything; 1 where a rule of the kind names the stop."""
    hit = rows.join(F.broadcast(rules), (F.col("r_route").isNull() | (F.col("r_route") == F.col("route"))) & (F.col("r_dir").isNull() | (F.col("r_dir") == F.col("direction"))) & F.array_contains("r_stops", F.col("name")), "left")
    keys = rows.columns
    return hit.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("r_kind") == "pickup", 1)), F.lit(0)).alias("pickup"), F.coalesce(F.max(F.when(F.col("r_kind") == "dropoff", 1)), F.lit(0)).alias("dropoff"))


def square_fares(grid: DataFrame, known: DataFrame) -> DataFrame:
    """(sheet, from_name, to_name, price) of square fare grids (sheet, row, col, value): the header row and column are those with most known names.

    Price is the first run of 2 to 4 digits; 0 and equal ends are left out, and the first of repeated pairs counts.
    """
    names = grid.join(known.select(F.col("name").alias("value")), "value", "left_semi")
    top = lambda c: names.groupBy("sheet", c).agg(F.count(F.lit(1)).alias("n")).groupBy("sheet").agg(F.max_by(c, F.struct("n", -F.col(c))).alias(c))
    to = names.join(top("row"), ["sheet", "row"]).select("sheet", "col", F.col("value").alias("to_name"))
    of = names.join(top("col"), ["sheet", "col"]).select("sheet", "row", F.col("value").alias("from_name"))
    return _pairs(grid.join(to, ["sheet", "col"]).join(of, ["sheet", "row"]))


def triangular_fares(grid: DataFrame, known: DataFrame) -> DataFrame:
    """(sheet, from_name, to_name, price) of triangular fare grids, whose stop names stand on the diagonal."""
    names = grid.join(known.select(F.col("name").alias("value")), "value", "left_semi")
    of = names.groupBy("sheet", "row").agg(F.min_by("value", "col").alias("from_name"))
    to = names.groupBy("sheet", "col").agg(F.min_by("value", "row").alias("to_name"))
    return _pairs(grid.join(of, ["sheet", "row"]).join(to, ["sheet", "col"]))


def _pairs(j: DataFrame) -> DataFrame:
    price = F.nullif(F.regexp_extract("value", "([0-9]{2,4})", 1), F.lit("")).cast("int")
    p = j.withColumn("price", price).where("price > 0 and from_name <> to_name")
    return p.groupBy("sheet", "from_name", "to_name").agg(F.min_by("price", F.struct("row", "col")).alias("price"))


def matrix_kind(grid: DataFrame, known: DataFrame) -> DataFrame:
    """(sheet, kind, category): square where some row and some column hold two known names, else triangular; category by words."""
    names = grid.join(known.select(F.col("name").alias("value")), "value", "left_semi")
    most = lambda c: names.groupBy("sheet", c).agg(F.count(F.lit(1)).alias("n")).groupBy("sheet").agg(F.max("n").alias(f"most_{c}"))
    words = grid.groupBy("sheet").agg(F.max(F.when(F.col("value").rlike("小児|child"), 3).when(F.col("value").rlike("障|disabled"), 2).otherwise(1)).alias("w"))
    j = words.join(most("row"), "sheet", "left").join(most("col"), "sheet", "left")
    return j.select("sheet", F.when((F.col("most_row") >= 2) & (F.col("most_col") >= 2), "square").otherwise("triangular").alias("kind"), F.element_at(F.array(F.lit("adult"), F.lit("disabled"), F.lit("child")), F.col("w")).alias("category"))


def zone_fares(pairs: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fare attributes (one a price, Z<price>) and rules (fare_id, origin_id, destination_id); names without a stop are dropped."""
    of = stops.select(F.col("name").alias("from_name"), F.col("stop_id").alias("origin_id"))
    to = stops.select(F.col("name").alias("to_name"), F.col("stop_id").alias("destination_id"))
    rules = pairs.join(of, "from_name").join(to, "to_name").select(F.concat(F.lit("Z"), F.col("price").cast("string")).alias("fare_id"), "origin_id", "destination_id", "price")
    return rules.select("fare_id", "price").distinct(), rules.drop("price")


def symmetric(pairs: DataFrame) -> DataFrame:
    """Pairs with their reverse added where it is not there."""
    swap = pairs.select(F.col("to_name").alias("from_name"), F.col("from_name").alias("to_name"), "price")
    own = pairs.select("from_name", "to_name", "price")
    return own.unionAll(swap.join(own, ["from_name", "to_name"], "left_anti"))


def shapes(patterns: DataFrame) -> DataFrame:
    """(shape_id, seq, lat, lon, dist) by straight lines along each distinct pattern: patterns has shape_id and points, an array of (lat, lon)."""
    p = patterns.select("shape_id", F.posexplode(F.filter("points", lambda x: x["lat"].isNotNull())).alias("seq", "p")).select("shape_id", "seq", "p.lat", "p.lon")
    w = W.partitionBy("shape_id").orderBy("seq")
    step = F.coalesce(sphere_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    return p.withColumn("step", step).withColumn("dist", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("step")


def moved(items: Column, item: Column, to: int) -> Column:
    """An array with one element moved to a position (from 0); unchanged if it is not there."""
    rest = F.filter(items, lambda x: x != item)
    put = F.concat(F.slice(rest, 1, to), F.array(item), F.slice(rest, F.lit(to + 1), F.greatest(F.size(rest) - to, F.lit(0))))
    return F.when(F.array_contains(items, item), put).otherwise(items)


def spliced(line: Column, lo: int, hi: int, piece: Column) -> Column:
    """An array with elements lo to hi (from 0) replaced by another array."""
    return F.concat(F.slice(line, 1, lo), piece, F.slice(line, F.lit(hi + 2), F.greatest(F.size(line) - (hi + 1), F.lit(0))))


def merged_map(base: Column, new: Column, owned: list[str]) -> Column:
    """A map whose owned keys come from ``new`` and the others from ``base``."""
    mine = F.map_filter(new, lambda k, _: k.isin(owned))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(mine, k)), mine)
