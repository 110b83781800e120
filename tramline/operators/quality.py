"""Confidence, coverage and gates: what is certain, and what goes to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo

SURE, REVIEW, EMPTY = "sure", "review", "empty"


def confidence(located: Column, source: Column, off_route_m: Column, agreeing: Column, estimated: Column, ambiguous: Column, near: float = 500.0) -> Column:
    """sure, review or empty for a coordinate.

    Official and manual sources are sure; an exact name is sure if it is not far off its route and not ambiguous; two
    independent sources that agree make others sure; an estimate always goes to review unless it is manual.
    """
    by_route = off_route_m.isNull() | (off_route_m <= near)
    base = F.when(source.isin("official", "manual"), SURE).when((source == "exact") & by_route & ~F.coalesce(ambiguous, F.lit(False)), SURE).when(by_route & (agreeing >= 2), SURE).otherwise(REVIEW)
    return F.when(~located, EMPTY).when(F.coalesce(estimated, F.lit(False)) & (source != "manual"), REVIEW).otherwise(base)


def agreeing_sources(final: DataFrame, evidence: DataFrame, radius: float = 100.0) -> DataFrame:
    """(stop_id, agreeing): how many kinds of evidence lie within ``radius`` of the final position."""
    e = evidence.select("stop_id", "kind", F.col("lat").alias("la"), F.col("lon").alias("lo"))
    d = geo.sphere_m(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"))
    return final.join(e, "stop_id").where(d <= radius).groupBy("stop_id").agg(F.countDistinct("kind").alias("agreeing"))


def nearest_source(final: DataFrame, evidence: DataFrame, slack: float = 1e-4) -> DataFrame:
    """(stop_id, source): the first kind whose position equals the final one, else the last kind, else unknown."""
    e = evidence.select("stop_id", "kind", "priority", F.col("lat").alias("la"), F.col("lon").alias("lo"))
    same = (F.abs(F.col("lat") - F.col("la")) < slack) & (F.abs(F.col("lon") - F.col("lo")) < slack)
    j = final.join(e, "stop_id", "left")
    return j.groupBy("stop_id").agg(F.coalesce(F.min_by("kind", F.when(same, F.col("priority"))), F.max_by("kind", "priority"), F.lit("unknown")).alias("source"))


def coverage(visits: DataFrame, shape_rows: DataFrame, far: float = 50.0, slack: float = 1.0) -> DataFrame:
    """(trip_id, seq, metres, along, verdict): each visit on its trip's shape, nearest segment first of ties.

    far: more than ``far`` metres off; reversed: its place along the line lies more than ``slack`` before that of the
    visit before. Visits have shape_id; those without a shape, and shapes of one point, give no row.
    """
    w = W.partitionBy("shape_id").orderBy("seq")
    seg = shape_rows.select("shape_id", F.col("seq").alias("i"), F.col("lat").alias("y1"), F.col("lon").alias("x1"), F.col("dist").alias("d0"), F.lead("lat").over(w).alias("y2"), F.lead("lon").over(w).alias("x2")).where("y2 is not null")
    # a place is measured once for a shape, however many trips pass it
    spots = visits.where("lat is not null").select("shape_id", "stop_id", "lat", "lon").distinct()
    j = spots.join(seg, "shape_id")
    xy = lambda a, o: geo.planar(F.col(a), F.col(o), F.col("lat"), F.col("lon"), north=111_320.0)
    (ax, ay), (bx, by), z = xy("y1", "x1"), xy("y2", "x2"), F.lit(0.0)
    t = geo.along(z, z, ax, ay, bx, by)
    j = j.select("shape_id", "stop_id", "i", geo.segment(z, z, ax, ay, bx, by).alias("m"), (F.col("d0") + t * F.hypot(bx - ax, by - ay)).alias("along"))
    near = j.groupBy("shape_id", "stop_id").agg(F.min_by(F.struct("m", "along"), F.struct("m", "i")).alias("b")).select("shape_id", "stop_id", F.col("b.m").alias("metres"), F.col("b.along").alias("along"))
    v = visits.where("lat is not null").join(near, ["shape_id", "stop_id"])
    back = F.coalesce(F.col("along") < F.lag("along").over(W.partitionBy("trip_id").orderBy("seq")) - slack, F.lit(False))
    away = F.col("metres") > far
    return v.select("trip_id", "seq", "metres", "along", F.when(away & back, "far_reversed").when(away, "far").when(back, "reversed").otherwise("ok").alias("verdict"))


def golden(conf: DataFrame, truth: DataFrame, radius: float = 100.0) -> DataFrame:
    """One row: silent errors (sure but wrong), precision of the sure, and gate: conf (stop_id, lat, lon, confidence), truth (stop_id, lat, lon)."""
    t = truth.select("stop_id", F.col("lat").alias("la"), F.col("lon").alias("lo"))
    m = geo.sphere_m(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"))
    j = conf.join(t, "stop_id").withColumn("right", F.coalesce(m <= radius, F.lit(False)))
    sure = F.col("confidence") == SURE
    g = j.agg(F.count_if(sure & ~F.col("right")).alias("silent_errors"), F.count_if(sure).alias("sure"), F.count_if(sure & F.col("right")).alias("sure_right"))
    return g.withColumn("passed", F.col("silent_errors") == 0)


def gates(rows: DataFrame) -> DataFrame:
    """All-pass per level of (level, name, ok), with the names that fail."""
    return rows.groupBy("level").agg(F.bool_and("ok").alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))), ",").alias("failing"))
