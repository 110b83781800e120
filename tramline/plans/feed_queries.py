"""Queries on the feed tables for the general data problems 2 to 5, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.instants import normalise_times
from ..operators.orphans import OrphanTracker, Relation, parent_events, reference_events
from ..operators.reconcile import compare
from ..operators.spatial import holding, near
from ..runtime import cut, discard, table

NEAR_M = 60.0
STOP_TIME_FIELDS = ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence", "pickup_type", "drop_off_type"]
ROUTE_FIELDS = ["agency_id", "route_short_name", "route_long_name", "route_type", "route_color"]


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parents = (
        parent_events(table(spark, d, "stops"), "stop", "stop_id", gone="deleted_at")
        .unionByName(parent_events(table(spark, d, "trips"), "trip", "trip_id", gone="deleted_at"))
        .unionByName(parent_events(table(spark, d, "routes"), "route", "route_id", gone="deleted_at"))
        .unionByName(parent_events(table(spark, d, "calendar"), "service", "service_id", gone="deleted_at"))
        .unionByName(parent_events(table(spark, d, "calendar_dates"), "service", "service_id"))
    )
    refs = reference_events(table(spark, d, "stop_times"), [Relation("stop_times", "stop_id", "stop"), Relation("stop_times", "trip_id", "trip")]).unionByName(
        reference_events(table(spark, d, "trips"), [Relation("trips", "route_id", "route"), Relation("trips", "service_id", "service")])
    )
    return refs, parents


def _tracker(spark: SparkSession, d: str) -> OrphanTracker:
    return OrphanTracker().apply(*_events(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _tracker(spark, d).orphans().distinct()


def p2_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The orphans after one batch a quarter of loading: what waits is resolved, and what was there reopened, by later batches."""
    refs, parents = (cut(e) for e in _events(spark, d))
    quarter = lambda c: F.date_trunc("quarter", F.col(c))
    loads = refs.select(quarter("loaded_ref").alias("q")).unionAll(parents.select(quarter("loaded").alias("q"))).distinct()
    tracker = OrphanTracker()
    for q in sorted((r["q"] for r in loads.collect()), key=lambda q: (q is not None, q)):
        new = tracker.apply(refs.where(quarter("loaded_ref").eqNullSafe(F.lit(q))), parents.where(quarter("loaded").eqNullSafe(F.lit(q))))
        for old in (tracker.index, tracker.refs):  # written anew
            if old is not None:
                discard(old)
        tracker = new
    return tracker.orphans().distinct()


def p2_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _tracker(spark, d).snapshot()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_times(table(spark, d, "stop_times"), table(spark, d, "agency"), ["arrival_time", "departure_time"]).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    def one(tbl: str, key: str, fields: list[str]) -> DataFrame:
        found = compare(table(spark, d, tbl), table(spark, d, f"{tbl}_copy"), [key], fields)
        return found.select(F.lit(tbl).alias("tbl"), F.col(key).cast("string").alias("row_key"), "finding").distinct()

    return one("stop_times", "row_id", STOP_TIME_FIELDS).unionAll(one("routes", "route_id", ROUTE_FIELDS))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    stops = table(spark, d, "stops").select("stop_id", "stop_lat", "stop_lon")
    pairs = near(stops, "stop_id", "stop_lat", "stop_lon", NEAR_M).select(F.lit("near").alias("kind"), "key_a", "key_b")
    inside = holding(stops, "stop_id", "stop_lat", "stop_lon", table(spark, d, "districts"), "district_id", "ring_lat", "ring_lon").select(F.lit("inside").alias("kind"), "key_a", "key_b")
    return pairs.unionAll(inside)


_REFS = """
refs as (
  select 'stop_times' tbl, 'stop_id' fld, row_id, 'stop' rel, stop_id k, loaded_at t from stop_times
  union all select 'stop_times', 'trip_id', row_id, 'trip', trip_id, loaded_at from stop_times
  union all select 'trips', 'route_id', row_id, 'route', route_id, loaded_at from trips
  union all select 'trips', 'service_id', row_id, 'service', service_id, loaded_at from trips),
par as (
  select 'stop' rel, stop_id k, loaded_at l, deleted_at x from stops union all select 'trip', trip_id, loaded_at, deleted_at from trips
  union all select 'route', route_id, loaded_at, deleted_at from routes union all select 'service', service_id, loaded_at, deleted_at from calendar
  union all select 'service', service_id, loaded_at, null from calendar_dates),
j as (
  select r.tbl, r.fld, r.row_id, strftime(r.t at time zone 'UTC', '%Y-%m') load_month, count(p.k) n, count(case when p.l <= r.t then 1 end) known,
    count(case when p.l <= r.t and (p.x is null or p.x > r.t) then 1 end) alive
  from refs r left join par p on p.rel = r.rel and p.k = r.k where r.k is not null and r.k <> '' group by r.tbl, r.fld, r.row_id, r.t, load_month),
orphans as (select distinct tbl, fld, row_id, load_month, case when n = 0 then 'missing' when known = 0 then 'late' else 'deleted' end kind from j where alive = 0)
"""


def _differ_sql(tbl: str, key: str, fields: list[str]) -> str:
    each = [f"select '{tbl}' tbl, cast(a.{key} as varchar) row_key, '{f}' finding from {tbl} a join {tbl}_copy b on a.{key} = b.{key} where a.{f} is distinct from b.{f}" for f in fields]
    return " union ".join(
        [*each, f"select '{tbl}', cast({key} as varchar), 'missing_in_copy' from {tbl} where {key} not in (select {key} from {tbl}_copy)", f"select '{tbl}', cast({key} as varchar), 'missing_in_base' from {tbl}_copy where {key} not in (select {key} from {tbl})"]
    )


def _near_sql() -> str:
    return f"""
with p as (select distinct stop_id, stop_lat la, stop_lon lo from stops where stop_lat is not null and stop_lon is not null and not (stop_lat = 0 and stop_lon = 0) and abs(stop_lat) <= 90 and abs(stop_lon) <= 180),
near as (select a.stop_id key_a, b.stop_id key_b from p a join p b on a.stop_id < b.stop_id and b.la between a.la - 0.001 and a.la + 0.001
  where 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) <= {NEAR_M}),
e as (select district_id, i, ring_lat[i] y1, ring_lon[i] x1, ring_lat[i % len(ring_lat) + 1] y2, ring_lon[i % len(ring_lon) + 1] x2 from districts, unnest(generate_series(1, len(ring_lat))) u(i)),
c as (select p.stop_id, e.district_id, count(*) n from p join e on (e.y1 <= p.la) <> (e.y2 <= p.la) and p.lo < e.x1 + (p.la - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) group by all)
select 'near' kind, key_a, key_b from near union select 'inside', stop_id, district_id from c where n % 2 = 1"""


QUERIES = {"p2_found": p2_found, "p2_incremental": p2_incremental, "p2_snapshot": p2_snapshot, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found}
SQL = {
    "p2_found": f"with {_REFS} select tbl, fld, row_id, load_month, kind from orphans",
    "p2_incremental": f"with {_REFS} select tbl, fld, row_id, load_month, kind from orphans",
    "p2_snapshot": f"with {_REFS} select tbl, fld, load_month, kind, count(*) orphans from orphans group by all",
    "p4_found": _differ_sql("stop_times", "row_id", STOP_TIME_FIELDS) + " union " + _differ_sql("routes", "route_id", ROUTE_FIELDS),
    "p5_found": _near_sql(),
}
