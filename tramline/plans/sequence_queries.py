"""Sequence and geometry operators over the visits of all trips."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import sequence as S
from .base import VISITS, Registry, hav, visits

R = Registry()
_SEG = f"""{VISITS}, seg0 as (select trip_id, seq, "name" from_name, lead("name") over w to_name, stop_id from_id, lead(stop_id) over w to_id, lat, lon, lead(lat) over w lat2, lead(lon) over w lon2, lead(arr) over w - dep secs
  from visits window w as (partition by trip_id order by seq)), seg as (select *, {hav("lat", "lon", "lat2", "lon2")} metres from seg0 where to_name is not null)"""
_VERDICT = "case when metres is null or secs is null then 'missing' when secs <= 0 then case when metres > 500 then 'zero_time' else '' end when metres / 1000 / (secs / 3600.0) > 60 then 'too_fast' when metres / 1000 / (secs / 3600.0) < 2 and metres > 500 then 'too_slow' else '' end"


@R.add("win01_segments", f"with {_SEG} select trip_id, seq, from_id, to_id, secs, round(metres, 2) metres from seg")
def win01(s, d):
    return S.segments(visits(s, d)).select("trip_id", "seq", "from_id", "to_id", "secs", F.round("metres", 2).alias("metres"))


@R.add("dom15_segment_speed", f"with {_SEG} select trip_id, seq, round(metres, 2) metres, secs, {_VERDICT} verdict from seg")
def dom15(s, d):
    return S.segments(visits(s, d)).select("trip_id", "seq", F.round("metres", 2).alias("metres"), "secs", S.speed_verdict(F.col("metres"), F.col("secs")).alias("verdict"))


@R.add("agg09_verdict_counts", f"with {_SEG} select {_VERDICT} verdict, count(*) n from seg group by 1")
def agg09(s, d):
    v = S.segments(visits(s, d)).select(S.speed_verdict(F.col("metres"), F.col("secs")).alias("verdict"))
    return v.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@R.add("win02_cumulative_distance", f"""with {VISITS}, x as (select trip_id, seq, coalesce({hav("lag(lat) over w", "lag(lon) over w", "lat", "lon")}, 0) step from visits where lat is not null window w as (partition by trip_id order by seq))
select trip_id, seq, round(sum(step) over (partition by trip_id order by seq rows unbounded preceding), 1) dist from x""")
def win02(s, d):
    return S.cumulative(visits(s, d).where("lat is not null")).select("trip_id", "seq", F.round("dist", 1).alias("dist"))


@R.add("win03_collapse", f"""with {VISITS}, x as (select *, round(lat, 3) la, round(lon, 3) lo from visits where lat is not null),
y as (select *, lag(1) over w is null or la is distinct from lag(la) over w or lo is distinct from lag(lo) over w keep from x window w as (partition by trip_id order by seq))
select trip_id, row_number() over (partition by trip_id order by seq) - 1 pos, la, lo from y where keep""")
def win03(s, d):
    v = visits(s, d).where("lat is not null").withColumn("la", F.round("lat", 3)).withColumn("lo", F.round("lon", 3))
    return S.collapse(v, "trip_id", "seq", ["la", "lo"]).select("trip_id", "pos", "la", "lo")


_PREV = lambda c: f"last_value({c} ignore nulls) over (partition by trip_id order by seq rows between unbounded preceding and 1 preceding)"


@R.add("win05_roll_over", f"""with {VISITS}, x as (select trip_id, seq, (arr // 60) % 1440 m from visits), y as (select *, case when m < {_PREV('m')} and m + 1440 - {_PREV('m')} <= 180 then 1 else 0 end j from x)
select trip_id, seq, m, m + 1440 * cast(sum(j) over (partition by trip_id order by seq rows unbounded preceding) as bigint) rolled from y""")
def win05(s, d):
    v = visits(s, d).select("trip_id", "seq", (F.floor(F.col("arr") / 60) % 1440).alias("m"))
    return S.roll_over(v).select("trip_id", "seq", "m", "rolled")


@R.add("win06_roll_over_adjusted")
def win06(s, d):
    v = visits(s, d).groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", (F.floor(F.col("arr") / 60) % 1440).cast("int").alias("m")))).alias("x"))
    return v.select("trip_id", S.roll_over_adjusted(F.col("x.m")).alias("rolled"))


@R.add("win07_monotonic", f"""with {VISITS}, x as (select trip_id, {_PREV('arr')} - arr fall from visits)
select trip_id, coalesce(max(fall) <= 0, true) monotonic, max(fall) largest_fall from x group by 1""")
def win07(s, d):
    return S.monotonic(visits(s, d))


@R.add("win08_backward_jump", f"""with {VISITS}, x as (select trip_id, {_PREV('arr')} - arr fall from visits) select trip_id, max(fall) largest_fall from x group by 1 having max(fall) >= 1800""")
def win08(s, d):
    return S.monotonic(visits(s, d)).where("largest_fall >= 1800").select("trip_id", "largest_fall")


@R.add("win09_backward_steps", f"with {VISITS}, x as (select trip_id, seq, arr, {_PREV('arr')} p, first_value(arr ignore nulls) over (partition by trip_id order by seq rows between 1 following and unbounded following) n from visits) select trip_id, seq, arr from x where arr < p or arr > n")
def win09(s, d):
    w = W.partitionBy("trip_id").orderBy("seq")
    v = visits(s, d).select("trip_id", "seq", "arr", S.known("arr", w).alias("p"), S.known("arr", w, ahead=True).alias("n"))
    return v.where("arr < p or arr > n").select("trip_id", "seq", "arr")


_ROUTE = "regexp_extract(trip_id, '^(.*)_[0-9]+$', 1)"
_ANOM = f"""{VISITS}, x as (select {_ROUTE} grp, trip_id, seq, stop_id, arr / 60.0 m from visits), y as (select *, lag(stop_id) over w pn, lag(m) over w pm, lead(stop_id) over w nn, lead(m) over w nm from x window w as (partition by grp, trip_id order by seq)),
med as (select grp, pn a, stop_id b, median(m - pm) med from y where pn is not null group by 1, 2, 3 having count(m - pm) >= 2),
z as (select y.*, y.pm + p.med e1, y.nm - q.med e2 from y left join med p on p.grp = y.grp and p.a = y.pn and p.b = y.stop_id left join med q on q.grp = y.grp and q.a = y.stop_id and q.b = y.nn),
f as (select *, coalesce(m < pm, false) or coalesce(m > nm, false) backward, coalesce(abs(e1 - e2) <= 3, false) ok, (e1 + e2) / 2 mid from z),
an as (select trip_id, seq, stop_id, backward, case when ok and (abs(m - mid) >= 5 or backward) then 'high' when backward then 'low' end lv, round(case when ok then mid end, 4) suggestion from f)"""


def _anomalies(s, d):
    v = visits(s, d).select(F.regexp_extract("trip_id", "^(.*)_[0-9]+$", 1).alias("grp"), "trip_id", "seq", "stop_id", (F.col("arr") / 60).alias("m"))
    return S.anomalies(v, "grp", "trip_id", "seq", "stop_id", "m")


@R.add("dom14_time_anomalies", f'with {_ANOM} select trip_id, seq, stop_id, backward, lv "level", suggestion from an where lv is not null')
def dom14(s, d):
    return _anomalies(s, d).select("trip_id", "seq", "stop_id", "backward", "level", F.round("suggestion", 4).alias("suggestion"))


@R.add("agg11_pair_intervals", f"with {_ANOM} select grp, a, b, round(med, 4) med from med")
def agg11(s, d):
    w = W.partitionBy("grp", "trip_id").orderBy("seq")
    v = visits(s, d).select(F.regexp_extract("trip_id", "^(.*)_[0-9]+$", 1).alias("grp"), "trip_id", "seq", "stop_id", (F.col("arr") / 60).alias("m")).withColumn("a", F.lag("stop_id").over(w)).withColumn("i", F.col("m") - F.lag("m").over(w))
    return v.where("a is not null").groupBy("grp", "a", F.col("stop_id").alias("b")).agg(F.round(F.median("i"), 4).alias("med"), F.count("i").alias("n")).where("n >= 2").drop("n")


_INTER = f"""{VISITS}, k as (select *, row_number() over (partition by trip_id order by seq) k from visits),
n as (select *, last_value(case when lat is not null then k end ignore nulls) over b ka, last_value(lat ignore nulls) over b la, last_value(lon ignore nulls) over b lo, first_value(case when lat is not null then k end ignore nulls) over f kb, first_value(lat ignore nulls) over f lb, first_value(lon ignore nulls) over f ob
  from k window b as (partition by trip_id order by seq rows between unbounded preceding and 1 preceding), f as (partition by trip_id order by seq rows between 1 following and unbounded following)),
i as (select trip_id, seq, stop_id, la + (lb - la) * (k - ka) / (kb - ka) ilat, lo + (ob - lo) * (k - ka) / (kb - ka) ilon from n where lat is null and ka is not null and kb is not null)"""


@R.add("win11_interpolate", f"with {_INTER} select trip_id, seq, stop_id, round(ilat, 6) ilat, round(ilon, 6) ilon from i")
def win11(s, d):
    return S.interpolate(visits(s, d)).where("ilat is not null").select("trip_id", "seq", "stop_id", F.round("ilat", 6).alias("ilat"), F.round("ilon", 6).alias("ilon"))


@R.add("agg14_interpolated_stops", f"with {_INTER} select stop_id, round(median(ilat), 5) lat, round(median(ilon), 5) lon, count(*) n_visits from i group by 1")
def agg14(s, d):
    return S.interpolated_stops(visits(s, d)).select("stop_id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "n_visits")


_OFF = f"""{VISITS}, l as (select * from visits where lat is not null), c as (select v.trip_id, v.seq, v.stop_id, v.lat, v.lon, max(case when o.seq < v.seq then o.seq end) ps, min(case when o.seq > v.seq then o.seq end) ns
  from l v join l o on o.trip_id = v.trip_id and o.stop_id <> v.stop_id group by all),
g as (select c.stop_id, (c.lon - p.lon) * 111320.0 * cos(radians(p.lat)) px, (c.lat - p.lat) * 110540.0 py, (n.lon - p.lon) * 111320.0 * cos(radians(p.lat)) bx, (n.lat - p.lat) * 110540.0 "by"
  from c join l p on p.trip_id = c.trip_id and p.seq = c.ps join l n on n.trip_id = c.trip_id and n.seq = c.ns),
t as (select *, case when bx * bx + "by" * "by" = 0 then 0.0 else greatest(0.0, least(1.0, (px * bx + py * "by") / (bx * bx + "by" * "by"))) end t from g),
off as (select stop_id, min(sqrt(pow(px - t * bx, 2) + pow(py - t * "by", 2))) metres from t group by 1)"""


@R.add("win13_off_route", f"with {_OFF} select stop_id, round(metres, 2) metres from off")
def win13(s, d):
    return S.off_route(visits(s, d)).select("stop_id", F.round("metres", 2).alias("metres"))


@R.add("dom17_outliers", f"with {_OFF} select stop_id, round(metres, 2) metres from off where metres > 3000")
def dom17(s, d):
    return S.off_route(visits(s, d)).where("metres > 3000").select("stop_id", F.round("metres", 2).alias("metres"))


_HEAD = f"""{VISITS}, l as (select stop_id, coalesce(lag(lat) over w, lat) alat, coalesce(lag(lon) over w, lon) alon, coalesce(lead(lat) over w, lat) blat, coalesce(lead(lon) over w, lon) blon from visits where lat is not null window w as (partition by trip_id order by seq)),
h0 as (select stop_id, (blon - alon) * cos(radians((alat + blat) / 2)) e, blat - alat n from l), h1 as (select *, sqrt(e * e + n * n) len from h0), heads as (select stop_id, sum(e / len) east, sum(n / len) north from h1 where len > 0 group by 1)"""


@R.add("win14_headings", f"with {_HEAD} select stop_id, round(east, 4) east, round(north, 4) north from heads")
def win14(s, d):
    return S.headings(visits(s, d)).select("stop_id", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"))


@R.add("geo09_offset_left", f"with {_HEAD}, p as (select stop_id, max(lat) lat, max(lon) lon from visits where lat is not null group by 1) select stop_id, round(lat + 15 * east / sqrt(east * east + north * north) / 110540.0, 6) lat, round(lon - 15 * north / sqrt(east * east + north * north) / (111320.0 * cos(radians(lat))), 6) lon from heads join p using (stop_id) where sqrt(east * east + north * north) > 0.01")
def geo09(s, d):
    v = visits(s, d)
    p = v.where("lat is not null").groupBy("stop_id").agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"))
    h = S.headings(v).where(F.hypot("east", "north") > 0.01).join(p, "stop_id")
    la, lo = geo.offset_left(F.col("lat"), F.col("lon"), F.col("east"), F.col("north"), 15.0)
    return h.select("stop_id", F.round(la, 6).alias("lat"), F.round(lo, 6).alias("lon"))


_TRIPS = f"""{VISITS}, fl as (select trip_id, arg_min(stop_id, seq) origin, arg_max(stop_id, seq) terminal, first(dep order by seq) "start", last(arr order by seq) "end", min(dep) first_dep, count(*) n from visits where stop_id is not null group by 1)"""


def _trips(s, d):
    return S.first_last(visits(s, d).where("stop_id is not null"))


@R.add("win26_loops", f"with {_TRIPS} select trip_id, origin, n from fl where origin = terminal and n > 1")
def win26(s, d):
    return _trips(s, d).where("loop").select("trip_id", "origin", "n")


@R.add("jn18_vehicle_links", f"""with {_TRIPS} select x.trip_id a, y.trip_id b, x.terminal place, y."start" - x."end" wait from fl x join fl y on y.origin = x.terminal and x.trip_id <> y.trip_id and y."start" - x."end" between 0 and 60""")
def jn18(s, d):
    return S.link_candidates(_trips(s, d), "trip_id", "origin", "terminal", "start", "end", 60)


@R.add("win20_chain_conflicts", f"""with {_TRIPS}, b as (select trip_id, max(block_id) block_id from trips where block_id is not null group by 1), c as (select b.block_id, fl.*, lead(trip_id) over w next_id, lead("start") over w ns, lead(origin) over w no_ from fl join b using (trip_id) where first_dep is not null window w as (partition by b.block_id order by coalesce("start", first_dep), trip_id))
select block_id, trip_id this_id, next_id, case when ns < "end" then 'overlap' when no_ <> terminal then 'moved' end verdict from c where next_id is not null and (ns < "end" or no_ <> terminal)""")
def win20(s, d):
    from ..runtime import table

    b = table(s, d, "trips").where("block_id is not null").groupBy("trip_id").agg(F.max("block_id").alias("block_id"))
    t = _trips(s, d).withColumn("at", F.coalesce("start", "first_dep")).where("at is not null")  # a trip without any time has no place in a chain
    return S.chain_conflicts(t.join(b, "trip_id"), "block_id", "start", "end", "origin", "terminal", "trip_id", "at")


@R.add("win16_gap_clusters", f"""with {VISITS}, x as (select stop_id, arr, trip_id, seq, case when arr - lag(arr) over w > 3600 then 1 else 0 end nw from visits where stop_id is not null and arr is not null window w as (partition by stop_id order by arr, trip_id, seq)),
y as (select stop_id, arr, cast(sum(nw) over (partition by stop_id order by arr, trip_id, seq rows unbounded preceding) as bigint) island from x) select stop_id, island, count(*) n, min(arr) lo, max(arr) hi, round(avg(arr), 2) mean from y group by 1, 2""")
def win16(s, d):
    v = visits(s, d).where("stop_id is not null and arr is not null").withColumn("ord", F.struct("trip_id", "seq"))
    return S.islands(v, "stop_id", "ord", "arr", 3600).groupBy("stop_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("arr").alias("lo"), F.max("arr").alias("hi"), F.round(F.avg("arr"), 2).alias("mean"))


@R.add("win21_renumber", f"with {VISITS} select trip_id, seq, row_number() over (partition by trip_id order by seq desc) new_seq from visits")
def win21(s, d):
    return visits(s, d).select("trip_id", "seq", F.row_number().over(W.partitionBy("trip_id").orderBy(F.desc("seq"))).alias("new_seq"))


@R.add("win27_issue_counts", f"""with {VISITS}, x as (select feed_id, trip_id, arr, {_PREV('arr')} p from visits) select feed_id, count(*) filter (where arr < p) reversals, count(*) filter (where arr >= 86400) next_day, count(*) n from x group by 1""")
def win27(s, d):
    w = W.partitionBy("trip_id").orderBy("seq")
    v = visits(s, d).withColumn("p", S.known("arr", w))
    return v.groupBy("feed_id").agg(F.count_if(F.col("arr") < F.col("p")).alias("reversals"), F.count_if(F.col("arr") >= 86400).alias("next_day"), F.count(F.lit(1)).alias("n"))


@R.add("geo03_feed_radius", f"""with {VISITS}, c as (select feed_id, avg(lat) la, avg(lon) lo from places where lat is not null group by 1) select p.stop_id, round({hav("c.la", "c.lo", "p.lat", "p.lon")} / 1000, 3) km, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 1) metres,
round((p.lon - c.lo) * 111320 * cos(radians(c.la)), 1) x, round((p.lat - c.la) * 110540, 1) y, round((p.lat - c.la) * 111320, 1) y2 from (select p.*, pow(sin(radians(p.lat - c.la) / 2), 2) + cos(radians(c.la)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - c.lo) / 2), 2) h from places p join c using (feed_id) where p.lat is not null) p join c using (feed_id)""")
def geo03(s, d):
    from .base import places

    p = places(s, d).where("lat is not null")
    j = p.join(p.groupBy("feed_id").agg(F.avg("lat").alias("la"), F.avg("lon").alias("lo")), "feed_id")
    a = (F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))
    (x, y), (_, y2) = geo.planar(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")), geo.planar(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"), north=111_320.0)
    return j.select("stop_id", F.round(geo.sphere_m(*a) / 1000, 3).alias("km"), F.round(geo.atan_m(*a), 1).alias("metres"), F.round(x, 1).alias("x"), F.round(y, 1).alias("y"), F.round(y2, 1).alias("y2"))


@R.add("stm_hourly_windows")
def stm(s, d):
    """Batch twin of the streaming job on events: tumbling hourly counts."""
    from ..streaming.events import hourly
    from ..runtime import table

    return hourly(table(s, d, "events"))


QUERIES, SQL = R.queries, R.sql
SQL["stm_hourly_windows"] = "select date_trunc('hour', ts) window_start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2"
