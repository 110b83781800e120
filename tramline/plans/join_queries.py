"""Joins, set comparisons and aggregates between a feed and its second copy, the survey and the reference lists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock, text
from ..operators import matching as M
from ..operators.spatial import sphere_m
from ..runtime import table
from .base import PLACES, VISITS, Registry, hav, normal, places, visits

R = Registry()
_PY = """py as (select ref_name, min(ref_id) ref_id, max(ref_reading) reading from stop_reference group by 1)"""


@R.add("jn01_fill_by_name", f"with {PLACES}, ref as (select point_name nm, arg_min(lat, survey_id) la, arg_min(lon, survey_id) lo from stop_survey where lat is not null and lon is not null and point_name is not null group by 1) select stop_id, case when p.lat is null and r.nm is not null then r.la else p.lat end lat, case when p.lat is null and r.nm is not null then r.lo else p.lon end lon, case when p.lat is null and r.nm is not null then 'survey' end source from places p left join ref r on r.nm = p.\"name\"")
def jn01(s, d):
    ref = M.first_by(table(s, d, "stop_survey").where("lat is not null and lon is not null and point_name is not null"), "point_name", "survey_id").select(F.col("point_name").alias("name"), "lat", "lon")
    return M.fill(places(s, d).drop("feed_id"), ref, "name", ["lat", "lon"], "survey").select("stop_id", "lat", "lon", "source")


@R.add("jn02_canonical_spelling", "with m as (select lower(ref_name) k, min(ref_name) c from stop_reference group by 1) select distinct s.stop_name old, coalesce(m.c, s.stop_name) new_name from stops s left join m on m.k = lower(trim(s.stop_name, ' ')) where s.stop_name is not null and coalesce(m.c, s.stop_name) <> s.stop_name")
def jn02(s, d):
    m = table(s, d, "stop_reference").groupBy(F.lower("ref_name").alias("k")).agg(F.min("ref_name").alias("c"))
    n = table(s, d, "stops").select(F.col("stop_name").alias("old")).where("old is not null").distinct()
    return n.join(m, F.lower(F.trim("old")) == F.col("k"), "left").select("old", F.coalesce("c", "old").alias("new_name")).where("old <> new_name")


@R.add("jn03_two_key_priority", f"""with {PLACES}, byid as (select stop_id k, 1.5 v from places where stop_id like '%_1'), bynm as (select "name" k, 2.5 v from places where "name" <> '' group by 1 having count(*) > 1)
select p.stop_id, coalesce(i.v, n.v) v from places p left join byid i on i.k = p.stop_id left join bynm n on n.k = p."name" """)
def jn03(s, d):
    p = places(s, d)
    by_id = p.where("stop_id like '%_1'").select("stop_id", F.lit(1.5).alias("v1"))
    by_name = p.where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit(2.5).alias("v2"))
    return p.join(by_id, "stop_id", "left").join(by_name, "name", "left").select("stop_id", F.coalesce("v1", "v2").alias("v"))


@R.add("jn04_readings", f"with {_PY}, n as (select distinct stop_name from stops where stop_name is not null) select n.stop_name field_value, l.language, case when l.language = 'ja-Hrkt' then py.reading end translation from n join py on py.ref_name = n.stop_name cross join (values ('ja-Hrkt'), ('en')) l(language)")
def jn04(s, d):
    py = table(s, d, "stop_reference").groupBy("ref_name").agg(F.max("ref_reading").alias("reading"))
    n = table(s, d, "stops").select("stop_name").where("stop_name is not null").distinct()
    lang = F.explode(F.array(F.lit("ja-Hrkt"), F.lit("en"))).alias("language")
    return n.join(py, n["stop_name"] == py["ref_name"]).select(F.col("stop_name").alias("field_value"), lang, "reading").select("field_value", "language", F.when(F.col("language") == "ja-Hrkt", F.col("reading")).alias("translation"))


@R.add("jn05_visit_names", f"""with {VISITS} select trip_id, seq, "name" from visits""")
def jn05(s, d):
    return visits(s, d).select("trip_id", "seq", "name")


_RK = "coalesce(nullif(trim(route_short_name, ' '), ''), nullif(trim(regexp_extract(route_long_name, '^([0-9]+)\\s+', 1), ' '), ''), nullif(trim(route_long_name, ' '), ''), '')"


def _routes(s, d, t="routes"):
    return table(s, d, t).withColumn("k", text.route_key(F.col("route_short_name"), F.col("route_long_name")))


@R.add("jn06_trips_by_route_key", f"with r as (select route_id, {_RK} k from routes) select r.k, count(*) n from trips t left join r using (route_id) where coalesce(r.k, '') <> '' group by 1")
def jn06(s, d):
    return table(s, d, "trips").join(_routes(s, d).select("route_id", "k"), "route_id", "left").where("k <> ''").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@R.add("jn08_routes_full_outer", """with a as (select route_id, route_short_name n, true x from routes), b as (select route_id, route_short_name n, true y from routes_copy) select coalesce(a.route_id, b.route_id) route_id, case when x is null then 'only_copy' when y is null then 'only_base' else 'both' end side, a.n is not distinct from b.n same from a full join b on a.route_id = b.route_id""")
def jn08(s, d):
    a = table(s, d, "routes").select("route_id", F.col("route_short_name").alias("n1"), F.lit(True).alias("x"))
    b = table(s, d, "routes_copy").select("route_id", F.col("route_short_name").alias("n2"), F.lit(True).alias("y"))
    return a.join(b, "route_id", "full").select("route_id", F.when(F.col("x").isNull(), "only_copy").when(F.col("y").isNull(), "only_base").otherwise("both").alias("side"), F.col("n1").eqNullSafe(F.col("n2")).alias("same"))


_COORD = f"""{PLACES}, a as (select "name", arg_min(lat, stop_id) la, arg_min(lon, stop_id) lo from places where "name" <> '' and lat is not null group by 1), b as (select point_name "name", arg_min(lat, survey_id) la2, arg_min(lon, survey_id) lo2 from stop_survey where point_name <> '' and lat is not null and lon is not null group by 1),
dist as (select "name", {hav("la", "lo", "la2", "lo2")} metres from a join b using ("name"))"""


def _coords(s, d):
    a = M.first_by(places(s, d).where("name <> '' and lat is not null"), "name", "stop_id").select("name", "lat", "lon")
    b = M.first_by(table(s, d, "stop_survey").where("point_name <> '' and lat is not null and lon is not null"), "point_name", "survey_id").select(F.col("point_name").alias("name"), F.col("lat").alias("la2"), F.col("lon").alias("lo2"))
    return a.join(b, "name").select("name", sphere_m(F.col("lat"), F.col("lon"), F.col("la2"), F.col("lo2")).alias("metres"))


@R.add("jn09_named_distance", f'with {_COORD} select "name", round(metres, 1) metres from dist')
def jn09(s, d):
    return _coords(s, d).select("name", F.round("metres", 1).alias("metres"))


@R.add("agg05_median_and_friends", f"""with {_COORD}, o as (select list(metres order by metres) l from dist) select round(median(metres), 2) med, round(avg(metres), 2) mean, round(max(metres), 2) top, count(*) filter (where metres <= 50) within_50, round((select l[len(l) // 2 + 1] from o), 2) upper_median, round((select l[cast(round_even(0.9 * (len(l) - 1), 0) as int) + 1] from o), 2) p90 from dist""")
def agg05(s, d):
    """Exact median, upper median, nearest-rank p90, mean, maximum and count within 50 m."""
    c = _coords(s, d)
    n = c.agg(F.count(F.lit(1)).alias("n"), F.round(F.median("metres"), 2).alias("med"), F.round(F.avg("metres"), 2).alias("mean"), F.round(F.max("metres"), 2).alias("top"), F.count_if(F.col("metres") <= 50).alias("within_50"))
    total = n.first()["n"]
    pick = c.agg(*[F.round(F.percentile("metres", min(1.0, i / max(1, total - 1))), 2).alias(k) for k, i in (("upper_median", total // 2), ("p90", round(0.9 * max(0, total - 1))))])
    return n.drop("n").crossJoin(pick)


_FEEDS = f"""{VISITS}, va as (select * from visits), vb as (select trip_id, stop_sequence seq, coalesce(p."name", '') "name", {normal("arrival_time")} a from stop_times_copy c left join places p on p.stop_id = c.stop_id where coalesce(trip_id, '') <> '' and stop_sequence is not null qualify row_number() over (partition by trip_id, stop_sequence order by row_id desc) = 1),
sa as (select trip_id, string_agg("name", chr(31) order by seq) sig, first(a order by seq) ft from va group by 1), sb as (select trip_id, string_agg("name", chr(31) order by seq) sig, first(a order by seq) ft from vb group by 1),
ka as (select *, row_number() over (partition by sig order by ft nulls first, trip_id) k from sa), kb as (select *, row_number() over (partition by sig order by ft nulls first, trip_id) k from sb),
pairs as (select ka.trip_id ours, kb.trip_id theirs from ka full join kb on ka.sig = kb.sig and ka.k = kb.k),
na as (select trip_id, row_number() over (partition by trip_id order by seq) - 1 pos, "name", a from va), nb as (select trip_id, row_number() over (partition by trip_id order by seq) - 1 pos, a from vb)"""


def _copy_visits(s, d):
    t = table(s, d, "stop_times_copy").where((F.coalesce("trip_id", F.lit("")) != "") & F.col("stop_sequence").isNotNull())
    t = M.first_by(t, ["trip_id", "stop_sequence"], F.desc("row_id")).select("trip_id", F.col("stop_sequence").alias("seq"), "stop_id", clock.normal(F.col("arrival_time")).alias("a"))
    return t.join(places(s, d).select("stop_id", "name"), "stop_id", "left").withColumn("name", F.coalesce("name", F.lit("")))


def aligned(s, d):
    return M.align(M.signatures(visits(s, d)), M.signatures(_copy_visits(s, d)))


@R.add("jn10_align_trips", f"with {_FEEDS} select ours, theirs from pairs")
def jn10(s, d):
    return aligned(s, d).select("ours", "theirs")


@R.add("jn11_compare_aligned", f"""with {_FEEDS} select ours, theirs, na.pos, na."name", na.a time_a, nb.a time_b, na.a is not distinct from nb.a same from pairs join na on na.trip_id = ours join nb on nb.trip_id = theirs and nb.pos = na.pos where ours is not null and theirs is not null""")
def jn11(s, d):
    return M.compare_aligned(aligned(s, d))


@R.add("dom12_alignment_report", f"""with {_FEEDS}, r as (select na.a is not distinct from nb.a same from pairs join na on na.trip_id = ours join nb on nb.trip_id = theirs and nb.pos = na.pos where ours is not null and theirs is not null)
select (select count(*) from pairs where ours is not null and theirs is not null) matched, (select count(*) from pairs where theirs is null) only_ours, (select count(*) from pairs where ours is null) only_theirs, count(*) rows_compared, count(*) filter (where same) rows_equal from r""")
def dom12(s, d):
    p = aligned(s, d)
    n = p.agg(F.count_if(F.col("ours").isNotNull() & F.col("theirs").isNotNull()).alias("matched"), F.count_if(F.col("theirs").isNull()).alias("only_ours"), F.count_if(F.col("ours").isNull()).alias("only_theirs"))
    return n.crossJoin(M.compare_aligned(p).agg(F.count(F.lit(1)).alias("rows_compared"), F.count_if("same").alias("rows_equal")))


_TOUCH = """n as (select distinct stop_name nm from stops where length(stop_name) >= 2), c as (select distinct ref_name cand from stop_reference where length(ref_name) >= 2), t as (select nm, cand from n, c where nm <> cand and (contains(nm, cand) or contains(cand, nm)))"""


def _touch(s, d):
    n = table(s, d, "stops").select(F.col("stop_name").alias("name"))
    return M.touching(n, table(s, d, "stop_reference").select(F.col("ref_name").alias("cand"))).withColumnRenamed("name", "nm")


@R.add("jn13_prefix_suffix", f"with {_TOUCH} select nm, cand from t where starts_with(nm, cand) or ends_with(nm, cand) or starts_with(cand, nm) or ends_with(cand, nm)")
def jn13(s, d):
    return _touch(s, d).where("startswith(nm, cand) or endswith(nm, cand) or startswith(cand, nm) or endswith(cand, nm)")


@R.add("jn14_substring", f"with {_TOUCH} select nm, cand from t")
def jn14(s, d):
    return _touch(s, d)


@R.add("jn16_cascade")
def jn16(s, d):
    n = table(s, d, "stops").select(text.squeeze(F.col("stop_name")).alias("name"))
    return M.cascade(n, table(s, d, "stop_reference").select(F.col("ref_name").alias("cand")).distinct())


@R.add("jn17_exact_bucket", "select s.stop_id, min(r.ref_id) ref_id from stops s join stop_reference r on r.ref_name = s.stop_name group by 1")
def jn17(s, d):
    r = table(s, d, "stop_reference")
    return table(s, d, "stops").join(r, F.col("stop_name") == F.col("ref_name")).groupBy("stop_id").agg(F.min("ref_id").alias("ref_id"))




@R.add("jn20_nearest_candidate", f"""with {PLACES}, c as (select point_name "name", survey_id, lat la, lon lo from stop_survey where lat is not null and lon is not null) select stop_id, arg_min(survey_id, ({hav("p.lat", "p.lon", "c.la", "c.lo")}, survey_id)) survey_id from places p join c using ("name") where p.lat is not null and p."name" <> '' group by 1""")
def jn20(s, d):
    c = table(s, d, "stop_survey").where("lat is not null and lon is not null").select(F.col("point_name").alias("name"), "survey_id", F.col("lat").alias("la"), F.col("lon").alias("lo"))
    j = places(s, d).where("lat is not null and name <> ''").join(c, "name")
    return j.groupBy("stop_id").agg(F.min_by("survey_id", F.struct(sphere_m(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")), "survey_id")).alias("survey_id"))


@R.add("jn25_route_agency_orphans", "select route_id, agency_id from routes r where agency_id is not null and not exists (select 1 from agency a where a.agency_id = r.agency_id)")
def jn25(s, d):
    return table(s, d, "routes").where("agency_id is not null").join(table(s, d, "agency"), "agency_id", "left_anti").select("route_id", "agency_id")


@R.add("jn26_dangling_counts", "select count(*) filter (where stop_id is not null and stop_id not in (select stop_id from stops where stop_id is not null)) bad_stop, count(*) filter (where trip_id is not null and trip_id not in (select trip_id from trips where trip_id is not null)) bad_trip from stop_times")
def jn26(s, d):
    t = table(s, d, "stop_times")
    bad = lambda parent, k: t.where(F.col(k).isNotNull()).join(table(s, d, parent).select(k), k, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return bad("stops", "stop_id").withColumnRenamed("n", "bad_stop").crossJoin(bad("trips", "trip_id").withColumnRenamed("n", "bad_trip"))


@R.add("flt20_referenced_only", "select t.row_id from stop_times t where exists (select 1 from trips x where x.trip_id = t.trip_id and x.shape_id is not null)")
def flt20(s, d):
    return table(s, d, "stop_times").join(table(s, d, "trips").where("shape_id is not null"), "trip_id", "left_semi").select("row_id")


@R.add("agg01_trip_sequences", f"""with {VISITS} select trip_id, string_agg(seq || ':' || "name" || '@' || coalesce(a, ''), '>' order by seq) line from visits group by 1""")
def agg01(s, d):
    v = M.signatures(visits(s, d))
    return v.select("trip_id", F.array_join(F.transform("rows", lambda r: F.concat(r["seq"].cast("string"), F.lit(":"), r["n"], F.lit("@"), F.coalesce(r["t"], F.lit("")))), ">").alias("line"))


@R.add("agg02_stop_patterns", f"""with {VISITS}, p as (select trip_id, string_agg(stop_id, '|' order by seq) k from visits where stop_id is not null group by 1) select k, left(sha1(k), 8) short_hash, count(*) n, min(trip_id) first_trip from p group by 1""")
def agg02(s, d):
    v = visits(s, d).where("stop_id is not null").groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stop_id"))).alias("x"))
    p = v.select("trip_id", text.pattern_key(F.col("x.stop_id")).alias("k"))
    return p.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("trip_id").alias("first_trip")).withColumn("short_hash", text.short_hash(F.col("k")))


@R.add("agg03_count_ratio", "with a as (select trip_id k, count(*) n from stop_times where trip_id is not null group by 1), b as (select trip_id k, count(*) n from stop_times_copy where trip_id is not null group by 1) select k, a.n n1, b.n n2, round(least(a.n, b.n) * 100.0 / greatest(a.n, b.n), 6) pct from a join b using (k)")
def agg03(s, d):
    n = lambda t, c: table(s, d, t).where("trip_id is not null").groupBy(F.col("trip_id").alias("k")).agg(F.count(F.lit(1)).alias(c))
    return n("stop_times", "n1").join(n("stop_times_copy", "n2"), "k").withColumn("pct", F.round(F.least("n1", "n2") * 100.0 / F.greatest("n1", "n2"), 6))


@R.add("agg04_distinct_pairs", "select feed_id, count(distinct stop_id) stops, count(distinct (stop_id, arrival_time)) pairs from stop_times where stop_id is not null and arrival_time is not null group by 1")
def agg04(s, d):
    t = table(s, d, "stop_times").where("stop_id is not null and arrival_time is not null")
    return t.groupBy("feed_id").agg(F.countDistinct("stop_id").alias("stops"), F.countDistinct("stop_id", "arrival_time").alias("pairs"))


@R.add("agg12_least_over_threshold", f"""with {_COORD} select "name", round(metres, 1) metres from dist where metres > 500""")
def agg12(s, d):
    return _coords(s, d).groupBy("name").agg(F.min("metres").alias("metres")).where("metres > 500").select("name", F.round("metres", 1).alias("metres"))


@R.add("agg13_max_pairwise", f"""with {PLACES}, q as (select distinct feed_id, "name", lat, lon from places where lat is not null and "name" <> '') select x.feed_id, x."name", round(max({hav("x.lat", "x.lon", "y.lat", "y.lon")}), 1) spread from q x join q y on x.feed_id = y.feed_id and x."name" = y."name" and (x.lat, x.lon) < (y.lat, y.lon) group by 1, 2""")
def agg13(s, d):
    q = places(s, d).where("lat is not null and name <> ''").select("feed_id", "name", "lat", "lon").distinct()
    y = q.select("feed_id", "name", F.col("lat").alias("la"), F.col("lon").alias("lo"))
    return q.join(y, ["feed_id", "name"]).where("lat < la or (lat = la and lon < lo)").groupBy("feed_id", "name").agg(F.round(F.max(sphere_m(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"))), 1).alias("spread"))


@R.add("flt18_ambiguous_names", f"""with {PLACES}, q as (select distinct feed_id, "name", lat, lon from places where lat is not null and "name" <> '') select x.feed_id, x."name" from q x join q y on x.feed_id = y.feed_id and x."name" = y."name" and (x.lat, x.lon) < (y.lat, y.lon) group by 1, 2 having max({hav("x.lat", "x.lon", "y.lat", "y.lon")}) > 100""")
def flt18(s, d):
    return agg13(s, d).where("spread > 100").select("feed_id", "name")


@R.add("agg16_first_direction", "select stop_id, arg_min(direction_id, (st.row_id, t.row_id)) direction from stop_times st join trips t using (trip_id) where stop_id is not null and direction_id is not null group by 1")
def agg16(s, d):
    t = table(s, d, "trips").where("direction_id is not null").select("trip_id", "direction_id", F.col("row_id").alias("tr"))
    return table(s, d, "stop_times").where("stop_id is not null").join(t, "trip_id").groupBy("stop_id").agg(F.min_by("direction_id", F.struct("row_id", "tr")).alias("direction"))


@R.add("agg17_two_and_two", """select stop_name, min(zone_id) z from stops where stop_name is not null group by 1 having count(distinct stop_id) = 2 and count(distinct zone_id) = 2""")
def agg17(s, d):
    g = table(s, d, "stops").where("stop_name is not null").groupBy("stop_name").agg(F.countDistinct("stop_id").alias("n"), F.countDistinct("zone_id").alias("m"), F.min("zone_id").alias("z"))
    return g.where("n = 2 and m = 2").select("stop_name", "z")


@R.add("agg18_mode", "with c as (select feed_id, stop_sequence x, count(*) n from stop_times where stop_sequence is not null group by 1, 2), m as (select *, max(n) over (partition by feed_id) top from c) select feed_id, min(x) filter (where n = top) mode_x, min(x) filter (where n >= 0.7 * top) leftmost from m group by 1")
def agg18(s, d):
    c = table(s, d, "stop_times").where("stop_sequence is not null").groupBy("feed_id", F.col("stop_sequence").alias("x")).agg(F.count(F.lit(1)).alias("n")).withColumn("top", F.max("n").over(W.partitionBy("feed_id")))
    return c.groupBy("feed_id").agg(F.min(F.when(F.col("n") == F.col("top"), F.col("x"))).alias("mode_x"), F.min(F.when(F.col("n") >= 0.7 * F.col("top"), F.col("x"))).alias("leftmost"))


@R.add("agg19_frequent_values", "with c as (select feed_id, stop_id, count(*) n from stop_times where stop_id is not null group by 1, 2), m as (select *, max(n) over (partition by feed_id) top from c) select feed_id, stop_id, n from m where n >= greatest(4, 0.5 * top)")
def agg19(s, d):
    c = table(s, d, "stop_times").where("stop_id is not null").groupBy("feed_id", "stop_id").agg(F.count(F.lit(1)).alias("n")).withColumn("top", F.max("n").over(W.partitionBy("feed_id")))
    return c.where(F.col("n") >= F.greatest(F.lit(4.0), 0.5 * F.col("top"))).select("feed_id", "stop_id", "n")


@R.add("agg21_mean_latitude", f"with {PLACES} select feed_id, round(coalesce(avg(lat), 35.0), 6) lat0 from places group by 1")
def agg21(s, d):
    return places(s, d).groupBy("feed_id").agg(F.round(F.coalesce(F.avg("lat"), F.lit(35.0)), 6).alias("lat0"))


@R.add("agg25_coverage", f"with {PLACES} select feed_id, count(*) total, count(lat) located, round(count(lat) * 100.0 / greatest(count(*), 1), 6) pct from places group by 1")
def agg25(s, d):
    g = places(s, d).groupBy("feed_id").agg(F.count(F.lit(1)).alias("total"), F.count("lat").alias("located"))
    return g.withColumn("pct", F.round(F.col("located") * 100.0 / F.greatest("total", F.lit(1)), 6))


_BITS = "monday || '' || tuesday || wednesday || thursday || friday || saturday || sunday"


@R.add("agg26_weekday_patterns", f"select {_BITS} pattern, max(service_id) service_id, count(*) n from calendar group by 1")
def agg26(s, d):
    bits = F.concat(*[F.col(c).cast("string") for c in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")])
    return table(s, d, "calendar").groupBy(bits.alias("pattern")).agg(F.max("service_id").alias("service_id"), F.count(F.lit(1)).alias("n"))


@R.add("agg28_first_per_category", "select route_color, arg_min(route_id, (loaded_at, route_id)) route_id from routes where route_color is not null group by 1")
def agg28(s, d):
    return M.first_by(table(s, d, "routes").where("route_color is not null"), "route_color", "loaded_at", "route_id").select("route_color", "route_id")


@R.add("agg30_grouped_lists", "with g as (select feed_id, route_long_name nm, min(route_id) f, string_agg(distinct route_id, ',' order by route_id) ids from routes where trim(route_long_name, ' ') <> '' group by 1, 2) select feed_id, nm, ids, 'R' || lpad(cast(row_number() over (partition by feed_id order by f) as varchar), 4, '0') new_id from g")
def agg30(s, d):
    g = table(s, d, "routes").where("trim(route_long_name) <> ''").groupBy("feed_id", F.col("route_long_name").alias("nm")).agg(F.min("route_id").alias("f"), F.array_join(F.array_sort(F.collect_set("route_id")), ",").alias("ids"))
    return g.select("feed_id", "nm", "ids", F.format_string("R%04d", F.row_number().over(W.partitionBy("feed_id").orderBy("f"))).alias("new_id"))


@R.add("agg31_uniform_or_not", "select o_custkey, count(distinct o_orderpriority) kinds, min(o_totalprice) lo, max(o_totalprice) hi from orders group by 1 having count(distinct o_orderpriority) > 1")
def agg31(s, d):
    g = table(s, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("kinds"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return g.where("kinds > 1")


@R.add("set01_names_both_ways", "select nm, 'both' side from (select stop_name nm from stops intersect select ref_name from stop_reference) union all select nm, 'only_stops' from (select stop_name nm from stops where stop_name is not null except select ref_name from stop_reference) union all select nm, 'only_reference' from (select ref_name nm from stop_reference except select stop_name from stops)")
def set01(s, d):
    a = table(s, d, "stops").select(F.col("stop_name").alias("nm")).where("nm is not null")
    b = table(s, d, "stop_reference").select(F.col("ref_name").alias("nm"))
    tag = lambda x, t: x.withColumn("side", F.lit(t))
    return tag(a.intersect(b), "both").unionAll(tag(a.subtract(b), "only_stops")).unionAll(tag(b.subtract(a), "only_reference"))


@R.add("set02_pairs_in_both", "select stop_id, arrival_time from stop_times intersect select stop_id, arrival_time from stop_times_copy")
def set02(s, d):
    return table(s, d, "stop_times").select("stop_id", "arrival_time").intersect(table(s, d, "stop_times_copy").select("stop_id", "arrival_time"))


@R.add("set03_key_union", "select coalesce(a.k, b.k) k, coalesce(n, 0) n, coalesce(m, 0) m from (select trip_id k, count(*) n from trips where trip_id is not null group by 1) a full join (select trip_id k, count(*) m from stop_times where trip_id is not null group by 1) b on a.k = b.k")
def set03(s, d):
    n = lambda t, c: table(s, d, t).where("trip_id is not null").groupBy(F.col("trip_id").alias("k")).agg(F.count(F.lit(1)).alias(c))
    return n("trips", "n").join(n("stop_times", "m"), "k", "full").select("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


@R.add("set05_append_new", "with e as (select distinct service_id, exception_date, exception_type from calendar_dates), n as (select distinct service_id, '20260503' exception_date, 2 exception_type from calendar) select *, 'kept' origin from e union all select *, 'added' from (select * from n except select * from e)")
def set05(s, d):
    e = table(s, d, "calendar_dates").select("service_id", "exception_date", "exception_type").distinct()
    n = table(s, d, "calendar").select("service_id", F.lit("20260503").alias("exception_date"), F.lit(2).alias("exception_type")).distinct()
    return e.withColumn("origin", F.lit("kept")).unionAll(n.join(e, e.columns, "left_anti").withColumn("origin", F.lit("added")))


@R.add("set06_union_reindexed", "with f as (select feed_id, count(*) n from routes group by 1), o as (select feed_id, cast(coalesce(sum(n) over (order by feed_id rows between unbounded preceding and 1 preceding), 0) as bigint) off from f) select route_id, off + row_number() over (partition by r.feed_id order by route_id) - 1 idx from routes r join o using (feed_id)")
def set06(s, d):
    r = table(s, d, "routes")
    f = r.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"))
    o = f.withColumn("off", F.coalesce(F.sum("n").over(W.orderBy("feed_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return r.join(o, "feed_id").select("route_id", (F.col("off") + F.row_number().over(W.partitionBy("feed_id").orderBy("route_id")) - 1).alias("idx"))


@R.add("set07_first_non_empty", "select feed_id, arg_min(agency_phone, agency_id) filter (where agency_phone <> '') phone from agency group by 1")
def set07(s, d):
    return table(s, d, "agency").groupBy("feed_id").agg(F.min_by("agency_phone", F.when(F.coalesce("agency_phone", F.lit("")) != "", F.col("agency_id"))).alias("phone"))


@R.add("set08_symmetric", f"with p as (select distinct o_custkey a, o_orderkey b from orders) select a, b from p union select b, a from p")
def set08(s, d):
    p = table(s, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")).distinct()
    swap = p.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return p.unionAll(swap.join(p, ["a", "b"], "left_anti"))


@R.add("set09_jaccard_groups")
def set09(s, d):
    v = visits(s, d).where("stop_id is not null").withColumn("route", F.regexp_extract("trip_id", "^(.*)_[0-9]+$", 1))
    return M.jaccard_groups(v.select("feed_id", "route", "stop_id"), "feed_id", "route", "stop_id")


@R.add("set10_upsert", "with u as (select route_id k, case when route_type = 3 then upper(route_short_name) end v from routes_copy where route_short_name is not null) select coalesce(r.route_id, u.k) k, coalesce(u.v, r.route_short_name) v from routes r full join u on u.k = r.route_id where coalesce(u.v, r.route_short_name) is not null")
def set10(s, d):
    u = table(s, d, "routes_copy").where("route_short_name is not null").select(F.col("route_id").alias("k"), F.when(F.col("route_type") == 3, F.upper("route_short_name")).alias("v"))
    r = table(s, d, "routes").select(F.col("route_id").alias("k"), F.col("route_short_name").alias("old"))
    return r.join(u, "k", "full").select("k", F.coalesce("v", "old").alias("v")).where("v is not null")


@R.add("set11_translation_targets", "select 'stops' t, stop_name v from stops where stop_name <> '' union select 'routes', route_long_name from routes where route_long_name <> '' union select 'agency', agency_name from agency where agency_name <> '' union select 'trips', trip_headsign from trips where trip_headsign <> ''")
def set11(s, d):
    one = lambda t, c: table(s, d, t).select(F.lit(t).alias("t"), F.col(c).alias("v")).where("v <> ''")
    return one("stops", "stop_name").unionAll(one("routes", "route_long_name")).unionAll(one("agency", "agency_name")).unionAll(one("trips", "trip_headsign")).distinct()


@R.add("ord02_natural_order", f"select route_id, row_number() over (partition by feed_id order by length({_RK}), {_RK}, route_id) pos from routes")
def ord02(s, d):
    return _routes(s, d).select("route_id", F.row_number().over(W.partitionBy("feed_id").orderBy(F.length("k"), "k", "route_id")).alias("pos"))


@R.add("ord04_worst_ten", f'with {_COORD} select "name", round(metres, 1) metres from dist order by metres desc, "name" limit 10')
def ord04(s, d):
    return _coords(s, d).orderBy(F.desc("metres"), "name").limit(10).select("name", F.round("metres", 1).alias("metres"))


@R.add("ord05_argmax", "select feed_id, arg_max(stop_id, (n, stop_id)) stop_id from (select feed_id, stop_id, count(*) n from stop_times where stop_id is not null group by 1, 2) group by 1")
def ord05(s, d):
    n = table(s, d, "stop_times").where("stop_id is not null").groupBy("feed_id", "stop_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("feed_id").agg(F.max_by("stop_id", F.struct("n", "stop_id")).alias("stop_id"))


@R.add("ord09_sort_with_default", "select trip_id, row_id, row_number() over (partition by feed_id order by coalesce(try_cast(regexp_extract(trip_id, '([0-9]+)$', 1) as int), 99999), coalesce(direction_id, 9), trip_id, row_id) pos from trips where trip_id is not null")
def ord09(s, d):
    k = F.coalesce(F.regexp_extract("trip_id", "([0-9]+)$", 1).try_cast("int"), F.lit(99999))
    w = W.partitionBy("feed_id").orderBy(k, F.coalesce("direction_id", F.lit(9)), "trip_id", "row_id")
    return table(s, d, "trips").where("trip_id is not null").select("trip_id", "row_id", F.row_number().over(w).alias("pos"))


QUERIES, SQL = R.queries, R.sql

