"""Remaining operators: defaults, predicates, neighbours, orderings and document grids."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from ..functions import clock, geo, text
from ..operators import matching as M
from ..operators import sequence as S
from ..runtime import table
from ..sources import documents, feeds
from .base import PLACES, VISITS, Registry, normal, places, visits
from .join_queries import _COORD, _coords
from .sequence_queries import _ANOM, _INTER, _SEG, _VERDICT

R = Registry()


@R.add("src01_text_scan", "select cast(stop_id as varchar) stop_id, cast(stop_name as varchar) stop_name, cast(zone_id as varchar) zone_id from stops")
def src01(s, d):
    return table(s, d, "stops").select(*[F.col(c).cast("string").alias(c) for c in ("stop_id", "stop_name", "zone_id")])


@R.add("src06_column_rewrite", "select row_id, case trip_headsign when '中央共同ターミナル' then '中央ターミナル' else trip_headsign end trip_headsign from trips")
def src06(s, d):
    m = F.create_map(F.lit("中央共同ターミナル"), F.lit("中央ターミナル"))
    return table(s, d, "trips").select("row_id", F.coalesce(F.try_element_at(m, F.col("trip_headsign")), "trip_headsign").alias("trip_headsign"))


@R.add("src20_grid_cells", "select doc_id, count(*) n from (select doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) line from documents where contains(text, ',')) where regexp_matches(line, '^[^,]+(,[0-9]{1,2}:[0-9]{2}){2,}(, *)*$') group by 1")
def src20(s, d):
    g = feeds.grid(table(s, d, "documents").where(F.col("text").contains(",")), "doc_id", "text")
    rows = g.groupBy("doc_id", "row").agg(F.count_if(documents.is_time(F.col("value")) & (F.col("value") == F.trim("value"))).alias("t"), F.max("col").alias("c"), F.count(F.lit(1)).alias("k"), F.count_if((F.col("col") == 0)).alias("first"))
    return rows.where("t >= 2 and t = c and k = c + 1 and first = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@R.add("dom23_grid_timetables")
def dom23(s, d):
    """Stops x trips grids in documents, as visits."""
    g = feeds.grid(table(s, d, "documents").where(F.col("text").contains(",")), "doc_id", "text")
    return documents.grid_to_cells(g.join(documents.timetable_grids(g, "doc_id"), "doc_id", "left_semi"), "doc_id")


@R.add("dom24_html_timetables")
def dom24(s, d):
    """HTML timetables in documents, as visits."""
    c = feeds.html_cells(table(s, d, "documents"), "doc_id", "text").where("trim(value) <> ''")
    return documents.grid_to_cells(c.select("doc_id", "row", "col", "value"), "doc_id")


def _words(s, d):
    """Lines of documents laid out as words with positions, as a page reader gives them."""
    l = table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return l.select("doc_id", "i", F.posexplode(F.split("line", "[ \t,|]+")).alias("j", "text")).where("text <> ''").select("doc_id", "text", (F.col("j") * 40.0).alias("x0"), (F.col("i") * 12.0).alias("top"))


@R.add("dom21_page_grids")
def dom21(s, d):
    return documents.words_to_grid(_words(s, d).where(F.col("text").rlike("[0-9]:[0-9]")), "doc_id")


@R.add("win17_column_clusters", "with w as (select doc_id, i, j, regexp_split_to_array(line, '[ \\t,|]+')[j] v from (select doc_id, i, string_split(text, chr(10))[i] line from documents, unnest(generate_series(1, len(string_split(text, chr(10))))) u(i)), unnest(generate_series(1, len(regexp_split_to_array(line, '[ \\t,|]+')))) k(j)), t as (select doc_id, (j - 1) * 40.0 x0 from w where regexp_matches(trim(v, ' '), '^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$')) select doc_id, cast(x0 as double) x, count(*) n from t group by 1, 2")
def win17(s, d):
    return documents.columns_of(_words(s, d), "doc_id").select("doc_id", "x", "n")


@R.add("val06_token_shortfall")
def val06(s, d):
    w = _words(s, d)
    return documents.uncovered_columns(w, "doc_id", documents.words_to_grid(w, "doc_id"))


@R.add("src32_review_grid", "select stop_name, count(distinct stop_id) poles, min(stop_id) first_pole from stops where stop_name is not null group by 1 having count(distinct stop_id) > 1")
def src32(s, d):
    return table(s, d, "stops").where("stop_name is not null").groupBy("stop_name").agg(F.countDistinct("stop_id").alias("poles"), F.min("stop_id").alias("first_pole")).where("poles > 1")


@R.add("src33_review_merge", "select coalesce(a.row_id, b.row_id) row_id, coalesce(b.arrival_time, a.arrival_time) \"value\", a.row_id is null added from stop_times a full join stop_times_copy b on a.row_id = b.row_id where b.arrival_time is distinct from a.arrival_time")
def src33(s, d):
    b = table(s, d, "stop_times_copy").select("row_id", F.col("arrival_time").alias("new"), F.lit(True).alias("y"))
    a = table(s, d, "stop_times").select("row_id", F.col("arrival_time").alias("old"), F.lit(True).alias("x"))
    return a.join(b, "row_id", "full").where(~F.col("new").eqNullSafe(F.col("old"))).select("row_id", F.coalesce("new", "old").alias("value"), F.col("x").isNull().alias("added"))


@R.add("prj11_rules_projection", "select coalesce(route_id, '') route_id, coalesce(route_color, '') origin_id, '' contains_id from routes")
def prj11(s, d):
    return table(s, d, "routes").select(F.coalesce("route_id", F.lit("")).alias("route_id"), F.coalesce("route_color", F.lit("")).alias("origin_id"), F.lit("").alias("contains_id"))


@R.add("prj14_answers", "select agency_id, case when agency_lang = 'en' then 'office' else coalesce(agency_phone, '') end agency_phone from agency")
def prj14(s, d):
    """Answers laid over a table; blank answers, and answers to unknown fields, change nothing."""
    a = s.createDataFrame([("en", "agency_phone", "office"), ("ja", "agency_phone", ""), ("ja", "nothing", "x")], "agency_lang string, field string, answer string").where("field = 'agency_phone' and answer <> ''").drop("field")
    return table(s, d, "agency").join(F.broadcast(a), "agency_lang", "left").select("agency_id", F.coalesce("answer", "agency_phone", F.lit("")).alias("agency_phone"))


@R.add("prj16_confidence_reasons", f"with {PLACES} select stop_id, case when lat is null then 'empty' when stop_id like '%\\_1' escape '\\' then 'sure' else 'review' end confidence, case when lat is null then 'no coordinate' when stop_id like '%\\_1' escape '\\' then 'first pole' else 'other pole' end reason from places")
def prj16(s, d):
    first = F.endswith("stop_id", F.lit("_1"))
    return places(s, d).select("stop_id", F.when(F.col("lat").isNull(), "empty").when(first, "sure").otherwise("review").alias("confidence"), F.when(F.col("lat").isNull(), "no coordinate").when(first, "first pole").otherwise("other pole").alias("reason"))


@R.add("prj17_speed_ladder", f"with {_SEG} select trip_id, seq, {_VERDICT} verdict from seg where {_VERDICT} <> ''")
def prj17(s, d):
    return S.segments(visits(s, d)).select("trip_id", "seq", S.speed_verdict(F.col("metres"), F.col("secs")).alias("verdict")).where("verdict <> ''")


@R.add("prj19_coordinate_verdict", "select stop_id, max(case when stop_lat is null or stop_lon is null then 'none' when not (stop_lat between 31 and 33 and stop_lon between 130 and 132) then 'outside' else 'ok' end) verdict from stops group by 1")
def prj19(s, d):
    la, lo = F.col("stop_lat"), F.col("stop_lon")
    return table(s, d, "stops").groupBy("stop_id").agg(F.max(F.when(la.isNull() | lo.isNull(), "none").when(~geo.in_box(la, lo, 31.0, 33.0, 130.0, 132.0), "outside").otherwise("ok")).alias("verdict"))


@R.add("flt03_country_range", "select distinct stop_id from stops where stop_lat between 24 and 46 and stop_lon between 122 and 154")
def flt03(s, d):
    return table(s, d, "stops").where(geo.in_box(F.col("stop_lat"), F.col("stop_lon"), 24.0, 46.0, 122.0, 154.0)).select("stop_id").distinct()


@R.add("flt05_empty_coordinates", "select distinct stop_id from stops where stop_lat is null or stop_lat = 0")
def flt05(s, d):
    return table(s, d, "stops").where("stop_lat is null or stop_lat = 0").select("stop_id").distinct()


@R.add("flt06_excluded_cells", "select row_id from stop_times where not (coalesce(pickup_type, 0) = 2) and stop_sequence is not null")
def flt06(s, d):
    return table(s, d, "stop_times").where(~(F.coalesce("pickup_type", F.lit(0)) == 2) & F.col("stop_sequence").isNotNull()).select("row_id")


@R.add("flt15_admin_names", "select agency_id from agency where len(list_filter([agency_name, agency_url, agency_timezone], lambda x: contains(coalesce(x, ''), '市') or contains(coalesce(x, ''), 'Town'))) > 0")
def flt15(s, d):
    return table(s, d, "agency").where(F.exists(F.array("agency_name", "agency_url", "agency_timezone"), lambda x: F.coalesce(x.contains("市") | x.contains("Town"), F.lit(False)))).select("agency_id")


@R.add("flt16_denied_kinds", "select distinct stop_name from stops s where stop_name is not null and not exists (select 1 from (values ('駅'), ('Station'), ('車庫')) v(w) where contains(s.stop_name, v.w))")
def flt16(s, d):
    deny = F.broadcast(s.createDataFrame([("駅",), ("Station",), ("車庫",)], "w string"))
    return table(s, d, "stops").select("stop_name").where("stop_name is not null").distinct().join(deny, F.expr("contains(stop_name, w)"), "left_anti")


@R.add("flt17_stem_contained", "select distinct stop_id from stops where contains(stop_name, regexp_extract(zone_id, '[0-9]+'))")
def flt17(s, d):
    return table(s, d, "stops").where(F.contains("stop_name", F.regexp_extract("zone_id", "[0-9]+", 0))).select("stop_id").distinct()


@R.add("jn07_cells_by_name", f"""with {PLACES}, n as (select "name", max(stop_id) stop_id from places where "name" <> '' group by 1) select t.row_id, n.stop_id from trips t left join n on n."name" = t.trip_headsign""")
def jn07(s, d):
    n = places(s, d).where("name <> ''").groupBy("name").agg(F.max("stop_id").alias("stop_id"))
    return table(s, d, "trips").join(n, F.col("trip_headsign") == F.col("name"), "left").select("row_id", "stop_id")


@R.add("jn12_verify_extract", f"with {VISITS} select a.trip_id, a.seq, a.a time_a, c.arrival_time time_b from visits a join stop_times_copy c on c.trip_id = a.trip_id and c.stop_sequence = a.seq where a.a <> {normal('c.arrival_time')}")
def jn12(s, d):
    c = table(s, d, "stop_times_copy").select("trip_id", F.col("stop_sequence").alias("seq"), F.col("arrival_time").alias("time_b"))
    return visits(s, d).join(c, ["trip_id", "seq"]).where(F.col("a") != clock.normal(F.col("time_b"))).select("trip_id", "seq", F.col("a").alias("time_a"), "time_b")


@R.add("jn15_close_matches")
def jn15(s, d):
    n = table(s, d, "stops").select(F.col("stop_name").alias("name"))
    r = table(s, d, "stop_reference").select(F.col("ref_name").alias("cand"))
    c = M.close_by_grams(n, r, 0.85).withColumn("score", M.ratio("name", "cand")).where("score >= 0.85")
    return c.withColumn("rn", F.row_number().over(W.partitionBy("name").orderBy(F.desc("score"), "cand"))).where("rn <= 5").drop("rn")


@R.add("jn19_known_neighbours", f"with {_INTER} select trip_id, seq, ka is not null before, kb is not null after from n where lat is null")
def jn19(s, d):
    w = W.partitionBy("trip_id").orderBy("seq")
    known = F.when(F.col("lat").isNotNull(), F.col("seq"))
    v = visits(s, d).withColumn("a", F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("b", F.first(known, True).over(w.rowsBetween(1, W.unboundedFollowing)))
    return v.where("lat is null").select("trip_id", "seq", F.col("a").isNotNull().alias("before"), F.col("b").isNotNull().alias("after"))


@R.add("jn21_nearest_edge", f"""with {PLACES}, e as (select district_id, feed_id, i, ring_lat[i] y1, ring_lon[i] x1, ring_lat[i % len(ring_lat) + 1] y2, ring_lon[i % len(ring_lon) + 1] x2 from districts, unnest(generate_series(1, len(ring_lat))) u(i)),
g as (select stop_id, district_id, i, (x1 - lon) * 111320.0 * cos(radians(lat)) ax, (y1 - lat) * 110540.0 ay, (x2 - lon) * 111320.0 * cos(radians(lat)) bx, (y2 - lat) * 110540.0 b2 from places join e using (feed_id) where lat is not null),
t as (select *, case when pow(bx - ax, 2) + pow(b2 - ay, 2) = 0 then 0 else greatest(0, least(1, (-ax * (bx - ax) - ay * (b2 - ay)) / (pow(bx - ax, 2) + pow(b2 - ay, 2)))) end t from g) select stop_id, district_id, round(min(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (b2 - ay), 2))), 0) metres from t group by 1, 2""")
def jn21(s, d):
    t = table(s, d, "districts")
    nxt = lambda c: F.transform(c, lambda x, i: F.get(c, (i + 1) % F.size(c)))
    e = t.select("feed_id", "district_id", F.explode(F.arrays_zip(F.col("ring_lat").alias("y1"), F.col("ring_lon").alias("x1"), nxt("ring_lat").alias("y2"), nxt("ring_lon").alias("x2"))).alias("e")).select("feed_id", "district_id", "e.*")
    j = places(s, d).where("lat is not null").join(e, "feed_id")
    xy = lambda a, o: geo.planar(F.col(a), F.col(o), F.col("lat"), F.col("lon"))
    (ax, ay), (bx, by), z = xy("y1", "x1"), xy("y2", "x2"), F.lit(0.0)
    return j.groupBy("stop_id", "district_id").agg(F.round(F.min(geo.segment(z, z, ax, ay, bx, by)), 0).alias("metres"))


@R.add("jn23_nearest_heading", "with h as (select feed_id, min(stop_sequence) lo, max(stop_sequence) hi from stop_times where stop_sequence is not null group by 1) select row_id, case when abs(stop_sequence - lo) <= abs(stop_sequence - hi) then 'first' else 'last' end heading from stop_times join h using (feed_id) where stop_sequence is not null")
def jn23(s, d):
    t = table(s, d, "stop_times").where("stop_sequence is not null")
    h = t.groupBy("feed_id").agg(F.min("stop_sequence").alias("lo"), F.max("stop_sequence").alias("hi"))
    return t.join(F.broadcast(h) if h.limit(50_001).count() <= 50_000 else h, "feed_id").select("row_id", F.when(F.abs(F.col("stop_sequence") - F.col("lo")) <= F.abs(F.col("stop_sequence") - F.col("hi")), "first").otherwise("last").alias("heading"))


@R.add("agg06_upper_median", "select feed_id, list(stop_sequence order by stop_sequence)[len(list(stop_sequence)) // 2 + 1] upper_median from stop_times where stop_sequence is not null group by 1")
def agg06(s, d):
    """Counts by value first, so that a group never stands in one task."""
    c = table(s, d, "stop_times").where("stop_sequence is not null").groupBy("feed_id", "stop_sequence").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("feed_id").orderBy("stop_sequence").rowsBetween(W.unboundedPreceding, 0)
    c = c.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.partitionBy("feed_id")))
    return c.where("upto > floor(all / 2)").groupBy("feed_id").agg(F.min("stop_sequence").alias("upper_median"))


@R.add("agg07_nearest_rank", "select feed_id, list(stop_sequence order by stop_sequence)[cast(round_even(0.9 * (len(list(stop_sequence)) - 1), 0) as int) + 1] p90 from stop_times where stop_sequence is not null group by 1")
def agg07(s, d):
    c = table(s, d, "stop_times").where("stop_sequence is not null").groupBy("feed_id", "stop_sequence").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("feed_id").orderBy("stop_sequence").rowsBetween(W.unboundedPreceding, 0)
    c = c.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(W.partitionBy("feed_id")))
    return c.where(F.col("upto") > F.bround(F.lit(0.9) * (F.col("all") - 1))).groupBy("feed_id").agg(F.min("stop_sequence").alias("p90"))


@R.add("agg08_distance_rates", f"with {_COORD} select round(avg(metres), 1) mean, round(max(metres), 1) top, count(*) filter (where metres <= 50) within_50, round(count(*) filter (where metres <= 50) * 100.0 / greatest(count(*), 1), 4) rate from dist")
def agg08(s, d):
    n = F.count_if(F.col("metres") <= 50)
    return _coords(s, d).agg(F.round(F.avg("metres"), 1).alias("mean"), F.round(F.max("metres"), 1).alias("top"), n.alias("within_50"), F.round(n * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("rate"))


@R.add("agg23_codes_not_totals", "select event_type, count(distinct user_id) codes from events group by 1")
def agg23(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("codes"))


@R.add("win04_tolerant_collapse")
def win04(s, d):
    """Consecutive positions within 1e-3 degrees of the last one kept are dropped (a fold, as the last kept matters)."""
    v = visits(s, d).where("lat is not null").groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("x"))
    near = lambda a, b: (F.abs(a["lat"] - b["lat"]) <= 1e-3) & (F.abs(a["lon"] - b["lon"]) <= 1e-3)
    kept = F.aggregate("x", F.slice("x", 1, 1), lambda acc, p: F.when(near(F.element_at(acc, -1), p), acc).otherwise(F.concat(acc, F.array(p))))
    return v.select("trip_id", F.posexplode(kept).alias("pos", "p")).select("trip_id", "pos", "p.lat", "p.lon")


@R.add("win10_expected_times", f"with {_ANOM} select trip_id, seq, round(e1, 4) e1, round(e2, 4) e2, ok from f where e1 is not null or e2 is not null")
def win10(s, d):
    v = visits(s, d).select(F.regexp_extract("trip_id", "^(.*)_[0-9]+$", 1).alias("grp"), "trip_id", "seq", "stop_id", (F.col("arr") / 60).alias("m"))
    w = W.partitionBy("grp", "trip_id").orderBy("seq")
    c = v.withColumn("pn", F.lag("stop_id").over(w)).withColumn("pm", F.lag("m").over(w)).withColumn("nn", F.lead("stop_id").over(w)).withColumn("nm", F.lead("m").over(w))
    med = c.where("pn is not null").groupBy("grp", F.col("pn").alias("x"), F.col("stop_id").alias("y")).agg(F.median(F.col("m") - F.col("pm")).alias("med"), F.count(F.col("m") - F.col("pm")).alias("k")).where("k >= 2").drop("k")
    j = c.join(med.select("grp", F.col("x").alias("pn"), F.col("y").alias("stop_id"), F.col("med").alias("mb")), ["grp", "pn", "stop_id"], "left").join(med.select("grp", F.col("x").alias("stop_id"), F.col("y").alias("nn"), F.col("med").alias("ma")), ["grp", "stop_id", "nn"], "left")
    e1, e2 = F.col("pm") + F.col("mb"), F.col("nm") - F.col("ma")
    return j.select("trip_id", "seq", F.round(e1, 4).alias("e1"), F.round(e2, 4).alias("e2"), F.coalesce(F.abs(e1 - e2) <= 3, F.lit(False)).alias("ok")).where("e1 is not null or e2 is not null")


@R.add("win12_masked_interpolation", f"""with {VISITS}, k0 as (select *, lat is not null and not ends_with(stop_id, '_2') kn, row_number() over (partition by trip_id order by seq) k from visits where stop_id is not null),
n as (select *, last_value(case when kn then k end ignore nulls) over b ka, last_value(case when kn then lat end ignore nulls) over b la, first_value(case when kn then k end ignore nulls) over f kb, first_value(case when kn then lat end ignore nulls) over f lb from k0
 window b as (partition by trip_id order by seq rows between unbounded preceding and 1 preceding), f as (partition by trip_id order by seq rows between 1 following and unbounded following))
select trip_id, seq, round(la + (lb - la) * (k - ka) / (kb - ka), 6) ilat from n where not kn and ka is not null and kb is not null""")
def win12(s, d):
    """Interpolation whose anchors leave out second poles."""
    i = S.interpolate(visits(s, d).where("stop_id is not null"), anchor=~F.endswith("stop_id", F.lit("_2")))
    return i.where("ilat is not null").select("trip_id", "seq", F.round("ilat", 6).alias("ilat"))


@R.add("win15_order_inversions", f"with {VISITS}, x as (select trip_id, seq, lat, lag(lat) over (partition by trip_id order by seq) p from visits where lat is not null) select trip_id, seq from x where lat < p - 0.01")
def win15(s, d):
    w = W.partitionBy("trip_id").orderBy("seq")
    return visits(s, d).where("lat is not null").withColumn("p", F.lag("lat").over(w)).where(F.col("lat") < F.col("p") - 0.01).select("trip_id", "seq")


@R.add("win18_contiguous_blocks", f"with {VISITS}, x as (select trip_id, seq, case when seq - lag(seq) over w > 1 then 1 else 0 end nw from visits window w as (partition by trip_id order by seq)), y as (select *, cast(sum(nw) over (partition by trip_id order by seq rows unbounded preceding) as bigint) block from x) select trip_id, block, min(seq) lo, max(seq) hi from y group by 1, 2")
def win18(s, d):
    v = S.islands(visits(s, d).select("trip_id", "seq", F.col("seq").alias("v")), "trip_id", "seq", "v", 1, "block")
    return v.groupBy("trip_id", "block").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))


@R.add("win19_ranked_pairing", "select row_id, row_number() over (partition by route_id, direction_id order by trip_id, row_id) k from trips")
def win19(s, d):
    return table(s, d, "trips").select("row_id", F.row_number().over(W.partitionBy("route_id", "direction_id").orderBy("trip_id", "row_id")).alias("k"))


@R.add("ord01_multi_key", f"with {VISITS} select trip_id, seq, row_number() over (partition by feed_id order by trip_id, seq) pos from visits")
def ord01(s, d):
    return visits(s, d).select("trip_id", "seq", F.row_number().over(W.partitionBy("feed_id").orderBy("trip_id", "seq")).alias("pos"))


@R.add("ord03_severity_rank", "select event_type, count(*) n, list_position(['view', 'click', 'cart', 'purchase', 'error'], event_type) rnk from events group by 1")
def ord03(s, d):
    g = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rnk", F.nullif(F.array_position(F.array(*map(F.lit, ("view", "click", "cart", "purchase", "error"))), F.col("event_type")), F.lit(0)))


@R.add("ord07_choice_by_class", "select point_name, arg_min(survey_id, (case when point_reading is not null then 0 when operator_name is not null then 1 else 2 end, survey_id)) survey_id from stop_survey where point_name is not null group by 1")
def ord07(s, d):
    t = table(s, d, "stop_survey").where("point_name is not null")
    k = F.when(F.col("point_reading").isNotNull(), 0).when(F.col("operator_name").isNotNull(), 1).otherwise(2)
    return t.groupBy("point_name").agg(F.min_by("survey_id", F.struct(k, "survey_id")).alias("survey_id"))


@R.add("ord08_detail_limit", "select stop_id, count(*) n from stop_times where stop_id is not null group by 1 order by n desc, stop_id limit 50")
def ord08(s, d):
    return table(s, d, "stop_times").where("stop_id is not null").groupBy("stop_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "stop_id").limit(50)


@R.add("ord10_sorted_exceptions", "select service_id, exception_date, row_number() over (partition by feed_id order by service_id, exception_date, exception_type) pos from calendar_dates")
def ord10(s, d):
    return table(s, d, "calendar_dates").select("service_id", "exception_date", F.row_number().over(W.partitionBy("feed_id").orderBy("service_id", "exception_date", "exception_type")).alias("pos"))


def _normal(form: str, *, strip_marks: bool = False, blanks: bool = True):
    import unicodedata

    @pandas_udf(StringType())
    def f(x):
        def one(v):
            if v is None:
                return None
            t = unicodedata.normalize(form, v)
            if strip_marks:
                t = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
            return " ".join(t.split()) if blanks else "".join(t.split())

        return x.map(one)

    return f


@R.add("str02_variant_names")
def str02(s, d):
    n = _normal("NFKC")("stop_name")
    return table(s, d, "stops").select("stop_name").distinct().select("stop_name", F.translate(n, "ヶヵ澤濱瀧峯嶋櫻鐵關鹽檜", "ケカ沢浜滝峰島桜鉄関塩桧").alias("n"))


@R.add("str03_noise_phrases")
def str03(s, d):
    n = F.regexp_replace(_normal("NFKC")("stop_name"), r"\(?バス停\)?|停留所|のりば|\[コミバス\]|※", "")
    return table(s, d, "stops").select("stop_name").distinct().select("stop_name", F.trim(n).alias("n"))


_RADICAL = "replace(" * (len(text.RADICALS) // 2) + "nfkc" + "".join(f", '{a}', '{b}')" for a, b in zip(text.RADICALS[::2], text.RADICALS[1::2], strict=True))


@R.add("str04_radicals", f"select distinct ref_name, {_RADICAL.replace('nfkc', 'ref_name')} n from stop_reference")
def str04(s, d):
    """Radicals repaired in the clean names, which are in compatibility form."""
    return table(s, d, "stop_reference").select("ref_name", text.radicals(F.col("ref_name")).alias("n")).distinct()


@R.add("str10_readings")
def str10(s, d):
    """Readings of all stop names by the words of the reference list."""
    return M.readings(table(s, d, "stops"), "stop_name", table(s, d, "stop_reference"), "ref_name", "ref_reading")


@R.add("geo12_splice", """with r as (select district_id, list_zip(ring_lat, ring_lon) p, list_min(ring_lat) la, list_min(ring_lon) lo, list_max(ring_lat) lb, list_max(ring_lon) lp from districts),
e as (select *, pow(p[1][1] - la, 2) + pow(p[1][2] - lo, 2) + pow(p[-1][1] - lb, 2) + pow(p[-1][2] - lp, 2) straight, pow(p[-1][1] - la, 2) + pow(p[-1][2] - lo, 2) + pow(p[1][1] - lb, 2) + pow(p[1][2] - lp, 2) turned from r)
select district_id, case when straight > turned then p[-1][1] else p[1][1] end first_lat, case when straight > turned then p[1][2] else p[-1][2] end last_lon from e""")
def geo12(s, d):
    """Rings as open lines, laid from the south-west to the north-east corner of their box."""
    t = table(s, d, "districts")
    at = lambda f: F.struct(f("ring_lat").alias("lat"), f("ring_lon").alias("lon"))
    p = geo.splice(F.zip_with("ring_lat", "ring_lon", lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))), at(F.array_min), at(F.array_max))
    return t.select("district_id", p.alias("p")).select("district_id", F.try_element_at("p", F.lit(1))["lat"].alias("first_lat"), F.try_element_at("p", F.lit(-1))["lon"].alias("last_lon"))


@R.add("str06_no_blanks")
def str06(s, d):
    return table(s, d, "stops").select("stop_name").distinct().select("stop_name", _normal("NFKC", blanks=False)("stop_name").alias("n"))


@R.add("str07_confusion_keys")
def str07(s, d):
    return table(s, d, "stops").select("stop_name").distinct().select("stop_name", F.translate(_normal("NFKC", strip_marks=True)("stop_name"), "ー一―‐−二ニロ口力カ", "-----22oocc").alias("k"))


@R.add("str09_has_kanji", "select ref_id, regexp_matches(ref_name, '[一-鿿]') kanji from stop_reference")
def str09(s, d):
    return table(s, d, "stop_reference").select("ref_id", text.has_kanji(F.col("ref_name")).alias("kanji"))


@R.add("str17_postcodes", "select agency_id, regexp_matches(coalesce(agency_phone, ''), '^[0-9]{3}-?[0-9]{4}$') ok from agency")
def str17(s, d):
    return table(s, d, "agency").select("agency_id", text.zip_code(F.coalesce("agency_phone", F.lit(""))).alias("ok"))


@R.add("geo01_survey_distance", f"with {_COORD} select \"name\", round(metres, 2) metres, round(metres / 1000, 4) km from dist")
def geo01(s, d):
    return _coords(s, d).select("name", F.round("metres", 2).alias("metres"), F.round(F.col("metres") / 1000, 4).alias("km"))


@R.add("geo10_speeds", f"with {_SEG} select trip_id, seq, round(case when secs > 0 then metres / 1000 / (secs / 3600.0) end, 3) kmh from seg where metres is not null")
def geo10(s, d):
    return S.segments(visits(s, d)).where("metres is not null").select("trip_id", "seq", F.round(geo.speed(F.col("metres"), F.col("secs")), 3).alias("kmh"))


@R.add("geo13_similarity")
def geo13(s, d):
    p = table(s, d, "stop_survey").where("point_name is not null and operator_name is not null").select("survey_id", "point_name", "operator_name")
    return p.select("survey_id", M.ratio("point_name", "operator_name").alias("ratio"))


@R.add("geo14_python_rounding")
def geo14(s, d):
    @pandas_udf(DoubleType())
    def py_round(x):
        return x.map(lambda v: None if v is None else round(float(v), 1))

    return _coords(s, d).select("name", py_round("metres").alias("metres"))


@R.add("col08_first_pairs", "select o_custkey a, o_orderpriority b, arg_min(o_totalprice, o_orderkey) price from orders group by 1, 2")
def col08(s, d):
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.min_by("o_totalprice", "o_orderkey").alias("price"))


@R.add("col12_required_keys", "select event_id, json_extract_string(props, '$.missing') is null lacks from events")
def col12(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.missing").isNull().alias("lacks"))


@R.add("dom09_translations")
def dom09(s, d):
    """Readings and English names of every translatable value, the dictionary's first."""
    v = table(s, d, "stops").select(F.lit("stops").alias("table_name"), F.lit("stop_name").alias("field_name"), F.col("stop_name").alias("field_value")).where("field_value <> ''").distinct()
    r = table(s, d, "stop_reference").groupBy(F.col("ref_name").alias("field_value")).agg(F.max("ref_reading").alias("ja_Hrkt"))
    j = v.join(r, "field_value", "left").withColumn("en", F.when(F.col("field_value").rlike("^[ -~]+$"), F.col("field_value")))
    return j.unpivot(["table_name", "field_name", "field_value"], ["ja_Hrkt", "en"], "language", "translation").where("translation <> ''")


@R.add("dom10_holiday_days", "select c.service_id, e.exception_date, e.exception_type from calendar c join calendar_dates e on e.service_id = c.service_id where e.exception_date between c.start_date and c.end_date")
def dom10(s, d):
    e = table(s, d, "calendar_dates").select("service_id", "exception_date", "exception_type")
    return table(s, d, "calendar").join(e, "service_id").where("exception_date between start_date and end_date").select("service_id", "exception_date", "exception_type")


@R.add("set12_edits", "select a.route_id, a.route_long_name old, b.route_long_name new_name from routes a join routes_copy b using (route_id) where a.route_long_name is distinct from b.route_long_name")
def set12(s, d):
    b = table(s, d, "routes_copy").select("route_id", F.col("route_long_name").alias("new_name"))
    return table(s, d, "routes").select("route_id", F.col("route_long_name").alias("old")).join(b, "route_id").where(~F.col("old").eqNullSafe(F.col("new_name")))


@R.add("val02_orphan_counts", "select 'trips' child, count(*) n from trips t where route_id is not null and not exists (select 1 from routes r where r.route_id = t.route_id) union all select 'lineitem', count(*) from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey)")
def val02(s, d):
    a = table(s, d, "trips").where("route_id is not null").join(table(s, d, "routes"), "route_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("trips").alias("child"), "n")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    b = table(s, d, "lineitem").join(o, "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("lineitem").alias("child"), "n")
    return a.unionAll(b)


QUERIES, SQL = R.queries, R.sql
