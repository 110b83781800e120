"""Scalar functions, filters and verdict ladders over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, geo, mining, text
from ..runtime import table
from .base import BLANK, PLACES, VISITS, Registry, normal, places, secs, visits

R = Registry()
_T = "t as (select distinct arrival_time v from stop_times where arrival_time is not null)"


def _times(s, d):
    return table(s, d, "stop_times").select(F.col("arrival_time").alias("v")).where("v is not null").distinct()


@R.add("tim01_normal_time", f"with {_T} select v, {normal('v')} t from t")
def tim01(s, d):
    return _times(s, d).select("v", clock.normal(F.col("v")).alias("t"))


@R.add("tim02_seconds", f"with {_T} select v, {secs('v')} secs from t")
def tim02(s, d):
    return _times(s, d).select("v", clock.seconds(F.col("v")).alias("secs"))


@R.add("tim03_minutes", f"with {_T} select v, ({secs('v')}) // 60 m, lpad(cast(({secs('v')}) // 3600 as varchar), 2, '0') || ':' || lpad(cast((({secs('v')}) // 60) % 60 as varchar), 2, '0') || ':00' back from t")
def tim03(s, d):
    m = clock.minutes(F.col("v"))
    return _times(s, d).select("v", m.alias("m"), clock.from_minutes(m).alias("back"))


@R.add("tim04_cell_time", f"with {_T}, c as (select v, regexp_extract(v, '([0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?)', 1) f from t) select v, case when f <> '' then {normal('f')} end t from c")
def tim04(s, d):
    return _times(s, d).select("v", clock.cell(F.col("v")).alias("t"))


@R.add("tim05_fiscal_end", "select service_id, start_date, coalesce(cast(year(dt) + case when month(dt) >= 4 then 1 else 0 end as varchar) || '0331', '20991231') fiscal_end from (select *, cast(try_strptime(start_date, '%Y%m%d') as date) dt from calendar)")
def tim05(s, d):
    return table(s, d, "calendar").select("service_id", "start_date", clock.fiscal_end(F.col("start_date")).alias("fiscal_end"))


@R.add("tim06_dates", "select service_id, exception_date, strftime(try_strptime(exception_date, '%Y%m%d'), '%Y-%m-%d') dt, strftime(try_strptime(exception_date, '%Y%m%d'), '%Y%m%d') back from calendar_dates")
def tim06(s, d):
    x = clock.day(F.col("exception_date"))
    return table(s, d, "calendar_dates").select("service_id", "exception_date", F.date_format(x, "yyyy-MM-dd").alias("dt"), clock.ymd(x).alias("back"))


_CAL = "c as (select service_id, cast(try_strptime(start_date, '%Y%m%d') as date) a, cast(try_strptime(end_date, '%Y%m%d') as date) b, monday, tuesday, wednesday, thursday, friday, saturday, sunday from calendar), x as (select c.*, cast(u.dt as date) dt from c, unnest(generate_series(a, b, interval 1 day)) u(dt))"


def _days(s, d):
    c = table(s, d, "calendar")
    return c.select(*c.columns, F.explode(clock.days(clock.day(F.col("start_date")), clock.day(F.col("end_date")))).alias("dt"))


@R.add("tim07_date_ranges", f"with {_CAL} select service_id, strftime(dt, '%Y-%m-%d') dt from x")
def tim07(s, d):
    return _days(s, d).select("service_id", F.date_format("dt", "yyyy-MM-dd").alias("dt"))


@R.add("tim08_season_over_new_year", f"with {_CAL} select service_id, strftime(dt, '%Y-%m-%d') dt from x where strftime(dt, '%m-%d') >= '12-29' or strftime(dt, '%m-%d') <= '01-03'")
def tim08(s, d):
    return _days(s, d).where(clock.in_season(F.col("dt"), "12-29", "01-03")).select("service_id", F.date_format("dt", "yyyy-MM-dd").alias("dt"))


@R.add("tim09_era_dates", "with t as (select distinct arrival_time v from stop_times where arrival_time like '%令和%'), n as (select v, translate(v, '０１２３４５６７８９', '0123456789') w from t) select v, try_cast(cast(2018 + cast(regexp_extract(w, '令和([0-9]{1,2})年', 1) as int) as varchar) || '-' || lpad(regexp_extract(w, '年([0-9]{1,2})月', 1), 2, '0') || '-' || lpad(regexp_extract(w, '月([0-9]{1,2})日', 1), 2, '0') as varchar) dt from n")
def tim09(s, d):
    return _times(s, d).where("v like '%令和%'").select("v", F.date_format(clock.era_date(F.col("v")), "yyyy-MM-dd").alias("dt"))


@R.add("tim10_stale_dates", "select route_id, loaded_at < timestamp '2026-06-01' - interval 90 day stale from (select route_id, cast(cast(loaded_at at time zone 'UTC' as date) as timestamp) loaded_at from routes where loaded_at is not null)")
def tim10(s, d):
    return table(s, d, "routes").where("loaded_at is not null").select("route_id", clock.stale(F.to_date("loaded_at"), "2026-06-01", 90).alias("stale"))


@R.add("tim11_closed_periods", "select c.service_id, strftime(u.dt, '%Y%m%d') \"date\", 2 exception_type from calendar c, unnest(generate_series(date '2026-08-13', date '2026-08-16', interval 1 day)) u(dt)")
def tim11(s, d):
    p = F.explode(clock.days(F.lit("2026-08-13").cast("date"), F.lit("2026-08-16").cast("date"))).alias("dt")
    return table(s, d, "calendar").select("service_id", p).select("service_id", clock.ymd(F.col("dt")).alias("date"), F.lit(2).alias("exception_type"))


@R.add("tim12_feed_validity", "select feed_id, min(start_date) feed_start_date, max(end_date) feed_end_date, max(end_date) >= '20261126' valid from calendar group by 1")
def tim12(s, d):
    g = table(s, d, "calendar").groupBy("feed_id").agg(F.min("start_date").alias("feed_start_date"), F.max("end_date").alias("feed_end_date"))
    return g.withColumn("valid", F.col("feed_end_date") >= "20261126")


@R.add("agg20_calendar_bounds", "select min(start_date) first_day, max(end_date) last_day from calendar")
def agg20(s, d):
    return table(s, d, "calendar").agg(F.min("start_date").alias("first_day"), F.max("end_date").alias("last_day"))


_WD = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_RUNS = "case isodow(dt) " + " ".join(f"when {i + 1} then {c}" for i, c in enumerate(_WD)) + " end"
_HOL = "h as (select cast(h as date) h from (values ('2026-04-29'), ('2026-05-03'), ('2026-05-04'), ('2026-05-05'), ('2026-07-20'), ('2026-09-21')) v(h))"
HOLIDAYS = ["2026-04-29", "2026-05-03", "2026-05-04", "2026-05-05", "2026-07-20", "2026-09-21"]


@R.add("jn27_holiday_exceptions", f"with {_CAL}, {_HOL}, m as (select *, {_RUNS} runs, sunday = 0 closed from x join h on h.h = x.dt) select service_id, strftime(dt, '%Y%m%d') \"date\", case when closed then 2 else 1 end exception_type from m where (closed and runs = 1) or (not closed and runs = 0)")
def jn27(s, d):
    """Services that do not run on Sundays close on holidays of their weekdays; the others run on holidays off their weekdays."""
    h = s.createDataFrame([(x,) for x in HOLIDAYS], "h string").select(F.to_date("h").alias("dt"))
    m = _days(s, d).join(F.broadcast(h), "dt").withColumn("runs", F.element_at(F.array(*_WD), F.weekday("dt") + 1)).withColumn("closed", F.col("sunday") == 0)
    out = m.where((F.col("closed") & (F.col("runs") == 1)) | (~F.col("closed") & (F.col("runs") == 0)))
    return out.select("service_id", clock.ymd(F.col("dt")).alias("date"), F.when(F.col("closed"), 2).otherwise(1).alias("exception_type"))


@R.add("jn28_closed_date_product", f"with {_HOL}, p as (select distinct service_id, strftime(h.h, '%Y%m%d') exception_date from calendar, h) select * from p where not exists (select 1 from calendar_dates e where e.service_id = p.service_id and e.exception_date = p.exception_date)")
def jn28(s, d):
    p = table(s, d, "calendar").select("service_id", F.explode(F.array(*[F.lit(x.replace("-", "")) for x in HOLIDAYS])).alias("exception_date")).distinct()
    return p.join(table(s, d, "calendar_dates"), ["service_id", "exception_date"], "left_anti")


@R.add("set04_holiday_union", f"with {_HOL} select strftime(h, '%Y%m%d') dt from h union select exception_date from calendar_dates where exception_date is not null")
def set04(s, d):
    h = s.createDataFrame([(x.replace("-", ""),) for x in HOLIDAYS], "dt string")
    return h.unionAll(table(s, d, "calendar_dates").select(F.col("exception_date").alias("dt")).where("dt is not null")).distinct()


_B = "monday || '' || tuesday || wednesday || thursday || friday || saturday || sunday"


def _bits(s, d):
    return table(s, d, "calendar").withColumn("bits", F.concat(*[F.col(c).cast("string") for c in _WD]))


@R.add("prj20_weekday_labels", f"select service_id, {_B} bits, array_to_string(list_filter([{', '.join(f'case when {c} = 1 then {chr(39)}{c[:3]}{chr(39)} end' for c in _WD)}], lambda x: x is not null), '-') label, 'SVC_' || {_B} new_id, regexp_matches({_B}, '^[01]{{7}}$') ok from calendar")
def prj20(s, d):
    label = F.array_join(F.filter(F.array(*[F.when(F.col(c) == 1, c[:3]) for c in _WD]), lambda x: x.isNotNull()), "-")
    return _bits(s, d).select("service_id", "bits", label.alias("label"), F.concat(F.lit("SVC_"), "bits").alias("new_id"), F.col("bits").rlike("^[01]{7}$").alias("ok"))


@R.add("prj22_not_on_sundays", f"select service_id from calendar where not ends_with({_B}, '1')")
def prj22(s, d):
    return _bits(s, d).where(~F.endswith("bits", F.lit("1"))).select("service_id")


@R.add("prj01_agency_defaults", "select agency_id, coalesce(nullif(agency_url, ''), 'https://unknown.example/') agency_url, coalesce(nullif(agency_lang, ''), 'ja') agency_lang, coalesce(nullif(agency_phone, ''), '') agency_phone from agency")
def prj01(s, d):
    f = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)).alias(c)
    return table(s, d, "agency").select("agency_id", f("agency_url", "https://unknown.example/"), f("agency_lang", "ja"), f("agency_phone", ""))


@R.add("prj02_two_sources", "select coalesce(nullif(r.route_short_name, ''), nullif(c.route_short_name, ''), '') short, r.route_id, r.agency_id from routes r left join routes_copy c on c.route_id = r.route_id")
def prj02(s, d):
    c = table(s, d, "routes_copy").select("route_id", F.col("route_short_name").alias("n2"))
    e = lambda x: F.nullif(F.col(x), F.lit(""))
    return table(s, d, "routes").join(c, "route_id", "left").select(F.coalesce(e("route_short_name"), e("n2"), F.lit("")).alias("short"), "route_id", "agency_id")


@R.add("prj03_numbered_ids", "select agency_id, printf('OFFICE%02d', row_number() over (partition by agency_lang order by agency_id)) office_id from agency")
def prj03(s, d):
    from pyspark.sql import Window as W

    return table(s, d, "agency").select("agency_id", F.format_string("OFFICE%02d", F.row_number().over(W.partitionBy("agency_lang").orderBy("agency_id"))).alias("office_id"))


@R.add("prj04_route_defaults", "select route_id, coalesce(route_type, 3) route_type, coalesce(route_color, '') route_color from routes")
def prj04(s, d):
    return table(s, d, "routes").select("route_id", F.coalesce("route_type", F.lit(3)).alias("route_type"), F.coalesce("route_color", F.lit("")).alias("route_color"))


@R.add("prj05_date_stamp", "select route_id, strftime(loaded_at at time zone 'UTC', '%Y%m%d') route_update_date from routes where loaded_at is not null")
def prj05(s, d):
    return table(s, d, "routes").where("loaded_at is not null").select("route_id", F.date_format("loaded_at", "yyyyMMdd").alias("route_update_date"))


@R.add("prj06_present_columns", "select 'zone_id' col, bool_or(coalesce(zone_id, '') <> '') used from stops union all select 'stop_name', bool_or(coalesce(stop_name, '') <> '') from stops")
def prj06(s, d):
    t = table(s, d, "stops")
    one = t.agg(*[F.bool_or(F.coalesce(F.col(c), F.lit("")) != "").alias(c) for c in ("zone_id", "stop_name")])
    return one.unpivot([], ["zone_id", "stop_name"], "col", "used")


@R.add("prj07_trips_projection", "select row_id, coalesce(block_id, '') block_id, coalesce(shape_id, '') shape_id, coalesce(direction_id, 0) direction_id from trips")
def prj07(s, d):
    return table(s, d, "trips").select("row_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("block_id", ""), ("shape_id", ""), ("direction_id", 0))])


@R.add("prj08_calendar_defaults", "select service_id, coalesce(nullif(start_date, ''), '20250401') start_date, coalesce(nullif(end_date, ''), '20991231') end_date from calendar")
def prj08(s, d):
    f = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)).alias(c)
    return table(s, d, "calendar").select("service_id", f("start_date", "20250401"), f("end_date", "20991231"))


@R.add("prj09_exception_defaults", "select service_id, exception_date, coalesce(exception_type, 2) exception_type from calendar_dates where exception_date is not null order by 1, 2")
def prj09(s, d):
    return table(s, d, "calendar_dates").where("exception_date is not null").select("service_id", "exception_date", F.coalesce("exception_type", F.lit(2)).alias("exception_type"))


@R.add("prj10_owner_mismatch", "select r.route_id, r.agency_id, a.agency_id owner_id from routes r join agency a on a.feed_id = r.feed_id where r.agency_id is distinct from a.agency_id")
def prj10(s, d):
    a = table(s, d, "agency").select("feed_id", F.col("agency_id").alias("owner_id"))
    return table(s, d, "routes").join(a, "feed_id").where(~F.col("agency_id").eqNullSafe(F.col("owner_id"))).select("route_id", "agency_id", "owner_id")


@R.add("prj12_feed_info", "select a.feed_id, max(agency_name) feed_publisher_name, max(coalesce(agency_url, '')) feed_contact_url, min(start_date) feed_start_date, max(end_date) feed_end_date from agency a left join calendar c on c.feed_id = a.feed_id group by 1")
def prj12(s, d):
    c = table(s, d, "calendar").groupBy("feed_id").agg(F.min("start_date").alias("feed_start_date"), F.max("end_date").alias("feed_end_date"))
    a = table(s, d, "agency").groupBy("feed_id").agg(F.max("agency_name").alias("feed_publisher_name"), F.max(F.coalesce("agency_url", F.lit(""))).alias("feed_contact_url"))
    return a.join(c, "feed_id", "left")


@R.add("prj13_overrides", "select agency_id, case when agency_lang = 'en' then 'und' else agency_lang end agency_lang, case when agency_lang = 'en' then '0' else coalesce(agency_phone, '') end agency_phone from agency")
def prj13(s, d):
    """Overrides keyed table.field, pivoted to one row per language and laid over the table."""
    o = s.createDataFrame([("en", "agency.agency_lang", "und"), ("en", "agency.agency_phone", "0"), ("en", "nowhere.x", "y")], "lang string, k string, v string")
    o = o.where(F.split_part("k", F.lit("."), F.lit(1)) == "agency").groupBy("lang").pivot("k", ["agency.agency_lang", "agency.agency_phone"]).agg(F.first("v")).toDF("agency_lang", "new_lang", "new_phone")
    return table(s, d, "agency").join(F.broadcast(o), "agency_lang", "left").select("agency_id", F.coalesce("new_lang", "agency_lang").alias("agency_lang"), F.coalesce("new_phone", "agency_phone", F.lit("")).alias("agency_phone"))


@R.add("prj15_missing_fields", "select agency_id, count(*) filter (where coalesce(v, '') = '') missing from (select agency_id, unnest([agency_name, agency_url, agency_timezone, agency_lang, agency_phone]) v from agency) group by 1")
def prj15(s, d):
    cols = ["agency_name", "agency_url", "agency_timezone", "agency_lang", "agency_phone"]
    u = table(s, d, "agency").unpivot("agency_id", cols, "field", "v")
    return u.groupBy("agency_id").agg(F.count_if(F.coalesce("v", F.lit("")) == "").alias("missing"))


@R.add("prj18_coordinate_status", """with t as (select row_number() over () i, stop_id, coalesce(cast(stop_lat as varchar), '') la, coalesce(cast(stop_lon as varchar), '') lo, stop_lat y, stop_lon x from stops) select stop_id, case when y is null or x is null then 'no_coord' when not (y between 24 and 46 and x between 122 and 154) then 'out_of_country' when not (y between 31.2 and 32.2 and x between 130.1 and 131) then 'out_of_box' else 'ok' end status, count(*) n from t group by 1, 2""")
def prj18(s, d):
    t = table(s, d, "stops").select("stop_id", F.col("stop_lat").cast("string").alias("la"), F.col("stop_lon").cast("string").alias("lo"))
    st = geo.status(F.col("la"), F.col("lo"), (24.0, 46.0, 122.0, 154.0), (31.2, 32.2, 130.1, 131.0))
    return t.select("stop_id", st.alias("status")).groupBy("stop_id", "status").agg(F.count(F.lit(1)).alias("n"))


@R.add("prj21_formatted", "select distinct stop_id, printf('%.6f', stop_lat) la, printf('%.6f', stop_lon) lo from stops where stop_lat is not null and stop_lon is not null")
def prj21(s, d):
    return table(s, d, "stops").where("stop_lat is not null and stop_lon is not null").select("stop_id", F.format_string("%.6f", "stop_lat").alias("la"), F.format_string("%.6f", "stop_lon").alias("lo")).distinct()


@R.add("flt01_in_box", "select distinct stop_id from stops where stop_lat between 31.2 and 32.2 and stop_lon between 130.1 and 131")
def flt01(s, d):
    return table(s, d, "stops").where(geo.in_box(F.col("stop_lat"), F.col("stop_lon"), 31.2, 32.2, 130.1, 131.0)).select("stop_id").distinct()


@R.add("flt02_box_intersection", f"with {PLACES}, b as (select feed_id, min(lat) s, max(lat) n, min(lon) w, max(lon) e from places where lat is not null group by 1) select feed_id, greatest(s, 31.0) s, least(n, 32.0) n, greatest(w, 130.0) w, least(e, 131.0) e from b")
def flt02(s, d):
    b = places(s, d).where("lat is not null").groupBy("feed_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    return b.select("feed_id", F.greatest("s", F.lit(31.0)).alias("s"), F.least("n", F.lit(32.0)).alias("n"), F.greatest("w", F.lit(130.0)).alias("w"), F.least("e", F.lit(131.0)).alias("e"))


@R.add("flt04_has_coordinates", "select stop_id, bool_or(stop_lat is not null and stop_lon is not null) has, bool_and(coalesce(stop_lat, 0) = 0 or coalesce(stop_lon, 0) = 0) empty from stops group by 1")
def flt04(s, d):
    has = F.col("stop_lat").isNotNull() & F.col("stop_lon").isNotNull()
    empty = (F.coalesce("stop_lat", F.lit(0.0)) == 0) | (F.coalesce("stop_lon", F.lit(0.0)) == 0)
    return table(s, d, "stops").groupBy("stop_id").agg(F.bool_or(has).alias("has"), F.bool_and(empty).alias("empty"))


@R.add("flt07_two_or_more", f"with {VISITS} select trip_id, seq from (select *, count(*) over (partition by trip_id) n from visits) where n >= 2")
def flt07(s, d):
    from pyspark.sql import Window as W

    return visits(s, d).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("trip_id"))).where("n >= 2").select("trip_id", "seq")


PASSES = ["||", "↓", "レ", "…", "-", "--:--", "通過", "運休", "降車専用"]


@R.add("flt13_pass_tokens", f"select row_id from stop_times where arrival_time is not null and arrival_time not in ({', '.join(repr(x) for x in PASSES)})")
def flt13(s, d):
    return table(s, d, "stop_times").where(F.col("arrival_time").isNotNull() & ~F.col("arrival_time").isin(PASSES)).select("row_id")


@R.add("flt08_noise_names", "select distinct stop_name from stops where stop_name in ('のりば', 'バス停') or stop_name like '%停留所' or (regexp_matches(stop_name, 'のりば|platform') and stop_name not like '%駅%')")
def flt08(s, d):
    n = F.col("stop_name")
    noisy = n.isin("のりば", "バス停") | n.endswith("停留所") | (n.rlike("のりば|platform") & ~n.contains("駅"))
    return table(s, d, "stops").where(noisy).select("stop_name").distinct()


@R.add("flt09_headings", "select doc_id from documents where not regexp_matches(text, '[0-9]{1,2}:[0-9]{2}') and regexp_matches(text, '[(「][^)」]*(方面|行き)[^)」]*[)」]')")
def flt09(s, d):
    t = F.col("text")
    return table(s, d, "documents").where(~t.rlike("[0-9]{1,2}:[0-9]{2}") & t.rlike("[(「][^)」]*(方面|行き)[^)」]*[)」]")).select("doc_id")


@R.add("flt10_schedule_times", f"with {_T} select v from t where regexp_matches(v, '^[0-9]{{1,2}}:[0-9]{{2}}') and try_cast(split_part(v, ':', 1) as int) >= 4")
def flt10(s, d):
    return _times(s, d).where(F.col("v").rlike("^[0-9]{1,2}:[0-9]{2}") & (F.split_part("v", F.lit(":"), F.lit(1)).try_cast("int") >= 4)).select("v")


@R.add("flt12_timetable_documents", "select doc_id, len(regexp_extract_all(text, '[0-9]{1,2}:[0-9]{2}')) n from documents where len(regexp_extract_all(text, '[0-9]{1,2}:[0-9]{2}')) >= 4 and len(string_split(text, chr(10))) >= 3")
def flt12(s, d):
    t = table(s, d, "documents").withColumn("n", F.size(F.regexp_extract_all("text", F.lit("([0-9]{1,2}:[0-9]{2})"), 1)))
    return t.where("n >= 4").where(F.size(F.split("text", "\n")) >= 3).select("doc_id", "n")


@R.add("src23_pages_with_times", "select source, count(*) pages from documents where len(regexp_extract_all(text, '[0-9]{1,2}:[0-9]{2}')) >= 3 group by 1")
def src23(s, d):
    n = F.size(F.regexp_extract_all("text", F.lit("([0-9]{1,2}:[0-9]{2})"), 1))
    return table(s, d, "documents").where(n >= 3).groupBy("source").agg(F.count(F.lit(1)).alias("pages"))


_DIR = "'上', '中', '下', '東', '西', '南', '北', '新', '旧'"
_FIT = f"""n as (select distinct substr(ref_name, 2) b, ref_name a from stop_reference where left(ref_name, 1) in ({_DIR})), p as (select n.a, r.ref_name b from n join stop_reference r on r.ref_name = n.b or r.ref_name = n.a)"""


@R.add("flt14_direction_compatible", f"with {_FIT}, q as (select *, case when left(a, 1) in ({_DIR}) and length(a) > 1 then left(a, 1) else '' end pa, case when left(b, 1) in ({_DIR}) and length(b) > 1 then left(b, 1) else '' end pb from p), e as (select *, substr(a, length(pa) + 1) ra, substr(b, length(pb) + 1) rb from q) select a, b, case when pa = pb then true when pb = '' then not (ra = b or (length(ra) >= 2 and (starts_with(ra, b) or ends_with(ra, b) or starts_with(b, ra) or ends_with(b, ra)))) when pa = '' then not (rb = a or (length(rb) >= 2 and (starts_with(rb, a) or ends_with(rb, a) or starts_with(a, rb) or ends_with(a, rb)))) else not (ra = rb or (length(ra) >= 2 and length(rb) >= 2 and (contains(ra, rb) or contains(rb, ra)))) end ok from e")
def flt14(s, d):
    r = table(s, d, "stop_reference").select("ref_name")
    n = r.where(F.left("ref_name", F.lit(1)).isin(*"上中下東西南北新旧")).select(F.col("ref_name").alias("a"), F.explode(F.array(F.expr("substr(ref_name, 2)"), "ref_name")).alias("b")).distinct()
    p = n.join(r.select(F.col("ref_name").alias("b")), "b")
    return p.select("a", "b", text.compatible_direction(F.col("a"), F.col("b")).alias("ok"))


@R.add("flt19_suspicious_readings", "select ref_id from stop_reference where ref_reading is null or trim(ref_reading, ' ') = '' or regexp_matches(ref_reading, '[一-鿿｡-ﾟ]')")
def flt19(s, d):
    r = F.col("ref_reading")
    return table(s, d, "stop_reference").where(r.isNull() | (F.trim(r) == "") | r.rlike("[一-鿿｡-ﾟ]")).select("ref_id")


@R.add("flt21_only_empty", f"with {PLACES} select stop_id, case when lat is null then 35.0 else lat end lat, lat is null filled from places")
def flt21(s, d):
    return places(s, d).select("stop_id", F.when(F.col("lat").isNull(), 35.0).otherwise(F.col("lat")).alias("lat"), F.col("lat").isNull().alias("filled"))


@R.add("flt22_drop_off_only", "select trip_id, count(*) n from stop_times where pickup_type = 1 and trip_id is not null group by 1")
def flt22(s, d):
    return table(s, d, "stop_times").where("pickup_type = 1 and trip_id is not null").groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))


@R.add("flt23_invalid_times", "select row_id, arrival_time from stop_times where trim(arrival_time, ' ') <> '' and not regexp_matches(arrival_time, '^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$')")
def flt23(s, d):
    a = F.col("arrival_time")
    return table(s, d, "stop_times").where((F.trim(a) != "") & ~a.rlike("^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$")).select("row_id", "arrival_time")


@R.add("str01_nfkc_names")
def str01(s, d):
    from pyspark.sql.functions import pandas_udf

    from ..functions.text import nfkc

    @pandas_udf("string")
    def f(x):
        return x.map(lambda v: None if v is None else nfkc(v))

    return table(s, d, "stops").select("stop_name").distinct().select("stop_name", text.squeeze(f("stop_name")).alias("normal"))


@R.add("str05_wide_digits", "select distinct stop_name, translate(regexp_replace(stop_name, '^[※■●]+', ''), '０１２３４５６７８９', '0123456789') n from stops where stop_name is not null")
def str05(s, d):
    n = F.translate(F.regexp_replace("stop_name", "^[※■●]+", ""), "０１２３４５６７８９", "0123456789")
    return table(s, d, "stops").where("stop_name is not null").select("stop_name", n.alias("n")).distinct()


_K, _H = text._kana_map()


@R.add("str08_hiragana", f"select distinct stop_name, translate(stop_name, '{_K}', '{_H}') h, regexp_matches(stop_name, '[一-鿿]') kanji from stops where stop_name is not null")
def str08(s, d):
    n = F.col("stop_name")
    return table(s, d, "stops").where("stop_name is not null").select("stop_name", text.hiragana(n).alias("h"), text.has_kanji(n).alias("kanji")).distinct()


@R.add("str11_route_keys", f"select route_id, regexp_extract(route_long_name, '^([0-9]+)[{BLANK}]+', 1) num, regexp_replace(route_long_name, '^[0-9]+[{BLANK}]+', '') rest from routes where route_long_name is not null")
def str11(s, d):
    n = F.col("route_long_name")
    return table(s, d, "routes").where(n.isNotNull()).select("route_id", text.route_number(n).alias("num"), text.without_number(n).alias("rest"))


STEMS = ("公民館前", "小学校", "役場前", "神社前", "温泉", "前")


@R.add("str12_name_stems", "select ref_id, case " + " ".join(f"when ref_name like '%{x}' and length(ref_name) >= {len(x) + 2} then left(ref_name, length(ref_name) - {len(x)})" for x in STEMS) + " else ref_name end stem from stop_reference")
def str12(s, d):
    return table(s, d, "stop_reference").select("ref_id", text.stem(F.col("ref_name"), STEMS).alias("stem"))


@R.add("str13_town_of_operator", "select agency_id, regexp_extract(agency_name, '^(.{1,5}[市町村])', 1) town from agency")
def str13(s, d):
    return table(s, d, "agency").select("agency_id", F.regexp_extract("agency_name", "^(.{1,5}[市町村])", 1).alias("town"))


@R.add("str14_destinations", f"""with {VISITS}, t as (select trip_id, arg_min("name", seq) f, arg_max("name", seq) l, count(*) n, max(seq) filter (where true) mx from visits group by 1), p as (select v.trip_id, arg_max("name", seq) q from visits v join t on t.trip_id = v.trip_id and v.seq < t.mx group by 1)
select t.trip_id, regexp_replace(case when f = l and n >= 3 then q else l end, '(行き|方面)$', '') || '方面' dest from t left join p using (trip_id)""")
def str14(s, d):
    v = visits(s, d).groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("x"))
    a = F.col("x.name")
    end = F.when((F.get(a, F.lit(0)) == F.element_at(a, -1)) & (F.size(a) >= 3), F.try_element_at(a, F.lit(-2))).otherwise(F.element_at(a, -1))
    return v.select("trip_id", F.concat(F.regexp_replace(end, "(行き|方面)$", ""), F.lit("方面")).alias("dest"))


@R.add("str15_title_mining", "with t as (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n,:;|/()]+'), lambda x: length(x) between 2 and 20 and (ends_with(x, '線') or ends_with(x, 'Circular') or ends_with(x, 'エクスプレス'))) l from documents where text is not null) select doc_id, l[1] title from t where len(l) > 0")
def str15(s, d):
    return table(s, d, "documents").select("doc_id", mining.title(F.col("text")).alias("title")).where("title is not null")


@R.add("str16_pattern_hash", "select trip_id, left(sha1(route_id || '|' || service_id), 8) h, 'shape_' || route_id || '_' || left(sha1(route_id || '|' || service_id), 8) shape from trips where route_id is not null and service_id is not null")
def str16(s, d):
    h = text.short_hash(text.pattern_key(F.array("route_id", "service_id")))
    return table(s, d, "trips").where("route_id is not null and service_id is not null").select("trip_id", h.alias("h"), F.concat(F.lit("shape_"), "route_id", F.lit("_"), h).alias("shape"))


_MINE = " union all ".join(f"select doc_id, '{k}' kind, unnest(regexp_extract_all(text, '{p}', 1)) \"value\" from documents where text is not null" for k, p in mining.PATTERNS.items())


@R.add("str18_condition_mining", f"select doc_id, kind, \"value\", count(*) n from ({_MINE}) group by all")
def str18(s, d):
    return mining.mine(table(s, d, "documents"), "doc_id", "text")


@R.add("str18_only_values", f"select doc_id, kind, min(\"value\") \"value\" from ({_MINE}) group by 1, 2 having count(distinct \"value\") = 1")
def str18b(s, d):
    return mining.only_value(mining.mine(table(s, d, "documents"), "doc_id", "text"), "doc_id")


@R.add("str19_file_names", f"select distinct route_long_name, regexp_replace(route_long_name, '[\\\\/:*?\"<>|{BLANK}]+', '_', 'g') f from routes where route_long_name is not null")
def str19(s, d):
    n = F.col("route_long_name")
    return table(s, d, "routes").where(n.isNotNull()).select("route_long_name", text.safe_file(n).alias("f")).distinct()


@R.add("str20_column_letters", "with l as (select distinct substr(route_color, 1, 2) c from routes where regexp_matches(route_color, '^[A-F]{2}')) select c, (ascii(substr(c, 1, 1)) - 64) * 26 + ascii(substr(c, 2, 1)) - 64 i from l")
def str20(s, d):
    c = F.expr("substr(route_color, 1, 2)")
    return table(s, d, "routes").where(F.col("route_color").rlike("^[A-F]{2}")).select(c.alias("c"), text.column_index(c).alias("i")).distinct()


@R.add("str22_query_variants", "select agency_id, array_to_string(list_distinct_keep, '|') variants from (select agency_id, case when agency_name = coalesce(agency_phone, agency_name) then [agency_name, agency_name || ' ' || agency_lang] else [agency_name, agency_phone, agency_name || ' ' || agency_lang] end list_distinct_keep from agency)")
def str22(s, d):
    v = F.array_distinct(F.filter(F.array("agency_name", "agency_phone", F.concat_ws(" ", "agency_name", "agency_lang")), lambda x: x.isNotNull()))
    return table(s, d, "agency").select("agency_id", F.array_join(v, "|").alias("variants"))


@R.add("geo07_segment_distance", f"""with {PLACES}, c as (select feed_id, min(lat) la, min(lon) lo, max(lat) lb, max(lon) ob from places where lat is not null group by 1), g as (select stop_id, (lon - lo) * 111320.0 * cos(radians(la)) px, (lat - la) * 110540.0 py, (ob - lo) * 111320.0 * cos(radians(la)) bx, (lb - la) * 110540.0 b2 from places join c using (feed_id) where lat is not null),
t as (select *, case when bx * bx + b2 * b2 = 0 then 0 else greatest(0, least(1, (px * bx + py * b2) / (bx * bx + b2 * b2))) end t from g) select stop_id, round(sqrt(pow(px - t * bx, 2) + pow(py - t * b2, 2)), 1) metres, round(t, 6) t from t""")
def geo07(s, d):
    p = places(s, d).where("lat is not null")
    c = p.groupBy("feed_id").agg(F.min("lat").alias("la"), F.min("lon").alias("lo"), F.max("lat").alias("lb"), F.max("lon").alias("ob"))
    xy = lambda a, o: geo.planar(F.col(a), F.col(o), F.col("la"), F.col("lo"))
    (px, py), (bx, by), z = xy("lat", "lon"), xy("lb", "ob"), F.lit(0.0)
    return p.join(c, "feed_id").select("stop_id", F.round(geo.segment(px, py, z, z, bx, by), 1).alias("metres"), F.round(geo.along(px, py, z, z, bx, by), 6).alias("t"))


@R.add("geo11_nearest_vertex", "with v as (select district_id, feed_id, unnest(generate_series(1, len(ring_lat))) i, unnest(ring_lat) y, unnest(ring_lon) x from districts), c as (select feed_id, avg(ring_lat[1]) cy, avg(ring_lon[1]) cx from districts group by 1) select district_id, arg_min(i - 1, (pow(y - cy, 2) + pow(x - cx, 2), i)) nearest from v join c using (feed_id) group by 1")
def geo11(s, d):
    t = table(s, d, "districts")
    c = t.groupBy("feed_id").agg(F.avg(F.get("ring_lat", F.lit(0))).alias("cy"), F.avg(F.get("ring_lon", F.lit(0))).alias("cx"))
    v = t.select("district_id", "feed_id", F.posexplode(F.arrays_zip("ring_lat", "ring_lon")).alias("i", "p")).join(c, "feed_id")
    d2 = F.pow(F.col("p.ring_lat") - F.col("cy"), 2) + F.pow(F.col("p.ring_lon") - F.col("cx"), 2)
    return v.groupBy("district_id").agg(F.min_by("i", F.struct(d2, "i")).alias("nearest"))


QUERIES, SQL = R.queries, R.sql
