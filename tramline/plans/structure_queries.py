"""Documents, registries, reshaping, fares, shapes, confidence, validation and gates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock, geo, text
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import sequence as S
from ..operators import structure as T
from ..runtime import table
from .base import PLACES, VISITS, Registry, hav, places, secs, visits
from .sequence_queries import _HEAD, _OFF

R = Registry()
_BLOCK = "regexp_extract(trip_id, '^(.*)_[0-9]+$', 1)"
_CELLS = f"""{VISITS}, tr as (select {_BLOCK} block, trip_id, row_number() over (partition by {_BLOCK} order by trip_id) ord from (select distinct trip_id from visits)),
cells as (select block, ord, v.trip_id, row_number() over (partition by v.trip_id order by seq) - 1 pos, "name", a "time" from visits v join tr using (trip_id))"""


def docs(s, d):
    return T.documents(visits(s, d), F.regexp_extract("trip_id", "^(.*)_[0-9]+$", 1))


@R.add("col01_explode_documents", f'with {_CELLS} select block, ord, trip_id, pos, "name", "time" from cells')
def col01(s, d):
    return T.cells(docs(s, d))


@R.add("col02_stop_registry", f'with {_CELLS} select left(block, 6) grp, "name", arg_min(block, (block, ord, pos)) first_block, count(*) n, printf(\'S%03d\', row_number() over (partition by left(block, 6) order by "name")) new_id from cells group by 1, 2')
def col02(s, d):
    return T.registry(T.cells(docs(s, d)), F.left("block", F.lit(6)))


_HOUR = f"""({secs('"time"')}) // 3600 % 24"""


@R.add("col03_pivot_grid", f"""with {_CELLS} select block, "name", {', '.join(f'min("time") filter (where {_HOUR} = {i}) h{i}' for i in range(24))} from cells group by 1, 2""")
def col03(s, d):
    """Stops by hours: each stop's first time in every hour of the day."""
    c = T.cells(docs(s, d)).withColumn("hour", F.floor(clock.seconds(F.col("time")) / 3600) % 24)
    return c.groupBy("block", "name").pivot("hour", list(range(24))).agg(F.min("time")).toDF("block", "name", *[f"h{i}" for i in range(24)])


@R.add("col04_unpivot_grid", f"""with {_CELLS} select block, "name", 'h' || {_HOUR} h, min("time") "time" from cells where {_HOUR} is not null group by 1, 2, 3""")
def col04(s, d):
    return col03(s, d).unpivot(["block", "name"], [f"h{i}" for i in range(24)], "h", "time").where("`time` is not null")


_GRID = """nn as (select n_nationkey k, n_name from nation), rr as (select r_regionkey k, r_name from region)"""


def _grid(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    head = r.select(F.lit(0).alias("row"), (F.col("r_regionkey") + 1).alias("col"), F.col("r_name").alias("value"))
    left = n.select((F.col("n_nationkey") + 1).alias("row"), F.lit(0).alias("col"), F.col("n_name").alias("value"))
    body = n.crossJoin(F.broadcast(r)).select((F.col("n_nationkey") + 1).alias("row"), (F.col("r_regionkey") + 1).alias("col"), F.concat((F.col("n_nationkey") * 10 + F.col("r_regionkey") * 100).cast("string"), F.lit("円")).alias("value"))
    known = n.select(F.col("n_name").alias("name")).unionAll(r.select("r_name")).distinct()
    return head.unionAll(left).unionAll(body).select(F.lit("adult").alias("sheet"), "row", "col", "value"), known


@R.add("col06_square_fares", f"with {_GRID} select 'adult' sheet, n_name from_name, r_name to_name, nn.k * 10 + rr.k * 100 price from nn, rr where nn.k * 10 + rr.k * 100 >= 10 and n_name <> r_name")
def col06(s, d):
    return T.square_fares(*_grid(s, d))


def _tri(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("i"), "n_name")
    m = n.select(F.col("i").alias("j"))
    low = n.crossJoin(F.broadcast(m)).where("j < i").select(F.col("i").alias("row"), F.col("j").alias("col"), (F.lit(100) + 10 * (F.col("i") - F.col("j"))).cast("string").alias("value"))
    diag = n.select(F.col("i").alias("row"), F.col("i").alias("col"), F.col("n_name").alias("value"))
    return low.unionAll(diag).select(F.lit("tri").alias("sheet"), "row", "col", "value"), n.select(F.col("n_name").alias("name"))


_TRI = "select 'tri' sheet, a.n_name from_name, b.n_name to_name, 100 + 10 * (a.n_nationkey - b.n_nationkey) price from nation a join nation b on b.n_nationkey < a.n_nationkey"


@R.add("col05_triangular_fares", _TRI)
def col05(s, d):
    return T.triangular_fares(*_tri(s, d))


@R.add("col07_matrix_kinds", "select 'adult' sheet, 'square' kind, 'adult' category union all select 'tri', 'triangular', 'adult'")
def col07(s, d):
    (a, k), (b, k2) = _grid(s, d), _tri(s, d)
    return T.matrix_kind(a.unionAll(b), k.unionAll(k2).distinct())


@R.add("set08_symmetric_fares", f"with p as ({_TRI}) select from_name, to_name, price from p union all select to_name, from_name, price from p")
def set08(s, d):
    return T.symmetric(T.triangular_fares(*_tri(s, d)).drop("sheet"))


@R.add("jn31_zone_fares", f"with p as ({_TRI}) select 'Z' || price fare_id, a.n_nationkey origin_id, b.n_nationkey destination_id from p join nation a on a.n_name = from_name join nation b on b.n_name = to_name")
def jn31(s, d):
    stops = table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("stop_id"))
    return T.zone_fares(T.triangular_fares(*_tri(s, d)), stops)[1]


@R.add("agg27_price_fares", f"with p as ({_TRI}) select distinct 'Z' || price fare_id, price from p")
def agg27(s, d):
    stops = table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("stop_id"))
    return T.zone_fares(T.triangular_fares(*_tri(s, d)), stops)[0]


_SQUARE = f"{_GRID}, p as (select n_name from_name, rr.k zone, nn.k * 10 + rr.k * 100 price from nn, rr where nn.k * 10 + rr.k * 100 >= 10 and n_name <> r_name)"


@R.add("col18_fare_matrix", f"with {_SQUARE} select from_name, {', '.join(f'max(price) filter (where zone = {i}) zone_{i}' for i in range(5))} from p group by 1")
def col18(s, d):
    z = table(s, d, "region").select(F.col("r_name").alias("to_name"), F.col("r_regionkey").alias("zone"))
    p = T.square_fares(*_grid(s, d)).join(z, "to_name").groupBy("from_name").pivot("zone", list(range(5))).agg(F.first("price"))
    return p.toDF("from_name", *[f"zone_{i}" for i in range(5)])


@R.add("col19_matrix_to_pairs", f"with {_SQUARE} select from_name, 'zone_' || zone zone, price from p where price > 0")
def col19(s, d):
    return col18(s, d).unpivot("from_name", [f"zone_{i}" for i in range(5)], "zone", "price").where("price > 0")


@R.add("dom05_fare_precedence", "select route_id, case when route_type = 3 and route_color is not null then 'zone' when route_short_name is not null then 'route' when agency_id is not null then 'category' else 'flat' end strategy from routes")
def dom05(s, d):
    r = table(s, d, "routes")
    return r.select("route_id", F.when((F.col("route_type") == 3) & F.col("route_color").isNotNull(), "zone").when(F.col("route_short_name").isNotNull(), "route").when(F.col("agency_id").isNotNull(), "category").otherwise("flat").alias("strategy"))


@R.add("col09_rename_in_documents", f"""with {_CELLS} select block, count(*) cells, count(*) filter (where "name" <> '' and r.ref_id is not null) renamed from cells left join (select ref_name, min(ref_id) ref_id from stop_reference group by 1) r on r.ref_name = "name" group by 1""")
def col09(s, d):
    r = table(s, d, "stop_reference").groupBy("ref_name").agg(F.min("ref_id").alias("ref_id"))
    if r.limit(100_001).count() > 100_000:
        raise ValueError("the renaming map is too large for one value; join the cells instead")
    m = r.agg(F.map_from_entries(F.collect_list(F.struct("ref_name", "ref_id"))).alias("m"))
    new = F.transform("trips", lambda t: t.withField("cells", F.transform(t["cells"], lambda c: c.withField("name", F.coalesce(F.try_element_at("m", c["name"]), c["name"])))))
    x = docs(s, d).crossJoin(F.broadcast(m)).select("block", F.col("trips").alias("old"), new.alias("trips"))
    pair = lambda t: F.flatten(F.transform(t, lambda x: x["cells"]["name"]))
    z = x.select("block", F.zip_with(pair("old"), pair("trips"), lambda a, b: (a != b).cast("int")).alias("z"))
    return z.select("block", F.size("z").alias("cells"), F.aggregate("z", F.lit(0), lambda a, b: a + b).alias("renamed"))


@R.add("col10_names_in_documents", f'with {_CELLS} select distinct block, "name" from cells')
def col10(s, d):
    return docs(s, d).select("block", F.explode(F.array_distinct(F.flatten(F.transform("trips", lambda t: t["cells"]["name"])))).alias("name"))


@R.add("col13_reverse", f'with {_CELLS} select trip_id, string_agg("name", \'>\' order by pos desc) names from cells group by 1')
def col13(s, d):
    return docs(s, d).select(F.explode("trips").alias("t")).select("t.trip_id", F.array_join(F.reverse("t.cells.name"), ">").alias("names"))


@R.add("col14_move_element", "select district_id, len(ring_lat) n, ring_lat[2] first_lat, ring_lat[1] second_lat, ring_lat[3] third_lat from districts where len(list_distinct(ring_lat)) = len(ring_lat)")
def col14(s, d):
    t = table(s, d, "districts").where(F.size(F.array_distinct("ring_lat")) == F.size("ring_lat"))
    m = t.select("district_id", T.moved(F.col("ring_lat"), F.get("ring_lat", F.lit(0)), 1).alias("m"))
    return m.select("district_id", F.size("m").alias("n"), *[F.get("m", F.lit(i)).alias(c) for i, c in enumerate(("first_lat", "second_lat", "third_lat"))])


@R.add("col20_splice", "select district_id, len(ring_lat) - 1 n, ring_lat[1] first_lat, 0.0::double second_lat, ring_lat[4] third_lat from districts")
def col20(s, d):
    m = table(s, d, "districts").select("district_id", T.spliced(F.col("ring_lat"), 1, 2, F.array(F.lit(0.0))).alias("m"))
    return m.select("district_id", F.size("m").alias("n"), *[F.get("m", F.lit(i)).alias(c) for i, c in enumerate(("first_lat", "second_lat", "third_lat"))])


@R.add("col15_map_merge", "select agency_id, 'en' lang, coalesce(agency_phone, '') phone from agency")
def col15(s, d):
    base = F.create_map(F.lit("lang"), "agency_lang", F.lit("phone"), F.coalesce("agency_phone", F.lit("")))
    m = T.merged_map(base, F.create_map(F.lit("lang"), F.lit("en"), F.lit("phone"), F.lit("x")), ["lang"])
    return table(s, d, "agency").select("agency_id", m["lang"].alias("lang"), m["phone"].alias("phone"))


@R.add("col16_coordinate_lists", f"with {VISITS} select trip_id, count(lat) located, count(*) - count(lat) skipped from visits group by 1")
def col16(s, d):
    v = visits(s, d).groupBy("trip_id").agg(F.collect_list(F.struct("lat")).alias("p"))
    n = F.size(F.filter("p", lambda x: x["lat"].isNotNull()))
    return v.select("trip_id", n.alias("located"), (F.size("p") - n).alias("skipped"))


@R.add("col17_translations_pivot", "select point_name field_value, max(point_reading) filter (where point_reading is not null) ja_hrkt, max(operator_name) op from stop_survey where point_name is not null group by 1")
def col17(s, d):
    t = table(s, d, "stop_survey").where("point_name is not null")
    u = t.select("point_name", F.explode(F.array(F.struct(F.lit("ja_hrkt").alias("l"), F.col("point_reading").alias("v")), F.struct(F.lit("op").alias("l"), F.col("operator_name").alias("v")))).alias("e")).select(F.col("point_name").alias("field_value"), "e.*")
    return u.groupBy("field_value").pivot("l", ["ja_hrkt", "op"]).agg(F.max("v"))


@R.add("col11_name_variants")
def col11(s, d):
    """Names of a feed that share a confusion key: compatibility form without accents, blanks and case."""
    import unicodedata

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def key(x):
        strip = lambda v: "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", v).casefold()) if unicodedata.category(c) not in ("Mn", "Zs", "Cf"))
        return x.map(lambda v: None if v is None else strip(v))

    n = table(s, d, "stops").where("stop_name is not null").select("feed_id", "stop_name").distinct().withColumn("k", key("stop_name")).where(F.length("k") >= 3)
    return n.groupBy("feed_id", "k").agg(F.array_join(F.array_sort(F.collect_set("stop_name")), "|").alias("names"), F.countDistinct("stop_name").alias("n")).where("n > 1")


@R.add("dom01_stop_times", f"""with {_CELLS}, reg as (select left(block, 6) grp, "name", printf('S%03d', row_number() over (partition by left(block, 6) order by "name")) new_id from cells group by 1, 2), n as (select trip_id, count(*) n from cells group by 1)
select block || '_' || ord new_trip, pos + 1 stop_sequence, new_id stop_id, "time" arrival_time from cells c join reg on reg.grp = left(c.block, 6) and reg."name" = c."name" join n using (trip_id) where n.n >= 2""")
def dom01(s, d):
    """Documents to stop times: registry ids, trip ids by block and ordinal (counted before short trips are dropped)."""
    c = T.cells(docs(s, d))
    reg = T.registry(c, F.left("block", F.lit(6))).select("grp", "name", "new_id")
    j = c.withColumn("grp", F.left("block", F.lit(6))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("trip_id"))).where("n >= 2").join(reg, ["grp", "name"])
    return j.select(F.concat_ws("_", "block", F.col("ord").cast("string")).alias("new_trip"), (F.col("pos") + 1).alias("stop_sequence"), F.col("new_id").alias("stop_id"), F.col("time").alias("arrival_time"))


@R.add("dom02_block_direction", f"with {_CELLS} select block, right(block, 1) direction, count(distinct trip_id) trips, count(distinct \"name\") stops from cells group by 1")
def dom02(s, d):
    c = T.cells(docs(s, d))
    return c.groupBy("block", F.right("block", F.lit(1)).alias("direction")).agg(F.countDistinct("trip_id").alias("trips"), F.countDistinct("name").alias("stops"))


@R.add("dom03_vehicle_blocks", "with l as (select feed_id grp, block_id b, min(trip_id) f from trips where block_id is not null and trip_id is not null group by 1, 2), n as (select grp, b, row_number() over (partition by grp order by f) i from l) select distinct grp, trip_id, printf('B%03d', i) block_id from n join trips t on t.feed_id = n.grp and t.block_id = n.b where trip_id is not null")
def dom03(s, d):
    l = table(s, d, "trips").where("block_id is not null and trip_id is not null").groupBy(F.col("feed_id").alias("grp"), "block_id").agg(F.array_sort(F.collect_set("trip_id")).alias("trips"))
    return T.chains(l).distinct()


@R.add("dom04_service_priority", "with t as (select trip_id, min(row_id) r, arg_min(route_id, row_id) block from trips where trip_id is not null group by 1), p as (select trip_id, min(service_id) s1 from trips where direction_id = 1 and service_id is not null and trip_id is not null group by 1), b as (select route_id block, min(service_id) s2 from trips where route_id is not null and direction_id = 0 group by 1) select trip_id, coalesce(s1, s2, 'EVERY') service_id, case when s1 is not null then 'trip' when s2 is not null then 'block' else 'default' end origin from t left join p using (trip_id) left join b using (block)")
def dom04(s, d):
    t = table(s, d, "trips")
    per_trip = t.where("direction_id = 1 and service_id is not null and trip_id is not null").groupBy("trip_id").agg(F.min("service_id").alias("service_id"))
    per_block = t.where("route_id is not null and direction_id = 0").groupBy(F.col("route_id").alias("block")).agg(F.min("service_id").alias("service_id"))
    return T.service_of(t.where("trip_id is not null").groupBy("trip_id").agg(F.min_by("route_id", "row_id").alias("block")), per_trip, per_block, "EVERY")


@R.add("dom06_boarding_types", f"""with {PLACES} select row_id, coalesce(pickup_type, case when contains("name", 'のりば') then 2 else 0 end) pickup from stop_times t left join places p on p.stop_id = t.stop_id""")
def dom06(s, d):
    p = places(s, d).select("stop_id", "name")
    return table(s, d, "stop_times").join(p, "stop_id", "left").select("row_id", T.boarding_type(F.col("pickup_type"), F.col("name"), "のりば").alias("pickup"))


@R.add("jn29_boarding_rules", f"""with {VISITS}, b as (select distinct {_BLOCK} route, right({_BLOCK}, 1) direction, "name" from visits) select route, direction, "name", case when "name" = '中央共同ターミナル' then 1 else 0 end pickup, case when direction = '0' and "name" = '中央共同ターミナル' then 1 else 0 end dropoff from b""")
def jn29(s, d):
    b = F.regexp_extract("trip_id", "^(.*)_[0-9]+$", 1)
    rows = visits(s, d).select(b.alias("route"), F.right(b, F.lit(1)).alias("direction"), "name").distinct()
    rules = s.createDataFrame([("pickup", None, None, ["中央共同ターミナル"]), ("dropoff", None, "0", ["中央共同ターミナル", "x"]), ("dropoff", "none", None, ["x"])], "r_kind string, r_route string, r_dir string, r_stops array<string>")
    return T.board_codes(rows, rules)


_SHAPE = f"""{VISITS}, pat as (select trip_id, string_agg(stop_id, '|' order by seq) k, count(*) n from visits where lat is not null group by 1), sh as (select k, 'shape_' || left(sha1(k), 8) shape_id, min(trip_id) rep from pat group by 1),
pts as (select shape_id, row_number() over (partition by shape_id order by seq) - 1 seq, lat, lon from sh join visits v on v.trip_id = sh.rep where lat is not null),
st as (select *, coalesce({hav("lag(lat) over w", "lag(lon) over w", "lat", "lon")}, 0) step from pts window w as (partition by shape_id order by seq)), shp as (select shape_id, seq, lat, lon, sum(step) over (partition by shape_id order by seq rows unbounded preceding) dist from st)"""


def _shapes(s, d):
    v = visits(s, d).where("lat is not null")
    p = v.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stop_id", "lat", "lon"))).alias("points"))
    p = p.withColumn("shape_id", F.concat(F.lit("shape_"), text.short_hash(F.array_join("points.stop_id", "|"))))
    one = p.groupBy("shape_id").agg(F.min_by("points", "trip_id").alias("points"))
    return p.select("trip_id", "shape_id"), T.shapes(one)


@R.add("dom08_shapes", f"with {_SHAPE} select shape_id, seq, lat, lon, round(dist, 1) dist from shp")
def dom08(s, d):
    return _shapes(s, d)[1].withColumn("dist", F.round("dist", 1))


@R.add("dom16_shape_coverage")
def dom16(s, d):
    ids, rows = _shapes(s, d)
    c = Q.coverage(visits(s, d).join(ids, "trip_id"), rows)
    return c.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@R.add("dom26_representative_trip", f"with {VISITS}, f as (select {_BLOCK} block, min(trip_id) rep from visits where lat is not null group by 1) select block, rep, count(*) located from f join visits v on v.trip_id = f.rep where lat is not null group by 1, 2")
def dom26(s, d):
    v = visits(s, d).where("lat is not null")
    f = v.groupBy(F.regexp_extract("trip_id", "^(.*)_[0-9]+$", 1).alias("block")).agg(F.min("trip_id").alias("rep"))
    return f.join(v, F.col("rep") == F.col("trip_id")).groupBy("block", "rep").agg(F.count(F.lit(1)).alias("located"))


_CASC = f"""{PLACES}, sv as (select point_name nm, arg_min(lat, survey_id) la, arg_min(lon, survey_id) lo from stop_survey where lat is not null and lon is not null and point_name is not null group by 1), fm as (select feed_id, avg(lat) la, avg(lon) lo from places where lat is not null group by 1),
casc as (select p.stop_id, coalesce(p.lat, sv.la, fm.la) lat, coalesce(p.lon, sv.lo, fm.lo) lon, case when p.lat is not null then 'official' when sv.nm is not null then 'exact' when fm.la is not null then 'estimate' end source from places p left join sv on sv.nm = p."name" left join fm on fm.feed_id = p.feed_id)"""


def _cascade(s, d):
    p = places(s, d).withColumn("source", F.when(F.col("lat").isNotNull(), "official"))
    sv = M.first_by(table(s, d, "stop_survey").where("lat is not null and lon is not null and point_name is not null"), "point_name", "survey_id").select(F.col("point_name").alias("name"), "lat", "lon")
    fm = p.where("lat is not null").groupBy("feed_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return M.fill(M.fill(p, sv, "name", ["lat", "lon"], "exact"), fm, "feed_id", ["lat", "lon"], "estimate")


@R.add("dom07_coordinate_cascade", f"with {_CASC} select stop_id, round(lat, 6) lat, round(lon, 6) lon, source from casc")
def dom07(s, d):
    return _cascade(s, d).select("stop_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "source")




@R.add("dom18_confidence", f"""with {_OFF}, sv as (select point_name nm, arg_min(lat, survey_id) la, arg_min(lon, survey_id) lo from stop_survey where lat is not null and lon is not null and point_name is not null group by 1), fm as (select feed_id, avg(lat) la from places where lat is not null group by 1),
x as (select p.stop_id, coalesce(p.lat, sv.la, fm.la) is not null has, case when p.lat is not null then 'official' when sv.nm is not null then 'exact' else 'estimate' end src from places p left join sv on sv.nm = p."name" left join fm on fm.feed_id = p.feed_id)
select x.stop_id, case when not has then 'empty' when src = 'estimate' then 'review' when src = 'official' then 'sure' when metres is null or metres <= 500 then 'sure' else 'review' end confidence from x left join off using (stop_id)""")
def dom18(s, d):
    c = _cascade(s, d).join(S.off_route(visits(s, d)), "stop_id", "left")
    conf = Q.confidence(F.col("lat").isNotNull(), F.coalesce("source", F.lit("unknown")), F.col("metres"), F.lit(0), F.col("source") == "estimate", F.lit(False))
    return c.select("stop_id", conf.alias("confidence"))


@R.add("agg10_confidence_counts", f"""with {_CASC} select coalesce(source, 'none') source, count(*) n from casc group by 1""")
def agg10(s, d):
    return _cascade(s, d).groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@R.add("jn24_source_of_position", f"""with {_CASC}, sv2 as (select point_name nm, arg_min(lat, survey_id) la, arg_min(lon, survey_id) lo from stop_survey where lat is not null and lon is not null and point_name is not null group by 1), e as (select p.stop_id, s.la, s.lo from places p join sv2 s on s.nm = p."name" where p."name" <> '')
select c.stop_id, case when e.stop_id is null then 'unknown' else 'survey' end source from casc c left join e using (stop_id)""")
def jn24(s, d):
    sv = M.first_by(table(s, d, "stop_survey").where("lat is not null and lon is not null and point_name is not null"), "point_name", "survey_id").select(F.col("point_name").alias("name"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    e = places(s, d).where("name <> ''").join(sv, "name").select("stop_id", F.lit("survey").alias("kind"), F.lit(1).alias("priority"), F.col("la").alias("lat"), F.col("lo").alias("lon"))
    return Q.nearest_source(_cascade(s, d), e)


@R.add("dom19_direction_offset", f"""with {_HEAD}, g as (select feed_id, "name", min(stop_id) a, max(stop_id) b from places where lat is not null and "name" <> '' group by 1, 2 having count(*) = 2), j as (select b stop_id, p.lat, p.lon, {hav("p.lat", "p.lon", "q.lat", "q.lon")} m from g join places p on p.stop_id = b join places q on q.stop_id = a)
select j.stop_id, heads.stop_id is not null moved, round(case when heads.stop_id is null then lat else lat + 15 * east / sqrt(east * east + north * north) / 110540.0 end, 6) lat from j left join heads on heads.stop_id = j.stop_id where m <= 30""")
def dom19(s, d):
    """The second of two poles of one name at nearly one position moves to the left of its heading."""
    p = places(s, d).where("lat is not null")
    g = p.where("name <> ''").groupBy("feed_id", "name").agg(F.min("stop_id").alias("a"), F.max("stop_id").alias("stop_id"), F.count(F.lit(1)).alias("n")).where("n = 2")
    j = g.join(p.select("stop_id", "lat", "lon"), "stop_id").join(p.select(F.col("stop_id").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("lo")), "a").where(geo.sphere_m(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")) <= 30)
    j = j.join(S.headings(visits(s, d)), "stop_id", "left")
    la, _ = geo.offset_left(F.col("lat"), F.col("lon"), F.col("east"), F.col("north"), 15.0)
    return j.select("stop_id", F.col("east").isNotNull().alias("moved"), F.round(F.when(F.col("east").isNull(), F.col("lat")).otherwise(la), 6).alias("lat"))


@R.add("dom20_golden_gate", f"""with {_CASC}, sv2 as (select point_name nm, arg_min(lat, survey_id) la, arg_min(lon, survey_id) lo from stop_survey where lat is not null and lon is not null and point_name is not null group by 1), j as (select c.*, coalesce({hav("c.lat", "c.lon", "s.la", "s.lo")} <= 100, false) ok from casc c join places p using (stop_id) join sv2 s on s.nm = p."name" where p."name" <> '')
select count(*) filter (where source = 'official' and not ok) silent_errors, count(*) filter (where source = 'official') sure, count(*) filter (where source = 'official' and ok) sure_right, count(*) filter (where source = 'official' and not ok) = 0 passed from j""")
def dom20(s, d):
    sv = M.first_by(table(s, d, "stop_survey").where("lat is not null and lon is not null and point_name is not null"), "point_name", "survey_id").select(F.col("point_name").alias("name"), "lat", "lon")
    truth = places(s, d).where("name <> ''").select("stop_id", "name").join(sv, "name")
    c = _cascade(s, d).select("stop_id", "lat", "lon", F.when(F.col("source") == "official", "sure").otherwise("review").alias("confidence"))
    return Q.golden(c, truth)


@R.add("dom11_set_report", "select 'routes' what, (select count(*) from routes a join routes_copy b using (route_id)) \"both\", (select count(*) from routes) base, (select count(*) from routes_copy) other union all select 'stop_times', (select count(*) from stop_times a join stop_times_copy b using (row_id)), (select count(*) from stop_times), (select count(*) from stop_times_copy)")
def dom11(s, d):
    def one(t, k):
        a, b = table(s, d, t).select(k), table(s, d, f"{t}_copy").select(k)
        return a.join(b, k).agg(F.count(F.lit(1)).alias("both")).crossJoin(a.agg(F.count(F.lit(1)).alias("base"))).crossJoin(b.agg(F.count(F.lit(1)).alias("other"))).select(F.lit(t).alias("what"), "both", "base", "other")

    return one("routes", "route_id").unionAll(one("stop_times", "row_id"))


@R.add("dom13_consistency", "select count(*) = 0 passed, count(*) n from stop_times a join stop_times_copy b using (row_id) where a.arrival_time is distinct from b.arrival_time")
def dom13(s, d):
    b = table(s, d, "stop_times_copy").select("row_id", F.col("arrival_time").alias("t"))
    n = table(s, d, "stop_times").join(b, "row_id").where(~F.col("arrival_time").eqNullSafe(F.col("t"))).agg(F.count(F.lit(1)).alias("n"))
    return n.select((F.col("n") == 0).alias("passed"), "n")


@R.add("jn30_review_edits", "select row_id, a.stop_id old, b.stop_id new_value from stop_times a join stop_times_copy b using (row_id) where a.stop_id is distinct from b.stop_id")
def jn30(s, d):
    b = table(s, d, "stop_times_copy").select("row_id", F.col("stop_id").alias("new_value"))
    return table(s, d, "stop_times").select("row_id", F.col("stop_id").alias("old")).join(b, "row_id").where(~F.col("old").eqNullSafe(F.col("new_value")))


@R.add("jn22_nearest_line", "with t as (select row_id, feed_id, stop_sequence x from stop_times where stop_sequence is not null), l as (select * from (values (1), (10), (20), (35)) v(line)) select row_id, arg_min(line, (abs(x - line), line)) line from t, l group by 1 having min(abs(x - line)) <= 4")
def jn22(s, d):
    lines = F.array(*map(F.lit, (1, 10, 20, 35)))
    best = F.array_min(F.transform(lines, lambda v: F.struct(F.abs(F.col("stop_sequence") - v).alias("dx"), v.alias("line"))))
    return table(s, d, "stop_times").where("stop_sequence is not null").select("row_id", best.alias("b")).where("b.dx <= 4").select("row_id", "b.line")


@R.add("win22_dense_ids", "select stop_id, printf('S%05d', row_number() over (partition by feed_id order by stop_id)) new_id from (select distinct feed_id, stop_id from stops)")
def win22(s, d):
    w = W.partitionBy("feed_id").orderBy("stop_id")
    return table(s, d, "stops").select("feed_id", "stop_id").distinct().select("stop_id", F.format_string("S%05d", F.row_number().over(w)).alias("new_id"))


@R.add("win23_unique_labels", "with t as (select row_id, coalesce(trip_headsign, '') h, row_number() over (partition by route_id, coalesce(trip_headsign, '') order by row_id) k from trips) select row_id, case when k = 1 then h else h || '(' || k || ')' end label from t")
def win23(s, d):
    h = F.coalesce("trip_headsign", F.lit(""))
    k = F.row_number().over(W.partitionBy("route_id", h).orderBy("row_id"))
    return table(s, d, "trips").select("row_id", h.alias("h"), k.alias("k")).select("row_id", F.when(F.col("k") == 1, F.col("h")).otherwise(F.concat("h", F.lit("("), F.col("k").cast("string"), F.lit(")"))).alias("label"))


@R.add("win24_duplicate_ids", "select row_id, trip_id from (select row_id, trip_id, row_number() over (partition by trip_id order by row_id) k from trips where trip_id is not null) where k > 1")
def win24(s, d):
    t = table(s, d, "trips").where("trip_id is not null")
    return t.withColumn("k", F.row_number().over(W.partitionBy("trip_id").orderBy("row_id"))).where("k > 1").select("row_id", "trip_id")


@R.add("win25_cells_on_rows")
def win25(s, d):
    """Cells of every trip laid onto the rows of the longest trip's stops, by names in order."""
    v = visits(s, d).groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("x")).select(F.col("trip_id").alias("trip"), F.col("x.name").alias("cells"))
    master = v.orderBy(F.desc(F.size("cells")), "trip").limit(1).select("cells")
    return M.merge_rows(master, v)


@R.add("val03_value_domains", "select row_id, 'direction' rule from trips where direction_id not in (0, 1) union all select row_id, 'pickup' from stop_times where pickup_type not between 0 and 3 union all select row_id, 'sequence' from stop_times where stop_sequence < 0")
def val03(s, d):
    bad = lambda t, cond, rule: table(s, d, t).where(cond).select("row_id", F.lit(rule).alias("rule"))
    return bad("trips", "direction_id not in (0, 1)", "direction").unionAll(bad("stop_times", "pickup_type not between 0 and 3", "pickup")).unionAll(bad("stop_times", "stop_sequence < 0", "sequence"))


@R.add("val04_value_sets", "select distinct trim(zone_id, ' ') zone_id from stops where trim(zone_id, ' ') <> ''")
def val04(s, d):
    return table(s, d, "stops").select(F.trim("zone_id").alias("zone_id")).where("zone_id <> ''").distinct()


@R.add("val01_missing_columns", "select * from (values ('stops', 'stop_desc'), ('trips', 'wheelchair_accessible')) v(tbl, col)")
def val01(s, d):
    want = {"stops": ["stop_id", "stop_name", "stop_lat", "stop_lon", "stop_desc"], "trips": ["trip_id", "route_id", "service_id", "wheelchair_accessible"]}
    return s.createDataFrame([(t, c) for t, cs in want.items() for c in sorted(set(cs) - set(table(s, d, t).columns))], "tbl string, col string")


@R.add("val05_gates", """with g as (select 'block' lv, 'stops' nm, (select count(*) from stops) > 0 ok union all select 'block', 'names', (select count(*) from routes where coalesce(trim(route_long_name, ' '), '') = '') = 0 union all select 'must', 'located', (select count(*) from stops where stop_lat is null) = 0 union all select 'info', 'valid', (select max(end_date) from calendar) >= '20261126')
select lv "level", bool_and(ok) passed, coalesce(string_agg(nm, ',' order by nm) filter (where not ok), '') failing from g group by 1""")
def val05(s, d):
    g = lambda lv, nm, t, e: table(s, d, t).agg(F.expr(e).alias("ok")).select(F.lit(lv).alias("level"), F.lit(nm).alias("name"), "ok")
    rows = g("block", "stops", "stops", "count(*) > 0").unionAll(g("block", "names", "routes", "count_if(coalesce(trim(route_long_name), '') = '') = 0"))
    rows = rows.unionAll(g("must", "located", "stops", "count_if(stop_lat is null) = 0")).unionAll(g("info", "valid", "calendar", "max(end_date) >= '20261126'"))
    return Q.gates(rows)


@R.add("val07_confirmed_override", f"with {_CASC} select stop_id, case when stop_id like '%_1' then 'sure' when source = 'official' then 'sure' else 'review' end confidence from casc")
def val07(s, d):
    c = _cascade(s, d)
    return c.select("stop_id", F.when(F.col("stop_id").like("%_1"), "sure").when(F.col("source") == "official", "sure").otherwise("review").alias("confidence"))


@R.add("val09_generation_guards", "select feed_id, count(*) filter (where regexp_matches(agency_id, '^[0-9]{13}$')) good_ids, bool_or(coalesce(trim(route_long_name, ' '), '') = '') nameless from routes group by 1")
def val09(s, d):
    return table(s, d, "routes").groupBy("feed_id").agg(F.count_if(F.col("agency_id").rlike("^[0-9]{13}$")).alias("good_ids"), F.bool_or(F.coalesce(F.trim("route_long_name"), F.lit("")) == "").alias("nameless"))


@R.add("val10_range_sanity", "select service_id from calendar where end_date < start_date or (start_date is null) <> (end_date is null)")
def val10(s, d):
    return table(s, d, "calendar").where("end_date < start_date or (start_date is null) <> (end_date is null)").select("service_id")


@R.add("agg15_vector_sums", f"with {_HEAD} select round(sum(east), 2) east, round(sum(north), 2) north from heads")
def agg15(s, d):
    return S.headings(visits(s, d)).agg(F.round(F.sum("east"), 2).alias("east"), F.round(F.sum("north"), 2).alias("north"))


@R.add("agg22_severities", "select event_type sev, count(*) codes, round(sum(value), 4) total from events group by 1")
def agg22(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("sev")).agg(F.count(F.lit(1)).alias("codes"), F.round(F.sum("value"), 4).alias("total"))


@R.add("agg24_all_pass", "select feed_id, bool_and(stop_lat is not null) located, bool_and(coalesce(stop_name, '') <> '') named from stops group by 1")
def agg24(s, d):
    return table(s, d, "stops").groupBy("feed_id").agg(F.bool_and(F.col("stop_lat").isNotNull()).alias("located"), F.bool_and(F.coalesce("stop_name", F.lit("")) != "").alias("named"))


@R.add("udx04_block_summary", f"""with {_CELLS} select block, count(distinct trip_id) trips, count(*) cells, min("time") filter (where {_HOUR} is not null) first_time, max("time") filter (where {_HOUR} is not null) last_time from cells group by 1""")
def udx04(s, d):
    t = F.when(clock.seconds(F.col("time")).isNotNull(), F.col("time"))
    return T.cells(docs(s, d)).groupBy("block").agg(F.countDistinct("trip_id").alias("trips"), F.count(F.lit(1)).alias("cells"), F.min(t).alias("first_time"), F.max(t).alias("last_time"))


QUERIES, SQL = R.queries, R.sql
