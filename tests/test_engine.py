import json
import subprocess
import sys
import zipfile
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tramline.functions import clock, geo, text
from tramline.operators import matching, quality, sequence, structure
from tramline.plans import catalog
from tramline.sources import feeds
from tramline.streaming.events import hourly

ROOT = Path(__file__).resolve().parents[1]


def one(spark, expr, *values, kinds=None):
    cols = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], kinds or ", ".join(f"{c} string" for c in cols))
    return df.select(expr(*[F.col(c) for c in cols]).alias("x")).first()["x"]


def test_collapse_and_renumber(spark):
    rows = [("s", i, la, lo) for i, (la, lo) in enumerate([(33.10, 130.40), (33.10, 130.40), (33.11, 130.41), (33.11, 130.41), (33.12, 130.42)])]
    got = sequence.collapse(spark.createDataFrame(rows, "k string, i int, la double, lo double"), "k", "i", ["la", "lo"]).orderBy("pos").collect()
    assert [(r["pos"], r["la"]) for r in got] == [(0, 33.10), (1, 33.11), (2, 33.12)]


def test_distances(spark):
    row = spark.createDataFrame([(35.0, 135.0, 35.0, 135.001)], "a double, b double, c double, d double")
    a = [F.col(c) for c in "abcd"]
    m, n = row.select(geo.sphere_m(*a), geo.atan_m(*a)).first()
    assert 80 < m < 100 and abs(m - n) < 1e-6
    assert row.select(geo.sphere_m(F.lit(None).cast("double"), *a[1:])).first()[0] is None


@pytest.mark.parametrize("value, want", [("20260601", "20270331"), ("20260301", "20260331"), (None, "20991231"), ("x", "20991231")])
def test_fiscal_end(spark, value, want):
    assert one(spark, clock.fiscal_end, value) == want


@pytest.mark.parametrize("value, want", [("8:10:00", "08:10:00"), ("8:10", "08:10:00"), ("25:10:00", "25:10:00"), ("レ", "レ"), (None, None), ("", "")])
def test_normal_time(spark, value, want):
    assert one(spark, clock.normal, value) == want


@pytest.mark.parametrize("short, long, want", [("", "1 一番田～上須恵線", "1"), ("7", "x", "7"), (None, "循環線", "循環線"), (None, None, "")])
def test_route_key(spark, short, long, want):
    assert one(spark, text.route_key, short, long) == want


@pytest.mark.parametrize("a, b, want", [("上萩瀬公民館前", "萩瀬公民館前", False), ("東桜", "西桜", False), ("東桜", "東桜二", True), ("車庫前", "車庫前通り", True), ("北藍", "南凪", True)])
def test_direction_compatible(spark, a, b, want):
    assert one(spark, text.compatible_direction, a, b) is want


@pytest.mark.parametrize("value", ["\u30008:10", "\t8:10\n", "8:10\u00a0"])
def test_blanks_of_any_width(spark, value):
    assert one(spark, clock.normal, value) == "08:10:00" and one(spark, clock.seconds, value) == 29400
    assert one(spark, text.route_number, "12\u3000線") == "12" and one(spark, text.without_number, "12\u00a0線") == "線" and one(spark, text.safe_file, "a\u3000b") == "a_b"


def test_dirty_rows_stay(spark, sf):
    q = catalog.queries()
    raw = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    assert q["tim01_normal_time"](spark, sf).count() == raw("stop_times").where("arrival_time is not null").select("arrival_time").distinct().count()
    assert q["str11_route_keys"](spark, sf).count() == raw("routes").where("route_long_name is not null").count()
    assert q["src19_cell_grid"](spark, sf).count() == raw("documents").where("contains(text, ',')").count()


def _fold(times, window=180):
    out, add = [], 0
    for i, t in enumerate(times):
        if i and t < times[i - 1] and t + 1440 - times[i - 1] <= window:
            add += 1440
        out.append(t + add)
    return out


def test_roll_over_equals_recurrence(spark):
    import random

    rng = random.Random(1)
    seqs = {f"t{i}": [rng.choice([1430, 1439, 0, 10, 600, 1300, 5]) for _ in range(8)] for i in range(40)} | {"x": [1430, 10]}
    rows = [(k, i, m) for k, v in seqs.items() for i, m in enumerate(v)]
    got = sequence.roll_over(spark.createDataFrame(rows, "trip_id string, seq int, m int")).groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "rolled"))).alias("x")).collect()
    for r in got:
        assert [x["rolled"] for x in r["x"]] == _fold(seqs[r["trip_id"]])
    adj = spark.createDataFrame([([1430, 10, 1439, 5],)], "a array<int>").select(sequence.roll_over_adjusted(F.col("a"))).first()[0]
    assert adj == [1430, 1450, 1439, 1445]


def test_unknown_times_are_stepped_over(spark):
    df = spark.createDataFrame([("t", i, m) for i, m in enumerate([1430, None, 10, None])], "trip_id string, seq int, m int")
    assert [r["rolled"] for r in sequence.roll_over(df).orderBy("seq").collect()] == [1430, None, 1450, None]
    assert sequence.monotonic(df, value="m").first()["largest_fall"] == 1420
    assert spark.createDataFrame([([1430, None, 10],)], "a array<int>").select(sequence.roll_over_adjusted(F.col("a"))).first()[0] == [1430, None, 1450]


def test_visits_keep_every_position(spark, sf):
    from tramline.plans.base import visits

    raw = spark.read.parquet(f"{sf}/stop_times.parquet").where("coalesce(trip_id, '') <> '' and stop_sequence is not null")
    got = visits(spark, sf)
    assert got.count() == raw.select("trip_id", "stop_sequence").distinct().count()
    assert got.where("arr is null").count() and got.where("arr is not null and a not rlike '^[0-9]{2}:[0-9]{2}:[0-9]{2}$'").count() == 0


def test_interpolation_by_index(spark):
    rows = [("t", i, s, la, la) for i, (s, la) in enumerate([("a", 33.0), ("b", None), ("c", None), ("d", 36.0), ("e", None)])]
    df = spark.createDataFrame(rows, "trip_id string, seq int, stop_id string, lat double, lon double")
    got = {r["stop_id"]: (round(r["lat"], 9), r["n_visits"]) for r in sequence.interpolated_stops(df).collect()}
    assert got == {"b": (34.0, 1), "c": (35.0, 1)}


def test_off_route_skips_the_stop_itself(spark):
    rows = [("t", 0, "a", 35.0, 139.0), ("t", 1, "b", 35.1, 139.1), ("t", 2, "b", 35.1, 139.1), ("t", 3, "c", 35.0, 139.2)]
    got = {r["stop_id"]: r["metres"] for r in sequence.off_route(spark.createDataFrame(rows, "trip_id string, seq int, stop_id string, lat double, lon double")).collect()}
    assert set(got) == {"b"} and 10_000 < got["b"] < 12_000


def test_speed_verdicts(spark):
    rows = [(None, 60, "missing"), (400.0, 0, ""), (800.0, 0, "zero_time"), (2000.0, 60, "too_fast"), (600.0, 3600, "too_slow"), (300.0, 3600, ""), (900.0, 120, "")]
    df = spark.createDataFrame(rows, "m double, s int, want string")
    assert df.where(sequence.speed_verdict(F.col("m"), F.col("s")) != F.col("want")).count() == 0


def test_link_candidates_band_join(spark):
    import random

    rng = random.Random(2)
    trips = [(f"t{i}", rng.choice("AB"), rng.choice("AB"), d := rng.randrange(0, 500), d + rng.randrange(5, 60)) for i in range(60)]
    df = spark.createDataFrame(trips, "id string, o string, t string, dep int, arr int")
    got = {(r["a"], r["b"]) for r in sequence.link_candidates(df, "id", "o", "t", "dep", "arr", 30).collect()}
    assert got == {(a[0], b[0]) for a in trips for b in trips if a[0] != b[0] and a[2] == b[1] and 0 <= b[3] - a[4] <= 30}


def test_vehicle_chain_vector(spark):
    trips = [("b0", "駅東口", "長井", 645, 660), ("b1", "長井", "駅東口", 660, 680), ("b2", "駅東口", "長井", 1020, 1035)]
    df = spark.createDataFrame(trips, "id string, o string, t string, dep int, arr int")
    links = {(r["a"], r["b"]) for r in sequence.link_candidates(df, "id", "o", "t", "dep", "arr", 60).collect()}
    assert links == {("b0", "b1")}
    c = structure.chains(spark.createDataFrame([("f", ["b0", "b1"])], "grp string, trips array<string>"))
    got = {r["id"]: r["block_id"] for r in df.join(c, df["id"] == c["trip_id"], "left").select("id", "block_id").collect()}
    assert got == {"b0": "B001", "b1": "B001", "b2": None}


def test_structuring_one_block(spark):
    rows = [("f_R1_0_1", i, n, t) for i, (n, t) in enumerate([("A停", "08:00:00"), ("B停", "08:10:00"), ("C停", "08:20:00")])]
    v = spark.createDataFrame(rows, "trip_id string, seq int, name string, a string")
    d = structure.documents(v, F.regexp_extract("trip_id", "^(.*)_[0-9]+$", 1))
    c = structure.cells(d)
    assert [(r["pos"], r["name"], r["time"]) for r in c.orderBy("pos").collect()] == [(i, n, t) for _, i, n, t in rows]
    assert {r["name"]: r["new_id"] for r in structure.registry(c, F.lit("g")).collect()} == {"A停": "S001", "B停": "S002", "C停": "S003"}


def test_alignment_is_symmetric_and_ranked(spark):
    mk = lambda rows: matching.signatures(spark.createDataFrame(rows, "trip_id string, seq int, name string, a string"))
    a = mk([(t, i, n, f"{h:02d}:{i:02d}:00") for t, h in (("x", 9), ("y", 8), ("z", 7)) for i, n in enumerate("PQR")])
    b = mk([(t, i, n, f"{h:02d}:{i:02d}:00") for t, h in (("u", 8), ("w", 10)) for i, n in enumerate("PQR")] + [("v", 0, "P", "01:00:00")])
    got = {(r["ours"], r["theirs"]) for r in matching.align(a, b).collect()}
    assert got == {("z", "u"), ("y", "w"), ("x", None), (None, "v")}
    assert {(r["theirs"], r["ours"]) for r in matching.align(b, a).collect()} == got
    p = matching.compare_aligned(matching.align(a, b)).collect()
    assert len(p) == 6 and not any(r["same"] for r in p)


def test_cascade_tiers(spark):
    ref = ["市役所", "市役所前", "中央病院入口", "江洲公民館前", "ショッピングセンター西"]
    names = ["市役所", "市役所前バス", "中央病院入り口", "上江洲公民館前", "", None, "無関係"]
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {r["name"]: (r["cand"], r["tier"], round(r["score"], 3)) for r in matching.cascade(n, spark.createDataFrame([(x,) for x in ref], "cand string")).collect()}
    r = lambda a, b: round(SequenceMatcher(None, a, b).ratio(), 3)
    assert got == {"市役所": ("市役所", "exact", 1.0), "市役所前バス": ("市役所前", "prefix_suffix", r("市役所前バス", "市役所前")), "中央病院入り口": ("中央病院入口", "similar", r("中央病院入り口", "中央病院入口"))}


def test_touching_equals_cross_check(spark):
    words = ["ab", "abc", "bc", "xabcx", "cab", "zz", "a"]
    n = spark.createDataFrame([(w,) for w in words], "name string")
    c = spark.createDataFrame([(w,) for w in words], "cand string")
    assert {(r[0], r[1]) for r in matching.touching(n, c).collect()} == {(a, b) for a in words for b in words if a != b and min(len(a), len(b)) >= 2 and (a in b or b in a)}


def test_fill_keeps_provenance(spark):
    df = spark.createDataFrame([("a", 1.0, "official"), ("b", None, None), ("c", None, None), (None, None, None)], "k string, v double, source string")
    got = {r["k"]: (r["v"], r["source"]) for r in matching.fill(df, spark.createDataFrame([("a", 9.0), ("b", 2.0)], "k string, v double"), "k", ["v"], "ref").collect()}
    assert got == {"a": (1.0, "official"), "b": (2.0, "ref"), "c": (None, None), None: (None, None)}


def test_confidence_ladder(spark):
    rows = [(False, "exact", None, 0, False, False, "empty"), (True, "official", 9999.0, 0, False, False, "sure"), (True, "exact", 400.0, 0, False, False, "sure"), (True, "exact", 600.0, 0, False, False, "review"), (True, "exact", None, 0, False, True, "review"),
            (True, "similar", None, 2, False, False, "sure"), (True, "similar", None, 1, False, False, "review"), (True, "exact", None, 0, True, False, "review"), (True, "manual", None, 0, True, False, "sure")]
    df = spark.createDataFrame(rows, "a boolean, b string, c double, d int, e boolean, f boolean, want string")
    assert df.where(quality.confidence(*[F.col(c) for c in "abcdef"]) != F.col("want")).count() == 0


def test_shape_coverage(spark):
    shape = structure.shapes(spark.createDataFrame([("s", [(35.0, 139.0), (35.0, 139.1), (None, None), (35.0, 139.2)])], "shape_id string, points array<struct<lat: double, lon: double>>"))
    v = spark.createDataFrame([("t", 0, "a", 35.0, 139.05, "s"), ("t", 1, "b", 35.0, 139.02, "s"), ("t", 2, "c", 35.01, 139.15, "s"), ("t", 3, "d", None, None, "s"), ("u", 0, "a", 35.0, 139.05, "none")], "trip_id string, seq int, stop_id string, lat double, lon double, shape_id string")
    got = {(r["trip_id"], r["seq"]): r["verdict"] for r in quality.coverage(v, shape).collect()}
    assert got == {("t", 0): "ok", ("t", 1): "reversed", ("t", 2): "far"}


def test_jaccard_groups_first_fit(spark):
    rows = [("d", g, x) for g, xs in {"1": "abcd", "2": "abce", "3": "xyz", "4": "abc"}.items() for x in xs]
    got = {r["g"]: r["leader"] for r in matching.jaccard_groups(spark.createDataFrame(rows, "k string, g string, x string"), "k", "g", "x").collect()}
    assert got == {"1": "1", "2": "1", "3": "3", "4": "1"}


def test_array_tools(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], {"a": 1, "b": 2}, {"a": 9, "c": 7})], "x array<int>, m map<string,int>, n map<string,int>")
    r = df.select(structure.moved(F.col("x"), F.lit(1), 2), structure.moved(F.col("x"), F.lit(9), 0), structure.spliced(F.col("x"), 1, 2, F.array(F.lit(0))), structure.merged_map(F.col("m"), F.col("n"), ["a"])).first()
    assert r[0] == [2, 3, 1, 4] and r[1] == [1, 2, 3, 4] and r[2] == [1, 0, 4] and r[3] == {"a": 9, "b": 2}
    assert one(spark, text.column_index, "AA") == 27 and one(spark, text.hiragana, "バスのりば") == "ばすのりば"


# ---- sources and sinks


def test_feed_round_trip(spark, tmp_path):
    stops = spark.createDataFrame([("S1", 'A "x", 停', None, "35.0", "139.0"), ("S2", "B\n改行", "", None, "1")], "stop_id string, stop_name string, stop_desc string, stop_lat string, stop_lon string")
    trips = spark.createDataFrame([("T1", "R1", 0)], "trip_id string, route_id string, direction_id int")
    warnings = feeds.write_feed({"stops": stops, "trips": trips, "routes": trips.limit(0)}, str(tmp_path / "f"))
    assert warnings == ["agency is missing", "routes is missing", "stop_times is missing"]
    raw = (tmp_path / "f" / "stops.txt").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfstop_id,stop_name,stop_lat,stop_lon\r\n")
    back = feeds.scan_feed(spark, str(tmp_path))
    assert sorted(tuple(r) for r in back["stops"].collect()) == [("S1", 'A "x", 停', "35.0", "139.0"), ("S2", "B\n改行", None, "1")]
    assert back["agency"].count() == 0 and back["trips"].columns == feeds.SCHEMAS["trips"].replace(" block_id", "").split()
    members, warned = feeds.write_zip(str(tmp_path / "f"), str(tmp_path / "feed.zip"))
    assert members == ["stops.txt", "trips.txt"] and len(warned) == 3
    assert feeds.scan_zips(spark, str(tmp_path / "*.zip"), "stops").where("stop_name like 'A%'").first()["stop_lat"] == "35.0"
    assert {r["name"] for r in feeds.names_from(spark, str(tmp_path / "feed.zip")).collect()} == {'A "x", 停', "B\n改行"}


def test_rewrite_keeps_style(spark, tmp_path):
    p = tmp_path / "translations.txt"
    p.write_bytes("﻿table_name,field_value\r\nstops,A\r\nstops,B\r\n".encode())
    assert feeds.rewrite_csv(spark, str(p), "field_value", {"A": "C"}) == 1
    assert p.read_bytes() == "﻿table_name,field_value\r\nstops,C\r\nstops,B\r\n".encode()
    before = p.read_bytes()
    assert feeds.rewrite_csv(spark, str(p), "field_value", {}) == 0 and p.read_bytes() == before


def test_small_text_sources(spark, tmp_path):
    (tmp_path / "h.csv").write_bytes("国民の祝日,名称\r\n2026/1/1,元日\r\n2026/5/3,憲法記念日\r\n".encode("cp932"))
    assert [(str(r["date"]), r["name"]) for r in feeds.holidays(spark, str(tmp_path / "h.csv")).orderBy("date").collect()] == [("2026-01-01", "元日"), ("2026-05-03", "憲法記念日")]
    (tmp_path / "r.csv").write_text("stop_name,ja-Hrkt,en\nA,えい,\n,x,y\n", encoding="utf-8")
    assert [tuple(r) for r in feeds.reading_dictionary(spark, str(tmp_path / "r.csv")).collect()] == [("A", {"ja-Hrkt": "えい"})]
    (tmp_path / "n.txt").write_text("﻿A\n\nB\nA\n", encoding="utf-8")
    assert {r["name"] for r in feeds.names_from(spark, str(tmp_path / "n.txt")).collect()} == {"A", "B"}
    (tmp_path / "v.json").write_text(json.dumps({"notices": [{"code": "a", "severity": "ERROR", "totalNotices": 2}, {"code": "b", "severity": "INFO", "totalNotices": 5}]}))
    assert [tuple(r) for r in feeds.validator_notices(spark, str(tmp_path / "v.json")).collect()] == [("INFO", 1, 5), ("ERROR", 1, 2)]
    (tmp_path / "d.json").write_text(json.dumps({"source": "x", "blocks": [{"block_index": 0, "stops": [], "trips": [{"cells": [{"seq": 0, "name": "A", "time": "8:00"}]}]}]}))
    assert feeds.scan_documents(spark, str(tmp_path / "d.json")).selectExpr("blocks[0].trips[0].cells[0].name").first()[0] == "A"


def test_html_cells(spark):
    t = "x<table><tr><th>停</th><td colspan=2>8:00</td></tr><tr><td>a &amp; b</td></tr></table><table><tr><td></td></tr></table>"
    got = [tuple(r)[1:] for r in feeds.html_cells(spark.createDataFrame([(1, t), (2, None), (3, "no")], "i long, t string"), "i", "t").collect()]
    assert got == [(0, 0, 0, "停"), (0, 0, 1, "8:00"), (0, 1, 0, "a & b"), (1, 0, 0, "")]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = hourly(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "3650 days").writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = spark.table("hourly"), hourly(events)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


# ---- contract


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150
    for name in ("p2_found", "p3_found", "p4_found", "p5_found"):
        assert name in catalog.queries()


def test_nothing_outside_imports_the_llm_package():
    for p in [*(ROOT / "tramline").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tramline.llm" not in p.read_text() and "from ..llm" not in p.read_text() and "from .llm" not in p.read_text(), p


def test_engine_works_without_the_llm_package(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tramline", tmp_path / "tramline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith(('p1_', 'p6_', 'p7_', 'p9_', 'p10_')) for k in q)"], cwd=tmp_path, check=True, timeout=60)




def test_readings_equal_greedy_longest_match(spark):
    import random

    from tramline.operators import matching

    rng = random.Random(8)
    book = {"駅": "えき", "駅前": "えきまえ", "小": "しょう", "小学校": "しょうがっこう", "前": "まえ", "アイ": "あい"}
    names = ["".join(rng.choice("駅前小学校アx山") for _ in range(rng.randint(0, 9))) for _ in range(80)]

    def brute(t):
        out, at = "", 0
        while at < len(t):
            hit = max((w for w in book if t.startswith(w, at)), key=len, default=None)
            out += book[hit] if hit else {"ア": "あ"}.get(t[at], t[at])
            at += len(hit) if hit else 1
        return out

    n = spark.createDataFrame([(x, 1) for x in [*names, None]], "name string, hits int")
    w = spark.createDataFrame([*book.items(), (None, "x"), ("山", None), ("", "y"), ("駅", "ん")], "w string, r string")
    got = {r["name"]: (r["reading"], r["whole"]) for r in matching.readings(n, "name", w, "w", "r").collect()}
    assert {k: v[0] for k, v in got.items()} == {t: brute(t) for t in names} and all(v[1] == (not any(c in "駅前小学校山" for c in v[0])) for v in got.values())
    assert matching.readings(n.where("name <> ''"), "name", w.limit(0), "w", "r").where("name = reading or name like '%ア%'").count() == len(set(names) - {""})
    assert matching.readings(n.limit(0), "name", w, "w", "r").count() == 0


def test_office_tables(spark, tmp_path):
    import zipfile

    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in rows) + "</w:tbl>"
    doc = f'<w:document xmlns:w="w"><w:body>{table([["駅", "8:00"], ["病院", "8:10"]])}{table([["料金", "200"], ["注", "9:00"]])}</w:body></w:document>'
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>9:</a:t></a:r><a:r><a:t>05</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>9:15</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:sld>'
    for name, member, xml in (("a.docx", "word/document.xml", doc), ("b.pptx", "ppt/slides/slide1.xml", slide)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(member, xml)
    (tmp_path / "c.docx").write_bytes(b"no zip file")
    got = sorted((r["path"][-6:], r["table"], r["row"], r["col"], r["value"]) for r in feeds.scan_office(spark, str(tmp_path)).collect())
    assert got == [("a.docx", 0, 0, 0, "駅"), ("a.docx", 0, 0, 1, "8:00"), ("a.docx", 0, 1, 0, "病院"), ("a.docx", 0, 1, 1, "8:10"), ("b.pptx", 0, 0, 0, "9:05"), ("b.pptx", 0, 0, 1, "9:15")]


def test_entry_outlives_an_llm_package_that_cannot_be_imported():
    run = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", run], cwd=ROOT, check=True, timeout=60)


def test_splice_and_radicals(spark):
    from tramline.functions import geo as g

    p = lambda la, lo: F.struct(F.lit(la).alias("lat"), F.lit(lo).alias("lon"))
    line = F.array(p(1.0, 1.0), p(2.0, 2.0), p(3.0, 3.0))
    row = spark.range(1).select(g.splice(line, p(3.1, 3.0), p(0.9, 1.0)).alias("a"), g.splice(line, p(0.0, 0.0), p(4.0, 4.0)).alias("b"), g.splice(F.array(p(1.0, 1.0)), p(3.0, 3.0), p(1.0, 1.0)).alias("c"), text.radicals(F.lit("小⻑田⺠")).alias("t")).first()
    assert [x["lat"] for x in row["a"]] == [3.0, 2.0, 1.0] and [x["lat"] for x in row["b"]] == [1.0, 2.0, 3.0] and len(row["c"]) == 1 and row["t"] == "小長田民"


def test_name_forms_equal_brute_force(spark, sf):
    import re
    import unicodedata

    q = catalog.queries()
    names = {r[0] for r in spark.read.parquet(f"{sf}/stops.parquet").select("stop_name").distinct().collect()}
    folded = lambda t: " ".join(unicodedata.normalize("NFKC", t).split())
    variants = str.maketrans("ヶヵ澤濱瀧峯嶋櫻鐵關鹽檜", "ケカ沢浜滝峰島桜鉄関塩桧")
    forms = {
        "str02_variant_names": lambda t: folded(t).translate(variants),
        "str03_noise_phrases": lambda t: re.sub(r"\(?バス停\)?|停留所|のりば|\[コミバス\]|※", "", folded(t)).strip(" "),
        "str06_no_blanks": lambda t: "".join(unicodedata.normalize("NFKC", t).split()),
    }
    for k, f in forms.items():
        got = {r[0]: r[1] for r in q[k](spark, sf).select("stop_name", q[k](spark, sf).columns[1]).collect()}
        assert got == {t: None if t is None else f(t) for t in names}, k


def test_shapefile_points(spark, tmp_path):
    import struct

    pts, names = [(139.0, 35.0), (140.0, 36.0)], ["駅前", "病院"]
    body = b"".join(struct.pack(">II", i + 1, 10) + struct.pack("<Idd", 1, *p) for i, p in enumerate(pts))
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + body)
    field = b"P11_001".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([20]) + b"\0" * 15
    rec = b"".join(b" " + n.encode("cp932").ljust(20) for n in names)
    (tmp_path / "a.dbf").write_bytes(b"\x03\0\0\0" + struct.pack("<IHH", 2, 65, 21) + b"\0" * 20 + field + b"\r" + rec)
    got = [(r["name"], r["lat"], r["lon"]) for r in feeds.scan_shapefile(spark, str(tmp_path / "*")).orderBy("lat").collect()]
    assert got == [("駅前", 35.0, 139.0), ("病院", 36.0, 140.0)]
    assert feeds.scan_shapefile(spark, str(tmp_path / "*"), box=(35.5, 37, 139, 141)).count() == 1


def test_page_words_to_cells(spark):
    from tramline.sources import documents

    words = [("p", "駅", 0.0, 10.0), ("前", "x", 0.0, 0.0), ("p", "前", 12.0, 11.0), ("p", "8:00", 100.0, 10.0), ("p", "9:00", 150.0, 12.0), ("p", "病院", 0.0, 30.0), ("p", "8:10", 104.0, 30.0), ("p", "9:10", 149.0, 31.0)]
    w = spark.createDataFrame(words, "page string, text string, x0 double, top double").where("page = 'p'")
    g = documents.words_to_grid(w, "page")
    got = sorted((r["name"], r["trip"], r["time"]) for r in documents.grid_to_cells(g, "page").collect())
    assert got == [("病院", 0, "8:10"), ("病院", 1, "9:10"), ("駅前", 0, "8:00"), ("駅前", 1, "9:00")]
    assert documents.uncovered_columns(w, "page", g).count() == 0
    t = spark.createDataFrame([("g", 0, 0, "A"), ("g", 0, 1, "B"), ("g", 1, 0, "8:00"), ("g", 1, 1, "8:05"), ("g", 2, 0, "レ"), ("g", 2, 1, "9:05")], "i string, row int, col int, value string")
    assert sorted((r["name"], r["time"]) for r in documents.grid_to_cells(t, "i", transposed=True).collect()) == [("A", "8:00"), ("B", "8:05")]
