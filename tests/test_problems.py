import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline import runtime
from tramline.operators import instants, orphans, reconcile, spatial

T0 = datetime(2026, 1, 1)
DAY = timedelta(days=1)


# ---- orphan references


def _kind(key, t, parents):
    rows = [p for p in parents if p[0] == key]
    if not rows:
        return "missing"
    known = [p for p in rows if p[1] <= t]
    if not known:
        return "late"
    return None if any(p[2] is None or p[2] > t for p in known) else "deleted"


def _events(spark, parents, refs):
    p = spark.createDataFrame(parents, "k string, loaded_at timestamp, deleted_at timestamp, key string")
    r = spark.createDataFrame(refs, "row_id long, k string, loaded_at timestamp, kind string")
    return orphans.parent_events(p, "x", "k", gone="deleted_at"), orphans.reference_events(r, [orphans.Relation("t", "k", "x")])


def _random_feed(seed):
    rng = random.Random(seed)
    parents = [(f"k{rng.randrange(12)}", T0 + DAY * rng.randrange(20), rng.choice([None, T0 + DAY * rng.randrange(30)]), "clash") for _ in range(30)]
    refs = [(i, rng.choice([f"k{rng.randrange(16)}", None, ""]), T0 + DAY * rng.randrange(25), "clash") for i in range(120)]
    return parents, refs


@pytest.mark.parametrize("seed", [1, 2])
def test_orphans_equal_brute_force(spark, seed):
    parents, refs = _random_feed(seed)
    p, r = _events(spark, [*parents, (None, T0, None, "")], refs)
    got = {x["row_id"]: x["kind"] for x in orphans.OrphanTracker().apply(r, p).orphans().collect()}
    assert got == {i: k for i, key, t, _ in refs if key and (k := _kind(key, t, parents))}


def test_orphans_in_batches_equal_one_batch(spark):
    parents, refs = _random_feed(7)
    p, r = _events(spark, parents, refs)
    whole = orphans.OrphanTracker().apply(r, p)
    half = F.lit(T0 + DAY * 10)
    step = orphans.OrphanTracker().apply(r.where("row_id % 2 = 0"), p.where(F.col("loaded") < half)).apply(r.where("row_id % 2 = 1"), p.where(F.col("loaded") >= half))
    as_set = lambda t: {tuple(x) for x in t.orphans().collect()}
    assert as_set(whole) == as_set(step)
    assert sum(x["orphans"] for x in whole.snapshot().collect()) == whole.orphans().count()


def test_arrivals_resolve_and_deletions_reopen(spark):
    p, r = _events(spark, [("a", T0, None, "")], [(1, "a", T0 + DAY * 5, ""), (2, "b", T0 + DAY * 5, "")])
    t = orphans.OrphanTracker().apply(r, p)
    assert {x["row_id"]: x["kind"] for x in t.orphans().collect()} == {2: "missing"}
    q, _ = _events(spark, [("b", T0 + DAY * 9, None, "")], [(0, None, T0, "")])
    t = t.apply(parents=q)
    assert {x["row_id"]: x["kind"] for x in t.orphans().collect()} == {2: "late"}
    gone, _ = _events(spark, [("a", T0, T0 + DAY * 3, "")], [(0, None, T0, "")])
    t = t.apply(deletions=gone)
    assert {x["row_id"]: x["kind"] for x in t.orphans().collect()} == {1: "deleted", 2: "late"}
    with pytest.raises(ValueError):
        orphans.OrphanTracker().apply(r)
    assert orphans.OrphanTracker().apply(r.limit(0), p.limit(0)).orphans().count() == 0


def test_salted_join_equals_plain_join(spark):
    left = spark.range(80_000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id").unionAll(spark.createDataFrame([(None, -1)], "k string, id long"))
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k4", 3), (None, 4)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = runtime.salted_join(left, right, ["k"], how, salt_by="id"), left.join(right, "k", how)
        assert a.count() == b.count() and a.exceptAll(b.select(a.columns)).count() == 0, how


# ---- times


@pytest.mark.parametrize("value, utc", [
    ("2026-02-05T08:33:00+09:00", "2026-02-04 23:33:00"), ("08:33", "2026-02-04 23:33:00"), ("８：３３", "2026-02-04 23:33:00"), ("26:10:05", "2026-02-05 17:10:05"), ("1770595500", "2026-02-09 00:05:00"),
    ("1769975700999", "2026-02-01 19:55:00"), ("20260114T083900", "2026-01-13 23:39:00"), ("20260112T063000Z", "2026-01-12 06:30:00"), ("2026-03-28 22:28:00 UTC", "2026-03-28 22:28:00"), ("2026-01-13 09:35:00 America/Denver", "2026-01-13 16:35:00"),
    ("1317", "2026-02-05 04:17:00"), ("13:41:00.709", "2026-02-05 04:41:00"), ("Fri, 16 Jan 2026 14:13:00 +0900", "2026-01-16 05:13:00"), ("午後4時43分", "2026-02-05 07:43:00"), ("午前12時05分", "2026-02-04 15:05:00"),
    ("2026/1/6 9:44", "2026-01-06 00:44:00"), ("令和８年１月２１日 １５時０８分", "2026-01-21 06:08:00"), ("19時49分5秒", "2026-02-05 10:49:05"), ("翌0:08", "2026-02-05 15:08:00"), ("6:54 a.m.", "2026-02-04 21:54:00"), ("12:03 PM", "2026-02-05 03:03:00"),
    ("　18 : 45 ", "2026-02-05 09:45:00"), ("9時", "2026-02-05 00:00:00"), ("2026-02-05T08:33:00.250-0700", "2026-02-05 15:33:00"),
])
def test_notations(value, utc):
    got = instants.interpretations(value, "20260205", "Asia/Tokyo")
    assert got and datetime.fromtimestamp(got[0][0], ZoneInfo("UTC")).strftime("%Y-%m-%d %H:%M:%S") == utc


@pytest.mark.parametrize("value", [None, "", " ", "||", "レ", "通過", "--:--", "-", "25:61", "99:99:99", "2026-13-01 08:00:00", "x" * 10_000, "26時70分"])
def test_no_times(value):
    assert instants.interpretations(value, "20260205", "Asia/Tokyo") == []


def test_clock_changes():
    f = lambda v, d: instants.interpretations(v, d, "America/Denver")[0][0]
    # the day of the change counts from noon minus 12 hours; a wall-clock time that occurs twice is the first
    assert f("00:30:00", "20260308") == int(datetime(2026, 3, 8, 6, 30, tzinfo=ZoneInfo("UTC")).timestamp())
    assert f("2026-11-01 01:30:00", "20261101") == int(datetime(2026, 11, 1, 7, 30, tzinfo=ZoneInfo("UTC")).timestamp())


def test_viterbi_is_the_least_cost_path():
    rng = random.Random(3)
    for _ in range(40):
        rows = [[(rng.randrange(0, 10) * 3600, rng.choice("ab"), rng.random()) for _ in range(rng.randint(0, 3))] for _ in range(6)]
        live = [r for r in rows if r]

        def cost(path):
            return sum(o[2] for o in path) + sum((a[1] != b[1]) * 1.0 + (b[0] < a[0]) * 1.5 for a, b in zip(path, path[1:], strict=False))

        import itertools

        best = min(cost(p) for p in itertools.product(*live)) if live else 0
        got = instants.viterbi(rows, [None] * 6)
        assert [g is None for g in got] == [not r for r in rows]
        picked = itertools.product(*[[o for o in r if o[0] == g] for r, g in zip(rows, got, strict=True) if r])
        assert abs(min(cost(p) for p in picked) - best) < 1e-9


def test_normalise_times_table(spark):
    rows = [(1, "f", "20260205", "08:00:00", "8:05", "clash"), (2, "f", "20260205", None, "", "clash"), (3, "g", "20260205", "9:00", "9:00", None), (4, None, "20260205", "1770595500", "x", None), (5, "f", None, "10:00", "2026-02-05 10:00:00", None),
            (6, "d", "20260308", "08:00:00", "08:00", None), (1, "f", "20260205", "08:00:00", "8:05", "clash")]
    df = spark.createDataFrame(rows, "row_id long, feed_id string, service_date string, a string, b string, fld string")
    zones = spark.createDataFrame([("f", "Asia/Tokyo"), ("d", "America/Denver"), (None, "UTC"), ("g", None)], "feed_id string, agency_timezone string")
    got = {(r["row_id"], r["fld"]): r["utc_second"] for r in instants.normalise_times(df, zones, ["a", "b"]).collect()}
    assert set(got) == {(1, "b"), (4, "a"), (5, "b"), (6, "a"), (6, "b")} and got[6, "a"] == got[6, "b"]
    assert instants.normalise_times(df.limit(0), zones, ["a", "b"]).count() == 0


@pytest.mark.parametrize("block", [1, 3, 64, 10**9])
def test_chains_do_not_end_at_blocks(spark, block):
    """Ambiguous stretches across, before, after and over whole blocks, against one Viterbi chain per source."""
    rng = random.Random(4)
    rows = []
    for i in range(200):
        d = rng.randrange(1, 28)
        v = rng.choice([f"2026/{rng.randrange(1, 13)}/{rng.randrange(1, 13)} 8:{i % 60:02}", f"{rng.randrange(1, 13)}/{rng.randrange(1, 13)}/2026 9:00", *([] if 40 < i < 120 else [f"2026-02-{d:02} 10:00", "24:10", None, "x"])])
        rows.append((i, "f" if i % 3 else None, f"202602{d:02}", v))
    df = spark.createDataFrame(rows, "row_id long, feed_id string, service_date string, a string").repartition(7)
    zones = spark.createDataFrame([("f", "Asia/Tokyo"), ("g", "no zone")], "feed_id string, agency_timezone string")
    want = {}
    for feed, tz in (("f", "Asia/Tokyo"), (None, None)):
        mine = [r for r in rows if r[1] == feed]
        got = instants.viterbi([instants.interpretations(r[3], r[2], tz) for r in mine], [instants._noon_start(r[2], tz) for r in mine])
        want |= {r[0]: g for r, g in zip(mine, got, strict=True) if g is not None}
    assert {r["row_id"]: r["utc_second"] for r in instants.normalise_times(df, zones, ["a"], block=block).collect()} == want


def test_jvm_reads_as_python_does(spark):
    values = ["8:05", " ８：０５：０７ ", "47:59:59.5", "48:00", "12:60", "2026-02-05T08:33:00+09:00", "2026-02-05 8:33", "2026-02-30 08:00", "2026-02-05T25:00:00", "2026-02-05T08:33:00.25-0730", "2026-02-05T08:33Z", "2026-11-01 01:30", "2026-03-08 02:30:00",
              "1770595500", "1769975700999", "1769975700999123", "12345678", "2026-02-05T08:33:00+24:00", "-1", "８:０５\u3000", "08:" + " " * 100 + "05", "2026-02-05" + " " * 70_000 + "08:33", "7:5", "1:2:3", ""]
    days = ["20260205", "20261101", "20260308", "2026", None]
    rows = [(v, d, z) for v in values for d in days for z in ("America/Denver", "Asia/Tokyo", None)]
    df = spark.createDataFrame(rows, "v string, d string, z string").select("*", instants.read_plainly(F.col("v"), instants.noon_start(F.col("d"), F.col("z")), F.col("z")).alias("q"))
    read = 0
    for r in df.collect():
        want = instants.interpretations(r["v"], r["d"], r["z"])
        if r["q"] is not None:
            read += 1
            assert [tuple(r["q"])] == [w[:2] for w in want], r
    assert read > 100
    assert instants.interpretations(values[20], "20260205", "Asia/Tokyo") and instants.interpretations(values[21], "20260205", "Asia/Tokyo")


# ---- two copies


def test_decode_recovers_signed_elements():
    rng = random.Random(2)
    p = reconcile.P
    for n in range(9):
        xs = rng.sample(range(1, p), n)
        signs = [rng.choice([1, -1, 2]) for _ in xs]
        sums = [sum(c * pow(x, k, p) for x, c in zip(xs, signs, strict=True)) % p for k in range(1, 2 * 8 + reconcile.CHECKS + 1)]
        got = reconcile.decode(sums, 8)
        assert (got is None) if n > 8 else dict(got) == dict(zip(xs, signs, strict=True))
    many = [sum(pow(x, k, p) for x in rng.sample(range(1, p), 20)) % p for k in range(1, 11)]
    assert reconcile.decode(many, 4) is None


def test_decode_many_matches_decode():
    rng = random.Random(4)
    p, rows, want = reconcile.P, [], []
    for i in range(60):
        xs = rng.sample(range(1, p), i % 5)
        signs = [1 if j % 2 == 0 else -1 for j in range(len(xs))]
        rows.append([sum(c * pow(x, k, p) for x, c in zip(xs, signs, strict=True)) % p for k in range(1, 11)])
        want += [(i, x, c) for x, c in zip(xs, signs, strict=True)]
    found, bad = reconcile.decode_many(np.array(rows, np.int64), 4)
    assert not len(bad) and sorted(map(tuple, np.concatenate(found, axis=1).T.tolist())) == sorted(want)


@pytest.mark.parametrize("per_bucket", [5, 400])
def test_compare_equals_brute_force(spark, per_bucket):
    rng = random.Random(6)
    a = {i: [rng.choice([None, "", "x", "y"]), rng.randrange(3)] for i in range(600)}
    b = {i: list(v) for i, v in a.items() if i % 11}
    for i in rng.sample(sorted(b), 40):
        b[i][rng.randrange(2)] = rng.choice([None, 7])
    b |= {i: ["n", 1] for i in range(600, 620)}
    schema = "id long, s string, n int, finding string"
    rows = lambda t: [(i, None if v[0] is None else str(v[0]), v[1], "c") for i, v in t.items()]
    x, y = spark.createDataFrame(rows(a) + rows(a)[:5], schema), spark.createDataFrame(rows(b), schema).select("n", "s", "id")
    want = {(i, "missing_in_copy") for i in a if i not in b} | {(i, "missing_in_base") for i in b if i not in a}
    want |= {(i, f) for i in a if i in b for k, f in enumerate(("s", "n")) if (None if a[i][k] is None else str(a[i][k])) != (None if b[i][k] is None else str(b[i][k]))}
    got = reconcile.compare(x, y, ["id"], ["s", "n"], per_bucket)
    assert {(r["id"], r["finding"]) for r in got.collect()} == want and got.count() == len(want)


def test_compare_edges(spark):
    schema = "id string, s string"
    df = lambda rows: spark.createDataFrame(rows, schema)
    f = lambda x, y: sorted((r["id"] or "", r["finding"]) for r in reconcile.compare(df(x), df(y), ["id"], ["s"]).collect())
    assert f([], []) == []
    assert f([("a", None)], []) == [("a", "missing_in_copy")]
    assert f([], [("a", "x" * 100_000)]) == [("a", "missing_in_base")]
    assert f([(None, "x")], [(None, "y")]) == [("", "s")]
    assert f([("a", None)], [("a", "")]) == [("a", "s")]
    assert f([("a", "1"), ("a", "2")], [("a", "2")]) == [("a", "missing_in_copy")]


# ---- places


def test_near_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"s{i}", 35 + rng.random() * 0.004, 139 + rng.random() * 0.004, "c") for i in range(150)]
    rows += [(f"w{i}", rng.uniform(-0.001, 0.001), x, "c") for i, x in enumerate([179.9999, -179.9999, 180.0, -180.0, 179.9996])]
    rows += [(f"n{i}", 89.9997, x, "c") for i, x in enumerate([0.0, 90.0, 180.0, -90.0])]
    rows += [("z0", 0.0, 0.0, "c"), ("z1", None, 1.0, "c"), ("z2", 91.0, 1.0, "c"), ("z3", float("nan"), 1.0, "c"), (None, 35.0, 139.0, "c"), rows[0], ("twin", *rows[0][1:])]

    def metres(a, b):
        la1, lo1, la2, lo2 = np.radians([a[1], a[2], b[1], b[2]])
        return 2 * 6_371_000 * np.arcsin(min(1, np.sqrt(np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin((lo2 - lo1) / 2) ** 2)))

    good = sorted({r for r in rows if r[0] and r[0][0] in "swnt"})
    want = {tuple(sorted((a[0], b[0]))) for i, a in enumerate(good) for b in good[i + 1 :] if a[0] != b[0] and metres(a, b) <= 60}
    got = spatial.near(spark.createDataFrame(rows, "id string, lat double, lon double, metres string"), "id", "lat", "lon", 60.0).collect()
    assert {(r["key_a"], r["key_b"]) for r in got} == want and len(got) == len(want)


def test_holding_equals_brute_force_and_borders(spark):
    rng = random.Random(9)
    regions = []
    for i in range(12):
        cy, cx, n = rng.uniform(0, 0.1), rng.uniform(0, 0.1), rng.randint(3, 9)
        a = sorted(rng.uniform(0, 2 * np.pi) for _ in range(n))
        r = [rng.uniform(0.005, 0.04) for _ in a]
        ring = [(float(cy + q * np.sin(t)), float(cx + q * np.cos(t))) for q, t in zip(r, a, strict=True)][:: rng.choice([1, -1])]
        regions.append((f"r{i}", [p[0] for p in ring], [p[1] for p in ring], "c"))
    regions += [("sq", [0.2, 0.2, 0.3, 0.3], [0.2, 0.3, 0.3, 0.2], "c"), ("sq2", [0.2, 0.3, 0.3, 0.2, 0.2], [0.2, 0.2, 0.3, 0.3, 0.2], "c"), ("bad", [1.0, 2.0], [1.0, 2.0], "c"), ("null", None, None, "c"), ("odd", [0.2, 0.3, None], [0.2, 0.3, 0.2], "c"), (None, [0.2, 0.2, 0.3], [0.2, 0.3, 0.3], "c")]
    pts = [(f"p{i}", rng.uniform(-0.05, 0.15), rng.uniform(-0.05, 0.15), "c") for i in range(200)]
    pts += [("corner", 0.2, 0.2, "c"), ("edge", 0.25, 0.2, "c"), ("level", 0.3, 0.25, "c"), ("mid", 0.25, 0.25, "c"), ("out", 0.25, 0.35, "c"), ("beside", 0.2, 0.1, "c"), ("nil", None, 0.2, "c")]

    def inside(y, x, ys, xs):
        odd = False
        for i in range(len(ys)):
            y1, x1, y2, x2 = ys[i], xs[i], ys[(i + 1) % len(ys)], xs[(i + 1) % len(xs)]
            if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                odd = not odd
        return odd

    want = {(k, g) for k, y, x, _ in pts if k[0] == "p" for g, ys, xs, _ in regions if g and g[0] == "r" and inside(y, x, ys, xs)}
    want |= {(k, g) for k in ("corner", "edge", "level", "mid") for g in ("sq", "sq2")}
    p = spark.createDataFrame(pts, "id string, lat double, lon double, ring string")
    r = spark.createDataFrame(regions, "id string, la array<double>, lo array<double>, s string")
    got = spatial.holding(p, "id", "lat", "lon", r, "id", "la", "lo").collect()
    assert {(x["key_a"], x["key_b"]) for x in got} == want and len(got) == len(want)
    assert spatial.holding(p.limit(0), "id", "lat", "lon", r, "id", "la", "lo").count() == 0
