import random

from tramline.llm import canonical, entity, names
from tramline.llm.queries import QUERIES, SQL


def test_distance_is_a_metric():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(30)]
    d = names.distance
    for a in words:
        for b in words:
            assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b)
            for c in words[:12]:
                assert d(a, c) <= d(a, b) + d(b, c)
    assert d("ab", "ba") == 1 and d("ca", "abc") == 2


def test_bk_tree_returns_all_within():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(200)})
    tree = canonical.BKTree()
    for w in words:
        tree.add(w, w)
    for q in ["abc", "dddd", "", "aabbcc"]:
        for k in (0, 1, 2):
            assert sorted(tree.within(q, k)) == sorted((names.distance(q, w), w) for w in words if names.distance(q, w) <= k)


REF = [("N1", "藍矢里三丁目", "あいやさとさんちょうめ"), ("N2", "藍矢里小学校", "あいやさとしょうがっこう"), ("N3", "北藍矢里小学校", None), ("N4", "桜車越駅東口", None), ("N5", "Kaszöwald Cross-Roads", None), ("N6", "鉄氷原八幡宮", None), (None, "x", None), ("N7", None, None)]
CASES = {
    "藍矢里3丁目": "N1", "藍矢里ミ丁目 のりば": "N1", "藍矢里2丁目": None, "藍矢小": "N2", "藍矢里里小学校": "N2", "北藍矢里(小学校)": "N3", "南藍矢里小学校": None, "桜車越駅(東)": "N4", "桜車越駅西口": None, "鐵氷原ハ幡": "N6",
    "KASZOWALD CROSS-ROADS": "N5", "Cross-Roads, Kaszöwald": "N5", "Kaszwald X-Roads bus stop": "N5", "Kaszöwald Depot": None, "アイヤサトショウガッコウ": "N2", "あいやさとしょうがっこ": "N2",
}


def test_canonical_cases_and_shards(spark):
    ref = spark.createDataFrame(REF, "i string, n string, r string")
    rows = [(k,) for k in CASES] * 2 + [(None,), ("",), (" ​",)]
    df = spark.createDataFrame(rows, "name string")
    for shard_rows in (200_000, 2):
        got = {r["name"]: r["ref_id"] for r in canonical.canonical(df, "name", ref, "i", "n", "r", shard_rows=shard_rows).collect()}
        assert got == CASES, shard_rows
    assert canonical.canonical(df.limit(0), "name", ref, "i", "n", "r").count() == 0
    assert {r["ref_id"] for r in canonical.canonical(df, "name", ref.limit(0), "i", "n", "r").collect()} == {None}


def test_short_parts_must_be_equal():
    forest = canonical.Forest([("A", "谷温泉", None), ("B", "山温泉", None), ("C", "川上温泉", None)])
    assert forest.best("谷温泉") == ("A", 0) and forest.best("森温泉") is None and forest.best("川下温泉") == ("C", 1)


def test_names_are_searched_in_many_tasks(spark):
    """More than one task, though the names fit one shuffle partition."""
    df = spark.createDataFrame([(f"名前{i}",) for i in range(300)], "name string")
    ref = spark.createDataFrame(REF, "i string, n string, r string")
    got = canonical.canonical(df, "name", ref, "i", "n", "r")
    from pyspark.sql import functions as F

    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def _brute_marginals(edges):
    import itertools
    import math

    z, p = 0.0, [0.0] * len(edges)
    for mask in itertools.product((0, 1), repeat=len(edges)):
        used = [e for e, m in zip(edges, mask, strict=True) if m]
        if len({u for u, _, _ in used}) < len(used) or len({v for _, v, _ in used}) < len(used):
            continue
        w = math.exp(sum(s for _, _, s in used))
        z += w
        for i, m in enumerate(mask):
            p[i] += w * m
    return [x / z for x in p]


def test_belief_propagation_is_exact_on_trees(spark):
    edges = [("a", "x", 2.0), ("a", "y", 0.5), ("b", "y", 1.5), ("c", "z", -1.0), ("b", "w", 0.2)]
    got = {(r["u"], r["v"]): r["p"] for r in entity.propagate(spark.createDataFrame(edges, "u string, v string, s double"), tolerance=1e-6, rounds=40).collect()}
    for e, p in zip(edges, _brute_marginals(edges), strict=True):
        assert abs(got[e[:2]] - p) < 1e-3, (e, p, got)


def test_messages_within_groups_are_the_same(spark):
    edges = [(f"{g}{u}", f"{g}{v}", s, g) for g in "pqr" for u, v, s in (("a", "x", 2.0), ("a", "y", 0.5), ("b", "y", 1.5), ("b", "x", 0.1), ("c", "z", -1.0))]
    e = spark.createDataFrame(edges, "u string, v string, s double, g string")
    ran = lambda df: {(r["u"], r["v"]): (round(r["p"], 9), r["settled"]) for r in df.collect()}
    got = ran(entity.propagate(e, within=("g",)))
    assert got == ran(entity.propagate(e.drop("g"))) and len(got) == 15


def test_matching_spares_the_driver(spark, sf):
    # every broadcast is a table, a job and a thread of the driver
    plan = QUERIES["p7_found"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_unsettled_messages_are_marked(spark):
    edges = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 0.5), ("b", "y", 1.5), ("c", "z", 1.0)], "u string, v string, s double")
    few = {(r["u"], r["v"]): r["settled"] for r in entity.propagate(edges, tolerance=1e-9, rounds=2).collect()}
    assert few["c", "z"] and not few["a", "y"]
    assert all(r["settled"] for r in entity.propagate(edges).collect())


def test_match_cases(spark):
    left = [("s1", "F1", "藍矢里小学校", 31.5, 130.5), ("s2", "F1", "藍矢里小", 31.5002, 130.5001), ("s3", "F1", "藍矢里小学校", 31.6, 130.5), ("s4", "F1", None, 31.5, 130.5), ("s5", "F1", " ", 31.5, 130.5), ("s6", None, "藍矢里小学校", 31.5, 130.5),
            ("s7", "F2", "藍矢里小学校", 31.5, 130.5), ("s8", "F1", "柏木岡車庫", None, None), ("s9", "F1", "桜車越温泉", 130.55, 31.55), ("s1", "F1", "藍矢里小学校", 31.5, 130.5)]
    right = [("1", "樫門交通(株)", "藍矢里小学校前", None, 31.5001, 130.5), ("2", "樫門交通", "藍里小学校", None, 31.5, 130.5001), ("3", None, "藍矢里小学校", None, 31.6, 130.5002), ("4", "樫門交通", "柏木岡車庫", None, 31.7, 130.7),
             ("5", "樫門交通", "桜車越温泉", None, 31.55, 130.55), ("6", "樫門交通", None, None, 31.5, 130.5), ("7", "樫門交通", "桜車越農協前", None, 31.55, 130.55), ("8", None, "藍矢里小学校", None, None, None), ("9", None, "藍矢里小学校", None, 130.5, 31.6)]
    agencies = [("F1", "樫門交通株式会社"), ("F2", "Norpowick Verkehr"), (None, None)]
    a = spark.createDataFrame(left, "id string, feed string, name string, lat double, lon double")
    b = spark.createDataFrame(right, "id string, op string, name string, reading string, lat double, lon double")
    c = spark.createDataFrame(agencies, "feed string, agency string")
    m = lambda x, y: entity.match(x, "id", "feed", "name", "lat", "lon", y, "id", "op", "name", "reading", "lat", "lon", c, "agency")
    got = {(r["left_id"], r["right_id"]) for r in m(a, b).where("confidence >= 0.5").collect()}
    assert got == {("s1", "1"), ("s2", "1"), ("s1", "2"), ("s2", "2"), ("s3", "3"), ("s3", "9"), ("s8", "4"), ("s9", "5")}
    assert m(a.limit(0), b).count() == 0 and m(a, b.limit(0)).count() == 0


def test_queries_run(spark, sf):
    for k, q in QUERIES.items():
        assert q(spark, sf).count() >= 0, k
    assert not set(SQL) - set(QUERIES)
