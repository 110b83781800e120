import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import leakage, lookalike, packing, prose


def test_union_find_is_transitive_and_frequency_picks():
    m = lookalike.classes({"a": 5, "а": 9, "ａ": 1}, ["aа"])
    assert m["a"] == "а" and m["ａ"] == "а" and "а" not in m


def test_rewrite_longest_first_and_unseen_gone():
    m = lookalike.classes({"ガ": 3, "ｶﾞ": 1, "カ": 2, "力": 1})
    a = lookalike.automaton(m)
    assert lookalike.rewrite("ｶﾞ​力　 x ", a) == lookalike.rewrite("ガカ x", a)
    assert lookalike.rewrite("​ 　", a) == ""


def test_the_usual_writing_represents_its_class(spark):
    names = ["車庫"] * 5 + ["⾞庫"] + ["ö"] * 3 + ["o\u0308"] + ["5キロ"] * 2 + ["5㌔"]
    m = lookalike.learn(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    assert m["⾞"] == "車" and m["o\u0308"] == "ö" and "車" not in m and "ö" not in m and m["㌔"] == "キロ"


def test_clusters_that_no_class_knows_take_their_plain_form():
    m = lookalike.classes({"ö": 5, "o\u0308": 1, "㌔": 9, "キロ": 1})
    a, known = lookalike.automaton(m), frozenset(m) | frozenset(m.values())
    assert lookalike.rewrite("㌔ ㍉ e\u0301", a, known) == lookalike.rewrite("キロ ミリ é", a, known) == "㌔ ミり é"


def test_rewriting_goes_on_until_nothing_changes():
    chain = {chr(0x100 + i): chr(0x101 + i) for i in range(40)}
    assert lookalike.rewrite("\u0100", lookalike.automaton(chain)) == chr(0x100 + 40)
    assert lookalike.rewrite("ab", lookalike.automaton({"a": "b", "b": "a"})) == "ab"


def test_rare_clusters_beyond_the_drivers_share(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "MOST_CLUSTERS", 1)
    rows = [("f", "1", "é駅"), ("f", "2", "e\u0301駅"), ("f", "3", "ミリ ミリ"), ("f", "4", "㍉ ㍉"), ("f", "5", "㍉ ミリ")]
    got = {tuple(r) for r in lookalike.same_look(spark.createDataFrame(rows, "feed string, k string, name string"), "feed", "k", "name").collect()}
    assert got == {("1", "2"), ("3", "4"), ("3", "5"), ("4", "5")}


def test_many_passages_are_searched_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, "".join(rng.choice("abcdefgh") for _ in range(90))) for i in range(9)]
    docs = [(i, "x " + t[5:70] + " y") for i, t in items] + [(100, "ｶﾞ"), (101, "")]
    d, q = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item long, text string")
    want = {tuple(r) for r in leakage.leaks(d, q, "doc", "text", "item", "text").collect()}
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 4)
    assert {tuple(r) for r in leakage.leaks(d, q, "doc", "text", "item", "text").collect()} == want and len(want) == 9


NAMES = "feed string, k string, name string, feed_extra string"


def test_same_look_cases(spark):
    rows = [
        ("f", "1", "Town Hall", "x"), ("f", "2", "Tоwn Hall", None), ("f", "3", "town Hall", ""), ("f", "4", "TownHall", ""), ("f", "5", "Town  Hall ", ""), ("g", "6", "Тown Hall", ""),
        ("f", "7", None, ""), ("f", "8", " ", ""), ("f", "9", "　", ""), (None, "10", "Town Hall", ""), ("f", "2", "Tоwn Hall", None), ("f", "11", "Town Hall", ""),
        ("f", "12", "ロータリー", ""), ("f", "13", "口－タリ一", ""), ("f", "14", "Müller", ""), ("f", "15", "Müller", ""), ("f", "16", "Muller", ""),
    ]
    got = {tuple(r) for r in lookalike.same_look(spark.createDataFrame(rows, NAMES), "feed", "k", "name").collect()}
    assert got == {("1", "2"), ("1", "5"), ("2", "5"), ("11", "2"), ("11", "5"), ("12", "13"), ("14", "15")}
    assert lookalike.same_look(spark.createDataFrame([], NAMES), "feed", "k", "name").count() == 0


def _letters(t):
    return "".join(c for c in unicodedata.normalize("NFKC", t).lower() if unicodedata.category(c)[0] in "LN")


def _brute(text, item, run):
    a, b = _letters(text), _letters(item)
    return any(b[i : i + run] in a for i in range(len(b) - run + 1))


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgé日本語のは") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(40)) for i in range(12)] + [(50, None), (51, ""), (52, "short"), (53, items_dup := text(40)), (54, items_dup)]
    docs = []
    for i in range(60):
        item = items[rng.randrange(12)][1]
        at, n = rng.randrange(len(item) // 2), rng.randint(30, 110)
        piece = item[at : at + n].upper() if i % 3 else ". ".join(item[at : at + n])
        docs.append((i, text(rng.randint(0, 60)) + "\n" + piece + "\n" + text(20)))
    docs += [(100, None), (101, ""), (102, items[0][1] * 400), (102, items[0][1] * 400), (None, items[0][1]), (103, items_dup)]
    d, q = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item long, text string")
    got = leakage.leaks(d, q, "doc", "text", "item", "text")
    assert {(r["doc"], r["item"]) for r in got.where("longest_run >= 50").collect()} == {(i, j) for i, t in docs for j, p in items if i is not None and t and p and _brute(t, p, 50)}
    assert got.count() == got.select("doc", "item").distinct().count()
    assert leakage.leaks(d.limit(0), q, "doc", "text", "item", "text").count() == 0
    assert leakage.leaks(d, q.limit(0), "doc", "text", "item", "text").count() == 0


def test_runs_are_aligned_and_equal_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdeé日本語") for _ in range(n))
    items = [(i, text(150)) for i in range(8)] + [(20, text(30)), (21, None)]
    docs = [(k, text(200) + t[20 : 20 + n] + text(30)) for k, (t, n) in enumerate((items[i % 8][1], n) for i, n in enumerate(range(40, 62)))] + [(90, items[3][1] * 9), (91, None)]
    d, q = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item long, text string")
    got = {(r["doc"], r["item"]): r for r in leakage.leaks(d, q, "doc", "text", "item", "text", align=False).collect()}
    assert {k for k, r in got.items() if r["longest_run"] >= 50} == {(i, j) for i, t in docs for j, p in items if t and p and _brute(t, p, 50)}
    assert all(r["score"] >= 2 * r["longest_run"] for r in got.values())
    assert leakage.leaks(d, q.limit(0), "doc", "text", "item", "text", align=False).count() == 0
    assert leakage.leaks(d.limit(0), q, "doc", "text", "item", "text", align=False).count() == 0


def test_seeds_are_rare_in_the_corpus(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(77))
    texts = [passage[:50]] * 3 + [passage[25:]] + [passage[:27] + passage[53:]]
    p = leakage.letters([passage])[0]
    h = leakage.window_hashes(p, 24)
    known = np.unique(h)
    often = leakage.frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), "text", known, 24)
    want = [sum(t.count(passage[k : k + 24]) for t in texts) for k in range(len(h))]
    assert often[np.searchsorted(known, h)].tolist() == want
    seeds, where = leakage.choose_seeds([p], 50, 24, known, often)
    # every stretch of 27 window starts holds the rarest of its windows
    assert all(any(s <= j < s + 27 and want[j] == min(want[s : s + 27]) for j in where[:, 1]) for s in range(len(h) - 26))
    assert (seeds == h[where[:, 1]]).all()


def test_alignment_scores_edited_copies():
    rng = random.Random(1)
    p = np.array([rng.randrange(97, 123) for _ in range(200)], np.uint32)
    edited = np.delete(p, [40, 90]).copy()
    edited[[10, 60, 120]] = 1
    noise = np.array([rng.randrange(97, 123) for _ in range(200)], np.uint32)
    text = np.concatenate([noise, edited])
    good, bad, whole = leakage.smith_waterman([(text, p, 200), (noise, p, 0), (p, p, 0)])
    assert whole == 2 * len(p) and good > 1.6 * len(p) and bad < 80


@pytest.mark.parametrize("step", [12, 20, 25, 40])
def test_evenly_edited_copies_are_scored(spark, step):
    rng = random.Random(step)
    items = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(183))) for i in range(20)]
    edit = lambda t: "".join("9" if k % step == step - 1 else c for k, c in enumerate(t))
    noise = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))
    docs = [(i, noise() + edit(t) + noise()) for i, t in items]
    got = leakage.leaks(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item long, text string"), "doc", "text", "item", "text").collect()
    # brute force: every edited letter costs a mismatch instead of a match
    assert {(r["doc"], r["item"], r["longest_run"]) for r in got} == {(i, i, step - 1) for i, _ in items}
    assert all(r["score"] >= 2 * (183 - 183 // step) - 2 * (183 // step) for r in got)


def test_window_hashes_agree_for_equal_windows():
    x = np.array([1, 2, 3, 4, 5] * 3, np.uint32)
    for w in (1, 3, 5, 7):
        h = leakage.window_hashes(x, w)
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (x[i : i + w].tolist() == x[j : j + w].tolist())


PROSE = "なお、朝の増便は祭りの人出を見込んで誰も降りない日が増えています。今回の見直しでは、循環線の車両は小型の車に替わりました。運転士の話では、工事のため時刻を変えるよう案内したことです。"
ENGLISH = "The first bus from the depot has been moved across the road, which the council accepted. After the second count the ticket counter is staffed only on market days because the lights were retimed."


@pytest.mark.parametrize("text, kind", [
    (PROSE, True), (ENGLISH, True), (ENGLISH.lower().replace(".", ""), True), ("「" + PROSE + "」\n" + "| 駅 | 8:00 | 9:00 |", True), ("\n".join(PROSE[i : i + 20] for i in range(0, len(PROSE), 20)), True),
    ("\n".join(f"鷺釜峰公民館前,{h}:00,{h}:20,レ" for h in range(6, 20)), False), ("Home | News | Fares\n" * 9, False), (" ".join(PROSE), False), ("\n".join("1234 5678 90" for _ in range(9)), False),
    ((PROSE.split("。")[0] + "。") * 20, False), (ENGLISH[::-1], False), ("zone: 12\nstop_name: Depot\nroute_id: X1\n" * 5, False), ("#$%&|~_=-" * 30, False), (ENGLISH.encode().hex(), False),
])
def test_prose_and_junk(spark, text, kind):
    terms = spark.read.parquet("/root/testdata/sf0.001/common_terms.parquet")
    r = prose.statistics(spark.createDataFrame([(1, text)], "i long, t string"), "i", "t", terms).withColumn("prose", prose.is_prose()).first()
    assert r["prose"] is kind, r


def test_repeated_fragments_fill_a_text(spark):
    terms = spark.read.parquet("/root/testdata/sf0.001/common_terms.parquet")
    line = PROSE.split("。")[0]
    texts = ["新茅布川工業団地 " * 30, "stop desk " * 40, (line + "\n") * 12, PROSE, ENGLISH, ""]
    got = prose.statistics(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t", terms).withColumn("prose", prose.is_prose()).orderBy("i").collect()
    assert all(r["top_fragment"] > 0.9 and not r["prose"] for r in got[:3])
    assert all(r["top_fragment"] < 0.3 and r["prose"] for r in got[3:5]) and got[5]["top_fragment"] == 0


def test_all_terms_count():
    """Terms of one kana, of kanji and of more than 12 letters, against a count by hand."""
    terms = prose.Terms(["の", "停留所", "から", "notwithstanding", "Über", "", None, "ab"])
    texts = ["のxから停留所のの", "notwithstanding über abc ab", "停留からの所", "", "NOTWITHSTANDING"]
    got = prose.measure(texts, terms)
    assert got["common_share"].round(6).tolist() == [round(8 / 9, 6), round(21 / 24, 6), round(3 / 6, 6), 0.0, 1.0]


def _dominant(text):
    """Brute force: coverage of the most frequent n-gram of characters and of words."""
    flat = re.sub(r"\s+", " ", text)
    total, best = len(flat.replace(" ", "")), 0
    units = [(list(flat), n) for n in prose.CHARACTERS] + [(flat.split(), n) for n in prose.WORDS]
    for seq, n in units:
        grams = [tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)]
        times = {g: grams.count(g) for g in set(grams)}
        top = max(times.values(), default=0)
        if top < 3:
            continue
        for g in (g for g, k in times.items() if k == top):
            under = {i + j for i, h in enumerate(grams) if h == g for j in range(n)}
            best = max(best, sum(len(seq[i].strip()) for i in under))
    return best / total if total else 0.0


def test_dominant_equals_brute_force():
    rng = random.Random(11)
    texts = ["", "a", "abcabcabcabc", "x y x y x y z"]
    for _ in range(60):
        piece = "".join(rng.choice("abc 日本\n") for _ in range(rng.randint(1, 20)))
        texts.append("".join(piece if rng.random() < 0.5 else rng.choice("abcd ") for _ in range(rng.randint(1, 40))))
    got = prose.measure(texts, prose.Terms([]))["top_fragment"]
    for t, g in zip(texts, got, strict=True):
        assert g >= _dominant(t) - 1e-9 and (g <= _dominant(t) + 1e-9 or g == prose._repetition(t)[2]), t


def test_statistics_edges(spark):
    terms = spark.createDataFrame([("en", "the"), ("ja", "です"), (None, None)], "lang string, term string")
    rows = [(1, None), (2, ""), (3, " \n　"), (None, "the"), (4, "the the x"), (4, "the the x"), (5, "a" * 300_000), (6, "\x00\x00")]
    got = prose.statistics(spark.createDataFrame(rows, "i long, t string"), "i", "t", terms).orderBy("i").collect()
    assert [(r["i"], r["n_chars"]) for r in got] == [(2, 0), (3, 0), (4, 7), (4, 7), (5, 300_000), (6, 0)]
    assert got[2]["n_words"] == 3 and abs(got[2]["common_words"] - 2 / 3) < 1e-9 and got[2]["mean_word_length"] == 7 / 3
    assert prose.statistics(spark.createDataFrame([], "i long, t string"), "i", "t", terms).count() == 0


def test_length_buckets_are_optimal():
    rng = random.Random(5)
    hist = np.zeros(12, np.int64)
    for _ in range(40):
        hist[rng.randint(1, 11)] += 1
    pad = lambda bounds: sum(n * (min(b for b in bounds if b >= i) - i) for i, n in enumerate(hist) if n)
    from itertools import combinations

    top = int(np.flatnonzero(hist).max())
    for k in (1, 2, 3, 4):
        best = min(pad([*c, top]) for r in range(k) for c in combinations(range(1, top), r))
        got = packing.length_buckets(hist, k)
        assert len(got) <= k and pad(got) == best
    assert packing.length_buckets(np.zeros(5, np.int64), 3) == []


def test_pack_places_everything_once(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice([1, 5, 64, 64, 64, 37, 90, 100, 250, 0])) for i in range(3000)]
    items = packing.pieces(spark.createDataFrame(docs, "doc long, tokens long"), "doc", 100)
    got = packing.pack(items, "doc", 100)
    rows = got.collect()
    assert sum(r["tokens"] for r in rows) == sum(n for _, n in docs) and len(rows) == len({(r["doc"], r["piece"]) for r in rows}) == items.count()
    per = {}
    for r in rows:
        per[r["window"]] = per.get(r["window"], 0) + r["tokens"]
    assert max(per.values()) <= 100 and all(r["piece"] == 0 for r in rows if dict(docs)[r["doc"]] <= 100)
    rooms: list[int] = []
    for n in sorted((r["tokens"] for r in rows), reverse=True):  # best fit decreasing, one item at a time
        fit = min((room for room in rooms if room >= n), default=None)
        rooms.append(100 - n) if fit is None else rooms.__setitem__(rooms.index(fit), fit - n)
    assert len(per) <= len(rooms) * 1.01
    hist = packing.histogram(items, 100)
    b = packing.batches(items, "doc", packing.length_buckets(hist, 4), 100)
    assert b.count() == items.count() and b.groupBy("bound", "batch").agg((F.count("*") * F.first("bound")).alias("n")).where("n > 100").count() == 0
    assert packing.pack(items.limit(0), "doc", 100).count() == 0


def test_long_groups_are_ranked_over_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 100)
    items = packing.pieces(spark.range(3000).select(F.col("id").alias("doc"), F.when(F.col("id") % 3 == 0, 40).when(F.col("id") % 3 == 1, 900).otherwise(100).cast("long").alias("tokens")), "doc", 100)
    rows = packing.pack(items, "doc", 100).collect()
    per: dict[int, int] = {}
    for r in rows:
        per[r["window"]] = per.get(r["window"], 0) + r["tokens"]
    assert len(rows) == 1000 + 9000 + 1000 == len({(r["doc"], r["piece"]) for r in rows})
    assert max(per.values()) == 100 and len(per) == 9000 + 1000 + 500
    b = packing.batches(items, "doc", [40, 100], 100)
    assert b.groupBy("bound", "batch").count().where(F.col("count") > F.floor(100 / F.col("bound"))).count() == 0 and b.count() == 11000


def test_window_query(spark, sf):
    from tramline.llm.queries import p8_windows

    got = p8_windows(spark, sf)
    per = got.groupBy("window").agg(F.sum("tokens").alias("n")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    assert got.columns == ["doc_id", "piece", "first_token", "tokens", "window"] and per[0] <= 2048 and per[1] / (per[2] * 2048) > 0.95


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_windows_of_documents(spark, sf, name):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = packing.windows(docs, "doc_id", "text", public_tokenizers.path(name))
    per = got.groupBy("window").agg(F.sum("tokens").alias("n")).agg(F.max("n"), F.sum("n"), F.count("*")).first()
    assert per[0] <= 2048 and per[1] / (per[2] * 2048) > 0.95
