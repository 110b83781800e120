"""Matching and filling by keys in order of trust, and alignment of trips of two feeds."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions.text import compatible_direction, has_kanji, hiragana


def first_by(df: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order that must be total (first duplicate wins; reverse it for last wins)."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def fill(df: DataFrame, ref: DataFrame, key: str, columns: list[str], source: str) -> DataFrame:
    """Null ``columns`` filled from ``ref`` by an equal key, all together, with ``source`` noted in column source.

    ``ref`` has one row a key. Rows that have values, and rows whose key is null or unknown, stay as they are.
    """
    r = ref.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    j = df.join(r, key, "left")
    need = F.col("__hit")
    for c in columns:
        need = need & F.col(c).isNull()
    for c in columns:
        j = j.withColumn(f"__n_{c}", F.when(need, F.col(f"__{c}")).otherwise(F.col(c)))
    note = F.when(need, source).otherwise(F.col("source") if "source" in df.columns else F.lit(None))
    out = j.withColumn("__note", note)
    keep = [c for c in df.columns if c not in columns and c != "source"]
    return out.select(*keep, *[F.col(f"__n_{c}").alias(c) for c in columns], F.col("__note").alias("source"))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of a target and a candidate, in this order; null if one is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: Similarity of a target and a candidate; marked so that the optimiser evaluates it once per pair.
ratio = pandas_udf(_ratio, DoubleType()).asNondeterministic()


def touching(names: DataFrame, ref: DataFrame, n: int = 2) -> DataFrame:
    """(name, cand): pairs where one holds the other, both of ``n`` characters or more, found by shared grams, not by a cross join.

    The shorter name's first ``n``-gram is in the longer, so each pair meets on a gram of one side's start.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(F.col(c), i, F.lit(n))))
    a, b = names.select("name").where(F.length("name") >= n).distinct(), ref.select("cand").where(F.length("cand") >= n).distinct()
    inside = a.withColumn("g", F.left("name", F.lit(n))).join(b.withColumn("g", F.explode(grams("cand"))), "g").where("contains(cand, name)")
    around = a.withColumn("g", F.explode(grams("name"))).join(b.withColumn("g", F.left("cand", F.lit(n))), "g").where("contains(name, cand)")
    return inside.select("name", "cand").unionAll(around.select("name", "cand")).where("name <> cand").distinct()


def close_by_grams(names: DataFrame, ref: DataFrame, cutoff: float) -> DataFrame:
    """(name, cand) that may reach ``cutoff`` (0.8 or more): they share a pair of characters, ends included, and their lengths and common pairs allow it."""
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.length(c)), lambda i: F.substr(F.concat(F.lit("^"), F.col(c), F.lit("$")), i + 1, F.lit(2))))

    def side(df: DataFrame, c: str, n: str, k: str) -> DataFrame:
        g = df.select(c).where(F.col(c) != "").distinct().withColumn("g", pairs(c))
        return g.select(c, F.length(c).alias(n), (F.length(c) + 1 - F.size("g")).alias(k), F.explode("g").alias("g"))

    # of la + lb characters m match in blocks and the other u do not; u + 1 blocks at most keep m - u - 1 pairs whole,
    # less the pairs that a name repeats
    both = F.col("la") + F.col("lb")
    met = side(names, "name", "la", "ra").join(side(ref, "cand", "lb", "rb"), "g").where(2 * F.least("la", "lb") >= cutoff * both)
    shared = met.groupBy("name", "cand", "la", "lb", "ra", "rb").agg(F.count(F.lit(1)).alias("shared"))
    return shared.where(F.col("shared") >= F.ceil(cutoff * both / 2) - F.floor((1 - cutoff) * both) - 1 - F.col("ra") - F.col("rb")).select("name", "cand")


def cascade(names: DataFrame, ref: DataFrame, threshold: float = 0.8, top: int = 5) -> DataFrame:
    """(name, cand, tier, score) for each distinct name: exact, then prefix or suffix, then substring, then similar.

    A tier is left for the next where its best candidate is under ``threshold``. Later tiers leave out names that
    differ by a direction; ties go to the least candidate. ``ref`` has distinct ``cand``. Null and empty names match nothing.
    """
    words = names.select("name").where("name <> ''").distinct()
    exact = words.join(ref.select(F.col("cand").alias("name")).distinct(), "name").select("name", F.col("name").alias("cand"), F.lit("exact").alias("tier"), F.lit(1.0).alias("score"))
    rest = words.join(exact.select("name"), "name", "left_anti")
    touch = touching(rest, ref).where(compatible_direction(F.col("name"), F.col("cand")))
    ends = F.expr("startswith(name, cand) or endswith(name, cand) or startswith(cand, name) or endswith(cand, name)")
    scored = touch.withColumn("score", ratio("name", "cand")).withColumn("tier", F.when(ends, "prefix_suffix").otherwise("substring"))
    near = close_by_grams(rest, ref, threshold).withColumn("score", ratio("name", "cand")).where(F.col("score") >= threshold)
    near = near.withColumn("rn", F.row_number().over(W.partitionBy("name").orderBy(F.desc("score"), "cand"))).where(F.col("rn") <= top).where(compatible_direction(F.col("name"), F.col("cand"))).withColumn("tier", F.lit("similar"))
    cols = ["name", "cand", "tier", "score"]
    # any prefix or suffix also counts as substring
    both = scored.select(*cols).unionAll(scored.withColumn("tier", F.lit("substring")).select(*cols)).unionAll(near.select(*cols)).where(F.col("score") >= threshold)
    order = F.array_position(F.array(*map(F.lit, ("prefix_suffix", "substring", "similar"))), F.col("tier"))
    best = first_by(both, "name", order, F.desc("score"), "cand")
    return exact.unionAll(best.select(*cols))


def signatures(visits: DataFrame, name: str = "name", time: str = "a") -> DataFrame:
    """One row a trip: its stop names in order as one text, first time, and ordered (name, time)."""
    s = visits.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col(name).alias("n"), F.col(time).alias("t")))).alias("rows"))
    return s.select("trip_id", F.array_join("rows.n", "\x1f").alias("sig"), F.get("rows.t", F.lit(0)).alias("first_time"), "rows")


def align(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Trips of two feeds paired: equal stop sequences, k-th with k-th by first time (as text); leftovers have a null side."""
    w = W.partitionBy("sig").orderBy("first_time", "trip_id")
    a = ours.withColumn("k", F.row_number().over(w)).select("sig", "k", F.col("trip_id").alias("ours"), F.col("rows").alias("rows_a"))
    b = theirs.withColumn("k", F.row_number().over(w)).select("sig", "k", F.col("trip_id").alias("theirs"), F.col("rows").alias("rows_b"))
    return a.join(b, ["sig", "k"], "full").select("ours", "theirs", "rows_a", "rows_b")


def compare_aligned(pairs: DataFrame) -> DataFrame:
    """Position by position: (ours, theirs, pos, name, time_a, time_b, same) of trips paired on both sides."""
    p = pairs.where("ours is not null and theirs is not null").select("ours", "theirs", F.posexplode(F.arrays_zip("rows_a", "rows_b")).alias("pos", "r"))
    return p.select("ours", "theirs", "pos", F.col("r.rows_a.n").alias("name"), F.col("r.rows_a.t").alias("time_a"), F.col("r.rows_b.t").alias("time_b"), F.col("r.rows_a.t").eqNullSafe(F.col("r.rows_b.t")).alias("same"))


def jaccard_groups(df: DataFrame, key: str, group: str, item: str, least: float = 0.6) -> DataFrame:
    """(key, group, leader): groups of items within ``key``, each joined to the first earlier leader it is like.

    The greedy order is by ``group``; one task folds the sets of one key, which must be few (blocks of one document).
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders: list[tuple] = []
        rows = []
        for g, items in sorted(zip(pdf[group], pdf["items"], strict=True), key=lambda x: x[0]):
            s = set(items)
            hit = next((g0 for g0, s0 in leaders if len(s & s0) >= least * len(s | s0)), None)
            if hit is None:
                leaders.append((g, s))
                hit = g
            rows.append((pdf[key].iloc[0], g, hit))
        return pd.DataFrame(rows, columns=[key, group, "leader"])

    kinds = dict(df.dtypes)
    return df.groupBy(key, group).agg(F.collect_set(item).alias("items")).groupBy(key).applyInPandas(fold, f"`{key}` {kinds[key]}, `{group}` {kinds[group]}, leader {kinds[group]}")


def merge_rows(master: DataFrame, trips: DataFrame) -> DataFrame:
    """(trip, pos, row): cells laid onto the master rows greedily by name, each at the first row after the one before.

    ``master``: one array of names; ``trips``: trip, cells (array of names). Cells that fit nowhere get row null.
    """
    names = [r for r in master.first()[0]]

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, cells in zip(pdf["trip"], pdf["cells"], strict=True):
                at = 0
                for i, n in enumerate(cells):
                    hit = next((j for j in range(at, len(names)) if names[j] == n), None)
                    out.append((t, i, hit))
                    at = at if hit is None else hit + 1
            yield pd.DataFrame(out, columns=["trip", "pos", "row"]).astype({"pos": "int32", "row": "Int32"})

    return trips.mapInPandas(lay, "trip string, pos int, row int")


def readings(names: DataFrame, name: str, words: DataFrame, word: str, reading: str) -> DataFrame:
    """(name, reading, whole): readings of names by the longest words of a dictionary, from the left.

    What no word covers is kept, katakana as hiragana; ``whole`` says whether no kanji is left. Each distinct name
    meets the dictionary by its substrings, as long as the longest word, so neither side is broadcast or capped. Of
    several readings of a word the least counts. Null names, words and readings give nothing; an empty name reads empty.
    """
    book = words.where(F.col(word).isNotNull() & (F.col(word) != "") & F.col(reading).isNotNull()).groupBy(F.col(word).alias("w")).agg(F.min(reading).alias("r"))
    longest = book.agg(F.max(F.length("w"))).first()[0] or 0
    n = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    starts = n.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at")).where(F.length("name") > 0)
    parts = starts.select("name", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("name") - F.col("at") + 1))).alias("n")) if longest else starts.withColumn("n", F.lit(0)).limit(0)
    hits = parts.withColumn("w", F.expr("substring(name, at, n)")).join(book, "w")
    best = hits.groupBy("name", "at").agg(F.max_by(F.struct("n", "r"), "n").alias("hit"))
    found = best.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("at", "hit"))).alias("hits"))
    step = lambda acc, i, hit, char: (
        F.when(i < acc["next"], acc)
        .when(hit.isNotNull(), F.struct((i + hit["n"]).alias("next"), F.concat(acc["text"], hit["r"]).alias("text")))
        .otherwise(F.struct((i + 1).alias("next"), F.concat(acc["text"], char).alias("text")))
    )
    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("text"))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda i: i <= F.length("name"))
    read = F.aggregate(at, start, lambda acc, i: step(acc, i, F.try_element_at("hits", i), hiragana(F.substr(F.col("name"), i, F.lit(1)))))["text"]
    out = n.join(found, "name", "left").select("name", read.alias("reading"))
    return out.withColumn("whole", ~has_kanji(F.col("reading")))
