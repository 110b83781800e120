"""Records of two sources that describe the same things, without a common key.

Records of each side are gathered into units (one operator's place of one name), slips are merged into the unit they
stand beside, and candidate pairs are scored by name, operator and position. Where pairs compete, loopy belief
propagation with one-to-one factors runs through window sums until the messages settle; the marginals are the confidences.

A broadcast costs the driver a table, a job and a thread each, and there are dozens of joins on small sides here; they are
hinted as merges (``_merged``), and rows are spread once for all steps that share a key.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.spatial import placed, sphere_m
from ..runtime import cut, discard, maybe_broadcast
from .names import fold, parse

APART_M = 1000.0
GAP_DEG = 0.005
PARTS = "kind string, direction string, stem string, facility string, number string, drops array<string>"
# Words that tell the kinds of Japanese operators.
KINDS = r"(.+?)(市|町|村|観光|交通)"


def _merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join through shuffle and sort at any size."""
    return left.join(right.hint("merge"), on, how)


def drops(stem: str) -> list[str]:
    """The stem and all its spellings with one character left out: strings one slip apart share one of them."""
    return sorted({stem, *(stem[:i] + stem[i + 1 :] for i in range(len(stem)))}) if stem else [""]


def parts_udf():
    @pandas_udf(PARTS)
    def parts(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            p = parse(t) if t is not None else None
            rows.append((p.kind, p.direction, p.stem, p.facility, p.number, drops(p.stem)) if p else (None,) * 6)
        return pd.DataFrame(rows, columns=["kind", "direction", "stem", "facility", "number", "drops"])

    return parts


def operator_key(name: str | None) -> str | None:
    """The part of an operator's name that all its spellings share: place and kind in Japanese, first word in English."""
    if name is None or not name.strip():
        return None
    t = fold(name).lower()
    if (m := regex.match(KINDS, t)) and regex.search(r"\p{Han}", t):
        return m.group(1) + m.group(2)
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    return regex.split(r"[\s\-]+", t.strip())[0]


def operator_udf():
    @pandas_udf("key string, drops array<string>")
    def key(s: pd.Series) -> pd.DataFrame:
        keys = [operator_key(t) for t in s]
        return pd.DataFrame({"key": keys, "drops": [drops(k) if k and len(k) > 5 else [k] if k else None for k in keys]})

    return key


def operators_of(names: DataFrame, name: str, agencies: DataFrame, owner: str, agency_name: str) -> DataFrame:
    """(name, owner): owners whose name a free-entered operator name stands for; of slips, the nearest. Several owners of one name all count."""
    k = operator_udf().asNondeterministic()  # keeps the optimiser from evaluating it once per field
    a = agencies.where(F.col(owner).isNotNull()).select(F.col(owner).alias("owner"), k(agency_name).alias("k")).where("k.key is not null").distinct()
    n = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct().select("name", k("name").alias("k")).where("k.key is not null")
    # a written operator that runs two words into one still begins with the owner's key
    left = n.select("name", F.col("k.key").alias("key"), F.explode("k.drops").alias("d"))
    right = a.select("owner", F.col("k.key").alias("key2"), F.explode("k.drops").alias("d"))
    e = _merged(left, right, "d").select("name", "owner", F.when(F.col("key") == F.col("key2"), 0).otherwise(F.levenshtein("key", "key2")).alias("e")).where("e <= 2").distinct()
    long = _merged(n.where(F.length("k.key") > 12), e.select("name").distinct(), "name", "left_anti").select("name", F.col("k.key").alias("key"))
    heads = long.select("name", "key", F.explode(F.sequence(F.lit(6), F.length("key") - 1)).alias("at")).select("name", F.expr("left(key, at)").alias("key2"))
    run_on = _merged(heads, a.select("owner", F.col("k.key").alias("key2")), "key2").select("name", "owner", F.lit(1).alias("e"))
    e = e.unionAll(run_on)
    w = W.partitionBy("name")
    return e.withColumn("least", F.min("e").over(w)).where("e = least").select("name", "owner").distinct()


def _turned(df: DataFrame, lat: str, lon: str, owner: str, centres: DataFrame) -> DataFrame:
    """Positions with swapped coordinates turned back; positions that are nowhere, or 5 degrees off their owner, become null."""
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    some = la.isNotNull() & lo.isNotNull() & ~F.isnan(la) & ~F.isnan(lo) & ~((la == 0) & (lo == 0)) & (F.abs(la) <= 180) & (F.abs(lo) <= 180)
    near = lambda y, x: (F.abs(y - F.col("clat")) <= 5) & (F.abs(x - F.col("clon")) <= 5)
    unknown = F.col("clat").isNull()
    y = F.when(some & (near(la, lo) | unknown & (F.abs(la) <= 90)), la).when(some & (near(lo, la) | unknown & (F.abs(lo) <= 90)), lo)
    x = F.when(some & (near(la, lo) | unknown & (F.abs(la) <= 90)), lo).when(some & (near(lo, la) | unknown & (F.abs(lo) <= 90)), la)
    return df.join(centres, owner, "left").withColumn("y", y).withColumn("x", x).drop("clat", "clon")


def _units(records: DataFrame) -> DataFrame:
    """``records`` with ``place``: the number of the position cluster within owner and name parts.

    Clusters are gaps and islands, by latitude and then by longitude. Records without a position join the cluster of
    their name if there is one only; else they stand alone as cluster -1.
    """
    key = ["owner", "kind", "direction", "stem", "facility", "number"]
    w = W.partitionBy(*key).orderBy("y", "x", "id")
    all_rows = records.withColumn("row", F.sum(F.coalesce((F.col("y") - F.lag("y").over(w) > GAP_DEG).cast("int"), F.lit(0))).over(w))
    w2 = W.partitionBy(*key, "row").orderBy("x", "y", "id")
    all_rows = all_rows.withColumn("col", F.sum(F.coalesce((F.col("x") - F.lag("x").over(w2) > GAP_DEG).cast("int"), F.lit(0))).over(w2))
    # records without a position come first in both orders, and leave no gap
    all_rows = all_rows.withColumn("place", F.when(F.col("y").isNotNull(), F.col("row").cast("long") * 2**31 + F.col("col"))).drop("row", "col")
    of_name = W.partitionBy(*key)
    p1, p2 = F.min("place").over(of_name), F.max("place").over(of_name)
    return all_rows.withColumn("only", F.when(p1 == p2, p1)).withColumn("place", F.coalesce("place", "only", F.lit(-1))).drop("only")


def _slip(a: str, b: str) -> Column:
    """Whether two stems are one insertion, deletion, replacement or transposition apart, given that they share a drop."""
    x, y = F.col(a), F.col(b)
    swapped = (F.length(x) == F.length(y)) & (F.levenshtein(x, y) == 2) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, "")))
    return (F.levenshtein(x, y) == 1) | swapped


def _merge_slips(units: DataFrame, summary: DataFrame) -> DataFrame:
    """unit -> lead: a unit beside a larger one of the same owner and facility with nearly its name takes that one's place.

    With both positions known, beside is 150 m and nearly is two slips (one on each side); else one slip is allowed.
    """
    key = ["owner", "kind", "direction", "facility", "number"]
    cell = lambda c: F.floor(F.col(c) * 400).cast("long")
    around = lambda c: F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1))
    base = summary.select("unit", *key, "stem", "y", "x", "n", "drops")
    other = base.select(*key, F.col("unit").alias("unit2"), F.col("stem").alias("stem2"), F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("n").alias("n2"), F.col("drops").alias("drops2"))
    # a longitude cell covers 150 m up to 57 degrees of latitude
    placed_here = base.where("y is not null").withColumn("cy", around("y")).withColumn("cx", around("x"))
    near = _merged(placed_here, other.where("y2 is not null").withColumn("cy", cell("y2")).withColumn("cx", cell("x2")), [*key, "cy", "cx"])
    near = near.where((F.levenshtein("stem", "stem2") <= F.when(F.least(F.length("stem"), F.length("stem2")) >= 3, 2).otherwise(1)) & (sphere_m(F.col("y"), F.col("x"), F.col("y2"), F.col("x2")) <= 150))
    loose = _merged(base.withColumn("d", F.explode("drops")), other.withColumn("d", F.explode("drops2")), [*key, "d"]).where("y is null or y2 is null").where(_slip("stem", "stem2"))
    cols = ["unit", "unit2", "stem", "stem2", "n", "n2", "y2"]
    larger = (F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("stem2") < F.col("stem")))
    both = near.select(*cols).unionAll(loose.select(*cols)).where("stem <> stem2").where(larger)
    lead = cut(both.groupBy("unit").agg(F.max_by("unit2", F.struct(F.col("y2").isNotNull(), "n2", "unit2")).alias("lead")))
    # leads run towards larger units, so following them twice more ends all chains of slips of one place
    for _ in range(2):
        further = lead.select(F.col("unit").alias("lead"), F.col("lead").alias("next"))
        lead = _merged(lead, further, "lead", "left").select("unit", F.coalesce("next", "lead").alias("lead"))
    return _merged(units, lead, "unit", "left").withColumn("unit", F.coalesce("lead", "unit")).drop("lead")


def _summary(units: DataFrame, *most: str) -> DataFrame:
    """One row a unit: its commonest name parts, middle position and number of records; and the greatest value of the columns ``most``."""
    key = ["kind", "direction", "stem", "facility", "number"]
    by_name = units.repartition("unit").groupBy("unit", "owner", *key).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum("x").alias("sx"), F.count("y").alias("ny"), F.first("drops").alias("drops"), *(F.max(c).alias(c) for c in most))
    top = F.max_by(F.struct(*key, "drops"), F.struct("n", "stem")).alias("t")
    u = by_name.groupBy("unit", "owner").agg(top, F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("sx").alias("sx"), F.sum("ny").alias("ny"), *(F.max(c).alias(c) for c in most))
    return u.select("unit", "owner", "t.*", "n", *most, F.when(F.col("ny") > 0, F.col("sy") / F.col("ny")).alias("y"), F.when(F.col("ny") > 0, F.col("sx") / F.col("ny")).alias("x"))


def propagate(edges: DataFrame, tolerance: float = 5e-3, rounds: int = 400, every: int = 4, within: tuple[str, ...] = ()) -> DataFrame:
    """(u, v, s, p, settled): marginal p of each edge (u, v, s) under one-to-one factors on both sides; s is the log-odds of the edge by itself.

    The message of u to v is s - log(1 + sum of exp over u's other incoming messages), and likewise back; edges that
    compete with none are settled at once. Messages are damped by half, and stop when none moves by ``tolerance``; what
    still moves after ``rounds`` comes out with ``settled`` false. All edges of a u, and all of a v, agree in the columns
    ``within``: rows spread by those are shuffled once for ``every`` rounds instead of twice a round.
    """
    du, dv = W.partitionBy(*within, "u"), W.partitionBy(*within, "v")
    spread = lambda df: df.repartition(*within) if within else df
    e = spread(edges).withColumn("nu", F.count(F.lit(1)).over(du)).withColumn("nv", F.count(F.lit(1)).over(dv))
    e = cut(e)
    sole = e.where("nu = 1 and nv = 1").select("u", "v", "s", (1 / (1 + F.exp(-F.col("s")))).alias("p"), F.lit(True).alias("settled"))
    m = e.where("nu > 1 or nv > 1").select(*within, "u", "v", "s", F.col("s").alias("muv"), F.col("s").alias("mvu"))
    if m.isEmpty():
        return sole
    cap = lambda c: F.exp(F.least(F.greatest(c, F.lit(-30.0)), F.lit(30.0)))
    written, m = None, spread(m)
    for k in range(rounds):
        inu = F.greatest(F.sum(cap(F.col("mvu"))).over(du) - cap(F.col("mvu")), F.lit(0.0))
        inv = F.greatest(F.sum(cap(F.col("muv"))).over(dv) - cap(F.col("muv")), F.lit(0.0))
        nxt = m.withColumn("a", F.col("s") - F.log(1 + inu)).withColumn("b", F.col("s") - F.log(1 + inv))
        move = F.greatest(F.abs(F.col("a") - F.col("muv")), F.abs(F.col("b") - F.col("mvu"))).alias("move")
        m = nxt.select(*within, "u", "v", "s", ((F.col("a") + F.col("muv")) / 2).alias("muv"), ((F.col("b") + F.col("mvu")) / 2).alias("mvu"), move)
        if k % every == every - 1 or k == rounds - 1:
            before, m = written, cut(m)
            if before is not None:
                discard(before)
            written = m
            if (m.agg(F.max("move")).first()[0] or 0) < tolerance:
                break
            if k < rounds - 1:
                m = spread(m)
        if k < rounds - 1:
            m = m.drop("move")
    belief = F.col("muv") + F.col("mvu") - F.col("s")
    return sole.unionAll(m.select("u", "v", "s", (1 / (1 + F.exp(-belief))).alias("p"), (F.col("move") < tolerance).alias("settled")))


def match(
    left: DataFrame, left_id: str, left_owner: str, left_name: str, left_lat: str, left_lon: str,
    right: DataFrame, right_id: str, right_owner_name: str, right_name: str, right_reading: str, right_lat: str, right_lon: str,
    agencies: DataFrame, agency_name: str, readings: DataFrame | None = None,
) -> DataFrame:
    """(left_id, right_id, confidence, settled): records of the same owner's same place; all records of matched units pair up.

    Left records with a null owner, and records of either side with a null or blank name, match nothing. Right records
    with an unknown owner are tried with every owner within reach of their position, and match nothing without one. A
    position that is missing or impossible neither helps nor hinders. Rows repeated under one id count once; a name in
    kana stands for the name that the right side's readings, or ``readings`` (name, reading), give it.
    """
    parts = parts_udf().asNondeterministic()
    lraw = left.select(F.col(left_id).cast("string").alias("id"), F.col(left_owner).cast("string").alias("owner"), F.col(left_name).alias("name"), F.col(left_lat).alias("la"), F.col(left_lon).alias("lo")).distinct().where("id is not null and owner is not null and name is not null")
    rraw = right.select(F.col(right_id).cast("string").alias("id"), F.col(right_owner_name).alias("op"), F.col(right_name).alias("name"), F.col(right_reading).alias("reading"), F.col(right_lat).alias("la"), F.col(right_lon).alias("lo")).distinct().where("id is not null and name is not null")
    known_readings = rraw.select("name", "reading")
    if readings is not None:
        known_readings = known_readings.unionAll(readings.select("name", "reading"))
    known_readings = known_readings.where("reading is not null and name is not null")
    names = lraw.select("name").unionAll(rraw.select("name")).unionAll(known_readings.select("name")).distinct().select("name", parts("name").alias("p")).where("p.kind is not null")
    names = cut(names)
    # kana names by the readings written beside names
    read = _merged(known_readings.groupBy("reading", "name").agg(F.count(F.lit(1)).alias("n")), names, "name").where("p.kind <> 'kana'")
    read = read.select(parts("reading")["stem"].alias("kana"), "p", "n").groupBy("kana", "p").agg(F.sum("n").alias("n")).groupBy("kana").agg(F.max_by("p", F.struct("n", F.col("p.stem"))).alias("kp"))
    names = _merged(names, read, (F.col("p.kind") == "kana") & (F.col("p.stem") == F.col("kana")), "left").select("name", F.coalesce("kp", "p").alias("p"))
    names = cut(names.select("name", "p.*"))
    good = lraw.where(placed(lraw, "la", "lo")).groupBy("owner").agg(F.percentile_approx("la", 0.5).alias("clat"), F.percentile_approx("lo", 0.5).alias("clon"))
    good = maybe_broadcast(cut(good), 100_000)
    lrec = _merged(_turned(lraw, "la", "lo", "owner", good), names, "name")
    cols = ["id", "owner", "y", "x", "kind", "direction", "stem", "facility", "number", "drops"]
    unit = F.concat_ws("|", "owner", "kind", "direction", "stem", "facility", "number", "place")
    lu = cut(_units(lrec.select(*cols)).select("id", unit.alias("unit"), "owner", "y", "x", "kind", "direction", "stem", "facility", "number", "drops"))
    lu = cut(_merge_slips(lu, cut(_summary(lu))))
    ls = cut(_summary(lu))
    # owners of the right records: by the operator's name, or every owner with a unit near enough
    owners = cut(operators_of(rraw, "op", agencies, left_owner, agency_name))
    named = _merged(rraw, owners, rraw["op"] == owners["name"], "left").drop(owners["name"])
    known = named.where("owner is not null")
    # without an owner nobody knows which way round a position is: both are tried
    ways = F.array(F.struct(F.col("la").alias("y"), F.col("lo").alias("x")), F.struct(F.col("lo").alias("y"), F.col("la").alias("x")))
    somewhere = lambda p: (F.abs(p["y"]) <= 90) & (F.abs(p["x"]) <= 180) & ((p["y"] != 0) | (p["x"] != 0))
    grid = lambda c, out: F.explode(F.sequence(F.floor(F.col(c) * 50).cast("long") - 1, F.floor(F.col(c) * 50).cast("long") + 1)).alias(out)
    unknown = _merged(named.where("owner is null"), names, "name").select("*", F.explode(F.filter(ways, somewhere)).alias("at"))
    unknown = unknown.select("*", grid("at.y", "cy")).select("*", grid("at.x", "cx")).select("*", F.explode("drops").alias("d"))
    cells = ls.where("y is not null").select(F.col("owner").alias("owner2"), "kind", "direction", "facility", "number", F.floor(F.col("y") * 50).cast("long").alias("cy"), F.floor(F.col("x") * 50).cast("long").alias("cx"), F.explode("drops").alias("d"))
    guess = _merged(unknown, cells, ["kind", "direction", "facility", "number", "cy", "cx", "d"]).select("id", F.col("owner2").alias("owner"), "name", "la", "lo").distinct()
    rows = known.select("id", "owner", "name", "la", "lo", F.lit(True).alias("sure")).unionAll(guess.select("id", "owner", "name", "la", "lo", F.lit(False).alias("sure")))
    rrec = _merged(_turned(rows, "la", "lo", "owner", good), names, "name")
    ru = cut(_units(rrec.select(*cols, "sure")).select("id", unit.alias("unit"), "owner", "y", "x", "kind", "direction", "stem", "facility", "number", "drops", "sure"))
    ru = cut(_merge_slips(ru, cut(_summary(ru))))
    rs = cut(_summary(ru, "sure"))
    k = ["owner", "kind", "direction", "facility", "number", "d"]
    a = ls.select(*k[:-1], "drops", F.col("unit").alias("u"), F.col("stem").alias("s1"), F.col("y").alias("y1"), F.col("x").alias("x1"))
    b = rs.select(*k[:-1], "drops", F.col("unit").alias("v"), F.col("stem").alias("s2"), F.col("y").alias("y2"), F.col("x").alias("x2"), "sure")
    pairs = _merged(a.withColumn("d", F.explode("drops")).drop("drops"), b.withColumn("d", F.explode("drops")).drop("drops"), k).where((F.col("s1") == F.col("s2")) | _slip("s1", "s2")).drop("d")
    # two slips, one on each side, are allowed where the positions agree
    cell = lambda c: F.floor(F.col(c) * 400).cast("long")
    around = lambda c: F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1))
    a2 = a.drop("drops").where("y1 is not null").withColumn("cy", around("y1")).withColumn("cx", around("x1"))
    b2 = b.drop("drops").where("y2 is not null").withColumn("cy", cell("y2")).withColumn("cx", cell("x2"))
    close = _merged(a2, b2, [*k[:-1], "cy", "cx"]).where((F.levenshtein("s1", "s2") == 2) & (F.least(F.length("s1"), F.length("s2")) >= 3)).where(sphere_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")) <= 150)
    pairs = pairs.unionByName(close.select(*pairs.columns))
    m = sphere_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    by_place = F.when(m.isNull(), 0.0).when(m <= 150, 4.0).when(m <= 300, 2.5).when(m <= APART_M, 0.0)
    by_name = F.when(F.col("s1") == F.col("s2"), 3.0).when(F.levenshtein("s1", "s2") == 1, -0.5).otherwise(-1.5)
    by_owner = F.when(F.col("sure"), 0.5).otherwise(-1.5)
    edges = pairs.where(m.isNull() | (m <= APART_M)).repartition(*k[:-1]).groupBy(*k[:-1], "u", "v").agg(F.max(by_place + by_name + by_owner).alias("s"))
    p = propagate(edges, within=tuple(k[:-1]))
    lm, rm = lu.select(F.col("id").alias("left_id"), F.col("unit").alias("u")).repartition("u").distinct(), ru.select(F.col("id").alias("right_id"), F.col("unit").alias("v"), "sure").repartition("v").distinct()
    met = _merged(p.where("p >= 0.05"), rm, "v")
    # a record whose owner was guessed belongs to the owner it fits best
    met = met.withColumn("best", F.max("p").over(W.partitionBy("right_id"))).where("sure or p = best")
    return _merged(met, lm, "u").groupBy("left_id", "right_id").agg(F.max("p").alias("confidence"), F.bool_and("settled").alias("settled"))
