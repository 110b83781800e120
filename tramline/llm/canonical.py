"""Free-entered names mapped to the entries of a reference list.

Reference entries are taken apart like the names and stand in BK-trees, one for each facility, direction and number (a
difference there is another place whatever its distance). The metric is the true Damerau-Levenshtein distance of the
place's own part, so the triangle inequality prunes and every entry within the threshold comes back. Reference lists
beyond the proven broadcast size are sharded: each name meets each shard, and the shards' winners merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS
from .names import distance, fold, parse
from .names import _hiragana as hiragana

THRESHOLD = 1
#: Letters of a reference list up to which it is broadcast whole.
BROADCAST_LETTERS = 20_000_000


class BKTree:
    """Strings with payloads under a true metric."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, word: str, payload: str) -> None:
        if self.root is None:
            self.root = [word, [payload], {}]
            return
        node = self.root
        while True:
            d = distance(word, node[0])
            if d == 0:
                node[1].append(payload)
                return
            if d not in node[2]:
                node[2][d] = [word, [payload], {}]
                return
            node = node[2][d]

    def within(self, word: str, limit: int) -> list[tuple[int, str]]:
        """(distance, payload) of all entries at most ``limit`` away."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            w, payloads, children = todo.pop()
            d = distance(word, w)
            if d <= limit:
                out += [(d, p) for p in payloads]
            todo += [c for e, c in children.items() if d - limit <= e <= d + limit]
        return out


class Forest:
    """Reference entries by facility, direction and number, and by reading."""

    def __init__(self, entries: list[tuple[str, str | None, str | None]]):
        self.trees: dict[tuple, BKTree] = {}
        for ref_id, name, reading in sorted((e for e in entries if e[1]), key=lambda e: str(e[0])):
            p = parse(name)
            if p is None:
                continue
            self._tree(p).add(p.stem, ref_id)
            if reading and (r := parse(reading)) and r.kind == "kana":
                self._tree(r).add(r.stem, ref_id)

    def _tree(self, p) -> BKTree:
        return self.trees.setdefault((p.kind, p.direction, p.facility, p.number), BKTree())

    def best(self, name: str, limit: int = THRESHOLD) -> tuple[str, int] | None:
        """(entry, distance) of the nearest entry within ``limit``; of several as near, the least entry.

        The radius grows from 0, so a name written rightly follows one path of its tree. It stays below the length of
        the place's own part: a part of one letter must be equal, as one slip makes any letter of any other.
        """
        p = parse(name)
        if p is None:
            return None
        tree = self.trees.get((p.kind, p.direction, p.facility, p.number))
        for radius in range(min(limit, max(0, len(p.stem) - 1)) + 1) if tree else ():
            if hits := tree.within(p.stem, radius):
                d, e = min(hits)
                return e, d
        return None


def canonical(names: DataFrame, name: str, reference: DataFrame, ref_id: str, ref_name: str, ref_reading: str, limit: int = THRESHOLD, shard_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(name, ref_id, distance) for each distinct name; ref_id is null where no entry is within ``limit``.

    Null and blank names give no row. Null reference names match nothing; of entries written alike the least counts.
    """
    ref = reference.where(F.col(ref_id).isNotNull() & F.col(ref_name).isNotNull()).select(F.col(ref_id).cast("string").alias("i"), F.col(ref_name).alias("n"), F.col(ref_reading).alias("r")).distinct()
    n, letters = ref.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("n") + F.coalesce(F.length("r"), F.lit(0))), F.lit(0))).first()
    words = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    # a few names a task: the cost is in the metric, not in the bytes
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.sparkSession.sparkContext.defaultParallelism)
    # (hashed anew: by the name itself Spark would take the partitions that distinct left, and adaptive execution joins those)
    words = words.repartition(tasks, F.xxhash64("name"))
    out = "name string, ref_id string, distance int"

    def search(forest: Forest, column: pd.Series) -> pd.DataFrame:
        shown = [w for w in column if parse(w) is not None]
        hits = [forest.best(w, limit) for w in shown]
        return pd.DataFrame({"name": pd.Series(shown, dtype=object), "ref_id": pd.Series([h[0] if h else None for h in hits], dtype=object), "distance": pd.array([h[1] if h else None for h in hits], dtype="Int32")})

    if n <= shard_rows and letters <= BROADCAST_LETTERS:
        shared = words.sparkSession.sparkContext.broadcast([tuple(r) for r in ref.collect()])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            forest = Forest(shared.value)
            for pdf in batches:
                yield search(forest, pdf["name"])

        return words.mapInPandas(run, out)
    shards = max(-(-n // shard_rows), -(-letters // BROADCAST_LETTERS))
    left = words.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(tasks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = ref.withColumn("shard", F.pmod(F.xxhash64("i"), F.lit(shards)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    met = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(lambda a, b: search(Forest([tuple(x) for x in b[["i", "n", "r"]].itertuples(index=False)]), a["name"]), out)
    best = met.groupBy("name").agg(F.min(F.when(F.col("ref_id").isNotNull(), F.struct("distance", "ref_id"))).alias("b"))
    return best.select("name", F.col("b.ref_id").alias("ref_id"), F.col("b.distance").alias("distance"))


__all__ = ["BKTree", "Forest", "canonical", "fold", "hiragana"]
