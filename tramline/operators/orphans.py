"""References to records that do not exist: incremental pending-orphan state.

State has two parts. The *parent index* holds, per relation, key and load time, the latest end of the parent. To
judge, it is folded to the frontier of each parent's life: pairs (loaded, gone) in load order, keeping only rows that
outlive all earlier ones. The *reference state* holds each reference with its kind so far: those that wait, and those that
are fine, since a deletion may reopen them. A batch of new
references probes the index; arriving parents and deletions touch keys, and only the references of touched keys are
judged again: a parent that comes resolves waiting orphans (they turn from missing to late), a deletion that comes
reopens references that were fine. ``snapshot`` counts per table, field, month and kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, salted_join

FOREVER = "9999-12-31 00:00:00"


@dataclass(frozen=True)
class Relation:
    """Field ``fld`` of table ``tbl`` names a key of relation ``rel``."""

    tbl: str
    fld: str
    rel: str


def parent_events(df: DataFrame, rel: str, key: str, loaded: str = "loaded_at", gone: str | None = None) -> DataFrame:
    """Parent rows as (rel, key, loaded, gone); a null deletion lasts for ever, null keys are no parents.

    A null load time counts as loaded before everything.
    """
    g = F.col(gone) if gone else F.lit(None).cast("timestamp")
    return df.where(F.col(key).isNotNull()).select(
        F.lit(rel).alias("rel"), F.col(key).cast("string").alias("key"),
        F.coalesce(F.col(loaded), F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("loaded"),
        F.coalesce(g, F.lit(FOREVER).cast("timestamp")).alias("gone"),
    )


def reference_events(df: DataFrame, relations: list[Relation], row_id: str = "row_id", loaded: str = "loaded_at") -> DataFrame:
    """References as (rel, key, tbl, fld, row_id, loaded_ref), one per relation; null and empty references are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(r.rel).alias("rel"), F.col(r.fld).cast("string").alias("key"), F.lit(r.tbl).alias("tbl"), F.lit(r.fld).alias("fld")) for r in relations])).alias("e")
    return df.select(each, F.col(row_id).alias("row_id"), F.col(loaded).alias("loaded_ref")).select("e.*", "row_id", "loaded_ref").where(F.col("key").isNotNull() & (F.col("key") != ""))


def fold_index(parents: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Parent index (rel, key, loaded, gone): one row per key and load time with its latest end, resent rows folded."""
    both = parents if index is None else parents.unionByName(index)
    return both.groupBy("rel", "key", "loaded").agg(F.max("gone").alias("gone"))


def _frontier(rows):
    """The (loaded, gone) pairs, in load order, that outlive all earlier ones."""
    return F.aggregate(
        F.array_sort(rows), F.slice(F.array_sort(rows), 1, 0),
        lambda acc, x: F.when((F.size(acc) == 0) | (x["gone"] > F.element_at(acc, -1)["gone"]), F.concat(acc, F.array(x))).otherwise(acc),
    )


def lives(index: DataFrame) -> DataFrame:
    """(rel, key, life): folded per day of loading and then per key, so that no task holds all rows of a key resent for years."""
    daily = index.groupBy("rel", "key", F.to_date("loaded").alias("__day")).agg(F.collect_list(F.struct("loaded", "gone")).alias("__rows"))
    daily = daily.select("rel", "key", _frontier(F.col("__rows")).alias("__part"))
    merged = daily.groupBy("rel", "key").agg(F.flatten(F.collect_list("__part")).alias("__rows"))
    return merged.select("rel", "key", _frontier(F.col("__rows")).alias("life"))


def judge(refs: DataFrame, index: DataFrame) -> DataFrame:
    """References with their kind: missing, late, deleted, or null where the parent was there.

    A reference with a null load time is judged as loaded last.
    """
    t = F.coalesce("loaded_ref", F.lit(FOREVER).cast("timestamp"))
    known = F.filter("life", lambda x: x["loaded"] <= t)
    kind = (
        F.when(F.col("life").isNull(), "missing")
        .when(F.element_at("life", 1)["loaded"] > t, "late")
        .when(F.element_at(known, -1)["gone"] <= t, "deleted")
    )
    joined = salted_join(refs, lives(index), ["rel", "key"], "left", salt_by="row_id")
    return joined.withColumn("kind", kind).drop("life")


class OrphanTracker:
    """Keyed orphan state over batches of references, parents and deletions.

    ``apply`` takes any of the two event sets; a deletion is a parent event whose ``gone`` is set (the row sent again
    with its deletion replaces the open one: see ``deletions``). State is written to the shared folder after each
    batch, so a lost executor or driver continues from the last batch.
    """

    def __init__(self, index: DataFrame | None = None, refs: DataFrame | None = None):
        self.index, self.refs = index, refs

    def apply(self, refs: DataFrame | None = None, parents: DataFrame | None = None, deletions: DataFrame | None = None) -> "OrphanTracker":
        """One batch. ``deletions``: (rel, key, loaded, gone) of rows that were open until now."""
        index, touched = self.index, None
        if deletions is not None:
            if index is not None:
                ends = deletions.groupBy("rel", "key", "loaded").agg(F.max("gone").alias("__end"))
                index = index.join(ends, ["rel", "key", "loaded"], "left").withColumn("gone", F.coalesce("__end", "gone")).drop("__end")
            touched = deletions.select("rel", "key")
        if parents is not None:
            index = fold_index(parents, index)
            touched = parents.select("rel", "key") if touched is None else touched.unionByName(parents.select("rel", "key"))
        if index is None:
            raise ValueError("the first batch needs parents")
        index = cut(index)
        new = None if refs is None else judge(refs, index)
        if self.refs is not None:
            keys = None if touched is None else touched.distinct()
            old = self.refs if keys is None else self.refs.join(keys, ["rel", "key"], "left_anti").unionByName(judge(self.refs.join(keys, ["rel", "key"], "left_semi").drop("kind"), index))
            new = old if new is None else old.unionByName(new)
        return OrphanTracker(index, None if new is None else cut(new))

    def orphans(self) -> DataFrame:
        """References without a parent: tbl, fld, row_id, load_month, kind."""
        return self.refs.where(F.col("kind").isNotNull()).select("tbl", "fld", "row_id", F.date_format(F.to_utc_timestamp("loaded_ref", F.current_timezone()), "yyyy-MM").alias("load_month"), "kind")

    def snapshot(self) -> DataFrame:
        """Orphan counts per table, field, month and kind."""
        return self.orphans().groupBy("tbl", "fld", "load_month", "kind").agg(F.count(F.lit(1)).alias("orphans"))
