"""Filling fixed-capacity training windows with texts.

Lengths are counted with a public tokenizer; texts beyond the capacity, and only those, are cut. ``length_buckets`` is
the optimal-bucket method: dynamic programming over the global length histogram chooses boundaries of least padding,
and token-budget batches form inside each bucket. ``pack`` fills windows closer: it plans patterns of lengths on the
same histogram (longest first, then whatever fits best), and gives each item a place by its rank among equal lengths.
Both look only at the histogram, whose size is the capacity, on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPACITY = 2048
#: Rows that are ranked in one task; a length or bucket with more is spread over as many salts as it needs.
RANKED = 50_000


def token_counter(vocabulary: str):
    """Function from texts to token counts, for a .json (tokenizers), .tiktoken or .model (sentencepiece) vocabulary file."""
    if vocabulary.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    if vocabulary.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(x) for x in e.encode_ordinary_batch(texts, num_threads=1)]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]


def token_lengths(df: DataFrame, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """(doc_id, tokens) of every text, counted whole; null texts and ids give no row, empty texts have 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(vocabulary)
        for pdf in batches:
            sizes, at, n = pdf[text].str.len().to_numpy(), 0, []
            while at < len(pdf):  # texts of about two million characters at once
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 2_000_000)))
                n += count(pdf[text].iloc[at:to].tolist())
                at = to
            yield pd.DataFrame({doc_id: pdf[doc_id], "tokens": np.array(n, np.int64)})

    return df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(doc_id, text).mapInPandas(run, f"`{doc_id}` {dict(df.dtypes)[doc_id]}, tokens long")


def pieces(lengths: DataFrame, doc_id: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, first_token, tokens): whole texts, and capacity-long pieces and a rest of those beyond the capacity; empty texts are left out."""
    n = F.floor((F.col("tokens") + capacity - 1) / capacity)
    cut = lengths.where("tokens > 0").select(doc_id, F.col("tokens").alias("__all"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    return cut.select(doc_id, F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("__all") - F.col("piece") * capacity).alias("tokens"))


def histogram(items: DataFrame, capacity: int = CAPACITY) -> np.ndarray:
    """Number of items of each length from 0 to the capacity."""
    out = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["tokens"]] = r["n"]
    return out


def length_buckets(hist: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets that minimise the padding of all items to their bound."""
    lengths = np.flatnonzero(hist)
    if not len(lengths):
        return []
    n, total = np.append(0, np.cumsum(hist[lengths])), np.append(0, np.cumsum(hist[lengths] * lengths))
    m = len(lengths)
    # cost[i, j]: items i..j padded to the length of j
    cost = lengths[None, :] * (n[None, 1:] - n[:-1, None]) - (total[None, 1:] - total[:-1, None])
    cost = np.where(np.tri(m, k=-1, dtype=bool), np.iinfo(np.int64).max // 4, cost)
    best, back = cost[0].copy(), []
    for _ in range(min(buckets, m) - 1):
        through = best[:-1, None] + cost[1:]
        at = through.argmin(0)
        new = through[at, np.arange(m)]
        back.append(np.where(new < best, at, -1))
        best = np.minimum(new, best)
    bounds, j = [], m - 1
    for step in [*back[::-1], None]:
        if step is None:
            bounds.append(int(lengths[j]))
        elif step[j] >= 0:
            bounds.append(int(lengths[j]))
            j = int(step[j])
    return sorted(set(bounds))


def batches(items: DataFrame, doc_id: str, bounds: list[int], capacity: int = CAPACITY) -> DataFrame:
    """``items`` with bucket bound and batch number: inside a bucket, batches of as many items as the token budget holds when padded."""
    bound = F.element_at(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b >= F.col("tokens")), 1)
    bucketed = items.withColumn("bound", bound)
    sizes = {r["bound"]: r["n"] for r in bucketed.groupBy("bound").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = _ranked(bucketed, doc_id, "bound", sizes)
    return ranked.withColumn("batch", F.floor(F.col("rank") / F.floor(F.lit(capacity) / F.col("bound")))).drop("rank")


def packing_plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of windows, [(length, items of it in a window)]): patterns that use up the histogram.

    A pattern starts with the longest length left and takes the longest that fits until none does; it is used as often
    as its lengths last, so each pattern exhausts a length.
    """
    left = hist.astype(np.int64).copy()
    plan = []
    while len(have := np.flatnonzero(left)):
        room, pattern, top = capacity, [], len(have) - 1
        while top >= 0:
            length = int(have[top])
            take = int(min(room // length, left[length])) if length else 0
            if take:
                pattern.append((length, take))
                room -= take * length
            top = min(top - 1, int(np.searchsorted(have, room, "right")) - 1)
        times = int(min(left[length] // k for length, k in pattern))
        for length, k in pattern:
            left[length] -= times * k
        plan.append((times, pattern))
    return plan


def _ranked(items: DataFrame, doc_id: str, group: str, sizes: dict[int, int]) -> DataFrame:
    """``items`` with a rank from 0 within ``group``, without gathering a group in one task: ranks by salt, plus offsets.

    ``sizes``: rows of each group, of which there are at most as many as lengths. A group has one salt for every
    ``RANKED`` of its rows, so a task ranks about that many whatever the sizes are.
    """
    wide = [(g, -(-n // RANKED)) for g, n in sizes.items() if n > RANKED]
    if wide:
        spread = items.sparkSession.createDataFrame(wide, f"`{group}` {dict(items.dtypes)[group]}, __salts long")
        keyed = items.join(F.broadcast(spread), group, "left").withColumn("__salt", F.pmod(F.xxhash64(doc_id, "piece"), F.coalesce("__salts", F.lit(1)))).drop("__salts")
    else:
        keyed = items.withColumn("__salt", F.lit(0).cast("long"))
    counts = keyed.groupBy(group, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(group).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    r = F.row_number().over(W.partitionBy(group, "__salt").orderBy(doc_id, "piece")) - 1
    return keyed.withColumn("__r", r).join(offsets, [group, "__salt"]).withColumn("rank", F.col("__off") + F.col("__r")).drop("__salt", "__off", "__r")


def pack(items: DataFrame, doc_id: str, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (doc_id, piece, first_token, tokens) with ``window``: the windows' tokens sum to at most the capacity.

    Every item is placed once and none is cut here. The plan's slots are broadcast: it has at most one pattern for each
    length, and a pattern has fewer different lengths than the root of twice the capacity.
    """
    hist = histogram(items, capacity)
    plan = packing_plan(hist, capacity)
    start, base, rows = np.zeros(capacity + 1, np.int64), 0, []
    for times, pattern in plan:
        for length, k in pattern:
            rows.append((length, int(start[length]), int(start[length] + times * k), k, base))
            start[length] += times * k
        base += times
    spark = items.sparkSession
    slots = spark.createDataFrame(rows or [(0, 0, 0, 1, 0)], "tokens long, lo long, hi long, each long, base long")
    by_length = slots.groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "each", "base"))).alias("slots"))
    ranked = _ranked(items, doc_id, "tokens", {int(k): int(hist[k]) for k in np.flatnonzero(hist)})
    slot = F.element_at(F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"])), 1)
    placed = ranked.join(F.broadcast(by_length), "tokens").withColumn("__s", slot)
    return placed.withColumn("window", F.col("__s.base") + F.floor((F.col("rank") - F.col("__s.lo")) / F.col("__s.each"))).select(doc_id, "piece", "first_token", "tokens", "window")


def windows(df: DataFrame, doc_id: str, text: str, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, first_token, tokens, window) for all texts of ``df``."""
    from ..runtime import cut

    return pack(cut(pieces(token_lengths(df, doc_id, text, vocabulary), doc_id, capacity)), doc_id, capacity)
