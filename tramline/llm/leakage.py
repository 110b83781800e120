"""Evaluation passages inside training texts.

Texts are reduced to their letters and digits. For exact runs the n-grams of each passage that are rarest in the corpus
are taken as seeds, at least one in every stretch of ``run`` characters; corpus windows meet the seeds by rolling hash, a
banded Smith-Waterman alignment around their diagonals scores the copy, and an exact extension measures the longest shared
run. For edited and paraphrased copies all short n-grams of the passages are met, and where several lie near one diagonal
the same alignment scores the copy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc
from ..runtime import BROADCAST_ROWS

#: Letters of the passages that are searched for at once.
LETTERS = 50_000_000
RUN = 50
SEED = 24
BAND = 8
#: Letters of the n-grams that lead to an alignment, and how many letters in such runs must survive near one diagonal.
GRAM = 8
ENOUGH = 16
BITS = 22
MATCH, MISMATCH, GAP = 2, -2, -2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _kept() -> np.ndarray:
    """For each code point whether it is a letter or a number."""
    table = np.zeros(0x110000, bool)
    for c in range(0x110000):
        table[c] = unicodedata.category(chr(c))[0] in "LN"
    return table


_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_kept())
    return _TABLE[0]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts after NFKC, lower-casing and dropping all but letters and numbers; and each text's start."""
    joined = "\n".join(nfkc(t).replace("\n", " ").lower() for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = _table()[raw]
    ends = np.flatnonzero(raw == 10)
    n = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    return raw[keep], np.concatenate([[0], n[ends], [n[-1]]])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every window of ``width`` codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        # Horner's rule by doubling: hash of 2w = hash of w, shifted, plus hash of the next w
        parts, w, h = [], 1, (codes.astype(np.uint64) + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
        power, need = _BASE, width
        offset = 0
        while need:
            if need & 1:
                parts.append((offset, h, power))
                offset += w
            need >>= 1
            if need:
                h = h[: len(h) - w] * power + h[w:]
                power *= power
                w *= 2
        for at, h, power in parts:
            out = out * power + h[at : at + n]
        out ^= out >> np.uint64(31)
        return out * _MIX


def choose_seeds(passages: list[np.ndarray], run: int, width: int, known: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and (passage, offset) of the seeds: in every ``run - width + 1`` window starts the rarest n-gram, so that any shared run holds a seed.

    ``known`` are the sorted hashes of all windows of the passages, ``often`` says how often each occurs in the corpus.
    """
    hashes, where, span = [np.empty(0, np.uint64)], [np.empty((0, 2), np.int64)], run - width + 1
    for i, p in enumerate(passages):
        h = window_hashes(p, width)
        if not len(h):
            continue
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((h, often[np.searchsorted(known, h)]))] = np.arange(len(h))
        stretches = np.lib.stride_tricks.sliding_window_view(rank, min(span, len(h)))
        at = np.unique(stretches.argmin(axis=1) + np.arange(len(stretches)))
        hashes.append(h[at])
        where.append(np.stack([np.full(len(at), i), at], axis=1))
    return np.concatenate(hashes), np.concatenate(where)


def smith_waterman(cases: list[tuple[np.ndarray, np.ndarray, int]], band: int = BAND) -> np.ndarray:
    """Best local alignment score of each (text, passage, diagonal), all at once, within ``band`` of the diagonal.

    The diagonal is the text position less the passage position; text outside the band is not looked at.
    """
    if not cases:
        return np.empty(0, np.int32)
    width, longest = 2 * band + 1, max(len(p) for _, p, _ in cases)
    # side by side: strip[c, i + j] is the text of case c under band cell j at passage position i; 0 where there is none
    strip = np.zeros((len(cases), longest + width), np.uint32)
    query = np.full((len(cases), longest), 0xFFFFFFFF, np.uint32)
    for c, (text, passage, diagonal) in enumerate(cases):
        query[c, : len(passage)] = passage
        start = diagonal - band
        piece = text[max(0, start) : max(0, start + len(passage) + width)]
        strip[c, max(0, -start) : max(0, -start) + len(piece)] = piece[: max(0, strip.shape[1] - max(0, -start))]
    kind = np.int16 if MATCH * longest - GAP * width < 32_000 else np.int32
    ramp = (-GAP * np.arange(width)).astype(kind)
    prev, best = np.zeros((len(cases), width + 1), kind), np.zeros(len(cases), kind)
    for i in range(longest):
        cell = strip[:, i : i + width]
        row = prev[:, :-1] + np.where(cell == query[:, i, None], kind(MATCH), kind(MISMATCH))
        np.maximum(row, prev[:, 1:] + kind(GAP), out=row)
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        np.maximum(row, 0, out=row)
        row[cell == 0] = 0
        np.maximum(best, row.max(axis=1), out=best)
        prev[:, :-1] = row
    return best


def aligned(cases: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """``smith_waterman`` of any number of cases, passages of about one length and some four million letters at once."""
    out = np.zeros(len(cases), np.int64)
    order = np.argsort([len(p) for _, p, _ in cases], kind="stable")
    k = 0
    while k < len(order):
        to = k + 1
        while to < len(order) and (to + 1 - k) * len(cases[order[to]][1]) <= 4_000_000:
            to += 1
        out[order[k:to]] = smith_waterman([cases[c] for c in order[k:to]])
        k = to
    return out


def _run(text: np.ndarray, passage: np.ndarray, i: int, j: int) -> int:
    """Length of the shared run through text position i and passage position j."""
    back = min(i, j)
    a = text[i - back : i][::-1] == passage[j - back : j][::-1]
    left = back if a.all() else int(np.argmin(a))
    ahead = min(len(text) - i, len(passage) - j)
    b = text[i : i + ahead] == passage[j : j + ahead]
    return left + (ahead if b.all() else int(np.argmin(b)))


def _sieve(hashes: np.ndarray) -> np.ndarray:
    """For the first bits of a hash whether any of ``hashes`` begins with them."""
    sieve = np.zeros(1 << BITS, bool)
    sieve[(hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return sieve


def _parts(pdf: pd.DataFrame, text: str) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows of ``pdf`` with the letters and starts of their texts, about two million characters at once."""
    sizes, at = pdf[text].str.len().to_numpy(), 0
    while at < len(pdf):
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 2_000_000)))
        yield pdf.iloc[at:to], *letters(pdf[text].iloc[at:to].tolist())
        at = to


def frequencies(texts: DataFrame, text: str, known: np.ndarray, width: int) -> np.ndarray:
    """How often windows with each of the sorted hashes ``known`` occur in the corpus."""
    often = np.zeros(len(known), np.int64)
    if not len(known):
        return often
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        sieve = _sieve(known)
        for pdf in batches:
            for _, codes, starts in _parts(pdf, text):
                h = window_hashes(codes, width)
                pos = np.flatnonzero(sieve[(h >> np.uint64(64 - BITS)).astype(np.int64)])
                at = np.minimum(np.searchsorted(known, h[pos]), len(known) - 1)
                inside = pos + width <= starts[np.searchsorted(starts, pos, "right")]
                at, n = np.unique(at[(known[at] == h[pos]) & inside], return_counts=True)
                yield pd.DataFrame({"at": at.astype(np.int32), "n": n})

    sums = texts.select(text).mapInPandas(count, "at int, n long").groupBy("at").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    often[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return often


class Grams:
    """All n-grams of the passages, to meet texts at every window that they share."""

    def __init__(self, passages: list[np.ndarray], width: int):
        self.passages, self.width = passages, width
        self.flat = np.concatenate([*passages, np.empty(0, np.uint32)]).astype(np.uint32)
        self.base = np.cumsum([0, *map(len, passages)])
        hashes = [window_hashes(p, width) for p in passages]
        h = np.concatenate([*hashes, np.empty(0, np.uint64)])
        at = np.concatenate([*[self.base[i] + np.arange(len(x)) for i, x in enumerate(hashes)], np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.at = h[order], at[order]
        self.sieve = np.zeros(1 << BITS, bool)
        self.sieve[(h >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def hits(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, passage, diagonal, position in the document) of every shared window, sorted."""
        h = window_hashes(text, self.width)
        pos = np.flatnonzero(self.sieve[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        lo = np.searchsorted(self.hashes, h[pos], "left")
        n = np.searchsorted(self.hashes, h[pos], "right") - lo
        flat = self.at[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pos = np.repeat(pos, n)
        doc = np.searchsorted(starts, pos, "right") - 1
        ok = pos + self.width <= starts[doc + 1]
        for j in range(self.width):
            ok[ok] = text[pos[ok] + j] == self.flat[flat[ok] + j]
        pos, flat, doc = pos[ok], flat[ok], doc[ok]
        item = np.searchsorted(self.base, flat, "right") - 1
        q = pos - starts[doc]
        diagonal = q - (flat - self.base[item])
        order = np.lexsort((q, diagonal, item, doc))
        return doc[order], item[order], diagonal[order], q[order]

    def scores(self, text: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(document, passage) -> longest shared run and alignment score.

        A run is a row of hits on one diagonal. Diagonals are taken in strips of ``BAND``; where the runs
        of a strip and the next have ``ENOUGH`` letters together, the passage is aligned around their middle.
        """
        doc, item, diagonal, q = self.hits(text, starts)
        if not len(doc):
            return {}
        new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(q) != 1)])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(doc))) + self.width - 1
        found: dict[tuple[int, int], list[int]] = {}
        by_length = np.argsort(length, kind="stable")
        for d, i, n in zip(doc[first][by_length].tolist(), item[first][by_length].tolist(), length[by_length].tolist(), strict=True):
            found[d, i] = [n, 0]
        strip = diagonal // BAND
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(strip) != 0)]))
        n = np.add.reduceat(np.where(new, self.width, 1), edge)
        d, i, s = doc[edge], item[edge], strip[edge]
        beside = np.concatenate([(np.diff(d) == 0) & (np.diff(i) == 0) & (np.diff(s) == 1), [False]])
        after = np.concatenate([[False], beside[:-1]])
        both = n + np.where(beside, np.append(n[1:], 0), 0)
        take = np.flatnonzero((beside | ~after) & (both >= ENOUGH))
        middle = np.where(beside, (s + 1) * BAND, s * BAND + BAND // 2)
        take = take[np.argsort([len(self.passages[x]) for x in i[take]], kind="stable")]
        for k in range(0, len(take), 2000):  # passages of about one length at once
            part = take[k : k + 2000]
            cases = [(text[starts[d[c]] : starts[d[c] + 1]], self.passages[i[c]], int(middle[c])) for c in part]
            for c, score in zip(part, smith_waterman(cases), strict=True):
                got = found[int(d[c]), int(i[c])]
                got[1] = max(got[1], int(score))
        return {k: (r, x) for k, (r, x) in found.items()}


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, run: int = RUN, width: int = SEED, align: bool = True) -> DataFrame:
    """(doc_id, item_id, longest_run, score): documents that share letters with a passage.

    Without ``align`` rows are those that meet a rare seed, as a shared run of ``run`` letters always does, with the score
    of the alignment around the seed's diagonal; rarity is counted in a first pass over the documents. With it texts meet passages in all n-grams of ``GRAM`` letters, and rows are those whose alignment scores as
    much as ``width`` letters in a row: an edited copy is aligned if ``ENOUGH`` of its letters survive, in runs of
    ``GRAM`` or more, near one diagonal.
    Longest run and score are the best over all meetings of document and passage. Null texts and ids, and passages
    shorter than ``width`` letters, give nothing; repeated documents with one id count once. Passages that are too many
    for one table (``BROADCAST_ROWS`` of them, ``LETTERS`` letters) are searched in parts, each in own passes over the documents.
    """
    kept = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(item_id, item_text).distinct()
    n, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()
    if n > BROADCAST_ROWS or size > LETTERS and n > 1:
        parts = 2 * max(-(-n // BROADCAST_ROWS), min(n, -(-size // LETTERS)))
        each = [leaks(docs, kept.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(parts)) == k), doc_id, doc_text, item_id, item_text, run, width, align) for k in range(parts)]
        both = each[0]
        for e in each[1:]:
            both = both.unionAll(e)
        return both.groupBy(doc_id, item_id).agg(F.max("longest_run").alias("longest_run"), F.max("score").alias("score"))
    rows = kept.collect()
    ids = [r[0] for r in rows]
    codes, starts = letters([r[1] for r in rows]) if rows else (np.empty(0, np.uint32), np.zeros(1, np.int64))
    passages = [codes[starts[i] : starts[i + 1]] for i in range(len(rows))]
    if align:
        return _scored(docs, doc_id, doc_text, ids, passages, f"`{item_id}` {dict(items.dtypes)[item_id]}", item_id, width)
    texts = docs.where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull()).select(doc_id, doc_text)
    known = np.unique(np.concatenate([np.empty(0, np.uint64), *(window_hashes(p, width) for p in passages)]))
    seeds = choose_seeds(passages, run, width, known, frequencies(texts, doc_text, known, width))
    out_type = f"`{doc_id}` {dict(docs.dtypes)[doc_id]}, `{item_id}` {dict(items.dtypes)[item_id]}, longest_run int, score int"
    shared = docs.sparkSession.sparkContext.broadcast((ids, passages, *seeds))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, passages, hashes, where = shared.value
        order = np.argsort(hashes, kind="stable")
        hashes, where = hashes[order], where[order]
        sieve = _sieve(hashes)
        for pdf in batches:
            rows = []
            for part, text, starts in _parts(pdf, doc_text):
                h = window_hashes(text, width)
                near = np.flatnonzero(sieve[(h >> np.uint64(64 - BITS)).astype(np.int64)])
                if not len(near):
                    continue
                found: dict[tuple[int, int], int] = {}
                strips: set[tuple[int, int, int]] = set()
                lo, hi = np.searchsorted(hashes, h[near], "left"), np.searchsorted(hashes, h[near], "right")
                for pos, a, b in zip(near[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
                    d = int(np.searchsorted(starts, pos, "right")) - 1
                    if pos + width > starts[d + 1]:
                        continue
                    doc = text[starts[d] : starts[d + 1]]
                    for k in range(a, b):
                        i, off = where[k].tolist()
                        p, q = passages[i], int(pos - starts[d])
                        if not np.array_equal(doc[q : q + width], p[off : off + width]):
                            continue
                        found[d, i] = max(found.get((d, i), 0), _run(doc, p, q, off))
                        strips.add((d, i, (q - off) // BAND))
                # one alignment around the middle of each strip of diagonals
                score: dict[tuple[int, int], int] = {}
                cases = sorted(strips)
                for (d, i, _), x in zip(cases, aligned([(text[starts[d] : starts[d + 1]], passages[i], s * BAND + BAND // 2) for d, i, s in cases]).tolist(), strict=True):
                    score[d, i] = max(score.get((d, i), 0), x)
                doc_ids = part[doc_id].to_numpy()
                rows += [(doc_ids[d], ids[i], r, score[d, i]) for (d, i), r in found.items()]
            yield pd.DataFrame(rows, columns=[doc_id, item_id, "longest_run", "score"]).astype({"longest_run": "int32", "score": "int32"})

    hits = texts.mapInPandas(search, out_type)
    return hits.groupBy(doc_id, item_id).agg(F.max("longest_run").alias("longest_run"), F.max("score").alias("score"))


def _scored(docs: DataFrame, doc_id: str, doc_text: str, ids: list, passages: list[np.ndarray], item_type: str, item_id: str, width: int) -> DataFrame:
    """``leaks`` with alignment scores."""
    out_type = f"`{doc_id}` {dict(docs.dtypes)[doc_id]}, {item_type}, longest_run int, score int"
    shared = docs.sparkSession.sparkContext.broadcast((ids, passages))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, passages = shared.value
        grams = Grams(passages, GRAM)
        for pdf in batches:
            rows, at = [], 0
            sizes = pdf[doc_text].str.len().to_numpy()
            while at < len(pdf):  # texts of about half a million characters at once
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 500_000)))
                part = pdf.iloc[at:to]
                at = to
                doc_ids = part[doc_id].to_numpy()
                rows += [(doc_ids[d], ids[i], r, x) for (d, i), (r, x) in grams.scores(*letters(part[doc_text].tolist())).items() if x >= MATCH * width]
            yield pd.DataFrame(rows, columns=[doc_id, item_id, "longest_run", "score"]).astype({"longest_run": "int32", "score": "int32"})

    texts = docs.where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull()).select(doc_id, doc_text)
    return texts.mapInPandas(search, out_type).groupBy(doc_id, item_id).agg(F.max("longest_run").alias("longest_run"), F.max("score").alias("score"))
