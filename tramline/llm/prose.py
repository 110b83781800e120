"""Per-document text statistics, and prose told from lists, tables and junk.

All texts of a batch are laid out as one array of code points; classes of characters, words and sentence particles are
found by table lookups over it and summed by line and document, so the cost is a few passes over the characters
whatever the lines look like.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc

# classes of code points
OTHER, SPACE, NEWLINE, DIGIT, LATIN, HIRAGANA, KATAKANA, HAN, END = range(9)
# Marks that may close a line of prose.
CLOSING = ".!?…。!?」』\"'”’)）:;：；､、"

STATISTICS = {
    "n_chars": "long", "n_words": "long", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double", "closed_lines": "double",
    "common_words": "double", "common_share": "double", "particle_share": "double", "duplicate_lines": "double", "duplicate_paragraphs": "double", "top_fragment": "double", "prose_share": "double",
}

#: Lengths of the n-grams whose dominance is measured.
CHARACTERS = (4, 8, 16, 32, 64, 128, 256)
WORDS = (1, 2, 3, 4)
#: Odd multipliers of the hashes, and bits of the sieve for frequent runs.
MIX, BASE, SIEVE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), 22

_TABLES: list[np.ndarray] = []


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each code point."""
    if not _TABLES:
        kind, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            cat = unicodedata.category(ch)
            if cat[0] == "Z" or ch in "\t\r\v\f":
                kind[c] = SPACE
            elif cat == "Nd":
                kind[c] = DIGIT
            elif 0x3041 <= c <= 0x309F:
                kind[c] = HIRAGANA
            elif 0x30A1 <= c <= 0x30FF and c != 0x30FB or 0xFF66 <= c <= 0xFF9F:
                kind[c] = KATAKANA
            elif 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or 0x20000 <= c <= 0x3FFFF or c == 0x3005:
                kind[c] = HAN
            elif cat[0] in "LM":
                kind[c] = LATIN
            elif ch in CLOSING:
                kind[c] = END
            if len(ch.lower()) == 1:
                low[c] = ord(ch.lower())
        kind[10] = NEWLINE
        _TABLES.extend([kind, low])
    return _TABLES[0], _TABLES[1]


class Terms:
    """Frequent words: those of spaced scripts are met as whole words, those of Japanese wherever they are written."""

    def __init__(self, terms: list[str]):
        kinds, _ = _classes()
        folded = sorted({nfkc(t).strip().lower() for t in terms if t and t.strip()})
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in folded]
        spaced = [c for c in codes if (kinds[c] == LATIN).all()]
        self.longest = max(map(len, spaced), default=0)
        self.words = np.unique(np.array([self._key(c) for c in spaced], np.uint64))
        self.written = [c for c in codes if np.isin(kinds[c], (HIRAGANA, KATAKANA, HAN)).any()]
        self.first = np.zeros(0x110000, bool)
        self.first[[c[0] for c in self.written]] = True
        #: terms of two kana or more: the ones that scrambled text does not keep
        self.particles = [len(c) > 1 and bool((kinds[c] == HIRAGANA).all()) for c in self.written]

    @staticmethod
    def _key(codes: np.ndarray) -> np.uint64:
        with np.errstate(over="ignore"):
            return np.add.reduce(codes.astype(np.uint64) * BASE ** np.arange(1, len(codes) + 1, dtype=np.uint64))

    def common(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each word (a span of the array) is a frequent one."""
        n = ends - starts
        key, fits = np.zeros(len(starts), np.uint64), n <= self.longest
        with np.errstate(over="ignore"):
            for j in range(self.longest):
                more = np.flatnonzero((n > j) & fits)
                key[more] += low[starts[more] + j].astype(np.uint64) * BASE ** np.uint64(j + 1)
        at = np.searchsorted(self.words, key)
        return fits & (self.words[np.minimum(at, len(self.words) - 1)] == key) if len(self.words) else np.zeros(len(starts), bool)

    def covered(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each character stands in a written term, and whether it stands in a particle."""
        any_, part = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        heads = np.flatnonzero(self.first[codes])
        head = codes[heads]
        for term, particle in zip(self.written, self.particles, strict=True):
            at = heads[head == term[0]]
            at = at[at + len(term) <= len(codes)]
            for j in range(1, len(term)):
                at = at[codes[at + j] == term[j]]
            for j in range(len(term)):
                any_[at + j] = True
                if particle:
                    part[at + j] = True
        return any_, part


def measure(texts: list[str], terms: Terms) -> pd.DataFrame:
    """The STATISTICS of each text."""
    kinds, lower = _classes()
    joined = "\x00".join(nfkc(t.replace("\x00", " ")) for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc_ends = np.append(np.flatnonzero(raw == 0), len(raw))
    kind = kinds[raw]
    kind[doc_ends[:-1]] = NEWLINE
    low = lower[raw]
    # lines end at newlines and at the ends of texts
    line_end = np.append(np.flatnonzero(kind == NEWLINE), len(raw))
    line_start = np.append(0, line_end[:-1] + 1)
    doc_of_line = np.searchsorted(doc_ends, line_start, "left")

    line_of = np.repeat(np.arange(len(line_end), dtype=np.int32), line_end - line_start + 1)[: len(raw)]
    counts = np.bincount(line_of * np.int64(9) + kind, minlength=len(line_end) * 9).reshape(-1, 9)

    def by_doc(per_line: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of_line, per_line, len(texts))

    body = counts.sum(1) - counts[:, SPACE] - counts[:, NEWLINE]
    digits, latin, hira, kata, han = (counts[:, k] for k in (DIGIT, LATIN, HIRAGANA, KATAKANA, HAN))
    letters = latin + hira + kata + han
    # words: runs of Latin letters, digits and underscores that begin or end with a letter
    inside = (kind == LATIN) | (kind == DIGIT) | (raw == 95)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    named = kind[starts] == LATIN
    named |= kind[ends - 1] == LATIN
    starts, ends = starts[named], ends[named]
    line_of_word = np.searchsorted(line_end, starts, "left")
    words = np.bincount(line_of_word, minlength=len(line_end))
    word_chars = np.bincount(line_of_word, ends - starts, len(line_end))
    frequent = terms.common(low, starts, ends)
    common = np.bincount(line_of_word, frequent, len(line_end))
    written, particle = terms.covered(low)
    particles = np.bincount(line_of[np.flatnonzero(particle)], minlength=len(line_end))
    in_terms = np.bincount(line_of[np.flatnonzero(written)], minlength=len(line_end)) + np.bincount(line_of_word, np.where(frequent, ends - starts, 0), len(line_end))
    # the last character of a line, before up to three blanks
    last = np.maximum(line_end - 1, 0)
    for _ in range(3):
        back = (kind[np.minimum(last, len(raw) - 1)] == SPACE) & (last > line_start) if len(raw) else np.zeros(len(last), bool)
        last = last - back
    closed = (body > 0) & (kind[np.minimum(last, len(raw) - 1)] == END) if len(raw) else body > 0
    # a line reads as prose by its particles or its frequent words, not by its shape
    ja = hira + kata + han
    reads_ja = (ja * 2 >= letters) & (hira * 5 >= ja) & (particles * 20 >= hira)
    reads_en = (latin * 2 > letters) & (common * 8 >= words) & (words > 0)
    reads = (reads_ja | reads_en) & (letters * 2 >= body) & (digits * 4 <= body)
    good = np.where(reads, body, 0)
    n, n_words, lines = by_doc(body), by_doc(words), by_doc((body > 0).astype(np.int64))
    g = lambda x: by_doc(np.where(reads, x, 0))
    read_ja, read_words = g(hira), g(words)
    div = lambda a, b: np.divide(a, b, out=np.zeros(len(texts)), where=b > 0)
    repeats = [_repetition(t) for t in texts]
    top = np.maximum([r[2] for r in repeats], dominant(raw, kind, doc_ends)) if texts else np.zeros(0)
    return pd.DataFrame({
        "n_chars": n.astype(np.int64), "n_words": (n_words + by_doc(ja)).astype(np.int64), "mean_word_length": div(by_doc(word_chars), n_words), "symbol_ratio": div(n - by_doc(letters) - by_doc(digits), n),
        "digit_ratio": div(by_doc(digits), n), "closed_lines": div(by_doc(closed), lines), "common_words": div(g(common), read_words), "common_share": div(by_doc(in_terms), by_doc(letters)), "particle_share": div(g(particles), read_ja),
        "duplicate_lines": [r[0] for r in repeats], "duplicate_paragraphs": [r[1] for r in repeats], "top_fragment": top, "prose_share": div(by_doc(good), n),
    })


class _Runs:
    """Dominance of runs of units, documents side by side: ``doc`` is each unit's document, ``weight`` its characters.

    A run that comes more than twice is made of shorter runs that do, so each length looks only where the parts it is
    put together from came more than twice; what is counted there is counted exactly.
    """

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int):
        self.unit, self.doc, self.docs = hashes, doc, docs
        self.before = np.append(0, np.cumsum(weight))
        self.best = np.zeros(docs, np.int64)
        #: length of the runs looked at last, their hashes by start, and the starts that may come more than twice
        self.n, self.hash, self.often = 0, hashes, np.zeros(0, bool)

    def first(self, n: int) -> None:
        """Look at runs of ``n`` units, all of them."""
        self.n, count = n, len(self.unit) - n + 1
        if count <= 0:
            self.often = np.zeros(0, bool)
            return
        h = self.unit[:count].copy()
        with np.errstate(over="ignore"):
            for j in range(1, n):
                h = h * MIX + self.unit[j : j + count]
        self.hash = h
        self._look(np.flatnonzero(self.doc[:count] == self.doc[n - 1 :]))

    def longer(self, n: int) -> None:
        """Look at runs of ``n`` units, at most twice as many as before: two that overlap or touch make one."""
        step, self.n = n - self.n, n
        count = len(self.often) - step
        if count <= 0 or not self.often.any():
            self.often = np.zeros(0, bool)
            return
        at = np.flatnonzero(self.often[:count] & self.often[step:])
        at = at[self.doc[at] == self.doc[np.minimum(at + n, len(self.doc)) - 1]]
        with np.errstate(over="ignore"):
            h = np.zeros(count, np.uint64)
            h[at] = (self.hash[at] ^ (self.hash[at] >> np.uint64(31))) * MIX + self.hash[at + step]
        self.hash = h
        self._look(at)

    def _look(self, at: np.ndarray) -> None:
        self.often = np.zeros(len(self.hash), bool)
        if not len(at):
            return
        d = self.doc[at]
        with np.errstate(over="ignore"):
            h = (self.hash[at] ^ (self.hash[at] >> np.uint64(29))) * MIX
        key = (d.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
        order = np.sort(key)
        new = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        times = np.diff(np.append(new, len(order)))
        many = times > 2
        if not many.any():
            return
        runs, times = order[new[many]], times[many]
        # a sieve of the frequent runs: what passes it may be less frequent, what does not is not frequent
        slot = lambda k: ((k * MIX if len(k) else k) >> np.uint64(64 - SIEVE)).astype(np.int64)
        sieve = np.zeros(1 << SIEVE, bool)
        with np.errstate(over="ignore"):
            sieve[slot(runs)] = True
            passed = sieve[slot(key)]
        self.often[at[passed]] = True
        of = (runs >> np.uint64(44)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0]))
        most = np.repeat(np.maximum.reduceat(times, edge), np.diff(np.append(edge, len(of))))
        lead = times == most
        top, of = runs[lead], of[lead]
        at, key = at[passed], key[passed]
        which = np.minimum(np.searchsorted(top, key), len(top) - 1)
        same = top[which] == key
        at, which = at[same], which[same]
        order = np.argsort(which, kind="stable")
        at, which = at[order], which[order]
        # up to the next start of the same run, where that overlaps
        after = np.where(np.append(which[1:] == which[:-1], False), np.append(at[1:], 0), len(self.doc))
        share = np.bincount(which, self.before[np.minimum(at + self.n, after)] - self.before[at], len(top)).astype(np.int64)
        np.maximum.at(self.best, of, share)


def dominant(raw: np.ndarray, kind: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """Share of each text's characters under its most frequent n-gram of characters or of words, the largest of all lengths.

    An n-gram counts if it comes more than twice; of several as frequent, the one that covers most. Runs of blanks and line ends are one blank, which parts words; a
    fragment repeated without end is covered whole by n-grams longer than itself.
    """
    docs = len(doc_ends)
    doc = np.repeat(np.arange(docs), np.diff(np.append(-1, doc_ends)))[: len(raw)]
    blank = (kind == SPACE) | (kind == NEWLINE)
    keep = ~blank | np.concatenate([[True], ~blank[:-1]])[: len(blank)]
    codes, doc, blank = np.where(blank, 32, raw)[keep].astype(np.uint64) + np.uint64(1), doc[keep], blank[keep]
    weight = (~blank).astype(np.int64)
    total = np.bincount(doc, weight, docs)
    with np.errstate(over="ignore"):
        spread = codes * MIX
        spread ^= spread >> np.uint64(29)
    chars = _Runs(spread, doc, weight, docs)
    chars.first(CHARACTERS[0])
    for n in CHARACTERS[1:]:
        chars.longer(n)
    best = chars.best
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1] | (np.diff(doc) != 0)])[: len(blank)])
    if len(start):
        end = np.flatnonzero(~blank & np.concatenate([blank[1:] | (np.diff(doc) != 0), [True]]))
        place = np.arange(len(codes)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(codes)]])))
        with np.errstate(over="ignore"):
            mixed = codes * (place.astype(np.uint64) * BASE | np.uint64(1))
            mixed ^= mixed >> np.uint64(29)
            mixed *= MIX
        mixed[blank] = 0
        words = _Runs(np.add.reduceat(mixed, start), doc[start], end - start + 1, docs)
        words.first(WORDS[0])
        for n in WORDS[1:]:
            words.longer(n)
        best = np.maximum(best, words.best)
    return np.divide(best, total, out=np.zeros(docs), where=total > 0)


def _repetition(text: str) -> tuple[float, float, float]:
    """Shares of characters in repeated lines, in repeated paragraphs, and in the dominant sentence where it occurs more than twice."""
    out = []
    for parts in (text.split("\n"), text.split("\n\n")):
        c = Counter(p.strip() for p in parts)
        total = sum(len(p) * k for p, k in c.items())
        out.append(sum(len(p) * (k - 1) for p, k in c.items()) / total if total else 0.0)
    flat = "".join(text.split())
    for mark in "!?！？。":
        flat = flat.replace(mark, ".")
    c = Counter(flat.split("."))
    total = sum(len(p) * k for p, k in c.items())
    top = max((len(p) * k for p, k in c.items() if k > 2), default=0)
    return out[0], out[1], top / total if total else 0.0


def statistics(df: DataFrame, doc_id: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """(doc_id, STATISTICS...) of every document with a text; null texts and null ids give no row.

    Texts are measured whole, whatever their length; empty and blank ones have n_chars 0 and all ratios 0. Terms are a
    short list (at most 10,000 are taken, else this raises).
    """
    words = [r[0] for r in terms.where(F.col(term).isNotNull()).select(term).distinct().limit(10_001).collect()]
    if len(words) > 10_000:
        raise ValueError("the list of frequent terms is too long")
    found = Terms(sorted(words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, at = pdf[text].str.len().to_numpy(), 0
            while at < len(pdf):  # texts of about two million characters at once
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 2_000_000)))
                part = pdf.iloc[at:to]
                at = to
                out = measure(part[text].tolist(), found)
                out.insert(0, doc_id, part[doc_id].to_numpy())
                yield out

    kinds = f"`{doc_id}` {dict(df.dtypes)[doc_id]}, " + ", ".join(f"{k} {v}" for k, v in STATISTICS.items())
    return df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(doc_id, text).mapInPandas(run, kinds)


def is_prose() -> Column:
    """Combined rules over the STATISTICS: most characters stand in lines that read as prose, the reading lines as a whole
    have a language's share of frequent words or particles, some of all letters stand in frequent terms, and no fragment,
    repeated lines or repeated paragraphs fill the text. Marks at line ends do not count: prose may do without."""
    read = (F.col("common_words") >= 0.15) | (F.col("particle_share") >= 0.09)
    return (F.col("prose_share") >= 0.5) & read & (F.col("common_share") >= 0.05) & (F.col("top_fragment") < 0.5) & (F.col("duplicate_lines") <= 0.5) & (F.col("duplicate_paragraphs") <= 0.5)
