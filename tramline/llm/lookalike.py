"""Text that looks the same, brought to one form.

Look-alike classes are transitive: a union-find joins code points and strings that are drawn alike (compatibility forms
by Unicode's own tables, and a fixed list across scripts). The most frequent member in the corpus represents its class,
and an automaton over all members rewrites a text greedily from the left, longest member first. Characters that are not
drawn go, and any run of blanks becomes one.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Characters drawn alike in different scripts or code points, one class a word.
ALIKE = """
aа cсϲ dԁ eе hһ iі jјϳ oоο pр qԛ sѕ vν wԝ xх yу
AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙ JЈ KКΚ MМΜ NΝ OОΟ PРΡ QԚ SЅ TТΤ WԜ XХΧ YΥҮ ZΖ
カ力 エ工 ニ二 ロ口 ハ八 ミ三 タ夕 ト卜 へヘ べベ ぺペ りリ 民⺠
-‐‑‒–—―−─ー一 ~〜∼ ・·‧•
""".split()
# Signs that are drawn though their category is Cf, and unseen marks of other categories.
DRAWN = "؀-؅۝܏࢐࢑࣢\U000110bd\U000110cd"
UNSEEN = rf"[[\p{{Cf}}͏︀-️\U000e0100-\U000e01ef᠋-᠍᠏]--[{DRAWN}]]+"

_UNSEEN = regex.compile(UNSEEN, regex.V1)
_BLANKS = regex.compile(r"[\s\p{Z}⠀]+")
_CLUSTER = regex.compile(r".[\p{M}ﾞﾟ]*", regex.S)


def clean(text: str) -> str:
    """Without unseen characters, blanks folded to single spaces and cut at the ends."""
    return _BLANKS.sub(" ", _UNSEEN.sub("", text)).strip()


class UnionFind:
    """Transitive classes of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def classes(counts: dict[str, int], alike: list[str] | None = None) -> dict[str, str]:
    """Member -> representative for the clusters counted in a corpus; members that represent themselves are left out.

    A cluster is a character with its marks. It joins its compatibility form, cluster by cluster, and each class of
    ``alike`` joins whole. The representative is the most frequent member, ties going to the least string.
    """
    uf = UnionFind()
    for group in ALIKE if alike is None else alike:
        for c in group[1:]:
            uf.join(group[0], c)
    for c in list(counts):
        form = unicodedata.normalize("NFKC", c)
        if form != c and (form := clean(form)):
            uf.join(c, form)
    groups: dict[str, list[str]] = {}
    for c in list(uf.parent):
        groups.setdefault(uf.find(c), []).append(c)
    out = {}
    for members in groups.values():
        rep = min(members, key=lambda c: (-counts.get(c, 0), c))
        out.update({c: rep for c in members if c != rep})
    return out


def automaton(mapping: dict[str, str]) -> ahocorasick.Automaton | None:
    """Multi-pattern automaton over the members of all classes."""
    if not mapping:
        return None
    a = ahocorasick.Automaton()
    for member, rep in mapping.items():
        a.add_word(member, (len(member), rep))
    a.make_automaton()
    return a


def rewrite(text: str, a: ahocorasick.Automaton | None, known: frozenset[str] = frozenset()) -> str:
    """``text`` cleaned, and members replaced from the left, longest first, until nothing changes.

    Clusters that no class knows (``known``: all members and representatives) take Unicode's compatibility form. Should
    replacements go round in a ring, the least string of it counts.
    """
    text, seen = clean(text), []
    while text not in seen:
        seen.append(text)
        if a is not None:
            out, at = [], 0
            for end, (n, rep) in a.iter_long(text):
                out += [text[at : end - n + 1], rep]
                at = end + 1
            text = clean("".join([*out, text[at:]])) if out else text
        if not unicodedata.is_normalized("NFKC", text):
            text = clean("".join(c if c in known else unicodedata.normalize("NFKC", c) for c in _CLUSTER.findall(text)))
    return min(seen[seen.index(text) :])


def cluster_counts(texts: DataFrame, column: str) -> DataFrame:
    """(cluster, n) over a column, counted within batches first; bounded by the clusters a script can write."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter[str] = Counter()
            for t in pdf[column]:
                if t is not None:
                    c.update(_CLUSTER.findall(clean(t)))
            yield pd.DataFrame({"cluster": list(c), "n": list(c.values())})

    return texts.select(column).mapInPandas(count, "cluster string, n long").groupBy("cluster").agg(F.sum("n").alias("n"))


def form_counts(texts: DataFrame, column: str, forms: list[str]) -> DataFrame:
    """(form, n) over a column: forms of one cluster where that stands as a cluster, longer ones as strings, longest first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = {f for f in forms if _CLUSTER.fullmatch(f)}
        a = automaton({f: f for f in forms if f not in one})
        for pdf in batches:
            c: Counter[str] = Counter()
            for t in pdf[column]:
                if t is not None:
                    t = clean(t)
                    c.update(x for x in _CLUSTER.findall(t) if x in one)
                    c.update(rep for _, (_, rep) in a.iter_long(t)) if a else None
            yield pd.DataFrame({"form": list(c), "n": list(c.values())}).astype({"form": "str", "n": "int64"})

    return texts.select(column).mapInPandas(count, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))


def look_udf(mapping: dict[str, str]):
    """Column function: the consistent form of a text; null stays null."""

    @pandas_udf("string")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a, known = automaton(mapping), frozenset(mapping) | frozenset(mapping.values())
        for s in batches:
            yield s.map(lambda t: None if t is None else rewrite(t, a, known))

    return look


#: Different clusters that are looked at on the driver, the most frequent; the rest, if a corpus has more, takes
#: Unicode's own form in ``rewrite`` and the representative of that.
MOST_CLUSTERS = 300_000


def learn(texts: DataFrame, column: str) -> dict[str, str]:
    """Classes and representatives of a column's corpus.

    Only clusters that can belong to a class leave the executors: a fixed alike character, or one with another
    compatibility form. There are fewer than ``MOST_CLUSTERS`` of them in Unicode but for stacks of marks.
    """
    fixed = "".join(ALIKE)

    @pandas_udf("boolean")
    def matters(s: pd.Series) -> pd.Series:
        return s.map(lambda c: len(c) > 1 or c in fixed or unicodedata.normalize("NFKC", c) != c)

    rows = cluster_counts(texts, column)
    rows = rows.where(matters("cluster") | (F.length("cluster") == 1) & F.col("cluster").rlike(r"^[\x20-\x7e぀-ヿ]$"))
    kept = rows.orderBy(F.desc("n"), "cluster").limit(MOST_CLUSTERS).collect()
    counts = {r["cluster"]: r["n"] for r in kept}
    # the plain forms of what was seen count too, so that the usual writing represents a class
    forms = sorted({clean(unicodedata.normalize("NFKC", c)) for c in counts} - set(counts) - {""})
    if forms:
        counts.update({r["form"]: r["n"] for r in form_counts(texts, column, forms).collect()})
    return classes({**{f: 0 for f in forms}, **counts})


def consistent(df: DataFrame, column: str, out: str = "look", mapping: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``out``: the consistent form of ``column``; each distinct text is rewritten once.

    Null stays null; blank and unseen-only texts become empty.
    """
    mapping = learn(df.select(column), column) if mapping is None else mapping
    texts = df.select(F.col(column).alias("__t")).where(F.col("__t").isNotNull()).distinct()
    forms = texts.select("__t", look_udf(mapping)("__t").alias(out))
    return df.join(forms, df[column] == forms["__t"], "left").drop("__t")


def same_look(df: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """(key_a, key_b) within ``group``: different keys whose names look the same but are different strings.

    Null and blank names, null groups and null keys give nothing; repeated rows count once. Different spellings are
    paired first and their keys attached, so copies of one spelling are never compared with each other.
    """
    rows = consistent(df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(name).alias("name")).distinct(), "name").where("look <> '' and g is not null and k is not null")
    spellings = rows.select("g", "look", "name").distinct()
    a = spellings.select("g", "look", F.col("name").alias("na"))
    b = spellings.select("g", "look", F.col("name").alias("nb"))
    pairs = a.join(b, ["g", "look"]).where("na < nb").drop("look")
    ka = rows.select("g", F.col("name").alias("na"), F.col("k").alias("ka"))
    kb = rows.select("g", F.col("name").alias("nb"), F.col("k").alias("kb"))
    met = pairs.join(ka, ["g", "na"]).join(kb, ["g", "nb"]).where("ka <> kb")
    return met.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def same(a: Column, b: Column, mapping: dict[str, str]) -> Column:
    """Whether two text columns look the same."""
    f = look_udf(mapping)
    return f(a) == f(b)
