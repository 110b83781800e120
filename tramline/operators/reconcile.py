"""Differences between two copies of a table by characteristic-polynomial set reconciliation.

Rows become elements of the field of 2^31-1 values and fall into small buckets by key. Per bucket the two sides'
power sums are subtracted; elements on both sides cancel, so the sums depend on the differing rows alone. They are the
coefficients of the logarithmic derivative of the quotient of the sides' characteristic polynomials, and Berlekamp and
Massey's algorithm turns 2d of them into the polynomial of up to d differing elements. Two further sums verify it; a
bucket that does not verify is tried again with the degree bound doubled, and beyond the last bound its rows are
fetched whole. Roots are the hashes of the differing rows, which are fetched from both copies and compared by field.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, cut

P = 2_147_483_647
CHECKS = 2
BOUNDS = (4, 8, 16, 32)
ROWS_PER_BUCKET = 5


def _mul(f: list[int], g: list[int]) -> list[int]:
    out = [0] * (len(f) + len(g) - 1)
    for i, a in enumerate(f):
        for j, b in enumerate(g):
            out[i + j] += a * b
    return [x % P for x in out]


def _rem(f: list[int], g: list[int]) -> list[int]:
    """f modulo the monic g; coefficients from the lowest."""
    f, n = f[:], len(g) - 1
    for i in range(len(f) - 1, n - 1, -1):
        if c := f[i] % P:
            for j in range(n):
                f[i - n + j] -= c * g[j]
    f = [x % P for x in f[:n]]
    while f and not f[-1]:
        f.pop()
    return f


def _monic(f: list[int]) -> list[int]:
    inv = pow(f[-1], P - 2, P)
    return [x * inv % P for x in f]


def _gcd(f: list[int], g: list[int]) -> list[int]:
    while g:
        f, g = g, _rem(f, _monic(g))
    return _monic(f)


def _power(base: list[int], e: int, f: list[int]) -> list[int]:
    out = [1]
    for bit in bin(e)[2:]:
        out = _rem(_mul(out, out), f) if out else []
        if bit == "1":
            out = _rem(_mul(out, base), f) if out else []
    return out


def roots(f: list[int], rng: random.Random) -> list[int] | None:
    """The roots of a monic polynomial that splits into different linear factors; None if it does not."""
    if len(f) == 2:
        return [-f[0] % P]
    if len(f) == 3:
        d = (f[1] * f[1] - 4 * f[0]) % P
        s = pow(d, (P + 1) // 4, P)
        half = (P + 1) // 2
        return [(-f[1] + s) * half % P, (-f[1] - s) * half % P] if d and s * s % P == d else None
    x_p = _power([0, 1], P, f)
    if _rem([(a - b) % P for a, b in zip([*x_p, *[0] * len(f)], [0, 1, *[0] * len(f)], strict=False)], f):
        return None
    done, todo = [], [f]
    while todo:
        g = todo.pop()
        if len(g) <= 3:
            r = roots(g, rng)
            if r is None:
                return None
            done += r
            continue
        while True:
            h = _power([rng.randrange(P), 1], (P - 1) // 2, g)
            h = [*h, *[0] * (1 - len(h))]
            h[0] = (h[0] - 1) % P
            while h and not h[-1]:
                h.pop()
            if h and 1 < len(k := _gcd(g, h)) < len(g):
                break
        q, r, n = [], g[:], len(k) - 1
        for i in range(len(g) - 1, n - 1, -1):
            c = r[i] % P
            q.append(c)
            for j in range(n + 1):
                r[i - n + j] -= c * k[j]
        todo += [k, q[::-1]]
    return done


def decode(sums: list[int], bound: int) -> list[tuple[int, int]] | None:
    """(element, signed count) of up to ``bound`` elements from their power sums 1 to 2*bound+CHECKS; None if unverified."""
    c, b, length, shift, last = [1], [1], 0, 1, 1
    for n, s in enumerate(sums):
        d = s
        for i in range(1, length + 1):
            if i < len(c):
                d += c[i] * sums[n - i]
        d %= P
        if not d:
            shift += 1
            continue
        t, coef = c[:], d * pow(last, P - 2, P) % P
        c += [0] * (len(b) + shift - len(c))
        for i, x in enumerate(b):
            c[i + shift] = (c[i + shift] - coef * x) % P
        if 2 * length <= n:
            length, b, last, shift = n + 1 - length, t, d, 1
        else:
            shift += 1
    if length > bound:
        return None
    c += [0] * (length + 1 - len(c))
    found = roots(c[length::-1] if length else [1], random.Random(length)) if length else []
    if found is None or len(set(found)) < length or 0 in found:
        return None
    rows = [[pow(x, k + 1, P) for x in found] + [sums[k]] for k in range(length)]
    for i in range(length):
        j = next((j for j in range(i, length) if rows[j][i]), None)
        if j is None:
            return None
        rows[i], rows[j] = rows[j], rows[i]
        inv = pow(rows[i][i], P - 2, P)
        rows[i] = [x * inv % P for x in rows[i]]
        for j in range(length):
            if j != i and rows[j][i]:
                k = rows[j][i]
                rows[j] = [(x - k * y) % P for x, y in zip(rows[j], rows[i], strict=True)]
    counts = [r[-1] if r[-1] <= P // 2 else r[-1] - P for r in rows]
    return list(zip(found, counts, strict=True))


def _inverse(x: np.ndarray) -> np.ndarray:
    out, e, base = np.ones_like(x), P - 2, x.copy()
    while e:
        if e & 1:
            out = out * base % P
        base = base * base % P
        e >>= 1
    return out


def decode_many(s: np.ndarray, bound: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For buckets x sums: arrays (bucket position, element, sign), and the positions that are not verified.

    One differing row, and one row that changed, are solved for all buckets at once; other buckets one by one.
    """
    n, m = s.shape
    left = np.ones(n, bool)
    found: list[np.ndarray] = []

    def keep(ok: np.ndarray, *elements: tuple[np.ndarray, int]) -> None:
        at = np.flatnonzero(ok & left)
        found.extend(np.stack([at, x[at], np.full(len(at), sign)]) for x, sign in elements)
        left[at] = False

    def powers(x: np.ndarray) -> np.ndarray:
        out = np.empty((n, m), np.int64)
        p = np.ones(n, np.int64)
        for k in range(m):
            p = p * x % P
            out[:, k] = p
        return out

    for sign in (1, -1):
        x = s[:, 0] * sign % P
        keep((powers(x) * sign % P == s).all(1) & (x != 0), (x, sign))
    total = s[:, 1] * _inverse(s[:, 0]) % P
    half = (P + 1) // 2
    a, b = (total + s[:, 0]) % P * half % P, (total - s[:, 0]) % P * half % P
    keep(((powers(a) - powers(b)) % P == s).all(1) & (s[:, 0] != 0), (a, 1), (b, -1))
    bad = []
    for i in np.flatnonzero(left):
        r = decode([int(v) for v in s[i]], bound)
        if r is None:
            bad.append(i)
        else:
            found.append(np.array([[i] * len(r), [x for x, _ in r], [1 if k > 0 else -1 for _, k in r]], np.int64).reshape(3, len(r)))
    return found, np.array(bad, np.int64)


def _elements(df: DataFrame, key: list[str], fields: list[str], buckets: int) -> tuple[Column, Column]:
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in [*key, *fields]])
    row = F.xxhash64(nulls, *[F.col(c).cast("string") for c in [*key, *fields]])
    bucket = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key]), F.lit(buckets))
    return bucket, F.pmod(row, F.lit(P - 1)) + 1


def _sums(both: DataFrame, bound: int, parts: int) -> DataFrame:
    """Per bucket the signed power sums; buckets whose sums are all zero are left out."""
    m = 2 * bound + CHECKS
    df = both.repartition(parts, "b").withColumn("p1", F.col("h"))
    for k in range(2, m + 1):
        df = df.withColumn(f"p{k}", F.col(f"p{k - 1}") * F.col("h") % F.lit(P))
    g = df.groupBy("b").agg(*[F.sum(F.col(f"p{k}") * F.col("sign")).alias(f"s{k}") for k in range(1, m + 1)])
    s = F.array(*[F.pmod(F.col(f"s{k}"), F.lit(P)) for k in range(1, m + 1)])
    return g.where(" or ".join(f"s{k} % {P} <> 0" for k in range(1, m + 1))).select("b", s.alias("s"))


def _decoder(bound: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            b = pdf["b"].to_numpy()
            found, bad = decode_many(np.stack(pdf["s"].to_numpy()).astype(np.int64), bound)
            flat = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
            yield pd.DataFrame({"b": np.concatenate([b[flat[0]], b[bad]]), "h": np.concatenate([flat[1], np.zeros(len(bad), np.int64)]), "side": np.concatenate([flat[2], np.zeros(len(bad), np.int64)])})

    return run


def differing(base: DataFrame, copy: DataFrame, key: list[str], fields: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, int]:
    """(b, h, side) of the differing rows and the number of buckets: side 1 is in base only, -1 in copy only, 0 a bucket to fetch whole."""
    rows = max(base.count(), copy.count())
    buckets = max(1, rows // rows_per_bucket)
    parts = max(1, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 4_000_000)

    def side(df: DataFrame, sign: int) -> DataFrame:
        b, h = _elements(df, key, fields, buckets)
        return df.select(b.alias("b"), h.alias("h"), F.lit(sign).alias("sign"))

    both = side(base, 1).unionAll(side(copy, -1))
    done = None
    for n, bound in enumerate(BOUNDS):
        out = cut(_sums(both, bound, parts).mapInPandas(_decoder(bound), "b long, h long, side long"))
        solved = out.where("side <> 0")
        done = solved if done is None else done.unionAll(solved)
        open_buckets = out.where("side = 0").select("b")
        if open_buckets.isEmpty():
            return done, buckets
        if n + 1 < len(BOUNDS):
            both = both.join(open_buckets, "b", "left_semi")
    return done.unionAll(out.where("side = 0")), buckets


def compare(base: DataFrame, copy: DataFrame, key: list[str], fields: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(key..., finding, base_value, copy_value): one row per differing field, or missing_in_copy / missing_in_base.

    Values compare exactly; two nulls are equal, null and empty differ; so do null keys, which match null keys. Columns
    that are not named are ignored. Rows repeated whole count once; of a key with several different versions, equal
    versions are set aside and the rest are paired in hash order, a version left over being missing on the other side.
    Two empty tables give no rows.
    """
    wanted, buckets = differing(base, copy, key, fields, rows_per_bucket)
    hashes = wanted.where("side <> 0").select("b", "h").distinct()
    whole = wanted.where("side = 0").select("b").distinct()
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    some_whole = not whole.isEmpty()

    def fetch(df: DataFrame) -> DataFrame:
        b, h = _elements(df, key, fields, buckets)
        rows = df.select(*key, *fields, b.alias("b"), h.alias("h"))
        out = rows.join(F.broadcast(hashes) if small else hashes, ["b", "h"], "left_semi")
        if some_whole:
            out = out.unionAll(rows.join(F.broadcast(whole) if small else whole, "b", "left_semi").select(*out.columns))
        return out.distinct()

    def values(tag: str) -> Column:
        return F.array(*[F.col(c).cast("string") for c in fields]).alias(tag)

    x, y = fetch(base).select(*key, "h", values("__x")), fetch(copy).select(*key, "h", values("__y"))
    # one shuffle by key: both sides' versions of a key meet, equal ones cancel, the rest are paired by rank
    tagged = x.select(*key, "h", F.col("__x").alias("v"), F.lit(1).alias("side")).unionAll(y.select(*key, "h", F.col("__y").alias("v"), F.lit(-1).alias("side")))
    net = tagged.groupBy(*key, "v").agg(F.sum("side").alias("side"), F.min("h").alias("h")).where("side <> 0")
    item = F.struct("h", "v")
    sides = net.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("side") > 0, item))).alias("x"), F.array_sort(F.collect_list(F.when(F.col("side") < 0, item))).alias("y"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("x"), F.size("y")) - 1)).alias("i")
    pairs = sides.select(*key, "x", "y", at).select(*key, F.get("x", "i").alias("x"), F.get("y", "i").alias("y"))
    by_field = F.array(*[F.struct(F.lit(c).alias("finding"), F.col("x.v")[i].alias("base_value"), F.col("y.v")[i].alias("copy_value")) for i, c in enumerate(fields)])
    missing = lambda name: F.array(F.struct(F.lit(name).alias("finding"), F.lit(None).cast("string").alias("base_value"), F.lit(None).cast("string").alias("copy_value")))
    found = F.when(F.col("y").isNull(), missing("missing_in_copy")).when(F.col("x").isNull(), missing("missing_in_base")).otherwise(F.filter(by_field, lambda f: ~f["base_value"].eqNullSafe(f["copy_value"])))
    return pairs.select(*key, F.explode(found).alias("f")).select(*key, "f.*")
