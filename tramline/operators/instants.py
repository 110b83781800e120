"""Mixed timestamp notations and zones to one UTC second.

``interpretations`` lists every valid reading of a written time; a chain of readings per source is then chosen by
Viterbi in record order, with penalties for distance from the service day, for changes of notation and for steps back
in time. Plain clock times on days without a clock change never leave the JVM, and the commonest notations with one
reading are read there.

A value with one reading settles the chain before it, so a source's chain falls into stretches between such values. Pieces
of a source decode apart from each other; what a piece leaves open at its ends is joined with the open end of the next and
chosen in a second, small step. The result is that of one chain over the whole source, however it is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut, maybe_broadcast

UTC = timezone.utc
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
PLAIN = r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"
#: Record numbers of one source that are decoded in one task.
BLOCK = 8192

# Offsets in hours of zone abbreviations, English month names, first years of Japanese eras.
ABBREVIATIONS = {"UTC": 0, "GMT": 0, "Z": 0, "JST": 9, "CET": 1, "CEST": 2, "MST": -7, "MDT": -6, "AEST": 10, "AEDT": 11}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
ERAS = {"令和": 2019, "平成": 1989, "昭和": 1926, "R": 2019, "H": 1989, "S": 1926}

_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0xA0: 0x20, 0x2212: 0x2D, 0x2236: 0x3A}
_CLOCK = r"(?P<h>\d{1,2})\s*:\s*(?P<mi>\d{2})(?:\s*:\s*(?P<s>\d{2})(?:[.,]\d+)?)?"
_KANJI = r"(?P<h>\d{1,2})\s*時(?:\s*(?:(?P<mi>\d{1,2})\s*分|(?P<half>半))(?:\s*(?P<s>\d{1,2})(?:\.\d+)?\s*秒)?)?"
_ZONE = r"(?P<zone>Z|[+-]\d{2}:?\d{2}|[A-Za-z]+(?:/[A-Za-z_]+)+|[A-Z]{3,4})"
_HALF_DAY = r"(?P<ap>午前|午後|正午|[AaPp]\.?[Mm]\.?)"
_DATE = {
    "iso": r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})",
    "slash": r"(?P<y>\d{4})[/.](?P<m>\d{1,2})[/.](?P<d>\d{1,2})",
    "tail": r"(?P<a>\d{1,2})[/.](?P<b>\d{1,2})[/.](?P<y>\d{4})",
    "kanji": r"(?:(?P<era>令和|平成|昭和|[RHS])(?P<ey>\d{1,2}|元)|(?P<y>\d{4}))\s*年\s*(?P<m>\d{1,2})\s*月\s*(?P<d>\d{1,2})\s*日",
    "mail": r"(?:[A-Za-z]{3,9},?\s+)?(?P<d>\d{1,2})\s+(?P<mon>[A-Za-z]{3})[a-z]*\s+(?P<y>\d{4})",
}
_FULL = [(name, re.compile(rf"{d}(?:T|\s+)\s*(?:{_HALF_DAY}\s*)?{c}(?:\s*{_ZONE})?", re.A if c is _CLOCK else 0)) for name, d in _DATE.items() for c in (_CLOCK, _KANJI)]
_COMPACT = re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[T ]?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?(?:[.,]\d+)?\s*{_ZONE}?")
_BARE = [(f"bare{i}", re.compile(rf"(?P<next>翌日?|翌朝)?\s*(?:{_HALF_DAY}\s*)?{c}(?:\s*(?P<ap2>[AaPp]\.?\s*[Mm]\.?))?")) for i, c in enumerate((_CLOCK, _KANJI))]
_BLANKS = re.compile(r"\s+")
_HHMM = re.compile(r"(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?")


@lru_cache(512)
def _zone(name: str):
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - any unknown name
        return None


def _wall(d: date, h: int, mi: int, s: int, zone) -> int | None:
    """UTC second of a wall-clock time; of two, the first; one skipped by a clock change keeps the offset before it."""
    if mi > 59 or s > 59 or zone is None:
        return None
    local = datetime(d.year, d.month, d.day, tzinfo=zone) if h > 23 else datetime(d.year, d.month, d.day, h, mi, s, tzinfo=zone)
    if h > 23:
        if h > 47:
            return None
        n = d + timedelta(days=1)
        local = datetime(n.year, n.month, n.day, h - 24, mi, s, tzinfo=zone)
    return int((local - EPOCH).total_seconds())


@lru_cache(65536)
def _noon_start(service_date: str, tz: str) -> int | None:
    """Noon of the day in the zone minus 12 hours."""
    try:
        d = datetime.strptime(service_date, "%Y%m%d")
    except (TypeError, ValueError):
        return None
    z = _zone(tz) if tz else None
    return None if z is None else int((d.replace(hour=12, tzinfo=z) - EPOCH).total_seconds()) - 43200


def _hour(g: dict) -> tuple[int, int, int] | None:
    h, mi, s = int(g["h"]), int(g.get("mi") or (30 if g.get("half") else 0)), int(g.get("s") or 0)
    ap = (g.get("ap") or g.get("ap2") or "").lower().replace(".", "").replace(" ", "")
    if ap in ("午後", "pm"):
        h = h + 12 if h < 12 else h
    elif ap in ("午前", "am"):
        h = 0 if h == 12 else h
    return None if mi > 59 or s > 59 else (h, mi, s)


def interpretations(value: str | None, service_date: str | None, tz: str | None) -> list[tuple[int, str, float]]:
    """All valid readings of ``value`` as (utc_second, notation, cost), preferred first; empty if it names no time.

    Without a date a reading counts from noon of the service day minus 12 hours and may pass 24 hours; with a date and
    no zone it is wall-clock time of ``tz``.
    """
    if value is None:
        return []
    v = _BLANKS.sub(" ", str(value).translate(_WIDE)).strip()
    if not v:
        return []
    out: list[tuple[int, str, float]] = []

    def add(y: int, m: int, d: int, clock, zone_text: str | None, notation: str, cost: float) -> None:
        try:
            day = date(y, m, d)
        except ValueError:
            return
        if clock is None:
            return
        if zone_text is None:
            t = _wall(day, *clock, _zone(tz) if tz else None)
        elif zone_text in ABBREVIATIONS:
            t = _wall(day, *clock, timezone(timedelta(hours=ABBREVIATIONS[zone_text])))
        elif zone_text[0] in "+-":
            k = int(zone_text[1:3]) * 60 + int(zone_text[-2:])
            t = None if k >= 1440 else _wall(day, *clock, timezone(timedelta(minutes=k if zone_text[0] == "+" else -k)))
        else:
            t = _wall(day, *clock, _zone(zone_text))
        if t is not None:
            out.append((t, notation, cost))

    if v.isascii() and v.isdigit():
        n = len(v)
        if n in (9, 10):
            out.append((int(v), "epoch_s", 0.0))
        elif n in (12, 13):
            out.append((int(v) // 1000, "epoch_ms", 0.0))
        elif n == 16:
            out.append((int(v) // 1_000_000, "epoch_us", 0.0))
        elif n in (4, 6) and (m := _HHMM.fullmatch(v)) and (start := _noon_start(service_date, tz)) is not None and (c := _hour(m.groupdict())):
            out.append((start + c[0] * 3600 + c[1] * 60 + c[2], "digits", 0.0))
        if out or n not in (12, 14):
            return out
    for notation, rx in _BARE:
        if m := rx.fullmatch(v):
            c, start = _hour(g := m.groupdict()), _noon_start(service_date, tz)
            if c and start is not None and c[0] < 48:
                out.append((start + c[0] * 3600 + c[1] * 60 + c[2] + (86400 if g["next"] and c[0] < 24 else 0), notation, 0.0))
            return out
    if m := _COMPACT.fullmatch(v):
        g = m.groupdict()
        add(int(g["y"]), int(g["m"]), int(g["d"]), _hour(g), g["zone"], "compact", 0.0)
        return out
    for notation, rx in _FULL:
        if not (m := rx.fullmatch(v)):
            continue
        g = m.groupdict()
        c, zone = _hour(g), g["zone"]
        if notation == "tail":
            add(int(g["y"]), int(g["b"]), int(g["a"]), c, zone, "dmy", 0.0)
            add(int(g["y"]), int(g["a"]), int(g["b"]), c, zone, "mdy", 0.0)
        elif notation == "mail":
            add(int(g["y"]), MONTHS.get(g["mon"].lower(), 0), int(g["d"]), c, zone, notation, 0.0)
        elif notation == "kanji" and g["era"]:
            add(ERAS[g["era"]] - 1 + (1 if g["ey"] == "元" else int(g["ey"])), int(g["m"]), int(g["d"]), c, zone, notation, 0.0)
        else:
            add(int(g["y"]), int(g["m"]), int(g["d"]), c, zone, notation, 0.0)
            if notation == "slash" and g["m"] != g["d"]:
                add(int(g["y"]), int(g["d"]), int(g["m"]), c, zone, "ydm", 6.0)
        return out
    return out


def viterbi(rows: list[list[tuple[int, str, float]]], anchors: list[int | None], switch: float = 1.0, back: float = 1.5, day: float = 2.0) -> list[int | None]:
    """One reading per row, of least total cost; rows without a reading give None and do not break the chain.

    A reading costs its own cost and ``day`` for each day beyond the service day's span; following another it costs
    ``switch`` if the notation changes and ``back`` if it lies before it. Ties take the reading listed first. Where a
    row has one reading, all earlier rows are settled, so memory follows the ambiguous stretches only.
    """
    result: list[int | None] = [None] * len(rows)
    # (cost, (path before, row, second), (second, notation)) of the best path to each reading of the row before
    paths: list[tuple[float, tuple | None, tuple[int, str] | None]] = [(0.0, None, None)]

    def settle(path: tuple | None) -> None:
        while path:
            path, j, t = path
            result[j] = t

    for i, options in enumerate(rows):
        if not options:
            continue
        step = []
        for t, notation, cost in options:
            if len(options) > 1 and anchors[i] is not None:
                cost += day * max(0.0, abs(t - anchors[i] - 86400) / 86400 - 1.5)
            follow = [p[0] + (0 if p[2] is None else switch * (p[2][1] != notation) + back * (t < p[2][0])) for p in paths]
            k = follow.index(min(follow))
            step.append((follow[k] + cost, (paths[k][1], i, t), (t, notation)))
        if len(step) == 1:
            settle(step[0][1])
            step = [(0.0, None, step[0][2])]
        paths = step
    settle(min(paths, key=lambda p: p[0])[1])
    return result


def _once(c: Column, f) -> Column:
    """``f`` of ``c``, with ``c`` evaluated once however often ``f`` takes it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _utc(wall: Column, tz: Column) -> Column:
    """UTC second of a wall clock, given as seconds since 1970 as if it were UTC; of two, the first; a skipped one keeps the offset before the change."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(wall), tz))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Seconds from 1970 to the start of a date, as if it were UTC; null if there is no such date."""
    zero = F.lit(0)
    return F.unix_date(F.try_make_timestamp_ntz(y, m, d, zero, zero, zero).cast("date")).cast("long") * 86400


def _day(day: Column) -> Column:
    """``_days`` of YYYYMMDD."""
    part = lambda i, n: F.substring(day, i, n).cast("int")
    return F.when(day.rlike("^[0-9]{8}$"), _days(part(1, 4), part(5, 2), part(7, 2)))


def changes_clock(day: Column, tz: Column) -> Column:
    """Whether the day (YYYYMMDD) has a clock change in the zone."""
    return _once(_day(day), lambda d: _utc(d + 86400, tz) - _utc(d, tz) != 86400)


def noon_start(day: Column, tz: Column) -> Column:
    """UTC second of noon of the day (YYYYMMDD) in the zone, less 12 hours."""
    return _utc(_day(day) + 43200, tz) - 43200


_A = r"[ \t\n\f\r]*"
_JVM_CLOCK = rf"([0-9]{{1,2}}){_A}:{_A}([0-9]{{2}})(?:{_A}:{_A}([0-9]{{2}})(?:[.,][0-9]+)?)?"
_JVM_BARE = rf"^{_JVM_CLOCK}$"
_JVM_ISO = rf"^([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(?:T|[ \t\n\f\r]+){_A}{_JVM_CLOCK}{_A}(Z|[+-](?:[01][0-9]|2[0-3]):?[0-5][0-9])?$"


def read_plainly(value: Column, start: Column, tz: Column) -> Column:
    """(t, notation) of clock times, ISO dates and epochs, as ``interpretations`` gives them; null for what it must read.

    ``start`` is the day's ``noon_start``; ``tz`` must be null or a zone that Spark knows.
    """
    v = F.trim(F.translate(value, "".join(map(chr, _WIDE)), "".join(map(chr, _WIDE.values()))))
    # each notation is taken apart at once: digits and sign stay, whatever parts them becomes a comma
    part = lambda x, i: F.coalesce(F.try_element_at(x, F.lit(i)).try_cast("int"), F.lit(0))
    pair = lambda t, notation: F.when(t.isNotNull(), F.struct(t.cast("long").alias("t"), F.lit(notation).alias("notation")))
    clock = lambda x, i: part(x, i) * 3600 + part(x, i + 1) * 60 + part(x, i + 2)

    def bare(x: Column) -> Column:
        return pair(F.when((part(x, 1) < 48) & (part(x, 2) < 60) & (part(x, 3) < 60), start + clock(x, 1)), "bare0")

    def iso(x: Column) -> Column:
        wall = F.when((part(x, 4) < 24) & (part(x, 5) < 60) & (part(x, 6) < 60), _days(part(x, 1), part(x, 2), part(x, 3)) + clock(x, 4))
        zone = F.try_element_at(x, F.lit(7))
        sign = F.when(F.left(zone, F.lit(1)) == "-", -1).otherwise(1)
        offset = sign * (F.substring(zone, 2, 2).cast("int") * 3600 + F.right(zone, F.lit(2)).cast("int") * 60)
        return pair(F.when(zone == "", _utc(wall, tz)).when(zone == "Z", wall).otherwise(wall - offset), "iso")

    n = F.length(v)
    whole = v.try_cast("long")
    return F.when(F.length(value) <= 64, (  # a long one is left to Python, where blanks are folded first
        F.when(v.rlike(_JVM_BARE), _once(F.split(F.regexp_replace(v, _JVM_BARE, "$1,$2,$3"), ","), bare))
        .when(v.rlike(_JVM_ISO), _once(F.split(F.regexp_replace(v, _JVM_ISO, "$1,$2,$3,$4,$5,$6,$7"), ","), iso))
        .when(v.rlike("^[0-9]{9,16}$"), F.when(n.isin(9, 10), pair(whole, "epoch_s")).when(n.isin(12, 13), pair(F.floor(whole / 1000), "epoch_ms")).when(n == 16, pair(F.floor(whole / 1_000_000), "epoch_us")))
    ))


#: Where a decoded row stands: settled in its piece, open at its beginning or end, or in a piece without any settled row.
CLOSED, HEAD, TAIL, WHOLE = range(4)
_OPTIONS = "array<struct<t: long, n: string, c: double>>"


def normalise_times(
    records: DataFrame, zones: DataFrame, fields: list[str], source: str = "feed_id", order: str = "row_id",
    service_date: str = "service_date", tz: str = "agency_timezone", skip_plain: bool = True, block: int = BLOCK,
) -> DataFrame:
    """(order, fld, utc_second) for every value of ``fields`` that names a time.

    ``zones`` has one time zone per source (the least, if several); a source without one, or with one that is no zone,
    gives no value that needs it. ``skip_plain`` leaves out plain HH:MM:SS on days without a clock change. One chain runs
    over a source's remaining values in ``order``; ``block`` record numbers are decoded in one task, so the largest source
    splits over tasks like any other, and does not change the result. Null values, null dates and unreadable values give
    no row; repeated rows give equal rows.
    """
    spark = records.sparkSession
    names = spark._jvm.java.time.ZoneId.getAvailableZoneIds().toString().strip("[]").split(", ")
    known = F.broadcast(spark.createDataFrame([(n,) for n in sorted(names)], "__tz string"))
    z = zones.where(F.col(source).isNotNull()).groupBy(F.col(source)).agg(F.min(tz).alias("__tz")).join(known, "__tz", "left_semi")
    z = maybe_broadcast(z)
    # days and zones are few beside the records: their clocks are worked out once
    days = records.select(source, F.col(service_date).alias("__date")).distinct().join(z, source).select("__date", "__tz").distinct()
    days = days.withColumn("__start", noon_start(F.col("__date"), F.col("__tz"))).withColumn("__change", changes_clock(F.col("__date"), F.col("__tz")))
    days = maybe_broadcast(cut(days.where(F.col("__start").isNotNull())))
    base = records.select(F.col(source), F.col(order), F.col(service_date).alias("__date"), *fields).join(z, source, "left").join(days, ["__date", "__tz"], "left")
    base = base.select(source, order, "__date", "__tz", "__start", "__change", F.explode(F.array(*[F.struct(F.lit(f).alias("fld"), F.col(f).cast("string").alias("v")) for f in fields])).alias("e"))
    joined = base.select("*", "e.fld", "e.v").where(F.col("v").isNotNull() & (F.length(F.trim("v")) > 0))
    if skip_plain:
        joined = joined.where(~F.col("v").rlike(PLAIN) | F.coalesce("__change", F.lit(False)))
    # exploded, so that each value is read once however many columns are taken from the reading
    joined = joined.select("*", F.explode_outer(F.array(read_plainly(F.col("v"), F.col("__start"), F.col("__tz")))).alias("__q"))
    some = F.col("__q").isNull()  # only what Python must read is sent to it
    joined = joined.select(
        source, order, "fld", "__date", "__tz", F.when(some, F.col("v")).alias("v"), F.col("__q.t").alias("__t"), F.col("__q.notation").alias("__n"),
        F.coalesce(F.floor(F.col(order) / F.lit(block)).cast("long"), F.lit(-(2**62))).alias("__block"),
    )
    kinds = dict(records.dtypes)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, pdf in enumerate(batches):
            if not len(pdf):
                continue
            who, where = pd.factorize(pdf[source])[0], pdf["__block"].to_numpy()
            start = np.flatnonzero(np.concatenate([[True], (np.diff(who) != 0) | (np.diff(where) != 0)]))
            piece = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(pdf))))
            how, dates, zone, values = (pdf[c].to_numpy(object) for c in ("__n", "__date", "__tz", "v"))
            second, ways = pdf["__t"].fillna(0).to_numpy().astype(np.int64), pdf["__t"].notna().to_numpy().astype(np.int64)
            options: dict[int, list] = {}
            for i in np.flatnonzero(ways == 0).tolist():
                r = _read(values[i], dates[i], zone[i])
                ways[i] = len(r)
                if len(r) == 1:
                    second[i], how[i] = r[0][:2]
                elif r:
                    options[i] = r
            one = np.flatnonzero(ways == 1)
            # rows that stay open, and the settled rows next to the ends of each piece: (row, part, shown, options, anchor)
            ends: list[tuple] = []
            last = {}
            for i in options:  # in order: stretches between the same two settled rows go together
                at = int(np.searchsorted(one, i))
                lo = int(one[at - 1]) if at and piece[one[at - 1]] == piece[i] else None
                hi = int(one[at]) if at < len(one) and piece[one[at]] == piece[i] else None
                if lo is None or hi is None:
                    ends.append((i, WHOLE if lo is hi else HEAD if lo is None else TAIL, True, options[i], _noon_start(dates[i], zone[i])))
                else:
                    last.setdefault((lo, hi), []).append(i)
            for (lo, hi), row in last.items():
                chain = [[(int(second[lo]), how[lo], 0.0)], *[options[i] for i in row], [(int(second[hi]), how[hi], 0.0)]]
                for i, got in zip(row, viterbi(chain, [None, *[_noon_start(dates[i], zone[i]) for i in row], None])[1:-1], strict=True):
                    second[i], ways[i] = got, 1
            if len(one):
                edge = np.flatnonzero(np.concatenate([[True], np.diff(piece[one]) != 0]))
                for part, rows in ((HEAD, one[edge]), (TAIL, one[np.append(edge[1:], len(one)) - 1])):
                    ends += [(i, part, False, [(int(second[i]), how[i], 0.0)], None) for i in rows.tolist()]
            keep = np.flatnonzero(ways == 1)
            rows = np.append(keep, [e[0] for e in ends]).astype(np.int64)
            first = start[piece[rows]]
            fill = lambda j, blank: [blank] * len(keep) + [e[j] for e in ends]  # noqa: B023, E731
            take = lambda c, at: pdf[c].take(at).array  # noqa: B023, E731
            yield pd.DataFrame({
                order: take(order, rows), "fld": take("fld", rows), "utc_second": second[rows], "part": np.array(fill(1, CLOSED), np.int32), "shown": fill(2, True), "options": pd.Series(fill(3, None), dtype=object),
                "anchor": pd.array(fill(4, None), dtype="Int64"), source: take(source, rows), "piece_order": take(order, first), "piece_fld": take("fld", first), "piece_batch": np.full(len(rows), k, np.int32),
            })

    kind = f"`{order}` {kinds[order]}, fld string, utc_second long, part int, shown boolean, options {_OPTIONS}, anchor long, `{source}` {kinds[source]}, piece_order {kinds[order]}, piece_fld string, piece_batch int"
    ordered = joined.repartition(source, "__block").sortWithinPartitions(source, "__block", order, "fld")
    decoded = cut(ordered.mapInPandas(decode, kind))
    closed = decoded.where(F.col("part") == CLOSED).select(order, "fld", "utc_second")
    ends = decoded.where(F.col("part") != CLOSED).withColumn("piece", F.struct("piece_order", "piece_fld", "piece_batch"))
    # pieces of a source in order: a piece that is open as a whole goes on with the border before it
    pieces = ends.groupBy(source, "piece").agg((F.max("part") == WHOLE).alias("whole"))
    w = W.partitionBy(source).orderBy("piece")
    pieces = pieces.withColumn("step", F.when(F.lag("whole", 1, False).over(w), 0).otherwise(1)).withColumn("border", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    pieces = pieces.select(F.col(source).alias("__s"), F.col("piece").alias("__p"), "border")
    met = ends.join(pieces, ends[source].eqNullSafe(F.col("__s")) & ends["piece"].eqNullSafe(F.col("__p")))
    met = met.withColumn("border", F.col("border") + (F.col("part") == TAIL).cast("int"))
    # nothing is open at most borders
    met = met.withColumn("open", F.max("shown").over(W.partitionBy("__s", "border"))).where("open")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "fld"], kind="stable")
        rows = [[(int(o["t"]), o["n"], o["c"]) for o in x] for x in pdf["options"]]
        got = viterbi(rows, [None if pd.isna(x) else int(x) for x in pdf["anchor"]])
        out = pd.DataFrame({order: pdf[order].to_numpy(), "fld": pdf["fld"].to_numpy(), "utc_second": pd.array(got, dtype="Int64")})
        return out[pdf["shown"].to_numpy(bool)]

    late = met.groupBy("__s", "border").applyInPandas(choose, f"`{order}` {kinds[order]}, fld string, utc_second long")
    return closed.unionAll(late)


@lru_cache(65536)
def _read(value: str, service_date: str | None, tz: str | None) -> list[tuple[int, str, float]]:
    """``interpretations``, remembered: arrival and departure are often one."""
    return interpretations(value, service_date, tz)
