"""Text helpers shared by operators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import BLANK


def nfkc(text: str) -> str:
    """NFKC form; the check first, as most text is in it already."""
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def _kana_map() -> tuple[str, str]:
    """Katakana and the Hiragana 96 code points below them."""
    kata = "".join(chr(c) for c in range(0x30A1, 0x30F7))
    return kata, "".join(chr(ord(c) - 96) for c in kata)


def hiragana(c: Column) -> Column:
    """Katakana shifted to Hiragana."""
    return F.translate(c, *_kana_map())


# Radicals that Unicode's compatibility forms leave, each before its ideograph.
RADICALS = "⺠民⻁虎⻄西⻑長⻘青⻤鬼⻩黄⻭歯⻯竜"


def radicals(c: Column) -> Column:
    """Text in compatibility form with the radicals that are left written as ideographs."""
    return F.translate(c, RADICALS[::2], RADICALS[1::2])


def has_kanji(c: Column) -> Column:
    """Whether a text holds a kanji."""
    return c.rlike("[一-鿿]")


def route_number(c: Column) -> Column:
    """Leading digits before a blank; empty if there are none."""
    return F.regexp_extract(c, rf"^([0-9]+)[{BLANK}]+", 1)


def without_number(c: Column) -> Column:
    """A route name without its leading number."""
    return F.regexp_replace(c, rf"^[0-9]+[{BLANK}]+", "")


def route_key(short: Column, long: Column) -> Column:
    """Key that routes of two feeds are matched by: short name, else leading number, else the whole name; '' if all are blank."""
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(blank(short), blank(route_number(long)), blank(long), F.lit(""))


def stem(c: Column, suffixes: tuple[str, ...]) -> Column:
    """A name without the first of the suffixes it ends with, if two characters or more remain."""
    out = None
    for s in suffixes:
        fits = c.endswith(s) & (F.length(c) >= len(s) + 2)
        out = F.when(fits, F.left(c, F.length(c) - len(s))) if out is None else out.when(fits, F.left(c, F.length(c) - len(s)))
    return out.otherwise(c)


def squeeze(c: Column) -> Column:
    """Blanks of all widths folded to one, ends cut."""
    return F.trim(F.regexp_replace(c, "[ \\t\\r\\n\\u3000\\u00a0]+", " "))


def pattern_key(ids: Column) -> Column:
    """One text for a sequence of stops."""
    return F.array_join(ids, "|")


def short_hash(c: Column) -> Column:
    """First eight hexadecimal digits of SHA-1."""
    return F.left(F.sha1(c.cast("binary")), F.lit(8))


def safe_file(c: Column) -> Column:
    """A text usable as a file name."""
    return F.regexp_replace(c, rf'[\\/:*?"<>|{BLANK}]+', "_")


def column_index(c: Column) -> Column:
    """Spreadsheet column letters as a number from 1: A is 1, AA is 27."""
    return F.aggregate(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64)


def zip_code(c: Column) -> Column:
    """Whether a text is a Japanese postcode."""
    return c.rlike(r"^[0-9]{3}-?[0-9]{4}$")


# Signs of direction or age that may stand before a place's name.
DIRECTIONS = "上中下東西南北新旧"


def compatible_direction(a: Column, b: Column, prefixes: str = DIRECTIONS) -> Column:
    """Whether two place names may be one: names that differ only by a direction in front may not.

    Equal directions (or none) are compatible. One-sided: the rest must not equal, or from two characters on begin or
    end, the other name. Both but different: the rests must not be equal, nor hold each other from two characters on.
    """
    pa, pb = (F.when(F.left(x, F.lit(1)).isin(*prefixes) & (F.length(x) > 1), F.left(x, F.lit(1))).otherwise("") for x in (a, b))
    ra, rb = (F.when(p != "", F.substring(x, 2, 10_000)).otherwise(x) for p, x in ((pa, a), (pb, b)))
    touch = lambda x, y: x.startswith(y) | x.endswith(y) | y.startswith(x) | y.endswith(x)
    one = lambda rest, other: ~((rest == other) | ((F.length(rest) >= 2) & touch(rest, other)))
    both = ~((ra == rb) | ((F.length(ra) >= 2) & (F.length(rb) >= 2) & (ra.contains(rb) | rb.contains(ra))))
    return F.when(pa == pb, True).when(pb == "", one(ra, b)).when(pa == "", one(rb, a)).otherwise(both)
