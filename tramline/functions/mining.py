"""Conditions written in free text: fares, dates, telephone numbers, addresses and labels found by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the conditions, read alike by Java, RE2 and Python.
PATTERNS = {
    "yen": "([0-9]{2,5}) ?円",
    "coins": "fare of ([0-9]{1,4}) coins",
    "clock": "([0-9]{1,2}:[0-9]{2})",
    "era_date": "(令和[0-9]{1,2}年[0-9]{1,2}月[0-9]{1,2}日)",
    "month_day": "([0-9]{1,2}月[0-9]{1,2}日)",
    "weekday": "(月曜|火曜|水曜|木曜|金曜|土曜|日曜)",
    "phone": "(0[0-9]{1,3}-[0-9]{2,4}-[0-9]{4})",
    "url": "(https?://[A-Za-z0-9./_-]+)",
    "postcode": "〒?([0-9]{3}-[0-9]{4})",
    "long_id": "([0-9]{13})",
    "route": "([0-9]+)系統",
}


def mine(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, kind, value, n): every pattern's distinct values in each text, with their counts; null texts give nothing."""
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), 1).alias("values")) for k, p in PATTERNS.items()])).alias("e")
    return df.where(F.col(text).isNotNull()).select(ident, every).select(ident, "e.kind", F.explode("e.values").alias("value")).groupBy(ident, "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def only_value(mined: DataFrame, ident: str) -> DataFrame:
    """Kinds for which a text has one value only, and so may be taken without asking."""
    return mined.groupBy(ident, "kind").agg(F.count(F.lit(1)).alias("values"), F.min("value").alias("value")).where("values = 1").drop("values")


def label_value(text: Column, label: str) -> Column:
    """What stands after a label and a colon, to the end of the line; empty if the label is not there."""
    return F.regexp_extract(text, label + "[:：] *([^\\n]+)", 1)


def title(text: Column, endings: tuple[str, ...] = ("線", "Circular", "エクスプレス")) -> Column:
    """The first piece of a text, cut at blanks and marks, that ends like a route's title and is 2 to 20 characters long."""
    pieces = F.split(text, "[ \\t\\n,:;|/()]+")
    ok = lambda x: F.length(x).between(2, 20) & F.exists(F.array(*map(F.lit, endings)), lambda e: x.endswith(e))
    return F.get(F.filter(pieces, ok), F.lit(0))
