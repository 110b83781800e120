"""Shared inputs of the query modules: well-formed visits and places, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..operators.spatial import placed
from ..runtime import table

# Blanks of any width and clock times, in the SQL engine's regular expressions.
BLANK = r"\x09-\x0d\x20\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
HMS = rf"^[{BLANK}]*([0-9]{{1,2}}):([0-9]{{1,2}})(:([0-9]{{1,2}}))?[{BLANK}]*$"


class Registry:
    """Queries of a module by name, each with its SQL if SQL can say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def deco(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return deco


def places(spark: SparkSession, d: str) -> DataFrame:
    """One row a stop: feed_id, stop_id, name, lat, lon (null where the stop has no place)."""
    s = table(spark, d, "stops")
    ok = placed(s, "stop_lat", "stop_lon")
    return s.groupBy("stop_id").agg(F.min("feed_id").alias("feed_id"), F.coalesce(F.max("stop_name"), F.lit("")).alias("name"), F.max(F.when(ok, F.col("stop_lat"))).alias("lat"), F.max(F.when(ok, F.col("stop_lon"))).alias("lon"))


PLACES = """
ok_ as (select *, stop_lat is not null and stop_lon is not null and not isnan(stop_lat) and not isnan(stop_lon) and not (stop_lat = 0 and stop_lon = 0) and abs(stop_lat) <= 90 and abs(stop_lon) <= 180 ok from stops),
places as (select stop_id, min(feed_id) feed_id, coalesce(max(stop_name), '') "name", max(case when ok then stop_lat end) lat, max(case when ok then stop_lon end) lon from ok_ group by stop_id)"""


def visits(spark: SparkSession, d: str) -> DataFrame:
    """One row a trip and position: feed_id, trip_id, seq, stop_id, name, lat, lon, arr, dep (seconds, null where the value is no clock time), a (text, as HH:MM:SS if it is one); the latest row counts.

    No row goes for its times.
    """
    t = table(spark, d, "stop_times").where((F.coalesce("trip_id", F.lit("")) != "") & F.col("stop_sequence").isNotNull())
    last = t.withColumn("rn", F.row_number().over(W.partitionBy("trip_id", "stop_sequence").orderBy(F.desc("row_id")))).where("rn = 1")
    cols = last.select("feed_id", "trip_id", F.col("stop_sequence").alias("seq"), "stop_id", clock.seconds(F.col("arrival_time")).alias("arr"), clock.seconds(F.col("departure_time")).alias("dep"), clock.normal(F.col("arrival_time")).alias("a"))
    return cols.join(places(spark, d).drop("feed_id"), "stop_id", "left").withColumn("name", F.coalesce("name", F.lit("")))


def _int(c: str, k: int) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract({c}, '{HMS}', {k}), '') as int), 0)"


def secs(c: str) -> str:
    """SQL of the seconds of a clock time; null if it is none."""
    return f"case when regexp_matches({c}, '{HMS}') then {_int(c, 1)} * 3600 + {_int(c, 2)} * 60 + {_int(c, 4)} end"


def normal(c: str) -> str:
    """SQL of a clock time as HH:MM:SS; anything else unchanged."""
    part = " || ':' || ".join(f"lpad(cast({_int(c, k)} as varchar), 2, '0')" for k in (1, 2, 4))
    return f"case when regexp_matches({c}, '{HMS}') then {part} else {c} end"


VISITS = f"""{PLACES},
st_ as (select *, row_number() over (partition by trip_id, stop_sequence order by row_id desc) rn from stop_times where coalesce(trip_id, '') <> '' and stop_sequence is not null),
visits as (select st_.feed_id, st_.trip_id, st_.stop_sequence seq, st_.stop_id, {secs("arrival_time")} arr, {secs("departure_time")} dep, {normal("arrival_time")} a, coalesce(p."name", '') "name", p.lat, p.lon
  from st_ left join places p on p.stop_id = st_.stop_id where rn = 1)"""


def hav(a: str, b: str, c: str, d: str) -> str:
    """SQL of the great-circle metres."""
    return f"2 * 6371000.0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"
