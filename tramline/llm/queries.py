"""Queries of the problems on texts and names, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .canonical import canonical
from .entity import match
from .leakage import MATCH, RUN, leaks
from .lookalike import consistent, learn, same_look
from .packing import windows
from .prose import is_prose, statistics

#: Vocabulary file of the public tokenizer that windows are counted with.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    stops, routes = table(spark, d, "stops"), table(spark, d, "routes")
    a = same_look(stops, "feed_id", "stop_id", "stop_name").select(F.lit("stops").alias("tbl"), "key_a", "key_b")
    return a.unionAll(same_look(routes, "feed_id", "route_id", "route_long_name").select(F.lit("routes").alias("tbl"), "key_a", "key_b"))


def p1_names(spark: SparkSession, d: str) -> DataFrame:
    """Every stop and route with the consistent form of its name."""
    stops = table(spark, d, "stops").select(F.lit("stops").alias("tbl"), F.col("stop_id").alias("key"), F.col("stop_name").alias("name"))
    both = stops.unionAll(table(spark, d, "routes").select(F.lit("routes").alias("tbl"), F.col("route_id").alias("key"), F.col("route_long_name").alias("name"))).distinct()
    return consistent(both, "name", "look", learn(both, "name"))


def p6_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every stop name with its reference entry and the distance to it; unmatched names have null."""
    return canonical(table(spark, d, "stops"), "stop_name", table(spark, d, "stop_reference"), "ref_id", "ref_name", "ref_reading")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = p6_mapped(spark, d)
    stops = table(spark, d, "stops").select("stop_id", "stop_name").distinct()
    return stops.join(found, stops["stop_name"] == found["name"]).select("stop_id", F.coalesce("ref_id", F.lit("NONE")).alias("ref_id")).distinct()


def p7_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of stops and survey points that may be one place, with the confidence of each."""
    return match(
        table(spark, d, "stops"), "stop_id", "feed_id", "stop_name", "stop_lat", "stop_lon",
        table(spark, d, "stop_survey"), "survey_id", "operator_name", "point_name", "point_reading", "lat", "lon", table(spark, d, "agency"), "agency_name",
        table(spark, d, "stop_reference").select(F.col("ref_name").alias("name"), F.col("ref_reading").alias("reading")),
    ).select(F.col("left_id").alias("stop_id"), F.col("right_id").cast("long").alias("survey_id"), "confidence", "settled")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_confidence(spark, d).where("confidence >= 0.5").select("stop_id", "survey_id")


def p8_windows(spark: SparkSession, d: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every text's pieces with their training window of 2,048 tokens."""
    return windows(table(spark, d, "documents"), "doc_id", "text", vocabulary)


def _leaks(spark: SparkSession, d: str, align: bool) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text", align=align)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose alignment with a passage scores as much as a run of 50 letters, and that have such a run in it."""
    return _leaks(spark, d, False).where((F.col("score") >= MATCH * RUN) & (F.col("longest_run") >= RUN)).select("doc_id", "item_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Documents with whole, partial or edited passages: longest shared run and alignment score."""
    return _leaks(spark, d, True)


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text statistics."""
    return statistics(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_terms"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).where((F.col("n_chars") > 0) & ~is_prose()).select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_names": p1_names, "p6_found": p6_found, "p6_mapped": p6_mapped, "p7_found": p7_found, "p7_confidence": p7_confidence, "p8_windows": p8_windows, "p9_found": p9_found, "p9_scores": p9_scores, "p10_found": p10_found, "p10_statistics": p10_statistics}
SQL: dict[str, str] = {}
