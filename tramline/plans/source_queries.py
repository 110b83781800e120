"""Scans of tables inside texts, and the feed's CSV form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import table
from ..sources import feeds
from .base import Registry

R = Registry()


@R.add("src21_html_tables", "select doc_id, len(regexp_extract_all(text, '<td')) cells, len(regexp_extract_all(text, '<tr')) \"rows\" from documents where contains(text, '<td')")
def src21(s, d):
    c = feeds.html_cells(table(s, d, "documents"), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("table", "row").alias("rows"))


@R.add("src19_cell_grid", "with l as (select doc_id, i - 1 \"row\", regexp_split_to_array(text, '\\r?\\n')[i] line from documents, unnest(generate_series(1, len(regexp_split_to_array(text, '\\r?\\n')))) u(i) where contains(text, ',')), c as (select doc_id, \"row\", j - 1 col, string_split(line, ',')[j] \"value\" from l, unnest(generate_series(1, len(string_split(line, ',')))) u(j)) select doc_id, count(*) n, max(col) last_col from c where trim(\"value\", ' ') <> '' group by 1")
def src19(s, d):
    t = table(s, d, "documents").where(F.col("text").contains(","))
    return feeds.grid(t, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("col").alias("last_col"))


@R.add("flt11_header_rows", "with l as (select doc_id, i - 1 \"row\", string_split(text, chr(10))[i] line from documents, unnest(generate_series(1, len(string_split(text, chr(10))))) u(i) where text is not null) select doc_id, \"row\" from l where not regexp_matches(line, '[0-9]{1,2}:[0-9]{2}') and len(regexp_extract_all(line, '便')) >= 2")
def flt11(s, d):
    """Rows with two trip labels or more and no time."""
    l = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return l.where(~F.col("line").rlike("[0-9]{1,2}:[0-9]{2}") & (F.size(F.regexp_extract_all("line", F.lit("(便)"), 1)) >= 2)).select("doc_id", "row")


@R.add("src26_raw_text_sizes", "select source, count(*) n, cast(sum(length(text)) as bigint) chars from documents where text is not null group by 1")
def src26(s, d):
    return table(s, d, "documents").where("text is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@R.add("src28_reading_dictionary", "select ref_name \"name\", ref_reading reading from stop_reference where trim(ref_name, ' ') <> '' and ref_reading is not null")
def src28(s, d):
    return table(s, d, "stop_reference").where("trim(ref_name) <> '' and ref_reading is not null").select(F.col("ref_name").alias("name"), F.col("ref_reading").alias("reading"))


@R.add("stm05_cache_misses", "select distinct stop_name from stops where stop_name is not null and stop_name not in (select ref_name from stop_reference where ref_name is not null)")
def stm05(s, d):
    cache = table(s, d, "stop_reference").select(F.col("ref_name").alias("stop_name"), "ref_id").dropDuplicates(["stop_name"])
    return feeds.cached_lookup(table(s, d, "stops"), "stop_name", cache)[1]


QUERIES, SQL = R.queries, R.sql
