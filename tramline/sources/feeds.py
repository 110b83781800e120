"""Feeds as folders and zip files of CSV tables, and the smaller text inputs around them.

Scans keep every column as text and add nothing; a missing table is an empty one. Sinks write one named file, with
byte-order mark and CRLF as the format asks, from the rows of a table that fits one file (``MOST_ROWS``, checked).
"""

from __future__ import annotations

import csv
import io
import json
import os
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a single-file sink takes.
MOST_ROWS = 20_000_000
BOM = "﻿"

# The columns of the feed's tables, in the order they are written.
SCHEMAS = {
    "agency": "agency_id agency_name agency_url agency_timezone agency_lang agency_phone",
    "agency_jp": "agency_id agency_official_name agency_zip_number agency_address agency_president_pos agency_president_name",
    "office_jp": "office_id office_name office_url office_phone",
    "routes": "route_id agency_id route_short_name route_long_name route_type route_color",
    "routes_jp": "route_id route_update_date origin_stop via_stop destination_stop",
    "pattern_jp": "pattern_id route_id direction_id pattern_name",
    "stops": "stop_id stop_name stop_desc stop_lat stop_lon zone_id",
    "trips": "route_id service_id trip_id trip_headsign direction_id block_id shape_id",
    "stop_times": "trip_id arrival_time departure_time stop_id stop_sequence pickup_type drop_off_type",
    "calendar": "service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date",
    "calendar_dates": "service_id date exception_type",
    "fare_attributes": "agency_id fare_id price currency_type payment_method transfers",
    "fare_rules": "fare_id route_id origin_id destination_id contains_id",
    "feed_info": "feed_publisher_name feed_publisher_url feed_lang feed_start_date feed_end_date feed_version feed_contact_email feed_contact_url",
    "shapes": "shape_id shape_pt_lat shape_pt_lon shape_pt_sequence shape_dist_traveled",
    "frequencies": "trip_id start_time end_time headway_secs exact_times",
    "transfers": "from_stop_id to_stop_id transfer_type min_transfer_time",
    "translations": "table_name field_name language translation field_value",
}
REQUIRED = ["agency", "stops", "routes", "trips", "stop_times"]
OPTIONAL_COLUMNS = {"stop_desc", "zone_id", "block_id", "feed_contact_email", "feed_contact_url", "pattern_name"}


def text_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in SCHEMAS[table].split()])


def scan_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file or folder with a header: every column as text, byte-order mark gone, quoted newlines kept."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).option("ignoreLeadingWhiteSpace", False).csv(path, inferSchema=False)
    return df.toDF(*[c.lstrip(BOM).strip() for c in df.columns])


def scan_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a feed's folder (or of the one folder inside it); those that are not there are empty."""
    root = folder
    if not os.path.exists(os.path.join(folder, "stops.txt")):
        inside = [os.path.join(folder, x) for x in sorted(os.listdir(folder)) if os.path.exists(os.path.join(folder, x, "stops.txt"))]
        root = inside[0] if inside else folder
    out = {}
    for t in SCHEMAS:
        p = os.path.join(root, f"{t}.txt")
        out[t] = scan_csv(spark, p) if os.path.exists(p) else spark.createDataFrame([], text_schema(t))
    return out


def _rows_of(data: bytes) -> Iterator[dict[str, str]]:
    text = data.decode("utf-8-sig")
    yield from csv.DictReader(io.StringIO(text, newline=""))


def scan_zips(spark: SparkSession, pattern: str, table: str, suffix: bool = False) -> DataFrame:
    """One table out of every zip file that a path pattern names, with column feed_file; read in the executors.

    The member is the table's file at the top or one folder down; with ``suffix`` any member whose name ends so.
    """
    columns = SCHEMAS[table].split()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    hits = [n for n in z.namelist() if n.endswith(f"{table}.txt") and (suffix or n.count("/") <= 1 and n.split("/")[-1] == f"{table}.txt")]
                    rows = list(_rows_of(z.read(min(hits, key=lambda n: (n.count("/"), n))))) if hits else []
                yield pd.DataFrame({"feed_file": [path] * len(rows), **{c: pd.Series([r.get(c) for r in rows], dtype="object") for c in columns}})

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(read, "feed_file string, " + ", ".join(f"{c} string" for c in columns))


def _lines(df: DataFrame) -> Iterator[list[str]]:
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError("too many rows for one file; write a folder instead")
    for r in df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).toLocalIterator():
        yield list(r)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, bom: bool = True, newline: str = "\r\n") -> None:
    """One CSV file: given columns in order, absent ones empty, others dropped, null as empty."""
    wanted = columns or df.columns
    out = df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in wanted])
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(wanted)
        w.writerows(_lines(out))


def style_of(path: str) -> tuple[bool, str]:
    """Whether a file begins with a byte-order mark, and its newline."""
    with open(path, "rb") as f:
        head = f.read(65536)
    return head.startswith(BOM.encode()), "\r\n" if b"\r\n" in head else "\n"


def rewrite_csv(spark: SparkSession, path: str, column: str, renames: dict[str, str]) -> int:
    """Values of one column replaced in place, byte-order mark and newlines as they were; the number of changed rows."""
    bom, newline = style_of(path)
    df = scan_csv(spark, path)
    new = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in renames.items() for x in kv]), F.col(column)), F.col(column)) if renames else F.col(column)
    changed = df.where(~new.eqNullSafe(F.col(column))).count()
    rows = df.withColumn(column, new)
    tmp = f"{path}.new"
    write_csv(rows, tmp, bom=bom, newline=newline)
    os.replace(tmp, path)
    return changed


def written_columns(df: DataFrame, table: str) -> list[str]:
    """The table's columns, without optional ones that are blank in all rows."""
    have = [c for c in SCHEMAS[table].split() if c in OPTIONAL_COLUMNS and c in df.columns]
    used = df.agg(*[F.coalesce(F.bool_or(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""), F.lit(False)).alias(c) for c in have]).first() if have else {}
    return [c for c in SCHEMAS[table].split() if c not in OPTIONAL_COLUMNS or c in have and used[c]]


def write_feed(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """All tables of a feed as CSV files; required tables that are missing or empty are returned as warnings."""
    os.makedirs(folder, exist_ok=True)
    warnings = []
    for t in SCHEMAS:
        if t in tables and not tables[t].isEmpty():
            write_csv(tables[t], os.path.join(folder, f"{t}.txt"), written_columns(tables[t], t), bom=t != "calendar_dates")
        elif t in REQUIRED:
            warnings.append(f"{t} is missing")
    return warnings


def write_zip(folder: str, path: str, instead: dict[str, str] | None = None) -> tuple[list[str], list[str]]:
    """The feed's files of a folder in one zip, in fixed order; ``instead`` names another file for a table. (members, warnings)"""
    members, warnings = [], []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for t in SCHEMAS:
            p = os.path.join(folder, (instead or {}).get(t, f"{t}.txt"))
            if os.path.exists(p):
                z.write(p, f"{t}.txt")
                members.append(f"{t}.txt")
            elif t in REQUIRED:
                warnings.append(f"{t}.txt is missing")
    return members, warnings


def names_from(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names from a feed zip, a CSV file with stop_name, or one name a line."""
    if path.endswith(".zip"):
        df = scan_zips(spark, path, "stops", suffix=True).select(F.col("stop_name").alias("name"))
    else:
        head = spark.read.text(path).first()
        if head and "stop_name" in head[0]:
            df = scan_csv(spark, path).select(F.col("stop_name").alias("name"))
        else:
            df = spark.read.text(path).select(F.trim(F.regexp_replace("value", f"^{BOM}", "")).alias("name"))
    return df.where("trim(name) <> ''").distinct()


def holidays(spark: SparkSession, path: str) -> DataFrame:
    """(date, name) of a holiday CSV (Shift-JIS or UTF-8, at most 10 MB) whose rows begin with Y/M/D; other rows are left out."""
    if os.path.getsize(path) > 10_000_000:
        raise ValueError("too large for a list of holidays")
    with open(path, "rb") as f:
        data = f.read()
    for encoding in ("utf-8-sig", "cp932"):
        try:
            rows = [(r + [None])[:2] for r in csv.reader(io.StringIO(data.decode(encoding), newline="")) if r]
            break
        except UnicodeDecodeError:
            continue
    else:
        raise ValueError("neither UTF-8 nor Shift-JIS")
    df = spark.createDataFrame(rows, "day string, name string")
    return df.select(F.to_date(F.try_to_timestamp("day", F.lit("y/M/d"))).alias("date"), "name").where("date is not null")


def reading_dictionary(spark: SparkSession, path: str, key: str = "stop_name") -> DataFrame:
    """(name, readings: map of language and text) of a dictionary CSV; blank names and readings are left out."""
    df = scan_csv(spark, path)
    langs = [c for c in df.columns if c != key]
    pairs = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, langs)), F.array(*[F.coalesce(F.col(c), F.lit("")) for c in langs])), lambda k, v: F.trim(v) != "")
    return df.where(F.trim(key) != "").select(F.col(key).alias("name"), pairs.alias("readings"))


DOCUMENT = "source string, blocks array<struct<block_index int, direction_hint string, route_title string, stops array<struct<num int, name string, reserve boolean>>, trips array<struct<label string, cells array<struct<seq int, num int, name string, time string, reserve boolean>>>>>>"


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Extract documents (one JSON file each) by their schema; unknown fields are ignored, missing ones null."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A small report (at most 100,000 rows) as a JSON list, in UTF-8."""
    if rows.limit(100_001).count() > 100_000:
        raise ValueError("too many rows for a report")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(r) for r in rows.toJSON().collect()], f, ensure_ascii=False, indent=1)


def validator_notices(spark: SparkSession, path: str) -> DataFrame:
    """(severity, codes, total) of a validator's report, worst first by count."""
    n = spark.read.option("multiLine", True).schema("notices array<struct<code string, severity string, totalNotices long>>").json(path).select(F.explode("notices").alias("n")).select("n.*")
    return n.groupBy("severity").agg(F.count(F.lit(1)).alias("codes"), F.sum("totalNotices").alias("total")).orderBy(F.desc("total"), "severity")


class _Tables(HTMLParser):
    """Cells of all tables of a text; spans count as one cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[list] = []
        self.table, self.row, self.col, self.open = -1, -1, -1, False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row, self.col = self.table + 1, -1, -1
        elif tag == "tr":
            self.row, self.col = self.row + 1, -1
        elif tag in ("td", "th"):
            self.col, self.open = self.col + 1, True
            self.cells.append([max(self.table, 0), max(self.row, 0), self.col, ""])

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.cells[-1][3] += data


def html_cells(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, table, row, col, value) of every HTML table in a text column; texts without one, and null texts, give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf[ident], pdf[text], strict=True):
                p = _Tables()
                p.feed(t)
                rows += [(i, *c) for c in p.cells]
            yield pd.DataFrame(rows, columns=[ident, "table", "row", "col", "value"])

    kind = dict(df.dtypes)[ident]
    return df.where(F.lower(text).contains("<td") | F.lower(text).contains("<th")).select(ident, text).mapInPandas(run, f"`{ident}` {kind}, table int, row int, col int, value string")


def _office_cells(content: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(table, row, col, value) of a .docx or .pptx file: both are zip files of XML with tables of rows and cells."""
    from xml.etree import ElementTree

    plain = lambda e: e.tag.rsplit("}", 1)[-1]
    table = -1
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        pages = [n for n in z.namelist() if n == "word/document.xml" or n.startswith("ppt/slides/slide") and n.endswith(".xml")]
        for page in sorted(pages, key=lambda n: (len(n), n)):
            for t in ElementTree.fromstring(z.read(page)).iter():
                if plain(t) != "tbl":
                    continue
                table += 1
                for i, row in enumerate(r for r in t if plain(r) == "tr"):
                    for j, cell in enumerate(c for c in row if plain(c) == "tc"):
                        lines = ("".join(x.text or "" for x in p.iter() if plain(x) == "t") for p in cell.iter() if plain(p) == "p")
                        yield table, i, j, "\n".join(lines).strip()


def scan_office(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """(path, table, row, col, value) of the tables of .docx and .pptx files that hold ``least`` cells with a time or more.

    Files are read on the executors from any storage; one that is no such file gives nothing. Tables inside a cell count
    as tables of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(p, *c) for c in _office_cells(bytes(content))]
                except (zipfile.BadZipFile, SyntaxError):
                    continue
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object if c in ("path", "value") else "int32") for i, c in enumerate(("path", "table", "row", "col", "value"))})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cells = files.mapInPandas(run, "path string, table int, row int, col int, value string")
    timed = F.count_if(F.col("value").rlike("[0-9]{1,2}:[0-9]{2}"))
    kept = cells.groupBy("path", "table").agg(timed.alias("n")).where(F.col("n") >= least).drop("n")
    return cells.join(kept, ["path", "table"], "left_semi")


def grid(df: DataFrame, ident: str, text: str, separator: str = ",") -> DataFrame:
    """(ident, row, col, value) of the non-blank cells of a text's lines."""
    lines = df.where(F.col(text).isNotNull()).select(ident, F.posexplode(F.split(text, "\r?\n")).alias("row", "line"))
    return lines.select(ident, "row", F.posexplode(F.split("line", separator)).alias("col", "value")).where("trim(value) <> ''")


def cached_lookup(keys: DataFrame, key: str, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, misses) of distinct keys against a cache table; the misses go to a rate-limited client and into the cache."""
    k = keys.where(F.col(key).isNotNull()).select(key).distinct()
    return k.join(cache, key), k.join(cache.select(key), key, "left_anti")


def scan_shapefile(spark: SparkSession, path: str, encoding: str = "cp932", name_fields: tuple[str, ...] = ("P11_001", "name", "NAME"), box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(name, lat, lon, fields) of the points of every .shp file a pattern names, with the .dbf beside it.

    ``box`` (south, north, west, east) is tested before attributes are decoded. The name is the first of ``name_fields``
    that exists, else the first field whose name holds one of them, else null. Shapes that are no points are left out.
    """
    import struct

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content, attributes in zip(pdf["content"], pdf["dbf"], strict=True):
                n, head, size = struct.unpack("<IHH", attributes[4:12])
                fields, at, off = [], 32, 1
                while attributes[at] != 0x0D:
                    fields.append((attributes[at : at + 11].split(b"\0")[0].decode(encoding), off, attributes[at + 16]))
                    off, at = off + attributes[at + 16], at + 32
                names = [f for f, _, _ in fields]
                chosen = next((f for f in name_fields if f in names), next((f for f in names if any(x in f for x in name_fields)), None))
                rows, pos, i = [], 100, 0
                while pos + 8 <= len(content) and i < n:
                    words = struct.unpack(">I", content[pos + 4 : pos + 8])[0]
                    if words >= 10 and struct.unpack("<I", content[pos + 8 : pos + 12])[0] in (1, 11, 21):
                        x, y = struct.unpack("<dd", content[pos + 12 : pos + 28])
                        if box is None or (box[0] <= y <= box[1] and box[2] <= x <= box[3]):
                            rec = attributes[head + i * size : head + (i + 1) * size]
                            values = {f: rec[o : o + w].decode(encoding, "replace").strip() for f, o, w in fields}
                            rows.append((values.get(chosen), y, x, values))
                    pos, i = pos + 8 + words * 2, i + 1
                yield pd.DataFrame(rows, columns=["name", "lat", "lon", "fields"])

    files = spark.read.format("binaryFile").load(path)
    stem = F.regexp_replace("path", r"\.(shp|dbf|SHP|DBF)$", "")
    shp = files.where(F.lower("path").endswith(".shp")).select(stem.alias("stem"), "content")
    dbf = files.where(F.lower("path").endswith(".dbf")).select(stem.alias("stem"), F.col("content").alias("dbf"))
    return shp.join(dbf, "stem").select("content", "dbf").mapInPandas(read, "name string, lat double, lon double, fields map<string,string>")
