"""Timetables out of word sets, cell grids and HTML tables, as relational steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIME = r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?\z"


def is_time(c: Column) -> Column:
    """Whether a cell is a clock time."""
    return F.trim(c).rlike(TIME)


def grid_to_cells(grid: DataFrame, ident: str, transposed: bool = False) -> DataFrame:
    """(ident, trip, seq, name, time) of a stops x trips grid (ident, row, col, value).

    Stops stand in the first column with a name, trips in columns with two times or more; ``transposed`` swaps the two.
    """
    row, col = ("col", "row") if transposed else ("row", "col")
    g = grid.select(ident, F.col(row).alias("r"), F.col(col).alias("c"), F.trim("value").alias("v"))
    t = is_time(F.col("v"))
    trips = g.where(t).groupBy(ident, "c").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    names = g.where(~t & (F.col("v") != "")).groupBy(ident, "c").agg(F.count(F.lit(1)).alias("n")).groupBy(ident).agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("nc"))
    stops = g.join(names, ident).where(F.col("c") == F.col("nc")).where(~t).select(ident, "r", F.col("v").alias("name"))
    return g.where(t).join(trips, [ident, "c"]).join(stops, [ident, "r"]).select(ident, F.col("c").alias("trip"), F.col("r").alias("seq"), "name", F.col("v").alias("time"))


def timetable_grids(grid: DataFrame, ident: str, rows: int = 3, times: int = 4, columns: int = 3) -> DataFrame:
    """(ident) of grids that are timetables: enough rows, times and columns."""
    g = grid.groupBy(ident).agg(F.countDistinct("row").alias("r"), F.countDistinct("col").alias("c"), F.count_if(is_time(F.col("value"))).alias("t"))
    return g.where((F.col("r") >= rows) & (F.col("t") >= times) & (F.col("c") >= columns)).select(ident)


def lines_of(words: DataFrame, page: str, tolerance: float = 7.0) -> DataFrame:
    """Words (page, text, x0, top) with ``line``: rows of words whose tops follow within the tolerance."""
    w = W.partitionBy(page).orderBy("top", "x0")
    new = F.coalesce((F.col("top") - F.lag("top").over(w) > tolerance).cast("int"), F.lit(0))
    return words.withColumn("__n", new).withColumn("line", F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__n")


def columns_of(words: DataFrame, page: str, gap: float = 20.0) -> DataFrame:
    """(page, column, x, n): clusters of the times' x positions; the mean stands for a cluster."""
    t = words.where(is_time(F.col("text")))
    w = W.partitionBy(page).orderBy("x0", "top")
    new = F.coalesce((F.col("x0") - F.lag("x0").over(w) > gap).cast("int"), F.lit(0))
    c = t.withColumn("__n", new).withColumn("column", F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return c.groupBy(page, "column").agg(F.avg("x0").alias("x"), F.count(F.lit(1)).alias("n"))


def words_to_grid(words: DataFrame, page: str, tolerance: float = 7.0, gap: float = 20.0) -> DataFrame:
    """(page, row, col, value) of a page's words: names of a line joined in column -1, times in their nearest column."""
    l = lines_of(words, page, tolerance)
    t = is_time(F.col("text"))
    names = l.where(~t).groupBy(page, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), "").alias("value"))
    c = columns_of(words, page, gap).select(page, "column", "x")
    near = l.where(t).join(c, page).groupBy(page, "line", "text", "x0").agg(F.min_by("column", F.struct(F.abs(F.col("x") - F.col("x0")), "column")).alias("col"))
    cells = near.select(page, F.col("line").alias("row"), F.col("col").cast("int").alias("col"), F.col("text").alias("value"))
    return names.select(page, F.col("line").alias("row"), F.lit(-1).alias("col"), "value").unionAll(cells)


def uncovered_columns(words: DataFrame, page: str, cells: DataFrame, least: int = 5, share: float = 0.1) -> DataFrame:
    """Pages where the cells hold fewer times than the words by ``least`` and by ``share``."""
    a = words.where(is_time(F.col("text"))).groupBy(page).agg(F.count(F.lit(1)).alias("seen"))
    b = cells.where(is_time(F.col("value"))).groupBy(page).agg(F.count(F.lit(1)).alias("kept"))
    j = a.join(b, page, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return j.where(F.col("seen") - F.col("kept") >= F.greatest(F.lit(least), share * F.col("seen"))).select(page, "seen", "kept")
