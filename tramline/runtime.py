"""Session defaults, shared-folder checkpoints, checked broadcasts and salted joins."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast after it has been counted.
BROADCAST_ROWS = 200_000


def session(app: str = "tramline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow transfer."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, unless their PYTHONPATH has it already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_tramline_shipped", False):
        return
    local = tempfile.mkdtemp(prefix="tramline-package-")
    path = shutil.make_archive(os.path.join(local, "tramline"), "zip", root, "tramline")
    if named := spark.conf.get("spark.checkpoint.dir", None):  # a cluster: hand it over through the shared folder
        with open(path, "rb") as f:
            data = f.read()
        shared = sc._jvm.org.apache.hadoop.fs.Path(f"{named.rstrip('/')}/package-{uuid.uuid4().hex}/tramline.zip")
        out = shared.getFileSystem(sc._jsc.hadoopConfiguration()).create(shared)
        out.write(bytearray(data))
        out.close()
        path = str(shared.toString())
    sc.addPyFile(path)
    sc._tramline_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a folder of Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one is set only where the session names none (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tramline-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: a lineage cut that survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tramline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; nothing that is still to be computed may read it."""
    if path := getattr(df, "_tramline_path", None):
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, counted; unhinted beyond that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salt_by: str | None = None, spread: int = 24, hot: int = 64) -> DataFrame:
    """Join on ``keys`` with the rows of the most frequent left keys spread over ``spread`` tasks.

    A key is hot if it holds more than 1/``hot`` of the left rows, so there are fewer than ``hot`` of them at any
    size and the list of hot keys is safe to broadcast. Their right rows are repeated once per salt; all other keys
    join unsalted. ``how`` may be inner, left, left_semi or left_anti. Null keys match nothing, as in SQL; of a left
    join they are kept.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"))
    hot_keys = counts.crossJoin(F.broadcast(total)).where(F.col("__n") * hot > F.col("__t")).where(F.col("__n") > 20_000).select(*keys)
    heavy = [tuple(r) for r in hot_keys.collect()]
    salt = F.pmod(F.xxhash64(salt_by) if salt_by else F.monotonically_increasing_id(), F.lit(spread)).cast("int")
    if not heavy:
        return left.join(right, keys, how)
    flag = F.broadcast(left.sparkSession.createDataFrame(heavy, left.select(*keys).schema).withColumn("__hot", F.lit(True)))
    l2 = left.join(flag, keys, "left").withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(F.lit(0))).drop("__hot")
    r2 = right.join(flag, keys, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return l2.join(r2, [*keys, "__salt"], how).drop("__salt")
