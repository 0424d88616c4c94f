"""Helpers of the corpus operators: shared storage, cut lineage, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000
#: A key with more than this part of a table's rows is hot.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where a local session has none (tests), a temporary folder is set once; a cluster must name it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; Spark removes it when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, its lineage cut,
    and no loss of an executor can undo it."""
    spark = df.sparkSession
    path = f"{new_folder(spark, name)}/t"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables made by ``cut`` that nothing is going to read any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            spark = df.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int | None = None) -> DataFrame:
    """Join with ``right``, broadcast if its counted rows are at most BROADCAST_ROWS, else shuffled."""
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right, on, how)


def join_rows(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join many rows of ``left`` with the one row that ``right`` has of each key. A key with more than a
    HOT-th of the rows of ``left`` would fill one task: at most HOT keys can have so many, so their rows of ``right``
    are broadcast, and only the others are shuffled. Both sides should be written tables: they are read twice."""
    rows = left.count()
    counts = left.where(F.col(on).isNotNull()).groupBy(on).count().where(f"count > {rows // HOT}").select(on)
    keys = [r[0] for r in counts.limit(HOT + 1).collect()]
    if not keys:
        return left.join(right, on, how)
    hot = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in keys], counts.schema))
    few = F.broadcast(right.join(hot, on, "left_semi"))
    return left.join(hot, on, "left_semi").join(few, on, how).unionByName(left.join(hot, on, "left_anti").join(right, on, how))


def text_or_empty(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))
