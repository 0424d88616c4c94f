"""Rules over increments: the same compiled columns in micro-batches of a stream, upserted by key."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.config import DEFAULT, EngineConfig, RuleError
from ruleweave.plans.engine import evaluate


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share (``spark.checkpoint.dir``); a local session may have none and gets
    a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuleError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last version of each key, by a partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def run_increments(spark: SparkSession, path: str, rules: dict[str, Any], keys: list[str], config: EngineConfig = DEFAULT, per_batch: int = 1) -> DataFrame:
    """Reads a folder (or file) of Parquet as a stream of available files, evaluates the rules on each batch and
    appends to a versioned table; returns the latest version of each key. A batch that is run again
    replaces its own rows, so each input row counts once."""
    schema = spark.read.parquet(path).schema
    out, state = folder(spark, "increments"), folder(spark, "state")

    def write(batch: DataFrame, batch_id: int) -> None:
        made = evaluate(batch, rules, config=config).select(*keys, *rules)
        made.withColumn("_version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    source, names = (place.getParent().toString(), place.getName()) if single else (path, "*.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", names).parquet(source)
    running = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    running.awaitTermination()
    made = spark.read.option("basePath", out).parquet(out).drop("batch")
    return latest(made, keys, "_version").drop("_version")
