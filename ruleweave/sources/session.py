"""Sessions: Python workers need to import this package."""

from __future__ import annotations

import os

import ruleweave
from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Lets the session's Python workers import the package from where the driver has it. On a cluster whose
    machines do not share that folder, ship the package with ``spark.submit.pyFiles``."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(ruleweave.__file__)))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{home}:{env.get('PYTHONPATH', '')}".rstrip(":")
    return spark
