"""Where documents, rules and schemas come from, and where results go."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False) -> DataFrame:
    """JSON documents: one a line, or (multiline) one or a list of them a file."""
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def parse_documents(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """A column of JSON texts as typed columns beside the others; texts that do not parse give nulls."""
    return df.withColumn("__doc", F.from_json(column, schema)).select(*[c for c in df.columns if c != column], "__doc.*")


def read_schema(path: str) -> Any:
    """A rule or schema file, through Spark's file systems."""
    spark = SparkSession.getActiveSession()
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; nulls stay as fields, so that all documents have the same."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside carry a tag by which ``cancel`` ends them."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.interruptTag(tag)
