"""The corpus operators as queries: each takes (spark, sf_dir) and reads its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import ruleweave
from pyspark.sql import DataFrame, SparkSession

from ruleweave.llm import oracles


#: Rows and bytes of an Arrow batch that goes to a Python worker, at most.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Python workers of the session can import this package, get small batches, and give memory back that they have
    no more use for. Called before any of them starts: workers that differ in this are not shared."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    home = os.path.dirname(os.path.dirname(os.path.abspath(ruleweave.__file__)))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{home}:{env.get('PYTHONPATH', '')}".rstrip(":")
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "1")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleweave.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleweave.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleweave.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleweave.llm.resampling import importance_sample

    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleweave.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleweave.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleweave.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleweave.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleweave.llm.mixing import replicate

    return replicate(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleweave.llm.token_files import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return read_token_files(spark, files)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_ngram_jaccard_join,
        op3_warc,
        op4_quality_classifier,
        op5_best_fit_packing,
        op6_language_id,
        op7_quality_rules,
        op8_sharding,
        op9_source_mixing,
        op10_token_files,
    )
}

#: DuckDB SQL for the same results, where SQL can express them.
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op3_warc": oracles.WARC,
    "op9_source_mixing": oracles.MIXING,
}
