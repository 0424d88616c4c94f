"""The corpus pipeline: five stages, each one of the operators in ruleweave.llm.

A stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read as the next one's docs.

Cases, in every stage: columns other than those of documents are left out; an empty table gives no row; rows are judged
one by one, so repeated rows share their fate except where a stage keeps one of them, and null ids, languages and
sources are values like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm.language import keep_languages
from ruleweave.llm.mixing import replicate
from ruleweave.llm.ngram_join import ngram_components
from ruleweave.llm.packing import pack_documents
from ruleweave.llm.queries import prepare, table
from ruleweave.llm.resampling import resample
from ruleweave.llm.shared import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(docs: DataFrame) -> DataFrame:
    """The columns of documents, in a session whose Python workers are set up."""
    prepare(docs.sparkSession)
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model takes for one of the learned languages stay; other languages, scripts and gibberish go,
    and null texts and texts without a letter."""
    return keep_languages(rows_of(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample takes stay. A null or empty text has the weight 1, so the noise of its id
    decides; rows with a null id share one noise."""
    return resample(rows_of(docs), table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of least doc_id, null ids last. Rows are told apart by a
    number of their own, so repeated and null ids are judged each by its own text."""
    rows = cut(rows_of(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = ngram_components(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = rows.select("row", "doc_id").join(groups, "row").groupBy("component_id").agg(F.min(order).getField("row").alias("row"))
    return rows.join(first.select("row"), "row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target shares; equal ids in a source have equal
    counts, null ids those of their texts."""
    return replicate(rows_of(docs)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences; a null or empty text is the end id alone."""
    return pack_documents(rows_of(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: models, sampling noise, tokenizers and packing are outside it. Tested stage by stage.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
