"""Quality classifier by importance resampling.

Two hashed n-gram models, of target text (labelled good, not toxic) and of raw text (all documents),
give each document a log importance weight: the sum over its words and character 4-grams of the log
ratio of their probabilities. Adding Gumbel noise and taking the k largest keys is a sample without
replacement in proportion to the weights. Without a given k it is the expected number of target
documents, the sum over all documents of min(1, share of good labels x weight).

In the raw model each document counts by its language's share of characters in target text against that in
raw text, so that a language that is rarer among the labelled good loses nothing by it.

Target text comes from at most TARGET_DOCS labelled documents, the first by a hash of their ids;
counts of raw text cover every document. Both models are arrays of 2 x BUCKETS numbers.

Cases: null or empty text has weight 0 in the log. Null labels count as not good; a document with
contradicting labels is not good. No good label: all weights are equal. A language without a good
label: its n-grams that no other language has tell nothing. Null language: one with the empty one. Null doc_id: no label. Repeated
rows get the same key; ties at the k-th key are all kept. Other columns are kept by ``resample``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm import kernels as K
from ruleweave.llm.shared import cut, join_checked

#: Buckets of words, and as many of character 4-grams.
BUCKETS = 1 << 16
#: Labelled documents that the target model may use.
TARGET_DOCS = 20_000
#: Pseudo-counts that pull rare buckets' ratios towards 1.
SMOOTHING = 4.0
#: Raw n-grams count in units of its inverse, so that sums are whole numbers, the same in any order.
UNIT = 1 << 30
SEED = 20_011


def features(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text of each n-gram of texts: words, then character 4-grams, which come in stretches for a very long
    text; texts ascend within each."""
    buf, offs = K.strings(column)
    start, _, h = K.words(buf, offs)
    yield (h & K.U(BUCKETS - 1)).astype(np.int64), np.searchsorted(offs, start, side="right") - 1
    before = buf[:0]
    for more, ends, goes_on in K.stretches(buf, offs):
        if goes_on:
            more = np.concatenate((before, more))
            ends = np.array([0, len(more)])
        before = more[-3:]
        own = K.owner(ends)
        m = max(0, len(more) - 3)
        key = np.zeros(m, K.U)
        for j in range(4):
            key = key << K.U(8) | more[j : j + m]
        same = own[:m] == own[3:] if m else np.zeros(0, bool)
        yield (K.mix(key[same]) & K.U(BUCKETS - 1)).astype(np.int64) + BUCKETS, own[:m][same]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    for batch in batches:
        for part in K.slices(batch, "text"):
            good = part.column("good").to_numpy(zero_copy_only=False)
            share = part.column("share").to_numpy().astype(np.float64)
            for bucket, own in features(part.column("text")):
                raw += np.bincount(bucket, share[own], 2 * BUCKETS).astype(np.int64)
                target += np.bincount(bucket[good[own]], minlength=2 * BUCKETS)
    at = np.flatnonzero(raw)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def log_ratios(bucket: np.ndarray, raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the target's and the raw model's probability of each bucket; words and
    characters are two models."""
    r, t = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    r[bucket], t[bucket] = raw, target
    out = np.zeros(2 * BUCKETS, np.float32)
    for half in (slice(0, BUCKETS), slice(BUCKETS, None)):
        if t[half].sum():
            expected = r[half] * (t[half].sum() / r[half].sum())
            out[half] = np.log((t[half] + SMOOTHING) / (expected + SMOOTHING))
    return out


def log_weights(ratios: np.ndarray, column) -> np.ndarray:
    """The sum of each text's log ratios."""
    return sum(K.sums(ratios[bucket], own, len(column)) for bucket, own in features(column))


#: Columns of the results, and reserved names for them beside columns of other tables.
WEIGHT, KEY = "log_weight", "sample_key"
OWN_WEIGHT, OWN_KEY = "__resample_weight", "__resample_key"


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratios by bucket, and the share of good documents among the labelled."""
    by_doc = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.min(F.coalesce(F.col("quality") == 1, F.lit(False))) & F.min(F.coalesce(F.col("toxic") == 0, F.lit(False)))).alias("good")
    )
    share = by_doc.agg(F.avg(F.col("good").cast("int"))).first()[0] or 0.0
    good = by_doc.where("good").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(TARGET_DOCS)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    marked = docs.select(F.col("doc_id").cast("long"), "text", lang.alias("lang")).join(F.broadcast(good), "doc_id", "left")
    marked = marked.withColumn("good", F.coalesce("good", F.lit(False)))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    shares = cut(marked.groupBy("lang").agg(F.sum(size).alias("raw"), F.sum(F.when(F.col("good"), size).otherwise(0)).alias("target")), "shares")
    shares = shares.select("lang", F.when(F.col("raw") > 0, F.round(F.col("target") / F.col("raw") * UNIT)).otherwise(0).cast("long").alias("share"))
    counted = join_checked(marked, shares, ["lang"], "left").select("text", "good", "share").mapInArrow(_count, "bucket int, raw long, target long")
    table = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    return log_ratios(*(table.column(c).to_numpy() for c in ("bucket", "raw", "target"))), share


def gumbel_noise():
    """Gumbel noise that depends on the document's id only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value: histograms of ever narrower ranges, then the few values of one bin."""
    if k <= 0:
        return None
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        return None
    inside, left = df.select(column), min(k, n)
    while lo < hi and n > 10_000:
        width = (hi - lo) / 1024
        place = F.least(F.floor((F.col(column) - lo) / width), F.lit(1023))
        bins = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for _, count, a, b in sorted(((r["b"], r["n"], r["lo"], r["hi"]) for r in bins), reverse=True):
            if left <= count:
                lo, hi, n = a, b, count
                break
            left -= count
        inside = inside.where((F.col(column) >= lo) & (F.col(column) <= hi))
    if lo == hi:
        return lo
    return sorted((r[0] for r in inside.collect()), reverse=True)[left - 1]


def weight_column(docs: DataFrame, labels: DataFrame):
    """The log weight of ``text`` as a column, and the share of good documents among the labelled."""
    ratios, share = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    return K.per_text(lambda column: pa.array(log_weights(shared.value, column)), "double")("text"), share


def importance_sample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, sample_key, kept (true) of the k documents that the sample takes."""
    weight, share = weight_column(docs, labels)
    keys = docs.select(F.col("doc_id").cast("long"), weight.alias(WEIGHT)).withColumn(KEY, F.col(WEIGHT) + gumbel_noise())
    keys = cut(keys, "keys")
    return _above(keys, WEIGHT, KEY, share, k).withColumn("kept", F.lit(True))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns, whatever their names; only texts go to Python, and each is
    scored once: the rows are written with their keys."""
    weight, share = weight_column(docs, labels)
    keys = cut(docs.withColumn(OWN_WEIGHT, weight).withColumn(OWN_KEY, F.col(OWN_WEIGHT) + gumbel_noise()), "keys")
    return _above(keys, OWN_WEIGHT, OWN_KEY, share, k).select(*(F.col(f"`{c}`") for c in docs.columns))


def _above(keys: DataFrame, weight: str, key: str, share: float, k: int | None) -> DataFrame:
    """The rows whose key is among the k largest."""
    if k is None:
        k = round(keys.agg(F.sum(F.least(F.lit(1.0), share * F.exp(F.least(weight, F.lit(700.0)))))).first()[0] or 0)
    least = kth_largest(keys, key, k)
    return keys.where(F.col(key) >= least if least is not None else F.lit(False))
