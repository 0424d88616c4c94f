"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's rate is target share x total rows / its rows, so that the expected output has as many rows
as the input. A document's count is the Poisson distribution of that mean inverted at a uniform number that
a hash of (seed, doc_id) gives: the number of terms of the cumulative sum that are at most u. Means of over
CHUNK are split into equal parts with a number each, whose counts add up (a sum of Poisson counts). Each document
is exploded by its count, and rows are dealt and sorted by a hash of (seed, doc_id, copy).

Cases: null source: a source of its own. Null doc_id: the text's md5 takes its place. Null text stays null. Equal
doc_ids get equal counts. An empty table stays empty. Sources without a target share get weight by size
to the power ``temper``; with explicit targets they get none. All columns are kept; columns of the input that are
named as one of the three added ones are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.shared import BROADCAST_ROWS, cut

SEED = "mix-1"
#: Source shares go with size to this power: 1 keeps the proportions, 0 makes sources equal.
TEMPER = 0.7
#: Greatest mean that is inverted at once, and terms of the sum that are looked at.
CHUNK, TERMS = 8.0, 64
#: Columns that are added, and how names begin that are reserved until the end.
ADDED, OWN = ("mix_rate", "mix_count", "mix_copy"), "__mix_"


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) with 52 bits from the md5 of the parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_count(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    """The count of a document whose source has this rate."""
    pieces = F.greatest(F.ceil(rate / CHUNK), F.lit(1)).cast("int")
    mean = rate / pieces

    def one(j: Column) -> Column:
        u = uniform(F.lit(seed), doc_id, j.cast("string"))
        start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("total"), F.lit(0).alias("count"), u.alias("u"))
        step = lambda a, k: F.when(
            a["total"] <= a["u"],
            F.struct((a["term"] * mean / k).alias("term"), (a["total"] + a["term"] * mean / k).alias("total"), (a["count"] + 1).alias("count"), a["u"].alias("u")),
        ).otherwise(a)
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["count"])

    return F.aggregate(F.transform(F.sequence(F.lit(1), pieces), one), F.lit(0), lambda a, c: a + c)


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, temper: float = TEMPER) -> DataFrame:
    """(mix_source, mix_rate) of each source."""
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(F.count("*").alias("n"))
    if targets is None:
        weighted = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temper)))
    else:
        given = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]) if targets else F.create_map().cast("map<string,double>")
        weighted = sizes.withColumn("w", F.coalesce(given[F.coalesce("mix_source", F.lit(""))], F.lit(0.0)).cast("double"))
    weighted = cut(weighted, "sources")
    all_n, all_w = weighted.agg(F.sum("n"), F.sum("w")).first()
    share = F.try_divide(F.col("w") * F.lit(all_n), F.lit(all_w) * F.col("n"))
    return weighted.select("mix_source", F.coalesce(share, F.lit(0.0)).alias("mix_rate"))


def replicate(docs: DataFrame, targets: dict[str, float] | None = None, temper: float = TEMPER, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, repeated and shuffled, with mix_rate, mix_count and mix_copy (from 0)."""
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    rates = source_rates(docs, targets, temper).toDF(f"{OWN}source", f"{OWN}rate")
    same = F.col("source").eqNullSafe(F.col(f"{OWN}source"))
    if rates.count() <= BROADCAST_ROWS:
        rated = docs.join(F.broadcast(rates), same, "left")
    else:  # too many sources to send to every task: the hot ones are spread over salts
        salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted = rates.withColumn(f"{OWN}salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = docs.withColumn(f"{OWN}mine", F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)).cast("int"))
        rated = rows.join(salted, same & (F.col(f"{OWN}mine") == F.col(f"{OWN}salt")), "left")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("md5:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    counted = rated.withColumn(f"{OWN}count", poisson_count(F.col(f"{OWN}rate"), name, seed)).where(f"{OWN}count > 0")
    copies = counted.withColumn(f"{OWN}copy", F.explode(F.sequence(F.lit(0), F.col(f"{OWN}count") - 1)))
    dealt = copies.withColumn(f"{OWN}order", F.xxhash64(F.lit(seed), name, f"{OWN}copy"))
    dealt = dealt.repartition(f"{OWN}order").sortWithinPartitions(f"{OWN}order")
    return dealt.select(*columns, *(F.col(f"{OWN}{c.removeprefix('mix_')}").alias(c) for c in ADDED))
