"""Language identification: multinomial naive Bayes over hashed character 1- to 3-grams.

Texts are lower-cased, runs of non-letters become one space. Counts by (language, bucket) are summed by
Spark; the matrix of log-probabilities (languages x BUCKETS floats, whatever the corpus) is broadcast,
and batches of texts are scored by gathering and summing its rows.

The pipeline's stage keeps a text only if its n-grams are about as probable in the predicted language as
those that the language was learned from.

Cases: null text or no letter: ``und`` with score 0. Null language: never learned from. Nothing
to learn from: ``und`` everywhere. Equal probabilities: the first language by name. Null doc_id: neither learned
from nor held out. Repeated rows count each. Other columns are ignored, or kept by ``keep_languages``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm import kernels as K

BUCKETS = 1 << 16
#: Added to every count.
SMOOTHING = 0.5
UNKNOWN = "und"
#: A text is in the language that it is predicted to be in if its n-grams gain (log-probability above that of an
#: n-gram never learned, on average) no less than the language's own n-grams by FAR + SHORT / sqrt(n-grams)
#: of their deviations, and at least LEAST of what these gain.
FAR, SHORT, LEAST = 1.25, 4.0, 0.25


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket and text of each n-gram, in the order of the texts, and the texts with a letter; a very long text comes
    in several stretches that have each n-gram once."""
    lowered = pc.utf8_lower(pc.fill_null(column, ""))
    before = np.zeros(0, K.U)
    for buf, offs, goes_on in K.stretches(*K.strings(lowered)):
        points, offs = K.code_points(buf, offs)
        own = K.owner(offs)
        letter = _letters()[points]
        has = np.zeros(len(offs) - 1, bool)
        has[own[letter]] = True
        points = np.where(letter, points, 32).astype(K.U)
        if goes_on:
            points, own = np.concatenate((before, points)), np.zeros(len(before) + len(points), np.int64)
        again = np.zeros(len(points), bool)
        again[1:] = (points[1:] == 32) & (points[:-1] == 32) & (own[1:] == own[:-1])
        points, own = points[~again], own[~again]
        yield *_grams(points, own, len(before) if goes_on else 0), has
        before = points[-2:]


def _grams(points: np.ndarray, own: np.ndarray, old: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each n-gram that ends behind the first ``old`` characters."""
    grams, owners = [], []
    for n in (1, 2, 3):
        if len(points) < n:
            continue
        m = len(points) - n + 1
        key = np.full(m, n, K.U)
        for j in range(n):
            key = key << K.U(20) | points[j : j + m]
        same = own[:m] == own[n - 1 :]
        same[: max(0, old - n + 1)] = False
        if n == 1:
            same &= points != 32
        grams.append((K.mix(key[same]) & K.U(BUCKETS - 1)).astype(np.int64))
        owners.append(own[:m][same])
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(grams)[order], owners[order]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
    docs: dict[str, int] = defaultdict(int)
    for batch in batches:
        for part in K.slices(batch, "text"):
            names = part.column("lang").dictionary_encode()
            which = names.indices.to_numpy()
            of = [counts[lang] for lang in names.dictionary.to_pylist()]
            for k, lang in enumerate(names.dictionary.to_pylist()):
                docs[lang] += int((which == k).sum())
            for bucket, own, _ in features(part.column("text")):
                for k, c in enumerate(of):
                    c += np.bincount(bucket[which[own] == k], minlength=BUCKETS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(c[at], docs[lang]))], ["lang", "bucket", "n"]
        )


class Model:
    """languages; table: (BUCKETS, languages) log-probabilities; prior."""

    def __init__(self, rows: pa.Table) -> None:
        self.languages = sorted(set(rows.column("lang").to_pylist()))
        place = {x: i for i, x in enumerate(self.languages)}
        which = np.array([place[x] for x in rows.column("lang").to_pylist()], np.int64)
        bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
        counts, docs = np.zeros((BUCKETS, len(place))), np.zeros(len(place))
        counts[bucket[bucket >= 0], which[bucket >= 0]] = n[bucket >= 0]
        docs[which[bucket < 0]] = n[bucket < 0]
        self.table = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)).astype(np.float32)
        self.prior = np.log(docs / max(docs.sum(), 1)) if len(place) else docs
        # mean and deviation of the gain of each learned n-gram by a model of all others
        all_grams = counts.sum(0)
        self.floor = np.log(SMOOTHING / (all_grams + SMOOTHING * BUCKETS))
        gain, size = np.log(np.maximum(counts - 1, 0) / SMOOTHING + 1), np.maximum(all_grams, 1)
        self.gain = (counts * gain).sum(0) / size
        self.deviation = np.sqrt(np.maximum((counts * gain**2).sum(0) / size - self.gain**2, 0))

    def _totals(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probability of each text by language, its number of n-grams, and whether it has a letter."""
        n = len(column)
        total, grams, has = np.zeros((n, len(self.languages))), np.zeros(n, np.int64), np.zeros(n, bool)
        step = max(1 << 12, (1 << 20) // max(1, len(self.languages)))
        for bucket, own, letters in features(column):
            has |= letters
            grams += np.bincount(own, minlength=n)
            for a in range(0, len(bucket), step):
                total += K.sums(self.table[bucket[a : a + step]], own[a : a + step], n)
        return total, grams, has

    def known(self, column) -> np.ndarray:
        """Whether each text is like the learned texts of the language it is predicted to be in."""
        total, grams, has = self._totals(column)
        if not self.languages:
            return np.zeros(len(has), bool)
        best = (total + self.prior).argmax(1)
        grams = np.maximum(grams, 1)
        gain = total[np.arange(len(has)), best] / grams - self.floor[best]
        usual = self.gain[best] - self.deviation[best] * (FAR + SHORT / np.sqrt(grams))
        # float32 sums differ from the floor by a little where no n-gram is known
        return has & (gain >= np.maximum(usual, LEAST * self.gain[best])) & (gain > 1e-4)

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        total, _, has = self._totals(column)
        if not self.languages:
            return [UNKNOWN] * len(has), np.zeros(len(has))
        total = total + self.prior
        total = np.exp(total - total.max(1, keepdims=True))
        best = total.argmax(1)
        score = total[np.arange(len(has)), best] / total.sum(1)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0)


def train(docs: DataFrame) -> Model:
    """The model of all rows of ``docs`` (text, lang)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counted = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model(counted.toArrow())


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in K.slices(batch, "text"):
                lang, score = model.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id's digits leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those not held out."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", held_out().alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows.where("not held_out and doc_id is not null")))
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a known language: rows without a letter go, and rows
    whose n-grams are too rare in the language predicted for them (``Model.known``), as those of languages and scripts
    never learned or of letters without sense. Given values of ``lang`` are left as they are. Only texts go to Python."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held_out())))
    known = K.per_text(lambda part: pa.array(model.value.known(part)), "boolean")
    return docs.where(known("text"))
