"""Quality rules: base counts of every text, and bands of perplexity by language.

The language model is a modified Kneser-Ney model of character trigrams, the characters as they are. Workers count the
grams of each language in sorted arrays of 64-bit hashes; Spark adds them up over all documents and derives the lower
orders, the discounts and the probabilities, so what is gathered grows with the input and lies in written tables.
What only one document has tells nothing about that document: such grams count as never seen and get the probability
that the lower orders give them.

Texts are scored by binary search in a sorted array of the hashes of the most frequent grams (TOP at most, sent to all
tasks); the grams that are not among them are joined with the written model. Every gram of a text is in one of the two.

A document is rejected if its log-perplexity lies outside its language's band: the median plus or minus BAND times the
median deviation, wider for short texts. Medians are over all documents that pass the base rules, by Spark's
approximate percentile with an error of a 10,000th of the documents in rank.

Cases: null or empty text: no words, fails the base rules. Null language: a language of its own. Any number of
languages. Repeated rows count each. An empty table stays empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm import kernels as K
from ruleweave.llm.shared import cut, join_checked

#: Characters of a gram, and the character that stands before each text as often as a gram has earlier ones.
ORDER, START = 3, "\x02"
#: Grams that are sent to all tasks, at most: 12 bytes each.
TOP = 1 << 21
#: Counted grams that a task holds before it adds them up, and sends them on.
HELD, SENT = 400_000, 1_000_000
MIN_WORDS = 20
#: Most words in repeated windows, in percent.
REPEAT_SHARE = 30
WINDOW_WORDS = 8
#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Width of a band in median deviations, and how it widens: times 1 + SHORT / sqrt(characters).
BAND, SHORT = 5.0, 6.0
#: Least deviation that a band counts with.
LEAST_DEVIATION = 0.01

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_STEP = K.U(0x9E3779B97F4A7C15)


def language_key(lang: pa.Array) -> np.ndarray:
    """A number for each language; null is one of its own."""
    names = lang.dictionary_encode()
    kinds = [xxhash.xxh3_64_intdigest("-" if x is None else "+" + x) for x in [*names.dictionary.to_pylist(), None]]
    places = pc.fill_null(names.indices, len(kinds) - 1).to_numpy(zero_copy_only=False)
    return np.array(kinds, K.U)[places]


def gram_keys(points: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Hash of the language and the ORDER characters from each place on; lang has a number for each."""
    m = len(points) - ORDER + 1
    key = lang[:m].copy()
    with np.errstate(over="ignore"):
        for j in range(ORDER):
            key = (key + points[j : j + m]) * _STEP
    return K.mix(key)


def grams(column, lang: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts of languages: keys of their grams and the text of each, and the bytes of the texts with the first byte of
    each gram and of what follows it. A very long text comes in stretches that have each gram once."""
    padded = pc.binary_join_element_wise(pa.scalar(START * (ORDER - 1), pa.large_string()), pc.fill_null(column, "").cast(pa.large_string()), pa.scalar("", pa.large_string()))
    before = np.zeros(0, np.uint8)
    for buf, offs, goes_on in K.stretches(*K.strings(padded)):
        if goes_on:
            buf, offs = np.concatenate((before, buf)), np.array([0, len(before) + len(buf)])
        points, at = K.code_points(buf, offs)
        lead = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
        before = buf[lead[max(0, len(lead) - ORDER)] :]
        own = K.owner(at)
        m = len(points) - ORDER + 1
        same = np.flatnonzero(own[:m] == own[ORDER - 1 :]) if m > 0 else np.zeros(0, np.int64)
        if len(same):
            yield gram_keys(points.astype(K.U), lang[own])[same], own[same], buf, lead[same], lead[same + ORDER]


def _texts(buf: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts between places of UTF-8 bytes."""
    size = end - first
    offs = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(first - offs[:-1], size) + np.arange(offs[-1])
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(buf[at])])


class _Counts:
    """Rows (lang, gram, n, docs), added up by their keys."""

    def __init__(self) -> None:
        self.keys, self.n, self.docs, self.tables = [], [], [], []
        self.rows = 0

    def add(self, keys: np.ndarray, own: np.ndarray, table) -> None:
        """The grams of some texts; table makes (lang, gram) of places among them."""
        order = np.argsort(keys, kind="stable")
        k, o = keys[order], own[order]
        new = np.concatenate(([True], k[1:] != k[:-1]))
        first = np.flatnonzero(new)
        self.keys.append(k[first])
        self.n.append(np.diff(np.append(first, len(k))))
        self.docs.append(np.add.reduceat((new | np.concatenate(([True], o[1:] != o[:-1]))).astype(np.int64), first))
        self.tables.append(table(order[first]))
        self.rows += len(first)

    def merged(self, one_text: bool = False) -> None:
        keys, n, docs, table = np.concatenate(self.keys), np.concatenate(self.n), np.concatenate(self.docs), pa.concat_tables(self.tables)
        _, first, place = np.unique(keys, return_index=True, return_inverse=True)
        self.keys, self.tables, self.rows = [keys[first]], [table.take(pa.array(first))], len(first)
        self.n = [np.bincount(place, n).astype(np.int64)]
        self.docs = [np.ones(len(first), np.int64) if one_text else np.bincount(place, docs).astype(np.int64)]

    def batches(self) -> list[pa.RecordBatch]:
        table = self.tables[0].append_column("n", pa.array(self.n[0])).append_column("docs", pa.array(self.docs[0]))
        return table.combine_chunks().to_batches()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, limit = _Counts(), HELD
    for batch in batches:
        for part in K.slices(batch, "text"):
            names, own_counts = part.column("lang").dictionary_encode(), _Counts()
            for keys, own, buf, first, end in grams(part.column("text"), language_key(part.column("lang"))):

                def table(at: np.ndarray, own=own, buf=buf, first=first, end=end, names=names) -> pa.Table:
                    lang = names.take(pa.array(own[at])).cast(pa.string())
                    return pa.table({"lang": lang, "gram": _texts(buf, first[at], end[at])})

                own_counts.add(keys, own, table)
            if len(own_counts.keys) > 1:  # stretches of one text
                own_counts.merged(one_text=True)
            for name in ("keys", "n", "docs", "tables"):
                getattr(held, name).extend(getattr(own_counts, name))
            held.rows += own_counts.rows
            if held.rows >= limit:
                held.merged()
                limit = held.rows + HELD
                if held.rows >= SENT:
                    yield from held.batches()
                    held, limit = _Counts(), HELD
    if held.rows:
        held.merged()
        yield from held.batches()


def discounts(one: Column, two: Column, three: Column, four: Column) -> list[Column]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of grams that were counted once, twice ..."""
    n1, n2, n3, n4 = (F.greatest(x, F.lit(1)).cast("double") for x in (one, two, three, four))
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [F.greatest(F.lit(0.0), F.least(x, F.lit(most))) for x, most in zip(raw, (0.95, 1.9, 2.9), strict=True)]


def probabilities(counted: DataFrame) -> DataFrame:
    """(lang, gram, n, p) for counted grams (lang, gram, n, docs): p of the last character after the others."""
    same = lambda *on: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    level = counted.select("lang", F.col("gram").alias("g"), F.when(F.col("docs") > 1, F.col("n")).otherwise(0).alias("c"), F.col("n").alias("raw"))
    levels = [level]
    for _ in range(ORDER - 1):  # counts of lower orders: the kept grams that end in them
        level = cut(level.groupBy("lang", F.expr("substring(g, 2)").alias("g")).agg(F.count_if(F.col("c") > 0).alias("c")).withColumn("raw", F.col("c")), "level")
        levels.append(level)
    sums = levels[-1].groupBy("lang").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    p = levels[-1].alias("a").join(sums.alias("b"), same("lang")).select("a.lang", "g", ((F.col("c") + 0.5) / (F.col("total") + 0.5 * (F.col("kinds") + 1))).alias("p"))
    for level in reversed(levels[:-1]):
        d = level.groupBy("lang").agg(*(F.count_if(F.col("raw") == i).alias(f"n{i}") for i in (1, 2, 3, 4)))
        d = d.select("lang", *(x.alias(f"d{i}") for i, x in enumerate(discounts(*(F.col(f"n{i}") for i in (1, 2, 3, 4))), 1)))
        rows = level.withColumns({"context": F.expr("left(g, length(g) - 1)"), "g2": F.expr("substring(g, 2)")})
        seen = rows.where("c > 0").groupBy("lang", "context").agg(F.sum("c").alias("total"), *(F.count_if(t).alias(f"m{i}") for i, t in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") > 2))))
        rows = rows.alias("a").join(seen.alias("b"), same("lang", "context"), "left").select("a.*", "total", "m1", "m2", "m3")
        rows = rows.alias("a").join(d.alias("b"), same("lang")).select("a.*", "d1", "d2", "d3")
        rows = rows.alias("a").join(p.withColumnRenamed("g", "g2").alias("b"), same("lang", "g2")).select("a.*", "p")
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).when(F.col("c") > 2, F.col("d3")).otherwise(0.0)
        back = (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")
        p = rows.select("lang", "g", F.coalesce((F.col("c") - off) / F.col("total") + back * F.col("p"), F.col("p")).alias("p"), "raw")
        p = p if level is levels[0] else cut(p.drop("raw"), "order")
    return p.select("lang", F.col("g").alias("gram"), F.col("raw").alias("n"), "p")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            points, at = K.code_points(*K.strings(batch.column("gram")))
            lang = np.repeat(language_key(batch.column("lang")), ORDER)
            keys = gram_keys(points.astype(K.U), lang)[at[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("n"), pa.array(np.log(batch.column("p").to_numpy()))], ["key", "n", "log_p"])


def fit(docs: DataFrame) -> DataFrame:
    """The model of all rows of ``docs`` (text, lang): (key, n, log_p) of each gram."""
    counted = docs.mapInArrow(_count, "lang string, gram string, n long, docs long")
    counted = cut(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "grams")
    return cut(probabilities(counted).mapInArrow(_keyed, "key long, n long, log_p double"), "model")


def most_frequent(model: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and log-probabilities of the most frequent grams, at most so many."""
    by_count = sorted(((r[0], r[1]) for r in model.groupBy(F.least("n", F.lit(100_000))).count().collect()), reverse=True)
    least, total = by_count[0][0] + 1 if by_count else 0, 0
    for n, rows in by_count:
        total += rows
        if total > most:
            break
        least = n
    table = model.where(F.col("n") >= least).select("key", F.col("log_p").cast("float")).toArrow()
    keys, values = (table.column(c).to_numpy() for c in ("key", "log_p"))
    order = np.argsort(keys.view(K.U))
    return keys.view(K.U)[order], values[order]


def base_counts(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    buf, offs = K.strings(part.column("text"))
    docs = len(offs) - 1
    start, end, h = K.words(buf, offs)
    bounds = np.searchsorted(start, offs)
    inside = np.concatenate(([0], np.cumsum(((buf & 0xC0) != 0x80) & ~K.SPACE[buf])))
    marks = np.concatenate(([0], np.cumsum(_IS_SYMBOL[buf])))
    n_words = np.diff(bounds)
    return {
        "n_words": n_words,
        "word_chars": np.diff(inside[offs]),
        "n_symbols": np.diff(marks[offs]),
        "n_dup_lines": _dup_lines(buf, offs, start),
        "n_repeat_words": _repeat_words(h, bounds, docs),
    }


def _dup_lines(buf: np.ndarray, offs: np.ndarray, start: np.ndarray) -> np.ndarray:
    data, feeds, out = buf.tobytes(), np.flatnonzero(buf == 10), []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        i, j = np.searchsorted(feeds, (a, b))
        if i == j:
            out.append(0)
            continue
        lines = [x for x in data[a:b].split(b"\n") if x.strip(b" \t\n\v\f\r")]
        out.append(len(lines) - len(set(lines)))
    return np.array(out, np.int64)


def _repeat_words(h: np.ndarray, bounds: np.ndarray, docs: int) -> np.ndarray:
    out = np.zeros(docs, np.int64)
    if len(h) < WINDOW_WORDS:
        return out
    g = K.runs(h, WINDOW_WORDS)
    for k in np.flatnonzero(np.diff(bounds) > WINDOW_WORDS).tolist():
        a, b = int(bounds[k]), int(bounds[k + 1])
        mine = g[a : b - WINDOW_WORDS + 1]
        order = np.argsort(mine, kind="stable")
        same = mine[order][1:] == mine[order][:-1]
        if same.any():
            twice = np.zeros(len(mine), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(b - a + 1, np.int64)
            at = np.flatnonzero(twice)
            cover[at] += 1
            np.add.at(cover, at + WINDOW_WORDS, -1)
            out[k] = int((np.cumsum(cover)[:-1] > 0).sum())
    return out


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = shared.value
        for batch in batches:
            for part in K.slices(batch, "text"):
                docs = part.num_rows
                bits, size, rare = np.zeros(docs), np.zeros(docs, np.int64), []
                for keys, own, *_ in grams(part.column("text"), language_key(part.column("lang"))):
                    each, place = np.unique(keys, return_inverse=True)
                    at = np.minimum(np.searchsorted(known, each), max(len(known) - 1, 0))
                    there = known[at] == each if len(known) else np.zeros(len(each), bool)
                    log_p = np.where(there, values[at], np.float32(0)) if len(known) else np.zeros(len(each), np.float32)
                    bits -= K.sums(log_p[place], own, docs)
                    size += np.bincount(own, minlength=docs)
                    absent = np.flatnonzero(~there[place])
                    rare.append((own[absent], keys[absent]))
                owner, key = (np.concatenate(x) for x in zip(*rare, strict=True)) if rare else (np.zeros(0, np.int64), np.zeros(0, K.U))
                ends = np.searchsorted(owner, np.arange(docs + 1)).astype(np.int32)
                base = base_counts(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), *(pa.array(base[c]) for c in _COUNTS), pa.array(size), pa.array(bits), pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))],
                    ["doc_id", "lang", *_COUNTS, "n", "bits", "rare"],
                )

    return run


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and log_perplexity of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    model = fit(docs)
    top = most_frequent(model, TOP)
    schema = f"doc_id long, lang string, {', '.join(f'{c} long' for c in _COUNTS)}, n long, bits double, rare array<long>"
    scored = docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(top)), schema)
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    if len(top[0]) < model.count():  # grams that were not sent to all tasks
        rest = scored.select("row", F.explode("rare").alias("key")).join(model, "key").groupBy("row").agg(F.sum(-F.col("log_p")).alias("more"))
        scored = cut(scored.drop("rare").join(rest, "row", "left").withColumn("bits", F.col("bits") + F.coalesce("more", F.lit(0.0))).drop("more"), "scored")
    scored = scored.select("doc_id", "lang", *_COUNTS, "n", F.when(F.col("n") > 0, F.col("bits") / F.col("n")).otherwise(0.0).alias("log_perplexity"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    scored = scored.withColumn("band", F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("lang"))))
    passed = scored.where(~failed)
    middle = cut(passed.groupBy("band").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle")), "middle")
    apart = join_checked(passed, middle, ["band"], "left").groupBy("band").agg(
        F.first("middle").alias("middle"), F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10_000).alias("deviation")
    )
    wide = BAND * F.greatest("deviation", F.lit(LEAST_DEVIATION)) * (1 + SHORT / F.sqrt("n"))
    inside = F.abs(F.col("log_perplexity") - F.col("middle")) <= wide
    return join_checked(scored, cut(apart, "bands"), ["band"], "left").select(
        "doc_id", *_COUNTS, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"), "log_perplexity"
    )
