"""Document fingerprints: invertible Bloom lookup sketches of paragraph pieces, with SQL functions only.

A text's pieces are runs of at most PIECE_WORDS words within a line, a word of more than WORD_CHARS characters (as
in scripts without spaces) counting as several; each has a 64-bit digest, and a text is the set of its digests.
Pieces start anew at each line, so a word put into a line moves the pieces behind it up to the line's end only. A sketch has ROWS x c cells of (count, xor of digests, xor of their checks); a
digest enters one cell of each row. Sketches of two texts subtract cell by cell; a cell left with one
digest, confirmed by its check, is peeled from its other cells, until all cells are empty: the digests
peeled are those that differ.

The fingerprint is the sketch of BASE columns. Where its difference cannot be peeled, the digests
are dealt to 2**k sub-sketches by their low bits, and each is decoded by itself, with columns doubled
until it succeeds. What fails at the largest size too is compared digest by digest.

likeness = (a + b - d) / (a + b + d) for a and b digests of which d differ: the share that both have of
all that either has; 1 for two texts without words.

Next documents: rows are dealt to ranges of ids, and those of an id with many rows (as null) to ranges of a hash of
their texts; the first row of each range is also sent to the range that precedes it in descending order, so no task
sees all rows.

Cases: null text: empty. Null doc_id: below all others. Equal doc_ids: descending by a hash of the text, then the text.
One row: it is its own next. Repeated rows follow each other. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECE_WORDS, WORD_CHARS = 12, 16
ROWS, BASE = 3, 8
#: Columns that a sub-sketch is tried with; powers of two.
SIZES = [4, 8, 16, 32, 64, 128, 256, 512]
#: Digests of both texts that share a sub-sketch, at most on average.
LOAD = 6
#: First bit of a digest that gives its column in each row; lower bits choose the sub-sketch.
SHIFTS = [10, 28, 46]

_CELL = "named_struct('n', {n}, 'k', {k}, 'h', {h})"
_EMPTY = _CELL.format(n="0", k="0L", h="0L")


def _column(digest: str, row: int, mask: str) -> str:
    return f"(shiftrightunsigned({digest}, {SHIFTS[row]}) & {mask})"


def pieces_sql(text: str) -> str:
    return rf"array_distinct(transform(regexp_extract_all({text}, '(?:[^ \\n]{{1,{WORD_CHARS}}}+ *+){{1,{PIECE_WORDS}}}+', 0), t -> xxhash64(t)))"


def cells_sql(digests: str, mask: str) -> str:
    """The sketch of an array of digests: the cells of the first row, the second, the third. mask: columns less one."""
    entered = _CELL.format(n="a.n + 1", k="a.k ^ d", h="a.h ^ xxhash64(d)")
    rows = [f"transform(sequence(0, {mask}), j -> aggregate({digests}, {_EMPTY}, (a, d) -> if({_column('d', r, mask)} = j, {entered}, a)))" for r in range(ROWS)]
    return f"concat({', '.join(rows)})"


def subtract_sql(x: str, y: str) -> str:
    return f"zip_with({x}, {y}, (p, q) -> {_CELL.format(n='p.n - q.n', k='p.k ^ q.k', h='p.h ^ q.h')})"


def peel_sql(cells: str, mask: str, most: str) -> str:
    """(ok, found): whether the sketch could be emptied, and the digests with their sign; at most ``most`` of them."""
    pure = "get(filter(s.t, x -> abs(x.n) = 1 and x.h = xxhash64(x.k)), 0)"
    places = ", ".join(f"'i{r}', {r} * ({mask} + 1) + {_column('p.k', r, mask)}" for r in range(ROWS))
    held = f"named_struct('k', p.k, 'n', p.n, 'h', p.h, {places})"
    here = " or ".join(f"i = q.i{r}" for r in range(ROWS))
    without = f"transform(s.t, (x, i) -> if({here}, {_CELL.format(n='x.n - q.n', k='x.k ^ q.k', h='x.h ^ q.h')}, x))"
    after = f"named_struct('t', {without}, 'found', concat(s.found, array(named_struct('k', q.k, 'n', q.n))), 'stop', false)"
    after = f"element_at(transform(array({held}), q -> {after}), 1)"
    halted = "named_struct('t', s.t, 'found', s.found, 'stop', true)"
    step = f"if(s.stop, s, element_at(transform(array({pure}), p -> if(p is null, {halted}, {after})), 1))"
    none = "cast(array() as array<struct<k: bigint, n: int>>)"
    start = f"named_struct('t', {cells}, 'found', {none}, 'stop', false)"
    empty = "forall(s.t, x -> x.n = 0 and x.k = 0L and x.h = 0L)"
    return f"aggregate(sequence(0, {most}), {start}, (s, z) -> {step}, s -> named_struct('ok', {empty}, 'found', s.found))"


def differences_sql(a: str, b: str, base_a: str, base_b: str) -> str:
    """The differing digests (array of (k, n), n = 1: only in a) of two arrays of digests whose base
    sketches are given."""
    result = "struct<ok: boolean, found: array<struct<k: bigint, n: int>>>"
    larger = peel_sql(subtract_sql(cells_sql("w.x", "c"), cells_sql("w.y", "c")), "c", "size(w.x) + size(w.y)")
    only = "transform(array_except({0}, {1}), t -> named_struct('k', t, 'n', {2}))"
    failed = f"concat({only.format('w.x', 'w.y', 1)}, {only.format('w.y', 'w.x', -1)})"
    tries = f"aggregate(array({', '.join(str(c - 1) for c in SIZES)}), cast(null as {result}), (r, c) -> if(coalesce(r.ok, false), r, {larger}), r -> if(r.ok, r.found, {failed}))"
    # dealt twice, first by some of the bits and then by the others, so that no digest is looked at for each sub-sketch
    dealt = "transform(sequence(0L, {mask}), g -> named_struct('x', filter({x}, t -> {bits} & {mask} = g), 'y', filter({y}, t -> {bits} & {mask} = g)))"
    inner = dealt.format(x="u.x", y="u.y", bits="shiftrightunsigned(t, p.b)", mask="p.fine")
    outer = dealt.format(x=a, y=b, bits="t", mask="p.coarse")
    bits = f"cast(ceil(log2(greatest(1.0, (size({a}) + size({b})) / {LOAD}D))) as int)"
    masks = "named_struct('b', n div 2, 'coarse', shiftleft(1L, n div 2) - 1, 'fine', shiftleft(1L, n - n div 2) - 1)"
    masks = masks.replace("n div 2", "cast(n div 2 as int)")
    parts = f"transform(array({bits}), n -> {masks})"
    whole = f"element_at(transform({parts}, p -> flatten(transform({outer}, u -> flatten(transform({inner}, w -> {tries}))))), 1)"
    first = peel_sql(subtract_sql(base_a, base_b), str(BASE - 1), f"{ROWS * BASE}")
    return f"element_at(transform(array({first}), f -> if(f.ok, f.found, {whole})), 1)"


def likeness_sql(a: str, b: str, differ: str) -> str:
    both = f"(size({a}) + size({b}))"
    return f"if({both} = 0, 1.0D, cast({both} - size({differ}) as double) / ({both} + size({differ})))"


def fingerprint_sql(base: str, text: str) -> str:
    cell = "concat(lpad(hex(x.n), 4, '0'), lpad(hex(x.k), 16, '0'), left(lpad(hex(x.h), 16, '0'), 8))"
    return f"concat(lower(array_join(transform({base}, x -> {cell}), '')), lpad(lower(hex(xxhash64({text}))), 16, '0'))"


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: the text of the next lower doc_id, for the lowest that of the highest."""
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(lowest)))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    # an id that is several of the cuts has the rows of several ranges: cut them by their hashes
    often = {i: k for i, k in Counter(cuts).items() if k > 1}
    ends = sorted({(i, (2 * j - k) * (1 << 63) // k if i in often else 0) for i, k in Counter(cuts).items() for j in range(k if i in often else 1)})
    rows = rows.withColumn("at", F.struct("id", (F.xxhash64("text") if often else F.lit(0).cast("long")).alias("h")))
    pair = "array<struct<id: bigint, h: bigint>>"
    bounds = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(h).cast("long").alias("h")) for i, h in ends]).cast(pair)
    place = F.size(F.filter(bounds, lambda b: b < F.col("at")))
    top = {r["range"]: r["top"] for r in rows.groupBy(place.alias("range")).agg(F.max("at").alias("top")).collect()}
    used = sorted(top)
    after = {r: used[(i + 1) % len(used)] for i, r in enumerate(used)}  # the range whose last row this one's first row follows
    size = (used[-1] + 1) if used else 1
    tops = F.array(*[F.struct(F.lit(top[i]["id"] if i in top else lowest).cast("long").alias("id"), F.lit(top[i]["h"] if i in top else 0).cast("long").alias("h")) for i in range(size)])
    nexts = F.array(*[F.lit(after.get(i, 0)) for i in range(size)])
    placed = rows.withColumn("range", place)
    guest = F.struct(F.get(nexts, F.col("range")).alias("range"), F.lit(1).alias("guest"))
    own = F.struct(F.col("range"), F.lit(0).alias("guest"))
    placed = placed.withColumn("to", F.explode(F.when(F.col("at") == F.get(tops, F.col("range")), F.array(own, guest)).otherwise(F.array(own))))
    placed = placed.select("doc_id", "id", "text", F.col("to.range").alias("range"), F.col("to.guest").alias("guest"))
    order = Window.partitionBy("range").orderBy("guest", F.desc("id"), F.xxhash64("text").desc(), "text")
    return placed.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next_text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and how many
    digests the edit removed and added (n_only_before, n_only_after)."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.selectExpr("*", "cast(n_chars div 3 as int) as cut")
    rows = rows.selectExpr("doc_id", "text", "n_chars", "next_text", "concat(substring(text, 1, cast(n_chars as int) - cut), substring(next_text, 1, cut)) as edited")
    rows = rows.selectExpr(
        "doc_id", "n_chars", "sha2(edited, 256) as edited_sha256", "text", "edited",
        f"{pieces_sql('text')} as a", f"{pieces_sql('edited')} as e", f"{pieces_sql('next_text')} as b",
    )
    rows = rows.selectExpr("*", *(f"{cells_sql(x, str(BASE - 1))} as c{x}" for x in "aeb"))
    rows = rows.selectExpr(
        "doc_id", "n_chars", "edited_sha256", "a", "e", "b",
        f"{fingerprint_sql('ca', 'text')} as fingerprint", f"{fingerprint_sql('ce', 'edited')} as edited_fingerprint",
        f"{differences_sql('a', 'e', 'ca', 'ce')} as d_edited", f"{differences_sql('a', 'b', 'ca', 'cb')} as d_next",
    )
    return rows.selectExpr(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        f"{likeness_sql('a', 'e', 'd_edited')} as near_edited", f"{likeness_sql('a', 'b', 'd_next')} as near_next",
        "cast(size(filter(d_edited, t -> t.n = 1)) as long) as n_only_before", "cast(size(filter(d_edited, t -> t.n = -1)) as long) as n_only_after",
    )
