"""N-gram Jaccard self-join by filters over several global token orders.

A document's set is its distinct 5-word shingles (64-bit hashes); a document with fewer words
has its whole word sequence as one shingle, one without words has the empty set and no link.
Two sets link when ``100 * |intersection| >= 80 * |union|``.

A linked pair shares a token among the first ``n - ceil(0.8 n) + 1`` tokens of both sets,
whatever the total order of tokens is. Three orders are used, and a pair must pass all of them:

* order A: by hash. A pass over all texts sends twice the least prefix, as packed arrays; linked sets
  share about half of that prefix (``long_prefix``), and most texts end here.
* order B: by document frequency among the remaining sets, then hash: common passages come last,
  so they make no candidates unless they make up most of both texts.
* order C: by the logarithm of the frequency, then another hash; tested pair by pair beside order A
  before the exact intersection.

No bucket of a token is expanded into its pairs at once. Each bucket elects one pivot, members are
verified against the pivot only, links are contracted into components, and this is repeated with
other pivots. What still crosses components afterwards is compared exactly, with sets of about its size, so no link
that joins two components is lost, and a group of copies of any size costs a number of comparisons in
proportion to its members. Sets that share a token early in their orders and are in no component with each other cost a
comparison of sizes each, in these last buckets only.

Cases: null or empty text: ``n_shingles`` 0, a component of its own. Exact copies and repeated rows
share one node. Rows that repeat a ``doc_id`` are judged each by its own text. Null ``doc_id`` is
kept and never chosen as a component's id unless all its members are null. Other columns are ignored.
Equality of sets is equality of a 64-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm import kernels as K
from ruleweave.llm.shared import BROADCAST_ROWS, cut, discard, join_rows

SHINGLE = 5
#: Links need 100 * intersection >= SHARE * union.
SHARE = 80
#: Most rounds with one pivot per bucket before what is left is compared in full, and the share of sets that
#: a round must link for another one.
PIVOT_ROUNDS, WORTH = 3, 0.5
#: Sets are compared in full within bands of sizes by powers of this, which is above 100 / SHARE.
BAND = 1.3
#: From this size on a larger partner's prefix never leaves fewer live tokens than the set's own size tells.
SMALL = 64


def needed(n):
    """Least intersection of a linked pair, from one side's size."""
    return -(-SHARE * n // 100)


def token_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a batch."""
    buf, offs = K.strings(batch.column("text"))
    start, _, h = K.words(buf, offs, lower=True)
    bounds = np.searchsorted(start, offs)
    g = K.runs(h, SHINGLE)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(g[a : b - SHINGLE + 1])
        else:
            yield K.runs(h[a:b], b - a) if b > a else np.zeros(0, K.U)


def _arrays(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, K.U)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, K.U).view(np.int64))


def _node(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes())


def _searched(n: int) -> int:
    """Length of the prefix of order A that is searched: twice the least one."""
    return min(n, 2 * (n - needed(n) + 1))


@lru_cache(1 << 16)
def long_prefix(n: int) -> tuple[int, int]:
    """Length of the prefix of order A that is searched, and how many of its tokens are in the searched
    prefix of a linked set at least, whatever that set's size."""
    m = _searched(n)
    if n >= SMALL:
        return m, m - (n - needed(n))
    # of c common tokens the prefixes of sizes n and k share at least the least of these two
    shared = []
    for k in range(max(needed(n), 1), n * 100 // SHARE + 1):
        c = -(-SHARE * (n + k) // (100 + SHARE))
        shared.append(min(m - (n - c), _searched(k) - (k - c)))
    return m, min(shared, default=1)


def least_live(n):
    """The second of ``long_prefix`` as a column."""
    need = F.ceil(SHARE * n / 100)
    small = F.array(*(F.lit(long_prefix(k)[1]) for k in range(SMALL)))
    return F.when(n < SMALL, F.get(small, n.cast("int"))).otherwise(F.least(n, 2 * (n - need + 1)) - (n - need))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "text"):
            sets = list(token_sets(part))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), _signed([_node(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "node", "n"]
            )


def _new_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, node, tokens) of the sets that the task meets for the first time."""
    seen: set[int] = set()
    for batch in batches:
        for part in K.slices(batch, "text"):
            for doc_id, tokens in zip(part.column("doc_id").to_pylist(), token_sets(part), strict=True):
                node = _node(tokens)
                if len(tokens) and node not in seen:
                    seen.add(node)
                    yield doc_id, node, tokens


#: Tokens that a task holds before it sends them on; low bits of tokens and nodes that are sent.
HELD_TOKENS = 1_000_000
#: Tokens that meet in one task, about.
PART_TOKENS = 2_000_000
LOW = K.U((1 << 48) - 1)


def _blobs(parts: int):
    """Rows (part, blob): 48 bits each of tokens and of one or two different nodes that have them;
    a token goes to the part that its upper 32 bits choose."""

    def pack(tokens: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        token = np.concatenate(tokens)
        node = np.repeat(np.array(nodes, K.U) & LOW, [len(t) for t in tokens])
        order = np.argsort(token, kind="stable")
        token, node = token[order], node[order]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        token, lo, hi = token[first], np.minimum.reduceat(node, first), np.maximum.reduceat(node, first)
        two = lo != hi
        token, node = np.concatenate((token, token[two])), np.concatenate((lo, hi[two]))
        part = (token >> K.U(32)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        token, node, part = token[order] & LOW, node[order], part[order]
        rows = np.empty((len(token), 3), np.uint32)
        rows[:, 0], rows[:, 1] = token & K.U(0xFFFFFFFF), (token >> K.U(32)) | (node >> K.U(32) << K.U(16))
        rows[:, 2] = node & K.U(0xFFFFFFFF)
        ends = np.searchsorted(part, np.arange(parts + 1))
        use = np.flatnonzero(np.diff(ends))
        return pa.RecordBatch.from_arrays(
            [pa.array(use.astype(np.int32)), pa.array([rows[ends[i] : ends[i + 1]].tobytes() for i in use], pa.binary())], ["part", "blob"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, nodes, held = [], [], 0
        for _, node, s in _new_sets(batches):
            tokens.append(s[: long_prefix(len(s))[0]])
            nodes.append(node)
            held += len(tokens[-1])
            if held >= HELD_TOKENS:
                yield pack(tokens, nodes)
                tokens, nodes, held = [], [], 0
        if tokens:
            yield pack(tokens, nodes)

    return run


def _live(table: pa.Table) -> pa.Table:
    """Of one part: the low bits of the tokens that two different nodes have."""
    rows = np.frombuffer(b"".join(table.column("blob").to_pylist()), np.uint32).reshape(-1, 3).astype(K.U)
    token = rows[:, 0] | (rows[:, 1] & K.U(0xFFFF)) << K.U(32)
    node = rows[:, 2] | rows[:, 1] >> K.U(16) << K.U(32)
    order = np.argsort(token, kind="stable")
    token, node = token[order], node[order]
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    two = np.minimum.reduceat(node, first) != np.maximum.reduceat(node, first)
    return pa.table({"token": pa.array(token[first][two].view(np.int64))})


#: Least and most bits of the map of live tokens that all tasks get (64 MB at most). It has 8 to 16 bits a live
#: token; beyond its greatest size it only lets more tokens through to the exact join.
MAP_BITS = 1 << 20, 1 << 29


def map_bits(live: int) -> int:
    least, most = MAP_BITS
    return min(most, max(least, 1 << (8 * max(live, 1) - 1).bit_length()))


def _maybe(shared):
    """(token, node, doc_id) of prefix tokens that the map of live tokens lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value.view(K.U)
        last = K.U(64 * len(bitmap) - 1)
        rows: list[tuple] = []
        held = 0

        def flush():
            sizes = [len(r[2]) for r in rows]
            ids = pa.array([r[0] for r in rows], pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), sizes)))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([r[2] for r in rows]).view(np.int64)), pa.array(np.repeat(np.array([r[1] for r in rows], K.U), sizes).view(np.int64)), ids],
                ["token", "node", "doc_id"],
            )

        for doc_id, node, s in _new_sets(batches):
            m, least = long_prefix(len(s))
            token = s[:m] & LOW
            token = token[(bitmap[((token & last) >> K.U(6)).astype(np.int64)] >> (token & K.U(63)) & K.U(1)).astype(bool)]
            if len(token) >= least:
                rows.append((doc_id, node, token))
                held += len(token)
            if held >= HELD_TOKENS // 8:
                yield flush()
                rows, held = [], 0
        if rows:
            yield flush()

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for doc_id, node, s in _new_sets(batches):
        rows.append((doc_id, node, s))
        if sum(len(r[2]) for r in rows[-50:]) > HELD_TOKENS // 8 or len(rows) == 500:
            yield _whole_batch(rows)
            rows = []
    if rows:
        yield _whole_batch(rows)


def _whole_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), _signed([r[1] for r in rows]), pa.array([len(r[2]) for r in rows], pa.int64()), _arrays([r[2] for r in rows])],
        ["doc_id", "node", "n", "tokens"],
    )


def _first_tokens(tokens: np.ndarray, df: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens in the orders B and C of a set of size n, of which these are the tokens
    that occur in other sets (in both orders all others come before them)."""
    room = n - needed(n) + 1 - (n - len(tokens))
    if room <= 0:
        return tokens[:0], tokens[:0]
    b = tokens[np.lexsort((K.mix(tokens), df))[:room]]
    c = tokens[np.lexsort((K.mix(tokens ^ K.U(0xA5A5A5A5A5A5A5A5)), np.log2(df).astype(np.int64)))[:room]]
    return b, c


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {"node": [], "n": [], "live": [], "b": [], "c": []}
        for node, n, live in zip(*(batch.column(c).to_pylist() for c in ("node", "n")), _pairs(batch.column("live")), strict=True):
            b, c = _first_tokens(*live, n)
            if len(b):
                for k, v in (("node", node), ("n", n), ("live", len(live[0])), ("b", b), ("c", c)):
                    rows[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(rows[k], pa.int64()) for k in ("node", "n", "live")), _arrays(rows["b"]), _arrays(rows["c"])], list(rows)
        )


def _pairs(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    flat = column.flatten()
    token = flat.field("token").to_numpy(zero_copy_only=False).view(K.U)
    df = flat.field("df").to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *column.value_lengths().to_pylist()])
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield token[a:b], df[a:b]


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *column.value_lengths().to_pylist()])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def linked(x: np.ndarray, y: np.ndarray, xc: np.ndarray, yc: np.ndarray) -> bool:
    """Filters of the orders A and C, then the exact test. x and y: sorted as unsigned."""
    n, m = len(x), len(y)
    if min(n, m) < needed(max(n, m)):
        return False
    a = np.intersect1d(x[: n - needed(n) + 1], y[: m - needed(m) + 1], assume_unique=True)
    if not len(a) or not len(np.intersect1d(xc, yc, assume_unique=True)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= SHARE * (n + m - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(*(_lists(batch.column(c)) for c in ("tokens", "tokens2", "c", "c2")), strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("node2"), pa.array([linked(*s) for s in sets], pa.bool_())], ["node", "node2", "link"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that edges (node, node2) lead to, by alternating large-star and
    small-star contraction; every step is written to the shared folder."""
    edges = cut(edges.select("node", "node2").where("node != node2").distinct(), "edges")
    if edges.isEmpty():
        return edges.selectExpr("node", "node2 as comp")
    while True:
        both = edges.union(edges.selectExpr("node2", "node"))
        least = both.groupBy("node").agg(F.min("node2").alias("m")).withColumn("m", F.least("m", "node"))
        # a hub that is the least of its neighbours keeps them; only others are looked up
        large = join_rows(both.where("node2 > node"), least, "node").selectExpr("node2 as node", "m as node2").where("node != node2").distinct()
        down = cut(large.selectExpr("greatest(node, node2) as node", "least(node, node2) as node2"), "down")
        least = down.groupBy("node").agg(F.min("node2").alias("m"))
        small = join_rows(down, least, "node")
        new = cut(small.selectExpr("node2 as node", "m as node2").union(least.selectExpr("node", "m as node2")).where("node != node2").distinct(), "edges")
        # done when every node hangs on one root and no root hangs on a node
        ends = new.groupBy("node").agg(F.count("*").alias("k")).join(new.selectExpr("node2 as root").distinct(), F.col("node") == F.col("root"), "left").where("k > 1 or root is not null")
        discard(edges, down)
        edges = new
        if ends.isEmpty():
            return edges.selectExpr("node", "node2 as comp")


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the component) of each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    sets = cut(docs.mapInArrow(_names, "doc_id long, node long, n long"), "sets")
    comp = _links(docs, _candidates(spark, docs, sets))
    comp = comp.union(comp.selectExpr("comp", "comp").distinct())  # roots are in their components
    # least id of each set, then of each component; whatever the copies, a set and a component have one row each here
    alone = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    names = cut(alone.join(comp, "node", "left"), "names")
    joined = names.where("comp is not null")
    least = joined.groupBy("comp").agg(F.min("least").alias("id"))
    ids = join_rows(joined.select("node", "comp"), least, "comp").select("node", "id")
    ids = cut(ids.union(names.where("comp is null").select("node", "least")), "ids")
    own = join_rows(sets.where("n > 0"), ids, "node").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("id", "doc_id").alias("component_id"))
    return own.union(sets.where("n = 0").select("doc_id", "n", "doc_id"))


def _candidates(spark, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, doc_id): one document of each set that order A leaves."""
    # the tokens that are sent, at most, tell how many parts there are
    sent = sets.agg(F.sum(F.least("n", 2 * (F.col("n") - F.ceil(SHARE * F.col("n") / 100) + 1)))).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sent // PART_TOKENS))
    blobs = docs.mapInArrow(_blobs(parts), "part int, blob binary")
    live = cut(blobs.groupBy("part").applyInArrow(_live, "token long").distinct(), "live")
    bits = map_bits(live.count())
    spread = live.selectExpr(f"cast(shiftrightunsigned(token & {bits - 1}L, 6) as int) as word", "shiftleft(1L, cast(token & 63 as int)) as bit")
    words = spread.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    maybe = docs.mapInArrow(_maybe(spark.sparkContext.broadcast(bitmap)), "token long, node long, doc_id long")
    found = maybe.join(live, "token").groupBy("node", "doc_id").agg(F.count("*").alias("k"))
    found = found.join(sets.groupBy("node").agg(F.first("n").alias("n")), "node")
    found = found.where(F.col("k") >= least_live(F.col("n")))
    chosen = found.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).getField("doc_id").alias("doc_id"))
    return cut(chosen, "chosen")


def _links(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    rows = chosen.count()
    pick = chosen.select("doc_id").distinct()
    picked = docs.join(F.broadcast(pick) if rows <= BROADCAST_ROWS else pick, docs.doc_id.eqNullSafe(pick.doc_id), "left_semi")
    whole = picked.mapInArrow(_whole, "doc_id long, node long, n long, tokens array<long>")
    whole = cut(whole.join(F.broadcast(chosen.select("node")) if rows <= BROADCAST_ROWS else chosen.select("node"), "node", "left_semi").select("node", "n", "tokens"), "whole")
    each = whole.select("node", F.explode("tokens").alias("token"))
    df = each.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    shared = each.join(df, "token").groupBy("node").agg(F.collect_set(F.struct("token", "df")).alias("live"))
    shared = shared.join(whole.select("node", "n").distinct(), "node").where(f"100 * size(live) >= {SHARE} * n")
    ordered = cut(shared.mapInArrow(_order, "node long, n long, live long, b array<long>, c array<long>"), "ordered")
    nodes = cut(whole.join(ordered.select("node", "c"), "node"), "nodes")
    discard(whole)
    # most: tokens from this one on; a linked pair meets at its first common token, so it has no more in common
    member = ordered.select("node", "n", "live", F.posexplode("b").alias("pos", "token")).selectExpr("node", "n", "live", "token", "live - pos as most")
    comp, links, seen, last = None, None, None, False
    for step in range(PIVOT_ROUNDS + 1):
        state = member.withColumn("comp", F.col("node")) if comp is None else member.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        state = cut(state, "state")
        buckets = state.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        if buckets.isEmpty():
            break
        last = last or step == PIVOT_ROUNDS
        if not last:
            # the member with the least share of tokens of its own is nearest to all others
            rank = F.col("live") / F.col("n") if step == 0 else F.xxhash64("node", F.lit(step)).cast("double")
            pivot = state.groupBy("token").agg(F.max(F.struct(rank.alias("rank"), "node", "n", "most", "comp")).alias("p")).select("token", "p.*").drop("rank")
            pivot = pivot.toDF("token", "node2", "n2", "most2", "comp2")
            pairs = state.join(pivot, "token")
        else:
            # sizes of linked sets differ by a quarter at most, so they are in the same band or in neighbouring ones
            mine = state.join(buckets.select("token"), "token", "left_semi").withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))))
            near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
            other = mine.select("token", near, F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("most").alias("most2"), F.col("comp").alias("comp2"))
            pairs = mine.join(other, ["token", "band"]).where("node < node2")
        pairs = pairs.where(f"comp != comp2 and 100 * least(most, most2) >= {SHARE} * (n + n2 - least(most, most2))")
        pairs = pairs.select(F.least("node", "node2").alias("node"), F.greatest("node", "node2").alias("node2")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["node", "node2"], "left_anti")
        full = pairs.join(nodes.select("node", "tokens", "c"), "node").join(nodes.selectExpr("node as node2", "tokens as tokens2", "c as c2"), "node2")
        judged = cut(full.select("node", "node2", "tokens", "tokens2", "c", "c2").mapInArrow(_verify, "node long, node2 long, link boolean"), "judged")
        discard(state)
        found = judged.where("link").select("node", "node2")
        seen = judged.select("node", "node2") if seen is None else seen.union(judged.select("node", "node2"))
        links = found if links is None else links.union(found)
        comp = components(links)
        if last:
            break
        last = found.count() < WORTH * ordered.count()
    return docs.sparkSession.createDataFrame([], "node long, comp long") if comp is None else comp
