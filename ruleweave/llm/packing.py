"""Best-fit packing by hierarchical residuals.

Every partition packs its pieces by best fit, longest first, into bins of ``capacity`` tokens. Bins
that are nearly full are final; underfull bins become items of the next round, where fewer partitions
pack the bins of several, and so on up a tree. A piece's place is resolved through the rounds' tables
(bin, parent bin, offset). A task holds at most MERGE_ITEMS bins: where more stay underfull, the last
rounds keep several partitions, and rounds end when they no longer save bins.

Cases: a null text is empty and its document is the end id alone. Repeated rows are packed each.
An empty table gives no sequence. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm import kernels as K
from ruleweave.llm.shared import cut
from ruleweave.llm.tokens import encoder

#: Pieces, or bins of a merging round, that one task packs, about.
MERGE_ITEMS = 100_000
#: Partitions whose underfull bins meet in one task of the next round.
FAN_IN = 16


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill: longest items first, each to the open bin that
    it leaves the least room in."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    mask = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        room -= n
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


def _round(capacity: int, level: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("item").to_numpy(), b.column("length").to_numpy()) for b in batches]
        if not parts:
            return
        item, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        bins, offset, fill = best_fit(length, capacity)
        name = (np.int64(level) << 56) | (np.int64(TaskContext.get().partitionId()) << 32) | bins
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (item, name, offset, fill[bins])], ["item", "bin", "offset", "fill"])

    return pack


def pack_pieces(items: DataFrame, capacity: int, slack: int | None = None) -> DataFrame:
    """(item, bin, offset) for items (item long, length long <= capacity). slack: room that a final
    bin may keep, at most; the default is a hundredth of the capacity."""
    slack = capacity // 100 if slack is None else slack
    schema = "item long, bin long, offset long, fill long"
    level, items = 0, items.select("item", "length")
    tasks = max(1, -(-items.count() // MERGE_ITEMS))
    items = items.coalesce(tasks) if items.rdd.getNumPartitions() > tasks else items.repartition(tasks)
    placed = cut(items.mapInArrow(_round(capacity, level), schema), "packed")
    out, last, parts = placed.select("item", "bin", "offset"), placed, tasks
    while parts > 1:
        bins = last.where(F.col("fill") < capacity - slack).groupBy("bin").agg(F.first("fill").alias("length"))
        bins = cut(bins.select(F.col("bin").alias("item"), "length"), "underfull")
        n = bins.count()
        fewer = max(-(-parts // FAN_IN), -(-n // MERGE_ITEMS))
        if not n or fewer >= parts and level:
            break
        level, parts = level + 1, fewer
        last = cut(bins.repartition(parts).mapInArrow(_round(capacity, level), schema), "packed")
        up = last.select(F.col("item").alias("bin"), F.col("bin").alias("parent"), F.col("offset").alias("shift"))
        out = out.join(up, "bin", "left").select(
            "item", F.coalesce("parent", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
        )
        if last.select("bin").distinct().count() > 0.99 * n and parts > 1:
            break
    return out


def _pieces(path: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made = encoder(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in K.slices(batch, "text"):
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = memoryview(encode(text or "") + end)
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[a : a + 4 * capacity]
                        out.append((made, doc_id, k, a // 4, len(piece) // 4, zlib.crc32(piece)))
                        made += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    ["item", "doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return split


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Each document's ids and end id, cut into pieces of at most ``capacity`` ids."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _pieces(tokenizer, end_id, capacity), "item long, doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    pieces = cut(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    placed = pack_pieces(pieces, capacity)
    return pieces.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
